"""Plan shapes shared by the operators: block scans, interval joins, picks and exact quantiles."""
