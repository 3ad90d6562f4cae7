"""Training-data operators on tables of texts: scans, near duplicates, scores, counts and mixing.

Nothing outside this folder imports it. `queries` registers one query per operator.
"""
