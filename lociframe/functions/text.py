"""Text and ordering expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NBSP = "\u00a0"


def natural_key(name: Column, prefix: str = "chr") -> list[Column]:
    """Sort columns: numbered names by number, then the others by name."""
    rest = F.regexp_replace(name, prefix, "")
    number = F.when(rest.rlike("^[0-9]+$"), rest.try_cast("long"))
    return [number.isNull(), number, rest]


def in_scope(chrom: Column) -> Column:
    """Numbered chromosomes and X."""
    return chrom.rlike("^chr([0-9]+|X)$")


def is_autosome(chrom: Column, last: int = 38) -> Column:
    number = F.regexp_extract(chrom, "^chr([0-9]+)$", 1).try_cast("int")
    return F.coalesce(number.between(1, last), F.lit(False))


def format_bp(size: Column) -> Column:
    return (
        F.when(size >= 1_000_000, F.format_string("%.2fMb", size / 1e6))
        .when(size >= 1000, F.format_string("%dkb", F.floor(size / 1000)))
        .otherwise(F.format_string("%dbp", size.cast("long")))
    )


def sentence_case(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def clean_label(text: Column) -> Column:
    """Trim, with the no-break space treated as a space."""
    return F.trim(F.translate(text, NBSP, " "))


def is_fusion_name(name: Column) -> Column:
    """Two names of more than four letters joined by one hyphen."""
    return name.rlike("^[^-]{5,}-[^-]{5,}$")


def contains_any(text: Column, terms: list[str]) -> Column:
    """Substring test against fixed terms (letters, digits and underscores only)."""
    return text.rlike("|".join(terms))


def half_up(value: Column) -> Column:
    """Nearest integer of a value that is not negative."""
    return F.floor(value + 0.5).cast("long")
