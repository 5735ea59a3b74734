"""Cleaning of text columns as column expressions. Null stays null everywhere; what isn't recognised is tagged, not dropped."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "UNKNOWN:"
# Statuses of an enrollment, and another spelling of one.
STATUSES = ("ENROLLED", "GRADUATED", "DROPPED")
STATUS_SPELLINGS = {"DROPPED OUT": "DROPPED"}


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def nullify(text: Column) -> Column:
    """Without spaces at both ends; null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def category(text: Column, known: Iterable[str], spellings: dict[str, str] | None = None) -> Column:
    """The known value that the text is, whatever its case and surrounding space, else UNKNOWN: and the text as it was."""
    folded = F.upper(strip(text))
    found = F.when(text.isNull(), F.lit(None).cast("string"))
    for value in known:
        found = found.when(folded == value.upper(), value)
    for spelling, value in (spellings or {}).items():
        found = found.when(folded == spelling.upper(), value)
    return found.otherwise(F.concat(F.lit(UNKNOWN), text))


def status(text: Column) -> Column:
    return category(text, STATUSES, STATUS_SPELLINGS)


def is_unknown(text: Column) -> Column:
    return F.coalesce(text.startswith(UNKNOWN), F.lit(False))


def semester(text: Column) -> Column:
    """1 or 2, as text, from a number or a label that starts with 1st or 2nd; anything else as it was."""
    folded = F.lower(strip(text.cast("string")))
    return F.when(folded.isin("1", "2"), folded).when(folded.startswith("1st"), "1").when(folded.startswith("2nd"), "2").otherwise(text.cast("string"))


def whole_number(text: Column) -> Column:
    """An integer from text that holds a whole number, also one written with decimals; null otherwise."""
    number = text.try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("bigint"))


def lost(before: Column, after: Column) -> Column:
    """Whether a conversion lost a value."""
    return before.isNotNull() & after.isNull()


def header(names: Iterable[str]) -> list[str]:
    return [n.strip().lower() for n in names]
