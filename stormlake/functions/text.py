"""Text and hashing expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def link_filename(link: Column) -> Column:
    """Last path segment; trailing slashes do not count."""
    return F.element_at(F.split(F.regexp_replace(link, "/+$", ""), "/"), -1)


def clean_section(section: Column) -> Column:
    """Delete newlines and pull a full stop to the word before it."""
    return F.regexp_replace(F.replace(section, F.lit("\n"), F.lit("")), r" ?\.", ".")


def clean_sections(text: Column) -> Column:
    """Clean every blank-line separated section and join them with one newline."""
    return F.array_join(F.transform(F.split(text, r"\n[ \t]*\n\s*"), clean_section), "\n")


def stable_bucket(text: Column) -> Column:
    """Sum of code points mod 9, plus 1."""
    points = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    total = F.aggregate(points, F.lit(0).cast("bigint"), lambda acc, p: acc + p)
    return (total % 9 + 1).cast("int")


def blank_to_null(text: Column) -> Column:
    """An empty element carries no value."""
    return F.nullif(text, F.lit(""))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
