"""Storm-name expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_name(name: Column) -> Column:
    """Upper case, the word TYPHOON deleted, trimmed."""
    bare = F.replace(F.upper(name), F.lit("TYPHOON"), F.lit(""))
    return F.regexp_replace(bare, r"(?U)^\s+|\s+$", "")


def without_hyphen(name: Column) -> Column:
    """Without hyphens and apostrophes: a question's words have neither."""
    return F.regexp_replace(name, "[-'’]", "")


def without_spaces(name: Column) -> Column:
    return F.replace(name, F.lit(" "), F.lit(""))


def name_matches(storm: Column, wanted: Column) -> Column:
    """The wanted (normalised) name occurs in the storm's name, or in its hyphen-less
    form, there also with the wanted name's spaces removed. An empty wanted name
    matches every named storm."""
    bare = without_hyphen(storm)
    return (
        F.contains(storm, wanted)
        | F.contains(bare, wanted)
        | F.contains(bare, without_spaces(wanted))
    )
