"""Time expressions. All wall clocks are TIMESTAMP_NTZ, so no result depends on the
session time zone."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BAD_TIME

_ISO = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}:\d{2}(:\d{2}(\.\d{3}(\d{3})?)?)?(Z|[+-]\d{2}:\d{2})?)?$"
)
_ISO_WITH_OFFSET = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})$"
_LENIENT = r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}(T\d{1,2}:\d{1,2}:\d{1,2})?$"

NO_YEAR = "unknown"
TOKYO_OFFSET_MINUTES = 540
MAX_OFFSET_MINUTES = 18 * 60


def wall_clock(text: Column) -> Column:
    """The wall clock of an ISO text, offset dropped; null when it is not one."""
    bare = F.regexp_replace(text, r"(Z|[+-]\d{2}:\d{2})$", "")
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).otherwise(bare)
    return F.when(text.rlike(_ISO), iso.try_cast("timestamp_ntz"))


def observation_date(text: Column) -> Column:
    day = F.substring(wall_clock(text).cast("string"), 1, 10)
    return F.coalesce(day, F.lit(BAD_TIME))


def observation_time(text: Column) -> Column:
    clock = F.substring(wall_clock(text).cast("string"), 12, 15)
    padded = F.when(F.contains(clock, F.lit(".")), F.rpad(clock, 15, "0")).otherwise(clock)
    return F.coalesce(padded, F.lit(BAD_TIME))


def tokyo_time(text: Column) -> Column:
    """Wall clock in Tokyo of an ISO text that carries an offset, else null."""
    local = F.substring(text, 1, 19).try_cast("timestamp_ntz")
    ahead = F.substring(text, 21, 2).try_cast("int") * 60 + F.substring(text, 24, 2).try_cast("int")
    offset = (
        F.when(F.substring(text, 20, 1) == "Z", F.lit(0))
        .when(F.substring(text, 20, 1) == "-", -ahead)
        .otherwise(ahead)
    )
    valid = text.rlike(_ISO_WITH_OFFSET) & (F.abs(offset) <= MAX_OFFSET_MINUTES)
    return F.when(valid, F.timestamp_add("MINUTE", TOKYO_OFFSET_MINUTES - offset, local))


def lenient_time(text: Column) -> Column:
    """A date or date-time; anything else, ``None`` included, is null."""
    return F.when(text.rlike(_LENIENT), text.try_cast("timestamp_ntz"))


def event_year(text: Column) -> Column:
    """Year of a readable time; all others share one value, so partitions are bounded."""
    return F.when(wall_clock(text).isNotNull(), F.substring(text, 1, 4)).otherwise(NO_YEAR)
