"""Schemas of the landed XML and of the published tables."""

from .constants import OBSERVATION_TYPES

# `_VALUE` is the text of an element, `_x` its attribute x. Elements whose attributes
# are never read are plain strings, which the parser builds a third faster.
_DIRECTION = "struct<_VALUE:string,_type:string,_unit:string,_description:string>"
_AXIS = f"struct<`jmx_eb:Direction`:{_DIRECTION},`jmx_eb:Radius`:array<string>>"
_AREA = f"struct<_type:string,`jmx_eb:Circle`:struct<`jmx_eb:Axes`:struct<`jmx_eb:Axis`:array<{_AXIS}>>>>"
_CENTRE = (
    "struct<`jmx_eb:Coordinate`:array<string>,Location:string,`jmx_eb:Direction`:string,"
    "`jmx_eb:Speed`:array<string>,`jmx_eb:Pressure`:string>"
)
_PROPERTY = (
    "struct<Type:string,TyphoonNamePart:struct<Name:string>,"
    f"CenterPart:{_CENTRE},WindPart:struct<`jmx_eb:WindSpeed`:array<string>>,"
    f"WarningAreaPart:array<{_AREA}>>"
)
_SECTION = (
    "struct<DateTime:struct<_VALUE:string,_type:string>,"
    f"Item:array<struct<Kind:array<struct<Property:{_PROPERTY}>>>>>"
)

HEAD = "struct<EventID:string,InfoType:string,Serial:string,InfoKindVersion:string>"
BODY = f"struct<MeteorologicalInfos:struct<MeteorologicalInfo:array<{_SECTION}>>>"

# Every repeatable element is an array, so one element and many read alike. Only
# the fields used are listed: the reader builds nothing else. The corrupt-record
# column has to come last for from_xml.
CORRUPT = "_corrupt_record"
BULLETIN = f"Head {HEAD}, Body {BODY}, {CORRUPT} string"

FEED_ENTRY = "title string, link struct<_href:string>"
TIMED_ENTRY = f"{FEED_ENTRY}, updated string"

OBSERVATION = (
    ", ".join(f"{n} {t}" for n, t in OBSERVATION_TYPES.items())
    + ", obs_jst timestamp_ntz, event_year string"
)

# The published columns, then what the engine stores beside them so that time
# ranges, years and sizes are real columns a scan can prune on.
DOCUMENT = (
    "id_ string, EventID string, TyphoonName string, ObservationDate string, "
    "ObservationTime string, ObservationDateTime string, InfoType string, Serial string, "
    "InfoKindVersion string, Text string, embedding array<float>, unique_event_id string, "
    "obs_jst timestamp_ntz, text_chars int, event_year string, event_bucket int"
)
