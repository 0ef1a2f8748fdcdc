"""Bulletins to observations: one row per observed section, 23 fields."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    AREA_GALE,
    AREA_STORM,
    AXIS_ALL_ROUND,
    AXIS_BEARING,
    AXIS_UNIT,
    OBSERVATION_TYPES,
    OBSERVED,
    PROPERTY_CENTRE,
    PROPERTY_NAME,
    PROPERTY_WIND,
)
from ..functions.text import blank_to_null
from ..functions.times import event_year, tokyo_time

HEADER_FIELDS = ("EventID", "InfoType", "Serial", "InfoKindVersion")
_COORDINATE = r"^\s*([+-]\d+)\s*([+-]\d+)"


def headers(bulletins: DataFrame, *keep: str) -> DataFrame:
    """Header fields and the link as ``URL``."""
    fields = [blank_to_null(F.col(f"Head.{f}")).alias(f) for f in HEADER_FIELDS]
    return bulletins.select(*fields, F.col("link").alias("URL"), *keep)


def sections(bulletins: DataFrame, observed_only: bool = True) -> DataFrame:
    """One row per timed section, with the bulletin's header.

    The forecast sections are dropped inside the array, before they become rows.
    """
    infos = F.col("Body.MeteorologicalInfos.MeteorologicalInfo")
    if observed_only:
        infos = F.filter(infos, lambda s: s["DateTime"]["_type"] == OBSERVED)
    head = headers(bulletins, "file_name", "Body")
    return head.select(
        *HEADER_FIELDS, "URL", "file_name", F.explode(infos).alias("section")
    ).select(
        *HEADER_FIELDS,
        "URL",
        "file_name",
        F.col("section.DateTime._type").alias("section_type"),
        F.col("section.DateTime._VALUE").alias("ObservationTime"),
        F.col("section.Item").alias("items"),
    )


def unnest_properties(section_rows: DataFrame) -> DataFrame:
    """One row per section, item and kind, positions counted from 0."""
    items = section_rows.select(
        "EventID", "Serial", "section_type", "ObservationTime",
        F.posexplode("items").alias("item_no", "item"),
    )
    return items.select(
        "EventID", "Serial", "section_type", "ObservationTime", "item_no",
        F.posexplode("item.Kind").alias("kind_no", "kind"),
    ).select(
        "EventID", "Serial", "section_type", "ObservationTime", "item_no", "kind_no",
        F.col("kind.Property").alias("property"),
    )


def _present(array: Column) -> Column:
    return F.filter(array, lambda x: x.isNotNull())


def _properties(items: Column) -> Column:
    """All properties of a section in document order."""
    kinds = F.flatten(_present(F.transform(items, lambda i: i["Kind"])))
    return _present(F.transform(kinds, lambda k: k["Property"]))


def _last(properties: Column, kind: str) -> Column:
    return F.try_element_at(F.filter(properties, lambda p: p["Type"] == kind), F.lit(-1))


def _text_at(texts: Column, position: int) -> Column:
    """Text at a 0-based position; null when there are fewer or it is empty."""
    return blank_to_null(F.get(texts, F.lit(position)))


def coordinate(text: Column, part: int) -> Column:
    """Latitude (1) or longitude (2) of a coordinate text, divided by 100, 2 decimals."""
    digits = F.regexp_extract(text, _COORDINATE, part).try_cast("bigint")
    return F.when(digits.isNotNull(), F.format_string("%.2f", digits / 100))


def _axis_pairs(area: Column) -> Column:
    """Direction and radius of the accepted axes of a warning area.

    An area with an axis that lacks its unit or its second radius counts as missing.
    """
    axes = area["jmx_eb:Circle"]["jmx_eb:Axes"]["jmx_eb:Axis"]

    def malformed(axis: Column) -> Column:
        return (
            axis["jmx_eb:Direction"]["_unit"].isNull()
            | _text_at(axis["jmx_eb:Radius"], 1).isNull()
        )

    def accepted(axis: Column) -> Column:
        direction = axis["jmx_eb:Direction"]
        return (direction["_unit"] == AXIS_UNIT) & (
            F.coalesce(direction["_type"] == AXIS_BEARING, F.lit(False))
            | F.coalesce(direction["_description"] == AXIS_ALL_ROUND, F.lit(False))
        )

    def pair(axis: Column) -> Column:
        direction = axis["jmx_eb:Direction"]
        return F.struct(
            F.coalesce(direction["_VALUE"], direction["_description"]).alias("direction"),
            _text_at(axis["jmx_eb:Radius"], 1).alias("radius"),
        )

    return F.when(
        ~F.exists(axes, malformed), F.transform(F.filter(axes, accepted), pair)
    )


def _area(areas: Column, kind: str) -> Column:
    """The first warning area of a kind."""
    return F.try_element_at(F.filter(areas, lambda a: a["_type"] == kind), F.lit(1))


def property_groups(section_rows: DataFrame) -> DataFrame:
    """Section rows with the storm name, the centre, the wind and both warning areas."""
    props = section_rows.withColumn("props", _properties(F.col("items"))).drop("items")
    named = F.filter(
        F.col("props"), lambda p: (p["Type"] == PROPERTY_NAME) & p["TyphoonNamePart"].isNotNull()
    )
    picked = props.select(
        *[c for c in props.columns if c != "props"],
        F.try_element_at(named, F.lit(-1))["TyphoonNamePart"]["Name"].alias("name"),
        _last(F.col("props"), PROPERTY_CENTRE)["CenterPart"].alias("centre"),
        _last(F.col("props"), PROPERTY_WIND).alias("wind"),
    )
    return picked.withColumns(
        {
            "storm_area": _area(F.col("wind.WarningAreaPart"), AREA_STORM),
            "gale_area": _area(F.col("wind.WarningAreaPart"), AREA_GALE),
        }
    )


def axis_pairs(groups: DataFrame) -> DataFrame:
    """Property groups with the accepted axes of both areas as arrays."""
    return groups.withColumns(
        {
            "storm_pairs": _axis_pairs(F.col("storm_area")),
            "gale_pairs": _axis_pairs(F.col("gale_area")),
        }
    )


def observation_rows(bulletins: DataFrame) -> DataFrame:
    """The 23 fields of every observed section as text; what is missing is null."""
    paired = axis_pairs(property_groups(sections(bulletins)))
    place = _text_at(F.col("centre.`jmx_eb:Coordinate`"), 1)
    speeds = F.col("wind.WindPart.`jmx_eb:WindSpeed`")
    fields = {
        "TyphoonName": blank_to_null(F.col("name")),
        "CenterLat": coordinate(place, 1),
        "CenterLon": coordinate(place, 2),
        "CenterLocation": blank_to_null(F.col("centre.Location")),
        "CenterMovementDirection": blank_to_null(F.col("centre.`jmx_eb:Direction`")),
        "CenterSpeed": _text_at(F.col("centre.`jmx_eb:Speed`"), 1),
        "CentralPressure": blank_to_null(F.col("centre.`jmx_eb:Pressure`")),
        "MaxWindspeedNearCenter": _text_at(speeds, 1),
        "MaxGustSpeed": _text_at(speeds, 3),
    }
    for prefix, pairs in (("Bofuuiki", "storm_pairs"), ("Kyofuuiki", "gale_pairs")):
        for position in (0, 1):
            pair = F.get(F.col(pairs), F.lit(position))
            fields[f"{prefix}_Direction{position + 1}"] = pair["direction"]
            fields[f"{prefix}_Radius{position + 1}"] = pair["radius"]
    return paired.select(
        "EventID", "ObservationTime", "InfoType", "Serial", "InfoKindVersion",
        *[column.alias(name) for name, column in fields.items()],
        "URL", "file_name",
    )


def typed_observations(rows: DataFrame) -> DataFrame:
    """Cast to the declared types and add Tokyo time and event year."""
    columns = [
        F.col(name).try_cast(kind).alias(name) if kind != "string" else F.col(name)
        for name, kind in OBSERVATION_TYPES.items()
    ]
    return rows.select(
        *columns,
        tokyo_time(F.col("ObservationTime")).alias("obs_jst"),
        event_year(F.col("ObservationTime")).alias("event_year"),
    )
