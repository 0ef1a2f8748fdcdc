"""Test inputs derived from the driver's tables by column arithmetic (FIXTURES.md)."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import (
    AREA_GALE,
    AREA_STORM,
    AXIS_ALL_ROUND,
    AXIS_BEARING,
    AXIS_UNIT,
    FEED_TITLE,
    OBSERVED,
    PROPERTY_CENTRE,
    PROPERTY_NAME,
    PROPERTY_WIND,
)

CORRECTION = "訂正"
ANNOUNCEMENT = "発表"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, as the landing zone that the fixtures derive from: dealt over all cores,
    since each file is a single row group."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.repartition(spark.sparkContext.defaultParallelism)


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _mod(n: int) -> Column:
    return (F.col("e") % n).cast("string")


def _property(kind: str, *parts) -> Column:
    return _text(f"<Kind><Property><Type>{kind}</Type>", *parts, "</Property></Kind>")


def _radii(value) -> Column:
    return _text(
        '<jmx_eb:Radius unit="海里">9999</jmx_eb:Radius><jmx_eb:Radius unit="km">',
        value, "</jmx_eb:Radius>",
    )


def _axis(attributes: str, direction: str, radius) -> Column:
    return _text(
        f"<jmx_eb:Axis><jmx_eb:Direction {attributes}>{direction}</jmx_eb:Direction>",
        _radii(radius), "</jmx_eb:Axis>",
    )


def _area(kind: str, *axes) -> Column:
    return _text(
        f'<WarningAreaPart type="{kind}"><jmx_eb:Circle><jmx_eb:Axes>', *axes,
        "</jmx_eb:Axes></jmx_eb:Circle></WarningAreaPart>",
    )


def _unless(absent: Column, element: Column) -> Column:
    return F.when(absent, F.lit("")).otherwise(element)


def bulletins(events: DataFrame, *also: str) -> DataFrame:
    """One bulletin per event, as ``link, body`` and the columns ``also``."""
    e, u = F.col("e"), F.col("u")
    rows = events.select(
        F.col("event_id").alias("e"), F.col("user_id").alias("u"), "ts", "event_type", *also
    ).withColumns(
        {
            # cast first: truncation works on timestamps, text keeps the wall clock
            "obs": F.concat(
                F.replace(F.substring(F.col("ts").cast("string"), 1, 13), F.lit(" "), F.lit("T")),
                F.lit(":00:00+09:00"),
            ),
            "name": F.when(u % 4 == 0, "KONG-REY").when(u % 4 == 1, "SHANSHAN").when(u % 4 == 2, "TRAMI"),
        }
    )
    name = _unless(
        F.col("name").isNull(),
        _property(PROPERTY_NAME, "<TyphoonNamePart><Name>", F.coalesce("name", F.lit("")), "</Name></TyphoonNamePart>"),
    )
    centre = _property(
        PROPERTY_CENTRE,
        '<CenterPart><jmx_eb:Coordinate type="度分">+9999+99999/</jmx_eb:Coordinate>',
        '<jmx_eb:Coordinate type="度">+', (e % 3000 + 1000).cast("string"),
        "+", (e % 8000 + 10000).cast("string"), "/</jmx_eb:Coordinate>",
        "<Location>L", _mod(20), "</Location>",
        _unless(
            e % 7 == 0,
            _text(
                '<jmx_eb:Direction unit="１６方位漢字">',
                F.element_at(F.array(*[F.lit(d) for d in "北南東西"]), (e % 4 + 1).cast("int")),
                "</jmx_eb:Direction>",
            ),
        ),
        _unless(
            F.col("event_type") == "error",
            _text('<jmx_eb:Speed unit="ノット">999</jmx_eb:Speed><jmx_eb:Speed unit="km/h">', _mod(60), "</jmx_eb:Speed>"),
        ),
        '<jmx_eb:Pressure unit="hPa">', (e % 100 + 900).cast("string"), "</jmx_eb:Pressure></CenterPart>",
    )
    speed = "jmx_eb:WindSpeed"
    wind = _property(
        PROPERTY_WIND,
        "<WindPart>",
        _unless(
            e % 11 == 0,
            _text(
                f"<{speed}>999</{speed}><{speed}>", _mod(70), f"</{speed}>",
                f"<{speed}>998</{speed}><{speed}>", _mod(90), f"</{speed}>",
            ),
        ),
        "</WindPart>",
        _unless(
            e % 3 == 0,
            _area(AREA_STORM, _axis(f'unit="{AXIS_UNIT}" description="{AXIS_ALL_ROUND}"', "", _mod(500))),
        ),
        _area(
            AREA_GALE,
            _axis('unit="度"', "180", "9999"),
            _axis(f'unit="{AXIS_UNIT}" type="{AXIS_BEARING}"', "南東", _mod(400)),
            _axis(f'unit="{AXIS_UNIT}" type="{AXIS_BEARING}"', "北西", _mod(300)),
        ),
    )
    # every second bulletin spreads its kinds over two items
    split = F.when(e % 2 == 0, F.lit("")).otherwise(F.lit("</Item><Item>"))
    forecast = _property(
        PROPERTY_CENTRE,
        "<CenterPart><jmx_eb:Coordinate>+1+1/</jmx_eb:Coordinate>"
        "<jmx_eb:Coordinate>+2+2/</jmx_eb:Coordinate><Location>F</Location></CenterPart>",
    )
    report = _text(
        "<Report><Head><EventID>TC", F.lpad((u % 50).cast("string"), 4, "0"), "</EventID><InfoType>",
        F.when(e % 5 == 0, CORRECTION).otherwise(ANNOUNCEMENT),
        "</InfoType><Serial>", e.cast("string"), "</Serial><InfoKindVersion>1.0_0</InfoKindVersion></Head>",
        f'<Body><MeteorologicalInfos><MeteorologicalInfo><DateTime type="{OBSERVED}">', F.col("obs"),
        "</DateTime><Item>", name, centre, split, wind, "</Item></MeteorologicalInfo>",
        '<MeteorologicalInfo><DateTime type="予報">', F.col("obs"), "</DateTime><Item>", forecast,
        "</Item></MeteorologicalInfo></MeteorologicalInfos></Body></Report>",
    )
    return rows.select(
        _text("https://example.org/bulletins/", e.cast("string"), "_0_storm.xml").alias("link"),
        F.when(e % 97 == 0, F.lit("<Report><Head>")).otherwise(report).alias("body"),
        *also,
    )


def damaged(landed: DataFrame) -> DataFrame:
    """Bulletins of which some lack the event id, the sections, or the time of the observed section."""
    number = F.regexp_extract("link", r"(\d+)_0_storm", 1).cast("bigint")
    body = F.col("body")
    for modulus, pattern, left in (
        (89, r"<EventID>[^<]*</EventID>", "<EventID> </EventID>"),
        (83, r"<MeteorologicalInfos>.*</MeteorologicalInfos>", ""),
        (79, f'<DateTime type="{OBSERVED}">[^<]*', f'<DateTime type="{OBSERVED}">'),
    ):
        body = F.when(number % modulus == 0, F.regexp_replace(body, pattern, left)).otherwise(body)
    return landed.withColumn("body", body)


def feed_entries(pages: DataFrame) -> DataFrame:
    """One Atom entry per page, as XML text in column ``value``."""
    href = F.replace("url", F.lit("&"), F.lit("&amp;"))
    title = F.when(F.col("page_id") % 3 == 0, FEED_TITLE).otherwise("その他")
    return pages.select(
        _text("<entry><title>", title, '</title><link href="', href, '"/></entry>').alias("value")
    )


#: a thirteenth of the entries announce something else, a seventeenth of the payloads never land, a nineteenth land late
_OTHER, _LOST, _LATE = 13, 17, 19


def announcements(events: DataFrame) -> DataFrame:
    """``value, at``: an Atom entry with its time for every event's bulletin, and when a poll found it.

    Every entry of an even event is found by two polls.
    """
    number, link = F.col("event_id"), _text("https://example.org/bulletins/", F.col("event_id").cast("string"), "_0_storm.xml")
    title = F.when(number % _OTHER == 0, "その他").otherwise(FEED_TITLE)
    time = _text(F.replace(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" "), F.lit("T")), "Z")
    entry = _text("<entry><title>", title, '</title><link href="', link, '"/><updated>', time, "</updated></entry>")
    polls = F.when(number % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return events.select(entry.alias("value"), F.col("ts").alias("at"), F.explode(polls).alias("poll")).drop("poll")


def landings(events: DataFrame) -> DataFrame:
    """``link, body, landed_at``: payloads ten minutes after their event, late ones five hours after it.

    Times are met before bodies are built, and by a shuffle: the files say too little of how many rows a broadcast would hold.
    """
    number = F.regexp_extract(F.col("event_id").cast("string"), r"(\d+)$", 1).cast("bigint")
    times = events.select(F.col("event_id").alias("number"), F.col("ts").alias("at")).where(F.col("number") % _LOST != 0)
    wait = F.when(F.col("number") % _LATE == 0, F.expr("INTERVAL 5 HOURS")).otherwise(F.expr("INTERVAL 10 MINUTES"))
    timed = times.withColumn("landed_at", (F.col("at") + wait).cast("timestamp")).hint("merge")
    return bulletins(events.withColumn("number", number).join(timed, "number"), "landed_at")


def questions(documents: DataFrame) -> DataFrame:
    """One question per named storm and calendar day of the document table.

    ``question_id, question, parsed``; the question form turns with day and storm.
    """
    days = (
        documents.where(F.col("TyphoonName").isNotNull() & F.col("obs_jst").isNotNull())
        .select("TyphoonName", F.col("obs_jst").cast("date").alias("d"))
        .distinct()
    )
    names = {"KONG-REY": "Kong Rey", "SHANSHAN": "typhoon Shanshan", "TRAMI": "Trami"}
    shown = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("TyphoonName"))
    numbered = days.select(
        (F.unix_date("d") * 3 + F.array_position(F.array(*[F.lit(n) for n in names]), F.col("TyphoonName")) - 1)
        .cast("bigint").alias("question_id"),
        shown.alias("n"),
        "d",
    )

    def iso(plus: int) -> Column:
        return F.date_add("d", plus).cast("string")

    months = F.array(*[F.lit(m) for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()])

    def spoken(plus: int) -> Column:
        day = F.date_add("d", plus)
        return F.concat_ws(
            " ", F.day(day).cast("string"), F.element_at(months, F.month(day)), F.year(day).cast("string")
        )

    n = F.col("n")
    forms = [
        (_text("Where is ", n, " on ", spoken(0), "?"), _text(n, ", ", iso(0))),
        (
            _text("What is the trajectory of ", n, " from ", spoken(0), " to ", spoken(1), "?"),
            _text(n, ", ", iso(0), ", ", iso(1)),
        ),
        (_text("Where is ", n, " on ", spoken(0), " 12pm?"), _text(n, ", ", iso(0), "T12:00:00")),
        (
            _text("What is the trajectory of ", n, " up to ", spoken(0), "?"),
            _text(n, ", None, ", iso(0)),
        ),
        (_text("What is ", n, "?"), _text(n, ", None")),
        (F.lit("tell me about storms"), F.lit("tell me about storms")),
        (
            _text("What is the trajectory of ", n, " from ", spoken(0), " to ", spoken(1), " and then ", spoken(2), " 8pm?"),
            _text(n, ", ", iso(0), ", ", iso(1), ", ", iso(2), "T20:00:00"),
        ),
    ]
    form = F.col("question_id") % len(forms)

    def choose(which: int) -> Column:
        column = F.when(form == 0, forms[0][which])
        for number, texts in enumerate(forms[1:], 1):
            column = column.when(form == number, texts[which])
        return column

    return numbered.select("question_id", choose(0).alias("question"), choose(1).alias("parsed"))


def worded_questions(documents: DataFrame) -> DataFrame:
    """One question per named storm and calendar day, its date worded in one of twelve other ways.

    ``question_id, question``; ids go on from a million.
    """
    plain = questions(documents)
    names = {"KONG-REY": "Kong Rey", "SHANSHAN": "typhoon Shanshan", "TRAMI": "Trami"}
    days = (
        documents.where(F.col("TyphoonName").isNotNull() & F.col("obs_jst").isNotNull())
        .select("TyphoonName", F.col("obs_jst").cast("date").alias("d"))
        .distinct()
    )
    shown = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("TyphoonName"))
    number = F.unix_date("d") * 3 + F.array_position(F.array(*[F.lit(n) for n in names]), F.col("TyphoonName")) - 1
    numbered = days.select((number + 1_000_000).cast(plain.schema["question_id"].dataType).alias("question_id"), shown.alias("n"), "d")
    month, short = F.date_format("d", "MMMM"), F.date_format("d", "MMM")
    day, year, later = F.day("d"), F.year("d").cast("string"), F.date_add("d", 1)
    suffix = F.when(day.isin(11, 12, 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")
    number_of = day.cast("string")
    spoken = _text(number_of, " ", short, " ", year)
    n, tomorrow = F.col("n"), F.date_format(later, "d MMM yyyy")
    forms = [
        _text("Where was ", n, " on ", F.col("d").cast("string"), "?"),
        _text("Where was ", n, " on ", month, " ", number_of, ", ", year, "?"),
        _text("Where was ", n, " on ", number_of, suffix, " ", short, " ", year, " at 18:30?"),
        _text("What was the path of ", n, " from ", number_of, " ", short, " to ", tomorrow, "?"),
        _text("What was the path of ", n, " from 1st to ", number_of, suffix, " of ", month, " ", year, "?"),
        _text("What was the path of ", n, " from ", month, " 1 to ", number_of, ", ", year, "?"),
        _text("Where did ", n, " go after ", spoken, "?"),
        _text("Where did ", n, " go since ", spoken, " until now?"),
        _text("Where had ", n, " been before ", spoken, "?"),
        _text("At 1pm on ", spoken, ", where was ", n, "?"),
        _text("How strong was ", n, " in ", month, " ", year, "?"),
        _text("How strong was ", n, " between ", spoken, " and ", tomorrow, " 9:15 pm?"),
    ]
    form = F.col("question_id") % len(forms)
    chosen = F.when(form == 0, forms[0])
    for at, text in enumerate(forms[1:], 1):
        chosen = chosen.when(form == at, text)
    return numbered.select("question_id", chosen.alias("question"))
