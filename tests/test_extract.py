import pytest

from bulletin_text import area, axis, bulletin, centre, direction, kind, name, section, wind
from stormlake.operators.documents import document_rows
from stormlake.operators.extract import observation_rows, typed_observations
from stormlake.plans.ingest import observations
from stormlake.sources.bulletins import parse_bulletins, split_quarantine

TIME = "2024-08-28T13:00:00+09:00"


def parse(spark, *bodies):
    rows = [(f"http://x/data/f{n}.xml", b) for n, b in enumerate(bodies)]
    return parse_bulletins(spark.createDataFrame(rows, "link string, body string"))


def rows(spark, *bodies):
    good, _ = split_quarantine(parse(spark, *bodies))
    return observation_rows(good).collect()


def one(spark, *items):
    found = rows(spark, bulletin(section(TIME, *items)))
    assert len(found) == 1
    return found[0]


def test_full_bulletin(spark):
    areas = area("暴風域", axis(direction(description="全域"), ("90", "170"))) + area(
        "強風域",
        axis(direction("180", unit="度"), ("1", "2")),
        axis(direction("南東", type="方向"), ("150", "280")),
        axis(direction("北西", type="方向"), ("120", "220")),
        axis(direction("北", type="方向"), ("100", "200")),
    )
    rest = (
        "<jmx_eb:Direction unit='d'>北</jmx_eb:Direction>"
        "<jmx_eb:Speed unit='kt'>8</jmx_eb:Speed><jmx_eb:Speed unit='km/h'>15</jmx_eb:Speed>"
        "<jmx_eb:Pressure unit='hPa'>975</jmx_eb:Pressure>"
    )
    row = one(spark, name() + centre(rest=rest), wind(("65", "33", "95", "50"), areas)).asDict()
    row.pop("file_name")
    assert row == {
        "EventID": "TC01", "ObservationTime": TIME, "InfoType": "発表", "Serial": "1",
        "InfoKindVersion": "1.0_0", "TyphoonName": "SHANSHAN", "CenterLat": "22.30",
        "CenterLon": "134.50", "CenterLocation": "Sea", "CenterMovementDirection": "北",
        "CenterSpeed": "15", "CentralPressure": "975", "MaxWindspeedNearCenter": "33",
        "MaxGustSpeed": "50", "Bofuuiki_Direction1": "全域", "Bofuuiki_Radius1": "170",
        "Bofuuiki_Direction2": None, "Bofuuiki_Radius2": None, "Kyofuuiki_Direction1": "南東",
        "Kyofuuiki_Radius1": "280", "Kyofuuiki_Direction2": "北西", "Kyofuuiki_Radius2": "220",
        "URL": "http://x/data/f0.xml",
    }


def test_forecast_sections_are_dropped_and_observed_ones_kept(spark):
    found = rows(
        spark,
        bulletin(
            section(TIME, centre()),
            section("2024-08-29T13:00:00+09:00", centre(), kind_of_time="予報"),
            section("2024-08-28T16:00:00+09:00", centre("+2300+13400/")),
        ),
    )
    assert sorted((r.ObservationTime, r.CenterLat) for r in found) == [
        (TIME, "22.30"), ("2024-08-28T16:00:00+09:00", "23.00"),
    ]


def test_observed_section_without_anything_gives_a_default_row(spark):
    row = one(spark).asDict()
    keys = {"EventID", "ObservationTime", "InfoType", "Serial", "InfoKindVersion", "URL", "file_name"}
    assert all(row[c] is None for c in row.keys() - keys)


def test_last_name_and_last_centre_win(spark):
    row = one(spark, name("A") + centre("+1000+10000/"), name("B") + kind("呼称", "") + centre("+1100+11000/"))
    assert (row.TyphoonName, row.CenterLat) == ("B", "11.00")


@pytest.mark.parametrize(
    "text, lat, lon",
    [
        ("+2230+13450/", "22.30", "134.50"),
        (" +0005+00100+0/", "0.05", "1.00"),
        ("-0520+17830/", "-5.20", "178.30"),
        ("+2230-13450/", "22.30", "-134.50"),
        ("unknown", None, None),
        ("+22.3+134.5/", None, None),
    ],
)
def test_coordinates(spark, text, lat, lon):
    row = one(spark, centre(text))
    assert (row.CenterLat, row.CenterLon) == (lat, lon)


def test_missing_centre_parts_are_null_and_do_not_lose_the_row(spark):
    row = one(spark, centre(rest="<jmx_eb:Speed unit='kt'>8</jmx_eb:Speed>"), wind(("9", "8")))
    assert row.CenterSpeed is None and row.CentralPressure is None
    assert (row.MaxWindspeedNearCenter, row.MaxGustSpeed) == ("8", None)


def test_attribute_only_speed_is_null(spark):
    rest = "<jmx_eb:Speed unit='kt'/><jmx_eb:Speed unit='km/h' condition='slow'/>"
    assert one(spark, centre(rest=rest)).CenterSpeed is None


def test_no_warning_area_is_null(spark):
    row = one(spark, wind())
    assert row.Bofuuiki_Direction1 is None and row.Kyofuuiki_Direction1 is None


def test_single_warning_area_is_read(spark):
    row = one(spark, wind(areas=area("強風域", axis(direction("東", type="方向"), ("1", "2")))))
    assert (row.Kyofuuiki_Direction1, row.Kyofuuiki_Radius1) == ("東", "2")
    assert row.Bofuuiki_Direction1 is None


def test_first_area_of_a_type_is_taken(spark):
    areas = area("強風域", axis(direction("東", type="方向"), ("1", "2"))) + area(
        "強風域", axis(direction("西", type="方向"), ("3", "4"))
    )
    assert one(spark, wind(areas=areas)).Kyofuuiki_Direction1 == "東"


def test_area_with_a_malformed_axis_is_null_for_its_prefix_only(spark):
    areas = area(
        "暴風域",
        axis(direction("東", type="方向"), ("1", "2")),
        axis(direction("西", type="方向"), ("3",)),
    ) + area("強風域", axis(direction("北", type="方向"), ("5", "6")))
    row = one(spark, wind(areas=areas))
    assert row.Bofuuiki_Direction1 is None and row.Bofuuiki_Radius1 is None
    assert row.Kyofuuiki_Radius1 == "6"


def test_axis_without_unit_is_malformed_and_without_type_is_rejected(spark):
    malformed = area("暴風域", axis(direction("東", unit=None, type="方向"), ("1", "2")))
    rejected = area("強風域", axis(direction("東"), ("1", "2")), axis(direction("西", type="方向"), ("3", "4")))
    row = one(spark, wind(areas=malformed + rejected))
    assert row.Bofuuiki_Direction1 is None
    assert (row.Kyofuuiki_Direction1, row.Kyofuuiki_Direction2) == ("西", None)


def test_quarantine(spark):
    good = bulletin(section(TIME, centre()))
    bodies = [
        good,
        "<Report><Head>",
        "",
        None,
        good.replace("<EventID>TC01</EventID>", ""),
        good.replace("TC01", ""),
        "<Report><Head><EventID>T</EventID></Head></Report>",
        good.replace(TIME, ""),
        bulletin(section("t", kind_of_time="予報")),
    ]
    kept, bad = split_quarantine(parse(spark, *bodies))
    assert sorted(r.file_name for r in kept.collect()) == ["f0.xml", "f8.xml"]
    assert {r.file_name: r.reason for r in bad.collect()} == {
        "f1.xml": "unparsable", "f2.xml": "unparsable", "f3.xml": "no event id",
        "f4.xml": "no event id", "f5.xml": "no event id", "f6.xml": "no sections",
        "f7.xml": "section without time",
    }


def test_latest_serial_wins_as_a_number(spark):
    bodies = [bulletin(section(TIME, name(n)), serial=s) for n, s in (("A", "9"), ("B", "10"), ("C", "2"))]
    latest = observations(parse(spark, *bodies)).collect()
    assert [(r.TyphoonName, r.Serial) for r in latest] == [("B", "10")]


def test_equal_serials_fall_back_to_the_file_name(spark):
    bodies = [bulletin(section(TIME, name(n))) for n in ("A", "B")]
    assert [r.URL for r in observations(parse(spark, *bodies)).collect()] == ["http://x/data/f1.xml"]


def test_typed_columns(spark):
    body = bulletin(section("2024-08-28T04:00:00Z", centre()), serial="x7")
    row = typed_observations(observations(parse(spark, body))).first()
    assert (row.Serial, row.CenterLat, row.event_year) == (None, 22.3, "2024")
    assert row.obs_jst.isoformat() == "2024-08-28T13:00:00"


def document(spark, body):
    return document_rows(observations(parse(spark, body))).first()


def test_document_text(spark):
    rest = "<jmx_eb:Pressure unit='hPa'>975</jmx_eb:Pressure>"
    doc = document(spark, bulletin(section(TIME, name() + centre(rest=rest) + wind())))
    assert doc.Text == "\n".join(
        [
            "Event ID: TC01",
            f"Observation Time: {TIME}",
            "Info Type: 発表",
            "Serial: 1",
            "Info Kind Version: 1.0_0",
            "Typhoon Name: SHANSHAN",
            "Center Latitude: 22.30",
            "Center Longitude: 134.50",
            "Center Location: Sea",
            "Center Movement Direction: nan",
            "Center Speed: N/A km/h",
            "Central Pressure: 975 hPa",
            "Max Windspeed Near Center: 2 km/h",
            "Max Gust Speed: 4 km/h",
            "Bofuuiki Direction 1: nan, Radius 1: nan",
            "Bofuuiki Direction 2: nan, Radius 2: nan",
            "Kyofuuiki Direction 1: nan, Radius 1: nan",
            "Kyofuuiki Direction 2: nan, Radius 2: nan",
        ]
    )
    assert doc.unique_event_id == f"TC01{TIME}" and len(doc.id_) == 64
    assert (doc.ObservationDate, doc.ObservationTime) == ("2024-08-28", "13:00:00")
    assert doc.ObservationDateTime == TIME and doc.embedding is None


def test_absent_name_is_null_in_the_table_and_unknown_in_the_text(spark):
    for items in (name(""), ""):
        doc = document(spark, bulletin(section(TIME, items)))
        assert doc.TyphoonName is None and "Typhoon Name: Unknown\n" in doc.Text


def test_unreadable_time(spark):
    doc = document(spark, bulletin(section("28 Aug 2024")))
    assert (doc.ObservationDate, doc.ObservationTime, doc.obs_jst) == ("Unknown", "Unknown", None)
    assert doc.event_year == "unknown"
