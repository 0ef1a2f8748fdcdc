from pathlib import Path

import pytest

from bulletin_text import bulletin, centre, name, section
from stormlake.operators.changes import apply_changes, change_feed
from stormlake.operators.upsert import upsert
from stormlake.plans.ingest import announced, documents, documents_from_payloads, ingest, read_rejected
from stormlake.sources.archive import read_archive, write_archive
from stormlake.sources.bulletins import REASONS, parse_bulletins, read_bulletins, split_quarantine
from stormlake.sources.feed import read_feed, storm_entries
from stormlake.sources.tables import read_documents
from stormlake.streaming.ingest import ingest_landed


def landed(spark, *bodies):
    rows = [(f"http://x/data/f{n}.xml", b) for n, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "link string, body string")


def made(storm, serial="1", hour=13, event="TC01", year=2024):
    return bulletin(section(f"{year}-08-28T{hour:02d}:00:00+09:00", name(storm)), event=event, serial=serial)


def content(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def names(spark, path):
    rows = read_documents(spark, path).collect()
    return {r.unique_event_id: (r.TyphoonName, r.Serial) for r in rows}


def test_upsert_replaces_inserts_and_keeps(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert(spark, documents_from_payloads(landed(spark, made("A"), made("B", hour=14), made("Z", year=2023))), path)
    old_year = sorted(p.name for p in Path(path, "event_year=2023").rglob("*.parquet"))
    source = documents_from_payloads(landed(spark, made("C", serial="0"), made("D", hour=15)))
    upsert(spark, source, path)
    assert names(spark, path) == {
        "TC012024-08-28T13:00:00+09:00": ("C", "0"),
        "TC012024-08-28T14:00:00+09:00": ("B", "1"),
        "TC012024-08-28T15:00:00+09:00": ("D", "1"),
        "TC012023-08-28T13:00:00+09:00": ("Z", "1"),
    }
    # an untouched year is not rewritten
    assert old_year == sorted(p.name for p in Path(path, "event_year=2023").rglob("*.parquet"))
    once = content(read_documents(spark, path))
    upsert(spark, source, path)
    assert content(read_documents(spark, path)) == once


def test_upsert_of_new_keys_only_appends(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert(spark, documents_from_payloads(landed(spark, made("A"))), path)
    before = {p.name for p in Path(path).rglob("*.parquet")}
    upsert(spark, documents_from_payloads(landed(spark, made("B", hour=14), made("Y", year=2022))), path)
    assert before < {p.name for p in Path(path).rglob("*.parquet")}
    assert sorted(n for n, _ in names(spark, path).values()) == ["A", "B", "Y"]


def test_upsert_can_be_repeated_after_a_partial_write(spark, tmp_path):
    """As if a run had ended between the rewrite and the append, or in the append."""
    path = str(tmp_path / "t")
    upsert(spark, documents_from_payloads(landed(spark, made("A"))), path)
    source = [made("C"), made("B", hour=14), made("D", hour=15)]
    upsert(spark, documents_from_payloads(landed(spark, *source[:2])), path)
    upsert(spark, documents_from_payloads(landed(spark, *source)), path)
    assert content(read_documents(spark, path)) == content(
        documents_from_payloads(landed(spark, *source)).select(*read_documents(spark, path).columns)
    )


def test_upsert_with_versions_keeps_the_newer_row(spark, tmp_path):
    path = str(tmp_path / "t")
    for batch in ([made("A", "10")], [made("B", "9"), made("N", "1", hour=20)], [made("C", "11")], [made("D", "x")]):
        upsert(spark, documents_from_payloads(landed(spark, *batch)), path, newest="Serial")
    assert names(spark, path)["TC012024-08-28T13:00:00+09:00"] == ("C", "11")
    assert names(spark, path)["TC012024-08-28T20:00:00+09:00"] == ("N", "1")


def test_empty_upsert_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert(spark, documents_from_payloads(landed(spark, made("A"))), path)
    before = content(read_documents(spark, path))
    upsert(spark, documents_from_payloads(landed(spark, "<Report>")), path)
    assert content(read_documents(spark, path)) == before


def test_change_feed_turns_old_into_new(spark):
    old = documents_from_payloads(landed(spark, made("A"), made("B", hour=14), made("C", hour=15)))
    new = documents_from_payloads(landed(spark, made("X"), made("B", hour=14), made("D", hour=16)))
    # equal rows come from other files in the two sets
    feed = change_feed(old.drop("id_"), new.drop("id_"), "unique_event_id")
    kinds = sorted((r._change_type, r.TyphoonName) for r in feed.collect())
    assert kinds == [("delete", "C"), ("insert", "D"), ("update_postimage", "X"), ("update_preimage", "A")]
    assert content(apply_changes(old.drop("id_"), feed, "unique_event_id")) == content(new.drop("id_"))


def test_archive_keeps_payloads_byte_for_byte(spark, tmp_path):
    bodies = [
        made("A").replace("><", ">\n  <"), made("B", event="TC02"),
        bulletin(section("2023-12-31T23:00:00+09:00"), section("2024-01-01T02:00:00+09:00"), event="TC03"),
        "<Report><Head>",
    ]
    path = str(tmp_path / "a")
    write_archive(landed(spark, *bodies), path)
    rows = {(r.event_year, r.EventID, r.file_name): r.body for r in read_archive(spark, path).collect()}
    assert rows == {
        ("2024", "TC01", "f0.xml"): bodies[0],
        ("2024", "TC02", "f1.xml"): bodies[1],
        ("2023", "TC03", "f2.xml"): bodies[2],
        ("2024", "TC03", "f2.xml"): bodies[2],
    }


def land(folder, **files):
    folder.mkdir(exist_ok=True)
    for file, body in files.items():
        (folder / f"{file}.xml").write_text(body, encoding="utf-8")


PRETTY = '<?xml version="1.0" encoding="UTF-8"?>\n' + made("A", hour=15).replace("><", ">\n<")


@pytest.mark.parametrize("per_line", [False, True])
def test_folder_scan(spark, tmp_path, per_line):
    folder = tmp_path / "in"
    if per_line:
        land(folder, all="\n".join([made("A"), "<Report><Head>", made("B", hour=14)]))
    else:
        land(folder, one=made("A"), bad="<Report><Head>", two=made("B", hour=14), three=PRETTY)
    good, bad = split_quarantine(read_bulletins(spark, str(folder), per_line))
    assert good.count() == (2 if per_line else 3) and bad.count() == 1
    docs = documents(read_bulletins(spark, str(folder), per_line))
    found = {(r.TyphoonName, r.ObservationTime) for r in docs.collect()}
    expected = {("A", "13:00:00"), ("B", "14:00:00")}
    assert found == expected | (set() if per_line else {("A", "15:00:00")})


def test_stream_equals_batch_whatever_the_order(spark, tmp_path):
    folder, table, offsets = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    drops = [
        {"a": made("A", "5"), "b": made("B", "1", hour=14), "x": "<Report>"},
        {"c": made("OLD", "2"), "d": made("D", "3", hour=14), "e": made("E", event="TC09")},
    ]
    for drop in drops:
        land(folder, **drop)
        ingest_landed(spark, str(folder), table, offsets, files_per_trigger=2).awaitTermination()
    batch = documents(read_bulletins(spark, str(folder)))
    columns = ["unique_event_id", "TyphoonName", "Serial", "Text", "obs_jst"]
    assert content(read_documents(spark, table).select(*columns)) == content(batch.select(*columns))
    assert read_documents(spark, table).count() == 3


def test_feed(spark, tmp_path):
    title = "台風解析・予報情報（５日予報）"
    (tmp_path / "feed.xml").write_text(
        '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>'
        f'<entry><title>{title}（第1号）</title><id>1</id><link type="x" href="http://x/d/a.xml?a=1&amp;b=2"/></entry>'
        '<entry><title>other</title><link href="http://x/d/b.xml"/></entry></feed>',
        encoding="utf-8",
    )
    feed = read_feed(spark, str(tmp_path / "feed.xml"))
    assert feed.count() == 2
    assert [tuple(r) for r in storm_entries(feed).collect()] == [
        (f"{title}（第1号）", "http://x/d/a.xml?a=1&b=2", "a.xml?a=1&b=2")
    ]


def test_live_mode_takes_what_the_feed_announces(spark, tmp_path):
    title = "台風解析・予報情報（５日予報）"
    (tmp_path / "feed.xml").write_text(
        f'<feed><entry><title>{title}</title><link href="http://x/data/f1.xml"/></entry>'
        f'<entry><title>{title}</title><link href="http://x/data/f1.xml"/></entry>'
        '<entry><title>other</title><link href="http://x/data/f0.xml"/></entry></feed>',
        encoding="utf-8",
    )
    feed = read_feed(spark, str(tmp_path / "feed.xml"))
    docs = documents_from_payloads(announced(feed, landed(spark, made("A"), made("B", hour=14))))
    assert [r.TyphoonName for r in docs.collect()] == ["B"]


def test_centre_only_bulletin_goes_through(spark, tmp_path):
    path = str(tmp_path / "t")
    body = bulletin(section("2024-08-28T13:00:00+09:00", centre()))
    upsert(spark, documents_from_payloads(landed(spark, body)), path)
    assert read_documents(spark, path).first().TyphoonName is None


def test_ingest_keeps_what_it_rejects(spark, tmp_path):
    path = str(tmp_path / "t")
    bodies = [
        made("A"), "<Report><Head>", made("B", event=" "), bulletin(event="TC02"),
        bulletin(section(" ", name("C")), event="TC03"), made("D", hour=15), "",
    ]
    counts = ingest(spark, parse_bulletins(landed(spark, *bodies)), path, run="one")
    assert sum(counts.values()) == len(bodies)
    rejected = {(r.file_name, r.reason, r.payload, r.run) for r in read_rejected(spark, path).collect()}
    assert {(n, p) for n, _, p, _ in rejected} == {(f"f{n}.xml", bodies[n]) for n in (1, 2, 3, 4, 6)}
    assert {r for _, r, _, _ in rejected} == set(REASONS) and {r for *_, r in rejected} == {"one"}
    assert counts["ok"] == 2 and read_documents(spark, path).count() == 2
    # the same run again replaces its own, another one is kept beside it
    ingest(spark, parse_bulletins(landed(spark, *bodies)), path, run="one")
    ingest(spark, parse_bulletins(landed(spark, *bodies[1:2])), path, run="two")
    assert sorted(r.run for r in read_rejected(spark, path).collect()) == ["one"] * 5 + ["two"]
    assert read_documents(spark, path).count() == 2


def test_stream_keeps_what_it_rejects(spark, tmp_path):
    folder, table, offsets = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    for drop in ({"a": made("A"), "x": "<Report>"}, {"y": "<Report>\n<Head>"}, {"b": made("B", hour=14)}):
        land(folder, **drop)
        ingest_landed(spark, str(folder), table, offsets).awaitTermination()
    rejected = read_rejected(spark, table).collect()
    assert sorted((r.file_name, r.payload) for r in rejected) == [("x.xml", "<Report>"), ("y.xml", "<Report>\n<Head>")]
    assert len({r.run for r in rejected}) == 2 and read_documents(spark, table).count() == 2


def test_a_folder_is_read_whole_and_marked_files_too(spark, tmp_path):
    folder = tmp_path / "in"
    land(folder, marked="﻿" + PRETTY, plain=PRETTY, empty="")
    good, bad = split_quarantine(read_bulletins(spark, str(folder)))
    assert good.count() == 2
    # the source passes over files without a byte
    assert bad.count() == 0
