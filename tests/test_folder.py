from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path

from checks.queries import all_queries
from stormlake.sources.bulletins import read_payloads


def write(folder, files):
    for name, content in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(content)


def test_the_driver_neither_lists_files_nor_deals_each_as_megabytes(spark, tmp_path):
    write(tmp_path, {f"folder={i % 3}/file={i}.xml": f"<x>{i}</x>".encode() for i in range(600)})
    found = read_payloads(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() <= 8 and not any(x.endswith(".xml") for x in found.inputFiles())
    assert sorted(r["body"] for r in found.collect()) == sorted(f"<x>{i}</x>" for i in range(600))


def test_files_and_links_are_those_of_the_binary_source(spark, tmp_path):
    names = ["a b.xml", "c%d.xml", "ü漢\u3000x\xa0y.xml", "plus+&=,;@!$'()~*.xml", "q?.xml", "h#a.xml", "br[1]{2}.xml", "t\tab.xml", 'q"\\^`|<>.xml', "\u200bz\ufeff😀.xml", "_k=v.xml"]
    files = {name: b"\xef\xbb\xbfbody \xff %d" % i for i, name in enumerate(names)}
    hidden = {"_hidden.xml": b"x", ".dot.xml": b"x", "x._COPYING_": b"x", "empty.xml": b"", "below/plain.xml": b"x"}
    dealt = {f"year={i % 2}/part={i}/{name}": b"x" for i, name in enumerate(names)} | {"_SUCCESS": b"x", "year=0/part=0/_no.xml": b"x"}
    for k, some in enumerate((files | hidden, dealt, dealt | {"beside.xml": b"x"}, {"below/plain.xml": b"x"}, {"_no": b"x"})):
        folder = tmp_path / str(k)
        write(folder, some)
        source = spark.read.format("binaryFile").load(str(folder)).selectExpr("_metadata.file_path AS link", "content")
        want = sorted((r["link"], r["content"].decode("utf-8-sig", "replace")) for r in source.collect())
        for path in (str(folder), f"file:{folder}/"):
            assert sorted((r["link"], r["body"]) for r in read_payloads(spark, path).collect()) == want
        assert len(want) == (len(names) if k < 3 else 0)


def test_whole_files_share_folders_and_copies_have_files_of_their_own(spark, tmp_path):
    ids = [*range(1, 601), 5, 5]
    rows = [(i, i % 7, datetime(2024, 10, 1) + timedelta(hours=i), "click") for i in ids]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    work = Path(spark.conf.get("spark.checkpoint.dir")) / "stormlake"
    before = set(work.glob("folder-*"))
    found = all_queries()["bulletin_folder"](spark, str(tmp_path)).collect()
    (landing,) = set(work.glob("folder-*")) - before
    assert Counter(r["file_name"] for r in found) == Counter(f"{i}_0_storm.xml" for i in ids)
    assert {r["verdict"] for r in found if r["Serial"] is None} == {"unparsable"}
    assert all(r["file_name"].startswith(f"{r['Serial']}_") for r in found if r["verdict"] == "ok")
    assert sum(r["verdict"] == "unparsable" for r in found) == 6
    below = list(landing.rglob("*"))
    # one document a file, no folder for each
    assert sum(x.is_file() for x in below) == len(ids) and sum(x.is_dir() for x in below) < 300
