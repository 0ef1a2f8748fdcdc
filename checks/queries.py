"""One query per operator, each over whole tables."""

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormlake import fixtures as fx
from stormlake.constants import OBSERVATION_TYPES
from stormlake.functions.text import clean_sections, link_filename, stable_bucket
from stormlake.functions.times import event_year, observation_date, observation_time, tokyo_time
from stormlake.functions.names import normal_name
from stormlake.operators import extract
from stormlake.operators.context import answer_prompts
from stormlake.operators.dedup import latest_observations
from stormlake.operators.documents import document_rows
from stormlake.operators.embed import embed
from stormlake.operators.index import read_index, sync_actions, sync_index, sync_stored_index
from stormlake.operators.merge import read_changes
from stormlake.operators.name_index import read_names, sync_names
from stormlake.operators.questions import (
    gate,
    parse_questions,
    question_bounds,
    question_times,
    resolve_questions,
    split_parsed,
    storm_names,
)
from stormlake.operators.retrieve import match_names, retrieve, retrieve_batch
from stormlake.operators.similarity import (
    approximate_top_k,
    hash_index,
    plane_count,
    search,
    search_text,
    top_k,
    write_hash_index,
)
from stormlake.operators.upsert import upsert
from stormlake.operators.windows import window_contexts
from stormlake.plans.answer import answer_batch, fallback_hits
from stormlake.plans.ingest import documents, documents_from_payloads, ingest, observations, read_rejected
from stormlake.session import stage, work_path
from stormlake.sources.archive import read_archive, write_archive
from stormlake.sources.bulletins import judge_bulletins, parse_bulletins, read_bulletins, split_judged, split_quarantine
from stormlake.sources.feed import read_feed, storm_entries, stream_feed
from stormlake.sources.tables import document_table, read_documents, write_documents
from stormlake.streaming.ingest import ingest_landed
from stormlake.streaming.live import ingest_announced, read_unmet

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(name: str):
    def register(function: Query) -> Query:
        _QUERIES[name] = function
        return function

    return register


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


#: bulletins in a packed file, some 50 MB of text
_PER_FILE = 20_000
#: folders that whole files land in: listed by so many tasks
_FOLDERS = 128

# --- inputs ------------------------------------------------------------------


def _landed(spark: SparkSession, sf: str) -> DataFrame:
    return fx.bulletins(fx.table(spark, sf, "events"))


def _land(landed: DataFrame, path: str) -> None:
    """Packed files with a bulletin per line, compressed; files of bounded length, as each is read by one task."""
    packed = landed.select("body").write.mode("append").option("compression", "gzip")
    packed.option("maxRecordsPerFile", _PER_FILE).text(path)


def _land_files(files: DataFrame, path: str) -> int:
    """A file of its own for every row of ``file, value``, in ``_FOLDERS`` folders, written by the tasks; how many files.

    Names are ``file=``, and copies of a name lie in folders beside each other. Rows are dealt and sorted by name and text, so a
    task that runs again writes the same files, each by a rename.
    """
    dealt = files.select(F.coalesce("file", F.lit("__HIVE_DEFAULT_PARTITION__")).alias("file"), F.coalesce("value", F.lit("")).alias("value"))
    dealt = dealt.repartition(_FOLDERS, "file").sortWithinPartitions("file", "value")

    def write(batches):
        import pyarrow as pa
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = FileSystem.from_uri(path)
        hidden, last, copy, made = f"{root}/_attempt-{task.taskAttemptId()}", None, 0, set()
        for batch in batches:
            for name, text in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist()):
                copy, last = copy + 1 if name == last else 0, name
                folder = f"{root}/folder={task.partitionId()}/copy={copy}"
                if folder not in made:
                    store.create_dir(folder)
                    made.add(folder)
                with store.open_output_stream(hidden) as out:
                    out.write(f"{text}\n".encode())
                store.move(hidden, f"{folder}/file={name}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return dealt.mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0


def _corrections(landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bulletins that are not corrections, and those that are."""
    correction = F.contains(F.col("body"), F.lit(f"<InfoType>{fx.CORRECTION}"))
    return landed.where(~correction), landed.where(correction)


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return parse_bulletins(_landed(spark, sf))


def _good(spark: SparkSession, sf: str) -> DataFrame:
    return split_quarantine(_parsed(spark, sf))[0]


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    return extract.property_groups(extract.sections(_good(spark, sf)))


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return extract.observation_rows(_good(spark, sf))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return documents(_parsed(spark, sf))


def _document_table(spark: SparkSession, sf: str) -> DataFrame:
    """The published table, as retrieval jobs find it."""
    return read_documents(spark, _published(spark, sf))


def _published(spark: SparkSession, sf: str) -> str:
    path = work_path(spark, "documents")
    write_documents(_documents(spark, sf), path)
    return path


def _questions(documents: DataFrame) -> DataFrame:
    return stage(fx.questions(documents), "questions")


def _index(documents: DataFrame) -> DataFrame:
    texts = documents.select("unique_event_id", "Text")
    return stage(sync_index(None, texts, "unique_event_id", "Text"), "index")


def _centroids(vectors: DataFrame) -> DataFrame:
    """The mean vector of every label, as search queries."""
    parts = vectors.select("label", F.posexplode("embedding").alias("dim", "x"))
    means = parts.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    ordered = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v"))
    return ordered.select(F.col("label").alias("query_label"), F.col("v.x").alias("embedding"))


# --- scans and sources -------------------------------------------------------


@query("bulletin_scan")
def bulletin_scan(spark, sf):
    landing = work_path(spark, "landing")
    _land(_landed(spark, sf), landing)
    good, _ = split_quarantine(read_bulletins(spark, landing, per_line=True))
    sections = F.size("Body.MeteorologicalInfos.MeteorologicalInfo").alias("n_sections")
    return good.select(*[f"Head.{f}" for f in extract.HEADER_FIELDS], sections)


@query("bulletin_parse")
def bulletin_parse(spark, sf):
    return _parsed(spark, sf).select(
        "link", "file_name", "Head.EventID", "Head.Serial",
        F.col("_corrupt_record").isNotNull().alias("corrupt"),
    )


@query("feed_scan")
def feed_scan(spark, sf):
    path = work_path(spark, "feed")
    _write_feed(spark, sf, path)
    return read_feed(spark, path, per_line=True)


def _write_feed(spark, sf, path):
    fx.feed_entries(fx.table(spark, sf, "pages")).write.text(path)


@query("bulletin_stream")
def bulletin_stream(spark, sf):
    first, second = _corrections(_landed(spark, sf))
    landing, table, checkpoint = (work_path(spark, n) for n in ("landing", "table", "offsets"))
    for drop in (first, second):
        _land(drop, landing)
        ingest_landed(spark, landing, table, checkpoint, per_line=True).awaitTermination()
    return read_documents(spark, table).select(
        "unique_event_id", "Serial", "TyphoonName", F.md5("Text").alias("text_md5")
    )


@query("live_ingest")
def live_ingest(spark, sf):
    """Feed and landing zone as two streams, taken in by two runs: documents, and what did not meet."""
    feed, landing, table, checkpoint = (work_path(spark, n) for n in ("feed", "landing", "table", "offsets"))
    events = fx.table(spark, sf, "events")
    entries, landed = stage(fx.announcements(events), "entries"), stage(fx.landings(events), "landings")
    first, last = events.select(F.min("ts").cast("timestamp"), F.max("ts").cast("timestamp")).first()
    middle, close = first + (last - first) / 2, last + timedelta(days=2)
    # entry and payload of the close: no storm, but times far beyond all others
    ends = spark.range(1).select(F.lit(close).alias("at"))
    closing = ends.select(F.format_string("<entry><title></title><updated>%s</updated></entry>", F.col("at").cast("string")).alias("value"))
    schema = "link string, body string, landed_at timestamp"
    for run, since, until in ((1, first, middle), (2, middle, close)):
        times = (F.lit(since), F.lit(until) - F.expr("INTERVAL 1 MICROSECOND"))
        entries.where(F.col("at").cast("timestamp").between(*times)).select("value").write.mode("append").text(feed)
        landed.where(F.col("landed_at").between(*times)).write.mode("append").parquet(landing)
        if run == 2:
            closing.write.mode("append").text(feed)
            ends.select(F.lit("close").alias("link"), F.lit("").alias("body"), F.col("at").alias("landed_at")).write.mode("append").parquet(landing)
        payloads = spark.readStream.schema(schema).parquet(landing)
        ingest_announced(stream_feed(spark, feed, per_line=True), payloads, table, checkpoint, "2 HOURS", "1 MINUTE").awaitTermination()
    documents = read_documents(spark, table).select(F.col("unique_event_id").alias("what"), F.lit("document").alias("status"), "Serial")
    rejected = read_rejected(spark, table).select(F.col("link").alias("what"), F.col("reason").alias("status"))
    unmet = read_unmet(spark, table).select(F.col("link").alias("what"), "status")
    none = F.lit(None).cast("string").alias("Serial")
    return documents.unionByName(rejected.unionByName(unmet).select("*", none))


@query("bulletin_folder")
def bulletin_folder(spark, sf):
    """A folder with one indented XML document per file."""
    landing = work_path(spark, "folder")
    lines = F.replace(F.col("body"), F.lit("><"), F.lit(">\n  <"))
    files = _landed(spark, sf).select(link_filename(F.col("link")).alias("file"), F.concat(F.lit("\ufeff"), lines).alias("value"))
    _land_files(files, landing)
    # both halves are read from what was judged, so every file is opened and parsed once
    good, bad = split_judged(stage(judge_bulletins(read_bulletins(spark, landing)), "judged"))
    name = F.regexp_extract("link", "file=([^/]+)$", 1).alias("file_name")
    kept = good.select(name, "Head.EventID", "Head.Serial", F.lit("ok").alias("verdict"))
    none = F.lit(None).cast("string")
    return kept.unionByName(bad.select(name, none.alias("EventID"), none.alias("Serial"), F.col("reason").alias("verdict")))


@query("ingest_quarantine")
def ingest_quarantine(spark, sf):
    """What an ingest rejects, payload and all, and its counts: good and rejected ones are all that landed."""
    landed, path = stage(fx.damaged(_landed(spark, sf)), "landed"), work_path(spark, "documents")
    counts = ingest(spark, parse_bulletins(landed), path)
    # all that landed goes to this join: digests of the payloads, not their text
    digests = landed.select("link", F.sha2("body", 256).alias("landed"))
    kept = read_rejected(spark, path).withColumn("kept", F.sha2("payload", 256)).drop("payload").join(digests, "link")
    rows = kept.select("file_name", "reason", (F.col("kept") == F.col("landed")).alias("whole"), F.lit(1).cast("bigint").alias("n"))
    total = spark.createDataFrame([("", r, True, n) for r, n in counts.items()], rows.schema)
    stored = read_documents(spark, path).agg(F.count("*").alias("n"))
    return rows.unionByName(total).unionByName(stored.select(F.lit("").alias("file_name"), F.lit("documents").alias("reason"), F.lit(True).alias("whole"), "n"))


@query("document_scan")
def document_scan(spark, sf):
    return _document_table(spark, sf).select(
        "id_", "EventID", "TyphoonName", "ObservationDateTime", "event_year"
    )


@query("bulletin_quarantine")
def bulletin_quarantine(spark, sf):
    good, bad = split_quarantine(_parsed(spark, sf))
    kept = good.select("link", "file_name", F.lit("ok").alias("verdict"))
    return kept.unionByName(bad.select("link", "file_name", F.col("reason").alias("verdict")))


# --- filters, projections, nested extraction ---------------------------------


@query("feed_filter")
def feed_filter(spark, sf):
    path = work_path(spark, "feed")
    _write_feed(spark, sf, path)
    return storm_entries(read_feed(spark, path, per_line=True))


@query("link_filename")
def link_filename_(spark, sf):
    return fx.table(spark, sf, "pages").select(
        "page_id", link_filename(F.col("url")).alias("file_name")
    )


@query("bulletin_header")
def bulletin_header(spark, sf):
    return extract.headers(_good(spark, sf))


@query("bulletin_unnest")
def bulletin_unnest(spark, sf):
    rows = extract.unnest_properties(extract.sections(_good(spark, sf), observed_only=False))
    return rows.select(
        "EventID", "Serial", "section_type", "item_no", "kind_no",
        F.col("property.Type").alias("property_type"),
    )


@query("observed_only")
def observed_only(spark, sf):
    return extract.sections(_good(spark, sf)).select(
        "EventID", "Serial", "section_type", "ObservationTime"
    )


@query("observation_rows")
def observation_rows(spark, sf):
    return _rows(spark, sf).select(*OBSERVATION_TYPES)


@query("storm_name")
def storm_name(spark, sf):
    return _groups(spark, sf).select("EventID", "Serial", F.col("name").alias("TyphoonName"))


@query("center_fields")
def center_fields(spark, sf):
    return _rows(spark, sf).select(
        "EventID", "Serial", "CenterLocation", "CenterMovementDirection", "CenterSpeed",
        "CentralPressure",
    )


@query("coordinate_parse")
def coordinate_parse(spark, sf):
    return _rows(spark, sf).select(
        "EventID", "Serial",
        F.col("CenterLat").cast("double").alias("CenterLat"),
        F.col("CenterLon").cast("double").alias("CenterLon"),
    )


@query("unit_pick")
def unit_pick(spark, sf):
    return _groups(spark, sf).select(
        "Serial",
        *[
            F.get("wind.WindPart.`jmx_eb:WindSpeed`", F.lit(n)).alias(f"wind_{n}")
            for n in (1, 3, 4)
        ],
        F.get("centre.`jmx_eb:Speed`", F.lit(1)).alias("speed_1"),
    )


@query("wind_fields")
def wind_fields(spark, sf):
    return _rows(spark, sf).select("EventID", "Serial", "MaxWindspeedNearCenter", "MaxGustSpeed")


@query("area_lookup")
def area_lookup(spark, sf):
    axes = "`jmx_eb:Circle`.`jmx_eb:Axes`.`jmx_eb:Axis`"
    return _groups(spark, sf).select(
        "EventID", "Serial",
        F.col("storm_area._type").alias("storm_type"),
        F.coalesce(F.size(f"storm_area.{axes}"), F.lit(-1)).alias("storm_axes"),
        F.col("gale_area._type").alias("gale_type"),
        F.coalesce(F.size(f"gale_area.{axes}"), F.lit(-1)).alias("gale_axes"),
    )


@query("axis_pairs")
def axis_pairs(spark, sf):
    paired = extract.axis_pairs(_groups(spark, sf))
    pairs = F.concat(
        F.transform(
            F.coalesce("storm_pairs", F.array()),
            lambda p: F.struct(F.lit("storm").alias("area"), p["direction"].alias("direction"), p["radius"].alias("radius")),
        ),
        F.transform(
            F.coalesce("gale_pairs", F.array()),
            lambda p: F.struct(F.lit("gale").alias("area"), p["direction"].alias("direction"), p["radius"].alias("radius")),
        ),
    )
    return paired.select("EventID", "Serial", F.explode(pairs).alias("p")).select("EventID", "Serial", "p.*")


@query("axis_pivot")
def axis_pivot(spark, sf):
    areas = [c for c in OBSERVATION_TYPES if c.startswith(("Bofuuiki", "Kyofuuiki"))]
    return _rows(spark, sf).select("EventID", "Serial", *areas)


@query("observation_typed")
def observation_typed(spark, sf):
    return extract.typed_observations(observations(_parsed(spark, sf)))


@query("event_year")
def event_year_(spark, sf):
    return _rows(spark, sf).select("Serial", event_year(F.col("ObservationTime")).alias("event_year"))


@query("obs_date_time")
def obs_date_time(spark, sf):
    time = F.col("ObservationTime")
    return _rows(spark, sf).select(
        "Serial", observation_date(time).alias("obs_date"), observation_time(time).alias("obs_time"),
        observation_date(F.col("InfoType")).alias("bad_date"),
        observation_time(F.col("InfoType")).alias("bad_time"),
    )


@query("document_render")
def document_render(spark, sf):
    rendered = document_rows(_rows(spark, sf))
    return rendered.select("Serial", F.md5("Text").alias("text_md5"), "text_chars")


@query("document_table")
def document_table_(spark, sf):
    return _documents(spark, sf).select(
        "id_", "EventID", "TyphoonName", "ObservationDate", "ObservationTime",
        "ObservationDateTime", "InfoType", "Serial", "InfoKindVersion", "Text",
        F.col("embedding").isNull().alias("embedding_missing"), "unique_event_id",
    )


@query("unique_event_id")
def unique_event_id(spark, sf):
    return _documents(spark, sf).select("EventID", "ObservationDateTime", "unique_event_id")


@query("document_id")
def document_id(spark, sf):
    return _documents(spark, sf).select("unique_event_id", "id_")


# --- dedup, sinks, change tracking -------------------------------------------


@query("dedup_latest")
def dedup_latest(spark, sf):
    return latest_observations(_rows(spark, sf)).select(*OBSERVATION_TYPES)


@query("upsert")
def upsert_(spark, sf):
    path = work_path(spark, "documents")
    for part in _corrections(_landed(spark, sf)):
        upsert(spark, documents_from_payloads(part), path)
    return read_documents(spark, path).select(
        "unique_event_id", "Serial", "InfoType", F.md5("Text").alias("text_md5"), "event_year"
    )


@query("change_feed")
def change_feed_(spark, sf):
    path = work_path(spark, "documents")
    for part in _corrections(_landed(spark, sf)):
        batch = upsert(spark, documents_from_payloads(part), path).batch
    feed = read_changes(spark, document_table(path), batch, batch)
    return feed.select("unique_event_id", "Serial", "InfoType", F.md5("Text").alias("text_md5"), "_change_type")


@query("raw_archive")
def raw_archive(spark, sf):
    path = work_path(spark, "archive")
    write_archive(_landed(spark, sf), path)
    number = F.regexp_extract("file_name", r"^(\d+)_", 1).cast("bigint")
    return read_archive(spark, path).groupBy("event_year", "EventID").agg(
        F.count("*").alias("n_files"),
        F.sum(number).alias("sum_numbers"),
        F.max(F.when(F.contains(F.col("body"), F.lit("</Report>")), 1).otherwise(0)).alias("whole"),
    )


# --- similarity retrieval ----------------------------------------------------


@query("embed_text")
def embed_text(spark, sf):
    vectors = embed(fx.table(spark, sf, "documents"), "doc_id", "text")
    parts = vectors.select("doc_id", F.posexplode("embedding").alias("dim", "x"))
    return parts.where("x <> 0").select(
        "doc_id", "dim", F.round(F.col("x").cast("double"), 5).alias("weight")
    )


@query("embedding_sync")
def embedding_sync(spark, sf):
    docs, labels = fx.table(spark, sf, "documents"), fx.table(spark, sf, "labels")
    # before: raw texts, one language not yet taken in; after: cleaned, flagged ones gone
    before = docs.where("lang <> 'es'").select("doc_id", "text")
    flagged = labels.where("toxic = 1").select("doc_id")
    after = docs.join(flagged, "doc_id", "left_anti").select(
        "doc_id", clean_sections(F.col("text")).alias("text")
    )
    index = stage(sync_index(None, before, "doc_id", "text"), "index")
    synced = sync_index(index, after, "doc_id", "text")
    actions = sync_actions(index, after, "doc_id", "text")
    held = synced.select("doc_id", F.lit(True).alias("indexed"))
    return actions.join(held, "doc_id", "left").select(
        "doc_id", "text_hash", "action", F.coalesce("indexed", F.lit(False)).alias("indexed")
    )


@query("index_sync")
def index_sync(spark, sf):
    """The stored index after three batches, synced from the changes of each."""
    landed, documents, index = stage(_landed(spark, sf), "landed"), work_path(spark, "documents"), work_path(spark, "index")
    third = F.pmod(F.xxhash64("link"), F.lit(3))
    for number in range(3):
        ingest(spark, parse_bulletins(landed.where(third == number)), documents)
        sync_stored_index(spark, documents, index)
    return read_index(spark, index).select("unique_event_id", "text_hash", F.size("embedding").alias("dim"))


@query("similarity_topk")
def similarity_topk(spark, sf):
    vectors = fx.table(spark, sf, "embeddings")
    return top_k(_centroids(vectors), vectors, 4, "query_label", "vec_id", 64)


@query("retriever_k3")
def retriever_k3(spark, sf):
    vectors = fx.table(spark, sf, "embeddings")
    found = search(
        _centroids(vectors), vectors, ["vec_id", "label", "embedding"], "query_label", "vec_id", 64, k=3
    )
    components = F.transform("embedding", lambda x: F.format_string("%.6f", x.cast("double")))
    return found.select(
        "query_label", "rank", "score", "vec_id", "label", F.array_join(components, " ").alias("components")
    )


@query("search_text")
def search_text_(spark, sf):
    """The four documents nearest to each benchmark text, by their embedding."""
    docs = fx.table(spark, sf, "documents")
    vectors = stage(embed(docs, "doc_id", "text"), "vectors").join(docs.select("doc_id", "lang"), "doc_id")
    found = search_text(fx.table(spark, sf, "benchmark"), vectors, ["doc_id", "lang"], "item_id", "text", "doc_id")
    return found.select("item_id", "rank", F.round("score", 5).alias("score"), "doc_id", "lang")


@query("similarity_ann")
def similarity_ann(spark, sf):
    vectors = fx.table(spark, sf, "embeddings")
    planes, path = plane_count(vectors.count(), 32), work_path(spark, "hash-index")
    write_hash_index(hash_index(vectors, "vec_id", "embedding", 64, planes), path)
    index = spark.read.schema("vec_id long, embedding array<float>, bucket int, shelf int").parquet(path)
    return approximate_top_k(_centroids(vectors), index, 4, "query_label", "vec_id", 64, planes, probes=6)


# --- questions and structured retrieval --------------------------------------


@query("question_parse")
def question_parse(spark, sf):
    docs = _document_table(spark, sf)
    asked = _questions(docs).select("question_id", "question").unionByName(stage(fx.worded_questions(docs), "wordings"))
    parsed = parse_questions(asked, storm_names(docs))
    split = question_times(split_parsed(parsed))
    return split.select("question_id", "name", "start", "end", F.size(F.split("parsed", ", ")).alias("n_parts"))


@query("question_gate")
def question_gate(spark, sf):
    return gate(fx.questions(_documents(spark, sf))).select("question_id", "parsed", "gate_ok")


@query("question_split")
def question_split(spark, sf):
    split = split_parsed(fx.questions(_documents(spark, sf)))
    return split.select("question_id", "name", "start_text", "end_text")


@query("question_times")
def question_times_(spark, sf):
    timed = question_times(split_parsed(fx.questions(_documents(spark, sf))))
    return timed.select("question_id", "start", "end")


@query("question_modes")
def question_modes(spark, sf):
    bounded, _ = resolve_questions(fx.questions(_documents(spark, sf)))
    return bounded.select("question_id", "mode", "lo", "hi")


@query("obs_jst")
def obs_jst(spark, sf):
    return _rows(spark, sf).select("Serial", tokyo_time(F.col("ObservationTime")).alias("obs_jst"))


@query("name_match")
def name_match(spark, sf):
    """Wanted names against the names that the table keeps, after its announcements and then its corrections."""
    path = work_path(spark, "documents")
    for part in _corrections(_landed(spark, sf)):
        upsert(spark, documents_from_payloads(part), path)
    names = read_names(spark, path)
    name = F.col("TyphoonName")
    spellings = [
        name, F.replace(name, F.lit("-"), F.lit(" ")), F.replace(name, F.lit("-"), F.lit("")),
        F.lower(name), F.concat(F.lit("Typhoon "), name), F.substring(name, 1, 2),
        F.substring(name, 4, 20), F.reverse(name), F.lit(""),
    ]
    wanted = names.select(F.explode(F.array(*spellings)).alias("asked")).select(
        normal_name(F.col("asked")).alias("name")
    )
    return match_names(wanted, names)


def _retrieval(name, start=None, end=None):
    def run(spark, sf):
        return retrieve(_document_table(spark, sf), name, start, end)

    return run


_QUERIES["retrieve_range"] = _retrieval("Kong Rey", datetime(2024, 1, 5), datetime(2024, 1, 12, 6))
_QUERIES["retrieve_day"] = _retrieval("typhoon Shanshan", datetime(2024, 1, 10))
_QUERIES["retrieve_instant"] = _retrieval("Trami", datetime(2024, 1, 10, 12))
_QUERIES["retrieve_upto"] = _retrieval("Shanshan", None, datetime(2024, 1, 9))
_QUERIES["retrieve_name"] = _retrieval("KongRey")


@query("retrieve_batch")
def retrieve_batch_(spark, sf):
    docs = _document_table(spark, sf)
    bounded, _ = resolve_questions(_questions(docs))
    hits = retrieve_batch(bounded, docs)
    return hits.withColumn("Text", F.md5("Text"))


@query("retrieve_fallback")
def retrieve_fallback(spark, sf):
    docs = _document_table(spark, sf)
    _, failed = resolve_questions(_questions(docs))
    index = _index(docs)
    hits = fallback_hits(failed, docs, index)
    return hits.select("question_id", "place", "unique_event_id", F.md5("Text").alias("text_md5"))


def _contexts(spark, sf):
    docs = _document_table(spark, sf)
    asked = _questions(docs)
    bounded, _ = resolve_questions(asked)
    return asked, window_contexts(bounded, docs)


@query("context_assembly")
def context_assembly(spark, sf):
    return _contexts(spark, sf)[1]


@query("answer_prompt")
def answer_prompt(spark, sf):
    asked, contexts = _contexts(spark, sf)
    prompts = answer_prompts(asked, contexts)
    return prompts.select(
        "question_id", "part", F.md5("prompt").alias("prompt_md5"), F.char_length("prompt").alias("prompt_chars")
    )


@query("answer_batch")
def answer_batch_(spark, sf):
    path = _published(spark, sf)
    sync_names(spark, path)
    docs = read_documents(spark, path)
    asked = _questions(docs).select("question_id", "question")
    index = _index(docs)
    answers = answer_batch(asked, docs, index, read_names(spark, path))
    return answers.select(
        "question_id", "mode", "part",
        F.md5("context").alias("context_md5"), F.md5("prompt").alias("prompt_md5"),
    )


# --- text and hashing helpers ------------------------------------------------


@query("section_clean")
def section_clean(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", clean_sections(F.col("text")).alias("text"))


@query("stable_bucket")
def stable_bucket_(spark, sf):
    return fx.table(spark, sf, "customer").select(
        "c_custkey", stable_bucket(F.col("c_name")).alias("bucket")
    )
