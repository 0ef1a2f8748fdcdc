"""DuckDB statements giving the expected result of every registered query.

Bulletin fields are arithmetic on ``events`` (FIXTURES.md), so the statements never
see XML. Fixed texts are shared with the package; all logic here is stated anew.
"""

import re

from stormlake.constants import ANSWER_PROMPT, DOCUMENT_LINES

# e: event, u: user; one row per bulletin that is not malformed
_RAW = """
raw AS (
  SELECT event_id AS e, 'TC' || lpad(CAST(user_id % 50 AS VARCHAR), 4, '0') AS "EventID",
    strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S') || '+09:00' AS "ObservationTime",
    CASE WHEN event_id % 5 = 0 THEN '訂正' ELSE '発表' END AS "InfoType",
    CAST(event_id AS VARCHAR) AS "Serial", '1.0_0' AS "InfoKindVersion",
    CASE user_id % 4 WHEN 0 THEN 'KONG-REY' WHEN 1 THEN 'SHANSHAN' WHEN 2 THEN 'TRAMI' END AS "TyphoonName",
    printf('%.2f', (1000 + event_id % 3000) / 100.0) AS "CenterLat",
    printf('%.2f', (10000 + event_id % 8000) / 100.0) AS "CenterLon",
    'L' || CAST(event_id % 20 AS VARCHAR) AS "CenterLocation",
    CASE WHEN event_id % 7 <> 0 THEN ['北', '南', '東', '西'][event_id % 4 + 1] END AS "CenterMovementDirection",
    CASE WHEN event_type <> 'error' THEN CAST(event_id % 60 AS VARCHAR) END AS "CenterSpeed",
    CAST(900 + event_id % 100 AS VARCHAR) AS "CentralPressure",
    CASE WHEN event_id % 11 <> 0 THEN CAST(event_id % 70 AS VARCHAR) END AS "MaxWindspeedNearCenter",
    CASE WHEN event_id % 11 <> 0 THEN CAST(event_id % 90 AS VARCHAR) END AS "MaxGustSpeed",
    CASE WHEN event_id % 3 <> 0 THEN '全域' END AS "Bofuuiki_Direction1",
    CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 500 AS VARCHAR) END AS "Bofuuiki_Radius1",
    CAST(NULL AS VARCHAR) AS "Bofuuiki_Direction2", CAST(NULL AS VARCHAR) AS "Bofuuiki_Radius2",
    '南東' AS "Kyofuuiki_Direction1", CAST(event_id % 400 AS VARCHAR) AS "Kyofuuiki_Radius1",
    '北西' AS "Kyofuuiki_Direction2", CAST(event_id % 300 AS VARCHAR) AS "Kyofuuiki_Radius2",
    'https://example.org/bulletins/' || CAST(event_id AS VARCHAR) || '_0_storm.xml' AS "URL",
    date_trunc('hour', ts) AS obs_jst
  FROM events WHERE event_id % 97 <> 0)"""

_FIELDS = [
    "EventID", "ObservationTime", "InfoType", "Serial", "InfoKindVersion", "TyphoonName",
    "CenterLat", "CenterLon", "CenterLocation", "CenterMovementDirection", "CenterSpeed",
    "CentralPressure", "MaxWindspeedNearCenter", "MaxGustSpeed", "Bofuuiki_Direction1",
    "Bofuuiki_Radius1", "Bofuuiki_Direction2", "Bofuuiki_Radius2", "Kyofuuiki_Direction1",
    "Kyofuuiki_Radius1", "Kyofuuiki_Direction2", "Kyofuuiki_Radius2", "URL",
]
_ALL = ", ".join(f'"{f}"' for f in _FIELDS)
_NUMBERS = [f for f in _FIELDS if re.match("CenterL[ao][tn]$|CenterSpeed|Central|Max|.*Radius", f)]


def _latest(source: str, where: str = "TRUE") -> str:
    return (
        f'SELECT * FROM {source} WHERE {where} '
        'QUALIFY row_number() OVER (PARTITION BY "EventID", "ObservationTime" ORDER BY e DESC) = 1'
    )


_MISSING = {"TyphoonName": "Unknown", "CenterSpeed": "N/A"}


def _filled(template: str, values) -> str:
    """A template as a DuckDB concatenation."""
    parts = []
    for n, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if n % 2:
            parts.append(values(piece))
        elif piece:
            parts.append("'" + piece.replace("'", "''") + "'")
    return " || ".join(parts)


_TEXT = _filled(
    "\n".join(DOCUMENT_LINES), lambda f: f"""coalesce("{f}", '{_MISSING.get(f, "nan")}')"""
)


def _rendered(source: str) -> str:
    return f"""
  SELECT *, "EventID" || "ObservationTime" AS k, sha256("EventID" || "ObservationTime") AS id_,
    {_TEXT} AS txt, substr("ObservationTime", 1, 10) AS d, substr("ObservationTime", 12, 8) AS t,
    substr("ObservationTime", 1, 4) AS y
  FROM ({source})"""


_DOCS = f"docs AS ({_rendered(_latest('raw'))})"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# question fixture: forms turn with (day, storm)
_QUESTIONS = """
days AS (SELECT DISTINCT "TyphoonName" AS storm, CAST(obs_jst AS DATE) AS d FROM docs WHERE "TyphoonName" IS NOT NULL),
numbered AS (
  SELECT CAST(date_diff('day', DATE '1970-01-01', d) * 3 + list_position(['KONG-REY', 'SHANSHAN', 'TRAMI'], storm) - 1 AS BIGINT) AS question_id,
    CASE storm WHEN 'KONG-REY' THEN 'Kong Rey' WHEN 'SHANSHAN' THEN 'typhoon Shanshan' ELSE 'Trami' END AS n,
    CASE storm WHEN 'KONG-REY' THEN 'KONG REY' ELSE storm END AS nn, storm, d,
    strftime(d, '%-d %b %Y') AS s0, strftime(d + 1, '%-d %b %Y') AS s1, strftime(d + 2, '%-d %b %Y') AS s2,
    strftime(d, '%Y-%m-%d') AS i0, strftime(d + 1, '%Y-%m-%d') AS i1, strftime(d + 2, '%Y-%m-%d') AS i2
  FROM days),
q AS (
  SELECT *, question_id % 7 AS form,
    CASE question_id % 7
      WHEN 0 THEN 'Where is ' || n || ' on ' || s0 || '?'
      WHEN 1 THEN 'What is the trajectory of ' || n || ' from ' || s0 || ' to ' || s1 || '?'
      WHEN 2 THEN 'Where is ' || n || ' on ' || s0 || ' 12pm?'
      WHEN 3 THEN 'What is the trajectory of ' || n || ' up to ' || s0 || '?'
      WHEN 4 THEN 'What is ' || n || '?'
      WHEN 5 THEN 'tell me about storms'
      ELSE 'What is the trajectory of ' || n || ' from ' || s0 || ' to ' || s1 || ' and then ' || s2 || ' 8pm?'
    END AS question,
    CASE question_id % 7
      WHEN 0 THEN n || ', ' || i0
      WHEN 1 THEN n || ', ' || i0 || ', ' || i1
      WHEN 2 THEN n || ', ' || i0 || 'T12:00:00'
      WHEN 3 THEN n || ', None, ' || i0
      WHEN 4 THEN n || ', None'
      WHEN 5 THEN 'tell me about storms'
      ELSE n || ', ' || i0 || ', ' || i1 || ', ' || i2 || 'T20:00:00'
    END AS parsed
  FROM numbered)"""

# what each form asks for, stated by form
_BOUNDED = """
bounded AS (
  SELECT question_id, question, storm,
    ['day', 'range', 'instant', 'upto', 'name'][form + 1] AS mode,
    CASE form WHEN 0 THEN CAST(d AS TIMESTAMP) WHEN 1 THEN CAST(d AS TIMESTAMP) WHEN 2 THEN d + INTERVAL 12 HOUR END AS lo,
    CASE form WHEN 0 THEN d + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND WHEN 1 THEN CAST(d + 1 AS TIMESTAMP)
      WHEN 2 THEN d + INTERVAL 12 HOUR WHEN 3 THEN CAST(d AS TIMESTAMP) END AS hi
  FROM q WHERE form < 5)"""

_HITS = """
hits AS (
  SELECT b.question_id, b.mode, docs.d, docs.t, docs.obs_jst, docs.txt, docs."TyphoonName", docs.id_, 0 AS place
  FROM bounded b JOIN docs ON docs."TyphoonName" = b.storm
   AND (b.lo IS NULL OR docs.obs_jst >= b.lo) AND (b.hi IS NULL OR docs.obs_jst <= b.hi))"""

_QCTES = (_RAW, _DOCS, _QUESTIONS, _BOUNDED, _HITS)


def _vectors(name: str, source: str, key: str, text: str) -> str:
    """CTE ``name(key, dim, w)``: hashed bag of words of a text column."""
    return f"""
{name}_n AS (
  SELECT key, CAST(CAST('0x' || substr(md5(t), 1, 8) AS UBIGINT) % 64 AS INTEGER) AS dim, count(*) AS n
  FROM (SELECT {key} AS key, unnest(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+')) AS t FROM {source})
  WHERE t <> '' GROUP BY ALL),
{name} AS (
  SELECT key, dim, CAST(CAST(n / sqrt(CAST(sum(n * n) OVER (PARTITION BY key) AS DOUBLE)) AS FLOAT) AS DOUBLE) AS w
  FROM {name}_n)"""


_FALLBACK = f"""
failed AS (SELECT question_id, question FROM q WHERE form >= 5),
asked AS (SELECT DISTINCT question FROM failed),
{_vectors("qv", "asked", "question", "question").strip()},
{_vectors("dv", "docs", "k", "txt").strip()},
likeness AS (
  SELECT qv.key AS question, dv.key AS k, round(sum(qv.w * dv.w), 9) AS score
  FROM qv JOIN dv USING (dim) GROUP BY ALL),
near AS (
  SELECT question, k, row_number() OVER (PARTITION BY question ORDER BY score DESC, k) AS place
  FROM likeness QUALIFY place <= 3),
found AS (
  SELECT f.question_id, 'similar' AS mode, docs.d, docs.t, docs.obs_jst, docs.txt, docs."TyphoonName", docs.id_, near.place, docs.k
  FROM failed f JOIN near USING (question) JOIN docs ON docs.k = near.k)"""


def _contexts(source: str) -> str:
    """Context per question, place, day and four million characters."""
    return f"""
sliced AS (
  SELECT *, coalesce(sum(length(txt) + 1) OVER (PARTITION BY question_id, place, CAST(obs_jst AS DATE) ORDER BY obs_jst, id_
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 4000000 AS slice
  FROM {source}),
contexts AS (
  SELECT question_id,
    lpad(CAST(place AS VARCHAR), 6, '0') || ' ' || coalesce(strftime(obs_jst, '%Y-%m-%d'), '9999-12-31')
      || ' ' || lpad(CAST(slice AS VARCHAR), 6, '0') AS part,
    string_agg(txt, ' ' ORDER BY obs_jst, id_) AS context
  FROM sliced GROUP BY 1, 2)"""


_PROMPT = _filled(
    ANSWER_PROMPT, {"context": "coalesce(c.context, '')", "query": "a.question"}.__getitem__
)

_CENTROIDS = """
parts AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT label AS query_label, i, round(avg(CAST(x AS DOUBLE)), 6) AS c FROM parts GROUP BY 1, 2)"""

_SCORES = """
scores AS (
  SELECT m.query_label, p.vec_id, round(sum(m.c * CAST(p.x AS DOUBLE)), 9) AS score
  FROM means m JOIN parts p USING (i) GROUP BY 1, 2)"""


def _top(k: int, source: str = "scores") -> str:
    return f"""
best AS (
  SELECT query_label, vec_id, score,
    CAST(row_number() OVER (PARTITION BY query_label ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM {source} QUALIFY rank <= {k})"""


# planes of 64 signs each, a fixed function of their position; a query opens its own bucket and the five
# whose planes it is nearest to
_PLANES = """
size AS (SELECT CAST(greatest(1, least(24, ceil(log2(count(*) / 32.0)))) AS INTEGER) AS planes FROM embeddings),
signs AS (
  SELECT (x - 1) // 64 AS plane, (x - 1) % 64 + 1 AS i,
    CASE WHEN (x * x * 2654435761 + x * 40503) % 4294967296 >= 2147483648 THEN 1 ELSE -1 END AS s
  FROM range(1, 1537) r(x), size WHERE (x - 1) // 64 < planes),
sides AS (
  SELECT v.kind, v.id, s.plane, sum(v.x * s.s) AS margin
  FROM (SELECT 'd' AS kind, vec_id AS id, i, CAST(x AS DOUBLE) AS x FROM parts
        UNION ALL SELECT 'q', query_label, i, c FROM means) v
  JOIN signs s USING (i) GROUP BY 1, 2, 3),
codes AS (
  SELECT kind, id, CAST(sum(CASE WHEN margin >= 0 THEN 1 << (planes - 1 - plane) ELSE 0 END) AS BIGINT) AS bucket
  FROM sides, size GROUP BY 1, 2),
distances AS (
  SELECT s.id AS query_label, b.bucket,
    sum(CASE WHEN (margin >= 0) <> ((b.bucket >> (planes - 1 - plane)) & 1 = 1) THEN margin * margin ELSE 0 END) AS far
  FROM sides s, size, (SELECT unnest(range(0, CAST(1 << planes AS BIGINT))) AS bucket FROM size) b WHERE s.kind = 'q' GROUP BY 1, 2),
opened AS (SELECT query_label, bucket FROM distances QUALIFY row_number() OVER (PARTITION BY query_label ORDER BY far) <= 6),
candidates AS (
  SELECT s.* FROM scores s JOIN codes d ON d.kind = 'd' AND d.id = s.vec_id JOIN opened o ON o.query_label = s.query_label AND o.bucket = d.bucket)"""

_SECTIONS = r"""array_to_string(list_transform(string_split_regex(text, '\n[ \t]*\n\s*'),
    lambda s: regexp_replace(replace(s, chr(10), ''), ' ?\.', '.', 'g')), chr(10))"""


def _retrieve(storm: str, condition: str) -> str:
    return (
        _with(_RAW, _DOCS)
        + f"""SELECT d AS "ObservationDate", t AS "ObservationTime", obs_jst AS "ObservationDateTime",
  txt AS "Text", "TyphoonName" FROM docs WHERE "TyphoonName" = '{storm}' AND {condition}"""
    )


def _raw(columns: str) -> str:
    return _with(_RAW) + f"SELECT {columns} FROM raw"


def all_oracles() -> dict[str, str]:
    header = '"EventID", "InfoType", "Serial", "InfoKindVersion"'
    numbers = ", ".join(f'CAST("{f}" AS DOUBLE) AS "{f}"' for f in _NUMBERS)
    areas = ", ".join(f'"{f}"' for f in _FIELDS if f.startswith(("Bofuuiki", "Kyofuuiki")))
    file_name = "CAST(event_id AS VARCHAR) || '_0_storm.xml'"
    link = f"'https://example.org/bulletins/' || {file_name}"
    upserted = (
        # corrections replace announcements of the same key, whatever the serial
        f"""merged AS (
  SELECT * FROM ({_latest('raw')}) WHERE FALSE
  UNION ALL SELECT * FROM corr
  UNION ALL SELECT * FROM ann WHERE ("EventID", "ObservationTime") NOT IN (SELECT "EventID", "ObservationTime" FROM corr))"""
    )
    split = (
        f"ann AS ({_latest('raw', 'e % 5 <> 0')})",
        f"corr AS ({_latest('raw', 'e % 5 = 0')})",
    )
    documents = """SELECT id_, "EventID", "TyphoonName", d AS "ObservationDate", t AS "ObservationTime",
  "ObservationTime" AS "ObservationDateTime" """
    both = (*_QCTES, _FALLBACK)
    every = "every_hit AS (SELECT * FROM hits UNION ALL SELECT * EXCLUDE (k) FROM found)"
    # plain-text questions without a date or storm parse to "None, None, None"
    plain = """asked_plain AS (
  SELECT question_id, question, CASE form WHEN 5 THEN 'name' WHEN 6 THEN 'similar'
    ELSE ['day', 'range', 'instant', 'upto', 'name'][form + 1] END AS mode FROM q)"""
    return {
        # scans and sources
        "bulletin_scan": _raw(f"{header}, CAST(2 AS INTEGER) AS n_sections"),
        "bulletin_parse": f"""SELECT {link} AS link, {file_name} AS file_name,
  CASE WHEN event_id % 97 <> 0 THEN 'TC' || lpad(CAST(user_id % 50 AS VARCHAR), 4, '0') END AS "EventID",
  CASE WHEN event_id % 97 <> 0 THEN CAST(event_id AS VARCHAR) END AS "Serial",
  event_id % 97 = 0 AS corrupt FROM events""",
        "feed_scan": """SELECT CASE WHEN page_id % 3 = 0 THEN '台風解析・予報情報（５日予報）' ELSE 'その他' END AS title,
  url AS link FROM pages""",
        "bulletin_stream": _with(_RAW, _DOCS)
        + 'SELECT k AS unique_event_id, "Serial", "TyphoonName", md5(txt) AS text_md5 FROM docs',
        "document_scan": _with(_RAW, _DOCS)
        + 'SELECT id_, "EventID", "TyphoonName", "ObservationTime" AS "ObservationDateTime", y AS event_year FROM docs',
        "bulletin_quarantine": f"""SELECT {link} AS link, {file_name} AS file_name,
  CASE WHEN event_id % 97 = 0 THEN 'unparsable' ELSE 'ok' END AS verdict FROM events""",
        "bulletin_folder": f"""SELECT {file_name} AS file_name,
  CASE WHEN event_id % 97 <> 0 THEN 'TC' || lpad(CAST(user_id % 50 AS VARCHAR), 4, '0') END AS "EventID",
  CASE WHEN event_id % 97 <> 0 THEN CAST(event_id AS VARCHAR) END AS "Serial",
  CASE WHEN event_id % 97 = 0 THEN 'unparsable' ELSE 'ok' END AS verdict FROM events""",
        # announced unless a multiple of 13, landed unless of 17, too late if of 19
        "live_ingest": _with(_RAW, f"docs AS ({_rendered(_latest('raw', 'e % 13 <> 0 AND e % 17 <> 0 AND e % 19 <> 0'))})")
        + f"""SELECT k AS what, 'document' AS status, "Serial" FROM docs
UNION ALL SELECT {link}, 'unparsable', NULL FROM events
  WHERE event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_id % 19 <> 0 AND event_id % 97 = 0
UNION ALL SELECT {link}, 'missing', NULL FROM events WHERE event_id % 13 <> 0 AND (event_id % 17 = 0 OR event_id % 19 = 0)
UNION ALL SELECT {link}, 'unannounced', NULL FROM events WHERE event_id % 17 <> 0 AND (event_id % 13 = 0 OR event_id % 19 = 0)""",
        "ingest_quarantine": f"""WITH judged AS (
  SELECT {file_name} AS file_name, user_id, ts, CASE WHEN event_id % 97 = 0 THEN 'unparsable' WHEN event_id % 89 = 0 THEN 'no event id'
    WHEN event_id % 83 = 0 THEN 'no sections' WHEN event_id % 79 = 0 THEN 'section without time' ELSE 'ok' END AS reason FROM events)
SELECT file_name, reason, TRUE AS whole, CAST(1 AS BIGINT) AS n FROM judged WHERE reason <> 'ok'
UNION ALL SELECT '', r.reason, TRUE, (SELECT count(*) FROM judged j WHERE j.reason = r.reason)
  FROM (SELECT unnest(['ok', 'unparsable', 'no event id', 'no sections', 'section without time']) AS reason) r
UNION ALL SELECT '', 'documents', TRUE, (SELECT count(*) FROM (SELECT DISTINCT user_id % 50, date_trunc('hour', ts) FROM judged WHERE reason = 'ok'))""",
        # filters, projections, nested extraction
        "feed_filter": r"""SELECT '台風解析・予報情報（５日予報）' AS title, url AS link,
  regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$') AS file_name FROM pages WHERE page_id % 3 = 0""",
        "link_filename": r"""SELECT page_id, regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$') AS file_name FROM pages""",
        "bulletin_header": _raw(f'{header}, "URL"'),
        "bulletin_unnest": _with(_RAW)
        + """SELECT "EventID", "Serial", section_type, CAST(item_no AS INTEGER) AS item_no, CAST(kind_no AS INTEGER) AS kind_no, property_type FROM (
  SELECT "EventID", "Serial", '実況' AS section_type, 0 AS item_no, 0 AS kind_no, '呼称' AS property_type FROM raw WHERE "TyphoonName" IS NOT NULL
  UNION ALL SELECT "EventID", "Serial", '実況', 0, CASE WHEN "TyphoonName" IS NULL THEN 0 ELSE 1 END, '中心' FROM raw
  UNION ALL SELECT "EventID", "Serial", '実況', e % 2,
    CASE WHEN e % 2 = 1 THEN 0 WHEN "TyphoonName" IS NULL THEN 1 ELSE 2 END, '風' FROM raw
  UNION ALL SELECT "EventID", "Serial", '予報', 0, 0, '中心' FROM raw)""",
        "observed_only": _raw("""
  "EventID", "Serial", '実況' AS section_type, "ObservationTime" """),
        "observation_rows": _raw(_ALL),
        "storm_name": _raw('"EventID", "Serial", "TyphoonName"'),
        "center_fields": _raw(
            '"EventID", "Serial", "CenterLocation", "CenterMovementDirection", "CenterSpeed", "CentralPressure"'
        ),
        "coordinate_parse": _raw(
            '"EventID", "Serial", (1000 + e % 3000) / 100.0 AS "CenterLat", (10000 + e % 8000) / 100.0 AS "CenterLon"'
        ),
        "unit_pick": _raw(
            '"Serial", "MaxWindspeedNearCenter" AS wind_1, "MaxGustSpeed" AS wind_3, '
            'CAST(NULL AS VARCHAR) AS wind_4, "CenterSpeed" AS speed_1'
        ),
        "wind_fields": _raw('"EventID", "Serial", "MaxWindspeedNearCenter", "MaxGustSpeed"'),
        "area_lookup": _raw("""
  "EventID", "Serial", CASE WHEN e % 3 <> 0 THEN '暴風域' END AS storm_type,
  CAST(CASE WHEN e % 3 <> 0 THEN 1 ELSE -1 END AS INTEGER) AS storm_axes,
  '強風域' AS gale_type, CAST(3 AS INTEGER) AS gale_axes"""),
        "axis_pairs": _with(_RAW)
        + """SELECT "EventID", "Serial", 'storm' AS area, '全域' AS direction, CAST(e % 500 AS VARCHAR) AS radius FROM raw WHERE e % 3 <> 0
  UNION ALL SELECT "EventID", "Serial", 'gale', '南東', CAST(e % 400 AS VARCHAR) FROM raw
  UNION ALL SELECT "EventID", "Serial", 'gale', '北西', CAST(e % 300 AS VARCHAR) FROM raw""",
        "axis_pivot": _raw(f'"EventID", "Serial", {areas}'),
        "observation_typed": _with(_RAW)
        + f"""SELECT * EXCLUDE (e, "Serial", {", ".join(f'"{f}"' for f in _NUMBERS)}), CAST("Serial" AS INTEGER) AS "Serial",
  {numbers}, substr("ObservationTime", 1, 4) AS event_year FROM ({_latest('raw')})""",
        "event_year": _raw('"Serial", substr("ObservationTime", 1, 4) AS event_year'),
        "obs_date_time": _raw(
            """"Serial", strftime(obs_jst, '%Y-%m-%d') AS obs_date, strftime(obs_jst, '%H:%M:%S') AS obs_time,
  'Unknown' AS bad_date, 'Unknown' AS bad_time"""
        ),
        "document_render": _with(_RAW)
        + f"""SELECT "Serial", md5(txt) AS text_md5, CAST(length(txt) AS INTEGER) AS text_chars
FROM ({_rendered("SELECT * FROM raw")})""",
        "document_table": _with(_RAW, _DOCS)
        + documents
        + """, "InfoType", "Serial", "InfoKindVersion", txt AS "Text", TRUE AS embedding_missing, k AS unique_event_id FROM docs""",
        "unique_event_id": _with(_RAW, _DOCS)
        + 'SELECT "EventID", "ObservationTime" AS "ObservationDateTime", k AS unique_event_id FROM docs',
        "document_id": _with(_RAW, _DOCS) + "SELECT k AS unique_event_id, id_ FROM docs",
        # dedup, sinks, change tracking
        "dedup_latest": _with(_RAW) + f"SELECT {_ALL} FROM ({_latest('raw')})",
        "upsert": _with(_RAW, *split, upserted)
        + f"""SELECT k AS unique_event_id, "Serial", "InfoType", md5(txt) AS text_md5, y AS event_year
FROM ({_rendered("SELECT * FROM merged")})""",
        "change_feed": _with(
            _RAW, *split, f"o AS ({_rendered('SELECT * FROM ann')})", f"n AS ({_rendered('SELECT * FROM corr')})"
        )
        + """SELECT k AS unique_event_id, "Serial", "InfoType", md5(txt) AS text_md5,
    'update_preimage' AS _change_type FROM o WHERE k IN (SELECT k FROM n)
  UNION ALL SELECT k, "Serial", "InfoType", md5(txt),
    CASE WHEN k IN (SELECT k FROM o) THEN 'update_postimage' ELSE 'insert' END FROM n""",
        "raw_archive": _with(_RAW)
        + """SELECT substr("ObservationTime", 1, 4) AS event_year, "EventID", count(*) AS n_files,
  CAST(sum(e) AS BIGINT) AS sum_numbers, CAST(1 AS INTEGER) AS whole FROM raw GROUP BY 1, 2""",
        # similarity
        "embed_text": _with(_vectors("dv", "documents", "doc_id", "text"))
        + "SELECT key AS doc_id, dim, round(w, 5) AS weight FROM dv",
        "embedding_sync": f"""WITH o AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE lang <> 'es'),
n AS (SELECT doc_id, sha256({_SECTIONS}) AS h FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL))
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.h, o.h) AS text_hash,
  CASE WHEN o.h IS NULL THEN 'insert' WHEN n.h IS NULL THEN 'delete' WHEN n.h = o.h THEN 'keep' ELSE 'update' END AS action,
  n.h IS NOT NULL AS indexed
FROM n FULL JOIN o ON n.doc_id = o.doc_id""",
        "index_sync": _with(_RAW, _DOCS) + "SELECT k AS unique_event_id, sha256(txt) AS text_hash, CAST(64 AS INTEGER) AS dim FROM docs",
        "similarity_topk": _with(_CENTROIDS, _SCORES, _top(4)) + "SELECT * FROM best",
        "retriever_k3": _with(_CENTROIDS, _SCORES, _top(3))
        + """SELECT b.query_label, b.rank, b.score, e.vec_id, e.label,
  array_to_string(list_transform(e.embedding, lambda x: printf('%.6f', CAST(x AS DOUBLE))), ' ') AS components
FROM best b JOIN embeddings e ON e.vec_id = b.vec_id""",
        "search_text": _with(_vectors("qv", "benchmark", "item_id", "text"), _vectors("dv", "documents", "doc_id", "text"))
        + """, scores AS (SELECT qv.key AS item_id, dv.key AS doc_id, round(sum(qv.w * dv.w), 9) AS score FROM qv JOIN dv USING (dim) GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY s.score DESC, doc_id) AS INTEGER) AS rank, round(s.score, 5) AS score, doc_id, lang
FROM scores s JOIN documents USING (doc_id)
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY s.score DESC, doc_id) <= 4""",
        "similarity_ann": _with(_CENTROIDS, _SCORES, _PLANES, _top(4, "candidates")) + "SELECT * FROM best",
        # questions and structured retrieval
        "question_parse": _with(_RAW, _DOCS, _QUESTIONS)
        + """SELECT question_id, CASE WHEN form = 5 THEN 'NONE' ELSE nn END AS name,
  CASE WHEN form IN (0, 1, 6) THEN CAST(d AS TIMESTAMP) WHEN form = 2 THEN d + INTERVAL 12 HOUR END AS "start",
  CASE WHEN form IN (1, 6) THEN CAST(d + 1 AS TIMESTAMP) WHEN form = 3 THEN CAST(d AS TIMESTAMP) END AS "end",
  CAST(CASE WHEN form = 6 THEN 4 ELSE 3 END AS INTEGER) AS n_parts FROM q
UNION ALL
SELECT question_id + 1000000, nn, CASE (question_id + 1000000) % 12
    WHEN 0 THEN CAST(d AS TIMESTAMP) WHEN 1 THEN CAST(d AS TIMESTAMP) WHEN 2 THEN d + INTERVAL 1110 MINUTE WHEN 3 THEN CAST(d AS TIMESTAMP)
    WHEN 4 THEN CAST(date_trunc('month', d) AS TIMESTAMP) WHEN 5 THEN CAST(date_trunc('month', d) AS TIMESTAMP)
    WHEN 6 THEN CAST(d + 1 AS TIMESTAMP) WHEN 7 THEN CAST(d AS TIMESTAMP) WHEN 9 THEN d + INTERVAL 13 HOUR WHEN 11 THEN CAST(d AS TIMESTAMP) END,
  CASE (question_id + 1000000) % 12
    WHEN 3 THEN CAST(d + 1 AS TIMESTAMP) WHEN 4 THEN CAST(d AS TIMESTAMP) WHEN 5 THEN CAST(d AS TIMESTAMP)
    WHEN 6 THEN TIMESTAMP '2199-12-31 23:59:59' WHEN 7 THEN TIMESTAMP '2199-12-31 23:59:59'
    WHEN 8 THEN d - INTERVAL 1 SECOND WHEN 11 THEN (d + 1) + INTERVAL 1275 MINUTE END,
  CAST(CASE WHEN (question_id + 1000000) % 12 = 10 THEN 2 ELSE 3 END AS INTEGER) FROM q""",
        # fixed value: the pattern of the gate
        "question_gate": _with(_RAW, _DOCS, _QUESTIONS)
        + r"""SELECT question_id, parsed, regexp_full_match(parsed,
  '(None|[\w\s]+), (None|\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2})?)?(, (''''|None|\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2})?))?') AS gate_ok FROM q""",
        "question_split": _with(_RAW, _DOCS, _QUESTIONS)
        + """SELECT question_id, trim(replace(upper(split_part(parsed, ', ', 1)), 'TYPHOON', '')) AS name,
  string_split(parsed, ', ')[2] AS start_text, string_split(parsed, ', ')[3] AS end_text FROM q""",
        "question_times": _with(_RAW, _DOCS, _QUESTIONS)
        + """SELECT question_id, try_cast(string_split(parsed, ', ')[2] AS TIMESTAMP) AS "start",
  try_cast(string_split(parsed, ', ')[3] AS TIMESTAMP) AS "end" FROM q""",
        "question_modes": _with(_RAW, _DOCS, _QUESTIONS, _BOUNDED)
        + "SELECT question_id, mode, lo, hi FROM bounded",
        "obs_jst": _raw('"Serial", obs_jst'),
        "name_match": _with(_RAW)
        + """, names AS (SELECT DISTINCT "TyphoonName" AS s FROM raw WHERE "TyphoonName" IS NOT NULL),
spelled AS (SELECT unnest([s, replace(s, '-', ' '), replace(s, '-', ''), lower(s), 'Typhoon ' || s,
  substr(s, 1, 2), substr(s, 4, 20), reverse(s), '']) AS a FROM names),
wanted AS (SELECT DISTINCT trim(replace(upper(a), 'TYPHOON', '')) AS name FROM spelled)
SELECT w.name, n.s AS "TyphoonName" FROM wanted w, names n
WHERE contains(n.s, w.name) OR contains(replace(n.s, '-', ''), w.name)
   OR contains(replace(n.s, '-', ''), replace(w.name, ' ', ''))""",
        "retrieve_range": _retrieve(
            "KONG-REY", "obs_jst BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12 06:00:00'"
        ),
        "retrieve_day": _retrieve("SHANSHAN", "CAST(obs_jst AS DATE) = DATE '2024-01-10'"),
        "retrieve_instant": _retrieve("TRAMI", "obs_jst = TIMESTAMP '2024-01-10 12:00:00'"),
        "retrieve_upto": _retrieve("SHANSHAN", "obs_jst <= TIMESTAMP '2024-01-09'"),
        "retrieve_name": _retrieve("KONG-REY", "TRUE"),
        "retrieve_batch": _with(*_QCTES)
        + """SELECT question_id, mode, d AS "ObservationDate", t AS "ObservationTime", obs_jst AS "ObservationDateTime",
  md5(txt) AS "Text", "TyphoonName" FROM hits""",
        "retrieve_fallback": _with(*both)
        + "SELECT question_id, CAST(place AS INTEGER) AS place, k AS unique_event_id, md5(txt) AS text_md5 FROM found",
        "context_assembly": _with(*_QCTES, _contexts("hits")) + "SELECT question_id, part, context FROM contexts",
        "answer_prompt": _with(*_QCTES, _contexts("hits"))
        + f"""SELECT question_id, part, md5(p) AS prompt_md5, CAST(length(p) AS INTEGER) AS prompt_chars FROM (
  SELECT a.question_id, coalesce(c.part, '') AS part, {_PROMPT} AS p
  FROM q a LEFT JOIN contexts c ON c.question_id = a.question_id)""",
        "answer_batch": _with(
            *both,
            plain,
            every,
            "chosen AS (SELECT e.* FROM every_hit e JOIN asked_plain a ON a.question_id = e.question_id AND a.mode = e.mode)",
            _contexts("chosen"),
        )
        + f"""SELECT question_id, mode, part, md5(context) AS context_md5, md5(p) AS prompt_md5 FROM (
  SELECT a.question_id, a.mode, coalesce(c.part, '') AS part, coalesce(c.context, '') AS context, {_PROMPT} AS p
  FROM asked_plain a LEFT JOIN contexts c ON c.question_id = a.question_id)""",
        # text and hashing helpers
        "section_clean": f"SELECT doc_id, {_SECTIONS} AS text FROM documents",
        "stable_bucket": """SELECT c_custkey, CAST(list_sum(list_transform(string_split(c_name, ''), lambda c: unicode(c))) % 9 + 1 AS INTEGER) AS bucket
FROM customer""",
    }
