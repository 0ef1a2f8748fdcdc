"""DuckDB SQL for the queries of this subpackage that SQL can express."""


def llm_oracles() -> dict[str, str]:
    return dict(_SQL)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SQL: dict[str, str] = {
    "op2_decontamination": rf"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents),
        b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark),
        sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
        wanted AS (
            SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS words
            FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM sized)),
        sizes AS (SELECT DISTINCT n FROM wanted),
        places AS (
            SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n),
        hits AS (
            SELECT p.doc_id, p.s, p.n, t.item_id
            FROM (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS words FROM places) p
            JOIN wanted t USING (n, words)),
        hit_words AS (
            SELECT doc_id, count(DISTINCT pos) AS n_hit
            FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM (SELECT DISTINCT doc_id, s, n FROM hits)) GROUP BY doc_id),
        hit_items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
               sha256(coalesce(i.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items i USING (doc_id)""",
    "op5_mixing": r"""
        WITH named AS (
            SELECT doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
                   TRY_CAST(regexp_extract(coalesce(source, ''), '^src([0-9]{1,9})$', 1) AS INTEGER) AS number
            FROM documents),
        rows AS (
            SELECT doc_id, lang, source, n_tokens, coalesce(lang, '(none)') AS l, coalesce(source, '(none)') AS s,
                   CASE WHEN number < 10 THEN 'web' WHEN number < 15 THEN 'books' WHEN number >= 15 THEN 'reference' ELSE 'other' END AS domain
            FROM named),
        total AS (SELECT CAST(floor(sum(n_tokens) * 0.5) AS DOUBLE) AS budget FROM rows),
        leaves AS (
            SELECT domain, l, s, sum(n_tokens) AS tokens, CAST(sum(n_tokens) * 2 AS DOUBLE) AS cap,
                   CAST(CASE domain WHEN 'web' THEN 0.4 WHEN 'books' THEN 0.35 WHEN 'reference' THEN 0.2 ELSE 0.05 END AS DOUBLE) AS w1,
                   CAST(CASE l WHEN 'en' THEN 0.5 WHEN 'de' THEN 0.2 WHEN 'es' THEN 0.15 WHEN 'fr' THEN 0.15 ELSE 1.0 END AS DOUBLE) AS w2
            FROM rows GROUP BY domain, l, s),
        a0 AS (SELECT domain, sum(cap) AS cap, any_value(w1) AS w, any_value(budget) AS have FROM leaves, total GROUP BY domain HAVING sum(cap) > 0),
        a1 AS (SELECT *, (have - coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM a0),
        a AS (SELECT domain, CASE WHEN cap / w <= rate THEN cap
                     ELSE greatest(0, w * max(rate) FILTER (WHERE cap / w > rate) OVER ()) END AS have FROM a1),
        b0 AS (SELECT domain, l, sum(cap) AS cap, any_value(w2) AS w, any_value(have) AS have FROM leaves JOIN a USING (domain) GROUP BY domain, l HAVING sum(cap) > 0),
        b1 AS (SELECT *, (have - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / sum(w) OVER (PARTITION BY domain ORDER BY cap / w, l ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM b0),
        b AS (SELECT domain, l, CASE WHEN cap / w <= rate THEN cap
                     ELSE greatest(0, w * max(rate) FILTER (WHERE cap / w > rate) OVER (PARTITION BY domain)) END AS have FROM b1),
        c0 AS (SELECT domain, l, s, cap, CAST(1.0 AS DOUBLE) AS w, have FROM leaves JOIN b USING (domain, l) WHERE cap > 0),
        c1 AS (SELECT *, (have - coalesce(sum(cap) OVER (PARTITION BY domain, l ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / sum(w) OVER (PARTITION BY domain, l ORDER BY cap / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM c0),
        c AS (SELECT domain, l, s, CASE WHEN cap / w <= rate THEN cap
                     ELSE greatest(0, w * max(rate) FILTER (WHERE cap / w > rate) OVER (PARTITION BY domain, l)) END AS have FROM c1),
        plan AS (
            SELECT domain, l, s, CAST(floor(have + 1e-6) AS BIGINT) AS budget, tokens,
                   CAST(least(2, floor(floor(have + 1e-6) / tokens)) AS INTEGER) AS epochs
            FROM leaves JOIN c USING (domain, l, s)),
        placed AS (
            SELECT r.*, p.epochs, p.budget - p.epochs * p.tokens AS room,
                   md5('17|' || p.epochs || '|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
            FROM rows r JOIN plan p USING (domain, l, s)),
        run AS (
            SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, l, s ORDER BY place
                   RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS before
            FROM placed),
        taken AS (SELECT *, epochs + CASE WHEN epochs < 2 AND room > 0 AND before < room THEN 1 ELSE 0 END AS n FROM run)
        SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(unnest(range(0, n)) AS INTEGER) AS epoch FROM taken""",
    "op6_near_dedup": rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[s:s + 1], ' ') AS shingle
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS s FROM d WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
            FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        links AS (
            SELECT c.a, c.b FROM common c JOIN sizes x ON c.a = x.doc_id JOIN sizes y ON c.b = y.doc_id
            WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
        both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM d
            UNION
            SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON r.other = l.a)
        SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.other) AS component_id, d.doc_id = min(r.other) AS kept
        FROM d JOIN reach r USING (doc_id) LEFT JOIN sizes s USING (doc_id) GROUP BY d.doc_id""",
    "op7_line_dedup": rf"""
        WITH split_lines AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
            FROM documents),
        lines AS (
            SELECT doc_id, pos, line, regexp_extract_all(translate(line, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM split_lines),
        long_lines AS (SELECT doc_id, pos, w, array_to_string(w, ' ') AS words FROM lines WHERE len(w) >= 8 AND doc_id IS NOT NULL),
        firsts AS (SELECT words, any_value(w) AS w, min((doc_id, pos)) AS place FROM long_lines GROUP BY words),
        variants AS (
            SELECT words, place, len(w) AS n, i, array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') AS rest
            FROM (SELECT words, w, place, unnest(range(1, len(w) + 1)) AS i FROM firsts)),
        near AS (
            SELECT a.words, b.place FROM variants a JOIN variants b ON a.rest = b.rest AND a.i = b.i WHERE b.place < a.place
            UNION ALL SELECT a.words, b.place FROM firsts a JOIN variants b ON a.words = b.rest WHERE b.place < a.place
            UNION ALL SELECT a.words, b.place FROM variants a JOIN firsts b ON a.rest = b.words WHERE b.place < a.place
            UNION ALL SELECT words, place FROM firsts),
        earliest AS (SELECT words, min(place) AS place FROM near GROUP BY words),
        gone AS (SELECT l.doc_id, l.pos FROM long_lines l JOIN earliest e USING (words) WHERE e.place < (l.doc_id, l.pos)),
        kept AS (
            SELECT l.doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY l.pos) AS kept_text
            FROM split_lines l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
        SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS INTEGER) AS n_lines,
               CAST(coalesce(len(string_split(d.text, chr(10))), 0) - coalesce(k.n, 0) AS INTEGER) AS n_removed,
               CASE WHEN d.text IS NOT NULL THEN coalesce(k.kept_text, '') END AS text
        FROM documents d LEFT JOIN kept k USING (doc_id)""",
    "op10_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        places AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13),
        windows AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS words FROM places),
        earliest AS (SELECT words, min(doc_id) AS first_id FROM windows GROUP BY words),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS pos
            FROM windows JOIN earliest USING (words) WHERE first_id < doc_id),
        all_words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
        kept AS (
            SELECT a.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept_text
            FROM all_words a ANTI JOIN gone g ON a.doc_id = g.doc_id AND a.pos = g.pos GROUP BY a.doc_id)
        SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept_text, '')) AS kept_sha256
        FROM d LEFT JOIN kept k USING (doc_id)""",
    "op13_lexical": rf"""
        WITH d AS (
            SELECT row_number() OVER () AS place, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
            FROM documents),
        b AS (
            SELECT row_number() OVER () AS item, item_id,
                   regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
            FROM benchmark),
        wanted AS (SELECT item, item_id, term, count(*) AS q FROM (SELECT item, item_id, unnest(w) AS term FROM b) GROUP BY item, item_id, term),
        sums AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
        tfs AS (
            SELECT place, doc_id, n, term, count(*) AS tf
            FROM (SELECT place, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY place, doc_id, n, term),
        dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
        weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM dfs, sums),
        scores AS (
            SELECT item, item_id, place, doc_id, CAST(sum(q * x.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total)))) AS BIGINT) AS score
            FROM wanted JOIN tfs USING (term) JOIN weights x USING (term), sums GROUP BY item, item_id, place, doc_id)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
        FROM scores WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) <= 10""",
}
