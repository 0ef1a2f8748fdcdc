import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from stormlake.llm import url_filter as u
from stormlake.llm.url_filter import judge_urls

SCHEMA = "page_id long, url string, bad boolean"
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]


def brute_force(rows):
    """The same tree, a node at a time in plain Python."""
    parsed = []
    for key, url, bad in rows:
        found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (found[1], found[2]) if found else ("", "")
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fit = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        rule = max(fit, key=lambda r: len(r[1] + r[2]), default=None)
        parts = re.sub("^/", "", path).split("/")
        parts = parts if len(parts) < u.LEVELS else parts[: u.LEVELS - 1] + ["/".join(parts[u.LEVELS - 1 :])]
        masked = []
        for s in parts:
            if not re.search(r"^[0-9]+(\.[A-Za-z0-9]+)?$", s):
                s = re.sub(r"(?i)\b(?=[0-9a-f-]*[0-9])[0-9a-f][0-9a-f-]{7,}\b", "{h}", s)
            masked.append(re.sub(r"[0-9]+", "{n}", s))
        label = bad if bad is not None else (rule[0] == "block" if rule else None)
        parsed.append((key, host, path, rule, tuple(masked), label))
    template = {(host, seg): "" for _, host, _, _, seg, _ in parsed if host}
    labels = defaultdict(lambda: [0, 0])
    for _, host, _, _, seg, label in parsed:
        if host and label is not None:
            labels[host, seg][label] += 1
    for level in range(u.LEVELS):
        children = defaultdict(lambda: defaultdict(lambda: [0, 0]))
        for (host, seg), t in template.items():
            if level < len(seg):
                for i in (0, 1):
                    children[host, t][seg[level]][i] += labels[host, seg][i]
        names = {}
        for node, kids in children.items():
            if len(kids) > u.MOST_CHILDREN:
                names.update({(*node, k): "*" for k in kids})
                continue
            names.update({(*node, k): k for k in kids})
            known = sorted((b / (g + b), k) for k, (g, b) in kids.items() if g + b)
            groups = []
            for i, (rate, k) in enumerate(known):
                g, b = kids[k]
                if i:
                    g0, b0 = kids[known[i - 1][1]]
                    pooled = (b + b0) / (g + b + g0 + b0)
                    error = (pooled * (1 - pooled) * (1 / (g + b) + 1 / (g0 + b0))) ** 0.5
                    if not rate - known[i - 1][0] > u.SIMILAR * error:
                        groups[-1].append(k)
                        continue
                groups.append([k])
            for group in groups:
                names.update({(*node, k): "|".join(sorted(group)) for k in group})
        for (host, seg), t in list(template.items()):
            if level < len(seg):
                template[host, seg] = f"{t}/{names[host, t, seg[level]]}"
    sums = defaultdict(lambda: [0, 0])
    for (host, seg), t in template.items():
        for i in (0, 1):
            sums[host, t][i] += labels[host, seg][i]
    rejected = {k for k, (g, b) in sums.items() if (b + u.PRIOR * u.PRIOR_WEIGHT) / (g + b + u.PRIOR_WEIGHT) >= u.REJECT_FROM}
    out = []
    for key, host, path, rule, seg, _ in parsed:
        t = template.get((host, seg)) if host else None
        t = t if (host, t) in rejected else None
        verdict = rule[0] if rule else "block" if t is not None else "allow"
        out.append((key, host, path, rule[1] + rule[2] if rule else None, t, verdict))
    return sorted(out, key=str)


def ours(spark, rows):
    found = judge_urls(spark.createDataFrame(rows, SCHEMA), RULES, bad="bad").collect()
    return sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["template"], r["verdict"]) for r in found), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for key in range(1500):
        host = rng.choice(["a.org", "B.org", "x.example.com", "www.example.com", "news.net", "shop.info"])
        kind = rng.choice(["casino", "news", "blog", "user"])
        path = {
            "casino": f"/casino/{rng.randrange(10**6)}", "news": f"/news/{rng.choice(['en', 'es', 'de'])}/{rng.randrange(99)}.html",
            "blog": f"/blog/{''.join(rng.choice('ghijklm') for _ in range(6))}/post", "user": f"/es/{rng.getrandbits(64):016x}/a/b/c/d/e/f",
        }[kind]
        share = {"casino": 0.97, "news": 0.05, "blog": 0.5, "user": 0.2}[kind]
        bad = rng.random() < share if rng.random() < 0.4 else None
        rows.append((key, f"https://{host}{path}" + rng.choice(["", "?q=1", "#top", "/"]), bad))
    found = ours(spark, rows)
    assert found == brute_force(rows)
    assert any(r[5] == "block" and r[3] is None for r in found)
    assert any("*" in (r[4] or "") or "|" in (r[4] or "") for r in found) or any(r[4] for r in found)


def test_edge_urls(spark):
    rows = [
        (1, None, None), (2, "", True), (3, "no scheme.com/en/", None), (4, "http://", None), (5, "http:///en/x", None),
        (6, "HTTP://WWW.Example.COM/en/É?x", None), (7, "a://b://c/d", None), (8, "http://com", None), (9, "http://x.com?y/", None),
        (10, "http://notexample.com/en/1", None), (11, "http://example.com/en/1", None), (11, "http://example.com/en/1", None),
        (None, "http://sub.net/es/1", None), (12, "http://h.org/" + "a/" * 50000, None), (13, "x\ny://h.org/z", None),
    ]
    assert ours(spark, rows) == brute_force(rows)
    assert judge_urls(spark.createDataFrame([], SCHEMA), RULES).collect() == []
    clash = spark.createDataFrame([(1, "http://a.com/", "x", 2)], "page_id long, url string, host string, template int")
    assert judge_urls(clash, RULES).first()["host"] == "a.com"


def test_whole_query_on_the_given_table(spark):
    from stormlake.llm.queries import URL_RULES, llm_queries

    sf = "/root/testdata/sf0.01"
    found = llm_queries()["op3_url_filter"](spark, sf)
    assert found.count() == spark.read.parquet(f"{sf}/pages.parquet").count()
    fixed = {f"{h}{p}": a for a, h, p in URL_RULES}
    assert found.where(F.col("rule").isNotNull()).select("rule", "verdict").distinct().collect()
    assert all(fixed[r["rule"]] == r["verdict"] for r in found.where(F.col("rule").isNotNull()).collect())
