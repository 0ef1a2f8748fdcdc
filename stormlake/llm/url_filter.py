"""URL filtering by hand-written rules and, where none fits, by learned path templates.

Templates are the branches of a tree for each host. Paths are cut into segments; numbers and long hexadecimal
strings become typed wildcards at once. Then level by level: a node with more than ``MOST_CHILDREN``
different children has a variable segment, which becomes ``*``; labelled siblings whose share of bad labels
does not differ significantly become one branch. A template is rejected when its smoothed share of bad labels is high:
it takes several bad ones and hardly a good one, so without evidence a page is allowed.

Everything is grouped sums and joins on (host, template, segment): pages are first counted by
host and masked path, so a host with a third of all pages is a few rows a task. Siblings are
only ordered where they are at most ``MOST_CHILDREN``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormlake.session import stage

MOST_CHILDREN = 32
#: segments of a path that are levels of their own; what follows is one last segment
LEVELS = 6
#: two shares of bad labels are the same branch within so many standard errors
SIMILAR = 2.0
#: prior share of bad labels and how many labels it weighs; least smoothed share of a rejected template
PRIOR, PRIOR_WEIGHT, REJECT_FROM = 0.1, 2.0, 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: str) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: str) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(rules: Sequence[tuple[str, str, str]], host: Column, path: Column, field: int | None = None) -> Column:
    """The longest fitting rule of ``(action, host, path)``: as text, or its action with ``field`` 0.

    A rule fits its host and all subdomains if the path starts with the rule's. Of equally long
    ones the blocking one wins. The list is written by hand; it becomes part of the plan.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))
    found = F.lit(None).cast("string")
    for rule in reversed(ordered):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        found = F.when(fits, F.lit(rule[1] + rule[2] if field is None else rule[field])).otherwise(found)
    return found


def masked_segments(path: Column) -> Column:
    """Segments with typed wildcards: ``{n}`` for digits, ``{h}`` for eight or more hexadecimal digits, file endings kept."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    head = F.slice(parts, 1, LEVELS - 1)
    tail = F.array_join(F.slice(parts, LEVELS, F.greatest(F.size(parts) - (LEVELS - 1), F.lit(0))), "/")
    cut = F.when(F.size(parts) < LEVELS, parts).otherwise(F.concat(head, F.array(tail)))
    digits = lambda s: F.regexp_replace(s, r"[0-9]+", "{n}")
    hexed = lambda s: F.regexp_replace(s, r"(?i)\b(?=[0-9a-f-]*[0-9])[0-9a-f][0-9a-f-]{7,}\b", "{h}")
    return F.transform(cut, lambda s: F.when(s.rlike(r"^[0-9]+(\.[A-Za-z0-9]+)?$"), digits(s)).otherwise(digits(hexed(s))))


def path_templates(paths: DataFrame) -> DataFrame:
    """``host, segments, template, good, bad`` for a table of ``host, segments, good, bad`` sums.

    Each level is written to the shared folder, as the next one reads it several times.
    """
    held = paths.withColumn("template", F.lit(""))
    for level in range(LEVELS):
        segment = F.get(F.col("segments"), level)
        held = held.withColumn("_segment", segment)
        children = held.where(F.col("_segment").isNotNull()).groupBy("host", "template", "_segment").agg(
            F.sum("good").alias("good"), F.sum("bad").alias("bad")
        )
        children = stage(children, "url-children")
        crowded = children.groupBy("host", "template").agg((F.count("*") > MOST_CHILDREN).alias("_crowded"))
        children = children.join(crowded, ["host", "template"])
        labels = F.col("good") + F.col("bad")
        few = children.where(~F.col("_crowded") & (labels > 0)).withColumn("_rate", F.col("bad") / labels)
        order = Window.partitionBy("host", "template").orderBy("_rate", "_segment")
        near, n, before = F.lag("bad").over(order), labels, F.lag(labels).over(order)
        pooled = (F.col("bad") + near) / (n + before)
        error = F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / before))
        parted = F.coalesce((F.col("_rate") - F.lag("_rate").over(order)) > SIMILAR * error, F.lit(True))
        branches = few.withColumn("_parted", parted.cast("int")).withColumn("_branch", F.sum("_parted").over(order))
        names = branches.groupBy("host", "template", "_branch").agg(F.array_join(F.array_sort(F.collect_list("_segment")), "|").alias("_name"))
        renamed = branches.join(names, ["host", "template", "_branch"]).select("host", "template", "_segment", "_name")
        renamed = renamed.unionByName(
            children.where(F.col("_crowded") | (labels == 0)).select(
                "host", "template", "_segment", F.when(F.col("_crowded"), "*").otherwise(F.col("_segment")).alias("_name")
            )
        )
        held = held.join(renamed, ["host", "template", "_segment"], "left").withColumn(
            "template", F.when(F.col("_name").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "_name"))
        ).drop("_segment", "_name")
        held = stage(held, "url-templates")
    return held


def rejected_templates(pages: DataFrame) -> DataFrame:
    """``host, segments, template, badness`` of every masked path under a rejected template.

    ``pages`` has ``host``, ``path`` and ``bad`` (true, false or null for no label).
    """
    paths = pages.where(F.col("host") != "").groupBy("host", masked_segments(F.col("path")).alias("segments")).agg(
        F.count_if(~F.col("bad")).alias("good"), F.count_if(F.col("bad")).alias("bad")
    )
    templates = path_templates(paths)
    judged = (
        templates.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        .withColumn("badness", (F.col("bad") + PRIOR * PRIOR_WEIGHT) / (F.col("good") + F.col("bad") + PRIOR_WEIGHT))
        .where(F.col("badness") >= REJECT_FROM)
    )
    return templates.select("host", "segments", "template").join(judged.select("host", "template", "badness"), ["host", "template"])


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], key: str = "page_id", url: str = "url", bad: str | None = None
) -> DataFrame:
    """``key, host, path, rule, template, verdict`` for every row.

    A page with a fitting rule gets its action. Any other is blocked if its path is under a rejected template of
    its host, else allowed. Labels are the rules' verdicts on the pages they fit and, if ``bad`` names a boolean column, that
    column where it is not null. ``template`` is set where one was rejected. A null url, one without ``://`` or with an empty
    host has no template and is allowed. Repeated rows are each judged; other columns are left out.
    """
    parts = pages.select(
        F.col(key).alias("_key"), host_of(url).alias("host"), path_of(url).alias("path"),
        (F.col(bad) if bad else F.lit(None)).cast("boolean").alias("_label"),
    )
    ruled = parts.withColumns({
        "rule": rule_of(rules, F.col("host"), F.col("path")), "_action": rule_of(rules, F.col("host"), F.col("path"), 0),
    })
    labelled = ruled.select("host", "path", F.coalesce("_label", F.col("_action") == "block").alias("bad"))
    rejected = rejected_templates(labelled)
    judged = ruled.withColumn("segments", masked_segments(F.col("path"))).join(rejected, ["host", "segments"], "left")
    verdict = F.coalesce("_action", F.when(F.col("template").isNotNull(), "block").otherwise("allow"))
    return judged.select(F.col("_key").alias(key), "host", "path", "rule", "template", verdict.alias("verdict"))
