"""URL filters: a sort-merge range join of reversed-host keys with rules.

A rule is a host and a path prefix; it fits its host and all subdomains when
the url's path starts with the prefix, and the longest fitting rule (host and
path together) decides.

Keys: a host's labels reversed, joined by ``SEPARATOR``, a closing mark, then
the path.  A url is looked up once per parent host (its own, without the first
label, ...), so every rule is one interval of keys: all keys that begin with
the rule's key.  Such intervals are nested or disjoint, hence a sweep over
sorted keys needs only a stack of the active rules.

Keys are cut into ranges at sampled keys.  Look-ups of one range and the rules
whose intervals reach into it meet in one group; broad rules are repeated per
range.  Look-ups are ordered by key and row number, so one key that holds a
third of all rows is spread over many ranges.

Defined cases: null urls and urls without ``://`` have empty host and path
and fit no rule; rules with equal keys: the later in sort order of the verdict
wins; hosts without characters fit no rule; identical rows are judged once and returned as often as they came;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import string

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orchard.session import cut_lineage

SEPARATOR, CLOSE = "\x01", "\x02"
#: Above every character of a key.
_TOP = "\U0010ffff"
#: Keys sampled for each range.
SAMPLE_PER_RANGE = 30


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.expr("substring(url, locate('://', url) + 3)"))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def parent_keys(host: Column, path: Column) -> Column:
    """One key per parent host, the host itself first."""
    labels = F.reverse(F.split(host, r"\."))
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(
        F.concat_ws(SEPARATOR, F.slice(labels, 1, n)), F.lit(CLOSE), path))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, default: str = "allow",
          ranges: int | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    rules: (verdict, host, path) rows, as a list or as a table.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "verdict string, host string, path string")
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").groupBy("page_id", "url").agg(
        F.count("*").alias("times"))
    host, path = host_and_path(F.col("url"))
    rows = cut_lineage(rows.select(
        F.xxhash64("page_id", "url").alias("row"), "page_id", "url", "times", host.alias("host"), path.alias("path")))
    points = rows.where("host <> ''").select(
        "row", F.explode(parent_keys(F.col("host"), F.col("path"))).alias("key"))
    # the row's number after the key spreads one key's look-ups over ranges
    points = points.select("row", F.concat(
        "key", F.lit("\x00"), F.lpad(F.pmod(F.col("row"), F.lit(1 << 40)).cast("string"), 13, "0")).alias("key"))

    sample = points.select("key").orderBy(F.xxhash64("key"), "key").limit(ranges * SAMPLE_PER_RANGE)
    keys = sorted(r["key"] for r in sample.collect())
    bounds = [keys[i * len(keys) // ranges] for i in range(1, ranges)] if keys else []
    bounds = sorted(set(bounds))

    def place_points(batches):
        for pdf in batches:
            pdf["part"] = [bisect.bisect_right(bounds, k) for k in pdf["key"]]
            yield pdf

    def place_rules(batches):
        for pdf in batches:
            out = [(a, key, rule, verdict)
                   for key, rule, verdict in zip(pdf["key"], pdf["rule"], pdf["verdict"])
                   for a in range(bisect.bisect_right(bounds, key), bisect.bisect_right(bounds, key + _TOP) + 1)]
            yield pd.DataFrame(out, columns=["part", "key", "rule", "verdict"])

    # the labels of a rule's host end with the closing mark, so that a rule of
    # a host fits that parent host's keys alone
    labels = F.reverse(F.split("host", r"\."))
    rule_rows = rules.select(
        F.concat(F.concat_ws(SEPARATOR, labels), F.lit(CLOSE), F.col("path")).alias("key"),
        F.concat("host", "path").alias("rule"), "verdict").mapInPandas(
        place_rules, "part int, key string, rule string, verdict string")
    placed = points.select("row", "key").mapInPandas(place_points, "row long, key string, part int")

    def sweep(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Sorted keys against sorted rules; the top of the stack is the
        longest rule whose interval holds the key."""
        active = sorted(zip(right["key"], right["rule"], right["verdict"]))
        stack, at, out = [], 0, []
        for key, row in sorted(zip(left["key"], left["row"])):
            while at < len(active) and active[at][0] <= key:
                while stack and not active[at][0].startswith(stack[-1][0]):
                    stack.pop()
                stack.append(active[at])
                at += 1
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if stack:
                out.append((row, stack[-1][1], stack[-1][2]))
        return pd.DataFrame(out, columns=["row", "rule", "verdict"])

    found = placed.groupBy("part").cogroup(rule_rows.groupBy("part")).applyInPandas(
        sweep, "row long, rule string, verdict string")
    best = found.groupBy("row").agg(F.max(F.struct(F.length("rule").alias("length"), "rule", "verdict")).alias("best"))
    out = rows.join(best, "row", "left").withColumn("_copy", F.explode(F.expr("sequence(1, times)")))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                      F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
