"""Temporal URL lists: every capture is judged by the entries active when it was fetched.

A list is a log of dated entries ``(list_name, pattern, action, at)`` where
``action`` is ``add`` or ``remove``.  Entries become validity intervals
``[valid_from, valid_to)``; a capture is looked up under each host suffix and
each host-plus-path prefix that could be listed, and the intervals that hold at
its fetch time decide.  Only DataFrame functions are used.

The join key is the pattern, so a host that a third of the captures share is
spread by the optimiser's skew join: nothing but the equi-join needs its rows
together.  The matches of a capture come back to it by its own key, not by its
host.

Defined results: a capture with a null or hostless URL, or a null fetch time,
matches nothing and is allowed; entries with a null pattern or time are void;
entries of one pattern at the same time: a removal counts after an addition;
repeated additions keep the first interval open; repeated captures are judged
one by one; an empty list allows all; paths match by whole segments.  Other columns pass through, also those
named like the working columns here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoaudit.session import table


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals ``(list_name, pattern, valid_from, valid_to)``; open ones end null."""
    clean = entries.where(F.col("pattern").isNotNull() & F.col("at").isNotNull()).select(
        F.coalesce("list_name", F.lit("")).alias("list_name"), F.lower(F.trim("pattern")).alias("pattern"), (F.col("action") == "add").alias("on"), "at"
    )
    # the state after each instant: a removal wins over an addition
    state = clean.groupBy("list_name", "pattern", "at").agg(F.coalesce(F.min("on"), F.lit(False)).alias("on"))
    by = Window.partitionBy("list_name", "pattern").orderBy("at")
    turned = state.withColumn("was", F.lag("on", 1, False).over(by)).where(F.col("on") != F.col("was"))
    return (
        turned.withColumn("valid_to", F.lead("at").over(by))
        .where("on")
        .select("list_name", "pattern", F.col("at").alias("valid_from"), "valid_to")
    )


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without user, port and a final dot; empty if there is none."""
    authority = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


def path_of(url: Column) -> Column:
    """Path of a URL, without query and fragment."""
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)


def patterns_of(url: Column, depth: int) -> Column:
    """All patterns that would list a URL: host suffixes, and the host with path prefixes of up to ``depth`` segments."""
    labels = F.split(host_of(url), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    segments = F.filter(F.split(F.lower(path_of(url)), "/"), lambda s: s != "")
    some = F.least(F.size(segments), F.lit(depth))
    prefixes = F.when(some >= 1, F.transform(F.sequence(F.lit(1), some), lambda i: F.concat(host_of(url), F.lit("/"), F.concat_ws("/", F.slice(segments, 1, i)))))
    return F.when(host_of(url) != "", F.array_distinct(F.concat(suffixes, F.coalesce(prefixes, F.array().cast("array<string>")))))


def filter_urls(captures: DataFrame, entries: DataFrame, key: str, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """Every capture with ``allowed``, ``n_active``, ``rule`` and ``rule_list``.

    ``rule`` is the most specific active pattern (the longest; ties: the first in
    order, then the first list's), ``n_active`` how many entries are active.
    ``key`` names a column that tells captures apart; captures that share key,
    URL and fetch time get the same judgement, so they may be looked up once.
    """
    # no entry is deeper than this: one number, whatever the list's size
    depth = entries.agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0
    asked = captures.select(F.col(key).alias("__key"), F.col(url).alias("__url"), F.col(fetched).alias("__at"))
    probe = asked.where(F.col("__at").isNotNull()).select("__key", "__url", "__at", F.explode(patterns_of(F.col("__url"), depth)).alias("__p"))
    valid = intervals(entries).select(F.col("pattern").alias("__v"), F.col("list_name").alias("__l"), F.col("valid_from").alias("__f"), F.col("valid_to").alias("__t"))
    on = (F.col("__p") == F.col("__v")) & (F.col("__at") >= F.col("__f")) & (F.col("__t").isNull() | (F.col("__at") < F.col("__t")))
    # repeated captures would be counted once each: distinct (pattern, list, start) per capture
    hits = probe.join(valid, on).groupBy("__key", "__url", "__at").agg(
        F.collect_set(F.struct((-F.length("__p")).alias("n"), F.col("__p").alias("p"), F.col("__l").alias("l"), F.col("__f").alias("f"))).alias("__hits")
    )
    best = F.array_min("__hits")
    hits = hits.select("__key", "__url", "__at", F.size("__hits").cast("long").alias("__n"), best["p"].alias("__rule"), best["l"].alias("__list"))
    same = F.col(f"__in.{key}").eqNullSafe(F.col("__key")) & (F.col(f"__in.{url}") == F.col("__url")) & (F.col(f"__in.{fetched}") == F.col("__at"))
    out = captures.select(F.struct(*(F.col(f"`{c}`") for c in captures.columns)).alias("__in")).join(hits, same, "left")
    added = {"allowed": F.col("__n").isNull(), "n_active": F.coalesce("__n", F.lit(0)).cast("long"), "rule": F.col("__rule"), "rule_list": F.col("__list")}
    kept = [F.col(f"__in.`{c}`").alias(c) for c in captures.columns if c not in added]
    return out.select(*kept, *(v.alias(k) for k, v in added.items()))


#: The list of the query, dated entries of two block lists.
ENTRIES = [
    ("spam", "cheap-pills.example.com", "add", "2024-01-10"),
    ("spam", "cheap-pills.example.com", "remove", "2024-03-01"),
    ("spam", "cheap-pills.example.com", "add", "2024-05-15"),
    ("spam", "www.cheap-pills.example.com", "add", "2024-02-01"),
    ("spam", "example.net", "add", "2024-04-01"),
    ("spam", "example.net", "remove", "2024-06-01"),
    ("lang", "blog.ththly.example.org", "add", "2024-01-01"),
    ("lang", "example.org", "add", "2024-07-01"),
    ("lang", "therha.example.com/en", "add", "2024-02-15"),
    ("lang", "therha.example.com/en", "remove", "2024-08-15"),
]


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every row of ``pages`` by the dated list.

    ``pages`` has no fetch time, so the capture of page p counts as fetched at
    2024-01-01 plus (p * 7919) modulo 366 days.
    """
    entries = spark.createDataFrame(ENTRIES, "list_name string, pattern string, action string, day string").select("list_name", "pattern", "action", F.to_timestamp("day").alias("at"))
    day = F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int")
    captures = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.to_date(F.lit("2024-01-01")), day).cast("timestamp").alias("fetched"))
    judged = filter_urls(captures, entries, "page_id")
    return judged.select("page_id", "allowed", "n_active", "rule", "rule_list")


SQL = """
WITH entries(list_name, pattern, act, day) AS (VALUES %s),
state AS (SELECT list_name, pattern, day, bool_and(act = 'add') AS live FROM entries GROUP BY ALL),
lagged AS (SELECT *, coalesce(lag(live) OVER (PARTITION BY list_name, pattern ORDER BY day), false) AS was FROM state),
spans AS (
  SELECT list_name, pattern, live, day AS valid_from, lead(day) OVER (PARTITION BY list_name, pattern ORDER BY day) AS valid_to
  FROM lagged WHERE live <> was
),
asked AS (
  SELECT page_id, DATE '2024-01-01' + CAST((page_id * 7919) %% 366 AS INT) AS fetched,
    regexp_replace(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.\\-]*://([^/?#]*)', 1), '^.*@', ''), '\\.?(:[0-9]*)?$', '') AS host,
    lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*(/[^?#]*)', 1)) AS path
  FROM pages
),
hits AS (
  SELECT a.page_id, s.pattern, s.list_name, s.valid_from
  FROM asked a JOIN spans s ON s.live AND a.fetched >= s.valid_from AND (s.valid_to IS NULL OR a.fetched < s.valid_to)
    AND a.host <> ''
    AND (a.host = s.pattern OR ends_with(a.host, '.' || s.pattern)
      OR (contains(s.pattern, '/') AND starts_with(a.host || regexp_replace(a.path, '/*$', '') || '/', s.pattern || '/')))
),
best AS (
  SELECT page_id, count(*) AS n, min_by(pattern, (-length(pattern), pattern, list_name)) AS rule, min_by(list_name, (-length(pattern), pattern, list_name)) AS rule_list
  FROM hits GROUP BY page_id
)
SELECT p.page_id, b.n IS NULL AS allowed, CAST(coalesce(b.n, 0) AS BIGINT) AS n_active, b.rule, b.rule_list
FROM pages p LEFT JOIN best b USING (page_id)
""" % ", ".join(f"('{a}', '{b}', '{c}', DATE '{d}')" for a, b, c, d in ENTRIES)
