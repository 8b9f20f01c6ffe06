"""URL filter lists that change over time.

Dated list entries (pattern, listed_at, action) become validity intervals; every capture is
judged by the entries active when it was fetched (an as-of join, cut into time buckets).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def url_host(url):
    """Host of a URL: lower case, without user, port and final dot, an IPv6 address in its brackets; null if there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1))
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host == "", F.lit(None)).otherwise(host)


def host_suffixes(host):
    """The host and every parent domain of two labels or more, longest first. Addresses have no parents."""
    labels = F.split(host, r"\.")
    return F.when(host.rlike(r"^[0-9]+(\.[0-9]+){3}$|^\["), F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels)))))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Entries (pattern, category, listed_at date, action 'add' or 'remove') -> the intervals
    [valid_from, valid_to) in which a pattern is listed in a category; valid_to is null while
    the listing lasts. An add while listed, or a remove while not, changes nothing; of
    entries of one day, 'remove' comes last. Rows with nulls in pattern, day or action go."""
    e = entries.select("pattern", "category", F.col("listed_at").cast("date").alias("listed_at"), "action").where(F.col("pattern").isNotNull() & F.col("listed_at").isNotNull() & F.col("action").isin("add", "remove"))
    # one action a day, so that repeated and contradicting rows have one meaning
    e = e.groupBy("pattern", "category", "listed_at").agg(F.max("action").alias("action"))
    w = Window.partitionBy("pattern", "category").orderBy("listed_at")
    e = e.withColumn("_last", F.lag("action").over(w)).where(F.col("_last").isNull() | (F.col("_last") != F.col("action")))
    e = e.withColumn("valid_to", F.lead("listed_at").over(w))
    return e.where(F.col("action") == "add").select("pattern", "category", F.col("listed_at").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", bucket_days: int = 64) -> DataFrame:
    """Judges ``captures`` (id, url, fetched_at) by the list entries active at fetch time.

    Returns for every capture: id, host, fetched_at (date), blocked, category, pattern,
    valid_from of the most specific active pattern (ties: smaller category, a null one first). Captures match an
    entry through their host or any parent domain. Intervals are cut into buckets of
    ``bucket_days``, so a capture meets only the intervals of its pattern and bucket: the join
    has equal keys and a key of a popular domain is split by the adaptive skew join.

    A null or hostless URL, or a null date, is never blocked. Repeated captures are each judged.
    """
    c = captures.select(F.col(id_col).alias("_id"), url_host(F.col("url")).alias("host"), F.col("fetched_at").cast("date").alias("fetched_at"))
    spans = validity_intervals(entries)
    day = lambda x: F.datediff(x, F.lit("1970-01-01").cast("date"))
    last = c.agg(F.max("fetched_at").alias("_last"))  # open intervals end with the newest capture
    spans = spans.crossJoin(F.broadcast(last)).where(F.col("valid_from") <= F.col("_last"))
    end = F.least(F.coalesce(F.date_sub("valid_to", 1), "_last"), F.col("_last"))
    spans = spans.select("pattern", "category", "valid_from", "valid_to", F.explode(F.sequence(F.floor(day(F.col("valid_from")) / bucket_days), F.floor(day(end) / bucket_days))).alias("bucket"))
    # captures of one host and day share one verdict: the join sees each pair once
    asked = c.where(F.col("host").isNotNull() & F.col("fetched_at").isNotNull()).select("host", "fetched_at").distinct()
    probes = asked.select("host", "fetched_at", F.floor(day(F.col("fetched_at")) / bucket_days).alias("bucket"), F.explode(host_suffixes(F.col("host"))).alias("pattern"))
    hit = probes.join(spans, ["pattern", "bucket"]).where((F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))))
    best = F.min(F.struct((-F.length("pattern")).alias("n"), F.col("category"), "pattern", "valid_from"))
    verdict = hit.groupBy("host", "fetched_at").agg(best.alias("b")).select("host", "fetched_at", F.col("b.category").alias("category"), F.col("b.pattern").alias("pattern"), F.col("b.valid_from").alias("valid_from"))
    out = c.join(verdict, ["host", "fetched_at"], "left")
    return out.select(F.col("_id").alias(id_col), "host", "fetched_at", F.col("pattern").isNotNull().alias("blocked"), "category", "pattern", "valid_from")


def derived_list(pages: DataFrame) -> DataFrame:
    """A dated block list made from the hosts of ``pages``: the hosts whose crc32 is divisible
    by 3 are listed on a day of 2023, delisted 90 days later and, if the crc32 is even,
    listed again after 60 more; parent domains whose crc32 is divisible by 5 get one lasting entry."""
    hosts = pages.select(url_host(F.col("url")).alias("pattern")).where("pattern IS NOT NULL").distinct()
    crc = F.crc32("pattern")
    first = F.date_add(F.lit("2023-01-01").cast("date"), (crc % 200).cast("int"))
    category = F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam")), (crc % 7 % 3 + 1).cast("int"))
    own = hosts.where(crc % 3 == 0).select("pattern", category.alias("category"), F.explode(F.array(
        F.struct(first.alias("listed_at"), F.lit("add").alias("action")),
        F.struct(F.date_add(first, 90).alias("listed_at"), F.lit("remove").alias("action")),
        F.struct(F.date_add(first, F.when(crc % 2 == 0, 150)).alias("listed_at"), F.lit("add").alias("action")))).alias("e")).select("pattern", "category", "e.listed_at", "e.action")
    parents = hosts.select(F.explode(F.slice(host_suffixes(F.col("pattern")), 2, 100)).alias("pattern")).distinct()
    crc = F.crc32("pattern")
    lasting = parents.where(crc % 5 == 0).select("pattern", F.lit("parked").alias("category"), F.date_add(F.lit("2023-06-01").cast("date"), (crc % 120).cast("int")).alias("listed_at"), F.lit("add").alias("action"))
    return own.unionByName(lasting)


def op2(spark, sf_dir):
    """Captures: all ``pages``, fetched on the day 2023-01-01 + page_id mod 365."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.date_add(F.lit("2023-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int")))
    return filter_captures(captures, derived_list(pages))


# DuckDB has no crc32, so op2 has no SQL; tests/llm holds it against a brute-force version.
