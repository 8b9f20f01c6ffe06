"""Secret scans with multipart credential linking; DataFrame functions only.

Strong patterns are reported wherever they match. Weak candidates (user names, random-looking
words, endpoints) are reported only where complementary parts meet in one scope: the reach of an
identifier, joined with the parts as an interval join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, split_by_keys, written

#: The kinds, in the order that breaks ties of start. Strong: pattern, group whose length counts, least length.
STRONG = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),  # a run that is too short holds no longer one
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
WEAK = {
    "ident": r"""(?i:username|user|login|client_id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""",
    "secret": r"[A-Za-z0-9+/_-]{20,}",  # kept if it has a digit and a letter
    "endpoint": r"""https?://[^\x00-\x20"'<>]+|[a-z0-9-]+(?:\.[a-z0-9-]+)+:[0-9]{2,5}""",
}
#: The endpoint pattern as Java runs it: labels are possessive, so nothing recurses, and a host starts where no label, or label and
#: dot, stands before (or where the last match ended), so no host is read twice. Its matches are the same.
_JAVA = {"endpoint": r"""https?://[^\x00-\x20"'<>]++|(?:\G|(?<=\G\.)|(?<![a-z0-9-])(?<![a-z0-9-]\.))[a-z0-9-]++(?:\.[a-z0-9-]++)++:[0-9]{2,5}"""}
KINDS = (*STRONG, *WEAK)
#: Code points to either side of an identifier that belong to its scope.
REACH = 200
_BUCKET = 512


def _spans(text: Column, kind: str, hits: Column, lengths: Column | None = None, least: int = 0, ok=None) -> Column:
    """array<struct<start, kind, end>> of the matches ``hits``: places follow from the lengths of the
    pieces between matches. A match counts if its entry in ``lengths`` is at least ``least`` and ``ok``
    holds for it; others still use up their text."""
    pattern = STRONG[kind][0] if kind in STRONG else _JAVA.get(kind, WEAK[kind])
    k = KINDS.index(kind)
    pieces = F.transform(F.split(text, pattern, -1), F.length)
    parts = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(hits)).alias("gap"), F.transform(hits, F.length).alias("n"), (lengths if lengths is not None else F.transform(hits, F.length)).alias("m"), hits.alias("hit"))
    zero = F.struct(F.lit(0).alias("pos"), F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int>>)").alias("out"))

    def step(acc, x):
        start = acc["pos"] + x["gap"]
        end = start + x["n"]
        good = x["m"] >= least
        good = good & ok(x["hit"]) if ok else good
        return F.struct(end.alias("pos"), F.when(good, F.array_append(acc["out"], F.struct(start.alias("start"), F.lit(k).alias("kind"), end.alias("end")))).otherwise(acc["out"]).alias("out"))

    empty = F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int>>)")
    return F.when(F.size(hits) > 0, F.aggregate(parts, zero, step, lambda acc: acc["out"])).otherwise(empty)


def strong_spans(text: Column) -> Column:
    """Spans of the strong kinds in a text (null: none), each kind leftmost and non-overlapping."""
    text = F.coalesce(text, F.lit(""))
    out = []
    for kind, (pattern, group, least) in STRONG.items():
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        lengths = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) if group else None
        spans = _spans(text, kind, hits, lengths, least)
        out.append(F.when(text.rlike(pattern), spans).otherwise(F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int>>)")))
    return F.concat(*out)


def weak_spans(text: Column) -> Column:
    """Spans of the weak kinds in a text."""
    text = F.coalesce(text, F.lit(""))
    ok = {"secret": lambda h: h.rlike("[0-9]") & h.rlike("[A-Za-z]")}
    return F.concat(*[_spans(text, kind, F.regexp_extract_all(text, F.lit(_JAVA.get(kind, pattern)), F.lit(0)), ok=ok.get(kind)) for kind, pattern in WEAK.items()])


def link_weak(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """``parts`` (key, start, kind, end; kind as an index of KINDS) -> the weak ones to report.

    Identifiers ('access' and 'ident') widened by ``reach`` and merged where they touch are the
    scopes of a key; parts join the scope that their start lies in (equal key and
    bucket, then the interval; scopes of a key are disjoint, so a part meets one at most). Weak
    secrets that overlap a strong span are that span and drop out. In a scope a weak secret is
    reported as it meets an identifier; an ident or endpoint if the scope has a secret ('assign',
    'hex' or a weak one). All steps are linear in the parts of a text.
    """
    i = {k: KINDS.index(k) for k in KINDS}
    strong = F.col("kind") < len(STRONG)
    w = Window.partitionBy("key").orderBy("start", "kind", "end")
    parts = parts.withColumns({
        "_before": F.max(F.when(strong, F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "_after": F.min(F.when(strong, F.col("start"))).over(w.rowsBetween(1, Window.unboundedFollowing)),
    })
    covered = (F.coalesce("_before", F.lit(0)) > F.col("start")) | (F.coalesce("_after", F.lit(2**31 - 1)) < F.col("end"))
    parts = parts.where((F.col("kind") != i["secret"]) | ~covered).drop("_before", "_after")
    ids = parts.where(F.col("kind").isin(i["access"], i["ident"])).select("key", (F.col("start") - reach).alias("lo"), (F.col("end") + reach).alias("hi"))
    w = Window.partitionBy("key").orderBy("lo", "hi")
    ids = ids.withColumn("_new", (F.col("lo") > F.coalesce(F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-(2**31)))).cast("int"))
    ids = ids.withColumn("scope", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    scopes = ids.groupBy("key", "scope").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    scopes = scopes.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / _BUCKET), F.floor(F.col("hi") / _BUCKET))))
    inside = parts.withColumn("bucket", F.floor(F.col("start") / _BUCKET)).join(scopes, ["key", "bucket"]).where((F.col("start") >= F.col("lo")) & (F.col("start") < F.col("hi")))
    has_secret = F.max(F.col("kind").isin(i["assign"], i["hex"], i["secret"]).cast("int")).over(Window.partitionBy("key", "scope"))
    inside = inside.withColumn("_secret", has_secret)
    return inside.where((F.col("kind") == i["secret"]) | (F.col("kind").isin(i["ident"], i["endpoint"]) & (F.col("_secret") == 1))).select("key", "start", "kind", "end")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """Every row of ``docs``, its columns kept, with base_spans and spans: arrays of struct<start, kind,
    end>, sorted, in code points, kind an index of KINDS.

    A null or empty text has none; very long texts are scanned whole. Repeated rows each get theirs, an empty table gives no
    rows. Only texts with an identifier and something weak are dealt out by key, and only those with weak findings move. Input columns named base_spans or spans are replaced, all others stay.
    """
    docs = docs.drop("base_spans", "spans")
    key, weak, more = fresh(docs, "key"), fresh(docs, "weak"), fresh(docs, "extra")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text))
    scanned = keyed.withColumns({"base_spans": strong_spans(text), weak: weak_spans(text)})
    both = F.concat("base_spans", weak)
    linkable = (F.size(weak) > 0) & F.exists(both, lambda s: s["kind"].isin(KINDS.index("access"), KINDS.index("ident")))
    parts = scanned.where(linkable).select(F.col(key).alias("key"), F.explode(both).alias("s")).select("key", "s.*").distinct()
    extra = written(link_weak(parts, reach).groupBy(F.col("key").alias(key)).agg(F.collect_set(F.struct("start", "kind", "end")).alias(more)), "linked")
    some, rest = split_by_keys(keyed, key, extra.select(key))  # rows without weak findings don't move
    base = {"base_spans": F.array_sort(strong_spans(text))}
    some = some.join(extra, key, "left").withColumns(base).withColumn("spans", F.array_sort(F.concat("base_spans", F.coalesce(more, F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int>>)")))))
    rest = rest.withColumns(base).withColumn("spans", F.col("base_spans"))
    names = [*docs.columns, "base_spans", "spans"]
    return some.select(*names).unionByName(rest.select(*names))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[redacted]") -> Column:
    """The text with each run of overlapping spans replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(text, acc["pos"] + 1, F.greatest(F.lit(0), s["start"] - acc["pos"]))
        new = s["start"] >= acc["pos"]
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(new, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op8(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs)
    n = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(spans_text(F.col("base_spans")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    one = []
    for k, kind in enumerate(KINDS):
        pattern, group, least = STRONG.get(kind, (WEAK.get(kind), 0, 0))
        p = q(pattern)
        ok = f"length(regexp_extract_all(t, {p}, {group})[i]) >= {least}" + (f" AND regexp_matches(h[i], '[0-9]') AND regexp_matches(h[i], '[A-Za-z]')" if kind == "secret" else "")
        one.append(f"""
  SELECT r, start, {k} AS kind, start + length(h[i]) AS stop FROM (
    SELECT r, t, h, i, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0))::BIGINT AS start
    FROM (SELECT r, t, regexp_extract_all(t, {p}) AS h, string_split_regex(t, {p}) AS g, unnest(range(1, len(regexp_extract_all(t, {p})) + 1)) AS i FROM d WHERE regexp_matches(t, {p})))
  WHERE {ok}""")
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    join = lambda cond: f"coalesce(string_agg(({names})[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop){cond}, '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
p0 AS ({' UNION ALL'.join(one)}),
p1 AS (SELECT *, max(CASE WHEN kind < 3 THEN stop END) OVER (PARTITION BY r ORDER BY start, kind, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
              min(CASE WHEN kind < 3 THEN start END) OVER (PARTITION BY r ORDER BY start, kind, stop ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM p0),
p AS (SELECT r, start, kind, stop FROM p1 WHERE kind <> 4 OR NOT (coalesce(b, 0) > start OR coalesce(a, 2147483647) < stop)),
i0 AS (SELECT r, start - {REACH} AS lo, stop + {REACH} AS hi FROM p WHERE kind IN (1, 3)),
i1 AS (SELECT *, CASE WHEN lo > coalesce(max(hi) OVER (PARTITION BY r ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -2147483648) THEN 1 ELSE 0 END AS fresh FROM i0),
i2 AS (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS scope FROM i1),
s AS (SELECT r, scope, min(lo) AS lo, max(hi) AS hi FROM i2 GROUP BY ALL),
n AS (SELECT p.*, max(CASE WHEN kind IN (0, 2, 4) THEN 1 ELSE 0 END) OVER (PARTITION BY p.r, scope) AS sec
      FROM p JOIN s ON p.r = s.r AND start >= lo AND start < hi),
f AS (SELECT r, start, kind, stop FROM p0 WHERE kind < 3
      UNION SELECT r, start, kind, stop FROM n WHERE kind = 4 OR (kind IN (3, 5) AND sec = 1)),
o AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
             {join(' FILTER (kind < 3)')} AS base, {join('')} AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN o USING (r)
"""


OP8_SQL = _sql()
