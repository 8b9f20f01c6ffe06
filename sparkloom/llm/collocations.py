"""Phrase collocations by stripes.

A stripe is a counter of next words that belongs to a prefix: the empty prefix counts single words, a prefix of one word
counts pairs, of two words triples. Tasks fill stripes from texts; stripes of one prefix are merged element by element.
Extensions, prefix totals and the largest extension of a phrase are all read off the merged stripes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop, mix, written

#: Texts are counted in lots of about so many bytes; a longer text is cut between words into several lots.
LOT = 16 << 20
#: A stripe's next words are dealt over up to so many parts of it, so no task holds all that follow a common word.
PARTS = 64
#: Parts of stripes are packed into so many bundles a shuffle partition; one bundle at a time is merged.
BUNDLES = 4
#: Bits of the filter of frequent phrases (2 MB): a phrase that isn't frequent has no frequent extension.
_FILTER_BITS = 24
#: So many words of a lot are hashed, and about so many entries of it counted, at a time.
_AT_ONCE = 1 << 18
#: First ranking: so many groups a language each keep their own first rows.
_GROUPS = 64

# pieces end at . , ; : ! ? and U+000A to U+000D, words at spaces and tabs
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0b\x0c\x0d\t", bytes(range(97, 123)) + b"\n" * 9 + b" ")
_STRIPE = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("next", pa.list_(pa.string())), ("count", pa.list_(pa.int64()))])
_P = np.uint64(0x9E3779B97F4A7C15)


def _word_hash(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) if len(words) else np.empty(0, np.uint64)


def _known(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes of phrases are in the filter that frequent() made."""
    bit = h >> np.uint64(64 - _FILTER_BITS)
    return (known[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)).astype(np.int64)) & 1 == 1


def _chain(first: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Hashes of sequences, one column of hashes after the other."""
    out = mix(first)
    for h in more:
        out = mix(out * _P + h)
    return out


def _lots(batches: Iterator[pa.RecordBatch], size: int, depth: int) -> Iterator[tuple[list[str], pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(languages, and what _words() tells) of each lot. A part is a text, or some of a long one: it is cut between words, and
    what follows begins with the last ``depth`` words again, so that each run of depth + 1 words lies in one part and no run
    in two."""
    langs: dict[str, int] = {}
    of, parts, held = [], [], 0

    def out():
        nonlocal langs, of, parts, held
        starts = np.cumsum([1] + [len(p) + 1 for p in parts[:-1]])
        names, which, data = list(langs), np.array(of, np.int32), b"\n".join([b"", *parts, b""])
        langs, of, parts, held = {}, [], [], 0
        return names, *_words(which, data, starts)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(_FOLD)
            at = 0
            while at < len(data):
                ends = [x for x in (data.find(b" ", at + size), data.find(b"\n", at + size)) if x >= 0] if len(data) - at > size else []
                end = min(ends, default=len(data))
                of.append(langs.setdefault(lang, len(langs)))
                parts.append(data[at:end])
                held += end - at
                back = end
                for _ in range(depth if ends else 0):
                    while back > at and data[back - 1] in b" \n":
                        back -= 1
                    back = max(data.rfind(b" ", at, back), data.rfind(b"\n", at, back), at)
                at = back if back > at else end
                if held >= size:
                    yield out()
    if parts:
        yield out()


def _words(of: np.ndarray, data: bytes, starts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, which of them each word is, the language of each word, its piece) of folded bytes, whose parts begin at
    ``starts`` and are of the languages ``of``."""
    b = np.frombuffer(data, np.uint8)
    sep = (b == 32) | (b == 10)
    first = np.flatnonzero(sep[:-1] & ~sep[1:]).astype(np.int32)
    first += 1
    lens = np.zeros(len(first) + 1, np.int32)
    np.cumsum(np.flatnonzero(~sep[:-1] & sep[1:]).astype(np.int32) + 1 - first, out=lens[1:])
    lang = of[np.searchsorted(starts, first, "right") - 1]
    piece = np.searchsorted(np.flatnonzero(b == 10), first).astype(np.int32)
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(lens), pa.py_buffer(b[~sep])).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(), lang, piece


def _bundle(head: np.ndarray, word: np.ndarray, depth: int, bundles: int) -> np.ndarray:
    """The bundle of each entry, by the hashes of its prefix and of its next word. A stripe's next words are dealt over its
    parts; of the empty prefix, which all words follow, over all bundles."""
    part = word % np.uint64(PARTS) if depth else word
    return (mix(head + part * _P) % np.uint64(bundles)).astype(np.int32)


def _fill(langs: list[str], names: pa.Array, ids: np.ndarray, lang: np.ndarray, piece: np.ndarray, depth: int, known, bundles: int) -> Iterator[pa.RecordBatch]:
    """The stripes of prefixes of ``depth`` words in one lot, as batches (bundle, stripes): a serialised batch of stripes
    for each bundle. Entries are told their bundle some at a time and then counted for a range of bundles at a time, so only
    the words themselves are held for the whole lot."""
    n = len(ids) - depth
    if n <= 0:
        return
    hashes, lang_hash = _word_hash(names), _word_hash(pa.array(langs))
    phrase = lambda at, off: _chain(lang_hash[lang[at]], *[hashes[ids[at + off + i]] for i in range(depth)])
    starts, dealt = [], []
    for i in range(0, n, _AT_ONCE):
        # words that have `depth` more behind them in their piece
        at = i + np.flatnonzero(piece[i : min(i + _AT_ONCE, n)] == piece[i + depth : min(i + _AT_ONCE, n) + depth])
        head = phrase(at, 0)
        if known is not None and depth:  # the first and the last `depth` words must be a frequent phrase
            may = _known(known, head)
            at, head = at[may], head[may]
            may = _known(known, phrase(at, 1))
            at, head = at[may], head[may]
        starts.append(at.astype(np.int32))
        dealt.append(_bundle(head, hashes[ids[at + depth]], depth, bundles))
    starts, dealt = np.concatenate(starts), np.concatenate(dealt)
    ranges = min(bundles, -(-len(starts) // _AT_ONCE))
    edges = [bundles * i // ranges for i in range(ranges + 1)] if ranges else []
    for low, high in zip(edges[:-1], edges[1:]):
        at = starts[(dealt >= low) & (dealt < high)].astype(np.int64)
        if len(at):
            yield _stripes(langs, names, ids, lang, at, depth, bundles, hashes, phrase)


def _stripes(langs: list[str], names: pa.Array, ids: np.ndarray, lang: np.ndarray, at: np.ndarray, depth: int, bundles: int, hashes: np.ndarray, phrase) -> pa.RecordBatch:
    """The stripes of the prefixes that begin at the words ``at``, packed by bundle."""
    # prefixes as numbers: each word refines the number of those before it
    prefix, heads = lang[at].astype(np.int64), at
    for i in range(depth):
        _, where, prefix = np.unique(prefix * len(names) + ids[at + i], return_index=True, return_inverse=True)
        heads = at[where]
    if not depth:
        _, where, prefix = np.unique(prefix, return_index=True, return_inverse=True)
        heads = at[where]
    key, count = np.unique(prefix * len(names) + ids[at + depth], return_counts=True)
    prefix, word = key // len(names), key % len(names)
    bundle = _bundle(phrase(heads, 0)[prefix], hashes[word], depth, bundles)
    order = np.lexsort((prefix, bundle))
    prefix, word, count, bundle = prefix[order], word[order], count[order], bundle[order]
    new = np.flatnonzero(np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (bundle[1:] != bundle[:-1]))))
    offsets = pa.array(np.append(new, len(prefix)).astype(np.int32))
    lead = heads[prefix[new]]
    text = [names.take(pa.array(ids[lead + i])) for i in range(depth)]
    stripes = pa.RecordBatch.from_arrays([
        pa.array(langs, pa.string()).take(pa.array(lang[lead])), pc.binary_join_element_wise(*text, " ") if depth else pa.array([""] * len(lead), pa.string()),
        pa.ListArray.from_arrays(offsets, names.take(pa.array(word))), pa.ListArray.from_arrays(offsets, pa.array(count, pa.int64())),
    ], schema=_STRIPE)
    of_stripe = bundle[new]
    edge = np.flatnonzero(np.concatenate(([True], of_stripe[1:] != of_stripe[:-1], [True])))
    packed = [stripes.slice(i, j - i).serialize().to_pybytes() for i, j in zip(edge[:-1], edge[1:])]
    return pa.RecordBatch.from_arrays([pa.array(of_stripe[edge[:-1]], pa.int32()), pa.array(packed, pa.binary())], names=["bundle", "stripes"])


def _merge(stripes: list[pa.RecordBatch]) -> pa.Table:
    """(lang, prefix, next, count): the stripes of one bundle added up element by element."""
    flat = []
    for s in stripes:
        of = pc.list_parent_indices(s.column("next"))
        flat.append(pa.table([s.column("lang").take(of), s.column("prefix").take(of), pc.list_flatten(s.column("next")), pc.list_flatten(s.column("count"))], names=["lang", "prefix", "next", "count"]))
    return pa.concat_tables(flat).group_by(["lang", "prefix", "next"], use_threads=False).aggregate([("count", "sum")]).rename_columns(["lang", "prefix", "next", "count"])


def stripes(docs: DataFrame, depth: int, least: int, known: np.ndarray | None = None, lot: int = LOT) -> DataFrame:
    """The merged stripes of the prefixes of ``depth`` words: lang, prefix (space-joined), next and count (the next words
    met ``least`` times or more), hash (of each phrase) and total, the count of all next words of the part, rare ones too.
    A stripe may come in several parts with different next words. ``docs`` is (lang, text), null lang being und.
    ``known`` is a filter of frequent phrases of ``depth`` words: only they are extended."""
    spark = docs.sparkSession
    bundles = BUNDLES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(known)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _lots(batches, lot, depth):
            for out in _fill(*words, depth, shared.value, bundles):
                for i in range(0, len(out), 64):
                    yield out.slice(i, 64)
            words = out = None  # not held while the next lot is gathered
            pa.default_memory_pool().release_unused()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, held, size = None, [], 0

        def out():
            t = held[0] if len(held) == 1 and isinstance(held[0], pa.Table) else _merged(held)
            return _kept(t, depth, least)

        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                if k != bundle and held:
                    yield out()
                    held, size = [], 0
                bundle = k
                held.append(pa.ipc.read_record_batch(packed.as_buffer(), _STRIPE))
                size += held[-1].nbytes
                if size > 2 * lot:  # what has come so far becomes one table
                    held, size = [_merged(held)], 0
        if held:
            yield out()

    packed = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(fill, "bundle int, stripes binary")
    dealt = packed.repartition("bundle").sortWithinPartitions("bundle")
    return dealt.mapInArrow(merge, "lang string, prefix string, next array<string>, count array<long>, hash array<long>, total long")


def _merged(held: list) -> pa.Table:
    tables = [t for t in held if isinstance(t, pa.Table)]
    batches = [b for b in held if not isinstance(b, pa.Table)]
    if batches:
        tables.append(_merge(batches))
    if len(tables) == 1:
        return tables[0]
    return pa.concat_tables(tables).group_by(["lang", "prefix", "next"], use_threads=False).aggregate([("count", "sum")]).rename_columns(["lang", "prefix", "next", "count"])


def _kept(t: pa.Table, depth: int, least: int) -> pa.RecordBatch:
    """The merged stripes of a bundle with their frequent next words; stripes without one only add to a total a language."""
    if depth:
        t = t.filter(pc.greater_equal(t["count"], least))
        total = None
    else:
        total = t.group_by("lang").aggregate([("count", "sum")])
        t = t.filter(pc.greater_equal(t["count"], least))
    t = t.combine_chunks()
    flat = lambda c: t[c].combine_chunks() if t[c].num_chunks else pa.array([], t.schema.field(c).type)
    lang, prefix, word, count = flat("lang"), flat("prefix"), flat("next"), flat("count")
    codes = lambda a: a.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    a, b = codes(lang), codes(prefix)
    order = np.lexsort((b, a))
    a, b, at = a[order], b[order], pa.array(order)
    lang, prefix, word, count = (x.take(at) for x in (lang, prefix, word, count))
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    offsets = pa.array(np.append(new, len(a)).astype(np.int32))
    columns = [_word_hash(lang)]
    if depth:
        parts = pc.split_pattern(prefix, " ")
        h = _word_hash(pc.list_flatten(parts)).reshape(len(prefix), depth)
        columns += [h[:, i] for i in range(depth)]
    h = _chain(*columns, _word_hash(word)).view(np.int64)
    heads = pa.array(new)
    whole = dict(zip(total["lang"].to_pylist(), total["count_sum"].to_pylist())) if total is not None else {}
    langs = lang.take(heads)
    sums = [whole.pop(x, None) for x in langs.to_pylist()]
    lists = [pa.ListArray.from_arrays(offsets, x) for x in (word, count, pa.array(h, pa.int64()))]
    rest = len(whole)  # languages that have no frequent word here
    names = ["lang", "prefix", "next", "count", "hash", "total"]
    out = pa.RecordBatch.from_arrays([langs, prefix.take(heads), *lists, pa.array(sums, pa.int64())], names=names)
    if not rest:
        return out
    none = pa.RecordBatch.from_arrays([pa.array(list(whole), pa.string()), pa.array([""] * rest, pa.string()), *[pa.array([[]] * rest, x.type) for x in lists], pa.array(list(whole.values()), pa.int64())], names=names)
    return pa.Table.from_batches([out, none]).combine_chunks().to_batches()[0]


def frequent(found: DataFrame) -> np.ndarray:
    """A filter of the phrases in merged stripes (see _known()), put together by Spark as at most 2**18 words of 64 bits."""
    bits = F.expr("shiftleft(1L, CAST(h % 64 AS INT))")
    at = found.select(F.explode("hash").alias("h")).select(F.shiftrightunsigned("h", 64 - _FILTER_BITS).alias("h"))
    rows = at.groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(bits).alias("b")).toPandas()
    out = np.zeros(1 << (_FILTER_BITS - 6), np.int64)
    out[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64)
    return out


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, top: int = 2000, share: int = 50, lot: int = LOT) -> DataFrame:
    """The phrases of 2 to ``longest`` words that stick together, of each language: lang, rank (from 1), phrase, a (its
    occurrences, ``least`` or more), l and r (those of the two sides of its weakest cut), n (all words of the language)
    and score, floor(1000000 * a * a / (l * r)) at that cut.

    Texts (A-Z in lower case, a null one empty) are cut at .,;:!? and line ends; phrases lie within a piece, overlapping
    occurrences count. A phrase inside a longer one that has ``share`` percent of its occurrences or more is dropped. The
    first ``top`` by score, occurrences and phrase stay. A null language is und, repeated rows each count, columns
    beyond lang and text play no part, an empty table gives no rows.

    Stripes are filled level by level; a prefix is extended only where it and the last words may be frequent, so later levels
    move little. Every entry of a stripe is merged in one place, a stripe's entries in up to PARTS places.
    """
    docs = docs.select("lang", "text")
    levels, known = [], None
    for depth in range(longest):
        found = written(stripes(docs, depth, least, known, lot), f"stripes-{depth}")
        levels.append(found)
        if depth + 1 < longest:
            known = frequent(found)
    total = levels[0].groupBy("lang").agg(F.sum("total").alias("n"))
    entry = lambda df: df.select("lang", "prefix", F.explode(F.arrays_zip("next", "count")).alias("e")).select("lang", "prefix", F.trim(F.concat_ws(" ", "prefix", "e.next")).alias("phrase"), F.col("e.count").alias("a"))
    counts = entry(levels[0])
    for found in levels[1:]:
        counts = counts.unionByName(entry(found))
    counts = written(counts, "phrases")

    longer = counts.where("prefix <> ''")
    words = F.split("phrase", " ")
    # the largest extension of each phrase: to the right the maximum of its stripe, to the left over the stripes it ends
    right = levels[-1].select("lang", F.col("prefix").alias("phrase"), F.array_max("count").alias("m")).limit(0)
    for found in levels[2:]:
        right = right.unionByName(found.select("lang", F.col("prefix").alias("phrase"), F.array_max("count").alias("m")))
    inner = longer.where(F.size(words) > 2).select("lang", "a", F.explode(F.filter(_runs(words), lambda p: p.isNotNull())).alias("phrase"))
    most = right.unionByName(inner.select("lang", "phrase", F.col("a").alias("m"))).groupBy("lang", "phrase").agg(F.max("m").alias("m"))
    kept = longer.select("lang", "phrase", "a").join(most, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("m") < share * F.col("a"), F.lit(True))).drop("m")

    cut = F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k")
    cuts = kept.select("lang", "phrase", "a", cut).select(
        "*", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice(words, F.col("k") + 1, F.size(words)), " ").alias("right"))
    side = lambda name, c: counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(c))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    wide = lambda c: f"CAST({c} AS DECIMAL(15, 0))"  # noqa: E731  # products of 37 digits at most
    score = F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * ({wide('a')} * {wide('a')})) div ({wide('l')} * {wide('r')})").cast("long")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")

    order = [F.desc("score"), F.desc("a"), "phrase"]
    first = Window.partitionBy("lang", (F.crc32("phrase") % _GROUPS)).orderBy(*order)
    best = best.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= top).drop("_r")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    out = written(ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    drop(*levels, counts)
    return out


def _runs(words):
    """The contiguous runs of 2 or more of ``words`` that are shorter than all of them and aren't its beginning."""
    n = F.size(words)
    starts = F.sequence(F.lit(2), n - 1)
    return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(2), n - i + 1), lambda m: F.array_join(F.slice(words, i, m), " "))))


def op11(spark, sf_dir):
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])) AS g FROM p, range(1, 4) r(m) WHERE len(w) >= m),
c AS (SELECT lang, m, array_to_string(g, ' ') AS phrase, any_value(g) AS g, count(*) AS f FROM g GROUP BY 1, 2, 3),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE m = 1 GROUP BY 1),
b AS (SELECT * FROM c WHERE m > 1 AND f >= 10),
s AS (SELECT lang, array_to_string(g[1:2], ' ') AS phrase, f FROM b WHERE m = 3 UNION ALL SELECT lang, array_to_string(g[2:3], ' '), f FROM b WHERE m = 3),
x AS (SELECT lang, phrase, max(f) AS m FROM s GROUP BY 1, 2),
y AS (SELECT b.*, k FROM b JOIN range(1, 3) r(k) ON k < m WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.lang = b.lang AND x.phrase = b.phrase AND 100 * x.m >= 50 * b.f)),
z AS (SELECT y.lang, y.phrase, y.f AS a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * y.f::HUGEINT * y.f::HUGEINT // (l.f::HUGEINT * r.f::HUGEINT))::BIGINT AS score
      FROM y JOIN c l ON l.lang = y.lang AND l.phrase = array_to_string(y.g[1:k], ' ') JOIN c r ON r.lang = y.lang AND r.phrase = array_to_string(y.g[k + 1:], ' ')),
v AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM z),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM v WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""
