"""Language of the words of a text by a linear-chain conditional random field.

Word features are byte n-grams with the word's edges (so prefixes and suffixes are among
them) and the word itself (a hashed lexicon); label transitions are learned from training
sequences that switch between languages; forward-backward over the whole text gives each word's label probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import crc_mod, drop, fresh, written

#: Documents for each language that the field is fitted on, and their most characters.
TRAIN_DOCS, TRAIN_CHARS = 300, 20_000
#: With more languages than this, each has fewer documents, so the sample stays as large.
FULL_LANGUAGES = 64
#: Words of a link; a text is a chain of links.
CHAIN = 64
_BITS = 18
_PIECE = 1 << 17  # bytes of text whose features are computed at once

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def _bucket(x: np.ndarray, salt: int) -> np.ndarray:
    return ((x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _BITS)).astype(np.int64)


def word_features(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature buckets of the bytes of words: shape (3, bytes), where each word starts among these
    bytes, lexicon bucket of each word) of a lower-case text."""
    b = np.frombuffer(b" " + data + b"  ", np.uint8)
    letter = _LETTER[b]
    b = np.where(letter, b, 32).astype(np.uint64)
    at = np.flatnonzero(letter)
    if not len(at):
        return np.empty((3, 0), np.int64), at, at
    two = b[at - 1] | b[at] << np.uint64(8)
    three = two | b[at + 1] << np.uint64(16)
    four = three | b[np.minimum(at + 2, len(b) - 1)] << np.uint64(24)
    grams = np.stack([_bucket(two, 1), _bucket(three, 2), _bucket(four, 3)])
    first = np.flatnonzero(~letter[at - 1])
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    weight = (b[at] + np.uint64(1)) * (np.uint64(0x100000001B3) ** (place % 4096).astype(np.uint64))
    return grams, first, _bucket(np.add.reduceat(weight, first), 4)


class Field:
    """labels, weights (buckets, labels) and transitions (labels, labels)."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.weights = np.zeros((1 << _BITS, len(labels)), np.float32)
        self.transitions = np.zeros((len(labels), len(labels)))

    def emissions(self, data: bytes, places: bool = False):
        """(words, labels): each word's summed feature weights; with ``places`` also where each word starts in ``data``."""
        grams, first, word = word_features(data)
        if not len(first):
            none = np.empty((0, len(self.labels)))
            return (none, np.empty(0, np.int64)) if places else none
        each = self.weights[grams[0]]
        each += self.weights[grams[1]]
        each += self.weights[grams[2]]
        out = np.add.reduceat(each, first, axis=0).astype(np.float64) + self.weights[word]
        return (out, np.flatnonzero(_LETTER[np.frombuffer(data, np.uint8)])[first]) if places else out

    def posteriors(self, emissions: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities (chains, CHAIN, labels) by forward-backward, and expected transitions
        summed over all chains. ``emissions`` is padded; ``lengths`` has each chain's words."""
        s, t, n = emissions.shape
        e = np.exp(emissions - emissions.max(axis=2, keepdims=True))
        move = np.exp(self.transitions - self.transitions.max())
        alive = np.arange(t)[None, :] < lengths[:, None]
        ahead, back, scale = np.empty_like(e), np.ones_like(e), np.ones((s, t))
        for i in range(t):
            a = e[:, 0] if i == 0 else (ahead[:, i - 1] @ move) * e[:, i]
            scale[:, i] = a.sum(axis=1)
            ahead[:, i] = a / scale[:, i, None]
        for i in range(t - 2, -1, -1):
            step = (back[:, i + 1] * e[:, i + 1]) @ move.T / scale[:, i + 1, None]
            back[:, i] = np.where(alive[:, i + 1, None], step, 1.0)
        p = ahead * back
        p /= p.sum(axis=2, keepdims=True)
        p *= alive[:, :, None]
        right = (e[:, 1:] * back[:, 1:] / scale[:, 1:, None]) * alive[:, 1:, None]
        return p, np.einsum("stj,stk->jk", ahead[:, :-1], right) * move

    def marginals(self, emissions: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Label probabilities (words, labels) of several texts, the rows of ``emissions`` in turn, each of so many
        ``words``, by forward-backward over whole texts. Texts are cut into links of CHAIN words that
        are walked side by side: first each link's product of steps, then the messages that enter
        links from either side, one link of every text at a time, then the words inside."""
        n = emissions.shape[1]
        links = -(-words // CHAIN)
        first = np.cumsum(links) - links  # the first link of each text
        owner = np.repeat(np.arange(len(words)), links)
        place = np.arange(len(emissions)) + np.repeat(first * CHAIN - (np.cumsum(words) - words), words)
        e = np.ones((len(owner) * CHAIN, n))
        e[place] = np.exp(emissions - emissions.max(axis=1, keepdims=True))
        e = e.reshape(len(owner), CHAIN, n)
        sizes = np.full(len(owner), CHAIN)
        sizes[first + links - 1] = words - (links - 1) * CHAIN
        alive = np.arange(CHAIN)[None, :] < sizes[:, None]
        move = np.exp(self.transitions - self.transitions.max())
        start, end = np.full((len(owner), n), 1.0 / n), np.full((len(owner), n), 1.0 / n)
        if (links > 1).any():
            through = np.broadcast_to(np.eye(n), (len(owner), n, n)).copy()
            for i in range(CHAIN):
                step = (through @ move) * e[:, i, None, :]
                step /= step.sum(axis=(1, 2), keepdims=True)
                through = np.where(alive[:, i, None, None], step, through)
            for j in range(1, links.max()):
                at = first[links > j] + j
                before = self._leaving(e[at - 1], move) if j == 1 else np.einsum("sj,sjk->sk", start[at - 1], through[at - 1])
                start[at] = before / before.sum(axis=1, keepdims=True)
            for j in range(links.max() - 1, 0, -1):
                at = first[links > j] + j  # messages go from link j to link j - 1
                after = np.einsum("sjk,sk->sj", through[at], end[at])
                end[at - 1] = after / after.sum(axis=1, keepdims=True)
        ahead, back = np.empty_like(e), np.empty_like(e)
        opens = np.zeros(len(owner), bool)
        opens[first] = True
        a = np.where(opens[:, None], 1.0, start @ move) * e[:, 0]
        for i in range(CHAIN):
            if i:
                a = (a @ move) * e[:, i]
            a = a / a.sum(axis=1, keepdims=True)
            ahead[:, i] = a
        # from the last word of a link on, the message is that of the next link
        b = end.copy()
        for i in range(CHAIN - 1, -1, -1):
            back[:, i] = b
            if i:
                step = (b * e[:, i]) @ move.T
                b = np.where(alive[:, i, None], step / step.sum(axis=1, keepdims=True), b)
        p = (ahead * back).reshape(-1, n)[place]
        return p / p.sum(axis=1, keepdims=True)

    @staticmethod
    def _leaving(e: np.ndarray, move: np.ndarray) -> np.ndarray:
        """The message that leaves full first links."""
        a = e[:, 0]
        for i in range(1, CHAIN):
            a = (a @ move) * e[:, i]
            a = a / a.sum(axis=1, keepdims=True)
        return a

    def label_masses(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed label probabilities of the words of each whole text (texts, labels), and their numbers. The texts are
        looked at together, so callers deal them out by _PIECE bytes; a longer one's features come in pieces."""
        rows, words = [], np.zeros(len(texts), np.int64)
        held, owners = [], []  # whole short texts whose features are computed at once

        def emit():
            if held:
                em, counts = self._several(held)
                rows.append(em)
                words[owners] += counts
                held.clear()
                owners.clear()

        for i, text in enumerate(texts):
            data = text.lower().encode("utf-8", "replace")
            if len(data) <= _PIECE:
                held.append(data)
                owners.append(i)
                continue
            emit()
            for piece in _pieces(data):
                em = self.emissions(piece)
                rows.append(em)
                words[i] += len(em)
        emit()
        em, mass = np.concatenate(rows) if rows else np.empty((0, len(self.labels))), np.zeros((len(texts), len(self.labels)))
        some = np.flatnonzero(words)
        if len(some):
            p = self.marginals(em, words[some])
            mass[some] = np.add.reduceat(p, np.cumsum(words[some]) - words[some], axis=0)
        return mass, words

    def _several(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The emissions of the words of ``texts`` and how many each has."""
        em, starts = self.emissions(b"  ".join(texts), True)  # features reach two bytes ahead
        at = np.cumsum([0] + [len(t) + 2 for t in texts])
        return em, np.diff(np.searchsorted(starts, at))


def _pieces(data: bytes) -> Iterator[bytes]:
    """A long text cut between words (a word longer than a piece is cut)."""
    at = 0
    while at < len(data):
        end = at + _PIECE
        if end < len(data):
            cut = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end))
            end = cut + 1 if cut > at else end
        yield data[at:end]
        at = end


def fit(texts: list[tuple[str, str]], labels: list[str], epochs: int = 3, rate: float = 0.3, seed: int = 5) -> Field:
    """Fits a field to (text, label) rows by adaptive gradient ascent on the log-likelihood. Runs
    of 16 words from all texts are dealt to chains at random, so labels also change inside a chain."""
    field, rng = Field(labels), np.random.default_rng(seed)
    runs: list[tuple[np.ndarray, int]] = []  # (features of each word, label)
    for text, label in texts:
        grams, first, word = word_features(text.lower().encode("utf-8", "replace"))
        if len(first):
            ends = np.append(first[1:], grams.shape[1])
            for i in range(0, len(first), 16):
                a, z = first[i], ends[min(i + 16, len(first)) - 1]
                sizes = (ends - first)[i : i + 16]
                owner = np.repeat(np.arange(len(sizes)), sizes)
                runs.append((np.concatenate([*grams[:, a:z], word[i : i + 16]]).astype(np.int32), np.concatenate([owner, owner, owner, np.arange(len(sizes))]).astype(np.int16), len(sizes), labels.index(label)))
    n, seen, seen_moves = len(labels), np.full((1 << _BITS, len(labels)), 1e-6, np.float32), np.full((len(labels),) * 2, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(runs))
        for i in range(0, len(order), 1024):
            picked = [runs[j] for j in order[i : i + 1024]]
            chains = [picked[j : j + CHAIN // 16] for j in range(0, len(picked), CHAIN // 16)]
            start, feats, owners, gold = 0, [], [], np.full((len(chains), CHAIN), -1)
            for c, chain in enumerate(chains):
                at = 0
                for f, o, size, label in chain:
                    feats.append(f)
                    owners.append(o.astype(np.int64) + c * CHAIN + at)
                    gold[c, at : at + size] = label
                    at += size
            feats, owners = np.concatenate(feats), np.concatenate(owners)
            em = np.stack([np.bincount(owners, field.weights[feats, k], len(chains) * CHAIN) for k in range(n)], axis=1).reshape(len(chains), CHAIN, n)
            lengths = (gold >= 0).sum(axis=1)
            p, moves = field.posteriors(em, lengths)
            want = (gold[:, :, None] == np.arange(n)).astype(float)
            error = (want - p).reshape(-1, n)
            touched, inverse = np.unique(feats, return_inverse=True)
            g = np.stack([np.bincount(inverse, error[owners, k], len(touched)) for k in range(n)], axis=1) / len(chains)
            seen[touched] += g**2
            field.weights[touched] += rate * g / np.sqrt(seen[touched])
            pairs = np.zeros((n, n))
            ok = gold[:, 1:] >= 0
            np.add.at(pairs, (gold[:, :-1][ok], gold[:, 1:][ok]), 1)
            g = (pairs - moves) / len(chains)
            seen_moves += g**2
            field.transitions += rate * g / np.sqrt(seen_moves)
    return field


def train_field(docs: DataFrame, docs_each: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> Field | None:
    """Fits a field on ``docs`` (doc_id, text, lang): for every language up to ``docs_each`` distinct rows
    picked by hashes of their id and text - a bounded sample, bounded before texts are exchanged. Of texts longer than
    ``chars`` characters each piece of so many is a row. Beyond FULL_LANGUAGES languages ``docs_each`` shrinks, down to
    one; the field takes 1 MB a language (twice that while it is fitted). No language: no field."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("lang", "doc_id", "text", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.lit(0), F.length("text") - 1) / chars).cast("int"))).alias("_p"))
    rows = rows.select("lang", "doc_id", F.col("text").substr(F.col("_p") * chars + 1, F.lit(chars)).alias("text"), "_p")
    key = F.concat_ws("\x00", F.col("doc_id").cast("string"), F.col("_p").cast("string"), "text")
    rows = rows.select("lang", "text", key.alias("_key"), F.xxhash64(key).alias("_h"))
    # equal rows share a hash, so distinct ones are counted
    counts = written(rows.select("lang", "_h").distinct().groupBy("lang").agg(F.count("*").alias("n")), "languages")
    docs_each = max(1, min(docs_each, FULL_LANGUAGES * docs_each // max(1, counts.count())))
    # rows of small hash, about twice as many as wanted, so that the ranking below sees few; with 40 more
    # a language comes short with odds under 1e-16, however few are wanted
    share = F.least(F.lit(1.0), F.lit(2.0 * docs_each + 40) / F.col("n"))
    rows = rows.join(F.broadcast(counts), "lang").where(F.shiftrightunsigned("_h", 11) <= share * float(1 << 53))
    rows = rows.groupBy("lang", "_h", F.md5(F.col("_key").cast("binary")).alias("_o")).agg(F.first("text").alias("text"))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_o"))).where(F.col("_r") <= docs_each).select("lang", "text", "_r")
    sample = sorted(rows.collect(), key=lambda r: (r["lang"], r["_r"]))  # docs_each a language
    drop(counts)
    labels = sorted({r["lang"] for r in sample})
    return fit([(r["text"], r["lang"]) for r in sample], labels) if labels else None


def has_letter(text) -> F.Column:
    return F.coalesce(text, F.lit("")).rlike(r"\p{L}")


def identify(docs: DataFrame, field: Field | None) -> DataFrame:
    """Adds lang_pred and score to ``docs`` (columns of these names are replaced): the label with
    the largest share of the words' summed probabilities, and this share. ``und`` and 0 for a
    null text, one without letters, or no field. Rows are scored each for itself, repeated ones alike; very long texts are
    one chain like any other; an empty table gives no rows."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names = docs.columns
    at = names.index("text")
    letter = fresh(docs, "letters")
    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), letter: F.lit(True)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            texts, letters = batch.column(at), batch.column(batch.num_columns - 1).to_pylist()
            langs, scores = ["und"] * len(letters), [0.0] * len(letters)
            for group in _dealt(texts, letters if field else []):
                mass, n = field.label_masses([texts[i].as_py() for i in group])
                best = mass.argmax(axis=1)
                for i, b, m, words in zip(group, best.tolist(), mass.max(axis=1).tolist(), n.tolist()):
                    if words:
                        langs[i], scores[i] = field.labels[b], min(1.0, m / words)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), batch.columns[-1]], names=[*names, "lang_pred", "score", letter])

    return docs.withColumn(letter, has_letter(F.col("text"))).mapInArrow(run, schema).drop(letter)


def _dealt(texts, letters: list[bool]) -> Iterator[list[int]]:
    """The places of texts with letters, in groups of about _PIECE bytes."""
    group, size = [], 0
    for i, ok in enumerate(letters):
        if ok:
            group.append(i)
            size += len(texts[i].as_buffer())
            if size >= _PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


def label_words(field: Field, text: str) -> list[tuple[str, float]]:
    """(label, probability) of each word of a text, words as word_features sees them."""
    em = field.emissions(text.lower().encode("utf-8", "replace"))
    if not len(em):
        return []
    p = field.marginals(em, np.array([len(em)]))
    return [(field.labels[i], float(p[j, i])) for j, i in enumerate(p.argmax(axis=1))]


def op5(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(crc_mod("doc_id", 4), F.lit(0)) == 2)
    field = train_field(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), field).select("doc_id", "held_out", "lang_pred", "score")
