"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans they miss.

The field scores whole spans (how many digits, whether they pass the check sum, the shape of groups, what stands beside them) and
chooses boundaries and kinds together by dynamic programming over spans of bounded length. It learns from spans of the
patterns in a bounded sample, from harder spellings of them, and from look-alikes.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh

#: The kinds, in the order that sorts spans.
KINDS = ("email", "ip", "card", "phone")
#: Sampled stretches a kind, and of those without a pattern; the field is fitted on them and their variants in the driver.
SAMPLE = 100
#: Tokens of the longest span that the field considers, and of the longest stretch that it is fitted on.
LONGEST, FITTED = 24, 40
#: Every span has one of these; RE2 finds texts without any at once.
_ANCHOR = r"[0-9@]|[\[(]at[\])]"

# --- patterns ----------------------------------------------------------------------------

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return not (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for c in digits[-2::-2])) % 10


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns in a text, each kind leftmost and non-overlapping. Linear: a match begins where
    its run of characters does, so no place is tried twice."""
    out, lo = [], 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        start = lo + len(text[lo:at].rstrip(_LOCAL))
        lo = at + 1  # what comes before an @ has none
        if start < at:
            out.append((0, start, m.end()))
            lo = m.end()
    for m in _IP.finditer(text):
        if all(len(p) <= 3 or len(p.lstrip("0")) <= 3 for p in m.groups()) and all(int(p) <= 255 for p in m.groups()):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# --- stretches, tokens and features of spans -----------------------------------------------

_CORE = r"[A-Za-z0-9._%+@()\[\]/-]"
#: Stretches that may hold spans: runs of such characters, and further runs after single spaces if they begin like numbers.
_STRETCH = re.compile(rf"(?<!{_CORE}){_CORE}++(?:\x20(?=[0-9+(\[]){_CORE}++)*+")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^A-Za-z0-9]")
_HAS = re.compile(_ANCHOR)


def stretches(text: str) -> list[tuple[int, str]]:
    return [(m.start(), m[0]) for m in _STRETCH.finditer(text) if _HAS.search(m[0])]


def _hot(x: np.ndarray, *edges: int) -> list[np.ndarray]:
    """One column for each interval of values, the first up to edges[0]."""
    at = np.searchsorted(np.array(edges), x)
    return [at == i for i in range(len(edges) + 1)]


class Tokens:
    """A stretch as tokens, with what counts of them its spans' features need as running sums."""

    def __init__(self, s: str):
        t = self.tokens = _TOKEN.findall(s)
        n = self.n = len(t)
        first = np.array([x[0] for x in t])
        size = self.size = np.array([len(x) for x in t])
        self.digit, self.letter = np.array([c.isdigit() for c in first], bool), np.array([c.isalpha() for c in first], bool)
        at = first == "@"
        for i in range(1, n - 1):
            at[i] |= t[i] == "at" and t[i - 1] in "[(" and t[i + 1] in "])"
        run = lambda x: np.concatenate(([0], np.cumsum(x)))
        small = np.array([d and len(x) <= 3 and int(x) <= 255 for x, d in zip(t, self.digit)], bool)
        kinds = {"digits": size * self.digit, "letters": size * self.letter, "at": at, "dot": first == ".", "space": first == " ", "dash": first == "-", "open": first == "(", "close": first == ")", "plus": first == "+",
                 "groups": self.digit, "small": small, "four": self.digit & (size == 4), "chars": size}
        kinds["other"] = ~(self.digit | self.letter | at | np.isin(first, list(". -()+")))
        self.run = {k: run(v) for k, v in kinds.items()}
        self.first = first
        self.zeros = np.array([x.startswith("00") for x in t], bool)
        self.last_at = np.maximum.accumulate(np.concatenate(([-1], np.where(at, np.arange(n), -1))))
        # Luhn sums over the stretch's digits, with those at even and at odd places doubled
        d = np.array([int(c) for x, is_d in zip(t, self.digit) if is_d for c in x], np.int64)
        twice = np.array([0, 2, 4, 6, 8, 1, 3, 5, 7, 9])[d] if len(d) else d
        place = np.arange(len(d)) % 2
        self.luhn = [run(np.where(place == p, twice, d)) for p in (0, 1)]

    def spans(self, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) tokens of the spans that may be personal data and end in (lo, hi]."""
        hi = self.n if hi is None else hi
        end = np.arange(lo + 1, hi + 1)
        end = end[(self.digit | self.letter)[end - 1]]
        e = np.repeat(end, LONGEST)
        s = e - np.tile(np.arange(1, LONGEST + 1), len(end))
        e, s = e[s >= 0], s[s >= 0]
        c = lambda k: self.run[k][e] - self.run[k][s]
        starts = self.digit | self.letter | (self.first == "+") | (self.first == "(")
        at, letters = c("at") > 0, c("letters") > 0
        ok = starts[s] & ((c("digits") > 0) | at) & (at | ~self.letter[s]) & (at | ~letters | (c("space") == 0)) & (c("chars") <= 128)
        return s[ok], e[ok]

    def features(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        c = {k: v[e] - v[s] for k, v in self.run.items()}
        d = c["digits"]
        a, b = self.run["digits"][s], self.run["digits"][e]
        sums = np.where(b % 2 == 0, self.luhn[0][b] - self.luhn[0][a], self.luhn[1][b] - self.luhn[1][a])  # the last digit, at place b - 1, is not doubled
        card = (d >= 13) & (d <= 19)
        plain = (c["letters"] == 0) & (c["other"] == 0) & (c["at"] == 0)
        small = c["small"] == c["groups"]
        dotted = plain & (c["groups"] == 4) & (c["dot"] == 3) & (e - s == 7)
        at = self.last_at[e]
        host = (c["at"] == 1) & (at >= s) & (self.run["dot"][e] - self.run["dot"][np.maximum(at, 0)] > 0) & self.letter[e - 1] & (self.size[e - 1] >= 2) & (at > s)
        host &= (self.run["space"][e] - self.run["space"][np.maximum(at, 0)]) == 0
        side = lambda i, edge: np.where(edge, 0, np.where(self.first[i] == " ", 1, np.where((self.digit | self.letter)[i], 2, 3)))
        before = side(np.maximum(s - 1, 0), s == 0)
        after = side(np.minimum(e, self.n - 1), e == self.n)
        numbers = plain & (d >= 7) & (d <= 15)
        big = np.where(c["groups"] > 0, d / np.maximum(c["groups"], 1), 0)
        cols = [
            np.ones(len(s), bool), *_hot(d, 0, 3, 6, 8, 10, 12, 15, 16, 19), card & (sums % 10 == 0), card & (sums % 10 > 0), *_hot(c["at"], 0, 1), *_hot(c["dot"], 0, 1, 2, 3), c["letters"] > 0, c["other"] > 0,
            self.first[s] == "+", self.first[s] == "(", (c["plus"] > 0) & (self.first[s] != "+"), (c["open"] > 0) & (c["open"] == c["close"]), c["open"] != c["close"], *_hot(c["space"], 0, 3), *_hot(c["dash"], 0, 3),
            *_hot(c["groups"], 0, 1, 2, 3, 4), small & (c["groups"] > 0), dotted & small, dotted & ~small, host, self.zeros[s], c["four"] == c["groups"], *_hot(big, 2, 3, 4, 8),
            *(before == i for i in range(4)), *(after == i for i in range(4)), numbers & (c["groups"] >= 3) & (self.digit[s] | (self.first[s] == "(")), numbers & (self.first[s] == "+"), card & (c["dot"] > 0) & (sums % 10 == 0),
            (c["at"] == 0) & (c["letters"] > 0), plain & (d >= 9) & (d <= 15) & self.zeros[s],
        ]
        return np.stack(cols, 1)


# --- the field ----------------------------------------------------------------------------


class SemiField:
    """Weights of span features by kind, and of what kind follows what (0: no personal data). Tokens outside spans are
    spans of one token that score 0."""

    def __init__(self, weights: np.ndarray, follows: np.ndarray):
        self.weights, self.follows = weights, follows

    def best(self, s: str) -> list[tuple[int, int, int]]:
        """(kind, start, end) of the best segmentation of a stretch. Scores are made for some thousand tokens at a time,
        so a stretch of any length takes bounded memory besides its tokens."""
        t = Tokens(s)
        n, k = t.n, len(KINDS)
        m = np.full((n + 1, k + 1), -np.inf)  # the best that ends at a token, by kind
        into = np.full((n + 1, k + 1), -np.inf)  # the best before a span of each kind that begins at a token
        m[0, 0], into[0] = 0.0, self.follows[0]
        back = np.zeros((n + 1, k + 1), np.int32)
        for lo in range(0, n, 4096):
            hi = min(n, lo + 4096)
            a, e = t.spans(lo, hi)
            order = np.argsort(e, kind="stable")
            a, e = a[order], e[order]
            score = t.features(a, e) @ self.weights if len(a) else np.empty((0, k))
            edge = np.searchsorted(e, np.arange(lo + 1, hi + 2))
            for j in range(lo + 1, hi + 1):
                m[j, 0], back[j, 0] = into[j - 1, 0], j - 1
                i0, i1 = edge[j - lo - 1], edge[j - lo]
                if i1 > i0:
                    x = into[a[i0:i1], 1:] + score[i0:i1]
                    w = x.argmax(0)
                    m[j, 1:], back[j, 1:] = x[w, np.arange(k)], a[i0:i1][w]
                into[j] = (m[j][:, None] + self.follows).max(0)
        out, j, y = [], n, int(m[n].argmax())
        place = t.run["chars"]
        while j:
            i = int(back[j, y])
            if y:
                out.append((y - 1, int(place[i]), int(place[j])))
            y = int((m[i] + self.follows[:, y]).argmax())
            j = i
        return out[::-1]


def _lse(x: np.ndarray, axis) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.squeeze(np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top, axis)


class Lot:
    """Labelled stretches side by side: the likelihood of their segmentations and its gradient by the semi-Markov
    forward-backward algorithm, all stretches a step at a time."""

    def __init__(self, cases: list[tuple[str, list[tuple[int, int, int]]]]):
        self.k, rows, phi, gold, sizes = len(KINDS), [], [], [], []
        self.gold_follows = np.zeros((self.k + 1, self.k + 1))
        for s, spans in cases:
            t = Tokens(s)
            place = {int(p): i for i, p in enumerate(t.run["chars"])}
            if t.n > FITTED or any(x not in place or y not in place for _, x, y in spans):
                continue
            want = {(place[x], place[y]): kind for kind, x, y in spans}
            a, e = t.spans()
            if not set(want) <= set(zip(a.tolist(), e.tolist())):
                continue
            b = len(sizes)
            rows.append(np.stack([np.full(len(a), b), e, e - a], 1))
            phi.append(t.features(a, e))
            g = np.zeros((len(a), self.k), bool)
            for i, span in enumerate(zip(a.tolist(), e.tolist())):
                if span in want:
                    g[i, want[span]] = True
            gold.append(g)
            sizes.append(t.n)
            j = kind = 0
            starts = {x: (y, w + 1) for (x, y), w in want.items()}
            while j < t.n:
                to, now = starts.get(j, (j + 1, 0))
                self.gold_follows[kind, now] += 1
                j, kind = to, now
        self.sizes = np.array(sizes)
        if sizes:
            self.rows, self.phi, self.gold = np.concatenate(rows), np.concatenate(phi).astype(np.float64), np.concatenate(gold).astype(np.float64)

    def likelihood(self, weights: np.ndarray, follows: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        n, k, b = int(self.sizes.max()), self.k, len(self.sizes)
        most = min(n, LONGEST)
        score = np.full((b, n + 1, most + 1, k + 1), -np.inf)
        score[:, 1:, 1, 0] = 0.0
        r = self.rows
        score[r[:, 0], r[:, 1], r[:, 2], 1:] = self.phi @ weights
        ahead = np.full((b, n + 1, k + 1), -np.inf)  # sums over segmentations up to a token, by last kind
        into = np.full((b, n + 1, k + 1), -np.inf)
        ahead[:, 0, 0], into[:, 0] = 0.0, follows[0]
        for j in range(1, n + 1):
            d = min(j, most)
            ahead[:, j] = _lse(into[:, j - d : j][:, ::-1] + score[:, j, 1 : d + 1], 1)
            into[:, j] = _lse(ahead[:, j][:, :, None] + follows, 1)
        behind = np.full((b, n + 1, k + 1), -np.inf)  # sums after a token, by the kind that ends there
        behind[np.arange(b), self.sizes] = 0.0
        out = np.full((b, n + 1, k + 1), -np.inf)  # sums from a token on, by the kind that begins there
        for j in range(n - 1, -1, -1):
            d = min(n - j, most)
            steps = np.arange(1, d + 1)
            out[:, j] = _lse(score[:, j + steps, steps] + behind[:, j + steps], 1)
            more = _lse(follows[None] + out[:, j][:, None, :], 2)
            behind[:, j] = np.where((self.sizes == j)[:, None], 0.0, more)
        total = behind[:, 0, 0]
        own = into[r[:, 0], r[:, 1] - r[:, 2], 1:] + score[r[:, 0], r[:, 1], r[:, 2], 1:] + behind[r[:, 0], r[:, 1], 1:]
        p = np.exp(own - total[r[:, 0], None])
        with np.errstate(invalid="ignore"):
            pair = np.exp(ahead[:, :n, :, None] + follows + out[:, :n, None, :] - total[:, None, None, None])
        inside = np.arange(n)[None, :] < self.sizes[:, None]
        pair = np.where(inside[:, :, None, None] & np.isfinite(pair), pair, 0.0)
        value = (self.gold * (self.phi @ weights)).sum() + (self.gold_follows * follows).sum() - total.sum()
        return value, self.phi.T @ (self.gold - p), self.gold_follows - pair.sum((0, 1))


def variants(s: str, spans: list[tuple[int, int, int]], rng: random.Random) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Harder spellings of the only span of a stretch: numbers without plus, cards in groups, addresses with (at)."""
    if len(spans) != 1:
        return []
    kind, a, b = spans[0]
    one, out = s[a:b], []
    if kind == 0:
        out = [one.replace("@", x) for x in ("(at)", "[at]")]
    elif kind == 2:
        d = re.sub("[^0-9]", "", one)
        out = [x.join(d[i : i + 4] for i in range(0, len(d), 4)) for x in (" ", "-", ".")]
    elif kind == 3:
        out = [one[1:], "00" + one[1:], "00 " + one[1:], re.sub(r"[ ().-]+", rng.choice("- "), one[1:]), re.sub(r"^\+[0-9]+ (?=\()", "", one)]
    return [(s[:a] + x + s[b:], [(kind, a, a + len(x))]) for x in out if x[:1] != " "]


def look_alikes(n: int, rng: random.Random) -> list[str]:
    """Numbers that are no personal data: dates, versions, amounts, book numbers, failed check sums, parts beyond 255, codes."""
    i = rng.randint
    out = []
    for _ in range(n):
        card = "".join(rng.choice("0123456789") for _ in range(16))
        while _luhn(card):
            card = card[:-1] + rng.choice("0123456789")
        code = "".join(rng.choice("0123456789abcdef") for _ in range(i(8, 40)))
        out.append(rng.choice([
            f"{i(1900, 2099)}-{i(1, 12):02}-{i(1, 28):02}", f"{i(1, 28):02}.{i(1, 12):02}.{i(1900, 2099)}", f"v{i(0, 20)}.{i(0, 20)}.{i(0, 99)}", f"{i(0, 9)}.{i(0, 9)}.", f"{i(1, 999)}.{i(0, 99):02}", f"{i(1900, 2099)}-{i(1900, 2099)}",
            f"{i(1, 9)}.{i(0, 9)}.{i(256, 99999)}.{i(256, 9999)}", f"{i(256, 999)}.{i(256, 999)}.{i(0, 255)}.{i(0, 255)}", f"978-{i(0, 9)}-{i(10, 99)}-{i(100000, 999999)}-{i(0, 9)}", f"{i(1, 12)}.{i(0, 9)}.{i(1000, 99999)}.{i(0, 999)}", card, f"{card[:4]} {card[4:8]} {card[8:12]} {card[12:]}", f"{i(1, 10**8)}", code, f"{code}-{i(1, 9999)}", f"{i(1, 99)}/{i(1, 99)}", f"AB-{i(100, 9999)}",
            f"{i(1, 9)} {i(10, 999)}", f"({i(1, 99)})", f"{i(10, 99)}%", f"@{code[:6]}", f"page {i(1, 999)}", f"{i(1, 9)}-{i(1, 9)}",
        ]))
    return out


def fit(cases: list[tuple[str, list[tuple[int, int, int]]]], steps: int = 60, seed: int = 7) -> SemiField | None:
    """A field fitted on labelled stretches, their variants and as many look-alikes; None where no stretch has a span."""
    rng = random.Random(seed)
    some = sorted({(s, tuple(sorted(x))) for s, x in cases})
    if not any(x for _, x in some):
        return None
    more = [v for s, x in some for v in variants(s, list(x), rng)]
    cases = [(s, list(x)) for s, x in some] + more + [(s, []) for s in look_alikes(max(600, 2 * len(some)), rng)]
    of_size: dict[int, list] = {}
    for case in cases:  # stretches of like sizes side by side
        of_size.setdefault((len(_TOKEN.findall(case[0])) + 3) // 4, []).append(case)
    lots = [x for x in map(Lot, of_size.values()) if len(x.sizes)]
    w, f = np.zeros((lots[0].phi.shape[1], len(KINDS))), np.zeros((len(KINDS) + 1,) * 2)
    state = [np.zeros_like(x) for x in (w, f, w, f)]
    for step in range(1, steps + 1):  # ascent with running means of the gradient and its square
        parts = [x.likelihood(w, f) for x in lots]
        for i, x in enumerate((w, f)):
            g = sum(p[i + 1] for p in parts) - 0.02 * x
            state[i] = 0.9 * state[i] + 0.1 * g
            state[i + 2] = 0.99 * state[i + 2] + 0.01 * g * g
            x += 0.2 * (state[i] / (1 - 0.9**step)) / (np.sqrt(state[i + 2] / (1 - 0.99**step)) + 1e-8)
    return SemiField(w, f)


# --- over documents -----------------------------------------------------------------------


def _disjoint(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of spans that overlap the longest."""
    out: list[tuple[int, int, int]] = []
    for k, a, b in sorted(spans, key=lambda x: (x[1] - x[2], x)):
        if all(b <= c or a >= d for _, c, d in out):
            out.append((k, a, b))
    return sorted(out, key=lambda x: x[1])


def labelled(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Up to ``sample`` stretches for each kind that the patterns find, and as many without one, the first by hash among
    the distinct ones of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str, str]] = []
            for text in batch.column(0).filter(pc.match_substring_regex(batch.column(0), _ANCHOR)):
                text = text.as_py()
                spans, i = sorted(pattern_spans(text), key=lambda x: x[1]), 0
                for at, s in stretches(text):
                    if len(s) > 256:
                        continue
                    while i < len(spans) and spans[i][1] < at:
                        i += 1
                    mine, j = [], i
                    while j < len(spans) and spans[j][1] < at + len(s):
                        k, a, b = spans[j]
                        mine.append((k, a - at, min(b - at, len(s))))
                        j += 1
                    mine = _disjoint(mine)
                    out.append((KINDS[mine[0][0]] if mine else "none", s, ",".join(f"{k}:{a}:{b}" for k, a, b in mine)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["kind", "s", "spans"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "kind string, s string, spans string")
    found = found.groupBy("kind", "s").agg(F.min("spans").alias("spans"))
    order = [F.xxhash64("s"), "s"]
    some = found.withColumn("_r", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).where(F.col("_r") <= sample)
    return [(r["s"], [tuple(map(int, x.split(":"))) for x in r["spans"].split(",") if x]) for r in some.orderBy("kind", "s").collect()]


def find_pii(docs: DataFrame, text_col: str = "text", field: SemiField | None = None) -> DataFrame:
    """Every row of ``docs``, its columns kept, with base_spans (those of the patterns) and spans (and those that the field adds
    where they touch none of them): arrays of struct<kind, start, end> by kind and start, in code points, kind an index
    of KINDS. Without ``field`` one is fitted on these texts; where they hold no pattern, none is added.

    A null or empty text has none; texts are scanned whole, however long; repeated rows are treated alike, an empty table
    gives no rows. Columns named base_spans or spans are replaced, all others stay."""
    docs = docs.drop("base_spans", "spans")
    field = field or fit(labelled(docs, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(field)
    row, text = fresh(docs, "row"), fresh(docs, "text")
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def arrays(lists: list[list[tuple[int, int, int]]]) -> pa.Array:
        flat = [x for one in lists for x in one]
        cols = [pa.array(c, pa.int32()) for c in (zip(*flat) if flat else ((), (), ()))]
        offsets = pa.array(np.cumsum([0] + [len(one) for one in lists]), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(cols, names=["kind", "start", "end"])).cast(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            base: list[list[tuple[int, int, int]]] = [[] for _ in range(len(batch))]
            every = list(base)
            may = pc.fill_null(pc.match_substring_regex(batch.column(1), _ANCHOR), False)
            for i in np.flatnonzero(may.to_numpy(zero_copy_only=False)):
                s = batch.column(1)[int(i)].as_py()
                base[i] = sorted(pattern_spans(s))
                every[i] = sorted(base[i] + added(s, base[i], field)) if field is not None else base[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), arrays(base), arrays(every)], names=["row", "base_spans", "spans"])

    spans = "array<struct<kind: int, start: int, end: int>>"
    one = docs.select(F.struct(*docs.columns).alias(row), F.col(text_col).alias(text))
    got = one.mapInArrow(run, f"row {one.schema[row].dataType.simpleString()}, base_spans {spans}, spans {spans}")
    return got.select(*[F.col("row")[c].alias(c) for c in docs.columns], "base_spans", "spans")


def added(text: str, base: list[tuple[int, int, int]], field: SemiField) -> list[tuple[int, int, int]]:
    """The field's spans that touch none of ``base``."""
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else []
    out = []
    for at, s in stretches(text):
        for k, a, b in field.best(s):
            a, b = a + at, b + at
            i = int(np.searchsorted(starts, b))  # spans that begin before this one ends
            if not i or reach[i - 1] <= a:
                out.append((k, a, b))
    return out


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12(spark, sf_dir):
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in KINDS], F.sha2(spans_text(F.col("base_spans")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
