"""Language identification by character models with interpolated Kneser-Ney smoothing.

One model per language over three-letter windows of lower-cased text, in the language's
own most frequent letters; its other letters share a symbol in the windows and are told
apart by a sorted array of code points with their probabilities, so scripts do not
compete for symbols and large alphabets do not blur.  A run of anything that is no
letter is one border symbol.  A model has a fixed greatest size (``SYMBOLS ** 3`` windows
and the letters of Unicode) and may be collected and broadcast.  The counts come from a bounded sample of labelled rows (``rows_per_language``, taken
by a hash of the row's key); every text is scored whole.  A model is kept as
sorted arrays of n-gram codes with log probabilities and back-off weights.

A text goes to the language of the lowest cross-entropy per symbol, ties to the
smaller name.  Rejection is calibrated on the training texts: with the mean
cross-entropy of a language, the spread between its texts and the spread of single
symbols, a text is rejected if its cross-entropy lies ``tolerance`` deviations above
its language's mean and also nearer to that of random symbols than to the mean; so is
a text that is null or has no letter.

Defined results: rows with null text or null language are not learned from; a
prediction for null, empty or letterless text is ``und`` with score 0, not
accepted; with no training rows at all, every prediction is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import give_back, slices

SYMBOLS = 64  # 0 border, 1 any other letter, then a language's own most frequent letters
ROWS_PER_LANGUAGE = 2_000
SLICE = 1 << 18  # bytes of text that are looked at together
UNKNOWN = "und"
RESULT = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("cross_entropy", T.DoubleType()), T.StructField("accepted", T.BooleanType()),
])


@lru_cache(maxsize=1)
def alphabet() -> np.ndarray:
    """By code point: the lower case of a letter, 0 for what is none."""
    out = np.zeros(0x110000, np.int32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            out[point] = ord(c.lower()[0])
    return out


@dataclass
class Others:
    """The letters of a language that have no symbol of their own: a sorted array of code
    points with log probabilities, and the one of any letter that was never seen.  Symbol
    1 is one of them each time, so no language explains letters more cheaply than one that
    has learned them."""

    points: np.ndarray
    logp: np.ndarray
    unseen: float

    @classmethod
    def of(cls, points: list[int], counts: list[int]) -> "Others":
        order = np.argsort(points)
        points, n = np.array(points, np.int64)[order], np.array(counts, float)[order]
        letters = len(np.unique(alphabet())) - SYMBOLS
        if not len(points):
            return cls(points, n, -float(np.log(letters)))
        d = _discount(n)
        rest = d * len(n) / n.sum()
        return cls(points, np.log((n - d) / n.sum() + rest / letters), float(np.log(rest / letters)))

    def of_points(self, points: np.ndarray) -> np.ndarray:
        if not len(self.points):
            return np.full(len(points), self.unseen)
        lower = alphabet()[points]
        at = np.minimum(np.searchsorted(self.points, lower), len(self.points) - 1)
        return np.where(self.points[at] == lower, self.logp[at], self.unseen)


def letter_table(letters: str) -> np.ndarray:
    """Symbol of every code point."""
    lower = alphabet()
    known = np.array(sorted(map(ord, letters)), np.int32)
    symbol = {ord(c): i + 2 for i, c in enumerate(letters)}
    out = (lower > 0).astype(np.uint8)
    if len(known):
        at = np.minimum(np.searchsorted(known, lower), len(known) - 1)
        out = np.where(known[at] == lower, np.array([symbol[k] for k in known.tolist()], np.uint8)[at], out)
    return out


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and where each text ends among them."""
    own = texts.to_pylist()
    points = np.frombuffer("".join(x or "" for x in own).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.cumsum([len(x or "") for x in own], dtype=np.int64)


@dataclass
class Windows:
    """Where the windows of three symbols of some texts stand.  Each text is set between
    two borders; runs of borders count once.  That is the same for all languages."""

    points: np.ndarray   # code points, -1 for a border
    owner: np.ndarray    # the text of each
    started: np.ndarray  # a window ends here

    @classmethod
    def of(cls, texts: pa.Array) -> "Windows":
        points, ends = code_points(texts)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        n = len(points) + 2 * len(ends)
        spots, owner = np.full(n, -1, np.int64), np.repeat(np.arange(len(ends)), ends - starts + 2)
        inner = np.ones(n, bool)
        first = starts + 2 * np.arange(len(ends))
        inner[first] = inner[ends + 2 * np.arange(len(ends)) + 1] = False
        spots[inner] = np.where(alphabet()[points] > 0, points.astype(np.int64), -1)
        keep = spots >= 0
        keep[1:] |= spots[:-1] >= 0
        keep[first] = True
        spots, owner = spots[keep], owner[keep]
        started = np.ones(len(spots), bool)
        started[1:] = owner[1:] == owner[:-1]
        started[:1] = False
        return cls(spots, owner, started)

    def codes(self, table: np.ndarray) -> np.ndarray:
        """Code of the window that ends at every symbol, in one language's symbols."""
        own = np.where(self.points >= 0, table[self.points], 0).astype(np.int32)
        before, earlier = np.zeros((2, len(own)), np.int32)
        before[1:] = np.where(self.owner[1:] == self.owner[:-1], own[:-1], 0)
        earlier[2:] = np.where(self.owner[2:] == self.owner[:-2], own[:-2], 0)
        return ((earlier * SYMBOLS + before) * SYMBOLS + own)[self.started]

    def owners(self) -> np.ndarray:
        return self.owner[self.started]


@dataclass
class Model:
    """Sorted n-gram codes of one language with what interpolation needs."""

    seen: np.ndarray          # sorted codes of three symbols
    seen_logp: np.ndarray
    pairs: np.ndarray         # sorted codes of the last two symbols
    pair_logp: np.ndarray
    contexts: np.ndarray      # sorted codes of the first two symbols
    context_weight: np.ndarray  # log weight of the lower order
    single_logp: np.ndarray   # by symbol, all of them
    mid_contexts: np.ndarray
    mid_weight: np.ndarray

    def logp(self, codes: np.ndarray) -> np.ndarray:
        """Natural-log probability of the last symbol of every code."""
        def find(keys, values, wanted, otherwise):
            at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            return np.where(keys[at] == wanted, values[at], otherwise) if len(keys) else np.broadcast_to(otherwise, wanted.shape)

        pair, last, middle = codes % SYMBOLS**2, codes % SYMBOLS, codes // SYMBOLS % SYMBOLS
        low = find(self.mid_contexts, self.mid_weight, middle, 0.0) + self.single_logp[last]
        low = find(self.pairs, self.pair_logp, pair, low)
        low = find(self.contexts, self.context_weight, codes // SYMBOLS, 0.0) + low
        return find(self.seen, self.seen_logp, codes, low)


def _discount(counts: np.ndarray) -> float:
    once, twice = np.count_nonzero(counts == 1), np.count_nonzero(counts == 2)
    return once / (once + 2 * twice) if once and twice else 0.5


def fit_model(codes: np.ndarray, counts: np.ndarray) -> Model:
    """Interpolated Kneser-Ney over three symbols: lower orders use the number
    of different left neighbours, the lowest is mixed with a uniform one."""
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order].astype(float)
    pairs, left = np.unique(codes % SYMBOLS**2, return_counts=True)
    singles, left_pairs = np.unique(pairs % SYMBOLS, return_counts=True)

    def level(n, context, lower):
        """log probabilities of n-grams and the log weight each context leaves."""
        d = _discount(n)
        keys, at = np.unique(context, return_inverse=True)
        total, kinds = np.bincount(at, n), np.bincount(at)
        weight = d * kinds / total
        return np.log((n - d) / total[at] + weight[at] * np.exp(lower)), keys, np.log(weight)

    d = _discount(left_pairs)
    single = np.full(SYMBOLS, d * len(singles) / left_pairs.sum() / SYMBOLS)
    single[singles] += (left_pairs - d) / left_pairs.sum()
    single_logp = np.log(single)
    pair_logp, mid_contexts, mid_weight = level(left.astype(float), pairs // SYMBOLS, single_logp[pairs % SYMBOLS])
    low = pair_logp[np.searchsorted(pairs, codes % SYMBOLS**2)]
    seen_logp, contexts, context_weight = level(counts, codes // SYMBOLS, low)
    return Model(codes, seen_logp, pairs, pair_logp, contexts, context_weight, single_logp, mid_contexts, mid_weight)


class Classifier:
    """All languages' models, each with its own letters, and the rejection limits."""

    def __init__(self, letters: dict[str, str], others: dict[str, Others], models: dict[str, Model], limits: dict[str, tuple[float, float, float]], tolerance: float):
        self.letters, self.others, self.models, self.limits, self.tolerance = letters, others, models, limits, tolerance

    def ready(self) -> None:
        """Resolve every possible window once: SYMBOLS ** 3 values a language."""
        if not hasattr(self, "logp"):
            self.names = sorted(self.models)
            self.tables = [letter_table(self.letters[name]) for name in self.names]
            every = np.arange(SYMBOLS**3)
            self.logp = [self.models[name].logp(every).astype(np.float32) for name in self.names]

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("letters", "others", "models", "limits", "tolerance")}

    def log_probabilities(self, i: int, own: "Windows") -> np.ndarray:
        """Of the last symbol of every window, in the i-th language."""
        codes = own.codes(self.tables[i])
        out = self.logp[i][codes].astype(float)
        other = np.flatnonzero(codes % SYMBOLS == 1)
        if len(other):
            out[other] += self.others[self.names[i]].of_points(own.points[own.started][other])
        return out

    def surprise(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy by language and text, number of symbols, has a letter."""
        self.ready()
        own = Windows.of(texts)
        owner = own.owners()
        n = np.bincount(owner, minlength=len(texts))
        letters = np.bincount(own.owner[own.points >= 0], minlength=len(texts)) > 0
        total = np.array([np.bincount(owner, self.log_probabilities(i, own), minlength=len(texts)) for i in range(len(self.names))]).reshape(len(self.names), len(texts))
        return -total / np.maximum(n, 1), n, letters

    def classify(self, texts: pa.Array) -> pa.StructArray:
        h, n, letters = self.surprise(texts)
        rows = np.arange(len(texts))
        if not len(h):
            letters = np.zeros(len(texts), bool)
            h = np.zeros((1, len(texts)))
        best = np.argmin(h, axis=0)
        low = h[best, rows]
        score = 1 / np.exp(-np.minimum((h - low) * n, 700)).sum(axis=0)
        names = np.array(self.names or [UNKNOWN], object)
        limit = np.array([self.limits[x] for x in self.names] or [(0.0, 0.0, 0.0)])
        mean = limit[best, 0]
        most = mean + np.maximum(self.tolerance * np.sqrt(limit[best, 1] + limit[best, 2] / np.maximum(n, 1)), (np.log(SYMBOLS) - mean) / 2)
        return pa.StructArray.from_arrays([
            pa.array(np.where(letters, names[best], UNKNOWN), pa.string()), pa.array(np.where(letters, score, 0.0)),
            pa.array(np.where(letters, low, 0.0)), pa.array(letters & (low <= most))], fields=list(RESULT_ARROW))


RESULT_ARROW = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("accepted", pa.bool_())])


def _batches(fn):
    """A mapInArrow function that hands ``fn`` slices of bounded text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text"), SLICE):
                yield from fn(batch.slice(*part))
    return run


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
        rows_per_language: int = ROWS_PER_LANGUAGE, tolerance: float = 8.0) -> Classifier:
    """Learn from about ``rows_per_language`` rows of each language, the ones
    with the smallest hashes of their key.  What reaches the driver is bounded
    by the symbols: counts of letters and of windows by language."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    sizes = {r[lang]: r["n"] for r in rows.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Classifier({}, {}, {}, {}, tolerance)
    share = F.lit(0)
    for name, n in sizes.items():
        share = F.when(F.col(lang) == name, F.lit(min(1_000_000, int(1_000_000 * rows_per_language / n) + 1))).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < share).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def letters_of(batch):
        langs = np.array(batch.column("lang").to_pylist(), object)
        for name in sorted(set(langs)):
            points, _ = code_points(batch.column("text").filter(pa.array(langs == name)))
            lower = alphabet()[points]
            found, n = np.unique(lower[lower > 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array([chr(p) for p in found], pa.string()), pa.array(n.astype(np.int64))], ["lang", "c", "n"])

    # the letters of each language by themselves: scripts do not compete for symbols
    counted = sample.mapInArrow(_batches(letters_of), "lang string, c string, n bigint").groupBy("lang", "c").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "c"))
    ranked = counted.withColumn("place", place).collect()  # a row for each letter of a language: Unicode bounds them
    letters = {name: "".join(sorted(r["c"] for r in ranked if r["lang"] == name and r["place"] <= SYMBOLS - 2)) for name in sizes}
    rare = {name: [(ord(r["c"]), r["n"]) for r in ranked if r["lang"] == name and r["place"] > SYMBOLS - 2] for name in sizes}
    others = {name: Others.of([c for c, _ in x], [n for _, n in x]) for name, x in rare.items()}

    def windows_of(batch):
        langs = np.array(batch.column("lang").to_pylist(), object)
        for name in sorted(set(langs)):
            codes = Windows.of(batch.column("text").filter(pa.array(langs == name))).codes(letter_table(letters[name]))
            n = np.bincount(codes, minlength=SYMBOLS**3)
            found = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int32)), pa.array(n[found].astype(np.int64))], ["lang", "code", "n"])

    grams = sample.mapInArrow(_batches(windows_of), "lang string, code int, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    langs, codes, counts = (grams.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    models = {name: fit_model(codes[langs == name].astype(np.int64), counts[langs == name]) for name in sorted(set(langs))}
    draft = Classifier(letters, others, models, {}, tolerance)

    def spread_of(batch):
        draft.ready()
        langs = np.array(batch.column("lang").to_pylist(), object)
        for i, name in enumerate(draft.names):
            texts = batch.column("text").filter(pa.array(langs == name))
            own = Windows.of(texts)
            p, owner = -draft.log_probabilities(i, own), own.owners()
            n = np.bincount(owner, minlength=len(texts))
            h = (np.bincount(owner, p, minlength=len(texts)) / np.maximum(n, 1))[n > 1]
            yield pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([float(x)]) for x in (len(h), h.sum(), (h * h).sum(), len(p), p.sum(), (p * p).sum()))], ["lang", "t", "h", "hh", "n", "p", "pp"])

    sums = sample.mapInArrow(_batches(spread_of), "lang string, t double, h double, hh double, n double, p double, pp double").groupBy("lang").agg(*(F.sum(c).alias(c) for c in ("t", "h", "hh", "n", "p", "pp"))).collect()
    limits = {}
    for r in sums:
        mean = r["h"] / max(r["t"], 1)
        single = max(r["pp"] / max(r["n"], 1) - (r["p"] / max(r["n"], 1)) ** 2, 0.0)
        limits[r["lang"]] = (mean, max(r["hh"] / max(r["t"], 1) - mean**2, 0.0), single)
    return Classifier(letters, others, models, {name: limits.get(name, (0.0, 0.0, 0.0)) for name in models}, tolerance)


def predict(docs: DataFrame, classifier: Classifier, text: str = "text") -> Column:
    """Struct column lang, score, cross_entropy, accepted for a column of texts."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)  # at most SYMBOLS ** 3 entries a language

    @F.arrow_udf(RESULT)
    def classify(texts: pa.Array) -> pa.Array:
        own = shared.value
        found = [own.classify(texts.slice(*part)) for part in slices(texts, SLICE)]
        give_back()
        return pa.concat_arrays(found or [pa.array([], RESULT_ARROW)])

    return classify(F.col(text))
