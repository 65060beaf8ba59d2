"""Hierarchical Pitman-Yor language model, trained and applied by Spark.

Every previous word is a context restaurant; all share one parent, the restaurant of
single words, whose base is uniform over the vocabulary and one unknown word.  A word is
served in a context restaurant at ``t`` tables to ``c`` customers, and each table is a
customer of the parent.  A word's probability in a context is

    (c - d * t + (theta + d * T) * parent) / (theta + C)

with the context's customers C and tables T.  A context is the full 64-bit hash of the
previous word (at the start of a text, of its end), so there are as many as words.

* *Counts.*  Tasks count (word, context) in pieces of the training text; a range of word
  hashes owns a word with all its contexts.  Words frequent in a sample are split by
  context into ``PARTS`` words of their own, so no word is a hot group.
* *Contexts.*  The range that owns a word also owns it as a context: C is the word's own
  count, and T is C less what customers and tables of its pairs differ by.  Only pairs
  of two or more customers differ, or ask for T to be seated; they alone take part in
  the sweeps and send that difference, once for each context of a range, to the
  context's owner, who answers with T.  Sums of frequent words are shared by all tasks.
* *Gibbs.*  In a sweep each pair draws the number of its tables from its conditional
  distribution given all other tables, its own taken out first (``reseat``: a block step
  by generalised Stirling numbers, equal to any number of one-by-one steps of that pair).
  What the others have is that of the sweep before, so ranges are swept side by side;
  each sweep's seating is a table, which goes when nothing reads it any more.
* *Scores.*  Blocks of documents ask the owners for their (word, context) pairs and get
  the customers and tables of pairs, words and contexts; the predictive probability is
  averaged over the sweeps after the first.

Counts of words are exact; discounts are estimated from counts of counts.

Defined results: null text is empty and has one token, the end; a row for which
``learn`` is null or false is not learned from; unknown words have the probability of
the parent's base; with nothing to learn from, every token has probability 1; rows are
not merged, other columns are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B

SWEEPS = 3
PASSES = 2  # over the documents to score
PARTS = 64
FREQUENT = 2_048
SAMPLE = 64  # one of so many documents shows which words are frequent
PIECE_TOKENS = 1_000_000  # counted at once by a task
BLOCK_BYTES = 6 << 20
USUAL = 65_535  # words of a sample that are sent as contexts by number; decides nothing but bytes
THETA = 1.0
_U = np.uint64
END = _U(0x5BD1E9955BD1E995)
PLACE = 32  # bits of a context's place in a pair
AVERAGED = range(min(2, SWEEPS), SWEEPS + 1)
FULL, LESS = -1, 100  # kinds of rows beside the sweeps' numbers
COUNTS = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("sizes", pa.binary()), ("contexts", pa.binary()), ("counts", pa.binary())])
ASKED = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("words", pa.binary()), ("sizes", pa.binary()), ("contexts", pa.binary())])
TOLD = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("pairs", pa.binary()), ("seen", pa.binary())])
ROWS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("sender", pa.int32()), *((c, pa.binary()) for c in ("words", "sizes", "contexts", "counts", "totals", "singles", "parent", "tables"))])
AS_ROWS = "bucket int, kind int, sender int, words binary, sizes binary, contexts binary, counts binary, totals binary, singles binary, parent binary, tables binary"
ANSWERS = pa.schema([("bucket", pa.int32()), ("sender", pa.int32()), ("tables", pa.binary())])
SCORES = "key bigint, learned boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def small(values: np.ndarray) -> bytes:
    """Integers below 2**32 as byte planes."""
    return B.planes(values, 4, "u4")


def from_small(data: bytes) -> np.ndarray:
    return B.from_planes(data, 4, low=True).view(np.int64)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every token, context of every token, document of every token."""
    words = B.Words(texts, lower=True)
    docs = len(words.range) - 1
    token = np.empty(len(words) + docs, _U)
    token[np.arange(len(words)) + words.doc] = words.hash
    ends = words.range[1:] + np.arange(docs)
    token[ends] = END
    before = np.empty(len(token), _U)
    before[1:] = token[:-1]
    before[words.range[:-1] + np.arange(docs)] = END
    doc = np.repeat(np.arange(docs), np.diff(words.range) + 1)
    return token, before, doc


@dataclass(frozen=True)
class Routing:
    """Owners of words, and the frequent words that are split."""

    buckets: int
    frequent: np.ndarray  # sorted hashes
    usual: np.ndarray     # sorted hashes
    parts: np.ndarray = field(init=False)  # sorted hashes of their parts
    part_of: np.ndarray = field(init=False)
    begins: np.ndarray = field(init=False)  # the upper 16 bits with which a frequent word begins
    by_number: np.ndarray = field(init=False)  # ``usual``, then 0 for the others

    def __post_init__(self):
        every = B.mix(self.frequent[:, None] + np.arange(1, PARTS + 1, dtype=_U)[None, :]).ravel()
        order = np.argsort(every)
        object.__setattr__(self, "parts", every[order])
        object.__setattr__(self, "part_of", np.repeat(np.arange(len(self.frequent)), PARTS)[order])
        begins = np.zeros(1 << 16, bool)
        begins[self.frequent >> _U(48)] = True
        object.__setattr__(self, "begins", begins)
        by_number = np.zeros(USUAL + 1, _U)
        by_number[: len(self.usual)] = self.usual
        object.__setattr__(self, "by_number", by_number)

    def hot(self, words: np.ndarray) -> np.ndarray:
        """Which words are frequent; most of the others have another beginning."""
        out = self.begins[words >> _U(48)]
        some = np.flatnonzero(out)
        out[some] = B.within(self.frequent, words[some])
        return out

    def split(self, token: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Tokens, with frequent words replaced by their parts."""
        hot = np.flatnonzero(self.hot(token))
        out = token.copy()
        out[hot] = B.mix(token[hot] + (B.mix(context[hot]) >> _U(58)) + _U(1))
        return out

    def numbers(self, contexts: np.ndarray) -> np.ndarray:
        """Of sorted contexts the number among the usual ones, or USUAL."""
        if not len(self.usual):
            return np.full(len(contexts), USUAL, np.uint16)
        at = np.searchsorted(self.usual, contexts)
        return np.where(self.usual[np.minimum(at, len(self.usual) - 1)] == contexts, at, USUAL).astype(np.uint16)

    def pack(self, contexts: np.ndarray, numbers: np.ndarray, place: np.ndarray) -> bytes:
        """The contexts at these places, usual ones by number, the others by hash."""
        number = numbers[place]
        return B.planes(number, 2, "u2") + B.planes(contexts[place[number == USUAL]])

    def unpack(self, data: bytes, n: int) -> np.ndarray:
        number = B.from_planes(data[: 2 * n], 2, low=True).view(np.int64)
        out = self.by_number[number]
        out[np.flatnonzero(number == USUAL)] = B.from_planes(data[2 * n :])
        return out

    def whole(self, words: np.ndarray) -> np.ndarray:
        """Place of the frequent word of which a word is a part, or -1."""
        out = np.full(len(words), -1)
        found = B.within(self.parts, words)
        out[found] = self.part_of[np.searchsorted(self.parts, words[found])]
        return out


def coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values in order, and the place of every value among them.  Values are
    sorted with their places in the lower bits, unless their upper bits do not tell
    them apart."""
    n = len(values)
    room = _U(max(n.bit_length(), 1))
    keys = values >> room
    keys <<= room
    keys |= np.arange(n, dtype=_U)
    keys.sort()
    upper = keys >> room
    alike = upper[1:] == upper[:-1]
    del upper
    keys &= (_U(1) << room) - _U(1)
    order = keys.view(np.int64)
    own = values[order]
    new = np.ones(n, bool)
    np.not_equal(own[1:], own[:-1], out=new[1:])
    if (new[1:] & alike).any():
        order = np.argsort(values)
        own = values[order]
        np.not_equal(own[1:], own[:-1], out=new[1:])
    place = np.empty(n, np.int64)
    place[order] = np.cumsum(new) - 1
    return own[new], place


def coded_pairs(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``coded`` for pairs of places."""
    word, context = split_pairs(pair)
    room, many = _U(max(len(pair).bit_length(), 1)), int(context.max(initial=0)) + 1
    if (int(word.max(initial=0)) + 1) * many >> (63 - int(room)):
        found, place = np.unique(pair, return_inverse=True)
        return found, place
    word *= many
    word += context
    del context
    keys = word.view(_U)
    keys <<= room
    keys |= np.arange(len(pair), dtype=_U)
    keys.sort()
    own, new = keys >> room, np.ones(len(pair), bool)
    np.not_equal(own[1:], own[:-1], out=new[1:])
    del own
    keys &= (_U(1) << room) - _U(1)
    order = keys.view(np.int64)
    place = np.empty(len(pair), np.int64)
    place[order] = np.cumsum(new) - 1
    return pair[order[new]], place


def pairs_of(word: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different words and contexts in order, then for every token its pair as
    word place << PLACE | context place."""
    (words, at), (contexts, of) = coded(word), coded(context)
    at <<= PLACE
    at |= of
    return words, contexts, at


def split_pairs(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return pairs >> PLACE, pairs & ((1 << PLACE) - 1)


def rows_by_bucket(words: np.ndarray, contexts: np.ndarray, pairs: np.ndarray, routing: Routing):
    """(bucket, words, pairs per word, contexts, from pair, to pair)."""
    at, numbers = np.searchsorted(pairs, np.arange(len(words) + 1) << PLACE), routing.numbers(contexts)
    for b, lo, hi in B.by_bucket(words, routing.buckets):
        x, y = at[lo], at[hi]
        yield b, B.planes(words[lo:hi]), small(np.diff(at[lo : hi + 1])), routing.pack(contexts, numbers, split_pairs(pairs[x:y])[1]), x, y


def read_pairs(routing: Routing, words: bytes, sizes: bytes, contexts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, and for each pair the place of its word and its context."""
    w, n = B.from_planes(words), from_small(sizes)
    return w, np.repeat(np.arange(len(w)), n), routing.unpack(contexts, int(n.sum()))


class Owned:
    """Training counts of a range of words."""

    def __init__(self, words: np.ndarray, word: np.ndarray, context: np.ndarray, count: np.ndarray):
        self.words, self.word, self.context, self.count = words, word, context, count

    @classmethod
    def merged(cls, routing: Routing, rows: list[tuple]) -> Owned:
        read = [read_pairs(routing, *r[:3]) for r in rows]
        words, contexts, pair = pairs_of(np.concatenate([w[i] for w, i, _ in read]), np.concatenate([c for *_, c in read]))
        count = np.concatenate([from_small(r[3]) for r in rows])
        order = np.argsort(pair)
        pair = pair[order]
        cuts = B.grouped(pair)[:-1]
        count = np.add.reduceat(count[order], cuts) if len(cuts) else count
        word, context = split_pairs(pair[cuts])
        return cls(words, word, contexts[context], count)

    @property
    def totals(self) -> np.ndarray:
        return np.bincount(self.word, self.count, len(self.words)).astype(np.int64)


@dataclass
class Seats:
    """What a sweep can change in a range: its words, but for those that occur once, and
    their pairs of two or more customers.  Pairs of one customer have one table."""

    words: np.ndarray
    totals: np.ndarray   # customers in all pairs of a word, also its customers as a context
    singles: np.ndarray  # pairs of one customer
    parent: np.ndarray   # tables in the parent
    word: np.ndarray     # of each pair
    context: np.ndarray
    count: np.ndarray
    tables: np.ndarray

    @classmethod
    def start(cls, own: Owned, routing: Routing) -> Seats:
        totals, many = own.totals, own.count > 1
        stays = (totals > 1) | (routing.whole(own.words) >= 0)
        place = np.cumsum(stays) - 1
        singles = np.bincount(own.word[~many], minlength=len(own.words))
        return cls(own.words[stays], totals[stays], singles[stays], np.ones(int(stays.sum()), np.int64),
                   place[own.word[many]], own.context[many], own.count[many], np.ones(int(many.sum()), np.int64))

    @classmethod
    def read(cls, row: dict, routing: Routing) -> Seats:
        words, word, context = read_pairs(routing, row["words"], row["sizes"], row["contexts"])
        return cls(words, *(from_small(row[c]) for c in ("totals", "singles", "parent")), word, context, from_small(row["counts"]), from_small(row["tables"]))

    def row(self, bucket: int, routing: Routing) -> tuple:
        """As the row of a start; a sweep changes only the last two of it."""
        sizes = np.bincount(self.word, minlength=len(self.words))
        contexts, place = coded(self.context)
        return (bucket, 0, bucket, B.planes(self.words), small(sizes), routing.pack(contexts, routing.numbers(contexts), place),
                *(small(x) for x in (self.count, self.totals, self.singles, self.parent, self.tables)))

    def row_after(self, before: dict, sweep: int) -> tuple:
        return (before["bucket"], sweep, before["bucket"], *(before[c] for c in ("words", "sizes", "contexts", "counts", "totals", "singles")),
                small(self.parent), small(self.tables))

    @property
    def of_word(self) -> np.ndarray:
        return self.singles + np.bincount(self.word, self.tables, len(self.words)).astype(np.int64)

    def less(self, routing: Routing) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts that are not frequent, the customers less tables they have here, and
        for each pair the place of its context in them (or the number of contexts)."""
        rare = np.flatnonzero(~routing.hot(self.context))
        keys, at = coded(self.context[rare])
        place = np.full(len(self.context), len(keys))
        place[rare] = at
        return keys, np.bincount(at, (self.count - self.tables)[rare], len(keys)).astype(np.int64), place


MOST_CUSTOMERS = 1_024   # of the table of Stirling numbers
MOST_TABLES = 2**32 - 1  # that ``small`` can hold; no draw is cut
LEAST = -37.0            # below the log of 2**-53
DROP = 45.0              # of log P(t), below which it is left


@lru_cache(maxsize=4)
def stirling_logs(discount: float) -> np.ndarray:
    """log S(c, t) of the generalised Stirling numbers: S(c + 1, t) = S(c, t - 1) +
    (c - discount t) S(c, t), for up to MOST_CUSTOMERS customers."""
    out = np.full((MOST_CUSTOMERS + 1, MOST_CUSTOMERS + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(1, MOST_CUSTOMERS + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(MOST_CUSTOMERS):
            stays = np.where(c > discount * t, np.log(np.maximum(c - discount * t, 1e-300)) + out[c, 1:], -np.inf)
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], stays)
    return out


def reseat(customers: np.ndarray, held: np.ndarray, word: np.ndarray, mass: np.ndarray, discount: float, random: np.random.Generator) -> np.ndarray:
    """A block Gibbs step: tables of each dish given everybody else, drawn from

        P(t) ~ S(c, t) * prod over i < t of (theta + d (T + i)) * (p D + i) / (D + i)

    with the other tables T in the restaurant (``held``), and in its parent the dish's
    probability p (``word``) and the mass D = theta + customers (``mass``), from all of
    which the dish's own tables have been taken out.  Up to MOST_CUSTOMERS customers all
    P(t) are summed; for more, ``seat_many`` draws from the same distribution."""
    tables = np.minimum(customers, 1).astype(np.int64)
    logs = stirling_logs(discount)
    wide = 2
    while wide // 2 < MOST_CUSTOMERS:
        here = np.flatnonzero((customers > wide // 2 if wide > 2 else customers > 1) & (customers <= wide))
        for part in np.array_split(here, max(1, len(here) * wide >> 18)):
            if not len(part):
                continue
            i = np.arange(wide)
            p, d = word[part, None], mass[part, None]
            steps = np.log(THETA + discount * (held[part, None] + i)) + np.log((p * d + i) / (d + i))
            own = np.cumsum(steps, axis=1) + logs[customers[part], 1 : wide + 1]
            own = np.cumsum(np.exp(own - own.max(axis=1, keepdims=True)), axis=1)
            tables[part] = 1 + (own < random.random(len(part))[:, None] * own[:, -1:]).sum(axis=1)
        wide *= 2
    many = np.flatnonzero(customers > MOST_CUSTOMERS)
    if len(many):
        tables[many] = seat_many(customers[many], *(np.asarray(x, float)[many] for x in (held, word, mass)), discount, random)
    return tables


def log_rising(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log of x (x + 1) ... (x + n - 1), also where x is far greater than n."""
    shift = 1 + n / x
    for j in range(1, 10):
        shift = shift * (1 + n / (x + j))
    y = x + 10

    def rest(z):
        r = 1 / z
        return r * (1 / 12 - r * r * (1 / 360 - r * r / 1260))

    return (y - 0.5) * np.log1p(n / y) + n * (np.log(y + n) - 1) + rest(y + n) - rest(y) - np.log(shift)


FEW = 256  # tables for which S(c, t) is summed in closed form


@lru_cache(maxsize=4)
def few_terms(discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of k = 1 to FEW: log and sign of Gamma(1 + d k) sin(pi d k) / pi; C(t, k) by (k, t)."""
    k = np.arange(1, FEW + 1)
    sine = np.sin(np.pi * (discount * k % 2)) / np.pi
    with np.errstate(divide="ignore"):
        logs = np.array([math.lgamma(1 + discount * x) for x in k]) + np.log(np.abs(sine))
    return logs, -np.sign(sine) * (-1.0) ** k, binomials()


@lru_cache(maxsize=1)
def binomials() -> np.ndarray:
    """C(t, k) by (k, t) from 1 to FEW, each the nearest double."""
    row, rows = [1] + [0] * FEW, []
    for _ in range(FEW):
        row = [1, *(a + b for a, b in zip(row, row[1:]))]
        rows.append([float(x) for x in row[1:]])
    return np.array(rows).T.copy()


def stirling_few(customers: np.ndarray, discount: float, most: int = FEW) -> tuple[np.ndarray, np.ndarray]:
    """log of S(c, t) / Gamma(c - d) for t = 1 to most and many customers, from

        S(c, t) = sum over k of (-1)^k C(t, k) Gamma(c - d k) / Gamma(-d k) / (d^t t!),

    and the number of leading t for which the sum loses few digits."""
    logs, sign, choose = (x[..., :most] for x in few_terms(discount))
    choose, k = choose[:most], np.arange(1, most + 1)
    terms = np.exp(logs - log_rising(customers[:, None] - discount * k, (k - 1) * discount))
    total, size = (terms * sign) @ choose, terms @ choose
    good = size < 1e5 * total
    factorial = np.cumsum(np.log(k * discount))
    return np.log(np.where(good, total, 1)) - factorial, np.where(good.all(axis=1), most, good.argmin(axis=1))


POINTS = 64    # of the integral of ``log_hits``, fewer where it is narrow
STEP = 0.07    # its greatest
AWAY = 4.0     # its path keeps this many times 1 / customers from 0
SCAN = 64      # places at which a distribution is looked at to find where it lies
NODES = 32     # of the interpolation of ``log_hits``
CELLS = 64     # of the envelope; up to so many tables are summed one by one


def _saddle(z: np.ndarray, discount: float) -> tuple[np.ndarray, ...]:
    """At x = 1 / (1 + e^z), with y = 1 - x: log x, log y, and of log f(x) for
    f(x) = 1 - y^d its value and first three derivatives by log x."""
    log_x, log_y = -np.logaddexp(0, z), -np.logaddexp(0, -z)
    log_f = np.log(-np.expm1(discount * log_y))
    ratio = np.exp(-z)  # x / y
    first = discount * np.exp((discount - 1) * log_y + log_x - log_f)
    slope = (1 - discount) * ratio + 1 - first
    second = first * slope
    return log_x, log_f, first, second, second * slope + first * ((1 - discount) * ratio * (1 + ratio) - second)


def _place(customers: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """z at which the first derivative of ``_saddle`` is customers / t."""
    low, high = np.full(t.shape, -60.0 / (1 - discount)), np.full(t.shape, 40.0)
    want = np.log(customers / t)
    for _ in range(44):
        middle = (low + high) / 2
        log_y = -np.logaddexp(0, -middle)
        more = np.log(discount) + (discount - 1) * log_y - np.logaddexp(0, middle) - np.log(-np.expm1(discount * log_y)) > want
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    return (low + high) / 2


def log_hits(customers: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log of S(c, t) d^t t! / c!, for any c and t: the coefficient of x^c in
    (1 - (1 - x)^d)^t, as an integral around 0 in the variable log x.  The path crosses the
    real axis at the saddle, but not too near the cut from x = 1, and bends around it as
    the steepest one does; a trapezoid rule on it is right to about ten digits.  Where c
    is hardly above t, the path is a circle."""
    customers, t = np.broadcast_arrays(np.asarray(customers, float), np.asarray(t, float))
    shape, customers, t = t.shape, customers.ravel(), t.ravel()
    z = np.minimum(_place(customers, t, discount), np.log(4 * customers))  # t = c has none
    z = np.maximum(z, np.log(np.expm1(AWAY / customers)))
    away, wide = np.logaddexp(0, z), np.sqrt(t * _saddle(z, discount)[3])
    circle = (away > 0.5) & (wide < 12)
    # standard deviations of the integrand from the cut, as far as it is like a normal one
    apart = np.where(circle, 0, wide * away)
    out = np.empty(len(t))
    for low, high, points in ((0.6 / STEP, np.inf, 16), (4, 0.6 / STEP, 24), (-1, 4, POINTS)):
        some = (apart > low) & (apart <= high)
        if some.any():
            out[some] = _integral(customers[some], t[some], z[some], circle[some], discount, points)
    return out.reshape(shape)


def _integral(customers: np.ndarray, t: np.ndarray, z: np.ndarray, circle: np.ndarray, discount: float, points: int) -> np.ndarray:
    w, log_f, _, second, third = _saddle(z, discount)
    away, wide = -w, np.sqrt(t * second)
    step = np.where(circle, np.pi / points, np.minimum(0.6 / (wide * away), STEP))
    bend = np.where(circle, 0, third / (6 * second))[..., None]
    u = step[..., None] * np.arange(1, points + 1)
    around, away = circle[..., None], away[..., None]
    v = np.where(around, u, away * np.sinh(u))
    h = bend * v * v + 1j * v
    with np.errstate(all="ignore"):
        small = -t * log_f < 1  # less 1, which adds nothing to the integral
        log_y = _log_less(w[:, None] + h, -w < 0.7)
        logs = t[:, None] * _log_less(discount * log_y, ~small)
        base, value = np.where(small, 0, t * log_f), np.empty_like(logs)
        value[small] = np.expm1(logs[small])
        value[small] *= np.exp(-(customers[:, None] * h)[small])
        value[~small] = np.exp((logs - base[:, None] - customers[:, None] * h)[~small])
        value = (value * (1 - 2j * bend * v)).real * np.where(around, 1, away * np.cosh(u))
        value[:, -1] *= np.where(circle, 0.5, 1)  # the two halves of a circle share its end
        first = np.where(small, np.expm1(t * log_f), 1) * np.where(circle, 1, -w)
        total = first + 2 * np.nan_to_num(value, nan=0.0, posinf=0.0, neginf=0.0).sum(axis=1)
        return base - customers * w + np.log(step / (2 * np.pi) * total)


def _log_less(x: np.ndarray, near: np.ndarray) -> np.ndarray:
    """log(1 - e^x); near: rows where x comes near 0."""
    out = np.empty_like(x)
    out[near] = np.log(-np.expm1(x[near]))
    out[~near] = np.log1p(-np.exp(x[~near]))
    return out


def _nodes(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """NODES different integers from low to high, dense at both ends of log t."""
    a, b = np.log(low), np.log(high)
    share = (1 - np.cos(np.pi * np.arange(NODES) / (NODES - 1))) / 2
    out = np.rint(np.exp(a[:, None] + (b - a)[:, None] * share))
    up = np.arange(NODES)
    out = np.maximum.accumulate(out - up, axis=1) + up  # each greater than the one before
    return np.minimum(out, high[:, None] - up[::-1])


def seat_many(customers: np.ndarray, held: np.ndarray, p: np.ndarray, mass: np.ndarray, discount: float, random: np.random.Generator) -> np.ndarray:
    """``reseat`` for any number of customers, at a cost that does not grow with it.

    1. *Where.*  Saddle points give P(t) to a few percent; what lies below e^-DROP of the
       greatest P(t) is left, which is far below the least step of a random number.
    2. *Few.*  Where that is few tables, P(t) is summed, in closed form if it has the digits.
    3. *Many.*  S(c, t) is integrated at NODES numbers of tables and interpolated between
       them, as the logarithm of what is smooth in log t.  A draw takes one of CELLS
       intervals by an upper bound of P(t) in it, a t in the interval, and is kept with
       the chance P(t) / bound."""
    out = np.zeros(len(customers), np.int64)
    for part in np.array_split(np.arange(len(customers)), len(customers) // 64 + 1):
        if len(part):
            out[part] = _seat_some(customers[part].astype(float), held[part], p[part], mass[part], discount, random)
    return out


def _seat_some(customers, held, p, mass, discount, random) -> np.ndarray:
    own = THETA / discount + held

    def rest(t, at):
        """log P(t) without ``log_hits``, up to a constant."""
        shape = (-1,) + (1,) * (t.ndim - 1)
        o, q, m, n = own[at].reshape(shape), (p * mass)[at].reshape(shape), mass[at].reshape(shape), t - 1
        return log_rising(o + 1, n) + log_rising(q + 1, n) - log_rising(m + 1, n) - log_rising(np.full(t.shape, 2.0), n)

    every = np.arange(len(customers))
    c = customers[:, None]
    low, high = _place(customers, np.ones(len(every)), discount), np.log(4 * customers)
    for _ in range(4):
        z = low[:, None] + (high - low)[:, None] * np.linspace(0, 1, SCAN)
        w, log_f, first, second, _ = _saddle(z, discount)
        t = np.clip(c / first, 1, c)
        logs = t * log_f - c * w - np.log(t * second) / 2 + rest(t, every)
        kept = logs > logs.max(axis=1, keepdims=True) - DROP
        left, right = np.maximum(kept.argmax(axis=1) - 1, 0), np.minimum(SCAN - kept[:, ::-1].argmax(axis=1), SCAN - 1)
        low, high = z[every, left], z[every, right]
    least, most = np.floor(t[every, left]), np.minimum(np.ceil(t[every, right]), customers)
    tables = np.zeros(len(every), np.int64)

    for low, high in ((0, 16), (16, 64), (64, FEW)):
        few = np.flatnonzero((most > low) & (most <= high))
        if len(few):
            logs, width = stirling_few(customers[few], discount, high)
            t = np.broadcast_to(np.arange(1.0, high + 1), logs.shape)
            # S(c, t) = hits c! / (d^t t!)
            logs = logs + rest(t, few) + log_rising(np.full(t.shape, 2.0), t - 1) + t * np.log(discount)
            logs = np.where(t <= width[:, None], logs, -np.inf)
            closed = most[few] <= width
            closed[closed] = (logs[np.arange(len(few)), width - 1] - logs.max(axis=1))[closed] < LEAST
            if closed.any():
                tables[few[closed]] = 1 + _one_of(logs[closed], random)
    some = np.flatnonzero((tables == 0) & (most - least < CELLS))
    if len(some):
        t = least[some, None] + np.arange(CELLS)
        inside = t <= most[some, None]
        t = np.where(inside, t, least[some, None])
        tables[some] = least[some] + _one_of(np.where(inside, log_hits(c[some], t, discount) + rest(t, some), -np.inf), random)
    many = np.flatnonzero(tables == 0)
    if len(many):
        tables[many] = _by_envelope(customers[many], least[many], most[many], lambda t: rest(t, many), discount, random)
    return tables


def _one_of(logs: np.ndarray, random: np.random.Generator) -> np.ndarray:
    sums = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
    return (sums <= random.random(len(logs))[:, None] * sums[:, -1:]).sum(axis=1)


def interpolated(customers: np.ndarray, least: np.ndarray, most: np.ndarray, discount: float):
    """``log_hits`` between least and most, as a function of t (a row each)."""
    smooth = lambda t: log_rising((customers - most + 1)[:, None], most[:, None] - t) - np.log(t)
    nodes = _nodes(least, most)
    values = log_hits(customers[:, None], nodes, discount) + smooth(nodes)
    scale = 4 / np.log(most / least)[:, None]
    apart = np.log(nodes[:, :, None] / nodes[:, None, :]) * scale[:, :, None] + np.eye(NODES)
    weights = 1 / apart.prod(axis=2)

    def at(t):
        away = np.log(t[:, :, None] / nodes[:, None, :])
        near = weights[:, None, :] / np.where(away == 0, 1, away)
        between = (near * values[:, None, :]).sum(axis=2) / near.sum(axis=2)
        exact = (np.where(away == 0, values[:, None, :], 0)).sum(axis=2)
        return np.where((away == 0).any(axis=2), exact, between) - smooth(t)

    return at


def _by_envelope(customers, least, most, rest, discount, random) -> np.ndarray:
    hits = interpolated(customers, least, most, discount)
    logs_at = lambda t: hits(t) + rest(t)
    edges = np.floor(least[:, None] + (most - least + 1)[:, None] * np.linspace(0, 1, CELLS + 1))
    logs = logs_at(np.minimum(edges, most[:, None]))
    bend = np.abs(np.diff(logs, 2, axis=1, prepend=logs[:, :1], append=logs[:, -1:]))
    bound = np.maximum(logs[:, :-1], logs[:, 1:]) + np.maximum(bend[:, :-1], bend[:, 1:]) / 4
    cells = bound + np.log(np.diff(edges, axis=1))
    out, every = np.zeros(len(customers), np.int64), np.arange(len(customers))
    while len(every):
        cell = _one_of(cells[every], random)
        wide = edges[every, cell + 1] - edges[every, cell]
        t = np.ones(len(customers)) * least
        t[every] = edges[every, cell] + np.floor(random.random(len(every)) * wide)
        kept = np.log(1 - random.random(len(every))) <= logs_at(t[:, None])[every, 0] - bound[every, cell]
        out[every[kept]] = t[every[kept]]
        every = every[~kept]
    return out


@dataclass
class Shared:
    """What every task knows: of fixed size.  One entry per sweep in the lists."""

    routing: Routing
    tokens: int = 0
    vocabulary: int = 0
    once: int = 0                                  # words that occur once: no sweep changes them
    discounts: tuple[float, float] = (0.5, 0.5)
    parent: list = field(default_factory=list)     # (customers, tables) of the parent
    frequent: list = field(default_factory=list)   # (customers, tables) of each frequent word in the parent
    contexts: list = field(default_factory=list)   # tables of each frequent word as a context
    frequent_count: np.ndarray | None = None

    def base(self, sweep: int) -> float:
        """The parent's mass for a word nobody ordered."""
        customers, tables = self.parent[sweep]
        return (THETA + self.discounts[0] * tables) / (self.vocabulary + 1) / (THETA + customers)

    def word_probability(self, sweep: int, customers: np.ndarray, tables: np.ndarray, whole: np.ndarray) -> np.ndarray:
        hot = whole >= 0
        if hot.any():
            customers, tables = customers.astype(float), tables.astype(float)
            customers[hot], tables[hot] = self.frequent[sweep][0][whole[hot]], self.frequent[sweep][1][whole[hot]]
        return np.maximum(customers - self.discounts[0] * tables, 0) / (THETA + self.parent[sweep][0]) + self.base(sweep)

    def swept(self, seats: Seats, bucket: int, sweep: int, tables: np.ndarray) -> Seats:
        """The seating after sweep + 1, given the tables of each pair's context: every pair
        draws its tables given all others', then every word its tables in the parent."""
        random = np.random.default_rng([bucket, sweep])
        low, high = self.discounts
        whole, of_word = self.routing.whole(seats.words), seats.of_word
        hot = whole >= 0
        customers, at = of_word.astype(float), seats.parent.astype(float)
        if hot.any():
            customers[hot], at[hot] = self.frequent[sweep][0][whole[hot]], self.frequent[sweep][1][whole[hot]]
        in_parent, parent_tables = self.parent[sweep]
        mass = THETA + in_parent - seats.tables
        base = (THETA + low * parent_tables) / (self.vocabulary + 1)
        word = (np.maximum(customers[seats.word] - seats.tables - low * at[seats.word], 0) + base) / mass
        others = np.maximum(tables - seats.tables, 0)
        out = replace(seats, tables=reseat(seats.count, others, word, mass, high, random))
        rest = np.maximum(parent_tables - seats.parent, 0)
        uniform = np.full(len(rest), 1 / (self.vocabulary + 1))
        out.parent = reseat(out.of_word, rest, uniform, np.full(len(rest), 1e15), low, random)
        return out


def frequent_words(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words with at least 1 / FREQUENT of the tokens of a sample, at most
    FREQUENT of them, which only decide where counts are added up; and of the USUAL
    most frequent words of the sample."""
    def count(batches):
        for batch in batches:
            for part in B.slices(B.flat(batch.column("text"))):
                every = np.sort(tokens(B.flat(batch.column("text")).slice(*part))[0])
                cuts = B.grouped(every)
                n = np.diff(cuts)
                many = (n > 1) | (n * FREQUENT >= len(every))  # what is frequent in all is frequent in some slice
                words = every[cuts[:-1]][many].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([*words.tolist(), 0]), pa.array([*n[many].tolist(), len(every)]), pa.array([*[False] * len(words), True])], ["word", "n", "total"])

    own = docs.where(F.pmod(F.xxhash64(text, F.lit(1)), F.lit(SAMPLE)) == 0).select(F.col(text).alias("text"))
    counted = B.kept(own.mapInArrow(count, "word bigint, n bigint, total boolean").groupBy("word", "total").agg(F.sum("n").alias("n")))
    size = counted.agg(F.max(F.when(F.col("total"), F.col("n"))).alias("all")).first()["all"] or 0
    found = counted.where(~F.col("total")).orderBy(F.desc("n"), "word").limit(USUAL).collect() if size else []
    hashes = lambda rows: np.sort(np.array([r["word"] for r in rows], np.int64).view(_U))
    return hashes([r for r in found[:FREQUENT] if r["n"] * FREQUENT >= size]), hashes(found)


def train(docs: DataFrame, text: str, learn: Column, size: int) -> tuple[DataFrame, Shared]:
    """What the owners know, by range of words, and what is shared."""
    routing = Routing(max(64, size // (8 << 20)), *frequent_words(docs, text))
    as_known = docs.sparkSession.sparkContext.broadcast(routing)

    def counts_of(held):
        word, context = (np.concatenate(x) for x in zip(*held))
        words, contexts, pair = pairs_of(word, context)
        pair.sort()
        cuts = B.grouped(pair)
        n = np.diff(cuts)
        rows = [(b, w, s, c, small(n[x:y])) for b, w, s, c, x, y in rows_by_bucket(words, contexts, pair[cuts[:-1]], as_known.value)]
        return B.as_table(rows, COUNTS).to_batches()

    def count(batches):
        held, n = [], 0
        for batch in batches:
            texts = B.flat(batch.column("text"))
            for part in B.slices(texts):
                token, context, _ = tokens(texts.slice(*part))
                held.append((as_known.value.split(token, context), context))
                n += len(token)
                if n >= PIECE_TOKENS:
                    yield from counts_of(held)
                    held, n = [], 0
                    B.give_back()
        if held:
            yield from counts_of(held)
        del held
        B.give_back()

    def merge(table: pa.Table) -> pa.Table:
        own = Owned.merged(as_known.value, list(zip(*(table.column(c).to_pylist() for c in ("words", "sizes", "contexts", "counts")))))
        sizes = np.bincount(own.word, minlength=len(own.words))
        bucket = table.column("bucket")[0].as_py()
        contexts, place = coded(own.context)
        packed = as_known.value.pack(contexts, as_known.value.numbers(contexts), place)
        return B.as_table([(bucket, FULL, bucket, B.planes(own.words), small(sizes), packed, small(own.count), b"", b"", b"", b"")], ROWS)

    def begin(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from B.as_table([Seats.start(read_owned(row, as_known.value), as_known.value).row(row["bucket"], as_known.value)], ROWS).to_batches()
                B.give_back()

    as_text = "bucket int, words binary, sizes binary, contexts binary, counts binary"
    counted = docs.where(F.coalesce(learn, F.lit(False))).select(F.col(text).alias("text")).mapInArrow(count, as_text)
    owned = B.written(counted.groupBy("bucket").applyInArrow(B.alone(merge), AS_ROWS))
    del counted
    B.settle(docs.sparkSession)
    seats = owned.mapInArrow(begin, AS_ROWS)
    shared = Shared(routing)
    learned_from(owned, shared)
    known = owned
    if shared.tokens:
        seated(seats, shared)
        for sweep in range(SWEEPS):
            before, seats = seats, swept(seats, shared, sweep)
            if sweep not in AVERAGED:
                B.discard(before)
            B.settle(docs.sparkSession)
            seated(seats, shared)
            if sweep + 1 in AVERAGED:
                known = known.union(seats).union(lacking(seats, routing))
    return known, shared


def sums(rows: DataFrame, shared: Shared, of_row) -> dict[str, np.ndarray]:
    """Sums of fixed size over all ranges, added up by each task first."""
    known = rows.sparkSession.sparkContext.broadcast(shared)

    def add(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                for name, values in of_row(known.value, row).items():
                    total[name] = total.get(name, 0) + np.asarray(values, np.int64)
        for name, values in total.items():
            at = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(values[at], pa.int64())], ["name", "place", "n"])

    out: dict[str, np.ndarray] = {}
    for r in rows.mapInArrow(add, "name string, place int, n bigint").groupBy("name", "place").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r["name"], np.zeros(max(16, len(shared.routing.frequent)), np.int64))[r["place"]] = r["n"]
    return out


def learned_from(owned: DataFrame, shared: Shared) -> None:
    def of_row(shared, row):
        own = read_owned(row, shared.routing)
        whole, totals, pairs = shared.routing.whole(own.words), own.totals, np.bincount(own.word, minlength=len(own.words))
        plain = whole < 0
        return {"all": [own.count.sum(), plain.sum(), (own.count == 1).sum(), (own.count == 2).sum(), (pairs[plain] == 1).sum(), (pairs[plain] == 2).sum(), (totals[plain] == 1).sum()],
                "counts": np.bincount(whole[~plain], totals[~plain], len(shared.routing.frequent))}

    found = sums(owned, shared, of_row)
    if "all" not in found:
        return
    m = len(shared.routing.frequent)
    shared.tokens, plain, once, twice, word_once, word_twice, shared.once = found["all"][:7].tolist()
    shared.frequent_count = found.get("counts", np.zeros(m, np.int64))[:m]
    shared.vocabulary = plain + int((shared.frequent_count > 0).sum())
    estimate = lambda a, b: a / (a + 2 * b) if a and b else 0.5
    shared.discounts = (estimate(word_once, word_twice), estimate(once, twice))


def seated(rows: DataFrame, shared: Shared) -> None:
    """Add the sums of a seating to ``shared``."""
    def of_row(shared, row):
        seats, routing = Seats.read(row, shared.routing), shared.routing
        whole, of_word, m = routing.whole(seats.words), seats.of_word, len(routing.frequent)
        plain, hot = whole < 0, np.flatnonzero(routing.hot(seats.context))
        return {"all": [of_word.sum(), seats.parent[plain].sum()], "words": np.bincount(whole[~plain], of_word[~plain], m),
                "less": np.bincount(np.searchsorted(routing.frequent, seats.context[hot]), (seats.count - seats.tables)[hot], m)}

    found, m, sweep = sums(rows, shared, of_row), len(shared.routing.frequent), len(shared.parent)
    none = np.zeros(max(16, m), np.int64)
    customers, tables = (found.get("all", none)[:2] + shared.once).tolist()
    words = found.get("words", none)[:m]
    if sweep == 0:
        at_tables = np.minimum(words, 1)
    else:
        rest = np.maximum(shared.parent[-1][1] - shared.frequent[-1][1], 0)
        at_tables = reseat(words, rest, np.full(m, 1 / (shared.vocabulary + 1)), np.full(m, 1e15), shared.discounts[0], np.random.default_rng([sweep]))
    shared.contexts.append(shared.frequent_count - found.get("less", none)[:m])
    shared.parent.append((customers, tables + int(at_tables.sum())))
    shared.frequent.append((words, at_tables))


def read_owned(row: dict, routing: Routing) -> Owned:
    return Owned(*read_pairs(routing, row["words"], row["sizes"], row["contexts"]), from_small(row["counts"]))


def lacking(rows: DataFrame, routing: Routing) -> DataFrame:
    """For the owner of each context, the customers less tables that a range has there."""
    known = rows.sparkSession.sparkContext.broadcast(routing)

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, less, _ = Seats.read(row, known.value).less(known.value)
                out = [(b, LESS + row["kind"], row["bucket"], B.planes(keys[lo:hi]), b"", b"", small(less[lo:hi]), b"", b"", b"", b"") for b, lo, hi in B.by_bucket(keys, known.value.buckets)]
                yield from B.as_table(out, ROWS).to_batches()
            B.give_back()

    return rows.mapInArrow(send, AS_ROWS)


def swept(rows: DataFrame, shared: Shared, sweep: int) -> DataFrame:
    """The seating after the next sweep; contexts' owners tell their tables first."""
    known = rows.sparkSession.sparkContext.broadcast(shared)

    def tell(asked: pa.Table, seats: pa.Table) -> pa.Table:
        if not len(asked):
            return ANSWERS.empty_table()
        own = Seats.read(seats.to_pylist()[0], known.value.routing)
        asked = asked.select(["bucket", "sender", "words", "counts"]).to_pylist()
        places = [np.searchsorted(own.words, B.from_planes(r["words"])) for r in asked]
        tables = own.totals.copy()
        for r, at in zip(asked, places):
            tables[at] -= from_small(r["counts"])
        return B.as_table([(r["sender"], r["bucket"], small(tables[at])) for r, at in zip(asked, places)], ANSWERS)

    def seat_all(seats: pa.Table, told: pa.Table) -> pa.Table:
        if not len(seats):
            return ROWS.empty_table()
        shared = known.value
        row = seats.to_pylist()[0]
        own = Seats.read(row, shared.routing)
        place = own.less(shared.routing)[2]
        answers = sorted(zip(told.column("sender").to_pylist(), told.column("tables").to_pylist()))
        tables = np.concatenate([*(from_small(t) for _, t in answers), np.zeros(1, np.int64)])[place]
        hot = np.flatnonzero(shared.routing.hot(own.context))
        tables[hot] = shared.contexts[sweep][np.searchsorted(shared.routing.frequent, own.context[hot])]
        return B.as_table([shared.swept(own, row["bucket"], sweep, tables).row_after(row, sweep + 1)], ROWS)

    told = lacking(rows, shared.routing).groupBy("bucket").cogroup(rows.groupBy("bucket")).applyInArrow(B.paired(tell), "bucket int, sender int, tables binary")
    return B.written(rows.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(B.paired(seat_all), AS_ROWS))


class Scorer:
    """The owners' answers and the blocks' questions."""

    def __init__(self, key: str, text: str, block: str, shared):
        self.key, self.text, self.block, self.shared = key, text, block, shared

    def read(self, table: pa.Table):
        """Words, contexts and pairs of a block in order, then the place of each token's
        pair and its document."""
        routing = self.shared.value.routing
        texts = B.flat(table.column(self.text))
        held, docs = [], []
        for a, n in B.slices(texts):
            token, _, doc = tokens(texts.slice(a, n))
            held.append(token)
            docs.append((doc + a).astype(np.int32))
        token, doc = np.concatenate(held), np.concatenate(docs)
        del held, docs
        # a context is the token before, as the end of a text is also what comes before the next one
        contexts, of = coded(token)
        words, at = coded(routing.split(token, np.roll(token, 1)))
        del token
        at <<= PLACE
        at |= np.roll(of, 1)
        del of
        return words, contexts, *coded_pairs(at), doc

    def ask(self, table: pa.Table) -> pa.Table:
        words, contexts, pairs, *_ = self.read(table)
        block = table.column(self.block)[0].as_py()
        return B.as_table([(b, block, w, s, c) for b, w, s, c, _, _ in rows_by_bucket(words, contexts, pairs, self.shared.value.routing)], ASKED)

    def tell(self, asked: pa.Table, known: pa.Table) -> pa.Table:
        """Of every pair its customers and the sum of its tables; of every word its
        count, customers and tables in the parent, and tables as a context."""
        if not len(asked):
            return TOLD.empty_table()
        routing = self.shared.value.routing
        bucket = asked.column("bucket")[0].as_py()
        rows: dict[int, list] = {}
        for row in known.to_pylist():
            rows.setdefault(row["kind"], []).append(row)
        if FULL in rows:
            own = read_owned(rows[FULL][0], routing)
        else:
            own = Owned(np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64))
        totals, of_pair = own.totals, np.zeros(len(own.word), np.int64)
        begun = Seats.start(own, routing)
        many, customers, tables, contexts = np.flatnonzero(own.count > 1), [], [], []
        for sweep in AVERAGED:
            customers.append(np.ones(len(own.words), np.int64))
            tables.append(np.ones(len(own.words), np.int64))
            contexts.append(totals.copy())
            of_pair += 1
            for row in rows.get(sweep, ()):
                seats = replace(begun, parent=from_small(row["parent"]), tables=from_small(row["tables"]))
                at = np.searchsorted(own.words, seats.words)
                customers[-1][at], tables[-1][at] = seats.of_word, seats.parent
                of_pair[many] += seats.tables - 1
            for row in rows.get(LESS + sweep, ()):
                contexts[-1][np.searchsorted(own.words, B.from_planes(row["words"]))] -= from_small(row["counts"])
        of_words = np.stack([totals, *customers, *tables, *contexts])
        every, place = coded(own.context)
        have, of_every = (own.word << PLACE) | place, B.Spread(every)
        out = []
        for block, *row in zip(*(asked.column(c).to_pylist() for c in ("block", "words", "sizes", "contexts"))):
            words, word, context = read_pairs(routing, *row)
            place, found = B.places(own.words, words)
            of_context, known_context = of_every.places(context)
            seen = np.flatnonzero(found[word] & known_context)
            at, both = B.places(have, (place[word[seen]] << PLACE) | of_context[seen])
            seen, at = seen[both], at[both]
            pairs, of = np.zeros((2, len(word)), np.int64), np.zeros((len(of_words), len(words)), np.int64)
            pairs[0, seen], pairs[1, seen] = own.count[at], of_pair[at]
            of[:, found] = of_words[:, place[found]]
            out.append((bucket, block, small(pairs.ravel()), small(of.ravel())))
        return B.as_table(out, TOLD)

    def decide(self, table: pa.Table, told: pa.Table) -> pa.Table:
        shared, k = self.shared.value, len(AVERAGED)
        n, frequent = len(table), shared.routing.frequent
        words, contexts, pairs, pair, doc = self.read(table)
        of_pair, of_word = np.zeros((2, len(pairs)), np.int64), np.zeros((1 + 3 * k, len(words)), np.int64)
        answers = {b: (x, y) for b, x, y in zip(*(told.column(c).to_pylist() for c in ("bucket", "pairs", "seen")))}
        at = np.searchsorted(pairs, np.arange(len(words) + 1) << PLACE)
        for b, lo, hi in B.by_bucket(words, shared.routing.buckets):
            if b in answers:
                of_pair[:, at[lo] : at[hi]] = from_small(answers[b][0]).reshape(2, -1)
                of_word[:, lo:hi] = from_small(answers[b][1]).reshape(len(of_word), -1)
        whole = shared.routing.whole(words)
        count = of_word[0].copy()
        count[whole >= 0] = shared.frequent_count[whole[whole >= 0]]
        # a context is a word of the block too, or frequent
        hot = B.within(frequent, contexts)
        number, place = np.searchsorted(frequent, contexts[hot]), np.searchsorted(words, contexts[~hot])
        customers, held = np.zeros(len(contexts)), np.zeros((k, len(contexts)))
        customers[hot], customers[~hot] = shared.frequent_count[number], of_word[0][place]
        word, context = split_pairs(pairs)
        total = of_pair[0] * k - shared.discounts[1] * of_pair[1]
        parents = np.zeros(len(words))
        for i, sweep in enumerate(AVERAGED):
            held[i][hot], held[i][~hot] = shared.contexts[sweep][number], of_word[1 + 2 * k + i][place]
            parent = shared.word_probability(sweep, of_word[1 + i], of_word[1 + k + i], whole)
            total += (THETA + shared.discounts[1] * held[i][context]) * parent[word]
            parents += parent
        total = np.where(customers[context] > 0, total / (THETA + customers[context]), parents[word])
        logs = np.log10(np.minimum(total / k, 1))
        seen = count[word[pair]]
        base = np.log10((seen + 1) / (shared.tokens + shared.vocabulary + 1))
        per = lambda x: np.bincount(doc, x, n)
        keys = table.column("key").combine_chunks()
        return pa.table([keys, table.column("learned"), pa.array(per(None).astype(np.int64)), pa.array(per((seen > 0).astype(float)).astype(np.int64)),
                         pa.array(per(base)), pa.array(per(logs[pair]))], names=["key", "learned", "n_tokens", "n_known", "base_score", "score"])


def score(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, Shared]:
    """key, learned, n_tokens, n_known, base_score and score (log10 of the text's
    probability) of every row; and the counts that all tasks share."""
    size = B.text_bytes(docs, text)
    own = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(learn, F.lit(False)).alias("learned"), F.col(text).alias("text"))
    known, shared = train(own, "text", F.col("learned"), size)
    if not shared.tokens:
        empty = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")) + 1
        return own.select("key", "learned", empty.cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score")), shared
    # of a seating only its tables are sent: words, contexts and counts follow from the full counts
    seating = F.col("kind").isin(*AVERAGED)
    known = known.withColumns({c: F.when(seating, F.lit(b"")).otherwise(F.col(c)) for c in ("words", "sizes", "contexts", "counts", "totals", "singles")})
    as_known, parts = own.sparkSession.sparkContext.broadcast(shared), []
    for i in range(PASSES):  # what a pass shuffles is gone before the next one
        some = own.where(F.pmod(F.xxhash64("key", "text", F.lit(3)), F.lit(PASSES)) == i)
        dealt, block = B.blocked(some, "key", "text", -(-size // PASSES), BLOCK_BYTES)
        s = Scorer("key", "text", block, as_known)
        asked = dealt.groupBy(block).applyInArrow(B.alone(s.ask), "bucket int, block int, words binary, sizes binary, contexts binary")
        told = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(B.paired(s.tell), "bucket int, block int, pairs binary, seen binary")
        parts.append(B.written(dealt.groupBy(block).cogroup(told.groupBy("block")).applyInArrow(B.paired(s.decide), SCORES)))
        del dealt, asked, told
        B.settle(own.sparkSession)
    return reduce(DataFrame.union, parts), shared
