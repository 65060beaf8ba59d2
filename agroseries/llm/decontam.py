"""Benchmark decontamination: SimHash of item-sized windows, then exact similarity.

For an item of L words, every window of L words of a document that shares a shingle
with some item of that length gets a SimHash over its shingles, each weighted with
how often it occurs.  Fingerprints are cut into blocks; two that differ in at most
``radius`` bits have a block in which they differ in at most radius / blocks bits, so
looking every block up among the values that near an item's block finds all
fingerprints within the radius.  The weighted Jaccard similarity of the shingle
counts, sum of least over sum of greatest, is then computed exactly; of overlapping
windows that match one item, the best stays (the first of equal ones).

A document of fewer words than the item is one window as a whole.  Its similarity is
computed exactly for every item of which it may hold enough shingles, without SimHash.

At a similarity of 0.75 two fingerprints of 128 bits differ in 22 bits on average, with a
deviation of 4.3; the radius of 47 leaves out fewer than one in 10**8 of such pairs.

Items are taken in blocks of at most ``ITEM_BYTES`` of text, read to the driver and
broadcast one after the other, so the benchmark may be of any size.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; an item or
window of fewer than five words is one shingle; items and texts without words match
nothing; null ids are passed through; repeated items match each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

SHINGLE = 5
PERCENT = 75
BITS = 128
HAMMING_BLOCKS = 8
RADIUS = 47
ITEM_BYTES = 8 << 20


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of a shingle's fingerprint."""
    words = np.stack([B.mix(hashes + np.uint64(0x9E3779B97F4A7C15 * (i + 1) % 2**64)) for i in range(BITS // 64)], axis=1)
    return np.unpackbits(words.view(np.uint8).reshape(len(hashes), -1), axis=1).astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """Bits of summed signs as 16-bit blocks."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


def near_values(values: np.ndarray, distance: int) -> np.ndarray:
    """Which 16-bit values differ from one of ``values`` in at most so many bits."""
    near = np.zeros(1 << 16, bool)
    near[values] = True
    every = np.arange(1 << 16)
    for _ in range(distance):
        grown = near.copy()
        for bit in range(16):
            grown |= near[every ^ (1 << bit)]
        near = grown
    return near


class SizeClass:
    """Items of one length."""

    def __init__(self, n_words: int, ids: list, grams: list[np.ndarray], radius: int):
        self.n_words, self.ids, self.grams, self.radius = n_words, ids, [np.sort(g) for g in grams], radius
        self.shingles = len(grams[0])
        self.known = B.unique(np.concatenate(grams))
        self.prints = np.concatenate([fingerprints(signs(g).sum(axis=0, keepdims=True)) for g in grams])
        self.postings = None  # made when a short document needs them
        self.near = [near_values(self.prints[:, b], radius // HAMMING_BLOCKS) for b in range(self.prints.shape[1])]

    def matches(self, hashes: np.ndarray, starts: np.ndarray, hit: np.ndarray, percent: int) -> list[tuple[int, int, float]]:
        """(window, item, similarity); ``hashes`` are the shingles of a stretch of
        one document, ``starts`` the windows to look at, as places in it."""
        sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(signs(hashes), axis=0, dtype=np.int32)])
        prints = fingerprints(sums[starts + self.shingles] - sums[starts])
        found = np.zeros(len(starts), bool)
        for b, near in enumerate(self.near):
            found |= near[prints[:, b]]
        out = []
        for w in np.flatnonzero(found):
            apart = np.bitwise_count(self.prints ^ prints[w]).sum(axis=1)
            for item in np.flatnonzero(apart <= self.radius):
                own = np.sort(hashes[starts[w] : starts[w] + self.shingles])
                same = overlap(own, self.grams[item])
                if (100 + percent) * same >= percent * 2 * self.shingles:
                    out.append((int(starts[w]), int(item), same / (2 * self.shingles - same)))
        return out

    def whole(self, hashes: np.ndarray, hits: int, percent: int) -> list[tuple[int, float]]:
        """(item, similarity) for a document shorter than the items: all its shingles,
        of which ``hits`` are known here."""
        least = percent * (len(hashes) + self.shingles)
        if (100 + percent) * min(hits, len(hashes)) < least:
            return []
        if self.postings is None:
            every = np.concatenate(self.grams)
            order = np.argsort(every, kind="stable")  # of one shingle, the items stay in order
            self.postings = every[order], np.repeat(np.arange(len(self.grams)), self.shingles)[order]
        gram, item = self.postings
        same = np.zeros(len(self.grams), np.int64)
        for value, n in zip(*np.unique(hashes, return_counts=True)):
            lo, hi = np.searchsorted(gram, value, "left"), np.searchsorted(gram, value, "right")
            holders = item[lo:hi]
            cuts = B.grouped(holders)
            same[holders[cuts[:-1]]] += np.minimum(n, np.diff(cuts))
        return [(int(i), int(same[i]) / (len(hashes) + self.shingles - int(same[i]))) for i in np.flatnonzero((100 + percent) * same >= least)]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the common part of two sorted multisets."""
    values, first, n = np.unique(a, return_index=True, return_counts=True)
    lo, hi = np.searchsorted(b, values, "left"), np.searchsorted(b, values, "right")
    return int(np.minimum(n, hi - lo).sum())


class Index:
    """All items of one block."""

    def __init__(self, ids: list, texts: list, percent: int, radius: int):
        self.percent = percent
        by_size: dict[int, tuple[list, list]] = {}
        words = B.Words(B.flat(pa.array([t or "" for t in texts], pa.string())), lower=True)
        start, grams = B.windows(words.hash, words.doc, SHINGLE)
        sums = B.prefix(words.hash)
        for d, item in enumerate(ids):
            lo, hi = int(words.range[d]), int(words.range[d + 1])
            if hi > lo:
                own = grams[np.searchsorted(start, lo) : np.searchsorted(start, hi)] if hi - lo >= SHINGLE else B.span(sums, np.array([lo]), np.array([hi]))
                of = by_size.setdefault(hi - lo, ([], []))
                of[0].append(item)
                of[1].append(own)
        self.classes = [SizeClass(n, *of, radius) for n, of in sorted(by_size.items())]
        full = [c.known for c in self.classes if c.n_words >= SHINGLE]
        self.known = B.unique(np.concatenate(full)) if full else np.zeros(0, np.uint64)

    def find(self, texts: pa.Array) -> list[tuple[int, object, int, int, float]]:
        """(row, item, first word, words, similarity) of all matches in a slice."""
        words = B.Words(texts, lower=True)
        best: list[tuple[int, object, int, int, float]] = []
        cache: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        shared = None
        for c in self.classes:
            size = min(SHINGLE, c.n_words)
            if size not in cache:
                start, grams = B.windows(words.hash, words.doc, size)
                cache[size] = start, grams, np.searchsorted(start, words.range)
            start, grams, at = cache[size]
            if size == SHINGLE:
                if shared is None:
                    shared = np.flatnonzero(B.within(self.known, grams))
                hits = shared[B.within(c.known, grams[shared])]
            else:
                hits = np.flatnonzero(B.within(c.known, grams))
            if not len(hits):
                continue
            doc = words.doc[start[hits]]
            for d in np.unique(doc):
                own = hits[doc == d] - at[d]
                n_words = int(words.range[d + 1] - words.range[d])
                if n_words < c.n_words:
                    best += [(int(d), c.ids[i], 0, n_words, v) for i, v in c.whole(grams[at[d] : at[d + 1]], len(own), self.percent)]
                    continue
                last = int(at[d + 1] - at[d]) - c.shingles
                marked = np.zeros(max(last, -1) + 2, np.int64)  # windows with a hit
                lo, hi = np.maximum(own - c.shingles + 1, 0), np.minimum(own, last)
                ok = lo <= hi
                np.add.at(marked, lo[ok], 1)
                np.add.at(marked, hi[ok] + 1, -1)
                windows = np.flatnonzero(np.cumsum(marked[:-1]) > 0)
                for part in np.split(windows, np.flatnonzero(np.diff(windows) > c.shingles) + 1):
                    if not len(part):
                        continue
                    base = int(part[0])
                    stretch = grams[at[d] + base : at[d] + part[-1] + c.shingles]
                    best += [(int(d), c.ids[i], s, c.n_words, v) for s, i, v in peaks([(w + base, i, v) for w, i, v in c.matches(stretch, part - base, own, self.percent)], c.n_words)]
        return best


def peaks(found: list[tuple[int, int, float]], reach: int) -> list[tuple[int, int, float]]:
    """Of overlapping windows that match one item, the best."""
    out: list[tuple[int, int, float]] = []
    for start, item, value in sorted(found, key=lambda x: (x[1], x[0])):
        if out and out[-1][1] == item and start - out[-1][0] < reach:
            if value > out[-1][2]:
                out[-1] = (start, item, value)
        else:
            out.append((start, item, value))
    return out


def indexes(items: DataFrame, item: str, text: str, percent: int, radius: int) -> Iterator:
    """Broadcast indexes, one for each block of the items."""
    spark = items.sparkSession
    n = max(1, -(-B.text_bytes(items, text) // ITEM_BYTES))
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64(item, text), F.lit(n)) == b).orderBy(item, text).select(item, text).collect()
        if rows:
            yield spark.sparkContext.broadcast(Index([r[0] for r in rows], [r[1] for r in rows], percent, radius))


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
            percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """key, item, start (first word), n_words, similarity: a row for each match."""
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    types = dict(own.dtypes)["key"], dict(items.dtypes)[item]
    out = docs.sparkSession.createDataFrame([], f"key {types[0]}, item {types[1]}, start bigint, n_words bigint, similarity double")
    schema = B.arrow_schema(out.schema)
    for index in indexes(items, item, item_text, percent, radius):
        def find(batches, index=index):
            for batch in batches:
                texts = B.flat(batch.column("text"))
                for a, n in B.slices(texts):
                    found = index.value.find(texts.slice(a, n))
                    if found:
                        rows, ids, start, size, value = zip(*found)
                        yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows, pa.int64()) if not a else pa.array([r + a for r in rows], pa.int64())),
                                                          *(pa.array(x, f.type) for x, f in zip((ids, start, size, value), list(schema)[1:]))], schema=schema)
        out = out.union(own.mapInArrow(find, out.schema))
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
          percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that match no item; a filter, nothing is shuffled."""
    for index in indexes(items, item, item_text, percent, radius):
        def keep(batches, index=index):
            for batch in batches:
                texts = B.flat(batch.column(text))
                stays = np.ones(len(batch), bool)
                for a, n in B.slices(texts):
                    for found in index.value.find(texts.slice(a, n)):
                        stays[a + found[0]] = False
                yield batch.filter(pa.array(stays))
        docs = docs.mapInArrow(keep, docs.schema)
    return docs
