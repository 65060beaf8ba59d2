"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has a bit where over half of the hashes of the text's word shingles have
one.  Fingerprints within ``radius`` bits link; components of links are near-duplicates.

1. *Classes.*  Equal fingerprints are one class, so copies cost one entry.
2. *Partitions.*  Bits that go together over all classes (a 64 x 64 table of how often
   two bits agree) are grouped into the same partition.
3. *Thresholds.*  If the partitions' thresholds t_i hold sum(t_i + 1) = radius + 1, two
   fingerprints within the radius are within t_i bits in some partition i.  Dynamic
   programming allots them, unequal and possibly -1 (not asked at all), so that the
   estimated number of candidates plus the price of the probes is least; the number
   of partitions is chosen the same way.  Estimates come from the distances of all
   classes to ``PROBED`` of them; they decide what the search costs, never its result.
4. *Probe.*  Every class is filed under its value in each partition that is asked; every
   class asks the values within t_i of its own.  First each value's least class is the
   pivot of the others: what links with it is one component.  Values under which
   different components still meet are then compared in full, in cells of at most
   about ``CELL`` x ``CELL`` classes however many classes share a value, and only
   between components.
5. *Verify.*  A candidate is compared in all 64 bits.  A cell returns a spanning forest
   of its links, so a large group costs as many rows as it has members.

Defined results: null text, empty text and text without words have the fingerprint 0,
which links like any other; a text with fewer words than a shingle has its whole
sequence as its one shingle; rows without a key get a fingerprint, link with nothing
and have no component; rows that share a key are documents of their own, which have
that number.  Other columns of the input are not read.
"""

from __future__ import annotations

from itertools import combinations
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import graph

WORDS, SEED, RADIUS, BITS = 4, 42, 4, 64
PARTITIONS = range(2, 9)
PROBED = 256
PROBE_PRICE = 300  # candidates that one probe costs as much as
CELL = 8_192
BUCKET_ROWS = 200_000
_U = np.uint64


# --- fingerprints ---------------------------------------------------------------------
def shingle_hashes(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of a slice of texts, and each text's range of them."""
    own = B.Words(texts, lower=True)
    size = np.diff(own.range)
    # the words of the slice joined by one space each
    length = own.end - own.start
    inside = np.zeros(len(own.raw) + 1, np.int64)
    np.add.at(inside, own.start, 1)
    np.subtract.at(inside, own.end, 1)
    letters = own.raw[np.cumsum(inside[:-1]) > 0]
    start = np.concatenate([[0], np.cumsum(length + 1)])[:-1]
    joined = np.full(int((length + 1).sum()), 0x20, np.uint8)
    joined[np.arange(len(letters)) + np.repeat(np.arange(len(own)), length)] = letters
    few = (size > 0) & (size < words)
    n = np.where(few, 1, np.maximum(size - words + 1, 0))
    at = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(own.range[:-1], n) + np.arange(at[-1]) - np.repeat(at[:-1], n)
    last = first + np.repeat(np.where(few, size, words), n) - 1
    data, digest = joined.tobytes(), xxhash.xxh64_intdigest
    spans = zip(start[first].tolist(), (start[last] + length[last]).tolist()) if len(own) else ()
    return np.fromiter((digest(data[a:b], SEED) for a, b in spans), _U, int(at[-1])), at


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(texts: pa.Array, words: int = WORDS) -> np.ndarray:
    texts = B.flat(texts)
    out = np.zeros(len(texts), _U)
    for a, n in B.slices(texts):
        hashes, at = shingle_hashes(texts.slice(a, n), words)
        out[a : a + n] = [majority(hashes[lo:hi]) for lo, hi in zip(at[:-1], at[1:])]
    return out


# --- partitions and thresholds --------------------------------------------------------
class Plan(NamedTuple):
    """Which bits each partition has, and how many of them may differ in it."""
    bits: list[list[int]]
    thresholds: list[int]

    def asked(self) -> list[tuple[int, list[int], int]]:
        return [(i, b, t) for i, (b, t) in enumerate(zip(self.bits, self.thresholds)) if t >= 0]


def grouped_bits(agree: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` partitions of about equal size: each grows from the free bit
    that goes with the others most by the free bits that go with its own most."""
    together = np.abs(agree)
    free, out = set(range(len(agree))), []
    for left in range(parts, 0, -1):
        pool = sorted(free)
        own = [max(pool, key=lambda b: (together[b, pool].sum(), -b))]
        free.remove(own[0])
        while len(own) < (len(free) + len(own)) / left and free:
            nearest = max(sorted(free), key=lambda b: (together[b, own].sum(), -b))
            own.append(nearest)
            free.remove(nearest)
        out.append(sorted(own))
    return out


def allot(costs: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = radius + 1 of least cost, where
    costs[i][t + 1] is what partition i costs at t."""
    best = {0: (0.0, [])}
    for own in costs:
        step = {}
        for used, (cost, chosen) in best.items():
            for more in range(min(len(own), radius + 2 - used)):
                now = (cost + own[more], [*chosen, more - 1])
                step[used + more] = min(step.get(used + more, now), now)
        best = step
    return best[radius + 1]


def distances(own: np.ndarray, probes: np.ndarray, bits: list[int]) -> np.ndarray:
    """How many pairs of the two are at each distance within some bits."""
    mask = _U(sum(1 << (BITS - 1 - b) for b in bits))
    out = np.zeros(len(bits) + 1, np.int64)
    for p in probes:
        out += np.bincount(np.bitwise_count((own ^ p) & mask), minlength=len(bits) + 1)
    return out


def bit_table(own: np.ndarray) -> np.ndarray:
    """How often two bits are both one, 64 x 64 (the diagonal: how often one is)."""
    x = np.unpackbits(own.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
    return (x.T @ x).round().astype(np.int64)


def numbers(frame: DataFrame, count) -> np.ndarray:
    """Sum over a frame's fingerprints of an array of numbers that ``count`` makes."""
    def of_task(batches):
        total = 0
        for batch in batches:
            own = batch.column(0).to_numpy().view(_U)
            for i in range(0, len(own), 1 << 16):
                total = total + count(own[i : i + (1 << 16)]).ravel()
        if not isinstance(total, int):
            yield pa.record_batch({"place": pa.array(range(len(total)), pa.int32()), "n": pa.array(total, pa.int64())})
    rows = frame.select("fp").mapInArrow(of_task, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).orderBy("place").collect()
    return np.array([r["n"] for r in rows], np.int64)


def plan(classes: DataFrame, radius: int = RADIUS, partitions=PARTITIONS) -> Plan:
    """Partitions and thresholds for a table of different fingerprints."""
    n = classes.count()
    ones = numbers(classes, bit_table)
    if n < 2:
        return Plan(grouped_bits(np.eye(BITS), radius + 1), [0] * (radius + 1))
    ones = ones.reshape(BITS, BITS) / n
    p = np.diag(ones)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    agree = (ones - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(agree, 0)
    probes = np.array([r["fp"] for r in classes.orderBy(F.xxhash64("fp"), "fp").limit(PROBED).collect()], np.int64).view(_U)
    options = [bits for m in partitions for bits in [grouped_bits(agree, m)]]
    flat = [bits for option in options for bits in option]
    found = numbers(classes, lambda own: np.concatenate([distances(own, probes, bits) for bits in flat]))
    at = np.cumsum([0, *(len(bits) + 1 for bits in flat)])
    chances = iter([np.cumsum(found[a:b]) / (n * len(probes)) for a, b in zip(at[:-1], at[1:])])
    best = None
    for option in options:
        costs = []
        for bits in option:
            near, own = next(chances), [0.0]
            for t in range(min(radius, len(bits)) + 1):
                own.append(PROBE_PRICE * sum(comb(len(bits), d) for d in range(t + 1)) + n * near[t])
            costs.append(own)
        cost, thresholds = allot(costs, radius)
        if best is None or cost < best[0]:
            best = (cost, Plan(option, thresholds))
    return best[1]


# --- probes -----------------------------------------------------------------------------
def masked(fp: Column, bits: list[int]) -> Column:
    mask = sum(1 << (BITS - 1 - b) for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))


def flips(bits: list[int], threshold: int) -> list[int]:
    """What to flip for every value within ``threshold`` of a partition's value."""
    out = [sum(1 << (BITS - 1 - b) for b in chosen) for d in range(threshold + 1) for chosen in combinations(bits, d)]
    return [x - (1 << 64) if x >= 1 << 63 else x for x in out]


def filed(classes: DataFrame, how: Plan) -> DataFrame:
    """part, value, fp of every class in every partition that is asked."""
    parts = F.array(*(F.struct(F.lit(i).alias("part"), masked(F.col("fp"), b).alias("value")) for i, b, _ in how.asked()))
    return classes.select("fp", F.explode(parts).alias("p")).select("p.part", "p.value", "fp")


def asking(classes: DataFrame, how: Plan) -> DataFrame:
    """part, value, fp of every value that a class asks beside its own."""
    out = classes.sparkSession.createDataFrame([], "part int, value bigint, fp bigint")
    for i, b, t in how.asked():
        if t > 0:
            others = F.from_json(F.lit(str(flips(b, t)[1:])), "array<bigint>")
            own = classes.select(F.lit(i).alias("part"), masked(F.col("fp"), b).alias("own"), F.explode(others).alias("flip"), "fp")
            out = out.union(own.select("part", F.col("own").bitwiseXOR(F.col("flip")).alias("value"), "fp"))
    return out


def forest(fps: np.ndarray, component: np.ndarray, bucket: np.ndarray, probe: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between different components within the buckets, filed with filed and
    probing with filed; each link that is returned joins two components, so they form
    a forest over the components of each bucket."""
    order = np.lexsort((fps, bucket))
    fps, component, bucket, probe = fps[order], component[order], bucket[order], probe[order]
    names, component = np.unique(component, return_inverse=True)
    root, x, y = np.arange(len(names)), [], []

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    left = np.arange(len(fps))
    for shift in range(1, len(fps)):
        left = left[left + shift < len(fps)]
        left = left[bucket[left] == bucket[left + shift]]
        if not len(left):
            break
        a, b = left, left + shift
        near = (component[a] != component[b]) & ~(probe[a] & probe[b])
        near[near] = np.bitwise_count(fps[a[near]] ^ fps[b[near]]) <= radius
        if not near.any():
            continue
        for i, j in zip(a[near].tolist(), b[near].tolist()):
            one, two = find(component[i]), find(component[j])
            if one != two:
                root[max(one, two)] = min(one, two)
                x.append(fps[i])
                y.append(fps[j])
        while (root[root] != root).any():
            root[:] = root[root]
        component = root[component]
    return np.array(x, _U), np.array(y, _U)


def cell(radius: int):
    def links(table: pa.Table) -> pa.Table:
        part = table.column("part").to_numpy().astype(np.int64)
        value = table.column("value").to_numpy()
        cut = table.column("cut").to_numpy().astype(np.int64)
        keys = np.lexsort((cut, value, part))
        new = np.ones(len(keys), bool)
        new[1:] = (np.diff(part[keys]) != 0) | (value[keys][1:] != value[keys][:-1]) | (np.diff(cut[keys]) != 0)
        bucket = np.empty(len(keys), np.int64)
        bucket[keys] = np.cumsum(new)
        x, y = forest(table.column("fp").to_numpy().view(_U), table.column("component").to_numpy(), bucket, table.column("probe").to_numpy(zero_copy_only=False), radius)
        return pa.table({"x": pa.array(x.view(np.int64)), "y": pa.array(y.view(np.int64))})
    return links


def link_components(classes: DataFrame, radius: int = RADIUS, how: Plan | None = None, cell_size: int = CELL) -> DataFrame:
    """node, component of all fingerprints that have a link."""
    how = how or plan(classes, radius)
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius
    places = B.written(filed(classes, how).withColumn("probe", F.lit(False)).union(asking(classes, how).withColumn("probe", F.lit(True))))
    # each value's least class first; its links are a forest already
    pivots = B.written(places.where("NOT probe").groupBy("part", "value").agg(F.min("fp").alias("pivot")))
    pairs = places.join(pivots, ["part", "value"]).where(F.col("fp") != F.col("pivot")).where(near("fp", "pivot")).select(F.col("fp").alias("x"), F.col("pivot").alias("y")).distinct()
    first = B.written(graph.components(pairs))
    B.discard(pivots)
    here = places.join(first.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    here = B.written(here)
    B.discard(places)
    # values under which different components meet, one of them filed there
    open_values = here.groupBy("part", "value").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), F.bool_or(~F.col("probe")).alias("any"))
    open_values = B.written(open_values.where("lo <> hi AND any").select("part", "value", F.ceil(F.col("n") / cell_size).cast("int").alias("cuts")))
    met = here.join(open_values, ["part", "value"])
    own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    dealt = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    dealt = B.written(dealt.select("part", "value", (F.least("own", "other") * F.col("cuts") + F.greatest("own", "other")).cast("bigint").alias("cut"), "fp", "component", "probe"))
    B.discard(here, open_values)
    buckets = max(1, -(-dealt.count() // BUCKET_ROWS) * 8)
    grouped = dealt.withColumn("bucket", F.pmod(F.xxhash64("part", "value", "cut"), F.lit(buckets)))
    more = grouped.groupBy("bucket").applyInArrow(B.alone(cell(radius)), "x bigint, y bigint").distinct()
    edges = first.select(F.col("node").alias("x"), F.col("component").alias("y")).union(more)
    return graph.components(edges.where("x <> y"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS, how: Plan | None = None, cell_size: int = CELL) -> DataFrame:
    """key, fp (the fingerprint's bits as a long) and component (the least key that links
    reach) of every row of ``docs``."""
    def of_task(batches):
        for batch in batches:
            yield pa.record_batch({"key": batch.column(0), "fp": pa.array(fingerprint(batch.column(1), words).view(np.int64))})

    own = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    prints = B.written(own.mapInArrow(of_task, "key bigint, fp bigint"))
    classes = B.written(prints.where("key IS NOT NULL").groupBy("fp").agg(F.min("key").alias("least")))
    found = link_components(classes, radius, how, cell_size).withColumnRenamed("node", "fp")
    whole = classes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = whole.groupBy("component").agg(F.min("least").alias("number"))
    named = whole.join(least, "component").select("fp", "number")
    return prints.join(named, "fp", "left").select("key", "fp", F.when(F.col("key").isNotNull(), F.col("number")).alias("component"))
