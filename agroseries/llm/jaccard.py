"""Jaccard join of word n-gram sets by vertical partitioning, to components of links.

1. *Sets.*  Blocks of documents ask which of their n-grams other documents have.  A
   document fewer than ``percent`` of whose n-grams occur elsewhere can link with
   nothing; only the others go on, with the n-grams that occur elsewhere.
2. *Classes.*  Documents with equal sets form a class; one entry stands for it.
3. *Global order.*  n-grams by number of classes that have them, rare ones first.
   Two linked classes share an n-gram within their prefixes (the first
   n - ceil(t * n) + 1), so classes meet only under prefix n-grams and only with sizes
   and places that allow the threshold.
4. *Fragments.*  The global order is cut into fragments.  For the candidate pairs, the
   overlap is counted in every fragment by itself, in cells of (fragment, range of
   left classes), and summed per pair.
5. *Rounds.*  Classes under one n-gram are first compared with one pivot per size band
   only; what links with a pivot is in one component, and pairs inside a component
   need no count.  Pairs between different components under one n-gram are all counted
   in the last round, so no link that joins two components is lost, and a group of
   copies costs as many pairs as it has members.

Components are found by alternating star contraction.

Defined results: null text and text without words have no n-grams and link with
nothing; rows without a key take no part (component null); rows that share a key are
documents of their own that have that number; a text shorter than ``n`` words has its
whole sequence as its one n-gram.  n-grams and classes are told apart by 64-bit
fingerprints.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B

N = 5
PERCENT = 75
FRAGMENTS = 4
BITMAP = 16  # words of 64 bits
PAIRS_IN_CELL = 40_000
PIVOT_ROUNDS = 2
KEY_BYTES = 6
ASKED = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("data", pa.binary()), ("more", pa.binary())])
TOLD = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("data", pa.binary())])
SETS = pa.schema([("key", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("sum", pa.int64()), ("xor", pa.int64()), ("grams", pa.list_(pa.int64()))])


def gram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Per text, the sorted different hashes of its word n-grams."""
    out = []
    for a, count in B.slices(texts):
        words = B.Words(texts.slice(a, count), lower=True)
        start, grams = B.windows(words.hash, words.doc, n)
        at = np.searchsorted(start, words.range)
        sums = B.prefix(words.hash)
        few = B.span(sums, words.range[:-1], words.range[1:])
        for d in range(count):
            size = words.range[d + 1] - words.range[d]
            if size >= n:
                out.append(B.unique(grams[at[d] : at[d + 1]]))
            else:
                out.append(few[d : d + 1] + np.uint64(size) if size else grams[:0])
    return out


class Sets(NamedTuple):
    key: str
    text: str
    block: str
    n: int
    percent: int
    buckets: int

    def ask(self, table: pa.Table) -> pa.Table:
        every = np.sort(np.concatenate(gram_sets(B.flat(table.column(self.text)), self.n)))
        cuts = B.grouped(every)
        grams, several = every[cuts[:-1]], np.diff(cuts) > 1
        block = table.column(self.block)[0].as_py()
        return B.as_table([(b, block, B.planes(grams[lo:hi], KEY_BYTES), B.bits(several[lo:hi])) for b, lo, hi in B.by_bucket(grams, self.buckets)], ASKED)

    def tell(self, table: pa.Table) -> pa.Table:
        keys = [B.from_planes(x, KEY_BYTES) for x in table.column("data").to_pylist()]
        several = [k[B.from_bits(x, len(k))] for k, x in zip(keys, table.column("more").to_pylist())]
        every = np.sort(np.concatenate([*(B.unique(k) for k in keys), *several]))
        again = B.unique(every[1:][every[1:] == every[:-1]])
        bucket = table.column("bucket")[0].as_py()
        flags = ((b, B.within(again, k)) for b, k in zip(table.column("block").to_pylist(), keys))
        return B.as_table([(bucket, b, B.bits(f)) for b, f in flags if f.any()], TOLD)

    def sets(self, table: pa.Table, told: pa.Table) -> pa.Table:
        """Every document's size and sums; the shared n-grams where enough are."""
        if not len(table):
            return SETS.empty_table()
        own = gram_sets(B.flat(table.column(self.text)), self.n)
        every = B.unique(np.concatenate(own))
        shared = B.flags_for(every, self.buckets, {b: (d,) for b, d in zip(told.column("bucket").to_pylist(), told.column("data").to_pylist())})
        sizes = np.array([len(x) for x in own])
        sums = np.array([x.sum() if len(x) else 0 for x in own], np.uint64)
        xors = np.array([np.bitwise_xor.reduce(x) if len(x) else 0 for x in own], np.uint64)
        keys = table.column(self.key)
        known = np.asarray(keys.is_valid())
        grams = []
        for x, k in zip(own, known):
            x = x[shared[np.searchsorted(every, x)]] if k else x[:0]
            grams.append((x, bool(k) and len(x) > 0))
        kept = [x if use and 100 * len(x) >= self.percent * n else None for (x, use), n in zip(grams, sizes)]
        offsets = np.cumsum([0, *(0 if x is None else len(x) for x in kept)])
        values = np.concatenate([np.zeros(0, np.uint64), *(x for x in kept if x is not None)]).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values), mask=pa.array([x is None for x in kept]))
        return pa.table([keys.combine_chunks(), table.column("row").combine_chunks(), pa.array(sizes, pa.int64()), pa.array(sums.view(np.int64)), pa.array(xors.view(np.int64)), lists], schema=SETS)


def reaches(overlap: Column, left: Column, right: Column, percent: int) -> Column:
    """overlap / union >= percent / 100, in integers."""
    return (100 + percent) * overlap >= percent * (left + right)


def ordered(sets: DataFrame, percent: int) -> DataFrame:
    """One row per class that can link: rep, n, own (n-grams no other class has),
    grams (struct of number of classes and hash, in the global order)."""
    alike = ["rep", "n"]
    classes = sets.where("grams IS NOT NULL").groupBy(alike).agg(F.min("key").alias("key"))
    reps = sets.join(classes, [*alike, "key"], "left_semi").dropDuplicates(alike)
    grams = reps.select("rep", "n", F.explode("grams").alias("g"))
    often = grams.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    rows = grams.join(often, "g").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("grams"))
    rows = rows.where(100 * F.size("grams") >= percent * F.col("n")).withColumn("own", F.col("n") - F.size("grams"))

    @F.arrow_udf("array<bigint>")
    def bitmap(lists: pa.Array) -> pa.Array:
        out = np.zeros((len(lists), BITMAP), np.uint64)
        values, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            own = B.mix(values[a:b])
            np.bitwise_xor.at(out[i], (own >> np.uint64(6)).astype(np.int64) % BITMAP, np.uint64(1) << (own & np.uint64(63)))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * BITMAP), pa.array(out.ravel().view(np.int64)))

    return rows.withColumn("bits", bitmap(F.col("grams")["g"]))


def prefixes(classes: DataFrame, percent: int) -> DataFrame:
    """g, rep, n, place (0 for the first) and size band of prefix n-grams."""
    least = F.ceil(F.col("n") * percent / 100.0)
    room = (F.col("n") - least + 1 - F.col("own")).cast("int")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    taken = classes.where(room > 0).select("rep", "n", "own", "bits", band.alias("band"), F.posexplode(F.slice("grams", 1, F.greatest(room, F.lit(1)))).alias("i", "x"))
    return taken.select(F.col("x.g").alias("g"), "rep", "n", (F.col("own") + F.col("i")).alias("place"), "band", "own", "bits")


def may_link(percent: int) -> Column:
    """Of two entries x and y under one n-gram, taken as the first that they share:
    bounds by size, by place and by the number of n-grams that only one of them has."""
    most = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    sizes = (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
    # n-grams of which only one has an odd number in a bit of the bitmap are not shared
    apart = " + ".join(["x.own", "y.own", *(f"bit_count(x.bits[{i}] ^ y.bits[{i}])" for i in range(BITMAP))])
    differ = F.expr(f"{100 + percent} * ({apart}) <= {100 - percent} * (x.n + y.n)")
    return sizes & reaches(most, F.col("x.n"), F.col("y.n"), percent) & differ


def fragment_overlap(right: pa.Table, left: pa.Table) -> pa.Table:
    """Of one cell: the pairs' overlap within a fragment."""
    segment = {r: s.values.to_numpy() for r, s in zip(right.column("rep").to_pylist(), right.column("segment").combine_chunks())}
    none = np.zeros(0, np.int64)
    x, y = left.column("x").to_pylist(), left.column("y").to_pylist()
    marked, last, n = None, None, []
    for a, b in zip(x, y):
        if a != last:
            marked, last = np.sort(segment.get(a, none)), a
        own = segment.get(b, none)
        n.append(int(B.within(marked, own).sum()))
    return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64()), "overlap": pa.array(n, pa.int64())})


def between(low: int | None, high: int | None) -> Column:
    """The n-grams of one fragment of the global order."""
    def inside(s):
        return (F.lit(True) if low is None else s["df"] > low) & (F.lit(True) if high is None else s["df"] <= high)

    return F.transform(F.filter("grams", inside), lambda s: s["g"])


def links(pairs: DataFrame, n: int, classes: DataFrame, percent: int) -> DataFrame:
    """Those of n pairs (x, y, with sizes nx, ny) that reach the threshold."""
    cells = max(1, -(-n // PAIRS_IN_CELL))
    # cuts of the global order: quantiles of its leading term, the number of classes
    cuts = classes.select(F.explode("grams.df").alias("df")).agg(F.percentile_approx("df", [i / FRAGMENTS for i in range(1, FRAGMENTS)]).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    celled = pairs.withColumn("cell", F.pmod(F.xxhash64("x"), F.lit(cells)).cast("int"))
    needed = celled.select("cell", F.col("x").alias("rep")).union(celled.select("cell", F.col("y").alias("rep"))).distinct()
    bounds = [None, *cuts, None]
    parts = [F.struct(F.lit(i).alias("fragment"), between(lo, hi).alias("segment")) for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:]))]
    segments = needed.join(classes.select("rep", "grams"), "rep").select("cell", "rep", F.explode(F.array(*parts)).alias("p")).select(F.col("cell").alias("cell"), "rep", "p.fragment", "p.segment").where(F.size("segment") > 0)
    asked = celled.select("cell", "x", "y", F.explode(F.array(*(F.lit(i) for i in range(len(parts))))).alias("fragment"))
    counted = segments.groupBy("cell", "fragment").cogroup(asked.groupBy("cell", "fragment")).applyInArrow(fragment_overlap, "x bigint, y bigint, overlap bigint")
    total = counted.groupBy("x", "y").agg(F.sum("overlap").alias("overlap"))
    return total.join(pairs, ["x", "y"]).where(reaches(F.col("overlap"), F.col("nx"), F.col("ny"), percent)).select("x", "y")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node), of all nodes that have an edge; by
    alternating large-star and small-star steps until every node hangs on its root."""
    def least(near):
        low = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        return near.join(low, "u"), low

    def star(e):
        moved, _ = least(e.union(e.select("y", "x")).toDF("u", "v"))
        large = moved.where("v > u").select(F.col("v").alias("x"), F.col("m").alias("y")).where("x <> y")
        moved, low = least(large.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")))
        return moved.select(F.col("v").alias("x"), F.col("m").alias("y")).union(low.select("u", "m")).where("x <> y").distinct()

    state = B.kept(edges.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    while True:
        state = B.kept(star(state))
        # done when no parent is a child and every child has one parent
        twice = state.groupBy("x").agg(F.count("*").alias("n"), F.lit(False).alias("p")).union(state.select("y", F.lit(0).alias("n"), F.lit(True)).distinct())
        if not twice.groupBy("x").agg(F.sum("n").alias("n"), F.max("p").alias("p")).where("n > 1 OR (n > 0 AND p)").limit(1).count():
            break
    roots = state.select(F.col("y").alias("node")).distinct()
    return state.select(F.col("x").alias("node"), F.col("y").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def with_components(index: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return index.withColumn("component", F.col("rep"))
    return index.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def link_components(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """node, component of all classes that have a link."""
    index, found = B.kept(prefixes(classes, percent)), None
    for step in range(PIVOT_ROUNDS + 1):
        here = with_components(index, found)
        # only n-grams under which different components still meet
        open_grams = here.groupBy("g").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("g")
        here = here.join(open_grams, "g")
        if step < PIVOT_ROUNDS:
            # one pivot for each n-gram and size band: first one for many, then each its own
            pick = F.struct(F.xxhash64("rep", "g").alias("o") if step else F.col("rep").alias("o"), "rep", "n", "place", "component", "own", "bits")
            pivots = here.groupBy("g", "band").agg(F.min(pick).alias("p")).select("g", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band"), "p.rep", "p.n", "p.place", "p.component", "p.own", "p.bits")
            met = here.alias("x").join(pivots.alias("y"), ["g", "band"])
        else:
            met = here.alias("x").join(here.alias("y"), "g").where("x.rep < y.rep")
        met = met.where(F.col("x.component") != F.col("y.component")).where(may_link(percent))
        low = F.col("x.rep") < F.col("y.rep")
        pairs = B.kept(met.select(F.least("x.rep", "y.rep").alias("x"), F.greatest("x.rep", "y.rep").alias("y"),
                                  F.when(low, F.col("x.n")).otherwise(F.col("y.n")).alias("nx"), F.when(low, F.col("y.n")).otherwise(F.col("x.n")).alias("ny")).distinct())
        n = pairs.count()
        fresh = B.kept(links(pairs, n, classes, percent)) if n else None
        if fresh is not None and fresh.limit(1).count():
            edges = fresh if found is None else found.select(F.col("node").alias("x"), F.col("component").alias("y")).union(fresh)
            found = B.kept(components(edges))
        del here, open_grams, met, pairs, fresh
        B.settle(classes.sparkSession)
    return found if found is not None else classes.sparkSession.createDataFrame([], "node bigint, component bigint")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """For every row: key, row (hash of its text), n_shingles, component (the least
    key that links reach) and, where it may link, group (the component's own number)."""
    size = B.text_bytes(docs, text)
    own = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    dealt, block = B.blocked(own, "key", "text", size)
    s = Sets("key", "text", block, n, percent, B.buckets_for(size))
    told = dealt.groupBy(block).applyInArrow(B.alone(s.ask), "bucket int, block int, data binary, more binary").groupBy("bucket").applyInArrow(B.alone(s.tell), "bucket int, block int, data binary")
    sets = dealt.groupBy(block).cogroup(told.groupBy("block")).applyInArrow(B.paired(s.sets), "key bigint, row bigint, n bigint, sum bigint, xor bigint, grams array<bigint>")
    sets = B.written(sets.withColumn("rep", F.when(F.col("grams").isNotNull(), F.xxhash64("n", "sum", "xor"))).drop("sum", "xor"))
    del own, dealt, told  # nor are the shuffles of whole texts and questions, once no plan holds them
    B.settle(docs.sparkSession)
    classes = B.written(ordered(sets, percent))
    B.settle(docs.sparkSession)
    found = link_components(classes, percent)
    B.discard(classes)
    members = sets.where("rep IS NOT NULL").groupBy("rep").agg(F.min("key").alias("key"))
    grouped = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "key", F.coalesce("component", "rep").alias("group"))
    least = grouped.groupBy("group").agg(F.min("key").alias("component"))
    labelled = grouped.select("rep", "group").join(least, "group")
    # what the result reads is small; the n-grams are not kept
    named = B.written(labelled)
    own = B.written(sets.select("key", "row", "n", "rep"))
    B.discard(sets)
    del found, members, grouped, least, labelled
    B.settle(docs.sparkSession)
    out = own.join(named, "rep", "left")
    return out.select("key", "row", F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component"), "group")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component, the one of the least key (and least
    hash of its text); rows without a key stay."""
    found = B.kept(join(docs, key, text, n, percent).where(F.col("group").isNotNull()).select("key", "row", "group"))
    best = found.groupBy("group").agg(F.min(F.struct("key", "row")).alias("best"))
    others = found.join(best, "group").where(F.struct("key", "row") != F.col("best")).select("key", "row").distinct()
    number, place = B.fresh(docs, "row"), B.fresh(docs, "place")
    others = others.select(F.col("key").alias(B.fresh(docs, "key_of")), F.col("row").alias(B.fresh(docs, "row_of")))
    a, b = others.columns
    marked = docs.withColumn(number, F.xxhash64(text))
    left = marked.join(others, (F.col(key).cast("long") == F.col(a)) & (F.col(number) == F.col(b)), "left_anti")
    if found.groupBy("key", "row").count().where("count > 1").limit(1).count():  # a row that occurs twice
        order = Window.partitionBy(key, number).orderBy(number)
        left = left.withColumn(place, F.row_number().over(order)).where(F.col(key).isNull() | (F.col(place) == 1)).drop(place)
    return left.drop(number)
