"""Divergence of the sources of a language, from run-length encoded columns.

Every (language, source) group gives each term of the language's vocabulary a share in
parts of a thousand million; the triangular divergence of two groups is the sum of
(p - q)^2 / (p + q), rounded down term by term, over the whole vocabulary.

1. *Counts.*  Each task counts its terms by (group, term), with the documents that
   have them; one shuffle by (language, term) adds up, keeps the terms that enough
   documents of the language have, and gives their totals.
2. *Order.*  The vocabulary is reordered so that equal counts stand together: by the
   counts in the language's ``LEADING`` largest sources, then by a hash of all counts
   of the term, so that terms with the same counts everywhere are neighbours.  The
   order is cut into chunks of ``CHUNK`` terms by range partitioning.
3. *Columns.*  In each chunk a group's column of counts, zeros included, is run-length
   encoded.
4. *Pairs.*  Sources are dealt into blocks by a hash; a task holds two blocks of one
   chunk, intersects the run boundaries of each pair of columns and multiplies the
   term's divergence by the length.  Sums over the chunks give the pairs.

The order only decides how many runs there are: it never changes a result.

Defined results: null text, language and source are ''; a text without terms still
makes its group occur; in a language without vocabulary each pair has the value 0; a
language with one source has no pairs; equal rows are documents of their own.  Other
columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B

LEAST_DOCS = 10
TOP_TERMS = 10
SCALE_STEPS = 3  # a thousand, three times
LEADING = 8
CHUNK = 1 << 16
SOURCES_IN_BLOCK = 32
ROWS_HELD = 500_000
COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("docs", pa.int64())])
COLUMN = pa.schema([("lang", pa.string()), ("source", pa.string()), ("chunk", pa.int32()), ("starts", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
PAIRS = pa.schema([("lang", pa.string()), ("x", pa.string()), ("y", pa.string()), ("value", pa.int64())])

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of a slice of texts, and the text that each belongs to."""
    raw, at = B.bytes_of(texts)
    inside = _LETTER[raw]
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    before[at[:-1][at[:-1] < len(raw)]] = False
    start = np.flatnonzero(inside & ~before)
    letters = B.lower(raw[inside])
    offsets = np.append(np.cumsum(inside)[start] - 1, len(letters)).astype(np.int64)
    terms = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return terms, np.searchsorted(at, start, side="right") - 1


def count_slice(texts: pa.Array, group: np.ndarray) -> pa.Table:
    """group, term, count, docs of a slice of texts."""
    terms, doc = terms_of(texts)
    coded = terms.dictionary_encode()
    code, n = coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
    pairs = np.sort(doc * n + code)
    cuts = B.grouped(pairs)
    first, times = pairs[cuts[:-1]], np.diff(cuts)
    key = group[first // n] * n + first % n
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    cuts = B.grouped(key)
    own = key[cuts[:-1]]
    count = np.add.reduceat(times, cuts[:-1]) if len(own) else times
    return pa.table({"group": own // n, "term": coded.dictionary.take(pa.array(own % n)), "count": count, "docs": np.diff(cuts)})


def summed(tables: list[pa.Table]) -> pa.Table:
    own = pa.concat_tables(tables).group_by(["group", "term"]).aggregate([("count", "sum"), ("docs", "sum")])
    return own.select(["group", "term", "count_sum", "docs_sum"]).rename_columns(["group", "term", "count", "docs"])


def count_terms(batches):
    """lang, source, term, count, docs of what a task reads, summed as far as memory allows."""
    number, names, held, rows = {}, [], [], 0

    def out():
        whole = summed(held)
        group = whole.column("group").combine_chunks()
        langs, sources = (pa.array([x[i] for x in names], pa.string()).take(group) for i in (0, 1))
        terms = whole.column("term").combine_chunks().cast(pa.large_string()).cast(pa.string())
        return pa.table([langs, sources, terms, whole.column("count").combine_chunks(), whole.column("docs").combine_chunks()], schema=COUNTED).to_batches(50_000)

    for batch in batches:
        texts = B.flat(batch.column("text"))
        pairs = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
        for x in pairs:
            if x not in number:
                number[x] = len(names)
                names.append(x)
        group = np.array([number[x] for x in pairs], np.int64)
        for a, n in B.slices(texts):
            found = count_slice(texts.slice(a, n), group[a : a + n])
            held.append(found)
            rows += len(found)
            if rows > ROWS_HELD:
                held = [summed(held)]
                rows = len(held[0])
                if rows > ROWS_HELD // 2:
                    yield from out()
                    held, rows = [], 0
    if held:
        yield from out()


def counted(docs: DataFrame, lang: str, source: str, text: str, least_docs: int) -> DataFrame:
    """lang, source, term, count, total (of the language) of the terms that are kept."""
    own = docs.select(*(F.coalesce(c, F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    parts = own.mapInArrow(count_terms, "lang string, source string, term string, count bigint, docs bigint")
    sums = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    every = sums.withColumns({"total": F.sum("count").over(term), "in_docs": F.sum("docs").over(term)})
    return every.where(F.col("in_docs") >= least_docs).select("lang", "source", "term", "count", "total")


def share(count: Column, n: Column) -> Column:
    """1 + floor(1000^3 * (count + 2) / n), a thousand at a time: no product leaves 64 bits."""
    rest, part = count + 2, F.lit(0).cast("long")
    for _ in range(SCALE_STEPS):
        part = part * 1000 + F.call_function("div", rest * 1000, n)
        rest = F.call_function("mod", rest * 1000, n)
    return part + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(counts: np.ndarray, n: int) -> np.ndarray:
    """``share`` for an array."""
    rest, part = counts + 2, np.zeros(len(counts), np.int64)
    for _ in range(SCALE_STEPS):
        part = part * 1000 + rest * 1000 // n
        rest = rest * 1000 % n
    return part + 1


def encode(table: pa.Table) -> pa.Table:
    """One column of a chunk: starts and counts of its runs; places without a row are 0."""
    place, count = (table.column(c).to_numpy().astype(np.int64) for c in ("place", "count"))
    length = table.column("length")[0].as_py()
    column = np.zeros(length, np.int64)
    column[place] = count
    cuts = B.grouped(column)[:-1]
    first = {c: table.column(c)[0].as_py() for c in ("lang", "source", "chunk")}
    return pa.Table.from_pylist([{**first, "starts": cuts.tolist(), "counts": column[cuts].tolist()}], schema=COLUMN)


def meet(table: pa.Table) -> pa.Table:
    """Divergence of the pairs of two blocks' columns in one chunk."""
    lang, length = table.column("lang")[0].as_py(), table.column("length")[0].as_py()
    a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
    own = []
    for source, block, n, starts, counts in zip(*(table.column(c).to_pylist() for c in ("source", "block", "n", "starts", "counts"))):
        counts = np.array(counts, np.int64)
        own.append((source.encode(), block, np.array(starts, np.int64), shares(counts, n) if len(counts) else counts))
    own.sort(key=lambda x: x[0])
    x, y, value = [], [], []
    for i, (one, block, at, p) in enumerate(own):
        for other, block_, at_, q in own[i + 1 :]:
            if a != b and block == block_:
                continue
            edges = np.union1d(at, at_)
            p_, q_ = p[np.searchsorted(at, edges, side="right") - 1], q[np.searchsorted(at_, edges, side="right") - 1]
            f = (p_ - q_) ** 2 // (p_ + q_)
            x.append(one.decode())
            y.append(other.decode())
            value.append(int((f * np.diff(np.append(edges, length))).sum()))
    return pa.table([pa.array([lang] * len(x), pa.string()), pa.array(x, pa.string()), pa.array(y, pa.string()), pa.array(value, pa.int64())], schema=PAIRS)


def placed(kept: DataFrame, sizes: DataFrame, chunk_terms: int) -> DataFrame:
    """lang, term, chunk, place, length: the vocabulary in its order, cut into chunks."""
    order = Window.partitionBy("lang").orderBy(F.desc("count"), "source")
    leading = sizes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= LEADING).select("lang", "source", "place")
    signature = F.bit_xor(F.xxhash64("source", "count")).alias("signature")
    columns = [F.max(F.when(F.col("place") == i + 1, F.col("count"))).alias(f"c{i}") for i in range(LEADING)]
    vocabulary = B.written(kept.join(leading, ["lang", "source"], "left").groupBy("lang", "term").agg(*columns, signature))
    by = [*(f"c{i}" for i in range(LEADING)), "signature", "term"]
    chunks = max(1, -(-vocabulary.count() // chunk_terms))
    cut = B.written(vocabulary.repartitionByRange(chunks, "lang", *by).withColumn("chunk", F.spark_partition_id()))
    own = Window.partitionBy("lang", "chunk")
    return cut.select("lang", "term", "chunk", (F.row_number().over(own.orderBy(*by)) - 1).alias("place"), F.count("*").over(own).alias("length"))


def pairs(kept: DataFrame, groups: DataFrame, sizes: DataFrame, chunk_terms: int = CHUNK, in_block: int = SOURCES_IN_BLOCK) -> DataFrame:
    """lang, x, y (x before y), value of every two sources of a language."""
    order = B.written(placed(kept, sizes, chunk_terms))
    cells = kept.select("lang", "source", "term", "count").join(order, ["lang", "term"])
    columns = cells.groupBy("lang", "source", "chunk").applyInArrow(B.alone(encode), "lang string, source string, chunk int, starts array<int>, counts array<bigint>")
    chunks = order.groupBy("lang", "chunk").agg(F.max("length").alias("length"))
    number = groups.groupBy("lang").agg(F.ceil(F.count("*") / in_block).cast("int").alias("blocks"))
    spine = groups.join(number, "lang").join(chunks, "lang", "left").select(
        "lang", "source", F.coalesce("chunk", F.lit(0)).alias("chunk"), F.coalesce("length", F.lit(0)).alias("length"), "n", "blocks",
        F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block"))
    none = F.when(F.col("length") > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    full = spine.join(columns, ["lang", "source", "chunk"], "left").withColumns({"starts": F.coalesce("starts", none), "counts": F.coalesce("counts", none.cast("array<bigint>"))})
    dealt = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")})
    parts = dealt.groupBy("lang", "chunk", "a", "b").applyInArrow(B.alone(meet), "lang string, x string, y string, value bigint")
    return parts.groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS,
          chunk_terms: int = CHUNK, in_block: int = SOURCES_IN_BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank.  Part ``pair``: every other source of the
    language and its divergence.  Part ``term``: the ``top`` terms that the source has
    more of than its language, by their share of the divergence."""
    kept = B.written(counted(docs, lang, source, text, least_docs))
    sizes = kept.groupBy("lang", "source").agg(F.sum("count").alias("count"))
    langs = kept.groupBy("lang").agg(F.sum("count").alias("words")).join(
        kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("terms")), "lang")
    occurring = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source")).distinct()
    groups = occurring.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", F.coalesce("words", F.lit(0)).alias("words"), F.coalesce("terms", F.lit(0)).alias("terms"),
        (F.coalesce("count", F.lit(0)) + 2 * F.coalesce("terms", F.lit(0))).alias("n"))
    groups = B.written(groups)
    found = B.written(pairs(kept, groups.select("lang", "source", "n"), sizes, chunk_terms, in_block))
    both = found.select("lang", F.col("x").alias("source"), F.col("y").alias("item"), "value").union(found.select("lang", "y", "x", "value"))
    of_terms = kept.join(groups.select("lang", "source", "n", (F.col("words") + 2 * F.col("terms")).alias("n_all")), ["lang", "source"])
    of_terms = of_terms.select("lang", "source", F.col("term").alias("item"), share(F.col("count"), F.col("n")).alias("p"), share(F.col("total"), F.col("n_all")).alias("q"))
    of_terms = of_terms.where("p > q").select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    shape = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shape(both.withColumn("rank", rank), "pair").union(shape(of_terms.withColumn("rank", rank).where(F.col("rank") <= top), "term"))
