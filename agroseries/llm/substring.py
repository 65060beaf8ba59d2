"""Removal of repeated word windows by compacting a de Bruijn graph.

A run of ``k`` words is an edge from its first k-1 words to its last k-1.  Edges
that occur again are what has to go, but for their first occurrence.

1. *Candidates.*  Every window of k words has one anchor, its gram of ``gram`` words
   with the least hash; only windows whose anchor occurs again can occur again.  A
   document whose words are those of an earlier one is a copy and goes whole.
2. *Edges.*  Blocks of documents send each different candidate edge once: how often
   it occurs, its first source coordinate (document, start) and the edge that always
   follows it, if there is one.  The owners of the hashes keep the repeated ones.
3. *Compaction.*  Where e is always followed by f and both occur equally often, each
   f comes after an e: there the path does not branch, and the first occurrences of e
   and f are neighbours.  So each nonbranching path is a run of first coordinates; it
   is compacted to its head, its length and a fingerprint.
4. *Join.*  Path heads are joined with the blocks that hold them.  At each further
   source coordinate of a head the whole span is verified against the fingerprint
   and removed.

One entry per block and edge is shuffled, never the occurrences of one edge
together; hot edges cost a block one entry.  Edges are told apart by 64-bit hashes.

Defined results: null text has no words; rows without a key take no part (kept
whole); windows of rows that share a key at the same start are not earlier than
each other; fewer than k words are kept whole; other columns pass by.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B

K = 20
GRAM = 10
STRETCH = 16_384
KEY_BYTES = 6  # of an anchor's hash; a clash only costs work
ASKED = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("data", pa.binary()), ("more", pa.binary())])
TOLD = pa.schema([("step", pa.int32()), ("bucket", pa.int32()), ("block", pa.int32()), ("data", pa.binary())])
EDGES = pa.schema([("id", pa.int64()), ("start", pa.int32()), ("edge", pa.int64()), ("next", pa.int64()), ("n", pa.int64())])


class Slice(NamedTuple):
    """Words of consecutive texts; windows of k words with their anchors."""

    words: B.Words
    ids: np.ndarray    # documents' keys
    rows: np.ndarray   # their places in the block
    whole: np.ndarray  # hash of all words of a document, with their number
    start: np.ndarray  # first word of each window
    edge: np.ndarray   # its hash
    anchor: np.ndarray
    place: np.ndarray  # of the anchor


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, each as byte planes."""
    return b"".join(B.planes(np.asarray(a).astype(np.uint64)) for a in arrays)


def unpacked(data: bytes, n: int) -> list[np.ndarray]:
    size = len(data) // n
    return [B.from_planes(data[i * size : (i + 1) * size]) for i in range(n)]


@dataclass(frozen=True)
class Graph:
    key: str
    text: str
    block: str
    k: int
    gram: int
    buckets: int

    # ---- what a block knows by itself

    def slices(self, table: pa.Table) -> list[Slice]:
        valid = np.asarray(table.column(self.key).is_valid())
        places = np.flatnonzero(valid)
        table = table.filter(pa.array(valid))
        texts, ids = B.flat(table.column(self.text)), table.column(self.key).to_numpy()
        out = []
        for a, n in B.slices(texts):
            words = B.Words(texts.slice(a, n))
            sums = B.prefix(words.hash)
            whole = B.span(sums, words.range[:-1], words.range[1:]) + np.diff(words.range).astype(np.uint64)
            start, edge = B.windows(words.hash, words.doc, self.k)
            grams = B.rolling(words.hash, self.gram)
            place = B.lowest(grams, self.k - self.gram + 1)[start] if len(start) else start
            out.append(Slice(words, ids[a : a + n], places[a : a + n], whole, start, edge, B.mix(grams[place]), place))  # least hashes are small: spread them
        return out

    def long_enough(self, s: Slice) -> np.ndarray:
        return np.diff(s.words.range) >= self.k

    def documents(self, parts: list[Slice]) -> tuple[np.ndarray, np.ndarray]:
        """Different word sequences and the least key of each."""
        return B.least(joined([s.whole[self.long_enough(s)] for s in parts]), joined([s.ids[self.long_enough(s)] for s in parts], np.int64))

    def copies(self, parts: list[Slice], told: dict) -> list[np.ndarray]:
        """By slice: documents whose words are those of an earlier document."""
        known, first = self.documents(parts)
        seen = B.flags_for(known, self.buckets, told.get(1, {}), shift=self.buckets)
        out = []
        for s in parts:
            copy = self.long_enough(s)
            place = np.searchsorted(known, s.whole[copy])
            copy[copy] = seen[place] | (first[place] < s.ids[copy])
            out.append(copy)
        return out

    def candidates(self, parts: list[Slice], told: dict, copies: list[np.ndarray]) -> list[np.ndarray]:
        """By slice: windows that may occur again and lie in no copy."""
        anchors = B.unique(joined([s.anchor for s in parts]))
        flags = B.flags_for(anchors, self.buckets, told.get(1, {}))
        return [flags[np.searchsorted(anchors, s.anchor)] & ~copy[s.words.doc[s.start]] for s, copy in zip(parts, copies)]

    # ---- questions and answers

    def ask_anchors(self, table: pa.Table) -> pa.Table:
        parts = self.slices(table)
        rows, block = [], table.column(self.block)[0].as_py()
        # an anchor counts as often as it is chosen at different places
        places = []
        for s in parts:
            fresh = np.ones(len(s.anchor), bool)
            fresh[1:] = s.place[1:] != s.place[:-1]
            places.append(s.anchor[fresh])
        every = np.sort(joined(places))
        cuts = B.grouped(every)
        anchors, several = every[cuts[:-1]], np.diff(cuts) > 1
        for b, lo, hi in B.by_bucket(anchors, self.buckets):
            rows.append((b, block, B.planes(anchors[lo:hi], KEY_BYTES), B.bits(several[lo:hi])))
        known, first = self.documents(parts)
        for b, lo, hi in B.by_bucket(known, self.buckets):
            rows.append((b + self.buckets, block, B.planes(known[lo:hi]), packed(first[lo:hi])))
        return B.as_table(rows, ASKED)

    def tell_anchors(self, table: pa.Table) -> pa.Table:
        bucket, blocks, data, more = columns(table)
        if bucket < self.buckets:
            keys = [B.from_planes(x, KEY_BYTES) for x in data]
            every = np.sort(np.concatenate([*(B.unique(k) for k in keys), *(k[B.from_bits(x, len(k))] for k, x in zip(keys, more))]))
            again = B.unique(every[1:][every[1:] == every[:-1]])
            flags = [B.within(again, k) for k in keys]
        else:
            keys, ids = [B.from_planes(x) for x in data], [unpacked(x, 1)[0].astype(np.int64) for x in more]
            known, first = B.least(np.concatenate(keys), np.concatenate(ids))
            flags = [first[np.searchsorted(known, k)] < i for k, i in zip(keys, ids)]
        return B.as_table([(1, bucket, b, B.bits(f)) for b, f in zip(blocks, flags) if f.any()], TOLD)

    def ask_edges(self, table: pa.Table, told: pa.Table) -> pa.Table:
        if not len(table) or not len(told):
            return ASKED.empty_table()
        parts, answers = self.slices(table), by_step(told)
        edge, after, ids, at = [], [], [], []
        for s, chosen in zip(parts, self.candidates(parts, answers, self.copies(parts, answers))):
            follows = np.zeros(len(s.edge), np.uint64)  # 0: the document ends
            if len(s.edge):
                follows[:-1] = np.where(s.start[1:] == s.start[:-1] + 1, s.edge[1:], np.uint64(0))
            doc = s.words.doc[s.start[chosen]]
            edge.append(s.edge[chosen])
            after.append(follows[chosen])
            ids.append(s.ids[doc])
            at.append(s.start[chosen] - s.words.range[doc])
        found = summary(joined(edge), joined(after), joined(ids, np.int64), joined(at, np.int64))
        block = table.column(self.block)[0].as_py()
        return B.as_table([(b, block, B.planes(found[0][lo:hi]), packed(*(x[lo:hi] for x in found[1:])))
                         for b, lo, hi in B.by_bucket(found[0], self.buckets)], ASKED)

    def repeated(self, table: pa.Table) -> pa.Table:
        """The edges of a range of hashes that occur more than once."""
        _, _, data, more = columns(table)
        parts = [unpacked(x, 4) for x in more]
        after, ids, at, n = (np.concatenate([p[i] for p in parts]) for i in range(4))
        edge, after, ids, at, n = summary(np.concatenate([B.from_planes(x) for x in data]), after, ids.astype(np.int64), at.astype(np.int64), n.astype(np.int64))
        many = n > 1
        return pa.table([ids[many], at[many].astype(np.int32), edge[many].view(np.int64), after[many].view(np.int64), n[many]], schema=EDGES)

    def tell_paths(self, asked: pa.Table, paths: pa.Table) -> pa.Table:
        """To each block the paths whose heads it holds."""
        if not len(asked) or not len(paths):
            return TOLD.empty_table()
        bucket, blocks, data, _ = columns(asked)
        head = paths.column("edge").to_numpy().view(np.uint64)
        order = np.argsort(head)
        head = head[order]
        rest = [paths.column(c).to_numpy()[order] for c in ("id", "start", "length", "fingerprint")]
        out = []
        for b, x in zip(blocks, data):
            mine = B.within(B.from_planes(x), head)
            if mine.any():
                out.append((2, bucket, b, packed(head[mine], *(r[mine] for r in rest))))
        return B.as_table(out, TOLD)

    # ---- the result

    def decide(self, table: pa.Table, told: pa.Table, schema: pa.Schema) -> pa.Table:
        if not len(table):
            return schema.empty_table()
        texts = B.flat(table.column(self.text)).to_pylist()
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        if len(told):
            answers = by_step(told)
            parts = self.slices(table)
            copies = self.copies(parts, answers)
            paths = [np.concatenate(x) for x in zip(*(unpacked(d[0], 5) for d in answers.get(2, {}).values()))] or [np.zeros(0, np.uint64)] * 5
            order = np.argsort(paths[0])
            head, first_id, first_at, length, fingerprint = (x[order] for x in paths)
            for s, copy, chosen in zip(parts, copies, self.candidates(parts, answers, copies)):
                cover = np.zeros(len(s.words) + 1, np.int32)
                lo, hi = s.words.range[:-1][copy], s.words.range[1:][copy]
                np.add.at(cover, lo, 1)
                np.add.at(cover, hi, -1)
                window = np.flatnonzero(chosen)
                window = window[B.within(head, s.edge[window])]
                path = np.searchsorted(head, s.edge[window])
                doc = s.words.doc[s.start[window]]
                later = (s.ids[doc] != first_id[path].astype(np.int64)) | (s.start[window] - s.words.range[doc] != first_at[path].astype(np.int64))
                window, path = window[later], path[later]
                n = length[path].astype(np.int64)
                before = np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(s.edge)]) if len(s.edge) else np.zeros(1, np.uint64)
                last = np.minimum(window + n, len(s.edge))
                verified = (last == window + n) & ((before[last] ^ before[window]) == fingerprint[path])
                begin = s.start[window[verified]]
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + n[verified] + self.k - 1, -1)
                for doc, a, b in B.runs(np.cumsum(cover[:-1]) > 0, s.words.range):
                    spans[s.rows[doc]].append((a, b - a))
        kept, n_words = [], []
        for t, gone in zip(texts, spans):
            words = (t or b"").split()  # splits bytes at the same six characters
            n_words.append(len(words))
            if gone:
                keep = bytearray(b"\1") * len(words)
                for a, n in gone:
                    keep[a : a + n] = bytes(n)
                words = list(compress(words, keep))
            kept.append(b" ".join(words))
        out = {c: table.column(c) for c in table.column_names if c != self.block}
        out["n_words"] = pa.array(n_words, pa.int64())
        out["removed"] = pa.array([[{"start": a, "length": n} for a, n in s] for s in spans], schema.field("removed").type)
        out["kept"] = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.table(out)


def joined(parts: list[np.ndarray], kind=np.uint64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def columns(table: pa.Table) -> tuple[int, list, list, list]:
    return (table.column("bucket")[0].as_py(), *(table.column(c).to_pylist() for c in ("block", "data", "more")))


def by_step(table: pa.Table) -> dict[int, dict[int, tuple]]:
    out: dict[int, dict[int, tuple]] = {}
    for step, bucket, data in zip(*(table.column(c).to_pylist() for c in ("step", "bucket", "data"))):
        out.setdefault(step, {})[bucket] = (data,)
    return out


def summary(edge, after, ids, at, n=None):
    """Different edges in order: the edge that always follows (or 0), the first
    coordinate, the number of occurrences."""
    order = np.lexsort((at, ids, edge))
    edge, after, ids, at = edge[order], after[order], ids[order], at[order]
    cuts = B.grouped(edge)
    first = cuts[:-1]
    if not len(first):
        return edge, after, ids, at, np.zeros(0, np.int64)
    n = np.diff(cuts) if n is None else np.add.reduceat(n[order], first)
    always = np.minimum.reduceat(after, first) == np.maximum.reduceat(after, first)
    return edge[first], np.where(always, after[first], np.uint64(0)), ids[first], at[first], n


def compact(edges: DataFrame, buckets: int) -> DataFrame:
    """Nonbranching paths: bucket and hash of the head, first coordinate, length
    and the exclusive or of the edges.  A path ends where a stretch of ``STRETCH``
    windows of its document does and the next one goes on from there, so no task holds a
    whole document; the pieces cover the same words."""
    edges = edges.withColumn("stretch", F.floor(F.col("start") / STRETCH))
    source = Window.partitionBy("id", "stretch").orderBy("start", "edge")
    goes_on = (F.lag("start").over(source) == F.col("start") - 1) & (F.lag("next").over(source) == F.col("edge")) & (F.lag("n").over(source) == F.col("n"))
    numbered = edges.withColumn("head", F.when(goes_on, 0).otherwise(1)).withColumn("path", F.sum("head").over(source.rowsBetween(Window.unboundedPreceding, 0)))
    paths = numbered.groupBy("id", "stretch", "path").agg(
        F.min("start").alias("start"), F.count("*").alias("length"), F.bit_xor("edge").alias("fingerprint"), F.max(F.when(F.col("head") == 1, F.col("edge"))).alias("edge"))
    bucket = F.shiftrightunsigned(F.shiftrightunsigned("edge", 32) * buckets, 32).cast("int")
    return paths.select(bucket.alias("bucket"), "edge", "id", F.col("start").cast("long").alias("start"), "length", "fingerprint")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, gram: int = GRAM) -> DataFrame:
    """``docs`` with ``n_words``, ``removed`` (spans of words, in order) and ``kept``
    (the words that stay, joined by one space); such columns are replaced."""
    docs = docs.drop("n_words", "removed", "kept")
    size = B.text_bytes(docs, text)
    dealt, block = B.blocked(docs, key, text, size)
    g = Graph(key, text, block, k, gram, B.buckets_for(size))
    asked_as, told_as = "bucket int, block int, data binary, more binary", "step int, bucket int, block int, data binary"
    own = dealt.select(block, key, text)
    told = own.groupBy(block).applyInArrow(B.alone(g.ask_anchors), asked_as).groupBy("bucket").applyInArrow(B.alone(g.tell_anchors), told_as).repartition("block")
    asked = own.groupBy(block).cogroup(told.groupBy("block")).applyInArrow(B.paired(g.ask_edges), asked_as).repartition("bucket")
    edges = asked.groupBy("bucket").applyInArrow(B.alone(g.repeated), "id bigint, start int, edge bigint, next bigint, n bigint")
    paths = compact(edges, g.buckets)
    heads = asked.groupBy("bucket").cogroup(paths.groupBy("bucket")).applyInArrow(B.paired(g.tell_paths), told_as)
    schema = docs.withColumns({"n_words": F.lit(0).cast("long"), "removed": F.lit(None).cast("array<struct<start:bigint,length:bigint>>"), "kept": F.lit("")}).schema
    out = B.arrow_schema(schema)

    def decide(table, told):
        return g.decide(table, told, out)

    return dealt.groupBy(block).cogroup(told.unionByName(heads).groupBy("block")).applyInArrow(decide, schema)
