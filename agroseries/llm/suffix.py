"""Removal of byte strings that start in an earlier document, by prefix-free parsing.

A rolling hash of ``GRAM`` bytes is the trigger: every window of ``length`` bytes
belongs to its gram with the least hash (the leftmost, if equal), which depends on
the window's bytes alone.  Consecutive windows with the same trigger form a phrase;
a document is parsed into overlapping phrases, every window lies in one phrase, and
equal windows lie under equal triggers wherever they occur.  The corpus order of the
windows, which a suffix array cut at ``length`` bytes gives, is combined from two:

* the *parse*: phrases in order, each with the least document that holds it.  All
  windows of a phrase that an earlier document holds are repeats, without looking
  into the phrase;
* the *dictionary*: different phrases under one trigger.  Only these are looked into,
  each once: their suffixes, cut at ``length``, are sorted by their bytes, and those
  that agree in all of them stand side by side, the least document among them first.

Both are kept in shards by trigger, as windows of different triggers differ: a block
of documents sends each different trigger or phrase once to the task that owns its
range of hashes, and gets one bit back for each (or for each window).  Copies collapse
before they are sent.  Of a trigger with more than ``crowd`` phrases the dictionary is
sharded by window instead, so no task holds all surroundings of a frequent string.

1. Triggers that occur in one document only are dropped (most of them).
2. Of the rest: has an earlier document the phrase; has the trigger several phrases,
   or a crowd?
3. For first phrases under triggers with several: has an earlier document the window?

Windows are compared by their bytes, phrases by 64-bit fingerprints.

Defined results: null text is empty; a null doc_id takes no part (kept whole, no
document is later than it); rows that share a doc_id are not earlier than each
other; texts shorter than ``length`` bytes are kept whole; other columns pass by.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

LENGTH = 50
GRAM = 24
KEY_BYTES = 6  # of a trigger's hash, in the first question; a clash only costs work
CROWD = 1 << 16  # phrases under one trigger that one task sorts
COUNT_BYTES = 2
SORTED_WINDOWS = 1 << 17  # sorted at once, where triggers allow
ASKED = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("data", pa.binary()), ("more", pa.binary()), ("base", pa.int64())])
TOLD = pa.schema([("step", pa.int32()), ("bucket", pa.int32()), ("block", pa.int32()), ("data", pa.binary())])


class Parse:
    """Phrases of the texts of one slice."""

    def __init__(self, texts: pa.Array, length: int, gram: int, detail: bool):
        self.raw, self.at = B.bytes_of(texts)
        self.length = length
        n = len(self.raw)
        doc = np.repeat(np.arange(len(self.at) - 1, dtype=np.int32), np.diff(self.at))
        if n < length:
            start = low = np.zeros(0, np.int64)
            hashes = np.zeros(0, np.uint64)
        else:
            hashes = B.rolling(B.byte_values(self.raw), gram)
            low = B.lowest(hashes, length - gram + 1)
            start = np.flatnonzero(doc[: n - length + 1] == doc[length - 1 :])
            low = low[start]
        if len(start):
            fresh = np.ones(len(start), bool)
            fresh[1:] = (low[1:] != low[:-1]) | (start[1:] != start[:-1] + 1)
            first = np.flatnonzero(fresh)
        else:
            first = np.zeros(0, np.int64)
        self.start = start[first]  # of the phrase's first window
        self.windows = np.diff(np.append(first, len(start)))
        self.doc = doc[self.start]
        self.key = B.mix(hashes[low[first]]) if len(first) else hashes[:0]  # least hashes are small: spread them again
        if detail:
            self.sums = B.prefix(self.raw)
            self.content = B.span(self.sums, self.start, self.start + self.windows + length - 1)

    def windows_of(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of all windows of the marked phrases."""
        n = self.windows[phrases]
        first = np.repeat(self.start[phrases] - (np.cumsum(n) - n), n)
        start = first + np.arange(len(first))
        return start, B.span(self.sums, start, start + self.length)


def suffix_order(raw: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``start``, cut at ``length`` bytes, in the order of their bytes;
    and where in that order one differs from the one before it."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), ">u8", buffer=padded, strides=(1,))
    words = []
    for i in range(0, length, 8):
        own = eight[start + i].astype(np.uint64)
        if length - i < 8:
            own >>= np.uint64(8 * (8 - (length - i)))
        words.append(own)
    order = np.lexsort(words[::-1])
    fresh = np.ones(len(start), bool)
    if len(start):
        fresh[1:] = False
        for own in words:
            own = own[order]
            fresh[1:] |= own[1:] != own[:-1]
    return order, fresh


def counted(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each i the n[i] numbers from start[i] on."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def offsets(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


class Part(NamedTuple):
    """A slice of a block: its phrases, its documents' keys and places."""

    parse: Parse
    ids: np.ndarray
    rows: np.ndarray


class Entries(NamedTuple):
    """What a block asks the dictionary: different phrases (or windows, of a crowd) by
    route.  ``number`` is the entry of each occurrence, slice by slice."""

    route: np.ndarray
    windows: np.ndarray
    first: np.ndarray  # least document of the block
    start: np.ndarray  # in the texts of all slices
    number: list[np.ndarray]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # by slice: start, windows, document


@dataclass(frozen=True)
class Dedup:
    """The questions that blocks of documents ask, and how they are answered.
    Steps: 1 triggers, 2 phrases and (from bucket ``buckets`` on) triggers with
    their least and greatest phrase and the number of phrases, 3 windows, 4 crowds."""

    key: str
    text: str
    block: str
    length: int
    gram: int
    buckets: int
    characters: bool = False  # the text is shortened too, by whole characters
    crowd: int = CROWD

    # ---- what a block knows by itself

    def parses(self, table: pa.Table, detail: bool = True) -> list[Part]:
        """The block's slices, without rows that have no key."""
        valid = np.asarray(table.column(self.key).is_valid())
        rows = np.flatnonzero(valid)
        table = table.filter(pa.array(valid))
        texts, ids = B.flat(table.column(self.text)), table.column(self.key).to_numpy()
        return [Part(Parse(texts.slice(a, n), self.length, self.gram, detail), ids[a : a + n], rows[a : a + n]) for a, n in B.slices(texts)]

    def shared(self, parts: list[Part], told: dict) -> list[np.ndarray]:
        """By slice: the phrases whose trigger occurs in several documents."""
        keys = B.unique(joined([x.parse.key for x in parts]))
        flags = B.flags_for(keys, self.buckets, told.get(1, {}))
        return [flags[np.searchsorted(keys, x.parse.key)] for x in parts]

    def phrases(self, parts: list[Part], chosen: list[np.ndarray]):
        """Different phrases with their least document; triggers with their least
        and greatest phrase and the number of different ones."""
        content = joined([x.parse.content[c] for x, c in zip(parts, chosen)])
        ids = joined([x.ids[x.parse.doc[c]] for x, c in zip(parts, chosen)], np.int64)
        keys = joined([x.parse.key[c] for x, c in zip(parts, chosen)])
        order = np.lexsort((content, keys))
        own, own_content = keys[order], content[order]
        cuts = B.grouped(own)
        fresh = np.ones(len(own), np.int64)
        fresh[1:] = (own[1:] != own[:-1]) | (own_content[1:] != own_content[:-1])
        number = np.add.reduceat(fresh, cuts[:-1]) if len(own) else fresh
        return *B.least(content, ids), own[cuts[:-1]], own_content[cuts[:-1]], own_content[cuts[1:] - 1], number

    def repeats(self, parts: list[Part], told: dict) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """By slice: phrases that an earlier document holds; phrases to look into;
        phrases under a crowd."""
        chosen = self.shared(parts, told)
        kept, first, keys, _, _, _ = self.phrases(parts, chosen)
        seen = B.flags_for(kept, self.buckets, told.get(2, {}))
        several = B.flags_for(keys, self.buckets, told.get(2, {}), shift=self.buckets)
        crowds = B.flags_for(keys, self.buckets, told.get(4, {}), shift=self.buckets)
        whole, inside, crowded = [], [], []
        for x, c in zip(parts, chosen):
            place = np.searchsorted(kept, x.parse.content[c])
            again, look, crowd = np.zeros((3, len(c)), bool)
            again[c] = seen[place] | (first[place] < x.ids[x.parse.doc[c]])
            under = np.searchsorted(keys, x.parse.key[c])
            look[c], crowd[c] = several[under], crowds[under]
            whole.append(again)
            inside.append(look & ~again)
            crowded.append(crowd)
        return whole, inside, crowded

    def dictionary(self, parts: list[Part], inside: list[np.ndarray], crowded: list[np.ndarray]) -> Entries:
        """The phrases to look into; of a crowd, each window by itself."""
        found, routes, contents = [], [], []
        for x, c, crowd in zip(parts, inside, crowded):
            p = x.parse
            plain, split = np.flatnonzero(c & ~crowd), np.flatnonzero(c & crowd)
            start, hashes = p.windows_of(split)
            routes.append(np.concatenate([p.key[plain], hashes]))
            contents.append(np.concatenate([p.content[plain], hashes]))
            found.append((np.concatenate([p.start[plain], start]), np.concatenate([p.windows[plain], np.ones(len(start), np.int64)]),
                          np.concatenate([x.ids[p.doc[plain]], np.repeat(x.ids[p.doc[split]], p.windows[split])])))
        route, content, ids = joined(routes), joined(contents), joined([i for _, _, i in found], np.int64)
        windows = joined([n for _, n, _ in found], np.int64)
        order = np.lexsort((content, route))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (route[order][1:] != route[order][:-1]) | (content[order][1:] != content[order][:-1])
        heads = np.flatnonzero(fresh)
        number = np.zeros(len(order), np.int64)
        number[order] = np.cumsum(fresh) - 1
        first = np.minimum.reduceat(ids[order], heads) if len(heads) else ids
        picked = order[heads]
        at = offsets(np.array([len(s) for s, _, _ in found], np.int64))
        begin = joined([s + base for (s, _, _), base in zip(found, offsets(np.array([len(x.parse.raw) for x in parts], np.int64)))], np.int64)
        return Entries(route[picked], windows[picked], first, begin[picked], [number[lo:hi] for lo, hi in zip(at[:-1], at[1:])], found)

    # ---- questions

    def ask_triggers(self, table: pa.Table) -> pa.Table:
        parts = self.parses(table, detail=False)
        keys = joined([x.parse.key for x in parts])
        rows = joined([x.rows[x.parse.doc] for x in parts], np.int64)
        order = np.argsort(keys)
        keys, rows = keys[order], rows[order]
        cuts = B.grouped(keys)[:-1]
        several = np.minimum.reduceat(rows, cuts) != np.maximum.reduceat(rows, cuts) if len(cuts) else np.zeros(0, bool)
        keys = keys[cuts]
        out = Asked(self.block_of(table))
        for b, lo, hi in B.by_bucket(keys, self.buckets):
            out.add(b, B.planes(keys[lo:hi], KEY_BYTES), B.bits(several[lo:hi]))
        return out.table()

    def ask_phrases(self, table: pa.Table, told: pa.Table) -> pa.Table:
        if not len(table) or not len(told):
            return ASKED.empty_table()
        parts = self.parses(table)
        kept, first, keys, low, high, number = self.phrases(parts, self.shared(parts, by_step(told)))
        number = np.minimum(number, (1 << 8 * COUNT_BYTES) - 1).astype(np.uint64) << np.uint64(64 - 8 * COUNT_BYTES)
        out = Asked(self.block_of(table))
        for b, lo, hi in B.by_bucket(kept, self.buckets):
            out.add_least(b, kept[lo:hi], first[lo:hi])
        for b, lo, hi in B.by_bucket(keys, self.buckets):
            out.add(b + self.buckets, B.planes(keys[lo:hi]), B.planes(low[lo:hi]) + B.planes(high[lo:hi]) + B.planes(number[lo:hi], COUNT_BYTES))
        return out.table()

    def ask_suffixes(self, table: pa.Table, told: pa.Table) -> pa.Table:
        if not len(table) or not len(told):
            return ASKED.empty_table()
        parts = self.parses(table)
        e = self.dictionary(parts, *self.repeats(parts, by_step(told))[1:])
        out = Asked(self.block_of(table))
        raw = joined([x.parse.raw for x in parts], np.uint8)
        # places within an owner's range let it sort its triggers some at a time
        place = (e.route >> np.uint64(32)) * np.uint64(self.buckets) << np.uint64(32)
        for b, lo, hi in B.by_bucket(e.route, self.buckets):
            base = int(e.first[lo:hi].min())
            more = B.planes(e.windows[lo:hi].astype(np.uint64)) + B.planes((e.first[lo:hi] - base).astype(np.uint64)) + B.planes(place[lo:hi])
            out.add(b, raw[counted(e.start[lo:hi], e.windows[lo:hi] + self.length - 1)].tobytes(), more, base)
        return out.table()

    def block_of(self, table: pa.Table) -> int:
        return table.column(self.block)[0].as_py()

    # ---- answers, one bit for each entry of a question

    def tell_triggers(self, table: pa.Table) -> pa.Table:
        keys = [B.from_planes(x, KEY_BYTES) for x in table.column("data").to_pylist()]
        several = [k[B.from_bits(x, len(k))] for k, x in zip(keys, table.column("more").to_pylist())]
        every = np.sort(np.concatenate([*(B.unique(k) for k in keys), *several]))
        again = B.unique(every[1:][every[1:] == every[:-1]])
        return told_rows(table, 1, [B.within(again, k) for k in keys])

    def tell_phrases(self, table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < self.buckets:
            return told_rows(table, 2, earlier(table))
        keys = [B.from_planes(x) for x in table.column("data").to_pylist()]
        more = [(x, 8 * len(k)) for x, k in zip(table.column("more").to_pylist(), keys)]
        every = np.concatenate(keys)
        known, low = B.least(every, np.concatenate([B.from_planes(x[:n]) for x, n in more]))
        several = low != ~B.least(every, ~np.concatenate([B.from_planes(x[n : 2 * n]) for x, n in more]))[1]
        number = np.concatenate([B.from_planes(x[2 * n :], COUNT_BYTES) for x, n in more]) >> np.uint64(64 - 8 * COUNT_BYTES)
        in_all = np.zeros(len(known), np.int64)
        np.add.at(in_all, np.searchsorted(known, every), number.astype(np.int64))
        crowded = several & (in_all > self.crowd)
        places = [np.searchsorted(known, k) for k in keys]
        return pa.concat_tables([told_rows(table, 2, [several[p] for p in places]), told_rows(table, 4, [crowded[p] for p in places])])

    def tell_suffixes(self, table: pa.Table) -> pa.Table:
        """Sorts the suffixes of a shard of the dictionary; a bit for each window."""
        data = table.column("data").to_pylist()
        more = table.column("more").to_pylist()
        entries = [len(x) // 24 for x in more]
        windows, ids, place = ([B.from_planes(x[8 * i * n : 8 * (i + 1) * n]).astype(np.int64 if i < 2 else np.uint64) for x, n in zip(more, entries)] for i in range(3))
        ids = np.concatenate([x + base for x, base in zip(ids, table.column("base").to_pylist())])
        windows, place = np.concatenate(windows), np.concatenate(place)
        raw = np.frombuffer(b"".join(data), np.uint8)
        text_at, bit_at = offsets(windows + self.length - 1), offsets(windows)
        seen = np.zeros(int(bit_at[-1]), bool)
        order = np.argsort(place, kind="stable")
        for lo, hi in pieces(place[order], windows[order], SORTED_WINDOWS):
            own = order[lo:hi]
            n = windows[own]
            start, bit, document = counted(text_at[own], n), counted(bit_at[own], n), np.repeat(ids[own], n)
            array, fresh = suffix_order(raw, start, self.length)
            least = np.minimum.reduceat(document[array], np.flatnonzero(fresh))
            seen[bit[array]] = least[np.cumsum(fresh) - 1] < document[array]
        cuts = bit_at[offsets(np.array(entries, np.int64))]
        return told_rows(table, 3, [seen[a:b] for a, b in zip(cuts[:-1], cuts[1:])])

    # ---- the result

    def decide(self, table: pa.Table, told: pa.Table, schema: pa.Schema) -> pa.Table:
        if not len(table):
            return schema.empty_table()
        texts = B.flat(table.column(self.text))
        spans: list[list[tuple[int, int]]] = [[] for _ in range(len(table))]
        if len(told):
            answers = by_step(told)
            parts = self.parses(table)
            whole, inside, crowded = self.repeats(parts, answers)
            e = self.dictionary(parts, inside, crowded)
            bit_at = offsets(e.windows)
            seen = np.zeros(int(bit_at[-1]), bool)
            for b, lo, hi in B.by_bucket(e.route, self.buckets):
                if b in answers.get(3, {}):
                    seen[bit_at[lo] : bit_at[hi]] = B.from_bits(answers[3][b][0], int(bit_at[hi] - bit_at[lo]))
            for x, again, number, (start, n, ids) in zip(parts, whole, e.number, e.found):
                hit = seen[counted(bit_at[number], n)] | np.repeat(e.first[number] < ids, n)
                hit = counted(start, n)[hit]
                cover = np.zeros(len(x.parse.raw) + 1, np.int32)
                np.add.at(cover, x.parse.start[again], 1)
                np.add.at(cover, (x.parse.start + x.parse.windows + self.length - 1)[again], -1)
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + self.length, -1)
                for doc, lo, hi in B.runs(np.cumsum(cover[:-1]) > 0, x.parse.at):
                    spans[x.rows[doc]].append((lo, hi - lo))
        kept_bytes = [B.without(t or b"", s) for t, s in zip(texts.to_pylist(), spans)]
        out = {name: table.column(name) for name in table.column_names if name != self.block}
        out["removed"] = pa.array([[{"start": a, "length": n} for a, n in s] for s in spans], schema.field("removed").type)
        out["kept"] = pa.array(kept_bytes, pa.binary())
        if self.characters:
            out[self.text] = pa.array([shortened(t, s) for t, s in zip(texts.to_pylist(), spans)], pa.binary()).cast(pa.string())
        return pa.table(out)


def shortened(text: bytes | None, spans: list[tuple[int, int]]) -> bytes | None:
    """A text without (start, length) spans; a character that a span cuts in two stays."""
    if text is None or not spans:
        return text
    cuts = ((B.character(text, a), B.character_before(text, a + n)) for a, n in spans)
    return B.without(text, [(a, b - a) for a, b in cuts if b > a])


def joined(parts: list[np.ndarray], kind=np.uint64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def pieces(values: np.ndarray, weights: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of a sorted array with a weight of about ``most``; equal values stay together."""
    cuts = B.grouped(values)
    total = offsets(weights)[cuts]
    out, lo = [], 0
    for i in range(1, len(cuts)):
        if i == len(cuts) - 1 or total[i + 1] - total[lo] > most:
            out.append((int(cuts[lo]), int(cuts[i])))
            lo = i
    return out


class Asked:
    """Rows of a block's question: entries of one bucket in sorted order."""

    def __init__(self, block: int):
        self.block, self.rows = block, []

    def add(self, bucket: int, data: bytes, more: bytes, base: int = 0) -> None:
        self.rows.append({"bucket": bucket, "block": self.block, "data": data, "more": more, "base": base})

    def add_least(self, bucket: int, keys: np.ndarray, ids: np.ndarray) -> None:
        """Keys, each with the least document of the block that has it."""
        base = int(ids.min())
        self.add(bucket, B.planes(keys), B.planes((ids - base).astype(np.uint64)), base)

    def table(self) -> pa.Table:
        return pa.Table.from_pylist(self.rows, ASKED)


def earlier(table: pa.Table) -> list[np.ndarray]:
    """For the rows of ``add_least``: has another block a lesser document?"""
    keys = [B.from_planes(x) for x in table.column("data").to_pylist()]
    ids = [B.from_planes(x).astype(np.int64) + base for x, base in zip(table.column("more").to_pylist(), table.column("base").to_pylist())]
    known, first = B.least(np.concatenate(keys), np.concatenate(ids))
    return [first[np.searchsorted(known, k)] < i for k, i in zip(keys, ids)]


def told_rows(table: pa.Table, step: int, flags: list[np.ndarray]) -> pa.Table:
    """One row for each question that has a yes."""
    some = [(b, f) for b, f in zip(table.column("block").to_pylist(), flags) if f.any()]
    bucket = table.column("bucket")[0].as_py()
    return pa.Table.from_pylist([{"step": step, "bucket": bucket, "block": b, "data": B.bits(f)} for b, f in some], TOLD)


def by_step(table: pa.Table) -> dict[int, dict[int, tuple]]:
    out: dict[int, dict[int, tuple]] = {}
    for step, bucket, data in zip(*(table.column(c).to_pylist() for c in ("step", "bucket", "data"))):
        out.setdefault(step, {})[bucket] = (data,)
    return out


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, characters: bool = False, crowd: int = CROWD) -> DataFrame:
    """``docs`` with ``removed`` (byte spans, in order) and ``kept`` (the bytes that
    stay); columns of these names are replaced.  With ``characters`` the text column is
    shortened as ``whole_characters`` does."""
    docs = docs.drop("removed", "kept")
    size = B.text_bytes(docs, text)
    dealt, block = B.blocked(docs, key, text, size)
    d = Dedup(key, text, block, length, gram, B.buckets_for(size), characters, crowd)
    asked = "bucket int, block int, data binary, more binary, base bigint"
    told_as = "step int, bucket int, block int, data binary"
    own = dealt.select(block, key, text)
    by_block = lambda told: own.groupBy(block).cogroup(told.groupBy("block"))
    told = own.groupBy(block).applyInArrow(B.alone(d.ask_triggers), asked).groupBy("bucket").applyInArrow(B.alone(d.tell_triggers), told_as).repartition("block")
    for ask, tell in ((d.ask_phrases, d.tell_phrases), (d.ask_suffixes, d.tell_suffixes)):
        answers = by_block(told).applyInArrow(B.paired(ask), asked).groupBy("bucket").applyInArrow(B.alone(tell), told_as).repartition("block")
        told = told.unionByName(answers)
    schema = docs.withColumns({"removed": F.lit(None).cast("array<struct<start:bigint,length:bigint>>"), "kept": F.lit(None).cast("binary")}).schema
    out = B.arrow_schema(schema)

    def decide(table, told):
        return d.decide(table, told, out)

    return dealt.groupBy(block).cogroup(told.groupBy("block")).applyInArrow(decide, schema)


def whole_characters(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the text shortened by ``removed``, which may cut a character
    in two: such a character stays."""
    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = [shortened(t, [(x["start"], x["length"]) for x in s or ()]) for t, s in zip(B.flat(texts).to_pylist(), spans.to_pylist())]
        return pa.array(out, pa.binary()).cast(pa.string())

    return docs.withColumn(text, cut(text, "removed"))
