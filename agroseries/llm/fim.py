"""Fill-in-middle transformation by secondary-sort assembly.

A text is cut into units (a word with the white space before it; white space at the
end is a unit of its own).  Two units drawn from a hash of the document's key bound
the middle.

1. *Pieces.*  A text becomes pieces of at most ``UNITS`` units (and ``PIECE_BYTES``
   bytes), each with a key of its document and its place in the *output*; the mark of
   a section stands before its first piece.
2. *Assembly.*  ``repartitionAndSortWithinPartitions`` brings a document's pieces
   together in output order; they stream into an incremental digest, so no task holds
   more of a document than a piece.
3. *Restoration.*  The streamed output is read back: marks are found wherever pieces
   are cut, sections become pieces keyed by their place in the *text*, are sorted again
   in the same partitions (the partitioner is the same, so nothing is shuffled) and
   stream into the digest of the restored text.

Defined results: a null or empty text has no unit and is ``plain``; a text that holds
a mark is ``plain``; a null key is drawn as an empty one; rows that share a key are
documents of their own, rows that are equal altogether each give the same result.
Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import groupby, islice
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
UNITS, PIECE_BYTES = 2_048, 64 << 10
PARTITION_BYTES = 8 << 20
HEAD = 0  # the section of a document's record about itself; 1 to 3: prefix, middle, suffix
#: Sections in the order of the output, with their marks.
LAYOUT = {"plain": [(b"", 1)], "psm": [(PREFIX, 1), (SUFFIX, 3), (MIDDLE, 2)], "spm": [(SUFFIX, 3), (PREFIX, 1), (MIDDLE, 2)]}
ID_BYTES = 20


class Draw(NamedTuple):
    """How documents are cut: percentages of formatted and of suffix-first texts."""
    seed: int = SEED
    fim: int = FIM_PERCENT
    spm: int = SPM_PERCENT

    def numbers(self, key: str) -> list[int]:
        digest = hashlib.sha256(f"{self.seed}:{key}".encode()).hexdigest()
        return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]

    def form(self, key: str, text: bytes) -> str:
        _, _, third, fourth = self.numbers(key)
        if not text or third % 100 >= self.fim or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
            return "plain"
        return "spm" if fourth % 100 < self.spm else "psm"

    def cuts(self, key: str, n: int) -> tuple[int, int]:
        first, second, _, _ = self.numbers(key)
        a, b = first % (n + 1), second % (n + 1)
        return min(a, b), max(a, b)


def unit_ends(text: bytes) -> np.ndarray:
    """Where each unit ends, in bytes."""
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    space = B.is_space(raw)
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.append(ends, len(raw))  # of the last word, or of the white space after it


def characters(text: bytes) -> int:
    return int(np.count_nonzero(np.frombuffer(text, np.uint8) & 0xC0 != 0x80))


def cut(text: bytes, ends: np.ndarray, lo: int, hi: int) -> Iterator[bytes]:
    """Units [lo, hi) of a text in pieces."""
    at = [0 if u == 0 else int(ends[u - 1]) for u in [*range(lo, hi, UNITS), hi]]
    for a, b in zip(at[:-1], at[1:]):
        for i in range(a, b, PIECE_BYTES):
            yield text[i : min(i + PIECE_BYTES, b)]


def record(document: bytes, section: int, place: int) -> bytes:
    """A key whose order is document, section, place."""
    return document + struct.pack(">BI", section, place)


def owner(key: bytes) -> int:
    return int.from_bytes(key[:7], "big")


def pieces(rows, draw: Draw):
    """(key, piece) of each document in output order; its own record comes first."""
    for key, name, text in rows:
        name, text = name or "", (text or "").encode()
        document = hashlib.sha256((b"" if key is None else f"{len(name)}:{name}".encode()) + b"\n" + text).digest()[:ID_BYTES]
        ends, form = unit_ends(text), draw.form(name, text)
        n, about = len(ends), (None, None)
        lo, hi = (n, n) if form == "plain" else draw.cuts(name, n)
        if form != "plain":
            a, b = (0 if u == 0 else int(ends[u - 1]) for u in (lo, hi))
            about = characters(text[:a]), characters(text[a:b])
        yield record(document, HEAD, 0), (key, n, form, *about)
        units = {1: (0, lo), 2: (lo, hi), 3: (hi, n)}
        place = 0
        for mark, section in LAYOUT[form]:
            for piece in cut(text, ends, *units[section]):
                yield record(document, 1, place), mark + piece
                mark, place = b"", place + 1
            if mark:  # of an empty section
                yield record(document, 1, place), mark
                place += 1


def different(records):
    """Records without the repetitions that equal rows leave, which stand together."""
    last = None
    for key, value in records:
        if key != last:
            yield key, value
        last = key


class Sections:
    """Reads an output back, however it is cut: bytes with the section they belong to."""

    def __init__(self, form: str):
        self.layout = list(LAYOUT[form])
        self.section, self.rest = None, b""
        if not self.layout[0][0]:
            self.section = self.layout.pop(0)[1]

    def feed(self, data: bytes) -> Iterator[tuple[int, bytes]]:
        data = self.rest + data
        while self.layout:
            mark, section = self.layout[0]
            at = data.find(mark)
            if at < 0:  # a mark may begin in the last bytes
                keep = min(len(mark) - 1, len(data))
                data, self.rest = data[: len(data) - keep], data[len(data) - keep :]
                break
            if at:
                yield self.section, data[:at]
            data, self.section = data[at + len(mark) :], section
            self.layout.pop(0)
        else:
            self.rest = b""
        if data:
            yield self.section, data

    def end(self) -> Iterator[tuple[int, bytes]]:
        if self.rest:
            yield self.section, self.rest


def assemble(stream, with_output: bool):
    """Digest of each output, and its bytes as pieces keyed by their place in the text."""
    for document, records in groupby(stream, lambda r: r[0][:ID_BYTES]):
        copies, about, output, digest, place = 0, None, [], hashlib.sha256(), 0
        head = record(document, HEAD, 0)
        parts = None
        for key, value in records_of(records, head):
            if key == head:
                copies, about = value
                parts = Sections(about[2])
                continue
            digest.update(value)
            if with_output:
                output.append(value)
            for section, part in parts.feed(value):
                yield record(document, section, place), part
                place += 1
        for section, part in parts.end():
            yield record(document, section, place), part
            place += 1
        yield head, (copies, about, digest.hexdigest(), b"".join(output).decode() if with_output else None)


def records_of(records, head: bytes):
    """A document's records; its own comes once, with the number of equal rows."""
    records = iter(records)
    copies, about, first = 0, None, []
    for key, value in records:
        if key != head:
            first.append((key, value))
            break
        copies, about = copies + 1, value
    yield head, (copies, about)

    def rest():
        yield from first
        yield from records
    yield from different(rest())


def restore(stream):
    """A row for each document, with the digest of the text that its pieces give."""
    for _, records in groupby(stream, lambda r: r[0][:ID_BYTES]):
        (_, (copies, about, made, output)), = islice(records, 1)
        digest = hashlib.sha256()
        for _, piece in records:
            digest.update(piece)
        row = (*about, made, digest.hexdigest(), output)
        for _ in range(copies):
            yield row


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", draw: Draw = Draw(), with_output: bool = False) -> DataFrame:
    """key, n (units), form, prefix_chars, middle_chars, output_sha256, restored_sha256
    and output (the formatted text, null unless asked for) of every row of ``docs``."""
    spark = docs.sparkSession
    own = docs.select(F.col(key).alias("key"), F.col(key).cast("string").alias("name"), F.col(text).alias("text"))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-B.text_bytes(docs, text) // PARTITION_BYTES))
    made = own.rdd.mapPartitions(lambda rows: pieces(rows, draw))
    sorted_out = made.repartitionAndSortWithinPartitions(partitions, owner)
    placed = sorted_out.mapPartitions(lambda s: assemble(s, with_output), preservesPartitioning=True)
    back = placed.repartitionAndSortWithinPartitions(sorted_out.getNumPartitions(), owner)
    kind = own.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string, output string"
    return spark.createDataFrame(back.mapPartitions(restore), schema, verifySchema=False)
