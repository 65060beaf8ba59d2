"""Arrow and numpy helpers shared by the operators of this subpackage.

Texts are handled as one byte array with offsets; words, hashes and windows are
computed for a whole slice of rows at once.  ``exchange`` is the shuffle most of
the operators need: blocks of documents ask questions about hashes, tasks that
each own a range of hashes answer them.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import os
import tempfile
import time
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path

SLICE_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
BLOCK_BYTES = 4 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


def ship(spark: SparkSession) -> None:
    """Let Spark hand this package to the Python workers, once a context, and texts
    in batches that are small beside a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_agroseries_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "agroseries.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    context._agroseries_shipped = True


def give_back() -> None:
    """Return freed memory of a Python worker, which later tasks reuse, to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, count) of consecutive rows with about ``most`` bytes of text; a
    longer text is a slice of its own."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), dtype=np.int64)
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i - start
            start, total = i, 0
        total += int(size)
    if len(sizes) > start:
        yield start, len(sizes) - start


def flat(column) -> pa.Array:
    """One contiguous large_binary array; null stays null."""
    own = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    own = own if isinstance(own, pa.Array) else pa.concat_arrays(own.chunks)
    if pa.types.is_string(own.type):
        own = own.cast(pa.binary())
    elif pa.types.is_large_string(own.type):
        own = own.cast(pa.large_binary())
    return own.cast(pa.large_binary())


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a large_binary array and the n+1 offsets; null is empty."""
    texts = pa.compute.fill_null(texts, b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


# --- hashes ---------------------------------------------------------------------------
# Runs are hashed by polynomial sums modulo the prime 2**61 - 1: two different runs of at
# most n values agree with a chance of about n / 2**61, whatever their pattern.  (Modulo
# 2**64 every base gives the same sum for some pairs of patterns, such as the Thue-Morse
# string and its complement.)  Triggers and anchors, where a clash only costs work, use
# the cheaper sums modulo 2**64.
_P = (1 << 61) - 1
_PRIME = _U(_P)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2**61 - 1, for any 64-bit x."""
    x = (x & _PRIME) + (x >> _U(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, for a and b below it."""
    low = _U((1 << 31) - 1)
    a1, a0, b1, b0 = a >> _U(31), a & low, b >> _U(31), b & low
    mid = a0 * b1 + a1 * b0
    return _reduced(a1 * b1 * _U(2) + (mid >> _U(30)) + ((mid & _U((1 << 30) - 1)) << _U(31)) + a0 * b0)


class _Powers:
    """Powers of a base and of its inverse modulo 2**61 - 1, or modulo 2**64, made when needed."""

    def __init__(self, modulus: int):
        self.modulus = modulus
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            size = len(self.up)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, self.modulus))):
                own, step = getattr(self, name), _U(pow(base, size, self.modulus))
                more = own * step if self.modulus == 2**64 else times(own, np.broadcast_to(step, own.shape))
                setattr(self, name, np.concatenate([own, more]))
        return self.up[:n], self.down[:n]


_POWERS, _CHEAP = _Powers(_P), _Powers(2**64)
_HALF = _U((1 << 30) - 1)
_PIECE = 1 << 22  # terms below 2**41 that 64 bits can add up


def _folded(x: np.ndarray) -> np.ndarray:
    """A number a little above 2**61 at most that is x modulo 2**61 - 1."""
    out = x >> _U(61)
    out += x & _PRIME
    return out


def prefix(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums; ``span`` reads the hash of any run from them.  Values
    are bytes or 64-bit hashes (taken modulo 2**61 - 1)."""
    up, _ = _POWERS.get(len(values) + 1)
    out = np.zeros(len(values) + 1, _U)
    carry = _U(0)
    for i in range(0, len(values), _PIECE):
        own, power = values[i : i + _PIECE], up[:-1][i : i + _PIECE]
        if own.dtype == np.uint8:
            own = own.astype(_U) + _U(1)
            high, low = own * (power >> _U(30)), own * (power & _HALF)
        else:
            own = times(_reduced(own), power)
            high, low = own >> _U(30), own & _HALF
        high, low = np.cumsum(high, out=high), np.cumsum(low, out=low)
        # 2**30 times a number modulo 2**61 - 1 is a turn of its bits
        low += (high << _U(30)) & _PRIME
        low += (high >> _U(31)) + carry
        out[i + 1 : i + 1 + len(low)] = low = _folded(low)
        carry = low[-1]
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the runs [start, end); equal runs have equal hashes anywhere."""
    _, down = _POWERS.get(len(sums))
    return mix(times(_reduced(sums[end] + (_U(2 * _P) - sums[start])), down[start]))


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """A cheap hash of every run of k values, for choices only: runs that differ may agree."""
    n = len(values) + 1 - k
    if n <= 0:
        return np.zeros(0, _U)
    up, down = _CHEAP.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[:n])


def byte_values(raw: np.ndarray) -> np.ndarray:
    return _BYTES[raw]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def is_space(raw: np.ndarray) -> np.ndarray:
    return _SPACE[raw]


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[raw]


_TAIL = np.array([(1 << 8 * i) - 1 for i in range(9)], _U)
LONG_WORD = 256


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words [start, end): eight bytes at a time, each step mixed,
    so that no pattern of bytes cancels; words beyond ``LONG_WORD`` bytes by BLAKE2."""
    size = end - start
    out = mix(size.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(0x632BE59BD9B4E019))
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray((len(raw) + 1,), "<u8", buffer=padded, strides=(1,))
    left = np.flatnonzero(size <= LONG_WORD)
    at = 0
    while len(left):
        own = out[left] ^ (eight[start[left] + at] & _TAIL[np.minimum(size[left] - at, 8)])
        out[left] = mix(own)
        at += 8
        left = left[size[left] > at]
    data = memoryview(padded)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts: where each starts and
    ends in ``raw``, its document, its 64-bit hash and each document's range."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        raw, at = bytes_of(texts)
        self.raw = _LOWER[raw] if lower else raw
        n = len(raw)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~_SPACE[raw]
        first = np.zeros(n + 1, bool)  # a document's first byte starts a word even after a visible byte
        first[at[:-1]] = True
        self.start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
        last = np.zeros(n + 1, bool)
        last[at[1:]] = True
        self.end = np.flatnonzero(inside[1:-1] & (~inside[2:] | last[1:])) + 1
        self.range = np.searchsorted(self.start, at)
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(self.range))
        self.hash = word_hashes(self.raw, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)


def windows(values: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every run of k values that lies within one document."""
    if len(values) < k:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    start = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :])
    return start, span(prefix(values), start, start + k)


def lowest(hashes: np.ndarray, wide: int) -> np.ndarray:
    """Place of the least of every ``wide`` neighbouring hashes, the leftmost of
    equal ones (by the bits that remain beside a place)."""
    n = len(hashes)
    if n < wide:
        return np.zeros(0, np.int64)
    room = _U(max(n.bit_length(), 1))
    low, span = (hashes >> room << room) | np.arange(n, dtype=_U), 1
    while span * 2 <= wide:
        low, span = np.minimum(low[span:], low[:-span]), span * 2
    if span < wide:
        low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
    return (low & ((_U(1) << room) - _U(1))).astype(np.int64)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of text in a table: one number from one aggregate."""
    return docs.select(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]


def kept(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small or middling frame in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage of a large frame: a compressed table in the shared folder."""
    path = scratch_path(df.sparkSession, "llm")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Remove tables of ``written`` that nothing reads any more."""
    for frame in frames:
        path = getattr(frame, "_scratch", None)
        if path:
            spark = frame.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
            frame._scratch = None


def settle(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that are done: it follows
    the driver's garbage collection, which may be hours away."""
    for _ in range(2):  # the driver's Python lets go of plans first, then its JVM
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def as_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()


def alone(method):
    """A method as a function of one table; Spark counts arguments, self too."""
    def of_table(table):
        try:
            return method(table)
        finally:
            _trim()
    return of_table


def paired(method):
    """A method as a function of two tables."""
    def of_tables(left, right):
        try:
            return method(left, right)
        finally:
            _trim()
    return of_tables


_CALLS = [0]


def _trim(every: int = 2) -> None:
    """``give_back`` after some calls; a task has many groups."""
    _CALLS[0] += 1
    if _CALLS[0] % every == 0:
        give_back()


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def blocked(docs: DataFrame, key: str, text: str, bytes_in_all: int, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """``docs`` dealt into blocks of about ``block_bytes`` by a hash of key and
    text, each block in one partition; plans that use the result several times
    share its one shuffle.  Returns the frame and the name of its block column."""
    blocks = max(1, -(-bytes_in_all // block_bytes))
    name = fresh(docs, "block")
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-blocks // 4))
    block = F.pmod(F.xxhash64(key, text), F.lit(blocks)).cast("int")
    return docs.withColumn(name, block).repartition(partitions, name), name


def arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def grouped(order: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a sorted array, with the end."""
    if not len(order):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(order[1:] != order[:-1]) + 1, [len(order)]])


def unique(values: np.ndarray) -> np.ndarray:
    """Sorted different values (a plain sort; faster than hashing here)."""
    s = np.sort(values)
    return s[grouped(s)[:-1]]


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Owner of each hash, by its upper 32 bits; monotonic in the hash."""
    return ((hashes >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def by_bucket(sorted_hashes: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of a sorted array."""
    owner = bucket_of(sorted_hashes, buckets)
    cuts = grouped(owner)
    return list(zip(owner[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist()))


def planes(values: np.ndarray, width: int = 8, of: str = "u8") -> bytes:
    """The upper ``width`` bytes of values of type ``of``, byte plane by byte plane: the
    planes of sorted values or small numbers compress well in a shuffle."""
    own = values.astype("<" + of)
    size = own.itemsize
    own = own.view(np.uint8).reshape(-1, size)
    out = np.empty((width, len(own)), np.uint8)
    for i in range(width):
        out[i] = own[:, size - 1 - i]
    return out.tobytes()


def from_planes(data: bytes, width: int = 8, low: bool = False) -> np.ndarray:
    """64-bit values from the planes of their upper bytes, or of the lower ones, in both
    cases the highest first."""
    own = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((own.shape[1], 8), np.uint8)
    for i in range(width):
        out[:, (width if low else 8) - 1 - i] = own[i]
    return out.view("<u8").ravel().astype(_U, copy=False)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def from_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def least(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and each one's least value."""
    order = np.lexsort((values, keys))
    keys = keys[order]
    first = grouped(keys)[:-1]
    return keys[first], values[order][first]


def buckets_for(bytes_in_all: int) -> int:
    """Ranges of hashes: each holds what some 8 MB of text ask."""
    return max(64, bytes_in_all // (8 << 20))


def flags_for(keys: np.ndarray, buckets: int, answers: dict[int, tuple], shift: int = 0) -> np.ndarray:
    """Answered bits of sorted different keys; no answer is no."""
    out = np.zeros(len(keys), bool)
    for b, lo, hi in by_bucket(keys, buckets):
        found = answers.get(b + shift)
        if found is not None:
            out[lo:hi] = from_bits(found[0], hi - lo)
    return out


def within(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values occur in a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def places(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value in a sorted array, and whether it occurs there (the place
    says nothing if not)."""
    if not len(known):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return at, known[at] == values


class Spread:
    """``places`` for values in no order: hashes are spread evenly, so a value is first
    looked for where its upper bits begin, and searched for only if it is beyond."""

    def __init__(self, known: np.ndarray):
        self.known = known
        if len(known):
            self.low, span = known[0], int(known[-1] - known[0])
            self.shift = _U(max(span.bit_length() - (4 * len(known)).bit_length(), 0))
            self.first = np.zeros((span >> int(self.shift)) + 2, np.int32)
            np.cumsum(np.bincount(((known - self.low) >> self.shift).astype(np.int64), minlength=len(self.first) - 1), out=self.first[1:])

    def places(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = self.known
        if not len(known):
            return places(known, values)
        cell = np.minimum((np.maximum(values, self.low) - self.low) >> self.shift, _U(len(self.first) - 2))
        at = np.minimum(self.first[cell], len(known) - 1).astype(np.int64)
        found = known[at]
        some = np.flatnonzero(found < values)
        at[some], there = places(known, values[some])
        found = found == values
        found[some] = there
        return at, found


def runs(flags: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
    """(document, start, end) of the runs of true flags, cut at documents' ends;
    ``at`` holds the documents' offsets and places count from a document's start."""
    change = np.ones(len(flags) + 1, bool)
    change[1:-1] = flags[1:] != flags[:-1]
    change[at] = True
    edges = np.flatnonzero(change)
    lo, hi = edges[:-1], edges[1:]
    lo, hi = lo[flags[lo]], hi[flags[lo]]
    doc = np.searchsorted(at, lo, side="right") - 1
    return list(zip(doc.tolist(), (lo - at[doc]).tolist(), (hi - at[doc]).tolist()))


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``data`` without the (start, length) spans, which are in order."""
    if not spans:
        return data
    ends = [0, *(a + n for a, n in spans)]
    return b"".join(data[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(data)]))


def character(data: bytes, at: int) -> int:
    """The first start of a UTF-8 character from ``at`` on."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def character_before(data: bytes, at: int) -> int:
    """The last start of a UTF-8 character up to ``at``."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at
