"""Words and shingles of Arrow string columns as NumPy arrays, without a Python loop over words.

A word is a run of bytes other than space and tab to carriage return ([^\\x20\\x09-\\x0D]+); A-Z are lower-cased.
Words and shingles are 64-bit hashes. A collision needs two different words with one hash among those compared,
odds of about n*n/2**65 for n distinct ones.
"""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.shared import materialize

#: Bytes of text that are turned into arrays at once. A longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: What reused Python workers keep from task to task, by name, and how it is dropped.
KEPT: dict[str, Callable[[], None]] = {"powers": _powers.clear}
#: Rows and bytes of an Arrow batch between the JVM and Python, unless the session sets its own.
ARROW_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are small: batches of 10,000 documents would be held by the JVM and by Python at once."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        for name, value in ARROW_LIMITS.items():
            conf.set(name, value)
    return df


def released(*keeps: str) -> Callable:
    """For tasks (batches, ...) -> batches in reused workers: what others have kept goes at the start, unless named; freed memory goes back at the end."""

    def deco(task: Callable) -> Callable:
        @wraps(task)
        def run(*args, **named) -> Iterator[pa.RecordBatch]:
            drop_kept(keeps)
            try:
                yield from task(*args, **named)
            finally:
                give_back()

        return run

    return deco


def drop_kept(keeps: tuple[str, ...]) -> None:
    for name, drop in KEPT.items():
        if name not in keeps:
            drop()


def give_back() -> None:
    """Returns freed memory to the system: the allocators of Arrow and of C keep it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


#: Partial results that one task adds up.
FAN_IN = 16


def add_in_tree(parts: DataFrame, add: Callable[[pa.Table], pa.Table], schema: str, *by: str) -> DataFrame:
    """FAN_IN sums at most of parts(at, *by, ...) for each value of `by`. at: numbers of tasks; add: from rows of a group to one row of the schema.

    A tree of bounded fan-in: no task reads more than FAN_IN rows, however many tasks there were. parts is read twice: a written table.
    """
    most = parts.agg(F.max("at").alias("n")).first()["n"] or 0
    while most >= FAN_IN:
        parts = parts.withColumn("at", F.floor(F.col("at") / FAN_IN))
        keys = ["at", *by]

        def sums(key: tuple, t: pa.Table) -> pa.Table:
            out = add(t)
            for name, value in zip(keys, key, strict=True):
                out = out.append_column(name, pa.array([value.as_py()], pa.int64()))
            return out.select(["at", *by, *add_columns])

        add_columns = [x.split()[0] for x in schema.split(", ")]
        parts = materialize(parts.groupBy(*keys).applyInArrow(sums, ", ".join([*(f"{k} long" for k in keys), schema])), "parts")
        most //= FAN_IN
    return parts


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= CHUNK_BYTES + 1:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows and the end) of a string array in pieces; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    if not wide and not pa.types.is_string(texts.type):
        texts, wide = texts.cast(pa.large_string()), True
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if n and texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, "right")) - 1)
        hi = min(hi, n)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, trim: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its length in bytes, index of the first word of each row and the end). trim: of words without symbols at their ends."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inner = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inner[:-1]))
    starts = np.flatnonzero(inner & (~before | edge[:-1]))
    after = np.concatenate((inner[1:], [False]))
    ends = np.flatnonzero(inner & (~after | edge[1:])) + 1
    if trim:
        starts, ends = trimmed(data, starts, ends, offsets)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:])
    length = ends - starts
    hashes = mix((sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(data))[starts] + length.astype(np.uint64))
    return hashes, length, np.searchsorted(starts, offsets)


_symbols: list[np.ndarray] = []


def symbol_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to symbols (Unicode punctuation and symbols)."""
    if not _symbols:
        _symbols.append(np.fromiter((unicodedata.category(chr(c))[0] in "PS" for c in range(0x110000)), bool, 0x110000))
    table = _symbols[0]
    out = table[:128][np.minimum(data, 127)] & (data < 128)
    for low, high, size in ((0xC0, 0xE0, 2), (0xE0, 0xF0, 3), (0xF0, 0xF8, 4)):
        at = np.flatnonzero((data >= low) & (data < high))
        if len(at):
            code = data[at].astype(np.int64) & (0x7F >> size)
            for j in range(1, size):
                code = code << 6 | data[at + j] & 0x3F
            at = at[table[code]]
            for j in range(size):
                out[at + j] = True
    return out


def trimmed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words (starts, ends) without the symbols at their ends. Words of symbols alone are dropped, unless a row has no others."""
    core = np.flatnonzero(~symbol_bytes(data))
    lo, hi = np.searchsorted(core, starts), np.searchsorted(core, ends)
    full = hi > lo
    starts, ends = starts.copy(), ends.copy()
    starts[full], ends[full] = core[lo[full]], core[hi[full] - 1] + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    keep = full | (np.bincount(row[full], minlength=len(offsets))[row] == 0)
    return starts[keep], ends[keep]


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Of each row, the sorted distinct hashes of its runs of k words; of fewer words, one hash of them all."""
    n = len(hashes)
    run = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        run = mix(run * np.uint64(31) + hashes[j : n - k + 1 + j]) if len(run) else run
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= k:
            s = np.sort(run[lo : hi - k + 1])
            yield s if len(s) < 2 else s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif hi > lo:
            h = np.array([hi - lo], np.uint64)
            for j in range(lo, hi):
                h = mix(h * np.uint64(131) + hashes[j : j + 1])
            yield h
        else:
            yield np.zeros(0, np.uint64)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The shingle set of every row."""
    for _, data, offsets in chunks(texts):
        hashes, _, first = words(data, offsets)
        yield from shingles(hashes, first, k)


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about `most` bytes in the column at most (a longer row alone)."""
    for batch in batches:
        rows = batch.num_rows
        step = max(1, min(rows, int(rows * most / max(1, batch.column(column).nbytes))))
        for lo in range(0, rows, step):
            yield batch.slice(lo, step)
