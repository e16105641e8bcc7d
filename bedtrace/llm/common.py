"""Shared helpers: tables, text columns as Arrow batches, word hashes in numpy, objects kept per Python worker."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_BYTES = 32 << 20  # of one Arrow batch, so that very long texts do not meet in one batch
WHITE = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def kept_object(key: object, make: Callable[[], object]) -> object:
    """One object per Python worker: functions travel by value, so their own globals do not outlive a task."""
    store = sys.__dict__.setdefault("_bedtrace_objects", {})
    if key not in store:
        store[key] = make()
    return store[key]


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches end after some bytes as well as after some rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_text(df: DataFrame, cols: list[str], text: str, out: T.StructType, fn: Callable[[pa.Array], list]) -> DataFrame:
    """``cols`` of every row and what ``fn`` makes of its text (null counts as empty), batch by batch.

    ``fn`` gets the string array of a batch and returns one array or list for each field of ``out``. Other columns of
    ``df`` are left behind, and a column of ``cols`` that is named like one of ``out`` gives way to it.
    """
    bound_batches(df.sparkSession)
    cols = [c for c in cols if c not in out.fieldNames()]
    src = df.select(*[F.col(f"`{c}`") for c in cols], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    schema = T.StructType([src.schema[c] for c in cols] + out.fields)
    names = out.fieldNames()
    kinds = [_arrow(f.dataType) for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, k) for x, k in zip(fn(b.column(len(cols))), kinds)]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(cols))] + made, names=cols + names)

    return src.mapInArrow(run, schema)


def _arrow(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow(t.elementType))
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[t.simpleString()]


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a batch and the offsets of its texts, without a copy."""
    wide = pa.types.is_large_string(arr.type)
    _, offs, data = arr.buffers()
    if data is None or len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


IS_WHITE = np.zeros(256, bool)
IS_WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
STEP = 0xD6E8FEB86659FD93  # odd: a change of one byte always changes the hash


def words_of(data: np.ndarray, offs: np.ndarray, block: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and 64-bit hash (A-Z in lower case) of each word `[^\\x20\\x09-\\x0D]+` of the texts.

    Bytes are worked on in blocks that end at white space or between two texts, so memory follows the block (or the
    longest word), not the text. White space is ASCII, so no word border falls inside a character.
    """
    n, at = len(data), 0
    starts, lens, hashes = [], [], []
    while at < n:
        end = min(n, at + block)
        while end < n:
            # the last text border or white space before the end
            k = np.searchsorted(offs, end, "right") - 1
            low = max(at + 1, int(offs[k]))
            white = np.flatnonzero(IS_WHITE[data[low:end]])
            if len(white) or offs[k] > at:
                end = low + int(white[-1]) + 1 if len(white) else int(offs[k])
                break
            end = min(n, end + block)  # one word longer than the block
        part = data[at:end]
        black = ~IS_WHITE[part]
        first = black.copy()
        first[1:] &= ~black[:-1]
        inner = offs[np.searchsorted(offs, at, "right") : np.searchsorted(offs, end, "left")] - at
        first[inner] = black[inner]
        s = np.flatnonzero(first)
        if len(s):
            idx = np.flatnonzero(black)
            begin = np.searchsorted(idx, s)
            size = np.diff(np.append(begin, len(idx)))
            pos = np.arange(len(idx)) - np.repeat(begin, size)
            power = np.full(int(size.max()), STEP, np.uint64)
            power[0] = 1
            h = np.add.reduceat(CODES[LOWER[part[idx]]] * np.cumprod(power)[pos], begin)
            starts.append(s + at)
            lens.append(size)
            hashes.append(mixed(h + size.astype(np.uint64)))
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(lens), np.concatenate(hashes)


def doc_counts(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Number of words of each text."""
    return np.diff(np.searchsorted(starts, offs))
