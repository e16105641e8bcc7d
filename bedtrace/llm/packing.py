"""Packing of documents into sequences: first-fit decreasing with a tournament tree of bin capacities, run independently
in randomised groups of documents."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bedtrace.llm.common import documents, map_text
from bedtrace.llm.tokens import CHUNK_CHARS, OVERLAP, encoder
from bedtrace.session import cut_lineage

CAPACITY = 1024
GROUP_DOCS = 4096
END_ID = 0


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece (sizes of 1 to ``capacity``), ties in the given order.

    A tournament tree holds at each node the largest free capacity below it, so the leftmost bin that fits is found in
    one walk from the root.
    """
    n = len(sizes)
    leaves = 1
    while leaves < n:
        leaves *= 2
    free = [capacity] * (2 * leaves)
    bins, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        s, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if free[node] < s:
                node += 1
        bins[i], at[i] = node - leaves, capacity - free[node]
        free[node] -= s
        while node > 1:
            node //= 2
            top = max(free[2 * node], free[2 * node + 1])
            if free[node] == top:
                break
            free[node] = top
    return bins, at


TOKENS = T.StructType([T.StructField("doc_tokens", T.LongType()), T.StructField("crcs", T.ArrayType(T.LongType()))])
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def piece_checksums(parts: Iterable[list[int]], capacity: int) -> tuple[int, list[int]]:
    """Number of ids, and the CRC-32 of each piece of ``capacity`` ids (the last may be shorter)."""
    total, filled, crc, crcs = 0, 0, 0, []
    for ids in parts:
        total += len(ids)
        raw = memoryview(np.array(ids, "<u4").tobytes() if array("I").itemsize != 4 else array("I", ids).tobytes())
        at = 0
        while at < len(raw):
            take = raw[at : at + 4 * (capacity - filled)]
            crc, filled, at = zlib.crc32(take, crc), filled + len(take) // 4, at + len(take)
            if filled == capacity:
                crcs.append(crc)
                crc, filled = 0, 0
    return total, crcs + [crc] * (filled > 0)


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``key``, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and ``end_id``; it is cut every ``capacity`` ids. Full pieces are sequences of their own, the
    rest piece of each document is packed. Documents are dealt into groups of about ``group_docs`` by a hash of a row
    number and each group packs for itself, so the padding is that of a few open bins per group. Only lengths and
    checksums are shuffled. Null and empty texts are the end id alone; repeated rows and null keys are documents of
    their own; an empty table gives an empty result; other columns are left behind.
    """

    def encode(arr: pa.Array) -> list:
        enc = encoder(path)
        sizes, crcs = [], []
        for x in arr:
            t = x.as_py()
            parts = enc.id_parts(t) if len(t) > CHUNK_CHARS + OVERLAP else [enc.ids(t)]
            n, c = piece_checksums(_and_end(parts, end_id), capacity)
            sizes.append(n)
            crcs.append(c)
        return [sizes, crcs]

    src = df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    kind = src.schema["__key"].dataType.simpleString()
    lengths = cut_lineage(map_text(src, ["__key"], "__text", TOKENS, encode).withColumn("row", F.monotonically_increasing_id()))
    groups = max(1, -(-lengths.count() // group_docs))
    dealt = lengths.withColumn("grp", F.pmod(F.xxhash64("row", F.lit(42)), F.lit(groups)))

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        n = group["doc_tokens"].to_numpy()
        count, full = -(-n // capacity), n // capacity
        rest = n - full * capacity
        bins, at = first_fit_decreasing(rest[rest > 0], capacity)
        used = int(bins.max()) + 1 if len(bins) else 0
        doc = np.repeat(np.arange(len(n)), count)
        no = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        is_full = no < full[doc]
        seq, off = np.empty(len(doc), np.int64), np.zeros(len(doc), np.int64)
        seq[is_full] = used + np.arange(int(is_full.sum()))
        seq[~is_full], off[~is_full] = bins, at
        seq += group["grp"][0].as_py() << 32
        crcs = group["crcs"].combine_chunks().flatten()
        return pa.table([group["__key"].take(pa.array(doc)), pa.array(no * capacity), pa.array(np.where(is_full, capacity, rest[doc])), crcs, pa.array(n[doc]), pa.array(seq), pa.array(off)],
                        names=["__key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return dealt.groupBy("grp").applyInArrow(place, f"__key {kind}, {PIECES}").withColumnRenamed("__key", key)


def _and_end(parts: Iterable[list[int]], end_id: int) -> Iterator[list[int]]:
    yield from parts
    yield [end_id]


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
