"""Exact dedup of documents that arrive in batches.

A batch that has been taken in becomes an immutable snapshot: its distinct digests in exact buckets, and one static
binary-fuse filter per bucket. The digests of the next batch are screened by the filters; only those that a filter
lets pass join the exact buckets, and what is found there is compared byte by byte. Copies inside the new batch are
grouped among themselves, apart from the filters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bedtrace.llm.common import WHITE, documents, mixed
from bedtrace.session import cut_lineage

BUCKETS = 2048
BUCKET_DIGESTS = 1 << 20  # more digests than this in a bucket on average mean more buckets
MARK_BITS = 1 << 24  # 2 MB as bitmaps, whatever the size of the data


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


# --- static binary-fuse filter (3-wise, 16-bit fingerprints) over 64-bit keys ---


def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots in neighbouring segments and the fingerprint of each key."""
    h = mixed(keys + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1)))
    h2 = mixed(h ^ np.uint64(0xC2B2AE3D27D4EB4F))
    first = (h >> np.uint64(32)) % np.uint64(segments)
    mask = np.uint64(segment - 1)
    at = [(first + np.uint64(i)) * np.uint64(segment) + ((h2 >> np.uint64(20 * i)) & mask) for i in range(3)]
    return np.stack(at).astype(np.int64), (h & np.uint64(0xFFFF)).astype(np.uint16)


def fuse_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """seed, segment length, number of first segments, fingerprints of a filter that holds every key of ``keys``.

    Built by peeling in waves: all slots with a single key left give up that key at once (a key's other slots hold other
    keys as well, so the keys of one wave do not meet in an owned slot), and fingerprints are set wave by wave backwards.
    """
    keys = np.unique(keys)
    n = len(keys)
    segment = 1 << max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
    segments = max(1, -(-int(1.23 * n + 16) // segment) - 2)
    for seed in range(1, 1000):
        if seed % 10 == 0:
            segments += max(1, segments // 10)  # unlucky ten times: a little more room
        at, prints = _slots(keys, seed, segment, segments)
        size = (segments + 2) * segment
        count = np.bincount(at.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)  # xor of the keys of a slot
        for i in range(3):
            np.bitwise_xor.at(owner, at[i], np.arange(n))
        waves, left = [], n
        while left:
            slot = np.flatnonzero(count == 1)
            key, where = np.unique(owner[slot], return_index=True)
            if not len(key):
                break
            waves.append((key, slot[where]))
            left -= len(key)
            for i in range(3):
                np.subtract.at(count, at[i][key], 1)
                np.bitwise_xor.at(owner, at[i][key], key)
        if left:
            continue
        table = np.zeros(size, np.uint16)
        for key, slot in reversed(waves):
            table[slot] = 0
            table[slot] = prints[key] ^ table[at[0][key]] ^ table[at[1][key]] ^ table[at[2][key]]
        return seed, segment, segments, table.tobytes()
    raise ValueError("the filter could not be built")


def may_hold(filt: tuple[int, int, int, bytes], keys: np.ndarray) -> np.ndarray:
    seed, segment, segments, raw = filt
    table = np.frombuffer(raw, np.uint16)
    at, prints = _slots(keys, seed, segment, segments)
    return prints == (table[at[0]] ^ table[at[1]] ^ table[at[2]])


FILTER = "bucket long, seed long, segment long, segments long, prints binary"


def build_filters(digests: DataFrame, buckets: int) -> DataFrame:
    """One filter row per bucket of the distinct ``digest`` values of a snapshot; written once, never changed."""

    def build(group: pa.Table) -> pa.Table:
        seed, segment, segments, raw = fuse_filter(group["h"].to_numpy().view(np.uint64))
        return pa.table([pa.array([group["bucket"][0].as_py()]), pa.array([seed]), pa.array([segment]), pa.array([segments]), pa.array([raw], pa.binary())],
                        names=["bucket", "seed", "segment", "segments", "prints"])

    return cut_lineage(_bucketed(digests, buckets).groupBy("bucket").applyInArrow(build, FILTER))


def _bucketed(digests: DataFrame, buckets: int) -> DataFrame:
    h = F.xxhash64("digest")
    return digests.select("digest", h.alias("h"), F.pmod(F.xxhash64("digest", F.lit(7)), F.lit(buckets)).alias("bucket"))


def screen(digests: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The ``digest`` values that the filter of their bucket lets pass: all that the snapshot holds, and about one other in 65,536."""

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return left.select(["digest"]).slice(0, 0)
        filt = tuple(right[c][0].as_py() for c in ("seed", "segment", "segments", "prints"))
        return left.select(["digest"]).filter(pa.array(may_hold(filt, left["h"].to_numpy().view(np.uint64))))

    kind = digests.schema["digest"].dataType.simpleString()
    return _bucketed(digests, buckets).groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(probe, f"digest {kind}")


def dedup_batches(df: DataFrame, batch: Column, batches: int, key: str = "doc_id", text: str = "text", digest: Column | None = None, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of ``df``: ``key``, keep_id, group_size, kept, text_sha256.

    The batches 0, 1, ... of ``batch`` arrive one after the other; each finds copies in itself and in the snapshots of
    all batches before it. The batch a row arrives in decides how its copy is found, not what the result is. Texts are
    equal when their bytes without white space are; of equal texts the row with most code points, then the smallest
    ``key`` (null last), then one of several same rows stays. ``digest`` (over column ``__norm``) only routes: texts
    with one digest but other bytes stay apart. Null text counts as empty; an empty table gives an empty result.
    Extra columns are left behind.

    A digest that occurs once is settled by counts alone. Texts whose digest occurs again are read a second time (found
    by bitmaps of MARK_BITS bits, a fixed size that may be broadcast; where they are crowded, more texts go through and
    come out alone) and grouped by their bytes, with the copies of each task combined before the shuffle, so a group of
    any size is spread over all tasks.
    """
    norm = normalised(F.col("__text"))
    src = df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"), batch.alias("__batch"))
    route = F.xxhash64("__norm") if digest is None else digest
    rows = src.withColumn("__norm", norm).select(
        "__key", F.coalesce(F.length("__text"), F.lit(0)).alias("points"), F.sha2("__norm", 256).alias("text_sha256"), route.alias("digest"), F.coalesce("__batch", F.lit(0)).alias("batch"))
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    buckets = max(buckets, -(-rows.count() // BUCKET_DIGESTS))

    snapshots: list[tuple[DataFrame, DataFrame]] = []
    again: DataFrame | None = None  # digests whose bytes have to be compared
    for no in range(batches):
        # new-batch copies: grouped among themselves
        new = cut_lineage(rows.filter(F.col("batch") == no).groupBy("digest").agg(F.count("*").alias("n")))
        found = new.filter("n > 1").select("digest")
        for held, filters in snapshots:
            passed = screen(new.select("digest"), filters, buckets)
            found = found.unionByName(passed.join(held.select("digest"), "digest"))  # the exact bucket decides
        again = found if again is None else again.unionByName(found)
        if no + 1 < batches:
            snapshots.append((new, build_filters(new, buckets)))
    again = cut_lineage(again.distinct())

    # byte check: rows of these digests grouped by the bytes themselves
    texts = src.withColumn("__norm", norm).select("__key", F.coalesce(F.length("__text"), F.lit(0)).alias("points"), "__norm", route.alias("digest"))
    mark = lambda: F.pmod(F.xxhash64("digest", F.lit(11)), F.lit(MARK_BITS))
    marks = again.groupBy(F.bitmap_bucket_number(mark()).alias("mark_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(mark())).alias("bits"))
    place = F.bitmap_bit_position(mark())
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    texts = texts.withColumn("mark_bucket", F.bitmap_bucket_number(mark())).join(F.broadcast(marks), "mark_bucket")
    suspect = texts.filter(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1)  # all rows that matter, and a few that are alone
    best = F.max(F.struct("points", F.col("__key").isNotNull().alias("known"), F.bitwise_not("__key").alias("turned"))).alias("best")
    classes = suspect.groupBy("digest", "__norm").agg(F.count("*").alias("group_size"), best)
    classes = cut_lineage(classes.select("digest", "__norm", "group_size", F.bitwise_not("best.turned").alias("keep_id"), F.col("best.points").alias("best_points")))
    clash = cut_lineage(classes.groupBy("digest").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    plain = classes.join(clash, "digest", "left_anti").select("digest", "group_size", "keep_id", "best_points")
    out = rows.join(plain, "digest", "left")
    if not clash.isEmpty():  # one digest, several texts: these rows are told apart by their bytes
        apart = rows.join(clash, "digest", "left_semi")
        other = classes.join(clash, "digest", "left_semi").select("digest", "group_size", "keep_id", "best_points", F.sha2("__norm", 256).alias("text_sha256"))
        out = rows.join(clash, "digest", "left_anti").join(plain, "digest", "left").unionByName(apart.join(other, ["digest", "text_sha256"], "left").select(*rows.columns, "group_size", "keep_id", "best_points"))
    alone = F.col("group_size").isNull()
    out = out.select(
        "__key", F.when(alone, F.col("__key")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("__key").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("best_points")))).alias("kept"), "text_sha256", "row")
    # several same rows with the key that stays: one of them
    twins = out.filter("kept and group_size > 1").groupBy("text_sha256", "keep_id").agg(F.count("*").alias("n"), F.min("row").alias("one")).filter("n > 1")
    twins = cut_lineage(twins)
    if not twins.isEmpty():
        out = out.join(twins.select("text_sha256", "one"), "text_sha256", "left").withColumn("kept", F.col("kept") & (F.col("one").isNull() | (F.col("one") == F.col("row")))).drop("one")
    return out.select(F.col("__key").alias(key), "keep_id", "group_size", "kept", "text_sha256")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of two arrivals, by a hash of the id, is the snapshot of the second."""
    return dedup_batches(documents(spark, sf_dir), F.pmod(F.xxhash64("__key"), F.lit(2)), 2)


OP1_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""
