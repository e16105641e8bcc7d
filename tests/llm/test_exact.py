import hashlib

import numpy as np
from pyspark.sql import functions as F

from bedtrace.llm import exact
from tests.llm.conftest import AWKWARD, WHITE_DELETED


def brute(rows):
    """Rows (key, text) -> multiset of (key, keep_id, group_size, kept), by plain Python."""
    groups = {}
    for no, (key, text) in enumerate(rows):
        groups.setdefault((text or "").translate(WHITE_DELETED), []).append((-len(text or ""), key is None, key, no))
    out = []
    for norm, members in groups.items():
        stays = min(members, key=lambda m: (m[0], m[1], m[2] or 0, m[3]))
        out += [(m[2], stays[2], len(members), m[3] == stays[3], hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()], key=str)


def test_filter_holds_all_its_keys_and_few_others():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 10, 1000, 20_000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        filt = exact.fuse_filter(keys)
        assert exact.may_hold(filt, keys).all()
        other = rng.integers(2**63, 2**64, 20_000, dtype=np.uint64)
        assert exact.may_hold(filt, other).mean() < 0.002
        assert len(filt[3]) < 2.6 * 1.3 * n + 500


def test_any_number_of_batches_gives_the_same(spark, docs, sample):
    want = brute(sample)
    for batches in (1, 3):
        df = exact.dedup_batches(docs, F.pmod(F.xxhash64("__key"), F.lit(batches)), batches, buckets=8)
        assert got(df) == want


def test_texts_with_one_digest_are_told_apart_by_their_bytes(spark, docs, sample):
    df = exact.dedup_batches(docs, F.pmod(F.col("__key"), F.lit(2)), 2, digest=F.crc32("__norm") % 5, buckets=4)
    assert got(df) == brute(sample)


def test_awkward_rows(spark, awkward, nothing):
    rows = [(r[0], r[1]) for r in AWKWARD]
    df = exact.dedup_batches(awkward, F.lit(0), 2, buckets=4)
    # of the two same rows with id 1 either is the one that stays
    assert got(df) == brute(rows)
    assert exact.dedup_batches(nothing, F.lit(0), 2, buckets=4).count() == 0
