import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from bedtrace.llm import packing, tokens
from tests.llm.conftest import AWKWARD

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(library, sample):
    enc = tokens.Encoder(PATH)
    rng = random.Random(3)
    pool = "abc ABC  \n\t'sre'll09,.<|endoftext|>éßŁ\xa0\x85\x1c日本😀٣"
    texts = [t for _, t in sample] + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(500)] + ["a<|endoftext|>b <|endoftext|>", "<|endof"]
    for t in texts:
        assert enc.ids(t) == ids(library, t)


@pytest.mark.parametrize("chunk,overlap", [(40, 20), (64, 64), (300, 40)])
def test_spliced_parts_equal_the_whole(library, sample, chunk, overlap):
    enc = tokens.Encoder(PATH)
    texts = [t for _, t in sample[:40]] + ["x" * 900 + " end", "we'll  <|endoftext|> they've " * 40, " " * 500 + "a"]
    for t in texts:
        assert [i for part in enc.id_parts(t, chunk, overlap) for i in part] == ids(library, t)


def test_distributed_splice_counts_as_the_library(spark, docs, sample, library):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs, PATH, ["doc_id"], chunk=400, overlap=60).collect()}
    want = {k: (len(t.encode()), n := len(ids(library, t)), n > 512) for k, t in sample}
    assert got == want


def test_overlaps_are_widened_where_no_border_is_common(spark, library):
    texts = ["x" * 5000, "ab " * 50 + "y" * 3000 + " end of it", " " * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df, PATH, ["doc_id"], chunk=200, overlap=30).collect()}
    assert got == {i: len(ids(library, t)) for i, t in enumerate(texts)}


def test_sentencepiece_files_count_as_well(spark, docs, sample):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs.limit(30), path, ["doc_id"]).collect()}
    texts = dict(sample)
    assert got == {k: len(sp.encode(texts[k])) for k in got}


def test_awkward_rows(spark, awkward, nothing, library):
    out = tokens.count_tokens(awkward, PATH, ["doc_id", "n_tokens"], chunk=500, overlap=60)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in out.collect())
    assert got == sorted((str(r[0]), len((r[1] or "").encode()), len(ids(library, r[1]))) for r in AWKWARD)
    assert tokens.count_tokens(nothing, PATH, ["doc_id"]).count() == 0


def test_first_fit_decreasing_is_first_fit():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 300):
        sizes = rng.integers(1, 101, n)
        bins, at = packing.first_fit_decreasing(sizes, 100)
        free: list[int] = []
        for i in np.argsort(-sizes, kind="stable"):
            k = next((j for j, f in enumerate(free) if f >= sizes[i]), len(free))
            if k == len(free):
                free.append(100)
            assert (bins[i], at[i]) == (k, 100 - free[k])
            free[k] -= sizes[i]


def check_pieces(rows, texts, library, capacity):
    """Each id in exactly one piece, checksums right, sequences gapless and not overfull."""
    docs: dict = {}
    seqs: dict = {}
    for r in rows:
        docs.setdefault(str(r.doc_id), []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    for key, text in texts:
        want = [*ids(library, text), 0]
        same = [k for k, t in texts if str(k) == str(key)]
        parts = sorted(docs[str(key)], key=lambda r: r.start)
        assert sum(r.length for r in parts) == len(want) * len(same)
        for r in parts:
            assert r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(np.array(want[r.start : r.start + r.length], "<u4").tobytes())
    return sum(r.length for r in rows), len(seqs)


def test_pieces_cover_all_ids(spark, docs, sample, library):
    rows = packing.pack(docs, PATH, capacity=128, group_docs=40).collect()
    total, used = check_pieces(rows, sample, library, 128)
    assert total / (used * 128) > 0.97


def test_packing_of_awkward_rows(spark, awkward, nothing, library):
    rows = packing.pack(awkward, PATH, group_docs=4).collect()
    check_pieces(rows, [(r[0], r[1]) for r in AWKWARD], library, 1024)
    assert packing.pack(nothing, PATH).count() == 0
