import itertools
import random

import public_tokenizers
import pytest
import sentencepiece

from bedtrace.llm import pieces
from tests.llm.conftest import AWKWARD

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return pieces.load(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_and_texts_equal_the_library(both, sample):
    own, lib = both
    rng = random.Random(1)
    pool = "abc ABCdeth   \n\té日本😀▁0123..,,-_ étheing<s>"
    texts = [t for _, t in sample] + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for t in texts:
        ids = own.encode(t).tolist()
        assert ids == lib.encode(t)
        assert own.decode(ids) == lib.decode(ids)
    for _ in range(1500):
        ids = [rng.choice([rng.randint(3, 258), rng.randint(3, 31_999)]) for _ in range(rng.randint(0, 8))]
        assert own.decode(ids) == lib.decode(ids)


def test_unigram_relaxes_to_the_best_sum():
    rng = random.Random(2)
    vocab = ["<unk>", "a", "b", "▁", "ab", "ba", "aab", "▁a", "bb", "abab"]
    for _ in range(60):
        scores = [0.0] + [-rng.random() * 5 for _ in vocab[1:]]
        m = pieces.Pieces(vocab, scores, [False] + [True] * (len(vocab) - 1), None, 0, bpe=False, dummy_prefix=False)
        w = "".join(rng.choice("ab") for _ in range(rng.randint(2, 9)))
        cuts = [_cut(w, bits) for bits in itertools.product((0, 1), repeat=len(w) - 1)]
        best = max(sum(scores[vocab.index(p)] for p in cut) for cut in cuts if all(p in vocab for p in cut))
        assert abs(sum(scores[i] for i in m.word(w)) - best) < 1e-9


def _cut(w, bits):
    at = [0] + [i + 1 for i, b in enumerate(bits) if b] + [len(w)]
    return [w[a:b] for a, b in zip(at, at[1:])]


def test_query_gives_whole_texts_back(spark, sample):
    out = pieces.op3_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert len(out) == len(sample) and all(r.round_trip and r.n_ids == len(r.ids) for r in out)


def test_awkward_rows(spark, awkward, nothing, both):
    out = pieces.encode_texts(awkward, PATH, ["doc_id", "ids"])
    assert out.columns == ["doc_id", "ids"]
    back = pieces.decode_ids(out, PATH, ["doc_id"]).collect()
    assert sorted(r.decoded for r in back) == sorted(r[1] or "" for r in AWKWARD)
    assert sorted(map(list, (r.ids for r in out.collect()))) == sorted(both[1].encode(r[1] or "") for r in AWKWARD)
    assert pieces.encode_texts(nothing, PATH, ["doc_id"]).count() == 0
