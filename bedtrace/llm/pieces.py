"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces.

One pass over a word visits, at each position, the pieces that end there, by the automaton's output links, and relaxes
the best way to reach the position:

* unigram models: the largest sum of piece scores (Viterbi);
* BPE models: a sum of scores is not what BPE computes, so the state of a position is the last piece of the encoding
  of the text up to it, and a piece is taken if it may follow the state of the place where it begins. Two neighbours may
  stand together exactly if merging their joint text gives just these two; a sequence is the BPE encoding of a text
  exactly if all its neighbours may stand together, since a merge across a border depends on the two pieces beside it
  alone. So at each position one piece fits, and the pass is exact.

A text falls into words at places that no piece crosses (before a blank mark after another character, before
signs that no piece has behind a letter, and around characters that occur in no longer piece), and a word is worked out once per task and then looked up.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bedtrace.llm.common import bound_batches, documents, kept_object, map_text

BLANK = "▁"
CACHED_WORDS = 3 << 17


def _fields(raw: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, raw[at : at + n]
            at += n


class Pieces:
    """A model of plain pieces: {piece: score}, byte pieces, BPE or unigram."""

    def __init__(self, pieces: list[str], scores: list[float], usable: list[bool], byte_ids: list[int] | None, unknown: int, bpe: bool, dummy_prefix: bool = True):
        import ahocorasick

        self.pieces, self.scores, self.byte_ids, self.unknown, self.bpe, self.dummy_prefix = pieces, scores, byte_ids, unknown, bpe, dummy_prefix
        self.id_of = {p: i for i, p in enumerate(pieces) if usable[i]}
        self.score_of = {p: scores[i] for p, i in self.id_of.items()}
        self.auto = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            if not bpe or len(p) == 1 or self._merged(p) == [p]:  # BPE never ends with the others
                self.auto.add_word(p, (len(p), i))
        self.auto.make_automaton()
        self.words: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        inner = sorted({c for p in self.id_of if len(p) > 1 for c in p} | {BLANK})
        if any(BLANK in p.lstrip(BLANK) for p in self.id_of):
            raise ValueError("pieces that hold a blank inside are not supported")
        # A word goes on from a letter or digit to another sign only where some piece has the sign behind one.
        inside = [c for c in inner if c != BLANK]
        behind = {b for p in self.id_of for a, b in zip(p, p[1:]) if a.isalnum()}
        letters = "".join(re.escape(c) for c in inside if c.isalnum())
        signs = "".join(re.escape(c) for c in inside if not c.isalnum())
        joined = "".join(re.escape(c) for c in inside if not c.isalnum() and c in behind)
        some = [f"[{signs}]+" + f"[{letters}]*" * bool(letters)] * bool(signs) + [f"[{letters}]+"] * bool(letters)
        more = f"(?:[{joined}]" + f"[{signs}]*" * bool(signs) + f"[{letters}]*" * bool(letters) + ")*" if joined else ""
        parts = [f"{BLANK}*(?:{'|'.join(some)}){more}"] * bool(some)
        self.cut = re.compile("|".join([*parts, f"{BLANK}+", f"[^{letters}{signs}{BLANK}]"]))
        self.whole = all(c in self.id_of for c in inner)  # every position of a word has a piece
        self.floor = min(self.score_of.values(), default=0.0) - 10

    def _merged(self, text: str) -> list[str]:
        """BPE of a short text, merge by merge: best score first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score_of.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _together(self, a: int, b: int) -> bool:
        ok = self.pairs.get(a << 32 | b)
        if ok is None:
            if len(self.pairs) >= CACHED_WORDS:
                self.pairs.clear()
            x, y = self.pieces[a], self.pieces[b]
            ok = self.pairs[a << 32 | b] = self._merged(x + y) == [x, y]
        return ok

    def _bpe_word(self, w: str) -> tuple[int, ...]:
        """``word`` for BPE where every character is a piece."""
        last, width, known = [-1] * (len(w) + 1), [0] * (len(w) + 1), self.pairs
        for end, (size, i) in self.auto.iter(w):
            end += 1
            if last[end] >= 0:
                continue
            if end != size:
                before = last[end - size]
                ok = known.get(before << 32 | i)
                if ok is None:
                    ok = self._together(before, i)
                if not ok:
                    continue
            last[end], width[end] = i, size
        out, e = [], len(w)
        while e:
            out.append(last[e])
            e -= width[e]
        out.reverse()
        return tuple(out)

    def _unknown(self, c: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in c.encode()) if self.byte_ids else (self.unknown,)

    def word(self, w: str) -> tuple[int, ...]:
        n = len(w)
        if n == 1:
            return (self.id_of[w],) if w in self.id_of else self._unknown(w)
        if self.bpe and self.whole:
            return self._bpe_word(w)
        last = [-1] * (n + 1)  # piece that ends at a position, -2: an unknown character
        width = [1] * (n + 1)
        if self.bpe:
            done = 0
            for end, (size, i) in self.auto.iter(w):
                end += 1
                while done < end - 1:  # positions without any piece
                    done += 1
                    if last[done] == -1:
                        last[done] = -2
                if last[end] != -1:
                    continue
                start = end - size
                before = last[start] if start else -2
                if before != -1 and (before == -2 or self._together(before, i)):
                    last[end], width[end] = i, size
            for k in range(1, n + 1):
                if last[k] == -1:
                    last[k] = -2
        else:
            best = [0.0] + [float("-inf")] * n
            done = 0
            hits: list[tuple[int, int, int]] = [(e + 1, s, i) for e, (s, i) in self.auto.iter(w)]
            at = 0
            for done in range(1, n + 1):
                best[done], last[done] = best[done - 1] + self.floor, -2
                if w[done - 1] in self.id_of:
                    best[done] = float("-inf")
                while at < len(hits) and hits[at][0] == done:
                    _, size, i = hits[at]
                    s = best[done - size] + self.scores[i]
                    if s > best[done]:
                        best[done], last[done], width[done] = s, i, size
                    at += 1
        out: list[int] = []
        e = n
        while e:
            if last[e] == -2:
                out.extend(reversed(self._unknown(w[e - 1])))
                e -= 1
            else:
                out.append(last[e])
                e -= width[e]
        return tuple(reversed(out))

    def encode(self, text: str) -> array:
        out = array("i")
        if not text:
            return out
        known = self.words
        for w in self.cut.findall((BLANK if self.dummy_prefix else "") + text.replace(" ", BLANK)):
            ids = known.get(w)
            if ids is None:
                ids = self.word(w)
                if len(w) <= 64:
                    if len(known) >= CACHED_WORDS:
                        known.clear()
                    known[w] = ids
            out.extend(ids)
        return out

    def decode(self, ids) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD one by one."""
        value = self.byte_values
        parts: list[str] = []
        pending = bytearray()
        for i in ids:
            b = value.get(i)
            if b is not None and b >= 0x80:
                pending.append(b)
                continue
            if pending:
                parts.append(_utf8(bytes(pending)))
                pending.clear()
            parts.append(self.pieces[i] if b is None else chr(b))
        if pending:
            parts.append(_utf8(bytes(pending)))
        if self.dummy_prefix and parts and parts[0].startswith(BLANK):
            parts[0] = parts[0][1:]
        return "".join(parts).replace(BLANK, " ")

    @property
    def byte_values(self) -> dict[int, int]:
        if not hasattr(self, "_values"):
            self._values = {i: b for b, i in enumerate(self.byte_ids or [])}
        return self._values


def _utf8(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for n in (2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def load(path: str) -> Pieces:
    """Pieces of a .model file without its own normalisation rules."""
    with open(path, "rb") as f:
        raw = f.read()
    pieces, scores, kinds = [], [], []
    bpe, dummy = False, True
    for no, value in _fields(raw):
        if no == 1:
            piece, score, kind = "", 0.0, 1
            for k, v in _fields(value):
                if k == 1:
                    piece = v.decode()
                elif k == 2:
                    score = float(np.frombuffer(v, "<f4")[0])
                elif k == 3:
                    kind = v
            pieces.append(piece)
            scores.append(score)
            kinds.append(kind)
        elif no == 2:
            bpe = dict(_fields(value)).get(3, 1) == 2
        elif no == 3:
            norm = dict(_fields(value))
            dummy = bool(norm.get(3, 1))
            if norm.get(2) or norm.get(4, 1):
                raise ValueError("models that normalise the text or take out blanks are not supported")
    if any(k in (4, 5) for k in kinds):
        raise ValueError("user-defined and unused pieces are not supported")
    byte_ids = [pieces.index(f"<0x{b:02X}>") for b in range(256)] if 6 in kinds else None
    return Pieces(pieces, scores, [k == 1 for k in kinds], byte_ids, kinds.index(2), bpe, dummy)


def model(path: str) -> Pieces:
    return kept_object(("pieces", path), lambda: load(path))


IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))
ROUND_TRIP = T.StructField("round_trip", T.BooleanType())


def encode_texts(df: DataFrame, path: str, cols: list[str], text: str = "text", decode: bool = False) -> DataFrame:
    """``cols`` of every row with ids (array of int) of its whole text. Null or empty text: no ids.

    With ``decode`` the ids are decoded again on the spot, and round_trip tells whether they give the text back.
    Rows are independent: repeated rows are encoded row by row, an empty table gives an empty result, a column of
    ``cols`` named like an output gives way to it.
    """

    def run(arr: pa.Array) -> list:
        m = model(path)
        all_ids, ends, same = array("i"), [0], []
        for x in arr:
            t = x.as_py()
            ids = m.encode(t)
            all_ids.extend(ids)
            ends.append(len(all_ids))
            if decode:
                same.append(m.decode(ids) == t)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(all_ids, np.int32) if len(all_ids) else [], pa.int32()))
        return [lists, same] if decode else [lists]

    return map_text(df, cols, text, T.StructType([IDS, ROUND_TRIP] if decode else [IDS]), run)


def decode_ids(df: DataFrame, path: str, cols: list[str], ids: str = "ids") -> DataFrame:
    """``cols`` of every row with decoded, the text of its ids (null: empty text)."""
    bound_batches(df.sparkSession)
    src = df.select(*[F.col(f"`{c}`") for c in cols], F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>")).alias("__ids"))
    schema = T.StructType([src.schema[c] for c in cols] + [T.StructField("decoded", T.StringType())])

    def run(batches):
        m = model(path)
        for b in batches:
            texts = [m.decode(x.values.to_numpy(zero_copy_only=False).tolist() if x.values is not None else []) for x in b.column(len(cols))]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(cols))], pa.array(texts, pa.string())], names=[*cols, "decoded"])

    return src.mapInArrow(run, schema)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded and decoded again: ids of every document, and whether they give its text back."""
    import public_tokenizers

    out = encode_texts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"], decode=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")
