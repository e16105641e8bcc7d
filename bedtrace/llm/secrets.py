"""Secret scans with multipart credential linking.

Strong findings (``assign``, ``access``, ``hex``) stand on their own. Weak parts (names of users, random-looking keys,
addresses of services) are common in harmless text and are reported only where complementary parts meet in one scope,
at any distance. A scope is an interval of the text: the innermost pair of braces around a part, or, outside of braces,
a block of lines without an empty line. Blocks of settings with one empty line between them are one scope; a heading in
square brackets starts a new one. The interval join asks for a complement whose place lies in the scope of the part, or
whose own scope holds the part, so parts in the inner and in the outer braces of one object are linked, and parts of two
neighbouring objects are not.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from bedtrace.llm.common import bound_batches, documents, map_text

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "user", "key", "endpoint")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
USER = re.compile(r"""(?:user(?:name)?|login|client_id|account(?:_?name)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", re.I | re.A)
# Also right behind an equals sign (NAME=key, ?sig=key), and with characters in the %XX form of URLs.
KEY = re.compile(r"(?<![A-Za-z0-9+/_-])(?<!%(?=[0-9A-Fa-f]{2}))(?:[A-Za-z0-9+/_-]|%(?!3[Dd])[0-9A-Fa-f]{2}){32,}+(?:=|%3[Dd]){0,2}+(?![A-Za-z0-9+/=_-]|%[0-9A-Fa-f]{2})")
ENDPOINT = re.compile(r"""(?:[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20"'<>]+|(?:[A-Za-z0-9-]+\.)+(?:amazonaws\.com|internal|local|svc|cloud)(?::[0-9]{2,5})?)""", re.A)
BRACE = re.compile(r"[{}]")
HEADING = re.compile(r"[\x20\t]*\[[^\[\]\n]+\][\x20\t\r]*$")
SETTING = re.compile(r"""[\x20\t]*(?:export\x20+|-\x20+)?["']?[A-Za-z_][A-Za-z0-9_.-]*["']?[\x20\t]*(?:=|:(?!//))""")
# What a text with any finding must hold, for the fast scan of whole batches.
SIGNS = r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=]|AKIA[A-Z0-9]|[0-9a-f]{24}|(?:[A-Za-z0-9+/_-]|%[0-9A-Fa-f]{2}){32}"""


def strong(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return found


def _random_looking(s: str) -> bool:
    s = unquote(s)
    return bool(re.search("[a-z]", s)) and bool(re.search("[A-Z]", s)) and bool(re.search("[0-9]", s))


def _braces(text: str) -> list[tuple[int, int]]:
    """Matched pairs of braces by their start; each is (start, end exclusive)."""
    open_at, pairs = [], []
    for m in BRACE.finditer(text):
        if m[0] == "{":
            open_at.append(m.start())
        elif open_at:
            pairs.append((open_at.pop(), m.end()))
    return sorted(pairs)


def _blocks(text: str, pairs: list[tuple[int, int]]) -> list[int]:
    """Where the scopes outside of braces start, in order. Empty lines inside braces separate nothing."""
    blocks: list[list] = []  # start, empty lines before (or -1 after a heading line), lines, lines that set something
    at, k, inside, gap = 0, 0, 0, 0
    for line in text.split("\n"):
        while k < len(pairs) and pairs[k][0] < at:
            inside = max(inside, pairs[k][1])
            k += 1
        if at < inside:
            gap = 0
        elif not line.strip(" \t\r"):
            gap += 1
        else:
            heading = bool(HEADING.match(line))
            if heading or gap or not blocks:
                blocks.append([at, -1 if heading else gap, 0, 0])
            blocks[-1][2] += 1
            blocks[-1][3] += heading or bool(SETTING.match(line))
            gap = 0
        at += len(line) + 1
    settings = [2 * b[3] >= b[2] for b in blocks]
    return [b[0] for i, b in enumerate(blocks) if not (i and b[1] == 1 and settings[i] and settings[i - 1])]


def scopes(text: str, places: list[int]) -> list[tuple[int, int]]:
    """The scope of each place of the text, places in rising order."""
    pairs = _braces(text)
    starts = np.array(_blocks(text, pairs), np.int64)
    ends = np.append(starts[1:], len(text) + 1)
    out, stack, k = [], [], 0
    for p in places:
        while k < len(pairs) and pairs[k][0] <= p:
            while stack and stack[-1][1] <= pairs[k][0]:
                stack.pop()
            stack.append(pairs[k])
            k += 1
        while stack and stack[-1][1] <= p:
            stack.pop()
        b = int(np.searchsorted(starts, p, "right")) - 1
        out.append(stack[-1] if stack else (int(starts[b]), int(ends[b])) if b >= 0 else (0, len(text) + 1))
    return out


def meet(a: list, b: list, scope: dict[int, tuple[int, int]]) -> np.ndarray:
    """Interval join: which of ``a`` have one of ``b`` in their scope, or lie in the scope of one of ``b``.

    Two searches per row in sorted places and sorted ends of scopes, however many intervals meet.
    """
    if not a or not b:
        return np.zeros(len(a), bool)
    own = np.array([scope[s] for s, _, _ in a], np.int64)
    places = np.array([s for s, _, _ in a], np.int64)
    others = np.sort([s for s, _, _ in b])
    theirs = np.array([scope[s] for s, _, _ in b], np.int64)
    inside = np.searchsorted(others, own[:, 1]) > np.searchsorted(others, own[:, 0])
    around = np.searchsorted(np.sort(theirs[:, 0]), places, "right") > np.searchsorted(np.sort(theirs[:, 1]), places, "right")
    return inside | around


def find(text: str) -> list[tuple[int, int, str]]:
    """All findings of a text, by start, then kind: (start, end, kind) in code points, end exclusive."""
    base = strong(text)
    taken = sorted(base)
    starts = np.array([s for s, _, _ in taken], np.int64)
    ends = np.maximum.accumulate(np.array([e for _, e, _ in taken] or [0], np.int64))

    def free(m: re.Match) -> bool:
        k = int(np.searchsorted(starts, m.end(), "left"))
        return k == 0 or int(ends[k - 1]) <= m.start()

    keys = [(m.start(), m.end(), "key") for m in KEY.finditer(text) if _random_looking(m[0]) and free(m)]
    if base or keys:
        users = [(m.start(), m.end(), "user") for m in USER.finditer(text) if free(m)]
        places = [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text) if free(m)]
        ids = users + [x for x in base if x[2] == "access"]
        secrets = keys + [x for x in base if x[2] != "access"]
        at = sorted({s for s, _, _ in ids + secrets + places})
        scope = dict(zip(at, scopes(text, at)))
        keep = [x for x, ok in zip(keys, meet(keys, ids + places, scope)) if ok]
        keep += [x for x, ok in zip(users, meet(users, secrets, scope)) if ok]
        keep += [x for x, s, i in zip(places, meet(places, secrets, scope), meet(places, ids, scope)) if s and i]
        base = base + keep
    return sorted(base, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def suspects(arr: pa.Array) -> np.ndarray:
    """Rows of a batch that can hold a finding at all."""
    return pc.match_substring_regex(arr, SIGNS).to_numpy(zero_copy_only=False)


OUT = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in BASE] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def scan(df: DataFrame, cols: list[str], text: str = "text") -> DataFrame:
    """``cols`` of every row with n_assign, n_access, n_hex, base_sha256 and spans of its whole text.

    A batch is first searched by one regular expression on its Arrow buffer; only rows with a sign of a finding are
    looked at in Python. Null or empty text: no findings (the hash is that of no bytes). Rows are independent, so
    repeated rows, ties and empty tables need no rule; columns of ``cols`` named like an output give way to it.
    """
    nothing = hashlib.sha256(b"").hexdigest()

    def run(arr: pa.Array) -> list:
        n = len(arr)
        counts = {k: np.zeros(n, np.int64) for k in BASE}
        digest, spans = [nothing] * n, [""] * n
        for i in np.flatnonzero(suspects(arr)).tolist():
            found = find(arr[i].as_py())
            base = [x for x in found if x[2] in BASE]
            for x in base:
                counts[x[2]][i] += 1
            digest[i] = hashlib.sha256(joined(base).encode()).hexdigest()
            spans[i] = joined(found)
        return [*counts.values(), digest, spans]

    return map_text(df, cols, text, OUT, run)


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """``text`` with each finding (overlapping ones together) replaced by ``mark``."""
    out, at = [], 0
    for s, e, _ in sorted(find(text)):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df``, all its columns, with the findings in ``text`` replaced; null texts and texts without findings as they are.

    Repeated rows are redacted row by row; an empty table gives an empty one.
    """
    bound_batches(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arr = b.column(at)
            hit = suspects(pc.fill_null(arr, ""))
            if hit.any():
                new = [redacted(arr[i].as_py()) for i in np.flatnonzero(hit).tolist()]
                arr = pc.replace_with_mask(arr, pa.array(hit), pa.array(new, arr.type))
            yield pa.RecordBatch.from_arrays([arr if i == at else b.column(i) for i in range(b.num_columns)], names=b.schema.names)

    return df.mapInArrow(run, df.schema)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir), ["doc_id"])
