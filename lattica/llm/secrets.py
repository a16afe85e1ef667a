"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

A vocabulary learned from ordinary text spells ordinary strings in few tokens.  A run of key-like
characters with few characters for each token is random.  Runs of 16 characters or more are tested
where letters and digits mix, others from 20 characters on.  Known digests and identifiers are left
out first: UUIDs, plain numbers, and hexadecimal runs of a digest's length, but for those that the
text assigns to a name (``token = "..."``) which isn't a digest's own (``sha256: ...``).  Words pass
the test by themselves.  A run joined by ``/`` or ``=`` is tested whole, and where it isn't random
each of its long enough parts is.

Spans are ``kind:start:end`` in code points, end exclusive, ordered by start and then by kind
as listed, joined by commas.  The kinds are assign, access, hex and dense (the method's).

Defined cases: a null or empty text has no span; texts of any length are scanned whole; spans
of different kinds may overlap; repeated rows are scanned each; other columns are kept and
outputs replace columns of the same name.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import vocabulary, worker_kept

DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
KINDS = ("assign", "access", "hex", "dense")

# The base patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # 18 characters or more
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE = 12

#: Runs the efficiency test looks at, and the ratio under which they count as random.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
PART = re.compile(r"[A-Za-z0-9+_-]{16,}")
LEAST_UNMIXED = 20
LEAST_CHARACTERS_A_TOKEN = 2.0
#: The ratio for assigned hexadecimal runs of a digest's length, which no word is.
HEXADECIMAL_RATIO = 2.5
#: Characters before a run in which an assignment to it begins.
CONTEXT = 64
DIGEST_LENGTHS = frozenset((32, 40, 48, 56, 64, 96, 128))
_HEXADECIMAL = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_ASSIGNED = re.compile(r"""([A-Za-z_][\w.-]*)["']?\x20*[:=]\x20*["']?\Z""", re.ASCII)
# Names whose values are digests or identifiers.
_DIGEST_NAME = re.compile(r"md5|sha|blake|crc|digest|checksum|hash|commit|revision|etag|integrity|fingerprint|uuid|guid|(?:^|[_.-])(?:id|rev)$", re.IGNORECASE)
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\Z")


def encoding(path: str) -> tiktoken.Encoding:
    """The worker's encoding of a vocabulary."""
    return worker_kept(_read_encoding, path)


def _read_encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("secrets", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_assigned(text: str, start: int) -> bool:
    """Is what begins at ``start`` the value of a name that isn't a digest's or an identifier's?"""
    m = _ASSIGNED.search(text[max(0, start - CONTEXT) : start])
    return bool(m) and not _DIGEST_NAME.search(m[1])


def is_digest(run: str) -> bool:
    return len(run) in DIGEST_LENGTHS and bool(_HEXADECIMAL.match(run))


def is_known(run: str, assigned: bool = False) -> bool:
    """Identifiers, runs without letters, and digests that aren't an assigned value."""
    return bool(_UUID.match(run)) or not any(map(str.isalpha, run)) or (not assigned and is_digest(run))


def is_random(text: str, start: int, end: int, enc: tiktoken.Encoding, ratio: float) -> bool:
    run = text[start:end]
    if len(run) < LEAST_UNMIXED and not (any(map(str.isalpha, run)) and any(map(str.isdigit, run))):
        return False
    most = HEXADECIMAL_RATIO if is_digest(run) else ratio
    return len(run) < most * len(enc.encode_ordinary(run)) and not is_known(run, is_assigned(text, start))


def spans_of(text: str | None, enc: tiktoken.Encoding, ratio: float = LEAST_CHARACTERS_A_TOKEN) -> str:
    """All spans of one whole text."""
    if not text:
        return ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in CANDIDATE.finditer(text):
        if is_random(text, m.start(), m.end(), enc, ratio):
            found.append((m.start(), 3, m.end()))
        else:  # a key may hang on its path or name
            parts = ((m.start() + x.start(), m.start() + x.end()) for x in PART.finditer(m[0]) if x[0] != m[0])
            found += [(start, 3, end) for start, end in parts if is_random(text, start, end, enc, ratio)]
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(found))


def with_spans(df: DataFrame, text_col: str = "text", out_col: str = "spans", vocab: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` with the spans of ``text_col``; nothing is shuffled."""
    path = vocabulary(vocab)

    @F.pandas_udf("string")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for texts in batches:
            yield pd.Series([spans_of(t, enc) for t in texts], dtype=object)

    return df.withColumn(out_col, scan(F.col(text_col).cast("string")))


def of_kinds(spans: str, *kinds: str) -> Column:
    """The spans of some kinds as an array."""
    return F.filter(F.split(spans, ","), lambda s: F.element_at(F.split(s, ":"), 1).isin(*kinds))


def masked(text: str, spans: str, mask: str = "[secret]") -> str:
    """``text`` with its spans, joined where they overlap, replaced."""
    out, at = [], 0
    for start, end in (tuple(map(int, s.split(":")[1:])) for s in spans.split(",") if s):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def with_masks(df: DataFrame, text_col: str = "text", vocab: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` with secrets in ``text_col`` masked; null texts stay null."""
    path = vocabulary(vocab)

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for texts in batches:
            yield pd.Series([t and masked(t, spans_of(t, enc)) for t in texts], dtype=object)

    return df.withColumn(text_col, mask(F.col(text_col).cast("string")))
