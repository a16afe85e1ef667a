"""Chat formatting by a grammar round trip.

Grammar of the output::

    conversation = { turn }
    turn         = "### " role ":" newline text "</turn>" newline
    role, text   = { "\\\\" any character | any other character }

An unescaped "###" or "</turn>" inside a text, or an unescaped ":" or newline inside a role, is an
error.  Each turn is rendered as it is, parsed again and compared with its source; where it differs,
the conflicting content (text, role or both) is escaped and the turn rendered anew, until what comes
back is identical.  As turns parse alone from their first to their last character, whole
conversations do.  The loss mask covers the assistant's texts.

Turns are rendered where they lie, then each conversation is written out in order, in rows of whole
turns of about a million characters; reading back needs no shuffle for conversations of one row.  No
conversation is held as a whole: its digests are taken along the ordered rows (a SHA-256 is
sequential, so that part of one conversation is one task's work, in bounded memory).

Defined cases: null texts and roles are empty; null conv_ids form one conversation; null turns come
first; turns with equal numbers go by role, then by formatted text, and repeated rows are turns of
their own; texts of any length are one turn; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN = re.compile(r"### ((?:[^\\:\n]++|\\.)*+):\n((?:[^\\#<]++|\\.|#(?!##)|<(?!/turn>))*+)</turn>\n", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)
TEXT_CONFLICTS = re.compile(r"\\|#(?=##)|<(?=/turn>)")
ROLE_CONFLICTS = re.compile(r"[\\:\n]")

ASSISTANT = "assistant"
#: Characters of a row of the output; a longer turn is a row alone.
ROW_CHARS = 1_000_000

FORMATTED = "conv_id long, portion int, last boolean, formatted string, loss array<struct<start:int,end:int>>"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def parse(formatted: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start, end) of each turn, the span being the text's as formatted; None where the grammar is broken."""
    turns, at = [], 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if not found:
            return None
        turns.append((ESCAPED.sub(r"\1", found[1]), ESCAPED.sub(r"\1", found[2]), *found.span(2)))
        at = found.end()
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and the span of its text; what conflicts is escaped until the turn reads back as it was."""
    for escape_text, escape_role in ((False, False), (True, False), (False, True), (True, True)):
        r = ROLE_CONFLICTS.sub(r"\\\g<0>", role) if escape_role else role
        t = TEXT_CONFLICTS.sub(r"\\\g<0>", text) if escape_text else text
        formatted = f"### {r}:\n{t}</turn>\n"
        turns = parse(formatted)
        if turns and len(turns) == 1 and turns[0][:2] == (role, text):
            return formatted, *turns[0][2:]
    raise AssertionError("an escaped turn reads back as it was")


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pieces = [render(role or "", text or "") for role, text in zip(b["role"].to_pylist(), b["text"].to_pylist())]
        formatted, start, end = map(list, zip(*pieces)) if pieces else ([], [], [])
        columns = [b["conv_id"], b["turn"], b["role"], pa.array(formatted, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "role", "formatted", "start", "end"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole turns from ordered turns; the one that ends a conversation is its last."""
    nothing = object()
    now, portion, pieces, loss, size = nothing, 0, [], [], 0
    done: list[tuple] = []

    def close(last: bool) -> None:
        nonlocal portion, pieces, loss, size
        done.append((now, portion, last, "".join(pieces), loss))
        portion, pieces, loss, size = portion + 1, [], [], 0

    def out() -> pa.RecordBatch:
        conv, number, last, text, spans = map(list, zip(*done))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        columns = [pa.array(conv, pa.int64()), pa.array(number, pa.int32()), pa.array(last), pa.array(text, pa.string()), pa.array(spans, kind)]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "portion", "last", "formatted", "loss"])

    held = 0
    for b in batches:
        rows = zip(*(b[c].to_pylist() for c in ("conv_id", "role", "formatted", "start", "end")))
        for conv, role, formatted, start, end in rows:
            if now is nothing or conv != now:
                if now is not nothing:
                    close(True)
                now, portion = conv, 0
            elif size + len(formatted) > ROW_CHARS:
                close(False)
            if role == ASSISTANT:
                loss.append({"start": size + start, "end": size + end})
            pieces.append(formatted)
            size += len(formatted)
            held += len(formatted)
            if held > 4 * ROW_CHARS and done:
                held = size
                yield out()
    if now is not nothing:
        close(True)
        yield out()


def formatted(rows: DataFrame) -> DataFrame:
    """The formatted conversations of ``rows`` (conv_id, turn, role, text).

    ``portion`` numbers a conversation's rows from 0, ``last`` marks its last; ``loss`` lists the
    spans of ``formatted`` under the loss mask.
    """
    asked = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    turns = asked.mapInArrow(_rendered, "conv_id long, turn long, role string, formatted string, start int, end int")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    return ordered.mapInArrow(_joined, FORMATTED)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: list[tuple] = []
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    n = lossy = size = 0
    turns, loss = hashlib.sha256(), hashlib.sha256()
    for b in batches:
        for conv, last, text, spans in zip(*(b[c].to_pylist() for c in ("conv_id", "last", "formatted", "loss"))):
            parsed = parse(text)
            if parsed is None:
                raise ValueError(f"conversation {conv} doesn't follow the grammar")
            for role, body, _, _ in parsed:
                turns.update(f"{role}\n{body}\n".encode())
            for span in spans:
                masked = ESCAPED.sub(r"\1", text[span["start"] : span["end"]])
                lossy += len(masked)
                loss.update(masked.encode())
            n, size = n + len(parsed), size + len(text)
            if last:
                done.append((conv, n, turns.hexdigest(), lossy, loss.hexdigest(), size))
                n = lossy = size = 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
            done.clear()


def read_back(written: DataFrame) -> DataFrame:
    """Per conversation of :func:`formatted` what its text says when it is parsed again."""
    alone = (F.col("portion") == 0) & F.col("last")
    several = written.where(~alone).repartition("conv_id").sortWithinPartitions("conv_id", "portion")
    return written.where(alone).mapInArrow(_read, READ).unionByName(several.mapInArrow(_read, READ))
