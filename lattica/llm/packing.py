"""Sequence packing by power-of-two decomposition.

Each document's identifiers, closed by an end identifier, are cut into full sequences and
then into pieces whose lengths are the set bits of what is left.  Pieces of equal length
share a bucket and each is a sequence by itself: no sequence crosses documents, and since
every length is a power of two no sequence needs padding.

Defined cases: a null or empty text has the end identifier only; repeated rows are packed
each; documents of any length are packed whole.  Sequence numbers are unique in one result;
they follow the input's partitions and order, so a recomputed task gives the same numbers.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm.common import fresh, in_portions, vocabulary, worker_kept

DEFAULT_VOCABULARY = "word_bpe_49k.json"
#: Distinct words whose identifiers a worker keeps (about 200 MB) and those that the library
#: encodes at once.
CACHED_WORDS, ENCODED_AT_ONCE = 1_000_000, 4_000
#: Bytes of identifiers after which a worker hands on what it has encoded.
HANDED_ON = 4_000_000


class WordEncoder:
    """Identifiers of whole texts by the ``tokenizers`` library, each distinct word encoded once.

    Only for vocabularies that drop white space before they merge (checked when the file is
    read): there the words between ASCII white space are encoded independently.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self._encode(["a b\n\tc", " a"]) != [sum(self._encode(["a", "b", "c"]), []), *self._encode(["a"])]:
            raise ValueError("the vocabulary doesn't drop white space")
        self.known: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[list[int]]:
        batch = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        return [e.ids for e in batch(texts, add_special_tokens=False)]

    def encode_packed(self, texts: Iterable[str | None], end_id: int) -> Iterator[bytes]:
        """Identifiers of each text and the end identifier, as little-endian unsigned 32-bit integers."""
        tail = np.array([end_id], "<u4").tobytes()
        for portion in in_portions((t or "" for t in texts), 500_000):
            cut = [t.encode().split() for t in portion]  # bytes split at ASCII white space only
            distinct = set().union(*cut)
            missing = [w for w in distinct if w not in self.known]
            if len(self.known) + len(missing) > CACHED_WORDS:
                self.known, missing = {}, list(distinct)
            for at in range(0, len(missing), ENCODED_AT_ONCE):
                some = missing[at : at + ENCODED_AT_ONCE]
                ids = self._encode([w.decode() for w in some])
                packed = np.fromiter((i for x in ids for i in x), "<u4").tobytes()
                ends = (4 * np.cumsum([len(x) for x in ids])).tolist()
                self.known.update(zip(some, (packed[a:b] for a, b in zip([0, *ends], ends))))
            for words in cut:
                yield b"".join(map(self.known.__getitem__, words)) + tail


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a vocabulary."""
    return worker_kept(WordEncoder, path)


def batched(pieces: DataFrame, tokens: int = 2048) -> DataFrame:
    """``pieces`` dealt into batches of equal-length sequences: (bucket, batch, row) beside their columns.

    A batch of a bucket holds tokens / length sequences (one at least; the last of a partition may
    hold fewer), so every batch is a rectangle without padding.  Pieces meet by bucket and
    partition, never a whole bucket in one task.
    """
    part, n = fresh(pieces, "_part"), fresh(pieces, "_n")
    by = Window.partitionBy("bucket", part).orderBy("doc_id", "start", "sequence_id")
    numbered = pieces.withColumn(part, F.spark_partition_id()).withColumn(n, F.row_number().over(by) - 1)
    height = F.greatest(F.lit(1), F.floor(F.lit(tokens) / F.col("bucket")))
    batch = F.concat_ws("-", "bucket", part, F.floor(F.col(n) / height))
    return numbered.withColumns({"batch": batch, "row": F.pmod(n, height).cast("int")}).drop(part, n)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = DEFAULT_VOCABULARY, end_id: int = 1, most: int = 2048) -> DataFrame:
    """A row per piece: id, start, length, doc_tokens, ids (packed binary), bucket, sequence_id, offset.

    ``most`` is a power of two.  Encoding is Arrow-batched; cutting is SQL; nothing is shuffled.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the sequence length is a power of two")
    path = vocabulary(vocab)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            at, size, packed = 0, 0, []

            def handed_on() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(packed)), pa.array(packed, pa.binary())], names=["doc_id", "_ids"])

            for ids in e.encode_packed((t.as_py() for t in batch.column(1)), end_id):
                packed.append(ids)
                size += len(ids)
                if size > HANDED_ON:
                    yield handed_on()
                    at, size, packed = at + len(packed), 0, []
            if packed:
                yield handed_on()

    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    encoded = rows.mapInArrow(encode, f"doc_id {id_type}, _ids binary")
    counted = encoded.withColumn("doc_tokens", F.expr("cast(octet_length(_ids) div 4 as long)"))
    halves = ", ".join(f"{1 << k}L" for k in reversed(range(most.bit_length() - 1)))
    rest = f"transform(filter(array({halves}), p -> doc_tokens & p > 0), p -> struct(doc_tokens - doc_tokens % (2 * p) as start, p as length))" if halves else "array()"
    full = f"transform(sequence(1L, doc_tokens div {most}), i -> struct((i - 1) * {most} as start, {most}L as length))"
    whole = f"case when doc_tokens >= {most} then concat({full}, {rest}) else {rest} end" if halves else full
    pieces = counted.select("doc_id", "doc_tokens", "_ids", F.explode(F.expr(whole)).alias("_piece"))
    return pieces.select(
        "doc_id",
        F.col("_piece.start").alias("start"),
        F.col("_piece.length").alias("length"),
        "doc_tokens",
        F.expr("substring(_ids, cast(4 * _piece.start + 1 as int), cast(4 * _piece.length as int))").alias("ids"),
        F.col("_piece.length").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
