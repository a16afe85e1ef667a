"""Chains of curation rounds: published optimistically, fed by decisions in batch or from a stream.

A chain is a folder.  Each round is written whole below ``attempts/<id>`` (cells, panel, history,
markers, log, all as tables) and becomes part of the chain by one small file, ``rounds/<number>``,
that is created only if it isn't there: of two writers that start from the same base one wins, the
other's base is stale and its attempt is never read.  Rounds are never changed.  Going on from an
older round moves the later ones' files to ``superseded/<time>``.

Decisions name the round whose groups they mean; one made on another round is refused, as is any
batch that breaks a rule, with its reasons written beside the chain.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from lattica.operators import rounds as R
from lattica.operators import selection as C
from lattica.sources.readers import parse_decisions

CELLS = "obs long, grp int, label string"
PANEL = "feature string, class string"
HISTORY = "grp int, action string, merged_from array<int>, merged_into int, round int"
MARKERS = "class string, line_no long, round string, action string, features array<string>, rationale string, evidence array<string>"
LOG = (
    "line_no long, groups array<int>, action string, label string, features array<string>, into string, round string, rationale string, "
    "decided_by string, timestamp string, evidence array<string>, alternatives array<string>"
)
TABLES = {"cells": CELLS, "panel": PANEL, "history": HISTORY, "markers": MARKERS, "log": LOG}


class Stale(ValueError):
    """The base isn't the chain's latest round."""


class Refused(ValueError):
    """A batch broke rules: ``reasons`` are (line, reason)."""

    def __init__(self, reasons: list[tuple[int, str]]):
        super().__init__("; ".join(f"decision {line}: {reason}" for line, reason in reasons[:20]))
        self.reasons = reasons


@dataclass(frozen=True)
class Round:
    number: int
    attempt: str
    base: int | None
    stream: str | None = None
    batch: int | None = None

    @property
    def name(self) -> str:
        return f"r{self.number}"


def _at(spark: SparkSession, path: str):
    """The file system of ``path`` and the path in its terms."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, folder: str) -> list[str]:
    files, at = _at(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def numbers(spark: SparkSession, chain: str) -> list[int]:
    """The chain's rounds, oldest first."""
    return sorted(int(n) for n in _names(spark, f"{chain}/rounds") if n.isdigit())


def read_round(spark: SparkSession, chain: str, number: int) -> Round:
    told = spark.read.text(f"{chain}/rounds/{number:08d}", wholetext=True).first()
    return Round(**json.loads(told[0]))


def latest(spark: SparkSession, chain: str) -> Round | None:
    found = numbers(spark, chain)
    return read_round(spark, chain, found[-1]) if found else None


def load(spark: SparkSession, chain: str, of: Round) -> dict[str, DataFrame]:
    """The tables of a round."""
    return {name: spark.read.schema(schema).parquet(f"{chain}/attempts/{of.attempt}/{name}") for name, schema in TABLES.items()}


def publish(spark: SparkSession, chain: str, new: Round) -> Round:
    """Makes an attempt the chain's next round, if no other came first."""
    if new.number != (found := numbers(spark, chain) or [-1])[-1] + 1:
        raise Stale(f"round r{new.base} is not the latest of {chain}, r{found[-1]} is")
    files, at = _at(spark, f"{chain}/rounds/{new.number:08d}")
    try:
        out = files.create(at, False)
    except Exception as e:
        if files.exists(at):
            raise Stale(f"{new.name} of {chain} was published by another writer") from e
        raise
    out.write(bytearray(json.dumps(asdict(new)).encode()))
    out.close()
    return new


def start(spark: SparkSession, chain: str, cells: DataFrame, panel: DataFrame) -> Round:
    """The first round of a chain: ``cells`` (obs, grp, label) and ``panel`` (feature, class) as they are."""
    tables = {"cells": cells.select("obs", "grp", "label"), "panel": panel.select("feature", "class")}
    return publish(spark, chain, Round(0, _attempt(spark, chain, tables), None))


def _attempt(spark: SparkSession, chain: str, tables: dict[str, DataFrame]) -> str:
    name = uuid.uuid4().hex
    for table, schema in TABLES.items():
        rows = tables[table] if table in tables else spark.createDataFrame([], schema)
        rows.to(spark.createDataFrame([], schema).schema).write.parquet(f"{chain}/attempts/{name}/{table}")
    return name


def checked(decisions: DataFrame, tables: dict[str, DataFrame], base: Round, must_name: bool = False) -> list[tuple[int, str]]:
    """(line, reason) of decisions that can't be taken on ``base``; curated decisions are few."""
    found = R.refusals(decisions.withColumnRenamed("line_no", "line"), tables["cells"].select("grp").distinct())
    other = C.stale(decisions, base.name).select(F.col("line_no").alias("line"), "reason")
    every = found.select("line", "reason").unionByName(other)
    if must_name:
        every = every.unionByName(decisions.where("round is null").select(F.col("line_no").alias("line"), F.lit("names no round").alias("reason")))
    return sorted((r["line"], r["reason"]) for r in every.distinct().collect())


def relabel(spark: SparkSession, chain: str, decisions: DataFrame, base: int | None = None, must_name: bool = False, stream: str | None = None, batch: int | None = None) -> Round:
    """The next round: ``decisions`` (as of ``readers.parse_decisions``) applied to the latest.

    ``base`` states the round that the caller expects to be the latest.  ``Stale`` and ``Refused``
    leave the chain as it was.
    """
    now = latest(spark, chain)
    if now is None or (base is not None and base != now.number):
        raise Stale(f"round r{base} is not the latest of {chain}, {now.name if now else 'there is none'}")
    tables = load(spark, chain, now)
    reasons = checked(decisions, tables, now, must_name)
    if reasons:
        raise Refused(reasons)
    try:
        panel = C.edit_markers(tables["panel"], decisions)
    except ValueError as e:  # a pair to drop that isn't there
        line, _, reason = str(e).removeprefix("decision ").partition(": ")
        raise Refused([(int(line), reason)]) from e
    lined = decisions.withColumnRenamed("line_no", "line")
    stamp = F.coalesce("timestamp", F.lit(datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")))
    name = _attempt(spark, chain, {
        "cells": R.apply_decisions(lined, tables["cells"], tables["history"]),
        "panel": panel,
        "history": R.history_of(lined, tables["cells"], tables["history"], now.number + 1),
        "markers": C.marker_history(decisions, f"r{now.number + 1}").unionByName(tables["markers"]),
        "log": decisions.withColumn("timestamp", stamp),
    })
    return publish(spark, chain, Round(now.number + 1, name, now.number, stream, batch))


def supersede(spark: SparkSession, chain: str, number: int) -> int:
    """Takes the rounds after ``number`` out of the chain, latest first; how many."""
    later = [n for n in numbers(spark, chain) if n > number]
    folder = f"{chain}/superseded/{datetime.now(UTC).strftime('%Y%m%dT%H%M%S%f')}"
    for n in reversed(later):
        files, at = _at(spark, f"{chain}/rounds/{n:08d}")
        _, to = _at(spark, folder)
        files.mkdirs(to)
        files.rename(at, _at(spark, f"{folder}/{n:08d}")[1])
    return len(later)


def decision_lines(texts: DataFrame) -> DataFrame:
    """(file, line_no, line) of whole decision files (file, value); lines of several files are numbered on, by file."""
    split = texts.select("file", F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).where(F.ltrim("line").startswith("{"))
    return split.select("file", F.row_number().over(Window.orderBy("file", "n")).cast("long").alias("line_no"), "line")  # a batch of curated decisions


def watch(spark: SparkSession, source: str, chain: str, checkpoint: str, stream: str = "watch", status: str | None = None) -> StreamingQuery:
    """Each new file of decisions below ``source`` is a round of ``chain``, in the order of the files' times.

    All of its decisions must name the latest round.  A batch that is refused, or can't be read, is
    written with its reasons to ``refused/<stream>/batch=<n>`` and passed over.  The checkpoint holds
    how far the source is read; a batch that comes again after a restart is known by the round it made.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        done = [r for n in numbers(spark, chain) if (r := read_round(spark, chain, n)).stream == stream and r.batch == batch_id]
        if done:
            return
        lines = decision_lines(batch).persist()
        try:
            for attempt in range(10):  # another writer may come first; then the decisions name an older round
                try:
                    relabel(spark, chain, parse_decisions(lines), must_name=True, stream=stream, batch=batch_id)
                    return
                except Stale:
                    if attempt == 9 or latest(spark, chain) is None:
                        raise
                except Refused as e:
                    reasons = e.reasons
                    break
                except PySparkException as e:
                    if "decided_by" not in str(e) and "not a group id" not in str(e) and "not JSON" not in str(e):
                        raise
                    reasons = [(0, str(e).splitlines()[0][:500])]
                    break
            rows = spark.createDataFrame(reasons, "line long, reason string")
            rows.coalesce(1).write.mode("overwrite").json(f"{chain}/refused/{stream}/batch={batch_id}")
        finally:
            lines.unpersist()

    files = spark.readStream.option("maxFilesPerTrigger", 1).option("wholetext", True).text(source)
    named = files.select(F.col("_metadata.file_path").alias("file"), "value")
    return named.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refused(spark: SparkSession, chain: str, stream: str = "watch") -> DataFrame:
    """(batch, line, reason) of the batches that were passed over."""
    folder = f"{chain}/refused/{stream}"
    schema = "line long, reason string, batch int"
    if not _names(spark, folder):
        return spark.createDataFrame([], "batch int, line long, reason string")
    return spark.read.schema(schema).json(folder).select("batch", "line", "reason")
