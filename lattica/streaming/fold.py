"""A keyed fold over a stream: each group's latest label and the length of its history.

Entries (grp, round, line, action, label) of a group arrive in order of rounds; the state of a
group is its label, the action that it last saw and how many entries it has.  The state lives in
the stream's state store, one small row a group, and comes back after a restart.  A group's entries
are taken one after the other, so a group with many entries costs time, not memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

FOLDED = "grp int, round int, line long, label string, before string, entries long"
STATE = "label string, entries long"

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class GroupFold(StatefulProcessor):
    """A row for each entry: the label after it, the one before, and the entries so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("group", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        label, entries = self.state.get() if self.state.exists() else (None, 0)
        for pdf in [pd.concat(list(rows))]:  # a group's new entries of one micro-batch
            out = []
            for r in pdf.sort_values(["round", "line"]).itertuples(index=False):
                before, label = label, r.label if isinstance(r.label, str) else label
                entries += 1
                out.append((key[0], r.round, r.line, label, before, entries))
            yield pd.DataFrame(out, columns=["grp", "round", "line", "label", "before", "entries"])
        self.state.update((label, entries))

    def close(self) -> None:
        pass


def folded(entries: DataFrame) -> DataFrame:
    """The fold of (grp, round, line, action, label): of a stream with state, of a batch by a window.

    A stream must bring the rounds in order; entries without a label (keep, a merge's old groups)
    leave the label as it is.  Rows without a group are left out.  The session's state store must be
    RocksDB's (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = entries.where("grp is not null").select("grp", "round", "line", "label")
    if entries.isStreaming:
        return rows.groupBy("grp").transformWithStateInPandas(GroupFold(), FOLDED, "Update", "None")
    by = Window.partitionBy("grp").orderBy("round", "line")
    so_far, past = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda w: F.last("label", ignorenulls=True).over(w)
    return rows.select("grp", "round", "line", last(so_far).alias("label"), last(past).alias("before"), F.count(F.lit(1)).over(so_far).alias("entries"))


def current(folded_rows: DataFrame) -> DataFrame:
    """(grp, label, entries): each group as its last entry left it."""
    return folded_rows.groupBy("grp").agg(F.max_by("label", "entries").alias("label"), F.max("entries").alias("entries"))
