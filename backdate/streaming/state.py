"""Belief windows of a stream of observations, with each key's observations as state.

A key's state is the last observation of each of its days, one RocksDB entry a day, so
a micro-batch costs what its own keys hold and nothing stored is rewritten. What goes
out are changes of windows. They do not depend on how the stream was cut into batches
or on the order of its observations: a late one changes the windows as if it had been
there in time, and summed up the changes are what :func:`versions.build_versions` makes
of the whole log.

State grows with the log, reduced to a row a key and day. Set
``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider.
"""

from __future__ import annotations

import datetime as dt
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from backdate.operators.deltas import ADDED, WITHDRAWN
from backdate.schemas import OPEN_END

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LAST_DAY = dt.date.fromisoformat(str(OPEN_END))


def _rank(values: Sequence[Any]) -> list[tuple]:
    """For comparing rows column by column, NULL first and NaN last."""
    return [(v is not None, v != v, None if v is None or v != v else v) for v in values]


def _same(a: Any, b: Any) -> bool:
    return a == b or (a != a and b != b)


class _Windows(StatefulProcessor):
    """Changes of one key's windows; a state value is the day's values and its default start."""

    def __init__(self, values: T.StructType, ranked: Sequence[str], compared: Sequence[str], carried: Sequence[str], out: Row, n_keys: int):
        self.values, self.out, self.n_keys = values, out, n_keys
        names = values.fieldNames()
        self.ranked, self.compared, self.carried = ([names.index(c) for c in some] for some in (ranked, compared, carried))

    def init(self, handle: StatefulProcessorHandle) -> None:
        day = T.StructType([T.StructField("day", T.DateType())])
        self.days = handle.getMapState("days", day, self.values)

    def close(self) -> None:
        pass

    def _windows(self, days: dict[dt.date, tuple]) -> Counter[tuple]:
        kept: list[tuple[dt.date | None, tuple]] = []
        for day in sorted(days):
            row = days[day]
            # The first observation counts from its default start, a later one from its day but not before that.
            if not kept:
                kept.append((row[-1], row))
            elif any(not _same(row[c], before[c]) for c in self.compared):
                first = kept[0][0]
                kept.append((day if first is None else max(day, first), row))
            before = row
        if not kept:
            return Counter()
        ends = [start for start, _ in kept[1:]] + [_LAST_DAY]
        return Counter((*[row[c] for c in self.carried], start, end) for (start, row), end in zip(kept, ends, strict=True))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        days = {k[0]: tuple(v) for k, v in self.days.iterator()}
        before = self._windows(days)
        for r in rows:
            day, values = r[self.n_keys], tuple(r[self.n_keys + 1 :])
            old = days.get(day)
            if old is None or _rank([values[c] for c in self.ranked]) >= _rank([old[c] for c in self.ranked]):
                days[day] = values
                self.days.updateValue((day,), values)
        after = self._windows(days)
        for change, some in ((WITHDRAWN, before - after), (ADDED, after - before)):
            for window in some.elements():
                yield self.out(*key, *window, change)


def version_changes(
    stream: DataFrame,
    keys: Sequence[str],
    compare_cols: Sequence[str],
    order_cols: Sequence[str] = (),
    default_known_from: Column | None = None,
    observed_on: str = "observed_on",
) -> DataFrame:
    """Keys, carried columns, known_from, known_until and ``change`` of one copy of a window each.

    Arguments and results are those of :func:`versions.build_versions`; keys and
    ``observed_on`` are not NULL.
    """
    values = [c for c in stream.columns if c not in {*keys, observed_on}]
    ranked = [c for c in order_cols if c in values]
    ranked += [c for c in values if c not in ranked]
    carried = [c for c in values if c not in order_cols or c in compare_cols]
    start = F.col(observed_on) if default_known_from is None else default_known_from
    rows = stream.select(*keys, observed_on, *values, start.cast("date").alias("_start"))
    types = {f.name: f.dataType for f in rows.schema}
    state = T.StructType([T.StructField(c, types[c]) for c in (*values, "_start")])
    out = T.StructType(
        [T.StructField(c, types[c]) for c in (*keys, *carried)]
        + [T.StructField(c, T.DateType()) for c in ("known_from", "known_until")] + [T.StructField("change", T.StringType())]
    )
    processor = _Windows(state, ranked, compare_cols, carried, Row(*out.fieldNames()), len(keys))
    return rows.groupBy(*keys).transformWithState(processor, out, "Append", "None")


def net_versions(changes: DataFrame) -> DataFrame:
    """The windows after all changes, in whatever order they are read."""
    columns = [c for c in changes.columns if c != "change"]
    copies = F.sum(F.when(F.col("change") == ADDED, 1).otherwise(-1))
    left = changes.groupBy(*columns).agg(copies.cast("int").alias("_copies")).where("_copies > 0")
    return left.withColumn("_copies", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*columns)
