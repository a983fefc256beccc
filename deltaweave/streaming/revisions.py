"""Extension: keyed revisions that arrive as a stream.

Records (key, revision time, values) are compared with those of the same key and
the revision before it in time, whatever the order they come in. A row waits in the
state of its key until the watermark has passed its time; then no earlier one can
come any more, and it is compared and leaves. Rows behind the watermark are dropped
by Spark. A batch touches the states of its own keys and of those whose rows have
waited long enough, so the work follows the batch, not the number of keys.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def changes_between(rows: DataFrame, key: str, time: str, compared: list[str]) -> DataFrame:
    """Each row beside its key's row before: kind (add for the first, modify, same) and the names of changed columns."""
    order = Window.partitionBy(key).orderBy(time)
    changed = [F.when(~F.col(c).eqNullSafe(F.lag(c).over(order)), F.lit(c)) for c in compared]
    first = F.row_number().over(order) == 1
    found = rows.withColumn("fields", F.when(first, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*changed))))
    return found.withColumn("kind", F.when(first, "add").when(F.size("fields") > 0, "modify").otherwise("same"))


def change_counts(stream: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of a streaming table of changes by window and kind."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), kind).agg(F.count(F.lit(1)).alias("n"))


def stream_changes(stream: DataFrame, key: str, time: str, compared: list[str], late: str = "10 minutes") -> DataFrame:
    """key, time, compared, kind, fields of every row of a stream, as ``changes_between`` finds them; equal times of a key go by their values.

    The state of a key is its last row and the rows that wait. Rows within ``late`` of
    the latest time stay there until later ones arrive.
    """
    columns = [key, time, *compared]
    kinds = dict(stream.dtypes)
    out = ", ".join([*[f"`{c}` {kinds[c]}" for c in columns], "kind string", "fields array<string>"])

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = pickle.loads(state.get[0]) if state.exists else (None, [])
        if not state.hasTimedOut:
            for pdf in batches:
                plain = pdf[columns].astype(object).where(pdf[columns].notna(), None)
                waiting += list(plain.itertuples(index=False, name=None))
        passed = state.getCurrentWatermarkMs()
        at = lambda row: int(pd.Timestamp(row[1]).tz_localize("UTC").value // 1_000_000)
        ready = sorted((r for r in waiting if at(r) <= passed), key=lambda r: (r[1], repr(r)))
        waiting = [r for r in waiting if at(r) > passed]
        found = []
        for row in ready:
            fields = [] if last is None else [c for c, old, new in zip(compared, last[2:], row[2:], strict=True) if old != new]
            found.append((*row, "add" if last is None else "modify" if fields else "same", fields))
            last = row
        state.update((pickle.dumps((last, waiting)),))
        if waiting:
            state.setTimeoutTimestamp(max(min(map(at, waiting)), passed + 1))
        if found:
            yield pd.DataFrame(found, columns=[*columns, "kind", "fields"])

    rows = stream.select(*columns).withWatermark(time, late)
    return rows.groupBy(key).applyInPandasWithState(run, out, "state binary", "append", GroupStateTimeout.EventTimeTimeout)


def compare_stream(stream: DataFrame, key: str, time: str, compared: list[str], out: str, checkpoint: str, late: str = "10 minutes") -> StreamingQuery:
    """Write the changes of what a stream holds now as Parquet below ``out``, each once; the states are below the checkpoint."""
    found = stream_changes(stream, key, time, compared, late)
    return found.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
