"""Live ingest: command streams into a store or a continuously resolved image."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import resolve
from ..plans.store import Store


def into_store(log: DataFrame, store: Store, checkpoint: str, compact: bool = True) -> StreamingQuery:
    """Each micro-batch becomes a run of level 0; compaction follows where it is due. A batch that
    is repeated after a failure has the same sequence numbers, so resolving it twice changes
    nothing."""

    def write(batch: DataFrame, _: int) -> None:
        store.append(batch.select("seq", "op", "key", "value", "key_end"))
        store.flush()
        if compact:
            store.compact_if_needed()

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_image(log: DataFrame) -> DataFrame:
    """The resolved image as a streaming aggregation (complete or update mode)."""
    return resolve.merge(resolve.entries(log))


def live_map(log: DataFrame) -> DataFrame:
    """One row for every change of a key's live value, with custom state: the newest (seq, value,
    dead) of each key is kept, late mutations are dropped."""

    def step(key, frames, state):
        seq, value, dead = state.get if state.exists else (-1, 0, True)
        out = []
        for pdf in frames:
            for r in pdf.sort_values("seq").itertuples(index=False):
                if r.seq > seq:
                    seq, dead = int(r.seq), bool(r.dead)
                    value = 0 if dead else int(r.value)
                    out.append((key[0], None if dead else value, seq))
        state.update((seq, value, dead))
        yield pd.DataFrame(out, columns=["key", "value", "seq"]).astype({"value": "Int64"})

    muts = resolve.entries(log)
    return muts.groupBy("key").applyInPandasWithState(step, "key long, value long, seq long", "seq long, value long, dead boolean", "update", "NoTimeout")


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is available and returns its result table."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
