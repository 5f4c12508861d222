"""A stream of file states kept as a table: each micro-batch replaces what it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillgraph.operators.incremental import Store
from quillgraph.operators.resolve import last_of_each


def upsert_stream(stream: DataFrame, store: Store, name: str, key: list[str], order: list[str], checkpoint: str, by: tuple[str, ...] = ("workspace_id", "repo")) -> StreamingQuery:
    """Upserts each batch into the stored table, the last row of a key by order.

    The result is the same if a batch is given again after a failure, as rows are keyed. A stored row
    that is newer by order than the batch's stays.
    """

    def write(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        fresh = last_of_each(batch, key, order)
        if not store.exists(name):  # before the first batch; what can't be read is an error
            store.refresh(name, fresh, by)
            return
        stored = store.read(name)
        parts = fresh.select(*by).distinct()
        within = stored.join(parts, list(by), "left_semi")
        both = last_of_each(within.select(*fresh.columns).unionByName(fresh), key, order)
        store.merge(name, both, both.select(*by, *[k for k in key if k not in by]).distinct(), key, by)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
