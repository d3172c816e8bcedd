"""Queries that arrive in a stream, matched with a panel that stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.matches import long_matches, named_panel
from ..sources.panel import Panel


def match_arrivals(arriving: DataFrame, panel: Panel, length: int, sink: str, checkpoint: str, once: bool = True, kept: str | None = None) -> StreamingQuery:
    """Long matches of each micro-batch of query positions (query_id, pos, node), appended to Parquet at sink. A query
    arrives whole in one batch; a batch that is done again replaces its own rows, so none is written twice. The panel's
    grams are named once and kept in the folder `kept`, beside the checkpoint if it isn't given; a batch only reads them."""
    named = panel.load_or_build(f"grams-{length}", kept or f"{checkpoint.rstrip('/')}-kept", lambda p: named_panel(p, length))

    def match(batch: DataFrame, number: int) -> None:
        long_matches(batch, panel, length, named=named).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = arriving.writeStream.foreachBatch(match).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
