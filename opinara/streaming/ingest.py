"""Forward-only intake of landed episodes with a durable ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from opinara.operators.coverage import unseen
from opinara.operators.store import OpinionStore
from opinara.sources.sinks import first_wins


def ingest_stream(episodes: DataFrame, store: OpinionStore, judge: Callable[[DataFrame], DataFrame],
                  checkpoint: str, delay: str = "30 days"):
    """Start a run over everything that has landed, then stop.

    ``judge`` turns unseen episodes into ledger rows with a ``status``; rows without one are
    deferred: they stay out of the ledger.  The file source remembers files, not episodes, so a
    deferred episode comes back when its feed lands again, as feeds do at every poll.

    The ledger write is keyed by guid, so a micro-batch that is replayed after a failure
    changes nothing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        # of several landings of an episode in one batch the first is judged
        fresh = unseen(first_wins(batch, "guid", "landed_at"), store.ledger())
        judged = judge(fresh)
        store.mark_episodes(judged.filter("status is not null"))

    return (episodes.withWatermark("landed_at", delay).dropDuplicatesWithinWatermark(["guid", "landed_at"])
            .writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
