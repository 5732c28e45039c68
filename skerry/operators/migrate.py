"""Moving a collection's rows to another node in batches, with retries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row

#: Rows of a batch, retries of a batch, and seconds of the first wait.
BATCH, RETRIES, WAIT = 1000, 3, 0.1


def with_retries(send: Callable[[list[Row]], None], batch: list[Row], retries: int = RETRIES, wait: float = WAIT) -> int:
    """Send a batch, again after growing waits if it fails; how many failures there were."""
    for failed in range(retries + 1):
        try:
            send(batch)
            return failed
        except Exception:
            if failed == retries:
                raise
            time.sleep(wait * (failed + 1))
    return retries


def migrate(rows: DataFrame, send: Callable[[list[Row]], None], batch: int = BATCH, retries: int = RETRIES) -> int:
    """Send all rows, ``batch`` at a time, from the executors; how many rows went.

    ``send`` may see a batch again after a lost executor, so it has to put rows, not
    add them.  A batch that keeps failing fails the migration.
    """
    sent = rows.sparkSession.sparkContext.accumulator(0)

    def part(own: Iterator[Row]) -> None:
        held: list[Row] = []
        for row in own:
            held.append(row)
            if len(held) == batch:
                with_retries(send, held, retries)
                sent.add(len(held))
                held = []
        if held:
            with_retries(send, held, retries)
            sent.add(len(held))

    rows.foreachPartition(part)
    return sent.value
