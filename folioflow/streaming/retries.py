"""Calls of a service over a stream of papers, tried again after waits that no task sits out.

How often a paper has failed is state, and a wait is a timer: the task ends, and when the time has come a later batch
tries again. A query that starts anew from its checkpoint goes on with the counts and the waits that it had.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RESULT = "paper_id string, ok boolean, value string, attempts int, error_type string, error string"
#: The state store that keeps timers.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Attempts(StatefulProcessor):
    """A paper's text while it waits, and how often it has failed."""

    def __init__(self, call: Callable[[list[str]], list[str]], most: int, wait_s: float, permanent: tuple[type[BaseException], ...]):
        self.call, self.most, self.wait_s, self.permanent = call, most, wait_s, permanent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "text string, failed int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
        """A paper that comes while it waits is the same paper, with its newest text: it keeps its count and its wait."""
        text = None
        for r in rows:
            text = r["text"]
        if self.waiting.exists():
            self.waiting.update((text, self.waiting.get()[1]))
            return
        yield from self._tried(key, text, 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
        if self.waiting.exists():
            text, failed = self.waiting.get()
            yield from self._tried(key, text, failed)

    def _tried(self, key, text: str | None, failed: int) -> Iterator[Row]:
        try:
            value = self.call([text or ""])[0]
        except self.permanent as e:
            self.waiting.clear()
            yield Row(paper_id=key[0], ok=False, value=None, attempts=failed + 1, error_type="PermanentError", error=str(e))
        except Exception as e:  # noqa: BLE001  what a service may raise isn't known
            failed += 1
            if failed >= self.most:
                self.waiting.clear()
                yield Row(paper_id=key[0], ok=False, value=None, attempts=failed, error_type="TransientError", error=str(e))
            else:
                self.waiting.update((text, failed))
                self.handle.registerTimer(int((time.time() + self.wait_s * 2 ** (failed - 1)) * 1000))
        else:
            self.waiting.clear()
            yield Row(paper_id=key[0], ok=True, value=value, attempts=failed + 1, error_type=None, error=None)

    def close(self) -> None:
        return None


def called(papers: DataFrame, call: Callable[[list[str]], list[str]], attempts: int = 3, wait_s: float = 1.0, permanent: tuple[type[BaseException], ...] = (ValueError,)) -> DataFrame:
    """Results of RESULT of a stream of papers (paper_id, text): a row when `call` has answered, or as a dead letter when it has failed `attempts` times or for good.

    Waits double from `wait_s`. Rows without an id belong to no paper and are left out; a null text is empty.
    """
    spark = papers.sparkSession
    spark.conf.set(PROVIDER, ROCKSDB)
    rows = papers.filter("paper_id IS NOT NULL").select("paper_id", F.col("text").cast("string").alias("text"))
    return rows.groupBy("paper_id").transformWithState(Attempts(call, attempts, wait_s, permanent), RESULT, "append", "processingTime")


def dead_letters(results: DataFrame) -> DataFrame:
    """What `Store.reject` takes: paper_id, error_type, error of the results that failed."""
    return results.filter("not ok").select("paper_id", "error_type", "error")
