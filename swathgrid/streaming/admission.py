"""Strip admission with state per strip: a verdict needs the first, middle and last line, which arrive when they like."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

VERDICT = "strip_id string, n_samples bigint, n_valid bigint, status string, is_daytime boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_session(spark: SparkSession) -> SparkSession:
    """A session for keyed state: kept on local disk, and in as many stores as the cluster has cores."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    session.conf.set("spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism)
    return session


class StripJudge(StatefulProcessor):
    """Collects the sampled lines of a strip; judges it once they are there, or when its time is up.

    State of a strip is a row for each sampled line, three at most, and goes with the verdict. The mark that a strip is judged stays
    ``keep_ms`` longer, so that repeated and late lines give no second verdict.
    """

    def __init__(self, wait_ms: int, keep_ms: int):
        self.wait_ms, self.keep_ms = wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getMapState("lines", "line int", "n_samples bigint, n_valid bigint")
        self.judged = handle.getValueState("judged", "forget_at bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.judged.exists():
            return
        newest, wanted = 0, set()
        for r in rows:
            wanted = {0, r.lines // 2, r.lines - 1}
            newest = max(newest, r.ts_ms)
            if r.line in wanted and not self.lines.containsKey((r.line,)):
                self.lines.updateValue((r.line,), (r.n_samples, r.n_valid))
        held = {k[0] for k in self.lines.keys()}
        if wanted and wanted <= held:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            yield self._verdict(key, max(newest, timerValues.getCurrentWatermarkInMs()))
        elif not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(newest + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.judged.exists():
            self.judged.clear()
        else:
            yield self._verdict(key, expiredTimerInfo.getExpiryTimeInMs(), complete=False)

    def _verdict(self, key, now_ms: int, complete: bool = True) -> Row:
        counts = list(self.lines.values())
        n, valid = sum(c[0] for c in counts), sum(c[1] for c in counts)
        self.lines.clear()
        self.judged.update((now_ms + self.keep_ms,))
        self.handle.registerTimer(now_ms + self.keep_ms)
        # A strip that cannot be judged is admitted, to be on the safe side.
        status = "day" if valid else "night" if n and complete else "error"
        return Row(strip_id=key[0], n_samples=n, n_valid=valid, status=status, is_daytime=status != "night")

    def close(self) -> None:
        pass


def judge_strips(lines: DataFrame, delay: str, wait_ms: int, keep_ms: int) -> DataFrame:
    """A verdict for each strip, as :func:`swathgrid.operators.mosaic.daylight` gives it.

    ``lines`` (streaming): strip_id, line, lines (of the strip), n_samples, n_valid, ts. A line that is delivered again counts once.
    ``delay`` is how late lines may be. A strip whose lines are not all there ``wait_ms`` of event time after the first ones gets the status
    "error", unless a usable sample has been seen, and is admitted. The session must be a :func:`keyed_session`.
    """
    timed = lines.withWatermark("ts", delay).withColumn("ts_ms", F.unix_millis("ts"))
    judge = StripJudge(wait_ms, keep_ms)
    return timed.groupBy("strip_id").transformWithState(judge, VERDICT, "append", "eventTime")


def start_judging(verdicts: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Store verdicts; those that are not "night" are the admitted strips."""
    return (
        verdicts.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
