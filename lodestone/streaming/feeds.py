"""Streams: a bounded log, pushes by webhook, and polling.

State is bounded by design: the log keeps a fixed number of rows, pushes keep ids within a watermark.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.ids import delivery_valid
from ..operators.changes import matched_pushes, poll, pushes
from ..sources.store import Table

LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}
LOG = "ts timestamp, level string, logger string, message string, traceback string"
CAPACITY = 500


def kept_logs(logs: DataFrame, capacity: int = CAPACITY, least: str = "INFO") -> DataFrame:
    """The newest rows of a batch of logs, of a level from ``least`` up."""
    level = F.coalesce(*(F.when(F.col("level") == k, F.lit(v)) for k, v in LEVELS.items()), F.lit(0))
    return logs.where(level >= LEVELS[least]).orderBy(F.desc("ts"), F.desc("seq")).limit(capacity)


#: The level of a row that empties the log of all rows up to its time.
CLEAR = "CLEAR"


class LogBuffer(StatefulProcessor):
    """The newest ``capacity`` rows of a key, as list state; older ones leave it, and a row of level ``CLEAR`` empties it.

    Gives, in each micro-batch that brings a key rows, the rows that the key holds then.
    """

    STATE = "ts long, seq long, level string, logger string, message string, traceback string"
    FIELDS = [f.split()[0] for f in STATE.split(", ")]

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", self.STATE)
        self.cleared = handle.getValueState("cleared", "ts long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        cleared = self.cleared.get()[0] if self.cleared.exists() else None
        for pdf in rows:
            new = pdf[self.FIELDS].astype(object)
            held += new.where(new.notna(), None).itertuples(index=False, name=None)
        if clears := [r[0] for r in held if r[2] == CLEAR]:
            cleared = max([*clears, *([] if cleared is None else [cleared])])
            self.cleared.update((cleared,))
        held = [r for r in held if r[2] != CLEAR and (cleared is None or r[0] > cleared)]
        held = [(int(r[0]), None if r[1] is None else int(r[1]), *r[2:]) for r in held]
        held = sorted(held, key=lambda r: (r[0], -1 if r[1] is None else r[1]))[-self.capacity :]
        if held:
            self.rows.put(held)
        else:
            self.rows.clear()
        yield pd.DataFrame([(key[0], *r) for r in held] or [(key[0], None, None, None, None, None, None)], columns=["salt", *self.FIELDS])

    def close(self) -> None:
        pass


@contextmanager
def settings(spark, **given: str):
    """The session has the settings given, ``__`` for a dot, within the block; a stream keeps those that it starts with."""
    keys = {k.replace("__", "."): v for k, v in given.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def buffered(logs: DataFrame, capacity: int = CAPACITY, least: str = "INFO", salts: int = 8) -> DataFrame:
    """(salt, ts, seq, level, logger, message, traceback): a stream's newest rows from a level up, as state of bounded size.

    ``logs`` has the columns of ``LOG`` and may have seq, which settles the order of one time. Rows are dealt over ``salts``
    states of ``capacity`` rows each, so no task takes the whole stream; the newest of all, ``tail``, are among them. A row of
    level ``CLEAR`` reaches every state and empties it of what is not newer. A state that is empty gives a row of nulls.
    """
    level = F.coalesce(*(F.when(F.col("level") == k, F.lit(v)) for k, v in LEVELS.items()), F.lit(0))
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    seq = F.col("seq").cast("long") if "seq" in logs.columns else F.lit(None).cast("long")
    rows = logs.where((level >= LEVELS[least]) | (F.col("level") == CLEAR)).select(F.unix_micros("ts").alias("ts"), seq.alias("seq"), "level", "logger", "message", "traceback")
    own = F.array(F.pmod(F.xxhash64("ts", "seq", "logger", "message"), F.lit(salts)).cast("int"))
    dealt = rows.withColumn("salt", F.explode(F.when(F.col("level") == CLEAR, every).otherwise(own)))
    return dealt.groupBy("salt").transformWithStateInPandas(LogBuffer(capacity), f"salt int, {LogBuffer.STATE}", "Update", "None")


BUFFER = f"salt int, {LogBuffer.STATE}"


def keep_log(logs: DataFrame, table: Table, checkpoint: str, capacity: int = CAPACITY, least: str = "INFO", salts: int = 8) -> StreamingQuery:
    """Keeps a stream's buffer in ``table`` (columns ``BUFFER``): the rows of a key's state replace the key's rows.

    A micro-batch that is run again after a failure replaces them by the same rows. A restart from ``checkpoint`` goes on.
    """

    def store(df: DataFrame, _: int) -> None:
        now = df.persist()
        try:
            table.swap(now.select("salt"), now.where("ts IS NOT NULL"))
        finally:
            now.unpersist()

    # list state needs the state store of RocksDB; there are no more states than salts
    own = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    with settings(logs.sparkSession, spark__sql__streaming__stateStore__providerClass=own, spark__sql__shuffle__partitions=str(salts)):
        return buffered(logs, capacity, least, salts).writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tail(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The newest rows of all keys of a buffer's table, newest first."""
    return table.orderBy(F.desc("ts"), F.desc("seq")).limit(capacity).withColumn("ts", F.timestamp_micros("ts")).drop("salt")


def judged(events: DataFrame, repositories: DataFrame, secret: str | None = None) -> DataFrame:
    """(event_id, repo_id, repo_name, status) of webhook deliveries (event_id, payload[, headers]), in a batch or a stream.

    ``payload`` is the raw body. With a ``secret`` a delivery must be signed or carry the token in ``headers``, a map with
    lower-case names; the others are ``unauthorized``. The rest is that of ``matched_pushes``, a join with a static table.
    """
    headers = F.col("headers") if "headers" in events.columns else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    text = events.withColumn("authentic", delivery_valid(secret, F.col("payload"), headers)).withColumn("payload", F.col("payload").cast("string"))
    return matched_pushes(pushes(text), repositories)


def triggered(events: DataFrame, repositories: DataFrame, secret: str | None = None) -> DataFrame:
    """Those of a batch of webhook deliveries that start a sync."""
    return judged(events, repositories, secret).where("status = 'sync_triggered'")


def webhook_results(events: DataFrame, repositories: DataFrame, sink: str, checkpoint: str, secret: str | None = None, delay: str = "10 minutes", partitions: int | None = None) -> StreamingQuery:
    """Writes what ``judged`` says of a stream of deliveries (event_id, ts, payload[, headers]) as Parquet under ``sink``.

    A delivery that comes again within ``delay`` counts once, also after a restart from ``checkpoint``. A forged delivery has no
    such effect: those that are not authentic are told apart before ids are compared. ``partitions``: over how many the ids
    that are remembered are dealt, which a checkpoint keeps; without it as many as the session's shuffles have.
    """
    authentic = events.withColumn("genuine", delivery_valid(secret, F.col("payload"), F.col("headers"))) if "headers" in events.columns else events.withColumn("genuine", F.lit(secret is None))
    once = authentic.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id", "genuine"])
    with settings(events.sparkSession, **({"spark__sql__shuffle__partitions": str(partitions)} if partitions else {})):
        return judged(once, repositories, secret).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)


def webhook_stream(events: DataFrame, repositories: Callable[[], DataFrame], sync: Callable[[int, str], None], checkpoint: str, delay: str = "10 minutes", secret: str | None = None) -> StreamingQuery:
    """Runs ``sync(repo_id, name)`` once for each repository that a micro-batch of deliveries (event_id, ts, payload[, headers]) pushes to.

    A delivery that comes again within ``delay`` counts once, and with a ``secret`` only authentic ones count. ``repositories``
    is read anew in every batch; there are at most as many calls as registered repositories.
    """

    def batch(df: DataFrame, _: int) -> None:
        for r in triggered(df, repositories()).select("repo_id", "repo_name").distinct().collect():
            sync(r["repo_id"], r["repo_name"])

    headers = F.col("headers") if "headers" in events.columns else F.lit(None).cast("map<string,string>")
    genuine = events.where(delivery_valid(secret, F.col("payload"), headers))
    once = genuine.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def poll_once(repositories: DataFrame, heads: DataFrame, sync: Callable[[int], None], busy: Callable[[], bool] = lambda: False) -> tuple[int, int]:
    """(checked, updated); runs ``sync(id)`` for each repository whose head is another. (0, 0) while an ingestion runs."""
    if busy():
        return 0, 0
    both = repositories.where("auto_sync").join(heads.select("id", "sha"), "id").where(F.col("sha").isNotNull() & ~F.col("sha").eqNullSafe(F.col("commit_sha")))
    for r in both.select("id").orderBy("id").collect():
        sync(r["id"])
    row = poll(repositories, heads).first()
    return row["checked"], row["updated"]


def poll_until(stop: threading.Event, interval: Callable[[], int], cycle: Callable[[], object], slice_s: float = 5.0, idle_s: float = 60.0) -> int:
    """Runs ``cycle`` every ``interval()`` minutes until ``stop`` is set; returns how often. 0 minutes: no cycle, asked again later.

    Waits in short slices, so that a stop or another interval takes effect soon. A cycle that fails is followed by the next.
    """
    done, waited = 0, 0.0
    while not stop.is_set():
        minutes = interval()
        if waited >= (minutes * 60 if minutes > 0 else idle_s):
            waited = 0.0
            if minutes > 0:
                try:
                    cycle()
                except Exception:  # noqa: BLE001  the next cycle may succeed
                    pass
                done += 1
        stop.wait(slice_s)
        waited += slice_s
    return done
