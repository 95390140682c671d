"""Parse jobs as a log of events: states, heartbeats, expiry. Batch folds, and the same fold over a stream.

``events``: job_id, at (epoch seconds), kind (queued, running, heartbeat, completed, failed, cancelled), message. A terminal state stays. An
active job expires 7200 s after its last change, a finished one 3600 s; without a heartbeat for 120 s an active job has failed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ledgerlark.sources.shared import create_once

ACTIVE, TERMINAL = ("queued", "running"), ("completed", "failed", "cancelled")
KEEP_ACTIVE, KEEP_DONE, STALE = 7200, 3600, 120


def jobs(events: DataFrame) -> DataFrame:
    """job_id, status, changed, expires: the first terminal event if any, else the last of queued and running. One aggregation."""
    kind, at = F.col("kind"), F.col("at")
    order = F.struct(at, kind)
    ended = F.min(F.when(kind.isin(*TERMINAL), order))
    going = F.max(F.when(kind.isin(*ACTIVE), order))
    last = events.groupBy("job_id").agg(F.coalesce(ended, going).alias("x")).filter("x is not null")
    keep = F.when(F.col("x.kind").isin(*TERMINAL), KEEP_DONE).otherwise(KEEP_ACTIVE)
    return last.select("job_id", F.col("x.kind").alias("status"), F.col("x.at").alias("changed"), (F.col("x.at") + keep).alias("expires"))


def progress(events: DataFrame) -> DataFrame:
    """job_id, heartbeat, message: the last heartbeat, and the last message that was given."""
    at = F.col("at")
    beats = events.filter(F.col("kind") == "heartbeat")
    return beats.groupBy("job_id").agg(F.max("at").alias("heartbeat"), F.max(F.when(F.col("message").isNotNull(), F.struct(at, F.col("message"))))["message"].alias("message"))


def status(jobs_: DataFrame, progress_: DataFrame, now: Column | float) -> DataFrame:
    """Jobs that haven't expired, with their progress if there is any."""
    return jobs_.filter(F.col("expires") >= now).join(progress_, "job_id", "left")


def orphans(progress_: DataFrame, jobs_: DataFrame) -> DataFrame:
    return progress_.join(jobs_.select("job_id"), "job_id", "left_anti")


def stale(jobs_: DataFrame, progress_: DataFrame, now: Column | float) -> DataFrame:
    """Active jobs without a recent heartbeat: one of exactly STALE seconds ago is none."""
    alive = progress_.filter(F.col("heartbeat") > now - F.lit(STALE)).select("job_id")
    return jobs_.filter(F.col("status").isin(*ACTIVE)).join(alive, "job_id", "left_anti")


def failed_when_stale(jobs_: DataFrame, progress_: DataFrame, now: Column | float) -> DataFrame:
    """The jobs with the stale ones failed as of now."""
    gone = stale(jobs_, progress_, now).select("job_id", F.lit(True).alias("gone"))
    gone_ = F.coalesce("gone", F.lit(False))
    return jobs_.join(gone, "job_id", "left").select("job_id", F.when(gone_, "failed").otherwise(F.col("status")).alias("status"), F.when(gone_, now).otherwise(F.col("changed")).alias("changed"), F.when(gone_, now + F.lit(KEEP_DONE)).otherwise(F.col("expires")).alias("expires"))


def active(jobs_: DataFrame) -> DataFrame:
    return jobs_.filter(F.col("status").isin(*ACTIVE)).agg(F.count("*").alias("n"))


def admitted(jobs_: DataFrame, most: int = 1) -> bool:
    """Whether another job may start."""
    return active(jobs_).first()["n"] < max(1, most)


def swept(jobs_: DataFrame, progress_: DataFrame, now: Column | float) -> tuple[DataFrame, DataFrame]:
    """What is left before a job is admitted: expired jobs and progress without a job are gone, stale jobs have failed."""
    alive = failed_when_stale(jobs_.filter(F.col("expires") >= now), progress_, now)
    return alive, progress_.join(alive.select("job_id"), "job_id", "left_semi")


def submitted(jobs_: DataFrame, progress_: DataFrame, requests: DataFrame, now: Column | float, most: int = 1, message: str = "starting") -> tuple[DataFrame, DataFrame]:
    """Jobs and progress after ``requests`` (job_id) came in: what is left after a sweep, and of the requests, in the order of their ids, as many as there is room for, queued and with a first heartbeat."""
    after = submitted_state(jobs_.join(progress_, "job_id", "left"), requests, now, most, message)
    return after.select("job_id", "status", "changed", "expires"), after.filter("heartbeat is not null").select("job_id", "heartbeat", "message")


# ---- state of jobs as one row each

def folded(events: DataFrame) -> DataFrame:
    """job_id, status, changed, expires, heartbeat, message: ``jobs`` and ``progress`` of a log in one aggregation. Status is null for a job of which only heartbeats are known."""
    kind, at, message = F.col("kind"), F.col("at"), F.col("message")
    order = F.struct(at, kind)
    rows = events.groupBy("job_id").agg(
        F.min(F.when(kind.isin(*TERMINAL), order)).alias("ended"), F.max(F.when(kind.isin(*ACTIVE), order)).alias("going"),
        F.max(F.when(kind == "heartbeat", at)).alias("heartbeat"), F.max(F.when((kind == "heartbeat") & message.isNotNull(), F.struct(at, message)))["message"].alias("message"),
    )
    last = F.coalesce("ended", "going")
    keep = F.when(F.col("ended").isNotNull(), KEEP_DONE).otherwise(KEEP_ACTIVE)
    return rows.select("job_id", last["kind"].alias("status"), last["at"].alias("changed"), (last["at"] + keep).alias("expires"), "heartbeat", "message")


def swept_state(state: DataFrame, now: Column | float) -> DataFrame:
    """``swept`` on one row a job: what has expired, or never was a job, is gone; active jobs without a recent heartbeat have failed as of now. No join: each row tells."""
    gone = F.col("status").isin(*ACTIVE) & ~F.coalesce(F.col("heartbeat") > now - F.lit(STALE), F.lit(False))
    left = state.filter("status is not null").filter(F.col("expires") >= now)
    at = now if isinstance(now, Column) else F.lit(now)
    return left.withColumns({"status": F.when(gone, "failed").otherwise(F.col("status")), "changed": F.when(gone, at).otherwise(F.col("changed")), "expires": F.when(gone, at + F.lit(KEEP_DONE)).otherwise(F.col("expires"))})


def submitted_state(state: DataFrame, requests: DataFrame, now: Column | float, most: int = 1, message: str = "starting") -> DataFrame:
    """``submitted`` on one row a job. Only the ``most`` requests with the smallest ids are ever numbered, as no more can be let in."""
    alive, most = swept_state(state, now), max(1, most)
    at = now if isinstance(now, Column) else F.lit(now)
    busy = alive.filter(F.col("status").isin(*ACTIVE)).agg(F.count("*").alias("busy")).select(F.lit(None).cast("long").alias("job_id"), "busy")
    first = requests.select("job_id").distinct().join(alive.select("job_id"), "job_id", "left_anti").orderBy("job_id").limit(most).select("job_id", F.lit(None).cast("long").alias("busy"))
    one = first.unionByName(busy).agg(F.array_sort(F.collect_list("job_id")).alias("ids"), F.greatest(F.lit(0), F.lit(most) - F.max("busy")).cast("int").alias("room"))  # of no more than most + 1 rows
    nth = one.select(F.explode(F.slice("ids", F.lit(1), F.col("room"))).alias("job_id"))
    fresh = nth.select("job_id", F.lit("queued").alias("status"), at.cast("double").alias("changed"), (at + KEEP_ACTIVE).cast("double").alias("expires"), at.cast("double").alias("heartbeat"), F.lit(message).alias("message"))
    return alive.unionByName(fresh)


STATE = "job_id long, status string, changed double, expires double, heartbeat double, message string"


class JobTable:
    """The state of all jobs in a shared folder, for any number of writers. A change reads a version, writes the state after it beside it, and makes it the next version with a file that only one writer can make; who comes
    second reads again and decides anew. So two writers never both take the last free place. A state holds the jobs of the last two hours."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/versions")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)

    def version(self) -> tuple[int, str | None]:
        """The last version and its state's folder. States before it may be removed at any time."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/versions")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = sorted(x.getPath().getName() for x in fs.listStatus(at) if not x.getPath().getName().startswith("."))
        if not names:
            return 0, None
        return int(names[-1]), self.spark.read.text(f"{self.folder}/versions/{names[-1]}").first()[0]

    def state(self) -> DataFrame:
        _, at = self.version()
        return self.spark.read.schema(STATE).parquet(at) if at else self.spark.createDataFrame([], STATE)

    def change(self, after: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The state after ``after`` of the newest one."""
        while True:
            n, at = self.version()
            before = self.spark.read.schema(STATE).parquet(at) if at else self.spark.createDataFrame([], STATE)
            path = f"{self.folder}/states/{uuid.uuid4().hex}"
            after(before).select(*before.columns).write.parquet(path)
            if create_once(self.spark, f"{self.folder}/versions/{n + 1:012d}", path):
                return self.spark.read.schema(STATE).parquet(path)

    def submit(self, requests: DataFrame, now: float, most: int = 1) -> DataFrame:
        """job_id of the requests (job_id) that were let in."""
        known = requests.select("job_id").distinct()
        before: list[DataFrame] = []

        def after(state: DataFrame) -> DataFrame:
            before[:] = [state]
            return submitted_state(state, known, now, most)

        done = self.change(after)
        return done.join(known, "job_id", "left_semi").join(before[0].select("job_id"), "job_id", "left_anti").select("job_id")

    def record(self, events: DataFrame) -> DataFrame:
        """The state after more events of the jobs that it holds; those of other jobs don't count. A finished job stays as it is."""
        def after(state: DataFrame) -> DataFrame:
            own = events.select("job_id", "at", "kind", "message").join(state.select("job_id"), "job_id", "left_semi")
            was = state.filter("status is not null").select("job_id", F.col("changed").alias("at"), F.col("status").alias("kind"), F.lit(None).cast("string").alias("message"))
            beats = state.filter("heartbeat is not null").select("job_id", F.col("heartbeat").alias("at"), F.lit("heartbeat").alias("kind"), "message")
            return folded(own.unionByName(was).unionByName(beats))

        return self.change(after)


# ---- the same fold on a stream

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STREAMED = "job_id long, status string, changed double, expires double, heartbeat double, message string, gone boolean, messages array<string>"


class JobProcessor(StatefulProcessor):
    """A job's state as events come in any order: the earliest end, the latest active state, the latest heartbeat and message, so that the order of arrival doesn't matter. An event-time timer fails a job that was silent for STALE
    seconds, as of the moment when it became so, and another forgets a job when it expires, with all its messages in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "ended_at double, ended string, going_at double, going string, heartbeat double, said_at double, said string")
        self.said = handle.getListState("said", "at double, message string")

    def _row(self, job_id: int, x: tuple, gone: bool, messages: list[str] | None) -> Row:
        ended_at, ended, going_at, going, beat, _, said = x
        status, changed = (ended, ended_at) if ended else (going, going_at)
        expires = None if changed is None else changed + (KEEP_DONE if ended else KEEP_ACTIVE)
        return Row(job_id=job_id, status=status, changed=changed, expires=expires, heartbeat=beat, message=said, gone=gone, messages=messages)

    def _due(self, x: tuple, watermark: float) -> int:
        """When the job fails or is forgotten, in milliseconds: after the watermark, so that a timer always fires."""
        ended_at, ended, going_at, going, beat, *_ = x
        if ended:
            at = ended_at + KEEP_DONE
        elif going:
            at = max(going_at, beat if beat is not None else going_at) + STALE
        else:
            at = beat + KEEP_ACTIVE
        return max(int(at * 1000), int(watermark) + 1)

    def _timed(self, x: tuple, watermark: float) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(self._due(x, watermark))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        x = tuple(self.job.get()) if self.job.exists() else (None,) * 7
        ended_at, ended, going_at, going, beat, said_at, said = x
        for r in rows:
            if r.kind in TERMINAL:
                if ended is None or (r.at, r.kind) < (ended_at, ended):
                    ended_at, ended = r.at, r.kind
            elif r.kind in ACTIVE:
                if going is None or (r.at, r.kind) > (going_at, going):
                    going_at, going = r.at, r.kind
            elif r.kind == "heartbeat":
                beat = r.at if beat is None else max(beat, r.at)
                if r.message is not None:
                    self.said.appendValue((r.at, r.message))
                    if said is None or (r.at, r.message) > (said_at, said):
                        said_at, said = r.at, r.message
        x = (ended_at, ended, going_at, going, beat, said_at, said)
        if ended or going or beat is not None:
            self.job.update(x)
            self._timed(x, timerValues.getCurrentWatermarkInMs())
            yield self._row(key[0], x, False, None)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if not self.job.exists():
            return
        x = tuple(self.job.get())
        ended_at, ended, going_at, going, beat, said_at, said = x
        if going and not ended:
            x = (max(going_at, beat if beat is not None else going_at) + STALE, "failed", going_at, going, beat, said_at, said)
            self.job.update(x)
            self._timed(x, timerValues.getCurrentWatermarkInMs())
            yield self._row(key[0], x, False, None)
            return
        messages = [m for _, m in sorted(tuple(v) for v in self.said.get())] if self.said.exists() else []
        self.job.clear()
        self.said.clear()
        yield self._row(key[0], x, True, messages)

    def close(self) -> None:
        pass


def job_stream(events: DataFrame) -> DataFrame:
    """job_id, status, changed, expires, heartbeat, message, gone, messages of each job with news, from a stream of events with column ``ts`` under a watermark. An active job that is silent for STALE seconds of event time fails; when it expires
    its last row has ``gone`` and all its messages. State is kept in RocksDB, which the session is set to."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    own = events.select("job_id", "at", "kind", "message", "ts")
    return own.groupBy("job_id").transformWithState(JobProcessor(), STREAMED, "Update", "EventTime")
