import random
import threading

import pytest
from pyspark.sql import functions as F

from ledgerlark.streaming import jobs as J

SCHEMA = "job_id long, at double, kind string, message string"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA).withColumn("ts", F.timestamp_seconds("at"))


def streamed(spark, tmp_path, batches, delay):
    """All rows that the stream gives for batches of events, in order."""
    seen = []
    (tmp_path / "in").mkdir()
    schema = rows(spark, [(1, 0.0, "x", None)]).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withWatermark("ts", delay)
    out = J.job_stream(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: seen.extend(df.collect())).start()
    try:
        for batch in batches:
            rows(spark, batch).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            out.processAllAvailable()
    finally:
        out.stop()
    return seen


def events(seed, n=160, jobs=12):
    r = random.Random(seed)
    kinds = [*J.ACTIVE, *J.TERMINAL, "heartbeat", "heartbeat", "heartbeat"]
    return [(r.randrange(jobs), 1000.0 + r.randrange(90), r.choice(kinds), r.choice([None, "a", "b"])) for _ in range(n)]


def test_any_order_of_arrival_gives_the_batch_fold(spark, tmp_path):
    data = events(5) + [(99, 1010.0, "heartbeat", "only"), (98, 1001.0, "queued", None), (98, 1050.0, "completed", None), (98, 1020.0, "failed", None)]
    random.Random(1).shuffle(data)
    seen = streamed(spark, tmp_path, [data[i::4] for i in range(4)], "1 hour")
    last = {r.job_id: tuple(r)[:6] for r in seen}
    assert not any(r.gone for r in seen)
    assert last == {r.job_id: tuple(r) for r in J.folded(rows(spark, data)).collect()}
    assert last[98][1:3] == ("failed", 1020.0) and last[99][1] is None


def test_silent_jobs_fail_and_ended_ones_are_forgotten(spark, tmp_path):
    batches = [
        [(1, 1000.0, "queued", None), (1, 1010.0, "heartbeat", "m2"), (1, 1005.0, "heartbeat", "m1"), (2, 1000.0, "running", None), (2, 1001.0, "completed", None)],
        [(3, 1200.0, "queued", None)],
        [(3, 1201.0, "heartbeat", None)],
        [(4, 9000.0, "queued", None)],
        [(4, 9001.0, "heartbeat", None)],
    ]
    seen = streamed(spark, tmp_path, batches, "1 second")
    ends = [(r.job_id, r.status, r.changed, r.gone, r.messages) for r in seen if r.status in J.TERMINAL]
    assert (1, "failed", 1010.0 + J.STALE, False, None) in ends and (1, "failed", 1010.0 + J.STALE, True, ["m1", "m2"]) in ends
    assert (2, "completed", 1001.0, False, None) in ends and (2, "completed", 1001.0, True, []) in ends
    assert not any(r.job_id == 4 and r.status != "queued" for r in seen)


def test_one_fold_equals_jobs_and_progress(spark):
    e = rows(spark, events(7, 300, 40))
    joined = J.jobs(e).join(J.progress(e), "job_id", "full").select("job_id", "status", "changed", "expires", "heartbeat", "message")
    assert sorted(map(tuple, J.folded(e).collect()), key=repr) == sorted(map(tuple, joined.collect()), key=repr)
    for now in (1050.0, 1150.0, 1200.0, 5000.0):
        jobs, progress = J.swept(J.jobs(e), J.progress(e), F.lit(now))
        want = jobs.join(progress, "job_id", "left").select("job_id", "status", "changed", "expires", "heartbeat", "message")
        assert sorted(map(tuple, J.swept_state(J.folded(e), now).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "job_id long")


def test_a_table_of_jobs(spark, tmp_path):
    t = J.JobTable(spark, str(tmp_path / "jobs"))
    assert sorted(r.job_id for r in t.submit(ids(spark, 5, 3, 9), 100.0, 2).collect()) == [3, 5]
    assert t.submit(ids(spark, 9, 3), 101.0, 2).count() == 0
    t.record(spark.createDataFrame([(3, 110.0, "completed", None), (3, 105.0, "running", None), (5, 120.0, "heartbeat", "half"), (7, 100.0, "queued", None), (3, 130.0, "failed", None)], SCHEMA))
    assert sorted((r.job_id, r.status, r.changed, r.heartbeat, r.message) for r in t.state().collect()) == [(3, "completed", 110.0, 100.0, "starting"), (5, "queued", 100.0, 120.0, "half")]
    assert [r.job_id for r in t.submit(ids(spark, 9), 121.0, 2).collect()] == [9]
    assert [r.job_id for r in t.submit(ids(spark, 10, 11), 260.0, 2).collect()] == [10, 11]  # 5 and 9 were silent too long
    assert {r.job_id: r.status for r in t.state().collect()} == {3: "completed", 5: "failed", 9: "failed", 10: "queued", 11: "queued"}
    assert t.submit(ids(spark, 12), 9000.0).count() == 1 and t.state().count() == 1


def test_two_writers_share_the_last_place(spark, tmp_path):
    folder, got, errors = str(tmp_path / "jobs"), [], []

    def writer(k):
        try:
            got.extend(r.job_id for r in J.JobTable(spark, folder).submit(ids(spark, k), 100.0).collect())
        except Exception as e:
            errors.append(e)

    J.JobTable(spark, folder)
    threads = [threading.Thread(target=writer, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and len(got) == 1 and J.JobTable(spark, folder).version()[0] == 4
