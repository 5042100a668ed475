import time

import pytest

from vaultlake.streaming import jobs


def test_drain_is_idempotent(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "object_id string, added_at long").write.parquet(str(tmp_path / "q"))
    stream = lambda: spark.readStream.schema("object_id string, added_at long").parquet(str(tmp_path / "q"))
    for checkpoint in ("c1", "c2"):
        assert jobs.drain(stream(), jobs.uploader(str(tmp_path / "store")), str(tmp_path / checkpoint)).awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "store")).collect())) == [("a", 1), ("b", 2)]


def test_barrier_and_rate_limit(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(str(i), i)], "object_id string, added_at long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/q")
    batches, published, failing = [], [], [["a back end"]]

    def upload(df):
        batches.append([r.object_id for r in df.collect()])
        return failing.pop() if failing else []

    stream = lambda: jobs.queue_stream(spark, f"{tmp_path}/q", "object_id string, added_at long", files=1)
    run = jobs.barrier(upload, lambda: published.append(len(batches)))
    with pytest.raises(Exception, match="a back end"):
        jobs.drain(stream(), run, f"{tmp_path}/c").awaitTermination(60)
    assert len(batches) == 1 and not published
    assert jobs.drain(stream(), run, f"{tmp_path}/c").awaitTermination(60)
    assert batches[0] == batches[1] and sorted(sum(batches[1:], [])) == ["0", "1", "2"] and all(len(b) == 1 for b in batches) and published == [2, 3, 4]
    with pytest.raises(ValueError):
        jobs.queue_stream(spark, "x", "a long", 1, "1m")


def test_periodic(spark, tmp_path):
    ran = []
    query = jobs.periodic(spark, lambda: ran.append(1), f"{tmp_path}/c", "1 second")
    until = time.time() + 60
    while len(ran) < 2 and time.time() < until:
        time.sleep(0.2)
    query.stop()
    assert len(ran) >= 2


def test_finalize_tries_only_what_failed(spark):
    asked, waits = [], []

    def flush(files):
        asked.append(sorted(r.id for r in files.collect()))
        return files.where("id % 2 = 0") if len(asked) == 1 else files.where("id = 4")

    left = jobs.finalize(flush, spark.range(6), wait=waits.append)
    assert [r.id for r in left.collect()] == [4] and asked == [[0, 1, 2, 3, 4, 5], [0, 2, 4], [4], [4]] and waits == [0.05, 0.2, 0.8]
    assert jobs.finalize(lambda f: f.limit(0), spark.range(3), wait=waits.append).isEmpty() and len(waits) == 3
