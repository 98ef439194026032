"""Reservations, replayed batches, failures between steps, and files that are replaced in one step."""

import pytest

from quillon.operators import storage
from quillon.streaming import jobs, lifecycle

SCHEMA = "id long, text string"


def source(spark, tmp_path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))


def add(spark, tmp_path, i):
    spark.createDataFrame([(10 * i + k, f"t{k}") for k in range(3)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))


def test_one_caller_reserves(spark, tmp_path):
    path = f"file://{tmp_path}/jobs"
    assert jobs.poll(spark, path, "a-1") is None
    assert jobs.reserve(spark, path, "a-1", owner="x") and not jobs.reserve(spark, path, "a-1", owner="y")
    assert jobs.poll(spark, path, "a-1") == {"job": "a-1", "status": "reserved", "owner": "x"}
    jobs.release(spark, path, "a-1")
    assert jobs.reserve(spark, path, "a-1", owner="y") and jobs.poll(spark, path, "a-1")["owner"] == "y"
    for wrong in ("", "../a", "a/b", "ä"):
        with pytest.raises(ValueError, match="not a job id"):
            jobs.reserve(spark, path, wrong)


def test_reserve_run_and_poll(spark, tmp_path):
    path = f"file://{tmp_path}/jobs"
    add(spark, tmp_path, 0)
    add(spark, tmp_path, 1)
    with pytest.raises(ValueError, match="not reserved"):
        jobs.run(source(spark, tmp_path), path, "j")
    jobs.reserve(spark, path, "j")
    assert jobs.run(source(spark, tmp_path), path, "j") == {"job": "j", "status": "done", "rows": 6}
    add(spark, tmp_path, 2)
    assert jobs.run(source(spark, tmp_path), path, "j")["rows"] == 9
    assert {r["job"]: r["status"] for r in jobs.statuses(spark, path).collect()} == {"j": "done"}


def test_replay_of_a_batch_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    write = jobs.write_batch(path)
    one, other = (spark.createDataFrame([(k, "x")], SCHEMA) for k in (1, 2))
    write(one, 0)
    write(other, 1)
    before = sorted(map(tuple, jobs.committed(spark, path, SCHEMA).collect()))
    write(one, 0)
    write(other, 0)
    assert sorted(map(tuple, jobs.committed(spark, path, SCHEMA).collect())) == before == [(1, "x", 0), (2, "x", 1)]


def test_a_batch_that_is_not_committed_is_not_read_and_is_written_anew(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    assert jobs.committed(spark, path, SCHEMA).count() == 0
    spark.createDataFrame([(9, "half")], SCHEMA).write.parquet(f"{path}/rows/batch=0")
    assert jobs.committed(spark, path, SCHEMA).count() == 0
    jobs.write_batch(path)(spark.createDataFrame([(1, "x")], SCHEMA), 0)
    assert [tuple(r) for r in jobs.committed(spark, path, SCHEMA).collect()] == [(1, "x", 0)]


def test_failed_jobs_say_so_and_go_on(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/jobs"
    add(spark, tmp_path, 0)
    jobs.reserve(spark, path, "j")
    real = jobs.write_batch

    def failing(where):
        def write(rows, batch):
            raise RuntimeError("no space")

        return write

    monkeypatch.setattr(jobs, "write_batch", failing)
    with pytest.raises(Exception, match="no space"):
        jobs.run(source(spark, tmp_path), path, "j")
    assert jobs.poll(spark, path, "j")["status"] == "failed"
    monkeypatch.setattr(jobs, "write_batch", real)
    assert jobs.run(source(spark, tmp_path), path, "j")["rows"] == 3


def test_a_checkpoint_survives_a_crash_between_the_steps(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/state.json"
    lifecycle.save_checkpoint(spark, path, {"last": 1})

    class Stop(Exception):
        pass

    # The new file is written beside; the run ends before it is put in place.
    context = spark.sparkContext
    monkeypatch.setattr(type(context._gateway), "new_array", lambda *a: (_ for _ in ()).throw(Stop()))
    with pytest.raises(Stop):
        lifecycle.save_checkpoint(spark, path, {"last": 2})
    monkeypatch.undo()
    assert lifecycle.load_checkpoint(spark, path, {})["last"] == 1
    lifecycle.save_checkpoint(spark, path, {"last": 3})
    assert lifecycle.load_checkpoint(spark, path, {})["last"] == 3


def test_files_are_replaced_in_one_step(spark, tmp_path):
    path = f"file://{tmp_path}/deep/er/a.txt"
    for text in ("one", "two ß", ""):
        storage.replace_text(spark, path, text)
        assert (tmp_path / "deep/er/a.txt").read_text() == text
    assert [p.name for p in (tmp_path / "deep/er").iterdir() if not p.name.endswith(".crc")] == ["a.txt"]
