"""Streaming runs into an epoch-keyed sink, sinks on empty frames, column names."""

import pytest

from hitlink.functions import columns as PC
from hitlink.sources import io
from hitlink.streaming import incremental as INC


def put(spark, folder, name, ids):
    spark.createDataFrame([(i, f"{name}{i}") for i in ids], "id long, v string").coalesce(1).write.mode("append").parquet(str(folder))


def rows(spark, sink):
    return sorted(r.id for r in INC.read_sink(spark, sink).collect())


@pytest.fixture
def run(spark, tmp_path):
    schema = spark.createDataFrame([], "id long, v string").schema
    lookup = spark.createDataFrame([(i, i * 10) for i in range(0, 20, 2)], "id long, w long")

    def go(checkpoint="checkpoint"):
        return INC.run_incremental(spark, str(tmp_path / "in"), schema, lambda d: d.join(lookup, "id", "left"), ["id"],
                                   sink=str(tmp_path / "sink"), checkpoint=str(tmp_path / checkpoint))

    return go


def test_each_key_once_over_files_restarts_and_new_checkpoints(spark, tmp_path, run):
    put(spark, tmp_path / "in", "a", range(1, 6))
    put(spark, tmp_path / "in", "b", range(4, 9))
    sink = run()
    assert rows(spark, sink) == list(range(1, 9))
    run()
    assert rows(spark, sink) == list(range(1, 9))  # nothing new
    put(spark, tmp_path / "in", "c", [1, 8, 9])
    run()
    assert rows(spark, sink) == list(range(1, 10))
    run("another checkpoint")  # reads all files again, under its own run
    assert rows(spark, sink) == list(range(1, 10))


def test_a_replayed_batch_replaces_itself_and_the_sink_is_not_read(spark, tmp_path, run, monkeypatch):
    seen = []
    real = INC.write_epoch

    def twice(batch, sink, run_id, epoch):
        seen.append(batch._jdf.queryExecution().optimizedPlan().toString())
        real(batch, sink, run_id, epoch)
        real(batch, sink, run_id, epoch)

    monkeypatch.setattr(INC, "write_epoch", twice)
    for k in range(4):
        put(spark, tmp_path / "in", "x", range(3 * k, 3 * k + 5))
    sink = run()
    assert rows(spark, sink) == list(range(14)) and len(seen) >= 4
    assert not any("sink" in plan for plan in seen)  # whatever the sink holds, a batch reads none of it


def test_an_empty_frame_does_not_replace_good_output(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(3)
    assert not io.write_table(df.where("false"), path) and not io.path_exists(spark, path)
    assert io.write_table(df, path) and not io.write_table(df.where("id > 5"), path)
    assert spark.read.parquet(path).count() == 3
    assert io.write_table(df.limit(1), path) and spark.read.parquet(path).count() == 1


def test_column_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["  Chart Week", "PEAK pos ", "title"])
    assert PC.standardise_names(df).columns == ["chart_week", "peak_pos", "title"]
