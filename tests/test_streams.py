"""Streams: left-over windows, levels of folders, extremes frame by frame."""

import glob
import os
import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelsheet.streaming import jobs

KEYS, ORDER = ["region", "px"], ["seq"]
SCHEMA = "region int, px int, v int, seq int"


def batches_of(n, seed=1):
    draw = random.Random(seed)
    return [[(draw.randrange(3), draw.randrange(20), draw.randrange(256), 100 * k + i) for i in range(5)] for k in range(n)]


def feed(spark, folder, batches, first=0):
    for k, rows in enumerate(batches, first):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        for f in glob.glob(f"{folder}/*.parquet"):
            if not os.path.basename(f).startswith("b"):
                os.rename(f, f"{folder}/b{k:04}.parquet")
                os.utime(f"{folder}/b{k:04}.parquet", (1_000_000 + 10 * k,) * 2)


def upsert(spark, source, path, fan=4):
    stream = jobs.follow(spark, source, spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)
    query = jobs.upsert_predictions(stream, KEYS, "v", ORDER, path, fan)
    query.awaitTermination()


def expected(batches):
    top = {}
    for rows in batches:
        for region, px, v, seq in rows:
            top[region, px] = max(top.get((region, px), (-1, 0)), (seq, v))
    return {k: v for k, (_, v) in top.items()}


def held(spark, path):
    return {(r.region, r.px): r.v for r in jobs.current(spark, path, KEYS, "v", ORDER).collect()}


def folders(path):
    return sorted(os.path.basename(f) for f in glob.glob(f"{path}/level*"))


def test_many_batches_leave_few_folders(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    batches = batches_of(50)
    feed(spark, source, batches)
    upsert(spark, source, path)
    live = jobs.LiveFolders(spark, path)
    assert held(spark, path) == expected(batches)
    assert live.versions()[-1] == 49 and len(live.versions()) == 2
    assert len(live.read()) <= 3 * 4 and len(folders(path)) <= 2 * 3 * 4
    assert sorted(live.read()) == ["level0-48", "level0-49", "level2-15", "level2-31", "level2-47"]


def test_a_crash_between_write_and_swap_changes_nothing(spark, tmp_path, monkeypatch):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    batches = batches_of(9, seed=2)
    feed(spark, source, batches[:7])
    upsert(spark, source, path)
    before, live = held(spark, path), jobs.LiveFolders(spark, path).read()
    feed(spark, source, batches[7:], first=7)
    swap = jobs.LiveFolders.swap

    def crash(self, version, names):
        raise RuntimeError("lost the driver")

    monkeypatch.setattr(jobs.LiveFolders, "swap", crash)
    with pytest.raises(Exception, match="lost the driver"):
        upsert(spark, source, path)
    assert held(spark, path) == before and jobs.LiveFolders(spark, path).read() == live
    assert "level0-7" in folders(path)  # written, but not live
    monkeypatch.setattr(jobs.LiveFolders, "swap", swap)
    upsert(spark, source, path)
    assert held(spark, path) == expected(batches)


def test_a_repeated_batch_is_not_merged_twice(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    feed(spark, source, batches_of(3))
    upsert(spark, source, path)
    names = jobs.LiveFolders(spark, path).read()
    with pytest.raises(OSError, match="already"):
        jobs.LiveFolders(spark, path).swap(2, names)
    assert jobs.LiveFolders(spark, path).read() == names
    with pytest.raises(ValueError, match="no batch"):
        jobs.current(spark, str(tmp_path / "none"), KEYS, "v", ORDER)


def test_one_file_is_dealt_out_before_it_is_sorted(spark, tmp_path, monkeypatch):
    """A batch's rows, many of one pixel, and those of folders are spread by what they meet on."""
    source, path, seen, spread = str(tmp_path / "in"), str(tmp_path / "out"), [], jobs.spread
    monkeypatch.setattr(jobs, "spread", lambda rows, *by: seen.append(by) or spread(rows, *by))
    batches = [[(0, 1, v, v % 7) for v in range(500)], [(0, 1, 3, 6), (1, 2, 1, 0)]]
    feed(spark, source, batches)
    upsert(spark, source, path, fan=2)
    assert held(spark, path) == expected(batches)
    assert seen == [(*KEYS, *ORDER)] * 2 + [tuple(KEYS)] * 2
    plan = jobs.current(spark, path, KEYS, "v", ORDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan


LOG = "job int, step bigint, metric string, value100 bigint, flush boolean"


def log_rows(n, seed):
    draw = random.Random(seed)
    return [(draw.randrange(3), k, draw.choice(["loss", "f1"]), draw.randrange(1000), draw.random() < 0.1) for k in range(n)]


def windows_by_hand(rows):
    report, out = defaultdict(int), defaultdict(list)
    for job, step, metric, value, flush in rows:
        out[job, report[job], metric].append(value)
        report[job] += flush
    return {k: (sum(v), len(v)) for k, v in out.items()}


def write_log(spark, folder, rows, files):
    size = -(-len(rows) // files)
    for k in range(files):
        part = rows[k * size:(k + 1) * size]
        if part:
            spark.createDataFrame(random.Random(k).sample(part, len(part)), LOG).coalesce(1).write.mode("append").parquet(folder)
            for f in glob.glob(f"{folder}/part-*.parquet"):
                os.rename(f, f"{folder}/f{k:04}.parquet")
                os.utime(f"{folder}/f{k:04}.parquet", (1_000_000 + 10 * k,) * 2)


@pytest.mark.parametrize("per_trigger", [1, 3])
def test_left_overs_go_on_into_the_next_batch(spark, tmp_path, per_trigger):
    rows = log_rows(400, 3)
    folder = str(tmp_path / "log")
    write_log(spark, folder, rows, 9)
    frame = spark.createDataFrame(rows, LOG)
    closed = jobs.run_to_end(jobs.count_windows(jobs.follow(spark, folder, frame.schema, files_per_trigger=per_trigger)), "windows")
    every = closed.unionByName(jobs.open_windows(closed, frame))
    got = {(r.job, r.report, r.metric): (r.total, r.n) for r in every.collect()}
    assert got == windows_by_hand(rows) and every.count() == len(got)


def test_idle_windows_are_closed_by_a_timer(spark, tmp_path):
    folder, out = str(tmp_path / "log"), str(tmp_path / "out")
    rows = [(1, k, "loss", k, k == 4) for k in range(7)]
    write_log(spark, folder, rows, 1)
    stream = jobs.count_windows(jobs.follow(spark, folder, spark.createDataFrame([], LOG).schema), idle_ms=200)
    query = stream.writeStream.format("parquet").outputMode("append").trigger(processingTime="500 milliseconds").option(
        "path", out).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        got = []
        for _ in range(120):
            time.sleep(0.5)
            got = spark.read.schema(stream.schema).parquet(out).collect() if os.path.exists(f"{out}/_spark_metadata") else []
            if len(got) == 2:
                break
    finally:
        query.stop()
    assert sorted((r.report, r.total, r.n) for r in got) == [(0, 10, 5), (1, 11, 2)]


def test_records_are_all_that_counts():
    draw = np.random.default_rng(4)
    steps, values = draw.permutation(300), draw.normal(size=(300, 6))
    kept = jobs.records(steps, values)
    assert len(kept[0]) < 80 and (np.diff(kept[0]) > 0).all()
    order = np.argsort(steps)
    best = np.hstack([np.minimum.accumulate(values[order, :3]), np.maximum.accumulate(values[order, 3:])])
    changed = np.r_[True, (best[1:] != best[:-1]).any(axis=1)]
    assert kept[0].tolist() == steps[order][changed].tolist()
    split = [jobs.records(s, v) for s, v in zip(np.array_split(steps, 7), np.array_split(values, 7))]
    again = jobs.records(np.concatenate([s for s, _ in split]), np.vstack([v for _, v in split]))
    assert again[0].tolist() == kept[0].tolist()
