"""Stack files: what is read is what filters and stride ask for."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

from voxelsheet.sources import stacks

SIZES = [("a", 7, 9, 11), ("b", 1, 30, 5), ("c", 12, 6, 40)]


def value(ordinal, z, y, x):
    return ordinal * 100_000 + z * 5_000 + y * 100 + x


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stacks") / "held")
    rows = [(name, z, y, x, float(value(k, z, y, x))) for k, (name, d, h, w) in enumerate(SIZES) for z in range(d) for y in range(h) for x in range(w) if (z + y) % 4]
    stacks.write_stacks(spark.createDataFrame(rows, "stack string, z int, y int, x int, v double").repartition(5), path, SIZES)
    return path


def expected(keep, stride=1):
    out, before = set(), 0
    for k, (name, d, h, w) in enumerate(SIZES):
        for z in range(0, d, stride):
            for y in range(h):
                for x in range(w):
                    row = dict(stack=name, ordinal=k, z=z, number=before + z, y=y, x=x)
                    if keep(row):
                        out.add((*row.values(), float(value(k, z, y, x)) if (z + y) % 4 else 0.0))
        before += d
    return out


CASES = [
    ("true", lambda r: True, 1), ("x >= 3 and x < 5 and y > 2", lambda r: 3 <= r["x"] < 5 and r["y"] > 2, 2),
    ("stack = 'c' and z in (0, 4, 9)", lambda r: r["stack"] == "c" and r["z"] in (0, 4, 9), 3), ("stack in ('a', 'b') and y = 4", lambda r: r["stack"] in "ab" and r["y"] == 4, 1),
    ("number between 5 and 9", lambda r: 5 <= r["number"] <= 9, 1), ("x in (1, 30) and y in (2, 5)", lambda r: r["x"] in (1, 30) and r["y"] in (2, 5), 1),
    ("z > 100 or y = 1", lambda r: r["z"] > 100 or r["y"] == 1, 1), ("ordinal = 1 and x < 0", lambda r: False, 1), ("stack like 'a%' and v > 5100", lambda r: r["stack"] == "a", 1),
]


@pytest.mark.parametrize(("condition", "keep", "stride"), CASES)
@pytest.mark.parametrize("size", [1 << 25, 64])
def test_filters_and_stride(spark, folder, condition, keep, stride, size):
    got = stacks.read_stacks(spark, folder, stride=stride, bytes_per_task=size).filter(condition)
    want = {r for r in expected(keep, stride) if "v >" not in condition or r[-1] > 5100}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def planned(folder, filters, monkeypatch, stride=1, size=1 << 25):
    """Filters left to Spark, and the bytes that all parts read."""
    reader = stacks.StackReader({"path": folder, "stride": str(stride), "bytes_per_task": str(size)})
    left = list(reader.pushFilters(filters))
    read = []
    plain = stacks.read_range
    monkeypatch.setattr(stacks, "read_range", lambda f, offset, count: read.append((f.name, offset, count)) or plain(f, offset, count))
    rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    monkeypatch.setattr(stacks, "read_range", plain)
    return left, sum(count for *_, count in read) * 4, rows, {os.path.basename(name) for name, *_ in read}


def test_bytes_read_follow_the_crop(folder, monkeypatch):
    every = sum(d * h * w for _, d, h, w in SIZES)
    left, size, rows, files = planned(folder, [], monkeypatch)
    assert (left, size, rows, len(files)) == ([], every * 4, every, 3)
    # one stack, every third slice, three rows, 4 of 40 cells: exactly these bytes
    crop = [EqualTo(("stack",), "c"), GreaterThanOrEqual(("y",), 1), LessThan(("y",), 4), GreaterThan(("x",), 9), LessThanOrEqual(("x",), 13), IsNotNull(("x",))]
    left, size, rows, files = planned(folder, crop, monkeypatch, stride=3)
    assert (left, size, rows, files) == ([], 4 * 3 * 4 * 4, 4 * 3 * 4, {"00002.f32"})
    # most of a row is wanted: one read a stretch, from the first wanted cell to the last
    left, size, rows, _ = planned(folder, [EqualTo(("ordinal",), 2), EqualTo(("z",), 3), GreaterThanOrEqual(("x",), 10)], monkeypatch)
    assert (left, size, rows) == ([], 4 * (5 * 40 + 30), 6 * 30)
    # listed rows are read as one range and left to Spark as well
    listed = In(("y",), (2, 5))
    left, size, rows, _ = planned(folder, [listed, EqualTo(("stack",), "c")], monkeypatch)
    assert (left, size, rows) == ([listed], 12 * 4 * 40 * 4, 12 * 4 * 40)
    other = StringStartsWith(("stack",), "a")
    assert planned(folder, [other, GreaterThan(("v",), 3)], monkeypatch)[0] == [other, GreaterThan(("v",), 3)]


def test_tasks_follow_the_bytes(folder):
    parts = stacks.StackReader({"path": folder, "bytes_per_task": str(6 * 40 * 4 * 3)}).partitions()
    assert max(len(p.slices) * (p.y1 - p.y0) * (p.x1 - p.x0) for p in parts) <= 6 * 40 * 3
    assert sum(len(p.slices) * (p.y1 - p.y0) * (p.x1 - p.x0) for p in parts) == sum(d * h * w for _, d, h, w in SIZES)


def test_plan_holds_no_filter_that_the_reader_took(spark, folder):
    frame = stacks.read_stacks(spark, folder).filter("x >= 2 and stack = 'a'")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan stacks" in plan and "Filter " not in plan, plan


def test_writing_again_replaces_and_empty_stacks_are_zero(spark, tmp_path):
    path = str(tmp_path / "again")
    none = spark.createDataFrame([], "stack string, z int, y int, x int, v double")
    stacks.write_stacks(none, path, [("only", 2, 3, 4)])
    assert stacks.read_stacks(spark, path).agg(F.sum("v"), F.count("*")).first() == (0.0, 24)
    with open(os.path.join(path, stacks.MANIFEST)) as f:
        assert json.load(f)["stacks"] == [{"name": "only", "file": "00000.f32", "depth": 2, "height": 3, "width": 4}]
    stacks.write_stacks(spark.createDataFrame([("only", 1, 2, 3, 5.0)], none.schema), path, [("only", 2, 3, 4)])
    assert stacks.read_stacks(spark, path).filter("v <> 0").collect()[0].asDict() == {"stack": "only", "ordinal": 0, "z": 1, "number": 1, "y": 2, "x": 3, "v": 5.0}
    assert stacks.sizes(spark, path).first().before == 0
    assert np.fromfile(os.path.join(path, "00000.f32"), "<f4").size == 24
