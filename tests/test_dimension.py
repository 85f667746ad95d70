"""Updates of a stored dimension: what changes, what stays, and what readers see meanwhile."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from quietstar.sources import dimension, sinks

SCHEMA = "product_id string, title string, brand string"


@pytest.fixture
def stored(spark, tmp_path):
    rows = [(f"p{i}", f"t{i}", "old") for i in range(300)] + [(None, "nobody", "old"), ("p7", "again", "old")]
    path = str(tmp_path / "dimension")
    dimension.create_dimension(spark.createDataFrame(rows, SCHEMA), path, buckets=16)
    return path, rows


def fixes(spark, *rows):
    return spark.createDataFrame(rows, "product_id string, brand string, title string")


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def test_only_touched_files_are_written_anew(spark, stored):
    path, rows = stored
    before = files(path)
    assert dimension.update_dimension(spark, path, fixes(spark, ("p7", "new", ""), ("p8", "new", "Named")), sinks.patch_products) == 2
    after = files(path)
    assert all(after[f] == t for f, t in before.items()) and 1 <= len(after) - len(before) <= 2
    folders = [dimension._folders(spark, path, v) for v in (1, 2)]
    assert sum(folders[0][b] == folders[1][b] for b in range(16)) >= 14
    want = {(p, "Named" if p == "p8" else t, "new" if p in ("p7", "p8") else b) for p, t, b in rows}
    assert {tuple(r) for r in dimension.read_dimension(spark, path).collect()} == want
    assert dimension.read_dimension(spark, path).count() == len(rows)


def test_a_repeated_update_writes_nothing(spark, stored):
    path, _ = stored
    fix = fixes(spark, ("p1", "new", "x"), ("absent", "new", "y"))
    assert [dimension.update_dimension(spark, path, fix, sinks.patch_products) for _ in range(3)] == [2, 2, 2]
    once = files(path)
    assert dimension.update_dimension(spark, path, fixes(spark, ("absent", "new", "y")), sinks.patch_products) == 2
    assert files(path) == once


def test_readers_see_a_version_before_or_after(spark, stored):
    path, rows = stored
    held = dimension.read_dimension(spark, path)
    dimension.update_dimension(spark, path, fixes(spark, ("p1", "new", "")), sinks.patch_products)
    assert {tuple(r) for r in held.collect()} == set(rows)
    assert dimension.read_dimension(spark, path, version=1).where("brand = 'new'").count() == 0
    # A listing that was not written to its end is not there.
    os.makedirs(f"{path}/listings/000000009")
    assert dimension.read_dimension(spark, path).where("brand = 'new'").count() == 1


def test_the_second_of_two_writers_fails(spark, stored):
    path, _ = stored
    old = dimension._folders(spark, path, 1)
    dimension.update_dimension(spark, path, fixes(spark, ("p1", "first", "")), sinks.patch_products)
    rows = dimension.read_dimension(spark, path, version=1).withColumn("_bucket", F.lit(0))
    with pytest.raises(Exception, match="exists"):
        dimension._write(spark, path, 2, rows, old, [0])
    assert dimension.read_dimension(spark, path).where("brand = 'first'").count() == 1


def test_an_empty_dimension(spark, tmp_path):
    path = str(tmp_path / "none")
    dimension.create_dimension(spark.createDataFrame([], SCHEMA), path, buckets=4)
    assert dimension.read_dimension(spark, path, SCHEMA).count() == 0
    assert dimension.update_dimension(spark, path, fixes(spark, ("p1", "new", "")), sinks.patch_products) == 1
