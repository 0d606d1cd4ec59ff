"""Appends by key: exact whatever the filters say, and files without a hit are not read."""

from pyspark.sql import functions as F

from lodeseam.sources import keyed


def test_appends_are_exact(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda ks, v: spark.createDataFrame([(k, v) for k in ks], "k string, v int")
    assert keyed.append_new(rows(["a", "b", None, None], 1), path, "k") == 3
    assert keyed.append_new(rows(["b", None, "c", "c"], 2), path, "k") == 1
    assert keyed.append_new(rows([], 3), path, "k") == 0
    # files of another writer have no filters yet
    rows(["x"], 4).write.mode("append").parquet(path)
    assert keyed.append_new(rows(["x", "a", "y"], 5), path, "k") == 1
    got = sorted(((r.k, r.v) for r in spark.read.parquet(path).collect()), key=str)
    assert got == [("a", 1), ("b", 1), ("c", 2), ("x", 4), ("y", 5), (None, 1)] and spark.read.parquet(path).columns == ["k", "v"]
    # names of deleted files stay in the sidecar and do no harm
    for f in spark.read.parquet(path).where("k = 'x'").select("_metadata.file_path").distinct().collect():
        (tmp_path / "t" / f.file_path.rsplit("/", 1)[-1]).unlink()
    assert keyed.append_new(rows(["x", "y"], 6), path, "k") == 1


def test_first_append_of_nothing(spark, tmp_path):
    assert keyed.append_new(spark.createDataFrame([], "k long"), str(tmp_path / "t"), "k") == 0


def test_filters_tell_files_apart(spark, tmp_path):
    """No key is missed, and of 40,000 keys that aren't there at most one in a hundred is said to be in one of four files."""
    path = str(tmp_path / "t")
    for k in range(4):
        spark.range(k * 10_000, (k + 1) * 10_000, numPartitions=1).write.mode("append").parquet(path)
    filters = keyed.index_files(spark, path, "id")
    there = spark.range(40_000)
    held = spark.read.parquet(path).select("id", F.col("_metadata.file_name").alias("file"))
    assert held.join(keyed.may_hold(there, "id", filters), ["id", "file"], "left_anti").count() == 0
    assert keyed.may_hold(spark.range(1_000_000, 1_040_000), "id", filters).count() <= 400
    assert filters.groupBy("file").count().count() == 4 and filters.count() <= 4 * 1024
