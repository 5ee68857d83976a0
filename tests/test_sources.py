import datetime
import zipfile

import pytest
from pyspark.sql import functions as F

from wharfline.operators import extract
from wharfline.sources import dump, index
from wharfline.sources.zips import ZipEntries
from wharfline.streaming import jobs


def test_dump_files(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else f"it's\n\\ {i} \0ü,(')", bytearray([i % 256, 0, 39]), i / 4) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, s string, b binary, d double")
    path = str(tmp_path / "dump")
    dump.write_dump(df, path, "t`x", ["id"], chunks=3)
    assert sorted(map(tuple, dump.read_dump(spark, path, df.schema).collect())) == sorted(map(tuple, rows))
    assert tuple(dump.dump_bound(spark, path, "id long").first()) == (199,)
    small = dump.dump_lines(df, "t", ["id"], chunks=2, statement_bytes=500)
    assert small.where("length(line) > 700").count() == 0
    assert sorted(r.id for r in dump.parse_lines(small, df.schema).collect()) == list(range(200))


def test_dump_of_nothing(spark):
    df = spark.createDataFrame([], "id long, s string")
    assert dump.parse_lines(dump.dump_lines(df, "t", ["id"], chunks=2), df.schema).count() == 0


def test_index(spark, tmp_path):
    path = str(tmp_path / "index")
    lines = spark.createDataFrame([("a", 1, "database/a.0001.sql", 5, "0" * 64)], "t string, c int, p string, b long, h string")
    index.write_index(lines, path)
    again = index.append_once(index.read_index(spark, path), lines.unionByName(lines.withColumn("c", F.lit(2))), ["t", "c"])
    assert sorted(r.c for r in again.collect()) == [1, 2]
    assert index.read_inventory(spark, path, "*.json").select("b").first().b > 0


def test_zip_entries(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/y.txt", b"abc")
        z.writestr("empty", b"")
    spark.dataSource.register(ZipEntries)
    got = {r.p: (r.b, r.h[:8]) for r in spark.read.format("zip_entries").load(str(tmp_path)).collect()}
    assert got == {"x/y.txt": (3, "ba7816bf"), "empty": (0, "e3b0c442")}


def test_greedy_batches_are_tight(spark):
    df = spark.createDataFrame([(0, i, (i * 37) % 101) for i in range(300)], "s int, id int, b long")
    for crossing in (True, False):
        got = extract.greedy_groups(df, ["s"], ["id"], "b", 500, crossing=crossing).groupBy("batch").agg(F.sum("b").alias("b"), F.max_by("b", "id").alias("last")).orderBy("batch").collect()
        assert sum(r.b for r in got) == sum((i * 37) % 101 for i in range(300))
        for r in got[:-1]:
            assert (r.b >= 500 and r.b - r["last"] < 500) if crossing else r.b <= 500


def test_greedy_batches_keep_each_row(spark):
    df = spark.createDataFrame([(0, 1, 300, 9), (0, 1, 300, 9), (0, None, None, 9), (None, 2, 5, 9)], "s int, id int, b long, batch int")
    got = extract.greedy_groups(df, ["s"], ["id"], "b", 250).collect()
    assert sorted((str(r.s), str(r.id), r.batch) for r in got) == [("0", "1", 0), ("0", "1", 1), ("0", "None", 2), ("None", "2", 0)]


def test_key_pages_cover_the_table(spark):
    df = spark.createDataFrame([(i % 5, i) for i in range(50)], "a int, b int")
    seen, after = [], None
    bound = extract.snapshot_bound(df, ["a", "b"]).first().asDict()
    while page := extract.key_page(df, ["a", "b"], after=after, bound=bound, limit=7).collect():
        seen += [tuple(r) for r in page]
        after = page[-1].asDict()
    assert seen == sorted((i % 5, i) for i in range(50))


def test_key_page_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    spark.range(100).select(F.col("id").alias("a"), F.col("id").alias("b")).write.parquet(path)
    df = extract.key_page(spark.read.parquet(path), ["a", "b"], after={"a": 5, "b": 5}, bound={"a": 50, "b": 1})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(a,5)" in plan and "LessThanOrEqual(a,50)" in plan


def test_streams(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [(1, "p", base), (1, "p", base + datetime.timedelta(seconds=300)), (1, "p", base + datetime.timedelta(seconds=600)), (2, "p", base), (2, "q", base + datetime.timedelta(seconds=300))]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, "job long, position string, ts timestamp").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("job long, position string, ts timestamp").parquet(src)
    query = jobs.takeovers(stream).writeStream.outputMode("update").format("memory").queryName("takeovers").option("checkpointLocation", str(tmp_path / "c1")).start()
    query.processAllAvailable()
    query.stop()
    assert {(r.job, r.position): r.takeovers for r in spark.table("takeovers").collect()} == {(1, "p"): 2, (2, "q"): 0}
    query = stream.writeStream.foreachBatch(jobs.write_once(out)).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(out).count() == 5
    counted = jobs.status_counts(stream.withColumnRenamed("position", "event_type")).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c3")).start()
    counted.processAllAvailable()
    counted.stop()
    assert sum(r.n for r in spark.table("counts").collect()) == 5


def test_broken_dump_raises(spark):
    lines = spark.createDataFrame([("INSERT INTO `t` (`a`, `b`) VALUES (1,2),(3);",)], "line string")
    with pytest.raises(Exception, match="values for 2 columns"):
        dump.parse_lines(lines, spark.createDataFrame([], "a int, b int").schema).collect()
    for line in ("UPDATE x SET y = 1;", "INSERT INTO `t` (`a`) VALUES (1);", "INSERT INTO `t` (`a`, `b`) VALUES (1,now());", "half a line"):
        with pytest.raises(Exception, match="ValueError"):
            dump.parse_lines(spark.createDataFrame([(line,)], "line string"), spark.createDataFrame([], "a int, b int").schema).collect()
