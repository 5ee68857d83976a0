import datetime as dt

from conftest import DATA
from pyspark.sql import functions as F

from wharfline.functions import clock, paths, sqltext
from wharfline.operators import carry, catalog, extract, verify


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_bounded_names_count_bytes(spark):
    names = ["é" * 40, "a" * 64, "a" * 65, "日本" * 30, None, ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    found = [r[0] for r in df.select(sqltext.bounded_name(F.col("n"))).collect()]
    assert all(n is None or len(n.encode()) <= 64 for n in found)
    assert found[1] == names[1] and found[4] is None and found[5] == ""
    assert found[0].startswith("é" * 28 + "_") and found[3].startswith("日本" * 9 + "_")


def test_path_keys(spark):
    given = ["A/B.txt", "É/x", "É/X", None, ""]
    df = spark.createDataFrame([(n,) for n in given], "n string")
    assert [r[0] for r in df.select(paths.path_key(F.col("n"))).collect()] == ["a/b.txt", "é/x", "é/x", None, ""]
    keyed = paths.with_path_key(df.withColumn("k", F.lit(1)), "n", "k")
    assert sorted(map(repr, keyed.collect())) == sorted(map(repr, df.select("n", paths.path_key(F.col("n")).alias("k")).collect())) and keyed.columns == ["n", "k"]


def test_times(spark):
    given = [0, 315532800, 1709164799, 4354819198, None]
    df = spark.createDataFrame([(n,) for n in given], "s long")
    for seconds, text, dos in df.select("s", clock.utc_text(F.col("s")), clock.dos_datetime(F.col("s"))).collect():
        if seconds is None:
            assert text is None and dos is None
            continue
        assert text == dt.datetime.fromtimestamp(seconds, dt.UTC).strftime("%Y-%m-%d %H:%M:%S")
        t = dt.datetime.fromtimestamp(max(seconds, 315532800), dt.UTC)
        assert tuple(dos) == (t.hour << 11 | t.minute << 5 | t.second // 2, (t.year - 1980) << 9 | t.month << 5 | t.day)


def test_own_names_are_those_that_are_made(spark):
    made = spark.read.parquet(f"{DATA}/part.parquet").select("p_partkey", sqltext.generated_name("tmp", F.col("p_partkey"), F.col("p_name")).alias("n"))
    assert made.where(~sqltext.own_name(F.col("n"), ["tmp"], ["jobs"])).isEmpty()
    given = ["tmp7_0123456789ab", "tmp_0123456789ab", "tmp7_0123456789AB", "tmp7_0123456789abc", "7_0123456789ab", "old7_0123456789ab", "wp_JOBS", "jobs", "jobs\n", "jobs2", "a-jobs", None]
    df = spark.createDataFrame([(n,) for n in given], "n string")
    assert [r[0] for r in df.select(sqltext.own_name(F.col("n"), ["tmp"], ["jobs"])).collect()] == [True] + [False] * 5 + [True, True] + [False] * 4
    kinds = spark.createDataFrame([(n,) for n in ("wp_posts", "wp_3_posts", "wp_users", "wp_3_users", "x_posts", "wp_3_4_posts", "wp_postsx", None)], "n string")
    assert [r[0] for r in kinds.select(sqltext.table_kind(F.col("n"), "wp_", ["users"], ["posts"])).collect()] == ["posts", "posts", "users", "", "", "", "", ""]


def test_numbered_with_nulls_ties_and_clashes(spark):
    df = spark.createDataFrame([(k, "x") for k in (5, None, 12, 5, 31, None, 25)], "before int, ordinal string")
    out = extract.numbered(df, ["before"], F.floor(F.col("before") / 10))
    assert sorted((r.ordinal, r.before) for r in out.collect()) == [(1, None), (2, None), (3, 5), (4, 5), (5, 12), (6, 25), (7, 31)]
    assert out.columns == ["before", "ordinal"]
    assert extract.numbered(df.limit(0), ["before"], F.lit(0)).count() == 0


def test_boundaries_deletes_and_caps(spark):
    df = spark.createDataFrame([(k, k % 2) for k in range(1, 11)] + [(None, 1)], "k int, odd int")
    assert rows(extract.boundaries(df.where("k is not null"), "k", 4, F.floor(F.col("k") / 3))) == [(1, 4), (2, 8)]
    left = extract.bounded_delete(df, "k", F.col("odd") == 1, 2)
    assert {r.k for r in left.collect()} == {None, 2, 4, 5, 6, 7, 8, 9, 10}
    assert rows(extract.found_up_to(df, "k", 3)) == [(1, True), (2, True), (3, True)]
    assert rows(extract.found_up_to(df.where("k < 3"), "k", 2)) == [(1, False), (2, False)]
    assert extract.found_up_to(df.limit(0), "k", 2).count() == 0


def test_ledger_definitions_and_staged_files(spark):
    held = spark.createDataFrame([("a", 5), ("b", 5), ("c", 1)], "t string, n long")
    ledger = spark.createDataFrame([("a", 8, 2, 1), ("b", 8, None, -4), ("d", 3, 0, 0)], "t string, rows long, removed long, owned long")
    assert rows(verify.count_problems(held, ledger)) == [("b", 5, 8), ("c", 1, -1), ("d", -1, 3)]
    definitions = spark.createDataFrame([("a", ["x", "y"])], "t string, columns array<string>")
    chunks = spark.createDataFrame([("a", 1, ["x", "y"], True), ("a", 2, ["y", "x"], False), ("a", 3, None, True), ("b", 1, None, True)], "t string, c int, columns array<string>, creates boolean")
    assert rows(catalog.definition_problems(definitions, chunks)) == [("a", 2, "columns"), ("a", 3, "created again"), ("b", 1, "undefined")]
    index = spark.createDataFrame([("p", 1, 2), ("q", 1, 2), ("r", 1, 2)], "p string, b long, m long")
    staged = spark.createDataFrame([("p", 1, 3), ("q", None, 2)], "p string, size long, mtime long")
    assert rows(verify.staged_problems(index, staged)) == [("p", "time"), ("q", "size"), ("r", "missing")]


def test_self_copies_of_absent_sources(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    copies = spark.createDataFrame([(9, 2), (10, 7)], "new int, source int")
    assert sorted(map(tuple, carry.self_copies(df, "k", copies).collect()), key=str) == [(1, "a"), (2, None), (9, None)]
