from wharfline.operators import carry


def test_carry_back_keeps_the_last_row_of_a_name(spark):
    rows = "id long, name string, v string"
    live = spark.createDataFrame([(1, "a", "x"), (5, "a", "y"), (3, "a", "z"), (2, "b", "x"), (4, "b", "w"), (6, "c", "x")], rows)
    old = spark.createDataFrame([(1, "a", "o"), (2, "b", "o"), (7, "c", "o"), (8, "c", "p")], rows)
    own = spark.createDataFrame([("a",), ("b",)], "name string")
    got = carry.carry_back(live, old, "name", "id", own, ["b"])
    assert sorted(map(tuple, got.collect())) == [(2, "b", "o"), (5, "a", "y"), (7, "c", "o"), (8, "c", "p")]


def test_copied_rows(spark):
    df = spark.createDataFrame([(1, "old_a", "x"), (1, "old_b", "y"), (1, "new_b", "z"), (2, "old_a", "w")], "owner long, name string, v string")
    outcomes = carry.copy_outcomes(df, "owner", "name", "old_", "new_", [])
    made = carry.copied_rows(df, outcomes, "owner", "name").exceptAll(df)
    assert sorted(map(tuple, made.collect())) == [(1, "new_a", "x"), (2, "new_a", "w")]
