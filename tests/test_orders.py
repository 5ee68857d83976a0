import datetime
import random

import pytest
from pyspark.sql import functions as F

from wharfline.operators import extract, graph, review, verify
from wharfline.streaming import jobs


def plan_of(tables, edges):
    """Rounds, circles and what is kept, by walks over the graph."""
    names = set(tables)
    refs = [(c, p) for c, p in edges if p in names and c != p]
    kept = {p for c, p in refs if c not in names}
    while more := {p for c, p in refs if c in kept} - kept:
        kept |= more
    free = names - kept

    def reach(n):
        seen, todo = set(), [n]
        while todo:
            at = todo.pop()
            todo += [p for c, p in refs if c == at and p in free and p not in seen and not seen.add(p)]
        return seen

    to = {n: reach(n) for n in free}
    circle = {n: min({n} | {m for m in to[n] if n in to[m]}) for n in free}
    depth = dict.fromkeys(set(circle.values()), 1)
    for _ in free:
        for c, p in refs:
            if c in free and p in free and circle[c] != circle[p]:
                depth[circle[p]] = max(depth[circle[p]], depth[circle[c]] + 1)
    return sorted((depth[circle[n]], circle[n], n, sum(g == circle[n] for g in circle.values()) > 1) for n in free)


def test_drop_order_of_many_graphs(spark):
    """Twenty random graphs side by side, with circles that touch, loops, repeats and tables outside."""
    rng = random.Random(7)
    tables, edges = [], []
    for g in range(20):
        names = [f"g{g:02}{c}" for c in "abcdefgh"]
        tables += names
        edges += [(rng.choice([*names, f"out{g}"] if g % 3 == 0 else names), rng.choice(names)) for _ in range(rng.choice([3, 8, 14]))]
    got = graph.drop_order(spark.createDataFrame([(t,) for t in [*tables, tables[0], None]], "name string"), spark.createDataFrame([*edges, edges[0], (None, "g00a"), ("g00a", None)], "child string, parent string"))
    assert sorted(map(tuple, got.collect())) == plan_of(tables, edges)


def test_drop_order_takes_several_hops_a_job(spark, monkeypatch):
    """Chains and circles of up to four are settled by few written tables; longer ones, and circles between circles, in any order of names, by more."""
    rng, many = random.Random(11), []
    monkeypatch.setattr(graph, "written", lambda df, kind, real=graph.written: many.append(kind) or real(df, kind))

    def planned(tables, edges):
        many.clear()
        got = graph.drop_order(spark.createDataFrame([(t,) for t in tables], "name string"), spark.createDataFrame(edges, "child string, parent string"))
        assert sorted(map(tuple, got.collect())) == plan_of(tables, edges)
        return len(many)

    tables, edges = [], []
    for g in range(12):
        names = [f"s{g:02}{i}" for i in range(4)]
        tables += names
        edges += list(zip(names, names[1:])) + ([(names[3], names[0])] if g % 3 == 0 else []) + ([(names[1], names[0])] if g % 4 == 1 else []) + ([("live", names[1])] if g % 5 == 0 else [])
    assert planned(tables, edges) <= 16
    names = [f"l{i:02}" for i in range(26)]
    rng.shuffle(names)
    # A chain of 6 to a circle of 9, a chain on to a circle of 6, and a chain after it; a table outside refers to the last two.
    edges = [*zip(names, names[1:]), (names[14], names[6]), (names[22], names[17]), ("live", names[24])]
    assert planned(names, edges) > 16


def test_drop_order_folds_case(spark):
    tables, edges = (spark.createDataFrame(r, s) for r, s in (([("A",), ("b",), ("C",)], "name string"), ([("a", "B"), ("B", "a"), ("b", "c")], "child string, parent string")))
    assert sorted(map(tuple, graph.drop_order(tables, edges, fold=True).collect())) == [(1, "A", "A", True), (1, "A", "b", True), (2, "C", "C", False)]
    assert graph.drop_order(tables.limit(0), edges.limit(0)).count() == 0


def walk(lines, entries):
    """The entries in turn: line of each, then the first that can't be placed."""
    at, out = 0, []
    for n, (name, gap) in enumerate(entries):
        if gap:
            while at < len(lines) and lines[at] != name:
                at += 1
            if at == len(lines):
                return out, (n, "lost")
        elif at >= len(lines) or lines[at] != name:
            return out, (n, "order")
        out.append(at)
        at += 1
    return out, None


def test_resync_is_the_walk(spark):
    rng = random.Random(3)
    lines, entries, fine, stops = [], [], [], []
    for a in range(150):
        own = [rng.choice("abcde") if rng.random() < 0.5 else f"n{i}" for i in range(rng.choice([1, 3, 12, 30]))]
        left, i, gap = [], 0, False
        while i < len(own):
            if rng.random() < 0.25:
                i, gap = i + rng.randrange(1, 5), True
                continue
            left.append((own[i], gap))
            i, gap = i + 1, False
        if a % 5 == 0 and len(left) > 2:
            left[1], left[2] = left[2], left[1]
        if a % 7 == 0:
            left.append(("never", a % 2 == 0))
        name = f"z{a}"
        lines += [(name, i, n) for i, n in enumerate(own)]
        entries += [(name, i, n, g) for i, (n, g) in enumerate(left)]
        placed, stop = walk(own, left)
        fine += [(name, i, line) for i, line in enumerate(placed)]
        stops += [(name, *stop)] if stop else []
    got, why = verify.resynced(spark.createDataFrame(lines, "archive string, line long, name string"), spark.createDataFrame(entries, "archive string, entry long, name string, gap boolean"))
    assert sorted(map(tuple, got.collect())) == sorted(fine) and sorted(map(tuple, why.collect())) == sorted(stops)


def test_phases_stop(spark):
    rows = [("a", "volumes", None), ("a", "contents", True), ("a", "manifest", False), ("b", "indexes", True), ("b", "contents", False), ("b", "index_lines", False), ("b", "volumes", False), ("c", "other", True), ("c", None, True), ("c", "contents", True)]
    got = verify.phased(spark.createDataFrame(rows, "archive string, phase string, stops boolean"))
    assert sorted((r.archive, r.phase) for r in got.collect()) == [("a", "contents"), ("a", "manifest"), ("a", "volumes"), ("b", "indexes"), ("b", "volumes"), ("c", "contents")]


def test_decisions_by_answer_and_policy(spark):
    findings = spark.createDataFrame([("unreadable", "f", 3), ("large_dir", "a", 5), ("large_dir", "b", 9), ("large_dir", "c", 5), ("oversize", "t", 1), ("oversize", "none", 0), ("other", "x", 1), ("oversize", "null", None)], "kind string, subject string, weight long")
    policy = spark.createDataFrame([("unreadable", "fail"), ("large_dirs", "exclude")], "name string, value string")
    answers = spark.createDataFrame([("large_dir_0", "include"), ("large_dir_more", "stop"), ("unreadable", "maybe"), (None, "stop")], "id string, choice string")
    got = review.decided(findings, review.rules(spark), policy, answers, listed=2)
    rows = sorted((r.subject, r.id, r.outcome) for r in got.collect())
    assert rows == [("a", "large_dir_1", "exclude"), ("b", "large_dir_0", "include"), ("c", "large_dir_more", "exclude"), ("f", "unreadable", "stop"), ("t", "oversize_0", "ask")]
    assert review.questions(got).count() == 0
    open_ = review.decided(findings, review.rules(spark), policy.where("name <> 'unreadable'"), answers)
    assert sorted(map(tuple, review.questions(open_).collect())) == [("oversize_0", "oversize", 1), ("unreadable", "unreadable", 1)]


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), i * 3 % 1009, rng.choice([None, 1, 5])) for i in range(600)]
    got = extract.running_sums(spark.createDataFrame(rows, "g string, i long, n long"), ["g"], "i", ["n"], block=7).collect()
    assert len(got) == 600
    for r in got:
        own = [(i, n or 0) for g, i, n in rows if g == r.g]
        assert r.n_before == sum(n for i, n in own if i < r.i) and r.n_total == sum(n for _, n in own)


@pytest.mark.parametrize("crossing", [True, False])
def test_wide_batches_are_the_fold(spark, crossing):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "a", "a", None]), i, rng.choice([0, 0, 1, 7, 30, 95, 100, 101, 950, None])) for i in range(900)] + [("zeros", i, 0) for i in range(60)] + [("one", 0, 5)]
    df = spark.createDataFrame(rows, "s string, k long, n long").repartition(4)
    args = (df, ["s"], ["k"], "n", 100)
    fold, wide = (sorted((repr(r.s), r.k, r.batch) for r in f(*args, rows=20, crossing=crossing, **more).collect()) for f, more in ((extract.greedy_groups, {}), (extract.greedy_groups_wide, {"block": 16})))
    assert fold == wide
    assert extract.greedy_groups_wide(df.limit(0), ["s"], ["k"], "n", 100).count() == 0


def test_silent_lease_is_told(spark, tmp_path):
    """Job 1 falls silent; the stream's time moves on by another job's events, and the lapse is told without any event of job 1."""
    start = datetime.datetime(2024, 1, 1)
    at = lambda s: start + datetime.timedelta(seconds=s)
    files = [[(1, "p", at(0)), (2, "q", at(0)), (None, "x", at(0))], [(2, "q", at(100))], [(2, "q", at(200))], [(2, "q", at(290)), (2, "q", at(300))], [(2, "r", at(700))], [(3, "s", at(1500))], [(3, "s", at(1501))]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("job long, position string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = jobs.lapses(stream).writeStream.outputMode("append").format("memory").queryName("lapses").option("checkpointLocation", str(tmp_path / "c")).start()
    seen = []
    try:
        for i, rows in enumerate(files):
            spark.createDataFrame(rows, "job long, position string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            query.processAllAvailable()
            seen.append(sorted((r.job, r.position, (r.at - start).seconds, r.takeovers) for r in spark.table("lapses").collect()))
    finally:
        query.stop()
    assert seen[1] == [] and (1, "p", 120, 1) in seen[3]
    assert seen[-1] == [(1, "p", 120, 1), (2, "q", 420, 1), (2, "r", 820, 1)]
    log = spark.createDataFrame([r for f in files for r in f], "job long, position string, ts timestamp")
    batch = jobs.lapses_of_log(log, F.lit(at(1501))).collect()
    assert sorted((r.job, r.position, (r.at - start).seconds, r.takeovers) for r in batch) == seen[-1]


def test_first_lines_of_names_that_repeat(spark):
    rng = random.Random(4)
    known = sorted({(rng.choice("ab"), rng.choice("xyz"), rng.randrange(60)) for _ in range(70)})
    runs = [(rng.choice("abc"), i, rng.choice(["x", "y", "z", "w", None]), rng.randrange(70), 99) for i in range(80)]
    found = verify.first_lines(spark.createDataFrame(runs, "archive string, run long, name string, least long, line long"), spark.createDataFrame(known, "archive string, name string, line long"))
    # No join, in which each run would meet every line of its name.
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    want = {r: min((n for a, m, n in known if (a, m) == (archive, name) and n >= least), default=None) for archive, r, name, least, _ in runs}
    assert {r.run: r.line for r in found.collect()} == want
