import random

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wharfline.operators import definitions
from wharfline.sources import foreign

DATA = "/root/testdata/sf0.001"


def sequential(text: bytes):
    """Statements by a plain walk over the bytes: (at, body) up to each semicolon in code."""
    out, at, i = [], 0, 0
    while i < len(text):
        c = text[i : i + 1]
        if c in (b"'", b'"', b"`"):
            i += 1
            while i < len(text) and text[i : i + 1] != c:
                i += 2 if c != b"`" and text[i : i + 1] == b"\\" else 1
            i += 1
        elif c == b"#" or text[i : i + 2] == b"--" and (i + 2 >= len(text) or text[i + 2] <= 0x20):
            while i < len(text) and text[i : i + 1] != b"\n":
                i += 1
        elif text[i : i + 2] == b"/*":
            if text[i + 2 : i + 3] == b"!" or text[i + 2 : i + 4] == b"M!":
                i += 3
            else:
                end = text.find(b"*/", i + 2)
                i = len(text) if end < 0 else end + 2
        else:
            i += 1
            if c == b";":
                out.append((at, text[at:i], True))
                at = i
    if at < len(text):
        out.append((at, text[at:], False))
    return out


def random_dump(rng, n):
    bits = ["'", '"', "`", "\\", ";", "-- ", "--", "-", "#", "\n", "/*", "/*!40101 ", "/*M!", "*/", "*", "/", "ab", " ", "é", "''", "\\'", "(", "1"]
    return "".join(rng.choice(bits) for _ in range(n)).encode()


def test_statements_are_the_sequential_walk(spark, monkeypatch):
    monkeypatch.setattr(foreign, "BLOCK", 3)
    rng = random.Random(5)
    texts = {f"d{i}": random_dump(rng, rng.choice([0, 1, 5, 40, 400])) for i in range(120)} | {"long": b"INSERT '" + b"x;" * 40000 + b"';a;", "open": b"a; 'b;"}
    rows = []
    for dump, text in texts.items():
        at, piece = 0, rng.randrange(10)
        while at < len(text):
            to = at + rng.choice([1, 2, 3, 50, 70000])
            rows.append((dump, piece, text[at:to]))
            at, piece = to, piece + rng.choice([1, 1, 7])
    rows += [(None, 0, b";"), ("null", 0, None)]
    df = spark.createDataFrame(rows, "dump string, piece long, body binary").repartition(5)
    got = sorted((r.dump, r.number, r["at"], bytes(r.body), r.closed) for r in foreign.statements(df).collect())
    want = sorted((d, n, at, body, closed) for d, t in texts.items() for n, (at, body, closed) in enumerate(sequential(t)))
    assert got == want
    assert foreign.statements(df.limit(0)).count() == 0


def test_states_agree_with_steps():
    rng = random.Random(1)
    for n in (1, 2, 3, 17, 300):
        body = random_dump(rng, n)
        for state in range(len(foreign.STATES)):
            before = foreign.states_before(body, state)
            now = state
            for b, s in zip(body, before):
                assert s == now
                now = foreign._STEP[b, now]
            assert foreign.step_of(body)[state] == now


def test_long_statements_are_refused_unread(spark, monkeypatch):
    monkeypatch.setattr(foreign, "STATEMENT_BYTES", 50)
    df = spark.createDataFrame([("d", 0, b"INSERT INTO `t` (`a`) VALUES ('" + b"x" * 30), ("d", 1, b"x" * 30 + b"');DROP TABLE IF EXISTS `t`;")], "dump string, piece long, body binary")
    got = foreign.read(foreign.statements(df)).orderBy("number").collect()
    assert [(r.kind, r.reason, r.bytes) for r in got] == [("refused", "too long to be read", 94), ("drop", None, 25)]


def judge(spark, *texts):
    df = spark.createDataFrame([("d", i, t.encode()) for i, t in enumerate(texts)], "dump string, piece long, body binary")
    return foreign.in_context(foreign.read(foreign.statements(df))).orderBy("number").collect()


def test_statements_in_context(spark):
    ok = [("set", None), ("set", None), ("drop", None), ("create", None), ("insert", None), ("insert", None)]
    head = ["/*!40101 SET NAMES utf8mb4 */;\n", "/*!40014 SET FOREIGN_KEY_CHECKS=0 */;\n", "-- x\nDROP TABLE IF EXISTS `t`;\n", "CREATE TABLE `t` (`a` int, `b;` text);\n"]
    rows = ["INSERT INTO `t` (`a`, `b;`) VALUES (1,'it''s; \\'fine\\''),\n(NULL, X'00fF');\n", "INSERT INTO `t` (`a`,`b;`) VALUES (-1.5e3,'');\n-- end\n"]
    got = judge(spark, *head, *rows)
    assert [(r.kind, r.reason) for r in got] == ok and [r.n_rows for r in got[-2:]] == [2, 1]
    assert [[None if v is None else bytes(v) for v in row] for row in got[4].rows] == [[b"1", b"it's; 'fine'"], [None, b"\x00\xff"]]
    bad = [
        ("/*!40101 SET NAMES utf8mb4 */;", "a session line after other statements"), ("DROP TABLE IF EXISTS `t`;", "drops the table more than once"), ("INSERT INTO `u` (`a`) VALUES (1);", "another table"),
        ("INSERT INTO `t` (`b;`,`a`) VALUES (1,2);", "other columns than the first rows have"), ("INSERT INTO `t` (`a`, `b;`) VALUES (1);", "a row of 1 values for 2 columns"), ("INSERT INTO `t` (`a`, `b;`) VALUES (1,now());", "something other than literal values"),
        ("INSERT INTO `t` (`a`, `b;`) VALUES (1,2) ON DUPLICATE KEY UPDATE a=1;", "something after its rows"), ("INSERT INTO `t` (`a`, `b;`) VALUES (1.,2);", "something other than literal values"), ("INSERT INTO `t` VALUES (1);", "no INSERT with a quoted name and a list of quoted columns"),
        ("DROP TABLE IF EXISTS `t`, `u`;", "drops something other than one table if it exists"), ("UPDATE x SET y=1;", "a kind that is not read: UPDATE"), ("/*!50003 CREATE TRIGGER x */;", "a versioned comment that is no session line"), ("INSERT INTO `t` (`a`, `b;`) VALUES (1,'x", "ends inside a statement"),
    ]
    got = judge(spark, *head, *rows, *[t for t, _ in bad])
    assert [(r.kind, r.reason) for r in got] == ok + [("refused", why) for _, why in bad]
    assert foreign.read(foreign.statements(spark.createDataFrame([], "dump string, piece long, body binary"))).count() == 0


def test_files_are_read_by_parts(spark, tmp_path):
    text = "".join(f"INSERT INTO `t` (`a`,`b`) VALUES ({i},'line {i};\nsecond ''line''');\n" for i in range(3000))
    (tmp_path / "x.sql").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = foreign.read(foreign.statements(foreign.read_pieces(spark, f"{tmp_path}/x.sql")))
        rows = foreign.inserted(found, T.StructType().add("a", "long").add("b", "string").add("c", "string")).orderBy("a").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [tuple(r) for r in rows] == [(i, f"line {i};\nsecond 'line'", None) for i in range(3000)]


def facts(spark, *texts):
    df = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "n int, body binary")
    return definitions.facts(foreign.tokens(df), ["n"]).orderBy("n").collect()


def test_definitions_that_are_refused(spark):
    cases = [
        ("CREATE TABLE `t` (`a` int) ENGINE=ARCHIVE;", "the engine ARCHIVE"), ("CREATE TABLE `t` (`a` int) UNION=(`x`);", "the option UNION"), ("CREATE TABLE `t` (`a` int, `a` int);", "a column defined twice"), ("CREATE TABLE `t` (KEY `x` (`y`));", "no columns"),
        ("CREATE TABLE `t` (`a` int, FOREIGN KEY (`a`) REFERENCES `x` (`y`));", "a foreign key without a name"), ("CREATE TABLE `t` (`a` int, CONSTRAINT `c` FOREIGN KEY (`a`) REFERENCES `d`.`x` (`y`));", "a foreign key to another database"),
        ("CREATE TABLE `t` (`a` int, CONSTRAINT `c` FOREIGN KEY (`a`) REFERENCES `x` (`y`,`z`));", "a foreign key whose columns don't match"), ("CREATE TABLE `t` (`a` int, PRIMARY KEY (`a`), PRIMARY KEY (`a`));", "two primary keys"), ("CREATE TABLE `t` (`a` int COLLATE, `b` int);", "COLLATE without a name"),
        ("CREATE TABLE `t` (`a` int;", "the list isn't closed"), ("CREATE TABLE `t` (`a` int, PERIOD FOR x);", "an item of another kind"), ("CREATE TABLE `t` (`a` int) AUTO_INCREMENT=x;", "AUTO_INCREMENT without a number"), ("CREATE TABLE `t` (`a` int, CONSTRAINT `p` PRIMARY KEY (`a`), CONSTRAINT UNIQUE (`a`), CHECK (`a` > 0));", None),
    ]
    got = facts(spark, *[t for t, _ in cases], "DROP TABLE `t`;")
    assert [(r.n, r.reason) for r in got] == [(i, why) for i, (_, why) in enumerate(cases)]


def test_names_of_constraints_fit(spark):
    names = ["t_ibfk_1", "t_ibfk_01", "t_ibfk_1x", "é" * 31, "é" * 32, "x" * 64, "x" * 57, "y", ""]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, i int")
    new = definitions.constraint_name(F.col("name"), "ibfk", F.lit("t"), F.lit("tmp9"), F.lit("final"), "mk_", F.lit(71))
    got = [r.new for r in df.select("i", new.alias("new")).orderBy("i").collect()]
    assert got[0] == "tmp9_ibfk_1" and got[1] == "mk_1z_t_ibfk_01" and got[2] == "mk_1z_t_ibfk_1x" and got[7:] == ["mk_1z_y", "mk_1z_"]
    assert all(len(g.encode()) <= 64 for g in got) and len(set(got)) == len(got)
    assert got[4].startswith("mk_1z_" + "é" * 25 + "_") and got[6] == "mk_1z_" + "x" * 57


def test_edits_keep_every_other_byte(spark):
    text = "CREATE TABLE `t` (`a` int /* `t` */ COMMENT 'é `t`', CONSTRAINT `c` FOREIGN KEY (`a`) REFERENCES `u` (`v`), CHECK (`a` <> 't')) COLLATE='x_ci';"
    df = spark.createDataFrame([(1, text.encode())], "n int, body binary")
    known = definitions.facts(foreign.tokens(df), ["n"]).join(df, "n").withColumns({"temporary": F.lit("te`mp"), "final": F.lit("f"), "number": F.lit(0)})
    got = definitions.rewritten(known, mark="m_", collations={"x_ci": "y_ci"}).collect()[0]
    assert got.sql == text[:-1].replace("TABLE `t`", "TABLE `te``mp`").replace("`c`", "`m_0_c`").replace("'x_ci'", "y_ci")
    assert [tuple(c) for c in got.constraints] == [("foreign", "c", "m_0_c")]


def test_facts_need_no_shuffle_and_no_unique_keys(spark):
    text = "CREATE TABLE `t` (`a` int COLLATE x_ci, CONSTRAINT `c` FOREIGN KEY (`a`) REFERENCES `u` (`v`)) ENGINE=InnoDB COLLATE y_ci;"
    df = spark.createDataFrame([(1, text.encode()), (1, text.encode()), (2, None), (3, b"")], "n int, body binary")
    found = definitions.facts(foreign.tokens(df), ["n", "body"])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    assert [(r.n, bytes(r.body), r.table, r.columns, r.engine, [tuple(c) for c in r.collations]) for r in got] == [(1, text.encode(), "t", ["a"], "InnoDB", [("x_ci", "column:a"), ("y_ci", "table")])] * 2
    assert [tuple(p)[:2] for p in got[0].places] == [("table", "t"), ("collation", "x_ci"), ("foreign", "c"), ("references", "u"), ("collation", "y_ci")]


def test_tokens_after_versioned_comments_and_blanks():
    assert foreign.tokens_of(b" a /*!9 b*/*/ /**/;  ") == [("word", 1, 2, b"a"), ("vopen", 3, 7, b"/*!9"), ("word", 8, 9, b"b"), ("vclose", 9, 11, b"*/"), ("p", 11, 12, b"*"), ("p", 12, 13, b"/"), ("comment", 14, 18, b"/**/"), ("end", 18, 19, b";")]
    assert foreign.tokens_of(b" " * 200000) == []


def test_slices_hold_few_bytes():
    bodies = [b"x" * n for n in (10, 900, 900, 0, 5000, 10)] + [None]
    batch = pa.record_batch([pa.array(range(7)), pa.array(bodies, pa.binary())], ["n", "body"])
    got = list(foreign.in_slices(iter([batch, batch.slice(0, 0)]), "body", 1000))
    assert [n for b in got for n in b.column(0).to_pylist()] == list(range(7)) and len(got) > 3
    assert all(sum(len(x or b"") for x in b.column(1).to_pylist()[1:]) <= 1000 for b in got)


def test_few_bytes_change_a_state():
    text = np.frombuffer(b"plain prose with a quote ' and more of it; after it" * 9, np.uint8)
    assert foreign._kept(text).sum() == 19


def test_statements_of_many_small_pieces(spark):
    # Statements of pieces of seven bytes.
    text = b"".join(b"INSERT INTO `t` (`a`) VALUES (%d);" % i for i in range(300))
    df = spark.createDataFrame([("d", i, text[i * 7 : i * 7 + 7]) for i in range(len(text) // 7 + 1) if text[i * 7 : i * 7 + 7]], "dump string, piece long, body binary")
    got = foreign.statements(df).orderBy("number").collect()
    assert b"".join(bytes(r.body) for r in got) == text and len(got) == 300


def test_lexed_bodies_have_the_sequential_tokens():
    rng = random.Random(3)
    bodies = [random_dump(rng, rng.choice([0, 1, 3, 8, 30, 200])) for _ in range(1500)] + [None, b"/*!9 a*//*!9 b;*/", b"/*!9 a /*!9 b*/", b"*/ /**/ /*/ */", b"`a``b` ``", b"x/*"]
    row, kind, start, end, value = foreign.lexed(bodies)
    got = [[] for _ in bodies]
    for r, *t in zip(row.tolist(), [foreign.KINDS[k] for k in kind.tolist()], start.tolist(), end.tolist(), value.to_pylist()):
        got[r].append(tuple(t))
    assert got == [foreign.tokens_of(b) if b else [] for b in bodies]


def test_facts_from_bodies_are_those_from_tokens(spark):
    texts = ["CREATE TABLE `t` (`a` int COLLATE 'x''y', PRIMARY KEY (`a`), CONSTRAINT `c` FOREIGN KEY (`a`) REFERENCES `u` (`v`)) ENGINE=InnoDB /*!9 COLLATE=z */;", "DROP TABLE `t`;", "CREATE TABLE `u` (`a``b` int, , CHECK (`a` > 0)) UNION=(`x`);", "", None]
    df = spark.createDataFrame([(i, None if t is None else t.encode()) for i, t in enumerate(texts)], "n int, body binary")
    got = definitions.facts(df, ["n"]).orderBy("n").collect()
    assert got == definitions.facts(foreign.tokens(df), ["n"]).orderBy("n").collect()
    assert [(r.n, r.table, r.columns, r.reason, [tuple(c) for c in r.collations]) for r in got] == [(0, "t", ["a"], None, [("x'y", "column:a"), ("z", "table")]), (2, "u", ["a`b"], "the option UNION", [])]
    assert definitions.facts(df, ["n"], ["reason", "table"]).columns == ["n", "reason", "table"]


def test_words_that_are_not_there_refuse_a_definition(spark):
    texts = ["CREATE 'x' `t` (`a` int);", "CREATE TABLE `t` (`a` int, PRIMARY (`a`));", "CREATE TABLE `t` (`a` int, CONSTRAINT `c` FOREIGN (`a`) REFERENCES `u` (`v`));"]
    assert [r.reason for r in facts(spark, *texts)] == ["no CREATE TABLE with a quoted name and a list", "a primary key without columns", "a foreign key without a table"]


def test_orders_are_dealt_out_before_they_become_definitions(spark):
    from wharfline.plans import dumps

    # One file with one row group, which is one task.
    for made in (dumps.ddl_facts, dumps.ddl_rename):
        assert made(spark, DATA).rdd.getNumPartitions() == 4


def test_tokens_of_all_documents(spark, tmp_path, monkeypatch):
    from wharfline.plans import dumps, registry

    # Most statements are longer than those that are read, and two documents have no id.
    monkeypatch.setattr(foreign, "STATEMENT_BYTES", 200)
    rows = [(1, "a;b' " * 900, "en", "x"), (7, None, None, "x"), (19, "c", "de", None), (34, "d\\" * 150, None, "x"), (None, "e" * 4000, "en", "x"), (None, "e" * 4000, "en", "x"), (None, None, None, None), (38, "", "fr", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.connect()
    want.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in dumps.dump_tokens(spark, str(tmp_path)).select("dump", "kind", "n").collect())
    assert got == sorted(want.sql(registry.oracle_sql()["dump_tokens"]).fetchall())
    assert {n for dump, kind, n in got if (dump, kind) == ("x", "end")} == {8} and {n for dump, kind, n in got if (dump, kind) == ("none", "end")} == {3}
