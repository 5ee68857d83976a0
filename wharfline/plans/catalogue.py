"""The registered queries and, where SQL can express them, the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.functions import hashing, masking, paths, replace, sizes, sqltext
from wharfline.operators import carry, catalog, extract, files, graph, jobs, verify
from wharfline.plans import dumps, listings, orders  # register their queries
from wharfline.plans.registry import oracle_sql, queries, query, table
from wharfline.sources import dump, index

__all__ = ["listings", "oracle_sql", "queries"]


# --- sizes -------------------------------------------------------------------


def _estimate_sql(columns: list[str]) -> str:
    return " + ".join(["2", *[f"CASE WHEN {c} IS NULL THEN 5 ELSE (strlen(CAST({c} AS VARCHAR)) * 11 + 9) // 10 + 4 END" for c in columns]])


DOCUMENT_SIZE = _estimate_sql(["doc_id", "text", "lang", "source", "n_chars"])


@query(f"SELECT doc_id, CAST({DOCUMENT_SIZE} AS BIGINT) AS row_bytes FROM documents")
def row_size_estimate(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    return df.select("doc_id", sizes.row_estimate(df).alias("row_bytes"))


@query(f"WITH e AS (SELECT CAST({DOCUMENT_SIZE} AS BIGINT) AS e FROM documents) SELECT count(*) AS rows, CAST(sum(e) AS BIGINT) AS bytes, max(e) AS largest, count(*) FILTER (e > 20000) AS oversize FROM e")
def oversize_count(spark, sf_dir):
    return extract.size_profile(table(spark, sf_dir, "documents"), 20000)


@query(f"SELECT 'exact' AS mode, count(*) FILTER ({_estimate_sql(['nation_key_placeholder'])} > 0) AS n, TRUE AS likely FROM (SELECT n_nationkey AS nation_key_placeholder FROM nation)")
def size_check_exact(spark, sf_dir):
    return extract.size_check(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey", 0)


@query(f"""
WITH b AS (SELECT min(doc_id) AS lo, max(doc_id) AS hi FROM documents),
w AS (SELECT i AS window_no, lo + (hi - lo + 1) * i // 8 AS a, CASE WHEN i = 7 THEN hi + 1 ELSE lo + (hi - lo + 1) * (i + 1) // 8 END AS z FROM b, range(8) AS r(i)),
r AS (SELECT {DOCUMENT_SIZE} AS e, row_number() OVER (PARTITION BY window_no ORDER BY doc_id) AS n FROM documents JOIN w ON doc_id >= a AND doc_id < z)
SELECT 'sampled' AS mode, CAST(NULL AS BIGINT) AS n, count(*) FILTER (e > 20000) > 0 AS likely FROM r WHERE r.n <= 5000""")
def size_check_sampled(spark, sf_dir):
    return extract.size_check(table(spark, sf_dir, "documents"), "doc_id", 20000, exact_rows=10)


@query("""
WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders),
w AS (SELECT i AS window_no, lo + (hi - lo + 1) * i // 8 AS a, CASE WHEN i = 7 THEN hi + 1 ELSE lo + (hi - lo + 1) * (i + 1) // 8 END AS z FROM b, range(8) AS r(i)),
r AS (SELECT o_orderkey, window_no, row_number() OVER (PARTITION BY window_no ORDER BY o_orderkey) AS n FROM orders JOIN w ON o_orderkey >= a AND o_orderkey < z)
SELECT o_orderkey, CAST(window_no AS INTEGER) AS window_no FROM r WHERE n <= 500""")
def size_sample_windows(spark, sf_dir):
    return extract.sample_windows(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", windows=8, rows=500)


@query("""
WITH s AS (SELECT CAST(floor(o_totalprice) AS BIGINT) AS held, count(*) AS n FROM orders GROUP BY 1)
SELECT held, n, CASE WHEN held > 0 THEN greatest(50, least(5000, CAST(floor(1000000.0 * n / held) AS BIGINT))) ELSE 50 END AS next_rows,
  CASE WHEN held < 50000 THEN 'low' WHEN held < 200000 THEN 'medium' ELSE 'high' END AS level FROM s""")
def look_ahead_and_levels(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy(F.floor("o_totalprice").cast("long").alias("held")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("held", "n", sizes.look_ahead(F.col("n"), F.col("held"), 1_000_000).alias("next_rows"), sizes.level(F.col("held"), [(50000, "low"), (200000, "medium")], "high").alias("level"))


# --- bounded extraction ------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey > 1000 AND o_orderkey <= (SELECT max(o_orderkey) FROM orders) ORDER BY o_orderkey LIMIT 500")
def keyset_page(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    bound = extract.snapshot_bound(orders, ["o_orderkey"]).first().asDict()
    return extract.key_page(orders, ["o_orderkey"], after={"o_orderkey": 1000}, bound=bound, limit=500)


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
WHERE (l_orderkey > 100 OR (l_orderkey = 100 AND l_linenumber > 2)) AND (l_orderkey < 5000 OR (l_orderkey = 5000 AND l_linenumber <= 3)) GROUP BY 1, 2""")
def composite_key_range(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    page = lines.where(extract.after_key({"l_orderkey": 100, "l_linenumber": 2}) & extract.up_to_key({"l_orderkey": 5000, "l_linenumber": 3}))
    return page.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey DESC, l_linenumber DESC LIMIT 1")
def snapshot_bound(spark, sf_dir):
    return extract.snapshot_bound(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem) ORDER BY ALL LIMIT 200 OFFSET 1000")
def keyless_page(spark, sf_dir):
    return extract.keyless_page(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), 1000, 200)


@query("SELECT event_id, event_type FROM events WHERE event_type IS NULL OR event_type NOT IN ('click', 'view')")
def null_safe_exclusion(spark, sf_dir):
    return extract.without_values(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", ["click", "view"])


@query("SELECT CAST(event_id // 1000 AS BIGINT) AS range_id, min(event_id) AS first_key, max(event_id) AS last_key, count(*) AS n FROM events GROUP BY 1")
def count_by_ranges(spark, sf_dir):
    return extract.range_counts(table(spark, sf_dir, "events"), "event_id", 1000)


@query("SELECT min(o_orderkey) AS low, max(o_orderkey) AS high, coalesce(max(CASE WHEN o_orderkey < 0 THEN o_orderkey END), 0) AS below FROM orders")
def key_bounds(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"), F.coalesce(F.max(F.when(F.col("o_orderkey") < 0, F.col("o_orderkey"))), F.lit(0)).alias("below"))


def _sections(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.floor(F.col("doc_id") / 500).alias("section"), sizes.row_estimate(docs).alias("b"))


_FOLD_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, CAST(doc_id // 500 AS BIGINT) AS section, CAST({size} AS BIGINT) AS b, row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) AS n FROM documents),
f AS (
  SELECT section, n, doc_id, b, 0::BIGINT AS batch, b AS held FROM d WHERE n = 1
  UNION ALL
  SELECT d.section, d.n, d.doc_id, d.b, f.batch + CASE WHEN {cut} THEN 1 ELSE 0 END, CASE WHEN {cut} THEN d.b ELSE f.held + d.b END FROM f JOIN d ON d.section = f.section AND d.n = f.n + 1
)
SELECT section, batch, min(doc_id) AS first_key, max(doc_id) AS last_key, count(*) AS n, CAST(sum(b) AS BIGINT) AS bytes FROM f GROUP BY section, batch"""


@query(_FOLD_SQL.format(size=DOCUMENT_SIZE, cut="f.held >= 65536"))
def greedy_batches(spark, sf_dir):
    batched = extract.greedy_groups(_sections(spark, sf_dir), ["section"], ["doc_id"], "b", 65536)
    return extract.batch_summary(batched, ["section"], "doc_id", "b")


@query(_FOLD_SQL.format(size=DOCUMENT_SIZE, cut="f.held + d.b > 65536"))
def nextfit_chunks(spark, sf_dir):
    batched = extract.greedy_groups(_sections(spark, sf_dir), ["section"], ["doc_id"], "b", 65536, crossing=False)
    return extract.batch_summary(batched, ["section"], "doc_id", "b")


@query(_FOLD_SQL.format(size=DOCUMENT_SIZE, cut="f.held >= 65536").replace("doc_id // 500", "doc_id * 0"))
def greedy_batches_wide(spark, sf_dir):
    """The whole table is one section."""
    docs = _sections(spark, sf_dir).withColumn("section", F.lit(0).cast("bigint"))
    return extract.batch_summary(extract.greedy_groups_wide(docs, ["section"], ["doc_id"], "b", 65536, block=256), ["section"], "doc_id", "b")


@query(_FOLD_SQL.format(size=DOCUMENT_SIZE, cut="f.held + d.b > 65536").replace("doc_id // 500", "doc_id * 0"))
def nextfit_chunks_wide(spark, sf_dir):
    docs = _sections(spark, sf_dir).withColumn("section", F.lit(0).cast("bigint"))
    return extract.batch_summary(extract.greedy_groups_wide(docs, ["section"], ["doc_id"], "b", 65536, crossing=False, block=256), ["section"], "doc_id", "b")


@query(
    _FOLD_SQL.format(size=DOCUMENT_SIZE, cut="(f.held + d.b > 262144 OR f.k = 20)")
    .replace("b AS held FROM d", "b AS held, 1 AS k FROM d")
    .replace("f.held + d.b END FROM f", "f.held + d.b END, CASE WHEN (f.held + d.b > 262144 OR f.k = 20) THEN 1 ELSE f.k + 1 END FROM f")
)
def plan_batches(spark, sf_dir):
    batched = extract.greedy_groups(_sections(spark, sf_dir), ["section"], ["doc_id"], "b", 262144, rows=20, crossing=False)
    return extract.batch_summary(batched, ["section"], "doc_id", "b")


@query("""WITH RECURSIVE d AS (SELECT c_nationkey AS section, c_custkey, CAST(2 * strlen(c_name) + 11 + CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 2 * strlen(c_name) + 11 END AS BIGINT) AS b, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer),
f AS (
  SELECT section, n, c_custkey, 0::BIGINT AS batch, b AS held FROM d WHERE n = 1
  UNION ALL
  SELECT d.section, d.n, d.c_custkey, f.batch + CASE WHEN f.held + d.b > 499 THEN 1 ELSE 0 END, CASE WHEN f.held + d.b > 499 THEN d.b ELSE f.held + d.b END FROM f JOIN d ON d.section = f.section AND d.n = f.n + 1
)
SELECT section, c_custkey, batch FROM f""")
def rename_batches(spark, sf_dir):
    """Renames of a swap by nation, 512 bytes a statement: a table that was there moves aside and its successor enters, both in one statement."""
    name = F.col("c_name")
    entries = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("section"), "c_custkey", catalog.rename_bytes(name, F.concat(F.lit("a"), name), F.concat(F.lit("b"), name), F.col("c_custkey") % 3 != 0).alias("b"))
    return extract.greedy_groups(entries, ["section"], ["c_custkey"], "b", 512 - catalog.RENAME_HEAD, crossing=False).drop("b")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows, CAST(sum({_estimate_sql(c)}) AS BIGINT) AS bytes, CAST(sum({_estimate_sql(c)}) // count(*) AS BIGINT) AS average FROM {t}" for t, c in (("nation", ["n_nationkey", "n_name", "n_regionkey"]), ("customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]))) + " UNION ALL SELECT 'absent', 0, 0, 0")
def table_statistics(spark, sf_dir):
    held = {"nation": table(spark, sf_dir, "nation"), "customer": table(spark, sf_dir, "customer").drop("c_acctbal")}
    return catalog.statistics(held, ["nation", "customer", "absent"])


@query(f"SELECT doc_id, lang FROM documents WHERE NOT {DOCUMENT_SIZE} > 20000")
def without_oversize(spark, sf_dir):
    return extract.without_oversize(table(spark, sf_dir, "documents"), 20000).select("doc_id", "lang")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 40")
def listing_page(spark, sf_dir):
    return extract.page(table(spark, sf_dir, "events"), [F.desc("ts"), F.desc("event_id")], 3, 20).select("event_id", "event_type")


@query("""WITH l AS (SELECT event_id, props, sum(strlen(props) + 1) OVER (ORDER BY event_id DESC) AS held FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 50))
SELECT event_id, props FROM l WHERE held <= 400""")
def log_tail(spark, sf_dir):
    return extract.tail(table(spark, sf_dir, "events").select("event_id", "props"), "event_id", "props", size=400)


@query("SELECT count(*) > 0 AS found FROM (SELECT 1 FROM orders WHERE o_orderkey = 7 LIMIT 1)")
def row_exists(spark, sf_dir):
    return extract.exists(table(spark, sf_dir, "orders").where("o_orderkey = 7"))


# --- SQL text ----------------------------------------------------------------

_QUOTE = "concat('''', replace(replace(replace(replace({c}, '\\', '\\\\'), '''', '\\'''), chr(10), '\\n'), chr(13), '\\r'), '''')"


@query(f"""SELECT doc_id, concat('(', CAST(doc_id AS VARCHAR), ',', coalesce({_QUOTE.format(c='text')}, 'NULL'), ',', coalesce({_QUOTE.format(c='lang')}, 'NULL'), ')') AS tuple,
CASE WHEN strlen(lang) = 0 THEN '''''' ELSE concat('X''', lower(hex(lang)), '''') END AS hexed FROM documents""")
def sql_literal(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return docs.select("doc_id", sqltext.row_tuple(docs).alias("tuple"), sqltext.hex_literal(F.col("lang").cast("binary")).alias("hexed"))


@query("""SELECT c_custkey, concat('`', replace(c_name, '`', '``'), '`') AS quoted, printf('database/%s.%04d.sql', c_name, CAST(c_custkey % 10000 AS INTEGER)) AS path,
CASE WHEN starts_with(c_name, 'Customer') THEN concat('Client', substr(c_name, 9)) ELSE c_name END AS swapped,
CASE WHEN strlen(c_name) <= 12 THEN c_name ELSE concat(substr(c_name, 1, 4), '_', substr(sha256(c_name), 1, 7)) END AS cut,
concat('wt', c_custkey, '_', substr(sha256(concat(c_custkey, '|', c_name)), 1, 12)) AS temporary FROM customer""")
def generated_names(spark, sf_dir):
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        sqltext.identifier(name).alias("quoted"),
        sqltext.chunk_path(name, (F.col("c_custkey") % 10000).cast("int")).alias("path"),
        sqltext.swapped_prefix(name, "Customer", "Client").alias("swapped"),
        sqltext.bounded_name(name, 12).alias("cut"),
        sqltext.generated_name("wt", F.col("c_custkey"), name).alias("temporary"),
    )


@query("SELECT doc_id, text, lang, n_chars FROM documents")
def dump_round_trip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    return dump.parse_lines(dump.dump_lines(docs, "documents", ["doc_id"], chunks=8), docs.schema)


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'co%' ORDER BY 1")
def like_prefix(spark, sf_dir):
    return table(spark, sf_dir, "part").where(sqltext.starts_like("p_name", "co")).select("p_partkey", "p_name")


# --- joins, aggregations, windows over job logs ------------------------------


@query("""SELECT v AS event_type, coalesce(c, 0) AS n FROM (VALUES ('click'), ('view'), ('error'), ('never'), ('purchase')) t(v)
LEFT JOIN (SELECT event_type, count(*) AS c FROM events GROUP BY 1) e ON v = event_type""")
def status_histogram_filled(spark, sf_dir):
    return jobs.histogram(table(spark, sf_dir, "events"), "event_type", ["click", "view", "error", "never", "purchase"])


@query("SELECT l_linenumber, count(*) FILTER (l_returnflag <> 'A') AS others, count(*) FILTER (l_returnflag = 'A') AS a FROM lineitem GROUP BY 1")
def conditional_sums(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.count_if(F.col("l_returnflag") != "A").alias("others"), F.count_if(F.col("l_returnflag") == "A").alias("a"))


@query("SELECT l_orderkey, count(*) AS n, max(l_linenumber - 1) = count(*) - 1 AS complete FROM lineitem GROUP BY 1")
def completeness(spark, sf_dir):
    return jobs.complete(table(spark, sf_dir, "lineitem").withColumn("seq", F.col("l_linenumber") - 1), "l_orderkey", "seq")


_NOW = "2024-01-30 00:00:00"


@query(f"""WITH e AS (SELECT event_id, ts, epoch(TIMESTAMP '{_NOW}') - floor(epoch(ts)) > CASE event_type WHEN 'click' THEN 604800 WHEN 'error' THEN 1728000 END AS old FROM events WHERE event_type IN ('click', 'error')),
r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS n, count(*) OVER () AS c FROM e WHERE NOT old)
SELECT event_id, 'age' AS reason FROM e WHERE old UNION ALL SELECT event_id, 'cap' FROM r WHERE n <= c - 100""")
def retention_purge(spark, sf_dir):
    return jobs.purge(table(spark, sf_dir, "events"), "event_id", "event_type", "ts", _NOW, {"click": 604800, "error": 1728000}, 100)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_user(spark, sf_dir):
    return jobs.latest(table(spark, sf_dir, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@query("""WITH m AS (SELECT event_id, user_id, md5(concat(event_type, '|', coalesce(CAST(event_id % 2 AS VARCHAR), ''))) AS mark FROM events),
c AS (SELECT *, CASE WHEN lag(mark) OVER (PARTITION BY user_id ORDER BY event_id) = mark THEN 0 ELSE 1 END AS new FROM m),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS spell FROM c)
SELECT event_id, user_id, mark, CAST(row_number() OVER (PARTITION BY user_id, spell ORDER BY event_id) AS INTEGER) AS run FROM s""")
def position_mark_runs(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (F.col("event_id") % 2).cast("string").alias("cursor"))
    return jobs.position_runs(events, "user_id", "event_id", "event_type", "cursor").select("event_id", "user_id", "mark", "run")


@query("""SELECT o_orderkey, CASE WHEN c_nationkey = 3 AND o_orderstatus = 'O' THEN 'held' ELSE o_orderstatus END AS o_orderstatus
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def fenced_update(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    holders = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("string").alias("token"))
    return jobs.fenced_update(orders, holders, "o_custkey", "3", {"o_orderstatus": F.lit("held")}, F.col("o_orderstatus") == "O").drop("o_custkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = 1 AND c_nationkey >= 0)")
def write_if_held(spark, sf_dir):
    holders = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") >= 0, "t").alias("token"))
    return jobs.write_if_held(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), holders, 1, "c_custkey", "t")


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN n IN ('click', 'purchase') WHEN 'click' THEN n IN ('purchase') ELSE FALSE END AS allowed
FROM (SELECT event_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n IS NOT NULL""")
def transitions(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id")).alias("n")).where("n is not null")
    return e.select("event_id", jobs.transition_allowed(F.col("event_type"), F.col("n"), {"view": ["click", "purchase"], "click": ["purchase"]}).alias("allowed"))


@query("""SELECT user_id, CASE WHEN user_id % 5 = 0 THEN NULL WHEN s = 'running' AND 1706572800 - p > 86400 THEN 'stalled' WHEN s = 'paused' AND 1706572800 - p > 604800 THEN 'unanswered' END AS reason,
s = 'queued' OR (s = 'running' AND p + 120 < 1706572800 AND user_id % 4 < 3) AS claimable
FROM (SELECT user_id, CASE user_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'paused' ELSE 'queued' END AS s, CAST(floor(epoch(max(ts))) AS BIGINT) AS p FROM events GROUP BY user_id)""")
def give_up_and_claim(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.unix_timestamp(F.max("ts")).alias("p"))
    s = F.when(F.col("user_id") % 3 == 0, "running").when(F.col("user_id") % 3 == 1, "paused").otherwise("queued")
    now = F.lit(1706572800)
    return last.select("user_id", jobs.give_up(s, F.col("p"), F.col("p"), now, F.col("user_id") % 5 == 0).alias("reason"), jobs.claimable(s, F.col("p") + 120, F.col("user_id") % 4, now).alias("claimable"))


@query("""WITH w AS (SELECT o_orderkey AS id, ['export', 'restore', 'verify', 'estimate'][o_orderkey % 4 + 1] AS type, CASE WHEN o_orderkey % 4 IN (1, 2) THEN concat('b', o_custkey % 500) END AS backup FROM orders),
a AS (SELECT c_custkey AS job_id, CASE WHEN c_custkey % 10 = 3 THEN 'verify' WHEN c_custkey % 10 = 4 THEN 'estimate' WHEN c_custkey = 57 THEN 'export' END AS type, CASE WHEN c_custkey % 10 = 3 THEN concat('b', c_custkey % 500) END AS backup FROM customer),
r(new, old, reason, place) AS (VALUES ('estimate', 'export', 'busy', 1), ('estimate', 'restore', 'busy', 2), ('estimate', 'estimate', 'busy', 3), ('*', 'restore', 'restoring', 4), ('restore', 'export', 'exporting', 5), ('export', 'export', 'exporting', 6)),
f AS (SELECT type, CASE WHEN type = 'verify' THEN backup END AS backup, min(job_id) AS job_id FROM a WHERE type IS NOT NULL GROUP BY ALL),
h AS (
  SELECT w.id, f.job_id, r.reason, r.place FROM w JOIN f ON f.type <> 'verify' JOIN r ON r.new IN (w.type, '*') AND r.old = f.type AND (r.new = 'estimate' OR f.type <> 'estimate')
  UNION ALL SELECT w.id, f.job_id, 'verifying', 9 FROM w JOIN f ON f.type = 'verify' AND f.backup = w.backup
)
SELECT id, type, backup, (SELECT first(reason ORDER BY job_id, place) FROM h WHERE h.id = w.id) AS reason FROM w""")
def job_conflicts(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    backup = F.when((k % 4).isin(1, 2), F.concat(F.lit("b"), (F.col("o_custkey") % 500).cast("string")))
    wanted = table(spark, sf_dir, "orders").select(k.alias("id"), F.get(F.array(*map(F.lit, ("export", "restore", "verify", "estimate"))), (k % 4).cast("int")).alias("type"), backup.alias("backup"))
    kind = F.when(c % 10 == 3, "verify").when(c % 10 == 4, "estimate").when(c == 57, "export")
    active = table(spark, sf_dir, "customer").select(c.alias("job_id"), kind.alias("type"), F.when(c % 10 == 3, F.concat(F.lit("b"), (c % 500).cast("string"))).alias("backup")).where("type is not null")
    return jobs.conflicts(wanted, active)


@query("""SELECT n_nationkey AS id, coalesce(CASE WHEN n_nationkey % 4 = 0 THEN 'move' END, CASE WHEN n_regionkey < 2 THEN 'keep' END, 'ask') AS decision,
CASE WHEN n_nationkey % 4 = 0 THEN 'answer' WHEN n_regionkey < 2 THEN 'policy' ELSE 'question' END AS "by" FROM nation""")
def decision_precedence(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    questions = nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("kind"))
    answers = nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 4 == 0, "move").otherwise("nonsense").alias("choice"))
    policy = table(spark, sf_dir, "region").where("r_regionkey < 2").select(F.col("r_regionkey").alias("kind"), F.lit("keep").alias("choice"))
    return jobs.decisions(questions, answers, policy, ["move", "keep"])


@query("""WITH m AS (SELECT o_orderpriority AS scope, o_orderkey, CAST(o_custkey + 1 AS BIGINT) AS b, CAST(o_orderkey % 90 + 1 AS BIGINT) AS s FROM orders),
l AS (SELECT scope, arg_max(b, o_orderkey) AS b, arg_max(s, o_orderkey) AS s FROM m GROUP BY 1), w AS (SELECT o_orderpriority AS scope, count(*) * 1000 AS bytes FROM orders GROUP BY 1)
SELECT w.scope, bytes, CAST(ceil(CAST(bytes * s AS DOUBLE) / b) AS BIGINT) AS seconds FROM w JOIN l USING (scope)""")
def export_estimate(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    measured = orders.select(F.col("o_orderpriority").alias("scope"), F.col("o_orderkey").alias("at"), (F.col("o_custkey") + 1).alias("bytes"), (F.col("o_orderkey") % 90 + 1).alias("seconds"))
    return jobs.time_estimate(orders.groupBy(F.col("o_orderpriority").alias("scope")).agg((F.count(F.lit(1)) * 1000).alias("bytes")), measured)


@query("""SELECT event_type AS kind, CASE WHEN bool_and(value > 0.05) THEN count(*) FILTER (event_id >= 5000) END AS n FROM events GROUP BY 1""")
def lost_writes(spark, sf_dir):
    entries = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("at"), (F.col("value") > 0.05).alias("readable"))
    return jobs.lost_writes(entries, 5000)


# --- table names -------------------------------------------------------------



def _site_names(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """Names of a database with this site's tables, sub-sites, and for each customer a neighbour: complete, incomplete or nested, with further tables."""
    k = F.col("c_custkey")
    own, inner = F.concat(F.lit("wp_"), k.cast("string"), F.lit("x_")), F.concat(F.lit("wp_"), k.cast("string"), F.lit("x_in_"))
    none = F.array().cast("array<string>")

    def under(prefix, tables):
        return F.array(*[F.concat(prefix, F.lit(t)) for t in tables])

    parts = [
        F.array(F.concat(own, F.lit("extra")), F.concat(F.lit("other_"), k.cast("string")), F.concat(F.lit("wp_"), (k % 50 + 1).cast("string"), F.lit("_posts"))),
        F.when(k % 3 == 0, under(own, (*catalog.MARKERS, "users", "3_options"))).otherwise(none),
        F.when(k % 3 == 1, under(own, catalog.MARKERS[1:])).otherwise(none),
        F.when(k % 6 == 0, under(inner, (*catalog.MARKERS, "custom"))).otherwise(none),
        F.when(k % 50 == 0, under(F.lit("wp_"), (*catalog.MARKERS, "users"))).otherwise(none),
        F.when(k % 25 == 0, F.array(sqltext.generated_name("wt", F.lit(5), own), F.concat(own, F.lit("l" + "o" * 50 + "ng")))).otherwise(none),
    ]
    # A customer is a few bytes in a file and some ten names here, so a split's customers are dealt out before they become names.
    dealt = table(spark, sf_dir, "customer").where(where).select("c_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    return dealt.select(F.explode(F.concat(*parts)).alias("name")).distinct()


def _site_names_sql(where: str = "true") -> str:
    def under(prefix, tables):
        return "[" + ", ".join(f"concat({prefix}, '{t}')" for t in tables) + "]"

    own, inner = "concat('wp_', c_custkey, 'x_')", "concat('wp_', c_custkey, 'x_in_')"
    parts = [
        f"[concat({own}, 'extra'), concat('other_', c_custkey), concat('wp_', c_custkey % 50 + 1, '_posts')]",
        f"CASE WHEN c_custkey % 3 = 0 THEN {under(own, (*catalog.MARKERS, 'users', '3_options'))} WHEN c_custkey % 3 = 1 THEN {under(own, catalog.MARKERS[1:])} ELSE [] END",
        f"CASE WHEN c_custkey % 6 = 0 THEN {under(inner, (*catalog.MARKERS, 'custom'))} ELSE [] END",
        f"CASE WHEN c_custkey % 50 = 0 THEN {under(repr('wp_'), (*catalog.MARKERS, 'users'))} ELSE [] END",
        f"CASE WHEN c_custkey % 25 = 0 THEN [concat('wt5_', substr(sha256(concat('5|', {own})), 1, 12)), concat({own}, 'l', repeat('o', 50), 'ng')] ELSE [] END",
    ]
    return "SELECT DISTINCT unnest(" + " || ".join(parts) + f") AS name FROM customer WHERE {where}"


_CORE = "|".join(catalog.SITE_TABLES)
_ALL = "|".join((*catalog.SITE_TABLES, *catalog.GLOBAL_TABLES))

_FOREIGN_SQL = f"""
names AS ({_site_names_sql()}), o AS (SELECT name FROM names WHERE starts_with(name, 'wp_')),
m(marker) AS (VALUES {", ".join(f"('{m}')" for m in catalog.MARKERS)}),
cand AS (
  SELECT p.candidate FROM (SELECT substr(name, 1, length(name) - 5) AS candidate FROM o WHERE suffix(name, 'posts')) p
  WHERE length(p.candidate) > 3 AND (SELECT count(*) FROM m JOIN o ON o.name = p.candidate || m.marker) = {len(catalog.MARKERS)}
), x AS (
  SELECT name, candidate FROM (
    SELECT o.name, candidate, row_number() OVER (PARTITION BY o.name ORDER BY length(candidate)) AS n FROM o JOIN cand ON starts_with(o.name, candidate)
    WHERE regexp_full_match(substr(o.name, length(candidate) + 1), '({_ALL})|[1-9][0-9]*_({_CORE})')
  ) WHERE n = 1
), k AS (
  SELECT name, candidate FROM (
    SELECT o.name, c.candidate, row_number() OVER (PARTITION BY o.name ORDER BY length(c.candidate)) AS n FROM o JOIN (SELECT DISTINCT candidate FROM x) c ON starts_with(o.name, c.candidate)
    WHERE o.name NOT IN (SELECT name FROM x)
  ) WHERE n = 1
), fates AS (SELECT candidate, name, 'excluded' AS fate FROM x UNION ALL SELECT candidate, name, 'kept' FROM k)"""


@query(f"WITH {_FOREIGN_SQL} SELECT candidate FROM cand")
def relational_division_markers(spark, sf_dir):
    return catalog.complete_prefixes(_site_names(spark, sf_dir).where("name like 'wp!_%' escape '!'"), "name", "wp_")


@query(f"WITH {_FOREIGN_SQL} SELECT name, candidate FROM x")
def shortest_prefix_claim(spark, sf_dir):
    names = _site_names(spark, sf_dir).where("name like 'wp!_%' escape '!'")
    return catalog.claims(names, catalog.complete_prefixes(names, "name", "wp_"), "name")


@query(f"WITH {_FOREIGN_SQL} SELECT * FROM fates")
def foreign_tables(spark, sf_dir):
    return catalog.foreign_tables(_site_names(spark, sf_dir), "name", "wp_", False)


@query(f"""WITH {_FOREIGN_SQL} SELECT name, CASE WHEN starts_with(name, 'wp_') AND name NOT IN (SELECT name FROM fates) THEN 'move' ELSE 'report' END AS fate
FROM names WHERE name NOT IN ({_site_names_sql("c_custkey % 2 = 0")})""")
def table_moves(spark, sf_dir):
    return catalog.table_moves(_site_names(spark, sf_dir), _site_names(spark, sf_dir, "c_custkey % 2 = 0"), "name", "wp_")


@query(f"""WITH {_FOREIGN_SQL}, f AS ({_site_names_sql("c_custkey % 5 < 3")}) SELECT n.name, CASE WHEN n.name = 'wp_users' OR (n.name = 'wp_6x_posts' AND t.fate = 'excluded') THEN 'shared' WHEN t.fate = 'excluded' THEN 'neighbour' WHEN t.fate = 'kept' THEN 'uncertain' END AS verdict
FROM f AS n LEFT JOIN fates AS t USING (name) WHERE n.name = 'wp_users' OR t.fate IS NOT NULL""")
def incoming_judgement(spark, sf_dir):
    return catalog.incoming_judgement(_site_names(spark, sf_dir), _site_names(spark, sf_dir, "c_custkey % 5 < 3"), "name", "wp_", ["wp_posts", "wp_users", "wp_6x_posts"], shared=["wp_users"])


@query(f"""WITH n AS ({_site_names_sql()}), p AS (SELECT name, CASE WHEN starts_with(name, 'wp_1') THEN concat('wpnew_', substr(name, 5)) ELSE name END AS final, concat('wt5_', substr(sha256(concat('5|', name)), 1, 12)) AS temporary FROM n),
r AS (
  SELECT *, CASE WHEN name = 'wp_10x_extra' THEN 'excluded' WHEN regexp_full_match(name, 'wt[0-9]+_[0-9a-f]{{12}}') THEN 'own' WHEN NOT starts_with(name, 'wp_1') THEN 'another prefix' WHEN strlen(final) > 64 THEN 'too long' END AS first FROM p
), c AS (SELECT lower(final) AS final FROM r WHERE first IS NULL GROUP BY 1 HAVING count(*) > 1)
SELECT name, final, temporary, lower(final) IN (SELECT lower(final) FROM p GROUP BY 1 HAVING count(*) > 1) AS clash, CASE WHEN first IS NULL AND lower(final) IN (FROM c) THEN 'clash' ELSE first END AS reason FROM r""")
def restore_plan(spark, sf_dir):
    return catalog.restore_plan(_site_names(spark, sf_dir), "name", "wp_1", "wpnew_", 5, excluded=["wp_10x_extra"])


@query(f"""WITH p AS ({_site_names_sql("c_custkey % 3 = 0")}), s AS (SELECT c_custkey AS k, concat('wp_', c_custkey, 'x_') AS prefix FROM customer)
SELECT prefix, concat(prefix, t) AS missing FROM s, (VALUES ('options'), ('terms')) AS needed(t) WHERE concat(prefix, t) NOT IN (FROM p)""")
def needed_tables(spark, sf_dir):
    sites = table(spark, sf_dir, "customer").select(F.concat(F.lit("wp_"), F.col("c_custkey").cast("string"), F.lit("x_")).alias("prefix"))
    return catalog.missing_tables(_site_names(spark, sf_dir, "c_custkey % 3 = 0"), "name", sites, ["options", "terms"])


@query("""WITH k AS (SELECT concat('wp_', n_nationkey % 7, CASE WHEN n_nationkey % 2 = 0 THEN '_capabilities' ELSE '_level' END) AS key FROM nation)
SELECT DISTINCT substr(key, 1, length(key) - 12) AS neighbour FROM k WHERE suffix(key, 'capabilities') AND substr(key, 1, length(key) - 12) NOT IN ('wp_2_', 'wp_4_')""")
def neighbours_by_keys(spark, sf_dir):
    keys = table(spark, sf_dir, "nation").select(F.concat(F.lit("wp_"), (F.col("n_nationkey") % 7).cast("string"), F.when(F.col("n_nationkey") % 2 == 0, "_capabilities").otherwise("_level")).alias("key"))
    return catalog.neighbours_by_keys(keys, "key", spark.createDataFrame([("wp_2_",), ("wp_4_",)], "prefix string"))


def _plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("n_nationkey")
    plan = table(spark, sf_dir, "nation").select(k.alias("seq"), F.when(k % 4 == 0, "move").otherwise("swap").alias("kind"), F.concat(F.lit("l"), k).alias("live"), F.concat(F.lit("s"), k).alias("stage"), F.concat(F.lit("o"), k).alias("old"), (k % 3 != 0).alias("had_live"))
    there = plan.select(F.explode(F.array(F.when(F.col("seq") % 2 == 0, F.col("live")), F.when(F.col("seq") % 5 < 2, F.col("stage")), F.when(F.col("seq") % 7 < 3, F.col("old")))).alias("name")).where("name is not null")
    return plan, there


_STATES_SQL = """
WITH p AS (SELECT n_nationkey AS seq, CASE WHEN n_nationkey % 4 = 0 THEN 'move' ELSE 'swap' END AS kind, concat('l', n_nationkey) AS live, concat('s', n_nationkey) AS stage, concat('o', n_nationkey) AS old, n_nationkey % 3 <> 0 AS had,
  n_nationkey % 2 = 0 AS l, n_nationkey % 5 < 2 AS s, n_nationkey % 7 < 3 AS o FROM nation)"""


@query(_STATES_SQL + """ SELECT seq, CASE WHEN kind = 'move' THEN CASE WHEN l AND NOT o THEN 'before' WHEN NOT l AND o THEN 'after' ELSE 'neither' END
ELSE CASE WHEN s AND NOT o AND l = had THEN 'before' WHEN NOT s AND l AND o = had THEN 'after' ELSE 'neither' END END AS state FROM p""")
def swap_state(spark, sf_dir):
    return catalog.swap_states(*_plan(spark, sf_dir)).select("seq", "state")


@query("SELECT FALSE AS committed")
def swap_committed(spark, sf_dir):
    return catalog.committed(catalog.swap_states(*_plan(spark, sf_dir)))


@query(_STATES_SQL + """, r AS (SELECT seq, CASE
  WHEN kind = 'move' THEN CASE WHEN NOT o THEN [] WHEN l THEN [[live, 'stray'], [old, live]] ELSE [[old, live]] END
  WHEN NOT s AND l AND had AND NOT o THEN []
  WHEN NOT s AND l THEN CASE WHEN had AND o THEN [[live, stage], [old, live]] ELSE [[live, stage]] END
  WHEN o AND NOT l THEN [[old, live]] WHEN s AND o AND l THEN [[live, 'stray'], [old, live]] ELSE [] END AS x FROM p)
SELECT seq, CAST(i - 1 AS INTEGER) AS step, x[i][1] AS source, x[i][2] AS target FROM r, generate_series(1, 2) AS g(i) WHERE i <= len(x)""")
def rollback_renames(spark, sf_dir):
    return catalog.rollback_renames(catalog.swap_states(*_plan(spark, sf_dir)), F.lit("stray"))


@query("""WITH e AS (SELECT concat('n', n_nationkey) AS child, concat('r', n_regionkey) AS parent FROM nation), i(name) AS (SELECT concat('n', n_nationkey) FROM nation WHERE n_nationkey < 10 UNION SELECT concat('r', r_regionkey) FROM region WHERE r_regionkey < 2)
SELECT child, parent, CASE WHEN child NOT IN (SELECT name FROM i) THEN 'child' ELSE 'parent' END AS side FROM e WHERE (child IN (SELECT name FROM i)) <> (parent IN (SELECT name FROM i))""")
def fk_conflicts(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    edges = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    moved = nation.where("n_nationkey < 10").select(F.concat(F.lit("n"), "n_nationkey").alias("name"))
    return catalog.key_conflicts(edges, moved, region.where("r_regionkey < 2").select(F.concat(F.lit("r"), "r_regionkey").alias("name")))


@query("""WITH c AS (SELECT p_partkey AS k, p_partkey % 5 IN (0, 1) AS known FROM part)
SELECT concat('c', k) AS name, CASE WHEN known THEN concat('c', k) WHEN (SELECT o.known FROM c AS o WHERE o.k = c.k + 1) THEN concat('c', k + 1) WHEN (SELECT o.known FROM c AS o WHERE o.k = c.k + 3) THEN concat('c', k + 3) END AS choice FROM c""")
def collation_choice(spark, sf_dir):
    part = table(spark, sf_dir, "part")

    def name(step: int):
        return F.concat(F.lit("c"), (F.col("p_partkey") + step).cast("string"))

    candidates = part.select(name(0).alias("name"), F.explode(F.array(*[F.struct(name(n).alias("candidate"), F.lit(rank).alias("rank")) for rank, n in ((2, 3), (1, 1))])).alias("c")).select("name", "c.*")
    return catalog.first_known(part.select(name(0).alias("name")), candidates, part.where("p_partkey % 5 in (0, 1)").select(name(0).alias("name")))


# --- keys and rows carried over ----------------------------------------------

_RENAMES = {"ECONOMY": "STANDARD", "STANDARD": "PLAIN"}


@query("""WITH p AS (SELECT p_partkey, split_part(p_type, ' ', 1) AS k FROM part)
SELECT p_partkey, CASE k WHEN 'ECONOMY' THEN 'STANDARD' WHEN 'STANDARD' THEN 'PLAIN' ELSE k END AS k FROM p WHERE k IN ('ECONOMY', 'STANDARD') OR k NOT IN ('STANDARD', 'PLAIN')""")
def key_rename_map(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.substring_index("p_type", " ", 1).alias("k"))
    return carry.rename_keys(part, "k", _RENAMES)[0]


@query("""WITH s AS (SELECT s_suppkey % 40 AS owner, concat('wpx_', s_nationkey % 6) AS k FROM supplier UNION ALL SELECT s_suppkey % 40, concat('wp_', s_nationkey % 6) FROM supplier WHERE s_suppkey % 3 = 0)
SELECT s.owner, k, concat('wp_', substr(k, 5)) AS copy, CASE WHEN (owner, concat('wp_', substr(k, 5))) IN (SELECT (owner, k) FROM s) THEN 'existing' ELSE 'copied' END AS outcome FROM s WHERE starts_with(k, 'wpx_') AND k <> 'wpx_1'""")
def key_copies(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    owner, n = (F.col("s_suppkey") % 40).alias("owner"), F.col("s_nationkey") % 6
    rows = s.select(owner, F.concat(F.lit("wpx_"), n).alias("k")).unionByName(s.where("s_suppkey % 3 = 0").select(owner, F.concat(F.lit("wp_"), n).alias("k")))
    return carry.copy_outcomes(rows, "owner", "k", "wpx_", "wp_", ["wpx_1"])


@query("""SELECT count(*) AS n, array_to_string((SELECT list(p_name ORDER BY p_name) FROM (SELECT DISTINCT p_name FROM part WHERE starts_with(p_name, 'b') ORDER BY p_name LIMIT 5)), ';') AS names FROM part WHERE starts_with(p_name, 'b')""")
def options_under_prefix(spark, sf_dir):
    return carry.named_under(table(spark, sf_dir, "part"), "p_name", "b", 5).select("n", F.array_join("names", ";").alias("names"))


@query("""SELECT c_name, c_nationkey + 100 AS c_nationkey FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_name, c_nationkey FROM customer WHERE c_custkey % 10 <> 0""")
def upsert_carry(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_name", "c_nationkey")
    changed = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select("c_name", (F.col("c_nationkey") + 100).alias("c_nationkey"))
    return carry.upsert(base, changed, ["c_name"])


@query("""SELECT c_name, c_nationkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0 UNION ALL SELECT c_name, c_nationkey + 1 FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 5 <> 0""")
def state_carry(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    restored = c.where("c_custkey % 2 = 0").select("c_name", "c_nationkey")
    live = c.where("c_custkey % 5 <> 0").select("c_name", (F.col("c_nationkey") + 1).alias("c_nationkey"))
    return carry.carry(live, restored, "c_name", c.where("c_custkey % 3 = 0").select("c_name"))


@query("""SELECT s_nationkey, s_suppkey FROM (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) AS n FROM supplier) WHERE n = 1""")
def prune_older(spark, sf_dir):
    return carry.prune_older(table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey"), "s_nationkey", "s_suppkey")


@query("""SELECT 'difference' AS part, k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 5)
UNION ALL SELECT 'common', k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_suppkey < 5)
UNION ALL SELECT 'union', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier WHERE s_suppkey < 5)""")
def name_sets(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    b = table(spark, sf_dir, "supplier").where("s_suppkey < 5").select(F.col("s_nationkey").alias("k"))
    parts = {"difference": carry.names_difference(a, b), "common": carry.names_common(a, b), "union": carry.names_union(a, b)}
    out = [df.select(F.lit(n).alias("part"), "k") for n, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


# --- files -------------------------------------------------------------------


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file inventory made of the pages' addresses: p and b."""
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "/*([?#].*)?$", "")
    deep = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("app/node_modules/x/"), path)).when(F.col("page_id") % 7 == 0, F.concat(F.lit("lib/.git/"), path)).otherwise(path)
    return table(spark, sf_dir, "pages").select("page_id", deep.alias("p"), F.octet_length("html").cast("long").alias("b"))


_PATHS_SQL = """f AS (SELECT page_id, strlen(html) AS b, CASE WHEN page_id % 5 = 0 THEN concat('app/node_modules/x/', path) WHEN page_id % 7 = 0 THEN concat('lib/.git/', path) ELSE path END AS p
FROM (SELECT *, regexp_replace(regexp_replace(url, '^https?://', ''), '/*([?#].*)?$', '') AS path FROM pages))"""


@query(f"""WITH {_PATHS_SQL} SELECT regexp_extract(p, '^(.*?(?:^|/)(?:node_modules|\\.git|\\.svn|\\.hg))/', 1) AS directory, CAST(sum(b) AS BIGINT) AS bytes FROM f
WHERE page_id % 5 = 0 OR page_id % 7 = 0 GROUP BY 1 HAVING sum(b) >= 1000""")
def heavy_dir_rollup(spark, sf_dir):
    return files.heavy_directories(_paths(spark, sf_dir), "p", "b", 1000)


@query(f"""WITH {_PATHS_SQL} SELECT page_id, regexp_matches(p, '^(?:m\\..*/[^/]*|app/node[^/]modules)(?:/.*)?$') AS globbed, p = 'lib' OR starts_with(p, 'lib/') AS under FROM f""")
def glob_exclusion(spark, sf_dir):
    p = F.col("p")
    return _paths(spark, sf_dir).select("page_id", paths.excluded(p, ["m.**/*", "app/node?modules"]).alias("globbed"), paths.under(p, ["lib"]).alias("under"))


@query(f"""WITH {_PATHS_SQL}, x AS (SELECT *, regexp_matches(p, '^(?:lib/[^/]*)(?:/.*)?$') AS out FROM f)
SELECT count(*) FILTER (NOT out) AS files, CAST(coalesce(sum(b) FILTER (NOT out), 0) AS BIGINT) AS bytes, count(*) FILTER (out) AS excluded, 0::BIGINT AS invalid,
count(DISTINCT CASE WHEN NOT out THEN regexp_extract(p, '^(.*)/[^/]*$', 1) END) AS directories FROM x""")
def file_totals(spark, sf_dir):
    return files.totals(_paths(spark, sf_dir).where(paths.problem(F.col("p")).isNull()), "p", "b", ["lib/*"])


@query(f"""WITH {_PATHS_SQL}, v AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN concat('/', p) WHEN 1 THEN concat('C:', p) WHEN 2 THEN concat('a/../', p) WHEN 3 THEN concat('a\\', p) ELSE concat('aux.txt/', p) END AS p, page_id % 6 AS k FROM f)
SELECT page_id, CASE k WHEN 0 THEN 'absolute' WHEN 1 THEN 'drive' WHEN 2 THEN 'segment' WHEN 3 THEN 'backslash' END AS problem, k > 3 AS odd FROM v""")
def path_validity(spark, sf_dir):
    k, p = F.col("page_id") % 6, F.col("p")
    path = F.when(k == 0, F.concat(F.lit("/"), p)).when(k == 1, F.concat(F.lit("C:"), p)).when(k == 2, F.concat(F.lit("a/../"), p)).when(k == 3, F.concat(F.lit("a\\"), p)).otherwise(F.concat(F.lit("aux.txt/"), p))
    return _paths(spark, sf_dir).select("page_id", path.alias("q"), k.alias("k")).select("page_id", paths.problem(F.col("q")).alias("problem"), F.coalesce(paths.unstorable(F.col("q")) == "aux.txt", F.lit(False)).alias("odd"))


@query(f"""WITH {_PATHS_SQL}, c AS (SELECT p FROM f UNION ALL SELECT upper(p) FROM f WHERE page_id % 7 = 0 UNION ALL SELECT regexp_replace(p, '/[^/]*$', '') FROM f WHERE page_id % 11 = 0), k AS (SELECT lower(p) AS k FROM c), x AS (SELECT k, 1 AS f, 0 AS d FROM k UNION ALL
  SELECT array_to_string(list_slice(string_split(k, '/'), 1, i), '/'), 0, 1 FROM (SELECT k, unnest(range(1, len(string_split(k, '/')))) AS i FROM k))
SELECT k AS key, CAST(sum(f) AS BIGINT) AS files, max(d) AS directories FROM x GROUP BY k HAVING sum(f) > 1 OR (sum(f) = 1 AND max(d) = 1)""")
def path_clashes(spark, sf_dir):
    p = _paths(spark, sf_dir)
    upper, above = p.where("page_id % 7 = 0").select(F.upper("p").alias("p")), p.where("page_id % 11 = 0").select(F.regexp_replace("p", "/[^/]*$", "").alias("p"))
    return files.clashes(p.select("p").unionByName(upper).unionByName(above), "p")


@query("""SELECT k AS key, array_to_string(list_sort(list(DISTINCT n)), ';') AS names FROM (SELECT n, lower(n) AS k FROM (SELECT p_name AS n FROM part UNION ALL SELECT upper(p_name) FROM part WHERE p_partkey % 3 = 0)) GROUP BY k HAVING count(DISTINCT n) > 1""")
def name_collisions(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_name").alias("n")).unionByName(part.where("p_partkey % 3 = 0").select(F.upper("p_name").alias("n")))
    return files.collisions(names, "n").select("key", F.array_join("names", ";").alias("names"))


@query("""WITH s AS (SELECT source AS volume, CAST(sum(strlen(text)) AS BIGINT) AS b FROM documents GROUP BY 1), f AS (SELECT source AS volume, count(*) * 2000000 AS free FROM documents GROUP BY 1)
SELECT volume, b + greatest(CAST(ceil(b * 5 / 100) AS BIGINT), 104857600) AS needed, free, free >= b + greatest(CAST(ceil(b * 5 / 100) AS BIGINT), 104857600) AS enough FROM s JOIN f USING (volume)""")
def free_space(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return files.space_needed(docs.select(F.col("source").alias("volume"), F.octet_length("text").cast("long").alias("b")), "volume", "b", docs.groupBy(F.col("source").alias("volume")).agg((F.count(F.lit(1)) * 2000000).alias("free")))


# --- hashes and verification -------------------------------------------------


@query("""WITH c AS (SELECT doc_id, list_transform(range(0, greatest(1, CAST(ceil(length(text) / 1000.0) AS BIGINT))), lambda i: sha256(substr(text, 1 + i * 1000, 1000))) AS h FROM documents)
SELECT doc_id, CASE WHEN len(h) = 1 THEN h[1] ELSE sha256(array_to_string(h, '')) END AS hash, CAST(len(h) AS INTEGER) AS chunks FROM c""")
def chunk_list_hash(spark, sf_dir):
    hashes = F.transform(hashing.text_chunks(F.col("text"), 1000), lambda c: F.sha2(c, 256))
    docs = table(spark, sf_dir, "documents").select("doc_id", hashes.alias("h"))
    return docs.select("doc_id", F.when(F.size("h") == 1, F.col("h")[0]).otherwise(hashing.list_hash(F.col("h"))).alias("hash"), F.size("h").alias("chunks"))


@query("SELECT n_regionkey AS key, sha256(concat(n_regionkey, ';t;', array_to_string(list_sort(list(DISTINCT lower(hex(n_name)))), ','))) AS id FROM nation GROUP BY 1")
def question_ids(spark, sf_dir):
    grouped = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("key")).agg(F.collect_list("n_name").alias("names"))
    return grouped.select("key", hashing.question_id(F.array(F.col("key").cast("string"), F.lit("t")), F.col("names")).alias("id"))


@query("""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(len(b) AS BIGINT) AS bytes, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[CAST((xor(c, x) & 255) + 1 AS INTEGER)])), 4294967295) AS crc FROM b, t
""")
def crc_of_chunks(spark, sf_dir):
    pieces = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(hashing.text_chunks(F.col("text"), 1000)).alias("n", "piece"))
    return hashing.crc_of_chunks(pieces, "doc_id", "n", "piece")


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index with a line for each supplier as a chunk of its nation's table; one in 50 has the wrong path, one in 70 no hash."""
    from pyspark.sql import Window

    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("t"), "s_nationkey").alias("t"), F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("c"))
    path = F.when(F.col("s_suppkey") % 50 == 0, "x").otherwise(sqltext.chunk_path(F.col("t"), F.col("c")))
    return s.select("s_suppkey", "t", "c", path.alias("p"), F.col("s_suppkey").alias("b"), F.when(F.col("s_suppkey") % 70 == 0, "").otherwise(F.sha2(F.col("s_suppkey").cast("string"), 256)).alias("h"))


_INDEX_SQL = """i AS (SELECT s_suppkey, t, c, CASE WHEN s_suppkey % 50 = 0 THEN 'x' ELSE printf('database/%s.%04d.sql', t, c) END AS p, s_suppkey AS b, CASE WHEN s_suppkey % 70 = 0 THEN '' ELSE sha256(CAST(s_suppkey AS VARCHAR)) END AS h
FROM (SELECT s_suppkey, concat('t', s_nationkey) AS t, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INTEGER) AS c FROM supplier))"""


@query(f"WITH {_INDEX_SQL} SELECT t, c, CASE WHEN s_suppkey % 50 = 0 THEN 'path' ELSE 'hash' END AS problem FROM i WHERE s_suppkey % 50 = 0 OR s_suppkey % 70 = 0")
def index_lockstep_check(spark, sf_dir):
    return verify.index_problems(_index(spark, sf_dir))


@query(f"""WITH {_INDEX_SQL}, s AS (SELECT t, count(*) AS n, sum(b) AS size FROM i GROUP BY t)
SELECT t, CASE WHEN t = 't3' THEN 'unexpected' WHEN t = 't5' THEN 'chunks' ELSE 'bytes' END AS problem FROM s WHERE t IN ('t3', 't5', 't7') UNION ALL SELECT 'gone', 'missing'""")
def index_against_summary(spark, sf_dir):
    i = _index(spark, sf_dir)
    summary = i.where("t <> 't3'").groupBy("t").agg((F.count(F.lit(1)) + F.max(F.when(F.col("t") == "t5", 1).otherwise(0))).alias("chunks"), (F.sum("b") + F.max(F.when(F.col("t") == "t7", 1).otherwise(0))).alias("bytes"))
    return verify.index_against_summary(i, summary.unionByName(spark.createDataFrame([("gone", 1, 1)], "t string, chunks long, bytes long")))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS p, CASE WHEN s_suppkey % 11 = 0 THEN 'missing' ELSE 'corrupt' END AS kind FROM supplier WHERE s_suppkey % 11 = 0 OR s_suppkey % 13 = 0 UNION ALL SELECT 'extra', 'unexpected'""")
def verify_entries(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("p"), F.col("s_suppkey").alias("b"), F.md5(F.col("s_name")).alias("h"))
    entries = s.where("b % 11 <> 0").withColumn("h", F.when(F.col("b") % 13 == 0, "bad").otherwise(F.col("h")))
    return verify.entry_problems(s, entries.unionByName(spark.createDataFrame([("extra", 1, "h")], "p string, b long, h string")))


@query("""SELECT n_nationkey AS id, CASE WHEN n_nationkey % 9 = 0 THEN 'invalid' WHEN n_nationkey % 9 = 1 THEN 'unreadable' WHEN n_nationkey % 9 = 2 THEN 'changed' WHEN n_nationkey % 2 = 0 THEN 'failed' WHEN n_nationkey % 5 = 0 THEN 'unsupported_layout'
WHEN n_nationkey % 7 = 0 OR n_nationkey % 3 = 0 THEN 'passed_partial' ELSE 'passed' END AS outcome FROM nation""")
def verification_outcome(spark, sf_dir):
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation")
    flags = n.select(k.alias("id"), (k % 9 == 0).alias("invalid"), (k % 9 == 1).alias("unreadable"), (k % 9 == 2).alias("changed"), (k % 7 == 0).alias("embedded"), (k % 3 != 0).alias("full"))
    findings = n.where("n_nationkey % 2 = 0").select(k.alias("id"), F.lit("corrupt").alias("kind")).unionByName(n.where("n_nationkey % 5 = 0").select(k.alias("id"), F.lit("unsupported").alias("kind")))
    return verify.outcome(findings, flags)


@query(f"""WITH {_INDEX_SQL}, k AS (SELECT * FROM i WHERE h <> '')
SELECT 1 AS version, count(*) AS exported, CAST(count(DISTINCT t) AS INTEGER) AS tables, count(*) AS entries, CAST(sum(b) AS BIGINT) AS bytes, CAST(NULL AS VARCHAR) AS problem FROM k""")
def manifest_round_trip(spark, sf_dir):
    i = _index(spark, sf_dir).where("h <> ''")
    tables = i.groupBy(F.col("t").alias("name")).agg(F.count(F.lit(1)).alias("rows"), F.sum("b").alias("bytes"), F.count(F.lit(1)).alias("chunks"), hashing.list_hash(F.transform(F.sort_array(F.collect_list(F.struct("c", "h"))), lambda x: x["h"])).alias("sha256"))
    read = index.parse_manifest(verify.manifest(tables, i, {"url": "https://old.example"}))
    return read.select("version", F.col("database.exported").alias("exported"), F.size("database.tables").alias("tables"), F.col("files.count").alias("entries"), F.col("files.bytes").alias("bytes"), "problem")


# --- text --------------------------------------------------------------------

_MOVE = replace.move_pairs("https://old.example", "https://new.example", "/var/www/old", "/srv/new")


@query("""SELECT page_id, concat('see ', u, '/a, "', replace(u, '/', '\\/'), '\\/b" and cold.example') AS value, 2 AS replaced
FROM (SELECT page_id, 'https://new.example' AS u FROM pages)""")
def replace_addresses(spark, sf_dir):
    u = F.when(F.col("page_id") % 2 == 0, "https://old.example").otherwise("http://old.example")
    text = F.concat(F.lit("see "), u, F.lit('/a, "'), F.replace(u, F.lit("/"), F.lit("\\/")), F.lit('\\/b" and cold.example'))
    return table(spark, sf_dir, "pages").select("page_id", replace.replaced(text, _MOVE).alias("r")).select("page_id", "r.value", "r.replaced")


@query("""SELECT page_id, concat('a:1:{s:1:"u";s:', 19 + length(CAST(page_id AS VARCHAR)) + 1, ':"https://new.example/', page_id, '";}') AS value, 'serialized' AS kind FROM pages""")
def replace_serialized(spark, sf_dir):
    inner = F.concat(F.lit("http://old.example/"), F.col("page_id").cast("string"))
    text = F.concat(F.lit('a:1:{s:1:"u";s:'), F.length(inner).cast("string"), F.lit(':"'), inner, F.lit('";}'))
    return table(spark, sf_dir, "pages").select("page_id", replace.replaced(text, _MOVE).alias("r")).select("page_id", "r.value", "r.kind")


@query()
def redact_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", masking.redacted(F.col("text"), ["s3cret/val"]).alias("text"))


@query("""SELECT page_id, regexp_replace(url, '^(https?://)[^/?#]+', '\\1[host]') AS masked FROM pages""")
def mask_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", masking.masked_hosts(F.col("url"), {"old.example": "[site]"}).alias("masked"))


@query("""SELECT page_id, CASE WHEN s = '' THEN 'site' ELSE s END AS slug FROM (SELECT page_id, trim(substr(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), '-') AS s FROM pages)""")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", paths.slug(F.col("url")).alias("slug"))


@query("SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '?', 'g') AS text FROM documents")
def scrub_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", masking.scrubbed(F.col("text").cast("binary")).alias("text"))


@query("SELECT page_id, concat('[root]/', page_id, ' and /srv/www2/', page_id) AS masked FROM pages")
def mask_paths(spark, sf_dir):
    text = F.concat(F.lit("/srv/www/"), F.col("page_id").cast("string"), F.lit(" and /srv/www2/"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", masking.masked_paths(text, {"/srv/www": "[root]"}).alias("masked"))


@query(f"""WITH {_INDEX_SQL}, l AS (SELECT substr(md5(p), 1, 3) AS bucket, p, concat(p, chr(9), b, chr(9), CASE WHEN h = '' THEN '-' ELSE h END) AS line, b, h FROM i),
g AS (SELECT bucket, count(*) AS n, sum(b) AS b, bool_and(h <> '') AS hashed, sha256(string_agg(line, chr(10) ORDER BY p, line)) AS hash FROM l GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(b) AS BIGINT) AS bytes, bool_and(hashed) AS hashed, sha256(string_agg(hash, '' ORDER BY bucket)) AS digest FROM g""")
def files_audit(spark, sf_dir):
    return verify.audit(_index(spark, sf_dir).withColumn("h", F.when(F.col("h") != "", F.col("h"))))


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS ordinal, CAST(o_orderkey AS VARCHAR) AS listed FROM orders), b AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS ordinal, CAST(o_orderkey AS VARCHAR) AS found FROM orders WHERE o_orderkey <> 700)
SELECT ordinal, listed, found FROM a FULL JOIN b USING (ordinal) WHERE listed IS DISTINCT FROM found""")
def entries_in_step(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("name"))
    return verify.in_step(orders, orders.where("o_orderkey <> 700"), "o_orderkey", "name", F.floor(F.col("o_orderkey") / 10000))


@query("""WITH c AS (SELECT doc_id, i, sha256(substr(text, 1 + i * 1000, 1000)) AS h FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / 1000.0) AS BIGINT)))) AS i FROM documents))
SELECT CAST(doc_id AS VARCHAR) AS p, CAST(i AS INTEGER) AS n, CASE WHEN i % 3 = 1 THEN 'missing' ELSE 'corrupt' END AS problem FROM c WHERE i % 3 = 1 OR (i % 3 <> 1 AND doc_id % 50 = 7)""")
def chunk_verification(spark, sf_dir):
    hashes = F.transform(hashing.text_chunks(F.col("text"), 1000), lambda c: F.sha2(c, 256))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("p"), hashes.alias("hc"))
    chunks = docs.select("p", F.posexplode("hc").alias("n", "h")).where("n % 3 <> 1").withColumn("h", F.when(F.col("p").cast("long") % 50 == 7, "bad").otherwise(F.col("h")))
    return verify.chunk_problems(chunks, docs)


@query("""SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'same' WHEN n_nationkey % 5 < 3 THEN 'deployment' WHEN n_nationkey % 2 = 0 THEN 'moved' ELSE 'clone' END AS kind FROM nation""")
def copy_kinds(spark, sf_dir):
    k = F.col("n_nationkey")
    previous = F.when(k % 5 < 3, "/srv/releases/1").otherwise("/home/a/site")
    current = F.when(k % 5 == 0, "/srv/releases/1/").when(k % 5 < 3, "/srv/releases/2").otherwise("/home/b/site")
    return table(spark, sf_dir, "nation").select(k.alias("id"), catalog.copy_kind(previous, current, k % 2 == 1).alias("kind"))


@query("""SELECT t, c FROM (SELECT concat('t', s_nationkey) AS t, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INTEGER) AS c FROM supplier)""")
def index_append_replayed(spark, sf_dir):
    i = _index(spark, sf_dir).select("t", "c", "p", "b", "h")
    return index.append_once(i.where("c <= 2"), i, ["t", "c"]).select("t", "c")


@query("SELECT max(doc_id) AS doc_id FROM documents")
def dump_last_key(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    ends = dump.dump_lines(docs, "documents", ["doc_id"], chunks=4).where(F.col("line").startswith("-- end "))
    return ends.agg(F.max(F.from_json(F.expr("substring(line, 8)"), "doc_id long")["doc_id"]).alias("doc_id"))
