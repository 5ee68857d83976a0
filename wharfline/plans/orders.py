"""Queries over references between tables, ordered listings, findings and leases, made of the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wharfline.operators import graph, review, verify
from wharfline.plans.registry import query, table
from wharfline.streaming import jobs as stream_jobs


def _references(spark, sf_dir):
    """Tables named by orders, and edges: chains of up to four orders of a customer, some closed to circles, some referred to by a table that stays."""
    by_customer = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    around = [F.lag("o_orderkey", i).over(by_customer).alias(f"before{i}") for i in (1, 2, 3)] + [F.lead("o_orderkey").over(by_customer).alias("after")]
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.row_number().over(by_customer) - 1).alias("place"), *around)
    o = o.withColumn("n", F.col("place") % 4 + 1).withColumn("next", F.when(F.col("n") < 4, F.col("after")))
    o = o.withColumn("head", F.when(F.col("n") == 1, F.col("o_orderkey")).when(F.col("n") == 2, F.col("before1")).when(F.col("n") == 3, F.col("before2")).otherwise(F.col("before3")))
    custkey = F.col("o_custkey")
    name, following, head = (F.concat(F.lit("t"), F.col(c).cast("string")) for c in ("o_orderkey", "next", "head"))
    refers = [
        (F.col("next").isNotNull(), name, following),
        ((custkey % 3 == 0) & F.col("next").isNull() & (F.col("n") > 1), name, head),
        ((custkey % 4 == 1) & (F.col("n") == 2), name, head),
        ((custkey % 5 == 0) & (F.col("place") == 1), F.concat(F.lit("live"), custkey.cast("string")), name),
    ]
    # All references of a row at once, so that orders are read and ordered once.
    found = F.array_compact(F.array(*(F.when(there, F.struct(child.alias("child"), parent.alias("parent"))) for there, child, parent in refers)))
    edges = o.select(F.explode(found).alias("e")).select("e.child", "e.parent")
    return o.select(name.alias("name")), edges


_REFERENCES = """
WITH RECURSIVE o AS (
  SELECT 't' || o_orderkey AS name, o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders
), l AS (
  SELECT *, lead(name) OVER w AS next, first(name) OVER w AS head, row_number() OVER w AS n FROM o WINDOW w AS (PARTITION BY o_custkey, place // 4 ORDER BY o_orderkey)
), e AS (
  SELECT name AS child, next AS parent FROM l WHERE next IS NOT NULL
  UNION SELECT name, head FROM l WHERE o_custkey % 3 = 0 AND next IS NULL AND n > 1
  UNION SELECT name, head FROM l WHERE o_custkey % 4 = 1 AND n = 2
  UNION SELECT 'live' || o_custkey, name FROM l WHERE o_custkey % 5 = 0 AND place = 1
), kept(name) AS (
  SELECT parent FROM e WHERE child LIKE 'live%' UNION SELECT e.parent FROM e JOIN kept ON e.child = kept.name
)
"""


@query(f"""{_REFERENCES}, free AS (SELECT name FROM o WHERE name NOT IN (FROM kept)),
f AS (SELECT child, parent FROM e WHERE child IN (FROM free) AND parent IN (FROM free)),
reach(a, b) AS (SELECT child, parent FROM f UNION SELECT r.a, f.parent FROM reach AS r JOIN f ON f.child = r.b),
g AS (SELECT name, least(name, coalesce((SELECT min(r.b) FROM reach AS r JOIN reach AS s ON s.a = r.b AND s.b = r.a WHERE r.a = free.name), name)) AS first FROM free),
d AS (SELECT DISTINCT c.first AS c, p.first AS p FROM f JOIN g AS c ON c.name = f.child JOIN g AS p ON p.name = f.parent WHERE c.first <> p.first),
depth(first, round) AS (SELECT DISTINCT first, 1 FROM g UNION SELECT d.p, depth.round + 1 FROM depth JOIN d ON d.c = depth.first)
SELECT (SELECT CAST(max(round) AS INTEGER) FROM depth WHERE depth.first = g.first) AS round, first, name, count(*) OVER (PARTITION BY first) > 1 AS together FROM g
""")
def drop_order(spark, sf_dir):
    return graph.drop_order(*_references(spark, sf_dir))


@query(f"""{_REFERENCES} SELECT DISTINCT parent AS name, child AS "by" FROM e WHERE parent IN (FROM kept) AND (child LIKE 'live%' OR child IN (FROM kept))""")
def kept_tables(spark, sf_dir):
    tables, edges = _references(spark, sf_dir)
    return graph.kept_by(graph.kept_tables(tables, edges), tables, edges)


# --- order and phases ----------------------------------------------------------


def _archives(spark, sf_dir):
    """An index and an archive for each hundredth of the customers: a line for each order; volumes of five entries, some lost, some archives with two entries swapped, names that repeat."""
    o = table(spark, sf_dir, "orders").select(F.format_string("a%04d", F.col("o_custkey") % 100).alias("archive"), "o_orderkey", "o_orderpriority")
    by = Window.partitionBy("archive").orderBy("o_orderkey")
    name = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")).otherwise(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")))
    lines = o.select("archive", "o_orderkey", (F.row_number().over(by) - 1).cast("bigint").alias("line"), name.alias("name"))
    number = F.substring("archive", -4, 4).cast("int")
    volume = F.floor(F.col("line") / 5)
    lost = (F.pmod(volume * 7 + number, F.lit(3)) == 0) & (number % 2 == 0)
    there = lines.withColumns({"volume": volume, "lost": lost}).where("not lost")
    # In some archives the second and third entry change places.
    rank = F.row_number().over(Window.partitionBy("archive").orderBy("line"))
    there = there.withColumn("place", rank - 1).withColumn("entry", F.when((number % 7 == 1) & F.col("place").isin(1, 2), 3 - F.col("place")).otherwise(F.col("place")).cast("bigint"))
    before = F.coalesce(F.lag("volume").over(Window.partitionBy("archive").orderBy("entry")), F.lit(-1))
    entries = there.select("archive", "entry", "name", (F.col("volume") > before + 1).alias("gap"))
    return lines.select("archive", "line", "name"), entries


_ARCHIVES = """
WITH RECURSIVE l AS (
  SELECT printf('a%04d', o_custkey % 100) AS archive, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) - 1 AS line, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE 'o' || o_orderkey END AS name, o_custkey % 100 AS number FROM orders
), t AS (
  SELECT *, line // 5 AS volume, row_number() OVER (PARTITION BY archive ORDER BY line) - 1 AS place FROM l WHERE NOT ((line // 5 * 7 + number) % 3 = 0 AND number % 2 = 0)
), m AS (SELECT *, CASE WHEN number % 7 = 1 AND place IN (1, 2) THEN 3 - place ELSE place END AS entry FROM t),
e AS (SELECT archive, entry, name, volume > coalesce(lag(volume) OVER (PARTITION BY archive ORDER BY entry), -1) + 1 AS gap FROM m),
walk(archive, entry, line, problem) AS (
  SELECT archive, CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), CAST(NULL AS VARCHAR) FROM (SELECT DISTINCT archive FROM e)
  UNION ALL
  SELECT e.archive, e.entry, CASE WHEN e.gap THEN (SELECT min(l.line) FROM l WHERE l.archive = e.archive AND l.name = e.name AND l.line > w.line) ELSE w.line + 1 END,
    CASE WHEN e.gap THEN CASE WHEN NOT EXISTS (SELECT 1 FROM l WHERE l.archive = e.archive AND l.name = e.name AND l.line > w.line) THEN 'lost' END
      WHEN NOT EXISTS (SELECT 1 FROM l WHERE l.archive = e.archive AND l.name = e.name AND l.line = w.line + 1) THEN 'order' END
  FROM walk AS w JOIN e ON e.archive = w.archive AND e.entry = w.entry + 1 WHERE w.problem IS NULL
)
"""


@query(f"""{_ARCHIVES}, stop AS (SELECT archive, entry FROM walk WHERE problem IS NOT NULL),
held AS (SELECT archive, line FROM walk WHERE problem IS NULL UNION ALL SELECT archive, count(*) FROM l WHERE archive NOT IN (SELECT archive FROM stop) GROUP BY archive),
g AS (SELECT archive, coalesce(lag(line) OVER (PARTITION BY archive ORDER BY line) + 1, 0) AS first, line FROM held WHERE line >= -1)
SELECT archive, first, line - 1 AS last, line - first AS n FROM g WHERE line > first AND line >= 0
""")
def resync_gaps(spark, sf_dir):
    lines, entries = _archives(spark, sf_dir)
    return verify.missing_lines(lines, *verify.resynced(lines, entries))


_FINDINGS = f"""{_ARCHIVES}, f AS (
  SELECT DISTINCT archive, 'manifest' AS phase, 'newer' AS what, true AS stops FROM l WHERE number % 11 = 0
  UNION ALL SELECT DISTINCT archive, 'volumes', 'lost', false FROM l WHERE (line // 5 * 7 + number) % 3 = 0 AND number % 2 = 0
  UNION ALL SELECT archive, 'indexes', 'lines', count(*) > 20 FROM l GROUP BY archive HAVING count(*) % 5 = 0
  UNION ALL SELECT archive, 'contents', problem, true FROM walk WHERE problem IS NOT NULL
)
"""


@query(f"""{_FINDINGS}, o AS (SELECT *, CASE phase WHEN 'manifest' THEN 1 WHEN 'volumes' THEN 2 WHEN 'indexes' THEN 3 ELSE 6 END AS n FROM f)
SELECT archive, phase, what FROM o WHERE n <= coalesce((SELECT min(n) FROM o AS s WHERE s.archive = o.archive AND s.stops), 9)
""")
def verify_phases(spark, sf_dir):
    lines, entries = _archives(spark, sf_dir)
    number = F.substring("archive", -4, 4).cast("int")
    volumes = lines.select("archive", F.floor(F.col("line") / 5).alias("volume")).distinct()
    sizes = lines.groupBy("archive").agg(F.count(F.lit(1)).alias("n"))
    _, stops = verify.resynced(lines, entries)

    def finding(df, phase, what, stops_):
        return df.select("archive", F.lit(phase).alias("phase"), what.alias("what"), stops_.alias("stops"))

    found = finding(sizes.where(number % 11 == 0), "manifest", F.lit("newer"), F.lit(True))
    lost = volumes.where((F.pmod(F.col("volume") * 7 + number, F.lit(3)) == 0) & (number % 2 == 0)).select("archive").distinct()
    found = found.union(finding(lost, "volumes", F.lit("lost"), F.lit(False))).union(finding(sizes.where("n % 5 = 0"), "indexes", F.lit("lines"), F.col("n") > 20))
    return verify.phased(found.union(finding(stops, "contents", F.col("problem"), F.lit(True)))).select("archive", "phase", "what")


# --- findings and decisions ------------------------------------------------------


def _decisions(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    files = part.where("p_size = 1").agg(F.count(F.lit(1)).alias("weight")).select(F.lit("unreadable").alias("kind"), F.lit("files").alias("subject"), "weight")
    heavy = part.groupBy("p_brand").agg(F.sum((F.col("p_retailprice") * 1000).cast("long")).alias("weight")).select(F.lit("large_dir"), "p_brand", "weight")
    orders = table(spark, sf_dir, "orders").groupBy(F.format_string("a%04d", F.col("o_custkey") % 37).alias("name")).agg(F.count(F.when(F.col("o_totalprice") > 200000, 1)).alias("weight")).select(F.lit("oversize"), "name", "weight")
    policy = table(spark, sf_dir, "region").select(F.when(F.col("r_regionkey") == 0, "unreadable").when(F.col("r_regionkey") == 1, "large_dirs").otherwise(F.concat(F.lit("p"), "r_regionkey")).alias("name"), F.when(F.col("r_regionkey") == 0, "continue").otherwise("ask").alias("value"))
    nation = table(spark, sf_dir, "nation")
    answers = nation.where("n_nationkey < 12").select(F.concat(F.lit("large_dir_"), "n_nationkey").alias("id"), F.when(F.col("n_regionkey") == 0, "stop").when(F.col("n_regionkey") < 3, "exclude").otherwise("include").alias("choice"))
    answers = answers.union(nation.where("n_nationkey = 0").select(F.lit("oversize_more"), F.lit("exclude")))
    return review.decided(files.union(heavy).union(orders), review.rules(spark), policy, answers)


_DECISIONS = """
WITH f(kind, subject, weight) AS (
  SELECT 'unreadable', 'files', count(*) FROM part WHERE p_size = 1
  UNION ALL SELECT 'large_dir', p_brand, CAST(sum(CAST(trunc(p_retailprice * 1000) AS BIGINT)) AS BIGINT) FROM part GROUP BY p_brand
  UNION ALL SELECT 'oversize', printf('a%04d', o_custkey % 37), count_if(o_totalprice > 200000) FROM orders GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY weight DESC, subject) - 1 AS place FROM f WHERE weight > 0),
q AS (SELECT *, CASE WHEN kind = 'unreadable' THEN kind WHEN place < 20 THEN kind || '_' || place ELSE kind || '_more' END AS id FROM r),
d AS (
  SELECT q.*, CASE WHEN kind = 'unreadable' THEN 'continue' WHEN id = 'oversize_more' THEN 'exclude'
    WHEN kind = 'large_dir' THEN (SELECT CASE WHEN n_regionkey = 0 THEN NULL WHEN n_regionkey < 3 THEN 'exclude' ELSE 'include' END FROM nation WHERE n_nationkey < 12 AND n_nationkey = q.place) END AS choice FROM q
)
"""


@query(f"{_DECISIONS} SELECT kind, subject, weight, id, choice, coalesce(choice, 'ask') AS outcome FROM d")
def review_decisions(spark, sf_dir):
    return _decisions(spark, sf_dir)


@query(f"{_DECISIONS} SELECT id, kind, count(*) AS n FROM d WHERE choice IS NULL GROUP BY id, kind")
def review_questions(spark, sf_dir):
    return review.questions(_decisions(spark, sf_dir))


# --- leases -----------------------------------------------------------------------


@query("""
WITH e AS (SELECT user_id AS job, event_type AS position, ts, ts + INTERVAL 6 HOUR AS "at", max(ts) OVER () AS until FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT *, lead(ts) OVER w AS next, lag(position) OVER w IS DISTINCT FROM position AS moved FROM e WINDOW w AS (PARTITION BY job ORDER BY ts, position)),
r AS (SELECT *, sum(moved::INT) OVER (PARTITION BY job ORDER BY ts, position ROWS UNBOUNDED PRECEDING) AS stay FROM s),
l AS (SELECT job, position, "at", row_number() OVER (PARTITION BY job, stay ORDER BY ts, position) AS n FROM r WHERE coalesce(next, until) > "at")
SELECT job, position, "at", CAST(n AS INTEGER) AS takeovers, n >= 3 AS given_up FROM l
""")
def leases_lapsed(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("position"), "ts")
    until = events.agg(F.max("ts").alias("until")).first()["until"]
    return stream_jobs.lapses_of_log(events, F.lit(until), lease_seconds=6 * 3600)
