"""Queries over listings, ledgers, definitions and times: what is there against what should be."""

from __future__ import annotations

from pyspark.sql import functions as F

from wharfline.functions import clock, hashing, paths, sqltext
from wharfline.operators import carry, catalog, extract, files, jobs, verify
from wharfline.plans.registry import query, table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_TABLE_LIST = ", ".join(f"'{t}'" for t in TABLES)


def _described(spark, sf_dir):
    return catalog.described({t: table(spark, sf_dir, t) for t in TABLES})


# --- tables and columns ------------------------------------------------------


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey > 1000 AND o_orderstatus = 'O' GROUP BY 1")
def parameterized(spark, sf_dir):
    return spark.sql("SELECT o_orderpriority, count(*) AS n FROM {orders} WHERE o_orderkey > :after AND o_orderstatus = :status GROUP BY 1", args={"after": 1000, "status": "O"}, orders=table(spark, sf_dir, "orders"))


@query(f"SELECT table_name AS t, CAST(ordinal_position AS INTEGER) AS position, column_name AS name FROM information_schema.columns WHERE table_name IN ({_TABLE_LIST})")
def table_description(spark, sf_dir):
    return _described(spark, sf_dir)


@query("SELECT table_name AS name FROM information_schema.tables WHERE table_name IN ('customer', 'conversations')")
def tables_under_prefix(spark, sf_dir):
    for t in TABLES:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return catalog.listed(spark, "c")


@query(f"""WITH t(t) AS (SELECT unnest([{_TABLE_LIST}])), e AS (SELECT t, name FROM t, (VALUES ('doc_id'), ('text'), ('n_name')) e(name))
SELECT t, name FROM e WHERE NOT EXISTS (SELECT 1 FROM information_schema.columns c WHERE c.table_name = e.t AND lower(c.column_name) = lower(e.name))""")
def missing_columns(spark, sf_dir):
    expected = spark.createDataFrame([(t, c) for t in TABLES for c in ("doc_id", "text", "n_name")], "t string, name string")
    return catalog.missing_columns(_described(spark, sf_dir), expected)


@query(f"""WITH d AS (SELECT table_name AS t, ordinal_position AS position, column_name AS name, regexp_extract(column_name, '_([a-z]+)key$', 1) AS stem FROM information_schema.columns WHERE table_name IN ({_TABLE_LIST}))
SELECT c.t AS child, c.name AS "column", p.t AS parent FROM d c JOIN d p ON c.stem = p.stem AND p.position = 1 AND starts_with(p.t, p.stem) WHERE c.stem <> '' AND c.t <> p.t""")
def reference_edges(spark, sf_dir):
    return catalog.reference_edges(_described(spark, sf_dir))


@query("""SELECT c_name AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'excluded' WHEN c_acctbal < 0 THEN 'damaged' WHEN c_nationkey = 3 THEN 'view' ELSE 'planned' END AS fate FROM customer""")
def planned_tables(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = F.col("c_name").alias("name")
    skipped = c.where("c_acctbal < 0 OR c_nationkey = 3").select(name, F.when(F.col("c_acctbal") < 0, "damaged").otherwise("view").alias("reason"))
    return catalog.planned(c.select(name), c.where("c_mktsegment = 'BUILDING'").select(name), skipped)


@query("""WITH d AS (SELECT DISTINCT c_nationkey AS t, ['id', 'name', concat('c', c_nationkey)] AS want FROM customer WHERE c_nationkey % 6 <> 5),
k AS (SELECT s_nationkey AS t, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS c, CASE s_suppkey % 4 WHEN 0 THEN ['id', 'name'] WHEN 1 THEN NULL ELSE ['id', 'name', concat('c', s_nationkey)] END AS cols, s_suppkey % 7 = 0 AS odd FROM supplier)
SELECT t, c, CASE WHEN want IS NULL THEN 'undefined' WHEN c = 1 AND odd THEN 'not created' WHEN c > 1 AND odd THEN 'created again' WHEN cols <> want THEN 'columns' END AS problem
FROM k LEFT JOIN d USING (t) WHERE want IS NULL OR odd OR cols <> want""")
def definition_problems(spark, sf_dir):
    from pyspark.sql import Window

    def columns(nation):
        return F.array(F.lit("id"), F.lit("name"), F.concat(F.lit("c"), F.col(nation).cast("string")))

    definitions = table(spark, sf_dir, "customer").where("c_nationkey % 6 <> 5").select(F.col("c_nationkey").alias("t"), columns("c_nationkey").alias("columns")).distinct()
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).cast("long").alias("c"))
    named = F.when(F.col("s_suppkey") % 4 == 0, F.array(F.lit("id"), F.lit("name"))).when(F.col("s_suppkey") % 4 != 1, columns("s_nationkey"))
    creates = (F.col("c") == 1) != (F.col("s_suppkey") % 7 == 0)
    return catalog.definition_problems(definitions, s.select(F.col("s_nationkey").alias("t"), "c", named.alias("columns"), creates.alias("creates")))


@query("""WITH n AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN concat('tmp', p_partkey % 50, '_', substr(sha256(concat(p_partkey % 50, '|', p_name)), 1, 12)) WHEN 1 THEN 'wp_Wharf_Jobs'
  WHEN 2 THEN concat('wp_', p_partkey % 9, '_posts') WHEN 3 THEN 'wp_users' WHEN 4 THEN concat('tmp0_', p_partkey, '_users') ELSE concat('other_', p_partkey) END AS name FROM part)
SELECT p_partkey, p_partkey % 6 IN (0, 1) AS own, CASE p_partkey % 6 WHEN 2 THEN 'posts' WHEN 3 THEN 'users' ELSE '' END AS kind FROM n""")
def own_and_counted_tables(spark, sf_dir):
    k, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    generated = sqltext.generated_name("tmp", k % 50, F.col("p_name"))
    name = (
        F.when(k % 6 == 0, generated)
        .when(k % 6 == 1, "wp_Wharf_Jobs")
        .when(k % 6 == 2, F.concat(F.lit("wp_"), (k % 9).cast("string"), F.lit("_posts")))
        .when(k % 6 == 3, "wp_users")
        .when(k % 6 == 4, F.concat(F.lit("tmp0_"), text, F.lit("_users")))
        .otherwise(F.concat(F.lit("other_"), text))
    )
    return table(spark, sf_dir, "part").withColumn("name", name).select("p_partkey", sqltext.own_name(F.col("name"), ["tmp", "old"], ["wharf_jobs"]).alias("own"), sqltext.table_kind(F.col("name"), "wp_", ["users"], ["posts"]).alias("kind"))


@query("""SELECT CASE WHEN p_partkey % 10 = 0 THEN 'pages/*' WHEN p_partkey % 10 < 4 THEN concat(p_partkey % 10, '/cache') ELSE p_brand END AS glob FROM part UNION SELECT p_brand FROM part WHERE p_brand <> ''""")
def merged_globs(spark, sf_dir):
    k = F.col("p_partkey")
    own = F.when(k % 10 == 0, "/pages/* ").when(k % 10 < 4, F.concat(F.lit("/"), (k % 10).cast("string"), F.lit("/cache/"))).otherwise(F.concat(F.lit(" "), "p_brand", F.lit("\t")))
    part = table(spark, sf_dir, "part")
    return paths.merged_globs(part.select(F.col("p_brand").alias("glob")), part.select(own.alias("glob")).union(part.select(F.lit(" / ").alias("glob"))), "glob")


# --- ranges and listings -----------------------------------------------------


@query("SELECT CAST(n // 500 AS BIGINT) AS range_no, o_orderkey AS upper FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) WHERE n % 500 = 0")
def range_boundaries(spark, sf_dir):
    return extract.boundaries(table(spark, sf_dir, "orders"), "o_orderkey", 500, F.floor(F.col("o_orderkey") / 10000))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 500)")
def bounded_delete(spark, sf_dir):
    return extract.bounded_delete(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", F.col("o_orderstatus") == "F", 500)


@query("SELECT user_id, (SELECT count(DISTINCT user_id) FROM events WHERE event_type = 'error') > 20 AS over FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' ORDER BY 1 LIMIT 20)")
def found_up_to_cap(spark, sf_dir):
    return extract.found_up_to(table(spark, sf_dir, "events").where("event_type = 'error'"), "user_id", 20)


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error')")
def exact_values(spark, sf_dir):
    return extract.with_values(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", ["click", "error", "CLICK"])


@query("SELECT * FROM (VALUES ('none', 'one', 'many')) t(a, b, c)")
def probes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    low = orders.agg(F.min(key).alias("k"))
    a, b, c = (extract.probe(df).select(F.col("found").alias(n)) for n, df in (("a", orders.where(key < 0)), ("b", orders.join(F.broadcast(low), key == F.col("k"))), ("c", orders)))
    return a.join(b).join(c)


@query("""WITH p AS (SELECT string_split(regexp_replace(url, '^https?://', ''), '/') AS a FROM pages)
SELECT directory, count(*) AS files FROM (SELECT unnest(list_transform(range(1, len(a)), lambda i: array_to_string(a[1:i], '/'))) AS directory FROM p) GROUP BY 1""")
def directories_once(spark, sf_dir):
    return files.directories(table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("p")), "p")


@query("SELECT page_id, url FROM pages ORDER BY encode(url), page_id LIMIT 40")
def byte_order_page(spark, sf_dir):
    return files.byte_order(table(spark, sf_dir, "pages").select("page_id", "url"), "url").orderBy(F.col("url").cast("binary"), "page_id").limit(40)


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders UNION ALL SELECT 100000000 + w.o_orderkey, s.o_custkey, s.o_orderstatus FROM orders w JOIN orders s ON s.o_orderkey = w.o_custkey WHERE w.o_orderkey % 50 = 0")
def self_copies(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return carry.self_copies(orders, "o_orderkey", orders.where("o_orderkey % 50 = 0").select((F.col("o_orderkey") + 100000000).alias("new"), F.col("o_custkey").alias("source")))


# --- against the ledger ------------------------------------------------------


@query("""WITH h AS (SELECT o_custkey AS t, count(*) AS held FROM orders WHERE o_orderstatus <> 'F' AND o_custkey % 40 <> 7 GROUP BY 1),
l AS (SELECT o_custkey AS t, count(*) - count(*) FILTER (o_orderstatus = 'F') - greatest(0, o_custkey % 5 - 3) AS want FROM orders WHERE o_custkey % 30 <> 5 GROUP BY o_custkey)
SELECT t, coalesce(held, -1) AS held, coalesce(want, -1) AS want FROM h FULL JOIN l USING (t) WHERE coalesce(held, -1) <> coalesce(want, -1)""")
def counts_against_ledger(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    t, n = F.col("o_custkey").alias("t"), F.count(F.lit(1))
    held = orders.where("o_orderstatus <> 'F' AND o_custkey % 40 <> 7").groupBy(t).agg(n.alias("n"))
    ledger = orders.where("o_custkey % 30 <> 5").groupBy(t).agg(n.alias("rows"), F.count_if(F.col("o_orderstatus") == "F").alias("removed")).withColumn("owned", F.col("t") % 5 - 3)
    return verify.count_problems(held, ledger)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS p, CASE o_orderkey % 11 WHEN 0 THEN 'missing' WHEN 1 THEN 'size' ELSE 'time' END AS problem FROM orders WHERE o_orderkey % 11 IN (0, 1, 2)""")
def staged_files(spark, sf_dir):
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(k, k.cast("string").alias("p"), F.col("o_custkey").alias("b"), F.unix_timestamp("o_orderdate").alias("m"))
    staged = orders.where("o_orderkey % 11 <> 0").select("p", F.when(k % 11 != 1, F.col("b")).alias("size"), (F.col("m") + F.when(k % 11 == 2, 1).otherwise(0)).alias("mtime"))
    return verify.staged_problems(orders.select("p", "b", "m"), staged)


@query("""SELECT event_id, CASE WHEN event_id % 8 BETWEEN 1 AND 5 THEN [5, 15, 60, 300, 300][event_id % 8] END AS wait,
event_id % 9 = 0 OR (event_id % 4 > 0 AND event_id % 40 > 0 AND event_id % 40 >= (event_id % 4) * 10 * 1.5) AS starts FROM events""")
def retries_and_units(spark, sf_dir):
    k = F.col("event_id")
    slowest = F.when(k % 4 > 0, (k % 4) * 10)
    return table(spark, sf_dir, "events").select("event_id", clock.retry_after(k % 8).alias("wait"), clock.may_start(k % 9 == 0, k % 40, slowest).alias("starts"))


@query("SELECT c_custkey, c_name FROM customer WHERE sha256(c_mktsegment) = sha256('BUILDING')")
def held_by_token(spark, sf_dir):
    held = table(spark, sf_dir, "customer").withColumn("hash", F.sha2("c_mktsegment", 256))
    return jobs.held_by(held, "hash", "BUILDING").select("c_custkey", "c_name")


@query("SELECT CAST(('0x' || substr(sha1(concat('3:', url)), 1, 2))::INT % 64 AS INTEGER) AS bucket, count(*) AS n FROM pages GROUP BY 1")
def name_buckets(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(hashing.name_bucket(F.lit(3), F.col("url"), 64).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# --- times and text ----------------------------------------------------------


@query("""WITH e AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) - (event_id % 60) * 31536000 AS s FROM events), u AS (SELECT event_id, s, make_timestamp(greatest(315532800, s) * 1000000) AS u FROM e)
SELECT event_id, strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') AS utc, CAST(hour(u) * 2048 + minute(u) * 32 + second(u) // 2 AS INTEGER) AS dos_time, CAST((year(u) - 1980) * 512 + month(u) * 32 + day(u) AS INTEGER) AS dos_date FROM u""")
def archive_times(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.unix_timestamp("ts") - F.col("event_id") % 60 * 31536000).alias("s"))
    dos = clock.dos_datetime(F.col("s"))
    return e.select("event_id", clock.utc_text(F.col("s")).alias("utc"), dos["time"].alias("dos_time"), dos["date"].alias("dos_date"))


@query("SELECT event_id, event_id % 11 IN (0, 1, 2, 3) AS valid FROM events")
def stamp_validity(spark, sf_dir):
    k, day = F.col("event_id"), F.concat(F.lit("2024-0"), (F.col("event_id") % 9 + 1).cast("string"), F.lit("-15T1"), (F.col("event_id") % 10).cast("string"), F.lit(":30:59"))
    text = (
        F.when(k % 11 == 0, F.concat(day, F.lit("Z")))
        .when(k % 11 == 1, F.concat(day, F.lit(".5+02:00")))
        .when(k % 11 == 2, F.concat(day, F.lit(".123456-11:30")))
        .when(k % 11 == 3, "2024-02-29T00:00:00Z")
        .when(k % 11 == 4, day)
        .when(k % 11 == 5, "2023-02-29T00:00:00Z")
        .when(k % 11 == 7, F.concat(day, F.lit("Z\n")))
        .when(k % 11 == 8, F.concat(day, F.lit("+99:99")))
        .when(k % 11 == 9, F.concat(day, F.lit(".1234567Z")))
        .when(k % 11 == 6, F.concat(F.translate(day, "T", " "), F.lit("Z")))
    )
    return table(spark, sf_dir, "events").select("event_id", clock.is_stamp(text).alias("valid"))


@query("SELECT c_custkey, hex(c_name) AS digits, c_name AS back, CAST(greatest(4096, least(1048576, floor(c_custkey * 4096 * 0.5))) AS BIGINT) AS longest FROM customer")
def key_round_trip(spark, sf_dir):
    digits = sqltext.key_hex(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", digits.alias("digits"), sqltext.key_from_hex(digits).alias("back"), sqltext.statement_bytes(F.col("c_custkey") * 4096).alias("longest"))


# --- keys, carried rows and scans ----------------------------------------------


@query("""SELECT c_custkey, concat('["', c_name, '",', CASE WHEN c_custkey % 3 = 0 THEN concat('{"h":"ff', lower(hex(c_name)), '"}') ELSE concat('"', c_custkey, '\\"/ü"') END, ']') AS key,
hex(c_name) AS first, CASE WHEN c_custkey % 3 = 0 THEN concat('FF', hex(c_name)) ELSE hex(concat(c_custkey, '"/ü')) END AS second FROM customer""")
def key_json_round_trip(spark, sf_dir):
    k = F.col("c_custkey")
    second = F.when(k % 3 == 0, F.concat(F.unhex(F.lit("FF")), F.col("c_name").cast("binary"))).otherwise(F.concat(k.cast("string"), F.lit('"/ü')).cast("binary"))
    keyed = table(spark, sf_dir, "customer").select("c_custkey", sqltext.key_json([F.col("c_name"), second]).alias("key"))
    first, other = sqltext.key_from_json(F.col("key"), 2)
    return keyed.select("c_custkey", "key", F.hex(first).alias("first"), F.hex(other).alias("second"))


_CARRIED_SQL = """live AS (SELECT o_orderkey AS id, concat('n', o_custkey) AS name, 'live' AS v FROM orders WHERE o_orderkey % 3 <> 0),
old AS (SELECT o_orderkey + 7 AS id, concat('n', o_custkey) AS name, 'old' AS v FROM orders WHERE o_orderkey % 2 = 0), own AS (SELECT concat('n', c_custkey) AS name FROM customer WHERE c_custkey % 4 = 0)"""


def _carried(spark, sf_dir):
    name = F.concat(F.lit("n"), F.col("o_custkey").cast("string")).alias("name")
    o = table(spark, sf_dir, "orders")
    live = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), name, F.lit("live").alias("v"))
    old = o.where("o_orderkey % 2 = 0").select((F.col("o_orderkey") + 7).alias("id"), name, F.lit("old").alias("v"))
    return live, old, table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("name"))


@query(f"""WITH {_CARRIED_SQL} SELECT id, name, v FROM old WHERE name NOT IN (FROM own) OR name = 'n8' UNION ALL SELECT max(id), name, 'live' FROM live WHERE name IN (FROM own) AND name <> 'n8' GROUP BY name""")
def carried_back(spark, sf_dir):
    live, old, own = _carried(spark, sf_dir)
    return carry.carry_back(live, old, "name", "id", own, ["n8"])


@query(f"""WITH {_CARRIED_SQL} SELECT DISTINCT name FROM live WHERE name IN (FROM own) AND name NOT IN (SELECT name FROM old WHERE id > 900)""")
def names_not_carried(spark, sf_dir):
    live, old, own = _carried(spark, sf_dir)
    return carry.not_carried(live, old, own, "name", "id", 900)


@query("""WITH r AS (SELECT o_custkey AS owner, concat(CASE WHEN o_orderkey % 3 = 0 THEN 'new_' ELSE 'old_' END, o_orderkey // 3 % 5) AS name, o_orderkey AS v FROM orders)
SELECT * FROM r UNION ALL SELECT owner, concat('new_', substr(name, 5)), v FROM r WHERE starts_with(name, 'old_') AND name <> 'old_1' AND NOT EXISTS (SELECT 1 FROM r AS o WHERE o.owner = r.owner AND o.name = concat('new_', substr(r.name, 5)))""")
def keys_copied(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.concat(F.when(k % 3 == 0, "new_").otherwise("old_"), (F.floor(k / 3) % 5).cast("string"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), name.alias("name"), k.alias("v"))
    return carry.copied_rows(rows, carry.copy_outcomes(rows, "owner", "name", "old_", "new_", ["old_1"]), "owner", "name")


@query("""SELECT page_id, lower(regexp_replace(concat(url, '. /x', CASE WHEN page_id % 2 = 0 THEN '. ' ELSE 'É' END), '[. ]+(/|$)', '\\1', 'g')) AS trimmed, concat(url, '. /x', CASE WHEN page_id % 2 = 0 THEN '. ' ELSE 'É' END) AS plain FROM pages""")
def target_keys(spark, sf_dir):
    path = F.concat("url", F.lit(". /x"), F.when(F.col("page_id") % 2 == 0, ". ").otherwise("E\u0301"))
    composed = F.replace(path, F.lit("E\u0301"), F.lit("É"))
    return table(spark, sf_dir, "pages").select("page_id", paths.target_key(path, trim=True).alias("trimmed"), paths.target_key(composed, fold=False).alias("plain"))


@query("""WITH f AS (
  SELECT p_partkey AS k, CASE WHEN p_partkey % 17 = 0 THEN concat('a/../', p_partkey) WHEN p_partkey % 5 = 0 THEN concat('x/node_modules/', p_brand, '/', p_partkey) WHEN p_partkey % 4 = 0 THEN concat('Dir/F', p_partkey // 8) ELSE concat('dir/f', p_partkey // 8, CASE WHEN p_partkey % 8 = 1 THEN '' ELSE concat('_', p_partkey) END) END AS p,
    p_size * 1000 AS n, CASE WHEN p_partkey % 13 = 0 THEN 'link' WHEN p_partkey % 19 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN 'dir' ELSE 'file' END AS kind, p_partkey % 23 <> 0 AS readable FROM part
), s AS (
  SELECT *, CASE WHEN starts_with(p, 'dir/f1') THEN 'excluded' WHEN kind = 'link' THEN 'links' WHEN kind IS NULL THEN 'special' WHEN k % 17 = 0 THEN 'bad_names' WHEN NOT readable THEN 'unreadable' WHEN kind = 'file' AND n > 45000 THEN 'too_large' WHEN kind = 'file' THEN 'files' ELSE 'directories' END AS state FROM f
), t AS (SELECT * FROM s WHERE state IN ('files', 'directories'))
SELECT count_if(state = 'files') AS files, count_if(state = 'directories') AS directories, count_if(state = 'excluded') AS excluded, count_if(state = 'links') AS links, count_if(state = 'special') AS special, count_if(state = 'unreadable') AS unreadable, count_if(state = 'bad_names') AS bad_names, count_if(state = 'too_large') AS too_large,
  CAST(coalesce(sum(n) FILTER (state = 'files'), 0) AS BIGINT) AS bytes, count_if(state = 'files' AND n > 40000) AS over_volume, (SELECT CAST(count(DISTINCT p) - count(DISTINCT lower(p)) AS BIGINT) FROM t) AS collisions,
  (SELECT count(*) FROM (SELECT 1 FROM t WHERE starts_with(p, 'x/node_modules/') HAVING sum(n) >= 5000)) AS heavy, 2::BIGINT AS invalid_patterns FROM s""")
def scan_totals(spark, sf_dir):
    k = F.col("p_partkey")
    text = k.cast("string")
    eighth = F.floor(k / 8).cast("string")
    path = (
        F.when(k % 17 == 0, F.concat(F.lit("a/../"), text)).when(k % 5 == 0, F.concat(F.lit("x/node_modules/"), "p_brand", F.lit("/"), text)).when(k % 4 == 0, F.concat(F.lit("Dir/F"), eighth))
        .otherwise(F.concat(F.lit("dir/f"), eighth, F.when(k % 8 == 1, "").otherwise(F.concat(F.lit("_"), text))))
    )
    kind = F.when(k % 13 == 0, "link").when(k % 19 == 0, None).when(k % 11 == 0, "dir").otherwise("file")
    found = table(spark, sf_dir, "part").select(path.alias("p"), (F.col("p_size") * 1000).alias("n"), kind.alias("kind"), (k % 23 != 0).alias("readable"))
    return files.scan_totals(found, "p", "n", "kind", "readable", ["dir/f1*", "", "../x"], largest=45000, volume=40000, heavy=5000)
