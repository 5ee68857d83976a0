"""Queries over dumps as other programs write them, made of documents and orders and cut at any byte."""

from __future__ import annotations

from pyspark.sql import functions as F

from wharfline.operators import definitions, extract
from wharfline.operators.shared import written
from wharfline.plans.registry import query, table
from wharfline.sources import foreign

#: Bytes of a piece: statements and tokens lie across pieces.
PIECE = 1531


def _quoted(column):
    """A string literal: even documents double quotes, odd ones escape them."""
    plain = F.replace(column, F.lit("\\"), F.lit("\\\\"))
    doubled, escaped = F.replace(plain, F.lit("'"), F.lit("''")), F.replace(F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit("'"), F.when(F.col("doc_id") % 2 == 0, doubled).otherwise(escaped), F.lit("'"))


def _when(every: int, text: str):
    return F.when(F.col("doc_id") % every == 0, text).otherwise("")


def _pieces(spark, sf_dir, nameless=False):
    """A dump for each source: an INSERT a document, some after comments, and some statements that are no INSERT; with ``nameless``, documents without an id come first."""
    docs = table(spark, sf_dir, "documents")
    # Those without an id are numbered below all others by their places in the files.
    file, row = F.pmod(F.xxhash64("_metadata.file_path"), F.lit(1 << 12)), F.col("_metadata.row_index")
    docs = docs.withColumn("_piece", F.coalesce("doc_id", -1 - file * (1 << 40) - row)) if nameless else docs.where("doc_id is not null").withColumn("_piece", F.col("doc_id"))
    body = F.concat(
        _when(7, "-- a note; it's `open\n"), _when(11, "/* a ' \" ` comment; -- */\n"), _when(13, "# don't; stop\n"),
        _when(17, "ALTER TABLE `docs` /*!40000 DISABLE KEYS */;\n"), _when(19, "INSERT INTO `docs` (`doc_id`,`lang`,`text`) VALUES (1,now(),'--');\n"),
        F.lit("INSERT INTO `docs` (`doc_id`,`lang`,\n  `text`) VALUES\n("), F.coalesce(F.col("doc_id").cast("string"), F.lit("NULL")), F.lit(","), F.coalesce(_quoted(F.col("lang")), F.lit("NULL")), F.lit(", "), F.coalesce(_quoted(F.col("text")), F.lit("NULL")), F.lit(");\n"),
    )
    parts = docs.select(F.coalesce("source", F.lit("none")).alias("dump"), F.col("_piece").alias("piece"), body.cast("binary").alias("body")).withColumn("size", F.octet_length("body").cast("bigint"))
    placed = extract.running_sums(parts, ["dump"], "piece", ["size"])
    return foreign.cut(placed.select("dump", F.col("size_before").alias("at"), "body"), PIECE)


_ALL = "SELECT coalesce(source, 'none') AS dump, doc_id, lang, text FROM documents"
_DUMP = f"{_ALL} WHERE doc_id IS NOT NULL"


@query(f"""
WITH d AS ({_ALL}), n AS (
  SELECT dump, count(*) AS docs, count(lang) AS langs, count(text) AS texts, count_if(doc_id % 7 = 0) AS a, count_if(doc_id % 11 = 0) AS b, count_if(doc_id % 13 = 0) AS c, count_if(doc_id % 17 = 0) AS alters, count_if(doc_id % 19 = 0) AS calls FROM d GROUP BY dump
), k AS (
  SELECT dump, unnest(['comment', 'id', 'str', 'word', 'p', 'end', 'vopen', 'vclose']) AS kind,
    unnest([a + b + c, 4 * docs + alters + 4 * calls, langs + texts + calls, 4 * docs + (docs - langs) + (docs - texts) + 4 * alters + 5 * calls, 8 * docs + 10 * calls, docs + alters + calls, alters, alters]) AS n FROM n
) SELECT dump, kind, CAST(n AS BIGINT) AS n FROM k WHERE n > 0
""")
def dump_tokens(spark, sf_dir):
    found = foreign.tokens(foreign.statements(_pieces(spark, sf_dir, nameless=True), any_length=True))
    return found.select("dump", F.explode("tokens").alias("t")).groupBy("dump", F.col("t.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


#: Each document's statements by number, and why one is refused: comments other than -- stand before the first.
_STATEMENTS = f"""
WITH d AS ({_DUMP}), c AS (
  SELECT *, (doc_id % 17 = 0)::INT AS alters, (doc_id % 19 = 0)::INT AS calls, doc_id % 11 = 0 OR doc_id % 13 = 0 AS noted FROM d
), p AS (
  SELECT *, CAST(coalesce(sum(1 + alters + calls) OVER (PARTITION BY dump ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM c
), s AS (
  SELECT dump, before AS number, CASE WHEN noted THEN 'a kind that is not read' ELSE 'a kind that is not read: ALTER' END AS reason FROM p WHERE alters = 1
  UNION ALL SELECT dump, before + alters, CASE WHEN noted AND alters = 0 THEN 'a kind that is not read' ELSE 'something other than literal values' END FROM p WHERE calls = 1
  UNION ALL SELECT dump, before + alters + calls, CASE WHEN noted AND alters + calls = 0 THEN 'a kind that is not read' END FROM p
)
"""


def _judged(spark, sf_dir):
    # Read once: the rules of a context look at all statements three times, and need neither texts nor rows.
    read = foreign.read(foreign.statements(_pieces(spark, sf_dir))).drop("body", "rows")
    return foreign.in_context(written(read, "dump-read"))


@query(f"{_STATEMENTS} SELECT dump, CASE WHEN reason IS NULL THEN 'insert' ELSE 'refused' END AS kind, count(*) AS n, CASE WHEN reason IS NULL THEN count(*) END AS rows FROM s GROUP BY dump, reason IS NULL")
def dump_statements(spark, sf_dir):
    read = _judged(spark, sf_dir)
    return read.groupBy("dump", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("n_rows").alias("rows"))


@query(f"{_STATEMENTS} SELECT dump, number, reason FROM s WHERE reason IS NOT NULL")
def refused_statements(spark, sf_dir):
    read = _judged(spark, sf_dir)
    return read.where("kind = 'refused'").select("dump", "number", "reason")


@query("SELECT doc_id, lang, md5(text) AS digest, CAST(length(text) AS INTEGER) AS n FROM documents WHERE doc_id IS NOT NULL")
def dump_rows_read(spark, sf_dir):
    schema = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").schema
    rows = foreign.inserted(foreign.read(foreign.statements(_pieces(spark, sf_dir)), comments=True), schema)
    return rows.select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").alias("n"))


# --- definitions -----------------------------------------------------------------


def _definitions(spark, sf_dir):
    """A definition for each order, with and without generated columns, keys, checks and what isn't to be run; named by the order."""
    k = F.col("o_orderkey")

    def some(every: int, text, other=""):
        return F.when(k % every == 0, text).otherwise(other)

    name = F.concat(F.lit("wp_"), k.cast("string"), some(9, "_" + "long" * 12, "_o"))
    text = F.concat(
        F.lit("-- table\nCREATE TABLE `"), name, F.lit("` (\n  `id` bigint(20) unsigned NOT NULL AUTO_INCREMENT,\n  `total` decimal(10,2) NOT NULL DEFAULT '0.00' COMMENT 'it''s, (a) \"total\"; COLLATE x',\n"),
        some(2, "  `na``me` varchar(190) CHARACTER SET utf8mb4 COLLATE utf8mb4_bin DEFAULT NULL,\n"), some(3, "  `twice` decimal(11,2) GENERATED ALWAYS AS ((`total` * 2)) STORED,\n"),
        some(5, "  `hidden` int DEFAULT NULL /*!80023 INVISIBLE */,\n"), some(101, "  `far` int REFERENCES `x` (`y`),\n"), some(103, "  `total` int,\n"),
        some(4, "  PRIMARY KEY (`id`,`total`),\n", "  PRIMARY KEY (`id`) USING BTREE,\n"),
        some(6, F.concat(F.lit("  CONSTRAINT `"), name, F.lit("_ibfk_1` FOREIGN KEY (`id`) REFERENCES `wp_customer` (`c_id`) ON DELETE CASCADE,\n"))),
        some(8, F.concat(F.lit("  CONSTRAINT `fk_"), F.repeat(F.lit("é"), F.lit(20)), k.cast("string"), F.lit("` FOREIGN KEY (`id`, `total`) REFERENCES `wp_part` (`p`, `q`),\n"))),
        some(10, "  CONSTRAINT `positive` CHECK ((`total` >= 0) and (`total` collate utf8mb4_unicode_520_ci <> 'a,b')),\n"),
        F.lit("  KEY `k` (`total`)\n) ENGINE="), some(97, "FEDERATED CONNECTION='mysql://x'", "InnoDB"), some(7, F.concat(F.lit(" AUTO_INCREMENT="), k.cast("string"))), F.lit(" DEFAULT CHARSET=utf8mb4 COLLATE=utf8mb4_unicode_520_ci;\n"),
    )
    # An order is a few bytes in a file and a definition here, so a split's orders are dealt out before they become definitions.
    dealt = table(spark, sf_dir, "orders").select("o_orderkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    return dealt.select("o_orderkey", text.cast("binary").alias("body"))


_DEFINITIONS = """
WITH o AS (
  SELECT o_orderkey AS k, 'wp_' || o_orderkey || CASE WHEN o_orderkey % 9 = 0 THEN '_' || repeat('long', 12) ELSE '_o' END AS name,
    'fk_' || repeat('é', 20) || o_orderkey AS far, CASE WHEN o_orderkey % 101 = 0 THEN 'a column with REFERENCES of its own' WHEN o_orderkey % 97 = 0 THEN 'the option CONNECTION' WHEN o_orderkey % 103 = 0 THEN 'a column defined twice' END AS reason FROM orders
)
"""


@query(f"""{_DEFINITIONS}
SELECT k AS o_orderkey, name, 'id,total' || CASE WHEN k % 2 = 0 THEN ',na`me' ELSE '' END || CASE WHEN k % 3 = 0 THEN ',twice' ELSE '' END || CASE WHEN k % 5 = 0 THEN ',hidden' ELSE '' END || CASE WHEN k % 101 = 0 THEN ',far' ELSE '' END || CASE WHEN k % 103 = 0 THEN ',total' ELSE '' END AS columns,
  CASE WHEN k % 3 = 0 THEN 'twice' ELSE '' END AS generated, CASE WHEN k % 4 = 0 THEN 'id,total' ELSE 'id' END AS primary_key,
  CASE WHEN k % 6 = 0 THEN name || '_ibfk_1 id wp_customer c_id;' ELSE '' END || CASE WHEN k % 8 = 0 THEN far || ' id,total wp_part p,q;' ELSE '' END AS foreign_keys,
  CASE WHEN k % 10 = 0 THEN 'positive' ELSE '' END AS checks, CASE WHEN k % 97 = 0 THEN 'FEDERATED' ELSE 'InnoDB' END AS engine, CASE WHEN k % 7 = 0 THEN CAST(k AS VARCHAR) ELSE '' END AS auto_increment,
  CASE WHEN k % 2 = 0 THEN 'utf8mb4_bin@column:na`me;' ELSE '' END || CASE WHEN k % 10 = 0 THEN 'utf8mb4_unicode_520_ci@check;' ELSE '' END || 'utf8mb4_unicode_520_ci@table;' AS collations, reason FROM o
""")
def ddl_facts(spark, sf_dir):
    found = definitions.facts(_definitions(spark, sf_dir), ["o_orderkey"], [f for f in definitions.FACTS if f not in ("places", "start")])
    keys = F.transform("foreign_keys", lambda x: F.concat(x["name"], F.lit(" "), F.array_join(x["columns"], ","), F.lit(" "), x["references"], F.lit(" "), F.array_join(x["referenced"], ","), F.lit(";")))
    collations = F.transform("collations", lambda x: F.concat(x["name"], F.lit("@"), x["at"], F.lit(";")))
    lists = {c: F.array_join(c, ",") for c in ("columns", "generated", "primary_key", "checks")} | {"foreign_keys": F.array_join(keys, ""), "collations": F.array_join(collations, "")}
    return found.select("o_orderkey", F.col("table").alias("name"), *[v.alias(c) for c, v in lists.items()], "engine", "auto_increment", "reason")


@query(f"""{_DEFINITIONS}, n AS (
  SELECT *, 'tmp' || k AS temporary, k % 1000 AS number, CASE WHEN k % 9 = 0 THEN repeat('final', 12) ELSE 'site_' || k END AS final FROM o
), m AS (
  SELECT *, 'zq7_' || CASE WHEN number >= 36 THEN substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(number // 36 % 36 AS INTEGER) + 1, 1) ELSE '' END || substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(number % 36 AS INTEGER) + 1, 1) || '_' AS front FROM n
), c AS (
  SELECT *, CASE WHEN k % 6 = 0 THEN CASE WHEN strlen(final || '_ibfk_1') <= 64 THEN temporary || '_ibfk_1' WHEN strlen(front || name || '_ibfk_1') <= 64 THEN front || name || '_ibfk_1' ELSE front || substr(name || '_ibfk_1', 1, CAST(56 - strlen(front) AS INTEGER)) || '_' || substr(sha256(name || '_ibfk_1'), 1, 7) END ELSE '' END AS first,
    CASE WHEN k % 8 = 0 THEN front || far ELSE '' END AS second,
    CASE WHEN k % 10 = 0 THEN front || 'positive' ELSE '' END AS third FROM m
) SELECT k AS o_orderkey, temporary AS name, first || ' ' || second || ' ' || third AS names, CASE WHEN k % 6 = 0 THEN 'tmp_customer ' ELSE '' END || CASE WHEN k % 8 = 0 THEN 'wp_part ' ELSE '' END AS tables,
  CASE WHEN k % 2 = 0 THEN 'utf8mb4_bin ' ELSE '' END || CASE WHEN k % 10 = 0 THEN 'utf8mb4_general_ci ' ELSE '' END || 'utf8mb4_general_ci ' AS collations FROM c WHERE reason IS NULL
""")
def ddl_rename(spark, sf_dir):
    """The facts of the rewritten definitions."""
    made = _definitions(spark, sf_dir)
    k = F.col("o_orderkey")
    known = definitions.facts(made, ["o_orderkey", "body"], ["table", "reason", "places", "start"])
    known = known.withColumns({"temporary": F.concat(F.lit("tmp"), k.cast("string")), "number": k % 1000, "final": F.when(k % 9 == 0, "final" * 12).otherwise(F.concat(F.lit("site_"), k.cast("string"))), "others": F.create_map(F.lit("wp_customer"), F.lit("tmp_customer"))})
    sql = definitions.rewritten(known, mark="zq7_", references="others", collations={"utf8mb4_unicode_520_ci": "utf8mb4_general_ci"})
    # Definitions that aren't to be run have no text and no facts.
    again = definitions.facts(sql.select("o_orderkey", F.concat("sql", F.lit(";")).cast("binary").alias("body")), ["o_orderkey"], ["table", "foreign_keys", "checks", "collations"])
    keys = F.col("foreign_keys")
    first = F.when(k % 6 == 0, F.get(keys, F.lit(0))["name"]).otherwise("")
    second = F.when(k % 8 == 0, F.get(keys, F.when(k % 6 == 0, 1).otherwise(0))["name"]).otherwise("")
    names = F.concat_ws(" ", first, second, F.coalesce(F.get("checks", F.lit(0)), F.lit("")))
    tables, collations = (F.array_join(F.transform(F.col(c)[field], lambda x: F.concat(x, F.lit(" "))), "") for c, field in (("foreign_keys", "references"), ("collations", "name")))
    return again.select("o_orderkey", F.col("table").alias("name"), names.alias("names"), tables.alias("tables"), collations.alias("collations"))
