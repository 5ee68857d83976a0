"""Verification of archives: index against entries, chunk numbering, findings and their outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wharfline.functions.sqltext import chunk_path
from wharfline.operators.extract import numbered
from wharfline.operators.shared import written


def index_problems(index: DataFrame) -> DataFrame:
    """t, c and problem of index lines (t, c, p, b, h): a chunk number out of turn, another path than the name's, no size, no hash."""
    turn = F.row_number().over(Window.partitionBy("t").orderBy("c"))
    checked = index.withColumn("turn", turn)
    problem = (
        F.when(F.col("c") != F.col("turn"), "order")
        .when(F.col("p") != chunk_path(F.col("t"), F.col("c").cast("int")), "path")
        .when(~F.col("h").rlike(r"\A[0-9a-f]{64}\z"), "hash")
        .when(F.col("b") < 0, "size")
    )
    return checked.select("t", "c", problem.alias("problem")).where("problem is not null")


def index_against_summary(index: DataFrame, summary: DataFrame) -> DataFrame:
    """t and problem where the index and the manifest's tables (t, chunks, bytes) disagree: missing, unexpected, chunks or bytes."""
    seen = index.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("size"))
    both = summary.join(seen, "t", "full_outer")
    problem = F.when(F.col("n").isNull() & (F.col("chunks") > 0), "missing").when(F.col("chunks").isNull(), "unexpected").when(F.coalesce("n", F.lit(0)) != F.col("chunks"), "chunks").when(F.coalesce("size", F.lit(0)) != F.col("bytes"), "bytes")
    return both.select("t", problem.alias("problem")).where("problem is not null")


def entry_problems(index: DataFrame, entries: DataFrame) -> DataFrame:
    """p and kind of what an index (p, b, h) and an archive's entries (p, b, h) disagree on: missing, unexpected, or corrupt.

    One join by path serves for the walk of both in step and for finding the way back after a gap.
    """
    a = index.select("p", F.col("b").alias("ib"), F.col("h").alias("ih"), F.lit(True).alias("listed"))
    e = entries.select("p", F.col("b").alias("eb"), F.col("h").alias("eh"), F.lit(True).alias("found"))
    both = a.join(e, "p", "full_outer")
    kind = F.when(F.col("found").isNull(), "missing").when(F.col("listed").isNull(), "unexpected").when((F.col("ib") != F.col("eb")) | (F.col("ih") != F.col("eh")), "corrupt")
    return both.select("p", kind.alias("kind")).where("kind is not null")


def in_step(left: DataFrame, right: DataFrame, order: str, name: str, bucket: Column) -> DataFrame:
    """ordinal, listed and found wherever the n-th names of two listings, ordered by ``order``, differ. ``bucket`` doesn't fall along the order and parts both (see ``numbered``)."""
    a, b = (numbered(df.select(F.col(order).alias("k"), F.col(name).alias(as_), bucket.alias("b")), ["k"], F.col("b")).select("ordinal", as_) for df, as_ in ((left, "listed"), (right, "found")))
    return a.join(b, "ordinal", "full_outer").where(~F.col("listed").eqNullSafe(F.col("found")))


#: Buckets of an audit's lines; each is sorted and hashed by one task.
AUDIT_BUCKETS = 4096


def audit(index: DataFrame) -> DataFrame:
    """One row: n and bytes of an index (p, b, h), whether every line has a hash, and digest.

    The digest is the SHA-256 of the SHA-256s of the lines' buckets: lines go to
    AUDIT_BUCKETS by the first three hexadecimal digits of their path's MD5, each bucket's are joined in order of
    path, then line. It doesn't depend on partitions, counts repeated lines, and changes with any line. An empty index has n 0 and the hash of nothing.
    """
    line = F.concat_ws("\t", F.coalesce("p", F.lit("")), F.coalesce(F.col("b").cast("string"), F.lit("-")), F.coalesce("h", F.lit("-")))
    bucket = F.substring(F.md5(F.coalesce("p", F.lit(""))), 1, 3)
    lines = index.select(bucket.alias("bucket"), F.coalesce("p", F.lit("")).alias("p"), line.alias("line"), "b", "h")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "line"))), lambda x: x["line"]), "\n")
    per = lines.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b"), F.bool_and(F.col("h").isNotNull()).alias("hashed"), F.sha2(joined, 256).alias("hash"))
    hashes = F.transform(F.sort_array(F.collect_list(F.struct("bucket", "hash"))), lambda x: x["hash"])
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"), F.coalesce(F.bool_and("hashed"), F.lit(True)).alias("hashed"), F.sha2(F.array_join(hashes, ""), 256).alias("digest"))


def outcome(findings: DataFrame, flags: DataFrame) -> DataFrame:
    """id and outcome of each verification: flags (id, invalid, unreadable, changed, embedded, full) and findings (id, kind), the first that holds of invalid, unreadable, changed, failed, unsupported_layout, passed_partial, passed."""
    kinds = findings.groupBy("id").agg(F.count_if(F.col("kind").isin("missing", "corrupt", "malformed")).alias("damage"), F.count_if(F.col("kind") == "unsupported").alias("odd"))
    both = flags.join(kinds, "id", "left").fillna(0, ["damage", "odd"])
    return both.select(
        "id",
        F.when(F.col("invalid"), "invalid")
        .when(F.col("unreadable"), "unreadable")
        .when(F.col("changed"), "changed")
        .when(F.col("damage") > 0, "failed")
        .when(F.col("odd") > 0, "unsupported_layout")
        .when(F.col("embedded") | ~F.col("full"), "passed_partial")
        .otherwise("passed")
        .alias("outcome"),
    )


def manifest(tables: DataFrame, files: DataFrame, site: dict[str, str]) -> DataFrame:
    """One row, manifest: a compact JSON document of tables (name, rows, bytes, chunks, sha256) and of the files' count and bytes."""
    listed = tables.agg(F.sort_array(F.collect_list(F.struct("name", "rows", "bytes", "chunks", "sha256"))).alias("tables"), F.sum("rows").alias("exported"))
    counted = files.agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"))
    where = F.struct(*[F.lit(v).alias(k) for k, v in sorted(site.items())]).alias("site")
    return listed.join(counted).select(F.to_json(F.struct(F.lit(1).alias("version"), where, F.struct("exported", "tables").alias("database"), F.struct("bytes", "count").alias("files"))).alias("manifest"))


def chunk_problems(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """p, n and problem of streamed chunks (p, n, h) against an index line's list of chunk hashes (p, hc): missing, unexpected or corrupt."""
    listed = index.select("p", F.posexplode("hc").alias("n", "want"))
    both = listed.join(chunks.select("p", "n", "h"), ["p", "n"], "full_outer")
    problem = F.when(F.col("h").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("want") != F.col("h"), "corrupt")
    return both.select("p", "n", problem.alias("problem")).where("problem is not null")


def count_problems(held: DataFrame, ledger: DataFrame) -> DataFrame:
    """t, held and want of tables whose rows (t, n) aren't those of the ledger (t, rows, removed, owned): rows less those removed later and own ones. A table that the ledger doesn't hold wants -1, one not counted holds -1."""
    want = F.col("rows") - F.coalesce("removed", F.lit(0)) - F.greatest(F.lit(0), F.coalesce("owned", F.lit(0)))
    both = held.select("t", "n").join(ledger.select("t", want.alias("w")), "t", "full_outer").select("t", F.coalesce("n", F.lit(-1)).alias("held"), F.coalesce("w", F.lit(-1)).alias("want"))
    return both.where("held <> want")


def staged_problems(index: DataFrame, staged: DataFrame) -> DataFrame:
    """p and problem of index lines (p, b, m) whose staged file (p, size, mtime) is missing, or of another size or time."""
    both = index.join(staged.select("p", "size", "mtime", F.lit(True).alias("_there")), "p", "left")
    problem = F.when(F.col("_there").isNull(), "missing").when(~F.col("size").eqNullSafe(F.col("b")), "size").when(~F.col("mtime").eqNullSafe(F.col("m")), "time")
    return both.select("p", problem.alias("problem")).where("problem is not null")


# --- order and phases --------------------------------------------------------

#: The phases of a verification, in order.
PHASES = ("manifest", "volumes", "indexes", "index_lines", "containers", "contents")


def phased(findings: DataFrame, phases: tuple[str, ...] = PHASES) -> DataFrame:
    """The findings (archive, phase, stops) that a verification in phases comes to: those of phases after one with a finding that stops are never looked for.

    A finding of an unknown or null phase is left out; a null ``stops`` doesn't stop. Archives may have any number of findings: what stops an archive is one row.
    """
    number = F.array_position(F.array(*map(F.lit, phases)), F.col("phase"))
    numbered_ = findings.withColumn("_phase", number).where("_phase > 0")
    stopped = numbered_.where("stops").groupBy("archive").agg(F.min("_phase").alias("_last"))
    return numbered_.join(stopped, "archive", "left").where(F.col("_last").isNull() | (F.col("_phase") <= F.col("_last"))).select(*findings.columns)


def first_lines(runs: DataFrame, known: DataFrame) -> DataFrame:
    """runs (archive, name, least, run and others) with ``line``: the first of known lines (archive, name, line) of its name that isn't before ``least``; null if there is none.

    Runs and lines of a name lie in one order, and each run takes the line before it from the end, so no run meets all lines of a name that repeats.
    """
    marks = runs.drop("line").withColumn("_place", F.col("least")).unionByName(known.select("archive", "name", "line", F.col("line").alias("_place")), allowMissingColumns=True)
    # Lines come before runs of the same place.
    back = Window.partitionBy("archive", "name").orderBy(F.col("_place").desc(), F.col("run").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marks.withColumn("line", F.last("line", ignorenulls=True).over(back)).where("run is not null").drop("_place")


def resynced(lines: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where each entry of an archive stands in its index, and where reading has to stop.

    lines (archive, line, name): the index, lines numbered from 0 without gaps. entries (archive, entry, name,
    gap): what is there, numbered likewise; ``gap`` says that a part before the entry is lost. An entry stands on the line after
    its predecessor's; one after a gap on the first line of its name that isn't before that. First: archive, entry, line for all entries up to the
    first that doesn't stand where it must. Second: archive, entry and problem (order, or lost: after a gap no such line follows) of that entry.

    Entries between two gaps move together, so only the first of each such run looks for its line, in the order of its name's lines;
    each round moves runs on that begin before their predecessor's end, until none does (no name repeated: one round). Numbers are unique and not null.
    """
    upto = Window.partitionBy("archive").orderBy("entry").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = (F.col("entry") == 0) & ~F.coalesce("gap", F.lit(False))
    starts = F.coalesce("gap", F.lit(False)) | (F.col("entry") == 0)
    marked = written(entries.withColumn("run", F.sum(starts.cast("int")).over(upto)).withColumn("fixed", first), "verify-entries")
    runs = marked.groupBy("archive", "run").agg(F.min("entry").alias("from"), F.count(F.lit(1)).alias("n"), F.min_by("name", "entry").alias("name"), F.max("fixed").alias("fixed"))
    # Lines of the names that runs begin with: all that searching needs.
    known = written(lines.join(runs.select("archive", "name").distinct(), ["archive", "name"]).select("archive", "name", "line"), "verify-lines")
    by_run = Window.partitionBy("archive").orderBy("run")

    def placed(at: DataFrame) -> DataFrame:
        """Each run on the first line of its name from ``least`` on; null if there is none. The first entry of an archive with no gap before it stands on line 0."""
        return first_lines(at, known).withColumn("line", F.when(F.col("fixed"), F.lit(0)).otherwise(F.col("line")))

    at = written(placed(runs.withColumn("least", F.lit(0).cast("bigint"))), "verify-runs")
    while True:
        # A run without a line hides those after it.
        end = F.lag(F.col("line") + F.col("n")).over(by_run)
        after = at.withColumn("bound", F.greatest("least", F.coalesce(end, F.lit(0))))
        if after.where("bound > least and bound > line and not fixed").isEmpty():
            break
        at = written(placed(after.withColumn("least", F.col("bound")).drop("bound")), "verify-runs")
    stood = marked.join(at.select("archive", "run", "from", F.col("line").alias("begin")), ["archive", "run"])
    stood = stood.withColumn("line", F.col("begin") + F.col("entry") - F.col("from"))
    there = lines.select("archive", "line", F.col("name").alias("listed"))
    checked = stood.join(there, ["archive", "line"], "left")
    problem = F.when(F.col("begin").isNull(), "lost").when(~F.col("listed").eqNullSafe(F.col("name")), "order")
    checked = written(checked.select("archive", "entry", "line", problem.alias("problem")), "verify-stood")
    stops = checked.where("problem is not null").groupBy("archive").agg(F.min(F.struct("entry", "problem")).alias("s")).select("archive", "s.entry", "s.problem")
    until = stops.select("archive", F.col("entry").alias("until"))
    fine = checked.join(until, "archive", "left").where(F.col("until").isNull() | (F.col("entry") < F.col("until"))).select("archive", "entry", "line")
    return fine, stops


def missing_lines(lines: DataFrame, fine: DataFrame, stops: DataFrame) -> DataFrame:
    """archive, first, last and n: runs of index lines that no entry stands on, up to the place where reading stopped; without a stop, up to the index's end."""
    size = lines.groupBy("archive").agg(F.count(F.lit(1)).alias("size"))
    ends = size.join(stops.select("archive", F.lit(True).alias("stopped")), "archive", "left")
    by_line = Window.partitionBy("archive").orderBy("line")
    held = fine.select("archive", "line").unionByName(ends.where("stopped is null").select("archive", F.col("size").alias("line")))
    gaps = held.withColumn("first", F.coalesce(F.lag("line").over(by_line) + 1, F.lit(0))).where("line > first")
    return gaps.select("archive", "first", (F.col("line") - 1).alias("last"), (F.col("line") - F.col("first")).alias("n"))
