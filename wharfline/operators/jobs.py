"""A log of jobs: states, conditional updates, retention, give-up rules and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wharfline.functions.hashing import position_mark


def histogram(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """column and n for every given value, 0 where no row has it."""
    every = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return every.join(df.groupBy(column).agg(F.count(F.lit(1)).alias("c")), column, "left").select(column, F.coalesce("c", F.lit(0)).alias("n"))


def complete(df: DataFrame, group: str, seq: str) -> DataFrame:
    """group, n and complete: whether its sequence numbers are 0 to n - 1 by count and maximum."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), (F.max(seq) == F.count(F.lit(1)) - 1).alias("complete"))


def fenced_update(df: DataFrame, holders: DataFrame, key: str, token: str, changes: dict[str, Column], where: Column | None = None) -> DataFrame:
    """df with ``changes`` made to rows whose key's holder has the token: the join and the fence are one condition, so a lost lease changes nothing."""
    held = holders.where(F.col("token") == token).select(key, F.lit(True).alias("_held")).distinct()
    joined = df.join(held, key, "left")
    hit = F.coalesce(F.col("_held"), F.lit(False)) & (F.lit(True) if where is None else F.coalesce(where, F.lit(False)))
    return joined.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in df.columns])


def write_if_held(df: DataFrame, holders: DataFrame, key_value: object, key: str, token: str) -> DataFrame:
    """The rows of df if the key's holder has the token, none otherwise."""
    held = holders.where((F.col(key) == key_value) & (F.col("token") == token)).limit(1).select(F.lit(1).alias("_one"))
    return df.withColumn("_one", F.lit(1)).join(held, "_one", "left_semi").drop("_one")


def transition_allowed(state: Column, new: Column, allowed: dict[str, list[str]]) -> Column:
    table = F.create_map([x for k, v in allowed.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    return F.coalesce(F.array_contains(table[state], new), F.lit(False))


def latest(df: DataFrame, group: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_n = 1").drop("_n")


def purge(df: DataFrame, row_id: str, status: str, created: str, now: object, ages: dict[str, int], keep: int) -> DataFrame:
    """id and reason of rows to remove: those whose status is past its age in seconds, then the oldest beyond ``keep`` of such as ended.

    Rows are counted by the hour; the counts, one row an hour, say which hours go whole, and
    only the hour in which the cut lies is put in order. Rows without a time come first.
    """
    age = F.create_map([x for k, v in ages.items() for x in (F.lit(k), F.lit(v))])[F.col(status)]
    old = F.coalesce(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col(created)) > age, F.lit(False))
    ended = df.where(F.col(status).isin(*ages)).select(F.col(row_id), F.col(created).alias("at"), F.date_trunc("hour", F.col(created)).alias("hour"), old.alias("old"))
    rest = ended.where("not old")
    hours = rest.groupBy("hour").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.col("hour").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = hours.withColumn("due", F.sum("n").over(Window.partitionBy()) - keep - before).where("due > 0").select(F.col("hour").alias("cut"), "n", "due")
    met = rest.join(cut, F.col("hour").eqNullSafe(F.col("cut"))).select(row_id, "at", "hour", "n", "due")
    place = F.row_number().over(Window.partitionBy("hour").orderBy(F.col("at").asc_nulls_first(), row_id))
    oldest = met.where("due >= n").select(row_id).unionByName(met.where("due < n").withColumn("place", place).where("place <= due").select(row_id))
    return ended.where("old").select(row_id, F.lit("age").alias("reason")).unionByName(oldest.select(row_id, F.lit("cap").alias("reason")))


def position_runs(df: DataFrame, job: str, order: str, step: str, cursor: str) -> DataFrame:
    """df with mark, and run: how many rows in a row, up to this one, stood at the same position."""
    by = Window.partitionBy(job).orderBy(order)
    marked = df.withColumn("mark", position_mark(F.col(step), F.col(cursor)))
    changed = marked.withColumn("_new", F.when(F.lag("mark").over(by) == F.col("mark"), 0).otherwise(1))
    spelled = changed.withColumn("_spell", F.sum("_new").over(by))
    return spelled.withColumn("run", F.row_number().over(Window.partitionBy(job, "_spell").orderBy(order))).drop("_new", "_spell")


def claimable(status: Column, lease_until: Column, takeovers: Column, now: Column, most: int = 3) -> Column:
    """Whether a job may be taken: queued, or running under a lapsed lease that wasn't lapsed ``most`` times at one position."""
    return (status == "queued") | ((status == "running") & (lease_until < now) & (takeovers < most))


def give_up(status: Column, progress: Column, asked: Column, now: Column, holds_site: Column) -> Column:
    """Why a job is given up, or null: no progress for a day, or a question unanswered for a week; never one that holds the site."""
    return F.when(holds_site, None).when((status == "running") & (now - progress > 86_400), "stalled").when((status == "paused") & (now - asked > 7 * 86_400), "unanswered")


#: The rules by which a job may not start, in order: (new type, active type, reason); * is any.
CONFLICTS = (
    ("estimate", "export", "busy"),
    ("estimate", "restore", "busy"),
    ("estimate", "estimate", "busy"),
    ("*", "restore", "restoring"),
    ("restore", "export", "exporting"),
    ("export", "export", "exporting"),
)


def conflicts(wanted: DataFrame, active: DataFrame, yielding: tuple[str, ...] = ("estimate",)) -> DataFrame:
    """wanted (id, type, backup) with reason, the first rule that an active job (job_id, type, backup) meets, by job; null if it may start.

    Of active jobs of one type only the first matters (of verifications, the first of each backup), so they meet
    the wanted ones by equality of type and backup, whatever their number.
    """
    types = sorted({old for _, old, _ in CONFLICTS})
    nothing = F.lit(None).cast("string")
    first = active.groupBy("type", F.when(F.col("type") == "verify", F.col("backup")).alias("backup")).agg(F.min("job_id").alias("job_id")).alias("a")
    first = first.where(F.col("type").isin(*types) | (F.col("type") == "verify") & F.col("backup").isNotNull())
    asked = F.array(*[F.struct(F.lit(t).alias("type"), nothing.alias("backup")) for t in types], F.struct(F.lit("verify").alias("type"), F.col("backup").alias("backup")))
    w = wanted.select("id", "type", "backup", F.explode(asked).alias("asked")).alias("w")
    reason = F.when(F.lit(False), nothing)
    for new, old, why in CONFLICTS:
        hit = (F.col("a.type") == old) & (F.lit(True) if new == "*" else F.col("w.type") == new)
        if new != "estimate":
            hit = hit & ~F.col("a.type").isin(*yielding)
        reason = reason.when(hit, why)
    rules = reason.when(F.col("a.type") == "verify", "verifying")
    met = w.join(first, (F.col("w.asked.type") == F.col("a.type")) & F.col("w.asked.backup").eqNullSafe(F.col("a.backup")), "left")
    return met.groupBy("w.id", "w.type", "w.backup").agg(F.min_by(rules, F.when(rules.isNotNull(), F.col("a.job_id"))).alias("reason"))


def decisions(questions: DataFrame, answers: DataFrame, policy: DataFrame, allowed: list[str]) -> DataFrame:
    """id and decision (and by whom): a valid answer, else a valid policy for the kind, else a question."""
    good = [df.withColumn("choice", F.when(F.col("choice").isin(allowed), F.col("choice"))) for df in (answers, policy)]
    out = questions.join(good[0].select("id", F.col("choice").alias("a")), "id", "left").join(good[1].select("kind", F.col("choice").alias("p")), "kind", "left")
    return out.select("id", F.coalesce("a", "p", F.lit("ask")).alias("decision"), F.when(F.col("a").isNotNull(), "answer").when(F.col("p").isNotNull(), "policy").otherwise("question").alias("by"))


def time_estimate(wanted: DataFrame, measured: DataFrame) -> DataFrame:
    """scope, bytes and seconds: the latest measured rate of the same scope; null without one."""
    rate = latest(measured.where("bytes > 0"), ["scope"], F.desc("at")).select("scope", F.col("bytes").alias("mb"), F.col("seconds").alias("ms"))
    return wanted.join(rate, "scope", "left").select("scope", "bytes", F.ceil(F.col("bytes") * F.col("ms") / F.col("mb")).alias("seconds"))


def lost_writes(entries: DataFrame, since: int) -> DataFrame:
    """kind and n: writes since a time, NULL (not 0) for a kind of which a table couldn't be read."""
    return entries.groupBy("kind").agg(F.when(F.bool_and("readable"), F.count_if(F.col("at") >= since)).alias("n"))


def held_by(df: DataFrame, hashed: str, token: str) -> DataFrame:
    """Rows whose stored SHA-256 is the token's: a table holds hashes, never tokens."""
    return df.where(F.col(hashed) == F.sha2(F.lit(token), 256))
