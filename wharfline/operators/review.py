"""What a check before a backup found, and what is done about it: rules, a policy, and answers to questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Findings of a kind that get a question of their own; all others share one.
LISTED = 20
#: What is decided for a finding of a kind, the policy that speaks for it, and the choices there are.
RULES = (("unreadable", "unreadable", ("continue", "stop")), ("large_dir", "large_dirs", ("include", "exclude")), ("oversize", "oversize", ("exclude", "stop")))
#: Kinds with one finding and one question for all.
SINGLE = ("unreadable",)
#: Least size of a directory that is asked about.
HEAVY_BYTES = 500 * 1024 * 1024


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, p, list(c), k in SINGLE) for k, p, c in RULES], "kind string, policy string, choices array<string>, single boolean")


def decided(findings: DataFrame, rule: DataFrame, policy: DataFrame, answers: DataFrame, *, listed: int = LISTED) -> DataFrame:
    """The findings (kind, subject, weight) with their question's ``id``, the ``choice`` made and the ``outcome``: ask, stop, or the choice.

    Findings of a kind are numbered from the heaviest, ties by subject; the first ``listed`` have
    questions of their own (kind_0, ...), the others share kind_more, and kinds marked single have one question, named by the kind. An answer (id, choice) counts if it is one of
    the rule's choices; else the policy (name, value) decides, where fail means stop and ask, or none, leaves the question open. Findings of
    other kinds, or with none of what they count (weight 0 or null), are left out. Only the first ``listed`` of a kind are put in order, so a kind may have any number.
    """
    told = findings.where("weight > 0").join(F.broadcast(rule), "kind")
    heaviest = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("weight"), "subject"))
    # The limit on numbers is applied before rows are sent.
    first = told.select("kind", "subject", "weight").withColumn("place", heaviest).where(F.col("place") <= listed)
    told = told.join(F.broadcast(first), ["kind", "subject", "weight"], "left")
    id_ = F.when(F.col("single"), F.col("kind")).otherwise(F.concat_ws("_", "kind", F.coalesce((F.col("place") - 1).cast("string"), F.lit("more"))))
    told = told.withColumn("id", id_)
    given = answers.select(F.col("id"), F.col("choice").alias("answer")).groupBy("id").agg(F.max("answer").alias("answer"))
    told = told.join(F.broadcast(policy.select(F.col("name").alias("policy"), "value")), "policy", "left").join(F.broadcast(given), "id", "left")
    spoken = F.when(F.array_contains("choices", F.col("answer")), F.col("answer"))
    ruled = F.when(F.col("value") == "fail", "stop").when(F.col("value") != "ask", F.col("value"))
    told = told.withColumn("choice", F.coalesce(spoken, ruled))
    return told.select("kind", "subject", "weight", "id", "choice", F.coalesce("choice", F.lit("ask")).alias("outcome"))


def questions(decisions: DataFrame) -> DataFrame:
    """id, kind and n of the questions still open. None is, where something was decided to stop: all such decisions are named at once."""
    stops = decisions.agg(F.bool_or(F.col("outcome") == "stop").alias("stopped"))
    return decisions.where("outcome = 'ask'").groupBy("id", "kind").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(stops)).where("not stopped").drop("stopped")
