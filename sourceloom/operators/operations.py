"""Supervision: counters, problem lists, requeueing, health."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP_ERRORS, MAX_LIST, MAX_REQUEUE = 5, 20, 20      # fixed values: report limits
PROBLEM_KINDS = ["verify_failed", "verify_partial", "manual_review", "error", "duplicate"]


def status_counters(state: DataFrame) -> DataFrame:
    """dimension, value, n: every counter of the status report in one pass over the state."""
    done = F.col("status") == "processed"
    facets = F.array(
        F.struct(F.lit("status").alias("dimension"), F.coalesce("status", F.lit("unknown")).alias("value")),
        F.struct(F.lit("verification").alias("dimension"), F.when(done, F.col("verification")).alias("value")),
        F.struct(F.lit("quality").alias("dimension"), F.when(done, F.col("quality")).alias("value")),
        F.struct(F.lit("flag").alias("dimension"), F.when(done & F.col("ocr"), "ocr").alias("value")),
        F.struct(F.lit("flag").alias("dimension"), F.when(done & F.col("retried"), "retried").alias("value")),
        F.struct(F.lit("flag").alias("dimension"), F.when(done & F.col("skipped"), "skipped").alias("value")))
    return (state.select(F.explode(F.filter(facets, lambda f: f["value"].isNotNull())).alias("f"))
            .groupBy("f.dimension", "f.value").agg(F.count(F.lit(1)).alias("n")))


def top_errors(state: DataFrame, n: int = TOP_ERRORS) -> DataFrame:
    return (state.filter(F.col("status") == "error")
            .groupBy(F.coalesce("error", F.lit("")).alias("error"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error").limit(n))


def problem_kind() -> Column:
    """array<string>: the problem lists a state row belongs to."""
    hidden = F.col("status").isin("deleted", "duplicate")
    return F.filter(F.array(
        F.when((F.col("verification") == "failed") & ~hidden, F.lit("verify_failed")),
        F.when((F.col("verification") == "partial") & ~hidden, F.lit("verify_partial")),
        F.when((F.col("quality") == "manual_review") & ~hidden, F.lit("manual_review")),
        F.when(F.col("status") == "error", F.lit("error")),
        F.when(F.col("status") == "duplicate", F.lit("duplicate"))), lambda k: k.isNotNull())


def problems(state: DataFrame) -> DataFrame:
    """Every problem document, one row per kind."""
    return state.select("file_id", "name", F.explode(problem_kind()).alias("kind"))


def list_problems(state: DataFrame, kind: str, n: int = MAX_LIST) -> DataFrame:
    if kind not in PROBLEM_KINDS:
        raise ValueError(f"unknown kind {kind!r}; use one of {PROBLEM_KINDS}")
    return problems(state).filter(F.col("kind") == kind).orderBy("file_id").limit(n)


def requeue(state: DataFrame, chosen: DataFrame, reason: str, budget: int = MAX_REQUEUE) -> DataFrame:
    """Marks at most ``budget`` eligible documents, lowest ids first."""
    eligible = (state.filter(~F.col("status").isin("requeued", "deleted", "duplicate"))
                .join(chosen.select("file_id").distinct(), "file_id", "left_semi")
                .select("file_id").orderBy("file_id").limit(budget).withColumn("_hit", F.lit(True)))
    out = state.join(eligible, "file_id", "left")
    return (out.withColumn("status", F.when(F.col("_hit"), "requeued").otherwise(F.col("status")))
            .withColumn("requeue_reason", F.when(F.col("_hit"), F.lit(reason[:200]))).drop("_hit"))


def health(state: DataFrame) -> DataFrame:
    """One row: red on errors or failed pages, yellow on partial or unread pages, else green."""
    shown = ~F.col("status").isin("deleted", "duplicate")
    return state.agg(
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(shown & (F.col("verification") == "failed")).alias("failed"),
        F.count_if(shown & (F.col("verification") == "partial")).alias("partial"),
        F.count_if(shown & (F.col("quality") == "manual_review")).alias("manual_review"),
    ).withColumn("health", F.when((F.col("errors") > 0) | (F.col("failed") > 0), "red")
                 .when((F.col("partial") > 0) | (F.col("manual_review") > 0), "yellow").otherwise("green"))


def merge_usage(a: Column, b: Column) -> Column:
    """Sum two usage maps key by key."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def pass_statistics(results: DataFrame) -> DataFrame:
    """Counters of one pass: results carry status, verdict, facts_kept, facts_rejected, tokens."""
    return results.agg(
        F.count_if(F.col("status") == "processed").alias("processed"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.col("verdict") == "verified").alias("verify_verified"),
        F.count_if(F.col("verdict") == "partial").alias("verify_partial"),
        F.count_if(F.col("verdict") == "failed").alias("verify_failed"),
        F.coalesce(F.sum("facts_kept"), F.lit(0)).alias("facts_kept"),
        F.coalesce(F.sum("facts_rejected"), F.lit(0)).alias("facts_rejected"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
