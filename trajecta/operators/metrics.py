"""Evaluation runs: summaries by seed, across seeds, by split, and the choice of a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ["success", "progress", "rounds", "success_rounds", "failure_rounds"]


def by_seed(runs: DataFrame, by: list[str]) -> DataFrame:
    """Per cent of wins, mean best progress (0 at least), mean rounds, and rounds of wins and failures (null if none)."""
    return runs.groupBy(*by).agg(
        F.count("*").alias("n"),
        (F.avg(F.col("won").cast("double")) * 100).alias("success"),
        F.avg(F.greatest(F.col("progress"), F.lit(0.0))).alias("progress"),
        F.avg(F.col("n").cast("double")).alias("rounds"),
        F.avg(F.when(F.col("won"), F.col("n").cast("double"))).alias("success_rounds"),
        F.avg(F.when(~F.col("won"), F.col("n").cast("double"))).alias("failure_rounds"),
    )


def across_seeds(seeds: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """(metric, mean, sample_std): the deviation is null for one seed, and both are null if a seed has no value."""
    long = seeds.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*metrics))).alias("metric", "value"))
    whole = F.count("value") == F.count("*")
    return long.groupBy("metric").agg(F.when(whole, F.avg("value")).alias("mean"), F.when(whole, F.stddev_samp("value")).alias("sample_std"))


def best_checkpoint(scores: DataFrame) -> DataFrame:
    """The step with the highest mean success over its seeds, the earliest of equals; only steps that have all seeds."""
    per_step = scores.groupBy("step").agg(F.avg("success").alias("success"), F.count_distinct("seed").alias("n_seeds"))
    most = scores.agg(F.count_distinct("seed").alias("all_seeds"))
    return per_step.crossJoin(F.broadcast(most)).where("n_seeds = all_seeds").agg(F.min_by(F.struct("step", "success"), F.struct(-F.col("success"), F.col("step"))).alias("b")).select("b.step", "b.success")


def coverage(found: DataFrame, tasks: DataFrame, reps: int) -> DataFrame:
    """(task, rep, n) of the expected grid of tasks and repetitions where exactly one result is not what there is."""
    grid = tasks.select("task").distinct().select("task", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))).alias("rep")) if reps else tasks.limit(0)
    counted = found.groupBy("task", "rep").agg(F.count("*").alias("n"))
    both = grid.withColumn("expected", F.lit(True)).join(counted, ["task", "rep"], "full")
    return both.select("task", "rep", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("expected", F.lit(False)).alias("expected")).where("n <> 1 OR NOT expected")


def episode_metrics(steps: DataFrame, runs: DataFrame, full_score: float = 100.0, must_end: bool = False, tolerance: float = 0.0) -> DataFrame:
    """(task, rep, best_score, final_score, length, won, n_format_errors, n_rejections) of each execution.

    steps: task, rep, t, score, done, format_error, rejection; runs: task, rep, initial_score. The best score is the
    largest ever seen, the first one included. A household or science task is won by its final score, a shop's
    (must_end) only if it also ended; the score may fall short by the tolerance. An execution without decisions has the
    initial score, and isn't won unless that is enough.
    """
    said = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    own = steps.groupBy("task", "rep").agg(F.max("score").alias("top"), F.max_by(F.struct("score", "done"), "t").alias("last"), F.count("*").alias("length"), F.count_if(said("format_error")).alias("n_format_errors"), F.count_if(said("rejection")).alias("n_rejections"))
    rows = runs.select("task", "rep", "initial_score").join(own, ["task", "rep"], "left")
    final = F.when(F.col("last").isNotNull(), F.col("last.score")).otherwise(F.col("initial_score"))
    ended = F.coalesce(F.col("last.done"), F.lit(False)) if must_end else F.lit(True)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.select("task", "rep", F.greatest("initial_score", "top").alias("best_score"), final.alias("final_score"), zero("length"), (ended & F.coalesce(final >= full_score - tolerance, F.lit(False))).alias("won"), zero("n_format_errors"), zero("n_rejections"))


def several_settings(found: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, first, last) of the columns, such as the model and the backend, in which results differ that are
    to be summarised together; a null counts as a value."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    long = found.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), text(c).alias("value")) for c in columns))).alias("x")).select("x.*")
    return long.groupBy("column").agg(F.count_distinct("value").alias("n"), F.min("value").alias("first"), F.max("value").alias("last")).where("n > 1")
