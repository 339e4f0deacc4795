"""Attempts and what became of them: alignment with committed decisions, merged events, trust, costs, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions.identity import proposed_action

RUN = ["task", "rep"]
# The integrity errors of a source, in the order in which they are looked for.
NO_SLOT, OUTSIDE, NOT_COVERED = "attempt_without_step_slot", "accepted_attempt_outside_steps", "attempts_do_not_cover_steps"


def trust(complete: Column, won: Column, trusted_success: Column, source_won: Column) -> Column:
    """struct(trusted, successful, failed, score). Only a trusted source is a success or a failure; a failure must
    not have been recorded as won either; the score is 1 or 0, never a part."""
    trusted = complete.eqNullSafe(True)
    success = trusted & won.eqNullSafe(True) & F.coalesce(trusted_success, F.lit(True))
    failed = trusted & won.eqNullSafe(False) & ~F.coalesce(source_won, F.lit(False))
    return F.struct(trusted.alias("trusted"), success.alias("successful"), failed.alias("failed"), success.cast("double").alias("score"))


def aligned(steps: DataFrame, attempts: DataFrame) -> DataFrame:
    """Each decision with `n_accepted` and whether its one accepted attempt has its raw output.

    steps: task, rep, t, raw_output; attempts: task, rep, step (from 1), type, raw_output. Attempts are reduced to one
    row a decision before the join, so a decision that was tried very often multiplies nothing.
    """
    accepted = attempts.where("type = 'accepted'").groupBy(*RUN, (F.col("step") - 1).alias("t")).agg(F.count("*").alias("n_accepted"), F.min("raw_output").alias("accepted_output"))
    joined = steps.join(accepted, [*RUN, "t"], "left")
    return joined.select(*RUN, "t", F.coalesce("n_accepted", F.lit(0)).alias("n_accepted"), ((F.coalesce("n_accepted", F.lit(0)) == 1) & F.col("accepted_output").eqNullSafe(F.col("raw_output"))).alias("aligned"))


def verified_prefix(rows: DataFrame, ok: str = "aligned") -> DataFrame:
    """The decisions up to which every one held, with `restored` for the others."""
    upto = Window.partitionBy(*RUN).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("restored", F.bool_and(ok).over(upto))


def merged(steps: DataFrame, attempts: DataFrame) -> DataFrame:
    """All events of each execution in order: attempts, of which accepted ones show the committed decision.

    An execution without attempts has its decisions as events, with what was wrong with them as their reason. steps may
    have semantic_action (what a number of a menu stood for), format_error and rejection. error: why an execution can't be
    read, null if it can.
    """
    for c in ("semantic_action", "format_error", "rejection"):
        steps = steps if c in steps.columns else steps.withColumn(c, F.lit(None).cast("string"))
    n = steps.groupBy(*RUN).agg(F.count("*").alias("n"))
    own = Window.partitionBy(*RUN)
    placed = attempts.join(n, RUN).withColumn("source_step", F.col("step") - 1).withColumn("committed", F.col("type") == "accepted")
    inside = F.col("committed") & F.col("source_step").between(0, F.col("n") - 1)
    error = F.when(F.count_if(F.col("step").isNull()).over(own) > 0, NO_SLOT).when(F.count_if(F.col("committed") & ~inside).over(own) > 0, OUTSIDE).when(F.size(F.collect_set(F.when(inside, F.col("source_step"))).over(own)) != F.col("n"), NOT_COVERED)
    tried = placed.withColumn("error", error)
    committed = steps.select(*RUN, F.col("t").alias("source_step"), F.col("action").alias("step_action"), F.col("semantic_action").alias("step_binding"), F.col("observation"), F.col("feedback").alias("step_feedback"))
    tried = tried.join(committed, [*RUN, "source_step"], "left")
    shown = F.when(F.col("committed"), F.col("step_action")).otherwise(proposed_action(F.col("action"), F.col("raw_output")))
    events = tried.select(*RUN, "seq", "source_step", F.when(F.col("committed"), "committed").otherwise(F.coalesce("type", F.lit("noncommitted"))).alias("kind"), "committed", shown.alias("action"), F.when(F.col("committed"), F.col("step_binding")).alias("semantic_action"), F.when(F.col("committed"), F.col("observation")).alias("observation_before"), F.when(F.col("committed"), F.col("step_feedback")).otherwise(F.col("feedback")).alias("feedback"), F.when(~F.col("committed"), F.col("reason")).alias("reason"), "error")
    plain = steps.join(attempts.select(*RUN).distinct(), RUN, "left_anti")
    plain = plain.select(*RUN, F.col("t").alias("seq"), F.col("t").alias("source_step"), F.lit("committed").alias("kind"), F.lit(True).alias("committed"), "action", "semantic_action", F.col("observation").alias("observation_before"), "feedback", F.coalesce("format_error", "rejection").alias("reason"), F.lit(None).cast("string").alias("error"))
    return events.unionByName(plain)


def collection_cost(starts: DataFrame, attempts: DataFrame) -> DataFrame:
    """(task, rep, start, committed_cost, attempts): attempts recorded from a place on, for its whole rest; null if
    some attempt has no place, or fewer were recorded than decisions.

    starts: task, rep, start, committed_cost. Counted once per execution as a running sum from the end, so places of one
    execution share the work.
    """
    rest = Window.partitionBy(*RUN).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = F.bool_and(F.col("step").isNotNull()).over(Window.partitionBy(*RUN))
    counts = attempts.withColumn("whole", whole).groupBy(*RUN, "step", "whole").agg(F.count("*").alias("c")).withColumn("from_here", F.sum("c").over(rest))
    # the first recorded place at or after a start holds the count of all from there
    places = counts.where("whole").groupBy(*RUN).agg(F.array_sort(F.collect_list(F.struct("step", "from_here"))).alias("p"))
    later = F.filter("p", lambda x: x["step"] >= F.col("start") + 1)
    found = F.when(F.col("p").isNotNull(), F.coalesce(F.try_element_at(later, F.lit(1))["from_here"], F.lit(0)))
    return starts.join(places, RUN, "left").select(*RUN, "start", "committed_cost", F.when(found >= F.col("committed_cost"), found).alias("attempts"))


def raw_success(manifest: DataFrame, graph: DataFrame) -> DataFrame:
    """Per task, the whole recorded success to fall back on: (task, rep, n_attempts), the fewest attempts first.

    manifest: task, rep, source_won, expected_missing, readable, n_attempts; graph: the same of replayed sources. A source
    that the manifest names isn't taken from the graph as well.
    """
    named = manifest.where("source_won AND NOT coalesce(expected_missing, false)")
    more = graph.where("source_won").join(named.select("task", "rep"), ["task", "rep"], "left_anti")
    columns = ["task", "rep", "readable", "n_attempts"]
    every = named.select(*columns).unionByName(more.select(*columns)).where("readable")
    return every.groupBy("task").agg(F.min(F.struct("n_attempts", "rep")).alias("b")).select("task", "b.rep", "b.n_attempts")


def raw_failure(manifest: DataFrame, graph: DataFrame) -> DataFrame:
    """Per task, the first readable recorded failure by rep."""
    named = manifest.where("NOT source_won AND NOT coalesce(expected_missing, false)")
    every = named.select("task", "rep", "readable").unionByName(graph.where("NOT source_won").select("task", "rep", "readable"))
    return every.where("readable").groupBy("task").agg(F.min("rep").alias("rep"))


def task_best(runs: DataFrame) -> DataFrame:
    """The best trusted win of each task: score, then fewest decisions, then rep."""
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("n").alias("cost"), F.col("rep").alias("rep")))
    return runs.where("trusted AND won").groupBy("task").agg(best.alias("b")).select("task", "b.rep", "b.cost")


def terminal_failure(steps: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The note for the last decision of an execution that it ended in failure: done, before the limit of decisions,
    with a score under 0. An inconsistent record has an error and no note.

    outcomes: task, rep, done, limit_reached, final_score, won, decision_count, technical_incomplete; steps: task, rep, t,
    action, score.
    """
    last = steps.groupBy(*RUN).agg(F.max(F.struct("t", "action", "score")).alias("l"), F.count("*").alias("n"))
    rows = outcomes.join(last, RUN, "left")
    asked = ~F.coalesce("technical_incomplete", F.lit(False)) & F.col("done").eqNullSafe(True) & F.col("limit_reached").eqNullSafe(False)
    finite = F.col("final_score").isNotNull() & ~F.isnan("final_score") & (F.abs("final_score") < float("inf"))
    failed = (F.col("final_score") < 0) & ~F.col("won").eqNullSafe(True)
    fits = F.col("won").eqNullSafe(False) & F.col("n").eqNullSafe(F.col("decision_count")) & F.col("l.score").eqNullSafe(F.col("final_score")) & (F.trim(F.coalesce("l.action", F.lit(""))) != "")
    error = F.when(asked & ~finite, "terminal annotation requires a finite recorded final score").when(asked & failed & ~fits, "inconsistent recorded terminal failure")
    # Fixed value: the sentence that begins the note.
    note = F.format_string('CURRENT ACTION AND ITS OBSERVED CONSEQUENCE: The recorded action "%s" immediately ended this task with FAILURE (score %s).', F.col("l.action"), F.regexp_replace(F.col("final_score").cast("string"), r"\.0$", ""))
    return rows.select(*RUN, F.when(asked & finite & failed & fits, note).alias("note"), error.alias("error"))


def attempt_counts(attempts: DataFrame) -> DataFrame:
    """A10: (task, rep, n_attempts, n_accepted, n_retried, types): attempts of each execution, decisions that took more
    than one, and how often each type was recorded."""
    by_type = attempts.groupBy(*RUN, F.coalesce("type", F.lit("(none)")).alias("type")).agg(F.count("*").alias("c"))
    types = by_type.groupBy(*RUN).agg(F.sum("c").alias("n_attempts"), F.sum(F.when(F.col("type") == "accepted", F.col("c")).otherwise(0)).alias("n_accepted"), F.array_sort(F.collect_list(F.struct("type", "c"))).alias("l"))
    retried = attempts.groupBy(*RUN, "step").agg(F.count("*").alias("c")).groupBy(*RUN).agg(F.count_if(F.col("c") > 1).alias("n_retried"))
    return types.join(retried, RUN).select(*RUN, "n_attempts", "n_accepted", "n_retried", F.map_from_entries("l").alias("types"))
