"""Verified replays and rolled-back attempts: what of a recorded execution may be trusted, and the graph with its branches.

An attempt that was rejected hangs on the committed prefix that the environment was brought back to; nothing follows it.
A replay that differs cuts the execution at the prefix, and with it the later decisions and the branches on them. Since
attempts are replayed in order and the cut only ever moves back, it is a running minimum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions import identity as I
from trajecta.operators.graph import PARSER_KINDS, kind, visits

RUN = ["task", "rep"]
# Failures of a replay that don't begin at the decision they are found at, and what became of attempts.
NO_START, TOO_EARLY = "initial_observation_mismatch", "terminal_before_source_end"
OUTSIDE, FORMAT, UNKNOWN_TYPE = "outside_trusted_prefix", "verified_no_environment_step_by_source_protocol", "uncompleted_or_unknown_attempt_type"
BRANCH, DIFFERS = "verified_independent_rolled_back_branch", "attempt_replay_mismatch"
ATTEMPT_FAILED = "attempt_or_restore_mismatch"
#: Executions whose members share a page.
PAGE = 64


def committed(steps: DataFrame) -> DataFrame:
    """(task, rep, n, upto, failure): decisions, how many of them a replay confirms in a row, and why not the next one.

    steps: task, rep, t, failure (null if the replay shows what was recorded). A replay that ends early confirms the
    decision that ended it; one that begins with another observation has no state at all (upto is -1).
    """
    held = F.when(F.col("failure") == TOO_EARLY, F.col("t") + 1).when(F.col("failure") == NO_START, -1).otherwise(F.col("t"))
    first = F.min(F.when(F.col("failure").isNotNull(), F.struct("t", held.alias("upto"), "failure")))
    out = steps.groupBy(*RUN).agg(F.count("*").alias("n"), first.alias("f"))
    return out.select(*RUN, "n", F.coalesce("f.upto", "n").alias("upto"), F.col("f.failure").alias("failure"))


def audited(steps: DataFrame, attempts: DataFrame) -> DataFrame:
    """(task, rep, seq, prefix, type, status, cut) of all attempts that weren't accepted; cut: where the execution
    ends once all are replayed.

    attempts: task, rep, seq (their order), step (from 1), type, same (whether the replay of prefix and attempt shows what
    was recorded). A wrong format needs no replay; of any other type than a rejection it isn't known what it did.
    """
    tried = attempts.where("type <> 'accepted'").join(committed(steps).select(*RUN, "upto"), RUN)
    prefix = F.coalesce(F.col("step"), F.lit(0)) - 1
    known = F.col("type").isin("format_invalid", "environment_rejection")
    cuts = (prefix >= 0) & (~known | ((F.col("type") == "environment_rejection") & ~F.col("same")))
    rows = tried.select(*RUN, "seq", "type", "same", "upto", prefix.alias("prefix"), F.when(cuts, prefix).alias("at"))
    before = Window.partitionBy(*RUN).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.least(F.col("upto"), F.min("at").over(before))
    status = F.when((F.col("prefix") < 0) | (F.col("prefix") > so_far), OUTSIDE).when(F.col("type") == "format_invalid", FORMAT).when(F.col("type") != "environment_rejection", UNKNOWN_TYPE).when(F.col("same"), BRANCH).otherwise(DIFFERS)
    return rows.select(*RUN, "seq", "prefix", "type", status.alias("status"), F.least(F.col("upto"), F.min("at").over(Window.partitionBy(*RUN))).alias("cut"))


def kept_branches(audit: DataFrame) -> DataFrame:
    """The attempts that stay: verified, and on a prefix that stays."""
    return audit.where(F.col("status").isin(FORMAT, BRANCH) & (F.col("prefix") <= F.col("cut")))


def records(steps: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row per execution: what was recorded, what a replay lets stand, and why the rest doesn't."""
    audit = audited(steps, attempts)
    tried = audit.groupBy(*RUN).agg(F.min("cut").alias("cut"), F.count_if(F.col("status").isin(FORMAT, BRANCH) & (F.col("prefix") <= F.col("cut"))).alias("n_branches"), F.count_if(F.col("status") == DIFFERS).alias("n_differ"), F.count_if(F.col("status") == OUTSIDE).alias("n_outside"))
    rows = committed(steps).join(tried, RUN, "left")
    cut = F.coalesce("cut", "upto")
    n_failures = F.col("failure").isNotNull().cast("long") + F.coalesce("n_differ", F.lit(0))
    return rows.select(*RUN, F.col("n").alias("n_source"), F.greatest(cut, F.lit(0)).alias("n_steps"), (cut + 1).alias("n_states"), F.coalesce("n_branches", F.lit(0)).alias("n_branches"), F.coalesce("n_outside", F.lit(0)).alias("n_outside"), n_failures.alias("n_failures"), "failure", ((cut == F.col("n")) & (n_failures == 0)).alias("trusted_complete"))


def trusted_steps(steps: DataFrame, record: DataFrame) -> DataFrame:
    """The decisions that stay, with `complete` as the replay has it and `n` as many as there are left."""
    kept = record.select(*RUN, "n_steps", "trusted_complete")
    return steps.join(kept, RUN).where("t < n_steps").withColumn("complete", F.col("trusted_complete")).withColumn("n", F.col("n_steps")).drop("n_steps", "trusted_complete")


def branch_table(steps: DataFrame, audit: DataFrame, tried: DataFrame) -> DataFrame:
    """One row per branch that stays: where it hangs, what it did, and how many observations came before its parent.

    steps: all decisions, as graph.kind gives them, with n_prior; tried: task, rep, seq, command, shown,
    rejection, format_error, key_changed (the state it led to, null if it changed nothing).
    """
    own = kept_branches(audit).join(tried, [*RUN, "seq"])
    # the state a prefix leads to is the one before the next decision, also where that decision doesn't stay
    parents = steps.select(*RUN, F.col("t").alias("prefix"), F.col("key_before").alias("before"), "n_prior")
    ends = steps.where(F.col("t") == F.col("n") - 1).select(*RUN, F.col("n").alias("prefix"), F.col("key_after").alias("before"), F.lit(0).cast("long").alias("n_prior"))
    rows = own.join(parents.unionByName(ends), [*RUN, "prefix"])
    rows = rows.withColumn("key_before", F.col("before")).withColumn("key_after", F.coalesce("key_changed", "before"))
    done = kind(rows).withColumn("physical_changed", F.col("key_before") != F.col("key_after"))
    prior = F.when(F.col("prefix") < F.col("cut"), F.col("n_prior")).otherwise(0)
    return done.select(*RUN, "seq", "prefix", F.col("key_before").alias("source"), F.col("key_after").alias("target"), "command", "kind", "is_observation", "passive_during_rejection", "physical_changed", prior.alias("n_prior"), "status")


def _first(*place: Column) -> Column:
    return F.min(F.struct(*place))


def lone_starts(steps: DataFrame, record: DataFrame) -> DataFrame:
    """(task, rep, key): the first state of executions of which no decision stays."""
    return steps.where("t = 0").join(record.where("n_steps = 0 AND n_states = 1").select(*RUN), RUN).select(*RUN, F.col("key_before").alias("key"))


def members(steps: DataFrame, lone: DataFrame, branches: DataFrame) -> DataFrame:
    """(task, key, rep, phase, place, tag): every appearance of a state, committed ones first, then those of branches."""
    seen = visits(steps).select(*RUN, "key", "t").unionByName(lone.withColumn("t", F.lit(0).cast("long")))
    seen = seen.select("task", "key", "rep", F.lit(0).alias("phase"), F.col("t").alias("place"), F.lit(0).alias("tag"))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("tag"), F.col("source").alias("key")), F.struct(F.lit(1).alias("tag"), F.col("target").alias("key"))))
    hung = branches.select("task", "rep", F.col("seq").alias("place"), sides.alias("s")).select("task", "s.key", "rep", F.lit(1).alias("phase"), "place", "s.tag")
    return seen.unionByName(hung)


def nodes(steps: DataFrame, lone: DataFrame, branches: DataFrame) -> DataFrame:
    """A1 with branches: one row per task and state, numbered by first appearance; a branch's states are no starts."""
    ends = steps.where(F.col("t") == F.col("n") - 1).where("won AND complete").select("task", F.col("key_after").alias("key")).distinct().withColumn("is_won", F.lit(True))
    found = members(steps, lone, branches).groupBy("task", "key").agg(F.count_if(F.col("phase") == 0).alias("n_visits"), F.count_if(F.col("phase") == 1).alias("n_rolled_back"), F.bool_or((F.col("phase") == 0) & (F.col("place") == 0)).alias("is_start"), _first(F.col("phase"), F.col("rep"), F.col("place"), F.col("tag")).alias("first"))
    number = F.row_number().over(Window.partitionBy("task").orderBy("first")) - 1
    return found.join(ends, ["task", "key"], "left").select("task", "key", F.concat(F.lit("N"), number.cast("string")).alias("id"), "n_visits", "n_rolled_back", "is_start", F.coalesce("is_won", F.lit(False)).alias("is_won"))


def edges(steps: DataFrame, branches: DataFrame) -> DataFrame:
    """A3 with branches: one row per task, source, target and command of moves, numbered by first appearance."""
    own = kind(steps).where("key_before <> key_after").select("task", F.col("key_before").alias("source"), F.col("key_after").alias("target"), "command", "rep", F.lit(0).alias("phase"), F.col("t").alias("place"), "positive", "passive_during_rejection", "is_observation")
    hung = branches.where("source <> target").select("task", "source", "target", "command", "rep", F.lit(1).alias("phase"), F.col("seq").alias("place"), F.lit(False).alias("positive"), "passive_during_rejection", "is_observation")
    place = F.struct("phase", "rep", "place")
    found = own.unionByName(hung).groupBy("task", "source", "target", "command").agg(F.count("*").alias("n_members"), F.count_if("positive").alias("n_positive"), F.count_if(F.col("phase") == 1).alias("n_rolled_back"), F.bool_or("passive_during_rejection").alias("passive"), F.min_by("is_observation", place).alias("observation_with_change"), F.min(place).alias("first"))
    number = F.row_number().over(Window.partitionBy("task").orderBy("first")) - 1
    return found.withColumn("id", F.concat(F.lit("E"), number.cast("string"))).drop("first")


def member_pages(steps: DataFrame, lone: DataFrame, branches: DataFrame) -> DataFrame:
    """A1: (task, key, page, members): a state's appearances in order, as `rep:place`, in pages of PAGE executions each, so
    no list is longer than what so many executions hold, however often the state appears."""
    said = F.concat_ws(":", F.col("rep"), F.when(F.col("phase") == 0, F.concat(F.lit("t"), "place")).otherwise(F.concat(F.lit("a"), F.col("place"), F.when(F.col("tag") == 0, "-").otherwise("+"))))
    listed = F.array_sort(F.collect_list(F.struct("rep", "phase", "place", "tag", said.alias("said"))))
    pages = members(steps, lone, branches).groupBy("task", "key", F.floor(F.col("rep") / PAGE).alias("page")).agg(listed.alias("l"))
    return pages.select("task", "key", "page", F.transform("l", lambda x: x["said"]).alias("members"))


def stats(steps: DataFrame, branches: DataFrame) -> DataFrame:
    """Per task, the records of decisions: committed, of branches, and of each kind."""
    rows = kind(steps).select("task", "kind", F.lit(False).alias("hung")).unionByName(branches.select("task", "kind", F.lit(True).alias("hung")))
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in PARSER_KINDS]
    return rows.groupBy("task").agg(F.count("*").alias("decision_records"), F.count_if(~F.col("hung")).alias("committed_decision_records"), F.count_if("hung").alias("attempt_branch_records"), *counts)


def rejected_attempts(rows: DataFrame) -> DataFrame:
    """The tried commands of attempts with their answers, as branch_table takes them; `reason` counts before what the
    answer says."""
    from trajecta.functions import text as T

    shown = F.when(F.col("type") != "format_invalid", F.col("shown"))
    rejection = F.when(F.col("type") != "format_invalid", F.coalesce("reason", T.rejection(F.col("shown"))))
    error = F.when(F.col("type") == "format_invalid", F.coalesce("reason", F.lit("recorded_format_invalid")))
    return rows.select(*RUN, "seq", F.when(F.col("type") != "format_invalid", I.proposed_action(F.col("command"), F.col("raw_output"))).alias("command"), shown.alias("shown"), rejection.alias("rejection"), error.alias("format_error"), F.when(F.col("type") != "format_invalid", F.col("key_changed")).alias("key_changed"))
