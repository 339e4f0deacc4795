"""State graphs of recorded executions: visits, nodes, edges, statistics.

One function serves the environments; where their rules differ, `Variant` says so.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions import identity as I
from trajecta.functions import text as T


@dataclass(frozen=True)
class Variant:
    """What differs between the environments' graphs and retrieval.

    final_state_ok: a success may be joined at its final state, at cost 0. needs_continuity: a success counts only if
    what follows is recorded without a gap. loops: edges that don't change the state are kept. every_node_won: all
    states of a won execution are won, not only its last. self_needs_match: the own success is an alternative only
    where a source success matches. pages: decisions are judged by a shop's rules, not by a parser's.
    """

    final_state_ok: bool = True
    needs_continuity: bool = True
    loops: bool = False
    every_node_won: bool = False
    self_needs_match: bool = False
    pages: bool = False


SCIENCE = Variant()
SHOP = Variant(loops=True, every_node_won=True, pages=True)
HOUSEHOLD = Variant(final_state_ok=False, needs_continuity=False, self_needs_match=True)


def visits(steps: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(task, rep, t, key, loc, ...): T + 1 states of T decisions. The last row of an execution has no decision, so what is
    carried along from the decisions is null there."""
    shared = ["task", "rep", "won", "n", "student", "complete"]
    own = ("positive", *carry)
    kinds = {f.name: f.dataType for f in steps.schema.fields}
    here = F.struct("t", F.col("key_before").alias("key"), F.col("loc_before").alias("loc"), *own)
    final = F.struct((F.col("t") + 1).alias("t"), F.col("key_after").alias("key"), F.col("loc_after").alias("loc"), *(F.lit(None).cast(kinds[c]).alias(c) for c in own))
    # one pass: the last decision gives its own visit and the final one
    both = F.when(F.col("t") == F.col("n") - 1, F.array(here, final)).otherwise(F.array(here))
    return steps.select(*shared, F.explode(both).alias("v")).select(*shared, "v.*")


def continuous(steps: DataFrame) -> DataFrame:
    """Adds `continuous`: from this decision on, each later one shows what the one before it left behind."""
    by_run = Window.partitionBy("task", "rep").orderBy("t")
    ok = F.coalesce(F.lag("feedback").over(by_run) == F.col("observation"), F.lit(True))
    after = by_run.rowsBetween(1, Window.unboundedFollowing)
    return steps.withColumn("ok", ok).withColumn("continuous", F.coalesce(F.every("ok").over(after), F.lit(True))).drop("ok")


def nodes(steps: DataFrame, variant: Variant = SCIENCE) -> DataFrame:
    """One row per task and state: visits, executions, first decision, whether it begins or wins one."""
    wins: Column = F.col("won") if variant.every_node_won else F.col("won") & (F.col("t") == F.col("n"))
    return visits(steps).groupBy("task", "key").agg(F.count("*").alias("n_visits"), F.count_distinct("rep").alias("n_reps"), F.min("t").alias("min_t"), F.max("t").alias("max_t"), F.bool_or(F.col("t") == 0).alias("is_start"), F.bool_or(wins).alias("is_won"))


def kind(steps: DataFrame, variant: Variant = SCIENCE) -> DataFrame:
    """Adds what each decision did: kind, is_binding, is_observation, passive_during_rejection.

    By a parser's rules a change of state comes first, also where the answer rejects the action (then the change is
    passive); by a shop's rules a wrong format comes first, then a rejection.
    """
    did = I.transition(F.col("command"), F.col("shown"), F.col("key_before") != F.col("key_after"), F.col("rejection"), F.col("format_error"))
    rows = steps.select("*", did.alias("did")).select("*", "did.*").drop("did")
    return rows.withColumn("kind", I.shop_kind(F.col("format_error"), F.col("rejection"), F.col("key_before"), F.col("key_after"))) if variant.pages else rows


def edges(steps: DataFrame, variant: Variant = SCIENCE) -> DataFrame:
    """One row per task, source, target and action; without loops only moves to another state."""
    rows = kind(steps, variant)
    moves = rows if variant.loops else rows.where("key_before <> key_after")
    return moves.groupBy("task", F.col("key_before").alias("source"), F.col("key_after").alias("target"), "action").agg(F.count("*").alias("n_members"), F.count_if("positive").alias("n_positive"), F.bool_or(F.col("rejection").isNotNull()).alias("any_rejected"), F.bool_or("passive_during_rejection").alias("passive"), F.min_by("is_observation", F.struct("rep", "t")).alias("observation_with_change"), F.min_by("kind", F.struct("rep", "t")).alias("first_kind"))


def internal_observations(steps: DataFrame) -> DataFrame:
    """Decisions that leave the state as it is; equal actions with equal feedback, up to white space, are merged."""
    return steps.where("key_before = key_after").groupBy("task", F.col("key_before").alias("node"), "action", T.norm(F.col("feedback")).alias("feedback")).agg(F.count("*").alias("n_members"), F.min("t").alias("min_t"))


# The kinds of decisions by a parser's rules.
PARSER_KINDS = ["state_change", "format_invalid", "binding", "internal_observation", "rejection", "unchanged_non_observation"]


def stats(steps: DataFrame) -> DataFrame:
    """One row per task: nodes, edges, visits, kinds, passive changes, won and trusted executions."""
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in PARSER_KINDS]
    per_task = kind(steps).groupBy("task").agg(F.count("*").alias("n_decisions"), *counts, F.count_if("passive_during_rejection").alias("n_passive"), F.count_distinct("rep").alias("n_runs"), F.count_distinct(F.when(F.col("won"), F.col("rep"))).alias("n_won"), F.count_distinct(F.when(F.col("won") & F.col("complete"), F.col("rep"))).alias("n_trusted_won"))
    n_nodes = nodes(steps).groupBy("task").agg(F.count("*").alias("n_nodes"), F.sum("n_visits").alias("n_visits"), F.count_if(F.col("n_reps") >= 2).alias("n_shared"))
    n_edges = edges(steps).groupBy("task").agg(F.count("*").alias("n_edges"))
    return per_task.join(n_nodes, "task").join(n_edges, "task", "left").fillna(0, ["n_edges"])


def coarse_index(steps: DataFrame) -> DataFrame:
    """Coarse states (the action alone) with how many fine states they hold."""
    return visits(steps).withColumn("coarse", F.split_part("key", F.lit("|"), F.lit(1))).groupBy("task", "coarse").agg(F.count_distinct("key").alias("n_strict"), F.array_join(F.array_sort(F.collect_set("key")), ",").alias("strict_keys"))


def shop_stats(steps: DataFrame) -> DataFrame:
    """One row per task: executions, untrusted ones, mean decisions, states of two executions or more, coarse states
    with several strict ones, and visits by page (the first part of a key)."""
    runs = steps.where("t = 0").groupBy("task").agg(F.count("*").alias("n_runs"), F.count_if(~F.col("complete")).alias("n_untrusted"), F.avg(F.col("n").cast("double")).alias("mean_steps"))
    seen = nodes(steps, SHOP).withColumn("coarse", F.split_part("key", F.lit("|"), F.lit(1)))
    shared = seen.groupBy("task").agg(F.count_if(F.col("n_reps") >= 2).alias("n_shared"))
    coarse = seen.groupBy("task", "coarse").agg(F.count("*").alias("n"), F.sum("n_visits").alias("v"))
    pages = coarse.groupBy("task").agg(F.count_if(F.col("n") > 1).alias("n_coarse_groups"), F.array_sort(F.collect_list(F.struct("coarse", "v"))).alias("l"))
    return runs.join(shared, "task").join(pages.select("task", "n_coarse_groups", F.map_from_entries("l").alias("pages")), "task")
