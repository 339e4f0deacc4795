"""Evidence retrieval: for each decision of a new execution, what earlier ones did from the same state.

Candidates are reduced to the best one of each task and state before any join with the decisions, which is legal since
their rank doesn't depend on the decision; so a state that all executions share doesn't multiply rows. States are matched
by locators (key and parser), and a state without one matches nothing; sources count by whether they are trusted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions.identity import source_label
from trajecta.operators.attempts import trust
from trajecta.operators.graph import SCIENCE, Variant, continuous, visits


def judged() -> Column:
    """The trust in a source: its replay was complete and it won, or didn't."""
    return trust(F.col("complete"), F.col("won"), F.lit(None).cast("boolean"), F.lit(False))


def source_visits(steps: DataFrame, variant: Variant = SCIENCE) -> DataFrame:
    """Visits of the sources with `cost` to their end and `eligible`: a success may be followed from here."""
    own = steps.where(~F.col("student"))
    seen = visits(continuous(own), ("continuous",)) if variant.needs_continuity else visits(own).withColumn("continuous", F.lit(True))
    final = F.col("t") == F.col("n")
    follows = F.coalesce(F.col("continuous"), F.lit(True)) & F.when(final, F.lit(variant.final_state_ok)).otherwise(F.col("positive"))
    return seen.withColumn("cost", F.col("n") - F.col("t")).withColumn("eligible", judged()["successful"] & follows)


def best_candidates(steps: DataFrame, variant: Variant = SCIENCE) -> DataFrame:
    """One row per task and locator: visits, and the best eligible success as (cost, rep, t), null if there is none."""
    return source_visits(steps, variant).where("loc IS NOT NULL").groupBy("task", "loc").agg(F.count("*").alias("n_visits"), F.count_if("eligible").alias("n_candidates"), F.min(F.when(F.col("eligible"), F.struct("cost", "rep", "t"))).alias("best"))


def matched(steps: DataFrame, variant: Variant = SCIENCE) -> DataFrame:
    """Each decision of the new executions with the best candidate of its state."""
    return steps.where("student").join(best_candidates(steps, variant).withColumnRenamed("loc", "loc_before"), ["task", "loc_before"], "left")


CASES = {True: ("matched_success_suffix", "matched_no_recorded_success", "outside_self_success", "outside_student_failure"), False: ("graph_inside_with_success_suffix", "graph_inside_without_usable_success_suffix", "graph_outside_student_succeeded", "graph_outside_student_failed")}


def case_of(variant: Variant) -> Column:
    a, b, c, d = CASES[variant.self_needs_match]
    return F.when(F.col("best").isNotNull(), a).when(F.col("n_visits").isNotNull(), b).when(F.col("won"), c).otherwise(d)


def chosen(rows: DataFrame, variant: Variant = SCIENCE) -> DataFrame:
    """Decisions from matched() with `case` and `chosen`: the success to follow as (cost, is_self, rep, at)."""
    rows = rows.withColumn("own_cost", F.col("n") - F.col("t"))
    source = F.struct(F.col("best.cost").alias("cost"), F.lit(0).alias("is_self"), F.col("best.rep").alias("rep"), F.col("best.t").alias("at"))
    own = F.struct(F.col("own_cost").alias("cost"), F.lit(1).alias("is_self"), F.lit(-1).cast("long").alias("rep"), F.col("t").alias("at"))
    source, own = F.when(F.col("best").isNotNull(), source), F.when(F.col("won") & (F.col("best").isNotNull() if variant.self_needs_match else F.lit(True)), own)
    return rows.withColumn("chosen", F.when(source.isNull() | (own < source), own).otherwise(source)).withColumn("case", case_of(variant))


def _choice() -> list[Column | str]:
    said = F.when(F.col("chosen").isNotNull(), F.when(F.col("chosen.is_self") == 1, "student_self").otherwise("source"))
    return ["task", "rep", "t", "case", F.col("chosen.cost").alias("selected_cost"), said.alias("selected"), F.col("chosen.rep").alias("selected_rep"), F.col("chosen.at").alias("selected_at")]


def four_case(steps: DataFrame, variant: Variant = SCIENCE) -> DataFrame:
    """The case of each decision and the success chosen for it: a source's, or the rest of the own execution.

    Order of choice: cost, own after others, rep, place. In the household variant the own rest competes only with a
    matching source success, and wins only if it is shorter.
    """
    return chosen(matched(steps, variant), variant).select(*_choice())


def four_case_summary(steps: DataFrame, variant: Variant = SCIENCE) -> DataFrame:
    rows = four_case(steps, variant)
    return rows.groupBy("case").agg(F.count("*").alias("n_steps"), F.coalesce(F.sum("selected_cost"), F.lit(0)).cast("long").alias("sum_cost"), F.count_if(F.col("selected") == "student_self").alias("n_self"))


def anchored(rows: DataFrame) -> DataFrame:
    """Decisions from matched() with `a`: the latest state up to each from which a success is known, and the best there.

    A backward as-of join: states met the reduced candidates in one equi-join, and a running last non-null value looks
    back.
    """
    back = Window.partitionBy("task", "rep").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.when(F.col("best").isNotNull(), F.struct(F.col("t").alias("anchor_t"), F.col("best.cost").alias("cost"), F.col("best.rep").alias("source_rep"), F.col("best.t").alias("source_t")))
    return rows.withColumn("a", F.last(here, ignorenulls=True).over(back))


def success_anchor(steps: DataFrame, variant: Variant = SCIENCE) -> DataFrame:
    """The latest state up to each decision from which a success is known, and the best success there."""
    return anchored(matched(steps, variant)).select("task", "rep", "t", "a.*")


def failure_anchor(steps: DataFrame) -> DataFrame:
    """The latest state up to each decision that a failed source was in, and the failed visit nearest to it in time;
    ties go to the shorter execution, then rep, then place."""
    failed = visits(steps.where(~F.col("student") & judged()["failed"])).where("loc IS NOT NULL")
    # of the visits of one place in time only the first counts; places are bounded by the length of executions, so the
    # ones of a state fit an array, and a decision meets one row however many failures share its state
    reduced = failed.groupBy("task", F.col("loc").alias("loc_before"), F.col("t").alias("source_t")).agg(F.min(F.struct(F.col("n").alias("cost"), F.col("rep").alias("source_rep"))).alias("f"))
    places = reduced.groupBy("task", "loc_before").agg(F.collect_list(F.struct("source_t", "f.cost", "f.source_rep")).alias("places"))
    near = F.array_min(F.transform("places", lambda p: F.struct(F.abs(p["source_t"] - F.col("t")).alias("apart"), p["cost"].alias("cost"), p["source_rep"].alias("source_rep"), p["source_t"].alias("source_t"))))
    best = steps.where("student").select("task", "rep", "t", "loc_before").join(places, ["task", "loc_before"], "left").withColumn("f", near)
    back = Window.partitionBy("task", "rep").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.when(F.col("f").isNotNull(), F.struct(F.col("t").alias("anchor_t"), "f.apart", "f.cost", "f.source_rep", "f.source_t"))
    return best.withColumn("a", F.last(here, ignorenulls=True).over(back)).select("task", "rep", "t", "a.*")


def fallbacks(runs: DataFrame, variant: Variant = SCIENCE) -> DataFrame:
    """Per task, what serves where no state is shared: the shortest success that can be followed from its start, and the
    shortest failure. runs: task, rep, n, won, student, complete, positive (of the first decision), continuous."""
    sources = runs.where(~F.col("student")).withColumn("j", judged())
    best = F.struct(F.col("n").alias("cost"), "rep")
    whole = F.col("positive") & (F.col("continuous") if variant.needs_continuity else F.lit(True))
    out = sources.groupBy("task").agg(F.min(F.when(F.col("j.successful") & whole, best)).alias("s"), F.min(F.when(F.col("j.failed"), best)).alias("f"))
    return out.select("task", F.col("s.cost").alias("success_cost"), F.col("s.rep").alias("success_rep"), F.col("f.cost").alias("failure_cost"), F.col("f.rep").alias("failure_rep"))


def starts(steps: DataFrame) -> DataFrame:
    """One row per execution, its first decision, as fallbacks() takes them."""
    return continuous(steps).where("t = 0")


def references(steps: DataFrame, variant: Variant = SCIENCE) -> DataFrame:
    """(task, rep, t, role, source_rep, source_at): what is shown with each decision.

    Selected success; a historical one only where no source success matches; a failure in the two cases without a
    success to follow. A decision outside the graph in a won execution shows its own success only. A source named
    twice is shown once, in its first role.
    """
    keys = ["task", "rep", "t"]
    # the cases and both looks back share one matching of states; only failures are matched on their own
    own = chosen(anchored(matched(steps, variant)), variant).select(*_choice(), F.col("a.source_rep").alias("h_rep"), F.col("a.source_t").alias("h_at"))
    rows = own.join(failure_anchor(steps).select(*keys, F.col("source_rep").alias("f_rep"), F.col("source_t").alias("f_at")), keys).join(fallbacks(starts(steps), variant), "task", "left")
    inside, without, outside_won, outside_failed = (F.col("case") == c for c in CASES[variant.self_needs_match])
    failing = without | outside_failed
    shown = F.array(
        F.struct(F.lit("selected").alias("role"), F.when(F.col("selected") == "source", F.col("selected_rep")).when(F.col("selected") == "student_self", F.lit(-1)).cast("long").alias("source_rep"), F.col("selected_at").alias("source_at")),
        F.struct(F.lit("historical").alias("role"), F.when(~inside & ~outside_won, F.coalesce("h_rep", "success_rep")).alias("source_rep"), F.coalesce("h_at", F.lit(0).cast("long")).alias("source_at")),
        F.struct(F.lit("failure").alias("role"), F.when(failing, F.coalesce("f_rep", "failure_rep")).alias("source_rep"), F.coalesce("f_at", F.lit(0).cast("long")).alias("source_at")),
    )
    listed = rows.select(*keys, F.posexplode(shown).alias("ord", "r")).where("r.source_rep IS NOT NULL").select(*keys, "ord", "r.*")
    first = Window.partitionBy(*keys, "source_rep").orderBy("ord")
    return listed.withColumn("k", F.row_number().over(first)).where("k = 1").select(*keys, "role", "source_rep", "source_at")


# How a failed source is related to a decision.
HERE, EARLIER, SAME_TASK = "current_exact_visit", "latest_shared_student_history_visit", "same_task_only_no_reliable_shared_anchor"


def scopes(steps: DataFrame, variant: Variant = SCIENCE) -> DataFrame:
    """What the sentences about a decision's choice need: (task, rep, t, case, outside, selected, selected_cost,
    selected_rep, selected_at, historical, demonstrated, failure); see records.scope_explained."""
    keys = ["task", "rep", "t"]
    own = chosen(anchored(matched(steps, variant)), variant).select(*_choice(), F.col("loc_before").isNull().alias("outside"), F.col("a.anchor_t").alias("h_t"), F.col("a.source_rep").alias("h_rep"), F.col("a.source_t").alias("h_at"))
    failed = failure_anchor(steps).select(*keys, F.col("anchor_t").alias("f_t"), F.col("source_rep").alias("f_rep"), F.col("source_t").alias("f_at"))
    known = starts(steps)
    claims = known.where("NOT student").groupBy("task").agg(F.bool_or("won").alias("demonstrated"))
    rows = own.join(failed, keys).join(fallbacks(known, variant), "task", "left").join(claims, "task", "left")
    inside, without, outside_won, outside_failed = (F.col("case") == c for c in CASES[variant.self_needs_match])
    label = lambda rep: source_label(F.lit("teacher"), rep)
    h_rep, f_rep = F.coalesce("h_rep", "success_rep"), F.coalesce("f_rep", "failure_rep")
    historical = F.when(~inside & ~outside_won & h_rep.isNotNull(), F.struct(F.col("h_t").alias("anchor_t"), label(h_rep).alias("label"), F.coalesce("h_at", F.lit(0).cast("long")).alias("source_t")))
    relation = F.when(F.col("f_t") == F.col("t"), HERE).when(F.col("f_t").isNotNull(), EARLIER).otherwise(SAME_TASK)
    failure = F.when((without | outside_failed) & f_rep.isNotNull(), F.struct(label(f_rep).alias("label"), relation.alias("relation"), F.col("f_t").alias("anchor_t"), F.col("f_at").alias("source_t")))
    return rows.select(*keys, "case", "outside", "selected", "selected_cost", "selected_rep", "selected_at", historical.alias("historical"), F.coalesce("demonstrated", F.lit(False)).alias("demonstrated"), failure.alias("failure"))
