"""Executions written out as evidence, line by line, and the sentences that explain a choice.

Lines are rows, so what was shown before is found by windows; a text is put together per execution, and only the marks of
the scored decision differ between the decisions of one execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions import text as T
from trajecta.functions.identity import shown_action, source_label

RUN = ["task", "rep"]
# The sentences of a record, which readers of other records know in this form.
NOTHING = "[No observation/feedback was recorded for this event.]"
NO_ACTION, NO_SOURCE_ACTION, NO_BINDING = "[no valid parsed environment action]", "[no valid source action recorded]", "[no recorded binding]"
SCORED = " [CURRENT SCORED DECISION]"
STUDENT_HEAD = "STUDENT'S COMPLETE ACTUAL ACTION/OBSERVATION EXECUTION"
STUDENT_WON, STUDENT_LOST = "This complete student execution SUCCEEDED.", "This complete student execution FAILED. This outcome does not mean each visited state or action must fail."
STUDENT_NOTE = "All recorded actions and feedback, including later events and the final outcome, are supplied after rollout completion. No historical thought or raw reply is supplied."
SOURCE_WON, SOURCE_LOST = "The COMPLETE original source record SUCCEEDED.", "The COMPLETE original source record FAILED. This is not a claim that its states necessarily fail or that every action was wrong."
SOURCE_NOTE = "Source thoughts and raw replies are not supplied. Noncommitted attempts are explicitly separate from the replayed committed path."
NOT_COMMITTED = "NONCOMMITTED COLLECTION ATTEMPT: recorded failure evidence; no successful transition or free student retry is implied."
SOURCE_TAIL = "Source observations, measurements and preparations belong to this source execution. They are not automatically facts observed by the student."

STUDENT_INITIAL, SOURCE_INITIAL = "Student initial observation:", "Source initial observation:"
STUDENT_EVENTS, CURRENT = "Actual student events: ", "; current scored decision: "
STUDENT_EVENT, INPUT, ACTION, BINDING = "Student event ", "Actual input observation:", "Recorded action: ", "Recorded action binding: "
FORMAT_FAILURE, REJECTION, FEEDBACK = "Actual format failure: ", "Actual environment rejection: ", "Actual feedback:"
STUDENT_END, SOURCE_END = "END OF COMPLETE STUDENT EXECUTION: ", "END OF COMPLETE SOURCE "
SOURCE_HEAD, SOURCE_FILE, SOURCE_ROLE = "COMPLETE SOURCE ACTION/OBSERVATION EXECUTION: ", "Original file: ", "; role: "
SOURCE_TRUSTED, SOURCE_ALL, SOURCE_AND, SOURCE_STEPS = "Complete source replay trusted: ", ". Displaying ALL ", " recorded events and all ", " committed steps."
SOURCE_ANCHOR, SOURCE_KEPT = "Source anchor: before zero-based committed step ", ". Its COMPLETE prefix and COMPLETE remaining recorded execution are both retained."
SOURCE_EVENT, SLOT, SOURCE_INPUT, STATUS, SOURCE_FEEDBACK = "Source event ", "; committed-step slot ", "Actual source input observation:", "Recorded event status: ", "Recorded feedback:"
UNANCHORED, PREFIX, ANCHOR, CONTINUATION = "unanchored history", "source prefix", "source anchor", "source continuation"
SAME, SAME_END = "[Exact same recorded observation text as ", " above; no state identity or shared knowledge is implied.]"
SCOPE, CATEGORY = "FOUR-CASE SELECTION AND ANCHOR SCOPE", "Category: "
NO_LOCATOR = "The current locator is unavailable/unmatchable. The outside fallback is not proof that the physical state is absent from the graph."
SELECTED, RANKED = "Selected applicable successful continuation: ", ". Self success and current compatible catalog suffixes are ranked together by recorded decision count; self has no fixed priority."
SELECTED_SOURCE = "The source matches the current abstract physical/control and parser locator. Its full prefix and successful continuation are shown; execution after the student's different prefix is not independently certified."
SAME_TASK = " is unanchored same-task historical success evidence. No physical LCA or executable connection is claimed."
COMMON, COMMON_SOURCE, COMMON_AT = "Latest actual historical common anchor: student position ", ", source ", " position "
COMMON_END = ". This is a past occurrence in the real student history, including cycles. It is not permission to roll back and not a route from the current state."
NO_TRUSTED = "No trustworthy successful continuation or shared success anchor is available."
NO_DEMONSTRATION = "NO SUCCESSFUL TEACHER/PLANNER DEMONSTRATION IS AVAILABLE FOR THIS TASK. Complete failures remain evidence; no successful LCA or route is invented."
RAW_SUCCESS = "An original record reports success but its full physical replay/seam is unverified. It is shown only as unanchored history, outside trusted suffix ranking."
FAILED, RELATION, FAILED_AT, FAILED_FROM, FAILED_END = "Complete failed-source evidence: ", "; relation=", "; student actual history position=", "; source position=", ". Its entire failed ending is preserved."
NO_FAILED = "No additional related failed source is available; no failed source is fabricated."
COST_SCOPE = {"catalog_source": "verified_committed_decisions_including_reads_and_bindings", "student_self": "all_actual_student_decisions_including_format_errors_and_rejections"}
SHORTEST_SCOPE = "recorded_trusted_source_suffixes"


def said(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def line(ord_: Column, sub: int, text: Column, owner: Column | None = None, when: Column | None = None) -> Column:
    """One line, or null where it isn't written; with an owner, it is an observation."""
    made = F.struct(ord_.cast("long").alias("ord"), F.lit(sub).alias("sub"), text.alias("text"), (F.lit(None).cast("string") if owner is None else owner).alias("owner"))
    return made if when is None else F.when(when, made)


def assembled(lines: DataFrame, keys: list[str], compressed: bool) -> DataFrame:
    """keys and `lines`: an array of (ord, sub, text) in order. Compressed, an observation that was shown before is a
    pointer to it; the first showings are numbered in order."""
    rows = lines.withColumn("body", F.when(F.col("owner").isNotNull(), F.coalesce("text", F.lit(NOTHING))).otherwise(F.col("text")))
    if compressed:
        counted = F.col("owner").isNotNull() & F.col("text").isNotNull()
        place = F.struct("ord", "sub")
        first = F.min(F.when(counted, F.struct(place.alias("p"), F.col("owner").alias("owner")))).over(Window.partitionBy(*keys, "text"))
        rows = rows.withColumn("first", F.when(counted, first)).withColumn("new", counted & (F.col("first.p") == place))
        number = F.sum(F.col("new").cast("int")).over(Window.partitionBy(*keys).orderBy("ord", "sub")) - 1
        rows = rows.withColumn("label", number).withColumn("label", F.min(F.when(F.col("new"), F.col("label"))).over(Window.partitionBy(*keys, "text")))
        name = said("OBS", F.col("label").cast("string"))
        pointer = said(SAME, name, " (", F.col("first.owner"), ")", SAME_END)
        rows = rows.withColumn("body", F.when(F.col("new"), said("[", name, ": ", F.col("owner"), "]\n", F.col("text"))).when(counted, pointer).otherwise(F.col("body")))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "sub", F.col("body").alias("text")))).alias("lines"))


def student_lines(steps: DataFrame) -> DataFrame:
    """Lines of each new execution. steps: task, rep, t, n, won, action, semantic_action, observation, feedback,
    format_error, rejection. What a decision saw is shown only where it isn't just the feedback before it."""
    i, t = (F.col("t") + 1).cast("string"), F.col("t")
    before = F.lag("feedback").over(Window.partitionBy(*RUN).orderBy("t"))
    rows = steps.withColumn("fresh", F.col("observation").isNotNull() & ((t == 0) | (T.norm(F.col("observation")) != T.norm(before))))
    won = F.col("won")
    own = F.array(
        line(t, 0, said(STUDENT_EVENT, i)),
        line(t, 1, F.lit(INPUT), when=F.col("fresh")),
        line(t, 2, F.col("observation"), said("student event ", i, " before"), F.col("fresh")),
        line(t, 3, said(ACTION, shown_action(F.col("action"), NO_ACTION))),
        line(t, 4, said(BINDING, shown_action(F.col("semantic_action"), NO_BINDING)), when=(F.coalesce("semantic_action", F.lit("")) != "") & ~F.col("semantic_action").eqNullSafe(F.col("action"))),
        line(t, 5, said(FORMAT_FAILURE, F.col("format_error")), when=F.coalesce("format_error", F.lit("")) != ""),
        line(t, 6, said(REJECTION, F.col("rejection")), when=F.coalesce("rejection", F.lit("")) != ""),
        line(t, 7, F.lit(FEEDBACK)),
        line(t, 8, F.col("feedback"), said("student event ", i, " feedback")),
    )
    head = F.when(t == 0, F.array(*(line(F.lit(-1), k, x) for k, x in enumerate([F.lit(STUDENT_HEAD), F.when(won, STUDENT_WON).otherwise(STUDENT_LOST), said(STUDENT_EVENTS, F.col("n").cast("string"), CURRENT), F.lit(STUDENT_NOTE), F.lit(STUDENT_INITIAL)])), line(F.lit(-1), 5, F.col("observation"), F.lit("student initial"))))
    tail = F.when(t == F.col("n") - 1, F.array(line(F.col("n"), 0, said(STUDENT_END, F.when(won, "SUCCESS").otherwise("FAILURE")))))
    none = F.array().cast("array<struct<ord:bigint,sub:int,text:string,owner:string>>")
    every = F.concat(own, F.coalesce(head, none), F.coalesce(tail, none))
    return rows.select(*RUN, F.explode(F.filter(every, lambda x: x.isNotNull())).alias("l")).select(*RUN, "l.*")


def student_records(steps: DataFrame, compressed: bool = False) -> DataFrame:
    """(task, rep, t, text): the execution as it is shown with each of its decisions, which is marked."""
    whole = assembled(student_lines(steps), RUN, compressed)
    text = F.transform("lines", lambda x: F.concat(x["text"], F.when((x["ord"] == F.col("t")) & (x["sub"] == 0), SCORED).when((x["ord"] == -1) & (x["sub"] == 2), F.concat((F.col("t") + 1).cast("string"), F.lit("."))).otherwise("")))
    return steps.select(*RUN, "t").join(whole, RUN).select(*RUN, "t", F.array_join(text, "\n").alias("text"))


def source_records(events: DataFrame, sources: DataFrame, compressed: bool = False) -> DataFrame:
    """(task, rep, text): sources with all their events, as operators.attempts.merged() gives them.

    sources: task, rep, kind, file, role, won, trusted, anchor (null if none), n_steps, initial, and if there is one
    replay_limit, what can't be certified of it. An event's input is shown only where it isn't just the feedback of the
    event before.
    """
    sources = sources if "replay_limit" in sources.columns else sources.withColumn("replay_limit", F.lit(None).cast("string"))
    events = events if "semantic_action" in events.columns else events.withColumn("semantic_action", F.lit(None).cast("string"))
    by_run = Window.partitionBy(*RUN).orderBy("seq")
    rows = events.withColumn("i", F.row_number().over(by_run)).withColumn("previous", F.lag("feedback").over(by_run)).withColumn("n_events", F.count("*").over(Window.partitionBy(*RUN))).join(sources, RUN)
    sid, i, anchor, at = source_label(F.col("kind"), F.col("rep")), F.col("i").cast("string"), F.col("anchor"), F.col("source_step")
    before = F.when(F.col("i") == 1, F.col("initial")).otherwise(F.col("previous"))
    fresh = F.col("observation_before").isNotNull() & ((F.col("i") == 1) | (T.norm(F.col("observation_before")) != T.norm(before)))
    relation = F.when(anchor.isNull(), UNANCHORED).when(at < anchor, PREFIX).when(at == anchor, ANCHOR).otherwise(CONTINUATION)
    o = F.col("i")
    own = F.array(
        line(o, 0, said(SOURCE_EVENT, i, SLOT, at.cast("string"), " [", relation, "; ", F.col("kind_of_event"), "]")),
        line(o, 1, F.lit(SOURCE_INPUT), when=fresh),
        line(o, 2, F.col("observation_before"), said(sid, " event ", i, " before"), fresh),
        line(o, 3, said(ACTION, shown_action(F.col("action"), NO_SOURCE_ACTION))),
        line(o, 4, said(BINDING, shown_action(F.col("semantic_action"), NO_BINDING)), when=(F.coalesce("semantic_action", F.lit("")) != "") & ~F.col("semantic_action").eqNullSafe(F.col("action"))),
        line(o, 5, F.lit(NOT_COMMITTED), when=~F.col("committed")),
        line(o, 6, said(STATUS, F.col("reason")), when=F.coalesce("reason", F.lit("")) != ""),
        line(o, 7, F.lit(SOURCE_FEEDBACK)),
        line(o, 8, F.col("feedback"), said(sid, " event ", i, " feedback")),
    )
    heads = [said(SOURCE_HEAD, sid), said(SOURCE_FILE, F.col("file"), SOURCE_ROLE, F.col("role"), "."), F.when(F.col("won"), SOURCE_WON).otherwise(SOURCE_LOST), said(SOURCE_TRUSTED, F.when(F.col("trusted"), "True").otherwise("False"), SOURCE_ALL, F.col("n_events").cast("string"), SOURCE_AND, F.col("n_steps").cast("string"), SOURCE_STEPS), F.lit(SOURCE_NOTE)]
    zero = F.lit(0)
    head = F.when(o == 1, F.array(*(line(zero, k, x) for k, x in enumerate(heads)), line(zero, 5, said(SOURCE_ANCHOR, anchor.cast("string"), SOURCE_KEPT), when=anchor.isNotNull()), line(zero, 6, F.col("replay_limit"), when=F.coalesce("replay_limit", F.lit("")) != ""), line(zero, 7, F.lit(SOURCE_INITIAL)), line(zero, 8, F.col("initial"), said(sid, " initial"))))
    tail = F.when(o == F.col("n_events"), F.array(line(o + 1, 0, said(SOURCE_END, sid, ": ", F.when(F.col("won"), "SUCCESS").otherwise("FAILURE"))), line(o + 1, 1, F.lit(SOURCE_TAIL))))
    none = F.array().cast("array<struct<ord:bigint,sub:int,text:string,owner:string>>")
    every = F.concat(own, F.coalesce(head, none), F.coalesce(tail, none))
    lines = rows.select(*RUN, F.explode(F.filter(every, lambda x: x.isNotNull())).alias("l")).select(*RUN, "l.*")
    return assembled(lines, RUN, compressed).select(*RUN, F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"))


def choice_summary(kind: Column, rep: Column, at: Column, cost: Column, collected: Column) -> Column:
    """A chosen success as its record says it: from where, how long, what the length counts, and within what it is the
    shortest. kind: catalog_source or student_self; collected: decisions with retries, null if they weren't recorded."""
    none = lambda x: F.coalesce(x.cast("string"), F.lit("None"))
    source = kind == "catalog_source"
    scope = F.when(source, COST_SCOPE["catalog_source"]).otherwise(COST_SCOPE["student_self"])
    return said("{'kind': '", kind, "', 'rep': ", F.when(source, none(rep)).otherwise("None"), ", 'anchor_state_t': ", none(at), ", 'decision_cost': ", none(cost), ", 'committed_suffix_cost': ", none(cost), ", 'cost_scope': '", scope, "', 'source_collection_attempt_cost': ", none(F.when(source, collected).otherwise(cost)), f", 'shortest_scope': '{SHORTEST_SCOPE}'}}")


def scope_explained(case: Column, outside: Column, selected: Column, from_source: Column, historical: Column, demonstrated: Column, raw_success: Column, failure: Column) -> Column:
    """The sentences about a decision's case, its chosen success, its historical one, and its failed source.

    outside: its state has no locator; selected: choice_summary, null if none; from_source: whether a source's was chosen;
    historical: struct(anchor_t, label, source_t), null if none, anchor_t null if it shares no state; demonstrated: some
    record of the task reports success; raw_success: one is shown whose replay isn't verified; failure: struct(label,
    relation, anchor_t, source_t), null if none.
    """
    shown = lambda x: F.coalesce(x.cast("string"), F.lit("None"))
    common = said(COMMON, shown(historical["anchor_t"]), COMMON_SOURCE, historical["label"], COMMON_AT, shown(historical["source_t"]), COMMON_END)
    lines = F.array(
        F.lit(SCOPE),
        said(CATEGORY, case, "."),
        F.when(outside, NO_LOCATOR),
        F.when(selected.isNotNull(), said(SELECTED, selected, RANKED)),
        F.when(selected.isNotNull() & from_source, SELECTED_SOURCE),
        F.when(historical.isNotNull(), F.when(historical["anchor_t"].isNull(), said("Source ", historical["label"], SAME_TASK)).otherwise(common)).when(selected.isNull(), F.when(demonstrated, NO_TRUSTED).otherwise(NO_DEMONSTRATION)),
        F.when(raw_success, RAW_SUCCESS),
        F.when(failure.isNotNull(), said(FAILED, failure["label"], RELATION, failure["relation"], FAILED_AT, shown(failure["anchor_t"]), FAILED_FROM, shown(failure["source_t"]), FAILED_END)).otherwise(NO_FAILED),
    )
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")
