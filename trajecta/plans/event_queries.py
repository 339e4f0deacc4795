"""Queries over `events` as trajectories, with their SQL oracles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.operators import graph, retrieval, verify
from trajecta.operators import prompts as P
from trajecta.operators import records as R
from trajecta.operators.graph import HOUSEHOLD, SCIENCE, SHOP
from trajecta.plans.names import Registry
from trajecta.session import table
from trajecta.sources import adapters

registry = Registry()

_COMMAND = adapters.COMMAND
_SHOWN = adapters.SHOWN.replace("nl ||", "chr(10) ||")
#: The locator after an event.
_LOCATOR = """CASE WHEN event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0 THEN key_after || '~' || CASE WHEN action = 'click' AND event_id % 5 = 0 THEN '["pending_menu",[["0","open door ' || band || '"],["1","b"]]]' ELSE '["normal",[]]' END END"""
#: The adapter in SQL: steps, visits of all executions, source visits with eligibility by variant.
STEPS = f"""
WITH num AS (SELECT *, event_type = 'purchase' AND value >= 75 AS wins, coalesce(count(*) FILTER (event_type = 'purchase' AND value >= 75) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w FROM events),
pl0 AS (SELECT *, (row_number() OVER (PARTITION BY user_id, w ORDER BY ts, event_id) - 1) % 30 AS t FROM num),
ord AS (SELECT *, CAST(sum(CASE WHEN t = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 AS e FROM pl0),
kept AS (SELECT user_id % 8 + 8 * e AS task, (user_id - user_id % 8) // 8 AS rep, t, event_id, event_type AS action, value, props, event_type = 'error' AS rejected, event_type || '|' || CAST(floor(value / 40) AS BIGINT) AS key_after, CAST(CAST(floor(value / 40) AS BIGINT) AS VARCHAR) AS band, bool_or(wins) OVER (PARTITION BY user_id, e) AS won,
  count(*) OVER (PARTITION BY user_id, e) AS n, (user_id - user_id % 8) // 8 % 4 = 0 AS student FROM ord),
said AS (SELECT *, {_COMMAND} AS command, {_SHOWN} AS shown, CASE WHEN action = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'unknown_command' ELSE 'unsupported_use' END END AS rejection, CASE WHEN event_id % 41 = 0 THEN 'tags' END AS format_error, event_id % 23 <> 0 AS executed, {_LOCATOR} AS loc_after FROM kept),
st AS (SELECT *, coalesce(lag(key_after) OVER r, 'start') AS key_before, CASE WHEN t = 0 THEN 'start~["normal",[]]' ELSE lag(loc_after) OVER r END AS loc_before, key_after || CASE WHEN event_id % 97 = 0 THEN '?' ELSE '' END AS feedback, bool_and(event_id % 97 <> 0) OVER (PARTITION BY task, rep) AS complete, rejection IS NULL AND format_error IS NULL AS positive FROM said WINDOW r AS (PARTITION BY task, rep ORDER BY t)),
ok AS (SELECT *, coalesce(lag(feedback) OVER (PARTITION BY task, rep ORDER BY t) = key_before, true) AS ok FROM st),
ste AS (SELECT *, coalesce(bool_and(ok) OVER (PARTITION BY task, rep ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), true) AS goes_on FROM ok),
vis AS (SELECT task, rep, t, key_before AS key, loc_before AS loc, won, n, student, complete, positive, goes_on FROM ste UNION ALL SELECT task, rep, n, key_after, loc_after, won, n, student, complete, NULL, true FROM ste WHERE t = n - 1)
"""
SOURCES = {True: ", sv AS (SELECT *, n - t AS cost, won AND complete AND goes_on AND (t = n OR positive) AS eligible FROM vis WHERE NOT student)", False: ", sv AS (SELECT *, n - t AS cost, won AND complete AND t < n AND coalesce(positive, false) AS eligible FROM vis WHERE NOT student)"}
BEST = ", best AS (SELECT task, loc AS loc_before, count(*) AS n_visits, count(*) FILTER (eligible) AS n_candidates, min({'cost': cost, 'rep': rep, 't': t}) FILTER (eligible) AS best FROM sv WHERE loc IS NOT NULL GROUP BY task, loc), m AS (SELECT s.*, b.n_visits, b.n_candidates, b.best, s.n - s.t AS own_cost FROM ste s LEFT JOIN best b USING (task, loc_before) WHERE s.student)"


def chosen(household: bool) -> str:
    a, b, c, d = retrieval.CASES[household]
    own = "won AND best IS NOT NULL" if household else "won"
    return f""", ch AS (SELECT *, CASE WHEN best IS NOT NULL THEN '{a}' WHEN n_visits IS NOT NULL THEN '{b}' WHEN won THEN '{c}' ELSE '{d}' END AS "case",
  CASE WHEN {own} AND (best IS NULL OR own_cost < best.cost) THEN 'student_self' WHEN best IS NOT NULL THEN 'source' END AS selected FROM m),
  fc AS (SELECT task, rep, t, "case", CASE selected WHEN 'student_self' THEN own_cost WHEN 'source' THEN best.cost END AS selected_cost, selected, CASE selected WHEN 'student_self' THEN -1 WHEN 'source' THEN best.rep END AS selected_rep, CASE selected WHEN 'student_self' THEN t WHEN 'source' THEN best.t END AS selected_at FROM ch)"""


def science(sql: str) -> str:
    return STEPS + SOURCES[True] + BEST + chosen(False) + sql


def household(sql: str) -> str:
    return STEPS + SOURCES[False] + BEST + chosen(True) + sql


SUMMARY = """ SELECT "case", count(*) AS n_steps, CAST(coalesce(sum(selected_cost), 0) AS BIGINT) AS sum_cost, count(*) FILTER (selected = 'student_self') AS n_self FROM fc GROUP BY "case" """


def steps(spark: SparkSession, root: str) -> DataFrame:
    return adapters.steps(table(spark, root, "events"))


@registry.add(science(SUMMARY))
def four_case_summary(spark, root):
    """Decisions, costs and own successes by case."""
    return retrieval.four_case_summary(steps(spark, root))


@registry.add(science(" SELECT * FROM fc"))
def four_case_steps(spark, root):
    """The case and choice of each decision."""
    return retrieval.four_case(steps(spark, root))


@registry.add(household(SUMMARY))
def household_case_summary(spark, root):
    """The same by the household rules."""
    return retrieval.four_case_summary(steps(spark, root), HOUSEHOLD)


@registry.add(household(" SELECT * FROM fc"))
def household_case_steps(spark, root):
    return retrieval.four_case(steps(spark, root), HOUSEHOLD)


@registry.add(STEPS + " SELECT task, rep, t, key, won, n, student FROM vis")
def visit_index(spark, root):
    """Every visit of every execution, with the final one."""
    return graph.visits(steps(spark, root)).select("task", "rep", "t", "key", "won", "n", "student")


def _nodes(won: str) -> str:
    return STEPS + f" SELECT task, key, count(*) AS n_visits, count(DISTINCT rep) AS n_reps, min(t) AS min_t, max(t) AS max_t, bool_or(t = 0) AS is_start, bool_or({won}) AS is_won FROM vis GROUP BY task, key"


@registry.add(_nodes("won AND t = n"))
def node_table(spark, root):
    """A1."""
    return graph.nodes(steps(spark, root), SCIENCE)


@registry.add(_nodes("won"))
def node_table_shop(spark, root):
    """A2: every state of a won execution is won."""
    return graph.nodes(steps(spark, root), SHOP)


#: Kinds by a parser's rules and by a shop's. Answers with a menu and commands that are numbers bind; looks observe.
_BINDING = "(command = '0' OR shown LIKE 'Ambiguous%')"
_KIND = f"CASE WHEN key_before <> key_after THEN 'state_change' WHEN format_error IS NOT NULL THEN 'format_invalid' WHEN {_BINDING} AND rejection IS NULL THEN 'binding' WHEN command = 'look around' AND rejection IS NULL THEN 'internal_observation' WHEN rejection IS NOT NULL THEN 'rejection' ELSE 'unchanged_non_observation' END"
_SHOP_KIND = "CASE WHEN format_error IS NOT NULL THEN 'format_invalid' WHEN rejection IS NOT NULL THEN 'rejection' WHEN key_before = key_after THEN 'unchanged' ELSE 'state_change' END"
_EDGES = "SELECT task, key_before AS source, key_after AS target, action, count(*) AS n_members, count(*) FILTER (positive) AS n_positive, bool_or(rejection IS NOT NULL) AS any_rejected, bool_or(key_before <> key_after AND rejection IS NOT NULL) AS passive, arg_min(command = 'look around', {{'rep': rep, 't': t}}) AS observation_with_change, arg_min({kind}, {{'rep': rep, 't': t}}) AS first_kind FROM st {where} GROUP BY task, key_before, key_after, action"


@registry.add(STEPS + _EDGES.format(kind=_KIND, where="WHERE key_before <> key_after"))
def edge_table(spark, root):
    """A3."""
    return graph.edges(steps(spark, root), SCIENCE)


@registry.add(STEPS + _EDGES.format(kind=_SHOP_KIND, where=""))
def edge_table_with_loops(spark, root):
    """A4."""
    return graph.edges(steps(spark, root), SHOP)


@registry.add(STEPS + " SELECT task, key_before AS node, action, feedback, count(*) AS n_members, min(t) AS min_t FROM st WHERE key_before = key_after GROUP BY task, key_before, action, feedback")
def internal_observations(spark, root):
    """A5, A6."""
    return graph.internal_observations(steps(spark, root))


@registry.add(
    STEPS
    + f""", k AS (SELECT *, {_KIND} AS kind FROM st),
a AS (SELECT task, count(*) AS n_decisions, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in graph.PARSER_KINDS)}, count(*) FILTER (key_before <> key_after AND rejection IS NOT NULL) AS n_passive, count(DISTINCT rep) AS n_runs, count(DISTINCT CASE WHEN won THEN rep END) AS n_won, count(DISTINCT CASE WHEN won AND complete THEN rep END) AS n_trusted_won FROM k GROUP BY task),
nd AS (SELECT task, key, count(*) AS v, count(DISTINCT rep) AS r FROM vis GROUP BY task, key),
b AS (SELECT task, count(*) AS n_nodes, CAST(sum(v) AS BIGINT) AS n_visits, count(*) FILTER (r >= 2) AS n_shared FROM nd GROUP BY task),
e AS (SELECT task, count(DISTINCT {{'s': key_before, 'e': key_after, 'a': action}}) AS n_edges FROM st WHERE key_before <> key_after GROUP BY task)
SELECT a.*, b.* EXCLUDE (task), coalesce(n_edges, 0) AS n_edges FROM a JOIN b USING (task) LEFT JOIN e USING (task)"""
)
def graph_stats(spark, root):
    """A7, A8."""
    return graph.stats(steps(spark, root))


@registry.add(STEPS + " SELECT task, split_part(key, '|', 1) AS coarse, count(DISTINCT key) AS n_strict, string_agg(DISTINCT key, ',' ORDER BY key) AS strict_keys FROM vis GROUP BY task, split_part(key, '|', 1)")
def coarse_index(spark, root):
    """A9."""
    return graph.coarse_index(steps(spark, root))


@registry.add(STEPS + " SELECT task, rep, t, goes_on AS continuous FROM ste")
def continuous_suffix(spark, root):
    """W1."""
    return graph.continuous(steps(spark, root)).select("task", "rep", "t", "continuous")


@registry.add(STEPS + " SELECT task, rep, t, n - t AS committed_cost, count(*) FILTER (rejected) OVER (PARTITION BY task, rep ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n_rejected_after FROM st")
def suffix_cost(spark, root):
    """A19, A20."""
    from pyspark.sql import Window

    after = Window.partitionBy("task", "rep").orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    return steps(spark, root).select("task", "rep", "t", F.count("*").over(after).alias("committed_cost"), F.count_if("rejected").over(after).alias("n_rejected_after"))


@registry.add(STEPS + SOURCES[True] + BEST + " SELECT task, rep, t, a.t AS anchor_t, a.best.cost AS cost, a.best.rep AS source_rep, a.best.t AS source_t FROM (SELECT *, last_value(CASE WHEN best IS NOT NULL THEN {'t': t, 'best': best} END IGNORE NULLS) OVER (PARTITION BY task, rep ORDER BY t) AS a FROM m)")
def anchor_success_asof(spark, root):
    """J3."""
    return retrieval.success_anchor(steps(spark, root))


FAILURE = """, fv AS (SELECT task, loc AS loc_before, rep AS source_rep, t AS source_t, n AS cost FROM vis WHERE NOT student AND NOT won AND complete AND loc IS NOT NULL),
fn AS (SELECT s.task, s.rep, s.t, min({'apart': abs(f.source_t - s.t), 'cost': f.cost, 'source_rep': f.source_rep, 'source_t': f.source_t}) FILTER (f.source_rep IS NOT NULL) AS f FROM ste s LEFT JOIN fv f USING (task, loc_before) WHERE s.student GROUP BY s.task, s.rep, s.t),
fa AS (SELECT task, rep, t, a.t AS anchor_t, a.f.apart AS apart, a.f.cost AS cost, a.f.source_rep AS source_rep, a.f.source_t AS source_t FROM (SELECT *, last_value(CASE WHEN f IS NOT NULL THEN {'t': t, 'f': f} END IGNORE NULLS) OVER (PARTITION BY task, rep ORDER BY t) AS a FROM fn))"""


@registry.add(STEPS + FAILURE + " SELECT * FROM fa")
def anchor_failure_asof(spark, root):
    """J4."""
    return retrieval.failure_anchor(steps(spark, root))


FALLBACK = ", fb AS (SELECT task, s.cost AS success_cost, s.rep AS success_rep, f.cost AS failure_cost, f.rep AS failure_rep FROM (SELECT task, min({'cost': n, 'rep': rep}) FILTER (won AND complete AND positive AND goes_on) AS s, min({'cost': n, 'rep': rep}) FILTER (NOT won AND complete) AS f FROM ste WHERE NOT student AND t = 0 GROUP BY task))"


@registry.add(STEPS + FALLBACK + " SELECT * FROM fb")
def unanchored_fallback(spark, root):
    """J5."""
    return retrieval.fallbacks(retrieval.starts(steps(spark, root)))


@registry.add(STEPS + SOURCES[True] + " SELECT task, key, rep, t, cost, row_number() OVER (PARTITION BY task, key ORDER BY cost, rep, t) AS rank FROM sv WHERE eligible")
def candidate_rank(spark, root):
    """W10."""
    from pyspark.sql import Window

    order = Window.partitionBy("task", "key").orderBy("cost", "rep", "t")
    return retrieval.source_visits(steps(spark, root)).where("eligible").select("task", "key", "rep", "t", "cost", F.row_number().over(order).cast("long").alias("rank"))


REFERENCES = FAILURE + FALLBACK + """, sa AS (SELECT task, rep, t, a.best.rep AS h_rep, a.best.t AS h_at FROM (SELECT *, last_value(CASE WHEN best IS NOT NULL THEN {'t': t, 'best': best} END IGNORE NULLS) OVER (PARTITION BY task, rep ORDER BY t) AS a FROM m)),
j AS (SELECT fc.*, sa.h_rep, sa.h_at, fa.source_rep AS f_rep, fa.source_t AS f_at, fb.* EXCLUDE (task) FROM fc JOIN sa USING (task, rep, t) JOIN fa USING (task, rep, t) LEFT JOIN fb USING (task)),
l AS (SELECT task, rep, t, 0 AS ord, 'selected' AS role, selected_rep AS source_rep, selected_at AS source_at FROM j
  UNION ALL SELECT task, rep, t, 1, 'historical', CASE WHEN "case" IN ('graph_inside_without_usable_success_suffix', 'graph_outside_student_failed') THEN coalesce(h_rep, success_rep) END, coalesce(h_at, 0) FROM j
  UNION ALL SELECT task, rep, t, 2, 'failure', CASE WHEN "case" IN ('graph_inside_without_usable_success_suffix', 'graph_outside_student_failed') THEN coalesce(f_rep, failure_rep) END, coalesce(f_at, 0) FROM j),
refs AS (SELECT task, rep, t, role, source_rep, source_at FROM l WHERE source_rep IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task, rep, t, source_rep ORDER BY ord) = 1)"""


@registry.add(science(REFERENCES + " SELECT * FROM refs"))
def evidence_references(spark, root):
    """References of each decision, suppressed and without repeats."""
    return retrieval.references(steps(spark, root))


@registry.add(STEPS + " SELECT task, rep, t, feedback AS recorded, key_after AS replayed, feedback = key_after AS same FROM st")
def replay_compare(spark, root):
    """J7."""
    return verify.compare(*verify.replay(steps(spark, root)))


_TRUST = ", tr AS (SELECT task, rep, count(*) AS n, count(*) FILTER (feedback <> key_after) AS n_mismatch, coalesce(min(t) FILTER (feedback <> key_after), count(*)) AS trusted FROM st GROUP BY task, rep)"


@registry.add(STEPS + _TRUST + " SELECT * FROM tr")
def trusted_prefix(spark, root):
    """W8."""
    return verify.trusted_prefix(verify.compare(*verify.replay(steps(spark, root))))


@registry.add(STEPS + _TRUST + " SELECT task, rep, t, action FROM st JOIN tr USING (task, rep) WHERE t < trusted")
def trusted_steps(spark, root):
    """The decisions that are kept."""
    s = steps(spark, root)
    return verify.cut(s, verify.trusted_prefix(verify.compare(*verify.replay(s)))).select("task", "rep", "t", "action")


@registry.add(STEPS + ", f AS (SELECT *, CASE WHEN contains(shown, 'You reset the goal progress and focus.') THEN {'v': NULL} WHEN shown LIKE 'You focus on%' THEN {'v': regexp_extract(shown, 'You focus on (?:the )?([^.]+)[.]', 1)} END AS u FROM st) SELECT task, rep, t, w.v AS focus FROM (SELECT *, last_value(u IGNORE NULLS) OVER (PARTITION BY task, rep ORDER BY t) AS w FROM f)")
def focus_carry(spark, root):
    """An answer that names a focus sets it, a reset clears it, everything else leaves it."""
    from trajecta.operators import history

    return history.focus(steps(spark, root)).select("task", "rep", "t", "focus")


@registry.add(STEPS + f", k AS (SELECT *, {_KIND} AS kind FROM st), o AS (SELECT *, CASE WHEN kind = 'state_change' AND command = 'look around' AND rejection IS NULL THEN key_after WHEN kind = 'internal_observation' THEN key_before END AS seen FROM k) SELECT task, rep, t, count(seen) OVER w AS n_prior, coalesce(string_agg(seen, ',') OVER w, '') AS prior FROM o WINDOW w AS (PARTITION BY task, rep ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def prior_evidence(spark, root):
    """W3."""
    from trajecta.operators import history

    return history.prior_evidence(graph.kind(steps(spark, root))).select("task", "rep", "t", "n_prior", "prior")


@registry.add(STEPS + f" SELECT task, rep, t, command, key_before, key_after, key_before <> key_after AS changed, split_part(key_before, '|', 1) <> split_part(key_after, '|', 1) AS coarse_changed, {_KIND} AS kind, {_SHOP_KIND} AS shop_kind, {_BINDING} AS is_binding, command = 'look around' AND NOT {_BINDING} AS is_observation, key_before <> key_after AND rejection IS NOT NULL AS passive_during_rejection FROM st")
def transitions(spark, root):
    """What each decision did, by a parser's rules and by a shop's."""
    coarse = lambda c: F.split_part(c, F.lit("|"), F.lit(1))
    rows = graph.kind(steps(spark, root), graph.SHOP).withColumnRenamed("kind", "shop_kind").drop("is_binding", "is_observation", "passive_during_rejection")
    rows = graph.kind(rows)
    return rows.select("task", "rep", "t", "command", "key_before", "key_after", (F.col("key_before") != F.col("key_after")).alias("changed"), (coarse("key_before") != coarse("key_after")).alias("coarse_changed"), "kind", "shop_kind", "is_binding", "is_observation", "passive_during_rejection")


_CASES = retrieval.CASES[False]
_HIST = f"""CASE WHEN j."case" NOT IN ('{_CASES[0]}', '{_CASES[2]}') AND coalesce(j.h_rep, j.success_rep) IS NOT NULL THEN CASE WHEN sa2.h_t IS NULL THEN 'Source original_qwen32b_k16:' || coalesce(j.h_rep, j.success_rep) || '{R.SAME_TASK}' ELSE '{R.COMMON}' || sa2.h_t || ', source original_qwen32b_k16:' || coalesce(j.h_rep, j.success_rep) || ' position ' || coalesce(j.h_at, 0) || '{R.COMMON_END}' END
  WHEN j.selected IS NULL THEN CASE WHEN cl.d THEN '{R.NO_TRUSTED}' ELSE '{R.NO_DEMONSTRATION}' END END"""
_FAILED = f"""CASE WHEN j."case" IN ('{_CASES[1]}', '{_CASES[3]}') AND coalesce(j.f_rep, j.failure_rep) IS NOT NULL THEN '{R.FAILED}original_qwen32b_k16:' || coalesce(j.f_rep, j.failure_rep) || '; relation=' || CASE WHEN fa.anchor_t = j.t THEN '{retrieval.HERE}' WHEN fa.anchor_t IS NOT NULL THEN '{retrieval.EARLIER}' ELSE '{retrieval.SAME_TASK}' END || '{R.FAILED_AT}' || coalesce(fa.anchor_t::VARCHAR, 'None') || '{R.FAILED_FROM}' || coalesce(fa.source_t::VARCHAR, 'None') || '{R.FAILED_END}' ELSE '{R.NO_FAILED}' END"""
_PICK = f"""CASE WHEN j.selected IS NOT NULL THEN '{R.SELECTED}{{''kind'': ''' || CASE j.selected WHEN 'source' THEN 'catalog_source' ELSE 'student_self' END || ''', ''rep'': ' || CASE j.selected WHEN 'source' THEN j.selected_rep::VARCHAR ELSE 'None' END || ', ''anchor_state_t'': ' || j.selected_at || ', ''decision_cost'': ' || j.selected_cost || ', ''committed_suffix_cost'': ' || j.selected_cost || ', ''cost_scope'': ''' || CASE j.selected WHEN 'source' THEN '{R.COST_SCOPE["catalog_source"]}' ELSE '{R.COST_SCOPE["student_self"]}' END || ''', ''source_collection_attempt_cost'': ' || CASE j.selected WHEN 'source' THEN 'None' ELSE j.selected_cost::VARCHAR END || ', ''shortest_scope'': ''{R.SHORTEST_SCOPE}''}}{R.RANKED}' END"""


@registry.add(science(REFERENCES + f""", sa2 AS (SELECT task, rep, t, a.t AS h_t FROM (SELECT *, last_value(CASE WHEN best IS NOT NULL THEN {{'t': t, 'best': best}} END IGNORE NULLS) OVER (PARTITION BY task, rep ORDER BY t) AS a FROM m)),
cl AS (SELECT task, bool_or(won) AS d FROM st WHERE NOT student GROUP BY task)
SELECT j.task, j.rep, j.t, concat_ws(chr(10), '{R.SCOPE}', '{R.CATEGORY}' || j."case" || '.', CASE WHEN st.loc_before IS NULL THEN '{R.NO_LOCATOR}' END, {_PICK}, CASE WHEN j.selected = 'source' THEN '{R.SELECTED_SOURCE.replace("'", "''")}' END, {_HIST}, {_FAILED}) AS said
FROM j JOIN st USING (task, rep, t) JOIN sa2 USING (task, rep, t) JOIN fa USING (task, rep, t) LEFT JOIN cl ON cl.task = j.task"""))
def scope_notes(spark, root):
    """The sentences about each decision's case, choice, history and failed source."""
    rows = retrieval.scopes(steps(spark, root))
    mine = F.col("selected") == "source"
    picked = F.when(F.col("selected").isNotNull(), R.choice_summary(F.when(mine, "catalog_source").otherwise("student_self"), F.col("selected_rep"), F.col("selected_at"), F.col("selected_cost"), F.lit(None)))
    text = R.scope_explained(F.col("case"), F.col("outside"), picked, mine, F.col("historical"), F.col("demonstrated"), F.lit(False), F.col("failure"))
    return rows.select("task", "rep", "t", text.alias("said"))


def _entries(most: int) -> str:
    """The last entries of a history in SQL; decisions of an execution are numbered without gaps."""
    entry = "'[Observation ' || (t + 1) || ': ''' || key_before || ''', Action ' || (t + 1) || ': ''' || action || ''']'"
    return f"list({entry}) OVER (PARTITION BY task, rep ORDER BY t ROWS BETWEEN {most} PRECEDING AND 1 PRECEDING)"


def _template(text: str, fields: dict[str, str]) -> str:
    """A template in SQL, with its fields as expressions."""
    parts = re.split(r"\{(\w+)\}", text)
    return " || ".join(fields[p] if k % 2 else "'" + p.replace("'", "''") + "'" for k, p in enumerate(parts) if k % 2 or p)


def _prompt_sql(first: str, later: str, most: int, fields: dict[str, str]) -> str:
    fields = {"task_description": "'do it ' || band", "current_observation": "key_before", "step_count": "t", "history_length": "len(h)", "current_step": "(t + 1)", "action_history": "array_to_string(h, chr(10))"} | fields
    return STEPS + f", hs AS (SELECT *, {_entries(most)} AS h FROM st) SELECT task, rep, t, md5(CASE WHEN t = 0 THEN {_template(first, fields)} ELSE {_template(later, fields)} END) AS digest FROM hs"


def asked(spark: SparkSession, root: str) -> DataFrame:
    """Steps with what a prompt needs: instruction, commands (with the one that asks for help), objects, clickables."""
    rows = steps(spark, root).withColumn("band", F.split_part("key_after", F.lit("|"), F.lit(2)))
    more = {"instruction": "'do it ' || band", "commands": "array('help', command, 'look around')", "objects": "array('thing ' || band, action)", "clickables": "array(action, 'next >')", "search": "event_id % 2 = 0"}
    return rows.withColumns({k: F.expr(v) for k, v in more.items()})


def _digest(rows: DataFrame) -> DataFrame:
    return rows.select("task", "rep", "t", F.md5(F.col("prompt").cast("binary")).alias("digest"))


@registry.add(_prompt_sql(P.SCIENCE_FIRST, P.SCIENCE_LATER, 5, {"action_templates": "'''' || command || ''', ''look around'''", "objects": "'''thing ' || band || ''', ''' || action || ''''"}))
def science_prompts(spark, root):
    """R21."""
    return _digest(P.prompts(asked(spark, root), "science"))


@registry.add(_prompt_sql(P.HOUSEHOLD_FIRST, P.HOUSEHOLD_LATER, 5, {"admissible_actions": "'''' || command || '''' || chr(10) || ' ''look around'''"}))
def household_prompts(spark, root):
    """R21."""
    return _digest(P.prompts(asked(spark, root), "household"))


@registry.add(_prompt_sql(P.SHOP_FIRST, P.SHOP_LATER, 2, {"available_actions": "CASE WHEN event_id % 2 = 0 THEN '''search[<your query>]'',' || chr(10) ELSE '' END || '''click[' || action || ']'',' || chr(10) || '''click[next >]'','"}))
def shop_prompts(spark, root):
    """R21."""
    return _digest(P.prompts(asked(spark, root), "shop"))
