"""Queries over states, attempts, sources and catalogs, with their SQL oracles.

The events give the rows, all of them; flags that they lack come from their ids: a state is captured unless
event_id % 7 = 0, may be matched unless event_id % 11 = 0, its parser waits for a choice where event_id % 5 = 0 and is
unknown where event_id % 13 = 0, and the state before a decision is unrecorded where event_id % 3 = 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions import identity as I
from trajecta.functions import text as T
from trajecta.operators import attempts as A
from trajecta.operators import catalog, objects, records, verify
from trajecta.plans.event_queries import STEPS, steps
from trajecta.plans.names import Registry
from trajecta.session import table
from trajecta.sources import adapters, catalogs

registry = Registry()


def _mode():
    return F.expr("CASE WHEN event_id % 13 = 0 THEN 'unknown' WHEN event_id % 5 = 0 THEN 'pending_menu' ELSE 'normal' END")


def _options():
    return F.expr("CASE WHEN event_id % 5 = 0 THEN map('1', concat(action, '  x'), '0', 'b') ELSE CAST(map() AS map<string,string>) END")


_SIGNATURE = "CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 5 = 0 THEN '[\"pending_menu\",[[\"0\",\"b\"],[\"1\",\"' || action || ' x\"]]]' ELSE '[\"normal\",[]]' END"
_STATE = f"CASE WHEN event_id % 7 <> 0 AND event_id % 11 <> 0 THEN {{}} || '~' || {_SIGNATURE} END"


def located(rows: DataFrame) -> DataFrame:
    """Steps with `loc`: the locator, as text, of the state that each decision was made in."""

    def state(key: str):
        found = I.locator(F.lit(None).cast("string"), F.col(key), F.expr("event_id % 7 <> 0"), F.expr("event_id % 11 <> 0"), _mode(), _options())
        return F.when(found.isNotNull(), F.concat_ws("~", found["key"], found["signature"]))

    captured = rows.withColumn("before", F.when(F.col("event_id") % 3 != 0, F.coalesce(state("key_before"), F.lit("")))).withColumn("after", F.coalesce(state("key_after"), F.lit("")))
    return captured.withColumn("loc", F.nullif(I.current_state(F.col("before"), F.col("after"), ["task", "rep"]), F.lit("")))


_LOCATED = STEPS + f", sb AS (SELECT *, CASE WHEN event_id % 3 <> 0 THEN coalesce({_STATE.format('key_before')}, '') END AS before, coalesce({_STATE.format('key_after')}, '') AS after FROM st), lo AS (SELECT *, nullif(coalesce(before, lag(after) OVER (PARTITION BY task, rep ORDER BY t)), '') AS loc FROM sb)"


@registry.add(_LOCATED + ", v AS (SELECT task, loc, count(*) AS n FROM lo WHERE NOT student AND loc IS NOT NULL GROUP BY task, loc) SELECT l.task, l.rep, l.t, l.loc, coalesce(v.n, 0) AS n_visits FROM lo l LEFT JOIN v ON v.task = l.task AND v.loc = l.loc WHERE l.student")
def locator_match(spark, root):
    """Visits of sources to the state of each new decision; a state without identity has none."""
    rows = located(steps(spark, root))
    seen = rows.where("NOT student AND loc IS NOT NULL").groupBy("task", "loc").agg(F.count("*").alias("seen"))
    return rows.where("student").join(seen, ["task", "loc"], "left").select("task", "rep", "t", "loc", F.coalesce("seen", F.lit(0)).alias("n_visits"))


@registry.add(STEPS + " SELECT task, rep, t, CASE WHEN ok THEN key_before END AS key, CASE WHEN ok THEN md5(key_before) END AS physical_hash, event_id % 7 <> 0 AS capture_ok, ok AS matchable FROM (SELECT *, event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0 AS ok FROM st)")
def matching_descriptors(spark, root):
    """P3."""
    made = I.descriptor(F.col("key_before"), F.md5(F.col("key_before").cast("binary")), F.expr("event_id % 7 <> 0"), F.expr("event_id % 11 <> 0"), _mode())
    return steps(spark, root).select("task", "rep", "t", made.alias("d")).select("task", "rep", "t", "d.*")


_FACTS = "SELECT task, rep, max(n) AS n, bool_or(won) AS won, CASE WHEN rep % 7 <> 3 THEN rep % 5 <> 4 END AS complete, CASE WHEN rep % 3 <> 0 THEN rep % 11 <> 5 END AS trusted_success, CASE WHEN rep % 4 <> 1 THEN rep % 9 = 2 END AS source_won FROM st GROUP BY task, rep"


def sources(spark, root) -> DataFrame:
    """Executions with the flags of a replayed source."""
    flags = {"complete": "CASE WHEN rep % 7 <> 3 THEN rep % 5 <> 4 END", "trusted_success": "CASE WHEN rep % 3 <> 0 THEN rep % 11 <> 5 END", "source_won": "CASE WHEN rep % 4 <> 1 THEN rep % 9 = 2 END"}
    return adapters.executions(table(spark, root, "events")).withColumns({k: F.expr(v) for k, v in flags.items()})


@registry.add(STEPS + f" SELECT task, rep, trusted, successful, trusted AND NOT won AND NOT coalesce(source_won, false) AS failed, CASE WHEN successful THEN 1.0 ELSE 0.0 END AS score FROM (SELECT *, trusted AND won AND coalesce(trusted_success, true) AS successful FROM (SELECT *, coalesce(complete, false) AS trusted FROM ({_FACTS})))")
def source_trust(spark, root):
    """An untrusted failure is neither a success nor a failure."""
    rows = sources(spark, root)
    return rows.select("task", "rep", A.trust(F.col("complete"), F.col("won"), F.col("trusted_success"), F.col("source_won")).alias("x")).select("task", "rep", "x.*")


@registry.add(STEPS + f", m AS (SELECT task, rep, n, coalesce(source_won, false) AS source_won, rep % 6 = 5 AS expected_missing, rep % 8 <> 7 AS readable FROM ({_FACTS})) SELECT task, rep, n_attempts FROM (SELECT task, rep, n AS n_attempts, row_number() OVER (PARTITION BY task ORDER BY n, rep) AS k FROM m WHERE source_won AND readable AND (rep % 2 = 1 OR NOT expected_missing)) WHERE k = 1")
def raw_success_fallback(spark, root):
    """Manifest rows (even runs) and replayed sources that the manifest doesn't name."""
    rows = sources(spark, root).select("task", "rep", F.col("n").alias("n_attempts"), F.coalesce("source_won", F.lit(False)).alias("source_won"), F.expr("rep % 6 = 5").alias("expected_missing"), F.expr("rep % 8 <> 7").alias("readable"))
    return A.raw_success(rows.where("rep % 2 = 0"), rows.where("rep % 2 = 1"))


@registry.add(STEPS + f" SELECT task, min(rep) AS rep FROM (SELECT *, coalesce(source_won, false) AS sw FROM ({_FACTS})) WHERE NOT sw AND rep % 8 <> 7 AND (rep % 2 = 1 OR rep % 6 <> 5) GROUP BY task")
def raw_failure_fallback(spark, root):
    """P14."""
    rows = sources(spark, root).select("task", "rep", F.coalesce("source_won", F.lit(False)).alias("source_won"), F.expr("rep % 6 = 5").alias("expected_missing"), F.expr("rep % 8 <> 7").alias("readable"))
    return A.raw_failure(rows.where("rep % 2 = 0"), rows.where("rep % 2 = 1"))


@registry.add(STEPS + f" SELECT task, rep, n AS cost FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY n % 3 DESC, n, rep) AS k FROM ({_FACTS}) WHERE coalesce(complete, false) AND won) WHERE k = 1")
def task_best_sources(spark, root):
    """A21."""
    return A.task_best(sources(spark, root).select("task", "rep", "n", "won", F.coalesce("complete", F.lit(False)).alias("trusted"), (F.col("n") % 3).alias("score")))


def tried(spark, root) -> tuple[DataFrame, DataFrame]:
    """Decisions with their answers, and 1 to 3 attempts at each (event_id % 3 + 1), of which the last was accepted; where
    event_id % 43 = 0 also the one before, where % 47 = 0 with another answer; executions of rep % 6 = 1 recorded none."""
    answer = F.concat(F.lit("<action>"), "action", F.lit(" "), F.col("t").cast("string"), F.lit("</action>"))
    rows = steps(spark, root).withColumn("raw_output", answer).withColumn("semantic_action", F.expr("CASE WHEN event_id % 11 = 0 THEN concat('menu ', action) ELSE action END"))
    each = rows.where("rep % 6 <> 1").withColumn("k", F.explode(F.expr("sequence(0, CAST(event_id % 3 AS int))")))
    last = F.col("k") == F.col("event_id") % 3
    accepted = last | ((F.col("event_id") % 43 == 0) & (F.col("k") == F.col("event_id") % 3 - 1))
    raw = F.when(last & (F.col("event_id") % 47 != 0), F.col("raw_output")).when(F.col("k") == 0, F.concat("raw_output", F.lit("<action>"))).otherwise(F.concat(F.lit("<action>Try "), F.col("k").cast("string"), F.lit("</action>")))
    tries = each.select("task", "rep", (F.col("t") * 3 + F.col("k")).alias("seq"), (F.col("t") + 1).alias("step"), F.when(accepted, "accepted").otherwise("not_executable").alias("type"), F.lit(None).cast("string").alias("action"), raw.alias("raw_output"), F.lit(None).cast("string").alias("feedback"), F.when(~accepted, "no").alias("reason"))
    return rows, tries


_TRIED = STEPS + """, an AS (SELECT *, '<action>' || action || ' ' || t || '</action>' AS raw_output FROM st),
tr AS (SELECT a.task, a.rep, a.t, a.t * 3 + k AS seq, a.event_id, a.action, a.key_before, a.feedback, a.raw_output AS own, k = event_id % 3 OR (event_id % 43 = 0 AND k = event_id % 3 - 1) AS accepted,
  CASE WHEN k = event_id % 3 AND event_id % 47 <> 0 THEN a.raw_output WHEN k = 0 THEN a.raw_output || '<action>' ELSE '<action>Try ' || k || '</action>' END AS raw_output FROM an a, unnest(range(0, event_id % 3 + 1)) AS u(k) WHERE rep % 6 <> 1)"""


@registry.add(_TRIED + ", ac AS (SELECT task, rep, t, count(*) AS found, min(raw_output) AS r FROM tr WHERE accepted GROUP BY ALL), al AS (SELECT a.task, a.rep, a.t, coalesce(found, 0) AS n_accepted, coalesce(found, 0) = 1 AND coalesce(r = a.raw_output, false) AS aligned FROM an a LEFT JOIN ac USING (task, rep, t)) SELECT *, bool_and(aligned) OVER (PARTITION BY task, rep ORDER BY t) AS restored FROM al")
def attempt_alignment(spark, root):
    """Decisions whose one accepted attempt has their answer, and the prefix up to which all do."""
    return A.verified_prefix(A.aligned(*tried(spark, root)))


@registry.add(_TRIED + """, ev AS (SELECT task, rep, seq, t AS source_step, CASE WHEN accepted THEN 'committed' ELSE 'not_executable' END AS kind, accepted AS committed, CASE WHEN accepted THEN action WHEN raw_output LIKE '%<action>' THEN NULL ELSE regexp_extract(raw_output, '<action>(.*?)</action>', 1) END AS action,
  CASE WHEN accepted THEN key_before END AS observation_before, CASE WHEN accepted THEN feedback END AS feedback, CASE WHEN NOT accepted THEN 'no' END AS reason, NULL AS error, CASE WHEN accepted THEN CASE WHEN event_id % 11 = 0 THEN 'menu ' || action ELSE action END END AS semantic_action FROM tr
  UNION ALL SELECT task, rep, t, t, 'committed', true, action, key_before, feedback, coalesce(format_error, rejection), NULL, CASE WHEN event_id % 11 = 0 THEN 'menu ' || action ELSE action END FROM an WHERE rep % 6 = 1) SELECT * FROM ev""")
def event_merge(spark, root):
    """Attempts and committed decisions in one order."""
    return A.merged(*tried(spark, root))


@registry.add(_TRIED + ", c AS (SELECT a.task, a.rep, a.t AS start, a.n - a.t AS committed_cost, count(tr.seq) AS c FROM an a LEFT JOIN tr ON tr.task = a.task AND tr.rep = a.rep AND tr.t >= a.t GROUP BY ALL) SELECT task, rep, start, committed_cost, CASE WHEN c >= committed_cost AND rep % 6 <> 1 THEN c END AS attempts FROM c")
def collection_cost(spark, root):
    """A20."""
    rows, tries = tried(spark, root)
    return A.collection_cost(rows.select("task", "rep", F.col("t").alias("start"), (F.col("n") - F.col("t")).alias("committed_cost")), tries)


@registry.add(STEPS + """, l AS (SELECT task, rep, count(*) AS n, max({'t': t, 'a': action}).a AS a FROM st GROUP BY task, rep), o AS (SELECT *, rep % 3 <> 0 AS done, rep % 5 = 0 AS lim, CASE WHEN rep % 4 = 0 THEN 0.5 ELSE -CAST(rep % 4 AS DOUBLE) END AS s, n + CASE WHEN rep % 10 = 3 THEN 1 ELSE 0 END AS dc FROM l)
SELECT task, rep, CASE WHEN done AND NOT lim AND s < 0 AND dc = n THEN 'CURRENT ACTION AND ITS OBSERVED CONSEQUENCE: The recorded action "' || a || '" immediately ended this task with FAILURE (score ' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ').' END AS note, CASE WHEN done AND NOT lim AND s < 0 AND dc <> n THEN 'inconsistent recorded terminal failure' END AS error FROM o""")
def terminal_notes(spark, root):
    """Notes of executions that their last decision ended in failure; others keep their prompt as it is."""
    score = F.expr("CASE WHEN rep % 4 = 0 THEN 0.5D ELSE -CAST(rep % 4 AS DOUBLE) END")
    rows = steps(spark, root).withColumn("score", score)
    ends = rows.groupBy("task", "rep").agg(F.count("*").alias("n"), F.max("score").alias("final_score")).select("task", "rep", F.expr("rep % 3 <> 0").alias("done"), F.expr("rep % 5 = 0").alias("limit_reached"), "final_score", F.lit(False).alias("won"), F.expr("n + CASE WHEN rep % 10 = 3 THEN 1 ELSE 0 END").alias("decision_count"), F.lit(False).alias("technical_incomplete"))
    return A.terminal_failure(rows, ends)


@registry.add("SELECT p_partkey, sha256('{\"facts\":[\"' || least(p_brand, p_type) || '\",\"' || greatest(p_brand, p_type) || '\"],\"gamefile\":\"' || p_name || '\",\"lost\":false,\"won\":' || CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END || '}') AS fact_key, substr(sha256('[\"' || least(lower(p_brand), lower(p_type)) || '\", \"' || greatest(lower(p_brand), lower(p_type)) || '\"]'), 1, 24) AS object_key FROM part")
def state_keys(spark, root):
    """F19, F28."""
    facts = F.array("p_type", "p_brand")
    return table(spark, root, "part").select("p_partkey", I.fact_key(F.col("p_name"), facts, F.col("p_size") % 2 == 0, F.lit(None).cast("boolean")).alias("fact_key"), I.object_key(facts).alias("object_key"))


_PARTS = "SELECT *, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 'http://h/search_results/x/1' WHEN 2 THEN 'http://h/item_page/x' WHEN 3 THEN 'http://h/item_sub_page/x/Features/y' ELSE 'http://h/' END AS url FROM part"


@registry.add(f"""WITH p AS ({_PARTS}), k AS (SELECT *, CASE p_size % 5 WHEN 1 THEN 'search_results' WHEN 2 THEN 'item_page' WHEN 3 THEN 'item_sub_page' ELSE 'start' END AS page_type, '[["brand","' || p_brand || '"],["type","' || p_type || '"]]' AS o, '"' || p_partkey || '"' AS a, CASE p_size % 5 WHEN 3 THEN '"Features"' ELSE 'null' END AS sub FROM p)
SELECT p_partkey, page_type, sha256(CASE WHEN p_size % 7 = 0 THEN CASE page_type WHEN 'start' THEN '["done",null,[]]' ELSE '["done",' || a || ',' || o || ']' END WHEN page_type = 'start' THEN '["start",[],null,null,[],null]' ELSE '["' || page_type || '",["' || p_name || '"],' || p_size || ',' || a || ',' || o || ',' || sub || ']' END) AS strict,
 sha256(CASE WHEN p_size % 7 = 0 THEN CASE page_type WHEN 'start' THEN '["done",null,[]]' ELSE '["done",' || a || ',' || o || ']' END WHEN page_type = 'start' THEN '["start",null,[],null]' ELSE '["' || page_type || '",' || a || ',' || o || ',' || sub || ']' END) AS coarse FROM k""")
def shop_keys(spark, root):
    """Strict and coarse keys of shop states, and their page."""
    url = F.expr("CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 'http://h/search_results/x/1' WHEN 2 THEN 'http://h/item_page/x' WHEN 3 THEN 'http://h/item_sub_page/x/Features/y' ELSE 'http://h/' END")
    options = F.create_map(F.lit("type"), "p_type", F.lit("brand"), "p_brand")
    keys = I.shop_keys(url, F.array("p_name"), F.col("p_size"), F.col("p_partkey").cast("string"), options, F.col("p_size") % 7 == 0)
    return table(spark, root, "part").select("p_partkey", keys.alias("k")).select("p_partkey", "k.*")


@registry.add("SELECT p_partkey, CASE WHEN p_size % 9 <> 0 THEN CAST(floor(p_retailprice / 1.0 + 0.5) AS BIGINT) END AS bin, CASE WHEN p_size % 9 <> 0 THEN CAST(sign(p_retailprice - p_size * 50) AS INT) END AS melting, CASE WHEN p_size % 9 <> 0 AND p_size % 2 = 0 THEN CAST(sign(p_retailprice - 1500) AS INT) END AS boiling FROM part")
def temperature_bins(spark, root):
    """two readings in one bin and on the same sides of all thresholds are no change."""
    value = F.when(F.col("p_size") % 9 != 0, F.col("p_retailprice"))
    made = I.temperature(value, {"melting": (F.col("p_size") * 50).cast("double"), "boiling": F.when(F.col("p_size") % 2 == 0, F.lit(1500.0))})
    return table(spark, root, "part").select("p_partkey", made.alias("x")).select("p_partkey", "x.bin", "x.sides.*")


@registry.add(STEPS + " SELECT task, rep, t, CASE WHEN event_id % 10 = 0 THEN 'format_invalid' WHEN rejected THEN 'rejection' WHEN key_before = key_after THEN 'unchanged' ELSE 'state_change' END AS shop, CASE WHEN key_before <> key_after THEN 'state_change' WHEN event_id % 10 = 0 THEN 'format_invalid' WHEN event_id % 4 = 0 AND NOT rejected THEN 'binding' WHEN event_id % 4 = 1 AND NOT rejected THEN 'internal_observation' WHEN rejected THEN 'rejection' ELSE 'unchanged_non_observation' END AS kind, key_before <> key_after AND rejected AS passive FROM st")
def transition_kinds(spark, root):
    """what each decision did, in the words of either environment."""
    rows = steps(spark, root)
    action = F.expr("CASE event_id % 4 WHEN 0 THEN ' 12 ' WHEN 1 THEN 'Look at it' ELSE action END")
    rejection, malformed = F.when(F.col("rejected"), "no"), F.when(F.col("event_id") % 10 == 0, "bad")
    made = I.transition(action, F.col("feedback"), F.col("key_before") != F.col("key_after"), rejection, malformed)
    return rows.select("task", "rep", "t", I.shop_kind(malformed, rejection, F.col("key_before"), F.col("key_after")).alias("shop"), made["kind"].alias("kind"), made["passive_during_rejection"].alias("passive"))


@registry.add("SELECT conv_id, turn, role AS observation, md5(text || chr(10)) AS prefix, ' a, b' AS suffix, '[' || turn || ',' || CASE WHEN turn % 2 = 0 THEN 'true' ELSE 'false' END || ']' AS flags FROM conversations")
def prompt_parts(spark, root):
    """A prompt around its observation, and the ordered goals of a progress text."""
    prompt = F.concat("text", F.lit("\ncurrent observation is: "), "role", F.lit(" \nAvailable action commands: a, b"))
    progress = F.concat(F.lit("Ordered\n "), F.col("turn").cast("string"), F.when(F.col("turn") % 2 == 0, "\ttrue").otherwise("\tfalse"), F.lit("\tgoal\nUnordered\n 9\ttrue\tx"))
    flag = I.goal_flags(progress)[0]
    return table(spark, root, "conversations").select("conv_id", "turn", I.prompt_parts(prompt).alias("p"), F.concat(F.lit("["), flag[0], F.lit(","), flag[1], F.lit("]")).alias("flags")).select("conv_id", "turn", "p.observation", F.md5(F.col("p.prefix").cast("binary")).alias("prefix"), "p.suffix", "flags")


@registry.add("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'choice:' || role WHEN 1 THEN 'command:7' WHEN 2 THEN 'command:go on' ELSE 'choice:x' END AS semantic, CASE turn % 4 WHEN 0 THEN '3' WHEN 1 THEN '7' WHEN 2 THEN 'go on' END AS action, CASE WHEN turn % 4 = 3 THEN 'semantic parser choice is absent or ambiguous' END AS error, turn % 4 = 2 AS rejected FROM conversations")
def menu_rebind(spark, root):
    """A number stands for the option that it chose, and is looked up anew in another menu."""
    before = F.concat(F.lit("Ambiguous request:\n0: "), "role", F.lit("\n1: x"))
    now = F.concat(F.lit("Ambiguous request:\n1: x\n2: x\n3: "), "role")
    spec = I.action_spec(F.expr("CASE turn % 4 WHEN 0 THEN ' 0' WHEN 1 THEN '7' WHEN 2 THEN 'Go on' ELSE '1' END"), before, F.when(F.col("turn") % 4 == 2, "No known action matches that input.").otherwise("done"))
    rows = table(spark, root, "conversations").select("conv_id", "turn", now.alias("now"), spec.alias("spec"))
    return rows.select("conv_id", "turn", "spec", I.rebind(F.col("spec"), F.col("now")).alias("r")).select("conv_id", "turn", "spec.semantic", "r.action", "r.error", F.col("spec.rejected_in_source").alias("rejected"))


@registry.add("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'choice_permutation' WHEN 2 THEN NULL ELSE 'scene_permutation' END AS relation, turn % 3 <> 1 AS same FROM conversations")
def observation_relations(spark, root):
    """How two observations agree; lists that hold the same items as often."""
    menu = lambda a, b: F.concat(F.lit("Ambiguous request:\n0: "), a, F.lit("\n1: "), b)
    one = F.when(F.col("turn") % 4 == 0, F.concat(F.lit(" "), "text")).when(F.col("turn") % 4 == 3, F.lit("a b")).otherwise(menu(F.col("role"), F.lit("z")))
    two = F.when(F.col("turn") % 4 == 0, F.concat("text", F.lit("\n"))).when(F.col("turn") % 4 == 3, F.lit("b a")).when(F.col("turn") % 4 == 1, menu(F.lit("z"), F.col("role"))).otherwise(menu(F.lit("z"), F.lit("z")))
    scene = lambda x: F.array_join(F.array_sort(F.split(x, " ")), " ")
    lists = F.array("role", "role", F.lit("a")), F.when(F.col("turn") % 3 == 1, F.array("role", F.lit("a"))).otherwise(F.array("role", F.lit("a"), "role"))
    return table(spark, root, "conversations").select("conv_id", "turn", I.relation(one, two, scene).alias("relation"), I.same_multiset(*lists).alias("same"))


@registry.add(STEPS + f" SELECT task, rep, CASE WHEN rep % 5 = 1 OR rep >= 12 THEN 'planner_actual_replay:' ELSE 'original_qwen32b_k16:' END || CASE WHEN rep >= 12 THEN rep + 1000000 ELSE rep END AS label, CASE rep % 4 WHEN 0 THEN 'none' WHEN 1 THEN '[recorded action text withheld: invalid control tags]' ELSE 'go ' || rep END AS shown, CASE WHEN rep % 3 = 0 THEN rep % 2 = 0 ELSE rep % 5 = 2 END AS teacher FROM ({_FACTS})")
def source_labels(spark, root):
    """F32, F33, P12."""
    rows = sources(spark, root)
    action = F.expr("CASE rep % 4 WHEN 0 THEN NULL WHEN 1 THEN 'x < Action >' ELSE concat('go ', rep) END")
    teacher = I.teacher_is(F.expr("CASE WHEN rep % 3 = 0 THEN CASE WHEN rep % 2 = 0 THEN 'org/model-a' ELSE 'org/model-b' END END"), F.expr("CASE WHEN rep % 5 = 2 THEN '/m/model-a//' ELSE '/m/xmodel-a' END"), "org/model-a")
    return rows.select("task", "rep", I.source_label(F.expr("CASE WHEN rep % 5 = 1 THEN 'planner_x' END"), F.expr("CASE WHEN rep >= 12 THEN rep + 1000000 ELSE rep END")).alias("label"), I.shown_action(action, "none").alias("shown"), teacher.alias("teacher"))


@registry.add("WITH t AS (SELECT c_custkey AS k, 'g/' || c_custkey AS path FROM customer) SELECT CAST(k AS VARCHAR) AS task, CASE WHEN ok THEN path END AS path, CASE WHEN k % 6 = 0 THEN NULL WHEN k % 6 = 1 THEN 'failed' WHEN k % 2 = 0 THEN 'complete' ELSE 'partial' END AS status, CASE WHEN k % 11 = 0 THEN NULL WHEN k % 6 = 0 THEN 'catalog_entry_not_ready' WHEN k % 6 = 1 THEN 'catalog_has_no_readable_graph' WHEN k % 7 = 0 THEN 'published_graph_file_missing' END AS fallback, CASE WHEN k % 11 = 0 THEN 'task_outside_the_manifest' WHEN k % 6 > 1 AND k % 7 <> 0 AND k % 13 = 0 THEN 'digest_mismatch' END AS error FROM (SELECT *, k % 11 <> 0 AND k % 6 > 1 AND k % 7 <> 0 AND k % 13 <> 0 AS ok FROM t)")
def catalog_lookup(spark, root):
    """Published graphs of tasks, or why there is none."""
    tasks = table(spark, root, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("task"), F.concat(F.lit("g/"), F.col("c_custkey").cast("string")).alias("path"))
    entries = tasks.where("k % 6 <> 0").select("task", F.expr("CASE WHEN k % 6 = 1 THEN 'failed' WHEN k % 2 = 0 THEN 'complete' ELSE 'partial' END").alias("status"), "path", F.when(F.col("k") % 13 == 0, "other").otherwise("h").alias("sha256"))
    files = tasks.where("k % 7 <> 0").select("path", F.lit("h").alias("sha256"))
    return catalogs.lookup(tasks, tasks.where("k % 11 <> 0"), entries, files).select("task", "path", "status", "fallback", "error")


@registry.add("SELECT 'goal' || o_orderkey AS gamefile, o_orderkey AS goal, o_orderkey AS task_index, 'train' AS split FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND o_custkey % 2 = 0")
def training_goals(spark, root):
    """Unsolved goals of those requested, as training tasks."""
    rows = table(spark, root, "orders").select(F.col("o_orderkey").alias("goal"), F.col("o_orderkey").alias("ord"), "o_orderstatus", "o_custkey")
    goals = catalogs.checked_goals(rows.select("ord", "goal"))
    left = catalogs.refinement(goals, rows.select("goal", (F.col("o_orderstatus") == "F").alias("solved")), rows.where("o_custkey % 2 = 0"))
    return catalogs.training_tasks(left)


@registry.add("WITH v AS (SELECT s_suppkey AS o, s_name AS task, unnest([{'split': 'train', 'l': [0, 1]}, {'split': 'dev', 'l': [2]}, {'split': 'test', 'l': [s_nationkey + 3]}]) AS x FROM supplier) SELECT x.split AS split, o AS task_order, CAST(k AS BIGINT) AS k, task || '|' || x.l[k + 1] || '|easy' AS id FROM v, unnest(range(0, len(x.l))) AS u(k)")
def official_splits(spark, root):
    """S19."""
    rows = table(spark, root, "supplier").select(F.col("s_suppkey").alias("task_order"), F.col("s_name").alias("task"), F.array(F.lit(0), F.lit(1)).alias("train"), F.array(F.lit(2)).alias("dev"), F.array(F.col("s_nationkey") + 3).alias("test"))
    return catalogs.official_splits(rows).withColumn("k", F.col("k").cast("long"))


_PAGE = "SELECT p_partkey % 50 AS page, p_partkey, upper(substr(md5(CAST(p_partkey AS VARCHAR)), 1, 10)) AS asin, p_name FROM part"


@registry.add(f"WITH p AS ({_PAGE}) SELECT page, p_partkey % 20 AS goal, asin, p_name AS title FROM p WHERE p_partkey % 3 <> 0 AND p_partkey % 4 = 1")
def page_results(spark, root):
    """Untried candidates among the results that a page shows."""
    rows = table(spark, root, "part").select((F.col("p_partkey") % 50).alias("page"), (F.col("p_partkey") % 20).alias("goal"), "p_partkey", F.upper(F.substring(F.md5(F.col("p_partkey").cast("string").cast("binary")), 1, 10)).alias("asin"), "p_name")
    entry = F.concat(F.lit("[button] "), "asin", F.lit(" [button_]\n"), "p_name")
    text = rows.groupBy("page").agg(F.concat(F.lit("[button] Back to Search [button_]\nPage 1\n"), F.array_join(F.array_sort(F.collect_list(entry)), "\n"), F.lit("\n[button] ABCDEFGHIJ [button_]")).alias("text"))
    # these ids are parts of hashes, and two parts may have the same: the n-th of equal entries of a page is the n-th such part
    nth = lambda title, order: F.row_number().over(Window.partitionBy("page", "asin", title).orderBy(order))
    shown = catalogs.page_results(text).withColumn("nth", nth("title", "place"))
    found = shown.join(rows.withColumn("nth", nth("p_name", "p_partkey")).withColumnRenamed("p_name", "title"), ["page", "asin", "title", "nth"])
    return catalogs.untried(found, rows.where("p_partkey % 4 = 1"), rows.where("p_partkey % 3 = 0"), ["goal", "p_partkey"]).select("page", "goal", "asin", "title")


@registry.add("SELECT o_custkey AS goal, stage, asin FROM (SELECT o_custkey, CASE o_orderkey % 3 WHEN 0 THEN 'initial' WHEN 1 THEN 'query' ELSE 'catalog' END AS stage, CAST(o_orderkey AS VARCHAR) AS asin, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3, o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O') WHERE k = 1")
def planner_stages(spark, root):
    """The first stage whose recorded try won."""
    tries = table(spark, root, "orders").select(F.col("o_custkey").alias("goal"), F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'initial' WHEN 1 THEN 'query' ELSE 'catalog' END").alias("stage"), F.col("o_orderkey").alias("place"), F.col("o_orderkey").cast("string").alias("asin"), (F.col("o_orderstatus") == "O").alias("won"))
    return catalogs.first_stage(tries, ["initial", "query", "catalog"])


@registry.add("SELECT p_partkey AS asin, CASE p_size % 4 WHEN 1 THEN 'a,b' ELSE 'both' END AS plan FROM part WHERE p_size % 4 <> 3")
def option_cover(spark, root):
    """The values of a product's option groups that together cover two wanted options, the first found."""
    rows = table(spark, root, "part").select(F.col("p_partkey").alias("asin"), "p_size")
    choice = lambda grp, ord_, mask, value: F.struct(F.lit(grp).alias("grp"), F.lit(ord_).alias("ord"), F.lit(mask).cast("long").alias("mask"), F.lit(value).alias("value"))
    by_size = F.when(F.col("p_size") % 4 == 0, F.array(choice(0, 0, 0, "none"), choice(0, 1, 3, "both"), choice(1, 0, 3, "more"))).when(F.col("p_size") % 4 == 1, F.array(choice(0, 0, 1, "a"), choice(1, 0, 2, "b"))).when(F.col("p_size") % 4 == 2, F.array(choice(0, 0, 2, "b"), choice(1, 0, 1, "a"), choice(1, 1, 3, "both"))).otherwise(F.array(choice(0, 0, 1, "a"), choice(0, 1, 2, "b")))
    choices = rows.select("asin", F.explode(by_size).alias("c")).select("asin", "c.*")
    return catalog.plans(choices, 2).select("asin", F.array_join("plan", ",").alias("plan"))


@registry.add("SELECT page_id, sha1('blob ' || strlen(html) || chr(0) || html) AS blob_id, url IS NOT DISTINCT FROM CASE WHEN page_id % 2 = 0 THEN url END AS same, CAST(floor((page_id - 5) / 7) AS BIGINT) AS epoch, page_id % 10 = 0 OR page_id = 33 AS saved FROM pages")
def ids_and_epochs(spark, root):
    """File ids, equality with nulls, passes over the data, steps that are saved."""
    step = F.col("page_id")
    return table(spark, root, "pages").select("page_id", I.blob_id(F.col("html")).alias("blob_id"), F.col("url").eqNullSafe(F.when(step % 2 == 0, F.col("url"))).alias("same"), catalogs.epoch(step, 5, 7).alias("epoch"), catalogs.saved(step, [], 10, 33).alias("saved"))


@registry.add("SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) || ' & <b>' AS plain FROM conversations")
def html_normalised(spark, root):
    """character references decoded, lowered, white space collapsed."""
    return table(spark, root, "conversations").select("conv_id", "turn", T.html_norm(F.concat("text", F.lit(" &amp;  &lt;B&gt;"))).alias("plain"))


@registry.add(STEPS + " SELECT task, rep, list_transform(list({'t': t, 'a': action, 'f': feedback, 'r': rejected} ORDER BY t), lambda x: x.a || '|' || x.f || '|' || CASE WHEN x.r THEN 'no' ELSE '-' END) AS past FROM st GROUP BY task, rep")
def public_past(spark, root):
    """What was public about the decisions so far; states and later outcomes aren't."""
    row = F.struct("t", "action", "feedback", F.lit(None).cast("string").alias("format_error"), F.when(F.col("rejected"), "no").alias("env_rejection"), F.col("key_after").alias("state"))
    past = steps(spark, root).groupBy("task", "rep").agg(F.array_sort(F.collect_list(row)).alias("steps")).select("task", "rep", I.public_past(F.col("steps")).alias("p"))
    return past.select("task", "rep", F.transform("p", lambda x: F.concat_ws("|", x["action"], x["feedback"], F.coalesce(x["env_rejection"], F.lit("-")))).alias("past"))


def parts_as_objects(spark, root) -> DataFrame:
    """Parts as objects: those of one number modulo 50 are a state; of 12 in a row, the first is the root, the next three
    lie in it, and each of the others in one of those."""
    rows = table(spark, root, "part").select((F.col("p_partkey") % 50).alias("state"), F.expr("(p_partkey - p_partkey % 50) DIV 50").alias("k"), "p_name", "p_size", "p_retailprice")
    parent = F.expr("CASE WHEN k % 12 = 0 THEN NULL WHEN k % 12 < 4 THEN k - k % 12 ELSE k - k % 12 + 1 + k % 3 END")
    properties = F.to_json(F.struct(F.col("p_size").alias("size"), F.struct(F.col("p_retailprice").alias("temperatureC"), F.lit(1500.0).alias("meltingPoint")).alias("propMaterial")))
    return rows.select("state", F.col("k").alias("id"), parent.alias("parent"), F.col("p_name").alias("name"), properties.alias("properties"))


@registry.add("WITH RECURSIVE o AS (SELECT p_partkey % 50 AS state, (p_partkey - p_partkey % 50) // 50 AS id, p_name AS name FROM part), q AS (SELECT *, CASE WHEN id % 12 = 0 THEN NULL WHEN id % 12 < 4 THEN id - id % 12 ELSE id - id % 12 + 1 + id % 3 END AS parent FROM o), r AS (SELECT state, id, 0 AS depth, CAST(NULL AS VARCHAR) AS room FROM q WHERE parent IS NULL UNION ALL SELECT q.state, q.id, r.depth + 1, CASE WHEN r.depth = 0 THEN q.name ELSE r.room END FROM q JOIN r ON q.state = r.state AND q.parent = r.id) SELECT state, id, room FROM r")
def object_rooms(spark, root):
    """F21."""
    return objects.rooms(spark, parts_as_objects(spark, root))


@registry.add(None)
def snapshot_keys(spark, root):
    """keys of states from their object trees; the tests hold them against a plain recursion."""
    own = parts_as_objects(spark, root)
    control = own.groupBy("state").agg(F.min("name").alias("focus")).select("state", F.when(F.col("state") % 2 == 0, F.col("focus")).alias("focus"), F.array(F.array(F.lit("0"), F.lit("true"))).alias("goal_flags"), F.when(F.col("state") % 7 == 3, "no tree").alias("error"))
    return objects.state_keys(own, control)


def written(spark, root) -> DataFrame:
    """Steps as records write them: every seventh in a wrong format, every eleventh bound to another action."""
    more = {"semantic_action": F.expr("CASE WHEN event_id % 11 = 0 THEN concat('menu ', action) ELSE action END"), "format_error": F.expr("CASE WHEN event_id % 7 = 0 THEN 'no tag' END"), "rejection": F.expr("CASE WHEN rejected THEN 'not now' END")}
    return steps(spark, root).withColumns(more)


@registry.add(None)
def student_records(spark, root):
    """Each new execution as shown with each of its decisions, plain and with pointers; the tests write them by
    hand."""
    rows = written(spark, root).where("student")
    plain, packed = (records.student_records(rows, c) for c in (False, True))
    return plain.withColumnRenamed("text", "plain").join(packed, ["task", "rep", "t"]).select("task", "rep", "t", F.md5(F.col("plain").cast("binary")).alias("plain"), F.md5(F.col("text").cast("binary")).alias("packed"))


@registry.add(None)
def source_records(spark, root):
    """Each source with all its events, committed or not."""
    rows, tries = tried(spark, root)
    facts = rows.where("NOT student").groupBy("task", "rep").agg(F.bool_or("won").alias("won"), F.max("n").alias("n_steps"), F.min_by("observation", "t").alias("initial"))
    facts = facts.withColumns({"kind": F.lit("teacher"), "file": F.concat(F.col("rep").cast("string"), F.lit(".json")), "role": F.lit("selected"), "replay_limit": F.expr("CASE WHEN rep % 5 = 4 THEN 'Not certified.' END"), "trusted": F.expr("rep % 5 <> 4"), "anchor": F.expr("CASE WHEN rep % 3 <> 0 THEN 1 END")})
    events = A.merged(rows, tries).withColumnRenamed("kind", "kind_of_event")
    out = records.source_records(events, facts, True)
    return out.select("task", "rep", F.md5(F.col("text").cast("binary")).alias("text"))


@registry.add(STEPS + """, r AS (SELECT task, rep, max(n) AS n, bool_or(event_id % 53 = 0) AS odd, bool_or(event_id % 59 = 0) AS gap FROM st GROUP BY task, rep)
SELECT task, rep, CASE WHEN n > 15 OR rep % 9 = 8 THEN 'not_a_completed_execution' WHEN odd THEN 'not_only_executed_actions' WHEN gap THEN 'replay_differs' WHEN rep % 7 = 6 THEN 'inconsistent_outcome' END AS problem FROM r""")
def planner_verdicts(spark, root):
    """Recorded planner executions that may serve as sources, or why not."""
    rows = steps(spark, root).select("task", "rep", "t", "event_id", "n", "observation", F.col("key_after").alias("key"), (F.col("t") == F.col("n") - 1).alias("done"), F.lit(1.0).alias("reward"), F.expr("event_id % 53 <> 0").alias("executed"), F.lit(None).cast("string").alias("format_error"))
    again = rows.withColumn("reward", F.when(F.col("event_id") % 59 == 0, 0.5).otherwise(1.0 + 1e-12))
    ends = rows.groupBy("task", "rep").agg(F.count("*").alias("n")).select("task", "rep", F.expr("rep % 9 <> 8").alias("complete"), F.lit(True).alias("done"), F.lit(1.0).alias("score"), F.expr("rep % 7 <> 6").alias("won"))
    return verify.planner_verdict(rows.drop("n", "event_id"), again.select("task", "rep", "t", "observation", "key", "done", "reward"), ends)


@registry.add(_TRIED + ", c AS (SELECT task, rep, count(*) AS n_attempts, count(*) FILTER (accepted) AS n_accepted FROM tr GROUP BY task, rep), s AS (SELECT task, rep, count(*) FILTER (k > 1) AS n_retried FROM (SELECT task, rep, t, count(*) AS k FROM tr GROUP BY task, rep, t) GROUP BY task, rep) SELECT task, rep, n_attempts, n_accepted, n_retried, concat_ws(',', 'accepted=' || n_accepted, CASE WHEN n_attempts > n_accepted THEN 'not_executable=' || (n_attempts - n_accepted) END) AS types FROM c JOIN s USING (task, rep)")
def attempt_counts(spark, root):
    """A10: attempts by type, and decisions that were tried more than once."""
    said = F.array_join(F.transform(F.array_sort(F.map_entries("types")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return A.attempt_counts(tried(spark, root)[1]).withColumn("types", said)
