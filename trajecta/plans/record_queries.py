"""Queries over replays, rolled-back attempts and nested objects, with their SQL oracles.

The events give the decisions; the attempts at them, what a replay of them shows, and objects come from events and ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.operators import branches as B
from trajecta.operators import graph, history, verify
from trajecta.plans.event_queries import _BINDING, _KIND, STEPS, steps
from trajecta.plans.names import Registry
from trajecta.session import table

registry = Registry()

#: Why a replay differs at a decision.
_FAILURE = f"CASE WHEN event_id % 97 = 0 THEN 'committed_step_mismatch' WHEN event_id % 101 = 0 THEN 'accepted_attempt_alignment_mismatch' WHEN t = 0 AND event_id % 31 = 0 THEN '{B.NO_START}' WHEN event_id % 89 = 0 AND t + 1 < n THEN '{B.TOO_EARLY}' END"
#: Up to two rejected attempts before a decision; k counts them.
_TYPE = "CASE WHEN event_id % 59 = 0 THEN 'interrupted' WHEN (event_id + k) % 4 = 0 THEN 'format_invalid' ELSE 'environment_rejection' END"
_TRIED = {
    "command": "CASE k WHEN 0 THEN 'use thing' ELSE 'look around' END",
    "shown": "CASE k WHEN 0 THEN 'No known action matches that input.' ELSE 'You see nothing.' END",
    "reason": "CASE WHEN k = 1 AND event_id % 2 = 0 THEN 'not_executable' END",
    "key_changed": "CASE WHEN event_id % 6 = 1 THEN key_before || '*' END",
    "same": "event_id % 53 <> 0",
}


def replayed(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Decisions with `failure`, and the attempts at them."""
    rows = steps(spark, root).withColumn("failure", F.expr(_FAILURE))
    each = rows.withColumn("k", F.explode(F.expr("array_append(filter(array(0, 1), x -> x < event_id % 3), 3)")))
    tried = each.select("task", "rep", (F.col("t") * 4 + F.col("k")).alias("seq"), F.expr("CASE WHEN event_id % 61 = 0 AND k < 3 THEN 0 ELSE t + 1 END").alias("step"), F.expr(f"CASE WHEN k = 3 THEN 'accepted' ELSE {_TYPE} END").alias("type"), F.lit(None).cast("string").alias("raw_output"), *(F.expr(v).alias(k) for k, v in _TRIED.items()))
    return rows, tried


_AUDIT = (
    STEPS
    + f""", fl AS (SELECT *, {_FAILURE} AS failure FROM st),
cm AS (SELECT task, rep, count(*) AS n, min({{'t': t, 'u': CASE failure WHEN '{B.TOO_EARLY}' THEN t + 1 WHEN '{B.NO_START}' THEN -1 ELSE t END, 'f': failure}}) FILTER (failure IS NOT NULL) AS f FROM fl GROUP BY task, rep),
c2 AS (SELECT task, rep, n, coalesce(f.u, n) AS upto, f.f AS failure FROM cm),
att AS (SELECT task, rep, t * 4 + k AS seq, CASE WHEN event_id % 61 = 0 THEN -1 ELSE t END AS prefix, {_TYPE} AS type, {', '.join(f'{v} AS {k}' for k, v in _TRIED.items())} FROM st, unnest(range(0, event_id % 3)) AS u(k)),
bad AS (SELECT task, rep, seq, prefix FROM att WHERE prefix >= 0 AND (type = 'interrupted' OR (type = 'environment_rejection' AND NOT same))),
so AS (SELECT a.task, a.rep, a.seq, min(b.prefix) FILTER (b.seq < a.seq) AS before, min(b.prefix) AS ever FROM att a LEFT JOIN bad b USING (task, rep) GROUP BY ALL),
au AS (SELECT a.*, c2.n, c2.upto, least(upto, coalesce(ever, upto)) AS cut, CASE WHEN prefix < 0 OR prefix > least(upto, coalesce(before, upto)) THEN '{B.OUTSIDE}' WHEN type = 'format_invalid' THEN '{B.FORMAT}' WHEN type = 'interrupted' THEN '{B.UNKNOWN_TYPE}' WHEN same THEN '{B.BRANCH}' ELSE '{B.DIFFERS}' END AS status FROM att a JOIN so USING (task, rep, seq) JOIN c2 USING (task, rep)),
kb AS (SELECT * FROM au WHERE status IN ('{B.FORMAT}', '{B.BRANCH}') AND prefix <= cut),
ag AS (SELECT task, rep, min(cut) AS cut, count(*) FILTER (status IN ('{B.FORMAT}', '{B.BRANCH}') AND prefix <= cut) AS n_branches, count(*) FILTER (status = '{B.DIFFERS}') AS n_differ, count(*) FILTER (status = '{B.OUTSIDE}') AS n_outside FROM au GROUP BY task, rep),
rec AS (SELECT task, rep, n AS n_source, greatest(coalesce(cut, upto), 0) AS n_steps, coalesce(cut, upto) + 1 AS n_states, coalesce(n_branches, 0) AS n_branches, coalesce(n_outside, 0) AS n_outside, (failure IS NOT NULL)::BIGINT + coalesce(n_differ, 0) AS n_failures, failure FROM c2 LEFT JOIN ag USING (task, rep)),
record AS (SELECT *, n_states = n_source + 1 AND n_failures = 0 AS trusted_complete FROM rec)"""
)
#: Branches in the graph, the decisions that stay, and all appearances of states.
_GRAPH = (
    _AUDIT
    + f""", kd AS (SELECT *, {_KIND} AS kind FROM st),
ob AS (SELECT *, CASE WHEN kind = 'state_change' AND command = 'look around' AND rejection IS NULL OR kind = 'internal_observation' THEN 1 END AS saw FROM kd),
pr AS (SELECT *, count(saw) OVER (PARTITION BY task, rep ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_prior FROM ob),
places AS (SELECT task, rep, t AS prefix, key_before AS source, n_prior FROM pr UNION ALL SELECT task, rep, n, key_after, 0 FROM pr WHERE t = n - 1),
b0 AS (SELECT kb.task, kb.rep, kb.seq, kb.prefix, kb.status, p.source, CASE WHEN type <> 'format_invalid' THEN coalesce(key_changed, p.source) ELSE p.source END AS target, CASE WHEN type <> 'format_invalid' THEN command END AS command, CASE WHEN type <> 'format_invalid' THEN coalesce(reason, CASE WHEN kb.shown LIKE 'No known%' THEN 'unknown_command' END) END AS rejection,
  CASE WHEN type = 'format_invalid' THEN coalesce(reason, 'recorded_format_invalid') END AS format_error, CASE WHEN kb.prefix < kb.cut THEN p.n_prior ELSE 0 END AS n_prior FROM kb JOIN places p USING (task, rep, prefix)),
br AS (SELECT task, rep, seq, prefix, source, target, command, CASE WHEN source <> target THEN 'state_change' WHEN format_error IS NOT NULL THEN 'format_invalid' WHEN command = 'look around' AND rejection IS NULL THEN 'internal_observation' WHEN rejection IS NOT NULL THEN 'rejection' ELSE 'unchanged_non_observation' END AS kind, coalesce(command = 'look around', false) AS is_observation,
  source <> target AND rejection IS NOT NULL AS passive_during_rejection, source <> target AS physical_changed, n_prior, status FROM b0),
ks AS (SELECT kd.*, r.n_steps, r.trusted_complete FROM kd JOIN record r USING (task, rep) WHERE t < n_steps),
mem AS (SELECT task, key_before AS key, rep, 0 AS phase, t AS place, 0 AS tag FROM ks UNION ALL SELECT task, key_after, rep, 0, t + 1, 0 FROM ks WHERE t = n_steps - 1
  UNION ALL SELECT task, 'start', rep, 0, 0, 0 FROM record WHERE n_steps = 0 AND n_states = 1
  UNION ALL SELECT task, source, rep, 1, seq, 0 FROM br UNION ALL SELECT task, target, rep, 1, seq, 1 FROM br)"""
)


@registry.add(_AUDIT + " SELECT task, rep, seq, prefix, type, status, cut FROM au")
def attempt_audit(spark, root):
    """What became of each rejected attempt."""
    return B.audited(*replayed(spark, root))


@registry.add(_AUDIT + " SELECT * FROM record")
def replay_record(spark, root):
    """What a replay lets stand of each execution."""
    return B.records(*replayed(spark, root))


def grown(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The decisions that stay, the first states of executions of which none does, and the branches."""
    rows, tried = replayed(spark, root)
    seen = history.prior_evidence(graph.kind(rows))
    hung = B.branch_table(seen, B.audited(rows, tried), B.rejected_attempts(tried))
    record = B.records(rows, tried)
    return B.trusted_steps(rows, record), B.lone_starts(rows, record), hung


@registry.add(_GRAPH + " SELECT * FROM br")
def branch_table(spark, root):
    """Branches of rolled-back attempts, on the prefixes that stay."""
    return grown(spark, root)[2]


@registry.add(_GRAPH + """, won AS (SELECT DISTINCT task, key_after AS key FROM ks WHERE t = n_steps - 1 AND won AND trusted_complete),
g AS (SELECT task, key, count(*) FILTER (phase = 0) AS n_visits, count(*) FILTER (phase = 1) AS n_rolled_back, bool_or(phase = 0 AND place = 0) AS is_start, min({'a': phase, 'b': rep, 'c': place, 'd': tag}) AS f FROM mem GROUP BY task, key)
SELECT task, key, 'N' || (row_number() OVER (PARTITION BY task ORDER BY f) - 1) AS id, n_visits, n_rolled_back, is_start, won.key IS NOT NULL AS is_won FROM g LEFT JOIN won USING (task, key)""")
def node_numbers(spark, root):
    """Nodes with their branches, numbered by first appearance."""
    return B.nodes(*grown(spark, root))


@registry.add(_GRAPH + f""", ev AS (SELECT task, key_before AS source, key_after AS target, command, rep, 0 AS phase, t AS place, positive, rejection IS NOT NULL AS passive, command = 'look around' AND NOT {_BINDING} AS obs FROM ks WHERE key_before <> key_after UNION ALL SELECT task, source, target, command, rep, 1, seq, false, passive_during_rejection, is_observation FROM br WHERE source <> target),
g AS (SELECT task, source, target, command, count(*) AS n_members, count(*) FILTER (positive) AS n_positive, count(*) FILTER (phase = 1) AS n_rolled_back, bool_or(passive) AS passive, arg_min(obs, {{'a': phase, 'b': rep, 'c': place}}) AS observation_with_change, min({{'a': phase, 'b': rep, 'c': place}}) AS f FROM ev GROUP BY ALL)
SELECT * EXCLUDE (f), 'E' || (row_number() OVER (PARTITION BY task ORDER BY f) - 1) AS id FROM g""")
def edge_numbers(spark, root):
    """Moves with those of branches, numbered by first appearance."""
    kept, _, hung = grown(spark, root)
    return B.edges(kept, hung)


@registry.add(_GRAPH + f" SELECT task, key, rep // {B.PAGE} AS page, string_agg(rep || ':' || CASE WHEN phase = 0 THEN 't' || place ELSE 'a' || place || CASE WHEN tag = 0 THEN '-' ELSE '+' END END, ' ' ORDER BY rep, phase, place, tag) AS members FROM mem GROUP BY task, key, rep // {B.PAGE}")
def node_members(spark, root):
    """A1: the appearances of each node, in pages."""
    return B.member_pages(*grown(spark, root)).withColumn("members", F.array_join("members", " "))


@registry.add(_GRAPH + f""", a AS (SELECT task, kind, false AS hung FROM ks UNION ALL SELECT task, kind, true FROM br) SELECT task, count(*) AS decision_records, count(*) FILTER (NOT hung) AS committed_decision_records, count(*) FILTER (hung) AS attempt_branch_records, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in graph.PARSER_KINDS)} FROM a GROUP BY task""")
def record_stats(spark, root):
    """Records of decisions, committed and of branches, by kind."""
    kept, _, hung = grown(spark, root)
    return B.stats(kept, hung)


#: An object's record as nested JSON, before and after a decision: where it is, and properties that are objects or plain.
_OBJECT = """'{"name": "' || action || '", "parent": "' || band || '", "room": ' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '"r' || band || '"' END || ', "properties": {"props": ' || props || ', "propMaterial": {"temperatureC": ' || CAST(round(value, 1) AS {text}) || ', "meltingPoint": 40, "boilingPoint": ' || CASE WHEN event_id % 5 = 0 THEN '1e2' ELSE '100.0' END || '}, "tags": ' || CASE event_id % 4 WHEN 0 THEN '7' WHEN 1 THEN '{"list": [1, ' || band || '], "odd": true}' WHEN 2 THEN '{}' ELSE '{"odd": {"deep": {"er": ' || band || '}}}' END || '}}'"""


def objects_of_states(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(state, id, object) before and after each decision but the first: the object that the event before it touched,
    and the one that it touched, under ids that now and then differ."""
    rows = steps(spark, root).join(table(spark, root, "events").select("event_id", "props"), "event_id").withColumn("band", F.split_part("key_after", F.lit("|"), F.lit(2)))
    made = rows.withColumn("object", F.expr(_OBJECT.replace("{text}", "STRING"))).withColumn("id", F.expr("CAST(event_id % 2 + 9 AS STRING)"))
    state = lambda t: F.concat_ws(":", "task", "rep", t)
    return made.select(state(F.col("t") + 1).alias("state"), "id", "object").where("object IS NOT NULL"), made.where("t > 0").select(state(F.col("t")).alias("state"), "id", "object")


def _path(p: str) -> str:
    return f"""SELECT state, id, '{p}' AS field, oa, ob, oa->'$.{p}' AS a, ob->'$.{p}' AS b FROM pairs"""


#: The paths that the objects have, by hand; one counts if both sides above it are objects and it is none on both sides.
_PATHS = ["name", "parent", "room", "properties.props.k", "properties.propMaterial.temperatureC", "properties.propMaterial.meltingPoint", "properties.propMaterial.boilingPoint", "properties.tags", "properties.tags.odd", "properties.tags.list", "properties.tags.odd.deep", "properties.tags.odd.deep.er"]
_BIN = "[floor({0} + 0.5)::BIGINT, sign({0} - 40)::BIGINT, sign({0} - 100)::BIGINT]"


def _said(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR json_type({x}) = 'NULL' THEN NULL WHEN json_type({x}) = 'VARCHAR' THEN json_extract_string({x}, '$') WHEN json_type({x}) IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN printf('%g', CAST({x} AS DOUBLE)) ELSE replace(CAST({x} AS VARCHAR), ' ', '') END"


@registry.add(
    STEPS
    + f""", ob AS (SELECT task, rep, t, CAST(event_id % 2 + 9 AS VARCHAR) AS id, ({_OBJECT.replace("{text}", "VARCHAR")})::JSON AS o FROM st),
bf AS (SELECT task || ':' || rep || ':' || (t + 1) AS state, id, o FROM ob), af AS (SELECT task || ':' || rep || ':' || t AS state, id, o FROM ob WHERE t > 0),
both_ AS (SELECT coalesce(bf.state, af.state) AS state, coalesce(bf.id, af.id) AS id, bf.o AS oa, af.o AS ob FROM bf FULL JOIN af ON bf.state = af.state AND bf.id = af.id),
ex AS (SELECT state, id, json_extract_string(coalesce(oa, ob), '$.name') AS object, '存在' AS field, CAST(oa IS NOT NULL AS VARCHAR) AS before, CAST(ob IS NOT NULL AS VARCHAR) AS after FROM both_ WHERE oa IS NULL OR ob IS NULL),
pairs AS (SELECT * FROM both_ WHERE oa IS NOT NULL AND ob IS NOT NULL),
long AS ({' UNION ALL '.join(_path(p) for p in _PATHS)}),
fit AS (SELECT *, CASE field WHEN 'properties.tags.odd' THEN json_type(oa->'$.properties.tags') = 'OBJECT' AND json_type(ob->'$.properties.tags') = 'OBJECT' WHEN 'properties.tags.list' THEN json_type(oa->'$.properties.tags') = 'OBJECT' AND json_type(ob->'$.properties.tags') = 'OBJECT'
  WHEN 'properties.tags.odd.deep' THEN coalesce(json_type(oa->'$.properties.tags.odd') = 'OBJECT' AND json_type(ob->'$.properties.tags.odd') = 'OBJECT', false) WHEN 'properties.tags.odd.deep.er' THEN coalesce(json_type(oa->'$.properties.tags.odd.deep') = 'OBJECT' AND json_type(ob->'$.properties.tags.odd.deep') = 'OBJECT', false) ELSE true END AS inside, coalesce(json_type(a) = 'OBJECT' AND json_type(b) = 'OBJECT', false) AS split FROM long),
val AS (SELECT state, id, json_extract_string(ob, '$.name') AS object, field, {_said('a')} AS before, {_said('b')} AS after, a, b FROM fit WHERE inside AND NOT split),
df AS (SELECT state, id, object, field, before, after FROM val WHERE before IS DISTINCT FROM after AND NOT (field = 'properties.propMaterial.temperatureC' AND {_BIN.format("TRY_CAST(a AS DOUBLE)")} = {_BIN.format("TRY_CAST(b AS DOUBLE)")})),
al AS (SELECT * FROM ex UNION ALL SELECT * FROM df)
SELECT al.*, row_number() OVER (PARTITION BY al.state ORDER BY CAST(al.id AS BIGINT), string_split(field, '.')) AS place, CASE WHEN field = 'parent' THEN coalesce(json_extract_string(bf.o, '$.name'), before) END AS before_label, CASE WHEN field = 'parent' THEN coalesce(json_extract_string(af.o, '$.name'), after) END AS after_label
FROM al LEFT JOIN bf ON bf.state = al.state AND bf.id = al.before AND field = 'parent' LEFT JOIN af ON af.state = al.state AND af.id = al.after AND field = 'parent'"""
)
def object_diff_nested(spark, root):
    """What changed in each object, at any depth; values as text."""
    changes = verify.nested_changes(*objects_of_states(spark, root), ["state"])
    return changes.select("state", "id", "object", "field", "before", "after", "place", "before_label", "after_label")
