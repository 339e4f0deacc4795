"""Queries over executions, evaluation runs, catalogs and tables: rendering, metrics, guards; with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.functions import identity as I
from trajecta.functions import text as T
from trajecta.operators import batching, catalog, graph, history, metrics, render, retrieval, verify
from trajecta.plans.event_queries import REFERENCES, STEPS, science, steps
from trajecta.plans.names import Registry
from trajecta.session import table
from trajecta.sources import adapters, files, store

registry = Registry()
RUNS = STEPS + ", runs AS (SELECT task, rep, max(n) AS n, bool_or(won) AS won, bool_or(student) AS student, max(value) AS progress FROM st GROUP BY task, rep)"


def runs(spark: SparkSession, root: str) -> DataFrame:
    return steps(spark, root).groupBy("task", "rep").agg(F.max("n").alias("n"), F.bool_or("won").alias("won"), F.bool_or("student").alias("student"), F.max("value").alias("progress"))


_TEXTS = ", pl AS (SELECT task, rep, string_agg('[' || t || '] ' || key_before || ' -> ' || action, chr(10) ORDER BY t) AS text FROM st GROUP BY task, rep), ff AS (SELECT *, min(t) OVER (PARTITION BY task, rep, key_before) AS f FROM st), rr AS (SELECT *, CAST(sum(CASE WHEN t = f THEN 1 ELSE 0 END) OVER (PARTITION BY task, rep ORDER BY t) AS BIGINT) - 1 AS running FROM ff), lb AS (SELECT *, min(running) OVER (PARTITION BY task, rep, key_before) AS label FROM rr), pk AS (SELECT task, rep, string_agg('[' || t || '] ' || CASE WHEN t = f THEN 'OBS' || label || ': ' || key_before ELSE 'same as OBS' || label END || ' -> ' || action, chr(10) ORDER BY t) AS text FROM lb GROUP BY task, rep)"


@registry.add(science(REFERENCES + _TEXTS + """ SELECT r.task, r.rep, r.t, count(*) AS n_references, md5(string_agg('## ' || role || ' from ' || p.rep || ' at ' || source_at || chr(10) || p.text, chr(10) ORDER BY list_position(['selected', 'historical', 'failure'], role))) AS digest
FROM refs r JOIN pl p ON p.task = r.task AND p.rep = CASE WHEN r.source_rep < 0 THEN r.rep ELSE r.source_rep END GROUP BY r.task, r.rep, r.t"""))
def render_evidence(spark, root):
    """The text of all references of a decision."""
    s = steps(spark, root)
    refs = retrieval.references(s)
    return render.evidence(refs, render.runs(s, False)).select("task", "rep", "t", "n_references", F.md5(F.col("text").cast("binary")).alias("digest"))


_WORDS = lambda c: f"len(regexp_split_to_array({c}, '\\s+'))"


@registry.add(STEPS + _TEXTS + f", x AS (SELECT pl.task, pl.rep, pl.text AS p, pk.text AS k, CASE WHEN {_WORDS('pl.text')} <= 40 THEN 'plain' WHEN {_WORDS('pk.text')} <= 64 - 24 THEN 'compressed' END AS form FROM pl JOIN pk USING (task, rep)) SELECT task, rep, form, md5(CASE form WHEN 'plain' THEN p WHEN 'compressed' THEN k END) AS digest, form IS NULL AS over FROM x")
def budget_choice(spark, root):
    """Uncompressed, else compressed, else over the budget."""
    s = steps(spark, root)
    out = render.budgeted(render.runs(s, False), render.runs(s, True), 40, ["task", "rep"])
    return out.select("task", "rep", "form", F.md5(F.col("text").cast("binary")).alias("digest"), "over")


@registry.add(science(""" SELECT task, rep, t, replace("case", '_', ' ') || ': ' || CASE selected WHEN 'source' THEN 'follow a recorded success, ' || selected_cost || ' decisions to its end' WHEN 'student_self' THEN 'the own rest is shortest, ' || selected_cost || ' decisions' ELSE 'no success to follow' END AS said FROM fc"""))
def explanations(spark, root):
    """R13."""
    return retrieval.four_case(steps(spark, root)).select("task", "rep", "t", render.explanation(F.col("case"), F.col("selected"), F.col("selected_cost")).alias("said"))


@registry.add(
    STEPS.replace("WITH num", "WITH RECURSIVE num", 1)
    + """, own AS (SELECT task, rep, t, n, executed, shown, CASE WHEN shown LIKE 'Ambiguous%' THEN '0=open door ' || band || ';1=b' ELSE '' END AS opts, rejection IS NOT NULL AS no FROM st),
p AS (SELECT task, rep, t, executed, CASE WHEN executed AND opts <> '' THEN 'pending_menu' ELSE 'normal' END AS mode, CASE WHEN executed THEN opts ELSE '' END AS options, '' AS last_known, CAST(NULL AS VARCHAR) AS previous_mode FROM own WHERE t = 0
  UNION ALL SELECT o.task, o.rep, o.t, o.executed, CASE WHEN NOT o.executed THEN p.mode WHEN o.no AND p.mode <> 'normal' THEN 'unknown' WHEN o.opts <> '' THEN 'pending_menu' ELSE 'normal' END, CASE WHEN NOT o.executed THEN p.options WHEN o.no AND p.mode <> 'normal' THEN '' ELSE o.opts END,
    CASE WHEN NOT o.executed THEN p.last_known WHEN o.no AND p.mode <> 'normal' THEN CASE WHEN p.options <> '' THEN p.options ELSE p.last_known END ELSE '' END, CASE WHEN NOT o.executed THEN p.previous_mode WHEN o.no AND p.mode <> 'normal' THEN p.mode END FROM own o JOIN p ON o.task = p.task AND o.rep = p.rep AND o.t = p.t + 1)
SELECT task, rep, t, mode, options, last_known, previous_mode, NOT executed AS preserved FROM p"""
)
def interaction_state_machine(spark, root):
    """The parser after each decision; the SQL takes one decision after the other."""
    said = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return history.interaction(steps(spark, root)).select("task", "rep", "t", "mode", said("options").alias("options"), said("last_known").alias("last_known"), "previous_mode", "preserved")


@registry.add(STEPS + ", o AS (SELECT task, rep, list({'t': t, 'k': key_before, 'a': action} ORDER BY t) AS l FROM st GROUP BY task, rep) SELECT task, rep, list_reduce(list_concat([sha256('start')], list_transform(l, lambda x: x.k || '|' || x.a)), lambda d, x: sha256(d || '|' || x)) AS digest FROM o")
def history_digest(spark, root):
    """W9."""
    return history.digests(steps(spark, root))


_SEED = "count(*) AS n, avg(CASE WHEN won THEN 1.0 ELSE 0 END) * 100 AS success, avg(greatest(progress, 0)) AS progress, avg(n) AS rounds, avg(n) FILTER (won) AS success_rounds, avg(n) FILTER (NOT won) AS failure_rounds"
_ROUND = "n, round(success, 9) AS success, round(progress, 9) AS progress, round(rounds, 9) AS rounds, round(success_rounds, 9) AS success_rounds, round(failure_rounds, 9) AS failure_rounds"


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "n", *(F.round(c, 9).alias(c) for c in metrics.METRICS))


@registry.add(RUNS + f", s AS (SELECT rep % 4 AS seed, {_SEED} FROM runs GROUP BY rep % 4) SELECT seed, {_ROUND} FROM s")
def seed_summary(spark, root):
    """A12."""
    return rounded(metrics.by_seed(runs(spark, root).withColumn("seed", F.col("rep") % 4), ["seed"]), "seed")


@registry.add(RUNS + f", s AS (SELECT CASE WHEN task % 2 = 0 THEN 'valid_seen' ELSE 'valid_unseen' END AS split, rep % 4 AS seed, {_SEED} FROM runs GROUP BY ALL) SELECT split, seed, {_ROUND} FROM s")
def split_summary(spark, root):
    """A14."""
    split = F.when(F.col("task") % 2 == 0, "valid_seen").otherwise("valid_unseen")
    return rounded(metrics.by_seed(runs(spark, root).withColumn("seed", F.col("rep") % 4).withColumn("split", split), ["split", "seed"]), "split", "seed")


@registry.add(RUNS + f", s AS (SELECT rep % 4 AS seed, {_SEED} FROM runs GROUP BY rep % 4), u AS (SELECT metric, v FROM (SELECT seed, success, progress, rounds, success_rounds, failure_rounds FROM s) UNPIVOT INCLUDE NULLS (v FOR metric IN (success, progress, rounds, success_rounds, failure_rounds))), c AS (SELECT metric, count(v) AS k, avg(v) AS m, stddev_samp(v) AS d FROM u GROUP BY metric) SELECT metric, round(CASE WHEN k = (SELECT count(*) FROM s) THEN m END, 9) AS mean, round(CASE WHEN k = (SELECT count(*) FROM s) THEN d END, 9) AS sample_std FROM c")
def across_seed_summary(spark, root):
    """A13."""
    out = metrics.across_seeds(metrics.by_seed(runs(spark, root).withColumn("seed", F.col("rep") % 4), ["seed"]))
    return out.select("metric", F.round("mean", 9).alias("mean"), F.round("sample_std", 9).alias("sample_std"))


@registry.add(RUNS + ", s AS (SELECT task AS step, rep % 4 AS seed, avg(CASE WHEN won THEN 1.0 ELSE 0 END) * 100 AS success FROM runs GROUP BY ALL), p AS (SELECT step, avg(success) AS success, count(DISTINCT seed) AS k FROM s GROUP BY step) SELECT step, round(success, 9) AS success FROM p WHERE k = (SELECT count(DISTINCT seed) FROM s) ORDER BY success DESC, step LIMIT 1")
def best_checkpoint(spark, root):
    """Tasks stand for checkpoints."""
    scores = metrics.by_seed(runs(spark, root).withColumn("seed", F.col("rep") % 4).withColumnRenamed("task", "step"), ["step", "seed"])
    return metrics.best_checkpoint(scores).select("step", F.round("success", 9).alias("success"))


@registry.add(RUNS + ", g AS (SELECT *, CASE WHEN won THEN 1.0 ELSE 0.0 END AS r FROM runs) SELECT task, rep, round(CASE WHEN count(*) OVER w = 1 THEN r / 1.000001 ELSE (r - avg(r) OVER w) / (stddev_samp(r) OVER w + 0.000001) END, 9) AS advantage FROM g WINDOW w AS (PARTITION BY task)")
def group_advantage(spark, root):
    """A15."""
    rewards = runs(spark, root).withColumn("r", F.col("won").cast("double"))
    return batching.group_advantage(rewards, "task", "r").select("task", "rep", F.round("advantage", 9).alias("advantage"))


@registry.add(RUNS + " SELECT count(*) AS n_episodes, CAST(sum(n) AS BIGINT) AS n_decisions, round(avg(CASE WHEN won THEN 1.0 ELSE 0 END), 9) AS success_rate FROM runs WHERE n > 0")
def batch_meta(spark, root):
    """A17."""
    return batching.batch_meta(runs(spark, root)).select("n_episodes", "n_decisions", F.round("success_rate", 9).alias("success_rate"))


@registry.add(RUNS + ", g AS (SELECT DISTINCT task, r AS rep FROM runs, range(24) AS x(r)) SELECT task, rep, coalesce(c.n, 0) AS n, g.task IS NOT NULL AS expected FROM g FULL JOIN (SELECT task, rep, count(*) AS n FROM runs GROUP BY task, rep) c USING (task, rep) WHERE coalesce(c.n, 0) <> 1 OR g.task IS NULL")
def coverage_check(spark, root):
    """J13."""
    found = runs(spark, root)
    return metrics.coverage(found, found, 24)


@registry.add(RUNS + ", g AS (SELECT DISTINCT task, r AS rep FROM runs, range(24) AS x(r)) SELECT task, rep FROM g WHERE NOT EXISTS (SELECT 1 FROM runs WHERE runs.task = g.task AND runs.rep = g.rep AND runs.won)")
def resume_antijoin(spark, root):
    """Jobs of the grid that no won execution has done."""
    found = runs(spark, root)
    return store.missing(store.grid(found.select("task").distinct(), 24), found.where("won"), ["task", "rep"])


@registry.add("WITH t AS (SELECT DISTINCT p_type AS task FROM part), n AS (SELECT row_number() OVER (ORDER BY task) - 1 AS idx, task FROM t), c AS (SELECT count(*) AS n FROM t) SELECT idx, task, false AS padding FROM n UNION ALL SELECT n + k, '__padding__' || k, true FROM c, range(31) AS r(k) WHERE k < (32 - n % 32) % 32")
def padded_tasks(spark, root):
    """S17."""
    return store.padded_tasks(table(spark, root, "part").select(F.col("p_type").alias("task")), 32)


@registry.add(RUNS + " SELECT task, count(*) AS k, count(*) FILTER (won) AS n_won, coalesce(string_agg(rep, ',' ORDER BY rep) FILTER (won), '') AS won_reps, sha256(string_agg(rep || '|' || n || '|' || won, ';' ORDER BY rep)) AS digest FROM runs GROUP BY task")
def manifest(spark, root):
    """S16, S11."""
    return store.manifest(runs(spark, root))


@registry.add("WITH b AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 89 <> 0), a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 101 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 97 <> 0), l AS (SELECT o_orderkey, unnest(['exists', 'o_orderstatus', 'o_orderpriority']) AS field, unnest(['true', o_orderstatus, o_orderpriority]) AS old FROM b), r AS (SELECT o_orderkey, unnest(['exists', 'o_orderstatus', 'o_orderpriority']) AS field, unnest(['true', o_orderstatus, o_orderpriority]) AS new FROM a) SELECT o_orderkey, field, old, new FROM l FULL JOIN r USING (o_orderkey, field) WHERE old IS DISTINCT FROM new")
def object_diff(spark, root):
    """Orders as objects, before and after a change."""
    orders = table(spark, root, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    after = orders.where("o_orderkey % 97 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 101 == 0, "X").otherwise(F.col("o_orderstatus")))
    return verify.object_changes(orders.where("o_orderkey % 89 <> 0"), after, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


def goals(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "part").select(F.col("p_partkey").alias("goal"), F.col("p_retailprice").alias("price_upper"), F.array("p_brand", "p_type").alias("wanted"))


_MATCHES = "SELECT g.p_partkey AS goal, p.p_partkey AS asin, p.p_retailprice AS price FROM part p JOIN part g ON p.p_retailprice <= g.p_retailprice AND p.p_brand = g.p_brand AND p.p_type = g.p_type"


@registry.add(_MATCHES)
def catalog_matches(spark, root):
    """Products within a goal's price that cover its options; every part is a goal."""
    return catalog.matches(adapters.products(table(spark, root, "part")), goals(spark, root))


@registry.add(_MATCHES + " QUALIFY row_number() OVER (PARTITION BY g.p_partkey ORDER BY p.p_partkey) <= 2")
def catalog_capped(spark, root):
    """At most two candidates of a goal, in order; every part is a goal."""
    return catalog.matches(adapters.products(table(spark, root, "part")), goals(spark, root), most=2)


@registry.add("SELECT p_partkey AS asin, CASE p_size % 7 WHEN 0 THEN 100.0 WHEN 1 THEN 100.0 WHEN 2 THEN 0.0 WHEN 3 THEN 0.0 WHEN 4 THEN 2.25 WHEN 5 THEN 1299.99 ELSE round(p_retailprice, 2) END AS lower FROM part")
def price_floor(spark, root):
    """no price, an empty one, unreadable ones, several, and plain ones."""
    pricing = F.expr("CASE p_size % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'ask us' WHEN 3 THEN '$3 or $x' WHEN 4 THEN 'from $3.50 to $2.25 and $1' WHEN 5 THEN '$1,299.99' ELSE concat('$', format_string('%.2f', p_retailprice), ' to $999999.00') END")
    return table(spark, root, "part").select(F.col("p_partkey").alias("asin"), F.round(T.price_floor(pricing), 2).alias("lower"))


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP) + "]"
_JOINED = lambda *lists: ", ".join(f"array_to_string({x}, ' ')" for x in lists)


@registry.add(
    rf"""WITH w AS (SELECT p_partkey AS asin, string_split(trim(regexp_replace(replace(replace(p_name, '[', ' '), ']', ' '), '\s+', ' ', 'g')), ' ') AS w FROM part),
c AS (SELECT *, list_filter(w, lambda x: NOT list_contains({_STOP}, lower(x))) AS core FROM w),
l AS (SELECT *, list_transform(list_sort(list_transform(core, lambda x, i: {{'l': -len(x), 'i': i, 'w': x}}))[1:6], lambda x: x.w) AS longest FROM c),
m AS (SELECT asin, list_transform([CAST(asin AS VARCHAR), '"' || array_to_string(w, ' ') || '"', {_JOINED("w[1:4]", "w[1:8]", "w[greatest(len(w) - 7, 1):]", "core[1:10]", "longest", "list_concat(w[1:2], w[greatest(len(w) - 3, 1):])")}], lambda q: lower(trim(q))) AS m FROM l)
SELECT asin, array_to_string(list_filter(m, lambda q, i: q <> '' AND list_position(m, q) = i), chr(10)) AS queries FROM m"""
)
def query_candidates(spark, root):
    """all of a product's queries, in order, one a line."""
    made = T.queries_of(F.col("asin").cast("string"), F.col("name"), F.lit(""))
    return adapters.products(table(spark, root, "part")).select("asin", F.array_join(made, "\n").alias("queries"))


@registry.add(None)
def option_masks(spark, root):
    """distinct part types against wanted options by word sets."""
    return catalog.option_masks(table(spark, root, "part").select(F.col("p_type").alias("value")), ["STANDARD POLISHED TIN", "small brass", "LARGE"])


@registry.add(RUNS + " SELECT task, rep, n, won, 'teacher' AS family FROM runs WHERE rep < 8 UNION ALL SELECT task, rep, n, won, 'planner' FROM runs WHERE rep >= 8 AND n BETWEEN 1 AND 12 AND won AND task IN (SELECT task FROM runs WHERE rep < 8)")
def planner_merge(spark, root):
    """J8, J9, O8."""
    found = runs(spark, root).select("task", "rep", "n", "won")
    return store.augment(found.where("rep < 8"), found.where("rep >= 8"), 12)


@registry.add(STEPS + " SELECT task, rep, count(*) FILTER (NOT rejected AND key_before <> key_after) AS accepted, count(*) FILTER (rejected) AS environment_rejection, count(*) FILTER (NOT rejected AND key_before = key_after) AS not_executable, count(*) AS n FROM st GROUP BY task, rep")
def attempt_summary(spark, root):
    """A10, A11."""
    still = F.col("key_before") == F.col("key_after")
    return steps(spark, root).groupBy("task", "rep").agg(F.count_if(~F.col("rejected") & ~still).alias("accepted"), F.count_if("rejected").alias("environment_rejection"), F.count_if(~F.col("rejected") & still).alias("not_executable"), F.count("*").alias("n"))


@registry.add("WITH r AS (SELECT DISTINCT l_suppkey AS k, l_linenumber AS split FROM lineitem), m AS (SELECT k, count(*) AS n FROM r GROUP BY k) SELECT split, count(*) AS n, count(*) FILTER (m.n > 1) AS n_shared FROM r JOIN m USING (k) GROUP BY split")
def split_overlap(spark, root):
    """The keys of each split, and how many of them another split has too."""
    rows = table(spark, root, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("split")).distinct()
    shared = rows.groupBy("k").agg(F.count("*").alias("m"))
    return rows.join(shared, "k").groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("m") > 1).alias("n_shared"))


@registry.add("SELECT CAST(c_custkey % 3 AS BIGINT) AS split, count(*) AS n FROM customer GROUP BY c_custkey % 3")
def split_disjoint(spark, root):
    """Three splits, checked to share no key (a shared one raises), and their sizes."""
    rows = table(spark, root, "customer").select("c_custkey", (F.col("c_custkey") % 3).alias("split"))
    store.disjoint({str(k): rows.where(F.col("split") == k) for k in range(3)}, "c_custkey")
    return rows.groupBy("split").agg(F.count("*").alias("n"))


# --- extras, beyond the engine's model ------------------------------------------------------------------------------


@registry.add("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def extra_pricing_summary(spark, root):
    """Not of the reference: one scan, one small aggregate."""
    rows = table(spark, root, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@registry.add("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def extra_hourly_events(spark, root):
    """Not of the reference: tumbling windows."""
    return table(spark, root, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


#: Parts as products with option groups, and as goals; every fifth has a range of prices, every seventh none.
_PRICING = "CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN concat('$', CAST(p_retailprice AS {text}), ' to $', CAST(p_retailprice - 50 AS {text})) ELSE concat('$', CAST(p_retailprice AS {text})) END"


def shelf(spark: SparkSession, root: str) -> DataFrame:
    """asin, place, pricing, real (price), groups: brand, type, size, and for every third part its type once more."""
    group = lambda name, *values: F.struct(F.lit(name).alias("name"), F.array(*values).alias("values"))
    size = F.concat(F.lit("Size "), F.col("p_size").cast("string"))
    own = F.array(group("Brand", "p_brand", F.lit("plain/any")), group("TYPE", "p_type"), group("Size", size))
    return table(spark, root, "part").select(F.col("p_partkey").alias("asin"), F.col("p_partkey").alias("place"), F.expr(_PRICING.replace("{text}", "STRING")).alias("pricing"), F.col("p_retailprice").alias("real"), F.when(F.col("p_partkey") % 3 == 0, F.concat(own, F.array(group("Extra", "p_type")))).otherwise(own).alias("groups"))


def wishes(spark: SparkSession, root: str) -> DataFrame:
    """Every part as a goal: its size, brand and type, written in another way, at its price."""
    return table(spark, root, "part").select(F.col("p_partkey").alias("goal"), F.col("p_retailprice").alias("price_upper"), F.array(F.concat(F.col("p_size").cast("string"), F.lit(" size")), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lower("p_type")).alias("wanted"))


def _priced(rows: DataFrame) -> DataFrame:
    return rows.select("goal", "asin", "price", F.array_join("names", ",").alias("names"), F.array_join("plan", ",").alias("plan"))


_SAME = "FROM part g JOIN part p ON p.p_brand = g.p_brand AND p.p_type = g.p_type AND p.p_size = g.p_size"


@registry.add(f"""WITH q AS (SELECT *, CASE WHEN p_partkey % 7 = 0 THEN 100 WHEN p_partkey % 5 = 0 THEN least(p_retailprice, p_retailprice - 50) ELSE p_retailprice END AS price FROM part)
SELECT g.p_partkey AS goal, p.p_partkey AS asin, p.price, 'brand,type,size' AS names, lower(p.p_brand) || ',' || lower(p.p_type) || ',size ' || p.p_size AS plan {_SAME.replace('JOIN part p', 'JOIN q p')} WHERE p.price <= g.p_retailprice QUALIFY row_number() OVER (PARTITION BY g.p_partkey ORDER BY p.p_partkey) <= 3""")
def catalog_price_theta(spark, root):
    """The first three products of each goal by a lower bound of their prices; likeness 100 alone, which SQL
    can tell."""
    rows = shelf(spark, root).withColumn("price", T.price_floor(F.col("pricing")))
    return _priced(catalog.priced(rows, wishes(spark, root), most=3, least=99.5))


@registry.add(f"SELECT g.p_partkey AS goal, p.p_partkey AS asin, p.p_retailprice AS price, CASE WHEN p.p_partkey % 3 = 0 THEN 'brand,size,extra' ELSE 'brand,type,size' END AS names, CASE WHEN p.p_partkey % 3 = 0 THEN lower(p.p_brand) || ',size ' || p.p_size || ',' || lower(p.p_type) ELSE lower(p.p_brand) || ',' || lower(p.p_type) || ',size ' || p.p_size END AS plan {_SAME} WHERE p.p_retailprice <= g.p_retailprice")
def catalog_owned(spark, root):
    """The exact pass: real prices, and values that belong to the last group that has them."""
    return catalog.priced(shelf(spark, root).withColumn("price", F.col("real")), wishes(spark, root), owners=True, least=99.5, said=",")


@registry.add(None)
def catalog_fuzzy(spark, root):
    """Likeness over 85, all products of each goal; the tests look at every pair."""
    rows = shelf(spark, root).withColumn("price", T.price_floor(F.col("pricing")))
    return catalog.priced(rows, wishes(spark, root), said=",")


_RANGE = lambda keys, rest: f"('0x' || substr(md5({keys}), 1, 15))::BIGINT % 64 AS r, ('0x' || substr(md5({rest}), 1, 15))::BIGINT AS d"
_SIDES = """a AS (SELECT r, count(*) AS n_base, sum(d::HUGEINT) AS da FROM b0 GROUP BY r), b AS (SELECT r, count(*) AS n_other, sum(d::HUGEINT) AS db FROM o0 GROUP BY r)
SELECT r AS range, coalesce(n_base, 0) AS n_base, coalesce(n_other, 0) AS n_other FROM a FULL JOIN b USING (r) WHERE da IS DISTINCT FROM db OR coalesce(n_base, 0) <> coalesce(n_other, 0)"""


def changed_orders(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Orders, and orders of which every 3001st is gone and every 2003rd has another status."""
    base = table(spark, root, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return base, base.where("o_orderkey % 3001 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 2003 == 0, "X").otherwise(F.col("o_orderstatus")))


@registry.add(f"""WITH b0 AS (SELECT {_RANGE('o_orderkey::VARCHAR', "o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority")} FROM orders), o0 AS (SELECT {_RANGE('o_orderkey::VARCHAR', "o_orderkey || '|' || CASE WHEN o_orderkey % 2003 = 0 THEN 'X' ELSE o_orderstatus END || '|' || o_orderpriority")} FROM orders WHERE o_orderkey % 3001 <> 0), {_SIDES}""")
def merge_guard(spark, root):
    """The ranges of keys in which two tables differ, by fingerprints."""
    return files.guard(*changed_orders(spark, root), ["o_orderkey"])


@registry.add(f"WITH b0 AS (SELECT {_RANGE('o_orderkey::VARCHAR', 'o_orderkey::VARCHAR')} FROM orders), o0 AS (SELECT {_RANGE('o_orderkey::VARCHAR', 'o_orderkey::VARCHAR')} FROM orders WHERE o_orderkey % 3001 <> 0), {_SIDES}")
def key_guard(spark, root):
    """The same for the keys alone."""
    return files.guard(*changed_orders(spark, root), ["o_orderkey"], columns=[])


@registry.add("WITH t AS (SELECT DISTINCT p_type || p_brand AS task FROM part), g AS (SELECT task, r AS rep FROM t, range(3) AS x(r)), n AS (SELECT row_number() OVER (ORDER BY task, rep) - 1 AS idx, task, rep FROM g) SELECT idx, task, rep FROM n WHERE idx % 4 = 1")
def job_shards(spark, root):
    """One of four shards of the grid of jobs, by place."""
    tasks = table(spark, root, "part").select(F.concat("p_type", "p_brand").alias("task")).distinct()
    return store.nth_shard(store.grid(tasks, 3), ["task", "rep"], 4, 1).select("idx", "task", "rep")


_SCORED = STEPS + ", sc AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN 120 ELSE value END AS score, t = n - 1 AND event_id % 3 <> 0 AS done FROM st), ag AS (SELECT task, rep, max(score) AS top, arg_max(score, t) AS final_score, arg_max(done, t) AS done, count(*) AS length, count(*) FILTER (format_error IS NOT NULL) AS n_format_errors, count(*) FILTER (rejection IS NOT NULL) AS n_rejections FROM sc GROUP BY task, rep)"


@registry.add(_SCORED + " SELECT task, rep, greatest(top, CAST(rep % 200 AS DOUBLE)) AS best_score, final_score, length, final_score >= 100 AS won, done AND final_score >= 100 - 1e-9 AS won_if_ended, n_format_errors, n_rejections FROM ag")
def episode_metrics(spark, root):
    """Best and final scores, lengths, wins by either rule, errors."""
    rows = steps(spark, root).withColumn("score", F.expr("CASE WHEN event_id % 7 = 0 THEN 120D ELSE value END")).withColumn("done", F.expr("t = n - 1 AND event_id % 3 <> 0"))
    starts = rows.where("t = 0").select("task", "rep", (F.col("rep") % 200).cast("double").alias("initial_score"))
    ended = metrics.episode_metrics(rows, starts, 100.0, True, 1e-9).select("task", "rep", F.col("won").alias("won_if_ended"))
    return metrics.episode_metrics(rows, starts).join(ended, ["task", "rep"])


@registry.add("SELECT 'model' AS column, count(DISTINCT p_brand) AS n, min(p_brand) AS first, max(p_brand) AS last FROM part HAVING count(DISTINCT p_brand) > 1 UNION ALL SELECT 'backend', count(DISTINCT p_type), min(p_type), max(p_type) FROM part HAVING count(DISTINCT p_type) > 1")
def mixed_settings(spark, root):
    """Settings in which results differ that one summary would hold; here brands and types stand for them."""
    rows = table(spark, root, "part").select(F.col("p_brand").alias("model"), F.col("p_type").alias("backend"), F.lit("v1").alias("version"))
    return metrics.several_settings(rows, ["model", "backend", "version"])


@registry.add(
    STEPS
    + """, r AS (SELECT task, count(*) AS n_runs, count(*) FILTER (NOT complete) AS n_untrusted, avg(n) AS mean_steps FROM st WHERE t = 0 GROUP BY task),
nd AS (SELECT task, key, split_part(key, '|', 1) AS coarse, count(*) AS v, count(DISTINCT rep) AS reps FROM vis GROUP BY task, key),
sh AS (SELECT task, count(*) FILTER (reps >= 2) AS n_shared FROM nd GROUP BY task),
co AS (SELECT task, coarse, count(*) AS n, sum(v) AS v FROM nd GROUP BY task, coarse),
pg AS (SELECT task, count(*) FILTER (n > 1) AS n_coarse_groups, string_agg(coarse || '=' || v, ',' ORDER BY coarse) AS pages FROM co GROUP BY task)
SELECT task, n_runs, n_untrusted, round(mean_steps, 9) AS mean_steps, n_shared, n_coarse_groups, pages FROM r JOIN sh USING (task) JOIN pg USING (task)"""
)
def shop_stats(spark, root):
    """A8."""
    rows = graph.shop_stats(steps(spark, root))
    pages = F.array_join(F.transform(F.array_sort(F.map_entries("pages")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return rows.withColumn("mean_steps", F.round("mean_steps", 9)).withColumn("pages", pages)


@registry.add("""SELECT event_id, props = CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '{"k": ' || (event_id % 100) || '}' END IS TRUE AS same FROM events""")
def same_values(spark, root):
    """properties against other writings of them: with blanks and zeros, with another number, and no JSON."""
    number = F.get_json_object("props", "$.k")
    other = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{ "k" :'), number, F.lit(".0 }"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"k": '), (F.col("event_id") % 100).cast("string"), F.lit("}"))).otherwise(F.lit("{k"))
    return table(spark, root, "events").select("event_id", I.same_value(F.col("props"), other).alias("same"))
