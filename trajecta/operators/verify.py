"""Recorded executions against their replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions import identity as I


def replay(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What was recorded and what a replay shows, for data without a simulator: the replay has the true states."""
    recorded = steps.select("task", "rep", "t", F.col("feedback").alias("recorded"))
    return recorded, steps.select("task", "rep", "t", F.col("key_after").alias("replayed"))


def compare(recorded: DataFrame, replayed: DataFrame) -> DataFrame:
    """Both by place; a decision that only one has is a mismatch."""
    both = recorded.join(replayed, ["task", "rep", "t"], "full")
    return both.withColumn("same", F.col("recorded").eqNullSafe(F.col("replayed")) & F.col("recorded").isNotNull())


def trusted_prefix(compared: DataFrame) -> DataFrame:
    """One row per execution: decisions, mismatches, and how many decisions come before the first mismatch."""
    return compared.groupBy("task", "rep").agg(F.count("*").alias("n"), F.count_if(~F.col("same")).alias("n_mismatch"), F.coalesce(F.min(F.when(~F.col("same"), F.col("t"))), F.count("*")).alias("trusted"))


def cut(steps: DataFrame, trust: DataFrame) -> DataFrame:
    """The decisions before an execution's first mismatch."""
    return steps.join(trust.select("task", "rep", "trusted"), ["task", "rep"]).where("t < trusted").drop("trusted")


def object_changes(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, old, new): fields that differ, and rows that only one side has (field 'exists')."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.explode(F.map_from_arrays(F.array(F.lit("exists"), *map(F.lit, fields)), F.array(F.lit("true"), *(F.col(f).cast("string") for f in fields)))).alias("field", name))

    both = long(before, "old").join(long(after, "new"), [key, "field"], "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


# The field that says whether an object is there, the temperature's, and where its thresholds stand.
EXISTS, TEMPERATURE = "存在", "properties.propMaterial.temperatureC"
THRESHOLDS = ["propMaterial.meltingPoint", "propMaterial.boilingPoint", "propLife.minTemp", "propLife.maxTemp"]


def _number(variant: str) -> str:
    """SQL of a variant's value as a double; null unless it is a number (true counts as 1, false as 0)."""
    return f"CASE WHEN schema_of_variant({variant}) RLIKE '^(BIGINT|DECIMAL|DOUBLE|FLOAT)' THEN try_variant_get({variant}, '$', 'double') WHEN schema_of_variant({variant}) = 'BOOLEAN' THEN CAST(try_variant_get({variant}, '$', 'boolean') AS double) END"


def _bins(whole: str, quantum: float) -> Column:
    """The signature of the temperature of an object (see identity.temperature)."""
    at = lambda p: F.expr(_number(f"try_variant_get({whole}, '$.properties.{p}', 'variant')"))
    return I.temperature(at("propMaterial.temperatureC"), {p.split(".")[1]: at(p) for p in THRESHOLDS}, quantum)


def nested_changes(before: DataFrame, after: DataFrame, keys: list[str], quantum: float = 1.0) -> DataFrame:
    """(keys, id, object, field, before, after, place, before_label, after_label, before_bin, after_bin).

    before and after: keys, id, object (JSON text of name, parent, room, properties). Objects are met by id; objects within
    them are gone into as long as both sides have one, so a field is the path to the deepest value that differs; lists are
    values. A missing entry and a null are alike, and so are two spellings of a number. A temperature that stays in its bin
    and on its sides of the thresholds hasn't changed. A parent has its name as a label, as its side has it. place: by the
    ids as numbers, then by the path. Values are text, null where there is none.

    A recursive query goes down one level of all objects at a time, and only where the texts differ.
    """
    spark = before.sparkSession
    sides = before.select(*keys, "id", F.col("object").alias("oa")).join(after.select(*keys, "id", F.col("object").alias("ob")), [*keys, "id"], "full")
    sides = sides.select(*keys, "id", F.parse_json("oa").alias("wa"), F.parse_json("ob").alias("wb"))
    name = lambda c: F.try_variant_get(c, "$.name", "string")
    one = F.col("wa").isNull() | F.col("wb").isNull()
    there = lambda c: F.col(c).isNotNull().cast("string")
    gone = sides.where(one).select(*keys, "id", F.coalesce(name("wa"), name("wb")).alias("object"), F.array(F.lit(EXISTS)).alias("path"), there("wa").alias("before"), there("wb").alias("after"))
    own = ", ".join(f"`{k}`" for k in keys)
    deep = ", ".join(f"d.`{k}`" for k in keys)
    found = spark.sql(
        f"""WITH RECURSIVE d({own}, id, path, a, b) MAX RECURSION LEVEL 1000 AS (
              SELECT {own}, id, CAST(array() AS array<string>), wa, wb FROM {{sides}} WHERE wa IS NOT NULL AND wb IS NOT NULL
              UNION ALL
              SELECT {own}, id, array_append(path, e), try_element_at(ma, e), try_element_at(mb, e)
              FROM (SELECT {deep}, d.id, d.path, try_variant_get(d.a, '$', 'map<string,variant>') AS ma, try_variant_get(d.b, '$', 'map<string,variant>') AS mb FROM d)
              LATERAL VIEW explode(array_union(map_keys(ma), map_keys(mb))) AS e
              WHERE ma IS NOT NULL AND mb IS NOT NULL AND NOT to_json(try_element_at(ma, e)) <=> to_json(try_element_at(mb, e)))
            SELECT {own}, id, path, a, b FROM d WHERE size(path) > 0 AND (try_variant_get(a, '$', 'map<string,variant>') IS NULL OR try_variant_get(b, '$', 'map<string,variant>') IS NULL) LIMIT ALL""",
        sides=sides,
    )
    said = lambda v: F.expr(f"CASE WHEN {v} IS NULL OR is_variant_null({v}) THEN NULL WHEN schema_of_variant({v}) = 'STRING' THEN try_variant_get({v}, '$', 'string') ELSE to_json({v}) END")
    kind_ = lambda v: F.expr(f"CASE WHEN {v} IS NULL OR is_variant_null({v}) THEN NULL ELSE schema_of_variant({v}) = 'STRING' END")
    number = F.coalesce(F.expr(_number("a")) == F.expr(_number("b")), F.lit(False))
    values = found.select(*keys, "id", "path", said("a").alias("before"), said("b").alias("after"), (kind_("a").eqNullSafe(kind_("b")) & said("a").eqNullSafe(said("b")) | number).alias("same"))
    values = values.where("NOT same").drop("same").join(sides.where(~one).select(*keys, "id", name("wb").alias("object"), _bins("wa", quantum).alias("ta"), _bins("wb", quantum).alias("tb")), [*keys, "id"])
    field = F.array_join("path", ".")
    warm = field == TEMPERATURE
    kept = values.where(~(warm & F.col("ta").eqNullSafe(F.col("tb"))))
    bins = [F.when(warm, F.to_json(c)).alias(n) for c, n in (("ta", "before_bin"), ("tb", "after_bin"))]
    none = [F.lit(None).cast("string").alias(n) for n in ("before_bin", "after_bin")]
    every = kept.select(*keys, "id", "object", "path", "before", "after", *bins).unionByName(gone.select("*", *none))
    every = every.withColumn("field", field).withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("id").cast("long"), "path")))
    # names of parents: met only by the changes of a parent
    for side, label, objects in (("before", "before_label", "wa"), ("after", "after_label", "wb")):
        names = sides.where(F.col(objects).isNotNull()).select(*keys, F.col("id").alias("parent_"), name(objects).alias("name_"))
        every = every.withColumn("parent_", F.when(F.col("field") == "parent", F.col(side))).join(names, [*keys, "parent_"], "left").withColumn(label, F.when(F.col("field") == "parent", F.coalesce("name_", side))).drop("parent_", "name_")
    return every.select(*keys, "id", "object", "field", "before", "after", "place", "before_label", "after_label", "before_bin", "after_bin")


# Why a recorded planner execution isn't taken over, in the order in which it is judged.
INCOMPLETE, NOT_EXECUTED, DIFFERS, OUTCOME = "not_a_completed_execution", "not_only_executed_actions", "replay_differs", "inconsistent_outcome"


def planner_verdict(steps: DataFrame, replayed: DataFrame, runs: DataFrame, most: int = 15, tolerance: float = 1e-9) -> DataFrame:
    """(task, rep, problem): null for executions that may serve as sources.

    steps and replayed: task, rep, t, observation, key, done, reward (steps also executed, format_error); runs: task, rep,
    complete, done, score, won. Decision by decision the replay must show the same, its reward within the tolerance.
    """
    keys = ["task", "rep"]
    other = replayed.select(*keys, "t", *(F.col(c).alias(f"{c}_again") for c in ("observation", "key", "done", "reward")))
    both = steps.withColumn("here", F.lit(True)).join(other.withColumn("there", F.lit(True)), [*keys, "t"], "full_outer")
    same = F.col("here").isNotNull() & F.col("there").isNotNull() & F.coalesce(F.abs(F.col("reward") - F.col("reward_again")) <= tolerance, F.lit(False))
    for c in ("observation", "key", "done"):
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_again"))
    ran = F.col("executed").eqNullSafe(True) & (F.coalesce("format_error", F.lit("")) == "")
    facts = both.groupBy(*keys).agg(F.count_if("here").alias("n"), F.bool_and(F.when(F.col("here"), ran)).alias("ran"), F.bool_and(same).alias("same"), F.max(F.when(F.col("here"), F.struct("t", "done", "reward"))).alias("l"))
    rows = runs.join(facts, keys, "left")
    score = F.when(F.col("l.done"), F.col("l.reward")).otherwise(0.0)
    sound = ~F.isnan(score) & (F.abs(score) < float("inf")) & F.col("done").eqNullSafe(F.col("l.done")) & (F.abs(F.col("score") - score) <= tolerance) & F.col("won").eqNullSafe(F.col("done") & (score >= 1 - tolerance))
    ok = lambda c: F.coalesce(c, F.lit(False))
    return rows.select(*keys, F.when(~ok(F.col("n").between(1, most) & F.col("complete")), INCOMPLETE).when(~ok(F.col("ran")), NOT_EXECUTED).when(~ok(F.col("same")), DIFFERS).when(~ok(sound), OUTCOME).alias("problem"))
