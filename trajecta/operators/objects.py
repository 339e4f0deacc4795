"""Object trees of a state: rooms by inheritance, and keys that don't depend on ids or the order of contents.

objects: state, id, parent (null for a root), name, properties (JSON text).
"""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def rooms(spark: SparkSession, objects: DataFrame) -> DataFrame:
    """(state, id, room): the name of the ancestor that lies directly in a root, for itself and all below it. A
    recursive query: one join a level for all states at once, however many objects there are and however deep they lie."""
    return spark.sql(
        """WITH RECURSIVE placed(state, id, depth, room) MAX RECURSION LEVEL 100000 AS (
             SELECT state, id, 0, CAST(NULL AS STRING) FROM {o} WHERE parent IS NULL
             UNION ALL SELECT o.state, o.id, p.depth + 1, CASE WHEN p.depth = 0 THEN o.name ELSE p.room END FROM {o} o JOIN placed p ON o.state = p.state AND o.parent = p.id)
           SELECT state, id, room FROM placed LIMIT ALL""",
        o=objects,
    )


# The thresholds of a temperature, and where they stand in an object's properties.
THRESHOLDS = {"propMaterial": ["meltingPoint", "boilingPoint"], "propLife": ["minTemp", "maxTemp"]}


def _number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def with_bins(properties: dict, quantum: float = 1.0) -> dict:
    """The properties with a temperature as its bin and its sides of the known thresholds."""
    material = properties.get("propMaterial") or {}
    if "temperatureC" not in material:
        return properties
    t, sides = material["temperatureC"], {}
    for part, names in THRESHOLDS.items():
        values = properties.get(part) or {}
        sides |= {n: (t > values[n]) - (t < values[n]) for n in names if _number(values.get(n)) and _number(t)}
    reading = {"bin": int((t / quantum + 0.5) // 1), "threshold_sides": sides} if _number(t) else None
    return {**properties, "propMaterial": {**material, "temperatureC": reading}}


def tree_hash(ids: list, parents: list, names: list, properties: list[str]) -> str:
    """Digest of the trees of one state, from the leaves up; contents are put in order by their own text."""
    below = defaultdict(list)
    for k, p in enumerate(parents):
        below[p].append(k)
    # children come after their parents in this order, so its reverse has every content ready
    order, texts = list(below[None]), {}
    for k in order:
        order.extend(below[ids[k]])
    for k in reversed(order):
        node = {"name": names[k], "properties": with_bins(json.loads(properties[k] or "{}"))}
        head = json.dumps(node, sort_keys=True)
        # "contents" sorts before the other names, and the parts are texts already
        texts[k] = '{"contents": [' + ", ".join(sorted(texts[c] for c in below[ids[k]])) + "], " + head[1:]
    return hashlib.sha256(("[" + ", ".join(sorted(texts[k] for k in below[None])) + "]").encode()).hexdigest()


def state_keys(objects: DataFrame, control: DataFrame) -> DataFrame:
    """(state, physical_hash, key, object_count, capture_ok): the digest of a state's trees, and of that with the
    focus and the goal flags; tick, score and room play no part.

    control: state, focus, goal_flags (arrays of texts), error. A state that couldn't be captured, or whose objects can't
    be read, has null keys. What is gathered is one state's objects.
    """

    def run(group: pa.Table) -> pa.Table:
        g = group.to_pydict()
        try:
            made = tree_hash(g["id"], [None if p is None or p != p else p for p in g["parent"]], g["name"], g["properties"])
        except (ValueError, TypeError, AttributeError):
            made = None
        return pa.table({"state": pa.array([g["state"][0]], pa.int64()), "physical_hash": pa.array([made], pa.string()), "object_count": pa.array([len(g["id"])], pa.int64())})

    hashed = objects.select("state", "id", "parent", "name", "properties").groupBy("state").applyInArrow(run, "state long, physical_hash string, object_count long")
    rows = control.join(hashed, "state", "left")
    ok = F.col("error").isNull() & F.col("physical_hash").isNotNull()
    return rows.select("state", F.when(ok, F.col("physical_hash")).alias("physical_hash"), F.when(ok, control_key(F.col("physical_hash"), F.col("focus"), F.col("goal_flags"))).alias("key"), F.when(ok, F.col("object_count")).alias("object_count"), ok.alias("capture_ok"))


def control_key(physical_hash: Column, focus: Column, goal_flags: Column) -> Column:
    """The digest of a tree's digest with what controls the task, as JSON with a blank after commas and colons."""
    flags = F.array_join(F.transform(goal_flags, lambda g: F.concat(F.lit('["'), g[0], F.lit('", "'), g[1], F.lit('"]'))), ", ")
    text = F.to_json(F.array(focus))
    shown = F.when(focus.isNull(), "null").otherwise(F.substring(text, F.lit(2), F.length(text) - 2))
    return F.sha2(F.concat(F.lit('["'), physical_hash, F.lit('", {"focus_reference": '), shown, F.lit(', "goal_flags": ['), flags, F.lit("]}]")).cast("binary"), 256)
