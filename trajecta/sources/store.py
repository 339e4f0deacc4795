"""Task lists, recorded documents, manifests and prepared task tables: readers, writers and their guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A recorded step; readers name their schema, so nothing is inferred by reading twice.
STEP = T.StructType([T.StructField("step", T.IntegerType()), T.StructField("action", T.StringType()), T.StructField("observation_before", T.StringType()), T.StructField("feedback", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("done", T.BooleanType())])
EPISODE = T.StructType([T.StructField("uid", T.StringType()), T.StructField("task", T.StringType()), T.StructField("rep", T.IntegerType()), T.StructField("won", T.BooleanType()), T.StructField("steps", T.ArrayType(STEP)), T.StructField("retry_counts", T.MapType(T.StringType(), T.IntegerType()))])


class BadInput(ValueError):
    """Recorded data that breaks a rule of its format."""


def refuse(rows: DataFrame, why: str) -> None:
    """Raises if there is a row; asks for one only."""
    found = rows.limit(1).collect()
    if found:
        raise BadInput(f"{why}: {found[0].asDict()}")


def task_list(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, family, variation, simplification) of a JSON list of "family|variation|simplification" texts, or of an
    object whose `tasks` have a `gamefile`. Ids have three parts, the second a number, and occur once."""
    raw = spark.read.text(path, wholetext=True).select("value")
    plain = F.from_json("value", "array<string>")
    nested = F.transform(F.from_json("value", "struct<tasks:array<struct<gamefile:string>>>")["tasks"], lambda t: t["gamefile"])
    ids = raw.select(F.explode(F.when(F.trim("value").startswith("["), plain).otherwise(nested)).alias("task_id"))
    parts = F.split("task_id", r"\|")
    rows = ids.select("task_id", parts[0].alias("family"), F.expr("try_cast(split(task_id, '[|]')[1] AS INT)").alias("variation"), F.get(parts, 2).alias("simplification"), F.size(parts).alias("n"))
    refuse(rows.where("task_id IS NULL OR n <> 3 OR variation IS NULL OR family = ''"), "not a task id")
    refuse(rows.groupBy("task_id").count().where("count > 1"), "a task twice")
    return rows.drop("n")


def unsafe_path(path: Column) -> Column:
    """Absolute paths, steps upward, backslashes, and anything but a game file."""
    return path.isNull() | path.startswith("/") | path.contains("\\") | path.rlike(r"(^|/)\.\.(/|$)") | ~path.endswith("game.tw-pddl")


def episodes(spark: SparkSession, path: str) -> DataFrame:
    """Recorded episodes of a folder of JSON files, gzip or not; a malformed file is an error."""
    return spark.read.schema(EPISODE).option("multiLine", True).option("mode", "FAILFAST").json(path)


def episode_steps(recorded: DataFrame) -> DataFrame:
    """One row per recorded step, in the order of the file."""
    return recorded.select("task", "rep", "won", F.posexplode("steps").alias("t", "s")).select("task", "rep", "won", "t", "s.*")


def missing(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Expected jobs without a result: what is left to do after a stop."""
    return expected.join(found.select(*keys).distinct(), keys, "left_anti")


def grid(tasks: DataFrame, reps: int) -> DataFrame:
    """Every task with repetitions 0 to reps - 1."""
    return tasks.select("task", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))).alias("rep"))


def shard(rows: DataFrame, keys: list[str], shards: int, own: int) -> DataFrame:
    """A share of the rows that depends on their keys alone, so that shards need no common order."""
    return rows.where(F.pmod(F.xxhash64(*keys), F.lit(shards)) == own)


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `idx`: the place of each row among all in the order of its keys, which are unique. Places come from counts per
    range of keys, so no task sees all rows."""
    from pyspark.sql import Window

    # a given number of ranges isn't merged at run time, so both uses below see the same ones
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("p_", F.spark_partition_id())
    counts = ranged.groupBy("p_").agg(F.count("*").alias("c_"))
    before = counts.withColumn("base_", F.coalesce(F.sum("c_").over(Window.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("p_", "base_")
    own = F.row_number().over(Window.partitionBy("p_").orderBy(*keys)) - 1
    return ranged.withColumn("k_", own).join(F.broadcast(before), "p_").withColumn("idx", F.col("base_") + F.col("k_")).drop("p_", "k_", "base_")


def nth_shard(rows: DataFrame, keys: list[str], shards: int, own: int) -> DataFrame:
    """Every `shards`-th row in the order of the keys, from the row numbered `own` on."""
    return numbered(rows, keys).where(F.pmod("idx", F.lit(shards)) == own)


def padded_tasks(tasks: DataFrame, multiple: int) -> DataFrame:
    """(idx, task, padding): tasks in order, then filling rows up to a multiple, which repeat no task."""
    one = tasks.select("task").distinct()
    total = one.agg(F.count("*").alias("n"))
    fill = total.where(F.col("n") % multiple != 0).select("n", F.explode(F.sequence(F.col("n"), F.col("n") + (multiple - F.col("n") % multiple) - 1)).alias("idx"))
    known = numbered(one, ["task"]).select("idx", "task", F.lit(False).alias("padding"))
    return known.unionByName(fill.select("idx", F.concat(F.lit("__padding__"), (F.col("idx") - F.col("n")).cast("string")).alias("task"), F.lit(True).alias("padding")))


def task_rows(padded: DataFrame, source: str) -> DataFrame:
    """Rows of the training table: prompt, reward model and extra information, nested."""
    return padded.select(F.lit(source).alias("data_source"), F.lit("trajectory").alias("agent_name"), F.array(F.struct(F.lit("user").alias("role"), F.col("task").alias("content"))).alias("prompt"), F.struct(F.lit("rule").alias("style"), F.lit("").alias("ground_truth")).alias("reward_model"), F.struct(F.when(~F.col("padding"), F.col("task")).alias("gamefile"), F.col("idx").alias("index"), "padding").alias("extra_info"))


def disjoint(splits: dict[str, DataFrame], key: str) -> None:
    """Raises if two splits share a key."""
    tagged = None
    for name, df in splits.items():
        own = df.select(F.col(key).alias("k")).distinct().withColumn("split", F.lit(name))
        tagged = own if tagged is None else tagged.unionByName(own)
    if tagged is not None:
        refuse(tagged.groupBy("k").agg(F.collect_set("split").alias("splits")).where(F.size("splits") > 1), "splits share a key")


def manifest(runs: DataFrame) -> DataFrame:
    """One row per task: executions, won ones, and a digest over them in order."""
    entry = F.concat_ws("|", "rep", "n", "won")
    per_task = runs.groupBy("task").agg(F.count("*").alias("k"), F.count_if("won").alias("n_won"), F.array_sort(F.collect_list(F.struct("rep", "won", entry.alias("e")))).alias("l"))
    return per_task.select("task", "k", "n_won", F.array_join(F.transform(F.filter("l", lambda x: x["won"]), lambda x: x["rep"].cast("string")), ",").alias("won_reps"), F.sha2(F.array_join(F.transform("l", lambda x: x["e"]), ";").cast("binary"), 256).alias("digest"))


def write_new(df: DataFrame, path: str, partition: str | None = None, fmt: str = "parquet") -> None:
    """Writes where nothing is yet; the commit protocol leaves either all files or none."""
    out = df.write.mode("errorifexists").format(fmt)
    if fmt == "json":
        out = out.option("compression", "gzip")
    (out.partitionBy(partition) if partition else out).save(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def with_provenance(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `issue`: what is wrong with a source document (missing, changed), null if nothing. rows have `expected`,
    known `sha256`."""
    joined = rows.join(known.select(*keys, "sha256"), keys, "left")
    return joined.withColumn("issue", F.when(F.col("sha256").isNull(), "source_missing").when(F.col("sha256") != F.col("expected"), "source_changed"))


def augment(base: DataFrame, planned: DataFrame, most: int, must_win: bool = True) -> DataFrame:
    """The base's executions and those planned ones of its tasks that may join it: 1 to `most` decisions, won if asked."""
    ok = planned.where(F.col("n").between(1, most) & (F.col("won") if must_win else F.lit(True)))
    return base.withColumn("family", F.lit("teacher")).unionByName(ok.join(base.select("task").distinct(), "task", "left_semi").withColumn("family", F.lit("planner")))
