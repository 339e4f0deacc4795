"""Catalogs and their parts: goals, task lists, published graphs, source documents, splits, search results, settings.

Guards that look at a whole table do it with one aggregate, never by collecting rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def goals(spark: SparkSession, path: str) -> DataFrame:
    """S3: (ord, goal) of a JSON list of numbers, or of {"tasks": [...]} with numbers or {"goal": number}; numbers must be
    whole, unique and not negative."""
    raw = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.from_json(F.get_json_object("value", "$.tasks"), "array<string>"), F.from_json("value", "array<string>"))
    rows = raw.select(F.posexplode(listed).alias("ord", "v")).select("ord", F.coalesce(F.get_json_object("v", "$.goal"), F.col("v")).alias("v"))
    return checked_goals(rows.select("ord", F.when(F.col("v").rlike(r"\A\d+\z"), F.expr("try_cast(v AS bigint)")).alias("goal")))


def checked_goals(rows: DataFrame) -> DataFrame:
    n, good, different = rows.agg(F.count("*"), F.count(F.when(F.col("goal") >= 0, 1)), F.count_distinct("goal")).first()
    if not n or good < n or different < n:
        raise ValueError("goals must be unique whole numbers that aren't negative")
    return rows


def training_tasks(rows: DataFrame) -> DataFrame:
    """Goals (ord, goal) as tasks of the training split, numbered by their places; rows that name another split are an error."""
    if "split" in rows.columns and rows.where("split IS NULL OR split <> 'train'").limit(1).count():
        raise ValueError("training takes tasks of the split train only")
    return rows.select(F.concat(F.lit("goal"), F.col("goal").cast("string")).alias("gamefile"), "goal", F.col("ord").cast("long").alias("task_index"), F.lit("train").alias("split"))


# Why a task has no graph, and the states of an entry that may have one.
NOT_READY, UNREADABLE, MISSING, READY = "catalog_entry_not_ready", "catalog_has_no_readable_graph", "published_graph_file_missing", ["complete", "partial"]


def lookup(tasks: DataFrame, manifest: DataFrame, entries: DataFrame, files: DataFrame) -> DataFrame:
    """For each task, its published graph or why there is none: (task, path, sha256, status, fallback).

    manifest: task; entries: task, status, path, sha256; files: path, sha256 of what can be read. A task that the manifest
    doesn't name, and a file whose digest isn't the entry's, are errors in `error`.
    """
    rows = tasks.select("task").join(manifest.select("task").distinct().withColumn("listed", F.lit(True)), "task", "left").join(entries, "task", "left")
    rows = rows.join(files.select("path", F.col("sha256").alias("actual")), "path", "left")
    readable = F.col("status").isin(READY) & (F.coalesce("path", F.lit("")) != "")
    fallback = F.when(F.col("status").isNull(), NOT_READY).when(~readable, UNREADABLE).when(F.col("actual").isNull(), MISSING)
    error = F.when(F.col("listed").isNull(), "task_outside_the_manifest").when(fallback.isNull() & (F.coalesce("sha256", "actual") != F.col("actual")), "digest_mismatch")
    good = fallback.isNull() & error.isNull()
    return rows.select("task", F.when(good, F.col("path")).alias("path"), F.when(good, F.col("sha256")).alias("sha256"), "status", F.when(error.isNull(), fallback).alias("fallback"), error.alias("error"))


def strict_documents(documents: DataFrame) -> DataFrame:
    """Source documents (path, sha256, actual, won, source_won, source_kind, runs): a planner's single run stands for
    its document, whose `won` falls back to source_won. A wrong digest or several runs raise."""
    digest_ok = F.col("sha256").isNull() | (F.col("sha256") == F.col("actual"))
    run = F.get("runs", F.lit(0))
    bad = F.when(~digest_ok, F.raise_error(F.concat(F.lit("source differs from its recorded digest: "), F.col("path")))).when(F.coalesce(F.size("runs"), F.lit(1)) != 1, F.raise_error(F.concat(F.lit("expected one run in "), F.col("path"))))
    one = F.col("runs").isNotNull()
    return documents.select("path", F.coalesce(bad.cast("boolean"), F.when(one, F.coalesce(run["won"], run["source_won"], F.lit(False))).otherwise(F.col("won"))).alias("won"), F.when(one, F.coalesce("source_kind", run["source_kind"], F.lit("planner_actual_replay"))).otherwise(F.col("source_kind")).alias("source_kind"))


def official_splits(variations: DataFrame, simplification: str = "easy") -> DataFrame:
    """(split, ord, id) of tasks with an array of variation numbers for each of train, dev and test; nothing is
    drawn at random, the order is the tasks' own."""
    each = [variations.select(F.lit(s).alias("split"), "task_order", F.posexplode(s).alias("k", "v"), "task") for s in ("train", "dev", "test")]
    rows = each[0].unionByName(each[1]).unionByName(each[2])
    return rows.select("split", "task_order", "k", F.concat_ws("|", "task", F.col("v").cast("string"), F.lit(simplification)).alias("id"))


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a file that holds one JSON array; a file that is cut off is an error when read. Such a file can't
    be split: write it as a table once."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)


def write_audit(snapshots: DataFrame, path: str) -> None:
    """Snapshots as compressed JSON, one folder a task; an existing folder is never overwritten."""
    snapshots.write.mode("errorifexists").option("compression", "gzip").partitionBy("task").json(path)


def with_nested(column: str, path: str, value: Column) -> Column:
    """A struct column with the field at a dotted path replaced."""
    return F.col(column).withField(path, value)


def settings_with(settings: Mapping, path: str, value: object) -> dict:
    """Nested settings with the one at a dotted path replaced; the given ones stay as they are."""
    name, _, rest = path.partition(".")
    return {**settings, name: settings_with(settings.get(name) or {}, rest, value) if rest else value}


def refinement(goals: DataFrame, solved: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """The goals still unsolved, in their order, of those requested; a request for another goal is an error."""
    if requested is not None:
        if requested.join(goals, "goal", "left_anti").limit(1).count():
            raise ValueError("requested goals must be among the training goals")
        goals = goals.join(requested.select("goal").distinct(), "goal", "left_semi")
    return goals.join(solved.where("solved").select("goal"), "goal", "left_anti")


def check_inference(batched_tokens: int, model_length: int, sequences: int, chunked_prefill: bool = False) -> None:
    """Limits of a scoring service that fit together."""
    if any(type(n) is not int or n < 1 for n in (batched_tokens, model_length, sequences)):
        raise ValueError("limits must be positive whole numbers")
    if batched_tokens < sequences or batched_tokens < model_length and not chunked_prefill:
        raise ValueError("the batch must cover all sequences, and a whole one unless prefill is chunked")


def check_resources(student: tuple[int, int], teacher: tuple[int, int], teacher_width: int, total: int | None = None) -> dict[str, int]:
    """Sizes of the two pools, each (nodes, devices of a node); raises if they don't fit the width or the total."""
    if any(type(n) is not int or n < 1 for n in (*student, *teacher, teacher_width)):
        raise ValueError("sizes must be positive whole numbers")
    own, other = student[0] * student[1], teacher[0] * teacher[1]
    if other % teacher_width:
        raise ValueError("the teacher's pool must be a multiple of its width")
    if total is not None and (type(total) is not int or total < own + other):
        raise ValueError(f"{own + other} devices are needed")
    return {"student": own, "teacher": other, "replicas": other // teacher_width}


def page_results(pages: DataFrame) -> DataFrame:
    """(page, place, asin, title) of search result pages (page, text): a button with ten letters or digits, and the
    line after it."""
    lines = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")
    rows = pages.select("page", lines.alias("l")).select("page", F.posexplode(F.arrays_zip(F.col("l").alias("line"), F.slice("l", 2, 1 << 30).alias("next"))).alias("place", "x"))
    asin = F.regexp_extract("x.line", r"\A\[button\] ([A-Za-z0-9]{10}) \[button_\]\z", 1)
    return rows.select("page", "place", asin.alias("asin"), F.col("x.next").alias("title")).where("asin <> '' AND title IS NOT NULL")


def untried(results: DataFrame, candidates: DataFrame, tried: DataFrame, keys: Sequence[str] = ("goal", "asin")) -> DataFrame:
    """Results that are candidates of the page's goal and weren't tried yet; keys tell the goal and its product."""
    return results.join(candidates.select(*keys).distinct(), list(keys), "left_semi").join(tried.select(*keys), list(keys), "left_anti")


def first_stage(attempts: DataFrame, stages: list[str]) -> DataFrame:
    """(goal, stage, asin): of recorded tries, the first that won, by stage and then by place."""
    rank = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    best = F.min(F.struct(rank.alias("r"), F.col("place"), F.col("stage"), F.col("asin")))
    return attempts.where("won").where(rank > 0).groupBy("goal").agg(best.alias("b")).select("goal", "b.stage", "b.asin")


def epoch(step: Column, offset: int, steps: int) -> Column:
    """The pass over the data that a step belongs to, counted from an offset."""
    return F.floor((step - offset) / steps).cast("long")


def saved(step: Column, chosen: list[int], every: int, last: int) -> Column:
    """Whether a step is saved: one of those chosen if any are, else every so many, and always the last."""
    return (step.isin(chosen) if chosen else step % every == 0) | (step == last)
