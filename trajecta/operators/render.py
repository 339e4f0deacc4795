"""Matched evidence as bounded text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def back_references(rows: DataFrame, group: list[str], order: str, text: str, base: int = 0) -> DataFrame:
    """Adds `is_first` and `label`: the number (from base) of the first row of the group with the same text."""
    same = Window.partitionBy(*group, text)
    ordered = Window.partitionBy(*group).orderBy(order)
    marked = rows.withColumn("is_first", F.col(order) == F.min(order).over(same))
    counted = marked.withColumn("running", F.sum(F.col("is_first").cast("long")).over(ordered) - 1 + base)
    return counted.withColumn("label", F.min("running").over(same)).drop("running")


def shown(rows: DataFrame, text: str, prefix: str = "OBS") -> Column:
    """The text with its label where it is new, else a pointer to where it was."""
    label = F.concat(F.lit(prefix), F.col("label").cast("string"))
    return F.when(F.col("is_first"), F.concat(label, F.lit(": "), F.col(text))).otherwise(F.concat(F.lit("same as "), label))


def runs(steps: DataFrame, compress: bool) -> DataFrame:
    """One text per execution: a line for each decision, with what it was shown. Compressed, repeats are pointers."""
    key = ["task", "rep"]
    marked = back_references(steps, key, "t", "observation") if compress else steps
    seen = shown(marked, "observation") if compress else F.col("observation")
    line = F.concat(F.lit("["), F.col("t").cast("string"), F.lit("] "), seen, F.lit(" -> "), F.col("action"))
    listed = marked.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("t", line.alias("line")))).alias("l"))
    return listed.select(*key, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def budgeted(plain: DataFrame, compressed: DataFrame, budget: int, keys: list[str], size: Callable[[Column], Column] | None = None, strict: bool = False) -> DataFrame:
    """The plain text if its size is at most the budget, else the compressed one if its is, else null with `over` set, or
    (strict) an error; nothing is ever cut off. size: what counts, such as the tokens of a text; by default its words."""
    size = size or (lambda c: F.size(F.split(c, r"\s+")))
    both = plain.withColumnRenamed("text", "plain").join(compressed.withColumnRenamed("text", "packed"), keys)
    fits = F.when(size(F.col("plain")) <= budget, "plain").when(size(F.col("packed")) <= budget, "compressed")
    if strict:
        needs = F.concat(F.lit("complete evidence needs "), size(F.col("packed")).cast("string"), F.lit(f", budget {budget}; nothing is left out"))
        fits = F.coalesce(fits, F.raise_error(needs).cast("string"))
    return both.withColumn("form", fits).select(*keys, "form", F.when(F.col("form") == "plain", F.col("plain")).when(F.col("form") == "compressed", F.col("packed")).alias("text"), F.col("form").isNull().alias("over"))


def explanation(case: Column, selected: Column, cost: Column) -> Column:
    """One sentence on the case and the choice."""
    what = F.when(selected == "source", F.format_string("follow a recorded success, %d decisions to its end", cost)).when(selected == "student_self", F.format_string("the own rest is shortest, %d decisions", cost)).otherwise(F.lit("no success to follow"))
    return F.concat(F.replace(case, F.lit("_"), F.lit(" ")), F.lit(": "), what)


def evidence(references: DataFrame, texts: DataFrame) -> DataFrame:
    """One text per decision: its references in order, each under its role, place and source."""
    keys = ["task", "rep", "t"]
    rank = F.array_position(F.array(F.lit("selected"), F.lit("historical"), F.lit("failure")), F.col("role"))
    sources = texts.select("task", F.col("rep").alias("source_rep"), "text")
    own = references.withColumn("source_rep", F.when(F.col("source_rep") < 0, F.col("rep")).otherwise(F.col("source_rep")))
    block = F.concat(F.lit("## "), F.col("role"), F.lit(" from "), F.col("source_rep").cast("string"), F.lit(" at "), F.col("source_at").cast("string"), F.lit("\n"), F.col("text"))
    listed = own.join(sources, ["task", "source_rep"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(rank.alias("o"), block.alias("b")))).alias("l"))
    return listed.select(*keys, F.size("l").cast("long").alias("n_references"), F.array_join(F.transform("l", lambda x: x["b"]), "\n").alias("text"))
