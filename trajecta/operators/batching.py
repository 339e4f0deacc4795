"""Turns as weighted, padded training rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids that fill rows up, and those of a row that only pads the batch.
PAD, PAD_PROMPT, PAD_RESPONSE = 151643, 151644, 151645


def episodes(turns: DataFrame) -> DataFrame:
    """One row per assistant turn: the ids of all turns before it are its prompt, its own ids the response."""
    before = Window.partitionBy("episode").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.withColumn("prompt_ids", F.flatten(F.collect_list("ids").over(before)))
    return rows.where((F.col("role") == "assistant") & (F.size("prompt_ids") > 0) & (F.size("ids") > 0)).select("episode", "step", "prompt_ids", F.col("ids").alias("response_ids"))


def token_weights(rows: DataFrame, multiple: int) -> DataFrame:
    """Adds `weight`: R / (N n), with R rows after padding, N episodes, n response tokens of the episode. So every
    episode weighs the same, and every token within one. The two totals are one row."""
    totals = rows.agg((F.ceil(F.count("*") / multiple) * multiple).cast("double").alias("R"), F.count_distinct("episode").cast("double").alias("N"))
    per_episode = F.sum(F.size("response_ids")).over(Window.partitionBy("episode"))
    return rows.withColumn("n_tokens", per_episode).crossJoin(F.broadcast(totals)).withColumn("weight", F.col("R") / (F.col("N") * F.col("n_tokens"))).drop("R", "N")


def left_padded(ids: Column, width: Column, pad: int = PAD) -> Column:
    return F.concat(F.array_repeat(F.lit(pad), width - F.size(ids)), ids)


def right_padded(ids: Column, width: Column, pad: int = PAD) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), width - F.size(ids)))


def expand(turns: DataFrame, multiple: int = 8, widths: tuple[int, int] | None = None) -> DataFrame:
    """Rows of equal width, with filling rows up to a multiple: prompts padded on the left, responses on the right,
    attention, positions, response mask, and each row's weight (0 for filling rows). widths: of prompts and responses, as
    the trainer sets them; a longer row is an error. Without them, the longest rows set them, which takes one more pass."""
    rows = token_weights(episodes(turns), multiple)
    count = rows.agg(F.count("*").alias("R0"))
    fill = count.select(F.explode(F.sequence(F.lit(1), F.when(F.col("R0") % multiple == 0, F.lit(None)).otherwise(multiple - F.col("R0") % multiple).cast("int"))).alias("k"))
    filling = fill.select(F.lit(None).cast("long").alias("episode"), (-F.col("k")).cast("long").alias("step"), F.array(F.lit(PAD_PROMPT)).alias("prompt_ids"), F.array(F.lit(PAD_RESPONSE)).alias("response_ids"), F.lit(0.0).alias("weight"))
    full = rows.select("episode", F.col("step").cast("long").alias("step"), "prompt_ids", "response_ids", "weight").unionByName(filling)
    a, b = F.size("prompt_ids"), F.size("response_ids")
    if widths is None:
        longest = full.agg(F.max(a).alias("P"), F.max(b).alias("L"))
        wide = full.crossJoin(F.broadcast(longest))
    else:
        fits = (a <= widths[0]) & (b <= widths[1])
        wide = full.withColumn("P", F.when(fits, F.lit(widths[0])).otherwise(F.raise_error(F.lit("a row is longer than the given widths")).cast("int"))).withColumn("L", F.lit(widths[1]))
    attention = F.concat(F.array_repeat(F.lit(0), F.col("P") - a), F.array_repeat(F.lit(1), a + b), F.array_repeat(F.lit(0), F.col("L") - b))
    position = F.transform(F.sequence(F.lit(1), F.col("P") + F.col("L")), lambda i: F.greatest(F.least(i - (F.col("P") - a), a + b) - 1, F.lit(0)))
    own = F.when(F.col("episode").isNull(), 0).otherwise(1)
    mask = F.concat(F.array_repeat(own, b), F.array_repeat(F.lit(0), F.col("L") - b))
    return wide.select("episode", "step", left_padded(F.col("prompt_ids"), F.col("P")).alias("prompts"), right_padded(F.col("response_ids"), F.col("L")).alias("responses"), attention.alias("attention_mask"), position.alias("position_ids"), mask.alias("response_mask"), "weight")


def group_advantage(rewards: DataFrame, group: str, reward: str, by_spread: bool = True, eps: float = 1e-6, has_teacher: bool = False) -> DataFrame:
    """Adds `advantage`: the reward against its group's mean, over the group's spread. A group of one keeps its reward
    (over 1 + eps); with teacher scores all advantages are 0."""
    # partial sums by task, joined back: a group of very many rows is neither sorted nor gathered
    facts = rewards.groupBy(group).agg(F.count("*").alias("n_"), F.avg(reward).alias("mean_"), F.stddev_samp(reward).alias("spread_"))
    one = F.col("n_") == 1
    mean = F.when(one, 0.0).otherwise(F.col("mean_"))
    spread = F.when(one, 1.0).otherwise(F.col("spread_")) if by_spread else F.lit(1.0 - eps)
    joined = rewards.join(facts.withColumnRenamed(group, "group_"), F.col(group).eqNullSafe(F.col("group_")))
    return joined.withColumn("advantage", F.lit(0.0) if has_teacher else (F.col(reward) - mean) / (spread + eps)).drop("group_", "n_", "mean_", "spread_")


def micro_batches(rows: DataFrame, budget: int, block: str = "block") -> DataFrame:
    """(block, row, batch): within each block of rows (what one rank holds), rows over the budget stand alone; the
    others go, heaviest first, to the lightest batch with room, and batches are added until all fit.

    A block is bounded by what a rank trains on at once, so it fits a task.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row"]).reset_index(drop=True)
        work = 24576 * frame.n + frame.n.astype("int64") ** 2
        long = frame.n > budget
        short = frame.index[~long].tolist()
        out = dict(zip(frame.index[long], range(int(long.sum())), strict=True))
        k = max(1, math.ceil(frame.n[~long].sum() / budget)) if short else 0
        while short:
            load, size, placed = [0] * k, [0] * k, {}
            for i in sorted(short, key=lambda i: (-work[i], i)):
                room = [b for b in range(k) if size[b] + frame.n[i] <= budget]
                if not room:
                    break
                b = min(room, key=lambda b: (load[b], b))
                load[b], size[b], placed[i] = load[b] + work[i], size[b] + frame.n[i], b
            if len(placed) == len(short):
                out |= {i: int(long.sum()) + b for i, b in placed.items()}
                break
            k += 1
        frame["batch"] = [out[i] for i in frame.index]
        return frame[[block, "row", "batch"]]

    return rows.select(block, "row", "n").groupBy(block).applyInPandas(run, f"{block} long, row long, batch long")


def batch_meta(runs: DataFrame) -> DataFrame:
    """One row: valid episodes, decisions, share of wins."""
    return runs.where("n > 0").agg(F.count("*").alias("n_episodes"), F.sum("n").alias("n_decisions"), F.avg(F.col("won").cast("double")).alias("success_rate"))


def weighted_loss(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean of (student - teacher) log-probabilities by token weight; 0 where no token counts."""
    total = F.sum(F.col("weight") * (F.col("student_lp") - F.col("teacher_lp")))
    return rows.groupBy(*by).agg(F.coalesce(total / F.nullif(F.sum("weight"), F.lit(0.0)), F.lit(0.0)).alias("loss"), F.coalesce(F.max("weight"), F.lit(0.0)).alias("max_weight"))

