"""Prompts of the three environments: what a decision is asked with, from the decisions before it.

A prompt is a fixed template whose fields are columns. Its history is the last few completed decisions, each with what was
shown before it, numbered from the first one; only so many rows of an execution are looked at for each decision.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions import text as T

RUN = ["task", "rep"]
# Templates (without and with a history), the entry of a history, and how many of them are shown.
SCIENCE_FIRST = "\nYour ScienceWorld task is: {task_description}\nYour current observation is: {current_observation}\nAvailable action commands: [{action_templates}]\nAvailable objects you can interact with: [{objects}]\n\nNow it's your turn to take an action. Combine an action command with appropriate object(s) to form a valid action.\nYou should first reason step-by-step about the current situation. This reasoning process MUST be enclosed within <thought> </thought> tags.\nOnce you've finished your reasoning, you should choose a valid action for the current step and present it within <action> </action> tags.\n"
SCIENCE_LATER = "\nYour ScienceWorld task is: {task_description}\nPrior to this step, you have already taken {step_count} step(s). Below are the most recent {history_length} observations and the corresponding actions you took: {action_history}\nYou are now at step {current_step} and your current observation is: {current_observation}\nAvailable action commands: [{action_templates}]\nAvailable objects you can interact with: [{objects}]\n\nNow it's your turn to take an action. Combine an action command with appropriate object(s) to form a valid action.\nYou should first reason step-by-step about the current situation. This reasoning process MUST be enclosed within <thought> </thought> tags.\nOnce you've finished your reasoning, you should choose a valid action for the current step and present it within <action> </action> tags.\n"
HOUSEHOLD_FIRST = "\nYou are an expert agent operating in the ALFRED Embodied Environment. Your task is to: {task_description}\nYour current observation is: {current_observation}\nYour admissible actions of the current situation are: [{admissible_actions}].\n\nNow it's your turn to take an action.\nYou should first reason step-by-step about the current situation. This reasoning process MUST be enclosed within <thought> </thought> tags. \nOnce you've finished your reasoning, you should choose an admissible action for current step and present it within <action> </action> tags.\n"
HOUSEHOLD_LATER = "\nYou are an expert agent operating in the ALFRED Embodied Environment. Your task is to: {task_description}\nPrior to this step, you have already taken {step_count} step(s). Below are the most recent {history_length} observations and the corresponding actions you took: {action_history}\nYou are now at step {current_step} and your current observation is: {current_observation}\nYour admissible actions of the current situation are: [{admissible_actions}].\n\nNow it's your turn to take an action.\nYou should first reason step-by-step about the current situation. This reasoning process MUST be enclosed within <thought> </thought> tags. \nOnce you've finished your reasoning, you should choose an admissible action for current step and present it within <action> </action> tags.\n"
SHOP_FIRST = "\nYou are an expert autonomous agent operating in the WebShop e‑commerce environment. \nYour task is to: {task_description}.\nYour current observation is: {current_observation}.\nYour admissible actions of the current situation are: \n[\n{available_actions}\n].\n\nNow it's your turn to take one action for the current step.\nYou should first reason step-by-step about the current situation, then think carefully which admissible action best advances the shopping goal. This reasoning process MUST be enclosed within <thought> </thought> tags. \nOnce you've finished your reasoning, you should choose an admissible action for current step and present it within <action> </action> tags.\n"
SHOP_LATER = "\nYou are an expert autonomous agent operating in the WebShop e‑commerce environment.\nYour task is to: {task_description}.\nPrior to this step, you have already taken {step_count} step(s). Below are the most recent {history_length} observations and the corresponding actions you took: {action_history}\nYou are now at step {current_step} and your current observation is: {current_observation}.\nYour admissible actions of the current situation are: \n[\n{available_actions}\n].\n\nNow it's your turn to take one action for the current step.\nYou should first reason step-by-step about the current situation, then think carefully which admissible action best advances the shopping goal. This reasoning process MUST be enclosed within <thought> </thought> tags. \nOnce you've finished your reasoning, you should choose an admissible action for current step and present it within <action> </action> tags.\n"
ENTRY = "[Observation {number}: '{observation}', Action {number}: '{action}']"
HELP = "help"
SHOWN = {"science": 5, "household": 5, "shop": 2}


def filled(template: str, fields: dict[str, Column]) -> Column:
    """The template with its {fields} as columns; a null field makes the text null."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(fields[p].cast("string") if k % 2 else F.lit(p) for k, p in enumerate(parts) if k % 2 or p))


def quoted(items: Column, between: str) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), between)


def with_history(steps: DataFrame, most: int, trimmed: bool) -> DataFrame:
    """Adds action_history (null for a first decision), history_length and step_count."""
    before = Window.partitionBy(*RUN).orderBy("t").rowsBetween(-most, -1)
    seen = T.strip(F.coalesce(F.col("observation"), F.lit("None"))) if trimmed else F.coalesce(F.col("observation"), F.lit("None"))
    entry = filled(ENTRY, {"number": F.col("t") + 1, "observation": seen, "action": F.coalesce("action", F.lit("None"))})
    rows = steps.withColumn("entry_", entry)
    listed = F.collect_list("entry_").over(before)
    return rows.withColumn("l_", listed).withColumn("history_length", F.size("l_")).withColumn("action_history", F.when(F.size("l_") > 0, F.array_join("l_", "\n"))).withColumn("step_count", F.col("t")).drop("entry_", "l_")


def prompts(steps: DataFrame, environment: str) -> DataFrame:
    """(task, rep, t, prompt). steps: task, rep, t (0, 1, ... without gaps), instruction, observation, action (what the
    history shows of it), and science: commands, objects; household: commands; shop: search (boolean), clickables.

    The command that asks for help isn't offered. A shop's observation loses what comes up to its instruction, and its
    parts are quoted; its history shows observations as they are.
    """
    rows = with_history(steps, SHOWN[environment], environment != "shop")
    offered = lambda between: quoted(F.filter("commands", lambda c: c != HELP), between)
    own: dict[str, Column] = {"task_description": F.col("instruction"), "step_count": F.col("step_count"), "history_length": F.col("history_length"), "action_history": F.col("action_history"), "current_step": F.col("step_count") + 1}
    if environment == "science":
        own |= {"current_observation": T.strip(F.col("observation")), "action_templates": offered(", "), "objects": quoted(F.col("objects"), ", ")}
        first, later = SCIENCE_FIRST, SCIENCE_LATER
    elif environment == "household":
        own |= {"current_observation": T.strip(F.col("observation")), "admissible_actions": offered("\n ")}
        first, later = HOUSEHOLD_FIRST, HOUSEHOLD_LATER
    else:
        own |= {"current_observation": T.shown_page(F.col("observation"), F.col("instruction")), "available_actions": T.shown_actions(F.col("clickables"), F.col("search"))}
        first, later = SHOP_FIRST, SHOP_LATER
    return rows.select(*RUN, "t", F.when(F.col("action_history").isNull(), filled(first, own)).otherwise(filled(later, own)).alias("prompt"))
