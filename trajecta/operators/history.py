"""What an execution has seen so far: focus, evidence, windows of turns, parser state, rolling digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions import identity as I
from trajecta.functions import text as T

RUN = ("task", "rep")
# Fixed value: answers that reject an action, after which a menu that isn't shown again may be gone.
TURNED_DOWN = r"(?i)\A(?:No known action|Unknown action|I'm not sure|You must |The .+ (?:is not|isn't)|That can't|You can't|Connections must)"


def focus(steps: DataFrame, feedback: str = "shown") -> DataFrame:
    """Adds `focus`, carried forward: what the last answer that named a focus named, null after a reset. A struct tells
    "set to null" from "not set"."""
    text = F.coalesce(F.col(feedback), F.lit(""))
    # The sentences that set and reset it.
    named = F.regexp_extract(text, r"You focus on (?:the )?(.+?)\.", 1)
    set_ = F.when(F.contains(text, F.lit("You reset the goal progress and focus.")), F.struct(F.lit(None).cast("string").alias("v"))).when(named != "", F.struct(T.strip(named).alias("v")))
    back = Window.partitionBy(*RUN).orderBy("t")
    return steps.withColumn("f", F.last(set_, ignorenulls=True).over(back)).withColumn("focus", F.col("f.v")).drop("f")


def prior_evidence(steps: DataFrame) -> DataFrame:
    """Adds the states that decisions before this one observed: where a look led to, unless the answer rejected it, and
    where a look was made that changed nothing. steps: as graph.kind gives them."""
    before = Window.partitionBy(*RUN).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    moved = (F.col("kind") == "state_change") & F.col("is_observation") & F.col("rejection").isNull()
    seen = F.when(moved, F.col("key_after")).when(F.col("kind") == "internal_observation", F.col("key_before"))
    return steps.withColumn("n_prior", F.count(seen).over(before)).withColumn("prior", F.array_join(F.collect_list(seen).over(before), ","))


def interaction(steps: DataFrame, feedback: str = "shown", executed: str = "executed") -> DataFrame:
    """One row per decision with the parser after it: mode, options, last_known, previous_mode, preserved.

    A menu makes it wait for a choice (pending_menu); an answer that rejects the action without showing the menu again
    leaves it unknown, as long as it was waiting or unknown before; any other answer makes it normal. What wasn't
    executed leaves all as it was.

    Every decision is a map of the parser's states, and maps compose: a menu and a normal answer are constant, so what
    came before them doesn't matter; what wasn't executed is the identity; and any number of rejections one after the
    other do what the first one did. So the state follows from the last constant map, whether a rejection came since, and
    how many: two running windows, no fold.
    """
    options, text = T.menu(F.coalesce(F.col(feedback), F.lit(""))), T.strip(F.coalesce(F.col(feedback), F.lit("")))
    ran = F.coalesce(F.col(executed), F.lit(True))
    turned_down = ran & (F.size(options) == 0) & text.rlike(TURNED_DOWN)
    upto = Window.partitionBy(*RUN).orderBy("t")
    rows = steps.select(*RUN, "t", ran.alias("ran"), turned_down.alias("no"), F.when(ran & ~turned_down, options).alias("options"))
    rows = rows.withColumn("noes", F.count_if("no").over(upto))
    rows = rows.withColumn("base", F.last(F.when(F.col("options").isNotNull(), F.struct("options", "noes")), ignorenulls=True).over(upto))
    none = F.create_map().cast("map<string,string>")
    shown, since = F.coalesce(F.col("base.options"), none), F.col("noes") - F.coalesce(F.col("base.noes"), F.lit(0))
    lost = (F.size(shown) > 0) & (since > 0)
    mode = F.when(lost, I.UNKNOWN).when(F.size(shown) > 0, I.PENDING).otherwise(I.NORMAL)
    return rows.select(*RUN, "t", mode.alias("mode"), F.when(lost, none).otherwise(shown).alias("options"), F.when(lost, shown).otherwise(none).alias("last_known"), F.when(lost, F.when(since == 1, I.PENDING).otherwise(I.UNKNOWN)).alias("previous_mode"), (~F.col("ran")).alias("preserved"))


def digests(steps: DataFrame) -> DataFrame:
    """One row per execution: a digest rolled over its decisions in order."""
    runs = steps.groupBy(*RUN).agg(F.array_sort(F.collect_list(F.struct("t", "key_before", "action"))).alias("s"))
    return runs.select(*RUN, F.expr("aggregate(s, sha2('start', 256), (d, x) -> sha2(concat_ws('|', d, x.key_before, x.action), 256))").alias("digest"))


def windowed(turns: DataFrame, last: int) -> DataFrame:
    """Each turn with the `last` turns before it as text, with their own step numbers."""
    before = Window.partitionBy("episode").orderBy("step").rowsBetween(-last, -1)
    entry = F.concat(F.lit("["), F.col("step").cast("string"), F.lit("] "), F.col("role"), F.lit(": "), F.col("text"))
    return turns.withColumn("history", F.array_join(F.collect_list(entry).over(before), "\n")).withColumn("n_history", F.count("*").over(before))
