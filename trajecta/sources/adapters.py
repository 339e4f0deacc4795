"""Recorded tables as trajectories: steps, visits, prompt turns, products.

Every event belongs to an execution: a user's events in order of time are cut after each win and after every CAP
decisions, so executions are bounded as an environment bounds them, and no event is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions import identity as I
from trajecta.functions import text as T

#: Most decisions of an execution; the next event of the user begins another one.
CAP = 30
TASKS = 8
#: A purchase of this value or more wins.
WIN_VALUE = 75
#: Width of the value bands that make up a state.
BAND = 40
#: Rows whose recorded feedback disagrees with a replay.
ODD = 97


#: What an event did, as a command; `band` stands for the event's band of values.
COMMAND = """CASE action WHEN 'view' THEN 'look around' WHEN 'click' THEN 'open door ' || band WHEN 'purchase' THEN 'pick up item ' || band
  WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN '0' ELSE 'focus on thing ' || band END ELSE 'use thing ' || band END"""
#: What the environment answered; `nl` stands for a new line.
SHOWN = """CASE WHEN action = 'error' AND event_id % 2 = 0 THEN 'No known action matches that input.' WHEN action = 'error' THEN 'I''m not sure how to use that.'
  WHEN action = 'click' AND event_id % 5 = 0 THEN 'Ambiguous request: Please enter the number' || nl || '0: open  door ' || band || nl || '1: b'
  WHEN action = 'signup' AND event_id % 2 = 1 THEN 'You focus on the thing ' || band || '. It is near.' WHEN action = 'purchase' AND event_id % 29 = 0 THEN 'You reset the goal progress and focus.' ELSE 'You see ' || key_after || '.' END"""


def texts(rows: DataFrame) -> DataFrame:
    """Adds what a parser's log would say: command, shown (its answer), rejection, format_error, executed; they follow
    from the event and its id, so every rule over texts has decisions to hold for."""
    rows = rows.withColumn("band", F.split_part("key_after", F.lit("|"), F.lit(2))).withColumn("nl", F.lit("\n"))
    rows = rows.withColumn("command", F.expr(COMMAND)).withColumn("shown", F.expr(SHOWN)).drop("band", "nl")
    return rows.withColumn("rejection", T.rejection(F.col("shown"))).withColumn("format_error", F.expr("CASE WHEN event_id % 41 = 0 THEN 'tags' END")).withColumn("executed", F.expr("event_id % 23 <> 0"))


def state_locator(key: Column, event_id: Column, shown: Column) -> Column:
    """The locator, as text, of the state after an event; null where it wasn't captured (event_id % 7 = 0), can't be
    matched (event_id % 11 = 0) or its parser is unknown (event_id % 13 = 0)."""
    options = T.menu(shown)
    mode = F.when(event_id % 13 == 0, "unknown").when(F.size(options) > 0, I.PENDING).otherwise(I.NORMAL)
    found = I.locator(key, F.lit(None).cast("string"), event_id % 7 != 0, event_id % 11 != 0, mode, options)
    return F.when(found.isNotNull(), F.concat_ws("~", found["key"], found["signature"]))


def steps(events: DataFrame, cap: int = CAP) -> DataFrame:
    """One row per decision of each execution (task, rep), in order of t, with its texts and locators.

    The first executions of all users are tasks 0 to 7 (by user_id), the second ones tasks 8 to 15, and so on; rep tells
    the users of a task apart. n: decisions; won: the last one wins; key_before, key_after: states; rejected; feedback
    and observation: what was shown after and before (they differ where a recording has a gap); student: executions to
    be annotated; complete: no decision's replay differs from its record; loc_before, loc_after: by what the states are
    matched; positive: neither rejected nor malformed. All windows share one partitioning by user, so the events are shuffled once.
    """
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = by_user.rowsBetween(Window.unboundedPreceding, -1)
    wins = F.coalesce((F.col("event_type") == "purchase") & (F.col("value") >= WIN_VALUE), F.lit(False))
    numbered = events.select("user_id", "ts", "event_id", F.col("event_type").alias("action"), "value", wins.alias("wins")).withColumn("place", F.row_number().over(by_user).cast("long"))
    # decisions since the last win, then cut at the cap
    since = numbered.withColumn("k", F.col("place") - 1 - F.coalesce(F.max(F.when(F.col("wins"), F.col("place"))).over(before), F.lit(0)))
    cut = since.withColumn("t", F.col("k") % cap).withColumn("e", F.count_if(F.col("t") == 0).over(by_user) - 1)
    run = Window.partitionBy("user_id", "e").orderBy("t")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    key = F.concat_ws("|", "action", F.floor(F.col("value") / BAND).cast("string"))
    first = F.col("user_id") % TASKS
    out = cut.select(
        (first + TASKS * F.col("e")).alias("task"),
        ((F.col("user_id") - first) / TASKS).cast("long").alias("rep"),
        "t",
        "event_id",
        "action",
        "value",
        (F.col("action") == "error").alias("rejected"),
        F.coalesce(F.lag(key).over(run), F.lit("start")).alias("key_before"),
        key.alias("key_after"),
        F.bool_or("wins").over(whole).alias("won"),
        F.count("*").over(whole).alias("n"),
        F.when(F.col("event_id") % ODD == 0, F.concat(key, F.lit("?"))).otherwise(key).alias("feedback"),
    )
    out = texts(out.withColumn("observation", F.col("key_before")).withColumn("student", F.col("rep") % 4 == 0))
    by_run = Window.partitionBy("task", "rep")
    out = out.withColumn("complete", F.bool_and(F.col("feedback") == F.col("key_after")).over(by_run)).withColumn("loc_after", state_locator(F.col("key_after"), F.col("event_id"), F.col("shown")))
    # a struct tells a state without identity from the first one
    before = F.lag(F.struct("loc_after")).over(by_run.orderBy("t"))
    return out.withColumn("loc_before", F.when(before.isNull(), 'start~["normal",[]]').otherwise(before["loc_after"])).withColumn("positive", F.col("rejection").isNull() & F.col("format_error").isNull())


def executions(events: DataFrame) -> DataFrame:
    """One row per execution: task, rep, n, won, student."""
    return steps(events).where("t = 0").select("task", "rep", "n", "won", "student")


def turns(conversations: DataFrame, limit: int = 32_000) -> DataFrame:
    """One row per turn of a conversation: its words as token ids (a hash modulo `limit`) and its role."""
    words = F.expr("filter(split(text, ' '), w -> w <> '')")
    ids = F.transform(words, lambda w: (F.conv(F.substring(F.sha2(w.cast("binary"), 256), 1, 8), 16, 10).cast("long") % limit).cast("int"))
    return conversations.select(F.col("conv_id").alias("episode"), F.col("turn").alias("step"), "role", "text", ids.alias("ids"))


def hashed(text: Column, modulus: int = 2**31) -> Column:
    """The first 32 bits of the SHA-256 of a text, modulo a number."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long") % modulus


def products(part: DataFrame) -> DataFrame:
    """Parts as catalog products with a price text and three options."""
    return part.select(F.col("p_partkey").alias("asin"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), F.concat(F.lit("$"), F.format_string("%.2f", "p_retailprice")).alias("pricing"), F.array(F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string")).alias("options"))
