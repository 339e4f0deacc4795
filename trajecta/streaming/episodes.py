"""Executions as a stream: decisions arrive as events, an execution's state lives until it ends.

The same rules as the batch adapter, one event at a time. An execution ends with a win, at its cap, or when nothing has
come for some time; the user's next event begins another one. What is kept of a user lies in the query's checkpoint, so a
query that was stopped goes on where it was, and a new query can begin from what a batch job knows of running executions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trajecta.functions.identity import NORMAL
from trajecta.functions.parser import focus_after, parser_after
from trajecta.sources import adapters

OUTPUT = "user_id long, episode long, t long, action string, key_before string, key_after string, mode string, focus string, won boolean, done boolean, ended string"
#: A running execution: its number, its next decision, the state it is in, the parser's mode and the focus.
PLACE = "episode long, t long, key string, mode string, focus string"
SNAPSHOT = f"user_id long, {PLACE}, options map<string,string>"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Executions(StatefulProcessor):
    """What is kept of a user: the place in the running execution and the options of an open menu."""

    def __init__(self, idle_ms: int | None, cap: int) -> None:
        self.idle_ms, self.cap = idle_ms, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", PLACE)
        self.options = handle.getMapState("options", "number string", "option string")

    def _take(self) -> tuple[list, dict[str, str]]:
        place = list(self.place.get()) if self.place.exists() else [0, 0, "start", NORMAL, None]
        return place, {k[0]: v[0] for k, v in self.options.iterator()} if self.options.exists() else {}

    def _keep(self, place: list, options: dict[str, str], before: dict[str, str]) -> None:
        self.place.update(tuple(place))
        for k in before.keys() - options.keys():
            self.options.removeKey((k,))
        for k, v in options.items():
            if before.get(k) != v:
                self.options.updateValue((k,), (v,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        (episode, t, last, mode, focus), before = self._take()
        options, out = dict(before), []
        arrived = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for action, now, shown, executed, won in zip(arrived["action"], arrived["key_after"], arrived["shown"], arrived["executed"], arrived["wins"], strict=True):
            mode, options = parser_after(mode, options, shown, bool(executed))
            focus = focus_after(focus, shown)
            done = bool(won) or t + 1 >= self.cap
            out.append((key[0], episode, t, action, last, now, mode, focus, bool(won), done, ("won" if won else "cap") if done else None))
            if done:
                episode, t, last, mode, focus, options = episode + 1, 0, "start", NORMAL, None, {}
            else:
                t, last = t + 1, now
        self._keep([episode, t, last, mode, focus], options, before)
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if t:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        """Nothing came for a while: the running execution ends without a decision."""
        (episode, t, last, mode, focus), options = self._take()
        self._keep([episode + 1, 0, "start", NORMAL, None], {}, options)
        yield pd.DataFrame([(key[0], episode, t, None, last, None, mode, focus, False, True, "idle")], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        row = initialState.iloc[0]
        options = row["options"] if isinstance(row["options"], dict) else dict(row["options"] or {})
        self._keep([int(row["episode"]), int(row["t"]), row["key"], row["mode"], row["focus"]], options, {})

    def close(self) -> None:
        pass


def decisions(events: DataFrame, idle: int | None = None, running: DataFrame | None = None, cap: int = adapters.CAP) -> DataFrame:
    """One row per decision of a stream of events, in the order of arrival of each user's.

    idle: milliseconds without an event after which an execution ends, with a row of its own (ended is `idle`; t is the
    decision that didn't come). running: executions under way when the stream begins, as snapshot() gives them. State is
    a few values for each user, and is kept by the session's RocksDB store, which this operator needs and sets.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    key = F.concat_ws("|", "event_type", F.floor(F.col("value") / adapters.BAND).cast("string"))
    wins = F.coalesce((F.col("event_type") == "purchase") & (F.col("value") >= adapters.WIN_VALUE), F.lit(False))
    rows = adapters.texts(events.select("user_id", "ts", "event_id", F.col("event_type").alias("action"), key.alias("key_after"), wins.alias("wins")))
    rows = rows.select("user_id", "ts", "event_id", "action", "key_after", "shown", "executed", "wins").groupBy("user_id")
    return rows.transformWithStateInPandas(statefulProcessor=Executions(idle, cap), outputStructType=OUTPUT, outputMode="Append", timeMode="none" if idle is None else "ProcessingTime", initialState=None if running is None else running.groupBy("user_id"))


def snapshot(events: DataFrame, cap: int = adapters.CAP) -> DataFrame:
    """SNAPSHOT of the executions that a table of events leaves under way: where a stream of later events goes on."""
    from trajecta.operators import history

    rows = adapters.steps(events, cap)
    keys = ["task", "rep"]
    rows = history.focus(rows).join(history.interaction(rows).select(*keys, "t", "mode", "options", "last_known"), [*keys, "t"])
    episode, user = F.floor(F.col("task") / adapters.TASKS), F.col("rep") * adapters.TASKS + F.col("task") % adapters.TASKS
    latest = Window.partitionBy("user_id").orderBy(F.desc("episode"), F.desc("t"))
    last = rows.withColumn("user_id", user).withColumn("episode", episode).withColumn("k", F.row_number().over(latest)).where("k = 1")
    done = F.col("won") | (F.col("t") + 1 >= cap)
    none = F.create_map().cast("map<string,string>")
    known = F.when(F.size("options") > 0, F.col("options")).otherwise(F.col("last_known"))
    return last.select("user_id", F.when(done, F.col("episode") + 1).otherwise(F.col("episode")).cast("long").alias("episode"), F.when(done, 0).otherwise(F.col("t") + 1).cast("long").alias("t"), F.when(done, "start").otherwise(F.col("key_after")).alias("key"), F.when(done, NORMAL).otherwise(F.col("mode")).alias("mode"), F.when(~done, F.col("focus")).alias("focus"), F.when(done, none).otherwise(known).alias("options"))


def windowed_counts(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Extra: events by type in tumbling or sliding windows, with a watermark that closes them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, slide) if slide else F.window("ts", length), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Extra: runs of a user's events with less than a gap between them."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
