"""Webhook batches as a stream. The catalogue handles each batch as it comes; running it as a Structured Streaming job, with the
last change of each bookmark as keyed state and its table committed batch by batch, is an extension of this engine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.semantics import query_string
from ..schemas import WEBHOOK
from ..sources.tables import Tables

# Texts that are commands, and their routes.
COMMANDS = {"イベントをレコメンド": "recommend", "ブックマークを確認": "bookmarks", "リマインド": "remind"}


def routed(events: DataFrame, commands: dict[str, str] = COMMANDS) -> DataFrame:
    """user, route, event_id, text, at of events(type, timestamp, source, postback, message): a postback goes by its action if it names an
    event, a text by the command it is exactly, else as free text; events without a user and other kinds go."""
    data = query_string(F.coalesce("postback.data", F.lit("")))
    action = F.try_element_at(data, F.lit("action"))
    event_id = F.nullif(F.try_element_at(data, F.lit("eventId")), F.lit(""))
    text = F.col("message.text")
    command: Column = F.lit("free_text")
    for words, name in commands.items():
        command = F.when(text == words, name).otherwise(command)
    route = F.when((F.col("type") == "postback") & event_id.isNotNull() & action.isin("bookmark", "unbookmark"), action)
    route = route.when((F.col("type") == "message") & (F.col("message.type") == "text"), command)
    at = F.timestamp_millis("timestamp") if "timestamp" in events.columns else F.lit(None).cast("timestamp")
    rows = events.select(F.col("source.userId").alias("user"), route.alias("route"), F.when(F.col("type") == "postback", event_id).alias("event_id"), text.alias("text"), at.alias("at"))
    return rows.where("user is not null and route is not null")


def exploded(batches: DataFrame) -> DataFrame:
    """Events of batches(events)."""
    return batches.select(F.explode("events").alias("e")).select("e.*")


def batch_stream(spark: SparkSession, path: str) -> DataFrame:
    """Routed events of webhook bodies that arrive as JSON files."""
    return routed(exploded(spark.readStream.schema(WEBHOOK).json(path)))


class LastChange(StatefulProcessor):
    """Keyed state: of each (user, event) the last change by its time (at equal times a bookmark gives way to its removal).
    What comes again or comes late changes nothing and says nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at timestamp, route string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.last.get() if self.last.exists() else None
        last = tuple(before) if before is not None else None
        for batch in rows:
            for change in zip(batch["at"], batch["route"], strict=True):
                if last is None or (pd.Timestamp(change[0]), change[1]) > (pd.Timestamp(last[0]), last[1]):
                    last = change
        if before is None or last != tuple(before):
            at = pd.Timestamp(last[0]).to_pydatetime()
            self.last.update((at, last[1]))
            yield pd.DataFrame({"user": [key[0]], "event_id": [key[1]], "route": [last[1]], "at": [at]})

    def close(self) -> None:
        pass


CHANGE = "user string, event_id string, route string, at timestamp"


def changes(routed_rows: DataFrame) -> DataFrame:
    """The bookmark changes of routed events: user, event_id, route, at."""
    return routed_rows.where("route in ('bookmark', 'unbookmark') and at is not null").select("user", "event_id", "route", "at")


def last_changes(stream: DataFrame) -> DataFrame:
    """Of a stream of changes, those that become a pair's last one (the state store must be RocksDB)."""
    return stream.groupBy("user", "event_id").transformWithStateInPandas(LastChange(), CHANGE, "Update", "None")


def newest(log: DataFrame) -> DataFrame:
    """The last change of each pair, in the order that LastChange uses."""
    best = F.max(F.struct("at", "route")).alias("x")
    return log.groupBy("user", "event_id").agg(best).select("user", "event_id", "x.route", "x.at")


def apply_bookmarks(tables: Tables, rows: DataFrame, batch: int, stream: str = "bookmarks", most: int = 16) -> None:
    """One micro-batch's changes come to the table; its number is noted in the same commit, so a batch that is tried again
    adds nothing. From so many folders on the log is rewritten as the last change of each pair, so it stays in proportion
    to the pairs."""
    now = tables.version()
    state = tables.manifest(now)
    if state["marks"].get(stream, -1) >= batch:
        return
    if len(state["tables"].get(stream, {"folders": []})["folders"]) >= most:
        tables.commit({stream: newest(tables.read(stream, now).unionByName(rows.select("user", "event_id", "route", "at")))}, marks={stream: batch}, base=now)
    else:
        tables.commit({stream: rows.select("user", "event_id", "route", "at")}, [stream], {stream: batch}, now)


def bookmarks(tables: Tables, stream: str = "bookmarks", version: int | None = None) -> DataFrame:
    """user, event_id that are bookmarked."""
    return newest(tables.read(stream, version)).where("route = 'bookmark'").select("user", "event_id")


def bookmark_job(spark: SparkSession, path: str, root: str, checkpoint: str) -> StreamingQuery:
    """The stream's bookmarks into the tables of a folder, all that is there."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = last_changes(changes(batch_stream(spark, path)))
    write = stream.writeStream.outputMode("update").foreachBatch(lambda rows, n: apply_bookmarks(Tables(spark, root), rows, n))
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
