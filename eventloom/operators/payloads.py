"""Messages as rows: what is sent to whom. Delivery is a caller's function over partitions; nothing here sends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bubble(key: Column, title: Column, day: Column, place: Column, url: Column, marked: Column, user: Column, image: Column | None = None) -> Column:
    """An event as a card with a button that sets or takes away its bookmark."""
    action = F.when(marked, "unbookmark").otherwise("bookmark")
    data = F.concat(F.lit("action="), action, F.lit("&eventId="), key.cast("string"), F.lit("&userId="), user.cast("string"))
    body = F.struct(title.alias("title"), F.date_format(day, "yyyy-MM-dd").alias("date"), place.alias("place"))
    # fixed values: labels of the button
    button = F.struct(F.when(marked, "ブックマーク解除").otherwise("ブックマークに追加").alias("label"), data.alias("data"))
    return F.struct(F.lit("bubble").alias("type"), F.coalesce(image, F.lit("")).alias("image") if image is not None else F.lit("").alias("image"), body.alias("body"), button.alias("button"), url.alias("url"))


def carousel(rows: DataFrame, user: str, card: str, *order: Column, most: int = 10) -> DataFrame:
    """user, payload: each user's first cards as one message."""
    placed = rows.withColumn("__n", F.row_number().over(Window.partitionBy(user).orderBy(*order))).where(F.col("__n") <= most)
    cards = F.transform(F.array_sort(F.collect_list(F.struct("__n", card))), lambda x: x[card])
    return placed.groupBy(user).agg(F.to_json(F.struct(F.lit("carousel").alias("type"), cards.alias("contents"))).alias("payload"))


def text_message(text: Column) -> Column:
    return F.to_json(F.struct(F.lit("text").alias("type"), text.alias("text")))


def delivered(payloads: DataFrame, user: str, send: Callable[[str, str], bool]) -> DataFrame:
    """user, success of each payload, sent a partition at a time; an error is no success."""
    import pandas as pd

    def run(batches):
        for b in batches:
            out = []
            for u, p in zip(b[user], b["payload"], strict=True):
                try:
                    out.append((u, bool(send(u, p))))
                except Exception:  # noqa: BLE001  whatever a sender raises counts as a failure
                    out.append((u, False))
            yield pd.DataFrame(out, columns=[user, "success"])

    return payloads.select(user, "payload").mapInPandas(run, f"{user} {payloads.schema[user].dataType.simpleString()}, success boolean")


def success_counts(results: DataFrame, user: str) -> DataFrame:
    """user, sent, succeeded."""
    return results.groupBy(user).agg(F.count("*").alias("sent"), F.count_if("success").alias("succeeded"))


def write_json(rows: DataFrame, path: str, *columns: str) -> None:
    """Rows, or some of their columns, as JSON lines."""
    (rows.select(*columns) if columns else rows).write.mode("overwrite").json(path)


def write_texts(rows: DataFrame, path: str, key: str, text: str) -> None:
    """Texts as files, a folder for each key; line breaks stay."""
    rows.select(key, F.coalesce(text, F.lit("")).alias("value")).repartition(key).write.mode("overwrite").partitionBy(key).text(path)


def run_summary(rows: DataFrame, text: str, ok: Column, seconds: float | None = None) -> DataFrame:
    """total, with_text, errors, success_rate (percent, two digits), seconds of a run over rows."""
    return rows.agg(
        F.count("*").alias("total"), F.count_if(F.length(F.trim(F.coalesce(text, F.lit("")))) > 0).alias("with_text"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("errors"),
        F.round(F.try_divide(100.0 * F.count_if(ok), F.count("*")), 2).alias("success_rate"), F.lit(seconds).cast("double").alias("seconds"),
    )
