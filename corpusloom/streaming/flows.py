"""Streams: work that goes on where it stopped, appended results, state of a document, and windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from corpusloom.functions import text as T


def appended(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], kind: str = "json") -> StreamingQuery:
    """Transforms what is new, appends it, and ends; the checkpoint knows what is done, so a second run takes up from there."""
    return transform(stream).writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def attempted(stream: DataFrame, work: Callable[[DataFrame], DataFrame], good: str, bad: str, checkpoint: str, most: int = 5) -> StreamingQuery:
    """Rows for which `work` gives a null result are tried again, `most` times in all; the rest go to `bad`. A batch that is run
    again writes over what it wrote."""

    def batch(rows: DataFrame, number: int) -> None:
        pending, held = rows.withColumn("attempts", F.lit(0)), []
        try:
            for k in range(1, most + 1):
                done = work(pending.drop("result")).withColumn("attempts", F.lit(k)).persist()
                held.append(done)
                done.where("result is not null").write.mode("overwrite").parquet(f"{good}/batch={number}/try={k}")
                pending = done.where("result is null")
                if pending.isEmpty():
                    return
            pending.write.mode("overwrite").parquet(f"{bad}/batch={number}")
        finally:
            for x in held:
                x.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def partial_outputs(stream: DataFrame, path: str, checkpoint: str, by: str = "doc_id", order: str = "para_idx") -> StreamingQuery:
    """After each batch, a file of all paragraphs so far for each document that got new ones. Rows are kept by batch under `path`/rows."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        kept = spark.read.schema(rows.schema.add("batch", "long")).parquet(f"{path}/rows").where(F.col("batch") <= number)
        own = kept.join(F.broadcast(rows.select(by).distinct()), by, "left_semi")
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda s: s["text"]), "\n\n")
        own.groupBy(by).agg(text.alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).text(f"{path}/documents")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_overuse(stream: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, para_idx, overused of paragraphs as they come: words of four letters or more that the document had `least` times by
    then. A document's counts are its own, and start anew where para_idx is 0."""
    import pandas as pd

    schema = "doc_id long, para_idx long, overused string"

    def update(key: tuple, frames, state):
        counts = dict(zip(*state.get)) if state.exists else {}
        for frame in frames:
            for row in frame.sort_values("para_idx").itertuples():
                if row.para_idx == 0:
                    counts = {}
                for w in row.words:
                    counts[w] = counts.get(w, 0) + 1
                seen = sorted(w for w in set(row.words) if counts[w] >= least)
                yield pd.DataFrame({"doc_id": [key[0]], "para_idx": [row.para_idx], "overused": [",".join(seen)]})
        state.update((list(counts), list(counts.values())))

    words = F.filter(T.word_tokens(F.col("text")), lambda w: F.char_length(w) >= 4)
    rows = stream.select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), words.alias("words"))
    return rows.groupBy("doc_id").applyInPandasWithState(update, schema, "words array<string>, counts array<long>", "append", "NoTimeout")


class Progress(StreamingQueryListener):
    """Rows, batches and rate of streams so far, for a report."""

    def __init__(self) -> None:
        self.rows, self.batches, self.seconds = 0, 0, 0.0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.batches += 1
        self.seconds += event.progress.batchDuration / 1000

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def left(self, total: int) -> float | None:
        """Seconds that the rest of `total` rows will take at the rate so far."""
        return (total - self.rows) * self.seconds / self.rows if self.rows else None


def running_words(stream: DataFrame) -> DataFrame:
    """Counts of each document's words of four letters or more as its paragraphs come."""
    words = F.filter(T.word_tokens(F.col("text")), lambda w: F.char_length(w) >= 4)
    return stream.select("doc_id", F.explode(words).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """An extension: events and values of each type in windows of time; late ones are waited for."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """An extension: runs of a user's events with no longer pause than the gap."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
