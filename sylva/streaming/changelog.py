"""Streams of notifications and of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(notifications: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Notifications per window and kind; works on streams and tables."""
    rows = notifications.withWatermark(time, late) if notifications.isStreaming else notifications
    out = rows.groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), kind, "n")


def fold(changes: DataFrame, keys: list[str], leaves: list[str], order: str) -> DataFrame:
    """State after a log of changes: the last change of each key, unless it deletes. One partial aggregation."""
    last = changes.groupBy(*keys).agg(F.max_by(F.struct("op", *leaves), order).alias("l"))
    return last.where("l.op <> 'delete'").select(*keys, *[F.col(f"l.{c}").alias(c) for c in leaves])


def fold_stream(changes: DataFrame, keys: list[str], leaves: list[str], order: str, path: str, checkpoint: str):
    """Keeps the last change of each key of a stream under ``path``, one version a batch, so that a batch that runs
    again after a failure rewrites its own version from the one before. Deletions are kept too, so an older change that
    comes late does not bring an entry back; ``folded`` reads the state."""
    def batch(df: DataFrame, epoch: int) -> None:
        log = df.select(*keys, "op", *leaves, order)
        if epoch:
            log = log.unionByName(df.sparkSession.read.parquet(f"{path}/v={epoch - 1}"))
        last = log.groupBy(*keys).agg(F.max_by(F.struct("op", *leaves, order), order).alias("l"))
        last.select(*keys, "l.*").write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()


def folded(spark: SparkSession, path: str, keys: list[str], leaves: list[str]) -> DataFrame:
    """The newest state under ``path``."""
    newest = spark.read.parquet(path).agg(F.max("v")).first()[0]
    return spark.read.parquet(f"{path}/v={newest}").where("op <> 'delete'").select(*keys, *leaves)


def updates(changes: DataFrame, keys: list[str], leaves: list[str], order: str) -> DataFrame:
    """The newest change of each key, as a stream's state store keeps it: (keys, op, leaves, order). In update mode a batch
    gives only the keys that it touched, and an older change that comes late gives the newer one again."""
    last = changes.groupBy(*keys).agg(F.max_by(F.struct("op", *leaves, order), order).alias("l"))
    return last.select(*keys, "l.*")


def keep_updates(changes: DataFrame, keys: list[str], leaves: list[str], order: str, path: str, checkpoint: str):
    """Writes each batch's updates under ``path``. What is written grows with the keys that changed, not with all keys; a
    batch that runs again after a failure rewrites its own folder. ``kept`` reads the state."""
    def batch(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch-{epoch}")

    stream = updates(changes, keys, leaves, order).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return stream.foreachBatch(batch).trigger(availableNow=True).start()


def kept(spark: SparkSession, path: str, keys: list[str], leaves: list[str], order: str) -> DataFrame:
    """The state after all updates under ``path``: deleted entries are gone."""
    return fold(spark.read.option("recursiveFileLookup", "true").parquet(path), keys, leaves, order)


def replies(requests: DataFrame, answers: DataFrame, message: str, time: str, within: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests with the answers that carry their message id and come no later than ``within`` after them; both may be
    streams, whose state is let go when their watermarks pass. Requests without an answer have nulls, in streams once none
    can come any more. Columns of answers get the prefix answer_."""
    if requests.isStreaming:
        requests, answers = requests.withWatermark(time, late), answers.withWatermark(time, late)
    renamed = answers.select(*[F.col(c).alias(f"answer_{c}") for c in answers.columns])
    soon = (F.col(f"answer_{time}") >= F.col(time)) & (F.col(f"answer_{time}") <= F.col(time) + F.expr(f"INTERVAL {within}"))
    return requests.join(renamed, (F.col(message) == F.col(f"answer_{message}")) & soon, "left_outer")
