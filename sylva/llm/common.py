"""Small helpers that several operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Regular expression of the characters that separate words.
BLANK = "[ \\t-\\r]"
WORD = "[^ \\t-\\r]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Where it names none a temporary folder is made, on one machine only: other
    executors would not see it, so a cluster without the setting is refused.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="sylva-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


#: Rows for which a task is worth while.
ROWS_A_TASK = 5_000


def checkpointed(df: DataFrame, at_most: int | None = None) -> DataFrame:
    """Cut lineage through the shared folder. A table of ``at_most`` rows gets no more tasks and files than it needs."""
    shared_folder(df.sparkSession)
    if at_most is not None:
        df = df.coalesce(1 + at_most // ROWS_A_TASK)
    return df.checkpoint()


def bounded(df: DataFrame, rows: int, at_most: int | None = None) -> DataFrame:
    """df checkpointed, and marked for a broadcast if it has at most ``rows`` rows; else the join is left to Spark."""
    df, seen = counted(df, at_most)
    return F.broadcast(df.coalesce(8)) if seen["rows"] <= rows else df


def counted(df: DataFrame, at_most: int | None = None, **measures: Column) -> tuple[DataFrame, dict]:
    """df checkpointed, with its number of rows (``rows``) and other aggregates, measured as it is written."""
    seen = Observation()
    out = checkpointed(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[m.alias(k) for k, m in measures.items()]), at_most)
    return out, seen.get


#: Groups of more than total / LARGE rows are few enough for a broadcast.
LARGE = 10_000
#: Narrow rows that are broadcast at most.
NARROW = 20_000


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: str, narrow: int = NARROW) -> DataFrame:
    """``rows``, each with the columns of its group, or nulls; ``size`` is the groups' number of rows.

    No key is hot: groups with more than total / LARGE rows, of which there
    are fewer than LARGE, are broadcast; the rows that are left are shuffled by
    key, and those without a key, or served already, by ``spread``, a column
    that tells rows apart. Few groups are all broadcast.
    """
    groups, seen = counted(groups, total)
    facts = [c for c in groups.columns if c != key]
    few = seen["rows"] <= narrow
    large = groups.coalesce(8) if few else groups.where(F.col(size) * LARGE > total)
    large = F.broadcast(large.select(F.col(key).alias("_k1"), F.struct(*facts).alias("_g1")))
    out = rows.join(large, rows[key] == large["_k1"], "left").drop("_k1")
    if few:
        return out.select(*rows.columns, *[F.col("_g1")[c].alias(c) for c in facts])
    kind = "long" if rows.schema[key].dataType == rows.schema[spread].dataType == LongType() else "string"
    small = groups.where(F.col(size) * LARGE <= total).select(F.col(key).cast(kind).alias("_k2"), F.lit(False).alias("_s2"), F.struct(*facts).alias("_g2"))
    out = out.withColumn("_served", F.col("_g1").isNotNull() | F.col(key).isNull())
    out = out.withColumn("_at", F.when(F.col("_served"), F.col(spread).cast(kind)).otherwise(F.col(key).cast(kind)))
    out = out.join(small, (out["_at"] == small["_k2"]) & (out["_served"] == small["_s2"]), "left")
    return out.select(*rows.columns, *[F.coalesce(F.col("_g1")[c], F.col("_g2")[c]).alias(c) for c in facts])


def keep_rows(docs: DataFrame, decided: DataFrame, text: str, id_col: str) -> DataFrame:
    """The rows of docs that ``decided`` (doc_id, _key: xxhash64 of the text, kept), with one row for each, keeps.

    Rows are told apart by id and text. Of rows that share both, one stays if
    only some of them are kept.
    """
    by = decided.groupBy(F.col("doc_id").alias("_id"), F.col("_key").alias("_k")).agg(F.bool_or("kept").alias("_kept"), F.bool_and("kept").alias("_all"))
    gone = checkpointed(by.where("NOT _all").select("_id", "_k", "_kept"))

    def match(keys: DataFrame) -> Column:
        return (F.xxhash64(docs[text]) == keys["_k"]) & docs[id_col].eqNullSafe(keys["_id"])

    out = docs.join(gone, match(gone), "left_anti")
    some = gone.where("_kept")
    if some.isEmpty():
        return out
    again = docs.join(some, match(some), "left_semi")
    again = again.groupBy(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_k")).agg(F.first(F.struct(*[docs[c] for c in docs.columns])).alias("_doc"))
    return out.unionByName(again.select("_doc.*"))


def small_batches(spark: SparkSession) -> None:
    """Bound what crosses to a Python worker at once: rows are whole texts here."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def squeezed(text: str = "text") -> Column:
    """The text without any white-space character; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"{BLANK}+", "")


def word_count(text: str | Column = "text") -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id written as decimal text, modulo ``modulus``; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % F.lit(modulus), F.lit(0)).cast("int")
