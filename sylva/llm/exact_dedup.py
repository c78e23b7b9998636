"""Exact dedup by progressive refinement, in DataFrame functions only.

Rows are compared by cheap keys first: the length of the text without white
space, then a hash of its first PREFIX characters, then a digest of all of it.
Each step counts its keys exactly and keeps only rows whose key another row has
too; keys that only one row has never reach the next step. Only the keys travel
until the last step, where the surviving groups' rows meet their texts again.

A group may hold any share of the rows. Keys are counted before they are
shuffled, and rows are given their group's facts in two ways (``with_groups``):
from groups of over 1 / LARGE of all rows, of which there are fewer than LARGE,
by a broadcast; from the others by a shuffle in which no key is hot.

Defined results: a null text is the empty text, and empty texts are copies of
one another; a null id sorts after every other id; of copies with equally many
code points the smallest id stays; rows that repeat one id with one text are
told apart by position, so exactly one row of a group is kept; a very long text
is one value of its row and is hashed where it is read; an empty table gives an
empty result; further columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, counted, keep_rows, squeezed, table, with_groups

#: Characters of the text without white space that the second key looks at.
PREFIX = 256


def _keyed(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """Cheap keys of every row, with the text without white space."""
    seen = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("_text"))
    seen = seen.withColumn("_norm", squeezed("_text"))
    return seen.select(
        F.monotonically_increasing_id().alias("_row"),
        F.xxhash64("_text").alias("_key"),
        "doc_id",
        F.length(F.coalesce("_text", F.lit(""))).alias("_raw"),
        F.length("_norm").alias("_len"),
        F.xxhash64(F.length("_norm"), F.substring("_norm", 1, PREFIX)).alias("_head"),
        "_norm",
    )


def _shared_heads(keys: DataFrame, total: int) -> DataFrame:
    """Prefix hashes that several rows of a shared length have, and how many."""

    def shared(rows: DataFrame, key: str) -> DataFrame:
        return rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")

    survivors = with_groups(keys, shared(keys, "_len"), "_len", "_n", total, "_row").where("_n IS NOT NULL").drop("_n")
    return shared(survivors, "_head")


def exact_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", digest_all: bool = False) -> DataFrame:
    """One row per input row: _row, _key (a hash of the text), the id, _raw (code points), keep_id, group_size, kept and digest.

    digest is the SHA-256 of the text without white space. Rows that the cheap
    keys already tell apart from all others get none, and their texts are not
    read again, unless ``digest_all``: it asks for every text's digest, which is
    then taken as the text is read for its keys.
    """
    keyed = _keyed(docs, text, id_col)
    digest = F.sha2("_norm", 256)
    if digest_all:
        rows, seen = counted(keyed.withColumn("digest", digest).drop("_norm"))
        total = seen["rows"]
        rows = with_groups(rows, _shared_heads(rows, total), "_head", "_n", total, "_row")
    else:
        keys, seen = counted(keyed.select("_row", "_len", "_head"))
        total = seen["rows"]
        rows = with_groups(keyed, _shared_heads(keys, total), "_head", "_n", total, "_row")
        rows = checkpointed(rows.withColumn("digest", F.when(F.col("_n").isNotNull(), digest)).drop("_norm"))
    best = F.min(F.struct((-F.col("_raw")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("_row").alias("d")))
    groups = (
        rows.where("_n IS NOT NULL")
        .groupBy(F.col("digest").alias("_d"))
        .agg(best.alias("_best"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )
    rows = rows.withColumn("_d", F.when(F.col("_n").isNotNull(), F.col("digest"))).drop("_n")
    out = with_groups(rows, groups, "_d", "group_size", total, "_row")
    alone = F.col("group_size").isNull()
    return out.select(
        "_row",
        "_key",
        "doc_id",
        "_raw",
        F.when(alone, F.col("doc_id")).otherwise(F.col("_best.c")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_row") == F.col("_best.d"))).alias("kept"),
        "digest",
    )


def drop_exact(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents that stay: of equal texts the longest, then the one with the smallest id."""
    return keep_rows(docs, exact_groups(docs, text, id_col), text, id_col)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact_groups(docs, digest_all=True).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


SQL = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS raw,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM t
WINDOW w AS (PARTITION BY text_sha256 ORDER BY raw DESC, doc_id)
"""
