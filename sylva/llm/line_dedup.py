"""Line dedup by pairwise alignment.

Lines are compared without the white space around them; blank lines are passed
over. A block is a run of lines of LEAST_CHARS characters or more together.
Two documents are a pair if they share a block; pairs are aligned by patience
diff, and aligned blocks are deleted from the later document, with the blank
lines inside them. Every deleted line therefore stays in an earlier document,
and short lines (a brace, a rule) that match on their own stay where they are.

Partners are found by keys, without forming all pairs. Keys are hashes of
windows: a line with the lines after it, and with those before it, until
LEAST_CHARS are reached. The windows inside a block cover all its lines, however
short, so two documents that share a block share keys for each of them. A key pairs each holder with the first one (the smallest id),
with the first one that has the key once, and with the first one that has it
equally often, with which it aligns even if nothing else is shared: at most
three pairs a key and document, however many documents have it. Windows of which a
line stays uncut are then held against the next holders in order, STEP times as
many in each round, until all is cut or no earlier holder is left; no two
documents are compared twice. Only a window that nothing cuts meets all of them:
one that no earlier document has equally often, or that stands in another order
in all of them.

Only hashes and positions are shuffled until the end, when each text meets the
positions to delete. Alignment compares other hashes than the keys are made
of, so a wrong deletion takes a collision of both, 128 bits in all. A key in a
third of all documents is counted before the shuffle, and its first holders
reach the others by a broadcast. Holders are numbered only for keys that are
left uncut somewhere, by ranges of (key, holder).

Defined results: a null text has no lines, and stays null; rows that repeat an
id and its text are one document and are all cut alike, never against each
other; null ids come last, and of equal ids the text with the smaller hash
comes first, so reruns agree; a very long text is one row of line hashes,
aligned whole by one worker; an empty table gives an empty result; further
columns pass through, but those named like a measure (MEASURES), which give
way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, counted, table, with_groups
from .patience import align

#: Fewest characters of a block.
LEAST_CHARS = 20
#: What is measured of each document.
MEASURES = ("n_lines", "n_cut", "cut_chars")
#: Factor by which the holders that uncut keys have met grow in each round.
STEP = 4


def blocks(later: list[int], sizes: list[int], first: list[int], least: int) -> list[int]:
    """Positions of the later document's lines, 0 for blank ones, that lie in blocks aligned with the first's."""
    at = [i for i, l in enumerate(later) if l]
    pairs = align([later[i] for i in at], [l for l in first if l], repeats=True)
    out: list[int] = []
    start = 0
    for k in range(1, len(pairs) + 1):
        if k == len(pairs) or pairs[k] != (pairs[k - 1][0] + 1, pairs[k - 1][1] + 1):
            run = [at[i] for i, _ in pairs[start:k]]
            if sum(sizes[i] for i in run) >= least:
                out += range(run[0], run[-1] + 1)
            start = k
    return out


def _aligner(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, cut): positions of the later document that go."""
        for batch in batches:
            rows = [blocks(*x, least) for x in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["row", "cut"])

    return run


def _windows(solid: Column, least: int) -> Column:
    """The shortest runs of lines with ``least`` characters, forwards and backwards from each line of ``solid`` (hash,
    size, at): their key and the positions of their first and last line."""

    def run(lines: Column, seed: int) -> Column:
        none = F.struct(F.lit(0).alias("chars"), F.lit(seed).cast("long").alias("hash"), F.lit(-1).alias("at"))
        return F.aggregate(
            lines,
            none,
            lambda s, x: F.when(s["chars"] >= least, s).otherwise(
                F.struct((s["chars"] + x["size"]).alias("chars"), F.xxhash64(s["hash"], x["hash"]).alias("hash"), x["at"].alias("at"))
            ),
        )

    def window(key: Column, first: Column, last: Column) -> Column:
        return F.struct(key.alias("key"), first.alias("a"), last.alias("b"))

    def both(x: Column, i: Column) -> Column:
        # Lines that are not blank have a character at least, so ``least`` of them suffice.
        after = F.slice(solid, i + 1, least)
        before = F.reverse(F.slice(solid, F.greatest(i + 2 - least, F.lit(1)), F.least(i + 1, F.lit(least))))
        forwards = F.transform(F.array(run(after, 0)), lambda g: F.when(g["chars"] >= least, window(g["hash"], x["at"], g["at"])))
        backwards = F.transform(F.array(run(before, 1)), lambda g: F.when(g["chars"] >= least, window(g["hash"], g["at"], x["at"])))
        alone = F.array(window(F.xxhash64(F.lit(0).cast("long"), x["hash"]), x["at"], x["at"]))
        return F.when(x["size"] >= least, alone).otherwise(F.concat(forwards, backwards))

    return F.filter(F.flatten(F.transform(solid, both)), lambda w: w.isNotNull())


def _standing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, key) of the windows of which a line still stands, from (row, lines, keys, a, b, cut)."""
    for batch in batches:
        row, keys = [], []
        for i in range(batch.num_rows):
            lines, key, first, last = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(1, 5))
            stands = lines != 0
            if batch.column(5)[i].is_valid:
                stands[batch.column(5)[i].values.to_numpy(zero_copy_only=False)] = False
            before = np.concatenate([[0], np.cumsum(stands)])
            open_ = np.unique(key[before[last + 1] > before[first]])
            row.append(np.full(len(open_), batch.column(0)[i].as_py(), np.int64))
            keys.append(open_.astype(np.int64))
        if row:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(row)), pa.array(np.concatenate(keys))], ["row", "key"])


def _numbered(holders: DataFrame) -> DataFrame:
    """(key, row, k): the holders of each key counted in order, by ranges, so that no task meets a key whole."""
    spread = checkpointed(holders.repartitionByRange("key", "o").withColumn("at", F.spark_partition_id()))
    sizes = spread.groupBy("key", "at").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("key", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = spread.withColumn("i", F.row_number().over(Window.partitionBy("key", "at").orderBy("o")))
    return inside.join(sizes, ["key", "at"]).select("key", "row", (F.col("before") + F.col("i")).alias("k"))


def cut_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least: int = LEAST_CHARS) -> DataFrame:
    """``docs`` with the text of each document less what it repeats of earlier ones, and n_lines, n_cut, cut_chars."""
    lines = F.split(F.col("_t"), "\n")
    keyed = docs.select(docs[id_col].alias("_id"), docs[text].alias("_t")).where(F.col("_t").isNotNull())
    bare = F.transform(lines, lambda l: F.trim(l, F.lit(" \t\r\x0b\x0c")))
    rows = keyed.select("_id", F.xxhash64("_t").alias("_key"), bare.alias("bare"))
    rows = rows.select(
        "_id",
        "_key",
        F.transform("bare", lambda l: F.when(l == "", F.lit(0).cast("long")).otherwise(F.xxhash64(l))).alias("lines"),
        F.transform("bare", F.length).alias("sizes"),
        F.filter(
            F.transform("bare", lambda l, i: F.struct(F.xxhash64(F.lit("key"), l).alias("hash"), F.length(l).alias("size"), i.alias("at"))),
            lambda x: x["size"] > 0,
        ).alias("solid"),
    )
    rows = rows.groupBy("_id", "_key").agg(F.first(F.struct("lines", "sizes", "solid")).alias("d"))
    rows = rows.select("_id", "_key", "d.lines", "d.sizes", _windows(F.col("d.solid"), least).alias("keys"))
    rows = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))
    order = F.struct(F.col("_id").isNull().alias("a"), F.col("_id").alias("b"), F.col("_key").alias("c"), F.col("row").alias("row"))
    held = rows.select("row", order.alias("o"), F.explode("keys.key").alias("key"))
    held, seen = counted(held.groupBy("row", "key").agg(F.first("o").alias("o"), F.count(F.lit(1)).alias("n")))
    # Of each key the first holder for every number of times that it occurs in one: few, however many hold it.
    firsts = held.groupBy("key", "n").agg(F.min("o").alias("o"), F.count(F.lit(1)).alias("df"))
    firsts = firsts.groupBy("key").agg(F.collect_list(F.struct("n", "o")).alias("by"), F.sum("df").alias("df"), F.min("o").alias("first")).where("df > 1")
    held = with_groups(held, firsts, "key", "df", seen["rows"], "row").where("df IS NOT NULL")
    held = held.where("row <> first.row")

    def earliest(test) -> Column:
        return F.array_min(F.transform(F.filter("by", test), lambda x: x["o"]))

    partners = F.array_distinct(F.array("first", earliest(lambda x: x["n"] == 1), earliest(lambda x: x["n"] == F.col("n"))))
    pairs = held.select("row", "o", F.explode(partners).alias("p")).where("p < o").select("row", F.col("p.row").alias("first")).distinct()
    later = rows.select("row", F.col("lines").alias("later"), "sizes")
    earlier = rows.select(F.col("row").alias("first"), F.col("lines").alias("earlier"))

    def aligned(pairs: DataFrame) -> DataFrame:
        """(row, _cut) of the documents that lose lines to one of their partners."""
        frame = pairs.join(earlier, "first").join(later, "row").select("row", "later", "sizes", "earlier")
        cuts = frame.mapInArrow(_aligner(least), "row long, cut array<int>").where(F.size("cut") > 0)
        return cuts.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("cut"))).alias("_cut"))

    def uncut(some: DataFrame, cuts: DataFrame) -> DataFrame:
        """The rows of ``some`` whose window still has a line that stands."""
        left = some.select("row").distinct().join(rows.select("row", "lines", "keys"), "row").join(cuts, "row", "left")
        left = left.select("row", "lines", "keys.key", "keys.a", "keys.b", "_cut").mapInArrow(_standing, "row long, key long")
        return some.join(left, ["row", "key"], "left_semi")

    pairs = checkpointed(pairs)
    cuts = checkpointed(aligned(pairs))
    waiting = checkpointed(uncut(held.select("key", "row"), cuts))
    if not waiting.isEmpty():
        again = checkpointed(waiting.select("key").distinct())
        order_of = rows.select("row", order.alias("o"), F.explode(F.array_distinct("keys.key")).alias("key"))
        holders = checkpointed(_numbered(order_of.join(again, "key", "left_semi")))
        waiting = waiting.join(holders, ["key", "row"])
        # The first holder was met by all.
        met, reach, done = 1, STEP, pairs
        while True:
            waiting = checkpointed(waiting.where(F.col("k") > met + 1))
            if waiting.isEmpty():
                break
            next_ones = holders.where((F.col("k") > met) & (F.col("k") <= reach)).select("key", F.col("row").alias("first"), F.col("k").alias("j"))
            pairs = waiting.join(next_ones, "key").where("j < k").select("row", "first").distinct()
            pairs = checkpointed(pairs.join(done, ["row", "first"], "left_anti"))
            done = done.unionByName(pairs)
            more = cuts.unionByName(aligned(pairs)).groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("_cut"))).alias("_cut"))
            cuts = checkpointed(more)
            waiting = uncut(waiting, cuts)
            met, reach = reach, reach * STEP
    cuts = cuts.join(rows.select("row", F.col("_id").alias("_cid"), F.col("_key").alias("_ckey")), "row").drop("row")
    whole = docs.select(*[docs[c].alias(f"_c{i}") for i, c in enumerate(docs.columns)], docs[id_col].alias("_id"), docs[text].alias("_t"))
    out = whole.join(cuts, whole["_id"].eqNullSafe(cuts["_cid"]) & (F.xxhash64("_t") == cuts["_ckey"]), "left")
    kept = F.filter(lines, lambda l, i: ~F.array_contains(F.col("_cut"), i))
    new = F.when(F.col("_cut").isNull(), F.col("_t")).otherwise(F.concat_ws("\n", kept))
    at = docs.columns.index(text)
    return out.withColumn("_new", new).select(
        *[(F.col("_new") if i == at else F.col(f"_c{i}")).alias(c) for i, c in enumerate(docs.columns) if c not in MEASURES],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_cut"), F.lit(0)).cast("long").alias("n_cut"),
        (F.length("_t") - F.length("_new")).cast("long").alias("cut_chars"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
