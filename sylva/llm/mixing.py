"""Mixing sources to target weights, in DataFrame functions only.

Every document gets a hash-random key from its id and text. Within a source the
keys are dealt to equal ranges of the hash space, so each range holds about
RANGE_ROWS documents whatever the source's share of the input. Prefix sums of
the sizes come in two levels: over the ranges of a source, from sums that are
made before anything is shuffled, then inside the one range that holds the
source's cut, whose documents are sorted by key. A source's budget is whole
epochs of it, and the rest is cut from the key order: a document belongs to the
last epoch if more than half of it lies before the cut, so the words taken miss
the target by at most half a document.

Rows of one id and text share one key. They are counted before the sort, so
however many they are they take one place in it, and as many of them as lie
before the cut are taken. Only a few facts per source, and no document, meet in
one place; texts are never shuffled.

Defined results: a null text has no words and is taken zero times; a null
source is a source of its own, ordered last; a source without words has the
target 0; repeated rows count and are taken like any other rows, and which of
several rows of one id and text are taken follows from their position; a very
long text is one document, and taken whole or not; an empty table gives an
empty result; further columns pass through, whatever their names. The list of
sources, one row of five numbers each, passes through one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, counted, table, with_groups, word_count

#: Documents that share one range of the key space, about.
RANGE_ROWS = 2_000
#: A source gives at most so many times its size.
MOST_EPOCHS = 3
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_EPOCHS) -> DataFrame:
    """Targets of the sources in ``sizes`` (source, _rows, source_size): all words shared by weight.

    With the sources sorted by capacity over weight, those that reach their
    capacity come first; ``_rate`` is what a unit of weight gets beyond them.
    One row per source passes through a single window: a list of sources, not
    of documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = reduce(lambda c, i: c.when(turn == i, weights[i]), range(len(weights)), F.when(turn == -1, 0))
    s = sizes.withColumn("_w", weight.cast("double")).withColumn("_cap", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = (
        s.withColumn("_words", F.sum("source_size").over(every).cast("double"))
        .withColumn("_left", F.col("_words") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_free", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_rate", F.col("_left") / F.col("_free"))
    )
    open_rate = F.min(F.when(F.col("_rate") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), "_rate"))).over(every)
    s = s.withColumn("_open", open_rate["_rate"])
    share = F.coalesce(F.col("_open") * F.col("_w"), F.col("_cap"))
    return s.select("source", "_rows", "source_size", F.least("_cap", share).alias("target"))


def _keyed(docs: DataFrame, text: str, source: str, id_col: str, seed: str) -> list[Column]:
    """Columns that place a row: its source by a name that is never null, its size, and its key in two parts."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit("")), F.lit(":"), F.coalesce(docs[text], F.lit("")))
    digest = F.sha2(said, 256)
    name = F.coalesce(F.concat(F.lit("="), docs[source].cast("string")), F.lit("null"))
    # 52 random bits, so that the key is exact as a double, and 60 more that settle ties.
    first, second = (F.conv(F.substring(digest, a, n), 16, 10).cast("long") for a, n in ((1, 13), (14, 15)))
    return [name.alias("_source"), word_count(docs[text]).alias("size"), first.alias("_key"), second.alias("_tie")]


def _range(ranges: str) -> Column:
    return F.floor(F.col("_key") / F.lit(float(1 << 52)) * F.col(ranges))


def _cuts(rows: DataFrame, total: int, weights: tuple[int, ...], most: float, range_rows: int) -> DataFrame:
    """One row per source: target, whole epochs, and the last place in key order that the rest reaches, with how
    many of its rows (_some of _many) are taken."""
    sums = rows.groupBy("_source").agg(F.first("source").alias("source"), F.count(F.lit(1)).alias("_rows"), F.sum("size").alias("source_size"))
    facts = source_targets(sums, weights, most)
    facts = facts.withColumn("_source", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))).drop("source")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    facts = facts.withColumn("_whole", whole.cast("long")).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    facts = checkpointed(facts.withColumn("_ranges", F.ceil(F.col("_rows") / range_rows)))
    placed = with_groups(rows, facts.select("_source", "_rows", "_rest", "_ranges"), "_source", "_rows", total, "_row")
    placed = placed.withColumn("_range", _range("_ranges"))
    parts = placed.groupBy("_source", "_range", "_rest").agg(F.sum("size").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    last = parts.where("_start <= _rest").groupBy("_source").agg(F.max_by(F.struct("_range", "_start"), "_range").alias("_last"), F.sum("_n").alias("_rows"))
    last = checkpointed(last.select("_source", "_rows", F.col("_last._range").alias("_cut_range"), F.col("_last._start").alias("_start")), total)
    inside = with_groups(placed, last, "_source", "_rows", total, "_row").where("_range = _cut_range AND size > 0")
    places = inside.groupBy("_source", "_key", "_tie", "_rest", "_start").agg(F.count(F.lit(1)).alias("_many"), F.first("size").alias("size"))
    order = Window.partitionBy("_source").orderBy("_key", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    places = places.withColumn("_start", F.col("_start") + F.coalesce(F.sum(F.col("size") * F.col("_many")).over(order), F.lit(0)))
    some = F.floor((F.col("_rest") - F.col("_start")) / F.col("size") - 0.5) + 1
    places = places.withColumn("_some", F.least(F.greatest(some, F.lit(0)), F.col("_many"))).where("_some > 0")
    cut = places.groupBy("_source").agg(F.max(F.struct("_key", "_tie", "_some", "_many")).alias("_cut"))
    found = facts.join(last.drop("_rows", "_start"), "_source", "left").join(cut, "_source", "left")
    nothing = F.struct(F.lit(-1).cast("long").alias("_key"), F.lit(-1).cast("long").alias("_tie"), F.lit(0).cast("long").alias("_some"), F.lit(0).cast("long").alias("_many"))
    return checkpointed(found.withColumn("_cut", F.coalesce("_cut", nothing)).withColumn("_cut_range", F.coalesce("_cut_range", F.lit(-1))), total)


def _epochs(rows: DataFrame, cuts: DataFrame, total: int) -> DataFrame:
    """``rows`` with source_size, target and epochs."""
    here = with_groups(rows, cuts, "_source", "_rows", total, "_row").withColumn("_range", _range("_ranges"))
    place, end = F.struct("_key", "_tie"), F.struct(F.col("_cut._key"), F.col("_cut._tie"))
    same = F.col("_range") == F.col("_cut_range")
    whole = (F.col("_range") < F.col("_cut_range")) | (same & (place < end))
    split = same & (place == end)
    kept = [*rows.columns, "source_size", "target"]

    def taken(more: Column) -> Column:
        return F.when(F.col("size") > 0, F.col("_whole") + more.cast("long")).otherwise(0).cast("long").alias("epochs")

    if cuts.where("_cut._some < _cut._many").isEmpty():
        return here.select(*kept, taken(whole | split))
    # A cut between rows of one id and text: they are numbered by partition, then inside it.
    torn = F.coalesce(split & (F.col("_cut._some") < F.col("_cut._many")), F.lit(False))
    rest = checkpointed(here.where(torn).withColumn("_part", F.shiftright("_row", 33)))
    counts = rest.groupBy("_source", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_source", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("_source", "_part").orderBy("_row"))
    rest = rest.withColumn("_inside", inside).join(counts, ["_source", "_part"])
    done = rest.select(*kept, taken(F.col("_ahead") + F.col("_inside") <= F.col("_cut._some")))
    return here.where(~torn).select(*kept, taken(whole | split)).unionByName(done)


def _mixed(docs: DataFrame, carried: bool, text: str, source: str, id_col: str, seed: str, weights: tuple[int, ...], most: float, range_rows: int) -> DataFrame:
    keyed = _keyed(docs, text, source, id_col, seed)
    number = F.monotonically_increasing_id().alias("_row")
    rows, seen = counted(docs.select(docs[id_col].alias("doc_id"), docs[source].alias("source"), *keyed, number))
    total = seen["rows"]
    cuts = _cuts(rows, total, weights, most, range_rows)
    if carried:
        rows = docs.select(F.struct(*[docs[c].alias(f"_{i}") for i, c in enumerate(docs.columns)]).alias("_doc"), *keyed, number)
    return _epochs(rows, cuts, total)


def mix_plan(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", seed: str = "mix",
             weights: tuple[int, ...] = WEIGHTS, most: float = MOST_EPOCHS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, epochs (times it is taken) and taken (words)."""
    plan = _mixed(docs, False, text, source, id_col, seed, weights, most, range_rows)
    return plan.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", seed: str = "mix",
                  weights: tuple[int, ...] = WEIGHTS, most: float = MOST_EPOCHS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The mix itself: each document as often as its plan takes it, in the columns of ``docs``."""
    out = _mixed(docs, True, text, source, id_col, seed, weights, most, range_rows).where("epochs > 0")
    again = F.explode(F.sequence(F.lit(1), F.col("epochs").cast("int")))
    out = out.select("_doc", again.alias("_epoch"))
    return out.select(*[F.col("_doc")[f"_{i}"].alias(c) for i, c in enumerate(docs.columns)])


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = """
WITH h AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         sha256('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS h
  FROM documents
), d AS (
  SELECT doc_id, source, size, ('0x' || substr(h, 1, 13))::BIGINT AS k, ('0x' || substr(h, 14, 15))::BIGINT AS tie FROM h
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w
  FROM d GROUP BY source
), c AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
         sum(source_size) OVER ()::DOUBLE - coalesce(sum(3.0::DOUBLE * source_size) OVER b, 0) AS rest,
         sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS free
  FROM s WINDOW b AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), r AS (
  SELECT *, arg_min(rest / free, source_size / w) FILTER (WHERE rest / free * w <= cap) OVER () AS rate FROM c
), t AS (
  SELECT source, source_size, least(cap, coalesce(rate * w, cap)) AS target FROM r
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN size > 0 AND before + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""
