"""Near-duplicate detection from bottom-k sketches of word shingles.

A document's set is its distinct 5-word shingles, hashed by one function. The
k smallest hashes are its sketch. Documents with the same set are one class
from the start, so copies never form pairs. Classes are found through inverted
lists of retained values, and candidates pass in three steps: they share a
listed value, their union sketch estimates a high enough similarity, and the
exact Jaccard similarity of the full sets confirms them.

Long lists do not become all pairs:

* Two similar sets share min_shared or more of the retained values, so each
  class is listed only under its k - min_shared + 1 rarest values: by the
  pigeonhole principle, two classes that share min_shared values still meet.
  Passages that many documents quote are frequent values and drop out.
* In every list one typical class is compared with all others (a star, linear
  in the list). Lists that then hold one component are finished. What is left
  are pairs between components of one list, joined with the size test and a
  bound on the symmetric difference inside the join condition. The bound comes
  from a second sketch of 128 bytes and never rejects a similar pair.

The chance that a pair at the threshold shares fewer than min_shared of k
values is below MISS (binomial), and falls fast above the threshold; the least
estimate that a candidate needs is min_shared / k.

Defined results: a text without words, or null, has an empty set and is linked
with nothing; repeated rows are one class; a null id forms a class member that
never gives its component its name unless all its members lack one; ties need
no rule, since components do not depend on an order; a very long text is one
set, held whole by one worker with about 30 bytes for each word, and its set
travels only to be confirmed; an empty table gives an empty result; further
columns pass through the filter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import distinct_by_row, mix, shingles, words_of
from .common import NARROW, bounded, checkpointed, counted, keep_rows, table, with_groups

#: Retained hashes of a sketch.
K = 40
#: Chance with which a pair at the threshold may share fewer of them than ``shared_at_least`` says.
MISS = 1e-7
#: Percent of the union that linked sets share.
PERCENT = 85
#: Hubs that a group of equally typical classes gets, about.
HUBS = 4
#: Bits of the sketch of symmetric differences.
ODD_BITS = 1024


def shared_at_least(percent: int, k: int) -> int:
    """How many of the k values of their union sketch two sets at the threshold share, but for a chance of MISS."""
    p, below = percent / 100, 0.0
    for m in range(k + 1):
        below += math.comb(k, m) * p**m * (1 - p) ** (k - m)
        if below > MISS:
            break
    if m < 1:
        raise ValueError(f"a sketch of {k} values is too small for {percent} per cent")
    return m


def _sketches(docs: DataFrame, text: str, id_col: str, size: int, k: int) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, two fingerprints of the set, its k smallest hashes in order, and its odd sketch."""
    frame = docs.select(docs[id_col].alias("doc_id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column(1), lower=True):
                h, r = distinct_by_row(*shingles(words, size))
                edge = np.searchsorted(r, np.arange(words.docs + 1))
                count = np.diff(edge)
                sums = np.zeros((2, len(h) + 1), np.uint64)
                np.cumsum(mix(h), out=sums[0, 1:])
                np.cumsum(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=sums[1, 1:])
                prints = [(s[edge[1:]] - s[edge[:-1]]).view(np.int64) for s in sums]
                held = np.minimum(count, k)
                to = np.concatenate([[0], np.cumsum(held)])
                at = np.arange(to[-1]) - np.repeat(to[:-1], held) + np.repeat(edge[:-1], held)
                # Signed values sort in another order than the hashes; any fixed order will do.
                sketch = pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(h[at].view(np.int64)))
                ids = batch.column(0).slice(words.first, words.docs)
                bit = r * ODD_BITS + (h >> np.uint64(20)).astype(np.int64) % ODD_BITS
                odd = np.packbits((np.bincount(bit, minlength=words.docs * ODD_BITS) & 1).astype(np.uint8)).view(np.int64)
                odd = pa.FixedSizeListArray.from_arrays(pa.array(odd), ODD_BITS // 64).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, batch.column(2).slice(words.first, words.docs), pa.array(count.astype(np.int64)), *map(pa.array, prints), sketch, odd],
                    ["doc_id", "_key", "n_shingles", "f1", "f2", "sketch", "odd"],
                )

    kind = frame.schema["doc_id"].dataType.simpleString()
    return frame.mapInArrow(run, f"doc_id {kind}, _key long, n_shingles long, f1 long, f2 long, sketch array<bigint>, odd array<bigint>")


def _full_sets(docs: DataFrame, text: str, size: int) -> DataFrame:
    """_class and the sorted set of hashes of its text."""
    frame = docs.select("_class", docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column(1), lower=True):
                h, r = distinct_by_row(*shingles(words, size))
                edge = np.searchsorted(r, np.arange(words.docs + 1)).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(edge), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(words.first, words.docs), sets], ["_class", "set"])

    return frame.mapInArrow(run, "_class long, set array<bigint>")


def _estimate(a: Column, b: Column, k: int) -> Column:
    """Share of the union sketch that lies in both sketches.

    The union sketch is the k smallest values of both; since a shared value is
    below a bound exactly if it is retained by both, the shared values of the
    two sketches, cut at the k-th of the union, are what is counted.
    """
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    both = F.array_intersect(F.array_intersect(union, a), b)
    return F.size(both) / F.greatest(F.size(union), F.lit(1))


def _may_differ_little(a: str, b: str, percent: int) -> Column:
    """False only for pairs whose sets are surely not similar enough.

    Each element flips one bit of its set's odd sketch, so two sketches differ
    in at most as many bits as the sets differ in elements.
    """
    bits = sum((F.bit_count(F.col(f"{a}.odd")[i].bitwiseXOR(F.col(f"{b}.odd")[i])) for i in range(ODD_BITS // 64)), F.lit(0))
    return bits * (100 + percent) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - percent)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    a = sets.select(F.col("_class").alias("a"), F.col("set").alias("sa"))
    b = sets.select(F.col("_class").alias("b"), F.col("set").alias("sb"))
    frame = pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                x, y = left[i].values.to_numpy(), right[i].values.to_numpy()
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return frame.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, at_most: int | None = None) -> DataFrame:
    """node and its component (smallest node that it reaches) for every node of edges (a, b), but for those that name one.

    Alternates the large-star step, in which every node hands its larger
    neighbours to its smallest one, and the small-star step, in which it hands
    on its smaller ones. Edges never grow in number, and the rounds are as many
    as the logarithm of the longest chain. Minima are taken before the shuffle
    and handed out by ``with_groups``, so a node with very many edges is no hot key.
    """
    edges, seen = counted(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), at_most)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
        large = with_groups(edges, low, "v", "c", 2 * seen["rows"], "u").select("u", "v", F.least("m", "v").alias("m"))
        low = large.groupBy("u").agg(F.min("m").alias("s"), F.count(F.lit(1)).alias("c"), F.max(F.col("m") < F.col("v")).alias("moved"))
        low, state = counted(low, seen["rows"], most=F.max("c"), moved=F.max("moved"))
        if not seen["rows"] or (state["most"] == 1 and not state["moved"]):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        small = with_groups(large, low.drop("moved"), "u", "c", seen["rows"], "m")
        small = small.select(F.explode(F.array(F.struct("u", F.col("s").alias("v")), F.struct(F.col("m").alias("u"), F.col("s").alias("v")))).alias("e"))
        edges, seen = counted(small.select("e.u", "e.v").where("u <> v").distinct(), 2 * seen["rows"])


def _decided(docs: DataFrame, text: str = "text", id_col: str = "doc_id", size: int = 5, percent: int = PERCENT,
             k: int = K, min_shared: int | None = None) -> DataFrame:
    """One row per document: doc_id, _key (a hash of its text), n_shingles, component_id and kept.

    Of each component the row with the smallest id is kept, ids before nulls; of rows that repeat it, the first.
    """
    if min_shared is None:
        min_shared = shared_at_least(percent, k)
    same = F.when(F.col("n_shingles") > 0, F.concat_ws(":", "n_shingles", "f1", "f2")).alias("_set")
    rows, total = counted(_sketches(docs, text, id_col, size, k).select("*", same, F.monotonically_increasing_id().alias("_row")))
    # A class is named by the smallest row number of its documents; what else it holds goes with the set, or with that row.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("_row").alias("c"))).alias("_first")
    one = F.min_by(F.struct("sketch", "odd", F.col("n_shingles").alias("n"), "doc_id", "_key"), "_row").alias("s")
    full = rows.where("n_shingles > 0")
    classes = full.groupBy("_set").agg(F.min("_row").alias("_class"), first, F.count(F.lit(1)).alias("c"), one)
    classes, held_values = counted(classes, total["rows"], values=F.sum(F.size("s.sketch")))
    values = classes.select("_class", F.explode("s.sketch").alias("value"))
    counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1")
    shared = with_groups(values, counts, "value", "freq", held_values["values"] or 0, "_class").where("freq IS NOT NULL")
    # Values that nobody shares are the rarest; they take places of the prefix without needing a list.
    ranked = shared.groupBy("_class").agg(F.array_sort(F.collect_list(F.struct("freq", "value"))).alias("vs"))
    facts = classes.select("_class", "s.n", "s.sketch", "s.odd", F.struct("s.doc_id", "s._key").alias("name"))
    held = F.least(F.col("n"), F.lit(k)).cast("int")
    need = F.greatest(F.lit(1), F.floor(held * min_shared / k)).cast("int")
    room = held - need + 1 - (held - F.size("vs"))
    listed = ranked.join(facts, "_class").where(room > 0).withColumn("vs", F.slice("vs", 1, room))
    listed, seen = counted(listed, held_values["rows"], entries=F.sum(F.size("vs")))
    entries = seen["entries"] or 0
    lists = listed.select("_class", "n", "vs", F.explode("vs").alias("v")).select("_class", "n", F.col("v.value").alias("value"), "v.freq", "vs")

    def sizes(x: Column, y: Column) -> Column:
        return F.least(x, y) * 100 >= F.greatest(x, y) * percent

    # A hub is a typical member: most of its listed values are about as frequent as this one. Ties fall
    # differently in each list, so that a large group gets several hubs.
    typical = F.size(F.filter("vs", lambda v: v["freq"] * 2 >= F.col("freq")))
    hub = F.max(F.struct(typical.alias("t"), F.xxhash64("_class", F.pmod("value", F.lit(HUBS))).alias("h"), "_class", "n"))
    hubs = lists.groupBy("value").agg(hub.alias("h"), F.count(F.lit(1)).alias("c")).where("c > 1")
    stars = with_groups(lists.select("value", "_class", "n"), hubs, "value", "c", entries, "_class")
    stars = stars.where((F.col("_class") != F.col("h._class")) & sizes(F.col("n"), F.col("h.n")))
    stars = stars.select(F.greatest("h._class", "_class").alias("a"), F.least("h._class", "_class").alias("b")).distinct()

    def alike(pairs: DataFrame) -> DataFrame:
        """The pairs whose union sketches are similar enough, with the names of their texts."""
        x = listed.select(F.col("_class").alias("a"), F.struct("n", "odd", "sketch", "name").alias("x"))
        y = listed.select(F.col("_class").alias("b"), F.struct("n", "odd", "sketch", "name").alias("y"))
        little = _may_differ_little("x", "y", percent)
        enough = _estimate(F.col("x.sketch"), F.col("y.sketch"), k) >= F.lit(shared_at_least(percent, k) / k)
        return pairs.join(x, "a").join(y, "b").where(little & enough).select("a", "b", F.col("x.name").alias("na"), F.col("y.name").alias("nb"))

    texts = docs.select(docs[text].alias("_text"), docs[id_col].alias("_id"), F.xxhash64(docs[text]).alias("_tkey"))

    def confirm(pairs: DataFrame, at_most: int) -> tuple[DataFrame, int]:
        pairs, seen = counted(pairs, at_most)
        names = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("_class"), F.col("na").alias("name")), F.struct(F.col("b").alias("_class"), F.col("nb").alias("name")))).alias("e"))
        names = bounded(names.groupBy("e._class").agg(F.first("e.name").alias("name")), NARROW, 2 * seen["rows"])
        # Rows that repeat an id, or have none, hold other texts: the text's hash says which one is meant.
        source = texts.join(names, (texts["_tkey"] == names["name._key"]) & texts["_id"].eqNullSafe(names["name.doc_id"]))
        sets = _full_sets(source, "_text", size).dropDuplicates(["_class"])
        found, seen = counted(_verified(pairs.select("a", "b"), checkpointed(sets, 2 * seen["rows"]), percent), seen["rows"])
        return found, seen["rows"]

    comp = components(*confirm(alike(stars), entries))
    tagged = listed.select("_class", F.explode("vs.value").alias("value")).join(comp, F.col("_class") == comp["node"], "left")
    tagged = checkpointed(tagged.select("_class", "value", F.coalesce("component", "_class").alias("comp")), entries)
    open_lists = tagged.groupBy("value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c"))
    open_lists = open_lists.where("lo <> hi and c > 2").select("value", "c")
    tagged, seen = counted(with_groups(tagged, open_lists, "value", "c", entries, "_class").where("c IS NOT NULL").drop("c"), entries)
    if seen["rows"]:
        met = tagged.join(listed.select("_class", "n", "odd", F.col("vs.value").alias("vs"), "name"), "_class")
        x, y = met.alias("x"), met.alias("y")
        # A pair that meets in several lists is taken from the first of them.
        here = F.array_min(F.array_intersect(F.col("x.vs"), F.col("y.vs"))) == F.col("x.value")
        rest = x.join(
            y,
            (F.col("x.value") == F.col("y.value"))
            & (F.col("x._class") > F.col("y._class"))
            & (F.col("x.comp") != F.col("y.comp"))
            & sizes(F.col("x.n"), F.col("y.n"))
            & _may_differ_little("x", "y", percent)
            & here,
        )
        rest = rest.select(F.col("x._class").alias("a"), F.col("y._class").alias("b"), F.col("x.name").alias("na"), F.col("y.name").alias("nb"))
        more, found = confirm(rest, max(entries, 1_000_000))
        if found:
            links = comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
            comp = components(links, held_values["rows"] + found)
    # Of each component, the name of its best row goes to all of its classes.
    linked = comp.unionByName(comp.select(F.col("component").alias("node"), "component").distinct())
    linked = linked.join(classes.select(F.col("_class").alias("node"), "_first"), "node")
    best = linked.groupBy("component").agg(F.min("_first").alias("_best"), F.count(F.lit(1)).alias("m"))
    named = with_groups(linked.drop("_first"), best, "component", "m", held_values["rows"], "node").select("node", "_best")
    named = classes.select("_set", "c", "_class", "_first").join(named, F.col("_class") == F.col("node"), "left")
    named = named.select("_set", "c", F.coalesce("_best", "_first").alias("_best"))
    out = with_groups(rows.select("doc_id", "_key", "_row", "n_shingles", "_set"), named, "_set", "c", total["rows"], "_row")
    alone = F.col("n_shingles") == 0
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("_best.b"))
    return out.select("doc_id", "_key", "n_shingles", component.alias("component_id"), (alone | (F.col("_row") == F.col("_best.c"))).alias("kept"))


def near_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id that it reaches) and kept."""
    return _decided(docs, text, id_col, **options).drop("_key")


def drop_near(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that stay: one of each component, and those without words."""
    return keep_rows(docs, _decided(docs, text, id_col, **options), text, id_col)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Here kept says that a row has its component's id; ``near_groups`` keeps one row of a component, also where ids repeat."""
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
