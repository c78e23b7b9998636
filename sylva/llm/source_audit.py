"""How the sources of a language differ: distances of all pairs of sources, and the terms that set a source apart.

Terms are runs of letters (ASCII letters in lower case, and all that is not
ASCII). A language keeps the terms that occur in at least LEAST_DOCS of its
documents. A term's probability in a group of documents is the whole number
p = 1 + floor(10**9 * (count + 2) / (N + 2 * V)); two probabilities are
floor((p - q)**2 / (p + q)) apart. All arithmetic is on whole numbers.

Counting reads every text once: tasks count the terms of their own documents
(Arrow dictionaries, so equal terms are equal texts) and hand on one row a
group and term, whatever the number of occurrences, so no term or source is hot.

The terms of a group are searched by upper bounds. Terms fall into buckets by
the powers of two of their counts; a bucket's largest probability in the group
and smallest one in the language bound the value of each of its terms, since
the value grows with p and falls with q where p > q. Buckets are evaluated best
bound first, more at a time in each round, until every unseen bound is strictly
below the group's k-th value; equal bounds are still evaluated, so ties are
settled by the terms alone.

Distances of pairs come from postings. A pair's sum over all terms is the sum
for two sources without any term, plus what each source's own counts change
against a source without them (from a histogram of its counts), plus a
correction for the terms that both hold, which a join of postings yields. No
term is visited for a source that does not hold it.

Defined results: null text, language and source count as ''; a group without
terms has probabilities from its zero counts; a language without kept terms
gives distances of 0 and no terms; a language with one source has no pairs;
repeated rows count as often as they occur, ids are not read; an empty table
gives an empty result; further columns are not read; a very long text is a
batch of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import LOWER, give_back
from .common import bounded, checkpointed, table
from .tables import stored

#: Documents of a language that a kept term occurs in.
LEAST_DOCS = 10
#: Terms that are reported for each group.
TOP = 10
#: Scale of probabilities.
SCALE = 1_000_000_000
#: Terms of a group that the first round may evaluate, and the factor from round to round.
FIRST, MORE = 64, 16
#: Counted rows that a task holds before it hands them on.
HELD = 400_000
#: Groups that are broadcast at most.
FEW_GROUPS = 20_000

_TERM = np.zeros(256, bool)
_TERM[128:] = True
for _a, _b in ((65, 91), (97, 123)):
    _TERM[_a:_b] = True


def _terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of a batch of texts, one after the other, and the text that each comes from."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = _TERM[data]
    before = np.append(False, inside[:-1])[: len(data)]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.append(inside[1:], False)[: len(data)]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    packed = LOWER[data[inside]]
    bounds = np.append(0, np.cumsum(ends - starts))
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(packed))
    return terms, np.searchsorted(offsets, starts, "right") - 1


def _summed(parts: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(parts).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return out.rename_columns(["lang", "source", "term", "n", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's documents; each group also has a row without a term."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        group = pa.StructArray.from_arrays([batch.column(i).cast(pa.string()).fill_null("") for i in (1, 2)], ["lang", "source"])
        names = pa.Table.from_arrays(group.flatten(), ["lang", "source"]).append_column("at", pa.array(np.arange(len(group))))
        own = names.group_by(["lang", "source"], use_threads=False).aggregate([("at", "list")])
        of = np.empty(len(group), np.int64)
        lists = own.column("at_list").combine_chunks()
        of[lists.flatten().to_numpy()] = np.repeat(np.arange(len(own)), lists.value_lengths().to_numpy())
        terms, doc = _terms(batch.column(0))
        coded = terms.dictionary_encode()
        code, many = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        # Occurrences of a term in a text, then texts and occurrences of a term in a group.
        once, times = np.unique(doc * max(many, 1) + code, return_counts=True)
        both, at = np.unique(of[once // max(many, 1)] * max(many, 1) + once % max(many, 1), return_inverse=True)
        n = np.bincount(at, times, len(both)).astype(np.int64)
        group_at = np.append(both // max(many, 1), np.arange(len(own)))
        found = pa.Table.from_arrays(
            [own.column("lang").take(group_at), own.column("source").take(group_at),
             pa.chunked_array([coded.dictionary.cast(pa.string()).take(pa.array(both % max(many, 1))), pa.nulls(len(own), pa.string())]),
             pa.array(np.append(n, np.zeros(len(own), np.int64))), pa.array(np.append(np.bincount(at, minlength=len(both)), np.zeros(len(own))).astype(np.int64))],
            ["lang", "source", "term", "n", "docs"],
        )
        held.append(found)
        size += len(found)
        if size > HELD:
            held = [_summed(held)]
            size = len(held[0])
            if size > HELD // 2:
                yield from held[0].combine_chunks().to_batches(max_chunksize=10_000)
                held, size = [], 0
    if held:
        yield from _summed(held).combine_chunks().to_batches(max_chunksize=10_000)
    del held
    give_back()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n occurrences, docs documents) of every term; a row without a term for every group."""
    frame = docs.select(docs[text].cast("string").alias("_text"), docs[lang].cast("string").alias("_lang"), docs[source].cast("string").alias("_source"))
    counted = frame.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exactly; null without terms."""
    out = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)"), (total + terms * 2).cast("decimal(20,0)"))
    return F.when(terms > 0, F.lit(1).cast("long") + out)


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def postings(docs: DataFrame, least_docs: int = LEAST_DOCS, text: str = "text", lang: str = "lang", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """Kept terms of each group that holds them (lang, source, term, n, p, and in the language ln, q), and all groups
    (lang, source, v kept terms, total, held kept terms, p0 probability of a term that the group lacks)."""
    counts = stored(term_counts(docs, text, lang, source))
    words = counts.where("term IS NOT NULL")
    in_lang = words.groupBy("lang", "term").agg(F.sum("n").alias("ln"), F.sum("docs").alias("_docs")).where(F.col("_docs") >= least_docs).drop("_docs")
    kept = words.join(in_lang, ["lang", "term"]).select("lang", "source", "term", "n", "ln")
    kept = checkpointed(kept)
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    langs = checkpointed(in_lang.groupBy("lang").agg(F.sum("ln").alias("ltotal"), F.count(F.lit(1)).alias("v")))
    groups = counts.where("term IS NULL").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("v", "total", "held", "ltotal")])
    groups = bounded(groups.withColumn("p0", probability(F.lit(0).cast("long"), F.col("total"), F.col("v"))), FEW_GROUPS)
    scored = kept.join(groups.select("lang", "source", "v", "total", "ltotal", "p0"), ["lang", "source"])
    scored = scored.withColumn("p", probability(F.col("n"), F.col("total"), F.col("v"))).withColumn("q", probability(F.col("ln"), F.col("ltotal"), F.col("v")))
    return checkpointed(scored.select("lang", "source", "term", "n", "ln", "p", "q", "p0")), groups


def _bucket() -> Column:
    return F.floor(F.log2("n") * 2) * 256 + F.floor(F.log2("ln"))


def top_terms(posts: DataFrame, k: int = TOP) -> DataFrame:
    """(lang, source, term, value, rank) of each group's k most telling terms among those with p > q."""
    keys = ["lang", "source"]
    posts = posts.withColumn("_b", _bucket())
    found = posts.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_size"), F.max("p").alias("_p"), F.min("q").alias("_q"))
    found = found.where("_p > _q").withColumn("_bound", apart(F.col("_p"), F.col("_q")))
    ahead = Window.partitionBy(*keys).orderBy(F.col("_bound").desc(), "_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = checkpointed(found.select(*keys, "_b", "_bound", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_ahead")))
    order = Window.partitionBy(*keys).orderBy(F.col("value").desc(), "term")
    best, least, seen, upto = None, None, -1, FIRST
    while True:
        # The unseen buckets of groups that are still open, as far as this round goes: rows ahead of them tell which.
        left = buckets.where(F.col("_ahead") > seen)
        if least is not None:
            left = left.join(least, keys, "left").where(F.col("_bound") >= F.coalesce("_kth", F.lit(-1))).drop("_kth")
        now = bounded(left.where(F.col("_ahead") <= upto).select(*keys, "_b"), FEW_GROUPS)
        fresh = posts.join(now, [*keys, "_b"]).where("p > q").select(*keys, "term", apart(F.col("p"), F.col("q")).alias("value"))
        both = fresh if best is None else fresh.unionByName(best)
        best = checkpointed(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*keys, "term", "value"))
        least = checkpointed(best.groupBy(*keys).agg(F.min("value").alias("_min"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k).select(*keys, F.col("_min").alias("_kth")))
        seen, upto = upto, upto * MORE
        open_ = buckets.where(F.col("_ahead") > seen).join(least, keys, "left").where(F.col("_bound") >= F.coalesce("_kth", F.lit(-1)))
        if open_.isEmpty():
            return best.withColumn("rank", F.row_number().over(order))


def pair_distances(posts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, other, value) of every ordered pair of a language's sources."""
    a = groups.select("lang", F.col("source").alias("s"), F.col("p0").alias("s0"), "v")
    b = groups.select("lang", F.col("source").alias("t"), F.col("p0").alias("t0"))
    none = a.join(b, "lang").where("s < t").select("lang", "s", "t", F.coalesce(F.col("v") * apart(F.col("s0"), F.col("t0")), F.lit(0)).alias("value"))
    counts = checkpointed(posts.groupBy("lang", F.col("source").alias("s"), "p", F.col("p0").alias("s0")).agg(F.count(F.lit(1)).alias("_n")))
    alone = counts.join(b, "lang").where("s <> t")
    change = F.col("_n") * (apart(F.col("p"), F.col("t0")) - apart(F.col("s0"), F.col("t0")))
    alone = alone.select("lang", F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t"), change.alias("value"))
    one = posts.select("lang", "term", F.col("source").alias("s"), F.col("p").alias("sp"), F.col("p0").alias("s0"))
    two = posts.select("lang", "term", F.col("source").alias("t"), F.col("p").alias("tp"), F.col("p0").alias("t0"))
    fix = apart(F.col("sp"), F.col("tp")) - apart(F.col("sp"), F.col("t0")) - apart(F.col("s0"), F.col("tp")) + apart(F.col("s0"), F.col("t0"))
    both = one.join(two, ["lang", "term"]).where("s < t").select("lang", "s", "t", fix.alias("value"))
    # Each part is summed for itself before they meet, so that only sums of pairs are shuffled.
    parts = [x.groupBy("lang", "s", "t").agg(F.sum("value").alias("value")) for x in (alone, both)]
    total = none.unionByName(parts[0]).unionByName(parts[1]).groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("s").alias("source"), F.col("t").alias("other")), F.struct(F.col("t").alias("source"), F.col("s").alias("other"))))
    return total.select("lang", ends.alias("_e"), "value").select("lang", "_e.source", "_e.other", "value")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts, groups = postings(table(spark, sf_dir, "documents"))
    pairs = pair_distances(posts, groups).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    terms = top_terms(posts).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(terms)


SQL = r"""
WITH d AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
r AS (SELECT lang, source, row_number() OVER () AS id, regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM d),
w AS (SELECT lang, source, id, translate(unnest(ts), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM r),
k AS (SELECT lang, term, count(*) AS ln FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(ln)::HUGEINT AS lt FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, k.ln, coalesce(x.n, 0)::HUGEINT AS n FROM g JOIN k ON g.lang = k.lang
      LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
t AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
p AS (SELECT c.lang, c.source, c.term, c.n, 1 + (1000000000::HUGEINT * (c.n + 2)) // (t.total + 2 * l.v) AS p, 1 + (1000000000::HUGEINT * (c.ln + 2)) // (l.lt + 2 * l.v) AS q
      FROM c JOIN t USING (lang, source) JOIN l USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
entries AS (
  SELECT pair.lang, pair.source, 'pair' AS part, pair.item, coalesce(pv.value, 0)::BIGINT AS value FROM pair LEFT JOIN pv USING (lang, source, item)
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM entries) WHERE part = 'pair' OR rank <= 10
"""
