"""Quality rules on repetition, from suffix arrays over words.

The suffix array of a text is built on its words by refining groups of equal
3-word windows: only windows that repeat inside the text are ever sorted
again, so ordinary text costs one sort. Neighbouring suffixes give the longest
common prefixes, and with them the longest repeat that starts at each word;
these are the maximal repeated substrings of the LCP intervals. Their spans
are united, and a text fails if they cover too much of it or one is too long:
a text may pass the base rule, which looks at 3-word windows only, and still
repeat whole passages.

Defined results: a null text has no words, and fails for having under
MIN_WORDS; repeated rows each get a row; null ids stay null; there are no
ties; a very long text is measured whole by one worker, with about 150 bytes of
memory for each word; an empty table gives an empty result; further columns
pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import _BASE, Words, _powers, _room, slices, split_words
from .common import table

#: Limits of the fixed base rules.
MIN_WORDS = 50
#: Percent of a text's words in repeated 3-word windows.
MOST_REPEATED = 50
#: Repeats of at least so many words count for the method's two limits.
MIN_REPEAT = 8
#: Percent of a text's words that repeats may cover, and words that the longest one may have. Clean texts repeat a
#: line or two: of 3,243 texts labelled clean none covers over 34 per cent or repeats over 20 words.
MOST_COVERED = 40
LONGEST = 100

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_CONT = (np.arange(256) & 0xC0) == 0x80

_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_covered_words long, longest_repeat long"
)
COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]


def _window_ranks(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(rank, members): 3-word windows ranked in word order, text by text, so that equal ones of a text share the
    place of the first of them; and the starts of those that repeat in their text. A text's last windows
    are filled up with a word that comes before all others."""
    n = len(words.hash)
    ids = np.zeros(n + 2, np.int64)
    distinct, ids[:n] = np.unique(words.hash, return_inverse=True)
    ids[:n] += 1
    one, two = ids[1 : n + 1].copy(), ids[2 : n + 2].copy()
    last = words.doc[:-1] != words.doc[1:]
    one[:-1][last] = 0
    two[:-1][last] = 0
    two[:-2][words.doc[:-2] != words.doc[2:]] = 0
    bits = int(len(distinct) + 1).bit_length()
    if bits <= 21:
        key = (ids[:n] << (2 * bits)) | (one << bits) | two
        order = np.argsort(key, kind="stable")
        changed = key[order][1:] != key[order][:-1]
    else:
        order = np.lexsort((two, one, ids[:n]))
        changed = np.zeros(n - 1, bool)
        for part in (ids[:n], one, two):
            changed |= part[order][1:] != part[order][:-1]
    new = np.ones(n, bool)
    new[1:] = changed | (words.doc[order][1:] != words.doc[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    width = np.diff(np.append(np.flatnonzero(new), n))
    return rank, order[np.repeat(width > 1, width)]


def _sorted_suffixes(rank: np.ndarray, members: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Members in suffix order: each round doubles the length that ranks tell apart, and goes on with the ties.

    stop is where each member's text ends; of tied suffixes at most one can end where the next comparison starts.
    """
    rank = rank.copy()
    ends = np.zeros(len(rank), np.int64)
    ends[members] = stop
    step, tied = 3, members
    while len(tied):
        ahead = tied + step
        key = np.where(ahead < ends[tied], rank[np.minimum(ahead, len(rank) - 1)], -1)
        order = np.lexsort((key, rank[tied]))
        tied, key, group = tied[order], key[order], rank[tied][order]
        first = np.ones(len(tied), bool)
        first[1:] = group[1:] != group[:-1]
        new = first.copy()
        new[1:] |= key[1:] != key[:-1]
        index = np.arange(len(tied))
        begin = np.maximum.accumulate(np.where(first, index, 0))
        rank[tied] = group + np.maximum.accumulate(np.where(new, index, 0)) - begin
        width = np.diff(np.append(np.flatnonzero(new), len(tied)))
        tied = tied[np.repeat(width > 1, width)]
        step *= 2
    return members[np.argsort(rank[members], kind="stable")]


def _common_prefix(words: Words, sums: np.ndarray, powers: np.ndarray, a: np.ndarray, b: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Words that the suffixes at a and b share, by bisection on hashes of word runs; stop is where texts end."""
    low = np.zeros(len(a), np.int64)
    high = np.minimum(stop[words.doc[a]] - a, stop[words.doc[b]] - b)
    left, right = np.minimum(a, b), np.maximum(a, b)
    shift = powers[right - left]
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high + 1) // 2
        same = (sums[left + mid] - sums[left]) * shift == sums[right + mid] - sums[right]
        low = np.where(open_ & same, mid, low)
        high = np.where(open_ & ~same, mid - 1, high)


def repeats(words: Words, least: int = MIN_REPEAT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: words in repeated 3-word windows, words covered by repeats of ``least`` words or more,
    and words in the longest repeat of three words or more."""
    n, docs = len(words.hash), words.docs
    nothing = np.zeros(docs, np.int64)
    if not n:
        return nothing, nothing, nothing

    def covered(at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        edge = np.bincount(at, minlength=n + 1) - np.bincount(at + length, minlength=n + 1)
        return np.bincount(words.doc[np.cumsum(edge[:-1]) > 0], minlength=docs)

    rank, members = _window_ranks(words)
    if not len(members):
        return nothing, nothing, nothing
    stop = words.bounds()[1:]
    order = _sorted_suffixes(rank, members, stop[words.doc[members]])
    powers = _powers(_room(n), _BASE)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words.hash * powers[:n], out=sums[1:])
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(words.doc[a] == words.doc[b])
    lcp = np.zeros(len(order) + 1, np.int64)
    lcp[near + 1] = _common_prefix(words, sums, powers, a[near], b[near], stop)
    length = np.maximum(lcp[:-1], lcp[1:])
    longest = nothing.copy()
    np.maximum.at(longest, words.doc[order], length)
    long = length >= least
    return covered(members, 3), covered(order[long], length[long]), longest


def _lines(data: np.ndarray, offsets: np.ndarray, word_start: np.ndarray) -> np.ndarray:
    """For each text, its lines with a word that equal an earlier line."""
    docs = len(offsets) - 1
    if not len(data):
        return np.zeros(docs, np.int64)
    newline = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1][offsets[1:] > offsets[:-1]], newline + 1]))
    begin = begin[begin < len(data)]
    doc = np.searchsorted(offsets, begin, "right") - 1
    end = np.minimum(np.append(begin[1:], len(data)), offsets[doc + 1])
    has_word = np.searchsorted(word_start, end) > np.searchsorted(word_start, begin)
    begin, end, doc = begin[has_word], end[has_word], doc[has_word]
    end = end - ((end > begin) & (data[np.maximum(end - 1, 0)] == 10))
    seen: set[tuple[int, bytes]] = set()
    out = np.zeros(docs, np.int64)
    raw = data.tobytes()
    for d, s, e in zip(doc.tolist(), begin.tolist(), end.tolist()):
        line = (d, raw[s:e])
        if line in seen:
            out[d] += 1
        else:
            seen.add(line)
    return out


def measure(texts: pa.Array) -> Iterator[dict[str, np.ndarray]]:
    """The columns of COLUMNS for consecutive slices of the texts."""
    for first, data, offsets in slices(texts):
        words = split_words(first, data, offsets)

        def per_text(mask: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(data) + 1, np.int64)
            np.cumsum(mask, out=sums[1:])
            return sums[offsets[1:]] - sums[offsets[:-1]]

        inside = np.zeros(len(data) + 1, np.int8)
        inside[words.start] = 1
        inside[words.end[words.end < len(data)]] -= 1
        in_word = np.cumsum(inside[:-1], dtype=np.int8) > 0
        in_windows, covered, longest = repeats(words)
        yield {
            "n_words": words.counts(),
            "word_chars": per_text(in_word & ~_CONT[data]),
            "n_symbols": per_text(_SYMBOL[data]),
            "n_dup_lines": _lines(data, offsets, words.start),
            "n_repeat_words": in_windows,
            "n_covered_words": covered,
            "longest_repeat": longest,
        }


def quality_report(docs: DataFrame, text: str = "text", carry: list[str] | None = None,
                   most_covered: int = MOST_COVERED, longest: int = LONGEST) -> DataFrame:
    """``carry`` columns (all by default) with the measures, base_failed and kept."""
    carry = docs.columns if carry is None else carry
    frame = docs.select(*[docs[c].alias(f"_c{i}") for i, c in enumerate(carry)], docs[text].alias("_text"))
    kinds = [f"_c{i} {frame.schema[f'_c{i}'].dataType.simpleString()}" for i in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = list(measure(batch.column(batch.num_columns - 1)))
            if parts:
                cols = [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64)) for c in COLUMNS]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], [*batch.schema.names[:-1], *COLUMNS])

    out = frame.mapInArrow(run, ", ".join([*kinds, _SCHEMA]))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    verdict = (100 * F.col("n_covered_words") <= most_covered * F.col("n_words")) & (F.col("longest_repeat") <= longest)
    return out.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
        *COLUMNS,
        base_failed.alias("base_failed"),
        (~base_failed & verdict).alias("kept"),
    )


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, in the columns of ``docs``."""
    plain = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    at = docs.columns.index(text)
    good = quality_report(plain, f"_{at}").where("kept")
    return good.select(*[good[f"_{i}"].alias(c) for i, c in enumerate(docs.columns)])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_report(docs, carry=["doc_id"])
