"""Language-model scores from a lattice of subwords.

The pieces of an existing vocabulary span a lattice over each word; a word's
probability is the sum over all its segmentations, found by a forward
recursion in log space. The vocabulary at hand is a merge list whose stored
scores are ranks and no log probabilities, so piece weights start from that
order (1 / (rank + 50)) and are re-estimated by expectation maximisation on the
distinct words of the training documents, since the pieces spell words that are
not known yet. ``lattice_score`` is the log10 of the lattice's probability alone:
each word opened by the vocabulary's word mark, and one end.

``text_score`` adds one arc over the whole word to each lattice, weighted by how
often training texts hold the word, less a discount (Kneser and Ney's). What the
discounts save goes to the pieces, for all words: words that no training text
holds are paid for by their spelling alone. Every segmentation opens with a piece
that has the word mark, and a word stops where the next such piece or the text's
end would stand, so the lattice's probabilities of all words sum to at most 1,
and so do those of ``text_score``: whole words have what the discounts leave,
pieces what they save. ``score`` is the same model with all unknown words as one
type, as ``base_score`` has them, so that these two can be compared: the type has
what the lattice leaves to all words but the known ones, and the probabilities of
known words, the unknown one and the end sum to 1.

The work is done once per distinct word: a table of all words holds counts and
log probabilities. Scoring needs the table beside every text. Its most
frequent HOT words (a bounded number) go to every executor; for the rest, each
text's words are joined with the table and summed per text.

Defined results: a null text has no words and scores its end alone; a null id
counts as held out; repeated rows are learnt and scored like any others; with
no training rows all counts are 0 and the first piece probabilities hold;
there are no ties; a very long text is one value, its rare words one row each; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import words_of
from .common import checkpointed, crc_mod, table

#: Words whose facts every executor holds.
HOT = 100_000
#: Rounds of re-estimation, and what each piece counts before them.
ROUNDS = 3
PRIOR = 0.05
#: Distinct words that are spelled together.
TOGETHER = 50_000
#: Probability that a text ends, as one training token would tell it.
END = 0.01
#: Distinct words that a task gathers before it hands them on.
GATHERED = 1 << 20

#: Bits of a place in the tables of pieces.
SLOT_BITS = 20

_LN10 = float(np.log(10.0))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _slot(h: np.ndarray, level: int) -> np.ndarray:
    """A place of SLOT_BITS bits for each hash, another one at each level."""
    return ((h * np.uint64(0x9E3779B97F4A7C15 + 2 * level * 0xD1B54A32D192ED03 & (1 << 64) - 1)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class Hashed:
    """Finds values by their hashes: a key stands in the first level where its place is free."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.levels = keys, []
        rest = np.arange(len(keys))
        while len(rest):
            at, first = np.unique(_slot(keys[rest], len(self.levels)), return_index=True)
            slots = np.full(1 << SLOT_BITS, -1, np.int32)
            slots[at] = rest[first]
            self.levels.append(slots)
            rest = np.delete(rest, first)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of h that are keys, which keys)."""
        rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        open_ = np.arange(len(h))
        for level, slots in enumerate(self.levels):
            at = slots[_slot(h[open_], level)]
            taken = at >= 0  # a key whose place is free at one level is at no later one
            open_, at = open_[taken], at[taken]
            hit = self.keys[at] == h[open_]
            rows.append(open_[hit])
            found.append(at[hit])
            open_ = open_[~hit]
            if not len(open_):
                break
        return np.concatenate(rows), np.concatenate(found)


class Lattice:
    """Pieces of a vocabulary, as hashes of their code points and of their beginnings."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size = n
        self.bytes = np.zeros(256, np.int64)
        prefixes: set[int] = set()
        whole: dict[int, int] = {}
        for i in range(n):
            if sp.is_byte(i):
                self.bytes[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                h = 0
                for c in sp.id_to_piece(i):
                    h = (h * 0x100000001B3 + ord(c) + 1) % (1 << 64)
                    prefixes.add(h)
                whole.setdefault(h, i)
        # Beginnings only say where to stop looking, so a bit each will do; pieces themselves are compared.
        self.begins = np.zeros(1 << SLOT_BITS, bool)
        self.begins[_slot(np.array(list(prefixes), np.uint64), 0)] = True
        self.pieces, self.ids = Hashed(np.array(list(whole), np.uint64)), np.array(list(whole.values()), np.int64)

    def start(self) -> np.ndarray:
        """First log probabilities, by the vocabulary's order: early pieces are the frequent ones."""
        p = 1.0 / (np.arange(self.size) + 50.0)
        return np.log(p / p.sum())

    def edges(self, codes: np.ndarray) -> dict[int, list[tuple[int, np.ndarray, np.ndarray]]]:
        """For words of one length (a row of code points each): by end, (start, words, pieces). Code points that no
        piece covers get no edge here."""
        m, n = codes.shape
        out: dict[int, list] = {j: [] for j in range(1, n + 1)}
        for i in range(n):
            rows, h = np.arange(m), np.zeros(m, np.uint64)
            for j in range(i, n):
                h = h * np.uint64(0x100000001B3) + codes[rows, j].astype(np.uint64) + np.uint64(1)
                on = self.begins[_slot(h, 0)]
                rows, h = rows[on], h[on]
                if not len(rows):
                    break
                hit, at = self.pieces.find(h)
                if len(hit):
                    out[j + 1].append((i, rows[hit], self.ids[at]))
        return out

    def spelled(self, codes: np.ndarray, edges: dict, logp: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(position, word, byte pieces) of the code points that only bytes can spell."""
        m, n = codes.shape
        out = []
        for j in range(n):
            lone = np.ones(m, bool)
            for i, rows, _ in edges[j + 1]:
                if i == j:
                    lone[rows] = False
            for w in np.flatnonzero(lone):
                out.append((j, int(w), self.bytes[np.frombuffer(chr(codes[w, j]).encode("utf-8", "replace"), np.uint8)]))
        return out

    def run(self, codes: np.ndarray, logp: np.ndarray, weight: np.ndarray | None, counts: np.ndarray | None) -> np.ndarray:
        """Marginal log probability of each word; with counts, adds what is expected of each piece to them."""
        m, n = codes.shape
        edges = self.edges(codes)
        bytes_at: dict[int, list] = {}
        for j, w, pieces in self.spelled(codes, edges, logp):
            bytes_at.setdefault(j, []).append((w, pieces, float(logp[pieces].sum())))
        a = np.full((n + 1, m), -np.inf)
        a[0] = 0.0
        for j in range(1, n + 1):
            for i, rows, ids in edges[j]:
                a[j, rows] = np.logaddexp(a[j, rows], a[i, rows] + logp[ids])
            for w, _, lp in bytes_at.get(j - 1, ()):
                a[j, w] = np.logaddexp(a[j, w], a[j - 1, w] + lp)
        if counts is None:
            return a[n]
        b = np.full((n + 1, m), -np.inf)
        b[n] = 0.0
        for j in range(n, 0, -1):
            for i, rows, ids in edges[j]:
                step = logp[ids] + b[j, rows]
                b[i, rows] = np.logaddexp(b[i, rows], step)
                counts += np.bincount(ids, np.exp(a[i, rows] + step - a[n, rows]) * weight[rows], self.size)
            for w, pieces, lp in bytes_at.get(j - 1, ()):
                b[j - 1, w] = np.logaddexp(b[j - 1, w], lp + b[j, w])
                np.add.at(counts, pieces, np.exp(a[j - 1, w] + lp + b[j, w] - a[n, w]) * weight[w])
        return a[n]

    def words(self, words: list[str], logp: np.ndarray, weight: np.ndarray | None = None, counts: np.ndarray | None = None) -> np.ndarray:
        """Log probabilities of words, handled together by length."""
        marked = ["\u2581" + w for w in words]
        length = np.fromiter(map(len, marked), np.int64, len(marked))
        out = np.zeros(len(words))
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            for k in range(0, len(at), max(1, 200_000 // int(n))):
                part = at[k : k + max(1, 200_000 // int(n))]
                raw = "".join(marked[i] for i in part).encode("utf-32-le", "replace")
                codes = np.frombuffer(raw, np.uint32).reshape(len(part), n)
                out[part] = self.run(codes, logp, None if weight is None else weight[part], counts)
        return out


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, word, train, total) of the words of (held_out, text) rows."""
    held: list[tuple[np.ndarray, ...]] = []
    rows_held = rows_new = 0

    def merged() -> tuple[np.ndarray, ...]:
        h, train, total, names = map(np.concatenate, zip(*held))
        every, at, back = np.unique(h, return_index=True, return_inverse=True)
        return every, *(np.bincount(back, n, len(every)).astype(np.int64) for n in (train, total)), names[at]

    def rows() -> Iterator[pa.RecordBatch]:
        hashes, train, total, names = merged()
        for i in range(0, len(hashes), 20_000):
            s = slice(i, i + 20_000)
            words = pa.array(names[s], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(hashes[s].view(np.int64)), words, pa.array(train[s]), pa.array(total[s])], ["hash", "word", "train", "total"])

    for batch in batches:
        kept_out = batch.column(0).to_numpy(zero_copy_only=False)
        for words in words_of(batch.column(1), lower=True):
            h, first, which, n = np.unique(words.hash, return_index=True, return_inverse=True, return_counts=True)
            learnt = np.bincount(which, ~kept_out[words.first + words.doc], len(h)).astype(np.int64)
            raw = words.data.tobytes()
            text = np.empty(len(h), object)
            text[:] = [raw[a:b] for a, b in zip(words.start[first].tolist(), words.end[first].tolist())]
            held.append((h, learnt, n, text))
            rows_new += len(h)
            if rows_new >= max(rows_held, 1 << 16):  # merging at each doubling costs little a word
                held = [merged()]
                rows_held, rows_new = len(held[0][0]), 0
                if rows_held >= GATHERED:
                    yield from rows()
                    held, rows_held = [], 0
    if held:
        yield from rows()


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Consecutive batches as tables of about TOGETHER rows: words are short, and longer columns cost less a word."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= TOGETHER:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def train_model(words: DataFrame, lattice: Lattice, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces, from a table of (word, train). What comes to the driver is one number per
    piece of the vocabulary."""
    logp = lattice.start()
    seen = words.where("train > 0").select("word")
    for _ in range(rounds):
        now = logp

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = None
            for part in _together(batches):
                counts = np.zeros(lattice.size) if counts is None else counts
                lattice.words(part.column(0).to_pylist(), now, np.ones(part.num_rows), counts)
            if counts is not None:
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["piece", "weight"])

        got = seen.mapInArrow(expect, "piece int, weight double").groupBy("piece").agg(F.sum("weight").alias("weight")).collect()
        if not got:
            break
        counts = np.full(lattice.size, PRIOR)
        for piece, weight in got:
            counts[piece] += weight
        logp = np.log(counts / counts.sum())
    return logp


def score_texts(docs: DataFrame, vocabulary: str | None = None, text: str = "text", id_col: str = "doc_id", modulus: int = 10,
                hot: int = HOT, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, text_score and
    lattice_score (all log10)."""
    path = vocabulary or default_vocabulary()
    source = docs.select(docs[id_col].alias("doc_id"), (crc_mod(id_col, modulus) == 0).alias("held_out"), docs[text].alias("text"))
    gathered = source.select("held_out", "text").mapInArrow(_gather, "hash long, word string, train long, total long")
    words = checkpointed(
        gathered.groupBy("hash", "word").agg(F.sum("train").alias("train"), F.sum("total").alias("total"))
    )
    n_train = source.where(~F.col("held_out")).count()
    tokens, kinds, once, twice = words.agg(
        F.coalesce(F.sum("train"), F.lit(0)), F.count_if(F.col("train") > 0), F.count_if(F.col("train") == 1), F.count_if(F.col("train") == 2)
    ).first()
    tokens, kinds = tokens + n_train, kinds + (n_train > 0)
    discount = min(0.9, max(0.1, once / max(1, once + 2 * twice)))
    lattice = Lattice(path)  # of the vocabulary's size, whatever the input
    logp = train_model(words, lattice, rounds)
    end = (n_train + END) / (tokens + 1)
    going_on = float(np.log(1 - end))  # a word, and not the end

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _together(batches):
            spelled = (lattice.words(part.column(1).to_pylist(), logp) + going_on) / _LN10
            yield from part.select(["hash", "train", "total"]).append_column("spelled", pa.array(spelled)).to_batches()

    scored = checkpointed(words.mapInArrow(weigh, "hash long, train long, total long, spelled double"))
    below = float(np.log10(tokens + 0.1 * (kinds + 1)))
    saved = float(np.log10(discount * kinds / tokens)) if tokens else 0.0

    def mixed(train: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """log10 of the arc over the whole word and its pieces together."""
        spelled = spelled + saved
        whole = np.maximum(train - discount, 0) / max(tokens, 1)
        return np.where(train > 0, np.log10(np.where(train > 0, whole, 1) + 10.0**spelled), spelled)

    spelling = F.col("spelled") + saved
    both = F.when(F.col("train") > 0, F.log10((F.col("train") - discount) / max(tokens, 1) + F.pow(F.lit(10.0), spelling))).otherwise(spelling)
    # What the lattice leaves to unknown words: they are one type in score.
    spelled_known = scored.where("train > 0").agg(F.coalesce(F.sum(F.pow(F.lit(10.0), "spelled")), F.lit(0.0))).first()[0]
    unknown = float(np.log10(max(1 - end - spelled_known, 1e-9))) + saved

    # The lowest count that at most ``hot`` words reach, from a histogram of counts.
    bins = scored.groupBy(F.floor(F.log2("total") * 8).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("total").alias("least"))
    least, held = None, 0
    for _, n, low in sorted(map(tuple, bins.collect()), reverse=True):
        held += n
        if held > hot:
            break
        least = low
    frequent = scored.where(F.col("total") >= least if least is not None else F.lit(False)).select("hash", "train", "spelled").toPandas()
    frequent = frequent.sort_values("hash")
    key, known, pieces = (frequent[c].to_numpy() for c in ("hash", "train", "spelled"))
    base, score = np.log10(known + 0.1) - below, mixed(known, pieces)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column(2), lower=True):
                h = words.hash.view(np.int64)
                at = np.minimum(np.searchsorted(key, h), max(len(key) - 1, 0))
                hit = key[at] == h if len(key) else np.zeros(len(h), bool)
                doc, where = words.doc[hit], at[hit]
                add = lambda v: np.bincount(doc, v, words.docs).astype(float)  # noqa: E731; of no words at all it counts in integers
                cold, row = h[~hit], words.doc[~hit]
                cut = np.searchsorted(row, np.arange(words.docs + 1)).astype(np.int32)
                ids = batch.column(0).slice(words.first, words.docs), batch.column(1).slice(words.first, words.docs)
                values = [words.counts() + 1, add(known[where] > 0).astype(np.int64), add(base[where]), add(score[where]), add(np.where(known[where] > 0, score[where], 0.0)), add(pieces[where])]
                rest = pa.ListArray.from_arrays(pa.array(cut), pa.array(cold))
                yield pa.RecordBatch.from_arrays([*ids, *map(pa.array, values), rest], ["doc_id", "held_out", "n_tokens", "known", "base", "score", "seen", "pieces", "rest"])

    kind = source.schema["doc_id"].dataType.simpleString()
    first = source.mapInArrow(look_up, f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, seen double, pieces double, rest array<bigint>")
    first = checkpointed(first.withColumn("_row", F.monotonically_increasing_id()))
    rare = first.select("_row", F.explode("rest").alias("hash")).join(scored.select("hash", "train", "spelled"), "hash")
    rare = rare.groupBy("_row").agg(
        F.sum((F.col("train") > 0).cast("long")).alias("k"),
        F.sum(F.log10(F.col("train") + 0.1) - below).alias("b"),
        F.sum(both).alias("s"),
        F.sum(F.when(F.col("train") > 0, both).otherwise(0.0)).alias("w"),
        F.sum("spelled").alias("p"),
    )
    end_base = float(np.log10(n_train + 0.1)) - below
    end_score = float(np.log10(max(n_train - discount, 0) / max(tokens, 1) + 10.0**saved * end))
    unseen = F.col("n_tokens") - 1 - F.col("known") - F.coalesce("k", F.lit(0))
    zero = F.lit(0.0)
    return first.join(rare, "_row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("k", F.lit(0)) + int(n_train > 0)).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero) + end_base).alias("base_score"),
        (F.col("seen") + F.coalesce("w", zero) + unseen * unknown + end_score).alias("score"),
        (F.col("score") + F.coalesce("s", zero) + end_score).alias("text_score"),
        (F.col("pieces") + F.coalesce("p", zero) + float(np.log10(end))).alias("lattice_score"),
    )


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
