"""Alignment of two tokenizers' tokens over the same bytes, and links between the tokens of a group.

The bytes are a space and the text. Byte offsets where tokens of both end cut
both sequences into groups; every token of one side is linked with every token
of the other in its group.

The alignment itself is relational (``align``): tokens are exploded with their
positions, a window sums their lengths to ends, an equi-join on unit and end
finds the shared ends, a window over these counts the cuts before each token,
which numbers its group, and tokens of one group are brought together.

It runs over distinct units instead of documents. A unit is a stretch between
places that both tokenizers always cut: before a single space between visible
characters, around a line end, and between a letter or digit and punctuation
that the piece vocabulary never joins. The rules follow from the first one's
split pattern and the second one's pieces (``Cuts``), and a rule that does not
hold is not used; at worst a unit is a document. So each different unit is
encoded and aligned once, and a document is a sequence of unit numbers: blocks
of texts list their distinct units and keep the numbers at all positions, the
lists are dealt to buckets by the units' hashes, and what is found for the units
returns to the blocks. No text and no single token of a document is shuffled,
and no unit makes a hot key.

How often a pair of ids is linked counts documents. Blocks count their own
documents, then the counts are summed. A unit's counts follow by a join of its
links with these sums, and a document's are sums over its units.

Defined results: a null or empty text, or one whose pieces do not give its bytes
back, has no tokens: zeros and an empty digest, and its pairs do not count;
repeated rows, null and repeated ids are rows like any others; an empty table
gives an empty result; further columns pass through on request, whatever their
names; all links that tie for an id's highest count are best; a very long text
is a block of its own, held whole by one task. A unit without any cut, such as a
very long word, is one key of the windows.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .arrays import give_back, slices
from .bpe_codec import _ROWS, BUCKETS, _blocks, _pack, _portions, _unpack
from .common import bounded, checkpointed, table
from .tables import stored

#: A pair of ids is a * PAIR + b.
PAIR = 1 << 20
#: Pairs that are broadcast at most.
FEW_PAIRS = 1_000_000
#: Units that the tokenizers get at once.
ENCODED = 5_000
#: What a unit's facts are called; all but the links are summed or joined for a document.
SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _load(a_path: str, b_path: str):
    # Tasks are the parallelism; more threads in a worker would only keep memory of their own.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(a_path)
    a.no_truncation()
    a.no_padding()
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=b_path)


def _piece_bytes(b) -> list[bytes | None]:
    """The bytes of each piece; None for those that stand for no text."""
    out: list[bytes | None] = []
    for i in range(b.get_piece_size()):
        if b.is_byte(i):
            out.append(bytes([int(b.id_to_piece(i)[3:5], 16)]))
        else:
            out.append(None if b.is_control(i) or b.is_unknown(i) else b.id_to_piece(i).replace("▁", " ").encode())
    return out


@dataclass(frozen=True)
class Cuts:
    """Which places both tokenizers always cut."""

    spaces: bool
    lines: bool
    punctuation: bytes

    @staticmethod
    def of(a_path: str, b_path: str) -> Cuts:
        a, b = _load(a_path, b_path)
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size()) if not (b.is_byte(i) or b.is_control(i) or b.is_unknown(i))]
        by_pattern = a.normalizer is None and '"type":"ByteLevel"' in (kind := a.pre_tokenizer.__getstate__().decode()) and '"use_regex":true' in kind
        letters = [chr(c) for c in range(128) if chr(c).isalnum()] + [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]
        joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        free = bytes(c for c in range(33, 127) if not chr(c).isalnum() and not any(x + chr(c) in joined for x in letters))
        return Cuts(by_pattern and not any(x[1] == "▁" != x[0] for x in joined), by_pattern and not any("\n" in p for p in pieces), free if by_pattern else b"")

    def at(self, data: np.ndarray) -> np.ndarray:
        """Whether a unit starts at each byte of texts that stand one after the other, each after its space."""
        cut = np.zeros(len(data), bool)
        if len(data) < 3:
            return cut
        visible = (data > 0x20) & (data < 0x7F)
        two = np.zeros(len(data), bool)  # ends of two-byte letters
        two[1:] = (data[:-1] >= 0xC3) & (data[:-1] <= 0xCB)
        ends, begins = visible | two, visible | ((data >= 0xC3) & (data <= 0xCB))
        if self.spaces:
            cut[1:-1] |= (data[1:-1] == 0x20) & ends[:-2] & begins[2:]
        if self.lines:
            # White space at a unit's end would be split otherwise than before what follows, unless it is one line end.
            cut[1:] |= (data[1:] == 0x0A) & ends[:-1]
            cut[2:] |= (data[1:-1] == 0x0A) & ends[:-2] & begins[2:]
        if self.punctuation:
            sign = np.zeros(256, bool)
            sign[list(self.punctuation)] = True
            alnum = ((data >= 48) & (data < 58)) | ((data >= 65) & (data < 91)) | ((data >= 97) & (data < 123))
            alnum[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
            cut[1:] |= sign[data[1:]] & alnum[:-1]
        return cut


def _units(data: np.ndarray, offsets: np.ndarray, cuts: Cuts) -> tuple[pa.Array, np.ndarray, int]:
    """The units of some texts, how many each text has, and the bytes they came from. An empty text has none."""
    full = np.diff(offsets) > 0
    begin = offsets[:-1][full]
    data = np.insert(data, begin, 0x20)
    begin = begin + np.arange(len(begin))
    cut = cuts.at(data)
    cut[begin] = True
    start = np.flatnonzero(cut)
    count = np.zeros(len(offsets) - 1, np.int64)
    count[full] = np.diff(np.append(np.searchsorted(start, begin), len(start)))
    edges = np.append(start, len(data)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]), count, len(data)


def _ipc(batch: pa.RecordBatch | pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as writer:
        writer.write(batch)
    return sink.getvalue().to_pybytes()


def _un_ipc(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _cut(text: int, buckets: int, cuts: Cuts):
    """(block, at, data): a block's distinct units by bucket, and its rows with the units' numbers in place of the text.
    Frequent units have small numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 24
        for block in _blocks(batches, text):
            parts, rows = [], []
            for batch in block:
                for first, data, offsets in slices(batch.column(text)):
                    units, count, size = _units(data, offsets, cuts)
                    parts.append(units.dictionary_encode())
                    rows.append((batch.select([*range(text)]).slice(first, len(count)), count, size))
            block.clear()  # the texts are no longer needed
            batch = data = units = None
            coded = pa.chunked_array(parts).unify_dictionaries()
            words = coded.chunk(0).dictionary
            codes = np.concatenate([c.indices.to_numpy() for c in coded.chunks])
            del parts, coded
            order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
            number = np.empty(len(words), np.uint32)
            number[order] = np.arange(len(words))
            codes = number[codes]
            bucket = np.fromiter((zlib.crc32(w) * buckets >> 32 for w in words.to_pylist()), np.int64, len(words))
            by = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[by], prepend=-1, append=-1)) if len(by) else []
            out, done = [], 0
            for a, b in zip(edges, edges[1:]):
                own = pa.array(by[a:b])
                out.append((int(bucket[by[a]]), _ipc(pa.RecordBatch.from_arrays([pa.array(number[by[a:b]]), words.take(own)], ["number", "word"]))))
            for at, portion in enumerate(_portions([r[2] for r in rows])):
                count = np.concatenate([rows[i][1] for i in portion])
                keep = pa.concat_batches([rows[i][0] for i in portion]).columns if text else []
                kept = pa.RecordBatch.from_arrays([*keep, pa.array(count)], [f"_c{i}" for i in range(text + 1)])
                to = done + int(count.sum())
                out.append((_ROWS + at, _pack(kept, codes[done:to])))
                done = to
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), name)), pa.array([p for p, _ in out], pa.int32()), pa.array([d for _, d in out], pa.binary())], ["block", "at", "data"])
            name += 1
            rows = codes = out = words = order = number = bucket = by = keep = kept = own = count = None
            give_back()

    return run


def _encode(words: list[bytes], a, b, pieces: list[bytes | None]) -> tuple[list, list]:
    """Ids of both tokenizers for each unit; None where the pieces do not give the unit's bytes back."""
    texts = [w.decode() for w in words]
    first = [x.ids for x in a.encode_batch_fast(texts, add_special_tokens=False)]
    # The second tokenizer puts a space before what it gets. A unit that starts otherwise follows a line end, and both
    # are taken off again.
    second = b.encode([t[1:] if t[0] == " " else "\n" + t for t in texts], num_threads=1)
    second = [ids if t[0] == " " else ids[2:] for t, ids in zip(texts, second)]
    for i, (w, ids) in enumerate(zip(words, second)):
        got = [pieces[x] for x in ids]
        if None in got or b"".join(got) != w:
            first[i] = second[i] = None
    return first, second


def _name(a_path: str, b_path: str):
    """Rows come bucket by bucket: each list gets its units' numbers in the bucket, each new unit a row with its ids."""
    schema = pa.schema([("block", pa.int64()), ("at", pa.int32()), ("data", pa.binary()), ("uid", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, loaded = None, {}, None
        for batch in batches:
            loaded = loaded or _load(a_path, b_path)
            a, b = loaded
            pieces = _piece_bytes(b)
            for block, at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if at != now:
                    now, known = at, {}
                own = _un_ipc(data.as_py())
                words = own.column("word").to_pylist()
                before = len(known)
                ns = [known.setdefault(w, len(known)) for w in words]
                data = _ipc(pa.RecordBatch.from_arrays([own.column("number").combine_chunks(), pa.array(ns, pa.int32())], ["number", "n"]))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([at], pa.int32()), pa.array([data], pa.binary()), *[pa.nulls(1, f.type) for f in list(schema)[3:]]], schema=schema)
                fresh = [w for w, n in zip(words, ns) if n >= before]
                for i in range(0, len(fresh), ENCODED):
                    some = fresh[i : i + ENCODED]
                    first, second = _encode(some, a, b, pieces)
                    uid = pa.array(np.arange(before + i, before + i + len(some), dtype=np.int64) + (at << 32))
                    yield pa.RecordBatch.from_arrays([*[pa.nulls(len(some), f.type) for f in list(schema)[:3]], uid, pa.array(first, pa.list_(pa.int32())), pa.array(second, pa.list_(pa.int32()))], schema=schema)
            batch = own = words = ns = fresh = some = first = second = None
        # Workers live on beside other stages: nothing of the tokenizers may stay.
        known = loaded = a = b = pieces = uid = data = None
        give_back()

    return run


def token_lengths(spark: SparkSession, a_path: str, b_path: str) -> DataFrame:
    """(side, id, len in bytes) of both vocabularies: a row an entry, whatever the input."""
    a, b = _load(a_path, b_path)
    rows = [("a", i, len(a.id_to_token(i) or "")) for i in range(a.get_vocab_size())] + [("b", i, len(x or b"")) for i, x in enumerate(_piece_bytes(b))]
    side, ids, size = zip(*rows)
    return spark.createDataFrame(pa.table({"side": pa.array(side), "id": pa.array(ids, pa.int32()), "len": pa.array(size, pa.int32())}))


def align(units: DataFrame, lengths: DataFrame, key: str = "uid") -> DataFrame:
    """(key, grp, a ids, b ids) of each group, from units (key, a, b) with both sides' ids and the ids' lengths (side, id,
    len). Keys are dealt out once; all windows and joins are within a key."""
    dealt = units.where("a IS NOT NULL").repartition(key)
    tokens = dealt.select(key, F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("ids")), F.struct(F.lit("b").alias("side"), F.col("b").alias("ids")))).alias("_s"))
    tokens = tokens.select(key, "_s.side", F.posexplode("_s.ids").alias("pos", "id")).join(F.broadcast(lengths), ["side", "id"])
    in_order = Window.partitionBy(key, "side").orderBy("pos")
    tokens = tokens.withColumn("end", F.sum("len").over(in_order)).select(key, "side", "pos", "id", "end")
    one, two = tokens.where("side = 'a'").select(key, "end"), tokens.where("side = 'b'").select(key, "end")
    shared = one.join(two, [key, "end"]).withColumn("_cut", F.lit(1))
    marked = tokens.join(shared, [key, "end"], "left")
    before = F.sum("_cut").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("grp", F.coalesce(before, F.lit(0)).cast("int"))

    def ids(side: str):
        own = F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("pos", "id"))))
        return F.transform(own, lambda t: t["id"]).alias(side)

    return marked.groupBy(key, "grp").agg(ids("a"), ids("b"))


def unit_facts(units: DataFrame, groups: DataFrame, key: str = "uid") -> DataFrame:
    """(key, ok, n_a, n_b, n_groups, n_links, groups as text, links as pairs with repeats) of every unit."""
    own = groups.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("grp", "a", "b"))).alias("_g"))
    links = F.flatten(F.transform("_g", lambda g: F.flatten(F.transform(g["a"], lambda x: F.transform(g["b"], lambda y: x.cast("long") * PAIR + y)))))
    text = F.array_join(F.transform("_g", lambda g: F.concat(F.array_join(g["a"].cast("array<string>"), ","), F.lit("|"), F.array_join(g["b"].cast("array<string>"), ","))), ";")
    own = own.select(key, F.size("_g").cast("long").alias("n_groups"), text.alias("groups"), links.alias("links"))
    sizes = units.select(key, F.col("a").isNotNull().alias("ok"), *[F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0).cast("long").alias(f"n_{c}") for c in "ab"])
    both = sizes.join(own, key, "left")
    return both.select(key, "ok", "n_a", "n_b", F.coalesce("n_groups", F.lit(0)).cast("long").alias("n_groups"), F.coalesce(F.size("links"), F.lit(0)).cast("long").alias("n_links"),
                       F.coalesce("groups", F.lit("")).alias("groups"), F.coalesce("links", F.array().cast("array<long>")).alias("links"))


def _hand_out(columns: int):
    """Rows come bucket by bucket, facts in the order of their numbers before the lists that ask for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, facts = None, [], None
        for batch in batches:
            bucket = batch.column(0).to_numpy()
            is_list = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                if bucket[at] != now:
                    now, held, facts = bucket[at], [], None
                if not is_list[at]:
                    to = at + int(np.argmax(np.append((bucket[at:] != now) | is_list[at:], True)))
                    held.append(pa.RecordBatch.from_arrays(batch.slice(at, to - at).columns[4:], [f"f{i}" for i in range(columns)]))
                    at = to
                    continue
                if facts is None:
                    facts = pa.Table.from_batches(held).combine_chunks()
                    held = []
                own = _un_ipc(batch.column(3)[at].as_py())
                out = facts.take(own.column("n")).append_column("number", own.column("number"))
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(at, 1), pa.array([now], pa.int32()), pa.array([_ipc(out.combine_chunks())], pa.binary())], ["block", "at", "data"])
                at += 1
        batch = held = facts = own = out = None
        give_back()

    return run


def _returned(facts: DataFrame, columns: list[str], lists: DataFrame, positions: DataFrame) -> DataFrame:
    """(block, at, data) with the facts of each block's units before its positions, block by block."""
    own = facts.select(F.shiftright("uid", 32).cast("int").alias("bucket"), F.col("uid").bitwiseAND((1 << 32) - 1).cast("long").alias("n"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("data"), *columns)
    asked = lists.select(F.col("at").alias("bucket"), F.lit(1 << 40).cast("long").alias("n"), "block", "data", *[F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in columns])
    rows = own.unionByName(asked).repartition("bucket").sortWithinPartitions("bucket", "n", "block")
    back = rows.mapInArrow(_hand_out(len(columns)), "block long, at int, data binary")
    return back.unionByName(positions).repartition("block").sortWithinPartitions("block", "at")


def _per_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table | None, list[bytes]]]:
    """Facts of a block's units, in the order of their numbers, and its packed positions."""
    now, facts, packed = None, [], []

    def done():
        if not facts:
            return None, packed
        own = pa.concat_tables(facts).combine_chunks()
        return own.take(pa.array(np.argsort(own.column("number").to_numpy()))), packed

    for batch in batches:
        for name, at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if name != now:
                if packed:
                    yield done()
                now, facts, packed = name, [], []
            (packed if at >= _ROWS else facts).append(data.as_py() if at >= _ROWS else _un_ipc(data.as_py()))
    if packed:
        yield done()


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, docs) of each block; facts are ok and links."""
    for facts, packed in _per_block(batches):
        if facts is None:
            continue
        ok, lists = facts.column("f0").to_numpy(), facts.column("f1").combine_chunks()
        edges = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        pairs, code = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        total = np.zeros(len(pairs), np.int64)
        for blob in packed:
            kept, numbers = _unpack(blob)
            count = kept.column(kept.num_columns - 1).to_numpy()
            once = np.unique(np.repeat(np.arange(len(count)), count) * len(ok) + numbers)
            doc, unit = once // len(ok), once % len(ok)
            good = np.ones(len(count), bool)
            good[doc[~ok[unit]]] = False
            doc, unit = doc[good[doc]], unit[good[doc]]
            many = edges[unit + 1] - edges[unit]
            to = np.cumsum(many)
            at = np.arange(to[-1] if len(to) else 0) - np.repeat(to - many - edges[unit], many)
            both = np.unique(np.repeat(doc, many) * max(len(pairs), 1) + code[at])
            total += np.bincount(both % max(len(pairs), 1), minlength=len(pairs))
        found = np.flatnonzero(total)
        facts = packed = lists = edges = code = kept = numbers = once = doc = unit = many = to = at = both = None
        yield from pa.table({"pair": pairs[found], "docs": total[found]}).to_batches(max_chunksize=10_000)
        give_back()


def _sum_up(schema: pa.Schema):
    """A document's sums and digest from its units' facts: ok, the groups' text, and SUMS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for facts, packed in _per_block(batches):
            if facts is not None:
                ok, texts = facts.column("f0").to_numpy(), facts.column("f1").combine_chunks().cast(pa.large_string())
                values = [facts.column(f"f{i + 2}").to_numpy() for i in range(len(SUMS))]
            for blob in packed:
                kept, numbers = _unpack(blob)
                count = kept.column(kept.num_columns - 1).to_numpy()
                edges = np.append(0, np.cumsum(count))
                if facts is None:
                    sums, digests = [np.zeros(len(count), np.int64)] * len(SUMS), [""] * len(count)
                else:
                    good = np.add.reduceat(np.append(~ok[numbers], False), np.minimum(edges[:-1], edges[-1]))
                    good = np.where(count > 0, good == 0, False)
                    sums = [np.diff(np.append(0, np.cumsum(v[numbers]))[edges]) * good for v in values]
                    digests, at = [], 0
                    while at < len(count):
                        to = max(at + 1, int(np.searchsorted(edges, edges[at] + (1 << 17), "right")) - 1)
                        some = texts.take(pa.array(numbers[edges[at] : edges[to]]))
                        lists = pa.ListArray.from_arrays(pa.array((edges[at : to + 1] - edges[at]).astype(np.int32)), some)
                        digests += [hashlib.sha256(t.as_buffer()).hexdigest() if g else "" for t, g in zip(pc.binary_join(lists, pa.scalar(";", pa.large_string())), good[at:to])]
                        at = to
                made = [*kept.columns[:-1], *[pa.array(s) for s in sums], pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, schema)], schema=schema)
            facts = packed = ok = texts = values = kept = numbers = sums = digests = some = lists = made = None
            give_back()

    return run


@dataclass
class Alignment:
    """What ``unit_alignment`` finds: facts of units, the blocks' lists and positions, and how many documents link a pair."""

    facts: DataFrame
    lists: DataFrame
    positions: DataFrame
    pairs: DataFrame
    carried: list[str]


def unit_alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, text: str = "text", carry: list[str] | None = None) -> Alignment:
    """Units of all texts, aligned, and the pairs (pair, a, b, docs documents that hold it linked, best of its a)."""
    default = default_tokenizers() if not (a_path and b_path) else (a_path, b_path)
    a_path, b_path = a_path or default[0], b_path or default[1]
    carry = docs.columns if carry is None else carry
    spark = docs.sparkSession
    frame = docs.select(*[docs[c].alias(f"_c{i}") for i, c in enumerate(carry)], docs[text].cast("string").alias("_text"))
    # As many buckets as the input has parts, so that a bucket's units are no more than a part's.
    buckets = max(BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")), frame.rdd.getNumPartitions())
    cut = checkpointed(frame.mapInArrow(_cut(len(carry), buckets, Cuts.of(a_path, b_path)), "block long, at int, data binary"))
    positions = cut.where(F.col("at") >= _ROWS)
    named = cut.where(F.col("at") < _ROWS).repartition("at").sortWithinPartitions("at", "block")
    named = stored(named.mapInArrow(_name(a_path, b_path), "block long, at int, data binary, uid long, a array<int>, b array<int>"))
    lists, units = named.where("block IS NOT NULL").select("block", "at", "data"), named.where("uid IS NOT NULL").select("uid", "a", "b")
    # Keys that are dealt out by unit stay where they are in joins on unit and end.
    whole = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    try:
        facts = stored(unit_facts(units, align(units, token_lengths(spark, a_path, b_path))))
    finally:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", whole)
    counted = _returned(facts, ["ok", "links"], lists, positions).mapInArrow(_count_pairs, "pair long, docs long")
    counts = checkpointed(counted.groupBy("pair").agg(F.sum("docs").alias("docs"))).withColumn("a", F.floor(F.col("pair") / PAIR))
    most = counts.groupBy("a").agg(F.max("docs").alias("_most"))
    pairs = counts.join(most, "a").select("pair", "a", (F.col("pair") - F.col("a") * PAIR).alias("b"), "docs", (F.col("docs") == F.col("_most")).alias("best"))
    return Alignment(facts, lists, positions, bounded(pairs, FEW_PAIRS), carry)


def aligned_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (all by default), SUMS and groups_sha256 of every document."""
    found = unit_alignment(docs, a_path, b_path, text, carry)
    spark, facts = docs.sparkSession, found.facts
    linked = facts.select("uid", F.explode("links").alias("pair")).join(found.pairs.select("pair", "docs", "best"), "pair")
    scores = linked.groupBy("uid").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("docs").alias("count_sum"))
    full = facts.drop("links").join(scores, "uid", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")})
    kinds = [f"_c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(found.carried)]
    schema = spark.createDataFrame([], ", ".join([*kinds, *[f"{c} long" for c in SUMS], "groups_sha256 string"])).schema
    out = _returned(full, ["ok", "groups", *SUMS], found.lists, found.positions).mapInArrow(_sum_up(to_arrow_schema(schema)), schema)
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(found.carried)], *SUMS, "groups_sha256")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_documents(table(spark, sf_dir, "documents"), carry=["doc_id"])
