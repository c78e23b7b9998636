"""Byte-pair encoding through a table of distinct words, and decoding through an id-to-piece table.

Words are split in Spark tasks, block by block; a block is at most BLOCK_BYTES
of consecutive texts. Each block lists its distinct words once and keeps, in
place of its texts, the number of the word at every position. The lists are
dealt to buckets by the words' hashes, so that all lists of a bucket meet in
one task, where each distinct word of the whole input is encoded exactly once.
The ids return to the blocks by bucket and place, where the numbers at the
positions are replaced with them. Neither texts nor single words are shuffled:
a row is a block's share of a bucket, or about PACKED_BYTES of its positions. A
bucket holds one entry a block of each of its words, however frequent, so no
word makes a hot key. Memory is a block or a bucket at a time, whatever the input.

Numbers and lists are cut once and checkpointed, so a lost executor repeats
its own blocks only.

The split is finer than the tokenizer's needs: at white space, and between an
ASCII letter or digit and ASCII punctuation other than the apostrophe. The
tokenizer never merges, normalises or matches across such a place. Words of a
text that holds ``<|``, which opens the special tokens, are left whole and in
their case. Words are told apart by 64-bit hashes inside a block.

Defined results: a null text is empty and has no ids; repeated rows are encoded
like any others; null ids stay null; an empty table gives an empty result;
further columns pass through, whatever their names; ties do not occur. A very
long text is a block of its own and is held whole by one worker, with about 60
bytes of memory for each of its words.

Ids can be decoded where they are put together, so a round trip that only
needs digests hands on neither ids nor texts.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .arrays import _BASE, _BYTE, _UNBASE, LOWER, SPACE, _powers, _room, give_back, mix, slices
from .common import checkpointed, table

#: Raw text that shares one list of words.
BLOCK_BYTES = 16 << 20
#: Raw text whose positions make one row: rows this small are no large objects to the executors' memory management.
PACKED_BYTES = 1 << 20
#: Buckets of words for each shuffle partition.
BUCKETS = 4
#: Words that the tokenizer gets at once.
ENCODED_WORDS = 5_000
#: What encoding can return, and its types. Digests are of the ids as little-endian unsigned 32-bit integers, and of
#: the decoded text in UTF-8.
OUTPUTS = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}
#: Ids whose pieces are laid out at once.
DECODED_IDS = 1 << 18

_ALNUM = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _ALNUM[_a:_b] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[33:127] = ~_ALNUM[33:127]
_PUNCT[ord("'")] = False


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _load(path: str):
    """One tokenizer for all tasks of a worker: each that is loaded leaves memory behind in every thread it ran on."""
    # Tasks are the parallelism; more threads in a worker would only keep memory of their own.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return _loaded(path, os.stat(path).st_mtime_ns)


@lru_cache(1)
def _loaded(path: str, changed: int):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _marked(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which bytes belong to a text that holds ``<|``; empty if none does."""
    at = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    text = np.searchsorted(offsets, at, "right") - 1
    text = text[at + 1 < offsets[text + 1]]
    if not len(text):
        return np.zeros(0, bool)
    has = np.zeros(len(offsets) - 1, bool)
    has[text] = True
    return np.repeat(has, np.diff(offsets))


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, text row, hash) of the words to encode."""
    marked = _marked(data, offsets)
    data = np.where(marked, data, LOWER[data]) if len(marked) else LOWER[data]
    full = offsets[1:] > offsets[:-1]
    word = ~SPACE[data]
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    if len(data) > 1:
        alnum, punct = _ALNUM[data], _PUNCT[data]
        cut = (alnum[:-1] & punct[1:]) | (punct[:-1] & alnum[1:])
        if len(marked):
            cut &= ~marked[1:]
        starts[1:] |= cut
        ends[:-1] |= cut
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    starts[first] = word[first]
    ends[last] = word[last]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_room(n), _BASE)[:n], out=sums[1:])
    value = (sums[end] - sums[start]) * _powers(_room(n), _UNBASE)[start]
    return data, start, end, np.searchsorted(offsets, start, "right") - 1, mix(value + (end - start).astype(np.uint64))


def _blocks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[list[pa.RecordBatch]]:
    """Cut a partition's rows into blocks."""
    held, block = 0, []
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            fit = int(np.searchsorted(np.cumsum(sizes[at:]), BLOCK_BYTES - held, "right"))
            if fit == 0 and held:
                yield block
                held, block = 0, []
                continue
            fit = max(1, fit)
            held += int(sizes[at : at + fit].sum())
            block.append(batch.slice(at, fit))
            at += fit
    if block:
        yield block


def _lines(data: np.ndarray, start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Words one after the other, each with the line end after it, which no word holds and ``width`` counts."""
    to = np.cumsum(width)
    source = np.arange(to[-1] if len(to) else 0) - np.repeat(to - width - start, width)
    joined = data[np.minimum(source, max(len(data) - 1, 0))]
    joined[to - 1] = ord("\n")
    return joined


def _slice_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, count, width, lines) of a slice's distinct words by hash, and which of them stands at each position.

    A block keeps this of a slice, in place of its text and an entry of some 20 bytes for each position.
    """
    distinct, at, number, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    width = end[at] - start[at] + 1
    kind = np.uint16 if len(distinct) <= 1 << 16 else np.uint32
    return distinct, count.astype(np.uint32), width.astype(np.uint32), _lines(data, start[at], width), number.astype(kind)


def _word_lists(h: np.ndarray, count: np.ndarray, width: np.ndarray, data: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, bytes]], bytes]:
    """Numbers of the slices' distinct words, (bucket, words) of the block's, and how these fall into ranks.

    Distinct words are ranked by the powers of two in their counts, frequent ones first, and numbered by rank, then by
    hash: frequent words have small numbers, which pack well. Buckets are ranges of hashes, and a bucket's words come by
    rank, then by hash; so the numbers follow from how many words of each rank each bucket has.
    """
    distinct, at, number = np.unique(h, return_index=True, return_inverse=True)
    power = np.frexp(np.bincount(number, count, len(distinct)))[1] - 1
    rank = (power.max() if len(power) else 0) - power
    numbers = np.empty(len(distinct), np.uint32)
    numbers[np.argsort(rank, kind="stable")] = np.arange(len(distinct))
    bucket = ((distinct >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    at = at[np.lexsort((rank, bucket))]
    start, width = (np.cumsum(width, dtype=np.int64) - width)[at], width[at].astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    packer = zstandard.ZstdCompressor(level=9)
    lists = [(int(bucket[a]), packer.compress(_lines(data, start[a:b], width[a:b])[:-1].tobytes())) for a, b in zip(edges, edges[1:])]
    ranks = int(rank.max()) + 1 if len(rank) else 1
    shape = np.bincount(np.cumsum(np.diff(bucket, prepend=bucket[:1]) > 0) * ranks + rank, minlength=ranks * max(len(lists), 1))
    return numbers[number], lists, packer.compress(np.append(ranks, shape).astype("<u4").tobytes())


def _numbered(shape: bytes) -> np.ndarray:
    """For each number, the place of its word when all lists of a block stand one after the other."""
    values = np.frombuffer(zstandard.ZstdDecompressor().decompress(shape), "<u4")
    ranks, counts = int(values[0]), values[1:]
    return np.argsort(np.repeat(np.tile(np.arange(ranks, dtype=np.uint8), len(counts) // ranks), counts), kind="stable")


def _pack(kept: pa.RecordBatch, numbers: np.ndarray) -> bytes:
    """Rows and numbers, compressed; the numbers byte by byte, since their high bytes are mostly alike."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, kept.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))) as writer:
        writer.write_batch(kept)
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    head = sink.getvalue().to_pybytes()
    return len(head).to_bytes(8, "little") + head + zstandard.ZstdCompressor(level=9).compress(planes.tobytes())


def _unpack(blob: bytes) -> tuple[pa.RecordBatch, np.ndarray]:
    cut = 8 + int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[cut:]), np.uint8).reshape(4, -1)
    return next(iter(pa.ipc.open_stream(blob[8:cut]))), np.ascontiguousarray(planes.T).view("<u4").ravel()


#: Places of words are their buckets; the next one is that of the ranks, and from _ROWS on are those of positions.
_ROWS = 1 << 30
_SHAPE = _ROWS - 1


def _cut(text: int, buckets: int):
    """(block, at, data): a block's words by bucket, and its rows with the words' numbers in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 24
        for block in _blocks(batches, text):
            found, places, rows = [], [], []
            while block:
                batch = block.pop(0)
                for first, data, offsets in slices(batch.column(text)):
                    data, start, end, doc, h = _pieces(data, offsets)
                    *words, place = _slice_words(data, start, end, h)
                    found.append(words)
                    places.append(place)
                    keep = batch.slice(first, len(offsets) - 1).select([*range(text)])
                    rows.append((keep, np.bincount(doc, minlength=len(offsets) - 1), len(data)))
            entry = np.cumsum([0, *[len(f[0]) for f in found]])
            words = [np.concatenate(x) for x in zip(*found)]
            del batch, data, start, end, doc, h, found
            numbers, lists, shape = _word_lists(*words, buckets)
            del words
            out = [*lists, (_SHAPE, shape)]
            for at, portion in enumerate(_portions([r[2] for r in rows])):
                count = np.concatenate([rows[i][1] for i in portion])
                keep = pa.concat_batches([rows[i][0] for i in portion]).columns if text else []
                kept = pa.RecordBatch.from_arrays([*keep, pa.array(count)], [f"_c{i}" for i in range(text + 1)])
                out.append((_ROWS + at, _pack(kept, np.concatenate([numbers[entry[i] : entry[i + 1]][places[i]] for i in portion]))))
            named = pa.array([p for p, _ in out], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), name)), named, pa.array([d for _, d in out], pa.binary())], ["block", "at", "data"])
            name += 1
            del numbers, places, lists, rows, out
            give_back()

    return run


def _portions(sizes: list[int]) -> Iterator[list[int]]:
    """Consecutive slices of about PACKED_BYTES together."""
    part, held = [], 0
    for i, size in enumerate(sizes):
        if part and held + size > PACKED_BYTES:
            yield part
            part, held = [], 0
        part.append(i)
        held += size
    if part:
        yield part


def _id_type(tokenizer) -> np.dtype:
    return np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")


def _encode_words(path: str):
    """Ids, in the fewest bytes that hold them, in place of words; rows come bucket by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, now, known = None, None, {}
        packer, opener = zstandard.ZstdCompressor(level=9), zstandard.ZstdDecompressor()
        for batch in batches:
            if tokenizer is None:
                tokenizer = _load(path)
                kind = _id_type(tokenizer)
                size = kind.itemsize
            out = []
            for bucket, data in zip(batch.column(1).to_pylist(), batch.column(2)):
                if bucket != now:
                    now, known = bucket, {}
                words = opener.decompress(data.as_py()).decode().split("\n")
                fresh = [w for w in words if w not in known]
                for i in range(0, len(fresh), ENCODED_WORDS):
                    some = fresh[i : i + ENCODED_WORDS]
                    for w, coded in zip(some, tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                        known[w] = np.array(coded.ids, kind).tobytes()
                ids = [known[w] for w in words]
                width = np.fromiter(map(len, ids), np.int64, len(ids)) // size
                out.append(packer.compress(np.append(len(ids), width).astype("<u4").tobytes() + b"".join(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["block", "at", "data"])
        known = words = fresh = some = ids = width = out = None
        give_back()

    return run


def _piece_table(path: str) -> pa.Array:
    """The piece of each id: one row per vocabulary entry, whatever the input."""
    t = _load(path)
    return pa.array([t.id_to_token(i) or "" for i in range(t.get_vocab_size())], pa.string())


def _joined(pieces: pa.Array):
    """A function from lists of ids (their edges and values) to their texts, in parts. Pieces are joined as the
    tokenizer's own decode joins them when it has no decoder: with single spaces."""

    def run(edges: np.ndarray, ids: pa.Array) -> Iterator[pa.Array]:
        at = 0
        while at < len(edges) - 1:
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + DECODED_IDS, "right")) - 1)
            some = pieces.take(ids.slice(edges[at], edges[to] - edges[at]))
            lists = pa.ListArray.from_arrays(pa.array((edges[at : to + 1] - edges[at]).astype(np.int32)), some)
            yield pc.binary_join(lists, " ")
            at = to

    return run


def _hexes(data: memoryview, edges: np.ndarray) -> pa.Array:
    cut = edges.tolist()
    return pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(cut, cut[1:])], pa.string())


def _place(path: str, outputs: tuple[str, ...], schema: pa.Schema):
    joined = _joined(_piece_table(path)) if {"decoded", "decoded_sha256"} & set(outputs) else None
    kind = _id_type(_load(path))

    def columns(ids: np.ndarray, cut: np.ndarray) -> dict[str, pa.Array]:
        made = {"n_tokens": pa.array(np.diff(cut))}
        if "ids" in outputs:
            made["ids"] = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids.astype(np.int32)))
        if "ids_sha256" in outputs:
            made["ids_sha256"] = _hexes(memoryview(ids.astype("<u4")).cast("B"), 4 * cut)
        if joined:
            texts, digests = [], []
            for part in joined(cut, pa.array(ids.astype(np.int32))):
                if "decoded" in outputs:
                    texts.append(part)
                if "decoded_sha256" in outputs:
                    digests += [hashlib.sha256(x.as_buffer()).hexdigest() for x in part]
            made["decoded"] = pa.chunked_array(texts, pa.string()).combine_chunks()
            made["decoded_sha256"] = pa.array(digests, pa.string())
        return made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come block by block, ids of the words before the positions that they go to."""
        opener = zstandard.ZstdDecompressor()
        now, widths, ids_of = None, [], []
        for batch in batches:
            for name, place, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if name != now:
                    now, widths, ids_of = name, [], []
                if place < _SHAPE:
                    raw = opener.decompress(data.as_py())
                    many = int.from_bytes(raw[:4], "little")
                    widths.append(np.frombuffer(raw, "<u4", many, 4))
                    ids_of.append(np.frombuffer(raw, kind, -1, 4 * (many + 1)))
                elif place == _SHAPE:
                    order = _numbered(data.as_py())
                    width = np.concatenate([np.zeros(0, np.int64), *widths]).astype(np.int64)
                    flat = np.concatenate([np.zeros(0, kind), *ids_of])
                    begin, width = (np.cumsum(width) - width)[order], width[order]
                    widths, ids_of = [], []
                else:
                    kept, numbers = _unpack(data.as_py())
                    count = width[numbers]
                    to = np.append(0, np.cumsum(count))
                    ids = flat[np.arange(to[-1]) - np.repeat(to[:-1] - begin[numbers], count)]
                    made = columns(ids, to[np.append(0, np.cumsum(kept.column(kept.num_columns - 1).to_numpy()))])
                    col = [*kept.columns[:-1], *[made[c] for c in outputs]]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(col, schema)], schema=schema)
        give_back()

    return run


def encode(docs: DataFrame, tokenizer: str | None = None, text: str = "text", outputs: tuple[str, ...] = ("ids",), carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (all by default) and those of OUTPUTS that are asked for."""
    path = tokenizer or default_tokenizer()
    carry = docs.columns if carry is None else carry
    spark = docs.sparkSession
    frame = docs.select(*[docs[c].alias(f"_c{i}") for i, c in enumerate(carry)], docs[text].alias("_text"))
    at = len(carry)
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = checkpointed(frame.mapInArrow(_cut(at, buckets), "block long, at int, data binary"))
    is_words = F.col("at") < _SHAPE
    lists = cut.where(is_words).repartition("at").sortWithinPartitions("at")
    coded = lists.mapInArrow(_encode_words(path), "block long, at int, data binary")
    together = coded.unionByName(cut.where(~is_words)).repartition("block").sortWithinPartitions("block", "at")
    kinds = [f"_c{i} {frame.schema[f'_c{i}'].dataType.simpleString()}" for i in range(at)]
    out_schema = spark.createDataFrame([], ", ".join([*kinds, *[f"{c} {OUTPUTS[c]}" for c in outputs]])).schema
    placed = together.mapInArrow(_place(path, outputs, to_arrow_schema(out_schema)), out_schema)
    return placed.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], *outputs)


def decode(coded: DataFrame, tokenizer: str | None = None, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all others by default) and the text of the ids."""
    path = tokenizer or default_tokenizer()
    keep = [c for c in coded.columns if c != ids] if keep is None else keep
    frame = coded.select(*[coded[c].alias(f"_c{i}") for i, c in enumerate(keep)], coded[ids].alias("_ids"))

    joined = _joined(_piece_table(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(batch.num_columns - 1)
            edges = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)))
            at = 0
            for text in joined(edges, col.flatten()):
                part = batch.slice(at, len(text))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], text], [*part.schema.names[:-1], "_out"])
                at += len(text)

    kinds = [f"_c{i} {frame.schema[f'_c{i}'].dataType.simpleString()}" for i in range(len(keep))]
    done = frame.mapInArrow(run, ", ".join([*kinds, "_out string"]))
    return done.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], F.col("_out").alias(out))


def token_table(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, ids, and the digest of what the ids decode to, of every document."""
    outputs = ("n_tokens", "ids_sha256", "ids", "decoded_sha256")
    return encode(docs, tokenizer, text, outputs, [id_col]).select(F.col(id_col).alias("doc_id"), *outputs)


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"), carry=["doc_id"])
