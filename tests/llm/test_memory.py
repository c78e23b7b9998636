"""What a worker holds while it cuts texts into blocks, and that blocks of several slices lose no position."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from sylva.llm import bpe_codec


@pytest.fixture
def cut(monkeypatch):
    monkeypatch.setattr(bpe_codec, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    return lambda batches: bpe_codec._cut(1, 8)(iter(batches))


def batch(first, texts):
    return pa.RecordBatch.from_arrays([pa.array(range(first, first + len(texts))), pa.array(texts, pa.string())], ["_c0", "_text"])


def words_back(made):
    """(id, words) of every row of one block, from its lists, its ranks and its positions."""
    rows = list(zip(made.column("at").to_pylist(), made.column("data").to_pylist()))
    words = [w for at, data in rows if at < bpe_codec._SHAPE for w in zstandard.ZstdDecompressor().decompress(data).decode().split("\n")]
    order = next(bpe_codec._numbered(data) for at, data in rows if at == bpe_codec._SHAPE)
    for at, data in rows:
        if at > bpe_codec._SHAPE:
            kept, numbers = bpe_codec._unpack(data)
            ends = np.cumsum(kept.column(1).to_numpy())
            for i, some in zip(kept.column(0).to_pylist(), np.split(numbers, ends[:-1])):
                yield i, [words[order[n]] for n in some]


def test_bpe_block_holds_no_entry_for_each_position(cut):
    rng = random.Random(5)
    vocab = [f"{rng.randrange(36**4):x}" for _ in range(30_000)]
    texts = [" ".join(vocab[int(rng.paretovariate(0.6)) % len(vocab)] for _ in range(4_000)) for _ in range(300)]
    size = sum(map(len, texts))
    assert size < bpe_codec.BLOCK_BYTES
    batches = [batch(i, texts[i : i + 20]) for i in range(0, len(texts), 20)]
    list(cut(batches[:1]))  # tables that stay
    tracemalloc.start()
    try:
        made = list(cut(batches))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(made) == 1
    assert dict(words_back(made[0])) == {i: t.split() for i, t in enumerate(texts)}
    assert peak < 10 * size, peak / size


def test_bpe_block_of_many_slices(cut, monkeypatch):
    from sylva.llm import arrays

    monkeypatch.setattr(arrays, "SLICE_BYTES", 64)
    monkeypatch.setattr(bpe_codec, "PACKED_BYTES", 150)
    long = " ".join(f"n{i}" for i in range(70_000))  # over 65,536 distinct words in one slice
    texts = ["a b a", None, "", "  ", "é b\tc", "b " * 60, long, "c a", "z"] * 2
    made = list(cut([batch(0, texts[:5]), batch(5, texts[5:6]), batch(6, texts[6:])]))
    assert len(made) == 1
    assert list(words_back(made[0])) == [(i, (t or "").split()) for i, t in enumerate(texts)]
    made = list(cut([batch(0, [None, "", " "])]))
    assert made[0].column("at").to_pylist()[0] == bpe_codec._SHAPE


def test_bpe_tasks_of_a_worker_share_a_tokenizer(tmp_path):
    import os
    import shutil

    path = str(tmp_path / "tokenizer.json")
    shutil.copyfile(bpe_codec.default_tokenizer(), path)
    first = bpe_codec._load(path)
    assert bpe_codec._load(path) is first
    task = bpe_codec._encode_words(path)
    lists = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0], pa.int32()), pa.array([zstandard.ZstdCompressor().compress(b"some\nwords")])], ["block", "at", "data"])
    assert [b.column("data").to_pylist() for _ in range(2) for b in task(iter([lists]))] == 2 * [next(iter(task(iter([lists])))).column("data").to_pylist()]
    assert bpe_codec._load(path) is first
    os.utime(path, ns=(1, 1))  # another file of that name
    assert bpe_codec._load(path) is not first
