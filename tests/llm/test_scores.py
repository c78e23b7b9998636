"""Language-model scores against all segmentations, count by count."""

import math
import zlib

import numpy as np
import sentencepiece

from sylva.llm import lm_score


def _plain(path):
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    return {sp.id_to_piece(i): i for i in range(n - 1, -1, -1) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}


def _total(text, plain, net, logp):
    if not text:
        return 1.0
    out = sum(math.exp(logp[plain[text[:k]]]) * _total(text[k:], plain, net, logp) for k in range(1, len(text) + 1) if text[:k] in plain)
    if text[0] not in plain:
        out += math.exp(sum(logp[net.bytes[b]] for b in text[0].encode())) * _total(text[1:], plain, net, logp)
    return out


def test_score_equals_all_segmentations(spark):
    known = ["the", "a", "cat", "\U0001F600x", "sat", "mat", "ñu"]
    texts = ["the cat sat", "a a a the", "the mat ñu", "cat \U0001F600x zqv", "never seen", "", "The CAT zqv the", "unsaid the", None, "sat sat"] * 4
    texts += known + ["zqv", "unsaid"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = [(t or "").lower().split() for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    counts = {}
    for w in sum(train, []):
        counts[w] = counts.get(w, 0) + 1
    tokens, kinds = sum(counts.values()) + len(train), len(counts) + 1
    once, twice = (sum(c == n for c in counts.values()) for n in (1, 2))
    d = min(0.9, max(0.1, once / max(1, once + 2 * twice)))
    saved, end = d * kinds / tokens, (len(train) + lm_score.END) / (tokens + 1)
    net, path = lm_score.Lattice(lm_score.default_vocabulary()), lm_score.default_vocabulary()
    plain, logp = _plain(path), net.start()
    spelled = lambda w: (1 - end) * _total("▁" + w, plain, net, logp)
    p = lambda w: max(counts.get(w, 0) - d, 0) / tokens + saved * spelled(w)
    p_end = (len(train) - d) / tokens + saved * end
    p_unknown = saved * (1 - end - sum(spelled(w) for w in counts))
    assert abs(sum(map(p, counts)) + p_end + p_unknown - 1) < 1e-9  # whole words, the end and all other spellings
    for hot in (0, 2, 100):
        for r in lm_score.score_texts(table, hot=hot, rounds=0).collect():
            words = (texts[r.doc_id] or "").lower().split()
            assert abs(r.text_score - sum(math.log10(p(w)) for w in words) - math.log10(p_end)) < 1e-8
            closed = sum(math.log10(p(w) if w in counts else p_unknown) for w in words) + math.log10(p_end)
            assert abs(r.score - closed) < 1e-8
            assert abs(r.lattice_score - sum(math.log10(spelled(w)) for w in words) - math.log10(end)) < 1e-8


def test_training_texts_without_words(spark):
    table = spark.createDataFrame([(i, None if i % 2 else " ") for i in range(30)] + [(None, "words here")], "doc_id long, text string")
    got = lm_score.score_texts(table, rounds=1).collect()
    assert len(got) == 31 and all(np.isfinite([r.score, r.text_score, r.lattice_score]).all() for r in got)
    assert [r.n_known for r in got if r.doc_id is None] == [1]


def test_rows_that_repeat_ids_are_scored_each(spark):
    table = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "a"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_tokens) for r in lm_score.score_texts(table, rounds=1, hot=1).collect())
    assert got == [(False, 2), (False, 3), (False, 3), (True, 1), (True, 2)]
