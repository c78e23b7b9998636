"""The text operators against brute force, on small tables with awkward rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sylva.llm import bpe_codec, chat_format, exact_dedup, license_scan, line_dedup, lm_score, mixing, near_dedup, quality_fm, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `_c0` string, ids string"


def rows():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    texts = [None, "", "   \n ", "one", "one two", "One TWO", "😀 é ß x", "w " * 3000, "q" * 4000]
    base = [[rng.choice(vocab) for _ in range(120)] for _ in range(12)]
    for words in base:
        texts.append(" ".join(words))
        texts.append("  ".join(words) + "\n")
        near = list(words)
        near[rng.randrange(120)] = "changed"
        texts.append(" ".join(near))
    texts += [texts[8]] * 3
    return [(i, t, "en", None if i % 9 == 0 else f"s{i % 3}", len(t or ""), "x", "y") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty):
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs, digest_all=True).collect()}
    groups = {}
    for i, t, *_ in rows():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    for key, members in groups.items():
        for _, i in members:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (min(members)[1], len(members), i == min(members)[1])
            assert r.digest == hashlib.sha256(key.encode()).hexdigest()
    assert exact_dedup.drop_exact(docs).count() == len(groups)
    assert exact_dedup.drop_exact(docs.union(docs)).count() == len(groups)
    assert exact_dedup.drop_exact(empty).count() == 0


def test_near_dedup(docs, empty):
    got = {r.doc_id: r for r in near_dedup.near_groups(docs).collect()}
    sets = {}
    for i, t, *_ in rows():
        w = [x.lower() for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    name = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and name[j] < name[i]:
                    name[i], changed = name[j], True
    assert {i: r.component_id for i, r in got.items()} == name
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert near_dedup.drop_near(docs).count() == len(set(name.values()))
    assert near_dedup.near_groups(empty).count() == 0


def test_dedup_decides_rows_not_ids(spark):
    rng = random.Random(8)
    texts = [[f"t{j}w{rng.randrange(900)}" for _ in range(100)] for j in range(8)]
    near = [" ".join(t[:50] + ["changed"] + t[51:]) for t in texts]
    texts = [" ".join(t) for t in texts]
    # A null id beside a named one, null ids only, a repeated id with a unique text, a row given twice.
    data = [(1, texts[0]), (None, near[0]), (None, texts[1]), (None, texts[2]), (None, near[2]), (2, texts[3]), (3, near[3]), (3, texts[4])]
    data += [(4, texts[5])] * 2 + [(5, texts[6]), (5, near[6]), (None, None), (None, "")]
    table = spark.createDataFrame(data, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in near_dedup.drop_near(table).collect()]
    two = [x for x in got if x[0] is None and x[1] in (texts[2], near[2])]
    five = [x for x in got if x[0] == 5]
    want = [(1, texts[0]), (None, texts[1]), (2, texts[3]), (3, texts[4]), (4, texts[5]), (None, None), (None, "")]
    assert len(two) == len(five) == 1 and sorted(got, key=str) == sorted(want + two + five, key=str)
    groups = near_dedup.near_groups(table).collect()
    assert len(groups) == len(data) and sum(r.kept for r in groups) == len(got)
    data = [(1, "a b"), (None, "ab"), (None, "c"), (None, "d e"), (None, "d e"), (2, "f"), (2, "a  b"), (3, "g"), (3, "g")]
    table = spark.createDataFrame(data, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in exact_dedup.drop_exact(table).collect()]
    assert sorted(got, key=str) == sorted([(2, "a  b"), (None, "c"), (None, "d e"), (2, "f"), (3, "g")], key=str)


def test_near_dedup_from_80_percent(spark):
    import corpus_pipeline

    # 124 and 100 shingles, 82 per cent of the union and a part of it: alike from 80 per cent, not from 85.
    words = [f"w{i}" for i in range(128)]
    table = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:106]))], "doc_id long, text string")
    assert near_dedup.drop_near(table).count() == 2
    assert [r.doc_id for r in corpus_pipeline.near(spark, table, "").collect()] == [1]
    assert near_dedup.shared_at_least(80, 40) == 17 and near_dedup.shared_at_least(85, 20) == 7
    # Pairs at half the union share fewer values than the least number for 85 per cent.
    pairs = [(2 * j + h, " ".join(f"v{j}x{i}" for i in range(120) if not (h and i >= 64))) for j in range(30) for h in (0, 1)]
    table = spark.createDataFrame(pairs, "doc_id long, text string")
    assert near_dedup.drop_near(table, percent=50).count() == 30


def test_bpe_round_trip(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_codec.default_tokenizer())
    outputs = ("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256")
    coded = bpe_codec.encode(docs, outputs=outputs, carry=["doc_id", "text", "ids"]).toDF("doc_id", "text", "other", *outputs)
    got = bpe_codec.decode(coded, out="back", keep=["doc_id", "text", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"]).collect()
    assert len(got) == len(rows())
    for r in got:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids) and r.back == r.decoded == back
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert bpe_codec.encode(empty).count() == 0


def test_bpe_decides_on_special_tokens_by_text(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_codec.default_tokenizer())
    texts = ["Up<|endoftext|>Down a,b", "A,b <", "|c D'e", "<|EndOfText|> X", "x<| |>y", "plain TEXT, here", "", None, "<", "|", "<|startoftext|>" * 3, "é<|endoftext|>É", "Q" * 70000, "it's (A.B)!"] * 2
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in bpe_codec.encode(table, outputs=("ids", "decoded")).collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == t.decode(ids, skip_special_tokens=False)


def test_mixing_meets_targets(docs, empty):
    plan = mixing.mix_plan(docs).collect()
    again = mixing.mix_plan(docs).collect()
    assert sorted(map(tuple, plan), key=str) == sorted(map(tuple, again), key=str)
    by = {}
    for r in plan:
        by.setdefault(r.source, []).append(r)
        assert r.taken <= 3 * r["size"]
    for source in by.values():
        assert abs(sum(r.taken for r in source) - source[0].target) <= max(r["size"] for r in source) / 2 + 1e-6
        assert source[0].target <= 3 * source[0].source_size + 1e-6
    assert mixing.mix_documents(docs).count() == sum(r.taken // r["size"] for r in plan if r["size"])
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_mixing_takes_rows_that_repeat_ids_by_plan(spark, monkeypatch):
    from sylva.llm import common

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    data = [(7, "same text of five words", "hot", i) for i in range(400)]  # one id and text, most of a source
    data += [(None, " ".join(word() for _ in range(rng.randint(1, 9))), rng.choice(["hot", "cold", None]), i) for i in range(300)]
    data += [(i % 40, " ".join(word() for _ in range(rng.randint(0, 30))), rng.choice(["cold", "warm", None]), i) for i in range(300)]
    table = spark.createDataFrame(data, "doc_id long, text string, source string, epochs long").repartition(3)
    for narrow in (20_000, 1):  # all facts broadcast, or most of them shuffled
        monkeypatch.setattr(common.with_groups, "__defaults__", (narrow,))
        plan = mixing.mix_plan(table, range_rows=50).collect()
        assert len(plan) == len(data)
        size = {}
        for r in plan:
            size[r.source] = size.get(r.source, 0) + r.taken
            assert r.taken % max(r["size"], 1) == 0 and r.taken <= 3 * r["size"]
        for r in plan:
            assert abs(size[r.source] - r.target) <= 15
        mix = mixing.mix_documents(table, range_rows=50)
        got = mix.collect()
        assert mix.columns == table.columns
        for source in size:
            assert sum(len(r.text.split()) for r in got if r.source == source) == size[source]
        # The same sums as one sort of each source gives.
        want = {}
        by = {}
        for i, t, s, _ in data:
            h = hashlib.sha256(f"mix:{'' if i is None else i}:{t}".encode()).hexdigest()
            by.setdefault(s, []).append((h[:28], i, t))
        targets = {r.source: (r.target, r.source_size) for r in plan}
        for s, found in by.items():
            whole, before = int(targets[s][0] // targets[s][1]), 0
            rest = targets[s][0] - whole * targets[s][1]
            for _, i, t in sorted(found, key=lambda x: x[0]):
                n = len(t.split())
                times = (whole + (before + n / 2 <= rest)) if n else 0
                before += n
                want[(i, t, s)] = want.get((i, t, s), 0) + times
        have = {}
        for r in got:
            have[(r.doc_id, r.text, r.source)] = have.get((r.doc_id, r.text, r.source), 0) + 1
        assert have == {k: v for k, v in want.items() if v}


def test_exact_dedup_in_shuffled_groups(docs, monkeypatch):
    from sylva.llm import common

    want = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()}
    monkeypatch.setattr(common.with_groups, "__defaults__", (0,))
    for every in (False, True):
        assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs, digest_all=every).collect()} == want


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "</s>[INST] a <\\s> [/INST"), (1, 1, "assistant", "]</s><"), (2, 0, None, None), (None, 0, "assistant", "x"), (3, 1, "assistant", "é"), (3, 1, "assistant", "é")]
    got = chat_format.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert all(r.exact for r in got.collect())
    back = {r.conv_id: r for r in chat_format.read_back(got).collect()}
    want = hashlib.sha256("user\n</s>[INST] a <\\s> [/INST\nassistant\n]</s><\n".encode()).hexdigest()
    assert back[1].turns_sha256 == want and back[1].loss_chars == 6
    assert back[3].loss_sha256 == hashlib.sha256("éé".encode()).hexdigest() and back[2].n_turns == 1


def test_quality_measures():
    text = "a b c a b c\n\n \na b c a b c\nx# y|"
    m = next(quality_rules.measure(pa.array([text, None])))
    assert [int(m[c][0]) for c in quality_rules.COLUMNS[:5]] == [14, 16, 2, 1, 12]
    assert all(int(m[c][1]) == 0 for c in quality_rules.COLUMNS)


def test_quality_verdict_equals_brute_force(spark):
    rng = random.Random(6)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    passage, part = fresh(110), fresh(45)
    texts = [fresh(400) + passage + fresh(200) + passage, fresh(60) + part + fresh(60) + part, fresh(10) + part + fresh(100) + part]
    texts += [[rng.choice("abc") for _ in range(rng.randint(40, 90))] for _ in range(20)]
    texts += [[f"v{rng.randrange(14)}" for _ in range(rng.randint(45, 200))] for _ in range(40)]
    for _ in range(20):
        bits = [fresh(rng.randint(5, 14)) for _ in range(4)]
        texts.append(sum((rng.choice(bits) if rng.random() < 0.4 else fresh(12) for _ in range(14)), []))
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.quality_report(table).collect()}
    verdicts = set()
    for i, w in enumerate(texts):
        n, long, windows = len(w), [0] * len(w), {}
        for a in range(n):
            windows.setdefault(tuple(w[a : a + 3]), []).append(a)
            for b in range(a):
                k = 0
                while a + k < n and w[a + k] == w[b + k]:
                    k += 1
                long[a], long[b] = max(long[a], k), max(long[b], k)
        again = {p + j for k, at in windows.items() if len(k) == 3 and len(at) > 1 for p in at for j in range(3)}
        covered = {a + j for a in range(n) if long[a] >= 8 for j in range(long[a])}
        longest = max(long) if max(long) >= 3 else 0
        failed = n < 50 or 100 * len(again) > 50 * n
        kept = not failed and 100 * len(covered) <= 40 * n and longest <= 100
        r = got[i]
        assert (r.n_words, r.n_repeat_words, r.n_covered_words, r.longest_repeat) == (n, len(again), len(covered), longest)
        assert (r.base_failed, r.kept) == (failed, kept)
        verdicts.add((failed, kept))
    assert not got[0].base_failed and not got[0].kept and not got[1].base_failed and not got[1].kept and got[2].n_words == 200
    assert verdicts == {(True, False), (False, False), (False, True)}


def test_quality_keeps_columns(docs, empty):
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, t, *_ in rows() if len(WORD.findall(t or "")) == 120}
    assert quality_rules.quality_report(empty).count() == 0


def test_lattice_sums_all_segmentations(docs, empty):
    import numpy as np

    net = lm_score.Lattice(lm_score.default_vocabulary())
    logp = net.start()
    assert np.isfinite(net.words(["the", "", "zq😀", "x" * 70], logp)).all()
    parts = net.words(["the", "zq", "x" * 5000], logp)
    assert np.isfinite(parts).all() and parts[2] < -745  # beyond what a probability outside log space can hold
    scored = lm_score.score_texts(docs, rounds=1, hot=20).collect()
    assert len(scored) == len(rows()) and all(-1e6 < r.score <= 0 and r.n_tokens >= 1 for r in scored)
    whole = {r.doc_id: round(r.score, 6) for r in lm_score.score_texts(docs, rounds=1).collect()}
    assert whole == {r.doc_id: round(r.score, 6) for r in scored}
    assert lm_score.score_texts(empty, rounds=1).count() == 0


def test_lattice_equals_all_segmentations():
    net = lm_score.Lattice(lm_score.default_vocabulary())
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=lm_score.default_vocabulary())
    plain = {sp.id_to_piece(i): i for i in range(sp.get_piece_size() - 1, -1, -1) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    logp = net.start()

    def total(text):  # the sum over all ways to cut a text, one by one
        if not text:
            return 1.0
        out = sum(np.exp(logp[plain[text[:k]]]) * total(text[k:]) for k in range(1, len(text) + 1) if text[:k] in plain)
        if text[0] not in plain:
            out += np.exp(sum(logp[net.bytes[b]] for b in text[0].encode())) * total(text[1:])
        return out

    words = ["the", "running", "a", "zqx", "unsaid", "e\U0001F600b", "ñandú", ""]
    assert np.allclose(net.words(words, logp), [np.log(total("\u2581" + w)) for w in words], rtol=1e-9)


def test_scores_beat_the_base_on_held_out_texts(spark):
    rng = random.Random(12)
    stems = ["".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(2)) for _ in range(2000)]
    ends = ["ing", "ed", "ness", "s", "tion", "ly", "er", "al", "ment", "able"]
    texts = [" ".join(rng.choice(stems) + rng.choice(ends) for _ in range(60)) for _ in range(200)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = lm_score.score_texts(table, hot=50).collect()
    held = [r for r in got if r.held_out]
    train = [WORD.findall(texts[r.doc_id]) for r in got if not r.held_out]
    counts = {}
    for w in sum(train, []):
        counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    below = np.log10(n + 0.1 * (v + 1))
    for r in got:
        words = WORD.findall(texts[r.doc_id])
        want = sum(np.log10(counts.get(w, 0) + 0.1) - below for w in words) + np.log10(len(train) + 0.1) - below
        assert abs(r.base_score - want) < 1e-6 and r.train_tokens == n and r.n_known == sum(w in counts for w in words) + 1
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_line_dedup_keeps_the_first(spark, docs, empty):
    common = "\n".join(f"line number {k} of the shared passage with some length" for k in range(4))
    table = spark.createDataFrame([(1, "own first line of one\n" + common), (2, common + "\nown last line of two"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.cut_lines(table).collect()}
    assert got[1].n_cut == 0 and got[2].text == "own last line of two" and got[2].n_cut == 4 and got[3].text is None
    assert line_dedup.cut_lines(docs).count() == len(rows()) and line_dedup.cut_lines(empty).count() == 0


def test_line_dedup_meets_later_holders(spark):
    h, k = "a shared line of thirty letters", "another shared line of thirty letters"
    rows = [(1, [h, "x", h, "y"]), (2, ["a", h, "b"]), (3, ["c", h, "d"]), (4, ["p", k, "q", h, k, "r"]), (5, ["s", k, k, "t"]), (6, ["u", h, "v", k, "w"]), (7, ["m", h, "z", k, "n"])]
    table = spark.createDataFrame([(i, "\n".join(t)) for i, t in rows], "doc_id long, text string")
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.cut_lines(table).collect()}
    assert got[3] == ["c", "d"] and got[7] == ["m", "z", "n"]
    # Lines that stand twice in the first holders reach the one that aligns only after several rounds.
    rows = [(i, [f"a{i}", h, f"b{i}", h, f"c{i}", k, f"d{i}", k, f"e{i}"]) for i in range(30)]
    rows += [(30, ["x", h, "y", "z"]), (31, ["o", h, "o1", "o2", k, "o3"]), (32, ["v", k, "v1", h, "v2"]), (33, ["w", k, "w1", h, "w2"])]
    table = spark.createDataFrame([(i, "\n".join(t)) for i, t in rows], "doc_id long, text string")
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.cut_lines(table).collect()}
    assert got[31] == ["o", "o1", "o2", k, "o3"]  # no earlier document has k in one place
    assert got[33] == ["w", "w1", "w2"]


def test_line_dedup_weighs_pairs_not_lines(spark):
    verse = [f"verse {k}" for k in range(6)]
    rows = [(1, ["own one", *verse]), (2, ["verse 0", "two"]), (3, ["verse 1", "three"]), (4, [*verse, "own four"])]
    boiler = "a line that very many documents have"
    rows += [(i, [f"start {i}", boiler, f"end {i}"]) for i in range(10, 160)]
    # First holders of the two lines differ, and only the third document has both.
    rows += [(200, ["first of it", "x1"]), (201, ["second half", "x2"]), (202, ["y", "first of it", "second half", "z"]), (203, ["k", "first of it", "second half", "l"])]
    table = spark.createDataFrame([(i, "\n".join(t)) for i, t in rows], "doc_id long, text string")
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.cut_lines(table).collect()}
    assert got[4] == ["own four"] and got[2] == ["verse 0", "two"] and got[10][1] == boiler
    assert all(got[i] == [f"start {i}", f"end {i}"] for i in range(11, 160))
    assert got[202] == ["y", "first of it", "second half", "z"] and got[203] == ["k", "l"]


def test_license_scan(spark, empty):
    table = spark.createDataFrame([(1, "x y\nLicensed under CC BY-NC 4.0.\nz"), (2, "the license of this work"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(table).collect()}
    assert got[1].license == "CC-BY-NC-4.0" and got[1].coverage == 1.0 and got[1].first_word == 2
    assert got[2].license is None and got[3].license is None
    assert license_scan.scan_licenses(empty).count() == 0


def test_license_scan_reaches_the_end_of_a_long_text(spark):
    rng = random.Random(3)
    common = ["the", "of", "to", "and", "or", "in", "this", "with", "free", "use"]
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else f"p{rng.randrange(999)}" for _ in range(n))
    mit = license_scan.NOTICES["MIT"].split()
    late = [(i, prose(3000 + 13 * i) + " " + " ".join(["Allowance", *mit[1:]]) + " " + prose(500)) for i in range(8)]
    # Copies without their first word, one after the other.
    many = [(8, prose(700) + " " + " ".join(mit[1:] * 9) + " " + prose(300)), (9, prose(4000))]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(late + many, "doc_id long, text string")).collect()}
    assert all(got[i].license == "MIT" and got[i].first_word >= 3000 + 13 * i for i in range(8)), got
    assert got[8].license == "MIT" and got[8].coverage > 0.9 and got[9].license is None
    rng = np.random.default_rng(4)
    for _ in range(200):
        words, often = rng.integers(-1, 4, rng.integers(1, 60)), np.array([1, 2, 1, 3])
        want = [s for s in range(max(len(words) - 7, 0) + 1) if sum(min(often[w], (words[s : s + 7] == w).sum()) for w in range(4)) >= 5]
        assert license_scan._full(words, often, 7, 5).tolist() == want


def test_quality_classifier_learns(spark, empty):
    rng = random.Random(2)
    data = [(i, " ".join(rng.choice(["good", "fine", "well", "text"]) for _ in range(30)) if i % 2 else "###!! " * 30) for i in range(400)]
    docs = spark.createDataFrame([*data, (400, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = quality_fm.score_quality(docs, quality_fm.fit_quality(docs, labels)).where("held_out AND doc_id < 400").collect()
    assert got and all(r.predicted == r.doc_id % 2 for r in got)
    assert quality_fm.score_quality(empty, None).count() == 0


def test_quality_margin_and_gradient_equal_the_double_sum():
    rng = np.random.default_rng(3)
    model = quality_fm.Model(np.sort(rng.normal(size=(quality_fm.STATS, quality_fm.BINS - 1)), axis=1))
    model.w = rng.normal(size=model.w.shape)
    model.v = rng.normal(size=model.v.shape)
    model.bias = 0.3
    buckets = [np.sort(rng.choice(quality_fm.BUCKETS, k, replace=False)) for k in (0, 1, 5, 40)]
    edges = np.concatenate([[0], np.cumsum([len(b) for b in buckets])])
    rows = model.rows(rng.normal(size=(4, quality_fm.STATS)), edges, np.concatenate(buckets))
    to, feature, value = rows

    def naive(i):
        f, x = feature[to[i] : to[i + 1]], value[to[i] : to[i + 1]]
        pairs = sum(model.v[f[a]] @ model.v[f[b]] * x[a] * x[b] for a in range(len(f)) for b in range(a))
        return model.bias + (model.w[f] * x).sum() + pairs

    assert np.allclose(model.margin(*rows)[0], [naive(i) for i in range(4)])
    # One step of the fit goes down along the slope that differences give.
    y = np.array([1.0, 0.0, 1.0, 0.0])

    def loss():
        m = model.margin(*rows)[0]
        return np.mean(np.log1p(np.exp(-np.abs(m))) + np.maximum(m, 0) - y * m)

    slopes = []
    spots = [(f, r) for f in feature[:3] for r in range(quality_fm.RANK)]
    for f, r in spots:
        old, step = model.v[f, r], 1e-5
        model.v[f, r] = old + step
        up = loss()
        model.v[f, r] = old - step
        slopes.append((up - loss()) / (2 * step))
        model.v[f, r] = old
    before, start = model.v.copy(), loss()
    model.fit(rows, y, epochs=1, rate=1e-4, decay=0.0)
    moved = [model.v[s] - before[s] for s in spots]
    assert loss() < start and all(a * b <= 0 for a, b in zip(moved, slopes) if abs(b) > 1e-6)


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(21)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    texts = [None, "", "few words here", "again and again " * 40]
    for _ in range(25):
        words = [rng.choice(vocab) for _ in range(rng.randint(60, 140))]
        texts += [" ".join(words)] * rng.randint(1, 2)
        if rng.random() < 0.5:
            texts.append("  ".join(words) + " \n")
        for share in (0.02, 0.3):
            other = list(words)
            at = rng.randrange(len(other) - 45)
            n = max(1, int(share * 40))
            other[at : at + n] = [rng.choice(vocab) for _ in range(n)]
            texts.append(" ".join(other))
    data = [(i, t, "en", f"s{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    # Quality: none of these texts but those under 50 words and the repeating one breaks a rule.
    left = [d for d in data if d[1] and len(WORD.findall(d[1])) >= 50 and not d[1].startswith("again")]
    groups = {}
    for d in left:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", d[1]), []).append(d)
    left = sorted(min(g, key=lambda d: (-len(d[1]), d[0])) for g in groups.values())
    sets = []
    for d in left:
        w = d[1].lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    name = list(range(len(left)))
    for a in range(len(left)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = name[a], name[b]
                name = [min(x, y) if n in (x, y) else n for n in name]
    left = [d for i, d in enumerate(left) if name[i] == i]
    size = {}
    for d in left:
        size[d[3]] = size.get(d[3], 0) + len(d[1].split())
    order = sorted((s for s in size if s), key=str) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, words = {}, list(order), float(sum(size.values()))
    while open_:
        rate = (words - sum(target.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if rate * weight[s] > 3 * size[s]]
        target |= {s: 3.0 * size[s] for s in over} or {s: rate * weight[s] for s in open_}
        open_ = [s for s in open_ if s not in target]
    t, want = Tokenizer.from_file(bpe_codec.default_tokenizer()), []
    for s in order:
        whole = int(target[s] // size[s])
        rest, before = target[s] - whole * size[s], 0
        for _, d in sorted((hashlib.sha256(f"mix:{d[0]}:{d[1]}".encode()).hexdigest()[:28], d) for d in left if d[3] == s):
            n = len(d[1].split())
            ids = t.encode(d[1], add_special_tokens=False).ids
            row = (d[0], len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest(), tuple(ids))
            want += [row] * (whole + (before + n / 2 <= rest))
            before += n
    assert got == sorted(want)


def test_pipeline_equals_its_stages(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(rows(), SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and len({r.doc_id for r in out}) <= 12 and all(len(r.ids) == r.n_tokens for r in out)


def test_line_dedup_equals_alignment_with_all_earlier_documents(spark, monkeypatch):
    from sylva.llm import common
    from sylva.llm.patience import align

    rng = random.Random(21)
    short = ["{", "}", "x = 1", "return", "end", "", "  "]
    long = [f"line {k} of a passage that several documents hold" for k in range(6)] + ["-" * 24]
    data = []
    for i in range(40):
        doc = [rng.choice(long) if rng.random() < 0.25 else rng.choice(short) if rng.random() < 0.8 else f"own {i} {rng.random()}" for _ in range(rng.randint(1, 14))]
        data.append((None if i % 13 == 5 else i // 2, "\n".join(doc)))
    data += [data[3], data[7], (90, None), (91, ""), (92, "{\n\n}"), (93, "own and long enough a line\n{\n\n}")]
    table = spark.createDataFrame([(*d, k, "c", 7) for k, d in enumerate(data)], "doc_id long, text string, k int, `row` string, n_cut int").repartition(3)
    for narrow in (20_000, 0):
        monkeypatch.setattr(common.with_groups, "__defaults__", (narrow,))
        out = line_dedup.cut_lines(table)
        assert out.columns == ["doc_id", "text", "k", "row", "n_lines", "n_cut", "cut_chars"]
        got = {r.k: r for r in out.collect()}
        assert len(got) == len(data)
        lines = [[x.strip() for x in (t or "").split("\n")] for _, t in data]
        cut_some = left_short = 0
        for k, (i, t) in enumerate(data):
            if t is None:
                assert got[k].text is None and got[k].n_cut == got[k].n_lines == 0
                continue
            may, must = set(), set()
            for j, (other, u) in enumerate(data):
                if u is None or (other, u) == (i, t):
                    continue
                mine, theirs = (i is None, i or 0), (other is None, other or 0)
                if theirs > mine:
                    continue
                at = [p for p, l in enumerate(lines[k]) if l]
                pairs = align([lines[k][p] for p in at], [l for l in lines[j] if l], repeats=True)
                runs = []
                for a, b in pairs:
                    if runs and runs[-1][-1] == (a - 1, b - 1):
                        runs[-1].append((a, b))
                    else:
                        runs.append([(a, b)])
                for run in runs:
                    size = [len(lines[k][at[a]]) for a, _ in run]
                    if sum(size) >= 20:
                        may |= set(range(at[run[0][0]], at[run[-1][0]] + 1))
                        if theirs < mine:
                            must |= {at[a] for a, _ in run}
            # Cut lines are told by what is left: some choice of positions that lies between the two.
            left = t.split("\n")
            sure = [l for p, l in enumerate(left) if p not in may]
            most = [l for p, l in enumerate(left) if p not in must]
            r = got[k]
            rest = r.text.split("\n") if r.n_cut < len(left) else []

            def inside(a, b):
                it = iter(b)
                return all(x in it for x in a)

            assert inside(sure, rest) and inside(rest, most), (k, sure, rest, most)
            assert r.n_lines == len(left) and r.n_cut == len(left) - len(rest)
            cut_some += r.n_cut > 0
            left_short += "{" in rest
        assert cut_some > 10 and left_short > 5
        assert got[len(data) - 1].n_cut == got[len(data) - 2].n_cut == 0  # short lines alone are no block


def test_short_ends_of_blocks_go_with_them(spark):
    long = "a line of more than twenty characters"
    data = [
        (1, long),
        (2, f"{long}\nshort tail"),
        (3, f"own words\n{long}\n\nshort tail\nx"),
        (4, "ten of it\n{ }\nten to go"),
        (5, "its own first\nten of it"),
        (6, "ten to go\nits own last"),
        (7, "its own first\nten of it\n{ }\nten to go\nits own last"),
        (8, "-" * 24),
        (9, f"{'-' * 24}\nx\n{'-' * 24}"),
    ]
    got = {r.doc_id: r.text for r in line_dedup.cut_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[1] == data[0][1] and got[2] == "short tail" and got[3] == "own words\nx"
    assert got[7] == "" and [got[i] for i in (4, 5, 6, 8)] == [t for i, t in data if i in (4, 5, 6, 8)]


def test_license_texts_are_told_apart(spark):
    rng = random.Random(3)
    filler = lambda n: " ".join("".join(rng.choice("bcdfgaeiou") for _ in range(7)) for _ in range(n))
    names = sorted(license_scan.NOTICES)
    whole = [f"{filler(200)}\n{license_scan.NOTICES[n].upper()}\n{filler(50)}" for n in names]
    # One word in ten is another: every notice of some length is still found.
    worn = [" ".join("changed" if k % 10 == 5 else w for k, w in enumerate(license_scan.NOTICES[n].split())) for n in names]
    table = spark.createDataFrame(list(enumerate([*whole, *worn, filler(400), None])), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(table).collect()}
    for i, n in enumerate(names):
        words = re.findall(r"[a-z0-9]+", license_scan.NOTICES[n].lower())
        r = got[i]
        assert n in r.notices and r.coverage == 1.0 and r.license == n
        assert (r.first_word, r.last_word) == (200, 199 + len(words))
        if len(words) > 20:
            assert n in got[len(names) + i].notices
    assert got[2 * len(names)].license is None and got[2 * len(names) + 1].license is None
