"""Source divergence, token alignment and personal data against brute force, on small tables with awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from sylva.llm import personal_data, source_audit, token_align

SCHEMA = "doc_id long, text string, lang string, source string, `_c0` string, number int, block string"


def texts():
    rng = random.Random(3)
    syllables = ["the", "ing", "ne", "o", "é", "ß", "un", "tion", "Ab", "x1", "ñ"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    out = [None, "", " ", "\n", "  a  b ", "a▁b", " x y", "<|endoftext|> </s> <s>", "tab\tand\r\nline", "🙂🙂 ok", "日本語のテキスト。 と", "é combining", "\0 nul", "don't 'tis 3.14 e.g. a.b,c;d", "a \n b\n\nc\n d", "x" * 3000, "w " * 4000]
    for _ in range(60):
        parts = [rng.choice(words) + rng.choice(["", "", ",", ".", "!", ":"]) for _ in range(rng.randint(1, 60))]
        out.append("".join(p + rng.choice([" ", " ", " ", "\n", "  "]) for p in parts))
    return out


def rows():
    made = [(i, t, ["en", "de", None][i % 3 if i % 11 else 2], [None, "s1", "s2", ""][i % 4], "x", 7, "b") for i, t in enumerate(texts())]
    return [*made, made[20], made[21], (None, made[22][1], "en", "lone", "x", 7, "b"), (None, None, "zz", "empty", "x", 7, "b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def audit(docs, tmp_path, monkeypatch):
    monkeypatch.setattr(source_audit, "table", lambda *_: docs)
    return source_audit.op11_source_divergence(docs.sparkSession, str(tmp_path))


def by_sql(spark_rows):
    import pyarrow as pa

    con = duckdb.connect()
    con.register("documents", pa.table({"text": [r[1] for r in spark_rows], "lang": [r[2] for r in spark_rows], "source": [r[3] for r in spark_rows]}))
    rel = con.sql(source_audit.SQL)
    return sorted(tuple(r[rel.columns.index(c)] for c in ("lang", "source", "part", "item", "value", "rank")) for r in rel.fetchall())


def test_source_divergence(docs, tmp_path, monkeypatch):
    monkeypatch.setattr(source_audit, "FIRST", 2)  # several rounds
    monkeypatch.setattr(source_audit, "MORE", 3)
    got = sorted(tuple(r) for r in audit(docs, tmp_path, monkeypatch).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == by_sql(rows())
    assert {r[1] for r in got if r[0] == "zz"} == set() and any(r[2] == "term" for r in got) and any(r[2] == "pair" for r in got)


def test_source_divergence_without_kept_terms(spark, empty, tmp_path, monkeypatch):
    few = [(1, "a b", "en", "s1", "", 0, ""), (2, "c", "en", "s2", "", 0, ""), (3, None, None, None, "", 0, "")]
    got = audit(spark.createDataFrame(few, SCHEMA), tmp_path, monkeypatch).collect()
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got) == [("en", "s1", "pair", "s2", 0, 1), ("en", "s2", "pair", "s1", 0, 1)] == by_sql(few)
    assert audit(empty, tmp_path, monkeypatch).count() == 0


def test_bound_holds_for_every_member(spark):
    rng = random.Random(1)
    posts = [("en", "s", f"t{i}", n := rng.randint(1, 300), n + rng.randint(0, 900)) for i in range(500)]
    df = spark.createDataFrame(posts, "lang string, source string, term string, n long, ln long")
    one = F.lit(1).cast("long")
    df = df.withColumn("p", source_audit.probability(F.col("n"), 5000 * one, 700 * one)).withColumn("q", source_audit.probability(F.col("ln"), 90000 * one, 700 * one))
    for k in (1, 10, 499):
        want = sorted(((-((r.p - r.q) ** 2 // (r.p + r.q)), r.term) for r in df.collect() if r.p > r.q))[:k]
        got = source_audit.top_terms(df, k).orderBy("rank").collect()
        assert [(-r.value, r.term) for r in got] == want


def brute_alignment(texts):
    a, b = token_align._load(*token_align.default_tokenizers())
    pieces = token_align._piece_bytes(b)
    from tokenizers.pre_tokenizers import ByteLevel

    assert len(ByteLevel.alphabet()) == 256
    whole = []
    for t in texts:
        source = (" " + t).encode() if t else b""
        first = a.encode(" " + t, add_special_tokens=False) if t else None
        second = b.encode(t) if t else []
        if not t or None in [pieces[x] for x in second] or b"".join(pieces[x] for x in second) != source:
            whole.append(None)
            continue
        sizes = [[len(a.id_to_token(x)) for x in first.ids], [len(pieces[x]) for x in second]]
        ends = [[sum(s[: i + 1]) for i in range(len(s))] for s in sizes] if len(source) < 5000 else [list(__import__("itertools").accumulate(s)) for s in sizes]
        assert ends[0][-1] == len(source)
        groups, at = [], [0, 0]
        for e in sorted(set(ends[0]) & set(ends[1])):
            to = [x.index(e) + 1 for x in ends]
            groups.append((first.ids[at[0] : to[0]], second[at[1] : to[1]]))
            at = to
        whole.append(groups)
    held = Counter()
    for groups in whole:
        held.update({(x, y) for g in groups or () for x in g[0] for y in g[1]})
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for groups in whole:
        links = [(x, y) for g in groups or () for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups or ())
        out.append((
            sum(len(g[0]) for g in groups or ()), sum(len(g[1]) for g in groups or ()), len(groups or ()), len(links), sum(held[x] == most[x[0]] for x in links),
            sum(held[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return out


def test_token_alignment(docs, empty, monkeypatch):
    monkeypatch.setattr(token_align, "ENCODED", 50)
    got = token_align.aligned_documents(docs, carry=["doc_id", "text", "_c0"]).collect()
    want = Counter(zip([(r[0], r[1]) for r in rows()], brute_alignment([r[1] for r in rows()])))
    assert Counter(((r.doc_id, r.text), (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in got) == want
    assert token_align.aligned_documents(empty, carry=["doc_id"]).count() == 0
    assert all(r[2] == "x" for r in got)


def test_units_give_the_tokens_of_whole_texts():
    rng = random.Random(9)
    paths = token_align.default_tokenizers()
    a, b = token_align._load(*paths)
    cuts, pieces = token_align.Cuts.of(*paths), token_align._piece_bytes(b)
    assert cuts.spaces and cuts.lines and set(b".,;:!?") <= set(cuts.punctuation)
    alphabet = ["a", "the", "É", "ß", "×", "1", "22", " ", "  ", "\n", "\t", ".", ",", "'", "'s", "-", "(", ")", "▁", " ", "日", "é", "é", "\r", "　", "🙂", "ſ"]
    import numpy as np

    for _ in range(1500):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14)))
        raw = np.frombuffer(t.encode(), np.uint8)
        units, count, _ = token_align._units(raw, np.array([0, len(raw)]), cuts)
        first, second = token_align._encode(units.to_pylist(), a, b, pieces)
        assert count.tolist() == [len(units)]
        whole = b.encode(t)
        good = None not in [pieces[x] for x in whole] and b"".join(pieces[x] for x in whole) == (" " + t).encode()
        assert good == (None not in second), t
        if good:
            assert [x for ids in second for x in ids] == whole, t
            assert [x for ids in first for x in ids] == a.encode(" " + t, add_special_tokens=False).ids, t


PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def slow_plain(t):
    out = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(t):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits[::-1])) % 10 == 0
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 16 <= len(digits) <= 19 and luhn or kind == "phone" and 8 <= len(digits) <= 15:
                out.append((kind, *m.span()))
    return out


def test_plain_spans_equal_their_patterns():
    rng = random.Random(4)
    for alphabet in ("a1.@-_ é+%", "0123456789 -.", "+0123 ().-", "12.5 4@a-"):
        for _ in range(4000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(50)))
            assert [(k, a, b) for k, found in personal_data.plain_spans(t).items() for a, b in found] == slow_plain(t), t
    card = "4539 1488-0343 6467"
    assert personal_data.plain_spans(f"x {card}, y")["card"] == [(2, 2 + len(card))]


DISGUISED = {
    "und.34 (at) mail7 (dot) example (dot) com": ("email", "und.34@mail7.example.com"), "jo [at] example.com": ("email", "jo@example.com"),
    "john dot doe at example dot com": ("email", "john.doe@example.com"), "und.34 at mail7.example.com": ("email", "und.34@mail7.example.com"),
    "us​er@exa​mple.com": ("email", "user@example.com"), "usеr@example.com": ("email", "user@example.com"),
    "ｕｓｅｒ＠ｅｘａｍｐｌｅ．ｃｏｍ": ("email", "user@example.com"), "a.b @ c.com": ("email", "a.b@c.com"), "jane AT example DOT org": ("email", "jane@example.org"),
    "plus one five five five one two three four": ("phone", "+15551234"), "+1 (974) five five five - three four three six": ("phone", "+1 (974) 5553436"),
    "four five three nine one four eight eight zero three four three six four six seven": ("card", "4539148803436467"), "4539 1488 O343 6467": ("card", "4539 1488 0343 6467"),
    "eins neun zwei punkt eins sechs acht punkt null punkt eins": ("ip", "192.168.0.1"), "1[.]2[.]3[.]4": ("ip", "1.2.3.4"), "１９２.１68.0.1": ("ip", "192.168.0.1"),
}


@pytest.mark.parametrize("text", DISGUISED)
def test_disguises_map_back_to_the_source(text):
    for before, after in (("", ""), ("Écrit à ", " enfin."), ("see \U0001f642 ", "")):
        found = [s for s in personal_data.all_spans(before + text + after) if not s[3]]
        assert found == [(DISGUISED[text][0], len(before), len(before) + len(text), False, DISGUISED[text][1])]
    assert any(len(re.findall(".", text)) and __import__("pyarrow.compute").compute.match_substring_regex(__import__("pyarrow").array([text]), s)[0].as_py() for s in personal_data._sieves())


def test_clean_prose_has_no_disguises():
    for t in ("look at the dot of it", "the point at one dot is near", "one two three four five", "meet at example.com", "at and in of at a the", "l'été à 3 heures", "a 1990s model: O2 and l33t", "un deux trois soleil", "null eins zwei"):
        assert personal_data.all_spans(t) == []


def test_personal_data_query(spark, docs, empty):
    made = [(1, "mail x@y.com, 10.0.0.1"), (2, None), (3, "jo [at] example.com or é x@y.com"), (None, ""), (3, "a" * 50_000 + " x@y.com")]
    df = spark.createDataFrame(made, "doc_id long, text string").withColumn("_text", F.lit(1)).withColumn("spans", F.lit("s"))
    found = personal_data.find_spans(df, out="found").withColumn("clean", personal_data.redacted(F.coalesce("text", F.lit("")), F.col("found")))
    got = {(r.doc_id, r.text): r for r in found.collect()}
    assert len(got) == 5 and all(r._text == 1 and r.spans == "s" for r in got.values())
    for (_, t), r in got.items():
        assert [(s.kind, s.start, s.end) for s in r.found if s.base] == slow_plain(t or "")
    assert got[made[0]].clean == "mail <email>, <ip>" and got[made[2]].clean == "<email> or é <email>" and got[made[1]].clean == ""
    assert personal_data.find_spans(empty).count() == 0


def test_licenses_that_differ_by_a_word(spark):
    from sylva.llm import license_scan

    lines = {
        "Released under the BSD License.": None, "Released under the ISC License.": None, "Licensed under CC BY-ND 4.0.": None, "Licensed under the Apache License, Version 1.1.": None,
        "This work is licensed under the GNU General Public License, version 1.": None, "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under CC BY 4.0.": "CC-BY-4.0", "released under the  mit licence.": "MIT-short", "It is under the Apache license, version 2.0": "Apache-2.0",
    }
    df = spark.createDataFrame([(f"some words before\n{t}\nand after",) for t in lines], "doc_id string").withColumn("text", F.col("doc_id"))
    got = {r.doc_id.split("\n")[1]: r for r in license_scan.scan_licenses(df).collect()}
    assert {t: r.license for t, r in got.items()} == lines
    assert all(r.notices == ([r.license] if r.license else []) for r in got.values())


def test_short_notices_equal_a_slow_search(spark):
    """Every one-word variant of every short notice, against all others by the longest common subsequence of words."""
    from sylva.llm import license_scan

    words = lambda t: re.findall("[a-z0-9]+", t.lower())
    short = {n: words(t) for n, t in license_scan.NOTICES.items() if len(words(t)) <= license_scan.SHORT}
    texts = [w for own in short.values() for w in [own, *[own[:i] + ["other"] + own[i + 1 :] for i in range(len(own))], *[own[:i] + own[i + 1 :] for i in range(len(own))]]]

    def common(x, y):
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    for i, t in enumerate(texts):
        for n, own in short.items():
            telling = [w for w in own if w not in license_scan.PLAIN_WORDS]
            if n in got[i].notices:
                assert common(t, own) >= license_scan.LEAST * len(own) and common(t, telling) == len(telling)
            elif t == own:
                raise AssertionError(n)
    # A changed telling word is noticed, a changed plain one is not.
    for n, own in short.items():
        for k, w in enumerate(own):
            found = got[texts.index(own[:k] + ["other"] + own[k + 1 :])].notices
            assert (n in found) == (w in license_scan.PLAIN_WORDS), (n, w)


def test_near_query_keeps_the_component_s_id(spark, monkeypatch):
    from sylva.llm import near_dedup

    one = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, one), (1, one), (2, one), (3, "x y z a b c"), (4, None)], "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "table", lambda *_: df)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.op10_near_dedup(spark, "").collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True)]
    assert near_dedup.drop_near(df).count() == 3
