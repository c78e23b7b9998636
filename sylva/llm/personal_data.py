"""Personal data in texts, written plainly or in disguise, as spans of the source's characters.

Plain spans follow four patterns (email, ip, card, phone), each leftmost and
without overlap. Disguised ones are found on a normalised text: a chain of
small transducers rewrites it and keeps, for each character that it writes, the
source characters that it stands for, so that what the same patterns find in
the normalised text maps back to exact source spans.

The transducers, in order:

1. characters: full-width and mathematical letters and digits, digits of other
   scripts, letters that look like Latin ones, other dashes, dots, at signs and
   spaces become their ASCII forms; characters without width vanish;
2. digits: O, o, I and l inside groups of mostly digits, and runs of at least
   three spelled digits in the four languages of the corpus ("double" and
   "triple" too), "plus" and "dot" beside them;
3. addresses: "at" and "dot" in brackets, spaced signs, and the bare words where
   the whole shape of an address stands around them.

A span that the normalised text gives is added if a rewritten character lies
inside it and no plain span of its kind covers it. Plain spans always stay.

Texts are first sifted in Arrow, a batch at a time, by patterns that any plain
or disguised span needs; only texts that pass are looked at one by one. No row
is shuffled, and a text is handled whole, whatever its length.

Defined results: a null text is empty and has no spans; repeated rows, null and
repeated ids pass through as they are; an empty table gives an empty result;
further columns pass through on request, whatever their names; ties cannot
occur, since spans of a kind do not start at the same character twice.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,value:string>>"

# The patterns of plain spans. An email is its sign and what follows, and the local part before it.
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile("[^0-9]+")

# Letters of other scripts and the Latin letters that they look like.
LOOK_ALIKES = dict(zip(
    "аеорсухіјѕԁԛԝһӏАВЕКМНОРСТХУІЈЅ" "αονικρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ɑɡıℓ",
    "aeopcyxijsdqwhlABEKMHOPCTXYIJS" "aovikptuxABEZHIKMNOPTYX" "agil", strict=True,
))
# Signs that stand for others, and characters without width.
SIGNS = (
    {c: "@" for c in "\uFF20\uFE6B"} | {c: "." for c in "\uFF0E\u3002\uFF61\u2024\u00B7\u2027\u2022"} | {c: "+" for c in "\uFF0B\uFE62\u02D6"}
    | {c: "-" for c in "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\uFE63\uFF0D\u2043"}
    | {c: " " for c in "\u00A0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A\u202F\u205F\u3000"}
)
WIDTHLESS = "\u00AD\u034F\u061C\u180E\u200B\u200C\u200D\u200E\u200F\u2060\u2061\u2062\u2063\u2064\uFE0E\uFE0F\uFEFF"
# Digits in words, in English, German, French and Spanish.
DIGIT_WORDS = {
    w: str(d)
    for d, words in enumerate(
        ["zero oh null zéro cero", "one eins un une uno una", "two zwei zwo deux dos", "three drei trois tres", "four vier quatre cuatro",
         "five fünf fuenf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve"]
    )
    for w in words.split()
}
# The words for the signs.
AT_WORDS = "at|ät|arroba|arobase|klammeraffe|chez|bei"
BARE_AT_WORDS = "at|ät|arroba|arobase|klammeraffe"
DOT_WORDS = "dot|punkt|point|punto|ponto"
PLUS_WORDS = "plus|más"
# The last labels of addresses that are written in bare words throughout.
LAST_LABELS = frozenset("com org net edu gov mil info biz io co uk de fr es eu ch nl it ca ru cn jp pl br au app dev".split())


@lru_cache(1)
def _folds() -> dict[int, str]:
    """One character for another: by the rule of compatibility forms for letters and digits, and by the lists."""
    out = {}
    for code in [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x2460, 0x2474), *range(0x24B6, 0x24EB), *range(0x2070, 0x208A), *range(0x2100, 0x2150)]:
        plain = unicodedata.normalize("NFKC", chr(code))
        if len(plain) == 1 and "!" <= plain <= "~":
            out[code] = plain
    for code in range(0x0660, 0x10000):
        digit = unicodedata.decimal(chr(code), None)
        if digit is not None:
            out[code] = str(digit)
    return out | {ord(k): v for k, v in (LOOK_ALIKES | SIGNS).items()}


def _luhn(digits: str) -> bool:
    odd = [int(c) for c in reversed(digits)]
    return (sum(odd[::2]) + sum(d * 2 - 9 * (d > 4) for d in odd[1::2])) % 10 == 0


def plain_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, leftmost first. A match that fails its further test is dropped without another try."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    last = 0
    for m in _AT_DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found["email"].append((start, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NO_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found["card"].append(m.span())
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
            found["phone"].append(m.span())
    return found


class Mapped:
    """A rewritten text: for each character, where its source begins and ends, and whether it was rewritten."""

    def __init__(self, source: str):
        self.text, self.start, self.end, self.new = source, list(range(len(source))), list(range(1, len(source) + 1)), [False] * len(source)

    def folded(self, folds: dict[int, str]) -> None:
        """Characters one for one."""
        now = self.text.translate(folds)
        if now != self.text:
            self.new = [n or a != b for n, a, b in zip(self.new, self.text, now)]
            self.text = now

    def rewrite(self, pattern: re.Pattern, to) -> None:
        """Each match becomes ``to(match)``: parts (text, from, to) of the match in turn; None leaves it as it is. A part
        that equals what it stands for keeps its characters; each character of another stands for the part's whole source."""
        text, start, end, new, at = [], [], [], [], 0

        def keep(a: int, b: int) -> None:
            text.append(self.text[a:b])
            start.extend(self.start[a:b])
            end.extend(self.end[a:b])
            new.extend(self.new[a:b])

        for m in pattern.finditer(self.text):
            parts = to(m)
            if parts is None:
                continue
            keep(at, m.start())
            for piece, a, b in parts:
                if piece == self.text[a:b]:
                    keep(a, b)
                else:
                    text.append(piece)
                    start.extend([self.start[a]] * len(piece))
                    end.extend([self.end[b - 1]] * len(piece))
                    new.extend([True] * len(piece))
            at = m.end()
        if at:
            keep(at, len(self.text))
            self.text, self.start, self.end, self.new = "".join(text), start, end, new


_NUMBER = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_NOT_WORD = r"(?<![^\W_])", r"(?![^\W_])"
_WIDTHLESS = re.compile(f"[{WIDTHLESS}]+")
_UNIT = rf"(?:(?:double|triple|doppel|doble)[ -])?(?:{_NUMBER}|[0-9]+)"
_BREAK = r"(?:[ ,]{1,2}| ?[-/] ?)"
_SPELLED = re.compile(rf"{_NOT_WORD[0]}(?:(?:{PLUS_WORDS})[ -])?\+?{_UNIT}(?:(?:{_BREAK}| (?:{DOT_WORDS}) ){_UNIT})+{_NOT_WORD[1]}", re.I)
_SPELLED_PART = re.compile(rf"({PLUS_WORDS})[ -]|(?:(double|triple|doppel|doble)[ -])?({_NUMBER})|(\+?[0-9]+|\+)|( (?:{DOT_WORDS}) )|({_BREAK})", re.I)
_MIXED = re.compile(r"(?<![A-Za-z0-9])[0-9OoIl](?:[0-9OoIl]|[ .-](?=[0-9OoIl]))*(?![A-Za-z0-9])")
_FAKE = str.maketrans("OoIl", "0011")
_OPEN, _CLOSE = r"[ \t]?[\[({<][ \t]?", r"[ \t]?[\])}>][ \t]?"
_BRACKET_AT = re.compile(rf"{_OPEN}(?:{AT_WORDS}|@|a){_CLOSE}(?=[A-Za-z0-9])", re.I)
_BRACKET_DOT = re.compile(rf"{_OPEN}(?:{DOT_WORDS}|\.){_CLOSE}(?=[A-Za-z0-9])", re.I)
_L = r"[A-Za-z0-9_%+-]+"
_D = r"[A-Za-z0-9-]+"
_SHAPE = re.compile(rf"(?<![A-Za-z0-9._%+-])({_L}(?:(?:\.| (?:{DOT_WORDS}) ){_L})*)( (?:{BARE_AT_WORDS}) | ?@ ?)({_D}(?:(?:\.| (?:{DOT_WORDS}) | \. ){_D})*(?:\.| (?:{DOT_WORDS}) | \. )[A-Za-z]{{2,24}})(?![A-Za-z0-9])", re.I)
_WORDED = re.compile(rf" (?:{DOT_WORDS}) | \. ", re.I)


def _split_dots(part: str, at: int) -> list[tuple[str, int, int]]:
    out, last = [], at
    for m in _WORDED.finditer(part):
        out += [(part[last - at : m.start()], last, at + m.start()), (".", at + m.start(), at + m.end())]
        last = at + m.end()
    return [p for p in [*out, (part[last - at :], last, at + len(part))] if p[1] < p[2]]


def _digits(m: re.Match) -> list[tuple[str, int, int]] | None:
    """A run with three spelled digits or more, or one in a long number, or three worded dots; breaks between two spelled
    digits vanish, others stay."""
    parts, spelled, many, dots, pending = [], False, 0, 0, None
    for p in _SPELLED_PART.finditer(m[0]):
        a, b = m.start() + p.start(), m.start() + p.end()
        if p[1]:
            parts.append(("+", a, b))
        elif p[3]:
            times = {"double": 2, "doppel": 2, "doble": 2, "triple": 3}.get((p[2] or "").lower(), 1)
            if pending and not spelled:
                parts.append(pending)
            parts.append((DIGIT_WORDS[p[3].lower()] * times, a, b))
            many, spelled, pending = many + times, True, None
        elif p[5]:
            parts.append((".", a, b))
            spelled, dots, pending = True, dots + 1, None
        elif p[6]:
            pending = (p[6], a, b)
        else:
            if pending:
                parts.append(pending)
            parts.append((p[4], a, b))
            spelled, pending = False, None
    long = many and len(_NO_DIGIT.sub("", m[0])) >= 6
    return parts if many >= 3 or long or dots >= 3 else None


def _mixed(m: re.Match) -> list[tuple[str, int, int]] | None:
    real = sum("0" <= c <= "9" for c in m[0])
    fake = sum(c in "OoIl" for c in m[0])
    return [(c.translate(_FAKE), m.start() + i, m.start() + i + 1) for i, c in enumerate(m[0])] if fake and real >= 4 and real > 2 * fake else None


def _address(m: re.Match) -> list[tuple[str, int, int]] | None:
    """The shape of an address. The bare word "at" counts if the local part is no plain word, or else if dots are worded
    or it stands in capitals, and the last label is a usual one."""
    local, sign, domain = m[1], m[2], m[3]
    if "@" not in sign and not re.search(r"[0-9._%+]", local):
        usual = re.search("[a-z]+$", domain.lower())[0] in LAST_LABELS
        if not usual or not (_WORDED.search(domain) or sign == " AT " and not local.isupper()):
            return None
    return [*_split_dots(local, m.start(1)), ("@", m.start(2), m.end(2)), *_split_dots(domain, m.start(3))]


def normalised(text: str) -> Mapped:
    out = Mapped(text)
    out.folded(_folds())
    out.rewrite(_WIDTHLESS, lambda m: [])
    out.rewrite(_MIXED, _mixed)
    out.rewrite(_SPELLED, _digits)
    out.rewrite(_BRACKET_AT, lambda m: [("@", m.start(), m.end())])
    out.rewrite(_BRACKET_DOT, lambda m: [(".", m.start(), m.end())])
    out.rewrite(_SHAPE, _address)
    return out


def all_spans(text: str, disguised: bool = True) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, end, whether plain, value in plain form) by kind, then start."""
    plain = plain_spans(text)
    out = [(k, a, b, True, text[a:b]) for k in KINDS for a, b in plain[k]]
    if disguised:
        made = normalised(text)
        # A widthless character that vanished left no character: it shows as a gap between its neighbours.
        gap = [made.new[i] or i + 1 < len(made.text) and made.start[i + 1] > made.end[i] for i in range(len(made.text))]
        if any(gap):
            for kind, spans in plain_spans(made.text).items():
                for a, b in spans:
                    if not any(gap[a : b - 1]) and not made.new[b - 1]:
                        continue
                    start, end = made.start[a], made.end[b - 1]
                    if not any(x <= start and end <= y for x, y in plain[kind]):
                        out.append((kind, start, end, False, made.text[a:b]))
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def _class(chars) -> str:
    return "[" + "".join(f"\\x{{{c:x}}}" for c in sorted(chars)) + "]"


@lru_cache(1)
def _sieves() -> tuple[str, ...]:
    """Patterns of which a text with a disguised span has one; each names what some transducer rewrites."""
    odd = _class({*_folds(), *map(ord, WIDTHLESS)} - {0xB7, 0x2022, 0x2013, 0x2014, 0xA0})
    common = _class([0xB7, 0x2022, 0x2013, 0x2014, 0xA0])  # frequent in prose, so only beside what a span is made of
    word = f"(?:{_NUMBER})"
    return (
        odd, f"[0-9@]{common}|{common}[0-9@]|[A-Za-z0-9]{common}[A-Za-z]{{2,}}",
        f"(?i){word}[ ,/-]+(?:(?:double|triple|doppel|doble)[ -])?{word}[ ,/-]+{word}|(?i)(?:double|triple|doppel|doble)[ -]{word}|(?i)(?:{word}|[0-9]) (?:{DOT_WORDS}) (?:{word}|[0-9])|(?i)[0-9]{{3}}[ ,/-]+{word}|(?i){word}[ ,/-]+[0-9]{{3}}",
        "[0-9][OoIl]|[OoIl][0-9]", f"(?i)[\\[({{<][ \\t]?(?:{AT_WORDS}|@|a|{DOT_WORDS}|\\.)[ \\t]?[\\])}}>]|(?i) (?:{DOT_WORDS}) [a-z]", " @|@ ",
        f"[0-9._%+-][A-Za-z0-9]* (?i:{BARE_AT_WORDS}) [A-Za-z0-9-]+\\.| AT [A-Za-z0-9-]+[. ]",
    )


def _find(carry: int, with_disguises: bool):
    struct = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(carry).cast(pa.large_string()).fill_null("")
            plain = pc.match_substring_regex(texts, "@|[0-9][^A-Za-z]{6}")
            odd = pa.array([False] * len(texts))
            for sieve in _sieves() if with_disguises else ():
                odd = pc.or_(odd, pc.match_substring_regex(texts, sieve))
            spans = [[]] * len(texts)
            for i in pc.indices_nonzero(pc.or_(plain, odd)).to_pylist():
                spans[i] = [dict(zip(("kind", "start", "end", "base", "value"), s)) for s in all_spans(texts[i].as_py(), odd[i].as_py())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:carry], pa.array(spans, pa.list_(struct))], [*batch.schema.names[:carry], "_spans"])

    return run


def find_spans(docs: DataFrame, text: str = "text", carry: list[str] | None = None, disguised: bool = True, out: str = "spans") -> DataFrame:
    """``carry`` columns (all by default) and an array of spans: kind, start and end in code points (end exclusive),
    whether it is a plain one (base), and its value in plain form."""
    carry = docs.columns if carry is None else carry
    frame = docs.select(*[docs[c].alias(f"_c{i}") for i, c in enumerate(carry)], docs[text].cast("string").alias("_text"))
    kinds = [f"_c{i} {frame.schema[f'_c{i}'].dataType.simpleString()}" for i in range(len(carry))]
    found = frame.mapInArrow(_find(len(carry), disguised), ", ".join([*kinds, f"_spans {SPANS}"]))
    return found.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], F.col("_spans").alias(out))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping ones together, replaced by its kind in angle brackets."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        more = F.when(s["start"] >= acc["at"], F.concat(acc["done"], gap, F.lit("<"), s["kind"], F.lit(">"))).otherwise(acc["done"])
        return F.struct(more.alias("done"), F.greatest(acc["at"], s["end"]).alias("at"))

    return F.aggregate(ordered, start, step, lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text))))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four counts and base_sha256 are of the plain spans, n_added of those in disguise; spans lists all."""
    found = find_spans(table(spark, sf_dir, "documents"), carry=["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), added)
