"""The path language's scalar functions as column builders.

Numbers are doubles. Absent values are nulls on the way in and never nulls on
the way out: each function gives what the language gives for an empty set.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def _text(s: Column) -> Column:
    return F.coalesce(s, F.lit(""))


# What numbers look like after leading white space: decimal, hexadecimal with a binary exponent, infinite.
DECIMAL = r"^[ \t\n\x0B\f\r]*([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)$"
HEXADECIMAL = r"^[ \t\n\x0B\f\r]*([+-]?)0[xX](?=\.?[0-9a-fA-F])([0-9a-fA-F]*)(?:\.([0-9a-fA-F]*))?(?:[pP]([+-]?[0-9]+))?$"
INFINITE = r"^[ \t\n\x0B\f\r]*([+-]?)(?i:inf|infinity)$"


def number(s: Column) -> Column:
    """NaN for text that is not a number as a whole, or is one out of range. White space may stand before it only."""
    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(s, pattern, i)

    plain = F.nullif(part(DECIMAL, 1), F.lit("")).try_cast("double")
    plain = F.when(F.abs(plain) < float("inf"), plain)
    digits = F.conv(F.concat(part(HEXADECIMAL, 2), part(HEXADECIMAL, 3)), 16, 10).try_cast("double")
    power = F.coalesce(part(HEXADECIMAL, 4).try_cast("double"), F.lit(0.0)) - F.length(part(HEXADECIMAL, 3)) * 4
    hexa = F.when(F.rlike(s, F.lit(HEXADECIMAL)), digits * F.pow(F.lit(2.0), power) * F.when(part(HEXADECIMAL, 1) == "-", -1.0).otherwise(1.0))
    endless = F.when(F.rlike(s, F.lit(INFINITE)), F.when(part(INFINITE, 1) == "-", float("-inf")).otherwise(float("inf")))
    return F.coalesce(plain, hexa, endless, F.lit(NAN))


def boolean(x: Column) -> Column:
    """Truth of a number: false for zero, NaN and absence."""
    return F.coalesce((x != 0) & ~F.isnan(x), F.lit(False))


def truth(s: Column) -> Column:
    """Truth of a string: false if empty."""
    return F.length(_text(s)) > 0


def negate(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def string(x: Column) -> Column:
    """A whole number without a point, any other with one digit after it."""
    whole = x == x.try_cast("bigint")
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity").when(
        F.coalesce(whole, F.lit(False)), x.try_cast("bigint").cast("string")
    ).otherwise(F.format_string("%.1f", F.bround(x, 1)))


def floor(x: Column) -> Column:
    """Cuts the fraction, also of negative numbers."""
    return F.coalesce(x.try_cast("bigint").cast("double"), x)


def ceiling(x: Column) -> Column:
    t = floor(x)
    return F.when(t == x, x).otherwise(t + 1)


def round_(x: Column) -> Column:
    return floor(x + 0.5)


def concat(*parts: Column) -> Column:
    return F.concat(*[_text(p) for p in parts])


def contains(a: Column, b: Column) -> Column:
    return F.contains(_text(a), _text(b))


def starts_with(a: Column, b: Column) -> Column:
    return F.startswith(_text(a), _text(b))


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """By bytes, with rounded positions from 1: those not before the start, and before start plus length. Nothing for
    a NaN; part of a character reads as U+FFFD."""
    raw = F.encode(_text(s), "UTF-8")
    size = F.octet_length(raw) + F.lit(1.0)
    begin = round_(start)
    end = size if length is None else begin + round_(length)
    low = F.least(F.greatest(begin, F.lit(1.0)), size)
    many = F.greatest(F.least(end, size) - low, F.lit(0.0))
    some = F.make_valid_utf8(F.substring(raw, low.cast("int"), many.cast("int")).cast("string"))
    return F.when(F.isnan(begin) | F.isnan(end), "").otherwise(some)


def substring_before(a: Column, b: Column) -> Column:
    at = F.locate(_text(b), _text(a)) if isinstance(b, str) else F.position(_text(b), _text(a))
    return F.when(at > 0, F.substring(_text(a), F.lit(1), at - 1)).otherwise("")


def substring_after(a: Column, b: Column) -> Column:
    at = F.position(_text(b), _text(a))
    return F.when(at > 0, F.substring(_text(a), at + F.length(_text(b)), F.length(_text(a)))).otherwise("")


def string_length(s: Column) -> Column:
    """In bytes."""
    return F.octet_length(_text(s))


def normalize_space(s: Column) -> Column:
    return F.trim(F.regexp_replace(_text(s), "[ \t\r\n]+", " "))


def translate(s: Column, source: str, target: str) -> Column:
    """By characters, so that no character is torn."""
    return F.translate(_text(s), source, target)


def re_match(s: Column, pattern: str) -> Column:
    return F.rlike(_text(s), F.lit(java_pattern(pattern)))


def enum_value(s: Column, values: dict[str, int]) -> Column:
    """NaN for a name that is none of the values."""
    pairs = [F.lit(x) for kv in values.items() for x in (kv[0], float(kv[1]))]
    return F.coalesce(F.create_map(*pairs)[s], F.lit(NAN))


def bit_is_set(bits: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(bits, name), F.lit(False))


def lang_matches(tag: Column, wanted: str) -> Column:
    """Whether a language tag is the wanted one or a variety of it, in any case."""
    low = F.lower(_text(tag))
    return (low == wanted.lower()) | F.startswith(low, F.lit(wanted.lower() + "-"))


def compare(a: Column, op: str, b: Column) -> Column:
    """Numbers compared on six decimals. NaN equals NaN, as its text does, and is neither less nor greater than any."""
    x, y = F.round(a, 6), F.round(b, 6)
    sides = {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}
    u, v = F.coalesce(F.isnan(a), F.lit(True)), F.coalesce(F.isnan(b), F.lit(True))
    with_nan = {"=": u & v, "!=": ~(u & v)}.get(op, F.lit(False))
    return F.when(u | v, with_nan).otherwise(sides[op])


def divide(a: Column, b: Column) -> Column:
    inf = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(NAN))
    return F.when(b == 0, inf).otherwise(a / b)


def modulo(a: Column, b: Column) -> Column:
    """With the sign of the dividend."""
    return F.when(b == 0, F.lit(NAN)).otherwise(a % b)


# What the classes of schema patterns mean, as members of a Java class, and the opposite ones.
SHORT = {"d": r"\p{Nd}", "w": r"\p{L}\p{M}\p{N}\p{S}", "i": r"\p{L}_:", "c": r"\p{L}\p{M}\p{Nd}._:\-\u00B7", "s": r" \t\n\r"}


def java_pattern(xsd: str) -> str:
    """A schema pattern as an anchored Java one. ``^`` and ``$`` are ordinary characters outside classes, the dot
    leaves out line ends, classes may subtract others, and blocks are named Is."""
    out, depth, at = [], 0, 0
    while at < len(xsd):
        c = xsd[at]
        if c == "\\" and at + 1 < len(xsd):
            n = xsd[at + 1]
            if n.lower() in SHORT:
                inside = ("^" if n.isupper() else "") + SHORT[n.lower()]
                out.append(SHORT[n] if depth and n.islower() else f"[{inside}]")
            elif n in "pP" and xsd[at + 2 : at + 5] == "{Is":
                out.append(f"\\{n}{{In")
                at += 3
            else:
                out.append(c + n)
            at += 2
            continue
        if depth and c == "-" and xsd[at + 1 : at + 2] == "[":
            positive = xsd[at + 2 : at + 3] == "^"
            out.append("&&[" if positive else "&&[^")
            depth, at = depth + 1, at + (3 if positive else 2)
            continue
        if c == "[":
            depth += 1
        elif c == "]" and depth:
            depth -= 1
        elif not depth and c in "^$":
            c = "\\" + c
        elif not depth and c == ".":
            c = r"[^\n\r]"
        elif depth and c == "&":
            c = r"\&"
        out.append(c)
        at += 1
    return rf"\A(?:{''.join(out)})\z"


def true_() -> Column:
    return F.lit(True)


def false_() -> Column:
    return F.lit(False)


def local_name(name: Column) -> Column:
    """The part after the prefix; nothing for no node."""
    return _text(F.substring_index(name, ":", -1))


def qualified_name(name: Column, module: Column) -> Column:
    """Prefix and name; a name without a prefix takes its module's."""
    return _text(F.when(F.contains(name, F.lit(":")), name).otherwise(F.concat(module, F.lit(":"), name)))


def namespace_uri(name: Column, module: Column, namespaces: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in namespaces.items() for x in kv]
    prefix = F.when(F.contains(name, F.lit(":")), F.substring_index(name, ":", 1)).otherwise(module)
    return _text(F.create_map(*pairs)[prefix])
