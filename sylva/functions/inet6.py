"""IPv6 addresses as columns: eight groups of sixteen bits, one canonical text, keys that sort as the addresses do.

The canonical text is in lower case without leading zeros; the first of the
longest runs of two or more zero groups becomes ``::``. Addresses that map or hold
an IPv4 address end in its four octets. A null text gives nulls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import _address, _dotted, _stored

_SIDE = r"^([0-9a-fA-F]{1,4}(:[0-9a-fA-F]{1,4})*)?$"


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``x``, which is computed once however often it stands there."""
    return F.transform(F.array(x), body)[0]


def groups(s: Column) -> Column:
    """The eight numbers of an address without a zone, or null if it is none."""
    def parsed(t: Column) -> Column:
        short = F.contains(t, F.lit("::"))
        left = F.when(short, F.substring_index(t, "::", 1)).otherwise(t)
        right = F.when(short, F.substring(t, F.length(left) + 3, F.length(t))).otherwise(F.lit(""))

        def numbers(side: Column) -> Column:
            return F.transform(F.filter(F.split(side, ":"), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("int"))

        def whole(a: Column) -> Column:
            return _let(numbers(right), lambda b: F.when(
                F.when(short, F.size(a) + F.size(b) < 8).otherwise(F.size(a) == 8),
                F.concat(a, F.array_repeat(F.lit(0), 8 - F.size(a) - F.size(b)), b),
            ))

        good = F.rlike(left, F.lit(_SIDE)) & F.rlike(right, F.lit(_SIDE)) & F.contains(t, F.lit(":"))
        return F.when(good, _let(numbers(left), whole))

    tail = F.substring_index(s, ":", -1)
    ok, number = _address(tail)
    low = F.concat_ws(":", F.hex(F.floor(number / 65536)), F.hex(number % 65536))
    head = F.substring(s, F.lit(1), F.length(s) - F.length(tail))
    return _let(F.when(F.contains(tail, F.lit(".")), F.when(ok, F.concat(head, low))).otherwise(s), parsed)


def text(g: Column) -> Column:
    """The canonical text of eight numbers."""
    dotted = _dotted(g[6].cast("bigint") * 65536 + g[7])

    def squeezed(t: Column) -> Column:
        # Between colons a run of zero groups is a run of ":0"; longer runs are looked for first.
        out = F.substring(t, F.lit(2), F.length(t) - 2)
        for n in range(2, 9):
            at = F.instr(t, ":0" * n + ":")
            before, after = F.substring(t, F.lit(2), F.greatest(at - 2, F.lit(0))), F.substring(t, at + 2 * n + 1, F.length(t))
            out = F.when(at > 0, F.concat(before, F.lit("::"), F.regexp_replace(after, ":$", ""))).otherwise(out)
        return out

    plain = _let(F.concat(F.lit(":"), F.array_join(F.transform(g, lambda x: F.lower(F.hex(x))), ":"), F.lit(":")), squeezed)
    none = F.forall(F.slice(g, 1, 5), lambda x: x == 0)
    return F.when(none & (g[5] == 0xFFFF), F.concat(F.lit("::ffff:"), dotted)).when(
        none & (g[5] == 0) & (g[6] != 0), F.concat(F.lit("::"), dotted)
    ).otherwise(plain)


def store_ipv6_address(s: Column, zone: bool = True) -> Column:
    """An address, with whatever zone after the first % kept as it is; with ``zone`` off there must be none."""
    g = groups(F.substring_index(s, "%", 1))
    tail = F.substring(s, F.length(F.substring_index(s, "%", 1)) + 1, F.length(s))
    canon = _let(g, lambda x: F.when(x.isNotNull(), F.concat(text(x), tail)))
    ok = ~F.contains(s, F.lit("%")) | F.lit(zone)
    return _stored(canon, canon.isNotNull() & ok, "not a valid ipv6-address")


def store_ipv6_prefix(s: Column) -> Column:
    """Address and length; the bits beyond the length become zero."""
    bits = F.regexp_extract(s, "/([0-9]{1,2}|1[01][0-9]|12[0-8])$", 1).try_cast("int")

    def cut(x: Column, i: Column) -> Column:
        return (x - x % F.pow(F.lit(2.0), 16 - F.greatest(F.lit(0), F.least(F.lit(16), bits - i * 16)))).cast("int")

    canon = _let(groups(F.substring_index(s, "/", 1)), lambda g: F.when(g.isNotNull(), _let(F.transform(g, cut), text)))
    one = F.length(s) - F.length(F.replace(s, F.lit("/"), F.lit(""))) == 1
    return _stored(F.concat(canon, F.lit("/"), bits.cast("string")), canon.isNotNull() & bits.isNotNull() & one, "not a valid ipv6-prefix")


def sort_key(canon: Column) -> Column:
    """Bytes whose order is that of addresses, then of prefix lengths, then of zones, none first."""
    address = F.regexp_extract(canon, "^[^%/]*", 0)
    octets = F.unhex(F.array_join(F.transform(groups(address), lambda x: F.lpad(F.hex(x), 4, "0")), ""))
    length = F.coalesce(F.regexp_extract(canon, "/([0-9]+)$", 1).try_cast("int"), F.lit(0))
    zone = F.regexp_extract(canon, "%.*$", 0)
    return F.concat(octets, F.unhex(F.lpad(F.hex(length), 2, "0")), F.encode(zone, "UTF-8"))
