"""Network addresses as Column expressions."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _v4_hex(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, r"\."), lambda o: F.lower(F.lpad(F.hex(o.cast("int")), 2, "0"))), "")


def ip_hex(c: Column | str) -> Column:
    """The address in hexadecimal, 8 digits for IPv4 and 32 for IPv6; null for anything else.

    All notations of an address give the same result: any letter case, outer
    blanks, leading zeros (octets are decimal), ``::`` anywhere, a dotted tail,
    brackets and a zone index; an IPv4-mapped IPv6 address is the IPv4 one.
    """
    c = F.col(c) if isinstance(c, str) else c

    def six(v: Column) -> Column:
        tail = F.regexp_extract(v, rf"({_V4})$", 1)
        hexed = let(tail, lambda t: F.when(t == "", v).otherwise(let(_v4_hex(t), lambda h: F.concat(F.substring(v, 1, F.length(v) - F.length(t)), F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 4)))))

        def groups(h: Column) -> Column:
            halves = F.split(h, "::", -1)
            part = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":", -1), lambda g: g != "")
            missing = 8 - F.size(part(0)) - F.size(part(1))
            return (
                F.when((F.size(halves) == 1) & ~h.rlike("^:|:$"), F.split(h, ":", -1))
                .when((F.size(halves) == 2) & (missing >= 1) & ~h.rlike("^:[^:]|[^:]:$|:::"), F.concat(part(0), F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), part(1)))
            )

        def joined(g: Column) -> Column:
            ok = (F.size(g) == 8) & F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$"))
            return F.when(ok, let(F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), ""), lambda f: F.when(f.startswith("0" * 20 + "ffff"), F.substring(f, 25, 8)).otherwise(f)))

        return let(groups(hexed), joined)

    bare = F.regexp_replace(F.lower(c), r"^[\s\[]+|%.*$|[\s\]]+$", "")
    return let(bare, lambda v: F.when(v.rlike(f"^{_V4}$"), F.lower(_v4_hex(v))).when(v.contains(":") & (F.length(v) <= 60), F.lower(six(v))))


def python_hex(address: str) -> str:
    """``ip_hex`` of a constant."""
    a = ipaddress.ip_address(address)
    return (getattr(a, "ipv4_mapped", None) or a).packed.hex()


def private_hex(h: Column) -> Column:
    """Whether an address in the form of ``ip_hex`` is private: RFC 1918, link-local 169.254/16 or fc00::/7."""
    v4 = F.length(h) == 8
    ten = h.startswith("0a") | h.startswith("c0a8") | h.startswith("a9fe") | (h.startswith("ac") & F.substring(h, 3, 2).between("10", "1f"))
    return F.coalesce((v4 & ten) | (~v4 & (h.startswith("fc") | h.startswith("fd"))), F.lit(False))


def is_private(c: Column | str) -> Column:
    """Whether an address is private. Anything that is no address isn't."""
    return let(ip_hex(c), private_hex)


def _prefix_bits(mask: Column) -> Column:
    """The length of a prefix, written as a number or as a dotted mask; null for masks with gaps."""
    bits = F.lpad(F.conv(_v4_hex(mask), 16, 2), 32, "0")
    return F.when(mask.rlike(r"^\d{1,3}$"), mask.cast("int")).when(mask.rlike(f"^{_V4}$") & bits.rlike("^1*0*$"), F.length(F.rtrim(bits, F.lit("0"))))


def cidr(c: Column | str) -> Column:
    """A network as a struct of its least and greatest address (``lo``, ``hi``, as ``ip_hex`` gives them) and its prefix length ``bits``.

    Host bits that are set don't matter, a bare address is a network of itself, the
    mask may be dotted. Null for anything else, also for masks that are too long.
    """
    c = F.col(c) if isinstance(c, str) else c
    part = lambda i: F.get(F.split(F.trim(c), "/", -1), F.lit(i))

    def of(x: Column) -> Column:
        h, size = x["h"], F.length(x["h"]) * 4
        bits = F.when(x["m"].isNull(), size).otherwise(_prefix_bits(x["m"]))
        full, rest = F.floor(bits / 4).cast("int"), F.pmod(bits, F.lit(4))
        unit = F.element_at(F.array(*(F.lit(v) for v in (16, 8, 4, 2))), rest.cast("int") + 1)
        digit = F.conv(F.substr(h, full + 1, F.lit(1)), 16, 10).cast("int")
        low = digit - F.pmod(digit, unit)
        head = F.substr(h, F.lit(1), full)
        fill = lambda d, pad: F.when(full * 4 >= size, h).otherwise(F.rpad(F.concat(head, F.lower(F.hex(d))), (size / 4).cast("int"), pad))
        return F.when((F.size(F.split(F.trim(c), "/", -1)) <= 2) & (bits <= size), F.struct(fill(low, "0").alias("lo"), fill(low + unit - 1, "f").alias("hi"), bits.cast("int").alias("bits")))

    return let(F.struct(ip_hex(part(0)).alias("h"), part(1).alias("m")), of)


def hex_address(h: Column) -> Column:
    """An address in the form of ``ip_hex`` as it is usually written: dotted, or in eight groups without leading zeros."""
    v4 = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10)), ".")
    v6 = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substr(h, i * 4 + 1, F.lit(4)), "^0{1,3}", "")), ":")
    return F.when(F.length(h) == 8, v4).when(F.length(h) == 32, v6)


def network(c: Column | str) -> Column:
    """A network in one notation: its least address and the length of its prefix."""
    return let(cidr(c), lambda n: F.concat(hex_address(n["lo"]), F.lit("/"), n["bits"].cast("string")))


def is_gateway(c: Column | str) -> Column:
    """Whether an IPv4 address ends in 1 or 254, as gateways usually do."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.rlike(r"^\d+\.\d+\.\d+\.(?:1|254)$"), F.lit(False))
