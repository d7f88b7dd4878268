"""Addresses as columns.

An address is ``(family INT, hi BIGINT, lo BIGINT)``: IPv4 sits in ``lo`` with
``hi = 0``; IPv6 fills both signed halves. Halves are only compared with ``=``
and ``&``, never with ``<``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

V4_ALL = 0xFFFFFFFF


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= (1 << 63) else value


def mask_halves(family: int, length: int) -> tuple[int, int]:
    """(mask_hi, mask_lo) of a literal prefix length, clamped to the family."""
    if family == 4:
        length = max(0, min(32, length))
        return 0, (V4_ALL << (32 - length)) & V4_ALL
    length = max(0, min(128, length))
    mask = ((1 << 128) - 1) ^ ((1 << (128 - length)) - 1)
    return _signed(mask >> 64), _signed(mask & ((1 << 64) - 1))


def width(family: Column) -> Column:
    return F.when(family == 4, F.lit(32)).otherwise(F.lit(128))


def _shifted_ones(bits: Column) -> Column:
    """All ones moved left by 0..63 bits."""
    return F.call_function("shiftleft", F.lit(-1).cast("bigint"), bits)


def mask_hi(family: Column, length: Column) -> Column:
    length = length.cast("int")
    return (
        F.when((family == 4) | (length <= 0), F.lit(0).cast("bigint"))
        .when(length >= 64, F.lit(-1).cast("bigint"))
        .otherwise(_shifted_ones(64 - length))
    )


def mask_lo(family: Column, length: Column) -> Column:
    length = length.cast("int")
    v4 = F.when(length <= 0, F.lit(0).cast("bigint")).otherwise(
        _shifted_ones(32 - F.least(length, F.lit(32))).bitwiseAND(F.lit(V4_ALL))
    )
    v6 = (
        F.when(length <= 64, F.lit(0).cast("bigint"))
        .when(length >= 128, F.lit(-1).cast("bigint"))
        .otherwise(_shifted_ones(128 - length))
    )
    return F.when(family == 4, v4).otherwise(v6)


def masked(family: Column, hi: Column, lo: Column, length: Column) -> tuple[Column, Column]:
    """The network halves an address falls in at ``length``."""
    return hi.bitwiseAND(mask_hi(family, length)), lo.bitwiseAND(mask_lo(family, length))


def contains(family: Column, net_hi: Column, net_lo: Column, length: Column,
             other_family: Column, hi: Column, lo: Column) -> Column:
    """Whether the network holds the address. A length past the family holds nothing."""
    own_hi, own_lo = masked(family, net_hi, net_lo, length)
    its_hi, its_lo = masked(family, hi, lo, length)
    return (family == other_family) & (length <= width(family)) & (own_hi == its_hi) & (own_lo == its_lo)


# --- text -------------------------------------------------------------------


def ipv4_text(lo: Column) -> Column:
    octet = lambda bits: F.shiftright(lo, bits).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", octet(24), octet(16), octet(8), octet(0))


def _hextets(half: Column) -> list[Column]:
    return [F.shiftrightunsigned(half, bits).bitwiseAND(F.lit(0xFFFF)) for bits in (48, 32, 16, 0)]


def ipv6_text(hi: Column, lo: Column) -> Column:
    """Canonical text: lower case, longest run of two or more zero groups folded."""
    full = F.concat_ws(":", *[F.lower(F.hex(h)) for h in _hextets(hi) + _hextets(lo)])
    mapped = (hi == 0) & (F.shiftrightunsigned(lo, 32) == 0xFFFF)
    return F.when(mapped, F.concat(F.lit("::ffff:"), ipv4_text(lo))).otherwise(let(full, _fold_zeros))


def _fold_zeros(full: Column) -> Column:
    text = full
    for run in range(2, 9):
        pattern = "^(.*?)(?:^|:)0(?::0){%d}(?:$|:)(.*)$" % (run - 1)
        text = F.when(full.rlike(pattern), F.regexp_replace(full, pattern, "$1::$2")).otherwise(text)
    return text


def address_text(family: Column, hi: Column, lo: Column) -> Column:
    return F.when(family == 4, ipv4_text(lo)).otherwise(ipv6_text(hi, lo))


def _parse_v4(text: Column) -> Column:
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    parts = F.split(text, r"\.")
    number = F.lit(0).cast("bigint")
    for i in range(4):
        number = number * 256 + F.try_element_at(parts, F.lit(i + 1)).try_cast("bigint")
    return F.when(text.rlike("^" + r"\.".join([octet] * 4) + "$"), number)


def _half_of(groups: Column) -> Column:
    """Fold four hexadecimal groups into one signed half."""
    return F.aggregate(
        groups,
        F.lit(0).cast("bigint"),
        lambda acc, g: F.shiftleft(acc, 16).bitwiseOR(F.conv(g, 16, 10).cast("bigint")),
    )


def parse_address(text: Column) -> Column:
    """Text to ``struct(family, hi, lo)``; NULL when it is not an address."""
    return let(F.lower(F.trim(text)), _parse_trimmed)


def _parse_trimmed(text: Column) -> Column:
    value4 = let(_parse_v4(text), lambda v4: F.when(v4.isNotNull(), F.struct(
        F.lit(4).alias("family"), F.lit(0).cast("bigint").alias("hi"), v4.alias("lo"))))
    return F.when(F.instr(text, ":") > 0, let(_plain_v6(text), _parse_v6)).otherwise(value4)


def _plain_v6(text: Column) -> Column:
    """A dotted tail stands for two groups; without one the text stays."""
    tail = let(_parse_v4(F.regexp_extract(text, r"^.*:([^:]*)$", 1)), lambda n: F.concat(
        F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(F.lit(0xFFFF))))))
    return F.when(F.instr(text, ".") == 0, text).otherwise(F.concat(F.regexp_extract(text, r"^(.*:)[^:]*$", 1), tail))


def _parse_v6(v6: Column) -> Column:
    folded = F.instr(v6, "::") > 0
    side = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    left = side(F.substring_index(v6, "::", 1))
    right = F.when(folded, side(F.substring_index(v6, "::", -1))).otherwise(F.array().cast("array<string>"))
    halves = F.struct(left.alias("l"), right.alias("r"))

    def assemble(h: Column) -> Column:
        missing = F.lit(8) - F.size(h["l"]) - F.size(h["r"])
        padding = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)))
        return F.when(F.when(folded, missing >= 1).otherwise(missing == 0), F.concat(h["l"], padding, h["r"]))

    def value(groups: Column) -> Column:
        legal = F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$")) & ~v6.rlike(":::|::.*::|^:[^:]|[^:]:$")
        return F.when(legal, F.struct(
            F.lit(6).alias("family"), _half_of(F.slice(groups, 1, 4)).alias("hi"),
            _half_of(F.slice(groups, 5, 4)).alias("lo")))

    return let(let(halves, assemble), value)


def unmap(address: Column) -> Column:
    """An IPv4-mapped IPv6 address as the IPv4 one it stands for."""
    def plain(a: Column) -> Column:
        mapped = (a["family"] == 6) & (a["hi"] == 0) & (F.shiftrightunsigned(a["lo"], 32) == 0xFFFF)
        v4 = F.struct(F.lit(4).alias("family"), F.lit(0).cast("bigint").alias("hi"),
                      a["lo"].bitwiseAND(F.lit(V4_ALL)).alias("lo"))
        return F.when(mapped, v4).otherwise(a)

    return let(address, plain)


def parse_cidr(text: Column) -> Column:
    """``network/length`` to ``struct(family, hi, lo, prefix_len)``; NULL when malformed."""
    length = F.when(text.rlike("^[^/]+/[0-9]{1,3}$"), F.substring_index(text, "/", -1).try_cast("int"))
    return let(parse_address(F.substring_index(text, "/", 1)), lambda a: F.when(
        a.isNotNull() & length.isNotNull(),
        F.struct(a["family"].alias("family"), a["hi"].alias("hi"), a["lo"].alias("lo"), length.alias("prefix_len"))))
