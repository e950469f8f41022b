"""Order-preserving packed keys, transaction stamps and name codes, as columns.

Composite keys are packed most significant part first, so the order of packed
keys is the order of their parts.  All packed keys here stay below 2^63.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of each part of a packed key, most significant first.
LAYOUTS = {
    "district": (("w_id", 32), ("d_id", 4)),
    "customer": (("w_id", 32), ("d_id", 4), ("c_id", 16)),
    "stock": (("w_id", 32), ("i_id", 24)),
    "orders": (("w_id", 27), ("d_id", 4), ("o_id", 32)),
    "order_line": (("w_id", 23), ("d_id", 4), ("o_id", 32), ("ol_number", 4)),
    "customer_name": (("w_id", 17), ("d_id", 4), ("last", 10), ("first", 16), ("c_id", 16)),
}
#: Syllables of generated last names, by digit.
SYLLABLES = ("BAR", "OUGHT", "ABLE", "PRI", "PRES", "ESE", "ANTI", "CALLY", "ATION", "EING")
#: Bits of a stamp's transaction start and worker; one more bit says invalid.
STAMP_START_BITS, STAMP_WORKER_BITS = 48, 15


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pack(layout: str, **parts: Column | str) -> Column:
    out = F.lit(0).cast("long")
    for name, bits in LAYOUTS[layout]:
        out = F.shiftleft(out, bits).bitwiseOR(_col(parts[name]).cast("long"))
    return out


def unpack(layout: str, key: Column | str) -> dict[str, Column]:
    out, shift = {}, 0
    for name, bits in reversed(LAYOUTS[layout]):
        out[name] = F.shiftrightunsigned(_col(key), shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("long")
        shift += bits
    return dict(reversed(out.items()))


def prefix_bounds(layout: str, n: int, **parts: Column | str) -> tuple[Column, Column]:
    """Smallest and largest key whose first ``n`` parts are the given ones."""
    low = high = F.lit(0).cast("long")
    for i, (name, bits) in enumerate(LAYOUTS[layout]):
        lo = hi = _col(parts[name]).cast("long") if i < n else None
        if lo is None:
            lo, hi = F.lit(0).cast("long"), F.lit((1 << bits) - 1)
        low, high = F.shiftleft(low, bits).bitwiseOR(lo), F.shiftleft(high, bits).bitwiseOR(hi)
    return low, high


def zone_encode(value: Column | str) -> Column:
    """Signed order to unsigned order: the sign bit is flipped."""
    return _col(value).cast("long").bitwiseXOR(F.lit(-(1 << 63)))


def stamp_pack(invalid: Column | str, worker: Column | str, ts_start: Column | str) -> Column:
    """(invalid:1, worker:15, ts_start:48); invalid stamps are negative longs."""
    head = F.shiftleft(_col(invalid).cast("int").cast("long"), STAMP_START_BITS + STAMP_WORKER_BITS)
    return head.bitwiseOR(F.shiftleft(_col(worker).cast("long"), STAMP_START_BITS)).bitwiseOR(_col(ts_start).cast("long"))


def stamp_unpack(stamp: Column | str) -> tuple[Column, Column, Column]:
    s = _col(stamp)
    worker = F.shiftrightunsigned(s, STAMP_START_BITS).bitwiseAND(F.lit((1 << STAMP_WORKER_BITS) - 1))
    return s < 0, worker, s.bitwiseAND(F.lit((1 << STAMP_START_BITS) - 1))


def last_name(code: Column | str) -> Column:
    """The name of a code from 0 to 999: one syllable for each decimal digit."""
    n, names = _col(code).cast("int"), F.array(*map(F.lit, SYLLABLES))
    digit = lambda d: F.element_at(names, F.pmod(F.floor(n / d), F.lit(10)).cast("int") + 1)
    return F.concat(digit(100), digit(10), digit(1))


def first_name_code(name: Column | str) -> Column:
    """The first three characters as digits in base 36, small letters as capitals
    and all others as 0: names sort about as their codes do."""
    head = F.rpad(F.regexp_replace(F.substring(_col(name), 1, 3), "[^0-9A-Za-z]", "0"), 3, "0")
    return F.conv(F.upper(head), 36, 10).cast("long")


def field_patch(row: Column | str, index: Column | int, width: int, new: Column | str) -> Column:
    """A fixed-width field of a row replaced: characters [i*width, (i+1)*width)."""
    at = (index if isinstance(index, Column) else F.lit(index)) * width + 1
    return F.overlay(_col(row), _col(new), at, F.lit(width))
