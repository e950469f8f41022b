"""Packed keys, stamps, names and interval algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..functions import keys
from .registry import register

_PARTS = "l_suppkey % 8 AS w_id, l_partkey % 10 AS d_id, l_orderkey AS o_id, l_linenumber::bigint AS ol_number"
_PACK = "((((((w_id << 4) | d_id) << 32) | o_id) << 4) | ol_number)"


def _parts(t):
    return t("lineitem").select((F.col("l_suppkey") % 8).alias("w_id"), (F.col("l_partkey") % 10).alias("d_id"), F.col("l_orderkey").alias("o_id"), F.col("l_linenumber").cast("long").alias("ol_number"))


@register("pack_order_line_key", "PRJ-01 SRC-06", f"SELECT w_id, d_id, o_id, ol_number, {_PACK} AS packed FROM (SELECT {_PARTS} FROM lineitem)")
def pack_order_line_key(t):
    names = ("w_id", "d_id", "o_id", "ol_number")
    return _parts(t).withColumn("packed", keys.pack("order_line", **{n: n for n in names}))


@register("unpack_order_line_key", "PRJ-01", f"SELECT {_PARTS}, l_orderkey = o AS same FROM (SELECT *, l_orderkey AS o FROM lineitem)")
def unpack_order_line_key(t):
    """Parts read back from packed keys."""
    names = ("w_id", "d_id", "o_id", "ol_number")
    packed = _parts(t).select(keys.pack("order_line", **{n: n for n in names}).alias("k"), F.col("o_id").alias("o"))
    back = keys.unpack("order_line", "k")
    return packed.select(*(back[n].alias(n) for n in names), (back["o_id"] == F.col("o")).alias("same"))


@register("order_key_bounds", "SRC-02 RD-20", "SELECT o_orderkey AS o_id, (((3::bigint << 4 | 2) << 32) | o_orderkey) << 4 AS lo, ((((3::bigint << 4 | 2) << 32) | o_orderkey) << 4) | 15 AS hi FROM orders")
def order_key_bounds(t):
    """Key range of all lines of an order."""
    lo, hi = keys.prefix_bounds("order_line", 3, w_id=F.lit(3), d_id=F.lit(2), o_id="o_orderkey")
    return t("orders").select(F.col("o_orderkey").alias("o_id"), lo.alias("lo"), hi.alias("hi"))


@register("zone_encode_signed", "FLT-09", "SELECT v, xor(v, (-9223372036854775808)::bigint) AS z FROM (SELECT o_orderkey - 5000 AS v FROM orders)")
def zone_encode_signed(t):
    return t("orders").select((F.col("o_orderkey") - 5000).alias("v")).withColumn("z", keys.zone_encode("v"))


@register("stamp_pack_unpack", "SRC-04", "SELECT event_id, event_type = 'error' AS invalid, user_id % 32768 AS worker, event_id * 10 AS ts_start, CASE WHEN event_type = 'error' THEN (-9223372036854775808)::bigint ELSE 0 END | ((user_id % 32768) << 48) | (event_id * 10) AS stamp FROM events")
def stamp_pack_unpack(t):
    """A stamp and what is read back from it."""
    rows = t("events").select("event_id", keys.stamp_pack(F.col("event_type") == "error", F.col("user_id") % 32768, F.col("event_id") * 10).alias("stamp"))
    invalid, worker, start = keys.stamp_unpack("stamp")
    return rows.select("event_id", invalid.alias("invalid"), worker.alias("worker"), start.alias("ts_start"), "stamp")


@register("last_name_from_code", "RNG", "WITH s AS (SELECT ['BAR','OUGHT','ABLE','PRI','PRES','ESE','ANTI','CALLY','ATION','EING'] AS n) SELECT c AS code, n[c // 100 + 1] || n[c // 10 % 10 + 1] || n[c % 10 + 1] AS name FROM s, range(0, 1000) r(c)")
def last_name_from_code(t):
    codes = t.spark.range(1000).select(F.col("id").alias("code"))
    return codes.withColumn("name", keys.last_name("code"))


@register("field_patch", "PRJ-03", "SELECT event_id, substr(rpad(event_type, 12, '.') || rpad(props, 12, '.'), 1, 4) || 'XXXX' || substr(rpad(event_type, 12, '.') || rpad(props, 12, '.'), 9) AS patched FROM events")
def field_patch(t):
    """Field 1 of rows of 4-character fields replaced."""
    row = F.concat(F.rpad("event_type", 12, "."), F.rpad("props", 12, "."))
    return t("events").select("event_id", keys.field_patch(row, 1, 4, F.lit("XXXX")).alias("patched"))


_A = "SELECT o_orderkey AS id, o_orderkey % 1000 AS lo, o_orderkey % 1000 + o_custkey % 50 AS hi FROM orders"
_B = "SELECT s_suppkey AS id, s_suppkey * 9 AS lo, s_suppkey * 9 + 20 AS hi FROM supplier"


def _a(t):
    k = F.col("o_orderkey")
    return t("orders").select(k.alias("a"), (k % 1000).alias("alo"), (k % 1000 + F.col("o_custkey") % 50).alias("ahi"))


def _b(t):
    k = F.col("s_suppkey")
    return t("supplier").select(k.alias("b"), (k * 9).alias("blo"), (k * 9 + 20).alias("bhi"))


GRID = 64


def overlap_join(a, b, width: int = GRID):
    """Pairs of overlapping intervals, by an equi-join on grid cells: both sides
    are laid out over the cells they touch, and a pair counts in the cell where
    its intersection starts, so it comes out once."""
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    left, right = a.withColumn("_c", cells("alo", "ahi")), b.withColumn("_c", cells("blo", "bhi"))
    x, y = (F.col("alo"), F.col("ahi")), (F.col("blo"), F.col("bhi"))
    return left.join(right, "_c").where(iv.overlaps(x, y) & (F.floor(F.greatest("alo", "blo") / width) == F.col("_c"))).drop("_c")


@register("interval_overlap_join", "FLT-03", f"SELECT a.id AS a, b.id AS b FROM ({_A}) a JOIN ({_B}) b ON a.lo <= b.hi AND b.lo <= a.hi")
def interval_overlap_join(t):
    return overlap_join(_a(t), _b(t)).select("a", "b")


def superseded(children, node: str, at: str, lo: str, hi: str, width: int = GRID):
    """(node, at) of children that a later one of their node overlaps: both are
    laid out over the cells they touch, so only neighbours meet."""
    cell = F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))).alias("_c")
    a = children.select(node, at, F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), cell)
    b = children.select(F.col(node).alias("_node"), F.col(at).alias("_at"), F.col(lo).alias("_blo"), F.col(hi).alias("_bhi"), cell.alias("_d"))
    meets = (F.col(node) == F.col("_node")) & (F.col("_c") == F.col("_d")) & (F.col("_at") > F.col(at))
    return a.join(b, meets & (F.col("_lo") <= F.col("_bhi")) & (F.col("_blo") <= F.col("_hi")), "left_semi").select(node, at).distinct()


_KIDS = "m AS (SELECT max(o_orderkey) + 1 AS m FROM orders), kids AS (SELECT o_custkey % 50 AS node, o_orderkey AS pos, o_orderkey * 37 % m AS lo, o_orderkey * 37 % m + o_custkey % 40 AS hi FROM orders, m WHERE o_orderkey <= m * 3 // 4)"


@register("active_children", "JN-10", "WITH " + _KIDS + " SELECT node, pos, lo, hi FROM kids a WHERE NOT EXISTS (SELECT 1 FROM kids b WHERE b.node = a.node AND b.pos > a.pos AND a.lo <= b.hi AND b.lo <= a.hi)")
def active_children(t):
    """Children that were there at a time, without those that a later child of
    the same node overlaps."""
    k = F.col("o_orderkey")
    top = t("orders").agg((F.max("o_orderkey") + 1).alias("m"))  # one row
    kids = t("orders").crossJoin(F.broadcast(top)).where(k <= F.floor(F.col("m") * 3 / 4))
    kids = kids.select((F.col("o_custkey") % 50).alias("node"), k.alias("pos"), (k * 37 % F.col("m")).alias("lo"), (k * 37 % F.col("m") + F.col("o_custkey") % 40).alias("hi"))
    gone = superseded(kids, "node", "pos", "lo", "hi")
    return kids.join(gone, ["node", "pos"], "left_anti").select("node", "pos", "lo", "hi")


@register("interval_intersection", "FLT-05", f"SELECT a.id AS a, b.id AS b, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM ({_A}) a JOIN ({_B}) b ON a.lo <= b.hi AND b.lo <= a.hi")
def interval_intersection(t):
    lo, hi = iv.intersection((F.col("alo"), F.col("ahi")), (F.col("blo"), F.col("bhi")))
    return overlap_join(_a(t), _b(t)).select("a", "b", lo.alias("lo"), hi.alias("hi"))


@register("interval_hull", "FLT-06", f"SELECT a.id AS a, min(least(a.lo, b.lo)) AS lo, max(greatest(a.hi, b.hi)) AS hi FROM ({_A}) a JOIN ({_B}) b ON a.lo <= b.hi AND b.lo <= a.hi GROUP BY a.id")
def interval_hull(t):
    """Each interval grown over all that overlap it."""
    lo, hi = iv.hull((F.col("alo"), F.col("ahi")), (F.col("blo"), F.col("bhi")))
    return overlap_join(_a(t), _b(t)).groupBy("a").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"))


@register("interval_cover", "FLT-04", f"SELECT b.id AS b, a.id AS a FROM ({_A}) a JOIN ({_B}) b ON b.lo <= a.lo AND a.hi <= b.hi")
def interval_cover(t):
    return overlap_join(_a(t), _b(t)).where(iv.covers((F.col("blo"), F.col("bhi")), (F.col("alo"), F.col("ahi")))).select("b", "a")


@register("interval_half_open", "FLT-07", "SELECT o_orderkey AS start, o_custkey AS stop, greatest(o_orderkey, o_custkey - 1) AS hi FROM orders")
def interval_half_open(t):
    lo, hi = iv.from_half_open(F.col("o_orderkey"), F.col("o_custkey"))
    return t("orders").select(lo.alias("start"), F.col("o_custkey").alias("stop"), hi.alias("hi"))


@register(
    "range_split_even",
    "RD-13 GEN-03",
    "WITH s AS (SELECT o_orderkey AS lo, o_orderkey + o_custkey % 20 AS hi FROM orders), n AS (SELECT *, least(7, hi - lo + 1) AS n FROM s) SELECT lo AS of_lo, hi AS of_hi, lo + (i * (hi - lo + 1)) // n AS lo, lo + ((i + 1) * (hi - lo + 1)) // n - 1 AS hi FROM n, LATERAL (SELECT unnest(range(0, n)) AS i)",
)
def range_split_even(t):
    """Pieces of key ranges: no gap, no overlap, none empty."""
    rows = t("orders").select(F.col("o_orderkey").alias("of_lo"), (F.col("o_orderkey") + F.col("o_custkey") % 20).alias("of_hi"))
    return rows.select("of_lo", "of_hi", F.explode(iv.split_even(F.col("of_lo"), F.col("of_hi"), 7)).alias("p")).select("of_lo", "of_hi", "p.lo", "p.hi")
