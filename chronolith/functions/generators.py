"""Deterministic populations: every value is a hash of its row's number."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .keys import first_name_code, last_name

#: Region names by key, and (nation, region key) by nation key.
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
NATIONS = (
    ("ALGERIA", 0), ("ARGENTINA", 1), ("BRAZIL", 1), ("CANADA", 1), ("EGYPT", 4), ("ETHIOPIA", 0), ("FRANCE", 3), ("GERMANY", 3), ("INDIA", 2),
    ("INDONESIA", 2), ("IRAN", 4), ("IRAQ", 4), ("JAPAN", 2), ("JORDAN", 4), ("KENYA", 0), ("MOROCCO", 0), ("MOZAMBIQUE", 0), ("PERU", 1),
    ("CHINA", 2), ("ROMANIA", 3), ("SAUDI ARABIA", 4), ("VIETNAM", 2), ("RUSSIA", 3), ("UNITED KINGDOM", 3), ("UNITED STATES", 1),
)
#: Milliseconds of the initial order history, share of undelivered orders.
HISTORY_MS, UNDELIVERED = 30 * 24 * 3600 * 1000, 0.3
#: 64-bit FNV-1a.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
#: Operation shares of the key-value workloads.
MIXES = {
    "a": {"read": 0.5, "update": 0.5},
    "b": {"read": 0.95, "update": 0.05},
    "c": {"read": 1.0},
    "d": {"read": 0.95, "insert": 0.05},
    "e": {"insert": 0.05, "scan": 0.95},
    "f": {"read": 0.5, "read_modify_write": 0.5},
}


def uniform(*parts: Column, seed: int = 0) -> Column:
    """A draw in [0, 1) that depends on its parts alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 40)) / F.lit(float(1 << 40))


def between(lo: int, hi: int, *parts: Column, seed: int = 0) -> Column:
    return (F.lit(lo) + F.floor(uniform(*parts, seed=seed) * (hi - lo + 1))).cast("long")


def nurand(a: int, lo: int, hi: int, c: int, *parts: Column, seed: int = 0) -> Column:
    """Non-uniform random: ((draw(0, a) | draw(lo, hi)) + c) mod (hi - lo + 1) + lo."""
    return nurand_of(between(0, a, *parts, seed=seed), between(lo, hi, *parts, seed=seed + 1), lo, hi, c)


def nurand_of(a: Column, x: Column, lo: int, hi: int, c: int) -> Column:
    """The same of two draws, a from 0 and x from lo to hi."""
    return (a.bitwiseOR(x) + c) % (hi - lo + 1) + lo


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(REGIONS)), "r_id long, r_name string")


def nations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, r) for i, (n, r) in enumerate(NATIONS)], "n_id long, n_name string, n_regionkey long")


def supplier_of(w_id: Column, i_id: Column, suppliers: int) -> Column:
    return (w_id * i_id) % suppliers


def order_date(anchor_ms: int, ordinal: Column, count: int) -> Column:
    """Dates that grow with the order's ordinal over the history, in whole milliseconds."""
    return F.lit(anchor_ms - HISTORY_MS) + F.floor(F.lit(HISTORY_MS).cast("decimal(20,0)") * ordinal / F.lit(max(count - 1, 1))).cast("long")


def population(spark: SparkSession, warehouses: int = 1, districts: int = 10, customers: int = 300, items: int = 1000, orders: int = 300, suppliers: int = 100, anchor_ms: int = 1_700_000_000_000) -> dict[str, DataFrame]:
    """The order-processing tables: ranges, products of ranges, and hashes."""

    def grid(*sizes: tuple[str, int, int]) -> DataFrame:
        total = 1
        for _, _, n in sizes:
            total *= n
        df, step = spark.range(total), total
        for name, first, n in sizes:
            step //= n
            df = df.withColumn(name, (F.floor(F.col("id") / step) % n + first).cast("long"))
        return df

    w, d, c, i, o = ("w_id", 1, warehouses), ("d_id", 1, districts), ("c_id", 1, customers), ("i_id", 1, items), ("o_id", 1, orders)
    cents = lambda lo, hi, seed: between(lo, hi, F.col("id"), seed=seed) / 100.0
    open_from = orders - int(orders * UNDELIVERED)
    order = grid(w, d, o).withColumn("o_ol_cnt", between(5, 15, F.col("id"), seed=21)).withColumn("o_entry_d", order_date(anchor_ms, F.col("o_id") - 1, orders))
    order = order.withColumn("o_carrier_id", F.when(F.col("o_id") <= open_from, between(1, 10, F.col("id"), seed=22)))
    order = order.withColumn("o_c_id", (F.col("o_id") - 1) % customers + 1)
    lines = order.withColumn("ol_number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("o_ol_cnt")))).withColumn("id", F.xxhash64("id", "ol_number"))
    stock = grid(w, i)
    name_code = F.when(F.col("c_id") <= 1000, F.col("c_id") - 1).otherwise(nurand(255, 0, 999, 123, F.col("id"), seed=3))
    people = grid(w, d, c).withColumn("last_code", name_code).withColumn("c_first", alphanumeric(F.lit(8), F.col("id"), seed=12))
    last_order = order.groupBy("w_id", "d_id", F.col("o_c_id").alias("c_id")).agg(F.max("o_id").alias("o_id"))
    return {
        "warehouse": grid(w).select("w_id", (between(0, 2000, F.col("id"), seed=1) / 10000.0).alias("w_tax"), F.lit(300000.0).alias("w_ytd")),
        "district": grid(w, d).select("w_id", "d_id", (between(0, 2000, F.col("id"), seed=2) / 10000.0).alias("d_tax"), F.lit(30000.0).alias("d_ytd"), F.lit(orders + 1).cast("long").alias("d_next_o_id")),
        "customer": people.select(
            "w_id", "d_id", "c_id", "c_first", last_name("last_code").alias("c_last"), (between(0, 5000, F.col("id"), seed=5) / 10000.0).alias("c_discount"),
            F.lit(-10.0).alias("c_balance"), F.lit(10.0).alias("c_ytd_payment"), F.lit(1).cast("long").alias("c_payment_cnt"),
            (between(1, 10, F.col("id"), seed=13) == 1).alias("c_credit_bad"),
        ),
        "customer_name_idx": people.select("w_id", "d_id", "last_code", first_name_code("c_first").alias("first_code"), "c_id"),
        "cust_last_order": last_order,
        "history": people.select(F.col("id").alias("seq"), F.col("c_id").alias("h_c_id"), F.col("d_id").alias("h_d_id"), F.col("w_id").alias("h_w_id"), F.lit(anchor_ms).alias("h_date"), F.lit(10.0).alias("h_amount")),
        "item": grid(i).select("i_id", cents(100, 10000, 6).alias("i_price")),
        "stock": stock.select("w_id", "i_id", between(10, 100, F.col("id"), seed=7).alias("s_quantity"), supplier_of(F.col("w_id"), F.col("i_id"), suppliers).alias("s_su_suppkey")),
        "orders": order.select("w_id", "d_id", "o_id", "o_c_id", "o_entry_d", "o_carrier_id", "o_ol_cnt"),
        "new_order": order.where(F.col("o_id") > open_from).select("w_id", "d_id", "o_id"),
        "order_line": lines.select("w_id", "d_id", "o_id", "ol_number", between(1, items, F.col("id"), seed=8).alias("ol_i_id"), F.when(F.col("o_carrier_id").isNotNull(), F.col("o_entry_d")).alias("ol_delivery_d"), F.lit(5).cast("long").alias("ol_quantity"), F.when(F.col("o_carrier_id").isNull(), cents(1, 999999, 9)).otherwise(0.0).alias("ol_amount")),
        "supplier": spark.range(suppliers).select(F.col("id").alias("su_id"), (F.col("id") % 25).alias("s_nationkey")),
        "nation": nations(spark),
        "region": regions(spark),
    }


#: The characters of random text.
ALPHANUMERICS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def alphanumeric(length: Column, *parts: Column, seed: int = 0) -> Column:
    """Text of digits and letters that depends on its parts alone."""
    at = lambda i: F.pmod(F.xxhash64(F.lit(seed), i, *parts), F.lit(len(ALPHANUMERICS))).cast("int") + 1
    return F.array_join(F.transform(F.sequence(F.lit(1), length), lambda i: F.substring(F.lit(ALPHANUMERICS), at(i), F.lit(1))), "")


def usertable(spark: SparkSession, n: int, fields: int = 10, width: int = 100) -> DataFrame:
    """Keys 1..n, each with a row of ``fields`` fields of ``width`` characters."""
    return spark.range(1, n + 1).select(F.col("id").alias("key"), alphanumeric(F.lit(fields * width), F.col("id")).alias("row"))


def arrival_key(ticket: Column, lateness: Column) -> Column:
    """Near-sorted arrivals: the ticket less a bounded lateness, from 1 on."""
    return F.greatest(F.lit(1).cast("long"), ticket - lateness)


def zipf(spark: SparkSession, n: int, theta: float) -> DataFrame:
    """(rank, weight): the finite Zipf distribution, exactly normalised."""
    w = F.pow(F.col("rank").cast("double"), F.lit(-theta))
    rows = spark.range(1, n + 1).select(F.col("id").alias("rank"))
    total = rows.agg(F.sum(w).alias("total"))  # one row
    return rows.crossJoin(total).select("rank", (w / F.col("total")).alias("weight"))


def fnv1a(value: Column) -> Column:
    """64-bit FNV-1a of the eight octets of a long, lowest first, as DECIMAL(20,0).

    Decimals hold the products that would overflow a long; the exclusive or
    touches the lowest octet alone."""
    wrap, prime = F.lit(Decimal(1 << 64)).cast("decimal(20,0)"), F.lit(FNV_PRIME).cast("decimal(14,0)")

    def step(h: Column, shift: Column) -> Column:
        octet = F.call_function("shiftrightunsigned", value, shift).bitwiseAND(F.lit(255)).cast("int")
        low = (h % 256).cast("int")
        mixed = (h - low + low.bitwiseXOR(octet)).cast("decimal(20,0)")
        return F.pmod((mixed * prime).cast("decimal(38,0)"), wrap).cast("decimal(20,0)")

    return F.aggregate(F.sequence(F.lit(0), F.lit(56), F.lit(8)), F.lit(Decimal(FNV_BASIS)).cast("decimal(20,0)"), step)


def scrambled(rank: Column, n: int) -> Column:
    """The key of a Zipf rank, spread over 1..n by its hash."""
    return (F.lit(1) + fnv1a(rank) % n).cast("long")


def latest(rank: Column, newest: Column) -> Column:
    """The key ``rank - 1`` places back from the newest, from 1 on."""
    return F.greatest(newest - (rank - 1), F.lit(1).cast("long"))


#: Shares of arrivals and of updates near the tail.
ARRIVAL, HOT_UPDATE = 0.2, 0.8


def hot_key(draw: Column, newest: Column, window: int, theta: float) -> Column:
    """One of the ``window`` newest keys, the newest likeliest: a Zipf rank,
    counted back from the tail.  The window is a handful of keys at any size of
    the table, so its cumulative weights are a literal."""
    weights = [r**-theta for r in range(1, window + 1)]
    total, tops = sum(weights), []
    for w in weights:
        tops.append((tops[-1] if tops else 0.0) + w / total)
    rank = F.lit(1) + F.size(F.filter(F.array(*map(F.lit, tops[:-1])), lambda x: x <= draw))
    return latest(rank.cast("long"), newest)


def tail_operation(draw: Column) -> Column:
    return F.when(draw < ARRIVAL / (ARRIVAL + HOT_UPDATE), "arrival").otherwise("hot_update")


def operation(mix: str, draw: Column) -> Column:
    """The operation of a workload for a draw in [0, 1), by cumulative shares."""
    out, top = None, 0.0
    for name, share in MIXES[mix].items():
        top += share
        out = F.when(draw < top, name) if out is None else out.when(draw < top, name)
    return out.otherwise(name)
