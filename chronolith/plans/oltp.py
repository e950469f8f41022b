"""Order-processing reads and transaction effects, as set operations.

Warehouses and districts are derived: warehouse = key % 4, district = key % 10.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import order_entry
from .base import cents
from .registry import register


@register(
    "order_status_last_order",
    "T-OS JN-06",
    "WITH l AS (SELECT o_custkey, max(o_orderkey) AS o FROM orders GROUP BY 1) SELECT l.o_custkey AS c_id, l.o AS o_id, l_linenumber::bigint AS ol_number, l_partkey AS i_id, CAST(l_quantity AS bigint) AS qty FROM l JOIN lineitem ON l_orderkey = l.o",
)
def order_status_last_order(t):
    """Lines of each customer's last order."""
    last = t("orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_id"))
    joined = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").join(last, F.col("l_orderkey") == F.col("o_id"))
    return joined.select(F.col("o_custkey").alias("c_id"), "o_id", F.col("l_linenumber").cast("long").alias("ol_number"), F.col("l_partkey").alias("i_id"), F.col("l_quantity").cast("long").alias("qty"))


@register(
    "middle_customer_by_name",
    "T-OS SO-03 JN-06",
    "WITH c AS (SELECT c_custkey % 100 AS code, c_custkey, row_number() OVER (PARTITION BY c_custkey % 100 ORDER BY c_custkey) AS r, count(*) OVER (PARTITION BY c_custkey % 100) AS n FROM customer), s AS (SELECT ['BAR','OUGHT','ABLE','PRI','PRES','ESE','ANTI','CALLY','ATION','EING'] AS m) SELECT m[code // 100 + 1] || m[code // 10 % 10 + 1] || m[code % 10 + 1] AS last, c_custkey FROM c, s WHERE r = (n + 1) // 2",
)
def middle_customer_by_name(t):
    """Of the customers with one last name, the one in the middle."""
    c = t("customer").select((F.col("c_custkey") % 100).alias("code"), "c_custkey")
    ranked = c.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("c_custkey"))).withColumn("n", F.count("*").over(Window.partitionBy("code")))
    return ranked.where("r = (n + 1) div 2").select(keys.last_name("code").alias("last"), "c_custkey")


_STOCK = "stock AS (SELECT p_partkey AS i_id, p_partkey * 7 % 100 AS s_quantity FROM part)"


def _stock(t):
    return t("part").select(F.col("p_partkey").alias("i_id"), (F.col("p_partkey") * 7 % 100).alias("s_quantity"))


@register(
    "stock_level_distinct",
    "T-SL JN-05 AG-05 SO-05",
    "WITH " + _STOCK + ", d AS (SELECT o_custkey % 10 AS d_id, max(o_orderkey) + 1 AS nxt FROM orders GROUP BY 1), o AS (SELECT o_orderkey, o_custkey % 10 AS d_id FROM orders) SELECT o.d_id, count(DISTINCT l_partkey) AS low_stock FROM o JOIN d ON o.d_id = d.d_id AND o.o_orderkey BETWEEN greatest(d.nxt - 200, 1) AND d.nxt - 1 JOIN lineitem ON l_orderkey = o.o_orderkey JOIN stock ON l_partkey = i_id WHERE s_quantity < 15 GROUP BY 1",
)
def stock_level_distinct(t):
    """Distinct items of a district's newest orders that run low."""
    o = t("orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("d_id"))
    d = o.groupBy("d_id").agg((F.max("o_orderkey") + 1).alias("nxt"))
    recent = o.join(d, "d_id").where(F.col("o_orderkey").between(F.greatest(F.col("nxt") - 200, F.lit(1)), F.col("nxt") - 1)).select("o_orderkey", "d_id")
    low = _stock(t).where("s_quantity < 15").select("i_id")
    rows = t("lineitem").select("l_orderkey", "l_partkey").join(recent, F.col("l_orderkey") == F.col("o_orderkey")).join(low, F.col("l_partkey") == F.col("i_id"), "left_semi")
    return rows.groupBy("d_id").agg(F.count_distinct("l_partkey").alias("low_stock"))


@register(
    "delivery_oldest_per_district",
    "T-DEL SO-04",
    "WITH n AS (SELECT o_custkey % 10 AS d_id, min(o_orderkey) AS o_id FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT n.d_id, n.o_id, o.o_custkey AS c_id, CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS bigint)) AS double) / 100 AS amount, count(l_orderkey) AS lines FROM n JOIN orders o ON n.o_id = o.o_orderkey LEFT JOIN lineitem ON l_orderkey = n.o_id GROUP BY 1, 2, 3",
)
def delivery_oldest_per_district(t):
    """The oldest undelivered order of each district and what its delivery
    credits to the customer."""
    o = t("orders").where("o_orderstatus = 'O'").groupBy((F.col("o_custkey") % 10).alias("d_id")).agg(F.min_by(F.struct("o_orderkey", "o_custkey"), "o_orderkey").alias("m"))
    o = o.select("d_id", F.col("m.o_orderkey").alias("o_id"), F.col("m.o_custkey").alias("c_id"))
    lines = t("lineitem").select("l_orderkey", cents("l_extendedprice").alias("a"))
    return o.join(lines, F.col("l_orderkey") == F.col("o_id"), "left").groupBy("d_id", "o_id", "c_id").agg((F.sum("a") / 100.0).alias("amount"), F.count("l_orderkey").alias("lines"))


@register(
    "new_order_pricing",
    "T-NO",
    "WITH l AS (SELECT o_orderkey, o_custkey, l_partkey, CAST(l_quantity AS bigint) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey), p AS (SELECT l.*, (l.q * (l_partkey % 1000) * (100 - o_custkey % 50) * (100 + o_custkey % 4 + o_custkey % 10))::bigint AS e4, l_partkey % 101 = 0 AS bad FROM l) SELECT o_orderkey, CASE WHEN bool_or(bad) THEN 'UserAbort' ELSE 'Committed' END AS outcome, CASE WHEN bool_or(bad) THEN 0.0 ELSE sum(e4) / 10000.0::DOUBLE END::DOUBLE AS total FROM p GROUP BY o_orderkey",
)
def new_order_pricing(t):
    """qty * price * (1 - discount) * (1 + w_tax + d_tax) by order, in whole
    hundredths; an order with an invalid item aborts before it writes anything."""
    o = t("orders").select("o_orderkey", "o_custkey")
    rows = t("lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("long").alias("q")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    c = F.col("o_custkey")
    rows = rows.select("o_orderkey", (F.col("q") * (F.col("l_partkey") % 1000) * (100 - c % 50) * (100 + c % 4 + c % 10)).alias("e4"), (F.col("l_partkey") % 101 == 0).alias("bad"))
    g = rows.groupBy("o_orderkey").agg(F.bool_or("bad").alias("bad"), F.sum("e4").alias("e4"))
    return g.select("o_orderkey", F.when(F.col("bad"), "UserAbort").otherwise("Committed").alias("outcome"), F.when(F.col("bad"), 0.0).otherwise(F.col("e4") / 10000.0).alias("total"))


def replenished(quantity, ordered):
    """What is left of a stock after an order: refilled by 91 if under 10 were left."""
    rest = quantity - ordered
    return F.when(rest >= 10, rest).otherwise(rest + 91)


@register("stock_replenish_rule", "T-NO", "WITH " + _STOCK + " SELECT l_orderkey, l_partkey, CASE WHEN s_quantity - q >= 10 THEN s_quantity - q ELSE s_quantity - q + 91 END AS after FROM (SELECT l_orderkey, l_partkey, CAST(l_quantity AS bigint) % 10 + 1 AS q FROM lineitem) JOIN stock ON l_partkey = i_id")
def stock_replenish_rule(t):
    rows = t("lineitem").select("l_orderkey", "l_partkey", (F.col("l_quantity").cast("long") % 10 + 1).alias("q"))
    return rows.join(_stock(t), F.col("l_partkey") == F.col("i_id")).select("l_orderkey", "l_partkey", replenished(F.col("s_quantity"), F.col("q")).alias("after"))


@register(
    "payment_effects",
    "T-PAY",
    "WITH p AS (SELECT event_id, user_id, user_id % 4 AS w_id, user_id % 10 AS d_id, CAST(floor(value * 100 + 0.5) AS bigint) AS a FROM events WHERE event_type = 'purchase') SELECT w_id, d_id, count(*) AS payments, CAST(sum(a) AS double) / 100 AS ytd, max(left('c' || user_id || ' w' || w_id || ' d' || d_id || ' ' || repeat('x', 600), 500)) AS note FROM p GROUP BY 1, 2",
)
def payment_effects(t):
    """Year-to-date sums by district, and bad-credit notes cut to 500 characters."""
    p = t("events").where("event_type = 'purchase'").select("user_id", (F.col("user_id") % 4).alias("w_id"), (F.col("user_id") % 10).alias("d_id"), cents("value").alias("a"))
    note = F.left(F.concat(F.lit("c"), F.col("user_id"), F.lit(" w"), F.col("w_id"), F.lit(" d"), F.col("d_id"), F.lit(" "), F.repeat(F.lit("x"), 600)), F.lit(500))
    return p.groupBy("w_id", "d_id").agg(F.count("*").alias("payments"), (F.sum("a") / 100.0).alias("ytd"), F.max(note).alias("note"))


# Batches of transactions ------------------------------------------------------
#
# Customers stand for customers of warehouse key % 4 and district key // 4 % 10;
# orders with status O are undelivered.  Each event is one transaction of the
# mix by its user as customer.

WAREHOUSES, DISTRICTS = 4, 10


def order_entry_tables(t) -> dict[str, DataFrame]:
    """The order-entry tables before the batch, in whole hundredths."""
    long = lambda x: F.lit(x).cast("long")
    w, d = (lambda c: F.col(c) % WAREHOUSES), (lambda c: F.floor(F.col(c) / WAREHOUSES) % DISTRICTS)
    orders = t("orders").select(w("o_custkey").alias("w"), d("o_custkey").alias("d"), F.col("o_orderkey").alias("o_id"), F.col("o_custkey").alias("c"), "o_orderstatus")
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", cents("l_extendedprice").alias("amount"))
    lines = lines.join(orders, F.col("l_orderkey") == F.col("o_id"))
    is_open = F.col("o_orderstatus") == "O"
    warehouse = t.spark.range(WAREHOUSES).select(F.col("id").alias("w"), F.col("id").alias("tax"), long(30_000_000).alias("ytd"))
    number = F.col("id") % DISTRICTS
    district = t.spark.range(WAREHOUSES * DISTRICTS).select(F.floor(F.col("id") / DISTRICTS).alias("w"), number.alias("d"), number.alias("tax"), long(3_000_000).alias("ytd"))
    district = district.join(orders.groupBy("w", "d").agg((F.max("o_id") + 1).alias("_next")), ["w", "d"], "left")
    part = t("part").select(F.col("p_partkey").alias("i"))
    none = long(0)
    return {
        "warehouse": warehouse,
        "district": district.select("w", "d", "tax", "ytd", F.coalesce("_next", none).alias("next_o_id")),
        "customer": t("customer").select(
            F.col("c_custkey").alias("c"), w("c_custkey").alias("w"), d("c_custkey").alias("d"), (F.col("c_custkey") % 50).alias("discount"),
            (F.col("c_custkey") % 10 == 0).alias("bad_credit"), long(-1000).alias("balance"), long(1000).alias("ytd_payment"),
            long(1).alias("payment_cnt"), none.alias("delivery_cnt"), F.lit("since").alias("data"),
        ),
        "item": part.select("i", (F.col("i") % 1000 + 100).alias("price")),
        "stock": part.select(F.explode(F.sequence(none, long(WAREHOUSES - 1))).alias("w"), "i").select(
            "w", "i", (10 + (F.col("i") * 7 + F.col("w")) % 91).alias("quantity"), none.alias("ytd"), none.alias("order_cnt"), none.alias("remote_cnt")
        ),
        "orders": orders.select("w", "d", "o_id", "c", F.when(~is_open, F.col("o_id") % 10 + 1).alias("carrier"), none.alias("ol_cnt")),
        "new_order": orders.where(is_open).select("w", "d", "o_id"),
        "order_line": lines.select(
            "w", "d", "o_id", F.col("l_linenumber").cast("long").alias("ol_number"), F.col("l_partkey").alias("i"), F.col("w").alias("supply_w"),
            F.col("l_quantity").cast("long").alias("qty"), "amount", F.when(~is_open, long(-1)).alias("delivered_at"),
        ),
        "history": t.spark.createDataFrame([], "seq long, c long, w long, d long, amount long"),
    }


def order_entry_batch(t) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The tables before and after the batch."""
    tables = order_entry_tables(t)
    e, seq = t("events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("c"), "value"), F.col("seq")
    e = e.withColumn("kind", order_entry.kind_of(seq * 7919 % 100))
    who = tables["customer"].select("c", "w", "d")
    asked = e.where("kind = 'new_order'").select("seq", "c").join(who, "c").select("seq", "c", "w")
    items = t("part").agg(F.max("p_partkey").alias("_top"))
    lines = asked.crossJoin(F.broadcast(items))  # one row
    lines = lines.withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), 5 + seq % 11)))
    item = F.when((seq % 100 == 1) & (F.col("j") == 1), F.col("_top") + 1).otherwise((seq * 31 + F.col("j") * 17) % (F.col("_top") + 1))
    supply = F.when((seq * 13 + F.col("j")) % 100 == 0, (F.col("w") + 1) % WAREHOUSES).otherwise(F.col("w"))
    lines = lines.select("seq", F.col("j").alias("ol_number"), item.alias("i"), supply.alias("supply_w"), ((seq + F.col("j")) % 10 + 1).alias("qty"))
    home = F.when(seq % 100 < 15, (F.col("w") + 1) % WAREHOUSES).otherwise(F.col("w"))
    payments = e.where("kind = 'payment'").join(who, "c").select("seq", "c", home.alias("home_w"), F.col("d").alias("home_d"), (cents("value") + 1).alias("amount"))
    deliveries = e.where("kind = 'delivery'").join(who, "c").select("seq", "w", (seq % 10 + 1).alias("carrier"), (10 * seq).alias("at"))
    return tables, order_entry.run_batch(tables, asked.select("seq", "c"), lines, payments, deliveries)


_BATCH = """WITH cust AS (SELECT c_custkey AS c, c_custkey % 4 AS w, c_custkey // 4 % 10 AS d, c_custkey % 50 AS discount FROM customer),
ev AS (SELECT event_id AS seq, c, w, d, discount, value, event_id * 7919 % 100 AS draw FROM events JOIN cust ON user_id = c),
top AS (SELECT max(p_partkey) AS top FROM part),
no_lines AS (SELECT seq, c, w, d, discount, j AS ol_number, CASE WHEN seq % 100 = 1 AND j = 1 THEN top + 1 ELSE (seq * 31 + j * 17) % (top + 1) END AS i,
  CASE WHEN (seq * 13 + j) % 100 = 0 THEN (w + 1) % 4 ELSE w END AS supply_w, (seq + j) % 10 + 1 AS qty
  FROM ev, top, LATERAL (SELECT unnest(range(1, 6 + seq % 11)) AS j) WHERE draw < 45),
bad AS (SELECT DISTINCT seq FROM no_lines WHERE i NOT IN (SELECT p_partkey FROM part)),
base AS (SELECT o_custkey % 4 AS w, o_custkey // 4 % 10 AS d, o_orderkey AS o_id, o_custkey AS c, o_orderstatus = 'O' AS open FROM orders),
nxt AS (SELECT w, d, max(o_id) + 1 AS next_o_id FROM base GROUP BY 1, 2),
made AS (SELECT e.seq, e.w, e.d, e.c, coalesce(next_o_id, 0) + row_number() OVER (PARTITION BY e.w, e.d ORDER BY e.seq) - 1 AS o_id
  FROM ev e LEFT JOIN nxt n ON e.w = n.w AND e.d = n.d WHERE draw < 45 AND e.seq NOT IN (SELECT seq FROM bad)),
made_lines AS (SELECT m.w, m.d, m.o_id, m.c, l.i, l.supply_w, l.qty,
  (l.qty * (l.i % 1000 + 100) * (100 - l.discount) * (100 + m.w + m.d) + 5000) // 10000 AS amount FROM made m JOIN no_lines l ON m.seq = l.seq),
pay AS (SELECT seq, c, d, w, CASE WHEN seq % 100 < 15 THEN (w + 1) % 4 ELSE w END AS home_w, CAST(floor(value * 100 + 0.5) AS bigint) + 1 AS amount
  FROM ev WHERE draw >= 45 AND draw < 88),
waiting AS (SELECT w, d, o_id, c FROM base WHERE open UNION ALL SELECT w, d, o_id, c FROM made),
queue AS (SELECT *, row_number() OVER (PARTITION BY w, d ORDER BY o_id) AS nth FROM waiting),
turns AS (SELECT seq, w, seq % 10 + 1 AS carrier, row_number() OVER (PARTITION BY w ORDER BY seq) AS nth FROM ev WHERE draw >= 92 AND draw < 96),
gone AS (SELECT q.w, q.d, q.o_id, q.c, carrier FROM queue q JOIN turns t ON q.w = t.w AND q.nth = t.nth),
all_lines AS (SELECT w, d, o_id, amount FROM made_lines UNION ALL
  SELECT w, d, o_id, CAST(floor(l_extendedprice * 100 + 0.5) AS bigint) FROM base JOIN lineitem ON l_orderkey = o_id),
credit AS (SELECT g.w, g.d, g.o_id, g.c, g.carrier, coalesce(sum(amount), 0)::bigint AS amount, count(amount) AS lines
  FROM gone g LEFT JOIN all_lines l ON g.w = l.w AND g.d = l.d AND g.o_id = l.o_id GROUP BY ALL)
"""


@register(
    "order_entry_outcomes",
    "T-MIX T-NO T-PAY T-DEL",
    _BATCH + """SELECT 'new_order' AS kind, CASE WHEN seq IN (SELECT seq FROM bad) THEN 'UserAbort' ELSE 'Committed' END AS outcome, count(*) AS n FROM ev WHERE draw < 45 GROUP BY 2
UNION ALL SELECT 'payment', 'Committed', count(*) FROM pay UNION ALL SELECT 'delivery', 'Committed', count(*) FROM turns""",
)
def order_entry_outcomes(t):
    """Transactions of the mix by kind and outcome; reads change nothing."""
    return order_entry_batch(t)[1]["outcomes"].groupBy("kind", "outcome").agg(F.count("*").alias("n"))


@register(
    "new_order_effects",
    "T-NO",
    _BATCH + """, n AS (SELECT w, d, count(*) AS made, max(o_id) + 1 AS next_o_id FROM made GROUP BY 1, 2),
l AS (SELECT w, d, count(*) AS lines, sum(qty)::bigint AS qty, sum(amount)::bigint AS amount FROM made_lines GROUP BY 1, 2)
SELECT n.w, n.d, n.next_o_id, n.made, l.lines, l.qty, l.amount FROM n JOIN l ON n.w = l.w AND n.d = l.d""",
)
def new_order_effects(t):
    """Order numbers that districts gave out, and the new orders' lines."""
    before, after = order_entry_batch(t)
    key = ["w", "d"]
    was = before["district"].select(*key, F.col("next_o_id").alias("_was"))
    grown = after["district"].join(was, key).select(*key, "next_o_id", (F.col("next_o_id") - F.col("_was")).alias("made"), "_was").where("made > 0")
    lines = after["order_line"].join(grown.select(*key, "_was"), key).where(F.col("o_id") >= F.col("_was"))
    lines = lines.groupBy(*key).agg(F.count("*").alias("lines"), F.sum("qty").alias("qty"), F.sum("amount").alias("amount"))
    return grown.drop("_was").join(lines, key)


@register(
    "stock_after_orders",
    "T-NO",
    _BATCH + """, s AS (SELECT supply_w AS w, i, count(*) AS order_cnt, sum(qty)::bigint AS ytd, count(*) FILTER (WHERE supply_w <> w) AS remote_cnt FROM made_lines GROUP BY 1, 2),
f AS (SELECT w, i, order_cnt, ytd, remote_cnt, 10 + (i * 7 + w) % 91 AS q0 FROM s)
SELECT w, i, ytd, order_cnt, remote_cnt, 10 + ((q0 - 10 - ytd) % 91 + 91) % 91 AS quantity FROM f""",
)
def stock_after_orders(t):
    """Stock that was ordered, refilled whenever too little would have been left."""
    return order_entry_batch(t)[1]["stock"].where("order_cnt > 0").select("w", "i", "ytd", "order_cnt", "remote_cnt", "quantity")


@register(
    "payment_balances",
    "T-PAY",
    _BATCH + """, p AS (SELECT c, sum(amount)::bigint AS paid, count(*) AS n,
  string_agg(c || ' ' || d || ' ' || w || ' ' || d || ' ' || home_w || ' ' || amount // 100 || '.' || lpad((amount % 100)::varchar, 2, '0') || ' | ', '' ORDER BY seq DESC) AS notes FROM pay GROUP BY c),
k AS (SELECT c, sum(amount)::bigint AS credit, count(*) AS n FROM credit GROUP BY c)
SELECT cust.c, (-1000 - coalesce(paid, 0) + coalesce(credit, 0))::bigint AS balance, (1000 + coalesce(paid, 0))::bigint AS ytd_payment, 1 + coalesce(p.n, 0) AS payment_cnt,
coalesce(k.n, 0) AS delivery_cnt, CASE WHEN cust.c % 10 = 0 THEN left(coalesce(notes, '') || 'since', 500) ELSE 'since' END AS data
FROM cust LEFT JOIN p ON cust.c = p.c LEFT JOIN k ON cust.c = k.c""",
)
def payment_balances(t):
    """Customers after their payments and deliveries, with bad customers' notes."""
    return order_entry_batch(t)[1]["customer"].select("c", "balance", "ytd_payment", "payment_cnt", "delivery_cnt", "data")


@register(
    "payment_history",
    "T-PAY",
    _BATCH + """, h AS (SELECT home_w AS w, d, count(*) AS payments, sum(amount)::bigint AS amount FROM pay GROUP BY 1, 2)
SELECT h.w, h.d, payments, amount, 3000000 + amount AS ytd FROM h""",
)
def payment_history(t):
    """History rows by home district, next to the district's year-to-date sum."""
    after = order_entry_batch(t)[1]
    rows = after["history"].groupBy("w", "d").agg(F.count("*").alias("payments"), F.sum("amount").alias("amount"))
    return rows.join(after["district"].select("w", "d", "ytd"), ["w", "d"])


@register("delivery_effects", "T-DEL", _BATCH + "SELECT w, d, o_id, c, carrier, lines, amount FROM credit")
def delivery_effects(t):
    """Delivered orders with their carrier, stamped lines and the customer's credit."""
    before, after = order_entry_batch(t)
    key = ["w", "d", "o_id"]
    made = after["orders"].where("carrier IS NOT NULL").join(before["orders"].where("carrier IS NOT NULL"), key, "left_anti")
    lines = after["order_line"].where("delivered_at >= 0").groupBy(*key).agg(F.count("*").alias("lines"), F.sum("amount").alias("amount"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return made.join(lines, key, "left").select(*key, "c", "carrier", zero("lines"), zero("amount"))


@register(
    "invariant_report",
    "INV",
    _BATCH + """, n AS (SELECT (SELECT count(*) FROM made) AS made, (SELECT count(*) FROM gone) AS gone, (SELECT count(*) FROM made_lines) AS lines,
  (SELECT sum(qty) FROM made_lines) AS qty, (SELECT sum(amount) FROM pay) AS paid, (SELECT count(*) FROM pay) AS pays, (SELECT sum(amount) FROM credit) AS credit)
SELECT invariant, coalesce(x, 0)::bigint AS "left", coalesce(x, 0)::bigint AS "right", true AS holds FROM (
  SELECT 'next_order_ids' AS invariant, made AS x FROM n UNION ALL SELECT 'orders', made FROM n UNION ALL SELECT 'undelivered', made - gone FROM n
  UNION ALL SELECT 'stock_order_count', lines FROM n UNION ALL SELECT 'stock_quantity', qty FROM n UNION ALL SELECT 'warehouse_district_ytd', paid FROM n
  UNION ALL SELECT 'warehouse_customer_ytd', paid FROM n UNION ALL SELECT 'balance_and_credit', credit FROM n UNION ALL SELECT 'history_rows', pays FROM n)""",
)
def invariant_report(t):
    """Nine equalities between what grew in the tables of a batch."""
    return order_entry.invariants(*order_entry_batch(t))


_CONS = """WITH o AS (SELECT o_custkey % 10 AS d, count(*) AS n, max(o_orderkey) AS top, count(*) FILTER (WHERE o_orderstatus = 'O') AS pending FROM orders GROUP BY 1),
l AS (SELECT count(*) AS lines, count(DISTINCT l_orderkey) AS with_lines FROM lineitem), oo AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS k, max(o_orderkey) AS top FROM orders)
SELECT 'orders_sum' AS invariant, (SELECT sum(n) FROM o) = (SELECT n FROM oo) AS holds UNION ALL SELECT 'order_keys_unique', (SELECT n = k FROM oo)
UNION ALL SELECT 'next_order_id', (SELECT max(top) FROM o) = (SELECT top FROM oo) UNION ALL SELECT 'pending_at_most_orders', (SELECT bool_and(pending <= n) FROM o)
UNION ALL SELECT 'orders_with_lines', (SELECT with_lines FROM l) <= (SELECT n FROM oo) UNION ALL SELECT 'lines_have_orders', NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
UNION ALL SELECT 'customers_exist', NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))"""


@register("consistency_report", "", _CONS)
def consistency_report(t):
    """Consistency across the driver's tables, one row for each rule."""
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    d = orders.groupBy((F.col("o_custkey") % 10).alias("d")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("top"), F.count_if(F.col("o_orderstatus") == "O").alias("pending"))
    d = d.agg(F.sum("n").alias("dn"), F.max("top").alias("dtop"), F.bool_and(F.col("pending") <= F.col("n")).alias("dp"))
    o = orders.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("k"), F.max("o_orderkey").alias("top"))
    lk = t("lineitem").select("l_orderkey").distinct()
    w = lk.agg(F.count("*").alias("wl"))
    orphan = lk.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg((F.count("*") == 0).alias("no_orphan"))
    cust = orders.join(t("customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg((F.count("*") == 0).alias("cust"))
    one = d.crossJoin(o).crossJoin(w).crossJoin(orphan).crossJoin(cust)  # five single rows
    c = F.col
    pairs = {"orders_sum": c("dn") == c("n"), "order_keys_unique": c("n") == c("k"), "next_order_id": c("dtop") == c("top"), "pending_at_most_orders": c("dp"), "orders_with_lines": c("wl") <= c("n"), "lines_have_orders": c("no_orphan"), "customers_exist": c("cust")}
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("invariant"), v.alias("holds")) for k, v in pairs.items()))).alias("x")).select("x.invariant", "x.holds")
