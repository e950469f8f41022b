"""Order-entry transactions as sets: a batch of New-Orders, Payments and
Deliveries turns the tables before it into the tables after it.

A batch is atomic and works in three phases: its New-Orders, then its Payments,
then its Deliveries, each in order of ``seq``.  Within a phase the effects on a
row add up (or, for stock, add up modulo 91), so they are aggregates with partial
results, whatever share of the batch one row takes; only order numbers and the
queue of undelivered orders need an order, and those are numbered by slices.

Amounts are whole hundredths, so sums are exact.

Tables: warehouse (w, tax, ytd), district (w, d, tax, ytd, next_o_id), customer
(c, w, d, discount, bad_credit, balance, ytd_payment, payment_cnt, delivery_cnt,
data), item (i, price), stock (w, i, quantity, ytd, order_cnt, remote_cnt),
orders (w, d, o_id, c, carrier, ol_cnt), new_order (w, d, o_id), order_line
(w, d, o_id, ol_number, i, supply_w, qty, amount, delivered_at), history (seq, c,
w, d, amount).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .sequence import numbered

#: Shares of the transaction kinds in percent, and characters of a bad-credit note that are kept.
MIX = {"new_order": 45, "payment": 43, "order_status": 4, "delivery": 4, "stock_level": 4}
NOTE_CHARS = 500
#: The shortest note that a payment adds: no more than NOTE_CHARS / SHORTEST of them can be seen.
SHORTEST = 17
#: The stock that an order must leave, and what is added where it would not.
LEAST_STOCK, REFILL = 10, 91


def kind_of(draw: Column) -> Column:
    """The kind of a transaction for a draw from 0 to 99."""
    out, top = None, 0
    for name, share in MIX.items():
        top += share
        out = F.when(draw < top, name) if out is None else out.when(draw < top, name)
    return out


def restocked(quantity: Column, ordered: Column) -> Column:
    """Stock after orders of 1 to 10 pieces each, taken one after another and
    refilled by 91 whenever fewer than 10 would be left: steps of that rule keep
    the stock in 10..100 and its value modulo 91, so their order is no matter."""
    return F.lit(LEAST_STOCK) + F.pmod(quantity - LEAST_STOCK - ordered, F.lit(REFILL))


def price(qty: Column, each: Column, discount: Column, tax: Column) -> Column:
    """qty * price * (1 - discount) * (1 + taxes), rounded to whole hundredths;
    discount and tax are whole percents."""
    return F.floor((qty * each * (100 - discount) * (100 + tax) + 5000) / 10_000).cast("long")


def new_orders(t: dict[str, DataFrame], asked: DataFrame, lines: DataFrame, slice_by: Column) -> tuple[DataFrame, DataFrame]:
    """(orders, order lines) of New-Orders: asked (seq, c), lines (seq, ol_number,
    i, supply_w, qty).  Orders have an outcome; one with an item that is not there
    is a UserAbort, which has no number and no lines."""
    found = lines.join(t["item"].select("i", F.col("price").alias("_price")), "i", "left")
    valid = found.groupBy("seq").agg(F.bool_and(F.col("_price").isNotNull()).alias("_ok"), F.count("*").alias("ol_cnt"))
    who = t["customer"].select("c", "w", "d", "discount")
    orders = asked.join(who, "c").join(valid, "seq").withColumn("outcome", F.when(F.col("_ok"), "Committed").otherwise("UserAbort"))
    kept = numbered(orders.where("_ok"), ["w", "d"], "seq", slice_by, "_nth")
    district = t["district"].select("w", "d", F.col("tax").alias("_d_tax"), "next_o_id")
    taxed = kept.join(district, ["w", "d"]).join(t["warehouse"].select("w", F.col("tax").alias("_w_tax")), "w")
    placed = taxed.withColumn("o_id", F.col("next_o_id") + F.col("_nth") - 1).withColumn("_tax", F.col("_w_tax") + F.col("_d_tax"))
    head = placed.select("seq", "w", "d", "o_id", "c", "discount", "_tax")
    amount = price(F.col("qty"), F.col("_price"), F.col("discount"), F.col("_tax")).alias("amount")
    rows = found.join(head, "seq").select("w", "d", "o_id", "ol_number", "i", "supply_w", "qty", amount, F.lit(None).cast("long").alias("delivered_at"))
    aborted = orders.where("NOT _ok").select("seq", "w", "d", F.lit(None).cast("long").alias("o_id"), "c", "ol_cnt", "outcome")
    return placed.select("seq", "w", "d", "o_id", "c", "ol_cnt", "outcome").unionByName(aborted), rows


def ordered_stock(stock: DataFrame, lines: DataFrame) -> DataFrame:
    """The stock after order lines."""
    remote = F.count_if(F.col("supply_w") != F.col("w")).alias("_remote")
    sums = lines.groupBy(F.col("supply_w").alias("_w"), "i").agg(F.sum("qty").alias("_qty"), F.count("*").alias("_n"), remote)
    rows = stock.join(sums.withColumnRenamed("_w", "w"), ["w", "i"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select(
        "w",
        "i",
        F.when(F.col("_n").isNull(), F.col("quantity")).otherwise(restocked(F.col("quantity"), F.col("_qty"))).alias("quantity"),
        (F.col("ytd") + zero("_qty")).alias("ytd"),
        (F.col("order_cnt") + zero("_n")).alias("order_cnt"),
        (F.col("remote_cnt") + zero("_remote")).alias("remote_cnt"),
    )


def money(cents: Column) -> Column:
    """An amount of whole hundredths as text with two decimals."""
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def paid(customer: DataFrame, payments: DataFrame) -> DataFrame:
    """Customers after payments (seq, c, home_w, home_d, amount).

    The note of a bad customer is what payments put before it, newest first, cut
    to NOTE_CHARS; so only the newest payments of each customer are gathered."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    sums = payments.groupBy("c").agg(F.sum("amount").alias("_paid"), F.count("*").alias("_n"))
    bad = payments.join(customer.where("bad_credit").select("c", "w", "d"), "c")
    newest = bad.withColumn("_r", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("seq")))).where(F.col("_r") <= NOTE_CHARS // SHORTEST + 1)
    note = F.concat(F.concat_ws(" ", "c", "d", "w", "home_d", "home_w", money(F.col("amount"))), F.lit(" | "))
    notes = newest.groupBy("c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", note.alias("t")))), lambda x: x["t"]), "").alias("_notes"))
    rows = customer.join(sums, "c", "left").join(notes, "c", "left")
    new = {
        "balance": F.col("balance") - zero("_paid"),
        "ytd_payment": F.col("ytd_payment") + zero("_paid"),
        "payment_cnt": F.col("payment_cnt") + zero("_n"),
        "data": F.when(F.col("_notes").isNotNull(), F.left(F.concat("_notes", "data"), F.lit(NOTE_CHARS))).otherwise(F.col("data")),
    }
    return rows.withColumns(new).select(*customer.columns)


def delivered(new_order: DataFrame, deliveries: DataFrame, slices: tuple[Column, Column]) -> DataFrame:
    """(w, d, o_id, carrier, at): what deliveries (seq, w, carrier, at) take: each
    one the oldest undelivered order of every district of its warehouse, if any.

    The n-th delivery of a warehouse meets the n-th order of each of its queues."""
    queue = numbered(new_order.select("w", "d", "o_id"), ["w", "d"], "o_id", slices[0], "nth")
    turns = numbered(deliveries.select("seq", "w", "carrier", "at"), ["w"], "seq", slices[1], "nth")
    return queue.join(turns, ["w", "nth"]).select("w", "d", "o_id", "carrier", "at")


def run_batch(t: dict[str, DataFrame], asked: DataFrame, lines: DataFrame, payments: DataFrame, deliveries: DataFrame, width: int = 1 << 16) -> dict[str, DataFrame]:
    """The tables after a batch, and ``outcomes`` (seq, kind, outcome).

    What several tables take from, the new orders with their lines and the
    deliveries, is written once."""
    cut = lambda c: F.floor(F.col(c) / width)
    after = dict(t)
    orders, ordered = new_orders(t, asked, lines, cut("seq"))
    orders, ordered = written(orders, "new-orders")[0], written(ordered, "new-lines")[0]
    made = orders.where("outcome = 'Committed'")
    waiting = t["new_order"].unionByName(made.select("w", "d", "o_id"))
    gone, _ = written(delivered(waiting, deliveries, (cut("o_id"), cut("seq"))), "delivered")
    after["stock"] = ordered_stock(t["stock"], ordered)
    by_home = payments.groupBy(F.col("home_w").alias("w"), F.col("home_d").alias("d")).agg(F.sum("amount").alias("_paid"))
    made_by = made.groupBy("w", "d").agg(F.count("*").alias("_made"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    district = t["district"].join(by_home, ["w", "d"], "left").join(made_by, ["w", "d"], "left")
    grown = {"ytd": F.col("ytd") + zero("_paid"), "next_o_id": F.col("next_o_id") + zero("_made")}
    after["district"] = district.withColumns(grown).select(*t["district"].columns)
    warehouse = t["warehouse"].join(by_home.groupBy("w").agg(F.sum("_paid").alias("_paid")), "w", "left")
    after["warehouse"] = warehouse.withColumn("ytd", F.col("ytd") + zero("_paid")).select(*t["warehouse"].columns)
    every = t["orders"].unionByName(made.select("w", "d", "o_id", "c", F.lit(None).cast("long").alias("carrier"), F.col("ol_cnt").cast("long").alias("ol_cnt")))
    key = ["w", "d", "o_id"]
    shipped = every.join(gone.withColumnRenamed("carrier", "_carrier"), key, "left")
    after["orders"] = shipped.withColumn("carrier", F.coalesce("_carrier", "carrier")).select(*t["orders"].columns)
    after["new_order"] = waiting.join(gone.select(*key), key, "left_anti")
    stamped = t["order_line"].unionByName(ordered).join(gone.select(*key, "at"), key, "left")
    after["order_line"] = stamped.withColumn("delivered_at", F.coalesce("delivered_at", "at")).select(*t["order_line"].columns)
    credit = stamped.where("at IS NOT NULL").groupBy(*key).agg(F.sum("amount").alias("_sum"))
    credit = gone.select(*key).join(credit, key, "left").join(every.select(*key, "c"), key)
    credit = credit.groupBy("c").agg(F.coalesce(F.sum("_sum"), F.lit(0)).alias("_credit"), F.count("*").alias("_n"))
    customer = paid(t["customer"], payments).join(credit, "c", "left")
    grown = {"balance": F.col("balance") + zero("_credit"), "delivery_cnt": F.col("delivery_cnt") + zero("_n")}
    after["customer"] = customer.withColumns(grown).select(*t["customer"].columns)
    after["history"] = t["history"].unionByName(payments.select("seq", "c", F.col("home_w").alias("w"), F.col("home_d").alias("d"), "amount"))
    done = lambda df, kind: df.select("seq", F.lit(kind).alias("kind"), F.lit("Committed").alias("outcome"))
    after["outcomes"] = orders.select("seq", F.lit("new_order").alias("kind"), "outcome").unionByName(done(payments, "payment")).unionByName(done(deliveries, "delivery"))
    return after


def totals(t: dict[str, DataFrame]) -> DataFrame:
    """One row of the sums and counts that the invariants compare."""
    parts = [
        t["district"].agg(F.sum("next_o_id").alias("next_o_id"), F.sum("ytd").alias("d_ytd")),
        t["warehouse"].agg(F.sum("ytd").alias("w_ytd")),
        t["orders"].agg(F.count("*").alias("orders")),
        t["new_order"].agg(F.count("*").alias("new_order")),
        t["stock"].agg(F.sum("order_cnt").alias("s_order_cnt"), F.sum("ytd").alias("s_ytd")),
        t["order_line"].agg(F.count("*").alias("lines"), F.sum("qty").alias("qty"), F.coalesce(F.sum(F.when(F.col("delivered_at").isNotNull(), F.col("amount"))), F.lit(0)).alias("credit")),
        t["customer"].agg(F.sum("ytd_payment").alias("c_ytd"), F.sum("balance").alias("c_balance"), F.sum("delivery_cnt").alias("deliveries")),
        t["history"].agg(F.count("*").alias("history")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # single rows
    return out


def invariants(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(invariant, left, right, holds): nine equalities of what grew."""
    old, new = totals(before), totals(after)
    committed = after["outcomes"].where("outcome = 'Committed'")
    n = committed.agg(F.count_if(F.col("kind") == "new_order").alias("_orders"), F.count_if(F.col("kind") == "payment").alias("_payments"))
    row = new.crossJoin(old.select(*(F.col(c).alias(f"_{c}_") for c in old.columns))).crossJoin(n)  # single rows
    grew = lambda c: F.col(c) - F.col(f"_{c}_")
    sides = {
        "next_order_ids": (grew("next_o_id"), F.col("_orders")),
        "orders": (grew("orders"), F.col("_orders")),
        "undelivered": (grew("new_order"), F.col("_orders") - grew("deliveries")),
        "stock_order_count": (grew("s_order_cnt"), grew("lines")),
        "stock_quantity": (grew("s_ytd"), grew("qty")),
        "warehouse_district_ytd": (grew("w_ytd"), grew("d_ytd")),
        "warehouse_customer_ytd": (grew("w_ytd"), grew("c_ytd")),
        "balance_and_credit": (grew("w_ytd") + grew("c_balance"), grew("credit")),
        "history_rows": (grew("history"), F.col("_payments")),
    }
    each = F.array(*(F.struct(F.lit(k).alias("invariant"), a.cast("long").alias("left"), b.cast("long").alias("right")) for k, (a, b) in sides.items()))
    return row.select(F.explode(each).alias("x")).select("x.*", (F.col("x.left") == F.col("x.right")).alias("holds"))
