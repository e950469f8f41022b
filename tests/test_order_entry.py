"""Batches of order-entry transactions against a transaction-by-transaction run."""

import random

import pytest
from pyspark.sql import functions as F

from chronolith.operators import order_entry as oe

W, D, C, I = 2, 3, 24, 15


@pytest.fixture(scope="module")
def tables(spark):
    where = lambda c: (c % W, c // W % D)
    orders = [(*where(c), 100 + o, c, None if o % 3 else 4, 1) for o, c in enumerate([c for c in range(C)] * 2)]
    made = {
        "warehouse": ([(w, w + 1, 1000) for w in range(W)], "w long, tax long, ytd long"),
        "district": ([(w, d, d, 500, 200) for w in range(W) for d in range(D)], "w long, d long, tax long, ytd long, next_o_id long"),
        "customer": ([(c, *where(c), c % 7, c % 2 == 0, 0, 0, 0, 0, "old" * 5) for c in range(C)], "c long, w long, d long, discount long, bad_credit boolean, balance long, ytd_payment long, payment_cnt long, delivery_cnt long, data string"),
        "item": ([(i, 100 + i) for i in range(I)], "i long, price long"),
        "stock": ([(w, i, 10 + (i * 13) % 91, 0, 0, 0) for w in range(W) for i in range(I)], "w long, i long, quantity long, ytd long, order_cnt long, remote_cnt long"),
        "orders": (orders, "w long, d long, o_id long, c long, carrier long, ol_cnt long"),
        "new_order": ([o[:3] for o in orders if o[4] is None], "w long, d long, o_id long"),
        "order_line": ([(*o[:3], 1, 0, o[0], 5, 700 + o[2], None if o[4] is None else 1) for o in orders], "w long, d long, o_id long, ol_number long, i long, supply_w long, qty long, amount long, delivered_at long"),
        "history": ([], "seq long, c long, w long, d long, amount long"),
    }
    return {k: spark.createDataFrame(rows, kinds) for k, (rows, kinds) in made.items()}


@pytest.fixture(scope="module")
def batch():
    r = random.Random(4)
    asked = [(s, r.choice([0, 0, r.randrange(C)])) for s in range(0, 300, 2)]
    lines = [(s, j, I if s % 50 == 4 and j == 2 else r.choice([3, r.randrange(I)]), r.randrange(W), r.randint(1, 10)) for s, _ in asked for j in range(1, r.randint(3, 6))]
    payments = [(s, r.choice([2, r.randrange(C)]), r.randrange(W), r.randrange(D), r.randint(1, 99_999)) for s in range(1, 300, 2)]
    return asked, lines, payments, [(400 + i, r.randrange(W), r.randint(1, 10), 9000 + i) for i in range(25)]


def one_by_one(t, asked, lines, payments, deliveries):
    """The same batch, a transaction at a time, on dictionaries."""
    rows = {k: [r.asDict() for r in v.collect()] for k, v in t.items()}
    by = {k: {tuple(r[x] for x in key): r for r in rows[k]} for k, key in {"warehouse": "w", "district": "wd", "stock": "wi", "orders": ["w", "d", "o_id"]}.items()}
    cust, price = {r["c"]: r for r in rows["customer"]}, {r["i"]: r["price"] for r in rows["item"]}
    waiting, out = sorted((r["w"], r["d"], r["o_id"]) for r in rows["new_order"]), []
    for seq, c in asked:
        mine = [x for x in lines if x[0] == seq]
        if any(x[2] not in price for x in mine):
            out.append((seq, "new_order", "UserAbort"))
            continue
        who = cust[c]
        d = by["district"][who["w"], who["d"]]
        o_id, d["next_o_id"] = d["next_o_id"], d["next_o_id"] + 1
        tax = by["warehouse"][who["w"],]["tax"] + d["tax"]
        for _, j, i, sw, qty in mine:
            s = by["stock"][sw, i]
            s["quantity"] = s["quantity"] - qty if s["quantity"] - qty >= 10 else s["quantity"] - qty + 91
            s["ytd"] += qty
            s["order_cnt"] += 1
            s["remote_cnt"] += sw != who["w"]
            amount = (qty * price[i] * (100 - who["discount"]) * (100 + tax) + 5000) // 10_000
            rows["order_line"].append({"w": who["w"], "d": who["d"], "o_id": o_id, "ol_number": j, "i": i, "supply_w": sw, "qty": qty, "amount": amount, "delivered_at": None})
        by["orders"][who["w"], who["d"], o_id] = {"w": who["w"], "d": who["d"], "o_id": o_id, "c": c, "carrier": None, "ol_cnt": len(mine)}
        waiting.append((who["w"], who["d"], o_id))
        out.append((seq, "new_order", "Committed"))
    for seq, c, w, d, amount in payments:
        who = cust[c]
        by["warehouse"][w,]["ytd"] += amount
        by["district"][w, d]["ytd"] += amount
        who["balance"] -= amount
        who["ytd_payment"] += amount
        who["payment_cnt"] += 1
        if who["bad_credit"]:
            who["data"] = f"{c} {who['d']} {who['w']} {d} {w} {amount // 100}.{amount % 100:02d} | {who['data']}"[:500]
        rows["history"].append({"seq": seq, "c": c, "w": w, "d": d, "amount": amount})
        out.append((seq, "payment", "Committed"))
    for seq, w, carrier, at in deliveries:
        for d in range(D):
            mine = sorted(x for x in waiting if x[:2] == (w, d))
            if mine:
                waiting.remove(mine[0])
                o = by["orders"][mine[0]]
                o["carrier"] = carrier
                who = cust[o["c"]]
                for x in rows["order_line"]:
                    if (x["w"], x["d"], x["o_id"]) == mine[0]:
                        x["delivered_at"] = at
                        who["balance"] += x["amount"]
                who["delivery_cnt"] += 1
        out.append((seq, "delivery", "Committed"))
    new = {"warehouse": by["warehouse"].values(), "district": by["district"].values(), "stock": by["stock"].values(), "orders": by["orders"].values(), "customer": cust.values()}
    new |= {"order_line": rows["order_line"], "history": rows["history"], "new_order": [dict(zip(("w", "d", "o_id"), x)) for x in waiting]}
    return new, out


def frames(spark, batch):
    kinds = ("seq long, c long", "seq long, ol_number long, i long, supply_w long, qty long", "seq long, c long, home_w long, home_d long, amount long", "seq long, w long, carrier long, at long")
    return [spark.createDataFrame(x, k) for x, k in zip(batch, kinds)]


def test_a_batch_equals_its_transactions_one_by_one(spark, tables, batch):
    want, outcomes = one_by_one(tables, *batch)
    got = oe.run_batch(tables, *frames(spark, batch), width=16)
    key = lambda r: tuple((k, str(v)) for k, v in sorted(r.items()))
    for name, rows in want.items():
        assert sorted(key(r.asDict()) for r in got[name].collect()) == sorted(map(key, rows)), name
    assert sorted(map(tuple, got["outcomes"].collect())) == sorted(outcomes)


def test_invariants_hold_and_notice_what_is_wrong(spark, tables, batch):
    after = oe.run_batch(tables, *frames(spark, batch))
    found = {r.invariant: r.holds for r in oe.invariants(tables, after).collect()}
    assert len(found) == 9 and all(found.values())
    broken = {**after, "history": after["history"].where("seq > 1"), "stock": after["stock"].withColumn("ytd", F.col("ytd") + 1)}
    found = {r.invariant for r in oe.invariants(tables, broken).collect() if not r.holds}
    assert found == {"history_rows", "stock_quantity"}


def test_an_empty_batch_changes_nothing(spark, tables):
    after = oe.run_batch(tables, *(df.where("false") for df in frames(spark, ([(0, 0)], [(0, 1, 0, 0, 1)], [(0, 0, 0, 0, 1)], [(0, 0, 1, 1)]))))
    for name, df in tables.items():
        assert sorted(map(str, after[name].collect())) == sorted(map(str, df.collect()))
    assert all(r.holds for r in oe.invariants(tables, after).collect())
