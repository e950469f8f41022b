"""Keys, intervals, percentiles, sources, generators and streaming forms."""

import math
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronolith.functions import generators, intervals, keys, percentiles
from chronolith.operators import metrics, reads, sequence
from chronolith.sources import dumps, opfile, wal
from chronolith.streaming import jobs


def test_packed_keys_round_trip_in_order(spark):
    r = random.Random(1)
    rows = [(r.randrange(100), r.randrange(1, 11), r.randrange(1 << 20), r.randrange(1, 16)) for _ in range(200)]
    df = spark.createDataFrame(rows, "w_id long, d_id long, o_id long, ol_number long")
    names = ("w_id", "d_id", "o_id", "ol_number")
    packed = df.withColumn("k", keys.pack("order_line", **{n: n for n in names}))
    got = packed.orderBy("k").select(*(keys.unpack("order_line", "k")[n].alias(n) for n in names)).collect()
    assert [tuple(x) for x in got] == sorted(rows)


def test_stamps(spark):
    rows = [(True, 32767, (1 << 48) - 1), (False, 0, 0), (False, 32767, 1), (True, 0, 7)]
    df = spark.createDataFrame(rows, "i boolean, w long, t long").select(keys.stamp_pack("i", "w", "t").alias("s"))
    assert [tuple(x) for x in df.select(*keys.stamp_unpack("s")).collect()] == rows


def test_zone_order(spark):
    values = [-(1 << 63), -5, 0, 5, (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long").select(keys.zone_encode("v").alias("z"))
    assert sorted(x.z & ((1 << 64) - 1) for x in df.collect()) == [x.z & ((1 << 64) - 1) for x in df.collect()]


def test_last_names(spark):
    got = {r.c: r.n for r in spark.range(1000).select(F.col("id").alias("c"), keys.last_name("id").alias("n")).collect()}
    assert got[0] == "BARBARBAR" and got[371] == "PRICALLYOUGHT" and len(set(got.values())) == 1000


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 1 << 40), st.integers(0, 5000), st.integers(1, 9))
def test_even_split_has_no_gap_or_overlap(lo, span, parts):
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    got = spark.range(1).select(intervals.split_even(F.lit(lo).cast("long"), F.lit(lo + span).cast("long"), parts).alias("p")).first().p
    assert got[0].lo == lo and got[-1].hi == lo + span and len(got) == min(parts, span + 1)
    assert all(a.hi + 1 == b.lo for a, b in zip(got, got[1:])) and all(x.lo <= x.hi for x in got)


def test_percentiles_differ_as_they_should(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    asked = {"a": ("nearest", 0.5), "b": ("nearest_even", 0.5), "c": ("linear", 0.5)}
    assert metrics.exact_percentiles(df, [], "x", asked).first().asDict() == {"n": 2, "a": 2.0, "b": 1.0, "c": 1.5}


@pytest.mark.parametrize("small", [4_000, 1])
def test_percentiles_equal_sorted_lists(spark, monkeypatch, small):
    """Brackets of large groups hold the percentile, with ties, skew and nulls."""
    monkeypatch.setattr(metrics, "SMALL", max(small, 3_000))
    r = random.Random(2)
    by = {"a": [r.random() for _ in range(12_000)], "b": [float(r.randint(0, 3)) for _ in range(9_000)], "c": [r.gauss(0, 1) ** 3 for _ in range(70)], None: [5.0]}
    rows = [(k, x) for k, v in by.items() for x in v] + [("a", None), ("d", None)]
    asked = {f"{d}{p}": (d, p) for d in ("nearest", "linear") for p in (0.0, 0.01, 0.5, 0.95, 0.999, 1.0)}
    got = {x.k: x for x in metrics.exact_percentiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", asked).collect()}
    assert set(got) == set(by)
    for k, v in by.items():
        s, n = sorted(v), len(v)
        assert got[k].n == n
        for p in (0.0, 0.01, 0.5, 0.95, 0.999, 1.0):
            at = p * (n - 1)
            assert got[k][f"nearest{p}"] == s[int(at + 0.5)]
            assert math.isclose(got[k][f"linear{p}"], s[math.floor(at)] + (s[math.ceil(at)] - s[math.floor(at)]) * (at - math.floor(at)), rel_tol=1e-12, abs_tol=1e-12)



def test_rates_are_zero_not_null(spark):
    df = spark.range(1)
    assert df.select(percentiles.or_zero(F.lit(5), F.lit(0)), metrics.interference(F.lit(0.0), F.lit(3.0))).first()[:] == (0.0, 0.0)


def test_choice_of_setting(spark):
    rows = [(1, 99.5, 98.0, 101.0, 1.0, 1.0), (2, 100.0, 99.0, 101.0, 1.0, 1.0), (3, 50.0, 49.0, 51.0, 1.0, 1.0), (0, 99.9, 99.0, 100.0, 9.0, 1.0)]
    df = spark.createDataFrame(rows, "setting long, throughput double, low double, high double, p99 double, rss double")
    assert metrics.choose_setting(df).first()[:] == (1, 2)


def test_log_survives_damage():
    records = [(1, "I", 3, 10, 7, 70, None), (None, "C", 3, 10, None, None, 12), (2, "D", 4, 11, 8, None, None), (2, "U", 4, 13, 9, 90, None)]
    parts = [wal.frame(wal.body(t or 0, op, w, s, k, p, c)) for t, op, w, s, k, p, c in records]
    broken = bytearray(parts[1])
    broken[8] ^= 0xFF
    data = b"\x00\x01junk" + parts[0] + bytes(broken) + parts[2] + parts[3][:-1]
    assert [r for _, r in wal.frames(data)] == [records[0], records[2]]
    assert [r for _, r in wal.frames(b"".join(parts))] == records


def test_operation_files(spark, tmp_path):
    ops = [("I", 1), ("U", 255), ("D", (1 << 62) + 5)]
    (tmp_path / "ops.bin").write_bytes(b"".join(struct.pack("<BQ", opfile.CODES[o], k) for o, k in ops) + b"\x01\x02")
    got = opfile.read(spark, str(tmp_path / "ops.bin")).orderBy("pos").collect()
    assert [(r.op, r.key) for r in got] == ops
    made = opfile.generate(spark, 10, 3, 20)
    assert made.count() == 70 and made.select("seq").distinct().count() == 70


def test_log_files_read_from_disk(spark, tmp_path):
    (tmp_path / "a.wal").write_bytes(wal.frame(wal.body(1, "I", 2, 3, 4, 5, None)))
    assert wal.read(spark, str(tmp_path)).select("op", "key", "payload").first()[:] == ("I", 4, 5)


def test_results_manifest_and_catalog(spark, tmp_path):
    df = spark.createDataFrame([("read", 2.5, 7)], "operation string, p50_us double, count long")
    dumps.write_results(df, str(tmp_path / "r"), "latency")
    assert dumps.read_results(spark, str(tmp_path / "r"), "latency").first()[:] == ("read", 2.5, None, None, 7, None, None)
    for _ in range(2):
        dumps.append_manifest(df.selectExpr("operation AS workload", "count AS threads"), str(tmp_path / "m"))
    back = dumps.read_results(spark, str(tmp_path / "m"), "manifest")
    assert back.count() == 2 and len(back.columns) == 17
    assert all(spark.createDataFrame([], kinds).columns for kinds in dumps.LAYOUTS.values())
    dumps.write_catalog(spark, ["orders", "stock"], str(tmp_path / "c"))
    assert sorted(map(tuple, dumps.read_catalog(spark, str(tmp_path / "c")).collect())) == [(0, "orders"), (1, "stock")]


def test_fnv(spark):
    def fnv(v):
        h = generators.FNV_BASIS
        for i in range(8):
            h = (h ^ (v >> 8 * i & 255)) * generators.FNV_PRIME % (1 << 64)
        return h

    values = [0, 1, 255, 256, (1 << 62) + 12345]
    got = spark.createDataFrame([(v,) for v in values], "v long").select(generators.fnv1a(F.col("v")).alias("h")).collect()
    assert [int(r.h) for r in got] == [fnv(v) for v in values]


def test_population_invariants(spark):
    p = generators.population(spark, warehouses=2, districts=3, customers=20, items=30, orders=15, suppliers=5)
    assert p["new_order"].count() == 2 * 3 * 4
    lines = p["order_line"].groupBy("w_id", "d_id", "o_id").agg(F.count("*").alias("n"), F.count("ol_delivery_d").alias("d"))
    both = p["orders"].join(lines, ["w_id", "d_id", "o_id"])
    assert both.where("n <> o_ol_cnt OR (o_carrier_id IS NULL) <> (d = 0)").count() == 0
    assert p["orders"].where("o_id = 1").first().o_entry_d == 1_700_000_000_000 - generators.HISTORY_MS
    assert p["orders"].where("o_id = 15").first().o_entry_d == 1_700_000_000_000
    again = generators.population(spark, warehouses=2, districts=3, customers=20, items=30, orders=15, suppliers=5)
    assert sorted(map(tuple, again["stock"].collect())) == sorted(map(tuple, p["stock"].collect()))


def test_reads(spark):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    assert reads.exists(df, "k", 5) and not reads.exists(df, "k", 500)
    assert reads.first_by_key(reads.scan(df, "k", 10, 20), "k", F.col("v") == 0).first().k == 14
    total = lambda s, b: s + sum(b.column("v").to_pylist())
    for parts in (1, 9, 30):
        assert reads.fold_with(df.repartition(parts), int, total, lambda a, b: a + b, fan_in=4) == sum(i % 7 for i in range(100))
    assert reads.fold_with(df.where("false"), int, total, lambda a, b: a + b) == 0
    assert sorted(r.k for r in reads.visited_until(df.repartition(5), "k", F.col("v") == 6).collect()) == list(range(7))
    assert reads.visited_until(df, "k", F.col("v") > 6).count() == 100
    assert reads.visit_until(df.coalesce(1).orderBy("k"), lambda r: r.k < 9) == 10
    got = df.select(reads.byte_sum(F.col("k").cast("string")).alias("s"), "k").where("k = 99").first().s
    assert got == 2 * ord("9")


def test_streams_over_several_batches(spark, tmp_path):
    path = str(tmp_path / "ops")
    for part in ([(1, 1, "I"), (2, 2, "U")], [(3, 1, "U"), (4, 1, "D")], [(5, 1, "U"), (6, 2, "I")]):
        spark.createDataFrame(part, "seq long, key long, op string").coalesce(1).write.mode("append").parquet(path)
    out = jobs.stateful_outcomes(jobs.source(spark, path, 1000))
    assert {r.seq: r.outcome for r in spark.read.parquet(out).collect()} == {1: "Inserted", 2: "KeyDoesNotExist", 3: "Updated", 4: "Deleted", 5: "KeyAlreadyDeleted", 6: "Inserted"}
    table = jobs.arrival_upsert(jobs.source(spark, path, 1), "key long, op string", "key", "seq")
    assert sorted(map(tuple, table.collect())) == [(1, "U"), (2, "I")]


def test_state_takes_several_operations_of_a_key_at_once(spark, tmp_path):
    r, path = random.Random(8), str(tmp_path / "ops")
    ops = [(i, r.randrange(5), r.choice("IUDU")) for i in range(300)]
    for part in (ops[:140], ops[140:150], ops[150:]):
        spark.createDataFrame(part, "seq long, key long, op string").coalesce(1).write.mode("append").parquet(path)
    live, ever, want = set(), set(), {}
    for seq, key, op in ops:
        missing = "KeyAlreadyDeleted" if key in ever else "KeyDoesNotExist"
        want[seq] = {"I": "KeyAlreadyExists" if key in live else "Inserted", "U": "Updated" if key in live else missing, "D": "Deleted" if key in live else missing}[op]
        if op == "I":
            live.add(key)
            ever.add(key)
        if op == "D":
            live.discard(key)
    for files in (1, 1000):
        out = spark.read.parquet(jobs.stateful_outcomes(jobs.source(spark, path, files)))
        assert {x.seq: x.outcome for x in out.collect()} == want


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    """The same folder and checkpoint, more files; then a batch that comes again."""
    src, path = str(tmp_path / "in"), str(tmp_path / "table")
    add = lambda rows: spark.createDataFrame(rows, "seq long, key long, op string").coalesce(1).write.mode("append").parquet(src)
    add([(i, i % 50, "a") for i in range(100)])
    first = jobs.arrival_upsert(jobs.source(spark, src, 1), "key long, op string", "key", "seq", path)
    assert sorted(map(tuple, first.collect())) == [(i, "a") for i in range(50)]
    add([(100, 3, "b"), (101, 77, "b")])
    then = jobs.arrival_upsert(jobs.source(spark, src, 1), "key long, op string", "key", "seq", path)
    want = sorted([(i, "b" if i == 3 else "a") for i in range(50)] + [(77, "b")])
    assert sorted(map(tuple, then.collect())) == want
    table = jobs.Buckets(spark, path, "key long, op string", "key")
    last, held = table._logged()
    table.change(spark.createDataFrame([(3, "z")], "key long, op string"), last, lambda old, new: new)  # logged already
    assert sorted(map(tuple, table.read().collect())) == want
    # A batch that failed after writing its data, but before its log, is written anew.
    spark.createDataFrame([(9, "half")], "key long, op string").write.parquet(f"{path}/data/batch={last + 1}/bucket=0")
    assert sorted(map(tuple, table.read().collect())) == want
    table.change(spark.createDataFrame([(3, "c")], "key long, op string"), last + 1, lambda old, new: old.where("key <> 3").unionByName(new))
    assert dict(map(tuple, table.read().collect())) == dict(want) | {3: "c"}


def test_updates_near_the_tail_need_their_row(spark, tmp_path):
    src = str(tmp_path / "in")
    for rows in ([(1, 5, "x", "hot_update"), (2, 5, "a", "arrival")], [(3, 5, "b", "hot_update"), (4, 6, "c", "hot_update")], [(5, 6, "d", "arrival")]):
        spark.createDataFrame(rows, "seq long, key long, v string, op string").coalesce(1).write.mode("append").parquet(src)
    for files in (1, 10):
        got = jobs.hot_tail(jobs.source(spark, src, files), "key long, seq long, v string", "key", "seq")
        assert sorted(map(tuple, got.collect())) == [(5, 3, "b"), (6, 5, "d")]


def test_running_sums_over_slices(spark):
    r = random.Random(3)
    rows = [(r.choice("aab"), i, r.randint(1, 9)) for i in range(400)]
    got = sequence.running(spark.createDataFrame(rows, "g string, i long, v long").repartition(6), ["g"], "i", F.floor(F.col("i") / 7), F.col("v"), "s").collect()
    total = {}
    want = {}
    for g, i, v in rows:
        total[g] = total.get(g, 0) + v
        want[i] = total[g]
    assert {x.i: x.s for x in got} == want


def test_tumbling_counts_take_rows_however_late(spark, tmp_path):
    """A file a batch, each 100 days before the last one; then more files for the same table."""
    src, path, day = str(tmp_path / "in"), str(tmp_path / "table"), 86_400
    spark.createDataFrame([(None,)], "s long").select(F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(src)
    want = {None: 1}
    for i in range(4):
        start = (900 - 100 * i) * day
        spark.createDataFrame([(start + x,) for x in (0, 5, day - 1)], "s long").select(F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(src)
        want[start] = 3
    counts = lambda: {x.s: x.n for x in jobs.tumbling_counts(jobs.source(spark, src, 1), "ts", "1 day", path=path).select(F.unix_seconds("start").alias("s"), "n").collect()}
    assert counts() == want
    spark.createDataFrame([(None,), (600 * day,), (-1,)], "s long").select(F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(src)
    assert counts() == want | {None: 2, 600 * day: 4, -day: 1}
