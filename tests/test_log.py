from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from framelake.functions.schema import Schema, SchemaError
from framelake.operators import index, log, ordering
from framelake.plans import catalog
from framelake.sources import framelog
from framelake.streaming import ingest


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def frames(spark, keys, length=10):
    return spark.createDataFrame([(i, length + i, k, k) for i, k in enumerate(keys)], "frame_no long, frame_len long, min_seq long, max_seq long")


@pytest.mark.parametrize("n", [1, 3, 8, 40, 700])
def test_ordering(spark, n):
    values = [(i * 37 % 101 * 3, i % 7) for i in range(101)]
    df = spark.createDataFrame(values, "k long, v long").repartition(5)
    before, total, want = None, 0, []
    for i, (k, v) in enumerate(sorted(values)):
        want.append((k, total, before, i + 11))
        total, before = total + v, v
    got = ordering.dense_numbers(ordering.previous(ordering.running_sum(df, "k", "v", "s", n), "k", "v", "p", n), "k", "i", 11, n)
    assert sorted(map(tuple, got.select("k", "s", "p", "i").collect())) == want
    assert ordering.running_sum(df.limit(0), "k", "v", "s", n).count() == 0


def test_layout_and_fence(spark):
    f = log.frame_layout(frames(spark, [1, 2, 3, 4]))
    assert rows(f, "frame_no", "frame_off") == [(0, 0), (1, 10), (2, 21), (3, 33)]
    assert rows(log.visible(f, 33), "frame_no") == [(0,), (1,), (2,)]
    assert rows(log.visible(f, 32), "frame_no") == [(0,), (1,)]
    assert rows(log.truncate(f, 46), "frame_no") == [(0,), (1,), (2,), (3,)]
    with pytest.raises(ValueError, match="beyond"):
        log.truncate(f, 47)
    assert log.log_stats(f).first().asDict() == {"n_frames": 4, "pos": 46, "last_seq": 4}
    assert log.log_stats(f.limit(0)).first().asDict() == {"n_frames": 0, "pos": 0, "last_seq": None}


@pytest.mark.parametrize(("keys", "want"), [([1, 2, 3], 3), ([1, 3, 2, 4], 2), ([1, 1], 1), ([0, 1], 0), ([], 0), ([5, 1, 6, 7], 1), ([2, None, 3], 1)])
def test_valid_prefix(spark, keys, want):
    assert log.scan_valid_prefix(frames(spark, keys)).count() == want


def test_damage_ends_a_scan_and_is_reported(spark):
    f = frames(spark, [1, 2, 3, 4]).withColumn("ok", F.col("frame_no") != 2)
    assert rows(log.scan_valid_prefix(f, ok=F.col("ok")), "frame_no") == [(0,), (1,)]
    got = log.scan_valid_prefix(f, ok=F.col("ok"), diagnostics=True)
    assert rows(got.where("not scanned").fillna("-"), "frame_no", "stop_reason") == [(2, "damaged"), (3, "-")]


def test_overlapping_ranges_differ_by_key(spark):
    f = spark.createDataFrame([(0, 10, 1, 9), (1, 10, 2, 5)], "frame_no long, frame_len long, min_seq long, max_seq long")
    assert log.scan_valid_prefix(f).count() == 1
    assert log.scan_valid_prefix(f, "min_seq").count() == 2


def test_numbers_resume(spark):
    df = spark.range(10).repartition(3)
    assert rows(log.assign_seq(df, "id", 5, 3), "id", "seq") == [(i, i + 6) for i in range(10)]


@pytest.mark.parametrize("cap", [21, 100, 10_000])
def test_group_commit(spark, cap):
    sizes = {"a": [30, 1, 50, 60, 5, 5, 5, 200], "b": [500], "c": [7] * 40}
    df = spark.createDataFrame([(k, i, n) for k, v in sizes.items() for i, n in enumerate(v)], "log string, seq long, rec_len long").repartition(4)
    want = []
    for k, v in sizes.items():
        frame, fill = 0, None
        for i, n in enumerate(v):
            if fill is not None and fill >= cap:
                frame, fill = frame + 1, None
            fill = (20 if fill is None else fill) + n
            want.append((k, i, frame))
    packed = log.group_commit(df, cap)
    assert rows(packed, "log", "seq", "frame_no") == sorted(want)
    assert log.sealed(packed).agg(F.sum("n_appends")).first()[0] == len(want)


def test_limit(spark):
    df = spark.createDataFrame([(bytearray(4194283),), (None,)], "payload binary")
    assert log.reject_oversize(df).count() == 2
    big = spark.createDataFrame([(bytearray(4194284),)], "payload binary")
    assert not big.select(log.fits(F.col("payload"))).first()[0]
    with pytest.raises(Exception, match="storage limit"):
        log.reject_oversize(big).collect()


def test_index(spark):
    r = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, None)], "seq long, v string")
    assert rows(index.index_bucket(r, F.col("v")).fillna("-"), "value", "n_seq", "first_seq", "last_seq") == [("-", 1, 4, 4), ("x", 2, 1, 3), ("y", 1, 2, 2)]
    assert rows(index.search(index.index_entries(r, F.col("v"), n=2), "x"), "seq") == [(1,), (3,)]
    assert rows(index.seq_lookup(r, [2, 9]), "v") == [("y",)]
    schemas = spark.createDataFrame([(1, "s")], "schema_seq long, name string")
    tagged = r.withColumn("schema_seq", F.col("seq") % 2)
    for most in (64, 0):
        assert rows(index.schema_resolve(tagged, schemas, most).fillna("-"), "seq", "name") == [(1, "s"), (2, "-"), (3, "s"), (4, "-")]
    merged = index.compact([r.where("seq < 3"), r.where("seq > 2").withColumn("more", F.lit(1))], 2)
    assert rows(merged.fillna(0), "seq", "more") == [(1, 0), (2, 0), (3, 1), (4, 1)]


def test_the_registered_query_numbers_every_event(spark, tmp_path):
    spark.createDataFrame([(i * 2, "x") for i in range(20)], "event_id long, event_type string").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    assert rows(catalog.assign_seq(spark, str(tmp_path)), "event_id", "seq") == [(i * 2, 1001 + i) for i in range(20)]


def test_overlapping_logs_keep_every_value(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", None)], "seq long, v string, old int").repartition(2)
    new = spark.createDataFrame([(2, "B", "n"), (3, None, "m"), (4, "d", None)], "seq long, v string, more string").repartition(2)
    assert sorted(map(tuple, index.compact([old, new], 2).collect())) == [(1, "a", 1, None), (2, "B", 2, "n"), (3, "c", None, "m"), (4, "d", None, None)]
    assert rows(index.compact([old.select("seq"), new.select("seq")]), "seq") == [(1,), (2,), (3,), (4,)]
    spark.range(700).selectExpr("id AS event_id", "'t' AS event_type", "'x' AS props").write.parquet(f"{tmp_path}/events.parquet")
    assert rows(catalog.compact(spark, str(tmp_path)).fillna("-"), "seq", "event_type") == [(i, "t" if i > 300 else "-") for i in range(1, 701)]


@pytest.mark.parametrize("n", [1, 4, 30])
def test_walk_stops_at_the_least_key(spark, n):
    values = [(i, i * 10 % 37 if i != 61 else None) for i in range(100)]
    df = spark.createDataFrame(values, "k long, v long").repartition(4)
    for bad in ([], [0], [99], [40, 41], [13, 77]):
        got = ordering.walk(df, "k", {"s": "v"}, {"p": "v"}, n, stop=lambda b: F.col("k").isin(bad) & (b["p"].isNotNull() | (F.col("k") == 0)))
        want = min(bad, default=None)
        assert {r[ordering.STOP] for r in got.collect()} == {want}
    walked = sorted(map(tuple, ordering.walk(df, "k", {"s": "v"}, {"p": "v"}, n).select("k", "s", "p").collect()))
    assert walked == [(k, sum(v or 0 for _, v in values[:k]), values[k - 1][1] if k else None) for k, _ in values]


def test_made_records(spark):
    made = log.generate(spark, 50, seed=3, payload=b"x").collect()
    assert sorted(r.seq for r in made) == list(range(1, len(made) + 1))
    by = {}
    for r in made:
        by.setdefault(r.txn, []).append(r.seq)
    assert sorted(by) == list(range(50)) and all(2 <= len(v) <= 20 for v in by.values())
    assert all(sorted(v) == list(range(min(v), min(v) + len(v))) for v in by.values())
    assert {bytes(r.payload) for r in made} == {b"x"} and {r.schema_seq for r in made} == {1}


def test_saved_indexes(spark, tmp_path):
    r = spark.range(1, 2001).select(F.col("id").alias("seq"), (F.col("id") % 40).alias("v"))
    index.save_index(r, F.col("v"), f"{tmp_path}/index", n=4)
    found = index.search_saved(spark, f"{tmp_path}/index", 7)
    assert rows(found, "seq") == [(i,) for i in range(7, 2001, 40)]
    assert "PushedFilters: [IsNotNull(value), EqualTo(value,7)]" in found._jdf.queryExecution().toString()


def test_records_by_number(spark, tmp_path):
    framelog.register(spark)
    path = f"{tmp_path}/log"
    r = spark.range(1, 301).select(F.col("id").alias("seq"), F.lit(1).alias("schema_seq"), F.encode(F.col("id").cast("string"), "utf-8").alias("payload"))
    for lo in (1, 151):
        r.where(f"seq >= {lo} and seq < {lo + 150}").repartitionByRange(3, "seq").sortWithinPartitions("seq").write.format("framelog").option("group_bytes", "200").mode("append").save(path)
    index.seq_map(spark.read.format("framelog").load(path), 3).write.parquet(f"{tmp_path}/map")
    saved = spark.read.parquet(f"{tmp_path}/map")
    got = index.fetch(spark, path, saved, [1, 77, 150, 151, 300, 301])
    assert sorted((int(x.seq), bytes(x.payload)) for x in got.collect()) == [(i, b"%d" % i) for i in (1, 77, 150, 151, 300)]
    assert index.fetch(spark, path, saved, []).count() == index.fetch(spark, path, saved, [999]).count() == 0


def test_schemas_in_the_log(spark, tmp_path):
    path = f"{tmp_path}/log"
    with pytest.raises(SchemaError):
        index.schema_payload("s", '{"a": "Nothing"}')
    declared = bytearray(index.schema_payload("s", '{"a": "Int", "b": {"c": "Bool?"}}', 3))
    ingest.append(spark.createDataFrame([(1, declared, index.SCHEMA_FLAG), (2, bytearray(b"x"), 1), (3, bytearray(b"y"), 9)], "at long, payload binary, schema_seq long"), path, "at")
    r = spark.read.format("framelog").load(path)
    (s,) = index.schemas_in(r).collect()
    assert (int(s.schema_seq), s.schema, s.version) == (1, "s", 3) and Schema.from_json("s", s.declaration).fields[1].name == "b.c"
    got = index.schema_resolve(index.data_in(r), index.schemas_in(r)).orderBy("seq").collect()
    assert [(int(x.seq), x.schema) for x in got] == [(2, "s"), (3, None)]


def test_migration(spark):
    make = lambda version, d, name="s": replace(Schema.from_json(name, d), version=version)
    old = make(1, {"id": "Int", "name": "String 5", "gone": "Bool"})
    new = make(2, {"id": "Int", "name": "String 3", "more": "Float?"})
    df = spark.createDataFrame([(1, "ab", True)], "id long, name string, gone boolean")
    got = index.migrate(df, old, new, "id")
    assert got.columns == ["id", "more", "name"] and [tuple(r) for r in got.collect()] == [(1, None, "ab")]
    long = spark.createDataFrame([(1, "abcd", True)], "id long, name string, gone boolean")
    with pytest.raises(Exception, match="does not fit: name"):
        index.migrate(long, old, new, "id").collect()
    for bad, key in ((make(1, {"id": "Int"}), None), (make(2, {"id": "Int"}, "t"), None), (make(2, {"id": "Int?"}), "id"), (make(2, {"x": "Int?"}), "id"), (make(2, {"id": "Int", "must": "Int"}), "id")):
        with pytest.raises(SchemaError):
            index.migrate(df, old, bad, key)


def test_a_table_by_primary_key(spark):
    r = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "a", None), (4, None, 9)], "seq long, k string, v int")
    assert rows(index.latest_per_key(r, "k").fillna(-1), "seq", "k", "v") == [(2, "b", 2), (3, "a", -1)]
