import datetime as dt

import pytest
from pyspark.sql import functions as F

from probitas.keys import ProbitasError
from probitas.operators import metrics as M
from probitas.sources import CachedStore, CacheStats, MemoryStore, ParquetStore, StoredMetric
from probitas.sources.store import with_created
from probitas.streaming import StateTable, stream_metrics, windowed_metrics

D = dt.date(2024, 5, 1)
T0 = dt.datetime(2024, 5, 2)


@pytest.fixture(params=["memory", "parquet"])
def store(request, spark, tmp_path):
    return MemoryStore() if request.param == "memory" else ParquetStore(spark, str(tmp_path / "store"))


def row(value, day=D, created=T0, **kw):
    return with_created(StoredMetric("sum", "sum(x)", "ds", value, day, **kw), created)


def test_latest_wins_and_windows(store):
    hour = dt.timedelta(hours=1)
    store.persist([row(1.0, tags={"a": "1"}, execution_id="e1"), row(2.0, created=T0 + hour, tags={"a": "1"}, execution_id="e2"), row(3.0, created=T0 + 2 * hour, tags={"a": "2"}, execution_id="e2")])
    store.persist([row(9.0, day=D - dt.timedelta(days=2)), row(5.0, parameters='{"p": 1}')])
    assert store.get_metric("sum(x)", "ds", D).value == 3.0
    assert store.get_metric("sum(x)", "ds", D, tags={"a": "1"}).value == 2.0
    assert store.get_metric("sum(x)", "ds", D, tags={"a": "1"}, execution_id="e1").value == 1.0
    assert store.get_metric("sum(x)", "ds", D, parameters='{"p": 1}').value == 5.0
    assert store.get_metric("sum(x)", "other", D) is None
    window = store.get_metric_window("sum(x)", "ds", D - dt.timedelta(days=5), D)
    assert {d: r.value for d, r in window.items()} == {D: 3.0, D - dt.timedelta(days=2): 9.0}
    assert sorted(r.value for r in store.get_by_execution_id("e2")) == [2.0, 3.0]


def test_deletion_and_expiry(store):
    old, young = row(1.0, ttl_hours=1), row(2.0, ttl_hours=100)
    store.persist([old, young])
    now = T0 + dt.timedelta(hours=2)
    assert store.exists(old.metric_id) and (store.stats(now).total, store.stats(now).expired) == (2, 1)
    assert store.delete_expired(now) == 1 and not store.exists(old.metric_id) and store.delete_expired(now) == 0
    store.delete(young.metric_id)
    assert store.stats(now).total == 0


def test_compaction(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "a"))
    rows = [row(float(k)) for k in range(3)]
    store.persist(rows)
    store.delete(rows[0].metric_id)
    assert store.compact(str(tmp_path / "b")).stats(T0).total == 2


def events(spark, path, parts):
    for part in parts:
        spark.createDataFrame(part, "k string, x double, ts timestamp").coalesce(1).write.mode("append").parquet(path)


def test_states_of_a_stream(spark, tmp_path):
    at = dt.datetime(2024, 5, 1)
    parts = [[("a", 1.0, at), (None, 3.0, at), ("a", None, at), ("b", 5.0, at)], [("a", 4.0, at), ("c", 2.0, at)], [("b", 7.0, at), ("a", 1.0, at)]]
    events(spark, f"{tmp_path}/in", parts)
    metrics = [M.num_rows(), M.total("x"), M.average("x"), M.variance("x"), M.minimum("x"), M.maximum("x"), M.null_count("x")]
    table = StateTable(spark, f"{tmp_path}/states", metrics, ["k"])
    stream = spark.readStream.schema("k string, x double, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream_metrics(stream, table, f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(120)
    whole = spark.read.parquet(f"{tmp_path}/in")
    expected = {r["k"]: r for r in whole.groupBy("k").agg(*(m.column().alias(m.name) for m in metrics)).collect()}
    got = {r["k"]: r for r in table.frame().collect()}
    assert set(got) == set(expected)
    for k, r in expected.items():
        for m in metrics:
            assert got[k][m.name] == (None if r[m.name] is None else pytest.approx(r[m.name])), (k, m.name)
    table.add(whole.limit(0), 0)  # a batch that is run again replaces itself
    with pytest.raises(ProbitasError):
        StateTable(spark, "x", [M.unique_count("x")], ["k"])


def test_windows_with_a_watermark(spark, tmp_path):
    at = dt.datetime(2024, 5, 1)
    minute = dt.timedelta(minutes=1)
    first = [("a", float(k), at + k * minute) for k in range(30)]
    events(spark, f"{tmp_path}/in", [first])
    stream = spark.readStream.schema("k string, x double, ts timestamp").parquet(f"{tmp_path}/in")
    query = windowed_metrics(stream, "ts", "10 minutes", [M.num_rows(), M.total("x")], "5 minutes").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = spark.table("windows").orderBy("start").select("start", F.col("`num_rows()`").alias("n"), F.col("`sum(x)`").alias("s")).collect()
    assert [(r.start, r.n, r.s) for r in rows] == [(at, 10.0, 45.0), (at + 10 * minute, 10.0, 145.0), (at + 20 * minute, 10.0, 245.0)]


def test_write_back_cache():
    day = dt.date(2024, 5, 1)
    row = lambda v, **kw: StoredMetric("sum", "sum(x)", "d", v, day, **kw)
    below = MemoryStore()
    below.persist([row(1.0, execution_id="old")])
    cache = CachedStore(below, most_dirty=3)
    assert [cache.get_metric("sum(x)", "d", day).value for _ in range(3)] == [1.0] * 3
    assert (cache.counts.hits, cache.counts.misses) == (2, 1) and cache.counts.hit_ratio == pytest.approx(2 / 3)
    new = row(2.0, execution_id="new")
    cache.persist([new])
    assert cache.get_metric("sum(x)", "d", day).value == 2.0 and below.stats().total == 1
    assert cache.is_dirty(new.metric_id) and cache.counts.dirty == 1 and cache.exists(new.metric_id)
    assert [r.value for r in cache.get_by_execution_id("new")] == [2.0] and cache.stats().total == 2
    cache.persist([row(3.0), row(4.0)])  # as many as are held back at most
    assert below.stats().total == 4 and cache.counts.dirty == 0 and cache.get_metric("sum(x)", "d", day).value == 4.0
    cache.persist([gone := row(5.0)])
    cache.delete(gone.metric_id)
    assert cache.counts.dirty == 0 and cache.get_metric("sum(x)", "d", day).value == 4.0
    with cache:
        cache.persist([row(6.0)])
    assert below.stats().total == 5 and cache.flush() == 0
    assert cache.delete_expired(dt.datetime(2999, 1, 1)) == 5 and cache.get_metric("sum(x)", "d", day) is None
    assert CacheStats().hit_ratio == 0.0


def test_parquet_store_behind_a_cache(spark, tmp_path):
    store = ParquetStore(spark, f"{tmp_path}/store")
    with CachedStore(store) as cache:
        for k in range(5):
            cache.persist([StoredMetric("sum", "sum(x)", "d", float(k), dt.date(2024, 5, 1 + k))])
    assert store.stats().total == 5 and len(list((tmp_path / "store/metrics").glob("*/*.parquet"))) == 5
