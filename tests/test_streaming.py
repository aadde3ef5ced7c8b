from datetime import datetime

import pytest

from lodestack.operators.policy import Breaker
from lodestack.plans.pipeline import Store
from lodestack.schemas import ITEM_COLUMNS
from lodestack.streaming import incremental as S
from tests.test_queries import batch


def drain(df, name, mode, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return df.sparkSession.table(name).collect()


def stream(spark, tmp_path, rows, schema, files=2):
    folder = tmp_path / "in"
    for k in range(files):
        spark.createDataFrame(rows[k::files], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_daily_counts_drop_late_rows_only(spark, tmp_path):
    rows = [(datetime(2026, 1, d, h), "x") for d in (1, 2, 3, 9) for h in (1, 20)]
    got = drain(S.daily_counts(stream(spark, tmp_path, rows, "ts timestamp, url string"), "ts", "30 days"), "daily", "update", tmp_path)
    best = {}
    for r in got:
        best[str(r.day)] = max(r.n, best.get(str(r.day), 0))
    assert best == {"2026-01-01": 2, "2026-01-02": 2, "2026-01-03": 2, "2026-01-09": 2}


def test_new_urls(spark, tmp_path):
    rows = [(datetime(2026, 1, 1, h), f"HTTP://A.test/{h % 3}#{h}") for h in range(9)]
    got = drain(S.new_urls(stream(spark, tmp_path, rows, "ts timestamp, url string")), "urls", "append", tmp_path)
    assert sorted(r.canon for r in got) == [f"http://a.test/{k}" for k in range(3)]


def test_last_seen(spark, tmp_path):
    rows = [(datetime(2026, 1, 1, h), "u") for h in range(5)]
    got = drain(S.last_seen(stream(spark, tmp_path, rows, "ts timestamp, url string"), "url"), "seen", "complete", tmp_path)
    assert [(r.n, r.last_seen_at.hour) for r in got] == [(5, 4)]


def test_merge_stream(spark, tmp_path):
    rows = batch(spark, ("a", "1", "u", "T1"), ("a", "2", "u", "T2"), ("a", "1", "u", "T1"))
    rows = rows.selectExpr("*", "cast(null as string) raw", "cast(null as timestamp) posted_at").select(*ITEM_COLUMNS)
    rows.write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    items = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = S.merge_stream(items, store, datetime(2026, 1, 1), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None and sorted(r.external_id for r in store.read("job_items").collect()) == ["1", "2"]


@pytest.fixture
def rocks(spark):
    pytest.importorskip("google.protobuf")
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def test_breaker_stream(rocks, tmp_path):
    rows = [("h", float(t), ok) for t, ok in enumerate([False, False, False, True, False])]
    got = drain(S.breaker_stream(stream(rocks, tmp_path, rows, "host string, ts double, ok boolean", 1), 3, 2.0), "breaker", "append", tmp_path)
    b, want = Breaker(3, 2.0), []
    for _, t, ok in rows:
        allowed = b.admits(t)
        if allowed:
            b.record(ok, t)
        want.append((t, allowed, b.state))
    assert sorted((r.ts, r.allowed, r.state) for r in got) == want


def test_bucket_stream(rocks, tmp_path):
    rows = [("h", 0.0), ("h", 0.1), ("h", 0.2), ("g", 0.0)]
    got = drain(S.bucket_stream(stream(rocks, tmp_path, rows, "host string, ts double", 1), 1.0), "bucket", "append", tmp_path)
    assert [(r.host, r.ts, round(r.waited, 6)) for r in sorted(got, key=lambda r: (r.host, r.ts))] == [("g", 0.0, 0.0), ("h", 0.0, 0.0), ("h", 0.1, 0.9), ("h", 0.2, 1.8)]


def test_stale_stream(rocks, tmp_path):
    folder = tmp_path / "in"
    for day, ids in ((1, ["1", "2"]), (2, ["1"]), (9, ["3"]), (20, ["3"])):
        rocks.createDataFrame([("a", i, datetime(2026, 1, day)) for i in ids], "source string, external_id string, ts timestamp").coalesce(1).write.mode("append").parquet(str(folder))
    items = rocks.readStream.schema("source string, external_id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(folder))
    got = drain(S.stale_stream(items, 5 * 86400.0), "stale", "append", tmp_path)
    first = {r.external_id for r in got if r.is_active}
    gone = {(r.external_id, r["at"]) for r in got if not r.is_active}
    assert first == {"1", "2", "3"} and {("2", datetime(2026, 1, 6)), ("1", datetime(2026, 1, 7))} <= gone
