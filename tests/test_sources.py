import json
import tarfile

import pytest

from tidemark.operators import episodes
from tidemark.sources import archives, messages, rest, tables
from tidemark.streaming import flows


def _archive(path, rows, name="market.jsonl", manifest=True):
    lines = "".join((json.dumps(r) if isinstance(r, dict) else r) + "\n" for r in rows)
    with tarfile.open(path, "w:gz") as tar:
        for member, text in ([("manifest.json", json.dumps({"batchId": "b1", "startMs": 1, "endMs": 9, "rows": len(rows)}))] if manifest else []) + [(name, lines)]:
            f = path.parent / "x"
            f.write_text(text)
            tar.add(f, member)


def test_archives_are_read_in_place(spark, tmp_path):
    rows = [{"_channel": "spot_trades", "tsRecordMs": 1_700_000_000_000 + 1000 * i, "price": 100 + i} for i in range(3)]
    _archive(tmp_path / "a.tar.gz", [rows[0], "", "not json", rows[1], "[1]", rows[2]])
    _archive(tmp_path / "b.tar.gz", rows, name="records_1.jsonl", manifest=False)
    paths = archives.discover(str(tmp_path))
    assert [p[-8:] for p in paths] == ["a.tar.gz", "b.tar.gz"]
    got = archives.read_archives(spark, paths)
    assert got.count() == 3 and archives.read_archives(spark, paths, dense=True).count() == 6
    assert archives.read_binary(spark, str(tmp_path)).count() == 3
    m = archives.measured(got).first()
    assert (m.start_ms, m.end_ms, m.n_rows) == (1_700_000_000_000, 1_700_000_002_000, 3)
    assert [(r.archive, r.batch_id, r.n_rows) for r in archives.manifests(spark, paths).collect()] == [("b.tar.gz", None, None), ("a.tar.gz", "b1", 6)]


def test_catalogue_prefers_archives(spark):
    make = lambda *rows: spark.createDataFrame(rows, "batch_id string, n long")
    got = archives.catalogue({"current": make(("a", 1), ("c", 3)), "staging": make(("a", 2), ("b", 5)), "archive": make(("a", 9))})
    assert sorted((r.batch_id, r.n, r.place) for r in got.collect()) == [("a", 9, "archive"), ("b", 5, "staging"), ("c", 3, "current")]


def test_written_archive_reads_back(spark, tmp_path):
    rows = spark.createDataFrame([(i, 1000 * i, "spot" if i % 2 else "perp") for i in range(60)], "id long, ts_ms long, channel string")
    path = tables.write_archive(rows, str(tmp_path), "batch1")
    got = archives.read_archives(spark, [path])
    assert [json.loads(r.value)["id"] for r in got.orderBy("line").collect()] == list(range(60))
    assert not list(tmp_path.glob("*.partial"))


def test_day_cache(spark, tmp_path):
    path, day = str(tmp_path / "cache"), tables.DAY
    rows = spark.createDataFrame([(0, 1.0), (day, 2.0), (day, 3.0), (2 * day, 4.0)], "at_ms long, v double").withColumn("tie", __import__("pyspark.sql.functions", fromlist=["col"]).col("v"))
    assert tables.missing_days(spark, path, "n", "s", 0, day, 9 * day) == [0, 1]
    tables.write_days(rows, path, "at_ms", "n", "s")
    tables.write_days(rows.where("at_ms = 0").selectExpr("at_ms", "v + 5 as v", "tie"), path, "at_ms", "n", "s")
    got = tables.read_range(spark, path, "at_ms", "n", "s", 0, day, "tie")
    assert sorted((r.at_ms, r.v) for r in got.collect()) == [(0, 6.0), (day, 3.0)]
    assert tables.missing_days(spark, path, "n", "s", 0, 3 * day, 2 * day) == [2, 3]
    with pytest.raises(LookupError):
        tables.missing_days(spark, path, "n", "s", 0, 3 * day, 2 * day, offline=True)


def test_messages(spark):
    def message(topic, data, **more):
        return (json.dumps({"topic": topic, "ts": 5, "data": data, **more}),)

    df = spark.createDataFrame(
        [
            message("publicTrade.X", [{"T": 1, "s": "X", "S": "Buy", "p": "10", "v": "2", "i": "a", "seq": 0}, {"T": 2, "s": "X", "S": "Sell", "p": "NaN", "v": "1", "i": "b"}, {"s": "X", "p": "1", "v": "1"}]),
            message("allLiquidation.X", [{"T": 3, "s": "X", "S": "Buy", "p": "9", "v": "x"}]),
            message("liquidation.X", {"T": 4, "s": "X", "S": "Sell", "p": "8", "v": "1"}),
            message("orderbook.50.X", {"s": "X", "u": 7, "seq": 8, "b": [["1", "2"]], "a": []}, type="snapshot", cts=6),
            ("oops",),
        ],
        "value string",
    )
    [t] = messages.parse_trades(df).collect()
    assert (t.trade_ms, t.side, t.price, t.size, t.seq, t.block_trade) == (1, "Buy", 10.0, 2.0, None, False)
    assert sorted((r.liquidation_ms, r.size) for r in messages.parse_liquidations(df).collect()) == [(3, None), (4, 1.0)]
    [b] = messages.parse_books(df).collect()
    assert (b.type, b.update_id, b.bids[0].qty, b.asks) == ("snapshot", 7, 2.0, [])
    assert [r.channel for r in messages.route(df).collect()] == ["trades", "liquidations", "liquidations", "orderbook", None]
    dense = messages.dense_records(df)
    assert sorted(r.kind for r in dense.collect()) == ["ob_snapshot", "trade"]
    assert [r.kind for r in messages.normalise_dense(dense).collect()] == ["trade"]


def test_late_rows_come_out_in_order_and_are_kept(spark, tmp_path):
    schema = "channel string, ts_ms long, event_id long, payload string"
    for n, rows in enumerate([[("c", 100, 1, "a"), ("c", 600, 3, "c"), ("c", 300, 2, "b")], [("c", 50, 4, "late"), ("c", 2000, 5, "d")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if n == 0:
            stream = flows.reordered(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
            q = stream.writeStream.format("memory").queryName("ordered").outputMode("append").start()
        q.processAllAvailable()
    assert flows.status(q)["active"]
    q.stop()
    assert [(r.payload, r.late) for r in spark.table("ordered").collect()] == [("a", False), ("b", False), ("late", True), ("c", False)]


def test_stream_to_tables(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.range(20).select(F.timestamp_seconds(F.col("id") * 10).alias("ts"), F.lit("spot").alias("channel"), (F.col("id") % 5).alias("trade_id"), F.lit("Buy").alias("side"), F.lit(1.0).alias("size"), F.lit(2.0).alias("price"), F.lit(0).alias("day"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    flows.to_tables(flows.without_duplicates(stream, ["trade_id"]), str(tmp_path / "out"), str(tmp_path / "ck"), "one").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/one")).count() == 5
    q = flows.minute_bars(stream, "0 seconds").writeStream.format("memory").queryName("minutes").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.minute_ms, r.n) for r in spark.table("minutes").collect()} >= {(0, 6), (60_000, 6)}


def test_only_finished_archives_are_frozen(tmp_path):
    (tmp_path / "market.jsonl").write_text("{}\n" * 50_000)
    paths = [str(tmp_path / f"{n}.tar.gz") for n in ("whole", "cut", "growing", "absent", "empty")]
    for p in (paths[0], paths[1], paths[2], paths[4]):
        with tarfile.open(p, "w:gz") as t:
            if p != paths[4]:
                t.add(tmp_path / "market.jsonl", "market.jsonl")
    with open(paths[1], "r+b") as f:
        f.truncate(100)

    def writes(_: float) -> None:
        with open(paths[2], "ab") as f:
            f.write(b"more")

    frozen = str(tmp_path / "frozen.txt")
    assert archives.freeze([*paths, paths[0]], frozen, sleep=writes) == [paths[0]]
    assert archives.listed(frozen) == [paths[0]]
    assert archives.freeze([]) == []


def test_instruments_of_all_pages(spark):
    pages = {None: {"list": [{"symbol": "B", "tick": "0.1"}], "nextPageCursor": "x"}, "x": {"list": [{"symbol": "A", "more": {"k": [1]}}], "nextPageCursor": "x"}}
    got = {r.symbol: json.loads(r.info) for r in rest.instruments(spark, lambda p: pages[p.get("cursor")], {"category": "linear"}).collect()}
    assert got == {"A": {"symbol": "A", "more": {"k": [1]}}, "B": {"symbol": "B", "tick": "0.1"}}
    assert rest.instruments(spark, lambda p: {}, {}).count() == 0


def test_ranges_over_policies(spark):
    m = spark.createDataFrame([(1.0, 5), (None, 7), (-2.0, None)], "a double, b int")
    got = {r.metric: (r.least, r.most, r.n) for r in episodes.range_report(m, ["a", "b"]).collect()}
    assert got == {"a": (-2.0, 1.0, 2), "b": (5.0, 7.0, 2)}
