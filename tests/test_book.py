import random

from pyspark.sql import functions as F

from tidemark.functions.arrays import levels
from tidemark.operators import book
from tidemark.streaming.books import LiveBook, sampled_books


def _levels(*pairs):
    return [{"price": float(p), "qty": float(q)} for p, q in pairs]


def _plain_book(messages):
    """Bids and asks that the messages leave: price to quantity."""
    sides = ({}, {})
    for kind, update, changes in messages:
        if kind == "snapshot" or update == 1:
            sides = ({}, {})
        for side, pairs in zip(sides, changes, strict=True):
            for price, qty in pairs:
                side.pop(price, None)
                if qty:
                    side[price] = qty
    return sides


def test_live_books_equal_a_plain_fold():
    rng = random.Random(17)
    for _ in range(40):
        live, messages = LiveBook(), []
        for n in range(rng.randint(1, 30)):
            kind = "snapshot" if not n or rng.random() < 0.05 else "delta"
            update = 1 if n and rng.random() < 0.05 else n + 2
            pairs = lambda low: [(low + k / 2, rng.choice([0, 1, 2.5, 7])) for k in rng.sample(range(12), rng.randint(0, 5))]
            changes = pairs(90.0), pairs(100.0)
            messages.append((kind, update, changes))
            live.apply(kind, update, 100 + n, *(_levels(*c) for c in changes))
            assert (live.update_id, live.seq) == (update, 100 + n)
            bids, asks = _plain_book(messages)
            assert live.top(6) == (sorted(bids.items(), reverse=True)[:6], sorted(asks.items())[:6])


def test_old_version_does_not_clean_the_book():
    b = LiveBook()
    b.apply("snapshot", 5, 1, _levels((100, 1)), _levels((101, 1)))
    version = b.version
    b.apply("delta", 6, 2, _levels((100, 3)), [])
    b.saved(version)
    assert b.dirty
    b.saved(b.version)
    assert not b.dirty


def test_strict_book_ignores_updates_before_a_snapshot():
    b = LiveBook(strict=True)
    assert b.apply("delta", 7, 1, _levels((100, 1)), []) == 0 and b.top(1) == ([], [])


def test_rebuild_in_batch_equals_the_fold(spark):
    rows = [("s", 1, 1, True, "bid", 100.0, 2.0), ("s", 1, 1, True, "ask", 101.0, 3.0), ("s", 2, 2, False, "bid", 100.0, 4.0), ("s", 3, 3, False, "ask", 101.0, 0.0), ("s", 4, 4, False, "ask", 102.0, 1.0), ("t", 1, 9, False, "bid", 5.0, 1.0)]
    df = spark.createDataFrame(rows, "sym string, ts_ms long, event_id long, is_snapshot boolean, side string, price double, qty double")
    got = book.book_as_of(book.with_epoch(df, ["sym"], ["ts_ms", "event_id"], "ts_ms"), ["sym"], ["ts_ms", "event_id"])
    assert sorted(tuple(r) for r in got.collect()) == [("s", "ask", 102.0, 1.0), ("s", "bid", 100.0, 4.0)]


def test_metrics_of_empty_and_crossed_books(spark):
    rows = [(1, [["100", "2"], ["99", "3"]], [["101", "4"]]), (2, [], [["101", "4"]]), (3, [["102", "1"]], [["101", "1"]]), (4, [["x", "1"]], [["101", "1"]])]
    df = spark.createDataFrame(rows, "id int, b array<array<string>>, a array<array<string>>").select("id", levels("b").alias("b"), levels("a").alias("a"))
    got = {r.id: r for r in df.select("id", *(c.alias(n) for n, c in book.book_metrics(F.col("b"), F.col("a")).items())).collect()}
    assert got[1].book_valid == 1 and got[1].mid == 100.5 and got[1].bid_depth == 5 and abs(got[1].imbalance - 1 / 9) < 1e-12
    assert all(got[k].book_valid == 0 and got[k].mid is None and got[k].imbalance is None for k in (2, 3, 4))


def test_stream_of_books_is_sampled(spark, tmp_path):
    schema = "symbol string, ts_ms long, type string, update_id long, seq long, bids array<struct<price:double,qty:double>>, asks array<struct<price:double,qty:double>>"
    rows = [("s", 0, "snapshot", 1, 1, _levels((100, 1)), _levels((101, 1))), ("s", 400, "delta", 2, 2, _levels((100, 2)), []), ("s", 1200, "delta", 3, 3, _levels((100.5, 1)), []), ("s", 1300, "delta", 4, 4, [], _levels((101, 0)))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = sampled_books(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 1000)
    q = stream.writeStream.format("memory").queryName("books").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.ts_ms, r.best_bid) for r in spark.table("books").orderBy("ts_ms").collect()] == [(0, 100.0), (1200, 100.5)]
