import datetime

from tidepanel.streaming import bars


def ticks(spark, tmp_path):
    start = datetime.datetime(2020, 1, 1)
    rows = [(k, k % 3, start + datetime.timedelta(minutes=7 * k), "t", float(k * 37 % 101), "{}") for k in range(300)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double, props string")
    for k, part in enumerate((df.where("event_id < 150"), df.where("event_id >= 150"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del k
    return df


def run(out, name, mode):
    q = out.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_stream_equals_batch(spark, tmp_path):
    df = ticks(spark, tmp_path)
    batch = bars.bars(df.selectExpr("user_id as instrument", "ts as date", "value as price"), "1 hour")
    run(bars.bars(bars.read_ticks(spark, str(tmp_path / "in")), "1 hour", late="2 hours"), "bars_out", "update")
    got = {}
    for r in spark.table("bars_out").collect():
        key = (r.instrument, r.date)
        got[key] = max(got.get(key, r), r, key=lambda x: x.ticks)
    assert {k: tuple(v) for k, v in got.items()} == {(r.instrument, r.date): tuple(r) for r in batch.collect()}
    run(bars.bars(bars.read_ticks(spark, str(tmp_path / "in")), "1 hour", late="2 hours"), "bars_append", "append")
    late = {(r.instrument, r.date): tuple(r) for r in spark.table("bars_append").collect()}
    whole = {(r.instrument, r.date): tuple(r) for r in batch.collect()}
    assert late and all(whole[k] == v for k, v in late.items())


def test_sessions_and_ledger(spark, tmp_path):
    df = ticks(spark, tmp_path).selectExpr("user_id as instrument", "ts as date", "value as price")
    assert bars.sessions(df, "22 minutes").count() == 3 and bars.sessions(df, "20 minutes").count() == 300
    fills = bars.read_ticks(spark, str(tmp_path / "in")).selectExpr("instrument", "date", "1.0D as size", "price")
    run(bars.ledger(fills), "ledger_out", "update")
    last = {}
    for r in spark.table("ledger_out").collect():
        last[r.instrument] = max(last.get(r.instrument, r), r, key=lambda x: x.fills)
    want = {r.instrument: r.s for r in df.groupBy("instrument").sum("price").withColumnRenamed("sum(price)", "s").collect()}
    assert {k: (v.held, -v.cash, v.fills) for k, v in last.items()} == {k: (100.0, s, 100) for k, s in want.items()}
