import datetime as dt

from platewise.streaming import events as E


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_streams_equal_tables(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=17 * i), i % 3, "ab"[i % 2], float(i)) for i in range(300)]
    ddl = "event_id long, ts timestamp, user_id long, event_type string, value double"
    for i in range(3):
        spark.createDataFrame(rows[i * 100 : i * 100 + 100], ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    table = spark.read.parquet(f"{tmp_path}/e")
    run(E.daily_counts(E.source(spark, f"{tmp_path}/e", 3)), "days", "complete")
    assert sorted(map(tuple, spark.table("days").collect())) == sorted(map(tuple, E.daily_counts(table).collect()))
    run(E.running_profiles(E.source(spark, f"{tmp_path}/e")), "profiles", "update")
    last = {}
    for r in spark.table("profiles").collect():
        last[r["user_id"]] = max(last.get(r["user_id"], (0, 0.0)), (r["n"], r["total"]))
    assert last == {u: (100, float(sum(i for i in range(300) if i % 3 == u))) for u in range(3)}
