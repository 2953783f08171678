"""Jobs: import times."""

from minuteworks.operators import jobs as J


def test_times_that_the_clock_shows_twice(spark):
    rows = [("2024-10-27T02:17", "Europe/Berlin"), ("2024-11-03T01:04", "america/new_york"), ("2024-04-07T01:45", "Australia/Lord_Howe"), ("2024-10-27T01:59", "Europe/Berlin"), ("2024-10-26T12:00", "Europe/Berlin"), ("2024-03-31T02:30", "Europe/Berlin")]
    df = spark.createDataFrame(rows, "local_time string, timezone string")
    found = {r: [x["recorded_at"] and x["recorded_at"].strftime("%d %H:%M") for x in J.import_contexts(df, repeated=r).selectExpr("CAST(recorded_at AS timestamp_ntz) AS recorded_at").collect()] for r in ("earlier", "later")}
    assert found["earlier"] == ["27 00:17", "03 05:04", "06 14:45", "26 23:59", "26 10:00", None]
    assert found["later"] == ["27 01:17", "03 06:04", "06 15:15", "26 23:59", "26 10:00", None]
