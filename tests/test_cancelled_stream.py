"""Results against closings of their tabs, as two streams."""

import random
from datetime import datetime, timedelta

from pagesieve.operators import store as S
from pagesieve.streaming import jobs

START = datetime(2024, 1, 1)
RESULTS = "event_id long, tab_id long, started_at timestamp, finished_at timestamp"
CLOSED = "tab_id long, closed_at timestamp"


def at(minutes):
    return None if minutes is None else START + timedelta(minutes=minutes)


def table(spark, rows, schema):
    times = [i for i, part in enumerate(schema.split(", ")) if part.endswith("timestamp")]
    return spark.createDataFrame([tuple(at(v) if i in times else v for i, v in enumerate(row)) for row in rows], schema)


def arrive(spark, folder, df):
    """A stream of files, of which ``df`` is the next."""
    df.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(spark, tmp_path, results, closed, **options):
    query = (jobs.drop_cancelled_stream(results, closed, **options).writeStream.format("parquet")
             .option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out"))
    query.awaitTermination()
    rows = spark.read.schema(results.schema).parquet(f"{tmp_path}/out").collect()
    return sorted(r.event_id for r in rows), query.recentProgress


def brute(results, closed):
    return sorted(e for e, tab, start, end in results if not any(
        tab is not None and tab == t and None not in (c, start, end) and start <= c <= end for t, c in closed))


def test_stream_is_batch_where_a_tab_closes_once(spark, tmp_path):
    results = [(1, 1, 0, 10), (2, 1, 20, 30), (3, 2, 0, 10), (4, 2, 5, 5), (5, 3, 0, 10), (6, None, 0, 10), (7, 4, 10, 0), (8, 2, 5, 9), (8, 2, 5, 9)]
    closed = [(1, 10), (2, 5), (3, 11), (None, 5), (4, 5)]
    r, c = table(spark, results, RESULTS), table(spark, closed, CLOSED)
    ended = jobs.with_ends(r, c)
    got, _ = run(spark, tmp_path, arrive(spark, f"{tmp_path}/r", ended[0]), arrive(spark, f"{tmp_path}/d", ended[1]))
    assert got == sorted(x.event_id for x in S.drop_cancelled(r, c).collect()) == brute(results, closed) == [2, 5, 6, 7]


def test_files_over_time_equal_brute_force_and_state_stays_small(spark, tmp_path):
    rng = random.Random(3)
    spans = [(60 * i, 60 * i + 60) for i in range(8)]
    results, closed, i = [], [], 0
    for n, (low, high) in enumerate(spans):
        # results arrive by their end, closings as they happen; some a few minutes late
        new = []
        for _ in range(200):
            end = rng.randrange(low, high)
            new.append((i, rng.choice([1, 1, rng.randrange(40)]), end - rng.randrange(0, 25), end))
            i += 1
        ended = [(rng.randrange(40), rng.randrange(low, high)) for _ in range(60)]
        results += new
        closed += ended
        for name, rows, schema in (("r", new, RESULTS), ("d", ended, CLOSED)):
            df = table(spark, rows, schema)
            if n == len(spans) - 1:
                whole = jobs.with_ends(table(spark, results, RESULTS), table(spark, closed, CLOSED), "60 minutes")
                df = df.union(whole[name == "d"].exceptAll(table(spark, results if name == "r" else closed, schema)))
            stream = arrive(spark, f"{tmp_path}/{name}", df)
            if name == "r":
                r = stream
            else:
                c = stream
    got, progress = run(spark, tmp_path, r, c, longest="25 minutes", lateness="60 minutes")
    assert got == brute(results, closed)
    kept = [op["numRowsTotal"] for p in progress for op in p["stateOperators"]]
    late = [op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"]]
    # 2080 rows in all; what is held spans some three hours of eight, in the end the last rows and the closings of the last 25 minutes
    recent = sum(c >= max(end for *_, end in results) - 25 for _, c in closed)
    assert max(kept) <= 3.5 * 260 and kept[-1] <= 2 + recent and not any(late)


def test_long_and_untimed_results_are_judged_apart(spark, tmp_path):
    results = [(1, 1, 0, 500), (2, 2, 0, 500), (3, 3, None, 5), (4, 3, 5, None), (5, 3, 0, 60)]
    closed = [(1, 20), (3, 4)]
    r, c = table(spark, results, RESULTS), table(spark, closed, CLOSED)
    ended = jobs.with_ends(r, c)
    got, _ = run(spark, tmp_path, arrive(spark, f"{tmp_path}/r", ended[0]), arrive(spark, f"{tmp_path}/d", ended[1]))
    rest = sorted(x.event_id for x in S.drop_cancelled(jobs.judged_apart(r), c).collect())
    assert (got, rest) == ([], [2, 3, 4]) and sorted(got + rest) == brute(results, closed)


def test_empty_streams(spark, tmp_path):
    r, c = table(spark, [], RESULTS), table(spark, [], CLOSED)
    ended = jobs.with_ends(r, c)
    assert [df.count() for df in ended] == [0, 0]
