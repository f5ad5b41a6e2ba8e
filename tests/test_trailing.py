import datetime as dt
import random

from pyspark.sql import functions as F

from runweave.operators.trailing import concentrated_days, trailing_totals

SCHEMA = "repo_id string, created_at timestamp, time_saved_minutes float, day int, entity string"


def brute(data, periods=(7, 30)):
    daily = {}
    for repo, at, v in data:
        if repo is None or at is None:
            continue
        cell = daily.setdefault(repo, {}).setdefault(at.date(), [0.0, 0, 0])
        if v is not None and v == v:
            cell[0] += v
            cell[1] += 1
        cell[2] += 1
    out = {}
    for repo, days in daily.items():
        day = min(days)
        while day <= max(days):
            row = []
            for n in periods:
                own = [days[day - dt.timedelta(k)] for k in range(n) if day - dt.timedelta(k) in days]
                total, valued = sum(c[0] for c in own), sum(c[1] for c in own)
                row += [total, total / valued if valued else None, sum(c[2] for c in own)]
            out[(repo, day.isoformat())] = tuple(row)
            day += dt.timedelta(1)
    return out


def sample(seed):
    rnd = random.Random(seed)
    start = dt.datetime(1969, 12, 20, tzinfo=dt.timezone.utc)
    out = []
    for _ in range(200):
        repo = rnd.choice(["a", "b", "c", None])
        at = None if rnd.random() < 0.05 else start + dt.timedelta(days=rnd.choice([0, 1, 5, 6, 29, 30, 31, 36, 100, 101, 250]), seconds=rnd.randrange(86400))
        out.append((repo, at, rnd.choice([None, float("nan"), 0.0, 0.5, 3.0])))
    return out


def test_against_brute_force(spark):
    for seed in (1, 2):
        data = sample(seed)
        df = spark.createDataFrame([(*r, 5, "x") for r in data], SCHEMA)
        got = {(r["repo_id"], r["run_day"]): (r["total_7"], r["avg_7"], r["rows_7"], r["total_30"], r["avg_30"], r["rows_30"]) for r in trailing_totals(df).collect()}
        assert got == brute(data)


def test_concentrated(spark, rows):
    start = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)
    data = [("a", start, 1.0, 0, ""), ("a", start + dt.timedelta(29), 20.0, 0, ""), ("a", start + dt.timedelta(40), 0.0, 0, ""), ("b", start, 100.0, 0, "")]
    found = rows(concentrated_days(spark.createDataFrame(data, SCHEMA)))
    assert found == [("a", f"2025-01-{d}") for d in (30, 31)] + [("a", f"2025-02-0{d}") for d in range(1, 6)]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert trailing_totals(df).count() == 0
    assert concentrated_days(df.withColumn("extra", F.lit(1))).count() == 0
