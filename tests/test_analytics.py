import datetime as dt

import pytest

from runweave.operators import analytics as A

SCHEMA = "ingest_seq bigint, id string, repo_id string, pr_number bigint, sha string, predicted_skip array<string>, actual_failures array<string>, all_tests array<string>, mode string, time_saved_minutes float, created_at timestamp"
SUNDAY = dt.datetime(2024, 1, 7, tzinfo=dt.timezone.utc)


def run(seq, *, repo="r", skip=(), fail=(), tests=("a", "b"), at=0, minutes=1.0, pr=1):
    when = None if at is None else SUNDAY + dt.timedelta(days=at)
    return (seq, f"id{seq}", repo, pr, "s", None if skip is None else list(skip), None if fail is None else list(fail), None if tests is None else list(tests), "shadow", minutes, when)


@pytest.fixture
def runs(spark):
    return lambda *rs: spark.createDataFrame(list(rs), SCHEMA)


def test_progress_counts_empty_test_lists(runs, rows):
    df = runs(run(1, skip=["a"]), run(2, tests=None, skip=None), run(3, tests=[], skip=["x"]))
    assert rows(A.shadow_progress(df)) == [("r", 3, (0.5 + 0 + 1) / 3, 6.0)]
    assert rows(A.accuracy_report(df).select("skip_rate", "recall")) == [(0.5, 1.0)]


def test_leaderboard_threshold_limit_and_ties(runs, rows):
    df = runs(*[run(i, tests=["a", "b", "c"], fail=["a"] if i < 3 else ["b", "b"]) for i in range(6)])
    found = rows(A.flaky_leaderboard(df))
    assert found == [("r", "a", 3 / 9, 9), ("r", "b", 6 / 12, 12), ("r", "c", 0.0, 6)]
    assert [r[1] for r in rows(A.flaky_leaderboard(df, n=1))] == ["b"]
    assert rows(A.flaky_leaderboard(runs(*[run(i) for i in range(5)]))) == []


def test_flake_scores_drop_unlisted_and_may_exceed_one(runs, rows):
    df = runs(run(1, tests=["a"], fail=["a", "x"]), run(2, tests=[], fail=["a"]))
    assert rows(A.flake_scores(df)) == [("r", "a", 2.0)]


def test_weeks_begin_on_sunday_and_bags_keep_repeats(runs, rows):
    df = runs(run(1, skip=["a"], fail=["a", "a", "b"]), run(2, at=6), run(3, at=7), run(4, at=None, fail=["a"]))
    assert rows(A.accuracy_trend(df)) == [("r", dt.date(2024, 1, 14), 0, 0, 0, 100.0), ("r", dt.date(2024, 1, 7), 1, 2, 3, pytest.approx(100 / 3))]
    assert rows(A.savings_trend(runs(run(1, minutes=float("nan")), run(2, minutes=None), run(3, minutes=2.5)))) == [("r", dt.date(2024, 1, 7), 2.5)]


def test_recent_recall_and_floor_windows(runs, rows):
    old = [run(i, at=i, fail=["a"], skip=["a"]) for i in range(5)]
    new = [run(100 + i, at=50 + i, fail=["a"], skip=["a"] if i == 0 else []) for i in range(20)]
    df = runs(*old, *new)
    assert rows(A.recent_recall(df)) == [("r", 0.95, 20)]
    assert rows(A.accuracy_floor(df)) == [("r", 20, 0.95, True)]
    assert rows(A.accuracy_floor(runs(*new[:19]))) == [("r", 19, pytest.approx(18 / 19), False)]
    assert rows(A.recent_recall(runs(run(1)))) == [("r", 1.0, 0)]


def test_recent_runs_break_ties_by_arrival(runs, rows):
    df = runs(*[run(i, at=1) for i in range(4)], run(9, at=None))
    assert rows(A.latest_per_repo(df, 2).select("ingest_seq", "place")) == [(2, 2), (3, 1)]


def test_alerts_fire_hold_and_recover(runs, rows):
    bad = [run(i, at=i, fail=["a"], skip=["a"] if i == 0 else []) for i in range(19)]  # recall rises from 0 to 18/19
    good = [run(100 + i, at=100 + i, fail=["a"]) for i in range(30)]
    events = [r for r in rows(A.alert_transitions(runs(*bad, *good)).where("event <> 'hold'").select("ingest_seq", "event"))]
    assert events == [(0, "fire"), (101, "recover")]


def test_dominant_repo_prefers_the_first_seen(runs, rows):
    df = runs(run(3, repo="x"), run(1, repo="y"), run(2, repo="x"), run(4, repo="y"))
    assert rows(A.dominant_repo(df)) == [("y", 2)]
    assert rows(A.dominant_repo(runs())) == []


def test_gates(runs, rows):
    df = runs(*[run(i, repo="big") for i in range(100)], *[run(200 + i, repo="small") for i in range(99)])
    assert rows(A.activity_gates(df, every=50).select("repo_id", "dormant", "backstop")) == [("big", False, True), ("small", True, False)]


def test_final_rows_keep_the_last_of_equal_keys(runs, rows):
    a, b, c = run(1), run(2), run(3, at=1)
    same = [tuple("same" if i == 1 else v for i, v in enumerate(r)) for r in (a, b, c)]
    assert rows(A.final_rows(runs(*same)).select("ingest_seq")) == [(2,), (3,)]


def test_results_do_not_depend_on_order(runs, rows):
    many = [run(i, at=i % 3, fail=["a"] if i % 2 else [], skip=["a"] if i % 4 == 1 else []) for i in range(40)]
    for f in (A.rolling_recall, A.recent_recall, A.alert_transitions):
        assert rows(f(runs(*many))) == rows(f(runs(*reversed(many)).repartition(3)))
