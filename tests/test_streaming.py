import datetime as dt
import json

from runweave.operators.redelivery import MessageTable
from runweave.streaming import runs as S


def record(seq, at, **more):
    when = dt.datetime(2025, 1, 5) + dt.timedelta(days=at)
    return {"ingest_seq": seq, "id": f"id-{seq}", "repo_id": "r", "pr_number": 1, "sha": "s", "predicted_skip": [], "actual_failures": [], "all_tests": ["a"], "mode": "shadow", "time_saved_minutes": 2.0, "created_at": when.isoformat() + "Z"} | more


def put(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, records)))


def test_ingest_once_across_batches(spark, tmp_path):
    src, table, mark = tmp_path / "in", f"file://{tmp_path}/table", f"file://{tmp_path}/mark"
    put(src, "1.json", [record(1, 0), record(2, 0), record(3, 0, id="ID-1"), record(4, 0, mode="odd")])
    S.ingest_stream(S.read_runs(spark, str(src)), table, mark).awaitTermination()
    kept = lambda: sorted(r[0] for r in MessageTable(spark, f"{table}/messages").winners().select("ingest_seq").collect())
    assert kept() == [1, 2]
    put(src, "2.json", [record(9, 1, id="id-2"), record(10, 1)])
    S.ingest_stream(S.read_runs(spark, str(src)), table, mark).awaitTermination()
    assert kept() == [1, 2, 10]
    assert spark.read.parquet(f"{table}/invalid/batch=0").count() == 1


def test_ingest_keeps_late_rows_and_every_blank_id(spark, tmp_path):
    src, table, mark = tmp_path / "in", f"file://{tmp_path}/table", f"file://{tmp_path}/mark"
    put(src, "1.json", [record(1, 0), record(2, 40), record(9, 40, id="x"), record(5, 40, id="x"), record(6, 40, id=None), record(7, 40, id=None), record(8, 40, id="")])
    S.ingest_stream(S.read_runs(spark, str(src)), table, mark).awaitTermination()
    put(src, "2.json", [record(10, 1), record(11, 1, mode="odd")])  # weeks behind the newest row
    S.ingest_stream(S.read_runs(spark, str(src)), table, mark).awaitTermination()
    put(src, "3.json", [record(12, 2, id="ID 10"), record(13, 41)])
    S.ingest_stream(S.read_runs(spark, str(src)), table, mark).awaitTermination()
    kept = MessageTable(spark, f"{table}/messages").winners().select("ingest_seq").collect()
    assert sorted(r[0] for r in kept) == [1, 2, 5, 10, 13]
    assert sorted(r[0] for r in spark.read.parquet(f"{table}/invalid").select("ingest_seq").collect()) == [6, 7, 8, 11]


def test_alert_events(spark, tmp_path):
    src = tmp_path / "alerts"
    miss = {"actual_failures": ["a"], "predicted_skip": ["a"]}
    put(src, "1.json", [record(1, 0, **miss), *[record(1 + i, i, actual_failures=["a"]) for i in range(1, 30)]])
    got = S.drained(S.alert_stream(S.read_runs(spark, str(src))), "alerts_once")
    assert sorted((r["ingest_seq"], r["event"]) for r in got.collect()) == [(1, "fire"), (21, "recover")]


def test_weeks(spark, tmp_path):
    src = tmp_path / "weeks"
    put(src, "1.json", [record(1, 0), record(2, 6), record(3, 7), record(4, 60)])
    got = S.drained(S.weekly_stream(S.read_runs(spark, str(src))), "weeks_once", "append")
    assert sorted((str(r["week"]), r["runs"], r["minutes_saved"]) for r in got.collect())[:2] == [("2025-01-05", 2, 4.0), ("2025-01-12", 1, 2.0)]


def test_ingest_derives_and_alerts(spark, tmp_path):
    from runweave.streaming.ingest import alert_state, ingest_batch

    root, sent = f"file://{tmp_path}/chain", []
    miss = {"actual_failures": ["a"], "predicted_skip": ["a"], "time_saved_minutes": None}
    src = tmp_path / "chain_in"
    put(src, "1.json", [record(1, 0, **miss), record(2, 1, repo_id="calm", actual_failures=["a"])])
    put(src, "2.json", [record(10 + i, 40 + i, actual_failures=["a"]) for i in range(19)])
    put(src, "3.json", [record(40, 70, actual_failures=["a"]), record(41, 2, **miss, repo_id="late"), record(42, 71, mode="odd")])
    batches = [spark.read.schema(S.read_runs(spark, str(src)).schema).json(f"{src}/{n}.json") for n in (1, 2, 3)]

    def notify(events):
        sent.append([tuple(r) for r in events.collect()])
        raise OSError("no way out")

    ingest_batch(batches[0], root, 0)
    for n, b in enumerate(batches):
        ingest_batch(b, root, n, notify=notify)
    assert sent[0] == [("r", 0.0, "fire")] and sent[1] == [] and sorted(sent[2]) == [("late", 0.0, "fire"), ("r", 1.0, "recover")]
    ingest_batch(batches[2], root, 2, notify=notify)  # given again after a failure
    assert sorted(sent[3]) == sorted(sent[2])
    state = {r["repo_id"]: (r["alert_fired_at"] is not None, r["recovered_at"] is not None) for r in alert_state(spark, root).collect()}
    assert state == {"r": (True, True), "late": (True, False)}
    kept = {r["ingest_seq"]: r["time_saved_minutes"] for r in MessageTable(spark, f"{root}/messages").winners().collect()}
    assert kept[1] == 0.5 and kept[10] == 2.0 and len(kept) == 23
