import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from runweave.operators.redelivery import MessageTable, in_epochs, once, replay
from runweave.session import state_path
from runweave.sources.store import CommitConflict, PartitionStore, dir_column

SCHEMA = "ingest_seq bigint, batch_id bigint, id string, repo_id string, created_at timestamp, note string, `extra col` map<string,int>"


def at(month, day=1):
    return dt.datetime(2025, month, day, tzinfo=dt.timezone.utc)


def key(text):
    return "".join(c for c in (text or "").lower() if c.isalnum())


def brute(data):
    """Sequence numbers of surplus rows."""
    best = {}
    for r in data:
        k = (r[3], key(r[2]))
        if r[3] is not None and k[1]:
            best[k] = min(best.get(k, r[0]), r[0])
    return sorted(r[0] for r in data if (r[3], key(r[2])) in best and r[0] > best[(r[3], key(r[2]))])


def sample(seed=1, n=300):
    rnd = random.Random(seed)
    shapes = [str, str.upper, "{{{}}}".format, "  {}\n".format, lambda s: s.replace("-", "")]
    out = []
    for i in range(n):
        base = rnd.choice([None, "", " - ", *[f"ab-{k}" for k in range(60)], *["hot-1"] * 30])
        out.append((i, i // 10, rnd.choice(shapes)(base) if base else base, rnd.choice(["a", "a", "b", None]), rnd.choice([None, at(1), at(2), at(3)]), None, {"x": i % 3}))
    rnd.shuffle(out)
    return out


def test_surplus_and_kept_against_brute_force(spark):
    data = sample()
    df = spark.createDataFrame(data, SCHEMA)
    table = replay(df)
    surplus = sorted(r[0] for r in table.surplus_rows(["ingest_seq"]).collect())
    assert surplus == brute(data)
    kept = table.winners()
    assert kept.columns == df.columns
    assert sorted(r[0] for r in kept.select("ingest_seq").collect()) == sorted({r[0] for r in data} - set(surplus))
    for unique in (False, True):
        counted = once(df, unique_seq=unique)
        assert counted.columns == df.columns and sorted(r[0] for r in counted.select("ingest_seq").collect()) == sorted({r[0] for r in data} - set(surplus))


def test_order_of_epochs_does_not_matter(spark):
    data = sample(2)
    df = spark.createDataFrame(data, SCHEMA)
    parts = in_epochs(df, "batch_id", (0.3, 0.6))
    table = MessageTable(spark, state_path(spark, "reverse"))
    for p in reversed(parts):  # earlier deliveries arrive last and take over
        table.merge(p)
    assert sorted(r[0] for r in table.winners().select("ingest_seq").collect()) == sorted({r[0] for r in data} - set(brute(data)))


def test_only_affected_partitions_are_rewritten(spark):
    table = MessageTable(spark, state_path(spark, "affected"))
    first = [(1, 0, "k1", "a", at(1), None, None), (2, 0, "k2", "a", at(2), None, None), (3, 0, "k3", "a", at(3), None, None)]
    table.merge(spark.createDataFrame(first, SCHEMA))
    before = table.rows.manifest()["parts"]
    table.merge(spark.createDataFrame([(4, 1, "K-1", "a", at(3), None, None), (5, 1, "k9", "a", at(2), None, None)], SCHEMA))
    after = table.rows.manifest()["parts"]
    assert after["202503"] == before["202503"]  # the repeat lost: nothing new in March
    assert after["202501"] != before["202501"] and len(after["202501"]) == 1  # looked up and overwritten
    assert after["202502"][0] == before["202502"][0] and len(after["202502"]) == 2  # only gained rows
    assert sorted(r[0] for r in table.winners().select("ingest_seq").collect()) == [1, 2, 3, 5]


def test_winner_moves_to_another_partition(spark):
    table = MessageTable(spark, state_path(spark, "moves"))
    table.merge(spark.createDataFrame([(7, 1, "x", "a", at(5), None, None)], SCHEMA))
    table.merge(spark.createDataFrame([(2, 0, "X", "a", at(1), None, None)], SCHEMA))
    assert [tuple(r) for r in table.winners().select("ingest_seq").collect()] == [(2,)]
    assert set(table.rows.manifest()["parts"]) == {"202501"}


def test_same_batch_again_changes_nothing(spark):
    data = spark.createDataFrame(sample(3, 60), SCHEMA)
    table = MessageTable(spark, state_path(spark, "again"))
    table.merge(data)
    first = sorted(map(str, table.winners().drop("extra col").collect()))
    table.merge(data.where("id is not null and repo_id is not null").where(F.length(F.regexp_replace("id", "[^a-zA-Z0-9]", "")) > 0))
    assert sorted(map(str, table.winners().drop("extra col").collect())) == first


def test_empty_nulls_and_ties(spark):
    table = MessageTable(spark, state_path(spark, "empty"))
    table.merge(spark.createDataFrame([], SCHEMA))
    assert table.winners() is None and table.surplus_rows(["ingest_seq"]) is None
    tied = [(1, 0, "x", "a", at(1), "p", None), (1, 0, "x", "a", at(1), "p", None), (1, 0, "x", "a", at(1), "q", None), (None, 0, "x", "a", None, None, None)]
    table.merge(spark.createDataFrame(tied, SCHEMA))
    assert table.winners().count() == 1
    table.merge(spark.createDataFrame([(None, 0, None, "a", None, None, None)] * 2, SCHEMA))
    assert table.winners().count() == 3


def test_compaction_and_vacuum(spark):
    table = MessageTable(spark, state_path(spark, "compact"), buckets=1)
    for i in range(4):
        table.merge(spark.createDataFrame([(10 * i, i, f"new{i}", "a", at(1), None, None), (10 * i + 1, i, "same", "a", at(2), None, None)], SCHEMA))
    want = sorted(r[0] for r in table.winners().select("ingest_seq").collect())
    assert want == [0, 1, 10, 20, 30] and len(table.rows.manifest()["parts"]["202501"]) == 4
    table.compact(most=3)
    assert len(table.rows.manifest()["parts"]["202501"]) == 1 and all(len(folders) == 1 for folders in table.index.manifest()["parts"].values())
    assert table.rows.vacuum(keep=1) > 0 and table.index.vacuum(keep=1) > 0
    table.merge(spark.createDataFrame([(50, 9, "NEW0", "a", at(3), None, None)], SCHEMA))
    assert sorted(r[0] for r in table.winners().select("ingest_seq").collect()) == want


def test_clashing_names_come_through(spark):
    names = "_key int, _rank int, _part string, _kept string, _dir string, _given_key int, `a.b` int"
    df = spark.createDataFrame([(1, "x", "a", at(1), 1, 2, "p", "k", "d", 3, 4), (2, "X", "a", at(2), 5, 6, "q", "l", "e", 7, 8)], f"ingest_seq bigint, id string, repo_id string, created_at timestamp, {names}")
    assert [tuple(r) for r in once(df).collect()] == [tuple(df.first())] and once(df).columns == df.columns
    table = MessageTable(spark, state_path(spark, "clash"))
    table.merge(df)
    assert table.winners().columns == df.columns and table.winners().first()["_given_key"] == 3
    assert [tuple(r) for r in table.surplus_rows(["ingest_seq", "_key"]).collect()] == [(2, 5)]


def test_commit_conflict_and_old_versions(spark):
    store = PartitionStore(spark, state_path(spark, "store"))
    df = spark.createDataFrame([(1, "a")], "v int, _part string")

    def write():
        path = store.fresh("t")
        df.withColumn("_dir", dir_column("_part")).write.partitionBy("_dir").parquet(path)
        return path

    one = write()
    assert store.commit(one, df.schema, ["a"], set(), 0) == 1
    with pytest.raises(CommitConflict):
        store.commit(write(), df.schema, ["a"], set(), 0)
    assert store.version() == 1 and store.read().count() == 1
    store.commit(write(), df.schema, ["a"], set(), 1)
    assert store.read().count() == 2 and store.read(version=1).count() == 1 and store.read(["b"]) is None


def test_any_partition_value(spark):
    values = ["2025/01", "a:b", "50%", "x=y", "", None, "p q", "日", "__HIVE_DEFAULT_PARTITION__"]
    schema = "ingest_seq bigint, id string, repo_id string, place string"
    table = MessageTable(spark, state_path(spark, "escaped"), part=F.col("place"))
    table.merge(spark.createDataFrame([(i, f"k{i}", "a", v) for i, v in enumerate(values)], schema))
    table.merge(spark.createDataFrame([(100 + i, f"K-{i}", "a", v) for i, v in enumerate(values)] + [(200, "new", "a", "2025/01")], schema))
    assert sorted(r[0] for r in table.winners().select("ingest_seq").collect()) == [*range(len(values)), 200]
    assert sorted(r[0] for r in table.surplus_rows(["ingest_seq"]).collect()) == [100 + i for i in range(len(values))]
    with pytest.raises(Exception, match="too long"):
        table.merge(spark.createDataFrame([(300, "z", "a", "x" * 101)], schema))


def test_index_reads_only_the_batch_buckets(spark, monkeypatch):
    table = MessageTable(spark, state_path(spark, "buckets"), buckets=8)
    table.merge(spark.createDataFrame([(i, 0, f"k{i}", "a", at(1), None, None) for i in range(200)], SCHEMA))
    assert len(table.index.manifest()["parts"]) == 8
    read, real = [], PartitionStore.read

    def seen(self, parts=None, version=None):
        if self.root.endswith("/index"):
            read.append(parts)
        return real(self, parts, version)

    monkeypatch.setattr(PartitionStore, "read", seen)
    table.merge(spark.createDataFrame([(500, 1, "K-7", "a", at(2), None, None)], SCHEMA))
    assert [len(p) for p in read] == [1]
    assert table.winners().count() == 200


def test_repeated_sequence_numbers_count_once(spark):
    df = spark.createDataFrame([(1, 0, "x", "a", at(1), "p", None), (1, 0, "X", "a", at(1), "q", None), (2, 0, None, "a", None, None, None), (2, 0, None, "a", None, None, None)], SCHEMA)
    assert sorted(r[0] for r in once(df, unique_seq=True).select("ingest_seq").collect()) == [1, 2, 2]


def test_one_identifier_with_a_third_of_all_rows(spark):
    df = spark.range(60_000).select(F.col("id").alias("ingest_seq"), (F.col("id") / 1000).cast("bigint").alias("batch_id"), F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("id"),
                                    F.lit("a").alias("repo_id"), F.lit(at(1)).alias("created_at"))
    table = replay(df)
    assert table.winners().count() == 40_001 and table.surplus_rows(["ingest_seq"]).count() == 19_999
    assert table.winners().where("id = 'Hot'").first()["ingest_seq"] == 0
