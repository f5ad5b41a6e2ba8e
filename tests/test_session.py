from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from runweave import session
from runweave.operators.ranks import placed


def test_a_cluster_needs_a_shared_folder():
    missing = SimpleNamespace(isDefined=lambda: False)
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: missing)))
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))


def there(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def test_scratch_and_discard(spark):
    kept = session.materialize(spark.range(3), "kept")
    with session.scratch(spark):
        inner = session.materialize(spark.range(4), "inner")
        gone = session.materialize(spark.range(5), "gone")
        assert inner.count() == 4 and spark.sparkContext.applicationId in inner._written
        session.discard(gone, None)
        assert not there(spark, gone._written) and there(spark, inner._written)
    assert not there(spark, inner._written) and there(spark, kept._written) and kept.count() == 3


def test_places_in_stretches(spark):
    data = [("hot", i % 7, i) for i in range(500)] + [(None, 1, 1), (None, None, 2), ("few", 3, 3)]
    df = spark.createDataFrame(data, "g string, v int, i int")
    got = {(r["g"], r["i"]): r["place"] for r in placed(df, ["g"], [F.col("v"), F.col("i").desc()]).collect()}
    for g in ("hot", "few", None):
        own = sorted((r for r in data if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, -r[2]))
        assert [got[(g, r[2])] for r in own] == list(range(1, len(own) + 1))
    assert placed(df.where("false"), ["g"], [F.col("v")]).count() == 0
