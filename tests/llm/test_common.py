import pytest
from pyspark.sql import functions as F

from vaultlens.llm import common


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_hot_keys_join_as_others_do(spark, hot):
    rows = spark.range(300).select(F.xxhash64(F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 30)).alias("key"), "id")
    table = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least")).filter("least % 2 = 0")
    for how in ("inner", "left", "left_semi"):
        want = rows.join(table.drop("n"), ["key"], how)
        have = common.by_key(rows, table, ["key"], rows.count(), how, hot)
        assert sorted(map(str, have.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
