import pytest
import os
import zlib

from pyspark.sql import functions as F

from flowquarry.llm import common
from tests.llm import rows as R


def test_stored_tables_are_read_back_and_dropped(spark):
    df = R.frame(spark, R.hard_documents())
    kept = common.stored(df, "kept")
    assert kept.dtypes == df.dtypes
    assert kept.exceptAll(df).count() == df.exceptAll(kept).count() == 0
    folder = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("///", "/")
    assert os.path.isdir(folder)
    assert folder.startswith(common.shared_dir(spark).removeprefix("file://"))
    common.drop_stored(kept)
    assert not os.path.exists(folder)
    assert common.stored(R.empty(spark), "empty").count() == 0


class Session:
    """As much of a session as names its folders."""

    def __init__(self, setting=None, folder=None, master="local[4]"):
        self.setting, self.folder, self.master = setting, folder, master
        self.conf = self.sparkContext = self

    def get(self, key, default):
        return self.setting or default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder + "/inner"


def test_the_session_names_the_shared_folder():
    assert common.shared_dir(Session("hdfs://a/b/", "file:/c")) == "hdfs://a/b"
    assert common.shared_dir(Session(None, "file:/c")) == "file:/c"
    unset = Session()
    assert common.shared_dir(unset) == common.shared_dir(unset) == unset.folder
    assert unset.folder.startswith("file:///") and unset.folder.endswith("/inner")
    assert common.shared_dir(Session("hdfs://a", master="spark://host:7077")) == "hdfs://a"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session(master="spark://host:7077"))


def test_only_small_tables_are_broadcast(spark):
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "ResolvedHint" in plan(common.broadcast_if_small(spark.range(10), 10)) or "UnresolvedHint" in plan(common.broadcast_if_small(spark.range(10), 10))
    assert "Hint" not in plan(common.broadcast_if_small(spark.range(11), 10))


def test_folds(spark):
    ids = [0, 1, 12345, None]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", common.crc_fold(F.col("doc_id")).alias("f")).collect()
    assert {r.doc_id: r.f for r in rows} == {i: zlib.crc32(b"" if i is None else str(i).encode()) % 4 for i in ids}


def test_batches_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    for asked, wanted in (("10000", str(common.BATCH_ROWS)), ("0", str(common.BATCH_ROWS)), ("16", "16")):
        spark.conf.set(key, asked)
        common.small_batches(spark)
        assert spark.conf.get(key) == wanted
    spark.conf.set(key, before)
