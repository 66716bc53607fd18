import os

from chatloom.session import materialize, release_scratch, scratch_path, settled
from pyspark.sql import functions as F


def test_scratch_is_released(spark):
    release_scratch(spark)
    df = materialize(spark.range(3), "kept")
    assert df.count() == 3
    scratch_path(spark, "never")
    folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    assert release_scratch(spark) == 1 and not os.path.exists(folder) and release_scratch(spark) == 0


def test_settled_columns(spark):
    assert [tuple(r) for r in settled(spark.range(2), {"a": F.col("id") + 1, "b": F.lit("x")}).collect()] == [(0, 1, "x"), (1, 2, "x")]
