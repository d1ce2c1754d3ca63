import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trailmark.llm.frames import discard, written


def shuffled(spark):
    """MB of shuffle files of the session."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(p.stat().st_size for d in dirs for p in Path(d).rglob("shuffle_*.data")) / 1e6


def test_a_written_table_leaves_no_shuffle(spark):
    before = shuffled(spark)
    table = written(spark.range(400_000).select(F.sha2(F.col("id").cast("string"), 256).alias("h")).repartition(4, "h"), "test-shuffle")
    for _ in range(20):
        if shuffled(spark) <= before + 1:
            break
        time.sleep(0.25)
    assert shuffled(spark) <= before + 1 and table.count() == 400_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_only_written_tables_are_discarded(spark, tmp_path):
    table = written(spark.range(5).toDF("a"), "test-discard")
    files = [Path(f.removeprefix("file:").replace("///", "/")) for f in table.inputFiles()]
    assert files and all(f.exists() for f in files)
    discard(table)
    assert not any(f.exists() for f in files)
    spark.range(5).write.parquet(str(tmp_path / "own" / "kept"))
    with pytest.raises(ValueError):
        discard(spark.read.parquet(str(tmp_path / "own" / "kept")))
    assert spark.read.parquet(str(tmp_path / "own" / "kept")).count() == 5
