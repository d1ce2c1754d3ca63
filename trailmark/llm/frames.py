"""Small pieces that the operators of this subpackage share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of bytes other than space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text (crc32 0)."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def text_key(text: Column) -> Column:
    """128 bits that stand for a text: equal for equal texts, null counting as empty."""
    t = F.coalesce(text, F.lit(""))
    return F.concat(F.hex(F.xxhash64(t)), F.lit("-"), F.hex(F.xxhash64(F.lit(7), t)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a local session may go without: there all is one machine, and a folder of it is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="trailmark-checkpoints-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/trailmark-{spark.sparkContext.applicationId}"


#: With it, Spark drops the shuffles of a query when the query ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, read back: its lineage ends there.

    What a later stage reads does not change when an executor is lost, and it
    is computed once however often it is read; its shuffles serve nothing else
    and go when it is written. The tables of an application stay until
    ``discard`` or ``forget``, for results are lazy and may still need them.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing lazy needs any more."""
    for df in tables:
        spark = df.sparkSession
        own = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark)).getName()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.rsplit("/", 2)[-2] != own:
                raise ValueError(f"{folder} was not written here")
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession) -> None:
    """Delete all tables that this application has written in between; call it when no result is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a batch that goes to a Python worker. Texts are kilobytes, and a batch is held four times over on its way.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, in whose session batches for Python workers have at most BATCH_ROWS rows from now on.

    The setting holds when a plan runs, which is after an operator returns, so
    it stays; a smaller one of the caller's is kept.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df


def running(df: DataFrame, keys: list[str], order: str, value: Column, name: str, rows: int, per_cell: int | None = None) -> DataFrame:
    """df with name: the sum of value over the rows before this one, by keys, in the order of a hash.

    order names a column of 64-bit hash values; ties are ordered by all other
    columns. A key's rows are cut into cells by the leading bits of the hash,
    about per_cell rows each at most (the square root of all rows, 256 at least,
    so that neither a cell nor a key's list of cells grows as the rows do), and
    a key with any share of the rows is spread over many tasks. The cells' sums are added up per key; a window
    inside the cell gives the rest. rows: the number of rows, for the cells.
    """
    from pyspark.sql import Window as W

    per_cell = per_cell or max(256, math.isqrt(max(rows, 1)))
    bits = max(0, (max(rows, 1) // per_cell)).bit_length()
    cell = F.shiftrightunsigned(F.col(order), 64 - bits) if bits else F.lit(0).cast("bigint")
    # the leading bits of a signed number: flipped, they sort as the number does
    cell = cell.bitwiseXOR(F.lit(1 << (bits - 1)).cast("bigint")) if bits else cell
    tiebreak = [F.col(order), *(F.col(c) for c in sorted(df.columns) if c != order)]
    # nulls are a key of their own, and the join below stays a plain one
    own = [f"_key{i}" for i in range(len(keys))]
    dealt = df.withColumns({"_cell": cell.cast("bigint"), "_value": value} | {k: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for k, c in zip(own, keys, strict=True)})
    sums = dealt.groupBy(*own, "_cell").agg(F.sum("_value").alias("_sum"))
    over_cells = W.partitionBy(*own).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(over_cells), F.lit(0))).drop("_sum")
    inside = W.partitionBy(*own, "_cell").orderBy(*tiebreak).rowsBetween(W.unboundedPreceding, -1)
    total = F.col("_before") + F.coalesce(F.sum("_value").over(inside), F.lit(0))
    return dealt.join(offsets, [*own, "_cell"]).withColumn(name, total).select(*df.columns, name)
