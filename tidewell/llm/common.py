"""Shared pieces: reading tables, shared scratch tables and joins that survive hot keys."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than this fraction of all rows is joined by broadcasting it, so
#: at most 1 / HOT_SHARE keys are ever broadcast.
HOT_SHARE = 1e-3

#: A key with so many rows at most is never heavy.
LIGHT = 1000

#: Rows of a table of keys that is broadcast after it was counted.
FEW_KEYS = 1 << 20

_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset a
    temporary folder in local mode and a folder of the warehouse elsewhere."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        root = "file://" + tempfile.mkdtemp(prefix="tidewell-")
    else:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, so that
    a lost executor costs no more than the tasks that it ran. narrow: a table of few small
    columns, dealt out to a file for each core. (To coalesce instead would run many
    partitions' joins in one task, whose memory is only freed when the task ends.)"""
    spark = df.sparkSession
    df = df.repartition(spark.sparkContext.defaultParallelism) if narrow else df
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _made:
        atexit.register(_clean)
    _made.append(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.scratch = path
    return made


def discard(made: DataFrame) -> None:
    """Deletes a table of materialize() that nothing will read again."""
    if made.scratch in _made:
        _made.remove(made.scratch)
        _delete(made.sparkSession, made.scratch)


def release() -> None:
    """Gives the driver's freed memory back to the system, after a model was trained there."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc, which keeps it otherwise
    if trim is not None:
        trim(0)


_work = ""


def turned(work: str) -> None:
    """For functions in Python workers, which Spark keeps for the tasks of other operators: when one
    turns to other work, it gives back the memory that the last one freed."""
    global _work
    if _work != work:
        _work = work
        release()


def freed(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what has been materialized, which it does when the
    driver's references are collected; without this they stay until the driver's heap is full. The
    first round clears what the second one's references hang on."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the gateway may be gone at exit
            return


def wrapped(docs: DataFrame, *needed: str) -> DataFrame:
    """Each row as a struct beside the columns that an operator works on, so that no name of
    the operator's can clash with one of the table's; select("row.*") gives the rows back."""
    row = F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row")
    return docs.select(row, *[F.col(quoted(c)) for c in needed])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def word_count(text: Column) -> Column:
    """Number of words, runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw_limits(df: DataFrame, by: str, counts: dict, most: int) -> DataFrame:
    """For each class (a value of column by, of which there are so many rows) the limit of the
    hash below which about most of its rows lie, most and a few deviations; for drawn()."""
    enough = most + 4 * most**0.5
    kind = df.schema[by].dataType.simpleString()
    rows = [(value, min(int(enough / max(n, 1) * 2**62), 2**62)) for value, n in counts.items()]
    return df.sparkSession.createDataFrame(rows, f"`{by}` {kind}, __limit long")


def drawn(key: str) -> Column:
    """Whether a row is of its class's sample, which its key's hash decides: no group meets
    anywhere, and a repeated key is in with all its rows or with none."""
    return F.pmod(F.xxhash64(F.lit("drawn"), F.col(key)), F.lit(2**62)) < F.col("__limit")


def join_keys(df: DataFrame, keys: DataFrame, key: str, how: str, most: int = FEW_KEYS) -> DataFrame:
    """df joined with a stored table of distinct keys (how: inner, left_semi or left_anti). It is
    counted, and broadcast if it has few rows, so that df isn't moved; else both are shuffled."""
    return df.join(F.broadcast(keys) if keys.count() <= most else keys, key, how)


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, most: int | None = None) -> DataFrame:
    """Inner join on key, which is unique in right, whose column weight tells how many rows
    of left each key has, of total, and most the largest of these, where it is known. Heavy keys are
    broadcast (1 / HOT_SHARE at most), the others meet in a shuffle where none has more than that share
    of the rows. Without heavy keys it is a plain join: broadcasts of none would take the driver's memory, too."""
    limit = max(total * HOT_SHARE, LIGHT)
    if (total if most is None else most) <= limit:
        return left.join(right.drop(weight), key)
    heavy = F.col(weight) > limit
    hot = right.filter(heavy).drop(weight)
    rest = right.filter(~heavy).drop(weight)
    keys = F.broadcast(hot.select(key))
    return (
        left.join(F.broadcast(hot), key)
        .unionByName(left.join(keys, key, "left_anti").join(rest, key))
    )
