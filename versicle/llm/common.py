"""Shared pieces: table reading, row identity, ASCII case, bindings inside expressions, checkpoints."""

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. lower() does just that for pure ASCII and is much faster than translate()."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def boxed(docs: DataFrame, **further: Column) -> DataFrame:
    """docs as one column `row`, and further columns, whose names then cannot clash with those of docs."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), *(c.alias(k) for k, c in further.items()))


def unboxed(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of `row` again, with those of new put in their place or added."""
    return df.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in columns), *(v.alias(k) for k, v in new.items() if k not in columns))


def fingerprint(*cols: Column) -> list[Column]:
    """Two 64-bit hashes under different seeds: equal pairs mean equal values for any corpus size we run on."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Parts of a batch with about `most` bytes of a column of strings or binaries."""
    ends = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)]
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def trimmed(run):
    """run, for mapInArrow, after which a worker hands back what is free: it lives on beside the next task's, and the
    allocator would keep all that the largest task took."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
            trim(0)

    return whole


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; a folder of our own only where it is unset and all runs in
    one process, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """A reliable checkpoint in checkpoint_dir()."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def stored(df: DataFrame) -> DataFrame:
    """df as a compressed table in checkpoint_dir(). Unlike a checkpoint it also forgets what the optimizer has inferred
    of its columns, which grows with every step of a loop. The shuffle files that made it go at once, not when the
    driver happens to collect its garbage."""
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes the files of tables that stored() has made and nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
