"""What the operators share: tables in the shared folder, stable column names, sizes."""

from __future__ import annotations

import atexit
import gc
import math
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: blank and the controls 9 to 13, as a Java character class.
SPACES = r"[\x20\x09-\x0D]+"
#: Stands for a null doc_id wherever ids are ordered: after every real one.
LAST_ID = (1 << 63) - 1


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine, which only local mode may use."""
    try:
        found = spark.conf.get("spark.checkpoint.dir")
    except Exception:  # noqa: BLE001  the session has no such setting
        found = None
    if found:
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/gridfield-shared"


#: Makes Spark delete a query's shuffle files when it ends, and not when the driver's memory is next collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Parquet tables in the shared folder, which cut lineage and outlive executors.

    ``save`` writes and rereads, and its shuffle files go at once; ``rows``: about how many there are at most, so that small
    tables make few files.  ``drop`` deletes one that nothing reads any longer; what is left goes when the driver
    ends, since a returned DataFrame may still read it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.close)

    def _delete(self, path: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)

    def save(self, df: DataFrame, name: str, compression: str = "zstd", rows: int | None = None) -> DataFrame:
        self.count += 1
        path, before = f"{self.root}/{self.count}-{name}", self.spark.conf.get(CLEANUP, None)
        if rows is not None:
            df = df.coalesce(files_for(self.spark, rows))
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", compression).parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self._delete(table._scratch_path)

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001  the JVM has gone already
            pass


def files_for(spark: SparkSession, rows: float, each: float = 200_000) -> int:
    """Files of about ``each`` rows, and no fewer than tasks that run at a time."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / each))


def fresh(name: str, taken: list[str]) -> str:
    """name, with underscores until no column has it (Spark ignores case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def partitions_for(spark: SparkSession, amount: float, each: float) -> int:
    """Partitions of about ``each`` out of ``amount``, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(amount / each), 1)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def sampled(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most so many of these rows: those with the smallest hashes of the key among the ones whose hash a number divides.

    The number grows with the rows, so that about four times as many as wanted are sorted, and not so many of each partition.
    """
    turn, every = F.xxhash64(key), max(1, rows.count() // (4 * most))
    return rows.where(F.pmod(turn, F.lit(every)) == 0).orderBy(turn, key).limit(most)


def dealt_out(classes: DataFrame, rows: str, turn: str, block: int = 1000) -> DataFrame:
    """A class of ``rows`` equal rows becomes that many, numbered from 0 in ``turn``; large classes by many tasks."""
    spark, first = classes.sparkSession, fresh("first", classes.columns + [turn])
    single = classes.where(F.col(rows) == 1).withColumn(turn, F.lit(0).cast("long"))
    many = classes.where(F.col(rows) > 1).withColumn(first, F.explode(F.sequence(F.lit(0).cast("long"), F.col(rows).cast("long") - 1, F.lit(block).cast("long"))))
    many = many.repartition(partitions_for(spark, 1, 1), F.xxhash64(*many.columns))
    last = F.least(F.col(first) + block, F.col(rows).cast("long")) - 1
    return single.unionByName(many.withColumn(turn, F.explode(F.sequence(F.col(first), last))).drop(first))


def ship(module) -> None:
    """Functions of this module go to the workers by value: executors need no copy of the package."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(module)


def release(keep: bool = False) -> None:
    """In a worker: what earlier tasks of other operators left behind goes back to the system.  Workers outlive stages.

    keep: what is held for later tasks stays.
    """
    import ctypes

    import pyarrow as pa

    home = sys.modules.get("gridfield_worker_state")
    if home is not None and not keep:
        home.__dict__.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


ship(sys.modules[__name__])
