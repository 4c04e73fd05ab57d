"""Helpers that the operators of this folder share."""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: code points that are none of the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: Rows of a lookup table up to which it is broadcast; rows are narrow (under 200 bytes), so under 20 MB.
BROADCAST_ROWS = 100_000
#: Bytes of a row group of intermediate tables.
ROW_GROUP = 8 << 20
#: Parts into which a larger lookup spreads every key.
SALTS = 64
#: Share of its largest heap beyond which the driver collects garbage, and how often that is looked at.
HEAP_SHARE, HEAP_SECONDS = 0.5, 1.0


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


def typed(spec: str) -> T.DataType:
    """"long", "array<long>" or "a long, b string" as a type, without a session, so that modules can be imported before one."""
    one = lambda x: T.ArrayType(_TYPES[x[6:-1]]) if x.startswith("array<") else _TYPES[x]
    if " " not in spec:
        return one(spec)
    return T.StructType([T.StructField(n, one(t)) for n, t in (x.split() for x in spec.split(", "))])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on a local master, where that is unset, a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        found = sc.getCheckpointDir()
        if not found:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="foliant-"))
            found = sc.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def own_heap(spark: SparkSession) -> bool:
    """Whether the driver's heap is its own; on a local master the tasks share it."""
    return re.fullmatch(r"local(\[.*)?", spark.sparkContext.master) is None


def give_back(spark: SparkSession, share: float = HEAP_SHARE) -> bool:
    """Whether the driver's heap had grown beyond a share of what it may be, so that garbage was collected.

    Plans, task results and broadcasts of finished stages are garbage, but a heap with room goes on growing rather than collect
    it: the more tasks, the larger, up to its limit. A full collection lets it shrink, and lets Spark drop the broadcasts and
    shuffle files that nothing refers to.
    """
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() < share * runtime.maxMemory():
        return False
    gc.collect()  # plans that only Python still holds
    jvm.java.lang.System.gc()
    return True


@contextlib.contextmanager
def heap_watched(spark: SparkSession) -> Iterator[None]:
    """While a step runs, the driver's heap is looked at every HEAP_SECONDS; what it can't give back isn't asked for again and again."""
    over = threading.Event()

    def watch() -> None:
        wait = HEAP_SECONDS
        while not over.wait(wait):
            wait = min(60, 2 * wait) if give_back(spark) else HEAP_SECONDS

    watcher = threading.Thread(target=watch, daemon=True)
    if own_heap(spark):
        watcher.start()
    try:
        yield
    finally:
        over.set()
        if watcher.ident:
            watcher.join()


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, and a lost executor costs no rerun of what made it. Row groups
    are small, as each writing task holds one of them in memory."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with heap_watched(spark):
        df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_az(c: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_of(c: Column) -> Column:
    """A string that tells null from every value."""
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), c.cast("string")))


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with a number that makes it differ from every column of df."""
    taken, n = {c.lower() for c in df.columns}, 0
    while (found := name if not n else f"{name}{n}").lower() in taken:
        n += 1
    return found


def lookup(big: DataFrame, small: DataFrame, key: str, how: str = "left", spread: Column | None = None, rows: int = BROADCAST_ROWS) -> DataFrame:
    """big joined to small, which has one row for each value of key.

    small is counted. Up to `rows` rows it is broadcast. Beyond, both sides are shuffled, and every key is dealt over SALTS
    parts by `spread` of big, so that one key with a third of all rows doesn't end in one task.
    """
    if small.limit(rows + 1).count() <= rows:
        return big.join(F.broadcast(small), key, how)
    salt = free_name(big, "salt")
    by = F.pmod(F.xxhash64(spread) if spread is not None else F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    dealt = small.withColumn(salt, F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return big.withColumn(salt, by).join(dealt, [key, salt], how).drop(salt)


def lookup_split(big: DataFrame, small: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """big inner joined to small, which has one row for each value of key, without copies of small.

    Keys with over a `most`-th of big's rows are fewer than `most`, so their rows of small are broadcast; no other key has more rows
    of big than that share. big is read three times; it should be a table.
    """
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), key)
    heavy = F.broadcast(big.groupBy(key).agg(F.count("*").alias("rows")).where(F.col("rows") > max(1000, big.count() // most)).select(key))
    hot = F.broadcast(small.join(heavy, key, "left_semi"))
    return big.join(hot, key).unionByName(big.join(heavy, key, "left_anti").join(small, key))


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Batches of few rows and bytes, of Parquet readers and for Python, as one text may be very long."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
