"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents of one Arrow batch; keeps a batch of long texts within a worker's memory.
ARROW_ROWS = 512
#: Spark's setting by which a query's shuffle files go as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


#: Spark's settings of the rows of an Arrow batch, and of the compression of tables.
ROWS, CODEC = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.compression.codec"


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Within it, what runs has these settings (ROWS, CODEC); afterwards the session has its own again."""
    keys = {"rows": ROWS, "codec": CODEC}
    before = {keys[k]: spark.conf.get(keys[k], None) for k in values}
    for k, v in values.items():
        spark.conf.set(keys[k], v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; on a local master that names none, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: The folder, within that of the application, of the stage that is being built; none outside stages.
_stage: list[str] = []


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's written tables."""
    return "/".join([f"{shared_dir(spark).rstrip('/')}/tessera-{spark.sparkContext.applicationId}", *_stage])


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete what this application has written; results that have not been read yet are lost with it."""
    _delete(spark, run_dir(spark))


def _roots(docs: DataFrame) -> list[str]:
    """The paths of the files that docs is read from."""
    leaves = docs._jdf.queryExecution().analyzed().collectLeaves()
    nodes = [leaves.apply(i) for i in range(leaves.size())]
    files = [n.relation() for n in nodes if n.getClass().getSimpleName() == "LogicalRelation"]
    return [r.location().rootPaths().mkString(" ") for r in files if r.getClass().getSimpleName() == "HadoopFsRelation"]


@contextlib.contextmanager
def stage_tables(spark: SparkSession, docs: DataFrame) -> Iterator[None]:
    """What operators write within it lies in a folder that goes when the next stage begins.

    That is when its result has been written elsewhere, as a pipeline does; nothing goes if docs, the rows of the stage
    that begins, are still read from such a folder.
    """
    base = f"{run_dir(spark)}/stages"
    if not any(base.split("://")[-1] in root for root in _roots(docs)):
        _delete(spark, base)
    _stage.extend(["stages", uuid.uuid4().hex])
    try:
        yield
    finally:
        del _stage[:]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and any executor may be lost later.

    A small table is then broadcast by Spark where the size of its files is below the session's threshold.  The
    shuffle files of the write are deleted when it ends.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables that were materialized and are not read any more."""
    for t in tables:
        for root in _roots(t):
            if run_dir(t.sparkSession).split("://")[-1] in root:
                _delete(t.sparkSession, root)


#: A key that holds more than a HOT_KEYS-th of all rows is dealt; there can't be more of them.
HOT_KEYS = 1_024


def join_counted(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """The inner join of rows with keyed, a table of one row a key that holds in count how many rows have that key.

    A key with more than a HOT_KEYS-th of the total rows is dealt over as many parts as it has such shares, by the
    hash of the row, so no task gets all its rows.  At most HOT_KEYS keys are dealt, and only they are broadcast, with
    their numbers of parts.  Null keys match nothing; count is dropped.
    """
    parted = keyed.withColumn("_parts", F.ceil(F.col(count) / max(1, total // HOT_KEYS)).cast("int")).drop(count)
    often = F.broadcast(parted.where("_parts > 1").select(*keys, "_parts"))
    salt = F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_parts")).cast("int"), F.lit(0))
    dealt = rows.join(often, keys, "left").withColumn("_part", salt).drop("_parts")
    each = parted.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return dealt.join(each, [*keys, "_part"]).drop("_part")


def unused(columns: list[str], name: str) -> str:
    """name, with underscores before it as long as a column is called so (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def crc_mod(doc_id: str | Column, m: int) -> Column:
    """crc32 of the id as text, mod m."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % m
