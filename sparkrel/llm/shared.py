"""Tables kept in the folder that driver and executors share.

``keep`` writes a DataFrame as Parquet below ``spark.checkpoint.dir`` and reads
it again: lineage ends there, and a lost executor costs no recomputation. The
setting is read from the session; only where it is unset and the master is
local (tests, a notebook) a folder of this machine is set.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

KEY = "spark.checkpoint.dir"
#: Addresses of the tables written by keep().
made: list[str] = []
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def folder(spark: SparkSession) -> str:
    """The shared folder's address."""
    at = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{KEY} names no folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="sparkrel-shared-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Prepares a session for Python workers: sends them the package, and lowers the limit of bytes in an Arrow batch to a few MB (thousands of long texts at once are no worker's business)."""
    ship(spark)
    have = str(spark.conf.get(BATCH_KEY)).rstrip("b")
    if not have.isdigit() or not 0 < int(have) <= BATCH_BYTES:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def keep(df: DataFrame, what: str = "step") -> DataFrame:
    """df, written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/sparkrel-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(table: DataFrame) -> DataFrame:
    """A table of files; where its rows lie in fewer partitions than there are cores, dealt anew. A table of as many files stays as it is."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    if len(table._jdf.inputFiles()) >= cores or table.select(F.spark_partition_id()).distinct().count() >= cores:
        return table
    return table.repartition(cores)


def sweep(spark: SparkSession, since: int, but: DataFrame) -> None:
    """Deletes the tables that keep() has written since it had written so many, but for one that is still read."""
    still = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in but.inputFiles()}
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for path in made[since:]:
        if path.rsplit("/", 1)[-1] not in still:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
    made[since:] = [path for path in made[since:] if path.rsplit("/", 1)[-1] in still]
