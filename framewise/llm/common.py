"""What the operators of this subpackage share: staged tables and table access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that setting is unset, a local master (tests) gets a temporary one; on a
    cluster that is an error, as executors could not read what others write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not found:
        found = getattr(spark.sparkContext, "_framewise_shared", None)
        if not found:
            found = tempfile.mkdtemp(prefix="framewise-")
            spark.sparkContext._framewise_shared = found
    return found.rstrip("/")


class Workspace:
    """Tables that one run of an operator writes to the shared folder and reads again.

    Writing cuts lineage: a lost executor costs the tasks that read the table, not the job that made it.
    ``drop`` removes a table as soon as nothing that is still lazy reads it. Texts are long, so Python gets them in
    smaller Arrow batches than Spark's own default; a session that has chosen a size keeps it.
    """

    BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def __init__(self, spark: SparkSession, name: str):
        if spark.conf.get(self.BATCH) == "10000":
            spark.conf.set(self.BATCH, "2000")
        self.spark, self.root, self.n, self.staged = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0, []

    def path(self, label: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{label}"

    def stage(self, df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
        path = self.path(label)
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._framewise_path = path
        self.staged.append(path)
        return out

    def keep_only(self, *frames: DataFrame, since: int = 0) -> None:
        """Removes the tables staged from number ``since`` on but for ``frames``."""
        kept = {f._framewise_path for f in frames}
        self.drop(*[p for p in self.staged[since:] if p not in kept])
        self.staged[since:] = [p for p in self.staged[since:] if p in kept]

    def drop(self, *frames: DataFrame | str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for frame in frames:
            path = jvm.org.apache.hadoop.fs.Path(frame if isinstance(frame, str) else frame._framewise_path)
            path.getFileSystem(conf).delete(path, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or it with more underscores in front, as no column of ``df`` is called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_row_key(documents: DataFrame, work: Workspace, name: str, few: int = 2_000_000) -> DataFrame:
    """Adds ``name``, a long that is the doc_id where one row alone has it. Rows without a doc_id and rows that share one
    get a negative number from doc_id and text instead, so only rows with equal ones share it. Which doc_ids are shared is
    broadcast up to ``few`` of them, else joined by a shuffle."""
    mark = free_name(documents, "_shared")
    shared = work.stage(documents.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(mark)), "shared")
    own = -F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(1 << 61)) - (1 << 61)
    if shared.isEmpty():
        return documents.withColumn(name, F.coalesce(F.col("doc_id").cast("long"), own))
    shared = F.broadcast(shared) if shared.count() <= few else shared.hint("merge")
    marked = documents.join(shared, F.col("doc_id") == F.col(mark), "left")
    return marked.withColumn(name, F.when(F.col("doc_id").isNull() | F.col(mark).isNotNull(), own).otherwise(F.col("doc_id").cast("long"))).drop(mark)


def one_row_each(documents: DataFrame, key: str, work: Workspace, few: int = 2_000_000) -> DataFrame:
    """One row for each ``key``; only rows that share theirs are shuffled."""
    twice = work.stage(documents.groupBy(key).count().where("count > 1").select(key), "twice")
    if twice.isEmpty():
        return documents
    twice = F.broadcast(twice) if twice.count() <= few else twice.hint("merge")
    return documents.join(twice, key, "left_anti").unionByName(documents.join(twice, key, "left_semi").dropDuplicates([key]))


def without(documents: DataFrame, ids: DataFrame, work: Workspace, key: str = "doc_id", few: int = 2_000_000) -> DataFrame:
    """The documents whose ``key`` is not in ``ids(key)``; up to ``few`` ids are broadcast, more are joined by a
    shuffle. Documents without a key stay."""
    ids = work.stage(ids.select(key).where(F.col(key).isNotNull()).distinct(), "gone")
    return documents.join(F.broadcast(ids) if ids.count() <= few else ids.hint("merge"), key, "left_anti").select(documents.columns)


def with_column_from_text(documents: DataFrame, name: str, kind: pa.DataType, make: Callable[[list[str | None]], Iterable]) -> DataFrame:
    """Every row of ``documents`` as it is, and a column that ``make`` gives for a batch of texts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column(name, pa.array(make(batch.column("text").to_pylist()), kind))

    return documents.mapInArrow(read, T.StructType([*documents.schema.fields, T.StructField(name, from_arrow_type(kind))]))
