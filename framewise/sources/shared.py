"""Tables in the folder that the driver and all executors share, and files that are checked after they are written."""

from __future__ import annotations

import tempfile
import uuid
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one on a local master, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not found:
        found = getattr(spark.sparkContext, "_framewise_root", None)
        if not found:
            found = spark.sparkContext._framewise_root = tempfile.mkdtemp(prefix="framewise-")
    return found.rstrip("/")


class Store:
    """A folder of Parquet tables of one run. ``stage`` writes a table and reads it, which cuts its lineage."""

    def __init__(self, spark: SparkSession, name: str, root: str | None = None):
        self.spark, self.root, self.n = spark, root or f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def stage(self, df: DataFrame, label: str) -> DataFrame:
        self.n += 1
        return self.write(df, f"{self.n:03d}-{label}")

    def write(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        df.write.partitionBy(*by).parquet(self.path(name))
        return self.read(df, name)

    def read(self, like: DataFrame, name: str) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def _files(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def exists(self, name: str) -> bool:
        files, path = self._files(name)
        return files.exists(path)

    def rename(self, name: str, to: str) -> None:
        files, path = self._files(name)
        if not files.rename(path, self._files(to)[1]):
            raise OSError(f"{self.path(name)} can't be renamed to {to}")

    def drop(self, name: str) -> None:
        files, path = self._files(name)
        files.delete(path, True)


def checksum(df: DataFrame) -> tuple[int, int]:
    """Number of rows, and a sum of their hashes that does not depend on order or partitioning."""
    told = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)")).alias("x")).first()
    return told["n"], int(told["x"] or 0)


def checked_write(store: Store, df: DataFrame, name: str, *by: str) -> DataFrame:
    """Writes ``df`` beside its place, reads it again, compares number and checksum of the rows with what was to be
    written, and only then gives it its name: a table of that name is always whole. What does not agree is removed and
    is an error. ``df`` is computed twice, so it must be deterministic; a staged one is."""
    partial = f"{name}.partial"
    store.drop(partial)
    wanted = checksum(df)
    found = checksum(store.write(df, partial, *by).select(*df.columns))
    if found != wanted:
        store.drop(partial)
        raise ValueError(f"{name}: {found[0]} rows read, {wanted[0]} written, checksums {found[1]} and {wanted[1]}")
    store.rename(partial, name)
    return store.read(df, name)


class Units:
    """Units of work kept for a resume: a unit's rows are written whole, then named in the ledger, so the ledger only
    names whole ones; a consumed unit's rows are dropped, its line stays."""

    LEDGER = "unit string, rows long, checksum decimal(38,0), state string, folder string"

    def __init__(self, store: Store, schema):
        self.store, self.schema = store, schema

    def _note(self, lines: DataFrame) -> None:
        lines.coalesce(1).write.mode("append").parquet(self.store.path("ledger"))

    def ledger(self) -> DataFrame:
        """(unit, rows, checksum, folder, state), the last state of each unit; ``kept`` comes before ``consumed``."""
        spark = self.store.spark
        if not self.store.exists("ledger"):
            return spark.createDataFrame([], self.LEDGER)
        rows = spark.read.schema(self.LEDGER).parquet(self.store.path("ledger"))
        return rows.groupBy("unit").agg(F.max("rows").alias("rows"), F.max("checksum").alias("checksum"), F.max("folder").alias("folder"), F.max(F.when(F.col("state") == "consumed", "consumed").otherwise("a kept")).alias("state")).withColumn("state", F.regexp_replace("state", "^a ", ""))

    def _sums(self, rows: DataFrame, unit: str) -> DataFrame:
        hashed = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(f.name for f in self.schema)]).cast("decimal(38,0)")
        return rows.groupBy(F.col(unit).cast("string").alias("unit")).agg(F.count("*").alias("rows"), F.sum(hashed).cast("decimal(38,0)").alias("checksum"))

    def save_all(self, df: DataFrame, unit: str) -> None:
        """Saves every unit of ``df`` at once: the rows in one write, parted by the column ``unit``, which is no column of
        theirs; what is read back is summed by unit in one pass and held against what was to be written; then all lines
        come into the ledger in one write. ``df`` must be deterministic. A failed try leaves no line."""
        folder = f"units-{uuid.uuid4().hex}"
        wanted = self._sums(df, unit)
        df.withColumn("_unit", F.col(unit).cast("string")).drop(unit).write.partitionBy("_unit").parquet(self.store.path(folder))
        kept = self.store.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_unit", T.StringType())])).parquet(self.store.path(folder))
        found = self.store.stage(self._sums(kept, "_unit"), f"sums-{uuid.uuid4().hex}")
        wrong = wanted.exceptAll(found).unionByName(found.exceptAll(wanted)).select("unit").distinct().limit(5).collect()
        if wrong:
            self.store.drop(folder)
            raise ValueError(f"units {sorted(str(r['unit']) for r in wrong)} were not written as they are")
        self._note(found.select("unit", "rows", "checksum", F.lit("kept").alias("state"), F.lit(folder).alias("folder")))

    def save(self, unit: str, df: DataFrame) -> DataFrame:
        """Saves one unit, which may be empty."""
        kept = checked_write(self.store, df, f"unit={unit}")
        n, x = checksum(kept)
        self._note(self.store.spark.createDataFrame([(unit, n, Decimal(x), "kept", None)], self.LEDGER))
        return kept

    def _path(self, unit: str, folder: str | None) -> str:
        return f"{folder}/_unit={unit}" if folder else f"unit={unit}"

    def _told(self, unit: str):
        told = self.ledger().where((F.col("unit") == unit) & (F.col("state") == "kept")).first()
        if not told:
            raise KeyError(unit)
        return told

    def take(self, unit: str) -> DataFrame:
        """The rows of a kept unit, refused if they are not those that were saved."""
        told = self._told(unit)
        rows = self.store.spark.read.schema(self.schema).parquet(self.store.path(self._path(unit, told["folder"])))
        if checksum(rows) != (told["rows"], int(told["checksum"])):
            raise ValueError(f"unit {unit} is not what was saved")
        return rows

    def take_all(self) -> DataFrame:
        """The rows of all kept units with their ``unit``: a read a folder of ``save_all``, one pass that sums them by unit,
        and an error if any unit's sums are not those in its line."""
        lines = self.store.stage(self.ledger().where("state = 'kept'"), f"kept-{uuid.uuid4().hex}")
        folders = [r["folder"] for r in lines.where("folder is not null").select("folder").distinct().collect()]  # one a save
        schema, rows = T.StructType([*self.schema.fields, T.StructField("_unit", T.StringType())]), None
        for folder in folders:
            part = self.store.spark.read.schema(schema).parquet(self.store.path(folder))
            part = part.join(lines.where(F.col("folder") == folder).select(F.col("unit").alias("_unit")), "_unit", "left_semi").select(*[f.name for f in schema])
            rows = part if rows is None else rows.unionByName(part)
        for r in lines.where("folder is null").select("unit").collect():
            part = self.store.spark.read.schema(self.schema).parquet(self.store.path(self._path(r["unit"], None))).withColumn("_unit", F.lit(r["unit"]))
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return self.store.spark.createDataFrame([], schema).withColumnRenamed("_unit", "unit")
        sums = self._sums(rows, "_unit")
        wrong = sums.exceptAll(lines.where("rows > 0").select("unit", "rows", "checksum")).limit(5).collect()
        if wrong or sums.count() != lines.where("rows > 0").count():
            raise ValueError(f"units {sorted(r['unit'] for r in wrong)} are not what was saved")
        return rows.withColumnRenamed("_unit", "unit")

    def consume(self, unit: str) -> None:
        folder = self._told(unit)["folder"]
        self._note(self.store.spark.createDataFrame([(unit, None, None, "consumed", None)], self.LEDGER))
        self.store.drop(self._path(unit, folder))


class Replay:
    """A source that is read once forward and again from any place: the first pass writes the rows by their key, a later
    one reads the rows of one key from ``start`` on, with the other keys' files left alone."""

    def __init__(self, store: Store, rows: DataFrame, key: str, order: str, name: str = "replay", dealt: int = 64):
        self.store, self.key, self.order, self.name, self.dealt = store, key, order, name, dealt
        self.rows = rows.withColumn("_deal", self._deal(F.col(key)))

    def _deal(self, key):
        return F.pmod(F.xxhash64(key), F.lit(self.dealt)).cast("int")

    def first(self) -> DataFrame:
        """All rows, kept as they pass."""
        if not self.store.exists(self.name):
            self.rows.repartition("_deal").sortWithinPartitions(self.key, self.order).write.partitionBy("_deal").parquet(self.store.path(self.name))
        return self.store.read(self.rows, self.name).drop("_deal")

    def again(self, key, start: int = 0) -> DataFrame:
        told = self.store.spark.range(1).select(self._deal(F.lit(key).cast(self.rows.schema[self.key].dataType))).first()[0]
        return self.store.read(self.rows, self.name).where((F.col("_deal") == told) & (F.col(self.key) == key) & (F.col(self.order) >= start)).drop("_deal")


def read_manifest(spark: SparkSession, path: str, schema: str, versions: tuple[int, ...] = (2, 3)) -> DataFrame:
    """The manifests (JSON, one object a file) in ``path``. One that does not parse, or whose version is not among
    ``versions``, ends the read with an error of three fields: file, version (``null`` without one), reason."""
    rows = spark.read.schema(f"version long, _bad string, {schema}").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path).withColumn("_file", F.input_file_name())
    reason = F.when(F.col("_bad").isNotNull(), "unparsed").when(F.col("version").isNull(), "unversioned").when(~F.col("version").isin(*versions), "unsupported")
    report = F.concat_ws(" ", F.concat(F.lit("MANIFEST_REFUSED file="), "_file"), F.concat(F.lit("version="), F.coalesce(F.col("version").cast("string"), F.lit("null"))), F.concat(F.lit("reason="), reason))
    return rows.withColumn("version", F.when(reason.isNull(), F.col("version")).otherwise(F.raise_error(report))).drop("_bad", "_file")
