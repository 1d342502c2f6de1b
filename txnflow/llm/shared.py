"""What the operators share: row identity, packed rows, shared tables and row functions as pandas UDFs."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Blank characters of the word rules: space and the controls from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"

#: Documents in one batch for a Python worker, at most.
BATCH_ROWS = 1_000

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Applications whose workers have this package.
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """A new path in the cluster's shared folder (``spark.checkpoint.dir``); a local one only for a local master without that."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="txnflow-")
    return f"{base}/txnflow-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str) -> tuple:
    """A folder and its file system, in the JVM."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def written(df: DataFrame, path: str | None = None, plain: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and read again whatever executor is lost.

    The shuffle files behind it are of no use then; Spark is asked to remove them when the write ends. The table goes
    when the driver ends, or with ``removed`` where ``path``, a new path from ``shared_dir``, was given. Columns named
    in ``plain`` hold mostly different values, so that Parquet needn't try to list them.
    """
    spark, path = df.sparkSession, path or shared_dir(df.sparkSession)
    folder, system = _folder(spark, path)
    system.deleteOnExit(folder)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**{f"parquet.enable.dictionary#{c}": "false" for c in plain}).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Take a written table away, once what was made from it is written too: nothing reads it again, also where executors are lost."""
    folder, system = _folder(spark, path)
    system.delete(folder, True)


def row_id(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Identity of a document row, 128 bits of hashes. Rows that repeat both id and text are one document."""
    words = (F.lpad(F.hex(F.xxhash64(F.lit(n), F.col(doc_id), F.col(text).isNull(), F.col(text))), 16, "0") for n in range(2))
    return F.unhex(F.concat(*words))


def packed(docs: DataFrame) -> DataFrame:
    """``__row`` (all columns, whatever their names), ``__rid`` and ``__text`` (null: empty)."""
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"),
        row_id().alias("__rid"),
        F.coalesce(F.col("text"), F.lit("")).alias("__text"),
    )


def unpacked(df: DataFrame, columns: list[str], text: Column | None = None) -> DataFrame:
    """The columns of a packed row again; ``text`` takes the place of the old text, and ``n_chars`` follows it."""
    row = F.col("__row")
    if text is None:
        return df.select(*(row[c].alias(c) for c in columns))
    df = df.withColumn("__new", text)
    new = {"text": F.col("__new"), "n_chars": F.length("__new").cast("long")}
    return df.select(*(new.get(c, row[c]).alias(c) for c in columns))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application, and bound the batches they get.

    Rows are whole documents here, so a batch of Spark's usual 10,000 would hold tens of MB several times over.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).parent.parent
    target = Path(tempfile.mkdtemp(prefix="txnflow-")) / "txnflow.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def struct_udf(spark: SparkSession, f: Callable[[str], tuple], schema: str):
    """A row function of one text as a pandas UDF that returns a struct; a null text is passed as ''.

    It is declared nondeterministic so that a filter on its result doesn't make Spark run it a second time.
    """
    ship(spark)
    names = StructType.fromDDL(schema).fieldNames()

    @F.pandas_udf(schema)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([f(t if t is not None else "") for t in texts], columns=names)

    return run.asNondeterministic()
