"""Folders of stored tables: partitions of clients, on whatever file system a path names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

#: Levels of folders above a client's, at most: a table, a batch and a bucket.
DEPTH = 3


def _on(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def client_folder(spark: SparkSession, client: str | None) -> str:
    """Name of a client's partition, escaped as Spark writes it."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("client_id", client)


def file_names(spark: SparkSession, folder: str) -> set[str]:
    fs, p = _on(spark, folder)
    return {f.getPath().getName() for f in fs.listStatus(p)} if fs.exists(p) else set()


def subfolders(spark: SparkSession, path: str) -> list[str]:
    fs, p = _on(spark, path)
    return sorted(f.getPath().toString() for f in fs.listStatus(p) if f.isDirectory()) if fs.exists(p) else []


def client_names(spark: SparkSession, path: str) -> list[str]:
    """Clients that have a folder right under ``path``."""
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    return [unescape(f.rsplit("/client_id=", 1)[1]) for f in subfolders(spark, path) if "/client_id=" in f]


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _on(spark, path)
    return fs.delete(p, True)


def delete_at_end(spark: SparkSession, path: str) -> str:
    """The path, whose files go when the driver ends."""
    fs, p = _on(spark, path)
    fs.deleteOnExit(p)
    return path


def _files_below(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _on(spark, folder)
    found, out = fs.listFiles(p, True) if fs.exists(p) else None, []
    while found is not None and found.hasNext():
        out.append(found.next().getPath().toString())
    return out


def write_clients(df: DataFrame, path: str, clients: Iterable[str] = (), format: str = "parquet", by: tuple[str, ...] = (), **options) -> None:
    """Write ``df`` with a folder for each client, and below it for ``by``; folders that get rows replace what was there.

    ``clients`` names those whose whole result this is: nothing they had before stays, also where they have no rows now.
    Other clients' folders stay. New files are in place before old ones go, so a failed write leaves what was there.
    """
    spark = df.sparkSession
    folders = [f"{path}/{client_folder(spark, c)}" for c in clients]
    before = {f: _files_below(spark, f) for f in folders}
    df.write.mode("overwrite").options(partitionOverwriteMode="dynamic", **options).partitionBy("client_id", *by).format(format).save(path)
    for folder, old in before.items():
        for f in old:
            delete(spark, f)  # gone already where its folder has new rows
        for f in {f.rsplit("/", 1)[0] for f in old} | {folder}:
            if not _files_below(spark, f):
                delete(spark, f)


def read_clients(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """A Parquet table with folders of clients, whose ids are text, whatever they look like; a known schema spares looking for it."""
    if schema is not None:
        return spark.read.schema(schema).parquet(path)
    fields = [StructField(f.name, StringType()) if f.name == "client_id" else f for f in spark.read.parquet(path).schema.fields]
    return spark.read.schema(StructType(fields)).parquet(path)


def purge_client(spark: SparkSession, client: str, paths: Iterable[str]) -> int:
    """Delete every folder of a client below the given tables, and say how many there were.

    A table may have the clients at its top or under batches and buckets. What is gone is no error, so a purge that broke
    off can be repeated; other clients aren't touched. Run it when no stream writes for that client.
    """
    n, name = 0, client_folder(spark, client)
    for path in paths:
        fs, p = _on(spark, path)
        for depth in range(DEPTH + 1):
            pattern = spark._jvm.org.apache.hadoop.fs.Path(p, "/".join(["*"] * depth + [_literal(name)]))
            for found in fs.globStatus(pattern) or []:
                n += bool(found.isDirectory() and fs.delete(found.getPath(), True))
    return n


def _literal(name: str) -> str:
    """A name for a glob pattern that stands for itself."""
    return "".join(f"\\{c}" if c in "*?[]{}\\^," else c for c in name)
