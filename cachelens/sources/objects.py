"""Objects in a store: list, stat, read, ranged read, write and delete through Spark's readers and Hadoop's file systems.

Spark's reader of binary files leaves out files without bytes, so empty objects are in no list and read as missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cachelens.config import EngineConfig


def s3a_options(config: EngineConfig) -> dict[str, str]:
    """Reader and writer options for the configured bucket; credentials come from the settings alone."""
    return {
        "fs.s3a.endpoint": config.endpoint,
        "fs.s3a.endpoint.region": config.region,
        "fs.s3a.access.key": config.access_key_id,
        "fs.s3a.secret.key": config.secret_access_key,
        "fs.s3a.path.style.access": "true",
        "fs.s3a.aws.credentials.provider": "org.apache.hadoop.fs.s3a.SimpleAWSCredentialsProvider",
    }


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), length and modificationTime; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(_below(root), "length", "modificationTime")


def _below(root: str):
    plain = root.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    full = F.url_decode(F.regexp_replace("path", r"\+", "%2B"))
    return F.substring(full, F.instr(full, plain) + len(plain), F.length(full)).alias("path")


def read(spark: SparkSession, root: str) -> DataFrame:
    """path, length and content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(_below(root), "length", "content")


def read_keys(spark: SparkSession, root: str, keys: DataFrame, column: str = "path") -> DataFrame:
    """Rows of keys with length and content of the object each names; null where there is none."""
    found = read(spark, root).withColumnsRenamed({"path": "_path", "length": "_length", "content": "_content"})
    both = keys.join(found, keys[column] == found["_path"], "left").drop("_path")
    return both.withColumnsRenamed({"_length": "length", "_content": "content"})


def read_range(spark: SparkSession, root: str, path: str, start: int, stop: int) -> DataFrame:
    """content of the half-open byte range of one object, cut at its end; no other byte is read. No row without such an object."""
    p, fs = _path(spark, root, path)
    rows = []
    if fs.exists(p):
        n = max(0, min(stop, fs.getFileStatus(p).getLen()) - start)
        source = fs.open(p)
        try:
            source.seek(start if n else 0)
            rows.append((path, bytearray(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source, n))))
        finally:
            source.close()
    return spark.createDataFrame(rows, "path string, content binary")


def _path(spark: SparkSession, root: str, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{path}")
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write(spark: SparkSession, root: str, path: str, content: bytes) -> None:
    """Writes one object; an existing one is replaced."""
    p, fs = _path(spark, root, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def delete(spark: SparkSession, root: str, path: str) -> bool:
    """Whether there was such an object."""
    p, fs = _path(spark, root, path)
    return bool(fs.delete(p, False))
