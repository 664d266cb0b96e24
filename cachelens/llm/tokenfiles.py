"""Token-ID files: documents' ids in ascending doc_id order, in range-coded blocks, written and read by Spark's own writers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cachelens.llm._ship import ship
from cachelens.llm.encoding import encoder, packed
from cachelens.llm.rangecoder import decode_block, encode_block

BLOCKS = "part int, block long, n_ids long, payload binary"
IDS = "part int, block long, doc_id long, at long, ids binary"


def _encoded(batches: Iterator[pd.DataFrame], tokenizer: str, end: int, vocabulary: int, block_ids: int) -> Iterator[pd.DataFrame]:
    encode, tail, part = encoder(tokenizer, spaces=True).encode, packed([end]), TaskContext.get().partitionId()
    docs: list[int | None] = []
    ids: list[np.ndarray] = []
    held = block = 0

    def full() -> pd.DataFrame:
        nonlocal held, block
        out = pd.DataFrame({"part": [part], "block": [block], "n_ids": [held], "payload": [encode_block(docs, ids, vocabulary)]})
        docs.clear()
        ids.clear()
        held, block = 0, block + 1
        return out

    for batch in batches:
        texts = [t if isinstance(t, str) else None for t in batch["text"]]
        for doc, got in zip(batch["doc_id"].tolist(), encode(texts), strict=True):
            docs.append(None if pd.isna(doc) else int(doc))
            ids.append(np.frombuffer(got + tail, np.uint32))
            held += len(ids[-1])
            if held >= block_ids:
                yield full()
    if docs:
        yield full()


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part, block, payload in zip(batch["part"], batch["block"], batch["payload"], strict=True):
            docs, ids = decode_block(payload)
            sizes = np.array([len(x) for x in ids], np.int64)
            out = pd.DataFrame({"part": part, "block": block, "doc_id": pd.array(docs, "Int64"), "at": np.cumsum(sizes) - sizes, "ids": [x.astype("<u4").tobytes() for x in ids]})
            yield out.astype({"part": "int32"})


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 0, vocabulary: int = 50_257, block_ids: int = 1 << 20) -> None:
    """Writes docs (doc_id long, text string; other columns are ignored) as token files under `path`.

    Rows are dealt by ranges of (doc_id, hash of the text), so file and block order is id order, null ids first and rows of
    one id by their texts, and a repeated id is not one task's work. A block ends with the document that brings it to
    `block_ids` ids, carries its own checksum, and can be decoded alone. Null and empty texts hold `end` alone; repeated
    rows are all written; an empty table leaves no blocks.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    work = partial(_encoded, tokenizer=tokenizer, end=end, vocabulary=vocabulary, block_ids=block_ids)
    ordered = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    ordered.select("doc_id", "text").mapInPandas(work, BLOCKS).write.option("compression", "none").parquet(path)


def _first(blocks: DataFrame) -> DataFrame:
    """Ids before each block: part, block, b0."""
    sizes = blocks.select("part", "block", "n_ids")
    per_part = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each file
    before_part = per_part.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("p0"))
    in_part = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.join(before_part, "part").select("part", "block", (F.col("p0") + F.coalesce(F.sum("n_ids").over(in_part), F.lit(0))).alias("b0"))


def _started(spark: SparkSession, path: str, *columns: Column) -> DataFrame:
    ship(spark)
    blocks = spark.read.schema(BLOCKS).parquet(path)
    rows = blocks.mapInPandas(_decoded, IDS).select("part", "block", "doc_id", "at", *columns)
    return rows.join(_first(blocks), ["part", "block"]).withColumn("start", F.col("b0") + F.col("at"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of token files: doc_id, start (ids of all documents before), ids (little-endian unsigned 32-bit, with the end id)."""
    return _started(spark, path, F.col("ids")).select("doc_id", "start", "ids")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Digests of what read_tokens gives, made before anything is joined: doc_id, start, n_tokens, ids_crc32."""
    digests = (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    return _started(spark, path, *digests).select("doc_id", "start", "n_tokens", "ids_crc32")
