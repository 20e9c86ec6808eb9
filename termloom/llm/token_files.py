"""Token ids in Parquet: a list column with dictionary pages, delta-encoded metadata, bounded row groups and pages.

Files hold documents in ascending id order. The writer keeps column and offset indexes, so a reader that asks for some
documents, or for metadata only, touches few pages:

* `ids` list of int: dictionary pages (format version 2).
* `doc_id`, `n_tokens`: delta encoding, so a scan for counts or ids of documents reads a few bytes per document.

Defined cases: null and empty texts hold the end id alone; a repeated doc_id keeps all its rows, next to one another; rows
with a null doc_id come first; an empty table gives one empty dataset. Further columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.llm.bpe import encoder
from termloom.llm.textbytes import pieces

ROW_GROUP_BYTES = 64 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2000
SCHEMA = "doc_id long, n_tokens int, ids array<int>"


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    cut: str = "spaces",
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
    page_rows: int = PAGE_ROWS,
) -> None:
    """Encode the column `text` of every row, append `end_id`, and write the ids in ascending `doc_id` order.

    `tokenizer` is the path of a `tokenizers` file that every executor has; `cut` says how its text may be split (bpe.py).
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, cut)
        for piece in pieces(batches, "text"):
            ids, offsets = coder.encode(piece.column("text"))
            ends = offsets[1:]
            ids = np.insert(ids, ends, np.uint32(end_id)).astype(np.int32)
            offsets = offsets + np.arange(len(offsets))
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    pa.array(np.diff(offsets).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                ],
                names=["doc_id", "n_tokens", "ids"],
            )

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id")
    (
        ordered.sortWithinPartitions("doc_id")
        .mapInArrow(encode, SCHEMA)
        .write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .option("parquet.page.row.count.limit", str(page_rows))
        .option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written rows with `file` and `row` (place in the file), read from file metadata."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    return spark.read.schema(SCHEMA).parquet(path).select("*", *place)


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the written files.

    Starts come from totals per file, of which there are few, and a running sum within each file.
    """
    rows = read_tokens(spark, path)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    in_order = Window.orderBy(F.col("first").asc_nulls_first(), F.col("last").asc_nulls_first(), "file")
    before = files.select("file", (F.sum("total").over(in_order) - F.col("total")).alias("before"))
    digest = rows.select("doc_id", "ids", "file", "row").mapInArrow(
        _digest, "doc_id long, n_tokens long, ids_crc32 long, file string, row long"
    )
    within = Window.partitionBy("file").orderBy("row")
    return digest.join(before, "file").select(
        "doc_id",
        (F.col("before") + F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )


def crc32_of_runs(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each run of ids as little-endian unsigned 32-bit integers."""
    data = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
    at = (offsets * 4).tolist()
    return np.array([zlib.crc32(data[a:b]) for a, b in zip(at[:-1], at[1:])], dtype=np.int64)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        ids = lists.values.to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.diff(offsets)),
                pa.array(crc32_of_runs(ids, offsets)),
                batch.column("file"),
                batch.column("row"),
            ],
            names=["doc_id", "n_tokens", "ids_crc32", "file", "row"],
        )
