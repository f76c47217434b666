"""Arrow text columns as numpy code-point arrays, and batch plumbing shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Characters of text that one numpy pass of an operator works on at most (a single longer text still goes alone).
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, a scan with projections and filters, over all cores where its files keep less than half of them busy (few files that can't be split). A df with shuffles of its own stays as it is."""
    if df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one uint32 array, and the start of each row in it (one more entry than rows).

    Nulls are empty rows. The UTF-8 buffer is decoded once for the whole array.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.type != pa.large_string():
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets_buffer, data = texts.buffers()
    offsets = np.frombuffer(offsets_buffer, np.int64)[texts.offset : texts.offset + n + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    raw = memoryview(data)[first:last] if data is not None else b""
    octets = np.frombuffer(raw, np.uint8)
    starts = np.concatenate(([0], np.cumsum((octets & 0xC0) != 0x80, dtype=np.int64)))
    points = np.frombuffer(bytes(raw).decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, starts[offsets - first]


def from_code_points(points: np.ndarray, rows: np.ndarray, nulls: np.ndarray | None = None) -> pa.Array:
    """The inverse of code_points; nulls marks rows to come out as null."""
    octets = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    ends = np.concatenate(([0], np.cumsum(width)))[rows]
    validity = None
    if nulls is not None and nulls.any():
        validity = pa.py_buffer(np.packbits(~nulls, bitorder="little").tobytes())
    return pa.Array.from_buffers(
        pa.large_string(), len(rows) - 1, [validity, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(octets)]
    )


def sliced(batches: Iterator[pa.RecordBatch], text: str | tuple[str, ...], most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches again in slices whose text columns hold about `most` characters, so that memory is bounded."""
    names = (text,) if isinstance(text, str) else text
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = np.zeros(batch.num_rows, np.int64)
        for name in names:
            lengths = pc.utf8_length(batch.column(name))
            size += pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        whole = np.cumsum(size)
        begin = 0
        while begin < batch.num_rows:
            base = whole[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(whole, base + most, "right")))
            yield batch.slice(begin, end - begin)
            begin = end
