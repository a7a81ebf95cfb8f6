"""What the operators of this subpackage share: shipping code, the shared folder, size-checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import running, shared_path, stored

__all__ = ["forget", "kept", "maybe_broadcast", "pieces", "release", "running", "shared_path", "ship", "split_words", "spread_join", "steady", "stored", "text_remainder", "texts_of", "uniform", "with_row", "without_rows"]

_shipped: set[str] = set()

#: A side of a join is broadcast only when it was counted and has at most this many narrow rows.
BROADCAST_ROWS = 1_000_000
#: Bytes of one Arrow batch to Python, and of the pieces in which workers split its texts.
ARROW_BYTES, PIECE_BYTES = 8 << 20, 1 << 20


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers, once per application, and keep Arrow batches small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp()) / f"{package.name}_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if df, which must be cheap to count, has at most `most` rows; else leave the join to shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def text_remainder(key: str, divisor: int) -> Column:
    """crc32 of the key as text, modulo divisor; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % divisor


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts' values alone, the same in every run and engine (52 bits of MD5)."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / float(2**52)


def pieces(batch: pa.RecordBatch, text: int, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts (column number `text`) have at most `most` bytes together, or are one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, text: int) -> list[bytes]:
    """UTF-8 texts of a batch; null is empty."""
    return [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]


#: Plans in which every row is a row of the file below.
_ROW_BY_ROW = {"Project", "Filter", "SubqueryAlias", "View"}
#: Copies of a narrow table that meet the parts of a hot key.
SALTS = 8


def steady(docs: DataFrame) -> DataFrame:
    """docs if it is read from Parquet files row by row, else a stored copy: rows that with_row can name for good."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in _ROW_BY_ROW:
        plan = plan.children().head()
    if plan.nodeName() == "LogicalRelation" and " parquet" in plan.toString() and "_metadata" not in docs.columns:
        return docs
    copy = docs.drop("_metadata") if "_metadata" in docs.columns else docs
    return stored(copy, "steady")


def _name() -> Column:
    return F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))


def with_row(docs: DataFrame, **columns: str) -> DataFrame:
    """row and the named columns of docs (a steady table). row names the file and the place in it, so that it is the same
    in every scan, however files are split and whichever executors there are."""
    return docs.select(_name().alias("row"), *[F.col(f"`{c}`").alias(name) for name, c in columns.items()])


def without_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs (a steady table) without the given rows; the columns stay as they are and texts move only if rows are many."""
    whole = docs.select(_name().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return whole.join(maybe_broadcast(rows.select("row")), "row", "left_anti").select("doc.*")


def spread_join(left: DataFrame, right: DataFrame, on: str, how: str, by: str, most: int | None = None) -> DataFrame:
    """left joined with right, which is narrow and holds a key once: by broadcast if right has at most `most` rows, else by
    a shuffle in which a key's rows are dealt to SALTS tasks by column `by` of left."""
    most = BROADCAST_ROWS if most is None else most
    if right.limit(most + 1).count() <= most:
        return left.join(F.broadcast(right), on, how)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [on, "_salt"], how).drop("_salt")


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of many texts (set apart by ASCII white space; A-Z in lower case): codes of all words, the distinct words
    as bytes, and how many words each text has. Null is empty."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = lists.flatten().dictionary_encode()
    words, codes = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    empty = np.flatnonzero(words == b"")  # stands before and after white space at a text's ends
    if len(empty):
        keep = codes != empty[0]
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[keep], minlength=len(sizes))
        codes = codes[keep]
    return codes, words, sizes


#: What workers keep from one task to the next.
_kept: list[dict] = []


def kept() -> dict:
    """A new dictionary that lasts in a worker until one of its tasks forgets."""
    _kept.append({})
    return _kept[-1]


def forget() -> None:
    """Drop what other operators' tasks have kept in this worker; for tasks that need the memory themselves."""
    if any(_kept):
        for own in _kept:
            own.clear()
        release()


def release() -> None:
    """Give memory that a finished task no longer uses back to the system; workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)
