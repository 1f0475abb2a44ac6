"""What several operators share: tables, shared storage and texts as numpy arrays."""

from __future__ import annotations

import gc
import math
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from attestry.session import shared_folder

#: Bytes of text that one numpy pass works on; arrays of eight bytes a byte stay small.
PASS_BYTES = 1 << 20


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors, once for each application, so that their
    Python can import it wherever it is installed for the driver alone."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    place = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(place, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(place))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the folder all executors share and read back:
    lineage ends there, and a lost executor costs a re-read of its splits."""
    ship_package(df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of results that are written and no
    longer held: it learns of them only when both garbage collectors have run, and a finished query
    is held by Spark's listeners for a moment."""
    for _ in range(2):
        time.sleep(1)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def drop_written(df: DataFrame) -> None:
    """Remove the files of a written() table that nothing reads any more."""
    spark = df.sparkSession
    for file in {path.rsplit("/", 1)[0] for path in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_fields(schema: StructType, **kinds) -> StructType:
    """The schema with more fields behind it; the given one stays as it is."""
    return StructType([*schema.fields, *(StructField(name, kind) for name, kind in kinds.items())])


def parts_for(amount: float, each: float, least: int = 1) -> int:
    """Partitions that hold about ``each`` of ``amount``: they grow with the data."""
    return max(least, math.ceil(amount / each))


def text_of(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def held_out(doc_id, folds: int = 5):
    """crc32 of the id's decimal digits, modulo the folds; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch as bytes, and where each begins; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    begin = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[begin[0] : begin[-1]], begin - begin[0]


def passes(offsets: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer text stands alone."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(rows, max(last, first + 1))
        yield first, last
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finish)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def powers(name: str, count: int) -> np.ndarray:
    """Powers of the hash base, or of its inverse, modulo 2**64."""
    known = _powers.get(name)
    if known is None or len(known) < count:
        size = max(count, PASS_BYTES + 1)
        steps = np.full(size, np.uint64(_BASE if name == "base" else _INVERSE))
        steps[0] = 1
        known = _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return known[:count]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running sums of byte values times powers of the base, one more than bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers("base", len(data)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit hashes of data[start:end], equal for equal bytes."""
    raw = (sums[ends] - sums[starts]) * powers("inverse", len(sums))[starts]
    return mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: Longer stretches are hashed one by one.
_STEPWISE = 4096


def bytes_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], eight bytes a step, each step mixed into the last."""
    lengths = ends - starts
    out = mixed(lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    eights = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    live, step = np.flatnonzero((lengths > 0) & (lengths <= _STEPWISE)), 0
    while len(live):
        left = lengths[live] - step
        chunk = eights[starts[live] + step]
        short = left < 8
        chunk[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
        out[live] = mixed((out[live] ^ chunk) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(step + 1))
        live, step = live[left > 8], step + 8
    for i in np.flatnonzero(lengths > _STEPWISE):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), 77)
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and each one's row."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[1:-1][edges]
    ends[edges - 1] = inside[1:-1][edges - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(offsets, starts, side="right") - 1
