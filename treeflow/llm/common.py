"""Helpers shared by the training-data operators: table access, shared-folder
materialisation and vectorised hashing over Arrow string columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MULT = 0x9E3779B97F4A7C15 | 1
M64 = (1 << 64) - 1
MULT_INV = pow(MULT, -1, 1 << 64)


#: Rows of an Arrow batch: texts are long, so the default of 10,000 holds tens of MB in the JVM and in Python alike.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; from here on the session sends Arrow batches of BATCH_ROWS rows."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where it is unset (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="treeflow-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables settled inside are deleted at its end, but for those handed to the function it gives (the scope around it owns them)."""
    outer, own = _SCOPE.get(), []
    token = _SCOPE.set(own)

    def keep(df: DataFrame) -> DataFrame:
        path = getattr(df, "_settled", None)
        if path in own:
            own.remove(path)
            if outer is not None:
                outer.append(path)
        return df

    try:
        yield keep
    finally:
        _SCOPE.reset(token)
        for path in own:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a table that nothing reads any more, through the file system that holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Files a core of tables with few bytes a row.
FILES_A_CORE = 4


def settle(df: DataFrame, name: str = "step", few: str | None = None) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: lineage is
    cut and any executor can read the rows again after another one is lost.

    few, for tables of keys: FILES_A_CORE files a core at most, as each file of a local folder takes the executor
    processes (chmod) and later reads a visit.  "merge": the last step is light and evenly dealt, so fewer tasks do it;
    "deal": its tasks stay as they are and their rows are dealt anew."""
    spark = df.sparkSession
    if few:
        n = FILES_A_CORE * spark.sparkContext.defaultParallelism
        df = df.coalesce(n) if few == "merge" else df.repartition(n)
    path = f"{shared_dir(spark)}/treeflow/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    if (own := _SCOPE.get()) is not None:
        own.append(path)
    return out


def apart(grouped: DataFrame, key: str) -> DataFrame:
    """One row a key, to be merged with rows of hot keys: dealt by another hash first, so that the join shuffles it
    by itself and adaptive execution may split the other side's hot partitions (it can't beside an aggregation)."""
    return grouped.repartition(F.xxhash64(key)).hint("merge")


def groups_for(df: DataFrame, column: str, group_bytes: int) -> int:
    """How many groups of about group_bytes the text column fills."""
    total = df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0
    return max(1, -(-int(total) // group_bytes))


def string_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_POW = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULT**i and MULT**-i modulo 2**64 for i < n."""
    if len(_POW["up"]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for key, base in (("up", MULT), ("down", MULT_INV)):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                _POW[key] = np.cumprod(a)
    return _POW["up"][:n], _POW["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """C with C[i] = sum of (raw[j]+1) * MULT**j for j < i; wraps modulo 2**64."""
    up, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of raw[start:end], equal for equal bytes wherever they stand."""
    _, down = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(MULT))


#: From this length on words are hashed byte by byte with a strong hash: polynomials modulo 2**64 collide on long patterns.
LONG_WORD = 512


def word_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words raw[start:end]."""
    import xxhash

    h = span_hash(prefix_hash(raw), start, end)
    for i in np.flatnonzero(end - start >= LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]].tobytes())
    return h


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words [^\\x20\\x09-\\x0D]+ of every row."""
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~_SPACE[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cut = offsets[:-1]
    cut = cut[cut < n]
    begin[cut] = inside[cut]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    last = offsets[1:] - 1
    last = last[(last >= 0)]
    finish[last] = inside[last]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def batches_by_bytes(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most limit bytes of text each (one row at least)."""
    _, off = string_buffer(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def as_signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def word_shingles(raw: np.ndarray, offsets: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every run of `words` words (the whole row where it has fewer), the
    rows' bounds within them, and the rows' word counts."""
    rows = len(offsets) - 1
    start, end, row = word_spans(raw, offsets)
    count = np.bincount(row, minlength=rows)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64), count
    word = word_hash(raw, start, end)
    first = np.concatenate([[0], np.cumsum(count)])
    made = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(made)])
    owner = np.repeat(np.arange(rows), made)
    at = first[owner] + np.arange(bounds[-1]) - bounds[owner]
    h = np.zeros(len(at), np.uint64)
    last = first[owner + 1] - 1
    with np.errstate(over="ignore"):
        for k in range(words):
            i = at + k
            h = np.where(i <= last, mix(h * np.uint64(31) + word[np.minimum(i, len(word) - 1)]), h)
    return h, bounds, count
