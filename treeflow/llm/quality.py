"""Quality rules by compression bands.

Zstandard ratios (bytes over compressed bytes) of the whole document and of
fixed chunks are held against limits that depend on the length: a ratio above
the band is repetitive text, one below it incompressible text.

Defined results: a null or empty text has no words, so it fails the base rule;
texts below the shortest band are judged by the base rule alone; rows are
judged one by one, so ties and repeated rows get equal verdicts; columns of the
input whose names clash with the verdict's are replaced in ``annotate`` and
untouched in ``keep``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Fixed values: (bytes from, lowest ratio, highest ratio), ascending.
BANDS = ((64, 0.0, 3.0), (256, 1.05, 3.2), (512, 1.2, 3.6), (1024, 1.4, 4.5), (4096, 1.4, 6.0), (16384, 1.4, 10.0))


@dataclass(frozen=True)
class Compression:
    level: int = 3
    chunk_bytes: int = 4096
    bad_chunk_share: float = 0.5
    bands: tuple = BANDS


VERDICT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("ratio", T.DoubleType()),
        T.StructField("n_chunks", T.LongType()),
        T.StructField("n_bad_chunks", T.LongType()),
        T.StructField("kept", T.BooleanType()),
    ]
)
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8


def repeat_words(words: list[bytes]) -> int:
    """Words covered by an 8-word window that occurs at least twice in the text."""
    if len(words) < WINDOW + 1:
        return 0
    ids: dict[bytes, int] = {}
    seq = [ids.setdefault(w, len(ids)) for w in words]
    windows = list(zip(*(seq[i:] for i in range(WINDOW)), strict=False))
    seen: dict[tuple, int] = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    if len(seen) == len(windows):
        return 0
    covered, reach = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + WINDOW - max(reach, i)
            reach = i + WINDOW
    return covered


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


def in_band(n: int, packed: int, bands: tuple) -> bool:
    low, high = 0.0, float("inf")
    for start, lo, hi in bands:
        if n >= start:
            low, high = lo, hi
    return low * packed <= n <= high * packed


def judge(text: str | None, zip_: object, opt: Compression) -> tuple:
    counts = base_counts(text)
    failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
    data = (text or "").encode("utf-8", "surrogatepass")
    packed = len(zip_.compress(data))
    chunks = [data[i : i + opt.chunk_bytes] for i in range(0, len(data), opt.chunk_bytes)] if len(data) > opt.chunk_bytes else []
    bad = sum(not in_band(len(c), len(zip_.compress(c)), opt.bands) for c in chunks)
    kept = not failed and in_band(len(data), packed, opt.bands) and not (chunks and bad > opt.bad_chunk_share * len(chunks))
    return (*counts, failed, len(data) / packed, len(chunks), bad, kept)


def annotate(docs: DataFrame, text: str = "text", keep_columns: list[str] | None = None, opt: Compression = Compression()) -> DataFrame:
    """keep_columns (all by default) beside the verdict columns; one pass, no shuffle."""
    names = [c for c in (docs.columns if keep_columns is None else keep_columns) if c not in VERDICT.names]
    schema = T.StructType([docs.schema[c] for c in names] + VERDICT.fields)
    source = docs.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark.sql.pandas.types import to_arrow_schema

        zip_ = zstandard.ZstdCompressor(level=opt.level, write_content_size=False)
        out = to_arrow_schema(schema)
        for b in batches:
            rows = [judge(x.as_py(), zip_, opt) for x in b.column(len(names))]
            cols = [b.column(i) for i in range(len(names))]
            made = list(zip(*rows, strict=True)) if rows else [()] * len(VERDICT)
            for f, v in zip(VERDICT.names, made, strict=True):
                cols.append(pa.array(v, out.field(f).type))
            yield pa.RecordBatch.from_arrays([c.cast(out.field(i).type) for i, c in enumerate(cols)], names=out.names)

    return source.mapInArrow(run, schema)


def keep(docs: DataFrame, text: str = "text", opt: Compression = Compression()) -> DataFrame:
    """The rows of docs whose text passes, with their own columns."""
    clash = [c for c in docs.columns if c in VERDICT.names]
    inner = docs.select([F.col(f"`{c}`").alias(f"__own_{c}" if c in clash else c) for c in docs.columns])
    got = annotate(inner, f"__own_{text}" if text in clash else text, None, opt).filter("kept")
    return got.select([F.col(f"`__own_{c}`" if c in clash else f"`{c}`").alias(c) for c in docs.columns])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate(table(spark, sf_dir, "documents"), "text", ["doc_id"])
