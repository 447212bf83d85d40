"""Fill-in-middle transformation over relational units.

A text's units are its matches of ``[A-Za-z]+|[^A-Za-z]``.  Their lengths become rows
(posexplode), window running sums number them and give where each ends, cut requests
join them by unit number, and one aggregation per document turns the two cuts into
character offsets, by which substring takes prefix, middle and suffix.

Texts are exploded by chunks of ``chunk`` characters, so no array holds a long text's
units; a run of letters that a chunk border cuts is one unit still, as its second half
adds to the sums but not to the number.  Rows are told apart by file and place in it, which the shuffles are
dealt by: neither equal texts nor equal or null ids meet, and a task that runs again
finds the same rows.  Texts that aren't just read from files are written first.  Texts
are shuffled once; units, cuts and offsets stay in the partition of their text.

Defined results: a null or empty text is plain; a null id draws as the empty string;
repeated rows are rows of their own with equal results; only the id and text columns
are read, so others, clashing names included, don't matter; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import groups_for, settle, table

UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Plan:
    seed: str = "1"
    fim_percent: int = 90
    spm_percent: int = 20
    chunk: int = 16_384
    partition_bytes: int = 8 << 20


ROW = ["row", "file"]


def placed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, text and the place of every row: its number in its file and the file's hash."""
    if not docs._jdf.queryExecution().analyzed().children().isEmpty() or not docs.inputFiles():
        docs = settle(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), "fim")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{key}`").alias("key"), body.alias("text"), F.col("_metadata.row_index").alias("row"), F.xxhash64("_metadata.file_path").alias("file"))


def requests(rows: DataFrame, plan: Plan) -> DataFrame:
    """key, place, n, form and the unit numbers after which the middle begins and ends."""
    digest = F.sha2(F.concat(F.lit(f"{plan.seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))).cast("binary"), 256)
    drawn = rows.withColumn("digest", digest)
    # every run of letters is one unit, every other character one
    drawn = drawn.withColumn("n", F.char_length(F.regexp_replace("text", "[A-Za-z]+", "a")).cast("long"))
    h1, h2, h3, h4 = (F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4))
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    taken = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        taken |= F.contains("text", F.lit(mark))
    plain = (F.col("n") == 0) | taken | (h3 % 100 >= plan.fim_percent)
    form = F.when(plain, "plain").when(h4 % 100 < plan.spm_percent, "spm").otherwise("psm")
    return drawn.select("key", *ROW, "n", form.alias("form"), F.least(a, b).alias("begin"), F.greatest(a, b).alias("end"))


def units(texts: DataFrame, chunk: int) -> DataFrame:
    """place, unit (1, 2, ...), stop: the characters up to the end of a unit, or of its half before a chunk's border."""
    starts = F.sequence(F.lit(1), F.greatest(F.char_length("text"), F.lit(1)), F.lit(chunk))
    # a chunk is read with the character before it, which says whether its first letters go on
    pieces = texts.select(*ROW, "text", F.explode(starts).alias("at"))
    pieces = pieces.select(*ROW, "at", F.substring("text", F.col("at"), chunk).alias("piece"), ((F.col("at") > 1) & F.substring("text", F.col("at") - 1, 2).rlike("^[A-Za-z]{2}$")).alias("goes_on"))
    sizes = F.transform(F.regexp_extract_all("piece", F.lit(UNIT), F.lit(0)), F.char_length)
    rows = pieces.select(*ROW, "at", "goes_on", F.posexplode(sizes).alias("pos", "size"))
    along = W.partitionBy(*ROW).orderBy("at", "pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    new = F.when((F.col("pos") == 0) & F.col("goes_on"), 0).otherwise(1)
    return rows.select(*ROW, F.sum(new).over(along).alias("unit"), F.sum("size").over(along).alias("stop"))


def offsets(texts: DataFrame, wanted: DataFrame, chunk: int) -> DataFrame:
    """place, begin_at, end_at: the characters before the middle and before the suffix."""
    cuts = wanted.filter("form <> 'plain'").select(*ROW, F.posexplode(F.array("begin", "end")).alias("cut", "cut_unit"))
    # the unit numbers meet inside the join on the row, by which both sides lie already
    at = units(texts, chunk).join(cuts, ROW).filter(F.col("unit").between(F.col("cut_unit"), F.col("cut_unit")))
    where = [F.max(F.when(F.col("cut") == k, F.col("stop"))).alias(c) for k, c in enumerate(("begin_at", "end_at"))]
    return at.groupBy(*ROW).agg(*where)


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", plan: Plan | None = None) -> DataFrame:
    """key, n, form, prefix_chars, middle_chars, output of every row."""
    plan = plan or Plan()
    rows = placed(docs, key, text)
    wanted = settle(requests(rows, plan), "cuts")
    here = " AND ".join(f"{c} IS NOT NULL" for c in ROW)  # said for both readers of the one shuffle
    texts = rows.select(*ROW, "text").filter(here).repartition(groups_for(rows, "text", plan.partition_bytes), *ROW)
    found = offsets(texts, wanted, plan.chunk)
    out = texts.join(found, ROW, "left").join(wanted.drop("begin", "end"), ROW)
    made = F.col("form") != "plain"
    begin, end = (F.coalesce(F.col(c), F.lit(0)).cast("int") for c in ("begin_at", "end_at"))  # no unit before the cut
    prefix, middle, suffix = F.substring("text", F.lit(1), begin), F.substring("text", begin + 1, end - begin), F.substring("text", end + 1, F.char_length("text"))
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    output = F.when(~made, F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    return out.select(
        F.col("key").alias(key), "n", "form", F.when(made, begin.cast("long")).alias("prefix_chars"), F.when(made, (end - begin).cast("long")).alias("middle_chars"), output.alias("output")
    )


def restore(output: Column, form: Column) -> Column:
    """The text of an output; its parts hold no mark, so the first of each is the one that was set."""

    def rest(x: Column, mark: str, head: Column) -> Column:
        return F.substring(x, F.char_length(head) + len(mark) + 1, F.char_length(x))

    def parted(first: str, second: str) -> tuple[Column, Column, Column]:
        body = rest(output, first, F.lit(""))
        one = F.substring_index(body, second, 1)
        left = rest(body, second, one)
        two = F.substring_index(left, MIDDLE, 1)
        return one, two, rest(left, MIDDLE, two)

    prefix, suffix, middle = parted(PREFIX, SUFFIX)
    by_psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parted(SUFFIX, PREFIX)
    return F.when(form == "plain", output).when(form == "psm", by_psm).otherwise(F.concat(prefix, middle, suffix))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(table(spark, sf_dir, "documents"))
    digest = [F.sha2(c.cast("binary"), 256).alias(n) for c, n in ((F.col("output"), "output_sha256"), (restore(F.col("output"), F.col("form")), "restored_sha256"))]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)


ORACLE = r"""
WITH units AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM units),
formed AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
), parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""
