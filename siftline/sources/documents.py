"""Reading texts and writing reports.

Many small texts lie in few files: texts of one order are written one after the
other, and a manifest tells where each begins. Reports go to a bounded number
of files sorted by what they are looked up by, or block by block, so that a run
that breaks off goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siftline.functions.text import filled
from siftline.operators.order import global_rank, running_totals
from siftline.shared import hadoop_path, stored

#: Endings of the files that can be read as text.
SUPPORTED = ("txt", "md", "text")
#: Bytes of texts in a file, about: a file is read by one task.
FILE_BYTES = 64 << 20
#: Texts that are cut from a file at a time.
_CUT_ROWS = 4096
#: Rows of a report in a file, about.
FILE_ROWS = 2_000_000
#: Candidates in a block of a report that is written block by block: with
#: 1,000 jobs, a hundred million rows or about 4 GB of Parquet.
BLOCK_ROWS = 100_000


def read_texts(spark: SparkSession, path: str, id_col: str = "doc_id", pattern: str | None = None) -> DataFrame:
    """Whole text files as ``(doc_id, text, file_name, file_path)``; a missing
    path raises. The id is a hash of the file's path."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=pattern).select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"))
    return files.select(F.xxhash64("file_path").alias(id_col), F.col("value").alias("text"), "file_name", "file_path")


def write_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Write ``(id, text)`` as text files of about ``file_bytes`` with many
    texts each, a line end after each, below ``path/texts``, and a manifest
    ``(id, part, offset, length)``, in bytes, at ``path/manifest``. A null text is empty."""
    texts = docs.select(F.col(id_col).alias("id"), filled(F.col(text_col).cast("string")).alias("text"))
    size = F.octet_length("text").cast("long")
    at = running_totals(texts, "id", "text", before=size + 1)
    at = at.withColumn("part", F.floor(F.col("before") / file_bytes))
    at.repartition("part").sortWithinPartitions("part", "before").select("part", "text").write.partitionBy("part").text(f"{path}/texts")
    first = at.groupBy("part").agg(F.min("before").alias("first"))
    at.select("id", "part", "before", size.alias("length")).join(first, "part").select(
        "id", "part", (F.col("before") - F.col("first")).alias("offset"), "length"
    ).write.parquet(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str, id_col: str = "doc_id", pattern: str = "*.txt") -> DataFrame:
    """``(id, text)`` of what ``write_texts`` wrote: a file is cut at the places
    that the manifest names. It is cut in Arrow, where a slice costs its own
    length: an expression of Spark would copy the file for each of its texts."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(f"{path}/texts")
    files = files.select(F.regexp_extract("path", r"part=([0-9]+)", 1).cast("long").alias("part"), "content")
    manifest = spark.read.parquet(f"{path}/manifest")
    entries = F.collect_list(F.struct("id", "offset", "length"))  # of one file, so bounded as that is
    named = files.join(manifest.groupBy("part").agg(entries.alias("entries")), "part").select("content", "entries")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                content, places = memoryview(batch.column(0)[row].as_buffer()), batch.column(1)[row].values
                ids, offset, length = (places.field(name) for name in ("id", "offset", "length"))
                for at in range(0, len(places), _CUT_ROWS):
                    bounds = zip(offset.slice(at, _CUT_ROWS).to_pylist(), length.slice(at, _CUT_ROWS).to_pylist())
                    texts = pa.array([content[a : a + n] for a, n in bounds], pa.binary())
                    yield pa.RecordBatch.from_arrays([ids.slice(at, _CUT_ROWS), texts], names=["id", "text"])

    texts = named.mapInArrow(cut, f"id {manifest.schema['id'].dataType.simpleString()}, text binary")
    return texts.select(F.col("id").alias(id_col), F.col("text").cast("string").alias("text"))


def text_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A Parquet or other table as ``(id, text)``, a null text as empty."""
    return docs.select(id_col, filled(F.col(text_col).cast("string")).alias("text"))


def with_suffix(files: DataFrame, name_col: str = "file_name", supported: tuple[str, ...] = SUPPORTED) -> DataFrame:
    """Add suffix (lower case, empty without one) and accepted."""
    suffix = F.lower(F.regexp_extract(filled(F.col(name_col)), r"\.([^./\\]+)$", 1))
    return files.withColumn("suffix", suffix).withColumn("accepted", F.col("suffix").isin(*supported))


def split_supported(files: DataFrame, name_col: str = "file_name", supported: tuple[str, ...] = SUPPORTED) -> tuple[DataFrame, DataFrame]:
    """Files that can be read, and those that are rejected."""
    marked = with_suffix(files, name_col, supported)
    return marked.filter("accepted").drop("accepted"), marked.filter("NOT accepted").drop("accepted")


def with_missing(rows: DataFrame) -> DataFrame:
    """Add missing_fields: the names of the columns that are null, in order."""
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in rows.columns)))
    return rows.withColumn("missing_fields", missing)


def quarantine(rows: DataFrame, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Write rows with every field filled and rows that lack some apart, in
    one pass: the valid ones, the rejected ones with missing_fields, and how many
    of each there are (``valid``, ``rejected``)."""
    seen, bad = Observation(), F.size("missing_fields") > 0
    marked = with_missing(rows).withColumn("rejected", bad)
    count = lambda test: F.count(F.when(test, 1))
    marked = marked.observe(seen, count(~F.col("rejected")).alias("valid"), count(F.col("rejected")).alias("rejected"))
    marked.write.partitionBy("rejected").parquet(path)
    back = rows.sparkSession.read.schema(marked.schema).parquet(path)
    part = lambda test: back.filter(test).drop("rejected")
    return part("NOT rejected").drop("missing_fields"), part("rejected"), dict(seen.get)


def write_report(report: DataFrame, path: str, by: str, *then: str, rows: int | None = None, file_rows: int = FILE_ROWS, mode: str = "errorifexists") -> None:
    """Write a report as Parquet files that hold ranges of ``by``, sorted by it
    and ``then``: as many as its ``rows`` need, however many values ``by`` has. A
    reader that asks for some values skips all files and row groups but theirs.
    ``rows`` is counted if it is not given."""
    rows = report.count() if rows is None else rows
    dealt = report.repartitionByRange(max(1, -(-rows // file_rows)), by, *then).sortWithinPartitions(by, *then)
    dealt.write.mode(mode).parquet(path)


def write_blocks(candidates: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, key: str = "candidate_id", block_rows: int = BLOCK_ROWS) -> int:
    """Write ``make(candidates)`` for one block of candidates after the other,
    each below ``path/block=k``, and return how many blocks were made now. Blocks
    are ranges of ``key`` of ``block_rows`` rows. A block that is whole is not made
    again, so a run that breaks off repeats one block and not the product."""
    spark = candidates.sparkSession
    placed = global_rank(candidates, key).withColumn("block", F.floor((F.col("nth") - 1) / block_rows)).drop("nth")
    placed = stored(placed, "blocks")
    # Bounds of blocks; ``key`` is the same in every run, so blocks are too.
    blocks, made = [r[0] for r in placed.select("block").distinct().collect()], 0
    for block in sorted(blocks):
        done, files = hadoop_path(spark, f"{path}/block={block}/_SUCCESS")
        if not files.exists(done):
            make(placed.filter(F.col("block") == block).drop("block")).write.mode("overwrite").parquet(f"{path}/block={block}")
            made += 1
    return made


def read_range(spark: SparkSession, path: str, test: Column | str) -> DataFrame:
    """The rows of a written report for which ``test`` holds; it reaches the files' statistics."""
    return spark.read.parquet(path).filter(test)
