"""Documents to numbered lines and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import split_lines


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, line_no, line)``: stripped lines that are not blank, numbered
    from 1 without gaps. Only these columns flow on."""
    lines = F.posexplode(split_lines(F.col(text_col)))
    return docs.select(F.col(id_col), lines.alias("pos", "line")).select(id_col, (F.col("pos") + 1).alias("line_no"), "line")


def full_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The clean lines of each document joined by a space; no shuffle."""
    return docs.select(id_col, F.array_join(split_lines(F.col(text_col)), " ").alias("full_text"))


def join_lines(lines: DataFrame, id_col: str = "doc_id", by: str = " ") -> DataFrame:
    """The same from a table of lines: ordered text of each document."""
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy(id_col).agg(parts.alias("parts")).select(id_col, F.array_join(F.transform("parts", lambda p: p["line"]), by).alias("full_text"))
