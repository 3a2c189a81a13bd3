"""Exact deduplication by distributed MSD radix partitioning.

Documents start in one group. At each level a group is split by its members'
next bytes, taken as one wide digit, until a group is a single document or its
members have ended. Members of an ended group have met byte for byte, so
equality rests on no digest. Digits widen by a factor each level, so the
number of levels is the logarithm of the longest text.

Splitting counts digits with partial aggregation, so a group that holds a
third of all rows costs each task one row. Only digits that occur more than
once are written, and documents without one of them are settled. Documents meet
that table in a shuffle. It is never broadcast, so a larger corpus runs the
same plan; each level moves what is left of the texts that still have a
partner, once. Digits of large groups are salted, by as many keys as the
counted size of the largest needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import ascii_lower, broadcast_if_small, doc_texts, drop_scratch, scratch_table

#: A digit is salted if over a thousandth of the level's grouped rows have it, and at least so many: 1,000 digits at most.
HOT_SHARE, HOT_ROWS = 1000, 10_000


def exact_groups(
    docs: DataFrame, digit_bytes: int = 256, widen: int = 16, hot_rows: int = HOT_ROWS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept,
    text_sha256 (lowercase hex of the normalised text).

    Texts are equal when identical after lower-casing A-Z; a null text counts
    as empty, and empty texts equal each other. The largest doc_id of a group
    stays. Rows that repeat a doc_id each count; where such rows are equal and
    have the group's largest doc_id, each is marked kept (``drop_copies``
    leaves one). A null doc_id is below all others. An empty table gives an
    empty table; other columns are not looked at.
    """
    return _grouped(docs, digit_bytes, widen, hot_rows, id_col, text_col)[0]


def _grouped(docs: DataFrame, digit_bytes: int, widen: int, hot_rows: int, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of ``exact_groups`` and the scratch tables that they are read from."""
    norm = ascii_lower(F.col("text"))
    active = doc_texts(docs, id_col, text_col).select(
        "doc_id", F.unhex(F.sha2(norm, 256)).alias("sha"), F.lit(0).cast("long").alias("grp"), norm.cast("binary").alias("rest")
    )
    levels, settled, width = [], [], digit_bytes
    while True:
        level = _split(active, width, hot_rows)
        levels.append(level)
        settled.append(level.filter("rest IS NULL").select("doc_id", "sha", "keep_id", "group_size"))
        active = level.filter("rest IS NOT NULL").select("doc_id", "sha", "grp", "rest")
        if active.isEmpty():
            break
        width *= widen
    out = reduce(DataFrame.unionByName, settled).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    return out, levels


def _split(active: DataFrame, width: int, hot_rows: int) -> DataFrame:
    """Split groups by the next ``width`` bytes. A row's ``rest`` is null once
    its group is settled."""
    digit, more = F.substring("rest", 1, width).alias("digit"), (F.length("rest") > width).alias("more")
    shared = scratch_table(
        active.select("grp", "doc_id", digit, more).groupBy("grp", "digit", "more")
        .agg(F.count("*").alias("n"), F.max("doc_id").alias("keep"))
        .filter("n > 1").withColumn("next_grp", F.monotonically_increasing_id()),
        "radix-shared",
    )
    total, largest = shared.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    bound = max(hot_rows, total // HOT_SHARE)
    salts = -(-largest // bound) or 1
    mark = F.xxhash64("grp", "digit", "more")
    hot = [r[0] for r in shared.filter(F.col("n") > bound).select(mark).collect()]  # at most HOT_SHARE rows
    keyed = active.select("doc_id", "sha", "grp", digit, more, F.expr(f"substring(rest, {width + 1}, length(rest))").alias("left"))
    # By place and not by id, so that rows with one id or none are split too. ``active`` is a table that gives the same rows each time.
    keyed = keyed.withColumn("salt", F.when(mark.isin(hot), F.monotonically_increasing_id() % salts).otherwise(F.lit(0).cast("long")))
    zero, last = (F.lit(x).cast("long") for x in (0, salts - 1))
    salted = shared.withColumn("salt", F.explode(F.when(mark.isin(hot), F.sequence(zero, last)).otherwise(F.array(zero)))).hint("merge")
    out = keyed.join(salted, ["grp", "digit", "more", "salt"], "left").select(
        "doc_id", "sha",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("next_grp").alias("grp"),
        F.when(F.col("n").isNotNull() & F.col("more"), F.col("left")).alias("rest"),
    )
    level = scratch_table(out, "radix-level")
    drop_scratch(shared)
    return level


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, one row of each group of equal texts.

    Rows are told apart by doc_id and text, so a repeated or null doc_id takes
    no other text with it.
    """
    out, levels = _grouped(docs, 256, 16, HOT_ROWS, id_col, text_col)
    named = out.select(F.col("doc_id").alias("__its_id"), F.unhex("text_sha256").alias("__its_sha"), "kept").groupBy("__its_id", "__its_sha", "kept").agg(F.count("*").alias("n"))
    # Rows that go, and rows that stay but equal another in id and text.
    marks = scratch_table(named.filter("NOT kept OR n > 1").select("__its_id", "__its_sha", "kept"), "radix-marks")
    drop_scratch(*levels)
    sha = F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), 256))
    marked = docs.withColumns({"__row_id": F.col(id_col).cast("long"), "__row_sha": sha})
    same = F.col("__row_id").eqNullSafe(F.col("__its_id")) & (F.col("__row_sha") == F.col("__its_sha"))
    rest = marked.join(broadcast_if_small(marks), same, "left_anti")
    twins = scratch_table(marks.filter("kept"), "radix-twins")
    if not twins.isEmpty():
        again = marked.join(broadcast_if_small(twins), same, "left_semi")
        rest = rest.unionByName(again.dropDuplicates(["__row_id", "__row_sha"]))
    return rest.drop("__row_id", "__row_sha")
