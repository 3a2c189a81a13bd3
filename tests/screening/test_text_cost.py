"""Text functions and headings do the same with less work for each line."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from siftline.functions import text as t
from siftline.operators import sections


def test_strip_takes_what_the_class_names(spark):
    assert all((chr(c) in t.SPACE_CHARACTERS) == chr(c).isspace() for c in range(1, 0xD800))
    rows = ["", " ", "a", " a b ", "\u3000\ta\n b\x85\u2028", "\r\n", "\u200ba\u200b", "é \xa0", "a \n", None, *t.SPACE_CHARACTERS]
    got = spark.createDataFrame(list(enumerate(rows)), "i long, s string").select("i", t.strip(F.col("s")).alias("s"), F.regexp_replace("s", f"^{t.SPACE}+|{t.SPACE}+$", "").alias("r")).orderBy("i").collect()
    assert [r.s for r in got] == [r.r for r in got] == [None if s is None else s.strip() for s in rows]


def test_a_line_is_normalised_and_cut_into_words_once(spark):
    lines = spark.createDataFrame([(1, 1, "Work History")], "doc_id long, line_no int, line string")
    plan = sections.detect_heading(lines)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"split\(", plan)) == 1 and "INSET" in plan
