"""Lines to headings, blocks, classified blocks and section maps.

A document's lines are dealt by document once; the window that numbers blocks
and the grouping that joins their lines reuse that partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import dictionaries as d
from siftline.functions.dims import content_keyword, section_alias, section_dim
from siftline.functions.text import clean_heading, has_experience_date, has_personal_info, norm_heading, tokens
from siftline.operators.lines import clean_lines
from siftline.operators.partials import finished, partial

CONTENT_FLOOR, STRONG = 0.40, 0.60


def _normalized(lines: DataFrame) -> DataFrame:
    return lines.withColumn("norm", norm_heading(F.col("line"))).withColumn("cleaned", clean_heading(F.col("norm")))


def _alias(lines: DataFrame, key: str, name: str) -> DataFrame:
    alias = section_alias(lines.sparkSession).select(F.col("alias_norm").alias(f"{name}_key"), F.col("section").alias(name))
    return lines.join(F.broadcast(alias), F.col(key) == F.col(f"{name}_key"), "left").drop(f"{name}_key")


def heading_exact(lines: DataFrame) -> DataFrame:
    """Add exact_section: the section of which the normalised line is an alias."""
    return _alias(_normalized(lines), "norm", "exact_section")


def heading_cleaned(lines: DataFrame) -> DataFrame:
    """Add cleaned_section: the same without leading numbering and bullets."""
    return _alias(_normalized(lines), "cleaned", "cleaned_section")


def _ends(cleaned: Column, words: Column) -> Column:
    """First and last one to three of so many words, where more words follow or precede."""
    parts = [F.when(words > n, F.substring_index(cleaned, " ", k)) for n in (1, 2, 3) for k in (n, -n)]
    return F.array_compact(F.array(*parts))


def heading_affix(lines: DataFrame) -> DataFrame:
    """Add affix_section: of the aliases that begin or end the cleaned line, the
    one declared first. Aliases have at most three words, so the lines' first
    and last words are looked up and not each alias tried."""
    alias = section_alias(lines.sparkSession).filter("alias_norm <> ''")
    found = F.map_from_entries(F.collect_list(F.struct("alias_norm", F.struct("alias_ord", "section").alias("v"))))
    lookup = F.broadcast(alias.agg(found.alias("aliases")))
    # Hardly any line has one. A set of literals tells that by hash; a map is searched entry by entry.
    known = [r.alias_norm for r in alias.select("alias_norm").collect()]
    cut = _normalized(lines).withColumn("words", F.size(F.split("cleaned", " ")))
    cut = cut.withColumn("ends", F.filter(_ends(F.col("cleaned"), F.col("words")), lambda e: e.isin(known))).drop("words")
    met = F.array_compact(F.transform("ends", lambda e: F.try_element_at(F.col("aliases"), e)))
    return cut.crossJoin(lookup).withColumn("affix_section", F.array_min(met)["section"]).drop("aliases", "ends")  # one row


def detect_heading(lines: DataFrame) -> DataFrame:
    """Add heading_section (``other`` without one) and heading_confidence."""
    out = heading_affix(lines)
    out = _alias(_alias(out, "norm", "exact_section"), "cleaned", "cleaned_section")
    blank = F.col("norm") == ""
    section = F.coalesce("exact_section", "cleaned_section", "affix_section")
    confidence = (
        F.when(F.col("exact_section").isNotNull(), 1.0).when(F.col("cleaned_section").isNotNull(), 0.98).when(F.col("affix_section").isNotNull(), 0.90)
    )
    return out.withColumns({
        "heading_section": F.when(blank, "other").otherwise(F.coalesce(section, F.lit("other"))),
        "heading_confidence": F.when(blank, 0.0).otherwise(F.coalesce(confidence, F.lit(0.0))),
    }).drop("norm", "cleaned", "exact_section", "cleaned_section", "affix_section")


def split_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, block_id (from 1), first_line, text, body (the text without its
    first line), heading_section, heading_confidence, n_lines. A block starts
    at each heading; what precedes the first is block 1."""
    dealt = docs.select(id_col, text_col).repartition(F.col(id_col))
    lines = detect_heading(clean_lines(dealt, id_col, text_col))
    order = Window.partitionBy(id_col).orderBy("line_no")
    starts = (F.col("heading_section") != "other") | (F.col("line_no") == 1)
    numbered = lines.withColumn("block_id", F.sum(starts.cast("int")).over(order).cast("int"))
    rows = F.array_sort(F.collect_list(F.struct("line_no", "line", "heading_section", "heading_confidence")))
    blocks = numbered.groupBy(id_col, "block_id").agg(rows.alias("rows"))
    joined = lambda rows: F.array_join(F.transform(rows, lambda r: r["line"]), "\n")
    first = F.col("rows")[0]
    return blocks.select(
        id_col, "block_id", first["line"].alias("first_line"), joined(F.col("rows")).alias("text"),
        joined(F.slice("rows", 2, F.greatest(F.lit(1), F.size("rows")))).alias("body"), first["heading_section"].alias("heading_section"),
        first["heading_confidence"].alias("heading_confidence"), F.size("rows").cast("long").alias("n_lines"),
    )


def _content_points(text: Column) -> Column:
    """Array of (score, -order, section), one for each section."""
    met, low = F.array_distinct(tokens(text)), F.lower(text)
    points = []
    for i, (section, words) in enumerate(d.CONTENT_KEYWORDS.items()):
        single = F.size(F.array_intersect(met, F.array(*(F.lit(w) for w in words if " " not in w))))
        phrases = [F.when(F.contains(low, F.lit(w)), 2).otherwise(0) for w in words if " " in w]
        points.append(F.struct(reduce(Column.__add__, phrases, single).cast("double").alias("score"), F.lit(-i).alias("first"), F.lit(section).alias("section")))
    return F.array(*points)


def content_scores(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Points of each section for each text, as rows: keys, section, score. A
    token is worth one point a keyword, a phrase two. Tokens and the phrases that
    occur meet the keyword table in a broadcast join; only sections with points are there."""
    words = F.broadcast(content_keyword(texts.sparkSession).select("keyword", "section", "weight"))
    low = F.lower(F.col(text_col))
    longer = dict.fromkeys(w for many in d.CONTENT_KEYWORDS.values() for w in many if " " in w)
    phrases = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in longer)))
    met = texts.select(*keys, F.explode(F.concat(F.array_distinct(tokens(F.col(text_col))), phrases)).alias("keyword"))
    return met.join(words, "keyword").groupBy(*keys, "section").agg(F.sum("weight").cast("double").alias("score"))


def classify_content(texts: DataFrame, text_col: str = "text", where: Column | None = None) -> DataFrame:
    """Add content_section and content_confidence; ties go to the section
    declared first. Texts where ``where`` does not hold are not looked at: other, 0."""
    known = F.coalesce(F.col("best.score") > 0, F.lit(False))
    best = F.array_max(_content_points(F.col(text_col)))
    return texts.withColumn("best", best if where is None else F.when(where, best)).withColumns({
        "content_section": F.when(known, F.col("best.section")).otherwise("other"),
        "content_confidence": F.when(known, F.bround(F.least(F.col("best.score") / 5.0, F.lit(1.0)), 2)).otherwise(0.0),
    }).drop("best")


def classify_blocks(blocks: DataFrame) -> DataFrame:
    """Add section, method, confidence. Every block but the first begins with a
    heading, so the class of a block follows from its number and text alone."""
    tests = [
        ((F.col("block_id") == 1) & has_personal_info(F.col("text")), "personal-info"),
        (F.col("heading_section") != "other", "rule-based"),
        (has_experience_date(F.col("text")), "date-pattern"),
        (F.col("content_confidence") >= CONTENT_FLOOR, "nlp-fallback"),
    ]
    method = F.lit("context")
    for test, name in reversed(tests):
        method = F.when(test, name).otherwise(method)
    by = F.col("method")
    return classify_content(blocks, where=F.col("heading_section") == "other").withColumn("method", method).withColumns({
        "section": F.when(by == "personal-info", "personal_information").when(by == "rule-based", F.col("heading_section"))
        .when(by == "date-pattern", "work_experience").when(by == "nlp-fallback", F.col("content_section")).otherwise("other"),
        "confidence": F.when(by.isin("personal-info", "date-pattern"), 0.95).when(by == "rule-based", F.col("heading_confidence"))
        .when(by == "nlp-fallback", F.col("content_confidence")).otherwise(STRONG),
    }).drop("content_section", "content_confidence")


def context_carry(classified: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Add current_section: the last section up to this block that strong
    evidence set, ``other`` before any."""
    strong = F.when((F.col("confidence") >= STRONG) & (F.col("method") != "context"), F.col("section"))
    order = Window.partitionBy(id_col).orderBy("block_id").rowsBetween(Window.unboundedPreceding, 0)
    return classified.withColumn("current_section", F.coalesce(F.last(strong, ignorenulls=True).over(order), F.lit("other")))


def segment_sections(classified: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Long form: doc_id, section, seq (from 1), content. A block found by its
    heading gives its body, which may be nothing; others their whole text."""
    content = F.when(F.col("method") == "rule-based", F.col("body")).otherwise(F.col("text"))
    kept = classified.withColumn("content", content).filter("content <> ''")
    seq = F.row_number().over(Window.partitionBy(id_col, "section").orderBy("block_id"))
    return kept.select(id_col, "section", seq.alias("seq"), "content")


def sections_map(sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Wide form: every section with its list of contents, empty ones too."""
    got = sections.groupBy(id_col).agg(F.collect_list(F.struct("section", "seq", "content")).alias("rows"))
    entry = lambda s: F.struct(
        F.lit(s).alias("key"), F.transform(F.array_sort(F.filter("rows", lambda r: r["section"] == s)), lambda r: r["content"]).alias("value")
    )
    return got.select(id_col, F.map_from_entries(F.array(*(entry(s) for s in d.SECTIONS))).alias("sections"))


def section_summary(sections: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Contents of each section of each document, zeros too: doc_id, section, n_blocks."""
    counts = [F.count(F.when(F.col("section") == s, 1)).alias(s) for s in d.SECTIONS]
    wide = docs.select(id_col).join(sections.groupBy(id_col).agg(*counts), id_col, "left")
    rows = F.array(*(F.struct(F.lit(s).alias("section"), F.coalesce(F.col(s), F.lit(0)).cast("long").alias("n_blocks")) for s in d.SECTIONS))
    return wide.select(id_col, F.inline(rows))


def sections_detected(sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return sections.groupBy(id_col).agg(F.count_distinct("section").alias("sections_detected"))


def blocks_classified(classified: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return classified.groupBy(id_col).agg(F.count("*").alias("blocks_classified"))


def method_breakdown(classified: DataFrame) -> DataFrame:
    """section, method, n_blocks, avg_confidence over the corpus."""
    return finished(partial(classified, ["section", "method"], "confidence"), "n_blocks", "avg_confidence")


def section_order(spark) -> DataFrame:
    """The sections in output order."""
    return section_dim(spark)
