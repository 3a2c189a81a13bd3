"""Dictionary tables: fixed, small, and so broadcast whatever the corpus."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import dictionaries as d


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal table, planned as one local relation."""
    quote = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else repr(v)
    values = ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)
    casts = [f"cast({c.split()[0]} as {c.split()[1]}) {c.split()[0]}" for c in schema.split(", ")]
    names = ", ".join(c.split()[0] for c in schema.split(", "))
    return spark.sql(f"SELECT {', '.join(casts)} FROM VALUES {values} t({names})")


def section_dim(spark: SparkSession) -> DataFrame:
    return _table(spark, [(s, i) for i, s in enumerate(d.SECTIONS)], "section string, section_ord int")


def section_alias(spark: SparkSession) -> DataFrame:
    """alias_norm, section, alias_ord; the first place of an alias counts, its last section too."""
    rows: dict[str, tuple[str, int]] = {}
    for n, (section, alias) in enumerate((s, a) for s, many in d.SECTION_ALIASES.items() for a in many):
        key = " ".join(alias.replace("&", " and ").split())
        rows[key] = (section, rows[key][1] if key in rows else n)
    return _table(spark, [(k, s, n) for k, (s, n) in rows.items()], "alias_norm string, section string, alias_ord int")


def content_keyword(spark: SparkSession) -> DataFrame:
    rows = [(k, s, i, 2 if " " in k else 1) for i, (s, ks) in enumerate(d.CONTENT_KEYWORDS.items()) for k in ks]
    return _table(spark, rows, "keyword string, section string, section_ord int, weight int")


def master_skills(spark: SparkSession) -> DataFrame:
    return _table(spark, [(s, c) for c, skills in d.MASTER_SKILLS.items() for s in skills], "canonical string, category string")


def synonyms(spark: SparkSession) -> DataFrame:
    return _table(spark, list(d.SYNONYMS.items()), "synonym string, canonical string")


def skill_stacks(spark: SparkSession) -> DataFrame:
    rows = [(s, i, c, j) for i, (s, cs) in enumerate(d.SKILL_STACKS.items()) for j, c in enumerate(cs)]
    return _table(spark, rows, "stack string, stack_ord int, component string, pos int")


def confidence_dim(spark: SparkSession) -> DataFrame:
    return _table(spark, [(k, s, v) for (k, s), v in d.CONFIDENCE.items()], "evidence string, section string, confidence double")


def keyword_dim(spark: SparkSession, words: tuple[str, ...]) -> DataFrame:
    return _table(spark, [(w, i) for i, w in enumerate(words)], "keyword string, ord int")


def term_of(name: str) -> str:
    """A dictionary name as a search term: what ``norm_skill`` makes of it."""
    return re.sub(r" ?([/+-]) ?", r"\1", " ".join(name.lower().replace("&", " and ").split()))


def _lookup() -> dict[str, str]:
    names = {term_of(s): s for many in d.MASTER_SKILLS.values() for s in many}
    return names | {term_of(k): v for k, v in d.SYNONYMS.items()}


def skill_dim(spark: SparkSession) -> DataFrame:
    """term, canonical: normalised names and synonyms; a synonym overrides a name."""
    return _table(spark, list(_lookup().items()), "term string, canonical string")


def skill_terms(spark: SparkSession) -> DataFrame:
    """All distinct search terms and what a mention of each says: term,
    canonical, category, source (canonical, synonym or skill_stack), stack_ord,
    derived_skills and
    derived_categories (of a stack), n_chars."""
    category = {s: c for c, many in d.MASTER_SKILLS.items() for s in many}
    rows = {t: (t, c, category.get(c, "other"), "canonical" if t == term_of(c) else "synonym", -1, "", "") for t, c in _lookup().items()}
    rows |= {term_of(s): (term_of(s), s, "stack", "skill_stack", i, "|".join(cs), "|".join(category.get(c, "other") for c in cs)) for i, (s, cs) in enumerate(d.SKILL_STACKS.items())}
    out = _table(spark, list(rows.values()), "term string, canonical string, category string, source string, stack_ord int, parts string, kinds string")
    parts = (F.when(F.col("parts") != "", F.split(c, r"\|")).alias(n) for c, n in (("parts", "derived_skills"), ("kinds", "derived_categories")))
    return out.select("term", "canonical", "category", "source", "stack_ord", *parts, F.length("term").alias("n_chars"))


def term_pieces(term: str) -> list[str]:
    """Runs of word characters and other single characters of a term."""
    return re.findall(r"\w+|\W", term)


def _terms() -> list[str]:
    return [*_lookup(), *map(term_of, d.SKILL_STACKS)]


#: The most pieces that a term has.
LONGEST_TERM = max(len(term_pieces(t)) for t in _terms())


def term_anchors(spark: SparkSession) -> DataFrame:
    """first, lengths: for each piece that begins a term, how many pieces such terms have."""
    lengths: dict[str, set[int]] = {}
    for pieces in map(term_pieces, _terms()):
        lengths.setdefault(pieces[0], set()).add(len(pieces))
    rows = [(first, ",".join(map(str, sorted(n)))) for first, n in lengths.items()]
    return _table(spark, rows, "first string, lengths string").select("first", F.split("lengths", ",").cast("array<int>").alias("lengths"))


def skill_category(skills: DataFrame, canonical: str = "canonical") -> DataFrame:
    """Add category: that of the canonical name (case-sensitive), else ``other``."""
    names = F.broadcast(master_skills(skills.sparkSession).withColumnRenamed("canonical", "__name"))
    out = skills.join(names, F.col(canonical) == F.col("__name"), "left")
    return out.withColumn("category", F.coalesce("category", F.lit("other"))).drop("__name")
