"""Skill mentions: dictionary matching, stacks, confidence, dedup, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import dictionaries as d
from siftline.functions.dims import LONGEST_TERM, skill_category, skill_dim, skill_stacks, skill_terms, term_anchors
from siftline.functions.text import NOT_WORD, WORD, norm_skill, strip
from siftline.operators.partials import finished, partial

MENTION = ("name", "canonical", "category", "confidence", "source", "section", "derived_skills")


def skill_confidence(evidence: Column, section: Column) -> Column:
    """Confidence of a kind of evidence in a section."""
    known = F.create_map(*(x for (e, s), v in d.CONFIDENCE.items() for x in (F.lit(f"{e} {s}"), F.lit(v))))
    at = lambda s: F.try_element_at(known, F.concat_ws(" ", evidence, s))
    return F.coalesce(at(section), at(F.lit("")), F.lit(d.CONFIDENCE["unknown", ""]))


def _section_order(section: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*(F.lit(s) for s in d.SKILL_SECTIONS)), section), F.lit(0))


def anchored_runs(texts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Runs of pieces that may be a term: doc_id, section, term, last (its last
    piece) and next (the piece behind it). The normalised text is cut into
    pieces, which are runs of word characters or other single characters. Only
    where the first piece of some term stands, runs of the lengths that terms
    with this first piece have are made."""
    anchors = term_anchors(texts.sparkSession)
    pieces = F.regexp_extract_all(norm_skill(F.col("text")), F.lit(f"{WORD}+|{NOT_WORD}"), F.lit(0))
    cut = texts.select(id_col, "section", pieces.alias("pieces")).filter(F.size("pieces") > 0)
    at = F.transform(F.sequence(F.lit(1), F.size("pieces")), lambda i: F.struct(F.get(F.col("pieces"), i - 1).alias("first"), F.slice("pieces", i + 1, F.lit(LONGEST_TERM)).alias("rest")))
    met = cut.select(id_col, "section", F.inline(F.filter(at, lambda x: x["first"] != " "))).join(F.broadcast(anchors), "first")
    run = met.select(id_col, "section", "first", "rest", F.explode("lengths").alias("n")).filter(F.size("rest") >= F.col("n") - 1)
    return run.select(
        id_col, "section", F.concat("first", F.array_join(F.slice("rest", F.lit(1), F.col("n") - 1), "")).alias("term"),
        F.when(F.col("n") == 1, F.col("first")).otherwise(F.get("rest", F.col("n") - 2)).alias("last"), F.get("rest", F.col("n") - 1).alias("next"),
    )


def match_terms(texts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every dictionary term present in ``(doc_id, section, text)``: doc_id,
    section and the columns of ``skill_terms``. Each term is tested alone, so
    overlapping terms all count.

    ``anchored_runs`` meet the terms in a broadcast hash join. A run that ends
    in a word character ends at a piece boundary anyway; after another one, no
    word may follow.
    """
    glued = ~F.col("last").rlike(f"{WORD}$") & F.coalesce(F.col("next").rlike(f"^{WORD}"), F.lit(False))
    terms = skill_terms(texts.sparkSession)
    # Repeats go while rows are narrow; only then come the terms' columns.
    met = anchored_runs(texts, id_col).join(F.broadcast(terms.select("term")), "term", "left_semi").filter(~glued)
    return met.select(id_col, "section", "term").distinct().join(F.broadcast(terms), "term").drop("n_chars")


def match_skills(texts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One mention for each term present in a text."""
    sure = skill_confidence(F.col("source"), F.col("section"))
    return match_terms(texts, id_col).select(
        id_col, F.col("canonical").alias("name"), "canonical", "category", sure.alias("confidence"), "source", "section", "derived_skills",
        "derived_categories", "stack_ord",
    )


def expand_stack(skills: DataFrame) -> DataFrame:
    """Add derived_skills: the components of a stack, null for other skills."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "component")))
    stacks = skill_stacks(skills.sparkSession).groupBy(F.col("stack").alias("__stack")).agg(parts.alias("parts"))
    stacks = F.broadcast(stacks.select("__stack", F.transform("parts", lambda p: p["component"]).alias("derived_skills")))
    return skills.join(stacks, F.col("canonical") == F.col("__stack"), "left").drop("__stack")


def merge_stack_components(mentions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Mentions and one derived mention for each component of each stack. Add
    seq_ord: found mentions come before derived ones, those by stack."""
    sure, none = F.lit(d.CONFIDENCE["derived", ""]), F.lit(None).cast("array<string>")

    def row(name: Column, category: Column, confidence: Column, source: Column, derived: Column, seq: Column) -> Column:
        fields = (name.alias("name"), name.alias("canonical"), category.alias("category"), confidence.alias("confidence"), source.alias("source"))
        return F.struct(*fields, F.col("section").alias("section"), derived.alias("derived_skills"), seq.alias("seq_ord"))

    own = row(F.col("canonical"), F.col("category"), F.col("confidence"), F.col("source"), F.col("derived_skills"), F.lit(-1))
    made_by = F.concat(F.lit("derived_from_"), F.col("canonical"))
    parts = F.zip_with("derived_skills", "derived_categories", lambda skill, category: row(skill, category, sure, made_by, none, F.col("stack_ord")))
    return mentions.select(id_col, F.inline(F.concat(F.array(own), F.coalesce(parts, F.array_remove(F.array(own), own)))))


def dedup_skills(mentions: DataFrame, id_col: str = "doc_id", within: tuple[str, ...] = ()) -> DataFrame:
    """One mention per canonical: the highest confidence, then the section
    searched first, then the first seen."""
    order = Window.partitionBy(id_col, *within, "canonical").orderBy(F.desc("confidence"), _section_order(F.col("section")), "seq_ord", "source")
    return mentions.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select(id_col, *MENTION)


def extract_skills(texts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Skills of each (doc_id, section, text) by itself."""
    return dedup_skills(merge_stack_components(match_skills(texts, id_col), id_col), id_col, ("section",))


def section_texts(sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One text for each document and searched section."""
    kept = sections.filter(F.col("section").isin(*d.SKILL_SECTIONS))
    parts = F.array_sort(F.collect_list(F.struct("seq", "content")))
    return kept.groupBy(id_col, "section").agg(parts.alias("parts")).select(id_col, "section", F.array_join(F.transform("parts", lambda p: p["content"]), "\n").alias("text"))


def extract_from_sections(sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Skills of each document from its four searched sections. Deduplicating
    once over all sections gives what doing it by section and then again does."""
    return dedup_skills(merge_stack_components(match_skills(section_texts(sections, id_col), id_col), id_col), id_col)


def merge_profile_skills(extracted: DataFrame, profiles: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Add the profile's skills that were not found: known ones as their
    canonical at 0.80, others as they are at 0.70. A profile skill is left out
    if a found or earlier one has its canonical, or for an unknown one its
    normal form, as lower-cased canonical."""
    # The outer form: a filter that Spark infers on the array would copy the whole profile expression below the generator.
    raw = profiles.select(id_col, F.posexplode_outer("skills").alias("pos", "raw")).filter("raw <> ''")
    raw = raw.withColumn("term", norm_skill(F.col("raw"))).join(F.broadcast(skill_dim(profiles.sparkSession).withColumnRenamed("canonical", "known")), "term", "left")
    raw = raw.withColumns({
        "canonical": F.coalesce("known", strip(F.col("raw"))),
        "key": F.lower(F.coalesce("known", "term")),
    }).withColumn("low", F.lower("canonical"))
    named = skill_category(raw.select(id_col, "pos", "key", "low", "canonical", F.col("known").isNotNull().alias("is_known")))
    kind = F.when(F.col("is_known"), "candidate_profile").otherwise("unknown")
    given = named.select(
        id_col, "pos", F.col("canonical").alias("name"), "canonical", F.when(F.col("is_known"), F.col("category")).otherwise("other").alias("category"),
        skill_confidence(kind, F.lit("")).alias("confidence"), F.lit("candidate_profile").alias("source"), F.lit("candidate_profile").alias("section"),
        F.lit(None).cast("array<string>").alias("derived_skills"), "key", "low",
    )
    # A document's rows meet as arrays, so mentions are not shuffled again: those found already lie by document.
    rows = F.array_sort(F.collect_list(F.struct("pos", *MENTION, "key", "low")))
    given = given.groupBy(id_col).agg(rows.alias("given"))
    found = extracted.groupBy(id_col).agg(F.collect_list(F.struct(*MENTION)).alias("found"))
    found = found.withColumn("keys", F.array_distinct(F.transform("found", lambda m: F.lower(m["canonical"]))))
    # Earlier rows of the profile: their lower-cased canonicals, before this one.
    lows = F.transform("given", lambda g: g["low"])
    both = found.join(given.withColumn("lows", lows), id_col, "full_outer")
    seen = lambda g, i: F.array_position("lows", g["key"]).between(1, i) | F.coalesce(F.array_contains("keys", g["key"]), F.lit(False))
    both = both.withColumn("added", F.filter("given", lambda g, i: ~seen(g, i)))
    mention = lambda m, seq: F.struct(*(m[c].alias(c) for c in MENTION), seq.alias("seq_ord"))
    both = both.select(
        id_col, F.transform("found", lambda m: mention(m, F.lit(-1))).alias("found"), F.transform("added", lambda g: mention(g, g["pos"])).alias("added"),
    )
    none = F.array().cast(both.schema["found"].dataType)
    both = both.select(id_col, F.concat(F.coalesce("found", none), F.coalesce("added", none)).alias("all"))
    # Of mentions with one canonical the best stays, as in ``dedup_skills``.
    rank = lambda m: F.struct(-m["confidence"], _section_order(m["section"]), m["seq_ord"], m["source"])
    best = both.select(id_col, F.array_sort(F.transform("all", lambda m: F.struct(rank(m).alias("rank"), m.alias("mention")))).alias("all"))
    best = best.withColumn("canonicals", F.transform("all", lambda m: m["mention"]["canonical"]))
    first = F.filter("all", lambda m, i: F.array_position("canonicals", m["mention"]["canonical"]) == i + 1)
    return best.select(id_col, F.inline(F.transform(first, lambda m: m["mention"]))).select(id_col, *MENTION)


def replace_profile_skills(profiles: DataFrame, unified: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Profiles with the unified canonicals, sorted, as their skills."""
    names = F.array_sort(F.collect_list(F.struct(F.lower("canonical").alias("low"), "canonical")))
    lists = unified.groupBy(id_col).agg(names.alias("names")).select(id_col, F.transform("names", lambda n: n["canonical"]).alias("skills"))
    out = profiles.drop("skills").join(lists, id_col, "left")
    return out.withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))


def compare_skills(profiles: DataFrame, unified: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, skill, status (kept, added or dropped) before and after unification."""
    before = profiles.select(id_col, F.explode_outer(F.array_distinct("skills")).alias("skill")).filter("skill IS NOT NULL").withColumn("was", F.lit(True))
    after = unified.select(id_col, F.col("canonical").alias("skill")).distinct().withColumn("is", F.lit(True))
    status = F.when(F.col("was") & F.col("is"), "kept").when(F.col("is"), "added").otherwise("dropped")
    return before.join(after, [id_col, "skill"], "full_outer").select(id_col, "skill", status.alias("status"))


def skill_total(unified: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return unified.groupBy(id_col).agg(F.count("*").alias("total_skills"))


def source_breakdown(unified: DataFrame) -> DataFrame:
    return finished(partial(unified, ["source"]), "n_skills")


def skill_summary(unified: DataFrame) -> DataFrame:
    """category, source, section, n_skills, avg_confidence over the corpus."""
    return finished(skill_partial(unified), "n_skills", "avg_confidence")


def skill_partial(unified: DataFrame) -> DataFrame:
    """What ``skill_summary`` needs of a batch."""
    return partial(unified, ["category", "source", "section"], "confidence")


def sort_skills(unified: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Add nth: the place in order of lower-cased canonical, by document."""
    order = Window.partitionBy(id_col).orderBy(F.lower("canonical"), "canonical")
    return unified.withColumn("nth", F.row_number().over(order))
