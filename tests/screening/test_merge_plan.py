"""Profile skills meet found ones without another shuffle of mentions."""

from __future__ import annotations

from siftline.operators import skills

MENTIONS = "doc_id long, name string, canonical string, category string, confidence double, source string, section string, derived_skills array<string>"


def found(spark, *rows):
    return spark.createDataFrame([(d, c, c, "x", sure, "exact_match", "skills", None) for d, c, sure in rows], MENTIONS)


def test_mentions_are_dealt_by_document_only(spark):
    profiles = spark.createDataFrame([(1, ["Python"])], "doc_id long, skills array<string>")
    plan = skills.skill_total(skills.merge_profile_skills(found(spark, (1, "Python", 1.0)), profiles))._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and not [line for line in dealt if "canonical" in line or "key#" in line]


def test_one_sided_documents_repeats_and_earlier_rows(spark):
    profiles = spark.createDataFrame([(1, ["python", "Odd / Thing", "odd/thing", " Odd / Thing"]), (2, ["SQL"]), (3, None), (4, [""])], "doc_id long, skills array<string>")
    mentions = found(spark, (1, "Python", 1.0), (1, "Python", 1.0), (5, "Git", 0.9))
    got = sorted((r.doc_id, r.canonical, r.confidence) for r in skills.merge_profile_skills(mentions, profiles).collect())
    assert got == [(1, "Odd / Thing", 0.7), (1, "Python", 1.0), (1, "odd/thing", 0.7), (2, "SQL", 0.8), (5, "Git", 0.9)]
