"""Hand-derived results for the screening operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siftline.functions import text as t
from siftline.operators import lines, profiles, scoring, sections, skills
from siftline.sources import documents as src


def one(spark, value: str, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("line", "want"), [
    ("1. Skills", ("skills", 0.98)), ("Technical Skills :", ("skills", 1.0)), ("Skills & Expertise", ("skills", 1.0)),
    ("Experience with SQL", ("work_experience", 0.90)), ("My project experience", ("work_experience", 0.90)), ("Plain text", ("other", 0.0)),
    ("• Education", ("education", 1.0)), ("-:|", ("other", 0.0)),
])
def test_headings(spark, line, want):
    got = sections.detect_heading(spark.createDataFrame([(1, 1, line)], "doc_id long, line_no int, line string")).first()
    assert (got.heading_section, got.heading_confidence) == want


@pytest.mark.parametrize(("text", "want"), [
    ("C++ and Java", {"C", "Java"}), ("React Native, C#, R&D", {"React Native", "React", "C#", "C", "R"}), ("CI / CD", {"CI/CD"}),
    ("Uses Python.", {"Python"}), ("Tensor-Flow; sklearn", {"TensorFlow", "Scikit-learn"}), ("éc", set()),
])
def test_skill_matches(spark, text, want):
    df = spark.createDataFrame([(1, "skills", text)], "doc_id long, section string, text string")
    assert {r.canonical for r in skills.match_skills(df).collect()} == want


def test_predicates_and_numbers(spark):
    assert one(spark, "2020-2022", lambda c: t.has_personal_info(c)) and one(spark, "a@b.co", lambda c: t.has_personal_info(c))
    assert not one(spark, "call 123", lambda c: t.has_personal_info(c))
    assert one(spark, "Marketing 2024", lambda c: t.has_experience_date(c)) and not one(spark, "in 2024", lambda c: t.has_experience_date(c))
    assert one(spark, "2+ years of experience", t.extract_years) == 2 and one(spark, "2.5 YEARS", t.extract_years) == 2.5 and one(spark, "none", t.extract_years) == 0
    months = lambda s: one(spark, s, lambda c: t.experience_months(t.experience_ranges(c)))
    assert months("January 2024 to August 2025 and January 2022 - December 2023") == 44
    assert months("December 2021 to January 2020") == 0 and months("Jan 2020 to Mar 2021") == 0
    assert one(spark, "  - Uses Python.", t.tokens) == ["uses", "python."]
    assert one(spark, "-- a -", t.strip_bullet) == "a -"


RESUME = """Sophia Example
sophia@example.com
AI Software Developer
Professional Summary
Innovative AI developer with machine learning expertise.
Work History
AI Software Developer
January 2024 to August 2025
Built systems with MERN.
Skills
Python
TensorFlow
Education
Master of Science
Languages
English
"""
JOB = """Python Developer

Requirements:
- 2+ years of experience in development.
- Strong knowledge of Python and Django.
- Bachelor's degree in Computer Science.
Responsibilities:
- Develop applications.
note
- Write clean code.
Requirements again
- not this
"""


def test_resume_end_to_end(spark):
    docs = spark.createDataFrame([(1, RESUME), (2, None), (3, "")], "doc_id long, text string")
    blocks = sections.classify_blocks(sections.split_blocks(docs))
    got = [(r.block_id, r.section, r.method, r.confidence, r.n_lines) for r in blocks.orderBy("block_id").collect()]
    assert got == [
        (1, "personal_information", "personal-info", 0.95, 3), (2, "summary", "rule-based", 1.0, 2), (3, "work_experience", "rule-based", 1.0, 4),
        (4, "skills", "rule-based", 1.0, 3), (5, "education", "rule-based", 1.0, 4),  # Languages is no section's heading
    ]
    profile = {r.doc_id: r for r in profiles.parse_resume(docs).collect()}
    assert profile[1].name == "Sophia Example" and profile[1].education == "Master of Science" and profile[1].languages == ["English"]
    assert profile[2].skills == [] and profile[3].name == ""
    found = skills.extract_from_sections(sections.segment_sections(blocks))
    by = {r.canonical: (r.confidence, r.source, r.section) for r in found.collect()}
    assert by["TensorFlow"] == (0.98, "canonical", "skills") and by["MERN"] == (0.96, "skill_stack", "work_experience")
    assert by["React"] == (0.84, "derived_from_MERN", "work_experience") and by["Artificial Intelligence"][0] == 0.88
    merged = skills.merge_profile_skills(found, profiles.parse_resume(docs))
    assert {r.canonical for r in merged.collect()} >= {"Python", "TensorFlow", "Machine Learning", "Node.js"}
    rows = lines.clean_lines(docs)
    assert rows.count() == len([x for x in RESUME.split("\n") if x.strip()])


def test_job_and_score(spark):
    jobs = profiles.parse_job(spark.createDataFrame([(7, JOB), (8, "")], "job_id long, text string"))
    job = {r.job_id: r for r in jobs.collect()}
    assert job[7].role == "Python Developer" and job[7].required_skills == ["Python", "Django"]
    assert job[7].experience == "2+ years of experience" and job[7].education == "- Bachelor's degree in Computer Science."
    assert job[7].responsibilities == ["Develop applications.", "Write clean code."] and job[8].responsibilities == []
    docs = spark.createDataFrame([(1, RESUME), (2, "")], "doc_id long, text string")
    report = {(r.candidate_id, r.job_id): r for r in scoring.score_report(profiles.parse_resume(docs), jobs).collect()}
    r = report[1, 7]
    assert (r.skill_score, r.experience_score, r.education_score, r.total_experience_years) == (50.0, 83.5, 100.0, 1.67)
    assert r.overall_score == 66.7 and r.matched_skills == ["Python"] and r.missing_skills == ["Django"]
    assert report[2, 7].overall_score == 0.0 and report[1, 8].skill_score == 0.0
    best = scoring.rank_candidates(profiles.parse_resume(docs), jobs, 1).collect()
    assert {(x.job_id, x.candidate_id) for x in best} == {(7, 1), (8, 1)}


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.TXT").write_text("x")
    (tmp_path / "c.pdf").write_text("y")
    good, bad = src.split_supported(src.read_texts(spark, str(tmp_path)))
    assert {(r.file_name, r.text) for r in good.collect()} == {("a.txt", "one\ntwo"), ("b.TXT", "x")} and [r.suffix for r in bad.collect()] == ["pdf"]
    assert [r.file_name for r in src.read_texts(spark, str(tmp_path), pattern="*.pdf").collect()] == ["c.pdf"]
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (None, None)], "i int, s string")
    valid, invalid, n = src.quarantine(rows, str(tmp_path / "checked"))
    assert n == {"valid": 2, "rejected": 2} and valid.columns == ["i", "s"] and {r.i for r in valid.collect()} == {1, 3}
    assert {(r.i, *r.missing_fields) for r in invalid.collect()} == {(2, "s"), (None, "i", "s")}
    valid, invalid, n = src.quarantine(rows.limit(0), str(tmp_path / "none"))
    assert n == {"valid": 0, "rejected": 0} and valid.count() == invalid.count() == 0
    with pytest.raises(Exception, match="(?i)path"):
        src.read_texts(spark, str(tmp_path / "missing")).count()
