"""Whole texts with results derived by hand (FIXTURES.md), given pairs, and a stream of resumes."""

from __future__ import annotations

import pytest

from siftline.operators import profiles, scoring, sections, skills
from siftline.streaming.screen import score_stream

# The texts that FIXTURES.md derives results for.
RESUME = """
Sophia Martinez
Northwood, OH
Sophia.Martinez@example.com

Professional Summary
Innovative AI Software Developer with expertise in machine learning,
Python and TensorFlow.

Work History
AI Software Developer
January 2024 to August 2025
DeepTech Innovations
Developed AI algorithms and optimized neural networks.

Machine Learning Engineer
January 2022 to December 2023
Quantum AI Systems
Designed machine learning models.

Skills
Python
TensorFlow
Machine Learning
Artificial Intelligence
Neural Networks
Data Science

Certifications
Certified AI Practitioner
Machine Learning Specialist

Education
Master of Science: Computer Science
Stanford University

Bachelor of Science: Data Science
University of California, Berkeley

Projects
AI Resume Screening System
Developed a Python-based resume analysis application.
"""
JOB = """Python Developer

We are looking for a Python Developer to join our development team.

Requirements:
- 2+ years of experience in Python development.
- Strong knowledge of Python and Django.
- Experience with REST APIs and SQL.
- Good understanding of Git and version control.
- Bachelor's degree in Computer Science or a related field.

Responsibilities:
- Develop and maintain Python applications.
- Build and integrate REST APIs.
- Work with databases using SQL.
- Collaborate with the development team.
- Write clean and maintainable code."""
SECTION_TEXTS = [
    ("skills", "Python\nPython3\nReactJS\nTensor Flow\nGit\nMERN\nFigma"), ("work_experience", "Developed applications using Django,\nPostgreSQL and AWS."),
    ("projects", "Built a machine learning project using\nPyTorch and Scikit Learn."), ("summary", "AI developer with experience in\nJavaScript and Docker."),
]
BLOCKS = [
    (1, "personal_information", "personal-info", 0.95, 3), (2, "summary", "rule-based", 1.0, 3), (3, "work_experience", "rule-based", 1.0, 9),
    (4, "skills", "rule-based", 1.0, 7), (5, "certifications", "rule-based", 1.0, 3), (6, "education", "rule-based", 1.0, 5), (7, "projects", "rule-based", 1.0, 3),
]
SKILLS = [
    ("Artificial Intelligence", 0.83, "synonym", "summary"), ("AWS", 0.91, "canonical", "work_experience"), ("Django", 0.91, "canonical", "work_experience"),
    ("Docker", 0.86, "canonical", "summary"), ("Express.js", 0.84, "derived_from_MERN", "skills"), ("Figma", 0.98, "canonical", "skills"),
    ("Git", 0.98, "canonical", "skills"), ("JavaScript", 0.86, "canonical", "summary"), ("Machine Learning", 0.88, "canonical", "projects"),
    ("MERN", 0.96, "skill_stack", "skills"), ("MongoDB", 0.84, "derived_from_MERN", "skills"), ("Node.js", 0.84, "derived_from_MERN", "skills"),
    ("PostgreSQL", 0.91, "canonical", "work_experience"), ("Python", 0.98, "canonical", "skills"), ("PyTorch", 0.88, "canonical", "projects"),
    ("React", 0.94, "synonym", "skills"), ("Scikit-learn", 0.85, "synonym", "projects"), ("TensorFlow", 0.94, "synonym", "skills"),
]
OWN = ["Python", "TensorFlow", "Machine Learning", "Artificial Intelligence", "Neural Networks", "Data Science"]


@pytest.fixture(scope="module")
def resumes(spark):
    return spark.createDataFrame([(1, RESUME)], "doc_id long, text string")


@pytest.fixture(scope="module")
def jobs(spark):
    return profiles.parse_job(spark.createDataFrame([(7, JOB)], "job_id long, text string"))


@pytest.fixture(scope="module")
def unified(resumes):
    parts = sections.segment_sections(sections.classify_blocks(sections.split_blocks(resumes)))
    return skills.merge_profile_skills(skills.extract_from_sections(parts), profiles.parse_resume(resumes))


def test_job(jobs):
    job = jobs.first()
    assert (job.role, job.required_skills) == ("Python Developer", ["Python", "Django", "REST APIs", "SQL", "Git"])
    assert (job.experience, job.education) == ("2+ years of experience", "- Bachelor's degree in Computer Science or a related field.")
    assert len(job.responsibilities) == 5
    assert (job.responsibilities[0], job.responsibilities[-1]) == ("Develop and maintain Python applications.", "Write clean and maintainable code.")


def test_blocks_and_section_contents(resumes):
    blocks = sections.classify_blocks(sections.split_blocks(resumes))
    assert [(r.block_id, r.section, r.method, r.confidence, r.n_lines) for r in blocks.orderBy("block_id").collect()] == BLOCKS
    parts = {r.section: r.content for r in sections.segment_sections(blocks).collect()}
    assert set(parts) == {b[1] for b in BLOCKS} and parts["skills"].split("\n") == OWN and parts["personal_information"].startswith("Sophia Martinez")


def test_profile(resumes):
    p = profiles.parse_resume(resumes).first()
    assert (p.name, p.skills, p.languages) == ("Sophia Martinez", OWN, [])
    assert p.certifications == ["Certified AI Practitioner", "Machine Learning Specialist"]
    assert p.education.startswith("Master of Science: Computer Science Stanford University") and "Projects" in p.education
    assert p.experience.startswith("AI Software Developer") and "Skills" in p.experience


def test_unified_skills(unified):
    got = sorted((r.canonical, r.source, r.section, r.confidence) for r in unified.collect())
    assert got == sorted((s, "canonical", "skills", 0.98) for s in OWN)


def test_skills_of_given_sections(spark):
    rows = [(1, s, 1, t) for s, t in SECTION_TEXTS]
    found = skills.extract_from_sections(spark.createDataFrame(rows, "doc_id long, section string, seq int, content string"))
    got = [(r.canonical, r.confidence, r.source, r.section) for r in skills.sort_skills(found).orderBy("nth").collect()]
    assert got == SKILLS


def test_score_all_given_and_streamed(spark, resumes, jobs, unified, tmp_path):
    candidates = skills.replace_profile_skills(profiles.parse_resume(resumes), unified)
    r = scoring.score_report(candidates, jobs).first()
    assert (r.overall_score, r.skill_score, r.experience_score, r.education_score, r.total_experience_years) == (52.0, 20.0, 100.0, 100.0, 3.67)
    assert (r.matched_skills, r.missing_skills) == (["Python"], ["Django", "REST APIs", "SQL", "Git"])
    pairs = spark.createDataFrame([(1, 7), (1, 8), (2, 7)], "candidate_id long, job_id long")
    assert [(x.candidate_id, x.job_id, x.overall_score) for x in scoring.score_report(candidates, jobs, pairs).collect()] == [(1, 7, 52.0)]
    resumes.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(resumes.schema).json(str(tmp_path / "in"))
    out = score_stream(stream, jobs).writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "state"))
    query = out.trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("scored").collect() == scoring.score_report(profiles.parse_resume(resumes), jobs).collect()


def test_ranking_equals_ranking_of_all_pairs(spark):
    """Ties, candidates without a needed skill, jobs that ask for nothing."""
    had = ["Python", "SQL", "Git", "Java", "Docker"]
    texts = []
    for i in range(160):
        own = [s for k, s in enumerate(had) if i >> k & 1]
        years = f"January 2020 to March 202{i % 4}" if i % 3 else ""
        degree = ("", "Bachelor of Science", "Master of Science", "PhD", "Diploma")[i % 5]
        texts.append((i, "\n".join(["Name", "Skills", *own, "Experience", years, "Education", degree])))
    asked = ["Python and SQL", "Git, Docker", "nothing", "Java", "Python, SQL, Git, Java, Docker"]
    degrees = ["", "Bachelor degree", "Master degree"]
    posts = [(j, f"Role\n- {asked[j % 5]}\n- {j % 4} years of experience\n- {degrees[j % 3]}") for j in range(30)]
    candidates = profiles.parse_resume(spark.createDataFrame(texts, "doc_id long, text string"))
    jobs = profiles.parse_job(spark.createDataFrame(posts, "job_id long, text string"))
    every = {}
    for r in scoring.score_report(candidates, jobs).collect():
        every.setdefault(r.job_id, []).append((-r.overall_score, r.candidate_id))
    for k in (1, 7, 200):
        got = {}
        for r in scoring.rank_candidates(candidates, jobs, k).collect():
            got.setdefault(r.job_id, []).append((r.nth, -r.overall_score, r.candidate_id))
        assert {j: [(s, c) for _, s, c in sorted(v)] for j, v in got.items()} == {j: sorted(v)[:k] for j, v in every.items()}
