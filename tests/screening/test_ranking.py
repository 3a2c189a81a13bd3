"""Scores by bits and the pruned ranking against plain pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siftline.functions.text import education_score
from siftline.operators import scoring

PROFILE = "doc_id long, skills array<string>, experience string, education string"
JOB = "job_id long, required_skills array<string>, experience string, education string"
EDUCATION = ["", "Bachelor of Science", "MASTER of Arts", "phd", "High School", "bachelor and master"]


def made(seed: int, n_skills: int, n: int = 400, m: int = 30):
    rng = random.Random(seed)
    skills = [f"Skill {k}" for k in range(n_skills)]
    months = ["January", "March", "July", "December"]
    some = lambda most: rng.sample(skills, rng.randint(0, min(most, n_skills)))
    span = lambda: f"{rng.choice(months)} 20{rng.randint(10, 15)} to {rng.choice(months)} 20{rng.randint(15, 24)}"
    spell = lambda s: rng.choice([s, s.upper(), f" {s} "])
    people = [(i, [spell(s) for s in some(9)] + ["Other"], " ".join(span() for _ in range(rng.randint(0, 3))), rng.choice(EDUCATION)) for i in rng.sample(range(10_000), n)]
    jobs = []
    for j in range(m):
        asked = some(5)
        asked += asked[:1] if rng.random() < 0.2 else []  # asked for twice
        jobs.append((j, asked, rng.choice(["", "2 years", "5 years of experience", "400 years", "2 years"]), rng.choice(EDUCATION)))
    return people, jobs + [(m + k, *jobs[k][1:]) for k in range(5)]


@pytest.mark.parametrize("seed,n_skills,k", [(1, 12, 4), (2, 150, 3), (3, 5, 7)])
def test_ranking_equals_all_pairs(spark, seed, n_skills, k):
    people, jobs = made(seed, n_skills)
    people, jobs = spark.createDataFrame(people, PROFILE), spark.createDataFrame(jobs, JOB)
    best: dict = {}
    for r in scoring.score_report(people, jobs).select("job_id", "candidate_id", "overall_score").collect():
        best.setdefault(r.job_id, []).append((-r.overall_score, r.candidate_id))
    want = {(j, nth + 1, c, -s) for j, rows in best.items() for nth, (s, c) in enumerate(sorted(rows)[:k])}
    got = [tuple(r) for r in scoring.rank_candidates(people, jobs, k).select("job_id", "nth", "candidate_id", "overall_score").collect()]
    assert len(got) == len(want) and set(got) == want


def test_ranking_scores_few_candidates(spark):
    people, jobs = made(4, 12, 3000, 40)
    known = scoring.facts(scoring.candidate_facts(spark.createDataFrame(people, PROFILE)), scoring.job_facts(spark.createDataFrame(jobs, JOB)))
    looked = scoring.looked_at(known, scoring.ranking(known, 3))
    n = [r["count"] for r in looked.groupBy("kind").count().collect()]
    assert max(n) < 150 and sum(n) / len(n) < 60  # of 3,000


def test_pair_scores_equal_plain_lists(spark):
    people, jobs = made(5, 90, 60, 20)
    rows = {(r.candidate_id, r.job_id): r for r in scoring.score_report(spark.createDataFrame(people, PROFILE), spark.createDataFrame(jobs, JOB)).collect()}
    assert len(rows) == len(people) * len(jobs)
    for i, skills, _, _ in people:
        have = {s.strip().lower() for s in skills}
        for j, asked, _, _ in jobs:
            r = rows[i, j]
            assert r.matched_skills == [s for s in asked if s.lower() in have] and r.missing_skills == [s for s in asked if s.lower() not in have]
            assert r.skill_score == (round(100 * len(r.matched_skills) / len(asked), 2) if asked else 0)
    short = scoring.facts(scoring.candidate_facts(spark.createDataFrame(people, PROFILE)), scoring.job_facts(spark.createDataFrame(jobs, JOB)))
    assert {(r.candidate_id, r.job_id): r.overall_score for r in scoring.score_pairs(short, lists=False).collect()} == {k: r.overall_score for k, r in rows.items()}


def test_degree_bits_equal_the_rule_on_texts(spark):
    pairs = spark.createDataFrame([(a, b) for a in EDUCATION for b in EDUCATION], "have string, need string")
    both = pairs.select(education_score(F.col("have"), F.col("need")).alias("a"), scoring.degree_score(scoring.degree_bits(F.col("have")), scoring.accepted_degrees(F.col("need"))).alias("b"))
    assert both.filter("a <> b").count() == 0


def test_empty_sides(spark):
    people, jobs = made(6, 12, 20, 5)
    people, jobs = spark.createDataFrame(people, PROFILE), spark.createDataFrame(jobs, JOB)
    for a, b in ((people.limit(0), jobs), (people, jobs.limit(0))):
        assert scoring.score_report(a, b).count() == scoring.rank_candidates(a, b).count() == 0
