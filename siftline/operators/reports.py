"""The summary of a screening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators.scoring import LISTS, SCORES, Facts, all_pairs, candidate_facts, class_report, facts, job_facts, score_pairs

COUNTS = ("sections_detected", "blocks_classified", "total_skills")


def experience_met(candidate_years: Column, required_years: Column) -> Column:
    """Whether the years suffice; no required years are always met."""
    return candidate_years >= required_years


def summary_facts(profiles: DataFrame, jobs: DataFrame, sections_detected: DataFrame, blocks_classified: DataFrame, skill_totals: DataFrame) -> Facts:
    """Numbers of both sides, with the counts of a candidate's sections, blocks and skills."""
    known = candidate_facts(profiles)
    for name, table in zip(COUNTS, (sections_detected, blocks_classified, skill_totals)):
        known = known.join(table.select(F.col("doc_id").alias("candidate_id"), name), "candidate_id", "left")
    return facts(known.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in COUNTS}), job_facts(jobs))


def summarize(known: Facts, pairs: DataFrame | None = None) -> DataFrame:
    """One row per pair: scores, years, whether they suffice, matched and
    required skills, what is missing, and the candidate's counts."""
    keep = ("required_years", "n_required", *COUNTS)
    by_class = pairs is None and not known.candidates.isStreaming
    report = class_report(known, *LISTS, *keep, *SCORES) if by_class else score_pairs(known, pairs, *keep)
    rows = report.select(
        "candidate_id", "job_id", "overall_score", "skill_score", "experience_score", "education_score", "total_experience_years",
        experience_met(F.col("total_experience_years"), F.col("required_years")).alias("experience_met"),
        F.size("matched_skills").cast("long").alias("n_matched"), F.col("n_required").cast("long").alias("n_required"), F.array_join("missing_skills", ", ").alias("missing"), *COUNTS,
    )
    return all_pairs(rows) if by_class else rows


def screening_summary(
    profiles: DataFrame, jobs: DataFrame, sections_detected: DataFrame, blocks_classified: DataFrame, skill_totals: DataFrame, pairs: DataFrame | None = None
) -> DataFrame:
    """``summarize`` for profiles, jobs and counts by doc_id."""
    return summarize(summary_facts(profiles, jobs, sections_detected, blocks_classified, skill_totals), pairs)
