"""Screening of resumes as they arrive.

Profiles and scores need nothing but the resume and the jobs, so a stream of
resumes is scored with the batch operators, row by row and without state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from siftline.operators.profiles import parse_resume
from siftline.operators.scoring import score_report


def score_stream(resumes: DataFrame, job_requirements: DataFrame) -> DataFrame:
    """Scores of a streaming ``(doc_id, text)`` against a table of parsed jobs."""
    return score_report(parse_resume(resumes), job_requirements)
