"""Resumes to candidate profiles, and job descriptions to requirements.

Both work on the array of a document's clean lines, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import dictionaries as d
from siftline.functions.text import JOB_YEARS, filled, is_bullet, is_education_line, split_lines, strip_bullet

#: Kinds of profile headings and the whole lines, lower-cased, that stand for them.
HEADINGS = {
    "skills": ("skills",), "work": ("work history", "experience"), "education": ("education",), "certifications": ("certifications",),
    "languages": ("languages",),
}
#: The later headings that end the lines after a heading.
STOPS = {
    "skills": ("work", "education", "certifications", "languages"), "certifications": ("education", "languages"), "education": ("languages",),
    "work": ("education", "certifications", "languages"), "languages": (),
}


def _with_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(id_col, filled(F.col(text_col)).alias("text"), split_lines(F.col(text_col)).alias("lines"))


def _last(lines: Column, names: tuple[str, ...]) -> Column:
    """Place (from 1) of the last line that is one of the names, else 0."""
    low = F.reverse(F.transform(lines, F.lower))
    first = F.array_min(F.array_compact(F.array(*(F.nullif(F.array_position(low, n), F.lit(0)) for n in names))))
    return F.coalesce(F.size(lines) - first + 1, F.lit(0)).cast("int")


def heading_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Line number of the last line that is each heading; 0 without one."""
    rows = _with_lines(docs, id_col, text_col)
    return rows.select(id_col, *(_last(F.col("lines"), names).alias(f"{k}_line") for k, names in HEADINGS.items()))


def _positions(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"{k}_line": _last(F.col("lines"), names) for k, names in HEADINGS.items()})


def _span(kind: str) -> Column:
    """Lines after a heading up to the nearest later one that ends it."""
    at = F.col(f"{kind}_line")
    ends = [F.when(F.col(f"{s}_line") > at, F.col(f"{s}_line") - 1).otherwise(F.size("lines")) for s in STOPS[kind]]
    end = F.least(F.size("lines"), *ends) if ends else F.size("lines")
    return F.when(at > 0, F.slice("lines", at + 1, F.greatest(F.lit(0), end - at))).otherwise(F.array().cast("array<string>"))


def span(docs: DataFrame, kind: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lines)`` of one kind of profile section."""
    return _positions(_with_lines(docs, id_col, text_col)).select(id_col, _span(kind).alias("lines"))


def detect_known_skills(text: Column) -> Column:
    """Resume keywords that are part of the joined text, in any case."""
    low = F.lower(text)
    test = lambda k: F.contains(low, F.lit(k.lower())) & (~F.contains(text, F.lit("REST APIs")) if k == "REST API" else F.lit(True))
    return F.array_compact(F.array(*(F.when(test(k), F.lit(k)) for k in d.RESUME_KEYWORDS)))


def detect_required_skills(text: Column) -> Column:
    """Job keywords that are part of the raw text, in any case."""
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(F.contains(low, F.lit(k.lower())), F.lit(k)) for k in d.JOB_KEYWORDS)))


def first_line(lines: Column) -> Column:
    return F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))


def parse_resume(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, name, skills, experience, education, certifications, languages;
    what is missing is empty, never null."""
    rows = _positions(_with_lines(docs, id_col, text_col))
    known = detect_known_skills(F.array_join("lines", " "))
    return rows.select(
        id_col, first_line(F.col("lines")).alias("name"), F.array_distinct(F.concat(_span("skills"), known)).alias("skills"),
        F.array_join(_span("work"), " ").alias("experience"), F.array_join(_span("education"), " ").alias("education"),
        _span("certifications").alias("certifications"), _span("languages").alias("languages"),
    )


def _first(lines: Column, test) -> Column:
    return first_line(F.filter(lines, test))


def job_experience(lines: Column) -> Column:
    """The first ``N years of experience`` phrase."""
    return F.regexp_extract(_first(lines, lambda line: line.rlike(JOB_YEARS)), f"({JOB_YEARS})", 1)


def job_education(lines: Column) -> Column:
    """The first line that names a degree, bullet kept."""
    return _first(lines, is_education_line)


def job_responsibilities(lines: Column) -> Column:
    """Bullets from the first line that holds ``responsibilities`` to the next
    that begins with ``requirements``; a line that holds the word is no bullet."""
    titles = F.transform(lines, lambda x: F.contains(F.lower(x), F.lit("responsibilities")))
    start = F.array_position(titles, True).cast("int")
    after = F.when(start > 0, F.slice(lines, start + 1, F.size(lines))).otherwise(F.array().cast("array<string>"))
    own = lambda x: F.contains(F.lower(x), F.lit("responsibilities"))
    stop = F.array_position(F.transform(after, lambda x: F.startswith(F.lower(x), F.lit("requirements")) & ~own(x)), True).cast("int")
    inside = F.when(stop > 0, F.slice(after, F.lit(1), stop - 1)).otherwise(after)
    return F.transform(F.filter(inside, lambda x: is_bullet(x) & ~own(x)), strip_bullet)


def parse_job(jobs: DataFrame, id_col: str = "job_id", text_col: str = "text") -> DataFrame:
    """job_id, role, required_skills, experience, education, responsibilities."""
    rows = _with_lines(jobs, id_col, text_col)
    lines = F.col("lines")
    return rows.select(
        id_col, first_line(lines).alias("role"), detect_required_skills(F.col("text")).alias("required_skills"),
        job_experience(lines).alias("experience"), job_education(lines).alias("education"), job_responsibilities(lines).alias("responsibilities"),
    )
