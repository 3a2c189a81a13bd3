"""Column functions over text: cleaning, normal forms, tests and extraction.

All are built-in JVM functions. Python's notions of line break, white space
and word character are written out as classes, since Java's differ.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions import dictionaries as d

#: Python's str.splitlines and str.strip. RE2 reads these the same way.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
SPACES = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE = f"[{SPACES}]"
#: The same characters themselves.
SPACE_CHARACTERS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
#: A start or end of the text or a character that is not part of a word.
EDGE_LEFT, EDGE_RIGHT = f"(^|{NOT_WORD})", f"({NOT_WORD}|$)"

EMAIL = rf"[\p{{L}}\p{{N}}_.\-]+@[\p{{L}}\p{{N}}_.\-]+\.{WORD}"
PHONE = rf"({EDGE_LEFT}|{WORD}\+)\p{{Nd}}[\p{{Nd}}{SPACES}().\-]{{7,}}\p{{Nd}}{EDGE_RIGHT}"
_DASH = "(-|–|—|to)"
MONTH_DATE = rf"(?i){EDGE_LEFT}(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*{SPACE}+[0-9]{{4}}{EDGE_RIGHT}"
YEAR_RANGE = rf"(?i){EDGE_LEFT}[0-9]{{4}}{SPACE}*{_DASH}{SPACE}*[0-9]{{4}}{EDGE_RIGHT}"
MONTH_RANGE = rf"(?i){EDGE_LEFT}[0-9]{{1,2}}/[0-9]{{4}}{SPACE}*{_DASH}{SPACE}*[0-9]{{1,2}}/[0-9]{{4}}{EDGE_RIGHT}"
TOKEN = r"[a-zA-Z][a-zA-Z0-9+#.\-]*"
JOB_YEARS = rf"(?i)[0-9]+\+?{SPACE}*years?{SPACE}+of{SPACE}+experience"
YEARS = rf"([0-9]+(\.[0-9]+)?){SPACE}*\+?{SPACE}*years?"
_MONTH = "(" + "|".join(d.MONTHS) + ")"
RANGE = rf"(?i){_MONTH}{SPACE}+(20[0-9]{{2}}){SPACE}+(to|-){SPACE}+{_MONTH}{SPACE}+(20[0-9]{{2}})"
DEGREE_WORDS = "bachelor|master|degree"
EDGE_MARKS = " -–—•|:"


def filled(text: Column) -> Column:
    """Null as the empty text: outputs are never null."""
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def split_lines(text: Column) -> Column:
    """Stripped lines that are not blank, in order."""
    return F.filter(F.transform(F.split(filled(text), LINE_BREAK), strip), lambda line: line != "")


def norm_heading(text: Column) -> Column:
    out = F.lower(strip(filled(text)))
    out = F.replace(out, F.lit("&"), F.lit(" and "))
    out = F.regexp_replace(out, "[:|]", " ")
    out = F.regexp_replace(out, f"{SPACE}+", " ")
    return F.btrim(out, F.lit(EDGE_MARKS))


def clean_heading(normalized: Column) -> Column:
    """A normalised heading without leading numbering and bullets."""
    out = F.regexp_replace(normalized, rf"^[0-9]+[{SPACES}.)\-]+", "")
    return F.regexp_replace(out, rf"^[•*\-]+{SPACE}*", "")


def norm_skill(text: Column) -> Column:
    out = strip(F.lower(filled(text)))
    out = F.replace(F.regexp_replace(out, "[–—]", "-"), F.lit("&"), F.lit(" and "))
    out = F.regexp_replace(out, f"{SPACE}+", " ")
    for mark in ("/", r"\+", "-"):
        out = F.regexp_replace(out, f" ?{mark} ?", mark.replace("\\", ""))
    return F.trim(out)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(filled(text)), F.lit(TOKEN), F.lit(0))


def norm_compare(skills: Column) -> Column:
    """Skills as they are compared for scoring."""
    return F.transform(skills, lambda s: strip(F.lower(s)))


def strip_bullet(line: Column) -> Column:
    return strip(F.ltrim(line, F.lit("- ")))


def preview(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def _any(tests: list[Column]) -> Column:
    return reduce(Column.__or__, tests)


def has_personal_info(text: Column) -> Column:
    """An e-mail address, a phone number or a contact word."""
    low = F.lower(text)
    return filled_test(_any([text.rlike(EMAIL), text.rlike(PHONE), *(F.contains(low, F.lit(w)) for w in d.CONTACT_WORDS)]))


def has_experience_date(text: Column) -> Column:
    return filled_test(_any([text.rlike(p) for p in (MONTH_DATE, YEAR_RANGE, MONTH_RANGE)]))


def filled_test(test: Column) -> Column:
    """A test that is false, not null, for a null text."""
    return F.coalesce(test, F.lit(False))


def looks_like_heading(line: Column) -> Column:
    words = F.filter(F.split(line, f"{SPACE}+"), lambda w: w != "")
    first = lambda w: F.substring(w, 1, 1)
    titled = F.size(F.filter(words, lambda w: first(w).rlike(r"\p{Lu}")))
    shape = (F.length(line) <= 60) & (F.size(words) <= 8) & ~F.endswith(line, F.lit(".")) & (line != "")
    by_title = titled >= F.greatest(F.lit(1), F.floor(F.size(words) / 2))
    return filled_test(shape & (by_title | ((F.upper(line) == line) & line.rlike(r"\p{L}"))))


def term_present(text: Column, term: str) -> Column:
    """The term with no word character right before or after it, in any case."""
    return filled_test(text.rlike(f"(?i){EDGE_LEFT}{quote(term)}{EDGE_RIGHT}"))


def quote(term: str) -> str:
    """A literal for Java and RE2 alike."""
    return re.sub(r"([^\w\s])", r"\\\1", term)


def is_education_line(line: Column) -> Column:
    return F.lower(line).rlike(DEGREE_WORDS)


def is_bullet(line: Column) -> Column:
    return F.startswith(line, F.lit("-"))


def extract_years(text: Column) -> Column:
    """The first ``N years`` as a number, else 0."""
    found = F.regexp_extract(F.lower(filled(text)), YEARS, 1)
    return F.coalesce(found.try_cast("double"), F.lit(0.0))


def experience_ranges(text: Column) -> Column:
    """Array of (sy, sm, ey, em) for each ``Month 20YY to Month 20YY``."""
    part = lambda n: F.regexp_extract_all(filled(text), F.lit(RANGE), F.lit(n))
    zipped = F.arrays_zip(part(1).alias("m1"), part(2).alias("y1"), part(4).alias("m2"), part(5).alias("y2"))
    number = F.create_map(*(x for i, m in enumerate(d.MONTHS) for x in (F.lit(m), F.lit(i + 1))))
    return F.transform(zipped, lambda r: F.struct(
        r["y1"].cast("int").alias("sy"), number[F.lower(r["m1"])].alias("sm"),
        r["y2"].cast("int").alias("ey"), number[F.lower(r["m2"])].alias("em"),
    ))


def experience_months(ranges: Column) -> Column:
    """Months of all ranges, both ends counted; a reversed range adds nothing."""
    months = F.transform(ranges, lambda r: (r["ey"] - r["sy"]) * 12 + (r["em"] - r["sm"]) + 1)
    return F.aggregate(F.filter(months, lambda m: m > 0), F.lit(0), lambda a, m: a + m)


def experience_years(months: Column) -> Column:
    return F.bround(months / F.lit(12.0), 2)


def experience_score(candidate_years: Column, required_years: Column) -> Column:
    return (
        F.when((required_years <= 0) | (candidate_years <= 0), F.lit(0.0))
        .when(candidate_years >= required_years, F.lit(100.0))
        .otherwise(F.bround(candidate_years / required_years * 100, 2))
    )


def education_score(candidate: Column, required: Column) -> Column:
    """0 without education; a degree that is asked for must be met."""
    have, need = F.lower(candidate), F.lower(required)
    master = have.rlike("master|phd")
    return (
        F.when(have == "", 0.0)
        .when(need.contains("bachelor"), F.when(master | have.contains("bachelor"), 100.0).otherwise(0.0))
        .when(need.contains("master"), F.when(master, 100.0).otherwise(0.0))
        .otherwise(100.0)
    )


def overall_score(skill: Column, experience: Column, education: Column) -> Column:
    return F.bround(skill * 0.60 + experience * 0.20 + education * 0.20, 2)
