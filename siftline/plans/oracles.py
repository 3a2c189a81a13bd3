"""DuckDB SQL for the screening queries.

Each query's SQL is a chain of common tables and a final SELECT over them.
Only the tables that a query needs are put in front of it.
"""

from __future__ import annotations

import re

from siftline.functions import dictionaries as d
from siftline.functions import text as t
from siftline.plans.inputs import JOBS_SQL, RESUMES_SQL


def lit(s) -> str:
    return "NULL" if s is None else str(s) if isinstance(s, (int, float)) else "'" + str(s).replace("'", "''") + "'"


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{t.SPACE}+|{t.SPACE}+$', '', 'g')"


def lines(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex(coalesce({x}, ''), '{t.LINE_BREAK}'), lambda l: {strip('l')}), lambda l: l <> '')"


def norm_heading(x: str) -> str:
    out = f"replace(lower({strip(f'coalesce({x}, {lit(str())})')}), '&', ' and ')"
    out = f"regexp_replace({out}, '[:|]', ' ', 'g')"
    return f"trim(regexp_replace({out}, '{t.SPACE}+', ' ', 'g'), '{t.EDGE_MARKS}')"


def cleaned(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^[0-9]+[{t.SPACES}.)\-]+', ''), '^[•*\-]+{t.SPACE}*', '')"


def norm_skill(x: str) -> str:
    out = strip(f"lower(coalesce({x}, ''))")
    out = f"replace(regexp_replace({out}, '[–—]', '-', 'g'), '&', ' and ')"
    out = f"regexp_replace({out}, '{t.SPACE}+', ' ', 'g')"
    for mark in ("/", r"\+", "-"):
        out = f"regexp_replace({out}, ' ?{mark} ?', '{mark[-1]}', 'g')"
    return f"trim({out})"


def rx(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def personal(x: str) -> str:
    words = " OR ".join(f"contains(lower({x}), '{w}')" for w in d.CONTACT_WORDS)
    return f"coalesce({rx(x, t.EMAIL)} OR {rx(x, t.PHONE)} OR {words}, false)"


def dated(x: str) -> str:
    return "coalesce(" + " OR ".join(rx(x, p) for p in (t.MONTH_DATE, t.YEAR_RANGE, t.MONTH_RANGE)) + ", false)"


def heading_like(x: str) -> str:
    words = f"list_filter(string_split_regex({x}, '{t.SPACE}+'), lambda w: w <> '')"
    titled = f"len(list_filter({words}, lambda w: regexp_matches(w, '^\\p{{Lu}}')))"
    return (
        f"coalesce({x} <> '' AND length({x}) <= 60 AND len({words}) <= 8 AND NOT ends_with({x}, '.') AND "
        f"({titled} >= greatest(1, len({words}) // 2) OR (upper({x}) = {x} AND regexp_matches({x}, '\\p{{L}}'))), false)"
    )


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '{t.TOKEN}')"


def span(kind: str, stops: tuple[str, ...]) -> str:
    ends = [f"CASE WHEN {s}_line > {kind}_line THEN {s}_line - 1 ELSE len(l) END" for s in stops]
    end = f"least(len(l), {', '.join(ends)})" if ends else "len(l)"
    return f"CASE WHEN {kind}_line > 0 THEN l[{kind}_line + 1 : {end}] ELSE [] END"


def position(names: tuple[str, ...]) -> str:
    quoted = ", ".join(map(lit, names))
    return f"cast(coalesce(list_max(list_filter(range(1, len(l) + 1), lambda i: lower(l[i]) IN ({quoted}))), 0) AS INTEGER)"


def known(x: str, words: tuple[str, ...], odd: str = "") -> str:
    test = f"contains(lower({x}), lower(w))" + (f" AND NOT (w = 'REST API' AND contains({x}, 'REST APIs'))" if odd else "")
    return f"list_filter([{', '.join(map(lit, words))}], lambda w: {test})"


def first(x: str) -> str:
    return f"coalesce(({x})[1], '')"


ALIASES = [(a, s, i) for i, (s, a) in enumerate((s, a) for s, many in d.SECTION_ALIASES.items() for a in many)]
KEYWORDS = [(k, s, i, 2 if " " in k else 1) for i, (s, ks) in enumerate(d.CONTENT_KEYWORDS.items()) for k in ks]
HEADS = {"skills": ("skills",), "work": ("work history", "experience"), "education": ("education",), "certifications": ("certifications",), "languages": ("languages",)}
STOPS = {"skills": ("work", "education", "certifications", "languages"), "certifications": ("education", "languages"), "education": ("languages",), "work": ("education", "certifications", "languages"), "languages": ()}
_MONTH = "(" + "|".join(d.MONTHS) + ")"
_NUMBER = "CASE lower({}) " + " ".join(f"WHEN '{m}' THEN {i + 1}" for i, m in enumerate(d.MONTHS)) + " END"
_CONF = lambda kind, section: "CASE " + " ".join(f"WHEN {kind} = '{k}' AND {section} = '{s}' THEN {v}" for (k, s), v in d.CONFIDENCE.items() if s) + " " + " ".join(f"WHEN {kind} = '{k}' THEN {v}" for (k, s), v in d.CONFIDENCE.items() if not s) + f" ELSE {d.CONFIDENCE['unknown', '']} END"
RANK = lambda x: "CASE " + " ".join(f"WHEN {x} = '{s}' THEN {i + 1}" for i, s in enumerate(d.SKILL_SECTIONS)) + " ELSE 0 END"


def ranges(x: str) -> str:
    ex = lambda n: f"regexp_extract_all(coalesce({x}, ''), '{t.RANGE}', {n})"
    m = lambda n: f"list_transform({ex(n)}, lambda m: {_NUMBER.format('m')})"
    return f"list_transform(range(1, len({ex(1)}) + 1), lambda i: {{'sy': cast({ex(2)}[i] AS INTEGER), 'sm': {m(1)}[i], 'ey': cast({ex(5)}[i] AS INTEGER), 'em': {m(4)}[i]}})"


def months(r: str) -> str:
    return f"cast(coalesce(list_sum(list_filter(list_transform({r}, lambda q: (q.ey - q.sy) * 12 + (q.em - q.sm) + 1), lambda n: n > 0)), 0) AS INTEGER)"


def years_of(x: str) -> str:
    return f"coalesce(try_cast(regexp_extract(lower(coalesce({x}, '')), '{t.YEARS}', 1) AS DOUBLE), 0.0)"


def experience_score(c: str, r: str) -> str:
    return f"CASE WHEN {r} <= 0 OR {c} <= 0 THEN 0.0 WHEN {c} >= {r} THEN 100.0 ELSE round_even({c} / {r} * 100, 2) END"


def education_score(c: str, r: str) -> str:
    top = f"regexp_matches(lower({c}), 'master|phd')"
    return (
        f"CASE WHEN {c} = '' THEN 0.0 WHEN contains(lower({r}), 'bachelor') THEN CASE WHEN {top} OR contains(lower({c}), 'bachelor') THEN 100.0 ELSE 0.0 END "
        f"WHEN contains(lower({r}), 'master') THEN CASE WHEN {top} THEN 100.0 ELSE 0.0 END ELSE 100.0 END"
    )


#: Common tables, in an order in which each uses only earlier ones.
TABLES: dict[str, str] = {
    "resumes": RESUMES_SQL,
    "jobs": JOBS_SQL,
    "rl": f"SELECT doc_id, text, {lines('text')} AS l FROM resumes",
    "jl": f"SELECT job_id, text, {lines('text')} AS l FROM jobs",
    "dl": f"SELECT doc_id, {lines('text')} AS l FROM documents",
    "rlines": "SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM rl",
    "dlines": "SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM dl",
    "alias": f"SELECT {norm_heading('a')} AS alias_norm, arg_max(s, o) AS section, min(o) AS alias_ord FROM {values(ALIASES)} v(a, s, o) GROUP BY 1",
    "normed": f"SELECT *, {cleaned('norm')} AS cleaned FROM (SELECT *, {norm_heading('line')} AS norm FROM rlines)",
    "affix": "SELECT doc_id, line_no, arg_min(section, alias_ord) AS affix_section FROM normed JOIN alias ON starts_with(cleaned, alias_norm || ' ') OR ends_with(cleaned, ' ' || alias_norm) GROUP BY 1, 2",
    "found": "SELECT n.doc_id, n.line_no, n.line, n.norm, e.section AS exact_section, c.section AS cleaned_section, affix_section FROM normed n LEFT JOIN alias e ON n.norm = e.alias_norm LEFT JOIN alias c ON n.cleaned = c.alias_norm LEFT JOIN affix a ON n.doc_id = a.doc_id AND n.line_no = a.line_no",
    "headed": "SELECT doc_id, line_no, line, CASE WHEN norm = '' THEN 'other' ELSE coalesce(exact_section, cleaned_section, affix_section, 'other') END AS heading_section, CASE WHEN norm = '' THEN 0.0 WHEN exact_section IS NOT NULL THEN 1.0 WHEN cleaned_section IS NOT NULL THEN 0.98 WHEN affix_section IS NOT NULL THEN 0.9 ELSE 0.0 END AS heading_confidence FROM found",
    "numbered": "SELECT *, sum(CASE WHEN heading_section <> 'other' OR line_no = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS block_id FROM headed",
    "blocks": "SELECT doc_id, cast(block_id AS INTEGER) AS block_id, arg_min(line, line_no) AS first_line, string_agg(line, chr(10) ORDER BY line_no) AS text, array_to_string(list(line ORDER BY line_no)[2:], chr(10)) AS body, arg_min(heading_section, line_no) AS heading_section, cast(arg_min(heading_confidence, line_no) AS DOUBLE) AS heading_confidence, count(*) AS n_lines FROM numbered GROUP BY 1, 2",
    "kw": f"SELECT * FROM {values(KEYWORDS)} v(keyword, section, section_ord, weight)",
    "points": f"SELECT doc_id, block_id, section, section_ord, cast(sum(weight) AS DOUBLE) AS score FROM (SELECT *, list_distinct({tokens('text')}) AS tk, lower(text) AS low FROM blocks) b, kw WHERE CASE WHEN weight = 2 THEN contains(low, keyword) ELSE list_contains(tk, keyword) END GROUP BY ALL".replace("SELECT *, list_distinct", "SELECT doc_id, block_id, text, list_distinct"),
    "content": "SELECT doc_id, block_id, arg_max(section, score * 100 - section_ord) AS content_section, round_even(least(max(score) / 5.0, 1.0), 2) AS content_confidence FROM points GROUP BY 1, 2",
    "judged": f"SELECT b.*, coalesce(content_section, 'other') AS content_section, coalesce(content_confidence, 0.0) AS sure, CASE WHEN block_id = 1 AND {personal('text')} THEN 'personal-info' WHEN heading_section <> 'other' THEN 'rule-based' WHEN {dated('text')} THEN 'date-pattern' WHEN coalesce(content_confidence, 0) >= 0.4 THEN 'nlp-fallback' ELSE 'context' END AS method FROM blocks b LEFT JOIN content USING (doc_id, block_id)",
    "classified": "SELECT doc_id, block_id, text, body, CASE method WHEN 'personal-info' THEN 'personal_information' WHEN 'rule-based' THEN heading_section WHEN 'date-pattern' THEN 'work_experience' WHEN 'nlp-fallback' THEN content_section ELSE 'other' END AS section, method, cast(CASE method WHEN 'personal-info' THEN 0.95 WHEN 'rule-based' THEN heading_confidence WHEN 'date-pattern' THEN 0.95 WHEN 'nlp-fallback' THEN sure ELSE 0.6 END AS DOUBLE) AS confidence FROM judged",
    "sections": "SELECT doc_id, section, cast(row_number() OVER (PARTITION BY doc_id, section ORDER BY block_id) AS INTEGER) AS seq, content FROM (SELECT *, CASE WHEN method = 'rule-based' THEN body ELSE text END AS content FROM classified) WHERE content <> ''",
    "master": f"SELECT * FROM {values([(s, c) for c, many in d.MASTER_SKILLS.items() for s in many])} v(canonical, category)",
    "syn": f"SELECT * FROM {values(d.SYNONYMS.items())} v(synonym, canonical)",
    "stacks": f"SELECT * FROM {values([(s, i, c, j) for i, (s, cs) in enumerate(d.SKILL_STACKS.items()) for j, c in enumerate(cs)])} v(stack, stack_ord, component, pos)",
    "lookup": f"SELECT term, arg_max(canonical, rank) AS canonical FROM (SELECT {norm_skill('canonical')} AS term, canonical, 0 AS rank FROM master UNION ALL SELECT {norm_skill('synonym')}, canonical, 1 FROM syn) GROUP BY term",
    "terms": f"SELECT coalesce(k.term, s.term) AS term, CASE WHEN s.stack IS NULL THEN canonical END AS canonical, stack, stack_ord, length(coalesce(k.term, s.term)) AS n_chars FROM lookup k FULL OUTER JOIN (SELECT DISTINCT {norm_skill('stack')} AS term, stack, stack_ord FROM stacks) s ON k.term = s.term",
    "stexts": f"SELECT doc_id, section, {norm_skill(chr(120))} AS nt FROM (SELECT doc_id, section, string_agg(content, chr(10) ORDER BY seq) AS x FROM sections WHERE section IN ({', '.join(map(lit, d.SKILL_SECTIONS))}) GROUP BY 1, 2)",
    "near": "SELECT doc_id, section, nt, term, canonical, stack, stack_ord FROM stexts JOIN terms ON contains(nt, term)",
    "met": rf"SELECT * FROM near WHERE regexp_matches(nt, '{t.EDGE_LEFT}' || regexp_replace(term, '([^\w\s])', '\\\1', 'g') || '{t.EDGE_RIGHT}')",
    "mentions": f"SELECT doc_id, coalesce(stack, m.canonical) AS name, coalesce(stack, m.canonical) AS canonical, CASE WHEN stack IS NOT NULL THEN 'stack' ELSE coalesce(category, 'other') END AS category, source, section, cast({_CONF('source', 'section')} AS DOUBLE) AS confidence, stack_ord FROM (SELECT *, CASE WHEN stack IS NOT NULL THEN 'skill_stack' WHEN term = {norm_skill('canonical')} THEN 'canonical' ELSE 'synonym' END AS source FROM met) m LEFT JOIN master ON m.canonical = master.canonical",
    "expanded": "SELECT doc_id, name, canonical, category, source, section, confidence, -1 AS seq_ord FROM mentions UNION ALL SELECT doc_id, component, component, coalesce(ms.category, 'other'), 'derived_from_' || m.canonical, section, cast(0.84 AS DOUBLE), s.stack_ord FROM mentions m JOIN stacks s ON m.canonical = s.stack AND m.source = 'skill_stack' LEFT JOIN master ms ON s.component = ms.canonical",
    "extracted": f"SELECT doc_id, name, canonical, category, confidence, source, section FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, canonical ORDER BY confidence DESC, {RANK('section')}, seq_ord, source) AS nth FROM expanded) WHERE nth = 1",
    "places": f"SELECT doc_id, text, l, {', '.join(f'{position(n)} AS {k}_line' for k, n in HEADS.items())} FROM rl",
    "profiles": f"SELECT doc_id, {first('l')} AS name, {span('skills', STOPS['skills'])} AS own, {known('''array_to_string(l, ' ')''', d.RESUME_KEYWORDS, 'odd')} AS detected, array_to_string({span('work', STOPS['work'])}, ' ') AS experience, array_to_string({span('education', STOPS['education'])}, ' ') AS education, {span('certifications', STOPS['certifications'])} AS certifications, {span('languages', ())} AS languages FROM places",
    "profile": "SELECT doc_id, name, list_filter(list_concat(own, detected), lambda x, i: list_position(list_concat(own, detected), x) = i) AS skills, experience, education, certifications, languages FROM profiles",
    "jparsed": f"SELECT job_id, {first('l')} AS role, {known('text', d.JOB_KEYWORDS)} AS required_skills, regexp_extract({first(f'''list_filter(l, lambda x: regexp_matches(x, '{t.JOB_YEARS}'))''')}, '{t.JOB_YEARS}') AS experience, {first(f'''list_filter(l, lambda x: regexp_matches(lower(x), '{t.DEGREE_WORDS}'))''')} AS education, l FROM jl",
    "jlines": "SELECT job_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM jl",
    "jstart": "SELECT job_id, min(line_no) AS a FROM jlines WHERE contains(lower(line), 'responsibilities') GROUP BY 1",
    "jstop": "SELECT j.job_id, min(line_no) AS b FROM jlines j JOIN jstart USING (job_id) WHERE line_no > a AND starts_with(lower(line), 'requirements') AND NOT contains(lower(line), 'responsibilities') GROUP BY 1",
    "jresp": f"SELECT j.job_id, list({strip('''ltrim(line, '- ')''')} ORDER BY line_no) AS responsibilities FROM jlines j JOIN jstart USING (job_id) LEFT JOIN jstop USING (job_id) WHERE line_no > a AND (b IS NULL OR line_no < b) AND starts_with(line, '-') AND NOT contains(lower(line), 'responsibilities') GROUP BY 1",
    "job": "SELECT p.job_id, role, required_skills, experience, education, coalesce(responsibilities, []) AS responsibilities FROM jparsed p LEFT JOIN jresp USING (job_id)",
    "raw": f"SELECT p.doc_id, pos, raw, {norm_skill('raw')} AS term, k.canonical AS known FROM (SELECT doc_id, unnest(range(1, len(skills) + 1)) AS pos, unnest(skills) AS raw FROM profile) p LEFT JOIN lookup k ON {norm_skill('raw')} = k.term WHERE raw <> ''",
    "keyed": f"SELECT *, coalesce(known, {strip('raw')}) AS canonical, lower(coalesce(known, term)) AS key, lower(coalesce(known, {strip('raw')})) AS low FROM raw",
    "fresh": "SELECT k.* FROM keyed k WHERE NOT EXISTS (SELECT 1 FROM keyed e WHERE e.doc_id = k.doc_id AND e.pos < k.pos AND e.low = k.key) AND NOT EXISTS (SELECT 1 FROM extracted x WHERE x.doc_id = k.doc_id AND lower(x.canonical) = k.key)",
    "pool": "SELECT doc_id, name, canonical, category, confidence, source, section, -1 AS seq_ord FROM extracted UNION ALL SELECT doc_id, f.canonical, f.canonical, CASE WHEN known IS NULL THEN 'other' ELSE coalesce(category, 'other') END, CASE WHEN known IS NULL THEN 0.7 ELSE 0.8 END, 'candidate_profile', 'candidate_profile', pos FROM fresh f LEFT JOIN master m ON f.canonical = m.canonical",
    "unified": f"SELECT doc_id, name, canonical, category, cast(confidence AS DOUBLE) AS confidence, source, section FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, canonical ORDER BY confidence DESC, {RANK('section')}, seq_ord, source) AS nth FROM pool) WHERE nth = 1",
    "replaced": "SELECT p.doc_id, p.name, p.experience, p.education, p.certifications, p.languages, coalesce(u.skills, []) AS skills FROM profile p LEFT JOIN (SELECT doc_id, list(canonical ORDER BY lower(canonical), canonical) AS skills FROM unified GROUP BY 1) u USING (doc_id)",
    "cand": f"SELECT doc_id AS candidate_id, list_transform(skills, lambda s: lower(trim(s))) AS have, {months(ranges('experience'))} AS months, education FROM replaced",
    "cand2": "SELECT *, round_even(months / 12.0, 2) AS years FROM cand",
    "need": f"SELECT job_id, required_skills, list_transform(required_skills, lambda s: lower(trim(s))) AS need, {years_of('experience')} AS required_years, education AS required_education FROM job",
    "pairs": "SELECT *, list_filter(required_skills, lambda s: list_contains(have, lower(trim(s)))) AS matched_skills, list_filter(required_skills, lambda s: NOT list_contains(have, lower(trim(s)))) AS missing_skills FROM cand2 CROSS JOIN need",
    "scored": f"SELECT *, CASE WHEN len(need) = 0 THEN 0.0 ELSE round_even(len(matched_skills) / len(need) * 100, 2) END AS skill_score, {experience_score('years', 'required_years')} AS experience_score, {education_score('education', 'required_education')} AS education_score FROM pairs",
    "report": "SELECT candidate_id, job_id, matched_skills, missing_skills, cast(round_even(skill_score * 0.60::DOUBLE + experience_score * 0.20::DOUBLE + education_score * 0.20::DOUBLE, 2) AS DOUBLE) AS overall_score, cast(skill_score AS DOUBLE) AS skill_score, cast(experience_score AS DOUBLE) AS experience_score, cast(education_score AS DOUBLE) AS education_score, cast(years AS DOUBLE) AS total_experience_years, required_years, need FROM scored",
}


def chain(select: str) -> str:
    """The SELECT with the tables that it needs, in order."""
    needed: set[str] = set()
    waiting = [select]
    while waiting:
        found = {w for w in re.findall(r"\w+", waiting.pop()) if w in TABLES} - needed
        needed |= found
        waiting.extend(TABLES[n] for n in found)
    ordered = [n for n in TABLES if n in needed]
    if not ordered:
        return select
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({TABLES[n]})" for n in ordered) + "\n" + select
