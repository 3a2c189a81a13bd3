"""Candidate and job scores.

What scores need of each side is worked out once for each candidate and once
for each job, and is numbers: skills that any job asks for are bits of a few
longs, degrees are bits of an int. A pair then costs a few integer operations
and roundings; lists of names are read off the bits on output only. All pairs are
made by classes: who differs in nothing that is asked for is scored once, and rows
of ids come last. Ranking makes no pairs of candidates and jobs: it bounds what a set of skills can reach.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.text import experience_months, experience_ranges, experience_score, experience_years, extract_years, filled, norm_compare, overall_score
from siftline.operators.order import global_rank
from siftline.shared import stored

#: Pairs that a task makes, about.
TASK_PAIRS = 8_000_000
#: Candidates, and jobs, of a tile, and ids of a class that are kept together: two to the power of so
#: many bits. Few ids that repeat soon are what a file's dictionary and codec hold well.
TILE_BITS, IDS_BITS = 11, 7
#: Bits of the degrees that an education names, and of any education at all.
DEGREES = {"bachelor": 1, "master": 2, "phd": 4}
SOME_EDUCATION = 8
_WORD = 64


def candidate_facts(profiles: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """candidate_id, have (distinct compared skills), months, years, education."""
    months = experience_months(experience_ranges(F.col("experience")))
    rows = profiles.select(F.col(id_col).alias("candidate_id"), F.array_distinct(norm_compare(F.col("skills"))).alias("have"), months.alias("months"), F.col("education"))
    return rows.select("candidate_id", "have", "months", experience_years(F.col("months")).alias("years"), "education")


def job_facts(jobs: DataFrame, id_col: str = "job_id") -> DataFrame:
    """job_id, required_skills, need (the same as compared), required_years, required_education."""
    return jobs.select(
        F.col(id_col).alias("job_id"), "required_skills", norm_compare(F.col("required_skills")).alias("need"),
        extract_years(F.col("experience")).alias("required_years"), F.col("education").alias("required_education"),
    )


def degree_bits(education: Column) -> Column:
    """Which degrees an education names."""
    low = F.lower(filled(education))
    named = (F.when(low.contains(word), bit).otherwise(0) for word, bit in DEGREES.items())
    return reduce(Column.__add__, named, F.when(low != "", SOME_EDUCATION).otherwise(0))


def accepted_degrees(required: Column) -> Column:
    """Bits of which one has to be there: of the degree asked for and those above it, or of any education."""
    low, every = F.lower(filled(required)), sum(DEGREES.values())
    return F.when(low.contains("bachelor"), every).when(low.contains("master"), every - DEGREES["bachelor"]).otherwise(SOME_EDUCATION)


def degree_score(degrees: Column, accepted: Column) -> Column:
    """What ``education_score`` gives, from bits."""
    return F.when(degrees.bitwiseAND(accepted) != 0, 100.0).otherwise(0.0)


@dataclass(frozen=True)
class Facts:
    """Both sides as stored tables of numbers.

    ``candidates``: candidate_id, years, degrees, have_0, ... (bits of skills),
    and what else was kept. ``jobs``: job_id, required_skills, places (the bit
    of each), n_required, repeats (a skill is asked for twice), required_years,
    accepted, need_0, ... ``words``: longs of bits."""

    candidates: DataFrame
    jobs: DataFrame
    words: int

    def names(self, kind: str) -> list[str]:
        return [f"{kind}_{k}" for k in range(self.words)]


def _longs(places: Column, words: int, kind: str) -> list[Column]:
    """Longs in which the bits at ``places`` are set."""
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), (p % _WORD).cast("int"))
    word = lambda k: F.aggregate(places, F.lit(0).cast("long"), lambda a, p: F.when(F.floor(p / _WORD) == k, a.bitwiseOR(bit(p))).otherwise(a))
    return [word(k).alias(f"{kind}_{k}") for k in range(words)]


def facts(candidates: DataFrame, jobs: DataFrame) -> Facts:
    """Numbers of both sides, from rows with the columns of ``candidate_facts``
    and ``job_facts``; other columns are kept."""
    asked = stored(jobs, "job-facts")
    skills = asked.select(F.explode("need").alias("skill")).agg(F.array_sort(F.collect_set("skill")).alias("asked"))  # one row: the skills that jobs ask for
    skills = stored(skills, "asked-skills")
    words = max(1, -(-skills.select(F.size("asked")).first()[0] // _WORD))
    row = F.broadcast(skills)
    place = lambda s: F.array_position("asked", s) - 1
    had = candidates.crossJoin(row).withColumn("places", F.transform(F.array_intersect("asked", "have"), place))
    kept = [c for c in candidates.columns if c not in ("candidate_id", "have", "months", "years", "education")]
    had = had.select("candidate_id", "years", degree_bits(F.col("education")).alias("degrees"), *_longs(F.col("places"), words, "have"), *kept)
    needed = asked.crossJoin(row).withColumn("places", F.transform("need", place))
    kept = [c for c in jobs.columns if c not in ("job_id", "required_skills", "need", "required_years", "required_education")]
    needed = needed.select(
        "job_id", "required_skills", "places", F.size("need").alias("n_required"), (F.size("need") > F.size(F.array_distinct("need"))).alias("repeats"),
        "required_years", accepted_degrees(F.col("required_education")).alias("accepted"), *_longs(F.col("places"), words, "need"), *kept,
    )
    # A stream of candidates is scored as it comes.
    return Facts(had if had.isStreaming else stored(had, "candidate-numbers"), stored(needed, "job-numbers"), words)


def _in_parts(rows: DataFrame, id_col: str, part: str, bits: int, on: str | None) -> DataFrame:
    """Rows in the order of all but their ids, in parts of two to the power of
    ``bits``: one row for each class in a part, or some, with the ids of who is in it."""
    rows = rows if on else rows.withColumn("__on", F.lit(0))
    key = [on or "__on", *(c for c in rows.columns if c not in (id_col, on or "__on"))]
    dealt = rows.repartitionByRange(*key, id_col).sortWithinPartitions(*key, id_col)
    # The number of the range lies above the low 33 bits, so parts never reach over two.
    cut = lambda n: F.call_function("shiftright", "__place", F.lit(n))
    dealt = dealt.withColumn("__place", F.monotonically_increasing_id()).withColumns({part: cut(bits), "__some": cut(min(bits, IDS_BITS))})
    ids = F.transform(F.collect_list(F.struct(id_col)), lambda x: x[id_col])  # a plain list leaves nulls out
    return stored(dealt.groupBy(*key, part, "__some").agg(ids.alias(id_col)).drop("__some"), part.strip("_"))


def tiles(candidates: DataFrame, jobs: DataFrame, on: str | None = None) -> DataFrame:
    """All with all, or all that have the same in the column ``on``, by classes:
    a row has what a class of candidates and a class of jobs have in common, and in
    candidate_id and job_id the ids of all who are in them. Classes are those of all columns, so others than
    are needed should be left out before. Both sides are cut into parts and every
    part of one meets every part of the other, so no row and no task grows with the input.
    What is shuffled are ids, once for each part of the other side, and not pairs. Both sides are read for
    their sizes and should be stored."""
    context, key = candidates.sparkSession.sparkContext, on or "__on"
    # Small inputs are cut finer, so that all cores have some.
    bits = max(0, min(TILE_BITS, (candidates.count() // (4 * context.defaultParallelism)).bit_length() - 1))
    candidates, jobs = _in_parts(candidates, "candidate_id", "__candidates", bits, on), _in_parts(jobs, "job_id", "__jobs", TILE_BITS, on)
    side = lambda rows, id_col, part: rows.groupBy(key).agg(F.collect_set(part).alias(f"{part}_all"), F.sum(F.size(id_col)).alias(f"{part}_n"))
    sides = stored(side(candidates, "candidate_id", "__candidates").join(side(jobs, "job_id", "__jobs"), key), "sides")
    n = sides.agg(F.coalesce(F.sum(F.col("__candidates_n") * F.col("__jobs_n")), F.lit(0))).first()[0]
    tasks = max(4 * context.defaultParallelism, -(-n // TASK_PAIRS))

    def dealt(rows: DataFrame, other: str) -> DataFrame:
        parts = sides.select(key, F.col(f"{other}_all").alias(other))
        return rows.join(parts if on else F.broadcast(parts), key).withColumn(other, F.explode(other))  # without ``on`` it is one row

    tile = [key, "__candidates", "__jobs"]
    # Few bytes make many pairs, so neither side is to be broadcast to the few tasks of the other. A class
    # of jobs meets all candidates of the tile in turn, so its ids repeat from the first to the last.
    met = dealt(jobs, "__candidates").repartition(tasks, *tile).join(dealt(candidates, "__jobs").hint("merge"), tile)
    return met.select(*dict.fromkeys(c for c in (*candidates.columns, *jobs.columns) if not c.startswith("__")))


def all_pairs(rows: DataFrame) -> DataFrame:
    """The pairs of all ids in rows of ``tiles``."""
    return rows.withColumn("candidate_id", F.explode("candidate_id")).withColumn("job_id", F.explode("job_id"))


def pair_candidates_jobs(candidates: DataFrame, jobs: DataFrame, pairs: DataFrame | None = None, on: str | None = None) -> DataFrame:
    """Every candidate with every job, or the ``(candidate_id, job_id)`` of
    ``pairs``, or all that have the same in the column ``on``; all but given pairs
    are made as ``tiles`` and never shuffled. All with all is what this operator is asked for: its output is
    the product. If an executor is lost, its tasks' tiles are paired again."""
    if pairs is not None:
        return pairs.join(candidates, "candidate_id").join(jobs, "job_id")
    if candidates.isStreaming:
        return candidates.join(jobs, how="cross")
    return all_pairs(tiles(candidates, jobs, on))


@dataclass(frozen=True)
class Classes:
    """Candidates, and jobs, that differ in nothing but their ids. ``known`` has
    one row for each class, with the class's number as id. ``candidates`` is
    (candidate_id, candidate_class) and ``jobs`` (job_id, job_class), of all rows."""

    known: Facts
    candidates: DataFrame
    jobs: DataFrame


def _numbered_classes(rows: DataFrame, id_col: str, name: str) -> tuple[DataFrame, DataFrame]:
    """One row for each class, its number as ``id_col``, and the class of each
    row. Numbers are places in the order of the facts, so each run gives the same."""
    key = [c for c in rows.columns if c != id_col]
    heads = stored(global_rank(rows.select(*key).distinct(), *key, name=name), name)
    alike = reduce(Column.__and__, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key))
    members = stored(rows.alias("a").join(heads.alias("b"), alike).select(id_col, name), f"{name}-members")
    return heads.withColumnRenamed(name, id_col), members


def classes(known: Facts) -> Classes:
    """Both sides by classes: a pair of classes scores as all pairs of their members do."""
    candidates, of_candidates = _numbered_classes(known.candidates, "candidate_id", "candidate_class")
    jobs, of_jobs = _numbered_classes(known.jobs, "job_id", "job_class")
    return Classes(Facts(candidates, jobs, known.words), of_candidates, of_jobs)


def by_class(report: DataFrame) -> DataFrame:
    """A report of ``Classes.known``, whose ids are numbers of classes, called so."""
    return report.withColumnsRenamed({"candidate_id": "candidate_class", "job_id": "job_class"})


def all_members(report: DataFrame, candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """All pairs of candidates and jobs, from a report by class and who is in each class."""
    return report.join(candidates, "candidate_class").join(jobs, "job_class").drop("candidate_class", "job_class")


def skill_score(n_matched: Column, n_required: Column) -> Column:
    return F.when(n_required == 0, 0.0).otherwise(F.bround(n_matched / n_required * 100, 2))


def _common(words: int) -> list[Column]:
    return [F.col(f"have_{k}").bitwiseAND(F.col(f"need_{k}")) for k in range(words)]


def _count(longs: list[Column]) -> Column:
    return reduce(Column.__add__, map(F.bit_count, longs))


def with_lists(pairs: DataFrame, words: int) -> DataFrame:
    """Add matched_skills and missing_skills: required skills in order, as they are spelt."""
    both = pairs.withColumns({f"met_{k}": c for k, c in enumerate(_common(words))})
    met = F.col("met_0") if words == 1 else F.array(*(F.col(f"met_{k}") for k in range(words)))

    def is_met(place: Column) -> Column:
        long = met if words == 1 else F.get(met, F.floor(place / _WORD).cast("int"))
        return F.call_function("getbit", long, (place % _WORD).cast("int")) == 1

    at = lambda i: F.get("places", i)
    lists = {"matched_skills": F.filter("required_skills", lambda _, i: is_met(at(i))), "missing_skills": F.filter("required_skills", lambda _, i: ~is_met(at(i)))}
    return both.withColumns(lists).drop(*(f"met_{k}" for k in range(words)))


def with_n_matched(pairs: DataFrame, words: int) -> DataFrame:
    """Add n_matched: how many entries of the required skills are met."""
    repeated = F.size("matched_skills") if "matched_skills" in pairs.columns else F.size(F.filter("places", lambda p: reduce(
        Column.__or__, ((F.floor(p / _WORD) == k) & (F.call_function("getbit", c, (p % _WORD).cast("int")) == 1) for k, c in enumerate(_common(words)))
    )))
    return pairs.withColumn("n_matched", F.when(F.col("repeats"), repeated).otherwise(_count(_common(words))))


#: Columns of a report, besides ids and what is kept of the facts.
LISTS = ("matched_skills", "missing_skills")
SCORES = ("overall_score", "skill_score", "experience_score", "education_score", "total_experience_years")


def _takes(known: Facts, columns: tuple[str, ...]) -> set[str]:
    """The facts that columns of a report are made of."""
    bits = {*known.names("have"), *known.names("need"), "places"}
    of = {
        "skill_score": {*bits, "repeats", "n_required"}, "experience_score": {"years", "required_years"}, "education_score": {"degrees", "accepted"},
        "total_experience_years": {"years"}, **dict.fromkeys(LISTS, {*bits, "required_skills"}),
    }
    of["overall_score"] = of["skill_score"] | of["experience_score"] | of["education_score"]
    return set().union(*(of.get(c, {c}) for c in columns))


def _with_columns(rows: DataFrame, words: int, columns: tuple[str, ...]) -> DataFrame:
    """The ids and the columns of a report; of the others only what these are made of is worked out."""
    scored = {c for c in SCORES if c in columns or "overall_score" in columns}
    out = with_lists(rows, words) if {*LISTS} & {*columns} else rows
    out = with_n_matched(out, words) if "skill_score" in scored else out
    own = {
        "skill_score": lambda: skill_score(F.col("n_matched"), F.col("n_required")), "experience_score": lambda: experience_score(F.col("years"), F.col("required_years")),
        "education_score": lambda: degree_score(F.col("degrees"), F.col("accepted")), "total_experience_years": lambda: F.col("years"),
    }
    out = out.withColumns({c: make() for c, make in own.items() if c in scored})
    if "overall_score" in scored:
        out = out.withColumn("overall_score", overall_score(F.col("skill_score"), F.col("experience_score"), F.col("education_score")))
    return out.select("candidate_id", "job_id", *columns)


def class_report(known: Facts, *columns: str, on: str | None = None) -> DataFrame:
    """Columns of a report, or facts, by classes of what they are made of, as
    ``tiles`` has them; ``all_pairs`` makes the report of it. What is worked out
    of the columns in between is worked out once for each pair of classes."""
    facts_of = _takes(known, columns)
    own = lambda rows, id_col: rows.select(id_col, *((on,) if on else ()), *(c for c in rows.columns if c in facts_of and c != on))
    return _with_columns(tiles(own(known.candidates, "candidate_id"), own(known.jobs, "job_id"), on), known.words, columns)


def score_report(profiles: DataFrame, jobs: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One row per pair: candidate_id, job_id, five scores, matched_skills, missing_skills."""
    return score_pairs(facts(candidate_facts(profiles), job_facts(jobs)), pairs)


def score_pairs(known: Facts, pairs: DataFrame | None = None, *keep: str, lists: bool = True, on: str | None = None) -> DataFrame:
    """The report of paired facts, with the columns ``keep`` of theirs. Without
    ``lists`` no skills are spelt, only counted."""
    columns = (*(LISTS if lists else ()), *keep, *SCORES)
    if pairs is None and not known.candidates.isStreaming:
        return all_pairs(class_report(known, *columns, on=on))
    return _with_columns(pair_candidates_jobs(known.candidates, known.jobs, pairs), known.words, columns)


def _best(rows: DataFrame, k: int, by: list[str], *order) -> DataFrame:
    """The first ``k`` of each group, with their place as nth."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= k)


def _lowest(longs: list[Column]) -> Column:
    """The number of the lowest bit that is set, null for none."""
    top = F.lit(-(1 << 63))  # has no negative
    below = lambda c: F.when(c == top, 63).otherwise(F.bit_count(c.bitwiseAND(-c) - 1))
    return F.coalesce(*(F.when(c != 0, below(c) + k * _WORD) for k, c in enumerate(longs)))


def _skills(rows: DataFrame, kind: str, words: int) -> DataFrame:
    """One row for each bit that is set, as skill."""

    def found(k: int) -> Column:
        places = F.sequence(F.lit(k * _WORD), F.lit((k + 1) * _WORD - 1))
        return F.filter(places, lambda p: F.call_function("getbit", F.col(f"{kind}_{k}"), (p % _WORD).cast("int")) == 1)

    return rows.withColumn("skill", F.explode(F.concat(*map(found, range(words)))))


#: Scores that round to one overall score have experience scores no further apart.
_PLATEAU = 0.1


@dataclass(frozen=True)
class Ranking:
    """What a ranking looks at. ``kinds``: jobs that ask for the same, once.
    ``groups``: of each kind, the groups of candidates that may hold one of the
    best. ``members``: of all groups. ``rest``: the best by years and degrees alone."""

    kinds: DataFrame
    groups: DataFrame
    members: DataFrame
    rest: DataFrame


def _plateau(rows: DataFrame, k: int, group: list[str]) -> DataFrame:
    """The candidates who can be among the ``k`` best of a group by overall
    score and id, whatever else adds to the score: for each experience score
    the k smallest ids, down to what rounding may draw level with the k-th. Adds top, the best of the scores."""
    few = stored(_best(rows, k, [*group, "exp"], "candidate_id").drop("nth"), "few")
    enough = _best(few, k, group, F.desc("exp"), "candidate_id").groupBy(*group).agg(F.min("exp").alias("last"), F.max("exp").alias("top"))
    return few.join(enough, group).filter(F.col("exp") >= F.col("last") - _PLATEAU).drop("last")


def _overall(exp: str) -> Column:
    return overall_score(skill_score(F.col("n_matched"), F.col("n_required")), F.col(exp), F.col("degree_score"))


def _reached(kinds: DataFrame, members: DataFrame, words: int, k: int) -> DataFrame:
    """``(kind, reach)``: an overall score that ``k`` candidates reach, found
    among those who come first in the lists of the kind's skills."""
    first = _best(_skills(members, "have", words), k, ["ask", "skill", "degree_score"], F.desc("exp"), "candidate_id").drop("nth")
    met = with_n_matched(_skills(kinds, "need", words).join(first, ["ask", "skill"]), words)
    met = met.select("kind", "candidate_id", _overall("exp").alias("overall")).distinct()
    best = _best(met, k, ["kind"], F.desc("overall"), "candidate_id")
    return best.groupBy("kind").agg(F.count("*").alias("n"), F.min("overall").alias("reach")).filter(F.col("n") == k).drop("n")


def _searched(kinds: DataFrame, heads: DataFrame, words: int) -> DataFrame:
    """Kinds with the skills, as bits look_0, ..., under which they look for
    groups. Who meets fewer than ``least`` skills cannot reach the threshold with
    all years and degrees, and whoever meets as many has one of any ``n - least +
    1`` of the skills: those that the fewest groups have are taken."""
    full = 20.0 + 20.0 + 0.02  # years, degree, rounding
    least = F.ceil((F.col("reach") - full) / 60.0 * F.col("n_required") - 1e-6).cast("int")
    least = F.when(F.col("repeats") | F.col("reach").isNull(), 1).otherwise(F.least(F.greatest(F.lit(1), least), F.col("n_required")))
    lists = _skills(heads, "have", words).groupBy("ask", "skill").agg(F.count("*").alias("in_groups"))
    all_ = _skills(kinds.withColumn("least", least), "need", words).join(lists, ["ask", "skill"], "left")
    nth = F.row_number().over(Window.partitionBy("kind").orderBy(F.coalesce("in_groups", F.lit(0)), "skill"))
    size = F.count("*").over(Window.partitionBy("kind"))
    kept = all_.withColumns({"nth": nth, "size": size}).filter(F.col("nth") <= F.col("size") - F.col("least") + 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("skill") % _WORD).cast("int"))
    bits = [F.coalesce(F.bit_or(F.when(F.floor(F.col("skill") / _WORD) == w, bit)), F.lit(0).cast("long")).alias(f"look_{w}") for w in range(words)]
    return kinds.join(kept.groupBy("kind").agg(*bits), "kind")


def ranking(known: Facts, k: int) -> Ranking:
    """What has to be looked at for the ``k`` best of each kind of job.

    Under the years and degrees that a kind asks for, candidates with the same
    skills and degree score are a group, which its best member bounds. A group is
    left as soon as k candidates are known to come before its best: by a
    threshold from the lists of single skills first, then by the first members of
    the other groups. Years, degrees and skills of the corpus decide how many
    groups there are, not the number of candidates.
    """
    words, have, ask = known.words, known.names("have"), ["required_years", "accepted"]
    kinds = known.jobs.select(F.array_sort("places").alias("places"), "repeats", *known.names("need"), "n_required", *ask).distinct()
    kinds = stored(kinds.withColumn("kind", F.monotonically_increasing_id()), "job-kinds")
    asks = stored(kinds.select(*ask).distinct().withColumn("ask", F.monotonically_increasing_id()), "asks")
    kinds, group = kinds.join(F.broadcast(asks), ask), ["ask", *have, "degree_score"]
    alike = _best(known.candidates, k, [*have, "years", "degrees"], "candidate_id").drop("nth")
    under = alike.join(F.broadcast(asks), how="cross").select(
        "ask", *have, "candidate_id", degree_score(F.col("degrees"), F.col("accepted")).alias("degree_score"), experience_score(F.col("years"), F.col("required_years")).alias("exp"),
    )
    members = stored(_plateau(under, k, group), "members")
    # The first member, and the smallest id that rounding may put level with it.
    first, level = F.col("exp") == F.col("top"), F.col("exp") >= F.col("top") - _PLATEAU
    id_where = lambda test: F.min(F.when(test, F.col("candidate_id")))
    heads = stored(members.groupBy(*group).agg(F.max("top").alias("top"), id_where(first).alias("head"), id_where(level).alias("could")), "group-heads")
    kinds = stored(kinds.join(_reached(kinds, members, words, k), "kind", "left"), "kind-thresholds")
    met = _skills(_searched(kinds, heads, words), "look", words).join(_skills(heads, "have", words), ["ask", "skill"])
    shared = [F.col(f"have_{w}").bitwiseAND(F.col(f"look_{w}")) for w in range(words)]
    met = with_n_matched(met.filter(_lowest(shared) == F.col("skill")), words).withColumn("overall", _overall("top"))  # each group once
    met = stored(met.filter("reach IS NULL OR overall >= reach").select("kind", *group, "n_matched", "overall", "head", "could"), "met-groups")
    last = _best(met, k, ["kind"], F.desc("overall"), "head").filter(F.col("nth") == k)
    last = last.select("kind", F.col("overall").alias("last"), F.col("head").alias("last_head"))
    kept = met.join(last, "kind", "left").filter("last IS NULL OR overall > last OR (overall = last AND could <= last_head)")
    rest = _plateau(members.drop("top"), k, ["ask", "degree_score"])
    return Ranking(kinds, kept.select("kind", *group, "n_matched"), members, rest)


def looked_at(known: Facts, found: Ranking) -> DataFrame:
    """kind, candidate_id, overall_score of all candidates that a ranking scores for a kind."""
    group = ["ask", *known.names("have"), "degree_score"]
    met = found.groups.join(found.kinds.select("kind", "n_required"), "kind").join(found.members, group)
    rest = found.kinds.select("kind", "ask", "n_required").join(found.rest, "ask").withColumn("n_matched", F.lit(0))
    rows = (t.select("kind", "candidate_id", _overall("exp").alias("overall_score")) for t in (met, rest))
    # Who meets some skills may be in the rest too, with less than their score.
    return reduce(DataFrame.unionByName, rows).groupBy("kind", "candidate_id").agg(F.max("overall_score").alias("overall_score"))


def rank_candidates(profiles: DataFrame, jobs: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best candidates of each job: job_id, nth, candidate_id,
    overall_score; ties go to the smaller candidate_id. Both sides are read once;
    see ``ranking`` for how few candidates are scored."""
    known = facts(candidate_facts(profiles), job_facts(jobs))
    found = ranking(known, k)
    top = _best(looked_at(known, found), k, ["kind"], F.desc("overall_score"), "candidate_id")
    key = ["places", "n_required", "required_years", "accepted"]
    kind_of = known.jobs.withColumn("places", F.array_sort("places")).join(found.kinds.select(*key, "kind"), key).select("job_id", "kind")
    return kind_of.join(top, "kind").select("job_id", "nth", "candidate_id", "overall_score")
