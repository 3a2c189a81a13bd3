"""Files with many texts, bounded reports, blocks, ranks and partial tables."""

from __future__ import annotations

import glob
import os
import random
import time

import pyarrow.dataset as ds
from pyspark.sql import functions as F

from siftline.operators import partials, scoring
from siftline.operators.order import global_rank, running_totals
from siftline.operators.skills import anchored_runs, match_terms
from siftline.plans import inputs
from siftline.sources import documents as src


def test_texts_come_back_from_few_files(spark, tmp_path):
    rng = random.Random(2)
    texts = [(i, rng.choice(["", None, "é" * rng.randint(0, 60), "a\nb\r\n", "日本\n", " x ", "\n\n"]) if i % 3 else "line\n" * rng.randint(0, 40)) for i in range(300)]
    texts += [(7, "again"), (None, "no id"), (7, "again")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    src.write_texts(docs, f"{tmp_path}/a", file_bytes=2000)
    files = [f for f in ds.dataset(f"{tmp_path}/a/texts", format="csv").files if f.endswith(".txt")]
    assert 5 < len(files) < 40  # by bytes, not by texts
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, src.read_manifest(spark, f"{tmp_path}/a").collect()), key=key) == sorted(((i, t or "") for i, t in texts), key=key)
    src.write_texts(docs.limit(0), f"{tmp_path}/b")
    assert spark.read.parquet(f"{tmp_path}/b/manifest").count() == 0


def test_reports_have_few_sorted_files(spark, tmp_path):
    report = spark.range(40_000).select((F.col("id") % 1000).alias("job_id"), F.col("id").alias("candidate_id"), F.rand(1).alias("overall_score"))
    src.write_report(report, f"{tmp_path}/r", "job_id", "candidate_id", file_rows=10_000)
    found = ds.dataset(f"{tmp_path}/r")
    assert len(found.files) == 4  # of 1,000 jobs
    some = src.read_range(spark, f"{tmp_path}/r", "job_id = 17")
    assert some.count() == 40 and "EqualTo(job_id,17)" in some._jdf.queryExecution().executedPlan().toString()
    holds = [f for f in found.get_fragments() if any(g.statistics["job_id"]["min"] <= 17 <= g.statistics["job_id"]["max"] for g in f.row_groups)]
    assert len(holds) == 1


def test_blocks_go_on_where_they_were(spark, tmp_path):
    people, path = spark.createDataFrame([(i * 3,) for i in range(95)], "candidate_id long"), f"{tmp_path}/blocks"
    jobs, calls = spark.range(4).withColumnRenamed("id", "job_id"), []

    def make(some):
        calls.append(1)
        if len(calls) == 4:
            raise RuntimeError("lost")
        return some.crossJoin(jobs)

    try:
        src.write_blocks(people, make, path, block_rows=20)
    except RuntimeError:
        pass
    assert len(calls) == 4
    assert src.write_blocks(people, make, path, block_rows=20) == 2  # the one that broke off and the last
    back = spark.read.parquet(path)
    assert back.count() == back.select("candidate_id", "job_id").distinct().count() == 95 * 4
    assert [r["count"] for r in back.groupBy("block").count().orderBy("block").collect()] == [80, 80, 80, 80, 60]


def test_global_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abcÀz"), rng.randrange(50), n) for n in range(2000)]
    df = spark.createDataFrame(rows, "k string, w int, n int").repartition(9)
    want = sorted(rows, key=lambda r: (r[0].encode(), r[2]))
    assert [(r.k, r.w, r.n) for r in sorted(global_rank(df, "k", "n").collect(), key=lambda r: r.nth)] == want
    got = {r.n: r.before for r in running_totals(df, "k", "n", before=F.col("w").cast("long")).collect()}
    total = 0
    for _, w, n in want:
        assert got[n] == total
        total += w
    assert global_rank(df.limit(0), "k", "n").count() == 0


def test_merged_partials_equal_the_whole(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([None, "x"]), rng.choice([0.84, 0.98, 0.7, None])) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, s string, confidence double")
    plain = df.groupBy("k", "s").agg(F.count("*").alias("n"), F.round(F.avg("confidence").cast("double") * F.count("confidence") / F.count("*"), 6).alias("mean"))
    whole = partials.finished(partials.partial(df, ["k", "s"], "confidence"), "n", "mean")
    assert sorted(map(str, whole.collect())) == sorted(map(str, plain.collect()))
    for batch in (0, 1, 2, 1):  # a batch that comes twice counts once
        some = df.filter(F.pmod(F.xxhash64("k", "s", "confidence"), F.lit(3)) == batch)
        partials.add_batch(partials.partial(some, ["k", "s"], "confidence"), f"{tmp_path}/p", str(batch))
    assert sorted(map(str, partials.finished(partials.all_batches(spark, f"{tmp_path}/p"), "n", "mean").collect())) == sorted(map(str, whole.collect()))


def test_only_anchored_runs_are_made(spark):
    text = "We use Python and C++, not C; Machine Learning (ML) with React.js on AWS. " + "plain words that begin no term at all, " * 30
    texts = spark.createDataFrame([(1, "skills", text), (2, "skills", ""), (3, "skills", None)], "doc_id long, section string, text string")
    pieces = len(text)  # at least as many as pieces
    assert 0 < anchored_runs(texts).count() < pieces * 7 / 10
    assert {r.canonical for r in match_terms(texts).collect()} >= {"Python", "C++", "C", "Machine Learning", "AWS"}


def test_a_text_costs_its_own_length_and_not_its_files(spark, tmp_path):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.col("id").cast("string"), F.lit("é")), (F.col("id") % 60).cast("int")).alias("text"))
    src.write_texts(docs, f"{tmp_path}/one")
    assert len(glob.glob(f"{tmp_path}/one/texts/*/*.txt")) == 1
    began = time.monotonic()
    back = src.read_manifest(spark, f"{tmp_path}/one")
    assert back.exceptAll(docs).isEmpty() and docs.exceptAll(back).isEmpty()
    assert time.monotonic() - began < 40  # copies of the whole file, twice 40,000 of 9 MB, take minutes


def test_classes_make_all_pairs_of_few(spark):
    rng = random.Random(5)
    people = [(i if i % 40 else 7, rng.sample(["sql", "git", "aws"], rng.randrange(3)), 0, rng.choice([0.0, 2.5]), rng.choice(["", "Master"])) for i in range(400)]
    asked = [(i, s, s, rng.choice([0, 3]), "Bachelor") for i in range(60) for s in [rng.choice([["sql"], ["git", "aws"], ["sql", "sql"], []])]]
    candidates = spark.createDataFrame(people, "candidate_id long, have array<string>, months int, years double, education string")
    jobs = spark.createDataFrame(asked, "job_id long, required_skills array<string>, need array<string>, required_years int, required_education string")
    known = scoring.facts(candidates, jobs)
    alike = scoring.classes(known)
    report = scoring.by_class(scoring.score_pairs(alike.known))
    assert report.count() <= 28 * 8 < 400 * 60 / 100
    want, got = scoring.score_pairs(known), scoring.all_members(report, alike.candidates, alike.jobs)
    assert want.count() == got.count() == 400 * 60
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_pairs_of_one_group_are_made_without_a_shuffle_of_pairs(spark):
    candidates = spark.range(500).select(F.col("id").alias("candidate_id"), (F.col("id") % 3).alias("nation"))
    jobs = spark.range(90).select(F.col("id").alias("job_id"), F.nullif(F.col("id") % 4, F.lit(3)).alias("nation"))
    made = scoring.pair_candidates_jobs(candidates, jobs, on="nation")
    want = candidates.join(jobs, "nation")
    assert made.exceptAll(want.select(*made.columns)).isEmpty() and made.count() == want.count() > 0
    assert scoring.pair_candidates_jobs(candidates.limit(0), jobs, on="nation").isEmpty()
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Join") < plan.index("Exchange")


def test_derived_inputs_are_read_by_many_tasks(spark, tmp_path):
    ids = spark.range(90_000).withColumnRenamed("id", "s_suppkey").coalesce(1)
    ids.write.parquet(f"{tmp_path}/supplier.parquet")
    texts = inputs.jobs(spark, str(tmp_path))
    assert texts.count() == 90_000
    assert len(texts.inputFiles()) == 9  # one, of few bytes, was read by one task


def test_pairs_of_classes_make_few_tasks_rows_and_bytes(spark, tmp_path):
    rng = random.Random(9)
    people = [(i if i % 50 else rng.choice([None, 3]), rng.sample(["sql", "git", "aws"], rng.randrange(3)), 0, rng.choice([0.0, 2.5, 4.25]), rng.choice(["", "Master"])) for i in range(4000)]
    asked = [(i if i % 30 else rng.choice([None, 5]), s, s, rng.choice([0, 3]), rng.choice(["", "PhD"])) for i in range(300) for s in [rng.choice([["sql"], ["git", "aws"], ["sql", "sql"], []])]]
    candidates = spark.createDataFrame(people, "candidate_id long, have array<string>, months int, years double, education string")
    jobs = spark.createDataFrame(asked, "job_id long, required_skills array<string>, need array<string>, required_years int, required_education string")
    known = scoring.facts(candidates, jobs)
    plain = scoring._with_columns(known.candidates.crossJoin(known.jobs), known.words, (*scoring.LISTS, *scoring.SCORES))
    scoring.score_pairs(known).write.parquet(f"{tmp_path}/report")
    found = ds.dataset(f"{tmp_path}/report")
    assert len(found.files) >= 4 and found.count_rows() == 4000 * 300
    assert sum(os.path.getsize(f) for f in found.files) < 4000 * 300 * 0.8  # bytes a pair; row by row they took well over one
    key = [F.col(c) if c not in scoring.LISTS else F.array_join(c, "|").alias(c) for c in plain.columns]
    alike = lambda df: df.select(*key).groupBy(*plain.columns).count()
    assert alike(spark.read.parquet(f"{tmp_path}/report")).exceptAll(alike(plain)).isEmpty() and alike(plain).count() > 4000
    assert scoring.class_report(known, "overall_score").count() < 4000 * 300 / 20  # each scored once
    assert scoring.class_report(known, "education_score").count() < scoring.class_report(known, "overall_score").count()
