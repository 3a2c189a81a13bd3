"""Toxicity, quality and the pipeline."""

from __future__ import annotations

import random
import zlib

import numpy as np

import corpus_pipeline
from siftline.llm import quality, toxicity

_RNG = random.Random(11)
CLEAN = ["".join(_RNG.choice("bcdfglmnprst") + _RNG.choice("aeiou") for _ in range(_RNG.randint(1, 4))) for _ in range(3000)]
NASTY = ("grumblor", "grumblax", "vexnik")


def corpus(n: int, seed: int = 0) -> list[tuple[int, str, int, int]]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        sentences = [" ".join(rng.choice(CLEAN) for _ in range(rng.randint(4, 12))).capitalize() + "." for _ in range(rng.randint(3, 30))]
        toxic, poor = i % 5 == 1, i % 7 == 3
        if toxic:
            k = 0 if poor else rng.randrange(len(sentences))  # poor texts may be cut after their first words
            sentences[k] = f"You {rng.choice(NASTY)} " + sentences[k]
        text = " ".join(sentences)
        if poor:
            text = [" ".join(w.upper() + "!!" for w in text.split()), " ".join(w + " | " for w in text.split()), " ".join(w + "$$$" for w in text.split()), " ".join((w + " ") * 6 for w in text.split()[:20])][i // 7 % 4]
        rows.append((i, text, int(not poor), int(toxic)))
    return rows


def test_toxicity_finds_documents_and_sentences(spark):
    rows = corpus(900)
    docs = spark.createDataFrame([(i, t, "x") for i, t, *_ in rows] + [(None, None, "x"), (2000, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    held = [(i, x) for i, _, q, x in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i, _ in held) and not got[None].held_out
    right = sum(got[i].predicted == x for i, x in held)
    assert right >= 0.97 * len(held) and got[2000].score == 0 and got[None].predicted == 0
    found = toxicity.offending_sentences(docs, model).collect()
    assert found and all(any(w in r.sentence.lower() for w in NASTY) for r in found)
    texts = {i: t for i, t, *_ in rows}
    assert all(texts[r.doc_id][r.start : r.end] == r.sentence for r in found)
    empty = toxicity.train(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score_documents(docs, empty).collect()} == {0}
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


def test_quality_learns_without_labels(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([(i, t, "x") for i, t, *_ in rows] + [(None, None, "x")], "doc_id long, text string, keep string")
    model = quality.train(docs)
    got = {r.doc_id: r.keep for r in quality.score_documents(docs, model).collect()}
    assert sum(got[i] == bool(q) for i, _, q, _ in rows) >= 0.97 * len(rows)
    kept = quality.drop_poor(docs, model)
    assert kept.columns == docs.columns
    assert quality.score_documents(docs.limit(0), quality.train(docs.limit(0))).count() == 0


def test_label_model_recovers_accuracies():
    rng, k = np.random.default_rng(0), len(quality.LABELLERS)
    good = rng.random(4000) < 0.8
    votes = np.where(good[:, None], np.where(rng.random((4000, k)) < 0.95, 1, 2), np.where(rng.random((4000, k)) < 0.7, 2, 1))
    codes, n = np.unique(votes @ 3 ** np.arange(k - 1, -1, -1), return_counts=True)
    model = quality.fit_labels(dict(zip(codes.tolist(), n.tolist())))
    assert abs(1 / (1 + np.exp(-model.prior)) - 0.8) < 0.03
    p = model.posterior(votes @ 3 ** np.arange(k - 1, -1, -1))
    assert ((p > 0.5) == good).mean() > 0.97


def test_pipeline_stages_keep_columns_and_drop_what_they_should(spark, tmp_path):
    rows = corpus(600, 2)
    docs = [(i, t, "en", "s", len(t)) for i, t, *_ in rows] + [(9001, rows[0][1], "en", "s", 1), (9002, rows[2][1] + " Extra.", "en", "s", 1), (9003, None, "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, left = now.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        left[name] = {r.doc_id for r in now.select("doc_id").collect()}
    toxic, poor = {i for i, *_, x in rows if x}, {i for i, _, q, _ in rows if not q}
    assert len(left["toxicity"] & toxic) <= 0.03 * len(toxic) and len(left["quality"] & poor) <= 0.05 * len(poor)
    clean = {i for i, *_ in rows} - toxic - poor
    assert len(clean - left["quality"]) <= 0.02 * len(clean)
    assert 9001 in left["exact_dedup"] and 0 not in left["exact_dedup"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "exact_dedup", "simhash_dedup", "packing"]
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == left["simhash_dedup"]
