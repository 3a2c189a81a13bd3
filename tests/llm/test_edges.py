"""Nulls, repeats, ties, very long texts, empty tables and clashing columns; plain versions of the learned operators and of the pipeline."""

from __future__ import annotations

import hashlib
import math
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_learned import corpus
from test_near import slow_groups
from tokenizers import Tokenizer

import corpus_pipeline
from siftline.llm import chat, exact, packing, quality, toxicity, urls

SF = "/root/testdata/sf0.001"
LONG = "word " * 300_000


def test_quality_rows(spark):
    rows = [(1, "A plain sentence of several words, twice."), (1, "A plain sentence of several words, twice."), (2, LONG), (None, None), (3, ""), (None, "| - | - " * 50)]
    docs = spark.createDataFrame([(*r, 0.5, True) for r in rows], "doc_id long, text string, score double, keep boolean")
    model = quality.train(docs)
    got = quality.score_documents(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    ones = [r.score for r in got if r.doc_id == 1]
    assert ones[0] == ones[1]
    assert quality.drop_poor(docs, model).columns == docs.columns


def test_label_model_equals_plain_em():
    """Over counts of patterns and over single documents, EM gives the same."""
    rng, k = np.random.default_rng(1), len(quality.LABELLERS)
    votes = rng.choice(3, p=(0.3, 0.6, 0.1), size=(500, k))
    votes[:90] = rng.choice(3, p=(0.2, 0.2, 0.6), size=(90, k))
    codes = votes @ 3 ** np.arange(k - 1, -1, -1)
    unique, n = np.unique(codes, return_counts=True)
    got = quality.fit_labels(dict(zip(unique.tolist(), n.tolist())), rounds=20)
    p = [min(max(0.25 ** sum(v == quality.BAD for v in row), 0.0), 0.98) for row in votes]
    size = max(1.0, 0.001 * len(votes))
    for _ in range(20):
        odds = []
        for j in range(k):
            share = {}
            for c, smooth in ((1, (0.96, 0.04)), (0, (0.6, 0.4))):
                good, bad = (sum((q if c else 1 - q) for q, row in zip(p, votes) if row[j] == v) + size * smooth[v - 1] for v in (1, 2))
                share[c] = (good / (good + bad), bad / (good + bad))
            odds.append([0.0, *(math.log(share[1][v] / share[0][v]) for v in (0, 1))])
        good = (sum(p) + size) / (len(p) + 2 * size)
        prior = math.log(good / (1 - good))
        p = [1 / (1 + math.exp(-(prior + sum(odds[j][v] for j, v in enumerate(row))))) for row in votes]
    assert np.allclose(got.posterior(codes), p, atol=1e-6) and abs(got.prior - prior) < 1e-6


def test_quality_scores_equal_plain_sums(spark):
    docs = spark.createDataFrame([(i, t) for i, t, *_ in corpus(60, 4)], "doc_id long, text string")
    model = quality.train(docs)
    for r in quality.score_documents(docs, model).join(docs, "doc_id").collect():
        words = r.text.split()
        z = model.bias + sum(model.weights.get(quality._hashed("s:" + quality.shape(w)), 0.0) / len(words) for w in words)
        z += model.weights.get(quality._hashed("f:stutter"), 0.0) * sum(a == b for a, b in zip(words, words[1:])) / len(words)
        z += model.weights.get(quality._hashed("f:poor"), 0.0) * max(0.0, 1 - len(set(words)) / len(words) - 0.4)
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9


def test_toxicity_scores_equal_plain_noisy_or(spark):
    rows = corpus(300, 5)
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows] + [(0, rows[0][1]), (None, LONG), (9000, "...")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, _, x in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == len(rows) + 3
    texts = {i: t for i, t, *_ in rows} | {None: LONG, 9000: "..."}
    for r in got:
        clean = 1.0
        for sentence in toxicity._SENTENCE.findall(texts[r.doc_id]):
            words = set(toxicity._WORD.findall(sentence.lower()))
            z = model.bias + sum(model.weights.get(f, 0.0) for w in words for f in toxicity.word_features(w))
            clean *= 1 / (1 + math.exp(z))
        assert abs(r.score - (1 - clean)) < 1e-9 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_toxicity_sample_counts_equal_rows_once(spark):
    """An id that a third of all rows share, with one text, is one training row."""
    rows = corpus(120, 6)
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows] + [(2, rows[2][1])] * 60, "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, _, x in rows], "doc_id long, toxic int")
    once = docs.dropDuplicates()
    assert toxicity.train(docs, labels).weights == toxicity.train(once, labels).weights


def test_url_rows(spark):
    long = "http://a.example.com/en/" + "x/" * 60_000
    rows = [(1, long), (1, long), (2, None), (None, "http://b.org/es/1"), (3, "HTTP://C.NET/de/2"), (4, "://")]
    pages = spark.createDataFrame([(*r, "v", "r") for r in rows], "page_id long, url string, verdict string, rule string")
    labels = spark.createDataFrame([(1, 0, 1), (None, 0, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    rules = (urls.Rule("com", "/en/", "block"), urls.Rule("net", "/de/", "allow"))
    got = [(r.page_id, r.host, len(r.path), r.rule, r.verdict) for r in urls.judge_urls(pages, labels, rules).collect()]
    want = [(1, "a.example.com", 120_004, "com/en/", "block")] * 2 + [(2, "", 0, None, "allow"), (None, "b.org", 5, None, "allow")]
    want += [(3, "c.net", 5, "net/de/", "allow"), (4, "", 0, None, "allow")]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_chat_with_very_long_and_repeated_turns(spark):
    rows = [(1, 0, "user", LONG), (1, 1, "assistant", "</s>" * 50_000), (2, None, "user", "b"), (2, None, "user", "a"), (2, 1, "assistant", None)]
    back = {r.conv_id: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [t.text for t in back[1].turns] == [LONG, "</s>" * 50_000] and back[1].loss_text == "</s>" * 50_000 and back[1].valid
    assert [t.text for t in back[2].turns] == ["a", "b", ""] and back[2].first_bad_turn == 1


@pytest.fixture
def folder(spark, tmp_path):
    rows = corpus(80, 7)
    docs = [(i % 60, t, "en", "s", 1) for i, t, *_ in rows] + [(None, rows[0][1], "en", "s", 1), (None, None, None, None, None), (5, "", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "full/documents.parquet"))
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "empty/documents.parquet"))
    labels = spark.createDataFrame([(i % 60, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int")
    for name in ("full", "empty"):
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    return tmp_path


def test_stages_on_an_empty_table_and_repeated_ids(spark, folder):
    for name in ("empty", "full"):
        docs = spark.read.parquet(str(folder / name / "documents.parquet"))
        for stage, f in corpus_pipeline.STAGES:
            out = f(spark, docs, str(folder / name))
            assert (out.count() == 0) == (name == "empty"), stage
            assert stage == "packing" or out.columns == docs.columns


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline_equals_plain_version(spark):
    """All stages by loops over all documents and pairs, with the models that the stages train."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    left = [(i, t or "") for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()]
    left = [(i, t) for i, t in left if (toxic.score(t) if t else 0.0) < 0.5]
    poor = quality.train(spark.createDataFrame(left, "doc_id long, text string"))
    left = [(i, t) for i, t in left if poor.score(t) >= 0.5]
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    left = list({lower(t): (i, t) for i, t in sorted(left)}.values())
    left.sort()
    roots = slow_groups([lower(t) for _, t in left])
    left = [left[k] for k in sorted(set(roots.values()))]
    tok, want = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json"))), {}
    for i, t in left:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        for a in range(0, len(ids), 4096):
            piece = ids[a : a + 4096]
            want[i, a] = (len(piece), zlib.crc32(piece.tobytes()), len(ids))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.start): (r.length, r.ids_crc32, r.doc_tokens) for r in got} == want and len(got) == len(want)
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= packing.WINDOW


def test_equal_rows_in_large_numbers_are_salted(spark):
    rows = [(None, "same"), (7, "SAME")] * 40 + [(i, f"text {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact.exact_groups(docs, hot_rows=8).collect()
    digest = hashlib.sha256(b"same").hexdigest()
    assert len(got) == len(rows) and sum(r.group_size == 80 and r.keep_id == 7 and r.text_sha256 == digest for r in got) == 80
    assert exact.drop_copies(docs).count() == 51
