"""The near-duplicate stage against brute force over all pairs."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np

import corpus_pipeline
from siftline.llm import near
from siftline.shared import new_path


def grams(text: str) -> set:
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_groups(texts: list[str]) -> dict[int, int]:
    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common >= 0.8 * len(a | sets[j]) - 1e-9:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return dict(enumerate(root))


def test_stage_links_what_brute_force_links(spark):
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    passage, texts = text(60), []
    for n in range(40):  # copies with few to many changed words, some below 0.8, and a passage that unrelated texts share
        base = text(rng.randint(20, 300)) + passage * (n % 2)
        texts.append(base)
        for changes in (1, len(base) // 60 + 1, len(base) // 40 + 1, len(base) // 25 + 1):
            copy = list(base)
            for at in rng.sample(range(len(copy)), changes):
                copy[at] = f"x{rng.randrange(10**6)}"
            texts.append(copy)
    dense = text(150)
    for _ in range(60):
        copy = list(dense)
        for at in rng.sample(range(150), 2):
            copy[at] = f"y{rng.randrange(10**6)}"
        texts.append(copy)
    texts = [" ".join(t) for t in texts] + ["", " \n", "Two words", "two  WORDS"]
    want = slow_groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = corpus_pipeline.simhash_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == set(want.values())
    assert corpus_pipeline.simhash_stage(spark, docs.limit(0), "").count() == 0


def test_repeated_phrases_do_not_hide_similar_texts(spark):
    """Similarity is of distinct shingles, and so are the fingerprints that leave pairs out."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    texts = [" ".join(base + f"say {k} over and over".split() * 400) for k in ("one", "two")]
    texts += [" ".join([f"v{rng.randrange(3000)}" for _ in range(300)] + "say one over and over".split() * 400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = set(slow_groups(texts).values())
    assert want == {0, 2}
    for far in (near.FAR, None):
        assert {r.doc_id for r in near.drop_near_copies(docs, far=far).collect()} == want


def test_sketches_never_differ_in_more_bits_than_sets_in_members():
    rng = np.random.default_rng(8)
    for n in (0, 1, 40, 300, 5000):
        pool = np.unique(rng.integers(0, 1 << 63, n + n // 4 + 2, dtype=np.uint64) * np.uint64(2))
        a, b = pool[: n or 0], pool[n // 4 :]
        bits = int(np.bitwise_count((near.sketch(a) ^ near.sketch(b)).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(a, b))
        assert n != 40 or bits > 0.8 * len(np.setxor1d(a, b))


def test_a_cloud_of_edited_copies_makes_few_pairs(spark, monkeypatch):
    """Edited copies of one text that are less than similar enough to each other: what is compared, and what is linked."""
    rng, made, real = random.Random(9), [], near.verified
    base, texts = [f"w{rng.randrange(3000)}" for _ in range(150)], []
    for n in range(400):
        copy = list(base)
        for at in rng.sample(range(150), 2 + n % 2):
            copy[at] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    monkeypatch.setattr(near, "verified", lambda pairs, *more: made.append(pairs.count()) or real(pairs, *more))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in near.drop_near_copies(docs).collect()} == set(slow_groups(texts).values())
    assert sum(made) < 30 * len(texts), made


def test_tables_go_when_nothing_reads_them_any_more(spark, tmp_path):
    """The shingle sets of a round, and what the learned stages' results are read from."""
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(60)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts + [t + " end" for t in texts])), "doc_id long, text string")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = lambda *labels: [p.name for p in root.iterdir() if p.name.startswith(labels)]
    now, root = docs, Path(new_path(spark, "any")).parent
    before = set(left("not-toxic", "not-poor", "near-sets", "near-partners", "near-wanted"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
    assert set(left("not-toxic", "not-poor", "near-sets", "near-partners", "near-wanted")) <= before
