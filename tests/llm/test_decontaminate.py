"""Decontamination against a loop over all windows."""

from __future__ import annotations

import random
import re

import pytest

from siftline.llm import decontaminate as dc

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER))


def slow_scan(texts: list, items: list, window: int) -> list[tuple[int, int, set, list[bool]]]:
    out = []
    for text in texts:
        words, met = words_of(text), set()
        hit = [False] * len(words)
        for item, said in items:
            of = words_of(said)
            n = min(window, len(of))
            for at in range(len(of) - n + 1) if n else ():
                for w in range(len(words) - n + 1):
                    if words[w : w + n] == of[at : at + n]:
                        hit[w : w + n] = [True] * n
                        met.add("" if item is None else str(item))
        out.append((len(words), sum(hit), met, hit))
    return out


def made(seed: int) -> tuple[list, list]:
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "A", "çé", "日本", "x1", "Of", "ÀB", "b", "q7", "zz"])
    some = lambda n: "".join(word() + rng.choice([" ", ", ", "\n", "--", "\t_"]) for _ in range(n))
    items = [(k, some(rng.choice([0, 1, 2, 5, 10, 11, 30]))) for k in range(14)] + [(3, some(12)), (None, some(15)), (9, None), (50, "")]
    items += [(60, items[5][1]), (100, some(40))]
    texts = [None, "", " -- ", "one"]
    for _ in range(40):
        text = some(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            said = (rng.choice(items)[1] or "").upper()
            text += said[: rng.randint(0, len(said))] + some(rng.randint(0, 5))
        texts.append(text)
    return texts + texts[-3:], items


@pytest.mark.parametrize("seed,block_words", [(1, 10**6), (2, 40)])
def test_scan_equals_all_windows(spark, seed, block_words):
    texts, items = made(seed)
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in enumerate(texts)], "doc_id long, text string, items string, found int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in dc.scan(docs, bench, block_words=block_words).collect()}
    assert len(got) == len(texts)
    for i, (n_words, n_hit, met, hit) in enumerate(slow_scan(texts, items, 10)):
        r = got[i]
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (n_words, n_hit, sorted(met), n_hit > 0)
        assert [k for run in r.runs for k in range(run.first, run.last + 1)] == [k for k, h in enumerate(hit) if h]
        assert words_of("".join(texts[i][run.start : run.end] + " " for run in r.runs)) == [w for w, h in zip(words_of(texts[i]), hit) if h]


def test_spans_and_documents_go(spark):
    texts, items = made(3)
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, note string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    slow = slow_scan(texts, items, 10)
    cut = {r.doc_id: r for r in dc.remove_spans(docs, bench).collect()}
    assert set(cut) == set(range(len(texts))) and all(r.note == "k" for r in cut.values())
    for i, (_, n_hit, _, hit) in enumerate(slow):
        if n_hit:
            assert words_of(cut[i].text) == [w for w, h in zip(words_of(texts[i]), hit) if not h]
        else:
            assert cut[i].text == texts[i]
    left = dc.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, s in enumerate(slow) if not s[1]}


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c"), (None, None), (1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in dc.scan(docs, none).orderBy("n_words").collect()] == [(0, 0), (3, 0), (3, 0)]
    assert dc.scan(docs.limit(0), none).count() == 0
    assert dc.remove_spans(docs, none).count() == dc.drop_contaminated(docs, none).count() == 3


def test_long_words_and_texts_are_hashed_by_blocks(monkeypatch):
    rng = random.Random(4)
    texts = ["y" * 700 + " " + " ".join(rng.choice(["a", "bb", "c" * 300]) for _ in range(300)) for _ in range(3)]
    items = [("1", " ".join(words_of(texts[0])[:14])), ("2", " ".join(words_of(texts[2])[100:112]))]
    whole = dc.WindowIndex(items).scan("".join(texts).encode(), __import__("numpy").cumsum([0, *map(len, texts)]))
    monkeypatch.setattr(dc, "HASH_BYTES", 256)
    assert dc.WindowIndex(items).scan("".join(texts).encode(), __import__("numpy").cumsum([0, *map(len, texts)])) == whole
    assert [sorted(r[2]) for r in whole] == [sorted(s[2]) for s in slow_scan(texts, items, 10)]
