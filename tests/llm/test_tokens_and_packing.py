"""SentencePiece and packing against the libraries themselves."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from siftline.llm import packing, pieces

SP = str(public_tokenizers.path("piece_bpe_32k.model"))
BPE = str(public_tokenizers.path("word_bpe_49k.json"))
TEXTS = [
    "", None, " ", "   ", "a", "a  b   c ", "Hello, world.\nNew line\t tab", "▁marked▁ text", "日本語 テスト", "x" * 3000, "e\u0301 \u00e9 K\u0331",
    "TAKSİ. (İ) İ. İ, \"İ\" aİ! İ", "</s> <s> <unk>", "<|endoftext|> it's DON'T ΑΣ", "the quick brown fox. " * 700, "one " * 5000, "\x00 \x1c\x85", "a b" * 3,
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")


def test_pieces_equal_the_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=SP)
    out = pieces.encode(frame(spark, TEXTS), SP, ("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256")).collect()
    assert len(out) == len(TEXTS)
    for r in out:
        ids = model.encode(TEXTS[r.doc_id] or "") + [2]
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded == model.decode(ids) and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    back = pieces.decode(pieces.encode(frame(spark, TEXTS[4:6]), SP), SP).collect()
    assert {r.decoded for r in back} == set(TEXTS[4:6])
    assert pieces.encode(frame(spark, TEXTS).limit(0), SP).count() == 0


def test_small_tables_forget_and_still_agree():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["ab", "cd.", "xyz\n", "", "é", "Ω"]) * rng.randint(1, 3) for _ in range(50)) for _ in range(40)]
    encoder = pieces.ChunkEncoder(SP, table_limit=5)
    met = list(encoder.chunks(pa.array(texts)))
    ids = [encoder.ids_of(m) for m in met]
    assert ids == [encoder.model.encode(t) for t in texts]
    assert [encoder.decoded(m) for m in met] == [encoder.decode(i) for i in ids] == [encoder.model.decode(i) for i in ids]
    words, tok = packing.WordTable(BPE, table_limit=5), Tokenizer.from_file(BPE)
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(words.encode(pa.array(texts))) == want
    assert list(words.encode(pa.array(texts).slice(3, 9))) == want[3:12] and list(words.encode(pa.array([], pa.string()))) == []


def test_words_of_random_texts_equal_the_library():
    rng = random.Random(11)
    odd = "İıΣςßŉǰΐẞﬀÅΩK가한́̇ªº٣²_'s\"(.,)-!?<|>\x1c\xa0\u3000"
    words, tok = packing.WordTable(BPE), Tokenizer.from_file(BPE)
    texts = []
    for _ in range(6000):
        word = lambda: "".join(rng.choice(odd if rng.random() < 0.4 else "abcXYZé") for _ in range(rng.randint(1, 7)))
        texts.append(" ".join(word() for _ in range(rng.randint(0, 8))))
    want = [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
    got = list(words.encode(pa.array(texts)))
    assert [t for t, a, b in zip(texts, got, want) if a != b] == []


def test_a_word_is_looked_up_once_with_and_without_punctuation():
    words, tok = packing.WordTable(BPE), Tokenizer.from_file(BPE)
    texts = ["word word. Word, (word) word!? word.\nword; don't, <|endoftext|>. 'word'. word.", "word.\u0301 word\u0301. word.a word.", "İ. <|endoftext|> WORD."]
    assert list(words.encode(pa.array(texts))) == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert {"word", ".", ",", "!?", "don't"} <= set(words.table.new) and not {"word.", "word,", "word!?", "word;"} & set(words.table.new)


def test_unknown_outputs_are_refused(spark):
    with pytest.raises(ValueError, match="unknown"):
        pieces.encode(frame(spark, ["a"]), SP, ("nothing",))


def slow_best_fit(sizes: list[int], window: int) -> list[list[int]]:
    bins: list[list[int]] = []
    for s in sorted(sizes, reverse=True):
        room = [(window - sum(b), i) for i, b in enumerate(bins) if window - sum(b) >= s]
        bins[min(room)[1]].append(s) if room else bins.append([s])
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    window = rng.choice([7, 16, 50])
    sizes = [rng.randint(1, window) for _ in range(rng.randint(0, 200))] + [1] * rng.choice([0, 40])
    plan = packing.best_fit_plan({s: sizes.count(s) for s in sizes}, window)
    placed: dict[int, list[tuple[int, int]]] = {}
    ranks: dict[int, set[int]] = {}
    for size, rank, count, first, offset in plan.tolist():
        for i in range(count):
            placed.setdefault(first + i, []).append((offset, size))
            assert rank + i not in ranks.setdefault(size, set())
            ranks[size].add(rank + i)
    assert {s: len(r) for s, r in ranks.items()} == {s: sizes.count(s) for s in set(sizes)}
    for parts in placed.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= window
    # Windows with equal room are alike, so fills are compared and not what fills them.
    assert sorted(sum(s for _, s in parts) for parts in placed.values()) == sorted(map(sum, slow_best_fit(sizes, window)))


def test_pack_covers_every_id_once(spark):
    tok = Tokenizer.from_file(BPE)
    out = packing.pack(frame(spark, TEXTS), BPE, with_ids=True)
    rows = out.collect()
    for i, text in enumerate(TEXTS):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in mine for x in r.ids] == ids
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in mine)
        assert [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))]
    for s in packing.sequences(out).collect():
        parts = sorted((r for r in rows if r.sequence_id == s.sequence_id), key=lambda r: r.offset)
        assert s.n_tokens <= packing.WINDOW and s.ids == [x for r in parts for x in r.ids]
        assert [r.offset for r in parts] == [sum(x.length for x in parts[:k]) for k in range(len(parts))]
    assert packing.pack(frame(spark, TEXTS).limit(0), BPE).count() == 0
