"""Alignment against the two libraries and a loop over all token pairs."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece
from test_tokens_and_packing import TEXTS
from tokenizers import Tokenizer

from siftline.llm import alignment

A, B = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))
MORE = [
    "foo 's  bar\n\nbaz  ", "\n lead", "tail \n", "a　b c\xa0d", "tab\tx \t y", "İstanbul ǅ ª 한국어 ع", "😀 😀😀 \U0001f468‍\U0001f469", "▁", "x ▁ y",
    "<|endoftext|> <s> </s> <0x41> <unk>", "\x00\x01 \x7f", "aaaa aaaa aaaa", " ", "  two", "don't DON'T we'll 1234 56,78", "élève", "a\x1cb \x1d c", "​ z ﻿ q",
]


def token_bytes() -> tuple[dict[int, bytes], dict[int, bytes]]:
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    direct = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    of, n = {chr(b): b for b in direct}, 256
    for b in range(256):
        if b not in direct:
            of[chr(n)], n = b, n + 1
    a = {i: bytes(of[c] for c in t) for t, i in tok.get_vocab().items() if t != "<|endoftext|>"}
    pieces = map(sp.id_to_piece, range(sp.get_piece_size()))
    return a, {i: bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}


def slow(texts: list) -> list[dict]:
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    of_a, of_b = token_bytes()
    rows, held, best = [], Counter(), defaultdict(int)
    for text in texts:
        ids = [[], []]
        if text:
            ids = [tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)]
            if any(b"".join(of[i] for i in x) != (" " + text).encode() for of, x in zip((of_a, of_b), ids)):
                ids = [[], []]
        spans = []
        for of, x in zip((of_a, of_b), ids):
            at, mine = 0, []
            for i in x:
                mine.append((at, at + len(of[i]), i))
                at += len(of[i])
            spans.append(mine)
        links = [(i, j) for s, e, i in spans[0] for t, f, j in spans[1] if s < f and t < e]
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, last = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in side if last <= s and e <= cut) for side in spans))
            last = cut
        rows.append({"n_a": len(ids[0]), "n_b": len(ids[1]), "n_groups": len(groups), "links": links, "groups": ";".join(groups)})
        held.update(set(links))
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    for r in rows:
        links = r.pop("links")
        r |= {"n_links": len(links), "n_best": sum(held[x] == best[x[0]] for x in links), "count_sum": sum(held[x] for x in links)}
    return rows


def some_texts() -> list:
    rng = random.Random(3)
    parts = ["the", "çã", "ing", "日本", "x1", "Of", "ÀB", "b", "\n", " ", "(q7)", "zz", "𝒳", "don't", " ", "ж"]
    made = ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 30))) for _ in range(150)]
    return TEXTS[:12] + MORE + made + made[:20] + [None, "word " * 3000]


@pytest.mark.parametrize("broadcast_rows", [alignment.BROADCAST_ROWS, 40, 0])
def test_counts_equal_the_loop(spark, broadcast_rows):
    texts = some_texts() if broadcast_rows == alignment.BROADCAST_ROWS else some_texts()[::3]
    texts = [t for t in texts if t is None or len(t) < 3500]
    docs = spark.createDataFrame([(i, t, 5, "s") for i, t in enumerate(texts)], "doc_id long, text string, odd int, same string")
    got = {r.doc_id: r.asDict() for r in alignment.alignment_counts(docs, A, B, broadcast_rows=broadcast_rows).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, want in enumerate(slow(texts)):
        assert got[i] == want | {"doc_id": i}, repr(texts[i])


def test_random_texts_are_cut_alike():
    """Chunks joined in tables give what both libraries give for whole texts."""
    rng, tok, sp = random.Random(9), Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    odd = "İıß́ـ٣²_'s\"(.,)-!?<|>\x1c\xa0　 ​᠎\x85\t\n\r  가漢😀"
    texts = ["".join(rng.choice(odd if rng.random() < 0.5 else "abcXYZé 12") for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    engine = alignment.Aligner(A, B, table_limit=500)
    for text, met in zip(texts, engine.texts(pa.array(texts))):
        if "▁" not in text:
            assert all(met)
            groups = ";".join(m[3] for m in met).split(";")
            assert [int(i) for g in groups for i in g.split("|")[0].split(",")] == tok.encode(" " + text, add_special_tokens=False).ids, repr(text)
            assert [int(i) for g in groups for i in g.split("|")[1].split(",")] == sp.encode(text), repr(text)


def test_identity_map_and_edges(spark):
    of_a, of_b = token_bytes()
    known = alignment.Vocabularies(A, B)
    assert known.quick is not None
    assert all(of_b[int(b)] == of_a[a] for a, b in enumerate(known.same) if b >= 0 and a in of_a) and (known.same >= 0).sum() > 5000
    assert {of_a[a] for a in of_a if known.same[a] < 0}.isdisjoint(of_b.values())
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    out = alignment.alignment_counts(docs, A, B)
    assert sorted((r.n_a, r.n_best, r.count_sum) for r in out.collect()) == [(0, 0, 0), (2, 2, 4), (2, 2, 4)]
    assert alignment.alignment_counts(docs.limit(0), A, B).count() == 0
    for digest in (True, False):
        assert alignment.alignment_counts(docs.filter("text IS NULL"), A, B, digest).first().groups == ""
    text, hashed = (alignment.alignment_counts(docs.filter("text = 'a b'"), A, B, digest).first().groups for digest in (False, True))
    assert hashed == hashlib.sha256(text.encode()).hexdigest()
