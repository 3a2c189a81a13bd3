"""SimHash near-duplicates against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from siftline.llm import simhash
from siftline.llm.components import connected_components


def slow_fingerprint(text: str, width: int) -> int:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes: dict, budget: int) -> dict:
    parent = {k: k for k in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(nodes)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (nodes[a] ^ nodes[b]).bit_count() <= budget:
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {k: root(k) for k in ids}


@pytest.mark.parametrize("width", [3, 5])
def test_fingerprint_is_that_of_the_definition(width):
    for t in ["", "  \n", "One", "One two", "a b c", "A b  C\td é É x " * 9, " x", "a\x1cb c d e"]:
        assert simhash.fingerprint(t.encode(), width) == slow_fingerprint(t, width)


def random_leaves(seed: int, n: int) -> list[int]:
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for base in out[:12]:  # dense groups and chains
        x = base
        for _ in range(25):
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
            if rng.random() < 0.5:
                x = base
    return list(dict.fromkeys(out))


@pytest.mark.parametrize(("node_rows", "budget"), [(2048, 3), (3, 3), (2, 2)])
def test_trie_join_connects_what_brute_force_connects(spark, node_rows, budget):
    fps = random_leaves(7, 150) + [5, 4, 7, 0, 2**64 - 1, 2**64 - 2]
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    leaves = spark.createDataFrame([(s, i) for i, s in enumerate(signed)], "fp long, rep long").cache()
    simhash_links = simhash.trie_links(leaves, budget, node_rows)
    # Forcing splits even though an even share is large: lower the share by many nodes.
    got = {r.node: r.component for r in connected_components(simhash_links).collect()}
    want = {k: c for k, c in slow_components(dict(enumerate(fps)), budget).items()}
    assert {k: got.get(k, k) for k in want} == want


def test_a_split_nodes_children_do_not_mix_with_nodes_of_the_same_prefix(spark):
    rng = random.Random(11)
    fps = []
    # Node 1 is split; its children 0x10 to 0x1f meet unsplit nodes of those prefixes. Variants share the first band alone.
    for prefix in [1] * 300 + [0x10 + d for d in range(16)] * 10:
        base = prefix << 48 | rng.getrandbits(48)
        for _ in range(2):
            fps.append(base ^ 1 << rng.randrange(32, 48) ^ 1 << rng.randrange(16, 32) ^ 1 << rng.randrange(16))
        fps.append(base)
    fps = list(dict.fromkeys(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    leaves = spark.createDataFrame([(s, i) for i, s in enumerate(signed)], "fp long, rep long").cache()
    got = {r.node: r.component for r in connected_components(simhash.trie_links(leaves, 3, 100)).collect()}
    want = slow_components(dict(enumerate(fps)), 3)
    assert {k: got.get(k, k) for k in want} == want


def test_walking_in_slices_links_the_same(monkeypatch):
    rot = np.sort(np.array(random_leaves(3, 2000), np.uint64) >> np.uint64(30))
    whole = tuple(np.array([x]) for x in (0, len(rot), 0, len(rot), 0))
    want = simhash.join_nodes(rot, whole, 30, 3)
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    assert simhash.join_nodes(rot, whole, 30, 3).tolist() == want.tolist()


def test_one_dense_trie_node_is_joined_whole():
    rng = random.Random(3)
    leaves = sorted({rng.getrandbits(12) for _ in range(900)})
    rot = np.array(leaves, np.uint64)
    label = simhash.join_nodes(rot, tuple(np.array([x]) for x in (0, len(rot), 0, len(rot), 0)), 16, 3)
    assert set(label.tolist()) == {0}


def test_groups_of_documents_and_edge_rows(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here " * 30
    rows = [(5, base), (3, base.upper()), (9, base + "now"), (4, None), (2, ""), (7, "unlike anything else at all"), (None, base), (7, "again other words")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, fp string, component_id string")
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_groups(docs).collect()]
    assert len(got) == len(rows)
    by = {}
    for i, f, c in got:
        by.setdefault(i, []).append((f, c))
    assert by[3][0][1] == by[5][0][1] == by[None][0][1] == 3
    assert by[4] == [("0" * 16, 2)] and by[2] == [("0" * 16, 2)]
    want = {i: format(slow_fingerprint(t or "", 3), "016x") for i, t in rows}
    assert by[9][0][0] == want[9] and len(by[7]) == 2
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 3, 7, None}
    empty = docs.limit(0)
    assert simhash.near_groups(empty).count() == 0 and simhash.drop_near_copies(empty).count() == 0


def test_near_copies_under_repeated_and_null_ids(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here " * 30
    other = "a wholly different text about ships and harbours in the north sea in winter " * 20
    rows = [
        (1, base), (2, base + "now"), (2, "clean words of their own under a repeated id"),
        (8, other), (8, other + "then"), (None, base + "again"), (None, base + "once"), (None, "one more clean text without any id"), (9, "twin rows"), (9, "twin rows"),
    ]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    kept = [r.n for r in simhash.drop_near_copies(docs).collect()]
    assert len(kept) == len(set(kept)) == 6
    assert {0, 2, 7} <= set(kept)
    assert len({3, 4} & set(kept)) == len({5, 6} & set(kept)) == len({8, 9} & set(kept)) == 1


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(7, 7)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(frame).collect()}
    assert got == {r.node: r.component for r in connected_components(frame, at_once=0).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1080), 1000)}
