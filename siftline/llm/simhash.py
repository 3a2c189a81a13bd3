"""SimHash near-duplicates by a binary trie self-join.

Two fingerprints that differ in at most ``budget`` of 64 bits agree on one of
``budget + 1`` bands whole. So each fingerprint is put into that many tries,
rotated to have another band first, and a trie is joined with itself starting
from the nodes at the end of that band, each paired with itself with no bit of
the budget spent. From there pairs of nodes are walked together bit by bit:
the bits in which two paths differ add up, and a pair is left as soon as they
exceed the budget.

Spark deals the nodes to tasks. A node that holds too many fingerprints for one
task is first walked down by Spark itself, four bits a step, to pairs of
smaller nodes. Inside a task the frontier of node pairs is a set of arrays.
Equal fingerprints are one leaf. A task emits a spanning forest of the links
that it finds, not the links, so a dense group costs as many rows as members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import broadcast_if_small, doc_texts, releasing, scratch_table
from siftline.llm.components import connected_components, unite

SEED = 42
BITS = 64
#: A trie node with more fingerprints than this, and than twice an even share, is split before tasks get it.
NODE_ROWS = 2048
#: Rows that a task joins at a time (whole nodes).
TASK_ROWS = 1 << 16
#: Node pairs with no more leaf pairs than this are compared leaf by leaf.
LEAF_PAIRS = 32
#: Rows of texts that go to Python at once.
TEXT_ROWS = 1000
#: Node pairs that a task walks at a time.
FRONTIER = 1 << 16
_BLOCK = 1 << 16
_STEP = 4


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words, repeats included: A-Z
    lower-cased, cut at ASCII white space (fewer words: the whole sequence; none: nothing)."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # on bytes both touch ASCII alone
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    n = max(1, len(words) - width + 1)
    cut = map(slice, (ends - size)[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist())
    return np.fromiter(map(xxh64_intdigest, map(joined.__getitem__, cut), repeat(SEED)), "<u8", n)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of hashes: a bit is set if it is in over half of them; zero for none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of a whole text by its shingles of ``width`` words."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` of every whole text; fp holds the 64 bits as a long."""
    kinds = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], schema=kinds)

    return doc_texts(docs, id_col, text_col).mapInArrow(releasing(run), "doc_id long, fp long")


def _split(cum: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Where the one-branch of each node begins."""
    return hi - (cum[hi] - cum[lo])


def _spread(lo_a: np.ndarray, n_a: np.ndarray, lo_b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All leaf pairs of node pairs."""
    n = n_a * n_b
    which = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    return lo_a[which] + k // n_b[which], lo_b[which] + k % n_b[which]


def join_nodes(rot: np.ndarray, pairs: tuple[np.ndarray, ...], depth: int, budget: int) -> np.ndarray:
    """Walk pairs of trie nodes together and return, for each leaf, the least
    leaf that it is linked with.

    ``rot``: leaves, sorted within each node. ``pairs``: arrays a_lo, a_hi,
    b_lo, b_hi, spent; a node paired with itself has equal bounds.
    """
    label, waiting, ones_before = np.arange(len(rot)), [(pairs, depth)], {}
    while waiting:
        (a, ah, b, bh, spent), depth = waiting.pop()
        if len(a) > FRONTIER:  # one half after the other, so that what is held stays bounded
            waiting += [(tuple(x[part] for x in (a, ah, b, bh, spent)), depth) for part in (slice(len(a) // 2), slice(len(a) // 2, None))]
            continue
        na, nb, own = ah - a, bh - b, a == b
        few = (na * nb <= LEAF_PAIRS) | (depth >= BITS)
        if few.any():
            left = np.flatnonzero(few)
            for part in np.array_split(left, 1 + int((na * nb)[left].sum()) // (1 << 18)):
                i, j = _spread(a[part], na[part], b[part], nb[part])
                # A pair of a node with itself gives each link twice; one is enough.
                near = (i != j) & (np.bitwise_count(rot[i] ^ rot[j]) <= budget)
                label = unite(label, i[near], j[near])
            a, ah, b, bh, spent, own = (x[~few] for x in (a, ah, b, bh, spent, own))
        if not len(a):
            continue
        if depth not in ones_before:
            ones = (rot >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            ones_before[depth] = np.concatenate([[0], np.cumsum(ones.astype(np.int32), dtype=np.int32)])
        cum = ones_before[depth]
        am, bm = _split(cum, a, ah), _split(cum, b, bh)
        cross = ~own
        a, ah, b, bh, spent = (
            np.concatenate(x)
            for x in (
                (a, am, a, am[cross]), (am, ah, am, ah[cross]), (b, bm, bm, b[cross]), (bm, bh, bh, bm[cross]),
                (spent, spent, spent + 1, spent[cross] + 1),
            )
        )
        keep = (ah > a) & (bh > b) & (spent <= budget)
        if keep.any():
            waiting.append((tuple(x[keep] for x in (a, ah, b, bh, spent)), depth + 1))
    return label


def _join_task(budget: int):
    """mapInArrow function over rows sorted by node pair, side and leaf."""
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def forest(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        rot, rep = rows["rot"].view(np.uint64), rows["rep"]
        new = np.flatnonzero(_changes(rows)) if len(rot) else np.array([], int)
        end = np.append(new[1:], len(rot))
        sides = np.concatenate([[0], np.cumsum(rows["side"])])
        n_b = sides[end] - sides[new]
        own = rows["pa"][new] == rows["pb"][new]
        b = np.where(own, new, end - n_b)
        a_end = np.where(own, end, b)
        label = np.arange(len(rot))
        for depth in np.unique(rows["depth"][new]):
            some = (rows["depth"][new] == depth) & (a_end > new) & (end > b)
            got = join_nodes(rot, (new[some], a_end[some], b[some], end[some], rows["spent"][new][some]), int(depth), budget)
            label = np.minimum(label, got)  # depths have no leaves in common
        linked = np.flatnonzero(label != np.arange(len(rot)))
        return pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(rep[label[linked]])], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names})
            n += batch.num_rows
            if n < TASK_ROWS:
                continue
            rows = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
            last = np.flatnonzero(_changes(rows))[-1]
            if last:
                yield forest({c: v[:last] for c, v in rows.items()})
            held, n = [{c: v[last:] for c, v in rows.items()}], n - last
        if n:
            yield forest({c: np.concatenate([h[c] for h in held]) for c in held[0]})

    return run


def _changes(rows: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(rows["rot"]), bool)
    out[1:] = False
    for c in ("band", "pa", "pb", "depth"):
        out[1:] |= rows[c][1:] != rows[c][:-1]
    return out


def _masks(budget: int) -> list[tuple[int, int]]:
    return [(m, m.bit_count()) for m in range(1 << _STEP) if m.bit_count() <= budget]


def _walk_down(rows: DataFrame, budget: int) -> DataFrame:
    """One step of the walk for node pairs that are too large for a task."""
    masks = F.array(*(F.struct(F.lit(m).cast("long").alias("mask"), F.lit(n).cast("long").alias("bits")) for m, n in _masks(budget)))
    digit = F.expr(f"shiftrightunsigned(rot, cast({BITS - _STEP} - depth as int)) & {(1 << _STEP) - 1}")
    out = rows.withColumns({"digit": digit, "m": F.explode(masks)}).withColumn("other", F.col("digit").bitwiseXOR(F.col("m.mask")))
    out = out.filter(F.col("spent") + F.col("m.bits") <= budget)
    own = F.col("pa") == F.col("pb")
    first = F.when(own, F.least("digit", "other")).when(F.col("side") == 0, F.col("digit")).otherwise(F.col("other"))
    second = F.when(own, F.greatest("digit", "other")).when(F.col("side") == 0, F.col("other")).otherwise(F.col("digit"))
    side = F.when(own, (F.col("digit") > F.col("other")).cast("long")).otherwise(F.col("side"))
    deeper = lambda c, d: F.shiftleft(c, _STEP) + d
    return out.select(
        "band", deeper("pa", first).alias("pa"), deeper("pb", second).alias("pb"), (F.col("depth") + _STEP).alias("depth"),
        (F.col("spent") + F.col("m.bits")).alias("spent"), side.alias("side"), "rot", "rep",
    )


def trie_links(leaves: DataFrame, budget: int = 3, node_rows: int = NODE_ROWS) -> DataFrame:
    """``(a, b)``: edges that connect the same leaves as all pairs within
    ``budget`` bits do. ``leaves``: distinct ``fp`` with a ``rep`` each, read
    the same each time."""
    if not 0 <= budget < BITS // 8:
        raise ValueError("the budget leaves no band of eight bits")
    bands = budget + 1
    width = BITS // bands
    most = max(node_rows, 2 * -(-leaves.count() >> width))
    turned = F.array(*(
        F.struct(F.lit(k).cast("long").alias("band"), _rotate("fp", k * width).alias("rot")) for k in range(bands)
    ))
    prefix = F.shiftrightunsigned("rot", BITS - width)
    rows = leaves.select("rep", F.inline(turned)).select(
        "band", prefix.alias("pa"), prefix.alias("pb"), F.lit(width).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("spent"), F.lit(0).cast("long").alias("side"), "rot", "rep",
    )
    pair, ready = ["band", "pa", "pb", "depth"], []
    while True:
        sizes = rows.groupBy(pair).agg(F.count("*").alias("n"), F.sum("side").alias("n_b"))
        alive = (F.col("pa") == F.col("pb")) | F.col("n_b").between(1, F.col("n") - 1)
        large = scratch_table(sizes.filter(alive & (F.col("n") > most) & (F.col("depth") + _STEP <= BITS)).select(pair), "large-nodes")
        if large.isEmpty():
            ready.append(rows)
            break
        table = broadcast_if_small(large)
        ready.append(rows.join(table, pair, "left_anti"))
        rows = scratch_table(_walk_down(rows.join(table, pair, "left_semi"), budget), "walk")
    units = ready[0]
    for more in ready[1:]:
        units = units.unionByName(more)
    # A split node's child can have the same prefix number as a node that was not split: depth tells them apart.
    dealt = units.repartition(*pair).sortWithinPartitions(*pair, "side", "rot")
    return dealt.mapInArrow(releasing(_join_task(budget)), "a long, b long")


def _rotate(col: str, by: int):
    if not by:
        return F.col(col)
    return F.shiftleft(col, by).bitwiseOR(F.shiftrightunsigned(col, BITS - by))


def near_groups(
    docs: DataFrame, width: int = 3, budget: int = 3, node_rows: int = NODE_ROWS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 lowercase hex
    digits), component_id (the smallest doc_id that links reach).

    Fingerprints link at ``budget`` or fewer differing bits. A null or empty
    text has fingerprint zero and links like any other. Rows that repeat a
    doc_id are fingerprinted one by one; rows without a doc_id get the
    component of their fingerprint, null if no row with an id has it. An empty
    table gives an empty table; other columns are not looked at.
    """
    prints = scratch_table(fingerprints(docs, width, id_col, text_col), "fingerprints", TEXT_ROWS)
    reps = scratch_table(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "leaves")
    known = reps.filter("rep IS NOT NULL")
    groups = scratch_table(connected_components(trie_links(known, budget, node_rows)), "components")
    named = scratch_table(
        reps.join(broadcast_if_small(groups), F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id")),
        "named",
    )
    return prints.join(broadcast_if_small(named), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def text_digest(text_col: str):
    """What tells rows of one doc_id apart."""
    return F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))


def keep_one(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, one row of each group. ``rows``, read the
    same each time: doc_id, sha (``text_digest``), component (not null) of each row.

    Among rows with a doc_id the one with the smallest doc_id stays, then that
    with the smallest digest. Rows without a doc_id never take the place of
    rows with one, nor go because of them; of those, one of each group stays.
    """
    first = rows.groupBy("component", F.col("doc_id").isNull().alias("nameless")).agg(F.min(F.struct("doc_id", "sha")).alias("kept"), F.count("*").alias("n"))
    several = scratch_table(first.filter("n > 1"), "near-groups")
    mine = F.struct("doc_id", "sha")
    groups = broadcast_if_small(several)
    met = rows.withColumn("nameless", F.col("doc_id").isNull()).join(groups, ["component", "nameless"])
    out = met.select("doc_id", "sha", mine.eqNullSafe(F.col("kept")).alias("stays")).groupBy("doc_id", "sha", "stays").count()
    # Rows that go, and survivors that equal another row in id and text.
    marks = out.filter("NOT stays OR count > 1").select(F.col("doc_id").alias("__mark_id"), F.col("sha").alias("__mark_sha"), "stays")
    marks = scratch_table(marks, "near-copies")
    marked = docs.withColumns({"__row_id": F.col(id_col).cast("long"), "__row_sha": text_digest(text_col)})
    same = F.col("__row_sha").eqNullSafe(F.col("__mark_sha")) & F.col("__row_id").eqNullSafe(F.col("__mark_id"))
    rest = marked.join(broadcast_if_small(marks), same, "left_anti")
    twins = scratch_table(marks.filter("stays"), "near-twins")
    if not twins.isEmpty():
        again = marked.join(broadcast_if_small(twins), same, "left_semi")
        rest = rest.unionByName(again.dropDuplicates(["__row_id", "__row_sha"]))
    return rest.drop("__row_id", "__row_sha")


def drop_near_copies(
    docs: DataFrame, width: int = 3, budget: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with all its columns, one document of each group of linked
    fingerprints, chosen by ``keep_one``: rows are told apart by doc_id and text."""
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(text_col).alias("sha"), F.col(text_col).cast("string").alias("text"))
    keyed = scratch_table(keyed.withColumn("row", F.monotonically_increasing_id()), "near-rows")
    prints = fingerprints(keyed, width, "row", "text").withColumnRenamed("doc_id", "row")
    rows = keyed.select("doc_id", "sha", "row").join(prints, "row").select("doc_id", "sha", "fp")
    rows = scratch_table(rows, "fingerprints")
    # Links are between fingerprints, so rows without a doc_id have them too.
    reps = scratch_table(rows.select("fp").distinct().withColumn("rep", F.monotonically_increasing_id()), "leaves")
    groups = scratch_table(connected_components(trie_links(reps, budget)), "components")
    named = reps.join(broadcast_if_small(groups), F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component"))
    named = scratch_table(named, "named")
    rows = scratch_table(rows.join(broadcast_if_small(named), "fp").select("doc_id", "sha", "component"), "near-components")
    return keep_one(docs, rows, id_col, text_col)
