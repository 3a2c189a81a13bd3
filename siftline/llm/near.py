"""Near copies by fingerprints, confirmed and completed by exact similarity.

Fingerprints of ``simhash`` over the same shingles meet in the trie self-join;
each link is confirmed by the Jaccard similarity of the two shingle sets. That
finds the closest copies and collapses dense groups. At a similarity of 0.8
fingerprints of 64 bits differ in about ten, and a budget that wide leaves the
trie bands of four bits, where it has to compare nearly all pairs. So the rest
meets by shingles: two sets with a similarity of
``least`` or more share one of the first ``n - ceil(least * n) + 1`` members of
each, in any order that holds for all sets, and their first common member
leaves enough of both behind it. So no similar pair fails to meet. Pairs whose
fingerprints are much too far apart for the similarity are left out before sets
are compared, which loses about one in 300,000 of them; ``far=None`` loses
none. The order puts shingles that are frequent in a
sample last, which keeps common passages out of these keys; the sample changes
the cost and not the result.

A dense group is not paired out: sets that share a key are first compared with
one of them, round by round, and pairs that confirmed links connect already are
skipped. What is left apart is compared pair by pair, by sketches first: the
members of a set flip bits, so two sets differ in at least as many members as
their sketches differ in bits. Only pairs that this leaves possible become rows,
and none that is similar enough is lost by it. Sets themselves are not
kept: they are made again for the texts alone that are in a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b
from math import acos, ceil, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import broadcast_if_small, drop_scratch, releasing, scratch_table
from siftline.llm.components import link_by_keys
from siftline.llm.simhash import BITS, keep_one, majority, shingle_hashes, text_digest, trie_links

WIDTH, LEAST = 5, 0.8
#: Bits in which fingerprints may differ to meet in the trie.
BUDGET = 3
#: Standard deviations above the expected number of differing bits from which a
#: pair is left out, about one in 300,000 of those at just ``least``, and the
#: smallest set whose fingerprint is trusted for that. ``far=None`` compares
#: the sets of all candidates and leaves out none.
FAR, TRUSTED_SIZE = 4.5, 64
#: Longs of a sketch. Its bits tell sets of up to about as many members well apart; for larger ones it rules out less.
SKETCH_LONGS = 16
#: Rows whose shingles are counted for the order, about, and how many frequent shingles it knows at most.
SAMPLE_DOCS, FREQUENT = 8000, 100_000
_SLICE = 512
#: Rows of texts, and of pairs of sets, that go to Python at once.
TEXT_ROWS, SET_ROWS = 512, 128


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct hashed shingles of a text, ascending."""
    return np.unique(shingle_hashes(text, width))


def key_count(n: int, least: float) -> int:
    return n - ceil(least * n - 1e-9) + 1 if n else 0


def sketch(members: np.ndarray) -> np.ndarray:
    """Bits that each member of a set flips."""
    at = members >> np.uint64(64 - (BITS * SKETCH_LONGS - 1).bit_length())
    odd = (np.bincount(at.astype(np.int64), minlength=BITS * SKETCH_LONGS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(text_col).alias("sha"), text.alias("text"))


def frequent_shingles(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of the shingles that several sampled texts have."""
    share = min(1.0, SAMPLE_DOCS / max(1, rows.count()))
    draw = F.pmod(F.xxhash64(F.lit("near"), "sha"), F.lit(1 << 20)) / float(1 << 20)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                sets = [shingles(t.as_py(), width) for t in batch.column(0).slice(at, _SLICE).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])

    counts = rows.filter(draw < share).select("text").mapInArrow(releasing(each), "h long").groupBy("h").count()
    top = counts.filter("count > 2").orderBy(F.desc("count"), "h").limit(FREQUENT).collect()
    order = np.array([r[0] for r in top], np.int64).view(np.uint64), np.array([r[1] for r in top], np.int64)
    by_hash = np.argsort(order[0])
    return order[0][by_hash], order[1][by_hash]


def ordered_keys(members: np.ndarray, known: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` members: those not known as frequent, by hash, then the others by count."""
    if not len(known):
        return members[:n]
    at = np.minimum(np.searchsorted(known, members), len(known) - 1)
    frequent = known[at] == members
    rare = members[~frequent][:n]
    if len(rare) == n:
        return rare
    rest, often = members[frequent], count[at[frequent]]
    return np.concatenate([rare, rest[np.lexsort((rest, often))][: n - len(rare)]])


def described(rows: DataFrame, width: int, least: float) -> DataFrame:
    """doc_id, sha, digest of the set, size, fp, keys, sketch of each row."""
    order = rows.sparkSession.sparkContext.broadcast(frequent_shingles(rows, width))
    kinds = pa.schema([
        ("doc_id", pa.int64()), ("sha", pa.binary()), ("digest", pa.binary()), ("size", pa.int32()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64())),
        ("sketch", pa.list_(pa.int64())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = order.value
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                some, out = batch.slice(at, _SLICE), []
                for t in some.column(2).cast(pa.binary()):
                    s = shingles(t.as_py(), width)
                    fp = np.array(majority(s), np.uint64).view(np.int64)
                    keys = ordered_keys(s, known, count, key_count(len(s), least)).view(np.int64)
                    out.append((blake2b(s.tobytes(), digest_size=16).digest(), len(s), int(fp), keys, sketch(s)))
                cols = [pa.array(c, kinds.field(k + 2).type) for k, c in enumerate(zip(*out))]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1).cast(pa.binary()), *cols], schema=kinds)

    return rows.mapInArrow(releasing(run), "doc_id long, sha binary, digest binary, size int, fp long, keys array<long>, sketch array<long>")


def shingle_sets(rows: DataFrame, nodes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``(node, members)`` of the nodes of ``wanted``, written; members are the hashes,
    as bytes. ``nodes`` has node, doc_id, sha and twins (whether several rows
    are equal in both) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                some = batch.slice(at, _SLICE)
                sets = [shingles(t.as_py(), width).tobytes() for t in some.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.binary())], names=["node", "members"])

    some = scratch_table(nodes.join(broadcast_if_small(wanted), "node", "left_semi").select("node", "doc_id", "sha", "twins"), "near-wanted")
    table = broadcast_if_small(some).select("node", F.col("doc_id").alias("its_id"), F.col("sha").alias("its_sha"), "twins")
    met = rows.join(table, F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("sha") == F.col("its_sha")))
    once = met.filter("NOT twins").select("node", "text")
    if not some.filter("twins").isEmpty():
        once = once.unionByName(met.filter("twins").select("node", "text").dropDuplicates(["node"]))
    sets = scratch_table(once.mapInArrow(releasing(run), "node long, members binary"), "near-sets", TEXT_ROWS)
    drop_scratch(some)
    return sets


def verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are similar enough, written: the sets go at once. ``pairs`` and ``nodes`` give the same rows each time."""
    wanted = scratch_table(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-partners")
    sets = shingle_sets(rows, nodes, wanted, width)
    table = broadcast_if_small(sets)
    side = lambda c: table.select(F.col("node").alias(c), F.col("members").alias(f"in_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= least * (len(x) + len(y) - common) - 1e-9)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(mask) for k in (0, 1)], names=["a", "b"])

    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "in_a", "in_b")
    out = scratch_table(met.mapInArrow(releasing(run), "a long, b long"), "near-links", SET_ROWS)
    drop_scratch(wanted, sets)
    return out


def fingerprint_pairs(nodes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``(a, b)``: pairs of nodes that connect all whose fingerprints the trie
    join links. Nodes with equal fingerprints hang on one of them."""
    leaves = scratch_table(nodes.groupBy("fp").agg(F.min("node").alias("rep"), F.count("*").alias("n")), "near-leaves")
    several = leaves.filter("n > 1").select("fp", "rep")
    equal = nodes.select("fp", "node").join(several, "fp").filter("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    return trie_links(leaves.select("fp", "rep"), budget).unionByName(equal)


def enough(least: float, far: float | None = FAR) -> Callable[[Column, Column], Column]:
    """Whether what follows a common key in both sets, it included, can be
    enough, which is true for the first common key of any similar pair, and
    (unless ``far`` is None) whether their fingerprints, which are of distinct
    shingles as the similarity is, are near enough for it."""
    share = acos(2 * least / (1 + least)) / pi
    bits = BITS if far is None else ceil(BITS * share + far * (BITS * share * (1 - share)) ** 0.5)

    def fits(p: Column, q: Column) -> Column:
        behind = F.least(p["size"] - p["pos"], q["size"] - q["pos"])
        small = F.least(p["size"], q["size"]) < TRUSTED_SIZE
        return (behind >= F.ceil((p["size"] + q["size"]) * (least / (1 + least)) - 1e-9)) & (small | (F.bit_count(p["fp"].bitwiseXOR(q["fp"])) <= bits))

    return fits


def alike_enough(least: float) -> Callable[[Column, Column], Column]:
    """Whether two sets, of which ``size`` and ``sketch`` are known, can be similar enough."""

    def fits(p: Column, q: Column) -> Column:
        apart = sum((F.bit_count(F.get(p["sketch"], F.lit(k)).bitwiseXOR(F.get(q["sketch"], F.lit(k)))) for k in range(SKETCH_LONGS)), F.lit(0))
        return apart <= (p["size"] + q["size"]) * ((1 - least) / (1 + least)) + 1e-6

    return fits


def shared_keys(nodes: DataFrame) -> DataFrame:
    """``(key, node, at)`` of the keys that several nodes have; ``at`` is size, pos and fp."""
    keyed = nodes.select("node", "size", "fp", F.posexplode("keys").alias("pos", "key"))
    shared = scratch_table(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "near-shared")
    met = keyed.join(broadcast_if_small(shared), "key").select("key", "node", F.struct("size", "pos", "fp").alias("at"))
    met = scratch_table(met, "near-met")
    drop_scratch(shared)
    return met


def drop_near_copies(docs: DataFrame, width: int = WIDTH, least: float = LEAST, budget: int = BUDGET, far: float | None = FAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, one document of each group that links of
    ``least`` or more Jaccard similarity over runs of ``width`` words connect,
    chosen by ``keep_one``: rows are told apart by doc_id and text, whose nulls
    and repeats it defines. A null text counts as empty; texts without words
    are copies of each other. An empty table gives an empty table."""
    rows = _rows(docs, id_col, text_col)
    made = scratch_table(described(rows, width, least).withColumn("uid", F.monotonically_increasing_id()), "near-all", TEXT_ROWS)
    same = scratch_table(made.groupBy("digest").agg(F.min("uid").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "near-same")
    named = made.join(broadcast_if_small(same), "digest", "left").withColumn("node", F.coalesce("first", "uid"))
    nodes = named.filter("uid = node")
    keyed = shared_keys(nodes.select("node", "size", "fp", "keys"))
    close = scratch_table(fingerprint_pairs(nodes.select("node", "fp"), budget), "near-close")
    twins = made.groupBy("doc_id", "sha").agg(F.count("*").alias("n")).filter("n > 1")
    twins = scratch_table(twins.select(F.col("doc_id").alias("twin_id"), F.col("sha").alias("twin_sha")), "near-twin-rows")
    own = F.col("doc_id").eqNullSafe(F.col("twin_id")) & (F.col("sha") == F.col("twin_sha"))
    sketches = nodes.select("node", F.struct("size", "sketch").alias("more"))
    nodes = nodes.select("node", "doc_id", "sha").join(broadcast_if_small(twins), own, "left").withColumn("twins", F.col("twin_sha").isNotNull())
    confirm = lambda pairs: verified(pairs, rows, nodes, width, least)
    groups = link_by_keys(keyed, confirm, confirm(close), enough(least, far), more=sketches, closer=alike_enough(least))
    mine = named.select("doc_id", "sha", "node").join(broadcast_if_small(groups), "node", "left")
    mine = scratch_table(mine.select("doc_id", "sha", F.coalesce("component", "node").alias("component")), "near-components")
    drop_scratch(made, same, keyed, close, twins)
    return keep_one(docs, mine, id_col, text_col)
