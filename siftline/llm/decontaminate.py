"""Benchmark decontamination by exact runs of words.

Texts are normalised alike: A-Z lower-cased, words are runs of digits, letters
and characters outside ASCII. A window is ``window`` consecutive words of a
benchmark item, or all words of a shorter one. The windows' hashes are a sorted
array with a bit table in front, which is broadcast; a task hashes the words of
many documents at once, rolls them to windows of each length, and looks these
up. A hash that is met is verified on the words themselves, so nothing counts
that is not equal. Documents are not shuffled.

A broadcast holds ``BLOCK_WORDS`` benchmark words at most. A larger benchmark is
dealt into blocks that are scanned for one after the other, and what each block
finds in a document is merged. Items of any length are cut into overlapping
parts first, which have the same windows.

Defined results: a null or empty text has no words and is not hit; an item
without words has no window; items that share an id are one item with the
windows of all; an item without an id counts, and is spelt ``''``; repeated
documents are scanned one by one; empty tables give no hits or no rows; columns
that are not named are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from siftline.llm.common import drop_scratch, releasing, scratch_table

WINDOW = 10
#: Benchmark words in a broadcast, about, and in a part of an item besides the overlap.
BLOCK_WORDS, PART_WORDS = 1_000_000, 5_000
#: Bytes of text that are looked at together (whole documents), and that are hashed at a time.
SLICE_BYTES, HASH_BYTES = 1 << 20, 1 << 18
FOUND = "n_words long, runs array<struct<first:long,last:long,start:long,end:long>>, items array<string>"
_RUN = pa.struct([(c, pa.int64()) for c in ("first", "last", "start", "end")])
_FOUND = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("items", pa.list_(pa.string()))])
#: Bytes as they count: a lower-cased word byte, or a blank.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ODD, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(_ODD, HASH_BYTES), _powers(pow(_ODD, -1, 1 << 64), HASH_BYTES)


class Words:
    """The words of texts that lie one after the other in ``raw``; ``offsets``
    are the texts' bounds. Arrays start, end, doc and hash have one entry a word."""

    def __init__(self, raw: bytes, offsets: np.ndarray):
        self.plain = raw.translate(_PLAIN)
        kind = np.frombuffer(self.plain, np.uint8) != 32
        edge = np.zeros(len(kind) + 1, bool)
        edge[offsets] = True
        before, after = np.concatenate([[False], kind[:-1]]), np.concatenate([kind[1:], [False]])
        self.start = np.flatnonzero(kind & (~before | edge[:-1]))
        self.end = np.flatnonzero(kind & (~after | edge[1:])) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1

    @cached_property
    def hash(self) -> np.ndarray:
        """A polynomial in each word's bytes, by differences of prefix sums."""
        out, at = np.empty(len(self.start), np.uint64), 0
        while at < len(out):
            base = self.start[at]
            to = int(np.searchsorted(self.end, base + HASH_BYTES, side="right"))
            if to == at:  # one word of that many bytes
                out[at], to = xxh64_intdigest(self.plain[base : self.end[at]]), at + 1
            else:
                size = self.end[to - 1] - base
                sums = np.zeros(size + 1, np.uint64)
                np.cumsum(np.frombuffer(self.plain, np.uint8, size, base).astype(np.uint64) * _UP[:size], out=sums[1:])
                first = self.start[at:to] - base
                out[at:to] = (sums[self.end[at:to] - base] - sums[first]) * _DOWN[first]
            at = to
        out ^= out >> np.uint64(31)
        return out * _MIX

    def windows(self, n: int) -> np.ndarray:
        """The hash of the ``n`` words from each word on, whatever text they are of."""
        h = self.hash
        m = max(0, len(h) - n + 1)
        out = np.zeros(m, np.uint64)
        for k, p in enumerate(_UP[1 : n + 1]):
            out += h[k : k + m] * p
        return out

    def text(self, first: int, n: int) -> bytes:
        """``n`` words, a blank between."""
        return b" ".join([self.plain[a:b] for a, b in zip(self.start[first : first + n].tolist(), self.end[first : first + n].tolist())])


class WindowIndex:
    """The windows of benchmark parts ``(item, normalised words)``, by length:
    sorted hashes, where the words stand in ``text``, and the items of each
    distinct window."""

    def __init__(self, parts: list[tuple[str, str]], window: int = WINDOW):
        self.items = sorted({item for item, _ in parts})
        number = {item: i for i, item in enumerate(self.items)}
        said = [words.encode() for _, words in parts]
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in said])]).astype(np.int64)
        self.text = b"".join(said)
        words = Words(self.text, offsets)
        owner = np.array([number[item] for item, _ in parts], np.int64)
        length = np.minimum(np.bincount(words.doc, minlength=len(parts)), window) if parts else np.zeros(0, int)
        self.by_length = {int(n): self._of(words, owner, length, int(n)) for n in np.unique(length) if n}

    def _of(self, words: Words, owner: np.ndarray, length: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        h = words.windows(n)
        own = np.flatnonzero((length[words.doc[: len(h)]] == n) & (words.doc[: len(h)] == words.doc[n - 1 :]))
        own = own[np.argsort(h[own], kind="stable")]
        found: dict[bytes, tuple[int, set[int]]] = {}
        rows, last = [], None
        for at, value in zip(own.tolist(), h[own].tolist()):
            if value != last:
                rows.extend(found.items())
                found, last = {}, value
            found.setdefault(self.text[words.start[at] : words.end[at + n - 1]], (at, set()))[1].add(int(owner[words.doc[at]]))
        rows.extend(found.items())
        at = np.array([r[1][0] for r in rows], np.int64)
        size = [len(r[1][1]) for r in rows]
        return h[at], words.start[at], words.end[at + n - 1], np.concatenate([[0], np.cumsum(size)]).astype(np.int64), np.array([i for r in rows for i in sorted(r[1][1])], np.int32)

    @cached_property
    def _filters(self) -> dict[int, tuple[np.uint64, np.ndarray]]:
        """For each length a table over the leading bits of hashes."""
        out = {}
        for n, (h, *_) in self.by_length.items():
            bits = len(h).bit_length() + 4
            table, shift = np.zeros(1 << bits, bool), np.uint64(64 - bits)
            table[h >> shift] = True
            out[n] = shift, table
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_filters"}

    def scan(self, raw: bytes, offsets: np.ndarray) -> list[tuple[int, list, list[str]]]:
        """For each text the number of its words, its runs of hit words (first
        and last word, code points), and the items met, sorted."""
        words, n_docs = Words(raw, offsets), len(offsets) - 1
        n_words = np.bincount(words.doc, minlength=n_docs).tolist()
        depth, met = np.zeros(len(words.start) + 1, np.int64), {}
        for n, (keys, start, end, first, items) in self.by_length.items():
            h = words.windows(n)
            shift, table = self._filters[n]
            at = np.flatnonzero(table[h >> shift])
            at = at[words.doc[at] == words.doc[at + n - 1]]
            lo, hi = np.searchsorted(keys, h[at], side="left"), np.searchsorted(keys, h[at], side="right")
            some = hi > lo
            for w, a, b in zip(at[some].tolist(), lo[some].tolist(), hi[some].tolist()):
                said = words.text(w, n)
                for k in range(a, b):
                    if self.text[start[k] : end[k]] == said:
                        depth[w] += 1
                        depth[w + n] -= 1
                        met.setdefault(int(words.doc[w]), set()).update(items[first[k] : first[k + 1]].tolist())
        hit = np.cumsum(depth[:-1]) > 0
        # A run ends where its text does.
        begins = hit & ~(np.concatenate([[False], hit[:-1]]) & (words.doc == np.concatenate([[-1], words.doc[:-1]])))
        ends = hit & ~(np.concatenate([hit[1:], [False]]) & (words.doc == np.concatenate([words.doc[1:], [-1]])))
        runs: dict[int, list] = {}
        base = np.concatenate([[0], np.cumsum(n_words)])
        for a, b in zip(np.flatnonzero(begins).tolist(), np.flatnonzero(ends).tolist()):
            d = int(words.doc[a])
            o = int(offsets[d])
            chars = [len(raw[o:x].decode()) for x in (int(words.start[a]), int(words.end[b]))]
            runs.setdefault(d, []).append((a - int(base[d]), b - int(base[d]), *chars))
        return [(n, runs.get(d, []), [self.items[i] for i in sorted(met.get(d, ()))]) for d, n in enumerate(n_words)]


def benchmark_parts(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, words, n)``: normalised words of parts of items, which overlap
    so that they have the windows of the whole item and no others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = text.as_py().encode().translate(_PLAIN).decode().split(" ")
                words = [w for w in words if w]
                for at in range(0, max(1, len(words) - window + 1), PART_WORDS):
                    part = words[at : at + PART_WORDS + window - 1]
                    rows.append((item, " ".join(part), len(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], names=["item", "words", "n"])

    said = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return said.mapInArrow(run, "item string, words string, n long").filter("n > 0")


def window_blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, **cols: str) -> Iterator[WindowIndex]:
    """Indexes of the benchmark's windows, each of about ``block_words`` words."""
    parts = scratch_table(benchmark_parts(benchmark, window, **cols).distinct(), "benchmark-parts")
    blocks = -(-(parts.agg(F.sum("n")).first()[0] or 0) // block_words)
    for k in range(max(1, blocks)):
        mine = parts.filter(F.pmod(F.xxhash64("words"), F.lit(max(1, blocks))) == k)
        yield WindowIndex(sorted((r.item, r.words) for r in mine.collect()), window)  # bounded by block_words
    drop_scratch(parts)


def found_column(text: Column, index: WindowIndex, spark) -> Column:
    """A struct ``FOUND`` for each text."""
    sent = spark.sparkContext.broadcast(index)

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows: list = []
            size = np.fromiter((len(t.as_buffer()) for t in texts), np.int64, len(texts)) if len(texts) else np.zeros(0, np.int64)
            bounds, at = np.concatenate([[0], np.cumsum(size)]), 0
            while at < len(texts):
                to = max(at + 1, bisect_left(bounds, bounds[at] + SLICE_BYTES))
                to = min(to, len(texts))
                raw = b"".join([t.as_buffer().to_pybytes() for t in texts.slice(at, to - at)])
                rows += sent.value.scan(raw, bounds[at : to + 1] - bounds[at])
                at = to
            yield pa.array([{"n_words": n, "runs": [dict(zip(("first", "last", "start", "end"), r)) for r in runs], "items": items} for n, runs, items in rows], _FOUND)

    return F.arrow_udf(releasing(find), FOUND)(text)


def _filled(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, text_col: str = "text", **cols: str) -> DataFrame:
    """``docs`` with all its columns and ``found``: n_words, runs (stretches of
    hit words: first and last word, start and end in code points) and items
    (ids as strings, sorted). ``cols``: id_col and text_col of the benchmark,
    as ``item_id`` and ``item_text``."""
    spark = docs.sparkSession
    names = {"id_col": cols.get("item_id", "item_id"), "text_col": cols.get("item_text", "text")}
    blocks = window_blocks(benchmark, window, block_words, **names)
    index, more = next(blocks), next(blocks, None)
    if more is None:
        return docs.withColumn("found", found_column(_filled(F.col(text_col)), index, spark))
    rows = scratch_table(docs.withColumn("__row", F.monotonically_increasing_id()), "scanned")
    parts = None
    while index is not None:
        one = rows.select("__row", found_column(_filled(F.col(text_col)), index, spark).alias("f")).filter(F.size("f.items") > 0)
        one = scratch_table(one.select("__row", "f.runs", "f.items"), "block-hits")
        parts = one if parts is None else parts.unionByName(one)
        index, more = more, next(blocks, None)
    # At most one row for each document and block.
    both = parts.groupBy("__row").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    both = both.select("__row", _joined("runs").alias("runs"), "items")
    plain = rows.withColumn("n", found_column(_filled(F.col(text_col)), WindowIndex([], window), spark)["n_words"])
    filled = (F.coalesce(c, F.array().cast(parts.schema[c].dataType)).alias(c) for c in ("runs", "items"))
    found = F.struct(F.col("n").alias("n_words"), *filled)
    return plain.join(both, "__row", "left").withColumn("found", found).drop("__row", "n", "runs", "items")


def _joined(runs: str) -> Column:
    """Sorted runs, those that overlap or touch drawn together."""

    def add(done: Column, run: Column) -> Column:
        last = F.element_at(done, -1)
        longer = last.withField("last", F.greatest(last["last"], run["last"])).withField("end", F.greatest(last["end"], run["end"]))
        touching = (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["last"] + 1 >= run["first"])
        return F.when(touching, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(run)))

    return F.aggregate(runs, F.slice(F.col(runs), 1, 0), add)


def hit_words(found: Column) -> Column:
    """Number of hit words."""
    return F.aggregate(found["runs"], F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", **cols: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, items, runs, contaminated."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = find_overlaps(texts, benchmark, window, block_words, **cols)
    n_hit = hit_words(F.col("found"))
    return out.select("doc_id", "found.n_words", n_hit.alias("n_hit"), "found.items", "found.runs", (n_hit > 0).alias("contaminated"))


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", **cols: str) -> DataFrame:
    """``docs`` with all its columns, the runs of hit words cut out of its texts."""
    out, text, runs = find_overlaps(docs, benchmark, window, text_col=text_col, **cols), F.col(text_col).cast("string"), F.col("found.runs")
    kept = F.transform(F.sequence(F.lit(0), F.size(runs)), lambda i: F.substring(
        text, F.coalesce(F.get(runs, i - 1)["end"] + 1, F.lit(1)).cast("int"), (F.coalesce(F.get(runs, i)["start"], F.length(text)) - F.coalesce(F.get(runs, i - 1)["end"], F.lit(0))).cast("int"),
    ))
    return out.withColumn(text_col, F.when(F.size(runs) > 0, F.array_join(kept, "")).otherwise(text)).drop("found")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, most: float = 0.0, window: int = WINDOW, text_col: str = "text", **cols: str) -> DataFrame:
    """``docs`` with all its columns, without those of whose words more than the share ``most`` is hit."""
    out = find_overlaps(docs, benchmark, window, text_col=text_col, **cols)
    return out.filter(hit_words(F.col("found")) <= most * F.col("found.n_words")).drop("found")
