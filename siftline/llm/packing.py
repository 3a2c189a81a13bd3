"""Packing by best-fit decreasing.

A document longer than a window is first cut into full windows; what is left
is an item of 1 to ``window`` tokens. Best fit treats items of one length
alike, so it runs over the histogram of lengths, at most ``window`` rows
whatever the corpus: a segment tree over remaining capacity finds the tightest
open windows, and runs of equal items go to runs of equal windows at once. The
plan that comes out says, for each length, which ranks go to which windows.
Spark counts the lengths, ranks the items of each length and looks each rank
up in the plan.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import BoundedTable, batches_of, doc_texts, releasing, scratch_table

WINDOW = 4096
#: Items of one length are ranked in buckets of about this many.
RANK_ROWS = 20_000
#: Bytes of text that are cut into chunks at a time, about (whole documents).
SLICE_BYTES = 8 << 20
#: Rows that go to Python at once.
TEXT_ROWS = 2500
#: How the tokenizer splits texts into words, in its own notation.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile(rf"([{re.escape(punctuation)}]*)([^\W\d_]*)([{re.escape(punctuation)}]*)").fullmatch
_COMBINING = "[\u0300-\u036f]"
#: ASCII punctuation behind a letter and before white space is a word of its own, whatever chunk it
#: stands in. Not apostrophes, which start contractions, nor what special tokens are written with.
_TAIL = r'([A-Za-z])([.,;:!?)"\]]+)(?: |$)'


class CapacityTree:
    """Segment tree over remaining capacity; a leaf holds runs of windows
    ``(first window, count)`` with exactly that much room."""

    def __init__(self, window: int):
        self.base = 1 << window.bit_length()
        self.full = bytearray(2 * self.base)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def put(self, room: int, first: int, count: int) -> None:
        if room and count:
            self.runs[room].append((first, count))
            node = room + self.base
            while node and not self.full[node]:
                self.full[node] = 1
                node >>= 1

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        node = room + self.base
        if not self.runs[room]:
            self.full[node] = 0
            while (node := node >> 1) and not (self.full[2 * node] or self.full[2 * node + 1]):
                self.full[node] = 0
        return run

    def tightest(self, size: int) -> int | None:
        """The least room of at least ``size`` that some window has."""
        node = size + self.base
        if self.full[node]:
            return size
        while node > 1:
            if not node & 1 and self.full[node + 1]:
                node += 1
                while node < self.base:
                    node = 2 * node + (not self.full[2 * node])
                return node - self.base
            node >>= 1
        return None


def best_fit_plan(histogram: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """Best-fit decreasing over ``{length: count}``. Rows (length, first rank,
    count, first window, offset): rank ``first rank + i`` goes to window
    ``first window + i`` at ``offset``. The outcome is that of placing the
    items one by one."""
    tree, plan, windows = CapacityTree(window), [], 0
    for size in sorted(histogram, reverse=True):
        rank, left = 0, histogram[size]
        while left:
            room = tree.tightest(size)
            if room is None:
                # With no window that fits, each new one takes all it can before the next is opened.
                room, first = window, windows
                count = -(-left // (window // size))
                windows += count
            else:
                first, count = tree.take(room)
            each = room // size
            whole = min(count, left // each)
            for k in range(each if whole else 0):
                plan.append((size, rank, whole, first, window - room + k * size))
                rank += whole
            left -= whole * each
            tree.put(room - each * size, first, whole)
            if whole < count and left:
                # Fewer items are left than the next window takes.
                for k in range(left):
                    plan.append((size, rank, 1, first + whole, window - room + k * size))
                    rank += 1
                tree.put(room - left * size, first + whole, 1)
                whole, left = whole + 1, 0
            tree.put(room, first + whole, count - whole)
    return np.array(plan, dtype=np.int64).reshape(-1, 5)


class WordTable:
    """Ids of whole texts by way of their distinct blank-separated chunks.

    The tokenizer drops white space and no token crosses it, so the ids of
    chunks join to those of the text. ASCII letters are lower-cased first, as
    the tokenizer would, which leaves fewer chunks; not in texts with combining
    marks, for which composing comes before lower-casing. Where the tokenizer
    cuts words as known, punctuation behind words becomes a chunk too, so a
    word is one chunk with and without it.

    Most chunks are a run of letters with ASCII punctuation around it. The
    tokenizer takes such runs as words of their own, and the last token of a
    word is marked as its end, so many of them are encoded as one text with
    blanks between and told apart by these marks. If the marks don't come out
    one for each, and for all other chunks, each is encoded by itself.
    """

    def __init__(self, tokenizer_path: str, table_limit: int = 80_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_path)
        self.ends = self._ends()
        self.lowers = [self.tok.encode(t, add_special_tokens=False).ids for t in ("AZ", "az")]
        self.lowers = self.lowers[0] == self.lowers[1]
        self.table = BoundedTable(self._ids, table_limit)

    def _ends(self) -> np.ndarray:
        """Which ids end a word; none, so that no two words are encoded
        together, if the tokenizer marks no ends or cuts words another way."""
        ends, model = np.zeros(self.tok.get_vocab_size(), bool), self.tok.model
        suffix = getattr(model, "end_of_word_suffix", None)
        if suffix and WORDS in repr(self.tok.pre_tokenizer):
            for i in range(len(ends)):
                ends[i] = self.tok.id_to_token(i).endswith(suffix)
        return ends

    @staticmethod
    def _words(chunk: str) -> tuple[str, ...]:
        """The chunk's words if it is punctuation, letters, punctuation, of which any may lack; else none."""
        if chunk.isascii() and chunk.isalpha():
            return (chunk,)
        met = _PLAIN(chunk)
        if not met or "<|" in chunk:
            return ()
        lead, core, tail = met.groups()
        # Not letters alone, or what may be a contraction.
        if not core.isalpha() and core or (lead and core and lead[-1] == "'"):
            return ()
        # Lower-casing may leave a combining mark, which joins what follows it.
        if len(low := core.lower()) != len(core) or core and not low.isalpha():
            return ()
        return tuple([w for w in (lead, core, tail) if w])

    def _ids(self, chunks: list[str]) -> list[bytes]:
        parts = [self._words(c) for c in chunks]
        known = self.table.new.get
        words = {w: known(w) for many in parts for w in many}
        for some in batches_of((w for w, v in words.items() if v is None), 2000):
            ids = np.array(self.tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) == len(some) and ends[-1] == 4 * len(ids):
                raw, ends = ids.tobytes(), ends.tolist()
                words.update(zip(some, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends))))
            else:
                words.update((w, self._alone(w)) for w in some)
        return [b"".join([words[w] for w in many]) if many else self._alone(c) for c, many in zip(chunks, parts)]

    def _alone(self, chunk: str) -> bytes:
        return np.array(self.tok.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit numbers.

        Only the distinct chunks of the texts are looked up; their ids are then
        laid out by position in arrays."""
        plain = pc.replace_substring(self._plain(texts), "\n", " ")
        if self.ends.any():
            plain = pc.replace_substring_regex(plain, _TAIL, r"\1 \2 ")
        cut = pc.split_pattern(plain, " ")
        coded = cut.values.slice(cut.offsets[0].as_py(), cut.offsets[-1].as_py() - cut.offsets[0].as_py()).dictionary_encode()
        (found,) = self.table.look_up([coded.dictionary.to_pylist()])
        # Positions in a slice's ids fit in 32 bits, unless a single text is very long.
        kind = np.int32 if plain.nbytes < 1 << 28 else np.int64
        size = np.fromiter(map(len, found), kind, len(found)) // 4
        first, pool = np.cumsum(size, dtype=kind) - size, np.frombuffer(b"".join(found), "<u4")
        codes = coded.indices.to_numpy()
        n = size[codes]
        ends = np.concatenate([np.zeros(1, kind), np.cumsum(n, dtype=kind)])
        at = np.repeat(first[codes] - ends[:-1], n)
        at += np.arange(ends[-1], dtype=kind)
        ids = pool[at]
        bounds = ends[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
            yield ids[a:b].tobytes()

    def _plain(self, texts: pa.Array) -> pa.Array:
        if not self.lowers:
            return texts
        marked = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, _COMBINING))
        return pc.if_else(marked, texts, pc.ascii_lower(texts))


@lru_cache(maxsize=2)
def word_table(tokenizer_path: str) -> WordTable:
    """One table for each tokenizer and Python worker."""
    return WordTable(tokenizer_path)


def cut_pieces(
    docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Tokenise whole texts, add ``end_id`` and cut: doc_id, start, length,
    ids_crc32, doc_tokens, and ids if asked for. Each document gives its full
    windows and one remainder; an empty or null text gives the end id alone."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    if with_ids:
        fields, schema = [*fields, ("ids", pa.list_(pa.int32()))], f"{schema}, ids array<int>"
    kinds = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_table(tokenizer_path), struct.pack("<I", end_id)
        for batch in batches:
            step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
            for part in range(0, batch.num_rows, step):
                some = batch.slice(part, step)
                rows = []
                for doc_id, raw in zip(some.column(0).to_pylist(), words.encode(some.column(1))):
                    raw += end
                    n = len(raw) // 4
                    for at in range(0, n, window):
                        piece = raw[4 * at : 4 * (at + window)]
                        row = (doc_id, at, len(piece) // 4, zlib.crc32(piece), n)
                        rows.append((*row, np.frombuffer(piece, "<i4")) if with_ids else row)
                cols = list(zip(*rows)) or [[]] * len(fields)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, fields)], schema=kinds)

    return doc_texts(docs, id_col, text_col).mapInArrow(releasing(run), schema)


def place(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add sequence_id and offset to pieces with a ``length`` of at most
    ``window``. ``pieces`` must give the same rows each time it is read."""
    spark = pieces.sparkSession
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most `window` rows
    plan = best_fit_plan(histogram, window)
    buckets = max(16, sum(histogram.values()) // RANK_ROWS)
    marked = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy("length", "bucket").count().select(
        "length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier")
    )
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = marked.withColumn("nth", F.row_number().over(within)).join(starts, ["length", "bucket"])
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    sent = spark.sparkContext.broadcast((plan, plan[:, 0] << 48 | plan[:, 1]))

    @F.arrow_udf("sequence_id long, offset long")
    def look_up(length: pa.Array, rank: pa.Array) -> pa.Array:
        rows, key = sent.value
        length, rank = length.to_numpy(), rank.to_numpy()
        row = rows[np.searchsorted(key, length << 48 | rank, side="right") - 1]
        return pa.StructArray.from_arrays([pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], names=["sequence_id", "offset"])

    rank = (F.col("earlier") + F.col("nth") - 1).cast("long")
    return ranked.withColumn("at", look_up("length", rank)).select(*pieces.columns, "at.*")


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Cut and place every document: one row per piece, with doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id and offset (and ids).

    A repeated or null doc_id is packed like any other row; an empty table
    gives an empty table; other columns are not looked at."""
    pieces = cut_pieces(docs, tokenizer_path, end_id, window, with_ids, id_col, text_col)
    return place(scratch_table(pieces, "pieces", TEXT_ROWS), window)


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences of pieces that carry ids: sequence_id, n_tokens, ids,
    doc_ids. A sequence is at most one window long, so its group is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids", "length")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["length"]).alias("n_tokens"),
        F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"),
    )
