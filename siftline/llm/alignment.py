"""Cross-tokenizer alignment with an identity map as the fast path.

A text is cut by tokenizer A (byte-level BPE) and by tokenizer B (pieces with
byte fallback) into tokens of bytes. Where both end, groups end; tokens whose
bytes overlap are linked. Most groups are one token of each with the same bytes.
``Vocabularies.same`` holds for each A id the B id with its bytes, so such a link
is told by its A id alone and counted in a vector as long as A's vocabulary. Only
the other links go to the shuffle that counts pairs over the corpus.

Both tokenizers treat what follows a blank between other characters by
itself. So texts are cut there, and each distinct chunk is tokenised and aligned
once for many texts; a text's tokens, groups and links are its chunks' in a row.
A text's distinct links with their numbers are written once; counts are made
from that table and looked up for it: identity links in the vectors, which are
broadcast and no longer than the vocabulary, other links by a join with the
counted pairs. Pairs beyond a broadcast's bound are split: those that so many
documents hold that a join would pile up are broadcast, the rest is shuffled.

Defined results: a null or empty text, or one whose tokens do not join to
a blank and the text (as with U+2581 in it), has no tokens: zeros and an empty
digest. Rows that repeat a doc_id, or lack one, are documents of their own. An
empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import BROADCAST_ROWS, BoundedTable, batches_of, crowded_join, doc_texts, releasing, scratch_table

#: Bytes of text that are cut into chunks at a time, about (whole documents); chunks that are tokenised in one call.
SLICE_BYTES, JOINED = 4 << 20, 1000
#: Distinct pairs that a task counts before it passes them on.
PAIRS_HELD = 1 << 20
#: How byte-level tokenizers split a text (a fixed value).
SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MARK = "▁"
#: White space of any kind, and characters that some tables take for it.
_SPACES = "\t-\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
_CUT = re.compile(f"(?<=[^ {_SPACES}]) (?=[^ {_SPACES}])")
#: Texts in which not every blank is such a place.
_UNEVEN = f"^ | $|  |[{_SPACES}] | [{_SPACES}]"
_EVEN_CHUNK = re.compile(f" [^ {_SPACES}](?:[^ ]*[^ {_SPACES}])?").fullmatch
#: Letters, marks and line ends that have been the same in every version of Unicode.
_SETTLED = re.compile("[\n -~\xc0-\xd6\xd8-\xf6\xf8-\u024f]*").fullmatch
_KINDS = pa.schema([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()),
    ("same", pa.list_(pa.int32())), ("same_n", pa.list_(pa.int32())), ("odd", pa.list_(pa.int64())), ("odd_n", pa.list_(pa.int32())),
])
_LINKED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, same array<int>, same_n array<int>, odd array<long>, odd_n array<int>"


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: a
    printable Latin-1 character for itself, the others from U+0100 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabularies:
    """Both tokenizers, the bytes of each id, and the identity map ``same``
    (-1 where B has no piece with an A token's bytes)."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of = byte_characters()
        names = self.a.get_vocab()
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(map(of.__getitem__, name)) if all(c in of for c in name) else name.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search(f"[^{_MARK}]{_MARK}", p) for p in pieces):
            raise ValueError("a piece of this model crosses a whitespace marker")
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        # Where a byte has a piece of its own too, the model takes that.
        usual = {self.b_bytes[i]: i for byte in (True, False) for i in range(len(pieces)) if self.b.is_byte(i) == byte and not (self.b.is_control(i) or self.b.is_unknown(i))}
        self.same = np.array([usual.get(x, -1) for x in self.a_bytes], np.int32)
        self.a_size, self.b_size = (np.array([len(x) for x in many], np.int64) for many in (self.a_bytes, self.b_bytes))
        self.quick = self._quick()

    def _quick(self):
        """A faster encoder with A's vocabulary, for texts on whose character
        classes all encoders agree; none if the merges are not in the order of ids."""
        import tiktoken

        kind = json.loads(self.a.to_str())
        merged = [m if isinstance(m, list) else m.split(" ") for m in kind["model"]["merges"]]
        vocab = kind["model"]["vocab"]
        ids = [vocab["".join(m)] for m in merged]
        special = {t["id"] for t in kind["added_tokens"]}
        if kind["normalizer"] or kind["pre_tokenizer"].get("type") != "ByteLevel" or ids != sorted(ids):
            return None
        ranks = {x: i for i, x in enumerate(self.a_bytes) if i not in special}
        return tiktoken.Encoding("a", pat_str=SPLITS, mergeable_ranks=ranks, special_tokens={})

    def a_ids(self, text: str) -> list[int]:
        if self.quick and _SETTLED(text):
            return self.quick.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids


class Aligner:
    """Alignments of chunks: (A tokens, B tokens, groups, groups as text, A ids
    of identity links, other links as ``a << 16 | b``); empty if a chunk's tokens
    do not join to it."""

    def __init__(self, a_path: str, b_path: str, table_limit: int = 100_000):
        self.known = Vocabularies(a_path, b_path)
        if max(len(self.known.a_bytes), len(self.known.b_bytes)) > 1 << 16:
            raise ValueError("vocabularies have at most 65,536 ids here")
        self.table = BoundedTable(self._align, table_limit)

    def _align(self, chunks: list[str]) -> list[tuple]:
        out: dict[str, tuple] = {}
        for fits in (True, False):
            for some in batches_of((c for c in chunks if _MARK not in c and _EVEN_CHUNK(c) and bool(_SETTLED(c)) == fits), JOINED):
                out.update(zip(some, self._together(some) or map(self._alone, some)))
        return [out[c] if c in out else self._alone(c) for c in chunks]

    def _alone(self, chunk: str) -> tuple:
        return (self._together([chunk]) or [()])[0]

    def _together(self, chunks: list[str]) -> list[tuple] | None:
        """Alignments of chunks that are tokenised as one text; none if its tokens do not join to it or cross chunks."""
        known, text = self.known, "".join(chunks)
        a, b = known.a_ids(text), known.b.encode(text[1:])
        raw = text.encode()
        if any(b"".join(map(of.__getitem__, ids)) != raw for ids, of in ((a, known.a_bytes), (b, known.b_bytes))):
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        a_end, b_end = np.cumsum(known.a_size[a]), np.cumsum(known.b_size[b])
        both, every = np.intersect1d(a_end, b_end, assume_unique=True), np.union1d(a_end, b_end)
        ends = np.cumsum([len(c.encode()) for c in chunks])
        if not np.isin(ends, both).all():
            return None
        # Between two neighbouring ends of either side lies one link.
        la, lb = a[np.searchsorted(a_end, every)], b[np.searchsorted(b_end, every)]
        same = known.same[la] == lb
        a_group, b_group = (np.searchsorted(e, both).tolist() for e in (a_end, b_end))
        in_same, in_odd = (np.concatenate([[0], np.cumsum(x)])[np.searchsorted(every, ends) + 1].tolist() for x in (same, ~same))
        in_a, in_b, in_groups = ((np.searchsorted(e, ends) + 1).tolist() for e in (a_end, b_end, both))
        same_raw, odd_raw = la[same].astype("<u2").tobytes(), (la[~same] << 16 | lb[~same]).astype("<u4").tobytes()
        sa, sb = list(map(str, a.tolist())), list(map(str, b.tolist()))
        out, pa_, pb, pg, ps, po, x, y = [], 0, 0, 0, 0, 0, 0, 0
        for na, nb, ng, ns, no in zip(in_a, in_b, in_groups, in_same, in_odd):
            said = []
            for g in range(pg, ng):
                u, v = a_group[g] + 1, b_group[g] + 1
                said.append(f"{sa[x]}|{sb[y]}" if u == x + 1 and v == y + 1 else ",".join(sa[x:u]) + "|" + ",".join(sb[y:v]))
                x, y = u, v
            out.append((na - pa_, nb - pb, ng - pg, ";".join(said), same_raw[2 * ps : 2 * ns], odd_raw[4 * po : 4 * no]))
            pa_, pb, pg, ps, po = na, nb, ng, ns, no
        return out

    def texts(self, texts: pa.Array) -> Iterator[list[tuple]]:
        """For each text, not null, its chunks' alignments."""
        uneven = pc.or_(pc.match_substring_regex(texts, _UNEVEN), pc.equal(texts, ""))
        cut = pc.split_pattern(pc.if_else(uneven, "", texts), " ")
        first = cut.offsets[0].as_py()
        coded = cut.values.slice(first, cut.offsets[-1].as_py() - first).dictionary_encode()
        (found,) = self.table.look_up([[" " + w if w else "" for w in coded.dictionary.to_pylist()]])
        codes, bounds = coded.indices.to_numpy().tolist(), (cut.offsets.to_numpy() - first).tolist()
        for odd, text, a, b in zip(uneven.to_pylist(), texts, bounds, bounds[1:]):
            if odd:
                text = text.as_py()
                places = [0, *(m.start() + 1 for m in _CUT.finditer(text))] if text else []
                chunks = [(" " + text)[x:y] for x, y in zip([0, *places[1:]], [*places[1:], len(text) + 1])] if text else []
                yield self.table.look_up([chunks])[0]
            else:
                yield [found[c] for c in codes[a:b]]


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each Python worker."""
    return Aligner(a_path, b_path)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts) if parts else [], kind))


def align(docs: DataFrame, a_path: str, b_path: str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, groups
    (``a1,a2|b1;a3|b2,b3``, or with ``digest`` its SHA-256, empty without tokens), and the distinct links with how often they occur:
    same, same_n (A ids of identity links), odd, odd_n (others, ``a << 16 | b``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = aligner(a_path, b_path)
        for batch in batches:
            step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
            for part in range(0, batch.num_rows, step):
                some, rows, links = batch.slice(part, step), [], ([], [], [], [])
                for met in engine.texts(some.column(1)):
                    met = met if met and all(met) else []
                    n_a, n_b, n_groups = (sum([m[k] for m in met]) for k in range(3))
                    groups = ";".join([m[3] for m in met])
                    groups = hashlib.sha256(groups.encode()).hexdigest() if digest and groups else groups
                    rows.append((n_a, n_b, n_groups, n_a + n_b - n_groups, groups))
                    for k, kind in ((4, "<u2"), (5, "<u4")):
                        unique, n = np.unique(np.frombuffer(b"".join([m[k] for m in met]), kind), return_counts=True)
                        links[2 * k - 8].append(unique)
                        links[2 * k - 7].append(n)
                cols = [pa.array(c, _KINDS.field(i + 1).type) for i, c in enumerate(zip(*rows))]
                lists = [_lists(parts, _KINDS.field(6 + i).type.value_type) for i, parts in enumerate(links)]
                yield pa.RecordBatch.from_arrays([some.column(0), *cols, *lists], schema=_KINDS)

    return doc_texts(docs, id_col, text_col).mapInArrow(releasing(run), _LINKED)


def id_count(a_path: str) -> int:
    """One more than A's largest id."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(a_path).get_vocab().values()) + 1


def pair_counts(linked: DataFrame, a_size: int) -> tuple[np.ndarray, DataFrame]:
    """How many documents hold each link: a vector by A id for identity links,
    and a scratch table ``(odd, n)`` for the others."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, held, n_held = np.zeros(a_size, np.int64), [], 0

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            keys, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return keys, np.bincount(which, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)

        def rows(keys: np.ndarray, n: np.ndarray, same: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), same)), pa.array(keys.astype(np.int64)), pa.array(n)], names=["same", "key", "n"])

        for batch in batches:
            same, odd = (batch.column(k).flatten().to_numpy() for k in (0, 1))
            vector += np.bincount(same, minlength=a_size)
            held.append(np.unique(odd, return_counts=True))
            n_held += len(held[-1][0])
            if n_held > PAIRS_HELD:
                held = [merged(held)]
                n_held = len(held[0][0])
                if n_held > PAIRS_HELD // 2:
                    yield rows(*held[0], False)
                    held, n_held = [], 0
        if held:
            yield rows(*merged(held), False)
        some = np.flatnonzero(vector)
        yield rows(some, vector[some], True)

    parts = linked.select("same", "odd").mapInArrow(releasing(count), "same boolean, key long, n long")
    counted = scratch_table(parts.groupBy("same", "key").agg(F.sum("n").alias("n")), "pair-counts")
    vector = np.zeros(a_size, np.int64)
    for key, n in counted.filter("same").select("key", "n").collect():  # no more rows than A has ids
        vector[key] = n
    return vector, counted.filter("NOT same").select(F.col("key").alias("odd"), "n")


def alignment_counts(docs: DataFrame, a_path: str, b_path: str, digest: bool = False, broadcast_rows: int = BROADCAST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best
    (links whose pair no other pair of the A id exceeds in documents), count_sum
    (documents that hold a link's pair, over links), groups (see ``align``)."""
    linked = scratch_table(align(docs, a_path, b_path, digest, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "linked")
    vector, pairs = pair_counts(linked, id_count(a_path))
    best = vector.copy()
    a_id = F.shiftright("odd", 16)
    for a, n in pairs.groupBy(a_id.alias("a")).agg(F.max("n")).collect():  # no more rows than A has ids
        best[a] = max(best[a], n)
    sent = docs.sparkSession.sparkContext.broadcast((vector, vector == best, best))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, is_best, _ = sent.value
        for batch in batches:
            at = batch.column(1).offsets.to_numpy() - batch.column(1).offsets[0].as_py()
            ids, often = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in (1, 2))
            before = (np.concatenate([[0], np.cumsum(often * x[ids])]) for x in (is_best, n))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.diff(x[at])) for x in before)], names=["row", "n_best", "count_sum"])

    own = linked.select("row", "same", "same_n").mapInArrow(releasing(look_up), "row long, n_best long, count_sum long")

    def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = sent.value[2]
        for batch in batches:
            keys, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n == most[keys >> 16])], names=["odd", "n", "top"])

    known = scratch_table(pairs.mapInArrow(releasing(best_of), "odd long, n long, top boolean").withColumn("held", F.col("n")), "pair-best")
    links = linked.select("row", F.inline(F.arrays_zip("odd", F.col("odd_n").alias("often"))))
    met = crowded_join(links, known, "odd", broadcast_rows)
    other = met.groupBy("row").agg(F.sum(F.when(F.col("top"), F.col("often")).otherwise(0)).alias("n_best"), F.sum(F.col("often") * F.col("held")).alias("count_sum"))
    sums = own.unionByName(other).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return linked.drop("same", "same_n", "odd", "odd_n").join(sums, "row").drop("row")
