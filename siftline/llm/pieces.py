"""SentencePiece encoding and decoding over a distinct-chunk table.

A text is cut before each run of whitespace markers. No piece of the model
holds a marker after another character (checked when the model is loaded), so
no piece crosses such a cut and each distinct marked word needs segmenting
only once. Every task keeps the table of the chunks that it has met, segments
the new ones and joins ids back by position. Ids are decoded the same way:
what a piece decodes to depends on a marker before it alone, so a chunk's ids
decode alike wherever it stands but at a text's beginning. Nothing is shuffled: a table over
all tasks would move each (document, word) pair twice to save a segmentation
of a few microseconds for each word and task.

Defined results: a null or empty text gives only the end id; rows with equal
ids are encoded one by one; an empty table gives an empty table; other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from siftline.llm.common import BoundedTable, batches_of, doc_texts, releasing

MARK = "▁"
#: Bytes of text that are cut into chunks at a time, about (whole documents).
SLICE_BYTES = 16 << 20
#: What ``encode`` can return, and the Spark type of each.
OUTPUTS = {
    "n_tokens": "long", "ids": "array<int>", "ids_sha256": "string",
    "decoded": "string", "decoded_sha256": "string",
}
_ARROW = {
    "n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_sha256": pa.string(),
    "decoded": pa.string(), "decoded_sha256": pa.string(),
}
_CHUNK = re.compile(" +[^ ]*")


class ChunkEncoder:
    """Whole-text encoder that segments each distinct chunk once."""

    def __init__(self, model_path: str, table_limit: int = 250_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece of this model crosses a whitespace marker")
        if self.model.encode("a") == self.model.encode(" a"):
            raise ValueError("this model strips whitespace; chunks would not join back")
        self.marked = np.array([p.startswith(MARK) for p in pieces])
        self.decimal = [f"{i} " for i in range(len(pieces))]
        self.lone_mark = self.model.piece_to_id(MARK)
        self.anchor = self.model.encode("a")[-1]
        self.anchor_chars = len(self.model.decode([self.anchor]))
        self.table = BoundedTable(self._segment, table_limit)
        self.said = BoundedTable(self._say, table_limit)

    def _segment(self, chunks: list[str]) -> list[tuple[list[int], str, str]]:
        """Ids of each chunk, the same in decimal, and what they decode to
        after other text. Chunks with one marker are encoded many at a
        time and told apart by the pieces that begin with it."""
        out: dict[str, list[int]] = {c: self._alone(c) for c in chunks if c.startswith("  ") or c == " "}
        for some in batches_of((c for c in chunks if c not in out), 1000):
            ids = self.model.encode("".join(some)[1:])  # encode() puts the first marker in front
            starts = np.flatnonzero(self.marked[ids]).tolist()
            out.update((c, ids[a:b]) for c, a, b in zip(some, starts, [*starts[1:], len(ids)], strict=True))
        each = [out[c] for c in chunks]
        # With a piece in front, so that the first marker is kept.
        said = self.model.decode([[self.anchor, *ids] for ids in each]) if each else []
        return [(ids, "".join([self.decimal[i] for i in ids]), text[self.anchor_chars :]) for ids, text in zip(each, said)]

    def _alone(self, chunk: str) -> list[int]:
        return [self.lone_mark] if chunk == " " else self.model.encode(chunk[1:])

    def chunks(self, texts: pa.Array) -> Iterator[list[tuple[list[int], str, str]]]:
        """For each text what its chunks are segmented into (see ``_segment``).
        Only the distinct words of the texts are looked up."""
        plain = pc.replace_substring(texts, MARK, " ")
        odd = pc.match_substring_regex(plain, "^$|^ | $|  ")
        cut = pc.split_pattern(pc.if_else(odd, "", plain), " ")
        coded = cut.values.slice(cut.offsets[0].as_py(), cut.offsets[-1].as_py() - cut.offsets[0].as_py()).dictionary_encode()
        (found,) = self.table.look_up([[" " + w for w in coded.dictionary.to_pylist()]])
        codes, bounds = coded.indices.to_numpy().tolist(), (cut.offsets.to_numpy() - cut.offsets[0].as_py()).tolist()
        for is_odd, text, a, b in zip(odd.to_pylist(), plain, bounds, bounds[1:]):
            if is_odd:
                text = text.as_py()
                yield self.table.look_up([_CHUNK.findall(" " + text) if text else []])[0]
            else:
                yield [found[c] for c in codes[a:b]]

    @staticmethod
    def ids_of(met: list[tuple[list[int], str, str]]) -> list[int]:
        return list(chain.from_iterable([m[0] for m in met]))

    @staticmethod
    def decimal_of(met: list[tuple[list[int], str, str]]) -> str:
        """The ids in decimal, a space after each."""
        return "".join([m[1] for m in met])

    def decoded(self, met: list[tuple[list[int], str, str]]) -> str:
        """What the ids decode to; the first chunk loses the marker in front."""
        return self.model.decode(met[0][0]) + "".join([m[2] for m in met[1:]]) if met else ""

    def decode(self, ids: list[int]) -> str:
        """The text of ids, by distinct runs that begin at a marker."""
        if not ids:
            return ""
        begins = self.marked[ids]
        starts = [0, *(np.flatnonzero(begins[1:] & ~begins[:-1]) + 1).tolist()]
        runs = [tuple(ids[a:b]) for a, b in zip(starts, [*starts[1:], len(ids)])]
        return self.model.decode(list(runs[0])) + "".join(self.said.look_up([runs[1:]])[0])

    def _say(self, runs: list[tuple[int, ...]]) -> list[str]:
        return [t[self.anchor_chars :] for t in self.model.decode([[self.anchor, *r] for r in runs])] if runs else []


@lru_cache(maxsize=2)
def chunk_encoder(model_path: str) -> ChunkEncoder:
    """One encoder for each model and Python worker."""
    return ChunkEncoder(model_path)


def encode(
    docs: DataFrame, model_path: str, outputs: tuple[str, ...] = ("n_tokens", "ids"),
    end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Encode every whole text, ``end_id`` at the end, and decode the ids again
    where a ``decoded`` column is asked for.

    ``outputs`` names the columns beside ``doc_id`` (see ``OUTPUTS``). Digests
    are lowercase hex SHA-256 of the decimal ids joined by a space and of the
    decoded text in UTF-8.
    """
    unknown = [c for c in outputs if c not in OUTPUTS]
    if unknown:
        raise ValueError(f"unknown outputs: {unknown}")
    kinds = pa.schema([("doc_id", pa.int64()), *((c, _ARROW[c]) for c in outputs)])
    decode = any(c.startswith("decoded") for c in outputs)

    def finish(enc: ChunkEncoder, met: list[tuple[list[int], str, str]]) -> dict:
        end = [] if end_id is None else [end_id]
        row = {"n_tokens": sum([len(m[0]) for m in met]) + len(end)}
        if "ids" in outputs:
            row["ids"] = enc.ids_of(met) + end
        if "ids_sha256" in outputs:
            decimal = enc.decimal_of(met) + "".join(f"{i} " for i in end)
            row["ids_sha256"] = hashlib.sha256(decimal[:-1].encode()).hexdigest()
        if decode:
            # Control ids, as an end id is, decode to nothing.
            silent = all(map(enc.model.is_control, end))
            row["decoded"] = enc.decoded(met) if silent else enc.model.decode(enc.ids_of(met) + end)
            row["decoded_sha256"] = hashlib.sha256(row["decoded"].encode()).hexdigest()
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = chunk_encoder(model_path)
        for batch in batches:
            step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
            for part in range(0, batch.num_rows, step):
                some = batch.slice(part, step)
                rows = [finish(enc, met) for met in enc.chunks(some.column(1))]
                cols = [some.column(0), *(pa.array([r[c] for r in rows], _ARROW[c]) for c in outputs)]
                yield pa.RecordBatch.from_arrays(cols, schema=kinds)

    schema = ", ".join(["doc_id long", *(f"{c} {OUTPUTS[c]}" for c in outputs)])
    return doc_texts(docs, id_col, text_col).mapInArrow(releasing(run), schema)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, decoded)`` of a table of id lists; null ids decode to ''.

    Lists are cut before each id whose piece begins with a marker, if the one
    before has none, and each distinct run of ids is decoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = chunk_encoder(model_path)
        for batch in batches:
            texts = [enc.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return encoded.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{ids_col}` ids").mapInArrow(releasing(run), "doc_id long, decoded string")
