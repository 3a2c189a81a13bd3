"""Quality by a weak-label model.

Heuristic labellers vote good, bad or nothing on each document. Their votes
overlap; expectation-maximisation over the counts of all vote patterns of the
corpus estimates how each votes on good and on bad documents, without labels.
The posteriors then train a hashed linear scorer, which decides.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from siftline.llm.common import arrow_batches, doc_texts, releasing
from siftline.llm.linear import fit_logistic, sigmoid

NOTHING, GOOD, BAD = 0, 1, 2
HASH_BITS = 18
#: Bounds of the scorer's training sample: about this many documents, and
#: characters in all; and the longest text that is in it.
SAMPLE_DOCS, SAMPLE_CHARS, LONGEST = 6000, 60_000_000, 200_000
#: Rows of texts that go to Python at once.
TEXT_ROWS = 1000
_RUNS = re.compile(r"([^\w\s.!?\-])\1\1")
_ENDS = re.compile(r"[.!?](?:\s|$)")
_LONE = ("|", "-", "*", "/", "=", "~", "#", "+", ">", "<", ":", "•", "·", "–", "—")
_UPPER, _LETTER, _MARK = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0xC3:] = True  # a lead byte of a letter outside ASCII, mostly
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True


@dataclass(frozen=True)
class Facts:
    """What the labellers look at, all over the whole text."""

    words: int
    upper: float
    letters: int
    marks: float
    shouts: float
    bars: float
    runs: float
    repeats: float
    distinct: float
    word_length: float
    repeated_lines: float
    lone_marks: float
    ends: float


def facts(text: str) -> Facts:
    words = text.split()
    n = max(1, len(words))
    histogram = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    letters = int(histogram[_LETTER].sum())
    ascii_letters = int(histogram[65:91].sum() + histogram[97:123].sum())
    lines = [line for line in text.split("\n") if line and not line.isspace()]
    return Facts(
        len(words), histogram[_UPPER].sum() / max(1, ascii_letters), letters, histogram[_MARK].sum() / max(1, letters),
        text.count("!!") / n, text.count("|") / n, len(_RUNS.findall(text)) / n,
        sum(map(eq, words, words[1:])) / n, len(set(words)) / n, letters / n, 1 - len(set(lines)) / max(1, len(lines)),
        sum(map(words.count, _LONE)) / n, len(_ENDS.findall(text)) / n,
    )


def _two_sided(value: float, bad_over: float, good_under: float) -> int:
    return BAD if value > bad_over else GOOD if value < good_under else NOTHING


#: The labellers. All abstain on texts too short to judge; several look at the
#: same fault in other ways.
SHORT_WORDS = 12
LABELLERS: dict[str, Callable[[Facts], int]] = {
    "shouting": lambda f: _two_sided(f.upper, 0.5, 0.2),
    "exclamations": lambda f: _two_sided(f.shouts, 0.15, 0.05),
    "bars": lambda f: _two_sided(f.bars, 0.1, 0.02),
    "lone_marks": lambda f: _two_sided(f.lone_marks, 0.1, 0.03),
    "symbol_runs": lambda f: _two_sided(f.runs, 0.1, 0.02),
    "marks": lambda f: _two_sided(f.marks, 0.2, 0.1),
    "stutter": lambda f: _two_sided(f.repeats, 0.3, 0.05),
    "poor_words": lambda f: NOTHING if f.words < 30 else _two_sided(1 - f.distinct, 0.7, 0.45),
    "word_length": lambda f: GOOD if 3 <= f.word_length <= 8 else BAD,
    "repeated_lines": lambda f: _two_sided(f.repeated_lines, 0.6, 0.3),
    "sentence_ends": lambda f: NOTHING if f.words < 30 else _two_sided(-f.ends, -0.01, -0.03),
}


def votes(text: str) -> int:
    """All votes as one number in base three."""
    known, code = facts(text), 0
    for vote in LABELLERS.values():
        code = 3 * code + (vote(known) if known.words >= SHORT_WORDS else NOTHING)
    return code


def votes_column(text: Column) -> Column:
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([votes(t.as_py() or "") for t in texts], pa.int32())

    return F.arrow_udf(releasing(code), "int")(text)


@dataclass(frozen=True)
class WeakLabels:
    """``log_odds[k, v]``: evidence of labeller k's vote v for good; ``prior``: log-odds of good."""

    log_odds: np.ndarray
    prior: float

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        """Chance of good for vote patterns."""
        return sigmoid(self.prior + self.log_odds[np.arange(len(self.log_odds)), _digits(codes)].sum(1))


def _digits(codes: np.ndarray) -> np.ndarray:
    k = len(LABELLERS)
    return np.asarray(codes)[:, None] // 3 ** np.arange(k - 1, -1, -1) % 3


def fit_labels(counts: dict[int, int], rounds: int = 200) -> WeakLabels:
    """Expectation-maximisation over the counts of vote patterns. It starts
    from documents that are the likelier bad the more labellers say so, and
    estimates from there how often each labeller is right. To abstain says nothing."""
    k = len(LABELLERS)
    codes, n = np.array(sorted(counts), int), np.array([counts[c] for c in sorted(counts)], float)
    digits = _digits(codes) if len(codes) else np.zeros((0, k), int)
    one_hot = np.eye(3)[digits]
    # Smoothing stands for a thousandth of the documents and tells which class is which.
    smooth = {1: np.tile([0.0, 0.96, 0.04], (k, 1)), 0: np.tile([0.0, 0.6, 0.4], (k, 1))}
    size = max(1.0, 0.001 * n.sum())
    p = np.clip(0.25 ** (digits == BAD).sum(1), 0.0, 0.98)
    for _ in range(rounds):
        table = {}
        for c, q in ((1, p), (0, 1 - p)):
            seen = np.einsum("i,ikv->kv", n * q, one_hot) + size * smooth[c]
            seen[:, NOTHING] = seen[:, GOOD] + seen[:, BAD]
            table[c] = seen / seen[:, [NOTHING]]
        good = float(np.clip(((n * p).sum() + size) / (n.sum() + 2 * size), 1e-3, 1 - 1e-3))
        labels = WeakLabels(np.log(table[1]) - np.log(table[0]), float(np.log(good / (1 - good))))
        was, p = p, labels.posterior(codes) if len(codes) else p
        if not len(p) or np.abs(p - was).max() < 1e-9:
            break
    return labels


def shape(word: str) -> str:
    """A word with runs of upper-case, lower-case and digits drawn together."""
    return _SHAPE_DIGIT.sub("0", _SHAPE_LOWER.sub("a", _SHAPE_UPPER.sub("A", word)))


_SHAPE_UPPER, _SHAPE_LOWER, _SHAPE_DIGIT = re.compile(r"[A-ZÀ-ÖØ-Þ]{2,}"), re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+")


class _Features(dict):
    """Hashed feature of a word's shape, kept for words met before."""

    def __missing__(self, word: str) -> int:
        if len(self) > 60_000:
            self.clear()
        value = self[word] = _hashed("s:" + shape(word))
        return value


def _hashed(name: str) -> int:
    return xxh64_intdigest(name) & ((1 << HASH_BITS) - 1)


_SHAPES = _Features()
_STUTTER, _POOR, _EMPTY = (_hashed(f"f:{x}") for x in ("stutter", "poor", "empty"))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and values: shares of word shapes, share of words equal
    to the one before, and how few words are distinct for the length."""
    words = text.split()
    n = len(words)
    if not n:
        return np.array([_EMPTY]), np.array([1.0])
    ids, count = np.unique(np.fromiter(map(_SHAPES.__getitem__, words), np.int64, n), return_counts=True)
    extra = [sum(map(eq, words, words[1:])) / n, max(0.0, 1 - len(set(words)) / n - 0.4)]
    return np.concatenate([ids, [_STUTTER, _POOR]]), np.concatenate([count / n, extra])


@dataclass(frozen=True)
class QualityModel:
    """Weights by hashed feature (those that are not zero), bias, weak labels."""

    weights: dict[int, float]
    bias: float
    labels: WeakLabels

    def score(self, text: str) -> float:
        ids, values = features(text)
        z = self.bias + sum(self.weights.get(i, 0.0) * v for i, v in zip(ids.tolist(), values.tolist()))
        return float(sigmoid(np.array(z)))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Count vote patterns over all documents (at most 3 to the number of
    labellers rows reach the driver), fit the label model, and train the
    scorer on about ``sample_docs`` documents, and no more than the module's
    bounds on characters, chosen by a hash of id and text; rows equal in both
    count once."""
    texts = doc_texts(docs, id_col, text_col)
    patterns = texts.select(votes_column(F.col("text")).alias("votes"), F.length("text").alias("n")).groupBy("votes").agg(F.count("*"), F.sum("n"))
    with arrow_batches(docs.sparkSession, TEXT_ROWS):
        pattern = patterns.collect()
    counts = {int(r[0]): int(r[1]) for r in pattern}
    labels = fit_labels(counts)
    share = min(1.0, sample_docs / max(1, sum(counts.values())), SAMPLE_CHARS / max(1, sum(int(r[2]) for r in pattern)))
    draw = F.pmod(F.xxhash64(F.lit("quality"), "doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(votes(t), *features(t)) for t in batch.column(1).to_pylist()]
            cols = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *cols], names=["doc_id", "digest", "votes", "ids", "values"])

    drawn = texts.filter((draw < share) & (F.length("text") <= LONGEST)).withColumn("digest", F.xxhash64("text"))
    sample = drawn.mapInArrow(releasing(sparse), "doc_id long, digest long, votes int, ids array<long>, values array<double>")
    with arrow_batches(docs.sparkSession, TEXT_ROWS):
        rows = sample.dropDuplicates(["doc_id", "digest"]).collect()
    rows = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.digest))
    if not rows:
        return QualityModel({}, 40.0, labels)
    doc = np.repeat(np.arange(len(rows)), [len(r.ids) for r in rows])
    feature, value = np.concatenate([r.ids for r in rows]).astype(int), np.concatenate([r["values"] for r in rows])
    weights, bias = fit_logistic(doc, feature, value, labels.posterior(np.array([r.votes for r in rows])), 1 << HASH_BITS)
    return QualityModel({int(i): float(weights[i]) for i in np.flatnonzero(weights)}, bias, labels)


def score_column(text: Column, model: QualityModel) -> Column:
    """Chance of good quality of each text; a null text counts as empty."""

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([model.score(t.as_py() or "") for t in texts], pa.float64())

    return F.arrow_udf(releasing(score), "double")(text)


def score_documents(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score, keep. Rows that repeat an id
    are scored one by one; an empty table gives an empty table; other columns
    are not looked at."""
    scored = doc_texts(docs, id_col, text_col).select("doc_id", score_column(F.col("text"), model).alias("score"))
    return scored.withColumn("keep", F.col("score") >= 0.5)


def drop_poor(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, without the rows that the scorer rejects.
    A null text counts as empty; repeated rows are judged alike."""
    return docs.filter(score_column(F.col(text_col).cast("string"), model) >= 0.5)
