"""Toxicity by multiple-instance learning.

Only documents are labelled. A linear scorer gives each sentence a probability
and a document's is the noisy-or of its sentences', so training on document
labels finds the sentences that explain them. Features are a sentence's words and
their beginnings; labels, language, source and ids are never inputs.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from math import exp, expm1, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import doc_texts, releasing, scratch_table
from siftline.llm.linear import fit_noisy_or

#: Bounds of the training sample, for each class: about this many labelled
#: documents, and characters in all; and the longest text that is in it.
SAMPLE_DOCS, SAMPLE_CHARS, LONGEST = 2000, 20_000_000, 200_000
#: A word has to stand in so many sampled documents to get a weight.
MIN_DOCS = 8
#: Lengths of the word beginnings that are features too.
STEMS = (4, 5, 6)
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")


def _words(sentence: str) -> list[str]:
    """A sentence's distinct words: repeating one says nothing more."""
    return list(dict.fromkeys(_WORD.findall(sentence.lower())))


def word_features(word: str) -> list[str]:
    """A word and its beginnings, marked apart from whole words."""
    return [word, *(word[:n] + "~" for n in STEMS if len(word) > n)]


class ToxicityModel:
    """Weights of features, and the bias of a sentence."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self._words = _WordWeights(weights)

    def __reduce__(self):
        return ToxicityModel, (self.weights, self.bias)

    def sentence(self, sentence: str) -> float:
        """-log of the chance that the sentence does not offend."""
        return _softplus(self.bias + sum(map(self._words.__getitem__, _words(sentence))))

    def score(self, text: str) -> float:
        return 0.0 - expm1(-sum(map(self.sentence, _SENTENCE.findall(text))))


class _WordWeights(dict):
    """The summed weight of each word met lately."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= 120_000:
            self.clear()
        value = self[word] = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return value


def _softplus(z: float) -> float:
    return z + log1p(exp(-z)) if z > 0 else log1p(exp(z))


def is_held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fit on a sample of the labelled rows that are not held out: about
    ``sample_docs`` of each class and no more than the module's bounds on
    characters, chosen by a hash of id and text; rows equal in both count once.
    A document with several labels is toxic if one says so; null labels are
    left out. Without labels of both classes the model scores every text 0."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = doc_texts(docs, id_col, text_col).withColumn("digest", F.xxhash64("text"))
    rows = texts.select("doc_id", "digest", F.length("text").alias("n")).filter(F.col("n") <= LONGEST)
    keys = scratch_table(rows.join(known, "doc_id").groupBy("doc_id", "digest", "toxic").agg(F.max("n").alias("n")), "toxicity-keys")
    share = {int(k): min(1.0, sample_docs / n, SAMPLE_CHARS / max(1, chars)) for k, n, chars in keys.groupBy("toxic").agg(F.count("*"), F.sum("n")).collect()}
    if len(share) < 2:
        return ToxicityModel({}, -40.0)
    draw = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(1 << 20)) / float(1 << 20)
    sample = keys.filter(draw < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])).drop("n")
    drawn = texts.join(F.broadcast(sample), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])  # the sample's size is bounded
    rows = sorted(drawn.select("doc_id", "toxic", "text").collect())
    return fit([r[2] for r in rows], np.array([r[1] for r in rows], int))


def fit(texts: list[str], label: np.ndarray, min_docs: int = MIN_DOCS) -> ToxicityModel:
    if len(np.unique(label)) < 2:
        return ToxicityModel({}, -40.0)
    word_ids: dict[str, int] = {}
    words, sentence, doc_of, in_docs = array("i"), array("i"), array("i"), Counter()
    for d, text in enumerate(texts):
        met: set[int] = set()
        for s in _SENTENCE.findall(text):
            ids = [word_ids.setdefault(w, len(word_ids)) for w in _words(s)]
            words.extend(ids)
            sentence.extend([len(doc_of)] * len(ids))
            doc_of.append(d)
            met.update(ids)
        in_docs.update(met)
    # How many documents hold a word of each feature, at most: enough to leave out rare ones.
    count: Counter[str] = Counter()
    for w, i in word_ids.items():
        for f in word_features(w):
            count[f] += in_docs[i]
    vocabulary = {f: i for i, f in enumerate(sorted(f for f, n in count.items() if n >= min_docs))}
    features = np.full((len(word_ids), 1 + len(STEMS)), len(vocabulary))
    for w, i in word_ids.items():
        got = [vocabulary[f] for f in word_features(w) if f in vocabulary]
        features[i, : len(got)] = got
    arrays = [np.frombuffer(a, np.intc) if len(a) else np.zeros(0, int) for a in (words, sentence, doc_of)]
    weights, bias = fit_noisy_or(*arrays, label, features, len(vocabulary))
    return ToxicityModel({f: float(weights[i]) for f, i in vocabulary.items() if weights[i]}, bias)


def score_column(text: Column, model: ToxicityModel) -> Column:
    """The score of each text, 0 to 1; a null or empty text has no sentence and scores 0."""

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([model.score(t.as_py() or "") for t in texts], pa.float64())

    return F.arrow_udf(releasing(score), "double")(text)


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted. Rows
    that repeat an id are scored one by one; a null id is not held out; an
    empty table gives an empty table; other columns are not looked at."""
    scored = doc_texts(docs, id_col, text_col).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score_column(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def offending_sentences(docs: DataFrame, model: ToxicityModel, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sentences that score ``least`` or more: doc_id, sentence_no, start, end
    (code points), score, sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for n, m in enumerate(_SENTENCE.finditer(text)):
                    if (p := -expm1(-model.sentence(m[0]))) >= least:
                        rows.append({"doc_id": doc_id, "sentence_no": n, "start": m.start(), "end": m.end(), "score": p, "sentence": m[0]})
            kinds = [("doc_id", pa.int64()), ("sentence_no", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("sentence", pa.string())]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    return doc_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, sentence_no long, start long, end long, score double, sentence string")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, without the rows that are predicted
    toxic. A null or empty text stays; repeated rows are judged alike."""
    return docs.filter(score_column(F.col(text_col).cast("string"), model) < 0.5)
