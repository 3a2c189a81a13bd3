"""Small numpy trainers for bounded samples."""

from __future__ import annotations

import numpy as np


class Adagrad:
    """Adagrad steps with an optional L1 shrinkage."""

    def __init__(self, size: int, rate: float, l1: float = 0.0):
        self.value, self.seen, self.rate, self.l1 = np.zeros(size), np.full(size, 1e-8), rate, l1

    def step(self, gradient: np.ndarray) -> None:
        self.seen += gradient * gradient
        rate = self.rate / np.sqrt(self.seen)
        moved = self.value - rate * gradient
        self.value = np.sign(moved) * np.maximum(np.abs(moved) - rate * self.l1, 0.0)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_noisy_or(
    words: np.ndarray, sentence: np.ndarray, doc_of: np.ndarray, label: np.ndarray, features: np.ndarray, n_features: int,
    rounds: int = 250, rate: float = 0.6, l1: float = 1.0, bias: float = -12.0,
) -> tuple[np.ndarray, float]:
    """Weights of a sentence scorer whose document score is the noisy-or of its
    sentences'. ``words[i]`` stands in sentence ``sentence[i]``; sentence ``s``
    is in document ``doc_of[s]``; ``label`` is 0 or 1 for each document;
    ``features[w]`` are the features of word ``w``, filled up with ``n_features``."""
    w, b = Adagrad(n_features, rate, l1), Adagrad(1, rate)
    b.value[:] = bias
    n_s, n_d, width = len(doc_of), len(label), features.shape[1]
    flat = features.ravel()
    weight = np.where(label == 1, n_d / max(1, 2 * label.sum()), n_d / max(1, 2 * (n_d - label.sum())))
    for _ in range(rounds):
        of_word = np.append(w.value, 0.0)[features].sum(1)
        z = b.value[0] + np.bincount(sentence, of_word[words], n_s)
        p = sigmoid(z)
        none = np.bincount(doc_of, np.logaddexp(0, z), n_d)  # -log of the chance that no sentence offends
        slope = np.where(label == 1, -1 / np.expm1(np.clip(none, 1e-3, 40)), 1.0) * weight
        pull = slope[doc_of] * p
        by_word = np.bincount(words, pull[sentence], len(features))
        w.step(np.bincount(flat, np.repeat(by_word, width), n_features + 1)[:n_features])
        b.step(np.array([pull.sum()]))
    return w.value, float(b.value[0])


def fit_logistic(
    doc: np.ndarray, feature: np.ndarray, value: np.ndarray, target: np.ndarray, n_features: int,
    rounds: int = 200, rate: float = 0.5, l1: float = 0.02,
) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows and soft targets in [0, 1]."""
    w, b = Adagrad(n_features, rate, l1), Adagrad(1, rate)
    n = len(target)
    pos = target.sum()
    weight = np.where(target >= 0.5, n / max(1.0, 2 * pos), n / max(1.0, 2 * (n - pos)))
    for _ in range(rounds):
        z = b.value[0] + np.bincount(doc, w.value[feature] * value, n)
        pull = (sigmoid(z) - target) * weight
        w.step(np.bincount(feature, pull[doc] * value, n_features))
        b.step(np.array([pull.sum()]))
    return w.value, float(b.value[0])
