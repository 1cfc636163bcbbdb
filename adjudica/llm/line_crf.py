"""Quality of documents by a linear-chain conditional random field over their lines."""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjudica.llm.columns import id_and_text, map_batches

#: Labelled documents that the field is fitted on at most, the smallest hashes of their ids.
TRAINING_DOCUMENTS = 3000
STEPS, RATE, PENALTY = 250, 0.3, 1e-3
# Frequent words of the languages of the corpus.
STOP_WORDS = frozenset(
    "the of and to in is that de la le les et des que der die und das von zu en los el un une a on for "
    "with by mit den y las del por con qui pour dans".split()
)
_SYMBOLS = re.compile(r"[#*$%&|<>{}\\^~_=@]")
_CAPITALS = re.compile(r"[^\W\d_a-zß-öø-ÿ]")
_LETTERS = re.compile(r"[^\W\d_]")
_DIGITS = re.compile(r"\d")
_MARKS = re.compile(r"[!?]")
OWN_FEATURES = 13


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights): a row for each line of a whole text, and its length in characters.

    Own features of a line are followed by those of the line before and the line after, zero at the
    ends. Blank lines are lines; an empty text is one empty line of weight one.
    """
    lines = (text or "").split("\n")
    rows, seen = [], set()
    for line in lines:
        words = line.split()
        n, size = len(words), len(line)
        letters = len(_LETTERS.findall(line))
        distinct = len(set(words))
        stop = sum(w in STOP_WORDS for w in words)
        rows.append(
            (
                1.0,
                math.log1p(n) / 5,
                size == 0,
                min(1.0, len(_SYMBOLS.findall(line)) / (n or 1)),
                len(_CAPITALS.findall(line)) / (letters or 1),
                len(_DIGITS.findall(line)) / (size or 1),
                min(1.0, len(_MARKS.findall(line)) / (n or 1)),
                stop / (n or 1),
                distinct / (n or 1),
                min(1.0, letters / (n or 1) / 10),
                line in seen,
                line.rstrip().endswith((".", "!", "?", ":", ";")),
                sum(a == b for a, b in zip(words, words[1:])) / (n or 1),
            )
        )
        seen.add(line)
    own = np.array(rows, dtype=np.float64)
    around = np.zeros((len(own), 3 * OWN_FEATURES))
    around[:, :OWN_FEATURES] = own
    around[1:, OWN_FEATURES : 2 * OWN_FEATURES] = own[:-1]
    around[:-1, 2 * OWN_FEATURES :] = own[1:]
    return around, np.array([max(1, len(line)) for line in lines], dtype=np.float64)


@dataclass
class LineField:
    """Weights of a two-label chain: ``unary`` for label good against bad, ``pair`` for two labels in a
    row; ``scale`` and ``shift`` turn the mean marginal of a document into its score."""

    unary: np.ndarray
    pair: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def marginals(self, chains: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """P(good) of every line of every chain, and the expected label pairs over all, by forward and
        backward sums. Chains step together, longest first, so that a step is one array operation."""
        order = sorted(range(len(chains)), key=lambda k: -len(chains[k]))
        lengths = np.array([len(chains[k]) for k in order])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        rows = np.concatenate([chains[k] for k in order])
        energy = rows @ self.unary
        potential = np.stack([np.zeros_like(energy), np.clip(energy, -30, 30)], axis=1)
        link = np.exp(self.pair)
        local = np.exp(potential - potential.max(axis=1, keepdims=True))
        forward, backward = np.empty_like(local), np.ones_like(local)
        state = local[starts]
        state = state / state.sum(axis=1, keepdims=True)
        forward[starts] = state
        for t in range(1, int(lengths.max(initial=1))):
            count = int(np.searchsorted(-lengths, -t, side="left"))
            state = (state[:count] @ link) * local[starts[:count] + t]
            state /= state.sum(axis=1, keepdims=True)
            forward[starts[:count] + t] = state
        for t in range(int(lengths.max(initial=1)) - 2, -1, -1):
            count = int(np.searchsorted(-lengths, -(t + 1), side="left"))
            at = starts[:count] + t
            after = (local[at + 1] * backward[at + 1]) @ link.T
            backward[at] = after / after.sum(axis=1, keepdims=True)
        both = forward * backward
        good = both[:, 1] / both.sum(axis=1)
        inner = np.ones(len(rows), dtype=bool)
        inner[starts + lengths - 1] = False
        at = np.flatnonzero(inner)
        joint = forward[at][:, :, None] * link[None] * (local[at + 1] * backward[at + 1])[:, None, :]
        pairs = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0) if len(at) else np.zeros((2, 2))
        result: list = [None] * len(chains)
        for k, number in enumerate(order):
            result[number] = good[starts[k] : starts[k] + lengths[k]]
        return result, pairs

    def means(self, chains: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
        """The length-weighted mean of P(good) over the lines of each document."""
        good, _ = self.marginals(chains)
        return np.array([float(g @ w / w.sum()) for g, w in zip(good, weights)])

    def scores(self, chains: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.means(chains, weights) + self.shift)))


def fit_field(chains: list[np.ndarray], weights: list[np.ndarray], labels: np.ndarray) -> LineField:
    """The field whose lines all carry their document's label with the largest penalised likelihood.

    Classes weigh the same in the calibration only in so far as they occur: the last step is a logistic
    fit of the document's label on its mean marginal.
    """
    size = 3 * OWN_FEATURES
    field = LineField(np.zeros(size), np.zeros((2, 2)))
    if not len(labels) or labels.min() == labels.max():
        # Nothing to tell apart: the share of good labels, or one half without any.
        share = float(labels.mean()) if len(labels) else 0.5
        share = min(0.99, max(0.01, share))
        field.scale, field.shift = 0.0, math.log(share / (1 - share))
        return field
    rows = np.concatenate(chains)
    target = np.concatenate([np.full(len(c), y) for c, y in zip(chains, labels)])
    steps = [(len(c) - 1, int(y)) for c, y in zip(chains, labels)]
    seen = np.zeros((2, 2))
    for count, y in steps:
        seen[y, y] += count
    n = len(rows)
    gathered = [np.zeros(size), np.zeros((2, 2))]
    for _ in range(STEPS):
        good, pairs = field.marginals(chains)
        slope = (rows.T @ (target - np.concatenate(good))) / n - PENALTY * field.unary
        pair_slope = (seen - pairs) / n - PENALTY * field.pair
        gathered[0] += slope**2
        gathered[1] += pair_slope**2
        field.unary = field.unary + RATE * slope / np.sqrt(gathered[0] + 1e-8)
        field.pair = field.pair + RATE * pair_slope / np.sqrt(gathered[1] + 1e-8)
    mean = field.means(chains, weights)
    scale, shift = 0.0, 0.0
    for _ in range(50):  # Newton steps of a penalised logistic fit
        p = 1 / (1 + np.exp(-(scale * mean + shift)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([(labels - p) @ mean - 1e-2 * scale, (labels - p).sum()])
        h = np.array([[w @ mean**2 + 1e-2, w @ mean], [w @ mean, w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        scale, shift = scale + step[0], shift + step[1]
    field.scale, field.shift = float(scale), float(shift)
    return field


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1


def fit_on_labels(docs: DataFrame, labels: DataFrame, most: int = TRAINING_DOCUMENTS) -> LineField:
    """Fit on at most ``most`` labelled rows that are not held out, whole texts, chosen by a hash."""
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = id_and_text(docs).join(F.broadcast(chosen), "doc_id")

    def work(batches):
        for batch in batches:
            rows = [line_features(text) for text in batch["text"]]
            yield {
                "doc_id": batch["doc_id"],
                "quality": batch["quality"],
                "features": [f.astype("<f4").tobytes() for f, _ in rows],
                "lengths": [w.astype("<f4").tobytes() for _, w in rows],
            }

    schema = "doc_id long, quality int, features binary, lengths binary"
    frame = texts.select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
    rows = sorted(map_batches(frame, work, schema).collect())
    chains = [
        np.frombuffer(r["features"], dtype="<f4").reshape(-1, 3 * OWN_FEATURES).astype(float) for r in rows
    ]
    weights = [np.frombuffer(r["lengths"], dtype="<f4").astype(float) for r in rows]
    return fit_field(chains, weights, np.array([r["quality"] for r in rows]))


def score_documents(docs: DataFrame, labels: DataFrame, most: int = TRAINING_DOCUMENTS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    Each line is labelled good or bad from its own features and its neighbours' by a chain fitted on
    documents' labels; the score is the calibrated mean of its lines' P(good), weighted by length. Null
    text counts as empty and is scored like an empty line. Rows without an id are not held out; labels
    of ids without a document are not used; without usable labels every score is one half. The fit
    reads ``most`` labelled rows at most; scoring is one pass over all rows without a shuffle.
    """
    field = fit_on_labels(docs, labels, most)

    def work(batches):
        for batch in batches:
            ids, scores = batch["doc_id"], []
            for k in range(0, len(ids), 500):
                rows = [line_features(text) for text in batch["text"][k : k + 500]]
                scores += field.scores([f for f, _ in rows], [w for _, w in rows]).tolist()
            yield {
                "doc_id": ids,
                "held_out": [i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in ids],
                "score": scores,
                "predicted": [int(s >= 0.5) for s in scores],
            }

    return map_batches(
        id_and_text(docs), work, "doc_id long, held_out boolean, score double, predicted int"
    )
