"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other. The model of each is a logistic regression on a document's features
and the probabilities of the categories before it. Those probabilities are out-of-fold while fitting: each
training row gets them from models that have not seen its fold, so a later model learns from errors as large
as those it will meet. At scoring time they come from the earlier models of the chain.

Features say whether a lower-cased word, or a word beginning of 4 or 5 bytes, occurs anywhere in the text; each model
uses the features that tell its category best apart (by chi-square, within its own training rows).

The last category is decided by a threshold on its probability: the one that is right for most training rows, judged
by out-of-fold probabilities, and in the middle of its range, by odds.

Fitting: at most `max_rows` labelled rows, the first by a hash of their id, of texts up to `max_bytes`. That
bound is the only one: every document is scored, and whole. Scoring shuffles nothing; the models sent to the
workers have at most `features` weights a category.

Defined results: a null or empty text has no features and gets the chain's base probabilities. A label that is null is not
trained on. Of labels repeated for an id one row counts, the largest. If a category's labels
are all alike, or there are none, its probability is their (smoothed) share everywhere. Rows come back one for one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm.common import MARK_WORDS, columns_of, small_batches, words_of

MAX_ROWS, MAX_BYTES, FEATURES, FOLDS = 6000, 40_000, 400, 4
LEAST_ROWS = 3
HEADS = (4, 5)


def features_of(text: bytes | None) -> set[bytes]:
    """Words, and their beginnings with a mark that no word holds."""
    words = set(words_of(text, MARK_WORDS))
    out = set(words)
    for n in HEADS:
        out.update({w[:n] + b" %d" % n for w in words})
    return out


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weights, the intercept last, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(12):
        p = logistic(x @ w)
        slope = x.T @ (p - y) + penalty * w
        curve = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w = w - step
        if np.abs(step).max() < 1e-3:
            break
    return w


class Sample:
    """Features of training texts, each feature kept once, and texts as arrays of feature numbers."""

    def __init__(self, texts):
        number: dict[bytes, int] = {}
        self.texts = [np.fromiter((number.setdefault(f, len(number)) for f in sorted(features_of(t))), np.int32) for t in texts]
        self.names = list(number)

    def rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of some texts, and the place in `rows` that each is of."""
        own = [self.texts[i] for i in rows]
        return np.concatenate([np.zeros(0, np.int32), *own]), np.repeat(np.arange(len(own)), [len(x) for x in own])

    def matrix(self, rows: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """A row of 0 and 1 for each text, by the chosen features."""
        column = np.full(len(self.names) + 1, -1)
        column[chosen] = np.arange(len(chosen))
        ids, at = self.rows(rows)
        hit = column[ids] >= 0
        x = np.zeros((len(rows), len(chosen)))
        x[at[hit], column[ids[hit]]] = 1
        return x

    def best(self, rows: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
        """The features of largest chi-square for labels y of rows; ties by their number."""
        ids, at = self.rows(rows)
        n, yes = len(y), float(y.sum())
        total = np.bincount(ids, minlength=len(self.names)).astype(np.float64)
        with_yes = np.bincount(ids, weights=y[at], minlength=len(self.names))
        score = n * (with_yes * n - total * yes) ** 2 / np.maximum(total * (n - total) * yes * (n - yes), 1e-9)
        common = np.flatnonzero(total >= LEAST_ROWS)
        return common[np.lexsort((common, -score[common]))][:most]


class Link:
    """One model of the chain: weights of features, of earlier probabilities, and an intercept."""

    def __init__(self, sample: Sample, rows: np.ndarray, earlier: np.ndarray, y: np.ndarray, most: int):
        n = len(y)
        self.sample, self.chosen, self.w, self.earlier = sample, np.zeros(0, np.int64), np.zeros(0), np.zeros(earlier.shape[1])
        share = (float(y.sum()) + 0.5) / (n + 1)
        self.intercept = float(np.log(share / (1 - share)))
        if n and y.min() != y.max():
            self.chosen = sample.best(rows, y, most)
            w = fit_logistic(np.hstack([sample.matrix(rows, self.chosen), earlier]), y)
            self.w, self.earlier, self.intercept = w[: len(self.chosen)], w[len(self.chosen) : -1], float(w[-1])
        self.weights = {sample.names[i]: float(w) for i, w in zip(self.chosen, self.w)}

    def of_rows(self, rows: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """Probabilities of texts of the sample."""
        return logistic(self.sample.matrix(rows, self.chosen) @ self.w + earlier @ self.earlier + self.intercept)

    def probability(self, found: set[bytes], earlier: Sequence[float]) -> float:
        """found: features of the text, at least those with weights."""
        z = self.intercept + (float(np.dot(self.earlier, earlier)) if len(earlier) else 0.0)
        return float(logistic(np.float64(z + sum(map(self.weights.__getitem__, sorted(found & self.weights.keys()))))))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on to say yes: right most often, in the middle (by odds) of where that holds."""
    if not len(p) or y.min() == y.max():
        return 0.5
    p, y = (x[np.argsort(p, kind="stable")] for x in (np.clip(p, 1e-6, 1 - 1e-6), y))
    # Saying no to the first i: right for the noes among them and the yeses after.
    right = np.concatenate([[0], np.cumsum(1 - y)]) + (y.sum() - np.concatenate([[0], np.cumsum(y)]))
    right[1:-1][p[1:] == p[:-1]] = -1
    i = int(np.flatnonzero(right == right.max())[-1])
    low, high = (p[i - 1] if i else 1e-6), (p[i] if i < len(p) else 1 - 1e-6)
    odds = lambda x: np.log(x / (1 - x))
    return float(logistic((odds(low) + odds(high)) / 2))


class Chain:
    """Links for categories in order, and the threshold of the last."""

    def __init__(self, sample: Sample, labels: np.ndarray, folds: np.ndarray, most: int = FEATURES):
        n, k = labels.shape
        self.links: list[Link] = []
        earlier = np.zeros((n, 0))
        for j in range(k):
            known = ~np.isnan(labels[:, j])
            rows = np.flatnonzero(known)
            self.links.append(Link(sample, rows, earlier[rows], labels[rows, j], most))
            unseen = np.zeros(n)
            for f in np.unique(folds).tolist():
                train, held = rows[folds[rows] != f], np.flatnonzero(folds == f)
                unseen[held] = Link(sample, train, earlier[train], labels[train, j], most).of_rows(held, earlier[held])
            earlier = np.hstack([earlier, unseen[:, None]])
        self.unseen = earlier  # out-of-fold probabilities, by category
        self.threshold = best_threshold(unseen[known], labels[known, -1])

    def probabilities(self, text: bytes | None) -> list[float]:
        out: list[float] = []
        found = features_of(text)
        for link in self.links:
            out.append(link.probability(found, out))
        return out


class Scorer:
    """A chain's weights, indexed so that most words of a text are dismissed at once."""

    def __init__(self, chain: Chain):
        self.links = [(x.weights, x.earlier, x.intercept) for x in chain.links]
        used = {f for link in chain.links for f in link.weights}
        self.words = frozenset(f for f in used if b" " not in f)
        self.heads = [(n, frozenset(f[: f.index(b" ")] for f in used if f.endswith(b" %d" % n)), b" %d" % n) for n in HEADS]

    def probabilities(self, text: bytes | None) -> list[float]:
        words = set(words_of(text, MARK_WORDS))
        found = words & self.words
        for n, known, mark in self.heads:
            found |= {h + mark for h in known.intersection([w[:n] for w in words])}
        out: list[float] = []
        for weights, earlier, intercept in self.links:
            z = intercept + sum(map(weights.__getitem__, sorted(found & weights.keys())))
            out.append(float(logistic(np.float64(z + (np.dot(earlier, out) if out else 0.0)))))
        return out


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str], max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """A chain for label columns of 0 and 1, in their order, fitted on the driver on a bounded sample."""
    import xxhash

    order = F.xxhash64("id")
    marked = labels.select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(categories)]).filter("id IS NOT NULL")
    marked = marked.groupBy("id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(categories))])
    # Rows of too long texts leave the sample after the join, so a few more ids than asked for meet the texts.
    first = marked.orderBy(order, "id").limit(2 * max_rows)
    text = F.col(text_col).cast("binary")
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text")).filter((F.length("text") <= max_bytes))
    chosen = texts.join(F.broadcast(first), "id").orderBy(order, "id", "text").limit(max_rows)
    known: list[tuple] = []

    def each():
        for r in chosen.toLocalIterator():
            known.append((str(r["id"]), *[r[f"y{i}"] for i in range(len(categories))]))
            yield bytes(r["text"])

    sample = Sample(each())  # texts go as they come; their features stay
    y = np.array([[np.nan if v is None else float(v > 0) for v in r[1:]] for r in known], np.float64).reshape(len(known), len(categories))
    folds = np.array([xxhash.xxh3_64_intdigest(r[0]) % FOLDS for r in known], np.int64)
    return Chain(sample, y, folds)


def score(docs: DataFrame, chain: Chain, categories: Sequence[str], text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Rows (row, p): each row of docs as a struct of the columns in keep (default: all), and a struct of probabilities by category."""
    import pyarrow as pa

    small_batches(docs.sparkSession)
    wide = docs.select(F.struct(*(keep or ["*"])).alias("row"), F.col(text_col).cast("binary").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(Scorer(chain))  # some hundred weights a category
    kind = pa.struct([(c, pa.float64()) for c in categories])

    def run(it):
        scorer = sent.value
        for batch in it:
            got = [dict(zip(categories, scorer.probabilities(t))) for (t,) in columns_of([batch], "text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(got, kind)], names=["row", "p"])

    return wide.mapInArrow(run, T.StructType([wide.schema["row"], T.StructField("p", T.StructType([T.StructField(c, T.DoubleType()) for c in categories]))]))
