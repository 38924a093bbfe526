"""Document quality by co-training two views: what a text says, and what is known about its page.

The text view measures the whole text (character classes, repetition, word and line shapes), the
metadata view the language, source and stated length. Each view has a logistic classifier. In
every round each one labels the unlabelled documents of which it is sure, by a probability
calibrated on labelled rows kept aside, and all of them join the labelled rows in training the
other view, unless that one is as sure of the opposite. In the end a logistic function of both calibrated views scores all documents.

At most ``max_labelled`` labelled rows are on the driver. Confident documents of any number take
part where they are: the text view is fitted by Newton's method on sums over them, the metadata
view on counts of its distinct feature vectors. Where they outnumber the labelled rows, they are
weighted down to as much in all, so that they do not drown what is known.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.shared import stored, unused
from gradeloom.llm.words import encoded

MAX_LABELLED, ROUNDS = 20_000, 3
SURE, KEEP_FROM = 0.95, 0.5
CHARS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n\r", b"\t",
         b"!", b"|", b"%&$*#", b".", b",;:", b"?", b"'\"()[]{}", b"-_=+~^`", b"<>/\\@", bytes(range(0x80, 0x100)))
LANGS, SOURCES, SIZES = 8, 32, 8
_CLASS = np.full(256, len(CHARS))
for _i, _chars in enumerate(CHARS):
    _CLASS[list(_chars)] = _i
META = ("lang", "source", "n_chars")


def text_features(text: bytes) -> list[float]:
    """Shares of character classes, and measures of repetition and of word and line lengths."""
    n = max(len(text), 1)
    classes = np.bincount(_CLASS, np.bincount(np.frombuffer(text, np.uint8), minlength=256), len(CHARS) + 1) / n
    words, lines = text.split(), text.split(b"\n")
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    upper = classes[0] / max(classes[0] + classes[1], 1e-9)
    return [*np.sqrt(classes).tolist(), float(upper), len(set(words)) / max(len(words), 1),
            len(set(lines)) / len(lines), float(np.log1p(len(words))), float(np.log1p(lengths.mean())),
            float(np.log1p(lengths.std())), float(np.log1p(len(words) / len(lines)))]


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """One bit each for language, source (by hash) and order of length; nulls have none set."""
    out = [0.0] * (LANGS + SOURCES + SIZES)
    if lang is not None:
        out[zlib.crc32(lang.encode()) % LANGS] = 1.0
    if source is not None:
        out[LANGS + zlib.crc32(source.encode()) % SOURCES] = 1.0
    if n_chars is not None:
        out[LANGS + SOURCES + min(SIZES - 1, max(0, int(np.log10(max(n_chars, 1)) * 2)))] = 1.0
    return out


def _features(batch: pa.RecordBatch) -> tuple[list[list[float]], list[list[float]]]:
    names = batch.schema.names
    t = [text_features(x or b"") for x in encoded(batch.column("text"))]
    columns = [batch.column(c).to_pylist() if c in names else [None] * len(batch) for c in META]
    return t, [meta_features(*row) for row in zip(*columns, strict=True)]


@dataclass
class Logistic:
    """Weights over standardised features, the last one for the constant."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return z @ self.weights[:-1] + self.weights[-1]


@dataclass
class Sums:
    """Rows that are elsewhere: how many, sums of their features and squares, and sums for a step.

    ``newton`` maps a classifier to the Hessian and the gradient of the rows' loss.
    """

    n: float
    x: np.ndarray
    xx: np.ndarray
    newton: Callable[[Logistic], tuple[np.ndarray, np.ndarray]]


def _standard(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.hstack([np.clip((x - mean) / spread, -8, 8), np.ones((len(x), 1))])


def newton_sums(model: Logistic, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hessian and gradient of the weighted loss of some rows."""
    z = _standard(x, model.mean, model.spread)
    p = 1 / (1 + np.exp(-np.clip(z @ model.weights, -30, 30)))
    return (z * (weight * p * (1 - p))[:, None]).T @ z, z.T @ (weight * (p - y))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, weight: np.ndarray | None = None,
                 far: Sums | None = None, far_weight: float = 1.0) -> Logistic:
    """Newton's method with a ridge penalty; with no variation in ``y`` the smoothed base rate.

    ``weight`` counts the rows, each once if missing; ``far`` adds rows of weight ``far_weight``.
    """
    weight = np.ones(len(x)) if weight is None else weight
    n, sums, squares = weight.sum(), weight @ x, weight @ x**2
    if far is not None:
        n, sums, squares = n + far_weight * far.n, sums + far_weight * far.x, squares + far_weight * far.xx
    mean = sums / n
    spread = np.maximum(np.sqrt(np.maximum(squares / n - mean**2, 0)), 1e-6)
    model = Logistic(mean, spread, np.zeros(x.shape[1] + 1))
    penalty = np.full(x.shape[1] + 1, ridge)
    penalty[-1] = 1e-3
    for _ in range(30):
        hessian, gradient = newton_sums(model, x, y, weight)
        if far is not None:
            more = far.newton(model)
            hessian, gradient = hessian + far_weight * more[0], gradient + far_weight * more[1]
        step = np.linalg.solve(hessian + np.diag(penalty), gradient + penalty * model.weights)
        model.weights = model.weights - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return model


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Views:
    """Both classifiers, their calibration and their combination."""

    text: Logistic
    meta: Logistic
    text_scale: Logistic
    meta_scale: Logistic
    both: Logistic | None = None

    def scores(self, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated logits of the two views."""
        return (self.text_scale.logit(self.text.logit(t)[:, None]),
                self.meta_scale.logit(self.meta.logit(m)[:, None]))

    def score(self, t: np.ndarray, m: np.ndarray) -> np.ndarray:
        return _sigmoid(self.both.logit(np.column_stack(self.scores(t, m))))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, key, t, m): the features of every row; ``key`` is a hash of the row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, m = _features(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(t, pa.list_(pa.float32())),
                 pa.array(m, pa.list_(pa.float32()))], ["doc_id", "key", "t", "m"])
    return _inputs(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text",
                                *_inputs(docs).columns[2:]).mapInArrow(
        run, "doc_id long, key long, t array<float>, m array<float>")


def _metadata(docs: DataFrame) -> dict[str, Column]:
    kinds = {"lang": "string", "source": "string", "n_chars": "long"}
    return {c: F.col(c).cast(kinds[c]) for c in META if c in docs.columns}


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text", *[value.alias(c) for c, value in _metadata(docs).items()])


def _matrix(rows: list, name: str, width: int) -> np.ndarray:
    return np.array([r[name] for r in rows], float).reshape(len(rows), width)


def _rows_of(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(c).flatten().to_numpy().astype(float).reshape(len(batch), -1) for c in names]


def taught(views: Views, t: np.ndarray, m: np.ndarray) -> dict[str, np.ndarray]:
    """By the view that learns: 1 or 0 where the other view is sure of it, else -1.

    A row on which the views contradict each other, both being sure, teaches neither.
    """
    said = {}
    for view, logit in zip("tm", views.scores(t, m), strict=True):
        p = _sigmoid(logit)
        said[view] = np.where(np.maximum(p, 1 - p) >= SURE, p > 0.5, -1).astype(int)
    clash = (said["t"] >= 0) & (said["m"] >= 0) & (said["t"] != said["m"])
    return {learner: np.where(clash, -1, said[teacher]) for learner, teacher in (("m", "t"), ("t", "m"))}


def _summed(pool: DataFrame, views: Views, of: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
    """Sums of what ``of`` makes of the features and labels of all rows that teach the text view."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not len(batch):
                continue
            t, m = _rows_of(batch, "t", "m")
            y = taught(views, t, m)["t"]
            found = of(t[y >= 0], y[y >= 0])
            total = found if total is None else [a + b for a, b in zip(total, found, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([a.ravel() for a in total])])], ["v"])
    parts = [np.array(r.v) for r in pool.mapInArrow(run, "v array<double>").collect()]
    shapes = [a.shape for a in of(np.zeros((0, len(views.text.mean))), np.zeros(0))]
    ends = np.cumsum([int(np.prod(s)) for s in shapes])
    flat = sum(parts, np.zeros(ends[-1]))
    return [part.reshape(s) for part, s in zip(np.split(flat, ends[:-1]), shapes, strict=True)]


def text_sums(pool: DataFrame, views: Views) -> Sums:
    """All rows that teach the text view, as sums."""
    n, x, xx = _summed(pool, views, lambda t, y: [np.array([float(len(t))]), t.sum(axis=0), (t**2).sum(axis=0)])
    return Sums(float(n[0]), x, xx, lambda model: tuple(
        _summed(pool, views, lambda t, y: list(newton_sums(model, t, y, np.ones(len(t)))))))


def meta_counts(pool: DataFrame, views: Views) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features, label and count of all rows that teach the metadata view.

    There are at most (LANGS + 1) * (SOURCES + 1) * (SIZES + 1) features, at any corpus size.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            t, m = _rows_of(batch, "t", "m")
            y = taught(views, t, m)["m"]
            rows, n = np.unique(np.column_stack([m, y])[y >= 0], axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.tobytes() for r in rows.astype(np.uint8)], pa.binary()), pa.array(n.astype(np.int64))], ["x", "n"])
    found = sorted(pool.mapInArrow(run, "x binary, n long").groupBy("x").agg(F.sum("n").alias("n")).collect(), key=lambda r: r.x)
    rows = np.array([list(r.x) for r in found], float).reshape(len(found), len(views.meta.mean) + 1)
    return rows[:, :-1], rows[:, -1], np.array([r.n for r in found], float)


def fit_views(
    table: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS,
) -> Views | float:
    """Co-train on a measured table and ``labels`` (doc_id, quality); the base rate if that has one class.

    Of repeated labels of a document the largest counts; other values than 0 and 1 and nulls do
    not. Beyond ``max_labelled`` labelled rows a share of them by hash is taken, and a quarter of
    those taken serves for calibration. The labels that views give each other in a round replace
    those of the round before.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(
        F.max("quality").alias("y"))
    labelled = table.join(known, "doc_id")
    share = max_labelled / max(1, labelled.count())
    # A share of all hashes reaches the driver, not the smallest of every task.
    part = F.shiftrightunsigned(F.col("key"), 11) / F.lit(float(1 << 53))
    rows = sorted(labelled.where(part < share).collect(), key=lambda r: (r.key, r.doc_id))[:max_labelled]
    y = np.array([r.y for r in rows], float)
    aside = np.arange(len(rows)) % 4 == 3
    if any(len(set(y[part].tolist())) < 2 for part in (aside, ~aside)):
        return float(y.mean()) if len(y) else 1.0
    t = _matrix(rows, "t", len(text_features(b"")))
    m = _matrix(rows, "m", LANGS + SOURCES + SIZES)
    learn, n_learn = ~aside, int((~aside).sum())
    text, meta = fit_logistic(t[learn], y[learn]), fit_logistic(m[learn], y[learn])
    pool = stored(table.join(known, "doc_id", "left_anti").select("t", "m"))
    for turn in range(rounds + 1):
        views = Views(text, meta, fit_logistic(text.logit(t[aside])[:, None], y[aside]),
                      fit_logistic(meta.logit(m[aside])[:, None], y[aside]))
        if turn == rounds:
            break
        sums, (x, said, n) = text_sums(pool, views), meta_counts(pool, views)
        text = fit_logistic(t[learn], y[learn], far=sums, far_weight=min(1.0, n_learn / max(sums.n, 1)))
        meta = fit_logistic(np.vstack([m[learn], x]), np.concatenate([y[learn], said]), weight=np.concatenate(
            [np.ones(n_learn), n * min(1.0, n_learn / max(n.sum(), 1))]))
    views.both = fit_logistic(np.column_stack(views.scores(t[aside], m[aside])), y[aside])
    return views


def quality_scores(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, **fitting) -> DataFrame:
    """(doc_id, text_score, meta_score, score, keep) of every row of ``docs``.

    ``docs`` has doc_id and text, and lang, source and n_chars if known; other columns are not
    read. A null or empty text and null metadata have features of their own and are scored; rows
    with a null doc_id are scored but never labelled; repeated rows get equal scores. Without
    labels of both classes every score is the base rate (1 without labels).
    """
    table = stored(measured(docs))
    views = fit_views(table, labels, **fitting)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if isinstance(views, float) or not len(batch):
                scores = [np.full(len(batch), views if isinstance(views, float) else 0.0)] * 3
            else:
                t, m = (np.array(batch.column(c).to_pylist(), float) for c in "tm")
                scores = [*map(_sigmoid, views.scores(t, m)), views.score(t, m)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, scores), pa.array(scores[2] >= keep_from)],
                ["doc_id", "text_score", "meta_score", "score", "keep"])
    return table.select("doc_id", "t", "m").mapInArrow(
        run, "doc_id long, text_score double, meta_score double, score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, **fitting) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``keep_from``; all columns kept.

    Texts are measured again where they are instead of being moved for a join with their scores.
    """
    views = fit_views(stored(measured(docs)), labels, **fitting)
    # The metadata once more in the types it is measured in, whatever its own ones are.
    typed = {c: unused(docs, f"_{c}") for c in _metadata(docs)}
    columns, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(columns)
            if isinstance(views, float) or not len(rows):
                yield rows if not isinstance(views, float) or views >= keep_from else rows.slice(0, 0)
                continue
            measured_as = pa.RecordBatch.from_arrays(
                [batch.column("text"), *map(batch.column, typed.values())], ["text", *typed])
            t, m = (np.array(x, float) for x in _features(measured_as))
            yield rows.filter(pa.array(views.score(t, m) >= keep_from))
    wide = docs.withColumns({typed[c]: value for c, value in _metadata(docs).items()})
    return wide.mapInArrow(run, schema)
