"""Convolutional toxicity classifier, trained and run in numpy.

Words (A-Z lower-cased; ASCII letters, digits and everything beyond ASCII) are hashed
into an embedding table, once whole and once by their first bytes, which inflected
forms share; a word's embedding is the sum. Filters of widths 1, 2 and 3 run over a text's words, each
filter keeps its maximum over the whole text, and a dense layer gives the score. The
score is calibrated on all labelled rows, each scored by a fit that did not see it;
thresholds are then calibrated per language on the same rows, drawn towards the common
one where a language has few of them.

Only the text enters a score; language selects a threshold afterwards.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from blocklens.llm.common import blocks, part_bytes, pick, with_columns
from blocklens.llm.wordhash import scan, word_class

TABLE_BITS = 16
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Bounds of the rows that a fit reads; longer texts are not used for fitting.
MAX_PER_LABEL = 2000
MAX_FIT_BYTES = 60_000
HEAD_BYTES = 4
#: Rows of its rarer label at which a language's own cut weighs as much as the common one.
PRIOR_ROWS = 10
#: Parts of the labelled rows; each is scored by a fit on the others, for calibration.
FOLDS = 5


def word_ids(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed words (whole, heads) of runs of rows, and where each row's begin."""
    inside = word_class("alnum")
    for _, _, data, offsets in blocks(*part_bytes(column)):
        words = scan(data, offsets, inside, HEAD_BYTES)
        both = np.stack([words.hashes, words.heads ^ np.uint64(1 << 63)])
        yield (both >> np.uint64(64 - TABLE_BITS)).astype(np.int32), words.first


@dataclass
class TextCnn:
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.7

    @classmethod
    def fresh(cls, seed: int = 5) -> TextCnn:
        rng = np.random.default_rng(seed)
        return cls(
            rng.normal(0, 0.02, (1 << TABLE_BITS, DIM)).astype(np.float32),
            [rng.normal(0, (2 / DIM) ** 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
            np.zeros(len(WIDTHS) * FILTERS, np.float32),
            rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32),
        )

    def tables(self) -> list[list[np.ndarray]]:
        """Each word's part in each filter place, so that running is adding table rows."""
        return [[self.embedding @ f[j] for j in range(len(f))] for f in self.filters]

    def pooled(self, ids: np.ndarray, first: np.ndarray, tables: list[list[np.ndarray]] | None = None, where: bool = False):
        """Rectified maxima of every filter over each row; a row of too few words has 0.

        With ``where``, also the word at which each maximum lies (-1 for none).
        """
        rows, tables = len(first) - 1, tables or self.tables()
        best = np.zeros((rows, len(WIDTHS) * FILTERS), np.float32)
        place = np.full(best.shape, -1, np.int64)
        for g, (width, parts) in enumerate(zip(WIDTHS, tables, strict=True)):
            own = slice(g * FILTERS, (g + 1) * FILTERS)
            some = np.flatnonzero(np.diff(first) >= width)
            n = ids.shape[1] - width + 1
            if not len(some) or n <= 0:
                continue
            # The row after the last window lets a span end there.
            made = np.full((n + 1, FILTERS), -np.inf, np.float32)
            made[:n] = parts[0][ids[0, :n]]
            made[:n] += parts[0][ids[1, :n]]
            for j in range(1, width):
                for kind in ids:
                    made[:n] += parts[j][kind[j : j + n]]
            # A run that begins in a row's last words goes on into the next row.
            cut = np.empty(2 * len(some), np.int64)
            cut[::2], cut[1::2] = first[some], first[some + 1] - width + 1
            top = np.maximum.reduceat(made, cut, axis=0)[::2]
            best[some, own] = np.maximum(top + self.bias[own], 0)
            if where:
                for r, t in zip(some.tolist(), top, strict=True):
                    a, b = int(first[r]), int(first[r + 1]) - width + 1
                    hit = made[a:b].argmax(axis=0) + a
                    place[r, own] = np.where(t + self.bias[own] > 0, hit, -1)
        return (best, place) if where else best

    def logit(self, best: np.ndarray) -> np.ndarray:
        # A sum by row does not depend on the other rows, as a matrix product's rounding does.
        return (best * self.out).sum(axis=1) + self.out_bias

    def score(self, column: pa.Array) -> np.ndarray:
        tables = self.tables()
        raw = [self.logit(self.pooled(ids, first, tables)) for ids, first in word_ids(column)]
        a, b = self.scale
        return sigmoid(a * np.concatenate(raw).astype(np.float64) + b) if raw else np.zeros(0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def logit_of(p: float) -> float:
    p = min(max(p, 1e-9), 1 - 1e-9)
    return float(np.log(p / (1 - p)))


def calibrate(logits: np.ndarray, labels: np.ndarray, steps: int = 300) -> tuple[float, float]:
    """Platt's scale and shift, by Newton steps on smoothed targets."""
    pos, neg = labels.sum(), (1 - labels).sum()
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([logits, np.ones(len(logits))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * (w - [1.0, 0.0]))
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the best cut by F1."""
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    i = int(f1.argmax())
    return float((s[i] + s[i + 1]) / 2 if i + 1 < len(s) else s[i])


def trained(docs: list[np.ndarray], label: np.ndarray, train: np.ndarray, *, epochs: int = 6, least_steps: int = 400, batch: int = 32, rate: float = 0.01, seed: int = 5) -> TextCnn:
    """A net after Adam's steps over the rows ``train``; its scores are not calibrated."""
    net = TextCnn.fresh(seed)
    rng = np.random.default_rng(seed)
    weight = np.where(label == 1, (1 - label[train]).sum() / max(1, label[train].sum()), 1.0) ** 0.5
    params = [net.embedding, *net.filters, net.bias, net.out]
    first_moment, second_moment = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t, epochs = 0, max(epochs, -(-least_steps * batch // max(1, len(train))))
    for epoch in range(epochs):
        step_rate = rate * (1 - epoch / epochs)
        for chosen in np.array_split(rng.permutation(train), max(1, len(train) // batch)):
            ids = np.concatenate([docs[i] for i in chosen], axis=1)
            first = np.cumsum([0, *(docs[i].shape[1] for i in chosen)])
            grads = [np.zeros_like(p) for p in params[1:]]
            words, local = np.unique(ids, return_inverse=True)
            local = local.reshape(ids.shape)
            small = TextCnn(net.embedding[words], net.filters, net.bias, net.out, net.out_bias)
            best, place = small.pooled(local, first, where=True)
            p = sigmoid(small.logit(best))
            err = ((p - label[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
            grads[-1] += best.T @ err
            back = err[:, None] * net.out[None, :]
            back[place < 0] = 0
            grads[-2] += back.sum(axis=0)
            emb_grad = np.zeros_like(small.embedding)
            for g, (width, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
                own = slice(g * FILTERS, (g + 1) * FILTERS)
                r, c = np.nonzero(place[:, own] >= 0)
                at, b = place[:, own][r, c], back[:, own][r, c]
                for j in range(width):
                    whole, head = local[:, at + j]
                    np.add.at(grads[g][j].T, c, b[:, None] * (small.embedding[whole] + small.embedding[head]))
                    np.add.at(emb_grad, whole, b[:, None] * f[j].T[c])
                    np.add.at(emb_grad, head, b[:, None] * f[j].T[c])
            t += 1
            fix = (1 - 0.999**t) ** 0.5 / (1 - 0.9**t)
            net.out_bias -= 0.1 * step_rate * float(err.sum()) * len(chosen) ** 0.5
            for k, (param, m, v) in enumerate(zip(params, first_moment, second_moment, strict=True)):
                at, grad = (words, emb_grad) if k == 0 else (slice(None), grads[k - 1])
                m[at] = 0.9 * m[at] + 0.1 * grad
                v[at] = 0.999 * v[at] + 0.001 * grad * grad
                param[at] -= step_rate * fix * m[at] / (np.sqrt(v[at]) + 1e-8)
    return net


def logits(net: TextCnn, docs: list[np.ndarray], chosen: np.ndarray, batch: int = 32) -> np.ndarray:
    tables, out = net.tables(), np.zeros(len(chosen))
    for some in np.array_split(np.arange(len(chosen)), max(1, len(chosen) // batch)):
        own = [docs[i] for i in chosen[some]]
        out[some] = net.logit(net.pooled(np.concatenate(own, axis=1), np.cumsum([0, *(d.shape[1] for d in own)]), tables))
    return out


def fits(docs: list[np.ndarray], label: np.ndarray, part: np.ndarray, spark: SparkSession | None, **steps) -> tuple[np.ndarray, TextCnn]:
    """Every row's logit by the fit that did not see its part, and the fit on all rows.

    With a session each fit is a task of its own; what goes out and comes back is bounded
    by the sample.
    """
    def one(fold: int) -> tuple[np.ndarray, TextCnn | None]:
        unseen = np.flatnonzero(part == fold)
        if fold < FOLDS and not len(unseen):
            return np.zeros(0), None
        net = trained(docs, label, np.flatnonzero(part != fold), **steps)
        return (logits(net, docs, unseen), None) if fold < FOLDS else (np.zeros(0), net)

    if spark is None:
        made = [one(fold) for fold in range(FOLDS + 1)]
    else:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for fold in batch.column("id").to_pylist():
                    yield pa.RecordBatch.from_pydict({"fold": pa.array([fold], pa.int64()), "made": pa.array([pickle.dumps(one(fold))], pa.binary())})

        found = spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInArrow(run, "fold long, made binary").collect()
        made = [pickle.loads(r["made"]) for r in sorted(found, key=lambda r: r["fold"])]
    raw = np.zeros(len(docs))
    for fold in range(FOLDS):
        raw[part == fold] = made[fold][0]
    return raw, made[FOLDS][1]


def fit(rows: pa.Table, *, seed: int = 5, spark: SparkSession | None = None, **steps) -> TextCnn:
    """Fit on all ``rows(text, label, lang)``, calibrated by cross-fitting over the same rows.

    The texts are hashed at once; only their words' numbers are held while fitting.
    """
    net = TextCnn.fresh(seed)
    label = np.array(rows.column("label").to_pylist(), np.float32)
    if len(set(label.tolist())) < 2:
        # Nothing to tell apart: every text gets the same low score.
        net.out[:] = 0
        net.scale = (1.0, -6.0 if not label.any() else 6.0)
        return net
    docs = [np.ascontiguousarray(ids[:, a:b]) for ids, first in word_ids(rows.column("text")) for a, b in zip(first[:-1], first[1:], strict=True)]
    langs = np.array([str(x) for x in rows.column("lang").to_pylist()])
    del rows
    pa.default_memory_pool().release_unused()
    part = np.zeros(len(docs), np.int64)
    rng = np.random.default_rng(seed)
    for y in (0, 1):
        own = np.flatnonzero(label == y)
        part[rng.permutation(own)] = np.arange(len(own)) % FOLDS
    raw, net = fits(docs, label, part, spark, seed=seed, **steps)
    seen = label.astype(np.int64)
    net.scale = calibrate(raw, seen)
    scores = sigmoid(net.scale[0] * raw + net.scale[1])
    cut = best_threshold(scores, seen)
    # The best common cut becomes a score of 0.7, so that 0.7 means the same for every fit.
    # A cut below all rows tells nothing apart; then the probabilities stay as they are.
    if cut > scores.min():
        net.scale = (net.scale[0], net.scale[1] + np.log(0.7 / 0.3) - logit_of(cut))
        scores = sigmoid(net.scale[0] * raw + net.scale[1])
    for lang in sorted(set(langs)):
        at = langs == lang
        least = int(min(seen[at].sum(), (1 - seen[at]).sum()))
        if least:
            # A language's own cut counts by the rows that it rests on.
            net.thresholds[lang] = net.threshold + (best_threshold(scores[at], seen[at]) - net.threshold) * least / (least + PRIOR_ROWS)
    return net


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, *, label_col: str, id_col: str, text_col: str, lang_col: str, per_label: int = MAX_PER_LABEL, max_bytes: int = MAX_FIT_BYTES) -> pa.Table:
    """At most ``per_label`` labelled rows of either label, in the order of a hash of the id."""
    named = pick(labels, id=id_col, label=label_col).filter("id IS NOT NULL AND label IN (0, 1)").dropDuplicates(["id"]).filter(usable)
    by_hash = [named.filter(F.col("label") == y).orderBy(F.xxhash64(F.lit("fit"), "id"), "id").limit(per_label) for y in (0, 1)]
    sample = by_hash[0].unionByName(by_hash[1])
    texts = pick(docs, id=id_col, text=text_col, lang=lang_col).filter(F.octet_length("text") <= max_bytes)
    # The sample's size is bounded by the limit above.
    found = texts.join(F.broadcast(sample), "id").dropDuplicates(["id"])
    return found.orderBy("id").select("text", "lang", "label").toArrow()


def scored_rows(docs: DataFrame, labels: DataFrame, usable: Column | None = None, *, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> DataFrame:
    """The rows of ``docs`` in all their columns, and ``__score, __threshold, __toxic``.

    The fit reads a bounded sample of the labels for which ``usable`` (a condition on
    ``id``) holds: at most ``per_label`` rows of either label, less those whose text has
    more than ``max_bytes`` bytes (2,000 and 60,000). Every whole text is then scored in
    one narrow pass, row by row: rows that share an id are told apart. Null and empty
    texts get the score of a text without words; rows of an unknown or null language
    get the common threshold; repeated rows score alike; without both labels every
    score is low; an empty table gives an empty result; other columns are carried along.
    """
    usable = F.lit(True) if usable is None else usable
    net = fit(training_rows(docs, labels, usable, label_col=label_col, id_col=id_col, text_col=text_col, lang_col=lang_col, **bounds), spark=docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            score = net.score(batch.column(text_col))
            cut = np.array([net.thresholds.get(str(x), net.threshold) for x in batch.column(lang_col).to_pylist()])
            yield with_columns(batch, {"__score": pa.array(score), "__threshold": pa.array(cut, pa.float64()), "__toxic": pa.array(score >= cut)})

    kinds = StructType([*docs.schema.fields, *(StructField(n, t) for n, t in (("__score", DoubleType()), ("__threshold", DoubleType()), ("__toxic", BooleanType())))])
    return docs.mapInArrow(run, kinds)


def toxicity(docs: DataFrame, labels: DataFrame, usable: Column | None = None, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Per row of ``docs``: ``id, score, threshold, toxic``, as ``scored_rows`` finds them; other columns are ignored."""
    named = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys((id_col, text_col, lang_col))))
    scored = scored_rows(named, labels, usable, id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    return scored.select(F.col(f"`{id_col}`").alias("id"), F.col("__score").alias("score"), F.col("__threshold").alias("threshold"), F.col("__toxic").alias("toxic"))
