"""Quality classifier by co-training on two views of a page.

The content view is a logistic model over a text's words: whole, by their first and
by their last bytes, hashed, as shares of the text. The page view is a logistic model
over metadata alone: source, language and recorded length, each with the others; it
never sees the text. Over several rounds each view labels the unlabelled rows it is
surest of, in the proportion of the labels, and the other view learns from them; a view
hands over only rows of which its calibrated probability is ``CONFIDENT``, so that one
that can't tell teaches nothing. On labelled rows that no fit saw, each view is
calibrated and a last logistic step combines the two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklens.llm.common import blocks, part_bytes, pick
from blocklens.llm.toxicity import calibrate, logit_of, sigmoid
from blocklens.llm.wordhash import scan, word_class

BITS = 16
GROUPS = 64
#: Bounds of the rows that a fit reads; longer texts are not used for fitting.
MAX_PER_LABEL, MAX_UNLABELLED, MAX_FIT_BYTES = 1500, 3000, 60_000
ROUNDS, SHARE, CONFIDENT = 4, 0.05, 0.9


def content_ids(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Three hashed features per word of runs of rows, and where each row's words begin."""
    inside = word_class("space")
    for _, _, data, offsets in blocks(*part_bytes(column)):
        w = scan(data, offsets, inside, 3, 2)
        ids = np.stack([w.hashes, w.heads ^ np.uint64(1 << 62), w.tails ^ np.uint64(1 << 63)])
        yield (ids >> np.uint64(64 - BITS)).astype(np.int32), w.first


def row_means(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean of each row's values; 0 for a row without any."""
    total = np.concatenate(([0.0], np.cumsum(values)))
    n = np.diff(first)
    return (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)


#: Hashed metadata features, after the three plain ones.
PAGE = 3 + GROUPS * 6


def page_features(batch: pa.RecordBatch) -> np.ndarray:
    """Metadata of rows: a constant, the recorded length and whether there is one, and hashed names.

    Null metadata is a value of its own, apart from the empty string.
    """
    n = batch.num_rows
    stated = np.array([-1 if x is None else max(0, x) for x in batch.column("n_chars").to_pylist()], np.float64)
    level = np.where(stated < 0, -1, np.floor(2 * np.log2(np.maximum(stated, 0) + 1))).astype(np.int64).tolist()
    source, lang = (["\0null" if x is None else str(x) for x in batch.column(c).to_pylist()] for c in ("source", "lang"))
    out = np.zeros((n, PAGE))
    out[:, 0], out[:, 1], out[:, 2] = 1, np.log1p(np.maximum(stated, 0)) / 10, stated < 0
    views = (source, lang, level, zip(source, lang, strict=True), zip(source, level, strict=True), zip(lang, level, strict=True))
    for g, names in enumerate(views):
        codes = [zlib.crc32(f"{g}:{x}".encode()) % GROUPS for x in names]
        out[np.arange(n), 3 + g * GROUPS + np.array(codes, np.int64)] = 1
    return out


@dataclass
class Views:
    words: np.ndarray
    word_bias: float
    page: np.ndarray
    content_scale: tuple[float, float] = (1.0, 0.0)
    page_scale: tuple[float, float] = (1.0, 0.0)
    blend: tuple[float, float, float] = (0.5, 0.5, 0.0)
    #: From the odds of the sample, which takes labels alike, to those of all labelled rows.
    shift: float = 0.0

    def raw(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        content = [row_means(self.words[ids].sum(axis=0), first) for ids, first in content_ids(batch.column("text"))]
        return np.concatenate(content) + self.word_bias, page_features(batch) @ self.page

    def scores(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.raw(batch)
        a, b = self.content_scale[0] * a + self.content_scale[1], self.page_scale[0] * b + self.page_scale[1]
        x, y, z = self.blend
        return sigmoid(a + self.shift), sigmoid(b + self.shift), sigmoid(x * a + y * b + z + self.shift)


def class_weight(y: np.ndarray) -> np.ndarray:
    pos = min(max(y.mean(), 0.02), 0.98)
    return np.where(y == 1, 0.5 / pos, 0.5 / (1 - pos))


def fit_page(x: np.ndarray, y: np.ndarray, steps: int = 25, ridge: float = 1e-3) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w, weight = np.zeros(x.shape[1]), class_weight(y)
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (p - y)) / len(y) + ridge * w)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-5:
            break
    return w


def fit_content(docs: list[np.ndarray], y: np.ndarray, seed: int, epochs: int = 12, batch: int = 64, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Logistic weights of hashed words by Adagrad on row means."""
    words, held, bias, bias_held = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8), 0.0, 1e-8
    rng, weight = np.random.default_rng(seed), class_weight(y)
    for _ in range(epochs):
        for chosen in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // batch)):
            ids = np.concatenate([docs[i] for i in chosen], axis=1)
            first = np.cumsum([0, *(docs[i].shape[1] for i in chosen)])
            n = np.diff(first)
            err = weight[chosen] * (sigmoid(row_means(words[ids].sum(axis=0), first) + bias) - y[chosen]) / len(chosen)
            each = np.repeat(err / np.maximum(n, 1), n)
            grad = np.bincount(ids.ravel(), np.tile(each, len(ids)), 1 << BITS)
            on = np.flatnonzero(grad)
            held[on] += grad[on] ** 2
            words[on] -= rate * grad[on] / np.sqrt(held[on])
            bias_held += err.sum() ** 2
            bias -= 0.1 * rate * err.sum() / bias_held**0.5
    return words, bias


def co_train(rows: pa.Table, *, good_share: float | None = None, rounds: int = ROUNDS, share: float = SHARE, seed: int = 11) -> Views:
    """Fit on ``rows(text, source, lang, n_chars, label)``; label is null where unlabelled.

    ``good_share`` is the share of good rows among all labelled ones, of which these are a sample.
    """
    batch = rows.combine_chunks().to_batches()[0] if len(rows) else pa.RecordBatch.from_pylist([], schema=rows.schema)
    label = [np.nan if x is None else x for x in batch.column("label").to_pylist()]
    known = ~np.isnan(np.array(label, np.float64))
    rng = np.random.default_rng(seed)
    held = known & (rng.random(len(rows)) < 0.2)
    y = np.nan_to_num(np.array(label, np.float64))
    none = Views(np.zeros(1 << BITS), 0.0, np.zeros(PAGE))
    if len(set(y[known & ~held])) < 2:
        return none
    docs = [ids[:, a:b] for ids, first in content_ids(batch.column("text")) for a, b in zip(first[:-1], first[1:], strict=True)]
    page = page_features(batch)
    base = np.flatnonzero(known & ~held)
    free = np.flatnonzero(~known)
    given: list[dict[int, float]] = [{}, {}]
    rate_good = y[base].mean()

    def fits() -> tuple[tuple[np.ndarray, float], np.ndarray]:
        sets = [(np.concatenate((base, np.array(list(g), np.int64))), np.concatenate((y[base], np.array(list(g.values()))))) for g in given]
        return fit_content([docs[i] for i in sets[0][0]], sets[0][1], seed), fit_page(page[sets[1][0]], sets[1][1])

    for _ in range(rounds):
        (words, bias), weights = fits()
        content = lambda rows: np.array([words[docs[i]].sum(axis=0).mean() + bias if docs[i].shape[1] else bias for i in rows])
        own = [(content(free), content(np.flatnonzero(held))), (page[free] @ weights, page[held] @ weights)]
        for (raw, seen), learner in zip(own, (1, 0), strict=True):
            a, b = calibrate(seen, y[held])
            sure = sigmoid(a * raw + b)
            order = [k for k in np.argsort(sure, kind="stable") if free[k] not in given[learner]]
            take = int(share * len(free))
            good, bad = max(1, round(take * rate_good)), max(1, round(take * (1 - rate_good)))
            for k in order[:bad]:
                if sure[k] <= 1 - CONFIDENT:
                    given[learner][int(free[k])] = 0.0
            for k in order[-good:]:
                if sure[k] >= CONFIDENT:
                    given[learner][int(free[k])] = 1.0
    (words, bias), weights = fits()
    out = Views(words, bias, weights)
    if held.any():
        a, b = (v[held] for v in out.raw(batch))
        seen = y[held]
        out.content_scale, out.page_scale = calibrate(a, seen), calibrate(b, seen)
        if good_share and 0 < good_share < 1 and 0 < seen.mean() < 1:
            out.shift = logit_of(good_share) - logit_of(float(seen.mean()))
        out.blend = blended(out.content_scale[0] * a + out.content_scale[1], out.page_scale[0] * b + out.page_scale[1], seen)
    return out


def blended(a: np.ndarray, b: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Weights of the two views' log odds and a shift, neither weight below 0.

    A view that would get a negative weight is left out and the rest is fitted anew.
    """
    used = [0, 1]
    while used:
        both = np.stack([*((a, b)[k] for k in used), np.ones(len(a))], axis=1)
        start = np.array([*[1 / len(used)] * len(used), 0.0])
        w = start.copy()
        for _ in range(100):
            p = sigmoid(both @ w)
            h = (both * (p * (1 - p))[:, None]).T @ both + 0.1 * np.eye(len(w))
            w = w - np.clip(np.linalg.solve(h, both.T @ (p - y) + 0.1 * (w - start)), -0.5, 0.5)
        if (w[:-1] >= 0).all():
            out = [0.0, 0.0, float(w[-1])]
            for k, v in zip(used, w[:-1], strict=True):
                out[k] = float(v)
            return out[0], out[1], out[2]
        used = [k for k, v in zip(used, w[:-1], strict=True) if v >= 0]
    return 1.0, 0.0, 0.0


def quality(docs: DataFrame, labels: DataFrame, usable: Column | None = None, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_label: int = MAX_PER_LABEL, unlabelled: int = MAX_UNLABELLED, max_bytes: int = MAX_FIT_BYTES) -> DataFrame:
    """Per row of ``docs``: ``id, content_score, page_score, score, keep``.

    The fit reads at most ``per_label`` labelled rows of either label (those for which
    ``usable``, a condition on ``id``, holds) and ``unlabelled`` rows without a label,
    in the order of a hash of the id, less those whose text has more than ``max_bytes``
    bytes (1,500, 3,000 and 60,000); every whole text is scored in one narrow pass.
    Null texts are empty, null metadata counts as a value of its own, repeated rows
    score alike, and without both labels every score is 0.5. An empty table gives an
    empty result; other columns are ignored.
    """
    names = [c for c in ("source", "lang", "n_chars") if c in docs.columns]
    rows = pick(docs, id=id_col, text=text_col, **{c: c for c in names})
    for c, kind in (("source", "string"), ("lang", "string"), ("n_chars", "long")):
        rows = rows.withColumn(c, (F.col(c) if c in names else F.lit(None)).cast(kind))
    known = pick(labels, id=id_col, label=label_col).filter("id IS NOT NULL AND label IN (0, 1)").dropDuplicates(["id"])
    order = [F.xxhash64(F.lit("fit"), "id"), F.col("id")]
    may = known if usable is None else known.filter(usable)
    sample = may.filter("label = 0").orderBy(*order).limit(per_label).unionByName(may.filter("label = 1").orderBy(*order).limit(per_label))
    # Rows are chosen by a bound on their hash, of about twice as many as are wanted, before any shuffle.
    share = 2.0 * unlabelled / max(1, docs.count())
    ids = rows.select("id").filter("id IS NOT NULL").filter(F.pmod(F.xxhash64(F.lit("free"), "id"), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30)))
    ids = ids if usable is None else ids.filter(usable)
    free = ids.join(known, "id", "left_anti").distinct().orderBy(*order).limit(unlabelled).withColumn("label", F.lit(None).cast("int"))
    chosen = sample.select("id", F.col("label").cast("int").alias("label")).unionByName(free)
    # The sample's size is bounded by the limits above.
    found = rows.filter(F.octet_length("text") <= max_bytes).join(F.broadcast(chosen), "id").dropDuplicates(["id"]).orderBy("id")
    good = may.agg(F.avg("label").alias("share")).first()["share"]
    views = co_train(found.select("text", "source", "lang", "n_chars", "label").toArrow(), good_share=good)
    pa.default_memory_pool().release_unused()
    shared = docs.sparkSession.sparkContext.broadcast(views)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b, both = shared.value.scores(batch)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(a), pa.array(b), pa.array(both), pa.array(both >= 0.5)], ["id", "content_score", "page_score", "score", "keep"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, content_score double, page_score double, score double, keep boolean")
