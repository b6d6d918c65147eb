"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each text becomes a short vector of statistics (character classes, word and line shapes, repetition), moved to
scales on which they are closer to normal. Moments of both classes are summed over all labelled rows in Spark,
so the fit needs no sample. Each class covariance shrinks towards the pooled one and towards its diagonal; the
score is the difference of the two Mahalanobis log densities, by Cholesky factors that are computed once, put
through a logistic link that is fitted on a histogram of that difference.

Labels, language, source and id are never inputs of a score. Null texts count as empty and are scored like any
text. Labels without an id or value are ignored, of several for one id the smallest counts. With no labelled
row of one of the classes every score is the share of good rows (0.5 if there is no label at all). A null id is
never held out and has no label. Texts are read whole, however long. Repeated rows repeat; further columns of the
input may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaywise.llm.common import removed, small_batches, text_or_empty, written

_KIND = np.zeros(256, np.int64)
for _kind, _members in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".,;:", b"!?", b"'\"-()", b"|", b"#$%&*", b"<>{}[]=+~^_\\/@`", bytes(range(128, 256))], 1):
    _KIND[list(_members)] = _kind
KINDS = 14
_EDGE = bytes(b for b in range(128) if not chr(b).isalnum())


def _logit(x: float) -> float:
    x = min(max(x, 0.0), 1.0)
    return math.log((x + 1e-3) / (1 - x + 1e-3))


def statistics(raw: bytes) -> list[float]:
    """The transformed statistics of a UTF-8 text."""
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(len(raw), 1)
    kinds = np.bincount(_KIND, counts, KINDS) / n
    share = counts[counts > 0] / n
    letters = kinds[1] + kinds[2] + kinds[13]
    words = raw.split()
    m = max(len(words), 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    bare = [w.strip(_EDGE) for w in words]
    seen = Counter(bare)
    clean = sum(map(bytes.__eq__, words, bare))
    upper = sum(map(bytes.isupper, words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in raw.split(b"\n") if x]
    k = max(len(lines), 1)
    top = seen.most_common(8)
    return [
        math.log1p(len(raw)),
        math.log1p(len(words)),
        *(_logit(x) for x in kinds[1:]),
        _logit(kinds[2] / letters if letters else 0.0),
        float(-(share * np.log2(share)).sum()),
        math.log1p(float(sizes.mean())),
        math.log1p(float(sizes.std())),
        math.log1p(float(sizes.max())),
        _logit(len(seen) / m),
        _logit(top[0][1] / m if top else 0.0),
        _logit(sum(c for _, c in top) / m),
        _logit(clean / m),
        _logit(upper / m),
        _logit(pairs / max(len(words) - 1, 1)),
        _logit(len(set(lines)) / k),
        math.log1p(len(raw) / k),
        _logit(1 - kinds[0]),
    ]


SIZE = len(statistics(b""))


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc_id, held_out, x`` and the columns to keep."""
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            x = [statistics(b) for b in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64())), *batch.columns[2:]], names=["doc_id", "x", *keep])

    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"), *keep)
    kinds = dict(source.dtypes)
    rows = source.mapInArrow(run, f"doc_id {kinds['doc_id']}, x array<double>" + "".join(f", {c} {kinds[c]}" for c in keep))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "x", *keep)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


@dataclass
class Discriminant:
    mean: np.ndarray  # [class, feature], of standardised features
    factor: np.ndarray  # [class, feature, feature]: inverse Cholesky factors
    log_det: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of the good class less that of the other, per row."""
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        parts = [-0.5 * (((z - self.mean[k]) @ self.factor[k].T) ** 2).sum(1) - 0.5 * self.log_det[k] for k in (0, 1)]
        return parts[1] - parts[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.clip(self.difference(x), -LIMIT, LIMIT) + self.offset, -30, 30)))


LIMIT = 60.0  # of the log-density difference, for the link
BINS = 4  # of the link's histogram per unit


@dataclass
class Moments:
    n: np.ndarray  # [class]
    first: np.ndarray  # [class, feature]
    second: np.ndarray  # [class, feature, feature]


def class_moments(labelled: DataFrame, size: int = SIZE) -> Moments:
    """Counts, sums and products of ``x`` by label ``y``: partial sums in tasks, a fixed number of totals here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + size + size * size))
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                y = batch.column(1).to_numpy(zero_copy_only=False)
                for k in (0, 1):
                    mine = x[y == k]
                    total[k] += np.concatenate([[len(mine)], mine.sum(0), (mine.T @ mine).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["y", "sums"])

    parts = labelled.select("x", F.col("y").cast("int").alias("y")).mapInArrow(run, "y int, sums array<double>")
    rows = parts.select("y", F.posexplode("sums").alias("i", "v")).groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + size + size * size))
    for r in rows:
        total[r["y"], r["i"]] = r["v"]
    return Moments(total[:, 0], total[:, 1 : 1 + size], total[:, 1 + size :].reshape(2, size, size))


def fit(moments: Moments, to_pooled: float = 0.1, to_diagonal: float = 0.02) -> Discriminant:
    n, d = moments.n.sum(), moments.first.shape[1]
    centre = moments.first.sum(0) / n
    scale = np.sqrt(np.maximum(np.diagonal(moments.second.sum(0)) / n - centre**2, 1e-6))
    means, covs = [], []
    for k in (0, 1):
        m = moments.first[k] / moments.n[k]
        covs.append((moments.second[k] / moments.n[k] - np.outer(m, m)) / np.outer(scale, scale))
        means.append((m - centre) / scale)
    pooled = (moments.n[0] * covs[0] + moments.n[1] * covs[1]) / n
    factors, dets = [], []
    for k in (0, 1):
        c = (1 - to_pooled) * covs[k] + to_pooled * pooled
        c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.maximum(np.diagonal(c), 1e-2)) + 1e-3 * np.eye(d)
        lower = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(lower))
        dets.append(2 * np.log(np.diagonal(lower)).sum())
    return Discriminant(np.array(means), np.array(factors), np.array(dets), centre, scale)


def fit_link(histogram: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and offset of the logistic link from (difference, label, count) rows, by Newton steps with a small
    pull of the slope towards zero."""
    z, y, n = (np.array(c, float) for c in zip(*histogram, strict=True))
    total = n.sum()
    w = np.array([0.1, 0.0])
    pull = np.diag([1e-3 * total, 1e-9 * total])
    for _ in range(50):
        a = np.stack([z, np.ones_like(z)], 1)
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (n * (y - p)) - pull @ w
        hess = (a * (n * p * (1 - p))[:, None]).T @ a + pull + 1e-9 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _arrays(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)


def truth_of(labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """``_id, y``: one label for each id that has any, held-out ones left out."""
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(f"`{id_col}`")))
    return known.groupBy(F.col(f"`{id_col}`").alias("_id")).agg(F.min(label_col).alias("y")).where("_id is not null")


def train(labelled: DataFrame) -> Discriminant | float:
    """Fit on labelled rows (``x, y``, a stored table); the share of good rows where a class is missing."""
    moments = class_moments(labelled)
    if not moments.n.all():
        return float(moments.n[1] / moments.n.sum()) if moments.n.sum() else 0.5
    model = fit(moments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.rint(np.clip(model.difference(_arrays(batch, 0)), -LIMIT, LIMIT) * BINS).astype(np.int32) if batch.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(z), batch.column(1)], names=["z", "y"])

    binned = labelled.select("x", F.col("y").cast("int").alias("y")).mapInArrow(run, "z int, y int").groupBy("z", "y").count().collect()
    model.slope, model.offset = fit_link([(r["z"] / BINS, r["y"], r["count"]) for r in binned])
    return model


def apply_scores(stats: DataFrame, model: Discriminant | float, threshold: float = 0.7) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            score = np.full(n, model) if isinstance(model, float) else model.score(_arrays(batch, 2)) if n else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(run, f"doc_id {dict(stats.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    stats = written(statistics_table(docs, id_col, text_col), "statistics")
    labelled = written(stats.join(truth_of(labels), F.col("doc_id") == F.col("_id")).select("x", "y"), "labelled")
    return apply_scores(stats, train(labelled), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) that are predicted to be good. Only labelled texts are looked at for the
    fit; all are scored in passing, with no join."""
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    truth = written(truth_of(labels), "truth")  # its size is known then, so Spark broadcasts it as long as it is small
    known = statistics_table(texts.join(truth, F.col("doc_id") == F.col("_id")), keep=["y"])
    labelled = written(known.select("x", "y"), "labelled")
    model = train(labelled)
    removed(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            text = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()
            x = np.array([statistics(t or b"") for t in text])
            score = np.full(len(x), model) if isinstance(model, float) else model.score(x)
            yield batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)
