"""Quality classifier by positive-unlabelled learning."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import only, slices

#: Expected rows of the training samples; the scoring pass always covers every row.
POSITIVES = 6_000
UNLABELLED = 12_000
#: Folds by crc32 of the id's decimal text; labels of fold 0 are never read.
FOLDS = 5
#: Hash buckets of byte pairs.
PAIRS = 192
#: Score of a model that has no trusted positive to learn from.
NO_MODEL = 0.5

_PUNCTUATION = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
_STYLE = 14


def features(text: str | None) -> np.ndarray:
    """Style of a whole text: characters, words, repetition; and hashed byte pairs."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(raw))
    chars = np.bincount(raw, minlength=256)
    out = np.zeros(_STYLE + len(_PUNCTUATION) + PAIRS, np.float32)
    words = text.split()
    k = max(1, len(words))
    counts = Counter(words)
    follow = len(set(zip(words[:-1], words[1:], strict=True)))
    same = sum(a == b for a, b in zip(words[:-1], words[1:], strict=True))
    lines = [x for x in text.split("\n") if x.strip()]
    upper, lower = chars[65:91].sum(), chars[97:123].sum()
    out[:_STYLE] = (
        np.log1p(len(raw)),
        upper / n,
        lower / n,
        chars[48:58].sum() / n,
        chars[32] / n,
        chars[10] / n,
        chars[128:].sum() / n,
        upper / max(1, upper + lower),
        len(raw) / k / 10,
        len(counts) / k,
        follow / max(1, k - 1),
        same / max(1, k - 1),
        max(counts.values(), default=0) / k,
        len(set(lines)) / max(1, len(lines)),
    )
    out[_STYLE : _STYLE + len(_PUNCTUATION)] = np.sqrt(chars[_PUNCTUATION] / k)
    if len(raw) > 1:
        pair = (raw[:-1].astype(np.uint32) * 2654435 + raw[1:].astype(np.uint32) * 40503) >> 5
        out[_STYLE + len(_PUNCTUATION) :] = np.sqrt(np.bincount(pair % PAIRS, minlength=PAIRS) / n)
    return out


@dataclass(frozen=True)
class Model:
    """A linear score; ``prior`` is the estimated share of positives."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _adam(x: np.ndarray, slope, steps: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Minimises a risk of the margins; ``slope(z)`` is its derivative by each margin."""
    w = np.zeros(x.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        d = slope(x @ w[:-1] + w[-1])
        g = np.append(x.T @ d + decay * w[:-1], d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """Share of positives in the unlabelled rows, from scores of both.

    Among the rows above a threshold, the unlabelled share is at least the prior times the share of
    positives; the smallest ratio of the two, with a margin for the sample sizes, bounds the prior
    from above and meets it where the top scores are pure.
    """
    cuts = np.unique(np.quantile(positive, np.linspace(0.02, 0.98, 97)))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    margin = np.sqrt(np.log(4 / confidence) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = int(np.argmin((u + margin) / p))
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 300, rate: float = 0.05, decay: float = 1e-3) -> Model:
    """Non-negative unbiased risk with the logistic loss.

    First positives are told from unlabelled rows on one half of both samples, and the prior is estimated on
    the other half; then the risk prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)]) is minimised.
    Where the second part would be negative, its gradient is followed backwards.
    """
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    p, u = ((a - mean) / scale for a in (positive, unlabelled))

    def told(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
        sign = np.append(np.full(len(a), 0.5 / len(a)), np.full(len(b), -0.5 / len(b)))
        return _adam(np.concatenate([a, b]), lambda z: -sign * _sigmoid(-np.sign(sign) * z), steps // 2, rate, decay)

    w, b = told(p[::2], u[::2])
    prior = estimate_prior(p[1::2] @ w + b, u[1::2] @ w + b) if len(p) > 1 and len(u) > 1 else NO_MODEL
    n = len(p)

    def slope(z: np.ndarray) -> np.ndarray:
        zp, zu = z[:n], z[n:]
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp, gu = -prior * _sigmoid(-zp) / n, _sigmoid(zu) / len(zu)
        back = -prior * _sigmoid(zp) / n
        return np.append(gp + back, gu) if rest >= 0 else np.append(-back, -gu)

    weights, bias = _adam(np.concatenate([p, u]), slope, steps, rate, decay)
    return Model(mean, scale, weights, bias, prior)


def fold(column: str = "id"):
    """Fold of a row by its id; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS


def _featured(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x = [features(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("positive"), pa.array(x, pa.binary())], names=["positive", "x"])

    return rows.select("text", "positive").mapInArrow(run, "positive boolean, x binary")


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
) -> Model | None:
    """The model, or None where there is no trusted positive or no unlabelled row.

    Trusted positives are rows whose labels are all 1, outside fold 0; negatives are not looked at, they are
    part of the unlabelled rows, which are any rows outside fold 0. Both are samples by a hash of the id
    of an expected ``positives`` and ``unlabelled`` rows; ids that are null are in neither.
    """
    learn = F.coalesce(fold() != 0, F.lit(False))
    trusted = (
        only(labels, id=id_col, y=label_col).where(learn).groupBy("id").agg(F.min("y").alias("least"), F.count("y").alias("n"))
        .where("least = 1 AND n > 0").select("id")
    )
    texts = only(docs, id=id_col, text=text_col).where(learn)
    part = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    n_trusted, n_texts = trusted.count(), texts.count()
    if not n_trusted or not n_texts:
        return None
    chosen = trusted.where(part < positives / n_trusted)
    # bounded by the expected sample size
    some = texts.join(F.broadcast(chosen), "id", "left_semi").select("text", F.lit(True).alias("positive"))
    rest = texts.where(part < unlabelled / n_texts).select("text", F.lit(False).alias("positive"))
    got = _featured(some.unionByName(rest)).toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(got.num_rows, -1)
    y = np.asarray(got.column("positive"))
    order = np.lexsort(x.T[:16])  # the order of collected rows differs from run to run
    x, y = x[order], y[order]
    return fit(x[y], x[~y]) if y.any() and not y.all() else None


def scores(model: Model | None, texts: list[str | None]) -> np.ndarray:
    if model is None or not texts:
        return np.full(len(texts), NO_MODEL)
    return model.score(np.stack([features(t) for t in texts]))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score) for every row of ``docs``, from its whole text alone.

    A null text scores as an empty one. ``held_out`` is false for a null id. Repeated rows get the same score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s = scores(model, b.column("text").to_pylist())
            yield pa.record_batch([b.column("id"), b.column("held_out"), pa.array(s, pa.float64())], names=["id", "held_out", "score"])

    rows = only(docs, id=id_col, text=text_col).select(
        F.col("id").cast("bigint").alias("id"), "text", F.coalesce(fold() == 0, F.lit(False)).alias("held_out")
    )
    return rows.mapInArrow(run, "id bigint, held_out boolean, score double")


def keep_good(docs: DataFrame, model: Model | None, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            yield b.filter(pa.array(scores(model, b.column(text_col).to_pylist()) >= least))

    return docs.mapInArrow(run, docs.schema)
