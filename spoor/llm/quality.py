"""Quality scores by positive-unlabelled learning.

Trusted positives (``quality`` = 1 in the training fold) and unlabelled web text train a
small network by the non-negative unbiased risk  pi*R_p+ + max(0, R_u- - pi*R_p-).  The
class prior pi is estimated first, from a classifier of positives against unlabelled text:
the least ratio, over its score's upper tails, of the unlabelled to the positive share.

Inputs of a score are counts on the whole text alone (letters, cases, symbols, words,
repeats, lines).  Defined cases: a null text or one without words scores 0.0; repeated rows
score alike; a document labelled twice counts as positive if any label says so; without a
trusted positive every score is 0.0; a null id counts as the empty text in the fold; an
empty table gives no rows; a very long text is counted as a whole; columns other than id and
text (and ``quality`` of labels) are not read, so their names cannot clash.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm.common import fold, load, map_batches, texts

#: Bounds of the training sample.
POSITIVES, UNLABELLED = 3000, 6000
THRESHOLD = 0.3

_GROUPS = np.zeros((256, 8), np.float64)
for _c in range(256):
    _k = (
        0 if 97 <= _c <= 122 else 1 if 65 <= _c <= 90 else 2 if 48 <= _c <= 57 else 3 if _c in (32, 9, 10, 13)
        else 4 if chr(_c) in ".,;:'\"?-()" else 5 if _c in (33, 124) else 6 if _c < 128 else 7
    )
    _GROUPS[_c, _k] = 1
N_FEATURES = 19


def features(text: str) -> np.ndarray:
    """Counts of a whole text that has words, most of them as shares."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    shares = counts @ _GROUPS / len(raw)
    words = text.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    blocks = [words[i : i + 48] for i in range(0, n, 48)]
    fresh = sum(len(set(b)) for b in blocks) / n
    worst = min(len(set(b)) / len(b) for b in blocks if len(b) > 24 or len(blocks) == 1)
    probs = counts[counts > 0] / len(raw)
    return np.array(
        [
            *shares,
            np.log1p(n),
            len(text) / n,
            sum(map(eq, words, words[1:])) / n,
            fresh,
            worst,
            sum(map(str.isupper, words)) / n,
            np.log1p(n / len(lines)),
            len(set(lines)) / len(lines),
            sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines),
            -(probs * np.log2(probs)).sum(),
            sum(map(str.isalpha, words)) / n,
        ]
    )


class PUNet:
    """One hidden layer; the output is the log-odds of a positive."""

    def __init__(self, hidden: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.w1, self.b1 = rng.normal(0, N_FEATURES**-0.5, (N_FEATURES, hidden)), np.zeros(hidden)
        self.w2, self.b2 = rng.normal(0, hidden**-0.5, hidden), np.zeros(1)
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40)))

    def fit(self, p: np.ndarray, u: np.ndarray, prior: float | None, epochs: int = 60, rate: float = 0.01, seed: int = 5) -> PUNet:
        """Adam; with a prior by the non-negative risk, without one as plain positives against unlabelled."""
        rng = np.random.default_rng(seed)
        both = np.concatenate([p, u])
        self.mean, self.scale = both.mean(0), both.std(0) + 1e-6
        state = [[np.zeros_like(a), np.zeros_like(a)] for a in (self.w1, self.b1, self.w2, self.b2)]
        batches, t = max(1, len(u) // 256), 0
        for epoch in range(epochs):
            po, uo = rng.permutation(len(p)), rng.permutation(len(u))
            for i in range(batches):
                bp, bu = p[po[i::batches]], u[uo[i::batches]]
                if not len(bp) or not len(bu):
                    continue
                x = np.clip((np.concatenate([bp, bu]) - self.mean) / self.scale, -8, 8)
                h = np.tanh(x @ self.w1 + self.b1)
                s = 1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -40, 40)))
                sp, su = s[: len(bp)], s[len(bp) :]
                # logistic loss: l+ = -log s, l- = -log(1 - s); slopes in the logit are s - 1 and s
                if prior is None:
                    d = np.concatenate([(sp - 1) / len(bp), su / len(bu)]) / 2
                else:
                    negative = -np.log1p(-su + 1e-12).mean() + prior * np.log1p(-sp + 1e-12).mean()
                    d = np.concatenate([prior * (sp - 1) / len(bp), np.zeros(len(bu))])
                    slope = np.concatenate([-prior * sp / len(bp), su / len(bu)])
                    d = d + slope if negative >= 0 else -slope  # a negative estimate is pushed back up
                dh = d[:, None] * self.w2 * (1 - h * h)
                grads = [x.T @ dh, dh.sum(0), h.T @ d, np.array([d.sum()])]
                t += 1
                for k, (a, g) in enumerate(zip((self.w1, self.b1, self.w2, self.b2), grads)):
                    g = g + 1e-4 * a
                    m, v = state[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    a -= rate * (1 - epoch / epochs) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return self


def class_prior(p: np.ndarray, u: np.ndarray, slack: float = 1.0) -> float:
    """Share of positives among the unlabelled: least upper-tail ratio, with a bound on its error."""
    cuts = np.quantile(p, np.linspace(0, 0.5, 51))
    tp = np.array([(p >= c).mean() for c in cuts])
    tu = np.array([(u >= c).mean() for c in cuts])
    error = slack * (np.sqrt(tu * (1 - tu) / len(u)) + np.sqrt(tp * (1 - tp) / len(p)))
    best = int(((tu + error) / np.maximum(tp, 1e-9)).argmin())
    return float(np.clip(tu[best] / tp[best], 0.05, 0.98))


def with_features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), "positive")

    def columns(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column(0), "positive": batch.column(2), "x": [features(t).tolist() if t and t.strip() else None for t in texts(batch)]}

    return map_batches(own, f"id {own.schema['id'].dataType.simpleString()}, positive boolean, x array<double>", columns)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, held_out: int = 0,
    positives: int = POSITIVES, unlabelled: int = UNLABELLED,
) -> PUNet | None:
    """Fit on at most ``positives`` trusted and about ``unlabelled`` other rows of the training fold, drawn by hash.

    The drawn positive ids are bounded by ``positives``, so they can be sent to every executor.
    """
    trusted = labels.filter((F.col("quality") == 1) & F.col(id_col).isNotNull() & (fold(id_col, modulus) != held_out)).select(F.col(id_col).alias("key")).distinct()
    ids = [r["key"] for r in trusted.orderBy(F.xxhash64("key"), "key").limit(positives).collect()]
    if not ids:
        return None
    chosen = docs.sparkSession.createDataFrame([(i,) for i in ids], trusted.schema).withColumn("positive", F.lit(True))
    total = max(1, docs.count())
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("draw")), F.lit(1_000_000)) < int(min(1e6, 1e6 * unlabelled * 1.25 / total))
    own = docs.select(id_col, text_col)  # other columns may have any name
    rows = own.filter(fold(id_col, modulus) != held_out).join(F.broadcast(chosen), F.col(id_col) == F.col("key"), "left")
    picked = rows.filter(F.col("positive") | draw)
    found = with_features(picked, id_col, text_col).filter("x is not null").limit(3 * (positives + unlabelled)).toPandas()
    found = found.sort_values("id", kind="stable")
    x = np.array(found["x"].tolist()).reshape(-1, N_FEATURES)
    mark = found["positive"].eq(True).to_numpy(bool)
    # unlabelled text is web text as it comes: positives that the draw hits belong to it as well
    p = x[mark]
    hit = draw_hits(found["id"].tolist(), docs, id_col, draw) if mark.any() else set()
    u = np.concatenate([x[~mark], x[mark & found["id"].isin(hit).to_numpy(bool)]])
    if not len(p) or not len(u):
        return None
    first = PUNet().fit(p, u, None, epochs=25)
    return PUNet().fit(p, u, class_prior(first.score(p), first.score(u)))


def draw_hits(ids: list, docs: DataFrame, id_col: str, draw) -> set:
    """Which of the sampled ids the unlabelled draw took."""
    frame = docs.sparkSession.createDataFrame([(i,) for i in ids], docs.select(id_col).schema)
    return {r[0] for r in frame.filter(draw).collect()}


def score(docs: DataFrame, net: PUNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row: one narrow pass."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def columns(batch: pa.RecordBatch) -> dict:
        items = texts(batch)
        out = np.zeros(len(items))
        at = [i for i, t in enumerate(items) if net is not None and t and t.strip()]
        if at:
            out[at] = net.score(np.stack([features(items[i]) for i in at]))
        return {"id": batch.column(0), "score": out}

    return map_batches(own, f"id {own.schema['id'].dataType.simpleString()}, score double", columns).withColumnRenamed("id", id_col)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    net = train(docs, load(spark, sf_dir, "labels"))
    return score(docs, net).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
