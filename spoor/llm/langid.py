"""Language identification by a byte convolutional network, written and trained in numpy.

Lower-cased UTF-8 bytes are cut into windows of ``WIDTH`` bytes (the last one padded with
byte 0).  A byte embedding feeds filters of several widths, ReLU, max pooling over the
window and a softmax.  A document's distribution is the mean over its windows, each
weighted by the bytes it holds; every byte of the text is in exactly one window.

Because inputs are bytes, a filter of width 2 is one lookup in a table of 65,536 rows and
the wider ones are sums of such lookups: scoring needs no matrix product before the softmax.

Defined cases: a null text or one without letters is ``und`` with score 0.0; repeated rows
get equal predictions; ties go to the first language in sorted order; with no labelled row
to learn from, every text is ``und``; a null id counts as the empty text in the fold, so it
is not held out unless crc32('') says so; an empty table gives no rows; a very long text is
cut into all its windows.  Columns other than id, text and lang are not read, so their names
cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm.common import fold, load, map_batches, replace_rows, texts

WIDTH = 192
UND = "und"
#: Bound of the training sample: about so many windows for each language.
SAMPLE_PER_LANG = 800
#: More values of ``lang`` than this are not languages: training refuses them.
MOST_LANGS = 10_000
#: The pipeline keeps documents whose language is at least this sure.
MIN_SCORE = 0.3


class ByteConvNet:
    """Embedding -> filters of widths 2, 3 and 4 -> ReLU -> max pooling -> softmax."""

    def __init__(self, langs: list[str], dim: int = 12, filters: int = 8, widths: tuple[int, ...] = (2, 3, 4), seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.widths, self.filters = sorted(langs), widths, filters
        self.p = {"emb": rng.normal(0, 0.5, (256, dim)).astype(np.float32)}
        for w in widths:
            self.p[f"k{w}"] = rng.normal(0, (w * dim) ** -0.5, (w, dim, filters)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(filters, np.float32)
        n = filters * len(widths)
        self.p["out"] = rng.normal(0, n**-0.5, (n, len(langs))).astype(np.float32)
        self.p["bias"] = np.zeros(len(langs), np.float32)
        self.tables = None

    # training -------------------------------------------------------------------------
    def _forward(self, x: np.ndarray):
        e = self.p["emb"][x]
        pooled, at = [], []
        for w in self.widths:
            m = x.shape[1] - w + 1
            conv = sum(e[:, i : i + m] @ self.p[f"k{w}"][i] for i in range(w)) + self.p[f"b{w}"]
            arg = conv.argmax(1)
            at.append(arg)
            pooled.append(np.take_along_axis(conv, arg[:, None], 1)[:, 0])
        h = np.concatenate(pooled, 1)
        z = np.maximum(h, 0) @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        return e, h, at, z / z.sum(1, keepdims=True)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
        e, h, at, q = self._forward(x)
        n = len(x)
        loss = -float(np.log(q[np.arange(n), y] + 1e-9).mean())
        d = q.copy()
        d[np.arange(n), y] -= 1
        d /= n
        g = {"out": np.maximum(h, 0).T @ d, "bias": d.sum(0), "emb": np.zeros_like(self.p["emb"])}
        dh = (d @ self.p["out"].T) * (h > 0)
        rows = np.arange(n)[:, None]
        for j, w in enumerate(self.widths):
            dw = dh[:, j * self.filters : (j + 1) * self.filters]
            g[f"b{w}"] = dw.sum(0)
            gk = np.zeros_like(self.p[f"k{w}"])
            for i in range(w):
                where = at[j] + i
                gk[i] = np.einsum("nfd,nf->df", e[rows, where], dw)
                np.add.at(g["emb"], x[rows, where], dw[:, :, None] * self.p[f"k{w}"][i].T[None])
            g[f"k{w}"] = gk
        return g, loss

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.01, seed: int = 11) -> ByteConvNet:
        """Adam on the cross-entropy, with the rate falling to nought."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        steps, t = max(1, epochs * -(-len(x) // batch)), 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                pick = order[i : i + batch]
                g, _ = self._gradients(x[pick], y[pick])
                t += 1
                now = rate * (1 - (t - 1) / steps)
                for k, a in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * a
                    v[k] = 0.999 * v[k] + 0.001 * a * a
                    self.p[k] = self.p[k] - (now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        self.tables = None
        return self

    # scoring --------------------------------------------------------------------------
    def _lookup(self) -> dict:
        if self.tables is None:
            one = {w: np.einsum("bd,wdf->wbf", self.p["emb"], self.p[f"k{w}"]) for w in self.widths}
            pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, -1).astype(np.float32)
            self.tables = {}
            for w in self.widths:
                parts = [(i, pair(one[w][i], one[w][i + 1])) for i in range(0, w - 1, 2)]
                if w % 2:
                    parts.append((w - 1, one[w][w - 1].astype(np.float32)))
                self.tables[w] = parts
        return self.tables

    def windows(self, x: np.ndarray, chunk: int = 256) -> np.ndarray:
        """Class probabilities of windows (n, WIDTH) of bytes."""
        out = np.empty((len(x), len(self.langs)), np.float32)
        for at in range(0, len(x), chunk):
            b = x[at : at + chunk].T.astype(np.intp)  # positions first: the maximum then runs over whole rows
            pairs = (b[:-1] << 8) | b[1:]
            pooled = []
            for w, parts in self._lookup().items():
                m = len(b) - w + 1
                conv = None
                for i, table in parts:
                    got = table.take((pairs if len(table) > 256 else b)[i : i + m], axis=0, mode="clip")
                    conv = got if conv is None else np.add(conv, got, out=conv)
                pooled.append(conv.max(0) + self.p[f"b{w}"])
            z = np.maximum(np.concatenate(pooled, 1), 0) @ self.p["out"] + self.p["bias"]
            z = np.exp(z - z.max(1, keepdims=True))
            out[at : at + chunk] = z / z.sum(1, keepdims=True)
        return out

    def predict(self, items: list[str | None]) -> list[tuple[str, float]]:
        """(language, probability) of whole texts."""
        found: list[tuple[str, float]] = [(UND, 0.0)] * len(items)
        todo: list[tuple[int, bytes]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            counts = [-(-len(b) // WIDTH) for _, b in todo]
            buffer = np.frombuffer(b"".join(b.ljust(c * WIDTH, b"\0") for (_, b), c in zip(todo, counts)), np.uint8)
            q = self.windows(buffer.reshape(-1, WIDTH))
            firsts = np.concatenate(([0], np.cumsum(counts)))
            for (k, b), lo, hi in zip(todo, firsts[:-1], firsts[1:]):
                weight = np.full(hi - lo, WIDTH, np.float64)
                weight[-1] = len(b) - (hi - lo - 1) * WIDTH
                mean = weight @ q[lo:hi] / weight.sum()
                best = int(mean.argmax())
                found[k] = (self.langs[best], float(min(1.0, max(0.0, mean[best] / mean.sum()))))
            todo.clear()
            held = 0

        for k, text in enumerate(items):
            if self.langs and text and has_letter(text):
                todo.append((k, text.lower().encode("utf-8", "replace")))
                held += len(todo[-1][1])
                if held > 4 << 20:
                    flush()
        if todo:
            flush()
        return found


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def as_windows(items: list[str]) -> np.ndarray:
    """The first window of each training snippet."""
    return np.frombuffer(b"".join(t.lower().encode("utf-8", "replace")[:WIDTH].ljust(WIDTH, b"\0") for t in items), np.uint8).reshape(-1, WIDTH)


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, held_out: int = 2, per_lang: int = SAMPLE_PER_LANG
) -> ByteConvNet:
    """Fit on about ``per_lang`` snippets of each language, drawn by hash from the training fold.

    Two passes: counts by language, then snippets from random places of the drawn rows.  What reaches the driver is bounded by per_lang * languages * WIDTH characters.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col, modulus) != held_out)).select(
        F.col(lang_col).alias("lang"), F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text")
    )
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(MOST_LANGS + 1).collect()}
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not counts:
        return ByteConvNet([])
    draw = F.pmod(F.xxhash64("key", F.lit("draw")), F.lit(1_000_000))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1e6, 1e6 * per_lang / n)))])
    place = F.pmod(F.xxhash64("key", F.lit("place")), F.greatest(F.lit(1), F.length("text") - WIDTH + 1)).cast("int")
    rows = (
        known.filter(draw < share[F.col("lang")])
        .select("lang", "key", F.substring(F.col("text"), place + 1, F.lit(WIDTH)).alias("text"))
        .limit(2 * per_lang * len(counts))
        .collect()
    )
    rows.sort(key=lambda r: (r["lang"], r["key"] or "", r["text"]))
    rows = [r for r in rows if has_letter(r["text"])]
    net = ByteConvNet([*{r["lang"] for r in rows}])
    if len(net.langs) < 1:
        return net
    number = {k: i for i, k in enumerate(net.langs)}
    # short texts must be told apart too: each snippet also counts as its first few words
    full, y = [r["text"] for r in rows], [number[r["lang"]] for r in rows]
    short = [t[: 16 + 7 * (i % 9)] for i, t in enumerate(full)]
    return net.fit(as_windows(full + short), np.array(y + y))


def identify(docs: DataFrame, net: ByteConvNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every row: one narrow pass."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def columns(batch: pa.RecordBatch) -> dict:
        found = net.predict(texts(batch))
        return {"id": batch.column(0), "lang_pred": [a for a, _ in found], "score": [s for _, s in found]}

    return map_batches(own, f"id {own.schema['id'].dataType.simpleString()}, lang_pred string, score double", columns).withColumnRenamed("id", id_col)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: no letters, or no language with MIN_SCORE."""
    net = train(docs)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([lang != UND and s >= MIN_SCORE for lang, s in net.predict(texts(batch))], pa.bool_()))

    return replace_rows(docs, keep)
