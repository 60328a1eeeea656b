"""Language identification by a byte convolutional network trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.shared import outputs_over, text_or_empty

WINDOW = 256
WIDTHS = (2, 3, 4)
UNDETERMINED = "und"


@dataclass
class ByteConvNet:
    """Byte embedding -> filters of several widths -> ReLU -> max over a window -> softmax over languages."""

    languages: list[str]
    embedding: np.ndarray  # 256 x dim
    filters: np.ndarray  # (widest * dim) x all filters; a narrow filter's further rows are zero
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    @property
    def dim(self) -> int:
        return self.embedding.shape[1]

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """Windows (n x WINDOW bytes) -> n x positions x (widest * dim)."""
        n, wide = len(windows), max(WIDTHS)
        embedded = self.embedding[windows].reshape(n, -1)
        views = np.lib.stride_tricks.sliding_window_view(embedded, wide * self.dim, axis=1)
        return np.ascontiguousarray(views[:, :: self.dim])

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """The largest response of each filter in each window."""
        columns = self.columns(windows)
        n, positions, k = columns.shape
        response = (columns.reshape(-1, k) @ self.filters).reshape(n, positions, -1)
        return np.maximum(response.max(axis=1) + self.bias, 0)

    def logits(self, windows: np.ndarray, block: int = 64) -> np.ndarray:
        out = [self.pooled(windows[i : i + block]) @ self.dense + self.dense_bias for i in range(0, len(windows), block)]
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and its probability for each whole text: window logits, averaged by their bytes."""
        windows, sizes, counts = text_windows(texts)
        scores = self.logits(windows) * sizes[:, None]
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        total = np.add.reduceat(scores, starts) / np.maximum(np.add.reduceat(sizes, starts), 1)[:, None]
        total = np.exp(total - total.max(axis=1, keepdims=True))
        total /= total.sum(axis=1, keepdims=True)
        best = total.argmax(axis=1)
        return [self.languages[i] for i in best], total[np.arange(len(best)), best].astype(float)


def text_windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed-length windows over all bytes of the texts, the bytes in each, and each text's number of windows (1 at least)."""
    encoded = [t.encode() for t in texts]
    step = WINDOW - max(WIDTHS) + 1
    counts = np.array([max(1, -(-(len(e) - max(WIDTHS) + 1) // step)) for e in encoded])
    windows = np.zeros((int(counts.sum()), WINDOW), np.uint8)
    sizes = np.zeros(len(windows), np.float32)
    at = 0
    for e, n in zip(encoded, counts.tolist(), strict=True):
        data = np.frombuffer(e, np.uint8)
        for k in range(n):
            part = data[k * step : k * step + WINDOW]
            windows[at, : len(part)] = part
            sizes[at] = len(part)
            at += 1
    return windows, sizes, counts


def train(texts: list[str], labels: list[str], dim: int = 8, per_width: int = 16, steps: int = 300, batch: int = 96, seed: int = 7) -> ByteConvNet:
    """Fits the network by Adam on windows of labelled texts, each language drawn equally often."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    windows, sizes, counts = text_windows(texts)
    target = np.repeat(np.array([languages.index(x) for x in labels]), counts)
    pools = [np.flatnonzero((target == c) & (sizes > 0)) for c in range(len(languages))]
    known = [c for c, pool in enumerate(pools) if len(pool)]
    f, wide = per_width * len(WIDTHS), max(WIDTHS)
    mask = np.zeros((wide * dim, f), np.float32)
    for i, w in enumerate(WIDTHS):
        mask[: w * dim, i * per_width : (i + 1) * per_width] = 1
    p = {
        "embedding": rng.normal(0, 0.5, (256, dim)).astype(np.float32),
        "filters": rng.normal(0, 0.25, (wide * dim, f)).astype(np.float32) * mask,
        "bias": np.zeros(f, np.float32),
        "dense": rng.normal(0, 0.1, (f, len(languages))).astype(np.float32),
        "dense_bias": np.zeros(len(languages), np.float32),
    }
    p["embedding"][0] = 0  # padding
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1 if known else 1):
        rows = np.array([rng.choice(pools[known[i % len(known)]]) for i in range(batch)])
        net = ByteConvNet(languages, **p)
        x = windows[rows]
        columns = net.columns(x)
        n, positions, k = columns.shape
        response = (columns.reshape(-1, k) @ p["filters"]).reshape(n, positions, f)
        at = response.argmax(axis=1)
        peak = np.take_along_axis(response, at[:, None], axis=1)[:, 0] + p["bias"]
        pooled = np.maximum(peak, 0)
        logits = pooled @ p["dense"] + p["dense_bias"]
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        odds[np.arange(n), target[rows]] -= 1
        odds /= n
        up = (odds @ p["dense"].T) * (peak > 0)
        seen = columns[np.arange(n)[:, None], at]  # n x filters x k
        back = up[:, :, None] * (p["filters"].T[None] * mask.T[None])
        grad_e = np.zeros_like(p["embedding"])
        for o in range(wide):
            np.add.at(grad_e, np.take_along_axis(x, at + o, axis=1).ravel(), back[:, :, o * dim : (o + 1) * dim].reshape(-1, dim))
        grad_e[0] = 0
        grads = {"embedding": grad_e, "filters": np.einsum("nfk,nf->kf", seen, up) * mask, "bias": up.sum(axis=0), "dense": pooled.T @ odds, "dense_bias": odds.sum(axis=0)}
        for name, g in grads.items():
            first[name] = 0.9 * first[name] + 0.1 * g
            second[name] = 0.999 * second[name] + 0.001 * g * g
            p[name] = (p[name] - 0.01 * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return ByteConvNet(languages, **p)


def fit_languages(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1000, seed: int = 7) -> ByteConvNet | None:
    """A network fitted on a bounded sample of the rows where ``learn`` holds and language and text are known.

    Bound: at most ``per_language`` rows, drawn by a hash of the id, of each language, and three windows of
    each row (its start, middle and end). Every language of these rows is learned: what comes to the driver
    grows with the number of languages and not with the rows. None without rows.
    """
    known = df.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in known.groupBy(F.col(lang_col).alias("l")).count().orderBy(F.desc("count"), "l").collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1_000_000)) / 1_000_000
    wanted = F.lit(False)
    for language, n in counts.items():
        wanted |= (F.col(lang_col) == language) & (draw < (1.0 if n <= 4 * per_language else 1.2 * per_language / n))
    length = F.length(text_col)
    parts = [F.substring(F.col(text_col), F.greatest(F.lit(1), at.cast("int")), F.lit(WINDOW)) for at in (F.lit(1), length / 2 - WINDOW / 2, length - WINDOW)]
    sample = known.where(wanted).select(F.col(lang_col).alias("l"), draw.alias("d"), F.array_distinct(F.array(*parts)).alias("parts")).orderBy("l", "d", F.hash("parts")).collect()
    texts, labels, taken = [], [], dict.fromkeys(counts, 0)
    for r in sample:
        if taken[r["l"]] < per_language:
            taken[r["l"]] += 1
            texts += r["parts"]
            labels += [r["l"]] * len(r["parts"])
    return train(texts, labels, seed=seed)


def identify_languages(df: DataFrame, model: ByteConvNet | None, text_col: str = "text") -> DataFrame:
    """Every row with ``lang_pred`` and ``score``; only the text is read.

    All bytes of a text are cut into windows of 256 bytes, run through the network in batches, and their
    logits averaged by length. A text that is null or has no letter, and any text without a model, is
    ``und`` with score 0. Of equal scores the language first in code-point order wins. Columns of the
    output's names are replaced.
    """
    result = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(result)
    def predicted(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"lang_pred": [UNDETERMINED] * len(texts), "score": np.zeros(len(texts))})
        some = np.flatnonzero(texts.notna().to_numpy()) if model is not None else []
        for at in range(0, len(some), 256):
            rows = some[at : at + 256]
            languages, scores = model.predict(texts.iloc[rows].tolist())
            out.iloc[rows, 0] = languages
            out.iloc[rows, 1] = scores
        return out

    lettered = F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col))
    packed = df.select(F.struct("*").alias("row"), lettered.alias("lettered")).withColumn("found", predicted("lettered"))
    return outputs_over("row", packed.select("row", "found.lang_pred", "found.score"), ["lang_pred", "score"])
