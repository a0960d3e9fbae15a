"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of which only the bag has a label. Every passage of 512 bytes becomes
a vector of shape statistics, and an encoder turns that into a hidden vector. Gated attention weighs
the passages of a document, and the weighted sum is scored. All weights are learnt together from the
labels of documents, on a bounded sample of them. Nothing but the text reaches a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import columns_of

PASSAGE = 512
#: Bytes of text whose statistics are worked out at once; bounds memory for very long texts.
SEGMENT = PASSAGE * 2048
#: Labelled documents used for training, picked by a hash of doc_id. Longer ones than ``MOST_PASSAGES`` are not picked.
MOST_LABELLED = 4000
MOST_PASSAGES = 512
HIDDEN, ATTENTION, EPOCHS, RATE, DECAY, SEED = 16, 8, 250, 0.02, 1e-4, 11

#: Kinds of bytes that are counted, one flag each.
KINDS = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".", b",", b"!", b"|",
    b"#*$%&", b"<>{}[]\\", b"\"'()-:;?/", bytes(range(0xC0, 0x100)),
)
LAGS = (1, 2, 3)
N_FEATURES = len(KINDS) + 2 + len(LAGS)


def _table() -> np.ndarray:
    flags = np.zeros((len(KINDS), 256), bool)
    for k, kind in enumerate(KINDS):
        flags[k, list(kind)] = True
    return flags


FLAGS = _table()
SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
MIXED = np.random.default_rng(SEED).integers(1, 1 << 63, 256, dtype=np.uint64)


def passage_features(text: str | None) -> np.ndarray:
    """One row of statistics per passage; an empty text has one passage without any content."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    if not len(data):
        return np.zeros((1, N_FEATURES), np.float32)
    parts = [_segment(data[at : at + SEGMENT]) for at in range(0, len(data), SEGMENT)]
    return np.concatenate(parts)


def _segment(data: np.ndarray) -> np.ndarray:
    edges = np.arange(0, len(data), PASSAGE)
    sizes = np.diff(np.r_[edges, len(data)]).astype(np.float32)
    shares = [np.add.reduceat(flags[data], edges, dtype=np.float32) / sizes for flags in FLAGS]
    inside = ~SPACE[data]
    starts = np.flatnonzero(inside & np.r_[True, ~inside[:-1]])
    if not len(starts):
        rest = np.zeros((2 + len(LAGS), len(edges)), np.float32)
        return np.column_stack([*shares, *rest]).astype(np.float32)
    place = np.arange(len(data)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(data)]))
    mixed = MIXED[data] * (2 * place.astype(np.uint64) + np.uint64(1))
    words = np.add.reduceat(np.where(inside, mixed, np.uint64(0)), starts)
    home = starts // PASSAGE
    count = np.bincount(home, minlength=len(edges)).astype(np.float32)
    most = np.maximum(count, 1)
    again = [
        np.bincount(home[lag:][words[lag:] == words[:-lag]], minlength=len(edges)) / most for lag in LAGS
    ]
    length = np.add.reduceat(inside, edges, dtype=np.float32) / most / 32
    return np.column_stack([*shares, count / sizes, np.minimum(length, 4), *again]).astype(np.float32)


@dataclass
class Model:
    """Weights of the encoder, the gated attention and the score; ``mean`` and ``scale`` of the statistics."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    def score(self, passages: np.ndarray) -> float:
        return float(_forward(self.weights, (passages - self.mean) / self.scale, np.zeros(1, int))["p"][0])


def _forward(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Bags lie behind one another in ``x``; ``starts`` has the first row of each."""
    sizes = np.diff(np.r_[starts, len(x)])
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    e = (t * g) @ w["a"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
    alpha = e / np.repeat(np.add.reduceat(e, starts), sizes)
    z = np.add.reduceat(alpha[:, None] * h, starts)
    p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))
    return {"sizes": sizes, "h": h, "t": t, "g": g, "alpha": alpha, "z": z, "p": p}


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(w, x, starts)
    d = (f["p"] - y) / len(y)
    dz = np.repeat(d[:, None] * w["c"], f["sizes"], axis=0)
    da = (dz * f["h"]).sum(1)
    mean = np.repeat(np.add.reduceat(f["alpha"] * da, starts), f["sizes"])
    de = f["alpha"] * (da - mean)
    dt, dg = de[:, None] * w["a"] * f["g"], de[:, None] * w["a"] * f["t"]
    pt, pg = dt * (1 - f["t"] ** 2), dg * f["g"] * (1 - f["g"])
    dh = f["alpha"][:, None] * dz + pt @ w["V"].T + pg @ w["U"].T
    ph = dh * (1 - f["h"] ** 2)
    return {
        "c": f["z"].T @ d, "d": np.array(d.sum()), "a": (f["t"] * f["g"]).T @ de, "V": f["h"].T @ pt, "U": f["h"].T @ pg,
        "W": x.T @ ph, "b": ph.sum(0),
    }


def fit(bags: list[np.ndarray], labels: list[int]) -> Model:
    """Learn all weights from bags of passages by Adam over the whole sample."""
    x, y = np.concatenate(bags).astype(np.float64), np.array(labels, float)
    starts = np.cumsum([0, *[len(b) for b in bags[:-1]]])
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x, rng = (x - mean) / scale, np.random.default_rng(SEED)
    shapes = {"W": (N_FEATURES, HIDDEN), "b": HIDDEN, "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "a": ATTENTION, "c": HIDDEN, "d": ()}
    w = {k: rng.normal(0, 0.3, s) * (k not in "bd") for k, s in shapes.items()}
    m, v = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    for step in range(1, EPOCHS + 1):
        for k, grad in _gradients(w, x, starts, y).items():
            grad = grad + DECAY * w[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad**2
            w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(w, mean, scale)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents whose labels are kept from training."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model | None:
    """Fit on at most ``most`` labelled documents that are not held out; None where there is no label.

    NULL doc_ids and NULL labels are passed over; a document with several labels gets their smallest,
    and of several texts under one doc_id one is used.
    """

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [passage_features(t) for t in batch["text"]]
            keep = [len(b) <= MOST_PASSAGES for b in found]
            rows = [(k, q, b.tobytes()) for k, q, b in zip(batch["doc_id"], batch["quality"], found, strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", "quality", "bag"])[keep]

    usable = labels.select(*columns_of(labels, doc_id="long", quality="int")).where(
        F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()
    )
    one = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(*columns_of(docs, doc_id="long", text="string"))
    # ``picked`` has ``most`` rows at most.
    found = texts.join(F.broadcast(picked), "doc_id").mapInPandas(bags, "doc_id long, quality int, bag binary")
    rows = found.groupBy("doc_id", "quality").agg(F.min("bag").alias("bag")).orderBy("doc_id").limit(most).collect()
    if not rows:
        return None
    return fit([np.frombuffer(r.bag, np.float32).reshape(-1, N_FEATURES) for r in rows], [r.quality for r in rows])


def score(text: Column, model: Model | None) -> Column:
    """Probability that a text is of quality 1; 0.5 without a model. NULL and empty texts have a score too."""
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(passage_features(t)) for t in texts], dtype="float64")

    return scored(text.cast("string"))


def rate(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row; further columns are left behind."""
    scored = docs.select(*columns_of(docs, doc_id="long"), score(F.col("text"), model).alias("score"))
    return scored.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
