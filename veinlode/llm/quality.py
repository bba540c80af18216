"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text is a bag of terms: trigrams of its shape (runs of lower case, upper case, digits, white
space and kinds of marks), and coarse measures of its words (repetition, variety, length). Counts are
damped and weighted by rarity, and a truncated singular value decomposition of a labelled sample
gives the latent axes. The sample's unit vectors and labels are broadcast; each document takes
its exact cosine with every one of them, block by block, and the nearest vote with weights that
grow with the similarity.

Bounds: at most ``max_labelled`` labelled documents, chosen by hash over all labels, and ``axes``
axes, so that what is sent to each task has a fixed size (4096 x 48 floats: under 1 MB) at any
input. Every document is scored on its whole text.

Defined cases: null, empty and all-blank texts have no terms and score 0; labels with a null
quality or doc_id are ignored; several labels of one document are averaged; neighbours tied with
the last one all vote; without any usable label every score is 0.5. Labels, language, source and
doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_batches, need

N_CLASS = 16


def shape_classes() -> np.ndarray:
    """Class of each byte; continuation and lead bytes beyond ASCII count as lower case."""
    groups = ["\n", " \t\r\x0b\x0c", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"]
    groups += [".", ",", "!?", "#*", "$%&", "|", "@<>/\\:;=~^", "\"'`()[]{}", "-_+"]
    table = np.full(256, 15, dtype=np.uint8)
    table[128:] = 3
    for i, chars in enumerate(groups):
        table[[ord(c) for c in chars]] = i + 1
    return table


CLASSES = shape_classes()
#: Runs of these classes count as one.
RUNS = np.array([c in (2, 3, 4, 5) for c in range(N_CLASS)])
N_SHAPE = N_CLASS**3
#: Coarse measures: name by name, ten steps each.
MEASURES = ("repeat", "variety", "word length", "longest share", "line repeat")
STEPS = 10
N_TERMS = N_SHAPE + len(MEASURES) * STEPS


def measures(raw: bytes) -> list[float]:
    """Shares between 0 and 1: repeated neighbours, distinct words, word length / 20, commonest word, repeated lines."""
    words = raw.split()
    n = len(words)
    if not n:
        return []
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    repeats = sum(map(bytes.__eq__, words, words[1:])) / max(1, n - 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    variety = len(counts) / n * min(1.0, (n / 400) ** 0.25)  # distinct words fall with length
    return [repeats, variety, min(1.0, sum(map(len, words)) / n / 20), max(counts.values()) / n, 1 - len(set(lines)) / len(lines)]


def terms(raw: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and counts of a text."""
    if not raw or not raw.strip():
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)
    kinds = CLASSES[np.frombuffer(raw, dtype=np.uint8)]
    keep = np.ones(len(kinds), dtype=bool)
    keep[1:] = (kinds[1:] != kinds[:-1]) | ~RUNS[kinds[1:]]
    k = kinds[keep].astype(np.int64)
    k = np.concatenate(([0, 0], k, [0]))
    found = np.bincount((k[:-2] * N_CLASS + k[1:-1]) * N_CLASS + k[2:], minlength=N_SHAPE)
    at = np.flatnonzero(found)
    steps = [N_SHAPE + i * STEPS + min(STEPS - 1, int(v * STEPS)) for i, v in enumerate(measures(raw))]
    total = float(found.sum())
    return (
        np.concatenate([at, steps]).astype(np.int32),
        np.concatenate([found[at], np.full(len(steps), total / 8)]).astype(np.float32),
    )


def weighted(found: list[tuple[np.ndarray, np.ndarray]], rarity: np.ndarray) -> np.ndarray:
    """Unit rows of damped, rarity-weighted relative counts; a text without terms is a row of zeros."""
    out = np.zeros((len(found), N_TERMS), dtype=np.float32)
    for row, (at, n) in zip(out, found):
        if len(at):
            row[at] = np.log1p(n / n.sum() * 1000) * rarity[at]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-12)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(found: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, axes: int, seed: int = 7) -> dict:
    """Rarity, latent axes (randomised SVD) and the sample's vectors."""
    seen = np.bincount(np.concatenate([at for at, _ in found]), minlength=N_TERMS)
    rarity = np.log((1 + len(found)) / (1 + seen)).astype(np.float32) + 1
    x = weighted(found, rarity)
    axes = min(axes, len(found))
    q = np.random.default_rng(seed).standard_normal((N_TERMS, axes + 8)).astype(np.float32)
    for _ in range(3):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    basis = (q @ vt.T[:, :axes]).astype(np.float32)
    return {"rarity": rarity, "basis": basis, "vectors": unit(x @ basis), "labels": labels.astype(np.float32)}


def vote(model: dict, found: list[tuple[np.ndarray, np.ndarray]], neighbours: int, power: float, block: int) -> np.ndarray:
    out = np.zeros(len(found))
    k = min(neighbours, len(model["labels"]))
    for at in range(0, len(found), block):
        part = found[at : at + block]
        cosine = unit(weighted(part, model["rarity"]) @ model["basis"]) @ model["vectors"].T
        last = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, -k][:, None]
        weight = np.where(cosine >= last, np.maximum(cosine, 0) ** power, 0)
        total = weight.sum(1)
        out[at : at + len(part)] = np.where(total > 0, weight @ model["labels"] / np.maximum(total, 1e-12), 0)
        out[at : at + len(part)][[not len(a) for a, _ in part]] = 0
    return np.clip(out, 0, 1).round(6)


def learn(docs: DataFrame, labels: DataFrame, *, doc_id: str, text: str, quality: str, max_labelled: int, axes: int) -> dict | None:
    """Fit on at most ``max_labelled`` labelled documents, those with the lowest hashes; None without any."""
    given = (
        labels.where(F.col(quality).isNotNull() & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("_id"))
        .agg(F.avg(F.col(quality)).alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_labelled)
    )
    wanted = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("binary").alias("_raw")).join(F.broadcast(given), "_id")

    def make() -> Callable:
        def work(batch: dict) -> tuple[list, None]:
            found = [terms(r) for r in batch["raw"].to_pylist()]
            return [[a.tolist() for a, _ in found], [n.tolist() for _, n in found]], None

        return work

    kinds = [("_at", T.ArrayType(T.IntegerType())), ("_n", T.ArrayType(T.FloatType()))]
    rows = map_batches(wanted, {"raw": F.col("_raw")}, ["_id", "_y"], kinds, make)
    # One row of each labelled id, whatever the number of its copies: the sample's bound holds.
    rows = rows.groupBy("_id").agg(F.first("_y").alias("_y"), F.max(F.struct("_at", "_n")).alias("_t")).collect()
    rows = sorted((r for r in rows if r._t._at), key=lambda r: r._id)
    if not rows:
        return None
    found = [(np.array(r._t._at, dtype=np.int32), np.array(r._t._n, dtype=np.float32)) for r in rows]
    return fit(found, np.array([r._y for r in rows]), axes)


def score(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    quality: str = "quality",
    keep: list[str] | None = None,
    max_labelled: int = 4096,
    axes: int = 48,
    neighbours: int = 24,
    power: float = 8.0,
    block: int = 256,
    name: str = "score",
) -> DataFrame:
    """``keep`` columns (default: all) and the score as ``name`` (an underscore more if it clashes)."""
    need(docs, doc_id, text)
    need(labels, doc_id, quality)
    keep = docs.columns if keep is None else keep
    model = learn(docs, labels, doc_id=doc_id, text=text, quality=quality, max_labelled=max_labelled, axes=axes)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable:
        def work(batch: dict) -> tuple[list, None]:
            raw = batch["text"].to_pylist()
            if sent.value is None:
                return [[0.5] * len(raw)], None
            return [vote(sent.value, [terms(r) for r in raw], neighbours, power, block).tolist()], None

        return work

    return map_batches(docs, {"text": docs[f"`{text}`"].cast("binary")}, keep, [(fresh(name, keep), T.DoubleType())], make)


def keep_good(docs: DataFrame, labels: DataFrame, *, least: float = 0.7, **options) -> DataFrame:
    """The documents with a score of ``least`` or more, with their columns as they were."""
    name = fresh("score", docs.columns)
    done = score(docs, labels, name=name, **options)
    return done.where(F.col(f"`{name}`") >= least).select(*[F.col(f"`{c}`") for c in docs.columns])


def held_out(doc_id: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    learnt = labels.where(~held_out("doc_id"))
    scored = score(docs.select("doc_id", "text"), learnt, keep=["doc_id"])
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
