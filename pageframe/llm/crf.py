"""Document quality from a linear-chain conditional random field over lines.

Every line gets features of its own characters and words and those of its two
neighbours. The chain has two labels, good and bad. It is fitted by gradient ascent
on documents whose lines all carry the document's label; the marginals of the
forward-backward pass, weighted by line length, add up to the document's quality.

The model is fitted on at most `most_docs` labelled documents of at most
`most_lines` lines; their features, not their texts, come to the driver. Scoring
covers every document and every line of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.llm.store import sliced

KINDS = 8
PIECE = 1 << 21


def _byte_kinds() -> np.ndarray:
    """Kind of each byte: lower, upper, digit, blank, sentence mark, shout or bar, other sign, beyond ASCII."""
    kind = np.full(256, 6, np.uint8)
    for i in range(256):
        c = chr(i)
        if i >= 128:
            kind[i] = 7
        elif c.islower():
            kind[i] = 0
        elif c.isupper():
            kind[i] = 1
        elif c.isdigit():
            kind[i] = 2
        elif c.isspace():
            kind[i] = 3
        elif c in ".,;:'\"-()":
            kind[i] = 4
        elif c in "!?|":
            kind[i] = 5
    return kind


BYTE_KINDS = _byte_kinds()
OWN = KINDS + 5


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line with its neighbours', weight of each line); an empty text is one empty line."""
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = data.split(b"\n")
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    starts = np.cumsum(sizes + 1) - sizes - 1
    counts = np.zeros((len(raw), KINDS))
    for begin in range(0, len(data), PIECE):
        kinds = BYTE_KINDS[np.frombuffer(data, np.uint8, min(PIECE, len(data) - begin), begin)]
        low, high = np.searchsorted(starts, [begin, begin + len(kinds)])
        cuts = np.r_[begin, starts[low:high]] - begin
        owners = np.r_[max(low - 1, 0), np.arange(low, high)]
        cells = np.repeat(owners, np.diff(np.r_[cuts, len(kinds)])) * KINDS + kinds
        counts += np.bincount(cells, minlength=counts.size).reshape(counts.shape)
    own = np.zeros((len(raw), OWN))
    width = np.maximum(sizes, 1)[:, None]
    own[:, :KINDS] = counts / width
    own[:, 3] -= (starts + sizes < len(data)) / width[:, 0]  # its own newline
    own[:, KINDS] = np.log1p(sizes)
    for i, line in enumerate(raw):
        words = line.split()
        n = len(words)
        if n:
            own[i, KINDS + 1] = np.log1p(len(line) / n)
            own[i, KINDS + 2] = sum(map(eq, words, words[1:])) / n
            own[i, KINDS + 3] = len(set(words)) / n ** 0.9
        own[i, KINDS + 4] = i > 0 and line == raw[i - 1]
    edge = np.zeros((1, OWN))
    beside = np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge])])
    return beside, sizes + 1.0


@dataclass(frozen=True)
class Model:
    """Weights of the good label over standardised features, and of the four transitions."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    moves: np.ndarray

    def lines(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.mean) / self.scale, -5, 5) @ self.weights + self.bias


def forward_backward(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chains in the rows of `scores`: marginals of the good label (chains, lines), and expected moves (chains, 2, 2)."""
    chains, longest = scores.shape
    odds = np.exp(np.clip(scores, -30, 30))
    emit = np.stack([1 / (1 + odds), odds / (1 + odds)], axis=2)
    step = np.exp(moves)
    alpha = np.empty((longest, chains, 2))
    beta = np.ones((longest, chains, 2))
    alpha[0] = emit[:, 0]
    for t in range(longest):
        if t:
            alpha[t] = (alpha[t - 1] @ step) * emit[:, t]
        alpha[t] /= alpha[t].sum(axis=1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        here = (emit[:, t + 1] * beta[t + 1]) @ step.T
        beta[t] = np.where((sizes > t + 1)[:, None], here / here.sum(axis=1, keepdims=True), 1.0)
    both = alpha * beta
    both /= both.sum(axis=2, keepdims=True)
    expected = np.zeros((chains, 2, 2))
    for t in range(1, longest):
        pair = alpha[t - 1][:, :, None] * step * (emit[:, t] * beta[t])[:, None, :]
        expected += np.where((sizes > t)[:, None, None], pair / pair.sum(axis=(1, 2), keepdims=True), 0.0)
    return both[:, :, 1].T, expected


def padded(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(v) for v in values])
    out = np.zeros((len(values), sizes.max()))
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.concatenate(values)
    return out, sizes


def fit(features: list[np.ndarray], labels: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> Model:
    """Gradient ascent (Adam) on the mean log-likelihood of chains that carry their document's label throughout."""
    width = 3 * OWN
    if not len(labels):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, np.zeros((2, 2)))
    order = np.argsort([len(f) for f in features], kind="stable")
    features, labels = [features[i] for i in order], np.asarray(labels, float)[order]
    flat = np.concatenate(features)
    mean, scale = flat.mean(axis=0), flat.std(axis=0) + 1e-6
    ends = np.cumsum([len(f) for f in features])
    groups = np.split(np.arange(len(features)), np.flatnonzero(np.diff([int(np.log2(len(f))) for f in features])) + 1)
    rows = [np.clip((np.concatenate([features[i] for i in g]) - mean) / scale, -5, 5) for g in groups]
    theta = np.zeros(width + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for turn in range(1, rounds + 1):
        gradient = -ridge * theta * len(labels)
        for g, x in zip(groups, rows):
            cuts = np.cumsum([len(features[i]) for i in g])[:-1]
            scores, sizes = padded(np.split(x @ theta[:width] + theta[width], cuts))
            good, expected = forward_backward(scores, sizes, theta[-4:].reshape(2, 2))
            inside = np.arange(scores.shape[1]) < sizes[:, None]
            # a long chain counts like a short one
            miss = ((labels[g][:, None] - good) / sizes[:, None])[inside]
            gradient[:width] += x.T @ miss
            gradient[width] += miss.sum()
            seen = np.zeros((len(g), 2, 2))
            seen[np.arange(len(g)), labels[g].astype(int), labels[g].astype(int)] = sizes - 1
            gradient[-4:] += ((seen - expected) / sizes[:, None, None]).sum(axis=0).ravel()
        gradient /= len(labels)
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta += 0.1 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    assert ends[-1] == len(flat)
    return Model(mean, scale, theta[:width], float(theta[width]), theta[-4:].reshape(2, 2))


def quality(model: Model, texts: list[str | None], cells: int = 1 << 16) -> np.ndarray:
    """Length-weighted mean marginal of each text; chains of like length run side by side, at most `cells` lines at once."""
    found = np.zeros(len(texts))
    waiting: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}

    def settle(chains: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        scores, sizes = padded([s for _, s, _ in chains])
        weights, _ = padded([w for _, _, w in chains])
        good, _ = forward_backward(scores, sizes, model.moves)
        found[[i for i, _, _ in chains]] = (good * weights).sum(axis=1) / weights.sum(axis=1)

    for i, text in enumerate(texts):
        features, weights = line_features(text)
        size = len(weights).bit_length()
        chains = waiting.setdefault(size, [])
        chains.append((i, model.lines(features), weights))
        if len(chains) << size > cells:
            settle(waiting.pop(size))
    for chains in waiting.values():
        settle(chains)
    return np.clip(found, 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", most_docs: int = 3000, most_lines: int = 400) -> Model:
    """Fit on a bounded sample: the `most_docs` labelled, not held-out ids that come first by hash, texts of up to `most_lines` lines.

    Of several texts with one id the one with the smallest hash is taken, so at most `most_docs` texts reach the driver.
    """
    usable = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("_label"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    found = docs.select("doc_id", F.col(text).alias("_text")).join(F.broadcast(sample), "doc_id")
    tag = F.xxhash64(F.coalesce("_text", F.lit("")))
    chosen = found.groupBy("doc_id", "_label").agg(F.min_by(F.struct("_text"), tag)["_text"].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            keep = [i for i, t in enumerate(texts) if (t or "").count("\n") < most_lines]
            values = [line_features(texts[i])[0].astype("<f4").tobytes() for i in keep]
            rows = batch.take(pa.array(keep, pa.int64()))
            columns = [rows.column(0), rows.column(2).cast(pa.int32()), pa.array(values, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "features"])

    kept = chosen.select(F.col("doc_id").cast("long"), "_text", "_label").mapInArrow(run, "doc_id long, label int, features binary")
    rows = sorted((r.doc_id, r.label, bytes(r.features)) for r in kept.collect())  # at most `most_docs` rows
    return fit([np.frombuffer(f, "<f4").reshape(-1, 3 * OWN).astype(float) for _, _, f in rows], np.array([label for _, label, _ in rows]))


def scored(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: float = 0.7) -> DataFrame:
    """`keep` columns, held_out, score and predicted (1 if score >= `limit`).

    A null or empty text is scored as one empty line; very long texts count whole; equal texts have equal scores; a null
    doc_id is not held out. Columns beyond the text are never read by the model. An empty table stays empty.
    """
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double"
    sent = [F.col(c) for c in keep] + ([] if text in keep else [F.col(text).alias("_text")])
    place = keep.index(text) if text in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = quality(model, batch.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found)], [*keep, "score"])

    result = docs.select(*sent).mapInArrow(run, schema)
    return result.select(*keep, held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= limit, 1).otherwise(0).alias("predicted"))
