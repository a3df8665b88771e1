"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded from its surface and from hashed words and character n-grams, whose
vectors are learnt; gated attention weighs the encodings, and the weighted sum is scored. Only document labels are known, so
the attention learns by itself which passages tell. Training fits on a bounded sample on the driver; scoring is one pass over
whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, in_batches, text_or_empty
from .textkit import Words, mix

PASSAGE_WORDS = 64
HIDDEN, GATE = 16, 8
FEATURES = 14
#: Learnt vectors that words, and the first and last three bytes of words, are hashed to.
BUCKETS = 1 << 13
GRAMS = 3

_CLASS = {"symbol": b"#*$%&|<>", "shout": b"!", "bar": b"|", "digit": b"0123456789", "stop": b".,;:?", "line": b"\n"}


@dataclass
class Bags:
    """Passages of texts: features of each, how many each text has, words of each, and the buckets of every word."""

    x: np.ndarray
    counts: np.ndarray
    words: np.ndarray
    grams: np.ndarray

    def texts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(passages, features, words of passages, buckets) of each text."""
        last, at = np.cumsum(self.counts), np.r_[0, np.cumsum(self.words)]
        for n, b in zip(self.counts.tolist(), last.tolist(), strict=True):
            yield n, self.x[b - n : b], self.words[b - n : b], self.grams[at[b - n] : at[b]]


def passages(column: pa.Array, size: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, passages of each text), see bags."""
    got = bags(column, size)
    return got.x, got.counts


def _buckets(words: Words) -> np.ndarray:
    """The buckets of each word: of the whole word, its first and its last three bytes, small letters and capitals alike."""
    s, e = words.starts, words.ends
    spans = [(s, e, 1), (s, np.minimum(s + 3, e), 2), (np.maximum(e - 3, s), e, 3)]
    return np.stack([mix(words.spans(a, b, lower=True) + np.uint64(k)) % np.uint64(BUCKETS) for a, b, k in spans], 1).astype(np.uint16) if len(s) else np.zeros((0, GRAMS), np.uint16)


def bags(column: pa.Array, size: int = PASSAGE_WORDS) -> Bags:
    """The passages of each text. A passage is `size` words in a row; a text without words has one, of zeros.

    Features are shares within the passage: symbols, capitals, exclamation and bar marks, digits, stops and line ends, mean
    word length, one-byte and very long words, words equal to the one, two or three words before, and the passage's length.
    """
    words = Words(column)
    grams = _buckets(words)
    counts = np.maximum(1, -(-words.counts // size))
    of_text = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(len(of_text)) - np.repeat(np.cumsum(counts) - counts, counts)
    lo = words.first[:-1][of_text] + nth * size
    hi = np.minimum(lo + size, words.first[1:][of_text])
    n = np.maximum(hi - lo, 0)
    out = np.zeros((len(of_text), FEATURES), np.float32)
    full = n > 0
    if not full.any():
        return Bags(out, counts, n, grams)
    per_passage = n
    lo, hi, n = lo[full], hi[full], n[full].astype(np.float64)
    # The bytes from a passage's first word to the next passage's first word, or to the text's end.
    begin = words.starts[lo]
    last = hi == words.first[1:][of_text[full]]
    end = np.where(last, words.off[1:][of_text[full]], words.starts[np.minimum(hi, len(words.starts) - 1)])
    size_b = np.maximum(end - begin, 1)

    def bytes_in(mask: np.ndarray) -> np.ndarray:
        ran = np.r_[0, np.cumsum(mask)]
        return ran[end] - ran[begin]

    def words_in(mask: np.ndarray) -> np.ndarray:
        ran = np.r_[0, np.cumsum(mask)]
        return ran[hi] - ran[lo]

    table = {k: np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for k, v in _CLASS.items()}
    seen = {k: bytes_in(t[words.buf]) for k, t in table.items()}
    upper = (words.buf >= 65) & (words.buf <= 90)
    upper[1:] |= (words.buf[:-1] == 0xC3) & (words.buf[1:] >= 0x80) & (words.buf[1:] <= 0x9E)
    length, h = words.ends - words.starts, words.hashes()
    text_of = np.repeat(np.arange(len(words.counts)), words.counts)
    cols = [seen["symbol"] / size_b * 4, bytes_in(upper) / size_b * 2, seen["shout"] / n, seen["bar"] / n, seen["digit"] / size_b * 4, seen["stop"] / n, seen["line"] / n * 4, words_in(length) / n / 10, words_in(length == 1) / n, words_in(length > 24) / n]
    for lag in (1, 2, 3):
        same = np.zeros(len(h), bool)
        same[lag:] = (h[lag:] == h[:-lag]) & (text_of[lag:] == text_of[:-lag])
        cols.append(words_in(same) / n)
    cols.append(np.log1p(n) / np.log1p(size))
    out[full] = np.stack(cols, 1)
    return Bags(out, counts, per_passage, grams)


@dataclass
class Model:
    """Weights of encoder, gate and scorer, vectors of buckets (T), and the features' scale."""

    p: dict[str, np.ndarray]

    def scores(self, x: np.ndarray, counts: np.ndarray, words: np.ndarray | None = None, grams: np.ndarray | None = None) -> np.ndarray:
        return _forward(self.p, x, counts, words, grams)[0]

    def of_texts(self, column: pa.Array) -> np.ndarray:
        """Scores to twelve places: beyond, they depend on which texts are worked on together."""
        b = bags(column)
        return np.round(self.scores(b.x.astype(np.float64), b.counts, b.words, b.grams), 12)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _means(table: np.ndarray, words: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The sum of the words' vectors over the number of words for each passage, some thousand passages at a time."""
    out = np.zeros((len(words), table.shape[1]))
    full = np.flatnonzero(words)
    at = np.r_[0, np.cumsum(words[full])]
    for k in range(0, len(full), 2048):
        own = full[k : k + 2048]
        lo, hi = at[k], at[k + len(own)]
        sums = table[grams[lo:hi, 0]]
        for g in range(1, GRAMS):
            sums += table[grams[lo:hi, g]]
        out[own] = np.add.reduceat(sums, at[k : k + len(own)] - lo, axis=0) / words[own][:, None]
    return out


def _forward(p: dict[str, np.ndarray], x: np.ndarray, counts: np.ndarray, words: np.ndarray | None = None, grams: np.ndarray | None = None) -> tuple:
    x = (x - p["mean"]) / p["scale"]
    said = _means(p["T"], words, grams) if words is not None else 0
    h = np.tanh(x @ p["E"] + p["e"] + said)
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    a = np.clip((t * g) @ p["w"], -20, 20)
    starts = np.r_[0, np.cumsum(counts)[:-1]]
    top = np.repeat(np.maximum.reduceat(a, starts), counts)
    e = np.exp(a - top)
    share = e / np.repeat(np.add.reduceat(e, starts), counts)
    z = np.add.reduceat(share[:, None] * h, starts, axis=0)
    return _sigmoid(z @ p["c"] + p["b"]), x, h, t, g, share, z, starts


def train(x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 3, rate: float = 0.02, batch: int = 256, words: np.ndarray | None = None, grams: np.ndarray | None = None, steps: int = 150) -> Model:
    """Fit by Adam on the mean log loss with a little decay; each class has at least a third of the total weight.

    The data are gone through `epochs` times, or as often as about `steps` batches take. The buckets' vectors begin at
    zero, so that words which training hasn't met say nothing, and share one step size, so that rare ones move little.
    """
    rng = np.random.default_rng(seed)
    p = {"mean": x.mean(0), "scale": x.std(0) + 1e-3, "E": rng.normal(0, 0.3, (x.shape[1], HIDDEN)), "e": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, GATE)), "U": rng.normal(0, 0.3, (HIDDEN, GATE)), "w": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "b": np.zeros(1)}
    p["T"] = np.zeros((BUCKETS, HIDDEN), np.float32)
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    weight = np.where(y > 0, max(share, 1 / 3) / share, max(1 - share, 1 / 3) / (1 - share))
    names = ["E", "e", "V", "U", "w", "c", "b"] + ["T"] * (words is not None)
    m, v, step = {k: np.zeros_like(p[k]) for k in names}, {k: np.zeros_like(p[k]) if k != "T" else 0.0 for k in names}, 0
    first = np.r_[0, np.cumsum(counts)]
    at = np.r_[0, np.cumsum(words)] if words is not None else None
    for _ in range(min(epochs, max(1, -(-steps * batch // len(counts))))):
        order = rng.permutation(len(counts))
        for k in range(0, len(order), batch):
            chosen = order[k : k + batch]
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in chosen])
            own, said, met = counts[chosen], None, None
            if words is not None:
                said, met = words[rows], np.concatenate([grams[at[first[i]] : at[first[i + 1]]] for i in chosen])
            s, xs, h, t, g, a, z, starts = _forward(p, x[rows], own, said, met)
            ds = (s - y[chosen]) * weight[chosen] / len(chosen)
            d = {"c": z.T @ ds, "b": np.array([ds.sum()])}
            dz = np.repeat(ds[:, None] * p["c"], own, axis=0)
            dh, da = a[:, None] * dz, (dz * h).sum(1)
            da = a * (da - np.repeat(np.add.reduceat(a * da, starts), own))
            d["w"] = (t * g).T @ da
            dt, dg = da[:, None] * p["w"] * g * (1 - t * t), da[:, None] * p["w"] * t * g * (1 - g)
            d["V"], d["U"] = h.T @ dt, h.T @ dg
            dx = (dh + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
            d["E"], d["e"] = xs.T @ dx, dx.sum(0)
            if words is not None:
                each = np.repeat(dx / np.maximum(said, 1)[:, None], said, axis=0)
                d["T"] = np.stack([sum(np.bincount(met[:, j], each[:, i], BUCKETS) for j in range(GRAMS)) for i in range(HIDDEN)], 1).astype(np.float32)
            step += 1
            for name in names:
                grad = d[name] + 1e-4 * p[name] * (name != "T")
                square = grad * grad if name != "T" else float((grad * grad).sum() / max(1, np.count_nonzero(grad)))
                m[name], v[name] = 0.9 * m[name] + 0.1 * grad, 0.999 * v[name] + 0.001 * square
                p[name] = p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
    return Model({k: np.asarray(w, np.float32 if k == "T" else np.float64) for k, w in p.items()})


def held_out():
    """True for rows that training never sees."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 6000, max_passages: int = 120_000) -> Model:
    """Train on at most max_train labelled rows that aren't held out, and at most max_passages passages: those whose hashed ids,
    then texts, come first. What the driver holds is bounded by both, whatever the texts' lengths.

    Texts of more than a twentieth of max_passages are scored like others but not learnt from. Rows without a quality or
    with one that isn't 0 or 1, and labels without a document, are passed over; a document with two labels has the lower.
    With no labels, or labels of one class only, every score is that class's share (0.5 if none).
    """
    usable = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("_y"))
    sample = usable.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")  # max_train rows
    rows = rows.select("_y", F.xxhash64(F.lit(5), "doc_id").alias("h"), F.xxhash64("text").alias("h2"), "text")

    def work(batch: pa.RecordBatch) -> dict:
        b = bags(batch.column("text"))
        parts = list(b.texts())
        return {"h": batch.column("h"), "h2": batch.column("h2"), "y": batch.column("_y"), "n": b.counts, "x": pa.array([x.tobytes() for _, x, _, _ in parts], pa.binary()), "w": pa.array([w.astype(np.int16).tobytes() for _, _, w, _ in parts], pa.binary()), "g": pa.array([g.tobytes() for *_, g in parts], pa.binary())}

    table = in_batches(rows, "h long, h2 long, y int, n long, x binary, w binary, g binary", work, by="text").where(F.col("n") * 20 <= max_passages)
    first = cut(table.orderBy("h", "h2", "y").limit(max_train))
    upto = F.sum("n").over(Window.orderBy("h", "h2", "y").rowsBetween(Window.unboundedPreceding, 0))  # max_train rows
    got = first.withColumn("upto", upto).where(F.col("upto") <= max_passages).drop("upto").toPandas().sort_values(["h", "h2", "y"], kind="stable")
    y = got["y"].to_numpy(np.float64)
    if not len(got) or y.min() == y.max():
        share = float(y.mean()) if len(got) else 0.5
        zero = {"mean": np.zeros(FEATURES), "scale": np.ones(FEATURES), "E": np.zeros((FEATURES, HIDDEN)), "e": np.zeros(HIDDEN), "V": np.zeros((HIDDEN, GATE)), "U": np.zeros((HIDDEN, GATE)), "w": np.zeros(GATE), "c": np.zeros(HIDDEN), "T": np.zeros((BUCKETS, HIDDEN), np.float32)}
        return Model(zero | {"b": np.array([(share - 0.5) * 60 if share in (0, 1) else 0.0])})
    read_ = lambda c, kind: np.frombuffer(b"".join(got[c]), kind)
    x, words = read_("x", np.float32).reshape(-1, FEATURES).astype(np.float64), read_("w", np.int16).astype(np.int64)
    return train(x, got["n"].to_numpy(np.int64), y, words=words, grams=read_("g", np.uint16).reshape(-1, GRAMS))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text; further columns don't matter).

    Only the text is looked at. Null and empty texts, and those without words, are one passage of zeros and get its score.
    A null doc_id isn't held out. Texts of any length are read whole; repeated rows get equal scores. An empty table gives
    an empty result.
    """

    def work(batch: pa.RecordBatch) -> dict:
        s = model.of_texts(batch.column("text"))
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": s, "predicted": (s >= threshold).astype(np.int32)}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty().alias("text"))
    return in_batches(rows, "doc_id long, held_out boolean, score double, predicted int", work, by="text")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_train: int = 6000) -> DataFrame:
    """score() of docs (doc_id, text) by a model fitted to labels (doc_id, quality) of rows that aren't held out.

    Labels decide nothing but the training; lang, source and doc_id are no inputs of a score. Rows that repeat a doc_id are
    scored, and, within max_train rows, learnt from, each by its own text. Columns of other names, even those of the
    result, change nothing. Empty docs give an empty result; empty labels the score 0.5 everywhere.
    """
    return score(docs, fit(docs, labels, max_train), threshold)


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with docs' columns; one pass, nothing is joined."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(model.of_texts(batch.column("text")) >= threshold))

    return in_batches(docs, docs.schema, work, by="text")
