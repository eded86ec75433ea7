"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` words. A passage is a vector of hashed word shapes and hashed words, encoded by
a learned layer; gated attention, learned from the labels of whole documents, weighs the passages, and the weighted sum of
their codes is scored. Training takes a bounded sample of labelled documents (`max_documents`, those of least hash);
scoring covers every passage of every document.

Nulls and edge cases: a null or empty text is one empty passage and gets a score; labels without a document, or null, are
left out, as is a text longer than the bound on passages, from training; without labels the score is 0.5; with one kind of label only, the model learns that kind; repeated rows get equal
scores; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .common import batch_of, hold_tables, text_batches, two_columns, words_of

PASSAGE = 64
SHAPES, WORDS = 192, 320
WIDTH = SHAPES + WORDS
KEPT_WORDS = 300_000
_RUNS = [(re.compile(rb"[A-Z]+"), b"X"), (re.compile(rb"[a-z\x80-\xff]+"), b"x"), (re.compile(rb"[0-9]+"), b"9")]
_known: dict[bytes, int] = {}


def _features(word: bytes) -> int:
    """Two hashed features of a word in one number: its shape with runs of a kind collapsed, and its letters."""
    shape = word
    for pattern, sign in _RUNS:
        shape = pattern.sub(sign, shape)
    shape += b" long" if len(word) > 20 else b" mid" if len(word) > 8 else b""
    return zlib.crc32(shape) % SHAPES * WORDS + zlib.crc32(word.lower().strip(b".,;:!?#*$%&|<>\"'()")) % WORDS


def bag(text: str) -> np.ndarray:
    """(passages, WIDTH) counts of a whole text; counts fit a byte as a passage has PASSAGE words. Long texts are counted piece by piece."""
    hold_tables("quality classifier", _known.clear)
    words, step = words_of(text), 1024 * PASSAGE
    return np.concatenate([_counts(words[i:i + step]) for i in range(0, max(1, len(words)), step)])


def _counts(words: list[bytes]) -> np.ndarray:
    n = max(1, -(-len(words) // PASSAGE))
    for w in set(words).difference(_known):
        if len(_known) >= KEPT_WORDS:
            _known.clear()
        _known[w] = _features(w)
    found = np.fromiter((_known[w] if w in _known else _features(w) for w in words), np.int64, len(words))
    row = np.arange(len(words)) // PASSAGE * WIDTH
    both = np.concatenate((row + found // WORDS, row + SHAPES + found % WORDS))
    return np.bincount(both, minlength=n * WIDTH).astype(np.uint8).reshape(n, WIDTH)


class GatedAttention:
    """Encoder, gated attention and scorer as plain matrices."""

    def __init__(self, hidden: int = 24, attention: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        def start(*shape):
            return (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"E": start(WIDTH, hidden), "e": np.zeros(hidden, np.float32), "V": start(hidden, attention), "U": start(hidden, attention),
                  "w": start(attention), "c": start(hidden), "b": np.zeros(1, np.float32)}

    def forward(self, counts, starts):
        """Scores of the bags whose passages begin at ``starts``; with what the gradient needs."""
        p = self.p
        x = np.log1p(counts.astype(np.float32))
        h = np.tanh(x @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        logits = (t * s) @ p["w"]
        sizes = np.diff(np.append(starts, len(x)))
        bag_of = np.repeat(np.arange(len(starts)), sizes)
        a = np.exp(logits - np.maximum.reduceat(logits, starts)[bag_of])
        a /= np.add.reduceat(a, starts)[bag_of]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))
        return score, (x, h, t, s, a, z, bag_of)

    def gradient(self, counts, starts, labels, decay):
        p = self.p
        score, (x, h, t, s, a, z, bag_of) = self.forward(counts, starts)
        do = ((score - labels) / len(labels)).astype(np.float32)
        dz = (do[:, None] * p["c"])[bag_of]
        da = (h * dz).sum(axis=1)
        dl = a * (da - np.add.reduceat(a * da, starts)[bag_of])
        dt, ds = dl[:, None] * p["w"] * s * (1 - t * t), dl[:, None] * p["w"] * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        g = {"E": x.T @ dh, "e": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ dl, "c": z.T @ do, "b": do.sum(keepdims=True)}
        return {k: v + (decay * p[k] if v.ndim == 2 else 0) for k, v in g.items()}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 15, batch: int = 128, rate: float = 0.005, decay: float = 1e-4, seed: int = 7):
        r = np.random.default_rng(seed)
        m, v, step = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        for _ in range(epochs):
            order = r.permutation(len(bags))
            for i in range(0, len(order), batch):
                part = order[i:i + batch]
                chosen = [bags[j] for j in part]
                starts = np.concatenate(([0], np.cumsum([len(x) for x in chosen])[:-1]))
                step += 1
                for k, g in self.gradient(np.concatenate(chosen), starts, labels[part], decay).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * m[k] / (1 - 0.9 ** step) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return self


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_documents: int = 6000, max_passages: int = 60_000) -> GatedAttention | None:
    """Fit on at most ``max_documents`` labelled documents, those whose id has the least hash, and at most ``max_passages`` passages of
    them: a document that would go beyond is left out, and the next ones are tried. Of rows that share an id one is taken (the text of
    least hash). Both bounds keep the driver's share fixed; they do not touch scoring."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
    plain = two_columns(docs, key, text, "string")
    there = known.groupBy("doc_id").agg(F.max("label").alias("label")).join(plain.select("doc_id"), "doc_id", "left_semi")
    chosen = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents)
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("passages", pa.int64()), ("counts", pa.binary())])

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                bags = [bag(t or "") for t in part.column("text").to_pylist()]
                yield batch_of(schema, part.column("doc_id").to_pylist(), part.column("label").to_pylist(), [len(x) for x in bags], [x.tobytes() for x in bags])

    # the sample has max_documents rows of two numbers at most
    chosen = F.broadcast(materialize(chosen, "training-ids"))
    text_of = F.coalesce("text", F.lit(""))
    joined = plain.join(chosen, "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min_by(text_of, F.struct(F.xxhash64(text_of), text_of)).alias("text"))
    rows = materialize(joined.mapInArrow(run, "doc_id bigint, label int, passages bigint, counts binary"), "bags")
    passages, fit = 0, []
    for r in sorted(rows.select(F.xxhash64("doc_id").alias("at"), "doc_id", "passages").collect()):
        if passages + r.passages <= max_passages:
            passages += r.passages
            fit.append((r.doc_id,))
    if not fit:
        return None
    taken = rows.join(F.broadcast(docs.sparkSession.createDataFrame(fit, "doc_id bigint")), "doc_id").withColumn("at", F.xxhash64("doc_id")).collect()
    taken.sort(key=lambda r: (r["at"], r.doc_id))
    bags = [np.frombuffer(r.counts, np.uint8).reshape(-1, WIDTH) for r in taken]
    return GatedAttention().fit(bags, np.array([min(max(r.label, 0), 1) for r in taken], np.float32))


def scores(docs: DataFrame, model: GatedAttention | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for keys, texts in text_batches(batches, "text"):
            for i in range(0, len(keys), 64):
                yield batch_of(schema, keys[i:i + 64], score_texts(model, texts[i:i + 64]))

    return two_columns(docs, key, text, "string").mapInArrow(run, "doc_id bigint, score double")


def score_texts(model: GatedAttention | None, texts: list[str]) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    bags = [bag(t) for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in bags])[:-1]))
    return model.forward(np.concatenate(bags), starts)[0].astype(np.float64)


def keep_good(docs: DataFrame, model: GatedAttention | None, least: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, all columns."""
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                good = score_texts(model, [t or "" for t in part.column(text).to_pylist()]) >= least
                yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
