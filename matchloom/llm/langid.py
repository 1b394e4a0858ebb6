"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its hashed byte 3- and 4-grams (lower-cased UTF-8, blanks included, so word
starts and ends are subwords too); a linear softmax on that average gives the language. Embeddings and softmax are trained
together by stochastic gradient descent in numpy on the driver, from a bounded, documented sample of labelled rows
(about ``max_rows`` distinct texts of at most ``max_chars`` characters, by a digest of the text). A fifth of the sample is held
back to fit a temperature and the rejection threshold: the lowest score from which on the accepted texts are right in at least
``precision`` of the cases. Where no score reaches that, or under 20 texts leave nothing to hold back, everything is rejected:
the language is still named, but marked as not accepted.

As average and softmax are both linear, prediction needs only the product of the two tables: one row of logits per hash
bucket. Whole texts are read, in slices, so memory does not grow with a text's length.

Defined cases: null texts and texts without a letter give ``und`` with score 0 and are rejected; with no labelled row at
all every text is ``und``; ids, language and source are never inputs of a prediction; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, id_bucket, map_batches, read_table, spread

UNKNOWN = "und"
REJECT_ALL = 2.0
_SLICE = 1 << 18


@dataclass(frozen=True)
class LanguageModel:
    """Languages, one row of logits per bucket, bias, temperature and rejection threshold."""

    languages: tuple[str, ...]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        z = counts @ self.logits / max(1.0, float(counts.sum())) + self.bias
        return softmax(z / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def bucket_counts(text: str, buckets: int) -> np.ndarray:
    """How often each hash bucket occurs among the byte 3- and 4-grams of the whole text."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)
    counts = np.zeros(buckets)
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    for start in range(0, len(data), _SLICE):
        b = data[start : start + _SLICE + 3].astype(np.uint32)
        tri = b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)
        quad = tri[:-1] ^ b[3:] * np.uint32(0x27D4EB2F) ^ np.uint32(0x165667B1)
        for grams, most in ((tri, _SLICE), (quad, _SLICE)):
            mixed = (grams[:most] * np.uint32(0x9E3779B1)) >> shift
            counts += np.bincount(mixed, minlength=buckets)
    return counts


def rejection_threshold(scores: np.ndarray, right: np.ndarray, precision: float) -> float:
    """The lowest occurring score from which on at least ``precision`` of the rows are right; above 1 if there is none."""
    levels, place = np.unique(scores, return_inverse=True)
    n = np.cumsum(np.bincount(place, minlength=len(levels))[::-1])[::-1]
    good = np.cumsum(np.bincount(place, right, len(levels))[::-1])[::-1]
    enough = np.flatnonzero(good >= precision * n)
    return float(levels[enough[0]]) if len(enough) else REJECT_ALL


def train(
    texts: list[str],
    labels: list[str],
    buckets: int = 1 << 15,
    width: int = 12,
    epochs: int = 4,
    rate: float = 0.5,
    precision: float = 0.99,
    seed: int = 7,
) -> LanguageModel:
    """Stochastic gradient descent over single texts; the last fifth (in seeded order) calibrates."""
    languages = tuple(sorted(set(labels)))
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 1 / width, (buckets, width))
    weights = np.zeros((width, len(languages)))
    bias = np.zeros(len(languages))
    place = {name: i for i, name in enumerate(languages)}
    order = rng.permutation(len(texts))
    held = set(order[: len(texts) // 5].tolist()) if len(texts) >= 20 else set()
    bags = []
    for text in texts:
        counts = bucket_counts(text, buckets)
        used = np.flatnonzero(counts)
        bags.append((used, (counts[used] / counts[used].sum())))
    steps = epochs * max(1, len(texts) - len(held))
    done = 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            if int(i) in held:
                continue
            used, share = bags[i]
            mean = share @ table[used]
            gap = softmax(mean @ weights + bias)
            gap[place[labels[i]]] -= 1
            step = rate * (1 - done / steps)
            back = weights @ gap
            weights -= step * np.outer(mean, gap)
            bias -= step * 0.1 * gap
            table[used] -= (step * len(used) ** 0.5) * share[:, None] * back
            done += 1
    logits = table @ weights
    raw = np.array([share @ logits[used] + bias for used, share in bags]) if bags else np.zeros((0, len(languages)))
    y = np.array([place[x] for x in labels], dtype=int)
    judge = np.array(sorted(held), dtype=int)
    temperature, threshold = 1.0, REJECT_ALL
    if len(judge):
        grid = np.geomspace(0.05, 5, 40)
        loss = [-np.log(np.maximum(softmax(raw[judge] / t)[np.arange(len(judge)), y[judge]], 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        scores = softmax(raw[judge] / temperature)
        threshold = rejection_threshold(scores.max(axis=1), scores.argmax(axis=1) == y[judge], precision)
    return LanguageModel(languages, logits.astype(np.float64), bias, temperature, threshold)


def training_sample(labelled: DataFrame, max_rows: int = 3000, max_chars: int = 20000) -> tuple[list[str], list[str]]:
    """About ``max_rows`` distinct labelled texts of at most ``max_chars`` characters, by a digest of the text."""
    fit = labelled.where(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull() & (F.length("text") <= max_chars)).select("text", "lang")
    rows = hash_sample(fit, F.xxhash64("text"), max_rows, "language").distinct().collect()  # copies come once
    rows.sort()
    return [r.text for r in rows], [r.lang for r in rows]


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row of ``docs``."""
    languages = model.languages if model else ()
    buckets = len(model.logits) if model else 0

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores, rejected = [], [], []
        for text, letter in zip(batch.column(1), batch.column(2)):
            if not languages or not letter.as_py():
                names.append(UNKNOWN), scores.append(0.0), rejected.append(True)
                continue
            p = model.probabilities(bucket_counts(text.as_py(), buckets))
            best = int(p.argmax())
            names.append(languages[best]), scores.append(float(p[best])), rejected.append(bool(p[best] < model.threshold))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
            ["doc_id", "lang_pred", "score", "rejected"],
        )

    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    return map_batches(rows, "doc_id long, lang_pred string, score double, rejected boolean", run)


def op2_langid(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learns only from rows whose crc32(doc_id) mod 3 is not 1."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")
    texts, labels = training_sample(docs.where(id_bucket("doc_id", 3) != 1))
    model = train(texts, labels) if texts else None
    out = predict(docs, model)
    return out.select("doc_id", (id_bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")
