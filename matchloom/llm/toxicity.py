"""Toxicity: a counterfactual-regularised linear classifier over words and subwords.

Features are the presence of words and of the 4- to 6-character pieces of bordered words (``<word>``) in a text. The
pieces kept are those far more frequent among toxic than among other labelled texts. A logistic regression is fitted
on them by gradient descent in numpy, with a counterfactual term: in every labelled text that names a group, the group
terms are swapped for others of the same kind a few times, and squared differences between the two scores are penalised.
A group term that merely travels with the label thus loses its weight, and neutral mentions of a group are left alone.

Training uses a bounded, documented sample (about ``max_rows`` labelled texts of at most ``max_chars`` characters, by a digest
of the id) that is collected to the driver. Scoring finds the kept pieces in every whole text by one automaton (Aho-Corasick),
so a run of letters of any length, as in scripts without blanks, is searched from end to end.

Defined cases: null and empty texts get the score of a text without features; without labels of both
kinds there is nothing to learn and every score is (nearly) 0; labels, language, source and id are never
inputs of a score; repeated rows of documents and labels count once (the highest label holds); a text that names every term
of a kind has no counterfactual of that kind; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, id_bucket, map_batches, read_table, spread

# Group terms whose exchange must not move a score. A term is exchanged within its kind, so that sentences stay sentences.
IDENTITY_TERMS = {
    "people, singular": "woman man girl boy muslim christian jew hindu buddhist atheist immigrant refugee foreigner migrant".split(),
    "people, plural": "women men girls boys muslims christians jews hindus buddhists atheists immigrants refugees foreigners migrants".split(),
    "adjectives": "gay lesbian transgender straight black white asian african arab latino indian chinese mexican turkish jewish islamic disabled blind deaf old young poor rich".split(),
    "French": "femmes hommes musulmans chrétiens juifs hindous bouddhistes athées immigrés réfugiés étrangers migrants noirs blancs arabes".split(),
    "German": "frauen männer muslime christen juden hindus buddhisten atheisten einwanderer flüchtlinge ausländer migranten schwarze weiße araber".split(),
    "Spanish": "mujeres hombres musulmanes cristianos judíos hindúes budistas ateos inmigrantes refugiados extranjeros migrantes negros blancos árabes".split(),
}
GROUP_WORDS = frozenset(term for terms in IDENTITY_TERMS.values() for term in terms)

_WORD = re.compile(r"\w+")
_GAP = re.compile(r"\W+")
_SLICE = 1 << 20


def pieces(word: str) -> Iterator[str]:
    """The bordered word itself and its 4- to 6-character pieces, repeats included."""
    w = f"<{word}>"
    yield w
    for n in (4, 5, 6):
        for i in range(len(w) - n + 1):
            yield w[i : i + n]


def _slices(text: str | None) -> Iterator[str]:
    """The lower-cased text in slices that end between words; a run without an end is one slice."""
    text = text or ""
    start = 0
    while start < len(text):
        end = min(len(text), start + _SLICE)
        while end < len(text) and (text[end].isalnum() or text[end] == "_"):
            end += 1
        yield text[start:end].lower()
        start = end


def words_of(text: str | None) -> set[str]:
    """Distinct lower-cased words of a whole text."""
    found: set[str] = set()
    for part in _slices(text):
        found.update(_WORD.findall(part))
    return found


@dataclass
class ToxicityModel:
    """Weights of the kept pieces, and the intercept."""

    index: dict[str, int]
    weights: np.ndarray
    intercept: float

    def __post_init__(self) -> None:
        self._automaton = None

    def __getstate__(self):
        return {"index": self.index, "weights": self.weights, "intercept": self.intercept, "_automaton": None}

    def features(self, text: str | None) -> list[int]:
        """The kept pieces that occur in the text, in ascending order."""
        if not self.index:
            return []
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for piece, i in self.index.items():
                self._automaton.add_word(piece, i)
            self._automaton.make_automaton()
        found: set[int] = set()
        for part in _slices(text):
            found.update(i for _, i in self._automaton.iter(f"<{_GAP.sub('><', part)}>"))
        return sorted(found)

    def score(self, text: str | None) -> float:
        z = self.intercept + float(self.weights[self.features(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


class _Corpus:
    """Labelled texts as sets of word numbers, and the piece numbers of every word (those of ``wanted``)."""

    def __init__(self, texts: list[str]) -> None:
        self.words: dict[str, int] = {}
        for term in sorted(GROUP_WORDS):
            self.words[term] = len(self.words)
        self.texts = [np.fromiter({self.words.setdefault(w, len(self.words)) for w in words_of(text)}, dtype=np.int64) for text in texts]

    def number(self, wanted: dict[str, int]) -> list[np.ndarray]:
        """Per word, the distinct numbers of its pieces."""
        return [np.fromiter({wanted[p] for p in pieces(word) if p in wanted}, dtype=np.int64) for word in self.words]


def _select(corpus: _Corpus, y: np.ndarray, most: int, ratio: float, least: int) -> list[str]:
    """Pieces at least ``ratio`` times as frequent among toxic texts, and group terms, by strength.

    Only pieces of at least ``least`` toxic texts are counted in the others.
    """
    names = list(corpus.words)
    toxic: Counter[str] = Counter()
    for words, label in zip(corpus.texts, y):
        if label:
            toxic.update({p for w in words.tolist() for p in pieces(names[w])})
    wanted = [p for p, n in toxic.items() if n >= least]
    wanted = list(dict.fromkeys(wanted + [f"<{t}>" for t in sorted(GROUP_WORDS)]))
    of_word = corpus.number({p: i for i, p in enumerate(wanted)})
    clean = np.zeros(len(wanted))
    seen = np.zeros(len(corpus.words), dtype=np.int64)
    for words, label in zip(corpus.texts, y):
        if not label:
            present = np.zeros(len(wanted), dtype=bool)
            for w in words.tolist():
                present[of_word[w]] = True
            clean += present
        seen[words] += 1
    positives, negatives = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    kept, groups = [], []
    for i, piece in enumerate(wanted):
        share, other = toxic.get(piece, 0) / positives, (clean[i] + 0.5) / negatives
        if piece[1:-1] in GROUP_WORDS:
            if seen[corpus.words[piece[1:-1]]]:
                groups.append(piece)
        elif share >= ratio * other:
            kept.append((other - share, piece))
    return list(dict.fromkeys([piece for _, piece in sorted(kept)[:most]] + groups))


def swapped(words: set[str], rng: np.random.Generator, copies: int = 4) -> list[set[str]]:
    """The words with the group terms exchanged for others of their kind, a few times; nothing if no term can be exchanged."""
    out = []
    named = {kind: sorted(words & set(terms)) for kind, terms in IDENTITY_TERMS.items()}
    rest = {kind: sorted(set(IDENTITY_TERMS[kind]) - words) for kind in named}
    kinds = [kind for kind in named if named[kind] and rest[kind]]
    if not kinds:
        return out
    for _ in range(copies):
        other = set(words)
        for kind in kinds:
            other -= set(named[kind])
            other |= set(rng.choice(rest[kind], len(named[kind])).tolist())
        out.append(other)
    return out


def _counterfactuals(corpus: _Corpus, of_word: list[np.ndarray], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each swapped copy, copy, piece, +1 or -1): the pieces that a swapped copy has more, or fewer, than its text."""
    names = list(corpus.words)
    terms = {corpus.words[t] for t in GROUP_WORDS}
    base, copy, col, sign = [], [], [], []
    for i, words in enumerate(corpus.texts):
        own = set(words.tolist())
        if not own & terms:
            continue
        for other in swapped({names[w] for w in own & terms}, rng):
            target = {corpus.words[t] for t in other}
            gone, new = (own & terms) - target, target - own
            stay = Counter(int(p) for w in own - gone for p in of_word[w])
            lost = {int(p) for w in gone for p in of_word[w]}
            more = {int(p) for w in new for p in of_word[w]}
            for p in lost - more:
                if not stay[p]:
                    copy.append(len(base)), col.append(p), sign.append(-1.0)
            for p in more - lost:
                if not stay[p]:
                    copy.append(len(base)), col.append(p), sign.append(1.0)
            base.append(i)
    return np.array(base, dtype=np.int64), np.array(copy, dtype=np.int64), np.array(col, dtype=np.int64), np.array(sign)


def train(
    texts: list[str],
    labels: list[int],
    fairness: float = 20.0,
    penalty: float = 0.05,
    most: int = 3000,
    ratio: float = 6.0,
    least: int = 4,
    steps: int = 300,
    seed: int = 11,
) -> ToxicityModel:
    """Full-batch gradient descent (Adam) on log loss + ridge + ``fairness`` x mean squared counterfactual score change."""
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return ToxicityModel({}, np.zeros(0), -40.0)
    corpus = _Corpus(texts)
    names = _select(corpus, y.astype(int), most, ratio, least)
    index = {p: i for i, p in enumerate(names)}
    of_word = corpus.number(index)
    present = [np.unique(np.concatenate([of_word[w] for w in words.tolist()])) if len(words) else np.zeros(0, dtype=np.int64) for words in corpus.texts]
    rows = np.repeat(np.arange(len(texts)), [len(p) for p in present])
    cols = np.concatenate(present).astype(np.int64)
    base, copy, col, sign = _counterfactuals(corpus, of_word, np.random.default_rng(seed))
    n, k, m = len(y), len(names), max(1, len(base))
    w, b = np.zeros(k), float(np.log(y.mean() / (1 - y.mean())))
    m1, m2 = np.zeros(k + 1), np.zeros(k + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        z = b + np.bincount(rows, w[cols], n)
        pull = (sigmoid(z) - y) / n
        grad = penalty / n * w
        if len(base):
            moved = np.bincount(copy, sign * w[col], len(base))
            p1, p2 = sigmoid(z[base]), sigmoid(z[base] + moved)
            change = 2 * fairness / m * (p1 - p2)
            slope1, slope2 = p1 * (1 - p1), p2 * (1 - p2)
            # A copy's score is its text's score plus the pieces it gained or lost, so it pulls on both.
            fair = np.bincount(base, change * (slope1 - slope2), n)
            grad = grad + np.bincount(cols, fair[rows], k) - np.bincount(col, sign * (change * slope2)[copy], k)
        full = np.append(grad + np.bincount(cols, pull[rows], k), pull.sum())
        m1, m2 = 0.9 * m1 + 0.1 * full, 0.999 * m2 + 0.001 * full**2
        move = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    return ToxicityModel(index, w, b)


def training_sample(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, max_chars: int = 20000) -> tuple[list[str], list[int]]:
    """About ``max_rows`` labelled texts. The ids are chosen first, so that side of the join is bounded and broadcast."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("labelled")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = hash_sample(known, F.col("labelled"), max_rows, "toxicity")
    short = docs.where(F.length("text") <= max_chars).select("doc_id", "text")
    rows = short.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).select("doc_id", "toxic", "text").distinct().collect()
    rows.sort()
    return [r.text for r in rows], [int(r.toxic > 0) for r in rows]


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t.as_py()) for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    return map_batches(docs.select("doc_id", "text"), "doc_id long, score double", run)


def learn(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """The model of labels whose crc32(doc_id) mod 5 is not 0."""
    texts, y = training_sample(docs.select("doc_id", "text"), labels.where(id_bucket("doc_id", 5) != 0))
    return train(texts, y)


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    model = learn(docs, labels)
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(names.index("text"))
        return batch.filter(pa.array([model.score(t.as_py()) < threshold for t in texts], pa.bool_()))

    return map_batches(docs, schema, run)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score of every document, learned from the labels of the training split."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    scored = score(docs, learn(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (id_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
