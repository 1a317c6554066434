"""Quality classifier from weak labels: heuristic labellers, their accuracies by EM, a hashed linear scorer."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StringType

from instqc.llm.common import bound_batches

#: Votes of a labeller.
JUNK, GOOD, ABSTAIN = "0", "1", "-"
#: About so many documents, drawn by hash, train the scorer; the bound does not grow with the corpus.
SAMPLE = 4096
#: Hashed features.
DIMENSIONS = 1024
#: Documents that score less are rejected.
THRESHOLD = 0.5
#: Words over which repetition is measured.
WINDOW = 50


@dataclass
class Measures:
    """What the labellers look at; shares are between 0 and 1."""

    words: int
    symbols: float
    capitals: float
    variety: float
    stutter: float
    copied_lines: float
    word_length: float
    bare_marks: float
    sentence: float


def _kinds() -> np.ndarray:
    """Bits per code point of the basic plane: 1 letter, 2 capital, 4 symbol."""
    chars = list(map(chr, range(0x10000)))
    out = np.array([c.isalpha() + 2 * c.isupper() for c in chars], np.uint8)
    out[list(map(ord, "!#$%&*+/<=>@\\^_`{|}~[]"))] |= 4
    return out


KINDS = _kinds()


def bare(word: str) -> bool:
    """Whether a word has neither letter nor digit."""
    return not word.isalnum() and not any(map(str.isalnum, word))


def measure(text: str) -> Measures | None:
    words = text.split()
    if not words:
        return None
    n = len(words)
    kinds = KINDS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)]
    tally = np.bincount(kinds, minlength=8)
    letters = int(tally[1] + tally[3]) or 1
    chars = sum(map(len, words))
    lines = [line for line in text.split("\n") if line.strip()]
    return Measures(
        words=n,
        symbols=int(tally[4:].sum()) / chars,
        capitals=int(tally[2] + tally[3]) / letters,
        variety=sum(len(set(words[i : i + WINDOW])) for i in range(0, n, WINDOW)) / n,
        stutter=sum(map(str.__eq__, words, words[1:])) / max(1, n - 1),
        copied_lines=1 - len(set(lines)) / len(lines) if lines else 0.0,
        word_length=chars / n,
        bare_marks=sum(bare(w) for w in words if len(w) < 4) / n,
        sentence=n / max(1, text.count(".") + text.count("?")),
    )


def _below(value: float, good: float, junk: float) -> str:
    return GOOD if value <= good else JUNK if value >= junk else ABSTAIN


#: Each looks at one side of a text; they overlap, and any may be wrong.
LABELLERS: tuple[tuple[str, Callable[[Measures], str]], ...] = (
    ("symbols", lambda m: _below(m.symbols, 0.02, 0.05)),
    ("capitals", lambda m: _below(m.capitals, 0.15, 0.35)),
    ("variety", lambda m: ABSTAIN if m.words < 20 else _below(1 - m.variety, 0.45, 0.65)),
    ("stutter", lambda m: ABSTAIN if m.words < 5 else _below(m.stutter, 0.06, 0.2)),
    ("copied lines", lambda m: _below(m.copied_lines, 0.3, 0.6)),
    ("word length", lambda m: GOOD if 3 <= m.word_length <= 9 else JUNK if m.word_length < 2 or m.word_length > 14 else ABSTAIN),
    ("bare marks", lambda m: _below(m.bare_marks, 0.05, 0.15)),
    ("sentences", lambda m: ABSTAIN if m.words < 20 else _below(m.sentence, 45, 150)),
)


def votes(text: str | None) -> str:
    """One character per labeller; all abstain on a text without words."""
    m = measure(text or "")
    return "".join(ABSTAIN if m is None else label(m) for _, label in LABELLERS)


@dataclass
class LabelModel:
    """Share of good documents, and how often each labeller that votes gives each vote to junk and to good ones."""

    prior: float
    rates: dict[str, np.ndarray]  # vote -> (2, labellers)

    def posterior(self, pattern: str) -> float:
        """Probability that a document with these votes is good; who abstains tells nothing."""
        junk, good = np.log(1 - self.prior), np.log(self.prior)
        for i, vote in enumerate(pattern):
            if vote != ABSTAIN:
                junk += np.log(self.rates[vote][0, i])
                good += np.log(self.rates[vote][1, i])
        return float(1 / (1 + np.exp(np.clip(junk - good, -700, 700))))


def fit_labels(patterns: dict[str, int], rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over counted vote patterns, of which there are at most 3 ** labellers.

    Junk shows in one way at a time, so the start takes any vote for junk as
    a sign of it; the rates then say whose votes hold. Half a count is added
    to every vote, so no rate is 0.
    """
    table = np.array([list(p) for p in patterns])
    weight = np.array(list(patterns.values()), float)
    p = np.where((table == JUNK).any(axis=1), 0.1, 0.9)
    for _ in range(rounds):
        share = np.stack([(1 - p) * weight, p * weight])
        prior = float(np.clip((share[1].sum() + 0.5) / (weight.sum() + 1), 1e-3, 1 - 1e-3))
        cast = share @ (table != ABSTAIN) + 1
        model = LabelModel(prior, {v: (share @ (table == v) + 0.5) / cast for v in (JUNK, GOOD)})
        new = np.array([model.posterior(x) for x in patterns])
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return model


#: Words of which the shape is kept at hand, per task.
SHAPES_KEPT = 50_000


class Shapes(dict):
    """Code point to the sign of its kind; there are 17 planes of 65,536 at most."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        value = self[point] = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c if c.isascii() else unicodedata.category(c)
        return value


SHAPES = Shapes()
_RUN = re.compile(r"(.)\1+")


class Slots(dict):
    """Feature number of the shape of each word seen: letter runs as A, a or Aa, digits as 9, marks as they are."""

    def __missing__(self, word: str) -> int:
        if len(self) >= SHAPES_KEPT:
            self.clear()
        shape = _RUN.sub(r"\1", word.translate(SHAPES))
        value = self[word] = xxhash.xxh3_64_intdigest(shape.encode("utf-8", "surrogatepass")) % DIMENSIONS
        return value


def features(text: str | None, slots: Slots) -> np.ndarray:
    """Shares of hashed word shapes, and hashed steps of variety, stutter, length and sentence length."""
    m = measure(text or "")
    out = np.zeros(DIMENSIONS)
    if m is None:
        return out
    words = (text or "").split()
    out += np.bincount(np.fromiter(map(slots.__getitem__, words), np.int64, len(words)), minlength=DIMENSIONS) / len(words)
    steps = {"variety": m.variety * 10, "stutter": m.stutter * 10, "copied": m.copied_lines * 10, "length": m.word_length, "sentence": np.log2(m.sentence + 1)}
    for name, value in steps.items() if m.words >= 20 else ():
        out[xxhash.xxh3_64_intdigest(f"{name} {int(value)}".encode()) % DIMENSIONS] += 1.0
    return out


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -500, 500)))


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 8.0, decay: float = 1e-5) -> Scorer:
    """Logistic regression on soft labels, by gradient descent with momentum."""
    x = x.astype(np.float32)
    scorer = Scorer(np.zeros(x.shape[1], np.float32), 0.0)
    speed, speed_b = np.zeros(x.shape[1], np.float32), 0.0
    for _ in range(rounds):
        error = ((scorer.score(x) - y) / len(y)).astype(np.float32)
        speed = 0.9 * speed - rate * (x.T @ error + decay * scorer.weights)
        speed_b = 0.9 * speed_b - rate * float(error.sum())
        scorer.weights, scorer.bias = scorer.weights + speed, scorer.bias + speed_b
    return scorer


def vote_column() -> Callable[[str], Column]:
    @F.pandas_udf(StringType())
    def column(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(votes, na_action=None)

    return column


def score_column(scorer: Scorer) -> Callable[[str], Column]:
    """Probability of being good; 0 for texts without words."""

    @F.pandas_udf(DoubleType())
    def column(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        slots = Slots()
        for texts in parts:
            out = []
            for text in texts:
                x = features(text, slots)
                out.append(float(scorer.score(x[None, :])[0]) if x.any() else 0.0)
            yield pd.Series(out, dtype="float64")

    return column


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[LabelModel, Scorer]:
    """Fit both models on ``docs`` (doc_id, text); no label column is read.

    Vote patterns are counted over all documents. The scorer learns the
    posteriors of about ``sample`` documents whose hash of id and text falls
    below a bound; their features alone are gathered.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    counted = texts.select(vote_column()("text").alias("votes")).groupBy("votes").count().collect()
    patterns = {r["votes"]: r["count"] for r in sorted(counted)}
    if not patterns:
        return LabelModel(0.5, {v: np.full((2, len(LABELLERS)), 0.5) for v in (JUNK, GOOD)}), Scorer(np.zeros(DIMENSIONS), 0.0)
    model = fit_labels(patterns)
    share = min(1.0, sample / sum(patterns.values()))
    drawn = texts.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))

    @F.pandas_udf(ArrayType(FloatType()))
    def vector(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        slots = Slots()
        for column in parts:
            yield pd.Series([features(t, slots).astype(np.float32) for t in column])

    rows = drawn.select(vote_column()("text").alias("votes"), vector("text").alias("x"), F.xxhash64("doc_id", "text").alias("h")).toPandas().sort_values("h")
    if not len(rows):
        return model, Scorer(np.zeros(DIMENSIONS), 0.0)
    return model, fit_scorer(np.stack(rows.x), rows.votes.map(model.posterior).to_numpy())


def quality_report(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, votes, posterior (of the votes), score and kept of every document.

    Null and empty texts draw no votes, score 0 and are not kept. Repeated
    rows score alike. An empty table gives no rows.
    """
    model, scorer = fit(docs, sample)

    @F.pandas_udf(DoubleType())
    def posterior(patterns: pd.Series) -> pd.Series:
        known = {p: model.posterior(p) for p in patterns.unique()}
        return patterns.map(known).astype("float64")

    scored = docs.select("doc_id", vote_column()("text").alias("votes"), score_column(scorer)("text").alias("score"))
    return scored.select("doc_id", "votes", posterior("votes").alias("posterior"), "score", (F.col("score") >= THRESHOLD).alias("kept"))


def keep_good(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that the scorer does not reject, columns as given."""
    _, scorer = fit(docs, sample)
    return docs.filter(score_column(scorer)("text") >= THRESHOLD)
