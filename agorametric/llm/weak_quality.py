"""Operator 8: a quality classifier from weak labels.

Heuristic labellers each speak up for good or for bad documents or abstain. Their votes are counted by pattern over all
documents (2 to the number of labellers patterns at most), and expectation-maximisation on these counts estimates the
share of good documents and how often each labeller is right and wrong. Each pattern's posterior labels its documents. A
logistic scorer over hashed word shapes, short words and repetitions is fitted to the posteriors of a sample of about
`TRAIN_ROWS` documents, of `TRAIN_ENTRIES` features at most, and scores all of them. The sample is drawn and ordered by a
hash of id and text, so the model depends on the documents alone and not on the order in which tasks finish.

Results for odd input: a text without words gets no vote, scores zero and is rejected; texts of any length are read
whole; repeated rows get the same score and count once in the sample; an empty table gives an empty table. Rows without an id
take part like others. Only the id column passes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorametric.llm.common import per_batch, stored

GOOD, BAD = 1, 0

# Documents, about, that the scorer is fitted to, their features at most (16 bytes each), and its hash buckets.
TRAIN_ROWS = 4000
TRAIN_ENTRIES = 1 << 23
BUCKETS = 1 << 13
# Words that are added to each text without a feature: the shortest texts keep close to the bias.
SMOOTH = 10
KEEP_FROM = 0.5

# Frequent words of the corpus languages.
FREQUENT = frozenset(
    "a and are as at be by for from in is it of on or that the this to was with "
    "auf aus das den der die ein eine für im in ist mit nicht sich und von zu "
    "au avec dans de des du elle en est et la le les par pour que qui sur un une "
    "con de del el en es la las los para por que se un una y".split()
)
_SIGNS = re.compile(r"[^\w\s.,;:!?'’()\"-]")
_STOPS = re.compile(r"[.!?]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_TAGGED = re.compile(r"[^\w\s.,;:!?'’()\"-](?=\s|$)")


@dataclass(frozen=True)
class Facts:
    """Shares that the labellers judge."""

    words: int
    signs: float
    tagged: float
    letters: float
    capitals: float
    repeats: float
    distinct: float
    per_stop: float
    frequent: float


def facts(text: str, words: list[str]) -> Facts:
    count, size = max(1, len(words)), max(1, len(text))
    letters = sum(map(len, _LETTERS.findall(text)))
    return Facts(
        words=len(words),
        signs=len(_SIGNS.findall(text)) / size,
        tagged=len(_TAGGED.findall(text)) / count,
        letters=letters / size,
        capitals=len(_CAPITALS.findall(text)) / max(1, letters),
        repeats=sum(map(eq, words, words[1:])) / count,
        distinct=len(set(words)) / count,
        per_stop=count / max(1, len(_STOPS.findall(text))),
        frequent=sum(map(FREQUENT.__contains__, text.lower().split())) / count,
    )


# By name: whether a labeller that speaks up calls a document good or bad, and when it does; otherwise it abstains.
LABELLERS = {
    "signs": (BAD, lambda seen: seen.signs >= 0.03),
    "tagged": (BAD, lambda seen: seen.tagged >= 0.2),
    "letters": (BAD, lambda seen: seen.words >= 6 and seen.letters < 0.7),
    "capitals": (BAD, lambda seen: seen.capitals >= 0.6),
    "shouting": (BAD, lambda seen: seen.words >= 6 and seen.per_stop <= 1.7),
    "repeats": (BAD, lambda seen: seen.repeats >= 0.25),
    "poor": (BAD, lambda seen: seen.words >= 20 and seen.distinct <= 0.15),
    "frequent": (GOOD, lambda seen: 0.05 <= seen.frequent <= 0.75),
    "sentences": (GOOD, lambda seen: (seen.words < 6 or seen.per_stop >= 2) and seen.per_stop <= 45),
    "varied": (GOOD, lambda seen: seen.distinct >= 0.15 and seen.repeats <= 0.05),
}


def votes(text: str, words: list[str]) -> str:
    """One sign per labeller: + for good, - for bad or a blank."""
    if not words:
        return " " * len(LABELLERS)
    seen = facts(text, words)
    return "".join("-+"[kind] if speaks(seen) else " " for kind, speaks in LABELLERS.values())


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents; per labeller the chance that it speaks up on a bad and on a good one."""

    good: float
    chances: np.ndarray
    posterior: dict[str, float]

    def accuracy(self) -> dict[str, float]:
        """Per labeller: the chance that it is right where it speaks up."""
        spoken = self.chances * [1 - self.good, self.good]
        right = [row[kind] / row.sum() for row, (kind, _) in zip(spoken, LABELLERS.values())]
        return dict(zip(LABELLERS, map(float, right)))


# Where the estimate starts, and how many documents that start counts for: the share of good documents, and how often a
# labeller speaks up on documents of its own and of the other kind, for those that find bad and those that find good.
GOOD_SHARE = 0.85
SPEAKS_UP = {BAD: (0.3, 0.005), GOOD: (0.9, 0.6)}
START_WEIGHT = 10


def fit_labels(patterns: dict[str, int], rounds: int = 50) -> LabelModel:
    """Expectation-maximisation over the counts of vote patterns."""
    names = sorted(name for name in patterns if name.strip())
    counts = np.array([patterns[name] for name in names], float)
    spoken = np.array([[sign != " " for sign in name] for name in names], float).reshape(-1, len(LABELLERS))
    start = np.array([SPEAKS_UP[kind][:: 1 if kind == BAD else -1] for kind, _ in LABELLERS.values()])
    good, chances, share = GOOD_SHARE, start, np.zeros(len(names))
    for _ in range(rounds):
        logs = spoken @ np.log(chances) + (1 - spoken) @ np.log(1 - chances) + np.log([1 - good, good])
        share = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        weight = np.stack([1 - share, share], axis=1) * counts[:, None]
        total = weight.sum(axis=0)
        good = float((total[1] + GOOD_SHARE * START_WEIGHT) / (total.sum() + START_WEIGHT))
        chances = (spoken.T @ weight + start * START_WEIGHT) / (total + START_WEIGHT)
    return LabelModel(good, chances, dict(zip(names, share.tolist())))


def _bucket(kind: str, text: str) -> int:
    return crc32(f"{kind}{text}".encode()) % BUCKETS


_SMALL, _LARGE, _DIGIT = re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+")
_SAME = _bucket("repeat", "")


def word_buckets(word: str) -> tuple[int, int]:
    """Hash buckets of a word's shape and of the word itself, if short."""
    shape = _DIGIT.sub("0", _LARGE.sub(lambda run: "A" * min(2, len(run[0])), _SMALL.sub("a", word)))
    return _bucket("shape", shape[:12]), _bucket("word", word[:5] if len(word) <= 5 else "")


class Features:
    """Hash buckets of texts; a bounded memory of words."""

    def __init__(self, weights: np.ndarray | None = None) -> None:
        self.weights = weights
        self._kept: dict[str, object] = {}

    def _known(self, word: str):
        found = self._kept.get(word)
        if found is None:
            if len(self._kept) > 200_000:
                self._kept.clear()
            found = word_buckets(word)
            if self.weights is not None:
                found = float(self.weights[found[0]] + self.weights[found[1]])
            if len(word) <= 48:
                self._kept[word] = found
        return found

    def shares(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pairs = np.array([self._known(word) for word in words], np.int64).reshape(-1)
        buckets, counts = np.unique(np.append(pairs, np.full(sum(map(eq, words, words[1:])), _SAME)), return_counts=True)
        return buckets, counts / (len(words) + SMOOTH)

    def score(self, words: list[str]) -> float:
        """The smoothed mean weight of the words' buckets."""
        known, kept = self._known, self._kept.get
        found = list(map(kept, words))
        if None in found:
            found = [known(word) if value is None else value for word, value in zip(words, found)]
        repeated = sum(map(eq, words, words[1:])) * float(self.weights[_SAME])
        return (sum(found) + repeated) / (len(words) + SMOOTH)


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-5):
    """Logistic regression by adaptive gradient steps over sparse rows; weights and bias."""
    weights, bias = np.zeros(BUCKETS), 0.0
    if not rows:
        return weights, bias
    sizes = np.array([len(buckets) for buckets, _ in rows])
    at = np.repeat(np.arange(len(rows)), sizes)
    buckets = np.concatenate([buckets for buckets, _ in rows])
    values = np.concatenate([values for _, values in rows])
    seen, seen_bias = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(rounds):
        margin = np.bincount(at, values * weights[buckets], len(rows)) + bias
        error = 1 / (1 + np.exp(-np.clip(margin, -500, 500))) - targets
        step = np.bincount(buckets, values * error[at], BUCKETS) / len(rows) + decay * weights
        seen += step**2
        weights -= rate * step / np.sqrt(seen)
        slope = float(error.mean())
        seen_bias += slope**2
        bias -= rate * slope / seen_bias**0.5
    return weights, bias


@dataclass(frozen=True)
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    bias: float


def _rows(documents: DataFrame, text: str, id: str) -> DataFrame:
    return documents.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))


def fit(documents: DataFrame, text: str = "text", id: str = "doc_id", train_rows: int = TRAIN_ROWS) -> QualityModel:
    """The label model from all documents; the scorer from about `train_rows` of them, drawn by a hash of the row."""
    voted = _rows(documents, text, id).select(F.xxhash64("doc_id", "text").alias("row"), "text")

    def vote(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        shown = [votes(text or "", (text or "").split()) for text in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(shown, pa.string())], names=["votes"])

    counted = per_batch(voted.select("text"), "votes string", vote).groupBy("votes").count()
    patterns = {row["votes"]: row["count"] for row in counted.collect()}
    labels = fit_labels(patterns)
    taken = _sample(voted, sum(patterns.values()), train_rows)
    targets = np.array([labels.posterior.get(row["votes"], 0.0) for row in taken])
    weights, bias = fit_scorer([(np.array(row["buckets"], np.int64), np.array(row["shares"])) for row in taken], targets)
    return QualityModel(labels, weights, bias)


_DRAWS = 1 << 30
_SAMPLE = pa.schema(
    [("row", pa.int64()), ("votes", pa.string()), ("buckets", pa.list_(pa.int64())), ("shares", pa.list_(pa.float64()))]
)


def _sample(rows: DataFrame, total: int, train_rows: int) -> list:
    """Votes and features of about `train_rows` different rows, in the order of their hashes.

    Where repeated rows leave fewer than half of them, more are drawn.
    """

    def look(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        features, found = Features(), []
        for row, text in dict(zip(*(column.to_pylist() for column in batch.columns))).items():
            words = (text or "").split()
            buckets, shares = features.shares(words)
            found.append({"row": row, "votes": votes(text or "", words), "buckets": buckets, "shares": shares})
        yield pa.RecordBatch.from_pylist(found, _SAMPLE)

    kinds = "row long, votes string, buckets array<long>, shares array<double>"
    most = min(_DRAWS, int(_DRAWS * train_rows / max(1, total)) + 1)
    while True:
        drawn = rows.where(F.pmod("row", F.lit(_DRAWS)) < most)
        sample = stored(per_batch(drawn, kinds, look).dropDuplicates(["row"]), "sample")
        sizes = sample.select("row", F.size("buckets").alias("size")).orderBy("row").limit(2 * train_rows).collect()
        if most == _DRAWS or 2 * len(sizes) >= train_rows:
            break
        most = min(_DRAWS, 4 * most)
    upto = np.cumsum([row["size"] for row in sizes])
    within = int(np.searchsorted(upto, TRAIN_ENTRIES, "right"))
    if not within:
        return []
    return sorted(sample.where(F.col("row") <= sizes[within - 1]["row"]).collect(), key=lambda row: row["row"])


def score(documents: DataFrame, model: QualityModel, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per document doc_id, votes, posterior (of its votes), score and is_kept. One narrow pass."""
    rows = _rows(documents, text, id)
    kind = rows.schema["doc_id"].dataType.simpleString()
    weights, bias, posterior = model.weights, model.bias, model.labels.posterior
    features: list[Features] = []

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not features:
            features.append(Features(weights))
        shown, shares, scores = [], [], []
        for data in batch.column(1).to_pylist():
            words = (data or "").split()
            shown.append(votes(data or "", words))
            shares.append(posterior.get(shown[-1]) if words else 0.0)
            scores.append(1 / (1 + np.exp(-np.clip(features[0].score(words) + bias, -500, 500))) if words else 0.0)
        scores = pa.array(scores, pa.float64())
        kept = pa.array([value >= KEEP_FROM for value in scores.to_pylist()], pa.bool_())
        columns = [batch.column(0), pa.array(shown, pa.string()), pa.array(shares, pa.float64()), scores, kept]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "votes", "posterior", "score", "is_kept"])

    return per_batch(rows, f"doc_id {kind}, votes string, posterior double, score double, is_kept boolean", run)


def keep_good(documents: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """The documents that the scorer accepts, with their columns. One narrow pass over the texts."""
    from pyspark.sql.pandas.functions import arrow_udf

    weights, bias = model.weights, model.bias
    features: list[Features] = []

    @arrow_udf("boolean")
    def accepted(texts: pa.Array) -> pa.Array:
        if not features:
            features.append(Features(weights))
        split = [(text or "").split() for text in texts.to_pylist()]
        level = np.log(KEEP_FROM / (1 - KEEP_FROM))
        return pa.array([bool(words) and features[0].score(words) + bias >= level for words in split], pa.bool_())

    return documents.where(accepted(F.col(text).cast("string")))
