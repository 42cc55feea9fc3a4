"""Toxicity by a classifier chain.

Categories are predicted one after the other, each by a logistic regression over lexical features and the probabilities
of the categories before it. While training, these probabilities are out of fold: they come from models that have not
seen the document, so that later links of the chain learn from predictions as uncertain as those they will meet.

Labels know only toxic or not. The first categories are kinds of toxic documents, found among those of the sample: groups
of documents with like words, whichever these are, by k-means on sketches of all their words. The last category is
toxic itself.

The chain is fitted on a bounded sample of labelled documents (``PER_CLASS`` of each class, those with the smallest
hashes of their ids; whole texts) and then applied to all. Features are words and word beginnings (once, twice or four
times in different words) whose occurrence in sampled documents depends on the label toxic, by a chi-square test, at most
``MAX_FEATURES``. No word is given beforehand. Scoring is a map over rows: it looks up the different words of a text,
remembers nothing but recent words, and needs no shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelry.llm.shared import written

PER_CLASS = 4000
MAX_FEATURES = 1024
FOLDS = 4
THRESHOLD = 0.5
PREFIXES = (4, 5, 6, 7)
#: A feature counts the different words of a text that have it; an indicator says whether there are so many.
LEVELS = (1, 2, 4)
LEAST_CHI_SQUARE = 15.0
LEAST_DOCUMENTS = 3
CACHE_WORDS = 50_000

#: Kinds of toxic documents, and the length of the sketches they are found by.
KINDS = 3
SKETCH = 128
CATEGORIES = [*(f"kind_{k + 1}" for k in range(KINDS)), "toxic"]

_WORDS = re.compile(r"[^\W_]+")


def features_of(word: str) -> list[str]:
    """A word and its beginnings, as feature names."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


def indicator(feature: str, level: int) -> str:
    return feature if level == 1 else f"{feature}{level}"


class Indicators:
    """Finds the chosen indicators in sets of words; remembers the features of recent words."""

    def __init__(self, chosen: list[str]):
        self.place = {f: i for i, f in enumerate(chosen)}
        self.features = {f.rstrip("0123456789") if "*" in f else f for f in chosen}
        self.known: dict[str, tuple[str, ...]] = {}

    def of(self, words) -> list[int]:
        counts: dict[str, int] = {}
        known = self.known
        for word in words:
            found = known.get(word)
            if found is None:
                if len(known) > CACHE_WORDS:
                    known.clear()
                found = known[word] = tuple(f for f in features_of(word) if f in self.features)
            for f in found:
                counts[f] = counts.get(f, 0) + 1
        return sorted(self.place[i] for f, n in counts.items() for level in LEVELS if n >= level and (i := indicator(f, level)) in self.place)


def words_of(text: str | None) -> set[str]:
    return set(_WORDS.findall(text.lower())) if isinstance(text, str) else set()


@dataclass
class Chain:
    """Feature names, and for each category its weights (features, earlier probabilities, intercept)."""

    features: list[str]
    categories: list[str]
    weights: list[np.ndarray]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (rows, categories) for indicators x (rows, features); each category sees those before it."""
        out = np.zeros((len(x), len(self.categories)))
        for k, w in enumerate(self.weights):
            out[:, k] = _sigmoid(_with(x, out[:, :k]) @ w)
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def _with(x: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    return np.hstack([x, earlier, np.ones((len(x), 1))])


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.1, steps: int = 300) -> np.ndarray:
    """Weights of a logistic regression; the last column of x is the intercept and is not shrunk. Accelerated gradient steps."""
    n, d = x.shape
    if not n or y.min() == y.max():  # one class only: a constant
        w = np.zeros(d)
        w[-1] = -30.0 if not n or y[0] < 0.5 else 30.0
        return w
    shrink = np.full(d, l2 / n)
    shrink[-1] = 0.0
    v = np.ones(d)
    for _ in range(20):  # the largest curvature, for the step
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) or 1.0
    step = 1.0 / (0.25 * float(np.linalg.norm(x @ v) ** 2) / n + l2 / n)
    w = ahead = np.zeros(d)
    t = 1.0
    for _ in range(steps):
        gradient = x.T @ (_sigmoid(x @ ahead) - y) / n + shrink * ahead
        new = ahead - step * gradient
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w


def fit_chain(x: np.ndarray, y: np.ndarray, folds: np.ndarray, features: list[str], categories: list[str]) -> Chain:
    """Fits the chain on indicators x and labels y (rows, categories); ``folds`` numbers the fold of each row."""
    outside = np.zeros((len(x), len(categories)))
    weights = []
    for k in range(len(categories)):
        inputs = _with(x, outside[:, :k])
        for fold in np.unique(folds):
            held = folds == fold
            outside[held, k] = _sigmoid(inputs[held] @ fit_logistic(inputs[~held], y[~held, k]))
        weights.append(fit_logistic(inputs, y[:, k]))
    return Chain(features, categories, weights)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS) -> DataFrame:
    """At most ``per_class`` labelled documents of each class with their different words: ``doc_id, y, words``."""
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    ids = known.where("y = 1").orderBy(*by_hash).limit(per_class).unionByName(known.where("y = 0").orderBy(*by_hash).limit(per_class))
    # at most 2 * per_class rows of two numbers: small enough to be sent to every task
    sampled = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(words_of(t)))

    return sampled.select("doc_id", "y", words("text").alias("words"))


def select_features(sample: DataFrame, limit: int = MAX_FEATURES) -> list[str]:
    """Features of the sample that depend on the label, those of the largest chi-square first."""
    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return []
    beginnings = [F.when(F.char_length("w") >= n, F.concat(F.substring("w", 1, n), F.lit("*"))) for n in PREFIXES]
    words = sample.select("doc_id", "y", F.explode("words").alias("w"))
    names = words.select("doc_id", "y", F.explode(F.array(F.col("w"), *beginnings)).alias("name")).where("name is not null").groupBy("doc_id", "y", "name").agg(F.count(F.lit(1)).alias("n"))
    levels = [F.when(F.col("n") >= k, F.col("name") if k == 1 else F.concat("name", F.lit(str(k)))) for k in LEVELS]
    names = names.select("y", F.explode(F.array(*levels)).alias("feature")).where("feature is not null")
    counts = names.groupBy("feature").agg(F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b"))
    a, b, n = F.col("a"), F.col("b"), n1 + n0
    chi = n * F.pow(a * (n0 - b) - b * (n1 - a), F.lit(2)) / ((a + b) * (F.lit(float(n)) - a - b + 1e-9) * n1 * n0)
    chosen = counts.where(a + b >= LEAST_DOCUMENTS).withColumn("chi", chi).where(F.col("chi") >= LEAST_CHI_SQUARE)
    return [r["feature"] for r in chosen.orderBy(F.desc("chi"), "feature").limit(limit).select("feature").collect()]


def sketch(words) -> np.ndarray:
    """The different words of a document as counts with signs, by their checksums; of length one."""
    hashes = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.int64)
    out = np.bincount(hashes >> 1 & SKETCH - 1, np.where(hashes & 1, 1.0, -1.0), minlength=SKETCH)
    return out / (np.linalg.norm(out) or 1.0)


def kinds_of(sketches: np.ndarray, kinds: int = KINDS, rounds: int = 25) -> np.ndarray:
    """Groups of alike rows by k-means; the first centres are rows far apart. With fewer different rows some groups stay empty."""
    if not len(sketches):
        return np.zeros(0, dtype=int)
    centres = [sketches[((sketches - sketches.mean(axis=0)) ** 2).sum(axis=1).argmin()]]
    while len(centres) < kinds:
        far = np.min([((sketches - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(sketches[far.argmax()])
    centres = np.array(centres)
    for _ in range(rounds):
        own = np.array([((sketches - c) ** 2).sum(axis=1) for c in centres]).argmin(axis=0)
        centres = np.array([sketches[own == k].mean(axis=0) if (own == k).any() else centres[k] for k in range(kinds)])
    return own


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Chain:
    """The chain over CATEGORIES from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    A document labelled several times is toxic if one of its labels says so; rows without id or label are not used.
    Without labelled documents of both classes the chain gives probabilities near zero, or near one where all are toxic.
    """
    sample = written(labelled_sample(docs, labels, "toxic", per_class), "sample")
    features = select_features(sample)

    @F.pandas_udf("struct<found: array<int>, sketch: array<float>>")
    def encoded(words: pd.Series) -> pd.DataFrame:
        indicators = Indicators(features)
        return pd.DataFrame({"found": [indicators.of(ws) for ws in words], "sketch": [sketch(ws) for ws in words]})

    # at most 2 * per_class rows
    rows = sample.select("y", F.xxhash64("doc_id").alias("h"), encoded("words").alias("e")).select("y", "h", "e.found", "e.sketch").collect()
    rows.sort(key=lambda r: (r["h"], r["found"], r["sketch"]))
    x, y = np.zeros((len(rows), len(features))), np.zeros((len(rows), len(CATEGORIES)))
    for i, r in enumerate(rows):
        x[i, r["found"]] = 1.0
    toxic = [i for i, r in enumerate(rows) if r["y"]]
    y[toxic, -1] = 1.0
    y[toxic, kinds_of(np.array([rows[i]["sketch"] for i in toxic]))] = 1.0
    return fit_chain(x, y, np.array([r["h"] % FOLDS for r in rows], dtype=int), features, CATEGORIES)


class Scorer:
    """Scores texts in a worker."""

    def __init__(self, chain: Chain):
        self.chain, self.indicators = chain, Indicators(chain.features)

    def rows(self, texts) -> np.ndarray:
        x = np.zeros((len(texts), len(self.chain.features)))
        for i, text in enumerate(texts):
            x[i, self.indicators.of(words_of(text))] = 1.0
        return x

    def score(self, texts) -> np.ndarray:
        return np.vstack([self.chain.probabilities(self.rows(texts[i : i + 512])) for i in range(0, len(texts), 512)] or [np.zeros((0, len(self.chain.categories)))])


def score_toxicity(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD, into: str = "toxicity") -> DataFrame:
    """Adds the column ``into``: a struct of ``p_<category>`` (DOUBLE) and ``is_toxic``, from the whole text.

    Null and empty texts have no features and are scored by the intercepts; they are never toxic. All other columns stay,
    but one named ``into`` is replaced. Rows are scored one by one, equal texts alike.
    """
    kind = T.StructType([T.StructField(f"p_{c}", T.DoubleType()) for c in chain.categories] + [T.StructField("is_toxic", T.BooleanType())])

    @F.pandas_udf(kind)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(chain)
        for texts in batches:
            p = scorer.score(texts.tolist())
            filled = texts.map(lambda t: isinstance(t, str) and bool(t.strip())).to_numpy(dtype=bool)
            out = pd.DataFrame(p, columns=[f"p_{c}" for c in chain.categories])
            out["is_toxic"] = (p[:, -1] >= threshold) & filled
            yield out

    return docs.withColumn(into, score("text"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not toxic by a chain fitted on them and ``labels``; same columns."""
    scored = score_toxicity(docs.select(F.struct("*").alias("row"), "text"), fit_toxicity(docs, labels), into="verdict")
    return scored.where("not verdict.is_toxic").select("row.*")


def read_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
