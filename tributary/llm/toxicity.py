"""Toxicity with class-conditional Kneser-Ney models.

Two bigram models, one of toxic and one of ordinary texts. Counts are continuation counts: in how
many texts an expression (a word, or two words in a row) was met. At the word level each class
discounts its own counts and backs off to one shared distribution, the word counts of all
documents, labelled or not, with a floor under rare words. Two-word expressions are discounted and
backed off in the same way, to what the word level and both classes together lead to expect. An
expression keeps class counts only where the two classes then differ by a factor of ``RATIO`` or
more; for all others, above all the rare ones, both classes take the shared backoff, so that
neither chance nor the language of a text moves the comparison.

Texts are weighted so that both classes weigh the same, in the counts and in the curve, whatever
their shares among the labelled rows are: the ratio of the classes is 1:1 at every size.

The feature of a text is the difference of the two log-likelihoods over the square root of its
number of words (the spread of such a sum grows with that root, so texts of any length compare),
and a logistic curve fitted on rows that the counts have not seen turns it into a score.

Sizes: the shared counts are kept by word in a DataFrame and cover every document. The class counts
come from at most ``FIT_ROWS`` labelled rows of each class (a bounded sample, chosen by a hash of
the id). Levels are computed in DataFrames, with exact shared counts; only the expressions on which
the classes differ come to the driver and go to the executors.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm.texts import blocks, whole
from tributary.scratch import Scratch

#: At most so many labelled rows of each class are fitted, three quarters for counts, the rest for the curve.
FIT_ROWS = 8_000
DISCOUNT = 0.75
#: Weight of the shared distribution, as a share of a class's own counts.
STRENGTH = 0.05
#: Floor under shared counts, as a share of the fitted texts, and in texts of the smaller class at
#: least: what so few texts show is chance at any size.
FLOOR = 0.0045
LEAST_FLOOR = 8.0
#: Two-word expressions met in a smaller share of the fitted texts, or in fewer texts of the smaller
#: class, have no counts of their own.
MIN_SHARE, LEAST_SHARED = 1 / 600, 4.0
RATIO = 10.0

_WORD = re.compile(r"[^\W\d_]+")
#: Words that a counting task holds before it hands their counts on.
_HELD = 100_000


def words(text: str) -> list[str]:
    """The lower-case words of a whole text."""
    return _WORD.findall(text.lower())


def held_out(id_col: str) -> Column:
    """Rows that nothing is learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def _corpus_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``word, n`` over the words of all documents, added up within a task first."""

    def counted(total: Counter[str]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for run in blocks((t.as_py() for t in batch.column(0)), 1 << 18):
                for text in run:
                    total.update(words(text))
                if len(total) > _HELD:
                    yield counted(total)
                    total = Counter()
        yield counted(total)

    return docs.select(whole(text_col).alias("t")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _expressions(texts: DataFrame) -> DataFrame:
    """``first, word, toxic_n, ordinary_n``: texts of each class with a word (``first = ''``) or two words in a row."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for toxic, rows in batch.groupby("toxic"):
                for run in blocks(rows["text"], 1 << 18):
                    met: Counter[tuple[str, str]] = Counter()
                    for w in map(words, run):
                        met.update({("", x) for x in w})
                        met.update(set(zip(w, w[1:], strict=False)))
                    if met:
                        first, word = zip(*met, strict=True)
                        yield pd.DataFrame({"toxic": int(toxic), "first": first, "word": word, "n": list(met.values())})

    counted = texts.mapInPandas(count, "toxic int, first string, word string, n long")
    of = lambda c: F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0))
    return counted.groupBy("first", "word").agg(of(1).alias("toxic_n"), of(0).alias("ordinary_n"))


@dataclass
class ClassModel:
    """One class: what words and two-word expressions add to the log-probability of the shared distribution."""

    word: np.ndarray  # by place; 0 at place 0
    gain: np.ndarray  # in the order of the model's expressions


@dataclass
class ToxicityModel:
    toxic: ClassModel
    ordinary: ClassModel
    places: dict[str, int]  # of the words that count, from 1; all others have place 0
    expressions: np.ndarray  # place of the first word * (len(places) + 1) + place of the second, sorted
    slope: float = 1.0
    offset: float = 0.0

    def log_likelihoods(self, text: str) -> tuple[float, float, int]:
        """Of the toxic and of the ordinary class, over that of the shared distribution, and the number of words."""
        found = words(text)
        w = np.fromiter((self.places.get(x, 0) for x in found), dtype=np.int64, count=len(found))
        ends = [c.word[w].sum() for c in (self.toxic, self.ordinary)]
        if len(self.expressions) and len(w) > 1:
            key = w[:-1] * (len(self.places) + 1) + w[1:]
            at = np.minimum(np.searchsorted(self.expressions, key), len(self.expressions) - 1)
            at = at[self.expressions[at] == key]
            ends = [e + c.gain[at].sum() for e, c in zip(ends, (self.toxic, self.ordinary), strict=True)]
        return float(ends[0]), float(ends[1]), len(w)

    def feature(self, text: str) -> float:
        """Length-normalised difference of the log-likelihoods; 0 for a text without words."""
        toxic, ordinary, n = self.log_likelihoods(text)
        return (toxic - ordinary) / n**0.5 if n else 0.0

    def score(self, text: str) -> float:
        z = self.offset + self.slope * self.feature(text)
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))


def _levels(counts: dict[str, Column], expected: dict[str, Column], weight: dict[str, float]) -> list[Column]:
    """By class (named as the counts, with ``_gain``): log of discounted, weighted and interpolated counts over expected ones.

    0 where the classes hardly differ.
    """
    out = {}
    for c, n in counts.items():
        met = F.lit(weight[c]) * F.greatest(n - DISCOUNT, F.lit(0.0))
        out[c] = F.log((met + STRENGTH * expected[c]) / ((1 + STRENGTH) * expected[c]))
    apart = F.abs(out["toxic_n"] - out["ordinary_n"]) >= float(np.log(RATIO))
    return [F.when(apart, x).otherwise(0.0).alias(f"{c}_gain") for c, x in out.items()]


def _models(expressions: DataFrame, corpus: DataFrame, sizes: dict[str, float]) -> ToxicityModel:
    """``corpus``: ``word, n`` of all documents; ``sizes``: fitted texts of each class, not 0. Both are stored tables.

    Levels are computed in Spark; the driver gets the expressions on which the classes differ.
    """
    texts = sum(sizes.values())
    weigh = {c: texts / 2 / n for c, n in sizes.items()}
    floor = max(LEAST_FLOOR * max(weigh.values()), FLOOR * texts)
    least = max(LEAST_SHARED * max(weigh.values()), MIN_SHARE * texts)
    counts = {c: F.col(c) for c in sizes}
    single, pairs = expressions.filter("first = ''"), expressions.filter("first != ''")
    met = single.join(corpus, "word", "left_semi").agg(*(F.sum(c).alias(c) for c in sizes)).first()
    total = {c: max(weigh[c] * (met[c] or 0), 1.0) for c in sizes}
    share = {c: t / sum(total.values()) for c, t in total.items()}
    shared = F.col("n") / float(corpus.agg(F.sum("n")).first()[0] or 1)
    spread = shared * sum(total.values()) + floor
    word = single.join(corpus, "word").select("word", *_levels(counts, {c: share[c] * spread for c in sizes}, weigh))

    frequent = pairs.filter(sum(counts[c] * weigh[c] for c in sizes) >= least)
    weight = {c: share[c] * F.exp(f"{c}_gain") for c in sizes}
    lead = {c: w / F.greatest(sum(weight.values()), F.lit(1e-12)) for c, w in weight.items()}
    both = sum(weigh[c] * counts[c] for c in sizes)
    two = frequent.join(word, "word").select("first", "word", *_levels(counts, {c: lead[c] * (both + floor) for c in sizes}, weigh))
    differ = "toxic_n_gain != ordinary_n_gain"
    words_, two_ = word.filter(differ).toPandas(), two.filter(differ).toPandas()
    places = {w: i for i, w in enumerate(sorted({*words_["word"], *two_["first"], *two_["word"]}), 1)}
    keys = (two_["first"].map(places) * (len(places) + 1) + two_["word"].map(places)).to_numpy(dtype=np.int64)
    order = np.argsort(keys)

    def model(c: str) -> ClassModel:
        gains = np.zeros(len(places) + 1)
        gains[words_["word"].map(places).to_numpy(dtype=np.int64)] = words_[f"{c}_gain"]
        return ClassModel(gains, two_[f"{c}_gain"].to_numpy(dtype=float)[order])

    return ToxicityModel(model("toxic_n"), model("ordinary_n"), places, keys[order])


def _sample(rows: DataFrame) -> DataFrame:
    """Labelled rows, at most about ``FIT_ROWS`` of each class, by a hash of the id."""
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return rows.limit(0)
    place = F.pmod(F.xxhash64(F.col("id")), F.lit(1 << 20))
    share = F.when(F.col("toxic") == 1, F.lit(FIT_ROWS / sizes[1])).otherwise(F.lit(FIT_ROWS / sizes[0]))
    return rows.filter(place < share * (1 << 20)).withColumn("part", F.pmod(F.xxhash64(F.col("id"), F.lit(7)), F.lit(4)))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over classes of equal weight, by Newton's method with a small ridge."""
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    scale = max(x.std(), 1e-9)
    a = np.column_stack([np.ones(len(x)), (x - x.mean()) / scale])
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        grad = a.T @ (weight * (y - p)) - 1e-4 * b
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-4 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[1] / scale), float(b[0] - b[1] * x.mean() / scale)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel | None:
    """The model learned from labelled rows that are not held out; None when they are too few to tell the classes apart.

    Labels other than 0 and 1 and null ids are passed over; an id labelled twice counts as toxic if
    any of its labels is. A document that occurs more than once is learned as often as it occurs.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    picked = _sample(known.filter(~held_out("id")))
    if "part" not in picked.columns:
        return None
    texts = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.save(texts.join(F.broadcast(picked), "id").select("toxic", "part", "text"), "rows")  # at most about 2 * FIT_ROWS labels
    try:
        sizes = {r["toxic"]: r["n"] for r in rows.filter("part > 0").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        if len(sizes) < 2:
            return None
        met = scratch.save(_expressions(rows.filter("part > 0").select("toxic", "text")), "expressions")
        corpus = scratch.save(_corpus_counts(docs, text_col), "corpus")
        model = _models(met, corpus, {"toxic_n": sizes[1], "ordinary_n": sizes[0]})
        sent = docs.sparkSession.sparkContext.broadcast(model)
        feature = F.pandas_udf(lambda t: pd.Series([sent.value.feature(x) for x in t], dtype="float64"), T.DoubleType())
        points = rows.filter("part = 0").select("toxic", feature("text").alias("x")).toPandas()
    finally:
        scratch.close()
    if points["toxic"].nunique() < 2 or points["x"].nunique() < 2:
        return None
    model.slope, model.offset = _fit_curve(points["x"].to_numpy(), points["toxic"].to_numpy(dtype=float))
    return model


def score_column(spark: SparkSession, model: ToxicityModel | None, text_col: str = "text") -> Column:
    """A column with the score of each whole text; 0.5 everywhere without a model."""
    if model is None:
        return F.lit(0.5)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([sent.value.score(t or "") for t in texts], dtype="float64")

    return score(whole(text_col))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted`` of each row.

    Null and empty texts, and texts without words, get the score of an even comparison. Repeated
    rows stay, null ids count as held out. Without a model (:func:`fit`) all scores are 0.5.
    """
    score = score_column(docs.sparkSession, fit(docs, labels, id_col, text_col), text_col)
    return docs.select(
        F.col(id_col), F.coalesce(held_out(id_col), F.lit(True)).alias("held_out"), score.alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
