"""Toxicity by class-conditional Kneser-Ney models.

A bigram model of words for toxic and one for ordinary texts. For class c

    p_c(w | u) = B max(n_c(u, w) - D_c, 0) / (n_c(u) + S) + (1 - B + B (f_c(u) + S) / (n_c(u) + S)) q_c(w)
    q_c(w)     = A max(k_c(w) - E_c, 0) / k_c + (1 - A + A l_c) s(w)

n_c(u, w) is the number of the class's documents that hold the bigram, n_c(u) its
sum over w, k_c(w) the number of distinct words before w in the class. D_c and E_c
are the discounts that counts of counts give, n1 / (n1 + 2 n2), between 0 and 1;
f_c(u) and l_c are the mass they free. s is the backoff that both classes share:
the part of their continuation counts that both have, with a rest spread evenly
over all words. A and B are the weights of what is the class's own and S is as many
imagined occurrences of the backoff, so a rare expression says next to nothing, a
word that one class uses after many words says a lot, and so does a phrase that
only one class has, in many of its documents. No count is too small to be used.

A text's ratio is the difference of both log-likelihoods over its distinct bigrams,
normalised by their number; a line that is repeated counts once, as in the counts.
Its score follows by a rising curve (isotonic regression).

Labels are learned from rows with crc32(doc_id as text) mod 3 other than 1. From
these, up to MAX_PER_CLASS documents of each class, or as many as MAX_CHARS
characters hold, by the order of a hash of their ids, are the sample on which the
models are fitted. The curve is fitted on
ratios that each half of the sample gets from models of the other half, and every
sampled document weighs as many as it stands for. A model holds a number for each
word and bigram of the sample, under 64-bit hashes; so its size is bounded by the
sample's, and it is broadcast.

Defined results: a null or empty text, and one without words, has the ratio that ordinary texts
have in the middle; a null
id is never held out; labels that are null are ignored, and of several labels of
an id the larger counts; rows with a repeated id are scored one by one; texts are
read whole at any length; without labels of both classes in both halves every
score is 0; an empty table gives an empty result. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_strings, materialize, slices, tables_deleted, text_or_empty, word_hash

#: Bounds of the sample: documents of each class, and characters of each class beyond which no document is added.
MAX_PER_CLASS, MAX_CHARS = 4000, 24_000_000
#: A, B, S and the evenly spread part of s; chosen on training rows.
CLASS_SHARE, PAIR_SHARE, PAIR_STRENGTH, EVEN_SHARE = 1e-4, 1e-7, 1000, 0.05
#: Texts' log-likelihood ratios are divided by their number of distinct bigrams to this power.
LENGTH = 0.75
THRESHOLD = 0.7
START = np.uint64(0)
_WORD = re.compile(r"[^\W\d_]+")
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
#: Counts by class (0 ordinary, 1 toxic) and half of the sample.
_CELLS = [(c, half) for c in (0, 1) for half in (0, 1)]


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def bigrams(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the first and second words of a text's distinct bigrams, and its number of words."""
    found = words(text)
    w = np.fromiter(map(word_hash.__getitem__, found), np.uint64, len(found))
    u = np.concatenate(([START], w))[: len(w)]
    _, at = np.unique(pair_keys(u, w), return_index=True)
    return u[at], w[at], len(found)


def pair_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = u * _MULTIPLY + w
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _look_up(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key would stand among the sorted known ones, and whether it is there."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


class Model:
    """Log-likelihood ratios of words and of seen bigrams, and what a context adds to words unseen after it."""

    def __init__(self, word: np.ndarray, ratio: np.ndarray, context: np.ndarray, other: float, pair: np.ndarray, pair_ratio: np.ndarray) -> None:
        order, pairs = np.argsort(word), np.argsort(pair)
        self.word, self.ratio, self.context, self.other = word[order], ratio[order], context[order], other
        self.pair, self.pair_ratio = pair[pairs], pair_ratio[pairs]

    def ratios(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        at, known = _look_up(w, self.word)
        found = np.where(known, self.ratio[at] if len(self.word) else 0.0, self.other).astype(float)
        at, known = _look_up(u, self.word)
        found[known] += self.context[at[known]]
        at, known = _look_up(pair_keys(u, w), self.pair)
        found[known] = self.pair_ratio[at[known]]
        return found

    def text_ratios(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the sum of its distinct bigrams' ratios over their number to the power LENGTH, and its number of words."""
        grams = [bigrams(x) for x in texts]
        size = np.array([len(w) for _, w, _ in grams], np.int64)
        if not size.sum():
            return np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        ratio = self.ratios(np.concatenate([u for u, _, _ in grams]), np.concatenate([w for _, w, _ in grams]))
        total = np.bincount(np.repeat(np.arange(len(texts)), size), ratio, len(texts))
        return total / np.maximum(size, 1) ** LENGTH, np.array([n for _, _, n in grams], np.int64)


def sample(docs: DataFrame, labels: DataFrame, most: int = MAX_PER_CLASS) -> DataFrame:
    """(doc_id, toxic, half, weight, text): the labelled documents that models are fitted on."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    lengths = texts.groupBy("doc_id").agg(F.sum(F.char_length("text")).alias("chars"))
    known = materialize(known.where("toxic in (0, 1)").where(~held_out()).join(lengths, "doc_id"), "labels")
    order = [F.xxhash64("doc_id", F.lit("sample")), "doc_id"]
    first = lambda c: known.where(F.col("toxic") == c).orderBy(*order).limit(most)
    before = Window.partitionBy("toxic").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)  # over at most ``most`` rows
    ids = first(0).unionByName(first(1)).withColumn("before", F.coalesce(F.sum("chars").over(before), F.lit(0))).where(F.col("before") < MAX_CHARS)
    ids = materialize(ids.select("doc_id", "toxic", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half")), "sample")
    count = lambda df: {r["toxic"]: r["count"] for r in df.groupBy("toxic").count().collect()}
    every, taken = count(known), count(ids)
    stands_for = lambda c: F.lit(every.get(c, 0) / max(1, taken.get(c, 0)))
    weighed = ids.withColumn("weight", F.when(F.col("toxic") == 0, stands_for(0)).otherwise(stands_for(1)))
    return materialize(texts.join(F.broadcast(weighed), "doc_id"), "sampled")  # at most 2 * most ids


def bigram_counts(sampled: DataFrame) -> DataFrame:
    """(u, w, n00, n01, n10, n11): how many documents hold a bigram (hashes), by class and half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for toxic, half, text in zip(batch["toxic"].to_pylist(), batch["half"].to_pylist(), arrow_strings(batch["text"])):
                u, w, _ = bigrams(text)
                cell = [np.full(len(u), int((toxic, half) == x), np.int64) for x in _CELLS]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (u.view(np.int64), w.view(np.int64), *cell)], names=["u", "w", *(f"n{c}{h}" for c, h in _CELLS)])

    names = [f"n{c}{h}" for c, h in _CELLS]
    rows = sampled.select("toxic", "half", "text").mapInArrow(run, "u bigint, w bigint, " + ", ".join(f"{n} bigint" for n in names))
    return materialize(rows.groupBy("u", "w").agg(*[F.sum(n).alias(n) for n in names]), "bigrams")


def discount(once: int, twice: int) -> float:
    """The Kneser-Ney discount from how many are counted once and twice."""
    return once / (once + 2 * twice) if once and twice else 0.5


def _arrays(df: DataFrame) -> list[np.ndarray]:
    table = df.toArrow()
    return [table[c].to_numpy() for c in df.columns]


def fit(counts: DataFrame, halves: tuple[int, ...]) -> Model | None:
    """The model of some halves of the sample; None where a class has no words in them."""
    n = [sum((F.col(f"n{c}{h}") for h in halves), F.lit(0)) for c in (0, 1)]
    pairs = counts.select("u", "w", n[0].alias("n0"), n[1].alias("n1")).where("n0 + n1 > 0")
    seen = lambda df, x: [a for c in (0, 1) for a in (F.count_if(F.col(f"{x}{c}") == 1).alias(f"once{c}"), F.count_if(F.col(f"{x}{c}") == 2).alias(f"twice{c}"))]
    t = pairs.agg(*seen(pairs, "n")).first()
    d2 = [discount(t[f"once{c}"], t[f"twice{c}"]) for c in (0, 1)]
    by_word = pairs.groupBy(F.col("w").alias("x")).agg(*[F.count_if(F.col(f"n{c}") > 0).alias(f"k{c}") for c in (0, 1)])
    by_context = pairs.groupBy(F.col("u").alias("x")).agg(*[F.sum(f"n{c}").alias(f"a{c}") for c in (0, 1)], *[F.sum(F.least(F.col(f"n{c}"), F.lit(d2[c]))).alias(f"f{c}") for c in (0, 1)])
    both = materialize(by_word.join(by_context, "x", "full").fillna(0), "words")
    t = both.where("k0 + k1 > 0").agg(F.count("*").alias("words"), *[F.sum(f"k{c}").alias(f"k{c}") for c in (0, 1)], *[F.count_if(F.col(f"k{c}") > 0).alias(f"types{c}") for c in (0, 1)], *seen(both, "k")).first()
    if not t["k0"] or not t["k1"]:
        return None
    d1 = [discount(t[f"once{c}"], t[f"twice{c}"]) for c in (0, 1)]
    common = F.least(F.col("k0") / t["k0"], F.col("k1") / t["k1"])
    total = both.agg(F.sum(common)).first()[0] or 1.0
    floor = EVEN_SHARE / (t["words"] + 1)
    shared = common * ((1 - EVEN_SHARE) / total) + floor
    rest = [1 - CLASS_SHARE + CLASS_SHARE * d1[c] * t[f"types{c}"] / t[f"k{c}"] for c in (0, 1)]
    q = [F.greatest(F.col(f"k{c}") - d1[c], F.lit(0.0)) * (CLASS_SHARE / t[f"k{c}"]) + shared * rest[c] for c in (0, 1)]
    left = [(F.col(f"f{c}") + PAIR_STRENGTH) / (F.col(f"a{c}") + PAIR_STRENGTH) * PAIR_SHARE + (1 - PAIR_SHARE) for c in (0, 1)]
    table = materialize(both.select("x", "a0", "a1", *[q[c].alias(f"q{c}") for c in (0, 1)], *[left[c].alias(f"l{c}") for c in (0, 1)]), "model")
    first = table.select(F.col("x").alias("u"), "a0", "a1", "l0", "l1")
    second = table.select(F.col("x").alias("w"), "q0", "q1")
    own = [F.greatest(F.col(f"n{c}") - d2[c], F.lit(0.0)) * PAIR_SHARE / (F.col(f"a{c}") + PAIR_STRENGTH) + F.col(f"l{c}") * F.col(f"q{c}") for c in (0, 1)]
    bigram = pairs.join(first, "u").join(second, "w").select("u", "w", F.log(own[1] / own[0]).cast("float").alias("ratio"))
    word, ratio, context = _arrays(table.select("x", F.log(F.col("q1") / F.col("q0")).alias("ratio"), F.log(F.col("l1") / F.col("l0")).alias("context")))
    u, w, pair_ratio = _arrays(bigram)
    return Model(word.view(np.uint64), ratio, context, math.log(rest[1] / rest[0]), pair_keys(u.view(np.uint64), w.view(np.uint64)), pair_ratio)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising curve closest to y, as the ends of its level parts: pooled adjacent violators."""
    value, place = np.unique(x, return_inverse=True)
    total, mass = np.bincount(place, y * weight), np.bincount(place, weight)
    parts: list[list[float]] = []  # low, high, weighted sum, weight
    for at, t, w in zip(value.tolist(), total.tolist(), mass.tolist()):
        parts.append([at, at, t, w])
        while len(parts) > 1 and parts[-2][2] * parts[-1][3] >= parts[-1][2] * parts[-2][3]:
            _, high, t, w = parts.pop()
            parts[-1] = [parts[-1][0], high, parts[-1][2] + t, parts[-1][3] + w]
    return np.array([e for p in parts for e in p[:2]]), np.array([p[2] / p[3] for p in parts for _ in (0, 1)])


class Scorer:
    """A model with its curve; middle and scale are where ordinary texts' ratios lie and how they spread."""

    def __init__(self, model: Model, middle: float, scale: float, at: np.ndarray, share: np.ndarray) -> None:
        self.model, self.middle, self.scale, self.at, self.share = model, middle, scale, at, share

    def score(self, ratio: np.ndarray) -> np.ndarray:
        """The toxic share at a ratio; two hundredths of the score keep the order within level parts of the curve."""
        x = ratio - self.middle
        return 0.98 * np.interp(x, self.at, self.share) + 0.01 * (1 + x / (np.abs(x) + self.scale))


def learn(docs: DataFrame, labels: DataFrame, most: int = MAX_PER_CLASS) -> Scorer | None:
    """The scorer, or None where labels of one class are missing."""
    with tables_deleted(docs.sparkSession):
        return _learn(docs, labels, most)


def _learn(docs: DataFrame, labels: DataFrame, most: int) -> Scorer | None:
    sampled = sample(docs, labels, most)
    counts = bigram_counts(sampled)
    halves = [fit(counts, (1,)), fit(counts, (0,))]  # each half's texts are scored by the other's model
    if None in halves:
        return None
    shared = docs.sparkSession.sparkContext.broadcast(halves)
    del halves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, half = arrow_strings(batch["text"]), batch["half"].to_numpy()
            ratio = np.where(half == 0, *(m.text_ratios(texts)[0] for m in shared.value))
            yield pa.RecordBatch.from_arrays([batch["toxic"], batch["weight"], pa.array(ratio, pa.float64())], names=["toxic", "weight", "ratio"])

    y, weight, ratio = _arrays(sampled.select("toxic", "half", "weight", "text").mapInArrow(run, "toxic int, weight double, ratio double"))
    shared.destroy()
    middle = float(np.median(ratio[y == 0]))
    scale = float(np.median(np.abs(ratio[y == 0] - middle))) or 1e-9
    return Scorer(fit(counts, (0, 1)), middle, scale, *isotonic(ratio - middle, y, weight))


def score(docs: DataFrame, scorer: Scorer | None, threshold: float = THRESHOLD) -> DataFrame:
    """Each row of ``docs`` with all its columns, and _gw_score, _gw_predicted and _gw_words."""
    own = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = own.value
        for batch in slices(batches):
            texts = arrow_strings(batch["text"])
            if s:
                ratio, n = s.model.text_ratios(texts)
                value = s.score(np.where(n > 0, ratio, s.middle))
            else:
                value, n = np.zeros(len(texts)), np.array([len(words(x)) for x in texts], np.int64)
            more = [pa.array(value), pa.array((value >= threshold).astype(np.int32)), pa.array(n)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "_gw_score", "_gw_predicted", "_gw_words"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, _gw_score double, _gw_predicted int, _gw_words bigint")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted, n_words."""
    scored = score(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")), learn(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("_gw_score").alias("score"), F.col("_gw_predicted").alias("predicted"), F.col("_gw_words").alias("n_words"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    return score(docs, learn(docs, labels)).where("_gw_predicted = 0").select(*docs.columns)
