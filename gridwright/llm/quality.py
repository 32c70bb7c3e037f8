"""Quality rules as weak supervision: rules vote or abstain, and a model of the votes decides.

Each text is measured once. A rule turns measures into a vote for good, a vote for
bad, or abstains. Rows are counted by their votes; expectation-maximisation on these
counts, at most 3 ** len(BOUNDS) of them whatever the number of rows, estimates the
share of good documents and, for good and for bad ones, how often each rule votes
either way, and from these follows the posterior probability that a document is good.

Defined results: a null text has no words and fails the base test, as all texts of
fewer than MIN_WORDS words do; such rows take no part in the estimate; without rows
that pass it, or on an empty table, nothing is estimated; rows that repeat an id are
documents of their own; other columns are passed through by keep_good and ignored
by judge.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_strings, materialize, settled, slices, text_or_empty

MIN_WORDS, MAX_REPEATED, WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_same_words", "n_plain", "n_letters", "n_capitals", "n_ends", "n_shouts", "n_distinct")


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """For each code point 1 if it is a digit or mark, 2 if it is a letter, 3 if it is a capital letter, else 0."""
    return np.array([3 if k == "Lu" else {"L": 2, "M": 1, "N": 1}.get(k[0], 0) for k in map(unicodedata.category, map(chr, range(0x110000)))], np.uint8)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """How many words lie in windows that occur twice or more, the first time included.

    Hashes say whether any window can occur twice; if so, windows are told apart by
    their words, which numbers of ever longer windows stand for.
    """
    n = len(ids) - window + 1
    if n < 2:
        return 0
    odd = np.uint64(0x9E3779B97F4A7C15)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * odd
    mixed ^= mixed >> np.uint64(29)
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = key * odd + mixed[k : k + n]
    ordered = np.sort(key)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    number = ids.astype(np.int64)
    for k in range(1, window):
        number = np.unique(number[:-1] * (int(ids.max()) + 1) + ids[k:], return_inverse=True)[1]
    again = np.bincount(number)[number] > 1
    step = np.zeros(len(ids) + 1, np.int64)
    np.add.at(step, np.flatnonzero(again), 1)
    np.add.at(step, np.flatnonzero(again) + window, -1)
    return int((np.cumsum(step)[:-1] > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """MEASURES of one text."""
    data = text.encode()
    words = data.split()  # at the white space of the contract, which is that of bytes
    place = dict(zip(words, range(len(words))))
    ids = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kinds = _kinds()[points]
    ends = sum(x.rstrip()[-1:] in b".!?" for x in lines)
    return (
        len(words), int(((points != 32) & ((points < 9) | (points > 13))).sum()), sum(data.count(SYMBOLS[k : k + 1]) for k in range(len(SYMBOLS))), len(lines) - len(set(lines)), repeated_words(ids),
        len(lines), int((ids[1:] == ids[:-1]).sum()), int((kinds > 0).sum()), int((kinds > 1).sum()), int((kinds > 2).sum()), ends, data.count(b"!"), len(place),
    )


def measured(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of each row, and _gw, a struct of MEASURES."""
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([measure(x) for x in arrow_strings(batch["_gw_text"])], np.int64).reshape(-1, len(MEASURES))
            columns = [pa.array(np.ascontiguousarray(c)) for c in found.T]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.StructArray.from_arrays(columns, list(MEASURES))], names=[*keep, "_gw"])

    struct = "struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">"
    return docs.select(*keep, text_or_empty(text_col).alias("_gw_text")).mapInArrow(run, ", ".join([*kinds, f"_gw {struct}"]))


def _between(value: Column, bad_below: float | None, good_from: float | None, good_to: float | None, bad_above: float | None) -> Column:
    """-1 outside the outer bounds, 1 within the inner ones, else 0."""
    bad, good = F.lit(False), F.lit(True)
    for bound, test in ((bad_below, lambda b: value < b), (bad_above, lambda b: value > b)):
        bad = bad | test(bound) if bound is not None else bad
    for bound, test in ((good_from, lambda b: value >= b), (good_to, lambda b: value <= b)):
        good = good & test(bound) if bound is not None else good
    return F.when(bad, -1).when(good, 1).otherwise(0)


def _ratio(a: str, b: str) -> Column:
    return F.col(f"_gw.{a}") / F.greatest(F.col(f"_gw.{b}"), F.lit(1))


#: name: (measure over measure, bad below, good from, good to, bad above). What lies between good and bad is an abstention.
BOUNDS = {
    "word_length": ("word_chars", "n_words", 2.5, 3.5, 8.0, 12.0),
    "symbols": ("n_symbols", "n_words", None, None, 0.02, 0.1),
    "copied_lines": ("n_dup_lines", "n_lines", None, None, 0.15, 0.3),
    "copied_words": ("n_repeat_words", "n_words", None, None, 0.06, 0.15),
    "stuttering": ("n_same_words", "n_words", None, None, 0.05, 0.15),
    "capitals": ("n_capitals", "n_letters", None, None, 0.15, 0.4),
    "letters": ("n_plain", "word_chars", 0.75, 0.9, None, None),
    "line_ends": ("n_ends", "n_lines", 0.2, 0.7, None, None),
    "shouts": ("n_shouts", "n_words", None, None, 0.05, 0.2),
    "variety": ("n_distinct", "n_words", 0.1, 0.3, None, None),
}
#: Votes (bad, none, good) of good and of bad documents before any is seen, and the part of each estimate that stays at them.
START, HELD, START_GOOD = {True: (0.001, 0.1, 0.899), False: (0.4, 0.2, 0.4)}, 0.1, 0.8
ROUNDS, KEPT_FROM = 30, 0.5


def votes() -> dict[str, Column]:
    """Each rule's vote, from the columns of measured."""
    return {name: _between(_ratio(a, b), *bounds) for name, (a, b, *bounds) in BOUNDS.items()}


def base_failed() -> Column:
    return (F.col("_gw.n_words") < MIN_WORDS) | (100 * F.col("_gw.n_repeat_words") > MAX_REPEATED * F.col("_gw.n_words"))


def estimate(patterns: np.ndarray, counts: np.ndarray, held: float = HELD) -> tuple[float, np.ndarray]:
    """The share of good documents, and (class, rule, vote) shares of bad (0) and good (1) ones, by expectation-maximisation.

    ``patterns`` are rows of votes -1, 0 and 1, ``counts`` how many documents have
    them. A part ``held`` of each estimate stays at its start, so a rule that few
    documents break still says something of a document that breaks it.
    """
    start = np.array([[START[False]] * patterns.shape[1], [START[True]] * patterns.shape[1]])
    good, share = START_GOOD, start
    rules = np.arange(patterns.shape[1])
    for _ in range(ROUNDS if counts.sum() else 0):
        odds = np.log(good) - np.log1p(-good) + (np.log(share[1]) - np.log(share[0]))[rules, patterns + 1].sum(axis=1)
        weight = counts / (1 + np.exp(-odds))
        both = np.stack([counts - weight, weight])
        good = (1 - held) * weight.sum() / counts.sum() + held * START_GOOD
        seen = np.stack([both @ (patterns == v) for v in (-1, 0, 1)], axis=-1)
        share = (1 - held) * seen / np.maximum(both.sum(axis=1), 1e-9)[:, None, None] + held * start
    return good, share


def fit(found: DataFrame) -> tuple[float, np.ndarray]:
    """The estimate for rows of measured; the driver sees a row for each pattern of votes."""
    cast = {name: vote.cast("int") for name, vote in votes().items()}
    rows = found.where(~base_failed()).groupBy(*[v.alias(k) for k, v in cast.items()]).agg(F.count("*").alias("_n")).orderBy(*cast).collect()
    return estimate(np.array([r[:-1] for r in rows], np.int64).reshape(-1, len(cast)), np.array([r[-1] for r in rows], np.float64))


def posterior(model: tuple[float, np.ndarray]) -> Column:
    """The probability that a row of measured is good."""
    good, share = model
    gain = np.log(share[1]) - np.log(share[0])
    odds = F.lit(float(np.log(good) - np.log1p(-good)))
    for vote, (bad, none, fine) in zip(votes().values(), gain):
        odds = odds + F.when(vote == -1, float(bad)).when(vote == 1, float(fine)).otherwise(float(none))
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, MEASURES, base_failed, each rule's vote, quality (the posterior) and kept of each row. Texts are read once."""

    def build() -> DataFrame:
        found = materialize(measured(docs, [id_col], text_col), "measures")
        judged = found.select(id_col, "_gw.*", base_failed().alias("base_failed"), F.struct(*[v.cast("int").alias(k) for k, v in votes().items()]).alias("votes"), posterior(fit(found)).alias("quality"))
        return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEPT_FROM))

    return settled(docs.sparkSession, "judged", build)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the base test and are good more likely than not, with their columns."""
    model = fit(materialize(measured(docs, [], text_col), "measures"))
    found = measured(docs, docs.columns, text_col)
    return found.where(~base_failed() & (posterior(model) >= KEPT_FROM)).select(*docs.columns)
