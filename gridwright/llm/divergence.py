"""Audit of how the sources of a language differ in their words.

Each language keeps the terms of enough of its documents. A term is pivoted into an
array of counts by source, and the array of the sources' smoothed shares follows
from it; higher-order functions emit what the term adds to every pair of sources,
and sums combined before the shuffle add these up. No two documents and no two
terms meet.

Defined results: null texts, languages and sources count as empty ones; a source
without kept terms has the shares that smoothing gives; in a language without kept
terms every pair has 0 and no term is listed; a language with one source has no
pairs; ties are in the order of the items' bytes; an empty table gives no rows.
All arithmetic is of whole numbers, exact below 9e15 words a language. Other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, settled, slices

MIN_DOCUMENTS, SMOOTH, SCALE, LISTED = 30, 5, 1_000_000_000, 50
#: Counts that a task holds before it hands them on, and rows of a side that is broadcast at most.
HELD, BROADCAST_ROWS = 300_000, 100_000
#: Bytes of terms as they are, A to Z in lower case, all others as spaces; every byte of a code point beyond ASCII is of a term.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)).lower()
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def named(docs: DataFrame, lang_col: str = "lang", source_col: str = "source") -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]


def term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): partial counts of terms and of documents with them, combined within tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, held = defaultdict(Counter), defaultdict(Counter), 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in words.items():
                terms, own = list(counts), seen[lang, source]
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(terms)), pa.repeat(source, len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array([own[t] for t in terms], pa.int64())], schema=_COUNTS)
            words.clear()
            seen.clear()

        for batch in slices(batches):
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
                found, key = text.translate(_FOLD).split(), (lang, source)
                before = len(words[key])
                words[key].update(found)
                seen[key].update(set(found))
                held += len(words[key]) - before
                if held > HELD:
                    yield from flush()
                    held = 0
        yield from flush()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    return docs.select(*named(docs), text).mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def kept_terms(docs: DataFrame, least: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, term, counts): terms in at least ``least`` documents of their language, with their counts by source. One shuffle, by language and term."""
    sums = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))
    return whole.where(F.col("docs") >= least).drop("docs")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept)), by long division in base 1000, so nothing overflows."""
    above, below = count + SMOOTH, total + SMOOTH * kept
    out, rest = F.lit(0), above
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + F.call_function("div", rest, below), rest % below
    return out + 1


def language_table(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, sources, totals, total, kept): each language's sources in order, their words in kept terms, and its number of kept terms."""
    groups = docs.select(*named(docs)).distinct()
    by_source = terms.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("own"))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("kept"))
    listed = groups.join(by_source, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("own", F.lit(0)).alias("own")))).alias("s"))
    total = F.aggregate("s.own", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return listed.join(sizes, "lang", "left").select("lang", F.col("s.source").alias("sources"), F.col("s.own").alias("totals"), total.alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"))


def vectors(terms: DataFrame, languages: DataFrame) -> DataFrame:
    """(lang, term, n, p, q): a term's counts and shares in the order of its language's sources, and its share in the language."""
    small = F.broadcast(languages) if languages.count() <= BROADCAST_ROWS else languages
    known = terms.withColumn("counts", F.map_from_entries("counts")).join(small, "lang")
    wide = known.withColumn("n", F.transform("sources", lambda s: F.coalesce(F.try_element_at("counts", s), F.lit(0))))
    total = F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x)
    p = F.transform(F.arrays_zip("n", "totals"), lambda x: share(x["n"], x["totals"], F.col("kept")))
    return wide.select("lang", "term", "n", p.alias("p"), share(total, F.col("total"), F.col("kept")).alias("q"))


def _pairs(items: Column, size: Column, pair) -> Column:
    """pair(i, j) of all i < j, as one array; empty for fewer than two."""
    each = F.flatten(F.transform(F.sequence(F.lit(0), size - 2), lambda i: F.transform(F.sequence(i + 1, size - 1), lambda j: pair(F.get(items, i), F.get(items, j)))))
    return F.when(size >= 2, each)


def pair_differences(languages: DataFrame, wide: DataFrame) -> DataFrame:
    """(lang, source, item, value): the sum of differences of shares over all kept terms, for every ordered pair of a language's sources."""
    parts = _pairs(F.col("p"), F.size("p"), lambda a, b: F.abs(a - b))
    sums = wide.select("lang", F.posexplode(parts).alias("k", "f")).groupBy("lang", "k").agg(F.sum("f").alias("value"))
    names = _pairs(F.col("sources"), F.size("sources"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    every = languages.select("lang", F.posexplode(names).alias("k", "s")).join(sums, ["lang", "k"], "left")
    both = F.array(F.struct(F.col("s.a").alias("source"), F.col("s.b").alias("item")), F.struct(F.col("s.b").alias("source"), F.col("s.a").alias("item")))
    return every.select("lang", F.explode(both).alias("o"), F.coalesce("value", F.lit(0)).alias("value")).select("lang", "o.source", "o.item", "value")


def raised_terms(languages: DataFrame, wide: DataFrame) -> DataFrame:
    """(lang, source, item, value): terms that a source has and uses more than its language does."""
    small = languages.select("lang", "sources")
    known = wide.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, "lang")
    each = known.select("lang", "term", "q", F.explode(F.arrays_zip("sources", "n", "p")).alias("x"))
    return each.where((F.col("x.n") > 0) & (F.col("x.p") > F.col("q"))).select("lang", F.col("x.sources").alias("source"), F.col("term").alias("item"), (F.col("x.p") - F.col("q")).alias("value"))


def divergence(docs: DataFrame, least: int = MIN_DOCUMENTS, listed: int = LISTED) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others, and its ``listed`` terms above its language."""

    def build() -> DataFrame:
        terms = materialize(kept_terms(docs, least), "terms")
        languages = materialize(language_table(docs, terms), "languages")
        wide = materialize(vectors(terms, languages), "vectors")
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        ranked = lambda df, part: df.withColumn("rank", rank).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
        return ranked(pair_differences(languages, wide), "pair").unionByName(ranked(raised_terms(languages, wide), "term").where(F.col("rank") <= listed))

    return settled(docs.sparkSession, "divergence", build)
