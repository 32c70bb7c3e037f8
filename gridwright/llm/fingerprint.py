"""Document fingerprints: bottom-k sketches of five-word shingle hashes.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's
shingles. The sketch of a union is the k smallest of both sketches, so sketches
of parts merge, and from sketches alone follow the distinct shingle count,
resemblance (Jaccard) and containment. All of it is made of Spark functions.

Defined results: a null text counts as empty and has an empty sketch; a text of
one to four words has the one shingle of all its words; two empty sketches have
resemblance 1, an empty and another one 0; in the order of documents, rows
without an id come first, and rows with the same id, or none, follow a hash of their
texts and then these; with one row, the next document is that row; an empty table gives an empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, materialize, text_or_empty

K = 256
SHINGLE = 5
ROWS_PER_BUCKET = 1000
QUANTILES = 255
#: Rows that a task's window holds, so that partitions grow in number and not in size.
ROWS_PER_TASK = 20_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE), "")


def shingles(word: Column, size: int = SHINGLE) -> Column:
    """Hashes of the runs of ``size`` words; ``word`` should be a column that is already computed."""
    n = F.size(word)
    runs = F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(F.slice(word, i, size)))
    return F.when(n >= size, runs).when(n > 0, F.array(F.xxhash64(word))).otherwise(F.array().cast("array<bigint>"))


def smallest(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_count(sketch: Column, k: int = K) -> Column:
    """Exact below k; beyond, from where the k-th smallest hash lies in the range of hashes."""
    share = (F.element_at(sketch, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The share of the union's sketch that both have; of two columns that are already computed."""
    both = F.size(F.array_intersect(merge(a, b, k), F.array_intersect(a, b)))
    n = F.size(merge(a, b, k))
    return F.when(n == 0, F.lit(1.0)).otherwise(both / n)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The share of a's shingles that b has."""
    share = resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / distinct_count(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))


def as_text(sketch: Column) -> Column:
    """Sixteen hex digits a hash."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def fingerprint(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id and sketch of each document."""
    split = docs.select("doc_id", words(text_or_empty()).alias("word"))
    return split.select("doc_id", smallest(shingles(F.col("word")), k).alias("sketch"))


def _tree(x: Column, edges: list, low: int, high: int) -> Column:
    """How many of edges[low:high] are at most x, as nested comparisons."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(x < F.lit(edges[middle]), _tree(x, edges, low, middle)).otherwise(_tree(x, edges, middle + 1, high))


def _buckets(docs: DataFrame) -> tuple[DataFrame, int]:
    """Adds part, bucket and hash, ascending as the rows are ordered, of about ROWS_PER_BUCKET rows each; and counts the rows.

    Quantiles of the ids make up to QUANTILES + 1 parts, and each part is divided
    evenly. Ids that hold several quantiles, and rows without an id, are many rows of
    one id each: these are divided by the hash of their texts.
    """
    found = docs.select(F.count("*"), F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", [i / (QUANTILES + 1) for i in range(1, QUANTILES + 1)], 10_000), F.count_if(F.col("doc_id").isNull())).first()
    n, least, most, quantiles, n_null = found[0], found[1] or 0, found[2] or 0, found[3] or [], found[4]
    edges = sorted(set(quantiles))
    heavy = [x for x in edges if quantiles.count(x) > 1] if n > ROWS_PER_BUCKET * 4 else []
    edges = edges if n > ROWS_PER_BUCKET * 4 else edges[:: max(1, len(edges) * ROWS_PER_BUCKET // max(1, n))]
    each, same = max(1, -(-n // (ROWS_PER_BUCKET * (len(edges) + 1)))), max(1, -(-n // ROWS_PER_BUCKET))
    bounds = F.array(*[F.lit(x).cast("bigint") for x in (least, *edges, most + 1)])
    low, high = F.get(bounds, F.col("part")), F.get(bounds, F.col("part") + 1)
    within = F.least(F.greatest(F.floor((F.col("doc_id") - low) / F.greatest(high - low, F.lit(1)) * each), F.lit(0)), F.lit(each - 1))
    part = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_tree(F.col("doc_id"), edges, 0, len(edges)))
    bucket = F.col("part").cast("bigint") * (same + each) + same + within
    if heavy or n_null > ROWS_PER_BUCKET:  # the texts are read here only where there are such rows
        by_hash = F.floor((F.col("hash") / F.lit(2.0**64) + 0.5) * same).cast("bigint")
        alone = F.col("doc_id").isNull() | F.col("doc_id").isin(heavy) if heavy else F.col("doc_id").isNull()
        bucket = F.when(alone, F.col("part").cast("bigint") * (same + each) + F.least(by_hash, F.lit(same - 1))).otherwise(bucket)
    rows = docs.withColumns({"part": part, "hash": F.xxhash64("text")})
    return rows.withColumn("bucket", F.coalesce(bucket, F.lit(-same - each)).cast("bigint")), n


def with_next(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, text, sketch, next_text, next_sketch; next by ascending doc_id, after the last the first.

    Texts are shuffled once, by bucket of ids, and the window runs inside the
    buckets; a bucket's last row gets the first row of the bucket that follows.
    """
    rows, n = _buckets(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")))
    heads = materialize(rows.groupBy("part", "bucket").agg(F.min("doc_id").alias("first_id")), "buckets")
    # the next bucket in the part, or else the first one of the next part; there are few parts
    parts = heads.groupBy("part").agg(F.min("bucket").alias("head"))
    every = Window.orderBy("part")
    parts = parts.select("part", F.coalesce(F.lead("head").over(every), F.min("head").over(every)).alias("following"))
    chain = heads.join(F.broadcast(parts), "part").select("bucket", F.coalesce(F.lead("bucket").over(Window.partitionBy("part").orderBy("bucket")), "following").alias("after"))
    head = heads.select(F.col("bucket").alias("_b"), F.col("first_id").alias("_id"))
    firsts = rows.join(head, (F.col("bucket") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_id"))).groupBy("bucket").agg(F.min(F.struct("hash", "text"))["text"].alias("text"))
    firsts = firsts.select(F.col("bucket").alias("after"), F.col("text").alias("head_text"), words(F.col("text")).alias("word"))
    tails = materialize(chain.join(firsts, "after").select("bucket", "head_text", smallest(shingles(F.col("word")), k).alias("head_sketch")), "heads")

    order = Window.partitionBy("bucket").orderBy("doc_id", "hash", "text")
    # words only after the window: made before it, they would go through the shuffle
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_PER_TASK))
    led = rows.repartition(tasks, "bucket").select("bucket", "doc_id", "hash", "text", F.lead("text").over(order).alias("next_text"))
    split = led.select("*", words(F.col("text")).alias("word"))
    sketched = split.select("bucket", "doc_id", "hash", "text", "next_text", smallest(shingles(F.col("word")), k).alias("sketch"))
    paired = sketched.withColumn("next_sketch", F.lead("sketch").over(order))
    tails = tails.withColumnRenamed("bucket", "_b")
    joined = paired.join(tails, (F.col("bucket") == F.col("_b")) & F.col("next_text").isNull(), "left")
    return joined.select("doc_id", "text", "sketch", F.coalesce("next_text", "head_text").alias("next_text"), F.coalesce("next_sketch", "head_sketch").alias("next_sketch"))


def fingerprint_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and its next document."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edit = with_next(docs, k).select("doc_id", n.cast("bigint").alias("n_chars"), "sketch", "next_sketch", F.concat(F.left("text", n - half), F.left("next_text", half)).alias("edited"))
    split = edit.select("*", words(F.col("edited")).alias("word"))
    both = split.select("doc_id", "n_chars", "sketch", "next_sketch", F.sha2("edited", 256).alias("edited_sha256"), smallest(shingles(F.col("word")), k).alias("edited_sketch"))
    return both.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"), resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"))
