"""Near-duplicate classes by ProbMinHash, banding and verification.

A document is the weighted set of its five-word shingles, a shingle's weight
being how often it occurs. Words are runs of letters and digits in lower case.
Every shingle is a Poisson process whose rate is its weight; its arrivals hit
random registers, and a register keeps the shingle that arrives first. A process
ends when its next arrival is later than the latest register, since no later one
can count. Two documents agree in a register with their probability Jaccard
similarity. Bands of registers propose pairs, and the pairs' whole shingle sets
decide: similarity is the larger of the probability Jaccard of the weights and
the Jaccard of the sets, so links that either of them sees are kept. A document
that repeats a shingle is signed twice, the second time with all weights 1, and
has the bands of both, as registers of weights 1 agree with the sets' Jaccard.

Texts with the same words are one node, whatever their ids. In a bucket of a band,
nodes meet the bucket's smallest one, as pairs. Connected classes follow. Nodes of
buckets that still hold several classes are open. For these an exact prefix filter
finds the rest: in any common order of all shingles, two sets whose Jaccard is t at
least share a shingle among the first |x| - 2t/(1+t)|x| + 1 of the smaller and the
first |y| - t|y| + 1 of the larger, and sets whose weights are alike share one where
each has more than 1 - t of its weight. In the order from rare to frequent, passages
and templates that many documents share stand last, so texts that have nothing else
in common don't meet, and a group is the nodes of one such shingle. How frequent a
shingle is comes from a sample of the open nodes, which decides the order only: no
order loses a link. A group's sets are compared block by block: a product of
incidence matrices counts the common shingles of two blocks of BLOCK nodes at once,
and only links that connect classes leave the task. So no pairs of a group become
rows, a task holds two blocks, and every candidate pair is decided all the same.

Defined results: a null text counts as empty; texts without words are one class;
a text of one to four words is a single shingle; rows that repeat an id are rows of
their own, each in the class of its text; a class is named after its smallest id,
and one without any id has the class null, its rows being counted and kept apart
from other such classes; of each class the row with the smallest id stays (of
several such rows, and of rows without an id, that with the smallest digest, once);
an empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_strings, give_back, keep_winners, materialize, settled, slices, text_or_empty, word_hash

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 30, 6
#: Members of a block and their shingles; two blocks are compared in one task.
BLOCK, BLOCK_SHINGLES = 512, 2_000_000
BATCH_SHINGLES = 60_000
#: Open nodes whose shingles are counted for the order, and frequent shingles that are told apart in it.
ORDER_NODES, ORDER_SHINGLES = 20_000, 200_000
_WORD = re.compile(r"\w+")
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str) -> np.ndarray:
    found = _WORD.findall(text.lower())
    return np.fromiter(map(word_hash.__getitem__, found), np.uint64, len(found))


def _mix(x: np.ndarray) -> np.ndarray:
    """The last steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and how often each occurs."""
    n = max(1, len(words) - size + 1) if len(words) else 0
    h = np.zeros(n, np.uint64)
    for i in range(min(size, len(words))):
        h = h * _MULTIPLY + words[i : i + n]
    return np.unique(_mix(h), return_counts=True)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = BANDS * ROWS) -> np.ndarray:
    """A row of shingle hashes, one for each register, for each weighted set; 0 where a set is empty."""
    item = np.concatenate([s for s, _ in sets])
    weight = np.concatenate([w for _, w in sets]).astype(float)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets])
    first = np.full(len(sets) * registers, np.inf)  # when each register was first hit
    owner = np.zeros(len(sets) * registers, np.uint64)
    time, state = np.zeros(len(item)), item.copy()
    while len(item):
        state = _mix(state + _MULTIPLY)
        time = time - np.log(((state >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / weight
        at = doc * registers + (_mix(state) % np.uint64(registers)).astype(np.int64)
        better = np.flatnonzero(time < first[at])
        better = better[np.argsort(-time[better], kind="stable")]  # of several arrivals in a register the earliest is written last
        first[at[better]], owner[at[better]] = time[better], item[better]
        latest = first.reshape(-1, registers).max(axis=1)
        on = time < latest[doc]
        item, weight, doc, time, state = item[on], weight[on], doc[on], time[on], state[on]
    return owner.reshape(-1, registers)


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """An int64 for each band of each signature; equal bands of one number get equal ones."""
    parts = signature.reshape(len(signature), bands, -1)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(parts.shape[2]):
        h = _mix(h * _MULTIPLY + parts[:, :, i])
    return h.view(np.int64)


def candidate_bands(sets: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The band hashes of each set: those of its weights and, where these differ from 1, those of weights 1."""
    own = band_hashes(signatures(sets))
    repeats = [i for i, (_, w) in enumerate(sets) if len(w) and w.max() > 1]
    found = list(own)
    if repeats:
        plain = band_hashes(signatures([(sets[i][0], np.ones_like(sets[i][1])) for i in repeats]))
        for i, more in zip(repeats, plain):
            found[i] = np.union1d(own[i], more)
    return found


def similarity(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """The larger of the sets' Jaccard and the weights' probability Jaccard.

    The latter sums 1 / sum(max(x'/x, y'/y)) over the common shingles; with
    shingles in order of x/y, those above a shingle count by x and the rest by y.
    """
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    plain = len(i) / (len(a) + len(b) - len(i)) if len(a) + len(b) else 1.0
    if not len(i) or (x.max() == 1 and y.max() == 1):
        return plain
    ratio = x[i] / y[j]
    order = np.argsort(ratio)
    xs, ys, ratio = x[i][order].astype(float), y[j][order].astype(float), ratio[order]
    cut = np.searchsorted(ratio, ratio)
    above = xs.sum() - np.concatenate(([0.0], np.cumsum(xs)))[cut] + x.sum() - x[i].sum()
    below = np.concatenate(([0.0], np.cumsum(ys)))[cut] + y.sum() - y[j].sum()
    return max(plain, float((1 / (above / xs + below / ys)).sum()))


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the words, band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in slices(batches):
            ids, sets, digests, size = [], [], [], 0

            def flush() -> pa.RecordBatch:
                bands = candidate_bands(sets)
                flat = pa.ListArray.from_arrays(np.cumsum([0, *map(len, bands)], dtype=np.int32), pa.array(np.concatenate(bands)))
                return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), flat], names=["doc_id", "digest", "bands"])

            for doc_id, text in zip(batch["doc_id"].to_pylist(), arrow_strings(batch["text"])):
                words = word_hashes(text)
                ids.append(doc_id)
                digests.append(words_digest(words))
                sets.append(shingles(words))
                size += len(words)
                if size >= BATCH_SHINGLES:
                    yield flush()
                    ids, sets, digests, size = [], [], [], 0
            if ids:
                yield flush()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id bigint, digest binary, bands array<bigint>")


def words_digest(words: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(words.tobytes())


def with_digest(docs: DataFrame) -> DataFrame:
    """Adds _gw_digest, the digest of the words of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digest = pa.array([words_digest(word_hashes(x)) for x in arrow_strings(batch["_gw_text"])], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], digest], names=[*batch.schema.names[:-1], "_gw_digest"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.withColumn("_gw_text", text_or_empty()).mapInArrow(run, f"{schema}, _gw_digest binary")


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles (sorted uint64), weights (uint32) of the nodes (node, digest, text_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in slices(batches, 100):
            words = [word_hashes(x) for x in arrow_strings(batch["text"])]
            sets = [shingles(w) for w in words]
            digests = pa.array([words_digest(w) for w in words], pa.binary())
            yield pa.RecordBatch.from_arrays([digests, pa.array([s.tobytes() for s, _ in sets], pa.binary()), pa.array([w.astype("<u4").tobytes() for _, w in sets], pa.binary())], names=["digest", "shingles", "weights"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    ids = nodes.select("text_id").distinct()
    own = texts.join(ids, texts["doc_id"].eqNullSafe(ids["text_id"]), "left_semi").select("text").mapInArrow(run, "digest binary, shingles binary, weights binary")
    # an id may have other texts than the node's: the digest tells
    return own.join(nodes.select("digest", "node"), "digest").dropDuplicates(["digest"]).select("node", "shingles", "weights")


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        columns = [batch[c].to_pylist() for c in ("s1", "w1", "s2", "w2")]
        value = [similarity(np.frombuffer(s1, "<u8"), np.frombuffer(w1, "<u4"), np.frombuffer(s2, "<u8"), np.frombuffer(w2, "<u4")) for s1, w1, s2, w2 in zip(*columns)]
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(value, pa.float64())], names=["a", "b", "similarity"])


def verified(pairs: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose similarity is at least ``similar``, with it."""
    side = lambda n, k: sets.select(F.col("node").alias(n), F.col("shingles").alias(f"s{k}"), F.col("weights").alias(f"w{k}"))
    both = pairs.join(side("a", 1), "a").join(side("b", 2), "b").select("a", "b", "s1", "w1", "s2", "w2")
    return both.mapInArrow(_similar, "a bigint, b bigint, similarity double").where(F.col("similarity") >= similar)


LINKS_PER_TASK = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, class_id) of every node of the edges (a, b) but the smallest ones: the smallest node it is connected with.

    Large-star and small-star steps in turn: each ties a node's neighbours to the
    smallest of them, until every node is tied to its component's smallest one.
    Minima are aggregated before they meet the links, so a node with very many
    neighbours is split like any skewed join.
    """
    links = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while not _are_stars(links):
        tasks = 8 + links.count() // LINKS_PER_TASK
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("s"))
        links = materialize(small.select("s.*").where("u <> v").coalesce(tasks).distinct().coalesce(tasks), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("class_id"))


def _are_stars(links: DataFrame) -> bool:
    """Whether each node is tied to one node, and none of these to another."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("tied")), F.struct(F.col("v").alias("x"), F.lit(0).alias("tied")))).alias("e")).select("e.*")
    return ends.groupBy("x").agg(F.sum("tied").alias("tied"), F.min("tied").alias("least")).where("tied > 1 or (tied = 1 and least = 0)").isEmpty()


def near_classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, digest, n, class, class_id): the class of each distinct row, n being how often the row occurs."""
    signed = materialize(sign(docs), "signed")
    texts = signed.groupBy("digest").agg(F.min("doc_id").alias("text_id"), F.any_value("bands").alias("bands"))
    texts = materialize(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    nodes = texts.select("node", F.explode("bands").alias("bucket"))
    shared = nodes.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("bucket", "hub")
    members = materialize(nodes.join(shared, "bucket"), "members")
    involved = materialize(texts.select("node", "digest", "text_id").join(members.select("node").distinct(), "node"), "involved")
    sets = materialize(shingle_sets(docs, involved), "sets")

    stars = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    edges = materialize(verified(stars, sets, similar), "edges")
    groups = _open_groups(_open_nodes(members, components(edges)), sets, similar)
    edges = edges.select("a", "b").unionByName(_compare_blocks(groups, sets, similar))
    classes = components(edges)
    named = texts.select("digest", "text_id", "node").join(classes, "node", "left").select("digest", "text_id", F.coalesce("class_id", "node").alias("class"))
    names = named.groupBy("class").agg(F.min("text_id").alias("class_id"))
    rows = signed.groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    return rows.join(named.join(names, "class").select("digest", "class", "class_id"), "digest").select("doc_id", "digest", "n", "class", "class_id")


def _open_nodes(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, c): the nodes of buckets that hold several classes, with their classes."""
    known = members.join(classes, "node", "left").select("bucket", "node", F.coalesce("class_id", "node").alias("c"))
    known = materialize(known, "known")
    mixed = known.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("bucket")
    return materialize(known.join(mixed, "bucket").select("node", "c").distinct(), "open")


def prefix(shingles: np.ndarray, weights: np.ndarray, often: np.ndarray, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a set that a similar one must share one of, and whether they are in its own prefix as the smaller set.

    ``often`` puts the shingles in order; equal ones follow their hashes.
    """
    order = np.lexsort((shingles, often))
    n = len(order)
    smaller, larger = (n - math.ceil(n * x - 1e-9) + 1 for x in (2 * similar / (1 + similar), similar))
    if n and weights.max() > 1:
        total = np.cumsum(weights[order].astype(np.int64))
        heavy = int(np.searchsorted(total, (1 - similar) * total[-1] + 1e-6, side="right")) + 1
        smaller, larger = max(smaller, heavy), max(larger, heavy)
    return shingles[order[:larger]], np.arange(min(larger, n)) < smaller


def _frequent(sets: DataFrame, n_open: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that are frequent in a sample of the open nodes, and their counts."""
    step = max(1, n_open // ORDER_NODES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 100):
            found = [np.frombuffer(x, "<i8") for x in batch["shingles"].to_pylist()]
            value, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n.astype(np.int64))], names=["shingle", "n"])

    some = sets.where(F.pmod(F.xxhash64("node"), F.lit(step)) == 0).select("shingles")
    counts = some.mapInArrow(run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 2")
    table = counts.orderBy(F.desc("n"), "shingle").limit(ORDER_SHINGLES).toArrow()
    value, n = table["shingle"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(value)
    return value[order], n[order]


def _open_groups(nodes: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """(node, piece, pieces, work): groups of open nodes that share a shingle of their prefixes.

    Groups with the same nodes are one. A large group is cut into blocks, its pieces,
    and is a work of its own; small groups share works of about one block, and those
    with the same smallest node share one, as most groups of one passage do, unless
    they have more nodes or shingles together than a block.
    """
    n_open = nodes.count()
    own = sets.join(nodes, "node")
    known, often = _frequent(own, n_open)
    shared = nodes.sparkSession.sparkContext.broadcast((known, often))  # at most ORDER_SHINGLES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = shared.value
        for batch in slices(batches, 100):
            columns = [[], [], [], [], []]
            for node, c, s, w in zip(*(batch[x].to_pylist() for x in ("node", "c", "shingles", "weights"))):
                s, w = np.frombuffer(s, "<u8"), np.frombuffer(w, "<u4")
                at = np.minimum(np.searchsorted(known, s), max(0, len(known) - 1))
                found, smaller = prefix(s, w, np.where(known[at] == s, often[at], 0) if len(known) else np.zeros(len(s)), similar)
                for column, x in zip(columns, (found.view(np.int64), np.full(len(found), node), np.full(len(found), c), smaller, np.full(len(found), len(s)))):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], names=["shingle", "node", "c", "smaller", "size"])

    items = materialize(own.select("node", "c", "shingles", "weights").mapInArrow(run, "shingle bigint, node bigint, c bigint, smaller boolean, size bigint"), "prefixes")
    same = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"h{k}") for k in (1, 2)]
    groups = items.groupBy("shingle").agg(F.count("*").alias("n"), F.sum("size").alias("mass"), F.min("c").alias("low"), F.max("c").alias("high"), F.max("smaller").alias("smaller"), F.min("node").alias("head"), *same)
    groups = groups.where("low <> high and smaller").groupBy("n", "h1", "h2").agg(F.min("shingle").alias("shingle"), F.min("head").alias("head"), F.min("mass").alias("mass")).select("shingle", "n", "mass", "head")
    members = materialize(items.select("shingle", "node", "size").join(materialize(groups, "groups"), "shingle"), "grouped")
    one = F.lit(1)
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("mass") / BLOCK_SHINGLES)).cast("int")
    found = members.where(blocks > 1).select("node", blocks.alias("pieces"), F.col("shingle").cast("string").alias("work"))
    few, left = members.where(blocks <= 1), ["head"]
    # of the small groups those with the same smallest node are together if their nodes fit in a block, else those
    # with the same two smallest ones; what is left, of nodes that share shingles with very many others, is dealt by group
    for letter in ("s", "t"):
        unions = materialize(few.groupBy(*left, "node").agg(F.max("size").alias("size"), F.count("*").alias("n")).groupBy(*left).agg(F.count("*").alias("nodes"), F.sum("size").alias("mass"), F.sum("n").alias("n")), "unions")
        fits = (F.col("nodes") <= BLOCK) & (F.col("mass") <= BLOCK_SHINGLES)
        deal = _works(unions.where(fits))
        whole = few.join(unions.where(fits).select(*left), left, "left_semi")
        found = found.unionByName(whole.select("node", one.alias("pieces"), F.concat(F.lit(letter), F.pmod(F.xxhash64(*left), F.lit(deal)).cast("string")).alias("work")))
        few = few.join(unions.where(~fits).select(*left), left, "left_semi")
        if unions.where(~fits).isEmpty():
            break
        if letter == "s":
            second = few.groupBy("shingle").agg(F.min(F.when(F.col("node") != F.col("head"), F.col("node"))).alias("second"))
            few, left = materialize(few.join(second, "shingle"), "hubs"), ["head", "second"]
    else:
        deal = _works(few)
        found = found.unionByName(few.select("node", one.alias("pieces"), F.concat(F.lit("u"), F.pmod(F.xxhash64("shingle"), F.lit(deal)).cast("string")).alias("work")))
    return materialize(found.select("node", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int").alias("piece"), "pieces", "work").distinct(), "works")


def _works(rows: DataFrame) -> int:
    """How many works rows of (n, ...) or of single members make, of half a block each."""
    n = F.sum("n") if "nodes" in rows.columns else F.count("*")
    mass = F.sum("mass") if "nodes" in rows.columns else F.sum("size")
    total = rows.agg(n.alias("n"), mass.alias("mass")).first()
    return max(1, -(-2 * (total.n or 0) // BLOCK), -(-2 * (total.mass or 0) // BLOCK_SHINGLES))


def _links(table: pa.Table, similar: float) -> list[tuple[int, int]]:
    """Links that connect the classes of all members of one or two blocks, by whole shingle sets."""
    node = table["node"].to_numpy()
    sets = [np.frombuffer(x, "<u8") for x in table["shingles"].to_pylist()]
    weights = [np.frombuffer(x, "<u4") for x in table["weights"].to_pylist()]
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = n > 1
    column, kept = np.cumsum(often) - 1, often[at]
    row, at, weight = row[kept], column[at[kept]], np.concatenate(weights)[kept].astype(np.float32)
    heavy = np.array([len(w) > 0 and w.max() > 1 for w in weights])
    common, mass = np.zeros((2, len(sets), len(sets)), np.float32)  # mass[i, j]: the weight in i of what j has too
    for low in range(0, int(often.sum()), 4096):  # a stripe of shingles at a time bounds the matrix
        own = (at >= low) & (at < low + 4096)
        stripe = np.zeros((len(sets), 4096), np.float32)
        stripe[row[own], at[own] - low] = 1
        common += stripe @ stripe.T
        if heavy.any():
            weighted = np.zeros_like(stripe)
            weighted[row[own], at[own] - low] = weight[own]
            mass += weighted @ stripe.T
    jaccard = common / np.maximum(size[:, None] + size[None, :] - common, 1)
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    found = []
    # links between members that are connected already are left out
    for i in range(len(sets)):
        for j in i + 1 + np.flatnonzero(jaccard[i, i + 1 :] >= similar):
            if find(i) != find(j):
                root[find(j)] = find(i)
                found.append((i, j))
    if heavy.any():  # repeated shingles can make weights more alike than sets, but no more than their common share
        share = mass / np.maximum(np.array([w.sum() for w in weights], np.float32), 1)[:, None]
        maybe = (np.minimum(share, share.T) >= similar - 1e-4) & (jaccard < similar) & (heavy[:, None] | heavy[None, :])
        for i, j in zip(*np.nonzero(np.triu(maybe, 1))):
            if find(i) != find(j) and similarity(sets[i], weights[i], sets[j], weights[j]) >= similar:
                root[find(j)] = find(i)
                found.append((i, j))
    return [(min(node[i], node[j]), max(node[i], node[j])) for i, j in found]


def _compare_blocks(groups: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) of the groups' members. A member goes to as many tasks as its group has blocks."""

    def run(table: pa.Table) -> pa.Table:
        links = _links(table, similar)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    spread = groups.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    spread = spread.select("node", "work", F.least("piece", "other").alias("one"), F.greatest("piece", "other").alias("two"))
    return materialize(spread.join(sets, "node").groupBy("work", "one", "two").applyInArrow(run, "a bigint, b bigint"), "edges")


def _winners(rows: DataFrame) -> DataFrame:
    """Per class: class, class_size, and doc_id and digest of the row that stays (as ``first``)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    return rows.groupBy("class").agg(F.sum("n").alias("class_size"), first.alias("first"))


def _wins() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """A row per document: doc_id, class_id (the smallest id of its class), class_size, kept."""
    rows = settled(docs.sparkSession, "classes", lambda: near_classes(docs, similar))
    named = rows.join(_winners(rows), "class").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
    return named.select("doc_id", "class_id", "class_size", (_wins() & (F.col("copy") == 1)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One document of each class, with all its columns."""
    rows = settled(docs.sparkSession, "classes", lambda: near_classes(docs, similar))
    judged = rows.join(_winners(rows), "class").select("doc_id", "digest", "n", _wins().alias("wins"))
    return keep_winners(docs, materialize(judged, "judged"), with_digest)
