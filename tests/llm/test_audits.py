"""Quality rules, Merkle manifest and source divergence against brute force, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from gridwright.llm import divergence, merkle, oracles, quality, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = ("n", "p", "q", "idx", "grp", "leaf", "digest", "members", "path", "term", "counts", "kept", "votes", "n_words", "item", "value")


def rows(sf=SF):
    return duckdb.connect().sql(f"select doc_id, text, lang, source, n_chars from '{sf}/documents.parquet'").fetchall()


def make(spark, data, extra=False):
    df = spark.createDataFrame(data, DOCS)
    for name in CLASHES if extra else ():
        df = df.withColumn(name, df["n_chars"])
    return df


ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", None, "", 3), (4, "one two", "en", "a", 7), (4, "one two", "en", "a", 7), (None, "one two", "en", None, 7), (None, None, "", "b", None), (5, "word " * 30000, "de", "c", 150000), (6, "Über Élan", "", None, 9)]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def merkle_brute(data):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, lg, s, n: h(*map(enc, (i, s, lg, n, t)))

    def tree(level):
        paths, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            runs = [level[k : k + 2] for k in range(0, len(level), 2)]
            for x, k in enumerate(at):
                run = runs[k // 2]
                paths[x].append(("".join(run[: k % 2]), "".join(run[k % 2 + 1 :])))
            level, at = [h(*r) for r in runs], [k // 2 for k in at]
        return level[0], paths

    by_lang = defaultdict(list)
    for i, t, lg, s, n in data:
        bad = leaf(i, t, lg, s, n + 1) if i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0 else None
        by_lang[lg].append(((i is not None, i or 0, leaf(i, t, lg, s, n)), i, bad))
    order = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lg: tree([k[2] for k, *_ in sorted(by_lang[lg], key=lambda r: r[0])]) for lg in order}
    root, crowns = tree([trees[lg][0] for lg in order])
    out = []
    for lg, crown in zip(order, crowns):
        for (key, i, bad), path in zip(sorted(by_lang[lg], key=lambda r: r[0]), trees[lg][1]):
            acc, whole = bad or key[2], path + crown
            for left, right in whole:
                acc = h(left, acc, right)
            out.append((i, key[2], trees[lg][0], root, h(*(a + b for a, b in whole)), acc, acc == root))
    return Counter(out)


def test_merkle_brute(spark):
    assert Counter(map(tuple, queries.op12_merkle(spark, SF).collect())) == merkle_brute(rows())


def test_merkle_odd(spark):
    assert Counter(map(tuple, merkle.audit(make(spark, ODD, extra=True)).collect())) == merkle_brute(ODD)
    assert merkle.audit(make(spark, [])).count() == 0
    one = merkle.audit(make(spark, ODD[:1])).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == h()


@pytest.mark.parametrize("size", [3, 17, 65])
def test_merkle_blocks_of_any_size(spark, size):
    """Rounds of two levels give the same tree as one of eight; a group of many equal rows spans several partitions."""
    data = [(7, "same", "en", "a", 4)] * (size // 2) + [(i, f"t{i}", "en", "a", 2) for i in range(size - size // 2)]
    want = merkle_brute(data)
    for depth in (2, 8):
        found = merkle.manifest(make(spark, data), depth=depth)
        leaf = merkle._text(found["leaf"])
        got = Counter(map(tuple, found.select("doc_id", leaf.alias("leaf"), "subroot", "root", merkle.proof_digest(found["path"]).alias("p")).collect()))
        assert got == Counter({k: v for k, v in Counter([x[:5] for x in want.elements()]).items()})


def test_wider_runs_fold_to_the_root(spark):
    found = merkle.manifest(make(spark, rows()), fan=5, depth=2)
    leaf = merkle._text(found["leaf"])
    assert found.where(merkle.fold(leaf, found["path"]) != found["root"]).count() == 0 and found.select("root").distinct().count() == 1


def divergence_brute(data, least):
    words = [((lg or "", s or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for _, t, lg, s, _ in data]
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for key, w in words:
        counts[key].update(w)
        df[key[0]].update(set(w))
    out = []
    for lang in {k[0] for k in counts}:
        kept = [t for t, n in df[lang].items() if n >= least]
        own = {s: {t: counts[lang, s][t] for t in kept} for lg, s in counts if lg == lang}
        p = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        ps, q = {s: p(c) for s, c in own.items()}, p({t: sum(c[t] for c in own.values()) for t in kept})
        for s in own:
            pairs = [(sum(abs(ps[s][t] - ps[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(ps[s][t] - q[t], t) for t in kept if own[s][t] > 0 and ps[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked[: 50 if part == "term" else None], 1)]
    return Counter(out)


@pytest.mark.parametrize("least", [3, 30])
def test_divergence_brute(spark, least):
    assert Counter(map(tuple, divergence.divergence(make(spark, rows()), least).collect())) == divergence_brute(rows(), least)


def test_divergence_odd(spark):
    for least in (1, 30):
        assert Counter(map(tuple, divergence.divergence(make(spark, ODD, extra=True), least).collect())) == divergence_brute(ODD, least)
    assert divergence.divergence(make(spark, [])).count() == 0
    assert divergence.divergence(make(spark, [(1, "a b", "en", "x", 3)])).count() == 0  # one source, no kept terms


def test_divergence_counts_are_handed_on(spark, monkeypatch):
    """A task that hands its counts on often gives the same sums; shares are exact where products would overflow."""
    monkeypatch.setattr(divergence, "HELD", 3)
    assert Counter(map(tuple, divergence.divergence(make(spark, rows()[:60]), 2).collect())) == divergence_brute(rows()[:60], 2)
    for count, total, kept in ((0, 0, 1), (8_999_999_999_999_990, 8_999_999_999_999_990, 2), (10**15 + 7, 7 * 10**15, 10**6)):
        got = spark.range(1).select(divergence.share(*map(divergence.F.lit, (count, total, kept)))).first()[0]
        assert got == 1 + 10**9 * (count + 5) // (total + 5 * kept)


def repeated_brute(words):
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    return len({p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 5)})


def test_measures_brute():
    rng = random.Random(5)
    texts = ["", " \t", "a", "a b c d e a b c d e", "x\nx\n x\nx\r\n\n", "Ünïcode ÀÉ 12 ٣  nb sp a\x0bb\x1cc"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) + rng.choice(["", ".", "\n\n.", " !!"]) for _ in range(200)]
    for text in texts + [t or "" for _, t, *_ in rows()]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        got = dict(zip(quality.MEASURES, quality.measure(text)))
        want = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeated_brute(words), "n_lines": len(lines), "n_same_words": sum(a == b for a, b in zip(words, words[1:])), "n_shouts": text.count("!"), "n_distinct": len(set(words))}
        assert {k: got[k] for k in want} == want
        assert got["n_letters"] == sum(c.isalpha() for c in text) and got["n_capitals"] <= got["n_letters"] <= got["n_plain"]


def test_estimate_finds_planted_accuracies():
    """Votes drawn from known rates: the estimate comes near them without a label, and beats the test that all must pass."""
    rng = np.random.default_rng(3)
    good = rng.random(20000) < 0.85
    rate = {True: [0.01, 0.03, 0.02, 0.15], False: [0.8, 0.7, 0.6, 0.5]}
    votes = np.stack([np.where(rng.random(len(good)) < np.where(good, rate[True][k], rate[False][k]), -1, np.where(rng.random(len(good)) < 0.3, 0, 1)) for k in range(4)], axis=1)
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, model = quality.estimate(patterns, counts.astype(float), held=0.001)
    assert abs(share - 0.85) < 0.05 and np.allclose(model[1][:, 0], rate[True], atol=0.05) and np.allclose(model[0][:, 0], rate[False], atol=0.1)
    odds = np.log(share / (1 - share)) + (np.log(model[1]) - np.log(model[0]))[np.arange(4), patterns + 1].sum(axis=1)
    right = ((odds > 0)[at.ravel()] == good).mean()
    assert right > 0.94 > ((votes >= 0).all(axis=1) == good).mean()


def test_quality_odd(spark):
    long = "A clean sentence of plain words that differ from one another. "
    data = [*ODD, (8, long, "en", "a", 1), (8, long, "en", "a", 1), (9, "$$$ %%% ### " * 3 + " ".join(f"w{i}%%%|" for i in range(40)), "en", "a", 1)]
    got = quality.judge(make(spark, data, extra=True)).collect()
    assert len(got) == len(data) and all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)
    assert Counter(r.doc_id for r in got if r.kept) == {8: 2} and not any(r.kept and r.base_failed for r in got)
    kept = quality.keep_good(make(spark, data, extra=True))
    assert Counter(r.doc_id for r in kept.collect()) == {8: 2} and kept.columns == make(spark, data, extra=True).columns
    assert quality.judge(make(spark, [])).count() == 0 and quality.keep_good(make(spark, [])).count() == 0


def test_quality_against_labels(spark):
    """On labelled rows nearly all good documents that pass the base test stay, and nearly all bad ones go."""
    sf = "/root/testdata/sf0.01"
    label = dict(duckdb.connect().sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall())
    got = [r for r in queries.op11_quality(spark, sf).collect() if r.doc_id in label and not r.base_failed]
    good, bad = ([r.kept for r in got if label[r.doc_id] == y] for y in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_new_queries_have_sql():
    assert {"op11_quality", "op12_merkle", "op13_divergence"} <= set(oracles.ORACLES) <= set(queries.QUERIES)
