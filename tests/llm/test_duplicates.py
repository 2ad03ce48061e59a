"""Near-duplicate classes and substring dedup against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import neardup, substrings
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def weights(text):
    w = WORD.findall(text or "")
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def prob_jaccard(a, b):
    """Sum over common elements of 1 / sum over all of max(a_j / a_i, b_j / b_i)."""
    every = set(a) | set(b)
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in every) for i in set(a) & set(b))


def groups(texts, least=0.8):
    """Smallest id of the component of every (id, text)."""
    own = [(i, t or "", weights(t)) for i, t in texts]
    up = list(range(len(own)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holds = defaultdict(list)
    for k, (_, t, w) in enumerate(own):
        for s in w or ["", t]:
            holds[s].append(k)
    pairs = {(a, b) for ks in holds.values() for x, a in enumerate(ks) for b in ks[x + 1 :]}
    for a, b in sorted(pairs):
        if own[a][1] == own[b][1] or root(a) != root(b) and prob_jaccard(own[a][2], own[b][2]) >= least - 1e-9:
            up[max(root(a), root(b))] = min(root(a), root(b))
    best = {}
    for k, (i, _, _) in enumerate(own):
        r = root(k)
        best[r] = i if best.get(r) is None else min(x for x in (i, best[r]) if x is not None)
    return Counter((own[k][0], best[root(k)]) for k in range(len(own)))


def test_op8_equals_brute_force(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert Counter(map(tuple, QUERIES["op8_probminhash"](spark, SF).collect())) == groups(texts)


def near(n, seed=3, words=220):
    """A text and copies of it with a few words changed."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        c = list(base)
        for _ in range(rng.randrange(0, 5)):
            c[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(c))
    return out


def test_op8_groups_ties_nulls(docs):
    rows = [(i, t) for i, t in enumerate(near(60))] + [(100 + i, t) for i, t in enumerate(near(40, 4))] + [(200, "a b"), (201, "a b"), (202, "a  b"), (203, None), (204, ""), (205, None), (206, "a b c"), (5, "other words here in full " * 3)]
    rows += [(None, "null id text one two three"), (300, "null id text one two three"), (301, "z " * 30000), (302, "z " * 29000), (0, near(1)[0]), (0, near(1)[0])]
    d = docs(*rows, extra=True)
    want = groups(rows)
    got = neardup.classes(d).select("doc_id", "class_id")
    assert Counter(map(tuple, got.collect())) == want
    kept = neardup.keep(d)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {c for _, c in want}
    assert neardup.classes(d.limit(0)).count() == 0 == neardup.keep(d.limit(0)).count()


def test_op8_keeps_one_of_each_group(docs):
    rows = [(i, t) for i, t in enumerate(near(30))] + [(50, "quite another text of seven words"), (51, "quite another text of seven words"), (51, "quite another text of seven words")]
    assert sorted(r.doc_id for r in neardup.keep(docs(*rows)).collect()) == sorted({c for _, c in groups(rows)})


def test_op8_chain_of_links(docs):
    """A bucket's links that its leaders don't see still join."""
    rng = random.Random(1)
    w = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(25):  # each text differs from the one before in a few words: ends of the chain are unlike
        rows.append((i, " ".join(w)))
        w[rng.randrange(200)] = f"y{i}"
    assert Counter(map(tuple, neardup.classes(docs(*rows)).select("doc_id", "class_id").collect())) == groups(rows)


def test_op8_registers_estimate_the_similarity():
    a = {k: 1 + k % 3 for k in range(300)}
    b = {k: 1 + k % 3 + (k % 7 == 0) for k in range(40, 330)}
    keys = np.array([*a, *b], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sig = neardup.prob_min_hash(np.repeat([0, 1], [len(a), len(b)]), keys, np.array([*a.values(), *b.values()], float), 2, 4096)
    want = prob_jaccard(Counter(a), Counter(b))
    arrays = [(np.array(list(x), dtype=np.uint64), np.array(list(x.values()))) for x in (a, b)]
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04 and abs(neardup.similarity(*arrays) - want) < 1e-9


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 103), (103, 101)], "a long, b long")
    got = {r.node: r.component for r in neardup.components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 103: 100}


def struck(rows, window=50):
    first = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - window + 1):
            if i is not None:
                s = tuple(w[k : k + window])
                first[s] = min(first.get(s, i), i)
    out = []
    for i, w in words:
        gone = {j for k in range(len(w) - window + 1) if i is not None and first[tuple(w[k : k + window])] < i for j in range(k, k + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_op10_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert Counter(map(tuple, QUERIES["op10_substring_dedup"](spark, SF).collect())) == struck(rows)


def passages(seed=5):
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(3000)}"
    shared = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 130)]
    rows = []
    for i in range(60):
        t = [word() for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            a = rng.randrange(0, 10)
            t += p[a:] if rng.random() < 0.5 else p
            t += [word() for _ in range(rng.randrange(0, 30))]
        rows.append((rng.randrange(1000), rng.choice([" ", "\n", "  "]).join(t)))
    return rows


@pytest.mark.parametrize("shard", [2048, 8])
def test_op10_passages(docs, shard):
    """Also with shards so small that most anchors are hot."""
    rows = passages() + [(5, None), (6, ""), (None, passages()[3][1]), (7, "r " * 300), (2000, "r " * 120), (2001, "a b " * 200), (2002, "b a " * 200), (7, "r " * 300), (3000, "x\x0by z   " * 80), (3001, "x\x0by z   " * 80)]
    d = substrings.dedup(docs(*rows, extra=True), shard=shard)
    got = d.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("s"))
    assert Counter(map(tuple, got.collect())) == struck(rows)


def test_op10_empty_and_many(docs):
    assert substrings.dedup(docs((1, "a")).limit(0)).count() == 0
    base = " ".join(f"p{i}" for i in range(70))
    rows = [(i, f"start{i} {base} end{i} " + " ".join(f"q{i}_{j}" for j in range(60))) for i in range(80)]
    got = substrings.dedup(docs(*rows), shard=16).select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("s"))
    assert Counter(map(tuple, got.collect())) == struck(rows)


def test_op10_automaton_tells_the_earliest():
    rng = random.Random(2)
    texts = [[rng.choice("abc") for _ in range(rng.randrange(1, 40))] for _ in range(30)]
    a = substrings.Automaton()
    marks = [rng.randrange(100) for _ in texts]
    for t, m in zip(texts, marks, strict=True):
        a.add(t, m)
    a.close()
    for window in (1, 3, 6):
        for t in [*texts, list("abcabdcab"), list("ddd")]:
            want = [min((m for s, m in zip(texts, marks, strict=True) if any(s[j : j + window] == t[i : i + window] for j in range(len(s) - window + 1))), default=None) for i in range(len(t) - window + 1)]
            assert list(a.earliest(t, window)) == want


def test_op8_prefixes_lose_no_pair(spark):
    """Every pair at the similarity, of texts with and without repeated shingles, is among the pairs that the prefixes propose."""
    rng = random.Random(9)
    texts = near(40, 7, 60) + near(25, 8, 80) + [" ".join(rng.choice("abc") for _ in range(rng.randrange(5, 40))) for _ in range(60)]
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "node long, c long, text string")
    got = {tuple(r) for r in neardup.prefix_pairs(df).collect()}
    w = [weights(t) for t in texts]
    want = {(i, j) for i in range(len(w)) for j in range(i + 1, len(w)) if prob_jaccard(w[i], w[j]) >= 0.8}
    assert want <= got and len(want) > 100
