"""Hard negatives, periodic runs and the Jaccard join against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.llm import hardneg, periodic, prefixtree
from tidemark.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- hard negatives ---------------------------------------------------------------------

def mined(rows, every=5):
    rows = {i: (label, v) for i, label, v in sorted(rows, key=lambda r: (-r[0], -r[1], [-x for x in r[2]]))}  # of one id, the smallest
    out = []
    for a in (i for i in rows if i % every == 0):
        score = {i: sum(x * y for x, y in zip(rows[a][1], v)) for i, (_, v) in rows.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if rows[i][0] == rows[a][0]][:5]:
            near = [i for i in order if rows[i][0] != rows[a][0] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:3]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(near)]
    return sorted(out)


def table(spark, rows):
    return hardneg.usable(spark.createDataFrame(rows, "vec_id long, vector array<double>, label int, more string"), F.col("vec_id"), F.col("vector"), F.col("label"))


@pytest.mark.parametrize("shard,codes", [(16384, 16), (20, 4), (7, 3)])
def test_op11_equals_brute_force(spark, shard, codes):
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), [float(rng.randrange(-9, 10)) for _ in range(5)]) for i in range(90)]
    rows += [(i, rng.randrange(3), [4.0, 4.0, 4.0, 4.0, 4.0]) for i in range(90, 160)]  # ties, and a cell above a shard
    given = [(i, v, label, "x") for i, label, v in rows]
    odd = [(500, None, 1, "x"), (505, [1.0, None, 1.0, 1.0, 1.0], 1, "x"), (510, [1.0] * 5, None, "x"), (515, [float("nan")] * 5, 1, "x"), (520, [float("inf")] * 5, 1, "x"), (None, [1.0] * 5, 1, "x"),
           (525, [1.0] * 4, 1, "x"), (530, [], 0, "x"), given[0], given[7]]
    got = hardneg.mine(table(spark, given + odd), F.col("vec_id") % 5 == 0, shard_rows=shard, codes=codes)
    assert sorted(map(tuple, got.collect())) == mined(rows) and len(mined(rows)) > 100


@pytest.mark.parametrize("wide", [0, 1, 2])
def test_op11_few_components_one_label_empty(spark, wide):
    rng = random.Random(wide)
    rows = [(i, i % 2, [float(rng.randrange(-5, 6)) for _ in range(wide)]) for i in range(30)]
    got = hardneg.mine(table(spark, [(i, v, label, "") for i, label, v in rows]), F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == mined(rows)
    alone = table(spark, [(i, [1.0, 2.0], i, "") for i in range(6)])
    assert hardneg.mine(alone, F.col("vec_id") % 5 == 0).count() == 0 == hardneg.mine(alone.limit(0), F.col("vec_id") % 5 == 0).count()


def test_op11_heap_stops_before_the_end():
    """Cells come in falling order of bounds that hold, and a search with clusters doesn't look at all of them."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-200, 200, (12, 8))
    x = (centres[rng.integers(0, 12, 3000)] + rng.integers(-3, 4, (3000, 8))).astype(float)
    books = [hardneg.codebook(x[:, :4], 12), hardneg.codebook(x[:, 4:], 12)]
    own = [hardneg.nearest(x[:, :4], books[0]), hardneg.nearest(x[:, 4:], books[1])]
    index = hardneg.MultiIndex(np.arange(3000), np.zeros(3000, int), x, *own, books)
    seen = list(index.visits(x[0]))
    assert sorted(k for _, s, e in seen for k in range(s, e)) == list(range(3000)) and all(a[0] >= b[0] for a, b in zip(seen, seen[1:]))
    assert all((index.vectors[s:e] @ x[0]).max() <= bound for bound, s, e in seen)
    looked = []
    index.visits = lambda q, every=index.visits: (looked.append(v) or v for v in every(q))
    best = index.positives(x[0], 0, 0, None, 5)
    score = x @ x[0]
    want = sorted(range(1, 3000), key=lambda i: (-score[i], i))[:5]
    assert best == [(i, int(score[i])) for i in want] and len(looked) < len(seen) / 2


# --- periodic runs ----------------------------------------------------------------------

def runs_of(w, least=24, times=3):
    n, best = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def repeats(seed, n=60):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = []
        for _ in range(rng.randrange(5)):
            unit = [f"u{rng.randrange(rng.choice([1, 2, 60]))}" for _ in range(rng.randrange(1, 16))]
            w += (unit * 40)[: rng.randrange(160)] + [f"v{rng.randrange(4)}" for _ in range(rng.randrange(40))]
        out.append(w)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_op12_runs_equal_brute_force(seed):
    texts = repeats(seed)
    number = defaultdict(lambda: len(number))
    assert periodic.runs([np.array([number[x] for x in w], np.int64) for w in texts]) == [runs_of(w) for w in texts]


def test_op12_extensions_equal_brute_force():
    rng = np.random.default_rng(1)
    w = np.concatenate([rng.integers(0, 2, 300), np.tile(rng.integers(0, 3, 11), 30), [9]])
    lce = periodic.CoverLCE(w, np.zeros(len(w), np.int64))
    i, j = np.sort(rng.integers(0, len(w) - 1, (2, 4000)), axis=0)
    i, j = i[i < j], j[i < j]
    want = [next(k for k in range(len(w)) if b + k >= len(w) or w[a + k] != w[b + k]) for a, b in zip(i.tolist(), j.tolist())]
    assert lce(i, j).tolist() == want and max(want) > 100


def digests(doc, w):
    found = runs_of(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    told = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc, len(found), top[0], top[1], top[2], 1000 * top[1] // top[2] if top[0] is not None else None, sha(told), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op12_query_equals_brute_force(spark, docs, tmp_path):
    rows = [(i, " ".join(w)) for i, w in enumerate(repeats(11, 80))] + [(900, None), (901, ""), (902, " \t "), (903, "a\x0bb  c " * 30), (904, "x " * 5000), (7, "r " * 24), (7, "r " * 24), (None, "n " * 30), (905, "r " * 23)]
    rows += [(1000 + i, " ".join(f"w{i}_{k}" for k in range(90 + i))) for i in range(60)]  # planted ones
    docs(*rows, extra=True).write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for doc, text in rows:
        w, h = WORD.findall(text or ""), 1 if doc is None else zlib.crc32(str(doc).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        want.append(digests(doc, w))
    got = QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == Counter(want) and sum(w[1] > 0 for w in want[-60:]) > 2


def test_op12_empty_and_own_rows(docs):
    d = docs((1, "a b " * 30), (2, None), extra=True)
    got = periodic.find_runs(d).orderBy("n_words").collect()
    assert [r.n_words for r in got] == [0, 60] and got[1].row.key == "x" and got[1].collapsed == "a b" and got[0].collapsed == ""
    assert periodic.find_runs(d.limit(0)).count() == 0


# --- Jaccard join -----------------------------------------------------------------------

def shingled(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def joined(rows):
    own = [(i, shingled(t)) for i, t in rows]
    up = list(range(len(own)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holds = defaultdict(list)
    for k, (_, s) in enumerate(own):
        for g in s:
            holds[g].append(k)
    shared = Counter((a, b) for ks in holds.values() for x, a in enumerate(ks) for b in ks[x + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= 80 * len(own[a][1] | own[b][1]):
            up[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, _) in enumerate(own):
        r = root(k)
        least[r] = i if least.get(r) is None else min(x for x in (i, least[r]) if x is not None)
    return Counter((own[k][0], len(own[k][1]), least[root(k)]) for k in range(len(own)))


def families(seed=3):
    """Texts with a few words changed, chains of changes, and one passage that many unlike texts share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    rows, passage = [], [word() for _ in range(60)]
    for f in range(4):
        base = [word() for _ in range(rng.randrange(8, 260))]
        for _ in range(30):
            c = list(base)
            for _ in range(rng.randrange(5)):
                c[rng.randrange(len(c))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(c))
            if f == 3:
                base = c
    rows += [" ".join([word() for _ in range(rng.randrange(40))] + passage + [word() for _ in range(rng.randrange(40))]) for _ in range(60)]
    return list(enumerate(rows))


@pytest.mark.parametrize("chunk", [256, 5])
def test_op13_equals_brute_force(docs, chunk):
    rows = families() + [(700, None), (701, ""), (702, " \n "), (703, "one two"), (704, "ONE  two"), (705, "one two three"), (706, "z " * 20000), (707, "Z " * 300), (708, "Ärger IST gut so ja"), (709, "ärger ist gut so ja"), (3, families()[3][1]), (3, families()[3][1])]
    rows += [(None, families()[70][1]), (None, "quite alone here with nobody at all"), (None, None)]
    got = prefixtree.linked(docs(*rows, extra=True), chunk=chunk)
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == joined(rows)


def test_op13_empty(docs):
    assert prefixtree.linked(docs((1, "a")).limit(0)).count() == 0
    assert [tuple(r) for r in prefixtree.linked(docs((4, None))).collect()] == [(4, 0, 4)]


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_op13_tree_finds_every_link(percent):
    rng = random.Random(percent)
    base = sorted(rng.sample(range(10**6), 60))
    sets = [sorted(set(rng.sample(base, rng.randrange(1, 60))) | set(rng.sample(range(10**6), rng.randrange(5)))) for _ in range(40)]
    sets += [sorted(set(base) - set(rng.sample(base, rng.randrange(6)))) for _ in range(40)]
    sizes = [len(s) + rng.randrange(3) for s in sets]  # some shingles of a set may be in no other one
    tree = prefixtree.PrefixTree(list(range(len(sets))), sizes, [np.array(s) for s in sets])
    label = np.arange(len(sets))
    for k, s in enumerate(sets):
        got = {tree.nodes[x] for x in tree.links(sizes[k], np.array(s), percent, label, lambda: -1)}
        want = {j for j, t in enumerate(sets) if (100 + percent) * len(set(s) & set(t)) >= percent * (sizes[k] + sizes[j])}
        assert got == want


def test_op13_heads_keep_every_linked_set():
    """Two linked sets share enough of their first shingles, whatever the order."""
    rng = random.Random(8)
    for _ in range(300):
        common = rng.randrange(1, 80)
        a, b = rng.randrange(common // 4 + 1), rng.randrange(common // 4 + 1)
        if 100 * common < 80 * (common + a + b):
            continue
        order = list(range(common + a + b))
        rng.shuffle(order)
        x, y = sorted(order[: common + a]), sorted(order[:common] + order[common + a :])
        (hx, nx), (hy, ny) = (prefixtree._head(len(s), 80) for s in (x, y))
        both = len(set(x[:hx]) & set(y[:hy]))
        assert both >= nx and both >= ny
