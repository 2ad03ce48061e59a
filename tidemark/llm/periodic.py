"""Periodic runs of words: where a text repeats itself at a fixed distance.

A run of period q is a stretch of words in which words q apart are equal, q its smallest period, at least three periods and
``least`` words long, and longer on neither side. Runs are enumerated on harmonic grids: a run of period p holds three
neighbouring multiples of p, so for each p only the grid points 0, p, 2p, ... with equal words are looked at (n / p of them, n log n
in all), and the longest common extensions (LCE) to both sides of two neighbours give the run.

An LCE takes constant time. Only suffixes at the positions of a difference cover (4 of 13) are sorted, by names of blocks of 13 words
and doubling. Two positions reach cover positions after the same 0 to 12 words, which are compared one by one; from there the least
LCP between the ranks of the two suffixes (a sparse table for range minima) counts equal blocks, and at most 12 words more end it.

Texts of a slice of a batch are taken together, a separator of its own between any two, so that short texts don't cost a call each.
A text is seen whole and alone: rows aren't shuffled, a lost task is done again from its rows.

Defined results: null, empty or blank text: no words, no runs, an empty collapsed text; repeated rows each get their row; an empty table
gives no rows; further columns stay, inside ``row``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.hashing import split_words
from tidemark.llm.shared import slices

LEAST, TIMES = 24, 3
SLICE_CHARS = 4_000_000  # of text that one step holds as arrays
#: A perfect difference cover; any two residues modulo 13 have equal distance to members of it.
MODULUS, COVER = 13, (0, 1, 3, 9)
RUN = T.StructType().add("start", "long").add("length", "long").add("period", "long")


def _shifts() -> np.ndarray:
    """The words from residues (a, b) to the next cover positions of both."""
    out = np.zeros((MODULUS, MODULUS), np.int64)
    for a in range(MODULUS):
        for b in range(MODULUS):
            out[a, b] = min(d for d in range(MODULUS) if (a + d) % MODULUS in COVER and (b + d) % MODULUS in COVER)
    return out


SHIFT = _shifts()


def _rank(*keys: np.ndarray) -> np.ndarray:
    """Ranks of rows by their keys in turn; equal rows share one."""
    out = np.unique(keys[0], return_inverse=True)[1].ravel()
    for k in keys[1:]:
        k = k - k.min()
        out = np.unique(out * (int(k.max()) + 1) + k, return_inverse=True)[1].ravel()
    return out


class CoverLCE:
    """Longest common extensions to the right inside ``words``; ``part`` numbers the texts, which end in words of their own."""

    def __init__(self, words: np.ndarray, part: np.ndarray):
        v, n = MODULUS, len(words)
        self.words = np.concatenate([words, np.full(2 * v, -1, np.int64)])
        places = [np.arange(d, n, v) for d in COVER]
        pos = np.concatenate(places)
        ends = np.cumsum([len(p) for p in places])
        self.offset = np.zeros(v, np.int64)
        self.offset[list(COVER)] = np.concatenate([[0], ends[:-1]])
        last = np.repeat(ends, [len(p) for p in places])  # where the row of blocks of a position ends
        at = np.arange(len(pos))
        blocks = [self.words[pos + k] for k in range(v)]
        while len(blocks) > 1:
            blocks = [_rank(*blocks[k : k + 2]) for k in range(0, len(blocks), 2)]
        levels, step = [_rank(part[pos], blocks[0])], 1  # equal names only inside a text
        while int(levels[-1].max(initial=0)) + 1 < len(pos):
            there = at + step
            follow = np.where(there < last, levels[-1][np.minimum(there, len(pos) - 1)] + 1, 0)
            levels.append(_rank(levels[-1], follow))
            step *= 2
        self.rank = levels[-1]
        order = np.argsort(self.rank)
        lcp = np.zeros(len(pos), np.int64)
        tied = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
        a, b = order[tied - 1].copy(), order[tied].copy()
        for k in range(len(levels) - 1, -1, -1):
            inside = (a < last[order[tied - 1]]) & (b < last[order[tied]])
            same = inside & (levels[k][np.minimum(a, len(pos) - 1)] == levels[k][np.minimum(b, len(pos) - 1)])
            a, b = a + (same << k), b + (same << k)
        lcp[tied] = a - order[tied - 1]
        edges = np.flatnonzero(lcp == 0)
        self.reach = int(np.diff(np.concatenate([edges, [len(lcp)]])).max(initial=1))  # no wider range has an LCP
        self.least = [lcp]
        while 2 << len(self.least) - 1 <= self.reach:
            half = 1 << len(self.least) - 1
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def _blocks(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal blocks from cover positions i and j on."""
        a, b = (self.rank[self.offset[x % MODULUS] + x // MODULUS] for x in (i, j))
        lo, wide = np.minimum(a, b) + 1, np.abs(a - b)
        out, near = np.zeros(len(i), np.int64), wide <= self.reach
        level = np.zeros(len(i), np.int64)
        level[near] = np.frexp(wide[near].astype(float))[1] - 1
        for k in np.unique(level[near]):
            x = near & (level == k)
            table = self.least[k]
            out[x] = np.minimum(table[lo[x]], table[lo[x] + wide[x] - (1 << k)])
        return out

    def _direct(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, up to ``most`` (below the modulus) of them."""
        out, live = np.zeros(len(i), np.int64), np.arange(len(i))
        for t in range(MODULUS):
            live = live[most[live] > t]
            live = live[self.words[i[live] + t] == self.words[j[live] + t]]
            if not len(live):
                break
            out[live] += 1
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        shift = SHIFT[i % MODULUS, j % MODULUS]
        out = self._direct(i, j, shift)
        on = np.flatnonzero(out == shift)
        if len(on):
            a, b = i[on] + shift[on], j[on] + shift[on]
            far = MODULUS * self._blocks(a, b)
            out[on] += far + self._direct(a + far, b + far, np.full(len(on), MODULUS))
        return out


def grid_points(words: np.ndarray, start: np.ndarray, size: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """(i, p): multiples i of p, counted from the start of their text, with equal words at i, i + p, ..., i + (times - 1) p."""
    long = np.argsort(-size, kind="stable")
    start, size = start[long], size[long]
    start, size = start[size >= least], size[size >= least]
    at, period = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p in range(1, int(size.max(initial=0)) // times + 1):
        k = int(np.searchsorted(-size, -times * p, side="right"))
        count = (size[:k] - 1) // p - times + 2
        total = int(count.sum())
        i = np.repeat(start[:k] - p * (np.cumsum(count) - count), count) + p * np.arange(total)
        for t in range(1, times):
            i = i[words[i] == words[i + p * t]]
        if len(i):
            at.append(i)
            period.append(np.full(len(i), p))
    return np.concatenate(at), np.concatenate(period)


def runs(ids: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each sequence of word ids, by start, then period."""
    size = np.array([len(x) for x in ids], np.int64)
    joined, start = np.concatenate([np.zeros(0, np.int64), *ids]), np.cumsum(size) - size
    i, p = grid_points(joined, start, size, least, times)
    out: list[list[tuple[int, int, int]]] = [[] for _ in ids]
    if not len(i):
        return out
    own = np.searchsorted(start + size, i, side="right")
    there = np.unique(own)  # texts with a grid point; between them stand words that occur once
    low = int(joined.max()) + 1
    line, place = [np.array([low])], np.zeros(len(ids), np.int64)
    at = 1
    for k, d in enumerate(there):
        place[d] = at
        line += [ids[d], np.array([low + 1 + k])]
        at += size[d] + 1
    line = np.concatenate(line)
    part = np.concatenate([[0], np.repeat(np.arange(len(there)), size[there] + 1)])
    i = i - start[own] + place[own]
    right = CoverLCE(line, part)(i, i + p)
    end = len(line) - 1
    left = CoverLCE(line[::-1].copy(), part[::-1].copy())(end - i + 1, end - i - p + 1)
    first, stop = i - left, i + p + right
    good = stop - first >= np.maximum(least, times * p)
    found = pd.DataFrame({"d": own[good], "s": first[good], "e": stop[good], "p": p[good]}).groupby(["d", "s", "e"], as_index=False)["p"].min()
    found = found.sort_values(["d", "s", "p"])
    for d, s, e, q in zip(found["d"], found["s"], found["e"], found["p"], strict=True):
        out[d].append((int(s - place[d]), int(e - s), int(q)))
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> str:
    """The words joined by a space, each run cut down to its first period."""
    if found:
        depth = np.zeros(len(words) + 1, np.int64)
        for s, n, q in found:
            depth[s + q] += 1
            depth[s + n] -= 1
        kept = np.flatnonzero(np.cumsum(depth)[:-1] == 0)
        words = [words[k] for k in kept.tolist()]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def find_runs(docs: DataFrame, text: Column | str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """row, n_words, runs, collapsed of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for i, j in slices([len(t or "") for t in texts], SLICE_CHARS):
                split = [split_words(t) for t in texts[i:j]]
                flat = np.array([w for ws in split for w in ws], dtype=object)
                ids = pd.factorize(flat)[0].astype(np.int64) if len(flat) else np.zeros(0, np.int64)
                cuts = np.cumsum([len(ws) for ws in split])[:-1]
                found = runs(np.split(ids, cuts), least, times)
                told = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in f] for f in found],
                                pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
                words = pa.array([len(ws) for ws in split], pa.int64())
                rest = pa.array([collapsed(ws, f) for ws, f in zip(split, found, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, j - i), words, told, rest], ["row", "n_words", "runs", "collapsed"])

    text = F.col(text) if isinstance(text, str) else text
    own = docs.select(F.struct(*(docs[c] for c in docs.columns if c != "text")).alias("row"), text.alias("_text"))
    told = T.StructType([own.schema["row"]]).add("n_words", "long").add("runs", T.ArrayType(RUN)).add("collapsed", "string")
    return own.mapInArrow(run, told)
