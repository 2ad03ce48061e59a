"""Hard negatives by exact inner-product search in an inverted multi-index.

A vector is cut into two halves, each with a codebook of its own (k-means on a bounded sample, in whole numbers of rows); a pair of
codewords is a cell. For a query, a codeword bounds its half of any score: inner product with the codeword plus the length of the
query's half times the codeword's radius (the largest distance of a row to it). The multi-sequence heap takes cells in falling
order of the sum of the two bounds, so once that sum is below what a query still needs, no unseen row counts: the result is exact.

Rows of neighbouring cells are dealt to shards of bounded size, a cell above that size to several. A task keeps one shard with its radii
and streams the queries that come to it. A query first visits the shard of its best cell, then the others whose best cell may still reach
its fifth positive, and, its positives known, the shards whose best cell reaches the lowest of its windows. Queries and shards meet in
one shuffle by shard; the driver holds the codebooks and one row a cell, as many as pairs of codewords at most.

Defined results: a row takes part if it has an id, a label and a vector of finite components whose length is the table's most frequent one
(of ties, the longest). Rows of one id count as one: that with the smallest label and vector. Components are whole numbers below 2**20.
Equal scores go by smaller id. An anchor without other rows of its label has no rows; an empty table gives none; further columns don't count.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import written

CODES, SAMPLE, ROUNDS = 16, 20_000, 8
SHARD_ROWS = 16_384
POSITIVES, NEGATIVES = 5, 3
LOWEST, HIGHEST = 50, 95  # per cent of the positive's score
SLACK = 1e-9  # of a bound, for rounding: scores are whole, bounds are not

VECTOR = "array<double>"


def usable(rows: DataFrame, vec_id: Column, vector: Column, label: Column) -> DataFrame:
    """vec_id, label, vector of the rows that take part, once an id."""
    x = rows.select(vec_id.cast("long").alias("vec_id"), label.cast("long").alias("label"), vector.cast(VECTOR).alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    x = x.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    size = x.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("rows")).agg(F.max(F.struct("rows", "n"))["n"].alias("_n"))
    x = x.join(F.broadcast(size), F.size("vector") == F.col("_n")).drop("_n")
    return x.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("x")).select("vec_id", "x.label", "x.vector")


def codebook(points: np.ndarray, codes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's k-means from points far apart in rank; the centres that some point has."""
    points = np.unique(points, axis=0)
    centres = points[np.linspace(0, len(points) - 1, min(codes, len(points))).astype(int)] if len(points) else points
    for _ in range(rounds):
        own = nearest(points, centres)
        centres = np.array([points[own == k].mean(axis=0) for k in range(len(centres)) if (own == k).any()])
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)


class MultiIndex:
    """Rows of one shard in cells; exact search for a query."""

    def __init__(self, ids, labels, vectors, first, second, books):
        order = np.lexsort((ids, second, first))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        first, second = first[order], second[order]
        self.half = books[0].shape[1]
        left, right = self.vectors[:, : self.half], self.vectors[:, self.half :]
        self.codes, self.radius = [], []
        for own, x, book in ((first, left, books[0]), (second, right, books[1])):
            used = np.unique(own)
            far = np.zeros(len(book))
            np.maximum.at(far, own, np.sqrt(((x - book[own]) ** 2).sum(axis=1)))
            self.codes.append((used, book[used]))
            self.radius.append(far[used])
        key = first * len(books[1]) + second
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        stop = np.concatenate([start[1:], [len(key)]])
        self.cells = {(int(first[s]), int(second[s])): (int(s), int(e)) for s, e in zip(start, stop, strict=True)}

    def visits(self, query: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """Cells as (bound, start, stop) in falling order of the bound of their scores."""
        sides = []
        for part, (used, book), radius in zip((query[: self.half], query[self.half :]), self.codes, self.radius, strict=True):
            bound = book @ part + np.sqrt(part @ part) * radius
            order = np.argsort(-bound)
            sides.append((bound[order].tolist(), used[order].tolist()))
        (a, first), (b, second) = sides
        heap = [(-(a[0] + b[0]), 0, 0)] if a and b else []
        while heap:
            minus, i, j = heapq.heappop(heap)
            cell = self.cells.get((first[i], second[j]))
            if cell:
                yield -minus + SLACK * (1 + abs(minus)), *cell
            if j + 1 < len(b):
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))

    def positives(self, query, vec_id, label, least, most) -> list[tuple[int, int]]:
        """The first ``most`` (id, score) of the same label with scores of at least ``least`` (None: any)."""
        best: list[tuple[float, int]] = []
        floor = -np.inf if least is None else least
        for bound, s, e in self.visits(query):
            if bound < floor:
                break
            score = self.vectors[s:e] @ query
            good = np.flatnonzero((self.labels[s:e] == label) & (score >= floor) & (self.ids[s:e] != vec_id))
            if len(good):
                ids, score = self.ids[s:e][good], score[good]
                top = np.lexsort((ids, -score))[:most]
                best = sorted(best + list(zip((-score[top]).tolist(), ids[top].tolist(), strict=True)))[:most]
                if len(best) == most:
                    floor = max(floor, -best[-1][0])
        return [(i, int(-s)) for s, i in best]

    def negatives(self, query, label, windows, most) -> list[list[tuple[int, int]]]:
        """For each window (lowest, highest) the first ``most`` (id, score) of other labels inside it."""
        best: list[list[tuple[float, int]]] = [[] for _ in windows]
        open_ = [k for k, (lo, hi) in enumerate(windows) if lo <= hi]
        for bound, s, e in self.visits(query):
            open_ = [k for k in open_ if bound >= (windows[k][0] if len(best[k]) < most else -best[k][-1][0])]
            if not open_:
                break
            score, other = self.vectors[s:e] @ query, self.labels[s:e] != label
            for k in open_:
                lo, hi = windows[k]
                lo = lo if len(best[k]) < most else max(lo, -best[k][-1][0])
                good = np.flatnonzero(other & (score >= lo) & (score <= hi))
                if len(good):
                    ids, own = self.ids[s:e][good], score[good]
                    top = np.lexsort((ids, -own))[:most]
                    best[k] = sorted(best[k] + list(zip((-own[top]).tolist(), ids[top].tolist(), strict=True)))[:most]
        return [[(i, int(-s)) for s, i in b] for b in best]


def _matrix(column: pa.ChunkedArray | pa.Array, wide: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), wide)


class Cells:
    """What every task knows of the index: the codebooks, and of each cell its radii and its shards."""

    def __init__(self, sample: np.ndarray, codes: int):
        self.wide = sample.shape[1]
        self.half = self.wide // 2
        self.books = [codebook(sample[:, : self.half], codes), codebook(sample[:, self.half :], codes)] if self.wide > 1 else [np.zeros((1, k)) for k in (self.half, self.wide - self.half)]
        self.cells, self.shards = [], 0

    def place(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"), self.wide)
            own, far = [], []
            for part, book in zip((x[:, : self.half], x[:, self.half :]), self.books, strict=True):
                k = nearest(part, book)
                own.append(pa.array(k.astype(np.int32)))
                far.append(pa.array(np.sqrt(((part - book[k]) ** 2).sum(axis=1))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *own, *far], [*batch.schema.names, "first", "second", "r_first", "r_second"])

    def deal(self, told: list[tuple], shard_rows: int) -> None:
        """Shards for the cells (codewords, rows, radii) in order; a cell above the bound gets several of its own."""
        shard, room = -1, 0
        for first, second, n, r1, r2 in sorted(told):
            parts = -(-n // shard_rows)
            if n > room:
                shard, room = shard + 1, shard_rows * parts
            self.cells.append((first, second, r1, r2, shard, parts))
            room -= n
            if parts > 1:
                shard, room = shard + parts - 1, 0
        self.shards = shard + 1

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """The largest score that each shard can hold."""
        out = np.full(self.shards, -np.inf)
        a, b = query[: self.half], query[self.half :]
        s1, s2, la, lb = self.books[0] @ a, self.books[1] @ b, np.sqrt(a @ a), np.sqrt(b @ b)
        for first, second, r1, r2, base, parts in self.cells:
            bound = s1[first] + la * r1 + s2[second] + lb * r2
            out[base : base + parts] = np.maximum(out[base : base + parts], bound + SLACK * (1 + abs(bound)))
        return out


class Index:
    """An inverted multi-index over (vec_id, label, vector), dealt to shards."""

    def __init__(self, rows: DataFrame, codes: int = CODES, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS):
        some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("vector").limit(sample).toArrow()["vector"]
        self.known = Cells(_matrix(some, len(some[0]) if len(some) else 0), codes)
        placed = rows.mapInArrow(self.known.place, f"vec_id long, label long, vector {VECTOR}, first int, second int, r_first double, r_second double")
        placed = written(placed, "hardneg-cells")
        told = placed.groupBy("first", "second").agg(F.count(F.lit(1)), F.max("r_first"), F.max("r_second"))
        self.known.deal([tuple(r) for r in told.collect()], shard_rows)  # one row a cell, at most codes * codes
        where = rows.sparkSession.createDataFrame([(a, b, s, p) for a, b, _, _, s, p in self.known.cells], "c1 int, c2 int, base long, parts long")
        at = F.col("base") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))
        self.rows = placed.join(F.broadcast(where), (F.col("first") == F.col("c1")) & (F.col("second") == F.col("c2"))).select("vec_id", "label", "vector", "first", "second", at.alias("shard"))

    def _route(self, queries: DataFrame, which: str) -> DataFrame:
        """(shard, anchor) for the shards that ``which`` asks for: the best one, the others that can count, those of the windows."""

        known = self.known

        def run(batches):
            for batch in batches:
                shards, at = [], []
                least = batch.column("least").to_pylist()
                for k, query in enumerate(_matrix(batch.column("vector"), known.wide)):
                    bound = known.bounds(query)
                    best = int(bound.argmax())
                    go = np.array([best]) if which == "best" else np.flatnonzero(bound >= (-np.inf if least[k] is None else least[k]))
                    go = go[go != best] if which == "rest" else go
                    shards.append(go)
                    at += [k] * len(go)
                told = pa.array(np.concatenate([np.zeros(0, np.int64), *shards]), pa.int64())
                yield pa.RecordBatch.from_arrays([told, *batch.take(pa.array(at, pa.int64())).columns], ["shard", *batch.schema.names])

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
        return queries.mapInArrow(run, f"shard long, {fields}")

    def _visit(self, routed: DataFrame, search, schema: str) -> DataFrame:
        """Streams the queries of each shard past its rows: rows come first, so a task holds one shard at a time."""
        more = [c for c in routed.columns if c not in ("shard", "vec_id", "label", "vector")]
        names = ["shard", "asks", "vec_id", "label", "vector", "first", "second", *more]
        own = self.rows.withColumns({"asks": F.lit(False), **{c: F.lit(None).cast(routed.schema[c].dataType) for c in more}})
        ask = routed.withColumns({"asks": F.lit(True), "first": F.lit(None).cast("int"), "second": F.lit(None).cast("int")})
        wide, books = self.known.wide, self.known.books

        def run(batches):
            shard, parts, index = None, [], None
            for batch in batches:
                t = pa.Table.from_batches([batch])
                place, asks = t["shard"].to_numpy(), t["asks"].to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero((np.diff(place) != 0) | (asks[1:] != asks[:-1])) + 1
                for s, e in zip([0, *cuts], [*cuts, len(place)], strict=True):
                    if s == e:
                        continue
                    piece = t.slice(s, e - s)
                    if place[s] != shard:
                        shard, parts, index = place[s], [], None
                    if not asks[s]:
                        parts.append(piece)
                        continue
                    if index is None:
                        x = pa.concat_tables(parts) if parts else piece.slice(0, 0)
                        index = MultiIndex(x["vec_id"].to_numpy(), x["label"].to_numpy(), _matrix(x["vector"], wide), x["first"].to_numpy(), x["second"].to_numpy(), books)
                        parts = []
                    out = [r for q, v in zip(piece.select(["vec_id", "label", *more]).to_pylist(), _matrix(piece["vector"], wide), strict=True) for r in search(index, q, v)]
                    if out:
                        yield pa.RecordBatch.from_pylist(out, kind)

        spark = routed.sparkSession
        kind = pa.schema([(f.name, _arrow(f.dataType.typeName())) for f in spark.createDataFrame([], schema).schema])
        both = own.select(*names).unionByName(ask.select(*names))
        return both.repartition("shard").sortWithinPartitions("shard", "asks").mapInArrow(run, schema)

    def positives(self, anchors: DataFrame, most: int = POSITIVES) -> DataFrame:
        """anchor_id, label, vector, positives (array of id and score, in order) of anchors (vec_id, label, vector)."""

        def search(index, q, vector):
            for i, s in index.positives(vector, q["vec_id"], q["label"], q["least"], most):
                yield {"anchor_id": q["vec_id"], "id": i, "score": s}

        def first(hits):
            h = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id")))
            return hits.groupBy("anchor_id").agg(F.slice(h, 1, most).alias("top"))

        kind = "anchor_id long, id long, score long"
        start = written(self._visit(self._route(anchors.withColumn("least", F.lit(None).cast("double")), "best"), search, kind), "hardneg-first")
        known = first(start).select("anchor_id", F.when(F.size("top") == most, -F.element_at("top", -1)["minus"]).cast("double").alias("least"))
        asks = anchors.join(known, anchors["vec_id"] == known["anchor_id"], "left").select("vec_id", "label", "vector", "least")
        rest = self._visit(self._route(asks, "rest"), search, kind)
        found = first(start.unionByName(rest))
        found = found.select("anchor_id", F.transform("top", lambda t: F.struct(t["id"].alias("id"), (-t["minus"]).alias("score"))).alias("positives"))
        return anchors.join(found, anchors["vec_id"] == found["anchor_id"]).select("anchor_id", "label", "vector", "positives")

    def negatives(self, positives: DataFrame, most: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST) -> DataFrame:
        """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""

        def search(index, q, vector):
            windows = [(-(-lowest * p["score"] // 100), highest * p["score"] // 100) for p in q["positives"]]
            for p, own in zip(q["positives"], index.negatives(vector, q["label"], windows, most), strict=True):
                for i, s in own:
                    yield {"anchor_id": q["vec_id"], "positive_id": p["id"], "positive_score": p["score"], "id": i, "score": s}

        asks = positives.select(F.col("anchor_id").alias("vec_id"), "label", "vector", "positives", F.array_min(F.transform("positives", lambda p: p["score"] * (lowest / 100))).alias("least"))
        hits = self._visit(self._route(asks.withColumn("least", F.col("least") - 1), "windows"), search, "anchor_id long, positive_id long, positive_score long, id long, score long")
        order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("score").desc(), "id")
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _arrow(name: str) -> pa.DataType:
    return {"long": pa.int64(), "integer": pa.int32(), "double": pa.float64()}[name]


def mine(rows: DataFrame, anchors: Column, **how) -> DataFrame:
    """Hard negatives of the rows (vec_id, label, vector) for which ``anchors`` holds."""
    rows = written(rows, "hardneg-rows")
    index = Index(rows, **how)
    return index.negatives(written(index.positives(rows.where(anchors)), "hardneg-positives"))
