"""Ordered operations on long histories without putting one key into one task.

A window over ``partitionBy(key)`` gives a whole key to one task.  With a key that
holds a third of the data that task never ends, so every ordered operation here
works on *chunks* of a key:

* :func:`scan` - running aggregates in two levels: inside a chunk by a window, across
  chunks by a window over one row per chunk, joined back.
* :class:`Framed` - bounded frames (``lag``, ``rowsBetween(-n, m)``): a row is copied
  into the following (preceding) chunks that still need it, so each chunk is complete
  on its own.

``grain`` is an order-preserving bucket of the ordering columns (for bars: a span of
time holding at most ``chunkRows`` bars), which keeps the groups of :func:`scan` small.
Where nothing bounds the rows of a span (ledgers, ticks) it is a :class:`Cut`, which
counts them and cuts the dense ones finer.

No row is lost: rows of a null key are a key of their own, and a row that has no place
in the order (a null grain) fails the job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import chunk_rows

FIRST, HERE = Window.unboundedPreceding, Window.currentRow


def _merge(op: str, before: Column, here: Column) -> Column:
    if op in ("sum", "count"):
        return F.when(before.isNull(), here).when(here.isNull(), before).otherwise(before + here)
    if op == "product":
        return F.when(before.isNull(), here).when(here.isNull(), before).otherwise(before * here)
    if op == "max":
        return F.greatest(before, here)
    if op == "min":
        return F.least(before, here)
    return F.coalesce(here, before)


_FOLD = {
    "sum": F.sum,
    "count": F.sum,
    "product": F.product,
    "max": F.max,
    "min": F.min,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def _shared(rows: DataFrame, by) -> tuple[DataFrame, Column]:
    """Two uses of one shuffle of ``rows``, for rows that are expensive to make.

    Spark reuses a shuffle only when both sides want the same columns, so the second use
    keeps all columns alive through a count that never filters anything out.
    """
    placed = rows.repartition(*by)
    seen = F.count(F.when(F.xxhash64(*rows.columns) != 0, 1))
    return placed, seen


def _stand_in(kind: T.DataType) -> Column | None:
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    return {"string": F.lit(""), "boolean": F.lit(False), "date": F.date_from_unix_date(F.lit(0)), "timestamp": F.timestamp_seconds(F.lit(0))}.get(kind.typeName())


def plain_keys(df: DataFrame, keys) -> dict[str, Column]:
    """Columns that stand for the keys in windows and joins and are never null, so that plain equality loses no row."""
    made, nulls = {}, F.lit(0)
    for i, k in enumerate(keys):
        field = df.schema[k]
        instead = _stand_in(field.dataType)
        if not field.nullable:
            made[f"_q{i}"] = F.col(k)
        elif instead is None:
            made[f"_q{i}"] = F.struct(k)
        else:
            made[f"_q{i}"] = F.coalesce(k, instead)
            nulls = nulls + F.when(F.col(k).isNull(), 1 << i).otherwise(0)
    if any(df.schema[k].nullable for k in keys):
        made["_qn"] = nulls
    return made


def keys_again(df: DataFrame, keys) -> dict[str, Column]:
    """The keys from the columns that :func:`plain_keys` made of them for ``df``, so that a shuffle needn't carry both."""
    again = {}
    for i, k in enumerate(keys):
        field, made = df.schema[k], F.col(f"_q{i}")
        again[k] = made if not field.nullable else made[k] if _stand_in(field.dataType) is None else F.when(F.col("_qn").bitwiseAND(1 << i) == 0, made)
    return again


@dataclass(frozen=True)
class Cut:
    """Chunks of a numeric order column (seconds, a quantity): spans of ``span``, and finer ones where a key is dense."""

    at: str
    span: float


#: Dense spans that are sent to all tasks; more are joined by a shuffle.
MANY = 10_000


def _or_fail(grain: Column, why: str, what: str = "order") -> Column:
    """The grain, or an error where it is null.

    Never null for the optimizer: else a null check of a join key would be pushed down with the error in it, past filters that take the row away.
    """
    return F.coalesce(F.when(grain.isNotNull(), grain).otherwise(F.raise_error(F.lit(f"a row has no place in its {what}: {why}"))), F.lit(0))


def _sizes(cut: Cut, times: int) -> list:
    """The span and its sixty-fourths, down to one second."""
    whole, sizes = isinstance(cut.span, int), [cut.span]
    while len(sizes) <= times and not (whole and sizes[-1] == 1):
        sizes.append(max(sizes[-1] // 64, 1) if whole else sizes[-1] / 64)
    return sizes


def _starts(at: Column, sizes) -> list[Column]:
    """Start of the span of each size that a value lies in, each inside the one before."""
    starts = [F.floor(at / sizes[0]) * sizes[0]]
    if isinstance(sizes[0], float):  # sixty-fourths of a float are exact, so all are counted from the first: nested, each would hold the one before twice
        return starts + [starts[0] + F.floor((at - starts[0]) / size) * size for size in sizes[1:]]
    for size in sizes[1:]:
        starts.append(starts[-1] + F.floor((at - starts[-1]) / size) * size)
    return starts


def chunked(df: DataFrame, keys, cut: Cut, name: str = "_b", times: int = 5, what: str = "order") -> DataFrame:
    """Adds the start of the span that a row lies in, such that no span of a key holds more than ``chunkRows`` rows.

    Spans with more rows are cut in 64, up to ``times`` times or down to one second. Rows of one second stay together, and a span of one
    second's rows isn't cut. Two jobs count, over the columns they need: the spans, and in the dense ones all finer spans at once. Without
    dense spans there is only the first, and nothing is joined.
    """
    most, sizes, by = chunk_rows(df.sparkSession), _sizes(cut, times), plain_keys(df, keys)
    at = F.col(cut.at)
    out = df.withColumn(name, _or_fail(F.floor(at / sizes[0]) * sizes[0], f"null in {cut.at}", what))
    if len(sizes) == 1:
        return out
    rows = out.select(*[c.alias(k) for k, c in by.items()], F.col(name), at.alias("_at"))
    held = [F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_lo"), F.max("_at").alias("_hi")]
    dense = rows.groupBy(*by, name).agg(*held).where((F.col("_n") > most) & (F.col("_lo") < F.col("_hi"))).select(*by, name)

    def known(frame):
        """The dense spans: a small list that is sent to all tasks, or the frame; with the sizes that occur."""
        some = frame.limit(MANY + 1).collect()
        small = len(some) <= MANY
        return some, (F.broadcast(df.sparkSession.createDataFrame(some, frame.schema)) if small else frame)

    some, first = known(dense)
    if not some:
        return out
    inner = rows.join(first, [*by, name], "left_semi")
    fine = inner.groupBy(*by, _starts(F.col("_at"), sizes)[-1].alias("_f")).agg(*held)
    levels = _starts(F.col("_lo"), sizes)[1:-1]
    found = None
    if levels:
        spans = F.explode(F.array(*[F.struct(F.lit(i).alias("_level"), x.alias("_d")) for i, x in enumerate(levels, 1)])).alias("_s")
        spans = fine.select(*by, spans, "_n", "_lo", "_hi").groupBy(*by, "_s._level", "_s._d").agg(F.sum("_n").alias("_n"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        some, found = known(spans.where((F.col("_n") > most) & (F.col("_lo") < F.col("_hi"))).select(*by, "_level", "_d"))
    deepest = max((r["_level"] for r in some), default=0) if levels and len(some) <= MANY else (len(levels) if levels else 0)
    starts = _starts(at, sizes)
    for level in range(deepest + 1):
        cuts = first.withColumnRenamed(name, "_d") if level == 0 else found.where(F.col("_level") == level).drop("_level")
        cuts = cuts.select(*[F.col(c).alias(f"_d{c}") for c in by], "_d")
        cuts = F.broadcast(cuts) if len(some) <= MANY and level else cuts
        same = F.col(name) == F.col("_d")
        for c in by:
            same = same & (by[c] == F.col(f"_d{c}"))
        out = out.join(cuts, same, "left").withColumn(name, F.coalesce(F.when(F.col("_d").isNotNull(), starts[level + 1]).otherwise(F.col(name)), F.lit(0))).select(*df.columns, name)
    return out


def cut_once(df: DataFrame, keys, grain: Column | Cut, name: str = "_span") -> tuple[DataFrame, Column]:
    """The rows with their chunk in a column, for callers that use it several times."""
    if not isinstance(grain, Cut):
        return df, grain
    return chunked(df, keys, grain, name), F.col(name)


def placed_rows(df: DataFrame, keys, grain: Column | Cut, what: str = "order") -> DataFrame:
    """Rows with the chunk ``_b`` they lie in."""
    if isinstance(grain, Cut):
        return chunked(df, keys, grain, what=what)
    field = df.select(grain.alias("_b")).schema["_b"]  # a struct is never null
    return df.withColumn("_b", _or_fail(grain, "its grain is null", what) if field.nullable else grain)


def scan(df: DataFrame, keys, order, grain: Column | Cut, reuse: bool = False, **specs) -> DataFrame:
    """Add running aggregates per key in ``order``.

    Each spec is ``name=(op, column)`` or ``(op, column, -1)`` to leave the current row
    out; ``op`` is sum, count, product, max, min or last (last non-null value).
    Rows of a null key are a key of their own; a row with a null grain fails the job.  ``reuse`` shuffles the rows once for both levels instead of
    making them twice: right for a long plan, wrong for a plain table scan.
    """
    order, made = list(order), plain_keys(df, keys)
    rows = placed_rows(df, keys, grain).withColumns(made) if made else placed_rows(df, keys, grain)
    keys, by = [*made], [*made, "_b"]
    local = Window.partitionBy(*by).orderBy(*order)
    above = Window.partitionBy(*keys).orderBy("_b").rowsBetween(FIRST, -1)
    here, totals, carried, result = {}, [], {}, {}
    for name, spec in specs.items():
        op, col, end = (*spec, 0)[:3]
        col = F.col(col) if isinstance(col, str) else col
        if op == "count":
            col = F.when(col.isNotNull(), F.lit(1).cast("long"))
        here[f"_h_{name}"] = _FOLD[op](col).over(local.rowsBetween(FIRST, end))
        if op == "last":
            total = F.max_by(col, F.when(col.isNotNull(), F.struct(*order)))
        else:
            total = _FOLD[op](col)
        totals.append(total.alias(f"_t_{name}"))
        carried[f"_c_{name}"] = _FOLD[op](F.col(f"_t_{name}")).over(above)
        value = _merge(op, F.col(f"_c_{name}"), F.col(f"_h_{name}"))
        result[name] = F.coalesce(value, F.lit(0).cast("long")) if op == "count" else value
    if reuse:
        rows, seen = _shared(rows, by)
        totals.append(seen.alias("_seen"))
    heads = rows.groupBy(*by).agg(*totals)
    if reuse:
        heads = heads.where("_seen >= 0")
    heads = heads.withColumns(carried).select(*by, *carried)
    out = rows.withColumns(here).join(heads, by)
    return out.select(*df.columns, *[c.alias(n) for n, c in result.items() if n not in df.columns])


def number(df: DataFrame, keys, order, grain: Column | Cut, name: str = "pos") -> DataFrame:
    """Zero-based position of a row inside its key."""
    out = scan(df, keys, order, grain, **{name: ("count", F.lit(1))})
    return out.withColumn(name, F.col(name) - 1)


class Framed:
    """Rows with ``back`` earlier and ``ahead`` later rows of the same key at hand.

    ``df`` holds every row in its own chunk (``_own``) and copies of the rows a
    neighbouring chunk needs.  Build windows with :meth:`w` and :attr:`row`, then call
    :meth:`own` to drop the copies.
    """

    def __init__(self, df, keys, order, grain, back=0, ahead=0, chunk=None):
        self.keys = list(keys)
        size = max(chunk or chunk_rows(df.sparkSession), back + ahead, 1)
        numbered = df if "pos" in df.columns else number(df, keys, order, grain)
        home = F.floor(F.col("pos") / size)
        spots = F.sequence(
            F.greatest(F.floor((F.col("pos") - ahead) / size), F.lit(0).cast("long")),
            F.floor((F.col("pos") + back) / size),
        )
        self.df = (
            numbered.withColumn("_home", home)
            .withColumn("_chunk", F.explode(spots))
            .withColumn("_own", F.col("_chunk") == F.col("_home"))
            .drop("_home")
        )
        self.row = Window.partitionBy(*self.keys, "_chunk").orderBy("pos")

    def w(self, n: int):
        """The current row and the n-1 rows before it."""
        return self.row.rowsBetween(-(n - 1), 0)

    def between(self, a: int, b: int):
        return self.row.rowsBetween(a, b)

    def own(self, df: DataFrame) -> DataFrame:
        return df.where("_own").drop("_own", "_chunk")


def path(df: DataFrame, keys, order, grain: Column | Cut, step: Column, start: Column | float = 0.0,
         product: bool = False, value: str = "equity", peak: str = "peak", low: str | None = None,
         from_start: bool = True, reuse: bool = False, sums: dict | None = None) -> DataFrame:
    """Running value from steps with its running peak (and low), in one pass.

    ``value`` is start plus the sum of steps, or with ``product`` start times the product of
    ``1 + step``; ``peak`` and ``low`` include the start if ``from_start``.  The peak over earlier chunks
    needs only one row per chunk: its total and its largest prefix.  ``low`` adds the
    running minimum and, as ``<low>_before``, the minimum before the row; ``sums`` adds
    further running sums in the same pass.  Rows of a null key are a key of their own; a row without a time fails the job.
    """
    keys, order = list(keys), list(order)
    start = F.lit(start) if not isinstance(start, Column) else start
    extra = sums or {}
    made_keys = plain_keys(df, keys)
    placed = placed_rows(df, keys, grain, "path")
    keys, by = [*made_keys], [*made_keys, "_b"]
    rows = placed.withColumns({**made_keys, "_x": (1.0 + step) if product else step, "_s": start,
                           **{f"_e_{n}": x for n, x in extra.items()}})
    order_w = Window.partitionBy(*by).orderBy(*order)
    w, prior = order_w.rowsBetween(FIRST, HERE), order_w.rowsBetween(FIRST, -1)
    above = Window.partitionBy(*keys).orderBy("_b").rowsBetween(FIRST, -1)
    fold, unit = (F.product, 1.0) if product else (F.sum, 0.0)
    join = (lambda a, b: a * b) if product else (lambda a, b: a + b)
    totals = [F.sum(f"_e_{n}").alias(f"_u_{n}") for n in extra]
    if reuse:
        rows, seen = _shared(rows, by)
        totals.append(seen.alias("_seen"))
    rows = rows.withColumn("_p", fold("_x").over(w))
    heads = rows.groupBy(*by).agg(fold("_x").alias("_t"), F.max("_p").alias("_hi"), F.min("_p").alias("_lo"), *totals)
    if reuse:
        heads = heads.where("_seen >= 0")
    heads = heads.withColumn("_base", F.coalesce(fold("_t").over(above), F.lit(unit)))
    heads = heads.withColumns({"_top": F.max(join(F.col("_base"), F.col("_hi"))).over(above),
                               "_bot": F.min(join(F.col("_base"), F.col("_lo"))).over(above),
                               **{f"_v_{n}": F.coalesce(F.sum(f"_u_{n}").over(above), F.lit(0.0)) for n in extra}})
    heads = heads.select(*by, "_base", "_top", "_bot", *[f"_v_{n}" for n in extra])
    c = F.col
    local = {"_ph": F.max("_p").over(w), **{f"_w_{n}": F.sum(f"_e_{n}").over(w) for n in extra}}
    if low:
        local.update({"_pl": F.min("_p").over(w), "_pb": F.min("_p").over(prior)})
    out = rows.withColumns(local).join(heads, by)
    begin = c("_s") if from_start else F.lit(None)
    made = {value: join(c("_s"), join(c("_base"), c("_p"))),
            peak: F.greatest(join(c("_s"), c("_top")), join(c("_s"), join(c("_base"), c("_ph"))), begin),
            **{n: c(f"_v_{n}") + c(f"_w_{n}") for n in extra}}
    if low:
        made[low] = F.least(join(c("_s"), c("_bot")), join(c("_s"), join(c("_base"), c("_pl"))), begin)
        made[f"{low}_before"] = F.least(join(c("_s"), c("_bot")), join(c("_s"), join(c("_base"), c("_pb"))), begin)
    return out.select(*[n for n in df.columns if n not in made], *[x.alias(n) for n, x in made.items()])
