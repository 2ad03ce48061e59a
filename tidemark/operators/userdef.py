"""User-defined indicators, their declared parameters and sweeps, their causality test, and aggregate builders."""

from __future__ import annotations

import inspect
import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.model import PRICES, Panel, div

c, lit, when = F.col, F.lit, F.when


def by_chunk(rows: DataFrame, by: Sequence[str], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` on the rows of each group of ``by`` in order of ``pos``; a null key is a group.

    Rows are placed and sorted by Spark and come in Arrow batches that hold many groups, so the price of a batch is not paid for
    each group. What is held are one batch and one group.
    """
    def batches(frames):
        rest = None
        for pdf in frames:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            new = np.zeros(max(len(pdf) - 1, 0), dtype=bool)
            for k in by:
                new |= np.diff(pd.factorize(pdf[k])[0]) != 0
            ends = np.flatnonzero(new) + 1
            made = [run(pdf.iloc[a:b].reset_index(drop=True)) for a, b in zip([0, *ends], ends)]
            rest = pdf.iloc[ends[-1] :] if len(ends) else pdf
            if made:
                yield pd.concat(made, ignore_index=True)
        if rest is not None and len(rest):
            yield run(rest.reset_index(drop=True))

    return rows.repartition(*by).sortWithinPartitions(*by, "pos").mapInPandas(batches, schema)


def indicator(panel: Panel, fn: Callable[[pd.DataFrame], pd.DataFrame], outputs: dict[str, str], lookback: int) -> DataFrame:
    """Apply ``fn`` to the bars of each symbol and add its columns.

    ``fn`` gets bars in time order and returns a frame of the same length with the columns of
    ``outputs`` (name: Spark type).  It runs on chunks with ``lookback`` earlier bars, so a
    long history is spread over tasks and a value may look back at most that far.
    """
    fr = panel.frame(lookback)
    cols = [*panel.keys, *panel.order, *PRICES, "pos", "_own", "_chunk"]
    types = {f.name: f.dataType.simpleString() for f in fr.df.select(*panel.keys, *panel.order, *PRICES, "pos").schema}
    schema = ", ".join(f"{n} {t}" for n, t in {**types, **outputs}.items())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = fn(pdf.copy())
        return pdf.assign(**{n: made[n].to_numpy() for n in outputs}).loc[pdf["_own"].to_numpy(), [*types, *outputs]]

    return by_chunk(fr.df.select(*cols), [*panel.keys, "_chunk"], run, schema)


@dataclass(frozen=True)
class Declared:
    """A parameter of an indicator: its default, and the values a sweep takes (none: it stays at the default)."""

    default: int | float | str | bool
    values: tuple = ()


def choices(default, *values) -> Declared:
    """Values in the order given, each once."""
    return Declared(default, tuple(dict.fromkeys(values)))


def span(default: float, low: float, high: float, step: float, most: int = 1024) -> Declared:
    """Values from ``low`` to ``high``, both ends included; whole numbers if the default is one.

    A step of zero or away from ``high`` gives no sweep. More than ``most`` values are an error.
    """
    if step == 0 or (high - low) * step < 0:
        return Declared(default)
    n = int((high - low) / step + 1e-9) + 1
    if n > most:
        raise ValueError(f"a sweep of {n} values, at most {most} are allowed")
    whole = isinstance(default, int) and not isinstance(default, bool)
    return choices(default, *(round(low + k * step) if whole else round(low + k * step, 8) for k in range(n)))


def declared(fn: Callable) -> dict[str, Declared]:
    """The parameters of an indicator: its keyword arguments; a plain default is a parameter without a sweep."""
    out = {}
    for name, p in list(inspect.signature(fn).parameters.items())[1:]:
        if p.default is p.empty:
            raise ValueError(f"parameter {name} has no default")
        out[name] = p.default if isinstance(p.default, Declared) else Declared(p.default)
    return out


def trials(fn: Callable, sweep: dict[str, Sequence] | None = None, fixed: dict | None = None, most: int = 4096) -> list[dict]:
    """One dictionary of values per combination of the declared (or here given) values."""
    known, sweep, fixed = declared(fn), sweep or {}, fixed or {}
    strange = {*sweep, *fixed} - {*known}
    if strange:
        raise ValueError(f"unknown parameters {sorted(strange)}")
    axes = {n: [fixed[n]] if n in fixed else list(sweep.get(n, p.values)) or [p.default] for n, p in known.items()}
    if (n := np.prod([len(v) for v in axes.values()], dtype=object)) > most:
        raise ValueError(f"{n} combinations, at most {most} are allowed: give fewer values or fix parameters")
    return [dict(zip(axes, values, strict=True)) for values in itertools.product(*axes.values())]


def swept(panel: Panel, fn: Callable, outputs: dict[str, str], lookback: int, sweep: dict[str, Sequence] | None = None, fixed: dict | None = None, block: int = 16) -> DataFrame:
    """``fn`` for every combination of its declared parameters: rows with ``trial``, the parameters and the outputs.

    All trials share one scan and one shuffle of the bars: a chunk of bars goes to one task per ``block`` trials, so many trials run side by side.
    """
    todo = trials(fn, sweep, fixed)
    fr = panel.frame(lookback)
    blocks = -(-len(todo) // block)
    cols = [*panel.keys, *panel.order, *PRICES, "pos"]
    types = {f.name: f.dataType.simpleString() for f in fr.df.select(*cols).schema}
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    named = {n: kinds[float if {type(t[n]) for t in todo} == {int, float} else type(todo[0][n])] for n in todo[0]}
    schema = ", ".join(f"{n} {t}" for n, t in {**types, "trial": "long", **named, **outputs}.items())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first, own = int(pdf["_block"].iloc[0]) * block, np.flatnonzero(pdf["_own"].to_numpy())
        bars, some = pdf[cols], todo[first : first + block]
        made = [fn(bars.copy(), **values) for values in some]
        out = pdf[[*types]].iloc[np.tile(own, len(some))].reset_index(drop=True)
        each = lambda values: np.repeat(np.array(values), len(own))
        return out.assign(trial=each(range(first, first + len(some))), **{n: each([t[n] for t in some]) for n in named},
                          **{n: np.concatenate([m[n].to_numpy()[own] for m in made]) for n in outputs})

    x = fr.df.select(*cols, "_own", "_chunk", F.explode(F.sequence(lit(0), lit(blocks - 1))).alias("_block"))
    return by_chunk(x, [*panel.keys, "_chunk", "_block"], run, schema)


def causality_report(panel: Panel, fn, outputs: dict[str, str], lookback: int, cut: Column, tolerance: float = 1e-9) -> DataFrame:
    """Bars before ``cut`` whose value changes when the bars from ``cut`` on are taken away."""
    key = [*panel.keys, *panel.order]
    whole = indicator(panel, fn, outputs, lookback)
    part = indicator(panel.replace(panel.df.where(c("ts") < cut)), fn, outputs, lookback)
    j = whole.select(*key, *[c(n).alias(f"all_{n}") for n in outputs]).join(part.select(*key, *outputs), key)
    differ = lit(False)
    for n in outputs:
        a, b = c(f"all_{n}"), c(n)
        differ = differ | (~a.eqNullSafe(b) & F.coalesce(F.abs(a - b) > tolerance, lit(True)))
    return j.where(differ)


def weighted_mean(value: Column, weight: Column) -> Column:
    return div(F.sum(value * weight), F.sum(weight))


def profit_factor(profit: Column) -> Column:
    """Gross profit over gross loss; without losses the gross profit."""
    gain, loss = F.sum(F.greatest(profit, lit(0.0))), F.sum(F.greatest(-profit, lit(0.0)))
    return when(loss > 0, gain / loss).otherwise(gain)


def information_ratio(active: Column, factor: float) -> Column:
    return div(F.avg(active) * factor, F.stddev_samp(active) * (factor ** 0.5))
