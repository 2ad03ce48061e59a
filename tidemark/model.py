"""Bars as a long table, and the cleaning done once at ingest."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.ordered import Framed, number, scan
from tidemark.session import chunk_rows

BAR_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType(), False),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
])
PRICES = ("open", "high", "low", "close", "volume")


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def div(a: Column, b: Column) -> Column:
    """a / b, null when b is zero."""
    return F.try_divide(a, b)


def epoch(c: Column | str = "ts") -> Column:
    return F.unix_seconds(F.col(c) if isinstance(c, str) else c)


@dataclass(frozen=True)
class Panel:
    """Bars of many symbols: at most one row per symbol and ``step`` seconds."""

    df: DataFrame
    step: int
    keys: tuple = ("symbol",)
    order: tuple = ("ts",)
    extra: dict = field(default_factory=dict)

    @property
    def grain(self) -> Column:
        span = self.step * chunk_rows(self.df.sparkSession)
        return F.floor(epoch() / span)

    def replace(self, df: DataFrame) -> "Panel":
        return Panel(df, self.step, self.keys, self.order)

    def clean(self, *cols: str) -> "Panel":
        """Turn non-finite values of ``cols`` into null."""
        return self.replace(self.df.withColumns({c: finite(F.col(c)) for c in cols}))

    def dropna(self, *cols: str) -> "Panel":
        return self.replace(self.clean(*cols).df.dropna(subset=list(cols)))

    def number(self) -> "Panel":
        return self.replace(number(self.df, self.keys, self.order, self.grain))

    def scan(self, **specs) -> "Panel":
        return self.replace(scan(self.df, self.keys, self.order, self.grain, **specs))

    def frame(self, back: int = 0, ahead: int = 0, chunk: int | None = None) -> Framed:
        return Framed(self.df, self.keys, self.order, self.grain, back, ahead, chunk)
