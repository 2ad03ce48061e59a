"""Column expressions of the trading domain: instruments, orders, prices, fees, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

lit, when = F.lit, F.when

# Market names, quote currencies, suffixes, frequencies, action and status names.
MARKETS = ("CNStock", "USStock", "HKStock", "Crypto", "Forex", "Futures", "MOEX")
QUOTES = ("USDT", "USDC", "USD", "BTC", "ETH")
STRATEGY_QUOTES = ("USDT", "USDC", "USD", "BUSD", "EUR")
STABLE = ("USD", "USDT", "USDC", "BUSD", "FDUSD", "TUSD")
EXCHANGE_SUFFIX = ((".XSHG", ".SH"), (".XSHE", ".SZ"), (".XBJS", ".BJ"), (".XHKG", ".HK"))
FREQUENCY = {"1m": 60, "3m": 180, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400, "1d": 86400, "1w": 604800}
ALIASES = {"daily": "1d", "day": "1d", "d": "1d", "1day": "1d", "weekly": "1w", "week": "1w", "w": "1w",
           "monthly": "1mo", "month": "1mo", "m1": "1m", "h1": "1h", "d1": "1d"}
STATUS = {
    "filled": ("filled", "fill", "closed", "done", "fully_filled", "full_fill"),
    "partial": ("partiallyfilled", "partially_filled", "partial_fill", "partial"),
    "cancelled": ("cancelled", "canceled", "expired", "rejected", "failed"),
    "open": ("new", "open", "live", "submitted", "accepted"),
}
ENTRIES = ("open_long", "add_long", "open_short", "add_short")
EXITS = ("reduce_long", "close_long", "reduce_short", "close_short")
BUYS = ("open_long", "add_long", "reduce_short", "close_short")
DERIVATIVES = ("swap", "futures", "future", "perp", "perpetual")
RATE_UNITS = {"percent": ("%", "pct", "percent", "percentage"), "decimal": ("decimal", "fraction", "ratio_decimal"),
              "bps": ("bp", "bps", "basis_point", "basis_points"), "ratio": ("ratio", "long_short_ratio", "multiple", "x")}
OPPORTUNITY_BANDS = {"Crypto": (15.0, 5.0, None), "USStock": (5.0, 2.0, None), "Forex": (1.5, 0.5, None),
                     "CNStock": (5.0, 2.0, 1.0), "HKStock": (4.0, 1.5, 0.8)}
HEADLINE_RULES = (
    ("inflation", ("cpi", "ppi", "pce", "inflation", "通胀", "物价")),
    ("central_bank", ("fomc", "fed", "rate decision", "interest rate", "联储", "央行", "利率")),
    ("jobs", ("nonfarm", "payroll", "jobless", "unemployment", "非农", "就业", "失业", "初请")),
    ("growth", ("gdp", "pmi", "ism", "retail sales", "industrial production", "零售", "制造业", "工业产出")),
)
CALENDAR_RULES = (
    ("inflation", ("cpi", "inflation", "ppi", "通胀", "物价")),
    ("central_bank", ("fomc", "fed", "federal funds", "interest rate", "rate decision", "利率", "降息", "加息")),
    ("jobs", ("non farm", "nonfarm", "payroll", "unemployment", "jobless", "非农", "失业", "初请")),
    ("growth", ("gdp", "pmi", "ism", "retail sales", "industrial production", "零售", "制造业", "工业产出")),
    ("energy", ("opec", "crude", "oil", "原油", "欧佩克")),
    ("earnings", ("earnings", "report", "call", "财报")),
)
BEARISH_IF_HIGHER = ("cpi", "inflation", "ppi", "price index", "interest rate", "rate decision", "fomc", "fed funds",
                     "unemployment", "jobless", "job cuts")
SLIPPAGE_BANDS = ((3600, 5.0, 15.0, 20.0, 50.0), (14400, 15.0, 40.0, 50.0, 120.0),
                  (86400, 30.0, 80.0, 100.0, 250.0), (None, 60.0, 150.0, 200.0, 500.0))
COIN_ALIASES = {"BTC": ("bitcoin",), "ETH": ("ethereum", "ether"), "SOL": ("solana",), "BNB": ("binance coin",),
                "XRP": ("ripple",), "DOGE": ("dogecoin",)}


def bind(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), lit(0))


def text(c: Column) -> Column:
    return F.coalesce(F.trim(c), lit(""))


def any_of(c: Column, words) -> Column:
    """True when the text holds one of the words (plain substrings)."""
    out = lit(False)
    for w in words:
        out = out | F.contains(c, lit(w))
    return out


def lookup(c: Column, table: dict, other: Column) -> Column:
    out = other
    for value, names in table.items():
        out = when(c.isin(*names), value).otherwise(out)
    return out


# --- instruments ----------------------------------------------------------------------

def _split_quote(s: Column, quotes) -> Column:
    """Split a trailing quote currency off with a slash; longer names come first."""
    return F.regexp_replace(s, f"^(.+?)({'|'.join(quotes)})$", "$1/$2")


def infer_market(symbol: Column) -> Column:
    return bind(F.upper(text(symbol)), lambda s: (when(s == "", "").when(F.contains(s, lit("/")) | s.endswith("USDT") | s.endswith("USDC"), "Crypto")
            .when(s.rlike(r"\.(HK|XHKG)$"), "HKStock").when(s.rlike(r"\.(SH|SZ|BJ|XSHG|XSHE|XBJS)$"), "CNStock")
            .when(s.rlike(r"^\d{6}$"), "CNStock").when(s.rlike(r"^[A-Z][A-Z0-9.\-]{0,14}$"), "USStock").otherwise("")))


def market_name(raw: Column) -> Column:
    out = lit("")
    for m in MARKETS:
        out = when(F.lower(text(raw)) == m.lower(), m).otherwise(out)
    return out


def parse_instrument(value: Column, default_market: str = "") -> Column:
    """Struct market, symbol, exchange, market_type of ``Market:SYMBOL[@venue[:type]]``."""
    def body(raw):
        prefix = when(F.contains(raw, lit(":")), market_name(F.substring_index(raw, ":", 1))).otherwise("")
        return bind(prefix, lambda p: F.struct(p.alias("market"), when(
            p != "", F.substr(raw, F.instr(raw, ":") + 1)).otherwise(raw).alias("body")))

    def venue(x):
        b = x["body"]
        v = when(F.contains(b, lit("@")), F.substring_index(b, "@", -1))
        return bind(v, lambda v: F.struct(
            x["market"].alias("market"), F.coalesce(v, lit("")).alias("venue"),
            when(v.isNotNull(), F.substr(b, lit(1), F.length(b) - F.length(v) - 1)).otherwise(b).alias("name")))

    def fields(x):
        v, name = F.lower(F.trim(x["venue"])), F.upper(F.trim(x["name"]))
        lone, pair = v.isin("spot", "swap"), F.contains(v, lit(":"))
        for old, new in EXCHANGE_SUFFIX:
            name = F.regexp_replace(name, "\\" + old + "$", new)
        return F.struct(
            x["market"].alias("market"), name.alias("symbol"),
            when(lone, "").when(pair, F.trim(F.substring_index(v, ":", 1))).otherwise(v).alias("exchange"),
            when(lone, v).when(pair, F.trim(F.substr(v, F.instr(v, ":") + 1))).otherwise("").alias("kind"))

    def settle(x):
        market = F.coalesce(F.nullif(x["market"], lit("")), F.nullif(lit(default_market), lit("")), infer_market(x["symbol"]))
        slashed = F.translate(x["symbol"], "-_", "//")
        coin = when(F.contains(slashed, lit("/")), slashed).otherwise(_split_quote(slashed, QUOTES))
        return bind(market, lambda m: F.struct(
            m.alias("market"), when(m == "Crypto", coin).otherwise(x["symbol"]).alias("symbol"),
            when(m == "Crypto", x["exchange"]).otherwise("").alias("exchange"),
            when(m == "Crypto", when(x["kind"].isin("spot", "swap"), x["kind"]).otherwise("spot")).otherwise("").alias("market_type")))

    return bind(bind(bind(bind(text(value), body), venue), fields), settle)


def traded_symbol(value: Column) -> Column:
    """Venue symbol: one separator, contract suffix removed, quote split off."""
    s = F.translate(F.upper(text(value)), "-_", "//")
    for suffix in ("SWAP", "PERP", "PERPETUAL"):
        s = F.regexp_replace(s, f"/{suffix}$", "")
    return bind(s, lambda x: when(F.contains(x, lit("/")), x).otherwise(_split_quote(x, QUOTES)))


def strategy_symbol(value: Column) -> Column:
    """Ledger symbol: settlement suffix dropped unless a venue comes first."""
    def cut(s):
        after = F.substr(s, F.instr(s, "/") + 1)
        settle, venue = F.instr(after, ":"), F.instr(after, "@")
        drop = (settle > 0) & ((venue == 0) | (settle < venue))
        return when(F.instr(s, "/") > 0, when(drop, F.substr(s, lit(1), F.instr(s, "/") + settle - 1)).otherwise(s)).otherwise(
            _split_quote(s, STRATEGY_QUOTES))

    return bind(F.regexp_replace(F.upper(text(value)), "-", ""), cut)


def order_status(value: Column) -> Column:
    return bind(F.regexp_replace(F.lower(text(value)), "-", "_"), lambda s: lookup(s, STATUS, s))


def epoch_seconds(value: Column) -> Column:
    """Seconds, milliseconds or nanoseconds by magnitude; null unless positive."""
    return when(value > 0, when(value > 1e13, value / 1e6).when(value > 1e10, value / 1e3).otherwise(value))


# --- frequencies ----------------------------------------------------------------------

def frequency(value: Column) -> Column:
    raw = F.regexp_replace(F.regexp_replace(F.lower(text(value)), "分钟", "m"), "小时", "h")
    table = F.create_map(*[lit(x) for kv in ALIASES.items() for x in kv])
    return bind(raw, lambda r: F.coalesce(F.try_element_at(table, r), F.nullif(r, lit("")), lit("1d")))


def frequency_seconds(freq: Column) -> Column:
    table = F.create_map(*[lit(x) for kv in FREQUENCY.items() for x in kv])
    return F.coalesce(F.try_element_at(table, freq), lit(FREQUENCY["1d"]))


def periods_per_year(freq: Column, crypto: Column) -> Column:
    days = when(crypto, 365.25).otherwise(252.0)
    n = F.greatest(F.regexp_extract(freq, r"^(\d+)", 1).try_cast("double"), lit(1.0))
    return (when(freq.endswith("m"), days * when(crypto, 1440.0).otherwise(390.0) / n)
            .when(freq.endswith("h"), days * when(crypto, 24.0).otherwise(6.5) / n)
            .when(freq.endswith("w"), 52.0).otherwise(days))


def last_completed_open(now: Column, step: int) -> Column:
    return (F.floor(now / step) - 1) * step


# --- positions and orders -------------------------------------------------------------

def unrealized_pnl(side, entry, price, size) -> Column:
    gap = when(F.lower(F.trim(side)) == "short", entry - price).otherwise(price - entry)
    return when((entry > 0) & (price > 0) & (size > 0), gap * size).otherwise(0.0)


def notional(entry, size) -> Column:
    return when((entry > 0) & (size > 0), entry * size).otherwise(0.0)


def is_derivative(kind: Column) -> Column:
    return F.lower(text(kind)).isin(*DERIVATIVES)


def _leverage(leverage: Column) -> Column:
    return when(leverage > 0, leverage).otherwise(1.0)


def margin(value, leverage, kind) -> Column:
    return when(value <= 0, 0.0).when(is_derivative(kind), value / _leverage(leverage)).otherwise(value)


def pnl_percent(entry, size, pnl, leverage, kind) -> Column:
    base = notional(entry, size)
    return when(base > 0, pnl / base * 100.0 * when(is_derivative(kind), _leverage(leverage)).otherwise(1.0)).otherwise(0.0)


def floor_to_step(value: Column, step: Column) -> Column:
    """Whole steps below a value; a value within 1e-12 of a step counts as that step."""
    v, s = value.cast("string").cast("decimal(28,14)"), step.cast("string").cast("decimal(28,14)")
    units = (v / s).cast("decimal(38,16)")
    near = F.round(units, 0)
    close = (near > 0) & (F.abs(units - near).cast("double") <= F.greatest(lit(1e-12), F.abs(units).cast("double") * 1e-12))
    out = when(close, near).otherwise(F.floor(units)).cast("double") * s.cast("double")
    return when(v <= 0, 0.0).when(s <= 0, v.cast("double")).otherwise(out)


def clean_number(value: Column, places: int = 12) -> Column:
    return F.round(value.cast("string").cast(f"decimal(38,{places + 2})"), places).cast("double") + 0.0


def target_quantity(kind, value, held, price, equity, leverage=1.0, slippage=0.0, commission=0.0) -> Column:
    worth = equity * value * leverage
    worth = when(worth > 0, worth / ((1.0 + slippage) * (1.0 + commission))).otherwise(worth)
    return (when(kind == "quantity", held + value).when(kind == "value", held + value * leverage / price)
            .when(kind == "target_quantity", value).when(kind == "target_value", value * leverage / price)
            .when(kind == "target_percent", worth / price))


def block_reason(price, suspended, limit_up, limit_down, delta) -> Column:
    return (when(price.isNull() | F.isnan(price) | (price <= 0), "no_price").when(suspended, "suspended")
            .when((delta > 0) & limit_up, "limit_up").when((delta < 0) & limit_down, "limit_down").otherwise(""))


def liquidity_cap(volume, lot) -> Column:
    return when(volume > 0, F.floor(volume * 0.1 / lot + 1e-10) * lot)


def is_exit(kind: Column) -> Column:
    return F.lower(text(kind)).rlike("^(close|reduce)_")


def leg(kind: Column) -> Column:
    t = F.lower(text(kind))
    return when(F.contains(t, lit("long")), "long").when(F.contains(t, lit("short")), "short").otherwise("")


def direction(kind: Column) -> Column:
    t = F.lower(text(kind))
    return when(t.isin("open_short", "add_short", "close_long", "reduce_long"), -1).otherwise(1)


def legacy_close_reason(kind, bot, stored=None) -> Column:
    t = F.lower(text(kind))
    grid = F.lower(text(bot)).isin("grid", "dca")
    guess = (when(~is_exit(kind), "").when(grid & F.contains(t, lit("long")), "grid_reduce_long")
             .when(grid & F.contains(t, lit("short")), "grid_reduce_short").otherwise("signal_trigger"))
    return guess if stored is None else F.coalesce(F.nullif(stored, lit("")), guess)


def close_reason(kind, reason, bot) -> Column:
    grid = F.lower(text(bot)).isin("grid", "dca")
    return (when(~is_exit(kind), "").when(text(reason) != "", text(reason))
            .when(grid, legacy_close_reason(kind, bot)).otherwise(""))


def fee_in_quote(symbol, fee, currency, price, rate=None) -> Column:
    """Fee in the quote currency; ``rate`` prices any other currency."""
    other = lit(None).cast("double") if rate is None else rate

    def convert(x):
        s, ccy = x["s"], x["ccy"]
        slash = F.instr(s, "/") > 0
        base = when(slash, F.substring_index(s, "/", 1)).otherwise("")
        quote = when(slash, F.substring_index(F.substr(s, F.instr(s, "/") + 1), ":", 1)).otherwise("")
        return (when(fee == 0, 0.0).when(ccy == "", None).when((quote == "") & ccy.isin(*STABLE), fee)
                .when((ccy == quote) | (ccy.isin(*STABLE) & quote.isin(*STABLE)), fee)
                .when((ccy == base) & (price > 0), fee * price).when((quote != "") & (other > 0), fee * other))

    return bind(F.struct(strategy_symbol(symbol).alias("s"), F.upper(text(currency)).alias("ccy")), convert)


def slipped(action, price, rate) -> Column:
    return F.greatest(price * when(F.lower(text(action)).isin(*BUYS), 1.0 + rate).otherwise(1.0 - rate), lit(0.0))


def limit_fill(action, limit, market, rate) -> Column:
    """Fill price of a resting order once the market reaches it, never worse than the limit."""
    buy = F.lower(text(action)).isin(*BUYS)
    ok = (limit > 0) & (market > 0)
    return (when(ok & buy & (market <= limit), F.least(limit, slipped(action, market, rate)))
            .when(ok & ~buy & (market >= limit), F.greatest(limit, slipped(action, market, rate))))


def commission(quantity, price, rate=0.0005) -> Column:
    return F.greatest(quantity, lit(0.0)) * F.greatest(price, lit(0.0)) * rate


def slippage_cost(quantity, reference, price) -> Column:
    return F.greatest(quantity, lit(0.0)) * F.abs(price - reference)


# --- labels ---------------------------------------------------------------------------

def opportunity(change: Column, market: Column) -> Column:
    """Struct signal, strength, impact from the % change; null when nothing stands out."""
    def label(s, k, i):
        return F.struct(lit(s).alias("signal"), lit(k).alias("strength"), lit(i).alias("impact"))
    out = lit(None)
    for name, (strong, medium, mild) in OPPORTUNITY_BANDS.items():
        v = when(change > strong, label("overbought", "strong", "bearish"))
        v = v.when(change > medium, label("bullish_momentum", "medium", "bullish"))
        if mild is not None:
            v = v.when(change > mild, label("bullish_momentum", "weak", "bullish"))
        v = v.when(change < -strong, label("oversold", "strong", "bullish"))
        v = v.when(change < -medium, label("bearish_momentum", "medium", "bearish"))
        if mild is not None:
            v = v.when(change < -mild, label("bearish_momentum", "weak", "bearish"))
            v = v.when(F.abs(change) <= mild, label("consolidation", "weak", "neutral"))
        out = when(market == name, v).otherwise(out)
    return out


def rate_unit(unit: Column) -> Column:
    return bind(F.translate(F.lower(text(unit)), "- ", "__"), lambda u: F.nullif(lookup(u, RATE_UNITS, u), lit("")))


def normal_rate(value: Column, unit: Column) -> Column:
    """Struct decimal, percent, warnings: a unit that is not explicit is never guessed."""
    return bind(rate_unit(unit), lambda u: _rate(value, u))


def _rate(value: Column, u: Column) -> Column:
    known = u.isin("decimal", "percent", "bps")
    dec = when(u == "decimal", value).when(u == "percent", value / 100.0).when(u == "bps", value / 10000.0)
    pct = when(u == "decimal", value * 100.0).when(u == "percent", value).when(u == "bps", value / 100.0)
    warn = F.array_compact(F.array(
        when(value.isNull(), "INVALID_NUMERIC_VALUE"),
        when(value.isNotNull() & ~F.coalesce(known, lit(False)), "AMBIGUOUS_RATE_UNIT")))
    return F.struct(dec.alias("decimal"), pct.alias("percent"), warn.alias("warnings"))


def long_short(ratio, unit, long_share, short_share, long_pct, short_pct) -> Column:
    """Struct ratio, long_share, short_share, warnings."""
    pct, share = long_pct.isNotNull() | short_pct.isNotNull(), long_share.isNotNull() | short_share.isNotNull()
    both_pct, both = long_pct.isNotNull() & short_pct.isNotNull(), long_share.isNotNull() & short_share.isNotNull()
    as_ratio = ~pct & ~share & (rate_unit(unit) == "ratio") & ratio.isNotNull()
    lo = when(pct, when(both_pct, long_pct / 100.0)).when(share, long_share).when(as_ratio & (ratio >= 0), ratio / (1.0 + ratio))
    sh = when(pct, when(both_pct, short_pct / 100.0)).when(share, short_share).when(as_ratio & (ratio >= 0), 1.0 / (1.0 + ratio))
    full = when(pct, both_pct).otherwise(both)
    out = when((pct | share) & full & (sh > 0), lo / sh).when(
        ((pct | share) & full) | rate_unit(unit).isin("ratio", "percent", "decimal"), ratio)
    warn = F.array_compact(F.array(
        when((pct | share) & ~full, "INCOMPLETE_LONG_SHORT_SHARES"),
        when((pct | share) & full & (F.abs(lo + sh - 1.0) > 0.02), "LONG_SHORT_SHARES_NOT_NORMALISED"),
        when(as_ratio & (ratio < 0), "INVALID_RATIO"),
        when(~pct & ~share & ~F.coalesce(as_ratio, lit(False)), "AMBIGUOUS_LONG_SHORT_UNIT")))
    return F.struct(out.alias("ratio"), lo.alias("long_share"), sh.alias("short_share"), warn.alias("warnings"))


def headline_class(title: Column, rules=HEADLINE_RULES) -> Column:
    def pick(t):
        out = lit("macro")
        for name, words in reversed(rules):
            out = when(any_of(t, words), name).otherwise(out)
        return out

    return bind(F.lower(F.coalesce(title, lit(""))), pick)


def figure(value: Column) -> Column:
    """Number of a calendar figure: thousands separators, %, K."""
    s = F.regexp_replace(F.trim(value), ",", "")
    kilo = s.endswith("K") | s.endswith("k")
    n = F.regexp_replace(s, "[%Kk]$", "").try_cast("double")
    return when(~value.isin("", "-"), n * when(kilo, 1000.0).otherwise(1.0))


def surprise(actual: Column, forecast: Column, name: Column) -> Column:
    bad = bind(F.lower(name), lambda n: any_of(n, BEARISH_IF_HIGHER))
    more = bind(F.struct(figure(actual).alias("a"), figure(forecast).alias("f")), lambda x: F.signum(x["a"] - x["f"]))
    sign = F.coalesce(more * when(bad, -1.0).otherwise(1.0), lit(0.0))
    return bind(sign, lambda s: when(s > 0, "bullish").when(s < 0, "bearish").otherwise("neutral"))


def impact_score(importance: Column, kind: Column, released: Column, impact: Column) -> Column:
    base = when(importance == "high", 72).when(importance == "low", 28).otherwise(48)
    extra = when(kind.isin("inflation", "central_bank", "jobs"), 10).when(kind.isin("growth", "energy"), 5).otherwise(0)
    news = when(released & impact.isin("bullish", "bearish"), 8).otherwise(0)
    return F.least(F.greatest(base + extra + news, lit(0)), lit(100))


def risk_level(score: Column) -> Column:
    return when(score >= 70, "high").when(score >= 45, "medium").otherwise("low")


def importance_rank(importance: Column) -> Column:
    i = F.lower(F.coalesce(importance, lit("medium")))
    return when(i == "high", 0).when(i == "low", 2).otherwise(1)


def curve_level(spread: Column) -> Column:
    return (when(spread < -0.5, "deeply_inverted").when(spread < 0, "inverted").when(spread < 0.5, "flat")
            .when(spread < 1.5, "normal").otherwise("steep"))


def vote(up: Column, down: Column) -> Column:
    """+1, -1 or 0; an unknown metric votes nothing."""
    return F.coalesce(when(up, 1).when(down, -1), lit(0))


def derivatives_bias(funding, oi, ratio) -> Column:
    s = vote(funding > 0, funding < 0) + vote(oi > 3, oi < -3) + vote(ratio > 1.2, ratio < 0.85)
    return when(s >= 2, "bullish").when(s <= -2, "bearish").otherwise("neutral")


def flow_bias(exchange, stable) -> Column:
    s = vote(exchange < 0, exchange > 0) + vote(stable > 0, stable < 0)
    return when(s >= 1, "bullish").when(s <= -1, "bearish").otherwise("neutral")


def squeeze_risk(funding, ratio, oi) -> Column:
    hot = ((funding > 0.03) & (ratio > 1.5) & (oi > 8)) | ((funding < -0.03) & (ratio < 0.75) & (oi > 8))
    warm = F.coalesce(F.abs(funding) > 0.015, lit(False)) | F.coalesce((ratio > 1.3) | (ratio < 0.85), lit(False))
    return when(F.coalesce(hot, lit(False)), "high").when(warm, "medium").otherwise("low")


def volume_state(change) -> Column:
    return when(change.isNull(), "unknown").when(change > 20, "expanding").when(change < -20, "shrinking").otherwise("stable")


def slippage_verdict(average, p90, matched, seconds) -> Column:
    """Struct level, reason: the bands widen with the bar length."""
    s = when(seconds <= 0, 60).otherwise(seconds)
    def pick(i):
        out = lit(SLIPPAGE_BANDS[-1][i])
        for band in reversed(SLIPPAGE_BANDS[:-1]):
            out = when(s < band[0], band[i]).otherwise(out)
        return out
    tail = F.coalesce(p90, lit(0.0))
    level = (when((matched < 5) | average.isNull(), "unknown").when((average <= pick(1)) & (tail <= pick(2)), "good")
             .when((average <= pick(3)) & (tail <= pick(4)), "warn").otherwise("bad"))
    return level


def stack_trend(price, ma5, ma10, ma20) -> Column:
    return (when((price > ma5) & (ma5 > ma10) & (ma10 > ma20), "strong_uptrend").when(price > ma20, "uptrend")
            .when((price < ma5) & (ma5 < ma10) & (ma10 < ma20), "strong_downtrend").when(price < ma20, "downtrend")
            .otherwise("sideways"))


def volatility_level(atr, price) -> Column:
    pct = when((price > 0) & (atr > 0), atr / price * 100.0).otherwise(0.0)
    return when(pct > 5, "high").when(pct > 2, "medium").when(atr > 0, "low").otherwise("unknown")


def active(value: Column) -> Column:
    """Is a marker value set (not null, finite, not zero)."""
    return F.coalesce(~F.isnan(value) & (value != 0) & (F.abs(value) != float("inf")), lit(False))


def alert_hit(kind, price, threshold, side, entry, size) -> Column:
    pnl = when(side == "long", price - entry).otherwise(entry - price) / F.nullif(entry, lit(0.0)) * 100.0
    open_ = (entry > 0) & (size > 0)
    hit = (when(kind == "price_above", price >= threshold).when(kind == "price_below", price <= threshold)
           .when(kind == "pnl_above", open_ & (pnl >= threshold)).when(kind == "pnl_below", open_ & (pnl <= threshold)))
    return F.coalesce((price > 0) & hit, lit(False))
