"""The same queries as DuckDB SQL, written from the definitions: windows, CASE, and recursion over the bar index."""

from __future__ import annotations

import math

from .operators.patterns import OFFSETS, PATTERNS, PENETRATION, THRESHOLDS, rule_sql
from .queries import UNIT

BARS = """bars AS (
  SELECT e.event_type AS key, date_trunc('hour', e.ts) AS hour, arg_min(e.value, struct_pack(t := e.ts, i := e.event_id)) AS open, max(e.value) AS high,
         min(e.value) AS low, arg_max(e.value, struct_pack(t := e.ts, i := e.event_id)) AS close, count(*)::DOUBLE AS volume
  FROM events e GROUP BY 1, 2),
b AS (
  SELECT *, close AS real0, high AS real1, volume * 3 AS periods, close / (1 + abs(close)) AS unit,
         row_number() OVER (PARTITION BY key ORDER BY hour) - 1 AS rn
  FROM bars)"""


def _final(source: str, values: dict[str, str], where: str = "TRUE") -> str:
    """values: output -> expression over source."""
    inner = ", ".join(f"({e})::DOUBLE AS {n}" for n, e in values.items())
    sound = " AND ".join(f"{n} IS NOT NULL AND NOT isnan({n})" for n in values)
    outer = ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in values)
    return f"SELECT key, rn, {outer} FROM (SELECT key, rn, {inner} FROM {source} WHERE {where}) WHERE {sound}"


def _w(rows: int, after: str = "") -> str:
    return f"OVER (PARTITION BY key ORDER BY rn ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW{after})"


_ALL = "OVER (PARTITION BY key ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY key ORDER BY rn)"


def simple(values: dict[str, str] | str, lookback: int = 0, steps: list[dict[str, str]] | None = None) -> str:
    """Windows in layers: each step adds columns that the next may use."""
    values = {"value": values} if isinstance(values, str) else values
    ctes, source = [BARS], "b"
    for k, columns in enumerate(steps or []):
        ctes.append(f"s{k} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {source})")
        source = f"s{k}"
    # Window values first, the lookback after: a filter would cut the windows.
    ctes.append(f"v AS (SELECT key, rn, {', '.join(f'({e})::DOUBLE AS {n}' for n, e in values.items())} FROM {source})")
    return f"WITH {', '.join(ctes)} {_final('v', {n: n for n in values}, f'rn >= {lookback}')}"


def recursion(states: list[tuple[str, str, str]], values: dict[str, str] | str, lookback: int, steps: list[dict[str, str]] | None = None, then: list[dict[str, str]] | None = None) -> str:
    """states: (name, value before the first bar, next value over the new row's columns, `p_name` of the last row and the new values of earlier states).

    then: layers of windows over the rows and their states.
    """
    values = {"value": values} if isinstance(values, str) else values
    ctes, source = [BARS], "b"
    for k, columns in enumerate(steps or []):
        ctes.append(f"s{k} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {source})")
        source = f"s{k}"
    ctes.append(f"x AS MATERIALIZED (SELECT * FROM {source})")
    begin = ", ".join(f"({i})::DOUBLE AS p_{n}" for n, i, _ in states)
    after = ", ".join(f"{n} AS p_{n}" for n, _, _ in states)
    # One subquery per state, so that a state may use the new values before it.
    inner = "(SELECT x.*, " + ", ".join(f"r.p_{n}" for n, _, _ in states) + " FROM r JOIN x ON x.key = r.key AND x.rn = r.rn + 1)"
    for n, _, e in states:
        inner = f"(SELECT *, ({e})::DOUBLE AS {n} FROM {inner})"
    ctes.append(f"r AS (SELECT key, -1::BIGINT AS rn, {begin} FROM (SELECT DISTINCT key FROM x) UNION ALL SELECT key, rn, {after} FROM {inner})")
    ctes.append("y AS (SELECT x.*, " + ", ".join(f"r.p_{n} AS {n}" for n, _, _ in states) + " FROM r JOIN x USING (key, rn))")
    source = "y"
    for k, columns in enumerate(then or []):
        ctes.append(f"y{k} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {source})")
        source = f"y{k}"
    ctes.append(f"v AS (SELECT key, rn, {', '.join(f'({e})::DOUBLE AS {n}' for n, e in values.items())} FROM {source})")
    return f"WITH RECURSIVE {', '.join(ctes)} {_final('v', {n: n for n in values}, f'rn >= {lookback}')}"


def _ema(name: str, x: str, p: int, first: int = 0, k: float | None = None) -> list[tuple[str, str, str]]:
    k, seed = 2.0 / (p + 1) if k is None else k, first + p - 1
    return [
        (f"{name}_sum", "0", f"p_{name}_sum + CASE WHEN rn BETWEEN {first} AND {seed} THEN {x} ELSE 0 END"),
        (name, "NULL", f"CASE WHEN rn < {seed} THEN NULL WHEN rn = {seed} THEN {name}_sum / {p} ELSE {x} * {k!r} + p_{name} * (1 - {k!r}) END"),
    ]


def _chain(p: int, count: int) -> list[tuple[str, str, str]]:
    return [s for j in range(count) for s in _ema(f"e{j + 1}", f"e{j}" if j else "close", p, j * (p - 1))]


def _wsum(name: str, x: str, p: int) -> list[tuple[str, str, str]]:
    return [(name, "0", f"CASE WHEN rn = 0 THEN 0 WHEN rn < {p} THEN p_{name} + {x} ELSE p_{name} * (1 - 1.0 / {p}) + {x} END")]


_TR = f"greatest(high - low, abs(high - {_lag('close')}), abs(low - {_lag('close')}))"
_MOVES = [
    {"up": f"high - {_lag('high')}", "dn": f"{_lag('low')} - low", "tr": _TR},
    {"pdm": "CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END", "mdm": "CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END"},
]
_STEP = [{"d": f"close - {_lag('close')}"}, {"gain": "greatest(d, 0)", "loss": "greatest(-d, 0)"}]
_DX = "CASE WHEN ps + ms = 0 THEN 0 ELSE 100 * abs(ps - ms) / (ps + ms) END"


def _extremum_index(column: str, p: int, largest: bool, latest: bool) -> str:
    order = f"struct_pack(a := {column if largest else '-' + column}, b := {'rn' if latest else '-rn'})"
    return f"arg_max(rn, {order}) {_w(p)}"


def _ma_line(name: str) -> str:
    return {
        "sma": simple(f"avg(close) {_w(20)}", 19),
        "wma": simple(" + ".join(f"{20 - k} * {_lag('close', k) if k else 'close'}" for k in range(20)).join(("(", ") / 210.0")), 19),
        "trima": simple(f"sum(s) {_w(7)} / 56.0", 13, [{"s": f"sum(close) {_w(8)}"}]),
    }[name]


def _slope(p: int) -> str:
    return f"regr_slope(close, rn) {_w(p)}"


def _macd(fast: int, slow: int, signal: int, fk: float | None = None, sk: float | None = None) -> str:
    states = [*_ema("f", "close", fast, slow - fast, fk), *_ema("s", "close", slow, 0, sk), ("m", "NULL", "f - s"), *_ema("g", "m", signal, slow - 1)]
    return recursion(states, {"macd": "m", "signal": "g", "hist": "m - g"}, slow + signal - 2)


def _raw_k(p: int, h: str = "high", l: str = "low", c: str = "close") -> dict[str, str]:  # noqa: E741
    return {"hh": f"max({h}) {_w(p)}", "ll": f"min({l}) {_w(p)}"} | {}


def _sar(signed: bool) -> str:
    """One row's state: side (1 long), extreme, pace, stop."""
    prior_low = "CASE WHEN rn >= 3 THEN least(l1, l2) ELSE l1 END"
    prior_high = "CASE WHEN rn >= 3 THEN greatest(h1, h2) ELSE h1 END"
    states = [
        ("side0", "NULL", "CASE WHEN rn = 1 THEN CASE WHEN high >= h1 THEN 1 ELSE 0 END ELSE p_side END"),
        ("ext0", "NULL", "CASE WHEN rn = 1 THEN CASE WHEN side0 = 1 THEN high ELSE low END ELSE p_ext END"),
        ("stop0", "NULL", "CASE WHEN rn = 1 THEN CASE WHEN side0 = 1 THEN l1 ELSE h1 END ELSE p_stop END"),
        ("pace0", "NULL", "CASE WHEN rn = 1 THEN 0.02 ELSE p_pace END"),
        ("raw", "NULL", "stop0 + pace0 * (ext0 - stop0)"),
        ("clamped", "NULL", f"CASE WHEN side0 = 1 THEN least(raw, {prior_low}) ELSE greatest(raw, {prior_high}) END"),
        ("turned", "NULL", "CASE WHEN side0 = 1 AND low <= clamped OR side0 = 0 AND high >= clamped THEN 1 ELSE 0 END"),
        ("side", "NULL", "CASE WHEN rn = 0 THEN NULL WHEN turned = 1 THEN 1 - side0 ELSE side0 END"),
        ("stop", "NULL", f"CASE WHEN rn = 0 THEN NULL WHEN turned = 0 THEN clamped WHEN side0 = 1 THEN greatest(ext0, {prior_high}) ELSE least(ext0, {prior_low}) END"),
        ("fresh", "NULL", "CASE WHEN turned = 0 AND (side0 = 1 AND high > ext0 OR side0 = 0 AND low < ext0) THEN 1 ELSE 0 END"),
        ("pace", "NULL", "CASE WHEN turned = 1 THEN 0.02 WHEN fresh = 1 THEN least(pace0 + 0.02, 0.2) ELSE pace0 END"),
        ("ext", "NULL", "CASE WHEN turned = 1 OR fresh = 1 THEN CASE WHEN side = 1 THEN high ELSE low END ELSE ext0 END"),
    ]
    steps = [{"h1": _lag("high"), "h2": _lag("high", 2), "l1": _lag("low"), "l2": _lag("low", 2)}]
    return recursion(states, "CASE WHEN side = 1 THEN stop ELSE -stop END" if signed else "stop", 1, steps)


def _cycle(start: int) -> tuple[list[tuple[str, str, str]], list[dict[str, str]]]:
    """(states, steps) of the dominant cycle; start: its first bar.

    A Hilbert line is a filter over every second of the last seven bars: with nothing before `start`,
    its two interleaved rings are the taps 0.0962, 0.5769, -0.5769, -0.0962 at lags 0, 2, 4, 6.
    """
    taps = lambda x: f"(0.0962 * {x[0]} + 0.5769 * {x[1]} - 0.5769 * {x[2]} - 0.0962 * {x[3]})"
    begun = lambda e: f"CASE WHEN rn < {start} THEN 0 ELSE {e} END"
    shifts = lambda x, n: [(f"{x}{k}", "0", f"p_{x}{k - 1 or ''}") for k in range(1, n + 1)]
    states = [
        ("adj", "0", "0.075 * p_period + 0.54"),
        ("d", "0", "line * adj"), *shifts("d", 9),
        ("q", "0", taps(["d", "d2", "d4", "d6"]) + " * adj"), *shifts("q", 6),
        ("ji", "0", taps(["d3", "d5", "d7", "d9"]) + " * adj"),
        ("jq", "0", taps(["q", "q2", "q4", "q6"]) + " * adj"),
        ("ii", "0", "0.2 * (d3 - jq) + 0.8 * p_ii"),
        ("qq", "0", "0.2 * (q + ji) + 0.8 * p_qq"),
        ("re", "0", "0.2 * (ii * p_ii + qq * p_qq) + 0.8 * p_re"),
        ("im", "0", "0.2 * (ii * p_qq - qq * p_ii) + 0.8 * p_im"),
        ("raw", "0", "CASE WHEN re <> 0 AND im <> 0 THEN 360 / degrees(atan(im / re)) ELSE p_period END"),
        ("held", "0", "greatest(6.0, least(50.0, greatest(0.67 * p_period, least(1.5 * p_period, raw))))"),
        ("period", "0", begun("0.2 * held + 0.8 * p_period")),
        ("sp", "0", begun("0.33 * period + 0.67 * p_sp")),
    ]
    back = lambda k: f"coalesce({_lag('s', k)}, 0)"
    steps = [{"s": begun(f"(4 * close + 3 * {_lag('close')} + 2 * {_lag('close', 2)} + {_lag('close', 3)}) / 10.0")}, {"line": taps(["s", back(2), back(4), back(6)])}]
    return states, steps


def _phase(values: dict[str, str] | str, lookback: int) -> str:
    """The cycle's phase, its waves, trendline and mode, as windows over the cycle.

    A bar whose cosine part is exactly zero (only at the start, where the period rounds to no bars) has no
    phase here; none of the outputs, which begin at bar 63, reaches back to it.
    """
    states, steps = _cycle(37)
    ago = lambda x: f"coalesce({_lag(x)}, 0)"
    # Newest bar first, one after the other.
    total = lambda x: f"list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(n), lambda k: ({x})::DOUBLE)), lambda x, y: x + y)"
    wave = lambda f: total(f"CASE WHEN k < len(ss) THEN {f}(2 * pi() * k / n) * ss[len(ss) - k] ELSE 0 END")
    then = [
        {"n": "CASE WHEN rn < 37 THEN 0 ELSE floor(sp + 0.5) END::BIGINT", "ss": f"list(s) {_w(50)}", "cs": f"list(close) {_w(50)}"},
        {"a": wave("sin"), "b": wave("cos"), "mean": f"CASE WHEN n = 0 THEN 0 ELSE {total('cs[greatest(len(cs) - k, 1)]')} / n END"},
        {"turn": "degrees(atan(a / b)) + 90 + 360 / sp + CASE WHEN b < 0 THEN 180 ELSE 0 END"},
        {"phase": "CASE WHEN turn > 315 THEN turn - 360 ELSE turn END", "trend": "(4 * mean + " + " + ".join(f"{4 - k} * coalesce({_lag('mean', k)}, 0)" for k in (1, 2, 3)) + ") / 10.0"},
        {"sine": "coalesce(sin(radians(phase)), 0)", "lead": "coalesce(sin(radians(phase + 45)), 0)"},
        {"crossed": f"rn >= 37 AND (sine > lead AND {ago('sine')} <= {ago('lead')} OR sine < lead AND {ago('sine')} >= {ago('lead')})", "moved": f"phase - {ago('phase')}"},
        {"days": f"rn + 1 - coalesce(max(CASE WHEN crossed THEN rn END) {_ALL}, 37)"},
    ]
    return recursion(states, values, lookback, steps, then)


def _hikkake(modified: bool) -> str:
    inside = "h1 < h2 AND l1 > l2"
    near = ""
    if modified:
        inside = "h2 < h3 AND l2 > l3 AND h1 < h2 AND l1 > l2 AND rn >= 3"
        near = "near"
    down = "high < h1 AND low < l1" + (f" AND c2 <= l2 + {near}" if near else "")
    up = "high > h1 AND low > l1" + (f" AND c2 >= h2 - {near}" if near else "")
    states = [
        ("setup", "0", f"CASE WHEN coalesce(({inside}) AND (({down}) OR ({up})), FALSE) THEN CASE WHEN high < h1 THEN 100 ELSE -100 END ELSE 0 END"),
        ("confirmed", "0", "CASE WHEN setup = 0 AND p_pending <> 0 AND rn <= p_since + 3 AND (p_pending > 0 AND close > p_top OR p_pending < 0 AND close < p_bottom) THEN 1 ELSE 0 END"),
        ("code", "0", "CASE WHEN setup <> 0 THEN setup WHEN confirmed = 1 THEN 2 * p_pending ELSE 0 END"),
        ("since", "0", "CASE WHEN setup <> 0 THEN rn WHEN confirmed = 1 THEN 0 ELSE p_since END"),
        ("top", "NULL", "CASE WHEN setup <> 0 THEN h1 ELSE p_top END"),
        ("bottom", "NULL", "CASE WHEN setup <> 0 THEN l1 ELSE p_bottom END"),
        ("pending", "0", "CASE WHEN setup <> 0 THEN setup WHEN confirmed = 1 THEN 0 ELSE p_pending END"),
    ]
    steps = [{f"{c[0]}{k}": _lag(c, k) for c in ("high", "low", "close") for k in (1, 2, 3)} | {"hl": "high - low"}]
    fixed = lambda k: f"max(CASE WHEN rn = {k} THEN high - low END) OVER (PARTITION BY key)"
    steps.append({"near": f"0.2 / 5 * (CASE WHEN rn >= 6 THEN {fixed(1)} + {fixed(2)} + {_lag('hl', 3)} + {_lag('hl', 4)} + {_lag('hl', 5)} "
                          f"WHEN rn = 5 THEN {fixed(0)} + 2 * {fixed(1)} + 2 * {fixed(2)} WHEN rn = 4 THEN {fixed(0)} + 2 * {fixed(1)} + {fixed(2)} ELSE {fixed(0)} + {fixed(1)} + {fixed(2)} END)"})
    return recursion(states, f"CASE WHEN rn >= {8 if modified else 2} THEN code ELSE 0 END", 0, steps)


def pattern(name: str) -> str:
    lookback, rules = PATTERNS[name]
    names: dict[tuple[str, int], str] = {}

    def threshold(kind: str, anchor: int) -> str:
        return names.setdefault((kind, anchor), f"t_{kind.lower()}_{anchor}")

    cases = " ".join(f"WHEN {rule_sql(rule, threshold, PENETRATION.get(name))} THEN {rule_sql(code, threshold)}" for rule, code in rules)
    lags = {f"{c[0]}{k}": _lag(c, k) if k else c for c in ("open", "high", "low", "close") for k in range(5)}
    amounts = {
        "q_rb": "abs(close - open)", "q_hl": "high - low", "q_us": "high - greatest(open, close)",
        "q_sh": "high - greatest(open, close) + least(open, close) - low",
    }
    means = {}
    for (kind, anchor), column in names.items():
        quantity, n, factor = THRESHOLDS[kind]
        q = f"q_{quantity.lower()}"
        total = f"sum({q}) OVER (PARTITION BY key ORDER BY rn ROWS BETWEEN {anchor + n} PRECEDING AND {anchor + 1} PRECEDING)"
        if seed := OFFSETS.get((name, f"{kind}@{anchor}")):
            over = lambda a, z, q=q: f"sum(CASE WHEN rn BETWEEN {a} AND {z} THEN {q} ELSE 0 END) OVER (PARTITION BY key)"
            total = f"({total} + {over(*seed)} - {over(lookback - anchor - n, lookback - anchor - 1)})"
        means[column] = f"{total} * {factor} / {n}"
    return simple(f"CASE WHEN rn < {lookback} THEN 0 {cases} ELSE 0 END", 0, [lags | amounts, means or {"none_": "0"}])


#: The long series of queries.LONG: a bar per order.
LINES = """bars AS (
  SELECT l_orderkey AS ts, arg_min(v, struct_pack(n := l_linenumber, v := v)) AS open, max(v) AS high, min(v) AS low,
         arg_max(v, struct_pack(n := l_linenumber, v := v)) AS close, count(*)::DOUBLE AS volume
  FROM (SELECT *, l_extendedprice / 997 AS v FROM lineitem) GROUP BY 1),
b AS (SELECT *, 'all' AS key, close AS real0, high AS real1, row_number() OVER (ORDER BY ts) - 1 AS rn FROM bars)"""


def _decayed(name: str, source: str, x: str, seed: str, at: int, keep: float, share: float) -> str:
    """CTE name(rn, v): v is `seed` at bar `at`, then v keep + x share, without a recursion.

    A bar's value is the sum of what is left of the inputs before it; inputs of which less than 1e-18 is left don't count.
    """
    back = math.ceil(-41.5 / math.log(keep))
    return f"""{name} AS (
  SELECT a.rn, CASE WHEN a.rn >= {at} THEN (SELECT {seed} FROM {source}) * pow({keep!r}, a.rn - {at}) + coalesce(sum(z.x * {share!r} * pow({keep!r}, a.rn - z.rn)), 0) END AS v
  FROM {source} a CROSS JOIN range({back}) o(j) LEFT JOIN (SELECT rn, {x} AS x FROM {source} WHERE rn > {at}) z ON z.rn = a.rn - o.j GROUP BY a.rn)"""


def _long_mean(name: str, source: str, x: str, p: int, first: int = 0, k: float | None = None) -> str:
    k, at = 2.0 / (p + 1) if k is None else k, first + p - 1
    return _decayed(name, source, x, f"avg({x}) FILTER (rn BETWEEN {first} AND {at})", at, 1 - k, k)


def _long(ctes: list[str], values: dict[str, tuple[str, int]], tables: list[str]) -> str:
    """values: column -> (expression, lookback). tables: what is joined by rn to the bars with their windows, w."""
    columns = ", ".join(f"round(CASE WHEN w.rn >= {n} THEN {e} END, 6) + 0.0 AS {c}" for c, (e, n) in values.items())
    joins = " ".join(f"JOIN {t} USING (rn)" for t in tables)
    return f"WITH {', '.join([LINES, *ctes])} SELECT w.rn AS rn, {columns} FROM w {joins}"


def _long_layers(*layers: dict[str, str]) -> list[str]:
    """CTEs l0, l1, ... of columns added to the bars; the last one is w."""
    names = ["b", *(f"l{k}" for k in range(len(layers) - 1)), "w"]
    return [f"{new} AS (SELECT *, {', '.join(f'({e})::DOUBLE AS {c}' for c, e in layer.items())} FROM {old})" for layer, old, new in zip(layers, names, names[1:])]


def long_sql() -> dict[str, str]:
    out = {}
    weights = " + ".join(f"{20 - k} * {_lag('close', k) if k else 'close'}" for k in range(20))
    layers = _long_layers(
        {
            "sma": f"avg(close) {_w(20)}", "wma": f"({weights}) / 210.0", "s8": f"sum(close) {_w(8)}", "stddev": f"stddev_pop(close) {_w(5)}", "mom": f"close - {_lag('close', 10)}", "max": f"max(close) {_w(30)}",
            "hh": f"max(high) {_w(14)}", "ll": f"min(low) {_w(14)}", "tp": "(high + low + close) / 3", "cov": f"covar_pop(real0, real1) {_w(30)}", "sd": f"stddev_pop(real0) {_w(30)} * stddev_pop(real1) {_w(30)}",
            "lr": f"avg(close) {_w(14)} + 6.5 * {_slope(14)}", "h5": f"max(high) {_w(5)}", "l5": f"min(low) {_w(5)}",
        },
        {"trima": f"sum(s8) {_w(7)} / 56.0", "m": f"avg(tp) {_w(20)}", "k": "CASE WHEN rn < 4 THEN NULL WHEN h5 = l5 THEN 0 ELSE 100 * (close - l5) / (h5 - l5) END"},
        {"dev": "(" + " + ".join(f"abs({_lag('tp', k) if k else 'tp'} - m)" for k in range(20)) + ") / 20", "slow": f"CASE WHEN rn < 6 THEN NULL ELSE avg(k) {_w(3)} END"},
        {"slowd": f"avg(slow) {_w(3)}"},
    )
    out["long_windows"] = _long(layers, {
        "sma": ("sma", 19), "wma": ("wma", 19), "trima": ("trima", 13), "stddev": ("stddev", 4), "mom": ("mom", 10), "max": ("max", 29), "willr": ("CASE WHEN hh = ll THEN 0 ELSE -100 * (hh - close) / (hh - ll) END", 13),
        "cci": ("CASE WHEN dev = 0 THEN 0 ELSE (tp - m) / (0.015 * dev) END", 19), "correl": ("CASE WHEN sd = 0 THEN 0 ELSE cov / sd END", 29), "linearreg": ("lr", 13), "stoch_slowk": ("slow", 8), "stoch_slowd": ("slowd", 8)}, [])
    ratio = lambda p: f"CASE WHEN sum(range) {_w(p)} = 0 THEN 0 ELSE sum(bp) {_w(p)} / sum(range) {_w(p)} END"
    money = "CASE WHEN high > low THEN (2 * close - high - low) / (high - low) * volume ELSE 0 END"
    running = _long_layers(
        {"pc": _lag("close"), "ad": f"sum({money}) {_ALL}"},
        {"step": "CASE WHEN pc IS NULL THEN volume WHEN close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END", "bp": "close - least(low, pc)", "range": "greatest(high, pc) - least(low, pc)"},
        {"bp": "CASE WHEN pc IS NOT NULL THEN bp END", "range": "CASE WHEN pc IS NOT NULL THEN range END"},
        {"obv": f"sum(step) {_ALL}", **{f"r{p}": ratio(p) for p in (7, 14, 28)}, "mean": f"avg(close) {_w(20)}", "sd": f"stddev_pop(close) {_w(20)}"},
    )
    running[2] = running[2].replace("SELECT *,", "SELECT * EXCLUDE (bp, range),")
    out["long_running"] = _long(running, {"obv": ("obv", 0), "ad": ("ad", 0), "ultosc": ("100 * (4 * r7 + 2 * r14 + r28) / 7", 28), "bbands_upper": ("mean + 2 * sd", 19), "bbands_middle": ("mean", 19), "bbands_lower": ("mean - 2 * sd", 19)}, [])
    bars_ = ["w AS (SELECT * FROM b)"]
    means = [*bars_, *(_long_mean(f"d{j + 1}", f"d{j}" if j else "b", "v" if j else "close", 20, 19 * j) for j in range(3)), *(_long_mean(f"t{j + 1}", f"t{j}" if j else "b", "v" if j else "close", 5, 4 * j) for j in range(6)), f"x AS (SELECT rn, {_lag('v').replace('PARTITION BY key ', '')} AS v FROM t3)"]
    v = 0.7
    t3 = f"{-(v**3)!r} * t6.v + {3 * v**2 + 3 * v**3!r} * t5.v + {-6 * v**2 - 3 * v - 3 * v**3!r} * t4.v + {1 + 3 * v + v**3 + 3 * v**2!r} * t3.v"
    out["long_means"] = _long(means, {"ema": ("d1.v", 19), "dema": ("2 * d1.v - d2.v", 38), "tema": ("3 * d1.v - 3 * d2.v + d3.v", 57), "t3": (t3, 24), "trix": ("CASE WHEN x.v = 0 THEN 0 ELSE 100 * (t3.v - x.v) / x.v END", 13)}, [*(f"d{j}" for j in (1, 2, 3)), *(f"t{j}" for j in range(1, 7)), "x"])
    moves = _long_layers(*_MOVES[:1], _MOVES[1] | {"d": f"close - {_lag('close')}", "ad": f"sum({money}) {_ALL}"}, {"gain": "greatest(d, 0)", "loss": "greatest(-d, 0)"})
    total = lambda n, x: _decayed(n, "w", x, f"sum({x}) FILTER (rn BETWEEN 1 AND 13)", 13, 1 - 1 / 14, 1.0)
    plain = lambda n, p: _decayed(n, "w", "ad", "max(ad) FILTER (rn = 0)", 0, 1 - 2 / (p + 1), 2 / (p + 1))
    momentum = [
        *moves, _long_mean("f", "w", "close", 12, 14), _long_mean("s", "w", "close", 26), "line AS (SELECT f.rn AS rn, f.v - s.v AS m FROM f JOIN s USING (rn))", _long_mean("g", "line", "m", 9, 25),
        _long_mean("up", "w", "gain", 14, 1, 1 / 14), _long_mean("dn", "w", "loss", 14, 1, 1 / 14), _long_mean("tr", "w", "tr", 14, 1, 1 / 14).replace("tr AS (", "atr AS (", 1), total("ps", "pdm"), total("ms", "mdm"),
        "dx AS (SELECT ps.rn AS rn, CASE WHEN ps.v + ms.v = 0 THEN 0 ELSE 100 * abs(ps.v - ms.v) / (ps.v + ms.v) END AS x FROM ps JOIN ms USING (rn))", _long_mean("adx", "dx", "x", 14, 14, 1 / 14), plain("fast", 3), plain("slow", 10),
    ]
    out["long_momentum"] = _long(momentum, {
        "macd_macd": ("line.m", 33), "macd_signal": ("g.v", 33), "macd_hist": ("line.m - g.v", 33), "rsi": ("CASE WHEN up.v = 0 THEN 0 WHEN dn.v = 0 THEN 100 ELSE 100 - 100 / (1 + up.v / dn.v) END", 14), "atr": ("atr.v", 14),
        "adx": ("adx.v", 27), "adosc": ("fast.v - slow.v", 9)}, ["line", "g", "up", "dn", "atr", "adx", "fast", "slow"])
    names = ("cdlengulfing", "cdldoji", "cdlharami", "cdl3outside", "cdlmorningstar", "cdlmatchinglow")
    parts = [f"{n} AS (SELECT rn, value AS {n} FROM ({pattern(n).replace(BARS, LINES)}))" for n in names]
    out["long_patterns"] = f"WITH {', '.join(parts)} SELECT rn, {', '.join(names)} FROM {names[0]} " + " ".join(f"JOIN {n} USING (rn)" for n in names[1:])
    return out


def _whole(sql: str, values: dict[str, tuple[str, int]], nan: dict[str, str] | None = None) -> str:
    """All bars of `v` in a statement of simple() or recursion(): each output from its lookback on, and where it is NaN."""
    head, _, _ = sql.rpartition(" SELECT key, rn, round(")
    spoiled = {c: f"rn >= {n} AND coalesce({(nan or {}).get(c, 'FALSE')}, FALSE)" for c, (_, n) in values.items()}
    columns = [f"CASE WHEN rn >= {n} AND NOT ({spoiled[c]}) THEN round({e}, 6) + 0.0 END AS {c}, {spoiled[c]} AS {c}_nan" for c, (e, n) in values.items()]
    return f"{head} SELECT key, rn, {', '.join(columns)} FROM v"


def _weighted(x: str, p: int) -> str:
    return "(" + " + ".join(f"{p - k} * {_lag(x, k) if k else x}" for k in range(p)) + f") / {p * (p + 1) / 2}"


def _adaptive(p: int) -> tuple[list[tuple[str, str, str]], list[dict[str, str]]]:
    """(state `kama`, steps) of the adaptive mean over p bars."""
    fast, slow = 2.0 / 3.0, 2.0 / 31.0
    states = [("kama", "NULL", f"CASE WHEN rn < {p - 1} THEN NULL WHEN rn = {p - 1} THEN close ELSE p_kama + c * (close - p_kama) END")]
    steps = [
        {"move": f"abs(close - {_lag('close')})", "net": f"abs(close - {_lag('close', p)})"}, {"path": f"sum(move) {_w(p)}"},
        {"c": f"((CASE WHEN path > 0 THEN net / path ELSE 0 END) * {fast - slow!r} + {slow!r}) ** 2"},
    ]
    return states, steps


def whole_sql() -> dict[str, str]:
    """The queries of queries.WHOLE."""
    out = {}
    kama, steps = _adaptive(10)
    steps = [*steps, {"sma": f"avg(close) {_w(10)}", "wma": _weighted("close", 10), "s6": f"sum(close) {_w(6)}"}, {"trima": f"sum(s6) {_w(5)} / 30.0"}]
    v = 0.7
    t3 = f"{-(v**3)!r} * e6 + {3 * v**2 + 3 * v**3!r} * e5 + {-6 * v**2 - 3 * v - 3 * v**3!r} * e4 + {1 + 3 * v + v**3 + 3 * v**2!r} * e3"
    types = [("sma", 9), ("e1", 9), ("wma", 9), ("2 * e1 - e2", 18), ("3 * e1 - 3 * e2 + e3", 27), ("trima", 9), ("kama", 10), ("e1", 9), (t3, 54)]
    names = [f"type{t}" for t in range(9)]
    out["ma_types"] = _whole(recursion([*_chain(10, 6), *kama], dict(zip(names, (e for e, _ in types))), 0, steps), {n: (n, b) for n, (_, b) in zip(names, types)})

    kama, steps = _adaptive(12)
    steps = [*steps, {"sma": f"avg(close) {_w(26)}", "wma": _weighted("close", 26), "s14": f"sum(close) {_w(14)}"}, {"trima": f"sum(s14) {_w(13)} / 182.0"}]
    line = lambda n, e: (n, "NULL", f"CASE WHEN rn < 25 THEN NULL ELSE {e} END")
    states = [
        *_ema("fast", "close", 12), line("m1", "fast - sma"),
        *_ema("d1", "close", 12), *_ema("d2", "d1", 12, 11), line("m2", "2 * d1 - d2 - wma"), *_ema("g", "m2", 9, 25),
        *kama, line("m3", "kama - trima"), *_ema("h1", "m3", 9, 25), *_ema("h2", "h1", 9, 33), *_ema("h3", "h2", 9, 41),
    ]
    lines = {"mean": ("m1", "g1", 33), "double": ("m2", "g", 33), "adaptive": ("m3", "3 * h1 - 3 * h2 + h3", 49)}
    values = {f"{n}_{o}": (e, b) for n, (m, g, b) in lines.items() for o, e in (("macd", m), ("signal", g), ("hist", f"{m} - ({g})"))}
    sql = recursion(states, {n: e for n, (e, _) in values.items()}, 0, steps, [{"g1": _weighted("m1", 9)}])
    out["macdext_types"] = _whole(sql, {n: (n, b) for n, (_, b) in values.items()})

    # Sums that run along stay NaN once a NaN has come in; windows that are looked at anew recover.
    gaps = {"gap": "floor(close * 100)::BIGINT % 199 = 7"}
    known = {"x": "CASE WHEN NOT gap THEN close END"}
    ever, within = f"bool_or(gap) {_ALL}", lambda p: f"bool_or(gap) {_w(p)}"
    nan = {"ever": ever, "last14": within(14), "last30": within(30), "all30": f"bool_and(gap) {_w(30)}", "ago10": _lag("gap", 10), "o1": _lag("open"), "x1": _lag("x")}
    values = {
        "sma": (f"avg(x) {_w(20)}", 19, "ever"), "wma": (_weighted("x", 20), 19, "ever"), "stddev": (f"stddev_pop(x) {_w(5)}", 4, "ever"), "mom": (f"x - {_lag('x', 10)}", 10, "gap OR ago10"),
        "linearreg": (f"avg(x) {_w(14)} + 6.5 * regr_slope(x, rn) {_w(14)}", 13, "last14"), "trange": ("CASE WHEN x1 IS NULL THEN high - low ELSE greatest(high - low, abs(high - x1), abs(low - x1)) END", 1, "FALSE"),
        "max": (f"max(x) {_w(30)}", 29, "last30"), "min": (f"min(x) {_w(30)}", 29, "all30"),
        "obv": (f"sum(CASE WHEN rn = 0 THEN volume WHEN x > x1 THEN volume WHEN x < x1 THEN -volume ELSE 0 END) {_ALL}", 0, "FALSE"),
        "engulfing": ("CASE WHEN x1 < o1 AND x >= open AND x > o1 AND open < x1 THEN 100 WHEN x1 >= o1 AND x < open AND x < o1 AND open > x1 THEN -100 ELSE 0 END", 0, "FALSE"),
    }
    states = _ema("ema", "x", 20)
    # A search as a scan does it: anew, from the window's oldest bar on, when the last extremum has left or is NaN; else the newest bar alone.
    for n, pick, beats in (("max", "arg_max", ">"), ("min", "arg_min", "<")):
        place = f"struct_pack(a := x, b := {'-rn' if n == 'max' else 'rn'})"
        nan |= {f"w_{n}": f"{n}(x) {_w(30)}", f"i_{n}": f"{pick}(rn, {place}) FILTER (WHERE NOT gap) {_w(30)}", "old": _lag("gap", 29)}
        states += [
            (f"anew_{n}", "0", f"CASE WHEN rn >= 29 AND (p_{n}_i < rn - 29 OR p_{n}_v IS NULL) THEN 1 ELSE 0 END"),
            (f"{n}_v", "NULL", f"CASE WHEN rn < 29 THEN NULL WHEN anew_{n} = 1 THEN CASE WHEN NOT old THEN w_{n} END WHEN x {beats} p_{n}_v THEN x ELSE p_{n}_v END"),
            (f"{n}_i", "-1", f"CASE WHEN rn < 29 THEN -1 WHEN anew_{n} = 1 THEN CASE WHEN old THEN rn - 29 ELSE i_{n} END WHEN x {beats} p_{n}_v THEN rn ELSE p_{n}_i END"),
        ]
        values |= {f"search_{n}": (f"{n}_v", 29, f"none_{n}"), f"search_{n}index": (f"{n}_i", 29, "FALSE")}
    flags = {f: f for f in ("gap", "ever", "last14", "last30", "all30", "ago10")} | {f"none_{n}": f"{n}_v IS NULL" for n in ("max", "min")}
    sql = recursion(states, {n: e for n, (e, _, _) in values.items()} | {"ema": "ema"} | flags, 0, [gaps, known, nan])
    out["nan_bars"] = _whole(sql, {n: (n, b) for n, (_, b, _) in values.items()} | {"ema": ("ema", 19)}, {n: " OR ".join(f"{f} <> 0" for f in s.split(" OR ")) for n, (_, _, s) in values.items() if s != "FALSE"} | {"ema": "ever <> 0"})
    return out


def oracle_sql() -> dict[str, str]:
    c, d = "close", "close"
    out = {n: simple(f"{n}(unit)") for n in UNIT}
    out |= {"ceil": simple("ceil(close)"), "floor": simple("floor(close)"), "sqrt": simple("sqrt(close)"), "ln": simple("ln(close)"), "log10": simple("log10(close)")}
    out |= {n: simple(f"real0 {s} real1") for n, s in (("add", "+"), ("sub", "-"), ("mult", "*"), ("div", "/"))}
    out |= {
        "avgprice": simple("(open + high + low + close) / 4"), "medprice": simple("(high + low) / 2"), "typprice": simple("(high + low + close) / 3"), "wclprice": simple("(high + low + 2 * close) / 4"),
        "bop": simple("CASE WHEN high = low THEN 0 ELSE (close - open) / (high - low) END"),
    }
    out |= {n: _ma_line(n) for n in ("sma", "wma", "trima")}
    out["mavp"] = simple("list_avg(list_slice(xs, 31 - p, 30))", 29, [{"p": "greatest(2, least(30, round(periods)))::BIGINT", "xs": f"list(close) {_w(30)}"}])
    out["bbands"] = simple({"upper": f"avg(close) {_w(20)} + 2 * stddev_pop(close) {_w(20)}", "middle": f"avg(close) {_w(20)}", "lower": f"avg(close) {_w(20)} - 2 * stddev_pop(close) {_w(20)}"}, 19)
    out["midpoint"] = simple(f"(max(close) {_w(14)} + min(close) {_w(14)}) / 2", 13)
    out["midprice"] = simple(f"(max(high) {_w(14)} + min(low) {_w(14)}) / 2", 13)
    lagged = [{"q": _lag("close", 10)}]
    out |= {
        "mom": simple("close - q", 10, lagged), "roc": simple("CASE WHEN q = 0 THEN 0 ELSE 100 * (close - q) / q END", 10, lagged), "rocp": simple("CASE WHEN q = 0 THEN 0 ELSE (close - q) / q END", 10, lagged),
        "rocr": simple("CASE WHEN q = 0 THEN 0 ELSE close / q END", 10, lagged), "rocr100": simple("CASE WHEN q = 0 THEN 0 ELSE 100 * (close / q) END", 10, lagged),
    }
    two = [{"f": f"avg(close) {_w(12)}", "s": f"avg(close) {_w(26)}"}]
    out |= {"apo": simple("f - s", 25, two), "ppo": simple("CASE WHEN s = 0 THEN 0 ELSE 100 * (f - s) / s END", 25, two)}
    out |= {
        "max": simple(f"max(close) {_w(30)}", 29), "min": simple(f"min(close) {_w(30)}", 29), "sum": simple(f"sum(close) {_w(30)}", 29),
        "maxindex": simple(_extremum_index(c, 30, True, False), 29), "minindex": simple(_extremum_index(c, 30, False, False), 29),
        "minmax": simple({"min": f"min(close) {_w(30)}", "max": f"max(close) {_w(30)}"}, 29),
        "minmaxindex": simple({"min_idx": _extremum_index(c, 30, False, False), "max_idx": _extremum_index(d, 30, True, False)}, 29),
    }
    up, down = (f"100.0 * (14 - (rn - {_extremum_index(x, 15, big, True)})) / 14" for x, big in (("high", True), ("low", False)))
    out |= {"aroon": simple({"up": up, "down": down}, 14), "aroonosc": simple(f"{up} - {down}", 14)}
    raw = [_raw_k(5), {"k": "CASE WHEN rn < 4 THEN NULL WHEN hh = ll THEN 0 ELSE 100 * (close - ll) / (hh - ll) END"}]
    out["stoch"] = simple({"slowk": "s", "slowd": f"avg(s) {_w(3)}"}, 8, [*raw, {"s": f"CASE WHEN rn < 6 THEN NULL ELSE avg(k) {_w(3)} END"}])
    out["stochf"] = simple({"fastk": "k", "fastd": f"avg(k) {_w(3)}"}, 6, raw)
    out["willr"] = simple("CASE WHEN hh = ll THEN 0 ELSE -100 * (hh - close) / (hh - ll) END", 13, [_raw_k(14)])
    out["cci"] = simple("CASE WHEN dev = 0 THEN 0 ELSE (tp - m) / (0.015 * dev) END", 19, [
        {"tp": "(high + low + close) / 3"}, {"m": f"avg(tp) {_w(20)}", "xs": f"list(tp) {_w(20)}"}, {"dev": "list_sum(list_transform(xs, lambda x: abs(x - m))) / 20"}])
    out["mfi"] = simple("CASE WHEN a + z = 0 THEN 0 ELSE 100 * a / (a + z) END", 14, [
        {"tp": "(high + low + close) / 3"}, {"was": _lag("tp")}, {"a0": "CASE WHEN tp > was THEN tp * volume ELSE 0 END", "z0": "CASE WHEN tp < was THEN tp * volume ELSE 0 END"},
        {"a": f"sum(a0) {_w(14)}", "z": f"sum(z0) {_w(14)}"}])
    out["ultosc"] = simple("100 * (4 * r7 + 2 * r14 + r28) / 7", 28, [
        {"pc": _lag("close")}, {"bp": "CASE WHEN pc IS NULL THEN NULL ELSE close - least(low, pc) END", "tr": "CASE WHEN pc IS NULL THEN NULL ELSE greatest(high, pc) - least(low, pc) END"},
        {f"r{p}": f"CASE WHEN sum(tr) {_w(p)} = 0 THEN 0 ELSE sum(bp) {_w(p)} / sum(tr) {_w(p)} END" for p in (7, 14, 28)}])
    out["trange"] = simple("tr", 1, _MOVES)
    out["ad"] = simple(f"sum(CASE WHEN high > low THEN (2 * close - high - low) / (high - low) * volume ELSE 0 END) {_ALL}")
    out["obv"] = simple(f"sum(CASE WHEN pc IS NULL THEN volume WHEN close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END) {_ALL}", 0, [{"pc": _lag("close")}])
    out["beta"] = simple("CASE WHEN n = 0 THEN 0 ELSE a / n END", 5, [
        {"p0": _lag("real0"), "p1": _lag("real1")}, {"r0": "(real0 - p0) / p0", "r1": "(real1 - p1) / p1"},
        {"a": f"5 * sum(r0 * r1) {_w(5)} - sum(r0) {_w(5)} * sum(r1) {_w(5)}", "n": f"5 * sum(r0 * r0) {_w(5)} - (sum(r0) {_w(5)}) ** 2"}])
    out["correl"] = simple(f"CASE WHEN stddev_pop(real0) {_w(30)} * stddev_pop(real1) {_w(30)} = 0 THEN 0 ELSE covar_pop(real0, real1) {_w(30)} / (stddev_pop(real0) {_w(30)} * stddev_pop(real1) {_w(30)}) END", 29)
    m, s = f"avg(close) {_w(14)}", _slope(14)
    out |= {
        "linearreg": simple(f"{m} + {s} * 6.5", 13), "linearreg_angle": simple(f"degrees(atan({s}))", 13), "linearreg_intercept": simple(f"{m} - {s} * 6.5", 13),
        "linearreg_slope": simple(s, 13), "tsf": simple(f"{m} + {s} * 7.5", 13), "stddev": simple(f"stddev_pop(close) {_w(5)}", 4), "var": simple(f"var_pop(close) {_w(5)}", 4),
    }
    # --- recurrences
    out["ema"] = recursion(_chain(20, 1), "e1", 19)
    out["ma"] = recursion(_chain(30, 1), "e1", 29)
    out["dema"] = recursion(_chain(20, 2), "2 * e1 - e2", 38)
    out["tema"] = recursion(_chain(20, 3), "3 * e1 - 3 * e2 + e3", 57)
    v = 0.7
    out["t3"] = recursion(_chain(5, 6), f"{-(v**3)!r} * e6 + {3 * v**2 + 3 * v**3!r} * e5 + {-6 * v**2 - 3 * v - 3 * v**3!r} * e4 + {1 + 3 * v + v**3 + 3 * v**2!r} * e3", 24)
    out["trix"] = recursion([*_chain(5, 3), ("roc", "NULL", "CASE WHEN p_e3 = 0 THEN 0 ELSE 100 * (e3 - p_e3) / p_e3 END")], "roc", 13)
    out["macd"], out["macdfix"] = _macd(12, 26, 9), _macd(12, 26, 9, 0.15, 0.075)
    out["macdext"] = simple({"macd": "m", "signal": f"avg(m) {_w(9)}", "hist": f"m - avg(m) {_w(9)}"}, 33, [*two, {"m": "CASE WHEN rn < 25 THEN NULL ELSE f - s END"}])
    wilder = [*_ema("g", "gain", 14, 1, 1 / 14), *_ema("l", "loss", 14, 1, 1 / 14)]
    rsi = "CASE WHEN g = 0 THEN 0 WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END"
    out["rsi"] = recursion(wilder, rsi, 14, _STEP)
    out["cmo"] = recursion(wilder, "CASE WHEN g + l = 0 THEN 0 ELSE 100 * (g - l) / (g + l) END", 14, _STEP)
    out["stochrsi"] = _after(recursion(wilder, rsi, 14, _STEP), [
        {"hh": f"max(z) {_w(5)}", "ll": f"min(z) {_w(5)}"}, {"k": "CASE WHEN rn < 18 THEN NULL WHEN hh = ll THEN 0 ELSE 100 * (z - ll) / (hh - ll) END"}], {"fastk": "k", "fastd": f"avg(k) {_w(3)}"}, 20)
    out["atr"] = recursion(_ema("a", "tr", 14, 1, 1 / 14), "a", 14, _MOVES)
    out["natr"] = recursion(_ema("a", "tr", 14, 1, 1 / 14), "100 * a / close", 14, _MOVES)
    out["plus_dm"], out["minus_dm"] = (recursion(_wsum("s", x, 14), "s", 13, _MOVES) for x in ("pdm", "mdm"))
    both = [*_wsum("ps", "pdm", 14), *_wsum("ms", "mdm", 14), *_wsum("ts", "tr", 14)]
    out["plus_di"], out["minus_di"] = (recursion(both, f"CASE WHEN ts = 0 THEN 0 ELSE 100 * {x} / ts END", 14, _MOVES) for x in ("ps", "ms"))
    out["dx"] = recursion(both, _DX, 14, _MOVES)
    adx = [*both, ("dx", "NULL", _DX), *_ema("a", "dx", 14, 14, 1 / 14)]
    out["adx"] = recursion(adx, "a", 27, _MOVES)
    out["adxr"] = _after(recursion(adx, "a", 27, _MOVES), [], {"value": f"(z + {_lag('z', 13)}) / 2"}, 40)
    money = [{"ad": f"sum(CASE WHEN high > low THEN (2 * close - high - low) / (high - low) * volume ELSE 0 END) {_ALL}"}]
    plain = lambda n, p: (n, "NULL", f"CASE WHEN rn = 0 THEN ad ELSE ad * {2 / (p + 1)!r} + p_{n} * (1 - {2 / (p + 1)!r}) END")
    out["adosc"] = recursion([plain("f", 3), plain("s", 10)], "f - s", 9, money)
    fast, slow = 2.0 / 3.0, 2.0 / 31.0
    out["kama"] = recursion([("y", "NULL", "CASE WHEN rn < 9 THEN NULL WHEN rn = 9 THEN close ELSE p_y + c * (close - p_y) END")], "y", 10, [
        {"move": f"abs(close - {_lag('close')})", "net": f"abs(close - {_lag('close', 10)})"}, {"path": f"sum(move) {_w(10)}"}, {"c": f"((CASE WHEN path > 0 THEN net / path ELSE 0 END) * {fast - slow!r} + {slow!r}) ** 2"}])
    out["sar"], out["sarext"] = _sar(False), _sar(True)
    cycle, smoothed = _cycle(12)
    out["ht_dcperiod"] = recursion(cycle, "sp", 32, smoothed)
    out["ht_phasor"] = recursion(cycle, {"inphase": "d3", "quadrature": "q"}, 32, smoothed)
    adaptive = [
        ("angle", "0", "CASE WHEN d3 <> 0 THEN degrees(atan(q / d3)) ELSE 0 END"),
        ("rate", "0", "CASE WHEN rn < 12 THEN 0 WHEN p_angle - angle > 1 THEN greatest(0.05, 0.5 / (p_angle - angle)) ELSE 0.5 END"),
        ("mama", "0", "rate * close + (1 - rate) * p_mama"),
        ("fama", "0", "rate / 2 * mama + (1 - rate / 2) * p_fama"),
    ]
    out["mama"] = recursion([*cycle, *adaptive], {"mama": "mama", "fama": "fama"}, 32, smoothed)
    out["ht_dcphase"], out["ht_trendline"] = _phase("phase", 63), _phase("trend", 63)
    out["ht_sine"] = _phase({"sine": "sine", "leadsine": "lead"}, 63)
    away = "coalesce(trend <> 0 AND abs((s - trend) / trend) >= 0.015, FALSE)"
    cyclic = "crossed OR days < 0.5 * sp OR moved > 0.67 * 360 / sp AND moved < 1.5 * 360 / sp"
    out["ht_trendmode"] = _phase(f"CASE WHEN rn < 63 THEN 0 WHEN {away} THEN 1 WHEN {cyclic} THEN 0 ELSE 1 END", 0)
    out |= {n: pattern(n) for n in PATTERNS}
    out |= {"cdlhikkake": _hikkake(False), "cdlhikkakemod": _hikkake(True)}
    out["vwap"] = simple(f"sum(p) {_w(14)} / sum(volume) {_w(14)}", 13, [{"p": "(high + low + close) / 3 * volume"}])
    return out | long_sql() | whole_sql()


def _after(sql: str, steps: list[dict[str, str]], values: dict[str, str], lookback: int) -> str:
    """Windows over a recursion's value, z, before it is rounded."""
    head, _, _ = sql.rpartition(" SELECT key, rn, round(")
    ctes, source = ["z0 AS (SELECT key, rn, value AS z FROM v)"], "z0"
    for k, columns in enumerate(steps):
        ctes.append(f"z{k + 1} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {source})")
        source = f"z{k + 1}"
    ctes.append(f"u AS (SELECT key, rn, {', '.join(f'({e})::DOUBLE AS {n}' for n, e in values.items())} FROM {source})")
    return f"{head}, {', '.join(ctes)} {_final('u', {n: n for n in values}, f'rn >= {lookback}')}"
