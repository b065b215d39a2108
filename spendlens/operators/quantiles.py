"""Exact medians without gathering a column into one task.

Spark's exact ``median``/``percentile`` keeps every distinct value of the
column in one aggregation buffer, and for a global aggregate the final merge
runs in a single task -- unbounded at scale.  Here the k-th smallest value is
found by narrowing a value range with histogram passes instead: each pass is
an ordinary distributed aggregation (value bucket -> count, min, max) whose
result has at most ``buckets`` rows per column, so neither a task nor the
driver ever holds more than a bounded summary.  A few passes suffice: buckets
are laid out on ``sign(v) * log1p(|v|)`` (equal widths for heavy-tailed
amounts) and each pass shrinks the range to the actual min/max of the bucket
holding the wanted rank.  Once a range holds at most ``final_rows`` values
they are fetched and ranked exactly.

All columns are narrowed together in the same passes (the values are
unpivoted to ``(name, v)``), so the pass count does not grow with the number
of columns.  Medians start from a bracket around the middle estimated by a
one-pass sketch: where it holds few enough values no histogram is needed.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

BUCKETS = 1024
FINAL_ROWS = 4096
# Distance of a bracket's ends from the middle (share of the values), and the
# accuracy of the estimate (its error is one over this, less than the distance).
BRACKET, ACCURACY = 0.0003, 10_000


def _t(c):
    """Order-preserving transform used for bucket widths."""
    return F.signum(c) * F.log1p(F.abs(c))


def _value(c: str):
    """The column as double, NULL for NaN (``isnan(NULL)`` is false, so
    NULL and NaN are excluded separately)."""
    v = F.col(c).cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v), v)


def _long_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """(name, v) for every non-NULL, non-NaN value of the columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols])
    return (df.select(F.explode(pairs).alias("p")).select("p.name", "p.v")
            .where(F.col("v").isNotNull() & ~F.isnan("v")))


def kth_values(df: DataFrame, wanted: dict[str, list[int]], buckets: int = BUCKETS,
               final_rows: int = FINAL_ROWS,
               bounds: dict[str, tuple[float, float]] | None = None,
               starts: dict[str, tuple[float, float, int, int]] | None = None) -> dict[str, dict[int, float]]:
    """For each column, the values at the given 1-based ranks (ascending).

    ``starts`` may give a column a range known to hold its ranks, with the
    numbers of values below and inside it.

    ``wanted`` maps a column to its ranks; ranks must lie in 1..n(column).
    Every (column, rank) target narrows its own range, so a target's range
    always shrinks to a single bucket of the previous pass.
    """
    if not wanted:
        return {}
    vals = _long_values(df, list(wanted))
    if bounds is None:
        first = vals.groupBy("name").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        bounds = {r["name"]: (r["lo"], r["hi"]) for r in first}
    # target -> [lo, hi, below, linear]
    state = {(c, k): [bounds[c][0], bounds[c][1], 0, False]
             for c, ks in wanted.items() if c in bounds for k in ks}
    result: dict[str, dict[int, float]] = {c: {} for c in wanted}
    for t in state:
        if t[0] in (starts or {}):
            state[t] = [*starts[t[0]][:3], False]
    few = [t for t, st in state.items() if t[0] in (starts or {}) and starts[t[0]][3] <= final_rows and st[0] != st[1]]
    if few:
        _finish_small(vals, state, result, few)

    while True:
        for t in [t for t, st in state.items() if st[0] == st[1]]:
            result[t[0]][t[1]] = state.pop(t)[0]
        if not state:
            break
        active = list(state)
        conds = [(F.col("name") == c) & (F.col("v") >= F.lit(state[(c, k)][0]))
                 & (F.col("v") <= F.lit(state[(c, k)][1])) for c, k in active]
        tids = F.array_compact(F.array(*[F.when(cnd, F.lit(i)) for i, cnd in enumerate(conds)]))
        sub = (vals.where(reduce(lambda a, b: a | b, conds))
               .select("v", F.explode(tids).alias("tid")))
        lo_c = hi_c = F.lit(None).cast("double")
        lin_c = F.lit(False)
        for i, t in enumerate(active):
            lo, hi, _below, lin = state[t]
            lo_c = F.when(F.col("tid") == i, F.lit(lo)).otherwise(lo_c)
            hi_c = F.when(F.col("tid") == i, F.lit(hi)).otherwise(hi_c)
            lin_c = F.when(F.col("tid") == i, F.lit(lin)).otherwise(lin_c)
        span_log = _t(hi_c) - _t(lo_c)
        pos_log = F.try_divide(_t(F.col("v")) - _t(lo_c), span_log)
        # Halved first, so that the span of very large values stays finite.
        pos_lin = F.try_divide(F.col("v") / 2 - lo_c / 2, hi_c / 2 - lo_c / 2)
        pos = F.when(lin_c | (span_log <= 0), pos_lin).otherwise(pos_log)
        bucket = F.least(F.greatest(F.floor(F.coalesce(pos, F.lit(0.0)) * buckets), F.lit(0)),
                         F.lit(buckets - 1))
        hist = (sub.groupBy("tid", bucket.alias("b"))
                .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx"))
                .collect())
        per: dict[int, list] = {}
        for r in hist:
            per.setdefault(r["tid"], []).append((r["b"], r["n"], r["mn"], r["mx"]))
        small = []
        for i, t in enumerate(active):
            lo, hi, below, lin = state[t]
            rows = sorted(per.get(i, []))
            if sum(r[1] for r in rows) <= final_rows:
                small.append(t)
                continue
            cum = below
            for b, n, mn, mx in rows:
                if cum < t[1] <= cum + n:
                    progressed = (mn, mx) != (lo, hi)
                    if lin and not progressed:
                        raise ArithmeticError(f"the values of {t[0]!r} between {lo!r} and {hi!r} cannot be told apart")
                    state[t] = [mn, mx, cum, lin or not progressed]
                    if mn != mx and n <= final_rows:
                        small.append(t)  # few enough values left: rank them now
                    break
                cum += n
        if small:
            _finish_small(vals, state, result, small)
    return result


def _finish_small(vals: DataFrame, state, result, targets):
    """Rank exactly within narrowed ranges: one job fetches the (value,
    count) pairs of every target range -- at most ``final_rows`` values per
    target."""
    conds = [(F.col("name") == c) & (F.col("v") >= F.lit(state[(c, k)][0]))
             & (F.col("v") <= F.lit(state[(c, k)][1])) for c, k in targets]
    rows = (vals.where(reduce(lambda a, b: a | b, conds))
            .groupBy("name", "v").agg(F.count(F.lit(1)).alias("n")).collect())
    per: dict[str, list] = {}
    for r in rows:
        per.setdefault(r["name"], []).append((r["v"], r["n"]))
    for c, k in targets:
        lo, hi, below, _lin = state.pop((c, k))
        cum = below
        for v, n in sorted(p for p in per.get(c, []) if lo <= p[0] <= hi):
            if cum < k <= cum + n:
                result[c][k] = v
                break
            cum += n


def bracket_exprs(cols: list[str]) -> list:
    """Aggregates ``__mid_<c>``: values a little below and above each column's
    middle.  They only say where to look; the ranks are counted afterwards."""
    return [F.percentile_approx(_value(c), [0.5 - BRACKET, 0.5 + BRACKET], ACCURACY).alias(f"__mid_{c}") for c in cols]


def middle_values(df: DataFrame, cols: list[str],
                  brackets: dict[str, list[float] | None] | None = None) -> dict[str, tuple[float, float] | None]:
    """The two middle values of each column (equal for an odd count); NULL/NaN
    ignored; ``None`` for a column without values.

    One pass counts the values below and inside each bracket, so whether it
    holds the middle is known exactly; a second one ranks the values inside.
    A bracket of more than ``FINAL_ROWS`` values is narrowed first, and one
    that misses the middle gives way to the column's whole range.
    """
    if brackets is None:
        row = df.agg(*bracket_exprs(cols)).first()
        brackets = {c: row[f"__mid_{c}"] for c in cols}
    aggs = []
    for c in cols:
        lo, hi = brackets.get(c) or (None, None)
        v = _value(c)
        aggs += [F.count(v).alias(f"n_{c}"), F.min(v).alias(f"min_{c}"), F.max(v).alias(f"max_{c}"),
                 F.count_if(v < F.lit(lo)).alias(f"below_{c}"), F.count_if(v.between(F.lit(lo), F.lit(hi))).alias(f"inside_{c}")]
    row = df.agg(*aggs).first()
    wanted, bounds, starts = {}, {}, {}
    for c in cols:
        n, below, inside = (row[f"{k}_{c}"] for k in ("n", "below", "inside"))
        if not n:
            continue
        wanted[c] = sorted({(n + 1) // 2, n // 2 + 1})
        bounds[c] = (row[f"min_{c}"], row[f"max_{c}"])
        if below < wanted[c][0] and wanted[c][-1] <= below + inside:
            starts[c] = (*brackets[c], below, inside)
    kth = kth_values(df, wanted, final_rows=FINAL_ROWS, bounds=bounds, starts=starts)
    return {c: (kth[c][wanted[c][0]], kth[c][wanted[c][-1]]) if c in wanted else None for c in cols}


def exact_medians(df: DataFrame, cols: list[str],
                  brackets: dict[str, list[float] | None] | None = None) -> dict[str, float | None]:
    """Exact median of each column (mean of the two middle values for an
    even count); NULL/NaN ignored; ``None`` for a column without values."""
    return {c: pair and (pair[0] if pair[0] == pair[1] else (pair[0] + pair[1]) / 2.0)
            for c, pair in middle_values(df, cols, brackets).items()}


def approx_medians(df: DataFrame, cols: list[str], accuracy: int = 100_000) -> dict[str, float | None]:
    """One-pass approximate medians (``percentile_approx``)."""
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, accuracy).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}
