"""Exact quantiles at scale.

Spark's ``percentile`` is exact but merges a map of every distinct value of
a group in one task, which is unbounded for a global quantile over a large
continuous column.  Here a quantile sketch guesses a bracket for the wanted ranks,
and an aggregate of conditional counts over all rows proves it: how many values lie
below it, on its ends and strictly inside.  A rank on an end is found; else only the
values strictly inside matter.  Once they are few (``SMALL``, as counted) one
more aggregate sorts them and picks the rank; until then a sketch of them gives
the next bracket.  Sketches are guesses only, so they need not see every value: about
``SKETCH_ROWS`` rows a group, drawn at random, keep the sketches that meet in one task
small at any size; a bracket that misses its rank is found out and counted again.
Every step is one aggregate over the source, whatever the number of columns and
quantiles, and returns one row a group: four scans for up to some million values, two
more for every further factor of a hundred.

Every count proves bounds inside the last ones, so the search ends for any data,
whatever the sketches say.  Infinities are values like others; NaN and NULL are missing.  Results
equal numpy's linear interpolation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.session import qcol

ACCURACY = 10_000
SMALL = 10_000
#: Rows of a group that a sketch sees, about.
SKETCH_ROWS = 200_000


@dataclass
class _Rank:
    """One wanted rank of a column in a group, and what is known of it.

    ``lo`` and ``hi`` are proven bounds (at first the least and greatest value), ``a``
    and ``b`` the ends of the bracket that is tried; ``below`` values are known to lie under the open interval,
    ``inside`` in it (None: not counted yet).
    """

    group: int
    col: int
    rank: int
    lo: float
    hi: float
    a: float
    b: float
    below: int = 0
    inside: int | None = None
    value: float | None = None


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """``{column: [quantile per prob]}``; None for a column without values."""
    return {c: v[-1] for c, v in exact_profile(df, cols, probs).items()}


def exact_profile(df: DataFrame, cols: Sequence[str], probs: Sequence[float]
                  ) -> dict[str, tuple[int, float | None, float | None, float | None, float | None, list]]:
    """``{column: (count, mean, std_samp, min, max, [quantiles])}`` from one search
    (the moments come from the search's first pass)."""
    cols = list(cols)
    frame = df.select(F.lit(0).alias("g"), *_values(cols))
    found, moments = _search(frame, [0], len(cols), probs)
    return {c: (*moments[0, i], found[0, i]) for i, c in enumerate(cols)}


def exact_quantiles_by(df: DataFrame, group_col: str, groups: Sequence[int], cols: Sequence[str],
                       probs: Sequence[float]) -> dict[int, dict[str, list[float | None]]]:
    """Exact quantiles per (integer group, column) in one search.

    ``group_col`` holds small non-negative ints (e.g. a fold id); a row may
    belong to several groups if ``group_col`` is an array column (it is
    exploded), which gives every cross-validation training set's medians in
    one pass.
    """
    cols = list(cols)
    is_array = isinstance(df.schema[group_col].dataType, T.ArrayType)
    gcol = F.explode(qcol(group_col).cast("array<int>")) if is_array else qcol(group_col).cast("int")
    frame = df.select(gcol.alias("g"), *_values(cols)).filter(F.col("g").isin(*[int(g) for g in groups]))
    found, _ = _search(frame, groups, len(cols), probs)
    return {g: {c: found[g, i] for i, c in enumerate(cols)} for g in groups}


def exact_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Exact median per column (numpy/pandas ``median``: mean of the middle pair)."""
    return {c: v[0] for c, v in exact_quantiles(df, cols, [0.5]).items()}


def _values(cols: Sequence[str]) -> list[Column]:
    out = []
    for i, c in enumerate(cols):
        v = qcol(c).cast("double")
        out.append(F.when(~F.isnan(v), v).alias(f"v{i}"))
    return out


def _by_group(values: dict[int, float]) -> Column:
    """A number per group as a column; NULL for other groups."""
    whens = F.lit(None).cast("double")
    for g, v in values.items():
        whens = F.when(F.col("g") == g, F.lit(float(v))).otherwise(whens)
    return whens


def _search(frame: DataFrame, groups: Sequence[int], width: int, probs: Sequence[float]):
    """Quantiles and moments per (group, column) of ``frame`` (g, v0, v1, ...)."""
    first = {r["g"]: r for r in frame.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[x for i in range(width) for x in (
        F.count(f"v{i}").alias(f"n{i}"), F.avg(f"v{i}").alias(f"mean{i}"), F.stddev_samp(f"v{i}").alias(f"std{i}"),
        F.min(f"v{i}").alias(f"min{i}"), F.max(f"v{i}").alias(f"max{i}"))]).collect()}
    gap = _gap(max((r["n"] for r in first.values()), default=0))
    shares = sorted({min(1.0, max(0.0, p + e)) for p in probs for e in (-gap, gap)})
    sketched = _sketch(frame, {g: r["n"] for g, r in first.items()}, width, shares) if probs else {}
    moments, ranks, plan = {}, {}, {}
    for g in groups:
        row = first.get(g)
        for i in range(width):
            n = row[f"n{i}"] if row else 0
            moments[g, i] = (n, *(row[f"{k}{i}"] if n else None for k in ("mean", "std", "min", "max")))
            for p in probs if n else ():
                at = p * (n - 1)
                for r in {math.floor(at), math.ceil(at)}:
                    t = ranks.setdefault((g, i, r), _Rank(g, i, r, *2 * (row[f"min{i}"], row[f"max{i}"])))
                    _narrow(t, shares, sketched[g][f"q{i}"] if g in sketched else None, (r + 0.5) / n, gap)
                plan[g, i, p] = (math.floor(at), math.ceil(at), at - math.floor(at))
    todo = list(ranks.values())
    while todo:
        _count_brackets(frame, todo)
        counted = [t for t in todo if t.value is None and t.inside is not None]
        _pick(frame, [t for t in counted if t.inside <= SMALL])
        _sketch_inside(frame, [t for t in counted if t.value is None])
        todo = [t for t in todo if t.value is None]
    out = {}
    for g in groups:
        for i in range(width):
            out[g, i] = []
            for p in probs:
                if (g, i, p) not in plan:
                    out[g, i].append(None)
                    continue
                lo, hi, part = plan[g, i, p]
                a, b = ranks[g, i, lo].value, ranks[g, i, hi].value
                out[g, i].append(a if not part or a == b else a + (b - a) * part)
    return out, moments


def _gap(n: int) -> float:
    """How far from a rank (as a share) its bracket's ends are taken: the sketch's error, and four deviations of a draw."""
    return 2.0 / ACCURACY + (2.0 / math.sqrt(SKETCH_ROWS) if n > SKETCH_ROWS else 0.0)


def _drawn(sizes: dict[int, int]) -> Column | None:
    """Rows that sketches see: all of a small group, about ``SKETCH_ROWS`` of a large one."""
    large = {g: SKETCH_ROWS / n for g, n in sizes.items() if n > SKETCH_ROWS}
    return F.coalesce(F.col("u") < _by_group(large), F.lit(True)) if large else None


def _sketch(frame: DataFrame, sizes: dict[int, int], width: int, shares: Sequence[float]) -> dict:
    """Sketched quantiles of every column, by group."""
    drawn = _drawn(sizes)
    rows = frame if drawn is None else frame.withColumn("u", F.rand(42)).filter(drawn)
    return {r["g"]: r for r in rows.groupBy("g").agg(*[F.percentile_approx(f"v{i}", shares, ACCURACY).alias(f"q{i}") for i in range(width)]).collect()}


def _narrow(t: _Rank, shares: Sequence[float], values: Sequence[float] | None, share: float, gap: float = 2.0 / ACCURACY) -> None:
    """Set the bracket of ``t`` to the sketched values around ``share`` (with the sketch's error to spare)."""
    near = gap - 0.5 / ACCURACY
    under = [v for s, v in zip(shares, values or []) if s <= share - near]
    over = [v for s, v in zip(shares, values or []) if s >= share + near]
    t.a, t.b = max([t.a, *under]), min([t.b, *over])


def _slots(targets: Sequence[_Rank]) -> dict[tuple[int, int], list[_Rank]]:
    """Targets by (column, number within its group and column): one expression serves all groups."""
    slots: dict[tuple[int, int], list[_Rank]] = {}
    seen: dict[tuple[int, int], int] = {}
    for t in targets:
        k = seen[t.group, t.col] = seen.get((t.group, t.col), -1) + 1
        slots.setdefault((t.col, k), []).append(t)
    return slots


def _aggregate(frame: DataFrame, targets: Sequence[_Rank], make) -> dict:
    """One aggregate with ``make(value, a, b, targets)`` (a dict of columns) per slot; {(group, col, k): {name: value}}."""
    slots = _slots(targets)
    exprs, names = [], {}
    for (col, k), members in slots.items():
        made = make(F.col(f"v{col}"), _by_group({t.group: t.a for t in members}), _by_group({t.group: t.b for t in members}), members)
        for name, e in made.items():
            names[f"{name}_{col}_{k}"] = (name, col, k)
            exprs.append(e.alias(f"{name}_{col}_{k}"))
    got = {r["g"]: r for r in frame.filter(F.col("g").isin(*sorted({t.group for t in targets}))).groupBy("g").agg(*exprs).collect()}
    return {(t.group, col, k): {name: got[t.group][f"{name}_{col}_{k}"] for name, c, j in set(names.values()) if (c, j) == (col, k)}
            for (col, k), members in slots.items() for t in members}


def _each(targets: Sequence[_Rank]):
    for (col, k), members in _slots(targets).items():
        for t in members:
            yield (t.group, col, k), t


def _count_brackets(frame: DataFrame, targets: Sequence[_Rank]) -> None:
    """Count around the brackets' ends; settle ranks that fall on an end."""
    got = _aggregate(frame, targets, lambda v, a, b, _: {
        "lt": F.count(F.when(v < a, 1)), "ea": F.count(F.when(v == a, 1)),
        "mid": F.count(F.when((v > a) & (v < b), 1)), "eb": F.count(F.when((v == b) & (b > a), 1))})
    for key, t in _each(targets):
        c = got[key]
        low, high = c["lt"] + c["ea"], c["lt"] + c["ea"] + c["mid"]
        if c["lt"] <= t.rank < low:
            t.value = t.a
        elif high <= t.rank < high + c["eb"]:
            t.value = t.b
        elif t.rank < c["lt"]:  # the sketch was off by more than it promises: count again below, or above
            t.hi, t.b, t.a, t.inside = t.a, t.a, t.lo, None
        elif t.rank >= high + c["eb"]:
            t.lo, t.a, t.b, t.inside = t.b, t.b, t.hi, None
        else:
            t.lo, t.hi, t.below, t.inside = t.a, t.b, low, c["mid"]


def _within(v: Column, a: Column, b: Column) -> Column:
    return F.when((v > a) & (v < b), v)


def _pick(frame: DataFrame, targets: Sequence[_Rank]) -> None:
    """Sort the (counted, few) values inside the brackets on the executors and take the rank."""
    if not targets:
        return
    got = _aggregate(frame, targets, lambda v, a, b, members: {
        "x": F.get(F.sort_array(F.collect_list(_within(v, a, b))), _by_group({t.group: t.rank - t.below for t in members}).cast("int"))})
    for key, t in _each(targets):
        t.value = got[key]["x"]


def _sketch_inside(frame: DataFrame, targets: Sequence[_Rank]) -> None:
    """Next brackets from sketches of the values inside the present ones."""
    if not targets:
        return

    gap = _gap(max(t.inside for t in targets))

    def share(t: _Rank) -> float:
        return min(1.0, (t.rank - t.below + 0.5) / t.inside)

    def shares(members: Sequence[_Rank]) -> list[float]:
        return sorted({min(1.0, max(0.0, share(t) + e)) for t in members for e in (-gap, gap)} | {0.0, 1.0})

    def guess(v: Column, a: Column, b: Column, members: Sequence[_Rank], at: Sequence[float]) -> Column:
        drawn, inside = _drawn({t.group: t.inside for t in members}), _within(v, a, b)
        return F.percentile_approx(inside if drawn is None else F.when(drawn, inside), at, ACCURACY)

    by_slot = {(col, k): shares(m) for (col, k), m in _slots(targets).items()}
    slots = iter(by_slot.values())
    got = _aggregate(frame.withColumn("u", F.rand(42)), targets, lambda v, a, b, members: {"q": guess(v, a, b, members, next(slots))})
    for key, t in _each(targets):
        _narrow(t, by_slot[key[1:]], got[key]["q"], share(t), gap)


# ---------------------------------------------------------------- overlapping row sets
#: Values between a bracket's ends that are sorted together, at most.
_SORTED = 50_000


@dataclass
class _Bracket:
    """Ranks of a column, wanted of several row sets, that lie between the same ends; ``below``: values up to ``lo``, by fold."""

    col: int
    ranks: list[tuple]
    lo: float
    hi: float
    a: float
    b: float
    below: dict | None = None
    inside: dict | None = None


def medians_outside(df: DataFrame, fold_col: str, folds: Sequence[int], cols: Sequence[str]) -> dict[int | None, dict[str, float | None]]:
    """Exact medians of the rows outside each fold, and of all rows (key None), all in the same passes.

    Every value is counted once, for its own fold; a row set's count is the sum over its folds.  The sets
    share most rows, so their medians lie close and one bracket serves all of them.
    """
    cols, sets = list(cols), [None, *folds]
    frame = df.select(qcol(fold_col).cast("int").alias("g"), *_values(cols))
    first = {r["g"]: r for r in frame.groupBy("g").agg(*[x for i in range(len(cols)) for x in (F.count(f"v{i}").alias(f"n{i}"), F.min(f"v{i}").alias(f"min{i}"), F.max(f"v{i}").alias(f"max{i}"))]).collect()}
    got: dict = {}
    plan, todo = {}, []
    for i in range(len(cols)):
        sizes = {g: r[f"n{i}"] for g, r in first.items()}
        for s in sets:
            n = _outside(sizes, s)
            plan[s, i] = ((n - 1) // 2, n // 2) if n else None
        if any(sizes.values()):
            lo, hi = min(r[f"min{i}"] for r in first.values() if r[f"n{i}"]), max(r[f"max{i}"] for r in first.values() if r[f"n{i}"])
            todo.append(_Bracket(i, sorted({(s, r) for s in sets for r in plan[s, i] or ()}, key=str), lo, hi, lo, hi))
    whole = {t.col: _outside({g: r[f"n{t.col}"] for g, r in first.items()}, None) for t in todo}
    _narrow_together(frame, todo, lambda t: whole[t.col], lambda t: [0.5] * len(t.ranks), lambda t, v: v)
    while todo:
        todo = _count_together(frame, todo, got)
        _pick_together(frame, [t for t in todo if t.inside is not None and sum(t.inside.values()) <= _SORTED], got)
        todo = [t for t in todo if t.inside is None or sum(t.inside.values()) > _SORTED]
        _narrow_together(frame, [t for t in todo if t.inside is not None], lambda t: sum(t.inside.values()), _shares_inside, lambda t, v: _within(v, F.lit(t.lo), F.lit(t.hi)))
    middle = lambda a, b: a if a == b else a + (b - a) * 0.5
    return {s: {c: middle(*[got[i, s, r] for r in plan[s, i]]) if plan[s, i] else None for i, c in enumerate(cols)} for s in sets}


def _outside(counts: dict, fold: int | None) -> int:
    return sum(n for g, n in counts.items() if fold is None or g != fold)


def _shares_inside(t: _Bracket) -> list[float]:
    """Where a bracket's ranks lie among all values inside it, about."""
    return [min(1.0, max(0.0, (r - _outside(t.below, s) + 0.5) / max(1, _outside(t.inside, s)))) for s, r in t.ranks]


def _narrow_together(frame: DataFrame, brackets: Sequence[_Bracket], size, shares, values) -> None:
    """New ends from sketches of the values inside; the sets' ranks may stray by the spread of a draw."""
    if not brackets:
        return
    asked = []
    for k, t in enumerate(brackets):
        n, at = size(t), shares(t)
        gap = _gap(n) + 1.0 / math.sqrt(n)
        value = values(t, F.col(f"v{t.col}"))
        if n > SKETCH_ROWS:
            value = F.when(F.col("u") < SKETCH_ROWS / n, value)
        asked.append(F.percentile_approx(value, [max(0.0, min(at) - gap), min(1.0, max(at) + gap)], ACCURACY).alias(f"q{k}"))
    # Values of all columns are drawn by the same numbers: rows that no sketch sees need not be looked at.
    most = max(min(1.0, SKETCH_ROWS / size(t)) for t in brackets)
    drawn = frame.withColumn("u", F.rand(42))
    got = drawn.filter(F.col("u") < most).agg(*asked).first()
    for k, t in enumerate(brackets):
        if got[k]:
            t.a, t.b = max(t.a, got[k][0]), min(t.b, got[k][1])


def _count_together(frame: DataFrame, brackets: Sequence[_Bracket], got: dict) -> list[_Bracket]:
    """Count around the ends by fold; ranks on an end are settled, the others go on with proven bounds."""
    exprs = []
    for k, t in enumerate(brackets):
        v, a, b = F.col(f"v{t.col}"), F.lit(t.a), F.lit(t.b)
        exprs += [F.count(F.when(v < a, 1)).alias(f"lt{k}"), F.count(F.when(v == a, 1)).alias(f"ea{k}"), F.count(F.when((v > a) & (v < b), 1)).alias(f"mid{k}"),
                  F.count(F.when((v == b) & (b > a), 1)).alias(f"eb{k}")]
    rows = frame.groupBy("g").agg(*exprs).collect()
    left = []
    for k, t in enumerate(brackets):
        lt, ea, mid, eb = ({r["g"]: r[f"{name}{k}"] for r in rows} for name in ("lt", "ea", "mid", "eb"))
        parts: dict[str, list] = {"under": [], "inside": [], "over": []}
        for s, r in t.ranks:
            low = _outside(lt, s)
            upto = low + _outside(ea, s)
            high = upto + _outside(mid, s)
            if low <= r < upto:
                got[t.col, s, r] = t.a
            elif high <= r < high + _outside(eb, s):
                got[t.col, s, r] = t.b
            else:
                parts["under" if r < low else "inside" if r < high else "over"].append((s, r))
        if parts["under"]:  # the sketch was off by more than it promises: count again below, or above
            left.append(_Bracket(t.col, parts["under"], t.lo, t.a, t.lo, t.a))
        if parts["inside"]:
            left.append(_Bracket(t.col, parts["inside"], t.a, t.b, t.a, t.b, {g: lt[g] + ea[g] for g in lt}, mid))
        if parts["over"]:
            left.append(_Bracket(t.col, parts["over"], t.b, t.hi, t.b, t.hi))
    return left


def _others(values: Column, fold: int) -> Column:
    return F.filter(values, lambda x: x["g"] != fold)


def _pick_together(frame: DataFrame, brackets: Sequence[_Bracket], got: dict) -> None:
    """Sort the (counted, few) values inside the brackets on an executor and take each set's ranks."""
    if not brackets:
        return
    held = frame.agg(*[F.sort_array(F.collect_list(F.when((v > F.lit(t.a)) & (v < F.lit(t.b)), F.struct(v.alias("v"), "g")))).alias(f"x{k}")
                       for k, t in enumerate(brackets) for v in [F.col(f"v{t.col}")]])
    picks = {}
    for k, t in enumerate(brackets):
        for j, (s, r) in enumerate(t.ranks):
            mine = F.col(f"x{k}") if s is None else _others(F.col(f"x{k}"), s)
            picks[f"p{k}_{j}"] = F.get(mine, F.lit(int(r - _outside(t.below, s))))["v"]
    row = held.select(*[c.alias(name) for name, c in picks.items()]).first()
    for k, t in enumerate(brackets):
        for j, (s, r) in enumerate(t.ranks):
            got[t.col, s, r] = row[f"p{k}_{j}"]
