"""Global ranks, running sums and weighted quantiles without a window over all rows in one task.

Rows are dealt by ranges of the key and ordered within each; what each range adds up to is collected
(a row a range), and its offset goes back to the range's rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.moments import number
from causeway.functions.storage import checkpointed

#: Accuracy of the sketches that bracket a quantile, and how many rows of a bracket are counted by value.
ACCURACY, COUNTED = 10_000, 20_000
SPREAD = 2.0 / ACCURACY


def running_sums(df: DataFrame, order: list[Column], totals: dict[str, Column], ranges: int | None = None, whole: dict[str, str] | None = None, part: str | None = None) -> DataFrame:
    """df with running sums (this row included) of the given columns in a global order.

    order must not tie between rows whose order matters. whole names columns for the grand totals of
    some of the sums, part one for the number of the row's range; ranges follow each other in order.
    """
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumns({f"_o{i}": o for i, o in enumerate(order)} | {f"_v{i}": v.cast("double") for i, v in enumerate(totals.values())})
    names = [f"_o{i}" for i in range(len(order))]
    dealt = keyed.repartitionByRange(n, *names).withColumn("_part", F.spark_partition_id()).persist()
    sums = dealt.groupBy("_part").agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(totals))])
    # one row a range
    before, all_ = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    offsets = sums.select("_part", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0.0)).alias(f"_b{i}") for i in range(len(totals))],
                          *[F.sum(f"_t{list(totals).index(of)}").over(all_).alias(name) for name, of in (whole or {}).items()])
    inside = Window.partitionBy("_part").orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({f"_s{i}": F.sum(f"_v{i}").over(inside) for i in range(len(totals))}).join(F.broadcast(offsets), "_part")
    return out.select(*df.columns, *[(F.col(f"_s{i}") + F.col(f"_b{i}")).alias(name) for i, name in enumerate(totals)], *(whole or {}), *([F.col("_part").alias(part)] if part else []))


def running_least(df: DataFrame, order: list[Column], value: str, group: str) -> DataFrame:
    """df with value replaced by the least one so far of its group, in a global order that keeps groups together."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_o{i}" for i in range(len(order))]
    dealt = df.withColumns({f"_o{i}": o for i, o in enumerate(order)}).repartitionByRange(n, *names).withColumn("_part", F.spark_partition_id()).persist()
    ends = dealt.groupBy(group, "_part").agg(F.min(value).alias("_m"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select(group, "_part", F.min("_m").over(before).alias("_b"))
    inside = Window.partitionBy("_part", group).orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumn("_s", F.min(value).over(inside)).join(offsets, [group, "_part"])
    return out.select(*[F.least("_s", "_b").alias(value) if c == value else F.col(c) for c in df.columns])


def average_ranks(df: DataFrame, col: str, name: str) -> DataFrame:
    """df with the rank of col among all rows, ties sharing their average: counts by value, then running counts of values."""
    counts = df.groupBy(F.col(col).alias("_v")).agg(F.count("*").alias("_n"))
    upto = running_sums(counts, [F.col("_v")], {"_upto": F.col("_n")})
    ranks = upto.select("_v", (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))
    return df.join(ranks, df[col] == ranks["_v"]).drop("_v")


def weighted_quantiles(df: DataFrame, value: str, weight: Column, points: list[float]) -> list[float | None]:
    """For each point the smallest value at which the running weight reaches that share of the total."""
    by_value = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.sum(weight).alias("_w"))
    upto = running_sums(by_value, [F.col("_v")], {"_upto": F.col("_w")}).persist()
    total = upto.agg(F.max("_upto")).first()[0]
    if total is None:
        return [None] * len(points)
    row = upto.agg(*[F.min(F.when(F.col("_upto") >= p * total - 1e-12 * total, F.col("_v"))).alias(f"q{i}") for i, p in enumerate(points)]).first()
    return list(row)


def _ends(points: list[float]) -> list[float]:
    return sorted({min(1.0, max(0.0, p + d)) for p in points for d in (-SPREAD, SPREAD)})


def sketched(columns: list[Column], points: list[float]) -> list[Column]:
    """Aggregates that quantiles starts from; they can share a pass with others."""
    xs = [c.cast("double") for c in columns]
    return [a for x in xs for a in (F.count(x), F.percentile_approx(x, _ends(points), ACCURACY), F.min(x), F.max(x))]


def _tallied(x: DataFrame, brackets: dict[tuple[int, int], tuple], with_values: set[tuple[int, int]], pivots: dict[int, float]) -> tuple[dict, dict, dict, dict]:
    """Of each bracket (a, b) of a column: values below a, values inside, and the inside values with their counts where asked for;
    and sums of the first four powers of a column's distances from its pivot."""
    names = sorted({i for i, _ in brackets})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        below, held = dict.fromkeys(brackets, 0), dict.fromkeys(brackets, 0)
        inside: dict[tuple[int, int], list] = {t: [] for t in with_values}
        powers = {i: np.zeros(4) for i in pivots}
        for batch in batches:
            for i in names:
                v = batch[f"x{i}"].to_numpy(float)
                v = np.sort(v[~np.isnan(v)])
                if i in pivots:
                    d = v - pivots[i]
                    square = d * d
                    powers[i] += [d.sum(), square.sum(), (square * d).sum(), (square * square).sum()]
                for t, (a, b) in brackets.items():
                    if t[0] == i:
                        low, high = np.searchsorted(v, a, "left"), np.searchsorted(v, b, "right")
                        below[t] += int(low)
                        held[t] += int(high - low)
                        if t in with_values:
                            inside[t].append(v[low:high])
        yield pd.DataFrame([(*t, kind, 0.0, n) for kind, of in ((0, below), (1, held)) for t, n in of.items()], columns=["i", "k", "kind", "v", "n"])
        yield pd.DataFrame([(i, p, 3, 0.0, 0, s[p]) for i, s in powers.items() for p in range(4)], columns=["i", "k", "kind", "v", "n", "s"])
        for t, vs in inside.items():
            values, n = np.unique(np.concatenate(vs or [np.zeros(0)]) + 0.0, return_counts=True)
            yield pd.DataFrame({"i": t[0], "k": t[1], "kind": 2, "v": values, "n": n})

    columns = ["i", "k", "kind", "v", "n", "s"]
    counted = x.select(*[f"x{i}" for i in names]).mapInPandas(lambda bs: (b.reindex(columns=columns) for b in work(bs)), "i int, k int, kind int, v double, n long, s double")
    out: tuple[dict, dict, dict, dict] = (dict.fromkeys(brackets, 0), dict.fromkeys(brackets, 0), {t: [] for t in with_values}, {i: np.zeros(4) for i in pivots})
    for r in counted.groupBy("i", "k", "kind", "v").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        if r["kind"] == 3:
            out[3][r["i"]][r["k"]] = r["s"]
        elif r["kind"] < 2:
            out[r["kind"]][r["i"], r["k"]] = r["n"]
        else:
            out[2][r["i"], r["k"]].append((r["v"], r["n"]))
    return out


def quantiles(df: DataFrame, columns: list[str] | dict[str, Column], points: list[float], sketch: list | None = None) -> dict[str, list[float | None]]:
    """For each column its exact quantiles, interpolated between neighbouring ranks; nulls and NaN are passed over."""
    return {c: q for c, (q, _) in described(df, columns, points, sketch).items()}


def described(df: DataFrame, columns: list[str] | dict[str, Column], points: list[float], sketch: list | None = None) -> dict[str, tuple[list[float | None], dict | None]]:
    """For each column its quantiles and (n, mean, sd, min, max, skew, kurtosis; None for no values), the last two of the values as they are.

    Nothing is shuffled but counts: a sketch (given, or made here) brackets each quantile, one pass counts
    what lies below and inside the brackets, and brackets with too many rows are narrowed by sketches of
    their own. Brackets of few rows, or of one value, give their values in the same pass, and the two ranks
    in question are picked among them. Moments come from that pass too, as sums about a value in the middle.
    """
    of = columns if isinstance(columns, dict) else {c: number(c) for c in columns}
    if not of:
        return {}
    x = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(of.values())])
    first = sketch or list(x.agg(*sketched([F.col(f"x{i}") for i in range(len(of))], points)).first())
    n, extremes, open_, expected = {}, {}, {}, {}
    for i in range(len(of)):
        n[i], quantile, low, high = first[4 * i : 4 * i + 4]
        if n[i]:
            extremes[i] = (low, high)
            at = dict(zip(_ends(points), quantile, strict=True))
            for k, p in enumerate(points):
                a, b = max(0.0, p - SPREAD), min(1.0, p + SPREAD)
                open_[i, k] = (low if a == 0 else at[a], high if b == 1 else at[b])
                expected[i, k] = 3 * SPREAD * n[i]  # twice the spread, and the sketch's own error at both ends
    ranks = {(i, k): (n[i] - 1) * points[k] for i, k in open_}
    pivots = {i: float(first[4 * i + 1][len(_ends(points)) // 2]) for i in range(len(of)) if n[i]}
    moments: dict[int, dict] = {}
    picked: dict[tuple[int, int], float] = {}
    narrowed: dict[tuple[int, int], int] = {}
    while open_:
        ask = {t for t, (a, b) in open_.items() if a == b or expected[t] <= COUNTED}
        below, held, values, powers = _tallied(x, open_, ask, {} if moments else pivots)
        moments = moments or {i: _moments(n[i], pivots[i], s, *extremes[i]) for i, s in powers.items()}
        wide = {}
        for t, (a, b) in open_.items():
            lowest, highest = math.floor(ranks[t]), math.ceil(ranks[t])
            if below[t] > lowest or below[t] + held[t] < highest + 1:
                wide[t], expected[t] = extremes[t[0]], n[t[0]]
            elif t in ask:
                picked[t] = _at_rank(sorted(values[t]), below[t], ranks[t])
            else:
                wide[t], expected[t] = (a, b), held[t]
        again = {t: ab for t, ab in wide.items() if expected[t] > COUNTED and ab[0] < ab[1]}
        if again:
            inside = {t: F.when(F.col(f"x{t[0]}").between(*ab), F.col(f"x{t[0]}")) for t, ab in again.items()}
            share = {t: ((ranks[t] - below[t]) / held[t] if ab == open_[t] and held[t] else points[t[1]]) for t, ab in again.items()}
            ends = [[min(1.0, max(0.0, share[t] + d)) for d in (-SPREAD, SPREAD)] for t in again]
            for t, e, row in zip(again, ends, x.agg(*[F.percentile_approx(inside[t], e, ACCURACY) for t, e in zip(again, ends, strict=True)]).first(), strict=True):
                narrowed[t] = narrowed.get(t, 0) + 1
                # a bracket that many rounds don't narrow lies between two neighbouring values that most of its rows have
                expected[t] = 0 if narrowed[t] > 8 or tuple(row) == wide[t] else 3 * SPREAD * expected[t]
                wide[t] = tuple(row)
        open_ = wide
    return {c: ([picked.get((i, k)) for k in range(len(points))], moments.get(i)) for i, c in enumerate(of)}


def _moments(n: int, pivot: float, sums: np.ndarray, low: float, high: float) -> dict:
    a, b, c, d = (float(s) / n for s in sums)
    m2 = b - a * a if low < high else 0.0
    skew = (c - 3 * a * b + 2 * a**3) / m2**1.5 if m2 > 0 else None
    kurtosis = (d - 4 * a * c + 6 * a * a * b - 3 * a**4) / m2**2 - 3 if m2 > 0 else None
    return {"n": n, "mean": pivot + a, "sd": math.sqrt(m2 * n / (n - 1)) if n > 1 else None, "min": low, "max": high, "skew": skew, "kurtosis": kurtosis}


def _at_rank(values: list[tuple[float, int]], seen: int, rank: float) -> float:
    """The value at a rank between two whole ones, of values with counts after so many others."""
    low, high, found = math.floor(rank), math.ceil(rank), []
    for v, m in values:
        found += [v] * sum(seen <= r < seen + m for r in sorted({low, high}))
        seen += m
    part = rank - low
    return found[0] if len(found) == 1 else found[0] * (1 - part) + found[-1] * part


def percentiles(df: DataFrame, column: str | Column, points: list[float]) -> list[float | None]:
    """quantiles of one column."""
    return quantiles(df, {"x": number(column) if isinstance(column, str) else column}, points)["x"]


def numbered(df: DataFrame, group: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """df with at, a row's place in its group from 0; order must tell the rows of a group apart.

    Rows are dealt by ranges of group and order, so that a group of any size is dealt out; a row's place is
    its number in the range, and the rows of its group in the ranges before.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    placed = df.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order)
    dealt = checkpointed(placed.withColumns({"_part": F.shiftright(at, 33), "_row": at.bitwiseAND(F.lit((1 << 33) - 1))}))
    held = dealt.groupBy("_part", *group).agg(F.min("_row").alias("_first"), F.count("*").alias("_held"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("_part", *group, (F.coalesce(F.sum("_held").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
    return dealt.join(offsets, ["_part", *group]).select(*df.columns, (F.col("_row") + F.col("_offset")).alias("at"))
