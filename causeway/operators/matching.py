"""Nearest-neighbour matching on a score, exact, with and without replacement.

Rows lie on a line by their score and are dealt by ranges of it, ties by key, so that a score that most
rows share is dealt out as well.

* With replacement, a treated row's nearest controls are the last ones before it and the first ones from
  it on. Within a range running windows carry them along; over its ends each range gets the nearest
  ones of all ranges before and after, a few rows a range.
* Without replacement, the nearest pair of all is matched first, then the nearest of what is left. Rows
  of one arm and score are one group with a count, so ties never take a step each. Within a range all
  pairs are settled in that order whose rows are nearer to each other than to anything outside, or to
  anything that waits for what is outside; what waits is dealt anew, by other ranges, with what is left.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.storage import checkpointed
from causeway.operators.diagnostics import propensity
from causeway.operators.ranks import numbered
from causeway.operators.results import frame, row

#: Scores are compared at so many digits.
DIGITS = 9
#: Of a group's members so many share a key when matches are read back.
PIECE = 64


def _on_line(df: DataFrame, key: str, treatment: str, score: str, ranges: int | None) -> tuple[DataFrame, int]:
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.where(F.col(score).isNotNull() & F.col(treatment).isNotNull() & F.col(key).isNotNull())
    return rows.select(F.col(key).alias("k"), F.col(score).cast("double").alias("e"), (F.col(treatment) != 1).alias("c")), n


def nearest_with_replacement(df: DataFrame, key: str, treatment: str, score: str, caliper: float, ratio: int = 1, ranges: int | None = None) -> DataFrame:
    """(treated, control, distance): each treated row's nearest controls, up to ratio within the caliper.

    Of equally near controls the one of lower score, then of lower key counts. Rows without key, score or
    treatment are passed over; keys should be unique.
    """
    rows, n = _on_line(df, key, treatment, score, ranges)
    dealt = checkpointed(rows.repartitionByRange(n, "e", "c", "k").withColumn("part", F.spark_partition_id()))
    # controls in the order in which a treated row to the right, and one to the left, would take them
    left, right = [F.desc("e"), F.asc("k")], [F.asc("e"), F.asc("k")]
    per = Window.partitionBy("part")
    controls = dealt.where("c").withColumns({"l": F.row_number().over(per.orderBy(*left)), "r": F.row_number().over(per.orderBy(*right))})
    ends = controls.where((F.col("l") <= ratio) | (F.col("r") <= ratio)).collect()  # twice the ratio a range at most
    one = F.struct("e", "k")
    before, after = {}, {}
    for side, into, order, sign in (("l", before, range(n), -1), ("r", after, range(n - 1, -1, -1), 1)):
        best: list = []
        for p in order:
            into[p] = list(best)
            own = [(x["e"], x["k"]) for x in ends if x["part"] == p and x[side] <= ratio]
            best = sorted([*best, *own], key=lambda x: (sign * x[0], x[1]))[:ratio]
    kind = dealt.schema["k"].dataType.simpleString()
    carried = df.sparkSession.createDataFrame([(p, before[p], after[p]) for p in range(n)], f"part int, before array<struct<e: double, k: {kind}>>, after array<struct<e: double, k: {kind}>>")

    def last(order: list[Column]) -> Column:
        """The last controls so far in an order, kept by each control and carried on to treated rows."""
        w = Window.partitionBy("part").orderBy(*order)
        return F.last(F.when(F.col("c"), F.col("own")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))

    def with_last(d: DataFrame, order: list[Column], name: str) -> DataFrame:
        w = Window.partitionBy("part", "c").orderBy(*order)
        own = F.array_compact(F.array(*[F.lag(one, i).over(w) for i in range(ratio)]))
        return d.withColumn("own", own).withColumn(name, last(order)).drop("own")

    met = with_last(dealt, [F.asc("e"), F.asc("c"), F.desc("k")], "below")
    met = with_last(met, [F.desc("e"), F.desc("c"), F.desc("k")], "above").where(~F.col("c")).join(F.broadcast(carried), "part")
    none = F.array().cast(f"array<struct<e: double, k: {kind}>>")
    every = F.concat(*[F.coalesce(x, none) for x in ("below", "above", "before", "after")])
    near = F.filter(F.transform(every, lambda x: F.struct(F.abs(F.col("e") - x["e"]).alias("d"), x["e"].alias("e"), x["k"].alias("k"))), lambda x: x["d"] <= caliper)
    return met.select(F.col("k").alias("treated"), F.explode(F.slice(F.sort_array(near), 1, ratio)).alias("x")).select("treated", F.col("x.k").alias("control"), F.col("x.d").alias("distance"))


def settle(e: np.ndarray, control: np.ndarray, n: np.ndarray, used: np.ndarray, low: float, high: float, caliper: float) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """Greedy matches of groups in order of e that nothing at low or below and at high or above can change.

    n are the groups' free members, used how many are gone. Returns (e of the treated group, its first
    member, e of the control group, its first member, number), n and used after it, and which groups wait.
    """
    n, used = n.copy(), used.copy()
    size = len(e)
    after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
    waits, found, heap = np.zeros(size, bool), [], []
    unsure = [low, high, math.inf]  # where something stands that may yet be matched otherwise, or leave

    def offer(i: int, j: int) -> None:
        if 0 <= i and j < size and control[i] != control[j] and e[j] - e[i] <= caliper:
            t, c = (j, i) if control[i] else (i, j)
            heapq.heappush(heap, (e[j] - e[i], e[t], e[c], i, j))

    for i in range(size - 1):
        offer(i, i + 1)
    while heap:
        d, _, _, i, j = heapq.heappop(heap)
        if not n[i] or not n[j] or after[i] != j:
            continue
        if unsure[bisect_left(unsure, e[i] - d)] <= e[j] + d:
            for g in (i, j):
                if not waits[g]:
                    waits[g] = True
                    insort(unsure, e[g])
            continue
        m = min(n[i], n[j])
        t, c = (j, i) if control[i] else (i, j)
        found.append((float(e[t]), int(used[t]), float(e[c]), int(used[c]), int(m)))
        for g in (i, j):
            n[g] -= m
            used[g] += m
            if not n[g]:
                a, b = before[g], after[g]
                if a >= 0:
                    after[a] = b
                if b < size:
                    before[b] = a
        a, b = (i if n[i] else before[i]), (j if n[j] else after[j])
        offer(a, b)
    return found, n, used, waits


_MATCHES = "et double, it long, ec double, ic long, m long"


def _greedy(groups: DataFrame, caliper: float, ranges: int) -> tuple[DataFrame, DataFrame]:
    """(matches, groups left over), by rounds over ranges; each round has another number of ranges, so other ends."""
    spark = groups.sparkSession
    done = spark.createDataFrame([], _MATCHES)
    left, r = groups, ranges
    while True:
        # groups of one score, one of either arm, must not be parted: they are each other's nearest
        dealt = checkpointed(left.repartitionByRange(r, "e").sortWithinPartitions("e", "c").withColumn("part", F.spark_partition_id()))
        ends = {x["part"]: (x["low"], x["high"]) for x in dealt.groupBy("part").agg(F.min("e").alias("low"), F.max("e").alias("high")).collect()}  # a row a range
        parts = sorted(ends)
        outside = {p: (ends[parts[i - 1]][1] if i else -math.inf, ends[parts[i + 1]][0] if i + 1 < len(parts) else math.inf) for i, p in enumerate(parts)}

        def work(batches: Iterator[pd.DataFrame], outside=outside) -> Iterator[pd.DataFrame]:
            own = [b for b in batches if len(b)]
            if not own:
                return
            b = pd.concat(own)
            low, high = outside[int(b["part"].iloc[0])]
            found, n, used, waits = settle(b["e"].to_numpy(), b["c"].to_numpy(bool), b["n"].to_numpy(), b["used"].to_numpy(), low, high, caliper)
            yield pd.DataFrame(found, columns=["et", "it", "ec", "ic", "m"]).assign(kind=0)
            yield pd.DataFrame({"kind": 1, "et": b["e"], "c": b["c"], "m": n, "it": used, "w": waits, "part": b["part"]})[n > 0]

        columns = ["kind", "et", "it", "ec", "ic", "m", "c", "w", "part"]
        out = checkpointed(dealt.mapInPandas(lambda bs, w=work: (x.reindex(columns=columns) for x in w(bs)), f"kind int, {_MATCHES}, c boolean, w boolean, part int"))
        done = done.unionByName(out.where("kind = 0").select("et", "it", "ec", "ic", "m"))
        rest = out.where("kind = 1").select(F.col("et").alias("e"), "c", F.col("m").alias("n"), F.col("it").alias("used"), "w", "part")
        left, r = rest.drop("w", "part"), max(1, r - 1)
        if not _goes_on(rest, caliper):
            return done, left


def _goes_on(rest: DataFrame, caliper: float) -> bool:
    """Whether rows of two arms within the caliper are left, in one range or on both sides of an end."""
    ends = [f(F.when(F.col("c") == c, F.col("e"))) for c in (True, False) for f in (F.min, F.max)]
    low, top = [math.inf, math.inf], [-math.inf, -math.inf]
    for _, waits, *e in sorted(tuple(x) for x in rest.groupBy("part").agg(F.max("w"), *ends).collect()):  # a row a range
        low = [math.inf if x is None else x for x in e[0::2]]
        if waits or low[0] - top[1] <= caliper or low[1] - top[0] <= caliper:
            return True
        top = [t if x is None else x for t, x in zip(top, e[1::2], strict=True)]
    return False


def nearest_without_replacement(df: DataFrame, key: str, treatment: str, score: str, caliper: float, ratio: int = 1, ranges: int | None = None) -> DataFrame:
    """(treated, control, distance): the nearest pair within the caliper is taken, then the nearest of what is left; ratio times over.

    A control is matched once. Of equally near pairs those of lower scores (treated, then control), then
    of lower keys come first; in each of the ratio passes every treated row gets a control if it can.
    Rows without key, score or treatment are passed over; keys should be unique.
    """
    rows, n = _on_line(df, key, treatment, score, ranges)
    rows = numbered(rows, ["c", "e"], ["k"], n)  # checkpointed
    all_ = rows.groupBy("e", "c").agg(F.count("*").alias("n")).withColumn("used", F.lit(0).cast("long"))
    treated_groups, controls = all_.where(~F.col("c")), all_.where("c")
    matches = None
    for _ in range(ratio):
        got, left = _greedy(treated_groups.unionByName(controls), caliper, n)
        controls = left.where("c")
        matches = got if matches is None else matches.unionByName(got)
    pieces = matches.withColumn("piece", F.explode(F.sequence(F.expr(f"it div {PIECE}"), F.expr(f"(it + m - 1) div {PIECE}"))))
    treated = rows.where(~F.col("c")).select(F.col("k").alias("treated"), F.col("e").alias("et"), F.col("at").alias("i"), F.expr(f"at div {PIECE}").alias("piece"))
    pairs = treated.join(pieces, ["et", "piece"]).where("i >= it and i < it + m").select("treated", "et", "ec", (F.col("ic") + F.col("i") - F.col("it")).alias("j"))
    members = rows.where("c").select(F.col("k").alias("control"), F.col("e").alias("ec"), F.col("at").alias("j"))
    return pairs.join(members, ["ec", "j"]).select("treated", "control", F.abs(F.col("et") - F.col("ec")).alias("distance"))


def nearest_pairs(df: DataFrame, key: str, treatment: str, score: str, caliper: float, ratio: int = 1, replace: bool = True, ranges: int | None = None) -> DataFrame:
    return (nearest_with_replacement if replace else nearest_without_replacement)(df, key, treatment, score, caliper, ratio, ranges)


def nearest_match(
    df: DataFrame, key: str, treatment: str, outcome: str, covariates: list[str], caliper_sd: float = 0.2, ratio: int = 1, replace: bool = True, estimand: str = "ATT",
) -> DataFrame:
    """Effect by nearest propensities within a caliper of so many deviations: each row against the mean of its matches.

    ATT matches the treated, ATC the controls, ATE both. n are the rows that found a match, of all; with
    replacement errors count how often a control is used, by the variance of differences over the rows.
    """
    base = propensity(df.na.drop(subset=[treatment, outcome, *covariates]), treatment, covariates, "_e")
    d = checkpointed(base.select(F.col(key).alias("k"), F.col(treatment).cast("double").alias("t"), F.col(outcome).cast("double").alias("y"), F.round("_e", DIGITS).alias("e")))
    sd, all_ = d.agg(F.stddev_samp("e"), F.count("*")).first()
    caliper = caliper_sd * (sd or 1e-6)
    y = d.select("k", "y")
    diffs = None
    for arm in {"ATT": [1], "ATC": [0], "ATE": [1, 0]}[estimand]:
        pairs = nearest_pairs(d.withColumn("t", (F.col("t") == arm).cast("int")), "k", "t", "e", caliper, ratio, replace)
        per = pairs.join(y.select(F.col("k").alias("control"), F.col("y").alias("y0")), "control").groupBy("treated").agg(F.avg("y0").alias("y0"))
        own = per.join(y.select(F.col("k").alias("treated"), "y"), "treated").select(((F.col("y") - F.col("y0")) * (1 if arm else -1)).alias("d"))
        diffs = own if diffs is None else diffs.unionByName(own)
    point, s, n = diffs.agg(F.avg("d"), F.stddev_samp("d"), F.count("*")).first()
    name = "matching.nearest" + ("" if replace else "_once")
    return frame(df.sparkSession, [row(name, treatment, outcome, point, (s or 0.0) / math.sqrt(max(n, 1)), n, estimand=estimand, caliper=caliper, rows=all_)])
