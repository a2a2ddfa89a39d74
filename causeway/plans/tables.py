"""The analysis tables that registered queries share, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.functions.moments import PRIME


#: Factors of the two lanes of an item's id: their sums stay below 2^63.
LANES = ((1073741827, 536870923, 268435459, 134217757), (402653189, 805306457, 201326611, 1610612741))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items: id (62 bits of a hash of all keys), t (discount over 5%), y (price), w1 (quantity), w2 (tax), flag, ship."""
    keys = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    lane = lambda factors: F.pmod(sum((F.pmod(F.col(k).cast("long"), F.lit(PRIME).cast("long")) * f for k, f in zip(keys, factors, strict=True)), F.lit(0).cast("long")), F.lit(PRIME).cast("long"))
    return table(spark, sf_dir, "lineitem").select(
        (lane(LANES[0]) * (1 << 31) + lane(LANES[1])).alias("id"), (F.col("l_discount") > 0.05).cast("int").alias("t"), F.col("l_extendedprice").alias("y"),
        F.col("l_quantity").alias("w1"), F.col("l_tax").alias("w2"), F.col("l_returnflag").alias("flag"), F.col("l_shipdate").alias("ship"),
    )


def _lane(factors: tuple[int, ...]) -> str:
    return "((" + " + ".join(f"({k} % {PRIME}) * {f}" for k, f in zip(("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber::BIGINT"), factors, strict=True)) + f") % {PRIME})"


ITEMS = (
    f"items AS (SELECT {_lane(LANES[0])} * 2147483648 + {_lane(LANES[1])} AS id, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS t, l_extendedprice AS y,"
    " l_quantity AS w1, l_tax AS w2, l_returnflag AS flag, l_shipdate AS ship FROM lineitem)"
)


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer: id, t (urgent or high priority), y (total price), x (balance), segment, nation, month."""
    # customers grow with the orders: they meet by shuffle, none are sent to the driver, which a broadcast does in each pass
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").hint("shuffle_hash")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("t"), F.col("o_totalprice").alias("y"), F.col("c_acctbal").alias("x"),
        F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.trunc("o_orderdate", "month").alias("month"),
    )


SALES = (
    "sales AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS t, o_totalprice AS y, c_acctbal AS x,"
    " c_mktsegment AS segment, c_nationkey AS nation, date_trunc('month', o_orderdate)::DATE AS month FROM orders JOIN customer ON o_custkey = c_custkey)"
)


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with holes by rule: balance null in every seventh, segment null in every fifth, nation null in every seventh and tenth."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("key"), F.when(k % 7 != 0, F.col("c_acctbal")).alias("balance"), F.when(k % 5 != 0, F.col("c_mktsegment")).alias("segment"),
        F.when((k % 7 != 0) & (k % 10 != 0), F.col("c_nationkey")).alias("nation"), (F.col("c_acctbal") > 0).cast("int").alias("t"),
    )


GAPS = (
    "gaps AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS balance, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment,"
    " CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 10 <> 0 THEN c_nationkey END AS nation, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS t FROM customer)"
)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User and day (whole grid): unit, time (days from the first), y (value), n, onset (first day with three errors, null if none), d."""
    e = table(spark, sf_dir, "events")
    start = e.agg(F.min(F.to_date("ts"))).first()[0]
    day = F.datediff(F.to_date("ts"), F.lit(start))
    daily = e.groupBy(F.col("user_id").alias("unit"), day.alias("time")).agg(F.sum("value").alias("y"), F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    # every unit has a row for every day of the span: days are as many as the calendar has
    span = e.agg(F.max(day).alias("last"))
    grid = daily.select("unit").distinct().crossJoin(F.broadcast(span)).select("unit", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("time"))
    full = grid.join(daily, ["unit", "time"], "left").na.fill(0, ["y", "n", "errors"])
    onset = F.min(F.when(F.col("errors") >= 3, F.col("time"))).over(Window.partitionBy("unit"))
    return full.withColumn("onset", onset).select("unit", "time", "y", "n", "onset", F.coalesce((F.col("time") >= F.col("onset")).cast("int"), F.lit(0)).alias("d"))


PANEL = """days AS (SELECT user_id AS unit, date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) AS time, sum(value) AS y, count(*) AS n,
  count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ALL),
grid AS (SELECT unit, unnest(range(0, (SELECT max(time) + 1 FROM days))) AS time FROM (SELECT DISTINCT unit FROM days)),
whole AS (SELECT unit, time, coalesce(y, 0) AS y, coalesce(n, 0) AS n, min(CASE WHEN errors >= 3 THEN time END) OVER (PARTITION BY unit) AS onset
  FROM grid LEFT JOIN days USING (unit, time)),
panel AS (SELECT *, CASE WHEN time >= onset THEN 1 ELSE 0 END AS d FROM whole)"""


def by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation and month, the whole grid: unit, time (months from the first), y (sum of order prices), n; zeros where there is none."""
    s = sales(spark, sf_dir)
    first = s.agg(F.min("month")).first()[0]
    d = s.groupBy(F.col("nation").alias("unit"), F.floor(F.months_between("month", F.lit(first))).cast("int").alias("time")).agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    grid = d.select("unit").distinct().crossJoin(F.broadcast(d.agg(F.max("time").alias("last")))).select("unit", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("time"))
    return grid.join(d, ["unit", "time"], "left").na.fill(0, ["y", "n"])


NATIONS = f"""{SALES}, seen AS (SELECT nation AS unit, date_diff('month', (SELECT min(month) FROM sales), month)::INT AS time, sum(y) AS y, count(*) AS n FROM sales GROUP BY ALL),
nations AS (SELECT unit, time, coalesce(y, 0)::DOUBLE AS y, coalesce(n, 0) AS n FROM (SELECT unit, unnest(range(0, (SELECT max(time) + 1 FROM seen)))::INT AS time FROM (SELECT DISTINCT unit FROM seen)) LEFT JOIN seen USING (unit, time))"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with doubles rounded to significant places of their column's use: sums differ in their last bits between runs."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])
