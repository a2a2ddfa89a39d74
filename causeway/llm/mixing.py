"""Mixing sources to target weights by hierarchical budgets.

A token budget flows down a tree of levels (domain, language, source). Each parent splits its budget
by its children's weights; a child can take max_epochs times its own tokens at most, and what it
can't take goes to its siblings by weight. As a child's capacity is that of its whole subtree, a
shortage reaches the parent's siblings only when the parent's own subtree is used up.

A leaf with budget b and t tokens takes b div t whole epochs and a prefix of one more: its documents
in the order of md5(seed|epoch|doc_id), as long as their tokens fit into the rest.

Only Spark's own functions are used. Tokens here are words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.llm.common import documents, fresh, stored, words

NULL_NODE = "(null)"
#: Leaf tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_LEAVES = 50_000
#: Hex digits by which a range of the order is cut, and digits of the whole order; so few rows of a leaf are sorted in one task.
CUT_DIGITS, ORDER_DIGITS, SORTED_ROWS = 2, 32, 256
DOMAINS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANGS = {"en": 4, "de": 2, "fr": 2, "es": 1}


def _weight(path: Column, weights: dict[str, int]) -> Column:
    """The weight of a node: of its path if given, else of its own name, else 1."""
    if not weights:
        return F.lit(1)
    known = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.try_element_at(known, path), F.try_element_at(known, F.element_at(F.split(path, "/"), -1)), F.lit(1))


def split_budget(leaves: DataFrame, levels: list[str], budget: int, weights: dict[str, int], max_epochs: int) -> DataFrame:
    """leaves (levels, tokens) with the budget of each leaf; whole tokens, rounded down."""
    leaves = leaves.withColumn("_cap", F.col("tokens") * max_epochs)
    given = None
    for k in range(1, len(levels) + 1):
        node, parent = levels[:k], levels[: k - 1]
        nodes = leaves.groupBy(*node).agg(F.sum("_cap").alias("_cap"))
        nodes = nodes.withColumn("_w", _weight(F.concat_ws("/", *node), weights).cast("long")).where("_w > 0")
        nodes = nodes.withColumn("_b", F.lit(budget).cast("long")) if given is None else nodes.join(given, parent)
        family = Window.partitionBy(*(parent or [F.lit(0)]))  # nodes, not rows
        ordered = family.orderBy(F.col("_cap") / F.col("_w"), node[-1])
        nodes = (
            nodes.withColumn("_before", F.coalesce(F.sum("_cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("_from", F.sum("_w").over(ordered.rowsBetween(0, Window.unboundedFollowing)))
            .withColumn("_full", F.expr("_cap * _from <= (_b - _before) * _w"))
            .withColumn("_used", F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0)).over(family))
            .withColumn("_open", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_w"))).over(family))
            .withColumn("_b", F.expr("if(_full, _cap, ((_b - _used) * _w) div _open)"))
        )
        given = nodes.select(*node, "_b")
    return leaves.drop("_cap").join(given, levels).withColumnRenamed("_b", "budget")


def mix(
    docs: DataFrame, levels: dict[str, Column], weights: dict[str, int], share: float = 0.5,
    max_epochs: int = 1, seed: int = 0, text: str = "text", row_id: str = "doc_id",
) -> DataFrame:
    """The documents of the mixture with epochs, the times each one is taken.

    The budget is share of all tokens of docs. levels name the tree from the top; a null value is a
    node of its own, named ``(null)``. A document without words costs nothing and is in the prefix
    if the tokens before it fit. Rows with equal id and text are taken or left together, as long as
    all of them fit. Where nothing is taken, or docs is empty, the result is empty. A column of docs
    named epochs is replaced, others stay, whatever their names.

    A leaf may hold most of the rows, so no leaf is sorted: its order is cut into 256 ranges of the
    hash, whose token sums tell in which range the prefix ends; that range is cut again by the next
    two digits, until few rows are left. What each leaf keeps is one bound of the order.
    """
    names = [f"l{k}" for k in range(len(levels))]
    kept = docs.drop("epochs")
    *inner, limit = fresh(kept, *names, "limit")
    at = dict(zip(names, inner, strict=True))
    nodes = [F.coalesce(c.cast("string"), F.lit(NULL_NODE)) for c in levels.values()]
    tokens = F.size(words(F.col(text))).cast("long")

    def order(epoch: Column, row: Column) -> Column:
        return F.md5(F.concat_ws("|", F.lit(seed), epoch.cast("string"), F.coalesce(row.cast("string"), F.lit(""))).cast("binary"))

    sized = stored(docs.select(*[c.alias(n) for n, c in zip(names, nodes, strict=True)], F.col(row_id).alias("id"), tokens.alias("n"), F.xxhash64(text).alias("check")))
    leaves = stored(sized.groupBy(*names).agg(F.sum("n").alias("tokens")))
    n_leaves, total = leaves.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    plan = split_budget(leaves, names, int(total * share), weights, max_epochs).where("tokens > 0")
    # cut: the range in which the prefix ends, as far as it is known; done: the tokens before it
    plan = stored(plan.select(*names, F.expr("budget div tokens").alias("whole"), F.expr("budget % tokens").alias("rest"), F.lit("").alias("cut"), F.lit(0).cast("long").alias("done")))

    def with_plan(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(plan) if n_leaves <= BROADCAST_LEAVES else plan, names)

    rows = with_plan(sized).select(*names, order(F.col("whole"), F.col("id")).alias("order"), "check", "n")
    digits = 0
    while digits < ORDER_DIGITS:
        digits += CUT_DIGITS
        ranges = rows.groupBy(*names, F.substring("order", 1, digits).alias("range")).agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*names).orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
        cuts = with_plan(ranges).withColumn("upto", upto + F.col("done")).groupBy(*names, "whole", "rest").agg(
            F.min(F.when(F.col("upto") > F.col("rest"), F.col("range"))).alias("cut"),
            F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))), F.first("done")).alias("done"),
        )
        plan = stored(cuts)
        rows = stored(with_plan(rows).where(F.substring("order", 1, digits) == F.col("cut")).select(*names, "order", "check", "n"))
        most = rows.groupBy(*names).agg(F.count("*").alias("k")).agg(F.max("k")).first()[0]
        if not most or most <= SORTED_ROWS:
            break
    # rows with equal order and text are one step
    steps = rows.groupBy(*names, "order", "check").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*names).orderBy("order", "check").rowsBetween(Window.unboundedPreceding, 0))
    last = with_plan(steps).withColumn("upto", upto + F.col("done")).where("upto <= rest").groupBy(*names).agg(F.max(F.struct("order", "check")).alias("last"))
    # before the first row of the cut range all is taken
    bounds = stored(plan.join(last, names, "left").select(*[F.col(n).alias(at[n]) for n in names], "whole", F.coalesce("last.order", "cut").alias("cut"), F.col("last.check").alias("check")))
    bounds = bounds.select(*[at[n] for n in names], F.struct("whole", "cut", "check").alias(limit))
    keyed = kept.select("*", *[c.alias(at[n]) for n, c in zip(names, nodes, strict=True)])
    joined = keyed.join(F.broadcast(bounds) if n_leaves <= BROADCAST_LEAVES else bounds, [at[n] for n in names])
    mine, bound = order(F.col(f"{limit}.whole"), F.col(row_id)), F.col(f"{limit}.cut")
    taken = (mine < bound) | ((mine == bound) & (F.xxhash64(text) <= F.col(f"{limit}.check")))
    epochs = F.col(f"{limit}.whole") + F.when(taken, 1).otherwise(0)
    return joined.select(*[F.col(f"`{c}`") for c in kept.columns], epochs.cast("long").alias("epochs")).where("epochs > 0")


def by_domain() -> dict[str, Column]:
    """The tree of documents: four domains by the source's number, then language, then source."""
    number = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), r"(\d+)$", 1).try_cast("int")
    domain = F.concat(F.lit("d"), F.coalesce(F.pmod(number, F.lit(4)), F.lit(0)))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture of 60 % of all tokens in up to three epochs; see mix() for nulls, empty texts, repeated rows and empty tables."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    mixed = mix(docs, by_domain(), DOMAINS | LANGS, share=0.6, max_epochs=3, seed=7)
    return mixed.select("doc_id", "lang", "source", "epochs")


def _oracle() -> str:
    case = lambda col, known: "CASE " + col + "".join(f" WHEN '{k}' THEN {v}" for k, v in known.items()) + " ELSE 1 END"
    level = lambda k, node, parent, name, weight, above: f"""
n{k} AS (SELECT {node}, sum(cap)::BIGINT AS cap, any_value({weight})::BIGINT AS w FROM leaves GROUP BY {node}),
o{k} AS (
  SELECT n.*, b, coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (PARTITION BY {parent} ORDER BY cap / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wfrom
  FROM n{k} n {above}),
f{k} AS (SELECT *, cap * wfrom <= (b - before) * w AS is_full FROM o{k}),
b{k} AS (
  SELECT {node}, CASE WHEN is_full THEN cap ELSE ((b - used) * w) // wopen END::BIGINT AS b
  FROM (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (PARTITION BY {parent}) AS used,
               sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (PARTITION BY {parent}) AS wopen FROM f{k}))"""  # noqa: E731
    return f"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(lang, '(null)') AS l1, coalesce(source, '(null)') AS l2,
         'd' || coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '(\\d+)$', 1) AS INT) % 4, 0) AS l0,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n
  FROM documents),
leaves AS (SELECT l0, l1, l2, sum(n)::BIGINT AS tokens, (3 * sum(n))::BIGINT AS cap FROM d GROUP BY l0, l1, l2),
{level(1, "l0", "1", "l0", case("l0", DOMAINS), "CROSS JOIN (SELECT (sum(tokens) * 0.6)::DOUBLE AS x, floor(sum(tokens)::DOUBLE * 0.6::DOUBLE)::BIGINT AS b FROM leaves)")},
{level(2, "l0, l1", "l0", "l1", case("l1", LANGS), "JOIN b1 USING (l0)")},
{level(3, "l0, l1, l2", "l0, l1", "l2", "1", "JOIN b2 USING (l0, l1)")},
plan AS (SELECT l0, l1, l2, b // tokens AS whole, b % tokens AS rest FROM b3 JOIN leaves USING (l0, l1, l2) WHERE tokens > 0),
walk AS (
  SELECT d.*, whole, rest, sum(n) OVER (PARTITION BY l0, l1, l2 ORDER BY md5('7|' || whole || '|' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN plan USING (l0, l1, l2))
SELECT doc_id, lang, source, (whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS epochs
FROM walk WHERE whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0
"""


ORACLE = _oracle()
