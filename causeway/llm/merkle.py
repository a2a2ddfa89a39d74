"""A Merkle manifest of a table: every row a leaf, a tree a group, a tree over the groups' roots.

A level is built by a slot pivot: nodes are grouped by parent, and conditional aggregates spread the
children over as many columns as a run has slots. The columns concatenated and hashed are the parent;
without the own slot's column they are a child's siblings. The way down joins each level's pivoted
rows, an eighth of its nodes, with their parents' proofs, so a proof grows by one step a level and no
row is ever looked up by its ancestors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.llm.common import LOWER, UPPER, documents, stored

FANOUT = 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_ROW_BITS = 33


def digest(*parts: Column | str) -> Column:
    """Lowercase hex sha256 of the concatenated parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(c: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, a colon and the value."""
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(columns: list[Column]) -> Column:
    return digest(*[field(c) for c in columns])


def numbered(rows: DataFrame, group: str, order: list[Column | str]) -> DataFrame:
    """rows with at, the place in the group from 0, and n, the group's rows; order must tell rows apart.

    Rows are dealt by ranges and sorted within each, so that a row's place is its range's offset in the
    group and its row number there; only a row for each range and group is windowed.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(ranges, group, *order).sortWithinPartitions(group, *order)
    row = F.monotonically_increasing_id()
    dealt = stored(sorted_.withColumns({"_part": F.shiftright(row, _ROW_BITS), "_row": row.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))}))
    ends = dealt.groupBy("_part", group).agg(F.min("_row").alias("_first"), F.count("*").alias("_held"))
    of_group = Window.partitionBy(group)
    before = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select("_part", group, "_first", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_offset"), F.sum("_held").over(of_group).alias("n"))
    return dealt.join(offsets, ["_part", group]).withColumn("at", F.col("_row") - F.col("_first") + F.col("_offset")).drop("_part", "_row", "_first", "_offset")


def build(nodes: DataFrame, group: str, fanout: int = FANOUT) -> list[DataFrame]:
    """The pivoted levels of the groups' trees, leaves first; nodes has group, at, n, h and columns to carry along.

    A level has group, up (the parent's place), n (the children's number in the group), slots c0, c1, ..
    (h and what is carried) and h of the parent. A group of one node stays that node.
    """
    levels, carried = [], [c for c in nodes.columns if c not in {group, "at", "n", "h"}]
    (most,) = nodes.agg(F.coalesce(F.max("n"), F.lit(0))).first()
    while True:
        slot = F.pmod("at", F.lit(fanout))
        spread = [F.max(F.when(slot == s, F.struct("h", *carried))).alias(f"c{s}") for s in range(fanout)]
        runs = nodes.groupBy(group, F.floor(F.col("at") / fanout).alias("up")).agg(F.max("n").alias("n"), *spread)
        joined = F.concat_ws("", *[F.col(f"c{s}.h") for s in range(fanout)])
        levels.append(stored(runs.withColumn("h", F.when(F.col("n") > 1, digest(joined)).otherwise(F.col("c0.h")))))
        most = -(-most // fanout)
        if most <= 1:
            return levels
        nodes, carried = levels[-1].select(group, F.col("up").alias("at"), F.ceil(F.col("n") / fanout).alias("n"), "h"), []


def descend(levels: list[DataFrame], tops: DataFrame, group: str, keep: list[str], fanout: int = FANOUT) -> DataFrame:
    """The leaves of levels, each with h, what it carries, keep of tops, and path.

    tops has group, path and keep, a row a group. path holds, from the leaf's level up, what stands before
    and after the node in its run; levels at which a group has one node add no step.
    """
    above = tops.withColumn("at", F.lit(0).cast("long"))
    for depth, level in reversed(list(enumerate(levels))):
        own = level.drop("h").withColumnRenamed("up", "at").join(above, [group, "at"])
        slots = []
        for s in range(fanout):
            before, after = (F.concat_ws("", *[F.col(f"c{k}.h") for k in r]) for r in (range(s), range(s + 1, fanout)))
            slots.append(F.when(F.col(f"c{s}").isNotNull(), F.struct((F.col("at") * fanout + s).alias("at"), before.alias("before"), after.alias("after"), F.col(f"c{s}").alias("node"))))
        one = own.select(group, *keep, "n", "path", F.explode(F.array_compact(F.array(*slots))).alias("s"))
        path = F.when(F.col("n") > 1, F.concat(F.array(F.struct("s.before", "s.after")), "path")).otherwise(F.col("path"))
        above = one.select(group, *keep, "s.at", "s.node.*", path.alias("path")) if depth == 0 else stored(one.select(group, *keep, "s.at", path.alias("path")))
    return above


def manifest(docs: DataFrame, columns: list[str], group: str, order: str, altered: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """order, leaf, altered_leaf, subroot, root and path of every row of docs.

    Leaves hash columns; they ascend by order within their group, null first, ties by their digest.
    Groups ascend by their text, null first. altered gives other values of some columns, of which
    altered_leaf is made. Equal rows are leaves of their own. Null values count as ``-``, empty texts as
    ``0:``. A lone leaf is its group's root, a lone group's root the root; an empty table has no rows.
    Other columns of docs are not read, whatever their names.
    """
    given = {c: F.col(f"`{c}`") for c in columns}
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    leaves = stored(docs.select(
        key.alias("_group"), F.col(f"`{order}`").alias("_order"), leaf(list(given.values())).alias("h"),
        leaf(list((given | (altered or {})).values())).alias("altered_leaf"), F.monotonically_increasing_id().alias("_tie"),
    ))
    levels = build(numbered(leaves, "_group", ["_order", "h", "_tie"]).drop("_tie"), "_group", fanout)
    one_tree = levels[-1].select(F.lit(0).alias("_all"), "_group", F.col("h"))
    upper = build(numbered(one_tree, "_all", ["_group"]), "_all", fanout)
    step = "struct<before: string, after: string>"
    top = upper[-1].select("_all", F.col("h").alias("root"), F.array().cast(f"array<{step}>").alias("path"))
    subroots = stored(descend(upper, top, "_all", ["root"], fanout).select("_group", F.col("h").alias("subroot"), "root", "path"))
    told = descend(levels, subroots, "_group", ["subroot", "root"], fanout)
    return told.select(F.col("_order").alias(order), F.col("h").alias("leaf"), "altered_leaf", "subroot", "root", "path")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, start, lambda acc, x: digest(x["before"], acc, x["after"]))


def proof(path: Column) -> Column:
    """All siblings of a path, from the leaf up and left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), "")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents against their manifest, a third of them tampered with; see manifest for nulls, repeated rows and empty tables."""
    hit = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0, F.lit(False))
    lowered = F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    told = manifest(documents(spark, sf_dir), FIELDS, "lang", "doc_id", {"text": lowered})
    back = told.withColumn("folded_root", folded(F.col("altered_leaf"), F.col("path")))
    return back.select("doc_id", "leaf", "subroot", "root", digest(proof(F.col("path"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def oracle(levels: int = 8, upper: int = 4, fanout: int = FANOUT) -> str:
    """DuckDB SQL of the query for up to fanout ^ levels documents a language and fanout ^ upper languages."""
    value = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf_of = lambda text: "sha256(" + " || ".join(value(c if c != "text" else text) for c in FIELDS) + ")"
    crc_table = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, tbl[(xor(a, b) & 255) + 1])), 4294967295)"
    parts = [f"""
c AS (SELECT {crc_table} AS tbl),
d AS (SELECT doc_id, source, lang, n_chars, text,
        CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS other
      FROM documents, c),
leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf_of('text')} AS h, {leaf_of('other')} AS o FROM d),
a0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves)"""]  # fmt: skip

    def level(name: str, k: int, group: str) -> str:
        return f"""
{name}r{k} AS (SELECT {group}, pos // {fanout} AS up, max(n) AS n, list(h ORDER BY pos) AS hs FROM {name}{k} GROUP BY ALL),
{name}{k + 1} AS (SELECT {group}, up AS pos, (n + {fanout - 1}) // {fanout} AS n, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {name}r{k})"""

    def steps(name: str, group: str, at: str, count: int) -> tuple[str, list[tuple[str, str, str]]]:
        """The joins to the runs above x, and for each the run's size and what stands before and after x in it."""
        joins, found = "", []
        for k in range(count):
            slot, run = f"{at} // {fanout**k} % {fanout}", f"{name}{k}_"
            joins += f" JOIN {name}r{k} {run} ON {run}.{group} = x.{group} AND {run}.up = {at} // {fanout ** (k + 1)}"
            found.append((f"{run}.n", f"array_to_string({run}.hs[1:{slot}], '')", f"array_to_string({run}.hs[{slot} + 2:], '')"))
        return joins, found

    parts += [level("a", k, "g") for k in range(levels)]
    parts.append(f"\nb0 AS (SELECT 0 AS z, g, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM a{levels})")
    parts += [level("b", k, "z") for k in range(upper)]
    (low, below), (high, over) = steps("a", "g", "x.pos", levels), steps("b", "z", "x.top", upper)
    sides = ", ".join(f"{n} AS n{k}, {b} AS b{k}, {a} AS a{k}" for k, (n, b, a) in enumerate(below + over))
    siblings = " || ".join(f"CASE WHEN {n} > 1 THEN {b} || {a} ELSE '' END" for n, b, a in below + over)
    parts.append(f"""
x0 AS (SELECT a0.*, b0.h AS subroot, b0.pos AS top, 0 AS z, b{upper}.h AS root FROM a0 JOIN b0 USING (g), b{upper}),
f0 AS (SELECT x.*, o AS v0, {siblings} AS proof, {sides} FROM x0 x{low}{high})""")
    for k in range(levels + upper):
        parts.append(f"\nf{k + 1} AS (SELECT *, CASE WHEN n{k} > 1 THEN sha256(b{k} || v{k} || a{k}) ELSE v{k} END AS v{k + 1} FROM f{k})")
    last = f"v{levels + upper}"
    return "WITH" + ",".join(parts) + f"\nSELECT doc_id, h AS leaf, subroot, root, sha256(proof) AS proof_sha256, {last} AS folded_root, {last} = root AS verified FROM f{levels + upper}"
