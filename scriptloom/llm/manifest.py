"""A Merkle manifest of a table: hash trees built in blocks by higher-order SQL functions, with a proof for each row.

A tree has one leaf a row, in the order of ids, for each language; the roots of the languages, in their order, are the leaves
of one more tree. Nodes are paired from the left at each level; a last node without a partner is hashed by itself.

1. Leaf digests are made where the text is read, and written; only digests and ids are ordered after that, by a range
   partitioning whose last key is the row itself, so that repeated ids can't fill one task.
2. A leaf's rank is its place in its partition and the sizes of the partitions before it: no window holds a language.
3. ``2**BLOCK_BITS`` nodes of consecutive ranks are one array. ``aggregate`` over ``slice``d levels, ``transform`` over a
   ``sequence`` of pairs, collapse it natively to one node; the blocks' nodes are the leaves of the next round, which has that
   many times fewer rows. So ten billion rows take five rounds, all but the first over little data.
4. Siblings go back down: a block's path to the root is joined to the blocks below it, where each leaf takes its siblings from
   the block's own levels. A proof is as long as its tree is high.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import discard, materialise

#: A block has 2**BLOCK_BITS nodes: about 16 KB of digests, and twice that with the levels above them.
BLOCK_BITS = 8
#: Rows whose crc32 this divides are tampered with by :func:`manifest`.
TAMPER = 7

_PATH = "array<struct<right: boolean, digest: string>>"


def digest(*fields: Column) -> Column:
    """The leaf of a row: SHA-256 over its fields, each ``-`` if null, else its length in UTF-8 bytes, a colon and itself."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _ranked(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` (``tree``, ``order`` columns) and ``rank``, ``size`` of each in its tree, in that order, nulls first; and the table that it reads."""
    keys = [F.asc_nulls_first(c) for c in ("tree", *order)]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    placed = materialise(placed.withColumn("part", F.expr("shiftright(place, 33)")), "ordered")
    parts = placed.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    # as many rows a tree as partitions hold rows of it
    whole, before = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("tree", "part", "first", F.sum("n").over(whole).alias("size"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = placed.join(parts, ["tree", "part"]).withColumn("rank", F.col("place") - F.col("first") + F.col("before"))
    return ranked.drop("place", "part", "first", "before"), placed


def _height(size: str) -> Column:
    return F.when(F.col(size) > 1, F.length(F.bin(F.col(size) - 1))).otherwise(0)


def _blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """``tree, block, size, leaves, levels, root`` of nodes ``tree, rank, size, node`` and ``payload``: digests collapsed by BLOCK_BITS levels, or to the root."""
    span = 1 << BLOCK_BITS
    grouped = nodes.groupBy("tree", F.expr(f"rank div {span}").alias("block")).agg(
        F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("rank", "node", *payload))).alias("leaves")
    )
    pairs = lambda x: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(x) - 1) / 2).cast("int")),
        lambda j: F.sha2(F.concat(F.get(x, j * 2), F.coalesce(F.get(x, j * 2 + 1), F.lit(""))), 256),
    )
    steps = F.slice(F.sequence(F.lit(1), F.lit(BLOCK_BITS)), F.lit(1), F.least(F.lit(BLOCK_BITS), _height("size")))
    levels = F.aggregate(
        steps, F.array(F.transform("leaves", lambda x: x["node"])).cast("array<array<string>>"),
        lambda done, _: F.concat(done, F.array(pairs(F.element_at(done, -1)))),
    )
    return grouped.withColumn("levels", levels).withColumn("root", F.element_at("levels", -1)[0])


def _siblings(i: Column) -> Column:
    """The path of the block's leaf i inside its block: a sibling a level, its digest null where there is none, and whether it is on the right."""
    levels = F.col("levels")
    return F.transform(
        F.slice(levels, F.lit(1), F.size(levels) - 1),
        lambda level, l: F.struct(
            (F.call_function("shiftright", i, l) % 2 == 0).alias("right"), F.get(level, F.call_function("shiftright", i, l).bitwiseXOR(F.lit(1))).alias("digest")
        ),
    ).cast(_PATH)


def _trees(rows: DataFrame, order: list[str], payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """``tree, node, subroot, path`` and ``payload`` for each of ``rows``; and the last round's blocks, one a tree."""
    nodes, placed = _ranked(rows, order)
    rounds, top = [], False
    while not top:
        blocks = materialise(_blocks(nodes, payload if not rounds else []), "blocks")
        rounds.append(blocks)
        nodes = blocks.select("tree", F.col("block").alias("rank"), F.expr(f"(size + {(1 << BLOCK_BITS) - 1}) div {1 << BLOCK_BITS}").alias("size"), F.col("root").alias("node"))
        top = nodes.where("size > 1").isEmpty()
    discard(placed)
    above = rounds[-1].select("tree", "block", F.col("root").alias("subroot"), F.array().cast(_PATH).alias("upper"))
    for k in range(len(rounds) - 1, -1, -1):
        kept = ["node", *(payload if k == 0 else [])]
        met = rounds[k].select("tree", "block", "leaves", "levels").join(above, ["tree", "block"])
        leaf = F.transform("leaves", lambda x, i: F.struct(x["rank"].alias("rank"), *[x[c].alias(c) for c in kept], F.concat(_siblings(i), F.col("upper")).alias("path")))
        found = met.select("tree", "subroot", F.inline(leaf))
        if k:
            above = found.select("tree", F.col("rank").alias("block"), "subroot", F.col("path").alias("upper"))
    return found, rounds[-1]


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    step = lambda node, x: F.sha2(F.when(x["digest"].isNull(), node).when(x["right"], F.concat(node, x["digest"])).otherwise(F.concat(x["digest"], node)), 256)
    return F.aggregate(path, leaf, step)


def manifest(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: str | None = "n_chars") -> DataFrame:
    """One row for each input row: ``doc_id long, leaf, subroot, root, proof_sha256, folded_root string, verified boolean``.

    ``proof_sha256`` hashes the siblings from the leaf to the root, of the trees as they are. ``folded_root`` comes from the leaf and those
    siblings; where ``TAMPER`` divides the crc32 of the decimal id, from a leaf whose ``tampered`` column is larger by one (a null one
    stays, so such a row is verified). ``verified``: it equals ``root``.

    A null ``tree_col`` is a tree of its own, before all others; trees are ordered bytewise. Null ids come first in their tree and are never tampered
    with. Rows that share an id are leaves each, ordered by their digests; equal rows are interchangeable. Null fields are ``-``, empty
    ones ``0:``. A table of one row has its leaf as root and the digest of nothing as proof. An empty table gives an empty result.
    Columns that aren't in ``fields`` are ignored.
    """
    tree = F.coalesce(F.concat(F.lit("1"), F.col(tree_col).cast("string")), F.lit("0"))
    other = F.lit(None).cast("string")
    if tampered:
        hit = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % TAMPER == 0
        other = F.when(hit & F.col(tampered).isNotNull(), digest(*[F.col(c) + 1 if c == tampered else F.col(c) for c in fields]))
    leaves = docs.select(tree.alias("tree"), F.col(id_col).cast("long").alias("doc_id"), digest(*map(F.col, fields)).alias("node"), other.alias("other"))
    leaves = materialise(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    found, tops = _trees(leaves, ["doc_id", "node", "row"], ["doc_id", "other"])
    discard(leaves)
    # the languages' roots are the leaves of the last tree
    roots = tops.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("node"))
    last, _ = _trees(roots, ["of"], ["of"])
    last = last.select(F.col("of").alias("tree"), F.col("subroot").alias("root"), F.col("path").alias("last"))
    found = found.join(last, "tree").withColumn("path", F.concat("path", "last"))
    found = found.select(
        "doc_id", F.col("node").alias("leaf"), "subroot", "root",
        F.sha2(F.array_join(F.transform("path", lambda x: x["digest"]), ""), 256).alias("proof_sha256"),
        fold(F.coalesce("other", "node"), F.col("path")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
