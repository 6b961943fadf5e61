"""Merkle manifest of a data set by superblock reduction.

Every document is a leaf; each language's leaves, in the order of their ids, stand under a root of their own, and these
subroots under one root. Leaves are numbered by a range partition, whose sorted parts get offsets from a small table of part
sizes, so no language passes through one task. Numbers are cut into superblocks of FANOUT^LEVELS leaves; one grouped-map
call collapses LEVELS levels of a block, and the block roots are reduced in the same way until one is left of each tree.
Going down again, every block hands its members the upper part of their proofs, to which they add the lower part.

A proof is the sibling digests from the leaf to the root, left to right within a level, as one text of 64 characters each.
How many of them stand to the left of the path follows from the leaf's number and the number of leaves.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import discard, ship, stored

FANOUT, LEVELS = 8, 4
WIDTH = 64  # characters of a digest
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


def depth(n: int, fanout: int = FANOUT) -> int:
    """Levels above n leaves until one node is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def collapse(nodes: list[str], levels: int, fanout: int = FANOUT) -> list[list[str]]:
    """The nodes and `levels` levels above them; every run of `fanout`, the last one shorter, becomes its digest."""
    found = [nodes]
    for _ in range(levels):
        nodes = found[-1]
        found.append([digest("".join(nodes[at : at + fanout])) for at in range(0, len(nodes), fanout)])
    return found


def siblings(tree: list[list[str]], at: int, fanout: int = FANOUT) -> str:
    """The other members of each run on the way up from node `at`."""
    found = []
    for nodes in tree[:-1]:
        run = at - at % fanout
        found += nodes[run:at] + nodes[at + 1 : run + fanout]
        at //= fanout
    return "".join(found)


def fold(node: str, proof: str, at: int, n: int, fanout: int = FANOUT) -> tuple[str, str]:
    """The root over n leaves that follows from the leaf with number `at` and its siblings, and the siblings not used."""
    while n > 1:
        run = at - at % fanout
        left, others = WIDTH * (at - run), WIDTH * (min(fanout, n - run) - 1)
        node = digest(proof[:left] + node + proof[left:others])
        proof, at, n = proof[others:], at // fanout, -(-n // fanout)
    return node, proof


def field(c: Column) -> Column:
    """A value as its UTF-8 length, a colon and its text; null as a minus."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column) -> Column:
    return F.sha2(F.concat(*(field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), field(text)), 256)


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """(…, at, n): the place of each row of (tree, …) among its tree's rows in the given order, and how many these are.

    Rows that agree in everything are interchangeable; a number by input place deals them over several parts.
    """
    tie = F.monotonically_increasing_id().alias("tie")
    ranged = leaves.select("*", tie).repartitionByRange("tree", *order, "tie").sortWithinPartitions("tree", *order, "tie").drop("tie")
    rows = stored(ranged.withColumn("seen", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("seen", 33).alias("part")
    # A row for each tree and each part its rows stand in: as many as parts and trees together.
    parts = rows.groupBy("tree", part).agg(F.min("seen").alias("first"), F.count("*").alias("held"))
    whole = Window.partitionBy("tree")
    before = F.sum("held").over(whole.orderBy("part")) - F.col("held")
    starts = parts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("held").over(whole).alias("n"))
    found = rows.withColumn("part", part).join(starts, ["tree", "part"])
    found = stored(found.withColumn("at", F.col("seen") + F.col("shift")).drop("seen", "part", "shift"), "numbered")
    discard(rows)
    return found


def _block_roots(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(tree, at, n, node) one superblock up from (tree, at, n, node)."""
    size = fanout**levels

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        n, at = int(rows["n"].iat[0]), int(rows["at"].iat[0])
        root = collapse(rows["node"].tolist(), min(levels, depth(n, fanout)), fanout)[-1][0]
        return pd.DataFrame({"tree": rows["tree"].iloc[:1], "at": at // size, "n": -(-n // size), "node": root})

    return nodes.groupBy("tree", F.expr(f"at div {size}")).applyInPandas(run, "tree string, at long, n long, node string")


Add = tuple[str, Callable[[pd.DataFrame], dict[str, list]]]


def _with_upper(nodes: DataFrame, uppers: DataFrame, fanout: int, levels: int, add: Add | None = None) -> DataFrame:
    """Nodes with the columns of uppers (tree, at, proof, …) for their block, before whose proof their own siblings stand.
    With add (schema, function), the function's columns of such a frame take the place of its proof."""
    size = fanout**levels
    carried = [c for c in uppers.columns if c not in ("tree", "at", "proof")]
    typed = lambda f: f"`{f.name}` {f.dataType.simpleString()}"
    fields = [*map(typed, nodes.schema.fields), *(typed(uppers.schema[c]) for c in carried), add[0] if add else "proof string"]

    def run(rows: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="block").sort_values("at")
        tree = collapse(rows["node"].tolist(), min(levels, depth(int(rows["n"].iat[0]), fanout)), fanout)
        above = upper["proof"].iat[0]
        rows = rows.assign(**{c: upper[c].iat[0] for c in carried}, proof=[siblings(tree, k, fanout) + above for k in range(len(rows))])
        return rows.drop(columns="proof").assign(**add[1](rows)) if add else rows

    blocks = nodes.withColumn("block", F.expr(f"at div {size}")).groupBy("tree", "block")
    return blocks.cogroup(uppers.withColumnRenamed("at", "block").groupBy("tree", "block")).applyInPandas(run, ", ".join(fields))


def proofs(nodes: DataFrame, crown: Callable[[DataFrame], DataFrame], fanout: int = FANOUT, levels: int = LEVELS, add: Add | None = None) -> DataFrame:
    """nodes (tree, at, n, node, …) with their proof, or what add makes of it, and the other columns that crown(roots) has.

    roots is a row (tree, root) for each tree; crown adds `proof`, what stands above a root, and any columns that all nodes
    of the tree are to carry. The driver takes one step for each `levels` levels of the deepest tree.
    """
    steps, size = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while True:
        steps.append(stored(_block_roots(steps[-1].select("tree", "at", "n", "node"), fanout, levels), "blocks"))
        size = -(-size // fanout**levels)
        if size <= 1:
            break
    upper = crown(steps[-1].select("tree", F.col("node").alias("root"))).withColumn("at", F.lit(0).cast("long"))
    for below in reversed(steps[1:-1]):
        upper = stored(_with_upper(below.select("tree", "at", "n", "node"), upper, fanout, levels).drop("n", "node"), "uppers")
    return _with_upper(nodes, upper, fanout, levels, add)


def fold_up(node: str, proof: str, at: int, n: int, tree_at: int, trees: int, fanout: int = FANOUT) -> str:
    """The root of all trees that follows from a leaf and its proof."""
    subroot, rest = fold(node, proof, at, n, fanout)
    return fold(subroot, rest, tree_at, trees, fanout)[0]


def _leaves(docs: DataFrame, fanout: int, levels: int, add: Add | None) -> DataFrame:
    ship(docs.sparkSession)
    low = F.translate("text", _UPPER, _LOWER)
    # "-" sorts before "=", and after that languages sort by their bytes.
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))
    hashed = stored(docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(F.col("text")).alias("node"), leaf_of(low).alias("changed")), "hashed")
    # Ids travel through pandas as text, which has nulls beside any long.
    leaves = numbered(hashed, ["doc_id", "node"]).withColumn("doc_id", F.col("doc_id").cast("string"))
    discard(hashed)

    def top(roots: DataFrame) -> DataFrame:
        return roots.withColumn("proof", F.lit("")).withColumnRenamed("root", "top")

    def subroots(roots: DataFrame) -> DataFrame:
        rows = numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("node")), ["name"])
        found = proofs(rows, top, fanout, levels)
        return stored(found.select(F.col("name").alias("tree"), "proof", F.col("node").alias("subroot"), F.col("at").alias("tree_at"), F.col("n").alias("trees"), "top"), "subroots")

    rows = proofs(leaves, subroots, fanout, levels, add)
    rows = rows.withColumn("lang", F.when(F.col("tree") != "-", F.expr("substring(tree, 2)"))).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.withColumnsRenamed({"node": "leaf", "top": "root"})


def manifest(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """doc_id, lang, leaf, changed, at, n, subroot, tree_at, trees, root, proof of every row of documents.

    `changed` is the leaf of the same row with A-Z of its text in lower case. at and n are the row's place in its
    language's tree and that tree's size, tree_at and trees the place of that tree and the number of all; the proof is
    the siblings in the language's tree, then those of its subroot.

    Nulls are values of their own: languages that are null are one tree, the first; ids that are null come first; rows of
    one id are in the order of their leaves. Repeated rows are leaves of their own. An empty table gives no rows. Other
    columns than doc_id, source, lang, n_chars and text are not read.
    """
    return _leaves(docs, fanout, levels, None).select("doc_id", "lang", "leaf", "changed", "at", "n", "subroot", "tree_at", "trees", "root", "proof")


def tamper_report(docs: DataFrame, every: int = 3, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, leaf_index of every document.

    Texts whose id's crc32 `every` divides are put into lower case after the manifest is made; folded_root is what their
    leaf then gives with the proof of the manifest. A row without id is never changed. See manifest() for hard rows.
    """

    def check(rows: pd.DataFrame) -> dict[str, list]:
        now = [c if i is not None and zlib.crc32(i.encode()) % every == 0 else leaf for i, c, leaf in zip(rows["doc_id"], rows["changed"], rows["node"], strict=True)]
        paths = zip(now, *(rows[c] for c in ("proof", "at", "n", "tree_at", "trees")), strict=True)
        return {"proof_sha256": [digest(p) for p in rows["proof"]], "folded_root": [fold_up(*path, fanout) for path in paths]}

    rows = _leaves(docs, fanout, levels, ("proof_sha256 string, folded_root string", check))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), F.col("at").alias("leaf_index"))
