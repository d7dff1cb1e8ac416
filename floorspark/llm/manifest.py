"""Merkle manifest of a dataset with a proof for every row, by butterfly exchange.

Rows of one group (a source) are the leaves of one tree in ascending order; the
roots of all groups are the leaves of a last tree, whose root stands for the whole
dataset. An aligned block of ``fanout ** block_levels`` leaves is hashed inside one
task. Above the blocks there is no pass up and down again: in every round aligned
groups of ``fanout`` partners swap the roots of the subtrees they know, each partner
hashes the common ancestor itself, and the siblings it saw are the next level of its
proof. After the last round every block holds the tree's root and the upper part of
the proofs of all its leaves.

Blocks of a subtree share the work of sending: block and partner differ in one digit
only, as a butterfly has it. Where the last subtree is incomplete, its blocks also
stand in for the partners it lacks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorspark.plans.ordered import OrderedGroups
from floorspark.plans.skew import lookup_join
from floorspark.session import stored

FANOUT = 3
#: Levels hashed inside one task: a block has 3 ** 7 = 2,187 leaves.
BLOCK_LEVELS = 7
#: The columns a leaf is made of.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PROOF = "array<struct<before: array<string>, after: array<string>>>"


def leaf_digest(*values: Column) -> Column:
    """SHA-256 (lowercase hex) of a row: each value as its UTF-8 length, a colon
    and itself, or ``-`` where it is null."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def folded_root(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    parent = lambda below, level: F.sha2(F.array_join(F.concat(level["before"], F.array(below), level["after"]), ""), 256)
    return F.aggregate(proof, leaf, parent)


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    siblings = F.flatten(F.transform(proof, lambda level: F.concat(level["before"], level["after"])))
    return F.sha2(F.array_join(siblings, ""), 256)


def _levels(leaves: list[bytes], block: int, fanout: int, block_levels: int) -> list[list[bytes]]:
    """The nodes of a block, level by level.

    A later block is one of several and goes up all its levels, even where one
    node is left. So does a full first block, as it ends in one node there.
    """
    out = [leaves]
    while len(out[-1]) > 1 or (block > 0 and len(out) <= block_levels):
        below = out[-1]
        runs = [b"".join(below[i : i + fanout]) for i in range(0, len(below), fanout)]
        out.append([hashlib.sha256(run).hexdigest().encode() for run in runs])
    return out


def _leaves(batch: pa.RecordBatch, row: int) -> tuple[pa.StructArray, list[bytes]]:
    entries = batch.column("leaves")[row].values
    return entries, [leaf.encode() for leaf in entries.field("leaf").to_pylist()]


def _block_roots(fanout: int, block_levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("block").to_pylist()
            roots = [_levels(_leaves(batch, i)[1], b, fanout, block_levels)[-1][0].decode() for i, b in enumerate(blocks)]
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("block"), pa.array(roots, pa.string())], ["tree", "block", "hash"])

    return run


def _digest_lists(nodes: np.ndarray, index: np.ndarray, there: np.ndarray) -> pa.ListArray:
    """Lists of the digests that ``index`` names where ``there`` is true, one for
    each (leaf, level)."""
    chosen = nodes[index[there]]
    ends = np.concatenate([[0], np.cumsum(there.sum(axis=2).ravel())]).astype(np.int32)
    at = (np.arange(len(chosen) + 1, dtype=np.int32) * 64).astype(np.int32)
    digests = pa.StringArray.from_buffers(len(chosen), pa.py_buffer(at.tobytes()), pa.py_buffer(chosen.tobytes()))
    return pa.ListArray.from_arrays(pa.array(ends), digests)


def _proofs(levels: list[list[bytes]], upper: list[dict], fanout: int) -> pa.ListArray:
    """The proof of every leaf of a block: its siblings inside, then those above."""
    n, wide = len(levels[0]), fanout - 1
    inside = levels[:-1]
    above = [[d.encode() for d in level[side]] for level in upper for side in ("before", "after")]
    nodes = np.array([node for level in (*inside, *above) for node in level], dtype="S64")
    depth = len(inside) + len(upper)
    index = np.zeros((2, n, depth, wide), dtype=np.int64)
    there = np.zeros((2, n, depth, wide), dtype=bool)
    start, own, step = 0, np.arange(n), np.arange(wide)
    for k, level in enumerate(inside):
        run = own // fanout * fanout
        left, right = run[:, None] + step, own[:, None] + 1 + step
        index[0, :, k], there[0, :, k] = start + left, left < own[:, None]
        index[1, :, k], there[1, :, k] = start + right, right < np.minimum(run + fanout, len(level))[:, None]
        start, own = start + len(level), own // fanout
    for k in range(len(upper)):
        for side in (0, 1):
            size = len(above[2 * k + side])
            index[side, :, len(inside) + k, :size] = start + step[:size]
            there[side, :, len(inside) + k, :size] = True
            start += size
    if not nodes.size:
        nodes = np.zeros(1, dtype="S64")
    index[~there] = 0
    sides = [_digest_lists(nodes, index[side], there[side]) for side in (0, 1)]
    levels_of = pa.StructArray.from_arrays(sides, ["before", "after"])
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * depth), levels_of)


def _expanded(fanout: int, block_levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                entries, leaves = _leaves(batch, i)
                proof = _proofs(_levels(leaves, block, fanout, block_levels), batch.column("proof")[i].as_py(), fanout)
                same = [pa.array([batch.column(c)[i].as_py()] * len(leaves), pa.string()) for c in ("subroot", "root")]
                yield pa.RecordBatch.from_arrays([entries.field("leaf"), entries.field("row"), *same, proof], ["leaf", "row", "subroot", "root", "proof"])

    return run


def _swapped(state: DataFrame, round_: int, fanout: int) -> DataFrame:
    """One round: every block learns the roots beside its own and hashes their parent.

    ``state`` has a row per block: tree, block, blocks (of the tree), hash (of the
    block's ancestor at this level) and proof (siblings so far).
    """
    width = fanout**round_
    at = lambda text: F.expr(text.format(width=width, next=width * fanout, fanout=fanout))
    nodes, last = at("(blocks + {width} - 1) div {width}"), at("blocks - block div {width} * {width}")
    lane = at("block % {width}")
    # Partners differ in the digit of this round only, so the lane names the group.
    incomplete = (nodes > 1) & (last < width) & (at("block div {width} % {fanout}") > 0)
    lanes = F.when(incomplete, F.sequence(lane, F.lit(width - 1).cast("long"), last)).otherwise(F.array(lane))
    sent = state.select("tree", "blocks", "block", "hash", "proof", lane.alias("lane"), F.explode(lanes).alias("to"))
    met = sent.groupBy("tree", at("block div {next}").alias("group"), "to").agg(
        F.max("blocks").alias("blocks"),
        F.sort_array(F.collect_list(F.struct(at("block div {width} % {fanout}").alias("digit"), "hash"))).alias("run"),
        F.collect_list(F.when(F.col("lane") == F.col("to"), F.struct("block", "proof"))).alias("members"),
    )
    each = met.select("tree", "blocks", "run", F.explode("members").alias("member")).select(
        "tree", "blocks", "run", F.col("member.block").alias("block"), F.col("member.proof").alias("proof")
    )
    digit, several = at("block div {width} % {fanout}"), nodes > 1
    hashes = lambda keep: F.transform(F.filter("run", keep), lambda x: x["hash"])
    sides = F.struct(hashes(lambda x: x["digit"] < digit).alias("before"), hashes(lambda x: x["digit"] > digit).alias("after"))
    parent = F.sha2(F.array_join(F.transform("run", lambda x: x["hash"]), ""), 256)
    return each.select(
        "tree",
        "block",
        "blocks",
        F.when(several, parent).otherwise(F.col("run")[0]["hash"]).alias("hash"),
        F.when(several, F.concat("proof", F.array(sides))).otherwise(F.col("proof")).alias("proof"),
    )


def _trees(leaves: DataFrame, order: list[Column], fanout: int, block_levels: int) -> tuple[DataFrame, DataFrame]:
    """(blocks, paths) of the trees of ``leaves``, which has tree, leaf and row.

    A block row holds its leaves in order; a path row holds, for a block, the
    tree's root (hash) and the proof from the block to it.
    """
    span = fanout**block_levels
    ordered = OrderedGroups(leaves, ["tree"], order).numbered("number").rows
    entry = F.struct(F.col("number").alias("place"), "leaf", "row")
    blocks = ordered.groupBy("tree", F.expr(f"(number - 1) div {span}").alias("block")).agg(F.sort_array(F.collect_list(entry)).alias("leaves"))
    blocks = stored(blocks, "blocks")
    roots = stored(blocks.mapInArrow(_block_roots(fanout, block_levels), "tree string, block long, hash string"), "block-roots")
    counted = roots.groupBy("tree").agg((F.max("block") + 1).alias("blocks"))
    paths = lookup_join(roots, counted, ["tree"]).withColumn("proof", F.array().cast(_PROOF))
    most, round_ = counted.agg(F.max("blocks")).first()[0] or 0, 0
    while fanout**round_ < most:
        paths = stored(_swapped(paths, round_, fanout), "paths")
        round_ += 1
    return blocks, paths


def manifest(docs: DataFrame, carry: tuple[str, ...] = (), fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Every row of ``docs`` as a leaf, with the roots above it and its proof.

    ``docs`` has doc_id, source, lang, n_chars and text; of other columns those in
    ``carry`` are kept beside the leaf. Returns doc_id, source, the carried columns,
    leaf, subroot (of the source's tree), root (of the dataset) and proof: from the
    leaf up to the root, the digests before and after the own one in each run.

    A source's leaves ascend by doc_id, rows without one first; rows of one doc_id
    by their digest, so that repeated rows are leaves of their own beside each
    other. Null is a source of its own, ahead of all others, apart from the empty
    one. A node alone at its level is the root and is not hashed again; an empty
    table has no rows and no root.
    """
    columns = ["doc_id", "source", *carry]
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    leaves = docs.select(tree.alias("tree"), leaf_digest(*[F.col(c) for c in FIELDS]).alias("leaf"), F.struct(*columns).alias("row"))
    leaves = stored(leaves, "leaves")
    blocks, paths = _trees(leaves, [F.col("row.doc_id").asc_nulls_first(), F.col("leaf").asc()], fanout, block_levels)

    subroots = paths.where("block = 0").select(F.lit("").alias("tree"), F.col("hash").alias("leaf"), F.struct("tree").alias("row"))
    top_blocks, top_paths = _trees(subroots, [F.col("row.tree").asc()], fanout, block_levels)
    tops = _leaf_rows(top_blocks, top_paths.select("tree", "block", F.col("hash").alias("subroot"), F.col("hash").alias("root"), "proof"), "tree string", fanout, block_levels)
    tops = tops.select(F.col("row.tree").alias("tree"), "root", F.col("proof").alias("above"))

    full = lookup_join(paths, tops, ["tree"], "inner").select(
        "tree", "block", F.col("hash").alias("subroot"), "root", F.concat("proof", "above").alias("proof")
    )
    row = leaves.schema["row"].dataType.simpleString()[len("struct<") : -1]
    found = _leaf_rows(blocks, stored(full, "full-paths"), row, fanout, block_levels)
    return found.select(*[F.col("row")[c].alias(c) for c in columns], "leaf", "subroot", "root", "proof")


def _leaf_rows(blocks: DataFrame, paths: DataFrame, row: str, fanout: int, block_levels: int) -> DataFrame:
    """The leaves of all blocks with their whole proofs."""
    schema = f"leaf string, row struct<{row}>, subroot string, root string, proof {_PROOF}"
    return blocks.join(paths, ["tree", "block"]).mapInArrow(_expanded(fanout, block_levels), schema)
