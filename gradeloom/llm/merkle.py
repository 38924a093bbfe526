"""A Merkle tree over the rows of a table, per group and then over the groups, with proofs.

Leaves are numbered within their group without gathering it: range-sorted partitions count
their rows, and only those counts are summed up. A builder takes an aligned block of
``3**HEIGHT`` consecutive leaves and appends each node to its log when it is complete, a parent
right after its last child, so the log is in postorder. The roots of the blocks are the leaves
of the next tier, until one node per group remains; the groups' roots make up the last tree.

Where a node stands in a postorder log follows from its level and index alone: before it stand
all complete subtrees up to its last leaf. A proof is extracted by computing the places of the
siblings in the block's log and adding the path of the block's root from the tier above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.shared import stored

ARITY, HEIGHT = 3, 6
BLOCK = ARITY ** HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_KINDS = {"string": pa.string(), "long": pa.int64(), "bigint": pa.int64()}


def _parent(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def height_of(n: int) -> int:
    """Levels above the leaves until a single node remains."""
    height = 0
    while ARITY ** height < n:
        height += 1
    return height


def position(level: int, index: int, n: int, height: int) -> int:
    """The place of a node in the postorder log of a tree of ``n`` leaves and ``height`` levels.

    Up to its own level, all nodes with leaves up to this node's last one are written before;
    of higher levels, those that are complete one leaf earlier. A full subtree keeps its place
    when leaves are appended.
    """
    last = min((index + 1) * ARITY ** level, n)
    return (sum(-(-last // ARITY ** k) for k in range(level + 1))
            + sum((last - 1) // ARITY ** k for k in range(level + 1, height + 1)) - 1)


def postorder(leaves: list[str], height: int) -> list[str]:
    """The log of one builder: every node of ``height`` levels over ``leaves``, as it is completed."""
    log: list[str] = []
    open_runs: list[list[str]] = [[] for _ in range(height)]

    def complete(level: int, digest: str) -> None:
        log.append(digest)
        if level < height:
            run = open_runs[level]
            run.append(digest)
            if len(run) == ARITY:
                open_runs[level] = []
                complete(level + 1, _parent(run))

    for leaf in leaves:
        complete(0, leaf)
    for level in range(height):
        if run := open_runs[level]:
            open_runs[level] = []
            complete(level + 1, _parent(run))
    return log


def paths(log: list[str], n: int, height: int, above: str) -> list[str]:
    """For each leaf of a log its siblings, ``left|right;`` per level, followed by the path ``above`` its root."""
    found = [above]
    for level in range(height - 1, -1, -1):
        width = -(-n // ARITY ** level)
        below = []
        for first in range(0, width, ARITY):
            run = [log[position(level, j, n, height)] for j in range(first, min(first + ARITY, width))]
            upper = found[first // ARITY]
            below += ["".join(run[:k]) + "|" + "".join(run[k + 1:]) + ";" + upper for k in range(len(run))]
        found = below
    return found


def fold(leaf: str, path: str) -> str:
    """The root that follows from a leaf and its path."""
    for level in path.split(";")[:-1]:
        left, right = level.split("|")
        leaf = _parent([left, leaf, right])
    return leaf


def _field(value: Column) -> Column:
    written = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(written).cast("string"), F.lit(":"), written), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    """The leaf of a row whose text is ``text``."""
    columns = [F.col(c).cast("long") if c in ("doc_id", "n_chars") else F.col(c).cast("string") for c in FIELDS[:-1]]
    return F.sha2(F.concat(*map(_field, [*columns, text.cast("string")])), 256)


def leaves(docs: DataFrame, *more: Column) -> DataFrame:
    """(key, doc_id, digest, ...): ``key`` keeps the order of sources, null first."""
    return docs.select(_group_key(F.col("source")).alias("key"), F.col("doc_id").cast("long"),
                       leaf_digest(F.col("text")).alias("digest"), *more)


def _group_key(group: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their 0-based ``index`` within ``key`` by ``order``, and the key's ``n`` rows."""
    kept = rows.columns
    keys = [F.asc("key"), *(F.asc_nulls_first(c) for c in order)]
    placed = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    # A row per partition and key; within a partition the rows of a key follow each other.
    counts = placed.groupBy("key", part).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    key = Window.partitionBy("key")
    before = key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("key", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                            F.sum("rows").over(key).alias("n"))
    return placed.withColumn("part", part).join(offsets, ["key", "part"]).select(
        *kept, (F.col("at") + F.col("shift")).alias("index"), "n")


@dataclass
class Tree:
    """The tiers of logs from the leaves up, and (key, root) of every key."""

    tiers: list[DataFrame]
    roots: DataFrame


def _build(rows: DataFrame, tier: int) -> DataFrame:
    """Logs (key, n, block, root, log) of aligned blocks of (key, n, index, digest); other columns become lists."""
    extra = [c for c in rows.columns if c not in ("key", "n", "index", "digest")]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = "key string, n long, block long, root string, log array<string>" + "".join(
        f", {c} array<{types[c]}>" for c in extra)
    base = HEIGHT * tier

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("index")
        n = table.column("n")[0].as_py()
        log = postorder(table.column("digest").to_pylist(), min(HEIGHT, height_of(n) - base))
        columns = {"key": table.column("key")[:1], "n": table.column("n")[:1], "block": table.column("block")[:1],
                   "root": pa.array([log[-1]]), "log": pa.array([log])}
        for c in extra:
            values = table.column(c).combine_chunks()
            columns[c] = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.table(columns)
    return rows.withColumn("block", F.expr(f"index div {BLOCK}")).groupBy("key", "block").applyInArrow(run, schema)


def build(rows: DataFrame) -> Tree:
    """The trees of (key, n, index, digest), one per key; further columns stay beside their leaves."""
    tiers = [stored(_build(rows, 0))]
    most = tiers[0].agg(F.max("n")).first()[0] or 0
    while most > ARITY ** (HEIGHT * len(tiers)):
        below = tiers[-1].where(F.col("n") > ARITY ** (HEIGHT * len(tiers))).select(
            "key", "n", F.col("block").alias("index"), F.col("root").alias("digest"))
        tiers.append(stored(_build(below, len(tiers))))
    roots = None
    for t, tier in enumerate(tiers):
        alone = tier.where(F.col("n") <= ARITY ** (HEIGHT * (t + 1))).select("key", "root")
        roots = alone if roots is None else roots.unionAll(alone)
    return Tree(tiers, roots)


def _spread(tier: int, schema: str, extra: list[str]):
    """Per leaf of a log: its path, with the columns ``extra`` of the log and of its lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {c.split()[0]: _KINDS[c.split()[1]] for c in schema.split(", ")}
        for batch in batches:
            for row in batch.to_pylist():
                log, n = row["log"], row["n"]
                height = min(HEIGHT, height_of(n) - HEIGHT * tier)
                width = min(-(-n // BLOCK ** tier) - row["block"] * BLOCK, BLOCK)
                found = paths(log, width, height, row["above"])
                columns = {"key": [row["key"]] * width, "index": [row["block"] * BLOCK + i for i in range(width)], "path": found,
                           "leaf": [log[position(0, i, width, height)] for i in range(width)]}
                columns |= {c: row[c] if isinstance(row[c], list) else [row[c]] * width for c in extra}
                yield pa.RecordBatch.from_arrays([pa.array(columns[c], k) for c, k in kinds.items()], list(kinds))
    return run


def proofs(tree: Tree, above: DataFrame, extra: str = "") -> DataFrame:
    """(key, index, leaf, path) of every leaf, with further columns ``extra`` ("name type, ...").

    ``above`` has (key, above): the path of each key's root, and perhaps columns of ``extra``;
    the other columns of ``extra`` are those that were beside the leaves.
    """
    top = above
    passed = [c for c in above.columns if c not in ("key", "above")]
    for t in range(len(tree.tiers) - 1, -1, -1):
        single = F.col("n") <= ARITY ** (HEIGHT * (t + 1))
        tier = tree.tiers[t]
        if t == len(tree.tiers) - 1:
            joined = tier.join(top, "key")
        else:
            upper = reached.select("key", F.col("index").alias("block"), F.col("path").alias("above"), *passed)
            joined = tier.where(single).join(top, "key").unionByName(tier.where(~single).join(upper, ["key", "block"]))
        types = dict(above.dtypes)
        here = ", ".join(["key string", "index long", "leaf string", "path string", *(f"{c} {types[c]}" for c in passed)])
        if t == 0 and extra:
            here = f"{here}, {extra}"
        names = [c.split()[0] for c in here.split(", ")][4:]
        reached = joined.mapInArrow(_spread(t, here, names), here)
    return reached


def log_nodes(tree: Tree) -> DataFrame:
    """(key, position, level, index, digest): each node once, at its place in its key's whole postorder log."""
    found = None
    for t, tier in enumerate(tree.tiers):
        def run(batches: Iterator[pa.RecordBatch], t: int = t) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    n, log, block = row["n"], row["log"], row["block"]
                    whole = height_of(n)
                    height = min(HEIGHT, whole - HEIGHT * t)
                    width = min(-(-n // BLOCK ** t) - block * BLOCK, BLOCK)
                    rows = []
                    # The leaves of a higher tier were written as roots of the tier below.
                    for level in range(1 if t else 0, height + 1):
                        for j in range(-(-width // ARITY ** level)):
                            index = block * ARITY ** (HEIGHT - level) + j
                            rows.append((row["key"], position(HEIGHT * t + level, index, n, whole), HEIGHT * t + level,
                                         index, log[position(level, j, width, height)]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c) for c in zip(*rows, strict=True)], ["key", "position", "level", "index", "digest"])
        nodes = tier.select("key", "n", "block", "log").mapInArrow(
            run, "key string, position long, level long, index long, digest string")
        found = nodes if found is None else found.unionAll(nodes)
    return found


@dataclass
class Manifest:
    """The trees of the groups, the tree over their roots, and its root (None if there is no row)."""

    groups: Tree
    top: Tree
    root: str | None


def manifest(rows: DataFrame) -> Manifest:
    """Trees over (key, doc_id, digest), leaves by doc_id, null first, and equal ones by digest."""
    groups = build(numbered(rows, ["doc_id", "digest"]))
    roots = stored(groups.roots)
    top = build(numbered(roots.select(F.lit("").alias("key"), F.col("key").alias("name"), F.col("root").alias("digest")), ["name"]))
    found = top.roots.first()
    return Manifest(Tree(groups.tiers, roots), top, found.root if found else None)


def audited(docs: DataFrame, tampered_text: Column, tampered_where: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``docs`` has the columns of ``FIELDS``, perhaps more. Rows of ``tampered_where`` (a null
    counts as false) are folded up from a leaf with ``tampered_text`` and the original siblings,
    the others from their own leaf; ``verified`` tells whether the root comes out. Nulls have a
    form of their own in a leaf, so null and empty values differ. Repeated rows are leaves of
    their own, next to each other; equal ones may change places. An empty table gives no rows.
    """
    changed = F.when(F.coalesce(tampered_where, F.lit(False)) & ~tampered_text.eqNullSafe(F.col("text")),
                     leaf_digest(tampered_text))
    made = manifest(stored(leaves(docs, changed.alias("changed"))))
    names = proofs(made.top, made.top.roots.select("key", F.lit("").alias("above")), "name string").select(
        F.col("name").alias("key"), F.col("path").alias("above"), F.col("leaf").alias("subroot"))
    found = proofs(made.groups, names, "doc_id long, changed string")
    root = made.root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop = str.maketrans("", "", "|;")
        for batch in batches:
            path, leaf = batch.column("path").to_pylist(), batch.column("leaf").to_pylist()
            changed = batch.column("changed").to_pylist()
            folded = [fold(c or x, p) for c, x, p in zip(changed, leaf, path, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("leaf"), batch.column("subroot"), pa.array([root] * len(leaf), pa.string()),
                 pa.array([hashlib.sha256(p.translate(drop).encode()).hexdigest() for p in path], pa.string()),
                 pa.array(folded, pa.string()), pa.array([f == root for f in folded], pa.bool_())],
                ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
    return found.mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
                                 "folded_root string, verified boolean")
