"""A Merkle manifest of a table: one tree for each group, one tree over the groups' roots.

A row's leaf is the SHA-256 of its fields.  The leaves of a group ascend by id;
every ``fanout`` consecutive nodes become their hash (the last run may be
shorter, it is neither padded nor lifted unhashed) until one node is left.

Leaves are numbered within their group by a range sort and prefix sums over its
partitions, and cut into indexed partitions of ``RUN`` numbers.  Each of them is
pushed through a mountain-range stack: a completed run of siblings is carried to
the next level and gives a node record; what has siblings in another indexed
partition stays on the stack as a peak.  Only peaks travel on: rounds of blocks,
aligned at powers of the fanout and ``STEP`` levels apart, merge them by the
same stack, and tell every peak its siblings up to the root of its block.  The
siblings of a leaf are those within its indexed partition, then those of its peak.

No group is held in one task: an indexed partition has at most ``RUN`` leaves and
a block at most the peaks of ``fanout ** STEP`` times the span below.  Groups may
be of any number, as their roots go through the same steps.

A null field is hashed as ``-``, apart from the empty text.  Null groups come
first, null ids first in their group, rows with equal ids by their leaf; equal
rows are leaves of their own.  An empty table has no rows.  Columns that are not
named are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from symloom.llm.common import broadcast_if_small, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3
#: Leaves of an indexed partition.  Not a power of the fanout: its edges need not be aligned.
RUN = 2048
#: Levels between two rounds of merging.
STEP = 5

_NODE = "grp string, level int, number long, digest string, run long, total long, peak boolean"
_MERGED = "grp string, level int, number long, digest string, total long, path string, root_level int, root_number long, kind string"
_PLACED = "grp string, path string, top string"


def digest_of(parts: Sequence[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


@dataclass(slots=True, eq=False)
class Node:
    """A node of a tree; ``left`` and ``right`` are the digests of its siblings once it has a parent."""

    level: int
    number: int
    digest: str
    parent: Node | None = None
    left: str = ""
    right: str = ""

    def path(self) -> list[tuple[str, str]]:
        """(left, right) siblings, level by level, as far as the tree is known."""
        found, node = [], self
        while node.parent is not None:
            found.append((node.left, node.right))
            node = node.parent
        return found

    def top(self) -> Node:
        node = self
        while node.parent is not None:
            node = node.parent
        return node


class Mountains:
    """The stack of nodes whose siblings are still to come, for a tree over ``total`` leaves.

    Nodes come in ascending order.  A node that is the last of its run takes the
    run off the stack if all of it is there; a run whose begin lies elsewhere stays.
    """

    def __init__(self, total: int, fanout: int = FANOUT, highest: int | None = None):
        self.fanout, self.peaks, self.made = fanout, [], []
        self.widths = [total]
        while self.widths[-1] > 1 and (highest is None or len(self.widths) <= highest):
            self.widths.append(-(-self.widths[-1] // fanout))

    def push(self, node: Node) -> Node:
        self.peaks.append(node)
        last = node
        while last.level + 1 < len(self.widths):
            begin = last.number - last.number % self.fanout
            if last.number != min(begin + self.fanout, self.widths[last.level]) - 1:
                break
            run = self.peaks[begin - last.number - 1 :]
            if len(run) != last.number - begin + 1 or (run[0].level, run[0].number) != (last.level, begin):
                break
            digests = [n.digest for n in run]
            last = Node(last.level + 1, begin // self.fanout, digest_of(digests))
            for k, child in enumerate(run):
                child.parent, child.left, child.right = last, "".join(digests[:k]), "".join(digests[k + 1 :])
            self.peaks[-len(run) :] = [last]
            self.made.append(last)
        return node


def encode_path(path: Sequence[tuple[str, str]]) -> str:
    return "/".join(f"{left}|{right}" for left, right in path)


def decode_path(path: str) -> list[tuple[str, str]]:
    return [tuple(level.split("|")) for level in path.split("/")] if path else []


def folded(leaf: str, path: Sequence[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings lead to."""
    return reduce(lambda digest, level: digest_of((level[0], digest, level[1])), path, leaf)


def leaf_of(fields: Sequence[str | Column]) -> Column:
    """The hash of a row: for each field its count of bytes, a colon and the value, or ``-`` for null."""

    def framed(field: str | Column) -> Column:
        value = (F.col(field) if isinstance(field, str) else field).cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*[framed(f) for f in fields]).cast("binary"), 256)


def _columns(table: pa.Table, *names: str) -> zip:
    return zip(*[table.column(n).to_pylist() for n in names], strict=True)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def _grown(table: pa.Table, fanout: int) -> tuple[Mountains, list[Node], list[int]]:
    """The stack of an indexed partition, its leaves in order, and the rows they come from."""
    numbers, digests = table.column("number").to_pylist(), table.column("leaf").to_pylist()
    order = sorted(range(len(numbers)), key=numbers.__getitem__)
    stack = Mountains(table.column("total")[0].as_py(), fanout)
    return stack, [stack.push(Node(0, numbers[i], digests[i])) for i in order], order


def _records(fanout: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        stack, _, _ = _grown(table, fanout)
        group, number, total = (table.column(c)[0].as_py() for c in ("grp", "run", "total"))
        peaks = {id(n) for n in stack.peaks}
        inner = [n for n in stack.made if id(n) not in peaks]
        return _table([(group, n.level, n.number, n.digest, number, total, id(n) in peaks) for n in stack.peaks + inner], _schema(_NODE))

    return run


def _merge(fanout: int, highest: int) -> Callable[[pa.Table], pa.Table]:
    """Merge the peaks of a block up to ``highest``: a row for each peak with its siblings, each new node, and the block's root."""

    def run(table: pa.Table) -> pa.Table:
        group, total = table.column("grp")[0].as_py(), table.column("total")[0].as_py()
        nodes = [Node(*row) for row in _columns(table, "level", "number", "digest")]
        nodes.sort(key=lambda n: n.number * fanout**n.level)
        stack = Mountains(total, fanout, highest)
        for node in nodes:
            stack.push(node)
        rows = []
        for node in nodes:
            top = node.top()
            rows.append((group, node.level, node.number, node.digest, total, encode_path(node.path()), top.level, top.number, "peak"))
        rows += [(group, n.level, n.number, n.digest, total, None, None, None, "node") for n in stack.made]
        rows += [(group, n.level, n.number, n.digest, total, None, None, None, "root") for n in stack.peaks]
        return _table(rows, _schema(_MERGED))

    return run


@dataclass
class Forest:
    """Trees over numbered leaves.

    ``leaves`` (grp, number, run, total and the given columns), ``nodes`` (grp, level,
    number, digest of all nodes above the leaves), ``peaks`` (grp, run, level, number,
    path to the group's root), ``roots`` (grp, digest, total).
    """

    leaves: DataFrame
    nodes: DataFrame
    peaks: DataFrame
    roots: DataFrame
    fanout: int


def numbered(rows: DataFrame, order: Sequence[str], run: int) -> DataFrame:
    """``rows`` with number and run within ``grp``, in the order given, and the group's total.

    One range sort; only counts of (group, partition) are summed up.
    """
    keys = ["grp", *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = written(dealt.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "merkle-sorted")
    counts = dealt.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    group = W.partitionBy("grp")
    before = F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = written(counts.select("grp", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(group).alias("total")), "merkle-starts")
    widest = starts.agg(F.coalesce(F.max(F.octet_length("grp")), F.lit(0)).alias("w")).first().w
    placed = dealt.join(broadcast_if_small(starts, starts.count(), widest + 64), ["grp", "part"])
    number = F.col("place") + F.col("shift")
    return placed.withColumn("number", number).withColumn("run", F.expr(f"number div {run}")).drop("part", "place", "shift")


def grow(rows: DataFrame, order: Sequence[str], run: int = RUN, fanout: int = FANOUT, step: int = STEP) -> Forest:
    """Trees over ``rows`` (grp, leaf and more), one for each ``grp``."""
    leaves = written(numbered(rows, order, run), "merkle-leaves")
    nodes = written(leaves.select("grp", "leaf", "number", "run", "total").groupBy("grp", "run").applyInArrow(_records(fanout), _NODE), "merkle-nodes")
    most = leaves.agg(F.coalesce(F.max("total"), F.lit(0)).alias("n")).first().n
    height = 1
    while fanout**height < run:
        height += 1
    rounds: list[DataFrame] = []
    waiting = nodes.where("peak").select("grp", "level", "number", "digest", "total")
    while True:
        height += step
        block = F.expr(f"(number * CAST(power({fanout}, level) AS BIGINT)) div {fanout**height}")
        merged = written(waiting.withColumn("block", block).groupBy("grp", "block").applyInArrow(_merge(fanout, height), _MERGED), "merkle-merged")
        rounds.append(merged)
        if fanout**height >= most:
            break
        waiting = merged.where((F.col("kind") == "root") & (F.col("total") > F.lit(fanout**height))).select("grp", "level", "number", "digest", "total")
    kept = [nodes.where("level > 0"), *[m.where(F.col("kind") == "node") for m in rounds]]
    records = reduce(DataFrame.unionByName, [n.select("grp", "level", "number", "digest") for n in kept])
    return Forest(leaves, records, _paths(nodes, rounds), _roots(rounds), fanout)


def _roots(rounds: list[DataFrame]) -> DataFrame:
    """The root of a group is that of the first block that holds all of it."""
    found = [m.where((F.col("kind") == "root") & (F.col("number") == 0)).select("grp", "digest", "total", F.lit(k).alias("round")) for k, m in enumerate(rounds)]
    return reduce(DataFrame.unionByName, found).groupBy("grp").agg(F.max_by("digest", "round").alias("digest"), F.first("total").alias("total"))


def _paths(nodes: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """(grp, run, level, number, path) of the peaks of the indexed partitions, from the last round down."""
    later: DataFrame | None = None
    for merged in reversed(rounds):
        own = merged.where(F.col("kind") == "peak").select("grp", "level", "number", "path", "root_level", "root_number")
        if later is not None:
            above = later.select("grp", F.col("level").alias("root_level"), F.col("number").alias("root_number"), F.col("path").alias("rest"))
            joined = F.concat_ws("/", *[F.when(F.col(c) != "", F.col(c)) for c in ("path", "rest")])
            own = own.join(above, ["grp", "root_level", "root_number"], "left").withColumn("path", joined)
        later = own.select("grp", "level", "number", "path")
    return nodes.where("peak").select("grp", "run", "level", "number").join(later, ["grp", "level", "number"])


def _whole_paths(fanout: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For every leaf (a group's root) its siblings up to the root of all."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row, _, _, path in _climbed(left, right, fanout):
            root = folded(left.column("leaf")[row].as_py(), path)
            rows.append((left.column("name")[row].as_py(), encode_path(path), root))
        return _table(rows, _schema(_PLACED))

    return run


def _climbed(left: pa.Table, right: pa.Table, fanout: int):
    """(row, leaf, upper path text, whole path) of the leaves of an indexed partition; ``right`` has its peaks."""
    if not left.num_rows:
        return
    above = {(level, number): (path, decode_path(path)) for level, number, path in _columns(right, "level", "number", "path")}
    _, leaves, order = _grown(left, fanout)
    for row, leaf in zip(order, leaves, strict=True):
        top = leaf.top()
        text, rest = above[top.level, top.number]
        yield row, leaf, text, leaf.path() + rest


def _proofs(fanout: int, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows:
            ids, changed = left.column("id").to_pylist(), left.column("changed").to_pylist()
            subroot, root = (right.column(c)[0].as_py() for c in ("subroot", "root"))
            for row, leaf, _, path in _climbed(left, right, fanout):
                reached = folded(changed[row], path)
                proof = digest_of([x for level in path for x in level])
                rows.append((ids[row], leaf.digest, subroot, root, proof, reached, reached == root))
        return _table(rows, schema)

    return run


@dataclass
class Manifest:
    """``leaves`` and ``nodes`` of the groups' trees, ``roots`` (grp, digest, total), ``tops`` (grp, path and root above a group)."""

    forest: Forest
    tops: DataFrame

    @property
    def nodes(self) -> DataFrame:
        return self.forest.nodes


def group_key(column: str) -> Column:
    """A text that sorts as the column does, nulls first, and is never null."""
    return F.coalesce(F.concat(F.lit("+"), F.col(column).cast("string")), F.lit(""))


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: Sequence[str] = FIELDS, changed: Column | None = None, run: int = RUN, fanout: int = FANOUT, step: int = STEP) -> Manifest:
    """The trees of a table; ``changed`` is another leaf for each row, to be folded in ``proofs``."""
    leaf = leaf_of(fields)
    rows = docs.select(group_key(group_col).alias("grp"), F.col(id_col).cast("long").alias("id"), leaf.alias("leaf"), (leaf if changed is None else changed).alias("changed"))
    forest = grow(written(rows, "merkle-rows"), ["id", "leaf"], run, fanout, step)
    names = forest.roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("digest").alias("leaf"))
    above = grow(written(names, "merkle-roots"), ["name"], run, fanout, step)
    placed = above.leaves.groupBy("grp", "run").cogroup(above.peaks.groupBy("grp", "run")).applyInArrow(_whole_paths(fanout), _PLACED)
    return Manifest(forest, written(placed, "merkle-tops"))


def proofs(made: Manifest, id_col: str = "doc_id") -> DataFrame:
    """For each row: id, leaf, subroot, root, proof_sha256, folded_root (of the changed leaf), verified."""
    forest, schema = made.forest, _schema("id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    tops = made.tops.join(forest.roots.select("grp", F.col("digest").alias("subroot")), "grp").select("grp", "subroot", F.col("top").alias("root"), F.col("path").alias("rest"))
    joined = F.concat_ws("/", *[F.when(F.col(c) != "", F.col(c)) for c in ("path", "rest")])
    peaks = forest.peaks.join(tops, "grp").select("grp", "run", "level", "number", joined.alias("path"), "subroot", "root")
    leaves = forest.leaves.select("grp", "run", "id", "leaf", "changed", "number", "total")
    found = leaves.groupBy("grp", "run").cogroup(peaks.groupBy("grp", "run")).applyInArrow(_proofs(forest.fanout, schema), "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return found.withColumnRenamed("id", id_col)


def tampered_leaf(id_col: str = "doc_id", text_col: str = "text", fields: Sequence[str] = FIELDS) -> Column:
    """The leaf of a row whose text lost its line breaks where 2 divides the CRC-32 of the decimal id, else its own."""
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    cut = F.when(hit, F.replace(F.col(text_col), F.lit("\n"), F.lit(""))).otherwise(F.col(text_col))
    return leaf_of([cut if f == text_col else f for f in fields])
