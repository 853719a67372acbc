"""Exact dedup by Patricia-trie owners.

Rows go to partitions by length and content hash; every partition inserts the
full byte strings into a compressed radix trie whose terminals hold the owner
(smallest or largest identifier) and the number of copies.

Two levels keep hot groups harmless: each input task folds its own rows into
small tries first, so a text reaches the shuffle once for a task, however many
copies exist.  Behind the shuffle the rows arrive sorted by (length, hash): a
finished subtree is emitted and dropped as soon as the resident bytes pass
``SUBTREE_BYTES``.  Rows waiting for their subtree live in Spark's external
sorter, which spills them; nothing is kept per group in a task or the driver.

Nulls count as empty texts; ties and repeated rows count towards the group; rows
with a null id never own a text, and are kept only where all of the group are
such; an empty table gives an empty result and extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import text_or_empty
from symloom.llm.worker import lean

#: Bytes of text that a task's trie holds before its finished subtrees are emitted.
SUBTREE_BYTES = 16 << 20

_FOLDED = "n_bytes long, digest binary, body binary, owner long, copies long"
_OWNED = "n_bytes long, digest binary, owner long, copies long"


class RadixTrie:
    """A compressed radix trie over byte strings.

    A node is ``[label, children, owner, copies]``; ``copies`` is 0 where no string ends.
    """

    def __init__(self, largest: bool = False):
        self.pick = max if largest else min
        self.root: list = [b"", {}, None, 0]
        self.resident = 0

    def insert(self, key: bytes, owner: int, copies: int = 1) -> None:
        node, at, end = self.root, 0, len(key)
        while at < end:
            child = node[1].get(key[at])
            if child is None:
                child = [key[at:], {}, None, 0]
                node[1][key[at]] = child
                self.resident += end - at + 200
                node, at = child, end
                break
            label = child[0]
            if not key.startswith(label, at):
                child = self._split(node, child, key, at)
                label = child[0]
            node, at = child, at + len(label)
        if node[2] is None or owner is None:
            node[2] = owner if node[2] is None else node[2]
        else:
            node[2] = self.pick(node[2], owner)
        node[3] += copies

    @staticmethod
    def _split(parent: list, child: list, key: bytes, at: int) -> list:
        label, low, high = child[0], 1, min(len(child[0]), len(key) - at)
        while low < high:  # the longest shared prefix has at least one byte
            middle = (low + high + 1) // 2
            if key.startswith(label[:middle], at):
                low = middle
            else:
                high = middle - 1
        upper = [label[:low], {label[low]: child}, None, 0]
        child[0] = label[low:]
        parent[1][key[at]] = upper
        return upper

    def terminals(self) -> Iterator[tuple[bytes, int, int]]:
        """(string, owner, copies) of every string, without recursion."""
        stack = [(self.root, b"")]
        while stack:
            node, before = stack.pop()
            here = before + node[0] if node[0] else before
            if node[3]:
                yield here, node[2], node[3]
            stack.extend((c, here) for c in node[1].values())


def _rows(trie: RadixTrie, with_body: bool) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    held = 0
    for body, owner, copies in trie.terminals():
        rows.append((len(body), hashlib.sha256(body).digest(), body, owner, copies))
        held += len(body)
        if held > 4 << 20 or len(rows) >= 8192:
            yield _batch(rows, with_body)
            rows, held = [], 0
    if rows:
        yield _batch(rows, with_body)


def _batch(rows: list[tuple], with_body: bool) -> pa.RecordBatch:
    n, digest, body, owner, copies = zip(*rows, strict=True)
    columns = [("n_bytes", pa.array(n, pa.int64())), ("digest", pa.array(digest, pa.binary()))]
    columns += [("body", pa.array(body, pa.binary()))] if with_body else []
    columns += [("owner", pa.array(owner, pa.int64())), ("copies", pa.array(copies, pa.int64()))]
    return pa.RecordBatch.from_arrays([c for _, c in columns], names=[k for k, _ in columns])


def _fold(largest: bool, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RadixTrie(largest)
        for batch in batches:
            ids, bodies = batch.column(0).to_pylist(), batch.column(1)
            for owner, body in zip(ids, bodies, strict=True):
                trie.insert(body.as_buffer().to_pybytes() if body.is_valid else b"", owner)
                if trie.resident > budget:
                    yield from _rows(trie, True)
                    trie = RadixTrie(largest)
        yield from _rows(trie, True)

    return run


def _own(largest: bool, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last = RadixTrie(largest), None
        for batch in batches:
            columns = (batch.column(k).to_pylist() for k in ("n_bytes", "digest", "body", "owner", "copies"))
            for n, digest, body, owner, copies in zip(*columns, strict=True):
                if trie.resident > budget and last != (n, digest):
                    yield from _rows(trie, False)
                    trie = RadixTrie(largest)
                last = (n, digest)
                trie.insert(body, owner, copies)
        yield from _rows(trie, False)

    return run


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", subtree_bytes: int = SUBTREE_BYTES) -> DataFrame:
    """One row for each distinct text: n_bytes, digest (SHA-256), owner, copies."""
    largest = {"smallest": False, "largest": True}[keep]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(text_or_empty(text_col), "utf-8").alias("body"))
    folded = rows.mapInArrow(lean(_fold(largest, subtree_bytes)), _FOLDED)
    dealt = folded.repartition("n_bytes", "digest").sortWithinPartitions("n_bytes", "digest")
    return dealt.mapInArrow(lean(_own(largest, subtree_bytes)), _OWNED)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", subtree_bytes: int = SUBTREE_BYTES) -> DataFrame:
    """One row for each document: id, keep_id, group_size, kept, text_sha256."""
    body = F.encode(text_or_empty(text_col), "utf-8")
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(body, 256)).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes"))
    owned = owners(docs, id_col, text_col, keep, subtree_bytes)
    return keyed.join(owned, ["digest", "n_bytes"], "left").select(
        F.col("id").alias(id_col), F.col("owner").alias("keep_id"), F.col("copies").alias("group_size"),
        F.coalesce(F.col("id") == F.col("owner"), F.col("owner").isNull()).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
