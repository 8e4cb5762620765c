"""Exact deduplication by Patricia tries over length-and-content-hash partitions.

Texts are equal when identical after each run of white space becomes one space. Map side, every partition
keeps one trie: full byte strings in compressed radix edges, terminals holding the smallest doc_id and the
count of rows, so a text reaches the shuffle once per partition however many copies there are. When a trie
outgrows its byte budget, its largest subtree is closed and its terminals leave as rows. Rows then meet by
(length, hash); the reduce side inserts each run of equal keys into a trie, whose terminals name the owners.

Defined cases: null text is the empty text; a null doc_id sorts after all others and a group of nulls keeps
null; rows that repeat the kept doc_id are all kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import squeeze

TRIE_BYTES = 48 << 20
_OWNER = pa.schema([("n_bytes", pa.int64()), ("sha", pa.string()), ("content", pa.binary()), ("low", pa.int64()), ("rows", pa.int64())])


class Node:
    __slots__ = ("edge", "kids", "low", "rows", "weight")

    def __init__(self, edge: bytes):
        self.edge, self.kids, self.low, self.rows, self.weight = edge, None, None, 0, len(edge)


class Patricia:
    """Compressed radix trie of byte strings; a terminal has rows > 0."""

    def __init__(self) -> None:
        self.root = Node(b"")
        self.bytes = 0

    def insert(self, key: bytes, low: int | None, rows: int = 1) -> None:
        node, at, path = self.root, 0, [self.root]
        added = 0
        while at < len(key):
            kid = node.kids.get(key[at]) if node.kids else None
            if kid is None:
                kid = Node(key[at:])
                node.kids = node.kids or {}
                node.kids[key[at]] = kid
                added, at = len(kid.edge), len(key)
            elif key.startswith(kid.edge, at):
                at += len(kid.edge)
            else:
                n = _common(kid.edge, key, at)
                upper = Node(kid.edge[:n])
                upper.kids, upper.weight = {kid.edge[n]: kid}, kid.weight
                kid.weight -= n
                kid.edge = kid.edge[n:]
                node.kids[key[at]] = upper
                kid, at = upper, at + n
            node = kid
            path.append(node)
        if added:
            self.bytes += added
            for p in path[:-1]:
                p.weight += added
        if low is not None and (node.low is None or low < node.low):
            node.low = low
        node.rows += rows

    def terminals(self, node: Node | None = None, head: bytes = b"") -> Iterator[tuple[bytes, int | None, int]]:
        todo = [(node or self.root, head)]
        while todo:
            n, before = todo.pop()
            full = before + n.edge
            if n.rows:
                yield full, n.low, n.rows
            if n.kids:
                todo.extend((k, full) for k in n.kids.values())

    def spill(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Close the heaviest subtree below the root and give its terminals."""
        first = max(self.root.kids, key=lambda b: self.root.kids[b].weight)
        kid = self.root.kids.pop(first)
        self.bytes -= kid.weight
        self.root.weight -= kid.weight
        yield from self.terminals(kid)


def _common(edge: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of edge and key[at:], by halving."""
    lo, hi = 0, min(len(edge), len(key) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if edge[lo:mid] == key[at + lo : at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _rows(terminals: Iterator[tuple[bytes, int | None, int]], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for content, low, rows in terminals:
        held.append({"n_bytes": len(content), "sha": hashlib.sha256(content).hexdigest(), "content": content, "low": low, "rows": rows})
        size += len(content)
        if size > limit or len(held) >= 4096:
            yield pa.RecordBatch.from_pylist(held, schema=_OWNER)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_OWNER)


def _local(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Patricia()
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                trie.insert(squeeze(text), doc)
                while trie.bytes > budget and trie.root.kids:
                    yield from _rows(trie.spill())
        yield from _rows(trie.terminals())

    return run


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (n_bytes, sha): one trie per run of equal keys."""
    out = pa.schema([("n_bytes", pa.int64()), ("sha", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
    trie, key = Patricia(), None
    for b in batches:
        held = []
        for n, sha, content, low, rows in zip(*(b.column(c).to_pylist() for c in ("n_bytes", "sha", "content", "low", "rows")), strict=True):
            if (n, sha) != key and key is not None:
                held += [(*key, t[1], t[2]) for t in trie.terminals()]
                trie = Patricia()
            key = (n, sha)
            trie.insert(content, low, rows)
        yield pa.RecordBatch.from_pylist([dict(zip(out.names, h, strict=True)) for h in held], schema=out)
    if key is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(out.names, (*key, t[1], t[2]), strict=True)) for t in trie.terminals()], schema=out)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [squeeze(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(k) for k in keys], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in keys], pa.string())], names=["doc_id", "n_bytes", "sha"])


def exact_groups(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """Every row of docs with keep_id, group_size, kept and text_sha256."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    local = rows.mapInArrow(_local(trie_bytes), "n_bytes long, sha string, content binary, low long, rows long")
    met = local.repartition("n_bytes", "sha").sortWithinPartitions("n_bytes", "sha")
    owners = met.mapInArrow(_owners, "n_bytes long, sha string, keep_id long, group_size long").where("group_size > 1")
    own = owners.select(F.col("n_bytes").alias("o_bytes"), F.col("sha").alias("o_sha"), "keep_id", "group_size")
    each = rows.mapInArrow(_digests, "doc_id long, n_bytes long, sha string")
    out = each.join(own, (F.col("n_bytes") == F.col("o_bytes")) & (F.col("sha") == F.col("o_sha")), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))
