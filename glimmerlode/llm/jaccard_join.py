"""N-gram Jaccard join by count-vector R-trees, and the components of its links.

A document's set holds the hashes of its distinct word shingles (`shingles`); documents whose sets agree in a 128-bit
hash form one class. Tokens (shingles) are hashed into GROUPS groups and their counts are the class's point; the sum of
coordinate minima of two points bounds the overlap of their sets. R-trees over the points give the pairs whose bound
reaches the threshold, the parts of the sets in the first of the hash space refute most others, and exact sets verify the rest.

Trees need pairs to be near each other first. Two sets over the threshold share one of the tokens that come first in
any common order, so classes are keyed by those (prefix filter; tokens that a bitmap of fixed size marks as frequent
come last, which changes cost and not results). Keys that only one class has go, and of keys with the same classes one
is kept. Within a key every class is first held against the key's least class; keys whose classes then lie in one
component are done. The others are cut by size (similar sets lie in one size bin or in neighbouring ones) and into
blocks, and an R-tree per block gives the pairs of classes in different components that are left. No link between
components can be missed: every such pair that shares a key has been bounded and verified.

Sets travel once: texts are verified beside their lead, whose text is sent once for PAIRS of its partners.

Defined cases: null or blank text has no shingles, size 0 and is linked with nothing; texts under `width` words are
one shingle; very long texts are read whole, one piece each; rows that repeat are one class; a null doc_id takes part
but names no component (component_id is the least doc_id that is not null, null if there is none); empty tables give
empty results; other columns are ignored. The bitmap's counters stop at 65,535 a task, which can only leave a frequent
token in front.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import discard, fresh, materialize
from .shingles import shingle_sets

WIDTH, PERCENT = 4, 85
GROUPS = 64
BLOCK = 512
PAIRS = 256
FAN = 16
SKETCH_BITS = 19
CHUNKS = 64
ROWS = 512
WHOLE = 96
DENSE = 4
SPACE = 1 << 21
CELLS = 1 << 23
_SPREAD = np.uint64(0xA0761D6478BD642F)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            yield b.slice(lo, ROWS)


def count_vector(s: np.ndarray) -> np.ndarray:
    return np.bincount((s * _SPREAD >> np.uint64(58)).astype(np.int64), minlength=GROUPS).astype(np.uint32)


def level(n: np.ndarray) -> np.ndarray:
    """Of sets of n tokens, the part in the first 2**-level of the hash space stands for the set: all of a small one, an eighth of a large one."""
    return np.digitize(n, WHOLE * np.array([1, 2, 4]), right=True)


def _limit(lv: np.ndarray) -> np.ndarray:
    """The last hash of the first 2**-lv of the hash space."""
    return np.uint64((1 << 64) - 1) >> np.asarray(lv, np.uint64)


def part_of(s: np.ndarray) -> np.ndarray:
    return s[: np.searchsorted(s, _limit(level(len(s))), "right")]


def prefix(s: np.ndarray, hot: np.ndarray, percent: int) -> np.ndarray:
    """The first tokens in the order (frequent, hash): enough that similar sets share one."""
    n = len(s)
    take = n - (percent * n + 99) // 100 + 1
    at = (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
    often = (hot[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    rare = s[~often]
    return rare[:take] if len(rare) >= take else np.concatenate([rare, s[often][: take - len(rare)]])


def frequent_tokens(rows: DataFrame, width: int) -> bytes:
    """Bitmap of 2**SKETCH_BITS hash cells that hold far more tokens than the mean, over all rows. Its size is fixed."""
    cells = 1 << SKETCH_BITS
    out = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(cells, np.int64), [], 0
        for b in _sliced(batches):
            for s in shingle_sets(b.column("text").to_pylist(), width):
                held.append(s)
                size += len(s)
                if size >= cells:
                    total += np.bincount((np.concatenate(held) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=cells)
                    held, size = [], 0
        if size:
            total += np.bincount((np.concatenate(held) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=cells)
        small = np.minimum(total, 65535).astype(np.uint16)
        yield pa.RecordBatch.from_pylist([{"chunk": i, "counts": c.tobytes()} for i, c in enumerate(np.split(small, CHUNKS))], schema=out)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, d in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist(), strict=True):
                sums[c] = sums.get(c, 0) + np.frombuffer(d, np.uint16).astype(np.uint64)
        bits = [{"chunk": c, "counts": (np.packbits(v > 3 * v.mean() + 60, bitorder="little")).tobytes()} for c, v in sums.items()]
        yield pa.RecordBatch.from_pylist(bits, schema=out)

    schema = "chunk int, counts binary"
    bits = rows.select("text").mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema).collect()
    found = {r["chunk"]: bytes(r["counts"]) for r in bits}
    return b"".join(found.get(i, bytes(cells // CHUNKS // 8)) for i in range(CHUNKS))


def _class_hash(s: np.ndarray) -> tuple[int, int]:
    a = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
    return int(a[0]), int(a[1])


_FEATURES = "doc_id long, mark long, n long, h1 long, h2 long, vec binary, part binary, keys array<long>"


def _features(hot: bytes, width: int, percent: int):
    """Size, class hash, point and keys of every document; of a task's equal sets only the first has point and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, seen = np.frombuffer(hot, np.uint8), set()
        for b in _sliced(batches):
            sizes, ones, twos, vecs, parts, keys = [], [], [], [], [], []
            for s in shingle_sets(b.column("text").to_pylist(), width):
                h = _class_hash(s)
                new = len(s) > 0 and h not in seen
                if new:
                    seen.add(h)
                sizes.append(len(s))
                ones.append(h[0])
                twos.append(h[1])
                vecs.append(count_vector(s).tobytes() if new else None)
                parts.append(part_of(s).tobytes() if new else None)
                keys.append(prefix(s, bitmap, percent).view(np.int64) if new else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), *(pa.array(c, pa.int64()) for c in (sizes, ones, twos)), pa.array(vecs, pa.binary()), pa.array(parts, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "mark", "n", "h1", "h2", "vec", "part", "keys"])

    return run


class RTree:
    """Points packed level by level, FAN to a node, in order of size and then of their first coordinates."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.order = np.lexsort((points[:, 1], points[:, 0], sizes))
        level = points[self.order]
        size = sizes[self.order]
        self.levels = [(level, size, size)]
        while len(level) > FAN:
            starts = np.arange(0, len(level), FAN)
            level = np.maximum.reduceat(level, starts)
            low, high = np.minimum.reduceat(self.levels[-1][1], starts), np.maximum.reduceat(self.levels[-1][2], starts)
            self.levels.append((level, low, high))

    def join(self, points: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of queries and of points whose bound can reach the threshold; a few queries descend together."""
        out = [self._descend(np.arange(lo, min(lo + FAN, len(points))), points, sizes, percent) for lo in range(0, len(points), FAN)]
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def _descend(self, some: np.ndarray, points: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        top = len(self.levels[-1][0])
        q, at = np.repeat(some, top), np.tile(np.arange(top), len(some))
        for depth in range(len(self.levels) - 1, -1, -1):
            nodes, low, high = self.levels[depth]
            bound, size = np.minimum(nodes[at], points[q]).sum(1).astype(np.int64), sizes[q]
            # overlap >= percent of the union, for the node's least size; and sizes within the ratio
            fits = (bound * (100 + percent) >= percent * (size + np.maximum(low[at], bound if depth else low[at]))) & (100 * high[at] >= percent * size) & (100 * size >= percent * low[at])
            q, at = q[fits], at[fits]
            if depth:
                q, at = np.repeat(q, FAN), (at[:, None] * FAN + np.arange(FAN)).ravel()
                real = at < len(self.levels[depth - 1][0])
                q, at = q[real], at[real]
        return q, self.order[at]


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Common tokens of every two of a block's ascending sets, some ranges of the hash space and up to CELLS marks at a time."""
    total = np.zeros((len(sets), len(sets)), np.int64)
    steps = 1 + sum(map(len, sets)) // SPACE
    cuts = np.array([(k << 64) // steps for k in range(1, steps)], np.uint64)
    edges = [np.concatenate([[0], np.searchsorted(s, cuts), [len(s)]]) for s in sets]
    for k in range(steps):
        parts = [s[e[k] : e[k + 1]] for s, e in zip(sets, edges, strict=True)]
        of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        _, column, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        some = times[column] > 1
        row, slot = of[some], (np.cumsum(times > 1) - 1)[column[some]]
        shared, width = int((times > 1).sum()), max(1, CELLS // max(1, len(parts)))
        for lo in range(0, shared, width):
            now = (slot >= lo) & (slot < lo + width)
            held = np.zeros((len(parts), min(width, shared - lo)), np.float32)
            held[row[now], slot[now] - lo] = 1
            total += (held @ held.T).astype(np.int64)
    return total


def _forest(a: np.ndarray, b: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Marks of the links a-b that join what the links before them, and equal labels, leave apart."""
    up = {c: c for c in set(labels.tolist())}

    def top(c: int) -> int:
        while up[c] != c:
            up[c] = c = up[up[c]]
        return c

    out = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(labels[a].tolist(), labels[b].tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            up[x] = y
            out[i] = True
    return out


_PLACE = ("key", "bin", "i", "j")
_MEMBER = (*_PLACE, "own", "home", "cid", "comp", "n")
_FOUND = "key long, bin long, i int, j int, own int, home boolean, cid long, comp long, n long, a long, b long, sure boolean"


def _block_pairs(percent: int, column: str):
    """Rows sorted by _PLACE: what block i and block j have between components, guests only with those at home.

    With the points (`vec`), an R-tree gives the pairs that can reach the threshold. With the parts of the sets (`part`),
    pairs whose parts are whole sets are decided, and of the links only those are given that join components (sure).
    The others are likely: they are given as pairs, or, in a block that has more than DENSE for each of its members, as
    the members alone.
    """
    types = {"home": pa.bool_(), "sure": pa.bool_()} | dict.fromkeys(("i", "j", "own"), pa.int32())
    out = pa.schema([(c, types.get(c, pa.int64())) for c in (*_MEMBER, "a", "b", "sure")])
    cols = (*_MEMBER, column)
    none = pa.RecordBatch.from_pylist([], schema=out)

    def near(held: list[tuple], n: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if column == "vec":
            points = np.array([np.frombuffer(h[9], np.uint32) for h in held])
            x, y = RTree(points[right], n[right]).join(points[left], n[left], percent)
            return left[x], right[y], np.zeros(len(x), bool)
        parts = [np.frombuffer(h[9], np.uint64) for h in held]
        sizes = np.array([np.searchsorted(p, _limit(np.arange(4)), "right") for p in parts])
        x, y = np.repeat(left, len(right)), np.tile(right, len(left))
        lv = np.maximum(level(n)[x], level(n)[y])
        most = _overlaps(parts)[x, y] + np.minimum(n[x] - sizes[x, lv], n[y] - sizes[y, lv])
        fits = most * (100 + percent) >= percent * (n[x] + n[y])
        return x[fits], y[fits], lv[fits] == 0

    def pairs(held: list[tuple]) -> pa.RecordBatch:
        own, home, cid, comp, n = (np.array([h[k] for h in held]) for k in range(4, 9))
        left, right = np.flatnonzero(own == held[0][2]), np.flatnonzero(own == held[0][3])
        if not len(left) or not len(right) or len(set(comp.tolist())) < 2:
            return none
        x, y, sure = near(held, n, left, right)
        some = (comp[x] != comp[y]) & (home[x] | home[y]) & ((x < y) | (held[0][2] != held[0][3]))
        x, y, sure = x[some], y[some], sure[some]
        links, likely = np.flatnonzero(sure), np.flatnonzero(~sure)
        links = links[_forest(x[links], y[links], comp)]
        members = np.unique(np.concatenate([x[likely], y[likely]]))
        dense = len(likely) > DENSE * len(members)
        given = links if dense else np.concatenate([links, likely])
        a, b = cid[x[given]], cid[y[given]]
        rows = [{"a": p, "b": q, "sure": z} for p, q, z in zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), sure[given].tolist(), strict=True)]
        rows += [dict(zip(_MEMBER, held[m], strict=False)) for m in members.tolist()] if dense else []
        return pa.RecordBatch.from_pylist(rows, schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in cols), strict=True):
                if held and row[:4] != held[0][:4]:
                    yield pairs(held)
                    held = []
                held.append(row)
        if held:
            yield pairs(held)

    return run


def _dense_links(width: int, percent: int):
    """Rows sorted by _PLACE: links that join the components of a dense block's members, by their whole texts."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(place: tuple, held: list[tuple]) -> pa.RecordBatch:
        own, home, cid, comp = (np.array([h[k] for h in held]) for k in range(4))
        sets = [h[4] for h in held]
        n = np.array([len(s) for s in sets])
        fits = _overlaps(sets) * (100 + percent) >= percent * (n[:, None] + n)
        fits &= (comp[:, None] != comp) & (home[:, None] | home) & (own[:, None] == place[2]) & (own == place[3])
        x, y = np.nonzero(fits)
        keep = _forest(x, y, comp)
        return pa.RecordBatch.from_arrays([pa.array(cid[x[keep]]), pa.array(cid[y[keep]])], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []
        for b in _sliced(batches):
            rows = zip(*(b.column(c).to_pylist() for c in (*_PLACE, "own", "home", "cid", "comp")), strict=True)
            for row, s in zip(rows, shingle_sets(b.column("text").to_pylist(), width), strict=True):
                if held and row[:4] != place:
                    yield links(place, held)
                    held = []
                place = row[:4]
                held.append((*row[4:], s))
        if held:
            yield links(place, held)

    return run


def _refuted(percent: int):
    """Drop pairs that the parts of their sets alone keep under the threshold."""

    def tokens(column: pa.Array, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pair number and token as one ascending array, and how many each pair has under its limit."""
        held = column.to_pylist()
        pair = np.repeat(np.arange(len(held), dtype=np.uint64), [len(x) // 8 for x in held])
        flat = np.frombuffer(b"".join(held), np.uint64)
        inside = flat <= limit[pair]
        return pair[inside] << np.uint64(55) | flat[inside] >> np.uint64(9), np.bincount(pair[inside].astype(np.int64), minlength=len(held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            limit = _limit(np.maximum(level(na), level(nb)))
            (x, nx), (y, ny) = tokens(b.column("pa"), limit), tokens(b.column("pb"), limit)
            met = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)
            both = np.bincount((x[met] >> np.uint64(55)).astype(np.int64), minlength=b.num_rows)
            most = both + np.minimum(na - nx, nb - ny)
            yield b.select(["a", "b"]).filter(pa.array(most * (100 + percent) >= percent * (na + nb)))

    return run


def _bounded(percent: int):
    """Keep pairs whose points let them reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            m = [np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, GROUPS) for c in ("va", "vb")]
            bound = np.minimum(*m).sum(1).astype(np.int64)
            total = m[0].sum(1).astype(np.int64) + m[1].sum(1)
            yield b.select(["a", "b"]).filter(pa.array(bound * (100 + percent) >= percent * total))

    return run


def _verified(width: int, percent: int):
    """Rows sorted by (a, part, b): a's own text, without b, and then the texts of its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = np.zeros(0, np.uint64)
        for batch in _sliced(batches):
            keep = []
            for b, s in zip(batch.column("b").to_pylist(), shingle_sets(batch.column("text").to_pylist(), width), strict=True):
                if b is None:
                    lead = s
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate([lead, s]), kind="stable")
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * same >= percent * (len(both) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _own_text(width: int):
    """Of rows that share an id and a text hash, the ones whose text is the class's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            asked = zip(b.column("h1").to_pylist(), b.column("h2").to_pylist(), strict=True)
            own = [_class_hash(s) == h for s, h in zip(shingle_sets(b.column("text").to_pylist(), width), asked, strict=True)]
            yield b.select(["cid", "text"]).filter(pa.array(own, pa.bool_()))

    return run


def components(links: DataFrame) -> DataFrame:
    """(cid, comp) of every linked class: least label by hooking to neighbours and jumping pointers, until still."""
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = both.groupBy(F.col("a").alias("cid")).agg(F.min("b").alias("m")).select("cid", F.least("cid", "m").alias("comp"))
    label = materialize(label, "labels")
    while True:
        other = label.select(F.col("cid").alias("b"), F.col("comp").alias("other"))
        least = both.join(other, "b").groupBy(F.col("a").alias("cid")).agg(F.min("other").alias("near"))
        hooked = label.select("cid", "comp").join(least, "cid").select("cid", "comp", F.least("comp", "near").alias("new"))
        parent = hooked.select(F.col("cid").alias("p"), F.col("new").alias("up"))
        jumped = hooked.join(parent, F.col("new") == F.col("p"), "left")
        step = materialize(jumped.select("cid", F.col("comp").alias("old"), F.least("new", F.coalesce("up", "new")).alias("comp")), "labels")
        discard(label)
        if step.where("old <> comp").isEmpty():
            discard(both)
            return step.select("cid", "comp")
        label = step


class _Join:
    """The stored tables of one join: classes (cid, h1, h2, n, vec, part, low, pick) and keys (key, cid) that classes share."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.width, self.percent = width, percent
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.rows = rows.withColumn("mark", F.xxhash64("text"))
        hot = frequent_tokens(rows, width)
        found = materialize(self.rows.mapInArrow(_features(hot, width, percent), _FEATURES), "sets")
        self.docs = materialize(found.select("doc_id", "mark", "n", "h1", "h2"), "rows")
        per_class = found.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "mark")).alias("pick"), F.min("n").alias("n"), F.max("vec").alias("vec"), F.max("part").alias("part"))
        self.classes = materialize(per_class.withColumn("cid", F.monotonically_increasing_id()), "classes")
        keyed = found.where("keys is not null").select("h1", F.explode("keys").alias("key"))
        shared = materialize(keyed.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("key"), "shared-keys")
        met = keyed.join(shared, "key").distinct().join(self.classes.select("h1", "cid"), "h1").select("key", "cid")
        met = materialize(met, "met")
        discard(found, shared)
        # of keys with the same classes, one
        sets = met.groupBy("key").agg(F.count("*").alias("members"), F.min("cid").alias("lead"), F.bit_xor(F.xxhash64("cid")).alias("x1"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("x2"))
        one = sets.groupBy("members", "lead", "x1", "x2").agg(F.min("key").alias("key")).select("key", "lead")
        self.near = materialize(met.join(one, "key"), "near")
        discard(met)

    def texts(self, pairs: DataFrame) -> DataFrame:
        """(cid, text) of the classes in pairs."""
        some = pairs.select(F.explode(F.array("a", "b")).alias("cid")).where("cid is not null").distinct()
        wanted = some.join(self.classes.select("cid", "h1", "h2", "pick"), "cid")
        wanted = wanted.select("cid", "h1", "h2", F.col("pick.doc_id").alias("w_id"), F.col("pick.mark").alias("w_mark"))
        found = self.rows.join(wanted, (F.col("mark") == F.col("w_mark")) & F.col("doc_id").eqNullSafe(F.col("w_id")))
        found = found.select("cid", "h1", "h2", "text").mapInArrow(_own_text(self.width), "cid long, text string")
        return materialize(found.dropDuplicates(["cid"]), "texts")

    def beside(self, pairs: DataFrame, column: str) -> DataFrame:
        """Pairs of sizes within the ratio, with a column of both classes."""
        first, second = (self.classes.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col(column).alias(f"{column[0]}{x}")) for x in ("a", "b"))
        fits = (F.col("na") * 100 >= F.col("nb") * self.percent) & (F.col("nb") * 100 >= F.col("na") * self.percent)
        return pairs.join(first, "a").join(second, "b").where(fits)

    def bound(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose points let them reach the threshold."""
        return self.beside(pairs, "vec").select("a", "b", "va", "vb").mapInArrow(_bounded(self.percent), "a long, b long")

    def verify(self, pairs: DataFrame, label: str) -> DataFrame:
        """The pairs whose sets reach the threshold: first by their parts, then by all words."""
        sure = materialize(self.beside(pairs, "part").mapInArrow(_refuted(self.percent), "a long, b long"), "likely")
        texts = self.texts(sure)
        parts = sure.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).alias("parts"))
        dealt = sure.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), "b")
        own = dealt.select("a", "part").distinct().join(texts.withColumnRenamed("cid", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
        partners = dealt.join(texts.withColumnRenamed("cid", "b"), "b").select("a", "part", "b", "text")
        beside = own.unionByName(partners).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
        out = materialize(beside.select("a", "b", "text").mapInArrow(_verified(self.width, self.percent), "a long, b long"), label)
        discard(sure, texts)
        return out

    def open_pairs(self, label: DataFrame) -> DataFrame:
        """Links, likely links and members of dense blocks, between classes of different components that share a key."""
        tagged = self.near.join(label, "cid", "left").select("key", "cid", F.coalesce("comp", "cid").alias("comp"))
        spread = tagged.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
        left = tagged.join(spread, "key").join(self.classes.select("cid", "n"), "cid")
        # a little wider than the ratio, so that rounding cannot put similar sizes two bins apart
        at = F.floor(F.log(F.col("n")) / F.lit(math.log(100 / self.percent) * (1 + 1e-9)))
        left = left.withColumn("where", F.explode(F.array(F.struct(at.alias("bin"), F.lit(True).alias("home")), F.struct((at + 1).alias("bin"), F.lit(False).alias("home"))))).select("key", "where.*", "cid", "comp", "n")
        left = materialize(left, "open-keys")
        # of groups with the same members, one; none without two components and a member at home
        marks = [F.bit_xor(F.xxhash64("cid", "home", F.lit(k))).alias(f"x{k}") for k in (0, 1)]
        groups = left.groupBy("key", "bin").agg(F.count("*").alias("members"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("home").alias("home"), *marks)
        one = groups.where("lo <> hi and home").groupBy("members", "x0", "x1").agg(F.min(F.struct("key", "bin")).alias("at")).select("at.*", "members")
        blocks = F.ceil(F.col("members") / BLOCK).cast("int")
        dealt = left.join(one, ["key", "bin"]).withColumn("own", F.pmod(F.xxhash64("cid"), blocks).cast("int"))
        dealt = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), blocks - 1)))
        dealt = dealt.select("key", "bin", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "own", "home", "cid", "comp", "n")
        out = self.blocks(dealt, "vec")
        discard(left)
        return out

    def blocks(self, members: DataFrame, column: str) -> DataFrame:
        """Stored pairs and members of dense blocks that _block_pairs finds with a column of the classes."""
        rows = members.join(self.classes.select("cid", column), "cid").repartition(*_PLACE).sortWithinPartitions(*_PLACE)
        return materialize(rows.mapInArrow(_block_pairs(self.percent, column), _FOUND), "blocks")

    def tiled(self, found: DataFrame) -> DataFrame:
        """The members of dense blocks, dealt anew where that sends fewer rows.

        Dense blocks of different keys often hold much the same classes. Blocks that share classes, directly or through
        others, form a cluster; a cluster's classes cut into tiles of every two BLOCKs hold each pair of its blocks once,
        so it is dealt in tiles if these have fewer members than its blocks have. Other clusters keep their blocks.
        """
        members = found.where("cid is not null").select(*_MEMBER)
        lead = members.groupBy(*_PLACE).agg(F.min("cid").alias("a"))
        named = components(members.join(lead, list(_PLACE)).where("a <> cid").select("a", F.col("cid").alias("b")).distinct()).withColumnRenamed("comp", "cluster")
        per_class = members.groupBy("cid").agg(F.count("*").alias("places"), F.min("comp").alias("comp"), F.min("n").alias("n")).join(named, "cid")
        sizes = per_class.groupBy("cluster").agg(F.sum("places").alias("places"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("classes"))
        sizes = sizes.select("cluster", "blocks", (F.col("classes") * F.col("blocks") < F.col("places")).alias("fewer"))
        per_class = materialize(per_class.join(sizes, "cluster"), "clusters")
        tiles = per_class.where("fewer").withColumn("own", F.pmod(F.xxhash64("cid"), "blocks").cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        tiles = tiles.select(F.col("cluster").alias("key"), F.lit(-1).cast("long").alias("bin"), F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "own", F.lit(True).alias("home"), "cid", "comp", "n")
        rest = members.join(per_class.where("fewer").select("cid"), "cid", "left_anti").select(*_MEMBER)
        out = materialize(tiles.unionByName(rest), "tiles")
        discard(per_class)
        return out

    def more_links(self, label: DataFrame) -> DataFrame:
        """Links that join the components of `label` wherever any link does."""
        by_point = self.open_pairs(label)
        dense = self.tiled(by_point)
        by_part = self.blocks(dense, "part")
        found = by_point.unionByName(by_part)
        likely = self.verify(found.where("not sure").select("a", "b").distinct(), "links-2")
        members = by_part.where("cid is not null").select(*_MEMBER)
        texts = self.texts(members.select(F.col("cid").alias("a"), F.lit(None).cast("long").alias("b")))
        found = members.join(texts, "cid").repartition(*_PLACE).sortWithinPartitions(*_PLACE)
        found = found.mapInArrow(_dense_links(self.width, self.percent), "a long, b long")
        out = materialize(likely.unionByName(by_part.where("sure").select("a", "b")).unionByName(found).distinct(), "links-3")
        discard(by_point, dense, by_part, likely, texts)
        return out

    def labels(self) -> DataFrame:
        """(cid, comp) of every class that is linked."""
        first = self.verify(self.bound(self.near.where("cid <> lead").select(F.col("lead").alias("a"), F.col("cid").alias("b")).distinct()), "links-1")
        label = components(first)
        second = self.more_links(label)
        if not second.isEmpty():
            label = components(first.unionByName(second))
        discard(first, second, self.near)
        return label

    def components(self) -> DataFrame:
        """Every row: doc_id, mark, n and h1, h2 of its class, and comp, low and pick of its component (null without words)."""
        named = self.classes.select("cid", "h1", "h2", "low", "pick").join(self.labels(), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        least = named.groupBy("comp").agg(F.min("low").alias("component"), F.min(F.struct(F.col("pick.doc_id").isNull().alias("nameless"), "pick")).alias("first"))
        names = named.select("h1", "h2", "comp").join(least, "comp").select("h1", "h2", "component", F.col("first.pick").alias("first"))
        return self.docs.join(names, ["h1", "h2"], "left")


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Every row of docs: doc_id, n_shingles, component_id."""
    out = _Join(docs, width, percent).components()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, the one with the least id; rows without words are all kept.

    Of rows that repeat id and text one stays. Columns of any name pass through.
    """
    out = _Join(docs, width, percent).components().select("doc_id", "mark", "n", "first")
    stays = (F.col("n") == 0) | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark")))
    keep = materialize(out.where(stays).groupBy("doc_id", "mark").agg(F.count("*").alias("rows")), "kept")
    names = [fresh(docs, c) for c in ("keep_id", "keep_mark")]
    ids = keep.select(F.col("doc_id").alias(names[0]), F.col("mark").alias(names[1]))
    left = docs.join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col(names[0])) & (F.xxhash64(F.col("text").cast("string")) == F.col(names[1])), "left_semi")
    return left if keep.where("rows > 1").isEmpty() else left.dropDuplicates(["doc_id", "text"])
