"""MinHash near-dedup by tensored banding (operator 4).

U small collections of R minhashes each are computed once; a table stands for each pair of collections, and its
key combines the two. So U R minhashes make U (U - 1) / 2 tables, of keys as selective as 2 R minhashes. Two sets
share a key if two of the collections agree; U is the least number for which that fails for at most one pair of
MISSED at the threshold (13 collections of 2, or 78 tables, at 0.8).

Sets that are equal are one node. In each bucket every node is held against a leader, so candidates grow with the
number of rows, not with the square of a bucket. Nodes that one batch of a task has in a bucket are held against
the smallest of them there, and only that one goes on to the bucket, so that a bucket with a third of all nodes is
folded before anything is shuffled. Verified links make components. A bucket whose nodes are all in one component
needs no more. The others are dealt into cells: the component with most nodes in the bucket is its hub, the other
nodes are the outside, and each cell has a block of the outside beside a block of the hub or of the outside. Cells
have a bounded size and are spread over all tasks. In a cell minhashes tell which nodes of different components may
be similar, and each cell names them by groups, one row for a node. The groups are dealt into cells in the same way,
now with full sets, where links are verified and a spanning forest of them leaves each cell. So no link that could
join two components is left out, and neither the links inside a component nor the pairs of a group are listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, pieces_of, stored, utf8_view
from .components import components
from .shingles import minhashes, mix, set_digest, shingle_sets

#: Minhashes that only sift candidates; of all minhashes so many may agree less than a pair at the threshold has, in
#: standard deviations; a pair at the threshold shares no key once in so many cases.
SIFT, DEVIATIONS, MISSED = 64, 4.5, 20_000
CHUNK_BYTES, RUN_BLOCK = 1 << 20, 512
#: Nodes, and members of full sets, in a block of a cell, about.
CELL_NODES, CELL_MEMBERS = 1024, 1 << 15
#: Over so many keys a hot key is spread where rows are joined to what is known of their group.
SALTS = 32


@dataclass(frozen=True)
class Layout:
    """Collections, minhashes in each, and how many of all minhashes a pair must have in common."""

    collections: int
    each: int
    agree: int

    @staticmethod
    @lru_cache(maxsize=8)
    def of(percent: int) -> Layout:
        each = 2 if percent >= 80 else 1
        p = (percent / 100) ** each
        u = 2
        while p < 1 and (1 - p) ** u + u * p * (1 - p) ** (u - 1) > 1 / MISSED:
            u += 1
        n = u * each + SIFT
        mean, deviation = n * percent / 100, (n * percent / 100 * (1 - percent / 100)) ** 0.5
        return Layout(u, each, max(0, round(mean - DEVIATIONS * deviation)))

    @property
    def banded(self) -> int:
        return self.collections * self.each

    @property
    def count(self) -> int:
        """All minhashes."""
        return self.banded + SIFT

    def keys(self, mins: np.ndarray) -> Iterator[np.ndarray]:
        """For each table the keys of some rows of minhashes."""
        mins = mins.astype(np.uint64)
        small = []
        for c in range(self.collections):
            held = mins[:, c * self.each]
            for k in range(1, self.each):
                held = held << np.uint64(32) | mins[:, c * self.each + k]
            small.append(mix(held))
        pairs = [(i, j) for i in range(self.collections) for j in range(i + 1, self.collections)]
        for t, (i, j) in enumerate(pairs):
            yield mix(small[i] * np.uint64(0x9E3779B97F4A7C15) + small[j] + np.uint64(t + 1)).view(np.int64)


def _signatures(docs: DataFrame, key: str, text: str, words: int, layout: Layout) -> DataFrame:
    """row_key, n (set size), digest (null for empty sets), mins (of the tables) and marks (a byte of each minhash)
    of each row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, 1, CHUNK_BYTES):
                sets = shingle_sets(*utf8_view(part.column(1)), words)
                found = minhashes((s for s in sets if len(s)), layout.count)
                mins, marks = iter(np.ascontiguousarray(found[:, : layout.banded])), iter(found.astype(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(mins).tobytes() if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(marks).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["row_key", "n", "digest", "mins", "marks"],
                )

    return docs.select(key, text).mapInArrow(run, f"row_key {kind}, n long, digest binary, mins binary, marks binary")


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """Binary values of one width as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), width)


def _batch_keys(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each table of each batch (node, mins): the keys and nodes in order, and the place where each key begins."""
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column(0).to_numpy()
        mins = _bytes(batch.column(1), 4 * layout.banded).view(np.uint32)
        for key in layout.keys(mins):
            order = np.lexsort((node, key))
            key_, node_ = key[order], node[order]
            starts = np.concatenate([[True], key_[1:] != key_[:-1]])
            yield key_, node_, np.maximum.accumulate(np.where(starts, np.arange(len(key_)), 0))


def _leaders_of_batches(nodes: DataFrame, layout: Layout) -> DataFrame:
    """A row (key, node) for each table and each smallest node of a key in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, begin in _batch_keys(batches, layout):
            first = begin == np.arange(len(key))
            yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(node[first])], ["key", "node"])

    return nodes.select("node", "mins").mapInArrow(run, "key long, node long")


def _shared_in_batches(nodes: DataFrame, layout: Layout) -> DataFrame:
    """key, node and leader (the smallest node) of the keys that more than one node of a batch has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, begin in _batch_keys(batches, layout):
            many = np.bincount(begin, minlength=len(key))[begin] > 1
            if many.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[many]), pa.array(node[many]), pa.array(node[begin[many]])], ["key", "node", "leader"])

    return nodes.select("node", "mins").mapInArrow(run, "key long, node long, leader long")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and node: those of keys with more than one node, and their leader. One row is held back."""
    held: tuple[int, int, bool] | None = None  # key, leader and whether the leader's own row is out
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        starts = np.concatenate([[held is None or held[0] != key[0]], key[1:] != key[:-1]])
        run = np.maximum.accumulate(np.where(starts, np.arange(len(key)), -1))
        leader = np.where(run >= 0, node[run], held[1] if held else 0)
        follows = np.concatenate([~starts[1:], [False]])
        out = ~starts | follows
        if held and not starts[0] and not held[2]:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]]), pa.array([held[1]])], ["key", "node", "leader"])
        yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(node[out]), pa.array(leader[out])], ["key", "node", "leader"])
        held = (int(key[-1]), int(leader[-1]), bool(out[-1]))


def _sift(pairs: DataFrame, nodes: DataFrame, percent: int, layout: Layout) -> DataFrame:
    """Of pairs (a, b, ...) those whose sizes and minhashes let them be similar."""
    names = pairs.columns
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("_n"), F.col("marks").alias("_m"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("_k"), F.col("marks").alias("_l"))
    sized = pairs.join(left, "a").join(right, "b").filter(F.least("_n", "_k") * 100 >= F.greatest("_n", "_k") * percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = (_bytes(batch.column(0), layout.count) == _bytes(batch.column(1), layout.count)).sum(axis=1) >= layout.agree
                yield pa.RecordBatch.from_arrays([c for c in batch.columns[2:]], names).filter(pa.array(near))

    return sized.select("_m", "_l", *names).mapInArrow(run, pairs.schema)


def _sets(docs: DataFrame, wanted: DataFrame, text: str, words: int) -> DataFrame:
    """node and its set (hashes as bytes) for the wanted (digest, node). Sets are made again from the texts and come
    by their digests, whatever the keys of the rows; copies are folded in each batch, then in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()
            for part in pieces_of(batch, 0, CHUNK_BYTES):
                found = {set_digest(s): s for s in shingle_sets(*utf8_view(part.column(0)), words) if len(s)}
                new = {name: s.tobytes() for name, s in found.items() if name not in seen}
                seen.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), pa.array(list(new.values()), pa.binary())], ["digest", "members"])

    made = docs.select(text).mapInArrow(run, "digest binary, members binary").groupBy("digest").agg(F.first("members").alias("members"))
    return stored(made.join(wanted, "digest").select("node", "members"), "sets")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those that are similar on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                small, large = (x, y) if len(x) < len(y) else (y, x)
                both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = sets.select(F.col("node").alias("a"), F.col("members").alias("x")), sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _spread(rows: DataFrame, known: DataFrame, on: str, by: str) -> DataFrame:
    """rows joined to what is known of each value of a column (unique there), so that a hot value is SALTS keys. What is
    known is never broadcast: it grows with the input, and Spark judges its size without the SALTS rows of each value."""
    salted = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted, [on, "_salt"]).drop("_salt")


def _cells(rows: DataFrame, group: str, weight: str, limit: int) -> DataFrame:
    """rows (a group, node, component, a weight, ...) dealt into cells: i and j name a cell of the group, inner says
    that a row is of block j. Groups of one component have none.

    The component of the most weight in a group is its hub. Cell (i, j) has block i of the other rows beside block j;
    blocks of the hub are numbered after those of the other rows. So two rows of different components meet in one
    cell, in that of i = j if they are of one block, and rows of the hub are never held against each other."""
    per = rows.groupBy(group, "component").agg(F.sum(weight).alias("w"))
    stats = per.groupBy(group).agg(F.max(F.struct("w", "component")).alias("hub"), F.sum("w").alias("all"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    stats = stats.select(
        group,
        F.col("hub.component").alias("_hub"),
        F.ceil((F.col("all") - F.col("hub.w")) / limit).alias("_outer"),
        F.ceil(F.col("hub.w") / limit).alias("_inner"),
    )
    dealt = _spread(rows, stats, group, "node").withColumn("_of_hub", F.col("component") == F.col("_hub"))
    block = F.when(F.col("_of_hub"), F.col("_outer") + F.pmod(F.xxhash64("node"), "_inner")).otherwise(F.pmod(F.xxhash64("node"), "_outer"))
    beside = F.when(F.col("_of_hub"), F.col("_outer")).otherwise(F.col("_outer") + F.col("_inner"))
    dealt = dealt.withColumn("_block", block).withColumn("_beside", F.explode(F.sequence(F.lit(0).cast("long"), beside - 1)))
    dealt = dealt.withColumn("i", F.least("_block", "_beside")).withColumn("j", F.greatest("_block", "_beside")).withColumn("inner", (F.col("_block") == F.col("j")) & (F.col("i") != F.col("j")))
    return dealt.select(group, "i", "j", "inner", *(c for c in rows.columns if c != group))


def _by_cell(cells: DataFrame, group: str) -> DataFrame:
    return cells.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), group, "i", "j").sortWithinPartitions(group, "i", "j")


def _each_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that follow each other and agree in the first three columns, without these."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([batch.column(c).to_numpy() for c in range(3)])
        cuts = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            this = tuple(names[:, start].tolist())
            if held and this != name:
                yield pa.Table.from_batches(held)
                held = []
            name = this
            held.append(batch.slice(start, end - start).select(batch.schema.names[3:]))
    if held:
        yield pa.Table.from_batches(held)


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the smallest one that pairs (a, b) connect it to."""
    name = np.arange(n)
    while True:
        low = np.minimum(name[a], name[b])
        new = name.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == name).all():
            return name
        name = new


def _near_groups(batches: Iterator[pa.RecordBatch], percent: int, layout: Layout) -> Iterator[pa.RecordBatch]:
    """Cells of rows (inner, node, component, n, marks): group, node, component and n of the nodes that sizes and
    minhashes let be similar to one of another component in the cell. Nodes that are near each other, directly or by
    others, are one group, named by its smallest node."""
    for cell in _each_cell(batches):
        inner, node, component, n = (cell.column(c).to_numpy() for c in range(4))
        order = np.argsort(node, kind="stable")
        inner, node, component, n = inner[order], node[order], component[order], n[order]
        if component.min() == component.max():
            continue
        low = _bytes(cell.column(4).combine_chunks(), layout.count)[order]
        left, right = (np.flatnonzero(~inner), np.flatnonzero(inner)) if inner.any() else (np.arange(len(node)),) * 2
        found = [np.zeros((2, 0), dtype=np.int64)]
        for i in range(0, len(left), RUN_BLOCK):
            for j in range(0, len(right), RUN_BLOCK):
                p, q = left[i : i + RUN_BLOCK], right[j : j + RUN_BLOCK]
                fits = np.minimum(n[p][:, None], n[q]) * 100 >= np.maximum(n[p][:, None], n[q]) * percent
                x, y = np.nonzero((component[p][:, None] != component[q]) & fits)
                for k in range(0, len(x), 1 << 18):
                    u, v = p[x[k : k + (1 << 18)]], q[y[k : k + (1 << 18)]]
                    good = (low[u] == low[v]).sum(axis=1) >= layout.agree
                    found.append(np.stack([u[good], v[good]]))
        a, b = np.concatenate(found, axis=1)
        if not len(a):
            continue
        name, seen = _joined(len(node), a, b), np.unique(np.concatenate([a, b]))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[name[seen]], node[seen], component[seen], n[seen])], ["group", "node", "component", "n"])


def _verified_in_cells(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Cells of rows (inner, node, component, members): links (a, b) that connect the components of all nodes of
    different ones whose full sets are similar."""
    for cell in _each_cell(batches):
        inner, node, component = (cell.column(c).to_numpy() for c in range(3))
        names, of = np.unique(component, return_inverse=True)
        if len(names) < 2:
            continue
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in cell.column(3)]
        left, right = (np.flatnonzero(~inner), np.flatnonzero(inner)) if inner.any() else (np.arange(len(node)),) * 2
        sizes = np.array([len(sets[i]) for i in right])
        values, where = np.unique(np.concatenate([sets[i] for i in right]), return_inverse=True)
        order = np.argsort(where, kind="stable")
        owner = np.repeat(np.arange(len(right)), sizes)[order]
        first = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=len(values)))])
        links: list[tuple[int, int]] = []
        made = np.arange(len(names))  # what the components of the cell are joined to so far
        for i in left.tolist():
            wanted = made[of[right]] != made[of[i]]
            if not wanted.any():
                continue
            at = np.minimum(np.searchsorted(values, sets[i]), len(values) - 1)
            at = at[values[at] == sets[i]]
            counts = first[at + 1] - first[at]
            both = np.zeros(len(right), dtype=np.int64)
            ends = np.cumsum(counts)
            cuts = [0, *np.unique(np.searchsorted(ends, np.arange(1 << 22, int(ends[-1]) if len(ends) else 0, 1 << 22))).tolist(), len(at)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):  # a common member's owners are spelt out some at a time
                c = counts[x:y]
                each = np.repeat(first[at[x:y]], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                both += np.bincount(owner[each], minlength=len(right))
            good = np.flatnonzero(wanted & (100 * both >= percent * (len(sets[i]) + sizes - both)))
            for j in good.tolist():
                x, y = made[of[i]], made[of[right[j]]]
                if x != y:
                    links.append((int(node[i]), int(node[right[j]])))
                    made[made == max(x, y)] = min(x, y)
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, n_shingles, component_id and kept.

    Texts are sets of distinct shingles of so many words ([^\\x20\\x09-\\x0D]+, A-Z lower-cased); with fewer words
    the whole sequence is one shingle. Sets with a Jaccard similarity of percent / 100 or more are linked,
    component_id is the smallest key reachable and the row of that key stays. Null texts and texts without words
    have empty sets, are linked with nothing and stay. Null keys are ignored for component_id unless a component
    has no other. Repeated rows are links of their own; rows with the key that stays all stay. Texts are whole, in
    chunks of rows. The lower percent is, the more tables are made: 78 at 80, 190 at 50."""
    layout = Layout.of(percent)
    signed = stored(_signatures(docs, key, text, words, layout), "signatures")
    full = signed.filter("digest IS NOT NULL")
    firsts = full.groupBy("digest").agg(F.min("row_key").alias("rep"), *(F.first(c).alias(c) for c in ("n", "mins", "marks")))
    nodes = stored(firsts.withColumn("node", F.monotonically_increasing_id()), "nodes")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_keys = _leaders_of_batches(nodes, layout).repartition(partitions, "key").sortWithinPartitions("key", "node")
    shared = sorted_keys.mapInArrow(_shared, "key long, node long, leader long").unionByName(_shared_in_batches(nodes, layout))
    shared = stored(shared, "shared-keys")

    counted = shared.filter("node <> leader").groupBy(F.col("node").alias("a"), F.col("leader").alias("b")).agg(F.count(F.lit(1)).alias("tables"))
    sifted = stored(_sift(counted, nodes, percent, layout), "candidates")
    sets = _sets(docs, shared.select("node").distinct().join(nodes.select("node", "digest"), "node"), text, words)

    best = sifted.groupBy("a").agg(F.max_by("b", F.struct("tables", "b")).alias("b"))
    edges = stored(_verify(best, sets, percent), "links")
    groups = components(edges)

    def named(rows: DataFrame, column: str, out: str) -> DataFrame:
        """rows with the component of a node added; a node without links is its own."""
        found = groups.select(F.col("node").alias(column), F.col("component").alias(out))
        return rows.join(found, column, "left").withColumn(out, F.coalesce(out, column))

    rest = named(named(sifted.select("a", "b"), "a", "p"), "b", "q").filter("p <> q").select("a", "b")
    more = stored(_verify(rest, sets, percent), "links")
    edges = edges.unionByName(more)
    forget(sifted)
    groups = stored(components(edges), "components") if not more.isEmpty() else groups

    members = named(shared.select("key", "node"), "node", "component")
    mixed = members.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key")
    # of buckets that hold more than one component: all their nodes, once
    members = stored(_spread(members, mixed, "key", "node").groupBy("key", "node").agg(F.first("component").alias("component")), "members")
    forget(shared)
    cells = _cells(members.join(nodes.select("node", "n", "marks"), "node").withColumn("one", F.lit(1)), "key", "one", CELL_NODES)
    near = _by_cell(cells.select("key", "i", "j", "inner", "node", "component", "n", "marks"), "key")
    near = near.mapInArrow(lambda batches: _near_groups(batches, percent, layout), "group long, node long, component long, n long")
    near = stored(near.distinct(), "near")
    forget(members)
    if not near.isEmpty():
        cells = _cells(near, "group", "n", CELL_MEMBERS).select("group", "i", "j", "inner", "node", "component")
        cells = _by_cell(cells.join(sets, "node").select("group", "i", "j", "inner", "node", "component", "members"), "group")
        late = stored(cells.mapInArrow(lambda batches: _verified_in_cells(batches, percent), "a long, b long"), "links")
        if not late.isEmpty():
            groups = stored(components(edges.unionByName(late)), "components")
    forget(near)
    forget(sets)

    labelled = stored(named(nodes.select("node", "digest", "rep"), "node", "component"), "labelled")
    forget(nodes)
    smallest = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_node = labelled.join(smallest, "component").select("digest", "component_id")
    out = signed.select("row_key", "n", "digest").join(of_node, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("row_key")).otherwise(F.col("component_id"))
    return out.select(F.col("row_key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("row_key").eqNullSafe(component).alias("kept"))
