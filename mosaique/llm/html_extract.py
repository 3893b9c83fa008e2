"""Main text of web pages by what the pages of a host repeat (operator 6).

Pages are scanned into blocks, and the token streams of a host's pages are searched for runs of RUN or more tokens
that stand on two or more distinct pages: on a small host by a suffix array over the concatenated streams, on a
large one by hashes of the runs, shuffled by host and run. A token lies in such a repeat, however long, just when
it lies in one of exactly RUN tokens, so suffixes are sorted to that depth: equal ones then lie side by side. Blocks
or parts of blocks covered by repeats are boilerplate; the unique runs between them stay. That text stands in an
article or main element is a hint: it is content wherever it is reprinted, so it stays and is not searched.
Elements for menus, notices, adverts, forms or comments are never main text, but are searched as all else is, so
that a notice in such an element on one page is known in a plain one on another.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import Block, blocks

#: Tokens in a long run (a power of two), and pages of a host that are held together, about; results do not depend
#: on the latter.
RUN, PAGES = 8, 256
#: Groups of pages whose runs share a bucket, and groups that one task works on, about.
GROUPS_PER_BUCKET, GROUPS_PER_TASK = 16, 8
#: Hosts with more than PAGES pages that may be broadcast, at most; beyond it they are joined.
BROADCAST_HOSTS = 50_000


def repeated(streams: list[list[str]], run: int = RUN) -> list[np.ndarray]:
    """For each stream a mask of its tokens that lie in runs of so many tokens found in two or more distinct
    streams. Equal streams count as one page."""
    first: dict[tuple, int] = {}
    page_of = [first.setdefault(tuple(s), len(first)) for s in streams]
    numbers: dict[str, int] = {}
    tokens, pages = [], []
    for s, page in zip(streams, page_of, strict=True):
        tokens += [numbers.setdefault(t, len(numbers)) for t in s]
        tokens.append(-1)
        pages += [page] * (len(s) + 1)
    rank, page = np.array(tokens, dtype=np.int64), np.array(pages, dtype=np.int64)
    ends = np.flatnonzero(rank < 0)
    rank[ends] = len(numbers) + np.arange(len(ends))  # an end is like no other, so no run crosses it
    depth = 1
    while depth < run:
        later = np.concatenate([rank[depth:], np.full(min(depth, len(rank)), -1)])[: len(rank)]
        rank = np.unique(rank * (len(rank) + len(numbers) + 2) + later + 1, return_inverse=True)[1]
        depth *= 2
    suffixes = np.argsort(rank, kind="stable")
    ordered, owner = rank[suffixes], page[suffixes]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    covered = np.zeros(len(rank) + 1, dtype=np.int64)
    if len(starts):
        many = np.maximum.reduceat(owner, starts) != np.minimum.reduceat(owner, starts)
        at = suffixes[np.repeat(many, np.diff(np.append(starts, len(ordered))))]
        np.add.at(covered, at, 1)
        np.subtract.at(covered, np.minimum(at + run, len(rank)), 1)
    mask, begin, out = np.cumsum(covered[:-1]) > 0, 0, []
    for s in streams:
        out.append(mask[begin : begin + len(s)])
        begin += len(s) + 1
    return out


def _whole_runs(mask: np.ndarray, run: int = RUN) -> np.ndarray:
    """A block's covered stretches that are long runs themselves or the whole block; the end of a run that reaches
    in from the block beside is the block's own."""
    if mask.all():
        return mask
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    out = np.zeros(len(mask), dtype=bool)
    for start, end in edges.reshape(-1, 2).tolist():
        out[start:end] = end - start >= run
    return out


def main_texts(parsed: list[list[Block]], masks: list[np.ndarray] | None = None) -> list[str]:
    """The main text of each of some pages of one host; masks as of `repeated` over the streams of these pages."""
    masks = repeated([_stream(page) for page in parsed]) if masks is None else masks
    out = []
    for page, mask in zip(parsed, masks, strict=True):
        kept, at = [], 0
        for block in page:
            if block.main and not block.noise:
                kept.append(block.text)
                continue
            tokens = block.text.split(" ")
            covered = mask[at : at + len(tokens)]
            at += len(tokens)
            if block.noise:
                continue
            unique = ~_whole_runs(covered)
            if unique.all():
                kept.append(block.text)
            elif unique.any():
                kept.append(" ".join(t for t, u in zip(tokens, unique.tolist(), strict=True) if u))
        out.append(" ".join(kept))
    return out


def _stream(page: list[Block]) -> list[str]:
    """The tokens that are searched: all outside main text."""
    return [t for b in page if b.noise or not b.main for t in b.text.split(" ")]


def _packed(page: list[Block]) -> bytes:
    return zlib.compress("\n".join(f"{b.main + 2 * b.noise}{b.text}" for b in page).encode(), 1)


def _unpacked(data: bytes) -> list[Block]:
    text = zlib.decompress(data).decode()
    return [Block(x[1:], x[0] in "13", x[0] in "23") for x in text.split("\n")] if text else []


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


class _Runs:
    """Hashes of the runs of some pages of a host, alike in every process, and which pages they stand on."""

    def __init__(self, parsed: list[list[Block]]):
        streams = [_stream(page) for page in parsed]
        known = {t: _digest(t.encode()) for t in set().union(*streams)}
        numbers = [np.array([known[t] for t in s], dtype=np.uint64) for s in streams]
        self.lengths = [len(s) for s in streams]
        self.of = [self._hashes(x) for x in numbers]
        # equal streams count as one page; 0 is kept for more than one
        pages = [_digest(x.tobytes()) | 1 for x in numbers]
        runs = np.concatenate([*self.of, np.zeros(0, np.uint64)])
        owners = np.repeat(np.array(pages, dtype=np.uint64), [len(x) for x in self.of])
        self.runs, self.owners = _owned(runs, owners)

    @staticmethod
    def _hashes(tokens: np.ndarray) -> np.ndarray:
        h, n = np.zeros(max(0, len(tokens) - RUN + 1), dtype=np.uint64), max(0, len(tokens) - RUN + 1)
        for i in range(RUN):
            h = h * np.uint64(0x9E3779B97F4A7C15) + tokens[i : i + n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def masks(self, repeats: np.ndarray) -> list[np.ndarray]:
        """A mask as of `repeated` for each page, by the runs that stand on two pages of these or are in repeats."""
        repeats = np.union1d(repeats, self.runs[self.owners == 0])
        found, begin, out = np.isin(np.concatenate([*self.of, np.zeros(0, np.uint64)]), repeats), 0, []
        for n, runs in zip(self.lengths, self.of, strict=True):
            at, covered = np.flatnonzero(found[begin : begin + len(runs)]), np.zeros(n + 1, dtype=np.int64)
            begin += len(runs)
            np.add.at(covered, at, 1)
            np.subtract.at(covered, at + RUN, 1)
            out.append(np.cumsum(covered[:-1]) > 0)
        return out


def _owned(runs: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs in order, and of each the page it stands on, 0 for more than one."""
    if not len(runs):
        return runs, owners
    order = np.argsort(runs, kind="stable")
    runs, owners = runs[order], owners[order]
    starts = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
    low, high = np.minimum.reduceat(owners, starts), np.maximum.reduceat(owners, starts)
    return runs[starts], np.where(low == high, low, np.uint64(0))


def _bits(arrays: int) -> int:
    """Leading bits of a run's hash that are looked at first: about one in a hundred is then like another by chance."""
    return min(63, 23 + arrays.bit_length())


def _steps(values: np.ndarray) -> bytes:
    """Ascending numbers as compressed planes of the bytes of their steps."""
    return zlib.compress(np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unsteps(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _named(owners: np.ndarray) -> bytes:
    """Owners as a list of the distinct ones and their numbers in it."""
    names, at = np.unique(owners, return_inverse=True)
    return np.uint64(len(names)).tobytes() + names.tobytes() + zlib.compress(at.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unnamed(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, dtype=np.uint64, count=1)[0])
    planes = np.frombuffer(zlib.decompress(data[8 + 8 * n :]), dtype=np.uint8).reshape(4, -1)
    return np.frombuffer(data, dtype=np.uint64, count=n, offset=8)[np.ascontiguousarray(planes.T).view("<u4").ravel()]


def _dealt(table: pa.Table, values: np.ndarray, tops: np.ndarray, owners: np.ndarray | None) -> pa.Table:
    """A group's ascending values as rows of buckets; tops are their leading 32 bits."""
    host, salt, arrays = (table.column(c)[0].as_py() for c in ("host", "salt", "arrays"))
    buckets = -(-arrays // GROUPS_PER_BUCKET)
    of = (tops * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64))
    rows = [(host, b, salt, _steps(values[i:j]), None if owners is None else _named(owners[i:j])) for b, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if j > i]
    return _rows(rows, BUCKETS)


BUCKETS = [("host", pa.string()), ("bucket", pa.int64()), ("salt", pa.int64()), ("runs", pa.binary()), ("owners", pa.binary())]
SHARED = [("host", pa.string()), ("salt", pa.int64()), ("runs", pa.binary())]


def _rows(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(schema)], [name for name, _ in schema])


def _shared(table: pa.Table) -> pa.Table:
    """Of a bucket's runs, for each group those that stand in another group too; with owners, on another page."""
    runs = [_unsteps(x) for x in table.column("runs").to_pylist()]
    values = np.concatenate(runs)
    owned = table.column("owners").to_pylist()
    if owned[0] is None:
        owners = np.repeat(np.arange(1, len(runs) + 1, dtype=np.uint64), [len(x) for x in runs])
    else:
        owners = np.concatenate([_unnamed(x) for x in owned])
    distinct, owner = _owned(values, owners)
    repeats, host = distinct[owner == 0], table.column("host")[0].as_py()
    mine = [(salt, x[np.isin(x, repeats)]) for salt, x in zip(table.column("salt").to_pylist(), runs, strict=True)]
    return _rows([(host, salt, x.tobytes()) for salt, x in mine if len(x)], SHARED)


def _sent(table: pa.Table) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(table.column("runs").to_pylist()), dtype=np.uint64))


def _pages(table: pa.Table) -> list[list[Block]]:
    return [_unpacked(x) for x in table.column("packed").to_pylist()]


def _large(table: pa.Table) -> bool:
    return bool(table.num_rows) and table.column("arrays")[0].as_py() > 1


def _first_look(table: pa.Table) -> pa.Table:
    """The leading bits of a group's runs; nothing for a host that is one group."""
    if not _large(table):
        return _rows([], BUCKETS)
    bits = _bits(table.column("arrays")[0].as_py())
    slots = np.unique(_Runs(_pages(table)).runs >> np.uint64(64 - bits))
    return _dealt(table, slots, slots >> np.uint64(bits - 32) if bits >= 32 else slots << np.uint64(32 - bits), None)


def _second_look(table: pa.Table, slots: pa.Table) -> pa.Table:
    """The group's whole hashes of runs whose leading bits another group has too, and their pages."""
    if not _large(table) or not slots.num_rows:
        return _rows([], BUCKETS)
    found, bits = _Runs(_pages(table)), _bits(table.column("arrays")[0].as_py())
    maybe = np.isin(found.runs >> np.uint64(64 - bits), _sent(slots))
    runs = found.runs[maybe]
    return _dealt(table, runs, runs >> np.uint64(32), found.owners[maybe])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: the key, url, text (empty if none) and n_chars.

    A null page is empty; pages without a host, or with a url that is none, are one host. Repeated rows each have
    their row, and a page's copies do not make it boilerplate. Hosts with more than PAGES pages are dealt by a
    hash of key and page to groups of about PAGES pages, so that no task holds a large host. Their repeats are found
    over the whole host all the same: the leading bits of each group's run hashes meet in buckets of the host, those
    seen in two groups are looked at again by 64-bit hashes and distinct pages, and come back to their groups."""
    host = F.coalesce(F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))), F.lit(""))
    rows = pages.select(F.col(key).alias("row_key"), F.col(url).cast("string").alias("row_url"), F.coalesce(F.col(html), F.lit("")).alias("page"), host.alias("host"))
    hosts = rows.groupBy("host").count()
    large = hosts.filter(F.col("count") > PAGES).select("host", F.ceil(F.col("count") / PAGES).alias("arrays"))
    sized = hosts.agg(F.count_if(F.col("count") > PAGES).alias("large"), F.coalesce(F.sum("count"), F.lit(0)).alias("pages")).first()
    number, spark = sized["large"], pages.sparkSession
    rows = rows.join(F.broadcast(large) if number <= BROADCAST_HOSTS else large, "host", "left").withColumn("arrays", F.coalesce("arrays", F.lit(1)))
    rows = rows.select("row_key", "row_url", "host", "arrays", F.pmod(F.xxhash64("row_key", "row_url"), "arrays").alias("salt"), "page")
    kind = pages.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array([_packed(blocks(x)) for x in batch.column(5).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], packed], ["row_key", "row_url", "host", "arrays", "salt", "packed"])

    def texts(group: pa.Table, shared: pa.Table | None = None) -> pa.Table:
        if not group.num_rows:
            return pa.table([group.column("row_key"), group.column("row_url"), pa.array([], pa.string()), pa.array([], pa.int64())], ["row_key", "row_url", "text", "n_chars"])
        parsed = _pages(group)
        found = main_texts(parsed, _Runs(parsed).masks(_sent(shared)) if _large(group) else None)
        return pa.table([group.column("row_key"), group.column("row_url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["row_key", "row_url", "text", "n_chars"])

    # a task's share stays the same however many pages there are
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sized["pages"] // (PAGES * GROUPS_PER_TASK)))

    def dealt(df: DataFrame, *by: str):
        return df.repartition(tasks, *by).groupBy(*by)

    groups = dealt(rows.mapInArrow(scan, f"row_key {kind}, row_url string, host string, arrays long, salt long, packed binary"), "host", "salt")
    schema = f"row_key {kind}, row_url string, text string, n_chars long"
    if number:
        buckets, shared = "host string, bucket long, salt long, runs binary, owners binary", "host string, salt long, runs binary"
        slots = dealt(groups.applyInArrow(lambda t: _first_look(t), buckets), "host", "bucket").applyInArrow(lambda t: _shared(t), shared)
        runs = groups.cogroup(dealt(slots, "host", "salt")).applyInArrow(lambda t, s: _second_look(t, s), buckets)
        repeats = dealt(runs, "host", "bucket").applyInArrow(lambda t: _shared(t), shared)
        out = groups.cogroup(dealt(repeats, "host", "salt")).applyInArrow(lambda t, s: texts(t, s), schema)
    else:
        out = groups.applyInArrow(lambda t: texts(t), schema)
    return out.withColumnsRenamed({"row_key": key, "row_url": url})
