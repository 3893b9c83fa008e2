"""Benchmark decontamination by the q-gram lemma (operator 1).

A benchmark item is cut into overlapping windows; equal windows, of one item or of many, are one. If a window of m
bytes occurs in a document with at most k edits, the two share at least m + 1 - q (k + 1) q-grams, and these lie on
diagonals that differ by at most k. So hits are counted in diagonal bands of width 2 (k + 1), each overlapping the
next by half; bands that reach the bound are verified by a banded alignment. Both sides are compared as lower-case
words with single spaces. Items too short for that are looked up whole, word for word.

Hits are counted in slices of a text's positions: counts of bands that later positions can still add to are carried
on, the others are settled. A window found without edits is not looked for again in the text, so a text or an item
that repeats itself costs little more than another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of, stored, utf8_view

#: Bytes in a q-gram, in a window, between windows; one edit is allowed for each so many bytes of a window. A copied
#: part of an item surely holds a whole window from WINDOW + STRIDE - 1 bytes on.
Q, WINDOW, STRIDE, BYTES_PER_EDIT = 12, 80, 40, 20
#: Items of fewer bytes are found by an exact match of their words.
LEAST_BYTES = 24
#: Text of one block of the benchmark that is sent to the executors, at most; further blocks take further passes.
BLOCK_BYTES, CHUNK_BYTES, FILTER_BITS = 8 << 20, 4 << 20, 22
#: Hits of a slice, and windows that may cover one place of an item.
SLICE_HITS, COVER = 1 << 19, (WINDOW - Q) // STRIDE + 2


def _table() -> np.ndarray:
    table = np.full(256, 32, dtype=np.uint8)
    for b in range(256):
        if b >= 128 or chr(b).isalnum():
            table[b] = b + 32 if 65 <= b <= 90 else b
    return table


_WORDS = _table()


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as lower-case words (ASCII and Latin-1 letters) with one space between; a space ends each text."""
    padded = np.insert(data, offsets[1:], 32)
    offsets = offsets + np.arange(len(offsets))
    text = _WORDS[padded]
    if len(text) > 1:
        accent = np.flatnonzero(text[:-1] == 0xC3) + 1
        upper = accent[(text[accent] >= 0x80) & (text[accent] <= 0x9E) & (text[accent] != 0x97)]
        text[upper] += 0x20
    keep = text != 32
    keep[1:] |= text[:-1] != 32
    starts = offsets[:-1]
    keep[starts] = text[starts] != 32
    at = np.concatenate([[0], np.cumsum(keep)])
    return text[keep], at[offsets]


def hashes(text: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the q-gram at each position."""
    if len(text) < Q:
        return np.zeros(0, dtype=np.uint32)
    r = 0x01000193
    h1 = text.astype(np.uint32) + np.uint32(1)
    h2 = h1[:-1] * np.uint32(r) + h1[1:]
    h4 = h2[:-2] * np.uint32(r**2 & 0xFFFFFFFF) + h2[2:]
    h8 = h4[:-4] * np.uint32(r**4 & 0xFFFFFFFF) + h4[4:]
    return h8[:-4] * np.uint32(r**4 & 0xFFFFFFFF) + h4[8:]


@dataclass
class Index:
    """Windows of a block of items, and where each q-gram stands in the items' text: 9 bytes for each byte of text."""

    text: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    budget: np.ndarray
    need: np.ndarray
    #: Of window w the items are items[first[w] : first[w + 1]], each with how many such windows it has.
    first: np.ndarray
    items: np.ndarray
    times: np.ndarray
    #: Hashes of q-grams in order, and where each stands.
    grams: np.ndarray
    places: np.ndarray
    filter: np.ndarray
    #: Short items as words with a space behind, with the numbers of the items.
    short: dict[str, list[int]]

    @staticmethod
    def of(items: list[str | None]) -> Index:
        data, offsets = utf8_view(pa.array(items, pa.string()))
        text, at = normalise(data, offsets)
        seen: dict[bytes, int] = {}
        windows, owners, short = [], [], {}
        for i in range(len(items)):
            a, b = int(at[i]), int(at[i + 1])
            while b > a and text[b - 1] == 32:
                b -= 1
            if b - a < LEAST_BYTES:
                if b > a:
                    short.setdefault(text[a:b].tobytes().decode("latin-1") + " ", []).append(i)
                continue
            last = b - WINDOW
            for start in (*range(a, last, STRIDE), last) if last > a else (a,):
                length = min(WINDOW, b - a)
                window = seen.setdefault(text[start : start + length].tobytes(), len(seen))
                if window == len(windows):
                    windows.append((start, length))
                owners.append((window, i))
        begin, length = np.array(windows, dtype=np.int32).reshape(-1, 2).T
        budget = length // BYTES_PER_EDIT
        pairs, times = np.unique(np.array(owners, dtype=np.int64).reshape(-1, 2), axis=0, return_counts=True)
        first = np.searchsorted(pairs[:, 0], np.arange(len(begin) + 1))
        inside = np.zeros(len(text) + 1, dtype=np.int32)  # places where a q-gram of a window begins
        np.add.at(inside, begin, 1)
        np.add.at(inside, begin + length - Q + 1, -1)
        places = np.flatnonzero(np.cumsum(inside)[:-1]).astype(np.int32)
        found = hashes(text)[places]
        order = np.argsort(found, kind="stable")
        mask = np.zeros(1 << FILTER_BITS, dtype=bool)
        mask[_slot(found)] = True
        return Index(
            text, begin, length, budget, length + 1 - Q * (budget + 1), first, pairs[:, 1].astype(np.int32), times.astype(np.int32),
            found[order], places[order], np.packbits(mask), short,
        )

    @property
    def size(self) -> int:
        """Bytes of all arrays."""
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def _windows(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows that cover q-grams at some places: numbers of the places, and windows."""
        at = np.searchsorted(self.begin, place, side="right") - 1
        numbers, windows = [], []
        for back in range(COVER):
            window = at - back
            covers = np.flatnonzero((window >= 0) & (place + Q <= self.begin[window] + self.length[window]))
            numbers.append(covers)
            windows.append(window[covers])
        return np.concatenate(numbers), np.concatenate(windows)

    def _hits(self, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the q-grams of texts that stand in the items: where each is, its text, and its range in places."""
        h = hashes(text)
        slot = _slot(h)
        hit = np.flatnonzero(self.filter[slot >> np.uint32(3)] >> (7 - (slot & np.uint32(7))).astype(np.uint8) & 1)
        low, high = np.searchsorted(self.grams, h[hit]), np.searchsorted(self.grams, h[hit], side="right")
        owner = np.searchsorted(at, hit, side="right") - 1
        true = (high > low) & (hit + Q <= at[owner + 1])
        return hit[true], owner[true], low[true], high[true]

    def leaks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document number, window and least edits of each window that occurs in a document."""
        text, at = normalise(data, offsets)
        hit, owner, low, high = self._hits(text, at)
        span = int(np.diff(at).max() + 2 * WINDOW) if len(at) > 1 else 1
        held, held_n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        settled, whose = np.zeros(len(self.begin), dtype=bool), -1
        out, start, slices = [np.zeros((3, 0), dtype=np.int64)], 0, 0
        while start < len(hit):
            sums = np.cumsum(high[start : start + SLICE_HITS] - low[start : start + SLICE_HITS])
            end = start + max(1, int(np.searchsorted(sums, SLICE_HITS, side="right")))
            counts = high[start:end] - low[start:end]
            each = np.repeat(low[start:end], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            place = self.places[each].astype(np.int64)
            number, window = self._windows(place)
            of, where = np.repeat(owner[start:end], counts)[number], np.repeat(hit[start:end], counts)[number]
            live = (of != whose) | ~settled[window]
            of, where, window, place = of[live], where[live], window[live], place[number[live]]
            # diagonals count from the document's start less a window, so that they are positive
            diagonal = where - (place - self.begin[window]) - at[of] + WINDOW
            band = diagonal // (self.budget[window] + 1)
            key = (of * len(self.begin) + window) * span
            bands, n = np.unique(np.concatenate([key + band, key + np.maximum(band - 1, 0)]), return_counts=True)
            bands, back = np.unique(np.concatenate([held, bands]), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([held_n, n]), minlength=len(bands)).astype(np.int64)
            of, window, band = bands // span // len(self.begin), bands // span % len(self.begin), bands % span
            # what a later position may still add to
            open_ = at[of] + (band + 2) * (self.budget[window] + 1) > hit[end] if end < len(hit) else np.zeros(len(bands), dtype=bool)
            held, held_n = bands[open_], n[open_]
            enough = np.flatnonzero(~open_ & (n >= self.need[window]))
            for i in range(0, len(enough), 4096):
                some = enough[i : i + 4096]
                edits = self._edits(text, at, of[some], window[some], band[some])
                true = edits <= self.budget[window[some]]
                out.append(np.stack([of[some][true], window[some][true], edits[true]]))
            start, slices = end, slices + 1
            if start < len(hit):
                if owner[start] != whose:
                    whose, settled = int(owner[start]), np.zeros(len(self.begin), dtype=bool)
                recent = np.concatenate(out, axis=1)
                out = [recent]
                settled[recent[1][(recent[0] == whose) & (recent[2] == 0)]] = True
                if settled.any() and slices & (slices - 1) == 0:
                    # the rest of this text: q-grams that stand in settled windows alone are passed over
                    stop = int(np.searchsorted(owner, whose, side="right"))
                    grams, of_hit = np.unique(low[start:stop], return_inverse=True)
                    needed = np.array([not settled[self._windows(self.places[g : np.searchsorted(self.grams, self.grams[g], side="right")])[1]].all() for g in grams.tolist()])
                    keep = np.concatenate([np.arange(start, dtype=np.int64), start + np.flatnonzero(needed[of_hit]), np.arange(stop, len(hit))])
                    hit, owner, low, high = hit[keep], owner[keep], low[keep], high[keep]
        of, window, edits = np.concatenate(out, axis=1)
        order = np.lexsort((edits, window, of))  # a window that several bands find counts once
        of, window, edits = of[order], window[order], edits[order]
        first = np.concatenate([[True], (of[1:] != of[:-1]) | (window[1:] != window[:-1])]) if len(of) else np.zeros(0, dtype=bool)
        return of[first], window[first], edits[first]

    def items_of(self, owner: np.ndarray, window: np.ndarray, edits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document number, item, number of its windows and least edits of each document and item."""
        counts = self.first[window + 1] - self.first[window]
        each = np.repeat(self.first[window], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        pair = np.repeat(owner, counts) << 32 | self.items[each]
        names, back = np.unique(pair, return_inverse=True)
        best = np.full(len(names), 1 << 20, dtype=np.int64)
        np.minimum.at(best, back, np.repeat(edits, counts))
        n = np.bincount(back, weights=self.times[each], minlength=len(names)).astype(np.int64)
        return names >> 32, names & 0xFFFFFFFF, n, best

    def short_items(self, data: np.ndarray, offsets: np.ndarray, finder: ahocorasick.Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As items_of, for short items: documents that hold an item's words one after the other."""
        raw, at = normalise(data, offsets)
        text = raw.tobytes().decode("latin-1")
        found = set()
        for end, words in finder.iter(text):
            start = end + 1 - len(words)
            if start == 0 or text[start - 1] == " ":
                found.add((start, end, words))
        starts, ends = np.array([(x[0], x[1]) for x in found], dtype=np.int64).reshape(-1, 2).T
        owner = np.searchsorted(at, starts, side="right") - 1
        pairs = {(o, i) for o, end, same, (_, _, words) in zip(owner.tolist(), ends.tolist(), (ends < at[owner + 1]).tolist(), found, strict=True) if same for i in self.short[words]}
        of, item = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2).T
        return of, item, np.ones(len(of), dtype=np.int64), np.zeros(len(of), dtype=np.int64)

    def finder(self) -> ahocorasick.Automaton | None:
        if not self.short:
            return None
        made = ahocorasick.Automaton()
        for words in self.short:
            made.add_word(words, words)
        made.make_automaton()
        return made

    def _edits(self, text: np.ndarray, at: np.ndarray, owner: np.ndarray, window: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Least edits of each window in its document within its band, widened by the budget on both sides."""
        k = self.budget[window]
        most = int(k.max())
        width = 2 * (most + 1) + 2 * most + 1
        column = np.arange(width)
        start = at[owner] + band * (k + 1) - WINDOW - k
        low, high = at[owner][:, None], at[owner + 1][:, None]
        cost = np.zeros((len(owner), width), dtype=np.int32)
        result = np.full(len(owner), 1 << 20, dtype=np.int32)
        for i in range(int(self.length[window].max())):
            live = i < self.length[window]
            place = start[:, None] + i + column
            good = (place >= low) & (place < high)
            char = np.where(good, text[np.clip(place, 0, len(text) - 1)], 0)
            pattern = self.text[np.minimum(self.begin[window] + i, len(self.text) - 1)][:, None]
            step = cost + (char != pattern)
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
            step = np.minimum.accumulate(step - column, axis=1) + column
            cost = np.where(live[:, None], step, cost)
        np.minimum(result, cost.min(axis=1), out=result)
        return result


def _slot(h: np.ndarray) -> np.ndarray:
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - FILTER_BITS)


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item of which a window occurs in it: the key, the item, windows (how many)
    and edits (of the best).

    Null and empty texts and items hold nothing. Items of under LEAST_BYTES are found where all their words follow
    each other; they are one window. A copied part of a longer item is surely found from WINDOW + STRIDE - 1 bytes
    on. Repeated documents and items give their rows each. Documents are only mapped, never shuffled, and whole,
    however long; memory grows with a text's bytes, not with its hits. The benchmark is sent in blocks of about
    BLOCK_BYTES, each with a pass over the documents whose result is written; a single longer item is a block of
    its own."""
    items = benchmark.select(F.col(item).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("body"))
    size = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema["item"].dataType.simpleString()
    schema = f"key {kind}, item {item_kind}, windows long, edits int"
    found = []
    for block in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == block)
        rows = part.orderBy("item", "body").toArrow()  # BLOCK_BYTES, about
        if not rows.num_rows:
            continue
        sent = docs.sparkSession.sparkContext.broadcast((Index.of(rows.column("body").to_pylist()), rows.column("item").combine_chunks()))
        scan = _scan(docs.select(key, text), sent, schema)
        found.append(scan if blocks == 1 else stored(scan, "leaks"))
        if blocks > 1:
            sent.unpersist()
    out = reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)
    return out.select(F.col("key").alias(key), F.col("item").alias(item), "windows", "edits")


def _scan(docs: DataFrame, sent, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ids = sent.value
        finder = index.finder()
        for batch in batches:
            for part in pieces_of(batch, 1, CHUNK_BYTES):
                view = utf8_view(part.column(1))
                results = [index.items_of(*index.leaks(*view))] if len(index.begin) else []
                results += [index.short_items(*view, finder)] if finder else []
                for owner, of, windows, edits in results:
                    if len(owner):
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0).take(pa.array(owner)), ids.take(pa.array(of)), pa.array(windows), pa.array(edits.astype(np.int32))], ["key", "item", "windows", "edits"]
                        )

    return docs.mapInArrow(run, schema)
