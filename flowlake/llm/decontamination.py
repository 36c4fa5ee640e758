"""Benchmark passages in documents, by q-gram counts and banded alignment (operator 3).

A passage of m characters within k edits of an item shares at least m - q + 1 - k * q of its
q-grams with it, and all of them lie on diagonals (place in the text less place in the item) that
differ by k at most. So shared q-grams are counted in diagonal bands 2 (k + 1) wide that overlap
by half; a band with fewer cannot hold a passage. What is left is aligned within the band.

The same is done for overlapping windows of each item, so that a part of an item is found as well;
windows that continue each other in item and text are one passage.

Only *telling* q-grams of an item count: those without a short period that stand nowhere else in
their item within a window's reach. Rules, tables and other repetition so cost no more than prose,
and a window needs enough of them to be searched: a rule of dashes is no evidence. Items without
any, and items shorter than q, are found character by character with one automaton.

Texts are compared in code points, with A-Z as a-z and every white-space byte as a blank.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import bound_batches, give_back, mix64, pieces
from flowlake.llm.encode import forget

Q = 12
EDITS = 0.05                  # edits a character of an item
WINDOW = 50                   # characters of a part of an item that is searched by itself
STEP = 10                     # from window to window; an item's last one ends where it ends
BENCHMARK_CHARS = 8 << 20     # characters of items that one pass holds
PAIRS = 1 << 18               # places in a text and in items that are counted at a time
FILTER_BITS = 22
FOUND = "doc_id long, item_id long, start long, stop long, edits long"


def points(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    c[(c >= 9) & (c <= 13)] = 32
    c[(c >= 65) & (c <= 90)] += 32
    return c


def grams(c: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit hashes of all runs of q code points; runs are joined from runs of powers of two."""
    n = len(c) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, base = c.astype(np.uint64), np.uint64(0x9E3779B97F4A7C15)
    out, done, length = None, 0, 1
    while True:
        if q & length:
            part = power[done:done + n]
            out = part if out is None else out * base + part
            done += length
        if 2 * length > q:
            return mix64(out)
        base = np.uint64(int(base) * 0xD6E8FEB86659FD93 % (1 << 64))
        power = power[:-length] * base + power[length:]
        length *= 2


def telling(c: np.ndarray, h: np.ndarray, q: int = Q) -> np.ndarray:
    """Which q-grams (of hashes ``h``) of an item tell: no period up to q / 2, and no equal one within a window's reach."""
    n = len(h)
    out = np.ones(n, bool)
    for p in range(1, q // 2 + 1):
        same = np.append(0, np.cumsum(c[p:] == c[:-p]))
        out &= same[q - p:q - p + n] - same[:n] < q - p
    order = np.argsort(h, kind="stable")
    near = (h[order][1:] == h[order][:-1]) & (np.diff(order) <= WINDOW - q)
    out[order[1:][near]] = False
    out[order[:-1][near]] = False
    return out


class Spans:
    """Passages of which none overlaps another of the same item."""

    def __init__(self):
        self.found: list[tuple[int, int, int, int]] = []
        self.by: dict[int, list[tuple[int, int]]] = {}

    def meets(self, item: int, start: int, stop: int) -> bool:
        spans = self.by.get(item, [])
        k = bisect_left(spans, (stop, 0)) - 1
        return k >= 0 and spans[k][1] > start

    def add(self, found: list[tuple[int, int, int, int]]) -> Spans:
        for f in found:
            if not self.meets(*f[:3]):
                self.found.append(f)
                insort(self.by.setdefault(f[0], []), f[1:3])
        return self


@dataclass
class Benchmark:
    """Items and where each of their telling q-grams stands."""

    ids: list[int]
    items: list[np.ndarray]
    edits: np.ndarray
    least: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    filter: np.ndarray
    q: int
    longest: int
    part_edits: int
    begin: np.ndarray
    told: np.ndarray                      # telling q-grams before each character of the items
    short: list[tuple[int, np.ndarray]]   # items of fewer than q characters
    plain: list[int]                      # longer ones without a telling q-gram

    @staticmethod
    def of(rows: list[tuple[int, str]], q: int = Q, rate: float = EDITS) -> Benchmark:
        rows = [(i, points(t)) for i, t in rows if t]
        short = [(i, c) for i, c in rows if len(c) < q and (c != 32).any()]
        rows = [(i, c) for i, c in rows if len(c) >= q]
        m = np.array([len(c) for _, c in rows], np.int64)
        # The most edits that still leave a q-gram.
        edits = np.minimum((m * rate).astype(np.int64), (m - q) // q)
        part_edits = min(int(WINDOW * rate), (WINDOW - q) // q)
        hashes = [grams(c, q) for _, c in rows]
        tells = [telling(c, h, q) for (_, c), h in zip(rows, hashes)]
        offsets = [np.flatnonzero(t) for t in tells]
        count = np.array([len(o) for o in offsets], np.int64)
        h = np.concatenate([np.empty(0, np.uint64), *[x[o] for x, o in zip(hashes, offsets)]])
        item = np.repeat(np.arange(len(rows)), count)
        offset = np.concatenate([np.empty(0, np.int64), *offsets])
        order = np.argsort(h, kind="stable")
        keys, first = np.unique(h[order], return_index=True)
        there = np.zeros(1 << FILTER_BITS, bool)
        there[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        told = np.concatenate([np.empty(0, bool), *[x for t in tells for x in (t, np.zeros(q - 1, bool))]])
        return Benchmark([i for i, _ in rows], [c for _, c in rows], edits, np.maximum(count - edits * q, 1),
                         keys, np.append(first, len(h)), item[order], offset[order], there, q, int(m.max(initial=0)),
                         part_edits, np.append(0, np.cumsum(m)), np.append(0, np.cumsum(told)), short, np.flatnonzero(count == 0).tolist())

    def name(self, item: int) -> int:
        return self.ids[item] if item < len(self.ids) else self.short[item - len(self.ids)][0]

    def search(self, c: np.ndarray, short: bool = True) -> list[tuple[int, int, int, int]]:
        """(item, start, stop, edits) of passages in a text's code points, whole items first, none that
        overlap for the same item. Items under q characters, where ``short``, are numbered after the others."""
        exact = self._exact(c, short)
        h = grams(c, self.q)
        at = np.flatnonzero(self.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]) if len(self.keys) else np.empty(0, np.int64)
        if not len(at):
            return exact
        slot = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[slot] == h[at]
        at, slot = at[hit], slot[hit]
        n = self.first[slot + 1] - self.first[slot]
        cuts = np.unique(np.append(np.searchsorted(np.cumsum(n), np.arange(0, int(n.sum()), PAIRS)), len(at)))
        items, parts = [], []
        for a, b in zip(cuts, cuts[1:]):
            k = n[a:b]
            place = np.repeat(self.first[slot[a:b]], k) + np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            item, offset = self.item[place], self.offset[place]
            diagonal = np.repeat(at[a:b], k) - offset
            band = (diagonal + self.longest) // (self.edits[item] + 1)
            items.append(np.unique(np.concatenate([item * (1 << 40) + band, item * (1 << 40) + band - 1]), return_counts=True))
            parts.append(np.unique(self._windows(item, offset, diagonal), return_counts=True))
        found = []
        keys, counts = _summed(items)
        for k in keys[counts >= self.least[(keys + 1) >> 40]].tolist():
            # Less by one may be band -1, which belongs to the same item.
            i, band = (k + 1) >> 40, ((k + 1) & ((1 << 40) - 1)) - 1
            width = int(self.edits[i]) + 1
            low = band * width - self.longest
            hit = align(self.items[i], c, low, low + 2 * width - 1, int(self.edits[i]))
            if hit:
                found.append((i, *hit))
        found.sort(key=lambda f: (f[0], f[3], f[1], f[2]))
        spans = Spans().add(found)
        return spans.add(self._parts(c, *_summed(parts), spans)).found + exact

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Built once a worker: the texts that are found character by character, and their items."""
        texts: dict[str, list[int]] = {}
        for i, c in [(i, self.items[i]) for i in self.plain] + [(len(self.ids) + k, c) for k, (_, c) in enumerate(self.short)]:
            texts.setdefault(_text(c), []).append(i)
        automaton = ahocorasick.Automaton()
        for t, items in texts.items():
            automaton.add_word(t, (len(t), items))
        if texts:
            automaton.make_automaton()
        return automaton

    def _exact(self, c: np.ndarray, short: bool) -> list[tuple[int, int, int, int]]:
        """Places of the items without telling q-grams; those under q characters do not begin or end within a word."""
        if not (self.plain or short and self.short) or not len(c):
            return []
        text, last, found = _text(c), {}, []
        for end, (n, items) in self.automaton.iter(text):
            a, b = end + 1 - n, end + 1
            if n < self.q and (not short or text[max(a - 1, 0):a + 1].isalnum() and a > 0 or text[b - 1:b + 1].isalnum() and b < len(text)):
                continue
            for i in items:
                if last.get(i, 0) <= a:
                    last[i] = b
                    found.append((i, a, b, 0))
        return sorted(found)

    def _windows(self, item: np.ndarray, offset: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        """Keys of windows and diagonal bands that hold the shared q-grams."""
        m = np.diff(self.begin)[item]
        starts = [(offset // STEP - j) * STEP for j in range((WINDOW - self.q) // STEP + 1)]
        fits = [(s >= 0) & (offset - s <= WINDOW - self.q) & (s + WINDOW <= m) for s in starts]
        starts.append(m - WINDOW)
        fits.append((m >= WINDOW) & (offset >= m - WINDOW) & ((m - WINDOW) % STEP > 0))
        band = (diagonal + self.longest) // (self.part_edits + 1)
        return np.concatenate([(self.begin[item[f]] + s[f]) * (1 << 32) + band[f] - k for s, f in zip(starts, fits) for k in (0, 1)])

    def _parts(self, c: np.ndarray, keys: np.ndarray, counts: np.ndarray, whole: Spans) -> list[tuple[int, int, int, int]]:
        """(item, start, stop, edits) of parts of items, longest first, from the windows' q-grams shared with a text."""
        most, width = self.part_edits, self.part_edits + 1
        # Each edit takes q of a window's telling q-grams at most; one has to be left.
        at = (keys + 1) >> 32
        least = self.told[np.minimum(at + WINDOW - self.q + 1, len(self.told) - 1)] - self.told[at] - most * self.q
        found = set()
        for key in keys[(least >= 1) & (counts >= least)].tolist():
            # Less by one may be band -1, which belongs to the same window.
            at, band = (key + 1) >> 32, (key + 1) % (1 << 32) - 1
            i = int(np.searchsorted(self.begin, at, "right")) - 1
            a = at - int(self.begin[i])
            low = band * width - self.longest + a
            if whole.meets(i, low, low + WINDOW):
                continue
            hit = align(self.items[i][a:a + WINDOW], c, low, low + 2 * width - 1, most)
            if hit:
                found.add((i, hit[0], a, hit[1], hit[2]))
        # Windows that continue each other, in the order of their places in the text.
        chains: list[list[tuple[int, int, int, int, int]]] = []
        reach: list[list[tuple[int, int, int, int, int]]] = []
        for f in sorted(found):
            reach = [chain for chain in reach if chain[-1][0] == f[0] and f[1] <= chain[-1][3]]
            for chain in reversed(reach):
                last = chain[-1]
                if f[2] >= last[2] and abs(f[1] - f[2] - last[1] + last[2]) <= 2 * most:
                    chain.append(f)
                    break
            else:
                chains.append([f])
                reach.append(chains[-1])
        out = []
        for chain in chains:
            i, a, b, edits = chain[0][0], chain[0][2], chain[-1][2] + WINDOW, sum(f[4] for f in chain)
            span = (chain[0][1], max(f[3] for f in chain), edits)
            if edits:
                begins = [f[1] - f[2] + a for f in chain]
                span = align(self.items[i][a:b], c, min(begins), max(begins), edits) or span
            out.append((i, *span))
        return sorted(out, key=lambda f: (f[0], f[1] - f[2], f[3], f[1]))


def _text(c: np.ndarray) -> str:
    return c.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of several counts together."""
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keys, slot = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(slot, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(start, stop, edits) of the best alignment of the whole item with a part of the text that
    begins on a diagonal from ``low`` to ``high`` and stays within ``most`` of them; None above ``most``.

    Of equal alignments the one that ends first counts.
    """
    m = len(item)
    for d in range(max(low, 0), min(high, len(text) - m) + 1):
        if text[d] == item[0] and np.array_equal(text[d:d + m], item):
            return d, d + m, 0
    if most == 0:
        return None
    far, low, high = 1 << 30, low - most, high + most
    width = high - low + 1
    # Cell j of row i: i characters of the item against the text up to i + low + j.
    place = np.arange(width) + low
    inside = (place >= 0) & (place <= len(text))
    cost = np.where(inside, 0, far)
    begin = np.where(inside, place, 0)
    padded = np.concatenate([text, [np.uint32(0xFFFFFFFF)]])
    steps = np.arange(width)
    for i in range(1, m + 1):
        end = place + i
        inside = (end >= 0) & (end <= len(text))
        same = (end >= 1) & inside & (padded[np.clip(end - 1, 0, len(text))] == item[i - 1])
        take = np.where(end >= 1, cost, far) + np.where(same, 0, 1)
        drop = np.append(cost[1:], far) + 1
        new = np.where(inside, np.minimum(take, drop), far)
        start = np.where(take <= drop, begin, np.append(begin[1:], 0))
        # Characters of the text that the item lacks: the best cell to the left, one edit a step.
        key = (new - steps) * width + (width - 1 - steps)
        best = np.minimum.accumulate(key)
        source = width - 1 - best % width
        moved = new[source] + steps - source
        use = inside & (moved < new)
        cost, begin = np.where(use, moved, new), np.where(use, start[source], start)
        if cost.min() > most:
            return None
    j = int(cost.argmin())
    return (int(begin[j]), int(place[j] + m), int(cost[j])) if cost[j] <= most else None


def _slices(benchmark: DataFrame, chars: int = BENCHMARK_CHARS) -> list[DataFrame]:
    """The items in slices of bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // chars))
    return [items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k) for k in range(n)]


def _read(items: DataFrame, q: int, rate: float) -> Broadcast:
    """One slice, by way of the driver; it keeps no slice after it is sent."""
    rows = sorted({(r.item_id, r.text) for r in items.collect()}, key=str)
    return items.sparkSession.sparkContext.broadcast(Benchmark.of(rows, q, rate))


def passages(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDITS) -> DataFrame:
    """(doc_id, item_id, start, stop, edits): every passage of an item in a document.

    A passage is within ``rate`` edits a character of the whole item, or of a part of it: a window of
    ``WINDOW`` characters or several that continue each other. Places are code points, stop
    exclusive. Passages of one item in one document do not overlap; whole items go before parts, of
    whole ones the one with fewest edits, then the first, of parts the longest. An item that repeats
    itself is surely found with as many edits as leave one of its telling q-grams, without any only
    unedited. Items shorter than ``q`` characters are found unedited and as whole words, wherever they
    stand. Windows of an item in which edits could spoil every telling q-gram are not searched by
    themselves. Null and blank items, and null texts, have no passages.
    Equal items count once for each item_id. Repeated documents are reported each. Texts are
    scanned once for every 8 M characters of items; they are not shuffled.
    """
    bound_batches(docs.sparkSession)
    out = None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for items in _slices(benchmark):
        found = texts.mapInArrow(_search(_read(items, q, rate)), FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def _search(held: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                both = zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())
                rows = [(d, held.value.name(i), a, b, e) for d, t in both if t for i, a, b, e in held.value.search(points(t))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)],
                                                 ["doc_id", "item_id", "start", "stop", "edits"])
    return run


def _clean(held: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in pieces(batch):
                clean = [not t or not held.value.search(points(t), short=False) for t in part.column("text").to_pylist()]
                yield part.filter(pa.array(clean, pa.bool_()))
        give_back()
    return run


def without_passages(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDITS) -> DataFrame:
    """The rows of ``docs`` without a passage of any item, with all their columns; no shuffle.

    Items shorter than ``q`` characters make no text go: a word or two are no copy of a benchmark.
    """
    bound_batches(docs.sparkSession)
    schema = docs.schema
    for items in _slices(benchmark):
        docs = docs.mapInArrow(_clean(_read(items, q, rate)), schema)
    return docs
