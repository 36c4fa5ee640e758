"""N-gram Jaccard join by count-vector R-trees (operator 2).

A document's set of shingles becomes a point: its tokens are hashed to groups, a coordinate counts
the tokens of a group. The sum over coordinates of the smaller counts bounds the overlap of two
sets from above, and with a page's largest counts that of a set with every set of the page. A
pair that may reach the threshold passes this bound; the rest is pruned.

One tree over all documents would prune nothing by place (documents without common text lie
around one middle), so there is a forest. Sets that reach the threshold share one of their first
n - ceil(0.8 n) + 1 tokens, in an order of all tokens that puts frequent ones last. Each such
token that several sets have is a tree of those sets, one for each band of sizes. Links found by bound alone join candidate
classes; whole sets then travel once, to their class, where a second tree and the exact
intersection decide. Equal sets count as one throughout.

Within a tree the search runs breadth first from set to set, over the sets that are not yet
reached: a group of copies is left after a few queries, and all links that could join two parts
are still tried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from flowlake.llm.common import BROADCAST_ROWS, bound_batches, give_back, mix64, pieces, window_hashes
from flowlake.llm.components import components
from flowlake.llm.encode import forget
from flowlake.scratch import materialize

WORDS = 5
SIMILARITY = 80               # per cent
GROUPS = (64, 4096)           # coordinates of a point at least and at most
PER_GROUP = 8                 # tokens a coordinate, about, between these
FREQUENT = 32                 # sets that make a token frequent
LOOKED = 25                   # per cent of a set's tokens that are counted for it
TREE = 4096                   # points of one tree; larger ones are cut into pairs of tiles
TREE_BYTES = 64 << 20
PAGE = 64

SETS = "doc_id long, n long, one long, two long, point binary, tokens binary"


def shingles(texts: list[str | None], k: int = WORDS) -> list[np.ndarray]:
    """Distinct 64-bit hashes of the runs of k words of each text, ascending. A-Z count as a-z."""
    cut = [(t or "").encode().lower().split() for t in texts]
    sizes = np.array([len(w) for w in cut], np.int64)
    flat = np.fromiter((h for w in cut for h in map(xxh64_intdigest, w)), np.uint64, int(sizes.sum()))
    h, ends, out = window_hashes(flat, k), np.cumsum(sizes), []
    for w, size, end in zip(cut, sizes.tolist(), ends.tolist()):
        if size >= k:
            own = h[end - size:end - k + 1]
        elif size:
            own = np.array([xxh64_intdigest(b" ".join(w), seed=size)], np.uint64)
        else:
            own = np.empty(0, np.uint64)
        out.append(np.unique(own))
    return out


def groups_for(n: int, similarity: int = SIMILARITY) -> int:
    """Coordinates of a set's point: a power of two that grows with the largest set it may link with."""
    largest = 100 * n // similarity
    return int(np.clip(1 << max(largest.bit_length() - PER_GROUP.bit_length() + 1, 0), *GROUPS))


def point(tokens: np.ndarray, groups: int) -> np.ndarray:
    """Tokens by their low bits, so that halves of a point add up to the point of half the groups."""
    return np.bincount((tokens & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def folded(points: list[bytes]) -> np.ndarray:
    """Points as rows, all with as many coordinates as the one that has fewest."""
    groups = min(map(len, points))
    return np.stack([np.frombuffer(p, np.uint8).astype(np.int32).reshape(-1, groups).sum(axis=0) for p in points])


def _sets(similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in pieces(batch):
                sets = shingles(part.column("text").to_pylist())
                prints = [(mix64(s + np.uint64(1)).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix64(s ^ np.uint64(0xA5A5A5A5)))) if len(s) else (0, 0) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                     *[pa.array(np.array([p[i] for p in prints], np.uint64).view(np.int64)) for i in (0, 1)],
                     # A count of 255 stands for more: the bound then holds nothing back.
                     pa.array([np.minimum(point(s, groups_for(len(s), similarity)), 255).astype(np.uint8).tobytes() for s in sets], pa.binary()),
                     pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())],
                    ["doc_id", "n", "one", "two", "point", "tokens"])
        give_back()
    return run


def _tokens(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(t, "<u8") for t in batch.column("tokens").to_pylist()]


def _looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first tokens of each set, whose frequency may matter."""
    for batch in batches:
        parts = [t[: -(-len(t) * LOOKED // 100)] for t in _tokens(batch)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *parts]).view(np.int64))], ["token"])


def prefix(tokens: np.ndarray, frequent: np.ndarray, similarity: int = SIMILARITY) -> np.ndarray:
    """The first tokens of a set, frequent ones last: a set that links with it has one of them among its own."""
    n = len(tokens)
    size = n - -(-similarity * n // 100) + 1 if n else 0
    if len(frequent) and n:
        slot = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        often = frequent[slot] == tokens
        tokens = np.concatenate([tokens[~often], tokens[often]])
    return tokens[:size]


def _prefixes(frequent: Broadcast, similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [prefix(t, frequent.value, similarity) for t in _tokens(batch)]
            flat = np.concatenate([np.empty(0, np.uint64), *parts]).view(np.int64)
            docs = np.repeat(np.asarray(batch.column("doc_id"), np.int64), [len(p) for p in parts])
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(docs)], ["token", "node"])
        give_back()
    return run


class Tree:
    """Points in pages of like size and shape; a query prunes pages, then points, by summed minima."""

    def __init__(self, size: np.ndarray, points: np.ndarray, similarity: int = SIMILARITY):
        self.similarity, pages = similarity, max(1, -(-len(size) // PAGE))
        # Sort, tile, sort: runs of like size, each cut by the coordinate that varies most.
        order = np.argsort(size, kind="stable")
        runs = np.array_split(order, max(1, int(np.sqrt(pages))))
        order = np.concatenate([r[np.argsort(points[r, points[r].std(axis=0).argmax()], kind="stable")] for r in runs])
        self.order, self.size, self.points = order, size[order], points[order]
        self.start = np.arange(0, len(size), PAGE)
        self.most = np.maximum.reduceat(self.points, self.start, axis=0)
        self.smallest = np.minimum.reduceat(self.size, self.start)
        self.open = np.ones(len(size), bool)
        self.left = np.add.reduceat(self.open.astype(np.int64), self.start)
        self.full = (self.points >= 255).any(axis=1)

    def reached(self, n: int, point: np.ndarray, full: bool) -> np.ndarray:
        """Open positions whose bound allows a link with a set of ``n`` tokens."""
        s = self.similarity
        # overlap / (a + b - overlap) >= s%  is  (100 + s) * overlap >= s * (a + b).
        enough = lambda bound, size: ((100 + s) * bound >= s * (n + size)) & (100 * np.minimum(n, size) >= s * np.maximum(n, size))
        pages = np.flatnonzero(self.left)
        if len(pages) > 1 and not full:
            bound = np.minimum(self.most[pages], point).sum(axis=1)
            pages = pages[((100 + s) * bound >= s * (n + self.smallest[pages])) | (self.most[pages] >= 255).any(axis=1)]
        if not len(pages):
            return pages
        at = (self.start[pages][:, None] + np.arange(PAGE)).ravel()
        at = at[at < len(self.size)]
        at = at[self.open[at]]
        bound = np.minimum(self.points[at], point).sum(axis=1)
        bound = np.where(self.full[at] | full, np.minimum(self.size[at], n), bound)
        return at[enough(bound, self.size[at])]

    def close(self, at: np.ndarray) -> None:
        self.open[at] = False
        np.subtract.at(self.left, at // PAGE, 1)

    def links(self, exact: Callable[[int, np.ndarray], np.ndarray] | None = None) -> list[tuple[int, int]]:
        """Links that join the same points as all links do: a spanning forest, by positions given."""
        out = []
        for first in range(len(self.size)):
            if not self.open[first]:
                continue
            self.close(np.array([first]))
            queue = [first]
            while queue:
                p = queue.pop()
                near = self.reached(int(self.size[p]), self.points[p], bool(self.full[p]))
                if exact is not None and len(near):
                    near = near[exact(int(self.order[p]), self.order[near])]
                if len(near):
                    self.close(near)
                    queue.extend(near.tolist())
                    out.extend((int(self.order[p]), int(self.order[q])) for q in near)
        return out


def tree_links(size: np.ndarray, points: np.ndarray, similarity: int) -> list[tuple[int, int]]:
    """``Tree.links`` by bound alone; two points need no tree."""
    if len(size) != 2:
        return Tree(size, points, similarity).links() if len(size) else []
    a, b = size.tolist()
    overlap = min(a, b) if (points >= 255).any() else int(np.minimum(points[0], points[1]).sum())
    enough = (100 + similarity) * overlap >= similarity * (a + b) and 100 * min(a, b) >= similarity * max(a, b)
    return [(0, 1)] if enough else []


def _runs(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(nodes, sizes, ``name`` column) of the rows of each tree, from batches sorted by it."""
    last, held = None, []
    for batch in batches:
        tree, nodes, sizes = (np.asarray(batch.column(c)) for c in ("tree", "node", "n"))
        data = batch.column(name).to_pylist()
        cuts = [0, *(np.flatnonzero(tree[1:] != tree[:-1]) + 1).tolist(), len(tree)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and last != tree[a]:
                yield _one(held)
                held = []
            held.append((nodes[a:b], sizes[a:b], data[a:b]))
            last = tree[a]
    if held:
        yield _one(held)


def _one(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    if len(parts) == 1:
        return parts[0]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), [x for p in parts for x in p[2]]


def _links(nodes: np.ndarray, found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(nodes[pairs[:, 0]]), pa.array(nodes[pairs[:, 1]])], ["a", "b"])


def _by_bound(similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for nodes, sizes, points in _runs(batches, "point"):
            for p, q in tree_links(sizes, folded(points), similarity):
                a.append(nodes[p])
                b.append(nodes[q])
            if len(a) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        give_back()
    return run


def _exactly(similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, size, tokens in _runs(batches, "tokens"):
            if len(nodes) < 2:
                continue
            sets = [np.frombuffer(x, "<u8") for x in tokens]
            groups = min(groups_for(int(np.median(size)), similarity), 512)
            points = np.stack([np.minimum(point(s, groups), 255) for s in sets]).astype(np.int32)

            def exact(p: int, others: np.ndarray) -> np.ndarray:
                own = sets[p]
                shared = np.array([_shared(own, sets[q]) for q in others.tolist()], np.int64)
                return 100 * shared >= similarity * (len(own) + size[others] - shared)

            found = Tree(size, points, similarity).links(exact)
            if found:
                yield _links(nodes, found)
        give_back()
    return run


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    slot = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[slot] == a).sum())


def _trees(rows: DataFrame, key: str, many) -> DataFrame:
    """``rows`` with ``tree``: their ``key``, or beyond ``many`` tiles each pair of tiles a row is in."""
    tile = F.pmod(F.xxhash64("node", F.lit(5)), F.col("tiles"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda j: F.struct(
        F.least(j, F.col("tile")).alias("low"), F.greatest(j, F.col("tile")).alias("high")))
    # The pair of a tile with itself is part of its pairs with others.
    pairs = F.filter(pairs, lambda p: (p["low"] < p["high"]) | (F.col("tiles") == 1))
    return (rows.withColumn("tiles", many.cast("long")).withColumn("tile", tile).withColumn("pair", F.explode(pairs))
            .withColumn("tree", F.xxhash64(key, "pair.low", "pair.high")).drop("tiles", "tile", "pair"))


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree").sortWithinPartitions("tree")


def _few(df: DataFrame) -> bool:
    return df.count() <= BROADCAST_ROWS


def frequent_tokens(points: DataFrame) -> np.ndarray:
    """Tokens that many sets have, ascending; at most as many as may be broadcast.

    Only the order of tokens depends on them, never which links are found.
    """
    counted = points.select("tokens").mapInArrow(_looked, "token long").groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT)
    counted = materialize(counted, "frequent")
    # How many tokens have 32, 64, 128, ... sets: at most 64 rows.
    steps = sorted(counted.groupBy(F.floor(F.log2("n")).alias("s")).agg(F.count("*").alias("n")).collect(), reverse=True)
    total, least = 0, None
    for r in steps:
        total += r.n
        if total > BROADCAST_ROWS:
            break
        least = r.s
    if least is None:
        return np.empty(0, np.uint64)
    rows = counted.filter(F.floor(F.log2("n")) >= least).select("token").toPandas()
    return np.sort(rows["token"].to_numpy(np.int64).view(np.uint64))


def similar(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_shingles, component_id, class_id.

    Two documents link when the Jaccard similarity of their sets of 5-word shingles is at least
    ``similarity`` per cent; component_id is the smallest doc_id that links reach, class_id the
    smallest with the same set. A document of fewer words has their whole sequence as its only
    shingle. Null and wordless texts have none and link with nothing, nor does a null doc_id
    (component_id null). Rows that share a doc_id are one document, with the links of each.
    """
    bound_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    sets = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_sets(similarity), SETS), "sets")
    narrow = sets.select("doc_id", "n", "one", "two")
    classes = materialize(narrow.filter("n > 0 and doc_id is not null").groupBy("n", "one", "two").agg(F.min("doc_id").alias("class_id")), "classes")

    # One set a class goes on. Ids of classes are broadcast where they are few enough.
    firsts = classes.select(F.col("class_id").alias("doc_id")).distinct()
    points = sets.filter("n > 0").join(F.broadcast(firsts) if _few(firsts) else firsts, "doc_id", "left_semi")

    frequent = context.broadcast(frequent_tokens(points))
    shared = points.select("doc_id", "tokens").mapInArrow(_prefixes(frequent, similarity), "token long, node long")
    of = Window.partitionBy("token")
    shared = (shared.withColumn("sets", F.count("*").over(of)).withColumn("list", F.sum(F.xxhash64("node") % F.lit(1 << 40)).over(of))
              .filter("sets > 1"))
    # Tokens of the same sets are one tree.
    lists = materialize(shared.groupBy("list", "sets", "node").agg(F.lit(1).alias("x")).drop("x"), "lists")
    # Bands of like size, one for each doubling. A set stands in its own band and in that of the
    # largest set it may link with, so that two sets that may link meet in the band of the larger.
    bands = F.array_distinct(F.array(F.length(F.bin("n")), F.length(F.bin(F.floor(F.col("n") * 100 / F.lit(similarity))))))
    placed = lists.join(points.select(F.col("doc_id").alias("node"), "n", "point"), "node").withColumn("band", F.explode(bands))
    trees = _trees(placed.withColumn("key", F.xxhash64("list", "sets", "band")), "key", F.ceil(F.col("sets") / F.lit(TREE)))
    candidates = _dealt(trees.select("tree", "node", "n", "point")).mapInArrow(_by_bound(similarity), "a long, b long")
    classed = materialize(components(candidates), "candidate-classes")

    # Whole sets travel to their candidate class.
    held = sets.filter("n > 0").select(F.col("doc_id").alias("node"), "n", "tokens")
    whole = held.join(F.broadcast(classed) if _few(classed) else classed, "node")
    load = materialize(whole.groupBy("component").agg(F.count("*").alias("sets"), F.sum(F.col("n") * 8).alias("bytes")), "class-loads")
    whole = whole.join(F.broadcast(load) if _few(load) else load, "component")
    tiles = F.greatest(F.ceil(F.col("sets") / F.lit(TREE)), F.ceil(F.col("bytes") / F.lit(TREE_BYTES)))
    trees = _trees(whole.withColumn("key", F.col("component")), "key", tiles)
    links = _dealt(trees.select("tree", "node", "n", "tokens")).mapInArrow(_exactly(similarity), "a long, b long")
    found = materialize(components(links), "components")

    return (narrow.join(classes, ["n", "one", "two"], "left")
            .join(found.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id", "doc_id")).alias("component_id"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id")))


def keep_one(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` but for those that are linked, near or far, with a smaller doc_id.

    Of rows that share a doc_id all stay or go. Only ids join the documents, broadcast where they
    are few enough.
    """
    gone = materialize(similar(docs, similarity).filter("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct(), "near-copies")
    return docs.join(F.broadcast(gone) if _few(gone) else gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
