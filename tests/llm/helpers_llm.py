"""Plain computations that the operators' results are compared with, and small tables."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Documents from (doc_id, text[, lang[, source]])."""
    full = [(*r, *[None] * (4 - len(r)), len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def clashing(docs: DataFrame) -> DataFrame:
    """Extra columns whose names the operators use themselves."""
    for name in ("n", "size", "target", "row", "kind", "start", "node", "tree", "tokens", "stats", "key", "copies", "_own", "place"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def given(sf_dir: str) -> dict[int, tuple]:
    import duckdb

    rows = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{sf_dir}/documents.parquet'").fetchall()
    return {r[0]: r for r in rows}


def removed(texts: dict[int, str | None], span: int = 50) -> dict[int, list[bytes]]:
    """Words that each document keeps when copied passages go."""
    first: dict[tuple, int] = {}
    cut = {d: words(t) for d, t in texts.items()}
    for d in sorted(cut):
        for i in range(len(cut[d]) - span + 1):
            first.setdefault(tuple(cut[d][i:i + span]), d)
    out = {}
    for d, w in cut.items():
        gone: set[int] = set()
        for i in range(len(w) - span + 1):
            if first[tuple(w[i:i + span])] < d:
                gone.update(range(i, i + span))
        out[d] = [x for i, x in enumerate(w) if i not in gone]
    return out


def shingle_set(text: str | None, k: int = 5) -> set[tuple]:
    w = [x.lower() for x in words(text)]
    if not w:
        return set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def linked(texts: dict[int, str | None], similarity: int = 80) -> dict[int, int]:
    """Smallest doc_id that links reach, by counting the shared shingles of all pairs."""
    sets = {d: shingle_set(t) for d, t in texts.items()}
    where = defaultdict(list)
    for d in sorted(sets):
        for s in sets[d]:
            where[s].append(d)
    shared: Counter = Counter()
    for ids in where.values():
        for i, b in enumerate(ids):
            for a in ids[:i]:
                shared[a, b] += 1
    parent = {d: d for d in sets}

    def root(d: int) -> int:
        while parent[d] != d:
            d = parent[d]
        return d

    for (a, b), n in shared.items():
        if 100 * n >= similarity * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {d: root(d) for d in sets}

def huffman_cost(counts: dict[int, int]) -> int:
    """Bits of the code without a limit, to compare with."""
    heap, total = sorted(counts.values()), 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a + b
        heapq.heappush(heap, a + b)
    return total


def brute_counts(texts: list[str | None], path: str) -> np.ndarray:
    """Each text encoded by itself."""
    t = Tokenizer.from_file(path)
    return np.array([len(t.encode(x or "", add_special_tokens=False).ids) for x in texts])
