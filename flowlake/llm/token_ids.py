"""Token ids in files, under a canonical length-limited Huffman code (operator 4).

1. Every text is encoded once, with an end id after it, into a written table.
2. The ids are counted over all documents; the counts give code lengths of at most 16 bits
   (package-merge), and the lengths alone give the canonical code.
3. Each document becomes a run of bits that begins at a byte, dealt to the partition that holds
   its range of doc_id, sorted there, and gathered in blocks of about 64k ids. A block stands by
   itself: documents, ids of each, bits, and the bit offset of every 256th id.
4. A reader decodes many checkpoints of a block side by side with one table look-up an id.

The files are Parquet, one block a row, and a second folder with the code lengths, so that
Spark's commit keeps them whole when executors are lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.llm.common import bound_batches, give_back, pieces
from flowlake.llm.encode import BATCH, MEMORY, encoder, forget
from flowlake.scratch import scratch_path

END = 0
LONGEST_CODE = 16
BLOCK_IDS = 1 << 16
EVERY = 256                   # ids between checkpoints
AT_ONCE = 1 << 20             # ids that one vectorized step handles
CUT_ERROR = 1e-5              # of all documents by which a range may be off; bounds the summary that finds the cuts
RANGE_BYTES = 32 << 20        # coded bytes of a range of doc_id

IDS = "doc_id long, n_tokens long, ids binary"
CODED = "doc_id long, n_tokens long, sum long, bits binary, marks binary, place int"
BLOCKS = ("part int, block int, first_id long, n_ids long, doc_ids array<long>, n_tokens array<long>,"
          " bits binary, marks binary")
DOCS = "part int, block int, at int, doc_id long, offset long, n_tokens long, ids_crc32 long"


def _names(schema: str) -> list[str]:
    return [column.split()[0] for column in schema.split(",")]


def encode_documents(docs: DataFrame, tokenizer: str, end: int = END, remembered: int = MEMORY, batch_bytes: int = BATCH) -> DataFrame:
    """(doc_id, n_tokens, ids): little-endian ids of each text and the end id. Null is empty."""
    bound_batches(docs.sparkSession, batch_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, remembered)
        tail = np.array([end], enc.dtype).tobytes()
        for batch in batches:
            for part in pieces(batch, batch_bytes):
                ids = [x + tail for x in enc.encode([t or "" for t in part.column("text").to_pylist()])]
                sizes = pa.array([len(x) // enc.dtype.itemsize for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, pa.array(ids, pa.binary())],
                                                 ["doc_id", "n_tokens", "ids"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, IDS)


def _joined(part: pa.RecordBatch, name: str, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(part.column(name).to_pylist()), dtype)


def id_counts(ids: DataFrame, dtype: str) -> dict[int, int]:
    """Times of each id over all documents; at most one entry for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                n = np.bincount(_joined(batch.slice(i, 256), "ids", dtype))
                if len(n) > len(total):
                    total = np.pad(total, (0, len(n) - len(total)))
                total[:len(n)] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], ["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return {r.id: r.n for r in rows}


def code_lengths(counts: dict[int, int], longest: int = LONGEST_CODE) -> dict[int, int]:
    """Lengths of an optimal prefix code with none above ``longest`` (package-merge).

    Ties between equal counts go to the smaller id. One id alone gets one bit; no id, no code.
    """
    items = sorted((n, i) for i, n in counts.items())
    if len(items) <= 1:
        return {i: 1 for _, i in items}
    longest = max(longest, (len(items) - 1).bit_length())
    weight = np.array([n for n, _ in items], np.float64)
    n = len(items)
    # Row by row: coins are the items and the pairs of the row before, by weight.
    rows, current, is_item = [], weight, np.ones(n, bool)
    for _ in range(longest - 1):
        rows.append(is_item)
        paired = current[: len(current) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([weight, paired])
        order = np.argsort(merged, kind="stable")
        current, is_item = merged[order], order < n
    rows.append(is_item)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_item in reversed(rows):
        chosen = int(is_item[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    return {i: int(b) for (_, i), b in zip(items, lengths)}


def canonical(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(code, bits) by id: codes rise with (length, id)."""
    size = max(lengths, default=0) + 1
    code, bits = np.zeros(size, np.uint64), np.zeros(size, np.int64)
    value, before = 0, 0
    for length, i in sorted((b, i) for i, b in lengths.items()):
        value <<= length - before
        code[i], bits[i], before = value, length, length
        value += 1
    return code, bits


def decode_table(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, bits, width): what any ``width`` next bits begin with."""
    width = max(lengths.values(), default=1)
    order = sorted((b, i) for i, b in lengths.items())
    spans = np.array([1 << (width - b) for b, _ in order], np.int64)
    ids = np.repeat(np.array([i for _, i in order], np.uint32), spans)
    bits = np.repeat(np.array([b for b, _ in order], np.uint8), spans)
    return np.pad(ids, (0, (1 << width) - len(ids))), np.pad(bits, (0, (1 << width) - len(bits)), constant_values=1), width


def pack(ids: np.ndarray, sizes: np.ndarray, code: np.ndarray, bits: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Bits of documents laid end to end, each begun at a byte: (bytes, byte offsets, bit offsets of ids)."""
    length = bits[ids]
    ends = np.cumsum(sizes)
    upto = np.concatenate([[0], np.cumsum(length)])
    of_doc = upto[ends] - upto[ends - sizes]
    first = np.concatenate([[0], np.cumsum((of_doc + 7) // 8)])
    at = upto[:-1] + np.repeat(first[:-1] * 8 - upto[ends - sizes], sizes)
    # Codes that begin in the same 32 bits fill 64 bits together, and none shares a bit with another.
    word = at >> 5
    begins = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros((int(first[-1]) + 3) // 4 + 2, np.uint32)
    if len(begins):
        filled = np.bitwise_or.reduceat(code[ids] << (64 - length - (at & 31)).astype(np.uint64), begins)
        out[word[begins]] = filled >> np.uint64(32)
        out[word[begins] + 1] |= (filled & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out.astype(">u4").tobytes()[: int(first[-1])], first, at


def unpack(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """ids of runs that begin at bit ``starts`` and have ``counts`` ids, all decoded in step."""
    ids, bits, width = table
    data = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
    four = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    offset = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")  # runs that end sooner stand last
    at, to, left = starts[order].astype(np.int64), offset[order], counts[order]
    out = np.empty(int(counts.sum()), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for step in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -step, side="left"))
        now = at[:n]
        look = (four[now >> 3] >> (32 - width - (now & 7)).astype(np.uint32)) & mask
        out[to[:n] + step] = ids[look]
        at[:n] = now + bits[look]
    return out


def _coded(ids: DataFrame, code: np.ndarray, bits: np.ndarray, dtype: str, edges: np.ndarray) -> DataFrame:
    """Each document's bits and checkpoints; ``sum`` orders documents that share an id, ``place`` is
    the number of edges at or below the id, 0 for a null one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.asarray(batch.column("n_tokens"))
            slot = np.cumsum(n) // AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1), len(n)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                raw = part.column("ids").to_pylist()
                sizes = n[a:b]
                data, first, at = pack(np.frombuffer(b"".join(raw), dtype), sizes, code, bits)
                ends = np.cumsum(sizes)
                marks = [(at[e - s:e:EVERY] - 8 * f).astype("<i8").tobytes() for s, e, f in zip(sizes, ends, first)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_tokens"), pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                     pa.array([data[x:y] for x, y in zip(first, first[1:])], pa.binary()), pa.array(marks, pa.binary()),
                     pa.array(np.searchsorted(edges, np.asarray(pc.fill_null(part.column("doc_id"), least)), "right").astype(np.int32))],
                    _names(CODED))

    least = int(np.iinfo(np.int64).min)
    return ids.mapInArrow(run, CODED)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, block, first, rows, size = TaskContext.get().partitionId(), 0, 0, [], 0
    names = _names(BLOCKS)

    def made() -> pa.RecordBatch:
        base = np.cumsum([0, *(len(r[3]) for r in rows[:-1])]) * 8
        marks = np.concatenate([np.frombuffer(r[4], "<i8") + b for r, b in zip(rows, base)])
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([size], pa.int64()),
             pa.array([[r[0] for r in rows]], pa.list_(pa.int64())), pa.array([[r[1] for r in rows]], pa.list_(pa.int64())),
             pa.array([b"".join(r[3] for r in rows)], pa.binary()), pa.array([marks.astype("<i8").tobytes()], pa.binary())], names)

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
            rows.append(row)
            size += row[1]
            if size >= BLOCK_IDS:
                yield made()
                block, first, rows, size = block + 1, first + size, [], 0
    if rows:
        yield made()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int = END, longest: int = LONGEST_CODE,
                      remembered: int = MEMORY, batch_bytes: int = BATCH) -> None:
    """Write ``path``/blocks and ``path``/code: ids of every text, in ascending doc_id order.

    ``remembered`` bounds the pieces of text whose ids a worker keeps, about 170 bytes each, and
    ``batch_bytes`` the text that it encodes at a time, about 25 bytes for each.

    A null doc_id comes first. Documents that share a doc_id stand side by side, by the checksum
    of their ids. A null text has the end id alone. No documents give files without blocks.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    work = scratch_path(spark, "token-ids")
    encode_documents(docs, tokenizer, end, remembered, batch_bytes).write.option("compression", "zstd").parquet(work)
    ids = spark.read.schema(IDS).parquet(work)
    dtype = encoder(tokenizer).dtype.str
    forget()  # the driver keeps no vocabulary
    counts = id_counts(ids, dtype)
    lengths = code_lengths(counts, longest)
    code, bits = canonical(lengths)
    spark.createDataFrame(sorted(lengths.items()), "id long, bits int").coalesce(1).write.parquet(f"{path}/code")
    coded_bytes = sum(n * lengths[i] for i, n in counts.items()) // 8
    ranges = max(1, -(-coded_bytes // RANGE_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = ids.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], max(0.1 / ranges, CUT_ERROR)) if ranges > 1 else []
    edges = np.unique(np.array(cuts, np.int64))
    (_coded(ids, code, bits, dtype, edges)
     .repartitionById(len(edges) + 1, F.col("place"))
     .sortWithinPartitions("doc_id", "n_tokens", "sum").drop("place")
     .mapInArrow(_blocks, BLOCKS)
     .write.option("compression", "none").parquet(f"{path}/blocks"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files.

    ``start`` counts the ids of all documents before it in the files.
    """
    bound_batches(spark)
    lengths = {r.id: r.bits for r in spark.read.schema("id long, bits int").parquet(f"{path}/code").collect()}
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    parts = sorted(blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # one row a written partition
    before = np.concatenate([[0], np.cumsum([r.n for r in parts])]).tolist()
    offsets = spark.createDataFrame([(r.part, b) for r, b in zip(parts, before)], "part int, before long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for batch in batches:
            n = np.asarray(batch.column("n_ids"))
            slot = np.cumsum(n) // AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1), len(n)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    yield _read_blocks(batch.slice(a, b - a), table)

    read = blocks.select("part", "block", "first_id", "doc_ids", "n_tokens", "bits", "marks").withColumn(
        "n_ids", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda x, y: x + y)).mapInArrow(run, DOCS)
    return (read.join(F.broadcast(offsets), "part")
            .select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"))


def _read_blocks(batch: pa.RecordBatch, table: tuple) -> pa.RecordBatch:
    col = {n: batch.column(n).to_pylist() for n in batch.schema.names}
    base = np.cumsum([0, *map(len, col["bits"])]) * 8
    starts = np.concatenate([np.frombuffer(m, "<i8") + b for m, b in zip(col["marks"], base)])
    sizes = np.concatenate([np.array(x, np.int64) for x in col["n_tokens"]])
    # Runs of each document: EVERY ids, the last run the rest. Every document has its end id.
    runs = (sizes + EVERY - 1) // EVERY
    counts = np.full(int(runs.sum()), EVERY, np.int64)
    counts[np.cumsum(runs) - 1] = sizes - (runs - 1) * EVERY
    ids = unpack(np.frombuffer(b"".join(col["bits"]), np.uint8), starts, counts, table).astype("<u4")
    ends = np.cumsum(sizes)
    crc = [zlib.crc32(ids[e - s:e]) for s, e in zip(sizes, ends)]
    docs = [len(x) for x in col["doc_ids"]]
    offset = np.concatenate([f + np.cumsum([0, *x[:-1]]) for f, x in zip(col["first_id"], col["n_tokens"])])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(col["part"], docs).astype(np.int32)), pa.array(np.repeat(col["block"], docs).astype(np.int32)),
         pa.array(np.concatenate([np.arange(d) for d in docs]).astype(np.int32)),
         pa.array([d for x in col["doc_ids"] for d in x], pa.int64()), pa.array(offset.astype(np.int64)),
         pa.array(sizes), pa.array(crc, pa.int64())], _names(DOCS))


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None, remembered: int = MEMORY,
                batch_bytes: int = BATCH) -> DataFrame:
    """Write the files (below the session's shared folder if no path is given) and read them back."""
    path = path or scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, remembered=remembered, batch_bytes=batch_bytes)
    return read_token_files(docs.sparkSession, path)
