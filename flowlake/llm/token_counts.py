"""Token counts: lengths only, from texts encoded in Arrow batches (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import bound_batches, pieces
from flowlake.llm.encode import BATCH, encoder

LIMIT = 1024


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, batch_bytes: int = BATCH) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; no shuffle, ids never leave the worker.

    ``tokenizer`` is the path of a vocabulary file that every executor has: ``.json`` for the
    tokenizers library, ``.model`` for sentencepiece. Strings of special tokens inside a text are
    handled as the library does by default. Batches are cut to about ``batch_bytes`` bytes, and
    long texts at blanks between other characters, where no token can reach across. A null text
    counts as empty: 0 bytes and tokens. Repeated rows are counted each. Other columns are ignored.
    """
    bound_batches(docs.sparkSession, batch_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer)
        for batch in batches:
            for part in pieces(batch, batch_bytes):
                texts = [t or "" for t in part.column("text").to_pylist()]
                sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), sizes, pa.array(count(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > F.lit(limit)))


def _counter(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)] if texts else []
    enc = encoder(path)
    return lambda texts: [len(x) // enc.dtype.itemsize for x in enc.encode(texts)]
