"""Exchanges of compact key arrays between chunks of documents.

Documents are packed into chunks (compressed Arrow tables of a few MB), checkpointed once and
partitioned by chunk. A round sends, for every chunk and every bucket of the hash space, one row
with the chunk's distinct keys of that bucket as a sorted array (so a key that a third of the
documents share is one entry per chunk), answers each entry with one bit in the bucket's task,
and joins the answers back to the chunks. Chunks are parsed anew in each round: parsing whole
texts is cheaper than keeping states of several bytes per byte of text.

The number of buckets follows the bytes of text, so a bucket's task holds a bounded share of keys.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.words import slices
from strata.session import checkpoint_dir

CHUNK = 4 << 20
BUCKET = 4 << 20  # bytes of text for each bucket of keys
LAST = np.int64(2**63 - 1)  # stands for a null id: after every other document


class Chunks:
    """``data``: checkpointed rows (chunk long, docs binary); ``answers``: one column per round."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK, bucket_bytes: int = BUCKET):
        spark = docs.sparkSession
        checkpoint_dir(spark)
        docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        self.id_type = docs.schema["id"].dataType.simpleString()
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        packed = docs.mapInArrow(lambda it: _packed(it, chunk_bytes), "chunk long, size long, docs binary").repartition(parts, "chunk")
        # without adaptive execution the checkpoint keeps its partitioning, and joins on chunk don't move the texts
        adaptive = spark.conf.get("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            self.data = packed.checkpoint()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        total = self.data.agg(F.sum("size")).first()[0] or 0
        self.buckets = max(64, math.ceil(total / bucket_bytes))
        self.rounds: list[str] = []

    def exchange(self, emit: Callable, answer: Callable[[list[np.ndarray], list[np.ndarray]], list[np.ndarray]], value_type: str, key_bytes: int = 8) -> None:
        """One round. ``emit(table, answers)`` gives (sorted distinct uint64 keys, values or None) of a
        chunk; ``answer(keys, values)`` gives for each chunk's arrays a mask (or several, one after the
        other), kept as bits in key order."""
        n = self.buckets

        def send(batches):
            for chunk, table, answers in _chunks(batches):
                keys, values = emit(table, answers)
                cut = np.searchsorted(keys, _edges(n))
                rows = [(b, x, y) for b, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if y > x]
                low = keys.astype("<u8") if key_bytes == 8 else keys.astype("<u4")
                yield pa.RecordBatch.from_arrays([
                    pa.array([b for b, _, _ in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()),
                    pa.array([low[x:y].tobytes() for _, x, y in rows], pa.binary()),
                    pa.array([b"" if values is None else np.ascontiguousarray(values[x:y]).tobytes() for _, x, y in rows], pa.binary())], names=["bucket", "chunk", "k", "v"])

        def reply(table: pa.Table) -> pa.Table:
            keys = [np.frombuffer(x, dtype="<u8" if key_bytes == 8 else "<u4") for x in table["k"].to_pylist()]
            values = [np.frombuffer(x, dtype=value_type) for x in table["v"].to_pylist()]
            bits = [np.packbits(m).tobytes() for m in answer(keys, values)]
            return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})

        sent = self.current().mapInArrow(send, "bucket int, chunk long, k binary, v binary")
        replies = (sent.groupBy("bucket").applyInArrow(reply, "chunk long, bucket int, bits binary")
                   .groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "bits"))).alias(f"r{len(self.rounds)}")))
        self.data_answers(replies.checkpoint())

    def data_answers(self, replies: DataFrame) -> None:
        self.rounds.append(f"r{len(self.rounds)}")
        self.answers = replies if len(self.rounds) == 1 else self.answers.join(replies, "chunk", "left")

    def current(self) -> DataFrame:
        """Chunks with the answers of all rounds so far (one array of bits per round)."""
        if not self.rounds:
            return self.data.select("chunk", "docs")
        return self.data.select("chunk", "docs").join(self.answers, "chunk", "left")

    def finish(self, make: Callable, schema: str, id_name: str) -> DataFrame:
        """``make(table, answers)`` gives the columns after the id of one row per document."""

        def run(batches):
            for _, table, answers in _chunks(batches):
                yield from (pa.RecordBatch.from_arrays([part["id"].combine_chunks(), *cols], names=[id_name, *names]) for part, names, cols in make(table, answers))

        return self.current().mapInArrow(run, f"`{id_name}` {self.id_type}, {schema}")


def _packed(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def row():
        sink = pa.BufferOutputStream()
        table = pa.Table.from_batches(held)
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as w:
            w.write_table(table.combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([task << 32 | number], pa.int64()), pa.array([size], pa.int64()),
                                           pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "size", "docs"])

    for batch in batches:
        for part in slices(batch, "text", chunk_bytes):
            if held and size + part.nbytes > 1.25 * chunk_bytes:
                yield row()
                number, held, size = number + 1, [], 0
            held.append(part)
            size += part.nbytes
    if held:
        yield row()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, list[np.ndarray]]]:
    """(chunk, its table, per round the answer bits in key order as one array)."""
    for batch in batches:
        for i in range(batch.num_rows):
            table = pa.ipc.open_stream(batch.column(1)[i].as_buffer()).read_all()
            answers = []
            for c in batch.columns[2:]:
                answers.append([(x["bucket"], x["bits"]) for x in c[i].as_py() or []])
            yield batch.column(0)[i].as_py(), table, answers


def _edges(buckets: int) -> np.ndarray:
    """Lower bounds of the buckets in the space of 64-bit keys; the last one is beyond every search."""
    step = 2**64 // buckets
    return np.array([min(i * step, 2**64 - 1) for i in range(buckets)] + [2**64 - 1], dtype=np.uint64)


def bits_of(keys: np.ndarray, answer: list[tuple[int, bytes]], buckets: int, width: int = 1) -> np.ndarray:
    """The round's answer (``width`` masks) for each of the chunk's sorted distinct keys."""
    cut = np.searchsorted(keys, _edges(buckets))
    out = np.zeros((width, len(keys)), dtype=bool)
    for b, bits in answer:
        x, y = cut[b], cut[b + 1]
        out[:, x:y] = np.unpackbits(np.frombuffer(bits, np.uint8), count=width * (y - x)).reshape(width, y - x)
    return out if width > 1 else out[0]


def in_two(keys: list[np.ndarray], _: list[np.ndarray]) -> list[np.ndarray]:
    """Answer: the key came from two chunks or more."""
    every = np.concatenate(keys)
    _, back, n = np.unique(every, return_inverse=True, return_counts=True)
    return np.split(n[back] > 1, np.cumsum([len(k) for k in keys])[:-1])


def documents(ids: pa.ChunkedArray) -> np.ndarray:
    """Ids as comparable integers; null is last."""
    return ids.combine_chunks().cast(pa.int64()).fill_null(int(LAST)).to_numpy(zero_copy_only=False)


def first_of(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, an index of each in the input, the smallest document of each, place of each
    input key in them, whether a key came from two documents)."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    begin = np.flatnonzero(fresh)
    back = np.empty(len(keys), dtype=np.int64)
    back[order] = np.cumsum(fresh) - 1
    if not len(keys):
        none = np.zeros(0, np.int64)
        return keys, none, none, none, np.zeros(0, bool)
    low, high = np.minimum.reduceat(docs[order], begin), np.maximum.reduceat(docs[order], begin)
    return ranked[begin], order[begin], low, back, low < high


def one_value(back: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    """Each key's value if all its entries agree, else 0."""
    some = np.zeros(n, dtype=values.dtype)
    some[back] = values
    differs = np.zeros(n, dtype=bool)
    differs[back[some[back] != values]] = True
    some[differs] = 0
    return some


def uniform(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each entry: all entries of its key agree in a value other than 0."""
    known, back = np.unique(keys, return_inverse=True)
    return one_value(back, len(known), values)[back] != 0


def smaller(keys: np.ndarray, checks: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each entry: another entry with the same key and check has a smaller document."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.lexsort((docs, checks, keys))
    k, c, d = keys[order], checks[order], docs[order]
    fresh = np.ones(len(k), dtype=bool)
    fresh[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    out = np.empty(len(k), dtype=bool)
    out[order] = d > d[fresh][np.cumsum(fresh) - 1]
    return out
