"""Training-order materialisation of token ids in fixed-stride binary shards.

Documents are tokenised once; each task's documents, one after another with an end id between them,
are cut into sequences of ``stride`` ids (the last one is padded with the end id). The sequences
are numbered 0 .. n - 1 by task and place. A keyed Feistel permutation of the next power of four,
walked along its cycle until it falls below n, gives each number its slot in training order.
Slots are dense, so contiguous ranges of ``per_shard`` slots are the shards: one task gathers one
range and writes one file of ``per_shard`` records of equal size. A reader finds slot s in file
s // per_shard at byte (s % per_shard) * record, and so can begin or resume anywhere.

Only numbers per task reach the driver. Files are written under a name of the attempt and moved, so
a repeated task replaces its file with the same bytes.

Defined cases: null and empty texts are one end id; rows with equal or null ids are documents of
their own; an empty table gives no sequence and no shard; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import tokens
from strata.llm.words import mix, slices
from strata.session import checkpoint_dir

ROUNDS = 6
CACHE = 700_000  # units whose ids a worker keeps: about 150 MB


class Feistel:
    """A keyed permutation of 0 .. n - 1."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % 2**64))

    def _once(self, x: np.ndarray, keys) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & self.mask)
        return left << self.half | right

    def slot(self, number: np.ndarray) -> np.ndarray:
        x = self._once(number.astype(np.uint64), self.keys)
        while (out := x >= self.n).any():  # cycle-walking
            x[out] = self._once(x[out], self.keys)
        return x.astype(np.int64)

    def number(self, slot: np.ndarray) -> np.ndarray:
        """The inverse of ``slot``."""
        back = lambda x: self._swap(self._once(self._swap(x), self.keys[::-1]))
        x = back(slot.astype(np.uint64))
        while (out := x >= self.n).any():
            x[out] = back(x[out])
        return x.astype(np.int64)

    def _swap(self, x: np.ndarray) -> np.ndarray:
        return (x & self.mask) << self.half | x >> self.half


def _compressed(a: np.ndarray) -> bytes:
    import zstandard
    return zstandard.ZstdCompressor(level=6).compress(a.tobytes())


def _restored(b: bytes, dtype: str) -> np.ndarray:
    import zstandard
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=dtype)


def sequences(docs: DataFrame, vocabulary: str, stride: int, end_id: int, dtype: str, text_col: str = "text", rows: int = 4096) -> DataFrame:
    """(part, first, n, last, ids): runs of up to ``rows`` numbered sequences, ids compressed; ``last`` is
    the number of ids in the run's last sequence."""

    def cut(batches):
        encode = tokens.worker_ids(vocabulary, CACHE)
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        end = np.array([end_id], dtype=dtype)

        def row(ids, n, last):
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([n], pa.int64()),
                                               pa.array([last], pa.int64()), pa.array([_compressed(ids)], pa.binary())], names=["part", "first", "n", "last", "ids"])

        for batch in batches:
            for some in slices(batch, "text", tokens.SLICE):
                for ids in encode(some.column(0)):
                    held += [ids.astype(dtype), end]
                    size += len(ids) + 1
                while size >= stride * rows:
                    flat = np.concatenate(held)
                    yield row(flat[:stride * rows], rows, stride)
                    number, held, size = number + rows, [flat[stride * rows:]], size - stride * rows
        if size:
            n = -(-size // stride)
            yield row(np.concatenate([*held, np.full(n * stride - size, end_id, dtype=dtype)]), n, size - (n - 1) * stride)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(cut, "part long, first long, n long, last long, ids binary")


def write_shards(docs: DataFrame, vocabulary: str, folder: str | None = None, stride: int = 1024, per_shard: int = 4096, end_id: int = 50256,
                 key: int = 20240229, text_col: str = "text") -> DataFrame:
    """Writes the shards when evaluated; one row per sequence: slot, shard, byte_offset, number, n_tokens, ids_crc32.

    ``folder``: a URI that pyarrow's file systems can write on every executor (default: a new folder
    under the session's checkpoint folder)."""
    spark = docs.sparkSession
    shared = checkpoint_dir(spark)
    folder = folder or f"{shared}/token-shards-{uuid.uuid4().hex}"
    dtype = "<u2" if max(tokens.load(vocabulary).get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else "<u4"
    record = stride * np.dtype(dtype).itemsize
    runs = sequences(docs, vocabulary, stride, end_id, dtype, text_col).checkpoint()
    base, total = {}, 0
    for r in runs.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        base[r["part"]], total = total, total + r["n"]
    permutation = Feistel(total, key)
    bases = spark.sparkContext.broadcast(base)
    shards = -(-total // per_shard)
    manifest = {"sequences": total, "stride": stride, "per_shard": per_shard, "dtype": dtype, "key": key, "end_id": end_id, "shards": shards}
    _put(folder, "manifest.json", json.dumps(manifest).encode())

    def deal(batches):
        for batch in batches:
            for part, first, n, last, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                number = bases.value[part] + first + np.arange(n)
                slot = permutation.slot(number)
                table = _restored(ids, dtype).reshape(n, stride)
                real = np.full(n, stride)
                real[-1] = last
                order = np.argsort(slot)
                for at in np.split(order, np.flatnonzero(np.diff(slot[order] // per_shard)) + 1):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([int(slot[at[0]] // per_shard)], pa.int32()),
                        pa.array([np.stack([slot[at], number[at], real[at]]).astype("<i8").tobytes()], pa.binary()),
                        pa.array([_compressed(table[at])], pa.binary())], names=["shard", "places", "ids"])

    def write(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for shard, places, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(shard, []).append((places, ids))
        for shard in sorted(held):
            rows = held.pop(shard)
            place = np.concatenate([np.frombuffer(p, "<i8").reshape(3, -1) for p, _ in rows], axis=1)
            at = place[0] - shard * per_shard
            out = np.zeros((len(at), stride), dtype=dtype)
            done = 0
            for p, ids in rows:
                n = len(p) // 24
                out[at[done:done + n]] = _restored(ids, dtype).reshape(n, stride)
                done += n
            _put(folder, f"shard-{shard:08d}.bin", out.tobytes())
            order = np.argsort(at)
            slot, number, real = place[:, order]
            crc = [zlib.crc32(r.tobytes()) for r in out]
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.full(len(slot), shard, np.int32)), pa.array(at[order] * record), pa.array(number),
                                              pa.array(real), pa.array(crc, pa.int64())], names=["slot", "shard", "byte_offset", "number", "n_tokens", "ids_crc32"])

    dealt = runs.mapInArrow(deal, "shard int, places binary, ids binary").repartitionById(max(1, shards), F.col("shard"))
    return dealt.mapInArrow(write, "slot long, shard int, byte_offset long, number long, n_tokens long, ids_crc32 long")


def _system(folder: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _put(folder: str, name: str, data: bytes) -> None:
    system, path = _system(folder)
    system.create_dir(path, recursive=True)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as f:
        f.write(data)
    system.move(own, f"{path}/{name}")


def read_slots(folder: str, start: int = 0, stop: int | None = None) -> Iterator[np.ndarray]:
    """The sequences of slots start .. stop - 1, in training order."""
    system, path = _system(folder)
    with system.open_input_file(f"{path}/manifest.json") as f:
        m = json.loads(f.read())
    record = m["stride"] * np.dtype(m["dtype"]).itemsize
    stop = m["sequences"] if stop is None else min(stop, m["sequences"])
    while start < stop:
        shard, at = divmod(start, m["per_shard"])
        with system.open_input_file(f"{path}/shard-{shard:08d}.bin") as f:
            f.seek(at * record)
            while start < min(stop, (shard + 1) * m["per_shard"]):
                yield np.frombuffer(f.read(record), dtype=m["dtype"])
                start += 1
