"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most ``capacity`` ids. Only the histogram of piece lengths (at
most ``capacity`` rows) reaches the driver. There, bin after bin, the longest remaining length is
fixed and a bitset subset-sum dynamic programme over the available lengths finds the fullest
feasible combination, which is removed; equal bins in a row are taken at once, as the programme
would find the same combination while its lengths last. The result is a list of bin patterns;
each length's pieces, ranked by Spark, are dealt to the patterns' slots by interval lookup.

Ranks within a length are counted per (length, salt), so a length held by a third of the pieces is
spread over many tasks.

Defined cases: null and empty texts are one piece (the end id); rows with equal or null ids are
pieces of their own; ties of equal rows are interchangeable; no documents give no pieces; other
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm import tokens
from strata.llm.words import slices
from strata.session import checkpoint_dir


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024,
                 id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if asked, the ids (uint32 bytes).

    Texts longer than ``capacity`` are cut into pieces of ``capacity`` ids; the first may be shorter."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()

    def cut(batches):
        encode = tokens.worker_ids(vocabulary)
        for batch in batches:
            for part in slices(batch, "text", tokens.SLICE):
                row, piece, start, length, crc, raw = [], [], [], [], [], []
                for i, ids in enumerate(encode(part.column(1))):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    first = (len(ids) - 1) % capacity + 1
                    edges = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        data = ids[a:b].tobytes()
                        row.append(i), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(data))
                        if keep_ids:
                            raw.append(data)
                cols = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    cols, names = [*cols, pa.array(raw, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(cut, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum that fits in ``room``."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if counts[x] and x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:  # bounded multiplicities as powers of two
            k = min(k, left)
            steps.append((reach, length, k))
            reach |= (reach << (length * k)) & mask
            left, k = left - k, 2 * k
        if reach >> room:
            break
    at, chosen = reach.bit_length() - 1, {}
    for before, length, k in reversed(steps):
        if not before >> at & 1:
            at -= length * k
            chosen[length] = chosen.get(length, 0) + k
    return chosen


def bin_patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(length -> pieces per bin, number of bins)] that uses up every piece."""
    counts = {x: n for x, n in counts.items() if n}
    patterns = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        pattern = fullest(counts, capacity - longest)
        counts[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(counts[x] // n for x, n in pattern.items())
        for x, n in pattern.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        patterns.append((pattern, times))
    return patterns


def pack(pieces: DataFrame, order: list[str], capacity: int = 1024) -> DataFrame:
    """``pieces`` (with a ``length`` column, read several times: hand in a checkpoint) plus
    sequence_id and offset. ``order`` columns settle the order among pieces of one length."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, used, sequence = [], dict.fromkeys(counts, 0), 0
    for pattern, times in bin_patterns(counts, capacity):
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            slots.append((length, used[length], used[length] + n * times, n, sequence, offset))
            used[length] += n * times
            offset += n * length
        sequence += times
    # at most a few rows for each length: the patterns' slots
    slots_df = spark.createDataFrame(slots, "s_length long, s_from long, s_to long, s_n long, s_sequence long, s_offset long")
    salts = 64 + max(counts.values(), default=0) // 10_000
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*order)) - 1)
    before = (salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
              .withColumn("__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("__n")).drop("__n"))
    placed = ranked.join(before, ["length", "__salt"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    # interval lookup: the slots of one length as a sorted array, one row per length
    per_length = slots_df.groupBy("s_length").agg(F.array_sort(F.collect_list(F.struct("s_from", "s_to", "s_n", "s_sequence", "s_offset"))).alias("__slots"))
    placed = placed.join(F.broadcast(per_length), F.col("length") == F.col("s_length"))
    slot = F.filter("__slots", lambda s: (s["s_from"] <= F.col("__rank")) & (F.col("__rank") < s["s_to"]))[0]
    placed = placed.withColumn("__slot", slot).withColumn("__k", F.col("__rank") - F.col("__slot.s_from"))
    n = F.col("__slot.s_n")
    return placed.select(*pieces.columns,
                         (F.col("__slot.s_sequence") + F.floor(F.col("__k") / n)).cast("long").alias("sequence_id"),
                         (F.col("__slot.s_offset") + F.col("__k") % n * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    checkpoint_dir(docs.sparkSession)
    pieces = token_pieces(docs, vocabulary, end_id, capacity, id_col, text_col).checkpoint()
    return pack(pieces, [id_col, "piece", "start", "ids_crc32"], capacity)
