"""Token counts by a map-side two-tier lookup.

First tier: a compact sorted table (64-bit hash, length) of the most frequent pre-token units of
the whole corpus, broadcast; its size is the parameter ``table_size``. Each task of the first pass
counts all its units and sends on only its ``per_task`` most frequent ones, so no pre-token is
shuffled. Second tier: units missing from the table are encoded by the library once per worker
cache. The table changes speed, never a count.

Defined cases: null or empty text has 0 bytes and 0 tokens; rows stay one to one with the input
(repeated ids or texts and null ids included); other columns are ignored; an empty table gives an
empty result; texts of any length are counted whole.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import tokens
from strata.llm.words import slices


def frequent_units(docs: DataFrame, path: str, table_size: int = 65_536, per_task: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(sorted unit hashes, token counts) of the most frequent units; at most ``table_size``."""

    def count(batches):
        seen: Counter = Counter()
        text: dict[int, str] = {}
        for batch in batches:
            for part in slices(batch, "text", tokens.SLICE):
                col = part.column(0)
                u = tokens.Units(col, spaces=False, lower=True)
                keep = np.flatnonzero(~tokens.whole_rows(col, path)[u.row])
                h, at, n = np.unique(u.hash[keep], return_index=True, return_counts=True)
                twice = np.flatnonzero(n > 1)  # in this slice; a frequent unit is
                for k, i, c in zip(h[twice].tolist(), keep[at[twice]].tolist(), n[twice].tolist(), strict=True):
                    if k not in text:
                        text[k] = u.text(i)
                    seen[k] += c
                if len(seen) > 10 * per_task:
                    seen = Counter(dict(seen.most_common(5 * per_task)))
                    text = {k: text[k] for k in seen}
        top = seen.most_common(per_task)
        yield pa.RecordBatch.from_pydict({"unit": pa.array([text[k] for k, _ in top], pa.string()),
                                          "h": pa.array([k - 2**63 for k, _ in top], pa.int64()),
                                          "n": pa.array([c for _, c in top], pa.int64())})

    rows = (docs.select("text").mapInArrow(count, "unit string, h long, n long")
            .groupBy("h").agg(F.sum("n").alias("n"), F.min("unit").alias("unit"))
            .orderBy(F.desc("n"), "h").limit(table_size).collect())
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.array([r["h"] + 2**63 for r in rows], dtype=np.uint64)
    n = np.array([len(e) for e in tokens.load(path).encode_batch_fast([r["unit"] for r in rows], add_special_tokens=False)], dtype=np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 2048, table_size: int = 65_536) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    table = docs.sparkSession.sparkContext.broadcast(frequent_units(docs, vocabulary, table_size))

    def count(batches):
        counts = tokens.Counts(vocabulary, table.value)
        for batch in batches:
            for part in slices(batch, "text", tokens.SLICE):
                n = counts(part.column(1))
                size = pa.compute.binary_length(part.column(1).cast(pa.large_binary()).fill_null(b"")).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(n), pa.array(n > limit)],
                                                 names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(count, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
