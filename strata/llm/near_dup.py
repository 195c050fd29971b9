"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, stars.

Each document's set of word shingles is hashed once; the smallest hash of each of ``bins`` parts of
the hash space is its signature, and an empty bin copies the bin that a fixed random sequence
reaches first (optimal densification). Bands of the signature are buckets. Equal sets are
collapsed to one representative before any bucket is built.

In each bucket one document, drawn by hash, is the centre of a star: one candidate pair per member,
whatever the bucket's size. Pairs are confirmed on the full sets. Large groups of copies are then
one component each. Buckets whose members still lie in different components are finished by an
exact prefix join of those members: shingles are ordered by their number of sets, rarest first, and two
sets that link share one of the first n - ceil(threshold * n) + 1 of each. Only pairs of different
components whose sizes and positions allow the threshold are made; sets that differ from a group by
shingles of their own end before the shingles which the group shares. So no link found by the
bands is lost, no bucket is compared pair by pair, and no estimate leaves out a pair.

A shingle's largest component is never paired with itself: the other members are the one side of the
join, copied once per SALT members of the whole, so that a shingle of very many sets is many keys.

Defined cases: null texts and texts without words have the empty set and link with nothing; null ids
link with nothing (component null, kept); rows with equal ids are one document that links if any
of its texts does; rows stay one to one; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.words import NOT_SPACE, Words, distinct, mix, powers, sequence_hash, slices
from strata.session import checkpoint_dir

SALT = 4096  # sets per key of the prefix join
_PROBES: dict[int, np.ndarray] = {}


def probes(bins: int) -> np.ndarray:
    """For each empty bin the fixed sequence of bins to copy from."""
    if bins not in _PROBES:
        rng = np.random.Generator(np.random.PCG64(77))
        _PROBES[bins] = rng.integers(0, bins, (16 * bins, bins))
    return _PROBES[bins]


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes; a text of fewer words is one shingle."""
    at, h = w.windows(k)
    cut = np.searchsorted(at, w.first)  # windows begin in their row
    out = []
    for r, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
        if b > a:
            out.append(distinct(h[a:b]))
        elif w.count[r]:
            out.append(np.array([sequence_hash(w.hash[w.first[r]:w.first[r + 1]])], dtype=np.uint64))
        else:
            out.append(h[:0])
    return out


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One-permutation signatures (rows of ``bins`` values) of sets that aren't empty."""
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    part = (every >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    row = np.repeat(np.arange(len(sets)), sizes)
    place = row * bins + part
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))  # sorted sets: the smallest of its bin
    sig = np.zeros(len(sets) * bins, dtype=np.uint64)
    full = np.zeros(len(sets) * bins, dtype=bool)
    sig[place[first]], full[place[first]] = every[first], True
    sig, full = sig.reshape(-1, bins), full.reshape(-1, bins)
    out, todo = sig.copy(), ~full
    rows = np.arange(len(sets))
    for probe in probes(bins):
        if not len(rows):
            break
        hit = todo[rows] & full[np.ix_(rows, probe)]
        r, c = np.nonzero(hit)
        out[rows[r], c] = sig[rows[r], probe[c]]
        todo[rows[r], c] = False
        rows = rows[todo[rows].any(axis=1)]
    for r in rows:  # beyond all probes: the next full bin
        at = np.flatnonzero(full[r])
        for c in np.flatnonzero(todo[r]):
            out[r, c] = sig[r, at[np.searchsorted(at, c) % len(at)]]
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` values."""
    bands = sig.shape[1] // rows
    total = (sig.reshape(len(sig), bands, rows) * powers(0xC2B2AE3D27D4EB4F, rows)).sum(axis=2, dtype=np.uint64)
    return mix(total + mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _signed(docs: DataFrame, shingle: int, bins: int, rows: int) -> DataFrame:
    """(id, n_shingles, same binary, bands array<long>); no words: nulls."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(Words(part.column(1), NOT_SPACE, lower=True), shingle)
                some = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                same: list = [None] * len(sets)
                if some:
                    for i, k in zip(some, band_keys(signatures([sets[i] for i in some], bins), rows).view(np.int64), strict=True):
                        keys[i] = k
                        same[i] = np.array([mix(sets[i]).sum(dtype=np.uint64), mix(sets[i] + np.uint64(len(sets[i]))).sum(dtype=np.uint64)]).tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(same, pa.binary()),
                                                  pa.array(keys, pa.list_(pa.int64()))], names=["id", "n_shingles", "same", "bands"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n_shingles long, same binary, bands array<long>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(Words(part.column(1), NOT_SPACE, lower=True), shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, shingles binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                common = int(np.count_nonzero(q[at] == p))
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    size = F.length("shingles")
    members = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"), size.alias("nb")), "b")
    both = members.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"), size.alias("na")), "a")
    both = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return both.select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, component): the smallest vertex reachable; ``edges`` (a, b) should be a checkpoint.

    Labels take the smallest of their neighbours' and then jump to their label's label."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
    labels = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("component")).checkpoint()
    while True:
        near = both.join(labels.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("component").alias("near"))
        step = labels.join(near, "v").select("v", F.col("component").alias("old"), F.least("component", "near").alias("to"))
        jump = labels.select(F.col("v").alias("to"), F.col("component").alias("far"))
        new = step.join(jump, "to", "left").select("v", "old", F.least("to", F.coalesce("far", "to")).alias("component")).checkpoint()
        changed = new.where("old != component").limit(1).count()
        labels = new.drop("old")
        if not changed:
            return labels


def _merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``labels`` (rep, component) after the links ``found`` (a, b), a checkpoint. Only components that a
    link joins to another take part in the search for the new ones."""
    a, b = (labels.select(F.col("rep").alias(x), F.col("component").alias(f"c{x}")) for x in ("a", "b"))
    links = found.join(a, "a").join(b, "b").where("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct().checkpoint()
    if links.isEmpty():
        return labels
    new = components(links).select(F.col("v").alias("component"), F.col("component").alias("to"))
    return labels.join(new, "component", "left").select("rep", F.coalesce("to", "component").alias("component")).checkpoint()


def _tokens(sets: DataFrame) -> DataFrame:
    """(rep, component, set, n, token): one row per shingle of ``sets`` (rep, component, set, shingles)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "shingles"):
                every = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(3)]
                sizes = np.array([len(x) for x in every])
                row = pa.array(np.repeat(np.arange(len(every)), sizes))
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(row) for i in range(3)), pa.array(np.repeat(sizes, sizes)),
                                                  pa.array(np.concatenate(every))], names=["rep", "component", "set", "n", "token"])

    kind = sets.schema["rep"].dataType.simpleString()
    return sets.select("rep", "component", "set", "shingles").mapInArrow(run, f"rep {kind}, component {kind}, set long, n long, token long")


def prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``sets`` (rep, component, set, shingles; a rep may have several sets, told apart by
    ``set``), among them all of different components that link."""
    tokens = _tokens(sets)
    held = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    # shingles of one set come first and pair with nothing: only their number matters
    shared = tokens.join(held, "token").groupBy("rep", "set").agg(
        F.first("component").alias("component"), F.first("n").alias("n"), F.sort_array(F.collect_set(F.struct("df", "token"))).alias("shared"))
    alone = (F.col("n") - F.size("shared")).alias("alone")
    length = F.floor(F.col("n") * (100 - percent) / 100) + 1
    first = shared.select("rep", "component", "n", alone, F.slice("shared", F.lit(1), F.greatest(length - alone, F.lit(0)).cast("int")).alias("shared"))
    prefix = first.select("rep", "component", "n", "alone", F.posexplode("shared").alias("at", "e"))
    prefix = prefix.select("rep", "component", "n", F.col("e.token").alias("token"), (F.col("n") - F.col("alone") - F.col("at")).alias("rest")).checkpoint()
    by = prefix.groupBy("token", "component").agg(F.count("*").alias("c"))
    mixed = by.groupBy("token").agg(F.max_by("component", "c").alias("main"), F.sum("c").alias("size"), F.count("*").alias("k")).where("k > 1")
    placed = prefix.join(mixed.drop("k"), "token")
    salts = F.floor(F.col("size") / SALT)
    x = placed.where("component != main").select("token", F.explode(F.sequence(F.lit(0).cast("long"), salts)).alias("salt"),
                                                 F.col("rep").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("rest").alias("ra"))
    y = placed.select("token", F.pmod(F.xxhash64("rep"), salts + 1).alias("salt"), F.col("rep").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("rest").alias("rb"))
    most = F.least("ra", "rb")  # shingles that both can share, from this one on
    near = x.join(y, ["token", "salt"]).where((F.col("ca") != F.col("cb")) & ((100 + percent) * most >= percent * (F.col("na") + F.col("nb"))))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 75, bins: int = 128, rows: int = 4,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = _signed(docs, shingle, bins, rows).checkpoint()
    sets_of = signed.where("id IS NOT NULL AND same IS NOT NULL")
    reps = sets_of.groupBy("same").agg(F.min("id").alias("rep"), F.any_value("bands").alias("bands"))
    rows_in = reps.select("rep", F.explode("bands").alias("key"))
    order = F.xxhash64("rep", "key")
    buckets = rows_in.groupBy("key").agg(F.min_by("rep", order).alias("centre"), F.min("rep").alias("x"), F.max("rep").alias("y"))
    members = rows_in.join(buckets.where("x != y").drop("x", "y"), "key").checkpoint()  # only buckets with two documents
    labels = members.select("rep").distinct().withColumn("component", F.col("rep")).checkpoint()
    sets = _sets(docs.join(labels.select(F.col("rep").alias("id")), "id"), shingle).checkpoint()

    pairs = members.where("rep != centre").select(F.least("centre", "rep").alias("a"), F.greatest("centre", "rep").alias("b")).distinct()
    labels = _merged(labels, confirm(pairs, sets, percent).checkpoint())
    placed = members.join(labels, "rep")
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y")
    left = placed.join(mixed.select("key"), "key").select("rep", "component").distinct()
    left = left.join(sets.select(F.col("id").alias("rep"), F.xxhash64("shingles").alias("set"), "shingles"), "rep")
    labels = _merged(labels, confirm(prefix_pairs(left, percent), sets, percent).checkpoint())
    rep = sets_of.groupBy("same").agg(F.min("id").alias("rep"))
    of = rep.join(labels, "rep", "left").select("same", F.coalesce("component", "rep").alias("component_id"))
    out = signed.drop("bands").join(of, "same", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
