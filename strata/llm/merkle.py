"""Merkle manifest of a table as a persistent tree with path copying.

Every row is a leaf: the SHA-256 of its fields. Leaves of one group (a source) ascend by id; ``FAN``
consecutive nodes become one node until a single one remains, the group's subroot, and the subroots,
ordered by group, become the root in the same way.

The tree is built in aligned blocks of ``FAN ** HEIGHT`` nodes: a task hashes a block up to its top and
passes on only that, so each round leaves a ``FAN ** HEIGHT``-th of the nodes and no group, however
large, is held by one task. On the way down every block gets the siblings between its top and
the root. A changed leaf then makes a version: the ancestors inside its block are copied, all other nodes are
shared with the first version, and the copies go on through the upper rounds' shared siblings to
a root of their own. No version copies more than the path above its leaf.

Places of leaves come from range partitions: only the number of rows in each partition's last group,
one row per partition, reaches the driver.

Defined cases: a null field is ``-``, any other its UTF-8 byte count, ``:`` and its value, so null and empty
differ; null groups are one group, the first; null ids come first in a group and equal ids ascend by
leaf, so repeated rows are leaves of their own; texts of any length are hashed whole in the JVM; an
empty table has no root and gives no rows; columns that are not named as fields are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.session import checkpoint_dir

FAN = 3
HEIGHT = 5
SPAN = FAN ** HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Iterable[Column]) -> Column:
    """The binary digest of the fields."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256))


def node(children: Iterable[bytes]) -> bytes:
    """The digest of nodes, which count as hex text."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Consecutive rows with equal first two columns (tree and block); at most SPAN + 1 rows."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:2] != held[0][:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _up(digests: list[bytes]) -> list[list[bytes]]:
    """The levels of one block, from its nodes to its top."""
    levels = [digests]
    while len(levels) <= HEIGHT and len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([node(last[i:i + FAN]) for i in range(0, len(last), FAN)])
    return levels


def _block(digests: list[bytes], number: int) -> list[list[bytes]]:
    """All levels of block ``number``: HEIGHT of them, but a first block ends with a single node, as its
    tree has no other block unless it is full."""
    levels = _up(digests)
    while number and len(levels) <= HEIGHT:
        levels.append([node(levels[-1])])
    return levels


def _siblings(levels: list[list[bytes]], i: int) -> tuple[list[bytes], list[bytes]]:
    """Digests left and right of node i's path in its runs, one joined value per level."""
    left, right = [], []
    for level in levels[:-1]:
        a = i - i % FAN
        left.append(b"".join(level[a:i]))
        right.append(b"".join(level[i + 1:a + FAN]))
        i //= FAN
    return left, right


def _dealt(nodes: DataFrame) -> DataFrame:
    """Nodes by tree and block, in order inside."""
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _tops(nodes: DataFrame) -> DataFrame:
    """The top of every block as a node (tree, pos, digest, level) of the next round."""
    out = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("digest", pa.binary()), ("level", pa.int32())])

    def tops(batches):
        for r in _runs(batches):
            levels = _block([x[3] for x in r], r[0][1])
            yield r[0][0], r[0][1], levels[-1][0], r[0][4] + len(levels) - 1

    cols = nodes.select("tree", F.expr(f"pos div {SPAN}").alias("block"), "pos", "digest", "level")
    return _dealt(cols).mapInArrow(lambda b: _batches(tops(b), out), "tree string, pos long, digest binary, level int")


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """The nodes of each round, up to one node per tree."""
    rounds = [nodes.select("tree", "pos", "digest", F.lit(0).alias("level"))]
    while True:
        rounds.append(_tops(rounds[-1]).checkpoint())
        if rounds[-1].where("pos > 0").isEmpty():
            return rounds


PATH = "lefts array<binary>, rights array<binary>, subroot binary, root binary"


def _with_paths(nodes: DataFrame, paths: DataFrame, extra: list[str], make, schema: str, out: pa.Schema) -> DataFrame:
    """Blocks of nodes, each with its top's path, through ``make(path, rows, levels)``."""
    kinds = {c: t for c, t in nodes.dtypes}
    below = nodes.select("tree", F.expr(f"pos div {SPAN}").alias("block"), "pos", "digest", *extra, *_nulls(PATH))
    tops = paths.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"),
                        *[F.lit(None).cast(kinds[c]).alias(c) for c in extra], "lefts", "rights", "subroot", "root")

    def rows(batches):
        for top, *inside in _runs(batches):
            yield from make(top[-4:], inside, _block([x[3] for x in inside], top[1]))

    return _dealt(below.unionByName(tops)).mapInArrow(lambda b: _batches(rows(b), out), schema)


def _nulls(schema: str) -> list[Column]:
    return [F.lit(None).cast(kind).alias(name) for name, kind in (x.split(" ") for x in schema.split(", "))]


_PATHS = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("name", pa.string()), ("lefts", pa.list_(pa.binary())),
                    ("rights", pa.list_(pa.binary())), ("subroot", pa.binary()), ("root", pa.binary())])


def _down(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """The path of every node, from those of the tops of their blocks."""

    def make(path, rows, levels):
        lefts, rights, subroot, root = path
        for i, r in enumerate(rows):
            left, right = _siblings(levels, i)
            # below the root of a group's own tree, a subroot is that group's; in the tree of groups a leaf is one
            yield r[0], r[2], r[4], left + lefts, right + rights, subroot if subroot is not None else r[3], root

    return _with_paths(nodes, paths, ["name"], make, f"tree string, pos long, name string, {PATH}", _PATHS)


class Manifest:
    """The tree of a table: ``leaves`` (tree, pos, digest, id, changed) and the nodes of all rounds."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: Iterable[str] = FIELDS,
                 changes: dict[str, Column] | None = None, changed: Column | None = None):
        """``changes``: new values of fields, for the rows where ``changed`` holds; the versions of those leaves."""
        checkpoint_dir(docs.sparkSession)
        self.id_col, self.group_col, self.id_type = id_col, group_col, dict(docs.dtypes)[id_col]
        values = [F.col(f"`{c}`") for c in fields]
        fresh = [(changes or {}).get(c, v) for c, v in zip(fields, values, strict=True)]
        leaves = docs.select(F.col(f"`{group_col}`").cast("string").alias("tree"), F.col(f"`{id_col}`").alias("id"), leaf(values).alias("digest"),
                             (F.when(changed, leaf(fresh)) if changed is not None else F.lit(None).cast("binary")).alias("changed"))
        self.leaves = placed(leaves.checkpoint(), ["id", "digest"]).checkpoint()  # else sampling the ranges hashes all texts once more
        self.rounds = _rounds(self.leaves)
        groups = self.rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
        self.groups = placed(groups, ["name"]).checkpoint()
        self.upper = _rounds(self.groups)

    def root(self) -> DataFrame:
        """One row with the root's digest; none for an empty table."""
        return self.upper[-1].select(F.lower(F.hex("digest")).alias("root"))

    def subroots(self) -> DataFrame:
        return self.rounds[-1].select(F.col("tree").alias(self.group_col), F.lower(F.hex("digest")).alias("subroot"))

    def nodes(self) -> DataFrame:
        """Every node of the first version: group (null and ``is_root_tree`` for the tree of groups), level, pos, digest."""
        parts = []
        for upper, rounds in ((False, self.rounds), (True, self.upper)):
            for level in [*(_inside(r) for r in rounds[:-1]), rounds[-1]]:
                parts.append(level.withColumn("is_root_tree", F.lit(upper)))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every.select(F.when(~F.col("is_root_tree"), F.col("tree")).alias(self.group_col), "is_root_tree", "level", "pos", F.lower(F.hex("digest")).alias("digest"))

    def versions(self) -> DataFrame:
        """A row per leaf: id, group, pos, leaf, subroot, root, ``changed`` (the new leaf or null), ``shared``
        (siblings up to the root, left to right, which the version shares) and ``copied`` (the nodes
        above the leaf that the version makes anew, its own root last; for unchanged leaves as they are)."""
        none = F.array().cast("array<binary>")
        paths = self.upper[-1].select("tree", "pos", F.lit("").alias("name"), none.alias("lefts"), none.alias("rights"),
                                      F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
        for nodes in reversed(self.upper[1:-1]):
            paths = _down(nodes.withColumn("name", F.lit("")), paths.drop("name")).withColumn("subroot", F.lit(None).cast("binary"))
        paths = _down(self.groups.select("tree", "pos", "digest", "name"), paths.drop("name"))
        paths = paths.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "lefts", "rights", "subroot", "root")
        for nodes in reversed(self.rounds[1:-1]):
            paths = _down(nodes.withColumn("name", F.lit("")), paths).drop("name")
        names = [self.id_col, self.group_col, "pos", "leaf", "subroot", "root", "changed", "shared", "copied"]
        hexes = pa.list_(pa.string())
        id_type = self.leaves.schema["id"].dataType
        from pyspark.sql.pandas.types import to_arrow_type
        out = pa.schema(list(zip(names, [to_arrow_type(id_type), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), hexes, hexes], strict=True)))

        def make(path, rows, levels):
            lefts, rights, subroot, root = path
            for i, (tree, _, pos, digest, doc, changed, *_rest) in enumerate(rows):
                left, right = _siblings(levels, i)
                own, shared, copied = changed or digest, [], []
                for a, b in zip(left + lefts, right + rights, strict=True):
                    before = [a[j:j + 32] for j in range(0, len(a), 32)]
                    after = [b[j:j + 32] for j in range(0, len(b), 32)]
                    own = node([*before, own, *after])
                    copied.append(own.hex())
                    shared += [x.hex() for x in before + after]
                yield doc, tree, pos, digest.hex(), subroot.hex(), root.hex(), changed and changed.hex(), shared, copied

        schema = f"`{self.id_col}` {self.id_type}, `{self.group_col}` string, pos long, leaf string, subroot string, root string, changed string, shared array<string>, copied array<string>"
        return _with_paths(self.leaves, paths, ["id", "changed"], make, schema, out)


def _inside(nodes: DataFrame) -> DataFrame:
    """All nodes of the blocks of a round but their tops."""
    out = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("digest", pa.binary()), ("level", pa.int32())])

    def every(batches):
        for r in _runs(batches):
            for k, digests in enumerate(_block([x[3] for x in r], r[0][1])[:-1]):
                for i, d in enumerate(digests):
                    yield r[0][0], r[0][1] * FAN ** (HEIGHT - k) + i, d, r[0][4] + k

    cols = nodes.select("tree", F.expr(f"pos div {SPAN}").alias("block"), "pos", "digest", "level")
    return _dealt(cols).mapInArrow(lambda b: _batches(every(b), out), "tree string, pos long, digest binary, level int")


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``pos``, their place from 0 among those of their tree by ``order``, nulls first."""
    p = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = ["tree", *order, "__tie"]  # the tie-breaker spreads equal rows over partitions
    cut = (rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(p, *keys).sortWithinPartitions(*keys).drop("__tie")
           .withColumn("__part", F.spark_partition_id()).checkpoint())
    per = (cut.groupBy("__part", "tree").agg(F.count("*").alias("n"))
           .groupBy("__part").agg(F.min(F.struct("tree")).alias("first"), F.max(F.struct("tree")).alias("last"), F.max_by("n", F.struct("tree")).alias("n")).collect())
    begin, tree, n = {}, None, 0
    for r in sorted(per, key=lambda r: r["__part"]):  # one row per partition
        begin[r["__part"]] = n if tree == (r["first"]["tree"],) else 0
        n = r["n"] + (begin[r["__part"]] if r["first"] == r["last"] else 0)
        tree = (r["last"]["tree"],)
    names = [c for c in cut.columns if c != "__part"]

    def number(batches):
        tree, n = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            col = batch.column("tree")
            if n is None:
                tree, n = col[0].as_py(), begin[batch.column("__part")[0].as_py()]
            codes = col.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            sizes = np.diff(np.append(starts, batch.num_rows))
            base = np.zeros(len(starts), dtype=np.int64)
            base[0] = n if col[0].as_py() == tree else 0
            pos = np.arange(batch.num_rows) - np.repeat(starts - base, sizes)
            tree, n = col[-1].as_py(), int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(pos)], names=[*names, "pos"])

    schema = ", ".join(f"`{c}` {t}" for c, t in cut.dtypes if c != "__part") + ", pos long"
    return cut.mapInArrow(number, schema)


def proofs(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: leaf, subroot, root, proof_sha256, folded_root, verified. Rows whose id's CRC-32 is
    even are tampered with: their text loses its line breaks."""
    name = F.col(f"`{id_col}`").cast("string").cast("binary")
    found = Manifest(docs, id_col, changes={"text": F.translate("text", "\n", "")}, changed=F.crc32(name) % 2 == 0).versions()
    own = F.coalesce(F.try_element_at("copied", F.lit(-1)), "changed", "leaf")
    return found.select(id_col, "leaf", "subroot", "root", F.sha2(F.array_join("shared", "").cast("binary"), 256).alias("proof_sha256"),
                        own.alias("folded_root"), (own == F.col("root")).alias("verified"))
