"""Neighbour joins in a metric space without comparing all pairs.

Donors are assigned to their nearest pivot (a sample of bounded size) and range-partitioned by
(pivot, distance to it), so that a partition holds rings of few pivots' cells. One row per (partition,
pivot) - the ring's least and largest radius - describes the whole table; its size is bounded by
``MOST_PARTS`` plus the pivots. The triangle inequality then bounds every query's distance to a ring
from below: ``|d(q, p) - r|`` and, as cells are Voronoi cells, ``(d(q, p) - d(q, nearest pivot)) / 2``.

``nearest`` takes the pivots, the partitions' limits and an upper bound of every query's k-th distance from one sample
of the donors, so that a donor's partition is known from its row alone: donors are shuffled once, without being sorted or
stored before, and a query goes only to partitions with a ring below its bound. ``Space`` keeps the donors of
callers that read them often; ``routed`` sends queries to all partitions with a ring within a fixed distance.
Inside a task the same bounds hold for slices of ``SLICE`` donors. Matrix products with an
error margin find the few candidates, whose distances are then computed plainly, so results
are exact to the last bit and ties are decided by id.

Tasks are bounded on both sides: a partition has at most about ``PART_BYTES`` and ``PART_ROWS`` of donors, and
queries for one partition are dealt into as many tasks as they outnumber its donors. Data without structure (no bound
below any distance) cost a copy of each query per partition, which no exact method avoids; so a table has
``LEAST_PARTS`` partitions whatever its size, until they would outgrow a task, and the copies grow with the rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.session import checkpoint_dir

SLICE = 1024
CHUNK = 512
PART_BYTES = 32 << 20
PART_ROWS = 1 << 18
LEAST_PARTS = 8
LEAST_TASKS = 32  # of a round with enough queries
MOST_PARTS = 1 << 18
MOST_PIVOTS = 1024
PIVOT_BYTES = 8 << 20
LEAST_QUERIES = 4096  # of a task, before a partition's queries are dealt into several
CELLS = 4_000_000  # of a (query, ring) matrix
NEAR_CELLS = 1 << 15  # of a matrix that stays in a core's cache
QUERIES = 4096  # whose bounds to all slices are held at once
NEAR_QUERIES = 1024  # the same, of queries in the order of their cells
SPARSE = 1 / 16  # of the pivots, that are close enough to a query, up to which its rings are looked at singly
ROOM = 1e-9  # relative room for rounding in bounds
FLAT = 512  # donors of a product in single precision
FLAT_SHARE = 0.25  # of a task's donors that bounds leave to a query, from which it is compared with all of them
FLAT_ERROR = 1 / 256  # largest error of single precision, of the squared distance looked for
HELD = 1 << 17  # candidates before those beyond the k-th are dropped
SAMPLE_BYTES = 16 << 20  # of donors whose vectors all tasks know
SAMPLE_ROWS = 1 << 14  # at least, if there are as many donors
SAMPLE_OF_PART = 64  # at least, of a partition
SAMPLE_OF_SPACE = 1 << 10  # at least, while the bytes allow it


def matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an array<double> column."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def names(col: pa.ChunkedArray) -> np.ndarray:
    return np.array(col.to_pylist(), dtype=object)


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Plain distances of all rows of a to all rows of b, column by column in bounded memory."""
    out = np.zeros((len(a), len(b)))
    columns, step = np.ascontiguousarray(b.T), max(1, NEAR_CELLS // max(len(b), 1))
    some = np.empty((min(step, len(a)), len(b)))
    for s in range(0, len(a), step):
        o = out[s:s + step]
        d = some[:len(o)]
        for j in range(a.shape[1]):
            np.subtract(a[s:s + step, j, None], columns[j], out=d)
            np.abs(d, out=d) if metric == "manhattan" else np.multiply(d, d, out=d)
            o += d
    return out if metric == "manhattan" else np.sqrt(out, out=out)


def exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of row i of a to row i of b."""
    out = np.empty(len(a))
    for s in range(0, len(a), 100_000):
        d = a[s:s + 100_000] - b[s:s + 100_000]
        out[s:s + 100_000] = np.abs(d).sum(axis=1) if metric == "manhattan" else np.sqrt((d ** 2).sum(axis=1))
    return out


def _gap(d: np.ndarray, low: np.ndarray, high: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Least possible distances to rings, from the distances to their pivots and to the nearest pivot."""
    gap = np.maximum(np.maximum(d - high, low - d), (d - near[:, None]) / 2)
    return np.maximum(gap - 1e-12 * (d + high), 0)  # rounding of d and of the radii


class Task:
    """One task's donors in slices of one ring each."""

    def __init__(self, donors: np.ndarray, cell: np.ndarray, radius: np.ndarray, pivots: np.ndarray, spaces: np.ndarray, metric: str):
        self.order = np.lexsort((radius, cell))
        self.y, cell, radius = donors[self.order], cell[self.order], radius[self.order]
        cut = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        ends = np.append(cut[1:], len(cell))
        self.slices = [(s, min(s + SLICE, e)) for a, e in zip(cut, ends, strict=True) for s in range(a, e, SLICE)]
        first = np.array([s for s, _ in self.slices], dtype=np.int64)
        self.cells, self.cell = np.unique(cell[first], return_inverse=True) if len(first) else (np.zeros(0, np.int64), first)
        self.low = radius[first]
        self.high = np.array([radius[e - 1] for _, e in self.slices])
        self.pivots, self.metric, self.space = pivots, metric, spaces[self.cells][self.cell]
        self._blocks: tuple | None = None

    def bounds(self, x: np.ndarray, near: np.ndarray, space: np.ndarray, columns: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(least, largest) possible distances of each query to each slice, or those of ``columns``; infinite in other spaces."""
        columns = np.arange(len(self.slices)) if columns is None else columns
        cells, at = np.unique(self.cell[columns], return_inverse=True)
        d = distances(x, self.pivots[self.cells[cells]], self.metric)[:, at]
        other = space[:, None] != self.space[None, columns]
        low, high = self.low[columns], self.high[columns]
        return np.where(other, np.inf, _gap(d, low, high, near)), np.where(other, np.inf, d + high)

    def compare(self, x: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances (manhattan: distances) to a slice's donors, and the most they can be off per query."""
        a, b = self.slices[s]
        if self.metric == "manhattan":
            d = distances(x, self.y[a:b], "manhattan")
            return d, 1e-12 * d.max(axis=1, initial=0)
        p = self.pivots[self.cells[self.cell[s]]]
        q, y = x - p, self.y[a:b] - p
        qq, yy = (q * q).sum(axis=1), (y * y).sum(axis=1)
        return qq[:, None] + yy[None, :] - 2 * (q @ y.T), (x.shape[1] + 16) * 1e-15 * (qq + yy.max(initial=0))

    def value(self, d: np.ndarray) -> np.ndarray:
        return d if self.metric == "manhattan" else d * d

    def flat(self, x: np.ndarray, rows: np.ndarray, low: np.ndarray, limit: np.ndarray, columns: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """The rows that bounds leave so many donors within their limit (a squared distance) that they are compared with all
        of them by products in single precision; their terms of the products and their squares, and the donors' largest square.
        Rows that need more digits are left out."""
        none = np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros(0), 0.0
        if self.metric == "manhattan" or not len(self.y) or not len(rows) or (self.space != self.space[0]).any():
            return none
        size = np.array([b - a for a, b in self.slices], dtype=float)[slice(None) if columns is None else columns]
        if size.sum() < FLAT_SHARE * len(self.y):
            return none
        share = (low[rows] <= (np.sqrt(limit[rows]) * (1 + ROOM))[:, None]) @ size / len(self.y)
        rows = rows[(share >= FLAT_SHARE) & np.isfinite(limit[rows])]
        if len(rows) < 64:
            return none
        if self._blocks is None:
            middle = self.y.mean(axis=0)
            y = self.y - middle
            yy = (y * y).sum(axis=1)
            most = float(yy.max())
            fits = 1e-20 < most < 1e30
            self._blocks = middle, most, [np.ascontiguousarray(np.concatenate([y[a:a + FLAT].T, yy[None, a:a + FLAT]]).astype(np.float32))
                                          for a in range(0, len(y), FLAT)] if fits else []
        middle, most, blocks = self._blocks
        q = x[rows] - middle
        qq = (q * q).sum(axis=1)
        fine = (self.error(qq, most) <= limit[rows] * FLAT_ERROR) & (qq < 1e30)
        if not blocks or fine.sum() < 64:
            return none
        q, qq = q[fine], qq[fine]
        return rows[fine], np.concatenate([-2 * q, np.ones((len(q), 1))], axis=1).astype(np.float32), qq, most

    def error(self, qq: np.ndarray, most: float) -> np.ndarray:
        """The most that a squared distance by ``products`` can be off."""
        return (self.y.shape[1] + 16) * 1.5e-7 * (qq + most)

    def products(self, q: np.ndarray, limit: np.ndarray):
        """Yields (rows, donors, values) of the values of ``flat`` terms that are no more than ``limit``, which may be lowered meanwhile."""
        buffer = np.empty((CHUNK, FLAT), np.float32)
        for a, block in enumerate(self._blocks[2]):
            for c in range(0, len(q), CHUNK):
                part = q[c:c + CHUNK]
                v = buffer[:len(part)] if block.shape[1] == FLAT else np.empty((len(part), block.shape[1]), np.float32)
                np.matmul(part, block, out=v)
                top = limit[c:c + CHUNK]
                hit = np.flatnonzero(v.min(axis=1) <= top)
                if len(hit):
                    some = v[hit]
                    i, j = np.nonzero(some <= top[hit, None])
                    yield hit[i] + c, j + a * FLAT, some[i, j]

    def nearest(self, x: np.ndarray, near: np.ndarray, space: np.ndarray, upper: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, donor, distance) of all donors that may be among the k nearest within ``upper``."""
        none = np.zeros(0, np.int64)
        if not len(x) or not self.slices:
            return none, none, np.zeros(0)
        parts = []
        order = np.argsort(_cells(x, self.pivots[self.cells], self.metric)[0], kind="stable") if len(x) > NEAR_QUERIES else np.arange(len(x))
        for c in range(0, len(x), NEAR_QUERIES):
            rows = order[c:c + NEAR_QUERIES]
            q, y, d = self._nearest(x[rows], near[rows], space[rows], upper[rows], k)
            parts.append((rows[q], y, d))
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))

    def _nearest(self, x: np.ndarray, near: np.ndarray, space: np.ndarray, upper: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        columns = np.flatnonzero(_close(x, self.pivots[self.cells], near + 2 * upper * (1 + ROOM), self.metric).any(axis=0)[self.cell])
        if not len(columns):
            return none, none, np.zeros(0)
        low, high = self.bounds(x, near, space, columns)
        top = self.value(upper * (1 + ROOM))
        best = np.full((len(x), k), np.inf)
        home = np.argmin(low + 1e-6 * high, axis=1)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def look(rows: np.ndarray, s: int) -> None:
            nonlocal held, size
            for c in range(0, len(rows), CHUNK):
                q = rows[c:c + CHUNK]
                v, off = self.compare(x[q], columns[s])
                some = (v <= (top[q] + off)[:, None]).any(axis=1)
                if not some.any():
                    continue
                q, v, off = q[some], v[some], off[some]
                m = min(k, v.shape[1])
                every = np.concatenate([best[q], (np.partition(v, m - 1, axis=1)[:, :m] if m < v.shape[1] else v) + off[:, None]], axis=1)
                best[q] = np.partition(every, k - 1, axis=1)[:, :k]
                top[q] = np.minimum(top[q], best[q].max(axis=1))
                i, j = np.nonzero(v - off[:, None] <= top[q, None])
                held.append((q[i], j + self.slices[columns[s]][0], v[i, j] - off[i]))
                size += len(i)
            if size > 2_000_000:
                held, size = [self._kept(held, top)], 0

        some = np.isfinite(low)
        for s in np.unique(home).tolist():
            look(np.flatnonzero((home == s) & some[:, s]), s)
        flat, q, qq, most = self.flat(x, np.flatnonzero(some.all(axis=1)), low, top, columns)
        if len(flat):
            some[flat] = False
            off = self.error(qq, most)
            limit = single(top[flat] + off - qq)
            own = np.array(self.slices)[columns[home[flat]]]
            fresh: list[tuple[np.ndarray, ...]] = []
            for i, j, v in self.products(q, limit):
                new = (j < own[i, 0]) | (j >= own[i, 1])
                i, j = i[new], j[new]
                fresh.append((flat[i], j, v[new] + qq[i] - off[i]))
                if sum(len(f[0]) for f in fresh) > HELD:
                    held = [self._least(held + fresh, top, k, flat, off)]
                    fresh = []
                    limit[:] = single(top[flat] + off - qq)
            held = [self._least(held + fresh, top, k, flat, off)]
            size = len(held[0][0])
        for s in np.argsort(low.min(axis=0)).tolist() if some.any() else []:
            reach = (np.sqrt(top) if self.metric != "manhattan" else top) * (1 + ROOM)
            look(np.flatnonzero((low[:, s] <= reach) & some[:, s] & (home != s)), s)
        if not held:
            return none, none, np.zeros(0)
        q, y, _ = self._kept(held, top)
        return q, self.order[y], exact(x[q], self.y[y], self.metric)

    def _least(self, held, top: np.ndarray, k: int, flat: np.ndarray, off: np.ndarray):
        """The candidates that may be among the k nearest of their queries; ``top`` of the ``flat`` queries is lowered to
        the k-th of the candidates' upper bounds."""
        if not held:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0)
        q, y, v = self._kept(held, top)
        room = np.zeros(len(top))
        room[flat] = 2 * off  # v is a lower bound
        order = np.lexsort((v, q))
        first = np.searchsorted(q[order], np.arange(len(top) + 1))
        full = flat[np.diff(first)[flat] >= k]
        top[full] = np.minimum(top[full], v[order[first[full] + k - 1]] + room[full])
        return self._kept([(q, y, v)], top)

    @staticmethod
    def _kept(held, top):
        q, y, v = (np.concatenate(p) for p in zip(*held, strict=True))
        ok = v <= top[q]
        return q[ok], y[ok], v[ok]

    def within(self, x: np.ndarray, near: np.ndarray, space: np.ndarray, eps: float):
        """Yields (queries, donors, matrix of which are within eps of each other) for chunks and slices that can be;
        a matrix of None means that all are."""
        for c in range(0, len(x), QUERIES):
            e = c + QUERIES
            for q, y, m in self._within(x[c:e], near[c:e], space[c:e], eps):
                yield q + c, y, m

    def _within(self, x: np.ndarray, near: np.ndarray, space: np.ndarray, eps: float):
        low, high = self.bounds(x, near, space)
        limit = eps if self.metric == "manhattan" else eps * eps
        flat, q, qq, most = self.flat(x, np.flatnonzero(np.isfinite(low).all(axis=1)), low, np.full(len(x), limit))
        if len(flat):
            yield from self._flat_within(x, flat, q, qq, most, eps)
            low[flat] = np.inf
        for s, (a, b) in enumerate(self.slices):
            rows = np.flatnonzero(low[:, s] <= eps * (1 + ROOM))
            inside = high[rows, s] * (1 + ROOM) <= eps
            if inside.any():
                yield rows[inside], self.order[a:b], None
            rows = rows[~inside]
            for c in range(0, len(rows), CHUNK):
                q = rows[c:c + CHUNK]
                v, off = self.compare(x[q], s)
                m = v <= limit
                i, j = np.nonzero(np.abs(v - limit) <= off[:, None])
                m[i, j] = exact(x[q[i]], self.y[a + j], self.metric) <= eps
                yield q, self.order[a:b], m

    def _flat_within(self, x: np.ndarray, flat: np.ndarray, q: np.ndarray, qq: np.ndarray, most: float, eps: float):
        off = self.error(qq, most)
        upper, lower = single(eps * eps + off - qq), -single(qq + off - eps * eps)
        for c in range(0, len(q), CHUNK):
            rows, part = flat[c:c + CHUNK], q[c:c + CHUNK]
            for a, block in enumerate(self._blocks[2]):
                a *= FLAT
                v = part @ block
                hit = np.flatnonzero(v.min(axis=1) <= upper[c:c + CHUNK])
                if not len(hit):
                    continue
                v = v[hit]
                m = v <= upper[c + hit, None]
                i, j = np.nonzero(m & (v >= lower[c + hit, None]))
                m[i, j] = exact(x[rows[hit[i]]], self.y[a + j], self.metric) <= eps
                yield rows[hit], self.order[a:a + FLAT], m


class Space:
    """Donors (space, x, payload columns) by pivot and ring. Only rows of equal ``space`` (a string) are compared."""

    def __init__(self, points: DataFrame, payload: list[str], metric: str = "euclidean", part_rows: int | None = None):
        spark = points.sparkSession
        checkpoint_dir(spark)
        self.spark, self.metric, self.payload = spark, metric, payload
        points = points.withColumn("__h", F.xxhash64("space", "x")).select("space", "x", "__h", *payload)
        per = points.groupBy("space").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).collect()  # a row per space
        n, d = sum(r["n"] for r in per), max((r["d"] for r in per), default=1)
        most = max(1, min(MOST_PIVOTS, PIVOT_BYTES // (8 * max(d, 1)) // max(len(per), 1)))
        w = Window.partitionBy("space").orderBy("__h", "x")
        ranked = points.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most)
        size = {r["space"]: min(most, max(1, math.isqrt(r["n"]))) for r in per}
        rows = [r for r in ranked.select("space", "x", "__r").collect() if r["__r"] <= size[r["space"]]]  # at most PIVOT_BYTES
        rows.sort(key=lambda r: (r["space"], r["__r"]))
        x = np.array([r["x"] for r in rows], dtype=float).reshape(len(rows), d)
        names_of = np.array([r["space"] for r in rows], dtype=object)
        order = [int(i) for s in dict.fromkeys(names_of) for i in _near_order(x, np.flatnonzero(names_of == s))]
        rows, self.pivots = [rows[i] for i in order], x[order]
        self.of = {s: np.array([i for i, r in enumerate(rows) if r["space"] == s]) for s in {r["space"] for r in rows}}
        self.parts = _parts(n, d, part_rows)
        self.known = spark.sparkContext.broadcast((self.pivots, self.of))
        kinds = ", ".join(f"{c} {t}" for c, t in points.dtypes)
        known = self.known

        def assign(batches):
            pivots, of = known.value
            for batch in batches:
                cell, radius = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
                for rows, x, mine in _by_space(batch, of):
                    for c in range(0, len(rows), CHUNK):
                        dist = distances(x[c:c + CHUNK], pivots[mine], metric)
                        at = dist.argmin(axis=1)
                        cell[rows[c:c + CHUNK]], radius[rows[c:c + CHUNK]] = mine[at], dist[np.arange(len(at)), at]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(radius)], names=[*batch.schema.names, "cell", "radius"])

        keys = ["cell", "radius", "__h"]
        self.donors = (points.mapInArrow(assign, f"{kinds}, cell long, radius double").repartitionByRange(self.parts, *keys)
                       .withColumn("part", F.spark_partition_id()).drop("__h").checkpoint())
        rings = [(r["part"], r["cell"], r["lo"], r["hi"], r["n"]) for r in self.donors.groupBy("part", "cell").agg(
            F.min("radius").alias("lo"), F.max("radius").alias("hi"), F.count("*").alias("n")).collect()]  # at most range partitions + pivots
        # if Spark dealt more range partitions than asked for, neighbours are one part: copies of queries go by the donors' size
        ranges = max((r[0] for r in rings), default=0) + 1
        if ranges > self.parts:
            rings = [(part * self.parts // ranges, *rest) for part, *rest in rings]
            self.donors = self.donors.withColumn("part", F.expr(f"cast(part * {self.parts} div {ranges} as int)"))
        rings.sort()
        self.sizes: dict[int, int] = {}
        for part, *_, n in rings:
            self.sizes[part] = self.sizes.get(part, 0) + n
        ring = np.array(rings, dtype=float).reshape(-1, 5)
        self.rings = spark.sparkContext.broadcast((ring[:, 0].astype(np.int64), ring[:, 1].astype(np.int64), ring[:, 2], ring[:, 3]))

    def _route(self, queries: DataFrame) -> DataFrame:
        """Adds ``near`` (distance to the nearest pivot) and ``parts``: all with a ring nearer than column ``u``."""
        known, rings, metric = self.known, self.rings, self.metric
        kept = [c for c in queries.columns if c not in ("near", "parts")]
        kinds = ", ".join(f"`{c}` {t}" for c, t in queries.dtypes if c in kept)

        def route(batches):
            pivots, of = known.value
            part, cell, lo, hi = rings.value
            for batch in batches:
                near = np.full(batch.num_rows, np.inf)
                reached: list[tuple[np.ndarray, np.ndarray]] = []
                u = batch.column("u").to_numpy()
                for rows, x, mine in _by_space(batch, of):
                    here = np.flatnonzero(np.isin(cell, mine))
                    column = np.searchsorted(mine, cell[here])
                    step = max(1, CELLS // max(len(here), len(mine)))
                    by_cell = np.argsort(column, kind="stable")
                    ends = np.searchsorted(column[by_cell], np.arange(len(mine) + 1))
                    near[rows] = _cells(x, pivots[mine], metric)[1]
                    for c in range(0, len(rows), step):
                        r = rows[c:c + step]
                        far = u[r] * (1 + ROOM)
                        close = _close(x[c:c + step], pivots[mine], near[r] + 2 * far, metric)
                        if np.count_nonzero(close) > SPARSE * close.size:
                            gap = _gap(distances(x[c:c + step], pivots[mine], metric)[:, column], lo[here], hi[here], near[r])
                            q, p = by_part(gap <= far[:, None], part[here])
                        else:  # each pair of a query and a cell that is close enough, with the cell's rings
                            q, at = np.nonzero(close)
                            d, n = exact(x[c + q], pivots[mine[at]], metric), ends[at + 1] - ends[at]
                            ring = here[by_cell[np.repeat(ends[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]]
                            q, d = np.repeat(q, n), np.repeat(d, n)[:, None]
                            hit = _gap(d, lo[ring, None], hi[ring, None], near[r[q]])[:, 0] <= far[q]
                            q, p = np.divmod(np.unique(q[hit] * MOST_PARTS + part[ring[hit]]), MOST_PARTS)
                        reached.append((r[q], p))
                parts = part_lists(reached, batch.num_rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(near), parts], names=[*kept, "near", "parts"])

        return queries.mapInArrow(route, f"{kinds}, near double, parts array<int>").where(F.size("parts") > 0)

    def _meet(self, routed: DataFrame, donors: DataFrame, fn, schema: str) -> DataFrame:
        """``fn(queries, donors)`` on Arrow tables, once per partition and deal of its queries."""
        each = routed.withColumn("part", F.explode("parts")).drop("parts")
        counts = each.groupBy("part").count().collect()  # at most parts
        wide = math.ceil(LEAST_TASKS / max(len(counts), 1))
        deals = [(r["part"], max(math.ceil(r["count"] / max(LEAST_QUERIES, self.sizes.get(r["part"], 0))), min(wide, math.ceil(r["count"] / LEAST_QUERIES)))) for r in counts]
        table = F.broadcast(self.spark.createDataFrame(deals, "part int, __deals int"))
        q = each.join(table, "part").withColumn("__deal", F.pmod(F.xxhash64("qid", "near"), F.col("__deals")).cast("int")).drop("__deals")
        y = donors.join(table, "part").withColumn("__deal", F.explode(F.sequence(F.lit(0), F.col("__deals") - 1))).drop("__deals")
        groups = sum(n for _, n in deals)
        if groups > int(self.spark.conf.get("spark.sql.shuffle.partitions")):  # a shuffle partition is sorted: few groups each
            q, y = q.repartition(groups, "part", "__deal"), y.repartition(groups, "part", "__deal")
        return q.groupBy("part", "__deal").cogroup(y.groupBy("part", "__deal")).applyInArrow(fn, schema)

    def routed(self, queries: DataFrame, eps: float) -> DataFrame:
        """Queries (qid, space, x, ...) with the partitions that can hold donors within eps, and ``near``."""
        return self._route(queries.withColumn("u", F.lit(float(eps)))).drop("u").checkpoint()

    def tasks(self):
        """A function that makes a Task of a partition's donors."""
        known, metric = self.known, self.metric

        def make(y: pa.Table) -> Task:
            pivots, of = known.value
            spaces = np.empty(len(pivots), dtype=object)
            for s, mine in of.items():
                spaces[mine] = s
            x, cell = matrix(y["x"]), y["cell"].to_numpy()
            return Task(x, cell, y["radius"].to_numpy() if "radius" in y.column_names else exact(x, pivots[cell], metric), pivots, spaces, metric)

        return make


class Dealt(Space):
    """Donors (nid, space, x, label) that are not stored: pivots, the partitions' limits and ``upper``'s bounds come from a
    sample, after which a donor's cell, radius and partition follow from its row. They are read four times and shuffled once."""

    def __init__(self, points: DataFrame, k: int, metric: str = "euclidean", part_rows: int | None = None):
        spark = points.sparkSession
        self.spark, self.metric = spark, metric
        per = points.groupBy("space").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).collect()  # a row per space
        n, d = sum(r["n"] for r in per), max((r["d"] for r in per), default=1)
        self.parts = _parts(n, d, part_rows)
        most = max(1, SAMPLE_BYTES // (8 * max(d, 1)))
        least = min(SAMPLE_OF_SPACE, max(1, most // max(len(per), 1)))
        share = min(most, max(SAMPLE_ROWS, SAMPLE_OF_PART * self.parts)) / max(n, 1)
        shares = spark.createDataFrame([(r["space"], min(1.0, max(share, least / r["n"]))) for r in per], "space string, __share double")
        rows = points.select("space", "x").join(F.broadcast(shares), "space").where(F.rand(1) < F.col("__share")).select("space", "x")
        some = rows.toArrow()  # about SAMPLE_BYTES
        of_space, x = names(some["space"]), matrix(some["x"])
        missed = {r["space"] for r in per} - set(of_space.tolist())
        if missed:
            more = _first(points.select("space", "x").join(F.broadcast(spark.createDataFrame([(s,) for s in missed], "space string")), "space"), ["space"], ["x"], 1).select("space", "x").toArrow()
            of_space, x = np.concatenate([of_space, names(more["space"])]), np.concatenate([x.reshape(-1, d), matrix(more["x"])])
        x = x.reshape(len(of_space), d)
        wanted = max(1, min(MOST_PIVOTS, PIVOT_BYTES // (8 * max(d, 1)) // max(len(per), 1)))
        rng, pivots, samples, limits = np.random.default_rng(0), [], {}, []
        self.of = {}
        for r in sorted(per, key=lambda r: r["space"]):
            mine = x[of_space == r["space"]]
            apart = rng.permutation(np.unique(mine, axis=0))[:min(wanted, max(1, math.isqrt(r["n"])))]
            apart = apart[_near_order(apart, np.arange(len(apart)))]
            self.of[r["space"]] = at = np.arange(len(apart)) + sum(map(len, pivots))
            pivots.append(apart)
            cell, radius = _cells(mine, apart, metric)
            limits.append((at[cell], radius, np.full(len(mine), r["n"] / len(mine))))
            few = mine[rng.permutation(len(mine))[:max(SAMPLE_ROWS // len(per), SAMPLE_OF_SPACE)]]
            few = few[_copies(np.zeros(len(few)), few, np.arange(len(few)), k)[0]]
            ends = apart[rng.permutation(len(apart))[:max(1, math.isqrt(len(few)))]]
            samples[r["space"]] = few, *_cells(few, ends, metric), ends
        self.pivots = np.concatenate(pivots) if pivots else np.zeros((0, d))
        cell, radius, weight = (np.concatenate(v) for v in zip(*limits, strict=True)) if limits else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        order = np.lexsort((radius, cell))
        reached = np.cumsum(weight[order])
        cuts = order[np.unique(np.searchsorted(reached, reached[-1] * np.arange(1, self.parts) / self.parts))] if len(order) else order
        limits = np.unique(np.stack([cell[cuts], radius[cuts]], axis=1), axis=0)
        self.known = spark.sparkContext.broadcast((self.pivots, self.of))
        self._limits, self._samples = spark.sparkContext.broadcast(limits), spark.sparkContext.broadcast(samples)
        self.k = k
        found = points.select("space", "x").mapInArrow(self._assign(False), "part int, cell long, lo double, hi double, n long")
        found = found.groupBy("part", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).collect()  # at most partitions + pivots
        rings = sorted((r["part"], r["cell"], r["lo"], r["hi"], r["n"]) for r in found)
        self.sizes = {}
        for part, *_, count in rings:
            self.sizes[part] = self.sizes.get(part, 0) + count
        ring = np.array(rings, dtype=float).reshape(-1, 5)
        self.rings = spark.sparkContext.broadcast((ring[:, 0].astype(np.int64), ring[:, 1].astype(np.int64), ring[:, 2], ring[:, 3]))
        kinds = dict(points.dtypes)
        self.donors = points.select("nid", "space", "x", "label").mapInArrow(self._assign(True), f"part int, cell long, x array<double>, nid {kinds['nid']}, label {kinds['label']}")

    def _assign(self, whole: bool):
        """Donors with their partition and cell, or what they add to the rings. Of a batch's equal vectors, as hot ones come, k ids do."""
        known, cuts, metric, k = self.known, self._limits, self.metric, self.k

        def assign(batches):
            pivots, of = known.value
            limits = cuts.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                cell, radius = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
                x = matrix(batch.column("x"))
                for rows, mine_x, mine in _by_space(batch, of):
                    at, radius[rows] = _cells(mine_x, pivots[mine], metric)
                    cell[rows] = mine[at]
                part = _after(limits, cell, radius).astype(np.int32)
                order = np.lexsort((radius, cell))
                new = np.flatnonzero(np.concatenate([[True], (np.diff(cell[order]) != 0) | (np.diff(radius[order]) != 0)]))
                runs = np.diff(np.append(new, len(order)))
                if not whole:
                    ring = np.stack([part[order[new]].astype(np.int64), cell[order[new]]], axis=1)
                    first = np.flatnonzero(np.concatenate([[True], (np.diff(ring, axis=0) != 0).any(axis=1)]))
                    r = radius[order[new]]
                    yield pa.RecordBatch.from_arrays([pa.array(ring[first, 0].astype(np.int32)), pa.array(ring[first, 1]), pa.array(np.minimum.reduceat(r, first)),
                                                      pa.array(np.maximum.reduceat(r, first)), pa.array(np.add.reduceat(runs, first))], names=["part", "cell", "lo", "hi", "n"])
                    continue
                columns = [pa.array(part), pa.array(cell), *(batch.column(c) for c in ("x", "nid", "label"))]
                if runs.max() > k:
                    kept, _ = _copies(cell, x, _ranks(batch.column("nid")), k)
                    columns = [c.take(pa.array(kept)) for c in columns]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "cell", "x", "nid", "label"])

        return assign

    def upper(self, queries: DataFrame) -> DataFrame:
        """Adds ``u``, the distance to the k-th nearest row of the sample: no less than that to the k-th donor."""
        samples, metric, k = self._samples, self.metric, self.k
        kinds = ", ".join(f"`{c}` {t}" for c, t in queries.dtypes)

        def bound(batches):
            tasks: dict[str, Task] = {}
            for batch in batches:
                u = np.full(batch.num_rows, np.inf)
                for rows, x, (y, cell, radius, ends) in _by_space(batch, samples.value):
                    if len(y) < k:
                        continue
                    s = batch.column("space")[int(rows[0])].as_py()
                    if s not in tasks:
                        tasks[s] = Task(y, cell, radius, ends, np.zeros(len(ends)), metric)
                    near = distances(x, ends, metric).min(axis=1)
                    row, _, dist = tasks[s].nearest(x, near, np.zeros(len(x)), np.full(len(x), np.inf), k)
                    order = np.lexsort((dist, row))
                    first = np.searchsorted(row[order], np.arange(len(x) + 1))
                    full = np.diff(first) >= k
                    u[rows[full]] = dist[order][first[:-1][full] + k - 1]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(u)], names=[*batch.schema.names, "u"])

        return queries.mapInArrow(bound, f"{kinds}, u double")


def by_part(hit: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, partition) of the rings hit; a column's partition is ``part``, in ascending order."""
    first = np.flatnonzero(np.diff(part, prepend=-1))
    if not len(first):
        return first, first
    q, at = np.nonzero(np.logical_or.reduceat(hit, first, axis=1))
    return q, part[first[at]]


def part_lists(reached: list[tuple[np.ndarray, np.ndarray]], n: int) -> pa.ListArray:
    """The partitions of each of n queries, from (query, partition)."""
    q, p = (np.concatenate([np.zeros(0, np.int64), *v]) for v in zip(*reached, strict=True)) if reached else (np.zeros(0, np.int64),) * 2
    order = np.argsort(q, kind="stable")
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(q[order], np.arange(n + 1)), pa.int32()), pa.array(p[order], pa.int32()))


def single(v: np.ndarray) -> np.ndarray:
    """Values in single precision, none less than before."""
    return np.nextafter(v.astype(np.float32), np.float32(np.inf))


def _parts(n: int, d: int, part_rows: int | None) -> int:
    parts = max(math.ceil(n * d * 8 / PART_BYTES), math.ceil(n / PART_ROWS), min(LEAST_PARTS, math.ceil(n / 1024)), 1)
    if part_rows:
        parts = max(1, math.ceil(n / part_rows))
    return min(parts, MOST_PARTS)


def _cells(x: np.ndarray, pivots: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot and the distance to it. Products leave rows in doubt that have another pivot within their error; these are
    compared plainly, so that a row's cell does not depend on the rows around it."""
    at, middle = np.zeros(len(x), np.int64), pivots.mean(axis=0)
    p = pivots - middle
    size, step = (p * p).sum(axis=1), max(1, 4 * NEAR_CELLS // len(pivots))
    terms = np.concatenate([-2 * p.T, size[None]])
    for c in range(0, len(x), step):
        if metric == "manhattan":
            at[c:c + step] = distances(x[c:c + step], pivots, metric).argmin(axis=1)
            continue
        q = x[c:c + step] - middle
        v, each = np.concatenate([q, np.ones((len(q), 1))], axis=1) @ terms, np.arange(len(q))
        least = v.argmin(axis=1)
        top = v[each, least] + (x.shape[1] + 16) * 4e-15 * ((q * q).sum(axis=1) + size.max())
        v[each, least] = np.inf
        doubt = np.flatnonzero(~(v.min(axis=1) > top))
        least[doubt] = distances(x[c:c + step][doubt], pivots, metric).argmin(axis=1)
        at[c:c + step] = least
    return at, exact(x, pivots[at], metric)


def _close(x: np.ndarray, pivots: np.ndarray, limit: np.ndarray, metric: str) -> np.ndarray:
    """Which pivots are within a row's limit; some that are hardly beyond it are among them."""
    if metric == "manhattan":
        return distances(x, pivots, metric) <= (limit * (1 + ROOM))[:, None]
    middle = pivots.mean(axis=0)
    p, q = pivots - middle, x - middle
    size, qq = (p * p).sum(axis=1), (q * q).sum(axis=1)
    top = (limit * (1 + ROOM)) ** 2 - qq + (x.shape[1] + 16) * 4e-15 * (qq + size.max(initial=0))
    out, step = np.empty((len(x), len(p)), dtype=bool), max(1, 4 * NEAR_CELLS // max(len(p), 1))
    for c in range(0, len(x), step):
        v = q[c:c + step] @ (-2 * p.T)
        v += size
        np.less_equal(v, top[c:c + step, None], out=out[c:c + step])
    return out


def _after(limits: np.ndarray, cell: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How many of the sorted limits (cell, radius) each row has reached."""
    part = np.searchsorted(limits[:, 0], cell, "left")
    ends = np.searchsorted(limits[:, 0], cell, "right")
    for c in np.unique(cell[ends > part]).tolist():
        rows = np.flatnonzero(cell == c)
        a, b = part[rows[0]], ends[rows[0]]
        part[rows] = a + np.searchsorted(limits[a:b, 1], radius[rows], "right")
    return part


def _ranks(ids: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Places of ids in their order, nulls first."""
    rank = np.empty(len(ids), dtype=np.int64)
    rank[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
    return rank


def _copies(cell: np.ndarray, x: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vector of each): of every cell's equal vectors the k rows of least rank, in order."""
    order = np.lexsort((rank, *x.T, cell))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(cell[order]) != 0) | (x[order[1:]] != x[order[:-1]]).any(axis=1)
    vector = np.cumsum(new) - 1
    keep = np.arange(len(order)) - np.flatnonzero(new)[vector] < k
    return order[keep], vector[keep]


def _near_order(x: np.ndarray, rows: np.ndarray) -> list[int]:
    """Pivots by halves along their widest column, so that neighbouring cells share partitions."""
    if len(rows) <= 2:
        return rows.tolist()
    column = int(np.argmax(np.ptp(x[rows], axis=0)))
    rows = rows[np.argsort(x[rows, column], kind="stable")]
    half = len(rows) // 2
    return _near_order(x, rows[:half]) + _near_order(x, rows[half:])


def _by_space(batch: pa.RecordBatch, of: dict):
    """(rows, their vectors, pivots) of each space with donors."""
    every = batch.column("space").dictionary_encode()
    codes = every.indices.to_numpy(zero_copy_only=False)
    for at, s in enumerate(every.dictionary.to_pylist()):
        if s in of:
            rows = np.flatnonzero(codes == at)
            yield rows, matrix(batch.column("x").take(pa.array(rows))), of[s]


def _first(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def _finite(rows: DataFrame) -> DataFrame:
    return rows.where(F.forall("x", lambda e: F.abs(e) < float("inf")))


def nearest_lists(queries: DataFrame, donors: DataFrame, k: int, metric: str = "euclidean", part_rows: int | None = None) -> DataFrame:
    """(qid, ids, labels, dists): of every query and partition that it met, the k nearest donors there; all k nearest
    ones are among them. Ties by the smaller id, nulls first.

    ``queries``: qid, space, x; ``donors``: nid, space, x, label. Donors with equal vectors are compared as one with
    their k smallest ids, so that repeated rows are not compared with each other. Rows with NaN or infinity have no neighbours."""
    checkpoint_dir(queries.sparkSession)
    space = Dealt(_finite(donors), k, metric, part_rows)
    make = space.tasks()
    kinds = {c: t for c, t in [*queries.dtypes, *donors.dtypes]}

    def best(q: pa.Table, y: pa.Table) -> pa.Table:
        """Per query its ids, labels and distances."""
        y = y.combine_chunks()
        rank = _ranks(y["nid"])
        kept, vector = _copies(y["cell"].to_numpy(), matrix(y["x"]), rank, k)
        y, rank = y.take(pa.array(kept)), rank[kept]
        first = np.flatnonzero(np.concatenate([[True], vector[1:] != vector[:-1]])) if len(vector) else vector
        size = np.diff(np.append(first, len(vector)))
        row, at, dist = make(y.select(["x", "cell"]).take(pa.array(first))).nearest(matrix(q["x"]), q["near"].to_numpy(), names(q["space"]), q["u"].to_numpy(), k)
        n = size[at]
        member = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        row, dist = np.repeat(row, n), np.repeat(dist, n)
        order = np.lexsort((rank[member], dist, row))
        row, member, dist = row[order], member[order], dist[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, member, dist = row[keep], member[keep], dist[keep]
        ends = np.searchsorted(row, np.arange(q.num_rows + 1))
        some = np.flatnonzero(np.diff(ends))
        ends = pa.array(np.append(ends[some], len(row)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v)
                 for v in (y["nid"].take(pa.array(member)), y["label"].take(pa.array(member)), pa.array(dist))]
        return pa.table([q["qid"].take(pa.array(some)), *lists], names=["qid", "ids", "labels", "dists"])

    asked = space._route(space.upper(_finite(queries.select("qid", "space", "x")))).checkpoint()
    return space._meet(asked, space.donors, best, f"qid {kinds['qid']}, ids array<{kinds['nid']}>, labels array<{kinds['label']}>, dists array<double>")


def nearest(queries: DataFrame, donors: DataFrame, k: int, metric: str = "euclidean", part_rows: int | None = None) -> DataFrame:
    """``nearest_lists`` as rows (qid, nid, dist, label)."""
    rows = F.explode(F.arrays_zip("ids", "labels", "dists")).alias("e")
    lists = nearest_lists(queries, donors, k, metric, part_rows)
    return lists.select("qid", rows).select("qid", F.col("e.ids").alias("nid"), F.col("e.dists").alias("dist"), F.col("e.labels").alias("label"))
