"""The most similar vectors of every vector: additive quantisation in an inverted index.

A coarse codebook sends each vector to a cell. Within a cell the rest to its
centre is written as a sum of full-dimensional codewords, one of each residual
codebook, found by beam search. The norm of the sum and the error of the code are
stored with it. A query scores a cell by lookup tables, as the distance to a
decoded vector is a sum of table entries and the stored norm, and the best are
ranked again by their exact vectors.

For pairs within a given distance the search is exact: a cell can hold a partner
only if its centre is not farther than that of the own cell by more than twice the
distance, and a vector only if its decoded form is not farther than the distance
plus the stored error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinetrail.llm.vectors import VectorSet, bounded_sample, lists, lloyd, matrix, nearest, spread_by, squares, vector_set

#: Vectors that the codebooks are fitted on, at most; every vector is encoded.
FIT_ON = 65_536
#: Vectors a cell on the average, as far as the largest coarse codebook allows: to two million vectors.
PER_CELL = 256
MOST_CELLS = 8192
#: Residual codebooks and codewords in each.
BOOKS, WORDS = 8, 256
BEAM = 4
#: Cells that a query visits for its nearest vectors: those with a centre not much farther than the nearest one,
#: a vector in a group few and one that lies alone many.
REACH, LEAST_PROBES, PROBES = 1.4, 6, 64
#: Vectors that are ranked exactly for each query in a cell: in each of the ``NEAREST`` first cells, and in each further one.
NEAREST, RERANK, RERANK_FAR = 3, 160, 48
#: Vectors that one task holds at most: neighbouring cells make up a region, larger regions are split in blocks.
BLOCK = 65_536
#: Regions as far as they then hold at least and at most so many vectors: few, as a query goes to each region it visits.
REGIONS, LEAST_REGION, MOST_REGION = 24, 2048, 32_768
#: Copies of a vector up to which all their pairs are told; of more the pairs with the first one.
EXPAND = 11


@dataclass(frozen=True)
class Codebooks:
    coarse: np.ndarray
    residual: tuple[np.ndarray, ...]

    def encode(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, squared norm of the sum of codewords, and error of each vector in its cell."""
        rest = x - self.coarse[cell]
        codes, error = beam_encode(rest, self.residual, BEAM)
        decoded = sum(book[codes[:, m]] for m, book in enumerate(self.residual))
        return codes, np.einsum("ij,ij->i", decoded, decoded), error


def beam_encode(x: np.ndarray, books: tuple[np.ndarray, ...], beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the sum of codewords found nearest to each vector, keeping the ``beam`` best sums after each codebook."""
    n, w = x.shape
    out, error = np.empty((n, len(books)), np.uint8), np.empty(n, np.float32)
    for a in range(0, n, 2048):
        part = x[a : a + 2048]
        m = len(part)
        rest, codes = part[:, None, :], np.zeros((m, 1, 0), np.uint8)
        for book in books:
            k = len(book)
            d = squares(rest.reshape(-1, w), book).reshape(m, -1)
            keep = min(beam, d.shape[1])
            best = np.argpartition(d, keep - 1, axis=1)[:, :keep] if keep < d.shape[1] else np.tile(np.arange(d.shape[1]), (m, 1))
            origin, word = best // k, best % k
            at = np.arange(m)[:, None]
            rest = rest[at, origin] - book[word]
            codes = np.concatenate([codes[at, origin], word[:, :, None].astype(np.uint8)], axis=2)
        e = np.einsum("ijk,ijk->ij", rest, rest)
        top = e.argmin(1)
        out[a : a + 2048] = codes[np.arange(m), top]
        error[a : a + 2048] = np.sqrt(e[np.arange(m), top])
    return out, error


def fit_codebooks(sample: np.ndarray, n: int, seed: int = 0) -> Codebooks:
    """Codebooks from a sample: the coarse one seeded by the density of the data, so that cells hold about equally many."""
    rng = np.random.default_rng(seed)
    cells = int(np.clip(n // PER_CELL, 1, min(MOST_CELLS, max(1, len(sample) // 8))))
    coarse = lloyd(sample, sample[rng.permutation(len(sample))[:cells]], 8)
    rest = sample - coarse[nearest(sample, coarse)[0]]
    books = []
    for _ in range(BOOKS):
        words = min(WORDS, len(rest))
        book = lloyd(rest, rest[rng.permutation(len(rest))[:words]], 6)
        books.append(book)
        rest = rest - book[nearest(rest, book)[0]]
    return Codebooks(coarse, tuple(books))


def regions(coarse: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The region of each cell: neighbouring cells together, so that a query goes to few tasks for many cells."""
    k = int(np.clip(-(-n // int(np.clip(n // REGIONS, LEAST_REGION, MOST_REGION))), 1, len(coarse)))
    rng = np.random.default_rng(seed)
    return nearest(coarse, lloyd(coarse, coarse[rng.permutation(len(coarse))[:k]], 5))[0]


INDEXED = "id bigint, vec array<float>, region int, block int, cell int, codes binary, norm float, error float, cells array<int>, near int"


def _index(vectors: DataFrame, books: Codebooks, region: np.ndarray, blocks: np.ndarray, probes: int, within: float | None, every: int) -> DataFrame:
    """A row for each vector in its region, and one for each region that it visits as a query, with the cells it visits there, the nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                ids, x = part.column(0).to_numpy(), matrix(part.column(1))
                d = squares(x, books.coarse)
                cell = d.argmin(axis=1)
                codes, norm, error = books.encode(x, cell)
                home = region[cell]
                block = (ids * 2654435761 % 1_000_003) % blocks[home]
                yield _rows(ids, x, home, block, cell=cell, codes=codes, norm=norm, error=error)
                asks = np.flatnonzero(ids % every == 0)
                if len(asks):
                    yield from _questions(ids[asks], x[asks], np.sqrt(d[asks]), region, blocks, probes, within)

    return vectors.mapInArrow(run, INDEXED)


def _questions(ids, x, d: np.ndarray, region: np.ndarray, blocks: np.ndarray, probes: int, within: float | None) -> Iterator[pa.RecordBatch]:
    if within is None:
        order = _first(d, probes)
        near = np.take_along_axis(d, order, axis=1)
        visits = (near <= REACH * near[:, :1]) | (np.arange(order.shape[1]) < LEAST_PROBES)
        q, rank = np.nonzero(visits)
        cell = order[q, rank]
    else:
        q, cell = np.nonzero(d <= d.min(axis=1)[:, None] + np.float32(2 * within + 1e-2))
        rank = np.zeros(len(q), np.int64)
    by = np.lexsort((rank, region[cell], q))
    q, rank, cell = q[by], rank[by], cell[by]
    where = region[cell]
    cuts = np.flatnonzero(np.concatenate(([True], (q[1:] != q[:-1]) | (where[1:] != where[:-1]))))
    ends = np.append(cuts[1:], len(q))
    near = np.add.reduceat((rank < NEAREST).astype(np.int32), cuts)
    times = blocks[where[cuts]]
    row = np.repeat(np.arange(len(cuts)), times)
    block = np.concatenate([np.arange(t) for t in times])
    for i in range(0, len(row), 8192):
        r = row[i : i + 8192]
        size = ends[r] - cuts[r]
        flat = np.repeat(cuts[r] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        cells = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(cell[flat].astype(np.int32)))
        yield _rows(ids[q[cuts[r]]], x[q[cuts[r]]], where[cuts[r]], block[i : i + 8192], cells=cells, near=near[r])


def _first(d: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` smallest of each row in order."""
    k = min(k, d.shape[1])
    at = np.argpartition(d, k - 1, axis=1)[:, :k]
    return np.take_along_axis(at, np.argsort(np.take_along_axis(d, at, axis=1), axis=1, kind="stable"), axis=1)


def _rows(ids, x, region, block, cell=None, codes=None, norm=None, error=None, cells=None, near=None) -> pa.RecordBatch:
    n = len(ids)
    asks = codes is None
    number = lambda v, kind: pa.nulls(n, kind) if v is None else pa.array(np.asarray(v)).cast(kind)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids),
            lists(x),
            pa.array(region.astype(np.int32)),
            pa.array(block.astype(np.int32)),
            number(cell, pa.int32()),
            pa.nulls(n, pa.binary()) if asks else pa.array([c.tobytes() for c in codes], pa.binary()),
            number(norm, pa.float32()),
            number(error, pa.float32()),
            cells if asks else pa.nulls(n, pa.list_(pa.int32())),
            number(near, pa.int32()),
        ],
        ["id", "vec", "region", "block", "cell", "codes", "norm", "error", "cells", "near"],
    )


class _Region:
    """The vectors of one block of a region, by cell."""

    def __init__(self, books: Codebooks):
        self.books, self.parts = books, []
        self.cells: dict[int, slice] | None = None

    def add(self, t: pa.RecordBatch) -> None:
        codes = np.frombuffer(b"".join(t.column(5).to_pylist()), np.uint8).reshape(t.num_rows, -1)
        self.parts.append((t.column(4).to_numpy(), t.column(0).to_numpy(), matrix(t.column(1)), codes, t.column(6).to_numpy(), t.column(7).to_numpy()))

    def close(self) -> None:
        if self.cells is not None:
            return
        self.cells = {}
        if not self.parts:
            return
        cell, ids, x, codes, norm, error = (np.concatenate(p) for p in zip(*self.parts))
        order = np.argsort(cell, kind="stable")
        self.ids, self.x, self.norm, self.error = ids[order], x[order], norm[order], error[order]
        # each codebook's column of codes, ready for lookups
        self.codes = [np.ascontiguousarray(codes[order, m]).astype(np.intp) for m in range(codes.shape[1])]
        cell = cell[order]
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        self.cells = {int(cell[a]): slice(a, b) for a, b in zip(first, np.append(first[1:], len(cell)))}

    def search(self, ids: np.ndarray, q: np.ndarray, cells: pa.Array, near: np.ndarray, k: int | None, within: float | None):
        """For queries: index, neighbour and exact distance of the best ``k``, or of all ``within`` with a greater id."""
        self.close()
        sizes = np.diff(cells.offsets.to_numpy())
        at = np.repeat(np.arange(len(ids)), sizes)
        rank = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        flat = cells.values.to_numpy()[cells.offsets[0].as_py() :][: len(at)]
        found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        by = np.argsort(flat, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(flat[by]) != 0))) if len(flat) else []
        for a, b in zip(starts, np.append(starts[1:], len(flat)) if len(flat) else []):
            cell = int(flat[by[a]])
            if cell not in self.cells:
                continue
            mine = by[a:b]
            if within is not None:
                groups = [(mine, None)]
            else:
                close = rank[mine] < near[at[mine]]
                groups = [(mine[close], RERANK), (mine[~close], RERANK_FAR)]
            for m, r in groups:
                for c in range(0, len(m), 1024):
                    i, j = self._candidates(q[at[m[c : c + 1024]]], cell, max(r, (k or 0) + 1) if r else None, within)
                    found_i.append(at[m[c : c + 1024]][i])
                    found_j.append(j)
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        d = np.empty(len(i))
        for c in range(0, len(i), 1 << 18):
            s = slice(c, c + (1 << 18))
            e = q[i[s]].astype(np.float64) - self.x[j[s]]
            d[s] = np.sqrt(np.einsum("ij,ij->i", e, e))
        fine = ids[i] != self.ids[j] if len(i) else np.zeros(0, bool)
        if within is not None:
            fine &= d <= within
        if k is None and len(i):
            fine &= ids[i] < self.ids[j]
        i, j, d = i[fine], j[fine], d[fine]
        order = np.lexsort((self.ids[j] if len(j) else j, d, i))
        i, j, d = i[order], j[order], d[order]
        best = np.ones(len(i), bool) if k is None else np.arange(len(i)) - np.searchsorted(i, i) < k
        return i[best], self.ids[j[best]] if best.any() else j[best], d[best]

    def _candidates(self, q: np.ndarray, cell: int, r: int | None, within: float | None) -> tuple[np.ndarray, np.ndarray]:
        """Query and vector of what the lookup tables score best in a cell, or of all that may lie within."""
        own = self.cells[cell]
        rest = q - self.books.coarse[cell]
        score = np.tile(self.norm[own], (len(q), 1))
        for book, codes in zip(self.books.residual, self.codes):
            score += np.take(rest @ (-2 * book.T), codes[own], axis=1)
        if within is not None:
            reach = (within + self.error[own] + 1e-2) ** 2
            i, j = np.nonzero(score <= reach[None, :] - np.einsum("ij,ij->i", rest, rest)[:, None])
        elif r < score.shape[1]:
            j = np.argpartition(score, r - 1, axis=1)[:, :r]
            i, j = np.repeat(np.arange(len(q)), r), j.ravel()
        else:
            i, j = np.repeat(np.arange(len(q)), score.shape[1]), np.tile(np.arange(score.shape[1]), len(q))
        return i, j + own.start


FOUND = "id bigint, ids array<bigint>, ds array<double>"


def _scan(indexed: DataFrame, books: Codebooks, k: int | None, within: float | None) -> DataFrame:
    """The best of each query in each block of a region it visits. A task holds one block of vectors and streams its queries."""
    # vectors, which have a cell, come before queries
    rows = spread_by(indexed, "region", "block").sortWithinPartitions("region", "block", F.col("cell").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key = None, None
        for batch in batches:
            query = np.asarray(batch.column(4).is_null())
            keys = np.stack([batch.column(2).to_numpy(), batch.column(3).to_numpy(), query], 1)
            cuts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]))
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                region, block, asks = keys[a]
                if key != (region, block):
                    now, key = _Region(books), (region, block)
                if not asks:
                    now.add(batch.slice(a, b - a))
                    continue
                step = 2048 if within is None else 256
                for c in range(a, b, step):
                    part = batch.slice(c, min(step, b - c))
                    ids = part.column(0).to_numpy()
                    i, other, d = now.search(ids, matrix(part.column(1)), part.column(8), part.column(9).to_numpy(), k, within)
                    if len(i):
                        n = np.bincount(i, minlength=len(ids))
                        has = np.flatnonzero(n)
                        ends = pa.array(np.concatenate(([0], np.cumsum(n[has]))).astype(np.int32))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[has]), pa.ListArray.from_arrays(ends, pa.array(other)), pa.ListArray.from_arrays(ends, pa.array(d.astype(np.float64)))],
                            ["id", "ids", "ds"],
                        )

    return rows.mapInArrow(run, FOUND)


def _best(lists_of: DataFrame, k: int) -> DataFrame:
    """``id`` and ``near``, the ``k`` best of all cells as (distance, id), ties by id."""
    pairs = F.arrays_zip(F.col("ds").alias("d"), F.col("ids").alias("other"))
    merged = F.slice(F.array_sort(F.flatten(F.collect_list(F.col("p")))), 1, k)
    return lists_of.select("id", F.transform(pairs, lambda x: F.struct(x["d"].alias("d"), x["other"].alias("other"))).alias("p")).groupBy("id").agg(merged.alias("near"))


def _search(vectors: VectorSet, k: int | None, within: float | None, every: int, seed: int) -> DataFrame:
    """Lists of neighbours of each query, one for each block that it visits."""
    sample = bounded_sample(vectors.distinct, vectors.n, FIT_ON, seed)
    books = fit_codebooks(sample, vectors.n, seed)
    probes = 0 if within is not None else PROBES
    region = regions(books.coarse, vectors.n, seed)
    # how many vectors a region holds, by its part of the sample: this only shares out the work
    counts = np.bincount(region[nearest(sample, books.coarse)[0]], minlength=int(region.max()) + 1)
    sizes = np.ceil(counts * (vectors.n / len(sample))).astype(np.int64)
    blocks = np.maximum(-(-sizes // BLOCK), 1)
    return _scan(_index(vectors.distinct, books, region, blocks, probes, within, every), books, k, within)


def similar_vectors(
    df: DataFrame, key: str, vector: str, width: int, k: int = 10, within: float | None = None, every: int = 1, seed: int = 0
) -> DataFrame:
    """The ``k`` most similar other vectors of every vector: ``id``, ``other`` and ``distance``.

    With ``within`` only those at most so far, which are then found without loss:
    the limit is pushed into the search. Else the loss is that of visiting a few
    cells and ranking so many vectors of each exactly; see the README for its
    measure. ``every`` takes as queries the ids divisible by it, against all vectors.

    Vectors with another number of elements, a NULL, NaN or infinity are left out,
    and so are rows without id. Of equal distances the smaller id comes first. Any number
    of exact copies is searched once; each then gets its own neighbours, the copies among
    them. An empty table gives no rows, one vector has none.
    """
    vectors = vector_set(df, key, vector, width)
    if vectors.n == 0:
        return df.sparkSession.createDataFrame([], "id bigint, other bigint, distance double")
    asked = every if not vectors.n_copies else 1
    found = _best(_search(vectors, k, within, asked, seed), k)
    if vectors.n_copies:
        out = _with_copies(found, vectors, k, every)
    else:
        out = found.select("id", F.explode("near").alias("x"))
    return out.select("id", F.col("x.other").alias("other"), F.col("x.d").alias("distance"))


def _with_copies(found: DataFrame, vectors: VectorSet, k: int, every: int) -> DataFrame:
    """Neighbours where several ids have one vector: the ids of a representative stand in its place, and are each other's nearest.

    Of the ids of a vector only the ``k + 1`` smallest can be among the first ``k`` of any.
    """
    first = W.partitionBy("rep").orderBy("id")
    heads = vectors.copies.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= k + 1)
    heads = heads.groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("heads"))
    near = found.select(F.col("id").alias("rep"), F.explode("near").alias("x"))
    near = near.join(heads.withColumnRenamed("rep", "__o"), F.col("x.other") == F.col("__o"), "left")
    near = near.select("rep", "x.d", F.explode(F.coalesce("heads", F.array("x.other"))).alias("other"))
    own = heads.select("rep", F.lit(0.0).alias("d"), F.explode("heads").alias("other"))
    pair = F.struct("d", "other")
    ranked = W.partitionBy("rep").orderBy("d", "other")
    top = near.unionByName(own).withColumn("__n", F.row_number().over(ranked)).where(F.col("__n") <= k + 1)
    top = top.groupBy("rep").agg(F.array_sort(F.collect_list(pair)).alias("near"))
    members = top.join(vectors.copies, "rep", "left").select(F.coalesce("id", "rep").alias("id"), "near")
    members = members.where(F.col("id") % every == 0)
    mine = F.slice(F.filter("near", lambda x: x["other"] != F.col("id")), 1, k)
    return members.select("id", F.explode(mine).alias("x"))


def close_pairs(df: DataFrame, key: str, vector: str, width: int, distance: float, seed: int = 0) -> DataFrame:
    """Each pair of different ids at most ``distance`` apart, the smaller id first, without loss and without a limit to their number.

    The pairs of a search of one vector at a time; exact copies are searched once. Up to
    ``EXPAND`` copies of a vector are told in all pairs; more are told as pairs with the one of
    the smallest id, which stands for them in the pairs with other vectors, so that no link
    between different vectors is lost and no group gives the square of its size.
    """
    vectors = vector_set(df, key, vector, width)
    if vectors.n == 0:
        return df.sparkSession.createDataFrame([], "vec_a bigint, vec_b bigint")
    lists_of = _search(vectors, None, distance, 1, seed)
    pairs = lists_of.select(F.col("id").alias("a"), F.explode("ids").alias("b"))
    if vectors.n_copies:
        size = vectors.copies.groupBy("rep").agg(F.count(F.lit(1)).alias("size"))
        copies = vectors.copies.join(size, "rep")
        few = copies.where((F.col("size") <= EXPAND) | (F.col("id") == F.col("rep")))
        for c in ("a", "b"):
            named = few.select(F.col("rep").alias("__rep"), F.col("id").alias("__id"))
            pairs = pairs.join(named, F.col(c) == F.col("__rep"), "left").withColumn(c, F.coalesce("__id", c)).drop("__rep", "__id")
        heads = few.select("rep", F.col("id").alias("head"))
        own = copies.join(heads, "rep").where(F.col("head") < F.col("id")).select(F.col("head").alias("a"), F.col("id").alias("b"))
        pairs = pairs.select("a", "b").unionByName(own)
    return pairs.select(F.least("a", "b").alias("vec_a"), F.greatest("a", "b").alias("vec_b"))
