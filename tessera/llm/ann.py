"""Approximate nearest neighbours by largest inner product: an inverted file with product-quantised residuals.

Coarse centroids and codebooks are fitted on a bounded sample; every vector is filed in the cell of
its centroid, with the codes of its residual and its distance from what they say. A query probes the
cells whose centroids are nearest and reads approximate products from asymmetric distance tables;
every vector of theirs that may be among the best, by that distance, is reranked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import written

NEIGHBOURS = 20
#: Rows that centroids and codebooks are fitted on, at most.
SAMPLE = 16_384
#: Rows of the sample that a codebook of 256 codes is fitted on, at most.
BOOK_SAMPLE = 4_096
#: Centroids of either level, at most: a second level cuts every cell by the residual, so cells grow with the table to four million.
CENTROIDS = 2_048
#: Rows of a cell, and queries, that meet in one task's group.
BLOCK_ROWS, BLOCK_QUERIES = 8_192, 4_096
#: Pairs whose exact products are taken at once.
PAIRS = 1 << 16
#: Sampled queries whose true neighbours decide how many cells are probed.
JUDGED = 256
#: Share of their true neighbours that the probed cells must hold.
COVERAGE = 0.985
#: A query's probed cells hold this many times the neighbours asked for, at least.
LEAST_HELD = 8


@dataclass
class Index:
    """Coarse centroids (k1 x d), centroids of their residuals (k2 x d), codebooks (parts x codes x width) and the number of cells to probe. Cell = first * k2 + second."""

    coarse: np.ndarray
    fine: np.ndarray
    books: np.ndarray
    probes: int

    @property
    def cells(self) -> int:
        return len(self.coarse) * len(self.fine)

    def centroid(self, cell: np.ndarray) -> np.ndarray:
        return self.coarse[cell // len(self.fine)] + self.fine[cell % len(self.fine)]

    def assign(self, x: np.ndarray) -> np.ndarray:
        first = _closest(x, self.coarse)
        return first * len(self.fine) + (_closest(x - self.coarse[first], self.fine) if len(self.fine) > 1 else 0)

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        parts, _, width = self.books.shape
        residual = (x - self.centroid(cell)).reshape(len(x), parts, width)
        return np.stack([_closest(residual[:, i], b) for i, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def offsets(self, x: np.ndarray, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Every row's distance from its centroid and codes, and some more for rounding: times a query's length, the most that its approximate product can be wrong by."""
        centre = self.centroid(cell)
        said = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)
        return np.linalg.norm(x - centre - said, axis=1) * (1 + 1e-6) + 1e-5 * (np.linalg.norm(x, axis=1) + np.linalg.norm(centre, axis=1))

    def cell_products(self, q: np.ndarray) -> np.ndarray:
        """Inner products of every query with every cell's centroid."""
        return ((q @ self.coarse.T)[:, :, None] + (q @ self.fine.T)[:, None, :]).reshape(len(q), self.cells)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Asymmetric distance tables, parts x codes x queries: what a code adds to a query's product."""
        parts, _, width = self.books.shape
        return np.matmul(self.books.astype(np.float32), q.reshape(len(q), parts, width).transpose(1, 2, 0).astype(np.float32))


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half, out = (centres**2).sum(1) / 2, np.empty(len(x), np.int64)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = np.argmin(half - x[at : at + 4096] @ centres.T, axis=1)
    return out


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _closest(x, centres)
        order = np.argsort(near, kind="stable")
        cells, starts = np.unique(near[order], return_index=True)
        centres[cells] = np.add.reduceat(x[order], starts, axis=0) / np.diff(np.append(starts, len(x)))[:, None]
    return centres


def fit(sample: np.ndarray, total: int, k: int = NEIGHBOURS, coverage: float = COVERAGE) -> Index:
    """An index for ``total`` vectors from a sample of them.

    About sqrt(total) cells: up to ``CENTROIDS`` by one level of centroids, beyond that by a second
    level on the residuals. The number to probe is the least that holds ``coverage`` of the true
    neighbours of sampled queries, so that data without clusters get more probes, not less recall.
    """
    rng, (n, d) = np.random.default_rng(0), sample.shape
    cells, most = max(1, round(total**0.5)), max(1, min(CENTROIDS, n // 8))
    coarse = _kmeans(sample, min(cells, most), 8, rng)
    left = sample - coarse[_closest(sample, coarse)]
    fine = _kmeans(left, min(-(-cells // most), most), 8, rng) if cells > most else np.zeros((1, d))
    width = 2 if d % 2 == 0 else 1
    index = Index(coarse, fine, np.zeros((d // width, 1, width)), 1)
    cell = index.assign(sample)
    residual = (sample - index.centroid(cell)).reshape(n, d // width, width)
    some = residual[rng.choice(n, min(n, BOOK_SAMPLE), replace=False)]
    index.books = np.stack([_kmeans(some[:, i], min(256, n), 4, rng) for i in range(d // width)])
    ask = rng.choice(n, min(n, JUDGED), replace=False)
    needed = []
    for at in range(0, len(ask), 16):
        q = sample[ask[at : at + 16]]
        products = q @ sample.T
        products[np.arange(len(q)), ask[at : at + 16]] = -np.inf
        near = np.argpartition(-products, min(k, n - 1) - 1, axis=1)[:, : min(k, n - 1)] if n > 1 else np.empty((len(q), 0), int)
        needed.append(_places(index, q, cell[near]).ravel())
    index.probes = _enough(index, np.concatenate(needed), coverage)
    return index


def _places(index: Index, q: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """For each query and each of its ``cells``, the number of cells to probe until that one is."""
    by_cell = index.cell_products(q)
    return np.stack([np.searchsorted(np.sort(-b), -b[c], side="right") for b, c in zip(by_cell, cells, strict=True)])


def _enough(index: Index, places: np.ndarray, coverage: float) -> int:
    """The number of cells to probe that holds ``coverage`` of the neighbours at ``places``."""
    places = np.sort(places)
    return int(places[min(len(places) - 1, int(np.ceil(coverage * len(places))))]) if len(places) else index.cells


def probed(index: Index, q: np.ndarray, held: np.ndarray, least: int) -> list[np.ndarray]:
    """The cells that each query probes: the ``index.probes`` nearest, and more until they hold ``least`` of the vectors, ``held`` by cell."""
    out = []
    step = max(1, (1 << 22) // index.cells)
    for at in range(0, len(q), step):
        for products in index.cell_products(q[at : at + step]):
            first = np.argpartition(-products, index.probes - 1)[: index.probes]
            if held[first].sum() < least and index.probes < index.cells:
                order = np.argsort(-products)
                enough = int(np.searchsorted(np.cumsum(held[order]), least)) + 1
                first = order[: max(index.probes, enough)]
            out.append(first[held[first] > 0].astype(np.int32))
    return out


def floors(index: Index, q: np.ndarray, cells: list[np.ndarray], sample_cell: np.ndarray, sample_codes: np.ndarray, total: int, most: int, k: int, sample: np.ndarray | None = None) -> np.ndarray:
    """For each query a product that its ``most`` best of the table surely reach: the sample's share of them and some more, read from the tables over the sample's rows in its cells; -inf where the cells hold too few of those.

    With the vectors of the ``sample`` the products are exact, but for rounding, which is taken off. Then ``most`` 0 gives what the ``k`` best reach in any case.
    """
    n = len(sample_cell)
    mean = most * n / max(1, total)
    wanted = max(k, int(np.ceil(mean + 4 * mean**0.5 + 1)))
    out = np.full(len(q), -np.inf)
    if n <= wanted:
        return out
    for at in range(0, len(q), 64):
        part = q[at : at + 64]
        if sample is None:
            tables, approx = index.tables(part), index.cell_products(part)[:, sample_cell].astype(np.float32)
            for p in range(len(tables)):
                approx += np.take(tables[p], sample_codes[:, p], axis=0).T
        else:
            approx = part @ sample.T - 1e-12 * np.linalg.norm(part, axis=1)[:, None] * np.linalg.norm(sample, axis=1)
        for i, row in enumerate(approx):
            mine = np.zeros(index.cells, bool)
            mine[cells[at + i]] = True
            row = row[mine[sample_cell]]
            if len(row) > wanted:
                out[at + i] = np.partition(row, len(row) - wanted)[len(row) - wanted]
    return out


def search_block(index: Index, cell: int, codes: np.ndarray, queries: np.ndarray, floor: np.ndarray, most: int, exact: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, product) of one cell's vectors that reach the query's floor, its ``most`` best at most.

    By the distance tables alone, or with ``exact``, the vectors and their ``offsets``: then every
    vector that may be one of the ``most`` best meets the query, and the products are exact; of equal
    ones the first rows stay.
    """
    q_rows, v_rows, products = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.float64 if exact else np.float32)]
    base, by_part = queries @ index.centroid(np.array([cell]))[0], np.ascontiguousarray(codes.T)
    for at in range(0, len(queries), 64):
        part, least = queries[at : at + 64], floor[at : at + 64]
        tables = index.tables(part)
        approx = np.tile(base[at : at + 64].astype(np.float32), (len(codes), 1))
        for p in range(len(tables)):
            approx += np.take(tables[p], by_part[p], axis=0)
        approx = np.ascontiguousarray(approx.T)
        slack = np.linalg.norm(part, axis=1)[:, None] * exact[1] if exact else np.float32(0)
        if len(codes) > most:
            least = np.maximum(np.partition(approx - slack, len(codes) - most, axis=1)[:, len(codes) - most], least)
        row, col = np.nonzero(approx + slack >= least[:, None])
        product = approx[row, col]
        if exact:
            steps = range(0, len(row), PAIRS)
            product = np.concatenate([np.empty(0), *[np.einsum("ij,ij->i", exact[0][col[i : i + PAIRS]], part[row[i : i + PAIRS]]) for i in steps]])
            order = np.lexsort((col, -product, row))
            order = order[(np.arange(len(order)) - np.searchsorted(row[order], row[order], side="left") < most) & (product[order] >= floor[at : at + 64][row[order]])]
            row, col, product = row[order], col[order], product[order]
        q_rows.append(row + at)
        v_rows.append(col)
        products.append(product)
    return np.concatenate(q_rows), np.concatenate(v_rows), np.concatenate(products)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v): rows with an id and a vector of finite components, not all zero, of the commonest length; one row per id (the smallest vector)."""
    v = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0.0)
    )
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, every: int = 20, k: int = NEIGHBOURS, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """The ``k`` nearest of each query (ids divisible by ``every``): query_id, rank from 1, vec_id and score.

    Score is the inner product in double precision; ties go to the smaller vec_id; a query is not
    its own neighbour. With fewer candidates all are returned.

    * Vectors that are null, zero, or hold null or non-finite components take no part, nor do null
      ids and vectors of another length than the commonest. Of rows that share an id the smallest vector counts.
    * Equal vectors are searched once, as one class with its k + 1 smallest ids, which holds every
      id that can be among anyone's k nearest; so thousands of copies cost no more than one row.
    * Only the two columns are read. Without usable vectors the result is empty.

    Cells are cut into blocks of bounded rows and bounded queries, so neither a popular cell nor a
    large table gathers in one task. There every vector whose approximate product, with its distance
    from its codes, may reach the query's k + 1 best meets the query for the exact product: within the
    probed cells nothing is lost, however alike the vectors are. How many are probed is judged by the
    true neighbours of ``JUDGED`` sampled queries among all rows. The driver holds the sample, those
    neighbours' cells and one number a cell.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = written(usable(vectors, vec_id, embedding), "vectors")
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return empty
    rows, total, d = rows.filter(F.size("v") == common.d), common["count"], common.d
    stored = np.dtype("<f4" if vectors.schema[embedding].dataType.elementType.typeName() == "float" else "<f8")  # the vectors as they came, exactly

    copies = Window.partitionBy("v").orderBy("id")
    members = rows.withColumn("i", F.row_number().over(copies)).filter(F.col("i") <= k + 1)  # cut to k + 1 a task before the shuffle
    members = written(members.withColumn("class", F.min("id").over(Window.partitionBy("v"))), "classes")
    classes = members.filter(F.col("i") == 1).select(F.col("class"), "v")

    draw = F.xxhash64("class", F.lit("sample"))
    parts = max(1, 4 * total // (5 * sample))  # about a quarter more than wanted, of which the first by hash stay
    drawn = classes.filter(F.pmod(draw, F.lit(parts)) == 0).orderBy(draw, "class").limit(sample).toPandas()
    if drawn.empty:
        drawn = classes.orderBy(draw, "class").limit(sample).toPandas()
    judged, drawn = drawn["class"].to_numpy()[:JUDGED], np.stack(drawn["v"]).astype(np.float64)
    index = fit(drawn, total, k)
    sample_cell = index.assign(drawn)
    sample_codes = index.codes(drawn, sample_cell)
    kept = drawn.astype(stored)

    def file_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                cell = index.assign(x)
                codes = index.codes(x, cell)
                off = pa.array(index.offsets(x, cell, codes).astype(np.float32))
                yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(cell, pa.int32()), _bytes(codes), off, _bytes(x.astype(stored))], names=["class", "cell", "codes", "off", "vec"])

    filed = written(classes.mapInArrow(file_rows, "class bigint, cell int, codes binary, off float, vec binary"), "inverted-file")
    index.probes = _judge(filed, index, judged, kept[: len(judged)], k)
    in_cell = {r.cell: r["count"] for r in filed.groupBy("cell").count().collect()}  # one number a cell
    held = np.zeros(index.cells, np.int64)
    held[list(in_cell)] = list(in_cell.values())

    asked = rows.filter(F.col("id") % every == 0).select("id", F.col("v").alias("qv"))
    asked = written(asked.join(classes, F.col("qv") == F.col("v")).select(F.col("id").alias("query_id"), F.col("class").alias("qclass")), "queries")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q = _vectors(batch.column("vec"), stored, d)
                cells = probed(index, q, held, LEAST_HELD * (k + 1))
                floor = floors(index, q, cells, sample_cell, sample_codes, int(held.sum()), 0, k + 1, kept.astype(np.float64))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, cells)]), pa.int32()), pa.array(np.concatenate(cells), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("vec"), pa.array(floor), lists], names=["class", "vec", "floor", "cells"])

    one_each = asked.select("qclass").distinct()
    probing = one_each.join(filed, F.col("qclass") == F.col("class")).select("class", "vec").mapInArrow(probe, "class bigint, vec binary, floor double, cells array<int>")
    probing = written(probing.select(F.col("class").alias("q"), F.col("vec").alias("qvec"), "floor", "cells"), "probes")
    sought = probing.select("q", "qvec", "floor", F.explode("cells").alias("cell"))
    blocks = lambda df, size, name: df.groupBy(F.col("cell").alias("c")).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    counts = written(blocks(filed, BLOCK_ROWS, "nr").join(blocks(sought, BLOCK_QUERIES, "nq"), "c"), "blocks")  # one row a cell
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda id, n: F.pmod(F.xxhash64(id, F.lit("block")), F.col(n)).cast("int")
    left = filed.join(counts, F.col("cell") == F.col("c")).select("class", "cell", "codes", "off", "vec", deal("class", "nr").alias("rb"), upto("nq").alias("qb"))
    right = sought.join(counts, F.col("cell") == F.col("c")).select("q", "qvec", "floor", "cell", deal("q", "nq").alias("qb"), upto("nr").alias("rb"))

    def meet(key: tuple, x: pa.Table, q: pa.Table) -> pa.Table:
        qs, vs, s = [], [], []
        if x.num_rows and q.num_rows:
            x = x.sort_by("class")
            codes, exact = _vectors(x.column("codes"), np.dtype(np.uint8), index.books.shape[0]), (_vectors(x.column("vec"), stored, d), x.column("off").to_numpy())
            qs, vs, s = search_block(index, key[0].as_py(), codes, _vectors(q.column("qvec"), stored, d), q.column("floor").to_numpy(), k + 1, exact)
        at = lambda column, i: column.to_numpy()[i] if len(i) else np.empty(0, np.int64)
        return pa.table({"q": at(q.column("q"), qs), "class": at(x.column("class"), vs), "score": np.asarray(s, np.float64)})

    found = left.groupBy("cell", "rb", "qb").cogroup(right.groupBy("cell", "rb", "qb")).applyInArrow(meet, "q bigint, class bigint, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "class")
    top = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).select("q", F.col("class").alias("c"), "score")
    spread = members.select(F.col("class"), F.col("id").alias("member"))
    listed = top.join(spread, F.col("c") == F.col("class")).withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "member"))).filter(F.col("n") <= k + 1)
    listed = listed.select("q", "member", "score")
    answers = asked.join(listed, F.col("qclass") == F.col("q")).filter(F.col("query_id") != F.col("member"))
    final = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "member"))).filter(F.col("rank") <= k)
    return final.select("query_id", "rank", F.col("member").alias("vec_id"), "score")


def _judge(filed: DataFrame, index: Index, judged: np.ndarray, vectors: np.ndarray, k: int) -> int:
    """The number of cells to probe that holds ``COVERAGE`` of the true ``k`` nearest, among all filed rows, of some queries (their classes and vectors)."""
    d, n, stored = vectors.shape[1], len(judged), vectors.dtype

    def nearest_of_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, cell, q = np.full((n, k), -np.inf), np.zeros((n, k), np.int32), vectors.astype(np.float64)
        for batch in batches:
            own, cells, x = batch.column("class").to_numpy(), batch.column("cell").to_numpy(), _vectors(batch.column("vec"), stored, d)
            for at in range(0, len(x), 4096):
                products = q @ x[at : at + 4096].T
                products[judged[:, None] == own[at : at + 4096]] = -np.inf
                products = np.concatenate([score, products], axis=1)
                held = np.concatenate([cell, np.broadcast_to(cells[at : at + 4096], (n, products.shape[1] - k))], axis=1)
                best = np.argpartition(-products, k - 1, axis=1)[:, :k]
                score, cell = np.take_along_axis(products, best, 1), np.take_along_axis(held, best, 1)
        row, col = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(cell[row, col], pa.int32()), pa.array(score[row, col])], names=["i", "cell", "score"])

    place = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), "cell"))
    rows = filed.select("class", "cell", "vec").mapInArrow(nearest_of_all, "i bigint, cell int, score double").withColumn("n", place).filter(F.col("n") <= k).select("i", "cell").collect()  # k a query
    at = [(r.i, r.cell) for r in rows]
    places = [_places(index, vectors[i : i + 1].astype(np.float64), np.array([[c for j, c in at if j == i]], int)).ravel() for i in sorted({i for i, _ in at})]
    return _enough(index, np.concatenate([np.empty(0, int), *places]), COVERAGE)


def _bytes(rows: np.ndarray) -> pa.Array:
    """Every row's bytes as a binary value."""
    rows = np.ascontiguousarray(rows)
    n, width = len(rows), rows.itemsize * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, n * width + 1, width, dtype=np.int32) if n else np.zeros(1, np.int32)), pa.py_buffer(rows)])


def _vectors(column: pa.Array | pa.ChunkedArray, kind: np.dtype, d: int) -> np.ndarray:
    """Binary values of ``d`` numbers each as the rows of an array; floats as doubles."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    begin = lambda c: int(np.frombuffer(c.buffers()[1], np.int32)[c.offset])
    parts = [np.frombuffer(c.buffers()[2], np.uint8)[begin(c) : begin(c) + len(c) * kind.itemsize * d] for c in chunks if len(c)]
    out = np.concatenate(parts).view(kind).reshape(-1, d) if parts else np.empty((0, d), kind)
    return out if kind == np.uint8 else out.astype(np.float64)
