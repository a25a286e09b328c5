"""Exact search for the largest inner products with an M-tree.

The tree is made for a metric. Vectors of norm at most M get one more component, sqrt(M^2 - |x|^2), and queries a
zero there: then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the largest products are the nearest vectors.

The root holds routing objects chosen from a bounded sample. Under each lie pages, of a size that keeps their
number bounded; a page is a row with its nodes: routing object, covering radius, distance to the page's routing
object, and the members. A query first searches one page of its nearest routing object, which bounds what it still
looks for. Then it visits, with the queries of its block, the pages that the triangle inequality cannot rule out,
and in a page the nodes, nearest first: a node is skipped on stored distances alone where they suffice, and its
routing object's distance is computed only where they do not.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolens.llm import common as C

ROOTS = 64
SAMPLE = 4096
PAGE = 4096
#: Pages that the root may list; beyond PAGE times as many vectors, pages get larger.
MOST_PAGES = 1 << 16
LEAF = 64
BLOCK = 512
#: Room for rounding in the bounds, so that no tie is lost, as a share of the largest norm (plus one).
SLACK = 4e-7
#: Below every score: squares of the vectors that take part are less than this, so all products are.
NONE = -(1 << 62)
#: Whole numbers below this are exact as doubles, in sums too.
EXACT = 1 << 53


def room(most: float) -> float:
    return SLACK * (1 + most**0.5)


def vectors(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """id, x: floor(scale * component) of every vector without null or non-finite components, as 32-bit numbers.

    Vectors whose own square no 64-bit number holds are left out.
    """
    width = df.agg(F.max(F.size(vector_col))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = np.zeros((len(batch), width))
            row = np.repeat(np.arange(len(batch)), size)
            x[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = values
            good = np.isfinite(x).all(axis=1) & lists.is_valid().to_numpy(zero_copy_only=False)
            x[~good] = 0
            with np.errstate(over="ignore"):
                x = np.floor(scale * x)
                square = (x * x).sum(axis=1)
            good &= square < -NONE
            x, square = x[good], square[good]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(good)), pa.array([v.tobytes() for v in x.astype("<i4")], pa.binary()), pa.array(square)], names=["id", "x", "square"]
            )

    chosen = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    return chosen.mapInArrow(run, "id long, x binary, square double")


def matrix(column) -> np.ndarray:
    """Rows of a binary column as 64-bit floats."""
    rows = [x.as_buffer() for x in column]
    return np.array([np.frombuffer(r, "<i4") for r in rows], np.float64).reshape(len(rows), -1)


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(axis=1)))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T))


def products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Inner products of rows of whole numbers: as doubles where those are exact, else as 64-bit numbers, which hold them all."""
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def farthest_first(x: np.ndarray, k: int, least: float) -> np.ndarray:
    """Rows of which each is farthest from those before it; fewer than k where all others are equal to one of them."""
    chosen = [0]
    near = distances(x, x[:1])[:, 0]
    while len(chosen) < min(k, len(x)):
        best = int(np.argmax(near))
        if near[best] <= least:
            break
        chosen.append(best)
        near = np.minimum(near, distances(x, x[best : best + 1])[:, 0])
    return np.array(chosen)


def build_page(ids: np.ndarray, x: np.ndarray, most: float, root: np.ndarray) -> dict:
    """A page's nodes: members by node, routing objects, radii, distances to the page's routing object."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    y = lifted(x, most)
    routing = y[farthest_first(y[: 8 * LEAF], max(1, len(y) // LEAF), room(most))]
    near = distances(y, routing)
    node = near.argmin(axis=1)
    order = np.argsort(node, kind="stable")
    size = np.bincount(node, minlength=len(routing))
    radius = np.zeros(len(routing))
    np.maximum.at(radius, node, near[np.arange(len(y)), node])
    return {
        "ids": ids[order], "x": x[order], "routing": routing, "size": size, "radius": radius,
        "to_root": distances(routing, root[None, :])[:, 0], "reach": float(distances(y, root[None, :]).max()),
    }


def search_page(page: dict, queries: np.ndarray, query_ids: np.ndarray, to_root: np.ndarray, floor: np.ndarray, active: np.ndarray, most: float, k: int):
    """Candidates (query, id, score) of a page: at most k for each active query, none below its `floor` score."""
    q = np.flatnonzero(active)
    empty = np.zeros(0, np.int64)
    if not len(q):
        return empty, empty, empty
    own = queries[q]
    square = (own * own).sum(axis=1)
    # The k best scores so far and, from the least of them, how far away the next may be.
    best = np.full((len(q), k), NONE, np.int64)
    least = floor[q].copy()
    far = lambda: np.sqrt(np.maximum(0.0, square + most - 2.0 * least)) + room(most)
    ends = np.cumsum(page["size"])
    # From stored distances alone.
    bound = np.abs(to_root[q][:, None] - page["to_root"][None, :]) - page["radius"][None, :]
    reach = far()
    open_ = bound <= reach[:, None]
    measured = distances(np.column_stack([own, np.zeros(len(q))]), page["routing"][open_.any(axis=0)])
    bound[:, open_.any(axis=0)] = np.maximum(bound[:, open_.any(axis=0)], measured - page["radius"][None, open_.any(axis=0)])
    heap = [(float(bound[open_[:, n], n].min()), n) for n in range(len(ends)) if open_[:, n].any()]
    heapq.heapify(heap)
    rows, ids, scores = [], [], []
    while heap:
        _, n = heapq.heappop(heap)
        live = np.flatnonzero(bound[:, n] <= reach)
        a, b = ends[n] - page["size"][n], ends[n]
        if not len(live) or a == b:
            continue
        product = products(own[live], page["x"][a:b], most)
        product[page["ids"][a:b][None, :] == query_ids[q[live]][:, None]] = NONE
        hit = (product >= least[live][:, None]) & (product > NONE)
        r, c = np.nonzero(hit)
        if not len(r):
            continue
        rows.append(live[r])
        ids.append(page["ids"][a:b][c])
        scores.append(product[r, c])
        some = np.flatnonzero(hit.any(axis=1))
        merged = np.concatenate([best[live[some]], product[some]], axis=1)
        best[live[some]] = -np.partition(-merged, k - 1, axis=1)[:, :k]
        least[live[some]] = np.maximum(least[live[some]], best[live[some]].min(axis=1))
        reach = far()
    if not rows:
        return empty, empty, empty
    rows, ids, scores = np.concatenate(rows), np.concatenate(ids), np.concatenate(scores)
    keep = scores >= least[rows]
    rows, ids, scores = rows[keep], ids[keep], scores[keep]
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    first = np.searchsorted(rows, rows)
    keep = np.arange(len(rows)) - first < k
    return q[rows[keep]], ids[keep], scores[keep]


_PAGE = "page long, root int, n long, reach double, ids binary, x binary, routing binary, size binary, radius binary, to_root binary"


def top_products(df: DataFrame, is_query: Callable[[Column], Column], k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, <id_col>, score: for each row whose id `is_query` picks, the k others of largest product.

    Products are of floor(scale * component), in whole numbers; ties go to the smaller id. A query's own id is no
    candidate. Rows that are null, hold null or non-finite components, or lack an id take no part, nor do those whose
    product with themselves is 2^62 or more, since a long could not hold all scores; shorter vectors count as if zeros
    followed. Rows that share an id are candidates each. An empty table gives none.
    """
    C.positive("k", k)
    spark = df.sparkSession
    table = C.staged(vectors(df, id_col, vector_col, scale), "vectors")
    schema = "query_id long, vec_id long, score long"
    n, most = table.agg(F.count("*"), F.max("square")).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long").withColumnRenamed("vec_id", id_col)
    sample = table.orderBy(F.xxhash64("id"), "id").select("x").limit(SAMPLE).toArrow()
    roots = lifted(matrix(sample.column("x")), most)
    roots = roots[farthest_first(roots, ROOTS, room(most))]
    capacity = max(PAGE, -(-n // MOST_PAGES))
    shared = spark.sparkContext.broadcast(roots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            near = distances(lifted(x, most), shared.value).argmin(axis=1)
            to = distances(np.column_stack([x, np.zeros(len(x))]), shared.value).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(to.astype(np.int32))], names=["id", "x", "root", "nearest"])

    placed = C.staged(table.select("id", "x").mapInArrow(assign, "id long, x binary, root int, nearest int"), "placed")
    sizes = {r.root: -(-r.n // capacity) for r in placed.groupBy("root").agg(F.count("*").alias("n")).collect()}  # at most ROOTS rows
    parts = F.element_at(F.create_map(*[F.lit(v) for kv in sizes.items() for v in kv]), F.col("root"))
    page_of = F.col("root").cast("long") * F.lit(1 << 32) + F.pmod(F.xxhash64("id"), parts.cast("long"))

    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        root = rows.column("root")[0].as_py()
        page = build_page(rows.column("id").to_numpy(), matrix(rows.column("x")), most, shared.value[root])
        return pa.table(
            {
                "page": pa.array([key[0].as_py()], pa.int64()), "root": pa.array([root], pa.int32()), "n": pa.array([len(page["ids"])], pa.int64()), "reach": pa.array([page["reach"]]),
                "ids": [page["ids"].astype("<i8").tobytes()], "x": [page["x"].astype("<i4").tobytes()], "routing": [page["routing"].tobytes()],
                "size": [page["size"].astype("<i8").tobytes()], "radius": [page["radius"].tobytes()], "to_root": [page["to_root"].tobytes()],
            }
        )

    pages = C.staged(placed.select(page_of.alias("page"), "root", "id", "x").groupBy("page").applyInArrow(build, _PAGE), "pages")
    listed = pages.select("page", "root", "reach").toPandas().sort_values("page")  # at most MOST_PAGES and ROOTS rows
    meta = spark.sparkContext.broadcast((listed["page"].to_numpy(), listed["root"].to_numpy(), listed["reach"].to_numpy()))
    first_page = {}
    for p, r in zip(listed["page"].tolist(), listed["root"].tolist()):
        first_page.setdefault(r, p)

    def block(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "nearest": rows.column("nearest").slice(0, 1), "qids": [rows.column("id").to_numpy().astype("<i8").tobytes()], "qx": [b"".join(v.as_py() for v in rows.column("x"))]})

    queries = placed.filter(is_query(F.col("id")))
    counted = {r.nearest: -(-r.n // BLOCK) for r in queries.groupBy("nearest").agg(F.count("*").alias("n")).collect()}
    if not counted:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long").withColumnRenamed("vec_id", id_col)
    split = F.element_at(F.create_map(*[F.lit(v) for kv in counted.items() for v in kv]), F.col("nearest"))
    block_of = F.col("nearest").cast("long") * F.lit(1 << 32) + F.pmod(F.xxhash64("id"), split.cast("long"))
    blocks = C.staged(queries.select(block_of.alias("block"), "nearest", "id", "x").groupBy("block").applyInArrow(block, "block long, nearest int, qids binary, qx binary"), "blocks")

    def unpack(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(batch.column("qids")[i].as_buffer(), "<i8")
        return ids, np.frombuffer(batch.column("qx")[i].as_buffer(), "<i4").reshape(len(ids), -1).astype(np.float64)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                qids, q = unpack(batch, i)
                get = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)
                page = {"ids": get("ids", "<i8"), "routing": get("routing", "<f8"), "size": get("size", "<i8"), "radius": get("radius", "<f8"), "to_root": get("to_root", "<f8")}
                page["x"] = get("x", "<i4").reshape(len(page["ids"]), -1).astype(np.float64)
                page["routing"] = page["routing"].reshape(len(page["radius"]), -1)
                root = shared.value[batch.column("root")[i].as_py()]
                to_root = distances(np.column_stack([q, np.zeros(len(q))]), root[None, :])[:, 0]
                floor = get("floor", "<i8")
                active = np.unpackbits(get("active", np.uint8), count=len(qids)).astype(bool)
                row, ids, scores = search_page(page, q, qids, to_root, floor, active, most, k)
                yield pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

    wants = "block long, page long, floor binary, active binary"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block with one page: of the root nearest to its queries, else of any."""
        for batch in batches:
            for i in range(len(batch)):
                qids, _ = unpack(batch, i)
                page = first_page.get(batch.column("nearest")[i].as_py(), next(iter(first_page.values())))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array([page], pa.int64()), pa.array([np.full(len(qids), NONE, "<i8").tobytes()], pa.binary()), pa.array([np.packbits(np.ones(len(qids), bool)).tobytes()], pa.binary())],
                    names=["block", "page", "floor", "active"],
                )

    def run(asked: DataFrame) -> DataFrame:
        return asked.join(blocks.select("block", "qids", "qx"), "block").join(pages, "page").mapInArrow(visit, schema)

    begun = C.staged(run(blocks.mapInArrow(first, wants)), "begun")
    floors = begun.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).select("query_id", F.when(F.col("n") >= k, F.col("least")).alias("least"))
    # One row per block again: what each of its queries must reach at least.
    of_block = queries.select(block_of.alias("block"), F.col("id").alias("query_id")).join(floors, "query_id", "left")
    of_block = of_block.groupBy("block").agg(F.collect_list(F.struct("query_id", F.coalesce("least", F.lit(NONE)).alias("least"))).alias("floors"))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All other pages that some query of the block may find something in."""
        page_ids, page_roots, reach = meta.value
        for batch in batches:
            for i in range(len(batch)):
                qids, q = unpack(batch, i)
                known = {f["query_id"]: f["least"] for f in batch.column("floors")[i].as_py()}
                floor = np.array([known[x] for x in qids.tolist()], "<i8")
                far = np.sqrt(np.maximum(0.0, (q * q).sum(axis=1) + most - 2.0 * floor)) + room(most)
                near = distances(np.column_stack([q, np.zeros(len(q))]), shared.value)
                begun_with = first_page.get(batch.column("nearest")[i].as_py(), next(iter(first_page.values())))
                for p, r, d in zip(page_ids.tolist(), page_roots.tolist(), reach.tolist()):
                    active = near[:, r] - d <= far
                    if p != begun_with and active.any():
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("block").slice(i, 1), pa.array([p], pa.int64()), pa.array([floor.tobytes()], pa.binary()), pa.array([np.packbits(active).tobytes()], pa.binary())],
                            names=["block", "page", "floor", "active"],
                        )

    found = begun.unionByName(run(blocks.join(of_block, "block").mapInArrow(rest, wants)))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id_col), "score")
