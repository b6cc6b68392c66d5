"""Exact top-k by inner product over an M-tree.

Tree.  A node with more than PAGE rows gets routing objects, about FAN of its own rows, and every row goes to the nearest by
Euclidean distance; so the tree grows by a level with every FAN-fold of the rows.  A node keeps its routing object, its covering
radius and its distance to the parent's.  Leaves are pages: in each a few entries route the others, with radii and distances of the
same kind.  Rows that no routing object tells apart (equal vectors) are dealt to pages of one leaf.

Search.  A row x within r of an object c has q.x <= q.c + |q| r, and q.c <= q.p + |q| d(p, c) for its parent's object p.  Each query
first walks down to one page, which gives a score that k rows reach.  Then it walks down all nodes that this score does not exclude:
through q.p and the stored distance before q.c is computed, then through q.c.  Its pages are visited best bound first, in waves that
grow fourfold; after each wave the k-th score found so far drops what is left of the queue.  Inside a page the same two bounds hold,
nodes best first, then entries by their stored distance.  Scores are exact integers; bounds only exclude.

Defined results: vectors that are null or hold null or non-finite components and rows without an id take no part; shorter
vectors are filled with zeros; rows that share the query's id are its own, and queries that
share an id are one, with the rows of all; ties go to the smaller id; fewer rows than k are
all returned; scores beyond 64 bits are not defined; an empty table gives an empty result; other columns do not take part.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import cut, discard

SCALE = 1024
FAN = 128
PAGE = 2048
NODES = 32
#: Queries that meet a page or the children of a node at once.
QUERY_BLOCK = 256
#: Rows that meet the routing objects of a node at once.
ROW_BLOCK = 20_000
#: Pages that a query visits in the first wave after its nearest one.
WAVE = 4
NONE = -(2**63)


def scaled(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id, v (binary doubles: floor of SCALE times the component), norm2."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = rows.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).where(good).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    most = usable.agg(F.max(F.size("x"))).first()[0] or 0

    def run(batches):
        for b in batches:
            lists = b.column(1)
            size = np.diff(lists.offsets.to_numpy())
            out = np.zeros((len(size), most))
            at = np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            out[at] = np.floor(SCALE * lists.flatten().to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in out], pa.binary()), pa.array((out * out).sum(axis=1))], ["id", "v", "norm2"])

    return usable.mapInArrow(run, "id long, v binary, norm2 double")


def _matrix(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(len(column), dims)


class space:
    """Vectors of ``dims`` components with norms up to ``largest``."""

    def __init__(self, dims: int, largest: float):
        self.dims, self.largest = dims, largest

    def vectors(self, column) -> np.ndarray:
        return _matrix(column, self.dims)

    def least(self, floor: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """What a bound has to reach for a score of ``floor``, with room for rounding."""
        return floor.astype(np.float64) - 1e-6 * norms * self.largest - 1


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; through floating point where every sum stays below 2**53."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    if np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2**53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def _blocks(rows: DataFrame, sizes: DataFrame, block: int, *by: str) -> DataFrame:
    """``rows`` with a number ``part`` so that about ``block`` of them share a node and a part; ``sizes``: node, rows."""
    parts = sizes.select("node", F.ceil(F.col("rows") / block).cast("int").alias("parts"))
    return rows.join(parts, "node").withColumn("part", F.pmod(F.xxhash64(*by), F.col("parts")).cast("int")).drop("parts")


def _every_part(rows: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """``rows`` once for each part that ``_blocks`` deals their node to."""
    parts = sizes.select("node", F.explode(F.sequence(F.lit(0), F.ceil(F.col("rows") / block).cast("int") - 1)).alias("part"))
    return rows.join(parts, "node")


def _to_nearest(m: space):
    def run(rows: pd.DataFrame, routers: pd.DataFrame) -> pd.DataFrame:
        if not len(routers) or not len(rows):
            return rows[["id", "v", "node", "d"]]
        routers = routers.sort_values("child")
        d = _distances(m.vectors(rows["v"]), m.vectors(routers["v"]))
        nearest = d.argmin(axis=1)
        return pd.DataFrame({"id": rows["id"].to_numpy(), "v": rows["v"].to_numpy(), "node": routers["child"].to_numpy()[nearest], "d": d[np.arange(len(d)), nearest]})

    return run


def grow(vectors: DataFrame, n: int, m: space) -> tuple[DataFrame, list[DataFrame]]:
    """The rows with their leaf (id, v, node, d: distance to its routing object; node 0 is the root, its object the zero vector) and
    the children by level: node, child, v, to_parent, radius over all rows below."""
    placed, levels, reached = vectors.select("id", "v", "node", F.sqrt("norm2").alias("d")), [], PAGE
    while reached < n:
        level, reached = len(levels) + 1, reached * FAN // 2
        sizes = cut(placed.groupBy("node").agg(F.count("*").alias("rows")).where(F.col("rows") > PAGE))
        # About twice as many children as pages are needed, FAN at most: rows drawn by hash.
        chance = F.least(F.lit(FAN), F.ceil(2 * F.col("rows") / PAGE)) / F.col("rows")
        drawn = placed.join(sizes.select("node", chance.alias("chance")), "node").where(F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 31)) < F.col("chance") * (1 << 31))
        routers = cut(drawn.groupBy("node", "v").agg(F.min("id").alias("id"), F.min("d").alias("to_parent")).select("node", "v", "to_parent", F.xxhash64(F.lit(level), "id", "v").alias("child")))
        rows = _blocks(placed, sizes, ROW_BLOCK, "id")
        dealt = rows.groupBy("node", "part").cogroup(_every_part(routers, sizes, ROW_BLOCK).groupBy("node", "part")).applyInPandas(_to_nearest(m), "id long, v binary, node long, d double")
        before, placed = placed, cut(dealt.unionByName(placed.join(sizes, "node", "left_anti")))
        radii = placed.groupBy(F.col("node").alias("child")).agg(F.max("d").alias("radius"))
        levels.append(cut(routers.join(radii, "child").select("node", "child", "v", "to_parent", "radius")))
        discard(sizes, routers, before if level > 1 else None)
    return placed, levels


def _build_page(m: space):
    def run(rows: pd.DataFrame, router: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        x = m.vectors(rows["v"])
        heads = np.arange(0, len(x), max(1, len(x) // NODES))[:NODES]
        d = _distances(x, x[heads])
        node = d.argmin(axis=1)
        order = np.argsort(node, kind="stable")
        own = d[np.arange(len(x)), node]
        radius = np.zeros(len(heads))
        np.maximum.at(radius, node, own)
        parent = _distances(x[heads], m.vectors(router["v"]))[:, 0]
        packed = (rows["id"].to_numpy()[order].astype("<i8"), x[order], own[order], np.bincount(node, minlength=len(heads)).astype("<i8"), x[heads], radius, parent)
        return pd.DataFrame([(int(rows["node"].iloc[0]), int(rows["part"].iloc[0]), *(c.tobytes() for c in packed))], columns=[c.split()[0] for c in PAGES.split(", ")])

    return run


PAGES = "node long, part int, ids binary, x binary, to_node binary, sizes binary, heads binary, radius binary, to_router binary"


class page:
    def __init__(self, row: dict, dims: int):
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.x = np.frombuffer(row["x"], "<f8").reshape(len(self.ids), dims)
        self.to_node = np.frombuffer(row["to_node"], "<f8")
        self.sizes = np.frombuffer(row["sizes"], "<i8")
        self.heads = np.frombuffer(row["heads"], "<f8").reshape(len(self.sizes), dims)
        self.radius = np.frombuffer(row["radius"], "<f8")
        self.to_router = np.frombuffer(row["to_router"], "<f8")
        self.starts = np.cumsum(self.sizes) - self.sizes


def search_page(p: page, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, at_router: np.ndarray, k: int, m: space):
    """For each query, its k best entries of the page with a score of ``floor`` or more: arrays of query number, id, score.
    ``at_router``: the queries' products with the page's routing object."""
    norms = np.sqrt((q * q).sum(axis=1))
    floor, least = floor.copy(), m.least(floor, norms)
    best = np.full((len(q), k), NONE)
    bound = at_router[:, None] + norms[:, None] * (p.to_router + p.radius)[None, :]
    found = []
    for n in np.argsort(-bound.max(axis=0)):
        active = np.flatnonzero(bound[:, n] >= least)
        if not len(active) or not p.sizes[n]:
            continue
        s = q[active] @ p.heads[n]
        near = s + norms[active] * p.radius[n] >= least[active]
        active, s = active[near], s[near]
        if not len(active):
            continue
        at = slice(p.starts[n], p.starts[n] + p.sizes[n])
        possible = s[:, None] + norms[active][:, None] * p.to_node[None, at] >= least[active][:, None]
        some = np.flatnonzero(possible.any(axis=0))
        if not len(some):
            continue
        rows = p.starts[n] + some
        score = _scores(q[active], p.x[rows])
        score[(p.ids[rows][None, :] == q_ids[active][:, None]) | ~possible[:, some]] = NONE
        both = np.concatenate([best[active], score], axis=1)
        best[active] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        floor[active] = np.maximum(floor[active], best[active].min(axis=1))
        least[active] = m.least(floor[active], norms[active])
        i, j = np.nonzero((score >= floor[active][:, None]) & (score > NONE))
        found.append((active[i], p.ids[rows[j]], score[i, j]))
    if not found:
        return (np.empty(0, np.int64),) * 3
    who, ids, score = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((ids, -score, who))
    who, ids, score = who[order], ids[order], score[order]
    keep = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[keep], ids[keep], score[keep]


def _expand(m: space, nearest: bool):
    """Queries at a node (id, v, floor, s: product with its object) and its children to the children that they go on to: with ``nearest`` one, else all that the bounds allow."""

    def run(rows: pd.DataFrame, children: pd.DataFrame) -> pd.DataFrame:
        names = ["id", "v", "floor", "s", "bound", "node"]
        if not len(rows) or not len(children):
            return pd.DataFrame(columns=names)
        q, radius = m.vectors(rows["v"]), children["radius"].to_numpy()
        norms = np.sqrt((q * q).sum(axis=1))[:, None]
        least = m.least(rows["floor"].to_numpy(np.int64), norms[:, 0])[:, None]
        stored = rows["s"].to_numpy()[:, None] + norms * (children["to_parent"].to_numpy() + radius)[None, :] >= least
        some = np.flatnonzero(stored.any(axis=0))
        s = q @ m.vectors(children["v"].iloc[some]).T
        bound = s + norms * radius[some][None, :]
        i, j = (np.arange(len(q)), s.argmax(axis=1)) if nearest else np.nonzero(stored[:, some] & (bound >= least))
        columns = [rows[c].to_numpy()[i] for c in ("id", "v", "floor")]
        return pd.DataFrame(dict(zip(names, [*columns, s[i, j], bound[i, j], children["child"].to_numpy()[some[j]]], strict=True)), columns=names)

    return run


QUEUE = "id long, v binary, floor long, s double, bound double, node long"


def _descend(queries: DataFrame, levels: list[DataFrame], leaves: DataFrame, m: space, nearest: bool) -> DataFrame:
    """From the root down: rows of QUEUE at leaves."""
    here = queries.select("id", "v", "floor", F.lit(0.0).alias("s"), F.lit(0.0).alias("bound"), "node")
    done = [here.join(leaves, "node", "left_semi").select(*here.columns)]
    for level in levels:
        sizes = here.groupBy("node").agg(F.count("*").alias("rows"))
        met = _blocks(here, sizes, QUERY_BLOCK, "id").groupBy("node", "part").cogroup(_every_part(level, sizes, QUERY_BLOCK).groupBy("node", "part"))
        here = cut(met.applyInPandas(_expand(m, nearest), QUEUE))
        done.append(here.join(leaves, "node", "left_semi").select(*here.columns))
    return reduce(DataFrame.unionByName, done)


def _visit(m: space, k: int):
    """Pages with the queries that visit them (ids, vectors, floors and products with the page's routing object) to query_id, vec_id, score."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                asked = row["asked"]
                q_ids, floor, at_router = (np.array([a[c] for a in asked], t) for c, t in (("id", np.int64), ("floor", np.int64), ("s", np.float64)))
                who, ids, score = search_page(page(row, m.dims), q_ids, m.vectors([a["v"] for a in asked]), floor, at_router, k, m)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[who]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


HITS = "query_id long, vec_id long, score long"


def _ask(queue: DataFrame, pages: DataFrame, m: space, k: int) -> DataFrame:
    """Hits of the queries at the pages (node, part) of the queue, in blocks of about QUERY_BLOCK queries a page."""
    sizes = queue.groupBy("node", "part").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    asked = queue.join(sizes, ["node", "part"]).groupBy("node", "part", block.alias("block")).agg(F.collect_list(F.struct("id", "v", "floor", "s")).alias("asked"))
    return pages.join(asked.drop("block"), ["node", "part"]).mapInArrow(_visit(m, k), HITS)


def _best(hits: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", place).where(F.col("rank") <= k)


def _floors(hits: DataFrame, k: int) -> DataFrame:
    """The k-th score so far (id, least) of queries that have k."""
    return hits.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select(F.col("query_id").alias("id"), "least")


def top_k(rows: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of every query with all rows but its own.
    ``is_query`` is a condition on the column ``id``, the id as long."""
    spark = rows.sparkSession
    vectors = cut(scaled(rows, vec_id, vector).withColumn("node", F.lit(0).cast("long")))  # all start at the root
    n, largest2, size = vectors.agg(F.count("*"), F.max("norm2"), F.max(F.octet_length("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    m = space(size // 8, float(np.sqrt(largest2)))
    placed, levels = grow(vectors, n, m)
    leaves = cut(placed.groupBy("node").agg(F.count("*").alias("rows")))
    root = spark.range(1).select(F.col("id").alias("node"), F.lit(bytes(size)).alias("v"))
    routers = reduce(DataFrame.unionByName, [x.select(F.col("child").alias("node"), "v") for x in levels], root).join(leaves.select("node"), "node", "left_semi")
    dealt = _blocks(placed, leaves, PAGE, "id").groupBy("node", "part")
    pages = cut(dealt.cogroup(_every_part(routers, leaves, PAGE).groupBy("node", "part")).applyInPandas(_build_page(m), PAGES))
    parts = pages.select("node", "part")

    queries = cut(vectors.where(is_query).dropDuplicates(["id", "v"]).select("id", "v", "norm2", "node", F.lit(NONE).alias("floor")))
    first = cut(_descend(queries, levels, leaves, m, True).join(parts.groupBy("node").agg(F.min("part").alias("part")), "node"))
    hits = cut(_best(_ask(first, pages, m, k), k).drop("rank"))
    known = queries.drop("floor").join(_floors(hits, k), "id", "left").withColumn("floor", F.coalesce("least", F.lit(NONE)))
    waiting = cut(_descend(cut(known), levels, leaves, m, False).join(parts, "node").join(first, ["id", "node", "part"], "left_anti"))
    wave = WAVE
    while not waiting.isEmpty():
        place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("bound"), "node", "part"))
        ranked = cut(waiting.withColumn("place", place))
        found = _ask(ranked.where(F.col("place") <= wave).drop("place"), pages, m, k)
        before, hits = hits, cut(_best(hits.unionByName(found), k).drop("rank"))
        rest = ranked.where(F.col("place") > wave).drop("place").join(_floors(hits, k), "id", "left").withColumn("floor", F.coalesce("least", "floor")).drop("least")
        old, waiting = waiting, cut(rest.mapInArrow(_still(m), f"{QUEUE}, part int"))
        discard(before, old, ranked)
        wave *= 4
    return _best(hits, k).select("query_id", "rank", "vec_id", "score")


def _still(m: space):
    """The queue without what the floors exclude by now."""

    def run(batches):
        for b in batches:
            row = {c: b.column(b.schema.get_field_index(c)) for c in ("id", "v", "floor", "s", "bound", "node", "part")}
            norms = np.sqrt((m.vectors(row["v"].to_pylist()) ** 2).sum(axis=1))
            keep = pa.array(np.flatnonzero(row["bound"].to_numpy() >= m.least(row["floor"].to_numpy(), norms)))
            yield pa.RecordBatch.from_arrays([c.take(keep) for c in row.values()], list(row))

    return run
