"""Approximate nearest neighbours by a hierarchical navigable small-world graph per shard.

Distinct vectors are dealt at random into shards that a task can hold (SHARD_BYTES). A shard's
graph is built from the top layer down by insertion: blocks of new nodes search the graph so far
by beam, their candidates are thinned by the usual diversity rule, and links go both ways. Nodes
are numbered by a random order and a layer is a prefix of it, so a layer is one flat array of
links. The graph is stored a node a row. A search task reads its shard's nodes, then streams the
queries through, in lockstep over blocks of them; the shards' results are merged. Inner products
become distances by one added component, so that all vectors of a shard have one length.

Copies of a vector are one node with its smallest ids, so a vector that is most of the table
costs no more than another and ties come out exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, saved

#: What a task may hold of a shard: vectors twice, links and ids.
SHARD_BYTES = 32_000_000
#: Links of a new node, the most with links back, thinning from layer to layer.
LINKS, MOST_LINKS, THINNING = 24, 48, 16
#: Beam widths: on upper layers, on a new node's layer, of a query on the lowest; nodes expanded at a time.
UPPER_BEAM, BUILD_BEAM, BEAM, EXPAND = 8, 48, 192, 6
#: Nodes or queries that go in lockstep, and queries that one copy of a shard's graph answers.
BLOCK, QUERY_BLOCK = 256, 1 << 18


def lifted(v: np.ndarray) -> np.ndarray:
    """v with a component that brings all rows to the longest one's length."""
    squares = (v * v).sum(axis=1)
    return np.concatenate([v, np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0.0))[:, None]], axis=1)


def sorted_set(keys: np.ndarray) -> np.ndarray:
    keys.sort()
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start, and their lengths."""
    first = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return first, np.diff(np.append(first, len(sorted_values)))


def diverse(points: np.ndarray, rows: np.ndarray, near: np.ndarray, value: np.ndarray, links: int) -> np.ndarray:
    """Of candidates (-1: none) with their products with the row, nearest first: keeps one if it is nearer to the row than to any kept one; fills up with the nearest of the rest."""
    out = np.full((len(rows), links), -1, dtype=np.int32)
    for i in range(0, len(rows), BLOCK):
        c, own = near[i : i + BLOCK], np.where(near[i : i + BLOCK] >= 0, value[i : i + BLOCK], -np.inf)
        by = np.argsort(-own, axis=1, kind="stable")[:, : 2 * links]
        c, own = np.take_along_axis(c, by, axis=1), np.take_along_axis(own, by, axis=1)
        p = points[c]
        between = p @ p.transpose(0, 2, 1)
        kept, closest, count = np.zeros(c.shape, dtype=bool), np.full(c.shape, -np.inf, dtype=np.float32), np.zeros(len(c), dtype=int)
        for j in range(c.shape[1]):
            keep = (c[:, j] >= 0) & (own[:, j] > closest[:, j]) & (count < links)
            kept[:, j] = keep
            count += keep
            closest[keep] = np.maximum(closest[keep], between[keep, j])
        by = np.argsort(np.where(kept, 0, np.where(c >= 0, 1, 2)), axis=1, kind="stable")[:, :links]
        out[i : i + len(c), : by.shape[1]] = np.take_along_axis(c, by, axis=1)
    return out


class Graph:
    """Points (lifted for a build, plain for a search) and a flat array of links for each layer, lowest first."""

    def __init__(self, points: np.ndarray, layers: list[np.ndarray]):
        self.points, self.layers, self.visited = points, layers, 0
        self.seen = np.zeros((0, 0), dtype=bool)

    def beam(self, layer: int, queries: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nodes of the largest inner product found from ``start``, and the products; -1 where fewer; unordered."""
        points, links = self.points, self.layers[layer]
        n, count = len(queries), len(points)
        if self.seen.shape[0] < n or self.seen.shape[1] != count:
            self.seen = np.zeros((max(n, BLOCK), count), dtype=bool)
        seen, touched = self.seen.reshape(-1), []
        ids, value = np.full((n, width), -1, dtype=np.int32), np.full((n, width), -np.inf, dtype=np.float32)
        done = np.ones((n, width), dtype=bool)
        rows, at = np.nonzero(start >= 0)
        keys = sorted_set(rows * count + start[rows, at])
        active = np.arange(n)
        while len(keys):
            seen[keys] = True
            touched.append(keys)
            rows, nodes = np.divmod(keys, count)
            products = np.einsum("nd,nd->n", points[nodes], queries[rows])
            first, lengths = runs(rows)
            good = products > np.repeat(value[rows[first]].min(axis=1), lengths)
            rows, nodes, products = rows[good], nodes[good], products[good]
            if len(rows):
                first, lengths = runs(rows)
                which, place = rows[first], np.arange(len(rows)) - np.repeat(first, lengths)
                more_ids = np.full((len(which), lengths.max()), -1, dtype=np.int32)
                more = np.full(more_ids.shape, -np.inf, dtype=np.float32)
                line = np.repeat(np.arange(len(which)), lengths)
                more_ids[line, place], more[line, place] = nodes, products
                i = np.concatenate([ids[which], more_ids], axis=1)
                v = np.concatenate([value[which], more], axis=1)
                d = np.concatenate([done[which], more_ids < 0], axis=1)
                top = np.argpartition(-v, width - 1, axis=1)[:, :width]
                ids[which], value[which], done[which] = (np.take_along_axis(x, top, axis=1) for x in (i, v, d))
            active = active[~done[active].all(axis=1)]
            if not len(active):
                break
            waiting = np.where(done[active], -np.inf, value[active])
            pick = np.argpartition(-waiting, min(EXPAND, width) - 1, axis=1)[:, :EXPAND]
            good = np.take_along_axis(waiting, pick, axis=1) > -np.inf
            line = np.broadcast_to(active[:, None], pick.shape)
            line, pick = line[good], pick[good]
            done[line, pick] = True
            new = links[ids[line, pick]]
            keys = (line[:, None] * count + new)[new >= 0]
            keys = sorted_set(keys[~seen[keys]])
        for keys in touched:
            seen[keys] = False
            self.visited += len(keys)
        return ids, value

    def descend(self, queries: np.ndarray, above: int) -> np.ndarray:
        """Where the search of layer ``above`` - 1 starts: what a beam from the top finds on layer ``above``."""
        top = len(self.layers) - 1
        first = min(len(self.layers[top]), THINNING)
        at = np.broadcast_to(np.arange(first), (len(queries), first))
        for layer in range(top, above - 1, -1):
            at, _ = self.beam(layer, queries, at, min(len(self.layers[layer]), UPPER_BEAM))
        return at

    def search(self, queries: np.ndarray, width: int) -> np.ndarray:
        return self.beam(0, queries, self.descend(queries, 1), min(width, len(self.points)))[0]


def link_back(points: np.ndarray, links: np.ndarray, new: np.ndarray, forward: np.ndarray) -> None:
    """Adds each new node to the links of those it links to; where there is no room the diversity rule decides."""
    u, v = np.repeat(new, forward.shape[1]), forward.ravel()
    u, v = u[v >= 0], v[v >= 0]
    if not len(u):
        return
    order = np.lexsort((-np.einsum("nd,nd->n", points[u], points[v]), v))
    u, v = u[order], v[order]
    first, lengths = runs(v)
    place = np.arange(len(v)) - np.repeat(first, lengths)
    which = v[first]
    width = min(int(lengths.max()), MOST_LINKS)
    more = np.full((len(which), width), -1, dtype=np.int32)
    line = np.repeat(np.arange(len(which)), lengths)
    near = place < width
    more[line[near], place[near]] = u[near]
    both = np.concatenate([links[which], more], axis=1)
    # A link that stands already is not added twice.
    double = (both[:, MOST_LINKS:, None] == both[:, None, :MOST_LINKS]).any(axis=2) & (more >= 0)
    both[:, MOST_LINKS:][double] = -1
    by = np.argsort(both < 0, axis=1, kind="stable")
    both = np.take_along_axis(both, by, axis=1)
    held = (both >= 0).sum(axis=1)
    roomy = held <= MOST_LINKS
    links[which[roomy]] = both[roomy, :MOST_LINKS]
    if not roomy.all():
        which, both = which[~roomy], both[~roomy]
        for i in range(0, len(which), 1024):
            w, b = which[i : i + 1024], both[i : i + 1024]
            links[w] = diverse(points, w, b, np.einsum("ncd,nd->nc", points[b], points[w]), MOST_LINKS)


def build(vectors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of nodes, and the layers from the lowest up: links (-1: none) of the order's first nodes."""
    n = len(vectors)
    order = np.random.default_rng(6).permutation(n)
    points = lifted(vectors[order]).astype(np.float32)
    sizes = [n]
    while sizes[-1] // THINNING >= THINNING:
        sizes.append(sizes[-1] // THINNING)
    graph = Graph(points, [])
    for size in reversed(sizes):
        links = np.full((size, MOST_LINKS), -1, dtype=np.int32)
        graph.layers.insert(0, links)
        done = 0
        while done < size:
            # Blocks double until they are BLOCK: a block's nodes find each other by all their products.
            new = np.arange(done, min(size, done + min(BLOCK, max(THINNING, done))))
            own = points[new] @ points[new].T
            np.fill_diagonal(own, -np.inf)
            near, value = np.broadcast_to(new.astype(np.int32), own.shape), own
            if len(new) > 2 * LINKS:
                top = np.argpartition(-own, 2 * LINKS - 1, axis=1)[:, : 2 * LINKS]
                near, value = new.astype(np.int32)[top], np.take_along_axis(own, top, axis=1)
            near = np.where(value > -np.inf, near, -1)
            if done:
                start = graph.descend(points[new], 1)
                found, products = graph.beam(0, points[new], np.where(start < done, np.maximum(start, 0), 0), min(done, BUILD_BEAM))
                near, value = np.concatenate([found, near], axis=1), np.concatenate([products, value], axis=1)
            forward = diverse(points, new, near, value, LINKS)
            links[new, :LINKS] = forward
            link_back(points, links, new, forward)
            done += len(new)
    return order, graph.layers


def usable(vector: Column) -> Column:
    """Not null, not zero, every component finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column) -> np.ndarray:
    """An Arrow column of lists of one length."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def by_shard(batches):
    """(shard, table) of each run of rows with one shard; rows come sorted by shard."""
    import pyarrow as pa

    at, held = None, []
    for batch in batches:
        shards = batch.column(0).to_numpy()
        cuts = np.flatnonzero(shards[1:] != shards[:-1]) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(shards)], strict=True):
            if lo == hi:
                continue
            if held and at != shards[lo]:
                yield at, pa.Table.from_batches(held)
                held = []
            at = shards[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield at, pa.Table.from_batches(held)


def index(df: DataFrame, id_col: str, vector_col: str, keep: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """shard, dim, pos, v, ids (smallest ``keep`` of each vector), links (int32, MOST_LINKS for each of the node's layers). One row a node.

    Rows with a null id and vectors that are null, zero or hold a null or non-finite component
    are left out; each length of vectors has shards of its own. An empty table gives no row.
    """
    vector = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    ranked = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("r") <= keep)
    distinct = saved(ranked.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")), "vectors")
    # One number for each length of vectors.
    shards, total = [], 0
    for r in distinct.groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect():
        n = -(-r["count"] * (12 * r["dim"] + 5 * MOST_LINKS + 60) // shard_bytes)
        shards.append((r["dim"], total, n))
        total += n
    plan = df.sparkSession.createDataFrame(shards, "dim int, first int, n int")
    dealt = distinct.select("ids", "v", F.size("v").alias("dim")).join(F.broadcast(plan), "dim")
    dealt = dealt.select((F.col("first") + F.pmod(F.xxhash64("v"), F.col("n"))).cast("int").alias("shard"), "dim", "v", "ids")

    def run(batches):
        import pyarrow as pa

        for shard, table in by_shard(batches):
            vectors = matrix(table.column("v"))
            order, layers = build(vectors)
            table = table.select(["shard", "dim", "v", "ids"])
            for lo in range(0, len(order), 4096):
                at = order[lo : lo + 4096]
                part = table.take(pa.array(at)).combine_chunks()
                links = [b"".join(layer[n].tobytes() for layer in layers if n < len(layer)) for n in range(lo, lo + len(at))]
                columns = [part.column(c).combine_chunks() for c in ("shard", "dim", "v", "ids")]
                yield pa.RecordBatch.from_arrays([*columns[:2], pa.array(np.arange(lo, lo + len(at), dtype=np.int32)), *columns[2:], pa.array(links, pa.binary())],
                                                 names=["shard", "dim", "pos", "v", "ids", "links"])

    # The order of arrival does not matter: nodes are sorted by their smallest id before the random order.
    sorted_ = dealt.repartition(max(1, total), "shard").sortWithinPartitions("shard", F.col("ids")[0], "v")
    out = saved(sorted_.mapInArrow(run, "shard int, dim int, pos int, v array<double>, ids array<long>, links binary"), "graphs")
    discard(distinct)
    return out


class Shard:
    """A stored graph read back for search."""

    def __init__(self, table):
        self.vectors = matrix(table.column("v"))
        raw = table.column("links").to_pylist()
        step, layers = 4 * MOST_LINKS, []
        for depth in range(len(raw[0]) // step):
            part = b"".join(b[depth * step : (depth + 1) * step] for b in raw if len(b) > depth * step)
            layers.append(np.frombuffer(part, dtype=np.int32).reshape(-1, MOST_LINKS))
        self.graph = Graph(self.vectors.astype(np.float32), layers)
        ids = table.column("ids").combine_chunks()
        self.ids, self.starts = ids.flatten().to_numpy(), ids.offsets.to_numpy() - ids.offsets[0].as_py()

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, width: int) -> tuple[list, list]:
        out_ids, out_scores = [], []
        for i in range(0, len(own), BLOCK):
            found = self.graph.search(queries[i : i + BLOCK].astype(np.float32), max(width, k + 1))
            for q, id_, near in zip(queries[i : i + BLOCK], own[i : i + BLOCK].tolist(), found, strict=True):
                near = near[near >= 0]
                scores = (self.vectors[near] * q).sum(axis=1)
                pairs = sorted((-s, x) for s, n in zip(scores.tolist(), near.tolist(), strict=True) for x in self.ids[self.starts[n] : self.starts[n + 1]].tolist() if x != id_)[:k]
                out_ids.append([x for _, x in pairs])
                out_scores.append([-s for s, _ in pairs])
        return out_ids, out_scores


def search(graphs: DataFrame, queries: DataFrame, k: int, width: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score. queries: id (distinct), v (usable); a query's own id is no candidate.

    A query's vector meets the shards of its length; without any it has no row.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    # A row a shard.
    shards = graphs.filter("pos = 0").select("shard", "dim")
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    asked = queries.select("id", "v", F.size("v").alias("dim"), block.alias("block"))
    # One row for each query and shard: the stated query set against all rows.
    asked = asked.join(shards.groupBy("dim").agg(F.collect_list("shard").alias("shards")), "dim").withColumn("shard", F.explode("shards"))
    none = F.lit(None)
    nodes = graphs.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "pos", none.cast("long").alias("id"), "v", "ids", "links")
    both = nodes.unionByName(asked.select("shard", "block", F.lit(1 << 30).alias("pos"), "id", "v", none.cast("array<long>").alias("ids"), none.cast("binary").alias("links")))
    tasks = max(1, shards.count() * blocks)

    def run(batches):
        import pyarrow as pa

        at, shard, held = None, None, []
        for batch in batches:
            key = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
            query = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (query[1:] != query[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if lo == hi:
                    continue
                if key[lo] != at:
                    at, shard, held = key[lo], None, []
                part = batch.slice(lo, hi - lo)
                if not query[lo]:
                    held.append(part)
                    continue
                if shard is None:
                    shard, held = Shard(pa.Table.from_batches(held)), []
                ids, scores = shard.search(part.column(3).to_numpy(), matrix(part.column(4)), k, width)
                yield pa.RecordBatch.from_arrays([part.column(3), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))], names=["id", "ids", "scores"])

    placed = both.repartition(tasks, "shard", "block").sortWithinPartitions("shard", "block", "pos", "id")
    found = placed.mapInArrow(run, "id long, ids array<long>, scores array<double>")
    every = found.select("id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("id", F.col("x")["ids"].alias("vec_id"), F.col("x")["scores"].alias("score"))
    # Repeated rows of an id with different vectors: its best score counts.
    best = every.groupBy("id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def neighbours(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, shard_bytes: int = SHARD_BYTES, width: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each row whose id is divisible by ``every``.

    Vectors that are null, zero or hold a null or non-finite component take no part; vectors of
    another length than the query's are no candidates. Of rows repeated with one id the smallest
    vector asks, and as a candidate the id counts once, with its best score. Ties go to the
    smaller id. Other columns are not read. An empty table gives an empty result.
    """
    graphs = index(df, id_col, vector_col, k + 1, shard_bytes)
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter((F.col("id") % every == 0) & usable(F.col("v")))
    return search(graphs, rows.groupBy("id").agg(F.min("v").alias("v")), k, width)
