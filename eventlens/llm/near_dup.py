"""Embedding near-duplicates with hierarchical navigable small-world graphs.

Equal vectors of one label collapse to a representative with a multiplicity. A label's representatives are dealt to
shards of bounded size; a task builds a navigable graph for each shard and puts it into a file on the shared folder.
Every shard is then queried with the vectors of every shard of its label: a task gets the names of two files, no vector
is shuffled again. Beams widen until an audit against brute force passes; a query whose beam is full of links is
answered by scanning the shard, and so are all queries of a pair of shards whose audit fails at the widest beam. Cosines
are verified in double precision. Scanned queries are counted row by row, so a dense group of any size never becomes a
list of pairs; those of beams that are not full are bounded by their width. A pair of shards returns one row per vector:
its number of links, and the smallest vector it is tied to there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import OWN, scratch_path, written
from eventlens.llm.components import LocalComponents, connected_components
from eventlens.llm.files import get, put

_EXPAND = 4


class Graph:
    """A navigable graph over unit vectors (float32 [n, d]); layer 0 holds all nodes, each next layer about 1 in m."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray], entry: int):
        self.x, self.layers, self.entry = x, layers, entry

    @classmethod
    def build(cls, x: np.ndarray, m: int = 12, ef: int = 48, seed: int = 1) -> Graph:
        n = len(x)
        level = np.minimum((-np.log(np.random.default_rng(seed).random(n) + 1e-12) / np.log(m)).astype(int), 4)
        level[0] = max(level.max(initial=0), 0)  # node 0 reaches the top and is the entry
        graph = cls(x, [np.full((n, 2 * m if i == 0 else m), -1, np.int32) for i in range(level[0] + 1)], 0)
        at = 1
        while at < n:
            batch = np.arange(at, min(n, at + min(256, max(16, at))))
            entry = np.zeros((len(batch), 1), np.int32)
            for layer in range(level[0], -1, -1):
                here = np.flatnonzero(level[batch] >= layer)
                found, sims = graph.search(x[batch], entry, layer, ef if len(here) else 4)
                entry = found[:, :4]
                if len(here):
                    graph._link(batch[here], found[here], sims[here], layer)
            at = batch[-1] + 1
        return graph

    def search(self, q: np.ndarray, entry: np.ndarray, layer: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ef best nodes for each query, best first (-1 and -inf where there are fewer), by beam search in lock step."""
        parts = [self._search(q[i : i + 512], entry[i : i + 512], layer, ef) for i in range(0, len(q), 512)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, q, entry, layer, ef):
        b, links = len(q), self.layers[layer]
        ids = np.full((b, ef), -1, np.int32)
        sims = np.full((b, ef), -np.inf, np.float32)
        done = np.zeros((b, ef), bool)
        seen = np.zeros((b, len(self.x) + 1), bool)  # the last column stands for -1
        seen[:, -1] = True
        self._merge(q, np.arange(b), entry[:, :ef].astype(np.int32), ids, sims, done, seen)
        rows = np.arange(b)
        while len(rows):
            open_sims = np.where(done[rows], -np.inf, sims[rows])
            k = min(_EXPAND, ef)
            best = np.argpartition(-open_sims, k - 1, axis=1)[:, :k]
            value = np.take_along_axis(open_sims, best, 1)
            live = np.isfinite(value).any(1)
            rows, best, value = rows[live], best[live], value[live]
            if not len(rows):
                break
            chosen = np.where(np.isfinite(value), ids[rows[:, None], best], -1)
            done[rows[:, None], best] |= np.isfinite(value)
            near = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(len(rows), -1)
            self._merge(q, rows, near, ids, sims, done, seen)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def _merge(self, q, rows, near, ids, sims, done, seen):
        near = np.sort(near, 1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near = np.where(seen[rows[:, None], near], -1, near)
        width = int((near >= 0).sum(1).max(initial=0))
        if not width:
            return
        near = -np.sort(-near, 1)[:, :width]
        seen[rows[:, None], near] = True
        value = np.matmul(self.x[near], q[rows][:, :, None])[:, :, 0]
        value[near < 0] = -np.inf
        ef = ids.shape[1]
        all_ids, all_sims = np.concatenate([ids[rows], near], 1), np.concatenate([sims[rows], value], 1)
        all_done = np.concatenate([done[rows], np.zeros(near.shape, bool)], 1)
        top = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
        ids[rows], sims[rows], done[rows] = (np.take_along_axis(z, top, 1) for z in (all_ids, all_sims, all_done))

    def _diverse(self, nodes, cand, sims, keep):
        """Of each row's candidates, best first, those closer to the node than to any kept one; then the best of the rest."""
        b, c = cand.shape
        v = self.x[cand]
        kept, taken = np.zeros((b, c), bool), np.zeros(b, int)
        cross = np.matmul(v, v.transpose(0, 2, 1))
        nearest = np.full((b, c), -np.inf, np.float32)
        for i in range(c):
            ok = (cand[:, i] >= 0) & (taken < keep) & (sims[:, i] > nearest[:, i])
            kept[:, i] = ok
            taken += ok
            nearest = np.where(ok[:, None], np.maximum(nearest, cross[:, i]), nearest)
        rank = np.where(cand >= 0, np.where(kept, 0, 1), 2) * c + np.arange(c)
        order = np.argsort(rank, 1)[:, :keep]
        out = np.take_along_axis(np.where(cand >= 0, cand, -1), order, 1)
        return np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)

    def _link(self, nodes, found, sims, layer):
        links, width = self.layers[layer], self.layers[layer].shape[1]
        own = self.x[nodes] @ self.x[nodes].T  # nodes of one batch see each other exactly
        np.fill_diagonal(own, -np.inf)
        own_ids = np.broadcast_to(nodes.astype(np.int32), own.shape)
        cand, value = np.concatenate([found, own_ids], 1), np.concatenate([sims, own], 1)
        order = np.argsort(-value, 1, kind="stable")[:, : found.shape[1]]
        cand, value = np.take_along_axis(cand, order, 1), np.take_along_axis(value, order, 1)
        cand = np.where(np.isfinite(value), cand, -1)
        chosen = self._diverse(nodes, cand, value, max(1, width // 2))
        links[nodes, : chosen.shape[1]] = chosen
        # back links: merged with what a node has, pruned by the same rule
        to, start = chosen.ravel(), np.repeat(nodes, chosen.shape[1])
        to, start = to[to >= 0], start[to >= 0]
        order = np.argsort(to, kind="stable")
        to, start = to[order], start[order]
        targets, first, count = np.unique(to, return_index=True, return_counts=True)
        extra = np.full((len(targets), int(count.max(initial=0))), -1, np.int32)
        extra[np.repeat(np.arange(len(targets)), count), np.arange(len(to)) - np.repeat(first, count)] = start
        for i in range(0, len(targets), 256):
            t = targets[i : i + 256]
            pool = np.sort(np.concatenate([links[t], extra[i : i + 256]], 1), 1)
            pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
            value = np.matmul(self.x[pool], self.x[t][:, :, None])[:, :, 0]
            value[pool < 0] = -np.inf
            order = np.argsort(-value, 1, kind="stable")[:, : 2 * width]
            links[t] = self._diverse(t, np.take_along_axis(pool, order, 1), np.take_along_axis(value, order, 1), width)

    def entries(self, q: np.ndarray) -> np.ndarray:
        """Entry points into layer 0, by descent through the upper layers."""
        at = np.full((len(q), 1), self.entry, np.int32)
        for layer in range(len(self.layers) - 1, 0, -1):
            at = self.search(q, at, layer, 4)[0]
        return at


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _audit(graph: Graph, q: np.ndarray, entry: np.ndarray, own: bool, floor: np.float32, ef: int, audit: int, target: float) -> bool:
    """Whether beams of width ef find what brute force finds, by `audit` queries whose beams are not full (full ones are scanned)."""
    order = np.random.default_rng(1).permutation(len(q))
    hit = truth = near = seen = 0
    for i in range(0, len(order), audit):
        part = order[i : i + audit]
        got, sims = graph.search(q[part], entry[part], 0, ef)
        rest = ~_full(sims, floor, ef, len(graph.x))
        part, got, sims = part[rest], got[rest], sims[rest]
        exact = q[part] @ graph.x.T
        if own:
            sims = np.where(got == part[:, None], -np.inf, sims)
            exact[np.arange(len(part)), part] = -np.inf
        hit += int((sims >= floor).sum())
        truth += int((exact >= floor).sum())
        near += int((sims.max(1) >= exact.max(1) - 1e-5).sum())
        seen += len(part)
        if seen >= audit:
            break
    return hit >= target * truth and near >= (0.9 if own else target) * seen


def _full(sims: np.ndarray, floor: np.float32, ef: int, n: int) -> np.ndarray:
    """Queries whose beam holds nothing but links, so that there may be more."""
    return (sims >= floor).all(1) & (ef < n)


def beam_links(graph: Graph, queries: np.ndarray, own: bool, threshold: float, audit: int = 128, target: float = 0.99, widest: int = 256, block: int = 4096) -> tuple[Iterator[tuple[np.ndarray, np.ndarray]], np.ndarray, int]:
    """((query, node) pairs that beams found, queries that are to be scanned, width of the beams or 0 where all are scanned).

    Pairs have a cosine near the threshold or above (in single precision, with a margin). own: the queries are the
    graph's own nodes, and each starts from itself. To be scanned are full beams, and all queries where the audit still
    fails at the widest beam. The queries to scan are complete when the pairs are used up.
    """
    floor, n = np.float32(threshold - 1e-5), len(graph.x)
    q = queries.astype(np.float32)
    entry = np.arange(len(q), dtype=np.int32)[:, None] if own else graph.entries(q)
    ef = min(32, n)
    while not (passed := _audit(graph, q, entry, own, floor, ef, audit, target)) and ef < min(widest, n):
        ef = min(2 * ef, n, widest)
    scan = np.full(len(q), not passed)

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(0, len(q) if passed else 0, block):
            got, sims = graph.search(q[i : i + block], entry[i : i + block], 0, ef)
            full = _full(sims, floor, ef, n)
            scan[i : i + block] = full
            row, column = np.nonzero((sims >= floor) & (got >= 0) & ~full[:, None])
            yield i + row, got[row, column]

    return pairs(), scan, ef if passed else 0


def links_between(graph: Graph, queries: np.ndarray, own: bool, threshold: float, **options) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) pairs of beams and scans, of cosine near the threshold or above."""
    pairs, scan, _ = beam_links(graph, queries, own, threshold, **options)
    yield from pairs
    todo, q = np.flatnonzero(scan), queries.astype(np.float32)
    for i in range(0, len(todo), 256):
        row, column = np.nonzero(q[todo[i : i + 256]] @ graph.x.T >= np.float32(threshold - 1e-5))
        yield todo[i : i + 256][row], column


class LinkCounts:
    """Links of two shards, or of one with itself: a weighted number and a component for each vector."""

    def __init__(self, x: np.ndarray, copies: np.ndarray, x2: np.ndarray, copies2: np.ndarray, own: bool, threshold: float):
        self.x, self.copies, self.x2, self.copies2, self.own, self.threshold = x, copies, x2, copies2, own, threshold
        self.base = 0 if own else len(x)
        self.links = np.zeros(self.base + len(x2), np.int64)
        self.parts = LocalComponents(len(self.links))

    def verified(self, q: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", self.x2[q[i : i + 65536]], self.x[node[i : i + 65536]]) >= self.threshold for i in range(0, len(q), 65536))])
        return q[keep], node[keep]

    def add(self, q: np.ndarray, node: np.ndarray) -> None:
        """Verified pairs, each once."""
        np.add.at(self.links, self.base + q, self.copies[node])
        np.add.at(self.links, node, self.copies2[q])
        self.parts.add(self.base + q, node)

    def scan(self, which: np.ndarray, block: int = 64) -> None:
        """All links of the queries that `which` marks, row by row; a pair of marked ones of one shard counts once for each."""
        todo, other = np.flatnonzero(which), (~which if self.own else np.ones(len(self.x), bool)).astype(np.int64)
        for i in range(0, len(todo), block):
            part = todo[i : i + block]
            near = self.x2[part] @ self.x.T >= self.threshold
            if self.own:
                near[np.arange(len(part)), part] = False
            self.links[self.base + part] += near @ self.copies
            self.links[: len(self.x)] += (self.copies2[part] @ near) * other
            for k, q in enumerate(part):
                fresh = np.flatnonzero(near[k] & (self.parts.root[: len(self.x)] != self.parts.root[self.base + q]))
                if len(fresh):
                    self.parts.add(np.full(len(fresh), self.base + q), fresh)


def count_links(graph: Graph, x: np.ndarray, copies: np.ndarray, x2: np.ndarray, copies2: np.ndarray, own: bool, threshold: float) -> tuple[LinkCounts, int]:
    """Links of the unit vectors x2 with those of the graph, in double precision, and the width of the beams (0: all scanned)."""
    counts = LinkCounts(x, copies, x2, copies2, own, threshold)
    pairs, scan, width = beam_links(graph, x2, own, threshold)
    n, held = len(x), []
    for q, node in pairs:
        if own:  # found from either side, so they are kept until both are there: less than the beams' width for each row
            q, node = np.minimum(q, node), np.maximum(q, node)
            code = np.unique(q[q != node].astype(np.int64) * n + node[q != node])
            q, node = counts.verified(code // n, code % n)
            held.append(q * n + node)
        else:
            counts.add(*counts.verified(q, node))
    if held:
        code = np.unique(np.concatenate(held))
        q, node = code // n, code % n
        both = ~scan[q] & ~scan[node]  # what is scanned has all its links from there
        counts.add(q[both], node[both])
    counts.scan(scan)
    return counts, width


def _shard_file(uri: str, ids: np.ndarray, copies: np.ndarray, x: np.ndarray, layers: list[np.ndarray]) -> str:
    """A file of a shard's arrays: a first line of rows, components and widths, then the arrays; its name."""
    head = " ".join(map(str, (len(ids), x.shape[1], *(z.shape[1] for z in layers)))).encode() + b"\n"
    name = f"{uuid.uuid4().hex}.shard"
    put(uri, name, head + b"".join(np.ascontiguousarray(z).tobytes() for z in (ids, copies, x, *layers)))
    return name


def _shard(uri: str, name: str, links: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(ids, copies, unit vectors, layers) of a shard's file; without links, no layers."""
    data = get(uri, name)
    at = data.index(b"\n") + 1
    n, d, *widths = map(int, data[: at - 1].split())
    out = []
    for kind, width in ((np.int64, 1), (np.int64, 1), (np.float64, d), *((np.int32, w) for w in widths if links)):
        out.append(np.frombuffer(data, kind, n * width, at).reshape(n, width))
        at += out[-1].nbytes
    return out[0][:, 0], out[1][:, 0], unit(out[2]), out[3:]


def _build(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                members = row.column("members")[0].values
                ids = members.field("vec_id").to_numpy()
                order = np.argsort(ids, kind="stable")
                vec = members.field("vec")
                x = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)[order]
                graph = Graph.build(unit(x).astype(np.float32))
                name = _shard_file(uri, ids[order], members.field("copies").to_numpy()[order], x, graph.layers)
                yield pa.RecordBatch.from_arrays([row.column("label"), row.column("dim"), row.column("shard"), pa.array([name])], ["label", "dim", "shard", "file"])

    return run


def _query(uri: str, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, others in zip(b.column("file").to_pylist(), b.column("others").to_pylist(), strict=True):
                ids, copies, x, layers = _shard(uri, first, True)
                graph = Graph(x.astype(np.float32), layers, 0)
                for name in others:
                    own = name == first
                    ids2, copies2, x2, _ = (ids, copies, x, None) if own else _shard(uri, name, False)
                    counts, width = count_links(graph, x, copies, x2, copies2, own, threshold)
                    every = ids if own else np.concatenate([ids, ids2])
                    tied = np.flatnonzero(counts.links)
                    least = np.full(len(every), np.iinfo(np.int64).max)
                    np.minimum.at(least, counts.parts.root, every)
                    yield pa.RecordBatch.from_arrays([pa.array(every[tied]), pa.array(counts.links[tied]), pa.array(least[counts.parts.root[tied]]), pa.array(np.full(len(tied), width, np.int32))], ["vec_id", "n", "root", "beam"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, shard_rows: int = 4096, growth: float = 64, most_rows: int = 131_072, most_bytes: int = 64 << 20, together: int = 8, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept. Vectors are compared within a label and a dimension.

    Rows with a null id, label or vector, and vectors that are empty, zero or hold null or non-finite components link
    with nothing (component_id is their own id). Rows of one id are vectors of their own. An empty table gives no rows.
    A label's shards hold growth * sqrt(vectors) of it, from shard_rows to most_rows, so that pairs of shards grow in
    proportion to the label, but not more than most_bytes of doubles. Ties do not arise: what counts is whether a cosine
    reaches the threshold.
    """
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    zero = ~F.exists("vec", lambda v: v != 0)
    every = every.withColumn("ok", F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~bad & ~zero, F.lit(False)))
    keys = [F.xxhash64(F.lit(s), F.size("vec"), F.transform("vec", lambda v: v + 0.0)).alias(f"k{s}") for s in (1, 2)]
    good = every.where("ok").select("vec_id", "label", "vec", *keys)
    reps = written(good.groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec")), "vectors")
    per_label = reps.groupBy("label", F.size("vec").alias("dim")).agg(F.count("*").alias("n"))
    per_label = written(per_label.withColumn("shards", F.ceil(F.col("n") / F.least(F.greatest(growth * F.sqrt("n"), F.lit(float(shard_rows))), F.lit(float(most_rows)), F.greatest(F.lit(1.0), most_bytes / (8 * F.col("dim"))))).cast("int")), "labels")
    dealt = reps.withColumn("dim", F.size("vec")).join(per_label, ["label", "dim"])  # AQE splits a hot label
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))
    member = F.struct(F.col("rep").alias("vec_id"), "copies", "vec")
    shards = dealt.groupBy("label", "dim", "shard").agg(F.collect_list(member).alias("members"))  # about shard_rows rows each
    uri = scratch_path(vectors.sparkSession, "shards")
    index = written(shards.mapInArrow(_build(uri), "label string, dim int, shard int, file string"), "graphs")
    # a task takes a shard and up to `together` others, itself first; only names are joined
    pairs = per_label.select("label", "dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "shards").select("label", "dim", "shard", F.explode(F.sequence("shard", F.col("shards") - 1)).alias("shard2"))
    named = pairs.join(index, ["label", "dim", "shard"]).join(index.select("label", "dim", F.col("shard").alias("shard2"), F.col("file").alias("file2")), ["label", "dim", "shard2"])
    work = named.groupBy("label", "dim", "shard", "file", F.floor((F.col("shard2") - F.col("shard")) / together).alias("run")).agg(F.collect_list("file2").alias("others"))
    work = written(work.select("file", "others", "run"), "shard-pairs")
    work = work.repartition(max(1, min(work.count(), 10_000)), "file", "run")
    found = written(work.select("file", "others").mapInArrow(_query(uri, threshold), "vec_id long, n long, root long, beam int"), "links")
    links = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    component = connected_components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    known = reps.select("label", "k1", "k2", F.col("rep").alias("vec_id"), "copies").join(links, "vec_id", "left").join(component.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    known = written(known.select("label", "k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")), "known")
    linked = good.select("vec_id", "label", "k1", "k2").join(known, ["label", "k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = every.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def keep_one(vectors: DataFrame, **options) -> DataFrame:
    """vectors without all but the smallest id of each component."""
    kept = near_duplicates(vectors, **options).where("kept").select(F.col("vec_id").alias(f"{OWN}id")).distinct()
    return vectors.join(kept, F.col(options.get("id_col", "vec_id")).eqNullSafe(F.col(f"{OWN}id")), "left_semi")


def op3_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r(id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM v LEFT JOIN n ON n.a = vec_id JOIN m ON m.id = vec_id
"""
