"""Exact inner-product top-k by ball-tree branch and bound in shards.

Vectors are dealt to the nearest of a bounded number of centres and within a centre to shards of bounded size, so that near vectors share a
shard; each shard builds one ball tree (centre, radius, least
id per node).  Queries travel in blocks, also of near ones.  The root balls of all shards form a small table in chunks, against which every block is held before it is sent anywhere: a block first goes to the shards whose
centres score best, and the k-th scores found there go with it; it is sent only to those further shards whose bound some query's k-th score does not exceed.
In a shard the nodes are visited in order of their upper bound
``q.c + |q| r``, for all queries of a block at once; a node is skipped for the queries whose current k-th score exceeds its bound (at an equal
bound, if all of its ids are larger).

Components are integers (``floor(scale * x)``), so scores are exact as long as they fit 53 bits; larger ones are computed in
Python integers and held at the limits of 64 bits.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, tidied

#: Vectors of a shard, and of a leaf, and queries of a block.
SHARD_ROWS = 8_192
LEAF_ROWS = 64
BLOCK_QUERIES = 256
#: Centres at most, and bytes of centres that are broadcast; root balls of a chunk; shards of a chunk that a block visits first.
CENTRES = 2_048
CENTRE_BYTES = 8 << 20
CHUNK_ROOTS = 4_096
HOMES = 2
_NONE = np.iinfo(np.int64).min
_LIMIT = np.iinfo(np.int64).max


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _load(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as z:
        return {k: z[k] for k in z.files}


class BallTree:
    """Balls over rows of an integer matrix; leaves are runs of the reordered rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.lexsort((ids,))
        self.exact = x.dtype != object
        f = x.astype(np.float64)
        runs, stack = [], [order]
        while stack:
            rows = stack.pop()
            v = f[rows]
            spread = v - v.mean(0)
            if len(rows) <= leaf or not (wide := (spread * spread).sum(1)).any():
                # equal vectors stay in id order, so that a leaf's least id is worth a test
                runs += [rows[k : k + leaf] for k in range(0, len(rows), leaf)]
                continue
            far = v[np.argmax(wide)]
            other = v[np.argmax(((v - far) ** 2).sum(1))]
            side = v @ (other - far)
            half = np.argsort(side, kind="stable")
            m = len(rows) // 2
            stack += [np.sort(rows[half[m:]]), np.sort(rows[half[:m]])]
        self.order = np.concatenate(runs) if runs else order
        self.ids, self.x, self.f = ids[self.order], x[self.order], f[self.order]
        self.starts = np.cumsum([0] + [len(r) for r in runs])
        # a tree over the leaves, level by level: a node's children are two neighbours of the level below
        self.levels = []
        spans = list(zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True))
        while spans:
            centre = np.stack([self.f[a:b].mean(0) for a, b in spans])
            radius = np.array([np.sqrt(((self.f[a:b] - c) ** 2).sum(1).max()) for (a, b), c in zip(spans, centre, strict=True)])
            least = np.array([self.ids[a:b].min() for a, b in spans])
            self.levels.append((centre, radius, least))
            if len(spans) == 1:
                break
            spans = [(spans[k][0], spans[min(k + 1, len(spans) - 1)][1]) for k in range(0, len(spans), 2)]

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int, floor_score: np.ndarray, floor_id: np.ndarray, own: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The k best (score, id) of each query that are not worse than its floor; absent ones have the score _NONE."""
        n = len(q_ids)
        best, best_id = np.full((n, k), _NONE, np.int64), np.full((n, k), np.iinfo(np.int64).max, np.int64)
        qf = q.astype(np.float64)
        norm = np.sqrt((qf * qf).sum(1))
        kth, kth_id = floor_score.astype(np.float64), floor_id.copy()

        def bound(level, nodes):
            centre, radius, _ = self.levels[level]
            b = qf @ centre[nodes].T + norm[:, None] * radius[nodes][None, :]
            return b + 1e-9 * (np.abs(b) + norm[:, None] * np.abs(centre[nodes]).max(initial=1.0)) + 1e-6

        def live(b, level, nodes):
            least = self.levels[level][2][nodes][None, :]
            return (b > kth[:, None] + 0.5) | ((b > kth[:, None] - 0.5) & ((least < kth_id[:, None]) | (b >= kth[:, None] + 1))) | np.isnan(b)

        def visit(leaf):
            nonlocal best, best_id
            a, b = self.starts[leaf], self.starts[leaf + 1]
            rows = np.flatnonzero(live(bound(0, np.array([leaf])), 0, np.array([leaf]))[:, 0])
            if not len(rows):
                return
            if self.exact and q.dtype != object:
                score = (qf[rows] @ self.f[a:b].T).astype(np.int64)
            else:
                score = np.array([[max(-_LIMIT, min(_LIMIT, sum(int(u) * int(v) for u, v in zip(y, z, strict=True)))) for z in self.x[a:b]] for y in q[rows]], np.int64)
            ids = np.broadcast_to(self.ids[a:b], score.shape)
            score = np.where(ids == q_ids[rows][:, None], _NONE, score)
            all_s, all_i = np.concatenate((best[rows], score), 1), np.concatenate((best_id[rows], ids), 1)
            pick = np.lexsort((all_i, np.where(all_s == _NONE, _LIMIT, -all_s)), axis=1)[:, :k]
            best[rows], best_id[rows] = np.take_along_axis(all_s, pick, 1), np.take_along_axis(all_i, pick, 1)
            last, last_id = best[rows, k - 1], best_id[rows, k - 1]
            better = (last > _NONE) & ((last > kth[rows]) | ((last == kth[rows]) & (last_id < kth_id[rows])))
            kth[rows] = np.where(better, last, kth[rows])
            kth_id[rows] = np.where(better, last_id, kth_id[rows])

        def descend(level, nodes):
            b = bound(level, nodes)
            alive = live(b, level, nodes).any(0)
            # the node with the largest bound of any query first
            for i in np.argsort(-b.max(0), kind="stable"):
                if not alive[i]:
                    continue
                node = int(nodes[i])
                if level == 0:
                    visit(node)
                else:
                    below = [c for c in (2 * node, 2 * node + 1) if c < len(self.levels[level - 1][1])]
                    if live(bound(level, np.array([node])), level, np.array([node])).any():
                        descend(level - 1, np.array(below))

        if self.levels and n:
            descend(len(self.levels) - 1, np.array([0]))
        good = (best > floor_score[:, None]) | ((best == floor_score[:, None]) & (best_id <= floor_id[:, None]))
        best = np.where(good, best, _NONE)
        return best, best_id

    def blob(self) -> bytes:
        parts = {f"l{k}_{n}": v for k, level in enumerate(self.levels) for n, v in zip("crm", level, strict=True)}
        return _pack(ids=self.ids, x=self.f if self.exact else self.x.astype(str), exact=np.array(self.exact), starts=self.starts, **parts)

    @classmethod
    def of(cls, blob: bytes) -> BallTree:
        z = _load(blob)
        self = cls.__new__(cls)
        self.exact, self.ids, self.starts = bool(z["exact"]), z["ids"], z["starts"]
        self.x = z["x"] if self.exact else np.array([[int(v) for v in r] for r in z["x"]], object)
        self.f = self.x.astype(np.float64)
        self.levels = []
        while f"l{len(self.levels)}_c" in z:
            self.levels.append(tuple(z[f"l{len(self.levels)}_{n}"] for n in "crm"))
        return self


def integers(rows: list, scale: float) -> np.ndarray:
    """floor(scale * x) of vectors of one length: float64 while every score fits 53 bits, else Python integers."""
    x = np.floor(np.array(rows, np.float64) * scale)
    if x.size and np.abs(x).max() ** 2 * x.shape[1] >= 2**52:
        return np.array([[int(v) for v in r] for r in x], object)
    return x


def _trees(scale: float, leaf: int):
    def run(key, table):
        ids = table.column("id").to_numpy()
        x = integers(table.column("v").to_pylist(), scale)
        tree = BallTree(ids, x, leaf)
        centre, radius, least = (level[0] for level in tree.levels[-1])
        row = {"dim": [key[0].as_py()], "shard": [key[1].as_py()], "blob": [tree.blob()], "centre": [centre.tolist()], "radius": [float(radius)], "least": [int(least)]}
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(row.items(), (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.float64()), pa.float64(), pa.int64()), strict=True)})

    return run


def _roots(key, table):
    """The root balls of some shards as one blob."""
    blob = _pack(shard=table.column("shard").to_numpy(), centre=np.array(table.column("centre").to_pylist()), radius=table.column("radius").to_numpy(), least=table.column("least").to_numpy())
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "chunk": pa.array([key[1].as_py()], pa.int32()), "roots": pa.array([blob], pa.binary())})


def _blocks(scale: float):
    def run(key, table):
        x = integers(table.column("v").to_pylist(), scale)
        ids = table.column("id").to_numpy()
        n = len(ids)
        blob = _pack(ids=ids, x=x if x.dtype != object else x.astype(str), floor=np.full(n, _NONE, np.int64), floor_id=np.full(n, np.iinfo(np.int64).max, np.int64))
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()), "blob": pa.array([blob], pa.binary())})

    return run


def _queries(z: dict) -> np.ndarray:
    return z["x"] if z["x"].dtype == np.float64 else np.array([[int(v) for v in r] for r in z["x"]], object)


def _send(first: bool):
    """Rows (dim, block, blob, roots) to copies (dim, shard, tag, blob) of a block for the shards of a chunk that it visits first, or else for those that may still improve it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, block, blob, roots in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                z, r = _load(blob), _load(roots)
                q = _queries(z).astype(np.float64)
                norm = np.sqrt((q * q).sum(1))
                score = q @ r["centre"].T
                # the shards whose centres are best for the most queries; of equal ones the smaller number
                votes = np.bincount(score.argmax(1), minlength=len(r["shard"]))
                home = np.lexsort((r["shard"], -votes))[:HOMES]
                home = home[votes[home] > 0]
                if first:
                    to = home
                else:
                    b = score + norm[:, None] * r["radius"][None, :]
                    b = b + 1e-9 * (np.abs(b) + norm[:, None] * np.abs(r["centre"]).max(initial=1.0)) + 1e-6
                    floor = z["floor"].astype(np.float64)[:, None]
                    live = (b > floor + 0.5) | ((b > floor - 0.5) & ((r["least"][None, :] < z["floor_id"][:, None]) | (b >= floor + 1))) | np.isnan(b)
                    live[:, home] = False
                    to = np.flatnonzero(live.any(0))
                for k in range(0, len(to), 32):
                    some = r["shard"][to[k : k + 32]]
                    n = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array([dim] * n, pa.int32()), pa.array(some, pa.int64()), pa.array([block + 1] * n, pa.int64()), pa.array([blob] * n, pa.binary())], ["dim", "shard", "tag", "blob"])

    return run


def _search(k: int):
    """Rows in order of (dim, shard, tag): a shard's tree, then the blocks sent to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at = None, None
        for batch in batches:
            for dim, shard, tag, blob in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if tag == 0:
                    tree, at = BallTree.of(blob), (dim, shard)
                    continue
                if at != (dim, shard):
                    continue
                z = _load(blob)
                q = _queries(z)
                score, ids = tree.search(z["ids"], q, k, z["floor"], z["floor_id"])
                i, j = np.nonzero(score > _NONE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(i), dim, np.int32)), pa.array(np.full(len(i), tag - 1, np.int64)), pa.array(z["ids"][i]), pa.array(ids[i, j]), pa.array(score[i, j])],
                    ["dim", "block", "query_id", "id", "score"],
                )

    return run


def _with_floor(k: int):
    """A block's rows (its blob, or a result of its home shard) to its blob with the k-th scores found there."""

    def run(key, rows):
        blobs, queries, ids, scores = (rows.column(c).to_pylist() for c in ("blob", "query_id", "id", "score"))
        found: dict[int, list[tuple[int, int]]] = {}
        for q, i, s in zip(queries, ids, scores, strict=True):
            if q is not None:
                found.setdefault(q, []).append((-s, i))
        out = []
        for blob in blobs:
            if blob is not None:
                z = _load(blob)
                for n, q in enumerate(z["ids"].tolist()):
                    best = sorted(found.get(q, ()))
                    if len(best) >= k:
                        z["floor"][n], z["floor_id"][n] = -best[k - 1][0], best[k - 1][1]
                out.append(_pack(**z))
        return pa.table({"dim": pa.array([key[0].as_py()] * len(out), pa.int32()), "block": pa.array([key[1].as_py()] * len(out), pa.int64()), "blob": pa.array(out, pa.binary())})

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0, shard_rows: int = SHARD_ROWS, leaf: int = LEAF_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows with the highest integer inner product for every row that ``is_query`` selects.

    A row is no candidate of its own query; ties go to the smaller id; with fewer candidates all are returned.  Rows whose
    id or vector is null, or that hold a null or non-finite component, take no part; vectors of different lengths do not
    meet.  Ids must be unique among rows that take part (rows that repeat an id are reduced to the first vector in order).
    An empty table gives no rows.
    """
    v = F.col(vec_col)
    fine = v.isNotNull() & F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("ask"))
    rows = materialise(rows.groupBy("id").agg(F.min(F.struct("v", "ask")).alias("m")).select("id", "m.*", F.size("m.v").alias("dim")), "topk-rows")
    spark = vectors.sparkSession
    total = rows.groupBy("dim").agg(F.count("*").alias("n")).collect()
    centres = {}
    for r in total:  # lengths of vectors are few
        most = min(CENTRES, max(1, CENTRE_BYTES // (8 * r["dim"] * len(total))), -(-2 * r["n"] // shard_rows))
        few = rows.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("id", F.lit(1)), "id").limit(most).select("v").collect()
        centres[r["dim"]] = np.floor(np.array([x["v"] for x in few]) * scale)
    near = _nearest(spark.sparkContext.broadcast(centres), scale)
    placed = materialise(rows.withColumn("c", near("v")), "topk-placed")
    size = placed.groupBy("dim", "c").agg(F.count("*").alias("n"), F.count_if("ask").alias("q"))
    part = lambda salt, n, rows_each: F.shiftleft(F.col("c").cast("long"), 32) + F.pmod(F.xxhash64("id", F.lit(salt)), F.ceil(F.greatest(F.col(n), F.lit(1)) / rows_each))
    # one row a centre, at most CENTRES a length of vectors
    dealt = placed.join(F.broadcast(size), ["dim", "c"]).select("id", "v", "ask", "dim", part(1, "n", shard_rows).alias("shard"), part(2, "q", BLOCK_QUERIES).alias("block"))
    shape = "dim int, shard long, blob binary, centre array<double>, radius double, least long"
    trees = materialise(dealt.groupBy("dim", "shard").applyInArrow(_trees(scale, leaf), shape), "topk-trees")
    asked = materialise(dealt.where("ask").groupBy("dim", "block").applyInArrow(_blocks(scale), "dim int, block long, blob binary"), "topk-blocks")
    n_shards = trees.count()
    chunk = F.pmod(F.xxhash64("shard"), F.lit(max(1, -(-n_shards // CHUNK_ROOTS)))).cast("int")
    roots = materialise(trees.select("dim", "shard", "centre", "radius", "least", chunk.alias("chunk")).groupBy("dim", "chunk").applyInArrow(_roots, "dim int, chunk int, roots binary"), "topk-roots")
    n_tasks = max(2, min(n_shards, 4096))

    def searched(blocks: DataFrame, first: bool, name: str) -> DataFrame:
        met = blocks.join(roots, "dim").select("dim", "block", "blob", "roots")
        sent = materialise(met.mapInArrow(tidied(_send(first)), "dim int, shard long, tag long, blob binary"), f"{name}-sent")
        both = trees.select("dim", "shard", F.lit(0).cast("long").alias("tag"), "blob").join(sent.select("dim", "shard").distinct(), ["dim", "shard"], "left_semi").union(sent)
        both = both.repartition(n_tasks, "dim", "shard").sortWithinPartitions("dim", "shard", "tag")
        return materialise(both.mapInArrow(tidied(_search(k)), "dim int, block long, query_id long, id long, score long"), name)

    home = searched(asked, True, "topk-home")
    both = asked.unionByName(home, allowMissingColumns=True)
    floored = materialise(both.groupBy("dim", "block").applyInArrow(_with_floor(k), "dim int, block long, blob binary"), "topk-floors")
    found = home.union(searched(floored, False, "topk-rest"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def _nearest(shared, scale: float):
    """A column function: the place of the nearest centre of a vector's length (of equally near ones the first)."""
    from pyspark.sql.functions import arrow_udf

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        centres = shared.value
        for batch in batches:
            out = np.zeros(len(batch), np.int32)
            size = np.diff(batch.offsets.to_numpy())
            flat = np.floor(batch.flatten().to_numpy(zero_copy_only=False) * scale)
            starts = np.cumsum(size) - size
            for dim in np.unique(size).tolist():
                at, c = np.flatnonzero(size == dim), centres[dim]
                half = (c * c).sum(1) / 2
                for k in range(0, len(at), 4096):
                    x = flat[starts[at[k : k + 4096]][:, None] + np.arange(dim)]
                    out[at[k : k + 4096]] = (x @ c.T - half).argmax(1)
            yield pa.array(out)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, "int")
