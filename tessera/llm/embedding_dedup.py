"""Near-duplicate embeddings: one HNSW graph per shard, every vector searched in every shard.

Equal vectors are one class from the start. The classes are dealt over shards by the hash
of their id; a shard's task builds its graph, audits it, and then streams the vectors of
all shards through it. A search is repeated with a beam four times as wide while its worst
result still reaches the limit, at last over the whole shard, so crowds come whole. The
audit compares vectors of all shards with the whole shard until ``AUDIT`` of them have a
few links there, ``SAMPLE`` at most; what is then missing of ``AUDIT`` are vectors of the
shard without links, moved until they only just link with where they were. The beam is
doubled until ``RECALL`` of a vector's links are found on average, both over those with
few links and over those in crowds; a vector's hit on itself is no link. Found pairs are
verified in double precision.

A task doesn't send pairs: it counts each query's links, merges what is linked in a
union-find over its shard, and sends for each query one link to its part. Components of
all shards' links are then united.

The number of shards is ``SHARDS`` until a shard would have more than ``SHARD_ROWS`` rows.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite components
links with nothing, and so does one with a null id; vectors of different lengths don't
link; rows alike count as different vectors of equal direction; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .hnsw import Graph
from .storage import cut

LIMIT = 0.9
SHARDS, SHARD_ROWS = 8, 500_000
EF = 24
AUDIT, RECALL = 128, 0.98
SAMPLE = 1 << 14
QUERIES = 512
SLACK = 1e-4


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Shard:
    """The vectors of a shard with their ids and counts, and what queries have linked."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, vectors: np.ndarray, limit: float, others: np.ndarray | None = None):
        self.ids, self.counts, self.vectors, self.limit = ids, counts, vectors, limit
        self.graph = Graph(vectors)
        self.part = np.arange(len(ids))
        self.ef = EF
        self.audit(vectors[:0] if others is None else others)

    def audit(self, others: np.ndarray) -> None:
        """Double the beam until it finds enough links of own vectors and of ``others``, vectors of other shards."""
        n, rng = len(self.ids), np.random.default_rng(7)
        own = rng.permutation(n)[: max(AUDIT, SAMPLE - len(others))]
        q, at = np.concatenate([self.vectors[own], others]), np.concatenate([own, np.full(len(others), -1)])
        by = rng.permutation(len(q))
        step = max(1, min(AUDIT, (1 << 24) // max(1, n)))
        sample, selves, links, lonely, few = [], [], [], [], 0

        def compared(x: np.ndarray, self_at: np.ndarray) -> np.ndarray:
            near = x @ self.vectors.T >= self.limit
            rows = np.flatnonzero(self_at >= 0)
            near[rows, self_at[rows]] = False
            true = near.sum(1)
            crowded = true >= EF
            kept = (true > 0) & (~crowded | (np.cumsum(crowded) + sum((t >= EF).sum() for t in links) <= AUDIT))  # AUDIT of crowds tell enough
            sample.append(x[kept])
            selves.append(self_at[kept])
            links.append(true[kept])
            return true

        for i in range(0, len(by), step):
            rows = by[i : i + step]
            true = compared(q[rows], at[rows])
            few += ((true > 0) & (true < EF)).sum()
            lonely.extend(at[rows][(true == 0) & (at[rows] >= 0)].tolist())
            if few >= AUDIT:
                break
        moved = self.vectors[lonely[: max(0, AUDIT - few)]]
        if self.vectors.shape[1] > 1:
            for i in range(0, len(moved), step):
                v = moved[i : i + step]
                away = rng.normal(size=v.shape)
                away -= (away * v).sum(axis=1, keepdims=True) * v
                share = min(1.0, self.limit + 1e-3)
                compared(share * v + math.sqrt(1 - share**2) * away / np.linalg.norm(away, axis=1, keepdims=True), np.full(len(v), -1))
        sample, selves, true = np.concatenate(sample), np.concatenate(selves), np.concatenate(links)
        kinds = [kind for kind in (true < EF, true >= EF) if kind.any()]
        while self.ef < n and kinds:
            found = np.zeros(len(sample))
            for row, hits in self.hits(sample):
                found[row] = (hits != selves[row]).sum()
            if all((found / true)[kind].mean() >= RECALL for kind in kinds):
                break
            self.ef *= 2

    def hits(self, q: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(row, its hits) of each query; the whole shard is compared where a beam would be a quarter of it."""
        step = max(8, min(QUERIES, (1 << 28) // max(1, len(self.ids))))
        left, ef = np.arange(len(q)), self.ef
        while len(left):
            wider = []
            for i in range(0, len(left), step):
                rows = left[i : i + step]
                found, s = self.graph.search(q[rows].astype(np.float32), ef)
                if ef < len(self.ids):
                    full = s.min(axis=1) >= self.limit - SLACK
                    wider.append(rows[full])
                    rows, found, s = rows[~full], found[~full], s[~full]
                some = (s >= self.limit - SLACK).any(1)
                for row, ids, near in zip(rows[some].tolist(), found[some], s[some], strict=True):
                    ids = ids[(near >= self.limit - SLACK) & (ids >= 0)]
                    ids = ids[self.vectors[ids] @ q[row] >= self.limit]
                    if len(ids):
                        yield row, ids
            left, ef = np.concatenate(wider) if wider else left[:0], ef * 4

    def join(self, hits: np.ndarray) -> int:
        """Put the hits into one part; returns its root."""
        roots = self.part[hits]
        while (self.part[roots] != roots).any():
            roots = self.part[roots]
        root = roots.min()
        self.part[roots] = root
        self.part[hits] = root
        return root


def near_duplicates(vectors: DataFrame, limit: float = LIMIT) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    own = F.concat_ws(":", F.size("embedding"), F.xxhash64("embedding"), F.xxhash64(F.reverse("embedding")))
    rows = vectors.select("vec_id", "embedding", F.when(usable(F.col("embedding")) & F.col("vec_id").isNotNull(), own).alias("own"))
    classes = cut(rows.filter("own IS NOT NULL").groupBy("own").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.any_value("embedding").alias("embedding")), "classes")
    total = classes.count()
    shards = max(SHARDS, -(-total // SHARD_ROWS))
    home = F.pmod(F.xxhash64("id"), F.lit(shards))
    dealt = classes.select("id", "n", "embedding", F.size("embedding").alias("width"), home.alias("home"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    audited = F.pmod(F.xxhash64(F.lit("audit"), "id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(1, total)))
    kind = F.when(F.col("home") == F.col("shard"), 0).when(audited, 1).otherwise(2)  # a shard's own come first, then those of others that it is audited with
    dealt = dealt.select("width", "shard", kind.alias("query"), "id", "n", "embedding")
    dealt = dealt.repartitionByRange(shards, "shard", "width").sortWithinPartitions("shard", "width", "query")

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, asked, shard = None, [], [], None
        names = ["id", "links", "other"]

        def answers(ids: np.ndarray, q: np.ndarray, own: bool) -> pd.DataFrame:
            out = []
            for row, hits in shard.hits(q):
                others = hits[shard.ids[hits] != ids[row]] if own else hits
                if len(others):
                    out.append((ids[row], int(shard.counts[others].sum()), shard.ids[shard.join(others)]))
            return pd.DataFrame(out, columns=names, dtype="int64")

        def built() -> Iterator[pd.DataFrame]:
            nonlocal shard
            ids, counts = (np.concatenate([h[c].to_numpy(np.int64) for h in held]) for c in ("id", "n"))
            others = [unit(a["embedding"]) for a in asked]
            shard = Shard(ids, counts, unit([v for h in held for v in h["embedding"]]), limit, np.concatenate(others) if others else None)
            held.clear()
            for i in range(0, len(ids), 1 << 14):
                yield answers(ids[i : i + (1 << 14)], shard.vectors[i : i + (1 << 14)], True)
            for a, q in zip(asked, others, strict=True):
                yield answers(a["id"].to_numpy(np.int64), q, False)
            asked.clear()

        def ended() -> Iterator[pd.DataFrame]:
            if held:
                yield from built()
            if shard is not None:
                moved = np.flatnonzero(shard.part != np.arange(len(shard.part)))
                yield pd.DataFrame({"id": shard.ids[moved], "links": 0, "other": shard.ids[shard.part[moved]]})

        for batch in batches:
            for (s, w), group in batch.groupby(["shard", "width"], sort=False):
                if (s, w) != at:
                    yield from ended()
                    at, shard = (s, w), None
                    asked.clear()
                members, audits, queries = (group[group["query"] == k] for k in range(3))
                if len(members):
                    held.append(members)
                if len(audits) and held:
                    asked.append(audits)
                if len(queries):
                    if held:
                        yield from built()
                    if shard is not None:
                        yield answers(queries["id"].to_numpy(np.int64), unit(queries["embedding"]), False)
        yield from ended()

    found = cut(dealt.mapInPandas(searched, "id long, links long, other long"), "found")
    parts = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.select("own", "id", "n").join(links, "id", "left").join(parts, "id", "left")
    known = cut(known.select("own", "id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("component")), "known")
    joined = rows.select("vec_id", "own").join(known, "own", "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
