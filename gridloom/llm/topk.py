"""Exact top-k by inner product, term at a time.

Vectors become sparse integer rows. A task holds one group of candidates as
postings (term -> rows and weights) in segments, and takes the query rows in
blocks: each term of a query scatters its weighted postings into the query's
dense score array, the best k of a segment are selected by partition, and
lists are merged. Every score comes from postings, whatever a term's share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridloom.llm.common import cut

SEGMENT = 4096
LEAST, MOST = -(2**63), 2**63 - 1


@dataclass(frozen=True)
class Params:
    """Candidates are dealt by a hash of the id to groups of about ``per_group`` (fewer if there would be
    less than ``least_tasks`` groups); the queries go to every group, in blocks of about ``block``. So the
    rows that are shuffled are a ``block * per_group``-th of the scores."""

    k: int = 20
    scale: int = 64
    per_group: int = 131_072
    block: int = 64
    least_tasks: int = 6


def scaled(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly: Python integers where a product is beyond the doubles."""
    with np.errstate(over="ignore"):
        out = np.floor(scale * np.asarray(v, np.float64))
    if np.isfinite(out).all():
        return out
    return np.array([int(math.floor(x)) if math.isfinite(x) else scale * int(y) for x, y in zip(out, v)], object)


class Rows:
    """Sparse integer vectors, ordered by id (ids differ)."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray], scale: int):
        order = sorted(range(len(ids)), key=lambda i: ids[i])
        self.ids = np.array([ids[i] for i in order], np.int64)
        held = [scaled(vectors[i], scale) for i in order]
        self.row = np.repeat(np.arange(len(order)), [len(v) for v in held]).astype(np.int64)
        self.term = np.concatenate([np.arange(len(v)) for v in held]) if held else np.zeros(0, np.int64)
        self.weight = np.concatenate(held) if held else np.zeros(0)
        some = np.asarray(self.weight != 0, bool)
        self.row, self.term, self.weight = self.row[some], self.term[some], self.weight[some]
        self.most = max((abs(int(x)) for x in (self.weight.min(), self.weight.max())), default=0) if len(self.weight) else 0
        by = np.argsort(self.term, kind="stable")
        self.row, self.term, self.weight = self.row[by], self.term[by], self.weight[by]
        terms, starts = np.unique(self.term, return_index=True)
        self.postings = {int(t): (self.row[a:b], self.weight[a:b]) for t, a, b in zip(terms, starts, [*starts[1:], len(self.term)])}
        self.laid: tuple | None = None

    def __len__(self) -> int:
        return len(self.ids)

    def queries(self) -> Iterator[tuple[int, list[tuple[int, float]]]]:
        """(row, its terms and weights) of each row."""
        out: list[list] = [[] for _ in self.ids]
        for r, t, w in zip(self.row.tolist(), self.term.tolist(), self.weight.tolist()):
            out[r].append((t, w))
        return enumerate(out)

    def scattered(self, kind: type) -> dict[int, tuple[slice | np.ndarray, np.ndarray]]:
        """Postings as they are added to a score array of ``kind``: where, and weights. A term that most rows
        between its first and last have is laid out along them, with weight 0 at those that lack it: adding to
        a run of rows costs a fraction of adding to listed rows."""
        if self.laid is None or self.laid[0] is not kind:
            out = {}
            for t, (rows, w) in self.postings.items():
                w = np.array([int(x) for x in w], object) if kind is object else w.astype(kind)
                first, last = int(rows[0]), int(rows[-1]) + 1
                if last - first <= 4 * len(rows):
                    along = np.zeros(last - first, kind)
                    along[rows - first] = w
                    out[t] = slice(first, last), along
                else:
                    out[t] = rows, w
            self.laid = kind, out
        return self.laid[1]


def scores(queries: Rows, docs: Rows) -> np.ndarray:
    """Integer inner products: [query, candidate]. Exact in the smallest type that holds them; beyond 2**53
    with Python integers, saturated to the range of a long."""
    bound = queries.most * docs.most * max(1, min(len(queries.postings), len(docs.postings)))
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object
    out = np.zeros((len(queries), len(docs)), kind)
    postings = docs.scattered(kind)
    cell = int if kind is object else kind
    for i, terms in queries.queries():
        mine = out[i]
        for t, w in terms:
            if t in postings:
                where, weights = postings[t]
                mine[where] += cell(w) * weights
    if kind is object:
        return np.array([[max(LEAST, min(MOST, x)) for x in r] for r in out], object).reshape(out.shape)
    return out


def best(queries: Rows, docs: Rows, k: int) -> list[tuple[int, int, int]]:
    """(query id, candidate id, score): the best k candidates of each query in a segment, ties to the
    smaller id, never the query's own id."""
    if not len(queries) or not len(docs):
        return []
    s = scores(queries, docs)
    if s.dtype == object:
        ranked = [sorted(range(len(docs)), key=lambda j: (-r[j], docs.ids[j]))[: k + 1] for r in s]
    else:
        n = s.shape[1]
        edge = np.partition(s, n - k - 1, axis=1)[:, n - k - 1] if n > k + 1 else np.full(len(s), -np.inf)
        ranked = []
        for r, e in zip(s, edge):
            above, at = np.flatnonzero(r > e), np.flatnonzero(r == e)
            found = np.concatenate([above, at[: k + 1 - len(above)]]) if n > k + 1 else np.arange(n)
            ranked.append(found[np.lexsort((found, -r[found]))])
    out = []
    for i, found in enumerate(ranked):
        own = [j for j in found if docs.ids[j] != queries.ids[i]][:k]
        out.extend((int(queries.ids[i]), int(docs.ids[j]), int(s[i][j])) for j in own)
    return out


def _vectors(column: pa.Array) -> list[np.ndarray]:
    """The values of each list of a list array."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.diff(column.offsets.to_numpy()))
    return np.split(flat, ends[:-1]) if len(ends) else []


def search(vectors: DataFrame, is_query, params: Params = Params(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the best k rows for each row where ``is_query(id column)`` holds.

    Rows whose id or vector is null, or whose vector holds a null or a
    non-finite component, take no part; ids must be whole numbers of a long.
    Vectors of different lengths meet in the terms both have; an empty vector
    scores 0 everywhere. Rows that share an id count once (the smallest
    vector). Scores beyond a long are saturated. Fewer than k candidates: all
    of them. Other columns are not read; an empty table gives an empty table.
    """
    x = F.col("v")
    usable = F.col("id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(usable)
    rows = cut(rows.groupBy("id").agg(F.min("v").alias("v")))
    n, asked_n = rows.agg(F.count(F.lit(1)), F.sum(is_query(F.col("id")).cast("long"))).first()
    groups = max(1, math.ceil(n / params.per_group), min(params.least_tasks, math.ceil(n / SEGMENT)))
    blocks = max(1, math.ceil((asked_n or 0) / params.block))
    spot = lambda of, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(of)).cast("int")
    # candidates one by one (block -1: they come first), queries as blocks, each to every group
    docs = rows.select(spot(groups, 0).alias("g"), F.lit(-1).alias("b"), F.array(F.struct("id", "v")).alias("held"))
    asked = rows.where(is_query(F.col("id"))).groupBy(spot(blocks, 1).alias("b")).agg(F.collect_list(F.struct("id", "v")).alias("held"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "b", "held")
    met = docs.union(asked).repartition(groups, "g").sortWithinPartitions("g", "b")
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
    types = [pa.int64()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, segments, ids, held = None, [], [], []

        def close():
            if ids:
                segments.append(Rows(np.array(ids, np.int64), held, params.scale))
            ids.clear()
            held.clear()

        def answer(block: Rows) -> pa.RecordBatch:
            found: dict[int, list] = {}
            for seg in segments:
                for q, d, sc in best(block, seg, params.k):
                    found.setdefault(q, []).append((-sc, d))
            out = [(q, d, -sc) for q, x in found.items() for sc, d in sorted(x)[: params.k]]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=schema.names)

        for batch in batches:
            lists = batch.column(2)
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            members = lists.flatten()
            all_ids, all_vectors = members.field("id").to_numpy(zero_copy_only=False), _vectors(members.field("v"))
            for i, (g, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if g != group:
                    close()
                    group = g
                    segments.clear()
                if b < 0:
                    ids.append(int(all_ids[at[i]]))
                    held.append(all_vectors[at[i]])
                    if len(ids) >= SEGMENT:
                        close()
                else:
                    close()
                    yield answer(Rows(all_ids[at[i] : at[i + 1]], all_vectors[at[i] : at[i + 1]], params.scale))

    found = met.mapInArrow(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= params.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
