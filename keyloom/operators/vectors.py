"""Vector search: exact nearest neighbours, and reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.exprs import METRICS, quantize_int8


def vsearch(vectors: DataFrame, query: list[float], k: int, metric: str = "COSINE", id_col: str = "ext_id") -> DataFrame:
    """The ``k`` nearest live vectors to one query: one pass, and a top-k that each task cuts first."""
    if not 1 <= k <= 10_000:
        raise ValueError("k is 1 to 10000")
    live = vectors.where(~F.coalesce(F.col("deleted"), F.lit(False))) if "deleted" in vectors.columns else vectors
    q = F.array(*[F.lit(float(x)) for x in query])
    out = live.where(F.size("embedding") == len(query)).select(id_col, METRICS[metric.upper()](F.col("embedding"), q).alias("distance"))
    return out.orderBy("distance", id_col).limit(k).withColumn("score", 1 - F.col("distance"))


def _live(vectors: DataFrame) -> DataFrame:
    rows = vectors.where(F.col("embedding").isNotNull())
    return rows.where(~F.coalesce(F.col("deleted"), F.lit(False))) if "deleted" in vectors.columns else rows


def _matrix(column, dim: int):
    """The rows of an Arrow list column as a matrix, from its flat buffer."""
    import numpy as np

    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def _names(column):
    """Ids in an array that sorts as Spark does: whole numbers as they are, all else in pairs, nulls first."""
    import numpy as np
    import pyarrow as pa

    if pa.types.is_signed_integer(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False).astype(np.int64)
    return _pairs(column.to_pylist())


def _pairs(names: list):
    import numpy as np

    return np.fromiter(((x is not None, x) for x in names), dtype=object, count=len(names))


def _joined(a, b):
    """Two arrays of ``_names`` in one; pairs if one of them has pairs."""
    import numpy as np

    if a.dtype != b.dtype:
        a, b = (_pairs(x.tolist()) if x.dtype != object else x for x in (a, b))
    return np.concatenate([a, b])


def _within(groups):
    """The place of each element in its run of equal ones."""
    import numpy as np

    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    return np.arange(len(groups)) - np.repeat(first, np.diff(np.append(first, len(groups))))


def _without_copies(v, names, k: int):
    """Places of vectors without those of which k equal ones have lesser names: they are nobody's nearest k."""
    import numpy as np

    rows = np.ascontiguousarray(v)
    kinds, kind = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_inverse=True)
    if len(kinds) == len(rows):
        return np.arange(len(rows))
    order = np.lexsort((names, kind))
    return order[_within(kind[order]) < k]


class _Best:
    """The ``k`` nearest so far of each query, ties by name, in memory that does not grow with the vectors seen.

    Products of matrices, a tile of ``_TILE`` numbers at a time, tell which pairs may be among them, with a margin for rounding. Only
    these get a distance, summed up in the order of dimensions, so that equal vectors are equally far wherever they stand."""

    _TILE = 1 << 19

    def __init__(self, q, k: int, metric: str):
        import numpy as np

        self.k, self.metric, self.by_dim = k, metric, np.ascontiguousarray(q.T)
        self.length = self._length(self.by_dim)
        ones = np.ones(len(q))
        self.right = q / np.maximum(self.length, 1e-300)[:, None] if metric == "COSINE" else np.column_stack([q, ones]) if metric == "L2" else q
        self.base = self.length**2 if metric == "L2" else ones  # a distance is this less the closeness
        self.far, self.who, self.n = np.full((len(q), k), np.inf), np.zeros((len(q), k), dtype=np.int64), np.zeros(len(q), dtype=np.int64)

    @staticmethod
    def _length(by_dim):
        import numpy as np

        total = np.zeros(by_dim.shape[1])
        for x in by_dim:
            total += x * x
        return np.sqrt(total)

    def add(self, v, names, only=None) -> None:
        """Vectors that all queries meet, or those at the places ``only``."""
        import numpy as np

        only = np.arange(len(self.n)) if only is None else only
        for i in range(0, len(v), 1024):
            rows, by_dim = v[i : i + 1024], np.ascontiguousarray(v[i : i + 1024].T)
            length = self._length(by_dim)
            left = rows / np.maximum(length, 1e-300)[:, None] if self.metric == "COSINE" else np.column_stack([2 * rows, -(length**2)]) if self.metric == "L2" else rows
            wide = max(1, self._TILE // len(rows))
            for j in range(0, len(only), wide):
                self._tile(left, by_dim, length, names[i : i + 1024], only[j : j + wide])

    def _tile(self, left, by_dim, length, names, at) -> None:
        import numpy as np

        close, other = left @ self.right[at].T, self.length[at]
        if self.metric == "COSINE" and length.min() * other.min() < 1e-12:
            close[np.outer(length, other) < 1e-12] = 0
        scale = 1.0 if self.metric == "COSINE" else length.max() * other if self.metric == "IP" else (length.max() + other) ** 2
        margin = 1e-15 * (len(by_dim) + 8) * scale * np.ones(len(at))
        odd = ~np.isfinite(margin) | ~np.isfinite(length.sum() + other)
        if odd.any():  # what is no number is farthest, and all of it is looked at
            close[np.isnan(close)] = -np.inf
            margin[~np.isfinite(margin)] = np.inf
        full = self.n[at] == self.k
        edge = self.far[at, -1]
        with np.errstate(invalid="ignore"):
            low = np.where(full, self.base[at] - edge - margin, -np.inf)
            if not full.all() and len(left) > self.k:
                low[~full] = np.partition(close[:, ~full], len(left) - self.k, axis=0)[len(left) - self.k] - 2 * margin[~full]
        low[np.isnan(low)] = -np.inf
        row, col = np.divmod(np.flatnonzero(close >= low), len(at))
        if len(row):
            self._keep(at[col], self._distance(by_dim, length, row, at[col]), names[row])

    def _distance(self, by_dim, length, row, query):
        import numpy as np

        total = np.zeros(len(row))
        for x, y in zip(by_dim, self.by_dim, strict=True):
            a, b = x[row], y[query]
            total += (a - b) * (a - b) if self.metric == "L2" else a * b
        if self.metric == "COSINE":
            both = length[row] * self.length[query]
            return np.where(both < 1e-12, 1.0, 1 - np.clip(total / np.maximum(both, 1e-300), -1, 1))
        return total if self.metric == "L2" else 1 - total

    def _keep(self, query, far, names) -> None:
        import numpy as np

        some = np.unique(query)
        had = np.arange(self.k) < self.n[some][:, None]
        query = np.concatenate([np.repeat(some, self.n[some]), query])
        far, names = np.concatenate([self.far[some][had], far]), _joined(self.who[some][had], names)
        order = np.lexsort((names, far, query))
        place = _within(query[order])
        order, place = order[place < self.k], place[place < self.k]
        if names.dtype != self.who.dtype:
            self.who = _pairs(self.who.ravel().tolist()).reshape(self.who.shape)
        self.far[query[order], place], self.who[query[order], place] = far[order], names[order]
        self.n[some] = np.bincount(np.searchsorted(some, query[order]), minlength=len(some))

    def found(self):
        """(places of queries, names, distances), so many at a time."""
        import numpy as np

        step = max(1, 65_536 // self.k)
        for i in range(0, len(self.n), step):
            had = np.arange(self.k) < self.n[i : i + step, None]
            if had.any():
                who = self.who[i : i + step][had].tolist()
                yield i + np.nonzero(had)[0], who if self.who.dtype != object else [x for _, x in who], self.far[i : i + step][had]


def vsearch_batch(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "COSINE", block_bytes: int = 16 << 20) -> DataFrame:
    """The ``k`` nearest live vectors of each query (query_id, q).

    Queries are a stated set, numbered once and taken in blocks of so many bytes, each of which meets every vector in one pass;
    a task keeps its best ``k`` of a query before anything is shuffled. Vectors of another dimension, deleted ones and nulls are left
    out. Ids may be of any type that has an order."""
    dims = [r[0] for r in queries.where(F.col("q").isNotNull()).select(F.size("q")).distinct().limit(2).collect()]
    if len(dims) > 1:
        raise ValueError("queries are of different dimensions")
    return _search(vectors, queries, dims[0] if dims else 0, k, metric.upper(), block_bytes)


def _search(vectors: DataFrame, queries: DataFrame, dim: int, k: int, metric: str, block_bytes: int, centres=None, probes: int = 0) -> DataFrame:
    """``vsearch_batch`` of queries of one dimension; with ``centres`` a vector meets those only that probe its cell."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    query_type, id_type = queries.schema["query_id"].dataType, vectors.schema["ext_id"].dataType
    shape = f"query_id {query_type.simpleString()}, ext_id {id_type.simpleString()}, distance double"
    asked = queries.where(F.size("q") == dim).select("query_id", F.col("q").cast("array<double>").alias("q"))
    # Dealt anew, as a file may be one task's, which all queries would meet in turn.
    rows = _live(vectors).where(F.size("embedding") == dim).select("ext_id", "embedding").repartition(F.xxhash64("ext_id", "embedding"))
    arrow = [to_arrow_type(query_type), to_arrow_type(id_type), pa.float64()]

    def pass_over(ids: list, q):
        def best(batches):
            kept = _Best(q, k, metric)
            asking = None
            if centres is not None:
                cells = _cells(q, centres, probes).ravel()
                asking = [np.sort(a) for a in np.split(np.argsort(cells, kind="stable") // min(probes, len(centres)), np.cumsum(np.bincount(cells, minlength=len(centres)))[:-1])]
            for batch in batches:
                for start in range(0, batch.num_rows, 10_000):
                    part = batch.slice(start, 10_000)
                    v, names = _matrix(part.column(1), dim), _names(part.column(0))
                    at = _without_copies(v, names, k)
                    v, names = v[at], names[at]
                    if asking is None:
                        kept.add(v, names)
                        continue
                    cell = _cells(v, centres, 1)[:, 0]
                    for c in np.unique(cell):
                        kept.add(v[cell == c], names[cell == c], asking[c])
            for at, who, far in kept.found():
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at], arrow[0]), pa.array(who, arrow[1]), pa.array(far)], ["query_id", "ext_id", "distance"])

        return rows.mapInArrow(best, shape)

    found, ids, held = None, [], []
    most = max(1, block_bytes // (8 * dim + 16 * k))
    for r in asked.orderBy("query_id").toLocalIterator():  # one block at a time is in the driver
        ids.append(r.query_id)
        held.append(r.q)
        if len(ids) == most:
            part = pass_over(ids, np.array(held, dtype=float))
            found, ids, held = part if found is None else found.unionByName(part), [], []
    if ids:
        part = pass_over(ids, np.array(held, dtype=float))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], shape + ", rank int")
    w = Window.partitionBy("query_id").orderBy("distance", "ext_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cells_fit(vectors: DataFrame, cells: int = 64, sample: int = 20_000, seed: int = 7, steps: int = 15):
    """Centres of an inverted index of cells, fitted by k-means on at most ``sample`` vectors (the least hashes of their ids). All
    vectors are then indexed by them."""
    import numpy as np

    some = _live(vectors).orderBy(F.xxhash64(F.lit(seed), "ext_id"), "ext_id").limit(sample).select("embedding").toArrow()
    x = _matrix(some.column(0).combine_chunks(), len(some.column(0)[0]) if len(some) else 1)
    x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(cells, len(x)), replace=False)]
    for _ in range(steps):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return centres


def _cells(v, centres, n: int):
    """The ``n`` nearest cells of each vector, nearest first."""
    import numpy as np

    sims = v @ centres.T
    return sims.argmax(1)[:, None] if n == 1 else np.argsort(-sims, axis=1, kind="stable")[:, :n]


def vsearch_cells(vectors: DataFrame, queries: DataFrame, centres, k: int, probes: int = 32, block_bytes: int = 16 << 20) -> DataFrame:
    """The ``k`` nearest by cosine distance of each query (query_id, q), looked for in its ``probes`` nearest cells only: an
    approximate search, whose answer is exact within what it looks at. Every live vector is in one cell, and meets the queries that
    probe it, a task's vectors of a cell and a block of queries in one product of matrices. No vector or pair becomes a row."""
    return _search(vectors, queries, centres.shape[1], k, "COSINE", block_bytes, centres, probes)


def vadd(vectors: DataFrame, new: DataFrame, dim: int | None = None) -> DataFrame:
    """Vectors (ext_id, embedding, deleted) with new ones; a vector of another dimension than ``dim`` is an error."""
    right = F.lit(True) if dim is None else F.size("embedding") == dim
    wrong = F.raise_error(F.lit("wrong dimension")).cast(new.schema["embedding"].dataType)
    return vectors.unionByName(new.select("ext_id", F.when(right, F.col("embedding")).otherwise(wrong).alias("embedding"), F.lit(False).alias("deleted")))


def vinfo(vectors: DataFrame) -> DataFrame:
    live = F.count_if(~F.coalesce(F.col("deleted"), F.lit(False))) if "deleted" in vectors.columns else F.count(F.lit(1))
    return vectors.agg(F.max(F.size("embedding")).alias("dim"), F.count(F.lit(1)).alias("count"), live.alias("live"))


def vdel(vectors: DataFrame, ids: list) -> DataFrame:
    return vectors.withColumn("deleted", F.coalesce(F.col("deleted"), F.lit(False)) | F.col("ext_id").isin(ids))


def quantized(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("q8", quantize_int8(F.col("embedding")))


def int8_dot(a, b):
    """The inner product of two quantized vectors, in whole numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def rank_fusion(*ranked: DataFrame, k: int = 60) -> DataFrame:
    """(doc_id, score): the sum of 1 / (position + k) over lists (doc_id, pos), positions from 0."""
    from functools import reduce

    rows = reduce(DataFrame.unionByName, [r.select("doc_id", "pos") for r in ranked])
    return rows.groupBy("doc_id").agg(F.sum(1.0 / (F.col("pos") + k)).alias("score"))
