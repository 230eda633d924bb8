"""The nearest vectors of a stated query set, by blocks of queries against all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries that are sent to every worker at once, some 10 MB.
BLOCK = 10_000


def nearest(rows: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query, neighbour, place): the ``k`` rows (id, u) with the largest dot product with each query (query, q).

    Products are rounded to ``digits``; the smaller id comes first among equals,
    and a row is no neighbour of the query with its id. All vectors are read once
    for each block of queries; a task keeps k rows per query, so what meets for a
    query is bounded by tasks, not rows.
    """
    blocks = -(-queries.count() // BLOCK)
    out = None
    for block in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).toArrow()  # about BLOCK rows
        if not own.num_rows:
            continue
        names, vectors = own.column("query").to_numpy(), np.stack(own.column("q").to_pylist())
        part = rows.select("id", "u").mapInArrow(_keep(rows.sparkSession.sparkContext.broadcast((names, vectors)), k, digits), "query bigint, neighbour bigint, product double")
        out = part if out is None else out.union(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], "query bigint, neighbour bigint, place bigint")
    best = out.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("product")).alias("d"), "neighbour"))), 1, k).alias("x"))
    return best.select("query", F.posexplode("x").alias("place", "x")).select("query", F.col("x.neighbour").alias("neighbour"), (F.col("place") + 1).cast("long").alias("place"))


def _keep(sent, k: int, digits: int):
    def keep(batches):
        names, vectors = sent.value
        ids, best = np.zeros((len(names), 0), np.int64), np.zeros((len(names), 0))
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                some = batch.slice(lo, 1000)
                own = some.column("id").to_numpy()
                product = np.round(vectors @ np.stack(some.column("u").to_pylist()).T, digits) + 0.0
                product[names[:, None] == own[None, :]] = -np.inf
                ids, best = np.hstack([ids, np.broadcast_to(own, product.shape)]), np.hstack([best, product])
                order = np.lexsort((ids, -best), axis=1)[:, :k]
                ids, best = np.take_along_axis(ids, order, 1), np.take_along_axis(best, order, 1)
        at, place = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(ids[at, place]), pa.array(best[at, place])], ["query", "neighbour", "product"])

    return keep
