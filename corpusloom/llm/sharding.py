"""Sharding by extendible hashing, in DataFrame operations only.

A directory is indexed by the leading bits of a hash of the id. A bucket that
is over the byte limit splits on one more bit; the others stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import read_table, stage

#: Bits of the hash (15 hexadecimal digits of an MD5).
BITS = 60
#: Directories of up to so many rows (a few MB) are broadcast.
BROADCAST_ROWS = 100_000
#: Bits that one round looks at beyond those that the sizes suggest.
AHEAD = 4


def _prefix(hash_: Column, depth: int) -> Column:
    return F.shiftright(hash_, BITS - depth) if depth else F.lit(0).cast("long")


def _name(prefix: Column, depth: Column) -> Column:
    return F.concat(F.lit("b"), F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(prefix), depth, "0")))


def shard(docs: DataFrame, limit: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assigns every row to a shard of at most ``limit`` bytes of text.

    Returns ``doc_id, n_bytes, shard_id, depth, shard_bytes``. ``shard_id`` is
    ``b`` and the directory's bits. Each round sums bytes of cells of some more
    bits than needed, rolls them up to every depth between, and takes for each
    cell the least depth at which its bucket fits; only cells that still do
    not fit go on to the next round. Rows whose whole hash is shared by more
    than ``limit`` bytes (an id that repeats) leave the directory: they are cut
    within the part of the input that they were read in, ``limit / 2`` bytes a
    piece; rows over ``limit / 2`` there get a shard each, and only a single row
    over ``limit`` makes a shard over it.

    Nulls: a null text has 0 bytes; null ids hash alike. An empty table gives
    an empty result. Other columns are ignored.
    """
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")
    base = stage(
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), hashed.alias("__h"), F.monotonically_increasing_id().alias("__n")),
        "shard-rows",
    )
    total = base.agg(F.sum("n_bytes")).first()[0] or 0
    done, rest, depth, floor = [], base, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + AHEAD), 0
    while True:
        cells = stage(rest.groupBy(_prefix(F.col("__h"), depth).alias("__cell")).agg(F.sum("n_bytes").alias("__sum")), "shard-cells")
        at = F.explode(F.sequence(F.lit(floor), F.lit(depth)))
        rolled = cells.withColumn("depth", at).withColumn("__p", F.expr(f"shiftright(__cell, {depth} - depth)"))
        fits = rolled.groupBy("depth", "__p").agg(F.sum("__sum").alias("shard_bytes")).filter(F.col("shard_bytes") <= limit)
        best = rolled.join(fits, ["depth", "__p"]).groupBy("__cell").agg(F.min(F.struct("depth", "__p", "shard_bytes")).alias("__b"))
        directory = stage(cells.join(best, "__cell", "left").select("__cell", "__b.*"), "shard-directory")
        small = directory.count() <= BROADCAST_ROWS
        rest = rest.withColumn("__cell", _prefix(F.col("__h"), depth)).join(F.broadcast(directory) if small else directory, "__cell", "left")
        done.append(rest.filter("depth is not null").select("doc_id", "n_bytes", _name(F.col("__p"), F.col("depth")).alias("shard_id"), "depth", "shard_bytes"))
        over = directory.filter("depth is null").limit(1).count()
        rest = rest.filter("depth is null").select("doc_id", "n_bytes", "__h", "__n")
        if not over or depth == BITS:
            break
        rest, floor, depth = stage(rest, "shard-rest"), depth + 1, min(BITS, depth + 2 * AHEAD)
    if over:
        part = F.shiftright("__n", 33)
        large = F.col("n_bytes") * 2 > limit
        run = Window.partitionBy("__h", "__part", "__large").orderBy("__n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cut = rest.withColumns({"__part": part, "__large": large}).withColumn("__at", F.when(F.col("__large"), F.row_number().over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))).otherwise(F.floor((F.sum("n_bytes").over(run) - F.col("n_bytes")) * 2 / limit)))
        name = F.concat(_name(F.col("__h"), F.lit(BITS)), F.when(F.col("__large"), F.lit("-large-")).otherwise(F.lit("-")), F.col("__part"), F.lit("-"), F.col("__at"))
        cut = cut.withColumn("shard_id", name)
        whole = Window.partitionBy("shard_id")
        done.append(cut.select("doc_id", "n_bytes", "shard_id", F.lit(BITS).alias("depth"), F.sum("n_bytes").over(whole).alias("shard_bytes")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def write_shards(docs: DataFrame, path: str, limit: int = 4 << 20) -> None:
    """Writes ``docs`` with one folder for each shard; needs ids that do not repeat."""
    placed = docs.join(shard(docs, limit).select("doc_id", "shard_id"), "doc_id")
    placed.repartition("shard_id").sortWithinPartitions("shard_id", "doc_id").write.partitionBy("shard_id").parquet(path)


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(read_table(spark, sf_dir, "documents"))


SQL = r"""
with b as (select doc_id, strlen(coalesce(text, ''))::bigint as n_bytes,
             ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as h from documents),
e as (select *, unnest(generate_series(0, 30)) as depth from b),
s as (select depth, h >> (60 - depth) as p, sum(n_bytes)::bigint as shard_bytes from e group by all),
c as (select e.doc_id, e.n_bytes, e.depth, s.p, s.shard_bytes,
        row_number() over (partition by e.doc_id order by e.depth) as k
      from e join s on s.depth = e.depth and s.p = e.h >> (60 - e.depth) where s.shard_bytes <= 4194304)
select doc_id, n_bytes, 'b' || case when depth = 0 then '' else right(lpad(bin(p), 64, '0'), depth::int) end as shard_id,
  depth::int as depth, shard_bytes from c where k = 1
"""
