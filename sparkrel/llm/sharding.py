"""Sharding by extendible hashing.

A document's hash is a long bit string: 60 bits of its id and text, then 60
bits of its row, so that equal rows part too. The directory is indexed by
hash-prefix bits. A bucket within the byte limit is a shard; only a bucket
over it splits on its next bit. Bytes are summed once per cell of ``step``
more bits, all buckets between two steps are judged from those sums (never
from documents), and only documents of cells that are still too large go on to
the next step; those of a cell whose documents are all alike go on to the
row's bits at once. Neither buckets nor documents reach the driver.

A document that is larger than the limit alone is a shard of its own, with
``oversize`` true. Names don't depend on how rows are partitioned, but for
rows alike in id and text. Defined results: a null text has no bytes; repeated
rows are sharded each; extra columns are ignored; an empty table has no shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep

LIMIT = 16 << 20
STEP = 6
#: Bits of either half of a hash.
HALF = 60


def bits(half: Column, at: int, to: int) -> Column:
    """Bits [at, to) of a half as a long."""
    return F.shiftrightunsigned(half, HALF - to).bitwiseAND(F.lit((1 << (to - at)) - 1))


def split(todo: DataFrame, half: str, step: int, limit: int, before: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Documents (doc_id, n_bytes, _h1, _h2, _prefix) whose buckets fit by the bits of one half, and those left, all bits being used or of no use."""
    done, left = [], None
    for base in range(0, HALF, step):
        low = 0 if before + base == 0 else 1
        todo = todo.withColumn("_cell", bits(F.col(half), base, base + step))
        cells = keep(todo.groupBy("_prefix", "_cell").agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"), (F.min(half) == F.max(half)).alias("alike")), "cells")
        paths = cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(step))).alias("d")).withColumn("p", F.expr(f"shiftright(_cell, {step} - d)"))
        nodes = paths.groupBy("_prefix", "d", "p").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        fit = nodes.filter(F.col("shard_bytes") <= limit)
        # The shallowest bucket of a cell's path that fits is its shard; fits are monotone along the path.
        leaf = paths.join(fit, ["_prefix", "d", "p"]).groupBy("_prefix", "_cell").agg(F.min_by(F.struct("d", "p", "shard_bytes", "shard_docs"), "d").alias("leaf"))
        told = cells.select("_prefix", "_cell", "alike").join(leaf, ["_prefix", "_cell"], "left")
        got = keep(todo.join(told, ["_prefix", "_cell"]), "directory")
        name = F.when(F.col("leaf.d") == 0, F.col("_prefix")).otherwise(F.concat("_prefix", F.lpad(F.bin("leaf.p"), F.col("leaf.d"), F.lit("0"))))
        done.append(got.filter("leaf is not null").select("doc_id", "n_bytes", name.alias("shard"), (F.col("leaf.d") + before + base).alias("depth"), F.col("leaf.shard_bytes").alias("shard_bytes"), F.col("leaf.shard_docs").alias("shard_docs"), F.lit(False).alias("oversize")))
        rest = got.filter("leaf is null").select("doc_id", "n_bytes", "_h1", "_h2", F.concat("_prefix", F.lpad(F.bin("_cell"), step, "0")).alias("_prefix"), "alike")
        # What is alike gets the bits that are left in one go.
        tail = F.lpad(F.bin(bits(F.col(half), base + step, HALF)), HALF - base - step, "0") if base + step < HALF else F.lit("")
        stuck = rest.filter("alike").select("doc_id", "n_bytes", "_h1", "_h2", F.concat("_prefix", tail).alias("_prefix"))
        left = stuck if left is None else left.unionByName(stuck)
        todo = rest.filter("not alike").drop("alike")
        if todo.isEmpty():
            return done, left
    return done, left.unionByName(todo)


def shards(docs: DataFrame, *, limit: int = LIMIT, step: int = STEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, shard (its prefix), depth, shard_bytes, shard_docs, oversize."""
    if HALF % step:
        raise ValueError(f"step divides {HALF}")
    text, doc_id = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), digest.alias("_digest"), F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << HALF) - 1)).alias("_h2"))
    rows = keep(rows.withColumn("_h1", F.conv(F.substring("_digest", 1, HALF // 4), 16, 10).cast("long")), "rows")
    number = F.row_number().over(Window.partitionBy("_digest").orderBy("doc_id")).cast("string")
    alone = rows.filter(F.col("n_bytes") > limit)  # fewer than bytes / limit
    out = alone.select("doc_id", "n_bytes", F.concat(F.lit("doc:"), "_digest", F.lit(":"), number).alias("shard"), F.lit(2 * HALF).alias("depth"), F.col("n_bytes").alias("shard_bytes"), F.lit(1).cast("long").alias("shard_docs"), F.lit(True).alias("oversize"))
    done, left = split(rows.filter(F.col("n_bytes") <= limit).select("doc_id", "n_bytes", "_h1", "_h2", F.lit("b").alias("_prefix")), "_h1", step, limit, 0)
    if not left.isEmpty():
        more, last = split(left, "_h2", step, limit, HALF)
        # Rows that agree in all bits, of which there is hardly ever one: each is a shard.
        again = F.row_number().over(Window.partitionBy("_prefix").orderBy("doc_id")).cast("string")
        done += [*more, last.select("doc_id", "n_bytes", F.concat("_prefix", F.lit(":"), again).alias("shard"), F.lit(2 * HALF).alias("depth"), F.col("n_bytes").alias("shard_bytes"), F.lit(1).cast("long").alias("shard_docs"), F.lit(False).alias("oversize"))]
    for some in done:
        out = out.unionByName(some)
    return out


def write_shards(docs: DataFrame, path: str, *, id_col: str = "doc_id", **options) -> None:
    """Writes documents as Parquet, one folder for each shard; ids are unique."""
    to = shards(docs, id_col=id_col, **options).select(F.col("doc_id").alias("_id"), "shard")
    docs.join(to, F.col(id_col) == F.col("_id")).drop("_id").repartition("shard").write.partitionBy("shard").parquet(path)


def sql(limit: int = LIMIT) -> str:
    """shards(documents) in DuckDB SQL, for documents that differ: the bytes below every prefix, and the shortest one that fits."""
    return f"""
WITH d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS digest FROM documents),
  h AS (SELECT doc_id, n_bytes, lpad(bin(('0x' || digest[1:{HALF // 4}])::BIGINT), {HALF}, '0') AS bits FROM d WHERE n_bytes <= {limit}),
  p AS (SELECT doc_id, n_bytes, depth::INT AS depth, bits[1:depth] AS prefix FROM h, range({HALF + 1}) r(depth)),
  s AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM p GROUP BY ALL),
  f AS (SELECT p.*, shard_bytes, shard_docs FROM p JOIN s USING (depth, prefix) WHERE shard_bytes <= {limit} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1)
SELECT doc_id, n_bytes, 'b' || prefix AS shard, depth, shard_bytes, shard_docs, false AS oversize FROM f
UNION ALL SELECT doc_id, n_bytes, 'doc:' || digest || ':1', {2 * HALF}, n_bytes, 1, true FROM d WHERE n_bytes > {limit}"""
