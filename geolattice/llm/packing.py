"""Operator 6: length buckets that waste least padding, and token-budget batches.

A batch is padded to its bucket's boundary.  The global histogram of lengths holds all
that the padding depends on, so the boundaries that minimise it are found exactly on the
driver by dynamic programming over the distinct lengths: cost(i, j) = boundary_j *
(documents in (i, j]), whose minimum over i is the lower envelope of lines, O(lengths)
a bucket.  Within a bucket documents stand in order of (length, id) and every
max(1, budget // boundary) of them make a batch.

Plan: one aggregation (the histogram, whose rows are distinct lengths, not documents)
and one shuffle of (id, length) by length, never of text.  A document's place in its
bucket is the number of shorter ones there, known from the histogram, plus its number
among those of its own length.  A length that more than `part_rows` share is numbered in
ranges of the id: a sample of its ids, of bounded size, only says where ranges end, so
that no task gets too many; the ranges' sizes are counted beforehand, and the order is
that of the ids however it is cut.

Defined results: null and empty texts have length 0 and go into the first bucket (a
bucket of boundary 0 if padding is least so); repeated rows are packed each; ties in
length stand in order of id, null ids first; ids may be of any type that has an order;
an empty table gives no rows; a document longer than the budget is a batch of its own;
texts are measured whole; other columns aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolattice.llm._store import documents, keep
from geolattice.llm._tokens import with_lengths

BUCKETS, BUDGET = 16, 65536
#: A length is numbered in ranges of about so many documents, whose ends are taken from so many ids for each.
PART_ROWS, SAMPLED = 1_000_000, 64


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> tuple[list[int], int]:
    """At most `buckets` boundaries for ascending distinct lengths, and the padding they leave."""
    n, buckets = len(lengths), min(buckets, len(lengths))
    if not n:
        return [], 0
    below = [0]
    for c in counts:
        below.append(below[-1] + c)
    best = [lengths[j - 1] * below[j] if j else 0 for j in range(n + 1)]  # with one bucket
    came = [[0] * (n + 1)]
    for _ in range(1, buckets):
        # best'[j] = min over i < j of best[i] + b_j * (below[j] - below[i]): lines of slope -below[i] at b_j
        hull: list[tuple[int, int, int]] = []
        head, nxt, back = 0, [0] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            m, q = -below[j - 1], best[j - 1]
            while len(hull) - head >= 2:
                (m1, q1, _), (m2, q2, _) = hull[-2], hull[-1]
                if (q - q1) * (m1 - m2) <= (q2 - q1) * (m1 - m):
                    hull.pop()
                else:
                    break
            hull.append((m, q, j - 1))
            b = lengths[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * b + hull[head + 1][1] <= hull[head][0] * b + hull[head][1]:
                head += 1
            m, q, i = hull[head]
            nxt[j], back[j] = m * b + q + b * below[j], i
        best, came = nxt, [*came, back]
    cuts, j = [], n
    for back in reversed(came):
        if not j:
            break
        cuts.append(lengths[j - 1])
        j = back[j]
    return cuts[::-1], best[n] - sum(x * c for x, c in zip(lengths, counts))


def _below(ends: Column, x: Column, step: int) -> Column:
    """How many of the ascending ends are below x: blocks of `step` first, then within one."""
    blocks = F.size(F.filter(F.transform(F.sequence(F.lit(step), F.greatest(F.size(ends), F.lit(step)), F.lit(step)), lambda k: F.get(ends, k - 1)), lambda e: e < x))
    return blocks * step + F.size(F.filter(F.slice(ends, blocks * step + 1, step), lambda e: e < x))


def pack(lengths: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, id_col: str = "doc_id", length_col: str = "n_tokens", part_rows: int = PART_ROWS) -> DataFrame:
    """id, n_tokens, bucket, padded_to, batch (numbered in its bucket from 0), of every row of lengths."""
    spark = lengths.sparkSession
    rows = keep(lengths.select(F.col(id_col).alias("id"), F.coalesce(F.col(length_col), F.lit(0)).cast("long").alias("n")), "lengths")
    hist = rows.groupBy("n").agg(F.count(F.lit(1)).alias("c")).toPandas().sort_values("n")  # as many rows as distinct lengths
    ns, cs = hist["n"].astype(int).tolist(), hist["c"].astype(int).tolist()
    ends, _ = boundaries(ns, cs, buckets)
    bucket = np.searchsorted(np.asarray(ends, np.int64), np.asarray(ns, np.int64)) if ns else np.zeros(0, np.int64)
    shorter, seen = [], {}
    for k, c in zip(bucket.tolist(), cs):
        shorter.append(seen.get(k, 0))
        seen[k] = seen.get(k, 0) + c
    plan = spark.createDataFrame(
        pa.table({"n": pa.array(ns, pa.int64()), "bucket": pa.array(bucket, pa.int64()), "padded_to": pa.array([ends[k] for k in bucket], pa.int64()), "shorter": pa.array(shorter, pa.int64()), "parts": pa.array([max(1, -(-c // part_rows)) for c in cs], pa.int64())})
    ) if ns else spark.createDataFrame([], "n long, bucket long, padded_to long, shorter long, parts long")
    placed = rows.join(F.broadcast(plan) if len(ns) < 500_000 else plan, "n")
    hot = {n: -(-c // part_rows) for n, c in zip(ns, cs) if c > part_rows}
    if hot:
        # Ends of the ranges, for each length of more than part_rows documents, of a sample of about SAMPLED ids a range.
        wanted = spark.createDataFrame([(n, SAMPLED * parts * (1 << 30) // c) for n, c in zip(ns, cs) if (parts := hot.get(n))], "n long, most long")
        few = rows.join(F.broadcast(wanted), "n").filter("id is not null").filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= F.col("most")).groupBy("n").agg(F.array_sort(F.collect_set("id")).alias("ids"))
        ends_of = few.join(F.broadcast(plan.select("n", "parts")), "n").select("n", F.transform(F.sequence(F.lit(1), F.col("parts") - 1), lambda k: F.element_at("ids", F.least(F.size("ids"), F.greatest(F.lit(1), F.floor(k * F.size("ids") / F.col("parts")))).cast("int"))).alias("ends"))
        ends_of = keep(ends_of, "ranges")
        placed = placed.join(F.broadcast(ends_of), "n", "left").withColumn("part", F.when(F.col("ends").isNull() | F.col("id").isNull(), F.lit(-1)).otherwise(_below(F.col("ends"), F.col("id"), math.ceil(math.sqrt(max(hot.values())))))).drop("ends")
    else:
        placed = placed.withColumn("part", F.lit(-1))
    sizes = placed.filter("parts > 1").groupBy("n", "part").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.partitionBy("n").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("n", "part", F.coalesce("before", F.lit(0)).alias("before"))
    if hot:
        placed = placed.join(before, ["n", "part"], "left")
    else:
        placed = placed.withColumn("before", F.lit(0))
    rank = F.col("shorter") + F.coalesce("before", F.lit(0)) + F.row_number().over(Window.partitionBy("n", "part").orderBy(F.col("id").asc_nulls_first())) - 1
    held = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("padded_to"), F.lit(1))))
    return placed.withColumn("batch", F.floor(rank / held).cast("long")).select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), "bucket", "padded_to", "batch")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(with_lengths(docs.select("doc_id", "text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket and batch of every document."""
    return pack(with_lengths(documents(spark, sf_dir).select("doc_id", "text")))


QUERY, SQL = "op6_packing", None
