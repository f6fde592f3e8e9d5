"""Operator 5: near copies among embeddings by iterative quantisation.

1. The principal axes of a bounded sample of vectors are turned by a rotation that is
   learnt by alternating between codes B = sign(VR) and the rotation that brings VR
   closest to B, so that the codes' bits are balanced.
2. Every vector is coded and retrieved by multi-index hashing: a code of 64 bits is cut
   into `PARTS` substrings, a table for each.  Two vectors meet if in one substring
   their codes differ in at most `FLIPS` bits, and in the whole code in at most
   `WITHIN`.  All codes within PARTS * (FLIPS + 1) - 1 = 11 bits do; of pairs at the
   least cosine, whose codes differ in about 6.5 bits, hardly one in a thousand doesn't.
   None of this depends on how many vectors there are.
3. Pairs that meet are reranked by the cosine of the original vectors, where they meet,
   each in the first table that brings it together; what leaves the task is the number
   of links of each vector, never the pairs.

Equal vectors are a class from the start.  The number of vectors decides only into how
many shares (by a substring's leading bits) a table is dealt; a vector goes to its own
share and is looked up in those whose leading bits are within `FLIPS` of its own.  A
share that holds more than `HOT` times its part, as of very many near copies of one
vector, is cut to several tasks (`_shares`).

The result has a row for each row of the table: class_id is the least id of the equal
vectors, n_links the number of other, different vectors within the cosine.

Defined results: vectors that are null or empty, hold null, NaN or infinity, or consist
of zeros have no class and no links; repeated rows and ids are each reported; null ids
are reported, and the class of equal vectors without any other id is null; vectors are
compared with those of their own length only, each length by codes of its own; ties at
exactly the cosine are links; double vectors are read as floats; an empty table gives no
rows; other columns aren't read.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolattice.llm._shares import ASKING, HELD, counted, dealt, parts_of
from geolattice.llm._store import documents, keep

MIN_COSINE, WITHIN, PARTS, FLIPS, STEPS = 0.95, 18, 4, 2, 12
#: Numbers in the sample (of about SAMPLE_FLOATS / width vectors) that axes and rotation are learnt from.
SAMPLE_FLOATS = 4_000_000
#: Vectors that the table of a task holds, about.
INDEX_ROWS = 250_000
#: A table's share of more than so many times that is dealt to several tasks.
HOT = 4


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def learn(x: np.ndarray, bits: int, steps: int = STEPS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Mean and width x bits projection of unit vectors: principal axes, rotated."""
    mean = x.mean(0)
    _, axes = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    axes = axes[:, ::-1][:, :bits]
    v = (x - mean) @ axes
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(steps):
        u, _, wt = np.linalg.svd(np.where(v @ rotation > 0, 1.0, -1.0).T @ v)
        rotation = (u @ wt).T
    return mean, axes @ rotation


def codes(x: np.ndarray, mean: np.ndarray, project: np.ndarray) -> np.ndarray:
    """Code of each unit vector."""
    out, on = np.zeros(len(x), np.uint64), (x - mean) @ project > 0
    for k in range(project.shape[1]):
        out |= on[:, k].astype(np.uint64) << np.uint64(k)
    return out


def cuts(bits: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Lowest bit and width of each substring."""
    ends = [bits * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _part(code: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    return (code >> np.uint64(span[0])) & np.uint64((1 << span[1]) - 1) if span[1] else np.zeros(len(code), np.uint64)


def links(vectors: DataFrame, n: int, mean: np.ndarray, project: np.ndarray, min_cosine: float = MIN_COSINE, index_rows: int = INDEX_ROWS) -> DataFrame:
    """number, n_links of the vectors (number, v; all of one width, about n of them) that have links."""
    spans = cuts(project.shape[1])
    high = min(min(w for _, w in spans), max(0, math.ceil(math.log2(max(1, n / index_rows)))))
    reach = [sum(1 << k for k in c) for f in range(min(FLIPS, high) + 1) for c in combinations(range(high), f)]

    def unit(v: np.ndarray) -> np.ndarray:
        x = v.astype(np.float64)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def held(batches):
        total = np.zeros((len(spans), 1 << high), np.int64)
        for b in batches:
            if b.num_rows:
                code = codes(unit(_matrix(b.column(0))), mean, project)
                total += counted([_part(code, (low + width - high, high)) for low, width in spans], high)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1)[at])], names=["at", "n"])

    sums = vectors.select("v").mapInArrow(held, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).filter(F.col("n") > HOT * index_rows).toArrow()  # hot shares
    rows_of = np.zeros(len(spans) << high, np.int64)
    rows_of[sums.column("at").to_numpy()] = sums.column("n").to_numpy()
    cells = parts_of(rows_of, HOT * index_rows).reshape(len(spans), -1)
    fields = "place int, share int, cell long, role int, number long, code long, v array<float>"

    def send(batches):
        for b in batches:
            if not b.num_rows:
                continue
            code, numbers = codes(unit(_matrix(b.column(1))), mean, project), b.column(0).to_numpy()
            for place, (low, width) in enumerate(spans):
                own = _part(code, (low + width - high, high))
                for r in reach:
                    share = (own ^ np.uint64(r)).astype(np.int32)
                    for rows, cell, role in dealt(share, r == 0, numbers, cells[place]):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), place, np.int32)), pa.array(share[rows]), pa.array(cell), pa.array(np.full(len(rows), role, np.int32)), pa.array(numbers[rows]), pa.array(code[rows].view(np.int64)), b.column(1).take(pa.array(rows))], names=[f.split()[0] for f in fields.split(", ")])

    def count(key: tuple, table: pa.Table) -> pa.Table:
        place, share = key[0].as_py(), key[1].as_py()
        span = spans[place]
        numbers, code, role = table.column("number").to_numpy(), table.column("code").to_numpy().view(np.uint64), table.column("role").to_numpy()
        x, rest = _matrix(table.column("v")), span[1] - high
        size = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
        part = _part(code, span)
        away = np.bitwise_count((part >> np.uint64(rest)) ^ np.uint64(share)).astype(np.int64)
        key_low = (part & np.uint64((1 << rest) - 1)).astype(np.int64)
        own = np.flatnonzero((away == 0) & (role != ASKING))
        own = own[np.argsort(key_low[own], kind="stable")]
        begin = np.concatenate([[0], np.cumsum(np.bincount(key_low[own], minlength=1 << rest))])
        found = np.zeros(len(numbers), np.int64)

        def compare(q: np.ndarray, entry: np.ndarray) -> None:
            apart = code[q] ^ code[entry]
            ok = (np.bitwise_count(apart) <= WITHIN) & (numbers[q] != numbers[entry])
            q, entry, apart = q[ok], entry[ok], apart[ok]
            for earlier in spans[:place]:  # a pair counts in the first table that brings it together
                ok = np.bitwise_count(_part(apart, earlier)) > FLIPS
                q, entry, apart = q[ok], entry[ok], apart[ok]
            for lo in range(0, len(q), 100_000):
                a, b = q[lo : lo + 100_000], entry[lo : lo + 100_000]
                cosine = np.einsum("ij,ij->i", x[a], x[b], dtype=np.float64) / (size[a] * size[b])
                np.add.at(found, a[cosine >= min_cosine], 1)

        for f in range(FLIPS + 1):
            query = np.flatnonzero((away + f <= FLIPS) & (role != HELD))
            for c in combinations(range(rest), f):
                wanted = key_low[query] ^ sum(1 << k for k in c)
                held = begin[wanted + 1] - begin[wanted]
                hit = np.flatnonzero(held)
                ends = np.cumsum(held[hit])
                lo = 0
                while lo < len(hit):  # as many as fit in memory at once; one query's partners stay together
                    base = ends[lo - 1] if lo else 0
                    hi = max(lo + 1, int(np.searchsorted(ends, base + 1_000_000, side="right")))
                    rows, many = hit[lo:hi], held[hit[lo:hi]]
                    first = np.cumsum(many) - many
                    entry = np.repeat(begin[wanted[rows]] - first, many) + np.arange(many.sum())
                    compare(np.repeat(query[rows], many), own[entry])
                    lo = hi
        some = np.flatnonzero(found)
        return pa.table({"number": numbers[some], "n": found[some]})

    sent = vectors.select("number", "v").mapInArrow(send, fields)
    return sent.groupBy("place", "share", "cell").applyInArrow(count, "number long, n long").groupBy("number").agg(F.sum("n").alias("n_links"))


def near_copies(table: DataFrame, min_cosine: float = MIN_COSINE, id_col: str = "vec_id", vector_col: str = "embedding", index_rows: int = INDEX_ROWS) -> DataFrame:
    """id, class_id, n_links of every row."""
    v = F.col("v")
    sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    rows = rows.withColumn("v", F.when(sound, v)).select("id", "v", F.when(v.isNotNull(), F.xxhash64("v")).alias("h"), F.when(v.isNotNull(), F.xxhash64(F.lit(1), "v")).alias("i"))
    classes = rows.filter("v is not null").groupBy("h", "i").agg(F.min("id").alias("class_id"), F.first("v").alias("v"))
    classes = keep(classes.withColumn("number", F.monotonically_increasing_id()), "classes")
    counted = None
    for d, n in sorted(classes.groupBy(F.size("v").alias("d")).count().collect()):  # one row a vector length
        own = classes.filter(F.size("v") == d)
        share = SAMPLE_FLOATS / (n * d)
        few = own if share >= 1 else own.filter(F.pmod(F.col("h"), F.lit(1 << 20)) < int(share * (1 << 20)))
        x = _matrix(few.select("v").toArrow().column("v")).astype(np.float64)
        mean, project = learn(x / np.linalg.norm(x, axis=1, keepdims=True), min(d, 64))
        part = links(own, n, mean, project, min_cosine, index_rows)
        counted = part if counted is None else counted.unionByName(part)
    if counted is None:
        return rows.select(F.col("id").alias(id_col), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links")).withColumn("class_id", F.when(F.lit(False), F.col("class_id")))
    known = classes.join(counted, "number", "left").select("h", "i", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return rows.select("id", "h", "i").join(known, ["h", "i"], "left").select(F.col("id").alias(id_col), "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every vector of the whole table."""
    return near_copies(documents(spark, sf_dir, "embeddings"))


QUERY = "op5_embedding_dedup"
SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding END AS e FROM embeddings),
classes AS (SELECT e, min(vec_id) AS class_id FROM v WHERE e IS NOT NULL GROUP BY e),
linked AS (SELECT a.e, count(*) AS n FROM classes a JOIN classes b ON a.e <> b.e
           AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e::DOUBLE[], b.e::DOUBLE[]) >= {MIN_COSINE} ELSE FALSE END GROUP BY a.e)
SELECT vec_id, class_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links
FROM v LEFT JOIN classes ON v.e = classes.e LEFT JOIN linked ON v.e = linked.e
"""
