"""Operator 10: benchmark passages in the corpus, by latent semantic retrieval.

1. Document frequencies of the benchmark's words are counted over the whole corpus.
   Words in more than `MAX_DF` of the documents (of which `FEW` are added, so that a
   corpus of a few documents has no stop words) are stop words; the others weigh as
   log(documents / frequency).
2. Items are cut into pieces of up to half a window, so that each stands whole in some
   window of a text that holds it.  The TF-IDF matrix of the pieces is reduced by randomised SVD (range
   finder with power iterations, each product a distributed sum over the passages).
3. Every document is cut into windows of `WINDOW` words, each overlapping the next by
   half.  In a window's latent vector each word counts by the inverse of its weight, so
   that the product with a piece's is the share of the piece's words (without stop words)
   that the window holds, whatever else stands there.  A pair is a candidate from the
   share that is left if all that `MIN_LCS` lets go are different words of these (from `MIN_SHARE` at least, which acts on pieces of mostly stop words only), so neither
   the number of documents nor that of copies hides an item.
4. A candidate is accepted if the longest common subsequence of its words and the
   window's (with as many words as the item has on either side) holds `MIN_LCS` of the
   item, and the answer check passes: half of the item's answer words, which are those
   after its last "answer:" or question mark, else its three rarest, stand in the
   window (or the subsequence holds `SURE_LCS` of the item).

The words of `ITEMS_PER_PASS` items at a time are counted in one reading of the corpus.
Items of at most `RANK` pieces (or one longer item) share a projection, so that its rank
is the pieces' number and no part is lost in it, however large the benchmark.  The corpus is read, never shuffled: only counts and the findings move.

Defined results: null and empty texts and items have no findings; items of fewer than
`MIN_WORDS` words, which any text may hold by chance, and items that consist of stop
words match only as a whole run of words; items with equal words are each found; repeated rows give equal findings once;
null ids of documents are judged like others, items without an id are left out; a share
on exactly a threshold is enough; ids of either table may be of any type; an empty
benchmark finds nothing, an empty table gives an empty one; texts and items are read
whole, however long; other columns are untouched, whatever their names.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from geolattice.llm._store import documents, shipped, small_batches
from geolattice.llm._text import give_back, slices, texts_of, tidy, words_of

WINDOW, MIN_SHARE, MIN_LCS, SURE_LCS, MAX_DF, FEW = 64, 0.2, 0.6, 0.8, 0.2, 20
RANK, OVERSAMPLE, POWER, ITEMS_PER_PASS, MIN_WORDS = 256, 16, 2, 4096, 6


@dataclass
class Index:
    """What the executors need of a part of the benchmark."""

    vocabulary: pa.Array
    weight: np.ndarray  # of each word; 0 for stop words
    project: np.ndarray  # words x rank, over the weights; 0 for stop words
    pieces: np.ndarray  # pieces x rank; times the latent vector of all of a piece's words: 1
    least: np.ndarray  # share of each piece that makes a candidate
    item: np.ndarray  # of each piece
    ids: pa.Array
    words: list[list[int]]
    answers: list[set[int]]


def _item_words(texts: pa.Array) -> list[list[str]]:
    flat, offsets = words_of(texts)
    flat = flat.to_pylist()
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def frequencies(docs: DataFrame, vocabulary: pa.Array, text_col: str = "text") -> tuple[int, np.ndarray]:
    """Documents, and how many hold each word."""
    shared = shipped(docs.sparkSession, vocabulary)

    def run(batches):
        words, total = shared(), 0
        df = np.zeros(len(words), np.int64)
        for b in batches:
            texts = texts_of(b.column(0))
            total += len(texts)
            for start, stop in slices(texts, 1_500_000):
                flat, offsets = words_of(texts.slice(start, stop - start))
                ids = pc.fill_null(pc.index_in(flat, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                at = np.flatnonzero(ids >= 0)
                owner = np.searchsorted(offsets, at, side="right") - 1
                df += np.bincount(np.unique(owner * len(words) + ids[at]) % max(1, len(words)), minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([df.tobytes()], pa.binary())], names=["n", "df"])

    def add(table: pa.Table) -> pa.Table:
        df = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("df"))
        return pa.table({"n": [pc.sum(table.column("n")).as_py()], "df": pa.array([df.tobytes()], pa.binary())})

    parts = small_batches(docs).select(text_col).mapInArrow(tidy(run), "n long, df binary")
    # Two levels of sums, so that no task adds up more than a few hundred parts.
    first = parts.groupBy((F.spark_partition_id() % 64).alias("g")).applyInArrow(add, "n long, df binary")
    rows = first.toArrow()
    if not rows.num_rows:
        return 0, np.zeros(len(vocabulary), np.int64)
    whole = add(rows)
    return whole.column("n")[0].as_py(), np.frombuffer(whole.column("df")[0].as_py(), np.int64)


def randomised_svd(spark: SparkSession, rows: list[tuple[list[int], list[float]]], width: int, rank: int, oversample: int = OVERSAMPLE, power: int = POWER, parts: int = 8, seed: int = 11) -> np.ndarray:
    """width x rank: right singular vectors of a sparse matrix; each product with it is a sum over partitions of its rows."""
    size = min(rank + oversample, width)
    table = spark.createDataFrame(pa.table({"at": pa.array([r[0] for r in rows], pa.list_(pa.int32())), "x": pa.array([r[1] for r in rows], pa.list_(pa.float32()))})).repartition(parts)

    def gram(v: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(v)

        def run(batches):
            out, q = np.zeros(shared.value.shape), shared.value
            for b in batches:
                for at, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    x = np.asarray(x)
                    np.add.at(out, at, x[:, None] * (x @ q[at])[None])
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["y"])

        got = table.mapInArrow(tidy(run), "y binary").toArrow().column("y")
        shared.unpersist()
        return sum(np.frombuffer(y.as_py()).reshape(v.shape) for y in got)

    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, size)))[0]
    for _ in range(power):
        q = np.linalg.qr(gram(q))[0]
    small = q.T @ gram(q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    keep = np.argsort(-values)[:rank]
    return q @ vectors[:, keep[values[keep] > 1e-9 * max(values.max(), 1e-30)]]


def _answer(text: str, words: list[str], weight: dict[str, float]) -> set[str]:
    tail = re.split(r"(?i)answer\s*:|\?", text)[-1] if re.search(r"(?i)answer\s*:|\?", text) else ""
    named = set(_item_words(pa.array([tail], pa.large_string()))[0])
    return named or set(sorted(set(words), key=lambda w: (-weight.get(w, 0.0), w))[:3])


def _pieces(words: list[str]) -> list[list[str]]:
    """The words in runs of up to half a window, about equally long."""
    k = -(-len(words) // (WINDOW // 2))
    return [words[len(words) * j // k : len(words) * (j + 1) // k] for j in range(k)]


def _index(spark: SparkSession, by_word: dict[str, float], ids: pa.Array, texts: tuple, words: tuple) -> Index:
    """The index of items that share a projection, by the weights of their words."""
    vocabulary = sorted({w for x in words for w in x})
    weight = np.array([by_word[w] for w in vocabulary])
    place = {w: k for k, w in enumerate(vocabulary)}
    sparse, scale, least, owner = [], [], [], []
    for k, item in enumerate(words):
        for piece in _pieces(item):
            every = [place[w] for w in piece]
            at = np.unique(every)
            x = weight[at]  # repeated words count once, in items and windows
            if not x.any():  # nothing but stop words
                continue
            size = np.linalg.norm(x)
            sparse.append((at.tolist(), (x / size).tolist()))
            lost = len(every) - math.ceil(MIN_LCS * len(every) - 1e-9)
            scale.append(size / (x > 0).sum())
            least.append(max(MIN_SHARE, 1 - lost / (x > 0).sum()))
            owner.append(k)
    project = randomised_svd(spark, sparse, len(vocabulary), len(sparse)) if sparse else np.zeros((len(vocabulary), 0))
    latent = np.array([np.asarray(x) @ project[at] * y for (at, x), y in zip(sparse, scale)], np.float32).reshape(len(sparse), project.shape[1])
    inverse = np.divide(1.0, weight, out=np.zeros(len(weight)), where=weight > 0)
    answers = [{place[w] for w in _answer(t, x, by_word) if w in place} for t, x in zip(texts, words)]
    return Index(pa.array(vocabulary, pa.large_string()), weight.astype(np.float32), (project * inverse[:, None]).astype(np.float32), latent, np.array(least, np.float32) * np.float32(0.999), np.array(owner, np.int64), ids, [[place[w] for w in x] for x in words], answers)


def build(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> list[Index]:
    rows = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).dropna().distinct().orderBy("i", "t").toArrow()
    words = _item_words(texts_of(rows.column("t")))
    some = [k for k, x in enumerate(words) if x]
    rows, words = rows.take(pa.array(some, pa.int64())), tuple(words[k] for k in some)
    ids, texts = rows.column("i").combine_chunks(), rows.column("t").to_pylist()
    out = []
    for lo in range(0, len(ids), ITEMS_PER_PASS):
        hi = min(lo + ITEMS_PER_PASS, len(ids))
        counted = pa.array(sorted({w for x in words[lo:hi] for w in x}), pa.large_string())
        n, df = frequencies(docs, counted, text_col)
        by_word = dict(zip(counted.to_pylist(), np.where(df > MAX_DF * (n + FEW), 0.0, np.log((n + 1) / np.maximum(df, 1))).tolist()))
        first, held = lo, 0
        for k in range(lo, hi):
            held += len(_pieces(words[k]))
            if k + 1 == hi or held + len(_pieces(words[k + 1])) > RANK:
                part = slice(first, k + 1)
                out.append(_index(spark, by_word, ids[part], texts[part], words[part]))
                first, held = k + 1, 0
    give_back()
    return out


def common(item: list[int], text: list[int], needed: set[int]) -> tuple[int, int]:
    """Length of the longest common subsequence, and how many of the needed words the text holds.

    Bit-parallel: bit i of the row says that the item's word i doesn't lengthen the subsequence so far.
    """
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in text:
        m = where.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    held = len(item) - row.bit_count()
    return held, len(needed & set(text))


def matches(index: Index, texts: pa.Array) -> dict[tuple[int, int], float]:
    """(row, item) -> share of the item in the longest common subsequence, for accepted pairs."""
    found: dict[tuple[int, int], float] = {}
    half = WINDOW // 2
    runs = [k for k, w in enumerate(index.words) if len(w) < MIN_WORDS or not index.weight[w].any()]
    stops = np.append(index.weight == 0, False)
    for start, stop in slices(texts, 1_500_000):
        flat, offsets = words_of(texts.slice(start, stop - start))
        if not len(flat):
            continue
        ids = pc.fill_null(pc.index_in(flat, value_set=index.vocabulary), len(index.vocabulary)).to_numpy(zero_copy_only=False).astype(np.int64)
        size = np.diff(offsets)
        blocks = np.maximum(1, -(-size // half)) * (size > 0)
        first = np.concatenate([[0], np.cumsum(blocks)])
        owner = np.repeat(np.arange(len(size)), blocks)
        begin = offsets[owner] + (np.arange(first[-1]) - first[owner]) * half  # half windows; a window is one and the next of its text
        at = np.flatnonzero((ids < len(index.vocabulary)) & ~stops[ids])
        mine = np.searchsorted(begin, at, side="right") - 1
        at = at[np.sort(np.unique(mine * len(stops) + ids[at], return_index=True)[1])]  # each word once a half window
        mine = np.searchsorted(begin, at, side="right") - 1
        last = np.append(owner[1:] != owner[:-1], True)
        busy, cut = np.unique(mine, return_index=True)
        sums = np.zeros((len(busy) + 1, index.project.shape[1]), np.float32)
        for lo in range(0, len(busy), 50_000):
            hi = min(lo + 50_000, len(busy))
            rows = slice(cut[lo], cut[hi] if hi < len(busy) else len(at))
            sums[lo:hi] = np.add.reduceat(index.project[ids[at[rows]]], cut[lo:hi] - cut[lo], axis=0)
        slot = np.full(first[-1] + 1, len(busy), np.int64)
        slot[busy] = np.arange(len(busy))
        # Windows that hold any of the benchmark's words; the last half window of a text is a window only if it is its first.
        single = last & np.append(True, owner[1:] != owner[:-1])
        window = np.flatnonzero(~last | single)
        second = np.where(last[window], first[-1], window + 1)
        some = (slot[window] < len(busy)) | (slot[second] < len(busy))
        window, second = window[some], second[some]
        for lo in range(0, len(window), 20_000):
            a, b = window[lo : lo + 20_000], second[lo : lo + 20_000]
            near, piece = np.nonzero((sums[slot[a]] + sums[slot[b]]) @ index.pieces.T >= index.least)
            for w, k in np.unique(np.stack([near, index.item[piece]], axis=1), axis=0).tolist():
                doc = owner[a[w]]
                item = index.words[k]
                if len(item) < MIN_WORDS or found.get((start + int(doc), k), 0) == 1:
                    continue
                lo_w, hi_w = max(offsets[doc], begin[a[w]] - len(item)), min(offsets[doc + 1], begin[a[w]] + WINDOW + len(item))
                held, answered = common(item, ids[lo_w:hi_w].tolist(), index.answers[k])
                share, needed = held / len(item), len(index.answers[k])
                if share >= MIN_LCS and (2 * answered >= needed or share >= SURE_LCS):
                    key = (start + int(doc), k)
                    found[key] = max(found.get(key, 0.0), share)
        for k in runs:
            item = np.asarray(index.words[k])
            hit = np.flatnonzero(ids[: len(ids) - len(item) + 1] == item[0])
            for j in range(1, len(item)):
                hit = hit[ids[hit + j] == item[j]]
            doc = np.searchsorted(offsets, hit, side="right") - 1
            for d in doc[hit + len(item) <= offsets[doc + 1]]:
                found[(start + int(d), k)] = 1.0
    return found


def findings(docs: DataFrame, indexes: list[Index], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, item_id, lcs: each document with each benchmark item that it holds."""
    kind = docs.schema[id_col].dataType.simpleString()
    item = from_arrow_type(indexes[0].ids.type).simpleString() if indexes else "bigint"
    shared = [shipped(docs.sparkSession, x) for x in indexes]

    def run(batches):
        parts = [x() for x in shared]
        for b in batches:
            texts = texts_of(b.column(1))
            for part in parts:
                rows = sorted(matches(part, texts).items())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r for (r, _), _ in rows], pa.int64())), part.ids.take(pa.array([k for (_, k), _ in rows], pa.int64())), pa.array([x for _, x in rows], pa.float64())], names=[id_col, "item_id", "lcs"])

    return small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"`{id_col}` {kind}, item_id {item}, lcs double").distinct()


def drop_contaminated(docs: DataFrame, indexes: list[Index], text_col: str = "text") -> DataFrame:
    """docs without those that hold an item; all columns as they were, no shuffle."""
    shared = [shipped(docs.sparkSession, x) for x in indexes]

    def run(batches):
        parts = [x() for x in shared]
        for b in batches:
            texts, clean = texts_of(b.column(b.schema.get_field_index(text_col))), np.ones(b.num_rows, bool)
            for part in parts:
                clean[[r for r, _ in matches(part, texts)]] = False
            yield b.filter(pa.array(clean))

    return small_batches(docs).mapInArrow(tidy(run), docs.schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, build(spark, docs, documents(spark, sf_dir, "benchmark")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table that holds a benchmark item, with the item."""
    docs = documents(spark, sf_dir)
    return findings(docs, build(spark, docs, documents(spark, sf_dir, "benchmark")))


QUERY, SQL = "op10_decontamination", None
