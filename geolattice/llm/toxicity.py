"""Operator 8: a convolutional text classifier over hashed words.

Each word is the sum of two learnt vectors, one for the whole word and one for its
first letters.  Filters of several widths slide over the text, each keeps its highest
response (max pooling), and a logistic layer on top gives the probability of a toxic
text.  All of it is trained in numpy on all labelled rows but a quarter, by hash of the
id, and the thresholds are then set for each language on all rows of that quarter.

Up to `LOCAL_ROWS` labelled rows train in the driver.  More are kept as tokens; in
each epoch every task that reads them trains a copy of the model, and the driver takes the
mean of what the copies learnt: of a word's vector, over the copies that changed it.  The thresholds then come from the scores of all rows kept out, sorted by Spark.

Defined results: null, empty and wordless texts score 0 and are never toxic; a null
language is a language of its own, apart from the empty one, and, as any language with
fewer than `MIN_POSITIVES` held-out toxic rows, takes the threshold of all languages
together; repeated rows are scored each by itself, and of the rows of one id one is
trained on; a score on exactly the threshold isn't toxic; without a toxic and a clean
label nothing is toxic; labels that are null are left out, and of an id labelled twice
the higher label holds; an empty table gives an empty one; other columns are untouched,
whatever their names.  Texts are read whole, however long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolattice.llm._store import documents, forget, keep, shipped, small_batches
from geolattice.llm._text import encoded, give_back, hash_words, reduce_rows, slices, texts_of, tidy, words_of

#: Up to so many labelled rows, of so many characters in all, train in the driver.
LOCAL_ROWS, LOCAL_CHARS = 6000, 30_000_000
#: Labelled rows of a file of tokens, at most about.
SHARD_ROWS = 4000
#: Bits, at most, of the filter that spares most texts without a label the join.
FILTER_BITS = 1 << 27
#: Words whose responses are held at once in training; a longer text stands alone.
HELD_WORDS = 100_000
STEP = 48
BUCKETS, DIM, FILTERS, WIDTHS, PREFIX = 1 << 17, 16, 8, (1, 2, 3), 4
MIN_POSITIVES = 8


@dataclass
class Model:
    table: np.ndarray  # BUCKETS x DIM
    filters: list[np.ndarray]  # for each width: width x DIM x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str | None, float]
    default: float


def _rows_of_words(uniq: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of each word and of its first letters."""
    whole = (hash_words(uniq) % np.uint64(BUCKETS)).astype(np.int64)
    heads, dictionary = encoded(pc.utf8_slice_codeunits(uniq, 0, PREFIX))
    salted = (hash_words(dictionary) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 17)
    return whole, salted.astype(np.int64)[heads]


def _pooled(parts: list[np.ndarray], idx: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Highest response of every filter in every text; 0 where a text is too short for the width.

    parts: for each width, responses of each distinct word at each place under the filter.
    """
    out = []
    for w, part in enumerate(parts):
        width = part.shape[1]
        ends = np.maximum(offsets[1:] - width + 1, offsets[:-1])
        owner_ok = np.zeros(len(idx) + 1, np.int64)
        np.add.at(owner_ok, offsets[:-1], 1)
        np.add.at(owner_ok, ends, -1)
        at = np.flatnonzero(np.cumsum(owner_ok[:-1]) > 0)  # places where the filter fits in its text
        z = part[idx[at], 0]
        for j in range(1, width):
            z = z + part[idx[at + j], j]
        first = np.searchsorted(at, offsets)
        out.append(np.maximum(reduce_rows(np.maximum, z, first, -np.inf), 0))
    return np.hstack(out)


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Probability that each text is toxic."""
    out = np.zeros(len(texts), np.float64)
    for start, stop in slices(texts, 1_000_000):
        flat, offsets = words_of(texts.slice(start, stop - start))
        if len(flat):
            idx, uniq = encoded(flat)
            out[start:stop] = _scored(model, *_rows_of_words(uniq), idx, offsets)
    return out


def _scored(model: Model, whole: np.ndarray, head: np.ndarray, idx: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probabilities of texts given as indexes of distinct words, these as table rows."""
    vec = model.table[whole] + model.table[head]
    parts = [np.stack([vec @ f[j] + (b if j == 0 else 0) for j in range(len(f))], axis=1) for f, b in zip(model.filters, model.bias)]
    p = 1 / (1 + np.exp(-(_pooled(parts, idx, offsets) @ model.out + model.out_bias)))
    return np.where(np.diff(offsets) > 0, p, 0).astype(np.float64)


class _Adam:
    def __init__(self, x: np.ndarray, rate: float):
        self.x, self.rate, self.m, self.v, self.t = x, rate, np.zeros_like(x), np.zeros_like(x), 0

    def step(self, g: np.ndarray, rows=slice(None)) -> None:
        self.t += 1
        self.m[rows] = m = 0.9 * self.m[rows] + 0.1 * g
        self.v[rows] = v = 0.999 * self.v[rows] + 0.001 * g * g
        self.x[rows] -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-7)


def _untrained(seed: int) -> Model:
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    filters = [rng.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    return Model(table, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0.3, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), -1.0, {}, 0.5)


def _weight_of(toxic: int, clean: int) -> float:
    return min(5.0, max(1.0, clean / max(1, toxic)))


class _Trainer:
    """Trains the model in place, from texts given as table rows of their words and of these words' first letters."""

    def __init__(self, model: Model, weight: float):
        self.model, self.weight, self.ob = model, weight, np.full(1, model.out_bias, np.float32)
        self.at_table, self.at_out, self.at_ob = _Adam(model.table, 0.02), _Adam(model.out, 0.02), _Adam(self.ob, 0.02)
        self.at_f, self.at_b = [_Adam(f, 0.01) for f in model.filters], [_Adam(b, 0.01) for b in model.bias]

    def _responses(self, rows: np.ndarray, whole: np.ndarray, head: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Highest response of each filter in each row, and the place of its first word; -1 where a text is too short."""
        m = self.model
        pooled = np.zeros((len(rows), FILTERS * len(WIDTHS)), np.float32)
        best = np.full(pooled.shape, -1, np.int64)
        size = offsets[rows + 1] - offsets[rows]
        ends = np.cumsum(size)
        lo = 0
        while lo < len(rows):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[lo] + HELD_WORDS, side="right")))
            words = np.concatenate([np.arange(offsets[r], offsets[r + 1]) for r in rows[lo:hi]])
            vec = m.table[whole[words]] + m.table[head[words]]
            starts = ends[lo:hi] - size[lo:hi] - (ends[lo] - size[lo])
            for k, width in enumerate(WIDTHS):
                n = len(words) - width + 1
                if n <= 0:
                    continue
                z = sum(vec[j : j + n] @ m.filters[k][j] for j in range(width)) + m.bias[k]
                for r, a, b in zip(range(lo, hi), starts, starts + size[lo:hi] - width + 1):
                    if b > a:
                        top = z[a:b].argmax(0)
                        pooled[r, k * FILTERS : (k + 1) * FILTERS] = z[a:b][top, np.arange(FILTERS)]
                        best[r, k * FILTERS : (k + 1) * FILTERS] = top + offsets[rows[r]]
            lo = hi
        return pooled, best

    def step(self, rows: np.ndarray, whole: np.ndarray, head: np.ndarray, offsets: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        """One step of Adam on some of the texts; gives the table rows that it changed."""
        m = self.model
        pooled, best = self._responses(rows, whole, head, offsets)
        alive = pooled > 0
        act = np.where(alive, pooled, 0)
        p = 1 / (1 + np.exp(-(act @ m.out + self.ob[0])))
        d = ((p - toxic[rows]) * np.where(toxic[rows] == 1, self.weight, 1.0) / len(rows)).astype(np.float32)
        back = d[:, None] * m.out[None] * np.where(alive, 1, 0.05) * (best >= 0)  # leaky, so that no filter dies
        touched, grads = [], []
        for k, width in enumerate(WIDTHS):
            g = np.zeros_like(m.filters[k])
            for f in range(FILTERS):
                c = k * FILTERS + f
                ok = np.flatnonzero(best[:, c] >= 0)
                for j in range(width):
                    w, h = whole[best[ok, c] + j], head[best[ok, c] + j]
                    g[j, :, f] = back[ok, c] @ (m.table[w] + m.table[h])
                    e = back[ok, c][:, None] * m.filters[k][j, :, f][None]
                    touched += [w, h]
                    grads += [e, e]
            self.at_f[k].step(g + 1e-4 * m.filters[k])
            self.at_b[k].step(back[:, k * FILTERS : (k + 1) * FILTERS].sum(0))
        self.at_out.step(d @ act + 1e-4 * m.out)
        self.at_ob.step(np.array([d.sum()], np.float32))
        m.out_bias = float(self.ob[0])
        touched = np.concatenate(touched)
        order = np.argsort(touched, kind="stable")
        which, first = np.unique(touched[order], return_index=True)
        total = np.add.reduceat(np.concatenate(grads)[order], first, axis=0)
        self.at_table.step(total + 1e-4 * m.table[which], which)
        return which


def _fit(texts: pa.Array, toxic: np.ndarray, epochs: int, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    flat, offsets = words_of(texts)
    idx, uniq = encoded(flat)
    whole, head = (rows[idx] for rows in _rows_of_words(uniq))
    model = _untrained(seed)
    trainer = _Trainer(model, _weight_of(int((toxic == 1).sum()), int((toxic == 0).sum())))
    usable = np.flatnonzero(np.diff(offsets) > 0)
    for _ in range(epochs):
        rng.shuffle(usable)
        for lo in range(0, len(usable), STEP):
            trainer.step(usable[lo : lo + STEP], whole, head, offsets, toxic)
    return model


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Middle of the gap between scores at which F1 is best; the lowest of several."""
    order = np.argsort(-p, kind="stable")
    ps, ys = p[order], y[order]
    tp = np.cumsum(ys)
    f1 = 2 * tp / (np.arange(1, len(ys) + 1) + ys.sum())
    f1[:-1][ps[:-1] == ps[1:]] = -1  # equal scores fall on one side
    k = len(f1) - 1 - int(np.argmax(f1[::-1]))
    return float((ps[k] + (ps[k + 1] if k + 1 < len(ps) else 0)) / 2)


def train(texts: pa.Array, langs: list[str | None], toxic: np.ndarray, epochs: int = 8, seed: int = 7) -> Model | None:
    """None where the labels hold only one class."""
    y = np.asarray(toxic, np.int64)
    if not len(y) or y.min() == y.max():
        return None
    part = np.random.default_rng(seed).random(len(y)) < 0.25
    if min(y[part].sum(), y[~part].sum(), (1 - y)[part].sum(), (1 - y)[~part].sum()) < MIN_POSITIVES:
        part[:] = True  # too few to keep any out: calibrated on the training rows
        model = _fit(texts, y, epochs, seed)
    else:
        inside = np.flatnonzero(~part)
        model = _fit(texts.take(pa.array(inside)), y[inside], epochs, seed)
    held = np.flatnonzero(part)
    p, yh = scores(model, texts.take(pa.array(held))), y[held]
    model.default = _threshold(p, yh)
    where = [langs[i] for i in held]
    for lang in set(where):
        own = np.array([x == lang for x in where])
        if yh[own].sum() >= MIN_POSITIVES and (1 - yh[own]).sum() >= MIN_POSITIVES:
            model.thresholds[lang] = _threshold(p[own], yh[own])
    return model


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int | None = None, sample_chars: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Trains on all labelled rows; only if asked to, on those whose ids hash lowest: sample_rows at most, and of these as many as hold sample_chars."""
    spark = docs.sparkSession
    chosen = labels.select(F.col(id_col).alias("i"), F.col("toxic").cast("int").alias("t")).dropna().groupBy("i").agg(F.max("t").alias("t"))
    if sample_rows is not None:
        chosen = chosen.orderBy(F.xxhash64("i"), "i").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang"))
    sizes = rows.select("i", F.xxhash64("text", "lang").alias("k"), F.length("text").alias("n")).groupBy("i").agg(F.min(F.struct("k", "n")).alias("r"))
    one = keep(sizes.join(chosen, "i").select(F.xxhash64("i").alias("h"), "i", "r.k", "r.n", "t"), "labelled")  # numbers and an id
    n, chars = one.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if sample_rows is None and sample_chars is None and (n > LOCAL_ROWS or chars > LOCAL_CHARS):
        model = fit_shards(rows, one, n)
        forget(one)
        return model
    sizes = one.toArrow()
    forget(one)
    sizes = sizes.take(pc.sort_indices(sizes, [("h", "ascending"), ("i", "ascending")]))
    held = np.cumsum(sizes["n"].to_numpy()) <= (chars if sample_chars is None else sample_chars)
    if not held.any():
        return None
    sample = spark.createDataFrame(sizes.select(["i", "k", "t"]).filter(pa.array(held)))
    both = rows.withColumn("k", F.xxhash64("text", "lang")).join(F.broadcast(sample), ["i", "k"])
    got = both.groupBy("i").agg(F.first(F.struct("text", "lang", "t")).alias("r")).select(F.xxhash64("i").alias("h"), "i", "r.*").toArrow()
    got = got.take(pc.sort_indices(got, [("h", "ascending"), ("i", "ascending")]))
    model = train(texts_of(got["text"]), got["lang"].to_pylist(), got["t"].to_numpy())
    del got, sizes, sample
    give_back()
    return model


def _tokens(batches):
    """i, lang, t, out of each row, and the table rows of its words and of their first letters, one after the other; of rows with one id, which follow each other, the first."""
    last, shard = None, TaskContext.get().partitionId()
    for b in batches:
        ids = b.column(0).to_pylist()
        new = pa.array([x != y for x, y in zip(ids, [last, *ids[:-1]])], pa.bool_())
        last, b = ids[-1] if ids else last, b.filter(new)
        texts = texts_of(b.column(1))
        for start, stop in slices(texts, 4_000_000):
            flat, offsets = words_of(texts.slice(start, stop - start))
            idx, uniq = encoded(flat)
            both = np.stack(_rows_of_words(uniq)).astype(np.int32)[:, idx]
            cells = [both[:, x:y].tobytes() for x, y in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([*(b.column(k).slice(start, stop - start) for k in (2, 3, 4)), pa.array(cells, pa.binary()), pa.array(np.full(len(cells), shard, np.int32))], names=["lang", "t", "out", "words", "shard"])


def _flat(cells: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """whole, head and offsets of all texts of a batch from _tokens()."""
    each = [np.frombuffer(c, np.int32).reshape(2, -1) for c in cells.to_pylist()]
    both = np.concatenate([np.zeros((2, 0), np.int32), *each], axis=1)
    return both[0], both[1], np.concatenate([[0], np.cumsum([c.shape[1] for c in each])]).astype(np.int64)


def _maybe_labelled(rows: DataFrame, one: DataFrame, n: int) -> DataFrame:
    """rows whose id's hash is that of a labelled one, in eight bits for each of these, so that few other texts are shuffled."""
    size = 1 << min(FILTER_BITS.bit_length() - 1, max(10, (8 * n - 1).bit_length()))
    bit = F.pmod(F.col("h"), F.lit(size))
    words = one.select(bit.alias("b")).groupBy(F.expr("b div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("b")).toArrow()
    table = np.zeros(size // 64, np.int64)
    table[words["w"].to_numpy()] = words["b"].to_numpy()
    shared = shipped(rows.sparkSession, table)

    def run(batches):
        table = shared()
        for b in batches:
            at = b.column(3).to_numpy()
            yield b.filter(pa.array((table[at >> 6] >> (at & 63)) & 1 == 1)).select(["i", "text", "lang"])

    return small_batches(rows).withColumn("h", F.pmod(F.xxhash64("i"), F.lit(size))).mapInArrow(tidy(run), rows.schema)


def fit_shards(rows: DataFrame, one: DataFrame, n: int, epochs: int = 8, seed: int = 7) -> Model | None:
    """Trains on all labelled rows, in shards; rows: i, text, lang; one: h, i, k, t of the n labelled ones."""
    spark = rows.sparkSession
    chosen = one.select("h", "i", F.col("k").alias("of"), "t", (F.pmod(F.xxhash64(F.lit(seed), "i"), F.lit(4)) == 0).alias("out"))
    parts = max(-(-n // SHARD_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))  # with fewer, Spark would shuffle again
    both = _maybe_labelled(rows, one, n).repartition(parts, "i").join(chosen.repartition(parts, "i"), "i").filter(F.xxhash64("text", "lang") == F.col("of"))
    both = both.sortWithinPartitions("h", "i").select("i", "text", "lang", "t", "out")
    tokens = keep(small_batches(both).mapInArrow(tidy(_tokens), "lang string, t int, out boolean, words binary, shard int"), "tokens")
    counts = {(r["out"], r["t"] > 0): r["n"] for r in tokens.groupBy("out", "t").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sum(v for (_, t), v in counts.items() if t) or not sum(v for (_, t), v in counts.items() if not t):
        forget(tokens)
        return None
    few = min(counts.get((out, t), 0) for out in (False, True) for t in (False, True)) < MIN_POSITIVES  # too few to keep any out
    weight = _weight_of(*(sum(counts.get((out, t), 0) for out in ((False, True) if few else (False,))) for t in (True, False)))
    model = _untrained(seed)
    for epoch in range(epochs):
        shared = shipped(spark, model)

        def run(batches, shared=shared, epoch=epoch):
            model, start = shared(), shared()
            trainer, changed, rows, shard = _Trainer(model, weight), np.zeros(BUCKETS, bool), 0, 0
            for piece, b in enumerate(batches):
                if not few:
                    b = b.filter(pc.invert(b.column(2)))
                if not b.num_rows:
                    continue
                shard = b.column(4)[0].as_py()
                whole, head, offsets = _flat(b.column(3))
                usable = np.flatnonzero(np.diff(offsets) > 0)
                np.random.default_rng([seed, epoch, shard, piece]).shuffle(usable)
                toxic = b.column(1).to_numpy()
                for lo in range(0, len(usable), STEP):
                    changed[trainer.step(usable[lo : lo + STEP], whole, head, offsets, toxic)] = True
                rows += len(usable)
            which = np.flatnonzero(changed).astype(np.int32)
            small = np.concatenate([(x - y).ravel() for x, y in zip(_small(model), _small(start))]).astype(np.float32)
            if rows:
                yield pa.RecordBatch.from_pydict({"rows": [rows], "which": [which.tobytes()], "learnt": [(model.table[which] - start.table[which]).tobytes()], "small": [small.tobytes()]})

        learnt = keep(small_batches(tokens).mapInArrow(tidy(run), "rows long, which binary, learnt binary, small binary"), "learnt")
        total, weights = np.zeros((BUCKETS, DIM), np.float64), np.zeros(BUCKETS)
        small, trained = 0.0, 0
        for r in learnt.toLocalIterator():  # one at a time
            which = np.frombuffer(r["which"], np.int32)
            total[which] += r["rows"] * np.frombuffer(r["learnt"], np.float32).reshape(-1, DIM)
            weights[which] += r["rows"]
            small = small + r["rows"] * np.frombuffer(r["small"], np.float32).astype(np.float64)
            trained += r["rows"]
        forget(learnt)
        if not trained:
            break
        model.table += (total / np.maximum(weights, 1)[:, None]).astype(np.float32)
        at = 0
        for x in _small(model)[:-1]:
            x += (small[at : at + x.size] / trained).reshape(x.shape).astype(np.float32)
            at += x.size
        model.out_bias += float(small[at] / trained)

    shared = shipped(spark, model)

    def score(batches):
        model = shared()
        for b in batches:
            if not few:
                b = b.filter(b.column(2))
            if b.num_rows:
                whole, head, offsets = _flat(b.column(3))
                distinct, idx = np.unique(whole.astype(np.int64) << 32 | head, return_inverse=True)
                p = _scored(model, distinct >> 32, distinct & 0xFFFFFFFF, idx, offsets) if len(whole) else np.zeros(b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p)], names=["lang", "t", "p"])

    scored = keep(small_batches(tokens).mapInArrow(tidy(score), "lang string, t int, p double"), "scored")
    model.thresholds, model.default = thresholds(scored)
    forget(scored, tokens)
    give_back()
    return model


def _small(model: Model) -> list[np.ndarray]:
    """All that is learnt but the table; the last is a copy."""
    return [*model.filters, *model.bias, model.out, np.full(1, model.out_bias)]


def thresholds(scored: DataFrame) -> tuple[dict[str | None, float], float]:
    """What _threshold() gives for each language that has rows enough of both kinds, and for all rows; scored: lang, t, p."""
    each = scored.select(F.lit(True).alias("own"), "lang", "t", "p").unionByName(scored.select(F.lit(False).alias("own"), F.lit(None).cast("string").alias("lang"), "t", "p"))
    whole = Window.partitionBy("own", "lang")
    down = whole.orderBy(F.desc("p"))
    points = each.groupBy("own", "lang", "p").agg(F.sum("t").alias("y"), F.count(F.lit(1)).alias("n"))
    points = points.select("own", "lang", F.sum("y").over(down).alias("tp"), F.sum("n").over(down).alias("k"), F.sum("y").over(whole).alias("y"), F.sum("n").over(whole).alias("n"), ((F.col("p") + F.coalesce(F.lead("p").over(down), F.lit(0.0))) / 2).alias("at"))
    best = points.groupBy("own", "lang", "y", "n").agg(F.max_by("at", F.struct(2 * F.col("tp") / (F.col("k") + F.col("y")), "k")).alias("at")).collect()
    enough = {r["lang"]: r["at"] for r in best if r["own"] and r["y"] >= MIN_POSITIVES and r["n"] - r["y"] >= MIN_POSITIVES}
    return enough, next(r["at"] for r in best if not r["own"])


def _judge(model: Model, batch: pa.RecordBatch, text_col: str, lang_col: str) -> tuple[np.ndarray, np.ndarray]:
    p = scores(model, texts_of(batch.column(batch.schema.get_field_index(text_col))))
    langs = batch.column(batch.schema.get_field_index(lang_col)).to_pylist()
    limit = np.asarray([model.thresholds.get(x, model.default) for x in langs])
    return p, (p > limit) & (p > 0)


def toxic_documents(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents found toxic: id, lang, score, toxic (always true)."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = shipped(docs.sparkSession, model)  # 8 MB, whatever the corpus

    def run(batches):
        model = shared()
        for b in batches:
            if model is not None and b.num_rows:
                p, bad = _judge(model, b, "text", "lang")
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(p), pa.array(bad)], names=[id_col, "lang", "score", "toxic"]).filter(pa.array(bad))

    return small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(tidy(run), f"`{id_col}` {kind}, lang string, score double, toxic boolean")


def reject_toxic(docs: DataFrame, model: Model | None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the toxic ones; all columns as they were, no shuffle."""
    shared = shipped(docs.sparkSession, model)

    def run(batches):
        model = shared()
        for b in batches:
            yield b.filter(pa.array(~_judge(model, b, text_col, lang_col)[1])) if model is not None and b.num_rows else b

    return small_batches(docs).mapInArrow(tidy(run), docs.schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_toxic(docs, fit(docs, documents(spark, sf_dir, "labels")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All toxic documents of the table."""
    docs = documents(spark, sf_dir)
    return toxic_documents(docs, fit(docs, documents(spark, sf_dir, "labels")))


QUERY, SQL = "op8_toxicity", None
