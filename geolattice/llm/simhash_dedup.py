"""Operator 7: near copies by SimHash and a Gray-order hierarchical index.

A document's fingerprint has 256 bits: the signs of the sums, over its words, of the
words' hashed +-1 vectors; a word weighs as its length less 3 (0 to 8), since the short
words of a language are those that all its texts share.  Two documents are near copies
if their fingerprints differ in at most `MAX_BITS` bits.

All pairs within `MAX_BITS` are found, at any number of documents.  Of a pair within 52
bits, one of the four 64-bit words differs in at most 13 (the first) or 12 bits, else all
would differ in 53 or more; and so one of that word's parts differs in no more bits than
`allotted` gives it, at most 3.  Words are searched once for each part.

The fingerprints are dealt to shares by a hash, and a task takes one word and two shares,
so that each pair meets once for each word.  One share's words are put under trees, one
for each pattern of the part, in which they are sorted by Gray rank: neighbours share long
bit patterns, and a node of eight holds the bits that all below it share, as mask and
pattern.  The other share's words search them, a block of equal parts at a time, from the
roots of all patterns near enough: a node, with all below it, is dropped if it differs
too much from the bits that the block shares, or once block and node are known to be of
one group; what is left is compared bit by bit.  What comes out is a forest of links, not
all pairs.

Equal fingerprints are one from the start.  Links are joined to groups by distributed
connected components, and the least id of each group stays.  Inside, a fingerprint goes
by a number of its own, so ids may be of any type that has an order.

Defined results: null, empty and wordless texts, and null ids, never have copies and
stay; the rows of one id count as one document and share its fate (its fingerprint is
the least of its rows'); an empty table gives an empty one; other columns are untouched,
whatever their names; very long texts are read whole.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolattice.llm._store import documents, fresh, keep, small_batches
from geolattice.llm._text import encoded, hash_words, reduce_rows, slices, texts_of, tidy, words_of
from geolattice.llm.components import components

MAX_BITS = 52
#: What holds of every near pair: in some word at most so many bits differ, and in a quarter of that word at most so many.
WORD_BITS, FLIPS = MAX_BITS // 4, MAX_BITS // 16
#: Fingerprints of a share, at most about.
INDEX_ROWS = 1_000_000
#: Parts of a word where a share holds fewer fingerprints than this; the choice changes the work, not the result.
PARTS = [(2000, 0), (16_000, 8), (120_000, 6), (600_000, 5), (float("inf"), 4)]
FAN, BLOCK, PIECE = 8, 64, 4096
_SPREAD = np.array([int.from_bytes(bytes((b >> k) & 1 for k in range(8)), "little") for b in range(256)], np.uint64)


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """rows x 4 words of the fingerprint, and the number of words of each text.

    Eight sums of 8 bits are kept in one integer: runs of at most 31 words (of weight up to 8) can't overflow.
    """
    out, size = np.zeros((len(texts), 4), np.uint64), np.zeros(len(texts), np.int64)
    for start, stop in slices(texts, 1_000_000):
        flat, offsets = words_of(texts.slice(start, stop - start))
        size[start:stop] = np.diff(offsets)
        if not len(flat):
            continue
        idx, uniq = encoded(flat)
        h = hash_words(uniq)
        words = np.empty((len(uniq), 4), np.uint64)
        for k, odd in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)):
            x = h * np.uint64(odd)
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            words[:, k] = x ^ (x >> np.uint64(29))
        weight = np.clip(pc.utf8_length(uniq).to_numpy(zero_copy_only=False).astype(np.int64) - 3, 0, 8)
        lanes = _SPREAD[words.view(np.uint8).reshape(len(uniq), 32)] * weight.astype(np.uint64)[:, None]
        if (weight[idx] == 0).any():  # words that weigh nothing are left out, unless a text has no other
            heavy = reduce_rows(np.add, weight[idx], offsets, 0)
            lone = np.repeat(heavy == 0, np.diff(offsets))
            if lone.any():
                lanes = np.concatenate([lanes, _SPREAD[words.view(np.uint8).reshape(len(uniq), 32)]])
                idx = np.where(lone, idx + len(uniq), idx)
                weight = np.concatenate([weight, np.ones(len(uniq), np.int64)])
            own = np.repeat(np.arange(stop - start), np.diff(offsets))
            stays = weight[idx] > 0
            idx = idx[stays]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(own[stays], minlength=stop - start))])
        runs = np.concatenate([np.arange(a, b, 31) for a, b in zip(offsets[:-1], offsets[1:])])
        sums = np.add.reduceat(lanes[idx], runs, axis=0).view(np.uint8).reshape(len(runs), 256).astype(np.int32)
        per = reduce_rows(np.add, sums, np.searchsorted(runs, offsets), 0)
        total = reduce_rows(np.add, weight[idx], offsets, 0)
        bits = 2 * per > total[:, None]
        out[start:stop] = np.packbits(bits.reshape(-1, 256), axis=1, bitorder="little").view(np.uint64)
    return out, size


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, w0..w3 of each document that has an id and words; one row an id."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            fp, size = fingerprints(texts_of(b.column(1)))
            some = np.flatnonzero(size)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), *(pa.array(fp[some, k].view(np.int64)) for k in range(4))], names=["id", "w0", "w1", "w2", "w3"])

    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null").mapInArrow(tidy(run), f"id {kind}, w0 long, w1 long, w2 long, w3 long")
    return rows.groupBy("id").agg(F.min(F.struct("w0", "w1", "w2", "w3")).alias("w")).select("id", "w.*")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a bit pattern in the reflected Gray code."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


class GrayTree:
    """Trees over the words of each key: levels[0] are the roots, the last level the words."""

    def __init__(self, keys: np.ndarray, words: np.ndarray):
        self.order = np.lexsort((gray_rank(words), keys))
        keys, pattern = keys[self.order], words[self.order]
        mask = np.full(len(pattern), 0xFFFFFFFFFFFFFFFF, np.uint64)
        built = [(pattern, mask, None)]
        while len(keys) and (keys[1:] == keys[:-1]).any():
            first = np.concatenate([[True], keys[1:] != keys[:-1]])
            place = np.arange(len(keys)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            starts = np.flatnonzero(place % FAN == 0)
            head = np.repeat(pattern[starts], np.diff(np.append(starts, len(keys))))
            apart = np.bitwise_or.reduceat(pattern ^ head, starts)
            mask = np.bitwise_and.reduceat(mask, starts) & ~apart
            pattern, keys = pattern[starts] & mask, keys[starts]
            built.append((pattern, mask, np.append(starts, len(place))))
        self.keys, self.levels = keys, built[::-1]

    def known(self, labels: np.ndarray) -> None:
        """Notes which nodes hold entries of one label only; merging labels doesn't change that."""
        at = self.order
        low = high = labels[at]
        self.one = [(np.ones(len(at), bool), at)]
        for _, _, starts in self.levels[-2::-1]:
            first = starts[:-1]
            low, high, at = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), at[first]
            self.one.append((low == high, at))
        self.one.reverse()

    def search(self, q: np.ndarray, node: np.ndarray, words: np.ndarray, most: int, labels: np.ndarray, own: np.ndarray, roots=lambda node: np.array([node])):
        """Pairs (index into words, entry) within `most` bits whose labels differ, in pieces; roots: those to start the q of one node at.

        labels, of words, may be merged in place between the pieces; own: place of each
        entry among words.  Fast where q of one node stand together.
        """
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(q) else []
        for a, b in zip(starts, [*starts[1:], len(q)]):
            first = roots(node[a])
            for lo in range(a, b, BLOCK) if len(first) else ():
                mine = q[lo : min(b, lo + BLOCK)]
                near = self._near(mine, first, words, most, labels, own)
                head = labels[mine[len(mine) // 2]]
                alike = labels[mine] == head
                if alike.sum() * 4 < len(mine) or len(mine) == 1:
                    yield from self._compared(mine, near, words, most, labels, own)
                else:  # much of the block is of one group already
                    yield from self._compared(mine[alike], near[labels[own[self.order[near]]] != head], words, most, labels, own)
                    yield from self._compared(mine[~alike], near, words, most, labels, own)

    def _near(self, mine: np.ndarray, node: np.ndarray, words: np.ndarray, most: int, labels: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Places, in Gray order, of the entries under `node` that a word of the block may be near to."""
        pattern = words[mine[0]]
        mask = ~np.bitwise_or.reduce(words[mine] ^ pattern)
        label = labels[mine[0]]
        alike = (labels[mine] == label).all()
        for (below, below_mask, starts), (one, entry) in zip(self.levels[:-1], self.one):
            ok = np.bitwise_count((below[node] ^ pattern) & below_mask[node] & mask) <= most
            if alike:
                ok &= ~one[node] | (labels[own[entry[node]]] != label)
            node = node[ok]
            first = starts[node]
            n = starts[node + 1] - first
            ends = np.cumsum(n)
            node = np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        return node

    def _compared(self, mine: np.ndarray, near: np.ndarray, words: np.ndarray, most: int, labels: np.ndarray, own: np.ndarray):
        for lo in range(0, len(near) if len(mine) else 0, PIECE):
            some = near[lo : lo + PIECE]
            far = np.bitwise_count(words[mine][:, None] ^ self.levels[-1][0][some])
            at = np.flatnonzero(far <= most)
            q, entry = mine[at // len(some)], self.order[some[at % len(some)]]
            apart = labels[q] != labels[own[entry]]
            if apart.any():
                yield q[apart], entry[apart]


def _link(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a with b; each label is an index, the least of its component."""
    a, b = labels[a], labels[b]
    while True:
        apart = a != b
        if not apart.any():
            return labels
        a, b = a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
        a, b = labels[a], labels[b]


def allotted(most: int, parts: int) -> list[int]:
    """Bits for each part, such that of two patterns within `most` bits some part differs in no more than its own; below 0 for none."""
    each, more = divmod(most - parts + 1, parts)
    return [each + (k < more) for k in range(parts)]


def places(n: int, most: int) -> list[tuple[int, int, int]]:
    """Lowest bit, width and greatest difference of each part by which words within `most` bits are searched, in shares of n rows."""
    m = next(m for few, m in PARTS if n < few)
    ends = [-(-64 * k // m) for k in range(m + 1)] if m else []
    return [(a, b - a, t) for a, b, t in zip(ends, ends[1:], allotted(most, m)) if t >= 0] if m else [(0, 0, 0)]


def links(prints: DataFrame, n: int, max_bits: int = MAX_BITS, index_rows: int = INDEX_ROWS) -> DataFrame:
    """a, b: links that join all pairs within max_bits among n distinct fingerprints (id: a long, w0..w3)."""
    deal, budget = max(2, -(-n // index_rows)), allotted(max_bits, 4)
    used = [word for word in range(4) if budget[word] >= 0]

    def share_of(ids: np.ndarray) -> np.ndarray:
        return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % deal

    def send(batches):
        for b in batches:
            mine = share_of(b.column(0).to_numpy(zero_copy_only=False))
            for word in used:
                for k in range(deal):
                    cell = (word * deal + np.minimum(mine, k)) * deal + np.maximum(mine, k)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), *b.columns], names=["cell", "id", "w0", "w1", "w2", "w3"])

    def join(key: tuple, table: pa.Table) -> pa.Table:
        pair, j = divmod(key[0].as_py(), deal)
        word, i = divmod(pair, deal)
        ids = table.column("id").to_numpy()
        fp = np.stack([table.column(f"w{k}").to_numpy().view(np.uint64) for k in range(4)], axis=1)
        mine, labels, words = share_of(ids), np.arange(len(ids)), np.ascontiguousarray(fp[:, word])
        asking, own = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        for low, width, flips in places(max(len(asking), len(own)), budget[word]) if len(asking) and len(own) else ():
            value = ((words >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
            tree = GrayTree(value[own], words[own])
            tree.known(labels[own])
            root = np.full(1 << width, -1)
            root[tree.keys] = np.arange(len(tree.keys))
            reach = np.array([sum(1 << k for k in c) for f in range(flips + 1) for c in combinations(range(width), f)])

            def roots(value: int, root=root, reach=reach) -> np.ndarray:
                first = root[value ^ reach]
                return first[first >= 0]

            q = asking[np.lexsort((gray_rank(words[asking]), value[asking]))]
            found, size = [], 0
            for a, entry in tree.search(q, value[q], words, budget[word], labels, own, roots):
                b = own[entry]
                near = np.bitwise_count(fp[a] ^ fp[b]).sum(1, dtype=np.int64) <= max_bits
                found.append((a[near], b[near]))
                size += int(near.sum())
                if size >= PIECE:
                    labels[:] = _link(labels, *map(np.concatenate, zip(*found)))
                    tree.known(labels[own])
                    found, size = [], 0
            if size:
                labels[:] = _link(labels, *map(np.concatenate, zip(*found)))
        moved = np.flatnonzero(labels != np.arange(len(ids)))
        return pa.table({"a": ids[moved], "b": ids[labels[moved]]})

    sent = prints.select("id", "w0", "w1", "w2", "w3").mapInArrow(send, "cell long, id long, w0 long, w1 long, w2 long, w3 long")
    return sent.groupBy("cell").applyInArrow(join, "a long, b long")


def copies(docs: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text", **search) -> DataFrame:
    """id, root of every document that is a near copy of one with a lower id; root is its group's least id."""
    prints = keep(fingerprint_table(docs, id_col, text_col), "prints")
    words = ["w0", "w1", "w2", "w3"]
    distinct = keep(prints.groupBy(*words).agg(F.min("id").alias("first")).withColumn("number", F.monotonically_increasing_id()), "distinct")
    numbered = distinct.select(F.col("number").alias("id"), *words)
    groups = keep(components(links(numbered, distinct.count(), max_bits, **search)).withColumnRenamed("id", "number"), "groups")
    mine = distinct.join(groups, "number", "left").withColumn("root", F.coalesce("root", "number"))
    least = mine.groupBy("root").agg(F.min("first").alias("least"))
    roots = mine.join(least, "root").select(*words, "least")
    return prints.join(roots, words).select("id", F.col("least").alias("root")).filter("id <> root")


def drop_copies(docs: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near copies, the one of least id."""
    gone = keep(copies(docs, max_bits, id_col, text_col).select("id"), "copies")
    name = fresh(docs.columns, "gone")[0]
    return docs.join(gone.toDF(name), F.col(id_col) == F.col(name), "left_anti")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each near copy with the document of its group that stays."""
    return copies(documents(spark, sf_dir)).toDF("doc_id", "copy_of")


QUERY, SQL = "op7_simhash_dedup", None
