"""Operator 1: text of web pages without what their host's pages share.

Markup is taken off, the words of a host's pages are put on end, each page closed by a
mark of its own, and the suffix array of that stream is built to the depth that matters:
suffixes are ranked by their first 1, 2, 4, ... words (prefix doubling) up to `MIN_WORDS`.
Neighbours in the array of equal rank are occurrences of one string of that length; where
they lie on two or more pages, the words they cover are boilerplate on each.  Any longer
repeat is the union of such strings, so what remains are the runs unique to a page.

Plan: one shuffle, of the plain text by host.  A host of more than `BLOCK_CHARS` of
markup, which one task couldn't hold, is dealt to blocks by hash of the page.  Each block
has its suffix array; fingerprints (64 bits) of the strings are made where the pages lie,
sent as packed lists by slices of their range, and those found in several blocks go to
these, so that the result is the same as from one array.  Hosts that fit take no part in that exchange.

Markup: comments go, and script, style, noscript, template, textarea, title, svg and
iframe elements with what is in them.  Where such an element isn't closed, a script or
style takes the rest of the page with it, as in browsers; of the others only the tag
goes, as of an svg that closes itself.  Names that only begin alike are other elements.

Defined results: null and empty pages give empty text; a page whose host can't be read
belongs to the host ''; rows of one page id are one page when repeats are counted, and
are each returned; null ids are one page; a string repeated within one page only stays;
pages shorter than `MIN_WORDS` are kept whole; if all is covered the text is empty; an
empty table gives no rows; very long pages are handled whole; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolattice.llm._store import documents, keep, small_batches
from geolattice.llm._text import hash_words, slices, texts_of, tidy

MIN_WORDS, BLOCK_CHARS = 10, 128_000_000

_ATTRIBUTES = r"""(?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+"""
_INLINE = re.compile(rf"(?i)</?(?:a|abbr|b|bdi|bdo|cite|code|em|font|i|kbd|mark|q|s|small|span|strong|sub|sup|u|var|wbr)(?:\s{_ATTRIBUTES})?>")
_TAG = re.compile(rf"<[!/?a-zA-Z]{_ATTRIBUTES}>|<[!/?a-zA-Z][^<>]*+>")


_HIDDEN = "script|style|noscript|template|textarea|title|svg|iframe"
_OPEN = re.compile(rf"(?i)<!--|<({_HIDDEN})(?=[\s/>])(?:{_ATTRIBUTES}>|[^>]*+>|[^>]*+\Z)")
_CLOSE = {name: re.compile(rf"(?i)</{name}(?=[\s/>])[^>]*+>") for name in _HIDDEN.split("|")}


def shown(page: str) -> str:
    """The page without comments and elements that hold no text to read; one walk through it."""
    out, pos, unclosed = [], 0, set()
    while m := _OPEN.search(page, pos):
        out += [page[pos : m.start()], " "]
        name = (m.group(1) or "").lower()
        pos = m.end()
        if not name:
            end = page.find("-->", pos)
            pos = end + 3 if end >= 0 else len(page)
        elif name not in unclosed and not (name == "svg" and m.group().endswith("/>")):
            if close := _CLOSE[name].search(page, pos):
                pos = close.end()
            elif name in ("script", "style"):
                pos = len(page)
            else:
                unclosed.add(name)
    return "".join([*out, page[pos:]])


def plain(page: str) -> str:
    """Words of a page in reading order, parted by single blanks."""
    x = _TAG.sub(" ", _INLINE.sub("", shown(page)))
    return " ".join(html.unescape(x).split())


def windows(tokens: np.ndarray, width: int) -> np.ndarray:
    """Rank of the string of `width` words at each place; equal ranks mean equal strings, and order is that of the suffix array.

    tokens end with marks that occur nowhere else, so strings that pass an end are unique.
    """
    rank, depth = tokens, 1
    while depth < width:
        step = min(depth, width - depth)
        key = rank.astype(np.int64)
        key *= int(rank.max()) + 2
        key[: max(0, len(key) - step)] += rank[step:] + 1  # 0 is what lies beyond the end
        order = np.argsort(key, kind="stable")
        key = key[order]
        place = np.zeros(len(key), np.int32)
        np.cumsum(key[1:] != key[:-1], out=place[1:])
        rank = np.empty(len(key), np.int32)
        rank[order] = place
        depth += step
    return rank


def covered(tokens: np.ndarray, row: np.ndarray, page: np.ndarray, inside: np.ndarray, width: int, elsewhere: np.ndarray | None = None) -> np.ndarray:
    """Which words lie in a string of `width` words that stands on two pages, or whose place is marked in elsewhere; row: of each word, page: of each row."""
    rank = windows(tokens, width)
    order = np.argsort(rank, kind="stable").astype(np.uint32)  # the suffix array
    r = rank[order]
    del rank
    starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    del r
    p = page[row[order]]
    shared = np.minimum.reduceat(p, starts) != np.maximum.reduceat(p, starts)
    begin = np.zeros(len(tokens), bool)
    begin[order] = np.repeat(shared, np.diff(np.append(starts, len(p))))
    del order, p
    if elsewhere is not None:
        begin |= elsewhere
    begin &= inside
    edge = np.zeros(len(tokens) + width + 1, np.int32)
    at = np.flatnonzero(begin)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge)[: len(tokens)] > 0


class Stream:
    """Pages on end: word numbers, each page closed by a mark of its own, and the row of each place.

    Texts are split some at a time, so that the words are never all in memory as text.
    """

    def __init__(self, texts: pa.ChunkedArray, page_key: np.ndarray, width: int):
        flats, sizes = [], [np.zeros(0, np.int64)]
        for chunk in texts.chunks:
            for start, stop in slices(texts_of(chunk), 4_000_000):
                split = pc.split_pattern(texts_of(chunk.slice(start, stop - start)), " ")
                flats.append(split.flatten().cast(pa.string()).dictionary_encode())
                sizes.append(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
        size = self.size = np.concatenate(sizes)
        flat = pa.chunked_array(flats, pa.dictionary(pa.int32(), pa.string())).unify_dictionaries()
        self.words = flat.chunk(0).dictionary if flat.num_chunks else pa.array([], pa.string())
        for c in flat.chunks:
            self.words = c.dictionary if len(c.dictionary) > len(self.words) else self.words
        self.starts = np.concatenate([[0], np.cumsum(size + 1)])  # a mark after each page
        mark = self.starts[1:] - 1
        self.row = np.repeat(np.arange(len(size), dtype=np.int32), size + 1)
        self.word = np.ones(len(self.row), bool)
        self.word[mark] = False
        self.tokens = np.empty(self.starts[-1], np.int32)
        self.tokens[mark] = len(self.words) + np.arange(len(size))
        at = 0
        places = np.flatnonzero(self.word)
        for c in flat.chunks:
            self.tokens[places[at : at + len(c)]] = c.indices.to_numpy(zero_copy_only=False)
            at += len(c)
        self.page = np.unique(page_key, return_inverse=True)[1].astype(np.int32) if len(size) else np.zeros(0, np.int32)
        edge = np.zeros(len(self.row) + 1, np.int8)  # where a string of `width` words begins that its page holds
        np.add.at(edge, self.starts[:-1], 1)
        np.add.at(edge, np.maximum(self.starts[:-1], mark - width + 1), -1)
        self.inside = np.cumsum(edge[:-1], dtype=np.int8) > 0

    def prints(self, width: int) -> np.ndarray:
        """64-bit fingerprint of the string at each place."""
        h = np.append(hash_words(self.words), np.zeros(len(self.size), np.uint64))[self.tokens]
        out = np.zeros(len(h), np.uint64)
        for j in range(width):
            out[: len(h) - j] += h[j:] * np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64))
        out ^= out >> np.uint64(32)
        return out

    def kept(self, gone: np.ndarray) -> tuple[pa.ChunkedArray, np.ndarray]:
        """Each row's words that aren't gone, and their number."""
        stays = self.word & ~gone
        n = np.bincount(self.row[stays], minlength=len(self.size)).astype(np.int64)
        ends, parts, at = np.concatenate([[0], np.cumsum(n)]), [], 0
        left = self.tokens[stays]
        while at < len(n):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + 500_000, side="right")) - 1)
            lists = pa.ListArray.from_arrays(pa.array(ends[at : stop + 1] - ends[at], pa.int32()), self.words.take(pa.array(left[ends[at] : ends[stop]])))
            parts.append(pc.binary_join(lists, pa.scalar(" ", pa.string())))
            at = stop
        return pa.chunked_array(parts, pa.string()), n


def packed(sorted_prints: np.ndarray) -> bytes:
    """Ascending fingerprints as differences, each in as few bytes as the largest takes."""
    step = np.diff(sorted_prints, prepend=np.uint64(0))
    width = max(1, (int(step.max()).bit_length() + 7) // 8)
    return bytes([width]) + step.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    out = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(out.reshape(-1).view(np.uint64), dtype=np.uint64)


def _blocks(pages: DataFrame, block_chars: int, url_col: str, html_col: str) -> DataFrame:
    """host, blocks of hosts too large for one task."""
    sizes = pages.groupBy(_host(F.col(url_col)).alias("host")).agg(F.sum(F.length(html_col)).alias("chars"))
    return sizes.filter(F.col("chars") > block_chars).select("host", F.ceil(F.col("chars") / block_chars).cast("int").alias("blocks"))


#: Fingerprints that a task looks through for those of several blocks, about.
SLICE_PRINTS = 2_000_000


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def unique_text(pages: DataFrame, min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, host, text (the runs unique to the page), n_words, n_kept of every page."""
    kind = pages.schema[id_col].dataType.simpleString()
    large = keep(_blocks(pages, block_chars, url_col, html_col), "large-hosts")
    rows = small_batches(pages).select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("page_key"), _host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    rows = rows.join(large, "host", "left").withColumn("block", F.pmod("page_key", F.coalesce("blocks", F.lit(1)).cast("long"))).select("id", "page_key", "host", "block", F.col("blocks").isNotNull().alias("split"), "html")

    def strip(batches):
        for b in batches:
            text = [plain(x) if x else "" for x in b.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.array(text, pa.large_string()).cast(pa.string())], names=["id", "page_key", "host", "block", "split", "text"])

    texts = rows.mapInArrow(tidy(strip), f"id {kind}, page_key long, host string, block long, split boolean, text string")
    blocks = large.agg(F.sum("blocks")).first()[0] or 0
    split_hosts = blocks > 0

    def runs(table: pa.Table, known: np.ndarray | None) -> pa.Table:
        s = Stream(table.column("text"), table.column("page_key").to_numpy(), min_words)
        elsewhere = np.isin(s.prints(min_words), known) if known is not None and len(known) else None
        gone = covered(s.tokens, s.row, s.page, s.inside, min_words, elsewhere) if len(s.tokens) else np.zeros(0, bool)
        text, kept = s.kept(gone)
        blank = pc.equal(table.column("text"), "").to_numpy()
        return pa.table({id_col: table.column("id"), "host": table.column("host"), "text": text, "n_words": pa.array(np.where(blank, 0, s.size), pa.int64()), "n_kept": pa.array(np.where(blank, 0, kept), pa.int64())})

    schema = f"`{id_col}` {kind}, host string, text string, n_words long, n_kept long"
    whole = (texts.filter("not split") if split_hosts else texts).groupBy("host", "block").applyInArrow(lambda table: runs(table, None), schema)
    if not split_hosts:
        return whole

    bits = min(24, max(3, math.ceil(math.log2(max(1, blocks) * block_chars / 5 / SLICE_PRINTS))))  # words have five letters and more

    def prints(batches):
        """A block's strings by slices of their fingerprints, those of a host apart from those of others."""
        for b in batches:
            if not b.num_rows:
                continue
            s = Stream(pa.chunked_array([b.column(2)]), b.column(1).to_numpy(), min_words)
            at = np.flatnonzero(s.inside)
            row = s.row[at]
            own, slots, inverse = s.prints(min_words)[at] ^ b.column(3).to_numpy().view(np.uint64)[row], *np.unique(b.column(0).to_numpy(), return_inverse=True)
            slot, out = inverse[row], []
            for k in range(len(slots)):
                fp = np.unique(own[slot == k])
                part = fp >> np.uint64(64 - bits)
                starts = np.flatnonzero(np.diff(part, prepend=~part[:1]))
                out += [(int(part[i]), int(slots[k]), packed(fp[i:j])) for i, j in zip(starts, [*starts[1:], len(fp)])]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else ([], [], []), (pa.int64(), pa.int64(), pa.binary()))], names=["part", "slot", "fps"])

    def repeated(table: pa.Table) -> pa.Table:
        """Of a slice, the fingerprints that several blocks have, for each of these."""
        lists = [unpacked(x) for x in table.column("fps").to_pylist()]
        slots, which = np.unique(table.column("slot").to_numpy(), return_inverse=True)
        slot, fp = np.repeat(which, [len(x) for x in lists]), np.concatenate(lists)
        order = np.argsort(fp, kind="stable")
        fp, slot = fp[order], slot[order]
        starts = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
        many = np.repeat(np.minimum.reduceat(slot, starts) != np.maximum.reduceat(slot, starts), np.diff(np.append(starts, len(fp))))
        fp, slot = fp[many], slot[many]
        out = [(int(slots[k]), packed(np.unique(fp[slot == k]))) for k in np.unique(slot)]
        return pa.table({"slot": pa.array([x for x, _ in out], pa.int64()), "fps": pa.array([x for _, x in out], pa.binary())})

    parts = texts.filter("split").withColumn("slot", F.xxhash64("host", "block")).withColumn("host_key", F.xxhash64("host"))
    found = parts.select("slot", "page_key", "text", "host_key").mapInArrow(tidy(prints), "part long, slot long, fps binary")
    shared = found.groupBy("part").applyInArrow(repeated, "slot long, fps binary")

    def among(table: pa.Table, known: pa.Table) -> pa.Table:
        key = np.uint64(table.column("host_key")[0].as_py() & 0xFFFFFFFFFFFFFFFF) if table.num_rows else np.uint64(0)
        return runs(table, np.concatenate([np.zeros(0, np.uint64), *map(unpacked, known.column("fps").to_pylist())]) ^ key)

    return whole.unionByName(parts.groupBy("slot").cogroup(shared.groupBy("slot")).applyInArrow(among, schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique text of every page of the table."""
    return unique_text(documents(spark, sf_dir, "pages"))


QUERY, SQL = "op1_html_extraction", None
