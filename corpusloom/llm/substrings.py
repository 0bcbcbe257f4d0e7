"""Substring dedup: maximal repeats of at least `window` words, from prefix-partitioned suffix subtrees.

A suffix starts at every word of a document. Suffixes are split into groups by variable-length prefixes, a suffix tree is built
of each group, and its deep internal nodes, those of at least `window` words, are the repeats.

Partitioning: within its first `window` words a suffix has one anchor, the ANCHOR words with the smallest hash (the leftmost of
equals). Its prefix runs from its start to the anchor's end and so is of variable length; suffixes that share a deep node have
equal prefixes and meet in the group of their anchor. Consecutive suffixes mostly share the anchor (about 18 of them) and travel as
one row, a run: anchor, document, place, and a 64-bit label of the first `window` words of each suffix. All consecutive suffixes
of equal anchors are one run, so a text that repeats a few words is one row too. A label holds only together with its anchor's
hash, 128 bits of two independent polynomials of 64-bit word hashes.

Memory-sized groups: anchors are counted first; one with more than a ten-thousandth of all runs is split further, by the
deep node itself (the longest prefix), into as many groups as its count asks for. At most ten thousand anchors can be so
frequent, which bounds what is shipped to the tasks. A group is streamed, sorted, so none is held beyond its own size.

Subtrees: a suffix of a group is the string of labels from its place to its run's end; equal first labels are `window` equal words,
each further equal label one word more. Runs that many documents have alike are one string, held by the smallest id. The
strings' suffixes are sorted by prefix doubling; neighbours' common prefixes are the tree's internal nodes, whose depth is in
words. For each suffix the deepest node that a suffix of an earlier document passes through gives its longest earlier match; those
that are not the rest of the match before are the maximal repeats, with the earlier document. A match that goes beyond the run's
end goes on in the next run's group, and both are one span in the end.

Removal: a word covered by a window whose node also has a suffix in a document with a smaller id. Judged on the input.
Null text: no words. Rows without an id are never smaller than others and keep their words. Rows that repeat an id do
not count against each other. An empty table gives an empty result. Only the named id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import map_rows, materialize, texts, utf8

WINDOW = 50
ANCHOR = 16
#: An anchor with more than this share of all rows, and more rows than LEAST, is split by deep node.
SHARE, LEAST = 1e-4, 2000
_B1, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; kept, and doubled when a longer text comes."""
    out = _POWERS.get(base, np.ones(1, np.uint64))
    while len(out) < n:  # base**(done + i) = base**done * base**i
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    _POWERS[base] = out
    return out[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolling(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """A hash of each run of size elements."""
    n = len(h) - size + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(base, len(h)), dtype=np.uint64)])
    inverse = _powers(pow(base, -1, 1 << 64), n)
    return _mix((sums[size:] - sums[:n]) * inverse)


def _argmin_windows(v: np.ndarray, width: int) -> np.ndarray:
    """For each window of so many values the place of its smallest, the leftmost of equals."""
    at, best, have = np.arange(len(v)), v, 1
    while have < width:
        step = min(have, width - have)
        left, right = best[: len(best) - step], best[step:]
        take = right < left
        best, at, have = np.where(take, right, left), np.where(take, at[step:], at[: len(at) - step]), have + step
    return at


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def suffixes(data: bytes, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each suffix with `window` words: its anchor's hash, the label of its first `window` words."""
    words = data.split()
    if len(words) < window:
        return (np.empty(0, np.uint64),) * 2
    h = word_hashes(words)
    anchors = _rolling(h, anchor, _B1)
    return anchors[_argmin_windows(anchors, window - anchor + 1)], _rolling(h, window, _B2)


def _signed(x: np.ndarray) -> list[int]:
    return x.astype(np.int64).tolist()


def _runs(anchors: np.ndarray) -> list[tuple[int, int]]:
    """Where consecutive suffixes have equal anchors: first, end."""
    cut = (np.flatnonzero(anchors[1:] != anchors[:-1]) + 1).tolist()
    return list(zip([0, *cut], [*cut, len(anchors)]))


def _count_rows(rows: Iterator[tuple], window: int, anchor: int) -> Iterator[tuple]:
    for _, _, data in rows:
        a, _ = suffixes(data, window, anchor)
        if len(a):
            for v in _signed(a[[s for s, _ in _runs(a)]]):
                yield (v,)


def _suffix_rows(rows: Iterator[tuple], hot: dict[int, int], window: int, anchor: int) -> Iterator[tuple]:
    """anchor, group, doc_id, row, start, labels, starts: runs of suffixes; those of a split anchor lie apart."""
    for key, row, data in rows:
        a, label = suffixes(data, window, anchor)
        if not len(a):
            continue
        runs = _runs(a)
        for (s, e), v in zip(runs, _signed(a[[s for s, _ in runs]])):
            if (parts := hot.get(v)) is None:
                yield v, 0, key, row, s, label[s:e].tobytes(), None
                continue
            home = (_mix(label[s:e]) % np.uint64(parts)).astype(np.int64)
            for g in np.unique(home).tolist():
                own = np.flatnonzero(home == g) + s
                yield v, g, key, row, -1, label[own].tobytes(), own.astype("<u4").tobytes()


class Subtree:
    """The suffix tree of a group's strings of labels, as its sorted suffixes and the common prefixes of neighbours."""

    def __init__(self, strings: list[np.ndarray], window: int):
        self.window = window
        sizes = np.array([len(x) for x in strings])
        self.string = np.repeat(np.arange(len(strings)), sizes)  # of each suffix
        self.begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        n = len(self.string)
        rest = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # labels up to the string's end
        rank = np.unique(np.concatenate(strings), return_inverse=True)[1].astype(np.int64)
        ranks, step = [rank], 1
        while step < sizes.max() and len(np.unique(rank)) < n:
            after = np.full(n, -1, np.int64)
            on = rest > step
            after[on] = rank[np.flatnonzero(on) + step]
            rank = np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
            ranks.append(rank)
            step *= 2
        self.order = np.argsort(rank, kind="stable")
        a, b = self.order[:-1], self.order[1:]
        self.common = np.zeros(max(0, n - 1), np.int64)  # labels that neighbours in the order share
        for k in range(len(ranks) - 1, -1, -1):
            size = 1 << k
            both = np.flatnonzero((rest[a] >= self.common + size) & (rest[b] >= self.common + size))
            same = both[ranks[k][a[both] + self.common[both]] == ranks[k][b[both] + self.common[both]]]
            self.common[same] += size
        self.rest = rest

    def nodes(self) -> list[tuple[int, list[tuple[int, int]]]]:
        """Deep internal nodes: depth in words, and the (string, place) of each suffix that passes through."""
        out, open_nodes = [], []  # of those open: depth in labels, first place in the order
        common = [*self.common.tolist(), 0]
        for i, depth in enumerate(common):
            first = i
            while open_nodes and open_nodes[-1][0] > depth:
                labels, first = open_nodes.pop()
                own = self.order[first : i + 1]
                out.append((labels + self.window - 1, sorted((int(self.string[x]), int(x - self.begin[self.string[x]])) for x in own)))
            if depth and (not open_nodes or open_nodes[-1][0] < depth):
                open_nodes.append((depth, first))
        return out

    def earlier_matches(self, holders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each suffix: labels of the deepest node that a suffix of a string with a smaller holder passes through (0: none), and the smallest such holder."""
        n = len(self.string)
        depth, earlier = np.zeros(n, np.int64), np.zeros(n, np.int64)
        order, common, own = self.order.tolist(), self.common.tolist(), holders[self.string]
        for places, gaps in ((range(n), [0, *common]), (range(n - 1, -1, -1), [*common, 0])):
            stack: list[tuple[int, int]] = []  # (holder, labels shared from there to here), holders increasing
            for i in places:
                shared, mine = gaps[i], int(own[order[i]])
                if not shared:
                    stack = []
                elif stack:
                    stack = [(h, min(d, shared)) for h, d in stack] if stack[-1][1] > shared else stack
                    while stack and stack[-1][0] >= mine:
                        stack.pop()
                    if stack:
                        deepest = stack[-1][1]
                        holder = next(h for h, d in stack if d == deepest)
                        if (-deepest, holder) < (-depth[order[i]], earlier[order[i]]):
                            depth[order[i]], earlier[order[i]] = deepest, holder
                stack.append((mine, self.rest[order[i]]))
        return depth, earlier


def _pieces(row: tuple) -> Iterator[tuple[int, bytes]]:
    """(start, labels) of the consecutive suffixes of a row."""
    if row[6] is None:
        yield row[4], row[5]
        return
    starts = np.frombuffer(row[6], "<u4").astype(np.int64)
    cut = (np.flatnonzero(np.diff(starts) > 1) + 1).tolist()
    for s, e in zip([0, *cut], [*cut, len(starts)]):
        yield int(starts[s]), row[5][8 * s : 8 * e]


def _subtree(rows: list[tuple], window: int) -> Iterator[tuple]:
    """One group: doc_id, row, first and last suffix of each maximal repeat of an earlier document, and that document."""
    if len({r[2] for r in rows}) < 2:
        return
    least: dict[bytes, int] = {}
    pieces = [(r[2], r[3], start, labels) for r in rows for start, labels in _pieces(r)]
    for key, _, _, labels in pieces:
        least[labels] = min(least.get(labels, key), key)
    tree = {}
    strings = [np.frombuffer(x, "<u8") for x in least]
    if len(strings) > 1:
        found = Subtree(strings, window)
        depth, earlier = found.earlier_matches(np.array(list(least.values()), np.int64))
        fresh = depth > 0  # not the rest of the match before
        inner = np.flatnonzero(found.string[1:] == found.string[:-1]) + 1
        fresh[inner] &= depth[inner] >= depth[inner - 1]
        names = list(least)
        for x in np.flatnonzero(fresh).tolist():
            at = int(x - found.begin[found.string[x]])
            tree.setdefault(names[found.string[x]], []).append((at, at + int(depth[x]) - 1, int(earlier[x])))
    for key, row, start, labels in pieces:
        if least[labels] < key:  # an earlier document has the whole run
            yield key, row, start, start + len(labels) // 8 - 1, least[labels]
        else:
            for first, last, other in tree.get(labels, ()):
                yield key, row, start + first, start + last, other


def _groups(rows: Iterator[tuple], window: int) -> Iterator[tuple]:
    held: list[tuple] = []
    for r in rows:
        if held and (r[0], r[1]) != (held[0][0], held[0][1]):
            yield from _subtree(held, window)
            held = []
        held.append(r)
    if held:
        yield from _subtree(held, window)


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """docs: doc_id, row, data. doc_id, row, first, last, earlier: the suffixes that begin a window of a maximal repeat (as far as one group's runs go) of an earlier document."""
    spark = docs.sparkSession
    source = docs.where("doc_id is not null")
    counts = map_rows(source, lambda x: _count_rows(x, window, anchor), "anchor long", pa.schema([("anchor", pa.int64())]), 1 << 16).groupBy("anchor").agg(F.count("*").alias("n"))
    frequent = materialize(counts.where(F.col("n") > LEAST), "substring-frequent")
    total = frequent.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # rows of anchors under LEAST are left out of the total here: the limit is then lower than a ten-thousandth of all
    limit = max(LEAST, int(total * SHARE))
    hot = {r["anchor"]: -(-r["n"] // limit) * 2 for r in frequent.where(F.col("n") > limit).collect()}
    shipped = spark.sparkContext.broadcast(hot)  # at most 1 / SHARE entries
    rows = map_rows(
        source,
        lambda x: _suffix_rows(x, shipped.value, window, anchor),
        "anchor long, part int, doc_id long, row long, start int, labels binary, starts binary",
        pa.schema([("anchor", pa.int64()), ("part", pa.int32()), ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("labels", pa.binary()), ("starts", pa.binary())]),
    )
    together = rows.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("earlier", pa.int64())])
    return map_rows(together, lambda x: _groups(x, window), "doc_id long, row long, first int, last int, earlier long", schema)


def maximal(ranges: list[tuple[int, int, int]], window: int) -> list[tuple[int, int, int]]:
    """(start, end, earlier document) of the repeats in words; parts of one document that touch are one."""
    out: list[list[int]] = []
    for earlier, first, last in sorted((e, f, n) for f, n, e in ranges):
        if out and out[-1][2] == earlier and first <= out[-1][1] - window + 1:
            out[-1][1] = max(out[-1][1], last + window)
        else:
            out.append([first, last + window, earlier])
    return sorted(map(tuple, out))


def kept_words(words: list[bytes], ranges: list[tuple[int, int]], window: int) -> tuple[list[bytes], list[tuple[int, int]]]:
    """The words outside the ranges' windows, and the removed spans [start, end)."""
    spans: list[list[int]] = []
    for s, e in sorted(ranges):
        if spans and s <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], e + window)
        else:
            spans.append([s, e + window])
    out, at = [], 0
    for s, e in spans:
        out += words[at:s]
        at = e
    return out + words[at:], [(s, e) for s, e in spans]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (start, end of removed runs, in words), repeats (start, end, earlier), with_text also kept_text.

    repeats: maximal stretches that an earlier document is known to hold; of several such documents one that the match goes farthest with.
    window must be at least anchor.
    """
    if not 0 < anchor <= window:
        raise ValueError("an anchor lies within the window")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("data")).withColumn("row", F.xxhash64("data")).select("doc_id", "row", "data")
    found = repeats(source, window, anchor).groupBy("doc_id", "row").agg(F.collect_set(F.struct("first", "last", "earlier")).alias("ranges"))
    joined = source.join(materialize(found, "substring-ranges").hint("merge"), ["doc_id", "row"], "left").select("doc_id", "data", "ranges")

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, data, ranges in rows:
            words, ranges = data.split(), [(r["first"], r["last"], r["earlier"]) for r in ranges or []]
            kept, spans = kept_words(words, [r[:2] for r in ranges], window)
            text = b" ".join(kept)
            held = [{"start": s, "end": e, "earlier": d} for s, e, d in maximal(ranges, window)]
            out = key, len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), [{"start": s, "end": e} for s, e in spans], held
            yield (*out, text.decode("utf-8", "replace")) if with_text else out

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    repeat = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("earlier", pa.int64())]))
    arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", span), ("repeats", repeat)] + [("kept_text", pa.string())] * with_text)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>, repeats array<struct<start:bigint,end:bigint,earlier:bigint>>"
    return map_rows(joined, each, schema + ", kept_text string" * with_text, arrow)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(texts(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), w AS (
  SELECT doc_id, s, array_to_string(ws[s:s + 49], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM d)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM (SELECT *, min(doc_id) OVER (PARTITION BY gram) AS earlier FROM w) WHERE earlier < doc_id
), per AS (
  SELECT doc_id, list(i) AS places FROM gone GROUP BY 1
), kept AS (
  SELECT doc_id, len(ws) AS n, coalesce(len(places), 0) AS removed,
         array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda i: places IS NULL OR NOT list_contains(places, i)), lambda i: ws[i]), ' ') AS t
  FROM d LEFT JOIN per USING (doc_id)
)
SELECT doc_id, n::BIGINT AS n_words, removed::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM kept
"""
