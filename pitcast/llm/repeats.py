"""What the two repeat removers share: sampled suffixes, candidate texts and local comparison of suffixes.

A window is a run of a fixed number of tokens (bytes or words). Of the short token grams inside a window the one with
the smallest hash is its anchor. Equal windows have equal anchors at equal offsets, and neighbouring windows mostly
share theirs, so one record per anchor, with the range of offsets ``lo..hi`` of its windows, stands for all suffixes.
Texts are named by two 64-bit hashes of their content, so copies of a text are examined once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitcast.llm.common import likely, likely_members, stage
from pitcast.llm.tokens import BYTE_VALUES, STEP, column_bytes, grams, hashed_spans, mixed, rolling, slices, word_spans

TEXT_KEY = ["t1", "t2"]
_LOW = np.uint64((1 << 24) - 1)


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, t1, t2, text``: null texts are empty, and the key is 128 bits of content hash."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, from running minima of blocks."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(hashes: np.ndarray, cuts: np.ndarray, gram: int, length: int) -> tuple[np.ndarray, ...]:
    """Rows, anchor positions and offset ranges ``lo, hi`` of the windows in a stream of tokens cut into rows.

    ``hashes`` holds the hash of the gram at each token but the last ``gram - 1``. Positions count from the stream's start.
    """
    n = int(cuts[-1])
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    at = np.arange(len(hashes), dtype=np.uint64)
    chosen = (sliding_min((hashes & ~_LOW) | at, length - gram + 1) & _LOW).astype(np.int64)
    row = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))[: len(chosen)]
    start = np.arange(len(chosen))
    whole = np.flatnonzero(start + length <= cuts[1:][row])
    picked = chosen[whole]
    if not len(picked):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    new = np.concatenate(([True], (picked[1:] != picked[:-1]) | (whole[1:] != whole[:-1] + 1)))
    first, last = whole[new], whole[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(whole) - 1]))]
    return row[first], picked[new], picked[new] - last, picked[new] - first


def byte_anchors(column: pa.Array, gram: int, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Batches of ``row, p, lo, hi, g`` over the bytes of each row; a long row is read in overlapping pieces."""
    data, at = column_bytes(column)
    for first, last in slices(at):
        for low in range(int(at[first]), max(int(at[last]), int(at[first]) + 1), STEP):
            high = min(int(at[last]), low + STEP + length - 1)
            part = data[low:high]
            if len(part) < length:
                continue
            cuts = np.clip(at[first : last + 1] - low, 0, len(part))
            prefix, inverse = rolling(BYTE_VALUES[part])
            hashes = mixed((prefix[gram:] - prefix[:-gram]) * inverse[: len(part) - gram + 1])
            row, p, lo, hi = anchors(hashes, cuts, gram, length)
            yield first + row, p + low - at[first + row], lo, hi, hashes[p]


def word_anchors(column: pa.Array, gram: int, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """As :func:`byte_anchors`, over words; positions count words."""
    data, at = column_bytes(column)
    for first, last in slices(at):
        base = int(at[first])
        part, own = data[base : int(at[last])], at[first : last + 1] - base
        starts, ends = word_spans(part, own)
        words, edge = hashed_spans(part, starts, ends), np.searchsorted(starts, own)
        for low in range(0, max(len(words), 1), STEP):
            piece = words[low : low + STEP + length - 1]
            if len(piece) < length:
                continue
            hashes = grams(piece, gram)
            row, p, lo, hi = anchors(hashes, np.clip(edge - low, 0, len(piece)), gram, length)
            yield first + row, p + low - edge[row], lo, hi, hashes[p]


def anchor_table(texts: DataFrame, find: Callable, gram: int, length: int) -> DataFrame:
    """``t1, t2, p, lo, hi, g`` of every anchor of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, p, lo, hi, g in find(batch.column("text"), gram, length):
                if len(row):
                    where = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("t1").take(where), batch.column("t2").take(where), pa.array(p.astype(np.int32)),
                         pa.array(lo.astype(np.int16)), pa.array(hi.astype(np.int16)), pa.array(g.view(np.int64))],
                        ["t1", "t2", "p", "lo", "hi", "g"],
                    )

    return texts.select("t1", "t2", "text").mapInArrow(run, "t1 long, t2 long, p int, lo short, hi short, g long")


def recurring(anchored: DataFrame) -> DataFrame:
    """The anchors whose gram is an anchor at another place too, places being positions in distinct texts."""
    places = anchored.withColumn("place", F.xxhash64("t1", "t2", "p"))
    again = places.groupBy("g").agg(F.min("place").alias("one"), F.max("place").alias("other")).where("one <> other").select("g")
    again = stage(again, "again")
    return likely_members(anchored, F.col("g"), again, F.col("g")).join(again, "g")


def by_text(anchored: DataFrame) -> DataFrame:
    """The anchors of each text as one array, never more than its own."""
    return anchored.groupBy(*TEXT_KEY).agg(F.array_sort(F.collect_set(F.struct("p", "lo", "hi"))).alias("found"))


def with_texts(lists: DataFrame, texts: DataFrame) -> DataFrame:
    """One row per text with ``text`` and ``id`` of the copy with the smallest id; the id in the join keeps copies apart.

    Rows that repeat that id and text count once.
    """
    ids = texts.groupBy(*TEXT_KEY).agg(F.min("doc_id").alias("doc_id"))
    wanted = stage(lists.join(ids, TEXT_KEY), "wanted")
    # a null id is two plain columns, so that one exchange serves the aggregate and the join
    place = {"place": F.coalesce("doc_id", F.lit(0)), "unnamed": F.col("doc_id").isNull()}
    some = likely_members(texts, F.xxhash64("t1", "doc_id"), wanted, F.xxhash64("t1", "doc_id")).withColumns(place)
    one = some.groupBy(*TEXT_KEY, *place).agg(F.min("text").alias("text")).join(wanted.withColumns(place), [*TEXT_KEY, *place])
    return one.select(*TEXT_KEY, F.col("doc_id").alias("id"), "text", *[c for c in lists.columns if c not in TEXT_KEY])


def unlike_copies(segments: DataFrame, place: Column) -> tuple[DataFrame, DataFrame]:
    """Segments that equal another one with a smaller ``place``, and the first of every distinct segment.

    Both keep all columns, with ``n`` copies. Only segments whose digest may occur twice are joined with their group.
    """
    groups = stage(segments.groupBy("s1", "s2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "copied")
    flagged = likely(segments, F.xxhash64("s1", "s2"), groups, F.xxhash64("s1", "s2"))
    sure = flagged.where("NOT likely").drop("likely").withColumn("n", F.lit(1).cast("long"))
    judged = flagged.where("likely").drop("likely").join(groups, ["s1", "s2"], "left")
    judged = judged.withColumn("copy", F.col("n").isNotNull() & (place != F.col("first"))).withColumn("n", F.coalesce("n", F.lit(1).cast("long")))
    judged = stage(judged.drop("first"), "judged")
    return judged.where("copy").drop("copy"), sure.unionByName(judged.where("NOT copy").drop("copy"))


def multikey_order(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Order of rows of 64-bit tokens: sort by the current token, descend to the next one only inside equal runs."""
    order = np.arange(len(tokens))
    group = np.zeros(len(tokens), np.int64)
    tied = np.arange(len(tokens))
    for depth in range(tokens.shape[1] + 1):
        rows = order[tied]
        key = tokens[rows, depth] if depth < tokens.shape[1] else sizes[rows].astype(np.uint64)
        inner = np.lexsort((key, group[tied]))
        order[tied], key, run = rows[inner], key[inner], group[tied]
        new = np.ones(len(tied), bool)
        new[1:] = (key[1:] != key[:-1]) | (run[1:] != run[:-1])
        group[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        tied = tied[~new | np.concatenate((~new[1:], [False]))]
        if not len(tied):
            break
    return order


def common_prefixes(units: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Units that each row of the order shares with the one before it; the first shares none."""
    out = np.zeros(len(order), np.int64)
    for low in range(1, len(order), 4096):
        here, before = order[low : low + 4096], order[low - 1 : low - 1 + len(order[low : low + 4096])]
        differ = units[here] != units[before]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), units.shape[1])
        out[low : low + len(here)] = np.minimum(first, np.minimum(sizes[here], sizes[before]))
    return out


class Suffixes:
    """Sorted suffixes of one side of the anchors, and their runs of equal prefixes at any depth."""

    def __init__(self, units: np.ndarray, sizes: np.ndarray):
        tokens = units if units.dtype == np.uint64 else np.ascontiguousarray(units).view(">u8").astype(np.uint64)
        self.order = multikey_order(tokens, sizes)
        self.shared = common_prefixes(units, sizes, self.order)
        self.rank = np.empty(len(units), np.int64)
        self.rank[self.order] = np.arange(len(units))

    def runs(self, depth: int) -> np.ndarray:
        """For each row the number of its run of suffixes that agree on ``depth`` units, in sorted order."""
        return np.cumsum(self.shared < depth)[self.rank] - 1


def padded(parts: list[np.ndarray], kind: type, multiple: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Rows of units as a matrix filled with zeros, and their sizes."""
    sizes = np.array([len(x) for x in parts], np.int64)
    width = max(multiple, -(-int(sizes.max(initial=1)) // multiple) * multiple)
    out = np.zeros((len(parts), width), kind)
    for i, x in enumerate(parts):
        out[i, : len(x)] = x
    return out, sizes


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of every run of true cells."""
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def span_lists(flagged: DataFrame) -> DataFrame:
    """The covered ranges ``[start, stop)`` of each text as one array, never more than its own."""
    return flagged.groupBy(*TEXT_KEY).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def staged_candidates(texts: DataFrame, find: Callable, gram: int, length: int, name: str) -> DataFrame:
    """Texts with an anchor that recurs, beside their recurring anchors ``found``."""
    anchored = stage(anchor_table(texts, find, gram, length), f"{name}-anchors")
    return stage(with_texts(by_text(recurring(anchored)), texts), f"{name}-texts")
