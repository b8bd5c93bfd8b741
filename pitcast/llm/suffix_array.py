"""Suffix-array deduplication: long byte strings that occur more than once are removed everywhere."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitcast.llm.common import stage
from pitcast.llm.repeats import (
    TEXT_KEY, Suffixes, by_text, byte_anchors, keyed, padded, recurring, span_lists, spans_of, staged_candidates, unlike_copies,
)
from pitcast.llm.tokens import column_bytes

LENGTH = 400
#: Suffixes that one range is meant to hold.
RANGE_ROWS = 12_000


def gram_of(length: int) -> int:
    """Bytes of the gram at an anchor, for strings of ``length`` bytes."""
    return max(1, length * 8 // 25)


def half_of(length: int) -> int:
    """Windows whose anchor lies at most this far in are compared by the suffix at the anchor, the others by the reversed prefix."""
    return (length - gram_of(length)) // 2


def segment_digests(candidates: DataFrame, length: int) -> DataFrame:
    """``t1, t2, p, lo, hi, g, s1, s2``: a 128-bit digest of all bytes that an anchor's windows cover."""
    gram = gram_of(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = column_bytes(batch.column("text"))
            found = batch.column("found")
            flat, edge = found.flatten(), found.offsets.to_numpy() - found.offsets[0].as_py()
            row = np.repeat(np.arange(batch.num_rows), np.diff(edge))
            p, lo, hi = (flat.field(i).to_numpy() for i in range(3))
            low, high = (at[row] + p - hi).tolist(), (at[row] + p - lo + length).tolist()
            body, shape = memoryview(data), (lo.astype(np.int64) * (length + 1) + hi).tolist()
            digests = np.frombuffer(b"".join(
                blake2b(body[a:b], digest_size=16, salt=c.to_bytes(8, "little")).digest() for a, b, c in zip(low, high, shape)
            ), np.int64).reshape(-1, 2)
            grams = np.frombuffer(b"".join(blake2b(body[a : a + gram], digest_size=8).digest() for a in (at[row] + p).tolist()), np.int64)
            where = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("t1").take(where), batch.column("t2").take(where), *flat.flatten(), pa.array(grams), pa.array(digests[:, 0]), pa.array(digests[:, 1])],
                ["t1", "t2", "p", "lo", "hi", "g", "s1", "s2"],
            )

    return candidates.select(*TEXT_KEY, "text", "found").mapInArrow(run, "t1 long, t2 long, p int, lo short, hi short, g long, s1 long, s2 long")


def suffix_records(candidates: DataFrame, length: int) -> DataFrame:
    """The suffixes to sort: ``kind`` 0 is text from the anchor on, 1 is reversed text up to the anchor gram's end.

    ``rest`` is the context on the other side. Each holds just the bytes that its windows need.
    """
    gram, half = gram_of(length), half_of(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = column_bytes(batch.column("text"))
            body = data.tobytes()
            found = batch.column("found").to_pylist()
            t1, t2 = batch.column("t1").to_pylist(), batch.column("t2").to_pylist()
            out = []
            for i, places in enumerate(found):
                for x in places:
                    p, lo, hi = x["p"] + int(at[i]), x["lo"], x["hi"]
                    if lo <= half:
                        top = min(hi, half)
                        out.append((t1[i], t2[i], x["p"], lo, top, 0, body[p : p + length - lo], body[p - top : p][::-1]))
                    if hi > half:
                        low = max(lo, half + 1)
                        out.append((t1[i], t2[i], x["p"], low, hi, 1, body[p - hi : p + gram][::-1], body[p + gram : p - low + length]))
                if len(out) >= 5_000 or i == len(found) - 1 and out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), _RECORD_TYPES)], _RECORD_NAMES)
                    out = []

    return candidates.select(*TEXT_KEY, "text", "found").mapInArrow(
        run, "t1 long, t2 long, p int, lo short, hi short, kind short, suffix binary, rest binary"
    )


_RECORD_NAMES = ["t1", "t2", "p", "lo", "hi", "kind", "suffix", "rest"]
_RECORD_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.int16(), pa.binary(), pa.binary()]


def compare_range(rows: pa.Table, kind: int, length: int) -> tuple[list, list]:
    """Repeated windows of one kind in one sorted range, and windows whose equals may lie in the next range.

    Windows agree when their suffixes share a run at the depth they need and so do their other sides. Runs that
    touch either end of the range may go on beyond it; one window of each of their classes is handed on.
    """
    data, at = column_bytes(rows.column("suffix").combine_chunks())
    rest, rest_at = column_bytes(rows.column("rest").combine_chunks())
    left = [data[a:b] for a, b in zip(at[:-1], at[1:])]
    right = [rest[a:b] for a, b in zip(rest_at[:-1], rest_at[1:])]
    first = Suffixes(*padded(left, np.uint8, 8))
    second = Suffixes(*padded(right, np.uint8, 8))
    lo, hi = rows.column("lo").to_numpy(), rows.column("hi").to_numpy()
    n, gram = len(lo), gram_of(length)
    flags = np.zeros((n, int(hi.max()) + 1), bool)
    beyond = []
    for d in range(int(lo.min()), int(hi.max()) + 1):
        deep, other = (length - d, d) if kind == 0 else (d + gram, length - d - gram)
        here = np.flatnonzero((lo <= d) & (d <= hi))
        if not len(here):
            continue
        runs = first.runs(deep)
        last = int(runs[first.order[-1]])
        code = runs[here] * n + second.runs(other)[here]
        order = np.argsort(code, kind="stable")
        new = np.concatenate(([True], code[order][1:] != code[order][:-1]))
        twice = ~new | np.concatenate((~new[1:], [False]))
        flags[here[order[twice]], d] = True
        heads = here[order[new]]
        heads = heads[(runs[heads] == 0) | (runs[heads] == last)]
        for i in heads.tolist():
            a, b = left[i].tobytes(), right[i].tobytes()
            window = b[:d][::-1] + a[: length - d] if kind == 0 else a[: d + gram][::-1] + b[: length - d - gram]
            beyond.append((i, d, blake2b(window, digest_size=16).digest()))
    return list(zip(*spans_of(flags))), beyond


def sorted_ranges(records: DataFrame, ranges: int, length: int) -> DataFrame:
    """Sort suffixes in ranges cut at sampled splitters; rows are covered ranges, or windows at a range's end with a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        for kind in (0, 1):
            rows = table.filter(pa.compute.equal(table.column("kind"), kind))
            if not rows.num_rows:
                continue
            spans, beyond = compare_range(rows, kind, length)
            p = rows.column("p").to_numpy()
            where = [int(s[0]) for s in spans] + [b[0] for b in beyond]
            begin = [int(p[i] - high) for i, _, high in spans] + [int(p[i] - d) for i, d, _ in beyond]
            end = [int(p[i] - low) + length for i, low, _ in spans] + [int(p[i] - d) + length for i, d, _ in beyond]
            digest = [None] * len(spans) + [x for *_, x in beyond]
            take = pa.array(where, pa.int64())
            yield from pa.Table.from_arrays(
                [rows.column("t1").take(take), rows.column("t2").take(take), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(digest, pa.binary())],
                ["t1", "t2", "start", "stop", "window"],
            ).combine_chunks().to_batches(20_000)

    return records.repartitionByRange(ranges, "kind", "suffix", "rest").mapInArrow(run, "t1 long, t2 long, start int, stop int, window binary")


def _settled(parts: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """What equal ``parts`` cover, as they repeat whole, and one of each, which goes on to meet unlike ones."""
    copies, firsts = unlike_copies(parts, F.struct("t1", "t2", "p"))
    covered = copies.unionByName(firsts.where("n > 1")).select(
        *TEXT_KEY, (F.col("p") - F.col("hi")).alias("start"), (F.col("p") - F.col("lo") + length).alias("stop")
    )
    return covered, firsts


def repeated_spans(candidates: DataFrame, length: int) -> DataFrame:
    """``t1, t2, start, stop``: ranges of bytes covered by a window that starts at another place too."""
    digests = stage(segment_digests(candidates, length), "segments")
    repeated, firsts = _settled(digests, length)
    single = stage(recurring(firsts.select(*TEXT_KEY, "p", "lo", "hi", "g")), "single")
    records = suffix_records(by_text(single).join(candidates.select(*TEXT_KEY, "text"), TEXT_KEY), length)
    # suffixes that agree in their other sides too have the same windows; no range could part them
    content = ["kind", "lo", "hi", "suffix", "rest"]
    records = stage(records.withColumns({"s1": F.xxhash64(*content), "s2": F.xxhash64(F.lit(1), *content)}), "suffixes")
    alike, records = _settled(records, length)
    repeated = repeated.unionByName(alike)
    records = stage(records.drop("s1", "s2", "n"), "unlike")
    ranges = max(1, -(-records.count() // RANGE_ROWS))
    compared = stage(sorted_ranges(records, ranges, length), "compared")
    ends = compared.where("window IS NOT NULL")
    crossing = ends.join(stage(ends.groupBy("window").agg(F.count("*").alias("n")).where("n > 1"), "crossing"), "window")
    names = [*TEXT_KEY, "start", "stop"]
    return repeated.unionByName(compared.where("window IS NULL").select(*names)).unionByName(crossing.select(*names))


def _without(candidates: DataFrame, spans: DataFrame) -> DataFrame:
    """``t1, t2, n_removed, n_spans, kept_sha256, kept_text`` of the texts with covered ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = column_bytes(batch.column("text"))
            out = []
            for i, places in enumerate(batch.column("spans").to_pylist()):
                text = data[at[i] : at[i + 1]]
                edge = np.zeros(len(text) + 1, np.int32)
                np.add.at(edge, [x["start"] for x in places], 1)
                np.add.at(edge, [x["stop"] for x in places], -1)
                gone = np.cumsum(edge)[:-1] > 0
                kept = text[~gone].tobytes()
                # a character goes when all its bytes do
                lead = np.flatnonzero((text & 0xC0) != 0x80)
                whole = np.repeat(np.logical_and.reduceat(gone, lead), np.diff(np.append(lead, len(text)))) if len(lead) else gone
                out.append((int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), sha256(kept).hexdigest(), text[~whole].tobytes()))
            n, runs, digest, kept = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("t1"), batch.column("t2"), pa.array(n, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["t1", "t2", "n_removed", "n_spans", "kept_sha256", "kept_text"],
            )

    joined = candidates.select(*TEXT_KEY, "text").join(span_lists(spans), TEXT_KEY)
    return joined.select(*TEXT_KEY, "text", "spans").mapInArrow(
        run, "t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    )


def _outcome(docs: DataFrame, keep_text: bool, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    texts = keyed(docs)
    candidates = staged_candidates(texts, byte_anchors, gram_of(length), length, "bytes")
    changed = _without(candidates, repeated_spans(candidates, length))
    changed = stage(changed if keep_text else changed.drop("kept_text"), "changed")
    copied = stage(texts.groupBy(*TEXT_KEY).agg(F.count("*").alias("copies")).where("copies > 1"), "copied")
    return texts, changed, copied


def suffix_array_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Every byte covered by a string of ``length`` bytes that also starts anywhere else, in the same document or
    another, is removed; strings are judged on the input and never cross documents. Sampled suffixes are
    range-partitioned by their leading bytes at splitters that Spark samples, each range is sorted by
    multikey quicksort, neighbours share what their common prefixes allow, and runs at the ends of ranges are compared
    across them. Whole texts that occur more than once are removed whole if long enough.

    Null texts are empty, and texts shorter than ``length`` stay as they are. Rows that repeat an id are rows of their
    own, so a long repeated row is removed. Null ids and other columns are carried or ignored.
    """
    texts, changed, copied = _outcome(docs, False, length)
    base = texts.select("doc_id", *TEXT_KEY, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    joined = base.join(changed, TEXT_KEY, "left").join(copied, TEXT_KEY, "left")
    gone = F.col("copies").isNotNull() & (F.col("n_bytes") >= length)
    return joined.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated strings of ``length`` bytes cut from ``text`` and ``n_chars`` counted anew, where there is such a column.

    A character that loses only some of its bytes stays whole, so texts stay valid. Documents that lose
    everything stay with an empty text; null texts stay null.
    """
    _, changed, copied = _outcome(docs, True, length)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = docs.withColumns({"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(1), text)}).join(
        changed.select(*TEXT_KEY, "kept_text"), TEXT_KEY, "left"
    ).join(copied, TEXT_KEY, "left")
    gone = F.col("copies").isNotNull() & (F.octet_length(text) >= length)
    cut = F.when(F.col("text").isNull(), F.col("text")).when(gone, F.lit("")).otherwise(F.coalesce("kept_text", "text"))
    out = joined.withColumn("text", cut)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
