"""Substring deduplication: word runs that also start earlier in the corpus are removed."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitcast.llm.common import SPACE, likely, stage
from pitcast.llm.repeats import TEXT_KEY, Suffixes, by_text, keyed, padded, recurring, span_lists, spans_of, staged_candidates, unlike_copies, word_anchors
from pitcast.llm.tokens import rows_of_words

LENGTH = 20
#: Words of the first prefix, and of the longer ones by which the suffixes of an oversized group are split: from the
#: anchor on for windows that start at most ``NEAR`` words before it, else from ``NEAR + 1`` words before it.
GRAM = 6
NEAR = (LENGTH - GRAM) // 2
FORWARD, BACKWARD = LENGTH - NEAR, NEAR + 1 + GRAM
#: Suffixes of one group that a task holds as a subtree; groups beyond it get a longer prefix, in the end a whole window.
GROUP_ROWS = 2_000
NO_ID = -(1 << 63)


def segments(candidates: DataFrame) -> DataFrame:
    """``t1, t2, id, p, lo, hi, g, s1, s2``: a 128-bit digest of all words that an anchor's windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("found")
            flat, edge = found.flatten(), found.offsets.to_numpy() - found.offsets[0].as_py()
            p, lo, hi = (flat.field(i).to_numpy() for i in range(3))
            digests, firsts = [], []
            for i, words, *_ in rows_of_words(batch.column("text")):
                for k in range(edge[i], edge[i + 1]):
                    part = words[p[k] - hi[k] : p[k] - lo[k] + LENGTH].tobytes()
                    digests.append(blake2b(part, digest_size=16, salt=bytes((int(lo[k]), int(hi[k])))).digest())
                    firsts.append(blake2b(words[p[k] : p[k] + GRAM].tobytes(), digest_size=8).digest())
            pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            where = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(edge)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(where) for c in ("t1", "t2", "id")], *flat.flatten(), pa.array(np.frombuffer(b"".join(firsts), np.int64)), pa.array(pair[:, 0]), pa.array(pair[:, 1])],
                ["t1", "t2", "id", "p", "lo", "hi", "g", "s1", "s2"],
            )

    return candidates.select(*TEXT_KEY, "id", "text", "found").mapInArrow(
        run, "t1 long, t2 long, id long, p int, lo short, hi short, g long, s1 long, s2 long"
    )


def suffixes(lists: DataFrame) -> DataFrame:
    """``t1, t2, id, p, lo, hi, words``: word hashes from the first window's start to the last window's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("found")
            flat, edge = found.flatten(), found.offsets.to_numpy() - found.offsets[0].as_py()
            p, lo, hi = (flat.field(i).to_numpy() for i in range(3))
            parts = []
            for i, words, *_ in rows_of_words(batch.column("text")):
                parts += [words[p[k] - hi[k] : p[k] - lo[k] + LENGTH].view(np.int64) for k in range(edge[i], edge[i + 1])]
            ends = np.cumsum([0, *map(len, parts)])
            where = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(edge)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(where) for c in ("t1", "t2", "id")], *flat.flatten(),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else [], pa.int64()))],
                ["t1", "t2", "id", "p", "lo", "hi", "words"],
            )

    return lists.select(*TEXT_KEY, "id", "text", "found").mapInArrow(
        run, "t1 long, t2 long, id long, p int, lo short, hi short, words array<long>"
    )


def later_windows(rows: list[tuple]) -> list[tuple[int, int, int]]:
    """``(row, smallest offset, largest offset)`` of windows that an equal window precedes, over rows of whole groups.

    The sorted suffixes and their shared prefixes are the group's suffix tree: at each depth a run is the subtree
    of one node. Windows at one offset are equal when they hang below one node at the depth they reach to the right
    and one node of the reversed tree at their offset to the left. The earliest leaf of such a class stays.
    """
    _, _, ids, p, lo, hi, words = zip(*rows)
    ids, p, lo, hi = (np.array(x, np.int64) for x in (ids, p, lo, hi))
    parts = [np.array(x, np.int64).view(np.uint64) for x in words]
    right = Suffixes(*padded([x[h:] for x, h in zip(parts, hi)], np.uint64))
    left = Suffixes(*padded([x[:h][::-1] for x, h in zip(parts, hi)], np.uint64))
    flags = np.zeros((len(rows), LENGTH - GRAM + 1), bool)
    for d in range(LENGTH - GRAM + 1):
        here = np.flatnonzero((lo <= d) & (d <= hi))
        if not len(here):
            continue
        code = right.runs(LENGTH - d)[here] * len(rows) + left.runs(d)[here]
        order = np.lexsort((p[here], ids[here], code))
        flags[here[order[1:]], d] = code[order][1:] == code[order][:-1]
    return list(zip(*(x.tolist() for x in spans_of(flags))))


def compare_groups(records: DataFrame) -> DataFrame:
    """``t1, t2, start, stop`` of the windows that an equal one precedes within its prefix group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def flush() -> pa.RecordBatch:
            out = [(held[i][0], held[i][1], held[i][3] - high, held[i][3] - low + LENGTH) for i, low, high in later_windows(held)]
            return pa.RecordBatch.from_arrays(
                [pa.array([x[j] for x in out], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["t1", "t2", "start", "stop"]
            )

        for batch in batches:
            keys = zip(batch.column("kind").to_pylist(), batch.column("key").to_pylist())
            rows = zip(*(batch.column(c).to_pylist() for c in ("t1", "t2", "id", "p", "lo", "hi", "words")))
            for now, row in zip(keys, rows):
                if now != key and len(held) >= GROUP_ROWS:
                    yield flush()
                    held = []
                key = now
                held.append(row)
        if held:
            yield flush()

    ordered = records.select("kind", "key", *TEXT_KEY, "id", "p", "lo", "hi", "words").repartition("kind", "key").sortWithinPartitions("kind", "key")
    return ordered.mapInArrow(run, "t1 long, t2 long, start int, stop int")


def grouped(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records dealt to prefix groups of bounded size, ``kind, key`` added, and those that only whole windows split."""
    first = records.withColumns({"kind": F.lit(0), "key": F.xxhash64(F.expr(f"slice(words, hi + 1, {GRAM})"))})
    large = stage(first.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_ROWS).select("key"), "large")
    fitting = first.join(large, "key", "left_anti")
    halves = first.join(large, "key").withColumn("half", F.explode(F.expr(f"""filter(array(
        named_struct('kind', 1, 'lo', lo, 'hi', least(hi, {NEAR}S), 'key', xxhash64(slice(words, hi + 1, {FORWARD}))),
        named_struct('kind', 2, 'lo', greatest(lo, {NEAR + 1}S), 'hi', hi, 'key', xxhash64(slice(words, greatest(hi - {NEAR}, 1), {BACKWARD})))
        ), x -> x.lo <= x.hi)""")))
    # each half keeps just the words of its own windows, so that ``hi`` words still precede the anchor
    halves = halves.select(
        *TEXT_KEY, "id", "p", F.col("half.lo").alias("lo"), F.col("half.hi").alias("hi"),
        F.expr("slice(words, hi - half.hi + 1, size(words))").alias("words"), F.col("half.kind").alias("kind"), F.col("half.key").alias("key"),
    )
    halves = stage(halves, "halves")
    still = halves.groupBy("kind", "key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_ROWS).select("kind", "key")
    still = stage(still, "still")
    return fitting.unionByName(halves.join(still, ["kind", "key"], "left_anti")), halves.join(still, ["kind", "key"], "left_semi")


def compare_windows(records: DataFrame) -> DataFrame:
    """As :func:`compare_groups` with the whole window as the prefix: its earliest place is a mergeable minimum."""
    windows = records.select(*TEXT_KEY, "id", "p", "hi", "words", F.explode(F.sequence(F.col("lo").cast("int"), F.col("hi").cast("int"))).alias("d"))
    windows = windows.withColumn("window", F.expr(f"slice(words, hi - d + 1, {LENGTH})")).select(
        *TEXT_KEY, "id", (F.col("p") - F.col("d")).alias("start"), F.xxhash64("window").alias("w1"), F.xxhash64(F.lit(1), "window").alias("w2")
    )
    place = F.struct("id", "start", "t1", "t2")
    least = windows.groupBy("w1", "w2").agg(F.min(place).alias("least"), F.count("*").alias("n")).where("n > 1")
    return windows.join(stage(least, "least"), ["w1", "w2"]).where(place != F.col("least")).select(*TEXT_KEY, "start", (F.col("start") + LENGTH).alias("stop"))


def later_spans(candidates: DataFrame) -> DataFrame:
    """``t1, t2, start, stop``: ranges of words covered by a window whose words also start earlier."""
    found = stage(segments(candidates), "segments")
    copies, firsts = unlike_copies(found, F.struct("id", "t1", "t2", "p"))
    later = copies.select(*TEXT_KEY, (F.col("p") - F.col("hi")).alias("start"), (F.col("p") - F.col("lo") + LENGTH).alias("stop"))
    single = by_text(recurring(firsts.select(*TEXT_KEY, "p", "lo", "hi", "g")))
    records = stage(suffixes(single.join(candidates.select(*TEXT_KEY, "id", "text"), TEXT_KEY)), "suffixes")
    groups, wide = grouped(records)
    return later.unionByName(compare_groups(groups)).unionByName(compare_windows(wide))


def _without(candidates: DataFrame, spans: DataFrame) -> DataFrame:
    """``t1, t2, n_removed, kept_text`` of the texts with covered ranges; kept words are joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, out = batch.column("spans").to_pylist(), []
            for i, words, starts, ends, text in rows_of_words(batch.column("text")):
                edge = np.zeros(len(words) + 1, np.int32)
                np.add.at(edge, [x["start"] for x in spans[i]], 1)
                np.add.at(edge, [x["stop"] for x in spans[i]], -1)
                stay = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
                body = text.tobytes()
                out.append((len(words) - len(stay), b" ".join([body[a:b] for a, b in zip(starts[stay].tolist(), ends[stay].tolist())])))
            n, kept = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("t1"), batch.column("t2"), pa.array(n, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["t1", "t2", "n_removed", "kept_text"]
            )

    joined = candidates.select(*TEXT_KEY, "text").join(span_lists(spans), TEXT_KEY)
    return joined.select(*TEXT_KEY, "text", "spans").mapInArrow(run, "t1 long, t2 long, n_removed long, kept_text string")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_text``, kept words joined by one space.

    A word goes when a window of ``LENGTH`` words of its document covers it whose word sequence also starts
    earlier: in a document with a smaller id, or before it in the same one. Windows are judged on the input. Suffixes are
    partitioned by prefixes of variable length, longer where a group would outgrow a task, and each group's subtree
    shows the repeats. Of texts that are copies, those with a larger id are whole repeats.

    Null texts have no words; texts under ``LENGTH`` words stay. Rows that repeat an id and text are one document and
    stay alike; a missing id comes before all others. Other columns are ignored.
    """
    texts = keyed(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    candidates = staged_candidates(texts, word_anchors, GRAM, LENGTH, "words")
    changed = stage(_without(candidates, later_spans(candidates)), "changed")
    copied = texts.groupBy(*TEXT_KEY).agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    copied = stage(copied.where("first_id <> last_id").drop("last_id"), "copied")
    wanted = changed.select(*TEXT_KEY).unionByName(copied.select(*TEXT_KEY))
    flagged = likely(texts, F.xxhash64(*TEXT_KEY), wanted, F.xxhash64(*TEXT_KEY))
    body = F.trim(F.regexp_replace("text", SPACE, " "))
    base = flagged.select(
        "doc_id", *TEXT_KEY, "likely", F.when(body == "", 0).otherwise(F.size(F.split(body, " "))).cast("long").alias("n_words"), body.alias("body")
    )
    # texts without copies or repeats are not shuffled
    alone = base.where("NOT likely").select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("body").alias("kept_text"))
    joined = base.where("likely").join(copied, TEXT_KEY, "left").join(changed, TEXT_KEY, "left").withColumn("first_id", F.coalesce("first_id", "doc_id"))
    gone = (F.col("doc_id") != F.col("first_id")) & (F.col("n_words") >= LENGTH)
    return alone.unionByName(joined.select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.when(F.col("doc_id") == F.col("first_id"), F.coalesce("n_removed", F.lit(0))).otherwise(0)).cast("long").alias("n_removed"),
        F.when(gone, F.lit("")).otherwise(F.when(F.col("doc_id") == F.col("first_id"), F.coalesce("kept_text", "body")).otherwise(F.col("body"))).alias("kept_text"),
    ))
