"""Target-distribution importance resampling: hashed features of distinct lines, log-ratio gains per bucket, a Gumbel draw."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitcast.llm.common import stage
from pitcast.operators.ordered import ranked

BUCKETS = 10_000
MIN_WORDS = 20
SEED = "2024"
#: A line with over one in ``HOT`` of all line occurrences is joined by a broadcast, of fewer than ``HOT`` rows.
HOT = 1_000
#: Lower case for A-Z; every other ASCII byte but digits and a-z is a space. Bytes of other characters stay.
_FOLD = bytes(
    b if b >= 0x80 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else b + 32 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32 for b in range(256)
)


def fold_words(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text whose A-Z are lower-cased, in UTF-8."""
    return text.encode().translate(_FOLD).split()


def _grams(words: list[bytes], start: int, longest: int, buckets: int) -> list[int]:
    """Buckets of the runs of 1 to ``longest`` words at ``start``; the checksum of a run goes on from the shorter one's."""
    at = zlib.crc32(words[start])
    out = [at % buckets]
    for word in words[start + 1 : start + longest]:
        at = zlib.crc32(word, zlib.crc32(b" ", at))
        out.append(at % buckets)
    return out


def line_features(lines: DataFrame, max_n: int, buckets: int) -> DataFrame:
    """``k1, k2, times, n_words, found`` of distinct ``lines(line, times)``: the buckets of all features inside the line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            counts, found = [], []
            for text in batch.column("line").to_pylist():
                words = fold_words(text)
                counts.append(len(words))
                if max_n > 1:
                    found.append([b for i in range(len(words)) for b in _grams(words, i, max_n, buckets)])
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                for w in words:
                    if w not in seen:
                        seen[w] = zlib.crc32(w) % buckets
                found.append([seen[w] for w in words])
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), batch.column("times"), pa.array(counts, pa.int64()), pa.array(found, pa.list_(pa.int32()))],
                ["k1", "k2", "times", "n_words", "found"],
            )

    keyed = lines.select(*line_key("line"), "line", F.col("times").cast("long").alias("times"))
    return keyed.mapInArrow(run, "k1 long, k2 long, times long, n_words long, found array<int>")


def crossing_features(texts: DataFrame, max_n: int, buckets: int) -> DataFrame:
    """``doc_id, t1, t2, times, found`` of ``texts(doc_id, t1, t2, times, text)``: the buckets of features that span several lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                words, line, edges = [], [], []
                for n, part in enumerate(text.split("\n")):
                    fresh = fold_words(part)
                    if fresh and words:
                        edges.append(len(words))  # where a line with words begins
                    words += fresh
                    line += [n] * len(fresh)
                starts = sorted({i for e in edges for i in range(max(0, e - max_n + 1), e)})
                crossing = []
                for i in starts:
                    for size, bucket in enumerate(_grams(words, i, max_n, buckets), 1):
                        if line[i + size - 1] != line[i]:
                            crossing.append(bucket)
                found.append(crossing)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "t1", "t2", "times")), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "t1", "t2", "times", "found"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "t1", "t2", "times", "text").mapInArrow(run, f"doc_id {kind}, t1 long, t2 long, times long, found array<int>").where("size(found) > 0")


def line_key(line: Column | str) -> list[Column]:
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(1), line).alias("k2")]


def texts_of(docs: DataFrame) -> DataFrame:
    """``doc_id, t1, t2, text``: rows by identifier and content, as rows that agree in both are alike."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))


def distinct_lines(texts: DataFrame) -> DataFrame:
    """``line, times``: the lines that are not empty and how often each occurs; copies combine before the shuffle."""
    return texts.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''").groupBy("line").agg(F.count(F.lit(1)).alias("times"))


def _spanning(texts: DataFrame, max_n: int, buckets: int) -> DataFrame:
    """Staged features across lines of distinct texts, one row for rows that are alike."""
    alike = texts.where(F.instr("text", "\n") > 0).groupBy("doc_id", "t1", "t2").agg(F.count(F.lit(1)).alias("times"), F.min("text").alias("text"))
    return stage(crossing_features(alike, max_n, buckets), "crossing")


def bucket_counts(*features: DataFrame) -> DataFrame:
    """``bucket, n``: how often each bucket occurs in ``features(times, found)``."""
    parts = [f.select("times", F.explode("found").alias("bucket")).groupBy("bucket").agg(F.sum("times").alias("n")) for f in features]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """``bucket, gain`` of all buckets: a thousand times the smoothed log ratio of the target's share to the source's, floored."""
    both = source.select("bucket", F.col("n").alias("s")).join(target.select("bucket", F.col("n").alias("t")), "bucket", "full")
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(both, "bucket", "left").fillna(0, ["s", "t"])
    totals = every.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t")).first()
    size = float(buckets)
    ratio = (F.col("t") + 1.0) * (F.lit(float(totals["all_s"])) + size) / ((F.col("s") + 1.0) * (F.lit(float(totals["all_t"])) + size))
    return every.select("bucket", F.floor(1000.0 * F.log(ratio)).cast("long").alias("gain"))


def _weighed(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """``features`` with ``found`` replaced by ``n_features`` and the sum of their gains, ``weight``."""
    rest = [f for f in features.schema.fields if f.name != "found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("found")
            edge = found.offsets.to_numpy().astype(np.int64)
            total = np.concatenate(([0], np.cumsum(gains[found.flatten().to_numpy()])))
            edge = edge - edge[0]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in rest), pa.array(np.diff(edge)), pa.array(total[edge[1:]] - total[edge[:-1]])], [*(f.name for f in rest), "n_features", "weight"],
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest)
    return features.mapInArrow(run, f"{kinds}, n_features long, weight long")


def importance_weights(docs: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, t1, t2, copies, n_words, n_features, weight`` of distinct documents, weighed towards the texts of ``target``.

    Newlines cut texts into lines; no word holds one, so the features of a text are those of its lines and, beyond single
    words, those across lines. Features of each distinct line are found once and counted as often as it occurs; gains per bucket,
    whose number is a parameter, are the one table that goes to every task.
    """
    texts = texts_of(docs)
    lines = stage(line_features(distinct_lines(texts), max_n, buckets), "lines")
    wanted = texts_of(target.select(F.lit(0).alias("doc_id"), "text"))
    source_parts, target_parts = [lines], [line_features(distinct_lines(wanted), max_n, buckets)]
    if max_n > 1:
        source_parts.append(_spanning(texts, max_n, buckets))
        target_parts.append(_spanning(wanted, max_n, buckets))
    by_bucket = np.zeros(buckets, np.int64)
    for r in bucket_gains(bucket_counts(*source_parts), bucket_counts(*target_parts), buckets).toLocalIterator():
        by_bucket[r["bucket"]] = r["gain"]
    weighed = stage(_weighed(lines, by_bucket).where("n_words > 0"), "weights")
    occurrences = weighed.agg(F.sum("times")).scalar()
    hot = weighed.where(F.col("times") * HOT > occurrences)
    rare = weighed.where(F.col("times") * HOT <= occurrences)
    placed = texts.select("doc_id", "t1", "t2", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    placed = placed.select("doc_id", "t1", "t2", "pos", *line_key("line"))
    sums = {"n_words": "words", "n_features": "features", "weight": "gain"}
    named = lambda df, mark: df.select("k1", "k2", *[F.col(a).alias(f"{mark}_{b}") for a, b in sums.items()])
    marked = placed.join(F.broadcast(named(hot, "hot")), ["k1", "k2"], "left")
    known = F.col("hot_words").isNotNull()
    rest = marked.where(~known).select("doc_id", "t1", "t2", "pos", "k1", "k2").join(named(rare, "line"), ["k1", "k2"], "left")
    both = marked.where(known).select("doc_id", "t1", "t2", "pos", *[F.col(f"hot_{b}").alias(f"line_{b}") for b in sums.values()]).unionByName(rest.drop("k1", "k2"))
    # alike rows repeat every line; their first lines count them
    per = both.groupBy("doc_id", "t1", "t2").agg(
        F.count_if(F.col("pos") == 0).alias("copies"), *[F.coalesce(F.sum(f"line_{b}"), F.lit(0)).alias(a) for a, b in sums.items()]
    )
    per = per.select("doc_id", "t1", "t2", "copies", *[F.expr(f"{a} div copies").alias(a) for a in sums])
    if max_n > 1:
        spans = _weighed(source_parts[1], by_bucket).select("doc_id", "t1", "t2", F.col("n_features").alias("more"), F.col("weight").alias("more_weight"))
        same = (F.col("p.doc_id").eqNullSafe(F.col("x.doc_id"))) & (F.col("p.t1") == F.col("x.t1")) & (F.col("p.t2") == F.col("x.t2"))
        per = per.alias("p").join(spans.alias("x"), same, "left").select(
            "p.doc_id", "p.t1", "p.t2", "copies", "n_words", (F.col("n_features") + F.coalesce("more", F.lit(0))).alias("n_features"),
            (F.col("weight") + F.coalesce("more_weight", F.lit(0))).alias("weight"),
        )
    return per


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = MIN_WORDS, max_n: int = 1,
             buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_features, weight, score, rank``.

    ``weight`` is the sum of the gains of the document's features, ``score`` adds Gumbel noise from the identifier, so that the highest
    scores are a draw without replacement in proportion to the importance. Of the documents with at least ``min_words`` words,
    ``percent`` in a hundred (rounded down) are drawn, by score and then the smaller identifier, and have a ``rank`` from 1; others have null.

    Null, empty and wordless texts have no features and weight 0. Repeated rows are rows of their own: alike ones have equal scores and
    successive ranks. Null identifiers take the noise of an empty one and precede in ties. An empty target or table is no error. Other
    columns are ignored.
    """
    per = importance_weights(docs, target, max_n, buckets)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000.0 * F.log(-F.log((noise + 0.5) / 4294967296.0))).cast("long")
    scored = per.withColumn("score", F.col("weight") + gumbel).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    scored = stage(scored.select("doc_id", "t1", "t2", "copy", "n_words", "n_features", "weight", "score", (-F.col("score")).alias("falling")), "scored")
    asked = scored.where(F.col("n_words") >= min_words)
    drawn = asked.count() * percent // 100
    placed = ranked(asked, [], ["falling", "doc_id", "t1", "t2", "copy"], "place")
    rank = F.when(F.col("place") <= drawn, F.col("place")).cast("long")
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    return placed.select(*columns, rank.alias("rank")).unionByName(
        scored.where(F.col("n_words") < min_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    )
