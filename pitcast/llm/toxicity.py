"""Toxicity scores by weak supervision: voters, a generative label model and a linear classifier."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitcast.llm.common import likely_members, stage
from pitcast.llm.tokens import BYTE_VALUES, STEP, column_bytes, mixed, rolling, slices, word_spans

#: Lengths in bytes of the word beginnings that serve as patterns.
STEMS = (3, 4, 5, 6, 7, 8)
#: Lexicon voters over whole words, pattern voters over beginnings (one per length), and voters on style. Votes of a document
#: are the bits of one number, so there are at most two to the power of their count vote patterns.
WORD_VOTERS, STYLE_VOTERS = 6, 3
VOTERS = WORD_VOTERS + len(STEMS) + STYLE_VOTERS
#: Words and patterns that the voters know at most, the strongest first, and what an entry must show at least.
LEXICON = 4_096
LEAST_DOCS, LEAST_Z, LEAST_LIFT = 3, 4.0, 15.0
EM_STEPS = 60
KIND = np.uint64(7)
SEPARATORS = np.ones(256, bool)
SEPARATORS[48:58] = SEPARATORS[65:91] = SEPARATORS[97:123] = False
SEPARATORS[128:] = False


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from all learning: the CRC of its id as text is divisible by five."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def style() -> Column:
    """Bits of the style voters, from the text as written: repeated exclamation, shouting, and drawn-out letters."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tests = [text.rlike("!!"), text.rlike(r"\b[A-Z]{4,} [A-Z]{2,}\b"), text.rlike(r"([A-Za-z])\1\1\1")]
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests[1:], 1)), F.when(tests[0], 1).otherwise(0))


def prepared(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"), style().alias("style"))


def piece_end(data: np.ndarray, low: int, end: int) -> int:
    """Where the piece from ``low`` on ends: after its last separator, or before the next one where a word outgrows ``STEP``."""
    high = min(low + STEP, end)
    if high == end:
        return end
    parted = np.flatnonzero(SEPARATORS[data[low:high]])
    if len(parted):
        return low + int(parted[-1]) + 1
    ahead = np.flatnonzero(SEPARATORS[data[high:end]])
    return high + int(ahead[0]) if len(ahead) else end


def feature_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For batches of rows, the row and the code of each of their features: a content hash whose low bits are the kind.

    Features are words (kind 0), and the beginnings of longer words (1 and on). Words are runs of letters and digits.
    """
    data, at = column_bytes(column)
    for first, last in slices(at):
        high, end = int(at[first]), int(at[last])
        while high < end:
            low, high = high, piece_end(data, high, end)
            part = data[low:high]
            cuts = np.clip(at[first : last + 1] - low, 0, len(part))
            starts, ends = word_spans(part, cuts, SEPARATORS)
            if not len(starts):
                continue
            prefix, inverse = rolling(BYTE_VALUES[part])
            row = first + np.searchsorted(cuts, starts, "right") - 1
            rows, codes = [row], [mixed((prefix[ends] - prefix[starts]) * inverse[starts]) & ~KIND]
            for k, size in enumerate(STEMS, 1):
                long = ends - starts > size
                s = starts[long]
                rows.append(row[long])
                codes.append(mixed((prefix[s + size] - prefix[s]) * inverse[s]) & ~KIND | np.uint64(k))
            yield np.concatenate(rows), np.concatenate(codes)


def feature_counts(labelled: DataFrame) -> DataFrame:
    """``feature, toxic, clean``: labelled documents with each feature; copies combine in the task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("toxic").to_numpy()
            for rows, codes in feature_rows(batch.column("text")):
                order = np.lexsort((rows, codes))
                rows, codes = rows[order], codes[order]
                new = np.concatenate(([True], (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])))
                rows, codes = rows[new], codes[new]
                head = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
                toxic = np.add.reduceat(labels[rows].astype(np.int64), head)
                total = np.diff(np.append(head, len(rows)))
                yield pa.RecordBatch.from_arrays([pa.array(codes[head].view(np.int64)), pa.array(toxic), pa.array(total - toxic)], ["feature", "toxic", "clean"])

    counts = labelled.select("text", "toxic").mapInArrow(run, "feature long, toxic long, clean long")
    return counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def lexicon(labelled: DataFrame) -> np.ndarray:
    """Hashes of the words and patterns that mark toxic documents, strongest first, at most ``LEXICON`` of them."""
    totals = labelled.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).first()
    toxic, clean = int(totals.toxic or 0), int(totals.n - (totals.toxic or 0))
    if not toxic or not clean:
        return np.zeros(0, np.uint64)
    rate, share = F.col("toxic") / toxic, (F.col("toxic") + F.col("clean")) / (toxic + clean)
    z = (rate - F.col("clean") / clean) / F.sqrt(share * (1 - share) * (1 / toxic + 1 / clean))
    strong = feature_counts(labelled).withColumn("z", z).where(
        (F.col("toxic") >= LEAST_DOCS) & (F.col("z") >= LEAST_Z) & (rate >= LEAST_LIFT * F.col("clean") / clean)
    )
    found = strong.orderBy(F.desc("z"), "feature").limit(LEXICON).select("feature").toPandas()
    return found.feature.to_numpy(np.int64).view(np.uint64)


def matches(texts: DataFrame, known: np.ndarray, others: list[str]) -> DataFrame:
    """``doc_id``, ``others``, ``votes`` and ``entries``: votes as bits, and the lexicon entries that a document holds."""
    order = np.argsort(known)
    ranked = known[order]
    bits = [1 << int(v) for v in voters_of(known)]
    slot = lambda codes: (codes >> np.uint64(8) & np.uint64((1 << 20) - 1)).astype(np.int64)
    maybe = np.zeros(1 << 20, bool)
    maybe[slot(known)] = True
    names = ["doc_id", *others]
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries: list = [set() for _ in range(batch.num_rows)]
            votes = [x << (VOTERS - STYLE_VOTERS) for x in batch.column("style").to_pylist()]
            for rows, codes in feature_rows(batch.column("text")):
                some = np.flatnonzero(maybe[slot(codes)])
                if not len(some):
                    continue
                at = np.searchsorted(ranked, codes[some])
                hit = ranked[np.minimum(at, len(ranked) - 1)] == codes[some]
                for r, e in zip(rows[some[hit]].tolist(), order[at[hit]].tolist()):
                    entries[r].add(e)
                    votes[r] |= bits[e]
            lists = [sorted(x) for x in entries]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(votes, pa.int64()), pa.array(lists, pa.list_(pa.int32()))], [*names, "votes", "entries"]
            )

    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", votes long, entries array<int>"
    return texts.select(*names, "style", "text").mapInArrow(run, schema)


def voters_of(known: np.ndarray) -> np.ndarray:
    """The voter of each entry: words are dealt to the lexicons by hash, beginnings go to the pattern voter of their length."""
    kinds = (known & KIND).astype(np.int64)
    return np.where(kinds == 0, (known >> np.uint64(40)).astype(np.int64) % WORD_VOTERS, WORD_VOTERS + kinds - 1)


@dataclass
class LabelModel:
    """Voter behaviour given the hidden class, with votes of voters that agree beyond it discounted."""

    prior: float
    toxic: np.ndarray
    clean: np.ndarray
    label: np.ndarray
    discount: np.ndarray

    def posterior(self, votes: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of votes; ``label`` is 1, 0 or -1 where a row has none."""
        odds = np.where(votes == 1, np.log(self.toxic / self.clean), np.log((1 - self.toxic) / (1 - self.clean)))
        said = np.where(label == 1, np.log(self.label[1] / self.label[0]), np.where(label == 0, np.log((1 - self.label[1]) / (1 - self.label[0])), 0.0))
        score = np.log(self.prior / (1 - self.prior)) + odds @ self.discount + said
        return 1 / (1 + np.exp(-np.clip(score, -50, 50)))


def fit_label_model(votes: np.ndarray, label: np.ndarray, weight: np.ndarray) -> LabelModel:
    """Expectation maximisation over vote patterns and their counts; given labels count as one more, noisy voter."""
    smooth = lambda hit, total: (hit + 0.5) / (total + 1.0)
    seen = label >= 0
    ones, zeros = weight * (label == 1), weight * (label == 0)
    model = LabelModel(
        float(np.clip(smooth(ones.sum(), ones.sum() + zeros.sum()), 1e-4, 0.5)), smooth(votes.T @ ones, ones.sum()), smooth(votes.T @ zeros, zeros.sum()),
        np.array([0.02, 0.9]), np.ones(votes.shape[1]),
    )
    for _ in range(EM_STEPS):
        p = model.posterior(votes, label)
        w1, w0 = weight * p, weight * (1 - p)
        toxic, clean = smooth(votes.T @ w1, w1.sum()), smooth(votes.T @ w0, w0.sum())
        excess = np.zeros((votes.shape[1], votes.shape[1]))
        for mean, w in ((toxic, w1), (clean, w0)):
            centred = votes - mean
            spread = np.sqrt(mean * (1 - mean))
            excess += (centred.T * w) @ centred / np.outer(spread, spread) / weight.sum()
        np.fill_diagonal(excess, 0)
        told = np.array([smooth((w * (label == 1)).sum(), (w * seen).sum()) for w in (w0, w1)])
        model = LabelModel(float(np.clip(w1.sum() / weight.sum(), 1e-4, 0.5)), toxic, clean, told, 1 / (1 + np.maximum(excess, 0).sum(axis=1)))
    return model


def unpacked(votes: np.ndarray) -> np.ndarray:
    return (votes[:, None] >> np.arange(VOTERS)) & 1


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Words and word beginnings that mark the toxic among the labelled documents form lexicon and pattern voters. A
    generative model over the vote patterns of all documents, with given labels as one more noisy voter, estimates how
    each voter behaves and how far voters repeat each other. A logistic regression on the lexicon entries is fitted to
    the posterior labels of the labelled documents; its probability is the score. Documents that are held out lend
    neither labels nor features to the lexicon or the classifier, only their votes to the pattern counts.

    Null texts are empty and get the score of a text without any entry. Of labels that repeat an id the highest counts;
    null labels do not. Without labels of both classes every score is 0. Repeated rows are scored one by one; other
    columns are ignored.
    """
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("marked_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marked = stage(marked.where(~held_out(F.col("marked_id"))), "labels")
    texts = prepared(docs)
    labelled = likely_members(texts, F.col("doc_id"), marked, F.col("marked_id")).join(marked, F.col("doc_id") == F.col("marked_id"))
    labelled = stage(labelled.select("doc_id", "text", "style", "toxic"), "labelled")
    known = lexicon(labelled)
    found = stage(matches(texts, known, []), "matches")
    trained = stage(matches(labelled, known, ["toxic"]), "trained")
    flag = held_out(F.col("doc_id"))
    if not len(known):
        return found.select("doc_id", flag.alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    everyone = found.groupBy("votes").agg(F.count("*").alias("n")).toPandas()
    told = trained.groupBy("votes", "toxic").agg(F.count("*").alias("n")).toPandas()
    rest = everyone.set_index("votes").n.sub(told.groupby("votes").n.sum(), fill_value=0).clip(lower=0)
    pattern = np.concatenate([told.votes.to_numpy(np.int64), rest.index.to_numpy(np.int64)])
    label = np.concatenate([told.toxic.to_numpy(np.int64), np.full(len(rest), -1)])
    model = fit_label_model(unpacked(pattern), label, np.concatenate([told.n, rest]).astype(float))
    told["p"] = model.posterior(unpacked(told.votes.to_numpy(np.int64)), told.toxic.to_numpy(np.int64))
    weights, intercept = fit_classifier(trained.join(docs.sparkSession.createDataFrame(told[["votes", "toxic", "p"]]), ["votes", "toxic"]), len(known))
    parts = F.array(*[F.lit(float(w)) for w in weights])
    total = F.aggregate("entries", F.lit(intercept), lambda a, e: a + F.get(parts, e))
    score = 1 / (1 + F.exp(-total))
    return found.select("doc_id", flag.alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))


def fit_classifier(rows: DataFrame, entries: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression of the posterior ``p`` on the lexicon entries."""
    counted = CountVectorizerModel.from_vocabulary([str(i) for i in range(entries)], "names", "features")
    counted.setBinary(True)
    named = rows.select(F.transform("entries", lambda e: e.cast("string")).alias("names"), F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight"))
    )).alias("side")).select("names", "side.*").where("weight > 0.0001")
    fitted = LogisticRegression(maxIter=60, regParam=2e-4, standardization=False, weightCol="weight").fit(counted.transform(named))
    return fitted.coefficients.toArray(), float(fitted.intercept)
