"""Near-duplicate documents from bottom-k sketches of one hash function."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitcast.llm.common import components, likely_members, stage
from pitcast.llm.tokens import rows_of_words, shingle_set

SHINGLE = 5
PERCENT = 75
#: Retained values per document of the first index, which finds the documents that can have a near copy at all, and of the
#: second one, which pairs those.
FIRST, SECOND = 64, 256
#: Standard deviations that an overlap of sketches may fall short of its expectation; one pair in about 1e8 does.
SLACK = 5.8
#: Hubs of the rounds of star links: the member with the most shared values, the smallest set, and an arbitrary one.
HUBS = ("-m", "n", "xxhash64(rep)")
#: Members of one inverted list that a task compares at a time; longer lists are dealt out as pairs of blocks.
BLOCK = 512


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n, set_id, sketch``: shingle count, 128-bit digest of the shingle set and its ``size`` smallest hashes."""
    width = SHINGLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, values, ends = [], [], [], [0]
            for _, words, *_ in rows_of_words(batch.column("text"), lower=True):
                found = shingle_set(words, width)
                counts.append(len(found))
                digests.append(blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                values.append(found[:size])
                ends.append(ends[-1] + len(values[-1]))
            sketch = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else [], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), sketch], ["doc_id", "n", "set_id", "sketch"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n long, set_id binary, sketch array<long>")


def needed(size: int) -> str:
    """SQL for the overlap of sketches that a document of ``n`` shingles must have with any partner.

    A partner shares at least ``PERCENT`` of the larger set. Sets no larger than a sketch are compared exactly.
    """
    share = PERCENT / 100
    return f"least(ceil(n * {PERCENT} / 100.0), {int(size * share - SLACK * sqrt(size * share * (1 - share)))})"


def sufficient(low: np.ndarray, high: np.ndarray, overlap: np.ndarray) -> np.ndarray:
    """Whether sketches of sets of ``low <= high`` elements that overlap so much allow the similarity.

    The union's sketch is the larger set's below its largest value. At the similarity asked for, the expected
    part of it that both sets hold follows from the sizes; sets that fit their sketches are decided exactly.
    """
    p = PERCENT / (100 + PERCENT) * (1 + low / high)
    estimate = SECOND * p - SLACK * np.sqrt(SECOND * p * (1 - p))
    exact = 100 * overlap >= PERCENT * (low + high - overlap)
    return (100 * low >= PERCENT * high) & np.where(high <= SECOND, exact, overlap >= estimate)


def sufficient_sql(low: str, high: str, overlap: str) -> str:
    """:func:`sufficient` as SQL."""
    p = f"({PERCENT / (100 + PERCENT)} * (1 + {low} / {high}))"
    return (
        f"100 * {low} >= {PERCENT} * {high} AND CASE WHEN {high} <= {SECOND} THEN 100 * {overlap} >= {PERCENT} * ({low} + {high} - {overlap}) "
        f"ELSE {overlap} >= {SECOND} * {p} - {SLACK} * sqrt({SECOND} * {p} * (1 - {p})) END"
    )


def inverted_lists(sets: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """``(index, shared)``: prefix entries ``(value, rep, n, m)`` and, per document, its values that others share.

    Values are ranked from rare to common. Two documents that share ``t`` sketch values share one among each
    other's first ``k - t + 1``, so only those enter the lists; values of one document alone cannot match.
    """
    values = sets.select("rep", F.explode("sketch").alias("value"))
    frequent = stage(values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "frequent")
    ranked = values.join(frequent, "value").groupBy("rep").agg(F.array_sort(F.collect_set(F.struct("df", "value"))).alias("ranked"))
    shared = stage(
        ranked.join(sets.select("rep", "n").distinct(), "rep")
        .withColumn("first", F.expr(f"int(size(ranked) - {needed(size)} + 1)")).where("first > 0")
        .select("rep", "n", F.expr("slice(ranked.value, 1, first)").alias("prefix"), F.col("ranked.value").alias("common")),
        "shared",
    )
    index = shared.select(F.explode("prefix").alias("value"), "rep", "n", F.size("common").alias("m"))
    return index, shared.select("rep", "n", "common")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets reach the similarity."""
    width, percent = SHINGLE, PERCENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, other = None, None
        for batch in batches:
            ids = batch.column("b").to_pylist()
            change = [i for i, x in enumerate(ids) if i == 0 or x != ids[i - 1]]
            heads = iter([shingle_set(words, width) for _, words, *_ in rows_of_words(batch.column("text_b").take(pa.array(change)), lower=True)])
            keep, starts = [], set(change)
            for i, words, *_ in rows_of_words(batch.column("text_a"), lower=True):
                if i in starts:
                    other = next(heads)
                own = shingle_set(words, width)
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(own) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    joined = pairs.join(texts.selectExpr("rep AS a", "text AS text_a"), "a").join(texts.selectExpr("rep AS b", "text AS text_b"), "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def open_lists(members: DataFrame) -> DataFrame:
    """``value, m`` of the lists whose members are not all connected yet."""
    lists = members.groupBy("value").agg(F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high"))
    return stage(lists.where("low <> high").select("value", "m"), "open")


def with_components(index: DataFrame, linked: DataFrame) -> DataFrame:
    named = index.join(linked.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return stage(named.withColumn("component", F.coalesce("component", "rep")), "members")


def hub_pairs(members: DataFrame, shared: DataFrame, order: str) -> DataFrame:
    """Each member of an open list beside the hub of its list and size class, where the sketches allow a link.

    The hub is the first member by ``order``. A list of ``m`` members gives fewer than ``m`` pairs.
    """
    step = F.floor(F.log(F.col("n").cast("double")) / -F.log(F.lit(PERCENT / 100)))
    asked = stage(members.join(open_lists(members).select("value"), "value").withColumn("step", step), "asked")
    hubs = stage(asked.groupBy("value", "step").agg(F.min(F.struct(F.expr(order).alias("o"), "rep", "component")).alias("hub")), "hubs")
    pairs = asked.join(hubs, ["value", "step"]).where("component <> hub.component").select(F.col("rep").alias("a"), F.col("hub.rep").alias("b")).distinct()
    left = shared.selectExpr("rep AS a", "n AS n_a", "common AS common_a")
    right = shared.selectExpr("rep AS b", "n AS n_b", "common AS common_b")
    sized = pairs.join(left, "a").join(right, "b").selectExpr(
        "a", "b", "least(n_a, n_b) AS low", "greatest(n_a, n_b) AS high", "size(array_intersect(common_a, common_b)) AS overlap"
    )
    return sized.where(sufficient_sql("low", "high", "overlap")).select("a", "b")


def block_pairs(members: DataFrame, shared: DataFrame) -> DataFrame:
    """Candidate pairs of members of one list that no link connects yet.

    Lists whose members are all connected are done. The others are compared whole, in pairs of blocks of bounded
    size that spread a long list over many tasks. A task holds two blocks and emits only pairs whose union
    sketch and sizes allow the similarity, each in the list of the first value that both prefixes share.
    """
    lists = stage(open_lists(members).select("value", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "blocks")
    dealt = members.join(lists, "value").withColumn("block", F.expr("pmod(hash(rep), blocks)"))
    dealt = dealt.select("value", "rep", "n", "component", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    dealt = dealt.select("value", "rep", "component", "n", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    full = dealt.join(shared.select("rep", "common"), "rep")

    def compare(value: int, ids: np.ndarray, comps: np.ndarray, sizes: np.ndarray, common: list) -> tuple[np.ndarray, np.ndarray]:
        # incidence of values that two members share, of all of them and of those ranked before this list's
        owner = np.repeat(np.arange(len(ids)), [len(x) for x in common])
        _, code, count = np.unique(np.concatenate(common), return_inverse=True, return_counts=True)
        often = count[code] > 1
        column = (np.cumsum(count > 1) - 1)[code[often]]
        grid = np.zeros((len(ids), int((count > 1).sum())), np.float32)
        earlier = np.zeros_like(grid)
        grid[owner[often], column] = 1
        ahead = np.concatenate([np.arange(len(x)) < np.flatnonzero(x == value)[0] for x in common])[often]
        earlier[owner[often][ahead], column[ahead]] = 1
        overlaps = np.where(earlier @ earlier.T == 0, grid @ grid.T, 0)
        a, b = np.nonzero(np.triu(overlaps, 1))
        fine = sufficient(np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b]), overlaps[a, b]) & (comps[a] != comps[b])
        return ids[a[fine]], ids[b[fine]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [], [])

        def flush():
            ids = np.array(held[0])
            if len(ids) < 2 or len(set(held[1])) < 2:
                return None
            first = np.unique(ids, return_index=True)[1]  # a repeated row is one member
            a, b = compare(key[0], ids[first], np.array(held[1])[first], np.array(held[2])[first], [held[3][i] for i in first])
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"]) if len(a) else None

        for batch in batches:
            values, i, j, rep, comp, size = (batch.column(c).to_pylist() for c in ("value", "i", "j", "rep", "component", "n"))
            common = batch.column("common")
            flat, at = common.flatten().to_numpy(), common.offsets.to_numpy() - common.offsets[0].as_py()
            for r in range(batch.num_rows):
                if (values[r], i[r], j[r]) != key:
                    if (out := flush()) is not None:
                        yield out
                    key, held = (values[r], i[r], j[r]), ([], [], [], [])
                held[0].append(rep[r])
                held[1].append(comp[r])
                held[2].append(size[r])
                held[3].append(flat[at[r] : at[r + 1]])
        if (out := flush()) is not None:
            yield out

    return full.select("value", "i", "j", "rep", "component", "n", "common").repartition("value", "i", "j").sortWithinPartitions("value", "i", "j").mapInArrow(
        run, "a long, b long"
    ).distinct()


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents with equal shingle sets are one node, named by their smallest id. Inverted lists of bottom-k values
    find the nodes that can have a partner, and lists of their longer sketches pair them: members are first linked to hubs of their list, then lists with unconnected members are
    compared in blocks. Overlaps of union sketches filter, full sets confirm, and ``component_id`` is the smallest id
    that confirmed links reach. ``kept`` marks that document.

    Words split at ASCII white space and only A-Z is lower-cased. Texts under five words are one shingle; null or
    blank texts have none, link with nothing and stay. Ids are taken as unique: rows that repeat an id share
    its component, and a row without an id can copy another but never hold a group together. Other columns are ignored.
    """
    found = stage(sketches(docs, FIRST), "sketches")
    groups = stage(found.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL"), "groups")
    sets = stage(found.join(groups, "set_id").where("doc_id = rep").select("rep", "n", "sketch"), "sets")
    wanted = stage(inverted_lists(sets, FIRST)[0].select("rep").distinct(), "wanted")
    bodies = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    texts = stage(likely_members(bodies, F.col("rep"), wanted, F.col("rep")).join(wanted, "rep"), "texts")
    closer = stage(sketches(texts.withColumnRenamed("rep", "doc_id"), SECOND).select(F.col("doc_id").alias("rep"), "n", "sketch"), "closer")
    index, shared = inverted_lists(closer, SECOND)
    members = index.withColumn("component", F.col("rep"))
    linked = None
    for order in HUBS:
        links = stage(verified(hub_pairs(members, shared, order), texts), "verified")
        linked = stage(components(links if linked is None else linked.selectExpr("node AS a", "component AS b").unionByName(links)), "components")
        members = with_components(index, linked)
    rest = verified(block_pairs(members, shared), texts)
    final = stage(components(linked.selectExpr("node AS a", "component AS b").unionByName(rest)), "components")
    named = found.select("doc_id", "n", "set_id").join(groups, "set_id", "left")
    out = named.join(final.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies, with all their columns; ids are taken as unique."""
    kept = near_dedup(docs).where("kept").select(F.col("doc_id").alias("kept_id"))
    return docs.join(kept, docs.doc_id.eqNullSafe(kept.kept_id), "left_semi")
