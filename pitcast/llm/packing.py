"""Packing of tokenized documents into sequences with lexically related neighbours."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitcast.llm.chunks import ChunkTable, kept_table, ragged
from pitcast.llm.common import stage
from pitcast.llm.tokens import LOWER, STEP, column_bytes, slices

LENGTH = 2048
END_ID = 1
#: Documents of one shard of the inverted index.
SHARD_ROWS = 256
K1, B = 1.2, 0.75
#: Words that a worker process keeps with their ids, about 80 MB.
KNOWN_WORDS = 400_000
#: Words that one call of the tokenizer encodes.
JOINED = 512
#: Last entries of the vocabulary, one of which stands between words.
RARE = 1_000
#: A pre-tokenizer's pattern that parts letters from all else, but for endings after an apostrophe.
LETTERS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def word_encoder(tokenizer) -> Callable[[list[bytes]], list[list[int]]]:
    """A function that returns the ids of each word.

    Words are encoded together with a special token between them, which the tokenizer takes out before it normalises what
    lies between. Words that share a character with the token's ends, and all words of a tokenizer without one, are encoded one by one.
    """
    special = [(i, t.content) for i, t in tokenizer.get_added_tokens_decoder().items() if t.special and not (t.normalized or t.single_word or t.lstrip or t.rstrip)]
    mark_id, mark = special[0] if special else (None, None)

    def apart(words: list[str]) -> list[list[int]]:
        return [x.ids for x in tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def together(words: list[str]) -> list[list[int]]:
        ids = tokenizer.encode_batch_fast([mark.join(words)], add_special_tokens=False)[0].ids
        cuts = np.flatnonzero(np.array(ids, np.int64) == mark_id).tolist()
        if len(cuts) != len(words) - 1:
            return apart(words)
        return [ids[a + 1 : b] for a, b in zip([-1, *cuts], [*cuts, len(ids)])]

    def encode(words: list[bytes]) -> list[list[int]]:
        texts = [w.decode() for w in words]
        if mark is None:
            return apart(texts)
        unlike = [i for i, w in enumerate(texts) if mark[0] in w or mark[-1] in w]
        own = dict(zip(unlike, apart([texts[i] for i in unlike])))
        plain = [w for i, w in enumerate(texts) if i not in own]
        rest = (ids for at in range(0, len(plain), JOINED) for ids in together(plain[at : at + JOINED]))
        return [own[i] if i in own else next(rest) for i in range(len(texts))]

    return encode


def parting_word(tokenizer) -> tuple[str, int] | None:
    """A short word of letters that is one token by itself, and that token; from the end of the vocabulary, where words are rare."""
    n = tokenizer.get_vocab_size(with_added_tokens=False)
    # without marks of a word's start or end
    named = [(max(re.findall("[a-z]+", tokenizer.id_to_token(i) or ""), key=len, default=""), i) for i in range(max(0, n - RARE), n)]
    for word, i in sorted(named, key=lambda x: len(x[0])):
        if len(word) > 2 and all(x.ids == [i] for x in tokenizer.encode_batch_fast([word, f" {word} "], add_special_tokens=False)):
            return word, i
    return None


def end_tokens(tokenizer) -> np.ndarray | None:
    """Whether each token ends a word of letters; None if the model marks no ends or has no token for some byte, so that words could go unseen."""
    from tokenizers.pre_tokenizers import ByteLevel

    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    letters = ByteLevel.alphabet()
    whole = suffix and "ByteLevel(" in repr(tokenizer.pre_tokenizer) and all(tokenizer.token_to_id(x + end) is not None for x in letters for end in ("", suffix))
    return np.array([(tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(tokenizer.get_vocab_size())]) if whole else None


def flat_word_encoder(tokenizer) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """A function that returns the ids of all words one after another, and the number of ids of each.

    Words are encoded together, parted by spaces as in a text. Words of letters alone are told apart by their end tokens: each has one at
    least, so as many ends as words are one for each. Between other words stands a known word, which is always its one token, so a
    group with no more of these tokens than places between words has them nowhere else. Groups with other counts go to :func:`word_encoder`.
    """
    encode, mark, ends = word_encoder(tokenizer), parting_word(tokenizer), end_tokens(tokenizer)

    def ids_of(text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def parted(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if mark:
            ids = ids_of(f" {mark[0]} ".join(words))
            cuts = np.flatnonzero(ids == mark[1])
            if len(cuts) == len(words) - 1:
                return np.delete(ids, cuts), np.diff(cuts, prepend=-1, append=len(ids)) - 1
        own = encode([w.encode() for w in words])
        return np.array([i for x in own for i in x], np.uint32), np.array([len(x) for x in own], np.int64)

    def ended(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if ends is not None:
            ids = ids_of(" ".join(words))
            cuts = np.flatnonzero(ends[ids])
            if len(cuts) == len(words):
                return ids, np.diff(cuts, prepend=-1)
        return parted(words)

    def encode_all(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.fromiter(map(str.isalpha, words), bool, len(words))
        kinds = [(ended, np.flatnonzero(plain)), (parted, np.flatnonzero(~plain))]
        ids, sizes = zip(*(how([words[i] for i in own[at : at + JOINED]]) for how, own in kinds for at in range(0, len(own), JOINED)))
        ids, sizes, order = np.concatenate(ids), np.concatenate(sizes), np.argsort(np.concatenate([own for _, own in kinds]))
        starts = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        return ids[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))], sizes

    return encode_all


def byte_kinds(tokenizer) -> tuple[np.ndarray, np.ndarray] | None:
    """Kind of each byte (0 letters, 1 others, 2 those that keep a word whole) and its lower case where the tokenizer takes it.

    A word of ASCII is then encoded as its runs of kinds are, one after another. None if that is not known of the tokenizer. Words
    that are not ASCII, have an apostrophe or may hold an added token stay whole.
    """
    config = json.loads(tokenizer.to_str())
    first, normalizer = config["pre_tokenizer"] or {}, config["normalizer"] or {"type": "Sequence", "normalizers": []}
    steps = first.get("pretokenizers", [])
    parted = [x["type"] for x in steps] == ["Split", "ByteLevel"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
    parted = parted and steps[0] == {"type": "Split", "pattern": {"Regex": LETTERS_APART}, "behavior": "Removed", "invert": True}
    changes = [x for x in normalizer.get("normalizers", [normalizer]) if x != {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}]
    if not parted or any(x["type"] not in ("NFC", "Lowercase") for x in changes):
        return None
    kinds = np.where((LOWER >= ord("a")) & (LOWER <= ord("z")), 0, 1).astype(np.uint8)
    kinds[128:] = 2
    for c in "'" + "".join(x["content"][:1] for x in config["added_tokens"]):
        kinds[[x for both in (c.lower(), c.upper()) for x in both.encode()]] = 2
    return kinds, LOWER if {"type": "Lowercase"} in changes else np.arange(256, dtype=np.uint8)


def word_parts(words: pa.LargeStringArray, kinds: np.ndarray, lower: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """Runs of one kind of byte, in lower case, of all words one after another, and how many each word has."""
    data, at = column_bytes(words)
    data, at = data[at[0] : at[-1]], at - at[0]
    kind = kinds[data]
    whole = np.diff(np.concatenate(([0], np.cumsum(kind == 2)))[at]) > 0
    kept = np.repeat(whole, np.diff(at))
    cut = np.append(False, kind[1:] != kind[:-1])[: len(data)] & ~kept
    cut[at[:-1][np.diff(at) > 0]] = True
    edges = np.append(np.flatnonzero(cut), len(data)).astype(np.int64)
    text = np.where(kept, data, lower[data])
    parts = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(text)])
    return parts, np.diff(np.concatenate(([0], np.cumsum(cut)))[at])


def encoded(words: pa.LargeStringArray, table: ChunkTable, kinds: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words one after another, and the number of ids of each; ``table`` holds their parts, or whole words without ``kinds``."""
    words = words.dictionary_encode()
    at_word = words.indices.to_numpy()
    parts, held = word_parts(words.dictionary, *kinds) if kinds else (words.dictionary, np.ones(len(words.dictionary), np.int64))
    parts = parts.dictionary_encode()
    at_part = parts.indices.to_numpy()
    # words hold no line ends, and one split is cheaper than as many conversions
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(parts.dictionary)], parts.dictionary), pa.scalar("\n", pa.large_string()))
    named = joined[0].as_py().split("\n")[: len(parts.dictionary)]
    times = np.bincount(at_part, np.repeat(np.bincount(at_word, minlength=len(held)), held), len(named))
    ids, sizes = table.expand(table.positions(named, times)[at_part])
    edges = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(held)))]
    return ragged(ids, edges[:-1][at_word], np.diff(edges)[at_word]), np.diff(edges)[at_word]


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """``doc_id, ids``: little-endian unsigned 32-bit token ids of the whole text and the end id.

    The tokenizer must drop white space and never join across it, so a word is encoded when it is new to the worker process.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        def new_table() -> tuple:
            tokenizer = Tokenizer.from_file(tokenizer_path)
            return ChunkTable(flat_word_encoder(tokenizer), KNOWN_WORDS), byte_kinds(tokenizer)

        table, kinds = kept_table(("packing", tokenizer_path), new_table)
        for batch in batches:
            _, at = column_bytes(batch.column("text"))
            for first, last in slices(at, 4 * STEP):
                # splits at the white space of ASCII, which leaves empty words at a text's ends
                split = pc.ascii_split_whitespace(batch.column("text").slice(first, last - first).cast(pa.large_string()))
                counts = split.offsets.to_numpy() - split.offsets[0].as_py()
                ids, sizes = encoded(split.flatten(), table, kinds)
                ends = np.concatenate(([0], np.cumsum(sizes)))[counts]
                out = [np.append(ids[a:b], np.uint32(end_id)).astype("<u4").tobytes() for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array(out, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def document_frequencies(pieces: DataFrame) -> tuple[np.ndarray, int, float]:
    """How many pieces hold each token, the number of pieces and their mean length; its size is the vocabulary's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1, np.int64)
        for batch in batches:
            data, at = column_bytes(batch.column("ids"))
            found = [np.unique(data[a:b].view("<u4")) for a, b in zip(at[:-1], at[1:])]
            if found:
                more = np.bincount(np.concatenate(found))
                counts = np.pad(counts, (0, max(0, len(more) - len(counts))))
                counts[: len(more)] += more
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["token", "df"])

    rows = pieces.select("ids").mapInArrow(run, "token long, df long").groupBy("token").agg(F.sum("df").alias("df")).toPandas()
    total = pieces.agg(F.count("*").alias("n"), F.avg(F.length("ids") / 4).alias("mean")).first()
    df = np.zeros(int(rows.token.max()) + 1 if len(rows) else 1)
    df[rows.token.to_numpy()] = rows.df
    return df, total.n, total["mean"] or 1.0


def relevance(texts: list[np.ndarray], df: np.ndarray, n: int, mean: float) -> np.ndarray:
    """BM25 scores of every text of a shard (columns) for every text as the query (rows), from an inverted index."""
    terms = [np.unique(x, return_counts=True) for x in texts]
    owner = np.repeat(np.arange(len(texts)), [len(t) for t, _ in terms])
    token, count = np.concatenate([t for t, _ in terms]), np.concatenate([c for _, c in terms]).astype(np.float64)
    names, column, held = np.unique(token, return_inverse=True, return_counts=True)
    size = np.array([len(x) for x in texts], np.float64)[owner]
    idf = np.log1p((n - df[token] + 0.5) / (df[token] + 0.5))
    weight = idf * count * (K1 + 1) / (count + K1 * (1 - B + B * size / mean))
    often = held[column] > 1  # a posting list of one document relates nothing
    index = (np.cumsum(held > 1) - 1)[column[often]]
    postings = np.zeros((len(texts), int((held > 1).sum())), np.float32)
    query = np.zeros_like(postings)
    postings[owner[often], index] = weight[often]
    query[owner[often], index] = 1
    return query @ postings.T


def fill(sizes: np.ndarray, scores: np.ndarray, length: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of ``(text, start, size)``: each seed, the longest unused text, then its best unused neighbours.

    Neighbours that fit are taken whole in order of relevance; what room is left goes to the most relevant one that did
    not fit, which is cut and stays available with its rest. Only the last sequence can end short.
    """
    left, start = sizes.copy(), np.zeros_like(sizes)
    out = []
    while left.any():
        seed = int(left.argmax())
        room, row = length - int(left[seed]), [(seed, int(start[seed]), int(left[seed]))]
        left[seed] = 0
        ranked = np.argsort(-scores[seed], kind="stable")
        ranked = ranked[left[ranked] > 0]
        for i in ranked.tolist():
            if not room:
                break
            if left[i] <= room:
                row.append((i, int(start[i]), int(left[i])))
                room -= int(left[i])
                left[i] = 0
        rest = ranked[left[ranked] > 0]
        if room and len(rest):
            i = int(rest[0])
            row.append((i, int(start[i]), room))
            start[i] += room
            left[i] -= room
        out.append(row)
    return out


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset``: every token once, in sequences of ``length``.

    A document's full stretches of ``length`` tokens are sequences of their own. What remains of each document is
    dealt to shards by row; a shard is a BM25 inverted index with the corpus statistics of all remainders, in which
    each seed retrieves the unused neighbours that fill its window. Only a shard's last sequence is padded.

    A null or blank text is its end id alone. Rows are packed as they come: repeated rows and ids, and null ids, each keep
    their own tokens; other columns are ignored. An empty table gives no rows.
    """
    rows = tokenized(docs, tokenizer_path, end_id).withColumn("row", F.monotonically_increasing_id())
    rows = stage(rows.withColumn("doc_tokens", (F.length("ids") / 4).cast("long")), "tokens")
    full = rows.where(f"doc_tokens >= {length}").select(
        "doc_id", "ids", "doc_tokens", F.explode(F.expr(f"sequence(0L, doc_tokens div {length} - 1)")).alias("k")
    ).select(
        "doc_id", (F.col("k") * length).alias("start"), F.lit(length).cast("long").alias("length"),
        F.expr(f"substring(ids, int(k * {4 * length}) + 1, {4 * length})").alias("ids"), "doc_tokens",
        (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    tails = rows.where(f"doc_tokens % {length} > 0").select(
        "doc_id", "row", "doc_tokens", (F.col("doc_tokens") - F.col("doc_tokens") % length).alias("start"),
        F.expr(f"substring(ids, int((doc_tokens - doc_tokens % {length}) * 4) + 1, int(doc_tokens % {length}) * 4)").alias("ids"),
    )
    df, n, mean = document_frequencies(tails)
    shards = max(1, -(-n // SHARD_ROWS))

    def run(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("row", ignore_index=True)
        texts = [np.frombuffer(x, "<u4") for x in shard.ids]
        out = []
        for k, row in enumerate(fill(np.array([len(x) for x in texts]), relevance(texts, df, n, mean), length)):
            at = 0
            for i, first, size in row:
                out.append((shard.doc_id[i], shard.start[i] + first, size, texts[i][first : first + size].tobytes(), shard.doc_tokens[i], 2 * ((key[0] << 24) + k), at))
                at += size
        return pd.DataFrame(out, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]).astype({"doc_id": shard.doc_id.dtype})

    packed = tails.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).groupBy("shard").applyInPandas(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
    return full.unionByName(packed)
