"""SentencePiece encoding and decoding through tables of distinct marked words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitcast.llm.chunks import ChunkTable
from pitcast.llm.tokens import column_bytes, slices

MARK = "▁"
#: A line feed, spaces with the word they mark, or spaces alone.
CHUNK = re.compile("\n| *[^ \n]+| +")


def load(model_path: str):
    """The model, if none of its pieces joins a word to a later marker or to a line feed and it changes no text."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    model = SentencePieceProcessor(model_file=model_path)
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(model.serialized_model_proto())
    crossing = [x.piece for x in spec.pieces if re.search(f"[^{MARK}]{MARK}|\n", x.piece) or x.type == 4]
    plain = spec.normalizer_spec.add_dummy_prefix and not spec.normalizer_spec.remove_extra_whitespaces and not spec.normalizer_spec.precompiled_charsmap
    if crossing or not plain or not spec.trainer_spec.byte_fallback or spec.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError(f"the model's pieces can cross white space or it rewrites text: {crossing[:5]}")
    return model


def chunk_codec(model):
    """Functions that encode distinct chunks and decode the ids of one chunk, both by the library."""
    feed = model.encode("\n")  # the marker and the line feed's byte, which nothing merges with
    space = model.piece_to_id(MARK)

    def encode(chunks: list[str]) -> list[list[int]]:
        # the library puts a marker before each text, which stands for a chunk's first space
        marked = [x[1:] if x[0] == " " else "\n" + x for x in chunks]
        out = model.encode(marked, num_threads=1)
        return [[space] if x == " " else ids if x[0] == " " else ids[len(feed):] for x, ids in zip(chunks, out)]

    def decode(ids: list[int]) -> str:
        return model.decode(feed + ids)[1:]

    return encode, decode


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids, decoded``: ids with begin and end as little-endian unsigned 32-bit integers, and their text.

    Pieces cannot cross white-space markers, so a task segments each distinct marked word once, decodes its ids once,
    and joins both back by position; a whole text is never segmented at once. Results equal the library's on
    the whole text. Null texts are empty: begin and end alone. Rows are taken one by one, so repeated rows, repeated or
    null ids need no rule, and other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        encode, decode = chunk_codec(model)
        table = ChunkTable(encode)
        begin, end = model.bos_id(), model.eos_id()
        known: list[str] = []
        generation = table.generation
        for batch in batches:
            data, at = column_bytes(batch.column("text"))
            for first, last in slices(at):
                bodies = [data[at[i] : at[i + 1]].tobytes().decode().replace(MARK, " ") for i in range(first, last)]
                chunks = [CHUNK.findall(" " + x) if x else [] for x in bodies]
                rows = table.positions([c for own in chunks for c in own])
                if generation != table.generation:
                    known, generation = [], table.generation
                fresh = slice(len(known), len(table.rows))
                known += [decode(table.ids[s : s + n].tolist()) for s, n in zip(table.starts[fresh].tolist(), table.sizes[fresh].tolist())]
                edge = np.cumsum([0, *map(len, chunks)])
                ids, sizes = table.expand(rows)
                ends = np.concatenate(([0], np.cumsum(sizes)))[edge]
                places, out, texts = rows.tolist(), [], []
                for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                    out.append(np.concatenate(([begin], ids[a:b], [end])).astype("<u4").tobytes())
                    texts.append("".join([known[r] for r in places[edge[i] : edge[i + 1]]])[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.array(out, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"]
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, decoded string")
