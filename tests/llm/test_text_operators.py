import hashlib
import json
import random
import zlib
from collections import defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from pitcast.llm import (
    chunks, common, exact_dedup, fuzzy_lines, near_dedup, packing, quality, queries, sentencepieces, substring_dedup, suffix_array, tool_calls, toxicity,
)

WORDS, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"


def test_exact_dedup(docs, rows, result):
    assert result(exact_dedup.exact_dedup(docs)) == result(brute.exact(rows))
    named = [r for r in rows if r[0] is not None]
    kept = exact_dedup.without_copies(docs.where("doc_id IS NOT NULL"))
    assert kept.columns == docs.columns and kept.count() == sum(r[3] for r in brute.exact(named))


def test_substring_dedup(docs, rows, result, monkeypatch):
    names = ["doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256)]
    want = result(brute.substring(rows))
    assert result(substring_dedup.substring_dedup(docs).select(*names)) == want
    monkeypatch.setattr(substring_dedup, "GROUP_ROWS", 4)  # longer prefixes, and whole windows
    assert result(substring_dedup.substring_dedup(docs).select(*names)) == want


def test_substring_dedup_shuffles_only_texts_that_may_change(docs, rows, result, monkeypatch):
    from pitcast.llm import common

    names = ["doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256)]
    kept = substring_dedup.substring_dedup(docs)
    first, *_ = kept._jdf.queryExecution().optimizedPlan().children().mkString("|").split("Join Left")
    assert kept._jdf.queryExecution().optimizedPlan().nodeName() == "Union" and "kept_text" in first
    monkeypatch.setattr(common, "BITMAP", 64)  # nearly all texts seem to change
    assert result(substring_dedup.substring_dedup(docs).select(*names)) == result(brute.substring(rows))


def test_suffix_array_dedup(docs, rows, result, monkeypatch):
    want = result(brute.repeated_bytes(rows))
    assert result(suffix_array.suffix_array_dedup(docs)) == want
    monkeypatch.setattr(suffix_array, "RANGE_ROWS", 3)  # runs go on across ranges
    assert result(suffix_array.suffix_array_dedup(docs)) == want


@pytest.mark.parametrize("length", [60, 200, 1500])
def test_suffix_array_of_other_lengths(docs, rows, result, length):
    assert result(suffix_array.suffix_array_dedup(docs, length)) == result(brute.repeated_bytes(rows, length))


def test_a_passage_that_very_many_texts_share_is_settled_by_count(spark, result, monkeypatch):
    passage = " ".join(f"common{k}" for k in range(80))
    rows = [(i, f"{i * 7919} {passage} {i * 104729} and more") for i in range(400)]
    sorted_, made = [], []
    compare, settle = suffix_array.sorted_ranges, suffix_array._settled
    monkeypatch.setattr(suffix_array, "sorted_ranges", lambda records, *more: sorted_.append(records) or compare(records, *more))
    monkeypatch.setattr(suffix_array, "_settled", lambda parts, length: made.append(parts) or settle(parts, length))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(suffix_array.suffix_array_dedup(frame)) == result(brute.repeated_bytes(rows))
    # the same suffix and the same other side meet once, so few of the 400 texts' records are sorted
    assert made[1].count() >= 400 and sorted_[0].groupBy("kind", "suffix", "rest").count().where("count > 1").isEmpty()


def test_repeated_rows_with_the_smallest_id_of_a_shared_passage(spark, result):
    passage = " ".join(f"word{k}" for k in range(90))
    rows = [(1, "first " + passage), (1, "first " + passage), (2, passage + " second")] + [(None, "none " + passage + " more")] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = substring_dedup.substring_dedup(frame).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256))
    assert result(kept) == result(brute.substring(rows))
    assert result(suffix_array.suffix_array_dedup(frame)) == result(brute.repeated_bytes(rows))
    assert suffix_array.without_repeats(frame).count() == len(rows)


def test_suffix_array_texts_stay_valid(docs, rows):
    out = {(r.doc_id, r.n): r.text for r in suffix_array.without_repeats(docs).collect()}
    assert out[600, 1] is None and out[701, 1] == "" and out[603, 1] == "one two"
    assert len(out[201, 1]) < len(dict(rows)[201])


def test_near_dedup(docs, rows, result, monkeypatch):
    want = result(brute.near(rows))
    assert result(near_dedup.near_dedup(docs)) == want
    monkeypatch.setattr(near_dedup, "HUBS", ("n",))
    monkeypatch.setattr(near_dedup, "BLOCK", 2)  # lists dealt out as pairs of blocks
    assert result(near_dedup.near_dedup(docs)) == want


@pytest.mark.parametrize("limit", [4, 30, 10_000])
def test_chunk_tables_of_any_size_give_the_same_ids(limit):
    rng = np.random.default_rng(3)
    seen = []

    def encode(new):
        seen.extend(new)
        return [list(x) for x in new]

    table = chunks.ChunkTable(encode, limit)
    for _ in range(60):
        words = [b"w%d" % (k * k) for k in rng.integers(0, 25, rng.integers(0, 40))]
        ids, sizes = table.expand(table.positions(words))
        assert ids.tolist() == [i for w in words for i in w] and sizes.tolist() == [len(w) for w in words]
    assert limit < 25 or len(seen) == len(set(seen))


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert common.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_components_of_stars_take_no_round(spark, monkeypatch):
    staged, write = [], common.stage
    monkeypatch.setattr(common, "stage", lambda df, name: staged.append(name) or write(df, name))
    stars = [(i, i // 10 * 10) for i in range(40)] + [(100, 105), (0, 3)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {**{i: i // 10 * 10 for i in range(40)}, 100: 100, 105: 100} and staged == ["links"]
    staged.clear()
    got = {r.node: r.component for r in common.components(spark.createDataFrame([(b"c", b"b"), (b"b", b"a")], "a binary, b binary")).collect()}
    assert set(map(bytes, got.values())) == {b"a"} and staged == ["links"] * 2


def test_fuzzy_lines(docs, rows, result):
    assert result(fuzzy_lines.fuzzy_line_dedup(docs)) == result(brute.fuzzy_lines(rows))
    texts = {r.doc_id: r.text for r in fuzzy_lines.without_lines(docs.where("doc_id IN (500, 501, 600)")).collect()}
    assert texts[500].count("\n") == 0 and texts[501] == "" and texts[600] is None


def test_edits_in_pieces_and_between_ends_against_plain_edit_distance(spark):
    draw = random.Random(3)
    rows = []
    for _ in range(150):
        words = ["".join(draw.choices("aeinst\u00e9\u4e2d\U0001f600", k=draw.randint(1, 8))) for _ in range(draw.choice((1, 3, 20, 90)))]
        if draw.random() < 0.2:
            words = words[:1] * len(words)
        other = list(words)
        for _ in range(draw.choice((1, 2, 6, 20))):
            i = draw.randrange(len(other) + 1)
            other[i : i + draw.randint(0, 3)] = draw.choices(["new", "an", "e", words[0]], k=draw.randint(0, 3))
        a, b = " ".join(words), " ".join(other)
        rows += [(a, b, int(0.1 * max(len(a), len(b))))] * (a != b)
    frame = spark.createDataFrame(rows, "a string, b string, most int")
    found = frame.select("a", "b", "most", *[F.expr(f("a", "b", "most")) for f in (fuzzy_lines.edits_in_pieces, fuzzy_lines.edits_between_ends)]).collect()
    settled = 0
    for a, b, most, pieces, between in found:
        edits = brute.edit_distance(a, b, most)
        assert between == (edits if edits <= most else -1)
        assert pieces is None or pieces >= edits
        settled += edits <= most and pieces is not None and pieces <= most
    linked = sum(x[4] >= 0 for x in found)
    assert linked > 30 and settled >= 0.9 * linked
    pairs, texts = [], {}
    for a, b, *_ in rows:
        pairs.append((texts.setdefault(a, len(texts)), texts.setdefault(b, len(texts))))
    texts = spark.createDataFrame([(i, x) for x, i in texts.items()], "id long, norm string")
    got = {(r.a, r.b) for r in fuzzy_lines.verified(spark.createDataFrame(sorted(set(pairs)), "a long, b long"), texts).collect()}
    assert got == {p for p, x in zip(pairs, found) if x[4] >= 0}


@pytest.mark.parametrize("group", [fuzzy_lines.GROUP, 3])
def test_fuzzy_lines_against_plain_edit_similarity(spark, result, monkeypatch, group):
    """Changed, dropped and added words and letters in lines of all lengths; links by edit similarity alone are the truth."""
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("aeioubcdlmnrstäж"), rng.integers(2, 10))) for _ in range(500)]
    base = [[vocabulary[k] for k in rng.integers(0, 500, n)] for n in [3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 55, 90] * 4]
    shared = [vocabulary[k] for k in rng.integers(0, 500, 12)]  # a passage that unlike lines share
    base += [shared + [vocabulary[k] for k in rng.integers(0, 500, 20)] for _ in range(12)]
    rows = []
    for i, line in enumerate(base):
        rows.append((10 * i, " ".join(line)))
        for k in range(1, 4):
            changed, kind = list(line), rng.integers(0, 3)
            for _ in range(max(1, len(line) * k // 40)):
                at = int(rng.integers(0, len(changed)))
                word = changed[at]
                changed[at : at + 1] = ([word[:1] + "q" + word[2:]], [], [word, "et"])[kind]
            rows.append((10 * i + k, " ".join(changed)))
    rows += [(9000, "春眠不覺曉處處聞啼鳥夜來風雨聲花落知多少"), (9001, "春眠不覺曉處處聞啼鳥夜來風雨聲花落知多了"), (9002, "chapter seventeen"), (9003, "chapter seventeem")]
    # a thousand equal lines, and many short ones that share all but one word
    rows += [(10000 + i, "the same line in very many places") for i in range(300)] + [(11000 + i, f"page {vocabulary[i]} footer") for i in range(60)]
    monkeypatch.setattr(fuzzy_lines, "GROUP", group)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got, want = dict((r[0], r[2]) for r in fuzzy_lines.fuzzy_line_dedup(frame).collect()), dict((r[0], r[2]) for r in brute.fuzzy_lines(rows))
    found, planted = sum(got.values()), sum(want.values())
    assert planted > 400 and all(want[i] or not n for i, n in got.items())
    near = sum(n for i, n in want.items() if i < 9000)
    assert sum(n for i, n in got.items() if i < 9000) >= 0.97 * near and found >= 0.97 * planted


def test_fuzzy_lines_do_not_depend_on_the_size_of_blocks(spark, result, monkeypatch):
    """Lines whose only common stretches lie in one passage that all lines share, so they meet in large groups alone."""
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("aeioubcdlmnrst"), 6)) for _ in range(900)]
    passage, rows = vocabulary[:24], []
    for i in range(40):
        line = [vocabulary[k] for k in rng.integers(24, 900, 20)]
        rows += [(2 * i, " ".join(passage + line)), (2 * i + 1, " ".join(passage + [w if k % 4 else "q" + w[1:] for k, w in enumerate(line)]))]
    frame, want = spark.createDataFrame(rows, "doc_id long, text string"), result(brute.fuzzy_lines(rows))
    found = {}
    for group in (3, 512):
        monkeypatch.setattr(fuzzy_lines, "GROUP", group)
        found[group] = result(fuzzy_lines.fuzzy_line_dedup(frame))
    assert found[3] == found[512]
    assert sum(r[2] for r in found[3]) >= 0.9 * sum(r[2] for r in want) >= 0.9 * 40


def test_fuzzy_lines_hand_on_no_pairs_that_are_near_but_not_linked(spark, result, monkeypatch):
    """Unlike lines around one passage are decided where they meet; only their number, and not its square, goes on to texts."""
    rng = np.random.default_rng(17)
    vocabulary = ["".join(rng.choice(list("aeioubcdlmnrst"), 6)) for _ in range(900)]
    passage, rows, seen, plain = vocabulary[:24], [], [], fuzzy_lines.verified
    for i in range(60):
        line = passage + [vocabulary[k] for k in rng.integers(24, 900, 6)]
        rows += [(10 * i, " ".join(line))] + [(10 * i + 1, " ".join(line[:-1] + ["q" + line[-1][1:]]))] * (i < 5)
    monkeypatch.setattr(fuzzy_lines, "verified", lambda pairs, texts: seen.append(pairs.count()) or plain(pairs, texts))
    got = result(fuzzy_lines.fuzzy_line_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == result(brute.fuzzy_lines(rows)) and sum(r[2] for r in got) >= 5
    assert sum(seen) <= fuzzy_lines.KEPT * len(rows)


def test_quality_statistics(docs, rows, result):
    got = quality.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert result(got) == result([(i, *brute.statistics(t)) for i, t in rows])


def test_quality_rejects_outliers_of_a_group(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(words, n))
    good = [(i, text(int(rng.integers(60, 400))), "en", f"s{i % 3}") for i in range(240)]
    junk = [(1000 + i, " | ".join(rng.choice(words, 120)), "en", f"s{i % 3}") for i in range(45)]
    odd = [(2000, "w" * 4000 + " " + " ".join("w" * (200 + k) for k in range(60)), "en", "s0")]
    out = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(good + junk + odd, "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[i] for i, *_ in good) and not any(out[i] for i, *_ in junk + odd)


def test_quality_rejects_an_outlier_on_each_axis_of_a_group_without_spread(spark):
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(3000)]
    text = lambda n: [str(w) for w in rng.choice(words, n, replace=False)]
    with_symbols = lambda n, k: " ".join([w[:4] + "#" for w in text(k)] + text(n - k))
    with_lines = lambda n, k: "\n".join(x for w in text(k) for x in ("again", w)) + "\n" + " ".join(text(n - 2 * k))
    block = text(15)
    odd = {
        "repeats": " ".join(block + text(20) + block + text(20) + block + text(15)), "symbols": with_symbols(100, 3),
        "dup_lines": with_lines(100, 21), "word_length": " ".join(w + "xx" for w in text(100)),
    }
    fair = [with_symbols(50, 1), with_lines(50, 2), " ".join(block[:6] + text(60) + block[:6])]
    rows = [(f"clean{i}", " ".join(text(100))) for i in range(60)] + [(f"fair{i}", t) for i, t in enumerate(fair)] + list(odd.items())
    frame = spark.createDataFrame([(n, t, "en", "s") for n, t in rows], "doc_id string, text string, lang string, source string")
    out = {r.doc_id: r for r in quality.quality_rules(frame).collect()}
    assert not any(r.base_failed for r in out.values())
    assert {n for n, r in out.items() if not r.kept} == set(odd)


def test_packing_round_trip(docs, rows):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(WORDS)
    tokenizer = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path, length=256).collect()
    by_text, used = defaultdict(list), defaultdict(list)
    for r in pieces:
        assert len(r.ids) == 4 * r.length <= 4 * 256
        by_text[r.doc_id].append(r)
        used[r.sequence_id].append(r)
    want = defaultdict(list)
    for i, t in rows:
        want[i] += [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    for i, ids in want.items():
        got = np.concatenate([np.frombuffer(r.ids, "<u4") for r in by_text[i]])
        assert sorted(got) == sorted(ids)
        if len({(j, t) for j, t in rows if j == i}) == 1 and sum(j == i for j, _ in rows) == 1:
            ordered = sorted(by_text[i], key=lambda r: r.start)
            assert [r.start for r in ordered] == list(np.cumsum([0, *[r.length for r in ordered]])[:-1])
            assert b"".join(r.ids for r in ordered) == np.array(ids, "<u4").tobytes() and {r.doc_tokens for r in ordered} == {len(ids)}
    short = 0
    for own in used.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == list(np.cumsum([0, *[r.length for r in own]])[:-1])
        short += sum(r.length for r in own) < 256
    assert short <= 1  # one shard, padded once


def test_packing_encodes_many_words_in_one_call(monkeypatch):
    from tokenizers import Tokenizer

    tokenizer, calls = Tokenizer.from_file(queries.tokenizer_path(WORDS)), []

    class Counted:
        get_added_tokens_decoder = staticmethod(tokenizer.get_added_tokens_decoder)

        @staticmethod
        def encode_batch_fast(texts, add_special_tokens):
            calls.append(len(texts))
            return tokenizer.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    words = ["", "plain", "Word,", "don't", "é́", "x\xa0y", "\xa0", "<|endoftext|>", "a<|endoftext|>b", "<|", "|>", ">", "<|endoftext", "春眠", "\x00", "\x85", "\u0301e"]
    words += [f"w{k}" for k in range(300)]
    want = [tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    assert packing.word_encoder(Counted)([w.encode() for w in words]) == want
    assert len(calls) == 2 and sum(calls) < 10
    monkeypatch.setattr(packing, "JOINED", 2)
    assert packing.word_encoder(tokenizer)([w.encode() for w in words]) == want
    Counted.get_added_tokens_decoder = staticmethod(dict)
    assert packing.word_encoder(Counted)([w.encode() for w in words]) == want


@pytest.mark.parametrize("joined", [packing.JOINED, 2, 1])
def test_packing_parts_words_by_a_word(monkeypatch, joined):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "JOINED", joined)
    tokenizer = Tokenizer.from_file(queries.tokenizer_path(WORDS))
    mark, token = packing.parting_word(tokenizer)
    words = ["", "plain", "Word,", "don't", "é́", "x\xa0y", "\xa0", "<|endoftext|>", "a<|endoftext|>b", "<|", "春眠", "\x00", "\x85", "\u0301e", "", "Σας", "İstanbul", "ªº", "aٱb"]
    words += [f"w{k}" for k in range(30)] + ["ab" + chr(97 + k) for k in range(20)]
    for more in ([], [mark], [mark.upper() + ",", mark * 2], [f"{mark}.{mark}", f"a{mark}"]):  # the word itself in a text
        want = [tokenizer.encode(w, add_special_tokens=False).ids for w in words + more]
        ids, sizes = packing.flat_word_encoder(tokenizer)(words + more)
        assert ids.tolist() == [i for own in want for i in own] and sizes.tolist() == [len(own) for own in want]
    assert tokenizer.encode(f"{words[1]} {mark} {words[2]}", add_special_tokens=False).ids.count(token) == 1
    assert packing.end_tokens(tokenizer).sum() > 1000


def test_packing_encodes_letters_apart_from_other_characters():
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer, seen = Tokenizer.from_file(queries.tokenizer_path(WORDS)), []
    texts = ["River,", "river.", "RIVER", "(river)", "don't", "'s", "x'Llama", "a1b22c", "12,", "<|endoftext|>river", "<|ENDOFTEXT|>", "Éa,b", "H\u0331a,", "naïve.", "漢字,ab", "--", "", "é", "İx.I", "a\x00b", "\x1fq\x7f"]

    def encode(words):
        seen.extend(words)
        return packing.flat_word_encoder(tokenizer)(words)

    kinds = packing.byte_kinds(tokenizer)
    ids, sizes = packing.encoded(pa.array(texts + texts[:4], pa.large_string()), chunks.ChunkTable(encode), kinds)
    want = [tokenizer.encode(w, add_special_tokens=False).ids for w in texts + texts[:4]]
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert seen.count("river") == 1 and not {"river,", "River,", "RIVER"} & set(seen)
    assert [len(x) for x in packing.encoded(pa.array([], pa.large_string()), chunks.ChunkTable(encode), kinds)] == [0, 0]
    # tokenizers that may join across these places keep whole words
    config = json.loads(tokenizer.to_str())
    for change in ({"pre_tokenizer": None}, {"normalizer": {"type": "Strip", "strip_left": True, "strip_right": True}}):
        assert packing.byte_kinds(Tokenizer.from_str(json.dumps(config | change))) is None


def test_packing_prefers_related_neighbours():
    rng = np.random.default_rng(5)
    topics = [rng.choice(np.arange(100 * k, 100 * k + 40), 60) for k in range(4) for _ in range(4)]
    df = np.bincount(np.concatenate([np.unique(t) for t in topics]))
    scores = packing.relevance([t.astype("<u4") for t in topics], df, len(topics), 60.0)
    rows = packing.fill(np.full(16, 60), scores, 240)
    assert [len({i // 4 for i, *_ in row}) for row in rows] == [1, 1, 1, 1]


def test_sentencepiece_equals_the_library(docs, rows, result):
    path = queries.tokenizer_path(PIECES)
    model = sentencepieces.load(path)
    want = []
    for i, t in rows:
        ids = [1, *model.encode(t or ""), 2]
        want.append((i, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), model.decode(ids)))
    coded = sentencepieces.encode_decode(docs, path)
    assert result(coded.select("doc_id", F.sha2("ids", 256), "decoded")) == result(want)


def test_chunk_tables_start_anew(monkeypatch):
    from pitcast.llm import chunks

    monkeypatch.setattr(chunks, "TABLE_LIMIT", 3)
    table = chunks.ChunkTable(lambda xs: [[len(x)] * len(x) for x in xs])
    for part in (["a", "bb", "a"], ["ccc", "dddd"], ["e", "bb"]):
        ids, sizes = table.expand(table.positions(part))
        assert sizes.tolist() == [len(x) for x in part] and ids.tolist() == [len(x) for x in part for _ in x]
    assert table.generation == 2


def test_toxicity_learns_words_and_beginnings(spark):
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(4, 9))) for _ in range(300)]
    docs, labels = [], []
    for i in range(600):
        text = list(rng.choice(words, 40))
        bad = i % 6 == 0
        if bad:
            text[int(rng.integers(40))] = str(rng.choice(["Vilest!!", "zorgan", "zorgeth"])) + str(rng.choice(["", "um", "ix"]))
            text[int(rng.integers(40))] = "vilest"
        docs.append((i, " ".join(text), 9, 9.5))
        if i % 10 != 9:
            labels.append((i, 1, int(bad if rng.random() < 0.97 else not bad)))
    docs += [(1000, None, 1, 1.0), (1001, "", 1, 1.0), (None, "vilest vilest", 1, 1.0), (0, docs[0][1], 1, 1.0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, votes int, score double")
    out = toxicity.toxicity(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert len(held) > 60 and np.mean([r.predicted == (r.doc_id % 6 == 0) for r in held]) > 0.95
    assert not any(r.predicted for r in out if r.doc_id in (1000, 1001))
    none = toxicity.toxicity(frame, spark.createDataFrame([], "doc_id long, quality int, toxic int")).select("score").distinct().collect()
    assert [r.score for r in none] == [0.0]


def test_toxicity_pieces_of_long_texts_keep_words_whole(monkeypatch):
    import pyarrow as pa

    texts = [" ".join(f"word{k}" for k in range(300)), "z" * 900 + " tail", "short one", "", "y" * 500]
    column = pa.array(texts)
    features = lambda: sorted((int(r), int(c)) for rows, codes in toxicity.feature_rows(column) for r, c in zip(rows, codes))
    whole = features()
    monkeypatch.setattr(toxicity, "STEP", 64)
    monkeypatch.setattr(toxicity, "slices", lambda at: ((i, i + 1) for i in range(len(at) - 1)))
    assert features() == whole


SCHEMAS = {"find": {"query": ("string", True), "limit": ("integer", False)}, "sum": {"values": ("array", True), "exact": ("boolean", False)}}


def test_tool_calls(spark):
    rows = [
        (1, 0, "user", "plain text"), (1, 1, "assistant", '{"tool_calls": [{"id": "b", "name": "find", "arguments": "{\\"limit\\": 3, \\"query\\": \\"é/\\"}"}, {"id": "a", "name": "sum", "arguments": {"values": [1, 2.50]}, "after": ["b", "x", "c"]}]}'),
        (1, 2, "tool", '{"tool_call_id": "b", "content": {"z": 1, "a": null}}'), (1, 2, "tool", '{"tool_call_id": "b", "content": {"z": 1, "a": null}}'),
        (1, 3, "assistant", '{"tool_calls": [{"id": "c", "name": "sum", "arguments": {"values": 3, "more": 1}, "after": ["a"]}, {"name": "drop", "arguments": {}}]}'),
        (1, 4, "tool", '{"tool_call_id": "nobody", "content": "x"}'), (2, 0, "assistant", '{"tool_calls": [{"id": "b", "name": "find", "arguments": "not json"}]}'),
        (2, 1, "assistant", None), (2, 2, "assistant", ""), (None, 0, "assistant", '{"tool_calls": [{"id": "b", "name": "find", "arguments": {}}]}'),
        (None, 1, "tool", '{"tool_call_id": "b", "content": "late"}'),
    ]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, level int, message string")
    out = {(r.conv_id, r.call_id): r for r in tool_calls.link_tool_calls(frame, SCHEMAS).collect()}
    assert len(out) == 7
    assert out[1, "b"].message == '{"arguments":{"limit":3,"query":"é/"},"id":"b","level":0,"name":"find","result":{"a":null,"z":1}}'
    assert (out[1, "b"].n_results, out[1, "b"].result_turn, out[1, "b"].problems) == (2, 2, "")
    assert [out[1, k].level for k in "bac"] == [0, 1, 2] and out[1, "a"].problems == ""
    assert out[1, "c"].problems == "type values; unexpected more" and out[1, "at-3-1"].problems == "unknown tool"
    assert out[1, "nobody"].problems == "unasked result" and out[1, "nobody"].turn is None
    assert out[2, "b"].problems == "malformed arguments" and out[None, "b"].problems == "missing query" and out[None, "b"].result_turn == 1
    assert tool_calls.link_tool_calls(frame.limit(0), SCHEMAS).isEmpty()


def test_no_message_is_lost(spark):
    twice = '{"tool_calls": [{"id": "dup", "name": "find", "arguments": {"query": "a", "query": "b"}}, {"id": "dup2", "name": "find", "arguments": {"query": "c"}}]}'
    answer = '{"tool_call_id": "ok", "content": {"n": 1, "n": 2}}'
    rows = [
        (1, 0, twice), (1, 0, twice), (1, 1, answer), (1, 2, '  {"tool_calls": [{"id": "cut'), (1, 3, '{"a": 1, "a": 2}'), (1, 4, "{not a message"), (None, None, answer),
        (1, 5, '{"tool_calls": [{"id": "ok", "name": "sum", "arguments": {"values": [1]}}, {"id": "big", "name": "find", "arguments": {"query": "q", "limit": 12345678901234567890}}, '
               '{"id": "half", "name": "find", "arguments": {"query": "q", "limit": 1.5}}]}'),
        (1, 6, '{"tool_call_id": "big", "content": "' + "long " * 400_000 + '"}'),
    ]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, text string, call_id string").repartition(3)
    out = tool_calls.link_tool_calls(frame, SCHEMAS).collect()
    lost = [r for r in out if r.problems == "unreadable message"]
    assert sorted((r.conv_id or 0, r.turn if r.turn is not None else -1, r.copies) for r in lost) == [(0, -1, 1), (1, 0, 2), (1, 1, 1), (1, 2, 1)]
    assert all(r.call_id in r.message and r.name is None and r.n_results == 0 for r in lost) and json.loads(next(r for r in lost if r.turn == 0).message)["text"] == twice
    rest = {r.call_id: r for r in out if r not in lost}
    assert set(rest) == {"ok", "big", "half"} and rest["big"].problems == "" and rest["half"].problems == "type limit"
    assert rest["big"].n_results == 1 and len(rest["big"].message) > 2_000_000 and "12345678901234567890" in rest["big"].message


def test_long_chains_of_calls(spark):
    rows = [(5, t, "assistant", '{"tool_calls": [{"id": "c%d", "name": "find", "arguments": {"query": "q"}, "after": ["c%d"]}]}' % (t, t - 1)) for t in range(9)]
    out = tool_calls.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SCHEMAS).collect()
    assert all(r.level == r.turn for r in out)


@pytest.mark.parametrize("operator", [
    exact_dedup.exact_dedup, substring_dedup.substring_dedup, suffix_array.suffix_array_dedup, near_dedup.near_dedup, fuzzy_lines.fuzzy_line_dedup,
    quality.quality_rules, lambda d: packing.pack(d, queries.tokenizer_path(WORDS)), lambda d: sentencepieces.encode_decode(d, queries.tokenizer_path(PIECES)),
    lambda d: toxicity.toxicity(d, d.selectExpr("doc_id", "1 AS quality", "1 AS toxic")),
])
def test_empty_tables(empty, operator):
    assert operator(empty).isEmpty()


def test_pipeline_stages(spark, docs, rows, tmp_path):
    import corpus_pipeline

    current = docs.where("doc_id IS NOT NULL").drop("n", "rep", "id", "key", "t1", "component", "kept", "value", "likely")
    for name, function in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in current.collect()]
        out = common.stage(function(spark, current, str(tmp_path)), name)
        if name == "quality":
            assert all(not brute.statistics(r.text)[5] for r in out.collect())
            keep = None
        elif name == "exact_dedup":
            keep = [r[0] for r in brute.exact(before) if r[3]]
        elif name == "near_dedup":
            keep = [r[0] for r in brute.near(before) if r[3]]
        elif name == "suffix_array_dedup":
            want = {r[0]: r[4] for r in brute.repeated_bytes(before)}
            ascii_only = [r for r in out.collect() if r.text.isascii()]
            assert out.count() == len(before) and all(brute.sha(r.text) == want[r.doc_id] for r in ascii_only)
            keep = None
        else:
            assert {r.doc_id for r in out.collect()} == {i for i, _ in before}
            break
        assert out.columns == current.columns
        if keep is not None:
            assert sorted(map(repr, keep)) == sorted(repr(r.doc_id) for r in out.collect())
        current = out


def test_registered_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(queries.ORACLE) == {"op5_tool_calls", "op6_exact_dedup", "op12_importance_resampling", "op13_source_mixing"}
