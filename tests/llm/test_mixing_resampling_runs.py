import math
import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitcast.llm import mixing, periodic_runs, queries, resampling


def words_of(text):
    return (text or "").encode().split()


def brute_runs(code, least):
    """Runs by comparing every word with the one q words on, for every q; a smaller period of the same stretch wins."""
    n, best = len(code), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and code[j] == code[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q) and j > i:
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    smallest = lambda s, n, q: not any(code[s : s + n - p] == code[s + p : s + n] for p in range(1, q))
    return sorted((s, n, q) for (s, n), q in best.items() if smallest(s, n, q))


def test_runs_of_words_against_every_period():
    rng = random.Random(1)
    for _ in range(1500):
        n, k = rng.randint(0, 70), rng.choice([1, 2, 3, 6])
        code = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.5 and n > 6:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(3, 10)
            for i in range(a + p, n):
                code[i] = code[a + (i - a) % p]
        least = rng.choice([1, 4, 12])
        runs, kept = periodic_runs.text_runs([str(c).encode() for c in code], least)
        want = brute_runs(code, least)
        assert runs == want
        gone = {i for s, m, q in want for i in range(s + q, s + m)}
        assert kept == [str(c).encode() for i, c in enumerate(code) if i not in gone]


def test_squares_lie_in_every_run_with_its_period():
    rng = random.Random(3)
    for _ in range(300):
        code = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(2, 60))]
        found = set(periodic_runs.squares(code))
        assert all(code[e - 2 * q : e - q] == code[e - q : e] for e, q in found)
        assert all({(e, q) for e in range(s + 2 * q, s + n + 1)} <= found for s, n, q in brute_runs(code, 2))


def test_a_long_text_needs_no_more_than_its_stretches():
    rng = random.Random(5)
    code = np.array([rng.randrange(10**6) for _ in range(300_000)])
    code[200_000:] = np.resize(code[200_000:200_700], 100_000)
    assert periodic_runs.stretches(code) == [(200_000, 300_000)]
    runs, kept = periodic_runs.text_runs([str(c).encode() for c in code])
    assert runs == [(200_000, 100_000, 700)] and len(kept) == 200_700


def planted(doc_id, text):
    words = words_of(text)
    if doc_id is None:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def brute_periodic(rows):
    for doc_id, text in rows:
        words = planted(doc_id, text)
        found = brute_runs(words, 12) if len(words) < 4000 else periodic_runs.text_runs(words)[0]
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        collapsed = b" ".join(w for i, w in enumerate(words) if i not in gone)
        top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        yield (doc_id, len(found), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4), sha256(listed.encode()).hexdigest(), sha256(collapsed).hexdigest())


@pytest.fixture
def tables(spark, docs, monkeypatch):
    """Lets the registered queries read frames of this test."""
    frames = {"documents": docs, "benchmark": spark.createDataFrame([(1, "Quick brown fox 12\nx é"), (2, None), (3, "")], "item_id long, text string")}
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: frames[name])
    return frames


def test_periodic_query(spark, docs, rows, result, tables, empty):
    more = [(9000 + i, " ".join(f"w{(i * j) % 17}" for j in range(5 * i))) for i in range(200)]
    more += [(9900, "a b " * 30 + "c"), (9901, "x\x0by\x0cz\t" * 9), (9902, " ".join(["é"] * 12)), (9903, " ".join(["é"] * 11))]
    tables["documents"] = docs.select("doc_id", "text", "n").unionByName(spark.createDataFrame([(*r, 1) for r in more], "doc_id long, text string, n long"))
    want = list(brute_periodic([*rows, *more]))
    assert result(queries.op11_periodic_runs(spark, "")) == result(want) and sum(r[1] for r in want) > 40
    tables["documents"] = empty
    assert queries.op11_periodic_runs(spark, "").isEmpty()


def brute_weights(rows, target, longest, buckets=10_000):
    def features(text):
        words = (text or "").encode().translate(bytes(
            b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
        )).split()
        return len(words), Counter(zlib.crc32(b" ".join(words[i : i + n])) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1))

    per = [(d, *features(t)) for d, t in rows]
    s, t = sum((c for *_, c in per), Counter()), sum((features(x)[1] for x in target), Counter())
    size_s, size_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (size_s + buckets) / ((s[b] + 1.0) * (size_t + buckets))))
    return [(d, n, sum(c.values()), sum(gain(b) * k for b, k in c.items())) for d, n, c in per]


@pytest.mark.parametrize("longest", [1, 3])
def test_weights_against_whole_texts(docs, rows, result, tables, longest):
    got = resampling.resample(docs, tables["benchmark"], 30, 20, longest)
    want = []
    for d, n, size, weight in brute_weights(rows, ["Quick brown fox 12\nx é"], longest):
        h = int(sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        want.append((d, n, size, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    assert result(got.drop("rank")) == result(want)
    ranked = sorted((r for r in got.collect() if r["rank"] is not None), key=lambda r: r["rank"])
    asked = sorted((r for r in want if r[1] >= 20), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    drawn = len(asked) * 30 // 100
    assert [r["rank"] for r in ranked] == list(range(1, drawn + 1))
    assert [(r["doc_id"], r["score"]) for r in ranked] == [(r[0], r[4]) for r in asked[:drawn]]


def test_a_hot_line_is_joined_by_broadcast_or_not_alike(docs, result, tables, monkeypatch):
    want = result(resampling.resample(docs, tables["benchmark"]))
    monkeypatch.setattr(resampling, "HOT", 1)  # no line is hot
    assert result(resampling.resample(docs, tables["benchmark"])) == want


def test_resampling_of_empty_tables(spark, docs, empty, tables):
    assert resampling.resample(empty, tables["benchmark"]).isEmpty()
    assert resampling.resample(docs, tables["benchmark"].limit(0)).count() == docs.count()


def brute_targets(sizes, share=1.5, limit=2):
    """Resharing by weight, source by source."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = goal / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= limit * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = limit * sizes[s]
            goal -= out[s]
        open_ -= over
    return out


def test_permutations_are_one_to_one(spark):
    for n in (1, 2, 7, 100, 1000):
        tag = F.lit("t")
        size = F.lit(n).cast("long")
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), mixing._keys(tag, size), tag, size)).collect()]
        assert sorted(got) == list(range(n))
        assert n < 100 or np.mean([abs(a - i) for i, a in enumerate(got)]) > n / 5


def test_mix_meets_targets(spark, docs, rows, result):
    full = docs.select("doc_id", "source", "text").collect()
    sizes = defaultdict(int)
    for r in full:
        sizes[r.source] += len(words_of(r.text))
    want = brute_targets(sizes)
    mixture = mixing.mix(docs, block=16, shard=8)
    out = mixing.taken(mixture).collect()
    assert result([(r.doc_id, r.size) for r in out]) == result([(r.doc_id, len(words_of(r.text))) for r in full])
    assert all(0 <= r.taken <= 2 * r["size"] for r in out)
    by_source = defaultdict(int)
    for r in mixture.documents.join(mixture.pieces.select("number", "start").distinct(), ["number", "start"], "left").select("source", "target").distinct().collect():
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9)
    for r in mixing.spans(mixture).join(mixture.documents.select("number", "source", "target").distinct(), "number").collect():
        by_source[r.source] += r.length
    for s, words in by_source.items():
        assert abs(words - want[s]) <= 32
    # shards: full but for the last one, no slot twice
    counts = {r.shard: r.n for r in mixing.shard_counts(mixture).groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    assert sorted(counts) == list(range(len(counts))) and all(n == 8 for s, n in counts.items() if s < len(counts) - 1)
    assert mixture.slots.select("shard", "place").distinct().count() == mixture.slots.count() == sum(counts.values())
    # reruns agree
    again = mixing.mix(docs.repartition(5), block=16, shard=8)
    assert result(mixing.spans(again).drop("doc_id")) == result(mixing.spans(mixture).drop("doc_id"))
    assert result(mixing.taken(again)) == result(out)


def test_shards_mix_sources(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('s', id % 3) AS source", "repeat('w ', 40) AS text")
    per_shard = mixing.shard_counts(mixing.mix(docs, block=8, shard=200)).collect()
    total = Counter()
    for r in per_shard:
        total[r.number] += r.n
    for r in per_shard:
        share = total[r.number] / sum(total.values())
        assert abs(r.n - 200 * share) < 6 * math.sqrt(200 * share * (1 - share)) + 3
    assert len({r.n for r in per_shard if r.number == 1}) > 10


def test_mix_of_empty_and_wordless_tables(spark, empty):
    assert mixing.taken(mixing.mix(empty)).isEmpty()
    blank = spark.createDataFrame([(1, None, "a"), (2, " \t", None), (None, "", "")], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.taken(mixing.mix(blank)).collect()] == [0, 0, 0]


def test_a_source_larger_than_one_task(spark, result, monkeypatch):
    docs = spark.range(500).selectExpr("id AS doc_id", "if(id % 2 = 0, 'hot', null) AS source", "repeat('w ', cast(id % 37 as int)) AS text")
    want = result(mixing.taken(mixing.mix(docs, block=4)))
    monkeypatch.setattr(mixing, "CHUNK", 16)
    assert result(mixing.taken(mixing.mix(docs, block=4))) == want
