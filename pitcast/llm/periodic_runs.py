"""Periodic run detection: maximal stretches of words that repeat with a period, found by a suffix automaton with link-cut access."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 12
#: Bytes of collapsed text after which a task hands on what it has.
STEP = 8 << 20
SCHEMA = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed_text string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def automaton(word: list[int]) -> tuple[array, array, array]:
    """Suffix automaton of ``word``: length and suffix link of each state, and the state of each prefix.

    States count from 1, the root, and 0 is none. Most states have one transition, so only further ones take a dict.
    """
    size = 2 * len(word) + 2
    length, link, symbol, target = (array("i", bytes(4 * size)) for _ in range(4))
    more: dict[int, dict[int, int]] = {}
    prefixes = array("i", bytes(4 * (len(word) + 1)))
    used = last = 1
    for i, c in enumerate(word, 1):
        used += 1
        new, p = used, last
        length[new] = i
        while p:
            if not target[p]:
                symbol[p], target[p] = c, new
            elif symbol[p] == c:
                break
            elif c in (far := more.setdefault(p, {})):
                break
            else:
                far[c] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = target[p] if symbol[p] == c else more[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                used += 1
                clone = used
                length[clone], link[clone], symbol[clone], target[clone] = length[p] + 1, link[q], symbol[q], target[q]
                if q in more:
                    more[clone] = dict(more[q])
                while p and (target[p] if symbol[p] == c and target[p] else more.get(p, {}).get(c)) == q:
                    if symbol[p] == c:
                        target[p] = clone
                    else:
                        more[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        prefixes[i] = last = new
    return length, link, prefixes


def _splay(x: int, left: array, right: array, up: array, seen: array) -> None:
    """Make ``x`` the root of its splay tree; the last occurrence of the path moves along with the root."""
    top = x
    while (p := up[top]) and (left[p] == top or right[p] == top):
        top = p
    if top == x:
        return
    seen[x] = seen[top]
    while (p := up[x]) and (left[p] == x or right[p] == x):
        g = up[p]
        inner = bool(g) and (left[g] == p or right[g] == p)
        turns = (p, x) if inner and (left[g] == p) == (left[p] == x) else (x, x) if inner else (x,)
        for y in turns:
            p = up[y]
            g = up[p]
            if left[g] == p and g:
                left[g] = y
            elif right[g] == p and g:
                right[g] = y
            if left[p] == y:
                b = right[y]
                left[p], right[y] = b, p
            else:
                b = left[y]
                right[p], left[y] = b, p
            if b:
                up[b] = p
            up[p], up[y] = y, g


def squares(word: list[int]) -> Iterator[tuple[int, int]]:
    """``(end, period)`` of squares of ``word``, at least one inside every run and always with the run's smallest period.

    Words are appended one after another. The states of a prefix and its suffixes are a path to the root of the link
    tree, which falls into segments that last occurred at the same end; the longest suffix of a segment repeats
    at the distance to that end, and is a square if the distance is within its length. The access then makes the whole
    path one segment that ends here.
    """
    length, up, prefixes = automaton(word)
    left, right, seen = (array("i", bytes(4 * len(length))) for _ in range(3))
    for i in range(1, len(word) + 1):
        x, below = prefixes[i], 0
        while x:
            _splay(x, left, right, up, seen)
            end = seen[x]
            if end and i - end <= length[x]:
                yield i, i - end
            if right[x]:
                seen[right[x]] = end
            right[x] = below
            below, x = x, up[x]
        seen[below] = i


def _agreeing(codes: np.ndarray, a: int, b: int, step: int) -> int:
    """For how many words the stretches from ``a`` and from ``b > a`` agree, onwards or backwards."""
    n, width = 0, 16
    limit = len(codes) - b if step > 0 else a + 1
    while n < limit:
        m = min(width, limit - n)
        x, y = (codes[a + n : a + n + m], codes[b + n : b + n + m]) if step > 0 else (codes[a - n - m + 1 : a - n + 1][::-1], codes[b - n - m + 1 : b - n + 1][::-1])
        unlike = np.flatnonzero(x != y)
        if len(unlike):
            return n + int(unlike[0])
        n, width = n + m, 2 * width
    return n


def runs_of(codes: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of at least ``min_length`` words, from squares extended to both sides."""
    reach: dict[int, int] = {}
    found = []
    for end, d in squares(codes.tolist()):
        if reach.get(d, 0) >= end:
            continue
        stop = end + _agreeing(codes, end - d, end, 1)
        start = end - 2 * d
        if start:
            start -= _agreeing(codes, start - 1, start + d - 1, -1)
        reach[d] = stop
        if stop - start >= min_length:
            found.append((start, stop - start, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(codes: np.ndarray, min_length: int = MIN_LENGTH, passes: int = 4) -> list[tuple[int, int]]:
    """Bounds outside of which no run lies.

    A run of period q agrees with itself q words on over at least half of ``min_length`` and over at least q
    words, so every word of it lies in a gram of that half which occurs again in the run. Words in no such gram part the text,
    and what is left is looked at anew by itself, as grams that recur far away are no periods. This only spares the automaton words.
    """
    gram = max(1, (min_length + 1) // 2)
    bounds = [(0, len(codes))]
    for _ in range(passes):
        kept = []
        rows = np.concatenate([np.arange(a, max(a, b - gram + 1)) for a, b in bounds]) if bounds else np.zeros(0, np.int64)
        part = np.repeat(np.arange(len(bounds)), [max(0, b - gram + 1 - a) for a, b in bounds])
        hashed = part.astype(np.uint64)
        for k in range(gram):
            hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + codes[rows + k].astype(np.uint64)
            hashed ^= hashed >> np.uint64(29)
        _, inverse, count = np.unique(hashed, return_inverse=True, return_counts=True)
        again = count[inverse] > 1
        starts, of = rows[again], part[again]
        if len(starts):
            cut = np.flatnonzero((np.diff(starts) > gram) | (np.diff(of) > 0)) + 1
            kept = [(int(s[0]), int(s[-1]) + gram) for s in np.split(starts, cut)]
        kept = [(a, b) for a, b in kept if b - a >= max(2, min_length)]
        if kept == bounds:
            break
        bounds = kept
    return bounds


def text_runs(words: list[bytes], min_length: int = MIN_LENGTH) -> tuple[list[tuple[int, int, int]], list[bytes]]:
    """The runs of a text, and its words without what runs repeat."""
    table: dict[bytes, int] = {}
    codes = np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, len(words))
    if len(words) < max(2, min_length) or len(table) == len(words):
        return [], words
    runs = [(a + s, n, q) for a, b in stretches(codes, min_length) for s, n, q in runs_of(codes[a:b], min_length)]
    if not runs:
        return runs, words
    edge = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        edge[s + q] += 1
        edge[s + n] -= 1
    return runs, [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """One row per document: ``doc_id, n_words, runs, collapsed_text``.

    A run is a stretch of consecutive words ``[^\\x20\\x09-\\x0D]+`` whose words are equal a smallest period q apart, of at least
    ``min_length`` and 2 q words, that neither neighbour prolongs. ``runs`` are ordered by start, then period; the collapsed
    text is the words that no run holds after its first period, joined by one space.

    Null, empty and blank texts have no words, no runs and an empty collapsed text. Each row is looked at by itself, so repeated rows and null
    ids give a row each; other columns are ignored. A long text takes memory in proportion to its own periodic stretches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            first, held, out = 0, 0, []
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                words = text.encode().split() if text else []
                runs, kept = text_runs(words, min_length)
                out.append((len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], b" ".join(kept)))
                held += len(out[-1][2])
                if held > STEP or i + 1 == batch.num_rows:
                    n, found, collapsed = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(first, i + 1 - first), pa.array(n, pa.int64()), pa.array(found, _RUNS), pa.array(collapsed, pa.binary()).cast(pa.string())],
                        ["doc_id", "n_words", "runs", "collapsed_text"],
                    )
                    first, held, out = i + 1, 0, []

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
