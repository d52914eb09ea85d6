"""Periodic runs in texts: maximal repetitions of words by the method of Kolpakov and Kucherov."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, only


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, source) of each factor of the LZ factorisation: the longest prefix of the rest that also occurs at an
    earlier start (the two may overlap), or one new letter (source -1).

    One suffix automaton of w; a state keeps the end of its first occurrence, which tells
    whether what was read so far has an earlier one. Time and memory are linear in w.
    """
    n = len(w)
    following: list[dict[int, int]] = [{}]
    link, depth, first_end = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(w):
        state = len(depth)
        following.append({})
        depth.append(depth[last] + 1)
        first_end.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = state
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if depth[q] == depth[p] + 1:
                link[state] = q
            else:
                clone = len(depth)
                following.append(following[q].copy())
                depth.append(depth[p] + 1)
                first_end.append(first_end[q])
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
    out, at = [], 0
    while at < n:
        state, end = 0, at
        while end < n and first_end[to := following[state][w[end]]] < end:
            state, end = to, end + 1
        if end == at:
            out.append((at, 1, -1))
            at += 1
        else:
            out.append((at, end - at, first_end[state] - (end - at) + 1))
            at = end
    return out


def _prefix_lengths(s: list[int]) -> list[int]:
    """For each position, how long s from there agrees with s itself."""
    n = len(s)
    z = [n] + [0] * (n - 1) if n else []
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _across(w: list[int], a: int, b: int, c: int, times: int, out: dict[tuple[int, int], int]) -> None:
    """Runs of w[:c] that touch b, the border of the factors w[a:b] and w[b:c], into out: (start, end) -> smallest period.

    A run that reaches beyond b starts less than a period before a, or the factor before b would have been
    longer; so its period is less than (c - a) / (times - 1), and it starts less than that before a.
    """
    most = (c - a - 1) // (times - 1)
    if most < 1:
        return
    low = max(0, a - most)
    t, v = w[low:b], w[b:c]
    m, n = len(t), len(v)
    ahead = _prefix_lengths(v)  # v[q:] against v
    back = _prefix_lengths(t[::-1])  # t without its last q words against t, from the right
    after = _prefix_lengths([*v, -1, *t, *v])[n + 1 :]  # each suffix of t v against v
    before = _prefix_lengths([*t[::-1], -1, *v[::-1], *t[::-1]])[m + 1 :]  # each prefix of t v against t, from the right

    def put(start: int, end: int, q: int) -> None:
        if end - start >= times * q and (start == 0 or w[start - 1] != w[start - 1 + q]) and (end == len(w) or w[end] != w[end - q]):
            out[start, end] = min(q, out.get((start, end), q))

    for q in range(1, most + 1):
        if q <= m:  # a whole period before the border
            put(b - q - (back[q] if q < m else 0), b + min(n, after[m - q]), q)
        if q <= n:  # a whole period after it
            put(b - min(m, before[n - q]), b + q + (ahead[q] if q < n else 0), q)


def _runs(w: list[int], times: int) -> dict[tuple[int, int], int]:
    """All runs of w with at least `times` periods: (start, end) -> smallest period.

    A run touches a border of factors, where Main's comparison of the words on both sides finds it, or
    lies strictly within a factor, and so does its like within the factor's earlier occurrence.
    """
    parts = factors(w)
    found: dict[tuple[int, int], int] = {}
    starts: dict[int, list[tuple[int, int]]] = {}
    a = 0
    for b, length, source in [*parts, (len(w), 0, -1)]:
        new: dict[tuple[int, int], int] = {}
        _across(w, a, b, b + length, times, new)
        for (s, e), q in new.items():
            if (s, e) not in found:
                starts.setdefault(s, []).append((e, q))
            found[s, e] = min(q, found.get((s, e), q))
        if source >= 0 and starts:
            shift = b - source
            for s in range(source + 1, source + length):
                for e, q in list(starts.get(s, ())):
                    if e < source + length and (s + shift, e + shift) not in found:
                        found[s + shift, e + shift] = q
                        starts.setdefault(s + shift, []).append((e + shift, q))
        a = b
    return found


def _stretches(ids: np.ndarray, times: int) -> list[tuple[int, int]]:
    """[start, end) of the stretches that may hold a run: every stretch of three words within a run of at least four periods and
    six words occurs three times in it, so the places where a less frequent one starts cut the text. No run is lost or cut."""
    n = len(ids)
    if times < 4:
        return [(0, n)]
    if n < 6:
        return []
    size = int(ids.max()) + 1
    pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
    _, of, count = np.unique(pairs[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
    often = np.concatenate([[0], (count[of] >= 3).astype(np.int8), [0]])
    edges = np.diff(often)
    return [(int(s), int(e) + 2) for s, e in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True) if e + 2 - s >= 6]


def runs(words: list, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of words, by start and period: a stretch of at least max(least, times * period)
    words with that smallest period that can't be extended on either side. times is 2 at least."""
    if times < 2:
        raise ValueError("a run has two periods at least")
    number: dict = {}
    ids = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words))
    out = []
    for s, e in _stretches(ids, times if least >= 6 else 2):
        for (start, end), q in _runs(ids[s:e].tolist(), times).items():
            if end - start >= least:
                out.append((s + start, end - start, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """Words without those that a run holds after its first period."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in found:
        change[start + q] += 1
        change[start + length] -= 1
    return [x for x, drop in zip(words, np.cumsum(change)[:-1], strict=True) if not drop]


def planted(doc_id: int | None, words: list) -> list:
    """The words with the periodic tail that a tenth of the ids get: from word a on, the p words from a repeat."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit, rest = words[a : a + p], n - a
    return words[:a] + (unit * (rest // p + 1))[:rest]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4, plant: bool = False) -> DataFrame:
    """(doc_id, runs array of (start, length, period), text): all runs of words of each whole text, by start and then period, and
    the text of the words that no run holds after its first period, joined by one space.

    Words are stretches without ASCII white space. plant applies planted() first. One row per row of docs, without a
    shuffle; time and memory are linear in a text. A null or empty text has no words and no runs. A null id stays null (and
    gets no planted tail); repeated rows give a row each; of runs with one start and end the smallest period
    counts. Empty input gives no rows. Further columns of docs are ignored.
    """
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                found, texts = [], []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    words = (text or "").encode().split()
                    words = planted(doc, words) if plant else words
                    own = runs(words, least, times)
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                    texts.append(b" ".join(collapsed(words, own)).decode())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.list_(item)), pa.array(texts, pa.string())], names=["doc_id", "runs", "text"])

    return only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, text string")


def digests(docs: DataFrame) -> DataFrame:
    """Of periodic_runs() with planted tails: how many runs, the longest one (ties: smallest start, then period) and digests."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    out = periodic_runs(docs, plant=True).withColumn("m", F.when(F.size("runs") > 0, longest))
    length = -F.col("m.n")
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("m.start").alias("start"),
        length.alias("length"),
        F.col("m.period").alias("period"),
        F.expr("(-1000 * m.n) div m.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )
