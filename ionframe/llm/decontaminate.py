"""Benchmark decontamination: every passage queries a BM25 index of the test items.

Terms are pairs of neighbouring words, so that a language's common words alone reach no item. An item's weights
are divided by their sum: a passage that holds all of an item's terms scores 1, and one threshold fits
items of any length. Document frequencies, the number of items and their mean length are those of the whole benchmark, and the
passages that an item is sought in are fitted to its own length, so that what is found doesn't depend on how items are
dealt to indexes.
"""

from __future__ import annotations

import math
import re
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, only, stored

_PLAIN = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
HITS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, word_offset long"


def words(text: str | None) -> list[bytes]:
    """Lower-cased words between white space and ASCII punctuation."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split() if text else []


def question_answer(text: str, least: int = 3) -> tuple[list[bytes], list[bytes]]:
    """An item's question and answer: the answer is its last sentences that have `least` words
    together; a lone sentence is parted at two thirds."""
    parts = [w for s in re.split(r"[.!?\n]+", text) if (w := words(s))]
    answer: list[bytes] = []
    while len(parts) > 1 and len(answer) < least:
        answer = parts.pop() + answer
    question = [w for p in parts for w in p]
    if not answer:
        cut = max(1, len(question) * 2 // 3)
        question, answer = question[:cut], question[cut:] or question[-1:]
    return question, answer


def mixed(pair: np.ndarray) -> np.ndarray:
    """Term keys with both words in the low bits."""
    return (pair >> 31) * 40503 + (pair & 0x7FFFFFFF)


def overlap(part: list[bytes], grams: set, k: int = 3) -> float:
    """The share of a part's words that lie in a k-gram of the passage (shorter parts: as one gram)."""
    k = min(k, len(part))
    if not k:
        return 0.0
    held = [False] * len(part)
    for i in range(len(part) - k + 1):
        if tuple(part[i : i + k]) in grams:
            held[i : i + k] = [True] * k
    return sum(held) / len(part)


@dataclass(frozen=True)
class Stats:
    """Of the whole benchmark: items, mean length in words, and in how many items each of the terms asked for is."""

    items: int
    mean: float
    df: dict[tuple[bytes, bytes], int]


def stats_of(tokens: list[list[bytes]]) -> Stats:
    """Stats of items that are all at hand."""
    held = Counter(p for ws in tokens for p in set(zip(ws, ws[1:], strict=False)))
    return Stats(len(tokens), sum(map(len, tokens)) / max(1, len(tokens)), held)


class Index:
    """Postings of items of at most `step` words each, in blocks with the maximum weight of each."""

    def __init__(self, items: list[tuple[int, str]], stats: Stats | None = None, vocab: dict[bytes, int] | None = None, step: int | None = None, k1: float = 1.2, b: float = 0.75, block: int = 8):
        self.ids = [i for i, _ in items]
        tokens = [words(t) for _, t in items]
        stats = stats or stats_of(tokens)
        self.parts = [question_answer(t) for _, t in items]
        self.step = step or max(16, max(map(len, tokens), default=0))
        self.vocab: dict[bytes, int] = {} if vocab is None else vocab
        for ws in tokens:
            for w in ws:
                self.vocab.setdefault(w, len(self.vocab))
        words_of = list(self.vocab)
        size = self.size = 1 << 31  # of term keys: first word * size + second
        postings: dict[int, dict[int, int]] = {}
        for n, ws in enumerate(tokens):
            for x, y in zip(ws, ws[1:], strict=False):
                held = postings.setdefault(self.vocab[x] * size + self.vocab[y], {})
                held[n] = held.get(n, 0) + 1
        raw = {}
        total = [0.0] * len(tokens)
        for term, held in postings.items():
            df = stats.df[words_of[term // size], words_of[term % size]]
            idf = math.log(1 + (stats.items - df + 0.5) / (df + 0.5))
            for n, tf in held.items():
                raw[term, n] = w = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(tokens[n]) / stats.mean))
                total[n] += w
        self.keys = np.array(sorted(postings), np.int64)
        self.most = np.zeros(len(self.keys))
        self.lists = []
        for at, term in enumerate(self.keys.tolist()):
            docs = sorted(postings[term])
            weights = [raw[term, n] / total[n] for n in docs]
            tops = [max(weights[i : i + block]) for i in range(0, len(docs), block)]
            self.lists.append((docs, weights, tops))
            self.most[at] = max(weights)
        self.block = block
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[mixed(self.keys) % len(self.maybe)] = True

    def search(self, terms: list[int], theta: float) -> list[tuple[int, float]]:
        """(item number, score) of all items that score theta or more, by block-max WAND."""
        cursors = [[0, t] for t in terms]
        lists, block, found = self.lists, self.block, []
        doc = lambda c: lists[c[1]][0][c[0]]

        def seek(c: list, target: int) -> bool:
            c[0] = bisect_left(lists[c[1]][0], target, c[0])
            return c[0] < len(lists[c[1]][0])

        while cursors:
            cursors.sort(key=doc)
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += self.most[c[1]]
                if bound >= theta:
                    pivot = i
                    break
            if pivot < 0:
                break
            d = doc(cursors[pivot])
            while pivot + 1 < len(cursors) and doc(cursors[pivot + 1]) == d:
                pivot += 1
            tight, nearest = 0.0, doc(cursors[pivot + 1]) if pivot + 1 < len(cursors) else len(self.ids)
            for c in cursors[: pivot + 1]:
                docs, _, tops = lists[c[1]]
                at = bisect_left(docs, d, c[0])
                if at < len(docs):
                    k = at // block
                    tight += tops[k]
                    nearest = min(nearest, docs[min(len(docs), (k + 1) * block) - 1] + 1)
            if tight < theta - 1e-12:
                target = max(d + 1, nearest)
                cursors = [c for i, c in enumerate(cursors) if i > pivot or seek(c, target)]
            elif doc(cursors[0]) == d:
                score = sum(lists[c[1]][1][c[0]] for c in cursors[: pivot + 1])
                if score >= theta - 1e-12:
                    found.append((d, score))
                cursors = [c for i, c in enumerate(cursors) if i > pivot or seek(c, d + 1)]
            else:
                cursors = [c for i, c in enumerate(cursors) if doc(c) >= d or seek(c, d)]
        return found

    def hits(self, tokens: list[list[bytes]], ids: np.ndarray, counts: np.ndarray, theta: float, question: float, answer: float) -> list[list[tuple]]:
        """For each text (item_id, score, overlaps, word offset) of its best passage per item. tokens: the texts' words,
        ids: their numbers in the vocabulary (-1: not in it), one text after another, counts: words of each text.

        Passages are runs of 2 * step words that start every step, so an item's copy always lies whole in one of
        them. Passages whose terms' maxima can't reach theta are passed over before the index is asked."""
        step, size = self.step, self.size
        out: list[list[tuple]] = [[] for _ in tokens]
        if not len(ids) or not len(self.keys):
            return out
        starts = np.cumsum(counts) - counts
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        pair = ids[at] * size + ids[at + 1]
        likely = self.maybe[mixed(pair) % len(self.maybe)]
        at, pair = at[likely], pair[likely]
        term = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        known = self.keys[term] == pair
        at, term = at[known], term[known]
        text = np.searchsorted(starts, at, side="right") - 1
        inside = at + 1 < (starts + counts)[text]
        at, term, text = at[inside], term[inside], text[inside]
        slot = (at - starts[text]) // step
        base = np.concatenate([[0], np.cumsum(counts // step + 2)])[:-1]
        window = np.concatenate([base[text] + slot + 1, base[text] + slot])  # of the passages that start at this step and the one before
        key = np.unique(window * len(self.keys) + np.concatenate([term, term]))
        window, term = key // len(self.keys), key % len(self.keys)
        bound = np.bincount(window, weights=self.most[term]) if len(window) else np.zeros(0)
        for w in np.flatnonzero(bound >= theta - 1e-9):
            lo, hi = np.searchsorted(window, [w, w + 1])
            n = int(np.searchsorted(base, w, side="right") - 1)
            first = max(0, (int(w - base[n]) - 1) * step)
            found = self.search(term[lo:hi].tolist(), theta)
            if not found:
                continue
            passage = tokens[n][first : first + 2 * step]
            grams = {tuple(passage[i : i + k]) for k in (1, 2, 3) for i in range(len(passage) - k + 1)}
            for item, score in found:
                q, a = (overlap(p, grams) for p in self.parts[item])
                if q >= question and a >= answer:
                    out[n].append((self.ids[item], score, q, a, first))
        return [best_of(rows) for rows in out]


class Block:
    """Indexes of a bounded block of items, one for each power of two of their lengths, over one vocabulary."""

    def __init__(self, items: list[tuple[int, str]], stats: Stats | None = None):
        sized: dict[int, list] = {}
        for item in items:
            sized.setdefault(max(16, 1 << (len(words(item[1])) - 1).bit_length()), []).append(item)
        stats = stats or stats_of([words(t) for _, t in items])
        self.vocab: dict[bytes, int] = {}
        self.indexes = [Index(part, stats, self.vocab, step) for step, part in sorted(sized.items())]

    def hits(self, texts: list, theta: float, question: float, answer: float) -> list[list[tuple]]:
        """For each text (item_id, score, question_overlap, answer_overlap, word_offset), in order of item_id."""
        get = self.vocab.get
        tokens = [words(t) for t in texts]
        ids = np.fromiter((get(w, -1) for ws in tokens for w in ws), np.int64)
        counts = np.array([len(ws) for ws in tokens])
        found = [x.hits(tokens, ids, counts, theta, question, answer) for x in self.indexes]
        return [best_of(r for own in found for r in own[n]) for n in range(len(texts))]


def best_of(rows) -> list[tuple]:
    """The best row of each item, the first of equals."""
    best: dict[int, tuple] = {}
    for r in rows:
        if r[0] not in best or r[1] > best[r[0]][1]:
            best[r[0]] = r
    return [best[i] for i in sorted(best)]


def blocks_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = 4 << 20) -> Iterator[Block]:
    """Blocks of the benchmark of about block_bytes of text each, built one at a time: what is sent to the
    executors and held by the driver is bounded; a larger benchmark makes more blocks, each asked in its turn. Statistics are
    counted once over the whole benchmark, by Spark. Null ids or texts are left out. A repeated id keeps each of its texts, all in one block."""
    items = only(benchmark, item_id=id_col, text=text_col).where("item_id is not null and text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    if blocks == 1:
        yield Block(sorted((r["item_id"], r["text"]) for r in items.collect()))
        return

    def pairs(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = [(b, len(ws), x, y) for b, t in zip(part.column("block").to_pylist(), part.column("text").to_pylist(), strict=True) for ws in [words(t)] for x, y in {*zip(ws, ws[1:], strict=False)} or {(None, None)}]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "n", "x", "y"])

    items = stored(items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")), "items")
    terms = stored(items.mapInArrow(pairs, "block int, n long, x binary, y binary"), "terms")
    df = stored(terms.where("x is not null").groupBy("x", "y").agg(F.count("*").alias("df")), "df")
    size = items.mapInArrow(_lengths, "n long").agg(F.count("*").alias("items"), F.avg("n").alias("mean")).head()
    for k in range(blocks):
        asked = df.join(terms.where((F.col("block") == k) & F.col("x").isNotNull()).select("x", "y").distinct(), ["x", "y"])
        own = sorted((r["item_id"], r["text"]) for r in items.where(F.col("block") == k).select("item_id", "text").collect())
        yield Block(own, Stats(size["items"], size["mean"], {(bytes(r["x"]), bytes(r["y"])): r["df"] for r in asked.collect()}))


def _lengths(batches):
    for batch in batches:
        for part in chunks(batch, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([len(words(t)) for t in part.column("text").to_pylist()], pa.int64())], names=["n"])


def contaminated(docs: DataFrame, benchmark: DataFrame, theta: float = 0.5, question: float = 0.7, answer: float = 0.7, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """One row per document row and item whose question and answer both are in one passage of it.

    A passage has two to four times an item's words (32 at least). What is found doesn't depend on block_bytes; with several blocks
    each block's rows are stored before the next block is built. Items of one word have no term and are never found: a
    word alone is no evidence. Null and empty texts have no rows; a null doc_id
    stays null; repeated rows repeat their hits; of equal passages the first is named. An empty benchmark
    gives no rows. Very long texts are read whole, in passages. Other columns are ignored.
    """
    own = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    out, blocks = None, blocks_of(benchmark, block_bytes=block_bytes)
    block = next(blocks)
    while block is not None:
        shared = docs.sparkSession.sparkContext.broadcast(block)  # bounded by block_bytes

        def run(batches, shared=shared):
            for batch in batches:
                for part in chunks(batch, "text"):
                    found = shared.value.hits(part.column("text").to_pylist(), theta, question, answer)
                    rows = [(d, *r) for d, rs in zip(part.column("doc_id").to_pylist(), found, strict=True) for r in rs]
                    cols = list(zip(*rows, strict=True)) or [[]] * 6
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split(" ")[0] for x in HITS.split(", ")])

        part, block = own.mapInArrow(run, HITS), next(blocks, None)
        if out is not None or block is not None:
            part = stored(part, "hits")
            shared.unpersist()
        out = part if out is None else out.unionAll(part)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, theta: float = 0.5, question: float = 0.7, answer: float = 0.7, text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of docs in which no item is found, with all their columns. With several blocks of
    benchmark what each block leaves is stored before the next is built."""
    blocks = blocks_of(benchmark, block_bytes=block_bytes)
    block, several = next(blocks), False
    names, at = docs.columns, docs.columns.index(text_col)
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])
    while block is not None:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for batch in batches:
                for part in chunks(batch, f"c{at}"):
                    found = shared.value.hits(part.column(at).to_pylist(), theta, question, answer)
                    yield part.filter(pa.array([not f for f in found], pa.bool_()))

        docs, block = docs.mapInArrow(run, docs.schema), next(blocks, None)
        several = several or block is not None
        if several:
            docs = stored(docs, "clean")
            shared.unpersist()
    return docs.toDF(*names)
