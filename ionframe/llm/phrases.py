"""Phrase collocations: counts of word n-grams from distinct suffixes of word numbers per shard, added up by prefix in buckets, and scores of their cuts."""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import chunks, mix64, only, stored

_BREAK = b"\xff"  # never a byte of UTF-8
_TABLE = bytes(32 if c == 9 else 255 if c in b".,;:!?\x0a\x0b\x0c\x0d" else c for c in range(256))
_PROBES = 3


def split(text: str) -> list[bytes]:
    """Words with A-Z lower-cased, and a break between pieces."""
    return text.encode().lower().translate(_TABLE).replace(_BREAK, b" \xff ").split()


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, in order of their first `depth` ids (ids are 0 and up; what lies past the end is less). Each round
    ranks twice as many ids by pairs of the last round's ranks."""
    rank, known = np.unique(ids, return_inverse=True)[1] + 1, 1
    while True:
        step = min(known, depth - known)
        if step <= 0:
            return np.argsort(rank, kind="stable")
        second = np.zeros_like(rank)
        second[:-step] = rank[step:]
        rank = np.unique(rank * (len(rank) + 2) + second, return_inverse=True)[1] + 1
        known += step


class _Shard:
    """Words of whole texts as ids, up to a number of words, then counted together. Ids differ by language."""

    def __init__(self, seed: int):
        self.seed, self.langs = seed, {}
        self.clear()

    def clear(self) -> None:
        self.number = itertools.count(1).__next__
        self.ids: dict[str, defaultdict] = {}
        self.parts: list[np.ndarray] = []
        self.words = 0

    def add(self, lang: str, words: list[bytes]) -> None:
        """No word pair spans two calls."""
        if lang not in self.ids:
            self.ids[lang] = defaultdict(self.number, {_BREAK: 0})
        self.parts += [np.fromiter(map(self.ids[lang].__getitem__, words), np.int64, len(words)), np.zeros(1, np.int64)]
        self.words += len(words)

    def tables(self):
        """Ids of all texts; per id the word's hash, its language's number, and the words themselves."""
        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int64)
        total = 1 + sum(len(v) - 1 for v in self.ids.values())
        hashes, lang, names = np.zeros(total, np.uint64), np.zeros(total, np.int64), [b""] * total
        for nth, vocabulary in enumerate(self.ids.values()):
            for word, i in vocabulary.items():
                if i:
                    hashes[i], lang[i], names[i] = xxhash.xxh3_64_intdigest(word, self.seed), nth, word
        return ids, hashes, lang, names, list(self.ids)


def _gram_hash(hashes: np.ndarray, langs: np.ndarray, ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit number for each n-gram and its language; it only selects what is worth counting exactly."""
    h = mix64(langs[ids[starts]] + np.uint64(n))
    for k in range(n):
        h = mix64(h ^ hashes[ids[starts + k]])
    return h


def _word_hash(langs: pa.Array, w: np.ndarray, seed: int) -> np.ndarray:
    """_gram_hash of single words, by the names of their languages and their own hashes."""
    coded = langs.dictionary_encode()
    lang_hash = np.array([xxhash.xxh3_64_intdigest(x, seed) for x in coded.dictionary.to_pylist()] or [0], np.uint64)
    at = np.arange(len(w))
    return _gram_hash(w.view(np.uint64), lang_hash[coded.indices.to_numpy()], at, at, 1)


def _bits(h: np.ndarray, size: int) -> np.ndarray:
    """_PROBES positions below size (a power of two) for each hash."""
    return np.stack([(mix64(h + np.uint64(k)) & np.uint64(size - 1)).astype(np.int64) for k in range(_PROBES)])


def _passes(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _bits(h, len(filter_) * 8)
    return ((filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(0)


def _scan(docs: DataFrame, seed: int, shard_words: int, emit, schema: str) -> DataFrame:
    """emit(ids, hashes, lang, lang hashes, words, lang names) of each shard of a task's rows, as rows of schema."""

    def run(batches):
        shard = _Shard(seed)

        def flush():
            ids, hashes, lang, names, langs = shard.tables()
            shard.clear()
            lang_hash = np.array([xxhash.xxh3_64_intdigest(x, seed) for x in langs] or [0], np.uint64)
            for out in emit(ids, hashes, lang, lang_hash[lang], names, langs):
                yield from (out.slice(at, 1 << 16) for at in range(0, out.num_rows, 1 << 16))
            pa.default_memory_pool().release_unused()

        for batch in batches:
            for part in chunks(batch, "text"):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    words = split(text) if text else []
                    while words:  # a text longer than a shard is cut at breaks
                        cut = words.index(_BREAK, shard_words) if len(words) > shard_words and _BREAK in words[shard_words:] else len(words)
                        shard.add(lang, words[:cut])
                        words = words[cut + 1 :]
                        if shard.words >= shard_words:
                            yield from flush()
        if shard.words:
            yield from flush()

    return docs.mapInArrow(run, schema)


def _first_counts(docs: DataFrame, seed: int, shard_words: int) -> DataFrame:
    """(lang, w, n, word, other): counts of a language's words by hash (w), with the first and last word of that hash, and the number of all its words (w null).

    A task counts its words by themselves until it holds shard_words different ones, so that no sort is needed before rows are dealt out.
    """

    def run(batches):
        counts: defaultdict[str, Counter] = defaultdict(Counter)
        held = 0

        def flush():
            for lang, own in counts.items():
                own.pop(_BREAK, None)
                names, n = list(own), np.fromiter(own.values(), np.int64, len(own))
                w = np.fromiter((xxhash.xxh3_64_intdigest(x, seed) for x in names), np.uint64, len(names)).view(np.int64)
                own.clear()
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.array([int(n.sum())])], names=["lang", "w", "word", "n"])
                for at in range(0, len(names), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    word = pa.array([x.decode() for x in names[part]], pa.string())
                    yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(word)), pa.array(w[part]), word, pa.array(n[part])], names=["lang", "w", "word", "n"])
            counts.clear()
            pa.default_memory_pool().release_unused()

        for batch in batches:
            for part in chunks(batch, "text"):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    own = counts[lang]
                    held -= len(own)
                    own.update(split(text) if text else [])
                    held += len(own)
                    if held >= shard_words:
                        yield from flush()
                        held = 0
        yield from flush()

    words = docs.mapInArrow(run, "lang string, w long, word string, n long")
    return words.repartition("lang", "w").groupBy("lang", "w").agg(F.sum("n").alias("n"), F.min("word").alias("word"), F.max("word").alias("other"))


def _filter_of(frequent: DataFrame, seed: int, most_bytes: int) -> np.ndarray:
    """A bit filter over the words (lang, w): no false negatives. 16 bits a key, up to most_bytes in all; beyond that it
    passes more, never less. The driver gets at most one row per 64 bits of it."""
    size = 1 << max(10, min((most_bytes * 8).bit_length() - 1, (frequent.count() * 16).bit_length()))

    def positions(batches):
        for batch in batches:
            at = np.unique(_bits(_word_hash(batch.column("lang"), batch.column("w").to_numpy(), seed), size))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], names=["slot", "bits"])

    words = frequent.select("lang", "w").mapInArrow(positions, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size >> 6, np.int64)
    out[words.column("slot").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


class _Numbers:
    """Words by number, from 1 in falling order of their counts, and suffixes of up to `longest` words packed into longs, the first word in the highest bits (0: no word)."""

    def __init__(self, words: pa.Table, seed: int, longest: int, bucket_rows: int):
        words = words.combine_chunks().sort_by([("n", "descending")])
        lang, w, n = (words.column(c).combine_chunks() for c in ("lang", "w", "n"))
        coded, w, n = lang.dictionary_encode(), w.to_numpy(), n.to_numpy()
        self.langs = coded.dictionary
        self.lang, self.w = np.append(-1, coded.indices.to_numpy()).astype(np.int32), np.append(0, w)
        h = _word_hash(lang, w, seed)
        order = np.argsort(h)
        self.h, self.number = h[order], (order + 1).astype(np.int32)
        self.unique = bool((self.h[1:] != self.h[:-1]).all())
        self.share = np.append(1, -(-n[n > bucket_rows] // bucket_rows))
        self.bits, self.longest = max(1, len(w).bit_length()), longest
        self.per = min(63 // self.bits, longest)
        self.longs = -(-longest // self.per)

    def of(self, h: np.ndarray, lang: np.ndarray, langs: list[str]) -> np.ndarray:
        """Numbers of words by their hash, and their languages as places in langs; 0 for other words."""
        if not len(self.h):
            return np.zeros(len(h), np.int64)
        code = {x: i for i, x in enumerate(self.langs.to_pylist())}
        own = np.array([code.get(x, -2) for x in langs] or [-2])
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        found = self.number[at]
        return np.where((self.h[at] == h) & (self.lang[found] == own[lang]), found, 0).astype(np.int64)

    def pack(self, numbers: np.ndarray) -> np.ndarray:
        """Suffixes of two words and more, cut at a number 0."""
        numbers = np.append(numbers, np.zeros(self.longest, np.int64))
        starts = np.flatnonzero((numbers[:-1] != 0) & (numbers[1:] != 0))
        keys, on = np.zeros((self.longs, len(starts)), np.int64), np.ones(len(starts), bool)
        for k in range(self.longest):
            nth = numbers[starts + k]
            on &= nth != 0
            keys[k // self.per] |= np.where(on, nth, 0) << self._shift(k)
        return keys

    def _shift(self, k: int) -> int:
        return self.bits * (self.per - 1 - k % self.per)

    def word(self, keys: np.ndarray, k: int) -> np.ndarray:
        return keys[k // self.per] >> self._shift(k) & ((1 << self.bits) - 1)

    def shares(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Over how many buckets suffixes that begin with these two words are spread: a pair is no more frequent than the rarer of them."""
        rarer = np.maximum(one, two)
        return np.where(rarer < len(self.share), self.share[np.minimum(rarer, len(self.share) - 1)], 1)

    def bucket(self, keys: np.ndarray, buckets: int) -> np.ndarray:
        one, two = self.word(keys, 0), self.word(keys, 1)
        third = mix64((self.word(keys, 2) if self.longest > 2 else 0 * one).view(np.uint64)) % self.shares(one, two).view(np.uint64)
        return (mix64(mix64((one << 32 | two).view(np.uint64)) + third) % np.uint64(buckets)).astype(np.int32)


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of keys in order, with the sums of their counts."""
    order = np.lexsort(keys[::-1])
    keys = keys[:, order]
    heads = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
    return keys[:, heads], np.add.reduceat(counts[order], heads)


def _narrow_counts(docs: DataFrame, seed: int, shard_words: int, longest: int, table, least: int, buckets: int) -> DataFrame:
    """(lang, w1.., f) of all n-grams of 2 words and more out of numbered words that occur at least `least` times.

    Every word's suffix goes out once a shard with its count, packed, in one compressed block for each bucket of pairs of first words. A bucket's suffixes,
    added up and sorted, give the counts of their prefixes; only a pair that is spread over several buckets is added up again.
    """
    cols = [f"w{k}" for k in range(1, longest + 1)]

    def emit(ids, hashes, lang, lang_hash, names, langs):
        numbered, every = table.value, np.arange(len(hashes))
        numbers = numbered.of(_gram_hash(hashes, lang_hash, every, every, 1), lang, langs)
        numbers[0] = 0
        keys = numbered.pack(numbers[ids])
        if not keys.shape[1]:
            return
        keys, counts = _added(keys, np.ones(keys.shape[1], np.int64))
        at = numbered.bucket(keys, buckets)
        order = np.argsort(at.astype(np.uint16) if buckets < 1 << 16 else at, kind="stable")
        at, rows = at[order], np.ascontiguousarray(np.vstack([keys, counts])[:, order])
        planes = rows.view(np.uint8).reshape(*rows.shape, 8).transpose(0, 2, 1).copy()  # nth bytes side by side, as they are alike
        heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        ends = np.append(heads[1:], len(at))
        packed = [pa.compress(planes[:, :, i:j].tobytes(), "zstd", asbytes=True) for i, j in zip(heads, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(at[heads]), pa.array((ends - heads).astype(np.int32)), pa.array(packed, pa.binary())], names=["bucket", "size", "packed"])

    def count(parts):
        numbered = table.value
        rows = np.concatenate(parts, 1)
        keys, counts = _added(rows[:-1], rows[-1])
        new, words = np.zeros(len(counts), bool), []
        new[0] = True
        for n in range(1, longest + 1):
            words.append(numbered.word(keys, n - 1))
            new[1:] |= words[-1][1:] != words[-1][:-1]
            if n < 2:
                continue
            heads = np.flatnonzero(new)
            sums = np.add.reduceat(counts, heads)
            use = sums >= least
            if n == 2:
                use |= numbered.shares(words[0][heads], words[1][heads]) > 1
            use &= words[-1][heads] != 0
            heads, sums = heads[use], sums[use]
            columns = [pa.array(numbered.w[words[k][heads]]) if k < n else pa.nulls(len(heads), pa.int64()) for k in range(longest)]
            yield pa.RecordBatch.from_arrays([numbered.langs.take(pa.array(numbered.lang[words[0][heads]])), *columns, pa.array(sums)], names=["lang", *cols, "f"])

    def run(batches):
        bucket, parts, held, most = None, [], 0, 1 << 22
        for batch in batches:
            for b, size, packed in zip(*(batch.column(c) for c in ("bucket", "size", "packed")), strict=True):
                if parts and b.as_py() != bucket:
                    yield from count(parts)
                    parts, held, most = [], 0, 1 << 22
                bucket, size, longs = b.as_py(), size.as_py(), table.value.longs + 1
                planes = np.frombuffer(pa.decompress(packed.as_buffer(), 8 * longs * size, "zstd"), np.uint8)
                parts.append(planes.reshape(longs, 8, size).transpose(0, 2, 1).copy().view(np.int64)[:, :, 0])
                held += size
                if held > most:
                    rows = np.concatenate(parts, 1)
                    parts = [np.vstack(_added(rows[:-1], rows[-1]))]
                    held = parts[0].shape[1]
                    most = max(most, 2 * held)
        if parts:
            yield from count(parts)

    schema = ", ".join(["lang string", *[f"{c} long" for c in cols], "f long"])
    blocks = _scan(docs, seed, shard_words, emit, "bucket int, size int, packed binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return blocks.mapInArrow(run, schema).groupBy("lang", *cols).agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def suffixes(ids: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, counts): one start of each distinct suffix, cut after `longest` ids and at a break (id 0), and how often it occurs. What starts at a break is left out.

    Equal ones lie side by side in the suffix array, as they are equal up to the break.
    """
    order = suffix_array(ids, longest)
    padded = np.concatenate([ids, np.zeros(longest, ids.dtype)])
    same = np.ones(len(order) - 1, bool)
    over = np.zeros(len(order) - 1, bool)  # whether both have come to a break
    for n in range(longest):
        nth = padded[order + n]
        equal = nth[1:] == nth[:-1]
        same &= over | equal
        over |= equal & (nth[1:] == 0)
    heads = np.flatnonzero(np.concatenate([[True], ~same]))
    counts = np.diff(np.append(heads, len(order)))
    use = ids[order[heads]] != 0
    return order[heads[use]], counts[use]


def _prefixes(longest: int, least: int):
    """Counts of all n-grams of 2 words and more from those of suffixes sorted by w1, lang, w2, ...: rows of the same first n words lie side by side.
    A group that goes on in the next batch is carried over; only counts of at least `least` are let out."""
    cols = [f"w{k}" for k in range(1, longest + 1)]

    def run(batches):
        carried: dict[int, tuple] = {}

        def rows(n, langs, keys, counts):
            columns = [pa.array(keys[:, k]) if k < n else pa.nulls(len(counts), pa.int64()) for k in range(longest)]
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), *columns, pa.array(counts)], names=["lang", *cols, "f"])

        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("lang").dictionary_encode()
            names, lang = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            filled = np.stack([batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in cols], 1).sum(1)
            words = np.stack([batch.column(c).fill_null(0).to_numpy() for c in cols], 1)
            f = batch.column("f").to_numpy()
            for n in range(2, longest + 1):
                at = np.flatnonzero(filled >= n)
                if not len(at):
                    continue
                own, keys = lang[at], words[at, :n]
                heads = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (keys[1:] != keys[:-1]).any(1)]))
                sums = np.add.reduceat(f[at], heads)
                own, keys = own[heads], keys[heads]
                if n in carried:
                    name, key, count = carried.pop(n)
                    if name == names[own[0]] and (key == keys[0]).all():
                        sums[0] += count
                    elif count >= least:
                        yield rows(n, [name], key[None], np.array([count]))
                carried[n] = names[own[-1]], keys[-1].copy(), int(sums[-1])
                out = np.flatnonzero(sums[:-1] >= least)
                if len(out):
                    yield rows(n, [names[i] for i in own[out].tolist()], keys[out], sums[out])
        for n, (name, key, count) in carried.items():
            if count >= least:
                yield rows(n, [name], key[None], np.array([count]))

    return run


def _wide_counts(docs: DataFrame, seed: int, shard_words: int, longest: int, table, known, least: int) -> DataFrame:
    """(lang, w1.., f) of all n-grams with a word without a number that occur at least `least` times.

    Every word's suffix with such a word goes out once a shard, with its count, cut at the first word that doesn't pass the filter; so there
    is at most one row a word, whatever is frequent. Sorted, they give the counts of their prefixes.
    """
    cols = [f"w{k}" for k in range(1, longest + 1)]

    def emit(ids, hashes, lang, lang_hash, names, langs):
        every = np.arange(len(hashes))
        h = _gram_hash(hashes, lang_hash, every, every, 1)
        passes, rare = _passes(known.value, h), table.value.of(h, lang, langs) == 0
        passes[0] = False
        ids = np.concatenate([np.where(passes[ids], ids, 0), np.zeros(longest, ids.dtype)])
        starts, counts = suffixes(ids, longest)
        more = ids[starts + 1] != 0  # single words are counted already
        starts, counts = starts[more], counts[more]
        on, some, columns = np.ones(len(starts), bool), np.zeros(len(starts), bool), []
        for k in range(longest):
            nth = ids[starts + k]
            on = on & (nth != 0)
            some |= on & rare[nth]
            columns.append(pa.array(hashes[nth].view(np.int64), mask=~on))
        batch = pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(lang[ids[starts]])), *columns, pa.array(counts.astype(np.int64))], names=["lang", *cols, "f"])
        yield batch.filter(pa.array(some))

    def with_rare(batches):
        for batch in batches:
            coded, some = batch.column("lang").dictionary_encode(), np.zeros(batch.num_rows, bool)
            for c in cols:
                h = _word_hash(batch.column("lang"), batch.column(c).fill_null(0).to_numpy(), seed)
                some |= batch.column(c).is_valid().to_numpy(zero_copy_only=False) & (table.value.of(h, coded.indices.to_numpy(), coded.dictionary.to_pylist()) == 0)
            yield batch.filter(pa.array(some))

    schema = ", ".join(["lang string", *[f"{c} long" for c in cols], "f long"])
    ends = _scan(docs, seed, shard_words, emit, schema).repartition("lang", *cols[:2]).sortWithinPartitions("w1", "lang", *cols[1:])
    return ends.mapInArrow(_prefixes(longest, least), schema).mapInArrow(with_rare, schema)


def _most_frequent(words: DataFrame, table_words: int) -> pa.Table:
    """(lang, w, n) of the most frequent words, table_words at most; words of equal counts are all among them or none."""
    if words.count() > table_words:
        by_count = words.groupBy("n").count().toArrow().sort_by([("n", "descending")])
        n, up_to = by_count.column("n").to_numpy(), np.cumsum(by_count.column("count").to_numpy())
        fit = int((up_to <= table_words).sum())
        words = words.where(F.col("n") >= int(n[fit - 1])) if fit else words.where("false")
    return words.select("lang", "w", "n").toArrow()


def _exact_counts(docs: DataFrame, seed: int, shard_words: int, longest: int, first: DataFrame, least: int, filter_bytes: int, table_words: int, bucket_rows: int) -> DataFrame:
    """(lang, w1.., f, word, other): exact counts by the words' hashes of all n-grams that occur at least `least` times, with the word's spellings where n is 1."""
    cols = [f"w{k}" for k in range(1, longest + 1)]
    none = F.lit(None).cast("string")
    frequent = first.where("w is not null")
    words = frequent.select("lang", F.col("w").alias("w1"), *[F.lit(None).cast("long").alias(c) for c in cols[1:]], F.col("n").alias("f"), "word", "other")
    number = frequent.count()
    if longest < 2 or not number:
        return words
    numbered = _Numbers(_most_frequent(frequent, table_words), seed, longest, bucket_rows)
    if not numbered.unique:  # two words of different languages: as with two spellings
        return words.withColumn("other", F.concat("word", F.lit(" ")))
    sc = docs.sparkSession.sparkContext
    table = sc.broadcast(numbered)
    total = first.where("w is null").agg(F.sum("n")).first()[0]
    grams = _narrow_counts(docs, seed, shard_words, longest, table, least, -(-total // bucket_rows))
    if number > len(numbered.h):
        known = sc.broadcast(_filter_of(frequent, seed, filter_bytes))
        grams = grams.unionAll(_wide_counts(docs, seed, shard_words, longest, table, known, least))
    return grams.select("*", none.alias("word"), none.alias("other")).unionAll(words)


def phrase_counts(docs: DataFrame, least: int = 100, longest: int = 5, lang_col: str = "lang", text_col: str = "text", shard_words: int = 1 << 19, filter_bytes: int = 1 << 25, table_words: int = 1 << 20, bucket_rows: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Exact counts: (lang, n) of all words, and (lang, w1..w<longest>, f, word) of all n-grams with f >= least.

    w are 64-bit hashes of words (null past the n-gram's end), `word` the word itself where n is 1. Two scans. The first counts words; an n-gram can
    only be frequent if its words are. The frequent ones get numbers, which all tasks are sent; the second scan counts suffixes of numbered words, and their
    prefixes are the n-grams. Only table_words get numbers (fewer than 2^21). Where more are frequent, those go into a bit filter of at most filter_bytes, and a third scan counts the
    n-grams that hold a word without a number. Should two words share a hash, both are among the first scan's words: then it is all done again with another seed.
    """
    docs = only(docs, lang=lang_col, text=text_col).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    for seed in itertools.count():
        first = stored(_first_counts(docs, seed, shard_words).where(F.col("w").isNull() | (F.col("n") >= least)), "words")
        grams = stored(_exact_counts(docs, seed, shard_words, longest, first, least, filter_bytes, min(table_words, (1 << 21) - 1), bucket_rows), "grams")
        if grams.where("word <> other").isEmpty():
            return first.where("w is null").select("lang", "n"), grams.drop("other")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, lang_col: str = "lang", text_col: str = "text", shard_words: int = 1 << 19, filter_bytes: int = 1 << 25, table_words: int = 1 << 20, bucket_rows: int = 1 << 20) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to `longest` words.

    Texts are cut into pieces at `.,;:!?` and line ends, pieces into words at spaces and tabs. a, l, r are the counts of the phrase and of the two parts of its
    lowest-scoring cut (ties: the shortest first part), n the language's number of words, score = floor(1000 a n / (l r)), in exact decimals.
    A phrase within a longer one of the same count isn't listed; ranks follow score, a (both descending) and the phrase.

    A null language is `und`; a null or empty text has no words. Repeated rows count each. Texts are read whole. Empty input gives
    no rows. Further columns of docs are ignored. Ranks are made in shares of a language first, which keep `top` each, so no
    task gets more of a language than 64 times that.
    """
    totals, grams = phrase_counts(docs, least, longest, lang_col, text_col, shard_words, filter_bytes, table_words, bucket_rows)
    cols = [f"w{k}" for k in range(1, longest + 1)]
    length = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    all_grams = stored(grams.select("lang", "f", length.alias("size"), F.filter(F.array(*cols), lambda w: w.isNotNull()).alias("g")), "phrases")
    phrases = all_grams.where("size >= 2")

    part = all_grams.select(F.col("lang"), F.col("g").alias("part"), F.col("f").alias("n_part"))
    inner = F.array(*[F.when((F.lit(i + n - 1) <= F.col("size")) & (F.lit(n) < F.col("size")), F.slice("g", i, n)) for n in range(2, longest) for i in range(1, longest - n + 2)])
    within = phrases.where("size > 2").select("lang", "f", F.explode(F.array_compact(inner)).alias("g")).groupBy("lang", "g").agg(F.max("f").alias("longer"))
    listed = phrases.join(within, ["lang", "g"], "left").where("longer is null or 100 * longer < 100 * f").drop("longer")

    cuts = listed.select("lang", "g", "f", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("head", F.slice(F.col("g"), F.lit(1), F.col("k"))).withColumn("tail", F.slice(F.col("g"), F.col("k") + 1, F.col("size") - F.col("k")))
    cuts = cuts.join(part.select("lang", F.col("part").alias("head"), F.col("n_part").alias("l")), ["lang", "head"]).join(part.select("lang", F.col("part").alias("tail"), F.col("n_part").alias("r")), ["lang", "tail"])
    cuts = cuts.join(totals, "lang")
    big = lambda c: f"cast({c} as decimal(19, 0))"
    cuts = cuts.withColumn("score", F.expr(f"(cast(1000 * {big('f')} as decimal(23, 0)) * cast(n as decimal(14, 0))) div ({big('l')} * {big('r')})"))
    best = cuts.groupBy("lang", "g").agg(F.min(F.struct("score", "k", "l", "r", "f", "n")).alias("m")).select("lang", "g", F.col("m.f").alias("a"), "m.l", "m.r", "m.n", "m.score")

    word = grams.where("w2 is null").select("lang", F.col("w1").alias("w"), "word")
    spelled = best.select("*", F.posexplode("g").alias("i", "w")).join(word, ["lang", "w"])
    spelled = spelled.groupBy("lang", "g", "a", "l", "r", "n", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    for salts in (4096, 64, 1):
        part_of = F.pmod(F.hash("phrase"), F.lit(salts))
        rank = F.row_number().over(Window.partitionBy("lang", part_of).orderBy(F.desc("score"), F.desc("a"), "phrase"))
        spelled = spelled.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return spelled.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
