"""Pieces against the library, phrases and runs against brute force, and all three on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ionframe.llm import phrases, pieces, runs
from ionframe.llm.packing import tokenizer_path

LONG = "word " * 40_000
ODD = [(1, None), (2, ""), (3, "   \t\n"), (None, "a b a b a b a b a"), (5, LONG), (6, "one two. one two"), (6, "one two. one two"), (7, "😀 ünïcode ▁text é\x00 <s> <0x0A>")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.select("doc_id", "text", F.when(F.col("doc_id") != 2, "x").alias("lang"), *[F.lit(7).alias(c) for c in ("ids", "decoded", "runs", "m", "f", "w1", "g", "n", "rank", "phrase")])


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def odd_texts(seed, n):
    r = random.Random(seed)
    some = ["a", "b", "th", "e", " ", "  ", "in", "er", "é", "日", "😀", "\n", "▁", "1", "2", ".", "ing", "\x00", "<s>", "<0x41>"]
    for _ in range(n):
        yield "".join(r.choice(some) for _ in range(r.randint(0, 40)))
    for _ in range(n):
        yield "".join(chr(r.choice([r.randrange(1, 0x250), r.randrange(1, 0xD800), r.randrange(0xE000, 0x110000)])) for _ in range(r.randint(1, 30)))


def test_ids_and_decoded_texts_are_the_library_s(library):
    model = pieces.pieces()
    for text in [*odd_texts(1, 1500), " " * 1000, "x" * 3000, "ab" * 2000, " " * 17 + "x", "▁▁ ▁", "\U0010ffff", "aaaaaaaaab" * 50]:
        ids = model.encode(text)
        assert ids == library.encode(text), text
        assert model.decode(ids) == library.decode(ids), text


def test_any_ids_decode_as_in_the_library(library):
    model, r = pieces.pieces(), random.Random(2)
    for _ in range(3000):
        ids = [r.choice([r.randrange(3, 259), r.randrange(32000)]) for _ in range(r.randint(0, 9))]
        assert model.decode(ids) == library.decode(ids), ids


def test_each_prefix_has_one_last_token():
    model = pieces.pieces()
    for word in ["▁unbelievable", "▁▁▁the", "日本x語", "aaaaaaa"]:
        table = model.last_tokens(word)
        for end in range(1, len(word) + 1):
            ids = model._encode_word(word[:end])
            assert ids[-1] == table[end] or table[end] >= model.size


def test_pieces_of_odd_rows(odd, library):
    rows = sorted(((r.doc_id or 0, r.ids, r.decoded) for r in pieces.encoded(odd).collect()), key=repr)
    assert rows == sorted(((i or 0, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t in ODD), key=repr)
    assert pieces.encoded(odd.where("false")).count() == 0
    got = {r.doc_id: r for r in pieces.digests(odd).collect()}
    assert got[1].n_tokens == 0 and got[1].ids_sha256 == got[1].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[5].ids_sha256 == hashlib.sha256(",".join(map(str, library.encode(LONG))).encode()).hexdigest()
    back = {r.doc_id: r.text for r in pieces.decoded(pieces.encoded(odd).withColumn("text", F.lit(1))).collect()}
    assert back[7] == library.decode(library.encode(ODD[7][1])) and back[1] == ""


def test_ids_outside_the_vocabulary(spark):
    df = spark.createDataFrame([(1, [5, None]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decoded(df).collect()} == {1: pieces.pieces().decode([5]), 2: ""}
    with pytest.raises(Exception, match="outside the vocabulary"):
        pieces.decoded(spark.createDataFrame([(1, [99999])], "doc_id long, ids array<int>")).collect()


def plain_phrases(rows, least, longest, top=2000):
    """The contract of collocations, word by word."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    out = []
    for lang in n:
        own = {g: a for (x, g), a in f.items() if x == lang and a >= least}
        many = {g: a for g, a in own.items() if len(g) > 1}
        rows = []
        for g, a in many.items():
            if any(len(h) > len(g) and 100 * b >= 100 * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in many.items()):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (own[g[:k]] * own[g[k:]]), k, own[g[:k]], own[g[k:]]) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_words, filter_bytes, top", [(1 << 20, 1 << 25, 2000), (40, 128, 2000), (7, 1 << 25, 5)])
def test_phrases_by_brute_force(spark, shard_words, filter_bytes, top):
    r, rows = random.Random(shard_words), []
    for i in range(150):
        words = [r.choice(["a", "B", "cc", "de", "é", "x", "long-word", "b", "q%d" % r.randrange(200)]) + r.choice(["", "", "", ".", ",", "\n", "\x0b", "; "]) for _ in range(r.randint(0, 60))]
        words += ["set phrase of five words"] * r.randint(0, 2) + ["A a a a a a a"] * (i % 5 == 0)
        rows.append((r.choice(["en", "en", "fr", None]), r.choice([" ", "\t", "  "]).join(words)))
    rows += [("en", None), ("zz", ""), (None, " . ")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = phrases.collocations(df, least=4, longest=5, top=top, shard_words=shard_words, filter_bytes=filter_bytes)
    assert sorted(tuple(x) for x in got.collect()) == plain_phrases(rows, 4, 5, top)


def test_a_filter_that_passes_all_changes_nothing(spark):
    rows = [("en", " ".join(random.Random(i).choices("abcdefgh", k=50))) for i in range(40)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(x) for x in phrases.collocations(df, least=3, filter_bytes=1).collect()) == plain_phrases(rows, 3, 5)


def test_hash_collisions_are_found(spark, monkeypatch):
    """Where two words share a hash under a seed, the counts are made again with the next."""
    df = spark.createDataFrame([("en", "aa bb. aa bb. cc aa bb")], "lang string, text string")
    seen = []
    exact = phrases._exact_counts

    def colliding(docs, seed, *rest):
        seen.append(seed)
        out = exact(docs, seed, *rest)
        return out.withColumn("other", F.lit("another word")) if seed == 0 else out

    monkeypatch.setattr(phrases, "_exact_counts", colliding)
    assert [x.phrase for x in phrases.collocations(df, least=2).collect()] == ["aa bb"] and seen == [0, 1]


def test_suffix_array_by_sorting():
    r = np.random.default_rng(3)
    for _ in range(60):
        ids = r.integers(0, 4, r.integers(1, 60))
        for depth in (1, 2, 3, 5, 8):
            order = phrases.suffix_array(ids, depth)
            assert order.tolist() == sorted(range(len(ids)), key=lambda i: (ids[i : i + depth].tolist(), i))


def test_phrases_of_odd_rows(odd):
    got = [tuple(x) for x in phrases.collocations(odd, least=2).collect()]
    assert sorted(got) == plain_phrases([("x" if i not in (None, 2) else None, t) for i, t in ODD], 2, 5)
    assert phrases.collocations(odd.where("false")).count() == 0


def plain_runs(w, least=6, times=4):
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_by_brute_force():
    r = random.Random(3)
    for _ in range(4000):
        k, w = r.randint(1, 4), []
        for _ in range(r.randint(1, 12)):
            x = r.random()
            if x < 0.3:
                w += [r.randrange(k) for _ in range(r.randint(1, 8))]
            elif x < 0.7:
                w += ([r.randrange(k) for _ in range(r.randint(1, 6))] * r.randint(2, 7))[: r.randint(1, 40)]
            elif w:
                s = r.randrange(len(w))
                w += w[s : s + r.randint(1, 40)]
        for least, times in ((6, 4), (2, 2), (1, 3)):
            assert runs.runs(w, least, times) == plain_runs(w, least, times), w


def test_factors_are_the_longest_earlier_ones():
    r = random.Random(5)
    for _ in range(300):
        w = [r.randrange(3) for _ in range(r.randint(0, 60))]
        at = 0
        for start, length, source in runs.factors(w):
            longest = max((n for n in range(len(w) - at + 1) if any(w[s : s + n] == w[at : at + n] for s in range(at))), default=0)
            assert start == at and length == max(1, longest) and (source < 0) == (longest == 0)
            assert source < 0 or source < at and w[source : source + length] == w[at : at + length]
            at += length
        assert at == len(w)


def test_run_digests_by_brute_force(spark):
    r, rows = random.Random(9), []
    for i in range(400):
        rows.append((i, " ".join(r.choices("abcdefghij", k=r.randint(0, 80))) + r.choice(["", " x y" * r.randint(1, 9), "\n" + "z " * r.randint(1, 12)])))
    got = {x.doc_id: x for x in runs.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    some = 0
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(len(w))]
        own = plain_runs(w)
        some += bool(own)
        gone = {j for s, n, q in own for j in range(s + q, s + n)}
        best = min(((-n, s, q) for s, n, q in own), default=None)
        x = got[i]
        assert (x.n_runs, x.start, x.length, x.period, x.exponent_milli) == ((len(own), best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if own else (0, None, None, None, None))
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(" ".join(y for j, y in enumerate(w) if j not in gone).encode()).hexdigest()
    assert some > 50


def test_runs_of_odd_rows(odd):
    got = {x.doc_id: x for x in runs.periodic_runs(odd).collect()}
    assert got[1].runs == got[2].runs == got[3].runs == [] and got[1].text == got[3].text == ""
    assert [tuple(x) for x in got[5].runs] == [(0, 40_000, 1)] and got[5].text == "word"
    assert [tuple(x) for x in got[None].runs] == [(0, 9, 2)] and got[None].text == "a b"
    assert runs.periodic_runs(odd).count() == runs.digests(odd).count() == len(ODD)
    assert runs.digests(odd.where("false")).count() == 0
    with pytest.raises(ValueError, match="two periods"):
        runs.runs([1, 1], 1, 1)


def test_suffixes_are_at_most_one_row_a_word(spark, monkeypatch):
    """Where every n-gram is frequent, the second scan sends one row a word, not one for each length."""
    sent = []
    scan = phrases._scan
    monkeypatch.setattr(phrases, "_scan", lambda *a: sent.append(scan(*a)) or sent[-1])
    rows = [("en", " ".join(str(i) for i in range(200)))] * 3 + [(None, "a a a a a a a . a a")]
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string").coalesce(1), least=3)
    assert sorted(tuple(x) for x in got.collect()) == plain_phrases(rows, 3, 5)
    words = sum(len(t.replace(".", " ").split()) for _, t in rows)
    assert [s.count() for s in sent][-1] <= words


def test_counts_of_prefixes_go_over_batches():
    r = random.Random(4)
    rows = Counter((r.choice(["x", "y"]), *(r.choice([-5, 0, 7]) for _ in range(r.randint(2, 4)))) for _ in range(400))
    plain = Counter()
    for key, f in rows.items():
        plain.update({key[: n + 1]: f for n in range(2, len(key))})
    table = sorted(((k[1], k[0], *((x is not None, x or 0) for x in (*k[2:], None, None, None)[:3])), k, f) for k, f in rows.items())
    for size in (1, 3, 1000):
        batches = []
        for i in range(0, len(table), size):
            part = table[i : i + size]
            columns = [pa.array([k[j] if j < len(k) else None for _, k, _ in part], pa.int64()) for j in range(1, 5)]
            batches.append(pa.RecordBatch.from_arrays([pa.array([k[0] for _, k, _ in part]), *columns, pa.array([f for *_, f in part])], names=["lang", "w1", "w2", "w3", "w4", "f"]))
        out = [x for b in phrases._prefixes(4, 9)(iter(batches)) for x in b.to_pylist()]
        got = {tuple(v for k, v in x.items() if k != "f" and v is not None): x["f"] for x in out}
        assert got == {k: f for k, f in plain.items() if f >= 9} and len(out) == len(got)


@pytest.mark.parametrize("table_words, bucket_rows, longest", [(1 << 20, 100, 5), (4, 300, 5), (4, 1 << 20, 7), (1, 300, 2)])
def test_phrases_with_few_numbers_and_small_buckets(spark, table_words, bucket_rows, longest):
    """Words without a number are counted by their hashes, and a pair spread over buckets is added up again."""
    rows = [(r.choice(["en", "de", None]), " ".join(r.choices("abcdefgh.", weights=[40, 20, 10, 8, 8, 5, 5, 2, 4], k=60))) for r in map(random.Random, range(60))]
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(3)
    got = phrases.collocations(df, least=4, longest=longest, top=100000, shard_words=150, table_words=table_words, bucket_rows=bucket_rows)
    assert sorted(tuple(x) for x in got.collect()) == plain_phrases(rows, 4, longest, 100000)


def test_words_of_two_languages_that_share_a_hash(spark, monkeypatch):
    """Under the first seed one word comes twice, as two that share a hash would; the counts are made again with the next."""
    seen = []
    most = phrases._most_frequent

    def sharing(*args):
        seen.append(most(*args))
        return pa.concat_tables([seen[-1], seen[-1].slice(0, 1)]) if len(seen) == 1 else seen[-1]

    monkeypatch.setattr(phrases, "_most_frequent", sharing)
    df = spark.createDataFrame([("en", "aa bb. aa bb. cc aa bb")], "lang string, text string")
    assert [x.phrase for x in phrases.collocations(df, least=2).collect()] == ["aa bb"]
    assert len(seen) == 2 and seen[0].column("w") != seen[1].column("w")


def test_suffixes_are_sent_in_few_bytes(spark, monkeypatch):
    """What the second scan sends is under 12 bytes a suffix; five hashes and a count were 48."""
    sent = []
    scan = phrases._scan
    monkeypatch.setattr(phrases, "_scan", lambda *a: sent.append(scan(*a)) or sent[-1])
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = [("en", " ".join(r.choices(vocabulary, weights=[1 / (i + 3) for i in range(3000)], k=4000))) for _ in range(20)]
    phrases.phrase_counts(spark.createDataFrame(rows, "lang string, text string").coalesce(1), least=3)
    columns = [f"coalesce(length({c}), 0)" if t in ("binary", "string") else f"if({c} is null, 0, {8 if t == 'bigint' else 4})" for c, t in sent[-1].dtypes]
    assert sent[-1].selectExpr(f"sum({' + '.join(columns)})").first()[0] < 12 * 80_000
