"""Language identification by bit-sliced Bloom filters over character n-grams."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, mix64, only

_NOT_LETTERS = re.compile(r"[\W\d_]+")
SPACE = ord(" ")


def ngrams(texts: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts' lower-cased letters, words parted by one space, and
    how many each text has. A gram may begin or end with a space but hold none inside."""
    clean = [f" {_NOT_LETTERS.sub(' ', t.lower()).strip()} " if t else "  " for t in texts]
    sizes = np.array([len(c) for c in clean])
    code = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    count = max(0, len(code) - n + 1)
    h = np.zeros(count, np.uint64)
    ok = np.ones(count, bool)
    for i in range(n):
        c = code[i : i + count]
        h = (h << np.uint64(21 if n <= 3 else 16)) + c * np.uint64(1 if n <= 3 else 0x9E3779B1)
        if 0 < i < n - 1:
            ok &= c != SPACE
    if n == 2:
        ok &= (code[:count] != SPACE) | (code[1 : 1 + count] != SPACE)
    starts = np.cumsum(sizes) - sizes
    for s in starts[1:]:  # grams that reach over the border of two texts
        ok[max(0, s - n + 1) : s] = False
    doc = np.repeat(np.arange(len(sizes)), sizes)[:count]
    return mix64(h[ok]), np.bincount(doc[ok], minlength=len(sizes))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", n: int = 3, max_docs: int = 2000, min_share: float = 2e-5, hashes: int = 3, bits_each: int = 12) -> dict:
    """The filters' slots from a sample of about max_docs documents per language (those with the
    smallest hashes of their ids); rows whose crc32(id as text) mod 4 is 2 are never used.

    An n-gram enters a language's filter if it makes up min_share of that language's n-grams, so
    a filter holds at most 1 / min_share of them. A slot is a mask with one bit per language.
    Null ids, languages or texts are ignored.
    """
    known = only(docs, doc_id=id_col, text=text_col, lang=lang_col).where("doc_id is not null and lang is not null and crc32(cast(doc_id as string)) % 4 <> 2")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "slots": np.zeros((1, 1), np.uint64), "fill": np.zeros(0), "n": n, "hashes": hashes}
    spark = docs.sparkSession
    rates = spark.createDataFrame([(k, i, int(min(1.0, max_docs / sizes[k]) * (1 << 20)) + 1) for i, k in enumerate(langs)], "lang string, nth int, rate long")
    sample = known.where("text is not null").join(F.broadcast(rates), "lang").where(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(5)), F.lit(1 << 20)) < F.col("rate"))

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text", 2 << 20):
                grams, counts = ngrams(part.column("text").to_pylist(), n)
                nth = np.repeat(np.array(part.column("nth").to_pylist()), counts)
                for k in np.unique(nth):
                    g, c = np.unique(grams[nth == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k), pa.int32()), pa.array(g.view(np.int64)), pa.array(c, pa.int64())], names=["nth", "gram", "c"])

    counted = sample.select("nth", "text").mapInArrow(run, "nth int, gram long, c long").groupBy("nth", "gram").agg(F.sum("c").alias("c"))
    totals = counted.groupBy("nth").agg(F.sum("c").alias("total"))
    kept = counted.join(F.broadcast(totals), "nth").where(F.col("c") >= F.greatest(F.lit(2), F.col("total") * min_share)).select("nth", "gram").toArrow()
    nth, grams = np.array(kept["nth"]), np.array(kept["gram"]).view(np.uint64)
    m = 1 << max(10, int(np.ceil(np.log2(max(1, np.bincount(nth).max() if len(nth) else 1) * bits_each))))
    slots = np.zeros((m, (len(langs) + 63) // 64), np.uint64)
    for where in _places(grams, m, hashes):
        np.bitwise_or.at(slots, (where, nth // 64), np.uint64(1) << (nth % 64).astype(np.uint64))
    fill = np.array([((slots[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(langs))])
    return {"langs": langs, "slots": slots, "fill": fill, "n": n, "hashes": hashes}


def _places(h: np.ndarray, m: int, hashes: int):
    for i in range(hashes):
        yield (h & np.uint64(m - 1)).astype(np.int64)
        h = mix64(h + np.uint64(i + 1))


def identify(texts: list, model: dict) -> tuple[list[str], np.ndarray]:
    """Languages and scores. One look-up returns all languages that may hold an n-gram; each
    language's hits are counted and corrected by its filter's false-positive rate. The score is the
    winner's corrected hits as a share of all languages'; equal hits go to the language first in
    order."""
    langs, slots = model["langs"], model["slots"]
    letters = [bool(t) and any(map(str.isalpha, t)) for t in texts]
    if not langs:
        return ["und"] * len(texts), np.zeros(len(texts))
    grams, counts = ngrams(texts, model["n"])
    held = None
    for where in _places(grams, len(slots), model["hashes"]):
        held = slots[where] if held is None else held & slots[where]
    hits = np.zeros((len(texts), len(langs)))
    full = np.flatnonzero(counts)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        planes = held.view(np.uint8)
        for byte in range((len(langs) + 7) // 8):
            bits = np.unpackbits(planes[:, byte : byte + 1], axis=1, bitorder="little")
            k = min(8, len(langs) - 8 * byte)
            hits[full, 8 * byte : 8 * byte + k] = np.add.reduceat(bits[:, :k], starts, axis=0, dtype=np.int64)
    wrong = model["fill"] ** model["hashes"]
    true = np.maximum(0, hits - wrong * counts[:, None]) / (1 - np.minimum(wrong, 0.999))
    best = true.argmax(1)
    total = true.sum(1)
    score = np.where(total > 0, true[np.arange(len(texts)), best] / np.where(total > 0, total, 1), 0.0)
    return [langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0)


def languages(docs: DataFrame, model: dict | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs, by a model trained on docs if none is given.

    held_out is true where crc32(doc_id as text) mod 4 is 2 (false for a null id). A text that is null, empty or
    without a letter is `und` with score 0, and so is every text if no language could be learned. Texts
    are read whole. Rows are independent: repeats, ties and null ids need no rule. Other columns are
    ignored. Empty input gives no rows.
    """
    model = model or train(docs, text_col, lang_col, id_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text", 2 << 20):
                pred, score = identify(part.column("text").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
