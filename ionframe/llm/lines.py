"""Line deduplication by a deletion-neighbourhood join.

Lines are sequences of words (between ASCII white space, A-Z lower-cased). A line of min_words words or
more goes if an equal line comes before it in order of (doc_id, line number); a line of edit_words words
or more also goes if a line that differs by one word (put in, left out or replaced) comes before it.

All hashes are polynomials over 64-bit word hashes modulo 2^64, so that the hash of any stretch of a line, and
of a line without one word, comes from prefix sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, mix64, only, stored

_P = np.uint64(0xD6E8FEB86659FD93)
_Q = np.uint64(0xA0761D6478BD642F)
_INVERSE = {p: np.uint64(pow(int(p), -1, 1 << 64)) for p in (_P, _Q)}


def split_words(line: str) -> list[bytes]:
    return line.encode("utf-8", "surrogatepass").lower().split()


class Words:
    """Prefix hashes over the words of many lines, laid end to end."""

    def __init__(self, lines: list[list[bytes]]):
        self.n = np.array([len(w) for w in lines], np.int64)
        self.start = np.cumsum(self.n) - self.n
        total = int(self.n.sum())
        w = np.fromiter((xxhash.xxh3_64_intdigest(x) for ws in lines for x in ws), np.uint64, total)
        self.sums, self.powers, self.back = {}, {}, {}
        for p in (_P, _Q):
            steps = np.full(total + 1, p, np.uint64)
            steps[0] = 1
            self.powers[p] = np.multiply.accumulate(steps)
            steps[1:] = _INVERSE[p]
            self.back[p] = np.multiply.accumulate(steps)
            self.sums[p] = np.concatenate([[np.uint64(0)], np.cumsum((w if p == _P else mix64(w + _Q)) * self.powers[p][:-1], dtype=np.uint64)])

    def stretch(self, lo: np.ndarray, hi: np.ndarray, p: np.uint64 = _P) -> np.ndarray:
        """Hashes of the words lo..hi-1."""
        return (self.sums[p][hi] - self.sums[p][lo]) * self.back[p][lo]

    def whole(self, p: np.uint64 = _P) -> np.ndarray:
        return mix64(self.stretch(self.start, self.start + self.n, p) + self.n.astype(np.uint64) * _Q)

    def without(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, place, hash) of every line without each of its words."""
        line = np.repeat(np.arange(len(self.n)), self.n)
        at = np.arange(len(line))
        place = at - self.start[line]
        end = (self.start + self.n)[line]
        left, right = self.stretch(self.start[line], at), self.stretch(at + 1, end)
        return line, place, mix64(left + right * self.powers[_P][place] + (self.n[line] - 1).astype(np.uint64) * _Q)


def halves(w: Words, edit_words: int) -> list[np.ndarray | None]:
    """For each line of edit_words words, keys of its first and last h words, h = n // 2 and (n - 1) // 2.

    Two lines one edit apart have an h in common and agree on the first or on the last h words, so only lines that
    share such a key with another need their deletion variants made."""
    out: list[np.ndarray | None] = [None] * len(w.n)
    long = np.flatnonzero(w.n >= max(2, edit_words))
    n, lo = w.n[long], w.start[long]
    keys = []
    for h in (n // 2, (n - 1) // 2):
        tag = h.astype(np.uint64) * _Q
        keys += [mix64(w.stretch(lo, lo + h) + tag), mix64(w.stretch(lo + n - h, lo + n) + tag + np.uint64(1))]
    for i, row, odd in zip(long.tolist(), np.stack(keys, 1).view(np.int64) if len(long) else [], n % 2 == 1, strict=True):
        out[i] = row[:2] if odd else row
    return out


def _read(batches, min_words, edit_words):
    """One row per line that has min_words words."""
    for batch in batches:
        for part in chunks(batch, "text", 4 << 20):
            ids, numbers, lines = [], [], []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                for k, line in enumerate(text.split("\n")):
                    ws = split_words(line)
                    if len(ws) >= min_words:
                        ids.append(doc)
                        numbers.append(k)
                        lines.append(ws)
            if lines:
                w = Words(lines)
                key = np.stack([w.whole(), w.whole(_Q)], 1)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(key), [None, pa.py_buffer(np.ascontiguousarray(key))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), raw, pa.array(halves(w, edit_words), pa.list_(pa.int64()))], names=["doc_id", "line_no", "key", "halves"])


def _pick(batches):
    """The texts of a document's wanted lines."""
    for batch in batches:
        for part in chunks(batch, "text"):
            rows = []
            for doc, text, wanted in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "wanted")), strict=True):
                lines = text.split("\n")
                rows += [(doc, k, lines[k]) for k in wanted if k < len(lines)]
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], names=["doc_id", "line_no", "line"])


def _variants(batches):
    """Keys of each line: whole (kind 1), without each word (kind 2), and without a word at a place, which
    lines share that differ in that word alone (kind 0)."""
    for batch in batches:
        for part in chunks(batch, "line", 1 << 20):
            w = Words([split_words(x) for x in part.column("line").to_pylist()])
            line, place, gone = w.without()
            keys = np.concatenate([mix64(gone ^ mix64(place.astype(np.uint64) + _Q)), w.whole(), gone])
            which = np.concatenate([line, np.arange(len(w.n)), line])
            kind = np.repeat(np.array([0, 1, 2], np.int8), [len(line), len(w.n), len(line)])
            at = pa.array(which)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(kind), part.column("doc_id").take(at), part.column("line_no").take(at)], names=["vkey", "kind", "doc_id", "line_no"])


def one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether two lines are at most one word apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    short = min(len(a), len(b))
    front = next((i for i in range(short) if a[i] != b[i]), short)
    back = next((i for i in range(short) if a[-1 - i] != b[-1 - i]), short)
    return front + back >= max(len(a), len(b)) - 1


def _check(batches):
    for part in (x for batch in batches for half in chunks(batch, "line") for x in chunks(half, "first_line")):
        ok = [one_edit(split_words(a), split_words(b)) for a, b in zip(part.column("line").to_pylist(), part.column("first_line").to_pylist(), strict=True)]
        yield part.select(["doc_id", "line_no"]).filter(pa.array(ok, pa.bool_()))


def _strip(batches):
    for batch in batches:
        for part in chunks(batch, "text"):
            texts, counts, gone = [], [], []
            for text, drop in zip(part.column("text").to_pylist(), part.column("gone").to_pylist(), strict=True):
                lines = text.split("\n") if text is not None else []
                held = set(drop or ())
                texts.append("\n".join(x for k, x in enumerate(lines) if k not in held) if held else text)
                counts.append(len(lines))
                gone.append(len(held))
            at = part.schema.get_field_index("text")
            cols = [*part.columns[:-1], pa.array(counts, pa.int64()), pa.array(gone, pa.int64())]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=[*part.schema.names[:-1], "n_lines", "n_removed"])


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5, edit_words: int = 5) -> DataFrame:
    """(doc_id, line_no) of every line that goes; lines are numbered from 0 within a text.

    Whether an earlier line exists decides, not whether that line is kept itself. A key's earliest line stands for all that
    share it: any two lines with a key of kind 0, and a whole line with the lines that give it by leaving
    out a word, are within one edit. So a hot key costs its rows, never its pairs. The earliest partner
    is compared word by word before the line goes.

    Null texts and null ids have no lines here: they neither go nor make others go. Rows that repeat an id have the
    same line numbers, so they keep or lose the same lines and are never each other's copies.
    """
    own = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).where("doc_id is not null and text is not null")
    lines = stored(own.mapInArrow(lambda b: _read(b, min_words, edit_words), "doc_id long, line_no int, key binary, halves array<long>"), "lines")
    place = F.struct("doc_id", "line_no")
    classes = stored(lines.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("many"), F.first("halves").alias("halves")), "classes")
    keyed = classes.where("halves is not null").select(F.explode(F.array_distinct("halves")).alias("half"), "first.doc_id", "first.line_no")
    shared = stored(keyed.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half"), "shared")
    wanted = keyed.join(shared, "half").groupBy("doc_id").agg(F.collect_set("line_no").alias("wanted"))
    near = stored(own.hint("merge").join(stored(wanted, "wanted"), "doc_id").mapInArrow(_pick, "doc_id long, line_no int, line string"), "near")
    variants = near.mapInArrow(_variants, "vkey long, kind byte, doc_id long, line_no int")
    of = lambda k: F.min(F.when(F.col("kind") == k, place))
    least = stored(variants.groupBy("vkey").agg(of(0).alias("same"), of(1).alias("whole"), of(2).alias("less"), F.count("*").alias("n")).where("n > 1").drop("n"), "least")
    partner = F.when(F.col("kind") == 0, F.col("same")).when(F.col("kind") == 1, F.col("less")).otherwise(F.col("whole"))
    found = variants.join(least, "vkey").select("doc_id", "line_no", partner.alias("p")).where(F.col("p") < place).groupBy("doc_id", "line_no").agg(F.min("p").alias("p"))
    pairs = stored(found.select("doc_id", "line_no", F.col("p.doc_id").alias("first_doc"), F.col("p.line_no").alias("first_no")), "partners")
    first = near.select(F.col("doc_id").alias("first_doc"), F.col("line_no").alias("first_no"), F.col("line").alias("first_line"))
    close = pairs.join(near, ["doc_id", "line_no"]).join(first, ["first_doc", "first_no"]).select("doc_id", "line_no", "line", "first_line").mapInArrow(_check, "doc_id long, line_no int")
    close = stored(close.select(place.alias("first"), F.lit(True).alias("close")), "close")
    again = classes.where("many > 1").select("key", "first").unionAll(classes.where("many = 1").join(close.select("first"), "first").select("key", "first")).join(close, "first", "left")
    again = stored(again, "repeated")
    gone = lines.select("doc_id", "line_no", "key").join(again, "key").where(F.coalesce("close", F.lit(False)) | (place != F.col("first")))
    return gone.select("doc_id", "line_no").distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with the lines of removed_lines taken out of the text; n_lines (before) and n_removed follow.

    Texts are joined by sort-merge at every size, as the decisions' table grows with the corpus. A text
    that loses all its lines is empty. Null texts stay null, with 0 lines; empty texts have one
    empty line. Other columns stay, except those named n_lines or n_removed. Empty input gives no rows.
    """
    gone = stored(removed_lines(docs, id_col, text_col, **how).groupBy("doc_id").agg(F.collect_list("line_no").alias("gone")).withColumnRenamed("doc_id", "_gone_id"), "gone")
    rest = docs.drop("n_lines", "n_removed")
    names = rest.columns
    plain = rest.toDF(*["text" if c == text_col else f"c{i}" for i, c in enumerate(names)])
    renamed = plain.hint("merge").join(gone, F.col(f"c{names.index(id_col)}") == F.col("_gone_id"), "left").drop("_gone_id")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in renamed.schema.fields[:-1]) + ", n_lines long, n_removed long"
    return renamed.mapInArrow(_strip, schema).toDF(*names, "n_lines", "n_removed")
