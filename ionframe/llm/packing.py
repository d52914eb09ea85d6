"""Packing of tokenised documents into fixed-length sequences by vector bin packing."""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, only

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
_LOADED: dict = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(json_path: str | None = None, special: bool = True):
    """text -> uint32 ids of a byte-level BPE vocabulary, as the tokenizers library gives them with add_special_tokens=False.

    Added tokens of the file, such as <|endoftext|>, that stand in a text get their own id, as the library's default is; with
    special=False they are ordinary text. A vocabulary that lies beside its rank file (same name, `.tiktoken`) is run from the ranks: the ids
    are the same at several times the speed (a test compares them). Any other file, and one whose added tokens
    strip or need word borders, goes through the tokenizers library.
    """
    json_path = json_path or tokenizer_path("byte_bpe_50k.json")
    if (json_path, special) not in _LOADED:
        ranks_path = os.path.splitext(json_path)[0] + ".tiktoken"
        with open(json_path, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens") or []
        if os.path.exists(ranks_path) and not any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")):
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            own = {t["content"]: t["id"] for t in added} if special else {}
            enc = tiktoken.Encoding(os.path.basename(json_path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=own)
            _LOADED[json_path, special] = lambda text: enc.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(json_path)
            tok.encode_special_tokens = not special
            _LOADED[json_path, special] = lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, np.uint32)
    return _LOADED[json_path, special]


def pack_vectors(tokens: np.ndarray, loss: np.ndarray, room: int, max_segments: int, max_loss: int) -> list[list[int]]:
    """Bins of item numbers by the dot-product heuristic.

    Each open bin takes the item that fits and has the greatest dot product of its demands
    with the bin's remaining room (tokens, segments, loss-bearing tokens, each as a share of
    the limit), until none fits. Items with equal demands are alike, so a step looks at
    the distinct demands only; ties go to the demand listed first, then to the item that came
    first. An item with more than a whole bin's tokens or loss tokens must be cut before.
    """
    if not len(tokens):
        return []
    kinds, of = np.unique(np.stack([tokens, loss], 1), axis=0, return_inverse=True)
    order = np.argsort(of, kind="stable")
    first = np.searchsorted(of[order], np.arange(len(kinds)))
    left = np.bincount(of, minlength=len(kinds))
    share = np.stack([kinds[:, 0] / room, np.full(len(kinds), 1 / max_segments), kinds[:, 1] / max_loss], 1)
    bins = []
    live = np.arange(len(kinds))
    todo = len(tokens)
    while todo:
        used, got = np.zeros(3, np.int64), []
        while len(got) < max_segments and todo:
            k = kinds[live]
            fits = (k[:, 0] + used[0] <= room) & (k[:, 1] + used[2] <= max_loss)
            if not fits.any():
                break
            rest = np.array([1 - used[0] / room, 1 - used[1] / max_segments, 1 - used[2] / max_loss])
            at = live[np.where(fits, share[live] @ rest, -1).argmax()]
            got.append(int(order[first[at]]))
            first[at] += 1
            left[at] -= 1
            todo -= 1
            used += (kinds[at, 0], 1, kinds[at, 1])
            if not left[at]:
                live = live[live != at]
        bins.append(got)
    return bins


def _take(piece: tuple, n: int) -> tuple[tuple, tuple | None]:
    """A piece's first n tokens, and what is left of it."""
    doc, start, length, bearing, ids, whole, silent = piece
    if n >= length:
        return piece, None
    part = n - max(0, min(silent - start, n))
    return (doc, start, n, part, ids[:n], whole, silent), (doc, start + n, length - n, bearing - part, ids[n:], whole, silent)


def _fit(piece: tuple, tokens: int, loss: int) -> int:
    """How many of a piece's first tokens fit into so many tokens and loss-bearing tokens."""
    return min(piece[2], tokens, max(0, piece[6] - piece[1]) + loss)


def _lay_out(pieces: list[tuple], room: int, max_segments: int, max_loss: int, next_id: int, final: bool) -> tuple[list[tuple], list[tuple], int]:
    """Rows for full sequences. A bin's gap is filled with a cut from the last bin. What can't be
    filled goes back to the pool, or, at the end, is cut to sequences of power-of-two length, which
    need no padding."""
    tokens = np.array([p[2] for p in pieces], np.int64)
    loss = np.array([p[3] for p in pieces], np.int64)
    bins = deque([pieces[i] for i in got] for got in pack_vectors(tokens, loss, room, max_segments, max_loss))
    rows, back = [], []

    def put(got: list[tuple]) -> None:
        nonlocal next_id
        offset = 0
        for doc, start, n, bearing, ids, whole, _ in got:
            rows.append((doc, start, n, zlib.crc32(ids.astype("<u4").tobytes()), whole, next_id, offset, bearing))
            offset += n
        next_id += 1

    while bins:
        got = bins.popleft()
        gap, bear = room - sum(p[2] for p in got), max_loss - sum(p[3] for p in got)
        while gap and bins and len(got) < max_segments and (n := _fit(bins[-1][-1], gap, bear)):
            part, rest = _take(bins[-1].pop(), n)
            bins[-1] += [rest] if rest else []
            if not bins[-1]:
                bins.pop()
            got.append(part)
            gap, bear = gap - part[2], bear - part[3]
        if not gap:
            put(got)
        elif not final:
            back += got
        else:
            total = room - gap
            for size in (1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1):
                own = []
                while size:
                    part, rest = _take(got.pop(0), size)
                    got[:0] = [rest] if rest else []
                    own.append(part)
                    size -= part[2]
                put(own)
    return rows, back, next_id


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", silent_col: str | None = None, length: int = 1024, max_segments: int = 64, max_loss: int | None = None, end_id: int = 0, path: str | None = None, window: int = 4096, special: bool = True) -> DataFrame:
    """Pack whole documents into sequences of at most `length` tokens; one row per piece.

    Each document is its ids and then end_id. silent_col may name a column with the number of
    leading ids that bear no loss (a prompt's); the rest bears loss. A sequence is bound by
    tokens, by max_segments pieces and by max_loss loss-bearing tokens (default: length). Full
    stretches of a document fill sequences of their own; the rests are packed by pack_vectors
    in windows of `window` rests; a gap that is left in a bin is filled with a cut from another,
    and what a window can't fill goes on to the next. At the end of a partition the unfilled bin is
    cut to powers of two, so no sequence has padding.
    Where max_loss is less than length, cuts also keep a piece within it.

    Strings of the vocabulary's added tokens in a text are those tokens, or with special=False ordinary text.

    Every partition of the input packs alone, without a shuffle; sequence_id is the partition
    number times 2^40 plus a counter, so a task that runs again gives the same rows.

    A null text is an empty one (one piece with end_id alone). A null id stays null. Repeated rows
    are packed each. Very long texts become many pieces. Empty input gives no rows. Further columns
    of docs are ignored.
    """
    cap = length if max_loss is None else max_loss
    if not 0 < cap <= length or max_segments < 1:
        raise ValueError("max_loss must be in 1..length and max_segments positive")
    named = {"doc_id": id_col, "text": text_col} | ({"silent": silent_col} if silent_col else {})

    def run(batches):
        ids_of = encoder(path, special)
        next_id = TaskContext.get().partitionId() << 40
        pool: list[tuple] = []
        names = [x.split(" ")[0] for x in PIECES.split(", ")]
        schema = pa.schema([(n, pa.int64()) for n in names])
        emit = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = []
                silent = part.column("silent").to_pylist() if silent_col else [0] * part.num_rows
                for doc, text, quiet in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), silent, strict=True):
                    ids = np.append(ids_of(text or ""), np.uint32(end_id))
                    whole, at, quiet = len(ids), 0, max(0, quiet or 0)
                    while whole - at >= length and cap == length:
                        n = length
                        rows.append((doc, at, n, zlib.crc32(ids[at : at + n].astype("<u4").tobytes()), whole, next_id, 0, n - max(0, min(quiet - at, n))))
                        next_id += 1
                        at += n
                    while at < whole:
                        n = min(whole - at, length)
                        bearing = n - max(0, min(quiet - at, n))
                        if bearing > cap:
                            n, bearing = n - (bearing - cap), cap
                        pool.append((doc, at, n, bearing, ids[at : at + n].copy(), whole, quiet))  # a copy lets go of the document
                        at += n
                if len(pool) >= window:
                    more, pool, next_id = _lay_out(pool, length, max_segments, cap, next_id, False)
                    rows += more
                    if len(pool) > window // 2:  # bins that another limit closed before they were full
                        more, pool, next_id = _lay_out(pool, length, max_segments, cap, next_id, True)
                        rows += more
                if rows:
                    yield emit(rows)
        rows, _, _ = _lay_out(pool, length, max_segments, cap, next_id, True)
        if rows:
            yield emit(rows)

    return only(docs, **named).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, PIECES)
