"""Encoding and decoding with merge-type piece vocabularies (BPE models of sentencepiece)."""

from __future__ import annotations

import re
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, only
from .packing import tokenizer_path

SPACE = "▁"
_START = (1 << 22) - 1  # stands before a text's first token
_LOADED: dict = {}


class _Memo(dict):
    """A dict that makes what it lacks and starts anew at `limit` entries; long keys aren't kept."""

    def __init__(self, make, limit: int, longest: int = 1 << 30):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key):
        value = self.make(key)
        if isinstance(key, str) and len(key) > self.longest:
            return value
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


class Pieces:
    """A BPE model of sentencepiece, encoded by prefix tables instead of an agenda of merges.

    The greedy merges give each prefix of a text exactly one last token, and the tokens before it are the
    prefix's that it leaves. So one pass with an automaton over the pieces fills a table: of the pieces that end at a
    position, the last token is the one that is compatible with the last token before it, i.e. the merges of
    the two never cross their border. The table is linear in the text; ids are read off it backwards.

    No piece holds a space mark after another character in models that split at white space; then merges can't
    cross such a place and each word is encoded once. Other models get whole texts.
    """

    def __init__(self, path: str, cached_words: int = 600_000):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        sp = SentencePieceProcessor(model_file=path)
        kinds = {p.type for p in model.pieces}
        if train.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or train.treat_whitespace_as_suffix or model.denormalizer_spec.precompiled_charsmap:
            raise ValueError("only BPE models that leave their text as it is are supported")
        if not kinds <= {1, 2, 3, 6}:
            raise ValueError("user-defined and unused pieces aren't supported")
        self.dummy = norm.add_dummy_prefix
        self.unknown = sp.unk_id()
        self.size = len(model.pieces)
        self.text = [p.piece for p in model.pieces]
        self.length = [len(x) for x in self.text]
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.chars = {x for x in self.score if len(x) == 1}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.is_byte = np.array([p.type == 6 for p in model.pieces])
        self.surface = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3 else train.unk_surface.encode() if p.type == 2 else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(model.pieces):
            if p.type == 1:
                self.automaton.add_word(p.piece, (i, len(p.piece)))
        self.automaton.make_automaton()
        inner = any(SPACE in p.lstrip(SPACE) for p in self.score)
        self.words = (lambda text: [text]) if inner else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self._history = _Memo(self._merges, 1 << 20)
        self._pairs = _Memo(lambda key: self._compatible(key >> 22, key & 0x3FFFFF), 1 << 20)
        self._ids = _Memo(self._encode_word, cached_words, 64)

    def _merges(self, token: int) -> tuple | None:
        """What a token's own merges do to its borders: the score of each merge in turn, and its first and last symbol
        before and after each. None if the merges don't end in the token. Tokens past the vocabulary are single characters."""
        symbols = list(self.text[token]) if token < self.size else [chr(token - self.size)]
        scores, first, last = [], [symbols[0]], [symbols[-1]]
        while len(symbols) > 1:
            found = [(-s, i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (s := self.score.get(a + b)) is not None]
            if not found:
                return None
            least, i = min(found)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            scores.append(-least)
            first.append(symbols[0])
            last.append(symbols[-1])
        return scores, first, last

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the merges of two tokens side by side leave both as they are: each turn takes the best of a's next
        merge, the merge across the border and b's next merge; of equals, the leftmost."""
        two = self._history[b]
        if two is None or a == _START:
            return two is not None
        one = self._history[a]
        if one is None:
            return False
        (own, _, last), (other, first, _) = one, two
        i = j = 0
        low = -float("inf")
        while True:
            left = own[i] if i < len(own) else low
            right = other[j] if j < len(other) else low
            across = self.score.get(last[i] + first[j], low)
            if across > left and across >= right:
                return False
            if left == right == low:
                return True
            if left >= right:
                i += 1
            else:
                j += 1

    def last_tokens(self, word: str) -> list[int]:
        """The last token of each prefix of word; that of the empty one is _START."""
        table, pairs = [_START] + [-1] * len(word), self._pairs
        if self.chars.issuperset(word):
            for end, (token, length) in self.automaton.iter(word):
                if table[end + 1] < 0 and pairs[table[end + 1 - length] << 22 | token]:
                    table[end + 1] = token
            return table
        found: dict[int, list] = {}
        for end, match in self.automaton.iter(word):
            found.setdefault(end, []).append(match)
        for end, char in enumerate(word):  # a character that is no piece is a token of its own, unless a longer piece ends there
            options = found.get(end, []) + ([] if char in self.chars else [(self.size + ord(char), 1)])
            table[end + 1] = next(token for token, length in options if pairs[table[end + 1 - length] << 22 | token])
        return table

    def _encode_word(self, word: str) -> tuple[int, ...]:
        table, end, ids = self.last_tokens(word), len(word), []
        while end:
            token = table[end]
            if token < self.size:
                ids.append(token)
                end -= self.length[token]
            else:
                char = word[end - 1].encode()
                ids.extend([self.bytes[x] for x in reversed(char)] if self.bytes else [self.unknown])
                end -= 1
        return tuple(reversed(ids))

    def encode(self, text: str) -> list[int]:
        """The ids of a text, as the library's encode gives them."""
        if not text:
            return []
        text = (SPACE + text if self.dummy else text).replace(" ", SPACE)
        ids = list(chain.from_iterable(map(self._ids.__getitem__, self.words(text))))
        if self.bytes or self.unknown not in ids:
            return ids
        return [x for i, x in enumerate(ids) if x != self.unknown or not i or ids[i - 1] != x]  # a run of unknown symbols is one

    def decode(self, ids) -> str:
        """The text of ids, as the library's decode gives it: byte pieces in a row are UTF-8, each byte that isn't is U+FFFD."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._decode_runs(ids)
        if not self.dummy:
            return text
        spaced = next((self.text[i].startswith(SPACE) for i in ids if self.surface[i] or self.is_byte[i]), False)
        return text[1:] if spaced else text

    def _decode_runs(self, ids) -> str:
        out, run = [], b""
        for i in chain(ids, [-1]):
            if i >= 0 and self.is_byte[i]:
                run += self.surface[i]
                continue
            while run:
                for n in range(1, min(4, len(run)) + 1):
                    try:
                        out.append(run[:n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    out.append("�")
                run = run[n:]
            if i >= 0:
                out.append(self.surface[i].decode())
        return "".join(out)


def pieces(path: str | None = None) -> Pieces:
    """The model at a path (default: the public 32k one), loaded once a worker."""
    path = path or tokenizer_path("piece_bpe_32k.model")
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded string): the ids of each whole text and the text that they decode to.

    One row per row of docs, without a shuffle. A null text is an empty one: no ids, the empty text. A null id stays null,
    repeated rows are encoded each, texts of any length are read whole. Empty input gives no rows. Further columns of docs are ignored.
    """

    def run(batches):
        model = pieces(path)
        for batch in batches:
            for part in chunks(batch, "text"):
                ids = [model.encode(t or "") for t in part.column("text").to_pylist()]
                flat = np.fromiter(chain.from_iterable(ids), np.int32)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                texts = pa.array([model.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, texts], names=["doc_id", "ids", "decoded"])

    return only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def decoded(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, text): the text of each row's ids. Null ids, and nulls among ids, are as if they were left out; an id
    outside the vocabulary is an error."""

    def run(batches):
        model = pieces(path)
        for batch in batches:
            ids = [[i for i in x or () if i is not None] for x in batch.column("ids").to_pylist()]
            if any(not 0 <= i < model.size for x in ids for i in x):
                raise ValueError("an id outside the vocabulary")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([model.decode(x) for x in ids], pa.string())], names=["doc_id", "text"])

    return only(df, doc_id=id_col, ids=ids_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded()'s rows: its ids in decimal, joined by commas, and its decoded text."""
    hexed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded(docs, path=path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(hexed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
