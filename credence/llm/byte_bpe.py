"""Operator 1: byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary is a tiktoken rank file.  Its bytes become characters by the usual byte-to-character
table, and every split of a token into two tokens becomes a merge with that token's rank, so that the
library merges in the order of the ranks.  Each match of the pattern is encoded separately; a worker
keeps the ids of the matches it has met lately (two generations of ``CACHE_WORDS`` at most, and a batch),
and a batch sends only new ones to the library.  Decoding goes through a table from ids to bytes; a character whose bytes lie in several
tokens comes together again because bytes are joined before they are read as UTF-8.

Defined cases: null and empty texts have no ids and decode to empty bytes; an id that is
null or outside the table makes decoding fail; rows stay separate however often they repeat; other columns pass through untouched.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.llm.common import refuse_clash, small_batches, table, worker_state

#: Matches, and pieces between single spaces, whose ids a worker keeps in each of two generations.
CACHE_WORDS = 80_000
#: Longer matches and pieces are encoded but not kept.
CACHE_CHARS = 48
#: Rows per Arrow batch, so that a batch of very long texts stays small.
BATCH_ROWS = 256
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def byte_characters() -> list[str]:
    """Printable Latin-1 bytes stand for themselves, the other bytes for characters from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def pieces_of(text: str) -> list[str]:
    """``text`` cut before each single space between two characters that aren't white space."""
    if not text:
        return []
    if _OTHER_SPACE(text) is None and "  " not in text and "\n " not in text and " \n" not in text and text[0] != " " and text[-1] != " ":
        first, *rest = text.split(" ")
        return [first, *map(" ".__add__, rest)]
    return _BOUNDARY(text)


#: White space other than space and line feed; Python counts a few control characters too, which only means fewer cuts.
_OTHER_SPACE = re.compile(r"[^\S \n]").search
_BOUNDARY = re.compile(r"(?<=\S)(?= \S)").split


class Cache(dict):
    """A table with the one before it: what is met again moves on, the rest goes when the next one is full,
    so that new rare words never push out the common ones."""

    def __init__(self):
        super().__init__()
        self.before: dict[str, bytes] = {}

    def missing(self, wanted: set[str]) -> set[str]:
        """Of ``wanted``, what neither table holds; the rest is in this one from now on."""
        if len(self) > CACHE_WORDS:
            self.before = dict(self)
            self.clear()
        new = wanted.difference(self)
        if back := new.intersection(self.before):
            self.update(zip(back, map(self.before.__getitem__, back)))
            new -= back
        return new


class Codec:
    """One per Python worker: the library's tokenizer, the table of bytes and the cache."""

    def __init__(self, path: str, pattern: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        chars = byte_characters()
        spell = lambda token: "".join(chars[b] for b in token)
        merges = []
        for token, _ in sorted(ranks.items(), key=lambda item: item[1]):
            halves = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            halves.sort(key=lambda pair: (ranks[pair[0]], ranks[pair[1]]))
            merges += [(spell(left), spell(right)) for left, right in halves]
        # Both tokenizers share one model; the words below are the cache.
        model = models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.whole = Tokenizer(model)
        self.whole.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), behavior="isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.bytes_of: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.plain = re.compile(r"[^\u0000-\u024F\u2010-\u2027\u20AC]").search
        self.matches = regex.compile(pattern).findall
        self.words, self.pieces = Cache(), Cache()

    def split(self, text: str) -> list[str]:
        """The matches of the pattern.  Outside of long-settled characters the tables of Unicode differ
        from library to library; there the tokenizers library itself splits."""
        if self.plain(text) is None:
            return self.matches(text)
        return [text[a:b] for _, (a, b) in self.whole.pre_tokenizer.pre_tokenize_str(text)]

    def learn(self, words: list[str]) -> list[bytes]:
        """The ids of single matches, by the library."""
        import numpy as np

        out: list[bytes] = []
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            code = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            packed = np.asarray(code.ids, "<u4").tobytes()
            cut = (4 * np.searchsorted(np.asarray(code.word_ids, "i8"), np.arange(len(part) + 1))).tolist()
            out += [packed[a:b] for a, b in zip(cut, cut[1:])]
        return out

    def packed(self, texts: list[str]) -> list[bytes]:
        """``_packed`` without Python's search for cycles: it makes none, and its many lists would set it off."""
        import gc

        on = gc.isenabled()
        gc.disable()
        try:
            return self._packed(texts)
        finally:
            if on:
                gc.enable()

    def _packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        No match reaches over a single space between two other characters: it begins the match after
        it.  So a text is cut before such spaces, and most pieces are already known.
        """
        cut = [pieces_of(text) for text in texts]
        new = {piece: self.split(piece) for piece in self.pieces.missing(set().union(*cut))}
        unknown = list(self.words.missing(set().union(*new.values())))
        fresh = dict(zip(unknown, self.learn(unknown)))
        kept = {w: p for w, p in fresh.items() if len(w) <= CACHE_CHARS}
        self.words.update(kept)
        look = self.words.__getitem__ if len(kept) == len(fresh) else lambda w: fresh[w] if w in fresh else self.words[w]
        made = {piece: b"".join(map(look, words)) for piece, words in new.items()}
        long = {piece: made.pop(piece) for piece in [p for p in made if len(p) > CACHE_CHARS]}
        self.pieces.update(made)
        look = self.pieces.__getitem__ if not long else lambda p: long[p] if p in long else self.pieces[p]
        return [b"".join(map(look, pieces)) for pieces in cut]

    def text_bytes(self, ids: list[int | None] | None) -> bytes:
        """The bytes that ``ids`` stand for; an id that is null or outside the table is an error."""
        known, n = self.bytes_of, len(self.bytes_of)
        for i in ids or ():
            if i is None or not 0 <= i < n or known[i] is None:
                raise ValueError(f"id {i} is not in the vocabulary")
        return b"".join(known[i] for i in ids or ())

    def unpacked(self, packed: bytes) -> bytes:
        import numpy as np

        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def spans(self, text: str) -> list[tuple[int, int]]:
        """The characters [start, end) that each id touches; ids that share a character overlap."""
        return self.whole.encode(text, add_special_tokens=False).offsets


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec; reading the ranks takes a second, so it stays until another operator comes."""
    return worker_state(f"byte_bpe {path} {pattern}", lambda: Codec(path, pattern))


def vocabulary(path: str | None = None, pattern: str | None = None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN


def _over_batches(df: DataFrame, added: list[T.StructField], column: str, work) -> DataFrame:
    """``df`` with columns added by ``work(values) -> list of columns``, in small Arrow batches."""
    import pyarrow as pa

    names = [f.name for f in added]
    refuse_clash(df, set(names))
    small_batches(df.sparkSession)
    schema = T.StructType([*df.schema.fields, *added])
    kinds = {"IntegerType": pa.int32(), "LongType": pa.int64(), "StringType": pa.string(), "BinaryType": pa.binary()}

    def kind(t):
        if isinstance(t, T.ArrayType):
            return pa.list_(kind(t.elementType))
        if isinstance(t, T.StructType):
            return pa.struct([(f.name, kind(f.dataType)) for f in t.fields])
        return kinds[type(t).__name__]

    arrow = [kind(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                made = work(part.column(part.schema.get_field_index(column)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(v, t) for v, t in zip(made, arrow))], names=[*part.schema.names, *names])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", offsets: str | None = None, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Add ``ids`` (array<int>) and, if named, ``offsets`` (array of character spans) to each row."""
    path, pattern = vocabulary(path, pattern)
    added = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    if offsets:
        added.append(T.StructField(offsets, T.ArrayType(T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)]), False), False))

    def work(values: list[str | None]) -> list[list]:
        import numpy as np

        own = codec(path, pattern)
        texts = [v or "" for v in values]
        out: list[list] = [[np.frombuffer(p, "<u4").astype("i4") for p in own.packed(texts)]]
        if offsets:
            out.append([[{"start": a, "end": b} for a, b in own.spans(t)] for t in texts])
        return out

    return _over_batches(df, added, text, work)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Add the bytes that ``ids`` stand for; a null list gives empty bytes."""
    path, pattern = vocabulary(path)

    def work(values: list[list[int] | None]) -> list[list]:
        own = codec(path, pattern)
        return [[own.text_bytes(v) for v in values]]

    return _over_batches(df, [T.StructField(out, T.BinaryType(), False)], ids, work)


def round_trip(df: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Add n_tokens, ids_sha256 and decoded_sha256: encode, then decode from the ids alone."""
    path, pattern = vocabulary(path, pattern)
    added = [T.StructField("n_tokens", T.LongType(), False), T.StructField("ids_sha256", T.StringType(), False), T.StructField("decoded_sha256", T.StringType(), False)]

    def work(values: list[str | None]) -> list[list]:
        own = codec(path, pattern)
        packed = own.packed([v or "" for v in values])
        digest = lambda b: hashlib.sha256(b).hexdigest()
        return [[len(p) // 4 for p in packed], [digest(p) for p in packed], [digest(own.unpacked(p)) for p in packed]]

    return _over_batches(df, added, text, work)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
