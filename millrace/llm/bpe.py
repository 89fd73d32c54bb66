"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash over its last bytes says so: the same passage is cut alike in
every document. A chunk is encoded once for all documents of a worker (a bounded memo), but for
its ragged ends. A join of chunks is repaired by encoding the ends on both sides again with the
library, together with a word that each side has encoded already. Where the ids of these two
words come out as they were, both sides agree with the window and it replaces the join; else, or
where a chunk has no such word, the window takes in more, at last the whole text.

The memo belongs to a worker, not to the cluster: a cluster-wide one needs two shuffles of the
corpus (chunks there, ids back), which costs more than the encoding it saves.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import kept

#: Bytes of the words' memo and of the chunks' memo of a worker; a full one is emptied.
WORD_MEMO_BYTES = 96_000_000
CHUNK_MEMO_BYTES = 24_000_000
#: What an entry of two byte strings takes beside their bytes: the objects and its share of the table.
ENTRY = 170
#: Bytes under the rolling hash, and the mean and least length of a chunk.
WINDOW, MEAN_CHUNK, MIN_CHUNK = 16, 1024, 64
BLANK = re.compile(rb"[ \t\n\r\x0b\x0c]")
BLANKS = (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")
#: Characters whose lower case, composition and class are the same in any Unicode version.
PLAIN = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
BIG_ENDIAN = sys.byteorder == "big"
LETTERS = "a-z\xdf-\xf6\xf8-\xff"


class WordEncoder(dict):
    """Blank-free bytes -> their ids as little-endian uint16, as the tokenizers library gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        if self.whole.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit in 16 bits")
        self.model = self.whole.model
        self.byte_chars = byte_alphabet()
        self.pieces = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")
        self.piece_memo: dict[str, bytes] = {}
        self.held = 0
        # The split into pieces below is the one of this pre-tokenizer; any other goes the library's way.
        spec = self.whole.pre_tokenizer.__getstate__() if self.whole.pre_tokenizer else b""
        self.plain = rb"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in spec

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if not self.plain or "<|" in text or not (text.isascii() and text.isprintable() or PLAIN.fullmatch(text)):
            out = packed(self.whole.encode(text, add_special_tokens=False).ids)
        else:
            low = text.lower()
            if low.isalpha():
                out = self.piece_memo.get(low) or self.piece(low)
            elif low[-1] in ".," and low[:-1].isalpha():
                out = (self.piece_memo.get(low[:-1]) or self.piece(low[:-1])) + (self.piece_memo.get(low[-1]) or self.piece(low[-1]))
            else:
                out = b"".join([self.piece_memo.get(p) or self.piece(p) for p in self.pieces.findall(low)])
        size = len(word) + len(out) + ENTRY
        self.make_room(size)
        if size <= WORD_MEMO_BYTES:
            self[word] = out
            self.held += size
        return out

    def make_room(self, size: int) -> None:
        if self.held + size > WORD_MEMO_BYTES:
            self.clear()
            self.piece_memo.clear()
            self.held = 0

    def piece(self, p: str) -> bytes:
        chars = p if p.isascii() else "".join(map(self.byte_chars.__getitem__, p.encode()))
        out = packed([t.id for t in self.model.tokenize(chars)])
        size = len(p) + len(out) + ENTRY
        self.make_room(size)
        if size <= WORD_MEMO_BYTES:
            self.piece_memo[p] = out
            self.held += size
        return out

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def packed(ids: list[int]) -> bytes:
    """Little-endian uint16."""
    out = array("H", ids)
    if BIG_ENDIAN:
        out.byteswap()
    return out.tobytes()


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself if it is a visible Latin-1 character, else the next of U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256))
    return [chr(b) if b in shown else chr(256 + next(rest)) for b in range(256)]


_SPREAD = np.random.default_rng(8).integers(0, 2**32, 256, dtype=np.uint32)


def chunk_ends(data: bytes) -> list[int]:
    """Where chunks end: the rolling hash of the last WINDOW bytes is 0 modulo MEAN_CHUNK, at a character's end."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n]
    raw = np.frombuffer(data, dtype=np.uint8)
    h, m, w = _SPREAD[raw], 0x9E3779B1, 1
    while w < WINDOW:  # each doubling joins two neighbouring windows
        longer = h.copy()
        longer[w:] += h[:-w] * np.uint32(m)
        h, m, w = longer, m * m % (1 << 32), 2 * w
    at = np.flatnonzero((h >> np.uint32(16)) % MEAN_CHUNK == 0) + 1
    at = at[at < n]
    at = at[(raw[at] & 0xC0) != 0x80]
    ends, last = [], 0
    for e in at.tolist():
        if e - last >= MIN_CHUNK:
            ends.append(e)
            last = e
    return [*ends, n]


@dataclass(slots=True)
class Chunk:
    """A piece of text: up to its first blank, the ids from there to its last blank, and the text from there on; the first and the last word between.

    Without a word between blanks it is all head.
    """

    head: bytes
    ids: bytes = b""
    tail: bytes = b""
    first: bytes = b""
    last: bytes = b""


class ChunkEncoder:
    """Whole texts to ids, by chunks."""

    def __init__(self, path: str):
        self.words = WordEncoder(path)
        self.memo: dict[bytes, Chunk] = {}
        self.joins: dict[bytes, bytes | None] = {}
        self.held = 0

    def keep(self, memo: dict, key: bytes, value, size: int):
        size += len(key) + 400
        if self.held + size > CHUNK_MEMO_BYTES:
            self.memo.clear()
            self.joins.clear()
            self.held = 0
        if size <= CHUNK_MEMO_BYTES:
            self.held += size
            memo[key] = value
        return value

    def chunk(self, piece: bytes) -> Chunk:
        if (known := self.memo.get(piece)) is not None:
            return known
        blank = BLANK.search(piece)
        out = Chunk(piece)
        if blank is not None:
            tail = piece[max(map(piece.rfind, BLANKS)) + 1 :]
            between = piece[blank.start() : len(piece) - len(tail)].split()
            if between:
                out = Chunk(piece[: blank.start()], b"".join(map(self.words.__getitem__, between)), tail, between[0], between[-1])
        return self.keep(self.memo, piece, out, len(out.ids))

    def whole(self, text: bytes) -> bytes:
        return packed(self.words.whole.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def join(self, before: bytes, ragged: bytes, after: bytes) -> bytes | None:
        """The ids of what stands between two words; None where the words' own ids do not come out."""
        window = b" ".join((before, ragged, after))
        if window in self.joins:
            return self.joins[window]
        ids, left, right = self.whole(window), self.words[before], self.words[after]
        agreed = len(ids) >= len(left) + len(right) and ids.startswith(left) and ids.endswith(right)
        return self.keep(self.joins, window, ids[len(left) : len(ids) - len(right)] if agreed else None, len(ids))

    def encode(self, data: bytes) -> bytes:
        ends = chunk_ends(data)
        if len(ends) == 1:
            return self.words.ids(data)
        parts, ragged, start, before = [], [], 0, None
        for end in ends:
            chunk = self.chunk(data[start:end])
            start = end
            ragged.append(chunk.head)
            if not chunk.first:
                continue
            window = b"".join(ragged)
            ragged = [chunk.tail]
            if before is None:  # from the text's start on, nothing is cut on the left
                parts.append(self.words.ids(window))
            elif window:
                between = self.join(before, window, chunk.first)
                if between is None:
                    return self.whole(data)
                parts.append(between)
            parts.append(chunk.ids)
            before = chunk.last
        parts.append(self.words.ids(b"".join(ragged)))
        return b"".join(parts)


class Decoder:
    """Ids to the text that the library's decode gives where the tokenizer names no decoder: tokens joined by a space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.joined = self.whole.decoder is None
        self.tokens = [(self.whole.id_to_token(i) or "").encode() for i in range(self.whole.get_vocab_size())] if self.joined else []

    def decode(self, ids: list[int]) -> bytes:
        if self.joined:
            return b" ".join(map(self.tokens.__getitem__, ids))
        return self.whole.decode(ids, skip_special_tokens=False).encode()


def texts(column) -> list[bytes]:
    """An Arrow string column as UTF-8, null as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def encode_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = True) -> DataFrame:
    """Per row: id, ids (little-endian uint16) - or with digests: id, n_tokens, ids_sha256, decoded_sha256.

    Whole texts; null or blank text has no ids. Rows stay rows, repeated or not; other columns
    are not read. An empty table gives an empty result. ``tokenizer`` is the path of the
    vocabulary file on the executors.
    """
    id_type = df.schema[id_col].dataType
    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    source = df.select(F.col(id_col), F.col(text_col))

    def run(batches):
        import pyarrow as pa

        codec = task_codec(tokenizer)
        encoder, decoder, decimal = codec.encoder, codec.decoder, codec.decimals
        for batch in batches:
            counts, sums, backs = [], [], []
            for data in texts(batch.column(1)):
                ids = np.frombuffer(encoder.encode(data), dtype="<u2").tolist()
                counts.append(len(ids))
                sums.append(hashlib.sha256(b" ".join(map(decimal.__getitem__, ids))).hexdigest())
                backs.append(hashlib.sha256(decoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(backs, pa.string())],
                                             names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    def run_ids(batches):
        import pyarrow as pa

        encoder = task_codec(tokenizer).encoder
        for batch in batches:
            ids = [encoder.encode(data) for data in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=[id_col, "ids"])

    if digests:
        return source.mapInArrow(run, StructType([StructField(id_col, id_type), *fields]))
    from pyspark.sql.types import BinaryType

    return source.mapInArrow(run_ids, StructType([StructField(id_col, id_type), StructField("ids", BinaryType())]))


def decode_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text of ids in little-endian uint16; null ids give empty text."""

    def run(batches):
        import pyarrow as pa

        decoder = task_codec(tokenizer).decoder
        for batch in batches:
            out = [decoder.decode(np.frombuffer(b or b"", dtype="<u2").tolist()).decode() for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, StructType([StructField(id_col, df.schema[id_col].dataType), StructField("text", StringType())]))


class Codec:
    """What a worker keeps of one vocabulary; each part is made when first used."""

    def __init__(self, path: str):
        self.path = path

    @cached_property
    def encoder(self) -> ChunkEncoder:
        return ChunkEncoder(self.path)

    @cached_property
    def decoder(self) -> Decoder:
        return Decoder(self.path)

    @cached_property
    def decimals(self) -> list[bytes]:
        return [str(i).encode() for i in range(1 << 16)]


def task_codec(path: str) -> Codec:
    return kept("bpe", path, lambda: Codec(path))
