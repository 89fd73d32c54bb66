"""Packing along a space-filling curve.

A document's ids are hashed into a count vector, the vector is projected to three dimensions and
its place on the Hilbert curve through them is the document's key. Documents are range-sorted
by key (ties by id and content, so a run of copies can be split) and each range is one stream, cut
every ``size`` tokens: neighbours on the curve share sequences and no sequence but a range's
last has room left. That last one is cut into sequences whose lengths are powers of two, which
take no padding.

Ids are computed once and written; the range sort reads them back.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .bpe import task_codec, texts
from .common import saved

BUCKETS, DIMS, BITS = 256, 3, 16
_RNG = np.random.default_rng(5)
_BUCKET = _RNG.integers(0, BUCKETS, 1 << 16)
_PROJECTION = _RNG.standard_normal((BUCKETS, DIMS))


def project(ids: np.ndarray) -> np.ndarray:
    """The document's hashed, normalised count vector in DIMS dimensions; zeros without ids."""
    counts = np.bincount(_BUCKET[ids], minlength=BUCKETS).astype(float)
    length = np.sqrt(counts @ counts)
    return counts @ _PROJECTION / length if length else np.zeros(DIMS)


def hilbert(points: np.ndarray) -> np.ndarray:
    """Place on the Hilbert curve of integer points (n, DIMS) with BITS bits a coordinate."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    # From the highest bit down: undo the reflections and swaps of each level's sub-cube.
    for b in range(BITS - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ t)
            x[i] ^= t
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(BITS - 1, 0, -1):
        t ^= np.where((x[-1] >> b) & 1, (1 << b) - 1, 0)
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(BITS - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(vectors: np.ndarray) -> np.ndarray:
    """Keys of projected vectors; coordinates beyond [-4, 4] lie on the border."""
    cells = np.clip((vectors + 4.0) / 8.0 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert(cells.astype(np.int64))


def encoded(df: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """id, curve key, ids with end_id."""
    schema = StructType([StructField("id", df.schema[id_col].dataType), StructField("curve", LongType()), StructField("ids", BinaryType())])
    last = np.array([end_id], dtype="<u2").tobytes()

    def run(batches):
        import pyarrow as pa

        words = task_codec(tokenizer).encoder.words
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [words.ids(data) for data in texts(batch.column(1))]
            keys = curve_keys(np.array([project(np.frombuffer(i, dtype="<u2")) for i in ids]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), pa.array([i + last for i in ids], pa.binary())], names=["id", "curve", "ids"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


class Stream:
    """Cuts documents into sequences. Yields (document, start, length, sequence, offset)."""

    def __init__(self, size: int, first: int):
        self.size, self.sequence, self.room, self.open = size, first, size, []

    def add(self, doc, length: int):
        start = 0
        while start < length:
            take = min(self.room, length - start)
            self.open.append((doc, start, take, self.sequence, self.size - self.room))
            start += take
            self.room -= take
            if not self.room:
                yield from self.open
                self.open, self.sequence, self.room = [], self.sequence + 1, self.size

    def close(self):
        """The last sequence again, as sequences of powers of two."""
        left, offset, room = sum(p[2] for p in self.open), 0, 0
        for doc, start, length, *_ in self.open:
            while length:
                if not room:
                    room, offset = 1 << (left.bit_length() - 1), 0
                    left -= room
                take = min(room, length)
                yield doc, start, take, self.sequence, offset
                start, length, offset, room = start + take, length - take, offset + take, room - take
                if not room:
                    self.sequence += 1
        self.open, self.room = [], self.size


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null or empty text is the end id alone. Every row is a document, so repeated rows are packed
    each for itself (with equal ids; their pieces differ in sequence and offset). Other columns
    are not read. An empty table gives an empty result. sequence_id is unique in the result and
    grows along the curve.
    """
    table = saved(encoded(df, tokenizer, id_col, text_col, end_id), "ids")
    ranged = table.repartitionByRange("curve", "id").sortWithinPartitions("curve", "id", "ids")
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = StructType([StructField(id_col, df.schema[id_col].dataType), *(StructField(n, LongType()) for n in names)])

    def run(batches):
        import pyarrow as pa

        stream = Stream(size, TaskContext.get().partitionId() << 32)
        waiting: dict[int, tuple] = {}  # documents with pieces in the open sequence
        serial = 0

        def rows(pieces):
            out = [[] for _ in range(7)]
            for doc, start, length, sequence, offset in pieces:
                id_, ids = waiting[doc]
                crc = zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
                for column, v in zip(out, (id_, start, length, crc, len(ids), sequence, offset), strict=True):
                    column.append(v)
            arrays = [pa.array(out[0], pa_type), *(pa.array(c, pa.int64()) for c in out[1:])]
            return pa.RecordBatch.from_arrays(arrays, names=[id_col, *names])

        pa_type = None
        for batch in batches:
            pa_type = batch.schema.field("id").type
            pieces = []
            for id_, ids in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                waiting[serial] = (id_, np.frombuffer(ids, dtype="<u2"))
                pieces += stream.add(serial, len(ids) // 2)
                serial += 1
            yield rows(pieces)
            still = {p[0] for p in stream.open}
            waiting = {k: v for k, v in waiting.items() if k in still}
        if pa_type is not None:
            yield rows(stream.close())

    return ranged.mapInArrow(run, schema)
