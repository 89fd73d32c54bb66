import hashlib
import random
import zlib

import numpy as np
import pytest

from fixtures import docs, edge, edge_rows, empty, rows, tokenizer_path
from millrace.llm import bpe, packing


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


EDGES = ["", " ", "don't I'LL we'Re", "<|endoftext|>", "a<|startoftext|>b <|endoftext|>c", "x́ ́y", "\x1c a\x85b\xa0c", "İstanbul ﬁ Å",
         "日本語", "\U0001f44d\U0001f3fd" * 30, "a" * 5000, " " * 3000, "x　y", "\xe9" * 700 + " b", "''s 's's", "\xbd \xb2 ٣", "\x00\x01 \x7f", "\xaa\xba \xb5 \xdf ẞ", "Σσς ΟΣ"]


def test_equals_the_library(library):
    encoder, decoder = bpe.ChunkEncoder(tokenizer_path()), bpe.Decoder(tokenizer_path())
    rng = random.Random(1)
    alphabet = "abcde\xc0\xe9\xf1\xdf'<|>sltrem \n\t\x0b\x1c\xa0́Σσ12_.-日\U0001f44d"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.choice([5, 50, 3000]))) for _ in range(150)]
    for text in [*EDGES, *made, *(r[0] for r in rows("SELECT text FROM documents"))]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text.encode()), "<u2").tolist() == ids
        assert decoder.decode(ids).decode() == library.decode(ids, skip_special_tokens=False)


def test_chunks_of_a_shared_passage_are_shared():
    encoder = bpe.ChunkEncoder(tokenizer_path())
    rng = random.Random(2)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000))
    encoder.encode(("one two three " + passage).encode())
    before = len(encoder.memo)
    encoder.encode(("quite another start, longer than that one " + passage).encode())
    assert before > 10 and len(encoder.memo) - before <= 2


def test_joins_are_repaired_until_they_agree(library, monkeypatch):
    """A join whose words come out otherwise is widened; so are chunks without a whole word, in linear time."""
    monkeypatch.setattr(bpe, "MEAN_CHUNK", 40)
    monkeypatch.setattr(bpe, "MIN_CHUNK", 8)
    texts = [r[0] for r in rows("SELECT text FROM documents")[:40]] + ["x" * 300_000, ("ab" * 40 + " ") * 500]
    encoder = bpe.ChunkEncoder(tokenizer_path())
    for text in texts:
        assert np.frombuffer(encoder.encode(text.encode()), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
    assert sum(v is not None for v in encoder.joins.values()) > 100
    broken = bpe.ChunkEncoder(tokenizer_path())
    monkeypatch.setattr(broken, "join", lambda *a: None)
    assert all(np.frombuffer(broken.encode(t.encode()), "<u2").tolist() == library.encode(t, add_special_tokens=False).ids for t in texts[:10])
    wrong = bpe.ChunkEncoder(tokenizer_path())
    wrong.words[b"left"] = b"\x00\x00"
    assert wrong.join(b"left", b"middle", b"right") is None


def test_memos_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "WORD_MEMO_BYTES", 10_000)
    monkeypatch.setattr(bpe, "CHUNK_MEMO_BYTES", 5000)
    encoder, plain = bpe.ChunkEncoder(tokenizer_path()), bpe.ChunkEncoder(tokenizer_path())
    for (text,) in rows("SELECT text FROM documents")[:20]:
        assert encoder.encode(text.encode()) == plain.words.ids(text.encode())
        assert len(encoder.words) + len(encoder.words.piece_memo) <= 10_000 / bpe.ENTRY and encoder.words.held <= 10_000 and encoder.held <= 5000 + 2 * len(text.encode()) + 200


def test_query_digests(spark, library):
    got = {r["doc_id"]: r for r in bpe.encode_documents(docs(spark), tokenizer_path()).collect()}
    for id_, text in rows("SELECT doc_id, text FROM documents")[::10]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[id_]["n_tokens"] == len(ids)
        assert got[id_]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[id_]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edges(spark, library):
    got = bpe.encode_documents(edge(spark), tokenizer_path())
    assert sorted(r["n_tokens"] for r in got.collect()) == sorted(len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in edge_rows())
    assert bpe.encode_documents(empty(spark), tokenizer_path()).count() == 0
    ids = bpe.encode_documents(edge(spark), tokenizer_path(), digests=False)
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(ids, tokenizer_path()).collect()}
    assert back[9] == library.decode(library.encode("<|endoftext|>", add_special_tokens=False).ids, skip_special_tokens=False) and back[2] == ""


def test_hilbert_neighbours_touch(monkeypatch):
    monkeypatch.setattr(packing, "BITS", 3)
    points = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert(points)
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def check_packing(pieces, documents, library, size=2048):
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for id_, text in documents:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[id_], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at], dtype="<u4").tobytes())
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size and at & (at - 1) == 0  # nothing needs padding


def test_packing(spark, library):
    pieces = packing.pack(docs(spark), tokenizer_path()).collect()
    check_packing(pieces, rows("SELECT doc_id, text FROM documents"), library)


def test_packing_edges(spark, library):
    df = edge(spark).dropDuplicates(["doc_id"])
    check_packing(packing.pack(df, tokenizer_path()).collect(), [(r["doc_id"], r["text"]) for r in df.collect()], library)
    assert packing.pack(edge(spark), tokenizer_path()).groupBy().sum("length").first()[0] == sum(len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in edge_rows())
    assert packing.pack(empty(spark), tokenizer_path()).count() == 0
