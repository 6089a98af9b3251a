import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docspark.llm import bytebpe, piece, records, token_counts
from docspark.llm.common import new_path

BPE, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
library = Tokenizer.from_file(BPE)
processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
ALPHABET = st.text(alphabet="ab cdeéñ中\n\t.,'12▁😀<s>| ", max_size=60) | st.text(max_size=40)


@settings(max_examples=300, deadline=None)
@given(ALPHABET)
def test_encodings_are_the_libraries(text):
    assert np.frombuffer(bytebpe.encoder(BPE).encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
    if "\x00" not in text:
        e = piece.encoder(MODEL)
        ids = e.encode(text)
        assert ids == processor.encode(text) and e.decode([*ids, e.end]) == processor.decode([*ids, e.end])


def test_special_strings_may_be_plain():
    assert 50256 in np.frombuffer(bytebpe.encoder(BPE).encode("a <|endoftext|> b"), "<u2")
    assert 50256 not in np.frombuffer(bytebpe.encoder(BPE, True).encode("a <|endoftext|> b"), "<u2")


def test_piece_digests(odd_docs, no_docs):
    rows = [tuple(r) for r in piece.digests(odd_docs, MODEL).collect()]
    want = []
    for r in odd_docs.collect():
        ids = [*processor.encode(r.text or ""), 2]
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(processor.decode(ids).encode()).hexdigest()))
    assert sorted(rows, key=repr) == sorted(want, key=repr) and piece.digests(no_docs, MODEL).count() == 0
    assert sorted(map(len, (r.ids for r in piece.encoded(odd_docs, MODEL).collect()))) == sorted(w[1] for w in want)


def expected(docs):
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out, at = [], 0
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_records_round_trip(spark, odd_docs, no_docs):
    got = sorted((tuple(r) for r in records.round_trip(odd_docs, BPE).collect()), key=lambda r: r[1])
    assert got == expected(odd_docs)
    assert records.round_trip(no_docs, BPE).count() == 0


def test_record_index_and_damage(spark, odd_docs, tmp_path):
    uri = f"file://{tmp_path}/r"
    shards = records.write(odd_docs, uri, BPE)
    shard, n, _ = max(shards, key=lambda s: s[1])
    in_turn = [(i, ids.tolist()) for i, ids in records.payloads(uri, shard)]
    assert len(in_turn) == n
    for k in reversed(range(n)):
        i, ids = records.read_at(uri, shard, k)
        assert (i, ids.tolist()) == in_turn[k]
    file = tmp_path / "r" / f"part-{shard:06d}.rec"
    data = bytearray(file.read_bytes())
    data[-6] ^= 1
    file.write_bytes(data)
    with pytest.raises(records.BadRecord):
        list(records.payloads(uri, shard))
    file.write_bytes(data[:-3])
    with pytest.raises(records.BadRecord):
        list(records.payloads(uri, shard))


@pytest.mark.parametrize("block", [1, 7, 64, token_counts.BLOCK])
def test_token_counts(odd_docs, no_docs, block):
    plain = Tokenizer.from_file(BPE)
    plain.encode_special_tokens = True
    want = sorted(((r.doc_id, len(plain.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_docs.where("length(coalesce(text, '')) < 5000").collect()), key=repr)
    docs = odd_docs.where("length(coalesce(text, '')) < 5000")
    assert sorted((tuple(r) for r in token_counts.counts(docs, BPE, block).collect()), key=repr) == want
    if block == 64:
        assert token_counts.counts(no_docs, BPE, block).count() == 0


def test_scan_of_plain_files(spark, tmp_path):
    """A last document without a separator, empty documents, and a file without any separator."""
    for shard, ids in enumerate(([1, 2, 9, 9, 3, 9, 4, 5], [1, 2, 3], [9])):
        (tmp_path / f"tokens-{shard:06d}.bin").write_bytes(np.array(ids, "<u2").tobytes())
    files = spark.createDataFrame([(0, 8), (1, 3), (2, 1)], "shard int, ids long")
    for block in (1, 2, 3, 100):
        got = sorted(tuple(r) for r in token_counts.scan(spark, f"file://{tmp_path}", files, 9, 2, block).collect())
        assert got == [(0, 0, 2), (0, 1, 0), (0, 2, 1), (0, 3, 2), (1, 0, 3), (2, 0, 0)]


def test_fresh_paths_differ(spark):
    assert new_path(spark, "x") != new_path(spark, "x")
