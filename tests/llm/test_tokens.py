"""BPE encoding and decoding, packing."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from veilspark.llm import bpe, packing
from veilspark.llm.vocab import library_tokenizer

pytest.importorskip("public_tokenizers")


def texts():
    rng = random.Random(1)
    pool = [chr(c) for c in range(0x190)] + list("'s't're ve m ll d  \n\t aAbB09") * 6 + ["ſ", "İ", "Σ", "🙂", "́", "<|endoftext|>", "<|startoftext|>", " "]
    made = ["".join(rng.choice(pool if i % 2 else pool[:300]) for _ in range(rng.randint(0, 60))) for i in range(800)]
    return [*made, "", None, "it's", " " * 3000, "a" * 25_000, "Plain words, twice. Plain words!"]


def test_words_as_the_library(frame):
    docs = list(enumerate(texts()))
    t = library_tokenizer("word_bpe_49k.json")
    got = {r.doc_id: r for r in bpe.bpe_encode(frame(docs)).collect()}
    sums = {r.doc_id: r for r in bpe.bpe_digests(frame(docs)).collect()}
    for k, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        assert np.frombuffer(got[k].ids, "<u4").tolist() == ids and got[k].decoded == decoded and got[k].n_tokens == len(ids)
        assert sums[k].ids_sha256 == sha256(np.array(ids, "<u4").tobytes()).hexdigest() and sums[k].decoded_sha256 == sha256(decoded.encode()).hexdigest()


def test_bytes_as_the_library():
    t = library_tokenizer("byte_bpe_50k.json")
    for text in texts():
        assert packing.encode(text or "", "byte_bpe_50k.json") == t.encode(text or "", add_special_tokens=False).ids


def test_odd_rows(frame, odd):
    t = library_tokenizer("word_bpe_49k.json")
    want = []
    for k, text in odd:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((k, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.bpe_digests(frame(odd)).collect()), key=repr) == sorted(want, key=repr)
    assert bpe.bpe_digests(frame(odd).filter("false")).count() == 0
    assert packing.pack_documents(frame(odd).filter("false")).count() == 0


def check_packing(rows, docs, size):
    t = library_tokenizer("byte_bpe_50k.json")
    at, seq = {}, {}
    for r in rows:
        at.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
    for members in seq.values():
        end = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == end and r.length > 0
            end += r.length
        assert end <= size
    for k, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        end = 0
        for r in sorted(at[k], key=lambda r: r.start):
            assert r.start == end and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[end : end + r.length], "<u4").tobytes())
            end += r.length
        assert end == len(ids)
    return sum(r.length for r in rows) / (size * len(seq))


def test_packing_covers_every_id_once(frame):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "x"]) for _ in range(rng.choice([0, 1, 5, 40, 300, 900])))) for i in range(400)] + [(1000 + i, "same length here") for i in range(200)] + [(5000, None)]
    rows = packing.pack_documents(frame(docs), size=256).collect()
    assert check_packing(rows, docs, 256) > 0.9


def test_rows_of_one_key_and_length_are_dealt(frame):
    docs = [(None, "same length here")] * 400 + [(1, "same length here")] * 200
    pieces = packing.document_pieces(frame(docs), "byte_bpe_50k.json", "doc_id", "text", 256).collect()
    assert max(np.bincount([r.place % 16 for r in pieces])) < 80
    rows = packing.pack_documents(frame(docs), size=256).collect()
    assert len(rows) == 600 == len({(r.sequence_id, r.offset) for r in rows}) and all(r.offset + r.length <= 256 for r in rows)


def test_repeated_rows_are_all_packed(frame, odd):
    rows = packing.pack_documents(frame(odd)).collect()
    assert sum(r.start == 0 for r in rows) == len(odd)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_shortest_pack_first():
    patterns = packing.shortest_pack_first({7: 2, 3: 4, 1: 1}, 10)
    assert sum(c * len(p) for c, p in patterns) == 7 and all(sum(p) <= 10 for _, p in patterns)
    spread = packing.slots(patterns)
    for length, n in ((7, 2), (3, 4), (1, 1)):
        assert sorted(r for s in spread if s[0] == length for r in range(s[1], s[2])) == list(range(n))
