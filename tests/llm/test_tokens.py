import hashlib

import numpy as np
import pytest
from fixtures_llm import documents, odd_texts, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from geoloom.llm import bpe, chunks, tokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_every_code_point_as_the_library(library):
    c = bpe.codec(bpe.default_path())
    points = [chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    texts = ["".join(f"a{x}1{x} {x}" for x in points[i : i + 200]) for i in range(0, len(points), 200)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert c.encode(text).tolist() == want.ids


@pytest.mark.parametrize("text", ["", " ", "\n" * 30_000, " " * 5000 + "x", "x<|endoftext|>y <|endoftext|>", "don't 'll 're  we'VE", "a 　b\x85c", "\x00\x1f"])
def test_odd_texts_as_the_library(library, text):
    c = bpe.codec(bpe.default_path())
    assert c.encode(text).tolist() == ids(library, text)
    assert c.decode(c.encode(text)).decode() == library.decode(ids(library, text), skip_special_tokens=False)


@given(st.text(alphabet="ab 'lé\n.1中<|>", max_size=300), st.integers(1, 40))
@settings(max_examples=200, deadline=None)
def test_pieces_add_up(text, size):
    c = bpe.codec(bpe.default_path())
    parts = bpe.pieces(text.encode(), size)
    assert b"".join(parts) == text.encode()
    assert np.concatenate([c.encode(p.decode()) for p in parts]).tolist() == c.encode(text).tolist()


@given(st.lists(st.text(alphabet="ab 'lé\n.12<|>", min_size=1, max_size=120), min_size=1, max_size=8), st.integers(0, 255))
@settings(max_examples=300, deadline=None)
def test_joins_are_repaired(parts, shared):
    c = bpe.codec(bpe.default_path())
    raw = "".join(parts).encode()
    cuts = np.concatenate([[0], np.cumsum([len(p.encode()) for p in parts])]).tolist()
    known = {i: c.encode(p) for i, p in enumerate(parts) if shared >> i & 1}
    assert chunks.assemble(raw, cuts, known, c).tolist() == c.encode(raw.decode()).tolist()


def test_counts(spark, library):
    docs = documents(spark)
    got = tokens.token_counts(docs, limit=20, long_bytes=5000)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(k, len((t or "").encode()), n := len(ids(library, t)), n > 20) for k, t in odd_texts()]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert tokens.token_counts(documents(spark, [])).count() == 0


def test_encoding_with_reuse_round_trip(spark, library):
    passage = prose(50, 900)
    rows = odd_texts() + [(100 + i, prose(200 + i, 300) + passage + prose(300 + i, 40)) for i in range(6)]
    out = chunks.encode(documents(spark, rows))
    assert sorted((repr(r.doc_id), r.n_tokens, hashlib.sha256(r.ids).hexdigest()) for r in out.collect()) == sorted(
        (repr(k), len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest()) for k, i in ((k, ids(library, t)) for k, t in rows)
    )
    back = chunks.decode(out)
    assert sorted((repr(r.doc_id), r.decoded) for r in back.collect()) == sorted((repr(k), t or "") for k, t in rows)
    assert chunks.encode(documents(spark, [])).count() == 0


def test_chunks_follow_content():
    shared = prose(7, 3000).encode()
    found = []
    for head in (b"", prose(8, 333).encode()):
        data = np.frombuffer(head + shared, np.uint8)
        cuts = chunks.borders(data, 0, len(data), chunks.rolling_marks(data))
        assert cuts[0] == 0 and cuts[-1] == len(data) and all(b > a for a, b in zip(cuts, cuts[1:]))
        found.append({chunks.digest(data[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])})
    assert len(found[0] & found[1]) >= len(found[0]) - 3
