import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from echofold.llm import bpe

PATH = bpe.tokenizer_path()
PARTS = st.sampled_from([" the", "don't", "\n", "  ", " ", " ", "　x", "’s", ",", ".", "<|endoftext|>", "<|", "12", "é", "ß,", "日本", "\t", "!!", "'s", " '", "\x01", " ", "a" * 9, "\U0001f600", " Ab"])


def encoded(texts):
    enc = bpe.encoder(PATH)
    out = []
    for _, _, ids, counts in bpe.encode_rows(pa.array(texts, pa.string()), PATH):
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    return out, enc


def expected(texts):
    return [e.ids for e in bpe.encoder(PATH).tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=14).map("".join), max_size=6))
def test_equals_library(texts):
    assert encoded(texts)[0] == expected(texts) if texts else True


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=4))
def test_equals_library_on_any_text(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert encoded(texts)[0] == expected(texts)


def test_null_empty_and_long():
    long = "word and more, " * 30_000 + "日本語" * 5000
    texts = [None, "", long, long + "<|endoftext|>", "x" * 3000]
    assert encoded(texts)[0] == expected(texts)


@settings(max_examples=30, deadline=None)
@given(st.lists(PARTS, min_size=1, max_size=30).map("".join), st.integers(0, 9))
def test_repaired_joins(unit, k):
    text = (unit + " alpha beta gamma delta" * (k + 1)) * 60
    assert bpe.encoder(PATH).repaired(text, window=16, size=64) == expected([text])[0]


def test_shared_chunks_are_encoded_once():
    enc = bpe.encoder(PATH)
    passage = " ".join(f"unseen{i} passage{i * 7}" for i in range(400))
    encoded([passage])
    before = enc.made
    encoded(["Another beginning here. " + passage])
    assert enc.made - before < 6


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (3, "a b"), (3, "a b")]])
def test_digests(spark, rows):
    got = bpe.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = []
    for i, t in rows:
        ids = expected([t])[0]
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got)) == sorted(want)


def thue_morse(n, first="a", second="b"):
    return "".join(second if i.bit_count() & 1 else first for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_thue_morse_words(n):
    a, b = thue_morse(n), thue_morse(n, "b", "a")
    texts = [a, b, f"{a} {b}", f"{b} {a}", f"one {a}, two {b}."]
    assert encoded(texts)[0] == expected(texts)


def test_forced_collisions(monkeypatch):
    """All slices of one length have one hash: what is found is then wrong as a rule, and never taken."""
    enc = bpe.Encoder(PATH)
    monkeypatch.setattr(bpe.Slices, "hashes", lambda self, start, end: bpe.mixed((end - start).astype(np.uint64)))
    texts = ["ab cd ef", "cd ab ef gh", "ef, cd ab", "", "gh ab cd ef " * 40, "hg ba dc fe " * 40]
    for _ in range(2):
        got = []
        for _, _, data, offsets in bpe.blocks(pa.array(texts)):
            ids, counts = enc.encode_block(data, offsets)
            got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == expected(texts)


def test_joins_that_disagree_are_repaired(monkeypatch):
    """Cuts inside of words make joins wrong; such rows are encoded again."""
    enc = bpe.Encoder(PATH)

    def anywhere(data, offsets):
        return np.unique(np.concatenate([np.arange(0, len(data), 3), offsets[:-1][np.diff(offsets) > 0]]))

    monkeypatch.setattr(enc, "piece_starts", anywhere)
    monkeypatch.setattr(bpe, "MASK", 1)
    texts = ["understanding everything about tokenizers " * 5, "short", "a b c d e f g h"]
    for _, _, data, offsets in bpe.blocks(pa.array(texts)):
        joined = enc.joins_agree(data, bpe.Slices(data), (s := anywhere(data, offsets)), np.append(s[1:], len(data)), np.arange(1, len(s)))
        assert not joined.all()


def test_shared_passages_are_reused():
    enc = bpe.Encoder(PATH)
    passage = " ".join(f"unseen{i} passage{i * 7}" for i in range(2000))
    texts = pa.array([f"{i} {passage} {i}" for i in range(10)])
    for _, _, data, offsets in bpe.blocks(texts):
        enc.encode_block(data, offsets)
    assert enc.made < 0.2 * enc.seen
