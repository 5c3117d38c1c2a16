import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from atticwork.llm import common

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="abAB éß|\t\n\r\x0b0", max_size=40)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(TEXT)
def test_words_and_equality(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    seen, rows = {}, 0
    for at, to, offsets, hashes in common.word_blocks(batch, "text"):
        for i in range(at, to):
            words = [w.translate(str.maketrans(common.UPPER, common.LOWER)) for w in WORD.findall(texts[i] or "")]
            own = hashes[offsets[i - at] : offsets[i - at + 1]].tolist()
            assert len(own) == len(words)
            for w, h in zip(words, own, strict=True):
                assert seen.setdefault(w, h) == h
            rows += 1
    assert rows == len(texts)
    assert len(set(seen.values())) == len(seen)


def test_long_text_is_read_whole(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000)) + " " + "x" * 3000
    batch = pa.RecordBatch.from_arrays([pa.array([text, None, "w1"])], names=["text"])
    whole = np.concatenate([h for *_, h in common.word_blocks(batch, "text")])
    monkeypatch.setattr(common, "BLOCK", 256)
    parts = np.concatenate([h for *_, h in common.word_blocks(batch, "text")])
    assert (whole == parts).all() and len(whole) == 5002


@settings(max_examples=60, deadline=None)
@given(TEXT, st.integers(1, 5))
def test_shingles(texts, size):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    for at, to, offsets, hashes in common.word_blocks(batch, "text"):
        owner, _ = common.shingles(offsets, hashes, size)
        for i in range(at, to):
            words = [w.translate(str.maketrans(common.UPPER, common.LOWER)) for w in WORD.findall(texts[i] or "")]
            sets = {tuple(words[j : j + size]) for j in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
            assert (owner == i - at).sum() == len(sets)
