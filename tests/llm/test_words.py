import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from sparkloom.llm import _exchange as X
from sparkloom.llm import _text

TEXT = st.text(alphabet=st.sampled_from(list("aBz09 \t\n\r\x0b\x0c\x1c\xa0é日😀-_\x00\x7f")), max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words(texts):
    for table, pattern, f in ((_text.AS_IS, brute.SPACED, lambda t: t or ""), (_text.LOWER, brute.SPACED, brute.lower), (_text.LOWER_ALNUM, brute.ALNUM, brute.lower)):
        flat, offsets = _text.words(pa.array(["skipped", *texts], pa.string()).slice(1), table)
        got = flat.to_pylist()
        assert [got[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [pattern.findall(f(t)) for t in texts]


def test_runs_tell_words_and_lengths_apart():
    flat, offsets = _text.words(pa.array(["a b c a b c a b", "a b", "b a"]), None)
    r = _text.Rolling(_text.word_hashes(flat))
    assert r.runs(np.array([0]), 3) == r.runs(np.array([3]), 3)
    assert len({int(r.runs(np.array([s]), n)[0]) for s, n in ((0, 1), (0, 2), (1, 2), (0, 3), (10, 2))}) == 5
    assert r.runs(np.array([8]), 2) == r.runs(np.array([0]), 2)
    starts, rows = _text.window_starts(offsets, 3)
    assert starts.tolist() == [0, 1, 2, 3, 4, 5] and set(rows.tolist()) == {0}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40), st.integers(1, 9))
def test_blocks_round_trip(xs, blocks):
    x = np.sort(np.array(xs, np.uint64))
    assert (X.unpack_sorted(X.pack_sorted(x)) == x).all() and (X.unplanes(X.planes(x)) == x).all()
    bounds = X.cut(x, blocks)
    assert len(bounds) == blocks + 1 and bounds[-1] == len(x)
    for i in range(blocks):
        assert all(int(v) * blocks >> 64 == i for v in x[bounds[i] : bounds[i + 1]])


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (3, 50, 0, 2, 2, 100)] + [None]})
    parts = list(_text.text_slices([batch], "text", 10))
    assert sum(p.num_rows for p in parts) == 7 and max(p.num_rows for p in parts) > 1


def test_pattern_of_words_is_what_it_says():
    assert re.findall(r"[^\x20\x09-\x0D]+", "a\x1cb\x85c d") == ["a\x1cb\x85c", "d"]
