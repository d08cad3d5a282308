"""Properties over generated inputs."""

from collections import Counter

import numpy as np
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from keyloom.llm import bpe, packing, subjects

VOCABULARY = bpe.load_vocabulary()
REFERENCE = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=VOCABULARY.rank, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_encoding_equals_merging(text):
    ids = VOCABULARY.encode(text)
    assert ids == REFERENCE.encode_ordinary(text) and VOCABULARY.decode(ids) == text


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40))
def test_pieces_of_any_bytes(piece):
    got = VOCABULARY.encode_piece(piece) if piece else ()
    assert b"".join(VOCABULARY.tokens[i] for i in got) == piece
    if piece:
        assert list(got) == list(REFERENCE._encode_single_piece(piece))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80), st.integers(30, 60))
def test_plan_places_every_item_once(sizes, capacity):
    steps, used = packing.plan(Counter(sizes), capacity)
    spans = {}
    ranks = set()
    for size, rank, n, container, start in steps.tolist():
        for i in range(n):
            assert (size, rank + i) not in ranks and start + size <= capacity and container + i < used
            ranks.add((size, rank + i))
            spans.setdefault(container + i, []).append((start, size))
    assert Counter(s for s, _ in ranks) == Counter(sizes)
    for parts in spans.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
    assert len(spans) <= 2 * -(-sum(sizes) // capacity) + 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.floats(0, 50), min_size=4, max_size=4), min_size=3, max_size=20))
def test_weights_of_unseen_features_are_zero(counts):
    table = np.zeros((len(counts) + 2, 4))
    table[: len(counts)] = counts
    w = subjects.weights(table)
    assert np.isfinite(w).all() and np.abs(w[-2:]).max() < 1e-6
