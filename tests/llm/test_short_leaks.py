"""Leaks of short items in a benchmark of mostly long ones, each length by itself."""

import random

import numpy as np
import pytest

from strandql.llm import decontaminate as d
from tests.llm.test_decontaminate import edited, vocabulary

SHORT = (5, 9, 12, 15, 16, 20)


def mixed_block():
    rng, vocab = random.Random(4), vocabulary(6000)
    items = [[rng.choice(vocab) for _ in range(n)] for n in (38,) * 300 + SHORT * 4]
    hashes = [h for t in items for _, h, _ in d.normal_words([" ".join(t)])]
    return items, d.ItemBlock(list(range(len(items))), hashes, 0.2), rng, vocab


def test_every_length_reaches_the_recall():
    items, block, rng, vocab = mixed_block()
    block.build(0.99)
    for n in SHORT:
        own = [i for i, t in enumerate(items) if len(t) == n]
        tried = [own[k % len(own)] for k in range(300)]
        around = lambda: [rng.choice(vocab) for _ in range(rng.randint(20, 40))]
        texts = [" ".join([*around(), *edited(items[i], n // 5, rng, vocab), *around()]) for i in tried]
        found = {(t, i) for t, i, _ in d.leaks(block, texts)}
        assert np.mean([(t, i) in found for t, i in enumerate(tried)]) >= 0.97, n


def test_a_recall_out_of_reach_is_an_error(monkeypatch):
    monkeypatch.setattr(d, "MAX_WALKS", 1)
    with pytest.raises(RuntimeError, match="recall"):
        mixed_block()[1].build(1.0)
