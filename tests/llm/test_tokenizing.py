import itertools
import random

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tradewind.llm.tokenizing import Encoder, default_vocabulary, encoder


def by_worker(texts, encoder=None):
    """Ids of the texts, one call each, all by one encoder."""
    encoder = encoder or Encoder(default_vocabulary())
    return [ids.tolist() for t in texts for _, ids, _ in encoder.encode(pa.array([t]))]


def by_library(texts):
    plain = Tokenizer.from_file(default_vocabulary())
    return [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_with_line_breaks_in_any_order():
    texts = ["Hello world\nfoo bar baz\n", "bar world foo baz"]
    expected = by_library(texts)
    for order in itertools.permutations(["world\nfoo", "bar", "baz\n"]):
        encoder = Encoder(default_vocabulary())
        encoder._learn = lambda pieces, learn=encoder._learn, order=order: learn(sorted(pieces, key=lambda p: order.index(p) if p in order else -1))
        assert by_worker(texts, encoder) == expected


def test_random_white_space_by_one_worker():
    rng = random.Random(5)
    gaps = [" "] * 8 + ["\n"] * 3 + ["\n\n", "  ", "\t", " \n", "\n ", "\r\n", "\xa0", "\u3000", "\x1c", "\x85"]
    pool = ["bar", "world", "foo", "baz.", "it's", "3.5", "é!", "中文", "a|b", "ab12", "'s", "x²;", "_a", "—", "end?!"]
    texts = []
    for _ in range(1_500):
        text = "".join(rng.choice(pool) + rng.choice(gaps) for _ in range(rng.randrange(1, 9)))
        texts.append(rng.choice(["", "", "\n", " "]) + (text if rng.random() < 0.6 else text.strip()))
    assert by_worker(texts) == by_library(texts)
    ids, sizes = [], []
    for _, some, n in Encoder(default_vocabulary()).encode(pa.array(texts)):
        ids.append(some), sizes.append(n)
    parts = np.split(np.concatenate(ids), np.cumsum(np.concatenate(sizes))[:-1])
    assert [p.tolist() for p in parts] == by_library(texts)


def test_literals_of_added_tokens():
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>b c\n<|endoftext|>\nd", "x\t<|endoftext|>  <|endoftext|", "<| endoftext|> <|endoftext|>.", "x y"]
    assert by_worker(texts) == by_library(texts)
    assert by_worker(texts[:1]) == [[87, 220, 50256, 331]]


def test_bounds_change_what_is_held_not_the_ids():
    texts = [f"word{i} of {i * 7919} texts {'x' * (i % 40)}\n{i}" for i in range(300)]
    held, ids, sizes = [], [], []
    worker = encoder(default_vocabulary(), words=50, chars=400)
    for _, some, n in worker.encode(pa.array(texts)):
        held.append(len(worker.known)), ids.append(some), sizes.append(n)
    assert len(held) > 20  # blocks of 400 characters
    assert max(held) < 200  # 50 and what a block adds; all texts have over 900
    parts = np.split(np.concatenate(ids), np.cumsum(np.concatenate(sizes))[:-1])
    assert [p.tolist() for p in parts] == by_library(texts)
    wide = encoder(default_vocabulary())  # the same worker, for an operator that asks for no bounds
    assert wide is worker and len([at for at, _, _ in wide.encode(pa.array(texts))]) == 1
