"""Ids by units against the library's ids of whole texts."""

import numpy as np

from hazeline.llm.units import TOKENIZER, UnitEncoder, tokenizer


def test_new_units_reach_the_library_joined_and_give_its_ids(monkeypatch):
    rng = np.random.default_rng(4)
    ends = ["", "'s", "'LL", "...", "1999", "é", "　", " x", "中", "_", "-a", "\x1c", "!?", "\x85"]
    gaps = [" ", "  ", "\n", "\t\t ", " \r\n", "\x0b"]
    some = lambda: "".join(rng.choice(list("abcdeABC019é中'.-"), rng.integers(1, 9))) + rng.choice(ends)
    xs = ["".join(some() + rng.choice(gaps) for _ in range(400)) for _ in range(30)] + ["", " ", "x", " x ", "<|endoftext|> y"]
    encoder = UnitEncoder(TOKENIZER)
    given = []
    library = encoder.library
    monkeypatch.setattr(encoder, "library", lambda few: given.append(len(few)) or library(few))
    ids, n = encoder.encode(xs)
    want = [e.ids for e in tokenizer(TOKENIZER).encode_batch_fast(xs, add_special_tokens=False)]
    assert n.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]
    assert encoder.join and sum(given) < len(encoder.known) * 0.7  # a text a unit before
