from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillbar.llm import tokenizer as tk


@pytest.fixture(scope="module")
def both():
    t = Tokenizer.from_file(tk.VOCABULARY)
    t.encode_special_tokens = True
    return tk.encoder(), t


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="ab eéßTHtheing' \n\t.,;0129=-", max_size=120)))
def test_equals_the_public_tokenizer(text):
    t = Tokenizer.from_file(tk.VOCABULARY) if not hasattr(test_equals_the_public_tokenizer, "t") else test_equals_the_public_tokenizer.t
    t.encode_special_tokens = True
    test_equals_the_public_tokenizer.t = t
    e = tk.encoder()
    ids = e.encode(text)
    assert ids == t.encode(text, add_special_tokens=False).ids
    assert e.decode(ids) == text


def test_runs_of_one_letter_and_long_pieces(both):
    e, t = both
    for x in ["a" * n for n in range(1, 80)] + [" " * 99, "=" * 500, "x7" * 5000, "<|endoftext|> a", "ab" * 40_000]:
        assert e.encode(x) == t.encode(x, add_special_tokens=False).ids


def test_small_automaton_by_hand():
    tok = {b"a": 0, b"b": 1, b"aa": 2, b"ab": 3, b"aab": 4}
    a = tk.Automaton(tok, [(0, 0, 2), (2, 1, 4), (0, 1, 3)])
    assert a.run(b"aaab") == [2, 3]  # aa is merged first, from the left; aa+b is not next to each other
    assert a.run(b"aab") == [4] and a.run(b"ab") == [3] and a.run(b"aaa") == [2, 0]


def test_corpus(spark):
    df = spark.createDataFrame([(1, "Hello world", 9), (2, "", 9), (3, None, 9), (4, "Hello world", 9), (None, " x", 9)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: r.ids for r in tk.encode_corpus(df).collect()}
    assert got[2] == [] and got[3] == [] and got[1] == got[4] == tk.encoder().encode("Hello world") and len(got[None]) == 1
    assert tk.encode_corpus(df.where("false")).count() == 0
    assert {r.doc_id: r.n_tokens for r in tk.count_tokens(df, ["doc_id"]).collect()}[1] == len(got[1])


def test_table_is_deterministic_and_may_be_dropped(both, monkeypatch):
    """A known prefix takes one look-up per byte, and a small table gives the same ids."""
    e, t = both
    a = e.automaton
    words = [" parliament", " parliamentary", " tribunal", "=" * 40, " Änderungsantrag", "x7" * 50]
    first = [a.run(w.encode()) for w in words]
    compiled = len(a.table)
    assert [a.run(w.encode()) for w in words] == first and len(a.table) == compiled
    monkeypatch.setattr(tk, "ROWS", 10)
    assert [a.run(w.encode()) for w in words] == first == [t.encode(w, add_special_tokens=False).ids for w in words]
