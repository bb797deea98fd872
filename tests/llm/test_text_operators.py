"""Pseudonyms, BPE and piece counts against definitions and the public libraries."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from rowwright.llm import bpe, pseudonyms, wordpiece

PATH = P.path("byte_bpe_50k.tiktoken")
DATA = open(PATH, "rb").read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, DATA.splitlines())}
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS = bpe.codec(DATA, P.PATTERN)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoding_is_that_of_the_library_and_decodes(text):
    ids = OURS.encode(text)
    assert ids == THEIRS.encode_ordinary(text)
    assert OURS.decode(ids) == text


@pytest.mark.parametrize("text", ["", " " * 300, "a" * 5000, "-=" * 900, "<|endoftext|> it's", "日本語 é \U0001f600\r\n\t x", "0123456789" * 80])
def test_runs_and_odd_texts(text):
    assert OURS.encode(text) == THEIRS.encode_ordinary(text) and OURS.decode(OURS.encode(text)) == text


MIXED = ["a \u00a0 \u00a0 b", "x\n \ny", "a \t b", "\t a\u00a0 b \n", " \n", "a  b c \u2003d", "q" * 90 + " " + "r" * 90 + "\n s"]


@settings(max_examples=300, deadline=None)
@given(st.text(" \n\t\u00a0\r\x1c\x85\u2003ab1.'", max_size=40))
def test_runs_of_mixed_white_space(text):
    count = wordpiece._counter(DATA, P.PATTERN)
    for t in (text, *MIXED):
        assert OURS.encode(t) == THEIRS.encode_ordinary(t)
        assert sum(count.parts(t)) >> wordpiece.BITS == len(bpe.regex.findall(P.PATTERN, t))


def test_machine_alone_equals_merging_with_few_states():
    machine = bpe.Transducer(bpe.read_ranks(DATA), max_states=30)
    rng = random.Random(3)
    for _ in range(60):
        data = bytes(rng.choice(b"aeinrst the-. 10") for _ in range(rng.randint(1, 80)))
        assert machine.encode(data) == machine.merge(data)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 50255), max_size=30), st.integers(1, 5))
def test_streamed_decoding_equals_decoding_at_once(ids, step):
    stream = bpe.Utf8Stream(OURS.tokens)
    got = "".join(stream.feed(ids[i:i + step]) for i in range(0, len(ids), step)) + stream.end()
    assert got == b"".join(OURS.tokens[i] for i in ids).decode(errors="replace")


def greedy(word, first, inside):
    count, at = 0, 0
    while at < len(word):
        use = first if at == 0 else inside
        size = next((n for n in range(len(word) - at, 0, -1) if word[at:at + n] in use), 0)
        if not size:
            return 1
        count, at = count + 1, at + size
    return count


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5).map(str.encode), max_size=12),
       st.sets(st.text("abc", min_size=1, max_size=5).map(str.encode), max_size=12), st.text("abc", max_size=14).map(str.encode))
def test_piece_counts_equal_greedy_cutting(first, inside, word):
    assert wordpiece.LongestMatch(list(first), list(inside)).count(word) == greedy(word, first, inside)
    assert wordpiece.LongestMatch(list(first)).count(word) == greedy(word, first, first)


def test_text_queries_on_odd_rows(spark):
    texts = [None, "", "a b", "a b", "x" * 20000, "It's 42\tfine é́"]
    rows = [(i, t, "other") for i, t in enumerate(texts)] + [(None, "null id", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    for r in bpe.round_trip(df, PATH, P.PATTERN).collect():
        text = dict((i, t) for i, t, _ in rows)[r.doc_id] or ""
        ids = THEIRS.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = bpe.decode_ids(bpe.encode_texts(df, PATH, P.PATTERN), PATH).collect()
    assert sorted((str(i), t) for i, t in back) == sorted((str(i), t or "") for i, t, _ in rows)
    counts = {r.doc_id: r for r in wordpiece.count_pieces(df, PATH, P.PATTERN).collect()}
    assert counts[0].n_pieces == counts[1].n_pieces == 0 and counts[2].n_pieces == 2 == counts[2].n_words
    assert bpe.round_trip(df.limit(0), PATH, P.PATTERN).count() == wordpiece.count_pieces(df.limit(0), PATH, P.PATTERN).count() == 0


CASES = {
    "email": "anna.b-7@mail3.example.com", "ip": "227.5.221.1", "card": "4349000490986231", "ssn": "123-45-6789",
    "phone": "+1 (743) 555-3824", "date": "2021-03-04", "iban": "DE89 3704 0044 0532 0130 00",
}


def test_every_kind_changes_keeps_its_form_and_turns_back():
    key = pseudonyms.Feistel(b"k")
    there, back = pseudonyms.Formats(key.forward), pseudonyms.Formats(key.back)
    card = "434900049098623"
    cases = CASES | {"card": card + pseudonyms.luhn(card)}
    for kind, value in cases.items():
        new = getattr(there, kind)(value)
        assert new and new != value and getattr(back, kind)(new) == value
        if kind != "ip":
            assert [c.isdigit() for c in new] == [c.isdigit() for c in value]
        assert getattr(there, kind)(new) is not None  # still valid


def test_permutation_of_any_size():
    key = pseudonyms.Feistel(b"k")
    for size in (1, 2, 3, 10, 97, 1000):
        assert sorted(key.forward(v, size, "t") for v in range(size)) == list(range(size))


def test_invalid_numbers_and_plain_texts_stay(spark):
    plain = ["Version 2.0.1 of 3.", "1219538112535717", "999.1.1.1 and 1.2.3.4.5", "2021-02-30", "key 44a0f5b6efd1d1e3", None, "", "1" * 5000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(plain)], "doc_id long, text string, found int")
    for r in pseudonyms.pseudonymise(df, b"k").collect():
        assert (r.text, r.n_found) == (plain[r.doc_id] or "", 0)


@pytest.mark.parametrize("value, kind", [("4111 1111 1111 1111", "card"), ("4111-1111-1111-1111", "card"), ("5500 0000 0000 0004", "card"),
                                         ("3782 822463 10005", "card"), ("BE68 5390 0754 7034", "iban"), ("DE89 3704 0044 0532 0130 00", "iban")])
@pytest.mark.parametrize("after", ["", " 12/26", " 12 26", " 123", " 1234", " 2026", " BIC", " IBAN", " IBAN BIC", " KREDBEBB"])
def test_numbers_are_found_before_other_groups(value, kind, after):
    formats = pseudonyms.Formats(pseudonyms.Feistel(b"k").forward)
    memo = pseudonyms.Memo(lambda hit: getattr(formats, hit[0])(hit[1]))
    new, found = pseudonyms.replace(f"pay {value}{after}", formats, memo)
    assert found == [(kind, 4, len(value), getattr(formats, kind)(value))] and new == f"pay {found[0][3]}{after}"


def test_equal_values_stay_linked_and_texts_turn_back(spark):
    texts = ["Call +1 (743) 555-3824 or mail Anna.B@x.example.org!", "call +1-743-555-3824 on 04/05/2020, 2020-04-05", "227.5.221.1*** is up"] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    done = pseudonyms.pseudonymise(df, b"secret")
    got = {r.doc_id: r for r in done.collect()}
    digits = lambda s: "".join(c for c in s if c.isdigit())
    assert digits(got[0].found[0].pseudonym) == digits(got[1].found[0].pseudonym) != "17435553824"
    assert [f.kind for f in got[1].found] == ["phone", "date", "date"] and got[0].text == got[3].text
    for r in got.values():
        for f in r.found:
            assert texts[r.doc_id][f.start:f.start + f.length] not in r.text
    again = pseudonyms.pseudonymise(done.select("doc_id", "text"), b"secret", back=True)
    assert {r.doc_id: r.text for r in again.collect()} == dict(enumerate(texts))


def test_new_words_of_many_texts_go_in_step():
    rng = random.Random(5)
    coder = bpe.Codec(bpe.read_ranks(DATA), P.PATTERN)
    letters = "aeinrstéßñ日'.7"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(300)) for _ in range(10)] + ["", "é" * 40, "x"]
    got = dict(coder.encode_rows((i, t or None) for i, t in enumerate(texts)))
    assert got == {i: THEIRS.encode_ordinary(t) for i, t in enumerate(texts)}
    assert len(coder.machine.states) < 200  # one by one, these words make thousands


def test_pieces_in_step_equal_the_machine():
    rng = random.Random(6)
    pieces = [rng.randbytes(rng.randint(1, 32)) for _ in range(300)] + [bytes([b]) * n for b in b"a -=\xc3" for n in range(1, 33)]
    pieces += [bytes(rng.choices(b"aeinrst the-. 10", k=rng.randint(1, 32))) for _ in range(300)]
    assert [list(bpe.array("I", ids)) for ids in OURS.abreast.encode(pieces)] == [OURS.machine.encode(p) for p in pieces]
    odd = bpe.Transducer([bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abcd", b"cd", b"aa", b"aaa", b"bcb"])
    pieces = [bytes(rng.choices(b"abcd", k=rng.randint(1, 12))) for _ in range(300)]
    assert [list(bpe.array("I", ids)) for ids in bpe.Lockstep(odd, bpe.NOTHING).encode(pieces)] == [odd.merge(p) for p in pieces]
