"""Line dedup, whitening and token alignment against plain versions."""

import hashlib
import json
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import difference
from tokenizers import Tokenizer

from rowwright.llm import crosstok, feast, linebloom, queries

JSON, MODEL = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SPACES = " \t\n\x0b\x0c\r"
RNG = random.Random(3)


# lines

def line_rows():
    shared = ["A line that many documents share %d" % k for k in range(6)] + ["short", "", "exactly twenty chars", "nineteen characters"]
    rows = [(None, None, "g"), (1, "", "g"), (2, "\n\n", "g"), (None, shared[0] + "\n" + shared[5], "g"), (None, shared[0], "g")]
    for i in range(3, 60):
        lines = [RNG.choice(shared) for _ in range(RNG.randint(0, 6))] + ["only document %d says this" % i] * (i % 3)
        lines += ["  \t" + shared[i % 6].upper() + "\r"] * (i % 4 == 0) + ["é" * 20] * (i % 5 == 0)
        RNG.shuffle(lines)
        rows.append((i, "\n".join(lines), "g"))
    return rows + [rows[20], rows[20], (61, "x " * 60_000 + "\n" + shared[1], "g")]


def plain_lines(rows, least=20, common=3):
    fold = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(SPACES))
    holders = {}
    for i, t, *_ in rows:
        for k in {fold(line) for line in (t or "").split("\n")}:
            if len(k) >= least:
                holders.setdefault(k, []).append(-math.inf if i is None else i)
    out = []
    for i, t, *_ in rows:
        own = -math.inf if i is None else i
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(fold(x), ())) < common or max(holders[fold(x)]) == own]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


@pytest.mark.parametrize("bits", [linebloom.MOST_BITS, 3])  # filters that suspect every line give the same result
def test_common_lines_stay_in_one_document(spark, monkeypatch, bits):
    rows = line_rows()
    monkeypatch.setattr(linebloom, "FEWEST_BITS", min(bits, linebloom.FEWEST_BITS))
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string").repartition(7)
    got = linebloom.drop_common_lines(df, most_bits=bits)
    assert Counter(map(tuple, got.collect())) == plain_lines(rows)
    assert linebloom.drop_common_lines(df.limit(0), most_bits=bits).collect() == []


def test_hot_lines_are_joined_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(linebloom, "HOT_KEYS", 10**9)
    rows = [(i, f"every document has this line {i % 2}\nown line of document number {i}") for i in range(3000)]
    got = linebloom.drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == plain_lines(rows)


def test_filters_have_every_repeated_key():
    rng = np.random.default_rng(5)
    keys = [rng.bytes(16) for _ in range(2000)]
    parts = [linebloom.Filters(13) for _ in range(3)]
    seen = Counter()
    for k in range(900):
        some = set(rng.choice(2000, 4).tolist())
        parts[k % 3].add(b"".join(keys[i] for i in some))
        seen.update(some)
    once, twice = parts[0].once, parts[0].twice
    for p in parts[1:]:
        linebloom.merge(once, twice, p.once, p.twice)
    found = parts[0].repeated(b"".join(keys))
    assert all(found[i] for i, n in seen.items() if n > 1) and not all(found)


def test_lines_agree_with_sql(spark, folder, db):
    assert difference(queries.op12_common_lines(spark, folder), db, queries.SQL["op12_common_lines"]) is None


# vectors

def symmetric(kind, size, rng):
    q = np.linalg.qr(rng.normal(size=(size, size)))[0]
    values = {"spread": np.geomspace(1, 1e-6, size), "equal": np.repeat([5.0, 1.0], [size - size // 3, size // 3]), "one": np.full(size, 3.0),
              "low rank": np.append(np.arange(1.0, 6), np.zeros(size - 5)), "close": 1 + 1e-9 * np.arange(size)}[kind]
    m = q @ np.diag(values) @ q.T
    return (m + m.T) / 2


@pytest.mark.parametrize("kind", ["spread", "equal", "one", "low rank", "close"])
@pytest.mark.parametrize("size", [7, 40])
def test_contours_find_all_eigenvectors(kind, size):
    m = symmetric(kind, size, np.random.default_rng(size))
    want = np.linalg.eigvalsh(m)[::-1]
    values, vectors = feast.largest(m, 32)
    k = min(32, size, 5 if kind == "low rank" else size)
    assert len(values) == k and np.abs(values - want[:k]).max() < 1e-13 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13
    assert np.abs(m @ vectors - vectors * values).max() < 1e-13 * want[0]
    for shift in (0.3, 1.00001, 2.9, 4.4):
        assert feast.inertia(m, shift) == (want > shift).sum()
    assert len(feast.largest(np.zeros((size, size)), 4)[0]) == 0


def plain_white(vectors, components=32):
    x = np.floor(64 * np.array(vectors)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    v = np.cov((x - s / n).T, bias=True).reshape(len(s), len(s))
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    deviation = [sum((int(n) * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return n, deviation, (x - s / n) @ axes / np.sqrt(values), values / np.trace(v)


@pytest.mark.parametrize("spread", [1.0, 1e9])
def test_whitened_vectors(spark, spread):
    rng = np.random.default_rng(9)
    good = (rng.normal(size=(150, 6)) * [1, 2, 3, 4, 5, 6] * spread).tolist()
    good += [good[0]] * 40
    bad = [None, [1.0, None, 3.0, 4.0, 5.0, 6.0], [math.nan] * 6, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0], [1.0], []]
    rows = [(i if i % 50 else None, v, i, "x") for i, v in enumerate(good + bad)]
    RNG.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row int, at string").repartition(4)
    n, deviation, white, explained = plain_white(good, 4)
    got = feast.whiten(df.drop("vec_id").withColumnRenamed("row", "vec_id"), components=4).collect()
    assert len(got) == 4 * n and {r.n for r in got} == {n} and got[0].identity_error < 1e-9
    signs = {}
    for r in got:
        want = white[r.vec_id, r.component - 1]
        assert int(r.deviation) == deviation[r.vec_id]
        assert abs(abs(r.whitened) - abs(want)) < 1e-7 and abs(r.explained - explained[r.component - 1]) < 1e-9
        if abs(want) > 1e-3:
            signs.setdefault(r.component, set()).add(np.sign(r.whitened) == np.sign(want))
    assert all(len(s) == 1 for s in signs.values())
    assert feast.whiten(df).count() == 6 * n  # null ids stay
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id long, embedding array<float>")
    assert feast.whiten(same).count() == feast.whiten(same.limit(0)).count() == 0


def test_whitening_query(spark, folder):
    rows = queries.op11_feast(spark, folder)
    assert dict(rows.dtypes)["deviation"] == "bigint"
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, white, explained = plain_white([r.embedding for r in vectors])
    by = {r.vec_id: k for k, r in enumerate(vectors)}
    for r in rows.collect():
        assert (r.n, r.deviation) == (n, deviation[by[r.vec_id]])
        assert abs(abs(r.whitened) - abs(white[by[r.vec_id], r.component - 1])) < 1e-6 and r.identity_error < 1e-9


# alignment

BOTH = crosstok.sides(open(JSON, encoding="utf-8").read(), open(MODEL, "rb").read())
THEIR_A, THEIR_B = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
THEIR_A.encode_special_tokens = True
NAMES = {i: t for t, i in json.load(open(JSON, encoding="utf-8"))["model"]["vocab"].items()}
LETTERS = crosstok.byte_alphabet()


def bytes_b(i):
    return bytes([int(THEIR_B.id_to_piece(i)[3:5], 16)]) if THEIR_B.is_byte(i) else THEIR_B.id_to_piece(i).replace("▁", " ").encode()


def plain_alignment(text):
    """Ids, groups and links of one text by sets of ends."""
    if not text:
        return [], [], [], []
    a, b = THEIR_A.encode(" " + text, add_special_tokens=False).ids, THEIR_B.encode(text)
    of_a, of_b = [bytes(LETTERS[c] for c in NAMES[i]) for i in a], [bytes_b(i) for i in b]
    if not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
        return [], [], [], []
    ends_a, ends_b = (np.cumsum([len(t) for t in x]).tolist() for x in (of_a, of_b))
    groups, links, low, left = [], [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        i, j = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append(",".join(map(str, a[low:i])) + "|" + ",".join(map(str, b[left:j])))
        links.append((a[i - 1], b[j - 1]))
        low, left = i, j
    return a, b, groups, links


ODD = [None, "", " ", "one", "▁ word", "word▁", "<|endoftext|> <s> </s>", "a  b", "a   b\n\n c", " lead", "trail ", "x" * 300, "日本語のテキスト é́ \U0001f600\U0001f1e9",
       "\x00\x01 \x7f", "it's 12345.678\r\n\tend", "supercalifragilistic expialidocious " * 40, "﻿bom ​ zero", "Ünïcödé straße naïve"]


def test_documents_are_aligned_as_the_plain_way(spark):
    texts = [*ODD, *ODD[10:14], *["the cat sat on the mat and %d" % i for i in range(30)]]
    rows = [(i if i != 7 else None, t, "n") for i, t in enumerate(texts)] + [(3, "one", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, links string").repartition(3)
    plain = [(i, plain_alignment(t)) for i, t, _ in rows]
    counts = Counter(link for _, x in plain for link in x[3])
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    want = Counter((i, len(a), len(b), len(g), len(k), sum(counts[x] == highest[x[1]] for x in k), sum(counts[x] for x in k), ";".join(g))
                   for i, (a, b, g, k) in plain)
    got = crosstok.aligned(df, JSON, MODEL)
    assert Counter(map(tuple, got.collect())) == want
    assert crosstok.aligned(df.limit(0), JSON, MODEL).collect() == []


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(crosstok, "MEMORY", 2000)
    words = ["w%d" % RNG.randint(0, 40) for _ in range(400)] + ["long" * 40]
    for k in range(0, 400, 20):
        some = words[k:k + 25]
        assert BOTH.parts(some) == [(len(a), len(b), np.searchsorted(BOTH.pairs, [i * BOTH.width + j for i, j in x]).astype("<u4").tobytes(), ";".join(g))
                                    for a, b, g, x in map(plain_alignment, some)]


@settings(max_examples=200, deadline=None)
@given(st.text(" \n\t \x1c▁aé1.'", max_size=30) | st.text(max_size=40))
def test_stretches_are_encoded_as_whole_texts(text):
    parts = BOTH.parts(BOTH.stretches(text))
    a, b, groups, _ = plain_alignment(text)
    if not parts or False in parts:
        assert not a
    else:
        assert (sum(p[0] for p in parts), sum(p[1] for p in parts), ";".join(p[3] for p in parts)) == (len(a), len(b), ";".join(groups))


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 400), min_size=1), st.sets(st.integers(1, 400), min_size=1), st.booleans())
def test_runs_are_all_common_ends(one, two, close):
    one, two = one | {401}, (one - set(list(two)[:5]) if close else two) | {401}
    a, b = np.array(sorted(one)), np.array(sorted(two))
    i, j = crosstok.align(a, b)
    assert a[i].tolist() == b[j].tolist() == sorted(one & two)


def test_alignment_query_digests_the_groups(spark, tmp_path):
    spark.createDataFrame([(1, "two words"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_token_alignment(spark, str(tmp_path)).collect()}
    assert got[1].groups_sha256 == hashlib.sha256(";".join(plain_alignment("two words")[2]).encode()).hexdigest()
    assert (got[2].groups_sha256, got[2].n_a) == ("", 0)
