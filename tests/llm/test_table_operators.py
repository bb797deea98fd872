"""Copies, mixing, quality, fingerprints, language model, pages and pipeline against plain versions."""

import math
import random
import re
from collections import Counter
from functools import cache
from zlib import crc32

import duckdb
import numpy as np
import pytest
from oracle import difference
from pyspark.sql import functions as F

import corpus_pipeline
from rowwright.llm import gam, imatch, lbl, minmax, mixing, queries, recipes, wrapper

SCHEMA = "doc_id long, text string, lang string, source string, hub string, row string, rep string"
RNG = random.Random(7)
VOCABULARY = ["".join(RNG.choice("abcdefghi") for _ in range(RNG.randint(2, 6))) for _ in range(300)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@cache
def odd_documents():
    base = prose(80)
    words = base.split(" ")
    near = []
    for k in range(40):
        w = list(words)
        for _ in range(k % 5):
            w[RNG.randrange(80)] = "new%d" % k
        near.append(" ".join(w))
    texts = [None, "", " \t", "one two", "One\nTWO", "a b c d e", base, base.upper(), base.replace(" ", "\n"), base + " ", prose(30000), *near]
    texts += [prose(RNG.randint(1, 60)) for _ in range(40)] + ["copy me now please"] * 30
    rows = [(i, t, "en", [None, "s1", "s2", "", "é"][i % 5] if i % 3 else "s1", "x", "y", "z") for i, t in enumerate(texts)]
    return rows + [rows[6]]  # one row twice


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA).repartition(5).cache()


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def components(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    least = {i: i for i in sets}

    def top(i):
        while least[i] != i:
            i = least[i]
        return i
    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                least[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_near_copies_are_the_components_of_all_pairs(spark, odd):
    want = components(odd_documents())
    for group in (minmax.GROUP, 200):  # also with stars cut into many blocks
        got = minmax.near_copies(odd, group=group).collect()
        assert len(got) == odd.count()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    nobody = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert all(r.kept for r in minmax.near_copies(nobody).collect())
    assert minmax.near_copies(odd.limit(0)).count() == 0


def test_signature_estimates_likeness():
    rng = np.random.default_rng(1)
    hits = [0, 0]
    for _ in range(60):
        common = rng.integers(0, 2**63, 180).astype(np.uint64)
        a, b = (np.unique(np.append(common, rng.integers(0, 2**63, 30).astype(np.uint64))) for _ in range(2))
        equal = minmax.bands(a) == minmax.bands(b)
        hits = [hits[0] + equal.sum(), hits[1] + len(equal)]
    assert abs(hits[0] / hits[1] - 0.75**4) < 0.06


def test_exact_copies(spark, odd):
    rows = odd_documents()
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(plain(t), []).append((-len(t or ""), i))
    for size in (16, 1):  # one byte: most chunks share a hash with others and are told apart
        got = recipes.exact_copies(odd, hash_bytes=size).collect()
        assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
        for r in got:
            mine = groups[plain(rows[r.doc_id][1])]
            assert (r.keep_id, r.group_size) == (min(mine)[1], len(mine))
    left = recipes.drop_copies(odd)
    assert left.columns == odd.columns and sorted(r.doc_id for r in left.collect()) == sorted(min(g)[1] for g in groups.values())
    assert recipes.exact_copies(odd.limit(0)).count() == 0


def test_chunks_cover_the_text_and_follow_its_content():
    data = RNG.randbytes(200_000)
    parts = recipes.chunks(data)
    assert b"".join(parts) == data and all(recipes.LEAST <= len(p) <= recipes.MOST for p in parts[:-1])
    moved = recipes.chunks(b"some bytes before" + data)
    assert len(set(parts) & set(moved)) > 0.9 * len(parts)
    assert recipes.chunks(b"") == [] and recipes.chunks(b"ab") == [b"ab"]


def test_mix_keeps_targets_and_limits(spark, odd):
    got = mixing.mix(odd).collect()
    again = mixing.mix(odd.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == odd.count()
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= mixing.BLOCK for s in sizes)
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    open_ = [s for s in order if target[s] < 3 * sizes[s]]
    assert len({round(target[s] / weight[s], 6) for s in open_}) == 1
    rows = Counter(r.doc_id for r in mixing.mixed_rows(odd).collect())
    assert max(n for i, n in rows.items() if i != 6) <= 3 and rows[6] <= 6  # two rows have that id
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mix(odd.filter("text IS NULL")).first().taken == 0


def test_apportionment_is_that_of_highest_quotients(spark):
    for n, house in ((7, 50), (40, 13), (3, 1000)):
        weights = [RNG.randint(1, 5) * RNG.choice([1, 100, 3000]) for _ in range(n)]
        df = spark.createDataFrame([(0, k, float(w), house) for k, w in enumerate(weights)], "g int, id int, weight double, house long")
        got = {r.id: r.seats for r in mixing.apportion(df, ["g"], "weight", "house", ["g", "id"]).collect()}
        quotients = sorted((-w / (2 * k + 1), i) for i, w in enumerate(weights) for k in range(house))[:house]
        want = Counter(i for _, i in quotients)
        assert got == {i: want[i] for i in range(n)}


def test_mix_equals_sql_on_several_shards(spark, odd, monkeypatch):
    db = duckdb.connect()
    db.register("documents", odd.select("doc_id", "text", "source").toPandas())
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    assert difference(mixing.mix(odd).select(*columns), db, queries.SQL["op6_mix"]) is None
    small = queries.SQL["op6_mix"].replace("262144", "500")
    assert difference(mixing.mix(odd, shard=500).select(*columns), db, small) is None


def test_mix_lines_up_rows_with_words_only(spark, odd):
    plan = mixing.mix(odd)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Filter .*size#\d+L > 0", plan[plan.index("Window"):])
    empty = mixing.mix(spark.range(50).selectExpr("cast(null as long) doc_id", "if(id < 40, '', 'a b') text", "'s' source")).collect()
    assert len(empty) == 50 and all(r.taken == r.size for r in empty) and sum(r.size for r in empty) == 20


def test_quality_learns_without_held_out_labels(spark, folder):
    docs, labels = (queries.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    got = {r.doc_id: r for r in gam.quality(docs, labels).collect()}
    assert all(r.held_out == (crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.97


def test_quality_on_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {round(r.score, 6) for r in gam.quality(odd, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(60)] + [(None, 0), (5, None), (6, 1)], "doc_id long, quality int")
    got = gam.quality(odd, one).collect()
    assert len(got) == odd.count() and all(r.predicted for r in got)
    assert gam.quality(odd.limit(0), one).count() == 0
    kept = gam.drop_rejected(odd, one)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(2)
    rows = rng.random((4000, 3))
    labels = ((rows[:, 0] > 0.5) ^ (rows[:, 1] > 0.5)).astype(float)
    model = gam.fit(rows[:3000], labels[:3000])
    assert ((model.score(rows[3000:]) > 0.5) == labels[3000:]).mean() > 0.9


def test_fingerprints(spark, odd):
    rows = odd_documents()
    got = {r.doc_id: r for r in imatch.fingerprints(odd).collect()}
    ordered = sorted(((i, t or "") for i, t, *_ in rows), key=lambda x: x[0])
    for k, (i, t) in enumerate(ordered):
        if ordered.count((i, t)) == 1:
            changed = imatch.edited(t, ordered[(k + 1) % len(ordered)][1])
            assert got[i].n_chars == len(t) and got[i].edited_sha256 == recipes.hashlib.sha256(changed.encode()).hexdigest()
    prints = {}
    for i, t in ordered:
        assert prints.setdefault(t, got[i].fingerprint) == got[i].fingerprint
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[10].near_edited > 0.2 > got[10].near_next
    assert imatch.fingerprints(odd.limit(0)).count() == 0
    alone = imatch.fingerprints(spark.createDataFrame([(4, "abcd efgh")], "doc_id long, text string")).first()
    assert alone.edited_sha256 == recipes.hashlib.sha256(b"abcd efab").hexdigest() and alone.near_next == 1
    nulls = spark.createDataFrame([(None, "b"), (2, "abcd"), (None, None)], "doc_id long, text string")
    assert imatch.fingerprints(nulls).count() == 3


def test_texts_without_terms_of_the_band_are_told_apart(spark):
    texts = ["one two", "three four five", "three five four", "three five four", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")  # some terms are in more than a tenth
    got = {r.doc_id: r for r in imatch.fingerprints(df).collect()}
    assert [got[i].near_next for i in range(6)] == [0, 0, 1, 0, 1, 0] and got[1].near_edited == 0
    assert len({r.fingerprint for r in got.values()}) == 4
    words = [b"a%d" % k for k in range(1500)]
    known = np.sort(np.array([imatch.xxhash.xxh3_64_intdigest(w) - 2**63 for w in words], np.int64))
    printer, seen = imatch.Printer(known), {}
    for k in range(0, 1500, 3):  # some have all terms in one part of the first level
        text = b" ".join(words[k:k + 3]).decode()
        assert seen.setdefault(printer(text), text) == text


def plain_parts(terms):
    """Parts of every level by plain loops over single terms."""
    stir = lambda v: int(imatch._stir(np.array([v], np.uint64))[0])
    parts, fine = {}, {}
    for t in sorted(terms):
        drawn = stir(t % 2**64)
        for level in range(imatch.LEVELS):
            if drawn >> 20 & (4**level - 1):
                break
            parts.setdefault(level * imatch.PARTS + drawn % imatch.PARTS, []).append(t)
        fine.setdefault(drawn >> 40 & (imatch.FINE - 1), []).append(t)
    return parts, fine


@pytest.mark.parametrize("n", [1, 2, 30, 48, 49, 700, 9000])
def test_parts_hold_the_terms_they_should(n):
    rng = np.random.default_rng(n)
    one = np.unique(rng.integers(-2**63, 2**63, n))
    two = np.unique(np.append(one[: len(one) * 3 // 4 + 1], rng.integers(-2**63, 2**63, n // 4)))
    made = [imatch.fingerprint(x) for x in (one, two)]
    (a, fine_a), (b, fine_b) = (plain_parts(x.tolist()) for x in (one, two))
    for parts, m in ((a, made[0]), (b, made[1])):
        dense = int.from_bytes(m[:imatch.BITS], "big")
        assert {p for p in range(imatch.LEVELS * imatch.PARTS) if dense >> p & 1} == {p for p, t in parts.items() if len(t) > imatch.FEW}
    if max(len(one), len(two)) <= imatch.SHORT:
        x, y = fine_a, fine_b
    else:
        x, y = ({p: t for p, t in q.items() if len(a.get(p, ())) <= imatch.FEW and len(b.get(p, ())) <= imatch.FEW} for q in (a, b))
    keys = x.keys() | y.keys()
    assert imatch.likeness(*made) == pytest.approx(sum(x.get(p) == y.get(p) for p in keys) / len(keys))
    assert imatch.likeness(*made) > 0.3 or n < 3


def test_edited_texts_stay_like_and_ids_may_be_texts(spark):
    got = imatch.fingerprints(queries.table(spark, "/root/testdata/sf0.01", "documents")).collect()
    assert sum(r.near_edited for r in got) / len(got) > 0.5 > 20 * sum(r.near_next for r in got) / len(got)
    # against the resemblance of all terms of the lexicon
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    printer = imatch.Printer(imatch.lexicon(docs, "text"))
    ordered = sorted((r.doc_id, r.text or "") for r in docs.collect())
    near, errors = {r.doc_id: r.near_edited for r in got}, []
    for k, (i, t) in enumerate(ordered):
        both = [{h for h in map(printer.known.__getitem__, imatch.terms(x)) if h is not False} for x in (t, imatch.edited(t, ordered[(k + 1) % len(ordered)][1]))]
        if both[0] and both[1]:
            errors.append((abs(near[i] - len(both[0] & both[1]) / len(both[0] | both[1])), near[i], len(both[0] & both[1]) / len(both[0] | both[1])))
    assert sum(e for e, *_ in errors) / len(errors) < 0.12
    assert max([true for _, n, true in errors if n == 0], default=0) < 0.25
    named = spark.createDataFrame([("b", "two words"), ("a", "one"), (None, "x"), ("c", None)], "doc_id string, text string")
    found = {r.doc_id: r for r in imatch.fingerprints(named).collect()}
    assert found["a"].edited_sha256 == recipes.hashlib.sha256(b"one").hexdigest() and len(found) == 4
    assert found["b"].edited_sha256 == recipes.hashlib.sha256(b"two wor").hexdigest()


def test_lexicon_is_the_band(spark):
    docs = [(i, "all " + ("half " if i % 20 == 0 else "") + f"own{i}") for i in range(2000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {imatch.xxhash.xxh3_64_intdigest(b"half") - 2**63}
    assert set(imatch.lexicon(df, "text").tolist()) == want


def plain_scores(rows, learn):
    counts = Counter()
    for t in learn:
        counts.update([*lbl.words(t), b""])
    n, v = sum(counts.values()), len(counts)
    return {i: (len(lbl.words(t)) + 1, sum(w in counts for w in [*lbl.words(t), b""]), n,
                sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*lbl.words(t), b""])) for i, t in rows}


@pytest.mark.parametrize("common", [lbl.COMMON, 20])
def test_language_model(spark, odd, monkeypatch, common):
    monkeypatch.setattr(lbl, "COMMON", common)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    held = lambda i: crc32(str(i).encode()) % 7 == 2
    want = plain_scores(rows, [t for i, t in rows if not held(i)])
    got = lbl.score_texts(odd).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.held_out == held(r.doc_id)
        assert r.base_score == pytest.approx(want[r.doc_id][3]) and r.score < 0
    assert lbl.score_texts(odd.limit(0)).count() == 0
    unseen = lbl.score_texts(odd.filter("doc_id = 6"))  # may be without any training text
    assert unseen.count() == 2


def test_model_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    chain = [0, 1]
    for _ in range(60_000):  # each word mostly follows from the one before
        chain.append((chain[-1] * 3 + 1) % 7 if rng.random() < 0.8 else int(rng.integers(7)))
    ids = np.array(chain)
    model = lbl.Model(np.bincount(ids, minlength=7).astype(float))
    scorer = lbl.Scorer(model)
    before = scorer(ids[1:-1], ids[:-2], ids[2:]).mean()
    for at in range(2, len(ids) - 2048, 2048):
        some = np.arange(at, at + 2048)
        model.train(ids[some - 1], ids[some - 2], ids[some], rng)
    scorer = lbl.Scorer(model)
    total = sum(np.exp(scorer(np.full(1, 2), np.full(1, 5), np.full(1, w))[0]) for w in range(7))
    assert total == pytest.approx(1) and scorer(ids[1:-1], ids[:-2], ids[2:]).mean() > before + 0.15


def test_batches_hold_every_place_once():
    lengths = [3, 1, 3 * lbl.BATCH + 5, 7, lbl.BATCH, 1]
    ids = np.split(np.arange(sum(lengths)), np.cumsum(lengths)[:-1])
    got = list(lbl.batches((i, i + 1, i + 2) for i in ids))
    assert [len(t) for *_, t in got] == [lbl.BATCH] * (sum(lengths) // lbl.BATCH) + [sum(lengths) % lbl.BATCH]
    for k in range(3):
        assert np.concatenate([b[k] for b in got]).tolist() == list(range(k, sum(lengths) + k))
    assert list(lbl.batches([])) == []


def test_all_places_of_a_long_text_are_learned(spark):
    learned = next(i for i in range(9) if crc32(str(i).encode()) % 7 != 2)
    df = spark.createDataFrame([(learned, "a b c d e f g h " * 40_000)], "doc_id long, text string")
    row = lbl.score_texts(df).first()
    assert row.base_score / row.n_tokens < -0.85 and row.score / row.n_tokens > -0.3


def test_held_out_texts_score_better_than_by_counts(spark):
    got = lbl.score_texts(queries.table(spark, "/root/testdata/sf0.01", "documents")).filter("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style></head><body><header>Site</header>
<nav><ul><li><a href=/a>{n}</a><li>Menu</ul></nav><div class="site-notice">{n} cookies</div><div><p>Same on all pages</p></div>
<article><h1>Head {n}</h1><p>First&nbsp;&lt;b&gt; {n} <b>bold</b>
 text<p>Second {n}<br>line<ul><li>one {n}<li>two {n}</ul><form>Mail <input></form><script>"</p>"</script><div id="comments"><p>reader {n}</p></div></article>
<aside>side {n}</aside><footer>&copy; {n}</footer></body></html>"""


def test_pages():
    pages = [PAGE.format(n=n) for n in range(6)]
    want = [f"Head {n}\nFirst <b> {n} bold text\nSecond {n} line\none {n}\ntwo {n}" for n in range(6)]
    assert wrapper.extract(pages) == want and wrapper.extract(pages[:1]) == want[:1]
    bare = [p.replace("article>", "div>") for p in pages]
    assert wrapper.extract(bare) == want  # what all pages share is template
    assert wrapper.extract([pages[0]] * 9) == want[:1] * 9  # copies of one page hide nothing
    assert wrapper.extract(["", "<p>", "plain & simple", "</p><b>x", "<script>never closed"]) == ["", "", "plain & simple", "x", ""]
    assert wrapper.extract(["<article>" + "<p>a b</p>" * 20000]) == ["\n".join(["a b"] * 20000)]
    assert wrapper.extract(["<div>" * 3000 + "deep"]) == ["deep"]


@pytest.mark.parametrize("names", ["site with-sidebar", "no-sidebar", "has-comments", "ad-free", "sidebar", "page widget"])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_articles_below_named_wrappers_are_found(names, tag):
    page = f'<div class="{names}"><{tag}><p>Text</p><div class="comments">reader</div></{tag}></div><div id="comments"><article>x</article></div>'
    assert wrapper.extract([f"<body>{page}</body>", f"<body><{tag}>Text</{tag}><p>out</p></body>"]) == [
        "Text" if tag == "main" or names not in ("sidebar", "page widget") else "Text\nx", "Text"]


def test_teasers_do_not_hide_main():
    teaser = "<article>teaser</article>"
    assert wrapper.extract([f"<body>{teaser}<main><p>Text</p></main>{teaser}</body>"]) == ["Text"]
    inside = "<main><p>in main</p><article>Text</article><div id=comments><article>reader</article></div></main>"
    assert wrapper.extract([inside, inside.replace("<article>Text</article>", "")]) == ["Text", "in main"]
    assert wrapper.extract(["<main><div class=widget><article>Text</article></div></main>"]) == ["Text"]
    layout = "<div class='site with-sidebar'><p>Text</p><p class=sidebar>x</p></div>"
    assert wrapper.extract([layout]) == ["Text"]


def site(layout, n, rng):
    """A page without any telling tag or name: boilerplate around and between varying sentences."""
    say = lambda: " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(3, 12)))
    body = [say() for _ in range(rng.randint(1, 4))]
    lines = "".join(f"<p>{t}</p>" for t in body)
    if layout == "a":
        page = (f"<div class=x><p>Tagline of this place</p><h1>Head {n}</h1>{lines}<p>Sign up for our letter today</p>"
                f"<ul><li>Item {n}</li><li>All rights kept</li></ul></div><div class=y><p>Made by us</p></div>")
        return page, "\n".join([f"Head {n}", *body, f"Item {n}"])
    page = f"<table><tr><td>Another slogan</td></tr></table><section>{lines}<p>Call <b>Note</b> us {n}</p><p>Sign up for our letter today</p></section>"
    return page, "\n".join([*body, f"Call Note us {n}"])


def plain_dropping(pages):
    """Texts of innermost blocks that nearly all different pages with the same layout have at the same path of names."""
    parsed = [wrapper.Page(p) for p in pages]
    seen = {}
    for page in parsed:
        for _, text, node in page.slots(wrapper.Reference(["none", "", []])):  # nothing aligns: paths alone
            seen.setdefault((page.layout, node.tag, node.names, text), set()).add(page.digest)
    sizes = {p.layout: len({q.digest for q in parsed if q.layout == p.layout}) for p in parsed}
    return {(t, n, x) for (layout, t, n, x), some in seen.items() if len(some) >= max(4, 0.9 * sizes[layout])}


@pytest.mark.parametrize("counts", [(12, 8), (203, 0), (5, 4)])
def test_each_layout_of_a_host_has_its_template(counts):
    rng = random.Random(1)
    made = [site("a", n, rng) for n in range(counts[0])] + [site("b", n, rng) for n in range(counts[1])]
    pages, want = [m[0] for m in made], [m[1] for m in made]
    assert wrapper.extract(pages) == want
    without = wrapper.extract(pages, use_template=False)
    assert all(a != b for a, b in zip(without, want))  # the template decides, not tags or names
    fixed = plain_dropping(pages)
    for page, text in zip(map(wrapper.Page, pages), want, strict=True):
        gone = {id(node) for _, t, node in page.slots(wrapper.Reference(["none", "", []])) if (node.tag, node.names, t) in fixed}
        assert wrapper.content(page.tree, gone) == text


def test_few_pages_have_no_template():
    rng = random.Random(2)
    pages = [site("a", n, rng)[0] for n in range(3)]
    assert wrapper.extract(pages) == wrapper.extract(pages, use_template=False)
    assert wrapper.extract(pages * 5) == wrapper.extract(pages * 5, use_template=False)  # copies count once


@pytest.mark.parametrize("sent", [wrapper.SENT_BYTES, 0])
def test_hosts_in_spark_are_those_in_memory(spark, monkeypatch, sent):
    monkeypatch.setattr(wrapper, "SENT_BYTES", sent)
    rng = random.Random(3)
    hosts = {"one.example": [site("ab"[n % 3 == 0], n, rng)[0] for n in range(40)], "two.example": [site("a", n, rng)[0] for n in range(3)],
             "three.example": [PAGE.format(n=n) for n in range(6)] * 2}
    rows = [(f"https://{h}/{n}", p) for h, pages in hosts.items() for n, p in enumerate(pages)]
    df = spark.createDataFrame([(i, u, p) for i, (u, p) in enumerate(rows)], "page_id long, url string, html string").repartition(6)
    want = {f"https://{h}/{n}": t for h, pages in hosts.items() for n, t in enumerate(wrapper.extract(pages))}
    assert {r.url: r.text for r in wrapper.main_texts(df).collect()} == want


def test_names_that_tell_of_notices_and_sentences():
    notices = ["ad-slot", "cookie-banner-wrapper", "related-posts", "newsletter-box", "share-buttons"]
    page = "<article><p>Text</p>{}<p>A <span class=comment>remark</span> and <label>label</label> <span class=ad>buy</span></p></article>"
    boxes = "".join(f"<div class='{n}'>no</div>" for n in notices)
    assert wrapper.extract([page.format(boxes)]) == ["Text\nA remark and label"]
    assert wrapper.extract(["<article><p class=share-price>Price</p><div class='with-sidebar'><p>in</p></div></article>"]) == ["Price\nin"]


def test_page_table(spark):
    rows = [(n, f"https://Host.example/{n}", PAGE.format(n=n), 1) for n in range(8)]
    rows += [(8, None, None, 1), (9, "no host", "", 1), (None, "https://other.example", "<p>x", 1), (3, *rows[3][1:])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = wrapper.main_texts(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    assert text[8] == text[9] == "" and text[None] == "x" and text[3].startswith("Head 3\nFirst")
    assert wrapper.main_texts(df.limit(0)).count() == 0


def test_pipeline_stages_against_plain_versions(spark, folder):
    docs = queries.table(spark, folder, "documents")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, folder).cache()
    labels = {r.doc_id: r.quality for r in queries.table(spark, folder, "labels").collect()}
    left = {r.doc_id for r in good.collect()}
    assert good.columns == docs.columns
    assert sum((i in left) == (q == 1) for i, q in labels.items()) / len(labels) > 0.95
    once = stages["exact_copies"](spark, good, folder).cache()
    assert once.count() == len({re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in good.collect()})
    near = stages["near_copies"](spark, once, folder).cache()
    want = components([(r.doc_id, r.text) for r in once.collect()])
    assert {r.doc_id for r in near.collect()} == {i for i, (_, c) in want.items() if c == i}
    mixed = stages["mix"](spark, near, folder).cache()
    copies = {r.doc_id: r.copies for r in mixing.mix(near).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: c for i, c in copies.items() if c})
    assert stages["byte_bpe"](spark, mixed, folder).count() == mixed.count()


def test_pipeline_runs_on_odd_rows(spark, tmp_path, odd):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_stages_take_columns_of_any_name_and_empty_tables(spark, folder):
    names = ["label_id", "__turn", "__id", "__copies", "__row", "c0", "band", "hub"]
    docs = queries.table(spark, folder, "documents").filter("doc_id < 60")
    docs = docs.select("*", *[F.lit("x").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, folder)
        assert left.columns == docs.columns, name
        assert {tuple(r)[-len(names):] for r in left.collect()} == {("x",) * len(names)}, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
