"""Operators on single texts: classifiers, licences, pages, leaks, packing."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from partita.llm import decontaminate as D
from partita.llm import learning, licenses, mainhtml, packing, quality, toxicity

ODD = [None, "", "  \n\t ", "a", "A b", "é ß 日本 \U0001f600", "x" * 200_000, "line\n" * 5000]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, a null id, and columns named like the operators' own."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "a"), (3, "a"), (None, "A b"), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "text as hash", "doc_id as node", "text as score", "1 as label", "2 as rank")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def labelled(spark, n=240):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [f"word{(i * 7 + j * 13) % 97}" for j in range(30)]
        text = " ".join(words[:15]).capitalize() + ".\n" + " ".join(words[15:]) + "."
        rows.append((i, text.replace(" ", "### ").upper() if bad else text, text.replace(words[5], "horrid") if bad else text))
        labels.append((i, int(not bad), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, junk string, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("make, label, column", [(toxicity.toxicity, "toxic", "text"), (quality.quality, "quality", "junk")])
def test_classifiers_learn_and_hold_out(spark, odd, make, label, column):
    docs, labels = labelled(spark)
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    got = make(docs, labels, text_col=column).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    out = [r for r in got if r["held_out"]]
    assert len(out) > 20 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in out]) > 0.95
    # labels of held-out ids change nothing
    flipped = labels.selectExpr("doc_id", *[f"case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - {c} else {c} end as {c}" for c in ("quality", "toxic")])
    assert {(r["doc_id"], r["score"]) for r in make(docs, flipped, text_col=column).collect()} == {(r["doc_id"], r["score"]) for r in got}
    # odd rows, no rows, and labels of one class or none
    few = docs.selectExpr("doc_id + 1000 as doc_id", f"{column} as text").unionByName(odd.select("doc_id", "text"))
    scored = make(few, labels.selectExpr("doc_id + 1000 as doc_id", "quality", "toxic")).collect()
    assert len(scored) == few.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert make(empty(spark), labels).collect() == []
    assert len(make(odd, labels.where(f"{label} = 1")).collect()) == odd.count()
    assert {r["predicted"] for r in make(odd, labels.limit(0)).collect()} <= {0, 1}


def test_quality_filter_keeps_columns(spark, odd):
    docs, labels = labelled(spark)
    kept = quality.good_documents(docs.selectExpr("doc_id", "junk as text", "doc_id as score"), labels)
    assert kept.columns == ["doc_id", "text", "score"] and {r["doc_id"] % 4 for r in kept.collect()} == {1, 2, 3}


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(1)
    doc = np.array([0, 0, 0, 0, 2, 3, 3])
    z, trans = rng.normal(size=7), rng.normal(size=(2, 2))
    good, pairs, log_sum = quality.forward_backward(z, trans, quality.chains(doc))
    want, total, expected = np.zeros(7), 0.0, np.zeros((2, 2))
    for d in set(doc.tolist()):
        at = np.flatnonzero(doc == d)
        weights = {}
        for path in np.ndindex(*[2] * len(at)):
            s = sum(z[a] * y for a, y in zip(at, path, strict=True)) + sum(trans[p, y] for p, y in zip(path, path[1:], strict=False))
            weights[path] = np.exp(s)
        norm = sum(weights.values())
        total += np.log(norm)
        for path, w in weights.items():
            want[at] += np.array(path) * w / norm
            for p, y in zip(path, path[1:], strict=False):
                expected[p, y] += w / norm
    assert np.allclose(good, want) and np.allclose(pairs, expected) and log_sum == pytest.approx(total)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB1. é\n\t#", max_size=40), min_size=1, max_size=6))
def test_line_features_do_not_depend_on_neighbouring_documents(texts):
    model = quality.Model(np.random.default_rng(0).normal(size=3 * quality.FEATURES + 3), np.array([[0.3, -0.2], [0.1, 0.4]]))
    data = [t.encode() for t in texts]
    together = quality.scores(pa.array(data, pa.binary()), model)
    alone = [quality.scores(pa.array([d], pa.binary()), model)[0] for d in data]
    assert np.allclose(together, alone)
    assert np.allclose(quality.scores(pa.array([b"x", None, *data], pa.binary()).slice(2), model), together)


def test_minimiser():
    a = np.diag([1.0, 10.0, 100.0])
    x = learning.minimise(lambda p: (float(0.5 * (p - 1) @ a @ (p - 1)), a @ (p - 1)), np.zeros(3), 200, tolerance=1e-9)
    assert np.allclose(x, 1, atol=1e-4)


def test_grams_are_character_n_grams():
    assert len(toxicity.grams("ab")) == 2 + 1  # " ab", "ab ", " ab "
    assert set(toxicity.grams("A  b\n")) == set(toxicity.grams("a b")) and len(toxicity.grams("")) == 0
    assert set(toxicity.grams("bcd")) < set(toxicity.grams("bcd xyz"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcdexyz"), max_size=14))
def test_licences_against_all_stretches(words):
    from collections import Counter

    templates = {"a": "a b c d e", "b": "b c", "c": "x y z a b c"}
    got, want = licenses.Scanner(templates, 0.7)(" ".join(words)), {}
    for name, text in templates.items():
        t = Counter(licenses.bigrams(text.split()))
        dice = [0.0]
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                c = Counter(licenses.bigrams(words[i:j]))
                dice.append(2 * sum((c & t).values()) / (sum(c.values()) + sum(t.values())))
        if max(dice) >= 0.7:
            want[name] = max(dice)
    assert {k: round(v[0], 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}


def test_licences_in_documents(spark, odd):
    mit = licenses.TEMPLATES["MIT"]
    docs = spark.createDataFrame([(1, "Some words. " + mit.replace("\n", "  ").lower() + " more"), (2, "All rights reserved."), (3, "no licence here at all")], "doc_id long, text string")
    got = {(r["doc_id"], r["license"]): r for r in licenses.licenses(docs).collect()}
    assert got[1, "MIT"]["dice"] == 1.0 and got[1, "MIT"]["start"] == 2 and got[2, "All-rights-reserved"]["best"] and all(k[0] != 3 for k in got)
    assert licenses.licenses(odd).collect() == [] and licenses.licenses(empty(spark)).collect() == []


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_every_template_is_told_from_the_others(name):
    text = "Some words before. " + licenses.TEMPLATES[name].upper().replace("\n", " * ") + " And after."
    found = licenses.Scanner(licenses.TEMPLATES)(text)
    dice, start, words = found[name]
    assert dice == 1.0 and start == 3 and all(o[0] < 1.0 or o[2] < words for k, o in found.items() if k != name)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";track({n});</script></head><body class="has-sidebar">
<div id="cookie-banner">We use cookies</div><header><h1>Site</h1></header><nav><ul><li><a href="/x>y">Menu</a></ul></nav><!-- <article>no</article> -->
<article><header><h1>Title {n} &amp; more</h1></header><p>One <b>bo</b>ld&nbsp;{n}<p>Two<br>three<script>if (a<b) "</article>"</script><div class="ad">buy</div>
<p>Sign up for our letters</p><ul><li>a<li>b {n}</ul></article><section id="comments"><article class="comment"><p>nice</p></article></section>
<aside>s</aside><footer>&copy; f</footer></body></html>"""


def test_pages(spark):
    rows = [(n, f"http://a.example/{n}", PAGE.format(n=n)) for n in range(8)]
    rows += [(100, "http://b.example/1", PAGE.format(n=9)), (101, None, "<p>x <p>y &lt; 1"), (102, "http://c.example", None), (103, "nonsense", ""), (None, "http://b.example/2", "<main>é</main>")]
    rows += rows[:2]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as host", "3 as token")
    got = mainhtml.main_text(pages).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    # what stands on every page of the host is template, inside the article too
    assert all(by[n] == f"Title {n} & more One bold {n} b {n}" for n in range(8))
    assert by[100] == "Title 9 & more One bold 9 Two three Sign up for our letters a b 9"
    assert (by[101], by[102], by[103], by[None]) == ("x y < 1", "", "", "é")
    assert mainhtml.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_copies_of_an_article_are_not_template(spark):
    rows = [(n, f"http://a.example/{n}", f"<nav>m</nav><article><p>{'same text' if n < 4 else f'text {n}'}</p></article>") for n in range(12)]
    got = {r["page_id"]: r["text"] for r in mainhtml.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "same text" and got[11] == "text 11"


@pytest.mark.parametrize("copies, others, repeats", [(6, 4, 1), (10, 0, 1), (1, 1, 5), (1, 4, 6)])
def test_copied_articles_and_repeated_rows_count_once(spark, copies, others, repeats):
    def page(n, words):
        return (n, f"http://a.example/{n}", f"<div class='x'><p>Site {n}</p></div><nav>{n}</nav><article><h1>{words}</h1><p>{words} one</p><p>{words} two</p></article>")

    rows = [page(n, "same") for n in range(copies)] * repeats + [page(100 + n, f"other {n}") for n in range(others)]
    got = mainhtml.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    assert all(r["text"] == ("same same one same two" if r["page_id"] < 100 else "other {0} other {0} one other {0} two".format(r["page_id"] - 100)) for r in got)


def test_words_of_a_class_or_id_as_a_whole():
    page = """<div class="cookie-banner">c</div><article class="post"><h2 id="social-history">h</h2><section id="related-work">r</section>
<section id="comments">o</section><div class="search-results-analysis">s</div><div class="wide ad">a</div><div id="share">b</div><p class="social-history">e</p></article>"""
    assert mainhtml.extract(page) == "h r o s e"
    assert mainhtml.extract("<div id='cookie-banner'>c</div><h2 class='search'>h</h2><div class='site-header'>t</div><div class='header'>m</div>") == "h t"


def edit_distance(p, t, anywhere):
    prev = [0 if anywhere else j for j in range(len(t) + 1)]
    for i, a in enumerate(p, 1):
        cur = [i]
        for j, b in enumerate(t, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (a != b)))
        prev = cur
    return min(prev) if anywhere else prev[-1]


@settings(max_examples=150, deadline=None)
@given(st.text("abc ", min_size=20, max_size=60), st.text("abc ", max_size=60), st.text("abc ", max_size=40), st.lists(st.tuples(st.integers(0, 10**6), st.sampled_from(["cut", "put", "a", "b"])), max_size=8))
def test_leaks_against_full_edit_distance(item, before, after, edits):
    text = list(item)
    for place, what in edits:
        k = place % max(1, len(text))
        if what == "cut":
            del text[k : k + 1]
        elif what == "put":
            text.insert(k, "c")
        else:
            text[k : k + 1] = [what]
    text = before + "".join(text) + after
    got, least = D.Finder([(7, item)], 0.1)(text), edit_distance(item, text, True)
    assert (7 in got) == (least <= int(0.1 * len(item)))
    if got:
        distance, start, stop = got[7]
        assert distance == least == edit_distance(item, text[start:stop], False)


def test_repeating_texts_are_read_once():
    import time

    text, item = "the cat sat on the mat and the " * 20_000, "the cat sat on the mat and then the cat sat on a hat"
    began = time.time()
    got = D.Finder([(1, item)], 0.08)(text)
    assert time.time() - began < 8 and ((1 in got) == (edit_distance(item, text[:200], True) <= 4))
    assert list(D._stretches([0, 1, 9, 30], 1, 5)) == [(0, 10), (17, 26), (59, 68)]


def test_samples_are_bounded_by_their_size(spark):
    sample = spark.createDataFrame([(bytes(10) + bytes([n]), n % 2) for n in range(20)], "f binary, label int")
    assert learning.bounded(sample, "f", 1000).count() == 20 and learning.bounded(sample, "f", 60).count() == 5 and learning.bounded(sample, "f", 3).count() == 1


def test_ratios_and_score_against_brute_force():
    texts = [("bad bad day", 1), ("a bad word", 1), ("good day", 0), ("a good word", 0), ("fine", 0)]
    docs = [{int(g) for g in toxicity.grams(t)} for t, _ in texts]
    y = [label for _, label in texts]
    counts, n = np.zeros((2, 1 << toxicity.BITS), np.int64), np.bincount(y)
    for d, label in zip(docs, y, strict=True):
        counts[label, list(d)] += 1
    ratio = toxicity.ratios(counts, n)
    for g in set().union(*docs):
        share = [(sum(g in d for d, label in zip(docs, y, strict=True) if label == c) + toxicity.SMOOTHING) / (n[c] + 2 * toxicity.SMOOTHING) for c in (0, 1)]
        want = np.log(share[1] / share[0])
        assert ratio[g] == pytest.approx(want if abs(want) >= toxicity.LEAST_RATIO else 0)
    model = toxicity.fit([(np.array(sorted(g for g in d if ratio[g]), np.int32), label) for d, label in zip(docs, y, strict=True)], ratio)
    got = toxicity.score(pa.array([t for t, _ in texts]), model)
    for d, s in zip(docs, got, strict=True):
        assert s == pytest.approx(1 / (1 + np.exp(-(model.bias + sum(float(model.weight[g]) for g in d)))), rel=1e-6)
    assert min(got[:2]) > max(got[2:])


def test_short_items_as_whole_words(spark):
    items = spark.createDataFrame([(1, "Who is Ada?"), (2, "東京の人口は"), (3, " ?! ")], "item_id long, text string")
    rows = [(1, "so who is ada, then"), (2, "who is adam"), (3, "who is ado"), (4, "昨日、東京の人口は何人ですか"), (5, "東京の口は"), (6, "who is adam who is ada")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r)[:4] for r in D.leaks(docs, items).collect()) == [(1, 1, 0, 3), (4, 2, 0, 3), (6, 1, 0, 12)]
    assert sorted(r["doc_id"] for r in D.without_leaks(docs, items).collect()) == [2, 3, 5]


def test_leaks_in_documents(spark, odd):
    item = "the quick brown fox jumps over the lazy dog and runs far away"
    items = spark.createDataFrame([(1, item), (2, "short"), (3, None), (4, ""), (None, item)], "item_id long, text string")
    rows = [(10, f"Noise! {item.upper()}, noise."), (11, item.replace("brown", "brwn").replace("lazy", "lxzy")), (12, "the quick brown fox sleeps"), (10, f"x {item}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in D.leaks(docs, items).collect()) == [(10, 1, 0), (10, 1, 0), (11, 1, 2)]
    assert [r["doc_id"] for r in D.without_leaks(docs, items).collect()] == [12]
    kept = D.without_leaks(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() and D.leaks(odd, items.limit(0)).collect() == []
    assert D.without_leaks(empty(spark), items).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), max_size=12))
def test_packing_plan(counts):
    made = packing.plan(counts, 30)
    got: dict[int, int] = {}
    for what, times in made:
        assert times > 0 and sum(s * n for s, n in what) <= 30
        for s, n in what:
            got[s] = got.get(s, 0) + n * times
    assert got == counts


def test_dominance_is_optimal_on_small_cases():
    from functools import cache
    from itertools import combinations
    from random import Random

    @cache
    def fewest(sizes):
        if not sizes:
            return 0
        first, rest, best = sizes[0], sizes[1:], len(sizes)
        for r in range(len(rest) + 1):
            for chosen in combinations(range(len(rest)), r):
                if first + sum(rest[i] for i in chosen) <= 12:
                    best = min(best, 1 + fewest(tuple(s for i, s in enumerate(rest) if i not in chosen)))
        return best

    random = Random(3)
    for _ in range(60):
        sizes = tuple(sorted((random.randint(1, 12) for _ in range(random.randint(1, 7))), reverse=True))
        h = np.bincount(sizes, minlength=13)
        fixed, left = packing.reduce_dominated(h, 12)
        rest = tuple(int(s) for s in np.repeat(np.arange(13), left)[::-1])
        assert sum(t for _, t in fixed) + fewest(rest) == fewest(sizes)


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    docs = odd.unionByName(spark.createDataFrame([(50, "Hello, big WORLD. " * 3000), (51, "á İ <|endoftext|>, it's 12.")], "doc_id long, text string"), allowMissingColumns=True)
    got = packing.pack(docs).collect()
    plain = Tokenizer.from_file(packing.vocabulary_path())
    want = []
    for r in docs.collect():
        ids = np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r["doc_id"], k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    key = lambda t: tuple((v is None, v or 0) for v in t)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r["length"] for r in got) // 2048) + 1
    assert packing.pack(empty(spark)).collect() == []
