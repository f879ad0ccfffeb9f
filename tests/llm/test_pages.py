"""Template deduction: classes against brute force, layouts without telling names, hostile pages."""

import random
import time
from collections import Counter, defaultdict

import pytest

from partita.llm import mainhtml as M
from partita.llm.shared import Scratch

WORDS = "river stone light paper green window answer morning letter garden number silver music market island".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n)) + "."


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def texts(spark, rows):
    return {x["page_id"]: x["text"] for x in M.main_text(frame(spark, rows)).collect()}


def brute_classes(pages):
    """Element tokens with equal occurrence vectors on enough pages, by all pages' counts in memory; the valid ones."""
    counts = [Counter(p.token for p in page if p.mark != M.TEXT) for page in pages]
    first = [{} for _ in pages]
    for k, page in enumerate(pages):
        for at, p in enumerate(page):
            first[k].setdefault(p.token, at)
    by = defaultdict(list)
    for t in set().union(*counts):
        v = tuple(c[t] for c in counts)
        n = sum(x > 0 for x in v)
        if n >= M.LEAST_PAGES and n >= M.LEAST_SHARE * len(pages):
            by[v].append(t)
    made = {v: ts for v, ts in by.items() if len(ts) > 1 or (max(v) == 1 and sum(x > 0 for x in v) >= M.ALONE_SHARE * len(pages))}
    valid = []
    for v, ts in made.items():
        orders, gaps, torn = set(), set(), False
        for k in range(len(pages)):
            if not v[k]:
                continue
            here = [w for w in made if w[k]]
            most = max((sum(x > 0 for x in w), len(made[w])) for w in here)
            root = [w for w in here if (sum(x > 0 for x in w), len(made[w])) == most]
            if len(root) > 1:
                return None  # which class is the root is left open
            places = sorted(first[k][t] for t in ts)
            orders.add(tuple(sorted(ts, key=first[k].get)))
            if v != root[0]:
                cut = [first[k][t] for t in made[root[0]]]
                ends = {sum(c < p for c in cut) for p in places}
                torn |= len(ends) > 1
                gaps |= ends
        if len(orders) == 1 and len(gaps) <= 1 and not torn:
            valid.append(frozenset(ts))
    return set(valid)


def test_classes_against_brute_force(spark):
    checked = 0
    for seed in range(8):
        r = random.Random(seed)
        rows = []
        for n in range(12):
            body = "".join(f"<div class='{c}'><h3>{prose(r, 2)}</h3>" + f"<p>{prose(r, 3)}</p>" * r.randint(0, 2) + "</div>" for c in r.sample("abcdef", 4) if r.random() < 0.8 or c < "c")
            rows.append((n, f"http://h{seed}.example/{n}", f"<html><body><nav><ul><li>x</ul></nav><section>{body}</section><div id='z'><span>q</span>{prose(r, 2)}</div></body></html>"))
        want = brute_classes([M.parse(h) for _, _, h in rows])
        if want is None:
            continue
        scratch = Scratch(spark)
        parsed = scratch.write(M._parsed(frame(spark, rows).selectExpr("split(url, '/')[2] as host", "page_id as page", "html")), "pages")
        made = M.valid_classes(parsed, scratch.write(M.classes(parsed), "classes")).collect()
        assert {frozenset(c["members"]) for c in made} == want
        for c in made:  # members come in page order
            for _, _, h in rows:
                first = {}
                for at, p in enumerate(M.parse(h)):
                    first.setdefault(p.token, at)
                at = [first[t] for t in c["members"] if t in first]
                assert at == sorted(at)
        checked += 1
    assert checked > 4


@pytest.mark.parametrize("wrap", ["<div class='c1'>{}</div>", "<table><tr><td>{}</td></tr></table>", "<div><div><div id='p{n}'>{}</div></div></div>"])
def test_slots_decide_without_telling_names(spark, wrap):
    """Menus, notes and letters in plain elements; only what the pages of the host hold tells them from the article."""
    r, rows, want = random.Random(4), [], {}
    for n in range(9):
        links = "".join(f"<li><a href='/{w}'>{w} {r.randint(0, 99)}</a>" for w in r.sample(WORDS, 5))
        paras = [prose(r, r.randint(20, 60)) for _ in range(r.randint(1, 5))]
        title = prose(r, 4)
        main = f"<h1>{title}</h1>" + "".join(f"<p>{p}" for p in paras)
        rows.append((n, f"http://plain.example/{n}", f"<body><div class='x1'><ul>{links}</ul></div><div class='x2'>Subscribe to the letter now</div>" + wrap.format(main, n=n) + f"<div class='x3'>{prose(r, 4)}</div><div class='x4'>All rights</div></body>"))
        want[n] = " ".join([title, *paras])
    assert texts(spark, rows) == want


def test_layouts_of_one_host(spark):
    """Two layouts on a host, a menu within the article's element, and pages of neither layout."""
    r, rows, want = random.Random(5), [], {}
    for n in range(20):
        p, t = [prose(r, 30) for _ in range(3)], prose(r, 3)
        menu = "".join(f"<li><a href='#'>{prose(r, 2)}</a></li>" for _ in range(6))
        if n % 2:
            h = f"<body><div class='top'>{prose(r, 3)}</div><main><h1>{t}</h1><div class='toc'><ul>{menu}</ul></div><p>{p[0]}</p><p>{p[1]}</p><p>{p[2]}</p></main></body>"
        else:
            h = f"<body><div class='left'><ul>{menu}</ul></div><article><h1>{t}</h1><section><p>{p[0]}</p><p>{p[1]}</p></section><section><p>{p[2]}</p></section></article><aside>{prose(r, 40)}</aside></body>"
        rows.append((n, f"http://two.example/{n}", h))
        want[n] = " ".join([t, *p])
    rows.append((50, "http://two.example/other", "<body><nav>menu</nav><div><p>Lone page.</p></div></body>"))
    want[50] = "Lone page."
    got = texts(spark, rows)
    assert {k: got[k] for k in want if k % 2 == 0} == {k: want[k] for k in want if k % 2 == 0}
    assert {k: got[k] for k in want if k % 2} == {k: want[k] for k in want if k % 2}


def test_text_on_half_of_the_pages_of_a_host_stays(spark):
    r = random.Random(6)
    paras = [prose(r, 12) for _ in range(10)]
    rows = [(n, f"http://half.example/{n}", f"<nav>m</nav><article><h1>t{n}</h1><p>{paras[n]}</p>" + ("<p>Licensed under CC BY 4.0.</p>" if n % 2 else "") + "<p>Every page</p></article>") for n in range(10)]
    got = texts(spark, rows)
    assert all(got[n] == f"t{n} {paras[n]}" + (" Licensed under CC BY 4.0." if n % 2 else "") for n in range(10))


def test_subjects_named_like_furniture_stay():
    page = """<article><p>Intro.</p><div class="related-work"><p>Body of the article.</p></div><div id="search-results-section"><p>Numbers.</p></div>
<section class="notice-of-meeting"><p>Agenda.</p></section></article>"""
    assert M.extract(page) == "Intro. Body of the article. Numbers. Agenda."


def test_deep_and_broken_pages():
    began = time.time()
    assert M.extract("<div>" * 60_000 + "deep" + "</div>" * 60_000) == "deep"
    assert M.extract("<div>" * 1000 + "</em></span>" * 20_000 + "</section>" * 20_000 + "text") == "text"
    assert M.extract("<p>a" + "</li></dd></x>" * 20_000 + "b") == "a b"
    assert M.extract("<" * 50_000) == "<" * 50_000 and M.extract("<a " * 20_000) is not None
    long = "<article>" + "".join(f"<p>word{n} " + "x" * 50 + "</p>" for n in range(30_000)) + "</article>"
    assert len(M.extract(long)) > 1_500_000
    assert time.time() - began < 30


def test_no_evidence_gives_no_template():
    assert M.choose([]) is None and M.choose([{"slot": 1, "owner": 5, "up": 0, "mark": 0, "chars": 0, "links": 0, "pages": 0, "texts": 0}]) is None


def test_an_empty_template_takes_the_whole_page():
    page = "<div>menu</div><p>text</p>"
    assert M.extract(page, M.Template(frozenset(), frozenset(), 0, frozenset([0]), frozenset())) == "menu text"
