"""Operators on whole corpora against brute force: line dedup, near duplicates, top-k, shards, pipeline."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from partita.llm import linededup as L
from partita.llm import sharding, simhash, topk
from partita.llm.components import components
from partita.llm.shared import COPIES, Scratch, ranked_in

from .test_text_operators import empty, odd  # noqa: F401


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def unions(n, pairs):
    p = list(range(n))

    def find(a):
        while p[a] != a:
            a = p[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


# --- line dedup ---


def dead_lines(rows, least):
    """Per distinct (id, text): which lines lie in a run of ``least`` words that stood somewhere before."""
    docs = sorted({(L.NO_ID if d is None else d, signed(xxhash.xxh64_intdigest(t.encode(), 42)), t) for d, t in rows if t is not None})
    first, out = {}, {}
    seqs = [[s for _, s in L.text_lines(t.encode())] for _, _, t in docs]
    for k, seq in enumerate(seqs):
        for i in range(len(seq)):
            for j in range(i + 1, len(seq) + 1):
                first.setdefault(tuple(seq[i:j]), (k, i))
    for k, seq in enumerate(seqs):
        dead = [False] * len(seq)
        for i in range(len(seq)):
            for j in range(i + 1, len(seq) + 1):
                if sum(len(s.split()) for s in seq[i:j]) >= least and first[tuple(seq[i:j])] < (k, i):
                    dead[i:j] = [True] * (j - i)
        out[docs[k][0], docs[k][2]] = dead
    return out


def cut(text, dead):
    number, lines, gone, k = [n for n, _ in L.text_lines(text.encode())], text.split("\n"), set(), 0
    while k < len(dead):
        if dead[k]:
            e = k
            while e + 1 < len(dead) and dead[e + 1]:
                e += 1
            gone |= set(range(number[k], number[e] + 1))
            k = e
        k += 1
    return "\n".join(s for n, s in enumerate(lines) if n not in gone), len(gone)


@pytest.mark.parametrize("least", [1, 3, 9])
def test_line_dedup_against_all_runs(spark, least):
    r = random.Random(least)
    rows = [(r.choice([d, None]), "\n".join(" ".join(r.choice("ab") for _ in range(r.randint(0, 3))) for _ in range(r.randint(0, 12)))) for d in range(40)]
    rows += rows[:4] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "doc_id as hash", "text as first")
    got = L.dedup_lines(docs, least).collect()
    assert len(got) == len(rows)
    dead = dead_lines(rows, least)
    for x in got:
        if x["first"] is None:
            assert x["text"] is None and x["removed"] == [] and x["n_lines"] == 0
            continue
        text, n = cut(x["first"], dead[L.NO_ID if x["doc_id"] is None else x["doc_id"], x["first"]])
        assert x["text"] == text and sum(s["count"] for s in x["removed"]) == n and x["n_lines"] == x["first"].count("\n") + 1


def test_passages_and_boilerplate(spark, odd):  # noqa: F811
    passage = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) for i in range(6))
    docs = spark.createDataFrame([(1, f"own line one here\n{passage}"), (2, f"{passage}\nown line two here"), (3, "nothing shared at all")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in L.dedup_lines(docs).collect()}
    assert got[1]["text"].endswith(passage) and got[2]["text"] == "own line two here" and got[3]["text"] == "nothing shared at all"
    assert [tuple(s) for s in got[2]["removed"]] == [(0, 6)]
    out = L.dedup_lines(odd)
    assert set(odd.columns) < set(out.columns) and out.count() == odd.count()
    assert L.dedup_lines(empty(spark)).collect() == []


# --- near duplicates ---


def test_fingerprint_by_definition():
    for text in ("", " \t\n", "One", "a b", "A b C", "the cat the cat the cat", "x " * 50 + "é Ü"):
        words = "".join(c.lower() if c.isascii() else c for c in text).split()
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))
        assert simhash.fingerprint(text.encode()) == want
    assert simhash.fingerprint(None) == 0


def near_prints(seed, bits):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(z) for z in set(rng.integers(0, 64, rng.integers(0, 2 + bits))))) for b in base for _ in range(20)]
    return np.unique(np.array(near, np.uint64))


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_index_links_against_all_pairs(bits, monkeypatch):
    monkeypatch.setattr(simhash, "WALKED", 64)
    fps = near_prints(bits, bits)
    rank = (simhash.gray_rank(fps) ^ np.uint64(1 << 63)).view(np.int64)
    order = np.argsort(rank)
    fps, rank = fps[order], rank[order]
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits
    # the walk finds each pair from a place on, and no other
    start = np.arange(len(fps)) * 2 % len(fps)
    q, at = simhash.Tree(fps).walk(fps, start, bits)
    assert sorted(zip(q.tolist(), at.tolist(), strict=True)) == [(i, j) for i, j in zip(*np.nonzero(close), strict=True) if j >= start[i]]
    # a leaf of some, met by all
    for some in (np.arange(len(fps)), np.arange(len(fps) // 3, len(fps))):
        leaf = simhash.Leaf(fps[some], rank[some], bits)
        u, v = leaf.meet(fps, rank)
        a, b = leaf.joined()
        got = [(int(i), int(some[j])) for i, j in zip(u, v, strict=True)] + [(int(some[i]), int(some[j])) for i, j in zip(a, b, strict=True)]
        want = [(i, j) for i, j in zip(*np.nonzero(close), strict=True) if j in some and (i in some or i < some[0])]
        assert unions(len(fps), got) == unions(len(fps), want) and len(got) <= len(fps)


def test_groups_are_left_by_accumulated_differences():
    rng = np.random.default_rng(11)
    fps = np.unique(rng.integers(0, 2**64, 20_000, dtype=np.uint64))
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    tree = simhash.Tree(fps)
    for (pattern, mask), (above, over) in zip(tree.levels, tree.levels[1:], strict=False):
        group = np.arange(len(pattern)) // simhash.FAN
        assert (over[group] & ~mask == 0).all() and ((pattern ^ above[group]) & over[group] == 0).all()
    tree.walk(fps[:500], np.zeros(500, np.int64), 3)
    print("visits a fingerprint:", tree.visits / 500, "of", len(fps))
    assert tree.visits / 500 < len(fps) / 3


def test_sketch_estimates_similarity():
    words = [f"w{i}" for i in range(3000)]
    for cut in (0, 300, 1000):
        a, b = " ".join(words[:2000]).encode(), " ".join(words[cut : 2000 + cut]).encode()
        sa, sb = (np.frombuffer(simhash.sketch(t), np.uint64)[None, :] for t in (a, b))
        j = (1996 - cut) / (1996 + cut)
        assert abs(simhash.differing(sa, sb)[0] - 128 * (1 - j) * 15 / 16) <= 18
    assert simhash.sketch(None) == simhash.sketch(b" \n") == bytes(64) and len(simhash.sketch(b"one")) == 64


@pytest.mark.parametrize("leaf, comers", [(8, 4), (16, 1 << 16), (1 << 15, 7)])
def test_links_over_leaves(spark, leaf, comers):
    rng = np.random.default_rng(leaf)
    base = int(rng.integers(0, 2**63))
    fps = sorted({base ^ sum(1 << int(z) for z in set(rng.integers(0, 64, 3))) for _ in range(60)} | {int(x) for x in rng.integers(0, 2**63, 20)} | {int(x) for x in near_prints(leaf, 3)})
    nodes = spark.createDataFrame([(signed(f), signed(f)) for f in fps], "node long, fp long")
    at = {signed(f): i for i, f in enumerate(fps)}
    got = [(at[r["u"]], at[r["v"]]) for r in simhash.links(nodes, Scratch(spark), leaf=leaf, comers=comers).collect()]
    want = [(i, j) for i, a in enumerate(fps) for j, b in enumerate(fps) if (a ^ b).bit_count() <= 3]
    assert unions(len(fps), got) == unions(len(fps), want)
    assert simhash.links(nodes.limit(0), Scratch(spark)).collect() == []


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(50)] + [(5, 5), (3, 9), (9, 3)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame([*pairs, (None, 1)], "u long, v long"), Scratch(spark)).collect()}
    want = unions(400, pairs)
    assert got == {i: want[i] for p in pairs if p[0] != p[1] for i in p}
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark)).collect() == []


def test_near_duplicates(spark, odd):  # noqa: F811
    r = random.Random(7)
    texts = [" ".join(r.choice(["red", "green", "blue", "sky", "sea"]) for _ in range(r.randint(0, 9))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = [simhash.fingerprint(t.encode()) for t in texts]
    want = unions(150, [(i, j) for i in range(150) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    got = {x["doc_id"]: x for x in simhash.near_duplicates(docs).collect()}
    assert [got[i]["component_id"] for i in range(150)] == want and [got[i]["fp"] & (1 << 64) - 1 for i in range(150)] == fps
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == odd.count() and {x["component_id"] for x in out if x["fp"] == 0} == {0}
    assert simhash.near_duplicates(empty(spark)).collect() == []


def test_one_of_each(spark, odd):  # noqa: F811
    r = random.Random(8)
    base = [[f"w{r.randint(0, 5000)}" for _ in range(400)] for _ in range(20)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    rows += [(100 + i, " ".join([*w[:200], "new", *w[201:]])) for i, w in enumerate(base[:10])] + [(3, " ".join(base[3])), (200, " ".join(base[4]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as node", "text as second")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == list(range(20))
    some = simhash.one_of_each(odd).collect()
    assert Counter(x["text"] for x in some)["a"] == 1 and len(some) < odd.count()
    assert simhash.one_of_each(empty(spark)).collect() == []


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("tile", [8, 1024])
def test_one_of_each_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "SETS", tile, raising=False)
    r = random.Random(9)
    texts = []
    for k in range(90):
        words = [f"w{r.randint(0, 9999)}" for _ in range(r.randint(100, 400))]
        n = len(words) - 4
        more = int(n / (0.7 + 0.3 * k / 90)) - n  # appended text, for similarities from 0.7 to 1
        texts += [words, words + [f"n{r.randint(0, 9999)}" for _ in range(more)]]
    words = [f"v{i}" for i in range(300)]
    texts += [words[:i] + [f"x{i}"] + words[i + 1 :] for i in range(10, 290, 9)]  # a group larger than a tile
    texts = [" ".join(w) for w in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = [(i, j) for i, a in enumerate(texts) for j in range(i) if jaccard(a, texts[j]) >= 0.8]
    want = unions(len(texts), near)
    assert 40 < sum(want[i] != i for i in range(180)) < 80
    assert sorted(x["doc_id"] for x in simhash.one_of_each(docs).collect()) == sorted(set(want))


# --- top-k ---


def test_top_k_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 7)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    r = random.Random(5)
    rows = [(i, [r.choice([-1.0, -0.25, 0.0, 0.5, 1.0]) for _ in range(6)]) for i in range(120)]
    rows += [(120, None), (121, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (122, [float("nan")] * 6), (123, [float("inf")] * 6), (None, [1.0] * 6), (124, [1.0] * 5), (150, []), rows[7]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as x", "2 as rank")
    v = topk.quantised(table)
    got: dict = {}
    for x in topk.top_k(v.where("vec_id % 10 = 0"), v, 4).orderBy("query_id", "rank").collect():
        assert x["rank"] == len(got.setdefault(x["query_id"], [])) + 1
        got[x["query_id"]].append((x["vec_id"], x["score"]))
    q = {i: [int(np.floor(256 * c)) for c in e] for i, e in rows[:120]}
    for i in range(0, 120, 10):
        want = sorted(((sum(a * b for a, b in zip(q[i], w, strict=True)), j) for j, w in q.items() if j != i), key=lambda s: (-s[0], s[1]))[:4]
        assert got[i] == [(j, s) for s, j in want]
    assert set(got) == set(range(0, 120, 10))
    assert topk.top_k(v.limit(0), v, 4).collect() == [] and topk.top_k(v.where("vec_id = 10"), v.where("vec_id in (10, 11)"), 4).count() == 1


# --- shards ---


def test_shards(spark, odd):  # noqa: F811
    rows = [(i, f"text {i}", "hot" if i % 3 else f"s{i % 7}") for i in range(1000)] + [(5, "text 5", "hot")] * 40 + [(None, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as rank", "2 as place", "3 as of")
    got = sharding.stratified_shards(docs).collect()
    assert Counter((x["doc_id"], x["size"]) for x in got) == Counter((d, 1 + len((t or "").encode())) for d, t, _ in rows)
    n = Counter(x["shard"] for x in got)
    assert set(n) == set(range(8)) and max(n.values()) - min(n.values()) <= 1
    for s in range(8):
        assert sorted(x["slot"] for x in got if x["shard"] == s) == list(range(n[s]))
    of = Counter(s for _, _, s in rows)
    for (s, source), c in Counter((x["shard"], x["source"]) for x in got).items():
        assert abs(c - of[source] / 8) <= 2, (s, source)
    # the order is that of fractional ranks within seeded shuffles
    order = sorted(got, key=lambda x: (x["shard"], x["slot"]))
    assert all(a["fraction"] <= b["fraction"] + 1e-12 for a, b in zip(order, order[1:], strict=False))
    assert len(sharding.stratified_shards(odd.selectExpr("*", "text as source")).collect()) == odd.count()
    assert sharding.stratified_shards(empty(spark).selectExpr("*", "text as source")).collect() == []


def test_equal_rows_are_counted_and_dealt_out(spark):
    n = COPIES * 2 + 5
    rows = [(None, None, 0)] * n + [(i % 50, i, 0) for i in range(500)] + [(7, 7, 0)] * 9
    docs = spark.createDataFrame(rows, "mix long, more long, all int")
    made = ranked_in(docs, "all", ["mix"], F.coalesce(F.col("mix"), F.lit(-1)), "rank", copies=True)
    got = sorted(made.collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(len(rows))) and Counter(map(tuple, (r[:3] for r in got))) == Counter(rows)
    assert [-1 if r["mix"] is None else r["mix"] for r in got] == sorted(-1 if r[0] is None else r[0] for r in rows)
    assert max(made.select(F.spark_partition_id().alias("p")).groupBy("p").count().toPandas()["count"]) < n


def test_shards_use_no_python(spark, smallest):
    plan = sharding.op6_stratified_shards(spark, smallest)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- pipeline ---


def test_pipeline(spark, smallest):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    scratch, columns, counts = Scratch(spark), docs.columns, [docs.count()]
    for name, stage in C.STAGES:
        docs = scratch.write(stage(spark, docs, smallest), name)
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2] and counts[4] < counts[3]
    assert C.run(spark, smallest).count() == counts[5]


def test_pipeline_on_odd_rows(spark, odd, tmp_path):  # noqa: F811
    """Nulls, empty and long texts, repeated rows, and columns named like those that the stages make."""
    import corpus_pipeline as C

    r = random.Random(12)
    rows = [(i, " ".join(f"w{r.randint(0, 3000)}" for _ in range(60)) + ".") for i in range(100, 130)]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    docs = odd.unionByName(more, allowMissingColumns=True).selectExpr("*", "1 as removed", "2 as n_lines", "3L as n_chars", "'s' as source", "'en' as lang", "4 as bucket", "5 as fp", "6 as _id")
    item = rows[3][1][:200]
    for name, df in (
        ("documents", docs), ("labels", spark.createDataFrame([(i, 1, 0) for i in range(100, 130)], "doc_id long, quality int, toxic int")),
        ("benchmark", spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")),
    ):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    here, scratch = spark.read.parquet(f"{tmp_path}/documents.parquet"), Scratch(spark)
    for name, stage in C.STAGES:
        out = scratch.write(stage(spark, here, str(tmp_path)), name)
        assert name == "packing" or out.schema.simpleString() == docs.schema.simpleString()
        kept = {x["doc_id"] for x in out.collect()}
        assert kept >= set(range(100, 130)) - ({103} if name in ("decontaminate", "packing") else set())
        if name == "line_dedup":
            assert all(x["n_chars"] == len(x["text"]) for x in out.where("text is not null").collect()) and {x["removed"] for x in out.collect()} == {1}
        if name == "near_dedup":
            assert Counter(x["text"] for x in out.collect()).most_common(1)[0][1] == 1
        here = out
    assert 103 not in kept
    empty_dir = tmp_path / "empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{empty_dir}/{name}.parquet")
    assert C.run(spark, str(empty_dir)).collect() == []


def test_every_query_runs(spark, smallest):
    from partita.llm import registry

    for name, query in registry.queries().items():
        df = query(spark, smallest)
        assert len(df.columns) == len(set(df.columns)) and df.count() >= 0, name
