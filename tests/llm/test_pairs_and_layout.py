import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plangrove.llm import jaccard, sharding, topk

from .common import AWKWARD, empty, frame


def brute_components(rows):
    import re

    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted(((d, len(s), min((x for x in groups[find(i)] if x is not None), default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(seed, n_base=12, copies=14):
    r = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(300)]
    passage = [r.choice(vocabulary) for _ in range(40)]
    rows = []
    for b in range(n_base):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 6, 12, 60, 150]))]
        if b % 3 == 0:
            base += passage
        for _ in range(r.randint(1, copies)):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
                k = r.randrange(len(t))
                if r.random() < 0.5:
                    t[k] = r.choice(vocabulary)
                else:
                    t[k:k] = [r.choice(vocabulary) for _ in range(r.randint(1, 3))]
            if r.random() < 0.2:
                t = t[: max(1, int(len(t) * 0.85))]
            rows.append((len(rows), r.choice([" ", "\n", "\t "]).join(w.upper() if r.random() < 0.1 else w for w in t)))
    return rows


@pytest.mark.parametrize("seed,leaf", [(1, 24), (2, 3), (3, 2)])
def test_jaccard_against_brute_force(spark, seed, leaf):
    rows = corpus(seed)
    got = sorted((tuple(r) for r in jaccard.join(frame(spark, rows), leaf=leaf).collect()), key=str)
    assert got == brute_components(rows)


def test_jaccard_spreads_giant_regions(spark, monkeypatch):
    # a common passage and clouds of near copies; every region of more than five sets counts as giant, in every round
    monkeypatch.setattr(jaccard, "GIANT", 5)
    r = random.Random(12)
    word = lambda: f"w{r.randint(0, 4000)}"
    passage, rows = [word() for _ in range(12)], []
    for c in range(3):
        base = [word() for _ in range(60)]
        for k in range(30):
            t = list(base)
            for _ in range(r.randint(0, 5)):
                t[r.randrange(len(t))] = word()
            rows.append((100 * c + k, " ".join(t)))
    rows += [(1000 + k, " ".join(passage + [word() for _ in range(r.randint(1, 40))])) for k in range(60)]
    r.shuffle(rows)
    got = sorted((tuple(x) for x in jaccard.join(frame(spark, rows), leaf=4).collect()), key=str)
    assert got == brute_components(rows)


def test_jaccard_measures_a_cluster_along_a_star(spark, monkeypatch):
    """A cluster of m sets is measured with about m pairs, not with m * m / 2 that each bring a whole set along; a chain of copies stays one component."""
    counts, measure = [], jaccard._measure
    monkeypatch.setattr(jaccard, "_measure", lambda sets, pairs, turn: (counts.append(pairs.count()), measure(sets, pairs, turn))[1])
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(base[:-1] + [f"own{k}"])) for k in range(50)]
    chain = [f"c{k}" for k in range(300)]
    rows += [(100 + k, " ".join(chain[12 * k : 12 * k + 150])) for k in range(10)]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute_components(rows)
    assert sum(counts) < 150


def test_jaccard_sends_a_set_once_not_once_a_pair(spark, monkeypatch):
    """40 sets of one family have 780 pairs; each set goes to its pairs once, or, cut into small parts, once for each part it meets; other rows of the corpus are not sent at all."""
    r = random.Random(3)
    texts = [" ".join(r.choice(["p", "q", "r"]) + str(j) for j in range(60)) for _ in range(40)] + [f"other {k} text of its own" for k in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {jaccard._keys(s)[0]: s for s in jaccard.shingle_sets([t.encode() for t in texts[:40]])}
    keys = sorted(sets)
    pairs = spark.createDataFrame([(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :]], "a long, b long")
    classes = spark.createDataFrame([(k, 0, len(sets[k]), i) for i, k in enumerate(jaccard._keys(s)[0] for s in jaccard.shingle_sets([t.encode() for t in texts[:40]]))], "key long, key2 long, n long, rep long")
    tables, write = {}, jaccard.materialise
    monkeypatch.setattr(jaccard, "materialise", lambda df, name: tables.setdefault(name, write(df, name)))
    whole = jaccard._whole_sets(docs, classes, pairs, jaccard.WORDS)
    assert tables["jaccard-whole"].count() == 40
    assert jaccard._sifted(docs, "doc_id", classes.select("rep")).count() < 60
    for turn, part in enumerate((1 << 18, 300)):
        monkeypatch.setattr(jaccard, "PART", part)
        got = {(a, b): (round(d, 9), link) for a, b, d, link in jaccard._measure(whole, pairs, turn).collect()}
        tables.pop("jaccard-families")
        shared = {p: len(np.intersect1d(sets[p[0]], sets[p[1]])) for p in got}
        assert len(got) == 780
        assert got == {(a, b): (round(1 - i / (u := len(sets[a]) + len(sets[b]) - i), 9), 100 * i >= 80 * u) for (a, b), i in shared.items()}
    assert tables["jaccard-need-0"].count() == 40
    assert 40 < tables["jaccard-need-1"].count() < 780


def join_rows(spark, run):
    """The rows that all joins make while ``run`` runs."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    made, runs = 0, store.executionsList()
    for k in range(before, runs.size()):
        run_id = runs.apply(k).executionId()
        values, nodes = store.executionMetrics(run_id), store.planGraph(run_id).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for metric in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if "Join" in node.name() and metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    made += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return made


def test_components_meet_each_link_once(spark):
    """A cluster's links are joined once, not once a turn, and links inside what is already one component go no further."""
    links = spark.createDataFrame([(hub, v) for hub in range(3) for v in range(3, 303)], "a long, b long")
    more = spark.createDataFrame([(3, v) for v in range(4, 303)] + [(400, 500), (302, 500)], "a long, b long")
    found = []
    assert 0 < join_rows(spark, lambda: found.append(jaccard.components(links))) < 2 * 900
    assert {tuple(x) for x in found[0].collect()} == {(v, 0) for v in range(303)}
    assert 0 < join_rows(spark, lambda: found.append(jaccard.components(more, start=found[0]))) < 4 * 306
    assert {tuple(x) for x in found[1].collect()} == {(v, 0) for v in [*range(303), 400, 500]}


def test_components_against_brute_force(spark):
    r = random.Random(5)
    for edges in ([(k, k + 1) for k in range(100)], [(r.randrange(60), r.randrange(60)) for _ in range(40)], [(7, 7)], []):
        r.shuffle(edges)
        least = {v: v for a, b in edges if a != b for v in (a, b)}
        for _ in edges:
            for a, b in edges:
                if a != b:
                    least[a] = least[b] = min(least[a], least[b])
        cut = len(edges) // 2
        parts = [spark.createDataFrame(e, "a long, b long") for e in (edges[:cut], edges[cut:])]
        assert sorted(map(tuple, jaccard.components(parts[1], start=jaccard.components(parts[0])).collect())) == sorted(least.items())


def test_jaccard_hands_each_link_to_components_once(spark, monkeypatch):
    """Every turn adds its own links to the components so far; it does not begin again with those of all turns."""
    handed, components = [], jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda links, *rest: (handed.append([tuple(x) for x in links.collect()]), components(links, *rest))[1])
    r = random.Random(9)
    rows = []
    for k in range(60):
        t = [f"b{i}" for i in range(120)]
        for i in r.sample(range(120), r.choice([1, 2, 3, 4])):
            t[i] = f"x{r.randrange(10**6)}"
        rows.append((k, " ".join(t)))
    got = sorted((tuple(x) for x in jaccard.join(frame(spark, rows), leaf=4).collect()), key=str)
    assert got == brute_components(rows)
    every = [x for links in handed for x in links]
    assert len(handed) > 1 and len(every) == len(set(every)) > 0


def test_jaccard_resists_the_center_of_a_cloud(spark):
    # many variants of one text that lie beyond the limit from each other, but for chains among some
    r = random.Random(9)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for _ in range(60):
        t = list(base)
        for k in r.sample(range(120), r.choice([1, 2, 3, 4])):
            t[k] = f"x{r.randrange(10**6)}"
        rows.append((len(rows), " ".join(t)))
    got = sorted((tuple(x) for x in jaccard.join(frame(spark, rows), leaf=4).collect()), key=str)
    assert got == brute_components(rows)


def test_jaccard_awkward(spark):
    got = sorted((tuple(r) for r in jaccard.join(frame(spark)).collect()), key=str)
    assert got == brute_components(AWKWARD)
    assert jaccard.join(empty(spark)).count() == 0
    only_empty = frame(spark, [(1, ""), (2, ""), (3, None)])
    assert sorted(tuple(r) for r in jaccard.join(only_empty).collect()) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_jaccard_at_the_limit(spark):
    # 8 shared of 10 in the union links, 8 of 11 does not
    w = [f"w{k}" for k in range(12)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:11], "q"])), (3, " ".join([*w, "r", "s", "t"]))]
    assert sorted((tuple(r) for r in jaccard.join(frame(spark, rows)).collect()), key=str) == brute_components(rows)


def test_best_fit_decreasing():
    r = random.Random(2)
    for _ in range(40):
        sizes = [r.randint(1, 50) for _ in range(r.randint(1, 80))]
        capacity = r.randint(50, 90)
        free, want = [], []
        for s in sorted(sizes, reverse=True):  # one by one
            fit = [k for k in range(len(free)) if free[k] >= s]
            k = min(fit, key=lambda k: (free[k], k)) if fit else len(free)
            if not fit:
                free.append(capacity)
            free[k] -= s
            want.append((s, k))
        classes = {}
        for s in sizes:
            classes[s] = classes.get(s, 0) + 1
        runs, bins = sharding.best_fit_decreasing(list(classes.items()), capacity)
        assert bins == len(free)
        assert sorted((s, k) for s, k, n in runs for _ in range(n)) == sorted(want)
    with pytest.raises(ValueError):
        sharding.best_fit_decreasing([(10, 1)], 5)


def test_shards(spark):
    r = random.Random(4)
    rows = [(i, "x" * r.randint(0, 300)) for i in range(500)] + [(900 + i, "hot " * 30) for i in range(120)] + [(1000, None), (1001, ""), (1002, None), (7, "x")]
    got = sharding.shard(frame(spark, rows), shards=8).collect()
    assert len(got) == len(rows)
    by = {}
    for g in got:
        by.setdefault(g.shard, []).append(g)
    for members in by.values():
        assert sorted(m.slot for m in members) == list(range(len(members)))
    shard_of = {}
    text = {(i, len((t or "").encode()) + 16): t or "" for i, t in rows}
    for g in got:
        assert shard_of.setdefault(text[g.doc_id, g.size], g.shard) == g.shard
    sizes = [sum(m.size for m in v) for v in by.values()]
    assert max(sizes) - min(sizes) < 400 or max(sizes) == 120 * (120 + 16)
    assert sharding.shard(empty(spark), shards=8).count() == 0
    assert sharding.shard(frame(spark), shards=3).count() == len(AWKWARD)


def test_topk_against_brute_force(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(400, 16)).astype(np.float32)
    x[100:200] = x[100]
    rows = [(i, [float(c) for c in x[i]], 0) for i in range(400)]
    rows += [(1000, None, 0), (1050, [float("nan")] * 16, 0), (1100, [1.0, None] * 8, 0), (1150, [float("inf")] * 16, 0), (None, [1.0] * 16, 0), (1200, [1.0, 2.0], 0), (1250, [], 0), (50, rows[50][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = sorted((g.query_id, g.rank, g.vec_id, g.score) for g in topk.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=90, leaf=8).collect())
    q = np.floor(x.astype(np.float64) * 256).astype(np.int64)
    want = []
    for i in range(0, 400, 50):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(400) if j != i)[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    few = topk.top_k(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 50 == 0).collect()
    assert len(few) == 2
    huge = spark.createDataFrame([(0, [3e6, 1.0]), (1, [2e6, 5.0]), (2, [-2e6, 1.0])], "vec_id long, embedding array<double>")
    assert [(g.vec_id, g.score) for g in topk.top_k(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 65536 * 6000000000000 + 65536 * 5), (2, -65536 * 6000000000000 + 65536)]


def test_topk_sends_blocks_to_few_shards(spark, monkeypatch):
    r = np.random.default_rng(9)
    middles = r.normal(0, 1, (120, 8))
    middles /= np.linalg.norm(middles, axis=1, keepdims=True)
    x = np.repeat(middles, 40, 0) * 4 + r.normal(0, 0.02, (4800, 8))
    order = r.permutation(len(x))
    df = spark.createDataFrame([(i, [float(v) for v in x[k]]) for i, k in enumerate(order)], "vec_id long, embedding array<double>")
    sent, write = {}, topk.materialise

    def noted(frame, name):
        out = write(frame, name)
        sent[name] = out.count() if name.endswith(("sent", "trees", "blocks")) else 0
        return out

    monkeypatch.setattr(topk, "materialise", noted)
    got = {}
    for g in topk.top_k(df, F.col("vec_id") % 50 == 0, k=3, shard_rows=40, leaf=8).collect():
        got.setdefault(g.query_id, []).append((g.rank, g.vec_id, g.score))
    ints = np.floor(x[order] * 256).astype(np.int64)
    for q, rows in got.items():
        score = ints @ ints[q]
        score[q] = -(1 << 60)
        best = np.lexsort((np.arange(len(score)), -score))[:3]
        assert sorted(rows) == [(k + 1, int(i), int(score[i])) for k, i in enumerate(best)]
    assert len(got) == 96 and sent["topk-trees"] > 100
    assert sent["topk-rest-sent"] < 0.1 * sent["topk-trees"] * sent["topk-blocks"]
