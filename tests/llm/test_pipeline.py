import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plangrove.llm import jaccard, queries
from plangrove.llm.common import table


def test_queries_are_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names)


@pytest.fixture(scope="module")
def larger():
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    return "/root/testdata/sf0.01"


def test_stages_keep_columns_and_act(spark, larger):
    sf_dir = larger
    docs = table(spark, sf_dir, "documents")
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf_dir).cache()
        if name != "bpe":
            assert after.columns == docs.columns
            assert after.join(docs, "doc_id", "left_anti").count() == 0
        kept.append(after.count())
        docs = after
    assert kept == sorted(kept, reverse=True) and kept[-1] == kept[-2]
    assert kept[0] > kept[1] > kept[2] > kept[3]
    assert len(corpus_pipeline.STAGES) == 5


def test_near_duplicate_stage_is_idempotent(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    once = corpus_pipeline.one_of_each(spark, docs, sf_dir).cache()
    groups = jaccard.join(docs)
    assert once.count() == groups.select("component_id").distinct().count()
    assert once.where("doc_id is null").count() == 0


def test_near_duplicate_stage_joins_each_link_once(spark, sf_dir, monkeypatch):
    """Near copies that take several rounds: the stage hands every link to the components in one round only, and keeps one document a component."""
    import random

    from .test_pairs_and_layout import brute_components

    handed, components = [], jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda links, *rest: (handed.append([tuple(x) for x in links.collect()]), components(links, *rest))[1])
    r, rows = random.Random(9), []
    for k in range(80):
        t = [f"b{i}" for i in range(120)]
        for i in r.sample(range(120), r.choice([1, 2, 3, 4])):
            t[i] = f"x{r.randrange(10**6)}"
        rows.append((k, " ".join(t)))
    kept = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()
    assert sorted(x.doc_id for x in kept) == sorted({x[2] for x in brute_components(rows)})
    every = [x for links in handed for x in links]
    assert len(handed) > 1 and len(every) == len(set(every)) > 0


def test_near_duplicate_stage_sends_sets_not_pairs(spark, sf_dir, monkeypatch):
    """Near copies with many pairs beside rows of their own: the stage writes the texts in pairs only, and sends each once a group."""
    import random

    r = random.Random(2)
    texts = [" ".join(r.choice(["p", "q"]) + str(j) if j % 12 == 0 else f"b{j}" for j in range(120)) for _ in range(24)] + [f"row {k} with words of its own" for k in range(60)]
    sent, write = {}, jaccard.materialise
    monkeypatch.setattr(jaccard, "materialise", lambda df, name: (t := write(df, name), sent.setdefault(name, t))[0])
    kept = corpus_pipeline.one_of_each(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), sf_dir)
    from .test_pairs_and_layout import brute_components

    assert sorted(x.doc_id for x in kept.collect()) == sorted({x[2] for x in brute_components(list(enumerate(texts)))})
    assert sent["jaccard-whole"].count() == len(set(texts[:24])) <= sent["jaccard-need-0"].count() < 2 * 24


def test_run_against_brute_force(spark, sf_dir):
    """Each stage redone in plain Python, with the models that the stages fit."""
    import hashlib

    import numpy as np
    from tokenizers import Tokenizer

    from plangrove.llm import quality, toxicity

    from .test_pairs_and_layout import brute_components
    from .test_text_operators import brute_decontam

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = quality.train(docs, labels)
    rows = {i: t for i, t in rows.items() if good.score(np.array([quality.features(t.encode())]))[0] >= quality.THRESHOLD}
    kept = docs.where(docs["doc_id"].isin(list(rows)))
    rude = toxicity.train(kept, labels)
    rows = {i: t for i, t in rows.items() if rude.above(t.encode())[0] < toxicity.THRESHOLD}
    rows = {i: rows[i] for i, _, least in brute_components(sorted(rows.items())) if i == least}
    items = [(str(r.item_id), r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    rows = {i: t for i, t in rows.items() if not brute_decontam(t, items)[4]}
    library = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    want = []
    for i, t in sorted(rows.items()):
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == want
    assert 0 < len(want) < docs.count()


def test_near_duplicate_stage_takes_rows_not_ids(spark):
    words = lambda tag, n=30: " ".join(f"{tag}{k}" for k in range(n))
    rows = [
        (None, words("a")),
        (None, words("b")),
        (None, words("b") + " more"),
        (1, words("c")),
        (1, words("d")),
        (1, words("d")),
        (2, words("d") + " more"),
        (3, words("e")),
        (None, words("e")),
        (4, ""),
        (4, None),
        (5, ""),
        (None, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, docs, "").collect()]
    b = [t for i, t in kept if i is None and t.startswith("b")]
    assert len(b) == 1 and b[0] in (words("b"), words("b") + " more")
    want = [(None, words("a")), (None, b[0]), (1, words("c")), (1, words("d")), (3, words("e")), (4, ""), (4, None), (5, ""), (None, "")]
    assert sorted(kept, key=repr) == sorted(want, key=repr)


def test_shuffle_files_go_with_the_table_they_were_written_for(spark):
    import time

    from plangrove.llm.common import materialise

    held = lambda: {f.getPath() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = held()
    rows = spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).count()
    assert materialise(rows, "test-clean", clean=True).count() == 5000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    for _ in range(50):
        left = {f for f in held() - before if f.endswith(".data")}
        if len(left) <= 1:  # at most that of the count
            break
        time.sleep(0.1)
    assert len(left) <= 1
