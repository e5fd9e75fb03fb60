import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plangrove.llm import bpe, counts, decontam, lm, quality, rans, toxicity

from .common import AWKWARD, empty, frame

P = pytest.importorskip("public_tokenizers")
WORD, PIECE = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


HARD = [
    "", " ", "a", "a" * 3000, "ab" * 1500, "the" * 900, "1" * 50, "!" * 700, "don't we'll 's's", "<|endoftext|>", "<|ENDOFTEXT|>x", "\x1c\x1d", "é é ΣΑΣ İ ﬁ ½ नमस्ते 👩‍👩‍👧",
    "word. word, word! a.,b 0 00 x0 a0 0a", "\u0085 ,   .", "Mixed CASE <|startoftext|>tail",
]


def test_bpe_equals_the_library(library):
    own = bpe.loaded(WORD)
    for t in HARD:
        want = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want, t
        machine = bpe.TokenText(own)
        assert machine.feed(*want[:3]) + "".join(map(machine.feed, want[3:])) == library.decode(want, skip_special_tokens=False)


def test_bpe_random_words_and_streaming(library):
    import random

    own, r = bpe.loaded(WORD), random.Random(3)
    for _ in range(300):
        w = "".join(r.choice("aabehtinorssé'.1") for _ in range(r.randint(1, 400)))
        assert own.encode(w) == library.encode(w, add_special_tokens=False).ids
    vocabulary = [t.removesuffix("</w>") for t in own.ids]
    plain = [t for t in vocabulary if t.isascii() and t.isalpha() and t.islower()]
    long = "".join(r.choice(plain) for _ in range(20_000))
    assert own.word(long) == library.encode(long, add_special_tokens=False).ids
    # however a word is cut, and with nothing but the lookahead held back
    for size in (1, 7, 300):
        c = long[:3000] + bpe.MARK
        out = [i for ids in own.transduce(c[k : k + size] for k in range(0, len(c), size)) for i in ids]
        assert out == own.word(long[:3000])
    fed = 0

    def symbols():
        nonlocal fed
        for c in long:
            fed += 1
            yield c

    out = own.transduce(symbols())
    ends = 0
    for _ in range(200):
        ends += sum(len(own.names[i].removesuffix("</w>")) for i in next(out))
        assert fed - ends <= own.lookahead + own.longest


def test_bpe_refuses_improper_merges():
    with pytest.raises(ValueError):
        bpe.Bpe._check_proper([("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")])
    with pytest.raises(ValueError):
        bpe.Bpe._check_proper([("ab", "c"), ("a", "b")])


def test_caches_stay_small_on_unspaced_text(library):
    import random
    import tracemalloc

    r = random.Random(8)
    paragraph = lambda: "".join(chr(r.randint(0x4E00, 0x9F00)) for _ in range(120))
    own, cache, counter = bpe.loaded(WORD), bpe._cached(WORD), counts.Counter(counts.vocabulary(PIECE))
    tracemalloc.start()
    for k in range(2000):
        t = paragraph()
        (ids,) = cache.fetch([t.encode()])
        n = counter.count(t)
        if k < 20:
            assert list(ids) == library.encode(t, add_special_tokens=False).ids and n == counter.pieces("▁" + t)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 60e6 and not any(len(k) > 64 for k in [*cache.known.new, *counter.known.new])
    assert own.fit_limit and len(own._fit_ids) <= own.fit_limit + 1


def test_counts_in_a_ring():
    import tracemalloc

    counter = counts.Counter(counts.vocabulary(PIECE))
    text = "theandof日\U0001F9FF" * 60_000
    tracemalloc.start()
    n = counter.count(text)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 20e6 and n == counter.pieces("▁" + text)


def test_bpe_byte_decoder():
    own = bpe.loaded(WORD)
    machine = bpe.TokenText(own, joined=False)
    assert ("".join(map(machine.feed, own.encode("héllo wörld 日本"))) + machine.close()).split() == ["héllo", "wörld", "日本"]


def test_bpe_rows(spark, library):
    got = {(r.doc_id, r.text): r.b for r in bpe.encode_digests(frame(spark), WORD, out="b").collect()}
    for i, t in AWKWARD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        b = got[i, t]
        assert b.n_tokens == len(ids)
        assert b.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert b.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_digests(frame(spark), WORD, out="b").count() == len(AWKWARD)
    assert bpe.encode_digests(empty(spark), WORD).count() == 0
    assert bpe.encode_ids(frame(spark), WORD, out="i", decoded="d").where("doc_id = 4").first().i == library.encode(AWKWARD[3][1], add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 3000, 700_000])
def test_rans_round_trip(n):
    r = np.random.default_rng(n)
    ids = (r.zipf(1.2, n) % 49_408).astype(np.uint32)
    blob = rans.pack_segment([5, None], [n // 2, n - n // 2], ids, lanes=64, block_tokens=1 << 15)
    docs, lengths, back = rans.unpack_segment(blob)
    assert docs == [5, None] and lengths.sum() == n and (back == ids).all()
    if n > 1000:
        broken = bytearray(blob)
        broken[-5] ^= 1
        with pytest.raises(ValueError):
            rans.unpack_segment(bytes(broken))


def test_token_file(spark, library, monkeypatch):
    monkeypatch.setattr(rans, "SLICE_BYTES", 40)
    docs = frame(spark)
    segments = rans.write_ids(docs, WORD, segment_tokens=50)
    assert segments.count() > 1
    got = rans.read_digests(segments).orderBy("start").collect()
    want, start = [], 0
    for i, t in sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    assert {r.doc_id: r.ids for r in rans.read_ids(segments).collect()}[1] == [1]
    assert rans.read_digests(rans.write_ids(empty(spark), WORD)).count() == 0
    texts = [*HARD, "a|b# c** 10,20"]
    import pyarrow as pa

    ids, n = rans._coded(rans._library(WORD), pa.array(texts), 1)
    for t, e, k in zip(texts, np.cumsum(n), n, strict=True):
        assert ids[e - k : e].tolist() == [*library.encode(t, add_special_tokens=False).ids, 1], t


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer, models

    pieces = counts.vocabulary(PIECE)
    own = counts.Counter(pieces)
    lib = Tokenizer(models.Unigram([("<unk>", -99.0), *pieces], unk_id=0, byte_fallback=False))
    for w in ["hello", "ththetion", "日本あ한", "א", "x" * 300, "a\x01b\x02\x03c", "naïve", "▁", "1234"]:
        assert own.pieces("▁" + w) == len(lib.encode("▁" + w, add_special_tokens=False).ids), w
    got = {(r.doc_id, r.text): r.n_tokens for r in counts.count_tokens(frame(spark), PIECE).collect()}
    assert got[1, None] == 0 and got[2, ""] == 0
    assert got[6, AWKWARD[5][1]] == sum(len(lib.encode("▁" + w, add_special_tokens=False).ids) for w in AWKWARD[5][1].split())
    assert counts.count_tokens(empty(spark), PIECE).count() == 0


def brute_decontam(text, items, window=13):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    d, hit, found = words(text), set(), set()
    for name, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            win = w[k : k + window]
            for i in range(len(d) - len(win) + 1):
                if d[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(name)
    return len(d), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(d)


def test_decontam_against_brute_force(spark):
    import random

    r = random.Random(5)
    word = lambda: r.choice("ab ba aa bb c".split())
    items = [(str(k), " ".join(word() for _ in range(r.choice([1, 3, 5, 13, 14, 20])))) for k in range(12)] + [("e", ""), ("n", None), ("dup", "aa bb"), ("dup2", "AA, bb!")]
    texts = [" ".join(word() for _ in range(r.randint(0, 60))) + r.choice(["", " Zz-é 9"]) for _ in range(80)] + [None, "", items[0][1]]
    texts += [items[k][1].upper() + " rest " + items[k + 1][1] for k in range(8)]
    docs = frame(spark, list(enumerate(texts)))
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: r.d for r in decontam.decontaminate(docs, bench, out="d").collect()}
    for i, t in enumerate(texts):
        g = got[i]
        assert (g.n_words, g.n_hit, g.n_items, g.items_sha256, g.contaminated) == brute_decontam(t, items), (i, t)
        assert sum(s["to"] - s["from"] for s in g.spans) == g.n_hit
    assert decontam.decontaminate(frame(spark), bench.where("false")).where("decontam.n_hit > 0").count() == 0
    assert decontam.decontaminate(empty(spark), bench).count() == 0
    # a benchmark in many slices gives the same
    sliced = {r.doc_id: r.d for r in decontam.decontaminate(docs, bench, out="d", max_words=30).collect()}
    assert len(list(decontam.build(bench, max_words=30))) > 3 and sliced == got
    assert len(list(decontam.build(bench.where("false")))) == 1
    # what is cut: the words of long spans, all of a text that is mostly hit
    cleaned = decontam.remove_spans(decontam.decontaminate(docs, bench, out="d"), "d", least_words=3, most_cover=0.8, out="c").collect()
    for r in cleaned:
        d, left = r.d, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.c or "").lower())
        if r.text is None or d.n_hit > 0.8 * max(d.n_words, 1):
            assert r.c is None
        else:
            gone = [(s["from"], s["to"]) for s in d.spans if s["to"] - s["from"] >= 3]
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.lower())
            assert left == [w for k, w in enumerate(words) if not any(a <= k < b for a, b in gone)]


def test_decontam_memory():
    import random
    import tracemalloc

    r = random.Random(2)
    machine = decontam.SuffixAutomaton()
    tracemalloc.start()
    for k in range(500):
        machine.add(str(k), " ".join(f"w{r.randint(0, 5000)}" for _ in range(100)).encode())
    machine.finish()
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    # 50,000 words: a million would stay below 700 MB on the driver
    assert peak < 35e6, peak


def labelled(spark, n=400):
    rows, labels = [], []
    for i in range(n):
        bad, toxic = i % 4 == 0, i % 5 == 0
        words = [f"w{(i * 7 + k * k) % 97}" for k in range(60)]
        if toxic:
            words[::9] = ["idiot"] * len(words[::9])
        rows.append((i, " ".join(w + "$$$" for w in words) if bad else " ".join(words)))
        labels.append((i, int(not bad), int(toxic)))
    return frame(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = labelled(spark)
    model = quality.train(docs, labels)
    got = quality.classify(docs, model, out="q").join(labels.where("quality is not null"), "doc_id").where(quality.held_out(F.col("doc_id"))).select("quality", "q.*").collect()
    assert got and sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)
    awkward = quality.classify(frame(spark), model, out="q")
    assert all(0 <= r.q.score <= 1 for r in awkward.collect()) and awkward.count() == len(AWKWARD)
    assert quality.classify(empty(spark), model).count() == 0
    constant = quality.train(docs, labels.where("false"))
    assert quality.classify(docs, constant, out="q").select("q.score").distinct().count() == 1
    # the held-out rows' labels do not matter
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.train(docs, flipped)
    assert all((a == b).all() for a, b in zip(model.tables, again.tables, strict=True))


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    assert (np.diff(model.theta) > 0).all()
    got = toxicity.grade(docs, model, out="t").join(labels.where("toxic is not null"), "doc_id").select("toxic", "t.expected_severity", F.col("t.toxic").alias("said")).collect()
    assert sum(bool(r.toxic) == r.said for r in got) >= 0.97 * len(got)
    assert min(r.expected_severity for r in got if r.toxic) > max(r.expected_severity for r in got if not r.toxic)
    assert toxicity.grade(frame(spark), model).where("toxicity.toxic").count() == 0
    assert toxicity.grade(empty(spark), model).count() == 0
    assert toxicity.grade(docs, toxicity.train(docs, labels.where("toxic = 0"))).where("toxicity.toxic").count() == 0


def test_toxicity_gradient_and_grades():
    r = np.random.default_rng(4)
    n, k, grades = 60, 5, 4
    cells = (r.integers(0, n, 200), r.integers(0, k, 200), r.random(200))
    grade = r.integers(0, grades, n)
    par = r.normal(0, 0.5, k + grades - 1)
    _, grad = toxicity.gradient(par, cells, grade, grades, 0.01)
    for j in range(len(par)):
        step = np.zeros(len(par))
        step[j] = 1e-6
        slope = (toxicity.gradient(par + step, cells, grade, grades, 0.01)[0] - toxicity.gradient(par - step, cells, grade, grades, 0.01)[0]) / 2e-6
        assert abs(slope - grad[j]) < 1e-5
    # the expected grade against a plain sum, and grades that rise with how toxic a text reads
    words = [b"mild", b"bad", b"foul"]
    texts = [b" ".join([b"plain"] * 9 + [words[i % 3]] * (1 + i % 3) + [b"x%d" % i]) if i % 2 else b"plain words %d" % i for i in range(240)]
    toxic = np.array([i % 2 for i in range(240)])
    model = toxicity.fit(texts, toxic)
    for t in (b"", None, b"foul foul plain", b"mild"):
        seen = toxicity._count(t, model.weights)
        z = sum(model.weights[f] * np.log2(1 + c) for f, c in seen.items())
        assert np.allclose(model.above(t), [1 / (1 + np.exp(-(z - x))) for x in model.theta])
    assert model.above(b"plain words").sum() < 0.5 < model.above(b"plain foul foul foul").sum()


def test_pseudo_likelihood(spark):
    import random

    r = random.Random(1)
    cycle = "one two three four five six seven eight nine ten".split()
    rows = [(i, " ".join(cycle[(i + k) % 10] for k in range(200))) for i in range(60)]
    docs = frame(spark, rows)
    model = lm.train(docs)
    shuffled = frame(spark, [(i, " ".join(r.sample(t.split(), 200))) for i, t in rows])
    mean = lambda d: lm.score(d, model, out="s").agg(F.avg("s.mean_log_prob")).first()[0]
    # in order, a word follows from its neighbours; out of order, it does not
    assert mean(docs) > mean(shuffled) + 0.5
    got = {(x.doc_id, x.text): x.s for x in lm.score(frame(spark), model, out="s").collect()}
    assert got[1, None].n_tokens == 0 and got[1, None].log_prob == 0 and got[1, None].mean_log_prob is None
    assert got[5, AWKWARD[4][1]] == got[6, AWKWARD[5][1]]
    # against a plain sum over the network's own probabilities
    net, ids = lm.Network.of(model.flat), lm.Ids(model.words).of(rows[0][1].encode())
    around = [0, *ids.tolist(), 0]
    want = sum(float(net.log_probs(np.array([around[k]]), np.array([around[k + 2]]))[1][0, around[k + 1]]) for k in range(len(ids)))
    assert abs(lm.score(docs, model, out="s").where("doc_id = 0").first().s.log_prob - want) < 1e-2
    assert lm.score(empty(spark), lm.train(empty(spark))).count() == 0


def test_pseudo_likelihood_training(spark):
    r = np.random.default_rng(6)
    net = lm.Network.start(9, 5)
    for p in net.parts():
        p[...] = r.normal(0, 0.5, p.shape)
    net = lm.Network(*(p.astype(np.float64) for p in net.parts()))
    l, c, seen = r.integers(0, 9, 7), r.integers(0, 9, 7), r.integers(0, 4, (7, 9)).astype(np.float64)
    _, grads = lm.loss_gradient(net, l, c, seen)
    for p, g in zip(net.parts(), grads, strict=True):
        for at in list(np.ndindex(p.shape))[:: max(1, p.size // 6)]:
            old = p[at]
            p[at] = old + 1e-6
            up = lm.loss_gradient(net, l, c, seen)[0]
            p[at] = old - 1e-6
            slope = (up - lm.loss_gradient(net, l, c, seen)[0]) / 2e-6
            p[at] = old
            assert abs(slope - g[at]) < 1e-6
    # the model does not depend on how the corpus is dealt to tasks
    import random

    q = random.Random(2)
    rows = [(i, " ".join(q.choice("a b c d e f g".split()) for _ in range(q.randint(0, 40)))) for i in range(60)]
    docs = frame(spark, rows)
    one, other = lm.train(docs.repartition(1)), lm.train(docs.repartition(7, "text"))
    assert one.words == other.words and (one.flat == other.flat).all() and (one.within.rest == other.within.rest).all()


def test_pseudo_likelihood_predicts_words_not_buckets(spark, monkeypatch):
    import zlib

    # more words than classes; the probe words come late in the order of frequency and so share a class
    words = [f"w{k:03d}" for k in range(400)]
    rows = [(i, " ".join(words[: 400 - i])) for i in range(200)] + [(900, "zqonce"), (901, "w399")]
    model = lm.train(frame(spark, rows))
    assert b"w390" not in model.words and model.vocabulary.count() == 400 - len(model.words)
    bucket = lambda w: zlib.crc32(w.encode()) % lm.BUCKETS
    garbled = next(w for w in (f"zq{k}x" for k in range(10_000)) if bucket(w) == bucket("w390"))
    probes = frame(spark, [(1, "w000 w390 w001"), (2, f"w000 {garbled} w001"), (3, "w000 zqonce w001 w395 zqonce")])
    got = {r.doc_id: r.s.log_prob for r in lm.score(probes, model, out="s").collect()}
    assert got[1] > got[2] + 1 and np.isfinite(got[3])
    # what a class deals out to its words is a probability
    for b in range(lm.BUCKETS):
        own = [model.within.known(w.encode()) for w in words if w.encode() not in model.words and bucket(w) == b]
        assert abs(np.exp(own).sum() + np.exp(model.within.rest[b]) - 1) < 1e-9
    # how many words the workers know does not matter
    monkeypatch.setattr(lm, "KNOWN_WORDS", 3)
    fewer = lm.train(frame(spark, rows))
    assert len(fewer.within.keys) == 3
    again = {r.doc_id: r.s.log_prob for r in lm.score(probes, fewer, out="s").collect()}
    assert all(abs(again[k] - got[k]) < 1e-4 for k in got)


def test_counts_keep_white_space_and_bytes(spark):
    import random

    import sentencepiece

    file = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    own = counts.Counter(counts.vocabulary(PIECE))
    r = random.Random(4)
    hard = ["a\nb", "a   b", "   ", " a ", "  x", "\n", "a\n\n\n b\t\tc \r\n d", "\U0001F9FF\U0001F9FF x", "a\u3000b\x85c", "a \u2581 b", "x" + " " * 40 + "\n" * 9]
    hard += ["".join(r.choice(["a", "the", "ing", " ", "  ", "\n", "\t", "é", "日", "\U0001F9FF", ".", "1"]) for _ in range(60)) for _ in range(40)]
    for t in hard:
        # in stretches as in one go
        assert own.count(t) == own.pieces("▁" + t.replace(" ", "▁")), t
    for t in ["a\nb", "a   b", "   ", " a ", "  x", "\n", "a\n\nb", "a\tb", "\U0001F9FF\U0001F9FF x", "x" + " " * 16]:
        assert own.count(t) == len(file.encode(t)), t
    got = {r.doc_id: r.n_tokens for r in counts.count_tokens(frame(spark, list(enumerate(hard))), PIECE).collect()}
    assert [got[k] for k in range(len(hard))] == [own.pieces("▁" + t.replace(" ", "▁")) for t in hard]
