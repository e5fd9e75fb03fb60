"""Queries over splits, releases, duplicates and leaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph
from ..registry import query
from ..tables import NODES, nodes, table
from .corpus import DISPOSED, disposed

#: A document is a unit; its sheet holds three units.
SHEET = "'APT_FP_' || (doc_id // 3)"
BUCKET = "CAST(('0x' || substr(md5('42:' || {k}), 1, 8)) AS BIGINT) / 4294967295.0"
SPLIT = "CASE WHEN {b} < 0.8 THEN 'train' WHEN {b} < 0.9 THEN 'val' ELSE 'test' END"


def split_sql(key: str) -> str:
    return SPLIT.format(b=BUCKET.format(k=key))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    unit = F.concat(F.lit("APT_FP_"), F.floor(F.col("doc_id") / 3).cast("string"), F.lit("_u"), (F.col("doc_id") % 3).cast("string"))
    return d.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("fp"), unit.alias("unit")).withColumn("sheet", S.sheet_key(F.col("unit")))


@query(f"SELECT doc_id, {SHEET} AS sheet, {split_sql(SHEET)} AS split FROM documents")
def split_bucket_80_10_10(spark, sf_dir):
    """Train, val or test by the hash of the sheet: units of a sheet stay together."""
    return units(spark, sf_dir).select("doc_id", "sheet", S.split_of(F.col("sheet")).alias("split"))


@query("""WITH h AS (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS m FROM documents), p AS (SELECT doc_id,
 (CAST(('0x' || substr(m, 1, 8)) AS BIGINT) % 20 * 16 + CAST(('0x' || substr(m, 9, 8)) AS BIGINT)) % 20 AS hi, (CAST(('0x' || substr(m, 17, 8)) AS BIGINT) % 20 * 16 + CAST(('0x' || substr(m, 25, 8)) AS BIGINT)) % 20 AS lo FROM h)
SELECT doc_id, CASE (hi * 16 + lo) % 20 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM p""")
def split_bucket_mod20(spark, sf_dir):
    """A twentieth each for test and val by the whole digest."""
    return table(spark, sf_dir, "documents").select("doc_id", S.split_mod20(F.col("doc_id")).alias("split"))


@query(f"""WITH f AS (SELECT DISTINCT {SHEET} AS sheet FROM documents WHERE doc_id % 17 = 0)
SELECT doc_id, CASE WHEN {SHEET} IN (SELECT sheet FROM f) THEN 'test' WHEN {split_sql(SHEET)} = 'val' THEN 'val' ELSE 'train' END AS benchmark, CASE WHEN {split_sql(SHEET)} = 'val' THEN 'val' ELSE 'train' END AS pretrain FROM documents""")
def frozen_test_membership(spark, sf_dir):
    """A frozen test set overrides the bucket; data for pretraining has no test part."""
    d = units(spark, sf_dir)
    frozen = d.where("doc_id % 17 = 0").select("sheet").distinct().withColumn("frozen", F.lit(True))
    s = d.join(frozen, "sheet", "left").withColumn("val", S.split_of(F.col("sheet")) == "val")
    rest = F.when(F.col("val"), "val").otherwise("train")
    return s.select("doc_id", F.when(F.col("frozen"), "test").otherwise(rest).alias("benchmark"), rest.alias("pretrain"))


@query(f"""WITH {DISPOSED} SELECT source, count(*) FILTER (WHERE disposition = 'use') AS rows_used, count(DISTINCT CASE WHEN disposition = 'use' THEN {SHEET} END) AS sheets, count(*) FILTER (WHERE reason = 'duplicate') AS duplicates,
 count(*) FILTER (WHERE reason = 'junk') AS junk, count(*) FILTER (WHERE disposition <> 'use') AS left_out FROM disposed GROUP BY 1""")
def release_manifest(spark, sf_dir):
    """Rows and sheets of each source in a release, and why others are out."""
    sheet = F.when(F.col("disposition") == "use", F.floor(F.col("doc_id") / 3))
    return disposed(spark, sf_dir).groupBy("source").agg(
        F.count_if(F.col("disposition") == "use").alias("rows_used"),
        F.countDistinct(sheet).alias("sheets"),
        F.count_if(F.col("reason") == "duplicate").alias("duplicates"),
        F.count_if(F.col("reason") == "junk").alias("junk"),
        F.count_if(F.col("disposition") != "use").alias("left_out"),
    )


@query("""WITH a AS (SELECT source, doc_id // 1000 AS p, sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY doc_id)) AS h, count(*) AS n FROM documents GROUP BY 1, 2),
b AS (SELECT source, p // 1000 AS p, sha256(string_agg(h, chr(10) ORDER BY p)) AS h, sum(n) AS n FROM a GROUP BY source, p // 1000)
SELECT source, CAST(sum(n) AS BIGINT) AS n, substr(sha256(string_agg(h, chr(10) ORDER BY p)), 1, 12) AS manifest FROM b GROUP BY 1""")
def manifest_hash(spark, sf_dir):
    """A digest of a source's ids in order: a tree of digests over runs of 1,000, so that no task holds all ids of a source."""
    digest = lambda rows: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda e: e["h"]), "\n"), 256)
    up = lambda c: F.floor(F.col(c) / 1000).alias("p")
    ids = table(spark, sf_dir, "documents").select("source", F.floor(F.col("doc_id") / 1000).alias("p"), F.col("doc_id").alias("k"), F.col("doc_id").cast("string").alias("h"))
    a = ids.groupBy("source", "p").agg(digest(F.struct("k", "h")).alias("h"), F.count("*").alias("n"))
    b = a.select("source", up("p"), F.col("p").alias("k"), "h", "n").groupBy("source", "p").agg(digest(F.struct("k", "h")).alias("h"), F.sum("n").alias("n"))
    return b.groupBy("source").agg(F.sum("n").alias("n"), F.substring(digest(F.struct(F.col("p").alias("k"), "h")), 1, 12).alias("manifest"))


@query(f"""WITH u AS (SELECT md5(text) AS fp, {split_sql(SHEET)} AS split FROM documents), g AS (SELECT fp, count(*) AS n, count(DISTINCT split) AS k, bool_or(split = 'train') AS in_train FROM u GROUP BY 1)
SELECT u.split, count(*) AS n, count(*) FILTER (WHERE g.in_train AND u.split <> 'train') AS leaked, count(*) FILTER (WHERE g.k > 1) AS straddling FROM u JOIN g ON g.fp = u.fp GROUP BY 1""")
def cross_split_leakage(spark, sf_dir):
    """Rows of val and test whose copy is in train, and rows of groups that straddle."""
    u = units(spark, sf_dir).select("fp", S.split_of(F.col("sheet")).alias("split"))
    g = u.groupBy("fp").agg(F.bool_or(F.col("split") == "train").alias("in_train"), F.countDistinct("split").alias("k"))
    return u.join(g, "fp").groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("in_train") & (F.col("split") != "train")).alias("leaked"), F.count_if(F.col("k") > 1).alias("straddling"))


@query(f"""WITH u AS (SELECT md5(text) AS fp, {split_sql(SHEET)} AS by_sheet, {split_sql("md5(text)")} AS by_signature FROM documents), g AS (SELECT fp, count(DISTINCT by_sheet) AS ks, count(DISTINCT by_signature) AS kg FROM u GROUP BY 1)
SELECT (SELECT count(*) FROM g WHERE ks > 1) AS straddling_by_sheet, (SELECT count(*) FROM g WHERE kg > 1) AS straddling_by_signature, (SELECT count(*) FROM u WHERE by_sheet <> by_signature) AS changed, (SELECT count(*) FROM u) AS n""")
def split_impact(spark, sf_dir):
    """What hashing by signature instead of by sheet would change."""
    u = units(spark, sf_dir).select("fp", S.split_of(F.col("sheet")).alias("a"), S.split_of(F.col("fp")).alias("b"))
    g = u.groupBy("fp").agg(F.countDistinct("a").alias("ka"), F.countDistinct("b").alias("kb"), F.count_if(F.col("a") != F.col("b")).alias("c"), F.count("*").alias("n"))
    return g.agg(F.count_if(F.col("ka") > 1).alias("straddling_by_sheet"), F.count_if(F.col("kb") > 1).alias("straddling_by_signature"), F.sum("c").alias("changed"), F.sum("n").alias("n"))


FORM = "string_agg(role || ':' || CAST(area AS BIGINT), ';' ORDER BY role, CAST(area AS BIGINT))"


@query(f"WITH {NODES}, f AS (SELECT g, md5({FORM}) AS fp FROM nodes GROUP BY 1) SELECT g, fp, count(*) OVER (PARTITION BY fp) AS copies FROM f")
def structural_fingerprint(spark, sf_dir):
    """A digest of a plan's sorted rooms, and how many plans share it."""
    text = F.transform(F.array_sort(F.collect_list(F.struct("role", F.col("area").cast("long").alias("a")))), lambda e: F.concat_ws(":", e["role"], e["a"].cast("string")))
    f = nodes(spark, sf_dir).groupBy("g").agg(F.md5(F.array_join(text, ";")).alias("fp"))
    n = f.groupBy("fp").agg(F.count("*").alias("copies"))
    return f.join(n, "fp").select("g", "fp", "copies")


@query("""WITH p AS (SELECT l_orderkey AS g, l_partkey % 100 AS x, l_suppkey % 100 AS y FROM lineitem), o AS (SELECT g, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p GROUP BY 1),
f AS (SELECT p.g, (x - x0) AS ax, (x1 - x) AS bx, (y - y0) AS ay, (y1 - y) AS by_ FROM p JOIN o ON o.g = p.g),
t AS (SELECT g, unnest([string_agg(lpad(ax::VARCHAR, 3, '0') || ',' || lpad(ay::VARCHAR, 3, '0'), ';' ORDER BY ax, ay), string_agg(lpad(bx::VARCHAR, 3, '0') || ',' || lpad(ay::VARCHAR, 3, '0'), ';' ORDER BY bx, ay), string_agg(lpad(ax::VARCHAR, 3, '0') || ',' || lpad(by_::VARCHAR, 3, '0'), ';' ORDER BY ax, by_), string_agg(lpad(bx::VARCHAR, 3, '0') || ',' || lpad(by_::VARCHAR, 3, '0'), ';' ORDER BY bx, by_)]) AS form FROM f GROUP BY 1),
s AS (SELECT g, min(form) AS sig FROM t GROUP BY 1)
SELECT min(g) AS first_plan, count(*) AS n FROM s GROUP BY sig HAVING count(*) > 1""")
def mirror_signature(spark, sf_dir):
    """Groups of plans equal up to shift and mirroring: the least of four canonical forms."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), (F.col("l_partkey") % 100).alias("x"), (F.col("l_suppkey") % 100).alias("y"))
    whole = p.groupBy("g").agg(F.collect_list(F.struct("x", "y")).alias("c"))

    def form(fx, fy):
        ox, oy = F.array_min(F.transform("c", lambda e: fx * e["x"])), F.array_min(F.transform("c", lambda e: fy * e["y"]))
        return F.array_sort(F.transform("c", lambda e: F.struct((fx * e["x"] - ox).alias("x"), (fy * e["y"] - oy).alias("y"))))

    least = F.array_min(F.array(*(form(fx, fy) for fx in (1, -1) for fy in (1, -1))))
    return whole.select("g", F.sha1(F.to_json(least)).alias("sig")).groupBy("sig").agg(F.min("g").alias("first_plan"), F.count("*").alias("n")).where("n > 1").drop("sig")


@query("""WITH g AS (SELECT md5(text) AS fp, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT n FROM g ORDER BY n DESC, fp LIMIT 10)
SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS n_unique, 1 - count(*) / sum(n) AS rate, max(n) AS largest, CAST((SELECT sum(n) FROM t) AS BIGINT) AS top_ten FROM g""")
def duplicate_rate(spark, sf_dir):
    """Share of copies, the largest group, and the ten largest together."""
    g = graph.checkpointed(table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("fp")).agg(F.count("*").alias("n")))
    top = g.orderBy(F.desc("n"), "fp").limit(10).agg(F.sum("n").alias("top_ten"))
    whole = g.agg(F.sum("n").alias("n"), F.count("*").alias("n_unique"), (1 - F.count("*") / F.sum("n")).alias("rate"), F.max("n").alias("largest"))
    return whole.join(top, F.lit(True))


@query("""WITH m AS (SELECT md5(d.text) AS fp, d.doc_id, l.quality || ':' || l.toxic AS variant FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT fp, count(*) AS members, count(variant) AS corrected, count(DISTINCT variant) AS variants, CASE WHEN count(variant) = 0 THEN 'none' WHEN count(variant) = 1 THEN 'single' WHEN count(DISTINCT variant) = 1 THEN 'agree' ELSE 'conflict' END AS status, count(*) - count(variant) AS pending FROM m GROUP BY 1 HAVING count(*) > 1""")
def variant_status(spark, sf_dir):
    """Groups of copies by how their corrections agree: none, single, agree, conflict."""
    v = F.concat_ws(":", F.col("quality").cast("string"), F.col("toxic").cast("string"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("fp")).join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("variant", F.when(F.col("quality").isNotNull(), v))
    g = d.groupBy("fp").agg(F.count("*").alias("members"), F.count("variant").alias("corrected"), F.countDistinct("variant").alias("variants")).where("members > 1")
    status = F.when(F.col("corrected") == 0, "none").when(F.col("corrected") == 1, "single").when(F.col("variants") == 1, "agree").otherwise("conflict")
    return g.withColumn("status", status).withColumn("pending", F.col("members") - F.col("corrected"))


@query(f"""WITH {NODES}, m AS (SELECT g, CASE WHEN role IN ('LARGE', 'MEDIUM', 'SMALL') THEN 'MEDIUM' WHEN role = 'PROMO' THEN 'STANDARD' ELSE role END AS role, role AS raw FROM nodes), k AS (SELECT g % 5000 AS grp, g, role, count(*) AS n FROM m GROUP BY 1, 2, 3), r AS (SELECT g % 5000 AS grp, g, raw, count(*) AS n FROM m GROUP BY 1, 2, 3),
a AS (SELECT grp, g, string_agg(role || n, ',' ORDER BY role) AS s FROM k GROUP BY 1, 2), b AS (SELECT grp, g, string_agg(raw || n, ',' ORDER BY raw) AS s FROM r GROUP BY 1, 2),
ca AS (SELECT grp, count(DISTINCT s) AS v, count(*) AS n FROM a GROUP BY 1), cb AS (SELECT grp, count(DISTINCT s) AS v FROM b GROUP BY 1)
SELECT count(*) FILTER (WHERE n > 1) AS n_groups, count(*) FILTER (WHERE n > 1 AND cb.v = 1) AS closed_raw, count(*) FILTER (WHERE n > 1 AND ca.v = 1) AS closed_policy FROM ca JOIN cb ON ca.grp = cb.grp""")
def policy_closure(spark, sf_dir):
    """Groups whose variants agree once roles are unified by a chained policy (LARGE and SMALL become MEDIUM, PROMO becomes STANDARD)."""
    rooms = nodes(spark, sf_dir).select("g", (F.col("g") % 5000).alias("grp"), "role")
    unified = F.when(F.col("role").isin("LARGE", "SMALL"), "MEDIUM").when(F.col("role") == "PROMO", "STANDARD").otherwise(F.col("role"))

    def variants(d, name):
        c = d.groupBy("grp", "g", "role").agg(F.count("*").alias("n")).groupBy("grp", "g").agg(F.array_sort(F.collect_list(F.struct("role", "n"))).alias("s"))
        return c.groupBy("grp").agg(F.countDistinct(F.xxhash64("s")).alias(name), F.count("*").alias(f"n_{name}"))

    both = variants(rooms, "raw").join(variants(rooms.withColumn("role", unified), "policy"), "grp").where("n_raw > 1")
    return both.agg(F.count("*").alias("n_groups"), F.count_if(F.col("raw") == 1).alias("closed_raw"), F.count_if(F.col("policy") == 1).alias("closed_policy"))


#: Bytes of benchmark texts that one broadcast matcher holds.
SLICE_BYTES = 4_000_000


def _holds(texts):
    """A column function: the md5 of each of some texts that a text holds, by one Aho-Corasick pass."""
    from collections.abc import Iterator

    import pyarrow as pa
    from pyspark.sql.functions import arrow_udf

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        finder = ahocorasick.Automaton()
        for text, key in texts.value:
            finder.add_word(text, key)
        finder.make_automaton()
        for batch in batches:
            yield pa.array([None if t is None else sorted({key for _, key in finder.iter(t)}) for t in batch.to_pylist()], pa.list_(pa.string()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, "array<string>")


@query("SELECT b.item_id, count(d.doc_id) AS n_docs FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY 1")
def benchmark_contamination(spark, sf_dir):
    """Documents that hold an item's text verbatim, by item.

    The distinct texts go in slices of bounded size into matchers; each document is read once a slice, whatever the size of the benchmark. Every document holds the empty text,
    none a null one.
    """
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select("text").where("text is not null")
    keyed = items.select("item_id", F.md5("text").alias("key"))
    parts, held, size = [docs.agg(F.count("*").alias("n")).select(F.md5(F.lit("")).alias("key"), "n")], [], 0

    def match() -> None:
        found = docs.select(F.explode(_holds(spark.sparkContext.broadcast(list(held)))("text")).alias("key"))
        parts.append(found.groupBy("key").agg(F.count("*").alias("n")))

    for r in items.where("text <> ''").select("text", F.md5("text").alias("key")).distinct().toLocalIterator():
        held.append((r["text"], r["key"]))
        size += len(r["text"])
        if size >= SLICE_BYTES:
            match()
            held, size = [], 0
    if held:
        match()
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    return keyed.join(hits, "key", "left").groupBy("item_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n_docs"))
