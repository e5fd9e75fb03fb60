"""Queries over raw entries: dispositions, coverage, copies, joins with labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import classify, windows
from ..registry import query
from ..tables import table


def disposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its label, whether it is the first of its copies, disposition and reason."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = docs.withColumn("fp", F.md5("text")).join(labels.withColumn("labelled", F.lit(True)), "doc_id", "left")
    copies = classify.with_representatives(joined, "fp", ["doc_id"])
    group, label = classify.waterfall(
        (~F.col("first"), "excl", "duplicate"),
        (F.col("n_chars") < 100, "excl", "junk"),
        (F.col("toxic") == 1, "excl", "toxic"),
        (F.col("quality") == 0, "fix", "low_quality"),
        (F.col("labelled").isNull(), "fix", "unlabelled"),
        otherwise=("use", "accepted"),
    )
    return copies.select("doc_id", "lang", "source", "n_chars", "quality", "toxic", "labelled", "fp", "first", group.alias("disposition"), label.alias("reason"))


DISPOSED = """disposed AS (
  SELECT *, CASE WHEN copy_no > 1 THEN 'excl' WHEN n_chars < 100 THEN 'excl' WHEN toxic = 1 THEN 'excl' WHEN quality = 0 THEN 'fix' WHEN NOT labelled THEN 'fix' ELSE 'use' END AS disposition,
         CASE WHEN copy_no > 1 THEN 'duplicate' WHEN n_chars < 100 THEN 'junk' WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low_quality' WHEN NOT labelled THEN 'unlabelled' ELSE 'accepted' END AS reason
  FROM (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic, l.doc_id IS NOT NULL AS labelled, md5(d.text) AS fp,
               row_number() OVER (PARTITION BY md5(d.text) ORDER BY d.doc_id) AS copy_no
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id))"""


@query(f"WITH {DISPOSED} SELECT disposition, reason, count(*) AS n_rows, CAST(sum(CASE WHEN copy_no = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_units FROM disposed GROUP BY 1, 2")
def disposition_accounting(spark, sf_dir):
    """Every input row in exactly one disposition; units are counted on representatives."""
    return disposed(spark, sf_dir).groupBy("disposition", "reason").agg(F.count("*").alias("n_rows"), F.count_if("first").alias("n_units"))


@query("""WITH r AS (
  SELECT CASE WHEN d.n_chars < 500 THEN 'short' ELSE '' END || ',' || CASE WHEN l.toxic = 1 THEN ' toxic ' ELSE '' END || ',' || CASE WHEN l.quality = 0 THEN 'low' ELSE '' END || ',' || CASE WHEN l.quality = 0 THEN ' low' ELSE '' END AS s
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
), p AS (SELECT list_distinct(list_filter(list_transform(string_split(s, ','), lambda x: trim(x)), lambda x: x <> '')) AS k FROM r),
e AS (SELECT unnest(CASE WHEN len(k) = 0 THEN [''] ELSE k END) AS reason FROM p)
SELECT reason, count(*) AS n FROM e GROUP BY 1""")
def reason_histogram(spark, sf_dir):
    """Reasons once per record after trimming; a record without any counts under the empty reason."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    low = F.coalesce(F.col("quality") == 0, F.lit(False))
    text = F.concat(
        F.when(F.col("n_chars") < 500, "short").otherwise(""), F.lit(","),
        F.when(F.coalesce(F.col("toxic") == 1, F.lit(False)), " toxic ").otherwise(""), F.lit(","),
        F.when(low, "low").otherwise(""), F.lit(","), F.when(low, " low").otherwise(""),
    )
    return d.select(F.explode(S.clean_reasons(text)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""WITH {DISPOSED}, k AS (SELECT *, CASE WHEN quality IS NOT NULL AND toxic = 1 THEN 'dual' WHEN quality = 1 THEN 'spa_only' WHEN quality = 0 THEN 'str_only' ELSE 'other' END AS composition FROM disposed)
SELECT composition, disposition, count(*) AS n_rows, CAST(sum(CASE WHEN copy_no = 1 THEN n_chars ELSE 0 END) AS BIGINT) AS units FROM k GROUP BY 1, 2""")
def label_composition_matrix(spark, sf_dir):
    """Rows and units by label composition and disposition; copies add no units."""
    d = disposed(spark, sf_dir)
    kinds = F.filter(F.array(F.when(F.col("quality").isNotNull() & (F.col("toxic") == 1), F.lit("STR")), F.when(F.col("quality").isNotNull() & ((F.col("toxic") == 1) | (F.col("quality") == 1)), F.lit("SPA")), F.when(F.col("quality") == 0, F.lit("STR"))), lambda x: x.isNotNull())
    units = F.when(F.col("first"), F.col("n_chars")).otherwise(F.lit(0))
    return d.withColumn("composition", classify.label_category(kinds)).groupBy("composition", "disposition").agg(F.count("*").alias("n_rows"), F.sum(units).alias("units"))


@query("""WITH c AS (SELECT o_orderstatus AS house, o_orderkey AS g, l_linenumber, CASE WHEN l_discount >= 0.08 THEN 0 WHEN l_tax >= 0.06 THEN 1 WHEN l_quantity < 10 THEN 2 ELSE 3 END AS p
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey), d AS (SELECT house, g, min(p) AS p, count(*) AS units FROM c GROUP BY 1, 2),
x AS (SELECT 'unit' AS grain, house, p FROM c UNION ALL SELECT 'drawing', house, p FROM d)
SELECT grain, coalesce(house, 'ALL') AS house, CASE p WHEN 0 THEN 'done' WHEN 1 THEN 'excl' WHEN 2 THEN 'fix' ELSE 'use' END AS disposition, count(*) AS n
FROM x GROUP BY GROUPING SETS ((grain, p), (grain, house, p))""")
def two_grain_status(spark, sf_dir):
    """Unit and drawing counts by disposition, over all and by house; a drawing has its units' strongest."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    d = classify.corrected_disposition(F.col("l_discount") >= 0.08, F.col("l_tax") < 0.06, F.lit("success"), F.when(F.col("l_quantity") < 10, 1).otherwise(0))
    rank = F.when(d == "done", 0).when(d == "excl", 1).when(d == "fix", 2).otherwise(3)
    units = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("o_orderkey").alias("g"), F.col("o_orderstatus").alias("house"), rank.alias("p"))
    drawings = units.groupBy("g", "house").agg(F.min("p").alias("p"))
    both = units.select(F.lit("unit").alias("grain"), "house", "p").unionByName(drawings.select(F.lit("drawing").alias("grain"), "house", "p"))
    counted = both.groupingSets([("grain", "p"), ("grain", "house", "p")], "grain", "house", "p").agg(F.count("*").alias("n"))
    name = F.element_at(F.array(*map(F.lit, ("done", "excl", "fix", "use"))), F.col("p") + 1)
    return counted.select("grain", F.coalesce("house", F.lit("ALL")).alias("house"), name.alias("disposition"), "n")


@query("SELECT d.lang, d.source, count(*) AS n, count(l.doc_id) AS labelled, count(*) - count(l.doc_id) AS missing, count(*) FILTER (WHERE l.toxic = 1) AS with_toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1, 2")
def inventory_coverage(spark, sf_dir):
    """Entries by language and source, and how many have labels."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels").withColumn("l", F.lit(1)), "doc_id", "left")
    return d.groupBy("lang", "source").agg(F.count("*").alias("n"), F.count("l").alias("labelled"), (F.count("*") - F.count("l")).alias("missing"), F.count_if(F.col("toxic") == 1).alias("with_toxic"))


@query(r"""WITH s AS (SELECT doc_id, (['APT', 'DEH', 'ROW', 'XXX'])[doc_id % 4 + 1] || '_' || (['FP', 'CS', 'EP', 'SD', '-'])[doc_id % 5 + 1] || '_' || (['STR', 'SPA', 'OBJ', 'OCR'])[n_chars % 4 + 1] || '_' || lpad(CAST(doc_id AS VARCHAR), 9 - CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END, '0') AS stem FROM documents),
p AS (SELECT doc_id, stem, string_split(stem, '_') AS p FROM s), v AS (SELECT *, len(p) = 4 AND p[1] IN ('APT', 'DEH', 'ROW') AND p[2] IN ('FP', 'CS', 'EP', 'SD') AND p[3] IN ('STR', 'SPA', 'OBJ', 'OCR') AND regexp_full_match(p[4], '\d{9}') AS ok FROM p)
SELECT doc_id, stem, CASE WHEN ok THEN p[1] END AS house, CASE WHEN ok THEN p[2] END AS drawing, CASE WHEN ok THEN p[3] END AS label, CASE WHEN ok THEN p[4] END AS key, coalesce(ok AND p[2] = 'FP', false) AS wanted FROM v""")
def filename_parse(spark, sf_dir):
    """Entry names into house, drawing, label and key; invalid names give nulls; floor plans are wanted."""
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    width = F.when(F.col("doc_id") % 11 == 0, 8).otherwise(9)
    stem = F.concat_ws("_", pick(("APT", "DEH", "ROW", "XXX"), F.col("doc_id")), pick(("FP", "CS", "EP", "SD", "-"), F.col("doc_id")), pick(("STR", "SPA", "OBJ", "OCR"), F.col("n_chars")), F.lpad(F.col("doc_id").cast("string"), width, F.lit("0")))
    d = table(spark, sf_dir, "documents").select("doc_id", stem.alias("stem")).withColumn("p", classify.filename_parts(F.col("stem")))
    return d.select("doc_id", "stem", "p.house", "p.drawing", "p.label", "p.key", F.coalesce(F.col("p.drawing") == "FP", F.lit(False)).alias("wanted"))


@query("SELECT l.doc_id, CASE WHEN l.quality = 1 THEN 'quality' ELSE 'toxic' END AS has_label, d.lang, d.source FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE (l.quality = 1) <> (l.toxic = 1)")
def label_pairing_xor(spark, sf_dir):
    """Exactly one of two flags, joined to the entry that complements it."""
    one = table(spark, sf_dir, "labels").where((F.col("quality") == 1) != (F.col("toxic") == 1))
    return one.join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id").select("doc_id", F.when(F.col("quality") == 1, "quality").otherwise("toxic").alias("has_label"), "lang", "source")


@query("SELECT d.doc_id, d.source FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' END IN ('good', 'bad'))")
def provenance_filter(spark, sf_dir):
    """Records whose provenance is in a set; an unknown provenance is not."""
    known = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").alias("p"))
    return table(spark, sf_dir, "documents").join(known.where(F.col("p").isin("good", "bad")), "doc_id", "left_semi").select("doc_id", "source")


@query("""WITH d AS (SELECT d.*, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT count(*) AS total, count(*) FILTER (WHERE labelled) AS done, count(*) FILTER (WHERE NOT labelled AND n_chars >= 100) AS recoverable, count(*) FILTER (WHERE NOT labelled AND n_chars < 100) AS hopeless FROM d""")
def recover_anti_join(spark, sf_dir):
    """Entries without a result that could still give one, with the four diagnostic counts."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id")
    lost = docs.join(labels, "doc_id", "left_anti").agg(F.count_if(F.col("n_chars") >= 100).alias("recoverable"), F.count_if(F.col("n_chars") < 100).alias("hopeless"))
    whole = docs.agg(F.count("*").alias("total"))
    return whole.join(lost, F.lit(True)).select("total", (F.col("total") - F.col("recoverable") - F.col("hopeless")).alias("done"), "recoverable", "hopeless")


@query("""WITH e AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 0 ELSE 1 END AS batch FROM events), r AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY batch DESC, ts DESC, event_id DESC) AS rn FROM e)
SELECT user_id, event_type, event_id, batch FROM r WHERE rn = 1""")
def incremental_unseen(spark, sf_dir):
    """Two batches merged by key; a row of the later batch wins."""
    e = table(spark, sf_dir, "events").withColumn("batch", F.when(F.col("ts") < F.lit("2024-01-15").cast("timestamp"), 0).otherwise(1))
    return windows.latest_per_key(e, ["user_id", "event_type"], ["batch", "ts", "event_id"]).select("user_id", "event_type", "event_id", "batch")


@query("""SELECT source, CASE WHEN source = 'src1' THEN 'one' WHEN source = 'src2' THEN 'two' WHEN source LIKE 'src1%' THEN 'one' WHEN source LIKE 'src2%' THEN 'two' END AS registered, count(*) AS n FROM documents GROUP BY 1, 2""")
def source_prefix_resolve(spark, sf_dir):
    """A registered source by exact name, then by prefix in registry order; unknown ones are null."""
    d = classify.resolve_prefix(table(spark, sf_dir, "documents").select("source"), "source", [("src1", "one"), ("src2", "two")], "registered")
    return d.groupBy("source", "registered").agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT d.doc_id, md5(d.text) AS fp, coalesce(l.quality, 1) AS ok FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id), r AS (
  SELECT *, row_number() OVER w AS rn, first_value(doc_id) OVER w AS kept FROM k WINDOW w AS (PARTITION BY fp ORDER BY CASE WHEN ok = 1 THEN 0 ELSE 1 END, doc_id))
SELECT doc_id, CASE WHEN rn = 1 THEN 'kept' ELSE 'quarantine' END AS status, CASE WHEN rn > 1 THEN kept END AS dup_of FROM r""")
def keep_one_duplicates(spark, sf_dir):
    """One of each group stays, a success before a failure; the others name it."""
    k = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("fp")).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    least = k.groupBy("fp").agg(F.min(F.struct((F.coalesce("quality", F.lit(1)) != 1).alias("bad"), "doc_id"))["doc_id"].alias("kept"))
    r = k.join(least.withColumnRenamed("fp", "key"), F.col("fp").eqNullSafe(F.col("key")))
    own = F.col("doc_id") == F.col("kept")
    return r.select("doc_id", F.when(own, "kept").otherwise("quarantine").alias("status"), F.when(~own, F.col("kept")).alias("dup_of"))


@query("""WITH k AS (SELECT doc_id, md5(text) AS fp FROM documents), r AS (SELECT doc_id, fp, row_number() OVER (PARTITION BY fp ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY fp) AS n, min(doc_id) OVER (PARTITION BY fp) AS group_id FROM k)
SELECT doc_id, CAST(i AS INTEGER) AS i, n, i = 1 AS kept, group_id FROM r WHERE n > 1""")
def copy_ordinals(spark, sf_dir):
    """i of n inside each group of copies; a group is named by its least id, which no global order needs."""
    k = windows.positioned(table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("fp")), ["fp", "doc_id"], "p")
    group = k.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("group_id"), F.min("p").alias("start")).where("n > 1")
    r = k.join(group.withColumnRenamed("fp", "key"), F.col("fp").eqNullSafe(F.col("key"))).withColumn("i", (F.col("p") - F.col("start") + 1).cast("int"))
    return r.select("doc_id", "i", "n", (F.col("i") == 1).alias("kept"), "group_id")


@query("""WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('42:test:' || CAST(doc_id AS VARCHAR)), doc_id) AS pick, count(*) OVER (PARTITION BY lang) AS available FROM documents)
SELECT lang, doc_id, CAST(pick AS INTEGER) AS pick, available FROM r WHERE pick <= 20""")
def hash_ranked_topk(spark, sf_dir):
    """A reproducible pick of 20 per class by the hash of the id."""
    d = table(spark, sf_dir, "documents").select("lang", "doc_id")
    n = d.groupBy("lang").agg(F.count("*").alias("available"))
    return windows.hash_ranked(d, "lang", F.col("doc_id"), 20, "42:test").join(F.broadcast(n), "lang").select("lang", "doc_id", "pick", "available")


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)
SELECT doc_id FROM r WHERE pos IN (SELECT CAST(floor(i * n / 37) AS BIGINT) FROM range(37) t(i), (SELECT count(*) AS n FROM documents))""")
def systematic_sample(spark, sf_dir):
    """37 rows at even strides of the sorted rows."""
    return windows.strided_sample(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 37)


@query("""WITH m AS (SELECT doc_id, lang, n_chars FROM documents WHERE contains(lower(source), 'rc1')), c AS (SELECT count(*) AS n FROM m)
SELECT doc_id, lang, n_chars FROM m ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET (SELECT least(100000000, greatest(0, (n - 1) // 25 * 25)) FROM c)""")
def paged_listing(spark, sf_dir):
    """A substring search, sorted and paged; an offset beyond the end shows the last page."""
    m = table(spark, sf_dir, "documents").where(F.contains(F.lower("source"), F.lit("rc1"))).select("doc_id", "lang", "n_chars")
    return windows.page(m, [F.desc("n_chars"), "doc_id"], 100_000_000, 25)


@query(f"WITH {DISPOSED}, r AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY CASE WHEN disposition = 'use' THEN 1 ELSE 0 END, doc_id) AS rn, count(*) OVER (PARTITION BY fp) AS n FROM disposed) SELECT doc_id, disposition, n FROM r WHERE rn = 1")
def representative_collapse(spark, sf_dir):
    """One row per signature, an unfinished one first."""
    d = disposed(spark, sf_dir).groupBy("fp").agg(F.min(F.struct((F.col("disposition") == "use").alias("done"), "doc_id", "disposition")).alias("m"), F.count("*").alias("n"))
    return d.select("m.doc_id", "m.disposition", "n")


@query("""WITH k AS (SELECT lower(coalesce(lang, '')) AS lang, doc_id, n_chars, text FROM documents)
SELECT doc_id, CASE WHEN regexp_extract(text, '(?i)(\\d+)\\s*the\\b', 1) <> '' THEN TRY_CAST(regexp_extract(text, '(?i)(\\d+)\\s*the\\b', 1) AS INTEGER) WHEN regexp_extract(text, '(?i)the\\b\\s*(\\d+)', 1) <> '' THEN TRY_CAST(regexp_extract(text, '(?i)the\\b\\s*(\\d+)', 1) AS INTEGER) END AS near_the,
  CASE WHEN contains(lower(text), 'family') THEN 'family' ELSE 'unknown' END AS scope, lang FROM k""".replace("\\\\", "\\"))
def text_constraint_parse(spark, sf_dir):
    """A number next to a keyword (before it, else behind it), a scope word and the language of a free text."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", S.number_near(F.col("text"), "the" + S.WORD_END).alias("near_the"), F.when(F.contains(S.lowered(F.col("text")), F.lit("family")), "family").otherwise("unknown").alias("scope"), S.lowered(F.coalesce("lang", F.lit(""))).alias("lang"))


@query("""WITH old AS (SELECT source AS k, max(n_chars) AS v FROM documents WHERE doc_id % 3 <> 0 AND source <> 'src7' GROUP BY 1), new AS (SELECT source AS k, max(n_chars) AS v FROM documents WHERE doc_id % 3 <> 1 AND source <> 'src8' GROUP BY 1)
SELECT coalesce(old.k, new.k) AS k, CASE WHEN old.k IS NULL THEN 'new' WHEN new.k IS NULL THEN 'removed' WHEN old.v <> new.v THEN 'amended' ELSE 'same' END AS change FROM old FULL JOIN new ON old.k = new.k""")
def law_catalog_diff(spark, sf_dir):
    """Two editions of a catalog by key: new, removed, amended, same."""
    d = table(spark, sf_dir, "documents")
    edition = lambda rows, v: rows.groupBy(F.col("source").alias("k")).agg(F.max("n_chars").alias(v))
    old, new = edition(d.where("doc_id % 3 <> 0 AND source <> 'src7'"), "old"), edition(d.where("doc_id % 3 <> 1 AND source <> 'src8'"), "new")
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "amended").otherwise("same")
    return old.join(new, "k", "full").select("k", change.alias("change"))


@query("""WITH p AS (SELECT d.lang, d.n_chars, l.doc_id IS NOT NULL AS labelled, coalesce(l.toxic, 0) = 1 AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT coalesce(lang, 'ALL') AS lang, labelled, toxic, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM p GROUP BY GROUPING SETS ((labelled, toxic), (lang, labelled, toxic))""")
def correction_delta(spark, sf_dir):
    """Counters of four populations, given as two flags, over all and by language."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels").withColumn("labelled", F.lit(True)), "doc_id", "left")
    p = d.select("lang", "n_chars", F.col("labelled").isNotNull().alias("labelled"), (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"))
    g = p.groupingSets([("labelled", "toxic"), ("lang", "labelled", "toxic")], "lang", "labelled", "toxic").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return g.select(F.coalesce("lang", F.lit("ALL")).alias("lang"), "labelled", "toxic", "n", "chars")


@query("""SELECT lang, count(*) AS n, list_sort(list(n_chars))[len(list(n_chars)) // 2 + 1] AS upper_median, list_sort(list(n_chars))[CAST(ceil(len(list(n_chars)) / 2) AS BIGINT)] AS lower_median,
 median(n_chars) AS interpolated, list_sort(list(n_chars))[CAST(round_even(0.9 * (len(list(n_chars)) - 1), 0) AS BIGINT) + 1] AS nearest_rank_90, list_sort(list(n_chars))[len(list(n_chars)) * 99 // 100 + 1] AS p99 FROM documents GROUP BY 1""")
def quantile_report(spark, sf_dir):
    """Five quantile definitions side by side.

    Exact and spill-safe: values are counted first, and each definition reads the running count, so no group's values are collected.
    """
    d = table(spark, sf_dir, "documents").groupBy("lang", "n_chars").agg(F.count("*").alias("c"))
    up = Window.partitionBy("lang").orderBy("n_chars").rowsBetween(Window.unboundedPreceding, 0)
    run = d.withColumns({"upto": F.sum("c").over(up), "n": F.sum("c").over(Window.partitionBy("lang"))})
    at = lambda pos: F.min(F.when(F.col("upto") > pos, F.col("n_chars")))
    n = F.col("n")
    half = lambda pos: F.floor(pos).cast("long")
    return run.groupBy("lang", "n").agg(
        at(half(n / 2)).alias("upper_median"),
        at(F.ceil(n / 2) - 1).alias("lower_median"),
        ((at(half((n - 1) / 2)) + at(half(n / 2))) / 2).alias("interpolated"),
        at(F.bround(0.9 * (n - 1)).cast("long")).alias("nearest_rank_90"),
        at(half(n * 99 / 100)).alias("p99"),
    )
