"""Queries over labels, roles, manifests and recipes.

A document is a drawing: its language is the house type, documents whose number is not divisible by 3 have a room label, by 4 a structure label; every fifth has a prediction of either.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import manifest, roles, rules
from ..registry import query
from ..tables import EDGES, NODES, edges, nodes, table
from .releases import SHEET, split_sql

#: The role vocabulary of the tables; PROMO is written as SMALL.
VOCABULARY = ["STANDARD", "MEDIUM", "LARGE", "SMALL", "OTHER"]


@query(f"WITH {NODES} SELECT CASE role WHEN 'STANDARD' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'SMALL' THEN 3 WHEN 'PROMO' THEN 3 ELSE 4 END AS id, count(*) AS n FROM nodes GROUP BY 1")
def role_ids(spark, sf_dir):
    """Rooms by role id: aliases share an id, unknown roles have that of the other."""
    return nodes(spark, sf_dir).groupBy(roles.role_id(F.col("role"), VOCABULARY, {"PROMO": "SMALL"}, "OTHER").alias("id")).agg(F.count("*").alias("n"))


@query(f"""WITH {NODES}, {EDGES} SELECT CASE WHEN role_a = 'PROMO' AND role_b = 'PROMO' THEN NULL WHEN (role_a = 'PROMO' AND role_b IN ('STANDARD', 'MEDIUM')) OR (role_b = 'PROMO' AND role_a IN ('STANDARD', 'MEDIUM')) THEN 'window'
 WHEN (role_a = 'PROMO' AND role_b = 'LARGE') OR (role_b = 'PROMO' AND role_a = 'LARGE') THEN 'door' END AS via, (role_a = 'MEDIUM' AND role_b = 'MEDIUM') OR (role_a = 'MEDIUM' AND role_b = 'LARGE') OR (role_a = 'LARGE' AND role_b = 'MEDIUM') AS forbidden, count(*) AS n FROM edges GROUP BY 1, 2""")
def role_pair_rules(spark, sf_dir):
    """How role pairs must be joined, and pairs that no door can join."""
    a, b = F.col("role_a"), F.col("role_b")
    via = roles.via_for(a, b, ["PROMO"], ["STANDARD", "MEDIUM"], ["LARGE"])
    return edges(nodes(spark, sf_dir)).groupBy(via.alias("via"), roles.door_forbidden(a, b, [("MEDIUM", "MEDIUM"), ("MEDIUM", "LARGE")]).alias("forbidden")).agg(F.count("*").alias("n"))


@query(f"WITH {NODES} SELECT CASE WHEN role IN ('STANDARD', 'MEDIUM', 'LARGE') THEN 'room' WHEN role = 'SMALL' THEN 'door' WHEN role = 'PROMO' THEN 'window' END AS kind, role = 'ECONOMY' OR (role = 'LARGE' AND area < 10) AS excluded, count(*) AS n FROM nodes GROUP BY 1, 2")
def element_kinds(spark, sf_dir):
    """Classes by kind, and rooms that are left out as core or as too small."""
    kind = roles.element_kind(F.col("role"), {"room": ["STANDARD", "MEDIUM", "LARGE"], "door": ["SMALL"], "window": ["PROMO"]})
    return nodes(spark, sf_dir).groupBy(kind.alias("kind"), roles.excluded_room(F.col("role"), F.col("area"), ["ECONOMY"], "LARGE", 10.0).alias("excluded")).agg(F.count("*").alias("n"))


@query(f"""WITH {NODES}, r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY area DESC, n DESC) AS rn FROM nodes WHERE role IN ('MEDIUM', 'LARGE')),
m AS (SELECT nodes.g, CASE WHEN nodes.role NOT IN ('MEDIUM', 'LARGE') THEN nodes.role WHEN rn = 1 THEN 'LARGE' ELSE 'MEDIUM' END AS role FROM nodes LEFT JOIN r ON r.g = nodes.g AND r.n = nodes.n) SELECT role, count(*) AS n FROM m GROUP BY 1""")
def master_rooms(spark, sf_dir):
    """Roles once the largest bedroom of a plan is its master and all others are plain."""
    return roles.largest_as_master(nodes(spark, sf_dir), ["MEDIUM", "LARGE"], "LARGE", "MEDIUM").groupBy("role").agg(F.count("*").alias("n"))


@query(f"""WITH {NODES}, k AS (SELECT g, count(*) FILTER (WHERE role IN ('MEDIUM', 'LARGE')) AS b, count(*) FILTER (WHERE role NOT IN ('MEDIUM', 'LARGE')) AS o FROM nodes GROUP BY 1)
SELECT CASE WHEN b > 0 THEN 1 ELSE 0 END AS masters, greatest(b - 1, 0) AS plain, CAST(sum(o) AS BIGINT) AS others, count(*) AS n FROM k GROUP BY 1, 2""")
def derived_masters(spark, sf_dir):
    """The same from counts alone: one master and the rest plain."""
    counted = nodes(spark, sf_dir).groupBy("g", "role").agg(F.count("*").alias("k")).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("role", "k"))).alias("c"))
    c = roles.derived_master(F.col("c"), ("LARGE", "MEDIUM"))
    of = lambda r: F.coalesce(F.try_element_at("d", F.lit(r)), F.lit(0).cast("long"))
    d = counted.select(c.alias("d")).withColumn("all", F.aggregate(F.map_values("d"), F.lit(0).cast("long"), lambda a, x: a + x))
    return d.groupBy(of("LARGE").cast("int").alias("masters"), of("MEDIUM").alias("plain")).agg(F.sum(F.col("all") - of("LARGE") - of("MEDIUM")).alias("others"), F.count("*").alias("n"))


@query(f"""WITH {NODES}, {EDGES}, near AS (SELECT g, a AS n, role_b AS r FROM edges UNION ALL SELECT g, b, role_a FROM edges), k AS (SELECT g, n, count(*) AS d, list_sort(list_distinct(list(r))) AS s FROM near GROUP BY 1, 2),
x AS (SELECT nodes.*, coalesce(d, 0) AS d, coalesce(s, []) AS s FROM nodes LEFT JOIN k ON k.g = nodes.g AND k.n = nodes.n)
SELECT CASE WHEN role <> 'SMALL' THEN role WHEN d >= 3 THEN 'corridor' WHEN has_window AND pk % 3 > 0 AND pk % 2 = 0 AND list_has_any(s, ['STANDARD', 'MEDIUM']) THEN 'balcony' WHEN d = 1 AND s = ['LARGE'] AND pk % 2 = 0 AND pk % 3 = 0 THEN 'dressing'
 WHEN 1 + pk % 4 >= 2.5 AND d >= 2 THEN 'corridor' WHEN d = 2 AND list_has_any(s, ['ECONOMY', 'LARGE']) THEN 'vestibule' ELSE role END AS role, count(*) AS n FROM x GROUP BY 1""")
def enhanced_roles(spark, sf_dir):
    """Rooms without a known role by neighbours, outline, windows and fixtures."""
    rooms = nodes(spark, sf_dir)
    shaped = rooms.select("g", "n", "role", (1.0 + F.col("pk") % 4).alias("aspect"), F.col("has_window").alias("outer"), (F.col("pk") % 3).alias("n_windows"), (F.col("pk") % 2).alias("n_fixtures"))
    names = {"other": "SMALL", "corridor": "corridor", "balcony": "balcony", "dressing": "dressing", "vestibule": "vestibule", "master": "LARGE", "living": ["STANDARD", "MEDIUM"], "private": ["ECONOMY", "LARGE"]}
    return roles.enhanced(shaped, edges(rooms), names).groupBy("role").agg(F.count("*").alias("n"))


@query(f"""WITH {NODES}, {EDGES}, v AS (SELECT g, list(DISTINCT via) AS r FROM edges GROUP BY 1) SELECT count(*) FILTER (WHERE list_has_any(r, ['door', 'open'])) AS n, count(*) AS plans FROM v""")
def prefix_flags(spark, sf_dir):
    """Plans some of whose entries begin with given prefixes."""
    v = edges(nodes(spark, sf_dir)).groupBy("g").agg(F.collect_set("via").alias("r"))
    return v.agg(F.count_if(rules.has_prefix(F.col("r"), "do", "op")).alias("n"), F.count("*").alias("plans"))


_CAT = "CASE doc_id % 6 WHEN 0 THEN 'nonfp' WHEN 1 THEN 'objocr' WHEN 2 THEN 'dual' WHEN 3 THEN 'spa_only' WHEN 4 THEN 'str_only' ELSE 'other' END"


@query(f"""WITH k AS (SELECT {_CAT} AS c, n_chars > 1000 AS b, doc_id % 4 = 0 AS m FROM documents), d AS (SELECT CASE WHEN c = 'nonfp' THEN 'excl' WHEN c IN ('dual', 'spa_only', 'str_only') AND b THEN 'use' ELSE 'fix' END AS disposition,
 CASE WHEN c IN ('nonfp', 'objocr') THEN c WHEN c = 'dual' THEN CASE WHEN b AND m THEN 'dual_dedup_merge' WHEN b THEN 'dual' ELSE 'convert_failed' END WHEN c = 'spa_only' THEN CASE WHEN b THEN 'v2v_str_recovered' ELSE 'spa_only_pending' END
 WHEN c = 'str_only' THEN CASE WHEN b THEN 'v2v_spa_recovered' ELSE 'str_only_pending' END ELSE 'other' END AS reason, CASE WHEN c IN ('spa_only', 'str_only') THEN 'v2v' ELSE 'direct' END AS origin FROM k)
SELECT disposition, reason, origin, reason IN ('dual_dedup_merge', 'v2v_str_recovered', 'v2v_spa_recovered') AS corrected, count(*) AS n FROM d GROUP BY 1, 2, 3, 4""")
def raw_dispositions(spark, sf_dir):
    """Raw entries by label category and whether a graph came of them."""
    d = table(spark, sf_dir, "documents")
    c = F.get(F.array(*map(F.lit, ("nonfp", "objocr", "dual", "spa_only", "str_only", "other"))), (F.col("doc_id") % 6).cast("int"))
    rows = d.select(manifest.raw_disposition(c, F.col("n_chars") > 1000, F.col("doc_id") % 4 == 0, "2020-01-01").alias("r"), manifest.graph_origin(c).alias("origin"))
    return rows.groupBy("r.disposition", "r.reason", "origin", F.col("r.corrected").isNotNull().alias("corrected")).agg(F.count("*").alias("n"))


_REAL = "doc_id % 3 <> 0 AS spa, doc_id % 4 <> 0 AS str, doc_id % 5 = 0 AS guess"


def _drawings(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    drawings = d.select(key.alias("drawing"), F.col("lang").alias("house"), key.alias("key_SPA"), key.alias("key_STR"))
    entry = lambda label, has: d.where(has).select(F.lit(label).alias("label"), F.lit("FP").alias("drawing"), key.alias("key"), F.lit("a.zip").alias("zip"), F.concat_ws("_", F.lit(label), key).alias("entry"))
    entries = entry("SPA", F.col("doc_id") % 3 != 0).unionByName(entry("STR", F.col("doc_id") % 4 != 0))
    files = d.where("doc_id % 5 = 0").select(F.explode(F.array(*(F.concat(F.lit(f"/p/{k}_"), key, F.lit(".json")) for k in ("SPA", "STR")))).alias("path"))
    return drawings, manifest.label_index(entries, ["SPA", "STR"], ["zip", "entry"]), manifest.predicted_index(files)


@query(f"""WITH k AS (SELECT lang, {_REAL} FROM documents), p AS (SELECT lang, CASE WHEN spa THEN 'label' WHEN guess THEN 'v2v' END AS spa, CASE WHEN str THEN 'label' WHEN guess THEN 'v2v' END AS str FROM k)
SELECT lang AS house, spa, str, CASE WHEN spa = 'label' AND str = 'label' THEN 'dual' WHEN spa = 'label' THEN 'spa_only' WHEN str = 'label' THEN 'str_only' ELSE 'objocr' END AS provenance, count(*) AS n FROM p GROUP BY ALL""")
def corpus_scan(spark, sf_dir):
    """Drawings with the real label, else a predicted one, and the provenance that follows."""
    found = manifest.corpus(*_drawings(spark, sf_dir), ["SPA", "STR"])
    p = manifest.provenance(F.col("kind_SPA"), F.col("kind_STR"))
    return found.groupBy("house", F.col("kind_SPA").alias("spa"), F.col("kind_STR").alias("str"), p.alias("provenance")).agg(F.count("*").alias("n"))


@query("SELECT CAST(doc_id AS VARCHAR) AS gid, 'SPA_' || doc_id AS entry_SPA, 'STR_' || doc_id AS entry_STR FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 0 GROUP BY doc_id")
def paired_labels(spark, sf_dir):
    """Drawings both of whose labels are indexed."""
    drawings, index, _ = _drawings(spark, sf_dir)
    return manifest.paired(drawings.select(F.col("drawing").alias("gid"), "key_SPA", "key_STR"), index, ["SPA", "STR"]).select("gid", "entry_SPA", "entry_STR")


@query(f"""WITH k AS (SELECT doc_id, {_REAL} FROM documents), u AS (SELECT DISTINCT doc_id, spa, str FROM k WHERE spa OR str) SELECT CASE WHEN spa AND str THEN 'SPA,STR' WHEN spa THEN 'SPA' ELSE 'STR' END AS labels, spa AND str AS complete, count(*) AS n FROM u GROUP BY 1, 2""")
def label_coverage(spark, sf_dir):
    """Keys by the labels they have, and whether both are there."""
    c = manifest.coverage(_drawings(spark, sf_dir)[1], ["SPA", "STR"])
    return c.groupBy(F.array_join("labels", ",").alias("labels"), "complete").agg(F.count("*").alias("n"))


def _manifest(spark, sf_dir):
    """Manifest rows: a fingerprint for every 7 documents, as many graphs as the number's remainder by 3."""
    d = table(spark, sf_dir, "documents")
    ids = F.when(F.col("doc_id") % 3 > 0, F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 3).cast("int")), lambda k: F.concat_ws("_u", F.col("doc_id").cast("string"), k.cast("string"))))
    reason = F.get(F.array(*map(F.lit, ("dual", "duplicate", "nonfp", "objocr"))), (F.col("doc_id") % 4).cast("int"))
    return d.select("doc_id", F.floor(F.col("doc_id") / 7).alias("fingerprint"), reason.alias("reason"), ids.alias("graph_ids"))


_REASON = "CASE doc_id % 4 WHEN 0 THEN 'dual' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'nonfp' ELSE 'objocr' END AS reason"


@query(f"SELECT reason, count(*) AS n_graphs FROM (SELECT {_REASON}, unnest(range(doc_id % 3)) FROM documents) GROUP BY 1")
def provenance_graphs(spark, sf_dir):
    """Graphs by the reason of the manifest row that lists them."""
    return manifest.provenance_map(_manifest(spark, sf_dir)).groupBy("reason").agg(F.count("*").alias("n_graphs"))


@query(f"SELECT CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 3 END AS units, {_REASON}, count(*) AS n FROM documents GROUP BY 1, 2")
def manifest_units(spark, sf_dir):
    """Manifest rows by the number of units they count for."""
    m = _manifest(spark, sf_dir)
    return m.groupBy(manifest.row_units(F.col("graph_ids")).cast("long").alias("units"), "reason").agg(F.count("*").alias("n"))


@query(f"""WITH m AS (SELECT doc_id // 7 AS fp, {_REASON} FROM documents), b AS (SELECT doc_id // 7 AS fp, min(source) AS source, count(*) AS k FROM documents WHERE doc_id % 5 = 0 GROUP BY 1)
SELECT CASE WHEN reason IN ('duplicate', 'nonfp') THEN 'excl: ' || reason WHEN source IS NULL THEN 'fix: not built' WHEN source = 'src1' THEN 'use: one' ELSE 'fix: not built' END AS label, count(*) AS drawings, CAST(sum(CASE WHEN reason IN ('duplicate', 'nonfp') THEN 0 ELSE coalesce(k, 0) END) AS BIGINT) AS units
FROM m LEFT JOIN b ON b.fp = m.fp GROUP BY 1""")
def built_combinations(spark, sf_dir):
    """Manifest rows by what the built graphs say of their fingerprint."""
    graphs = table(spark, sf_dir, "documents").where("doc_id % 5 = 0").select(F.floor(F.col("doc_id") / 7).alias("fingerprint"), "source")
    return manifest.corrected_combo(_manifest(spark, sf_dir), graphs, {"src1": "use: one"})


@query("SELECT CASE WHEN doc_id // 3 = 5 THEN 2.5 WHEN doc_id % 2 = 0 THEN 1.0 END AS scale, CASE WHEN doc_id // 3 = 5 THEN 'success' ELSE 'quarantine' END AS status, count(*) AS n FROM documents GROUP BY 1, 2")
def sheet_scale_update(spark, sf_dir):
    """One sheet's scale is set; its units become usable."""
    d = table(spark, sf_dir, "documents")
    gid = F.concat(F.lit("APT_FP_"), F.floor(F.col("doc_id") / 3).cast("string"), F.lit("_u"), (F.col("doc_id") % 3).cast("string"))
    r = d.select(gid.alias("graph_id"), F.when(F.col("doc_id") % 2 == 0, 1.0).alias("scale"), F.lit("quarantine").alias("status"), F.lit("x").alias("reason"))
    return manifest.scaled_sheet(r, "APT_FP_5", 2.5).groupBy("scale", "status").agg(F.count("*").alias("n"))


RECIPE = {"version": "v1", "include": [{"source": "src1", "status": "success", "provenance": ["dual", "objocr"]}, {"source": "src2", "status": "success", "role": "pretrain"}, {"source": "src3"}], "test_from": ["src1", "src3"]}
_SPLIT = split_sql(SHEET)
_RECIPE = f"""r AS (SELECT doc_id, source, {_REASON}, doc_id % 10 AS ent, doc_id % 11 AS liv, {SHEET} AS sheet, {_SPLIT} AS b FROM documents WHERE doc_id % 9 <> 0),
c AS (SELECT *, CASE WHEN source = 'src2' THEN '' WHEN ent % 3 = 0 THEN 'no_entrance' WHEN ent % 3 = 2 OR liv >= 9 THEN 'multi_household' ELSE '' END AS why FROM r WHERE (source = 'src1' AND reason IN ('dual', 'objocr')) OR source IN ('src2', 'src3'))"""


def _recipe_parts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    gid = F.concat(F.lit("APT_FP_"), F.floor(F.col("doc_id") / 3).cast("string"), F.lit("_u"), F.col("doc_id").cast("string"))
    living = F.when(F.col("doc_id") % 11 >= 9, 2).otherwise(1)
    records = d.select(gid.alias("graph_id"), "source", F.when(F.col("doc_id") % 9 == 0, "quarantine").alias("status"), (F.col("doc_id") % 10 % 3).alias("n_entrances"), living.alias("n_living"))
    reasons = d.select(gid.alias("graph_id"), F.get(F.array(*map(F.lit, ("dual", "duplicate", "nonfp", "objocr"))), (F.col("doc_id") % 4).cast("int")).alias("reason"))
    return manifest.freeze(records, RECIPE, reasons)


@query(f"WITH {_RECIPE}, k AS (SELECT source, sheet, CASE WHEN source = 'src2' AND b = 'test' THEN 'train' ELSE b END AS split FROM c WHERE why = '') SELECT source, count(*) AS n_graphs, count(DISTINCT sheet) AS n_sheets, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val, count(*) FILTER (WHERE split = 'test') AS test FROM k GROUP BY 1")
def recipe_freeze(spark, sf_dir):
    """A release from a recipe: benchmark sources of one household with a test split, another without."""
    return manifest.release_counts(_recipe_parts(spark, sf_dir)[0])


@query(f"WITH {_RECIPE} SELECT source, why AS reason, count(*) AS n FROM c WHERE why <> '' GROUP BY 1, 2")
def recipe_left_out(spark, sf_dir):
    """What the recipe's household rule leaves out."""
    return _recipe_parts(spark, sf_dir)[1]


@query("SELECT CASE WHEN CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967295.0 >= 0.9 THEN 'val' ELSE 'train' END AS bucket, count(*) AS n FROM documents GROUP BY 1")
def prediction_buckets(spark, sf_dir):
    """A tenth of the keys by their hash for validation."""
    return table(spark, sf_dir, "documents").groupBy(S.tenth_bucket(F.col("doc_id")).alias("bucket")).agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT md5(text) AS sig, list(n_chars % 4) AS k, count(DISTINCT n_chars % 2) AS rooms, count(DISTINCT lang) AS labels, count(*) FILTER (WHERE doc_id % 7 = 0) AS inside FROM documents GROUP BY 1 HAVING count(*) > 1),
v AS (SELECT *, list_reverse_sort(list_filter(k, lambda x: x > 0)) AS s FROM g), d AS (SELECT CASE WHEN rooms > 1 THEN 'structure' WHEN labels = 1 THEN 'position' ELSE 'label' END AS kind, CASE WHEN len(s) <= 1 THEN 'single' WHEN s[1] = s[2] THEN 'tie' ELSE 'majority' END AS verdict, inside FROM v)
SELECT kind, verdict, CASE WHEN inside = 0 THEN 'D' WHEN kind = 'structure' THEN 'A' WHEN kind = 'label' THEN 'B' ELSE 'C' END AS bucket, count(*) AS n FROM d GROUP BY 1, 2, 3""")
def dispute_worklist(spark, sf_dir):
    """Disputed groups by what they disagree on, whose judgement they rest on and their bucket."""
    d = table(spark, sf_dir, "documents")
    g = d.groupBy(F.md5("text").alias("sig")).agg(F.collect_list(F.col("n_chars") % 4).alias("k"), F.countDistinct(F.col("n_chars") % 2).alias("rooms"), F.countDistinct("lang").alias("labels"), F.count_if(F.col("doc_id") % 7 == 0).alias("inside"), F.count("*").alias("c")).where("c > 1")
    named = g.withColumn("kind", roles.difference_kind(F.col("rooms"), F.col("labels"))).withColumn("verdict", roles.worklist_verdict(F.col("k")))
    return named.groupBy("kind", "verdict", roles.worklist_bucket(F.col("inside"), F.col("kind")).alias("bucket")).agg(F.count("*").alias("n"))
