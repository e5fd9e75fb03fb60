"""Evaluation: generators, compliance loops, acceptance, geometry reports, agreement, samples and review orders."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import mean_std
from .windows import page, strided_sample


class Generator(ABC):
    """Makes plans: rooms ``g, n, role, ...`` and edges ``g, a, b, via`` for programs ``g, roles``; one attempt's seed makes it repeatable."""

    @abstractmethod
    def generate(self, programs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]: ...

    def adj_score(self, a: str, b: str) -> float:
        """How likely two roles are joined; 1 where the generator cannot tell."""
        return 1.0

    @classmethod
    def from_checkpoint(cls, checkpoint: Mapping) -> Generator:
        return cls(**{k: v for k, v in checkpoint.items() if k != "arch"})


def load_generator(checkpoint: Mapping, classes: Mapping[str, type[Generator]]) -> Generator:
    """The generator whose class the checkpoint's ``arch`` names."""
    arch = checkpoint.get("arch")
    if arch not in classes:
        raise KeyError(f"no generator {arch!r}; there are {sorted(classes)}")
    return classes[arch].from_checkpoint(checkpoint)


def loop_evaluation(attempts: DataFrame) -> DataFrame:
    """One row of ``n, compliance_no_loop, compliance_with_loop, avg_attempts`` from attempts (``g, attempt, raw_passed, passed``): the first raw attempt of a plan against the best of the loop, which ends at the first pass."""
    first_pass = F.min(F.when(F.col("passed"), F.col("attempt")))
    plan = attempts.groupBy("g").agg(F.max(F.when((F.col("attempt") == 0) & F.col("raw_passed"), 1).otherwise(0)).alias("raw"), F.max(F.col("passed").cast("int")).alias("done"), (F.coalesce(first_pass, F.max("attempt")) + 1).alias("tries"))
    return plan.agg(F.count("*").alias("n"), F.round(F.avg("raw"), 3).alias("compliance_no_loop"), F.round(F.avg("done"), 3).alias("compliance_with_loop"), F.round(F.avg("tries"), 2).alias("avg_attempts"))


def acceptance_budget(candidates: DataFrame) -> DataFrame:
    """One row of stage counts of drawn plans (``decoded, geom_ok, legal_ok``), the share that passes all, and the draws that one pass takes on average (null without any)."""
    both = F.col("decoded") & F.col("geom_ok") & F.col("legal_ok")
    ok = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    s = candidates.agg(F.count("*").alias("total"), ok(F.col("decoded")).alias("decoded"), ok(F.col("decoded") & F.col("geom_ok")).alias("geom_pass"), ok(F.col("decoded") & F.col("legal_ok")).alias("legal_pass"), ok(both).alias("both_pass"))
    share = F.col("both_pass") / F.col("total")
    return s.withColumns({"pass_rate": F.when(F.col("total") > 0, F.round(100 * share, 1)).otherwise(0.0), "expected_draws": F.when(F.col("both_pass") > 0, F.round(1 / share, 1))})


def best_of(candidates: DataFrame, key: str) -> DataFrame:
    """The best candidate of each key (``draw, geom_ok, legal_ok, n_violations``): the first that passes both, else geometry before fewer violations before earlier draws."""
    fine = F.col("geom_ok") & F.col("legal_ok")
    rank = F.struct((~fine).alias("a"), F.when(fine, F.lit(False)).otherwise(~F.col("geom_ok")).alias("b"), F.when(fine, 0).otherwise(F.col("n_violations")).alias("c"), F.col("draw"))
    return candidates.groupBy(key).agg(F.min(rank)["draw"].alias("draw"), F.count_if(fine).alias("accepted"))


def realisation(doors: DataFrame, adjacent: DataFrame) -> DataFrame:
    """``g, realised, total``: doors (``g, a, b``) whose rooms share a wall (``g, a, b`` in any order)."""
    pair = lambda d: d.select("g", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    met = pair(doors).join(pair(adjacent).distinct().withColumn("ok", F.lit(True)), ["g", "a", "b"], "left")
    return met.groupBy("g").agg(F.count("ok").alias("realised"), F.count("*").alias("total"))


def supervision(raw: DataFrame, post: DataFrame, realised: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row ``n, raw_pass, post_pass, realisation``, ``category, n_inputs``): pass shares before and after repair, mean share of realised doors, and inputs per distinct issue category (the first word)."""
    ok = raw.select("g", F.col("passed").alias("raw")).join(post.select("g", F.col("passed").alias("post")), "g").join(realised, "g", "left")
    share = F.when(F.col("total") > 0, F.col("realised") / F.col("total"))
    row = ok.agg(F.count("*").alias("n"), F.avg(F.col("raw").cast("double")).alias("raw_pass"), F.avg(F.col("post").cast("double")).alias("post_pass"), F.avg(share).alias("realisation"))
    return row, issues.select("g", F.substring_index("issue", " ", 1).alias("category")).distinct().groupBy("category").agg(F.count("*").alias("n_inputs"))


def render_issues(rooms: DataFrame, doors: DataFrame, adjacent: DataFrame, scaled: DataFrame) -> DataFrame:
    """``g, issue`` of drawn plans: R8 without a scale, R6 doors between rooms that share no wall, R7 rooms with doors none of which is real, R2 rooms of fewer than three corners.

    ``rooms``: ``g, n, role, n_corners``; ``scaled``: ``g, scale``.
    """
    pair = lambda d: d.select("g", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    met = pair(doors.where("a is not null and b is not null")).join(pair(adjacent).distinct().withColumn("ok", F.lit(True)), ["g", "a", "b"], "left").withColumn("ok", F.col("ok").isNotNull())
    role = rooms.select("g", "n", "role")
    named = met.join(role.withColumnRenamed("n", "a").withColumnRenamed("role", "ra"), ["g", "a"]).join(role.withColumnRenamed("n", "b").withColumnRenamed("role", "rb"), ["g", "b"])
    r6 = named.where("not ok").select("g", F.concat_ws("", F.lit("R6 unrealised "), "ra", F.lit("-"), "rb").alias("issue"))
    real = met.select("g", "ok", F.explode(F.array("a", "b")).alias("n")).groupBy("g", "n").agg(F.bool_or("ok").alias("ok"))
    r7 = real.where("not ok").join(role, ["g", "n"]).select("g", F.concat(F.lit("R7 isolated "), "role").alias("issue"))
    r8 = scaled.where("scale is null or scale = 0").select("g", F.lit("R8 no dimensions").alias("issue"))
    r2 = rooms.where("n_corners < 3").select("g", F.concat(F.lit("R2 broken outline "), "role").alias("issue"))
    return r8.unionByName(r6).unionByName(r7).unionByName(r2)


def quantile(values: DataFrame, keys: list[str], value: str, at: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Values at positions (from 0) of each key's sorted values: values are counted first, so that no key's values are collected."""
    counted = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    up = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    run = counted.withColumns({"upto": F.sum("c").over(up), "n": F.sum("c").over(Window.partitionBy(*keys))})
    return run.groupBy(*keys, "n").agg(*(F.min(F.when(F.col("upto") > F.floor(pos(F.col("n"))), F.col(value))).alias(name) for name, pos in at.items()))


def geometry_report(measured: DataFrame, arm: str | None = None) -> DataFrame:
    """Means, middles, ninth deciles and band shares of plan metrics in long form (``arm, measure, value``); ``arm`` names a column that splits the plans."""
    d = measured.withColumn("arm", F.col(arm) if arm else F.lit("all"))
    out = None
    for name in ("fill", "convex", "overlap", "corners"):
        q = quantile(d.withColumn(name, F.col(name).cast("double")), ["arm"], name, {"median": lambda n: n / 2, "p90": lambda n: F.bround(0.9 * (n - 1))})
        mean = d.groupBy("arm").agg(F.avg(name).alias("mean"))
        both = q.join(mean, "arm").select("arm", F.explode(F.array(*(F.struct(F.lit(f"{name}_{k}").alias("measure"), F.col(k).cast("double").alias("value")) for k in ("mean", "median", "p90")))).alias("v")).select("arm", "v.*")
        out = both if out is None else out.unionByName(both)
    share = lambda c: F.count_if(F.coalesce(c, F.lit(False))) / F.count("*")
    bands = d.groupBy("arm").agg(share(F.col("fill") >= 0.9).alias("fill_90"), share(F.col("overlap") == 0).alias("overlap_0"), share(F.col("holes") > 0).alias("with_holes"), share(F.col("pieces") == 1).alias("one_piece"))
    names = ("fill_90", "overlap_0", "with_holes", "one_piece")
    return out.unionByName(bands.select("arm", F.explode(F.array(*(F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("value")) for n in names))).alias("v")).select("arm", "v.*"))


def arms_compared(plans: DataFrame, arm: str, flags: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """One row an arm: ``n``, the percentage of each flag (of plans that have it), and the upper middle and mean of each number."""
    share = [F.avg(F.col(f).cast("double") * 100).alias(f"pct_{f}") for f in flags]
    out = plans.groupBy(arm).agg(F.count("*").alias("n"), *share, *(F.avg(c).alias(f"{c}_mean") for c in numbers))
    for c in numbers:
        out = out.join(quantile(plans, [arm], c, {f"{c}_median": lambda n: n / 2}).drop("n"), arm, "left")
    return out


def flips(paired: DataFrame, before: str, after: str) -> DataFrame:
    """``before, after, n``: how a flag of the same plans went."""
    return paired.groupBy(F.col(before).alias("before"), F.col(after).alias("after")).agg(F.count("*").alias("n"))


def round_trips(trips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row of shares and quantiles, the ten worst) of round trips (``g, n_before, n_after, edges_before, edges_after`` as arrays of pairs): loss-free share, and the Jaccard index of unordered edges."""
    scored = trips.withColumn("jaccard", edge_jaccard(F.col("edges_before"), F.col("edges_after")))
    q = quantile(scored.withColumn("k", F.lit(1)), ["k"], "jaccard", {"median": lambda n: n / 2, "p10": lambda n: F.bround(0.1 * (n - 1)), "p25": lambda n: F.bround(0.25 * (n - 1)), "p90": lambda n: F.bround(0.9 * (n - 1))})
    whole = scored.agg(F.lit(1).alias("k"), F.avg(((F.col("jaccard") == 1) & (F.col("n_before") == F.col("n_after"))).cast("double")).alias("loss_free"), F.avg((F.col("n_before") == F.col("n_after")).cast("double")).alias("rooms_kept"), F.avg("jaccard").alias("mean"), F.max("jaccard").alias("max"))
    return whole.join(q, "k").drop("k"), scored.orderBy("jaccard", "g").limit(10)


def edge_jaccard(a: Column, b: Column) -> Column:
    """Common over all unordered pairs of two arrays of (x, y) structs; 1 if both are empty."""
    flat = lambda c: F.array_distinct(F.transform(c, lambda e: F.struct(F.least(e["x"], e["y"]).alias("x"), F.greatest(e["x"], e["y"]).alias("y"))))
    union = F.size(F.array_union(flat(a), flat(b)))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(flat(a), flat(b))) / union)


def agreement(pairs: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row of agreement, ``x, y, n`` of role pairs that differ) between annotators: ``pairs (key, n_left, n_right)``, ``matches (key, role_a, role_b)``.

    Rooms agree by twice the matches over all rooms, roles by equal ones over matches, plans if all rooms match with equal roles.
    """
    m = matches.groupBy("key").agg(F.count("*").alias("matched"), F.count_if(F.col("role_a") == F.col("role_b")).alias("same"))
    d = pairs.join(m, "key", "left").withColumns({"matched": F.coalesce("matched", F.lit(0)), "same": F.coalesce("same", F.lit(0))})
    exact = (F.col("n_left") == F.col("n_right")) & (F.col("matched") == F.col("n_left")) & (F.col("same") == F.col("n_left"))
    row = d.agg(F.count("*").alias("pairs"), F.sum(F.col("n_left") + F.col("n_right")).alias("rooms"), F.sum("matched").alias("matched"), F.sum("same").alias("role_same"), F.count_if(exact).alias("exact"))
    row = row.withColumns({"room_rate": 2 * F.col("matched") / F.col("rooms"), "role_rate": F.when(F.col("matched") > 0, F.col("role_same") / F.col("matched")), "exact_rate": F.col("exact") / F.col("pairs")})
    apart = matches.where("role_a <> role_b").groupBy(F.least("role_a", "role_b").alias("x"), F.greatest("role_a", "role_b").alias("y")).agg(F.count("*").alias("n"))
    return row, apart


def by_version(ledger: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Means of metrics by version."""
    return ledger.groupBy("version").agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in metrics))


def seeds_text(ledger: DataFrame, keys: list[str], metrics: Sequence[str], digits: int = 3) -> DataFrame:
    """Mean and deviation over seeds as text, ``0.123±0.010 (n)``; a metric without numbers is null."""
    named = lambda m: F.struct(*(c.alias(n) for c, n in zip(mean_std(F.col(m)), ("mean", "std", "n"), strict=True))).alias(m)
    out = ledger.groupBy(*keys).agg(*map(named, metrics))
    text = lambda m: F.when(F.col(m)["n"] > 0, F.format_string(f"%.{digits}f±%.{digits}f (%d)", F.col(m)["mean"], F.col(m)["std"], F.col(m)["n"]))
    return out.select(*keys, *(text(m).alias(m) for m in metrics))


def opening_counts(tokens: DataFrame, door: int, window: int, passage: int, section: int) -> DataFrame:
    """One row of means over token arrays: doors, windows and passages a plan, and the share that reaches the section of openings."""
    count = lambda t: F.size(F.filter("tokens", lambda x: x == t))
    return tokens.agg(F.count("*").alias("n"), F.avg(count(door)).alias("doors"), F.avg(count(window)).alias("windows"), F.avg(count(passage)).alias("passages"), F.avg(F.array_contains("tokens", F.lit(section)).cast("double")).alias("reached"))


def permuted_rooms(plans: DataFrame, seed: int) -> DataFrame:
    """Rooms of token plans (``g, rooms`` as arrays of token arrays, ``edges`` as (x, y) of places from 0) in another order, by a hash of plan, seed and place; edges follow their rooms."""
    keyed = F.transform("rooms", lambda r, i: F.struct(F.md5(F.concat_ws(":", F.lit(seed), F.col("g").cast("string"), i.cast("string"))).alias("h"), i.alias("i"), r.alias("r")))
    sorted_rooms = plans.withColumn("__o", F.array_sort(keyed))
    place = lambda x: (F.array_position(F.transform("__o", lambda e: e["i"]), x) - 1).cast("int")
    edges = F.transform("edges", lambda e: F.struct(place(e["x"]).alias("x"), place(e["y"]).alias("y")))
    return sorted_rooms.select("g", F.transform("__o", lambda e: e["r"]).alias("rooms"), edges.alias("edges"))


def features(rooms: DataFrame, edges: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """``g, types, links``: role ids in room order and the pairs of places (from 0) that edges join; roles outside the vocabulary have its length as id."""
    from .roles import lookup

    type_id = lookup({r: k for k, r in enumerate(vocabulary)}, F.col("role"), len(vocabulary))
    place = F.row_number().over(Window.partitionBy("g").orderBy("n")) - 1
    placed = rooms.select("g", "n", type_id.alias("t"), place.alias("p"))
    types = placed.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "t"))), lambda e: e["t"]).alias("types"))
    a, b = placed.select("g", F.col("n").alias("a"), F.col("p").alias("x")), placed.select("g", F.col("n").alias("b"), F.col("p").alias("y"))
    links = edges.select("g", "a", "b").join(a, ["g", "a"]).join(b, ["g", "b"]).groupBy("g").agg(F.array_sort(F.collect_set(F.struct(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")))).alias("links"))
    return types.join(links, "g", "left")


# samples and orders


def gate_sample(plans: DataFrame, n: int, least: int = 7, most: int = 14) -> DataFrame:
    """The first plans by id with one entrance and a number of rooms that is fit for review."""
    return plans.where((F.col("n_entrances") == 1) & F.col("n_rooms").between(least, most)).orderBy("g").limit(n)


def gate_score(marks: DataFrame, missing: DataFrame) -> DataFrame:
    """One row of precision and recall of judged edges (``verdict``: o, ok, x, wrong; others are not judged) and edges that were missing."""
    v = F.lower(F.trim(F.coalesce("verdict", F.lit(""))))
    m = marks.agg(F.count_if(v.isin("o", "ok", "x", "wrong")).alias("judged"), F.count_if(v.isin("o", "ok")).alias("correct"))
    k = missing.agg(F.count("*").alias("missing"))
    out = m.join(k, F.lit(True))
    return out.withColumns({"precision": F.when(F.col("judged") > 0, F.round(F.col("correct") / F.col("judged"), 3)), "recall": F.when(F.col("correct") + F.col("missing") > 0, F.round(F.col("correct") / (F.col("correct") + F.col("missing")), 3))})


def tiered_sample(plans: DataFrame, per_tier: int) -> DataFrame:
    """A sample at even strides of each tier's plans by id; the tiers are few."""
    tiers = [r[0] for r in plans.select("tier").distinct().orderBy("tier").collect()]
    out = plans.where("false")
    for t in tiers:
        out = out.unionByName(strided_sample(plans.where(F.col("tier") == t), ["g"], per_tier))
    return out


#: Orders of the review list by name.
ORDERS = {"size": [F.desc, "n"], "pending": [F.desc, "pending"], "variants": [F.desc, "n_variants"], "id": [F.asc, "sig"]}


def review_list(groups: DataFrame, q: str = "", house: str | None = None, scope: str | None = None, status: str | None = None, sort: str = "size", offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of duplicate groups (``sig, house, scope, status, n, pending, n_variants``): filtered, in one of the orders of ``ORDERS``, ties by signature."""
    rows = groups.where(F.contains(F.lower("sig"), F.lit(q.lower()))) if q else groups
    for name, value in (("house", house), ("scope", scope), ("status", status)):
        rows = rows.where(F.col(name) == value) if value is not None else rows
    order, column = ORDERS[sort]
    return page(rows, [order(column), "sig"], offset, limit)


def conflict_order(groups: DataFrame) -> DataFrame:
    """Disputed groups in the order of review: by scope, then more corrected, more variants, more pending members first."""
    return groups.where("status = 'conflict'").orderBy("scope", F.desc("n_corrected"), F.desc("n_variants"), F.desc("pending"), "sig")


def rate_order(pairs: DataFrame) -> DataFrame:
    """Mined pairs by rising rate, ties by the pair."""
    return pairs.orderBy("rate", "x", "y")


def filtered(df: DataFrame, predicate: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """Rows that a caller's predicate selects; null counts as false."""
    return df if predicate is None else df.where(F.coalesce(predicate(df), F.lit(False)))
