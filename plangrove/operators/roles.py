"""Role vocabularies and rules on roles: ids, aliases, kinds, forbidden pairs, masters, enhancement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rules


def lookup(table: Mapping, key: Column, default=None) -> Column:
    """A small mapping as an expression; keys that it lacks (and null) give the default."""
    if not table:
        return F.lit(default)
    m = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(m, key), default if isinstance(default, Column) else F.lit(default))


def role_id(role: Column, vocabulary: Sequence[str], aliases: Mapping[str, str], other: str) -> Column:
    """A role's place in an append-only vocabulary, after trimming and aliases; unknown and null roles have the place of ``other``."""
    wrong = sorted(a for a, b in aliases.items() if b not in vocabulary or a in vocabulary)
    if wrong or other not in vocabulary or len(set(vocabulary)) < len(vocabulary):
        raise ValueError(f"a vocabulary must hold each alias's target once and no alias: {wrong}")
    name = F.trim(F.coalesce(role, F.lit("")))
    return lookup({r: k for k, r in enumerate(vocabulary)}, lookup(aliases, name, name), vocabulary.index(other))


def canonical(text: Column, aliases: Mapping[str, str], empty: str = "(none)") -> Column:
    """Printed text as a role: trimmed and through the aliases; an empty one is ``empty``."""
    name = F.trim(F.coalesce(text, F.lit("")))
    return F.when(name == "", F.lit(empty)).otherwise(lookup(aliases, name, name))


def family(role: Column, families: Mapping[str, str]) -> Column:
    """A role's family, itself if it has none."""
    return lookup(families, role, role)


def external_class(label: Column, table: Mapping[str, str], default: str) -> Column:
    """A foreign label's class: looked up without case, outer white space and blanks."""
    return lookup(table, F.replace(F.lower(F.trim(label.cast("string"))), F.lit(" "), F.lit("")), default)


def plain_name(name: Column, prefixes: Mapping[str, str]) -> Column:
    """A class name with its first matching prefix replaced."""
    out = name
    for old, new in reversed(list(prefixes.items())):
        out = F.when(name.startswith(old), F.concat(F.lit(new), F.substring(name, F.lit(len(old) + 1), F.length(name)))).otherwise(out)
    return out


def element_kind(name: Column, kinds: Mapping[str, Sequence[str]]) -> Column:
    """The bucket (room, door, window, ...) that a class belongs to; null for classes that none holds."""
    return lookup({c: kind for kind, classes in kinds.items() for c in classes}, name)


def excluded_room(name: Column, area: Column, core: Sequence[str], other: str, least_area: float) -> Column:
    """Whether a room is left out: the building's core, or another room smaller than ``least_area``."""
    return name.isin(list(core)) | ((name == other) & (area < least_area))


def door_forbidden(a: Column, b: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Whether no door can join two roles, in either order."""
    keys = [F.lit("\x00".join(sorted(p))) for p in pairs]
    return F.concat_ws("\x00", F.least(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))), F.greatest(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))).isin(*keys)


def via_for(a: Column, b: Column, outer: Sequence[str], window: Sequence[str], door: Sequence[str]) -> Column:
    """How two roles must be joined if one is an outer one: window, door, or null (left as geometry says)."""
    one = lambda x, y: F.when(x.isin(*outer) & y.isin(*window), "window").when(x.isin(*outer) & y.isin(*door), "door")
    both = a.isin(*outer) & b.isin(*outer)
    return F.when(~F.coalesce(both, F.lit(False)), F.coalesce(one(a, b), one(b, a)))


def largest_as_master(rooms: DataFrame, bedrooms: Sequence[str], master: str, plain: str) -> DataFrame:
    """Of a plan's bedrooms the largest (of equal ones the last) is the master, the others are plain."""
    bed = F.col("role").isin(*bedrooms)
    top = rooms.where(bed).groupBy("g").agg(F.max(F.struct("area", "n"))["n"].alias("__top"))
    named = rooms.join(top, "g", "left").withColumn("role", F.when(bed, F.when(F.col("n") == F.col("__top"), master).otherwise(plain)).otherwise(F.col("role")))
    return named.drop("__top")


def derived_master(counts: Column, bedrooms: tuple[str, str]) -> Column:
    """A map of role counts in which all bedrooms are one master and plain ones for the rest."""
    master, plain = bedrooms
    total = F.coalesce(F.try_element_at(counts, F.lit(master)), F.lit(0)) + F.coalesce(F.try_element_at(counts, F.lit(plain)), F.lit(0))
    others = F.map_filter(counts, lambda k, _: ~k.isin(master, plain))
    one = F.map_concat(others, F.create_map(F.lit(master), F.lit(1).cast("long")))
    return F.when(total <= 0, counts).when(total == 1, one).otherwise(F.map_concat(one, F.create_map(F.lit(plain), (total - 1).cast("long"))))


def area_share(rooms: DataFrame, out: str = "share") -> DataFrame:
    """Adds a room's area over its plan's largest (1 where nothing has an area)."""
    top = rooms.groupBy("g").agg(F.max(F.coalesce("area", F.lit(0.0))).alias("__top"))
    return rooms.join(top, "g").withColumn(out, F.coalesce("area", F.lit(0.0)) / F.when(F.col("__top") > 0, F.col("__top")).otherwise(F.lit(1.0))).drop("__top")


def enhanced(rooms: DataFrame, edges: DataFrame, names: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """Roles of rooms whose role is still ``names['other']``, by the first rule that holds.

    ``rooms``: ``g, n, role, aspect, outer, n_windows, n_fixtures``.  A degree of 3 or more is a corridor; a room with an outer wall, a window, no fixture and a living room beside it a
    balcony; one whose only neighbour is a master, without window and fixture, a dressing room; a slim one (aspect 2.5) of degree 2 or more a corridor; one of degree 2 beside a private room a vestibule.
    """
    seen = rules.neighbour_roles(rooms, edges)
    degree = edges.select("g", F.explode(F.array("a", "b")).alias("n")).groupBy("g", "n").agg(F.count("*").alias("__d"))
    seen = seen.join(degree, ["g", "n"], "left")
    d, near = F.coalesce("__d", F.lit(0)), lambda key: F.arrays_overlap("around", F.array(*map(F.lit, names[key])))
    bare = F.col("n_fixtures") == 0
    new = (
        F.when(d >= 3, names["corridor"])
        .when(F.col("outer") & (F.col("n_windows") > 0) & bare & near("living"), names["balcony"])
        .when((d == 1) & (F.col("around") == F.array(F.lit(names["master"]))) & bare & (F.col("n_windows") == 0), names["dressing"])
        .when((F.col("aspect") >= 2.5) & (d >= 2), names["corridor"])
        .when((d == 2) & near("private"), names["vestibule"])
    )
    return seen.withColumn("role", F.when(F.col("role") == names["other"], F.coalesce(new, "role")).otherwise(F.col("role"))).select(*rooms.columns)


def ordered_variants(variants: DataFrame) -> DataFrame:
    """Adds ``rank`` to variants (``grp, variant, count``): by falling count, earlier variants first."""
    return variants.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("count"), "variant")))


def difference_kind(n_room_counts: Column, n_role_counts: Column) -> Column:
    """What variants of a group disagree on: structure (numbers of rooms), position (the same roles) or label."""
    return F.when(n_room_counts > 1, "structure").when(n_role_counts == 1, "position").otherwise("label")


def worklist_verdict(independent: Column) -> Column:
    """Whose judgement a disputed group rests on, from the numbers of independent members of its variants: single, tie or majority."""
    some = F.sort_array(F.filter(independent, lambda x: x > 0), asc=False)
    return F.when(F.size(some) <= 1, "single").when(F.get(some, F.lit(0)) == F.get(some, F.lit(1)), "tie").otherwise("majority")


def worklist_bucket(in_corpus: Column, kind: Column) -> Column:
    """D for groups outside the training corpus, else A structure, B label, C position."""
    return F.when(F.coalesce(in_corpus, F.lit(0)) == 0, "D").otherwise(lookup({"structure": "A", "label": "B", "position": "C"}, kind))
