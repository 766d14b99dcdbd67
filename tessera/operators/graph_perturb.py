"""Seeded corruption of property graphs: rewiring, dropout, ontology violations. Choices rank ids by hash, so input order is irrelevant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.rng import u01
from tessera.operators.graph import Ontology, dangling_filter, resolved
from tessera.operators.order import ordinals


def affected(df: DataFrame, intensity: float) -> int:
    """Elements that an intensity touches, halves to even."""
    return round(intensity * df.count())


def chosen(df: DataFrame, n: int, seed: int, purpose: str) -> DataFrame:
    """Ids of ``n`` elements by hash of the id; each task keeps its ``n`` first only."""
    return df.select("id", u01(seed, purpose, "id").alias("_u")).orderBy("_u", "id").limit(n).select("id")


def _flag(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.withColumn("_hit", F.lit(True)), "id", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))


def rewire(nodes: DataFrame, edges: DataFrame, seed: int, intensity: float) -> DataFrame:
    """A share of edges gets another target: neither its source nor its present one."""
    n = nodes.count()
    if n < 3:
        return edges
    place = ordinals(nodes.select("id"), ["id"]).select("id", "_i")
    at = lambda c: place.select(F.col("id").alias(c), F.col("_i").alias(f"_{c}"))
    rows = _flag(edges, chosen(edges, affected(edges, intensity), seed, "rewire"))
    hit = rows.where("_hit").join(at("source"), "source", "left").join(at("target"), "target", "left")
    lo, hi = F.least(F.col("_source"), F.col("_target")), F.greatest(F.col("_source"), F.col("_target"))
    taken = F.when(lo == hi, 1).otherwise(2)
    k = F.floor(u01(seed, "rewire:to", "id") * (n - taken)).cast("long")
    k = F.when(k >= lo, k + 1).otherwise(k)
    k = F.when((lo != hi) & (k >= hi), k + 1).otherwise(k)
    new = hit.withColumn("_i", k).join(place.select(F.col("id").alias("_to"), "_i"), "_i", "left").withColumn("target", F.coalesce("_to", "target"))
    return rows.where("not _hit").select(*edges.columns).unionByName(new.select(*edges.columns))


def rewire_preserving(edges: DataFrame, seed: int, intensity: float) -> DataFrame:
    """Pairs of chosen edges of one type swap targets, so every node keeps its in- and out-degree."""
    k = affected(edges, intensity) // 2 * 2
    order = chosen(edges, k, seed, "swap").join(edges, "id").select("id", "type", "target", u01(seed, "swap", "id").alias("_u"))
    ranked = ordinals(order, ["type", "_u", "id"]).select("id", "type", "target", "_i")
    pair = ranked.withColumn("_pair", F.floor(F.col("_i") / 2)).withColumn("_side", F.col("_i") % 2)
    other = pair.select(F.col("_pair"), (1 - F.col("_side")).alias("_side"), F.col("type").alias("_type"), F.col("target").alias("_new"))
    swaps = pair.join(other, ["_pair", "_side"]).where("type = _type").select("id", "_new")
    return edges.join(swaps, "id", "left").withColumn("target", F.coalesce("_new", "target")).select(*edges.columns)


def drop_edges(edges: DataFrame, seed: int, intensity: float) -> DataFrame:
    return edges.join(chosen(edges, affected(edges, intensity), seed, "drop:edge"), "id", "left_anti").select(*edges.columns)


def drop_nodes(nodes: DataFrame, edges: DataFrame, seed: int, intensity: float) -> tuple[DataFrame, DataFrame]:
    """A share of nodes goes, and with them the edges that would dangle."""
    left = nodes.join(chosen(nodes, affected(nodes, intensity), seed, "drop:node"), "id", "left_anti").select(*nodes.columns)
    return left, dangling_filter(left, edges).select(*edges.columns)


def drop_both(nodes: DataFrame, edges: DataFrame, seed: int, intensity: float) -> tuple[DataFrame, DataFrame]:
    left, rest = drop_nodes(nodes, edges, seed, intensity)
    return left, drop_edges(rest, seed, intensity)


def _broken_props(ontology: Ontology) -> tuple[Column, Column]:
    """(new type, new props): for each type the first break that its properties allow, in the order range, choice, missing, datatype; undeclared type if none."""
    from tessera.functions.scalars import is_pii

    kind, props = F.lit("undeclared_type"), F.col("props")
    for t in ontology.nodes:
        own = sorted((p for p in t.props if not is_pii(p.name)), key=lambda p: p.name)
        ranged = next((p for p in own if p.constraints.get("max") is not None or p.constraints.get("min") is not None), None)
        choice = next((p for p in own if p.constraints.get("choices")), None)
        needed = next((p for p in own if not p.nullable), None)
        typed = next((p for p in own if p.datatype in ("integer", "float", "boolean")), None)
        here = F.col("type") == t.name
        fields = F.from_json("props", "map<string,string>")
        if ranged:
            bad = ranged.constraints["max"] + 1 if ranged.constraints.get("max") is not None else ranged.constraints["min"] - 1
            new = F.map_concat(F.map_filter(fields, lambda k, v: k != ranged.name), F.create_map(F.lit(ranged.name), F.lit(str(bad))))
        elif choice:
            new = F.map_concat(F.map_filter(fields, lambda k, v: k != choice.name), F.create_map(F.lit(choice.name), F.lit("__invalid__")))
        elif needed:
            new = F.map_filter(fields, lambda k, v: k != needed.name)
        elif typed:
            new = F.map_concat(F.map_filter(fields, lambda k, v: k != typed.name), F.create_map(F.lit(typed.name), F.lit("not a value")))
        else:
            continue
        kind = F.when(here, F.col("type")).otherwise(kind)
        props = F.when(here, F.to_json(new)).otherwise(props)
    return kind, props


def violate_ontology(nodes: DataFrame, edges: DataFrame, ontology: Ontology, seed: int, intensity: float) -> tuple[DataFrame, DataFrame]:
    """A share of nodes breaks its type's rules, a share of edges points to a node of a wrong type, or to none if there is no other type."""
    kind, props = _broken_props(ontology)
    n = _flag(nodes, chosen(nodes, affected(nodes, intensity), seed, "violate:node"))
    new_nodes = n.withColumn("_t", F.when(F.col("_hit"), kind).otherwise(F.col("type"))).withColumn("props", F.when(F.col("_hit"), props).otherwise(F.col("props"))).withColumn("type", F.col("_t")).select(*nodes.columns)
    # The least id of another type is the least of all, or of the types but that one's.
    least = [*nodes.groupBy("type").agg(F.min("id").alias("id")).orderBy("id").limit(2).collect(), None, None][:2]
    e = _flag(edges, chosen(edges, affected(edges, intensity), seed, "violate:edge"))
    any_, other = (F.lit(r["id"] if r else None) for r in least)
    wrong = resolved(nodes, e.where("_hit"))
    to = F.when(F.col("target_type").eqNullSafe(F.lit(least[0]["type"] if least[0] else None)), other).otherwise(any_)
    wrong = wrong.withColumn("target", F.coalesce(to, F.concat(F.lit("missing-"), "id")))
    return new_nodes, e.where("not _hit").select(*edges.columns).unionByName(wrong.select(*edges.columns))


def inject_violations(edges: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` more edges, copies of chosen ones with a missing target."""
    count = edges.count()
    if not count:
        return edges
    places = ordinals(edges, ["id"])
    draws = edges.sparkSession.range(n).select(F.col("id").alias("_k"), F.floor(u01(seed, "inject", "id") * count).cast("long").alias("_i"))
    new = draws.join(places, "_i").withColumn("id", F.concat(F.lit("violation-"), F.col("_k").cast("string"))).withColumn("target", F.concat(F.lit("missing-"), F.col("_k").cast("string")))
    return edges.unionByName(new.select(*edges.columns))
