"""Triphones with word positions: lookup with back-off, and the tables of states at word edges for every context.

A definition is a table id, base, left, right, pos, states; base phones have null contexts. The index of it has one
row for each base, left and right, with the ids by position: one join finds the exact triphone or its nearest position.
Wanted triphones are made distinct before they are joined, so that frequent ones cost one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Word positions in the order of back-off: begin, end, single, internal.
POSITIONS = ("b", "e", "s", "i")
KEYS = ["base", "left", "right", "pos"]


def prefix_index(definition: DataFrame) -> DataFrame:
    """base, left, right, ids (map of position to the lowest id)."""
    each = definition.filter(F.col("left").isNotNull()).groupBy(*KEYS).agg(F.min("id").alias("id"))
    return each.groupBy("base", "left", "right").agg(F.map_from_entries(F.collect_list(F.struct("pos", "id"))).alias("ids"))


def _nearest(ids: Column, pos: Column) -> Column:
    """The id at the position, else at the first other one."""
    return F.coalesce(ids[pos], *[ids[F.lit(p)] for p in POSITIONS])


def lookup(wanted: DataFrame, definition: DataFrame, fillers: list[str], silence: str = "SIL") -> DataFrame:
    """wanted with id: of the exact triphone, else of another position, else with filler contexts taken as silence, else of the base phone.

    wanted: base, left, right, pos and more. Filler phones, and those without a context, are base phones. id is null
    for a base that the definition lacks.
    """
    asked = wanted.select(*KEYS).distinct()
    index = prefix_index(definition)
    quiet = lambda c: F.when(F.col(c).isin(*fillers), silence).otherwise(F.col(c))
    exact = index.withColumnRenamed("ids", "exact")
    near = index.select(F.col("base").alias("near_base"), F.col("left").alias("near_left"), F.col("right").alias("near_right"), F.col("ids").alias("near"))
    bases = definition.filter(F.col("left").isNull()).select("base", F.col("id").alias("base_id"))
    found = asked.join(exact, ["base", "left", "right"], "left")
    found = found.join(near, (F.col("base") == F.col("near_base")) & (quiet("left") == F.col("near_left")) & (quiet("right") == F.col("near_right")), "left")
    found = found.join(bases, "base", "left")
    own = F.when(~F.col("base").isin(*fillers, silence), F.coalesce(_nearest(F.col("exact"), F.col("pos")), _nearest(F.col("near"), F.col("pos"))))
    known = found.select(*[F.col(c).alias(f"w_{c}") for c in KEYS], F.coalesce(own, F.col("base_id")).alias("id"))
    same = F.lit(True)
    for c in KEYS:
        same = same & F.col(c).eqNullSafe(F.col(f"w_{c}"))
    return wanted.join(known, same, "left").drop(*[f"w_{c}" for c in KEYS])


def contexts(phones: DataFrame, key: str, fillers: list[str], silence: str = "SIL") -> DataFrame:
    """phones (key, pos_no, phone, word) with base, left, right, pos: neighbours across words, fillers as silence, silence at both ends.

    word tells the words of a key apart; a filler is no neighbour by its own name, but keeps it as base.
    """
    line = Window.partitionBy(key).orderBy("pos_no")
    quiet = F.when(F.col("phone").isin(*fillers), silence).otherwise(F.col("phone"))
    marked = phones.withColumn("quiet", quiet)
    first = ~F.lag("word").over(line).eqNullSafe(F.col("word"))
    last = ~F.lead("word").over(line).eqNullSafe(F.col("word"))
    pos = F.when(first & last, "s").when(first, "b").when(last, "e").otherwise("i")
    around = [F.coalesce(f("quiet").over(line), F.lit(silence)).alias(n) for f, n in ((F.lag, "left"), (F.lead, "right"))]
    return marked.select(*phones.columns, F.col("phone").alias("base"), *around, pos.alias("pos"))


def base_of_states(definition: DataFrame) -> DataFrame:
    """state, base: the base phone of each tied state, by the first definition (lowest id) that uses it."""
    each = definition.select("id", "base", F.explode("states").alias("state"))
    return each.groupBy("state").agg(F.min_by("base", "id").alias("base"))


def base_states(definition: DataFrame) -> DataFrame:
    """state, ci_state: the state at the same place of the base phone of each tied state, by the first definition that uses it."""
    each = definition.select("id", "base", F.posexplode("states").alias("place", "state"))
    first = each.groupBy("state").agg(F.min_by(F.struct("base", "place"), F.struct("id", "place")).alias("f")).select("state", "f.*")
    own = definition.filter(F.col("left").isNull()).select("base", F.posexplode("states").alias("place", "ci_state"))
    return first.join(own, ["base", "place"], "left").select("state", "ci_state")


def edge_tables(lexicon: DataFrame, definition: DataFrame, fillers: list[str], silence: str = "SIL", end: bool = True) -> DataFrame:
    """base, inner, sequences, places: for each last phone of a word (first, without end) and the phone inside next to it.

    sequences: the distinct arrays of states over all outer contexts, in the order in which the contexts (by name)
    first need them; places: context to its place among them. Words of one phone have the inner context null:
    their table goes over pairs of contexts, written "left right". All is as large as the phone set allows, whatever the words.
    """
    size = F.size("phones")
    at = (lambda n: F.element_at("phones", n)) if end else (lambda n: F.element_at("phones", -n))
    edges = lexicon.filter(size > 0).select(at(-1).alias("base"), F.when(size > 1, F.try_element_at("phones", F.lit(-2 if end else 2))).alias("inner")).distinct()
    phones = definition.filter(F.col("left").isNull()).select(F.col("base").alias("outer"))
    pair = edges.crossJoin(phones).filter(F.col("inner").isNotNull())  # one row for each three phones at most
    side = lambda of_end: F.col("inner") if of_end == end else F.col("outer")
    several = pair.select("base", "inner", F.col("outer").alias("context"), side(True).alias("left"), side(False).alias("right"), F.lit("e" if end else "b").alias("pos"))
    both = edges.filter(F.col("inner").isNull()).crossJoin(phones.withColumnRenamed("outer", "left")).crossJoin(phones.withColumnRenamed("outer", "right"))
    single = both.select("base", "inner", F.concat_ws(" ", "left", "right").alias("context"), "left", "right", F.lit("s").alias("pos"))
    ids = lookup(several.unionByName(single), definition, fillers, silence).join(definition.select("id", "states"), "id")
    first = ids.groupBy("base", "inner", "states").agg(F.min("context").alias("first"), F.collect_list("context").alias("contexts"))
    row = Window.partitionBy("base", "inner").orderBy("first")
    placed = first.withColumn("place", F.row_number().over(row) - 1)
    lists = F.transform(F.array_sort(F.collect_list(F.struct("place", "states"))), lambda x: x["states"])
    entries = F.flatten(F.collect_list(F.transform("contexts", lambda c: F.struct(c, F.col("place")))))
    return placed.groupBy("base", "inner").agg(lists.alias("sequences"), F.map_from_entries(F.array_sort(entries)).alias("places"))


def composite_states(tables: DataFrame) -> DataFrame:
    """base, inner, composites: for each table and place of a state, the sorted set of states over all contexts."""
    each = tables.select("base", "inner", F.explode("sequences").alias("s")).select("base", "inner", F.posexplode("s").alias("place", "state"))
    sets = each.groupBy("base", "inner", "place").agg(F.array_sort(F.collect_set("state")).alias("set"))
    return sets.groupBy("base", "inner").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "set"))), lambda x: x["set"]).alias("composites"))
