"""Entity graph: names, aliases, mentions, relationships, merging, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.keys import strip
from tessera.functions.similarity import initialism, similarity


def alias_table(entities: DataFrame) -> DataFrame:
    """namespace, alias, entity_id: each entity's name and aliases in lower case. The entity seen first keeps an alias."""
    names = F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), F.lower))
    rows = entities.select("namespace", "id", "first_seen_at", F.explode(names).alias("alias")).where("alias IS NOT NULL")
    return rows.groupBy("namespace", "alias").agg(F.min(F.struct("first_seen_at", "id")).alias("o")).select("namespace", "alias", F.col("o.id").alias("entity_id"))


def upserted(observations: DataFrame) -> DataFrame:
    """Latest state of each (namespace, lower name): union of aliases, first and last sight, number of observations.

    aliases: where observations have them, without nulls and repeats, in order."""
    at = F.struct("extracted_at", "id")
    union = [
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_compact("aliases"))))).alias("aliases"),
    ] if "aliases" in observations.columns else []
    return observations.groupBy("namespace", F.lower("name").alias("key")).agg(
        F.max_by("name", at).alias("name"),
        F.max_by("type", at).alias("type"),
        *union,
        F.count("*").alias("n_observations"),
        F.min("extracted_at").alias("first_seen_at"),
        F.max("extracted_at").alias("last_seen_at"),
    )


def resolved(names: DataFrame, entities: DataFrame, threshold: float = 0.85) -> DataFrame:
    """namespace, name, entity_id, confidence, match: exact (1), alias (0.95), fuzzy, or new.

    Fuzzy candidates share the first three characters or the initials, and their lengths are near enough for the
    threshold, which cuts large blocks into bands of length; there is no cap on them. Of equally similar ones the first
    by name wins."""
    threshold = threshold if 0 < threshold <= 1 else 0.8
    asked = names.select("namespace", strip("name").alias("name")).where("name != ''").distinct().withColumn("low", F.lower("name"))
    known = entities.select("namespace", F.col("id").alias("entity_id"), F.col("name").alias("entity_name"), F.lower("name").alias("entity_low"))
    exact = asked.join(known.withColumnRenamed("entity_low", "low"), ["namespace", "low"])
    exact = exact.groupBy("namespace", "name").agg(F.min("entity_id").alias("exact_id"))
    by_alias = asked.join(
        alias_table(entities).withColumnRenamed("alias", "low"), ["namespace", "low"],
    ).select("namespace", "name", F.col("entity_id").alias("alias_id"))
    left = asked.join(exact, ["namespace", "name"], "left_anti").join(by_alias, ["namespace", "name"], "left_anti")

    def blocks(name: Column, low: Column) -> Column:
        prefix = F.when(F.length(low) >= 3, F.concat(F.lit("p"), F.left(low, F.lit(3))))
        initials = F.when(initialism(name) != "", F.concat(F.lit("i"), initialism(name)))
        return F.array_compact(F.array(prefix, initials))

    # the shorter of two similar names has `threshold` of the longer one's bytes, so bands differ by one at most
    band = lambda low: F.floor(F.log(F.octet_length(low)) / F.log(F.lit(1 / min(threshold, 0.99))) + 1e-9)
    a = left.withColumn("block", F.explode(blocks(F.col("name"), F.col("low")))).withColumn(
        "band", F.explode(F.sequence(band("low") - 1, band("low") + 1)),
    )
    b = known.where("entity_low != ''").withColumn(
        "block", F.explode(blocks(F.col("entity_name"), F.col("entity_low"))),
    ).withColumn("band", band("entity_low"))
    pairs = a.join(b, ["namespace", "block", "band"]).select("namespace", "name", "low", "entity_id", "entity_name", "entity_low").distinct()
    scored = pairs.withColumn("s", similarity(F.col("low"), F.col("entity_low"))).where(F.col("s") >= threshold)
    w = Window.partitionBy("namespace", "name").orderBy(F.desc("s"), "entity_name", "entity_id")
    fuzzy = scored.withColumn("r", F.row_number().over(w)).where("r = 1").select("namespace", "name", F.col("entity_id").alias("fuzzy_id"), "s")
    out = asked.select("namespace", "name").join(exact, ["namespace", "name"], "left").join(by_alias, ["namespace", "name"], "left").join(fuzzy, ["namespace", "name"], "left")
    return out.select(
        "namespace",
        "name",
        F.coalesce("exact_id", "alias_id", "fuzzy_id", F.lit("")).alias("entity_id"),
        F.when(F.col("exact_id").isNotNull(), 1.0).when(F.col("alias_id").isNotNull(), 0.95).otherwise(F.coalesce("s", F.lit(0.0))).alias("confidence"),
        F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("alias_id").isNotNull(), "alias").when(F.col("fuzzy_id").isNotNull(), "fuzzy").otherwise("new").alias("match"),
    )


def resolved_with_aliases(rows: DataFrame, entities: DataFrame, threshold: float = 0.85) -> DataFrame:
    """id, entity_id, confidence, match: by name, else by the first alias that resolves; rows that don't are left out."""
    spelled = rows.select(
        "id", "namespace",
        F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n", "raw"),
    )
    spelled = spelled.select("id", "namespace", "n", strip("raw").alias("name")).where("name != ''")
    found = spelled.join(resolved(spelled, entities, threshold).where("match != 'new'"), ["namespace", "name"])
    best = F.min(F.struct("n", "entity_id", "confidence", "match")).alias("b")
    return found.groupBy("id").agg(best).select("id", "b.entity_id", "b.confidence", "b.match")


def registered(aliases: DataFrame, registrations: DataFrame) -> DataFrame:
    """Aliases after registrations (namespace, alias, entity_id, at, id): the latest owns an alias."""
    new = registrations.groupBy("namespace", "alias").agg(F.max(F.struct("at", "id", "entity_id")).alias("r")).select("namespace", "alias", F.col("r.entity_id").alias("owner"))
    return aliases.join(new, ["namespace", "alias"], "full").select("namespace", "alias", F.coalesce("owner", "entity_id").alias("entity_id"))


def mention_counters(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("entity_id").agg(
        F.count("*").alias("mention_count"), F.min("created_at").alias("first_seen_at"),
        F.max("created_at").alias("last_seen_at"),
    )


def recent_mentions(mentions: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("entity_id").orderBy(F.desc_nulls_last("created_at"), "id")
    return mentions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def relationships(observed: DataFrame) -> DataFrame:
    """One edge for each (namespace, source, target, type): latest description and confidence, counts, first and last sight.

    description: where observations have it, the latest that isn't null."""
    at = F.struct("seen_at", "seen_id")
    described = [
        F.max_by("description", F.when(F.col("description").isNotNull(), at)).alias("description"),
    ] if "description" in observed.columns else []
    return observed.groupBy("namespace", "source_entity_id", "target_entity_id", "relation_type").agg(
        *described, F.max_by("confidence", at).alias("confidence"), F.count("*").alias("mention_count"), F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at")
    )


def edges_of(edges: DataFrame, entity_id: str, direction: str = "both") -> DataFrame:
    out, into = F.col("source_entity_id") == entity_id, F.col("target_entity_id") == entity_id
    return edges.where({"outgoing": out, "incoming": into, "both": out | into}[direction])


def merged_edges(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Edges after `source` became `target`: moved, loops dropped, edges that now coincide added up."""
    moved = lambda c: F.when(F.col(c) == source, F.lit(target)).otherwise(F.col(c)).alias(c)
    rows = edges.select(
        "namespace", moved("source_entity_id"), moved("target_entity_id"), "relation_type", "mention_count",
        "first_seen_at", "last_seen_at",
    )
    return rows.where("source_entity_id != target_entity_id").groupBy("namespace", "source_entity_id", "target_entity_id", "relation_type").agg(
        F.sum("mention_count").alias("mention_count"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at")
    )


def merged_attributes(source: Column, target: Column) -> Column:
    """Both maps; the target's values win."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(source, empty), F.coalesce(target, empty), lambda _k, s, t: F.coalesce(t, s))


def merged_aliases(source_name: Column, source: Column, target_name: Column, target: Column) -> Column:
    """The target's aliases, then the source's name and aliases, without repeats in other case and without the target's name."""
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce(target, none), F.array(source_name), F.coalesce(source, none))
    start = F.struct(none.alias("kept"), F.array(F.lower(target_name)).alias("seen"))
    step = lambda acc, x: F.when(x.isNull() | F.array_contains(acc["seen"], F.lower(F.coalesce(x, F.lit("")))), acc).otherwise(F.struct(F.concat(acc["kept"], F.array(x)).alias("kept"), F.concat(acc["seen"], F.array(F.lower(x))).alias("seen")))
    return F.aggregate(both, start, step, lambda acc: acc["kept"])


def co_mentions(mentions: DataFrame, group: list[str], item: str) -> DataFrame:
    """Pairs (a < b) of items of one text, as related_to edges of confidence 0.5. Pairs are made inside each text's list of items."""
    listed = mentions.groupBy(*group).agg(F.sort_array(F.collect_set(item)).alias("x"))
    pair = F.flatten(
        F.transform(
            "x", lambda a,
            i: F.transform(F.slice("x", i + 2, F.greatest(F.size("x") - i - 1, F.lit(0))), lambda b: F.struct(a.alias("a"), b.alias("b"))),
        )
    )
    return listed.select(*group, F.explode(pair).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n_texts")).withColumn("relation_type", F.lit("related_to")).withColumn("confidence", F.lit(0.5))
