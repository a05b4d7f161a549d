"""Entity queries: names, aliases, resolution, mentions, relationships, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.catalog.common import once, sql_strip, sql_words
from tessera.functions.similarity import initialism, similarity
from tessera.operators import entities as ent
from tessera.operators.conversation import page
from tessera.plans.registry import Catalog
from tessera.sources.tables import table

C = Catalog()
NS = "atlas-00000"


def _long(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("long"))
    return df


@C.query(f"SELECT id, name, row_number() OVER (ORDER BY name, id) AS position FROM entities WHERE namespace = '{NS}' AND name > 'C' ORDER BY name, id LIMIT 51")
def entity_list_by_name(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entities").where(F.col("namespace") == NS).select("id", "name")
    return _long(page(rows, "name", "id", 50, ("C", "￿"), descending=False), "position")


@C.query(f"SELECT id, mention_count, row_number() OVER (ORDER BY mention_count DESC, id) AS position FROM entities WHERE namespace = '{NS}' AND (mention_count < 9 OR mention_count = 9 AND id > 'ent-000000100') ORDER BY mention_count DESC, id LIMIT 51")
def entity_list_by_mention_count(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entities").where(F.col("namespace") == NS).select("id", "mention_count")
    return _long(page(rows, "mention_count", "id", 50, (9, "ent-000000100")), "position")


@C.query(f"SELECT id, last_seen_at, row_number() OVER (ORDER BY last_seen_at DESC NULLS LAST, id) AS position FROM entities WHERE namespace = '{NS}' AND type = 'person' ORDER BY last_seen_at DESC NULLS LAST, id LIMIT 51")
def entity_list_by_last_seen(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entities").where((F.col("namespace") == NS) & (F.col("type") == "person")).select("id", "last_seen_at")
    return _long(page(rows, "last_seen_at", "id", 50), "position")


_X = "x AS (SELECT DISTINCT ON (id) * FROM extracted_entities)"


@C.query(f"WITH {_X} SELECT x.id, e.id AS entity_id FROM x JOIN entities e ON e.namespace = x.namespace AND lower(e.name) = lower(x.name)")
def entity_by_name_ci(spark: SparkSession, d: str) -> DataFrame:
    x = once(spark, d, "extracted_entities").select("id", "namespace", F.lower("name").alias("low"))
    return x.join(table(spark, d, "entities").select("namespace", F.lower("name").alias("low"), F.col("id").alias("entity_id")), ["namespace", "low"]).select("id", "entity_id")


_ALIASES = "al AS (SELECT namespace, alias, min(struct_pack(f := first_seen_at, id := id)).id AS entity_id FROM (SELECT namespace, id, first_seen_at, unnest(list_distinct(list_transform(list_concat([name], coalesce(aliases, CAST([] AS VARCHAR[]))), lambda a: lower(a)))) AS alias FROM entities) WHERE alias IS NOT NULL GROUP BY 1, 2)"


@C.query(f"WITH {_ALIASES} SELECT * FROM al")
def alias_table_build(spark: SparkSession, d: str) -> DataFrame:
    return ent.alias_table(table(spark, d, "entities"))


@C.query(f"WITH {_ALIASES}, {_X} SELECT x.id, al.entity_id, e.name FROM x JOIN al ON al.namespace = x.namespace AND al.alias = lower(x.name) JOIN entities e ON e.id = al.entity_id")
def alias_resolve(spark: SparkSession, d: str) -> DataFrame:
    entities = table(spark, d, "entities")
    x = once(spark, d, "extracted_entities").select("id", "namespace", F.lower("name").alias("alias"))
    return x.join(ent.alias_table(entities), ["namespace", "alias"]).join(entities.select(F.col("id").alias("entity_id"), "name"), "entity_id").select("id", "entity_id", "name")


@C.query(
    f"""WITH {_X} SELECT namespace, lower(name) AS key, max(struct_pack(a := extracted_at, i := id, n := name)).n AS name, max(struct_pack(a := extracted_at, i := id, n := type)).n AS type,
array_to_string(list_sort(list_distinct(list_filter(flatten(list(coalesce(aliases, CAST([] AS VARCHAR[])))), lambda a: a IS NOT NULL))), '|') AS aliases, count(*) AS n_observations, min(extracted_at) AS first_seen_at, max(extracted_at) AS last_seen_at FROM x GROUP BY 1, 2"""
)
def entity_upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return ent.upserted(once(spark, d, "extracted_entities")).withColumn("aliases", F.array_join("aliases", "|"))


def _sql_initials(x: str) -> str:
    w = sql_words(x)
    return f"CASE WHEN len({w}) <= 1 THEN '' ELSE upper(array_to_string(list_transform(list_filter({w}, lambda w: lower(w) NOT IN ('the', 'of', 'and', 'a', 'an')), lambda w: left(w, 1)), '')) END"


@C.query(f"SELECT id, {_sql_initials('name')} AS initials FROM entities")
def initialisms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").select("id", initialism(F.col("name")).alias("initials"))


_SIM = "CASE WHEN {0} = {1} THEN 1.0 WHEN strlen({0}) = 0 OR strlen({1}) = 0 THEN 0.0 ELSE 1.0 - CAST(levenshtein({0}, {1}) AS DOUBLE) / greatest(strlen({0}), strlen({1})) END"


@C.query(f"WITH p AS (SELECT id, lower(name) AS a, lower(alias) AS b FROM (SELECT id, name, unnest(aliases) AS alias FROM entities)) SELECT id, a, b, round({_SIM.format('a', 'b')}, 6) AS similarity FROM p WHERE b IS NOT NULL")
def string_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Each entity's name against each of its aliases."""
    rows = table(spark, d, "entities").select("id", F.lower("name").alias("a"), F.explode("aliases").alias("alias")).where("alias IS NOT NULL").select("id", "a", F.lower("alias").alias("b"))
    return rows.select("id", "a", "b", F.round(similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


_RESOLVE = f"""WITH {_ALIASES}, {_X},
q AS (SELECT DISTINCT namespace, {sql_strip('name')} AS name FROM x WHERE {sql_strip('name')} <> ''),
ex AS (SELECT q.namespace, q.name, min(e.id) AS exact_id FROM q JOIN entities e ON e.namespace = q.namespace AND lower(e.name) = lower(q.name) GROUP BY 1, 2),
ba AS (SELECT q.namespace, q.name, al.entity_id AS alias_id FROM q JOIN al ON al.namespace = q.namespace AND al.alias = lower(q.name)),
lf AS (SELECT *, {_sql_initials('name')} AS ini FROM q WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.namespace = q.namespace AND ex.name = q.name) AND NOT EXISTS (SELECT 1 FROM ba WHERE ba.namespace = q.namespace AND ba.name = q.name)),
ei AS (SELECT *, {_sql_initials('name')} AS ini FROM entities),
cand AS (SELECT l.namespace, l.name, e.id, e.name AS en, {_SIM.format('lower(l.name)', 'lower(e.name)')} AS s FROM lf l JOIN ei e ON e.namespace = l.namespace
  AND ((length(l.name) >= 3 AND length(e.name) >= 3 AND left(lower(l.name), 3) = left(lower(e.name), 3)) OR (l.ini <> '' AND l.ini = e.ini))),
fz AS (SELECT namespace, name, id AS fuzzy_id, s FROM cand WHERE s >= 0.85 QUALIFY row_number() OVER (PARTITION BY namespace, name ORDER BY s DESC, en, id) = 1),
res AS (SELECT namespace, name, coalesce(exact_id, alias_id, fuzzy_id, '') AS entity_id,
  round(CASE WHEN exact_id IS NOT NULL THEN 1.0 WHEN alias_id IS NOT NULL THEN 0.95 ELSE coalesce(s, 0) END, 6) AS confidence,
  CASE WHEN exact_id IS NOT NULL THEN 'exact' WHEN alias_id IS NOT NULL THEN 'alias' WHEN fuzzy_id IS NOT NULL THEN 'fuzzy' ELSE 'new' END AS match
  FROM q LEFT JOIN ex USING (namespace, name) LEFT JOIN ba USING (namespace, name) LEFT JOIN fz USING (namespace, name))
"""


@C.query(_RESOLVE + "SELECT * FROM res")
def resolve_cascade(spark: SparkSession, d: str) -> DataFrame:
    return ent.resolved(once(spark, d, "extracted_entities"), table(spark, d, "entities")).withColumn("confidence", F.round("confidence", 6))


@C.query(_RESOLVE + "SELECT namespace, name, entity_id, confidence FROM res WHERE match = 'fuzzy'")
def resolve_blocked_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    got = ent.resolved(once(spark, d, "extracted_entities"), table(spark, d, "entities"))
    return got.where("match = 'fuzzy'").select("namespace", "name", "entity_id", F.round("confidence", 6).alias("confidence"))


_ALL = _RESOLVE.replace("q AS (SELECT DISTINCT namespace", "xn AS (SELECT id, namespace, 0 AS n, name FROM x UNION ALL SELECT id, namespace, CAST(generate_subscripts(aliases, 1) AS INTEGER), unnest(aliases) FROM x), q AS (SELECT DISTINCT namespace").replace(
    "FROM x WHERE", "FROM xn WHERE"
)


@C.query(
    _ALL
    + f"""SELECT xn.id, res.entity_id, res.confidence, res.match FROM xn JOIN res ON res.namespace = xn.namespace AND res.name = {sql_strip('xn.name')} WHERE match <> 'new' QUALIFY row_number() OVER (PARTITION BY xn.id ORDER BY n) = 1"""
)
def resolve_extracted(spark: SparkSession, d: str) -> DataFrame:
    """Each extracted entity by its name, else by its aliases in order."""
    got = ent.resolved_with_aliases(once(spark, d, "extracted_entities"), table(spark, d, "entities"))
    return got.select("id", "entity_id", F.round("confidence", 6).alias("confidence"), "match")


@C.query(f"WITH {_ALIASES}, {_X}, r AS (SELECT e.namespace, lower(x.name) AS alias, max(struct_pack(a := x.extracted_at, i := x.id, e := e.id)).e AS owner FROM x JOIN entities e ON e.namespace = x.namespace AND lower(e.name) = lower(x.name) GROUP BY 1, 2) SELECT namespace, alias, coalesce(r.owner, al.entity_id) AS entity_id FROM al FULL JOIN r USING (namespace, alias)")
def alias_register(spark: SparkSession, d: str) -> DataFrame:
    """Names seen again are registered as aliases; the latest registration owns an alias."""
    entities = table(spark, d, "entities")
    x = once(spark, d, "extracted_entities").select("namespace", F.lower("name").alias("alias"), F.col("extracted_at").alias("at"), "id")
    seen = x.join(entities.select("namespace", F.lower("name").alias("alias"), F.col("id").alias("entity_id")), ["namespace", "alias"])
    return ent.registered(ent.alias_table(entities), seen)


@C.query(f"WITH {_X} SELECT e.id FROM entities e WHERE e.id <> 'ent-000000007'")
def delete_entity_survivors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").where("id != 'ent-000000007'").select("id")


_MN = "mn AS (SELECT DISTINCT ON (id) * FROM entity_mentions)"


@C.query(f"WITH {_MN} SELECT id, entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC NULLS LAST, id) AS rank FROM mn QUALIFY rank <= 20")
def entity_mentions_recent(spark: SparkSession, d: str) -> DataFrame:
    return _long(ent.recent_mentions(once(spark, d, "entity_mentions").select("id", "entity_id", "created_at"), 20).select("id", "entity_id", "rank"), "rank")


@C.query(f"WITH {_MN} SELECT entity_id, count(*) AS mention_count, min(created_at) AS first_seen_at, max(created_at) AS last_seen_at FROM mn GROUP BY 1")
def mention_counters(spark: SparkSession, d: str) -> DataFrame:
    return ent.mention_counters(once(spark, d, "entity_mentions"))


def observed(spark: SparkSession, d: str) -> DataFrame:
    """Relationship observations: a supplier supplies a part, once a line item."""
    return table(spark, d, "lineitem").select(
        F.lit("g").alias("namespace"), F.concat(F.lit("s"), "l_suppkey").alias("source_entity_id"), F.concat(F.lit("p"), "l_partkey").alias("target_entity_id"), F.lit("supplies").alias("relation_type"),
        (1 - F.col("l_discount")).alias("confidence"), F.col("l_shipdate").alias("seen_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seen_id"),
        F.nullif("l_returnflag", F.lit("N")).alias("description"),
    )


_E = """o AS (SELECT 'g' AS namespace, 's' || l_suppkey AS source_entity_id, 'p' || l_partkey AS target_entity_id, 'supplies' AS relation_type, 1 - l_discount AS confidence, l_shipdate AS seen_at, l_orderkey * 10 + l_linenumber AS seen_id, nullif(l_returnflag, 'N') AS description FROM lineitem),
e AS (SELECT namespace, source_entity_id, target_entity_id, relation_type, (max(struct_pack(a := seen_at, i := seen_id, d := description)) FILTER (description IS NOT NULL)).d AS description, round(max(struct_pack(a := seen_at, i := seen_id, c := confidence)).c, 6) AS confidence, count(*) AS mention_count, min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at FROM o GROUP BY 1, 2, 3, 4)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return ent.relationships(observed(spark, d)).withColumn("confidence", F.round("confidence", 6))


@C.query(f"WITH {_E} SELECT * FROM e")
def relationship_upsert(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


def _ranked(where: str) -> str:
    return f"WITH {_E} SELECT *, row_number() OVER (ORDER BY mention_count DESC, last_seen_at DESC, source_entity_id, target_entity_id) AS position FROM e WHERE {where} ORDER BY position LIMIT 50"


def _edges_of(spark: SparkSession, d: str, entity: str, direction: str) -> DataFrame:
    """The fifty most mentioned edges, the latest first among equals."""
    order = (F.desc("mention_count"), F.desc("last_seen_at"), "source_entity_id", "target_entity_id")
    first = ent.edges_of(_edges(spark, d), entity, direction).orderBy(*order).limit(50)
    return _long(first.withColumn("position", F.row_number().over(Window.orderBy(*order))), "position")


@C.query(_ranked("source_entity_id = 's7'"))
def relationships_outgoing(spark: SparkSession, d: str) -> DataFrame:
    return _edges_of(spark, d, "s7", "outgoing")


@C.query(_ranked("target_entity_id = 'p7'"))
def relationships_incoming(spark: SparkSession, d: str) -> DataFrame:
    return _edges_of(spark, d, "p7", "incoming")


@C.query(_ranked("(source_entity_id = 'p7' OR target_entity_id = 'p7')"))
def relationships_both(spark: SparkSession, d: str) -> DataFrame:
    return _edges_of(spark, d, "p7", "both")


_TOGETHER = """p AS (SELECT DISTINCT namespace, source_id, entity_id FROM mn WHERE lower(trim(source_type)) = 'conversation' AND trim(source_id) <> ''),
co AS (SELECT a.entity_id AS a, b.entity_id AS b, count(*) AS n FROM p a JOIN p b ON a.namespace = b.namespace AND a.source_id = b.source_id AND a.entity_id < b.entity_id GROUP BY 1, 2),
rel AS (SELECT id, count(*) AS n_related, CAST(sum(n) AS BIGINT) AS n_together FROM (SELECT a AS id, n FROM co UNION ALL SELECT b, n FROM co) GROUP BY 1)"""


@C.query(
    f"""WITH {_MN}, {_TOGETHER}, r AS (SELECT entity_id, id, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC NULLS LAST, id) AS n FROM mn)
SELECT e.id, e.name, e.type, coalesce(string_agg(r.id, '|' ORDER BY r.n), '') AS mentions, count(r.id) AS n_mentions, coalesce(any_value(n_related), 0) AS n_related, coalesce(any_value(n_together), 0) AS n_together
FROM entities e LEFT JOIN r ON r.entity_id = e.id AND r.n <= 10 LEFT JOIN rel ON rel.id = e.id GROUP BY 1, 2, 3"""
)
def entity_360(spark: SparkSession, d: str) -> DataFrame:
    """Each entity with its ten latest mentions, and the entities it is mentioned with in one message."""
    mentions = once(spark, d, "entity_mentions").select("id", "entity_id", "namespace", "source_type", "source_id", "created_at")
    top = ent.recent_mentions(mentions.select("id", "entity_id", "created_at"), 10)
    listed = top.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("m"))
    told = mentions.where("lower(trim(source_type)) = 'conversation' AND trim(source_id) <> '' AND namespace IS NOT NULL")
    edges = ent.co_mentions(told, ["namespace", "source_id"], "entity_id")
    ends = edges.select(F.col("a").alias("entity_id"), "n_texts").unionByName(edges.select(F.col("b").alias("entity_id"), "n_texts"))
    related = ends.groupBy("entity_id").agg(F.count("*").alias("n_related"), F.sum("n_texts").alias("n_together"))
    named = table(spark, d, "entities").select("id", "name", "type")
    joined = named.join(listed.withColumnRenamed("entity_id", "id"), "id", "left").join(related.withColumnRenamed("entity_id", "id"), "id", "left")
    return joined.select(
        "id", "name", "type", F.coalesce(F.array_join(F.transform("m", lambda x: x["id"]), "|"), F.lit("")).alias("mentions"), F.coalesce(F.size("m"), F.lit(0)).cast("long").alias("n_mentions"),
        F.coalesce("n_related", F.lit(0)).alias("n_related"), F.coalesce("n_together", F.lit(0)).alias("n_together"),
    )


@C.query(
    f"""WITH {_E}, mv AS (SELECT namespace, CASE source_entity_id WHEN 's7' THEN 's8' ELSE source_entity_id END AS source_entity_id, CASE target_entity_id WHEN 's7' THEN 's8' ELSE target_entity_id END AS target_entity_id, relation_type, mention_count, first_seen_at, last_seen_at FROM e)
SELECT namespace, source_entity_id, target_entity_id, relation_type, CAST(sum(mention_count) AS BIGINT) AS mention_count, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at FROM mv WHERE source_entity_id <> target_entity_id GROUP BY 1, 2, 3, 4"""
)
def entity_merge_edges(spark: SparkSession, d: str) -> DataFrame:
    return ent.merged_edges(_edges(spark, d), "s7", "s8")


_NEXT = "n AS (SELECT *, lead(id) OVER w AS other FROM entities WINDOW w AS (PARTITION BY namespace ORDER BY id))"


def _paired(spark: SparkSession, d: str) -> DataFrame:
    """Each entity (target) with the next of its namespace (source)."""
    e = table(spark, d, "entities")
    pairs = e.withColumn("other", F.lead("id").over(Window.partitionBy("namespace").orderBy("id"))).where("other IS NOT NULL")
    return pairs.alias("t").join(e.alias("s"), F.col("t.other") == F.col("s.id"))


@C.query(
    f"""WITH {_NEXT}, p AS (SELECT t.id, t.attributes AS ta, s.attributes AS sa, t.mention_count + s.mention_count AS mention_count, least(t.first_seen_at, s.first_seen_at) AS first_seen_at, greatest(t.last_seen_at, s.last_seen_at) AS last_seen_at FROM n t JOIN entities s ON s.id = t.other)
SELECT id, coalesce(ta['city'], sa['city'], '') AS city, mention_count, first_seen_at, last_seen_at FROM p"""
)
def entity_merge_attributes(spark: SparkSession, d: str) -> DataFrame:
    merged = ent.merged_attributes(F.col("s.attributes"), F.col("t.attributes"))
    return _paired(spark, d).select(
        "t.id", F.coalesce(F.try_element_at(merged, F.lit("city")), F.lit("")).alias("city"), (F.col("t.mention_count") + F.col("s.mention_count")).alias("mention_count"),
        F.least("t.first_seen_at", "s.first_seen_at").alias("first_seen_at"), F.greatest("t.last_seen_at", "s.last_seen_at").alias("last_seen_at"),
    )


_UNSEEN = "lower({0}) <> lower({1}) AND list_position(list_transform({2}, lambda y: lower(y)), lower({0})) = i"


@C.query(
    f"""WITH {_NEXT}, p AS (SELECT t.id, t.name, list_filter(list_concat(coalesce(t.aliases, CAST([] AS VARCHAR[])), [s.name], coalesce(s.aliases, CAST([] AS VARCHAR[]))), lambda x: x IS NOT NULL) AS al FROM n t JOIN entities s ON s.id = t.other)
SELECT id, array_to_string(list_filter(al, lambda x, i: {_UNSEEN.format('x', 'name', 'al')}), '|') AS aliases FROM p"""
)
def entity_merge_aliases(spark: SparkSession, d: str) -> DataFrame:
    merged = ent.merged_aliases(F.col("s.name"), F.col("s.aliases"), F.col("t.name"), F.col("t.aliases"))
    return _paired(spark, d).select("t.id", F.array_join(merged, "|").alias("aliases"))


@C.query(
    f"""WITH {_X}, p AS (SELECT DISTINCT source_id, lower(name) AS item FROM x WHERE source_id IS NOT NULL AND name IS NOT NULL)
SELECT a.item AS a, b.item AS b, count(*) AS n_texts, 'related_to' AS relation_type, CAST(0.5 AS DOUBLE) AS confidence FROM p a JOIN p b ON a.source_id = b.source_id AND a.item < b.item GROUP BY 1, 2"""
)
def comention_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = once(spark, d, "extracted_entities", "source_id IS NOT NULL AND name IS NOT NULL").select("source_id", F.lower("name").alias("item"))
    return ent.co_mentions(rows, ["source_id"], "item")


QUERIES, ORACLE = C.QUERIES, C.ORACLE
