"""Chunking, statistics and ingest queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog.common import DIM, WS, once, sql_strip, sql_words
from tessera.functions.text import paragraphs, preview, sentences, word_count
from tessera.operators import chunking as ch
from tessera.operators import retention as ret
from tessera.operators import vectors as vec
from tessera.plans.registry import Catalog
from tessera.sources.embedding import embedded, hash_embedder
from tessera.sources.tables import table

C = Catalog()
WINDOW, OVERLAP = 64, 8


def _sentences(x: str) -> str:
    cut = f"string_split(regexp_replace({x}, '([.!?]){WS}(\\p{{Lu}})', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: {sql_strip('s')}), lambda s: s <> '')"


def _paragraphs(x: str) -> str:
    cut = f"string_split(replace({x}, chr(13) || chr(10), chr(10)), chr(10) || chr(10))"
    return f"list_filter(list_transform({cut}, lambda s: {sql_strip('s')}), lambda s: s <> '')"


def _tokens(x: str) -> str:
    return f"len({sql_words(x)})"


@C.query(f"SELECT doc_id, CAST(len({sql_words('text')}) AS BIGINT) AS n_tokens FROM documents WHERE text IS NOT NULL")
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", word_count(F.col("text")).cast("long").alias("n_tokens"))


@C.query(f"SELECT doc_id, generate_subscripts(s, 1) - 1 AS sentence_index, unnest(s) AS sentence FROM (SELECT doc_id, {_sentences('text')} AS s FROM documents WHERE text IS NOT NULL)")
def split_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("sentence_index", "sentence"))
    return rows.withColumn("sentence_index", F.col("sentence_index").cast("long"))


@C.query(f"SELECT doc_id, generate_subscripts(s, 1) - 1 AS paragraph_index, unnest(s) AS paragraph FROM (SELECT doc_id, {_paragraphs('text')} AS s FROM documents WHERE text IS NOT NULL)")
def split_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("paragraph_index", "paragraph"))
    return rows.withColumn("paragraph_index", F.col("paragraph_index").cast("long"))


def _fixed_sql(window: int, step: int) -> str:
    return f"""w AS (SELECT doc_id, {sql_words('text')} AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(CAST(greatest(1, CAST(ceil((len(w) - {window}) / {step}.0) AS BIGINT) + 1) AS BIGINT))) AS chunk_index FROM w WHERE len(w) > 0),
fixed AS (SELECT doc_id, chunk_index, array_to_string(w[chunk_index * {step} + 1 : chunk_index * {step} + {window}], ' ') AS content, CAST(len(w[chunk_index * {step} + 1 : chunk_index * {step} + {window}]) AS BIGINT) AS token_count FROM i)"""


@C.query(f"WITH {_fixed_sql(64, 56)} SELECT * FROM fixed")
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    return ch.fixed_chunks(table(spark, d, "documents"), "doc_id", "text", WINDOW, OVERLAP)


@C.query(f"WITH {_fixed_sql(64, 48)} SELECT * FROM fixed")
def chunk_fixed_overlap_guard(spark: SparkSession, d: str) -> DataFrame:
    """An overlap that reaches the window is a quarter of it."""
    return ch.fixed_chunks(table(spark, d, "documents"), "doc_id", "text", WINDOW, 70)


def _windows_of(x: str, limit: str, step: str) -> str:
    w = sql_words(x)
    n = f"CAST(greatest(1, CAST(ceil((len({w}) - {limit}) / CAST({step} AS DOUBLE)) AS BIGINT) + 1) AS BIGINT)"
    return f"list_transform(range({n}), lambda k: struct_pack(c := array_to_string(({w})[k * {step} + 1 : k * {step} + {limit}], ' '), n := CAST(len(({w})[k * {step} + 1 : k * {step} + {limit}]) AS BIGINT)))"


def _fold_sql(p: str, glue: str, oversize: str, joined: str = "", breaks: str = "false") -> str:
    """Greedy packing as a recursive query, one step a unit, of {p}u (doc_id, part, u, lim, step); {p}k holds the chunks as [content, tokens] structs."""
    flush = "CASE WHEN cur IS NULL THEN done ELSE list_append(done, struct_pack(c := cur, n := tok)) END"
    over, full = "ns[i + 1] > lim", f"cur IS NOT NULL AND (tok + ns[i + 1] > lim OR {breaks})"
    return f"""{p}n AS (SELECT *, list_transform(u, lambda x: {_tokens('x')}) AS ns FROM {p}u),
{p}f AS (SELECT doc_id, part, 0 AS i, CAST([] AS STRUCT(c VARCHAR, n BIGINT)[]) AS done, CAST(NULL AS VARCHAR) AS cur, CAST(0 AS BIGINT) AS tok FROM {p}n
  UNION ALL SELECT f.doc_id, f.part, i + 1,
    CASE WHEN {over} THEN list_concat({flush}, {oversize}) WHEN {full} THEN {flush} ELSE done END,
    CASE WHEN {over} THEN NULL WHEN cur IS NULL OR {full} THEN u[i + 1] ELSE cur || {glue} || u[i + 1] END,
    CASE WHEN {over} THEN 0 WHEN cur IS NULL OR {full} THEN ns[i + 1] ELSE tok + ns[i + 1] END
  FROM {p}f f JOIN {p}n n ON n.doc_id = f.doc_id AND n.part = f.part {joined} WHERE i < len(u)),
{p}k AS (SELECT f.doc_id, f.part, {flush} AS k FROM {p}f f JOIN {p}n n ON n.doc_id = f.doc_id AND n.part = f.part WHERE i = len(u))"""


def sql_hashed(word: str) -> tuple[str, str]:
    """Dimension and sign that the offline embedder gives a word."""
    return f"CAST('0x' || md5({word})[1:8] AS BIGINT) % {DIM}", f"CASE WHEN CAST('0x' || md5({word})[9:10] AS BIGINT) & 1 = 1 THEN 1 ELSE -1 END"


def _chunks_sql(config: str) -> str:
    """Chunks of g (doc_id, text, strategy, lim, step), which `config` selects."""
    dim, sign = sql_hashed("w")
    u = "len(u) >= 6"  # two windows of three sentences
    windows = _windows_of("u[i + 1]", "lim", "step")
    return f"""WITH RECURSIVE g AS ({config}),
sents AS (SELECT doc_id, strategy, {_sentences('text')} AS u, lim, step FROM g WHERE strategy IN ('sentence', 'semantic')),
paras AS (SELECT doc_id, 0 AS part, {_paragraphs('text')} AS u, lim, step FROM g WHERE strategy = 'paragraph'),
long AS (SELECT doc_id, part, p, lim, step FROM (SELECT doc_id, unnest(u) AS p, generate_subscripts(u, 1) AS part, lim, step FROM paras) WHERE {_tokens('p')} > lim),
su AS (SELECT doc_id, 0 AS part, u, lim, step FROM sents WHERE strategy = 'sentence' OR NOT {u} UNION ALL SELECT doc_id, part, {_sentences('p')}, lim, step FROM long),
{_fold_sql('s', "' '", windows)},
pu AS (SELECT * FROM paras),
{_fold_sql('p', "chr(10) || chr(10)", 'sk.k', 'LEFT JOIN sk ON sk.doc_id = f.doc_id AND sk.part = f.i + 1')},
mu AS (SELECT doc_id, 0 AS part, u, lim, step FROM sents WHERE strategy = 'semantic' AND {u}),
mw AS (SELECT doc_id, j, unnest({sql_words("lower(array_to_string(u[j + 1 : j + 3], ' '))")}) AS w FROM (SELECT doc_id, u, unnest(range(len(u) - 2)) AS j FROM mu)),
mv AS (SELECT doc_id, j, {dim} AS dim, sum({sign}) AS x FROM mw GROUP BY ALL),
mq AS (SELECT doc_id, j, sum(x * x) AS nn FROM mv GROUP BY ALL),
md AS (SELECT a.doc_id, a.j, sum(a.x * b.x) AS dot FROM mv a JOIN mv b ON b.doc_id = a.doc_id AND b.j = a.j + 1 AND b.dim = a.dim GROUP BY ALL),
mb AS (SELECT a.doc_id, a.j + 3 AS at FROM mq a JOIN mq b ON b.doc_id = a.doc_id AND b.j = a.j + 1 LEFT JOIN md ON md.doc_id = a.doc_id AND md.j = a.j WHERE coalesce(round(dot / nullif(sqrt(a.nn) * sqrt(b.nn), 0), 9), 0) < 0.5),
{_fold_sql('m', "' '", windows, 'LEFT JOIN mb ON mb.doc_id = f.doc_id AND mb.at = f.i', 'mb.at IS NOT NULL')},
k AS (SELECT doc_id, k FROM sk WHERE part = 0 UNION ALL SELECT doc_id, k FROM pk UNION ALL SELECT doc_id, k FROM mk
  UNION ALL SELECT doc_id, {_windows_of('text', 'lim', 'step')} FROM g WHERE strategy NOT IN ('sentence', 'paragraph', 'semantic') AND {_tokens('text')} > 0),
chunked AS (SELECT doc_id, generate_subscripts(k, 1) - 1 AS chunk_index, unnest(k).c AS content, unnest(k).n AS token_count FROM k)"""


def _all_by(strategy: str) -> str:
    return f"SELECT doc_id, text, '{strategy}' AS strategy, CAST({WINDOW} AS BIGINT) AS lim, CAST({WINDOW - OVERLAP} AS BIGINT) AS step FROM documents WHERE text IS NOT NULL"


@C.query(_chunks_sql(_all_by("sentence")) + " SELECT * FROM chunked")
def chunk_sentence(spark: SparkSession, d: str) -> DataFrame:
    return ch.text_chunks(table(spark, d, "documents"), "doc_id", "text", lambda t: ch.sentence_chunks(t, WINDOW, OVERLAP))


@C.query(_chunks_sql(_all_by("paragraph")) + " SELECT * FROM chunked")
def chunk_paragraph(spark: SparkSession, d: str) -> DataFrame:
    return ch.text_chunks(table(spark, d, "documents"), "doc_id", "text", lambda t: ch.paragraph_chunks(t, WINDOW, OVERLAP))


@C.query(_chunks_sql(_all_by("semantic")) + " SELECT * FROM chunked")
def chunk_semantic(spark: SparkSession, d: str) -> DataFrame:
    embed = hash_embedder(DIM)
    return ch.text_chunks(table(spark, d, "documents"), "doc_id", "text", lambda t: ch.semantic_chunks(t, WINDOW, OVERLAP, embed))


_SETTINGS = """SELECT doc_id, text, strategy, lim, greatest(1, lim - CASE WHEN ov < lim THEN ov ELSE lim // 4 END) AS step FROM (
SELECT doc_id, text, coalesce(lower(trim(c.chunk_config.strategy)), '') AS strategy, CAST(CASE WHEN c.chunk_config.max_tokens > 0 THEN c.chunk_config.max_tokens ELSE 512 END AS BIGINT) AS lim, CAST(greatest(coalesce(c.chunk_config.overlap, 0), 0) AS BIGINT) AS ov
FROM documents d LEFT JOIN collections c ON c.id = d.collection_id WHERE text IS NOT NULL)"""


@C.query(_chunks_sql(_SETTINGS) + " SELECT * FROM chunked")
def chunk_by_collection(spark: SparkSession, d: str) -> DataFrame:
    """Each document by the strategy, limit and overlap of its collection."""
    config = table(spark, d, "collections").select(F.col("id").alias("collection_id"), "chunk_config")
    docs = table(spark, d, "documents").select("doc_id", "collection_id", "text").join(config, "collection_id", "left")
    return ch.collection_chunks(docs, "doc_id", "text", "chunk_config", hash_embedder(DIM))


@C.query(
    f"""WITH {_fixed_sql(64, 56)}, n AS (SELECT doc_id, chunk_index, coalesce(lag(content) OVER w, '') AS context_before, coalesce(lead(content) OVER w, '') AS context_after FROM fixed WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index))
SELECT * FROM n"""
)
def chunk_context_window(spark: SparkSession, d: str) -> DataFrame:
    return ch.fixed_chunks(table(spark, d, "documents"), "doc_id", "text", WINDOW, OVERLAP, around=1).select("doc_id", "chunk_index", "context_before", "context_after")


_CH = "c AS (SELECT DISTINCT ON (id) * FROM chunks)"
_STATS = f"""WITH {_CH}, dd AS (SELECT collection_id, count(*) AS n_documents, max(created_at) AS last_document_at FROM documents GROUP BY 1), cc AS (SELECT collection_id, count(*) AS n_chunks, CAST(coalesce(sum(token_count), 0) AS BIGINT) AS n_tokens FROM c GROUP BY 1),
s AS (SELECT id AS collection_id, name, coalesce(n_documents, 0) AS n_documents, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_tokens, 0) AS n_tokens, last_document_at FROM collections LEFT JOIN dd ON dd.collection_id = id LEFT JOIN cc ON cc.collection_id = id)"""


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return ret.collection_stats(table(spark, d, "documents"), once(spark, d, "chunks"), table(spark, d, "collections"))


@C.query(_STATS + " SELECT * FROM s")
def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d)


@C.query(_STATS + " SELECT collection_id, round(coalesce(n_tokens / nullif(n_chunks, 0), 0), 6) AS avg_tokens FROM s")
def collection_avg_chunk(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d).select("collection_id", F.round(F.coalesce(F.try_divide("n_tokens", "n_chunks"), F.lit(0.0)), 6).alias("avg_tokens"))


@C.query(f"WITH {_CH} SELECT h.id AS hit_id, c.id, c.chunk_index FROM c h JOIN c ON c.document_id = h.document_id AND c.chunk_index BETWEEN h.chunk_index - 1 AND h.chunk_index + 1 WHERE h.chunk_index % 3 = 1")
def adjacent_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every third chunk of each document with the chunks beside it. Chunks are shared out to the hits they lie beside, so the join is one of equal keys."""
    rows = once(spark, d, "chunks").select("id", "document_id", "chunk_index").where("document_id IS NOT NULL")
    hits = rows.where("chunk_index % 3 = 1").select(F.col("id").alias("hit_id"), "document_id", F.col("chunk_index").alias("at"))
    beside = rows.withColumn("at", F.explode(F.array(F.col("chunk_index") - 1, F.col("chunk_index"), F.col("chunk_index") + 1)))
    return hits.join(beside, ["document_id", "at"]).select("hit_id", "id", "chunk_index")


_CACHED = ",".join(["9"] * DIM)


@C.query(
    f"""WITH t AS (SELECT DISTINCT sha256(coalesce(text, '')) AS text_hash, coalesce(text, '') AS text FROM documents), e AS (SELECT DISTINCT sha256(coalesce(text, '')) AS text_hash FROM documents WHERE lang = 'en'),
w AS (SELECT text_hash, unnest({sql_words('lower(text)')}) AS w FROM t), v AS (SELECT text_hash, {sql_hashed('w')[0]} AS dim, CAST(sum({sql_hashed('w')[1]}) AS BIGINT) AS x FROM w GROUP BY ALL),
l AS (SELECT text_hash, map(list(dim), list(x)) AS m FROM v GROUP BY ALL)
SELECT d.doc_id, CASE WHEN e.text_hash IS NOT NULL THEN '{_CACHED}' ELSE array_to_string(list_transform(range({DIM}), lambda i: coalesce(m[i], 0)), ',') END AS vector
FROM documents d LEFT JOIN l ON l.text_hash = sha256(coalesce(d.text, '')) LEFT JOIN e ON e.text_hash = sha256(coalesce(d.text, ''))"""
)
def embedding_cache_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Documents embedded through a cache that holds the English texts (as nines): no text of the cache goes to the embedder, the others once each."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    cache = docs.where("lang = 'en'").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash")).distinct()
    cache = cache.withColumn("embedding", F.array_repeat(F.lit(9.0).cast("float"), DIM))
    rows = embedded(docs, "text", hash_embedder(DIM), DIM, cache)
    return rows.select("doc_id", F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), ",").alias("vector"))


@C.query("SELECT id, namespace, name, chunk_config.strategy AS strategy FROM collections WHERE id = 'col-007'")
def collection_by_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "collections").where("id = 'col-007'").select("id", "namespace", "name", F.col("chunk_config.strategy").alias("strategy"))


_FIRST = "(SELECT min(d.id) FROM documents d JOIN chunks c ON c.document_id = d.id)"


def _first(spark: SparkSession, d: str) -> str:
    """The first document that has chunks."""
    docs = table(spark, d, "documents").select("id")
    return docs.join(table(spark, d, "chunks").select(F.col("document_id").alias("id")), "id", "left_semi").agg(F.min("id")).first()[0]


@C.query(f"SELECT id, namespace, collection_id, title, text FROM documents WHERE id = {_FIRST}")
def document_by_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("id") == _first(spark, d)).select("id", "namespace", "collection_id", "title", "text")


@C.query(f"WITH {_CH} SELECT document_id, chunk_index, max(struct_pack(a := created_at, i := id)).i AS id FROM c WHERE embedding IS NOT NULL AND len(embedding) > 0 AND document_id IS NOT NULL AND created_at IS NOT NULL GROUP BY 1, 2")
def embedding_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The latest vector of each place in each document."""
    rows = table(spark, d, "chunks").where("size(embedding) > 0 AND document_id IS NOT NULL AND created_at IS NOT NULL").select("document_id", "chunk_index", "created_at", "id", "embedding")
    return vec.upserted(rows, ["document_id", "chunk_index"], ["created_at", "id"]).select("document_id", "chunk_index", "id")


@C.query(f"WITH {_fixed_sql(64, 56)}, k AS (SELECT doc_id, count(*) AS n FROM fixed GROUP BY 1) SELECT d.doc_id, coalesce(k.n, 0) > 0 AS succeeded, coalesce(k.n, 0) AS n_chunks FROM documents d LEFT JOIN k USING (doc_id)")
def bulk_ingest_results(spark: SparkSession, d: str) -> DataFrame:
    """Per document: whether it gave chunks, and how many. An empty document fails."""
    docs = table(spark, d, "documents")
    n = ch.fixed_chunks(docs, "doc_id", "text", WINDOW, OVERLAP).groupBy("doc_id").agg(F.count("*").alias("n"))
    return docs.select("doc_id").join(n, "doc_id", "left").select("doc_id", (F.coalesce("n", F.lit(0)) > 0).alias("succeeded"), F.coalesce("n", F.lit(0)).alias("n_chunks"))


@C.query(f"WITH {_fixed_sql(64, 56)}, k AS (SELECT doc_id, count(*) AS n FROM fixed GROUP BY 1), r AS (SELECT d.doc_id, coalesce(k.n, 0) AS n FROM documents d LEFT JOIN k USING (doc_id)) SELECT count(*) FILTER (n > 0) AS succeeded, count(*) FILTER (n = 0) AS failed, CAST(sum(n) AS BIGINT) AS n_chunks FROM r")
def bulk_ingest_summary(spark: SparkSession, d: str) -> DataFrame:
    return bulk_ingest_results(spark, d).agg(F.count_if("succeeded").alias("succeeded"), F.count_if(~F.col("succeeded")).alias("failed"), F.sum("n_chunks").alias("n_chunks"))


@C.query(f"WITH {_CH} SELECT 'documents' AS section, id FROM documents WHERE id <> {_FIRST} UNION ALL SELECT 'chunks', id FROM c WHERE document_id IS NULL OR document_id <> {_FIRST}")
def delete_document_survivors(spark: SparkSession, d: str) -> DataFrame:
    """What is left when a document and its chunks are deleted."""
    docs = table(spark, d, "documents").select("id")
    gone = docs.where(F.col("id") == _first(spark, d))
    left = ret.without(once(spark, d, "chunks").select("id", "document_id"), gone, "document_id")
    return ret.without(docs, gone, "id").select(F.lit("documents").alias("section"), "id").unionByName(left.select(F.lit("chunks").alias("section"), "id"))


@C.query(f"WITH {_CH} SELECT 'collections' AS section, id FROM collections WHERE id <> 'col-007' UNION ALL SELECT 'documents', id FROM documents WHERE collection_id IS DISTINCT FROM 'col-007' UNION ALL SELECT 'chunks', id FROM c WHERE collection_id IS DISTINCT FROM 'col-007'")
def delete_collection_survivors(spark: SparkSession, d: str) -> DataFrame:
    """What is left when a collection is deleted with its documents and chunks."""
    tables = {"collections": table(spark, d, "collections"), "documents": table(spark, d, "documents"), "chunks": once(spark, d, "chunks")}
    gone = tables["collections"].where("id = 'col-007'").select("id")
    parts = [ret.without(df, gone, "id" if n == "collections" else "collection_id").select(F.lit(n).alias("section"), "id") for n, df in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@C.query("SELECT id, coalesce(lower(trim(chunk_config.strategy)), 'fixed') AS strategy, CASE WHEN chunk_config.max_tokens > 0 THEN chunk_config.max_tokens ELSE 512 END AS max_tokens, greatest(coalesce(chunk_config.overlap, 0), 0) AS overlap FROM collections")
def chunk_configs(spark: SparkSession, d: str) -> DataFrame:
    """Chunk settings after a round trip through JSON, with defaults for what is missing."""
    text = table(spark, d, "collections").select("id", F.to_json("chunk_config").alias("j"))
    c = F.from_json("j", "strategy string, max_tokens int, overlap int")
    limit = F.when(c["max_tokens"] > 0, c["max_tokens"]).otherwise(512)
    return text.select("id", F.coalesce(F.lower(F.trim(c["strategy"])), F.lit("fixed")).alias("strategy"), limit.alias("max_tokens"), F.greatest(F.coalesce(c["overlap"], F.lit(0)), F.lit(0)).alias("overlap"))


_DIM_OF, _SIGN_OF = sql_hashed("w")


@C.query(
    f"""WITH {_fixed_sql(64, 56)}, hw AS (SELECT doc_id, chunk_index, unnest({sql_words('lower(content)')}) AS w FROM fixed),
v AS (SELECT doc_id, chunk_index, {_DIM_OF} AS dim, CAST(sum({_SIGN_OF}) AS BIGINT) AS x FROM hw GROUP BY ALL),
l AS (SELECT doc_id, chunk_index, map(list(dim), list(x)) AS m FROM v GROUP BY ALL)
SELECT doc_id, chunk_index, token_count, array_to_string(list_transform(range({DIM}), lambda i: coalesce(m[i], 0)), ',') AS vector FROM fixed JOIN l USING (doc_id, chunk_index)"""
)
def ingest_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Documents to embedded chunks: chunked by windows, each distinct chunk embedded once. The offline embedder's vectors hold whole numbers."""
    chunks = ch.fixed_chunks(table(spark, d, "documents"), "doc_id", "text", WINDOW, OVERLAP)
    rows = embedded(chunks, "content", hash_embedder(DIM), DIM)
    return rows.select("doc_id", "chunk_index", "token_count", F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), ",").alias("vector"))


@C.query("SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 77) || '...' ELSE text END AS preview FROM documents WHERE text IS NOT NULL")
def truncate_preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", preview(F.col("text"), 80).alias("preview"))


QUERIES, ORACLE = C.QUERIES, C.ORACLE
