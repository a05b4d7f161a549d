"""Vector, full-text and hybrid search queries."""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog.common import COS, DIM, GOOD, once, query_vector, sql_bm25, sql_terms, sql_words
from tessera.functions.similarity import cosine, cosine_to, dot
from tessera.operators import fulltext as ft
from tessera.operators import hybrid as hy
from tessera.operators import vectors as vec
from tessera.operators.ann import VectorIndex
from tessera.operators.postings import TextIndex
from tessera.plans.lineage import shared_dir, written
from tessera.plans.metrics import histogram
from tessera.plans.registry import Catalog
from tessera.sources import files
from tessera.sources.tables import table

C = Catalog()
K = 10

TEXT_QUERY = "latency checksum handbook of schedule"
TEXT_TERMS = ["latency", "checksum", "handbook", "of", "schedule"]
MESSAGE_QUERY = "the compiler renamed"
MESSAGE_TERMS = ["the", "compiler", "renamed"]

_CHUNKS = f"ch AS (SELECT DISTINCT ON (id) * FROM chunks), ok AS (SELECT * FROM ch WHERE {GOOD}), sc AS (SELECT *, {COS} AS cos FROM ok)"


def _top(source: str, cols: str, score: str, k: int, where: str = "true") -> str:
    return f"SELECT {cols}, round({score}, 6) AS score, row_number() OVER (ORDER BY cos DESC, id) AS rank FROM (SELECT * FROM {source} WHERE {where} ORDER BY cos DESC, id LIMIT {k})"


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols, F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@C.query(
    f"WITH {_CHUNKS}, hits AS ({_top('sc', 'id, document_id, chunk_index', '(1 + cos) / 2', K)}) SELECT hits.id, document_id, chunk_index, score, rank, d.title, d.source FROM hits LEFT JOIN documents d ON d.id = hits.document_id"
)
def vector_topk_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest chunks, with title and source of their documents joined behind the cut."""
    hits = _rounded(vec.top_k(table(spark, d, "chunks").select("id", "document_id", "chunk_index", "embedding"), query_vector(spark, d), K, "id", repeated=True), "id", "document_id", "chunk_index")
    docs = table(spark, d, "documents").select(F.col("id").alias("document_id"), "title", "source")
    return hits.join(docs, "document_id", "left")


@C.query(f"WITH {_CHUNKS} " + _top("sc", "id, collection_id", "(1 + cos) / 2", K, "collection_id = 'col-007'"))
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").where("collection_id = 'col-007'").select("id", "collection_id", "embedding")
    return _rounded(vec.top_k(rows, query_vector(spark, d), K, "id", repeated=True), "id", "collection_id")


@C.query(f"WITH {_CHUNKS} SELECT * FROM ({_top('sc', 'id', '(1 + cos) / 2', 50)}) WHERE score >= 0.62")
def vector_minscore(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(vec.top_k(table(spark, d, "chunks").select("id", "embedding"), query_vector(spark, d), 50, "id", repeated=True, min_score=0.62), "id")


@C.query(f"WITH {_CHUNKS} " + _top("sc", "id", "cos", K))
def vector_score_one_minus(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(vec.top_k(table(spark, d, "chunks").select("id", "embedding"), query_vector(spark, d), K, "id", repeated=True, mode="one_minus"), "id")


@C.query(f"WITH {_CHUNKS} SELECT h.id, score, rank FROM ({_top('sc', 'id, metadata', '(1 + cos) / 2', 500)}) h WHERE h.metadata['page'] = '17'")
def vector_metadata_postfilter(spark: SparkSession, d: str) -> DataFrame:
    """The filter cuts the best 500, so fewer may come back."""
    hits = vec.top_k(table(spark, d, "chunks").select("id", "metadata", "embedding"), query_vector(spark, d), 500, "id", repeated=True)
    return _rounded(vec.with_metadata(hits, {"page": "17"}), "id")


@C.query(f"WITH {_CHUNKS} " + _top("sc", "id", "(1 + cos) / 2", K, "metadata['page'] = '17'"))
def vector_metadata_prefilter(spark: SparkSession, d: str) -> DataFrame:
    rows = vec.with_metadata(table(spark, d, "chunks").select("id", "metadata", "embedding"), {"page": "17"})
    return _rounded(vec.top_k(rows, query_vector(spark, d), K, "id", repeated=True), "id")


def _numbered_vectors(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """rows with a vector each: the n-th id has that of vec_id n, counted round and round."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    return rows.withColumn("vec_id", F.pmod(number - 1, F.lit(e.count()))).join(e, "vec_id").drop("vec_id")


def message_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _numbered_vectors(spark, d, once(spark, d, "messages").select("id", "namespace", "thread_id", "content"))


_VEC = "CAST(regexp_extract({0}.id, '(\\d+)$', 1) AS BIGINT)"
_ROUND = f"e.vec_id = ({_VEC} - 1) % (SELECT count(*) FROM embeddings)"
_MESSAGES = f"mv AS (SELECT m.id, namespace, thread_id, content, embedding FROM (SELECT DISTINCT ON (id) * FROM messages) m JOIN embeddings e ON {_ROUND.format('m')}), sc AS (SELECT *, {COS} AS cos FROM mv WHERE {GOOD})"


@C.query(f"WITH {_MESSAGES} " + _top("sc", "id, thread_id", "(1 + cos) / 2", K))
def vector_topk_messages(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(vec.top_k(message_vectors(spark, d).drop("content"), query_vector(spark, d), K, "id", repeated=True), "id", "thread_id")


def entity_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _numbered_vectors(spark, d, table(spark, d, "entities").select("id", "namespace", "name", "type", "summary"))


_ENTITIES = f"ev AS (SELECT n.id, namespace, name, type, summary, embedding FROM entities n JOIN embeddings e ON {_ROUND.format('n')}), sc AS (SELECT *, {COS} AS cos FROM ev WHERE {GOOD})"


@C.query(f"WITH {_ENTITIES} " + _top("sc", "id, name", "(1 + cos) / 2", K, "type = 'person'"))
def vector_topk_entities_by_type(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(vec.top_k(entity_vectors(spark, d), query_vector(spark, d), K, "id", where=F.col("type") == "person"), "id", "name")


@C.query(
    f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {GOOD}),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.e, b.e) AS c FROM v a, v b),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 12) DESC, vec_id) AS rank FROM p)
SELECT query_id, vec_id, round(c, 6) AS cosine, rank FROM r WHERE rank <= 5"""
)
def vector_batch_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    hits = vec.batch_top_k(e.select("vec_id", "embedding"), e.select(F.col("vec_id").alias("query_id"), "embedding"), 5, DIM, "vec_id")
    return hits.select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


@C.query(
    f"""WITH v AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings WHERE {GOOD})
SELECT v.vec_id, v.label, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])), 6) AS cosine FROM v JOIN v f ON f.label = v.label AND f.n = 1"""
)
def cosine_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's cosine to the first of its label."""
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("f"))
    return e.join(first, "label").select("vec_id", "label", F.round(cosine(F.col("embedding"), F.col("f")), 6).alias("cosine"))


@C.query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"))


@C.query("SELECT vec_id, CAST(len(embedding) * 4 AS BIGINT) AS n_bytes, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[len(embedding)] AS DOUBLE), 6) AS last FROM embeddings")
def vector_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as bytes and back."""
    packed = table(spark, d, "embeddings").select("vec_id", files.vector_bytes(F.col("embedding")).alias("b"))
    back = packed.select("vec_id", F.octet_length("b").cast("long").alias("n_bytes"), files.bytes_vector(F.col("b")).alias("v"))
    ends = (F.round(F.element_at("v", i).cast("double"), 6).alias(c) for i, c in ((1, "first"), (-1, "last")))
    return back.select("vec_id", "n_bytes", *ends)


def _bm(source: str, text: str, wanted: list[str], cols: str, k: int, where: str = "true", pre: str = "") -> str:
    return f"WITH {pre}{sql_bm25(source, text, wanted)} SELECT {cols}, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 12) DESC, id) AS rank FROM bm WHERE {where} ORDER BY round(score, 12) DESC, id LIMIT {k}"


@C.query(_bm("documents", "text", TEXT_TERMS, "id, title", 20))
def bm25_documents(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ft.search(table(spark, d, "documents").select("id", "title", "text"), F.col("text"), TEXT_QUERY, 20, "id"), "id", "title")


@C.query(_bm("documents", "text", TEXT_TERMS, "id, namespace", 20, "namespace = 'kb-harbor'"))
def bm25_by_namespace(spark: SparkSession, d: str) -> DataFrame:
    """Statistics over all rows, hits of one namespace."""
    rows = table(spark, d, "documents").select("id", "namespace", "text")
    return _rounded(ft.search(rows, F.col("text"), TEXT_QUERY, 20, "id", F.col("namespace") == "kb-harbor"), "id", "namespace")


@C.query(_bm("m", "content", MESSAGE_TERMS, "id, thread_id", 20, pre="m AS (SELECT DISTINCT ON (id) * FROM messages), "))
def bm25_messages(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ft.search(table(spark, d, "messages").select("id", "thread_id", "content"), F.col("content"), MESSAGE_QUERY, 20, "id", repeated=True), "id", "thread_id")


@C.query(_bm("chs", "content", TEXT_TERMS, "id, document_id", 20, pre="chs AS (SELECT DISTINCT ON (id) * FROM chunks), "))
def bm25_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ft.search(table(spark, d, "chunks").select("id", "document_id", "content"), F.col("content"), TEXT_QUERY, 20, "id", repeated=True), "id", "document_id")


@C.query(_bm("entities", "concat_ws(' ', name, summary)", ["energy", "known"], "id, name", 20))
def bm25_entities_two_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entities").select("id", "name", "summary")
    return _rounded(ft.search(rows, F.concat_ws(" ", "name", "summary"), "energy known", 20, "id"), "id", "name")


@C.query(
    f"""WITH t AS (SELECT unnest(list_distinct({sql_terms('text')})) AS term FROM documents), s AS (SELECT count(*) AS n_docs, round(avg(len({sql_terms('text')})), 6) AS avg_length FROM documents)
SELECT term, count(*) AS n_rows, any_value(n_docs) AS n_docs, any_value(avg_length) AS avg_length, round(greatest(ln((any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5)), 0.000001), 6) AS idf FROM t, s GROUP BY term"""
)
def bm25_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    """Row count and weight of every term."""
    rows = table(spark, d, "documents").select(ft.terms(F.col("text")).alias("t"))
    total = F.broadcast(rows.agg(F.count("*").alias("n_docs"), F.round(F.avg(F.size("t")), 6).alias("avg_length")))  # one row
    per = rows.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("n_rows"))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("n_rows") + 0.5) / (F.col("n_rows") + 0.5)), F.lit(ft.LEAST_IDF))
    return per.join(total).select("term", "n_rows", "n_docs", "avg_length", F.round(idf, 6).alias("idf"))


@C.query(_bm("documents", "text", ["the"], "id", 20))
def bm25_clamped_common_term(spark: SparkSession, d: str) -> DataFrame:
    """A term of most rows still weighs a little."""
    return _rounded(ft.search(table(spark, d, "documents").select("id", "text"), F.col("text"), "the", 20, "id"), "id")


@C.query(f"WITH t AS (SELECT id, {sql_terms('text')} AS t FROM documents) SELECT id FROM t WHERE list_contains(t, 'compiler') AND list_contains(t, 'the') AND list_contains(t, 'thread')")
def fts_and_match(spark: SparkSession, d: str) -> DataFrame:
    return ft.match_all(table(spark, d, "documents").select("id", "text"), F.col("text"), "compiler the thread").select("id")


@C.query(f"WITH t AS (SELECT id, ' ' || array_to_string({sql_terms('text')}, ' ') || ' ' AS t FROM documents) SELECT id FROM t WHERE contains(t, ' i e ')")
def fts_phrase_match(spark: SparkSession, d: str) -> DataFrame:
    """A word with punctuation inside is a phrase."""
    return ft.match_all(table(spark, d, "documents").select("id", "text"), F.col("text"), "i.e.").select("id")


@C.query(
    f"""WITH w AS (SELECT id, {sql_words('title')} AS w, title FROM documents WHERE title IS NOT NULL)
SELECT id, CASE WHEN len(list_filter(w, lambda x: strlen(x) >= 2)) > 0 THEN array_to_string(list_transform(list_filter(w, lambda x: strlen(x) >= 2), lambda x: '"' || replace(x, '"', '""') || '"'), ' OR ') ELSE '"' || replace(title, '"', '""') || '"' END AS match FROM w"""
)
def fts_query_prepare(spark: SparkSession, d: str) -> DataFrame:
    """Titles as queries, each through the query builder."""

    @F.arrow_udf("string")
    def prepared(titles: pa.Array) -> pa.Array:
        return pa.array([ft.prepare(t) for t in titles.to_pylist()], pa.string())

    return table(spark, d, "documents").where("title IS NOT NULL").select("id", prepared("title").alias("match"))


_STEM = "CASE WHEN regexp_matches({0}, '[^ae]ies$') THEN regexp_replace({0}, 'ies$', 'y') WHEN regexp_matches({0}, '[^aeo]es$') THEN regexp_replace({0}, 'es$', 'e') WHEN regexp_matches({0}, '[^us]s$') THEN regexp_replace({0}, 's$', '') ELSE {0} END"


@C.query(
    f"""WITH t AS (SELECT id, list_transform({sql_terms('text')}, lambda w: {_STEM.format('w')}) AS t FROM documents),
o AS (SELECT id, [list_position(t, 'compiler'), list_position(t, 'thread')] AS p, len(list_filter(t, lambda w: w = 'compiler')) + len(list_filter(t, lambda w: w = 'thread')) AS n FROM t WHERE list_contains(t, 'compiler') AND list_contains(t, 'thread'))
SELECT id, n = 2 AS once, CASE WHEN n = 2 THEN round(1.0 / (abs(p[1] - p[2]) + 1), 6) END AS density FROM o"""
)
def fts_stemmed_match(spark: SparkSession, d: str) -> DataFrame:
    """Rows that hold both words in either number. The density of rows that hold each once is 1 / the stretch between them."""
    docs = table(spark, d, "documents").select("id", "text")
    hits = ft.match_stemmed(docs, F.col("text"), "the compilers of threads")
    n = F.size(F.filter(F.transform(ft.terms(F.col("text")), ft.stem), lambda w: w.isin("compiler", "thread")))
    return hits.select("id", (n == 2).alias("once"), F.when(n == 2, F.round("score", 6)).alias("density"))


@C.query(_bm("documents", "text", TEXT_TERMS, "id", 20))
def bm25_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same ranking from a text index, of which the query reads its own terms."""
    index = TextIndex(spark, f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/text-{uuid.uuid4().hex}")
    docs = table(spark, d, "documents").select("id", "text")
    return _rounded(index.build(docs, "id", F.col("text")).search(TEXT_QUERY, 20), "id")


@C.query()
def vector_topk_approx(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest chunks by an index of cells, a quarter of which is looked into."""
    index = VectorIndex(spark, f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/cells-{uuid.uuid4().hex}", DIM)
    chunks = table(spark, d, "chunks").select("id", "document_id", "embedding")
    hits = index.build(chunks, cells=64).search(query_vector(spark, d), K, probes=16, repeated=True)
    return _rounded(hits, "id", "document_id")


@C.query("SELECT CAST(5 AS BIGINT) AS n_queries, true AS nine_of_ten")
def vector_approx_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the index of cells, looked into by three eighths, finds nine in ten of the true ten nearest of five vectors."""
    index = VectorIndex(spark, f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/cells-{uuid.uuid4().hex}", DIM)
    chunks = table(spark, d, "chunks").select("id", "embedding")
    index.build(chunks, cells=64)
    asked = table(spark, d, "embeddings").where("vec_id < 5").select("vec_id", "embedding").collect()  # five rows
    hits = [index.search(list(r.embedding), K, probes=24, repeated=True).select(F.lit(r.vec_id).alias("query_id"), "id") for r in asked]
    queries = spark.createDataFrame([(r.vec_id, r.embedding) for r in asked], "query_id long, embedding array<float>")
    true = vec.batch_top_k(chunks.dropDuplicates(["id"]), queries, K, DIM).select("query_id", "id")
    both = true.join(reduce(DataFrame.unionByName, hits), ["query_id", "id"], "left_semi").count()
    n = true.count()
    return spark.createDataFrame([(len(asked), both >= 0.9 * n)], "n_queries long, nine_of_ten boolean")


def _hybrid_sql(pre: str, text: str, wanted: list[str], alpha: float, k: int = K, min_score: float = 0.0, source: str = "src", vector_where: str = "true") -> str:
    out = f"""WITH {pre}, {sql_bm25(source, text, wanted)},
v AS (SELECT id, cos, row_number() OVER (ORDER BY cos DESC, id) AS r FROM (SELECT * FROM sc WHERE {vector_where} ORDER BY cos DESC, id LIMIT {3 * k})),
f AS (SELECT id, row_number() OVER (ORDER BY round(score, 12) DESC, id) AS r FROM (SELECT * FROM bm ORDER BY round(score, 12) DESC, id LIMIT {3 * k})),
u AS (SELECT id, {alpha} / (60 + r) AS w FROM v UNION ALL SELECT id, {1 - alpha} / (60 + r) FROM f),
g AS (SELECT id, sum(w) AS score FROM u GROUP BY id),
h AS (SELECT id, CASE WHEN (SELECT count(*) FROM f) = 0 THEN v.cos ELSE score END AS score FROM g LEFT JOIN v USING (id))
SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 12) DESC, id) AS rank FROM h ORDER BY round(score, 12) DESC, id LIMIT {k}"""
    return f"SELECT * FROM ({out}) WHERE score >= {min_score}" if min_score else out


_SRC = _CHUNKS + ", src AS (SELECT id, content FROM ch)"


def _hybrid(spark: SparkSession, d: str, query: str = TEXT_QUERY, **kw) -> DataFrame:
    rows = table(spark, d, "chunks").select("id", "content", "embedding")
    return _rounded(hy.hybrid_search(rows, "id", F.col("content"), query, query_vector(spark, d), K, repeated=True, **kw), "id")


@C.query(_hybrid_sql(_SRC, "content", TEXT_TERMS, 0.5))
def hybrid_rrf_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d)


@C.query(_hybrid_sql(_SRC, "content", TEXT_TERMS, 0.0))
def hybrid_alpha_text(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, mode="text")


@C.query(_hybrid_sql(_SRC, "content", TEXT_TERMS, 1.0))
def hybrid_alpha_vector(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, alpha=1.0)


@C.query(_hybrid_sql(_SRC, "content", TEXT_TERMS, 0.5, min_score=0.008))
def hybrid_minscore(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, min_score=0.008)


@C.query(_hybrid_sql(_SRC, "content", ["zzznothing"], 0.5))
def hybrid_fts_empty_fallback(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, query="zzznothing")


@C.query(_hybrid_sql(_SRC, "content", TEXT_TERMS, 0.5, vector_where="metadata['page'] = '17'"))
def hybrid_metadata(spark: SparkSession, d: str) -> DataFrame:
    """A metadata filter holds for the vector list only."""
    rows = table(spark, d, "chunks").select("id", "content", "metadata", "embedding")
    where = F.coalesce(F.try_element_at("metadata", F.lit("page")) == "17", F.lit(False))
    return _rounded(hy.hybrid_search(rows, "id", F.col("content"), TEXT_QUERY, query_vector(spark, d), K, repeated=True, vector_where=where), "id")


@C.query(_hybrid_sql(_MESSAGES + ", src AS (SELECT id, content FROM mv)", "content", MESSAGE_TERMS, 0.5))
def hybrid_messages(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(hy.hybrid_search(message_vectors(spark, d), "id", F.col("content"), MESSAGE_QUERY, query_vector(spark, d), K), "id")


@C.query(_hybrid_sql(_ENTITIES + ", src AS (SELECT id, name, summary FROM ev)", "concat_ws(' ', name, summary)", ["energy", "known"], 0.5))
def hybrid_entities(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(hy.hybrid_search(entity_vectors(spark, d), "id", F.concat_ws(" ", "name", "summary"), "energy known", query_vector(spark, d), K), "id")


@C.query(
    f"""WITH {_CHUNKS}, hits AS ({_top('sc', 'id, document_id, chunk_index', '(1 + cos) / 2', K)})
SELECT h.id, h.document_id, h.chunk_index, h.score, h.rank,
  coalesce((SELECT string_agg(content, chr(10) || chr(10) ORDER BY chunk_index, content) FROM ch WHERE ch.document_id = h.document_id AND ch.chunk_index BETWEEN h.chunk_index - 1 AND h.chunk_index - 1), '') AS context_before,
  coalesce((SELECT string_agg(content, chr(10) || chr(10) ORDER BY chunk_index, content) FROM ch WHERE ch.document_id = h.document_id AND ch.chunk_index BETWEEN h.chunk_index + 1 AND h.chunk_index + 1), '') AS context_after FROM hits h WHERE h.document_id IS NOT NULL"""
)
def search_with_context(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: nearest chunks with the chunks around them."""
    from tessera.operators.chunking import with_neighbours

    chunks = table(spark, d, "chunks")
    hits = _rounded(vec.top_k(chunks.select("id", "document_id", "chunk_index", "embedding"), query_vector(spark, d), K, "id", repeated=True), "id", "document_id", "chunk_index").where("document_id IS NOT NULL")
    # K rows: written once, so that they are not searched for again on the other side of the join
    hits = written(hits, "hits")
    return with_neighbours(hits, chunks.select("id", "document_id", "chunk_index", "content"), "document_id", 1, 1)


@C.query(
    f"""WITH {_CHUNKS}, b AS (SELECT CASE WHEN cos <= -0.2 THEN -0.2 WHEN cos <= 0.0 THEN 0.0 WHEN cos <= 0.2 THEN 0.2 WHEN cos <= 0.4 THEN 0.4 WHEN cos <= 1.0 THEN 1.0 END AS le FROM sc)
SELECT CAST(le AS DOUBLE) AS le, count(*) AS n FROM b GROUP BY 1"""
)
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    """How the scores of all chunks for one vector are spread over fixed buckets."""
    rows = table(spark, d, "chunks").select("id", cosine_to(F.col("embedding"), query_vector(spark, d)).alias("c")).dropDuplicates(["id"]).where("c IS NOT NULL")
    return histogram(rows, F.col("c"), (-0.2, 0.0, 0.2, 0.4, 1.0))


QUERIES, ORACLE = C.QUERIES, C.ORACLE

