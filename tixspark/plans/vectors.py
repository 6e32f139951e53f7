"""Vector jobs: tokens, embeddings, cosine, approved corpus and top-k search
(SIM-1..6, FLT-3, WIN-1, JOIN-5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import pyround
from ..functions import vectors as V
from ..functions.rules import strip_ws
from ..operators.topk import topk_similar
from ..settings import FIXTURE, Settings
from ..sources import fixtures
from ..sources.fixtures import with_views
from ..sources.tables import read_table, text_rows
from .registry import register


def approved_knowledge(tickets: DataFrame, settings: Settings) -> DataFrame:
    """FLT-3 + SIM-6: rows usable as retrieval evidence."""
    return tickets.where(
        V.dim_guard(F.col("embedding"), settings.embedding_dim)
        & F.col("source").isin(*settings.approved_knowledge_sources)
        & (F.col("assignment_group") != "Pending Review")
        & (strip_ws(F.col("resolution")) != ""))


@register("tokens", """
select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_./:-]+', 0) as tokens from documents""")
def q_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", V.tokens(F.col("text")).alias("tokens"))


@register("hashed_embedding")
def q_hashed_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SIM-2 (BLAKE2b, rows check; unit-tested against a Python rendering)."""
    d = text_rows(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", V.embed_text(F.col("text"), 384).alias("embedding"))


@register("hashed_embedding_md5", """
with t as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_./:-]+', 0)) as tok from documents),
s as (select doc_id, cast(('0x' || substring(md5(tok), 1, 8))::bigint % 384 as integer) as idx,
        case when ('0x' || substring(md5(tok), 9, 2))::integer % 2 = 1 then 1.0 else -1.0 end as sgn from t),
v as (select doc_id, idx, sum(sgn) as v from s group by doc_id, idx having sum(sgn) <> 0),
n as (select doc_id, sqrt(sum(v * v)) as norm from v group by doc_id)
select v.doc_id, idx, round(v / norm, 6) as value from v join n using (doc_id)""")
def q_hashed_embedding_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    e = V.md5_embedding_entries(d, "doc_id", "text", 384)
    return e.select("doc_id", "idx", pyround("value", 6).alias("value"))


@register("cosine_pairs", """
select a.vec_id, b.vec_id as next_vec_id,
  round(case when len(a.embedding) > 0 and len(b.embedding) > 0 and len(a.embedding) = len(b.embedding)
    then greatest(-1.0, least(1.0, list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])))) else 0.0 end, 6) as cosine
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def q_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SIM-4 on consecutive vectors (an equi-join on id + 1)."""
    e = read_table(spark, sf_dir, "embeddings")
    a = e.select("vec_id", F.col("embedding").alias("a"))
    b = e.select(F.col("vec_id").alias("next_vec_id"), F.col("embedding").alias("b"))
    j = a.join(b, b.next_vec_id == a.vec_id + 1)
    return j.select("vec_id", "next_vec_id", pyround(V.cosine_unit(F.col("a"), F.col("b")), 6).alias("cosine"))


@register("approved_knowledge", with_views("""
select t.ticket_id, t.category, t.assignment_group, t.source
from tickets t join embeddings e on e.vec_id = t.doc_id
where len(e.embedding) = 64 and t.source in ('6StringNinja/synthetic-servicenow-incidents', 'curated', 'historical', 'seed')
  and t.assignment_group <> 'Pending Review' and regexp_replace(t.resolution, '^\\s+|\\s+$', '', 'g') <> ''""", "tickets"))
def q_approved_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixtures.tickets_with_embedding(spark, sf_dir)
    return approved_knowledge(t, FIXTURE).select("ticket_id", "category", "assignment_group", "source")


@register("topk_similar", """
with p as (
  select a.vec_id as query_id, b.vec_id as neighbor_id,
    list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) as s
  from embeddings a, embeddings b where a.vec_id <> b.vec_id)
select query_id, cast(row_number() over (partition by query_id order by (s >= 0.95) desc, s desc, neighbor_id) as integer) as rank,
  neighbor_id, round(s, 6) as similarity, cast(s >= 0.95 as integer) as fast_candidate
from p qualify rank <= 5""")
def q_topk_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SIM-3 on the driver's vectors: each vector's 5 nearest other vectors."""
    e = read_table(spark, sf_dir, "embeddings")
    r = topk_similar(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding")),
                     e.select(F.col("vec_id").alias("neighbor_id"), "embedding"), k=5,
                     corpus_id="neighbor_id", corpus_order=("neighbor_id",), exclude_self=True)
    return r.select("query_id", "rank", "neighbor_id", pyround("similarity", 6).alias("similarity"), "fast_candidate")
