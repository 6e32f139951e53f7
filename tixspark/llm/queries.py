"""One registered query per corpus operator, over the whole tables, with its DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import convrepair, covercodes, decontam, factorization, forest, htmlcut, langmix, linespread, mixing, setjoin, simhash, tokencount, unitdedup
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


@query("op1_mix_sources")
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(mixing.mix_sources(table(spark, sf_dir, "documents")))


OP3_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
i as (
  select cast(item_id as varchar) item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where item_id is not null),
iw as (
  select item, m, array_to_string(w[k:k + m - 1], ' ') win
  from (select item, w, m, unnest(range(1, len(w) - m + 2)) k from (select item, w, least(13, len(w)) m from i where len(w) > 0))),
ms as (select distinct m from iw),
dw as (
  select doc_id, m, k, array_to_string(w[k:k + m - 1], ' ') win
  from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) k from d, ms where len(w) >= m)),
h as (select dw.doc_id, dw.m, dw.k, iw.item from dw join iw on dw.m = iw.m and dw.win = iw.win),
hw as (select doc_id, count(*) n_hit from (select distinct doc_id, unnest(range(k, k + m)) p from h) group by doc_id),
hi as (select doc_id, count(distinct item) n_items, string_agg(distinct item, ',' order by item) ids from h group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join hw using (doc_id) left join hi using (doc_id)
"""


@query("op3_decontaminate", OP3_SQL)
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_language_mixture")
def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = langmix.fit(docs.where(rest != 2))
    held = F.coalesce(rest == 2, F.lit(False)).alias("held_out")
    return langmix.identify(docs, model).select("doc_id", held, "lang_pred", "score")


OP9_SQL = r"""
with d as (select doc_id, text, source, string_split(text, chr(10)) ls, row_number() over () rid from documents),
l as (
  select rid, source, pos, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') line
  from (select rid, source, unnest(ls) raw, unnest(range(len(ls))) pos from d)),
wide as (select line from l where line != '' group by line having count(distinct source) >= 6),
cut as (
  select rid, list(pos) ats, sum(length(line)) n from l where line in (select line from wide) group by rid),
full_lines as (select rid, count(*) n_full from l where line != '' group by rid),
copied as (select text from d where text is not null group by text having count(distinct doc_id) > 1),
x as (
  select d.*, case when n > 0.5 * length(text) and (len(ats) = n_full or text in (select text from copied)) then [] else ats end ats
  from d left join cut using (rid) left join full_lines using (rid))
select doc_id, coalesce(cast(len(ls) as bigint), 0) n_lines, cast(len(coalesce(ats, [])) as bigint) n_cut,
       sha256(case when len(coalesce(ats, [])) = 0 then text
         else array_to_string([z[1] for z in list_zip(ls, range(len(ls))) if not list_contains(ats, z[2])], chr(10)) end) text_sha256
from (select doc_id, text, ls, ats from x)
"""


@query("op9_line_spread", OP9_SQL)
def op9_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linespread.spread_digest(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
with recursive t as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') w from documents),
s as (
  select distinct doc_id, array_to_string(w[k:k + m - 1], ' ') g
  from (select doc_id, w, least(5, len(w)) m, unnest(range(1, len(w) - least(5, len(w)) + 2)) k from t where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
p as (
  select a.doc_id x, b.doc_id y, count(*) i from s a join s b on a.g = b.g and a.doc_id != b.doc_id group by 1, 2),
e as (select x, y from p join n a on x = a.doc_id join n b on y = b.doc_id where 100 * i >= 80 * (a.n + b.n - i)),
r(d, c) as (select doc_id, doc_id from t union select e.y, r.c from r join e on e.x = r.d)
select t.doc_id, coalesce(any_value(n.n), 0) n_shingles, min(r.c) component_id
from t join r on r.d = t.doc_id left join n on n.doc_id = t.doc_id group by t.doc_id
"""


@query("op2_ngram_join", OP2_SQL)
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key", "root")


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op6_quality_fm")
def op6_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    machine = factorization.fit(docs, labels.where(rest != 1).select("doc_id", F.col("quality").alias("label")))
    score = factorization.quality(F.col("text"), F.col("n_chars"), machine)
    out = docs.select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op7_html_mincut")
def op7_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    model = htmlcut.fit(pages)
    out = pages.select("page_id", "url", F.coalesce(htmlcut.main_text(F.col("html"), model), F.lit("")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


@query("op5_prefix_forest")
def op5_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = forest.valid_vectors(table(spark, sf_dir, "embeddings"))
    return forest.nearest(vectors, vectors.where("id % 50 = 0"), 5)


@query("op8_line_hashing")
def op8_line_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unitdedup.repeats_digest(table(spark, sf_dir, "documents"))


@query("op11_simhash_trie")
def op11_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


_NEAR = "cast(coalesce(list_sum([(p.x[i] - c[i]) * (p.x[i] - c[i]) for i in range(1, len(p.x) + 1)]), 0) as hugeint)"


def _op12_assign(r: int) -> str:
    pairs = f"select p.rid, d, part, e, {_NEAR} dist from p join b{r} using (d, part)"
    return f"a{r} as (select rid, d, part, arg_min(e, dist * 64 + e) e, min(dist) dist from ({pairs}) group by all)"


def _op12_means(r: int) -> str:
    return f"""
m{r} as (
  select d, part, e, list((s - ((s % n) + n) % n) // n order by i) c
  from (select d, part, e, i, sum(x[i]) s, count(*) n from (select a{r}.d, a{r}.part, e, x, unnest(range(1, len(x) + 1)) i from a{r} join p using (rid, part)) group by all)
  group by all),
b{r + 1} as (select d, part, e, coalesce(m{r}.c, b{r}.c) c from b{r} left join m{r} using (d, part, e))"""


OP12_SQL = f"""
with v as (
  select row_number() over () rid, vec_id, label, len(embedding) d, embedding, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] q
  from embeddings where embedding is not null and len([1 for x in embedding if x is null or not isfinite(x)]) = 0),
p as (select rid, d, j part, q[j * d // 16 + 1 : (j + 1) * d // 16] x from v, range(16) t(j)),
b0 as (
  select p.d, part, e, x c
  from p join (select rid, row_number() over (partition by d order by vec_id nulls last, embedding) - 1 e from v qualify e < 64) using (rid)),
{_op12_assign(0)},{_op12_means(0)},
{_op12_assign(1)},{_op12_means(1)},
{_op12_assign(2)},
h as (select d, sha256(string_agg(array_to_string(c, ','), ',' order by part, e)) codebooks_sha256 from b2 where len(c) > 0 group by d),
o as (select rid, string_agg(printf('%02x', e), '' order by part) code, cast(sum(dist) as bigint) error from a2 group by rid)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error, codebooks_sha256
from v join o using (rid) left join h using (d)
"""


@query("op12_cover_codes", OP12_SQL)
def op12_cover_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covercodes.codes_digest(table(spark, sf_dir, "embeddings"))


#: What a row (or an insertion) does to the state: from, to, inserted rows, letter of the row's edit, its initial (null: any), role given (null: as it was), cost.
_OP13_MOVES = """
values (0,0,[],'D',null,null,4),(1,1,[],'D',null,null,4),(2,2,[],'D',null,null,4),(3,3,[],'D',null,null,4),
 (0,1,[],'K','s',null,0),(0,2,[],'K','u',null,0),(1,2,[],'K','u',null,0),(2,3,[],'K','a',null,0),(3,2,[],'K','u',null,0),
 (0,3,['user:'],'K','a',null,3),(0,2,['user:','assistant:'],'K','u',null,6),(1,3,['user:'],'K','a',null,3),(1,2,['user:','assistant:'],'K','u',null,6),
 (2,2,['assistant:'],'K','u',null,3),(3,3,['user:'],'K','a',null,3),
 (0,0,[],'K','',null,0),(1,1,[],'K','',null,0),(2,2,[],'K','',null,0),(3,3,[],'K','',null,0),(0,2,['user:'],'K','',null,3),(0,3,['user:','assistant:'],'K','',null,6),
 (1,2,['user:'],'K','',null,3),(1,3,['user:','assistant:'],'K','',null,6),(2,3,['assistant:'],'K','',null,3),(3,2,['user:'],'K','',null,3),
 (0,2,[],'R',null,'user',3),(1,2,[],'R',null,'user',3),(2,3,[],'R',null,'assistant',3),(3,2,[],'R',null,'user',3),
 (0,3,['user:'],'R',null,'assistant',6),(0,2,['user:','assistant:'],'R',null,'user',9),(1,3,['user:'],'R',null,'assistant',6),(1,2,['user:','assistant:'],'R',null,'user',9),
 (2,2,['assistant:'],'R',null,'user',6),(3,3,['user:'],'R',null,'assistant',6)"""

OP13_SQL = rf"""
with recursive src as (
  select row_number() over () rid, conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text,
    concat(coalesce(cast(conv_id as varchar), ' '), ':', coalesce(cast(turn as varchar), ' ')) k from conversations),
crc as (  -- CRC-32 a bit at a time: a number is a byte to add, -1 a shift
  select *, xor(4294967295, list_reduce(list_concat([4294967295], flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(k, '')])),
    lambda c, x: case when x >= 0 then xor(c, x) when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) % 20 kind from src),
dam as (
  select conv_id, turn, case kind when 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case kind when 3 then 2 else 1 end)) as copy
  from crc where kind != 0),
f as (
  select *, substr(role, 1, 1) ini, regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') bare,
    row_number() over (partition by conv_id order by turn nulls first, role, text) rn from dam),
g as (
  select *, case when bare = '' then 'b' when row_number() over (partition by conv_id, role, text order by rn) > 1 then 'd' when right(bare, 1) not in ('.', '!', '?') then 't' else '' end fault,
    concat(lag(ini) over (partition by conv_id order by rn), ini) pair from f),
moves(s, t, ins, letter, ini, newrole, cost) as ({_OP13_MOVES}),
walk as (
  select conv_id, cast(0 as bigint) rn, 0 s, {{'c': cast(0 as bigint), 'a': '', 't': cast([] as varchar[])}} v from (select distinct conv_id from conversations)
  union all
  select w.conv_id, g.rn, m.t, min({{'c': v.c + m.cost + case when m.letter != 'D' and fault = 't' then 3 else 0 end,
      'a': concat(v.a, repeat('I', len(m.ins)), m.letter),
      't': list_concat(v.t, m.ins, case when m.letter = 'D' then [] else [concat(coalesce(m.newrole, g.role), ':', g.text)] end)}})
  from walk w join g on w.conv_id is not distinct from g.conv_id and g.rn = w.rn + 1
    join moves m on m.s = w.s and (m.ini is null or m.ini = g.ini) and (m.letter = 'D' or fault not in ('b', 'd'))
  group by w.conv_id, g.rn, m.t),
ends(s, n, ins) as (values (0, 0, []), (1, 2, ['user:', 'assistant:']), (2, 1, ['assistant:']), (3, 0, [])),
done as (
  select w.conv_id, min({{'c': v.c + 3 * e.n, 'a': concat(v.a, repeat('I', e.n)), 't': list_concat(v.t, e.ins)}}) v
  from walk w join ends e on e.s = w.s join (select conv_id, max(rn) rn from walk group by conv_id) l on l.conv_id is not distinct from w.conv_id and l.rn = w.rn
  group by w.conv_id),
st as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (fault = 'b') blank,
    count(*) filter (fault = 'd') duplicate, count(*) filter (fault = 't') truncated,
    count(*) filter (rn > 1 and pair not in ('su', 'ua', 'au')) illegal from g group by conv_id)
select d.conv_id, cast(coalesce(gaps, 0) as bigint) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated,
  coalesce(illegal, 0) illegal, cast(d.v.c as bigint) as "cost", d.v.a as audit, sha256(array_to_string(d.v.t, chr(10))) repaired_sha256
from done d left join st on st.conv_id is not distinct from d.conv_id
"""


@query("op13_survivor_viterbi", OP13_SQL)
def op13_survivor_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convrepair.repair_digest(table(spark, sf_dir, "conversations"))
