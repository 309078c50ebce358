"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .decontaminate import find_contamination
from .hardnegatives import mine_hard_negatives
from .langid import page_languages, train_text_model
from .linededup import dedup_lines
from .maintext import extract_main_text
from .nearcopies import near_duplicates
from .packing import pack_documents
from .pitmanyor import pitman_yor_scores
from .repeats import remove_repeats
from .resampling import importance_resample
from .sharding import shard_documents
from .syncmers import syncmer_fingerprints
from .toxicity import held_out, toxicity_scores


def op1_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = pitman_yor_scores(read_table(spark, sf_dir, "documents"), ~held_out("doc_id", 7, 2))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    names = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), names.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP2_SQL = r"""
with d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents
), b as (
  select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark
), win as (
  select item_id, least(len(w), 10) as k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as z
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)
), dw as (
  select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') as z
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from win) where len(w) >= k)
), hit as (
  select doc_id, i, dw.k as k, item_id from dw join win on dw.k = win.k and dw.z = win.z
), words as (
  select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + k)) as p from hit) group by doc_id
), names as (
  select doc_id, count(*) as n, string_agg(x, ',' order by x) as s from (select distinct doc_id, item_id::varchar as x from hit) group by doc_id
)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(words.n, 0)::bigint as n_hit, coalesce(names.n, 0)::bigint as n_items,
  sha256(coalesce(names.s, '')) as items_sha256, coalesce(words.n, 0) > 0 as contaminated
from d left join words using (doc_id) left join names using (doc_id)
"""


def op9_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1)).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity_scores(read_table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op8_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).drop("text_key")


OP8_SQL = r"""
with recursive docs as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), sets as (
  select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end as s
  from docs
), rows as (select doc_id, unnest(s) as z from sets),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from rows a join rows b on a.z = b.z and a.doc_id < b.doc_id group by all
), links as (
  select a, b from pairs join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * c >= 75 * (len(x.s) + len(y.s) - c)
), both_ways as (select a, b from links union select b, a from links),
reach(a, b) as (select doc_id, doc_id from sets union select r.a, l.b from reach r join both_ways l on l.a = r.b)
select s.doc_id, len(s.s)::bigint as n_shingles, r.c as component_id, s.doc_id = r.c as kept
from sets s join (select a, min(b) as c from reach group by a) r on r.a = s.doc_id
"""

def op3_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train_text_model(read_table(spark, sf_dir, "documents").select("text", "lang"))
    return page_languages(read_table(spark, sf_dir, "pages"), model)


def op4_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmer_fingerprints(read_table(spark, sf_dir, "documents"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages"))


def op6_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shard_documents(read_table(spark, sf_dir, "documents"), 40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read_table(spark, sf_dir, "documents"))


def op10_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = r"""
with table_ as materialized (
  select list(c order by i) as t from (
    select i, list_reduce(range(0, 8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) as c from range(0, 256) r(i))
), d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents
), b as (
  select list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark
), dw as materialized (select doc_id, z, count(*) as n from (select doc_id, unnest(w) as z from d) group by all),
bw as materialized (select z, count(*) as n from (select unnest(w) as z from b) group by all),
crc as materialized (
  select z, xor(list_reduce(list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), 4294967295), 4294967295) % 10000 as k
  from (select z, hex(encode(z)) as x from (select z from dw union select z from bw)), table_
), totals as (
  select k, coalesce(sum(s), 0) as s, coalesce(sum(t), 0) as t
  from (select k, n as s, 0 as t from dw join crc using (z) union all select k, 0, n from bw join crc using (z)) group by k
), gain as materialized (
  select k, floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000)::double / ((s + 1)::double * (sum(t) over () + 10000)::double)))::bigint as g from totals
), weights as (select doc_id, sum(n * g)::bigint as weight from dw join crc using (z) join gain using (k) group by doc_id),
scored as (
  select d.doc_id, len(w)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(d.doc_id::varchar, '')), 1, 8))::bigint + 0.5) / 4294967296.0)))::bigint as score
  from d left join weights using (doc_id)
), placed as (
  select doc_id, row_number() over (order by score desc, doc_id)::bigint as rank, count(*) over () as n from scored where n_features >= 20
)
select s.doc_id, n_features, weight, score, case when rank <= n * 10 // 100 then rank end as rank from scored s left join placed p on s.doc_id = p.doc_id
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine_hard_negatives(rows, rows.where("vec_id % 100 = 0"))


OP12_SQL = """
with v as materialized (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as materialized (
  select a.vec_id as anchor_id, v.vec_id as id, v.label = a.label as same, list_inner_product(a.e, v.e)::bigint as score from v a join v on a.vec_id <> v.vec_id where a.vec_id % 100 = 0
), p as (
  select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select p.anchor_id, positive_id, (row_number() over (partition by p.anchor_id, positive_id order by score desc, id))::int as rank, id as negative_id, positive_score, score as negative_score
from p join s on p.anchor_id = s.anchor_id and not same and 80 * positive_score <= 100 * score and score <= positive_score
qualify rank <= 5
"""


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = """
with d as materialized (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
w as materialized (select doc_id, i, substr(x, 2 * i + 1, 100) as z from (select doc_id, x, unnest(range(0, length(x) // 2 - 49)) as i from d)),
f as (select z, min(doc_id) as least from w group by z having min(doc_id) <> max(doc_id)),
gone as (select doc_id, i from w join f using (z) where least < doc_id),
marked as (select doc_id, i, max(i) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as before from gone),
numbered as (select doc_id, i, sum(case when before is null or before + 50 < i then 1 else 0 end) over (partition by doc_id order by i) as run from marked),
spans as (select doc_id, run, min(i) as a, max(i) + 50 as b from numbered group by all),
placed as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as e from spans),
cut as (select p.doc_id, count(*) as n, sum(b - a) as removed, string_agg(substr(x, 2 * e + 1, 2 * (a - e)), '' order by a) || substr(any_value(x), 2 * max(b) + 1) as kept from placed p join d on p.doc_id = d.doc_id group by p.doc_id)
select d.doc_id, (length(x) // 2)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(n, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, x))) as kept_sha256
from d left join cut on d.doc_id = cut.doc_id
"""


QUERIES = {
    "op3_language_evidence": op3_language_evidence,
    "op4_syncmer_fingerprints": op4_syncmer_fingerprints,
    "op7_line_dedup": op7_line_dedup,
    "op5_main_text": op5_main_text,
    "op6_histogram_sharding": op6_histogram_sharding,
    "op10_retrieval_packing": op10_retrieval_packing,
    "op1_pitman_yor_scores": op1_pitman_yor_scores,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op9_toxicity_scores": op9_toxicity_scores,
    "op8_minhash_near_duplicates": op8_minhash_near_duplicates,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_suffix_dedup": op13_suffix_dedup,
}
ORACLE_SQL = {
    "op2_benchmark_decontamination": OP2_SQL,
    "op8_minhash_near_duplicates": OP8_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_suffix_dedup": OP13_SQL,
}
