"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentinelweave.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401
from sentinelweave.llm.common import scratch_path
from sentinelweave.llm.conversation_repair import repaired
from sentinelweave.llm.decontamination import leaked
from sentinelweave.llm.lexical_search import ranked
from sentinelweave.llm.licenses import license_scan
from sentinelweave.llm.line_dedup import line_report
from sentinelweave.llm.mixing import mix
from sentinelweave.llm.near_copies import near_copies
from sentinelweave.llm.quality import quality
from sentinelweave.llm.quality_rules import quality_rules
from sentinelweave.llm.suffix_dedup import remove_repeats
from sentinelweave.llm.token_counts import token_counts
from sentinelweave.llm.topk import top_k
from sentinelweave.llm.warc import round_trip


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query("op2_warc_archive", """
    with p as (select page_id, coalesce(html, '') as html from pages),
    h as (select *, max(page_id) over (partition by html) as holder from p)
    select page_id, strlen(html) as payload_bytes, sha1(html) as payload_digest,
           case when strlen(html) < 1000 or page_id = holder then 'response' else 'revisit' end as record_type,
           case when strlen(html) >= 1000 and page_id <> holder then holder end as refers_to
    from h""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"), scratch_path(spark, "archives"))


@query("op6_exact_top_k", """
    with v as (
        select vec_id, [floor(1024 * x::double) for x in embedding] as v from embeddings
        where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
    s as (
        select q.vec_id as query_id, c.vec_id, cast(list_sum([z[1] * z[2] for z in list_zip(q.v, c.v)]) as bigint) as score
        from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
    r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
    select query_id, rank, vec_id, score from r where rank <= 10""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.filter("vec_id % 100 = 0"), 10)


@query("op9_source_mix")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op5_license_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


@query("op10_ngram_jaccard_join")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"), words=4, hundredths=85)


@query("op7_spaced_seed_leaks")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_weak_label_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


@query("op1_line_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


@query("op4_suffix_array_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts_too=False).drop("kept")


@query("op11_lexical_search", r"""
    with t as (
        select row_number() over () as row_id, doc_id,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
        from documents),
    s as (select count(*) as n_docs, sum(len(terms))::bigint as n_words from t where len(terms) > 0),
    i as (
        select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
        from benchmark),
    f as (
        select row_id, doc_id, n, term, count(*) as tf
        from (select row_id, doc_id, len(terms) as n, unnest(terms) as term from t) group by all),
    w as (
        select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint as w
        from (select term, count(*) as df from f group by term), s),
    p as (
        select row_id, doc_id, f.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_words))) as part
        from f join w using (term), s),
    r as (select item_id, row_id, doc_id, sum(part)::bigint as score from i join p using (term) group by all having sum(part) > 0)
    select item_id, rank, doc_id, score
    from (select *, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank from r)
    where rank <= 50""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_quality_rules")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))
