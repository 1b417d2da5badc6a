"""Registered queries of the operators, over their whole tables, and DuckDB statements where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attribution, bpe, chats, decontaminate, fim, forest, jaccard, lines, notices, pii, toxicity, warc, whiten
from .common import read

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(read(spark, sf_dir, "embeddings"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.license_digest(notices.scan_licenses(read(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = attribution.line_sections(read(spark, sf_dir, "documents"))
    return attribution.count_tokens(documents, RANKS, public_tokenizers.PATTERN)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.render_chats(read(spark, sf_dir, "conversations"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_digest(warc.archive_pages(read(spark, sf_dir, "pages"), every_row=True))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(bpe.encode_documents(read(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.with_sums(fim.fill_in_middle(read(spark, sf_dir, "documents"))).drop("size")


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_digest(pii.find_personal_data(read(spark, sf_dir, "documents")))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten_embeddings(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontamination, op2_embedding_near_dedup, op3_line_dedup, op4_ngram_jaccard, op5_license_scan, op6_toxicity, op7_token_counts, op8_chat_formatting, op9_warc, op10_byte_bpe, op11_fill_in_middle, op12_personal_data, op13_embedding_whitening)
}

LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op3_line_dedup": f"""
with cut as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) pos
    from documents
), keyed as (
    select doc_id, pos, line, {LOWERED.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} k from cut
), common as (
    select k, max(doc_id) keeper from keyed where length(k) >= 40 group by k having count(distinct doc_id) >= 5
)
select doc_id, count(*) n_lines, count(*) filter (where keeper is not null and doc_id <> keeper) n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where keeper is null or doc_id = keeper), '')) kept_sha256
from keyed left join common using (k) group by doc_id""",
    "op4_ngram_jaccard": rf"""
with recursive cut as (
    select doc_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') w from documents
), sets as (
    select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end s
    from cut
), shingles as (
    select doc_id, len(s) n, unnest(s) shingle from sets
), links as (
    select a.doc_id x, b.doc_id y from shingles a join shingles b on a.shingle = b.shingle and a.doc_id < b.doc_id
    group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), ends as (
    select x, y from links union select y, x from links
), reach(doc_id, other) as (
    select x, x from ends union select r.doc_id, e.y from reach r join ends e on e.x = r.other
), lowest as (
    select doc_id, min(other) component_id from reach group by doc_id
)
select doc_id, len(s)::bigint n_shingles, coalesce(component_id, doc_id) component_id from sets left join lowest using (doc_id)""",
    "op8_chat_formatting": f"""
with turns as (
    select distinct conv_id, turn, coalesce(role, '') "role", coalesce(text, '') text from conversations where conv_id is not null
), numbered as (
    select *, row_number() over (partition by conv_id order by turn nulls first, "role", md5(text)) number from turns
), logs as (
    select conv_id, count(*) n, list("role" || chr(1) || text order by number) log from numbered group by conv_id
), kept as (
    select min(conv_id) conv_id from logs a
    where not exists (select 1 from logs b where b.log[1] = a.log[1] and b.n > a.n and b.log[1:a.n] = a.log) group by a.log
)
select conv_id, (number - 1) // {chats.PART_TURNS} part, count(*) n_turns,
       string_agg('<|im_start|>' || "role" || chr(10) || text || '<|im_end|>' || chr(10), '' order by number) text
from numbered join kept using (conv_id) group by conv_id, (number - 1) // {chats.PART_TURNS}""",
    "op11_fill_in_middle": r"""
with cut as (
    select doc_id, coalesce(text, '') t, sha256('42:' || coalesce(doc_id::varchar, '')) h,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') u from documents
), drawn as (
    select *, len(u) n, ('0x' || h[1:8])::bigint h1, ('0x' || h[9:16])::bigint h2, ('0x' || h[17:24])::bigint h3, ('0x' || h[25:32])::bigint h4 from cut
), planned as (
    select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
           case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain'
                when h4 % 100 < 80 then 'spm' else 'psm' end form from drawn
), parts as (
    select *, array_to_string(u[1:a], '') p, array_to_string(u[a + 1:b], '') m, array_to_string(u[b + 1:n], '') s from planned
)
select doc_id, n::bigint n, form, case when form <> 'plain' then length(p) end prefix_chars, case when form <> 'plain' then length(m) end middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256,
       sha256(t) restored_sha256
from parts""",
    "op9_warc": """
with payloads as (
    select page_id, octet_length(encode(coalesce(html, ''))) payload_bytes, sha256(coalesce(html, '')) payload_digest from pages
), firsts as (
    select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) else page_id end first from payloads
)
select page_id, payload_bytes, payload_digest, case when first = page_id then 'response' else 'revisit' end record_type,
       case when first <> page_id then first end refers_to
from firsts""",
}
