"""The numbered queries: each applies its operator, with production parameters, to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, decontam, licences, linetemplates, mixing, quality, sharding, simhash, tokens, warc, wrappers


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the token files."""
    import public_tokenizers

    path = common.new_path(spark, "tokens")
    tokens.write(_read(spark, sf_dir, "documents"), path, public_tokenizers.path(tokens.TOKENIZER))
    return tokens.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document."""
    return mixing.mixed(_read(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the verdict of every document."""
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.verdicts(_read(spark, sf_dir, "documents")).select(*columns)


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, page (canonical URL), outcome, response_id and the merged headers as text, of every recheck of a page."""
    found = warc.resolved(warc.records_of_pages(_read(spark, sf_dir, "pages")))
    text = "array_join(transform(array_sort(map_entries(headers)), e -> concat(e.key, ': ', e.value)), '\n')"
    return found.selectExpr("record_id as page_id", "page", "outcome", "response_id", f"{text} as merged_headers")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, word_at, edits of every benchmark item that a document contains."""
    return decontam.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, by the law of equal row counts."""
    rows = sharding.assigned(_read(spark, sf_dir, "documents"))
    return rows.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, licence, first_sentence, times, rules of every licence that a document states."""
    return licences.licences(_read(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return wrappers.extracted(_read(spark, sf_dir, "pages"))


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, the kept text's length and md5, of every document."""
    rows = linetemplates.cleaned(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", "n_lines", "n_dropped", F.length(text).cast("long").alias("kept_chars"), F.md5(F.encode(text, "UTF-8")).alias("kept_md5"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_mix_sources, op3_simhash, op4_quality_rules, op5_warc_revisits, op6_decontaminate, op7_shard, op8_licences, op9_main_text, op10_line_templates)}

#: DuckDB SQL for the same rows; the other queries have a brute-force test instead.
ORACLES: dict[str, str] = {
    "op5_warc_revisits": r"""
with p as materialized (
  select page_id, 1700000000 + page_id as t, case when coalesce(html, '') = '' then null else '"' || md5(html)[1:16] || '"' end as tag, octet_length(encode(coalesce(html, ''))) as n,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as rest
  from pages),
q as materialized (
  select *, list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(lower(x), '^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid)(=|$)'))) as params,
    regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), ':(80|443)$', '') || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') as place
  from p),
c as materialized (select page_id, t, tag, n, place || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end as page from q),
m as (
  select v.page_id, v.page, v.tag, v.t, arg_max(r.page_id, (r.t, r.page_id)) as response_id
  from c v left join c r on v.page = r.page and r.t < v.t + 86400 group by all),
f as (
  select m.page_id, m.page, m.tag, m.t, response_id, r.tag as stored, r.n,
    case when response_id is null then 'unmatched' when m.tag is null then 'no_validator' when m.tag = r.tag then 'resolved' else 'mismatch' end as outcome
  from m left join c r on r.page_id = response_id)
select page_id, page, outcome, response_id,
  case when outcome = 'resolved' then 'cache-control: max-age=60' || chr(10) || 'content-length: ' || n || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || strftime(to_timestamp(t + 86400) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') || chr(10) || 'etag: W/' || tag end as merged_headers
from f
""",
    "op10_line_templates": r"""
with d as materialized (select row_number() over () as rid, doc_id, coalesce(text, '') as t, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as materialized (
  select rid, doc_id, t, pos, words, array_to_string(words, ' ') as line, concat_ws(' ', len(words), array_to_string(words[1:3], ' ')) as leaf
  from (
    select rid, doc_id, t, pos, list_transform(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda w: w <> ''), lambda w: case when regexp_matches(w, '[0-9]') then '<*>' else w end) as words
    from (select rid, doc_id, t, unnest(ls) as l, unnest(range(len(ls))) as pos from d))
  where len(words) > 0),
c as materialized (select leaf, line, any_value(words) as words, count(distinct (doc_id, t)) as docs from l group by leaf, line),
leaves as (select leaf from c group by leaf having sum(docs) >= 3 and min(docs) < 3),
w as materialized (select leaf, line, docs, unnest(words) as word, unnest(range(len(words))) as place from c where leaf in (from leaves)),
k as materialized (select leaf, place, word from w group by all having sum(docs) >= 3),
x as materialized (
  select w.leaf, w.line, count(*) as n, count(k.word) as fixed, string_agg(case when k.word is null then '<*>' else w.word end, ' ' order by w.place) as template
  from w left join k on w.leaf = k.leaf and w.place = k.place and w.word = k.word where docs < 3 group by w.leaf, w.line),
y as materialized (select leaf, line, template from x where fixed >= 0.6 * n),
r as (select template, leaf from y join l using (leaf, line) group by template, leaf having count(distinct (doc_id, t)) >= 3),
gone as materialized (select leaf, line from c where docs >= 3 union select leaf, line from y join r using (template, leaf)),
g as (select rid, list(pos) as dropped from l join gone using (leaf, line) group by rid),
n as (select rid, count(*) as n_lines from l group by rid),
z as (
  select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(len(dropped), 0) as n_dropped,
    case when dropped is null then t else array_to_string(list_transform(list_filter(range(len(ls)), lambda i: not list_contains(dropped, i)), lambda i: ls[i + 1]), chr(10)) end as kept
  from d left join n using (rid) left join g using (rid))
select doc_id, cast(n_lines as bigint) as n_lines, cast(n_dropped as bigint) as n_dropped, cast(length(kept) as bigint) as kept_chars, md5(kept) as kept_md5 from z
""",
    "op4_quality_rules": r"""
with d as materialized (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as t from documents),
w as materialized (select rid, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as l, t from d),
g as (select rid, unnest(range(1, len(w) - 1)) as i, w from w),
g3 as materialized (select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from g),
rep as (select rid, i from g3 where (rid, g) in (select (rid, g) from g3 group by rid, g having count(*) > 1)),
r as (select rid, count(distinct i + k) as n from rep, (select unnest(range(3)) as k) group by rid),
f as materialized (
  select d.rid, doc_id, lang, source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(regexp_replace(w.t, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols, cast(len(l) as bigint) as n_lines,
    cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(coalesce(r.n, 0) as bigint) as n_repeat_words,
    n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed
  from d join w using (rid) left join r using (rid)),
m as materialized (
  select rid, lang, source, base_failed, unnest(['symbols', 'dup_lines', 'repeats', 'word_length']) as metric,
    unnest([1000000 * n_symbols // greatest(word_chars, 1), 1000000 * n_dup_lines // greatest(n_lines, 1), 1000000 * n_repeat_words // greatest(n_words, 1), 1000 * word_chars // greatest(n_words, 1)]) as v
  from f),
s as (
  select lang, source, metric, case when v < 32 then v else (length(bin(v)) - 5) * 32 + (v >> (length(bin(v)) - 6)) - 32 end as bucket, count(*) as n
  from m where not base_failed group by all),
s2 as (
  select *, 3 as depth from s union all select lang, null, metric, bucket, sum(n), 2 from s group by lang, metric, bucket
  union all select null, null, metric, bucket, sum(n), 1 from s group by metric, bucket),
q as (
  select lang, source, metric, depth, bucket, case when bucket < 32 then bucket else (bucket % 32 + 32) << (bucket // 32 - 1) end as edge,
    (case when bucket + 1 < 32 then bucket + 1 else ((bucket + 1) % 32 + 32) << ((bucket + 1) // 32 - 1) end) - 1 as top,
    sum(n) over (partition by lang, source, metric, depth order by bucket) as upto, sum(n) over (partition by lang, source, metric, depth) as total,
    sum(case when bucket = 0 then n else 0 end) over (partition by lang, source, metric, depth) as zeros,
    case metric when 'symbols' then 90 when 'word_length' then 90 else 99 end as level, case metric when 'word_length' then 2 else 1 end as reach
  from s2),
fence as (
  select lang, source, metric, depth, max(total) as n,
    greatest(
      min(case when 100 * upto >= level * total then top end) + any_value(reach) * (min(case when 100 * upto >= level * total then top end) - min(case when 100 * upto >= 50 * total then top end)),
      coalesce(min(case when bucket > 0 and 100 * (upto - zeros) >= 5 * (total - zeros) then edge - 1 end), 0)) as fence
  from q group by all),
lang_cut as (select b.lang, b.metric, (b.n * b.fence + 100 * a.fence) // (b.n + 100) as cut from fence b join fence a on a.metric = b.metric and a.depth = 1 and b.depth = 2),
cut as (
  select a.lang, a.source, a.metric, (a.n * a.fence + 100 * b.cut) // (a.n + 100) as cut
  from fence a join lang_cut b on a.lang is not distinct from b.lang and a.metric = b.metric and a.depth = 3),
v as (
  select rid, bool_and(v <= coalesce(cut, 0)) as fine
  from m left join cut on m.lang is not distinct from cut.lang and m.source is not distinct from cut.source and m.metric = cut.metric group by rid)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and fine as kept from f join v using (rid)
""",
}
