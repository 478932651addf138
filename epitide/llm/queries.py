"""Thin queries: each applies one operator to its whole table and derives the columns of its contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epitide.llm import alignment, ann, bpe, fingerprint, html_text, lexical, mixing, ngram_join, pii, quality, suffix_dedup, toxicity, url_filter
from epitide.llm.common import table


def op2_byte_bpe(spark: SparkSession, folder: str, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), bpe.read_ranks(public_tokenizers.path(vocabulary)), public_tokenizers.PATTERN)


def op8_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join_components(table(spark, folder, "documents"))


def op4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op5_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.report(table(spark, folder, "documents"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Pages have no labels of their own: a page's outcome is the quality label with the page's id, 0 being bad.

    The host's mean and bound are rounded to six places.
    """
    outcomes = table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    rows = url_filter.judged(table(spark, folder, "pages"), outcomes)
    return rows.withColumns({"mean": F.round("mean", 6), "bound": F.round("bound", 6)})


def op9_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.texts(table(spark, folder, "pages"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


OP7_SQL = r"""
with parts as (
    select page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
    from (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages)
), outcomes as (
    select doc_id as page_id, max(1 - quality) as bad from labels where doc_id is not null and quality is not null group by 1
), counted as (
    select host, string_split(host, '.') as l, count(bad) as n, coalesce(sum(bad), 0) as bad from parts left join outcomes using (page_id) group by 1
), named as (
    select *, case when len(l) < 3 then host when length(l[-1]) = 2 and l[-2] in ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') then array_to_string(l[-3:], '.') else array_to_string(l[-2:], '.') end as domain from counted
), hosts as (
    select host, n, bad, domain, case when instr(domain, '.') > 0 then substr(domain, instr(domain, '.') + 1) else domain end as suffix from named
), domains as (
    select domain, suffix, sum(n) as n, sum(bad) as bad from hosts group by 1, 2
), suffixes as (
    select suffix, sum(n) as n, sum(bad) as bad from domains group by 1
), units as (
    select 'host' as level, n::double as n, bad::double as bad from hosts union all select 'domain', n, bad from domains union all select 'suffix', n, bad from suffixes
), sums as (
    select level, count(*) as k, sum(n) as n, sum(bad) / sum(n) as mean, sum(n * n) as nn, sum(bad * bad / n) as npp, sum(bad * (1 - bad / n)) as within from units where n > 0 group by 1
), spread as (
    select level, mean, k, n, greatest(0, npp - n * mean * mean) / nullif(k - 1, 0) as between_units, within / nullif(n - k, 0) as inside, (n - nn / n) / nullif(k - 1, 0) as usual from sums
), strength as (
    select level, mean, case when k < 2 or n <= k then 1.0 when between_units > inside then least(1000.0, greatest(1.0, (between_units + (usual - 1) * inside) / (between_units - inside) - 1)) else 1000.0 end as s from spread
), prior as (
    select coalesce(max(case when level = 'suffix' then mean end), 0) as overall, coalesce(max(case when level = 'suffix' then s end), 1000.0) as s_suffix, coalesce(max(case when level = 'domain' then s end), 1000.0) as s_domain,
        coalesce(max(case when level = 'host' then s end), 1000.0) as s_host from strength
), domain_means as (
    select domain, (d.bad + s_domain * ((x.bad + s_suffix * overall) / (x.n + s_suffix))) / (d.n + s_domain) as dm from domains d join suffixes x using (suffix), prior
), beta as (
    select host, bad + s_host * dm as a, n - bad + s_host * (1 - dm) as b from hosts join domain_means using (domain), prior
), known as (
    select host, a / (a + b) as mean, a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) as bound from beta
), ruled as (
    select *, case when ('.' || host) like '%.www.example.com' and path like '/en/%' then 'www.example.com/en/' when ('.' || host) like '%.example.com' and path like '/en/%' then 'example.com/en/'
        when ('.' || host) like '%.net' and path like '/es/%' then 'net/es/' when ('.' || host) like '%.net' and path like '/fr/%' then 'net/fr/' when ('.' || host) like '%.com' and path like '/%' then 'com/' end as rule from parts join known using (host)
)
select page_id, host, path, rule, case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null or bound > 0.5 then 'block' else 'allow' end as verdict, round(mean, 6) as mean, round(bound, 6) as bound from ruled
"""

OP8_SQL = r"""
with recursive words as (
  select doc_id, row_number() over () as r,
    [v for v in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if v <> ''] as w
  from documents
), sets as (
  select doc_id, r, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)])) end as s
  from words
), kinds as (
  select s, len(s) as n, min(doc_id) as id from sets where len(s) > 0 group by s
), grams as (select id, n, unnest(s) as g from kinds
), links as (
  select a.id as x, b.id as y from grams a join grams b on a.g = b.g and a.id <> b.id
  group by a.id, b.id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(x, y) as (
  select id, id from kinds union select reach.x, links.y from reach join links on reach.y = links.x
), least as (select x, min(y) as c from reach group by x)
select sets.doc_id, cast(len(sets.s) as bigint) as n_shingles, coalesce(least.c, sets.doc_id) as component_id
from sets left join kinds on sets.s = kinds.s left join least on kinds.id = least.x
"""


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = suffix_dedup.dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
    )


def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, folder, "documents"))


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), 10)


OP11_SQL = r"""
with docs as (
  select doc_id, row_number() over () as r,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t
  from documents
), sizes as (select r, doc_id, cast(len(t) as bigint) as n from docs where len(t) > 0
), whole as (select count(*) as N_docs, cast(sum(n) as bigint) as L_terms from sizes
), norms as (select r, doc_id, 25 + (75 * n * N_docs) // L_terms as m from sizes, whole
), tfs as (select r, term, count(*) as tf from (select r, unnest(t) as term from docs) group by r, term
), weights as (
  select term, cast(floor(1000 * ln(cast(2 * N_docs + 2 as double) / (2 * df + 1))) as bigint) as w
  from (select term, count(*) as df from tfs group by term), whole
), items as (
  select item_id, row_number() over () as i,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t
  from benchmark
), asked as (select i, item_id, term, count(*) as c from (select i, item_id, unnest(t) as term from items) group by i, item_id, term
), scored as (
  select i, item_id, norms.r, doc_id, cast(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
  from asked join tfs using (term) join weights using (term) join norms on tfs.r = norms.r
  group by i, item_id, norms.r, doc_id
), ranked as (
  select *, cast(row_number() over (partition by i order by score desc, doc_id nulls last) as integer) as rank from scored where score > 0
) select item_id, rank, doc_id, score from ranked where rank <= 10
"""


def op12_token_alignment(spark: SparkSession, folder: str, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    ranks, (model, pieces) = alignment.read_byte_level(public_tokenizers.path(a)), alignment.read_pieces(public_tokenizers.path(b))
    return alignment.align(table(spark, folder, "documents"), (ranks, public_tokenizers.PATTERN, model, pieces))


def op13_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.spans(table(spark, folder, "documents"))
