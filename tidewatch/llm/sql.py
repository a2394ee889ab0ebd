"""The same results in SQL, for the queries that SQL can express."""

_COMPONENT = """
reach(node, other) as (
  select a, b from links
  union
  select r.node, l.b from reach r join links l on l.a = r.other
)"""

EMBEDDING_DEDUP = f"""
with recursive vectors as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v,
         embedding is not null and label is not null and len(embedding) > 0
         and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
         and len(list_filter(embedding, lambda x: x <> 0)) > 0 as usable
  from embeddings
), links as (
  select x.vec_id as a, y.vec_id as b
  from vectors x join vectors y on x.label = y.label and x.vec_id <> y.vec_id and len(x.v) = len(y.v)
  where x.usable and y.usable
    and case when x.usable and y.usable then list_cosine_similarity(x.v, y.v) end >= 0.93
), {_COMPONENT}
, counts as (select a, count(*) as n from links group by a)
, lowest as (select node, min(other) as low from reach group by node)
select v.vec_id, coalesce(c.n, 0) as n_links, least(v.vec_id, coalesce(l.low, v.vec_id)) as component_id,
       v.vec_id = least(v.vec_id, coalesce(l.low, v.vec_id)) as kept
from vectors v left join counts c on c.a = v.vec_id left join lowest l on l.node = v.vec_id
"""

_TWO_LABELS = (
    "'ac.jp','ac.uk','co.in','co.jp','co.kr','co.nz','co.uk','co.za','com.ar','com.au','com.br','com.cn','com.hk',"
    "'com.mx','com.sg','com.tr','com.tw','edu.au','go.jp','gov.au','gov.uk','ne.jp','net.au','net.uk','or.jp',"
    "'org.au','org.uk'"
)


def _strength(children: str) -> str:
    """One row: the strength of the prior of a level, from its children with their parents' raw share."""
    return f"""
  select case when pairs is null or pairs = 0 or excess is null or excess <= 0 then 1e6
              else least(greatest(1 / least(excess / pairs, 1.0) - 1, 1.0), 1e6) end as m
  from (select sum((good - n * mean) ** 2 / (n * mean * (1 - mean))) - count(*) as excess, sum(n - 1) as pairs
        from {children} where n > 0 and mean > 0 and mean < 1)"""


HOST_REPUTATION = f"""
with split as (
  select page_id, url,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages
), labelled as (
  select doc_id, max(quality) as good from labels where doc_id is not null and quality is not null group by doc_id
), judged as (
  select s.host, l.good
  from split s left join labelled l
    on l.doc_id = try_cast(nullif(regexp_extract(s.path, '/([0-9]{{1,18}})(?:\\.[^/]*)?/?$', 1), '') as bigint)
), hosts as (
  select host, count(good) as n, coalesce(sum(good), 0) as good, string_split(host, '.') as parts
  from judged group by host
), named as (
  select host, n, good,
         case when array_to_string(parts[-2:], '.') in ({_TWO_LABELS}) then array_to_string(parts[-3:], '.')
              else array_to_string(parts[-2:], '.') end as domain,
         case when array_to_string(parts[-2:], '.') in ({_TWO_LABELS}) then array_to_string(parts[-2:], '.')
              else parts[-1] end as suffix
  from hosts
), overall as (select case when sum(n) > 0 then sum(good) / sum(n) else 1.0 end as mean, sum(n) as backing from named
), suffixes as (
  select suffix, sum(n) as n, sum(good) as good, any_value(o.mean) as mean, any_value(o.backing) as backing from named, overall o group by suffix
), suffix_m as ({_strength("suffixes")}
), suffix_post as (
  select suffix, n, good, (k * mean + good) / (k + n) as posterior, k + n as weight
  from (select *, greatest(1.0, least(m, backing)) as k from suffixes, suffix_m)
), domains as (
  select d.*, case when s.n > 0 then s.good / s.n end as mean, s.posterior as prior, s.weight as backing
  from (select suffix, domain, sum(n) as n, sum(good) as good from named group by suffix, domain) d
  join suffix_post s on s.suffix = d.suffix
), domain_m as ({_strength("domains")}
), domain_post as (
  select domain, n, good, (k * prior + good) / (k + n) as posterior, k + n as weight
  from (select *, greatest(1.0, least(m, backing)) as k from domains, domain_m)
), leaves as (
  select h.host, h.n, h.good, case when d.n > 0 then d.good / d.n end as mean, d.posterior as prior, d.weight as backing
  from named h join domain_post d on d.domain = h.domain
), leaf_m as ({_strength("leaves")}
), leaf_post as (
  select host, (k * prior + good) / (k + n) as p, k + n as weight
  from (select *, greatest(1.0, least(m, backing)) as k from leaves, leaf_m)
), upper_bound as (select host, p + 1.645 * sqrt(p * (1 - p) / (weight + 1)) as upper from leaf_post
), ruled as (
  select s.*, case
    when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule
  from split s
)
select r.page_id, r.host, r.path, r.rule,
       case when r.rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' when r.rule is not null then 'allow'
            when u.upper < 0.5 then 'block' else 'allow' end as verdict
from ruled r left join upper_bound u on u.host = r.host
"""

WARC = """
with payloads as (
  select page_id, strlen(coalesce(html, '')) as bytes, sha1(coalesce(html, '')) as hex from pages
), digests as (
  select page_id, bytes, max(page_id) over (partition by hex, bytes) as first,
         array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s: 
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((cast('0x' || hex[5 * i + 1 : 5 * i + 5] as bigint) >> s) & 31)]), '')), '') as digest
  from payloads
)
select page_id, cast(bytes as bigint) as payload_bytes, digest as payload_digest,
       case when page_id is not distinct from first then 'response' else 'revisit' end as record_type,
       case when page_id is distinct from first then first end as refers_to
from digests
"""

NGRAM_JACCARD = f"""
with recursive words as (
  select doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w from documents
), grams as (
  select distinct doc_id, hash(w[i : i + least(5, len(w)) - 1]) as gram
  from words, unnest(range(1, len(w) - least(5, len(w)) + 2)) as t(i) where len(w) > 0
), sizes as (select doc_id, count(*) as n from grams group by doc_id
), common as (
  select x.doc_id as a, y.doc_id as b, count(*) as shared
  from grams x join grams y on x.gram = y.gram and x.doc_id <> y.doc_id group by x.doc_id, y.doc_id
), links as (
  select a, b from common join sizes p on p.doc_id = a join sizes q on q.doc_id = b
  where shared >= 0.8 * (p.n + q.n - shared)
), {_COMPONENT}
, counts as (select a, count(*) as n from links group by a)
, lowest as (select node, min(other) as low from reach group by node)
select d.doc_id, least(d.doc_id, coalesce(l.low, d.doc_id)) as class_id, coalesce(c.n, 0) as n_links,
       d.doc_id = least(d.doc_id, coalesce(l.low, d.doc_id)) as kept
from documents d left join counts c on c.a = d.doc_id left join lowest l on l.node = d.doc_id
"""

DECONTAMINATION = """
with docs as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from documents
), items as (
  select cast(item_id as varchar) as item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from benchmark
), windows as (
  select distinct item_id, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as run
  from items, unnest(range(1, len(w) - least(10, len(w)) + 2)) as t(i) where len(w) > 0
), lengths as (select distinct n from windows
), runs as (
  select r, i, n, array_to_string(w[i : i + n - 1], ' ') as run
  from docs, lengths, unnest(range(1, cast(len(w) - n + 2 as bigint))) as t(i)
), found as (
  select r, i, d.n, item_id from runs d join windows x on d.n = x.n and d.run = x.run
), hit as (
  select r, count(distinct i + k) as n_hit from (select distinct r, i, n from found), unnest(range(0, cast(n as bigint))) as t(k) group by r
), named as (
  select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct r, item_id from found where item_id is not null) group by r
)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit using (r) left join named using (r)
"""

ORACLES = {
    "op13_decontamination": DECONTAMINATION,
    "op1_embedding_dedup": EMBEDDING_DEDUP,
    "op3_host_reputation": HOST_REPUTATION,
    "op6_warc": WARC,
    "op8_ngram_jaccard": NGRAM_JACCARD,
}
