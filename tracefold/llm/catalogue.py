"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .decontaminate import op9_decontaminate
from .html_text import op8_html_text
from .jaccard_join import op1_jaccard_join
from .katz import op5_katz
from .language import op3_language_id
from .lexical import op12_lexical_search
from .mixing import op6_mixing
from .neighbours import op2_neighbours
from .quality import op10_quality
from .quality_rules import op13_quality_rules
from .secrets import op7_secret_scan
from .url_filter import op4_url_filter
from .vector_codes import op11_vector_codes

QUERIES = {
    f.__name__: f
    for f in (
        op1_jaccard_join, op2_neighbours, op3_language_id, op4_url_filter, op5_katz,
        op6_mixing, op7_secret_scan, op8_html_text, op9_decontaminate, op10_quality,
        op11_vector_codes, op12_lexical_search, op13_quality_rules,
    )
}
#: Squared distance of two parts in op11, and one round of it: nearest entries, then floored means.
_NEAREST = """
    {a} as materialized (
        select i, s, min(d * 64 + e) % 64 as e, min(d * 64 + e) // 64 as d from (
            select p.i, p.s, c.e, list_sum(list_transform(list_zip(p.x, c.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::bigint as d from p join {c} c using (s))
        group by i, s),"""
_ROUND = _NEAREST + """
    {n} as materialized (
        select c.s, c.e, coalesce(m.x, c.x) as x from {c} c left join (
            select s, e, list(v order by k) as x from (
                select s, e, k, ((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*))::bigint as v
                from (select a.s, a.e, unnest(p.x) as v, unnest(range(len(p.x))) as k from p join {a} a using (i, s)) group by s, e, k)
            group by s, e) m using (s, e)),"""
#: op4: the rules, and "allow" beside them. The driver's pages hold no link from host to host; what links decide is held against a
#: linear solve in the tests.
SQL: dict[str, str] = {
    "op4_url_filter": r"""
    with p as (
        select page_id,
            coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
            coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
        from pages),
    j as (
        select *, case
            when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
            when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
            when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
            when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule
        from p)
    select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict from j""",
    "op11_vector_codes": """
    with v as materialized (
        select vec_id, label, row_number() over (order by vec_id) as i, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as z
        from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    p as materialized (
        select i, s, list_slice(z, s * (len(z) // 16) + 1, (s + 1) * (len(z) // 16)) as x from v, range(16) t(s)),
    c0 as (select s, i - 1 as e, x from p where i <= 64),"""
    + _ROUND.format(a="a0", c="c0", n="c1") + _ROUND.format(a="a1", c="c1", n="c2") + _NEAREST.format(a="a2", c="c2") + """
    r as (select i, string_agg(format('{:02x}', e), '' order by s) as code, sum(d)::bigint as error from a2 group by i)
    select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
        (select sha256(string_agg(array_to_string(x, ','), ',' order by s, e)) from c2) as codebooks_sha256
    from r join v using (i)""",
    "op12_lexical_search": r"""
    with d as materialized (
        select doc_id, row_number() over () as i, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
    q as materialized (
        select j, t, count(*) as c from (
            select row_number() over () as j, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark)
        group by j, t),
    items as (select row_number() over () as j, item_id from benchmark),
    size as (select count(*) as n, sum(len(t))::bigint as l from d where len(t) > 0),
    tf as materialized (select i, t, count(*) as f from (select i, unnest(t) as t from d) where t in (select t from q) group by i, t),
    w as (select t, floor(1000 * ln((2.0::double * n + 2) / (2.0::double * count(*) + 1)))::bigint as w from tf, size group by t, n),
    s as (
        select j, i, sum(c * w * ((1000000000 * f) // (1000 * f + 12 * (75 + (25 * len(d.t) * n) // l))))::bigint as score
        from q join w using (t) join tf using (t) join d using (i), size group by j, i),
    ranked as (select j, doc_id, score, row_number() over (partition by j order by score desc, doc_id nulls last) as rank from s join d using (i) where score > 0)
    select item_id, rank::int as rank, doc_id, score from ranked join items using (j) where rank <= 20""",
}
