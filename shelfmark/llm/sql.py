"""What the operators compute, as DuckDB SQL over the given tables."""

from __future__ import annotations

from shelfmark.llm import licenses

HARD_NEGATIVES = """
with usable as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same,
         cast(list_dot_product(a.v, b.v) as bigint) as score
  from usable a join usable b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
),
positive as (
  select anchor_id, id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select anchor_id, positive_id,
       cast(row_number() over (partition by anchor_id, positive_id order by score desc, id) as integer) as rank,
       id as negative_id, positive_score, score as negative_score
from positive join scored using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, id) <= 10
"""

_WORDS = """regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

DECONTAMINATION = f"""
with item as (select item_id, {_WORDS} as w from benchmark),
windows as (
  select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as gram from (
    select item_id, w, least(10, len(w)) as k, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i
    from item where len(w) > 0)
),
doc as (select doc_id, row_number() over () as r, coalesce({_WORDS}, []) as w from documents),
grams as (
  select r, i, k, array_to_string(w[i:i + k - 1], ' ') as gram from (
    select r, w, k, unnest(range(1, len(w) - k + 2)) as i
    from doc, (select distinct k from windows) where len(w) >= k)
),
found as (select r, i, k, item_id from grams join windows using (k, gram)),
hit as (select r, count(distinct p) as n from (select r, unnest(range(i, i + k)) as p from (
          select distinct r, i, k from found)) group by r),
named as (
  select r, count(*) as n, string_agg(item, ',' order by item) as items
  from (select distinct r, cast(item_id as varchar) as item from found where item_id is not null) group by r
)
select doc_id, len(w)::bigint as n_words, coalesce(hit.n, 0)::bigint as n_hit, coalesce(named.n, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from doc left join hit using (r) left join named using (r)
"""

DIVERGENCE = """
with doc as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w
  from documents
),
counts as (select r, lang, source, t, count(*) as c from (select r, lang, source, unnest(w) as t from doc) group by all),
kept as (select lang, t, sum(c)::hugeint as c from counts group by all having count(*) >= 3),
own as (select lang, source, t, sum(c)::hugeint as c from counts semi join kept using (lang, t) group by all),
langs as (select l.lang, count(t)::hugeint as v, coalesce(sum(c), 0)::hugeint as n
          from (select distinct lang from doc) l left join kept k on k.lang = l.lang group by l.lang),
groups as (select g.lang, g.source, v, coalesce(sum(c), 0)::hugeint as n
           from (select distinct lang, source from doc) g join langs using (lang)
           left join own o on o.lang = g.lang and o.source = g.source group by all),
dense as (select g.lang, g.source, k.t, coalesce(o.c, 0) as c,
                 1 + (1000000000 * (coalesce(o.c, 0) + 1)) // (g.n + g.v) as p
          from groups g join kept k using (lang) left join own o using (lang, source, t)),
pairs as (
  select g.lang, g.source, h.source as item, coalesce(s.value, 0)::bigint as value
  from groups g join groups h on g.lang = h.lang and g.source <> h.source
  left join (select a.lang, a.source, b.source as other, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
             from dense a join dense b on a.lang = b.lang and a.t = b.t and a.source <> b.source group by all) s
    on s.lang = g.lang and s.source = g.source and s.other = h.source
),
terms as (
  select lang, source, t as item, ((p - q) * (p - q) // q)::bigint as value from (
    select d.lang, d.source, d.t, d.p, 1 + (1000000000 * (k.c + 1)) // (l.n + l.v) as q
    from dense d join kept k using (lang, t) join langs l using (lang) where d.c > 0)
  where p > q
),
ranked as (
  select lang, source, part, item, value,
         cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank
  from (select lang, source, 'pair' as part, item, value from pairs
        union all select lang, source, 'term' as part, item, value from terms)
)
select * from ranked where part = 'pair' or rank <= 200
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_scan() -> str:
    """Whole texts, last lines and known texts take the same canonical form; known digests join them."""
    head, inner = licenses.COPYRIGHT.removeprefix(r"(?:^|\n)").removesuffix(r"(?=\n|$)").split("*(?:", 1)
    form = f"regexp_replace(regexp_replace(lower(coalesce(t, '')), '\\r\\n?', chr(10), 'g'), '(?m)^{head}*(?:{inner}$', chr(10), 'g')"
    form = f"' ' || trim(regexp_replace({form}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g')) || ' '"
    for variant, usual in licenses.SPELLINGS.items():
        form = f"replace({form}, ' {variant.replace(' ', '  ')} ', ' {usual.replace(' ', '  ')} ')"
    form = f"sha256(trim(regexp_replace({form}, ' +', ' ', 'g')))"
    rows = ", ".join(f"({_quoted(v['license'])}, {_quoted(v['text'])})" for v in licenses.variants())
    more = ", ".join(f"({_quoted(n)}, {_quoted(d)})" for n, d in licenses.DIGESTS)
    return f"""
with known as (
  select digest, min(license) as license from (
    select license, {form} as digest from (values {rows}) as k(license, t)
    union all select * from (values {more}) as d(license, digest)) group by digest
),
whole as (select row_number() over () as r, doc_id, {form} as digest from (select doc_id, text as t from documents)),
line as (select row_number() over () as r, {form} as last
         from (select string_split(trim(coalesce(text, '')), chr(10))[-1] as t from documents))
select doc_id, whole.digest, k.license, l.license as last_line_license
from whole join line using (r) left join known k on k.digest = whole.digest left join known l on l.digest = line.last
"""


LICENSE_SCAN = _license_scan()
