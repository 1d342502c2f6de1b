"""Oracle SQL of the operators for documents that SQL can express."""

LEAKS = r"""
with d as (
  select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(lower(t), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from (select distinct doc_id, coalesce(text, '') as t from documents)),
i as (
  select distinct item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') as iw from benchmark),
m as (
  select * from (values (0, 9, 9, 1000000000, [0, 1, 3, 4, 6, 8]), (1, 10, 10, 1000000000, [0, 1, 2, 5, 8, 9]), (2, 12, 12, 1000000000, [0, 2, 5, 6, 7, 11]), (3, 4, 9, 15, [0, 1, 2, 3]))
    as v(mask, width, least, most, ones)
  union all select 100 + n, n, n, n, range(n) from range(1, 9) as g(n)),
iat as (select item_id, iw, unnest(range(len(iw))) as off from i),
seed as (
  select distinct item_id, off, mask, array_to_string(list_transform(ones, lambda k: iw[off + k + 1]), ' ') as key
  from iat, m where off + width <= len(iw) and len(iw) between least and most),
word as (select r, unnest(w) as x, generate_subscripts(w, 1) - 1 as pos from d),
ahead as (
  select r, pos, [x, lead(x, 1) over s, lead(x, 2) over s, lead(x, 3) over s, lead(x, 4) over s, lead(x, 5) over s, lead(x, 6) over s,
    lead(x, 7) over s, lead(x, 8) over s, lead(x, 9) over s, lead(x, 10) over s, lead(x, 11) over s] as xs
  from word window s as (partition by r order by pos)),
dkey as (select r, pos, mask, array_to_string(list_transform(ones, lambda k: xs[k + 1]), ' ') as key from ahead, m where xs[width] is not null),
hit as (select distinct r, item_id, pos - off as start from dkey join seed using (mask, key)),
scored as (
  select d.r, d.doc_id, i.item_id, start, len(iw) as n, list_filter(range(len(iw)), lambda k: start + k >= 0 and w[start + k + 1] = iw[k + 1]) as ks
  from hit join d using (r) join i using (item_id)),
sized as (
  select *, len(ks) as agree, coalesce(list_max(list_transform(ks, lambda k: len(list_filter(ks, lambda j: j >= k and j < k + 40)))), 0) as stretch from scored),
best as (
  select *, row_number() over (partition by r, item_id order by agree desc, n desc, stretch desc, start) as o from sized
  where (agree >= 0.5 * n and agree >= least(8, n)) or stretch >= 24)
select doc_id, item_id, agree::double / n as overlap, agree::int as n_matched, n::int as n_item_words, stretch::int as n_stretch, start::int as start from best where o = 1
"""

RULES = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
c as (
  select r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) as n_symbols
  from d),
word as (select r, unnest(w) as x, generate_subscripts(w, 1) as pos from c),
five as (
  select r, pos, concat_ws(' ', x, lead(x, 1) over s, lead(x, 2) over s, lead(x, 3) over s, lead(x, 4) over s) as win, lead(x, 4) over s is not null as whole
  from word window s as (partition by r order by pos)),
again as (select f.r, f.pos from five f join (select r, win from five where whole group by all having count(*) > 1) using (r, win) where whole),
rep as (select r, count(distinct pos + k) as n_repeat from again, range(5) as g(k) group by r),
line as (
  select r, x, regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') as solid, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) as n
  from (select r, unnest(string_split(t, chr(10))) as x from d)),
ruled as (
  select r, x, length(solid) as chars,
    2 * (length(x) - length(translate(x, '#*$%&<>~^={}', '')) + (length(x) - length(replace(x, '!!', ''))) // 2
      + (length(x) - length(replace(x, '??', ''))) // 2 + (length(x) - length(replace(x, '..', ''))) // 2) > n
    or 5 * (length(x) - length(translate(x, '|»•›', ''))) >= n
    or (n <= 6 and not contains('.!?…:;"''”’)', right(solid, 1))
      and len(regexp_extract_all(x, '(?i)\b(?:home|menu|about|contact|login|search|next|previous|back|top|help|faq|sitemap|blog|news|shop|cart)\b')) >= 2)
    or (n <= 30 and regexp_matches(x, '(?i)cookie (?:policy|settings)|we use cookies|privacy policy|terms of (?:service|use)|all rights reserved|subscribe to our|sign up for|click here|read more|share this|enable javascript|powered by|skip to (?:main )?content|follow us on')) as fails
  from line where n > 0),
per as (
  select r, count(*) - count(distinct x) as n_dup_lines, count(*) filter (fails) as n_removed_lines, coalesce(sum(chars) filter (fails), 0)::bigint as removed_chars
  from ruled group by r),
j as (
  select doc_id, len(w) as n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat, 0) as n_repeat_words,
    coalesce(n_removed_lines, 0) as n_removed_lines, coalesce(removed_chars, 0) as removed_chars
  from c left join per using (r) left join rep using (r))
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and removed_chars <= 0.5 * word_chars as kept
from j
"""



def vector_codes(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """Product quantisation by a full search: each round's assignment and codebook is a table of its own."""

    def assigned(r: int) -> str:
        return f"""a{r} as materialized (
  select i, p, min_by(e, (dist, e)) as e, min(dist) as dist
  from (select v.i, v.p, b.e, list_sum(list_transform(list_zip(v.y, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as dist from v join b{r} b using (p)) group by i, p)"""

    def moved(r: int) -> str:
        return f"""b{r + 1} as materialized (
  select b.p, b.e, coalesce(m.c, b.c) as c from b{r} b left join (
    select p, e, list(m order by j) as c
    from (select p, e, j, cast(floor(sum(x) / count(*)) as bigint) as m from (select p, e, unnest(y) as x, generate_subscripts(y, 1) as j from a{r} join v using (i, p)) group by p, e, j)
    group by p, e) m using (p, e))"""

    steps = ",\n".join(x for r in range(rounds) for x in (assigned(r), moved(r)))
    return f"""
with k as materialized (
  select row_number() over (order by vec_id nulls last, x) - 1 as i, vec_id, label, x from (
    select vec_id, label, list_transform(embedding, lambda c: cast(floor(1024 * cast(c as double)) as bigint)) as x from embeddings
    where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0)),
v as materialized (select i, p, x[p * len(x) // {parts} + 1:(p + 1) * len(x) // {parts}] as y from k, range({parts}) as g(p)),
b0 as materialized (select p, i as e, y as c from v where i < {entries}),
{steps},
{assigned(rounds)},
coded as (select i, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(dist) as bigint) as error from a{rounds} group by i),
books as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from b{rounds})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from coded join k using (i), books
"""


ORACLES = {"op4_decontaminate": LEAKS, "op10_quality_rules": RULES, "op11_vector_codes": vector_codes()}
