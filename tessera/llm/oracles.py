"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

import string

from .codes import ENTRIES, PARTS, ROUNDS, SCALE
from .middle import MIDDLE, PREFIX, RATE, SEED, SPM, SUFFIX, UNIT
from .set_join import LEAST, WORDS

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

SET_JOIN = rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, case when len(w) >= {WORDS} then list_distinct([array_to_string(w[i:i + {WORDS - 1}], ' ') for i in range(1, len(w) - {WORDS} + 2)])
                          when len(w) > 0 then [array_to_string(w, ' ')] else [] end s from w),
x as (select doc_id, len(s) n, unnest(s) x from s),
shared as (select a.doc_id a, b.doc_id b, a.n na, b.n nb, count(*) k from x a join x b on a.x = b.x and a.doc_id < b.doc_id group by all),
l as (select a, b from shared where 100 * k >= {LEAST} * (na + nb - k)),
e as (select a, b from l union select b, a from l),
r(id, other) as (select doc_id, doc_id from s union select r.id, e.b from r join e on e.a = r.other)
select s.doc_id, len(s)::bigint n_shingles, c.component_id from s join (select id, min(other) component_id from r group by id) c on c.id = s.doc_id
"""


def _codes() -> str:
    ctes = [
        f"k as (select vec_id, label, [floor({SCALE} * x::double) for x in embedding] v from embeddings where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0)",
        f"p as (select vec_id, p, v[p * len(v) // {PARTS} + 1:(p + 1) * len(v) // {PARTS}] x from k, range({PARTS}) t(p))",
        f"f as (select vec_id, row_number() over (order by vec_id) - 1 e from k qualify e < {ENTRIES})",
        "c0 as materialized (select p, e, x from p join f using (vec_id))",
    ]
    near = "arg_min({'e': e, 'd': d}, {'d': d, 'e': e})"
    for r in range(ROUNDS + 1):
        ctes.append(f"a{r} as materialized (select vec_id, p, {near} m from (select p.vec_id, p.p, c.e, list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, c.x) + list_dot_product(c.x, c.x) d from p join c{r} c on c.p = p.p) group by vec_id, p)")
        if r < ROUNDS:
            ctes.append(f"m{r} as (select p, e, list(m order by i) x from (select p.p, a.m.e e, u.i, floor(sum(p.x[u.i]) / count(*)) m from a{r} a join p on p.vec_id = a.vec_id and p.p = a.p, range(1, (select len(x) from p limit 1) + 1) u(i) group by all) group by all)")
            ctes.append(f"c{r + 1} as materialized (select c.p, c.e, coalesce(m.x, c.x) x from c{r} c left join m{r} m on m.p = c.p and m.e = c.e)")
    ctes += [
        f"o as (select vec_id, string_agg(lower(lpad(hex(m.e::bigint), 2, '0')), '' order by p) code, sum(m.d)::bigint error from a{ROUNDS} group by vec_id)",
        f"h as (select sha256(string_agg(array_to_string([(v::bigint)::varchar for v in x], ','), ',' order by p, e)) h from c{ROUNDS})",
    ]
    return "with " + ",\n".join(ctes) + "\nselect vec_id, code, error, sum(error) over (partition by label)::bigint label_error, h codebooks_sha256 from o join k using (vec_id), h"


CODES = _codes()

_H = "('0x' || substr(sha256('{seed}:' || coalesce(doc_id::varchar, '')), {at}, 8))::bigint"
_MARKED = " or ".join(f"contains(text, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))

FILL_IN_MIDDLE = rf"""
with d as (select doc_id, coalesce(text, '') text from documents),
u as (select *, regexp_extract_all(text, '{UNIT}') u, {", ".join(_H.format(seed=SEED, at=1 + 8 * i) + f" h{i + 1}" for i in range(4))} from d),
f as (select *, len(u)::bigint n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) b,
             case when text = '' or {_MARKED} or h3 % 100 >= {RATE} then 'plain' when h4 % 100 < {SPM} then 'spm' else 'psm' end form from u),
c as (select *, array_to_string(u[1:a], '') pre, array_to_string(u[a + 1:b], '') mid, array_to_string(u[b + 1:], '') suf from f)
select doc_id, n, form, case when form <> 'plain' then length(pre)::bigint end prefix_chars, case when form <> 'plain' then length(mid)::bigint end middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid else '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid end) output_sha256,
  sha256(text) restored_sha256 from c
"""
