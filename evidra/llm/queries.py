"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from .byte_bpe import op11_byte_bpe
from .centroids import op13_centroids
from .decontamination import op3_benchmark_decontamination
from .fill_middle import op12_fill_middle
from .jaccard import op4_jaccard_join
from .language import op1_language_id
from .lm_score import op5_lm_scoring
from .media import op2_media_columns
from .packing import op6_packing
from .pii import op7_private_data
from .sharding import op9_sharding
from .token_files import op10_token_files
from .toxicity import op8_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_media_columns, op3_benchmark_decontamination, op4_jaccard_join, op5_lm_scoring, op6_packing, op7_private_data,
        op8_toxicity, op9_sharding, op10_token_files, op11_byte_bpe, op12_fill_middle, op13_centroids,
    )
}

#: Word 13-grams (or whole short items) of the benchmark against those of the documents.
_OP3 = r"""
with w as (select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
iw as (select distinct item_id, least(len(w), 13) as n, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') as k from (select item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) as s from i where len(w) > 0)),
p as (select r, w, unnest(range(1, len(w) + 1)) as s from w),
h as (select p.r, p.s, iw.n, iw.item_id from p join (select distinct n from iw) l on p.s + l.n - 1 <= len(p.w) join iw on iw.n = l.n and iw.k = array_to_string(p.w[p.s : p.s + l.n - 1], ' ')),
c as (select r, count(distinct t) as n_hit from (select r, unnest(range(s, s + n)) as t from h) group by r),
m as (select r, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items from h group by r)
select w.doc_id, cast(len(w.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w.w) as contaminated
from w left join c using (r) left join m using (r)
"""

#: All pairs that share a 4-gram, their exact similarity, and the smallest reachable id.
_OP4 = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[s : s + least(len(w), 4) - 1], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) as s from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from pair join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
edge as (select a, b from link union all select b, a from link),
reach(doc_id, least) as (select doc_id, doc_id from documents union select e.b, r.least from reach r join edge e on e.a = r.doc_id where r.least < e.b)
select d.doc_id, coalesce(max(n.n), 0) as n_shingles, min(r.least) as component_id from documents d left join n using (doc_id) left join reach r on r.doc_id = d.doc_id group by d.doc_id
"""

#: Tokens by their pattern, choices by the hash of the key, outputs put together from slices of tokens.
_OP12 = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as w, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as sha from documents),
h as (select doc_id, t, w, len(w) as n, ('0x' || substr(sha, 1, 8))::ubigint as h1, ('0x' || substr(sha, 9, 8))::ubigint as h2, ('0x' || substr(sha, 17, 8))::ubigint as h3, ('0x' || substr(sha, 25, 8))::ubigint as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1))::bigint as lo, greatest(h1 % (n + 1), h2 % (n + 1))::bigint as hi,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from h),
p as (select doc_id, t, n, form, case when lo > 0 then array_to_string(w[1 : lo], '') else '' end as p, case when hi > lo then array_to_string(w[lo + 1 : hi], '') else '' end as m, case when n > hi then array_to_string(w[hi + 1 : n], '') else '' end as s from c)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(case form when 'plain' then t else p || m || s end) as restored_sha256
from p
"""


def _op13(rounds: int = 10, k: int = 8, dims: int = 64) -> str:
    """The rounds one after the other, each with all distances."""
    out = [
        f"v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as q from embeddings where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dims})",
        f"c0 as materialized (select row_number() over (order by sha256('3:' || coalesce(cast(vec_id as varchar), ''))) - 1 as k, q from v qualify k < {k})",
    ]
    near = "a{i} as materialized (select r, min(struct_pack(d := d, k := k)) as b from (select v.r, c.k, cast(list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as d from v, c{i} c) group by r)"
    for i in range(rounds):
        out += [
            near.format(i=i),
            f"s{i} as (select (b).k as k, p, sum(q[p]) as s, count(*) as n from a{i} join v using (r), range(1, {dims + 1}) t(p) group by 1, 2)",
            f"c{i + 1} as materialized (select c.k, coalesce(m.q, c.q) as q from c{i} c left join (select k, list(cast((s - ((s % n) + n) % n) // n as bigint) order by p) as q from s{i} group by k) m using (k))",
        ]
    out.append(near.format(i=rounds))
    return (
        "with " + ",\n".join(out) + f" select vec_id, cast(b.k as int) as cluster, b.d as distance, cast(sum(b.d) over (partition by b.k) as bigint) as cluster_inertia, cast(sum(b.d) over () as bigint) as inertia, sha256(array_to_string(c.q, ',')) as centroid_sha256"
        f" from a{rounds} a join v using (r) join c{rounds} c on c.k = (a.b).k"
    )


ORACLES = {"op3_benchmark_decontamination": _OP3, "op4_jaccard_join": _OP4, "op12_fill_middle": _OP12, "op13_centroids": _op13()}
