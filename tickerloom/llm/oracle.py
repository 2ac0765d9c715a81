"""DuckDB text with the meaning of the registered queries, where SQL can express them."""

from __future__ import annotations

MIXING = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), named as (
  select source, sum(size)::bigint as source_size, count(*) as documents from sized group by source
), ranked as (
  select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight, 2 * source_size as cap from named
), levels as (
  select *, cap / weight as ratio,
    (1.5 * sum(source_size) over () - coalesce(sum(cap) over before, 0)) / sum(weight) over onward as level,
    row_number() over (order by cap / weight, source nulls last) as place
  from ranked
  window before as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding),
    onward as (order by cap / weight, source nulls last rows between current row and unbounded following)
), goals as (
  select source, source_size, documents, least(cap::double, coalesce(
    (select arg_min(level, place) from levels where level <= ratio) * weight, cap::double)) as target
  from levels
), rated as (
  select *, case when source_size > 0 then least(round(target / source_size * 1000000000)::bigint, 2000000000) else 0 end as units,
    ceil(documents / 4000)::bigint as chunks
  from goals
), placed as (
  select s.doc_id, s.source, s.size, r.source_size, r.target, r.units // 1000000000 as base, r.units % 1000000000 as part,
    ((coalesce(s.doc_id, 0) % 1000003) * 7919 + s.size * 104729) % r.chunks as chunk
  from sized s join rated r on s.source is not distinct from r.source
), numbered as (
  select *, row_number() over (partition by source, chunk order by size desc, doc_id nulls last) as turn from placed
), recursive_round as (
  with recursive walk as (
    select doc_id, source, chunk, turn, size, source_size, target, base,
      (size > 0 and part > 0 and 2 * part::hugeint * size >= 1000000000::hugeint * size) as extra,
      part::hugeint * size - case when size > 0 and part > 0 and 2 * part::hugeint * size >= 1000000000::hugeint * size
        then 1000000000::hugeint * size else 0 end as behind
    from numbered where turn = 1
    union all
    select n.doc_id, n.source, n.chunk, n.turn, n.size, n.source_size, n.target, n.base,
      (n.size > 0 and n.part > 0 and 2 * (w.behind + n.part::hugeint * n.size) >= 1000000000::hugeint * n.size),
      w.behind + n.part::hugeint * n.size - case when n.size > 0 and n.part > 0
        and 2 * (w.behind + n.part::hugeint * n.size) >= 1000000000::hugeint * n.size then 1000000000::hugeint * n.size else 0 end
    from walk w join numbered n
      on n.source is not distinct from w.source and n.chunk = w.chunk and n.turn = w.turn + 1
  )
  select * from walk
)
select doc_id, size, source_size, target, ((base + extra::bigint) * size)::bigint as taken, (base + extra::bigint)::int as copies
from recursive_round
"""

ARCHIVE = """
with hashed as (
  select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as digest from pages
), kept as (
  select payload, max(page_id) as keeper from hashed group by payload
)
select h.page_id, strlen(h.payload)::bigint as payload_bytes,
  list_aggregate(list_transform(range(0, 8), lambda k: translate(
    lpad(to_base(('0x' || substr(h.digest, (5 * k + 1)::int, 5))::bigint, 32), 4, '0'),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')), 'string_agg', '') as payload_digest,
  case when h.page_id is not distinct from k.keeper then 'response' else 'revisit' end as record_type,
  case when h.page_id is not distinct from k.keeper then null else k.keeper end as refers_to
from hashed h join kept k on h.payload = k.payload
"""

NEAR_DUPLICATES = r"""
with recursive worded as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w from documents
), shingled as (
  select distinct doc_id, md5_number(array_to_string(s, ' ')) as shingle from (
    select doc_id, unnest(case when len(w) >= 5
      then list_transform(range(1, len(w) - 3), lambda k: w[k : k + 4]) when len(w) > 0 then [w] else [] end) as s
    from worded)
), sizes as (
  select doc_id, count(*) as n from shingled group by doc_id
), links as (
  select p.a, p.b from (
    select x.doc_id as a, y.doc_id as b, count(*) as common
    from shingled x join shingled y on x.shingle = y.shingle and x.doc_id <> y.doc_id group by 1, 2) p
  join sizes s on s.doc_id = p.a join sizes t on t.doc_id = p.b where 100 * common >= 75 * (s.n + t.n - common)
), reach as (
  select doc_id, doc_id as other from documents
  union
  select r.doc_id, l.b from reach r join links l on l.a = r.other
)
select d.doc_id, coalesce(any_value(s.n), 0)::bigint as n_shingles, min(r.other) as component_id, d.doc_id = min(r.other) as kept
from documents d left join sizes s on s.doc_id = d.doc_id join reach r on r.doc_id = d.doc_id group by d.doc_id
"""

TOP_K = """
with vectors as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id,
    list_sum(list_transform(range(1, len(q.v) + 1), lambda k: q.v[k] * c.v[k]))::bigint as score
  from vectors q join vectors c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 100 = 0
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from scored qualify rank <= 10
"""

INFILL = r"""
with cut as (
  select doc_id, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units,
    sha256('42:' || coalesce(doc_id::varchar, '')) as h
  from documents
), drawn as (
  select *, len(units) as n, list_transform(range(0, 4), lambda k: ('0x' || substr(h, (8 * k + 1)::int, 8))::bigint) as d from cut
), formed as (
  select *, least(d[1] % (n + 1), d[2] % (n + 1)) as one, greatest(d[1] % (n + 1), d[2] % (n + 1)) as two,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or d[3] % 100 >= 50 then 'plain'
      when d[4] % 100 < 80 then 'spm' else 'psm' end as form
  from drawn
), parts as (
  select *, array_to_string(units[:one], '') as p, array_to_string(units[one + 1 : two], '') as m, array_to_string(units[two + 1 :], '') as s
  from formed
)
select doc_id, n::bigint as n, form,
  case when form <> 'plain' then length(p) end::bigint as prefix_chars,
  case when form <> 'plain' then length(m) end::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
    else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""


def _merkle_field(name: str) -> str:
    return f"case when {name} is null then '-' else strlen({name}::varchar) || ':' || {name}::varchar end"


def _merkle_leaf(text: str) -> str:
    fields = [_merkle_field(name) for name in ("doc_id", "source", "lang", "n_chars")]
    return f"sha256({' || '.join([*fields, text])})"


MANIFEST = f"""
with recursive read as (
  select *, {_merkle_field("lang")} as tree, {_merkle_leaf(_merkle_field("text"))} as leaf,
    {_merkle_leaf(_merkle_field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))} as other,
    list_reduce(list_transform(range(1, length(doc_id::varchar) + 1), lambda k: ord(substr(doc_id::varchar, k::int, 1))::bigint),
      lambda crc, byte: list_reduce(range(0, 8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), xor(crc, byte)), 4294967295) as crc
  from documents
), leaves as (
  select tree, lang, doc_id, leaf, case when xor(crc, 4294967295) % 3 = 0 then other else leaf end as claim,
    row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by tree) as n
  from read
), low as (
  select tree, 0 as level, idx, leaf as hash, n from leaves
  union all
  select tree, level + 1, idx // 8, sha256(string_agg(hash, '' order by idx)), (any_value(n) + 7) // 8
  from low where n > 1 group by tree, level, idx // 8
), subroots as (
  select l.tree, l.hash as subroot, row_number() over (order by any_value(v.lang) nulls first) - 1 as idx, count(*) over () as n
  from low l join leaves v on v.tree = l.tree where l.n = 1 group by l.tree, l.hash
), high as (
  select '' as tree, 0 as level, idx, subroot as hash, n from subroots
  union all
  select tree, level + 1, idx // 8, sha256(string_agg(hash, '' order by idx)), (any_value(n) + 7) // 8
  from high where n > 1 group by tree, level, idx // 8
), runs as (
  select tree, level, idx // 8 as parent, list(hash order by idx) as members
  from (select * from low union all select * from high) where n > 1 group by tree, level, idx // 8
), walk as (
  select v.doc_id, v.idx as start, v.leaf, v.tree as own, v.tree, 0 as level, v.idx, v.n, v.claim as value, '' as proof, s.subroot,
    s.idx as place, s.n as places
  from leaves v join subroots s on s.tree = v.tree
  union all
  select w.doc_id, w.start, w.leaf, w.own,
    case when w.n = 1 then '' else w.tree end, case when w.n = 1 then 0 else w.level + 1 end,
    case when w.n = 1 then w.place else w.idx // 8 end, case when w.n = 1 then w.places else (w.n + 7) // 8 end,
    case when w.n = 1 then w.value else sha256(array_to_string(
      r.members[: w.idx % 8] || [w.value] || r.members[w.idx % 8 + 2 :], '')) end,
    case when w.n = 1 then w.proof else w.proof || array_to_string(r.members[: w.idx % 8] || r.members[w.idx % 8 + 2 :], '') end,
    w.subroot, w.place, w.places
  from walk w left join runs r on r.tree = w.tree and r.level = w.level and r.parent = w.idx // 8
  where w.n > 1 or w.tree <> ''
)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, value as folded_root, value = root as verified
from walk, (select hash as root from high where n = 1) where tree = '' and n = 1
"""

ORACLES: dict[str, str] = {
    "op11_sparse_exception_infill": INFILL,
    "op12_octopus_manifest": MANIFEST,
    "op2_entropy_mixing": MIXING,
    "op3_content_archive": ARCHIVE,
    "op4_tensored_minhash": NEAR_DUPLICATES,
    "op10_norm_bucket_topk": TOP_K,
}
