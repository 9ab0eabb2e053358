"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

WORD = "[^\\x20\\x09-\\x0D]+"

MIXING = f"""
with sizes as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint size from documents),
totals as (
  select source, sum(size)::bigint source_size,
         row_number() over (order by source is null, source collate "binary") - 1 place
  from sizes group by source),
weighted as (
  select *, [3.0, 1.0, 2.0][(place % 3 + 1)::int]::double weight, source_size * 2.0::double cap from totals),
turns as (
  select *, cap / weight turn,
         coalesce(sum(cap) over (order by cap / weight, source rows between unbounded preceding and 1 preceding), 0) caps,
         coalesce(sum(weight) over (order by cap / weight, source rows between unbounded preceding and 1 preceding), 0) held
  from weighted),
levels as (
  select *, (1.5 * (select sum(source_size) from totals) - caps) / ((select sum(weight) from weighted) - held) level
  from turns),
found as (select (select level from levels where level < turn order by turn, caps limit 1) level),
targets as (
  select t.source, t.source_size,
         case when f.level is null then t.cap else least(t.cap, t.weight * f.level) end target
  from turns t, found f),
places as (
  select s.*, t.source_size, t.target,
         case when t.source_size > 0
              then least(floor(t.target / t.source_size * 1073741824), 2147483648)::bigint else 0 end expected,
         ('0x' || substr(md5(coalesce(s.source, '') || '|41'), 1, 7))::bigint * 4 shift,
         row_number() over (partition by s.source order by s.size, s.doc_id) - 1 n
  from sizes s join targets t on s.source is not distinct from t.source)
select doc_id, source, size, source_size, target,
       ((n * expected + shift + expected) // 1073741824 - (n * expected + shift) // 1073741824) * size taken,
       (n * expected + shift + expected) // 1073741824 - (n * expected + shift) // 1073741824 copies
from places
"""

JACCARD = f"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '{WORD}') w from documents),
sets as (
  select doc_id, case when w is null or len(w) = 0 then []
                      when len(w) < 4 then [array_to_string(w, ' ')]
                      else list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) end s
  from words),
classes as (
  select doc_id, len(s)::bigint n, min(doc_id) over (partition by list_sort(s)) class_id from sets),
flat as (
  select s.doc_id, c.n, unnest(s.s) t from sets s join classes c using (doc_id) where c.class_id = s.doc_id),
pairs as (
  select a.doc_id a, b.doc_id b, any_value(a.n) an, any_value(b.n) bn, count(*) shared
  from flat a join flat b on a.t = b.t and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  group by 1, 2),
links as (select a, b from pairs where 100 * shared >= 85 * (an + bn - shared)),
near as (select a, b from links union all select b, a from links),
walk(id, root) as (select a, a from near union select n.b, w.root from walk w join near n on n.a = w.id),
roots as (select id, min(root) root from walk group by id)
select c.doc_id, c.n n_shingles,
       case when c.n = 0 then c.doc_id else coalesce(r.root, c.class_id) end component_id,
       case when c.n = 0 then c.doc_id else c.class_id end class_id
from classes c left join roots r on r.id = c.class_id
"""

KNN = """
with vectors as (
  select vec_id, [floor(256 * x::double) for x in embedding] v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select q.vec_id query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint score
  from vectors q join vectors c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int "rank", vec_id, score
from scores qualify "rank" <= 5
"""

IMPORTANCE = """
with steps as (
  select list(list_reduce([n] || range(8), lambda a, i: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)
              order by n) t from range(256) r(n)),
given as (
  select 'd' side, doc_id, text from documents union all select 't', null, text from benchmark),
split as (
  select side, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from given),
counted as (select side, doc_id, unnest(w) w from split),
names as (select distinct w, hex(encode(w)) h from counted),
bytes as (select w, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint) b from names),
buckets as (
  select w, xor(list_reduce([4294967295::bigint] || b, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295)
            % 10000 bucket from bytes, steps),
sums as (
  select bucket, count(*) filter (side = 'd') s, count(*) filter (side = 't') t
  from counted join buckets using (w) group by bucket),
totals as (select coalesce(sum(s), 0) s_all, coalesce(sum(t), 0) t_all from sums),
gains as (
  select bucket, floor(1000 * ln(((t + 1)::double * (s_all + 10000)::double)
                                 / ((s + 1)::double * (t_all + 10000)::double)))::bigint gain from sums, totals),
weights as (
  select doc_id, count(*) n_features, floor(sum(gain) / count(*))::bigint weight
  from counted join buckets using (w) join gains using (bucket) where side = 'd' group by doc_id),
scored as (
  select d.doc_id, coalesce(n_features, 0)::bigint n_features, coalesce(weight, 0)::bigint weight,
         ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint h
  from documents d left join weights w on w.doc_id = d.doc_id),
final as (
  select doc_id, n_features, weight,
         weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint score from scored),
places as (
  select doc_id, row_number() over (order by score desc, doc_id) place, count(*) over () able
  from final where n_features >= 20)
select f.doc_id, n_features, weight, score, case when place <= 10 * able // 100 then place end "rank"
from final f left join places p on p.doc_id = f.doc_id
"""


def _clusters(k: int = 16, rounds: int = 3) -> str:
    """Lloyd's rounds, one pair of steps each."""
    parts = ["""
with vectors as materialized (
  select row_number() over () row_id, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) v
  from embeddings
  where embedding is not null and len(embedding) = 64
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""", f"""
centres0 as materialized (
  select row_number() over (order by sha256('1:' || vec_id), v) - 1 c, v from vectors qualify c < {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""
near{i} as materialized (
  select row_id, vec_id, a.v, min({{'d': list_dot_product(a.v, a.v) - 2 * list_dot_product(a.v, b.v)
                                       + list_dot_product(b.v, b.v), 'c': c}}) best
  from vectors a, centres{i} b group by row_id, vec_id, a.v)""")
        if i < rounds:
            parts.append(f"""
means{i} as materialized (
  select c, list(floor(total / n) order by place) v
  from (select best.c c, place, sum(v[place]) total, count(*) n
        from near{i}, (select unnest(range(1, 65)) place) group by best.c, place) group by c),
centres{i + 1} as materialized (
  select a.c, coalesce(b.v, a.v) v from centres{i} a left join means{i} b on a.c = b.c)""")
    return ",".join(parts) + f"""
select vec_id, best.c::int "cluster", best.d::bigint distance,
       (sum(best.d) over (partition by best.c))::bigint cluster_inertia, (sum(best.d) over ())::bigint inertia,
       sha256(array_to_string(list_transform(b.v, lambda x: x::bigint::varchar), ',')) centroid_sha256
from near{rounds} a join centres{rounds} b on a.best.c = b.c
"""


CLUSTERS = _clusters()

FOREST = """
with recursive vectors as (
  select row_number() over () row_id, vec_id, label, embedding::double[] v,
         embedding is not null and label is not null
         and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
         and len(list_filter(embedding, lambda x: x <> 0)) > 0 usable
  from embeddings),
links as materialized (
  select a.row_id a, b.row_id b, b.vec_id from vectors a join vectors b
  on a.usable and b.usable and a.label = b.label and len(a.v) = len(b.v) and a.row_id <> b.row_id
  where list_cosine_similarity(a.v, b.v) >= 0.93),
walk(a, b) as (select a, b from links union select w.a, l.b from walk w join links l on l.a = w.b),
roots as (select w.a, min(v.vec_id) least from walk w join vectors v on v.row_id = w.b group by w.a),
counts as (select a, count(*) n from links group by a)
select v.vec_id, coalesce(n, 0)::bigint n_links, coalesce(least(r.least, v.vec_id), v.vec_id) component_id,
       v.vec_id = coalesce(least(r.least, v.vec_id), v.vec_id) kept
from vectors v left join counts c on c.a = v.row_id left join roots r on r.a = v.row_id
"""

ORACLES = {"op1_source_mixing": MIXING, "op7_jaccard_join": JACCARD, "op8_voronoi_knn": KNN,
           "op11_importance_resampling": IMPORTANCE, "op12_heap_clusters": CLUSTERS, "op13_projection_forest": FOREST}
