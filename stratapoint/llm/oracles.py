"""DuckDB SQL for the registered queries whose rows SQL can express: exact answers over all rows, without the operators' methods."""

from __future__ import annotations

from .embeddings import VectorParams
from .jaccard import JaccardParams
from .licenses import TEMPLATES, LicenseParams
from .mixing import MixParams
from .sharding import SAME, ShardParams


def mix_sql(p: MixParams = MixParams()) -> str:
    """Water-filling in closed form; a source's blocks are the first words of its shuffled stream, and slots follow the van der Corput points."""
    weight = "case s.sid % {} {} end".format(len(p.weights), " ".join(f"when {i} then {float(w)!r}" for i, w in enumerate(p.weights)))
    b = p.block_words
    return rf"""
    with d as (
      select doc_id, row_number() over () rid, case when source is null then '~' else '=' || source end source_key,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size,
        ('0x' || substr(md5('{p.seed}|' || coalesce(doc_id::varchar, '')), 1, 15))::bigint h from documents),
    sz as (select source_key, sum(size)::bigint source_size from d group by 1),
    s0 as (select *, (row_number() over (order by source_key) - 1)::bigint sid from sz),
    s1 as (select s.*, {weight} weight, {float(p.cap)!r} * source_size most from s0 s),
    goal as (select {p.share!r} * sum(size) goal from d),
    s2 as (select *, sum(most) over w - most used, sum(weight) over (order by most / weight desc, sid desc) open_, most / weight ratio, row_number() over w i
      from s1 where source_size > 0 window w as (order by most / weight, sid)),
    lev as (select arg_min((goal - used) / open_, i) lvl from s2, goal where (goal - used) / open_ < ratio),
    s3 as (select source_key, sid, source_size, least(most, coalesce(weight * lvl, most)) target from s1, lev),
    s4 as (select *, least(floor(target + 0.5)::bigint, source_size * {p.cap}) take from s3),
    s5 as (select *, coalesce(sum(take) over (order by sid rows between unbounded preceding and 1 preceding), 0)::bigint take_from from s4),
    tot as (select sum(take)::bigint total, ((sum(take) + {b - 1}) // {b})::bigint n_slots from s5),
    slots as (select slot, list_sum(list_transform(range(0, 32), lambda b: ((slot >> b::int) & 1) / pow(2.0, b + 1))) point from (select unnest(range(0, (select n_slots from tot))) slot)),
    placed as (select sid, take, slot, row_number() over (partition by sid order by slot) - 1 block from slots, s5, tot
      where take > 0 and point >= take_from / total::double and point < (take_from + take) / total::double),
    had as (select sid, count(*) had from placed group by 1),
    blocks as (
      select sid, block, slot from placed where block < ceil(take / {float(b)!r})
      union all select sid, unnest(range(coalesce(had, 0), ceil(take / {float(b)!r})::bigint)) block, n_slots slot from s5 left join had using (sid), tot where coalesce(had, 0) < ceil(take / {float(b)!r})),
    n as (select greatest(1, (count(*) + {p.bucket_rows - 1}) // {p.bucket_rows})::bigint n from d),
    r as (select d.doc_id, d.rid, d.size, s5.sid, s5.source_size, s5.target, s5.take,
        sum(d.size) over (partition by sid order by h % n, h, doc_id nulls first, d.size, rid) - d.size begins from d join s5 using (source_key), n),
    passes as (select r.*, k, begins + k * source_size lo from r, (select unnest(range(0, {p.cap})) k)),
    hit as (select rid, k, greatest(0, least(lo + size, take) - lo) w from passes where size > 0),
    met as (select q.rid, min(slot) first_slot from passes q join blocks b on q.sid = b.sid and q.size > 0 and q.lo < least((block + 1) * {b}, take) and q.lo + q.size > block * {b} group by 1),
    taken as (select rid, sum(w)::bigint taken, sum(case when w * 2 > size then 1 else 0 end)::int copies from hit join r using (rid) group by 1)
    select doc_id, size, source_size, target, coalesce(taken, 0)::bigint taken, coalesce(copies, 0)::int copies, coalesce(first_slot, -1)::bigint first_slot from r left join taken using (rid) left join met using (rid)
    """


def vectors_sql(p: VectorParams = VectorParams()) -> str:
    return f"""
    with recursive v as (select vec_id, row_number() over () rid, embedding::double[] e, label from embeddings),
    good as (select * from v where label is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
    link as (select a.rid a, b.rid b, b.vec_id from good a join good b on a.label = b.label and a.rid <> b.rid and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= {p.cosine!r}),
    reach(rid, other) as (select rid, rid from v union select r.rid, l.b from reach r join link l on l.a = r.other),
    least as (select r.rid, min(v.vec_id) component_id from reach r join v on v.rid = r.other group by 1),
    n as (select a rid, count(*) n from link group by 1)
    select vec_id, coalesce(n, 0)::bigint n_links, component_id, vec_id = component_id kept from v join least using (rid) left join n using (rid)
    """


def jaccard_sql(p: JaccardParams = JaccardParams()) -> str:
    space = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    k = p.words
    return rf"""
    with recursive t as (select doc_id, row_number() over () rid, string_split(trim(regexp_replace(lower(coalesce(text, '')), '{space}', ' ', 'g')), ' ') w from documents),
    g as (select rid, doc_id, case when w[1] = '' then [] when len(w) < {k} then [array_to_string(w, ' ')]
      else list_sort(list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k - 1}], ' ')))) end s from t),
    cls as (select min(doc_id) class_id, count(*) class_size, s, row_number() over () cid from g where len(s) > 0 group by s),
    sh as (select cid, len(s) n, unnest(s) x from cls),
    pr as (select a.cid a, b.cid b, any_value(a.n) na, any_value(b.n) nb, count(*) shared from sh a join sh b on a.x = b.x and a.cid <> b.cid group by 1, 2),
    link as (select a, b from pr where shared >= {p.threshold!r} * (na + nb - shared) - 1e-6),
    reach(cid, other) as (select cid, cid from cls union select r.cid, l.b from reach r join link l on l.a = r.other),
    comp as (select r.cid, min(c.class_id) component_id from reach r join cls c on c.cid = r.other group by 1),
    n as (select l.a cid, sum(c.class_size) n from link l join cls c on c.cid = l.b group by 1)
    select g.doc_id, coalesce(c.class_id, g.doc_id) class_id, coalesce(c.class_size, 1)::bigint class_size, coalesce(coalesce(n, 0) + c.class_size - 1, 0)::bigint n_links,
      coalesce(component_id, g.doc_id) component_id, coalesce(component_id, g.doc_id) = g.doc_id kept
    from g left join cls c using (s) left join comp using (cid) left join n using (cid)
    """


_WORDS = r"string_split(trim(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"


def _passages(items: str, p) -> str:
    """Shared windows of every text and item: hit(rid, item, m, d, start, w, shared, held) for all windows that share a shingle."""
    gram = "list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))"
    return f"""
    t as (select doc_id, row_number() over () rid, {_WORDS.format("text")} w from documents),
    it0 as (select item, {_WORDS.format("body")} w from ({items}) where item is not null),
    it as (select distinct item, k, hs, len(hs) m, len(list_distinct(hs)) d from (select item, k, {gram} hs from (select *, least(len(w), {p.words}) k from it0 where w[1] <> ''))),
    its as (select item, hs, k, m, x, count(*) b from (select item, hs, k, m, unnest(hs) x from it) group by all),
    g as (select rid, k, len(hs) n, unnest(hs) x, unnest(range(0, len(hs))) pos from (select rid, k, {gram} hs from t, (select distinct k from it) where len(w) >= k and w[1] <> '')),
    place as (select rid, n, pos, x, item, hs, k, m, b from g join its using (k, x)),
    win as (select *, unnest(range(greatest(0, pos - least(m, n) + 1), least(pos, n - least(m, n)) + 1)) start from place),
    per as (select rid, item, hs, m, n, start, x, least(count(*), any_value(b)) c from win group by all),
    hit as (select rid, item, m, start, least(m, n) w, len(list_distinct(hs)) d, sum(c) shared, count(*) held from per group by rid, item, hs, m, n, start)"""


def decontaminate_sql(p) -> str:
    return f"""
    with {_passages("select item_id item, text body from benchmark", p)},
    found as (select rid, item, max(shared / (w + m - shared)) sim from hit where shared / (w + m - shared) >= {p.threshold!r} - 1e-12 group by 1, 2),
    doc as (select rid, count(*) n, string_agg(item::varchar, ',' order by item) items, max(sim) sim from found group by 1)
    select doc_id, n is not null contaminated, coalesce(n, 0)::int n_items, coalesce(items, '') items, coalesce(sim, 0.0)::double similarity from t left join doc using (rid)
    """


def licenses_sql(p: LicenseParams = LicenseParams()) -> str:
    listed = " union all ".join(f"select '{name}#{i}' item, '{text}' body" for name, texts in TEMPLATES.items() for i, text in enumerate(texts))
    return f"""
    with {_passages(listed, p)},
    found as (select distinct rid, string_split(item, '#')[1] license, start from hit where held >= {p.threshold!r} * d - 1e-9),
    doc as (select rid, string_agg(distinct license, ',' order by license) licenses, count(distinct license) n from found group by 1),
    places as (select rid, string_agg(start || ':' || license, ',' order by start, license) starts from found group by 1)
    select doc_id, coalesce(n, 0)::int n_licenses, coalesce(licenses, '') licenses, coalesce(starts, '') starts from t left join doc using (rid) left join places using (rid)
    """


def shards_sql(p: ShardParams = ShardParams()) -> str:
    """All levels of the histograms at once: a splitter takes the first level at which its cell is small enough."""
    number = "('0x' || substr(md5({0}), 1, 15))::bigint"
    levels = ", ".join(f"({i + 1}, {sh})" for i, sh in enumerate((52, 40, 28, 16, 4, 0)))
    near = "case when wanted - below <= below + b - wanted then cell << sh else (cell << sh) + (1::bigint << sh) end"
    chosen = "rn = 1 and (b <= tol or n <= 1 or r = 6) qualify row_number() over (partition by j order by r) = 1"
    return f"""
    with ct as (select list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i::bigint, range(0, 8)), lambda c, _: xor(c >> 1, (c & 1) * 3988292384))) tab),
    d as (select doc_id, coalesce(text, '') t,
      xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::bigint)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) crc from documents, ct),
    e as (select doc_id, strlen(t)::bigint n_bytes, crc, md5(t) h from d),
    k as (select doc_id, n_bytes + 1 size, crc, {number.format("h")} k1, ({number.format("concat_ws('|', coalesce(doc_id::varchar, ''), crc, n_bytes, h)")} >> {SAME}) << {SAME} k2 from e),
    tot as (select sum(size) / {float(p.shards)!r} ideal, sum(size) / {float(p.shards)!r} * {p.tolerance!r} tol from k),
    lv as (select * from (values {levels}) t(r, sh)),
    w as (select j, ideal * j wanted, ideal, tol from tot, (select unnest(range(1, {p.shards})) j)),
    c as (select r, sh, k1 >> sh cell, sum(size)::double b, count(*) n from k, lv group by all),
    cc as (select *, sum(b) over (partition by r order by cell) - b below from c),
    hit as (select *, row_number() over (partition by j, r order by cell) rn from cc join w on below + b >= wanted),
    pick as (select *, r = 6 and n > 1 and b > {p.group_slack!r} * ideal heavy from hit where {chosen}),
    c2 as (select j, wanted, tol, lv.r, lv.sh, k2 >> lv.sh cell, k1, any_value(pick.below) start, sum(size)::double b, count(*) n from pick join k on heavy and k1 = pick.cell, lv group by all),
    cc2 as (select *, start + sum(b) over (partition by j, r order by cell) - b below from c2),
    hit2 as (select *, row_number() over (partition by j, r order by cell) rn from cc2 where below + b >= wanted),
    pick2 as (select * from hit2 where {chosen}),
    bounds as (select {near} a, -9223372036854775808 b from pick where not heavy union all select k1, {near} from pick2),
    sh as (select k.*, (select count(*) from bounds where k.k1 > bounds.a or (k.k1 = bounds.a and k.k2 >= bounds.b))::int shard from k),
    m as (select greatest(1, (count(*) + {p.shards * p.bucket_rows - 1}) // {p.shards * p.bucket_rows})::bigint m from k)
    select doc_id, size, crc text_crc32, 'bytes' law, shard, row_number() over (partition by shard order by (k2 >> {SAME}) % m, k2, k1) - 1 slot, null::int grown_shard from sh, m
    """
