"""The queries of this subpackage: one for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, covertree, media, minhash, mixture, quality, shards, substrings, suffixes, toxicity
from .base import table


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.deduplicated(table(spark, sf_dir, "documents"), both_ends=True)
    return found.select("doc_id", "n_sentences", "n_removed", "n_spans", "text")


def op2_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.interleave(table(spark, sf_dir, "documents"))


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.described(media.media_columns(table(spark, sf_dir, "documents")))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def tokenizer() -> str:
    """The path of the public vocabulary; executors have the same files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer(), ids=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substrings": op1_substrings,
    "op2_covertree": op2_covertree,
    "op3_toxicity": op3_toxicity,
    "op4_suffixes": op4_suffixes,
    "op5_sharding": op5_sharding,
    "op6_mixture": op6_mixture,
    "op7_media": op7_media,
    "op8_minhash": op8_minhash,
    "op9_quality": op9_quality,
    "op10_bpe": op10_bpe,
}

_FINITE = "len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0"

ORACLE_SQL: dict[str, str] = {
    "op1_substrings": r"""
        with docs as (
            select row_number() over () as r, doc_id, "text" as body, regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') as tokens from documents
        ), words as (
            select r, unnest(tokens) as token, unnest(range(len(tokens))) as i from docs
        ), marked as (
            select r, i, token, regexp_extract(token, '^[^\x20\x09-\x0D]+') as word from words
        ), ended as (
            select r, i, token, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low,
                contains(token, chr(10)) or right(regexp_extract(word, '^((?s).+?)["'')\]}]{0,2}$', 1), 1) in ('.', '!', '?', ';', ':', ',', '。', '！', '？', '，') as last
            from marked
        ), numbered as (
            select r, i, token, low, coalesce(sum(last::int) over (partition by r order by i rows between unbounded preceding and 1 preceding), 0)::int as k from ended
        ), sentences as (
            select r, k, min(i) as f, max(i) + 1 as u, string_agg(token, '' order by i) as body, string_agg(low, ' ' order by i) as low from numbered group by r, k
        ), runs as (
            select a.r, a.k as i, min(b.k) as j from sentences a join sentences b on a.r = b.r and b.k between a.k + 1 and a.k + 25 and b.u - a.f >= 20 group by all
            union select a.r, max(b.k) as i, a.k as j from sentences a join sentences b on a.r = b.r and b.k between a.k - 25 and a.k - 1 and a.u - b.f >= 20 group by a.r, a.k
            union select r, k, k from sentences where u - f >= 20
        ), hashed as (
            select runs.r, doc_id, i, j, md5(string_agg(low, ' ' order by k)) as h
            from runs join docs using (r) join sentences s on s.r = runs.r and s.k between runs.i and runs.j group by runs.r, doc_id, i, j
        ), again as (
            select *, count(*) over (partition by h) as n, min({'none': doc_id is not null, 'd': doc_id, 'p': i}) over (partition by h) as first from hashed
        ), cuts as (
            select r, i, j from again where n > 1 and (doc_id is distinct from first.d or i <> first.p)
        ), gone as (
            select distinct s.r, s.k from sentences s join cuts on cuts.r = s.r and s.k between cuts.i and cuts.j
        ), flagged as (
            select s.r, s.k, s.body, g.k is not null as gone, lag(g.k is not null) over (partition by s.r order by s.k) as before from sentences s left join gone g on g.r = s.r and g.k = s.k
        ), totals as (
            select r, count(*) as n, count(*) filter (gone) as removed, count(*) filter (gone and not coalesce(before, false)) as spans, string_agg(case when gone then '' else body end, '' order by k) as kept from flagged group by r
        )
        select doc_id, coalesce(n, 0)::bigint as n_sentences, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
            case when removed > 0 then regexp_extract(body, '^[\x20\x09-\x0D]*') || kept else body end as "text"
        from docs left join totals using (r)
    """,
    "op2_covertree": f"""
        with recursive v as (
            select row_number() over () as r, vec_id, coalesce({_FINITE}, false) as valid, embedding::double[] as e from embeddings
        ), links as (
            select a.r as a, b.r as b from v a join v b on a.r <> b.r and len(a.e) = len(b.e) and a.valid and b.valid
            where list_cosine_similarity(a.e, b.e) >= 0.9
        ), reach(r, s) as (
            select r, r from v union select reach.r, links.b from reach join links on reach.s = links.a
        ), component as (
            select reach.r, min(v.vec_id) as c from reach join v on v.r = reach.s group by reach.r
        )
        select vec_id, (select count(*) from links where links.a = v.r) as n_links, c as component_id,
            vec_id is not distinct from c as kept
        from v join component using (r)
    """,
    "op4_suffixes": r"""
        with docs as (select row_number() over () as r, doc_id, hex(encode(coalesce("text", ''))) as h from documents),
        places as (select r, unnest(range(0, len(h) // 2 - 199)) as i, h from docs),
        strings as (select r, i, md5(substr(h, 2 * i + 1, 400)) as m from places),
        again as (select r, i from (select r, i, count(*) over (partition by m) as n from strings) where n > 1),
        next as (select r, i, lag(i) over (partition by r order by i) as p from again),
        runs as (select r, i, sum(case when p is null or i - p > 200 then 1 else 0 end) over (partition by r order by i) as g from next),
        spans as (select r, min(i) as a, max(i) + 200 as b from runs group by r, g),
        parts as (select r, a, b, coalesce(lag(b) over (partition by r order by a), 0) as p from spans),
        pieces as (
            select r, a, substr(h, 2 * p + 1, 2 * (a - p)) as piece from parts join docs using (r)
            union all select r, len(h), substr(h, 2 * max(b) + 1) from spans join docs using (r) group by r, h
        ), kept as (select r, string_agg(piece, '' order by a) as k from pieces group by r),
        gone as (select r, sum(b - a) as n_removed, count(*) as n_spans from spans group by r)
        select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
            sha256(unhex(coalesce(k, h))) as kept_sha256
        from docs left join kept using (r) left join gone using (r)
    """,
    "op5_sharding": r"""
        with bits as (select i, list_reduce(list_prepend(i, range(8)), lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as v from range(256) r(i)),
        crc as (select list(v order by i) as t from bits),
        docs as (select doc_id, source, coalesce("text", '') as body, hex(encode(coalesce("text", ''))) as h from documents),
        rows_ as (
            select doc_id, source, (len(h) // 2 + 8)::bigint as size, ('0x' || substr(md5('0|' || coalesce(doc_id::varchar, '') || '|' || body), 1, 15))::bigint as k,
                xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295)::bigint as text_crc32
            from docs, crc
        ), ranked as (
            select *, (row_number() over (partition by source order by k, doc_id nulls first, text_crc32, size) - 1 + 0.5::double) / count(*) over (partition by source) as part_at from rows_
        ), placed as (
            select *, row_number() over (order by part_at, source nulls first, doc_id nulls first, text_crc32, size) - 1 as g, count(*) over () as total from ranked
        ), cut as (select *, (g * 24 // total)::int as shard from placed)
        select doc_id, size, text_crc32, 'rows' as law, shard, (row_number() over (partition by shard order by g) - 1)::bigint as slot, null::int as grown_shard, source from cut
    """,
    "op6_mixture": r"""
        with recursive docs as (
            select doc_id, source, len(regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+'))::bigint as size,
                ('0x' || substr(md5('0|' || coalesce(doc_id::varchar, '') || '|' || coalesce("text", '')), 1, 15))::bigint as h
            from documents
        ), per as (
            select source, sum(size)::bigint as source_size, count(*)::bigint as documents, row_number() over (order by source nulls last) as s from docs group by source
        ), weighed as (
            select *, ([3.0, 1.0, 2.0]::double[])[((s - 1) % 3 + 1)::int] as w, source_size * 2.0::double as stop, sum(source_size) over ()::double * 1.5::double as budget from per
        ), filled as (
            select *, stop / w as ratio, (budget - coalesce(sum(stop) over (order by stop / w, s rows between unbounded preceding and 1 preceding), 0.0))
                / (sum(w) over () - coalesce(sum(w) over (order by stop / w, s rows between unbounded preceding and 1 preceding), 0.0)) as level from weighed
        ), levelled as (
            select *, (select f.level from filled f where f.level <= f.ratio order by f.ratio, f.s limit 1) as water from filled
        ), targets as (
            select s, source, source_size, documents, least(stop, coalesce(w * water, stop)) as target from levelled
        ), hist as (
            select s, size, count(*)::bigint as n from docs join per on docs.source is not distinct from per.source group by all
        ), lists as (
            select t.s, t.target, t.source_size, list({'x': size * documents / source_size::double, 'm': (n * size)::double}) as l,
                case when target < source_size then -1 / (exp(1.0) * (target / source_size)) else 0.0 end as lo,
                case when target > source_size then ln(2.0) / min(size * documents / source_size::double) else 0.0 end as hi
            from targets t join hist on hist.s = t.s where size > 0 and target < source_size * 2.0::double * (1 - 1e-12) group by t.s, t.target, t.source_size, t.documents
        ), solved as (
            select s, list_reduce(list_prepend({'lo': lo, 'hi': hi}, list_transform(range(200), lambda k: {'lo': lo, 'hi': hi})),
                lambda a, k: case when list_sum(list_transform(l, lambda e: e.m * least(2.0, exp((a.lo + a.hi) / 2 * e.x)))) < target
                    then {'lo': (a.lo + a.hi) / 2, 'hi': a.hi} else {'lo': a.lo, 'hi': (a.lo + a.hi) / 2} end) as b
            from lists
        ), rates as (
            select h.s, h.size, h.n, t.target, case when h.size = 0 then 1.0::double
                else coalesce(least(2.0, exp(format('{:.7e}', (b.lo + b.hi) / 2)::double * h.size * t.documents / t.source_size)), 2.0::double) end as rate
            from hist h join targets t on t.s = h.s left join solved on solved.s = h.s
        ), summed as (select *, sum(n * rate) over (partition by s order by size) as upto from rates),
        cut as (
            select s, size, n, target, rate, greatest(0, least(floor(upto + 0.5) - floor(upto - n * rate + 0.5), 2 * n))::bigint as total from summed
        ), misses as (select s, max(target) - sum(size * total) as miss from cut group by s),
        room as (
            select c.s, miss, size, case when miss > 0 then 2 * n - total else total end as spare from cut c join misses m on m.s = c.s
            where size > 0 and size <= abs(miss) and case when miss > 0 then 2 * n - total else total end > 0
        ), best as (
            select s, miss, floor(log2(size)) as scale, max({'spare': spare, 'less': -size}) as top from room group by all
        ), steps as (
            select s, miss, -top.less as size, top.spare as spare, row_number() over (partition by s order by -top.less desc) as i from best
        ), walk(s, i, remains, size, k) as (
            select distinct s, 0::bigint, abs(miss)::double, null::bigint, 0::bigint from steps
            union all
            select w.s, p.i, w.remains - least(p.spare, floor(w.remains / p.size)::bigint) * p.size, p.size, least(p.spare, floor(w.remains / p.size)::bigint)
            from walk w join steps p on p.s = w.s and p.i = w.i + 1
        ), totals as (
            select c.s, c.size, c.n, c.rate, c.total + coalesce((case when miss > 0 then 1 else -1 end) * k, 0) as total
            from cut c join misses m on m.s = c.s left join walk on walk.s = c.s and walk.size = c.size
        ), dealt as (
            select doc_id, docs.size, per.s, row_number() over (partition by per.s, docs.size order by h, doc_id nulls first) - 1 as j from docs join per on docs.source is not distinct from per.source
        )
        select doc_id, d.size, source_size, target, round(rate, 6) as rate, (((j + 1) * total) // n - (j * total) // n)::int as copies,
            d.size * (((j + 1) * total) // n - (j * total) // n)::bigint as taken
        from dealt d join totals t on t.s = d.s and t.size = d.size join targets g on g.s = d.s
    """,
    "op8_minhash": r"""
        with recursive words as (
            select row_number() over () as r, doc_id,
                regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
            from documents
        ), sets as (
            select r, doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
                else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
            from words
        ), each as (select r, unnest(s) as x from sets),
        shared as (select a.r as a, b.r as b, count(*) as n from each a join each b on a.x = b.x and a.r < b.r group by all),
        pairs as (
            select a, b from shared join sets p on p.r = a join sets q on q.r = b where 100 * n >= 85 * (len(p.s) + len(q.s) - n)
        ), links as (select a, b from pairs union all select b, a from pairs),
        reach(r, s) as (select r, r from sets union select reach.r, links.b from reach join links on reach.s = links.a),
        component as (select reach.r, min(sets.doc_id) as c from reach join sets on sets.r = reach.s group by reach.r)
        select doc_id, len(s)::bigint as n_shingles, c as component_id, doc_id is not distinct from c as kept
        from sets join component using (r)
    """,
}
