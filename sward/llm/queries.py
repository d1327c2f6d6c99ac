"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from sward.llm import common as C

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


@register("op2_minhash", r"""
with recursive
w as (select doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as ws
      from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) = 1 then [ws[1]]
        else list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) end as sh from w),
rep as (select doc_id, sh, len(sh) as n, min(doc_id) over (partition by list_sort(sh)) as rid from s),
cls as (select distinct on (rid) rid, sh, n from rep where n > 0 order by rid),
x as (select rid, n, unnest(sh) as g from cls),
pairs as (select a.rid as a, b.rid as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c
          from x a join x b on a.g = b.g and a.rid < b.rid group by a.rid, b.rid),
links as (select a, b from pairs where 100 * c >= 80 * (na + nb - c)),
sym as (select a, b from links union all select b, a from links),
reach(node, comp) as (select rid, rid from cls union select sym.b, reach.comp from reach join sym on sym.a = reach.node),
comp as (select node, min(comp) as comp from reach group by node)
select r.doc_id, cast(r.n as bigint) as n_shingles,
       case when r.n = 0 then r.doc_id else c.comp end as component_id,
       r.doc_id = (case when r.n = 0 then r.doc_id else c.comp end) as kept
from rep r left join comp c on c.node = r.rid""")
def op2_minhash(spark, sf_dir):
    """Circulant MinHash near-duplicates on 2-word shingles at similarity 0.8."""
    from sward.llm.minhash import near_duplicates
    return near_duplicates(spark, C.documents(spark, sf_dir), shingle_words=2, threshold=0.8)


@register("op8_paragraphs")
def op8_paragraphs(spark, sf_dir):
    """Paragraphs that repeat across documents, with the occurrences to remove."""
    from sward.llm.paragraphs import repeated_paragraphs
    return repeated_paragraphs(spark, C.documents(spark, sf_dir))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op9_packing")
def op9_packing(spark, sf_dir):
    """All documents packed into sequences of at most 4096 tokens."""
    from sward.llm.packing import pack_documents
    return pack_documents(C.documents(spark, sf_dir), tokenizer_path())


@register("op10_decontam")
def op10_decontam(spark, sf_dir):
    """Benchmark passages in documents, by spaced seeds."""
    from sward.llm.decontam import leaks
    return leaks(spark, C.documents(spark, sf_dir), C.table(spark, sf_dir, "benchmark"))


@register("op1_topk", """
with v as (select distinct vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as q
           from embeddings
           where embedding is not null and vec_id is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id,
             cast(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) as bigint) as score
      from v a, v b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rn from s)
select query_id, cast(rn as integer) as rank, vec_id, score from r where rn <= 10""")
def op1_topk(spark, sf_dir):
    """Ten best integer inner products of every hundredth vector against all others."""
    from pyspark.sql import functions as F
    from sward.llm.topk import top_k
    return top_k(spark, C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"),
                 F.pmod(F.col("vec_id"), F.lit(100)) == 0, k=10)


@register("op5_warc", """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, strlen(h) as n, sha1(h) as x, min(page_id) over (partition by h) as low from p),
e as (select *, list_transform(string_split(x || '0', ''), lambda c: cast(strpos('0123456789abcdef', c) as integer) - 1) as g from d)
select page_id, cast(n as bigint) as payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda i:
   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          cast((((16 * g[(5 * i) // 4 + 1] + g[(5 * i) // 4 + 2]) >> (3 - (5 * i) % 4)) & 31) + 1 as bigint), 1)), '') as payload_digest,
 case when page_id = low then 'response' else 'revisit' end as record_type,
 case when page_id = low then null else low end as refers_to
from e""")
def op5_warc(spark, sf_dir):
    """Every page through WARC archives and back."""
    from sward.llm.warc import round_trip
    return (round_trip(spark, C.table(spark, sf_dir, "pages").select("page_id", "url", "html"), min_bytes=0)
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


@register("op3_quality")
def op3_quality(spark, sf_dir):
    """Quality of every document from a line-level conditional random field."""
    from sward.llm.quality import score_quality
    return score_quality(spark, C.documents(spark, sf_dir), C.table(spark, sf_dir, "labels"))


@register("op4_langid")
def op4_langid(spark, sf_dir):
    """Language of every document from bit-sliced Bloom filters."""
    from sward.llm.langid import predict_language
    return predict_language(spark, C.documents(spark, sf_dir, "doc_id", "text", "lang"))


@register("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    """Toxicity of every document from misspelling-tolerant lexicon hits in context."""
    from sward.llm.toxicity import score_toxicity
    return score_toxicity(spark, C.documents(spark, sf_dir), C.table(spark, sf_dir, "labels"))


@register("op7_katz")
def op7_katz(spark, sf_dir):
    """Katz backoff log probabilities of every document."""
    from sward.llm.katz import score_documents
    return score_documents(spark, C.documents(spark, sf_dir), least=1)


@register("pipeline")
def pipeline(spark, sf_dir):
    """The stages of corpus_pipeline.py over the whole documents table."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


@register("op11_whitening")
def op11_whitening(spark, sf_dir):
    """Every embedding on the first four whitened principal components."""
    from sward.llm.whitening import whiten
    return whiten(spark, C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register("op12_resample", r"""
with recursive
crc_table as (select list(c order by i) as t from (
  select i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
                        lambda x, z: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) as c
  from (select cast(range as bigint) as i from range(256)))),
texts as (select 'd' as side, row_number() over () as r, doc_id, text from documents
          union all select 'b', row_number() over (), null, text from benchmark),
w as (select side, r, doc_id, regexp_extract_all(""" + _FOLD.format("coalesce(text, '')") + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from texts),
f as (select side, r, unnest(list_concat(ws, list_concat(
        list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]),
        list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])))) as g from w),
g as (select side, r, g, count(*) as c from f group by all),
names as (select g, hex(encode(g)) as x from (select distinct g from g)),
crc as (select g, xor(list_reduce(list_prepend(cast(4294967295 as bigint),
          list_transform(range(1, len(x) // 2 + 1),
            lambda i: cast(16 * (strpos('0123456789ABCDEF', x[2 * i - 1]) - 1) + strpos('0123456789ABCDEF', x[2 * i]) - 1 as bigint))),
          lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) % 10000 as bucket
        from names, crc_table),
h as (select side, r, bucket, cast(sum(c) as bigint) as c from g join crc using (g) group by all),
counts as (select k as bucket, coalesce(sum(case when side = 'd' then c end), 0) as s,
                  coalesce(sum(case when side = 'b' then c end), 0) as t
           from range(10000) b(k) left join h on bucket = k group by k),
gain as (select bucket, cast(floor(1000 * ln((cast(t as double) + 1) * cast(sum(s) over () + 10000 as double)
                / ((cast(s as double) + 1) * cast(sum(t) over () + 10000 as double)))) as bigint) as gain from counts),
weights as (select r, sum(c * gain) as weight, sum(c) as n from h join gain using (bucket) where side = 'd' group by r),
scored as (select w.r, doc_id, len(ws) as n_words, cast(coalesce(n, 0) as bigint) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
  cast(coalesce(weight, 0) as bigint) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('42:' || doc_id), 1, 8) as bigint) + 0.5e0)
       / 4294967296e0))) as bigint) as score
  from w left join weights using (r) where side = 'd'),
drawn as (select r, row_number() over (order by score desc, doc_id) as rank from scored where n_words >= 20),
n as (select 5 * count(*) // 100 as k from drawn)
select doc_id, n_features, weight, score, case when rank <= k then rank end as rank from scored left join drawn using (r), n""")
def op12_resample(spark, sf_dir):
    """Documents drawn towards the benchmark's features, one draw in twenty."""
    from sward.llm.resample import resample
    return (resample(spark, C.documents(spark, sf_dir), C.table(spark, sf_dir, "benchmark").select("text"))
            .select("doc_id", "n_features", "weight", "score", "rank"))


@register("op13_mixing", r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
                  md5('42:' || coalesce(cast(doc_id as varchar), '')) as place from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
o as (select *, row_number() over (order by source is null, source) as i from s),
w as (select *, case i % 3 when 1 then 5 when 2 then 2 else 1 end as w from o),
-- sources by size over weight: the first k are clamped, the fewest for which no other is above
p as (select *, row_number() over q as k, sum(source_size) over q as below, sum(w) over q as wbelow,
             sum(source_size) over () as total, sum(w) over () as wall
      from w window q as (order by source_size * 10 / w, i rows unbounded preceding)),
c as (select coalesce(min(k) - 1, 0) as k from p
      where (total - 3 * (below - source_size)) * w <= 3 * source_size * (wall - (wbelow - w))),
l as (select c.k as clamped, any_value(total) - 3 * coalesce(sum(source_size) filter (p.k <= c.k), 0) as words,
             any_value(wall) - coalesce(sum(w) filter (p.k <= c.k), 0) as share from p, c group by c.k),
t as (select source, source_size, case when k <= clamped then 3e0 * source_size else cast(w as double) * cast(words as double) / cast(share as double) end as target
      from p, l),
r as (select doc_id, size, source_size, target, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as times,
             sum(size) over (partition by d.source order by place, doc_id, size rows unbounded preceding) - size as before
      from d join t on d.source is not distinct from t.source)
select doc_id, cast(size as bigint) as size, source_size, target,
       cast(times * size + greatest(0, least(size, floor(target - times * source_size + 0.5e0) - before)) as bigint) as taken from r""")
def op13_mixing(spark, sf_dir):
    """Words that a mix of 5 : 2 : 1 over the sources takes of every document, three epochs at most."""
    from sward.llm.mixing import mix
    return (mix(spark, C.documents(spark, sf_dir, "doc_id", "text", "source"))
            .select("doc_id", "size", "source_size", "target", "taken"))
