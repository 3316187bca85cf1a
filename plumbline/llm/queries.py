"""Named queries of the operators over the test tables, with SQL where it can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.compression import quality
from plumbline.llm.encoding import encoding_digest
from plumbline.llm.hyperdimensional import languages
from plumbline.llm.jaccard import jaccard_components
from plumbline.llm.lengths import length_histogram, suffix_sums, token_lengths
from plumbline.llm.licences import COPYRIGHT_LINE, NOTICES, SPELLINGS, known_licences, scan_licences
from plumbline.llm.mixture import mix_sources
from plumbline.llm.negatives import hard_negatives
from plumbline.llm.rules import quality_rules
from plumbline.llm.spelling import spelling_variants
from plumbline.llm.tiles import near_vectors
from plumbline.llm.toxicity import toxicity
from plumbline.llm.warc import archived_pages

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZERS = os.environ.get("PLUMBLINE_TOKENIZERS", "/opt/tokenizers")  # folder of the vocabulary files, the same on every executor
BYTE_RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
PIECE_MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_token_length_histogram")
def _op1(spark: SparkSession, folder: str) -> DataFrame:
    lengths = token_lengths(table(spark, folder, "documents"), BYTE_RANKS, keep=["lang"])
    return suffix_sums(length_histogram(lengths, ["lang"]), ["lang"])


def _canonical(x: str) -> str:
    """SQL of the canonical form of a licence text."""
    out = f"' ' || trim(regexp_replace(regexp_replace(lower({x}), '{COPYRIGHT_LINE}', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    for old, new in SPELLINGS:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"trim({out})"


@query(
    "op2_licence_scan",
    f"""with k as materialized (select d, min(licence) as licence from (select sha256({_canonical("t")}) as d, licence from (values {", ".join(f"('{n}', '{t}')" for n, t in NOTICES)}) v(licence, t)) group by d),
    w as (select doc_id, {_canonical("text")} as c from documents),
    l as (select doc_id, {_canonical("l")} as c from (select doc_id, unnest(string_split(text, chr(10))) as l from documents)),
    h as (select doc_id, count(*) as n, list_sort(list(distinct licence)) as notices from l join k on k.d = sha256(l.c) where c <> '' group by doc_id)
    select w.doc_id, case when c <> '' then sha256(c) end as digest, k.licence, coalesce(h.n, 0)::bigint as n_notices, coalesce(h.notices, []) as notices
    from w left join k on c <> '' and k.d = sha256(c) left join h on h.doc_id = w.doc_id""",
)
def _op2(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licences(table(spark, folder, "documents"), known_licences(spark))


@query("op3_quality_classifier")
def _op3(spark: SparkSession, folder: str) -> DataFrame:
    return quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_sentencepiece")
def _op4(spark: SparkSession, folder: str) -> DataFrame:
    return encoding_digest(table(spark, folder, "documents"), PIECE_MODEL)


@query(
    "op5_ngram_jaccard_join",
    r"""with recursive w as (
      select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
      from documents),
    g as (select doc_id, unnest(case when len(w) = 0 then [] else list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) end) as g from w),
    n as (select doc_id, count(*) as n from g group by doc_id),
    o as (select x.doc_id as a, y.doc_id as b, count(*) as o from g x join g y on x.g = y.g and x.doc_id <> y.doc_id group by all),
    l as materialized (select a, b from o join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * o >= 75 * (na.n + nb.n - o)),
    r as (select a as doc_id, a as other from l union select r.doc_id, l.b from r join l on l.a = r.other),
    c as (select doc_id, min(other) as least from r group by doc_id)
    select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(least(c.least, w.doc_id), w.doc_id) as component_id
    from w left join n on n.doc_id = w.doc_id left join c on c.doc_id = w.doc_id""",
)
def _op5(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"))


def _seats(frame: str, group: str, item: str, weight: str) -> str:
    """SQL of the apportionment: all quotients down to well below the last that can win."""
    return f"""(select x.*, coalesce(s.seats, 0) as seats from {frame} x left join (
        select {group}, {item}, count(*) as seats from (
          select {group}, {item}, total, row_number() over (partition by {group} order by {weight} / (2 * nth + 1) desc, {item}, nth) as r
          from (select *, unnest(range(0, cast(ceil({weight} * total / sum({weight}) over (partition by {group})) as bigint) + 30)) as nth from {frame} where {weight} > 0))
        where r <= total group by 1, 2) s on s.{group} = x.{group} and s.{item} = x.{item})"""


@query(
    "op6_mix_sources",
    rf"""with sizes as (
      select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
        cast('0x' || substr(md5('0:' || coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as turn from documents),
    p as (select source, sum(size)::bigint as source_size, count(*) as n, row_number() over (order by source nulls last) as k from sizes group by source),
    p2 as (select *, [1, 2, 3][(k - 1) % 3 + 1] as w, 3 * source_size as cap from p),
    p3 as (select *, cap / w <= ((select sum(source_size) from p2) - coalesce(sum(cap) over e, 0)) / ((select sum(w) from p2) - coalesce(sum(w) over e, 0)) as whole
      from p2 window e as (order by cap / w, k rows between unbounded preceding and 1 preceding)),
    src as materialized (select source, k, source_size, 1 as g,
        case when whole then cap::double else ((select sum(source_size) - sum(case when whole then cap else 0 end) from p3) * w)::double / (select sum(case when whole then 0 else w end) from p3) end as target,
        greatest(1, ceil(source_size / 262144), ceil(n / 4096))::bigint as shards from p3),
    src1 as (select *, case when min(case when target > 0 then target end) over () < 256 then 1 else 64 end as block from src),
    src2 as (select *, round(sum(target) over () / block)::bigint as total from src1),
    src3 as materialized (select * from {_seats("src2", "g", "k", "target")}),
    placed as materialized (select doc_id, size, turn, k, source_size, target, turn % shards as shard from sizes join src3 on sizes.source is not distinct from src3.source),
    sh as (select placed.k, shard, sum(size)::double as weight, any_value(seats) as total, any_value(block) as block from placed join src3 on src3.k = placed.k group by 1, 2 having sum(size) > 0),
    sh2 as materialized (select k, shard, weight::bigint as shard_size, least(seats * block, 3 * weight::bigint) as need from {_seats("sh", "k", "shard", "weight")}),
    o as (select placed.*, shard_size, need, coalesce(sum(size) over (partition by placed.k, placed.shard order by turn, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
      from placed left join sh2 on sh2.k = placed.k and sh2.shard = placed.shard)
    select doc_id, size::bigint as size, source_size, target,
      coalesce(need // shard_size * size + greatest(0, least(size, need - need // shard_size * shard_size - before)), 0)::bigint as taken from o""",
)
def _op6(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"))


@query("op7_toxicity")
def _op7(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))



def _limits(keys: str, least: int) -> str:
    """SQL of the limits of one level of sketches."""
    on = ", ".join(x for x in (keys, "metric") if x)
    group = f"group by {keys}" if keys else ""
    lead = f"{keys}," if keys else ""
    return f"""(select {lead} max(total) as group_docs,
        max(case when metric = 'symbols' then q2 + 4 * (q3 - q2) end) as symbols_high, max(case when metric = 'dup_lines' then q2 + 4 * (q4 - q2) end) as dup_high,
        max(case when metric = 'repeats' then q2 + 4 * (q4 - q2) end) as repeats_high,
        max(case when metric = 'word_length' then q2 + 4 * (q3 - q2) end) as length_high, max(case when metric = 'word_length' then q2 - 4 * (q2 - q1) end) as length_low
      from (select {on}, max(total) as total, min(case when 4 * upto >= total then bucket end) as q1, min(case when 4 * upto >= 2 * total then bucket end) as q2,
          min(case when 4 * upto >= 3 * total then bucket end) as q3, min(case when 10 * upto >= 9 * total then bucket end) as q4
        from (select {on}, bucket, sum(n) over (partition by {on} order by bucket) as upto, sum(n) over (partition by {on}) as total
          from (select {on}, bucket, sum(n) as n from h group by {on}, bucket)) group by {on}) {group} having max(total) >= {least})"""


@query(
    "op8_quality_rules",
    rf"""with w as (select doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as l from documents),
    t as (select doc_id, i, array_to_string(w[i:i + 2], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 3)),
    d as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as c from t) where c > 1),
    r as (select doc_id, count(distinct i + k) as n from d, (select unnest([0, 1, 2]) as k) group by doc_id),
    b as (select w.doc_id, lang, source, len(w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
        coalesce(r.n, 0)::bigint as n_repeat_words from w left join r on r.doc_id = w.doc_id),
    m as materialized (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
        case when word_chars > 0 then 1000 * n_symbols // word_chars else 0 end as symbols, case when n_lines > 0 then 1000 * n_dup_lines // n_lines else 0 end as dup_lines,
        case when n_words > 0 then 1000 * n_repeat_words // n_words else 0 end as repeats, case when n_words > 0 then 100 * word_chars // n_words else 0 end as word_length from b),
    h as materialized (select lang, source, metric, x - x % (case when x < 1000 then 1 else (10 ** (length(cast(x as varchar)) - 3))::bigint end) as bucket, count(*) as n
      from (unpivot (select lang, source, symbols, dup_lines, repeats, word_length from m where not base_failed) on symbols, dup_lines, repeats, word_length into name metric value x) group by all),
    l0 as {_limits("lang, source", 30)}, l1 as {_limits("lang", 30)}, l2 as {_limits("", 0)},
    a as (select m.*, case when l0.group_docs is not null then l0 else null end as x0, case when l1.group_docs is not null then l1 else null end as x1, l2 as x2
      from m left join l0 on l0.lang is not distinct from m.lang and l0.source is not distinct from m.source left join l1 on l1.lang is not distinct from m.lang left join l2 on true),
    f as (select *, coalesce(x0.group_docs, x1.group_docs, x2.group_docs)::bigint as group_docs, coalesce(greatest(x0.symbols_high, x1.symbols_high), x2.symbols_high) as a1, coalesce(greatest(x0.dup_high, x1.dup_high), x2.dup_high) as a2,
        coalesce(greatest(x0.repeats_high, x1.repeats_high), x2.repeats_high) as a3, coalesce(greatest(x0.length_high, x1.length_high), x2.length_high) as a4, coalesce(least(x0.length_low, x1.length_low), x2.length_low) as a5 from a)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, group_docs,
      not base_failed and coalesce(1000 * greatest(n_symbols - 5, 0) // word_chars <= a1 and 1000 * greatest(n_dup_lines - 5, 0) // n_lines <= a2 and 1000 * greatest(n_repeat_words - 36, 0) // n_words <= a3
        and word_length <= a4 + floor(1000 / sqrt(n_words)) and word_length >= a5 - floor(1000 / sqrt(n_words)), false) as kept from f""",
)
def _op8(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents"))


@query("op9_language_id")
def _op9(spark: SparkSession, folder: str) -> DataFrame:
    return languages(table(spark, folder, "documents"))


@query(
    "op10_embedding_near_dedup",
    """with recursive v as materialized (select vec_id, embedding::double[64] as e from embeddings
      where len(embedding) = 64 and not list_contains(list_transform(embedding, lambda x: x is null or not isfinite(x)), true) and list_dot_product(embedding::double[], embedding::double[]) > 0),
    l as materialized (select x.vec_id as a, y.vec_id as b from v x join v y on x.vec_id <> y.vec_id where array_cosine_similarity(x.e, y.e) >= 0.95),
    r as (select a as vec_id, b as other from l union select r.vec_id, l.b from r join l on l.a = r.other),
    c as (select vec_id, min(other) as least from r group by vec_id),
    n as (select a as vec_id, count(*) as n from l group by a),
    f as (select e.vec_id, coalesce(n.n, 0) as n_links, coalesce(least(c.least, e.vec_id), e.vec_id) as component_id
      from embeddings e left join n on n.vec_id = e.vec_id left join c on c.vec_id = e.vec_id)
    select *, vec_id = component_id as kept from f""",
)
def _op10(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


@query(
    "op11_warc_transactions",
    """with p as (select page_id, coalesce(html, '') as html from pages),
    d as (select page_id, strlen(html)::bigint as n, sha256(html) as digest, row_number() over (partition by html order by page_id nulls last) as r,
      first_value(page_id) over (partition by html order by page_id nulls last) as first from p)
    select page_id, n as payload_bytes, digest as payload_digest, case when n >= 100 and r > 1 then 'revisit' else 'response' end as record_type,
      case when n >= 100 and r > 1 then first end as refers_to from d""",
)
def _op11(spark: SparkSession, folder: str) -> DataFrame:
    return archived_pages(table(spark, folder, "pages"))


@query(
    "op12_hard_negatives",
    """with v as materialized (select row_number() over () as row, vec_id, (case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end)::bigint as label,
        list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e
      from embeddings where label is not null and embedding is not null and not list_contains(list_transform(embedding, lambda x: x is null or not isfinite(x)), true)),
    s as materialized (select a.row as a, a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2]))::bigint as score
      from v a join v b on a.row <> b.row and len(a.e) = len(b.e) where a.vec_id % 100 = 0),
    p as (select *, row_number() over (partition by a order by score desc, id nulls last) as r from s where same qualify r <= 5),
    n as (select p.anchor_id, p.id as positive_id, p.score as positive_score, s.id as negative_id, s.score as negative_score,
        row_number() over (partition by p.a, p.r order by s.score desc, s.id nulls last)::int as rank
      from p join s on s.a = p.a and not s.same and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score)
    select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 5""",
)
def _op12(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), "vec_id % 100 = 0")


# SQL of the crc32 of a list of bytes, by the table of its polynomial
CRC_TABLE = "(select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b)) as t)"
CRC = "xor(list_reduce({bytes}, lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295)"
UTF8 = "flatten(list_transform(list_transform(string_split({x}, ''), lambda z: unicode(z)), lambda u: case when u < 128 then [u] else [192 + u // 64, 128 + u % 64] end))"


@query(
    "op13_spelling_variants",
    rf"""with recursive crc as materialized {CRC_TABLE},
    r as (select coalesce(doc_id::varchar, '') as doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) as run from documents where text is not null),
    d as materialized (select doc_id, run, count(*) as n from r where length(run) >= 6 group by all),
    h as (select run, n, {CRC.format(bytes=UTF8.format(x="doc_id || ':' || run"))} as h from d, crc),
    v as materialized (select word, sum(n)::bigint as n from (select case when h % 199 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from h)
      where length(word) >= 6 group by word having sum(n) >= 5),
    x as materialized (select word, n, i, left(word, i) || substr(word, i + 2) as gone from (select word, n, unnest(range(length(word)))::int as i from v)),
    p as (select a.word as a, b.word as b from x a join x b on a.gone = b.gone and a.i = b.i and a.word < b.word union select x.word, v.word from x join v on v.word = x.gone),
    q as (select a as word, b as other from p union select b, a from p),
    f as (select q.word, count(*) as n_near, arg_min(q.other, (-o.n, q.other)) as best, max(o.n) as best_n from q join v o on o.word = q.other group by q.word),
    k as materialized (select v.word, v.n, coalesce(n_near, 0) as n_near, case when best_n >= 5 * v.n then best end as form, case when best_n >= 5 * v.n then best_n end as form_n from v left join f on f.word = v.word),
    s as (select word, word as at, form as next from k union all select s.word, k.word, k.form from s join k on k.word = s.next)
    select k.word, form, s.at as root, n, n_near, form_n from k join s on s.word = k.word and s.next is null""",
)
def _op13(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents"))
