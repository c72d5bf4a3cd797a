"""The opN_ queries over the tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    found = exact_dedup(_table(spark, sf_dir, "documents"), keep="max", carry=["doc_id"])
    return found.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256
from (select doc_id, coalesce(text, '') as t from documents) window w as (partition by t)
"""


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import digests, format_turns

    hard = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id bigint, turn bigint, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    vocabulary = _vocabulary("byte_bpe_50k.json")
    return digests(format_turns(rows, vocabulary), vocabulary)


OP6_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(14 + length(role) + length(replace(replace(replace(text, '\', '\\'), '###', '\#\#\#'), '</turn>', '\</turn>'))) as bigint) as formatted_chars
from t group by conv_id
"""


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import similar_components

    return similar_components(_table(spark, sf_dir, "documents"), n=3, threshold=(9, 10))


OP1_SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as a from documents
), s as (
  select doc_id, unnest(list_distinct(case when len(a) = 0 then [] when len(a) < 3 then [array_to_string(a, ' ')]
    else list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2]) end)) as g from w
), z as (select doc_id, count(*) as n from s group by doc_id
), p as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2
), e as (select a, b from p join z u on u.doc_id = a join z v on v.doc_id = b where 100 * k >= 90 * (u.n + v.n - k)
), l as (select a, b from e union all select b, a from e
), r as (select doc_id, doc_id as c from documents union select l.b, r.c from r join l on r.doc_id = l.a
), c as (select doc_id, min(c) as component_id from r group by doc_id)
select documents.doc_id, coalesce(n, 0) as n_shingles, component_id from documents join c on c.doc_id = documents.doc_id left join z on z.doc_id = documents.doc_id
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import id_bucket
    from .toxicity import fit, score

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, _table(spark, sf_dir, "labels"), usable=id_bucket("doc_id", 3) != 1)
    out = score(docs, model)
    return out.select("doc_id", (id_bucket("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lang_id import fit, identify
    from .shared import id_bucket

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, usable=id_bucket("i", 4) != 2)
    found = identify(docs, model)
    return found.select("doc_id", (id_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op9_pivot_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pivot_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


OP9_SQL = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), l as (select x.vec_id as a, y.vec_id as b from v x join v y on x.label = y.label and x.vec_id <> y.vec_id where list_cosine_similarity(x.e, y.e) >= 0.98
), r as (select vec_id, vec_id as c from embeddings union select l.b, r.c from r join l on r.vec_id = l.a
), c as (select vec_id, min(c) as component_id from r group by vec_id
), n as (select a, count(*) as n from l group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept from c left join n on a = vec_id
"""


def op10_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sp_scan import encode

    return encode(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import fit, scan

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, fit(docs)).drop("text_hash")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    found = remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents
), s as (select doc_id, x, unnest(range(0, greatest(0, length(x) // 2 - 49))) as i from d where length(x) >= 100
), w as (select doc_id, i, substr(x, 2 * i + 1, 100) as g from s
), m as (select g, min(doc_id) as low from w group by g
), gone as (select w.doc_id, w.i from w join m on w.g = m.g where m.low < w.doc_id
), b as (select doc_id, i, case when i > max(i + 50) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) then 1 else 0 end as jump from gone
), n as (select doc_id, i, 1 + sum(jump) over (partition by doc_id order by i) as k from b
), p as (select doc_id, k, min(i) as a, max(i) + 50 as z from n group by doc_id, k
), q as (select doc_id, count(*) as n_spans, sum(z - a) as n_removed from p group by doc_id
), k as (select doc_id, a, z, lag(z, 1, 0) over (partition by doc_id order by a) as before from p
), t as (select d.doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' order by a) as body, max(z) as last from d join k on d.doc_id = k.doc_id group by d.doc_id)
select d.doc_id, length(x) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(case when t.doc_id is null then x else t.body || substr(x, 2 * t.last + 1) end)) as kept_sha256
from d left join q on q.doc_id = d.doc_id left join t on t.doc_id = d.doc_id
"""


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import digests, find

    found = find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return digests(found).select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP12_SQL = rf"""
with d as (select doc_id, {_WORDS} as a from documents
), b as (select coalesce(cast(item_id as varchar), '') as item, {_WORDS} as a from benchmark
), v as (select item, array_to_string(a[i + 1:i + least(len(a), 10)], ' ') as g, least(len(a), 10) as n from (select item, a, unnest(range(0, greatest(1, len(a) - 9))) as i from b where len(a) > 0)
), k as (select distinct n from v
), p as (select doc_id, a, n, unnest(range(0, len(a) - n + 1)) as i from d, k where len(a) >= n
), h as (select p.doc_id, i, p.n, item from (select doc_id, n, i, array_to_string(a[i + 1:i + n], ' ') as g from p) p join v on v.g = p.g and v.n = p.n
), c as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(i, i + n)) as place from (select distinct doc_id, i, n from h)) group by doc_id
), m as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from h) group by doc_id)
select d.doc_id, len(a) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c on c.doc_id = d.doc_id left join m on m.doc_id = d.doc_id
"""


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: crc32 by its table of 256 values, which the rule of its polynomial gives
OP13_SQL = rf"""
with tb as (select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) as t
), w as (select 's' as side, doc_id, {_WORDS} as a from documents union all select 't', item_id, {_WORDS} from benchmark
), f as (select side, doc_id, unnest(list_concat(a, list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]))) as g from w
), u as (select g, hex(encode(g)) as x from (select distinct g from f)
), v as (select g, list_transform(range(length(x) // 2), lambda i: cast((strpos('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1 as bigint)) as y from u
), c as (select g, xor(list_reduce(y, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 10000 as bucket from v, tb
), n as (select side, bucket, count(*) as n from f join c on c.g = f.g group by side, bucket
), z as (select cast(sum(n) filter (where side = 's') as double) as s_all, cast(coalesce(sum(n) filter (where side = 't'), 0) as double) as t_all from n
), e as (select bucket, cast(coalesce(sum(n) filter (where side = 's'), 0) as double) as s, cast(coalesce(sum(n) filter (where side = 't'), 0) as double) as t from n group by bucket
), k as (select bucket, cast(floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) as bigint) as gain from e, z
), m as (select doc_id, count(*) as n_features, cast(floor(sum(gain) / count(*)) as bigint) as weight from f join c on c.g = f.g join k on k.bucket = c.bucket where side = 's' group by doc_id
), q as (select w.doc_id, len(a) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
   cast(('0x' || substr(sha256('7:' || cast(w.doc_id as varchar)), 1, 8)) as bigint) as h from w left join m on m.doc_id = w.doc_id where side = 's'
), r as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))) as bigint) as score from q
), o as (select *, row_number() over (order by score desc, doc_id) as place, count(*) over () as able from r where n_words >= 20)
select r.doc_id, r.n_features, r.weight, r.score, case when place <= able * 25 // 100 then place end as "rank" from r left join o on o.doc_id = r.doc_id
"""


def op11_yinyang_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .yinyang import cluster, with_inertia

    found = with_inertia(*cluster(_table(spark, sf_dir, "embeddings")))
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op11_sql(k: int = 16, rounds: int = 3) -> str:
    """Plain k-means, each round a pair of tables."""
    d = "list_sum(list_transform(range(1, 65), lambda i: (n.v[i] - c.v[i]) * (n.v[i] - c.v[i])))"
    sql = f"""with n as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), c0 as (select cast(place - 1 as int) as k, v from (select v, row_number() over (order by sha256('1:' || cast(vec_id as varchar)), v) as place from n) where place <= {k})"""
    for r in range(rounds + 1):
        sql += f""", a{r} as (select vec_id, n.v, c.k, {d} as away, row_number() over (partition by vec_id order by {d}, c.k) as place from n, c{r} c
), b{r} as (select vec_id, v, k, away from a{r} where place = 1)"""
        if r < rounds:
            sql += f""", s{r} as (select k, i, cast(floor(sum(v[i]) / count(*)) as bigint) as m from (select k, v, unnest(range(1, 65)) as i from b{r}) group by k, i
), c{r + 1} as (select c.k, coalesce(m.v, c.v) as v from c{r} c left join (select k, list(m order by i) as v from s{r} group by k) m on m.k = c.k)"""
    return sql + f""" select vec_id, b.k as "cluster", cast(away as bigint) as distance, cast(sum(away) over (partition by b.k) as bigint) as cluster_inertia, cast(sum(away) over () as bigint) as inertia,
  sha256(array_to_string(c.v, ',')) as centroid_sha256 from b{rounds} b join c{rounds} c on c.k = b.k"""


OP11_SQL = _op11_sql()


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_toxicity": op2_toxicity,
    "op7_language_id": op7_language_id,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_chat_format": op6_chat_format,
    "op9_pivot_near_dedup": op9_pivot_near_dedup,
    "op10_sentencepiece_scan": op10_sentencepiece_scan,
    "op3_secret_scan": op3_secret_scan,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op11_yinyang_clustering": op11_yinyang_clustering,
    "op12_decontamination": op12_decontamination,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLE_SQL = {"op4_suffix_array_dedup": OP4_SQL, "op9_pivot_near_dedup": OP9_SQL, "op1_ngram_jaccard_join": OP1_SQL, "op5_exact_dedup": OP5_SQL, "op6_chat_format": OP6_SQL, "op11_yinyang_clustering": OP11_SQL, "op12_decontamination": OP12_SQL, "op13_importance_resampling": OP13_SQL}
