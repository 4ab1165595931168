"""The queries of this subpackage: one for each operator, over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import collocations, common, decontamination, hash_search, jaccard_join, licenses, packing, quality, suffix_dedup, suffix_tree_lm, token_counts, warc, yinyang


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = common.scratch_path(spark, "token-cache")
    out = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), cache)
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024, end=2)
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.best_fit(pieces, 1024)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP3_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (
  select doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from d),
pos as (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w where len(words) >= 3),
win as (select doc_id, i, count(*) over (partition by doc_id, words[i], words[i + 1], words[i + 2]) as n from pos),
cov as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from win where n > 1) group by doc_id),
stop as (select doc_id, len(list_filter(words, lambda x: list_contains([%s], lower(x)))) as n_stop_words from w),
m as (
  select w.doc_id, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
         cast(length(regexp_replace(text, '[^#*$%%&|<>]', '', 'g')) as bigint) as n_symbols,
         length(regexp_replace(text, '[^!?]', '', 'g')) as n_marks, len(lines) as n_lines,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
         cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, n_stop_words
  from w left join cov using (doc_id) join stop using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and word_chars between 2 * n_words and 20 * n_words
         and 100 * n_symbols <= 20 * n_words and 100 * n_marks <= 50 * n_words and 100 * n_stop_words >= 3 * n_words
         and 100 * n_dup_lines <= 60 * n_lines as kept
from m
""" % ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.scores(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), common.scratch_path(spark, "archives"))


OP8_SQL = """
with p as (select page_id, coalesce(html, '') as html, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by all)
select page_id, payload_bytes, payload_digest, case when first <> page_id then 'revisit' else 'response' end as record_type,
       case when first <> page_id then first end as refers_to
from p left join f using (payload_digest)
"""


def op9_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece, where it lies in the written matrices; and its sequence as read back from there."""
    folder = common.scratch_path(spark, "matrices")
    pieces = common.stage(packing.pack_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048, end=50256, folder=folder, fill=50256), "shards")
    read = packing.read_shards(pieces, folder).select("shard", "sequence", "n_tokens", "n_segments", F.crc32("ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"))
    return pieces.hint("merge").join(read, ["shard", "sequence"])


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents")).drop("cut")


OP11_SQL = r"""
with p as (
  select lang, row_number() over () as piece, list_filter(regexp_split_to_array(t, '[\x20\x09]+'), lambda x: x <> '') as w
  from (select coalesce(lang, 'und') as lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as t from documents)),
o as (select lang, w, unnest(range(1, len(w) + 1)) as i from p),
g as (
  select lang, 1 as k, w[i] as phrase from o
  union all select lang, 2, w[i] || ' ' || w[i + 1] from o where i + 1 <= len(w)
  union all select lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] from o where i + 2 <= len(w)),
c as (select lang, k, phrase, count(*) as f, string_split(phrase, ' ') as w from g group by all),
n as (select lang, cast(sum(f) as bigint) as n from c where k = 1 group by lang),
cuts as (
  select lang, k, phrase, f as a, w[1] as x, array_to_string(w[2:], ' ') as y, 1 as cut from c where k > 1 and f >= 10
  union all select lang, k, phrase, f, w[1] || ' ' || w[2], w[3], 2 from c where k = 3 and f >= 10),
s as (
  select cuts.lang, cuts.k, cuts.phrase, a, l.f as l, r.f as r, cut, cast(1000000::hugeint * a * a // (l.f::hugeint * r.f) as bigint) as score
  from cuts join c l on l.lang = cuts.lang and l.phrase = x join c r on r.lang = cuts.lang and r.phrase = y),
low as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
around as (
  select lang, phrase, max(a) as f from (
    select lang, f as a, w[1] || ' ' || w[2] as phrase from c where k = 3 and f >= 10
    union all select lang, f, w[2] || ' ' || w[3] from c where k = 3 and f >= 10) group by all),
kept as (select low.* from low left join around using (lang, phrase) where around.f is null or 100 * around.f < 50 * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000
"""


def op12_hash_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    index = hash_search.build(vectors.withColumnRenamed("vec_id", "id"))
    return hash_search.search(index, vectors.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"))


def op13_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.clustered(table(spark, sf_dir, "embeddings"))


def _op13_sql() -> str:
    d = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = ["""
with v as (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as x
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as (select row_number() over (order by sha256('1:' || vec_id), vec_id, x) - 1 as c, x from v qualify c < 16)"""]
    for i in range(4):
        parts.append(f"a{i} as (select v.row, min(cast({d} as bigint) * 16 + c.c) as best from v, c{i} c group by v.row)")
        if i < 3:
            parts.append(f"""s{i} as (
  select best % 16 as c, pos, cast(sum(val) as bigint) as s, count(*) as n
  from (select best, unnest(x) as val, generate_subscripts(x, 1) as pos from v join a{i} using (row)) group by all),
m{i} as (select c, list((s - (s % n + n) % n) // n order by pos) as x from s{i} group by c),
c{i + 1} as (select c{i}.c, coalesce(m{i}.x, c{i}.x) as x from c{i} left join m{i} using (c))""")
    return ",\n".join(parts) + """
select vec_id, cast(best % 16 as int) as cluster, best // 16 as distance, cast(sum(best // 16) over (partition by best % 16) as bigint) as cluster_inertia,
       cast(sum(best // 16) over () as bigint) as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256
from v join a3 using (row) join c3 c on c.c = best % 16
"""


OP13_SQL = _op13_sql()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_best_fit": op2_best_fit,
    "op3_quality_rules": op3_quality_rules,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_suffix_tree": op6_suffix_tree,
    "op7_decontamination": op7_decontamination,
    "op8_warc": op8_warc,
    "op9_token_matrices": op9_token_matrices,
    "op10_license_scan": op10_license_scan,
    "op11_collocations": op11_collocations,
    "op12_hash_search": op12_hash_search,
    "op13_yinyang": op13_yinyang,
}
ORACLE_SQL: dict[str, str] = {"op3_quality_rules": OP3_SQL, "op8_warc": OP8_SQL, "op11_collocations": OP11_SQL, "op13_yinyang": OP13_SQL}
