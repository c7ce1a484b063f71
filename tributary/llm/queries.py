"""One query for each operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import ann, bpe, filter_audit, licenses, mixing, near_dup, pii, quality, runs, sharding, suffixes, token_counts, toxicity
from tributary.llm.texts import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies; the package is there on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_nearest_neighbours")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


@query("op2_bpe_round_trip")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    listed = F.btrim(F.replace(F.col("ids").cast("string"), F.lit(", "), F.lit(",")), F.lit("[]"))
    return bpe.round_trip(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_license_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("spans")


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


OP7_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from d),
m as (
  select doc_id, len(words) as n_words,
         length(array_to_string(words, '')) as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
         length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) as n_capitals
  from w),
lines as (
  select doc_id, line, count(*) as n
  from (select doc_id, unnest(string_split(text, chr(10))) as line from d)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id, line),
l as (select doc_id, sum(n) as n_lines, sum(n - 1) as n_dup_lines from lines group by doc_id),
spots as (
  select doc_id, i, words[i] as a, words[i + 1] as b, words[i + 2] as c
  from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w where len(words) > 2)),
again as (select doc_id, i from (select *, count(*) over (partition by doc_id, a, b, c) as n from spots) where n > 1),
r as (
  select doc_id, count(*) as n_repeat_words
  from (select distinct doc_id, i + s as place from again, (values (0), (1), (2)) t(s)) group by doc_id),
a as (
  select m.doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
         coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines, n_capitals
  from m left join l using (doc_id) left join r using (doc_id)),
f as (
  select *, n_words < 50 as f0, 100 * n_repeat_words > 50 * n_words as f1, 10 * n_symbols > 3 * n_words as f2,
         100 * n_dup_lines > 50 * n_lines as f3, word_chars < 2 * n_words as f4, word_chars > 15 * n_words as f5,
         100 * n_capitals > 50 * word_chars as f6
  from a)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
       cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
       cast(n_repeat_words as bigint) as n_repeat_words,
       cast(f0::int + 2 * f1::int + 4 * f2::int + 8 * f3::int + 16 * f4::int + 32 * f5::int + 64 * f6::int as bigint) as failed,
       f0 or f1 as base_failed, not (f0 or f1 or f2 or f3 or f4 or f5 or f6) as kept
from f
"""


@query("op7_quality_rules", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(table(spark, sf_dir, "documents"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed",
        (~quality.passes("base")).alias("base_failed"), quality.passes().alias("kept"),
    )


@query("op8_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op10_pii_surrogates")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op6_near_duplicates")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


@query("op9_suffix_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = r"""
with recursive
t(i, bit, v) as (
  select range, 0, range from range(256)
  union all
  select i, bit + 1, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end from t where bit < 8),
lookup as (select list(v order by i) as crcs from t where bit = 8),
b as (
  select doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint) as bytes
  from documents),
d as (
  select row_number() over () as row_id, doc_id, cast(len(bytes) + 8 as bigint) as size,
         xor(list_reduce(bytes, lambda c, x: xor(c // 256, crcs[xor(c % 256, x) + 1]), 4294967295), 4294967295) as crc
  from b, lookup),
keyed as (
  select *, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::hugeint as key,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ',' || size || ',' || crc), 1, 15))::bigint as mix
  from d),
jumps(row_id, key, shard) as (
  select row_id, key, 0::bigint from keyed
  union all
  select row_id, following, cast(floor((shard + 1) * (2147483648::double / (following // 8589934592 + 1)::double)) as bigint)
  from (select row_id, shard, (key * 2862933555777941757 + 1) % 18446744073709551616 as following from jumps where shard < 25)),
placed as (
  select row_id, max(shard) filter (shard < 24) as shard, max(shard) filter (shard < 25) as grown from jumps group by row_id)
select doc_id, size, crc as text_crc32, 'key' as law, cast(shard as integer) as shard,
       row_number() over (partition by shard order by mix, doc_id nulls first, size, crc) - 1 as slot,
       cast(grown as integer) as grown_shard
from keyed join placed using (row_id)
"""


@query("op11_sharding", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: a tenth of the texts (by the checksum of the id) repeat a part of theirs to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.expr(r"regexp_extract_all(text, '([^\\x20\\x09-\\x0D]+)', 1)")
    g, n = F.floor(h / 10), F.size("words")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
    repeated = F.array_join(F.transform("words", lambda _, i: F.get("words", place(i))), " ")
    planted = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"))
    return planted.select("doc_id", F.when(F.size("words") > 0, repeated).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    listed = F.transform("found.runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("found.runs").cast("long").alias("n_runs"),
        runs.strongest(F.col("found.runs")).alias("best"),
        F.sha2(F.array_join(listed, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("found.collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


OP13_SQL = r"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents),
known as (
  select doc_id, coalesce(max((quality = 1)::int), 0) as good, coalesce(max((toxic = 1)::int), 0) as toxic from labels group by doc_id),
m as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
         coalesce(d.doc_id > min(d.doc_id) over (partition by text), false) as e,
         len(words) < 50 as a, 100 * len(list_distinct(words)) < 65 * len(words) as b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) as c,
         regexp_matches(text, '[#$%&*|]') as d_
  from d left join known using (doc_id)),
f as (
  select *, (case when a then 'A' else '' end) || (case when b then 'B' else '' end) || (case when c then 'C' else '' end)
         || (case when d_ then 'D' else '' end) || (case when e then 'E' else '' end) as fails from m),
letter as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select p.x || q.x || r.x || s.x || t.x as filter_order
  from letter p, letter q, letter r, letter s, letter t
  where p.x not in (q.x, r.x, s.x, t.x) and q.x not in (r.x, s.x, t.x) and r.x not in (s.x, t.x) and s.x <> t.x),
steps as (
  select filter_order, step, substr(filter_order, step, 1) as x, substr(filter_order, 1, step - 1) as earlier
  from orders, (select unnest([1, 2, 3, 4, 5]) as step)),
cell as (
  select part, fails, count(*) as n, sum(good) as n_good, sum(toxic) as n_toxic from f group by part, fails),
hit as (
  select part, filter_order, step, x, n, n_good, n_toxic, contains(fails, x) as here, fails = x as only_here,
         len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) > 0 and earlier <> '' and fails <> '' as gone
  from cell, steps),
r as (
  select part, filter_order, step, x,
         coalesce(sum(n) filter (not here and not gone), 0) as kept, coalesce(sum(n) filter (here and not gone), 0) as removed,
         coalesce(sum(n) filter (here and gone), 0) as redundant, coalesce(sum(n) filter (only_here), 0) as unique_fails,
         coalesce(sum(n_good) filter (here and not gone), 0) as good_lost, coalesce(sum(n_toxic) filter (here and not gone), 0) as toxic_lost
  from hit group by part, filter_order, step, x)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
       cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
       cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, x) as bigint) as shapley
from r
"""


@query("op13_filter_audit", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
