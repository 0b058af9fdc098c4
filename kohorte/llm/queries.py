"""The subpackage's queries over the given tables, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from kohorte.llm.scratch import Scratch
from kohorte.llm import bpe, decisions, decontaminate, ebayes, lines, maxent, mixcoder, negatives, partenum, separators, stripes, toxicity, urlrules

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0xC480     # above all ids of the vocabulary
# (host, path, verdict)
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def coded(docs: DataFrame) -> DataFrame:
    """Digests of the encoded and of the decoded documents."""
    decoded = bpe.encode_decode(docs, VOCABULARY)
    return decoded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def op2_partenum_join(spark: SparkSession, folder: str) -> DataFrame:
    return partenum.classes(_table(spark, folder, "documents"))


def op3_maxent_scores(spark: SparkSession, folder: str) -> DataFrame:
    return maxent.score(_table(spark, folder, "documents"))


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    file = Scratch(spark, "token-files").keep(mixcoder.blocks(_table(spark, folder, "documents"), VOCABULARY), "blocks")
    docs = mixcoder.read(file).select("part", "block", "doc_id", "offset", F.expr("octet_length(ids) div 4").alias("n_tokens"),
                                      F.crc32("ids").alias("ids_crc32"))
    return docs.join(mixcoder.block_starts(file), ["part", "block"]).select(
        "doc_id", (F.col("begin") + F.col("offset")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")


def op5_bpe_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    return coded(_table(spark, folder, "documents"))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = decisions.judge(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark, "flat-tokens")
    files = scratch.keep(separators.tokenized_files(_table(spark, folder, "documents"), VOCABULARY, end_id=END_ID), "files")
    scanned = scratch.keep(separators.scan_files(files, END_ID), "scanned")
    return separators.named(files, separators.documents(scanned))


def op8_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.judge(_table(spark, folder, "pages"), rules)


def op9_site_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return ebayes.judged(docs, _table(spark, folder, "labels"), keep=["doc_id", "source", "lang"])


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.held_out_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return stripes.divergences(_table(spark, folder, "documents"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    name, label = F.col("vec_id"), F.col("label")
    return negatives.mine(_table(spark, folder, "embeddings"), label=F.when(name % 7 == 0, (label + 1) % 10).otherwise(label), anchor=name % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_partenum_join": op2_partenum_join,
    "op3_maxent_scores": op3_maxent_scores,
    "op4_token_files": op4_token_files,
    "op5_bpe_roundtrip": op5_bpe_roundtrip,
    "op6_quality_rules": op6_quality_rules,
    "op7_token_counts": op7_token_counts,
    "op8_url_rules": op8_url_rules,
    "op9_site_quality": op9_site_quality,
    "op10_decontaminate": op10_decontaminate,
    "op11_toxicity": op11_toxicity,
    "op12_source_divergence": op12_source_divergence,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op8_url_rules": r"""
        with parts as (
            select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
            from pages),
        rules(rule_host, rule_path, rule_verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
            ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        hosts as (
            select distinct p.host, p.path from parts p),
        best as (
            select h.host, h.path, arg_max(r.rule_host || r.rule_path, length(r.rule_host || r.rule_path)) as rule,
                   arg_max(r.rule_verdict, length(r.rule_host || r.rule_path)) as verdict
            from hosts h join rules r
              on (h.host = r.rule_host or ends_with(h.host, '.' || r.rule_host)) and starts_with(h.path, r.rule_path)
            group by h.host, h.path)
        select p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') as verdict
        from parts p left join best b on p.host = b.host and p.path = b.path""",
    "op12_source_divergence": r"""
        with docs as (
            select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as doc,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
            from documents),
        words as (
            select lang, source, doc, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
        counts as (
            select lang, source, term, count(*) as n from words group by all),
        kept as (
            select lang, term from words group by all having count(distinct doc) >= 30),
        sizes as (
            select lang, count(*) as v from kept group by all),
        groups as (
            select g.lang, g.source, coalesce(sum(c.n) filter (k.term is not null), 0) as total
            from (select distinct lang, source from docs) g
            left join counts c on c.lang = g.lang and c.source = g.source
            left join kept k on k.lang = c.lang and k.term = c.term
            group by all),
        shares as (
            select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
                   1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.total + 5 * s.v) as p
            from groups g join sizes s on s.lang = g.lang join kept k on k.lang = g.lang
            left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
        usual as (
            select h.lang, h.term, 1 + (1000000000::hugeint * (sum(h.n) + 5)) // (any_value(t.total) + 5 * any_value(s.v)) as q
            from shares h join sizes s on s.lang = h.lang join (select lang, sum(total) as total from groups group by all) t on t.lang = h.lang
            group by all),
        found as (
            select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0) as value
            from groups a join groups b on a.lang = b.lang and a.source <> b.source
            left join (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value
                       from shares x join shares y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) f
              on f.lang = a.lang and f.source = a.source and f.item = b.source
            union all
            select h.lang, h.source, 'term', h.term, h.p - u.q
            from shares h join usual u on u.lang = h.lang and u.term = h.term where h.n > 0 and h.p > u.q),
        ranked as (
            select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from found)
        select lang, source, part, item, value::bigint as value, rank::integer as rank
        from ranked where part = 'pair' or rank <= 50""",
    "op13_hard_negatives": r"""
        with vectors as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                   list_transform(embedding, lambda x: floor(256 * x::double)) as v
            from embeddings
            where label is not null and embedding is not null
              and coalesce(list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))), true)),
        scores as (
            select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
            from vectors a, vectors b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
        positives as (
            select anchor_id, vec_id as positive_id, score as positive_score from scores where same
            qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
        found as (
            select p.*, s.vec_id as negative_id, s.score as negative_score,
                   row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as rank
            from positives p join scores s on s.anchor_id = p.anchor_id
            where not s.same and 80 * p.positive_score <= 100 * s.score and s.score <= p.positive_score)
        select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score from found where rank <= 5""",
}
