"""Queries of the training-data operators over the given tables, and SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from . import alignment, decontamination, exact_dedup, language, mixing, near_dedup, pii, quality, ranked_search, secret_scan, simhash, token_counts, toxicity
from .arrow import bound_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).drop("text_key")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents")).drop("component_size")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_pii, op3_near_dedup, op4_secrets, op5_exact_dedup, op6_toxicity, op7_decontamination, op8_mixing,
                           op9_token_counts, op10_language, op11_simhash, op12_alignment, op13_ranked_search)
}

ORACLES: dict[str, str] = {
    "op5_exact_dedup": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
               doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window same as (partition by coalesce(text, ''))
    """,
    "op7_decontamination": r"""
        with lowered as (
            select 'd' as kind, doc_id as id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
            union all
            select 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark),
        lists as (select kind, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from lowered),
        items as (select id, words, least(len(words), 13) as n from lists where kind = 'b' and len(words) > 0),
        windows as (
            select distinct id as item_id, n, array_to_string(words[i:i + n - 1], ' ') as win
            from (select id, words, n, unnest(range(1, len(words) - n + 2)) as i from items) q),
        runs as (
            select doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') as win
            from (select id as doc_id, words, n, unnest(range(1, len(words) - n + 2)) as i
                  from lists, (select distinct n from windows) k where kind = 'd' and len(words) >= n) q),
        found as (select doc_id, i, r.n, item_id from runs r join windows w on r.n = w.n and r.win = w.win),
        covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from found) q group by doc_id),
        named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names
                  from (select distinct doc_id, cast(item_id as varchar) as item from found) q group by doc_id)
        select l.id as doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
               cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(names, '')) as items_sha256,
               coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
        from lists l left join covered c on c.doc_id = l.id left join named m on m.doc_id = l.id where l.kind = 'd'
    """,
    "op8_mixing": r"""
        with sized as (
            select doc_id, source, coalesce(text, '') as t,
                   cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
        weighed as (
            select doc_id, source, size,
                   greatest(0.05e0, 1e0 - 4e0 * (length(t) - length(regexp_replace(t, '[!#$%&*|<>{}\[\]^~_=+@]', '', 'g')))
                       / greatest(1e0, cast(length(t) as double))) as w,
                   (cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), t)), 1, 12) as bigint) + 0.5e0) / 281474976710656e0 as u
            from sized),
        keyed as (select doc_id, source, size, -ln(u) / w as key from weighed),
        sources as (
            select source, sum(size) as s,
                   [5e0, 2e0, 1e0][cast((row_number() over (order by source collate "binary" nulls last) - 1) % 3 + 1 as bigint)] as w
            from keyed group by source),
        levels as (
            select *, (1.5e0 * sum(s) over () - coalesce(sum(2e0 * s) over before, 0))
                      / (sum(w) over () - coalesce(sum(w) over before, 0)) as level
            from sources window before as (order by 2e0 * s / w, source rows between unbounded preceding and 1 preceding)),
        targets as (
            select source, cast(s as bigint) as s, round(least(2e0 * s, max(level) over () * w), 6) as target from levels),
        planned as (
            select source, s, target, case when s > 0 then floor(target / s) else 0 end as epochs from targets),
        summed as (
            select k.doc_id, k.source, k.size, k.key, p.s, p.target, p.epochs, p.target - p.epochs * p.s as rest,
                   sum(k.size) over (partition by k.source order by k.key, k.doc_id rows unbounded preceding) - k.size as before
            from keyed k join planned p on k.source is not distinct from p.source)
        select doc_id, size, s as source_size, target,
               cast(size * (epochs + case when rest > 0 and before + size / 2e0 <= rest then 1 else 0 end) as bigint) as taken
        from summed
    """,
    "op13_ranked_search": r"""
        with lowered as (
            select 'd' as kind, row_number() over () as k, doc_id as id,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
            union all
            select 'b', row_number() over (), item_id,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark),
        lists as (select kind, k, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as terms from lowered),
        sizes as (select kind, k, id, cast(len(terms) as bigint) as n from lists),
        whole as (select cast(count(*) as bigint) as docs, cast(sum(n) as bigint) as l from sizes where kind = 'd' and n > 0),
        counted as (select kind, k, term, cast(count(*) as bigint) as tf
                    from (select kind, k, unnest(terms) as term from lists) q group by kind, k, term),
        weights as (
            select term, cast(floor(1000 * ln((2 * docs + 2) / cast(2 * count(*) + 1 as double))) as bigint) as w
            from counted, whole where kind = 'd' group by term, docs),
        scored as (
            select q.k as item, d.k as doc,
                   cast(sum(q.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 12 * (75 + (25 * n * docs) // l)))) as bigint) as score
            from counted q join weights using (term) join counted d using (term) join sizes s on s.kind = 'd' and s.k = d.k, whole
            where q.kind = 'b' and d.kind = 'd' group by q.k, d.k),
        ranked as (
            select i.id as item_id, d.id as doc_id, score,
                   row_number() over (partition by i.k order by score desc, d.id asc nulls last) as rank
            from scored join sizes i on i.kind = 'b' and i.k = item join sizes d on d.kind = 'd' and d.k = doc where score > 0)
        select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 20
    """,
}
