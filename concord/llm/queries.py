"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from concord.llm import (
    kmeans_tree, lexical, line_crf, minhash, mixing, packing, periodic, pii, secrets, suffix_dedup, token_files, topk,
    warc,
)
from concord.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.screen(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op8_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.search(table(spark, sf_dir, "embeddings"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_mixing": op2_mixing,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_line_crf": op4_line_crf,
    "op5_warc": op5_warc,
    "op6_token_files": op6_token_files,
    "op7_topk": op7_topk,
    "op8_minmax": op8_minmax,
    "op9_packing": op9_packing,
    "op10_pii": op10_pii,
    "op11_lexical": op11_lexical,
    "op12_kmeans_tree": op12_kmeans_tree,
    "op13_periodic": op13_periodic,
}

ORACLES: dict[str, str] = {
    # a source takes the first words of its shuffled stream, over again when all are taken
    "op2_mixing": """
        with d as (
            select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size
            from documents
        ), s as (
            select source, sum(size) as source_size, row_number() over (order by source nulls last) as turn
            from d group by source
        ), w as (
            select *, [1, 2, 3][(turn - 1) % 3 + 1] as weight, 3 * source_size as cap from s
        ), l as (
            select *, (sum(source_size) over () - coalesce(sum(cap) over (
                    order by cap / weight, turn rows between unbounded preceding and 1 preceding), 0))
                / sum(weight) over (order by cap / weight, turn rows between current row and unbounded following) as level
            from w
        ), t as (
            select source, source_size, ceil(source_size / 32) as blocks,
                case when cap / weight <= level then cast(cap as double)
                    else weight * max(level) over () end as target
            from l
        ), e as (
            select *, floor(target / greatest(source_size, 1)) as epochs,
                least(blocks, round((target - floor(target / greatest(source_size, 1)) * source_size)
                    / greatest(least(source_size, 32), 1))) as more
            from t
        ), q as (
            select *, epochs + floor(more / greatest(blocks, 1)) as whole,
                case when more = blocks then 0 else more end * 32 as upto
            from e
        ), p as (
            select d.*, coalesce(sum(size) over (
                partition by source
                order by md5('mix:' || coalesce(cast(doc_id as varchar), 'none')), doc_id, size
                rows between unbounded preceding and 1 preceding), 0) as first
            from d
        )
        select p.doc_id, p.size, cast(q.source_size as bigint) as source_size, q.target,
            cast(p.size * whole + greatest(0, least(first + p.size, upto) - first) as bigint) as taken
        from p join q on p.source is not distinct from q.source
    """,
    "op5_warc": """
        with p as (
            select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest
            from pages
        ), f as (select *, min(page_id) over (partition by payload_digest) as first from p)
        select page_id, payload_bytes, payload_digest,
            case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
            case when payload_bytes >= 100 and page_id <> first then first end as refers_to
        from f
    """,
    "op7_topk": """
        with e as (
            select row_number() over () as row, vec_id, embedding from embeddings
            where embedding is not null
                and len(embedding) = len([x for x in embedding if x is not null and isfinite(x)])
        ), v as (
            select row, vec_id, unnest(range(len(embedding))) as i,
                cast(floor(256 * cast(unnest(embedding) as double)) as bigint) as x
            from e
        ), s as (
            select q.row as query_row, q.vec_id as query_id, c.row, c.vec_id, cast(sum(q.x * c.x) as bigint) as score
            from v q join v c on q.i = c.i and q.row <> c.row
            where q.vec_id % 50 = 0
            group by all
        ), r as (
            select *, row_number() over (partition by query_row order by score desc, vec_id, row) as rank from s
        )
        select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
    """,
    "op8_minmax": """
        with recursive w as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
            from documents
        ), s as (
            select distinct doc_id, shingle from (
                select doc_id, unnest(case when len(w) between 1 and 4 then [array_to_string(w, ' ')]
                    else [array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)] end) as shingle
                from w
            )
        ), n as (select doc_id, count(*) as n from s group by doc_id),
        i as (
            select a.doc_id as x, b.doc_id as y, count(*) as together
            from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all
        ), e as (
            select x, y from i join n p on x = p.doc_id join n q on y = q.doc_id
            where 100 * together >= 75 * (p.n + q.n - together)
        ), r as (
            select doc_id, doc_id as other from w
            union select r.doc_id, e.y from r join e on r.other = e.x
        ), c as (select doc_id, min(other) as component_id from r group by doc_id)
        select c.doc_id, coalesce(n.n, 0) as n_shingles, component_id, c.doc_id = component_id as kept
        from c left join n using (doc_id)
    """,
    "op11_lexical": """
        with t as (
            select row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
            from (select row_number() over () as row, doc_id, text from documents)
        ), s as (select row, count(*) as n from t group by row),
        c as (select count(*) as n_docs, cast(sum(n) as bigint) as n_terms from s),
        f as (select row, doc_id, term, count(*) as tf from t group by all),
        w as (
            select term, cast(floor(1000 * ln(cast(2 * max(n_docs) + 2 as double) / (2 * count(*) + 1))) as bigint) as w
            from f, c group by term
        ), i as (
            select distinct item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
            from (select row_number() over () as item, item_id, text from benchmark)
        ), r as (
            select item, item_id, row, doc_id, cast(sum(w * ((1000000000 * tf)
                // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) as bigint) as score
            from i join f using (term) join w using (term) join s using (row), c
            group by all
        ), k as (
            select *, row_number() over (partition by item order by score desc, doc_id nulls last, row) as rank
            from r where score > 0
        )
        select item_id, cast(rank as integer) as rank, doc_id, score from k where rank <= 50
    """,
}
