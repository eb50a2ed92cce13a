"""One query per corpus operator, over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.ann import nearest_neighbours
from ledgerline.llm.block_clusters import cluster_vectors
from ledgerline.llm.bpe import bpe_columns
from ledgerline.llm.common import join_groups, shared_dir
from ledgerline.llm.decontamination import find_contamination
from ledgerline.llm.exact_dedup import exact_dedup
from ledgerline.llm.langid import fold, identify, train_profiles
from ledgerline.llm.mixing import mix_sources
from ledgerline.llm.ppm import ppm_scores
from ledgerline.llm.simhash import near_duplicates
from ledgerline.llm.substring_dedup import repeated_passages
from ledgerline.llm.token_shards import read_token_shards, write_token_shards
from ledgerline.llm.vector_codes import compress_vectors
from ledgerline.llm.warc import plan_records, read_warc, write_warc


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_gear_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(_table(spark, sf_dir, "documents"))
    return found.withColumn("n_removed", F.size("removed")).drop("removed")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


def op3_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_columns(_table(spark, sf_dir, "documents"), tokenizer_path(), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op4_projected_kd_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold(F.col("doc_id"), 3) == 1)
    profiles = train_profiles(docs.filter(~F.col("held_out")))
    return identify(docs.select("doc_id", "text", "held_out"), profiles).drop("text")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taken counts the copies that stand in output shards; shards lists them, a copy a pass."""
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    shards = F.array_join(F.transform("draws", lambda x: x["shard"].cast("string")), ",")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), shards.alias("shards"))


#: Fixed value: the id that ends a document in the shards.
END_ID = 2


def op7_wavelet_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    write_token_shards(_table(spark, sf_dir, "documents"), tokenizer_path(), folder, END_ID)
    return read_token_shards(spark, folder, with_ids=False)


def op8_warc_boundary_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    write_warc(plan_records(_table(spark, sf_dir, "pages")), folder)
    page = lambda column: F.regexp_extract(column, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    read = read_warc(spark, folder, with_payload=False)
    return read.select(
        page("record_id").alias("page_id"), "payload_bytes", F.col("payload_sha1").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to")
    )


def op9_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_scores(_table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) == 2)


def op10_simhash_bk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).drop("fp")


def _digest(numbers: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def op11_block_norm_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster_vectors(_table(spark, sf_dir, "embeddings"))
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    known = [(i, sums.get(i), sum(sums.values()), _digest(c)) for i, c in enumerate(centroids)]
    clusters = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.drop("compared").join(F.broadcast(clusters), "cluster")


def op12_suffix_automaton_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_ball_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress_vectors(_table(spark, sf_dir, "embeddings"), keep="label")
    named = coded.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null")))
    groups = named.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    met = join_groups(named.select("vec_id", "code", "error", "key"), groups, "key", "n", "vec_id")
    digest = _digest([x for book in books for entry in book for x in entry])
    return met.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


QUERIES = {
    "op1_gear_substring_dedup": op1_gear_substring_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_trie_bpe": op3_trie_bpe,
    "op4_projected_kd_neighbours": op4_projected_kd_neighbours,
    "op5_rank_order_language": op5_rank_order_language,
    "op6_source_mixing": op6_source_mixing,
    "op7_wavelet_token_shards": op7_wavelet_token_shards,
    "op8_warc_boundary_chains": op8_warc_boundary_chains,
    "op9_ppm_scoring": op9_ppm_scoring,
    "op10_simhash_bk_tree": op10_simhash_bk_tree,
    "op11_block_norm_clusters": op11_block_norm_clusters,
    "op12_suffix_automaton_decontamination": op12_suffix_automaton_decontamination,
    "op13_ball_tree_codes": op13_ball_tree_codes,
}

ORACLE = {
    # The splitting tree of two shards, which is what tables of up to 40 million words get.
    "op6_source_mixing": r"""
        WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                          (('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null')), 1, 7))::BIGINT % 4096)::INT AS block FROM documents),
             g AS (SELECT source, block, sum(size)::BIGINT AS words, ('0x' || substr(md5('mix-1|block|' || block::VARCHAR), 1, 7))::BIGINT AS place FROM d GROUP BY source, block),
             s AS (SELECT source, sum(words)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM g GROUP BY source),
             o AS (SELECT *, 3.0 * source_size AS cap, sum(source_size) OVER ()::DOUBLE AS total, row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS k FROM s),
             l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
             t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, k) FROM l WHERE level * weight <= cap) * weight, cap))::DOUBLE AS target FROM l),
             p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS passes FROM t),
             b AS (SELECT p.source, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS need,
                          list({'w': g.words, 'b': g.block, 'p': g.place} ORDER BY g.place, g.block) AS blocks FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source GROUP BY ALL),
             f AS (SELECT *, list_reduce(list_concat([{'need': need, 'took': []::INT[], 'w': 0::BIGINT, 'b': -1, 'p': 0::BIGINT}],
                            list_transform(blocks, lambda x: {'need': 0.0::DOUBLE, 'took': []::INT[], 'w': x.w, 'b': x.b, 'p': x.p})),
                          lambda a, x: CASE WHEN x.w > 0 AND x.w <= a.need THEN {'need': a.need - x.w, 'took': list_append(a.took, x.b), 'w': a.w, 'b': a.b, 'p': a.p} ELSE a END) AS fit FROM b),
             e AS (SELECT *, list_min(list_transform(list_filter(blocks, lambda x: x.w > 0 AND x.w < 2 * fit.need AND NOT list_contains(fit.took, x.b)), lambda x: {'off': abs(fit.need - x.w), 'p': x.p, 'b': x.b})).b AS extra FROM f),
             n AS (SELECT source, source_size, target, passes, list_transform(blocks, lambda x: x.b) AS own, CASE WHEN extra IS NULL THEN fit.took ELSE list_append(fit.took, extra) END AS took FROM e),
             q AS (SELECT *, (passes * len(own) + len(took))::BIGINT AS quota, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM n),
             tree AS (
               SELECT 0::BIGINT AS i, (SELECT sum(quota) FROM q)::BIGINT AS rest, (SELECT floor(sum(quota) / 2) FROM q)::BIGINT AS free, 0::BIGINT AS got
               UNION ALL
               SELECT i, rest - quota, free - got, got FROM (SELECT *, ks[1 + len(list_filter(sums, lambda c: c <= u * sums[-1]))] AS got FROM (
                 SELECT *, list_transform(range(1, len(ws) + 1), lambda j: list_sum(ws[1:j])) AS sums FROM (
                 SELECT *, list_transform(ks, lambda k: exp(lgamma(mode + 1) + lgamma(quota - mode + 1) + lgamma(free - mode + 1) + lgamma(more + mode + 1) - lgamma(k + 1) - lgamma(quota - k + 1) - lgamma(free - k + 1) - lgamma(more + k + 1))) AS ws FROM (
                 SELECT *, list_concat(range(mode, least(quota, free, mode + 700) + 1), list_reverse(range(greatest(0, -more, mode - 700), mode))) AS ks FROM (
                 SELECT *, greatest(least(quota, free, floor((quota + 1) * (free + 1) / (rest + 2))::BIGINT), -more, 0) AS mode FROM (
                 SELECT q.i, q.quota, t.rest, t.free, t.rest - q.quota - t.free AS more, ('0x' || substr(md5('mix-1|0|0|' || (q.i - 1)::VARCHAR), 1, 12))::BIGINT / 281474976710656 AS u FROM tree t JOIN q ON q.i = t.i + 1)))))))
        SELECT d.doc_id, d.size, q.source_size, q.target, d.size * (q.passes + list_contains(q.took, d.block)::INT)::BIGINT AS taken,
               array_to_string(list_transform(list_concat(list_transform(range(0, q.passes), lambda p: p * len(q.own) + list_position(q.own, d.block) - 1),
                                                          CASE WHEN list_contains(q.took, d.block) THEN [q.passes * len(q.own) + list_position(q.took, d.block) - 1] ELSE []::BIGINT[] END),
                                              lambda s: CASE WHEN s < tree.got THEN '0' ELSE '1' END), ',') AS shards
        FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source JOIN tree ON tree.i = q.i""",
    "op8_warc_boundary_chains": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
             w AS (SELECT h, max(page_id) AS winner FROM p WHERE n >= 1000 GROUP BY h)
        SELECT p.page_id, p.n AS payload_bytes, sha1(p.h) AS payload_digest,
               CASE WHEN w.winner IS NULL OR w.winner = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN w.winner <> p.page_id THEN w.winner END AS refers_to
        FROM p LEFT JOIN w ON p.h = w.h""",
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t""",
    "op11_block_norm_clusters": """
        WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
                             WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
             rounds AS (
               SELECT 0 AS r, list(x ORDER BY i) AS cs FROM (SELECT x, row_number() OVER (ORDER BY sha256('3:' || vec_id), x) AS i FROM v) WHERE i <= 8
               UNION ALL
               SELECT r, list(coalesce(c, was) ORDER BY i) FROM (
                 SELECT o.r + 1 AS r, o.i, o.was, m.c FROM (SELECT r, cs[i] AS was, i FROM rounds, range(1, 9) t(i) WHERE i <= len(cs) AND r < 10) o
                 LEFT JOIN (SELECT i, list((((s - ((s % n) + n) % n) // n)::BIGINT) ORDER BY d) AS c FROM (
                   SELECT i, d, sum(x[d]) AS s, count(*)::HUGEINT AS n FROM (
                     SELECT x, list_position(ds, list_min(ds)) AS i FROM (
                       SELECT v.x, list_transform(cs, lambda c: list_sum(list_transform(range(1, 65), lambda j: (v.x[j] - c[j]) * (v.x[j] - c[j])))::BIGINT) AS ds FROM v, rounds)), range(1, 65) t(d)
                   GROUP BY i, d) GROUP BY i) m ON m.i = o.i) GROUP BY r),
             f AS (SELECT cs FROM rounds WHERE r = 10),
             a AS (SELECT vec_id, list_min(ds) AS distance, list_position(ds, list_min(ds)) AS i FROM (
                     SELECT v.vec_id, list_transform(cs, lambda c: list_sum(list_transform(range(1, 65), lambda j: (v.x[j] - c[j]) * (v.x[j] - c[j])))::BIGINT) AS ds FROM v, f))
        SELECT vec_id, (i - 1)::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY i))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(f.cs[i], ',')) AS centroid_sha256 FROM a, f""",
    "op12_suffix_automaton_decontamination": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
             i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
             n AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda a: array_to_string(w[a:a + 9], ' '))) AS win FROM i WHERE len(w) > 0),
             p AS (SELECT row, size, unnest(list_transform(range(1, len(w) - size + 2), lambda a: {'place': a, 'win': array_to_string(w[a:a + size - 1], ' ')})) AS x FROM d, (SELECT DISTINCT size FROM n) WHERE len(w) >= size),
             f AS (SELECT p.row, p.x['place'] AS place, p.size, n.item_id FROM p JOIN n ON p.size = n.size AND p.x['win'] = n.win),
             h AS (SELECT row, count(DISTINCT pos) AS n_hit FROM (SELECT row, unnest(range(place, place + size)) AS pos FROM (SELECT DISTINCT row, place, size FROM f)) GROUP BY row),
             t AS (SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT row, item_id::VARCHAR AS item_id FROM f WHERE item_id IS NOT NULL) GROUP BY row)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h ON h.row = d.row LEFT JOIN t ON t.row = d.row""",
    "op13_ball_tree_codes": """
        WITH RECURSIVE v AS (SELECT row_number() OVER (ORDER BY vec_id, x) AS k, * FROM (
                               SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x FROM embeddings
                               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding))),
             q AS (SELECT k, p, x[p * len(x) // 8 + 1 : (p + 1) * len(x) // 8] AS x FROM v, range(0, 8) t(p)),
             rounds AS (
               SELECT 0 AS r, p, list(x ORDER BY k) AS es FROM q WHERE k <= 16 GROUP BY p
               UNION ALL
               SELECT r, p, list(coalesce(c, was) ORDER BY i) FROM (
                 SELECT o.r + 1 AS r, o.p, o.i, o.was, m.c FROM (SELECT r, p, es[i] AS was, i FROM rounds, range(1, 17) t(i) WHERE i <= len(es) AND r < 6) o
                 LEFT JOIN (SELECT p, i, list((((s - ((s % n) + n) % n) // n)::BIGINT) ORDER BY d) AS c FROM (
                   SELECT p, i, d, sum(x[d]) AS s, count(*)::HUGEINT AS n FROM (
                     SELECT p, x, list_position(ds, list_min(ds)) AS i FROM (
                       SELECT q.p, q.x, list_transform(es, lambda c: list_sum(list_transform(range(1, len(q.x) + 1), lambda j: (q.x[j] - c[j]) * (q.x[j] - c[j])))::BIGINT) AS ds FROM q JOIN rounds ON rounds.p = q.p)), range(1, len(x) + 1) t(d)
                   GROUP BY p, i, d) GROUP BY p, i) m ON m.i = o.i AND m.p = o.p) GROUP BY r, p),
             f AS (SELECT p, es FROM rounds WHERE r = 6),
             a AS (SELECT k, sum(list_min(ds))::BIGINT AS error, string_agg(printf('%02x', list_position(ds, list_min(ds)) - 1), '' ORDER BY p) AS code FROM (
                     SELECT q.k, q.p, list_transform(es, lambda c: list_sum(list_transform(range(1, len(q.x) + 1), lambda j: (q.x[j] - c[j]) * (q.x[j] - c[j])))::BIGINT) AS ds FROM q JOIN f ON f.p = q.p) GROUP BY k)
        SELECT v.vec_id, a.code, a.error, (sum(a.error) OVER (PARTITION BY v.label))::BIGINT AS label_error,
               sha256((SELECT array_to_string(flatten(list(flatten(es) ORDER BY p)), ',') FROM f)) AS codebooks_sha256 FROM v JOIN a ON a.k = v.k""",
}
