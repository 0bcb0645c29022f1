"""The registered queries of this subpackage: thin calls of its operators on whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuebeam.llm import byte_bpe, chat, decontamination, merkle, packing, pitman_yor, quality, simhash, suffix_dedup, vectors, whitening
from cuebeam.llm.common import documents, embeddings
from cuebeam.llm.sharding import shard


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality.held_out(F.col("doc_id"))
    model = quality.train(docs, labels, usable=~out)
    scored = quality.score(docs.select("doc_id", "text"), model, at_least=0.7)
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), length=2048)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(embeddings(spark, sf_dir), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir), shards=16)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), shingle=3, most_bits=3)


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(documents(spark, sf_dir), quality.held_out(F.col("doc_id"), folds=7, fold=2))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(documents(spark, sf_dir), length=100)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(documents(spark, sf_dir))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(embeddings(spark, sf_dir), threshold=0.98)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(documents(spark, sf_dir), every=5)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digests(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(embeddings(spark, sf_dir), components=16)


QUERIES = {
    "op1_quality": op1_quality,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_sharding": op5_sharding,
    "op6_simhash": op6_simhash,
    "op7_pitman_yor": op7_pitman_yor,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_decontamination": op12_decontamination,
    "op13_whitening": op13_whitening,
}

_USABLE = "len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all(coalesce({_LOWER}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _leaf(text: str) -> str:
    fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({x}) AS VARCHAR) || ':' || {x}, '-')" for x in fields) + ")"


ORACLE: dict[str, str] = {
    "op4_exact_top_k": f"""
        WITH v AS (
            SELECT row_number() OVER () AS r, CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w
            FROM embeddings WHERE {_USABLE}
        ), scored AS (
            SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
            FROM v q JOIN v c ON q.r <> c.r AND len(q.w) = len(c.w) WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
        )
        SELECT * FROM ranked WHERE rank <= 5""",
    "op10_embedding_near_dedup": f"""
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND {_USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), link AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
            ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
        ), reach AS (
            SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
        ), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
        SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
        FROM embeddings e JOIN least ON least.a = e.vec_id LEFT JOIN degree ON degree.a = e.vec_id""",
    "op11_merkle_manifest": f"""
        WITH RECURSIVE crc AS (
            SELECT doc_id, xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
                lambda c, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda d, i: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, b)), CAST(4294967295 AS BIGINT))) AS sum
            FROM (SELECT DISTINCT CAST(doc_id AS BIGINT) AS doc_id FROM documents WHERE doc_id IS NOT NULL)
        ), leaves AS (
            SELECT doc_id, source, {_leaf('text')} AS leaf, {_leaf(_LOWER)} AS lowered, coalesce(sum % 5 = 0, false) AS tampered FROM documents LEFT JOIN crc USING (doc_id)
        ), placed AS (
            SELECT *, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS node,
                count(*) OVER (PARTITION BY source) AS n FROM leaves
        ), lower_nodes AS (
            SELECT tree, 0 AS level, node, leaf AS digest, n FROM placed
            UNION ALL
            SELECT tree, level + 1, node // 16, sha256(string_agg(digest, '' ORDER BY node)), (n + 15) // 16 FROM lower_nodes WHERE n > 1 GROUP BY tree, level, node // 16, n
        ), subroots AS (
            SELECT tree, digest AS subroot, level AS height FROM lower_nodes WHERE n = 1
        ), upper_nodes AS (
            SELECT 0 AS level, tree AS node, subroot AS digest, (SELECT count(*) FROM subroots) AS n FROM subroots
            UNION ALL
            SELECT level + 1, node // 16, sha256(string_agg(digest, '' ORDER BY node)), (n + 15) // 16 FROM upper_nodes WHERE n > 1 GROUP BY level, node // 16, n
        ), nodes AS (
            SELECT tree, level, node, digest FROM lower_nodes WHERE n > 1 UNION ALL SELECT -1, level, node, digest FROM upper_nodes WHERE n > 1
        ), sides AS (
            SELECT a.tree, a.level, a.node, coalesce(string_agg(b.digest, '' ORDER BY b.node) FILTER (b.node < a.node), '') AS before, coalesce(string_agg(b.digest, '' ORDER BY b.node) FILTER (b.node > a.node), '') AS after
            FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.node // 16 = b.node // 16 GROUP BY a.tree, a.level, a.node
        ), folded AS (
            SELECT p.*, subroot, 0 AS step, CASE WHEN tampered THEN lowered ELSE leaf END AS own, '' AS siblings, s.height FROM placed p JOIN subroots s ON s.tree = p.tree
            UNION ALL
            SELECT f.doc_id, f.source, f.leaf, f.lowered, f.tampered, f.tree, f.node, f.n, f.subroot, f.step + 1, sha256(s.before || f.own || s.after), f.siblings || s.before || s.after, f.height
            FROM folded f JOIN sides s ON (f.step < f.height AND s.tree = f.tree AND s.level = f.step AND s.node = f.node // CAST(power(16, f.step) AS BIGINT))
                OR (f.step >= f.height AND s.tree = -1 AND s.level = f.step - f.height AND s.node = f.tree // CAST(power(16, f.step - f.height) AS BIGINT))
        ), top AS (SELECT digest AS root, level AS height FROM upper_nodes WHERE n = 1)
        SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, own AS folded_root, own = root AS verified FROM folded JOIN top ON folded.step = folded.height + top.height""",
    "op12_decontamination": f"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
        ), items AS (
            SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark
        ), windows AS (
            SELECT DISTINCT item, least(10, len(w)) AS size, unnest(list_transform(range(len(w) - least(10, len(w)) + 1), lambda k: array_to_string(w[k + 1 : k + least(10, len(w))], ' '))) AS gram
            FROM items WHERE len(w) > 0
        ), asked AS (
            SELECT r, size, unnest(range(len(w) - size + 1)) AS k, w FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size
        ), found AS (
            SELECT DISTINCT r, k, a.size, item FROM (SELECT r, size, k, array_to_string(w[k + 1 : k + size], ' ') AS gram FROM asked) a JOIN windows USING (size, gram)
        ), hit AS (
            SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS p FROM found) GROUP BY r
        ), named AS (
            SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY encode(item)) AS names FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)""",
}
