"""One query per operator, over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its near-duplicates), kept."""
    from .minhash import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@_query
def op1_collision_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    from .collisions import linked_vectors

    return linked_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@_query
def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    from .packing import pack_documents

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@_query
def op8_multinomial_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    from .mixing import mix_plan

    return mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@_query
def op6_ivf_pq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 10 nearest of every hundredth vector."""
    from pyspark.sql import functions as F

    from .ivfpq import nearest_neighbours

    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


#: The rules of op7: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@_query
def op7_url_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    from .urlfilter import filter_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


ORACLE["op7_url_range_join"] = r"""
WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
urls AS (
    SELECT page_id,
           translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
    FROM pages
),
fits AS (
    SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, r.verdict,
           row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST, r.verdict DESC, r.host || r.path) AS n
    FROM urls u LEFT JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE n = 1
"""


@_query
def op9_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    from .pii_crf import digest, find_pii

    return digest(find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet")))


@_query
def op3_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    from pyspark.sql import functions as F

    from .quality_cnn import held_out, score_quality, train_quality

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query
def op5_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair k: conversation k up to its last assistant turn, and the same turns with conversation k + 1's last assistant turn instead.

    Without such a turn there is no pair; without a next conversation that has one, the rejected side ends before it.
    """
    from pyspark.sql import functions as F

    from .preference import format_preferences, number_turns

    turns = number_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    side = lambda name: F.struct("conv", F.lit(name).alias("side"))  # noqa: E731  (keys without arithmetic: any long is an id)
    last = turns.groupBy("conv").agg(F.max(F.when(F.col("role") == "assistant", F.struct("n", "text"))).alias("end")).where("end is not null").select("conv", F.col("end.n").alias("at"), F.col("end.text").alias("answer"))
    heads = turns.join(last.select("conv", "at"), "conv").where("n <= at")
    chosen = heads.select(side("chosen").alias("conv_id"), F.col("n").alias("turn"), "role", "text")
    kept = heads.where("n < at").select(side("rejected").alias("conv_id"), F.col("n").alias("turn"), "role", "text")
    other = last.where(F.col("conv") > -(2**63)).select((F.col("conv") - 1).alias("conv"), "answer")
    swapped = last.select("conv", "at").join(other, "conv").select(side("rejected").alias("conv_id"), F.col("at").alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text"))
    pairs = last.select(F.col("conv").alias("pair_id"), side("chosen").alias("chosen"), side("rejected").alias("rejected"))
    return format_preferences(pairs, chosen.unionByName(kept).unionByName(swapped))


ORACLE["op5_preference_pairs"] = r"""
WITH turns AS (
    SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS n,
           coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
),
ends AS (SELECT conv, max(n) AS place, arg_max(text, n) AS answer FROM turns WHERE role = 'assistant' GROUP BY conv),
heads AS (
    SELECT conv, place, string_agg(CASE WHEN n < place THEN '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) END, '' ORDER BY n) AS prompt
    FROM turns JOIN ends USING (conv) WHERE n <= place GROUP BY conv, place
),
sides AS (
    SELECT e.conv, e.place, coalesce(h.prompt, '') AS prompt, '<|assistant|>' || chr(10) || e.answer || '<|end|>' || chr(10) AS chosen,
           CASE WHEN o.conv IS NOT NULL THEN '<|assistant|>' || chr(10) || o.answer || '<|end|>' || chr(10) ELSE '' END AS rejected
    FROM ends e JOIN heads h USING (conv) LEFT JOIN ends o ON o.conv > -9223372036854775808 AND o.conv - 1 = e.conv
)
SELECT conv AS pair_id, (place + (chosen = rejected)::INT)::BIGINT AS shared_turns,
       CASE WHEN chosen = rejected THEN prompt || chosen ELSE prompt END AS prompt,
       CASE WHEN chosen = rejected THEN '' ELSE chosen END AS chosen,
       CASE WHEN chosen = rejected THEN '' ELSE rejected END AS rejected,
       CASE WHEN chosen = rejected THEN '' ELSE '14:' || length(chosen)::VARCHAR END AS chosen_loss,
       CASE WHEN chosen = rejected OR rejected = '' THEN '' ELSE '14:' || length(rejected)::VARCHAR END AS rejected_loss
FROM sides
"""


@_query
def op2_wrapper_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars."""
    from .html_wrapper import extract_main_text

    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@_query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    from .merkle import digest, manifest

    return digest(manifest(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _merkle_sql(levels: int = 6) -> str:
    """The trees level by level, for sources and numbers of sources of up to 16 ** levels rows."""
    up = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
    field = lambda x: f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    parts = [
        # The polynomial of CRC-32, over the ASCII codes of the decimal id.
        "table256 AS (SELECT list(list_reduce([k] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS t FROM range(256) AS x(k))",
        f"leaves AS (SELECT coalesce('s' || source, 'n') AS grp, doc_id, {leaf('text')} AS leaf, {leaf(f'translate(text, {up}, lower({up}))')} AS lowered, "
        "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0 AS hit FROM documents, table256)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves)",
    ]

    def tree(name: str, first: str) -> None:
        parts.append(f"{name}0 AS ({first})")
        for k in range(levels):
            # A level is built where more than one node is left; else the node stays.
            parts.append(f"{name}{k}n AS (SELECT *, count(*) OVER (PARTITION BY grp) > 1 AS more FROM {name}{k})")
            parts.append(f"{name}{k + 1} AS (SELECT grp, place // 16 AS place, CASE WHEN bool_or(more) THEN sha256(string_agg(node, '' ORDER BY place)) ELSE min(node) END AS node FROM {name}{k}n GROUP BY grp, place // 16)")

    tree("a", "SELECT grp, place, leaf AS node FROM placed")
    tree("b", f"SELECT 0 AS grp, row_number() OVER (ORDER BY grp) - 1 AS place, node FROM a{levels}")
    parts.append(f"sources AS (SELECT grp, node AS subroot, row_number() OVER (ORDER BY grp) - 1 AS at FROM a{levels})")
    parts.append("rows0 AS (SELECT p.*, s.subroot, s.at, coalesce(CASE WHEN hit THEN lowered END, leaf) AS fold, '' AS proof FROM placed p JOIN sources s USING (grp))")
    last = "rows0"
    for name, own, key in (("a", "r.place", "x.grp = r.grp"), ("b", "r.at", "x.grp = 0")):
        for k in range(levels):
            # Both sides of a row in its run, which has fewer than 16 others.
            side = lambda sign: f"(SELECT coalesce(string_agg(x.node, '' ORDER BY x.place), '') FROM {name}{k}n x WHERE {key} AND x.more AND x.place // 16 = {own} // {16 ** (k + 1)} AND x.place {sign} {own} // {16**k})"  # noqa: B023, E731
            level = f"{name}{k}"
            parts.append(f"s{level} AS (SELECT r.*, {side('<')} AS before, {side('>')} AS after, (SELECT bool_or(x.more) FROM {name}{k}n x WHERE {key} AND x.place = {own} // {16**k}) AS more FROM {last} r)")
            last = f"r{level}"
            parts.append(f"{last} AS (SELECT * EXCLUDE (fold, proof, before, after, more), CASE WHEN more THEN sha256(before || fold || after) ELSE fold END AS fold, proof || before || after AS proof FROM s{level})")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, b.node AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = b.node AS verified FROM {last}, b{levels} b"


ORACLE["op11_merkle_manifest"] = _merkle_sql()


@_query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    from .audit import interactions

    return interactions(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE["op13_filter_audit"] = r"""
WITH docs AS (
    SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS body, list_distinct(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS vocabulary,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
    FROM documents
),
fails AS (
    SELECT part, doc_id, (words < 200)::INT + 2 * (100 * len(vocabulary) < 50 * words)::INT + 4 * (100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body))::INT
           + 8 * regexp_matches(body, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false)::INT AS mask
    FROM docs
),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
counts AS (
    SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM fails LEFT JOIN marks USING (doc_id) GROUP BY part, mask
),
letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
),
steps AS (
    SELECT filter_order, step::INT AS step, letter, bit,
           coalesce((SELECT sum(x.bit) FROM letters x WHERE strpos(filter_order, x.letter) < step), 0)::INT AS before
    FROM orders, range(1, 6) AS s(step) JOIN letters ON letter = substr(filter_order, step, 1)
),
parts AS (
    SELECT part, filter_order, step, letter, sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & bit > 0 AND mask & before = 0) AS removed,
           sum(n) FILTER (mask & bit > 0 AND mask & before > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
           sum(good) FILTER (mask & bit > 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0) AS toxic_lost
    FROM counts, steps GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley
FROM parts
"""


@_query
def op12_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    from pyspark.sql import functions as F

    from .quality_cnn import held_out
    from .toxicity import score_toxicity, train_toxicity

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_toxicity(docs, train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
