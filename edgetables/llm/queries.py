"""One query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from edgetables.llm import (
    embed_dedup,
    filter_audit,
    html_text,
    langid,
    minhash,
    order_minhash,
    packing,
    pii,
    resample,
    token_file,
    topk,
    unigram,
    warc,
)
from edgetables.registry.base import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_pack_sequences")
def _(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op5_token_files")
def _(spark, sf_dir):
    folder = token_file.write_token_files(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    read = token_file.read_token_files(spark, folder.uri)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query(
    "op4_warc_revisits",
    "WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), "
    "h AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS payload_digest FROM p), "
    "o AS (SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 "
    "THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS original FROM h) "
    "SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, "
    "CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type, "
    "CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to FROM o",
)
def _(spark, sf_dir):
    folder = warc.write_warc(table(spark, sf_dir, "pages"))
    read = warc.resolve_revisits(warc.read_records(spark, folder.uri))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SOUND_SQL = (
    "embedding IS NOT NULL AND len(embedding) > 0 AND "
    "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
)


@query(
    "op7_bit_sliced_topk",
    "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c "
    f"FROM embeddings WHERE {SOUND_SQL}), "
    "s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.c, v.c) AS BIGINT) AS score "
    "FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0), "
    "r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, "
    "vec_id, score FROM s) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5",
)
def _(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


@query(
    "op10_near_embeddings",
    "WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS c, "
    "sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS size "
    f"FROM embeddings WHERE {SOUND_SQL}), "
    "e AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM v a JOIN v b ON a.vec_id <> b.vec_id "
    "WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.c, b.c) >= 0.9 * a.size * b.size), "
    "cc(node, comp) USING KEY (node) AS (SELECT src, least(src, min(dst)) FROM e GROUP BY src UNION "
    "SELECT e.src, min(c.comp) FROM e JOIN cc c ON c.node = e.dst JOIN recurring.cc r ON r.node = e.src "
    "WHERE c.comp < r.comp GROUP BY e.src), "
    "n AS (SELECT src, count(*) AS n_links FROM e GROUP BY src) "
    "SELECT m.vec_id, coalesce(n_links, 0) AS n_links, coalesce(comp, m.vec_id) AS component_id, "
    "m.vec_id = coalesce(comp, m.vec_id) AS kept FROM embeddings m LEFT JOIN n ON n.src = m.vec_id "
    "LEFT JOIN cc ON cc.node = m.vec_id",
)
def _(spark, sf_dir):
    return embed_dedup.near_links(table(spark, sf_dir, "embeddings"))


@query("op6_language_id")
def _(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = langid.train(documents.filter(~langid.held_out()))
    guessed = langid.predict(documents.select("doc_id", "text"), model)
    return guessed.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query(
    "op2_minhash_components",
    "WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), "
    "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words "
    "FROM documents), "
    "g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), "
    "lambda i: words[i:i + 3]) WHEN len(words) > 0 THEN [words] ELSE [] END) AS shingle FROM w), "
    "n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id), "
    "s AS (SELECT shingle, list(doc_id) AS docs FROM g GROUP BY shingle HAVING count(*) > 1), "
    "p AS (SELECT a.doc_id AS src, b.doc_id AS dst, count(*) AS common FROM g a JOIN g b ON a.shingle = b.shingle "
    "AND a.doc_id <> b.doc_id WHERE a.shingle IN (SELECT shingle FROM s) GROUP BY ALL), "
    "e AS (SELECT src, dst FROM p JOIN n x ON x.doc_id = src JOIN n y ON y.doc_id = dst "
    "WHERE 100 * common >= 80 * (x.n + y.n - common)), "
    "cc(node, comp) USING KEY (node) AS (SELECT src, least(src, min(dst)) FROM e GROUP BY src UNION "
    "SELECT e.src, min(c.comp) FROM e JOIN cc c ON c.node = e.dst JOIN recurring.cc r ON r.node = e.src "
    "WHERE c.comp < r.comp GROUP BY e.src) "
    "SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp, d.doc_id) AS component_id, "
    "d.doc_id = coalesce(comp, d.doc_id) AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id "
    "LEFT JOIN cc ON cc.node = d.doc_id",
)
def _(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4)


@query("op1_personal_data")
def _(spark, sf_dir):
    found = pii.find(table(spark, sf_dir, "documents"), ["doc_id"])
    kinds = [
        F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{kind}")
        for k, kind in enumerate(pii.KINDS)
    ]
    return found.select(
        "doc_id",
        *kinds,
        F.sha2(pii.span_names("base"), 256).alias("base_sha256"),
        pii.span_names("spans").alias("spans"),
    )


@query("op8_main_text")
def _(spark, sf_dir):
    return html_text.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


@query("op9_unigram_pieces")
def _(spark, sf_dir):
    """Size and checksum of the ids of every text, and what decoding them gives."""
    path = tokenizer("piece_bpe_32k.model")
    read = unigram.decode(unigram.encode(table(spark, sf_dir, "documents"), path), path)
    return read.select(
        "doc_id",
        (F.length("ids") / 4).cast("bigint").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
        F.length("text").cast("bigint").alias("n_chars"),
    )


# CRC-32 of each distinct word: a table of 256 entries, then the bytes one after another.
CRC_SQL = (
    "tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: "
    "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t), "
    "crc AS (SELECT feature, 4294967295 - list_reduce(list_transform(range(1, length(x) + 1, 2), lambda i: "
    "16 * (instr('0123456789ABCDEF', x[i]) - 1) + instr('0123456789ABCDEF', x[i + 1]) - 1), lambda c, b: "
    "xor(c // 256, t[1 + xor(c % 256, b)]), 4294967295) AS crc FROM (SELECT feature, hex(encode(feature)) AS x FROM u) JOIN tab ON true)"
)
WORDS_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)


@query(
    "op11_bit_sliced_resampling",
    f"WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS words FROM documents), "
    f"dw AS (SELECT r, unnest(words) AS feature FROM d), bw AS (SELECT unnest({WORDS_SQL}) AS feature FROM benchmark), "
    f"u AS (SELECT feature FROM dw UNION SELECT feature FROM bw), {CRC_SQL}, "
    "b AS (SELECT feature, crc % 10000 AS bucket FROM crc), "
    "s AS (SELECT bucket, count(*) AS n FROM dw JOIN b USING (feature) GROUP BY bucket), "
    "t AS (SELECT bucket, count(*) AS n FROM bw JOIN b USING (feature) GROUP BY bucket), "
    "z AS (SELECT CAST((SELECT count(*) FROM dw) AS DOUBLE) AS s_all, CAST((SELECT count(*) FROM bw) AS DOUBLE) AS t_all), "
    "g AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * (s_all + 10000) / "
    "((s.n + 1.0::DOUBLE) * (t_all + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), z), "
    "w AS (SELECT r, count(*) AS n, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight "
    "FROM dw JOIN b USING (feature) JOIN g USING (bucket) GROUP BY r), "
    "h AS (SELECT r, list_reduce(list_transform(range(1, 9), lambda i: instr('0123456789abcdef', x[i]) - 1), "
    "lambda a, c: 16 * a + c, 0) AS h FROM (SELECT r, sha256('2024:' || doc_id) AS x FROM d)), "
    "o AS (SELECT doc_id, r, len(words) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, "
    "coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score "
    "FROM d JOIN h USING (r) LEFT JOIN w USING (r)), "
    "k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM o WHERE n_words >= 20 AND score IS NOT NULL) "
    "SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM k) // 100 THEN rank END AS rank "
    "FROM o LEFT JOIN k USING (r)",
)
def _(spark, sf_dir):
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_order_minhash")
def _(spark, sf_dir):
    return order_minhash.with_next(table(spark, sf_dir, "documents"))


@query(
    "op13_filter_interactions",
    "WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, "
    "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents), "
    "j AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, "
    "max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id), "
    "m AS (SELECT doc_id, part, CASE WHEN len(words) < 100 THEN 1 ELSE 0 END "
    "+ CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END "
    "+ CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body) THEN 4 ELSE 0 END "
    "+ CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END "
    "+ CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 16 ELSE 0 END AS mask FROM d), "
    "c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS g, sum(coalesce(bad, 0)) AS x "
    "FROM m LEFT JOIN j USING (doc_id) GROUP BY part, mask), "
    "l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)), "
    "p AS (SELECT a.name || b.name || e.name || f.name || h.name AS filter_order, [a.bit, b.bit, e.bit, f.bit, h.bit] AS bits "
    "FROM l a JOIN l b ON b.bit <> a.bit JOIN l e ON e.bit NOT IN (a.bit, b.bit) JOIN l f ON f.bit NOT IN (a.bit, b.bit, e.bit) "
    "JOIN l h ON h.bit NOT IN (a.bit, b.bit, e.bit, f.bit)), "
    "s AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step]) - bits[step] AS before "
    "FROM p, (SELECT unnest(range(1, 6)) AS step)), "
    "r AS (SELECT part, filter_order, step, bit, mask, n, g, x, mask & CAST(bit AS INTEGER) > 0 AS here, "
    "mask & CAST(before AS INTEGER) > 0 AS gone FROM c, s), "
    "t AS (SELECT part, filter_order, step, bit, sum(CASE WHEN NOT here AND NOT gone THEN n ELSE 0 END) AS kept, "
    "sum(CASE WHEN here AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN here AND gone THEN n ELSE 0 END) AS redundant, "
    "sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN here AND NOT gone THEN g ELSE 0 END) AS good_lost, "
    "sum(CASE WHEN here AND NOT gone THEN x ELSE 0 END) AS toxic_lost FROM r GROUP BY ALL) "
    "SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, "
    "CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, "
    "CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM t",
)
def _(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
