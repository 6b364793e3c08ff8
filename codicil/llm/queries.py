"""The contract's queries: each applies its operator to a whole table and takes its digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontam, edit_counts, fuzzy_lines, main_text, media_tiles, mixing, near_dedup, pii, substring, tokens_wavelet, toxicity, yinyang
from .common import table


def op1_token_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_wavelet.encode_corpus(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_media_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_tiles.media_features(media_tiles.store_text_media(table(spark, sf_dir, "documents")))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.recount(table(spark, sf_dir, "documents"), edit_counts.mask_entities)


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fuzzy_lines.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.col("mix_copy").cast("long").alias("mix_copy"), "mix_key", F.md5("text").alias("text_md5"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_secret", "n_term", "n_private")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_yinyang_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.cluster(table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_token_wavelet, op2_media_tiles, op3_near_dedup, op4_suffix_trees, op5_edit_counts, op6_fuzzy_lines, op7_decontaminate, op8_poisson_mix, op9_pii, op10_toxicity, op11_yinyang_clusters, op12_collocations, op13_main_text)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_DISTANCE = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _round(i: int) -> str:
    """Assignment to the centroids of round i, and the centroids of the next."""
    return f"""
        a{i} AS MATERIALIZED (SELECT u, vec_id, v, min((d, j)) AS best FROM (SELECT u, vec_id, v, j, {_DISTANCE} AS d FROM v, c{i}) GROUP BY u, vec_id, v),
        s{i} AS (SELECT j, p, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT best[2] AS j, unnest(v) AS x, unnest(range(0, 64)) AS p FROM a{i}) GROUP BY j, p),
        m{i} AS (SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS m FROM s{i} GROUP BY j),
        c{i + 1} AS MATERIALIZED (SELECT c{i}.j, coalesce(m, c) AS c FROM c{i} LEFT JOIN m{i} ON m{i}.j = c{i}.j),"""


ORACLES: dict[str, str] = {
    "op4_suffix_trees": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+') AS ws FROM documents),
        w AS (SELECT doc_id, i, md5(array_to_string(ws[i + 1 : i + 50], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 49, 0))) AS i FROM d)),
        m AS (SELECT h, min(doc_id) AS low FROM w GROUP BY h),
        hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM w JOIN m USING (h) WHERE doc_id > low),
        words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS p FROM d),
        kept AS (SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY p)) AS s FROM words ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id),
        gone AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, coalesce(s, sha256('')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)""",
    "op7_decontaminate": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_ALNUM}) AS ws FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOW}, {_ALNUM}) AS ws FROM benchmark),
        t AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(ws), 10) AS n, array_to_string(ws[i + 1 : i + 10], ' ') AS g FROM (SELECT item_id, ws, unnest(range(0, greatest(len(ws) - 9, 1))) AS i FROM b WHERE len(ws) > 0)),
        w AS (SELECT doc_id, n, i, array_to_string(ws[i + 1 : i + n], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(0, greatest(len(ws) - n + 1, 0))) AS i FROM d, (SELECT DISTINCT n FROM t))),
        h AS (SELECT doc_id, n, i, item FROM w JOIN t USING (n, g)),
        p AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM h) GROUP BY doc_id),
        q AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)""",
    "op8_poisson_mix": """
        WITH RECURSIVE s AS (SELECT source, CAST(sum(n_chars) AS DOUBLE) AS size FROM documents GROUP BY source),
        a AS (SELECT CAST(count(*) AS DOUBLE) AS w, sum(size) AS total FROM s WHERE size > 0),
        r AS (SELECT source, 1.0 / w * total / size AS rate FROM s, a WHERE size > 0),
        q AS (SELECT source, CAST(greatest(1, ceil(rate / 16.0)) AS INTEGER) AS parts, rate / greatest(1, ceil(rate / 16.0)) AS part FROM r),
        c(source, parts, part, k, p, cdf) AS (SELECT source, parts, part, 0, exp(-part), exp(-part) FROM q
            UNION ALL SELECT source, parts, part, k + 1, p * part / (k + 1), cdf + p * part / (k + 1) FROM c WHERE k < 63),
        u AS (SELECT doc_id, source, text, i, (CAST(CAST('0x' || substr(md5('17|' || doc_id || '|' || i), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u
            FROM (SELECT doc_id, documents.source AS source, text, unnest(range(1, parts + 1)) AS i FROM documents JOIN q ON documents.source = q.source)),
        n AS (SELECT doc_id, u.source AS source, text, count(*) AS n FROM u JOIN c ON u.source = c.source AND c.cdf <= u.u GROUP BY doc_id, u.source, text)
        SELECT doc_id, source, mix_copy, md5('order 17|' || doc_id || '|' || mix_copy) AS mix_key, md5(text) AS text_md5 FROM (SELECT doc_id, source, text, unnest(range(1, n + 1)) AS mix_copy FROM n)""",
    "op11_yinyang_clusters": f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS u, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v AS c FROM (SELECT sha256('2:' || vec_id) AS h, v FROM v ORDER BY h, v LIMIT 40)),
        {"".join(_round(i) for i in range(6))}
        f AS (SELECT vec_id, best[2] AS j, best[1] AS d FROM a5)
        SELECT vec_id, CAST(f.j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY f.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(c, ',')) AS centroid_sha256 FROM f JOIN c5 ON c5.j = f.j""",
    "op12_collocations": rf"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOW}, '[.,;:!?\n\v\f\r]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS ws FROM p),
        g AS ({" UNION ALL ".join(f"SELECT lang, unnest(list_transform(range(1, greatest(len(ws) - {k - 1}, 0) + 1), lambda i: ws[i : i + {k - 1}])) AS g FROM w" for k in range(1, 6))}),
        f AS MATERIALIZED (SELECT lang, g, count(*) AS f FROM g GROUP BY lang, g HAVING count(*) >= 100),
        n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
        cand AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1),
        inside AS (SELECT DISTINCT x.lang, x.sub AS g, x.a FROM (SELECT lang, a, unnest([g[1 : len(g) - 1], g[2 : len(g)]]) AS sub FROM cand) x),
        kept AS (SELECT * FROM cand ANTI JOIN inside USING (lang, g, a)),
        cut AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM kept),
        scored AS (SELECT cut.lang, cut.g, a, k, x.f AS l, y.f AS r, n, CAST(CAST(1000 AS HUGEINT) * a * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
            FROM cut JOIN f x ON x.lang = cut.lang AND x.g = cut.g[1 : k] JOIN f y ON y.lang = cut.lang AND y.g = cut.g[k + 1 : len(cut.g)] JOIN n ON n.lang = cut.lang),
        least AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM least QUALIFY rank <= 2000""",
}
