"""The queries ``opN_<name>``: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gneiss.llm.suffix_dedup import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"), window=400)
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gneiss.llm.voronoi_topk import top_inner

    return top_inner(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gneiss.llm.byte_bpe import encoded

    out = encoded(_table(spark, sf_dir, "documents"), name="byte_bpe_multi_50k.tiktoken")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gneiss.llm.jaccard_join import jaccard_groups

    out = jaccard_groups(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)
    return out.select("doc_id", "n_shingles", "component_id")


def op5_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gneiss.llm.lattice_dedup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.98)


#: (verdict, host, path)
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op7_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gneiss.llm.url_cascade import judged

    return judged(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gneiss.llm.mixing import described, mixed, topics
    from gneiss.llm.work import written

    docs = _table(spark, sf_dir, "documents")
    text = F.col("text")
    # What the mixture needs of the texts, read once.
    facts = written(described(docs, text, topics(docs, text)).select("row.doc_id", "row.source", "row.lang", "topic", "n_tokens"), "facts")
    out = mixed(facts, {m: F.col(m) for m in ("source", "lang", "topic")}, F.col("n_tokens"))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "sampled")


def op8_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gneiss.llm.kneser_ney import classified

    out = classified(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.drop("text_key")


def op9_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gneiss.llm.log_bilinear import scored

    return scored(_table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gneiss.llm.html_text import extracted

    out = extracted(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES: dict[str, Query] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_voronoi_topk": op2_voronoi_topk,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_lattice_dedup": op5_lattice_dedup,
    "op6_mixing": op6_mixing,
    "op7_url_cascade": op7_url_cascade,
    "op8_kneser_ney_quality": op8_kneser_ney_quality,
    "op9_log_bilinear": op9_log_bilinear,
    "op10_html_text": op10_html_text,
}

#: DuckDB SQL of those queries that SQL can express on whole tables.
ORACLES: dict[str, str] = {}

ORACLES["op2_voronoi_topk"] = """
WITH v AS (
    SELECT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scores AS (
    SELECT q.id AS query_id, c.id AS vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.id <> c.id AND len(q.x) = len(c.x)
    WHERE q.id % 100 = 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

ORACLES["op7_url_cascade"] = """
WITH r(verdict, h, p) AS (
    VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), a AS (
    SELECT page_id, row_number() OVER () AS n, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
    SELECT page_id, n, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a
), c AS (
    SELECT page_id, n, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b
), d AS (
    SELECT c.n, h || p AS rule, verdict, row_number() OVER (PARTITION BY c.n ORDER BY length(h || p) DESC, length(h) DESC) AS k
    FROM c JOIN r ON (c.host = h OR ends_with(c.host, '.' || h)) AND starts_with(c.path, p)
)
SELECT page_id, host, path, d.rule AS rule, coalesce(d.verdict, 'allow') AS verdict FROM c LEFT JOIN d ON c.n = d.n AND d.k = 1
"""


def _components_sql(final: str) -> str:
    """From ``rows`` (n, id) and ``edges`` (a, b, both ways): ``comp`` (n, component_id), then ``final``."""
    return f"""reach AS (
    SELECT a, b FROM edges
    UNION
    SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
), comp AS (
    SELECT x.n, least(x.id, min(y.id)) AS component_id FROM rows x LEFT JOIN reach ON reach.a = x.n LEFT JOIN rows y ON y.n = reach.b GROUP BY x.n, x.id
)
{final}"""


ORACLES["op1_suffix_array_dedup"] = """
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS n, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), win AS (
    SELECT n, i, hash(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT n, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 399)) AS i FROM d)
), rep AS (
    SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY k) AS c FROM win) WHERE c > 1
), steps AS (
    SELECT n, i, CASE WHEN i <= lag(i) OVER (PARTITION BY n ORDER BY i) + 400 THEN 0 ELSE 1 END AS s FROM rep
), runs AS (
    SELECT n, i, sum(s) OVER (PARTITION BY n ORDER BY i) AS g FROM steps
), spans AS (
    SELECT n, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY n, g
), pieces AS (
    SELECT n, a, b, coalesce(lag(b) OVER (PARTITION BY n ORDER BY a), 0) AS before FROM spans
), cut AS (
    SELECT p.n, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(b) AS last, sum(b - a) AS gone, count(*) AS spans
    FROM pieces p JOIN d ON d.n = p.n GROUP BY p.n
)
SELECT doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN cut ON cut.n = d.n
"""

ORACLES["op4_ngram_jaccard_join"] = (
    """WITH RECURSIVE w AS (
    SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
    SELECT n, doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), sizes AS MATERIALIZED (
    SELECT n, doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM sets
), rows AS (
    SELECT n, doc_id AS id FROM sizes
), grams AS MATERIALIZED (
    SELECT n, unnest(s) AS g FROM sets
), common AS (
    SELECT a.n AS a, b.n AS b, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.n <> b.n GROUP BY a.n, b.n
), edges AS MATERIALIZED (
    SELECT a, b FROM common JOIN sizes x ON x.n = a JOIN sizes y ON y.n = b WHERE 100 * k >= 90 * (x.n_shingles + y.n_shingles - k)
), """
    + _components_sql("SELECT doc_id, n_shingles, component_id FROM sizes JOIN comp USING (n)")
)

ORACLES["op5_lattice_dedup"] = (
    """WITH RECURSIVE rows AS MATERIALIZED (
    SELECT row_number() OVER () AS n, vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), good AS MATERIALIZED (
    SELECT * FROM rows WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda v: v IS NOT NULL AND isfinite(v))) = len(x) AND len(list_filter(x, lambda v: v <> 0)) > 0
), edges AS MATERIALIZED (
    SELECT a.n AS a, b.n AS b FROM good a JOIN good b ON a.label = b.label AND a.n <> b.n AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.98
), """
    + _components_sql(
        "SELECT rows.id AS vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, component_id, rows.id IS NOT DISTINCT FROM component_id AS kept"
        " FROM rows JOIN comp USING (n) LEFT JOIN (SELECT a AS n, count(*) AS k FROM edges GROUP BY a) USING (n)"
    )
)


def _mixing_sql(rounds: int = 20, temper: float = 0.8, keep: float = 0.8, topics: int = 32) -> str:
    """The rounds of fitting, written out."""
    parts = [
        "x AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, source, lang, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents)",
        "df AS (SELECT w, count(*) AS n FROM (SELECT unnest(list_distinct(words)) AS w FROM x) GROUP BY w)",
        f"names AS MATERIALIZED (SELECT w FROM df WHERE n <= (SELECT count(*) FROM documents) * 0.1 AND regexp_matches(w, '^\\p{{L}}{{4,}}$') ORDER BY n DESC, w LIMIT {topics})",
        "hits AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(words) AS w FROM x) WHERE w IN (SELECT w FROM names) GROUP BY id, w)",
        "best AS (SELECT id, first(w ORDER BY n DESC, w) AS w FROM hits GROUP BY id)",
        "d AS MATERIALIZED (SELECT doc_id, source, lang, coalesce(best.w, 'none') AS topic, CAST(len(words) AS BIGINT) AS n_tokens FROM x LEFT JOIN best ON x.id = best.id)",
        "c0 AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS n, CAST(sum(n_tokens) AS DOUBLE) AS w FROM d GROUP BY source, lang, topic)",
    ]
    margins = ("source", "lang", "topic")
    for m in margins:
        parts.append(f"t_{m} AS (SELECT {m} AS v, pow(sum(n), {temper}) / sum(pow(sum(n), {temper})) OVER () AS t FROM c0 GROUP BY {m} HAVING sum(n) > 0)")
    k = 0
    for _ in range(rounds):
        for m in margins:
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.n, CASE WHEN s.s > 0 THEN c.w * coalesce(t.t, 0) / s.s ELSE 0 END AS w FROM c{k} c JOIN (SELECT {m} AS v, sum(w) AS s FROM c{k} GROUP BY {m}) s ON c.{m} IS NOT DISTINCT FROM s.v LEFT JOIN t_{m} t ON c.{m} IS NOT DISTINCT FROM t.v)")
            k += 1
    parts.append(f"f AS (SELECT source, lang, topic, n, w, CASE WHEN n > 0 THEN w / n ELSE 0 END AS f FROM c{k})")
    parts.append("o AS (SELECT f, coalesce(sum(n) OVER (ORDER BY f DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_n, sum(w) OVER (ORDER BY f DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM f WHERE f > 0)")
    parts.append(f"l AS (SELECT (g - full_n) / rest AS number FROM o, (SELECT {keep} * sum(n) AS g FROM f) WHERE (g - full_n) / rest * f <= 1 ORDER BY f DESC LIMIT 1)")
    parts.append("p AS (SELECT source, lang, topic, CASE WHEN f > 0 THEN least(1, f * coalesce((SELECT number FROM l), 'inf'::DOUBLE)) ELSE 0 END AS p FROM f)")
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(p.p, 6) AS probability,"
        " CAST(CAST('0x' || substr(md5(concat_ws(':', 'mix', coalesce(CAST(d.doc_id AS VARCHAR), ''))), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 < p.p AS sampled"
        " FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic IS NOT DISTINCT FROM p.topic"
    )


ORACLES["op6_mixing"] = _mixing_sql()
