"""The queries of this subpackage, with production parameters over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.quality import quality_rules

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules(docs, trusted).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tesserae.llm.tokenizer import encode

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.url_filter import url_filter

    # The number that ends a url's path is the id of the document that the page shows; its labels are the page's.
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr("try_cast(regexp_extract(url, '/([0-9]+)(?:[.]html|/)?(?:[?#].*)?$', 1) AS BIGINT)").alias("doc_id"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.expr("CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality = 1 OR toxic = 0 THEN 0 END").alias("bad"))
    return url_filter(pages.drop("doc_id"), pages.join(labels, "doc_id").select("page_id", "bad"))


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
         try_cast(regexp_extract(url, '/([0-9]+)(?:[.]html|/)?(?:[?#].*)?$', 1) AS BIGINT) AS doc_id FROM pages),
o AS (SELECT p.page_id, count(*) AS n, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS k FROM p JOIN labels USING (doc_id)
      WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY 1),
h0 AS (SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(k), 0)::DOUBLE AS k FROM (SELECT DISTINCT page_id, host FROM p) LEFT JOIN o USING (page_id) GROUP BY 1),
h1 AS (SELECT *, string_split(host, '.') AS l FROM h0),
h AS (SELECT host, n, k, array_to_string(l[-(CASE WHEN len(l) > 2 AND array_to_string(l[-2:], '.') IN ('ac.uk','co.uk','gov.uk','org.uk','com.au','net.au','org.au','co.jp','co.nz','com.br','com.cn','com.mx') THEN 3 ELSE 2 END):], '.') AS domain,
      array_to_string(l[-(CASE WHEN len(l) > 2 AND array_to_string(l[-2:], '.') IN ('ac.uk','co.uk','gov.uk','org.uk','com.au','net.au','org.au','co.jp','co.nz','com.br','com.cn','com.mx') THEN 2 ELSE 1 END):], '.') AS suffix FROM h1),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY 1, 2),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY 1),
a AS (SELECT coalesce(sum(k) / nullif(sum(n), 0), 0.05) AS mu FROM s),
s1 AS (SELECT s.*, mu FROM s, a),
sm AS (SELECT coalesce(CASE WHEN r > 0 THEN least(greatest(1 / r - 1, 1.0), 1000.0) END, 1000.0) AS m FROM (SELECT sum((k - n * mu) ** 2 - n * mu * (1 - mu)) / nullif(sum(n * (n - 1) * mu * (1 - mu)), 0) AS r FROM s1)),
d1 AS (SELECT d.*, (s1.k + m * mu) / (s1.n + m) AS mu FROM d JOIN s1 USING (suffix), sm),
dm AS (SELECT coalesce(CASE WHEN r > 0 THEN least(greatest(1 / r - 1, 1.0), 1000.0) END, 1000.0) AS m FROM (SELECT sum((k - n * mu) ** 2 - n * mu * (1 - mu)) / nullif(sum(n * (n - 1) * mu * (1 - mu)), 0) AS r FROM d1)),
h2 AS (SELECT h.*, (d1.k + m * mu) / (d1.n + m) AS mu FROM h JOIN d1 USING (domain), dm),
hm AS (SELECT coalesce(CASE WHEN r > 0 THEN least(greatest(1 / r - 1, 1.0), 1000.0) END, 1000.0) AS m FROM (SELECT sum((k - n * mu) ** 2 - n * mu * (1 - mu)) / nullif(sum(n * (n - 1) * mu * (1 - mu)), 0) AS r FROM h2)),
b AS (SELECT host, n, m, (k + m * mu) / (n + m) AS q FROM h2, hm),
j AS (SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    q - 1.6448536269514722 * sqrt(q * (1 - q) / (n + m + 1)) AS lower FROM p JOIN b USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN lower > 0.3 THEN 'block' ELSE 'allow' END AS verdict FROM j
"""


def op5_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.lm import lm_score, remainder

    held_out = remainder("doc_id", 7) == 2
    scored = lm_score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
u AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reached FROM n UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached)
SELECT n.doc_id, n.n AS n_shingles, min(r.reached) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY 1, 2
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.toxicity import held_out, toxicity, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id")).select("doc_id", "toxic")
    scored = toxicity(docs, train(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.embedding import near_dedup

    return near_dedup(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
r AS (SELECT vec_id AS node, vec_id AS reached FROM v UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY 1),
k AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON node = vec_id LEFT JOIN k ON a = vec_id
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE r AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS full_at, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS w FROM r GROUP BY source),
lv AS (
  SELECT 0 AS i, (SELECT sum(source_size)::DOUBLE FROM s) / (SELECT sum(w) FROM s) AS level
  UNION ALL
  SELECT i + 1, ((SELECT sum(source_size)::DOUBLE FROM s) - (SELECT coalesce(sum(full_at), 0) FROM s WHERE full_at < level * w)) / (SELECT sum(w) FROM s WHERE full_at >= level * w) FROM lv WHERE i < 40),
g AS (SELECT source, source_size, CASE WHEN full_at < level * w THEN full_at::DOUBLE ELSE level * w END AS target FROM s, (SELECT max(level) AS level FROM lv)),
p AS (SELECT r.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, floor(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target, (size * epochs + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM e
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.line_dedup import line_dedup
    from tesserae.llm.url_filter import host_of

    # The lines of a page are what stands between its tags.
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("text"))
    return line_dedup(pages, host_of(F.col("url")), break_at=r"<[^>]*>|\n").select("page_id", host_of(F.col("url")).alias("host"), "n_lines", "n_dropped", "text")


OP10_SQL = r"""
WITH p AS (SELECT page_id, html, row_number() OVER () AS rid, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  string_split_regex(html, '<[^>]*>|\n') AS lines FROM pages),
l AS (SELECT rid, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM p),
m AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS core FROM l),
c AS (SELECT host, core, count(DISTINCT rid) AS n FROM m WHERE core <> '' GROUP BY 1, 2),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY 1),
b AS (SELECT host, core FROM c JOIN t USING (host) WHERE n > 1 AND 100 * n > 30 * pages),
k AS (SELECT m.rid, count(*) AS n_lines, count(b.core) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE b.core IS NULL) AS kept FROM m LEFT JOIN b USING (host, core) GROUP BY 1)
SELECT page_id, host, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped,
  CASE WHEN html IS NOT NULL THEN coalesce(kept, '') END AS text FROM p LEFT JOIN k USING (rid)
"""


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.whitening import whiten

    rows, found = whiten(table(spark, sf_dir, "embeddings"))
    long = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    explained = F.get(F.lit(found.explained if found else [0.0]), F.col("place"))
    return long.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(found.n if found else 0).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"), "whitened",
        explained.alias("explained"), F.lit(found.identity_error if found else 0.0).alias("identity_error"),
    )


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tesserae.llm.packing import pack, pieces

    cut = pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserae.llm.codes import codebooks_sha256, compress, error_by

    coded, books = compress(table(spark, sf_dir, "embeddings"), carry=["label"])
    return error_by(coded, "label").select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def op13_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds follow one another as tables; vectors of one length, a multiple of the parts."""
    gap = "list_sum(list_transform(list_zip(q, e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    out = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT rid, part, x[part * (len(x) // {parts}) + 1:(part + 1) * (len(x) // {parts})] AS q FROM v, range({parts}) r(part)),
f AS (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS entry FROM v QUALIFY entry < {entries}),
b0 AS MATERIALIZED (SELECT part, entry, q AS e FROM s JOIN f USING (rid))"""
    for k in range(rounds + 1):
        out += f""",
a{k} AS MATERIALIZED (SELECT rid, part, q, min(struct_pack(d := {gap}, entry := entry)) AS m FROM s JOIN b{k} USING (part) GROUP BY 1, 2, 3)"""
        if k < rounds:
            out += f""",
m{k} AS (SELECT part, entry, place, floor(sum(y) / count(*))::BIGINT AS y, sum(y)::HUGEINT AS total, count(*) AS n FROM (SELECT part, m.entry AS entry, unnest(q) AS y, generate_subscripts(q, 1) AS place FROM a{k}) GROUP BY 1, 2, 3),
l{k} AS (SELECT part, entry, list((total - ((total % n) + n) % n) // n ORDER BY place)::BIGINT[] AS e FROM m{k} GROUP BY 1, 2),
b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(l{k}.e, b{k}.e) AS e FROM b{k} LEFT JOIN l{k} USING (part, entry))"""
    return out + f""",
c AS (SELECT rid, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY 1),
h AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(e) AS y, generate_subscripts(e, 1) AS place FROM b{rounds}))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM c JOIN v USING (rid), h"""


OP13_SQL = op13_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_quality_rules, op2_license_scan, op3_byte_bpe, op4_url_reputation, op5_hidden_markov, op6_ngram_jaccard, op7_toxicity, op8_nn_descent, op9_mixing, op10_line_dedup, op11_whitening, op12_best_fit_packing, op13_vector_codes)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_reputation": OP4_SQL, "op6_ngram_jaccard": OP6_SQL, "op8_nn_descent": OP8_SQL, "op9_mixing": OP9_SQL, "op10_line_dedup": OP10_SQL, "op13_vector_codes": OP13_SQL}
