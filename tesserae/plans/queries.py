"""One query for each operator, over whole tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text as X
from tesserae.operators import assets, choose, expand, predicates, profile, related, relax, sketches, times, vector, vocab
from tesserae.operators.incremental import ProfileStore
from tesserae.operators.numbering import numbered
from tesserae.operators.vector_index import VectorIndex
from tesserae.sources.catalog import SALES, SalesCatalog
from tesserae.sources.files import PagedFiles
from tesserae.staging import stage_path, staged
from tesserae.streaming.chunks import in_order
from tesserae.streaming.run import arriving, drained
from tesserae.streaming.sessions import sessions

CONSTRAINTS = {"o_orderpriority": ["1-URGENT", "2-HIGH"], "c_mktsegment": "BUILDING", "l_returnflag": ["A", "N"]}
NAMED = ["l_returnflag", "l_linestatus", "o_orderstatus", "o_orderpriority", "c_mktsegment", "p_type", "n_name", "r_name"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue, with values that are absent, empty or none on some lines."""
    flag = F.when(F.col("l_linenumber") == 7, "None").when(F.col("l_linenumber") == 6, "").when(F.col("l_linenumber") == 5, None).otherwise(F.col("l_returnflag"))
    return SalesCatalog(spark, sf_dir).records().withColumn("l_returnflag", flag)


CATALOG = """cat AS (SELECT p_brand, CASE l_linenumber WHEN 7 THEN 'None' WHEN 6 THEN '' WHEN 5 THEN NULL ELSE l_returnflag END AS l_returnflag, l_linestatus, o_orderstatus, o_orderpriority, c_mktsegment, p_type, n_name, r_name, string_split(p_name, ' ') AS p_name, l_linenumber, l_suppkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)"""
KEPT = "value IS NOT NULL AND value <> '' AND lower(value) <> 'none'"
LONG = (
    "long AS (SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT p_brand AS entity, '{n}' AS facet, {n} AS value FROM cat" for n in NAMED)
    + f" UNION ALL SELECT p_brand, 'p_name', unnest(p_name) FROM cat) WHERE {KEPT})"
)
WHERE = "o_orderpriority IN ('1-URGENT', '2-HIGH') AND c_mktsegment = 'BUILDING' AND l_returnflag IN ('A', 'N')"


@query(f"WITH {CATALOG} SELECT count(*) AS hit_count FROM cat WHERE {WHERE} AND list_has_any(p_name, ['red', 'blue', 'green', 'large', 'small'])")
def facet_filter_count(spark, sf_dir):
    chosen = predicates.condition(SALES, {**CONSTRAINTS, "p_name": ["red", "blue", "green", "large", "small"]})
    return records(spark, sf_dir).where(chosen).agg(F.count("*").alias("hit_count"))


@query(f"WITH {CATALOG}, {LONG} SELECT facet, value, count(*) AS n FROM (SELECT facet, value FROM long UNION ALL SELECT 'p_brand', p_brand FROM cat) GROUP BY 1, 2")
def facet_counts(spark, sf_dir):
    return profile.facet_counts(records(spark, sf_dir), SALES)


@query(f"WITH {CATALOG} SELECT p_brand AS entity, count(*) AS dataset_count FROM cat GROUP BY 1")
def entity_counts(spark, sf_dir):
    return profile.entity_counts(records(spark, sf_dir), SALES)


@query(f"WITH {CATALOG}, {LONG} SELECT entity, facet, value, count(*) AS n FROM long GROUP BY 1, 2, 3")
def entity_facet_profile(spark, sf_dir):
    return profile.entity_profile(records(spark, sf_dir), SALES)


@query(f"""WITH {CATALOG}, {LONG}, c AS (SELECT entity, facet, value, count(*) AS n FROM long GROUP BY 1, 2, 3)
SELECT p_brand AS entity, 'Total Datasets' AS parameter, count(*)::VARCHAR AS "values", '' AS details FROM cat GROUP BY 1
UNION ALL SELECT entity, facet, 'Total: ' || sum(n)::BIGINT::VARCHAR, string_agg(value || ': ' || n::VARCHAR, ', ' ORDER BY value) FROM c GROUP BY 1, 2""")
def profile_table(spark, sf_dir):
    return profile.profile_table(records(spark, sf_dir), SALES)


@query(f"""WITH {CATALOG}, {LONG}, c AS (SELECT entity, facet, value, count(*) AS n FROM long GROUP BY 1, 2, 3),
f AS (SELECT entity, facet || '{{' || string_agg(value || ':' || n::VARCHAR, ',' ORDER BY value) || '}}' AS part, facet FROM c GROUP BY entity, facet)
SELECT f.entity, (SELECT count(*) FROM cat WHERE p_brand = f.entity) AS dataset_count, string_agg(part, ';' ORDER BY facet) AS facets FROM f GROUP BY f.entity""")
def entity_profile_nested(spark, sf_dir):
    nested = profile.nested_profile(records(spark, sf_dir), SALES)
    inner = lambda e: F.array_join(F.transform(e["value"], lambda v: F.concat(v["key"], F.lit(":"), v["value"].cast("string"))), ",")
    shown = F.transform(F.map_entries("facets"), lambda e: F.concat(e["key"], F.lit("{"), inner(e), F.lit("}")))
    return nested.select("entity", "dataset_count", F.array_join(shown, ";").alias("facets"))


PART = "CASE WHEN count(DISTINCT {0}) = 1 THEN '{0} == ''' || min({0}) || '''' WHEN count(DISTINCT {0}) > 1 THEN '{0} == [' || string_agg(DISTINCT '''' || {0} || '''', ', ' ORDER BY '''' || {0} || '''') || ']' END"


@query(f"WITH {CATALOG} SELECT concat_ws(' & ', " + ", ".join(PART.format(n) for n in ["p_brand", "o_orderpriority", "c_mktsegment", "p_type", "n_name", "r_name"]) + f") AS predicate FROM cat WHERE {WHERE}")
def predicate_string(spark, sf_dir):
    chosen = records(spark, sf_dir).where(predicates.condition(SALES, CONSTRAINTS))
    return predicates.predicate_string(chosen, ["p_brand", "o_orderpriority", "c_mktsegment", "p_type", "n_name", "r_name"])


DISTINCT = f"SELECT DISTINCT facet, value FROM (SELECT 'p_brand' AS facet, p_brand AS value FROM cat WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'l_returnflag', l_returnflag FROM cat WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'p_name', unnest(p_name) FROM cat WHERE c_mktsegment = 'BUILDING') WHERE {KEPT}"
OF = "(SELECT CASE WHEN count(*) = 1 THEN '{0} == ''' || min(value) || '''' WHEN count(*) > 1 THEN '{0} == [' || string_agg('''' || value || '''', ', ' ORDER BY value) || ']' END FROM v WHERE facet = '{0}')"


@query(f"WITH {CATALOG}, v AS ({DISTINCT}) SELECT concat_ws(' & ', " + ", ".join(OF.format(n) for n in ["p_brand", "l_returnflag", "p_name"]) + ") AS predicate")
def predicate_string_multi(spark, sf_dir):
    chosen = records(spark, sf_dir).where(predicates.condition(SALES, {"c_mktsegment": "BUILDING"}))
    return predicates.predicate_string(chosen, ["p_brand", "l_returnflag", "p_name"])


BASE = "https://catalog.example/search?"


@query(f"""WITH {CATALOG}, v AS (SELECT p_brand, string_agg(DISTINCT '"' || p_type || '"', ', ' ORDER BY '"' || p_type || '"') AS types FROM cat GROUP BY 1)
SELECT p_brand AS entity, '{BASE}activeFacets=' || replace(url_encode('{{"p_brand": ["' || p_brand || '"], "p_type": [' || types || ']}}'), '%2F', '/') || '&project=SALES' AS link FROM v""")
def search_link(spark, sf_dir):
    types = records(spark, sf_dir).groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("t"))
    facets = F.create_map(F.lit("p_brand"), F.array("p_brand"), F.lit("p_type"), F.col("t"))
    return types.select(F.col("p_brand").alias("entity"), predicates.link_column(BASE, facets, "SALES").alias("link"))


@query(r"""WITH t AS (SELECT DISTINCT c_mktsegment, n_name, [' ' || n_name || chr(9), '  ', '', NULL, c_mktsegment] AS raw FROM customer JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT c_mktsegment, n_name, list_filter(list_transform(raw, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS v FROM t)
SELECT c_mktsegment, n_name, array_to_string(v, '|') AS "values", len(v)::BIGINT AS n FROM s""")
def constraint_normalize(spark, sf_dir):
    named = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_mktsegment", "n_name").distinct()
    raw = F.array(F.concat(F.lit(" "), "n_name", F.lit("\t")), F.lit("  "), F.lit(""), F.lit(None), F.col("c_mktsegment"))
    kept = predicates.normalized_values(raw)
    return named.select("c_mktsegment", "n_name", F.array_join(kept, "|").alias("values"), F.size(kept).cast("long").alias("n"))


@query(f"WITH {CATALOG}, c AS (SELECT p_brand, count(*) AS n FROM cat GROUP BY 1) SELECT string_agg('- **' || p_brand || '**: ' || n::VARCHAR || ' datasets', chr(10) ORDER BY p_brand) AS summary FROM c")
def summary_lines(spark, sf_dir):
    return profile.summary_lines(records(spark, sf_dir), SALES)


def links(spark, sf_dir, twice: bool = False) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    copies = pages.withColumn("seq", F.col("page_id"))
    if twice:
        copies = copies.union(pages.withColumn("seq", F.col("page_id") + 1_000_000))
    url = F.col("url")
    return copies.select("seq", "url", assets.filename(url).alias("filename"), assets.node(url).alias("node"))


NODE = "CASE WHEN len(string_split(url, '/')) > 3 THEN string_split(url, '/')[3] ELSE 'unknown' END"
LINKS = f"links AS (SELECT page_id AS seq, url, string_split(url, '/')[-1] AS filename, {NODE} AS node FROM pages)"
#: The host that is best liked comes from the data, so that it is there at every scale.
LIKED = "liked AS (SELECT node, row_number() OVER (ORDER BY count(*) DESC, node) - 1 AS rank FROM links GROUP BY 1 QUALIFY row_number() OVER (ORDER BY count(*) DESC, node) <= 3)"


@query(f"WITH {LINKS} SELECT seq, url, filename, node FROM links")
def url_parse(spark, sf_dir):
    return links(spark, sf_dir)


NAMES = "names AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber WHEN 1 THEN 'tas.nc' WHEN 2 THEN 'a_fx.nc' WHEN 3 THEN 'a_1-2.txt' ELSE 'var_day_X_' || strftime(l_shipdate, '%Y%m') || '-' || strftime(l_shipdate, '%Y') || '12.nc' END AS filename FROM lineitem)"


@query(f"WITH {NAMES} SELECT *, CASE WHEN contains(filename, '_') AND suffix(filename, '.nc') AND contains(replace(string_split(filename, '_')[-1], '.nc', ''), '-') THEN replace(string_split(filename, '_')[-1], '.nc', '') ELSE 'unknown' END AS date_range FROM names")
def date_range_extract(spark, sf_dir):
    line = F.col("l_linenumber")
    made = F.concat(F.lit("var_day_X_"), F.date_format("l_shipdate", "yyyyMM"), F.lit("-"), F.date_format("l_shipdate", "yyyy"), F.lit("12.nc"))
    name = F.when(line == 1, "tas.nc").when(line == 2, "a_fx.nc").when(line == 3, "a_1-2.txt").otherwise(made)
    named = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", name.alias("filename"))
    return named.withColumn("date_range", assets.date_range(F.col("filename")))


@query("SELECT string_split(url, '.html')[1] AS url FROM pages")
def file_scan_by_service(spark, sf_dir):
    url = F.col("url")
    entries = F.array(F.concat(url, F.lit(".html|application/opendap-html|OPENDAP")), F.concat(url, F.lit("|application/netcdf|HTTPServer")), F.concat(url, F.lit("|application/opendap|OpenDAP")))
    return assets.of_service(table(spark, sf_dir, "pages").select(entries.alias("url")), "opendap")


def archived(spark, sf_dir) -> tuple[str, Callable]:
    """A listing of the files of pages, as a service answers it, by scheme and whole: a document of 64 files for each page, in
    the shared folder. Its path, and what fetches from it."""
    url = F.col("url")
    entries = F.array(F.concat(url, F.lit(".html|application/opendap-html|OPENDAP")), F.concat(url, F.lit("|application/netcdf|HTTPServer")))
    docs = table(spark, sf_dir, "pages").select("page_id", F.substring_index(url, "://", 1).alias("scheme"), entries.alias("entries"))
    path, kinds = stage_path(spark, "listing"), [r.scheme for r in docs.select("scheme").distinct().collect()]
    for kind in [None, *kinds]:
        some = numbered(docs if kind is None else docs.where(F.col("scheme") == kind), ["page_id"], "n")
        pages = some.groupBy(F.floor(F.col("n") / 64).alias("page")).agg(F.sort_array(F.collect_list(F.struct("n", "scheme", "entries"))).alias("docs"))
        total = F.lit(some.count()).cast("long").alias("numFound")
        pages.select("page", F.to_json(F.struct(total, F.col("docs"))).alias("body")).repartition("page").write.partitionBy("page").text(f"{path}/scheme={kind or ''}")

    def fetch(asked: dict[str, str], offset: int) -> tuple[int, list]:
        import json

        from pyarrow.fs import FileSelector, FileSystem

        where, base = FileSystem.from_uri(path)
        files = where.get_file_info(FileSelector(f"{base}/scheme={asked.get('scheme', '')}/page={offset // 64}", allow_not_found=True))
        bodies = [where.open_input_file(f.path).read() for f in files if f.base_name.startswith("part-")]
        answer = json.loads(bodies[0]) if bodies else {"numFound": 0, "docs": []}
        return answer["numFound"], [({"scheme": d["scheme"]}, d["entries"]) for d in answer["docs"]]

    return path, fetch


@query("SELECT 'https' AS scheme, string_split(url, '.html')[1] AS url FROM pages WHERE url LIKE 'https://%'")
def file_scan_paged(spark, sf_dir):
    """The files of one scheme, by pages that tasks fetch; the scheme is part of the request."""
    _, fetch = archived(spark, sf_dir)
    return PagedFiles(spark, fetch, ["scheme"], "P").files({"scheme": "https"}).select("scheme", "url")


OFFERED = f"""offered AS (SELECT p_brand, CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN [] ELSE list_sort(list_distinct(list(o_orderpriority))) END AS o_orderpriority, list_sort(list_distinct(list(c_mktsegment))) AS c_mktsegment, CASE WHEN p_brand = 'Brand#13' THEN [NULL] ELSE list_sort(list_distinct(list(r_name))) END AS r_name FROM cat GROUP BY 1),
chosen AS (SELECT p_brand, unnest(o) AS o_orderpriority, c_mktsegment, r_name FROM (SELECT p_brand, CASE WHEN len(o_orderpriority) = 0 THEN ['3-MEDIUM'] ELSE o_orderpriority END AS o, c_mktsegment, r_name FROM offered)),
chosen2 AS (SELECT p_brand, o_orderpriority, unnest(c_mktsegment) AS c_mktsegment, r_name FROM chosen), chosen3 AS (SELECT p_brand, o_orderpriority, c_mktsegment, unnest(r_name) AS r_name FROM chosen2)"""


def offered(lines: DataFrame) -> DataFrame:
    """Two brands offer no priority, for which there is a default; one offers no region, for which there is none."""
    sets = lines.groupBy("p_brand").agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in ("o_orderpriority", "c_mktsegment", "r_name")))
    nothing = F.array().cast("array<string>")
    some = F.when(F.col("p_brand").isin("Brand#11", "Brand#12"), nothing).otherwise(F.col("o_orderpriority"))
    filled = sets.withColumn("o_orderpriority", expand.with_default(some, "3-MEDIUM")).withColumn("r_name", F.when(F.col("p_brand") == "Brand#13", nothing).otherwise(F.col("r_name")))
    return expand.combinations(filled, ["p_brand"], ["o_orderpriority", "c_mktsegment", "r_name"])


@query(f"WITH {CATALOG}, {OFFERED} SELECT * FROM chosen3")
def param_combinations(spark, sf_dir):
    return offered(records(spark, sf_dir))


@query(f"""WITH {CATALOG}, {OFFERED}, files AS (SELECT p_brand, o_orderpriority, c_mktsegment, r_name, count(*) AS n_files FROM cat GROUP BY ALL)
SELECT c.*, n_files FROM chosen3 c JOIN files f ON c.p_brand = f.p_brand AND c.o_orderpriority = f.o_orderpriority AND c.c_mktsegment = f.c_mktsegment AND (c.r_name IS NULL OR c.r_name = f.r_name)""")
def combination_file_join(spark, sf_dir):
    keys = ["p_brand", "o_orderpriority", "c_mktsegment", "r_name"]
    files = staged(records(spark, sf_dir).groupBy(*keys).agg(F.count("*").alias("n_files")), "files")
    return assets.combination_files(offered(files), files, keys, "p_brand")


@query(f"WITH {LINKS}, {LIKED} SELECT filename, node, url, seq FROM links LEFT JOIN liked USING (node) QUALIFY row_number() OVER (PARTITION BY filename ORDER BY coalesce(rank, 3), seq) = 1")
def best_replica_pick(spark, sf_dir):
    found = links(spark, sf_dir)
    liked = [r.node for r in found.groupBy("node").count().orderBy(F.desc("count"), "node").limit(3).collect()]
    return assets.best_replica(found, ["filename"], tuple(liked)).select("filename", "node", "url", "seq")


@query(f"WITH {LINKS} SELECT url, seq, (SELECT 2 * count(*) FROM links) AS initial, (SELECT count(DISTINCT url) FROM links) AS unique_urls FROM links QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1")
def links_dedup_first(spark, sf_dir):
    twice = links(spark, sf_dir, twice=True)
    return assets.dedup_first(twice).select("url", "seq").join(F.broadcast(assets.link_stats(twice)))


@query(f"""WITH {CATALOG}, r AS (SELECT p_brand, l_linenumber = 7 AS seventh, row_number() OVER (PARTITION BY p_brand, l_linenumber = 7 ORDER BY l_orderkey, l_partkey, l_suppkey) AS rank, count(*) OVER (PARTITION BY p_brand, l_linenumber = 7) AS total FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT p_brand, seventh, rank, total FROM r WHERE total <= 500 OR rank <= 10""")
def link_preview_limit(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = lines.select("p_brand", (F.col("l_linenumber") == 7).alias("seventh"), F.struct("l_orderkey", "l_partkey", "l_suppkey").alias("seq"))
    return assets.preview(rows, ["p_brand", "seventh"]).select("p_brand", "seventh", "rank", "total")


def with_params(spark, sf_dir) -> DataFrame:
    url = F.col("url")
    scheme = F.substring_index(url, "://", 1)
    top = F.element_at(F.split(assets.node(url), r"\."), -1)
    pairs = F.create_map(F.lit("scheme"), scheme, F.lit("top"), top, F.lit("project"), F.lit("P"))
    return links(spark, sf_dir).withColumn("params", pairs)


PARAMS = "params AS (SELECT seq, url, filename, node, string_split(url, '://')[1] AS scheme, string_split(node, '.')[-1] AS top, 'P' AS project FROM links)"


@query(f"WITH {LINKS}, {PARAMS}, d AS (SELECT * FROM params QUALIFY count(*) OVER () <= 500 OR row_number() OVER (ORDER BY seq) <= 10), u AS (SELECT unnest(['scheme', 'top', 'project']) AS parameter, unnest([count(DISTINCT scheme), count(DISTINCT top), count(DISTINCT project)]) AS n FROM d) SELECT parameter FROM u WHERE n > 1")
def dynamic_columns(spark, sf_dir):
    shown = assets.preview(with_params(spark, sf_dir).withColumn("all", F.lit(1)), ["all"])
    flat = shown.select(*(F.try_element_at("params", F.lit(p)).alias(p) for p in ("scheme", "top", "project")))
    return spark.createDataFrame([(p,) for p in assets.multi_valued(flat, ["scheme", "top", "project"])], "parameter string")


@query(f"""WITH {LINKS}, {PARAMS} SELECT node, row_number() OVER (PARTITION BY node ORDER BY seq) AS id, filename,
CASE WHEN contains(filename, '_') AND suffix(filename, '.nc') AND contains(replace(string_split(filename, '_')[-1], '.nc', ''), '-') THEN replace(string_split(filename, '_')[-1], '.nc', '') ELSE 'unknown' END AS date_range,
scheme, top, '' AS missing, url FROM params""")
def link_table(spark, sf_dir):
    shown = assets.link_table(with_params(spark, sf_dir).withColumnRenamed("node", "host").withColumn("node", F.col("host")), ["host"], ["scheme", "top", "missing"])
    return shown.drop("host")


FILE_PARAMETERS = ["o_orderpriority", "c_mktsegment", "r_name"]
FILES = """src AS (SELECT * REPLACE (CASE WHEN p_brand = 'Brand#13' THEN 'None' ELSE r_name END AS r_name), 'f_' || (l_suppkey % 40)::VARCHAR || '-e.nc' AS filename, 'n' || l_linenumber::VARCHAR || '.org' AS node FROM cat WHERE p_brand < 'Brand#3' OR l_linenumber = 7),
off AS (SELECT p_brand, CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN ['3-MEDIUM'] ELSE list_sort(list_distinct(list(o_orderpriority))) END AS o, list_sort(list_distinct(list(c_mktsegment))) AS c, list_filter(list_sort(list_distinct(list(r_name))), lambda x: x <> 'None') AS r FROM src GROUP BY 1),
met AS (SELECT src.* REPLACE (CASE WHEN len(r) > 0 THEN r_name END AS r_name), 'http://' || node || '/' || filename AS url, concat_ws('|', filename, CASE WHEN len(o) > 1 THEN o_orderpriority END, CASE WHEN len(c) > 1 THEN c_mktsegment END, CASE WHEN len(r) > 1 THEN r_name END) AS key FROM src JOIN off USING (p_brand)
  WHERE list_contains(o, o_orderpriority) AND list_contains(c, c_mktsegment) AND (len(r) = 0 OR list_contains(r, r_name))),
seqs AS (SELECT *, o_orderpriority || chr(1) || c_mktsegment || chr(1) || coalesce(r_name, '') || chr(1) || url AS seq FROM met),
best AS (SELECT *, min(seq) OVER (PARTITION BY p_brand, key) AS first FROM seqs QUALIFY row_number() OVER (PARTITION BY p_brand, key ORDER BY CASE node WHEN 'n7.org' THEN 0 WHEN 'n3.org' THEN 1 WHEN 'n5.org' THEN 2 ELSE 3 END, seq) = 1),
placed AS (SELECT *, count(*) OVER (PARTITION BY p_brand) AS total, row_number() OVER (PARTITION BY p_brand ORDER BY first) AS id FROM best),
seen AS (SELECT *, total <= 500 OR id <= 10 AS shown FROM placed),
vary AS (SELECT p_brand, count(DISTINCT o_orderpriority) > 1 AS o, count(DISTINCT c_mktsegment) > 1 AS c, count(DISTINCT r_name) > 1 AS r FROM seen WHERE shown GROUP BY 1)"""


@query(f"""WITH {CATALOG}, {FILES} SELECT p_brand, o_orderpriority, c_mktsegment, r_name, filename, node, url, total, shown, CASE WHEN shown THEN id END AS id, replace(string_split(filename, '_')[-1], '.nc', '') AS date_range,
CASE WHEN shown THEN concat_ws(';', CASE WHEN o THEN 'o_orderpriority=' || o_orderpriority END, CASE WHEN c THEN 'c_mktsegment=' || c_mktsegment END, CASE WHEN r THEN 'r_name=' || r_name END) END AS varying FROM seen JOIN vary USING (p_brand)""")
def file_pipeline(spark, sf_dir):
    """The region of one brand is none in all its records: it asks for no region, and no file is lost by that."""
    chosen = records(spark, sf_dir).where("p_brand < 'Brand#3' OR l_linenumber = 7")
    chosen = chosen.withColumn("r_name", F.when(F.col("p_brand") == "Brand#13", "None").otherwise(F.col("r_name")))
    url = F.concat(F.lit("http://n"), F.col("l_linenumber").cast("string"), F.lit(".org/f_"), (F.col("l_suppkey") % 40).cast("string"), F.lit("-e.nc"))
    # Both what is offered and the files come of the same lines, which are read once.
    files = staged(chosen.select(F.col("p_brand").alias("entity"), *FILE_PARAMETERS, url.alias("url")).distinct(), "files")
    lists = profile.offered(files.withColumnRenamed("entity", "p_brand"), SALES, FILE_PARAMETERS)
    some = F.when(F.col("entity").isin("Brand#11", "Brand#12"), F.array().cast("array<string>")).otherwise(F.col("o_orderpriority"))
    lists = lists.withColumn("o_orderpriority", expand.with_default(some, "3-MEDIUM"))
    found = assets.file_links(lists, files, "entity", FILE_PARAMETERS, ("n7.org", "n3.org", "n5.org"))
    varying = F.array_join(F.transform(F.map_entries("varying"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.withColumn("varying", varying).withColumnRenamed("entity", "p_brand").drop("seq")


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '5-LOW') ORDER BY o_orderkey DESC LIMIT 1")
def store_last_match(spark, sf_dir):
    chosen = (F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "5-LOW")
    return assets.last_match(table(spark, sf_dir, "orders"), chosen, "o_orderkey", ["o_orderkey", "o_custkey", "o_orderpriority"])


def distance(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"


def least_vector(spark, sf_dir) -> list[float]:
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").first().embedding


@query(f"WITH q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, {distance('embedding', 'v')} AS score FROM embeddings, q) SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY score, vec_id) AS rank FROM s ORDER BY score, vec_id LIMIT 20")
def vector_topk(spark, sf_dir):
    near = vector.top_k(table(spark, sf_dir, "embeddings"), least_vector(spark, sf_dir))
    return near.select("vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {distance('e.embedding', 'q.embedding')} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 20""")
def vector_topk_per_query(spark, sf_dir):
    store = table(spark, sf_dir, "embeddings")
    asked = store.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vector.top_k_each(store, asked).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def index_of(spark, sf_dir) -> tuple[VectorIndex, DataFrame]:
    """An index of all vectors, with as many probes as its audit asks for, and the queries: ids that 100 divides."""
    store = table(spark, sf_dir, "embeddings")
    asked = store.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return VectorIndex.build(store, stage_path(spark, "vector-index")).tuned(asked), asked


@query()
def vector_index_search(spark, sf_dir):
    """Approximate: the neighbours that the probed cells hold, of which the audit has found 95 % or more."""
    index, asked = index_of(spark, sf_dir)
    return index.search(asked).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(SQL["vector_topk_per_query"])
def vector_index_exact(spark, sf_dir):
    """Exact: a second pass reads the cells that may hold a nearer vector."""
    index, asked = index_of(spark, sf_dir)
    return index.search(asked, exact=True).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


ASKED = "asked AS (SELECT CASE row_number() OVER (ORDER BY vec_id) WHEN 1 THEN 'variable' WHEN 2 THEN 'source' ELSE 'experiment' END AS component, embedding AS query FROM embeddings ORDER BY vec_id LIMIT 3)"


def hits(spark, sf_dir) -> DataFrame:
    store = table(spark, sf_dir, "embeddings")
    first = store.orderBy("vec_id").limit(3).collect()
    asked = spark.createDataFrame([(c, t, r.embedding) for c, t, r in zip(("variable", "source", "experiment"), ("tas", "", "historical"), first)], "component string, text string, query array<float>")
    from tesserae.schema import COMPONENT_FACETS

    return vector.search_components(store, asked, COMPONENT_FACETS)


@query(f"""WITH {ASKED}, s AS (SELECT component, vec_id, {distance('embedding', 'query')} AS score FROM embeddings, asked WHERE component <> 'source')
SELECT component || '_id' AS facet, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY component ORDER BY score, vec_id) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY component ORDER BY score, vec_id) <= 20""")
def split_and_search(spark, sf_dir):
    return hits(spark, sf_dir).select("facet", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {ASKED}, s AS (SELECT component || '_id' AS facet, vec_id, {distance('embedding', 'query')} AS score FROM embeddings, asked WHERE component <> 'source'),
r AS (SELECT facet, vec_id, row_number() OVER (PARTITION BY facet ORDER BY score, vec_id) AS rank FROM s)
SELECT facet, rank, substring(text, 1, 100) AS content FROM r JOIN documents ON doc_id = vec_id WHERE rank <= 5""")
def hit_preview(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    return vector.previewed(hits(spark, sf_dir).join(docs, "vec_id"), "content").select("facet", "rank", "content")


@query(f"""WITH {ASKED}, s AS (SELECT component || '_id' AS facet, vec_id, {distance('embedding', 'query')} AS score FROM embeddings, asked WHERE component <> 'source'),
r AS (SELECT facet, vec_id, row_number() OVER (PARTITION BY facet ORDER BY score, vec_id) AS rank FROM s),
h AS (SELECT facet, 'name' || (vec_id % 7)::VARCHAR AS value, lang || ': ' || source || ': ' || doc_id::VARCHAR AS description, rank FROM r JOIN documents ON doc_id = vec_id WHERE rank <= 20),
d AS (SELECT facet, value, max_by(regexp_replace(description, '^[^\n]*?: ', ''), rank) AS description, 'hit' AS origin FROM h GROUP BY 1, 2)
SELECT * FROM d UNION ALL SELECT 'source_id', n_name, r_name, 'base' FROM nation JOIN region ON n_regionkey = r_regionkey""")
def dynamic_vocabulary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(": ", "lang", "source", F.col("doc_id").cast("string")).alias("description"))
    found = hits(spark, sf_dir).join(docs, F.col("vec_id") == F.col("doc_id")).select("facet", F.concat(F.lit("name"), (F.col("vec_id") % 7).cast("string")).alias("name"), "description", "rank")
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    base = nations.select(F.explode(F.array(F.lit("source_id"), F.lit("variable_id"), F.lit("realm"))).alias("facet"), F.col("n_name").alias("value"), F.col("r_name").alias("description"))
    return vocab.dynamic_vocabulary(found, base, ["variable_id", "source_id", "experiment_id"])


@query("SELECT c_custkey, n_name AS value, coalesce(CASE WHEN r_name <> 'ASIA' THEN r_name END, '') AS description FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def describe_values(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    vocabulary = nations.where("r_name <> 'ASIA'").select(F.col("n_name").alias("value"), F.col("r_name").alias("description"))
    values = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("value"))
    return vocab.described(values, vocabulary, ["value"])


@query(f"WITH {CATALOG}, {LONG} SELECT facet, value, count(*) AS n FROM (SELECT facet, value FROM long UNION ALL SELECT 'p_brand', p_brand FROM cat) WHERE (facet = 'l_returnflag' AND value NOT IN ('A', 'R')) OR (facet = 'l_linestatus' AND value <> 'F') GROUP BY 1, 2")
def domain_violations(spark, sf_dir):
    vocabulary = spark.createDataFrame([("l_returnflag", "A"), ("l_returnflag", "R"), ("l_linestatus", "F")], "facet string, value string")
    return predicates.domain_violations(profile.facet_counts(records(spark, sf_dir), SALES), vocabulary).select("facet", "value", "n")


@query("SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || coalesce(text, '') || chr(10), '' ORDER BY turn) AS history FROM conversations GROUP BY 1")
def chat_history_format(spark, sf_dir):
    return X.history(table(spark, sf_dir, "conversations"))


@query("SELECT user_id, string_agg(event_type, '' ORDER BY event_id) AS said FROM events GROUP BY 1")
def chunk_accumulate(spark, sf_dir):
    return X.joined(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type"), "said")


@query("SELECT event_id, CASE event_id % 3 WHEN 2 THEN '{\"summary\": \"' || event_type || '\"}' ELSE event_type END AS shown FROM events")
def response_shown(spark, sf_dir):
    third, start = F.col("event_id") % 3, F.concat(F.lit('{"summary": "'), "event_type")
    whole = F.concat(start, F.lit('", "full_result": "r"}'))
    response = F.when(third == 0, whole).when(third == 1, F.col("event_type")).otherwise(F.concat(start, F.lit('"}')))
    return table(spark, sf_dir, "events").select("event_id", X.shown(response).alias("shown"))


@query(r"""SELECT conv_id, turn, regexp_replace(replace(replace(replace(replace(lower('User wants ' || text || '  user need X' || chr(9)), 'user want ', ''), 'user wants ', ''), 'user need ', ''), 'user needs ', ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS cleaned FROM conversations""")
def clean_query(spark, sf_dir):
    said = F.concat(F.lit("User wants "), "text", F.lit("  user need X\t"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.clean_query(said).alias("cleaned"))


FENCED = "' Answer: ```json' || chr(10) || props || chr(10) || '```  '"


@query(rf"SELECT event_id, regexp_replace(replace(replace({FENCED}, '```json', ''), '```', ''), '^\s+|\s+$', '', 'g') AS cleaned FROM events")
def json_fence_clean(spark, sf_dir):
    said = F.concat(F.lit(" Answer: ```json\n"), "props", F.lit("\n```  "))
    return table(spark, sf_dir, "events").select("event_id", X.without_fences(said).alias("cleaned"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE props || ' and ' || props END AS found FROM events")
def json_brace_extract(spark, sf_dir):
    said = F.when(F.col("event_id") % 5 == 0, F.lit("none } here {")).otherwise(F.concat(F.lit("text "), "props", F.lit(" and "), "props", F.lit(" tail")))
    return table(spark, sf_dir, "events").select("event_id", X.outermost_braces(said).alias("found"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'ask ' || event_type ELSE event_type END AS variable_query,
CASE WHEN event_id % 3 = 2 THEN 'ask ' || event_type ELSE event_id::VARCHAR END AS source_query, CASE WHEN event_id % 3 = 2 THEN 'ask ' || event_type ELSE '' END AS experiment_query FROM events""")
def split_fallback(spark, sf_dir):
    body = F.concat(F.lit('{"variable_query": "User wants '), "event_type", F.lit('", "source_query": "'), F.col("event_id").cast("string"), F.lit('"}'))
    third = F.col("event_id") % 3
    response = F.when(third == 0, body).when(third == 1, F.concat(F.lit("Here: ```json\n"), body, F.lit("\n``` done"))).otherwise(F.lit("no idea"))
    parts = X.split_parts(response, F.concat(F.lit("ask "), "event_type"))
    return table(spark, sf_dir, "events").select("event_id", parts.alias("p")).select("event_id", "p.*")


@query(f"""WITH {CATALOG} SELECT unnest(['', 'o_orderpriority', 'c_mktsegment', 'l_returnflag']) AS dropped, unnest([
count(*) FILTER (WHERE {WHERE}), count(*) FILTER (WHERE c_mktsegment = 'BUILDING' AND l_returnflag IN ('A', 'N')), count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND l_returnflag IN ('A', 'N')),
count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND c_mktsegment = 'BUILDING')]) AS hits FROM cat""")
def relax_constraints(spark, sf_dir):
    return predicates.relaxed(records(spark, sf_dir), SALES, CONSTRAINTS)


#: No record has the segment, and none the nation and the region: no single constraint can be dropped, but pairs can.
CONFLICTS = {"n_name": ["NATION_0", "NATION_5"], "r_name": "ASIA", "c_mktsegment": "NOWHERE", "o_orderpriority": ["1-URGENT", "2-HIGH"], "l_returnflag": ["A", "N"], "p_name": ["red", "blue"]}
SETS = f"""met AS (SELECT CASE WHEN n_name IN ('NATION_0', 'NATION_5') THEN 1 ELSE 0 END + CASE WHEN r_name = 'ASIA' THEN 2 ELSE 0 END + CASE WHEN c_mktsegment = 'NOWHERE' THEN 4 ELSE 0 END
  + CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 8 ELSE 0 END + CASE WHEN l_returnflag IN ('A', 'N') THEN 16 ELSE 0 END + CASE WHEN list_has_any(p_name, ['red', 'blue']) THEN 32 ELSE 0 END AS mask FROM cat),
sets AS (SELECT k::INT AS kept, (SELECT count(*) FROM met WHERE mask & k::INT = k::INT) AS hits FROM range(64) r(k)),
named AS (SELECT kept, hits, concat_ws(',', {', '.join(f"CASE WHEN kept & {1 << i} = 0 THEN '{n}' END" for i, n in enumerate(CONFLICTS))}) AS dropped FROM sets)"""


@query(f"WITH {CATALOG}, {SETS} SELECT dropped, hits FROM named WHERE hits > 0")
def relax_lattice(spark, sf_dir):
    found = relax.relaxations(records(spark, sf_dir), SALES, CONFLICTS)
    return found.select(F.array_join("dropped", ",").alias("dropped"), "hits")


def minimal_sql(wanted: int) -> str:
    return f"WITH {CATALOG}, {SETS} SELECT dropped, hits FROM named a WHERE hits >= {wanted} AND NOT EXISTS (SELECT 1 FROM sets b WHERE b.hits >= {wanted} AND b.kept <> a.kept AND b.kept & a.kept = a.kept)"


@query(minimal_sql(1))
def relax_minimal(spark, sf_dir):
    found = relax.minimal(records(spark, sf_dir), SALES, CONFLICTS)
    return found.select(F.array_join("dropped", ",").alias("dropped"), "hits")


@query(minimal_sql(400))
def relax_enough(spark, sf_dir):
    found = relax.minimal(records(spark, sf_dir), SALES, CONFLICTS, wanted=400)
    return found.select(F.array_join("dropped", ",").alias("dropped"), "hits")


#: A customer's segment and nation are said in the turns of the conversation of the same number, some of them misspelt.
TALK = """talk AS (SELECT conv_id, turn, role, text || CASE turn % 4 WHEN 0 THEN ' we want ' || lower(CASE conv_id % 3 WHEN 0 THEN substring(c_mktsegment, 1, 3) || substring(c_mktsegment, 5) ELSE c_mktsegment END)
  WHEN 2 THEN ' from ' || n_name || ', ' || CASE conv_id % 5 WHEN 0 THEN 'Econmy' WHEN 1 THEN 'standard' ELSE 'parts' END ELSE '' END AS text
  FROM conversations JOIN customer ON c_custkey = conv_id + 1 JOIN nation ON c_nationkey = n_nationkey),
vocab AS (SELECT DISTINCT 'c_mktsegment' AS facet, c_mktsegment AS value, 'a segment of the market' AS description FROM customer UNION SELECT DISTINCT 'p_type', p_type, NULL FROM part
  UNION SELECT 'n_name', n_name, 'nation of ' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"""
TERMS = "list_distinct(list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> ''))"
GRAMS = "list_distinct(list_transform(range(1, length({0}) + 2), lambda i: substring('  ' || {0} || ' ', i, 3)))"
INDEX = f"""w AS (SELECT facet, value, term, max(w) AS w FROM (SELECT facet, value, unnest({TERMS.format('value')}) AS term, 1.0::DOUBLE AS w FROM vocab UNION ALL SELECT facet, value, unnest({TERMS.format("coalesce(description, '')")}), 0.25 FROM vocab) GROUP BY 1, 2, 3),
rare AS (SELECT term, ln(1 + (SELECT count(*) FROM (SELECT DISTINCT facet, value FROM w))::DOUBLE / count(*)) AS rare FROM w GROUP BY 1),
post AS (SELECT term, facet, value, w * rare / sum(w * rare) OVER (PARTITION BY facet, value) AS part FROM w JOIN rare USING (term)),
grams AS (SELECT term, len({GRAMS.format('term')}) AS size, unnest({GRAMS.format('term')}) AS gram FROM rare)"""
SPELT = f"""dict AS (SELECT DISTINCT word FROM said),
odd AS (SELECT word, len({GRAMS.format('word')}) AS n, unnest({GRAMS.format('word')}) AS gram FROM dict WHERE word NOT IN (SELECT term FROM rare)),
spelt AS (SELECT word, word AS term, 1.0::DOUBLE AS alike FROM dict WHERE word IN (SELECT term FROM rare)
  UNION ALL SELECT word, term, 2 * count(*) / (n + size)::DOUBLE FROM odd JOIN grams USING (gram) GROUP BY word, term, n, size HAVING 2 * count(*) / (n + size)::DOUBLE >= 0.5),
best AS (SELECT conv_id, turn, facet, value, term, max(weight * alike * part) AS s FROM said JOIN spelt USING (word) JOIN post USING (term) GROUP BY ALL),
scored AS (SELECT conv_id, turn, facet, value, round(sum(s), 6) AS score FROM best GROUP BY ALL HAVING round(sum(s), 6) >= 0.5),
top AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, facet ORDER BY score DESC, value) AS rank FROM scored QUALIFY rank <= 3)
SELECT conv_id, turn, facet, string_agg(value, '|' ORDER BY rank) AS "values", max(score) AS score FROM top GROUP BY 1, 2, 3"""


def talk(spark, sf_dir) -> tuple[DataFrame, choose.VocabularyIndex]:
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    segment = F.when(F.col("conv_id") % 3 == 0, F.concat(F.substring("c_mktsegment", 1, 3), F.expr("substring(c_mktsegment, 5)"))).otherwise(F.col("c_mktsegment"))
    kind = F.when(F.col("conv_id") % 5 == 0, "Econmy").when(F.col("conv_id") % 5 == 1, "standard").otherwise("parts")
    more = F.when(F.col("turn") % 4 == 0, F.concat(F.lit(" we want "), F.lower(segment))).when(F.col("turn") % 4 == 2, F.concat(F.lit(" from "), "n_name", F.lit(", "), kind)).otherwise("")
    said = table(spark, sf_dir, "conversations").join(customers, F.col("c_custkey") == F.col("conv_id") + 1).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    places = nations.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    values = customers.select(F.lit("c_mktsegment").alias("facet"), F.col("c_mktsegment").alias("value"), F.lit("a segment of the market").alias("description"))
    values = values.union(table(spark, sf_dir, "part").select(F.lit("p_type"), "p_type", F.lit(None))).union(places.select(F.lit("n_name"), "n_name", F.concat(F.lit("nation of "), "r_name")))
    return said.select("conv_id", "turn", "role", F.concat("text", more).alias("text")), choose.VocabularyIndex.of(values.distinct())


@query(f"""WITH {TALK}, {INDEX}, said AS (SELECT conv_id, turn, unnest({TERMS.format('text')}) AS word, 1.0::DOUBLE AS weight FROM talk WHERE role = 'user'), {SPELT}""")
def value_choice(spark, sf_dir):
    turns, index = talk(spark, sf_dir)
    keys = ["conv_id", "turn"]
    found = index.choose(turns.where("role = 'user'"), keys)
    return found.select(*keys, "facet", F.array_join("values", "|").alias("values"), F.array_max("scores").alias("score"))


@query(f"""WITH {TALK}, {INDEX}, words AS (SELECT conv_id, turn, unnest({TERMS.format('text')}) AS word FROM talk),
said AS (SELECT t.conv_id, t.turn, word, max(0.5 ** (t.turn - w.turn)) AS weight FROM talk t JOIN words w ON t.conv_id = w.conv_id AND t.turn - w.turn BETWEEN 0 AND 2 WHERE t.role = 'user' GROUP BY 1, 2, 3), {SPELT}""")
def value_choice_in_turns(spark, sf_dir):
    """What was said in the two turns before counts too, by a half and a quarter."""
    turns, index = talk(spark, sf_dir)
    found = index.choose_in_turns(turns, F.col("role") == "user")
    return found.select("conv_id", "turn", "facet", F.array_join("values", "|").alias("values"), F.array_max("scores").alias("score"))


def delivered(spark: SparkSession, parts: list[DataFrame], stream: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream has given out after its files came in several deliveries; after each it stopped, and went on from its
    checkpoint."""
    folder, out, checkpoint = (stage_path(spark, f"stream-{n}") for n in ("in", "out", "checkpoint"))
    found = None
    for part in parts:
        part.write.mode("append").parquet(folder)
        found = drained(stream(arriving(spark, folder, part.schema)), out, checkpoint)
    return found


@query("""WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM m)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, nth
HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY FROM events)""")
def stream_sessions(spark, sf_dir):
    """Events come in three deliveries. Every tenth of the last hours of a delivery comes with the next one, late; every
    seventh comes with both. Sessions are those of the whole table up to the last watermark."""
    events = table(spark, sf_dir, "events")
    span = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    cuts = [span.a + (span.b - span.a) * i / 3 for i in (1, 2)]
    ts, late, twice = F.col("ts"), F.col("event_id") % 10 == 0, F.col("event_id") % 7 == 0
    held = [(ts >= c - timedelta(hours=20)) & (ts < c) for c in cuts]
    parts = [
        events.where((ts < cuts[0]) & ~(held[0] & late)),
        events.where(((ts >= cuts[0]) & (ts < cuts[1]) & ~(held[1] & late)) | (held[0] & (late | twice))),
        events.where((ts >= cuts[1]) | (held[1] & (late | twice))),
    ]
    found = delivered(spark, parts, lambda s: sessions(s, "6 hours", "1 day"))
    return found.select("user_id", "started", "ended", "n", F.round("total", 2).alias("total"))


@query("SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations")
def stream_chunks_in_order(spark, sf_dir):
    """Turns come in three deliveries, dealt by a hash, and some in two; each conversation's turns leave once, in order."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    part = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(30))
    parts = [turns.where(part % 3 == i).union(turns.where(part == 3 * i + 4)) for i in range(3)]
    return delivered(spark, parts, lambda s: in_order(s, "conv_id", "turn", ["role", "text"]))


@query(SQL["facet_filter_count"])
def predicate_applied(spark, sf_dir):
    """The same filter from a predicate's text."""
    text = "o_orderpriority == ['1-URGENT', '2-HIGH'] & c_mktsegment == 'BUILDING' & l_returnflag == ['A', 'N'] & p_name == ['blue', 'green', 'large', 'red', 'small']"
    return records(spark, sf_dir).where(predicates.applied(text, SALES)).agg(F.count("*").alias("hit_count"))


@query(SQL["entity_facet_profile"])
def incremental_profile(spark, sf_dir):
    """Three batches, of which one comes twice, one is taken back and comes again, and a fold between them."""
    # Each batch is read several times; the catalogue's joins, and what they broadcast, run once.
    lines = staged(records(spark, sf_dir).select(*SALES.names, "l_orderkey"), "records")
    batch = [lines.where(F.col("l_orderkey") % 3 == i) for i in range(3)]
    store = ProfileStore(spark, stage_path(spark, "profile"), SALES)
    store.apply(batch[0], "a")
    store.apply(batch[1], "b")
    store.fold()
    store.apply(batch[1], "b")
    store.apply(batch[2], "c")
    store.apply(batch[2], "c")
    store.apply(batch[0], "a-back", taken_back=True)
    store.apply(batch[0], "a-again")
    return store.read()


@query("""WITH o AS (SELECT o_orderkey, o_custkey % 150 AS k, TIMESTAMP '2024-01-01' + to_seconds(1080 * date_diff('day', DATE '1995-01-01', o_orderdate::DATE)) AS t FROM orders)
SELECT o_orderkey, t AS asked_at, event_id, ts AS event_at, event_type FROM o ASOF LEFT JOIN events e ON o.k = e.user_id AND o.t >= e.ts""")
def latest_event_of_order(spark, sf_dir):
    """An order's day, laid over the month of the events, and the latest event of its customer's group before."""
    at = F.expr("TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, 0, 0, 1080 * datediff(o_orderdate, DATE '1995-01-01'))")
    asked = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("k"), at.alias("asked_at"))
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").alias("event_at"), "event_type")
    return times.as_of(asked, events, ("k", "user_id"), ("asked_at", "event_at"), ["event_id", "event_at", "event_type"], ["event_id"]).drop("k")


@query("""SELECT a.l_partkey, a.l_orderkey, a.l_linenumber, a.l_shipdate, count(*) AS peers FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey
AND a.l_shipdate >= b.l_shipdate + INTERVAL 1 DAY AND a.l_shipdate < b.l_shipdate + INTERVAL 1 DAY + to_days(b.l_quantity::INT) GROUP BY 1, 2, 3, 4""")
def lines_after_peers(spark, sf_dir):
    """Lines shipped within as many days of another line of their part as that one's quantity."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
    spans = lines.select("l_partkey", F.expr("l_shipdate + INTERVAL 1 DAY").alias("a"), F.expr("l_shipdate + make_dt_interval(1 + CAST(l_quantity AS INT))").alias("b"))
    found = times.in_intervals(lines.drop("l_quantity"), spans, ("l_partkey", "l_partkey"), "l_shipdate", "a", "b")
    return found.groupBy("point").agg(F.count("*").alias("peers")).select("point.*", "peers")


#: Any-of constraints, by name: a facet and its values.
ANY_OF = {"west": ("r_name", ["AMERICA", "EUROPE"]), "urgent": ("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]), "large": ("p_type", ["LARGE", "ECONOMY"]), "open": ("l_linestatus", ["O"]), "reds": ("p_name", ["red", "blue"])}
CUSTOMERS_OFF, RANK_OFF = 0.05, 0.03


@query(f"""WITH {CATALOG} SELECT name, n, true AS n_is_exact, true AS customers_near, true AS median_near, true AS ninth_near FROM (
{' UNION ALL '.join(f"SELECT '{k}' AS name, count(*) AS n FROM cat WHERE {f} IN ({', '.join(repr(v) for v in vs)})" for k, (f, vs) in ANY_OF.items() if f != 'p_name')}
UNION ALL SELECT 'reds', count(*) FROM (SELECT unnest(p_name) AS w FROM cat) WHERE w IN ('red', 'blue'))""")
def facet_sketches(spark, sf_dir):
    """Sketches of two halves of the records, stored and merged, answer each constraint; they are held against the records:
    customers within 5 %, the ranks of the quantiles 0.5 and 0.9 within 3 %."""
    lines = records(spark, sf_dir)
    names = sorted({f for f, _ in ANY_OF.values()})
    halves = [staged(sketches.sketched(lines.where(F.col("l_orderkey") % 2 == i), names, "o_custkey", "l_extendedprice"), "sketches") for i in (0, 1)]
    asked = spark.createDataFrame([(k, f, v) for k, (f, vs) in ANY_OF.items() for v in vs], "name string, facet string, value string")
    found = staged(sketches.any_of(sketches.merged(halves[0].union(halves[1]), ["facet", "value"]), asked, [0.5, 0.9]), "answers")
    # What the records say: a row for each value that a constraint names.
    values = predicates.values_of(lines, names, ["o_custkey", "l_extendedprice"]).join(F.broadcast(asked), ["facet", "value"])
    below = lambda i: F.count_if(F.col("l_extendedprice") <= F.col("quantiles")[i]) / F.count("*")
    exact = values.join(F.broadcast(found.select("name", "quantiles")), "name").groupBy("name").agg(F.count("*").alias("n_exact"), F.count_distinct("o_custkey").alias("customers"), below(0).alias("half"), below(1).alias("ninth"))
    near = lambda a, b, off: F.abs(a - b) <= off
    return found.join(exact, "name").select(
        "name", "n", (F.col("n") == F.col("n_exact")).alias("n_is_exact"), near(F.col("distinct"), F.col("customers"), CUSTOMERS_OFF * F.col("customers")).alias("customers_near"),
        near(F.col("half"), F.lit(0.5), RANK_OFF).alias("median_near"), near(F.col("ninth"), F.lit(0.9), RANK_OFF).alias("ninth_near"),
    )


def walk_sql(rounds: int) -> str:
    out = f"""WITH {CATALOG}, {LONG}, c AS (SELECT entity, facet, value, count(*) AS n FROM long GROUP BY 1, 2, 3),
l AS (SELECT entity, facet, value, n * sum(n) OVER (PARTITION BY facet) / (sum(n) OVER (PARTITION BY entity, facet) * sum(n) OVER (PARTITION BY facet, value))::DOUBLE AS lift FROM c),
g AS (SELECT * FROM l WHERE lift > 1),
s AS MATERIALIZED (SELECT entity, facet, value, lift / sum(lift) OVER (PARTITION BY entity) AS down, lift / sum(lift) OVER (PARTITION BY facet, value) AS up FROM g),
e0 AS (SELECT DISTINCT entity AS start, entity, 1.0::DOUBLE AS p FROM s)"""
    for r in range(rounds):
        out += f""",
v{r} AS MATERIALIZED (SELECT start, facet, value, sum(p * down) AS p FROM e{r} JOIN s USING (entity) GROUP BY 1, 2, 3),
e{r + 1} AS (SELECT start, entity, 0.8 * sum(p * up) AS p FROM v{r} JOIN s USING (facet, value) GROUP BY 1, 2)"""
    return out + f""",
t AS (SELECT start AS entity, facet, value, round(0.2 * sum(p), 9) AS score FROM ({' UNION ALL '.join(f'SELECT * FROM v{r}' for r in range(rounds))}) GROUP BY 1, 2, 3)
SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, facet, value) AS rank FROM t QUALIFY rank <= 5"""


@query(walk_sql(4))
def value_suggestions(spark, sf_dir):
    return related.suggestions(profile.entity_profile(records(spark, sf_dir), SALES))
