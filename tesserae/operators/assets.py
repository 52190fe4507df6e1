"""Files of a catalogue: their addresses, the best copy of each, and tables of links.

Order is always a column (seq), for frames have none of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.operators.numbering import numbered
from tesserae.staging import staged

#: Nodes by preference (fixed values).
PREFERRED_NODES = ("aims3.llnl.gov", "esgf-data1.llnl.gov", "esgf-data2.llnl.gov")
UNKNOWN, PREVIEW_ABOVE, PREVIEW_ROWS = "unknown", 500, 10


def filename(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def node(url: Column) -> Column:
    """The third part of an address that has more than three."""
    parts = F.split(url, "/")
    return F.when(F.size(parts) > 3, F.get(parts, F.lit(2))).otherwise(UNKNOWN)


def date_range(name: Column) -> Column:
    """The last part of name_..._from-to.nc, or unknown."""
    last = F.replace(F.element_at(F.split(name, "_"), -1), F.lit(".nc"), F.lit(""))
    return F.when(name.contains("_") & name.endswith(".nc") & last.contains("-"), last).otherwise(UNKNOWN)


def of_service(files: DataFrame, service: str, urls: str = "url") -> DataFrame:
    """The addresses of files that a service offers, as url, beside the files' other columns; url is what orders them. Entries
    read address|mime|service; the service's name is compared as it stands with the upper-case of what is asked."""
    rest = [c for c in files.columns if c not in (urls, "url")]
    entries = files.select(*rest, F.explode(urls).alias("#entry"))
    parts = F.split("#entry", r"\|")
    wanted = entries.where(F.element_at(parts, -1) == service.upper())
    return wanted.select(*rest, F.substring_index(parts[0], ".html", 1).alias("url"))


def preference(preferred: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.when(F.col("node") == p, F.lit(i)) for i, p in enumerate(preferred)), F.lit(len(preferred)))


def first_by(frame: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each group; the row goes along in one column, so that no name of its own can clash."""
    ranked = frame.select(F.struct("*").alias("row"), F.row_number().over(W.partitionBy(*keys).orderBy(*order)).alias("n"))
    return ranked.where("n = 1").select("row.*")


def best_replica(links: DataFrame, keys: list[str], preferred: tuple[str, ...] = PREFERRED_NODES, seq: str = "seq") -> DataFrame:
    """Of each key the row on the node that is preferred most, else the first."""
    return first_by(links, keys, preference(preferred), F.col(seq))


def multi_valued(links: DataFrame, parameters: list[str]) -> list[str]:
    """Parameters with more than one value among the links: one row reaches the driver."""
    if not parameters:
        return []
    counts = links.agg(*(F.count_distinct(p).alias(p) for p in parameters)).first()
    return [p for p in parameters if counts[p] > 1]


def dedup_first(links: DataFrame, by: str = "url", seq: str = "seq") -> DataFrame:
    """The first row of each url; a frame without that column passes as it is."""
    if by not in links.columns:
        return links
    return first_by(links, [by], seq)


def link_stats(links: DataFrame, by: str = "url") -> DataFrame:
    return links.agg(F.count("*").alias("initial"), F.count_distinct(by).alias("unique_urls"))


def preview(links: DataFrame, group: list[str], seq: str = "seq", above: int = PREVIEW_ABOVE, rows: int = PREVIEW_ROWS) -> DataFrame:
    """What is shown of each group: all, or the first rows of one that is larger; with rank (from 1) and total, which are
    called #rank and #total where the links have such columns themselves.

    The links are written once, for sizes and ranks both need them; sizes come from an aggregate, so that only the rows that
    can be shown are ranked, and no task sorts a group.
    """
    rank, total = (f"#{n}" if n in links.columns else n for n in ("rank", "total"))
    keys = [f"#key{i}" for i in range(len(group))]
    packed = staged(links.select(F.struct("*").alias("#row"), *(F.col(g).alias(k) for g, k in zip(group, keys)), F.col(seq).alias("#seq")), "links")
    sizes = packed.groupBy(*keys).agg(F.count("*").alias(total))
    place = F.row_number().over(W.partitionBy(*keys).orderBy("#seq")).cast("long")
    ranked = packed.withColumn(rank, place).where(F.col(rank) <= above)
    met = reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys), F.lit(True))
    shown = ranked.alias("a").join(sizes.alias("b"), met).where((F.col(total) <= above) | (F.col(rank) <= rows))
    return shown.select("#row.*", rank, total)


def link_table(links: DataFrame, group: list[str], parameters: list[str], seq: str = "seq") -> DataFrame:
    """id (from 1), filename, node, date_range, a column for each parameter ('' if missing), url. Without groups, all links are
    numbered by ranges, so that no task sees all of them."""
    if group:
        number = F.row_number().over(W.partitionBy(*group).orderBy(seq)).cast("long")
    else:
        links, number = numbered(links, [seq], "#id"), F.col("#id") + 1
    cells = [F.coalesce(F.try_element_at("params", F.lit(p)), F.lit("")).alias(p) for p in parameters]
    return links.select(*group, number.alias("id"), "filename", "node", date_range(F.col("filename")).alias("date_range"), *cells, "url")


def last_match(store: DataFrame, condition: Column, seq: str, columns: list[str]) -> DataFrame:
    """The last row that fits, by seq."""
    return store.where(condition).select(F.max_by(F.struct(*columns), seq).alias("r")).where("r IS NOT NULL").select("r.*")


def combination_files(choices: DataFrame, files: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """The files of each combination: a join in place of a lookup for each. A key that a combination has null is not asked
    for; such combinations join by the entity, and the others by all keys. Result: the combination and the files' other
    columns."""
    rest = [c for c in files.columns if c not in (*keys, entity)]
    asked = [k for k in keys if k != entity]
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in asked), F.lit(True))
    full = choices.where(whole).join(files, [entity, *asked]).select(entity, *asked, *rest)
    some = choices.where(~whole).alias("c").join(files.alias("f"), [entity])
    fits = reduce(lambda a, b: a & b, (F.col(f"c.{k}").isNull() | (F.col(f"c.{k}") == F.col(f"f.{k}")) for k in asked), F.lit(True))
    return full.unionByName(some.where(fits).select(entity, *(F.col(f"c.{k}") for k in asked), *rest))


def file_links(offered: DataFrame, files: DataFrame, entity: str, parameters: list[str], preferred: tuple[str, ...] = PREFERRED_NODES, above: int = PREVIEW_ABOVE, rows: int = PREVIEW_ROWS) -> DataFrame:
    """From what each entity offers to its links: its combinations' files, one replica of each, what is shown, and how.

    offered: entity (of one row) and a list of distinct values for each parameter; files: entity, parameters and url. A file
    belongs to a combination if the entity offers each of its values; a parameter for which it offers nothing (an empty list
    or null) is not asked for, so that all files pass it, and is null in their links. No combination is ever made: a file
    meets one at most, so that files join with lists. A file is known by its name and by the parameters that offer several
    values for its entity. Links come in the order of their first replica: by the parameters' values in turn, then by url.
    Result: entity, the parameters, filename, node, url, seq (that order), total (links of the entity), shown (whether the
    link is displayed), id (the place, from 1, of one that is), date_range, and varying: the parameters that have several
    values among the displayed links of the entity, with the link's own. The best replicas are written once, as totals,
    ranks and variation are all made of them.
    """
    names = [f"#{p}" for p in parameters]
    lists = offered.select(entity, *(F.when(F.size(p) > 0, F.col(p)).alias(n) for p, n in zip(parameters, names)))
    met = files.select(entity, *parameters, "url").join(lists, entity)
    met = met.where(reduce(lambda a, b: a & b, (F.col(n).isNull() | F.array_contains(n, F.col(p)) for p, n in zip(parameters, names)), F.lit(True)))
    url = F.col("url")
    key = F.struct(*(F.when(F.size(n) > 1, F.col(p)).alias(p) for p, n in zip(parameters, names)))
    own = [F.when(F.col(n).isNotNull(), F.col(p)).alias(p) for p, n in zip(parameters, names)]
    met = met.select(entity, *own, "url", filename(url).alias("filename"), node(url).alias("node"), key.alias("#key"))
    met = met.withColumn("#seq", F.struct(*parameters, "url"))
    group = W.partitionBy(entity, "filename", "#key")
    best = met.withColumns({"seq": F.min("#seq").over(group), "#n": F.row_number().over(group.orderBy(preference(preferred), "#seq"))}).where(F.col("#n") == 1)
    best = staged(best.select(entity, *parameters, "filename", "node", "url", "seq"), "best-replicas")

    totals = best.groupBy(entity).agg(F.count("*").alias("total"))
    # Only the rows that can be displayed are ranked, so that no task sorts all links of a large entity.
    ranked = best.select(entity, "seq", *parameters, F.row_number().over(W.partitionBy(entity).orderBy("seq")).cast("long").alias("id")).where(F.col("id") <= above)
    shown = staged(ranked.join(totals, entity).where((F.col("total") <= above) | (F.col("id") <= rows)), "displayed")
    several = shown.groupBy(entity).agg(F.array_compact(F.array(*(F.when(F.count_distinct(p) > 1, F.lit(p)) for p in parameters))).alias("#varying"), F.first("total").alias("total"))
    pairs = F.create_map(*(x for p in parameters for x in (F.lit(p), F.col(p))))
    placed = shown.drop("total").join(several.drop("total"), entity).select(entity, "seq", "id", F.map_filter(pairs, lambda k, _: F.array_contains("#varying", k)).alias("varying"))
    out = best.join(several.drop("#varying"), entity).join(placed, [entity, "seq"], "left")
    return out.select(entity, *parameters, "filename", "node", "url", "seq", "total", F.col("id").isNotNull().alias("shown"), "id", date_range(F.col("filename")).alias("date_range"), "varying")
