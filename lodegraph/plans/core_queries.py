"""Queries of the core operators for the general record problems 3, 4 and 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import hierarchy as H
from lodegraph.operators import keyed_counts as K
from lodegraph.operators import orphan_refs as O
from lodegraph.plans.lineage import parts_for
from lodegraph.sources.tables import month_label, norm_id, table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    symbols = table(spark, d, "symbols")
    return H.find_cycles(H.parent_links(symbols), parts=parts_for(spark, symbols.count(), H.PART_ROWS))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    symbols = table(spark, d, "symbols")
    return H.hierarchy(H.parent_links(symbols), parts=parts_for(spark, symbols.count(), H.PART_ROWS))


def p3_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d)
    below = H.descendants(t).groupBy(F.col("ancestor").alias("id")).agg(F.count(F.lit(1)).alias("n_descendants"))
    return t.join(below, "id", "left").select("id", "root", "depth", F.array_join("path", "/").alias("path"), "on_cycle", F.coalesce("n_descendants", F.lit(0).cast("long")).alias("n_descendants"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.descendants(_tree(spark, d))


def _counts(spark: SparkSession, d: str, member: str | None) -> tuple[DataFrame, int]:
    rel = table(spark, d, "relationships")
    total = rel.count()  # from the footers of the files
    ids = rel.select(norm_id("target_id").alias("target_id"), norm_id("type").alias("type"), norm_id("source_id").alias("source_id"))
    return K.keyed_counts(ids, ["target_id", "type"], member, total), total


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    counts, total = _counts(spark, d, None)
    return K.heavy_keys(counts, total).select("target_id", "type")


def p4_key_counts(spark: SparkSession, d: str) -> DataFrame:
    counts, total = _counts(spark, d, "source_id")
    return counts.select("target_id", "type", F.col("n").alias("n_rows"), F.col("members").alias("n_sources"), (F.col("n") * 100 >= F.lit(total)).alias("heavy"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return O.orphan_references(*(table(spark, d, t) for t in ("symbols", "relationships", "doc_mappings", "index_results")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "seq", "field").distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).groupBy("table_name", "field", "month").agg(F.count(F.lit(1)).alias("n")).select("table_name", "field", month_label("month").alias("month"), "n")


QUERIES = {f.__name__: f for f in (p3_found, p3_hierarchy, p3_descendants, p4_found, p4_key_counts, p6_found, p6_report)}

_CUR = """
raw as (select lower(trim(id, ' \t\r\n')) id, lower(trim(parent, ' \t\r\n')) parent, seq from symbols),
cur as (select id, case when parent <> '' then parent end parent from (
  select *, row_number() over (partition by id order by seq desc) rn from raw where id <> '') where rn = 1),
link as (select c.id, p.id parent from cur c left join cur p on p.id = c.parent)"""

_TREE = f"""with recursive {_CUR},
tree as (
  select id, id root, cast(0 as bigint) depth, id path from link where parent is null
  union all
  select l.id, t.root, t.depth + 1, t.path || '/' || l.id from tree t join link l on l.parent = t.id),
walk as (
  select id start, parent pos, id low, 1 n from link where parent is not null and id not in (select id from tree)
  union all
  select w.start, l.parent, least(w.low, l.id), n + 1 from walk w join link l on l.id = w.pos where w.pos <> w.start and n < 2000)"""

_REL = "select lower(trim(target_id, ' \t\r\n')) target_id, lower(trim(type, ' \t\r\n')) type, lower(trim(source_id, ' \t\r\n')) source_id from relationships"

_ORPHANS = r"""with gone as (
  select started_at, regexp_replace(replace(trim(f, E' \t\r\n'), '\', '/'), '^(\./)+', '') file from (select started_at, unnest(removed_files) f from index_results)),
live as (
  select lower(trim(s.id, E' \t\r\n')) id, s.name, s.indexed_at, min(g.started_at) gone_at
  from symbols s left join gone g on g.file = regexp_replace(replace(trim(s.file, E' \t\r\n'), '\', '/'), '^(\./)+', '') and g.started_at > s.indexed_at
  group by s.id, s.name, s.indexed_at),
spans as (
  select id, name, date_trunc('month', indexed_at at time zone 'UTC') lo, date_trunc('month', gone_at at time zone 'UTC') hi from live),
refs as (
  select 'relationships' table_name, seq, 'source_id' field, lower(trim(source_id, E' \t\r\n')) id, null as name, date_trunc('month', indexed_at at time zone 'UTC') m from relationships where lower(trim(source_id, E' \t\r\n')) not like 'module::%'
  union all select 'relationships', seq, 'target_id', lower(trim(target_id, E' \t\r\n')), null, date_trunc('month', indexed_at at time zone 'UTC') from relationships
  union all select 'doc_mappings', seq, 'symbol_name', null, trim(regexp_replace(trim(symbol_name, E' \t\r\n'), '\(\)$', ''), E' \t\r\n'), date_trunc('month', updated_at at time zone 'UTC') from doc_mappings),
months as (select distinct m from refs),
live_ids as (select distinct id, m from spans join months on m >= lo and (hi is null or m < hi)),
live_names as (select distinct name, m from spans join months on m >= lo and (hi is null or m < hi)),
orphans as (
  select r.* from refs r left join live_ids i on i.id = r.id and i.m = r.m left join live_names n on n.name = r.name and n.m = r.m
  where i.id is null and n.name is null and coalesce(r.id, r.name) <> '' and r.m is not null)"""

SQL = {
    "p3_found": _TREE + " select low cycle_id, start symbol_id from walk where pos = start",
    "p3_hierarchy": _TREE
    + """, rings as (select start id from walk where pos = start),
below as (select a id, count(*) n from (select unnest(string_split(path, '/')) a, id from tree) where a <> id group by 1)
select l.id, t.root, t.depth, t.path, l.id in (select id from rings) on_cycle, coalesce(b.n, 0) n_descendants from link l left join tree t on t.id = l.id left join below b on b.id = l.id""",
    "p3_descendants": _TREE
    + """, steps as (select id, depth, unnest(string_split(path, '/')) ancestor, generate_subscripts(string_split(path, '/'), 1) - 1 pos from tree)
select ancestor, id descendant, depth - pos distance from steps where pos < depth""",
    "p4_found": f"select target_id, type from ({_REL}) group by 1, 2 having count(*) * 100 >= (select count(*) from relationships)",
    "p4_key_counts": f"select target_id, type, count(*) n_rows, count(distinct source_id) n_sources, count(*) * 100 >= (select count(*) from relationships) heavy from ({_REL}) group by 1, 2",
    "p6_found": _ORPHANS + " select distinct table_name, seq, field from orphans",
    "p6_report": _ORPHANS + " select table_name, field, strftime(m, '%Y-%m') as month, count(*) n from orphans group by 1, 2, 3",
}
