"""Queries over the code-knowledge tables, each with SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.functions import exprs as X
from lodegraph.operators import changes, coverage, diagrams, documents, graph, patterns, resolution, retrieval, rules, search, trace
from lodegraph.sources import ingest
from lodegraph.sources.tables import current_rows, norm_id, norm_path, table
from lodegraph.streaming import incremental

QUERIES: dict = {}
SQL: dict[str, str] = {}


def S(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Current symbols with the columns asked for; ``parent`` normalised, an empty one null."""
    df = current_rows(table(spark, d, "symbols"), "id", [*cols])
    return df.withColumn("parent", F.nullif(norm_id("parent"), F.lit(""))) if "parent" in cols else df


def R(spark: SparkSession, d: str) -> DataFrame:
    """Distinct normalised edges."""
    return table(spark, d, "relationships").select(*[norm_id(c).alias(c) for c in ("source_id", "target_id", "type")]).distinct()


def M(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_mappings").groupBy("symbol_name", "doc_path").agg(F.max_by("section", "seq").alias("section"), F.max("seq").alias("seq"))


_S = "s as (select * exclude (rn) replace (nullif(lower(trim(parent, E' \\t\\r\\n')), '') as parent) from (select *, row_number() over (partition by id order by seq desc) rn from symbols) where rn = 1)"
_R = "r as (select distinct lower(trim(source_id, E' \\t\\r\\n')) source_id, lower(trim(target_id, E' \\t\\r\\n')) target_id, lower(trim(type, E' \\t\\r\\n')) as type from relationships)"
_M = "m as (select symbol_name, doc_path, max(seq) seq, arg_max(section, seq) section from doc_mappings group by 1, 2)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# -- lookups -----------------------------------------------------------------------------------


@query(f"with {_S} select id, name, file, start_line from s where (name ilike '%ledger%' or qualified_name ilike '%ledger%' or file ilike '%ledger%' or summary ilike '%ledger%') and kind = 'method' order by file, start_line, id limit 20")
def symbol_search(spark, d):
    return search.search(S(spark, d, "name", "qualified_name", "file", "summary", "kind", "layer", "start_line"), "ledger", "method").select("id", "name", "file", "start_line")


@query(f"with {_S} select id, kind, file from s where id in (select lower(trim(symbol_id, E' \\t\\r\\n')) from rag_chunks)")
def find_by_ids(spark, d):
    return search.by_ids(S(spark, d, "kind", "file"), table(spark, d, "rag_chunks").select(norm_id("symbol_id").alias("id")).where("id is not null")).select("id", "kind", "file")


@query(f"with {_S} select file, id, start_line, 'L' || start_line || '-' || end_line || ' [' || kind || '] ' || name || case when signature <> '' then ': ' || signature else '' end || case when summary <> '' then ' // ' || summary else '' end line from s")
def file_outline(spark, d):
    return search.outline(S(spark, d, "file", "start_line", "end_line", "kind", "name", "signature", "summary"))


@query(f"with {_S} select id, name, file from s where deprecated")
def deprecated_symbols(spark, d):
    return S(spark, d, "name", "file", "deprecated").where("deprecated").select("id", "name", "file")


@query(f"with {_S} select p.id parent, count(*) n_children, count(*) filter (c.kind = 'method') n_methods from s p join s c on c.parent = p.id group by 1")
def children_counts(spark, d):
    s = S(spark, d, "parent", "kind")
    kids = s.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("kind") == "method").alias("n_methods"))
    return kids.join(s.select(F.col("id").alias("parent")), "parent", "left_semi")


@query("select distinct id, substr(sha256(file || '::' || name || '::' || kind), 1, 16) computed from symbols")
def symbol_ids(spark, d):
    return table(spark, d, "symbols").select("id", X.symbol_id("file", "name", "kind").alias("computed")).distinct()


_LAYER = "case " + " ".join(f"when regexp_matches(file || ' ' || name, '(?i){w}') then '{k}'" for k, w in X.LAYER_WORDS) + " end"


@query(f"with {_S} select id, {_LAYER} detected, layer from s")
def detected_layers(spark, d):
    return S(spark, d, "file", "name", "layer").select("id", X.layer_of("file", "name").alias("detected"), "layer")


@query(f"with {_S} select by_file, said, count(*) n from (select case lower(regexp_extract(file, '\\.([^./]+)$', 1)) when 'ts' then 'typescript' when 'js' then 'javascript' when 'mjs' then 'javascript' when 'py' then 'python' when 'go' then 'go' when 'php' then 'php' end by_file, case lower(trim(language)) when 'ts' then 'typescript' when 'js' then 'javascript' when 'py' then 'python' when 'golang' then 'go' else lower(trim(language)) end said from s) group by 1, 2")
def languages(spark, d):
    return S(spark, d, "file", "language").groupBy(X.language_of("file").alias("by_file"), X.norm_language("language").alias("said")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_S} select id, case when trim(regexp_extract(coalesce(signature, ''), '\\(([^)]*)\\)', 1)) = '' then 0 else len(string_split(regexp_extract(signature, '\\(([^)]*)\\)', 1), ',')) end n_params from s")
def parameter_counts(spark, d):
    return S(spark, d, "signature").select("id", X.parameter_count("signature").cast("long").alias("n_params"))


# -- graph -------------------------------------------------------------------------------------


@query("select lower(trim(source_id, E' \\t\\r\\n')) source_id, lower(trim(target_id, E' \\t\\r\\n')) target_id, arg_max(lower(trim(type, E' \\t\\r\\n')), seq) as type from relationships group by 1, 2")
def last_edge_type(spark, d):
    return graph.last_edge(table(spark, d, "relationships").select(*[norm_id(c).alias(c) for c in ("source_id", "target_id", "type")], "seq"))


@query(f"with recursive {_S}, {_R}, w as (select id, 0 depth from s where kind = 'repository' union select r.source_id, depth + 1 from w join r on r.target_id = w.id where depth < 3) select id, min(depth) depth from w group by 1 having min(depth) > 0")
def impact_radius(spark, d):
    return graph.impact_radius(R(spark, d), S(spark, d, "kind").where("kind = 'repository'"), 3)


@query(f"with {_S}, {_R}, e as (select source_id a, target_id b from r union select target_id, source_id from r), q as (select id from s where kind = 'controller') select distinct b id, 1 depth from e where a in (select id from q) and b not in (select id from q)")
def khop_undirected(spark, d):
    return graph.neighbourhood(R(spark, d), S(spark, d, "kind").where("kind = 'controller'"), 1)


@query(f"with recursive {_S}, {_R}, w as (select id, 0 depth from s where kind = 'repository' union select r.source_id, depth + 1 from w join r on r.target_id = w.id where depth < 3), x as (select id, min(depth) depth from w group by 1 having min(depth) > 0) select coalesce(s.layer, 'unknown') layer, x.depth, count(*) n from x join s on s.id = x.id group by 1, 2")
def impact_by_layer(spark, d):
    s = S(spark, d, "kind", "layer")
    hit = graph.impact_radius(R(spark, d), s.where("kind = 'repository'"), 3)
    return hit.join(s.select("id", "layer"), "id").groupBy(F.coalesce("layer", F.lit("unknown")).alias("layer"), "depth").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_S}, {_R} select r.source_id, r.target_id, r.type, coalesce(a.name, r.source_id) source, coalesce(b.name, r.target_id) target from r left join s a on a.id = r.source_id left join s b on b.id = r.target_id")
def edge_labels(spark, d):
    return graph.labelled(R(spark, d), S(spark, d, "name"))


@query(f"with {_S}, {_R} select a.file source_file, b.file target_file, count(*) n from r join s a on a.id = r.source_id join s b on b.id = r.target_id where a.file <> b.file group by 1, 2")
def file_dependencies(spark, d):
    e = graph.endpoints(R(spark, d), S(spark, d, "file"), ["file"]).where("s_file <> t_file")
    return e.groupBy(F.col("s_file").alias("source_file"), F.col("t_file").alias("target_file")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_S}, {_R} select split_part(a.file, '/', 1) source_dir, split_part(b.file, '/', 1) target_dir, count(*) n from r join s a on a.id = r.source_id join s b on b.id = r.target_id where split_part(a.file, '/', 1) <> split_part(b.file, '/', 1) group by 1, 2")
def cross_dir_edges(spark, d):
    top = lambda c: F.substring_index(c, "/", 1)
    return graph.endpoints(R(spark, d), S(spark, d, "file"), ["file"]).where(top("s_file") != top("t_file")).groupBy(top("s_file").alias("source_dir"), top("t_file").alias("target_dir")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_S}, {_R}, e as (select coalesce(a.layer, 'application') x, coalesce(b.layer, 'application') y from r join s a on a.id = r.source_id join s b on b.id = r.target_id) select x source_layer, y target_layer, count(*) n from e where x <> y group by 1, 2")
def cross_layer_edges(spark, d):
    lay = lambda c: F.coalesce(c, F.lit("application"))
    return graph.endpoints(R(spark, d), S(spark, d, "layer"), ["layer"]).select(lay("s_layer").alias("source_layer"), lay("t_layer").alias("target_layer")).where("source_layer <> target_layer").groupBy("source_layer", "target_layer").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_S}, {_R}, e as (select a.layer, r.source_id, r.target_id, r.type, row_number() over (partition by a.layer order by r.source_id, r.target_id, r.type) n from r join s a on a.id = r.source_id join s b on b.id = r.target_id where a.layer = b.layer) select layer, source_id, target_id, type from e where n <= 100")
def intra_layer_edges(spark, d):
    e = graph.endpoints(R(spark, d), S(spark, d, "layer"), ["layer"]).where("s_layer = t_layer")
    w = Window.partitionBy("s_layer").orderBy("source_id", "target_id", "type")
    return e.withColumn("n", F.row_number().over(w)).where("n <= 100").select(F.col("s_layer").alias("layer"), "source_id", "target_id", "type")


@query(f"with {_S}, {_R}, t as (select target_id id, count(*) n from r group by 1) select t.id, s.name, n in_degree from t join s on s.id = t.id order by n desc, t.id limit 10")
def in_degree_top10(spark, d):
    t = R(spark, d).groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return t.join(S(spark, d, "name"), "id").select("id", "name", "in_degree").orderBy(F.desc("in_degree"), "id").limit(10)


@query(f"with {_S}, {_R}, t as (select id, count(*) n from (select unnest([source_id, target_id]) id from r) group by 1), k as (select t.id from t join s on s.id = t.id order by n desc, t.id limit 30) select r.* from r where source_id in (select id from k) and target_id in (select id from k)")
def degree_top30_induced(spark, d):
    e = R(spark, d)
    k = graph.degrees(e).join(S(spark, d), "id", "left_semi").orderBy(F.desc("degree"), "id").limit(30)
    return graph.induced(e, k).select("source_id", "target_id", "type")


@query(f"with {_S}, e as (select id source_id, sym_extends target_id, 'inherits' as type from s where sym_extends <> '' union all select id, unnest(sym_implements), 'implements' from s union all select id, unnest(sym_references), 'uses' from s) select type, count(*) n, count(distinct target_id) n_targets from e where target_id is not null group by 1")
def rebuilt_edge_counts(spark, d):
    e = graph.rebuilt_edges(S(spark, d, "sym_extends", "sym_implements", "sym_references"))
    return e.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("target_id").alias("n_targets"))


@query("with q as (select lower(trim(source_id, E' \\t\\r\\n')) a, lower(trim(target_id, E' \\t\\r\\n')) b, min(seq) q from relationships group by 1, 2) select a id, 'out' side, b other, q \"first\" from q union all select b, 'in', a, q from q")
def collected_references(spark, d):
    return resolution.references(table(spark, d, "relationships").select(norm_id("source_id").alias("source_id"), norm_id("target_id").alias("target_id"), "seq"))


# -- figures -----------------------------------------------------------------------------------


@query(f"with {_S} select kind, count(*) n from s group by 1")
def kind_counts(spark, d):
    return S(spark, d, "kind").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_S} select coalesce(layer, 'unknown') layer, count(*) n from s group by 1")
def layer_counts(spark, d):
    return S(spark, d, "layer").groupBy(F.coalesce("layer", F.lit("unknown")).alias("layer")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_R} select type, count(*) n from r group by 1")
def edge_type_counts(spark, d):
    return R(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_S}, g as (select split_part(file, '/', 1) dir, kind, count(*) n from s group by 1, 2), f as (select split_part(file, '/', 1) dir, count(distinct file) n_files from s group by 1), k as (select *, row_number() over (partition by dir order by n desc, kind) rank from g) select k.dir, kind, n, rank, n_files from k join f on f.dir = k.dir where rank <= 5")
def dir_kind_top5(spark, d):
    s = S(spark, d, "file", "kind").withColumn("dir", F.substring_index("file", "/", 1))
    g = s.groupBy("dir", "kind").agg(F.count(F.lit(1)).alias("n"))
    k = g.withColumn("rank", F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("n"), "kind")).cast("long")).where("rank <= 5")
    return k.join(s.groupBy("dir").agg(F.countDistinct("file").alias("n_files")), "dir")


@query(f"with {_S}, f as (select string_split(file, '/') p, count(*) n from s group by 1), x as (select array_to_string(p[1:i], '/') prefix, i depth, n from (select p, n, unnest(range(1, len(p) + 1)) i from f)) select prefix, depth, sum(n)::bigint n from x group by 1, 2")
def path_rollup(spark, d):
    f = S(spark, d, "file").groupBy("file").agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.split("file", "/"))
    x = f.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.struct(F.array_join(F.slice("p", F.lit(1), i), "/").alias("prefix"), i.cast("long").alias("depth")))).alias("x"))
    return x.groupBy("x.prefix", "x.depth").agg(F.sum("n").alias("n"))


@query(f"with {_S} select count(*) total, count(metrics) n_metrics, count(*) filter (metrics.cyclomaticComplexity > 10) n_complex, count(*) filter (doc_ref is null) n_without_doc, round(avg(metrics.cyclomaticComplexity), 6) avg_complexity, round(sum(metrics.cyclomaticComplexity) / count(*), 6) avg_over_all from s")
def complexity_stats(spark, d):
    c = F.col("metrics.cyclomaticComplexity")
    return S(spark, d, "metrics", "doc_ref").agg(F.count(F.lit(1)).alias("total"), F.count("metrics").alias("n_metrics"), F.count_if(c > 10).alias("n_complex"), F.count_if(F.col("doc_ref").isNull()).alias("n_without_doc"), F.round(F.avg(c), 6).alias("avg_complexity"), F.round(F.sum(c) / F.count(F.lit(1)), 6).alias("avg_over_all"))


@query(f"with {_S} select id, name, metrics.cyclomaticComplexity complexity from s where metrics.cyclomaticComplexity > 0 order by complexity desc, id limit 10")
def complexity_top10(spark, d):
    return S(spark, d, "name", "metrics").select("id", "name", F.col("metrics.cyclomaticComplexity").alias("complexity")).where("complexity > 0").orderBy(F.desc("complexity"), "id").limit(10)


@query(f"with {_S} select id, name, coalesce(metrics.linesOfCode, end_line - start_line + 1) loc from s order by loc desc, id limit 5")
def longest_top5(spark, d):
    return S(spark, d, "name", "metrics", "start_line", "end_line").select("id", "name", X.lines_of_code().alias("loc")).orderBy(F.desc("loc"), "id").limit(5)


@query(f"with {_S}, f as (select metrics.testCoverage.coveragePercent p from s) select count(*) total, count(*) filter (p >= 80) high, count(*) filter (p >= 50 and p < 80) medium, count(*) filter (p > 0 and p < 50) low, count(*) filter (p = 0) none, round(avg(p), 4) average from f")
def coverage_buckets(spark, d):
    return coverage.buckets(S(spark, d, "metrics"))


@query(f"with {_S} select file, round(avg(metrics.testCoverage.coveragePercent), 4) average from s where metrics.testCoverage.coveragePercent is not null group by 1")
def coverage_by_file(spark, d):
    return S(spark, d, "file", "metrics").where("metrics.testCoverage.coveragePercent is not null").groupBy("file").agg(F.round(F.avg("metrics.testCoverage.coveragePercent"), 4).alias("average"))


@query(f"with {_S} select 'kind' facet, kind as value, count(*) n from s group by 2 union all select 'tag', t, count(*) from (select unnest(tags) t from s) group by 2 union all select 'dir', split_part(file, '/', 1), count(*) from s group by 2")
def search_facets(spark, d):
    s = S(spark, d, "kind", "tags", "file")
    values = s.select(F.explode(F.concat(F.array(F.struct(F.lit("kind").alias("facet"), F.col("kind").alias("value")), F.struct(F.lit("dir").alias("facet"), F.substring_index("file", "/", 1).alias("value"))), F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.struct(F.lit("tag").alias("facet"), t.alias("value"))))).alias("v"))
    return values.groupBy("v.facet", "v.value").agg(F.count(F.lit(1)).alias("n"))


@query("with e as (select x.error msg, x.file from (select unnest(errors) x from index_results)) select msg, count(*) n, string_agg(file, ',' order by file) filter (k <= 5) files from (select *, row_number() over (partition by msg order by file) k from e) group by 1")
def index_error_groups(spark, d):
    """Counts per message, and its first five files: the limit works before the shuffle, so a frequent message costs no more."""
    e = table(spark, d, "index_results").select(F.explode("errors").alias("e")).select(F.col("e.error").alias("msg"), F.col("e.file").alias("file"))
    few = e.withColumn("k", F.row_number().over(Window.partitionBy("msg").orderBy("file"))).where("k <= 5").groupBy("msg").agg(F.array_join(F.array_sort(F.collect_list("file")), ",").alias("files"))
    return e.groupBy("msg").agg(F.count(F.lit(1)).alias("n")).join(few, "msg", "left")


@query(f"with {_S}, {_R}, {_M}, x as (select 'symbols' metric, count(*)::double as value from s union all select 'edges', count(*) from r union all select 'documented', count(*) from m union all select 'files', count(distinct file) from s union all select 'patterned', count(pattern) from s union all select 'deprecated', count(*) filter (deprecated) from s) select * from x union all select 'edges_per_symbol', round((select count(*) from r) / (select count(*) from s), 6) union all select 'doc_rows_percent', round(100.0 * (select count(*) from m) / (select count(*) from s), 6)")
def project_status(spark, d):
    s = S(spark, d, "file", "pattern", "deprecated").agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("file").alias("files"), F.count("pattern").alias("patterned"), F.count_if("deprecated").alias("deprecated"), F.lit(1).alias("one"))
    j = s.join(R(spark, d).agg(F.count(F.lit(1)).alias("edges"), F.lit(1).alias("one")), "one").join(M(spark, d).agg(F.count(F.lit(1)).alias("documented"), F.lit(1).alias("one")), "one")
    ratio = lambda a, b, f: F.coalesce(F.round(F.try_divide(F.lit(f) * F.col(a), F.col(b)), 6), F.lit(0.0))
    j = j.withColumn("edges_per_symbol", ratio("edges", "symbols", 1.0)).withColumn("doc_rows_percent", ratio("documented", "symbols", 100.0))
    return j.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in ("symbols", "edges", "documented", "files", "patterned", "deprecated", "edges_per_symbol", "doc_rows_percent")])).alias("x")).select("x.*")


# -- rules -------------------------------------------------------------------------------------


@query(f"with {_S}, {_R} select s.id, s.name, s.file from s where parent is null and exported is distinct from false and kind in ('function', 'method', 'class', 'abstract_class', 'constructor', 'getter', 'setter', 'event', 'service') and not contains(file, 'tests/') and not contains(file, '/fixtures/') and not contains(file, 'site/shared') and not exists (select 1 from r where r.target_id = s.id) and not exists (select 1 from s c where c.parent = s.id)")
def dead_code(spark, d):
    return rules.dead_code(S(spark, d, "name", "file", "parent", "exported", "kind"), R(spark, d))


@query(f"with {_S}, {_M} select symbol_name, doc_path from m where symbol_name not in (select name from s) and symbol_name not in (select id from s)")
def orphan_docs(spark, d):
    return rules.orphan_docs(M(spark, d), S(spark, d, "name"))


def _rule(spark, d, rule: rules.Rule) -> DataFrame:
    return rules.violations([rule], S(spark, d, *rules.SYMBOL_COLUMNS[1:]), R(spark, d))


@query(f"with {_S}, {_R} select 'domain-stays-clean' rule, a.file, a.id symbol_id, '''' || a.name || ''' in ' || a.file || ' depends on ''' || b.name || ''' in forbidden layer ' || b.file message, 'error' severity from r join s a on a.id = r.source_id join s b on b.id = r.target_id where regexp_matches(a.file, '^.*/domain/.*$') and (regexp_matches(b.file, '^.*/infra/.*$') or regexp_matches(b.file, '^.*/http/.*$')) and not regexp_matches(a.file, '^[^/]*-web/.*$')")
def layer_boundary(spark, d):
    return _rule(spark, d, rules.Rule("domain-stays-clean", "layer_boundary", {"source": "**/domain/**", "forbidden": ["**/infra/**", "**/http/**"], "ignore": ["*-web/**"]}))


@query(f"with {_S}, {_R} select 'no-registries' rule, a.file, a.id symbol_id, '''' || a.name || ''' uses forbidden dependency ''' || b.name || '''' message, 'error' severity from r join s a on a.id = r.source_id join s b on b.id = r.target_id where regexp_matches(a.file, '^.*/application/.*$') and (regexp_matches(b.file, '^.*/vendor/.*$') or regexp_matches(b.name, '^[^/]*Registry$'))")
def forbidden_import(spark, d):
    return _rule(spark, d, rules.Rule("no-registries", "forbidden_import", {"scope": "**/application/**", "forbidden": ["**/vendor/**", "*Registry"]}))


@query(f"with {_S}, q as (select *, coalesce(nullif(qualified_name, ''), name) q from s), g as (select *, case when regexp_matches(q, '[\\\\/]') then regexp_extract(q, '[^\\\\/]*$') else q end seg from q), h as (select *, case when regexp_matches(seg, '\\.|::') and regexp_extract(seg, '[^.:]*$') <> '' then regexp_extract(seg, '[^.:]*$') else seg end short from g) select 'method-camel-case' rule, file, id symbol_id, '''' || name || ''' does not match naming convention /^[a-z][a-zA-Z0-9]*$/' message, 'warning' severity from h where kind = 'method' and not regexp_matches(short, '^[a-z][a-zA-Z0-9]*$')")
def naming_convention(spark, d):
    return _rule(spark, d, rules.Rule("method-camel-case", "naming_convention", {"kind": "method", "pattern": "^[a-z][a-zA-Z0-9]*$"}))


def _limit_sql(name: str, metric: str, most: int, before: str, after: str) -> str:
    text = f"concat(chr(39), name, chr(39), ' {before}', {metric}, '{after} (max {most})')"
    return f"with {_S} select '{name}' rule, file, id symbol_id, {text} message, 'warning' severity from s where {metric} > {most}"


@query(_limit_sql("max-complexity", "metrics.cyclomaticComplexity", 4, "has cyclomatic complexity ", ""))
def max_complexity(spark, d):
    return _rule(spark, d, rules.Rule("max-complexity", "max_complexity", {"max": 4}))


@query(_limit_sql("max-parameters", "metrics.parameterCount", 2, "has ", " parameters"))
def max_parameters(spark, d):
    return _rule(spark, d, rules.Rule("max-parameters", "max_parameters", {"max": 2}))


@query(_limit_sql("max-lines", "coalesce(metrics.linesOfCode, end_line - start_line + 1)", 80, "has ", " lines"))
def max_lines(spark, d):
    return _rule(spark, d, rules.Rule("max-lines", "max_lines", {}))


@query(f"with {_S}, t as (select *, regexp_matches(coalesce(signature, ''), '\\)\\s*([:\\s].*)?$') m, trim(regexp_extract(coalesce(signature, ''), '\\)\\s*([:\\s].*)?$', 1)) tail from s where kind in ('method', 'function', 'constructor') and coalesce(visibility, '') in ('', 'public')) select 'missing-return-type' rule, file, id symbol_id, '''' || name || ''' has no declared return type' message, 'warning' severity from t where not (m and tail <> '' and not regexp_matches(tail, '^\\s*[{{\\[]?\\s*$'))")
def missing_return_type(spark, d):
    return _rule(spark, d, rules.Rule("missing-return-type", "missing_return_type", {"scope": "public"}))


@query(f"with {_S}, {_R}, e as (select distinct source_id, target_id from r) select a.layer source_layer, b.layer target_layer, count(*) n from e join s a on a.id = e.source_id join s b on b.id = e.target_id where a.layer <> b.layer and not (a.layer = 'application' and b.layer = 'domain') and not (a.layer = 'infrastructure') group by 1, 2")
def layer_matrix(spark, d):
    return rules.layer_matrix(S(spark, d, "layer"), R(spark, d), {"application": ["domain"], "infrastructure": ["domain", "application", "presentation", "test"]})


# -- patterns and events -----------------------------------------------------------------------


def _flat(df: DataFrame) -> DataFrame:
    return df.select("primary", "member", F.round("confidence", 4).alias("confidence"), F.array_join("violations", "; ").alias("violations"))


_KINDS = {"event_kinds": ("model",), "listener_kinds": ("listener", "handler"), "interface_kinds": ("service", "provider"), "entity_kinds": ("model",)}


def _P(spark, d):
    return S(spark, d, "name", "kind", "parent", "visibility", "sym_implements", "seq")


@query(f"select \"primary\", unnest(string_split(members, ',')) member, confidence, violations from (with {_S}, {_R}, ev as (select id, name, lower(regexp_replace(name, 'Events?$', '')) base from s where kind = 'model'), li as (select id, lower(name) n from s where kind in ('listener', 'handler')), e as (select source_id a, target_id b from r union select target_id, source_id from r), x as (select ev.id, li.id l from ev join e on e.a = ev.id join li on li.id = e.b union select ev.id, li.id from ev join li on contains(li.n, ev.base)), g as (select id, string_agg(l, ',' order by l) ls from x group by 1) select ev.id \"primary\", ev.id || coalesce(',' || ls, '') members, case when ls is null then 0.6 else 0.9 end confidence, case when ls is null then 'No listeners found for event ''' || name || '''' else '' end violations from ev left join g on g.id = ev.id)")
def pattern_observer(spark, d):
    return _flat(patterns.observer(_P(spark, d), R(spark, d), _KINDS["event_kinds"], _KINDS["listener_kinds"]))


@query(f"select \"primary\", unnest(string_split(members, ',')) member, confidence, violations from (with {_S}, {_R}, k as (select parent id, id m, id in (select source_id from r where type = 'instantiates') makes from s where kind = 'method' and regexp_matches(name, '^(load|render|resolve|parse)')), g as (select id, string_agg(m, ',' order by m) ms from k group by 1 having bool_or(makes)) select g.id \"primary\", g.id || ',' || ms members, 0.9 confidence, '' violations from g join s on s.id = g.id where s.kind in ('class', 'abstract_class'))")
def pattern_factory(spark, d):
    return _flat(patterns.factory(_P(spark, d), R(spark, d), ("load", "render", "resolve", "parse")))


@query(f"select \"primary\", unnest(string_split(members, ',')) member, confidence, violations from (with {_S}, k as (select parent id, bool_or(kind = 'constructor' and coalesce(visibility = 'private', false)) p, bool_or(name in ('instance', 'getInstance')) i from s where parent is not null group by 1) select s.id \"primary\", s.id members, case when p and i then 0.95 else 0.6 end confidence, case when p and not i then 'Singleton ''' || name || ''' has private constructor but no static instance accessor' when i and not p then 'Singleton ''' || name || ''' has static instance but constructor is not private' else '' end violations from s join k on k.id = s.id where s.kind = 'class' and (p or i))")
def pattern_singleton(spark, d):
    return _flat(patterns.singleton(_P(spark, d)))


@query(f"select \"primary\", unnest(string_split(members, ',')) member, confidence, violations from (with {_S}, {_R}, f as (select id, name, seq from s where kind in ('service', 'provider')), p as (select name, arg_min(id, seq) pid from f group by 1), i as (select distinct f.name, r.source_id member from r join f on f.id = r.target_id join s on s.id = r.source_id where r.type = 'implements'), g as (select name, string_agg(member, ',' order by member) ms from i group by 1 having count(*) >= 2), u as (select distinct f.name from f join r on r.target_id = f.id and r.type = 'uses') select pid \"primary\", pid || ',' || ms members, case when u.name is null then 0.6 else 0.85 end confidence, case when u.name is null then 'Strategy interface ''' || g.name || ''' has no detected consumer using it' else '' end violations from g join p on p.name = g.name left join u on u.name = g.name)")
def pattern_strategy(spark, d):
    """What the ``implements`` edges say takes the place of the array column, which the data leaves mostly empty."""
    e, sy = R(spark, d), _P(spark, d)
    said = e.where("type = 'implements'").select(F.col("source_id").alias("member"), F.col("target_id").alias("key")).join(sy.select(F.col("id").alias("member")), "member", "left_semi")
    return _flat(patterns.strategy(sy, e, _KINDS["interface_kinds"], said))


@query(f"select \"primary\", unnest(string_split(members, ',')) member, confidence, violations from (with {_S}, {_R}, p as (select * from s where kind = 'repository' or (kind = 'class' and regexp_matches(name, '(?i)Repository$'))), k as (select parent id, string_agg(id, ',' order by id) ms from s where kind = 'method' and regexp_matches(lower(name), '^(find|save|delete|update|get|remove|create)') group by 1), h as (select distinct source_id id from r join s on s.id = r.target_id and s.kind = 'model' where type in ('uses', 'instantiates')) select p.id \"primary\", p.id || coalesce(',' || ms, '') members, round((case when ms is null then 0 else 4 end + case when h.id is null then 0 else 3 end + case when kind = 'repository' then 3 else 1 end) / 10, 4) confidence, concat_ws('; ', case when ms is null then 'Repository ''' || name || ''' has no standard CRUD methods' end, case when h.id is null then 'Repository ''' || name || ''' has no associated entity' end) violations from p left join k on k.id = p.id left join h on h.id = p.id)")
def pattern_repository(spark, d):
    return _flat(patterns.repository(_P(spark, d), R(spark, d), _KINDS["entity_kinds"]))


@query()
def pattern_annotation(spark, d):
    s = _P(spark, d)
    return patterns.annotated(s, patterns.all_patterns(s, R(spark, d), **_KINDS))


@query(f"with {_S}, {_R}, ev as (select id, lower(regexp_replace(name, 'Event$', '')) base from s where kind = 'model'), li as (select id l, lower(regexp_replace(name, '(Listener|Handler|Subscriber)$', '')) base from s where kind in ('listener', 'handler')), sd as (select source_id l, target_id id from r union select target_id, source_id from r), x as (select distinct r.target_id id, 'emitter' as role, r.source_id symbol_id from r join ev on ev.id = r.target_id where type in ('uses', 'instantiates') and source_id in (select id from s where kind not in ('listener', 'handler')) union select sd.id, 'listener', sd.l from sd join ev on ev.id = sd.id where l in (select l from li) union select ev.id, 'listener', li.l from ev join li on li.base = ev.base and ev.base <> ''), c as (select id, count(distinct role) = 2 complete from x group by 1) select x.id, role, symbol_id, complete from x join c on c.id = x.id union all select id, 'none', null, false from ev where id not in (select id from x)")
def event_flow(spark, d):
    return patterns.event_flow(S(spark, d, "name", "kind"), R(spark, d), _KINDS["event_kinds"], _KINDS["listener_kinds"])


# -- changes -----------------------------------------------------------------------------------

_OLD = "o as (select * from (select *, row_number() over (partition by id order by seq) rn from symbols) where rn = 1)"
_DIFF = f"""{_S}, {_OLD}, a as (select name, kind, arg_max(struct_pack(id := id, file := file, sl := start_line, el := end_line, sg := signature), seq) v from o group by 1, 2),
b as (select name, kind, arg_max(struct_pack(id := id, file := file, sl := start_line, el := end_line, sg := signature), seq) v from s group by 1, 2),
j as (select coalesce(a.name, b.name) name, coalesce(a.kind, b.kind) kind, a.v ov, b.v nv from a full join b on a.name = b.name and a.kind = b.kind),
df as (select name, kind, case when ov is null then 'added' when nv is null then 'removed' when ov.sg is not null and nv.sg is not null and ov.sg <> nv.sg then 'signature_changed' when ov.el - ov.sl <> nv.el - nv.sl then 'body_changed' when ov.sl <> nv.sl or ov.el <> nv.el then 'moved' end change, coalesce(nv, ov) v from j)"""


_SNAPSHOT = ("seq", "name", "kind", "file", "start_line", "end_line", "signature")


def _diff(spark, d) -> DataFrame:
    """The first and the current row of every symbol as two snapshots."""
    first = table(spark, d, "symbols").groupBy("id").agg(F.min(F.struct(*_SNAPSHOT)).alias("r")).select("id", "r.*")
    return changes.snapshot_diff(first, S(spark, d, *_SNAPSHOT))


@query(f"with {_DIFF} select name, kind, change, v.id id from df where change is not null")
def snapshot_diff(spark, d):
    return _diff(spark, d).select("name", "kind", "change", "id")


_HUNKS = "h as (select file, start_line idx, start_line + 1 new_start, 3 new_lines, '@@ ' || id content from s)"


def _hunks(spark, d) -> DataFrame:
    """A hunk of three lines for every current symbol; its start gives the order within the file."""
    s = S(spark, d, *_SNAPSHOT)  # the columns of ``_diff``, whose shuffle is used again
    return s.select("file", F.col("start_line").alias("idx"), (F.col("start_line") + 1).alias("new_start"), F.lit(3).alias("new_lines"), F.concat(F.lit("@@ "), "id").alias("content"))


@query(f"with {_DIFF}, {_HUNKS}, t as (select df.name, df.kind, string_agg(h.content, chr(10) order by h.idx, h.content) dd from df join h on h.file = df.v.file where change is not null and h.new_start <= df.v.el and h.new_start + h.new_lines >= df.v.sl group by 1, 2) select df.name, df.kind, change, coalesce(dd, '') diff, change in ('added', 'removed', 'signature_changed') doc_update_required from df left join t on t.name = df.name and t.kind = df.kind where change is not null and (change in ('added', 'removed') or dd is not null)")
def change_impact(spark, d):
    return changes.change_impact(_diff(spark, d), _hunks(spark, d))


@query(f"with {_DIFF}, {_M}, dc as (select doc_path from doc_mappings group by 1 having min(updated_at) < max(updated_at)) select name, kind, change from df where change is not null and name not in (select symbol_name from m where doc_path in (select doc_path from dc))")
def doc_guard(spark, d):
    """A document changed if its mapping rows were updated at more than one time."""
    changed = table(spark, d, "doc_mappings").groupBy("doc_path").agg(F.min("updated_at").alias("a"), F.max("updated_at").alias("b")).where("a < b")
    return changes.doc_guard(_diff(spark, d), M(spark, d), changed).select("name", "kind", "change")


@query("with a as (select path, arg_min(sha256(coalesce(content, '')), seq) h from source_files group by 1), b as (select path, arg_max(sha256(coalesce(content, '')), seq) h from source_files where path not in (select f from (select unnest(removed_files) f from index_results) where f is not null) group by 1) select coalesce(a.path, b.path) path, case when a.path is null then 'added' when b.path is null then 'removed' when a.h = b.h then 'unchanged' else 'changed' end status from a full join b on a.path = b.path")
def incremental_files(spark, d):
    f = table(spark, d, "source_files").select("path", "seq", F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash"))
    gone = table(spark, d, "index_results").select(F.explode("removed_files").alias("path"))
    first = f.groupBy("path").agg(F.min_by("hash", "seq").alias("hash"))
    return changes.incremental(first, f.groupBy("path").agg(F.max_by("hash", "seq").alias("hash")).join(gone, "path", "left_anti"))


# -- coverage, resolution ----------------------------------------------------------------------

_LINES = "ln as (select distinct file, start_line + 1 as line, coalesce(metrics.testCoverage.hitCount, 0) hits from s)"


def _lines(spark, d) -> DataFrame:
    return S(spark, d, "file", "start_line", "metrics").select("file", (F.col("start_line") + 1).alias("line"), F.coalesce("metrics.testCoverage.hitCount", F.lit(0)).alias("hits")).distinct()


@query(f"with {_S}, {_LINES} select s.id, count(*) lines_found, count(*) filter (hits > 0) lines_hit, round(100.0 * count(*) filter (hits > 0) / count(*), 4) \"percent\" from s join ln on ln.file = s.file and ln.line between s.start_line and s.end_line group by 1")
def coverage_range_join(spark, d):
    return coverage.symbol_coverage(S(spark, d, "file", "start_line", "end_line"), _lines(spark, d)).withColumn("percent", F.round("percent", 4))


@query(f"with {_S}, x as (select p.id ref, s.id, row_number() over (partition by p.id order by s.end_line - s.start_line, s.id) n from s p join s on s.file = p.file and p.start_line between s.start_line and s.end_line) select ref, id from x where n = 1")
def enclosing_symbol(spark, d):
    s = S(spark, d, "file", "start_line", "end_line")
    return coverage.enclosing(s, s.select(F.col("id").alias("ref"), "file", F.col("start_line").alias("line")))


@query(f"with {_S}, q as (select name, arg_max(id, seq) id from s group by 1), f as (select id ref, file, coalesce(bounded_context, '') ns, coalesce(qualified_name, name) target from s) select f.ref, coalesce(q1.id, q2.id) id, case when q1.id is not null then 'exact' when q2.id is not null then 'namespace' end how from f left join q q1 on q1.name = f.target left join q q2 on f.ns <> '' and q2.name = f.ns || '\\' || f.target")
def name_resolution(spark, d):
    s = S(spark, d, "file", "name", "qualified_name", "bounded_context", "seq")
    refs = s.select(F.col("id").alias("ref"), "file", F.coalesce("bounded_context", F.lit("")).alias("namespace"), F.coalesce("qualified_name", "name").alias("target"))
    none = s.select("file", F.col("name").alias("alias"), F.col("name").alias("qualified")).where("false")
    return resolution.resolve(refs, s, none)


# -- documents, retrieval ----------------------------------------------------------------------


@query(f"with {_S}, {_M} select id, name, kind from s where name not in (select symbol_name from m where symbol_name is not null)")
def undocumented(spark, d):
    return documents.undocumented(S(spark, d, "name", "kind"), M(spark, d)).select("id", "name", "kind")


@query(f"with {_S}, q as (select symbol_name, arg_max(doc_path, seq) p from doc_mappings group by 1) select s.id, coalesce(q.p, s.doc_ref) doc_ref from s left join q on q.symbol_name = s.name")
def doc_refs(spark, d):
    return documents.with_doc_ref(S(spark, d, "name", "doc_ref"), table(spark, d, "doc_mappings"))


@query("with l as (select doc_id, unnest(string_split(text, chr(10))) t, generate_subscripts(string_split(text, chr(10)), 1) line, len(string_split(text, chr(10))) n from documents), h as (select * from l where regexp_matches(t, '^#{1,6}\\s+\\S')) select doc_id doc, length(regexp_extract(t, '^(#+)', 1)) \"level\", regexp_replace(t, '^#+\\s+', '') heading, line start_line, coalesce(lead(line) over (partition by doc_id order by line) - 1, n) end_line from h")
def section_spans(spark, d):
    return documents.sections(table(spark, d, "documents"))


@query("with l as (select doc_id, unnest(string_split(text, chr(10))) t, generate_subscripts(string_split(text, chr(10)), 1) line from documents), f as (select *, starts_with(t, '```') fence, sum(case when starts_with(t, '```') then 1 else 0 end) over (partition by doc_id order by line) no from l), g as (select doc_id, (no + 1) // 2 block, min(line) a, max(line) z, count(*) filter (fence) k, arg_min(trim(regexp_replace(t, '^```', '')), line) lang, coalesce(string_agg(t, chr(10) order by line) filter (not fence), '') code from f where no % 2 = 1 or fence group by 1, 2) select doc_id doc, a start_line, z end_line, lang \"language\", code from g where k = 2 and trim(code) <> ''")
def fence_blocks(spark, d):
    return documents.fenced_blocks(table(spark, d, "documents"))


@query()
def example_checks(spark, d):
    return documents.checked_examples(documents.fenced_blocks(table(spark, d, "documents")))


@query("with q as (select distinct doc_path path, repo module, source title from documents where doc_path is not null) select path, lag(path) over w previous, lead(path) over w \"next\" from q window w as (partition by module order by title nulls first, path)")
def doc_nav_links(spark, d):
    docs = table(spark, d, "documents").where("doc_path is not null").select(F.col("doc_path").alias("path"), F.col("repo").alias("module"), F.col("source").alias("title")).distinct()
    null = F.lit(None).cast("string")
    return documents.navigation(docs.withColumn("previous", null).withColumn("next", null))


_CHUNKS = r"""w as (select doc_id, text, regexp_split_to_array(text, '[ \t\n\x0b\f\r]+') w from documents where trim(text) <> ''),
st as (select doc_id, text, w, unnest(case when len(w) <= 100 then [0] else list_filter(range(0, len(w), 80), lambda s: s = 0 or s - 80 + 100 < len(w)) end) s from w),
ch as (select cast(doc_id as varchar) source, s // 80 pos, case when len(w) <= 100 then text else array_to_string(w[s + 1 : s + 100], ' ') end content from st)"""


@query(f"with {_CHUNKS}, q as (select substr(sha256(content || '|' || source), 1, 16) hash, pos from ch) select hash, min(pos)::int pos from q group by 1")
def chunk_documents(spark, d):
    return retrieval.chunks(table(spark, d, "documents"), "doc_id", "text", 100, 20).select("hash", "pos")


@query(f"with {_CHUNKS}, q as (select distinct substr(sha256(content || '|' || source), 1, 16) hash from ch) select count(*) n from q where hash not in (select hash from rag_chunks)")
def chunk_dedupe(spark, d):
    found = retrieval.chunks(table(spark, d, "documents"), "doc_id", "text", 100, 20)
    return retrieval.new_chunks(found, table(spark, d, "rag_chunks")).agg(F.count(F.lit(1)).alias("n"))


_QV = [((i * 37) % 17 - 8) / 8 for i in range(64)]


@query(f"with c as (select distinct hash, source, symbol_id, vector from rag_chunks where len(vector) = 64), q as (select hash, source, symbol_id, list_cosine_similarity(vector::double[], {_QV}::double[]) score from c) select hash, source, symbol_id, round(score, 5) score from q where not isnan(score) and score >= 0.05 order by round(score, 5) desc, hash limit 10")
def vector_topk(spark, d):
    store = table(spark, d, "rag_chunks").select("hash", "source", "symbol_id", "vector").distinct()
    return retrieval.top_k(store, _QV, 10, 0.05).withColumn("score", F.round("score", 5))


@query("select doc_id, ceil(length(text) / 4)::bigint tokens from documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", X.token_estimate("text").alias("tokens"))


@query(f"with {_S}, {_R}, {_M}, o as (select r.source_id id, string_agg(distinct s.name, ', ' order by s.name) x from r join s on s.id = r.target_id group by 1), i as (select r.target_id id, string_agg(distinct s.name, ', ' order by s.name) x from r join s on s.id = r.source_id group by 1), dd as (select symbol_name, string_agg(distinct doc_path, ', ' order by doc_path) x from m group by 1), t as (select s.id, concat_ws(chr(10), kind || ' ' || name || ' (' || file || ')', 'uses: ' || o.x, 'used by: ' || i.x, 'docs: ' || dd.x) text, o.x is not null has_deps, i.x is not null has_dependents, dd.x is not null has_docs from s left join o on o.id = s.id left join i on i.id = s.id left join dd on dd.symbol_name = s.name), u as (select id, case when length(text) > 20000 then substr(text, 1, 20000) || chr(10) || chr(10) || '... (truncated)' else text end text, has_deps, has_dependents, has_docs from t) select id, sha256(text) text_hash, ceil(length(text) / 4)::bigint tokens, has_deps, has_dependents, has_docs from u")
def relevant_context(spark, d):
    return retrieval.context(S(spark, d, "name", "kind", "file"), R(spark, d), M(spark, d)).select("id", F.sha2("text", 256).alias("text_hash"), "tokens", "has_deps", "has_dependents", "has_docs")


# -- tracing, APIs -----------------------------------------------------------------------------

_COMMITS = "c as (select run_id, upper(regexp_extract(repo, '^[a-z]+')) || '-' || (run_id % 40) || ' indexed, see ' || upper(regexp_extract(repo, '^[a-z]+')) || '-' || (run_id % 7) message, list_distinct(list_transform(coalesce(errors, []), lambda x: regexp_replace(replace(x.file, '\\', '/'), '^(\\./)+', ''))) files from index_results)"


def _commits(spark, d) -> DataFrame:
    """Index runs as commits: a message that names two tickets, and the files of their errors."""
    p = F.upper(F.regexp_extract("repo", "^[a-z]+", 0))
    return table(spark, d, "index_results").select(F.concat(p, F.lit("-"), F.col("run_id") % 40, F.lit(" indexed, see "), p, F.lit("-"), F.col("run_id") % 7).alias("message"), F.transform(F.coalesce("errors", F.array()), lambda e: norm_path(e["file"])).alias("files"))


_REFS = f"{_COMMITS}, t as (select distinct unnest(list_distinct(regexp_extract_all(message, '[A-Z][A-Z0-9]+-[0-9]+'))) ticket, files from c), f as (select distinct ticket, unnest(files) file from t)"


@query(f"with {_REFS} select ticket, file from f where file is not null")
def ticket_refs(spark, d):
    return trace.commit_refs(_commits(spark, d))


@query(f"with {_S}, {_M}, {_REFS}, g as (select distinct ticket, file, regexp_matches(lower(file), '\\.(test|spec)\\.|(^|/)tests?/') test from f where file is not null), n as (select g.*, s.name from g join s on s.file = g.file) select distinct ticket, 'symbol' as role, name as value from n where not test union select ticket, 'test', file from g where test union select ticket, 'doc', m.doc_path from n join m on m.symbol_name = n.name where m.doc_path is not null")
def traceability_matrix(spark, d):
    return trace.matrix(trace.commit_refs(_commits(spark, d)), S(spark, d, "file", "name"), M(spark, d))


_API = "where kind = 'method' and parent is not null and regexp_matches(name, '^[a-z]')"


def _api(s: DataFrame, shift: int) -> DataFrame:
    """Methods as endpoints; the second side leaves out and alters some, by a hash of the name."""
    h = F.conv(F.substring(F.sha2(F.col("name"), 256), 1, 2), 16, 10).cast("int")
    m = s.where("kind = 'method' and parent is not null").where(F.col("name").rlike("^[a-z]"))
    m = m.where(h % 5 != shift)
    return m.groupBy("name").agg(F.min("id").alias("id")).select(F.lit("get").alias("method"), F.concat(F.lit("/"), "name", F.lit("/{id}")).alias("path"), F.create_map(F.lit("id"), F.when(h % 3 == shift, "number").otherwise("string")).alias("params"), F.lit(None).cast("string").alias("response"), F.col("id").alias("symbol_id"))


def _side(shift: int) -> str:
    h = "('0x' || substr(sha256(name), 1, 2))::int"
    return f"(select 'GET /' || name || '/:id' endpoint, case when {h} % 3 = {shift} then 'number' else 'string' end ty, min(id) id from s {_API} and {h} % 5 <> {shift} group by name)"


@query(f"with {_S}, j as (select coalesce(a.endpoint, b.endpoint) endpoint, a.id aid, b.id bid, a.ty aty, b.ty bty from {_side(0)} a full join {_side(1)} b on a.endpoint = b.endpoint) select case when bid is null then 'missing_in_spec' when aid is null then 'missing_in_code' else 'type_mismatch' end as type, endpoint, case when bid is null then 'Exists in code (' || aid || ') but not in spec' when aid is null then 'Exists in spec (' || bid || ') but not in code' else 'Parameter ''id'' type mismatch: code=''' || aty || ''' spec=''' || bty || '''' end details from j where aid is null or bid is null or aty <> bty")
def api_diff(spark, d):
    s = S(spark, d, "name", "kind", "parent")
    return trace.compare_apis(_api(s, 0), _api(s, 1))


# -- event stream, diagrams, parsing -----------------------------------------------------------


@query("select time_bucket(interval '1 day', ts) \"start\", event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def event_windows(spark, d):
    return incremental.tumbling(table(spark, d, "events"), "1 day").withColumn("total", F.round("total", 4))


@query("with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '6 hours' then 0 else 1 end s from events), g as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) k from e) select user_id, min(ts) \"start\", max(ts) + interval '6 hours' \"end\", count(*) n from g group by user_id, k")
def event_sessions(spark, d):
    return incremental.sessions(table(spark, d, "events"), "6 hours")


@query()
def parsed_symbols(spark, d):
    files = current_rows(table(spark, d, "source_files"), "path", ["content"])
    return ingest.extract_symbols(files.where("content <> ''")).select("id", "name", "kind", "file", "start_line", "end_line", "parent")


@query()
def class_diagram(spark, d):
    """At most 400 lines, as the diagram allows; a last line tells of the cut."""
    return diagrams.class_diagram(S(spark, d, "name", "kind", "parent"), R(spark, d))


# -- reports -----------------------------------------------------------------------------------


@query(f"with {_S}, {_R} select a.file, r.type, count(*) n from r join s a on a.id = r.source_id join s b on b.id = r.target_id where a.file = b.file group by 1, 2")
def file_subgraphs(spark, d):
    return graph.within_files(R(spark, d), S(spark, d, "file")).groupBy("file", "type").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_S}, {_R}, c as (select target_id id from r join s on s.id = r.target_id group by 1 order by count(*) desc, 1 limit 1) select r.source_id, r.target_id, r.type, a.name s_name, b.name t_name from r join s a on a.id = r.source_id join s b on b.id = r.target_id where r.source_id = (select id from c) or r.target_id = (select id from c)")
def ego_network(spark, d):
    e, s = R(spark, d), S(spark, d, "name")
    top = e.groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).join(s, "id", "left_semi").orderBy(F.desc("n"), "id").first()
    return graph.ego(e, s, top.id if top else "").select("source_id", "target_id", "type", "s_name", "t_name")


@query("select coalesce(source, 'general') as \"group\", count(*) n, min(doc_path) \"first\", max(doc_path) \"last\" from (select distinct source, doc_path from documents where doc_path is not null) group by 1")
def docs_by_source(spark, d):
    docs = table(spark, d, "documents").where("doc_path is not null").select("source", F.col("doc_path").alias("path")).distinct()
    return documents.grouped(docs, "source")


@query(f"with a as (select doc_path path, max(source) title from documents where doc_path is not null group by 1), b as (select doc_path path, max(symbol_name) title, max(seq) pos from doc_mappings group by 1) select coalesce(a.path, b.path) path, case when a.path is not null then a.title else b.title end title, b.pos from a full join b on a.path = b.path")
def merged_docs(spark, d):
    a = table(spark, d, "documents").where("doc_path is not null").groupBy(F.col("doc_path").alias("path")).agg(F.max("source").alias("title"))
    b = table(spark, d, "doc_mappings").groupBy(F.col("doc_path").alias("path")).agg(F.max("symbol_name").alias("title"), F.max("seq").alias("pos"))
    return documents.merged(a, b)


@query(f"with {_S} select file, start_line, id, '- `' || kind || '` **' || name || '** (L' || start_line || '-' || end_line || ')' || case when summary <> '' then ': ' || summary else '' end line from s union all select distinct file, 0, '', '# ' || file from s")
def file_pages(spark, d):
    return documents.page_lines(S(spark, d, "file", "kind", "name", "start_line", "end_line", "summary"))


@query(f"with {_S}, {_M}, v as (select 'max-complexity' rule, id from s where metrics.cyclomaticComplexity > 4 union all select 'max-parameters', id from s where metrics.parameterCount > 2) select 'severity' topic, 'warning' as key, count(*) n from v having count(*) > 0 union all select 'rule', rule, count(*) from v group by rule union all select 'symbols', 'symbols', count(*) from s union all select 'symbols', 'complex', count(*) filter (metrics.cyclomaticComplexity > 10) from s union all select 'symbols', 'dead', count(*) filter (list_contains(violations, 'dead_code')) from s union all select 'symbols', 'documented', count(*) from m")
def code_review(spark, d):
    s = S(spark, d, *rules.SYMBOL_COLUMNS[1:], "violations")
    found = rules.violations([rules.Rule("max-complexity", "max_complexity", {"max": 4}), rules.Rule("max-parameters", "max_parameters", {"max": 2})], s, R(spark, d))
    return rules.review(s, M(spark, d), found)


@query(f"with {_S} select s.id symbol_id, s.name, s.kind, s.file from s where coalesce(metrics.linesOfCode, end_line - start_line + 1) > 60 and not (regexp_matches(lower(file), '\\.go$') and regexp_matches(file, '^.*/tests/.*$'))")
def violations_by_language(spark, d):
    s = S(spark, d, *rules.SYMBOL_COLUMNS[1:])
    found = rules.without_ignored(rules.violations([rules.Rule("long", "max_lines", {"max": 60})], s, R(spark, d)), {"go": ["**/tests/**"]})
    return rules.named(found, s).select("symbol_id", "name", "kind", "file")


@query(f"with {_S}, f as (select distinct file from s) select case when regexp_matches(file, '^.*/tests/.*$') then 'test' when regexp_matches(file, '^.*/(?:infra)/.*$') then 'adapter' when regexp_matches(file, '^[^/]*/src/.*$') then 'source' else 'other' end prompt, count(*) n from f group by 1")
def prompt_rules(spark, d):
    p = X.first_match("file", [("**/tests/**", "test"), ("**/infra/**", "adapter"), ("*/src/**", "source")], "other")
    return S(spark, d, "file").select("file").distinct().groupBy(p.alias("prompt")).agg(F.count(F.lit(1)).alias("n"))


@query("with a as (select path, arg_min(content, seq) c, arg_max(content, seq) e, count(*) n from source_files group by 1 having count(*) > 1), o as (select path, unnest(string_split(c, chr(10))) t, generate_subscripts(string_split(c, chr(10)), 1) line from a), n as (select path, unnest(string_split(e, chr(10))) t, generate_subscripts(string_split(e, chr(10)), 1) line from a) select coalesce(o.path, n.path) path, coalesce(o.line, n.line) line, o.t before, n.t after from o full join n on o.path = n.path and o.line = n.line where o.t is distinct from n.t")
def file_line_diff(spark, d):
    f = table(spark, d, "source_files").select("path", "seq", "content")
    g = f.groupBy("path").agg(F.min_by("content", "seq").alias("a"), F.max_by("content", "seq").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return changes.line_diff(g.select("path", F.col("a").alias("content")), g.select("path", F.col("b").alias("content")), "path", "content")


def _todos(content: str, path: str) -> int:
    return content.count("TODO")


@query("with c as (select path, arg_max(content, seq) t from source_files group by 1) select 'todo' rule, path file, (length(t) - length(replace(t, 'TODO', ''))) // 4 n, 'warning' severity from c where contains(t, 'TODO')")
def custom_rule(spark, d):
    return rules.custom_rule(current_rows(table(spark, d, "source_files"), "path", ["content"]), _todos, "todo")


@query(f"with {_S}, t as (select id, kind || ' ' || name || ' in ' || file || coalesce(chr(10) || nullif(concat_ws(' | ', 'layer: ' || nullif(layer, ''), 'domain: ' || nullif(domain, ''), 'summary: ' || nullif(summary, ''), 'signature: ' || nullif(signature, '')), ''), '') || coalesce(chr(10) || nullif(source, ''), '') text from s) select id, sha256(text) text_hash, length(text) n from t")
def symbol_texts(spark, d):
    t = retrieval.symbol_text(S(spark, d, "kind", "name", "file", "layer", "domain", "summary", "signature", "source"))
    return t.select("id", F.sha2("text", 256).alias("text_hash"), F.length("text").cast("long").alias("n"))


@query(f"with {_S}, {_R}, dd as (select s.id from s where parent is null and exported is distinct from false and kind in ('function', 'method', 'class', 'abstract_class', 'constructor', 'getter', 'setter', 'event', 'service') and not contains(file, 'tests/') and not contains(file, '/fixtures/') and not contains(file, 'site/shared') and not exists (select 1 from r where r.target_id = s.id) and not exists (select 1 from s c where c.parent = s.id)) select id, array_to_string(list_distinct(list_concat(coalesce(violations, []), ['dead_code'])), ',') violations from (select id, list_sort(list_distinct(list_concat(coalesce(violations, []), ['dead_code']))) violations from s where id in (select id from dd))")
def dead_code_marks(spark, d):
    s = S(spark, d, "name", "file", "parent", "exported", "kind", "violations")
    dead = rules.dead_code(s, R(spark, d))
    marked = rules.mark_dead(s, dead).join(dead.select("id"), "id", "left_semi")
    return marked.select("id", F.array_join(F.array_sort("violations"), ",").alias("violations"))


@query(f"with {_S}, {_R}, q as (select name, arg_max(id, seq) id from s group by 1), x as (select distinct coalesce(a.name, r.source_id) sn, coalesce(b.name, r.target_id) tn from r left join s a on a.id = r.source_id left join s b on b.id = r.target_id where r.type = 'dynamic_call') select coalesce(q2.id, x.tn) source_id, coalesce(q1.id, x.sn) target_id, 'dynamic_call' as type from x left join q q1 on q1.name = x.sn left join q q2 on q2.name = x.tn")
def dynamic_edges(spark, d):
    s = S(spark, d, "name", "seq")
    found = graph.labelled(R(spark, d).where("type = 'dynamic_call'"), s).select(F.col("source").alias("source_name"), F.col("target").alias("target_name")).distinct()
    return resolution.dynamic_edges(found, s)


@query(f"with {_S} select kind, count(*) n from s where name not in ('if', 'for', 'while', 'switch', 'catch', 'return', 'function', 'constructor') group by 1")
def named_kinds(spark, d):
    return search.without_ghosts(S(spark, d, "name", "kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_S}, c as (select run_id, unnest(list_distinct(list_transform(coalesce(errors, []), lambda x: regexp_replace(replace(x.file, '\\', '/'), '^(\\./)+', '')))) file from index_results) select c.run_id, count(distinct s.id) n_symbols from c join s on s.file = c.file group by 1")
def run_symbols(spark, d):
    """Symbols in the files that each index run had trouble with."""
    f = table(spark, d, "index_results").select("run_id", F.explode("errors").alias("e")).select("run_id", norm_path("e.file").alias("file")).distinct()
    return f.join(S(spark, d, "file"), "file").groupBy("run_id").agg(F.countDistinct("id").alias("n_symbols"))
