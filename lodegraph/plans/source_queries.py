"""Queries over source text, rule catalogues, exchange formats and sinks, each with SQL that states the same result.

Where no table holds a format (lcov, diffs, specifications, front matter), its text is written
from the rows of whole tables and read back; the SQL states the rows themselves.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph import schemas
from lodegraph.functions import exprs as X
from lodegraph.operators import catalogues, changes, diagrams, documents, patterns, resolution, retrieval, rules, search, sourcecode, trace
from lodegraph.plans.reference_queries import _DIFF, _M, _OLD, _R, _S, SQL as REFERENCE_SQL, M, R, S, _commits, _diff
from lodegraph.sources import ingest, sinks
from lodegraph.sources.tables import current_wide, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def q(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def _files(spark, d) -> DataFrame:
    return current_wide(table(spark, d, "source_files"), "path", ["repo", "content"])


_F = "f as (select path, repo, content from (select *, row_number() over (partition by path order by seq desc) rn from source_files where path is not null) where rn = 1)"
_LN = f"{_F}, ln as (select path file, unnest(string_split(replace(content, chr(13), ''), chr(10))) txt, generate_subscripts(string_split(replace(content, chr(13), ''), chr(10)), 1) line from f), code as (select * from ln where not regexp_matches(txt, {q(sourcecode.COMMENT_LINE)}))"


def _around(points: str, where: str = "true") -> str:
    return f"select p.*, s.id, row_number() over (partition by {points} order by s.end_line - s.start_line, s.id) n from p join s on s.file = p.file and p.line between s.start_line and s.end_line where {where}"


# -- source text -------------------------------------------------------------------------------

_RG = q(sourcecode.REGISTRATION)
_IN_FUNCTION = "s.kind in ('function', 'method')"


@query(f"with {_S}, {_LN}, m as (select file, line, unnest(regexp_extract_all(txt, {_RG})) m from code), p as (select distinct file, line, regexp_extract(m, {_RG}, 1) pattern, coalesce(nullif(regexp_extract(m, {_RG}, 2), ''), nullif(regexp_extract(m, {_RG}, 3), '')) registered from m), a as ({_around('p.file, p.line, p.pattern, p.registered', _IN_FUNCTION)}) select file, line, pattern, registered, id from a where n = 1 and registered is not null")
def dynamic_registrations(spark, d):
    return sourcecode.registrations(_files(spark, d), S(spark, d, "file", "kind", "start_line", "end_line"))


def _edge_sql() -> str:
    parts = []
    for kind, exts, pattern in sourcecode.EDGE_PATTERNS:
        only = "" if exts is None else f" where lower(regexp_extract(file, '\\.([^./]+)$', 1)) in ({', '.join(map(q, exts))})"
        parts.append(f"select file, line, {q(kind)} as type, unnest(regexp_extract_all(txt, {q(pattern)}, 1)) t from code{only}")
    return f"""with {_S}, {_LN}, e0 as ({' union all '.join(parts)}), e1 as (select file, line, type, trim(unnest(string_split(t, ','))) t from e0),
p as (select distinct * from e1 where t <> '' and not (type = 'calls' and t in ({', '.join(map(q, sourcecode.NO_CALLS))}))),
a as (select file, line, type, t, id from ({_around('p.file, p.line, p.type, p.t')}) where n = 1),
x as (select distinct case when p.type = 'uses' or a.id is null then 'module::' || p.file else a.id end source_id, p.type, p.t, coalesce(nullif(regexp_extract(p.t, '[^\\\\./]*$'), ''), p.t) as name from p left join a on a.file = p.file and a.line = p.line and a.type = p.type and a.t = p.t),
k as (select name, arg_max(id, seq) hit from s group by 1)
select distinct source_id, coalesce(hit, t) target_id, type, hit is not null resolved from x left join k on k.name = x.name where hit is null or hit <> source_id"""


@query(_edge_sql())
def extracted_edges(spark, d):
    return sourcecode.source_edges(_files(spark, d), S(spark, d, "file", "name", "start_line", "end_line", "seq"))


_BR = f"len(regexp_extract_all(regexp_replace(txt, {q(sourcecode.STRINGS.replace('*+', '*'))}, '', 'g'), {q(sourcecode.BRANCH)}))"
_PARAMS = "case when trim(regexp_extract(coalesce(signature, ''), '\\(([^)]*)\\)', 1)) = '' then 0 else len(string_split(regexp_extract(coalesce(signature, ''), '\\(([^)]*)\\)', 1), ',')) end"


@query(f"with {_S}, {_LN}, h as (select file, line, {_BR} hits from code), b as (select s.id, sum(hits) n from s join h on h.file = s.file and h.line between s.start_line and s.end_line group by 1) select s.id, end_line - start_line + 1 lines_of_code, cast(coalesce(n, 0) + 1 as bigint) complexity, {_PARAMS} parameters from s left join b on b.id = s.id where kind in ('function', 'method', 'constructor')")
def extracted_metrics(spark, d):
    return sourcecode.metrics(_files(spark, d), S(spark, d, "file", "kind", "start_line", "end_line", "signature"))


@query(f"with {_S}, r0 as (select id, list_transform(string_split(regexp_replace(regexp_replace(replace(doc_comment, chr(13), ''), '^/\\*\\*\\s*', ''), '\\s*\\*/$', ''), chr(10)), lambda x: regexp_replace(x, '^\\s*\\*\\s?', '')) l from s where starts_with(doc_comment, '/**')) select id, nullif(regexp_replace(array_to_string(list_filter(l, lambda x: not regexp_matches(x, '^@\\w')), ' '), '^\\s+|\\s+$', '', 'g'), '') summary, array_to_string(list_transform(list_filter(l, lambda x: regexp_matches(x, '^@\\w')), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), '|') tags from r0")
def doc_comment_parts(spark, d):
    parts = S(spark, d, "doc_comment").select("id", sourcecode.doc_parts("doc_comment").alias("p")).where("p is not null")
    return parts.select("id", "p.summary", F.array_join("p.tags", "|").alias("tags"))


def _kind_sql(language: str) -> str:
    low = "lower(name)"
    classes = "'class', 'abstract_class'" if language == "php" else "'class'"
    cases = [f"when kind not in ({classes}) then kind"]
    for suffixes, to in catalogues.KIND_SUFFIXES[language]:
        hit = " or ".join(f"ends_with({low}, {q(x)})" for x in suffixes.split())
        cases.append(f"when {hit}{' or contains(lower(sym_extends), ' + q('event') + ')' if language == 'php' and to == 'event' else ''} then {q(to)}")
    if language == "php":
        cases.append("when len(list_filter(sym_implements, lambda x: contains(lower(x), 'listener') or contains(lower(x), 'subscriber'))) > 0 then 'listener'")
    return f"select id, {q(language)} as language, case {' '.join(cases)} else kind end refined from s"


@query(f"with {_S} " + " union all ".join(map(_kind_sql, catalogues.KIND_SUFFIXES)))
def refined_kinds(spark, d):
    """The kind every symbol would have under the naming habits of each language."""
    s = S(spark, d, "kind", "name", "sym_extends", "sym_implements")
    return s.select("id", F.explode(F.array(*[F.struct(F.lit(x).alias("language"), catalogues.refined_kind(x).alias("refined")) for x in catalogues.KIND_SUFFIXES])).alias("k")).select("id", "k.language", "k.refined")


@query(f"with {_S} select a.id, case when b.name is not null then b.name || '.' || a.name when lower(regexp_extract(a.file, '\\.([^./]+)$', 1)) = 'php' and coalesce(a.bounded_context, '') <> '' then a.bounded_context || '\\' || a.name else a.name end qualified from s a left join s b on b.id = a.parent")
def qualified_names(spark, d):
    s = S(spark, d, "file", "name", "parent", "bounded_context")
    up = s.select(F.col("id").alias("parent"), F.col("name").alias("parent_name"))
    return s.withColumn("language_name", X.language_of("file")).join(up, "parent", "left").select("id", catalogues.qualified_name().alias("qualified"))


@query(f"with {_S}, {_F} select s.id, array_to_string(list_slice(string_split(content, chr(10)), greatest(1, start_line - 3), least(len(string_split(content, chr(10))), end_line + 3, greatest(1, start_line - 3) + 79)), chr(10)) txt, cast(greatest(0, least(len(string_split(content, chr(10))), end_line + 3) - greatest(0, start_line - 4) - 80) as int) omitted from s join f on f.path = s.file where content is not null")
def source_windows(spark, d):
    f = _files(spark, d).where("content is not null").select(F.col("path").alias("file"), "content")
    w = S(spark, d, "file", "start_line", "end_line").join(f, "file").select("id", retrieval.source_window("content", "start_line", "end_line").alias("w"))
    return w.select("id", F.col("w.text").alias("txt"), F.col("w.omitted").cast("int").alias("omitted"))


# -- rule catalogues ---------------------------------------------------------------------------

_SHORT = "case when regexp_matches(seg, '\\.|::') and regexp_extract(seg, '[^.:]*$') <> '' then regexp_extract(seg, '[^.:]*$') else seg end"
_RULED = f"w as (select *, coalesce(nullif(qualified_name, ''), name) qq, coalesce(signature, '') sig from s), w1 as (select *, case when regexp_matches(qq, '[\\\\/]') then regexp_extract(qq, '[^\\\\/]*$') else qq end seg, regexp_matches(sig, '\\)\\s*([:\\s].*)?$') m, trim(regexp_extract(sig, '\\)\\s*([:\\s].*)?$', 1)) tail from w), v as (select *, regexp_replace({_SHORT}, '(?i)\\.(php|ts|tsx|js|jsx|go|py|rs|java)$', '') short, coalesce(metrics.linesOfCode, end_line - start_line + 1) loc from w1)"


def _glob(col: str, pattern: str) -> str:
    body = "".join({"**": ".*", "*": "[^/]*"}.get(x, "\\" + x if x in ".+^${}()|[]\\" else x) for x in re.findall(r"\*\*|.", pattern))
    return f"regexp_matches({col}, {q('^' + body + '$')})"


def _rule_sql(r: rules.Rule) -> str | None:
    c, head = r.config, f"select {q(r.name)} as rule, "
    tail = f", {q(r.severity or 'warning')} severity"
    kind = f" and kind = {q(c['kind'])}" if c.get("kind") else ""
    if r.type in ("layer_boundary", "forbidden_import"):
        if not c.get("forbidden"):
            return None
        start = c.get("source") or c.get("scope")
        to = " or ".join([_glob("b.file", x) for x in c["forbidden"]] + ([_glob("b.name", x) for x in c["forbidden"]] if r.type == "forbidden_import" else []))
        return head + f"a.file, a.id symbol_id{tail} from r join v a on a.id = r.source_id join v b on b.id = r.target_id where {_glob('a.file', start) if start else 'true'} and ({to})"
    if r.type == "naming_convention":
        allow = ", ".join(q(x.lower()) for x in c.get("allowNames", []))
        free = f" and lower(short) not in ({allow}) and lower(name) not in ({allow})" if allow else ""
        return head + f"file, id symbol_id{tail} from v where not regexp_matches(short, {q(c['pattern'])}){kind}{free}"
    if r.type == "missing_return_type":
        scope = " and coalesce(visibility, '') in ('', 'public')" if c.get("scope") == "public" else ""
        return head + f"file, id symbol_id{tail} from v where kind in ('method', 'function', 'constructor') and not (m and tail <> '' and not regexp_matches(tail, '^\\s*[{{\\[]?\\s*$')){scope}"
    metric = {"max_complexity": "metrics.cyclomaticComplexity", "max_parameters": "metrics.parameterCount", "max_lines": "loc"}[r.type]
    return head + f"file, id symbol_id{tail} from v where {metric} > {c['max']}{kind}"


def _rules_sql(found: list[rules.Rule], exts: str = "") -> str:
    body = " union all ".join(x for x in map(_rule_sql, found) if x)
    return f"with {_S}, {_R}, {_RULED} select * from ({body})" + (f" where lower(regexp_extract(file, '\\.([^./]+)$', 1)) in ({exts})" if exts else "")


def _ruled(spark, d) -> DataFrame:
    return S(spark, d, "name", "qualified_name", "kind", "file", "start_line", "end_line", "visibility", "signature", "metrics")


_SLIM = ["rule", "file", "symbol_id", "severity"]


@query(_rules_sql(catalogues.PHP_RULES, "'php'"))
def php_catalogue(spark, d):
    return catalogues.catalogue_violations("php", _ruled(spark, d), R(spark, d)).select(*_SLIM)


@query(_rules_sql(catalogues.TYPESCRIPT_RULES, "'ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs'"))
def typescript_catalogue(spark, d):
    return catalogues.catalogue_violations("typescript", _ruled(spark, d), R(spark, d)).select(*_SLIM)


@query(_rules_sql(catalogues.CONTAINER_RULES))
def container_rules(spark, d):
    return rules.violations(catalogues.CONTAINER_RULES, _ruled(spark, d), R(spark, d)).select(*_SLIM)


_BASE = catalogues.base_rules(["php", "typescript", "javascript", "python"], return_type=True)


@query(_rules_sql(_BASE))
def base_rules(spark, d):
    return rules.violations(_BASE, _ruled(spark, d), R(spark, d)).select(*_SLIM)


_PICKED = rules.select_rules(catalogues.PHP_RULES, include=["php:max_complexity", "php:max_parameters", "php:naming_class"], exclude=["php:naming_class"], override={"php:max_parameters": {"severity": "info", "config": {"max": 2}}})


@query(_rules_sql([rules.Rule("php:max_complexity", "max_complexity", {"max": 10}, "warning"), rules.Rule("php:max_parameters", "max_parameters", {"max": 2}, "warning")]))
def selected_rules(spark, d):
    """A whitelist, a blacklist and an override of severity and limit."""
    return rules.violations(_PICKED, _ruled(spark, d), R(spark, d)).select(*_SLIM)


@query(f"select rule, symbol_id, rank, greatest(total - 10, 0) remaining from (select *, row_number() over (partition by rule order by symbol_id) rank, count(*) over (partition by rule) total from ({_rules_sql(catalogues.CONTAINER_RULES)})) where rank <= 10")
def first_violations(spark, d):
    """The first ten of each rule, as a report shows them, and how many remain."""
    found = rules.violations(catalogues.CONTAINER_RULES, _ruled(spark, d), R(spark, d)).select("rule", "symbol_id")
    total = found.groupBy("rule").agg(F.count(F.lit(1)).alias("total"))
    top = found.withColumn("rank", F.row_number().over(Window.partitionBy("rule").orderBy("symbol_id"))).where("rank <= 10")
    return top.join(total, "rule").select("rule", "symbol_id", "rank", F.greatest(F.col("total") - 10, F.lit(0)).alias("remaining"))


# -- scalars -----------------------------------------------------------------------------------


@query("select distinct hash, (case when h >= 2147483648 then '-' else '' end) || lower(to_base(case when h >= 2147483648 then 4294967296 - h else h end, 36)) legacy from (select hash, list_reduce(list_prepend(0::bigint, list_transform(list_filter(string_split(content, ''), lambda c: c <> ''), lambda c: unicode(c)::bigint)), lambda a, c: (a * 31 + c) % 4294967296) h from rag_chunks where content is not null)")
def legacy_chunk_hashes(spark, d):
    return table(spark, d, "rag_chunks").where("content is not null").select("hash", X.legacy_hash("content").alias("legacy")).distinct()


@query(f"with {_S}, p as (select id, metrics.testCoverage.coveragePercent x from s where metrics.testCoverage.coveragePercent is not null) select id, case when (x * 4) - 2 * floor(x * 2) = 1 then printf('%.1f', (floor(x * 10) + 1) / 10) else printf('%.1f', x) end percent from p")
def coverage_text(spark, d):
    return S(spark, d, "metrics").select("id", F.col("metrics.testCoverage.coveragePercent").alias("x")).where("x is not null").select("id", X.to_fixed("x").alias("percent"))


@query("select strftime(started_at at time zone 'UTC', '%Y-%m-%d') as day, count(*) n from index_results group by 1")
def runs_by_day(spark, d):
    return table(spark, d, "index_results").groupBy(X.iso_date("started_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_S} select id, metrics.linesOfCode lines, metrics.cyclomaticComplexity complexity, metrics.testCoverage.coveragePercent percent, len(tags) n_tags from s")
def json_columns(spark, d):
    """Metrics and tags as stored JSON text, read back by the model's schema."""
    kinds = {f.name: f.dataType for f in schemas.schema("symbols").fields}
    text = S(spark, d, "metrics", "tags").select("id", F.to_json("metrics").alias("metrics"), F.to_json("tags").alias("tags"))
    back = text.select("id", F.from_json("metrics", kinds["metrics"]).alias("m"), F.from_json("tags", kinds["tags"]).alias("t"))
    return back.select("id", F.col("m.linesOfCode").alias("lines"), F.col("m.cyclomaticComplexity").alias("complexity"), F.col("m.testCoverage.coveragePercent").alias("percent"), F.when(F.col("t").isNotNull(), F.size("t")).alias("n_tags"))


@query(f"with {_S} select id, kind from s where name = 'constructor' or qualified_name = 'constructor'")
def found_by_name(spark, d):
    return search.by_name(S(spark, d, "name", "qualified_name", "kind"), "constructor").select("id", "kind")


@query("select distinct path from source_files where regexp_matches(path, '^.*/core/[^/]*\\.ts$')")
def config_globs(spark, d):
    return table(spark, d, "source_files").where(F.col("path").rlike(X.glob_to_regex("**/core/*.ts", "."))).select("path").distinct()


# -- documents ---------------------------------------------------------------------------------

_TITLE = "array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_extract(doc_path, '[^/]*$'), '\\.[^.]+$', ''), '[-_]+', ' ', 'g'), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_DOCS = f"dp as (select distinct doc_path path, {_TITLE} title, case when contains(doc_path, '/') then string_split(doc_path, '/')[1] end as module from documents where regexp_matches(doc_path, '(?i)\\.mdx?$'))"


@query(f"with {_DOCS} select path, title, module from dp")
def found_documents(spark, d):
    return ingest.discovered_docs(table(spark, d, "documents").select(F.col("doc_path").alias("path")).distinct())


@query(f"with {_DOCS}, c as (select *, string_split(path, '/')[2] category from dp) select path, category, row_number() over (partition by category order by title, path) as position from c")
def registered_documents(spark, d):
    """Registered documents in their order: by title within a category."""
    docs = ingest.discovered_docs(table(spark, d, "documents").select(F.col("doc_path").alias("path")).distinct()).withColumn("category", F.try_element_at(F.split("path", "/"), F.lit(2)))
    return documents.registered_order(docs)


@query("select distinct doc_path path, 'T ' || doc_path title, trim(symbol_name, E' \\t\\r\\n\\'\"') symbol from doc_mappings where doc_path is not null and trim(symbol_name, E' \\t\\r\\n\\'\"') <> ''")
def front_matter_symbols(spark, d):
    """Mappings written as front matter with lists of symbols, and read back."""
    m = table(spark, d, "doc_mappings").where("doc_path is not null")
    text = F.concat(F.lit("---\ntitle: T "), "doc_path", F.lit("\nsymbols:\n  - "), F.array_join(F.array_sort(F.collect_set(F.trim("symbol_name", F.lit(" \t\r\n")))), "\n  - "), F.lit("\n---\nBody\n"))
    files = m.groupBy("doc_path").agg(text.alias("content")).select(F.col("doc_path").alias("path"), "content")
    return ingest.front_matter(files).select("path", "title", F.explode("symbols").alias("symbol")).distinct()


_IMPACT = "case when deprecated then 'removed' when visibility = 'public' then 'signature_changed' else 'moved' end"


@query(f"with {_S}, {_M} select m.doc_path, s.name, {_IMPACT} change, case when {_IMPACT} = 'removed' then 'removed' when {_IMPACT} = 'signature_changed' then 'updated' else 'skipped' end as action from s join m on m.symbol_name = s.name")
def doc_update_plan(spark, d):
    """Every current symbol as an impact: deprecated ones removed, public ones with a new signature, others moved."""
    change = F.when(F.col("deprecated"), "removed").when(F.col("visibility") == "public", "signature_changed").otherwise("moved")
    impacts = S(spark, d, "name", "deprecated", "visibility").select("name", change.alias("change")).withColumn("doc_update_required", F.col("change") == "signature_changed")
    return changes.doc_updates(impacts, M(spark, d)).select("doc_path", "name", "change", "action")


_FACTS = "id || ':' || start_line || ':' || end_line || ':' || coalesce(source, '')"


@query(f"with {_S} select id, substr(sha256({_FACTS}), 1, 16) hash, explanation is not null and explanation <> '' and explanation_hash is not distinct from substr(sha256({_FACTS}), 1, 16) cached, 'Explain ' || kind || ' ' || name || ' in ' || file || coalesce(chr(10) || nullif(signature, ''), '') || coalesce(chr(10) || nullif(summary, ''), '') prompt from s")
def explain_requests(spark, d):
    return retrieval.explain_requests(S(spark, d, "kind", "name", "file", "start_line", "end_line", "source", "signature", "summary", "explanation", "explanation_hash"))


@query(f"with {_S} select id, length(coalesce(name, ''))::double a, length(coalesce(kind, ''))::double b from s")
def embedded_names(spark, d):
    """An injected embedding function over batches of texts."""
    t = S(spark, d, "name", "kind").select("id", F.concat_ws("|", F.coalesce("name", F.lit("")), F.coalesce("kind", F.lit(""))).alias("text"))
    v = retrieval.embedded(t, lambda texts: [[float(len(x)) for x in t.rsplit("|", 1)] for t in texts])
    return v.select("id", F.col("vector")[0].cast("double").alias("a"), F.col("vector")[1].cast("double").alias("b"))


@query()
def example_pass_rate(spark, d):
    return documents.pass_rate(documents.checked_examples(documents.fenced_blocks(table(spark, d, "documents"))))


# -- exchange formats --------------------------------------------------------------------------

_FN = "fnc as (select file, name, start_line line, coalesce(metrics.testCoverage.hitCount, 0) hits, id from s where kind in ('function', 'method'))"


def _lcov(spark, d) -> DataFrame:
    """Coverage of the symbols as lcov text, a record a symbol."""
    s = S(spark, d, "file", "name", "kind", "start_line", "metrics").where("kind in ('function', 'method')").withColumn("h", F.coalesce("metrics.testCoverage.hitCount", F.lit(0)).cast("string"))
    line = F.col("start_line").cast("string")
    return s.select(F.concat(F.lit("TN:\nSF:./"), "file", F.lit("\nFN:"), line, F.lit(","), "name", F.lit("\nFNDA:"), "h", F.lit(","), "name", F.lit("\nDA:"), line, F.lit(","), "h", F.lit("\nend_of_record\n")).alias("value"))


@query(f"with {_S}, {_FN} select distinct replace(file, '\\', '/') file, line, hits from fnc")
def lcov_lines(spark, d):
    return ingest.lcov(_lcov(spark, d)).distinct()


@query(f"with {_S}, {_FN} select 'a' || id id, case when hits > 0 then hits else 0 end hits from fnc")
def function_hits(spark, d):
    """Hits of each symbol from the function records of lcov text: by file and first line."""
    s = S(spark, d, "file", "name", "kind", "start_line", "metrics").where("kind in ('function', 'method')").withColumn("h", F.coalesce("metrics.testCoverage.hitCount", F.lit(0)).cast("string"))
    text = s.select(F.concat(F.lit("SF:"), "file", F.lit("\nFN:"), F.col("start_line").cast("string"), F.lit(",a"), "id", F.lit("\nFNDA:"), "h", F.lit(",a"), "id", F.lit("\nend_of_record\n")).alias("value"))
    return ingest.lcov_functions(text).select(F.col("name").alias("id"), "hits")


_CHANGED = "a0 as (select path, arg_min(content, seq) c from source_files group by 1), b0 as (select path, arg_max(content, seq) c from source_files group by 1), la as (select path, unnest(string_split(c, chr(10))) t, generate_subscripts(string_split(c, chr(10)), 1) line from a0), lb as (select path, unnest(string_split(c, chr(10))) t, generate_subscripts(string_split(c, chr(10)), 1) line from b0), ch as (select la.path, la.line from la join lb on la.path = lb.path and la.line = lb.line where la.t <> lb.t)"


@query(f"with {_CHANGED} select path file, cast(line as int) new_start, 1 new_lines from ch")
def diff_hunks(spark, d):
    """Changed lines of each path between its first and current reading, as a diff that is read back."""
    f = table(spark, d, "source_files").where("path is not null")
    old, new = f.groupBy("path").agg(F.min_by("content", "seq").alias("text")), f.groupBy("path").agg(F.max_by("content", "seq").alias("text"))
    ch = changes.line_diff(old, new, "path", "text").where("before is not null and after is not null")
    n = F.col("line").cast("string")
    text = ch.select(F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\n--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\n@@ -"), n, F.lit(",1 +"), n, F.lit(",1 @@\n-"), "before", F.lit("\n+"), "after").alias("value"))
    return ingest.git_diff(text).select("file", "new_start", "new_lines")


@query(f"with {_S} select distinct 'GET' as method, '/' || name || '/:id' path, 'integer' id_type, 'Item' response from s where kind = 'function'")
def openapi_endpoints(spark, d):
    names = S(spark, d, "name", "kind").where("kind = 'function'").select("name").distinct()
    spec = F.concat(F.lit('{"paths": {"/'), "name", F.lit('/{id}": {"get": {"operationId": "x", "parameters": [{"name": "id", "schema": {"type": "integer"}}], "responses": {"200": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/Item"}}}}}}}}}'))
    return ingest.openapi(names.select(spec.alias("value"))).select("method", "path", F.col("params")["id"].alias("id_type"), "response").distinct()


@query(f"with {_S} select m.id symbol_id, 'GET' as method, '/' || m.name path from s m join s c on c.id = m.parent where m.kind = 'method' and (c.kind = 'controller' or regexp_matches(c.name, '(?i)Controller$'))")
def code_endpoints(spark, d):
    """Routes of controller methods from their tags; each method is tagged with its own name here."""
    s = S(spark, d, "name", "kind", "parent", "signature", "summary").withColumn("tags", F.array(F.concat(F.lit("get /"), "name")))
    return trace.endpoints_in_code(s).select("symbol_id", "method", "path")


@query(f"with {_F} select distinct upper(regexp_extract(path, '^[a-z]+')) || '-7' ticket, path file, 1 as line from f where content is not null")
def comment_tickets(spark, d):
    """Ticket references in comments; each file is given one in a first line of its own."""
    f = _files(spark, d).where("content is not null").select(F.col("path").alias("file"), F.concat(F.lit("// ref: "), F.upper(F.regexp_extract("path", "^[a-z]+", 0)), F.lit("-7\n"), "content").alias("content"))
    return trace.comment_refs(f)


@query(f"with x as ({REFERENCE_SQL['traceability_matrix']}) select role, value from x where ticket = (select min(ticket) from x)")
def ticket_lookup(spark, d):
    """The first ticket's row of the matrix, as a report."""
    m = trace.matrix(trace.commit_refs(_commits(spark, d)), S(spark, d, "file", "name"), M(spark, d))
    return trace.of_tickets(m, trace.commit_refs(_commits(spark, d)).where("file is not null").agg(F.min("ticket").alias("ticket"))).select("role", "value")


# -- sinks, schemas ----------------------------------------------------------------------------


@query(f"with {_S} select id, kind, seq from s")
def upserted_symbols(spark, d):
    """First readings as the store, all rows as the upsert."""
    s = table(spark, d, "symbols").select("id", "kind", "seq").where("id is not null")
    return sinks.upsert(s.groupBy("id").agg(F.min_by("kind", "seq").alias("kind"), F.min("seq").alias("seq")), s, ["id"])


@query(f"with {_S} select id, file from s where file not in (select f from (select unnest(removed_files) f from index_results) where f is not null)")
def kept_symbols(spark, d):
    gone = table(spark, d, "index_results").select(F.explode("removed_files").alias("file"))
    return sinks.delete(S(spark, d, "file"), gone, ["file"])


@query(f"with {_S}, {_OLD} select id, seq from o where file not in (select file from s where kind = 'service' and file is not null) union all select id, seq from s where kind = 'service'")
def replaced_by_file(spark, d):
    s = table(spark, d, "symbols").where("id is not null")
    old = s.groupBy("id").agg(F.min_by("file", "seq").alias("file"), F.min("seq").alias("seq"))
    return sinks.replace_by_file(old, S(spark, d, "file", "kind", "seq").where("kind = 'service'").select("id", "file", "seq")).select("id", "seq")


@query(f"with {_S} select id, name, kind, file, coalesce(summary, '') summary, string_split(file, '/')[1] dir from s")
def search_rows(spark, d):
    return sinks.search_index(S(spark, d, "name", "kind", "file", "summary"))


@query(f"select '\"' || replace(ticket, '\"', '\"\"') || '\",\"' || role || '\",\"' || replace(value, '\"', '\"\"') || '\"' line from ({REFERENCE_SQL['traceability_matrix']}) union all select 'ticket,role,value'")
def matrix_csv(spark, d):
    return sinks.matrix_text(trace.matrix(trace.commit_refs(_commits(spark, d)), S(spark, d, "file", "name"), M(spark, d)), "csv")


@query("select id, start_line, null::varchar pattern_new, indexed from (select id, start_line, seq indexed from symbols)")
def aligned_symbols(spark, d):
    """An older layout: text for numbers, a column missing, another too many."""
    old = table(spark, d, "symbols").select("id", F.col("start_line").cast("string").alias("START_LINE"), "seq", F.lit(1).alias("extra"))
    return schemas.align(old, "symbols").select("id", "start_line", F.col("pattern").alias("pattern_new"), F.col("seq").alias("indexed"))


# -- patterns, resolution ----------------------------------------------------------------------


@query(f"with {_S}, {_R}, face as (select name, min_by(id, seq) id, list(id) ids from s where kind in ('class', 'service', 'provider', 'component') group by 1), im as (select distinct f.name, r.source_id member from r join s x on x.id = r.target_id join face f on f.name = x.name and x.kind in ('class', 'service', 'provider', 'component') where r.type = 'implements'), g as (select name from im group by 1 having count(*) >= 2), u as (select distinct x.name from r join s x on x.id = r.target_id where r.type = 'uses' and x.kind in ('class', 'service', 'provider', 'component')) select f.id \"primary\", im.member, case when u.name is null then 0.6 else 0.85 end confidence from g join face f on f.name = g.name join im on im.name = g.name left join u on u.name = g.name union select f.id, f.id, case when u.name is null then 0.6 else 0.85 end from g join face f on f.name = g.name left join u on u.name = g.name")
def strategy_members(spark, d):
    """Strategies by ``implements`` edges."""
    r = R(spark, d)
    said = r.where("type = 'implements'").select(F.col("source_id").alias("member"), F.col("target_id").alias("key"))
    found = patterns.strategy(S(spark, d, "name", "kind", "sym_implements", "seq"), r, ("class", "service", "provider", "component"), said)
    return found.select("primary", "member", F.col("confidence").cast("double").alias("confidence")).distinct()


@query(f"with {_S}, p as ({REFERENCE_SQL['pattern_repository']}) select p.\"primary\", p.member, coalesce(s.name, p.member) as name from p left join s on s.id = p.member")
def repository_names(spark, d):
    s = S(spark, d, "name", "kind", "parent", "visibility", "sym_implements", "seq")
    return patterns.member_names(patterns.repository(s, R(spark, d), ("model",)), s).select("primary", "member", "name")


@query(f"with {_S}, k as (select name, arg_max(id, seq) id from s group by 1) select s.id ref, k.id, 'import' how from s join k on k.name = s.name")
def import_resolution(spark, d):
    """Every symbol referred to by an alias that its file imports."""
    s = S(spark, d, "file", "name", "seq")
    alias = F.concat(F.lit("as "), "name")
    refs = s.select(F.col("id").alias("ref"), "file", F.lit("").alias("namespace"), alias.alias("target"))
    return resolution.resolve(refs, s, s.select("file", alias.alias("alias"), F.col("name").alias("qualified")).distinct())


@query(f"with {_S}, {_OLD} select s.id, case when o.end_line = s.end_line then 'x' end explanation from s left join o on o.id = s.id")
def carried_explanations(spark, d):
    f = table(spark, d, "symbols").where("id is not null")
    old = f.groupBy("id").agg(F.min_by("end_line", "seq").cast("string").alias("hash")).withColumn("explanation", F.lit("x"))
    new = S(spark, d, "end_line").select("id", F.col("end_line").cast("string").alias("hash"))
    return changes.carry_explanations(old, new).select("id", "explanation")


@query(f"with {_S}, {_R}, n as (select id, regexp_replace(name, '[^a-zA-Z0-9_]', '_', 'g') label from s), l as (select distinct '    ' || a.label || '->>' || b.label || ': ' || r.type line from r join n a on a.id = r.source_id join n b on b.id = r.target_id where r.type in ('calls', 'dispatches', 'dynamic_call')) select 'sequenceDiagram' || chr(10) || array_to_string(list_slice(list(line order by line), 1, 400), chr(10)) || case when count(*) > 400 then chr(10) || '    %% truncated' else '' end txt from l")
def sequence_text(spark, d):
    """At most 400 lines, as the diagram allows; a last line tells of the cut."""
    s = S(spark, d, "name")
    e = R(spark, d).join(s.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id").join(s.select(F.col("id").alias("target_id"), F.col("name").alias("target")), "target_id")
    return diagrams.sequence_diagram(e.select("source", "target", "type")).select(F.col("text").alias("txt"))
