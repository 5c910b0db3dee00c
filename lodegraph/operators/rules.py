"""Architecture rules as data: each rule becomes one plan, their union one report."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.exprs import any_glob, glob, has_return_type, ignored, lines_of_code, short_name

SYMBOL_COLUMNS = ["id", "name", "qualified_name", "kind", "file", "start_line", "end_line", "visibility", "signature", "metrics"]


@dataclass(frozen=True)
class Rule:
    name: str
    type: str
    config: dict = field(default_factory=dict)
    severity: str | None = None


def _scope(symbols: DataFrame, cfg: dict) -> DataFrame:
    out = symbols.where(~ignored("file", cfg.get("ignore")))
    if cfg.get("kind"):
        out = out.where(F.col("kind") == cfg["kind"])
    if cfg.get("file"):
        out = out.where(glob("file", cfg["file"]))
    return out


def _report(df: DataFrame, rule: Rule, message: Column, default: str) -> DataFrame:
    return df.select(F.lit(rule.name).alias("rule"), "file", F.col("id").alias("symbol_id"), message.alias("message"), F.lit(rule.severity or default).alias("severity"))


def _edges(rule: Rule, symbols: DataFrame, edges: DataFrame, from_: Column, to: Column, message: Column) -> DataFrame:
    s = symbols.select("id", "name", "file").where(from_ & ~ignored("file", rule.config.get("ignore")))
    t = symbols.select(F.col("id").alias("target_id"), F.col("name").alias("t_name"), F.col("file").alias("t_file")).where(to)
    j = edges.select(F.col("source_id").alias("id"), "target_id").join(s, "id").join(t, "target_id")
    return _report(j, rule, message, "error")


def _layer_boundary(rule: Rule, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    c = rule.config
    text = F.format_string("'%s' in %s depends on '%s' in forbidden layer %s", "name", "file", "t_name", "t_file")
    return _edges(rule, symbols, edges, glob("file", c.get("source", "")), any_glob("t_file", c.get("forbidden")), text)


def _forbidden_import(rule: Rule, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    c = rule.config
    from_ = glob("file", c["scope"]) if c.get("scope") else F.lit(True)
    to = any_glob("t_file", c.get("forbidden")) | any_glob("t_name", c.get("forbidden"))
    return _edges(rule, symbols, edges, from_, to, F.format_string("'%s' uses forbidden dependency '%s'", "name", "t_name"))


def _naming(rule: Rule, symbols: DataFrame, _: DataFrame) -> DataFrame:
    c = rule.config
    allowed = sorted({n.lower() for n in [*c.get("allowNames", []), *c.get("excludeNames", [])]})
    checked = short_name("qualified_name", "name")
    bad = ~checked.rlike(c["pattern"])
    if allowed:
        bad = bad & ~F.lower(checked).isin(allowed) & ~F.lower("name").isin(allowed)
    text = F.concat(F.lit("'"), F.col("name"), F.lit(f"' does not match naming convention /{c['pattern']}/"))
    return _report(_scope(symbols, c).where(bad), rule, text, "warning")


def _limit(metric: Column, default: int, text: str):
    def run(rule: Rule, symbols: DataFrame, _: DataFrame) -> DataFrame:
        most = rule.config.get("max", default)
        hit = _scope(symbols, rule.config).withColumn("_m", metric).where(F.col("_m") > most)
        return _report(hit, rule, F.format_string(text, "name", "_m", F.lit(most)), "warning")

    return run


def _return_type(rule: Rule, symbols: DataFrame, _: DataFrame) -> DataFrame:
    out = _scope(symbols, rule.config).where(F.col("kind").isin("method", "function", "constructor") & ~has_return_type("signature"))
    if rule.config.get("scope", "all") == "public":
        out = out.where(F.coalesce(F.col("visibility"), F.lit("")).isin("", "public"))
    return _report(out, rule, F.format_string("'%s' has no declared return type", "name"), "warning")


def _types() -> dict:
    # Default limits and texts of the messages
    return {
        "layer_boundary": _layer_boundary,
        "forbidden_import": _forbidden_import,
        "naming_convention": _naming,
        "max_complexity": _limit(F.col("metrics.cyclomaticComplexity"), 10, "'%s' has cyclomatic complexity %d (max %d)"),
        "max_parameters": _limit(F.col("metrics.parameterCount"), 5, "'%s' has %d parameters (max %d)"),
        "max_lines": _limit(lines_of_code(), 80, "'%s' has %d lines (max %d)"),
        "missing_return_type": _return_type,
    }


def violations(rules: list[Rule], symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, file, symbol_id, message, severity) of all rules; unknown types and boundary rules without ``forbidden`` find nothing."""
    types = _types()
    parts = [types[r.type](r, symbols, edges) for r in rules if r.type in types]
    if not parts:
        return symbols.select(F.lit("").alias("rule"), "file", F.col("id").alias("symbol_id"), F.lit("").alias("message"), F.lit("").alias("severity")).where("false")
    return reduce(lambda a, b: a.unionByName(b), parts)


# Default limits and name patterns per language
DEFAULT_RULES = {
    "php": [Rule("class-pascal-case", "naming_convention", {"kind": "class", "pattern": "^[A-Z][a-zA-Z0-9]*$"}, "error"), Rule("method-camel-case", "naming_convention", {"kind": "method", "pattern": "^[a-z][a-zA-Z0-9]*$", "allowNames": ["__construct", "__destruct", "__call", "__callStatic", "__get", "__set", "__isset", "__unset", "__sleep", "__wakeup", "__serialize", "__unserialize", "__toString", "__invoke", "__set_state", "__clone", "__debugInfo"]}), Rule("max-complexity", "max_complexity", {"max": 10}), Rule("max-parameters", "max_parameters", {"max": 5}), Rule("max-method-lines", "max_lines", {"kind": "method", "max": 50}), Rule("max-class-lines", "max_lines", {"kind": "class", "max": 300})],
    "typescript": [Rule("class-pascal-case", "naming_convention", {"kind": "class", "pattern": "^[A-Z][a-zA-Z0-9]*$"}, "error"), Rule("function-camel-case", "naming_convention", {"kind": "function", "pattern": "^[a-z][a-zA-Z0-9]*$"}), Rule("method-camel-case", "naming_convention", {"kind": "method", "pattern": "^[a-z][a-zA-Z0-9]*$"}), Rule("max-complexity", "max_complexity", {"max": 10}), Rule("max-parameters", "max_parameters", {"max": 5}), Rule("max-class-lines", "max_lines", {"kind": "class", "max": 200}), Rule("missing-return-type", "missing_return_type", {"scope": "public"})],
}


def select_rules(rules: list[Rule], include: list[str] | None = None, exclude: list[str] | None = None, override: dict[str, dict] | None = None) -> list[Rule]:
    """Whitelist, then blacklist, then overrides of severity (``info`` becomes a warning) and config."""
    out = []
    for r in rules:
        if (include and r.name not in include) or r.name in (exclude or []):
            continue
        o = (override or {}).get(r.name, {})
        severity = o.get("severity", r.severity)
        out.append(Rule(r.name, r.type, {**r.config, **o.get("config", {})}, "warning" if severity == "info" else severity))
    return out


def layer_matrix(symbols: DataFrame, edges: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Edges between different layers that the matrix does not allow; symbols without a layer are left out."""
    pairs = sorted({f"{a}>{b}" for a, bs in allowed.items() for b in bs})
    layer = symbols.where("layer is not null").select("id", "layer")
    j = edges.select("source_id", "target_id").distinct().join(layer.select(F.col("id").alias("source_id"), F.col("layer").alias("source_layer")), "source_id").join(layer.select(F.col("id").alias("target_id"), F.col("layer").alias("target_layer")), "target_id")
    return j.where((F.col("source_layer") != F.col("target_layer")) & ~F.concat_ws(">", "source_layer", "target_layer").isin(pairs)).groupBy("source_layer", "target_layer").agg(F.count(F.lit(1)).alias("n"))


# Kinds that are entry points, and kinds whose lack of references means dead code
ENTRY_KINDS = ("test", "mock", "migration", "middleware", "controller", "listener")
EXECUTABLE_KINDS = ("function", "method", "class", "abstract_class", "constructor", "getter", "setter", "event", "service", "controller", "listener")


def dead_code(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Top-level executable symbols nobody refers to; unknown export status counts as exported."""
    own = symbols.where(F.col("parent").isNull() & ~F.coalesce(~F.col("exported"), F.lit(False)) & F.col("kind").isin(*EXECUTABLE_KINDS) & ~F.col("kind").isin(*ENTRY_KINDS))
    own = own.where(~F.col("file").contains("tests/") & ~F.col("file").contains("/fixtures/") & ~F.col("file").contains("site/shared"))
    free = own.join(edges.select(F.col("target_id").alias("id")), "id", "left_anti").join(symbols.select(F.col("parent").alias("id")), "id", "left_anti")
    return free.select("id", "name", "file")


def orphan_docs(mappings: DataFrame, symbols: DataFrame) -> DataFrame:
    """Mappings whose name is neither the name nor the id of a symbol: two anti joins, never an OR join."""
    return mappings.join(symbols.select(F.col("name").alias("symbol_name")), "symbol_name", "left_anti").join(symbols.select(F.col("id").alias("symbol_name")), "symbol_name", "left_anti").select("symbol_name", "doc_path")


def mark_dead(symbols: DataFrame, dead: DataFrame) -> DataFrame:
    """``violations`` with ``dead_code`` appended once for the dead ones."""
    flag = symbols.join(dead.select("id").withColumn("_d", F.lit(True)), "id", "left")
    return flag.withColumn("violations", F.when(F.col("_d"), F.array_union(F.coalesce("violations", F.array().cast("array<string>")), F.array(F.lit("dead_code")))).otherwise(F.col("violations"))).drop("_d")


def named(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """Violations with the name and kind of their symbol, null where it is gone."""
    return found.join(symbols.select(F.col("id").alias("symbol_id"), "name", "kind"), "symbol_id", "left")


def without_ignored(found: DataFrame, ignore: dict[str, list[str]]) -> DataFrame:
    """Violations minus those in paths that their language ignores; unknown languages keep all."""
    from lodegraph.functions.exprs import language_of

    drop = F.lit(False)
    for lang, patterns in ignore.items():
        drop = drop | (F.coalesce(language_of("file") == lang, F.lit(False)) & ignored("file", patterns))
    return found.where(~drop)


def custom_rule(files: DataFrame, check, name: str, severity: str = "warning") -> DataFrame:
    """(rule, file, n, severity) where a user's ``check(content, path) -> int`` counts anything; its errors count nothing."""
    from collections.abc import Iterator

    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for p, t in zip(f["path"], f["content"]):
                try:
                    n = int(check(t or "", p) or 0)
                except Exception:  # a user's rule must not end the job
                    n = 0
                if n > 0:
                    out.append((name, p, n, severity))
            if out:
                yield pd.DataFrame(out, columns=["rule", "file", "n", "severity"])

    return files.select("path", "content").mapInPandas(run, "rule string, file string, n long, severity string")


def review(symbols: DataFrame, mappings: DataFrame, found: DataFrame) -> DataFrame:
    """(topic, key, n): violations per severity and rule, documentation rows, complex and dead symbols."""
    parts = [
        found.groupBy(F.lit("severity").alias("topic"), F.col("severity").alias("key")).agg(F.count(F.lit(1)).alias("n")),
        found.groupBy(F.lit("rule").alias("topic"), F.col("rule").alias("key")).agg(F.count(F.lit(1)).alias("n")),
        symbols.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("metrics.cyclomaticComplexity") > 10).alias("complex"), F.count_if(F.array_contains("violations", "dead_code")).alias("dead")).select(F.explode(F.create_map(F.lit("symbols"), F.col("all"), F.lit("complex"), F.col("complex"), F.lit("dead"), F.col("dead"))).alias("key", "n")).select(F.lit("symbols").alias("topic"), "key", "n"),
        mappings.agg(F.count(F.lit(1)).alias("n")).select(F.lit("symbols").alias("topic"), F.lit("documented").alias("key"), "n"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
