"""Ticket references and the traceability matrix; API endpoints in code against a specification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: what a ticket looks like
TICKET = "[A-Z][A-Z0-9]+-[0-9]+"


def commit_refs(commits: DataFrame) -> DataFrame:
    """(ticket, file): tickets named in a message, for every file of the commit (message, files)."""
    t = commits.select("files", F.explode(F.array_distinct(F.regexp_extract_all("message", F.lit(TICKET), F.lit(0)))).alias("ticket"))
    return t.select("ticket", F.explode("files").alias("file")).distinct()


def comment_refs(files: DataFrame) -> DataFrame:
    """(ticket, file, line) of ``// ref: TICKET`` comments in (file, content)."""
    lines = files.select("file", F.posexplode(F.split("content", "\n")).alias("at", "text")).where(F.col("text").contains("ref:"))
    found = F.regexp_extract_all("text", F.lit(r"//\s*ref:\s*(" + TICKET + ")"), F.lit(1))
    return lines.select("file", (F.col("at") + 1).alias("line"), F.explode(found).alias("ticket")).select("ticket", "file", "line")


def matrix(refs: DataFrame, symbols: DataFrame, mappings: DataFrame) -> DataFrame:
    """(ticket, role, value): the symbols, test files and documents of each ticket, a row each (refs: ticket, file)."""
    test = F.lower("file").rlike(r"\.(test|spec)\.|(^|/)tests?/")
    r = refs.select("ticket", "file").distinct()
    s = r.join(symbols.select("file", "name"), "file")
    d = s.join(mappings.select(F.col("symbol_name").alias("name"), "doc_path"), "name")
    parts = [s.where(~test).select("ticket", F.lit("symbol").alias("role"), F.col("name").alias("value")), r.where(test).select("ticket", F.lit("test").alias("role"), F.col("file").alias("value")), d.select("ticket", F.lit("doc").alias("role"), F.col("doc_path").alias("value"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("value is not null").distinct()


def of_tickets(matrix_: DataFrame, tickets: DataFrame) -> DataFrame:
    """Rows of the matrix for some tickets (column ticket)."""
    return matrix_.join(tickets.select("ticket").distinct(), "ticket", "left_semi")


def endpoints_in_code(symbols: DataFrame) -> DataFrame:
    """(endpoint, method, path, params, response, symbol_id) from the route tags of controller methods."""
    ctl = symbols.where((F.col("kind") == "controller") | F.col("name").rlike("(?i)Controller$")).select(F.col("id").alias("parent"))
    m = symbols.where("kind = 'method'").join(ctl, "parent", "left_semi").select("id", "signature", "summary", F.explode("tags").alias("tag")).where(F.col("tag").rlike(r"(?i)^(GET|POST|PUT|DELETE|PATCH)\s+(.+)$"))
    method, path = F.upper(F.regexp_extract("tag", r"(?i)^(GET|POST|PUT|DELETE|PATCH)\s+(.+)$", 1)), F.regexp_extract("tag", r"(?i)^(GET|POST|PUT|DELETE|PATCH)\s+(.+)$", 2)
    sig = F.coalesce("signature", F.lit(""))
    names, types = F.regexp_extract_all(sig, F.lit(r"(\w+)\s*:\s*(\w+)"), F.lit(1)), F.regexp_extract_all(sig, F.lit(r"(\w+)\s*:\s*(\w+)"), F.lit(2))
    return m.select(method.alias("method"), path.alias("path"), F.map_from_entries(F.array_distinct(F.arrays_zip(names.alias("k"), types.alias("v")))).alias("params"), F.nullif(F.regexp_extract(F.coalesce("summary", F.lit("")), r"(?i)returns?\s+(\w+)", 1), F.lit("")).alias("response"), F.col("id").alias("symbol_id"))


def compare_apis(code: DataFrame, spec: DataFrame) -> DataFrame:
    """(type, endpoint, details) between two endpoint frames (method, path, params map, response, symbol_id): full outer joins."""
    from lodegraph.functions.exprs import endpoint_key

    def keyed(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(endpoint_key("method", "path").alias("endpoint")).agg(F.max_by(F.struct("params", "response", "symbol_id"), "symbol_id").alias(side))

    j = keyed(code, "c").join(keyed(spec, "s"), "endpoint", "full_outer")
    c, s = F.col("c"), F.col("s")
    # Kinds and texts of the discrepancies
    missing = j.where("c is null or s is null").select(F.when(s.isNull(), "missing_in_spec").otherwise("missing_in_code").alias("type"), "endpoint", F.when(s.isNull(), F.format_string("Exists in code (%s) but not in spec", c["symbol_id"])).otherwise(F.format_string("Exists in spec (%s) but not in code", s["symbol_id"])).alias("details"))
    both = j.where("c is not null and s is not null")
    names = both.select("endpoint", F.explode(F.array_union(F.map_keys(c["params"]), F.map_keys(s["params"]))).alias("p"), c["params"].alias("cp"), s["params"].alias("sp"))
    a, b = F.try_element_at("cp", F.col("p")), F.try_element_at("sp", F.col("p"))
    text = F.when(b.isNull(), F.format_string("Parameter '%s' exists in code but missing in spec", "p")).when(a.isNull(), F.format_string("Parameter '%s' exists in spec but missing in code", "p")).when(a != b, F.format_string("Parameter '%s' type mismatch: code='%s' spec='%s'", "p", a, b))
    params = names.select(F.lit("type_mismatch").alias("type"), "endpoint", text.alias("details")).where("details is not null")
    resp = both.where(c["response"] != s["response"]).select(F.lit("type_mismatch").alias("type"), "endpoint", F.format_string("Response type mismatch: code='%s' spec='%s'", c["response"], s["response"]).alias("details"))
    return missing.unionByName(params).unionByName(resp)
