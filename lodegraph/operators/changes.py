"""Snapshot diffs, change impact, document guard and document updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


LINE_BLOCK = 1000


def _last(df: DataFrame, side: str) -> DataFrame:
    cols = F.struct("seq", "id", "file", "start_line", "end_line", "signature")
    return df.groupBy("name", "kind").agg(F.max(cols).alias(side))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, kind, change, details, file, start_line, end_line, id) between two symbol snapshots.

    Keyed on name and kind, the last row of a key wins. A change of signature (both known) goes
    before one of size, that before a move; equal symbols are left out.
    """
    j = _last(old, "o").join(_last(new, "n"), ["name", "kind"], "full_outer")
    o, n = F.col("o"), F.col("n")
    size_o, size_n = o["end_line"] - o["start_line"], n["end_line"] - n["start_line"]
    change = (
        F.when(o.isNull(), "added").when(n.isNull(), "removed")
        .when(o["signature"].isNotNull() & n["signature"].isNotNull() & (o["signature"] != n["signature"]), "signature_changed")
        .when(size_o != size_n, "body_changed")
        .when((o["start_line"] != n["start_line"]) | (o["end_line"] != n["end_line"]), "moved")
    )
    text = (
        F.when(F.col("change") == "added", F.format_string('added %s "%s"', "kind", "name")).when(F.col("change") == "removed", F.format_string('removed %s "%s"', "kind", "name"))
        .when(F.col("change") == "signature_changed", F.format_string('signature changed for %s "%s"', "kind", "name"))
        .when(F.col("change") == "body_changed", F.format_string("body size changed (%d → %d lines)", size_o + 1, size_n + 1))
        .otherwise(F.format_string("moved from line %d to %d", o["start_line"], n["start_line"]))
    )
    at = F.coalesce(n, o)
    return j.withColumn("change", change).where("change is not null").select("name", "kind", "change", text.alias("details"), at["id"].alias("id"), at["file"].alias("file"), at["start_line"].alias("start_line"), at["end_line"].alias("end_line"))


def overlaps(start: Column, end: Column) -> Column:
    """A hunk meets a symbol; the line right after the hunk still counts."""
    return (F.col("new_start") <= end) & (F.col("new_start") + F.col("new_lines") >= start)


def change_impact(diff: DataFrame, hunks: DataFrame) -> DataFrame:
    """Changes that are additions, removals, or touch a hunk (file, idx, new_start, new_lines, content), with the text of their hunks."""
    # hunks and symbols meet in blocks of lines, so a long file is spread; the first block that both touch counts the pair once
    blocks = lambda lo, hi: F.explode(F.sequence(F.floor(lo / LINE_BLOCK).cast("long"), F.floor(F.greatest(lo, hi) / LINE_BLOCK).cast("long")))
    h = hunks.select("file", "idx", "new_start", "new_lines", "content").withColumn("block", blocks(F.col("new_start"), F.col("new_start") + F.col("new_lines")))
    spans = diff.where("start_line is not null and end_line is not null").withColumn("block", blocks(F.col("start_line"), F.col("end_line")))
    met = spans.join(h, ["file", "block"]).where(overlaps(F.col("start_line"), F.col("end_line")) & (F.col("block") == F.floor(F.greatest("start_line", "new_start") / LINE_BLOCK)))
    hit = met.groupBy("name", "kind").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "content"))), lambda x: x["content"]), "\n").alias("diff"))
    j = diff.join(hit, ["name", "kind"], "left").where(F.col("change").isin("added", "removed") | F.col("diff").isNotNull())
    return j.select("name", "kind", "change", F.coalesce("diff", F.lit("")).alias("diff"), F.col("change").isin("added", "removed", "signature_changed").alias("doc_update_required"))


def doc_guard(changed: DataFrame, mappings: DataFrame, changed_docs: DataFrame) -> DataFrame:
    """Changed symbols (column name) none of whose mapped documents changed as well."""
    ok = mappings.select(F.col("symbol_name").alias("name"), "doc_path").join(changed_docs.select("doc_path"), "doc_path", "left_semi").select("name").distinct()
    return changed.join(ok, "name", "left_anti")


def doc_updates(impacts: DataFrame, mappings: DataFrame) -> DataFrame:
    """(doc_path, name, change, action): what each mapped document needs for each impact."""
    j = impacts.join(mappings.select(F.col("symbol_name").alias("name"), "doc_path", "section"), "name")
    action = F.when(F.col("change") == "removed", "removed").when(F.col("doc_update_required"), "updated").otherwise("skipped")
    return j.select("doc_path", "name", "change", "section", action.alias("action"))


def line_diff(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """Lines that differ at the same position of two versions of a text."""
    def lines(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.posexplode(F.split(text, "\n")).alias("line", name))

    j = lines(old, "before").join(lines(new, "after"), [key, "line"], "full_outer")
    return j.where(~F.col("before").eqNullSafe(F.col("after"))).select(key, (F.col("line") + 1).alias("line"), "before", "after")


def incremental(previous: DataFrame, now: DataFrame) -> DataFrame:
    """(path, status) by content hash: added, changed, unchanged, removed."""
    j = previous.select("path", F.col("hash").alias("a")).join(now.select("path", F.col("hash").alias("b")), "path", "full_outer")
    status = F.when(F.col("a").isNull() & F.col("b").isNotNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("changed")
    return j.select("path", status.alias("status"))


def carry_explanations(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, explanation, hash): explanations go over to the new rows whose hash is unchanged."""
    o = old.select("id", F.col("explanation").alias("e"), F.col("hash").alias("h"))
    return new.select("id", "hash").join(o, "id", "left").select("id", F.when(F.col("h") == F.col("hash"), F.col("e")).alias("explanation"), "hash")


def keep_last(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Upsert semantics: of the rows of a key the one written last."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
