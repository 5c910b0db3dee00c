"""Design patterns and event flows found by joins over symbols and edges.

Every detector gives a row per member: (kind, primary, member, confidence, violations), the
primary being a member of its own pattern. Members are never gathered into lists, so a class
with a third of all methods is as cheap as any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def none() -> Column:
    return F.array().cast("array<string>")


def _note(*pairs: tuple[Column, Column]) -> Column:
    return F.filter(F.array(*[F.when(c, t) for c, t in pairs]), lambda x: x.isNotNull())


def _rows(kind: str, found: DataFrame, members: DataFrame) -> DataFrame:
    """``found`` (primary, confidence, violations) with its ``members`` (primary, member) and the primary itself."""
    all_ = members.select("primary", "member").unionByName(found.select("primary", F.col("primary").alias("member"))).distinct()
    return all_.join(found, "primary").select(F.lit(kind).alias("kind"), "primary", "member", "confidence", "violations")


def listeners_of(symbols: DataFrame, edges: DataFrame, event_kinds: tuple, listener_kinds: tuple) -> DataFrame:
    """(id, listener): by an edge in either direction, or by the event's base name inside the listener's name.

    Both parts are equi joins: the name part compares the substrings of listener names that
    have the length of some event's base name, so no nested loop over all pairs is needed.
    """
    ev = symbols.where(F.col("kind").isin(*event_kinds)).select("id", F.lower(F.regexp_replace("name", "Events?$", "")).alias("base"))
    li = symbols.where(F.col("kind").isin(*listener_kinds)).select(F.col("id").alias("listener"), F.lower("name").alias("l_name"))
    both = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).distinct()
    sides = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    by_edge = sides.join(ev.select(F.col("id").alias("a")), "a", "left_semi").join(li.select(F.col("listener").alias("b")), "b", "left_semi").select(F.col("a").alias("id"), F.col("b").alias("listener"))
    # every substring of a listener's name that is as long as some base: an equi join instead of a nested loop
    sizes = [r.n for r in ev.where("base <> ''").select(F.length("base").alias("n")).distinct().collect()]  # a row per length of a name

    def cuts(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length("l_name") - n + 1)
        return F.when(F.length("l_name") >= n, F.transform(starts, lambda i: F.substr("l_name", i, F.lit(n)))).otherwise(none())

    subs = li.select("listener", F.explode(F.array_distinct(F.flatten(F.array(*[cuts(n) for n in sizes]))) if sizes else none()).alias("base"))
    by_name = ev.where("base <> ''").join(subs, "base").select("id", "listener")
    return by_edge.unionByName(by_name).distinct()


def observer(symbols: DataFrame, edges: DataFrame, event_kinds: tuple = ("event",), listener_kinds: tuple = ("listener",)) -> DataFrame:
    pairs = listeners_of(symbols, edges, event_kinds, listener_kinds).select(F.col("id").alias("primary"), F.col("listener").alias("member"))
    ev = symbols.where(F.col("kind").isin(*event_kinds)).select(F.col("id").alias("primary"), "name").join(pairs.select("primary").distinct().withColumn("some", F.lit(True)), "primary", "left")
    some = F.coalesce("some", F.lit(False))
    found = ev.select("primary", F.when(some, 0.9).otherwise(0.6).alias("confidence"), _note((~some, F.format_string("No listeners found for event '%s'", "name"))).alias("violations"))
    return _rows("observer", found, pairs)


def factory(symbols: DataFrame, edges: DataFrame, verbs: tuple = ("create", "build", "make", "from", "of", "new")) -> DataFrame:
    made = edges.where("type = 'instantiates'").select(F.col("source_id").alias("member")).distinct()
    kids = symbols.where((F.col("kind") == "method") & F.col("name").rlike("^(" + "|".join(verbs) + ")")).select(F.col("parent").alias("primary"), F.col("id").alias("member"))
    cls = symbols.where(F.col("kind").isin("class", "abstract_class")).select(F.col("id").alias("primary"))
    found = cls.join(kids.join(made, "member", "left_semi").select("primary").distinct(), "primary", "left_semi").select("primary", F.lit(0.9).alias("confidence"), none().alias("violations"))
    return _rows("factory", found, kids.join(found.select("primary"), "primary", "left_semi"))


def singleton(symbols: DataFrame) -> DataFrame:
    kids = symbols.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(
        F.bool_or((F.col("kind") == "constructor") & F.coalesce(F.col("visibility") == "private", F.lit(False))).alias("priv"), F.bool_or(F.col("name").isin("instance", "getInstance")).alias("inst")
    )
    c = symbols.where("kind = 'class'").select("id", "name").join(kids, "id").where("priv or inst")
    p, i = F.col("priv"), F.col("inst")
    notes = _note((p & ~i, F.format_string("Singleton '%s' has private constructor but no static instance accessor", "name")), (i & ~p, F.format_string("Singleton '%s' has static instance but constructor is not private", "name")))
    return c.select(F.lit("singleton").alias("kind"), F.col("id").alias("primary"), F.col("id").alias("member"), F.when(p & i, 0.95).otherwise(0.6).alias("confidence"), notes.alias("violations"))


def strategy(symbols: DataFrame, edges: DataFrame, interface_kinds: tuple = ("interface",), implements: DataFrame | None = None) -> DataFrame:
    """``implements`` (member, key) says who implements which id or name; by default the array column does."""
    face = symbols.where(F.col("kind").isin(*interface_kinds)).select("id", "name", "seq")
    first = face.groupBy("name").agg(F.min_by("id", "seq").alias("primary"))
    keys = face.select("name", F.col("id").alias("key")).unionByName(first.select("name", F.col("name").alias("key"))).distinct()
    said = implements if implements is not None else symbols.select(F.col("id").alias("member"), F.explode("sym_implements").alias("key"))
    impl = said.join(keys, "key").select("name", "member").distinct()
    got = impl.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    used = edges.where("type = 'uses'").select(F.col("target_id").alias("id")).distinct().join(face, "id").select("name").distinct().withColumn("used", F.lit(True))
    j = got.join(first, "name").join(used, "name", "left").withColumn("used", F.coalesce("used", F.lit(False)))
    found = j.select("name", "primary", F.when(F.col("used"), 0.85).otherwise(0.6).alias("confidence"), _note((~F.col("used"), F.format_string("Strategy interface '%s' has no detected consumer using it", "name"))).alias("violations"))
    return _rows("strategy", found.drop("name"), impl.join(found.select("name", "primary"), "name"))


def repository(symbols: DataFrame, edges: DataFrame, entity_kinds: tuple = ("entity",)) -> DataFrame:
    repo = symbols.where((F.col("kind") == "repository") | ((F.col("kind") == "class") & F.col("name").rlike("(?i)Repository$"))).select("id", "name", "kind")
    kids = symbols.where((F.col("kind") == "method") & F.lower("name").rlike("^(find|save|delete|update|get|remove|create)")).select(F.col("parent").alias("primary"), F.col("id").alias("member"))
    ent = symbols.where(F.col("kind").isin(*entity_kinds)).select(F.col("id").alias("target_id"))
    has = edges.where("type in ('uses', 'instantiates')").join(ent, "target_id", "left_semi").select(F.col("source_id").alias("id")).distinct().withColumn("entity", F.lit(True))
    j = repo.join(kids.select(F.col("primary").alias("id")).distinct().withColumn("crud", F.lit(True)), "id", "left").join(has, "id", "left")
    j = j.withColumn("entity", F.coalesce("entity", F.lit(False))).withColumn("crud", F.coalesce("crud", F.lit(False)))
    score = F.when(F.col("crud"), 4).otherwise(0) + F.when(F.col("entity"), 3).otherwise(0) + F.when(F.col("kind") == "repository", 3).otherwise(1)
    notes = _note((~F.col("crud"), F.format_string("Repository '%s' has no standard CRUD methods", "name")), (~F.col("entity"), F.format_string("Repository '%s' has no associated entity", "name")))
    found = j.select(F.col("id").alias("primary"), (F.least(score, F.lit(10)) / F.lit(10.0)).alias("confidence"), notes.alias("violations"))
    return _rows("repository", found, kids.join(found.select("primary"), "primary", "left_semi"))


def all_patterns(symbols: DataFrame, edges: DataFrame, **kinds: tuple) -> DataFrame:
    parts = [
        observer(symbols, edges, kinds.get("event_kinds", ("event",)), kinds.get("listener_kinds", ("listener",))), factory(symbols, edges, kinds.get("verbs", ("create", "build", "make", "from", "of", "new"))), singleton(symbols),
        strategy(symbols, edges, kinds.get("interface_kinds", ("interface",))), repository(symbols, edges, kinds.get("entity_kinds", ("entity",))),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def annotated(symbols: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, pattern): the last pattern a symbol is a member of, in detector order."""
    order = F.array_position(F.array(*[F.lit(k) for k in ("observer", "factory", "singleton", "strategy", "repository")]), F.col("kind"))
    m = patterns.select(F.col("member").alias("id"), F.struct(order.alias("o"), F.col("primary").alias("p"), F.col("kind").alias("k")).alias("v"))
    return m.groupBy("id").agg(F.max("v").alias("v")).select("id", F.col("v.k").alias("pattern")).join(symbols.select("id"), "id", "left_semi")


def member_names(patterns: DataFrame, symbols: DataFrame) -> DataFrame:
    """Pattern members with their names, the id where a name is missing."""
    n = symbols.select(F.col("id").alias("member"), "name")
    return patterns.join(n, "member", "left").select("kind", "primary", "member", F.coalesce("name", "member").alias("name"))


def event_flow(symbols: DataFrame, edges: DataFrame, event_kinds: tuple = ("event",), listener_kinds: tuple = ("listener",)) -> DataFrame:
    """(id, role, symbol_id, complete): a row per emitter and listener of each event, one of role ``none`` for an event without any."""
    ev = symbols.where(F.col("kind").isin(*event_kinds)).select("id", F.lower(F.regexp_replace("name", "Event$", "")).alias("base"))
    li = symbols.where(F.col("kind").isin(*listener_kinds)).select(F.col("id").alias("l"), F.lower(F.regexp_replace("name", "(Listener|Handler|Subscriber)$", "")).alias("base"))
    other = symbols.where(~F.col("kind").isin(*listener_kinds)).select(F.col("id").alias("source_id"))
    em = edges.where("type in ('uses', 'instantiates')").join(ev.select(F.col("id").alias("target_id")), "target_id", "left_semi").join(other, "source_id", "left_semi")
    a = edges.select(F.col("source_id").alias("l"), F.col("target_id").alias("id"))
    sides = a.unionByName(a.select(F.col("id").alias("l"), F.col("l").alias("id"))).distinct()
    by_edge = sides.join(li.select("l"), "l", "left_semi").join(ev.select("id"), "id", "left_semi")
    by_name = ev.where("base <> ''").join(li, "base").select("l", "id")
    rows = em.select(F.col("target_id").alias("id"), F.lit("emitter").alias("role"), F.col("source_id").alias("symbol_id")).unionByName(by_edge.select("l", "id").unionByName(by_name).select("id", F.lit("listener").alias("role"), F.col("l").alias("symbol_id"))).distinct()
    whole = rows.groupBy("id").agg((F.bool_or(F.col("role") == "emitter") & F.bool_or(F.col("role") == "listener")).alias("complete"))
    idle = ev.select("id").join(whole, "id", "left_anti").select("id", F.lit("none").alias("role"), F.lit(None).cast("string").alias("symbol_id"), F.lit(False).alias("complete"))
    return rows.join(whole, "id").select("id", "role", "symbol_id", "complete").unionByName(idle)
