"""Parent links between sessions: resolution, roots, and roll-ups by root."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.classify import share, zero
from strata.sources.store import staged


def resolve_parents(sessions: DataFrame) -> DataFrame:
    """session_id, parent_session_id: raw thread parents as canonical session ids.

    The parent is the earliest session of the same user and source whose thread is named, never the
    session itself; a parent id that names a session already stays; anything else becomes null.
    """
    thread = ["username", "source", "raw"]
    named = sessions.select("session_id", "username", "source", F.col("parent_thread_id").alias("raw"))
    parents = sessions.filter("session_id is not null").select("username", "source", F.col("thread_id").alias("raw"), F.struct(F.coalesce("first_timestamp", F.lit("")).alias("pts"), F.col("session_id").alias("pid")).alias("p"))
    # Of a thread's sessions the two earliest are all that its children can have: the second is for the first itself.
    first = parents.groupBy(*thread).agg(F.min("p").alias("a"))
    second = parents.join(first, thread).filter("p.pid <> a.pid").groupBy(*thread).agg(F.min("p").alias("b"))
    found = named.join(first.join(second, thread, "left"), thread).withColumn("p", F.when(F.col("a.pid") != F.col("session_id"), F.col("a")).otherwise(F.col("b")))
    by_thread = found.groupBy("session_id").agg(F.min("p").alias("p")).select("session_id", F.col("p.pid").alias("by_thread"))
    by_id = named.join(sessions.select(F.col("session_id").alias("by_id")), (F.col("raw") == F.col("by_id")) & (F.col("session_id") != F.col("by_id")), "left").select("session_id", "by_id")
    return by_id.join(by_thread, "session_id", "left").select("session_id", F.coalesce("by_thread", "by_id").alias("parent_session_id"))


def roots(edges: DataFrame, most_rounds: int = 32) -> DataFrame:
    """session_id, root_session_id, depth of nodes (session_id, parent_session_id) by pointer jumping.

    Depth doubles in each round, so `most_rounds` bounds it at 2 ** rounds. Nodes whose chain leaves the
    table have no root and are left out; a cycle raises.
    """
    held = edges.select("session_id", F.col("parent_session_id").alias("up"), F.when(F.col("parent_session_id").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    for _ in range(most_rounds):
        held = staged(held, "jumps")
        if held.filter("up is not null").isEmpty():
            return held.select("session_id", F.col("top").alias("root_session_id"), "depth") if "top" in held.columns else held.select("session_id", F.col("session_id").alias("root_session_id"), "depth")
        top = F.col("top") if "top" in held.columns else F.when(F.col("up").isNull(), F.col("session_id"))
        held = held.withColumn("top", top)
        above = held.select(F.col("session_id").alias("a"), F.col("up").alias("aup"), F.col("depth").alias("adepth"), F.col("top").alias("atop"))
        met = held.join(above, F.col("up") == F.col("a"), "left").filter("up is null or a is not null")
        held = met.select("session_id", F.when(F.col("up").isNotNull(), F.col("aup")).alias("up"), (F.col("depth") + zero(F.col("adepth"))).alias("depth"), F.coalesce("top", "atop").alias("top"))
    raise ValueError("lineage has a cycle")


def context_explosions(sessions: DataFrame, least_children: int = 2, least_tokens: int = 250_000_000, children: int = 4) -> DataFrame:
    """Roots with several descendants and very many input tokens, and their largest descendants.

    `sessions` holds session_id, parent_session_id (validated) and total_input_tokens.
    """
    rooted = roots(sessions.select("session_id", "parent_session_id"))
    rows = sessions.select("session_id", "total_input_tokens").join(rooted, "session_id")
    below = F.col("session_id") != F.col("root_session_id")
    sums = rows.groupBy("root_session_id").agg(
        F.sum("total_input_tokens").cast("long").alias("tokens"), F.sum(F.when(below, 1).otherwise(0)).cast("long").alias("children"),
        F.max("depth").alias("max_depth"), F.sum(F.when(below, F.col("total_input_tokens")).otherwise(0)).cast("long").alias("child_tokens"))
    kept = sums.filter((F.col("children") >= least_children) & (F.col("tokens") >= least_tokens))
    rank = F.row_number().over(Window.partitionBy("root_session_id").orderBy(F.desc("total_input_tokens"), "session_id"))
    top = rows.filter(below).withColumn("rank", rank).filter(F.col("rank") <= children)
    wide = top.groupBy("root_session_id").agg(*[F.max(F.when(F.col("rank") == k, F.col("session_id"))).alias(f"child_{k}") for k in range(1, children + 1)])
    shares = share(F.col("child_tokens"), F.col("tokens"))
    warned = F.concat_ws("; ", F.when(F.col("children") >= 10, "many children"), F.when(F.col("max_depth") >= 3, "deep chain"), F.when(shares >= 80, "children use most tokens"))
    return kept.join(wide, "root_session_id", "left").withColumn("child_share", shares).withColumn("warnings", warned).orderBy(F.desc("tokens"), "root_session_id")


# What a workstream is warned of, by its counters.
HEAVY, SHOWN, CHILDREN = 250_000_000, 6, 4


def workstreams(sessions: DataFrame, since: str, source: str = "codex", least_children: int = 2, least_tokens: int = HEAVY, limit: int = SHOWN) -> DataFrame:
    """Roots whose descendants since a time stamp used very many tokens, heaviest first.

    Only sessions of the given rows count, ancestors too: pass those that may be listed. One grouping sums a root's recent
    sessions, and one more takes its `CHILDREN` largest.
    """
    rooted = roots(sessions.select("session_id", "parent_session_id")).select("session_id", "root_session_id")
    whole = zero(F.col("total_input_tokens")) + zero(F.col("total_output_tokens"))
    recent = sessions.filter((F.col("source") == source) & (F.col("first_timestamp") >= since)).join(rooted, "session_id")
    rows = recent.select("session_id", "root_session_id", whole.alias("tokens"), *[zero(F.col(c)).alias(c) for c in ("total_input_tokens", "fresh_input_tokens", "cached_input_tokens", "total_output_tokens", "spawn_depth")])
    child = F.col("session_id") != F.col("root_session_id")
    total = lambda c: F.sum(c).cast("long")
    sums = rows.groupBy("root_session_id").agg(
        total("tokens").alias("total_tokens"), *[total(c).alias(c) for c in ("total_input_tokens", "fresh_input_tokens", "cached_input_tokens", "total_output_tokens")], F.count(F.lit(1)).alias("session_count"),
        total(child.cast("int")).alias("child_session_count"), F.max("spawn_depth").alias("max_spawn_depth"), zero(F.max(F.when(child, F.col("tokens")))).alias("top_child_tokens"), zero(total(F.when(child, F.col("tokens")))).alias("child_token_burden"))
    top = sums.filter((F.col("child_session_count") >= least_children) & (F.col("total_tokens") >= least_tokens)).orderBy(F.desc("total_tokens"), "root_session_id").limit(limit)
    rank = F.row_number().over(Window.partitionBy("root_session_id").orderBy(F.desc("tokens"), "session_id"))
    largest = rows.filter(child).join(F.broadcast(top.select("root_session_id")), "root_session_id").withColumn("rank", rank).filter(F.col("rank") <= CHILDREN)  # `limit` roots
    largest = largest.groupBy("root_session_id").agg(F.array_sort(F.collect_list(F.struct("rank", "session_id", "tokens"))).alias("top_children"))
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = top.withColumns({"cached_input_share": part("cached_input_tokens", "total_input_tokens"), "child_token_share": part("child_token_burden", "total_tokens")})
    warned = F.array_compact(F.array(
        F.when(F.col("cached_input_share") >= 0.9, "mostly inherited context"), F.when(F.col("child_session_count") >= 8, "fork swarm"),
        F.when(F.col("top_child_tokens") >= 500_000_000, "giant child sessions"), F.when(F.col("max_spawn_depth") >= 2, F.concat(F.lit("spawn depth "), "max_spawn_depth"))))
    return out.withColumn("warnings", warned).join(largest, "root_session_id", "left").orderBy(F.desc("total_tokens"), "root_session_id")
