"""Sorts, top-k, pages, windows over keys, and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from eventlens.functions.time import BASIS_CLOCK, local_day
from eventlens.operators.filters import backed_by_evidence, basis_value, high_severity, is_fresh
from eventlens.sources.lineage import cut, small


def order_events(df: DataFrame, basis: str) -> DataFrame:
    return df.orderBy(F.desc("severity"), F.desc_nulls_first(BASIS_CLOCK[basis]), "id")


def sort_facts(df: DataFrame, basis: str) -> DataFrame:
    severity = F.when(F.col("severity").between(0, 4), F.col("severity")).otherwise(0)
    return df.orderBy(severity.desc(), F.desc_nulls_last(BASIS_CLOCK[basis]), "id")


def top_facts(df: DataFrame, basis: str, n: int = 30) -> DataFrame:
    return sort_facts(df, basis).limit(n)


def order_view(df: DataFrame, clock: str = "source_updated_at") -> DataFrame:
    return df.orderBy(F.desc_nulls_last(clock), "id")


def page(df: DataFrame, after: tuple | None, size: int = 60, clock: str = "issued_at") -> DataFrame:
    """Keyset page in view order: rows after (clock, id), so that no rows are counted off."""
    if after is not None:
        at, key = F.lit(after[0]).cast("timestamp"), F.lit(after[1])
        c = F.col(clock)
        df = df.where((c.isNull() & (at.isNotNull() | (F.col("id") > key)) & F.when(at.isNull(), F.col("id") > key).otherwise(F.lit(True))) | (c < at) | ((c == at) & (F.col("id") > key)))
    return df.orderBy(F.desc_nulls_last(clock), "id").limit(size)


def cited_relations(relations: DataFrame, fact_ids: DataFrame, n: int = 10) -> DataFrame:
    """Relations whose two ends are both among the facts, each unordered pair once, nearest first."""
    ids = fact_ids.select("id").distinct()
    pairs = relations.select(F.least("event_a", "event_b").alias("event_a"), F.greatest("event_a", "event_b").alias("event_b"), "relation_type", "time_delta_hours", "distance_km").dropDuplicates(["event_a", "event_b", "relation_type"])
    for side in ("event_a", "event_b"):
        pairs = pairs.join(ids.withColumnRenamed("id", side), side, "left_semi")
    return pairs.orderBy("time_delta_hours", "distance_km", "event_a", "event_b", "relation_type").limit(n)


def newest_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 30) -> DataFrame:
    """The first n rows of each key; used for revisions, relations, materials and representatives."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def recent_revisions(revisions: DataFrame, n: int = 30) -> DataFrame:
    return newest_per_key(revisions, ["event_id"], [F.desc("changed_at"), F.desc("revision_id")], n)


def recent_relations(relations: DataFrame, n: int = 30) -> DataFrame:
    both = relations.select(F.col("event_a").alias("id"), F.col("event_b").alias("other"), "relation_type", "distance_km", "time_delta_hours", "created_at")
    both = both.unionByName(both.select(F.col("other").alias("id"), F.col("id").alias("other"), "relation_type", "distance_km", "time_delta_hours", "created_at"))
    return newest_per_key(both, ["id"], [F.desc("created_at"), F.asc("other"), F.asc("relation_type")], n)


def revision_chain(observations: DataFrame, keys: list[str], clock: str) -> DataFrame:
    """Version number, previous clock and seconds to the next version of each record."""
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_first(clock), "observation_id")
    nxt = F.lead(clock).over(w)
    return observations.withColumns({"version_no": F.row_number().over(w), "previous_at": F.lag(clock).over(w), "seconds_to_next": F.unix_timestamp(nxt) - F.unix_timestamp(clock)})


def has_newer(observations: DataFrame, keys: list[str], clock: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_first(clock), "observation_id")
    return observations.withColumn("has_newer", F.lead("observation_id").over(w).isNotNull())


def high_water(df: DataFrame, keys: list[str], clock: str, order: str, width: float = 86_400) -> DataFrame:
    """The greatest clock among earlier rows of a key.

    A key's rows are dealt by runs of `width` in order (seconds, for a timestamp): the greatest clock of each run, those
    of the runs before it, and a window within the run; so no task holds a hot key's rows.
    """
    at = F.unix_timestamp(order) if isinstance(df.schema[order].dataType, TimestampType) else F.col(order).cast("double")
    runs = df.withColumn("__run", F.floor(at / width))
    per = runs.groupBy(*keys, "__run").agg(F.max(clock).alias("__top"))
    before = F.max("__top").over(Window.partitionBy(*keys).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select(*(F.col(k).alias(f"__of_{k}") for k in keys), F.col("__run").alias("__of_run"), before.alias("__before"))
    joined = runs.join(per, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys] + [F.col("__run").eqNullSafe(F.col("__of_run"))])
    inside = F.max(clock).over(Window.partitionBy(*keys, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return joined.withColumn("high_water", F.greatest("__before", inside)).select(*df.columns, "high_water")


def timeline_by_day(df: DataFrame, tz: str = "UTC") -> DataFrame:
    """Rows per local day of the row's own basis clock, newest first, the undated last."""
    return df.groupBy(local_day(basis_value(), tz).alias("day")).agg(F.count("*").alias("n"), F.max("severity").alias("max_severity")).orderBy(F.desc_nulls_last("day"))


def highlights(df: DataFrame, since, until, n: int = 8, relations: DataFrame | None = None, keys: list[str] | None = None, sources: list[str] | None = None) -> DataFrame:
    """Up to n rows per key: one of each category, then fresh ones, sources not yet shown first; no repeats.

    A repeat has the category, trimmed title and countries of a row picked before, or is related to it as possibly the
    same. With `sources`, only rows count that evidence of one of these sources backs, retrieved by `until`.

    Order: fresh, high source severity, newest basis clock, id. Of rows that repeat one another, name the same sources
    and have no twin the best one stands for all. A pick depends on earlier ones, so each of the n rounds is a grouped
    minimum over all rows that are still allowed; no rank cuts them and no task sorts them.
    """
    if sources is not None:
        df = df.where(backed_by_evidence(until, sources))
    keys = keys or []
    one = [*keys, "__all"]
    of = [F.col(k).alias(f"__of_{k}") for k in one]
    low = lambda c: -F.coalesce(c.cast("int"), F.lit(-1))
    clock = F.unix_micros(basis_value().cast("timestamp"))
    rank = F.struct(low(is_fresh(since, until)).alias("fresh"), low(high_severity()).alias("high"), clock.isNull().alias("undated"), (-clock).alias("clock"), "id")
    none = F.array().cast("array<string>")
    d = df.select(*keys, F.lit(1).alias("__all"), "id", "category", F.array_sort(F.coalesce("source_ids", none)).alias("source_ids"), F.concat_ws("|", "category", F.trim("title"), F.array_join(F.array_sort("countries"), ",")).alias("repeat_key"), rank.alias("rank"))
    twins = None
    if relations is not None:
        same = relations.where("relation_type = 'possible_same_event'")
        twins = cut(same.select(F.col("event_a").alias("id"), F.col("event_b").alias("o")).union(same.select("event_b", "event_a")).distinct())
        d = d.join(twins.select("id", F.col("id").alias("twin")).distinct(), "id", "left")
    else:
        d = d.withColumn("twin", F.lit(None).cast("string"))
    d = cut(d.groupBy(*one, "category", "repeat_key", "source_ids", "twin").agg(F.min("rank").alias("rank")).drop("twin"))
    taken = None
    for position in range(1, n + 1):
        rest, shown = d, none
        step = F.lit(0)
        if taken is not None:
            state = taken.groupBy(*of).agg(F.collect_set("category").alias("categories"), F.collect_set("repeat_key").alias("seen"), F.flatten(F.collect_list(F.when(F.col("step") == "category", F.col("source_ids")))).alias("shown"))
            rest = d.join(small(state), [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in one], "left").drop(*(f"__of_{k}" for k in one)).where(~F.coalesce(F.array_contains("seen", F.col("repeat_key")), F.lit(False)))
            step = F.when(F.coalesce(F.array_contains("categories", F.col("category")), F.lit(False)), 1).otherwise(0)
            shown = F.coalesce("shown", none)
            if twins is not None:
                blocked = taken.join(twins, "id").select(*of, F.col("o").alias("__id")).distinct()
                rest = rest.join(blocked, [*(F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in one), F.col("rank.id") == F.col("__id")], "left_anti")
        rest = rest.withColumns({"step": step, "known": F.when(step == 1, F.arrays_overlap("source_ids", shown)).otherwise(False)}).where((F.col("step") == 0) | (F.col("rank.fresh") == -1))
        best = rest.groupBy(*one).agg(F.min(F.struct("step", "known", "rank", "category", "repeat_key", "source_ids")).alias("x"))
        best = cut(best.select(*one, F.col("x.rank.id").alias("id"), F.when(F.col("x.step") == 0, "category").otherwise("fill").alias("step"), F.lit(position).alias("position"), "x.category", "x.repeat_key", "x.source_ids"))
        taken = best if taken is None else taken.unionByName(best)
        if best.isEmpty():
            break
    return taken.select(*keys, "id", "step", "position")


def briefing_pick(df: DataFrame, ids: DataFrame, n: int = 12) -> tuple[DataFrame, DataFrame]:
    """(rows of the first n distinct picked ids that are in scope, ids that are not)."""
    wanted = ids.select("id").distinct()
    found = df.join(wanted, "id", "left_semi")
    return newest_per_key(found.withColumn("__one", F.lit(1)), ["__one"], [F.asc("id")], n).drop("__one"), wanted.join(df, "id", "left_anti")


def intersect_views(*frames: DataFrame) -> DataFrame:
    """Ids that all frames hold."""
    out = frames[0].select("id").distinct()
    for f in frames[1:]:
        out = out.join(f.select("id").distinct(), "id", "left_semi")
    return out
