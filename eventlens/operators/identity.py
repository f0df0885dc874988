"""Hard keys, identity, observations, projections and change data."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.arrays import add_tag, col, has_tag, norm_array, origin_family
from eventlens.operators.filters import _ts, category_map, effective_state
from eventlens.schemas import SOURCES
from eventlens.sources.lineage import cut_wide, small

#: Namespace of public ids (fixed value: the URL namespace of RFC 4122).
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
#: Fields of a projection that make a change of it a revision (fixed values).
PROJECTION = ("kind", "category", "title", "description", "source_url", "occurred_start", "occurred_end", "issued_at", "source_updated_at", "valid_from", "valid_to", "countries", "location_precision", "time_precision", "severity", "original_severity", "lifecycle_status", "verification_status", "tags")


def hard_keys(df: DataFrame) -> DataFrame:
    """`keys`: external ids but GLIDE numbers, the record's own key, and references of the same sender; over-long keys are dropped."""
    own = F.concat_ws(":", F.lit("record"), "source_id", "provider_record_id")
    refs = F.transform(F.coalesce("supersedes", F.array().cast("array<string>")), lambda r: F.concat(F.lit("cap:"), F.col("sender"), F.lit(":"), r))
    ids = F.filter(F.coalesce("external_ids", F.array().cast("array<string>")), lambda k: ~k.startswith("glide:"))
    return df.withColumn("keys", F.filter(norm_array(F.concat(ids, F.array(own), refs)), lambda k: F.char_length(k) <= 1200))


def payload_hash(c: Column | str) -> Column:
    return F.sha2(col(c), 256)


def source_rank() -> Column:
    """Comparable rank of a version: current, source clock, numeric episode; unknown ranks lowest."""
    clock = F.coalesce("source_updated_at", "issued_at", "occurred_start")
    current = F.when(F.col("source_id") == "gdacs", F.coalesce("is_current", F.lit(False))).otherwise(F.lit(True))  # only disasters have episodes
    return F.struct(current.alias("current"), clock.alias("clock"), F.coalesce(F.col("episode_id").try_cast("long"), F.lit(0)).alias("episode"))


def newer_normalizer(new: Column | str, old: Column | str) -> Column:
    return F.coalesce(col(new).try_cast("int") > col(old).try_cast("int"), F.lit(False))


def key_components(records: DataFrame) -> DataFrame:
    """record_id, component: records that share hard keys, transitively, with the smallest of them as the component.

    A record points to a smaller one of its component. Each round it, and the one it points to, take the least pointer
    two steps away among the records of its keys, so a chain folds up in rounds that grow with the logarithm of its
    length. A hot key is summed by a grouped minimum. Each round is cut; ends at the fixpoint only.
    """
    edges = cut_wide(records.select("record_id", F.explode("keys").alias("key")).distinct())
    up, before = edges.select("record_id", F.col("record_id").alias("component")).distinct(), None
    while True:
        two = up.join(up.select(F.col("record_id").alias("component"), F.col("component").alias("top")), "component")
        by_key = edges.join(two, "record_id").groupBy("key").agg(F.min("top").alias("low"))
        low = edges.join(by_key, "key").groupBy("record_id").agg(F.min("low").alias("low"))
        both = two.join(low, "record_id")
        moves = both.select("record_id", F.least("component", "top", "low").alias("component")).union(both.select("component", "low"))
        up = cut_wide(moves.groupBy("record_id").agg(F.min("component").alias("component")))
        now = up.agg(F.sum(F.xxhash64("record_id", "component").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return up
        before = now


def match_keys(records: DataFrame, external_ids: DataFrame) -> DataFrame:
    """record_id with the events that own its keys."""
    keys = records.select("record_id", F.explode("keys").alias("external_id"))
    return keys.join(external_ids.select("external_id", "event_id"), "external_id").groupBy("record_id").agg(F.array_sort(F.collect_set("event_id")).alias("matches"))


def apply_known_only(signals: DataFrame, external_ids: DataFrame, prefixes: tuple = ("usgs:", "record:")) -> DataFrame:
    """Withdrawals that apply only where they concern what is known: by a key of the catalogue itself, or because the record is stored."""
    keys = signals.select("record_id", F.explode("keys").alias("external_id")).where(F.col("external_id").rlike("^(" + "|".join(map(re.escape, prefixes)) + ")"))
    known = keys.join(external_ids.select("external_id"), "external_id", "left_semi").select("record_id").distinct()
    return signals.join(known, "record_id", "left_semi")


def apply_overrides(resolved: DataFrame, overrides: DataFrame) -> DataFrame:
    """Manual assignments win; one against matched keys of another event is a conflict."""
    o = overrides.select("source_id", "provider_record_id", F.col("event_id").alias("__forced"))
    out = resolved.join(o, ["source_id", "provider_record_id"], "left")
    clash = F.col("__forced").isNotNull() & F.exists(F.coalesce("matches", F.array().cast("array<string>")), lambda m: m != F.col("__forced"))
    return out.withColumns({"conflict": clash, "event_id": F.coalesce("__forced", "event_id")}).drop("__forced")


def _claims_in_rounds(line: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(decided rows: record_id, raw_hash, event_id, is_new, reason; rows left for the replay, which know what was decided).

    A key belongs to the event of its earliest bearer that was not rejected. A row is decided once every key that it
    bears has an owner or no earlier bearer that is still open: the first row of a hot key decides in one round and all
    others of it in the next. A round is a grouped minimum over the bearers of each key and a join back. What a chain of
    keys still holds back after the rounds, and records with several warnings, whose senders follow each other, are left.
    """
    order = F.struct("__priority", F.col("__clock").isNull().alias("c"), "__clock", "record_id", F.col("raw_hash").isNull().alias("h"), "raw_hash")
    none = F.array().cast("array<string>")
    warned = line.where("caps is not null").groupBy("record_id").agg(F.count("*").alias("n")).where("n > 1").select("record_id")
    serial = line.join(warned, "record_id", "left_semi").select("component").distinct().withColumn("serial", F.lit(True))
    rows = line.join(serial, "component", "left").withColumns({"rank": order, "row": F.struct("record_id", "raw_hash"), "serial": F.coalesce("serial", F.lit(False))})
    for c in ("open", "known"):
        rows = rows.withColumn(c, F.coalesce(c, none))
    rows = cut_wide(rows)
    state = rows.where("not serial").select("row", "rank", "open", "known", "forced", "stored", "stored_caps", "caps", "least")
    bearers = cut_wide(state.select("row", "rank", F.explode("open").alias("key")))
    done = None
    for _ in range(rounds):
        live = bearers if done is None else bearers.join(done.where("reason is not null").select("row"), "row", "left_anti")
        live = live.withColumn("owner", F.lit(None).cast("string")) if done is None else live.join(done.select("row", F.col("event_id").alias("owner")), "row", "left")
        heads = live.groupBy("key").agg(F.min(F.struct("rank", "row", "owner")).alias("head"))
        waiting = state if done is None else state.join(done.select("row"), "row", "left_anti")
        seen = bearers.select("row", "key").join(waiting.select("row"), "row", "left_semi").join(heads, "key")
        held = F.col("head.owner").isNull() & (F.col("head.row") != F.col("row"))
        seen = seen.groupBy("row").agg(F.max(held).alias("held"), F.collect_set("head.owner").alias("owners"))
        ready = waiting.join(seen, "row", "left").where("not coalesce(held, false)")
        found = F.array_distinct(F.concat("known", F.coalesce("owners", none), F.array_compact(F.array("stored"))))
        ready = ready.withColumn("found", found)
        sender = (F.size(F.coalesce("caps", none)) > 0) & (F.size(F.coalesce("stored_caps", none)) > 0) & ~F.arrays_overlap("caps", "stored_caps")
        against = F.when(F.col("stored").isNotNull(), F.col("stored") != F.col("forced")).otherwise(F.exists("found", lambda m: m != F.col("forced")))
        reason = F.when(sender, "cap_sender_conflict").when(F.col("forced").isNotNull() & against, "override_conflict").when(F.col("forced").isNull() & (F.size("found") > 1), "identity_conflict")
        fresh = F.col("forced").isNull() & (F.size("found") == 0) & reason.isNull()
        event = F.when(reason.isNull(), F.coalesce("forced", F.get("found", F.lit(0)), F.concat(F.lit("ev:"), "least")))
        now = ready.select("row", event.alias("event_id"), F.coalesce(fresh, F.lit(False)).alias("is_new"), reason.alias("reason"))
        before, done = done, cut_wide(now if done is None else done.unionByName(now))
        if done.count() == state.count() or before is not None and done.count() == before.count():
            break
    left = rows if done is None else rows.join(done.select("row"), "row", "left_anti")
    if done is not None:  # keys whose owner is decided are known events to what is left
        owned = bearers.join(done.where("reason is null").select("row", "event_id"), "row").groupBy("key").agg(F.min(F.struct("rank", "event_id"))["event_id"].alias("owner"))
        told = left.select("row", F.explode("open").alias("key")).join(owned, "key").groupBy("row").agg(F.collect_set("owner").alias("owners"), F.collect_set("key").alias("settled"))
        left = left.join(told, "row", "left").withColumns({"known": F.array_distinct(F.concat("known", F.coalesce("owners", none))), "open": F.array_except("open", F.coalesce("settled", none))})
    columns = ["record_id", "raw_hash", "event_id", "is_new", "reason"]
    decided = None if done is None else done.select("row.record_id", "row.raw_hash", *columns[2:])
    return decided, left.select(*line.columns)


def resolve_identity(batch: DataFrame, external_ids: DataFrame, overrides: DataFrame | None = None, records: DataFrame | None = None, rounds: int = 6, replayed: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(rows with event_id and is_new, rejected rows with `reason`).

    No match opens an event, one attaches, more than one is a conflict that is rejected and never merges. Records of
    one key component replay in order of (priority, clock, record), as one at a time would: in `rounds` over all rows at
    once, so that a hot key is many tasks' work, and what chains of keys leave streams through one task a component in
    sorted order, which remembers the owners of keys that more than one row bears. A batch of up to `replayed` rows is
    replayed at once, which costs fewer jobs and gives the same.
    `records` are stored ones with the event_id and external_ids of their current material: a record stays with its
    event, an override that agrees with it wins over keys, and a CAP message never changes its sender.
    """
    priority = category_map({s[0]: s[5] for s in SOURCES})
    rows = hard_keys(batch).withColumns({"record_id": F.concat_ws("|", "source_id", "provider_record_id"), "__keys": F.xxhash64("keys")})
    rows = rows.withColumns({"__priority": F.coalesce(F.try_element_at(priority, F.col("source_id")), F.lit(2)), "__clock": F.coalesce("source_updated_at", "issued_at", "occurred_start")})
    if overrides is not None:
        o = overrides.select("source_id", "provider_record_id", F.col("event_id").alias("forced"))
        rows = rows.join(small(o), ["source_id", "provider_record_id"], "left")
    else:
        rows = rows.withColumn("forced", F.lit(None).cast("string"))
    joined = rows.join(key_components(rows), "record_id")
    cap = lambda c: F.filter(c, lambda k: k.startswith("cap:"))
    joined = joined.withColumn("caps", F.when(F.col("source_id") == "meteoalarm", cap("external_ids")))
    if records is not None:
        joined = joined.join(records.select("source_id", "provider_record_id", F.col("event_id").alias("stored"), cap("external_ids").alias("stored_caps")), ["source_id", "provider_record_id"], "left")
    else:
        joined = joined.withColumns({"stored": F.lit(None).cast("string"), "stored_caps": F.lit(None).cast("array<string>")})
    borne = rows.select("record_id", "__keys", F.explode("keys").alias("external_id"))
    shared = borne.groupBy("external_id").agg(F.count("*").alias("__rows")).where("__rows > 1").select("external_id", F.lit(True).alias("__shared"))
    owners = borne.distinct().join(shared, "external_id", "left").join(external_ids.select("external_id", "event_id"), "external_id", "left").where("__shared or event_id is not null")
    owners = owners.groupBy("record_id", "__keys").agg(F.collect_set(F.when(F.col("event_id").isNull(), F.col("external_id"))).alias("open"), F.collect_set("event_id").alias("known"))
    line = joined.join(owners, ["record_id", "__keys"], "left").select("component", "record_id", "raw_hash", "forced", "stored", "stored_caps", "caps", "open", "known", F.array_min("keys").alias("least"), "__priority", "__clock")
    line = line.dropDuplicates(["record_id", "raw_hash"])
    first = None
    if rounds and line.limit(replayed + 1).count() > replayed:
        first, line = _claims_in_rounds(line, rounds)
    line = line.repartition("component").sortWithinPartitions("component", "__priority", F.asc_nulls_last("__clock"), "record_id", F.asc_nulls_last("raw_hash"))

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        component, keys, senders = None, {}, {}
        for g in frames:
            out = []
            for r in g.itertuples():
                if r.component != component:
                    component, keys, senders = r.component, {}, {}
                mine = () if r.open is None else r.open
                found = {keys[k] for k in mine if k in keys} | set(() if r.known is None else r.known)
                event, new, reason = None, False, None
                if isinstance(r.stored, str):
                    found.add(r.stored)
                caps, old = set(() if r.caps is None else r.caps), senders.get(r.record_id, r.stored_caps)
                if caps and old is not None and len(old) and not caps.intersection(old):
                    reason = "cap_sender_conflict"
                elif isinstance(r.forced, str):
                    event = r.forced
                    if r.stored != event if isinstance(r.stored, str) else any(f != event for f in found):
                        reason = "override_conflict"
                elif len(found) > 1:
                    reason = "identity_conflict"
                elif found:
                    event = min(found)
                else:
                    event, new = "ev:" + r.least, True
                if reason is None:
                    for k in mine:
                        keys.setdefault(k, event)
                    if r.caps is not None:
                        senders[r.record_id] = caps
                out.append((r.record_id, r.raw_hash, event if reason is None else None, new, reason))
            yield pd.DataFrame(out, columns=["record_id", "raw_hash", "event_id", "is_new", "reason"])

    decided = line.select("component", "record_id", "raw_hash", "forced", "stored", "stored_caps", "caps", "open", "known", "least").mapInPandas(replay, "record_id string, raw_hash string, event_id string, is_new boolean, reason string")
    decided = decided if first is None else decided.unionByName(first)
    # whole rows are shuffled once, to meet what was decided on narrow ones
    done = rows.where(F.size("keys") > 0).join(decided, ["record_id", "raw_hash"], "left").drop("__keys", "__priority", "__clock")
    return done.where("reason is null").drop("reason"), done.where("reason is not null")


def append_observations(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of the batch that are not stored yet, by (source, record, payload, normalizer)."""
    keys = ["source_id", "provider_record_id", "payload_hash", "normalizer_version"]
    return batch.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def latest_material(records: DataFrame, observations: DataFrame) -> DataFrame:
    return records.select("source_id", "provider_record_id", "event_id", "observation_id", "last_seen_at").join(observations, ["source_id", "provider_record_id", "observation_id"])


def choose_current(previous: DataFrame, incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """`replaces` for each incoming version (rank, payload_hash, normalizer_version, source_snapshot_at).

    It replaces where there is no previous one, with a newer normalizer on the same payload, from a fresher snapshot,
    or with a rank not below; a payload seen before, that is not the current one, needs one of the first reasons.
    A snapshot clock that is older, missing where one was known, or equal with other content never replaces.
    """
    keys = ["source_id", "provider_record_id"]
    p = previous.select(*keys, *(F.col(c).alias(f"p_{c}") for c in ("rank", "payload_hash", "normalizer_version", "source_snapshot_at")))
    seen = stored.select(*keys, "payload_hash").distinct().withColumn("__seen", F.lit(True))
    j = incoming.join(p, keys, "left").join(seen, [*keys, "payload_hash"], "left")
    none, same = F.col("p_payload_hash").isNull(), F.col("payload_hash") == F.col("p_payload_hash")
    upgrade = same & newer_normalizer("normalizer_version", "p_normalizer_version")
    a, b = F.col("source_snapshot_at"), F.col("p_source_snapshot_at")
    fresher = F.coalesce(a > b, F.lit(False))
    barred = F.coalesce(b.isNotNull() & (a.isNull() | (a < b) | ((a == b) & ~same)), F.lit(False))
    old = F.coalesce("__seen", F.lit(False)) & ~F.coalesce(same, F.lit(False))
    ranked = F.coalesce(F.col("rank") >= F.col("p_rank"), F.lit(True))
    return j.withColumn("replaces", F.when(none, True).when(barred, False).when(upgrade | fresher, True).otherwise(ranked & ~old)).drop("__seen")


def independent_origins(material: DataFrame) -> DataFrame:
    """event_id, independent_origins, independent_source_count: families of records that name exactly one."""
    families = F.array_distinct(F.array_compact(F.transform("origins", origin_family)))
    one = material.select("event_id", F.when(F.size(families) == 1, families[0]).alias("family"))
    per = one.groupBy("event_id").agg(F.array_sort(F.collect_set("family")).alias("independent_origins"))
    return per.withColumn("independent_source_count", F.greatest(F.lit(1), F.size("independent_origins")))


def not_superseded(material: DataFrame) -> DataFrame:
    """Material whose record no other record of its event replaces."""
    refs = material.select("event_id", F.explode("supersedes").alias("provider_record_id"), F.lit("meteoalarm").alias("source_id"), F.col("provider_record_id").alias("__by")).where("__by <> provider_record_id").drop("__by")
    return material.join(refs.distinct(), ["event_id", "provider_record_id", "source_id"], "left_anti")


def cap_cycles(edges: DataFrame, most: int = 100_000) -> DataFrame:
    """Edges (event_id, src, dst) that lie on or lead out of a cycle, by peeling nodes without incoming edges.

    An event of at most `most` edges is peeled inside a task, larger ones layer by layer, to the end.
    """
    left = cut_wide(edges.select("event_id", "src", "dst").distinct())
    big = left.groupBy("event_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("event_id")

    def peel(g: pd.DataFrame) -> pd.DataFrame:
        into, out = g.dst.value_counts().to_dict(), g.groupby("src").dst.agg(list).to_dict()
        ready, gone = [s for s in out if s not in into], set()
        while ready:
            gone.add(src := ready.pop())
            for dst in out.get(src, ()):
                into[dst] -= 1
                if not into[dst]:
                    ready.append(dst)
        return g[~g.src.isin(gone)]

    small = left.join(big, "event_id", "left_anti").groupBy("event_id").applyInPandas(peel, left.schema)
    left = cut_wide(left.join(big, "event_id", "left_semi"))
    n = left.count()
    while n:
        heads = left.select("event_id", F.col("dst").alias("src")).distinct()
        left = cut_wide(left.join(heads, ["event_id", "src"], "left_semi"))
        before, n = n, left.count()
        if n == before:
            break
    return small.unionByName(left)


def cap_closing(material: DataFrame, rows: DataFrame) -> DataFrame:
    """(source_id, provider_record_id, raw_hash) of rows that close a cycle of CAP references within their event.

    `rows` come upon the material of their records in order of (clock, record), as one at a time would; only events in
    which a cycle would stand are replayed, on the edges that are left of them.
    """
    record = ["event_id", "provider_record_id"]
    new = rows.where("source_id = 'meteoalarm'").select(*record, "supersedes", "raw_hash", F.coalesce("source_updated_at", "issued_at", "occurred_start").alias("clock"), F.lit(True).alias("fresh"))
    old = material.where("source_id = 'meteoalarm'").join(rows.select(*record), record, "left_anti").select(*record, "supersedes", "raw_hash", F.lit(None).cast("timestamp").alias("clock"), F.lit(False).alias("fresh"))
    nodes = cut_wide(old.unionByName(new))
    edges = nodes.select("event_id", F.col("provider_record_id").alias("src"), F.explode("supersedes").alias("dst"), "raw_hash", "clock", "fresh")
    edges = edges.join(nodes.select("event_id", F.col("provider_record_id").alias("dst")), ["event_id", "dst"], "left_semi")
    left = edges.join(cap_cycles(edges), ["event_id", "src", "dst"], "left_semi")

    def replay(g: pd.DataFrame) -> pd.DataFrame:
        out = g[~g.fresh].groupby("src").dst.agg(list).to_dict()
        g, lost = g[g.fresh].assign(null=lambda x: x.clock.isna()), []
        for (_, _, src, raw_hash), targets in g.groupby(["null", "clock", "src", "raw_hash"], dropna=False).dst:
            reached, todo = set(), list(targets)
            while todo:
                if (at := todo.pop()) not in reached:
                    reached.add(at)
                    todo.extend(out.get(at, ()))
            if src in reached:
                lost.append((src, raw_hash))
            else:
                out[src] = list(targets)
        return pd.DataFrame(lost, columns=["provider_record_id", "raw_hash"])

    found = left.groupBy("event_id").applyInPandas(replay, "provider_record_id string, raw_hash string")
    return found.select(F.lit("meteoalarm").alias("source_id"), "provider_record_id", "raw_hash")


def rebuild_events(material: DataFrame, previous: DataFrame, now) -> DataFrame:
    """The projection of each event from its current material: the best candidate, sets of sources and evidence, independence.

    Best: source priority, rank, withdrawn, latest retrieval. A cancelling warning keeps fields it lacks from before.
    """
    priority = F.coalesce(F.try_element_at(category_map({s[0]: s[5] for s in SOURCES}), F.col("source_id")), F.lit(2))
    order = Window.partitionBy("event_id").orderBy(priority, source_rank().desc(), (F.col("lifecycle_status") == "withdrawn").desc(), F.desc("retrieved_at"), "source_id", "provider_record_id")
    best = not_superseded(material).withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")
    sets = material.groupBy("event_id").agg(F.array_sort(F.collect_set("source_id")).alias("source_ids"), F.array_sort(F.collect_set("source_url")).alias("source_urls"), F.array_sort(F.collect_set("observation_id")).alias("evidence_version_ids"), F.max("retrieved_at").alias("last_seen_at"))
    out = best.join(sets.withColumnRenamed("last_seen_at", "__seen"), "event_id").join(independent_origins(material), "event_id")
    keep = ("description", "occurred_start", "valid_from", "valid_to", "geometry", "original_severity")
    p = previous.select("event_id", *(F.col(c).alias(f"p_{c}") for c in keep), F.col("tags").alias("p_tags"), F.col("severity").alias("p_severity"))
    out = out.join(p, "event_id", "left")
    cancel = (F.col("source_id") == "meteoalarm") & (F.col("lifecycle_status") == "withdrawn")
    carried = {c: F.when(cancel, F.coalesce(c, f"p_{c}")).otherwise(F.col(c)) for c in keep}
    carried["severity"] = F.when(cancel, F.coalesce(F.nullif("severity", F.lit(0)), "p_severity", F.lit(0))).otherwise(F.col("severity"))
    carried["tags"] = F.when(cancel, norm_array(F.concat("tags", F.coalesce("p_tags", F.array().cast("array<string>"))))).otherwise(F.col("tags"))
    out = out.withColumns(carried).drop(*(f"p_{c}" for c in (*keep, "tags", "severity"))).withColumn("last_seen_at", F.col("__seen")).drop("__seen")
    return effective_state(out, now)


def projection_hash(columns: tuple = PROJECTION) -> Column:
    return F.sha2(F.to_json(F.struct(*columns, "source_ids", "independent_source_count"), {"ignoreNullFields": "false"}), 256)


def detect_changes(rebuilt: DataFrame, previous: DataFrame, first_fetch: Column | bool = False) -> DataFrame:
    """`change_type` of rows that changed: initial_import, new, withdrawn, expired or updated; null where nothing did."""
    first = first_fetch if isinstance(first_fetch, Column) else F.lit(first_fetch)
    p = previous.select("event_id", F.col("lifecycle_status").alias("p_status"), projection_hash().alias("p_hash"))
    j = rebuilt.withColumn("projection_hash", projection_hash()).join(p, "event_id", "left")
    became = lambda s: (F.col("lifecycle_status") == s) & (F.col("p_status") != s)
    kind = F.when(F.col("p_hash").isNull(), F.when(first, "initial_import").otherwise("new")).when(F.col("p_hash") == F.col("projection_hash"), None).when(became("withdrawn"), "withdrawn").when(became("expired"), "expired").otherwise("updated")
    return j.withColumn("change_type", kind).drop("p_status", "p_hash")


def revision_reason(before: str = "p_tags", after: str = "tags") -> Column:
    """Why a revision came without new evidence, by its tags; else null."""
    gained = lambda t: has_tag(after, t) & ~has_tag(before, t)
    lost = lambda t: has_tag(before, t) & ~has_tag(after, t)
    absent = "not_in_current_source_list"
    return F.when(gained(absent), "absent_from_current_list").when(lost(absent), "reappeared_in_current_list").when(lost("hazard_onset_in_future"), "clock_recomputed")


def upsert_events(current: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """The next version of a table: rebuilt rows replace those of their ids."""
    return current.join(rebuilt.select("event_id").distinct(), "event_id", "left_anti").unionByName(rebuilt.select(*current.columns))


def batch_status(stats: DataFrame, now) -> DataFrame:
    """partial, stale, ok or ok_empty. A quake feed is stale 20 minutes after its clock, and partial if that is 5 minutes ahead."""
    ahead = (F.col("source_id") == "usgs") & (F.col("provider_timestamp") > _ts(now) + F.expr("INTERVAL 5 MINUTES"))
    troubled = (F.col("rejected") > 0) | (F.col("warnings") > 0) | F.coalesce("partial", F.lit(False)) | F.coalesce("truncated", F.lit(False)) | F.coalesce(ahead, F.lit(False))
    old = (F.col("source_id") == "usgs") & (F.unix_timestamp(_ts(now)) - F.unix_timestamp("provider_timestamp") > 1200)
    return stats.withColumn("status", F.when(troubled, "partial").when(F.coalesce(old, F.lit(False)), "stale").when(F.col("records") == 0, "ok_empty").otherwise("ok"))


def snapshot_clock_invalid(state: DataFrame, stats: DataFrame, now) -> DataFrame:
    """source_id, invalid, refuse: a catalog's clock that is missing, ahead by 5 minutes or behind the last one.

    Its rows are refused where it has a clock or had one before; a first catalog without a clock is kept, as partial.
    """
    j = stats.join(state.select("source_id", F.col("latest_snapshot_at").alias("prior")), "source_id", "left")
    c, prior = F.col("provider_timestamp"), F.col("prior")
    bad = (F.col("source_id") == "cisa_kev") & F.coalesce(c.isNull() | (c > _ts(now) + F.expr("INTERVAL 5 MINUTES")) | (c < prior), F.lit(False))
    return j.select("source_id", bad.alias("invalid"), (bad & (c.isNotNull() | prior.isNotNull())).alias("refuse"))


def advance_cursor(state: DataFrame, stats: DataFrame, now) -> DataFrame:
    """High-water marks: complete reads, repairs, snapshots, lists seen and lists that were complete; none moves back.

    stats: source_id, status, records, rejected, repair_window, source_snapshot_at, current_list_complete,
    current_list_fetched_at, and list_invalid where a list's clock was refused.
    """
    s = stats.select("source_id", F.col("status").alias("b_status"), F.col("records").alias("b_records"), "repair_window", F.col("source_snapshot_at").alias("b_snapshot"), F.col("current_list_fetched_at").alias("b_list"), F.coalesce("list_invalid", F.lit(False)).alias("b_bad"), can_reconcile().alias("b_whole"))
    j, no = state.join(small(s), "source_id", "left"), F.lit(False)
    complete = F.coalesce(F.col("b_status").isin("ok", "ok_empty"), no)
    listed = F.coalesce((F.col("source_id") == "imgw_hydro") & ~F.col("b_bad") & F.col("b_list").isNotNull(), no)
    whole = listed & F.coalesce("b_whole", no)
    up = lambda old, new, on: F.when(on, F.greatest(F.col(old), new)).otherwise(F.col(old))
    out = j.withColumns({
        "initialized": F.coalesce("initialized", no) | complete, "last_complete_at": up("last_complete_at", _ts(now), complete), "last_repair_at": up("last_repair_at", _ts(now), complete & F.coalesce("repair_window", no)),
        "latest_snapshot_at": up("latest_snapshot_at", F.col("b_snapshot"), F.coalesce((F.col("b_records") > 0) | (F.col("b_status") != "partial"), no)),
        "latest_observed_fetched_at": up("latest_observed_fetched_at", F.col("b_list"), listed), "latest_observed_ingested_at": up("latest_observed_ingested_at", _ts(now), listed),
        "current_list_fetched_at": up("current_list_fetched_at", F.col("b_list"), whole), "current_list_ingested_at": up("current_list_ingested_at", _ts(now), whole),
    })
    return out.select(*state.columns)


def list_clock_invalid(state: DataFrame, stats: DataFrame, now) -> DataFrame:
    """source_id, invalid: a current list whose fetch clock is missing though complete, ahead by 5 minutes, or not later
    than any list seen before; or that comes no later than the last one was taken in."""
    marks = ("current_list_fetched_at", "latest_observed_fetched_at", "current_list_ingested_at", "latest_observed_ingested_at")
    j = stats.join(small(state.select("source_id", *(F.col(c).alias(f"p_{c}") for c in marks))), "source_id", "left")
    c, previous, taken = F.col("current_list_fetched_at"), F.greatest(*(f"p_{m}" for m in marks[:2])), F.greatest(*(f"p_{m}" for m in marks[2:]))
    rules = (F.col("current_list_complete") & c.isNull(), c > _ts(now) + F.expr("INTERVAL 5 MINUTES"), previous.isNotNull() & (c.isNull() | (c <= previous)), taken >= _ts(now))
    bad = F.lit(False)
    for r in rules:
        bad = bad | F.coalesce(r, F.lit(False))
    return j.select("source_id", ((F.col("source_id") == "imgw_hydro") & bad).alias("invalid"))


def can_reconcile() -> Column:
    """A complete current list with a clock, read without a fault."""
    return F.coalesce((F.col("source_id") == "imgw_hydro") & F.col("current_list_complete") & F.col("current_list_fetched_at").isNotNull() & F.col("status").isin("ok", "ok_empty") & (F.col("rejected") == 0), F.lit(False))


def absent_from_list(records: DataFrame, state: DataFrame) -> DataFrame:
    """Hydro records not seen since the last complete list was taken in."""
    s = state.select("source_id", "current_list_ingested_at")
    return records.where("source_id = 'imgw_hydro'").join(small(s), "source_id").where(F.col("last_seen_at") < F.col("current_list_ingested_at")).drop("current_list_ingested_at")


def update_source_state(state: DataFrame, stats: DataFrame, now) -> DataFrame:
    """status, clocks, record count and failures of each source after a batch (source_id, status, records, newest_content_at)."""
    s = stats.select("source_id", F.col("status").alias("b_status"), F.col("records").alias("b_records"), F.col("newest_content_at").alias("b_newest"))
    j, here = state.join(small(s), "source_id", "left"), F.col("b_status").isNotNull()
    done = F.coalesce((F.col("b_records") > 0) | (F.col("b_status") != "partial"), F.lit(False))
    out = j.withColumns({
        "status": F.coalesce("b_status", "status"), "last_attempt_at": F.when(here, F.greatest("last_attempt_at", _ts(now))).otherwise(F.col("last_attempt_at")), "last_success_at": F.when(done, F.greatest("last_success_at", _ts(now))).otherwise(F.col("last_success_at")),
        "newest_content_at": F.greatest("newest_content_at", "b_newest"), "record_count": F.when(done, F.col("b_records")).otherwise(F.col("record_count")), "failures": F.when(F.coalesce(F.col("b_status") != "partial", F.lit(False)), 0).otherwise(F.col("failures")),
    })
    return out.select(*state.columns)


def seed_sources(state: DataFrame, registry: DataFrame, enabled: DataFrame) -> DataFrame:
    """The registry replaces the description; a state is kept unless the source was, or becomes, disabled or lacks its key."""
    r = registry.join(enabled.select("source_id", F.col("enabled").alias("on")), "source_id", "left").withColumn("on", F.coalesce("on", ~F.col("needs_key")))
    j = r.join(state.select("source_id", F.col("status").alias("old"), "last_success_at"), "source_id", "full_outer")
    reset = ~F.coalesce("on", F.lit(False)) | F.col("old").isNull() | F.col("old").isin("disabled", "needs_credentials")
    status = F.when(~F.coalesce("on", F.lit(False)), F.when(F.col("needs_key"), "needs_credentials").otherwise("disabled")).when(reset, "pending").otherwise(F.col("old"))
    return j.select("source_id", "name", "category", "poll_seconds", F.coalesce("on", F.lit(False)).alias("enabled"), status.alias("status"), "last_success_at")


def expire_advisories(events: DataFrame, now) -> DataFrame:
    """Rows whose state a clock alone changes, with change_type; last_seen_at stays."""
    due = events.where(F.col("lifecycle_status").isin("active", "unknown") & ((F.col("valid_to") <= _ts(now)) | ((F.col("valid_from") <= _ts(now)) & F.col("source_id").isin("meteoalarm", "noaa_swpc"))))
    before = due.select("event_id", F.col("lifecycle_status").alias("__was"), F.col("tags").alias("__tags"))
    out = effective_state(due, now).join(before, "event_id").where((F.col("lifecycle_status") != F.col("__was")) | (F.array_sort("tags") != F.array_sort("__tags")))
    return out.withColumns({"change_type": F.when(F.col("lifecycle_status") == "expired", "expired").otherwise("updated"), "last_changed_at": _ts(now)}).drop("__was", "__tags")


def apply_retention(tables: dict[str, DataFrame], now) -> dict[str, DataFrame]:
    """Raw payloads and runs for 30 days, superseded revisions and ended events for 180; orphans go with them."""
    now = _ts(now)
    month, half = now - F.expr("INTERVAL 30 DAYS"), now - F.expr("INTERVAL 180 DAYS")
    out = dict(tables)
    out["runs"] = tables["runs"].where(F.col("started_at") >= month)
    out["observations"] = tables["observations"].withColumn("raw", F.when(F.col("retrieved_at") >= month, F.col("raw")))
    newer = F.lead("revision_id").over(Window.partitionBy("event_id").orderBy("changed_at", "revision_id")).isNotNull()
    out["revisions"] = tables["revisions"].withColumn("__newer", newer).where(~(F.col("__newer") & (F.col("changed_at") < half))).drop("__newer")
    e = tables["events"]
    end = F.coalesce("occurred_end", "valid_to", "occurred_start")
    over = F.col("lifecycle_status").isin("expired", "withdrawn") | ((F.col("kind") == "incident") & (F.col("occurred_start") < half) & ((F.col("category") == "earthquake") | ((F.col("lifecycle_status") != "active") & (end < half))))
    gone = e.where((F.col("last_seen_at") < half) & F.coalesce(over, F.lit(False))).select("event_id")
    out["events"] = e.join(gone, "event_id", "left_anti")
    for name in ("evidence", "records", "revisions"):
        out[name] = out[name].join(gone, "event_id", "left_anti")
    out["observations"] = out["observations"].join(orphans(out["observations"], out["evidence"], out["records"]).select("observation_id"), "observation_id", "left_anti")
    return out


def orphans(observations: DataFrame, evidence: DataFrame, records: DataFrame) -> DataFrame:
    """Observations that neither evidence nor a record points to."""
    return observations.join(evidence.select("observation_id").distinct(), "observation_id", "left_anti").join(records.select("observation_id").distinct(), "observation_id", "left_anti")


def preview_split(tables: dict[str, DataFrame], event_id: str, source_id: str) -> DataFrame:
    """Per side (moving, staying): records, keys and evidence."""
    from eventlens.functions.arrays import owns_key

    r = tables["records"].where(F.col("event_id") == event_id).withColumn("side", F.when(F.col("source_id") == source_id, "moving").otherwise("staying"))
    k = tables["external_ids"].where(F.col("event_id") == event_id).withColumn("side", F.when(owns_key(F.lit(source_id), "external_id"), "moving").otherwise("staying"))
    e = tables["evidence"].where(F.col("event_id") == event_id).join(tables["observations"].select("observation_id", "source_id"), "observation_id").withColumn("side", F.when(F.col("source_id") == source_id, "moving").otherwise("staying"))
    count = lambda df, what: df.groupBy("side").agg(F.count("*").alias("n")).select("side", F.lit(what).alias("what"), "n")
    return count(r, "records").unionByName(count(k, "keys")).unionByName(count(e, "evidence"))


def check_split(tables: dict[str, DataFrame], expected_keys: DataFrame, event_id: str) -> DataFrame:
    """ok: all expected keys belong to this event now."""
    j = expected_keys.select("external_id").join(tables["external_ids"].select("external_id", "event_id"), "external_id", "left")
    return j.agg(F.coalesce(F.bool_and(F.col("event_id").eqNullSafe(F.lit(event_id))), F.lit(False)).alias("ok"), F.count("*").alias("keys"))


def split_source(tables: dict[str, DataFrame], event_id: str, source_id: str, reason: str, now) -> dict[str, DataFrame]:
    """Tables after a source's records of an event move to an event of their own; both sides get overrides, so later reads keep the split."""
    from eventlens.functions.arrays import owns_key

    new = f"{event_id}/split/{source_id}"
    move = lambda df, mine: df.withColumn("event_id", F.when((F.col("event_id") == event_id) & mine, new).otherwise(F.col("event_id")))
    out = dict(tables)
    out["records"] = move(tables["records"], F.col("source_id") == source_id)
    out["external_ids"] = move(tables["external_ids"], owns_key(F.lit(source_id), "external_id"))
    mine = tables["observations"].where(F.col("source_id") == source_id).select("observation_id", F.lit(True).alias("__mine"))
    out["evidence"] = move(tables["evidence"].join(mine, "observation_id", "left"), F.coalesce("__mine", F.lit(False))).drop("__mine")
    touched = out["records"].where(F.col("event_id").isin(event_id, new)).select("source_id", "provider_record_id", "event_id", F.lit(reason).alias("reason"), _ts(now).alias("decided_at"))
    out["overrides"] = tables["overrides"].join(touched, ["source_id", "provider_record_id"], "left_anti").unionByName(touched)
    return out


def public_ids(events: DataFrame, pairs: str = "pairs", label: str = "public_id", prefix: str = "public/event/") -> DataFrame:
    """Version-5 UUIDs over the JSON list of the sorted (source, record) pairs of each event; the same pairs give the same id."""
    name = F.concat(F.lit(prefix), F.to_json(F.transform(F.array_sort(F.transform(pairs, lambda p: F.struct(p["source_id"].alias("a"), p["provider_record_id"].alias("b")))), lambda p: F.array(p["a"], p["b"]))))
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return events.withColumn(label, uuid)


def repeated_public_ids(events: DataFrame, label: str = "public_id") -> DataFrame:
    """Public ids that more than one event would bear: a publication with any must be refused."""
    return events.groupBy(label).agg(F.count("*").alias("n")).where("n > 1")


#: Content fields of an event's fingerprint (fixed values); read clocks, caches and relations are left out.
FINGERPRINT = ("kind", "category", "title", "description", "occurred_start", "occurred_end", "issued_at", "source_updated_at", "valid_from", "valid_to", "countries", "location_precision", "time_precision", "severity", "original_severity", "lifecycle_status", "source_ids", "independent_source_count", "source_url")


def event_fingerprint(df: DataFrame) -> DataFrame:
    tags = F.array_sort(F.array_except("tags", F.array(F.lit("cached_public_data"))))
    fields = sorted(c for c in FINGERPRINT if c in df.columns)
    evidence = [F.array_sort(F.transform("evidence", lambda e: F.struct(e["source_id"], e["provider_record_id"], e["issued_at"], e["source_updated_at"], e["source_url"]))).alias("evidence")] if "evidence" in df.columns else []
    return df.withColumn("fp", F.sha2(F.to_json(F.struct(*fields, tags.alias("tags"), *evidence), {"ignoreNullFields": "false"}), 256))


def make_baseline(snapshot: DataFrame) -> DataFrame:
    """Lower-case ids with their fingerprints; an id that is not unique is left out."""
    b = event_fingerprint(snapshot).select(F.lower("id").alias("id"), "fp")
    return b.groupBy("id").agg(F.min("fp").alias("fp"), F.count("*").alias("n")).where("n = 1").drop("n")


def advance_baseline(history: DataFrame, new: DataFrame) -> DataFrame:
    """Per owner: `accepted` where a new (generated_at, set_hash) is later than all, or equal with the same content; an equal clock with other content is `conflict`."""
    last = history.groupBy("owner").agg(F.max(F.struct("generated_at", "set_hash")).alias("last"))
    j = new.join(last, "owner", "left")
    a, b = F.col("generated_at"), F.col("last.generated_at")
    return j.select("owner", "generated_at", "set_hash", F.when(b.isNull() | (a > b), "accepted").when(a < b, "older").when(F.col("set_hash") == F.col("last.set_hash"), "same").otherwise("conflict").alias("outcome"))


def compare_snapshots(current: DataFrame, base: DataFrame, current_at, base_at) -> DataFrame:
    """id, status (added, changed, same, missing): only for a newer clock; `out_of_order` or `same_snapshot` rows tell why not.

    current and base hold id, fp.
    """
    if base_at is None:
        return current.limit(0).select(F.lit(None).cast("string").alias("id"), F.lit("first_visit").alias("status"))
    if current_at <= base_at:
        why = "out_of_order" if current_at < base_at else "same_snapshot"
        differs = current.join(base, ["id", "fp"], "left_anti").agg((F.count("*") > 0).alias("d"))
        return differs.select(F.lit(None).cast("string").alias("id"), F.when(F.col("d") & F.lit(why == "same_snapshot"), F.lit("same_snapshot_differs")).otherwise(F.lit(why)).alias("status"))
    j = current.select("id", F.col("fp").alias("a")).join(base.select("id", F.col("fp").alias("b")), "id", "full_outer")
    return j.select("id", F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "missing").when(F.col("a") != F.col("b"), "changed").otherwise("same").alias("status"))


def retain_previous(current: DataFrame, previous: DataFrame, sources: DataFrame) -> DataFrame:
    """Current events and those of the previous snapshot that only failed sources held, tagged.

    Kept: all sources in error now, with a success before; the id and none of its (source, record) pairs are there now.
    Where previous events share a pair, the first in order of id keeps it, if it is first on all its pairs.
    """
    failed = sources.where((F.col("status") == "error") & F.col("last_success_at").isNotNull()).select("source_id")
    ids = previous.select("id", F.explode("source_ids").alias("source_id"))
    only_failed = ids.join(failed.withColumn("f", F.lit(1)), "source_id", "left").groupBy("id").agg((F.count("*") == F.count("f")).alias("ok")).where("ok").select("id")
    kept = previous.join(only_failed, "id", "left_semi").join(current.select("id"), "id", "left_anti")
    pair = lambda df: df.select("id", F.explode("pairs").alias("p")).select("id", "p.source_id", "p.provider_record_id")
    taken = pair(kept).join(pair(current).select("source_id", "provider_record_id").distinct(), ["source_id", "provider_record_id"], "left_semi").select("id").distinct()
    kept = kept.join(taken, "id", "left_anti")
    first = Window.partitionBy("source_id", "provider_record_id").orderBy("id")
    late = pair(kept).withColumn("rn", F.row_number().over(first)).where("rn > 1").select("id").distinct()
    kept = kept.join(late, "id", "left_anti").withColumn("tags", add_tag("tags", "cached_public_data"))
    return current.unionByName(kept.select(*current.columns))


def retained_counts(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources with the record counts of rows kept for them."""
    n = events.where(has_tag("tags", "cached_public_data")).select(F.explode("source_ids").alias("source_id")).groupBy("source_id").agg(F.count("*").alias("__kept"))
    return sources.join(n, "source_id", "left").withColumn("record_count", F.when(F.col("status") == "error", F.coalesce("__kept", F.lit(0))).otherwise(F.col("record_count"))).drop("__kept")


def event_evidence(records: DataFrame, observations: DataFrame, registry: DataFrame, ids: DataFrame) -> DataFrame:
    """id, evidence: what is known of each event's records, in order."""
    r = records.join(ids.select(F.col("id").alias("event_id")).distinct(), "event_id", "left_semi").select("event_id", "source_id", "provider_record_id", "observation_id")
    j = r.join(observations.select("observation_id", "retrieved_at", "issued_at", "source_updated_at", "source_url"), "observation_id").join(small(registry.select("source_id", F.col("name").alias("source_name"))), "source_id", "left")
    item = F.struct("source_id", "provider_record_id", "source_name", "retrieved_at", "issued_at", "source_updated_at", "source_url", "observation_id")
    return j.groupBy(F.col("event_id").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("evidence"))


def briefing_since(scopes: DataFrame, runs: DataFrame, now) -> DataFrame:
    """since of each (country, window_hours) scope: the end of its last saved briefing, else the window; `first` tells which."""
    keys = ["country", "window_hours"]
    last = runs.groupBy(*keys).agg(F.max_by("until", F.struct("created_at", "run_id")).alias("__last"))
    j = scopes.alias("s").join(last.alias("l"), F.col("s.country").eqNullSafe(F.col("l.country")) & (F.col("s.window_hours") == F.col("l.window_hours")), "left")
    return j.select("s.country", "s.window_hours", F.coalesce("__last", _ts(now) - F.make_interval(hours=F.col("s.window_hours"))).alias("since"), _ts(now).alias("until"), F.col("__last").isNull().alias("first"))


def latest_briefing(runs: DataFrame, country: str | None, window_hours: int) -> DataFrame:
    mine = runs.where(F.col("country").eqNullSafe(F.lit(country)) & (F.col("window_hours") == window_hours))
    return mine.agg(F.max_by(F.struct(*runs.columns), F.struct("created_at", "run_id")).alias("x")).where("x is not null").select("x.*")


def with_health(result: DataFrame, health: DataFrame) -> DataFrame:
    """Each row with the one list of source states."""
    one = health.agg(F.array_sort(F.collect_list(F.struct("source_id", "status"))).alias("health"))
    return result.crossJoin(F.broadcast(one))


def changes_since(revisions: DataFrame, since, until) -> DataFrame:
    """The last revision of each event in a half-open cursor window."""
    w = revisions.where((F.col("changed_at") >= _ts(since)) & (F.col("changed_at") < _ts(until)))
    return w.groupBy("event_id").agg(F.max_by(F.struct(*[c for c in revisions.columns if c != "event_id"]), F.struct("changed_at", "revision_id")).alias("x")).select("event_id", "x.*")
