"""Append-only logs: chains checked with windows, states folded, versions compared, graphs closed.

Logs come with ``seq`` within their key. Every check is a window over one key or a join; commands and replays give
accepted rows and rejects, never errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import scan
from tessera.sources.shared import checkpointed


def chain(log: DataFrame, key: str, before: str, after: str, time: str, seq: str = "seq", rising: bool = True) -> DataFrame:
    """``log`` with link_ok (the digest before is the digest after of the row before) and time_ok (time does not fall, or with
    ``rising`` it increases)."""
    x = scan.scanned(log, key, seq, scan.Wanted(lags={"_after": F.col(after), "_time": F.col(time)}, number="_nth"))
    first, later = F.col("_nth") == 1, F.col("_time") < F.col(time)
    later = later if rising else F.col("_time") <= F.col(time)
    linked = first | F.coalesce(F.col("_after") == F.col(before), F.lit(False))
    return x.select(*log.columns, linked.alias("link_ok"), (first | F.coalesce(later, F.lit(False))).alias("time_ok"))


def chain_summary(checked: DataFrame, key: str, after: str, seq: str = "seq") -> DataFrame:
    """Per key: rows, whether all links and times hold, and the last digest."""
    return checked.groupBy(key).agg(
        F.count("*").alias("n_rows"),
        F.bool_and(F.col("link_ok") & F.col("time_ok")).alias("chain_ok"),
        F.max_by(after, seq).alias("last_hash"),
    )


def versions_ok(versions: DataFrame, by: str = "project_id", order: str = "created_at") -> DataFrame:
    """``versions`` with number_ok (``V1``, ``V2``, … in order) and parent_ok (the hash of the version before)."""
    w = Window.partitionBy(by).orderBy(order, "version_id")
    return versions.withColumns(
        {
            "number_ok": F.col("version_id") == F.concat(F.lit("V"), F.row_number().over(w)),
            "parent_ok": F.col("parent_version_hash").eqNullSafe(F.lag("version_hash").over(w)),
        }
    )


def latest(df: DataFrame, key: str | list[str], order: str) -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def replay(baseline: DataFrame, audits: DataFrame, added: DataFrame) -> DataFrame:
    """Current findings (finding_id, hash, chain_ok): the baseline and findings added by people, each with what its last
    audit left, and whether its audits chain from its first state: each starts where the one before ended, none changes
    nothing, and times do not fall; equal times are in order."""
    start = baseline.select("finding_id", "hash").unionByName(added.select("finding_id", "hash"))
    log = chain(audits, "finding_id", "before_hash", "after_hash", "reviewed_at", rising=False)
    changed = F.coalesce(F.col("before_hash") != F.col("after_hash"), F.lit(False))
    log = log.withColumn("link_ok", F.col("link_ok") & changed)
    first = audits.groupBy("finding_id").agg(F.min_by("before_hash", "seq").alias("_first"))
    folded = chain_summary(log, "finding_id", "after_hash").join(first, "finding_id")
    x = start.join(folded, "finding_id", "left")
    ok = F.col("n_rows").isNull() | (F.col("chain_ok") & (F.col("_first") == F.col("hash")))
    return x.select("finding_id", F.coalesce("last_hash", "hash").alias("hash"), F.coalesce(ok, F.lit(False)).alias("chain_ok"))


def snapshot_hash(snapshot: Column) -> Column:
    return F.sha2(F.to_json(snapshot, {"ignoreNullFields": "false"}), 256)


def _decision_key(action: Column, at: str) -> Column:
    """What a decision and the audit that it belongs to have in common, of rows with digests of their snapshots as _b and _a."""
    held = ("finding_id", "before_hash", "after_hash", "reviewer", "reason", "_b", "_a")
    return F.sha2(F.to_json(F.struct(action.alias("action"), F.col(at).alias("at"), *held), {"ignoreNullFields": "false"}), 256)


def _with_digests(df: DataFrame) -> DataFrame:
    """``df`` with the digests of both snapshots as _b and _a, and what is written of the one after as _a_json."""
    x = df.withColumn("_a_json", F.to_json("after_snapshot", {"ignoreNullFields": "false"}))
    return x.withColumns({"_b": snapshot_hash(F.col("before_snapshot")), "_a": F.sha2("_a_json", 256)})


def _refused(checks: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()))).alias("refused")


AUDIT_RULES = ("known_finding", "hashes_recomputed", "something_changed", "continues", "time_not_fallen", "change_allowed", "decided_once")
ACTION_RULES = ("id_unique", "id_recomputed", "hashes_recomputed", "added_properly", "bound_to_audit")


def replay_snapshots(baseline: DataFrame, audits: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(states, audits, actions): a review log replayed from its snapshots, not from their hashes.

    ``baseline`` has finding_id and snapshot (a struct with finding_id, claim_type, statement, review_status, source_anchors
    and revision_records of by, at and why); ``audits`` finding_id, seq, before_hash, after_hash, before_snapshot, after_snapshot,
    reviewer, reason and reviewed_at; ``actions`` action_id, action (add_human, confirm or soft_delete), purpose, acted_at and the same fields,
    without a snapshot before for what a person added. Snapshots of one table have one type.

    ``refused`` of each audit names the ``AUDIT_RULES`` that it breaks: its finding is in the baseline or was added; both hashes are
    those of the snapshots, and differ; it starts from the state that the one before it left (the baseline's, or the added
    one's); its time does not fall; nothing changed but the status to confirmed or deleted, or the statement with the status modified, and
    one record was added, its own; a change of status alone has one decision like it. ``refused`` of each action names the ``ACTION_RULES``:
    ids are unique and of their content, hashes those of the snapshots, a person's judgment is new, confirmed, cited and has its one
    record, and a decision belongs to an audit. States are what the last audit left of each finding."""
    kinds = ("confirm", "soft_delete")
    added = actions.where("action = 'add_human'")
    before, after = F.col("before_snapshot"), F.col("after_snapshot")
    own = lambda at: F.struct(F.col("reviewer").alias("by"), F.col(at).alias("at"), F.col("reason").alias("why"))
    same = before["statement"].eqNullSafe(after["statement"])
    status_only = same & after["review_status"].isin("confirmed", "deleted")
    status = F.when(status_only, after["review_status"]).otherwise("modified")
    expected = before.withField("review_status", status).withField("statement", after["statement"])
    expected = expected.withField("revision_records", F.concat(before["revision_records"], F.array(own("reviewed_at"))))
    decision = F.when(after["review_status"] == "confirmed", "confirm").otherwise("soft_delete")
    of_row = {  # what an audit shows by itself, so that no snapshot is shuffled
        "_hashed": (F.col("before_hash") == F.col("_b")) & (F.col("after_hash") == F.col("_a")),
        "_changed": F.col("before_hash") != F.col("after_hash"),
        "_allowed": (status_only | ~same) & (F.to_json(expected, {"ignoreNullFields": "false"}) == F.col("_a_json")),
        "_status_only": status_only,
        "_key": F.when(status_only, _decision_key(decision, "reviewed_at")),
    }
    one = F.lit(1).alias("_kind")
    judged = _with_digests(audits).select("finding_id", "seq", one, "reviewed_at", "_b", "_a", *(c.alias(name) for name, c in of_row.items()))
    start = baseline.select("finding_id", "snapshot", F.lit(None).cast("string").alias("reviewed_at"))
    start = start.unionByName(added.select("finding_id", F.col("after_snapshot").alias("snapshot"), F.col("acted_at").alias("reviewed_at")))
    start = start.withColumns({"seq": F.lit(0).cast("long"), "_kind": F.lit(0)})
    log = start.withColumn("_a", snapshot_hash(F.col("snapshot"))).drop("snapshot").unionByName(judged, allowMissingColumns=True)
    moved = scan.scanned(log, "finding_id", ["_kind", "seq"], scan.Wanted(lags={"_state": F.col("_a"), "_time": F.col("reviewed_at")}))
    decisions = _with_digests(actions.where(F.col("action").isin(*kinds)))
    decided = decisions.groupBy(_decision_key(F.col("action"), "acted_at").alias("_of")).agg(F.count("*").alias("_decided"))
    x = moved.where("_kind = 1")
    sought = F.coalesce("_key", F.concat_ws("-", F.lit(""), "finding_id", "seq"))  # no digest; nulls would meet in one task
    x = x.withColumn("_sought", sought).join(decided, F.col("_sought") == F.col("_of"), "left")
    clock = lambda c: F.unix_micros(F.try_to_timestamp(F.col(c)))
    checks = {
        "known_finding": F.col("_state").isNotNull(),
        "hashes_recomputed": F.col("_hashed"),
        "something_changed": F.col("_changed"),
        "continues": F.col("_state") == F.col("_b"),
        "time_not_fallen": F.col("_time").isNull() | (clock("reviewed_at") >= clock("_time")),
        "change_allowed": F.col("_allowed"),
        "decided_once": ~F.col("_status_only") | (F.col("_decided") == 1),
    }
    audited = x.select("finding_id", "seq", _refused(checks))
    used = judged.where("_key is not null").select(F.col("_key").alias("_used")).distinct()
    known = baseline.select("finding_id").distinct().withColumn("_known", F.lit(True))
    times = added.groupBy("finding_id").agg(F.count("*").alias("_added"))
    y = _with_digests(action_ids(actions.withColumn("_told", F.col("action_id")))).withColumn("_key", _decision_key(F.col("action"), "acted_at"))
    y = y.join(used, y["_key"] == used["_used"], "left").join(known, "finding_id", "left").join(times, "finding_id", "left")
    y = y.join(actions.groupBy(F.col("action_id").alias("_told")).agg(F.count("*").alias("_n")), "_told", "left")
    human = F.col("action") == "add_human"
    proper = F.col("before_hash").isNull() & F.col("_known").isNull() & (F.col("_added") == 1) & (after["claim_type"] == "human_judgment")
    proper &= (after["review_status"] == "confirmed") & (F.size(after["source_anchors"]) > 0) & (F.size(after["revision_records"]) == 1)
    proper &= snapshot_hash(F.get(after["revision_records"], F.lit(0))) == snapshot_hash(own("acted_at"))
    mine = (after["finding_id"] == F.col("finding_id")) & (human | (before["finding_id"] == F.col("finding_id")))
    acted = {
        "id_unique": F.col("_n") == 1,
        "id_recomputed": F.col("action_id") == F.col("_told"),
        "hashes_recomputed": mine & (F.col("after_hash") == snapshot_hash(after)) & (human | (F.col("before_hash") == snapshot_hash(before))),
        "added_properly": ~human | proper,
        "bound_to_audit": human | F.col("_used").isNotNull(),
    }
    left = audits.select("finding_id", F.col("after_snapshot").alias("snapshot"), "seq", one)
    every = start.select("finding_id", "snapshot", "seq", "_kind").unionByName(left)
    states = every.groupBy("finding_id").agg(F.max_by("snapshot", F.struct("_kind", "seq")).alias("snapshot"))
    return states, audited, y.select("finding_id", F.col("_told").alias("action_id"), _refused(acted))


def apply_commands(commands: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audit rows, rejects with a reason) of review commands (finding_id, action, new_hash, reviewer, reason, acted_at)."""
    x = commands.join(findings.select("finding_id", F.col("hash").alias("before_hash"), "review_status"), "finding_id", "left")
    blank = lambda c: F.coalesce(T.trim_ws(F.col(c)) == "", F.lit(True))
    why = (
        F.when(F.col("before_hash").isNull(), "unknown finding")
        .when(F.col("review_status") == "deleted", "finding is deleted")
        .when(blank("reviewer") | blank("reason"), "reviewer and reason are needed")
        .when(~T.utc_timestamp_valid(F.col("acted_at")), "time is not UTC")
        .when((F.col("action") == "modify") & F.col("new_hash").eqNullSafe(F.col("before_hash")), "nothing changed")
    )
    x = x.withColumn("why", why)
    rows = x.where("why is null").select("finding_id", "action", "before_hash", F.coalesce("new_hash", "before_hash").alias("after_hash"), "reviewer", "reason", F.col("acted_at").alias("reviewed_at"))
    return rows, x.where("why is not null").select(*commands.columns, "why")


def attest_commands(commands: DataFrame, validations: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attestations, rejects): only rules that wait for a person, and only once."""
    waiting = validations.where("status = 'manual_review_required'").select("finding_id", "rule", F.lit(True).alias("_waits"))
    held = existing.select("finding_id", "rule").distinct().withColumn("_held", F.lit(True))
    x = commands.join(waiting, ["finding_id", "rule"], "left").join(held, ["finding_id", "rule"], "left")
    why = F.when(F.col("_waits").isNull(), "rule does not wait for a person").when(F.col("_held"), "rule is attested")
    x = x.withColumn("why", why)
    return x.where("why is null").select(*commands.columns), x.where("why is not null").select(*commands.columns, "why")


def closure(edges: DataFrame, seeds: DataFrame, compact: int = 8) -> DataFrame:
    """(node, depth): what is reachable from ``seeds`` (node) along ``edges`` (parent, child), cycles included. Each round
    joins the new nodes alone with the edges and is written; every ``compact`` rounds the rounds become one table. It ends
    when a round finds nothing new, after as many rounds as the longest shortest path."""
    edges = checkpointed(edges.select("parent", "child"))
    front = checkpointed(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    seen, depth = [front], 0
    while True:
        depth += 1
        every = reduce(DataFrame.unionByName, seen)
        reached = front.join(edges, front["node"] == edges["parent"]).select(F.col("child").alias("node")).distinct()
        front = checkpointed(reached.join(every.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return every
        seen.append(front)
        if len(seen) > compact:
            seen = [checkpointed(reduce(DataFrame.unionByName, seen))]


def request_reanalysis(findings: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(finding_id, hash, is_target) of the targets and all findings derived from them."""
    gone = closure(edges, targets.select(F.col("finding_id").alias("node")))
    return findings.join(gone, findings["finding_id"] == gone["node"]).select("finding_id", "hash", (F.col("depth") == 0).alias("is_target"))


def apply_reanalysis(findings: DataFrame, invalidated: DataFrame, replacement: DataFrame) -> DataFrame:
    """Findings of the next version: those that stay, and the replacement, which must cover the targets exactly and keep
    their categories; rows that break this bear ``violation``."""
    gone = invalidated.select("finding_id")
    stay = findings.join(gone, "finding_id", "left_anti").withColumn("violation", F.lit(None).cast("string"))
    prior = findings.select("finding_id", F.col("category").alias("_category"), F.col("claim_type").alias("_type"))
    target = invalidated.where("is_target").select("finding_id", F.lit(True).alias("_target"))
    x = target.join(replacement, "finding_id", "full_outer").join(prior, "finding_id", "left")
    why = (
        F.when(F.col("_target").isNull(), "not a target")
        .when(F.col("category").isNull(), "target is not covered")
        .when((F.col("category") != F.col("_category")) | (F.col("claim_type") != F.col("_type")), "kind changed")
    )
    return stay.unionByName(x.withColumn("violation", why).select(*stay.columns))


def stale(prior: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of ``prior`` (finding_id, hash) whose finding is gone or has another hash now."""
    now = current.select("finding_id", F.col("hash").alias("_now"))
    return prior.join(now, "finding_id", "left").where("_now is null or _now <> hash").drop("_now")


def accept_revisions(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """``candidates`` (project_id, expected_revision, …) with accepted: the stored revision is the expected one, and of
    several for a project the first by ``submitted_at``."""
    now = stored.groupBy("project_id").agg(F.max("revision").alias("_now"))
    x = candidates.join(now, "project_id", "left")
    first = F.row_number().over(Window.partitionBy("project_id", "expected_revision").orderBy("submitted_at")) == 1
    return x.withColumn("accepted", (F.coalesce("_now", F.lit(0)) == F.col("expected_revision")) & first).drop("_now")


def drop_projects(df: DataFrame, projects: DataFrame) -> DataFrame:
    return df.join(projects.select("project_id").distinct(), "project_id", "left_anti")


def upsert_sources(stored: DataFrame, parsed: DataFrame) -> DataFrame:
    """Of each project and source type the latest parse, by ``parsed_at``."""
    return latest(stored.unionByName(parsed), ["project_id", "source_type"], "parsed_at")


def correct_units(units: DataFrame, corrections: DataFrame) -> DataFrame:
    """Units with the latest correction of each (unit_id, text, corrected_at) and the history of texts before it."""
    last = latest(corrections, "unit_id", "corrected_at").select("unit_id", F.col("text").alias("_new"))
    past = corrections.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("corrected_at", "text"))).alias("history"))
    x = units.join(last, "unit_id", "left").join(past, "unit_id", "left")
    return x.withColumn("text", F.coalesce("_new", "text")).drop("_new")


def slices(runs: DataFrame, sizes: Column, by: str, order: str) -> DataFrame:
    """``runs`` with first and last: where each run's outputs stand in one list of all."""
    x = scan.scanned(runs.withColumn("_n", sizes), by, order, scan.Wanted(sums={"last": F.col("_n")}))
    return x.withColumn("first", F.col("last") - F.col("_n")).drop("_n")


def group_digest(df: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """(by, digest) of each group's rows in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_at"), F.struct(*sorted(columns)).alias("row"))))
    return df.groupBy(by).agg(F.sha2(F.to_json(F.transform(rows, lambda s: s["row"])), 256).alias("digest"))


def cancel_request(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """``sessions`` (project_id, step, …) of projects whose request (project_id, step_before) is cancelled, back at the
    step before it; others stay."""
    back = requests.groupBy("project_id").agg(F.min("step_before").alias("_back"))
    return sessions.join(back, "project_id", "left").withColumn("step", F.coalesce("_back", "step")).drop("_back")


def authorized_results(results: DataFrame, targets: DataFrame, sources: DataFrame, stages: list[str]) -> DataFrame:
    """(project_id, rule, ok) of the results (project_id, finding_id, stage, source_id) of a reanalysis: they are of its
    stages and sources, and their findings are exactly its targets."""
    key = ["project_id", "finding_id"]
    allowed = sources.select("project_id", "source_id").distinct().withColumn("_s", F.lit(True))
    x = results.join(allowed, ["project_id", "source_id"], "left").groupBy("project_id").agg(
        F.bool_and(F.col("stage").isin(stages)).alias("a"), F.bool_and(F.coalesce("_s", F.lit(False))).alias("b")
    )
    both = results.select(*key).distinct().withColumn("_r", F.lit(True)).join(targets.select(*key).distinct().withColumn("_t", F.lit(True)), key, "full_outer")
    both = both.groupBy("project_id").agg(F.lit("results_are_targets").alias("rule"), F.bool_and(F.coalesce(F.col("_r") & F.col("_t"), F.lit(False))).alias("ok"))
    each = F.array(F.struct(F.lit("stages_allowed").alias("rule"), F.col("a").alias("ok")), F.struct(F.lit("sources_allowed").alias("rule"), F.col("b").alias("ok")))
    return x.select("project_id", F.inline(each)).unionByName(both)


def action_ids(actions: DataFrame) -> DataFrame:
    """``actions`` with action_id: a digest of the fields that make an action of its kind what it is."""
    kind = F.col("action")
    body = F.to_json(
        F.struct("action", "finding_id", F.when(kind != "add_human", F.col("before_hash")).alias("before_hash"), "after_hash", "reviewer", "acted_at", F.when(kind == "add_human", F.col("purpose")).alias("purpose")),
        {"ignoreNullFields": "false"},
    )
    return actions.withColumn("action_id", F.concat(F.lit("act-"), F.sha2(body, 256)))


def migrate_actions(actions: DataFrame, purpose: str = "human_review") -> DataFrame:
    """Actions of an earlier form: added judgments without a purpose get ``purpose`` and a new id."""
    old = (F.col("action") == "add_human") & F.col("purpose").isNull()
    kept = actions.withColumns({"_old": F.col("action_id"), "_was": F.coalesce(old, F.lit(False))})
    new = action_ids(kept.withColumn("purpose", F.when(F.col("_was"), purpose).otherwise(F.col("purpose"))))
    return new.withColumn("action_id", F.when(F.col("_was"), F.col("action_id")).otherwise(F.col("_old"))).drop("_old", "_was")


def state_digests(tables: dict[str, DataFrame], by: str = "project_id", leave_out: tuple[str, ...] = ()) -> DataFrame:
    """(by, digest) of what tables hold of each project, in any order of rows: for each table the number of its rows and
    the sum of their hashes, which are combined before the shuffle. Columns in ``leave_out`` do not count."""
    out = None
    for name, df in sorted(tables.items()):
        columns = sorted(c for c in df.columns if c not in (*leave_out, by))
        h = F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
        one = df.groupBy(by).agg(F.concat_ws(":", F.lit(name), F.count("*"), F.sum(h)).alias(f"_{name}"))
        out = one if out is None else out.join(one, by, "full_outer")
    return out.select(by, F.sha2(F.concat_ws("|", *(F.coalesce(f"_{n}", F.lit("")) for n in sorted(tables))), 256).alias("digest"))


def seal(sessions: DataFrame, columns: list[str]) -> DataFrame:
    """``sessions`` with content_hash over ``columns``."""
    return sessions.withColumn("content_hash", F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256))


def broken_seals(sessions: DataFrame, columns: list[str]) -> DataFrame:
    """Sessions whose content_hash is not that of ``columns``."""
    told = sessions.withColumn("_told", F.col("content_hash"))
    return seal(told, columns).where(~F.col("content_hash").eqNullSafe(F.col("_told"))).drop("content_hash").withColumnRenamed("_told", "content_hash")


def with_metrics(projects: DataFrame, metrics: DataFrame) -> DataFrame:
    """``projects`` with their metrics as columns; a project without any has nulls."""
    return projects.join(metrics, "project_id", "left")
