"""Run history, state and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from checks.base import Views, check, write_files
from checks.event_checks import DURATION_SQL, SIZE_SQL
from stepledger.functions.formats import format_finished, shown_duration, shown_size
from stepledger.operators import history as H
from stepledger.sources.runs import (
    export_step_output,
    list_workspace_files,
    read_artifacts,
    read_caches,
    read_locks,
    read_markers,
    read_runs,
    read_state,
)
from stepledger.storage import work_path

_KEY = ["workspace_id", "step_id"]

# Markers: a committed step in 50, live or stale, and a step never committed for every tenth workspace.
_RUNNING = """running AS (SELECT workspace_id, step_id, CAST(run_id AS BIGINT) % 100 = 0 AS alive FROM v_state WHERE CAST(run_id AS BIGINT) % 50 = 0
    UNION ALL SELECT DISTINCT workspace_id, 'extra', TRUE FROM v_runs WHERE CAST(workspace_id AS BIGINT) % 10 = 0)"""
_SHOW = f"""{_RUNNING},
sizes AS (SELECT run_id, sum(length) AS size FROM v_files GROUP BY run_id),
shown AS (SELECT s.workspace_id, s.step_id, CASE WHEN m.alive THEN '-' ELSE s.run_id END AS run_id,
    CASE WHEN m.alive THEN 'running' WHEN r.run_id IS NULL THEN 'unknown' WHEN r.exit_code = 0 THEN 'success' ELSE 'failure' END AS status,
    CASE WHEN m.alive OR r.run_id IS NULL THEN NULL ELSE r.duration_ms END AS duration_ms,
    CASE WHEN m.alive OR r.run_id IS NULL THEN NULL ELSE coalesce(z.size, 0) END AS artifact_size,
    CASE WHEN m.alive OR r.run_id IS NULL THEN NULL ELSE r.finished_at END AS finished_at, 0 AS section
    FROM v_state s LEFT JOIN running m ON s.workspace_id = m.workspace_id AND s.step_id = m.step_id AND m.alive
      LEFT JOIN v_runs r ON s.run_id = r.run_id AND CAST(r.run_id AS BIGINT) % 17 <> 0 LEFT JOIN sizes z ON s.run_id = z.run_id
    UNION ALL SELECT workspace_id, step_id, '-', 'running', NULL, NULL, NULL, 1 FROM running WHERE step_id = 'extra')"""


def _shown(v: Views) -> DataFrame:
    state = v.state().withColumn("pos", F.col("run_id").cast("bigint"))
    number = F.col("run_id").cast("bigint")
    markers = state.filter(number % 50 == 0).select(*_KEY, (number % 100 == 0).alias("alive"))
    extra = (
        v.runs()
        .filter(F.col("workspace_id").cast("bigint") % 10 == 0)
        .select("workspace_id", F.lit("extra").alias("step_id"), F.lit(True).alias("alive"))
        .distinct()
    )
    running = (
        markers.unionByName(extra)
        .withColumn("step_name", F.lit(None).cast("string"))
        .withColumn("started_at", F.lit("2000-01-01 00:00:00").cast("timestamp"))
    )
    runs = (
        v.runs()
        .filter(number % 17 != 0)
        .withColumn("step_name", F.lit(None).cast("string"))
        .withColumn("status", F.when(F.col("exit_code") == 0, "success").otherwise("failure"))
    )
    return H.show(state, runs, running, v.run_files())


@check(
    "j4_show",
    f"""WITH {_SHOW} SELECT workspace_id, step_id, run_id, status, section,
      CASE WHEN status = 'running' THEN '1m 30s' WHEN duration_ms IS NULL THEN '-' ELSE {DURATION_SQL.format(ms='duration_ms')} END AS duration,
      CASE WHEN coalesce(artifact_size, 0) > 0 THEN {SIZE_SQL.format(n='artifact_size')} ELSE '-' END AS size,
      coalesce(strftime(finished_at, '%Y-%m-%d %H:%M:%S'), '-') AS finished FROM shown""",
)
def show(v: Views) -> DataFrame:
    now = F.lit("2000-01-01 00:01:30").cast("timestamp")
    return _shown(v).select(
        *_KEY,
        F.coalesce("run_id", F.lit("-")).alias("run_id"),
        "status",
        "section",
        shown_duration(F.col("duration_ms"), F.col("started_at"), now).alias("duration"),
        shown_size(F.col("artifact_size")).alias("size"),
        format_finished(F.col("finished_at")).alias("finished"),
    )


@check("a10_show_total", f"WITH {_SHOW} SELECT workspace_id, sum(coalesce(artifact_size, 0)) AS total_size FROM shown GROUP BY workspace_id")
def total(v: Views) -> DataFrame:
    return H.show_total(_shown(v))


@check("a11_active_runs", "SELECT DISTINCT workspace_id, run_id FROM v_state")
def active(v: Views) -> DataFrame:
    return H.active_runs(v.state())


@check(
    "j5_cache_lookup",
    """SELECT r.run_id AS wanted, s.run_id FROM v_runs r JOIN v_state s ON r.workspace_id = s.workspace_id AND r.step_id = s.step_id AND r.image = s.fingerprint
    WHERE CAST(s.run_id AS BIGINT) % 11 <> 0 AND r.step_id <> 'step3'""",
)
def cached(v: Views) -> DataFrame:
    steps = v.runs().select(*_KEY, F.col("image").alias("fingerprint"), F.col("run_id").alias("wanted"))
    kept = v.runs().filter(F.col("run_id").cast("bigint") % 11 != 0)
    return H.cache_lookup(steps, v.state(), kept, force=["step3"]).select("wanted", "run_id")


@check(
    "j7_prune_summary",
    """SELECT r.workspace_id, count(*) FILTER (s.run_id IS NULL) AS removed, coalesce(sum(size) FILTER (s.run_id IS NULL), 0) AS freed_bytes
    FROM v_runs r LEFT JOIN v_state s ON r.workspace_id = s.workspace_id AND r.run_id = s.run_id
    LEFT JOIN (SELECT run_id, sum(length) AS size FROM v_files GROUP BY run_id) z ON r.run_id = z.run_id GROUP BY r.workspace_id""",
)
def prune(v: Views) -> DataFrame:
    return H.prune_summary(v.runs(), v.runs(), v.state(), v.run_files())


@check(
    "j8_current_run",
    """SELECT r.workspace_id, r.step_id, coalesce(s.run_id, '-') AS run_id, CASE WHEN s.run_id IS NULL THEN concat('Step not found: ', r.step_id) ELSE '-' END AS error
    FROM (SELECT workspace_id, step_id FROM v_runs UNION ALL SELECT workspace_id, concat('step', CAST(run_id AS BIGINT) % 11) FROM v_runs) r
    LEFT JOIN v_state s ON r.workspace_id = s.workspace_id AND r.step_id = s.step_id""",
)
def current(v: Views) -> DataFrame:
    runs = v.runs()
    other = runs.select("workspace_id", F.concat(F.lit("step"), F.col("run_id").cast("bigint") % 11).alias("step_id"))
    return H.current_run(runs.select(*_KEY).unionByName(other), v.state()).select(
        *_KEY, F.coalesce("run_id", F.lit("-")).alias("run_id"), F.coalesce("error", F.lit("-")).alias("error")
    )


_LOCKS = "locks AS (SELECT CAST(c_custkey AS VARCHAR) AS workspace_id, c_acctbal > 0 AS alive FROM customer WHERE c_custkey % 4 = 0)"


def _locks(v: Views) -> DataFrame:
    return v.table("customer").filter("c_custkey % 4 = 0").selectExpr(
        "CAST(c_custkey AS STRING) AS workspace_id", "c_acctbal > 0 AS alive"
    )


def _customers(v: Views) -> DataFrame:
    return v.table("customer").selectExpr("CAST(c_custkey AS STRING) AS workspace_id")


@check(
    "j9_unknown_names",
    f"""WITH {_LOCKS}, asked AS (SELECT CAST(s_suppkey * 3 AS VARCHAR) AS workspace_id FROM supplier UNION ALL SELECT s_name FROM supplier)
    SELECT workspace_id, 'unknown' AS why FROM asked WHERE workspace_id NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)
    UNION ALL SELECT workspace_id, 'locked' FROM asked JOIN locks USING (workspace_id) WHERE alive""",
)
def unknown(v: Views) -> DataFrame:
    suppliers = v.table("supplier")
    asked = suppliers.selectExpr("CAST(s_suppkey * 3 AS STRING) AS workspace_id").union(suppliers.select("s_name"))
    return (
        H.unknown_names(asked, _customers(v))
        .withColumn("why", F.lit("unknown"))
        .unionByName(H.locked_names(asked, _locks(v)).withColumn("why", F.lit("locked")))
    )


@check(
    "f7_clean_targets",
    f"WITH {_LOCKS} SELECT CAST(c_custkey AS VARCHAR) AS workspace_id FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT workspace_id FROM locks WHERE alive)",
)
def clean(v: Views) -> DataFrame:
    return H.clean_targets(_customers(v), _locks(v))


_CACHES = "caches AS (SELECT CAST(c_custkey AS VARCHAR) AS workspace_id, unnest(['npm', c_mktsegment]) AS name FROM customer)"


@check(
    "a7_workspace_summary",
    f"""WITH {_CACHES} SELECT workspace_id, coalesce(runs, 0) AS runs, coalesce(caches, 0) AS caches, coalesce(size, 0) AS size
    FROM (SELECT workspace_id, count(*) AS runs FROM v_runs GROUP BY ALL) FULL JOIN (SELECT workspace_id, count(DISTINCT name) AS caches FROM caches GROUP BY ALL) USING (workspace_id)
    FULL JOIN (SELECT workspace_id, sum(length) AS size FROM run_files GROUP BY ALL) USING (workspace_id)""",
)
def summary(v: Views) -> DataFrame:
    caches = v.table("customer").selectExpr(
        "CAST(c_custkey AS STRING) AS workspace_id", "explode(array('npm', c_mktsegment)) AS name"
    )
    return H.workspace_summary(v.runs(), caches, v.run_files())


@check("o3_sorted_workspaces", "SELECT DISTINCT workspace_id FROM v_runs")
def names(v: Views) -> DataFrame:
    return H.sorted_workspaces(v.runs())


@check("w1_latest_run_per_step", "SELECT workspace_id, step_id, run_id, duration_ms FROM v_state JOIN v_runs USING (workspace_id, step_id, run_id)")
def latest(v: Views) -> DataFrame:
    runs = v.runs().withColumn("n", F.col("run_id").cast("bigint"))
    return H.latest_run_per_step(runs, ["finished_at", "n"]).select(*_KEY, "run_id", "duration_ms")


@check(
    "s14_upsert_state",
    """WITH old AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY step_id) - 1 AS pos FROM v_state WHERE step_id < 'step5'),
    writes AS (SELECT workspace_id, step_id, run_id, 'new' AS fingerprint, CAST(run_id AS BIGINT) AS write_no FROM v_runs WHERE CAST(run_id AS BIGINT) % 2 = 0),
    last AS (SELECT workspace_id, step_id, arg_max(run_id, write_no) AS run_id, min(write_no) AS first_write FROM writes GROUP BY ALL),
    merged AS (SELECT workspace_id, step_id, coalesce(l.run_id, o.run_id) AS run_id, CASE WHEN l.run_id IS NULL THEN o.fingerprint ELSE 'new' END AS fingerprint,
      CASE WHEN pos IS NULL THEN 1000000000 + first_write ELSE pos END AS turn FROM old o FULL JOIN last l USING (workspace_id, step_id))
    SELECT workspace_id, step_id, run_id, fingerprint, row_number() OVER (PARTITION BY workspace_id ORDER BY turn) AS place FROM merged""",
)
def upsert(v: Views) -> DataFrame:
    by_name = Window.partitionBy("workspace_id").orderBy("step_id")
    old = v.state().filter("step_id < 'step5'").withColumn("pos", F.row_number().over(by_name) - 1)
    number = F.col("run_id").cast("bigint")
    writes = v.runs().filter(number % 2 == 0).select(
        *_KEY, "run_id", F.lit("new").alias("fingerprint"), number.alias("write_no")
    )
    place = F.row_number().over(Window.partitionBy("workspace_id").orderBy("pos"))
    return H.upsert_state(old, writes).withColumn("place", place).drop("pos")


@check(
    "s15_delete_step_state",
    """SELECT workspace_id, step_id, run_id, 'kept' AS what FROM v_state WHERE step_id NOT IN ('step1', 'step4')
    UNION ALL SELECT workspace_id, step_id, run_id, 'deleted' FROM v_state WHERE step_id IN ('step1', 'step4')
    UNION ALL SELECT workspace_id, step_id, '-', 'unknown' FROM (SELECT DISTINCT workspace_id, unnest(['step1', 'step4', 'step9']) AS step_id FROM v_state) w
      WHERE NOT EXISTS (SELECT 1 FROM v_state s WHERE s.workspace_id = w.workspace_id AND s.step_id = w.step_id)""",
)
def delete(v: Views) -> DataFrame:
    state = v.state()
    asked = state.select("workspace_id", F.explode(F.array(*[F.lit(s) for s in ("step1", "step4", "step9")])).alias("step_id"))
    kept, deleted, unknown_steps = H.delete_step_state(state, asked)
    return (
        kept.select(*_KEY, "run_id", F.lit("kept").alias("what"))
        .unionByName(deleted.select(*_KEY, "run_id", F.lit("deleted").alias("what")))
        .unionByName(unknown_steps.select(*_KEY, F.lit("-").alias("run_id"), F.lit("unknown").alias("what")))
    )


def _write_runs(v: Views) -> str:
    """One run per supplier: metadata (every tenth one cut off in the middle, every ninth one missing) and an artifact of that name."""
    number = F.col("s_suppkey")
    document = F.to_json(
        F.struct(
            number.cast("string").alias("runId"),
            F.concat(F.lit("step"), number % 4).alias("stepId"),
            F.col("s_name").alias("stepName"),
            F.floor("s_acctbal").cast("bigint").alias("durationMs"),
            (number % 3).cast("int").alias("exitCode"),
            F.array(F.lit("run"), "s_name").alias("cmd"),
            F.lit("2024-01-02T03:04:05.678Z").alias("finishedAt"),
        )
    )
    folder = F.concat(F.col("s_nationkey"), F.lit("/runs/"), number)
    meta = F.struct(
        F.concat(folder, F.lit("/meta.json")).alias("path"),
        F.when(number % 10 == 0, F.substring(document, 1, 30)).otherwise(document).alias("content"),
    )
    decoy = F.struct(F.concat(folder, F.lit("/artifacts/meta.json")).alias("path"), F.lit("{}").alias("content"))
    files = F.when(number % 9 == 0, F.array(decoy)).otherwise(F.array(meta, decoy))
    root = work_path(v.spark, "store/runs/of")
    write_files(v.table("supplier").select(F.explode(files).alias("f")).select("f.*").repartition(v.tasks()), root)
    return root


@check(
    "s2_read_runs",
    """SELECT CAST(s_nationkey AS VARCHAR) AS workspace_id, CAST(s_suppkey AS VARCHAR) AS run_id, (s_suppkey % 10 <> 0 AND s_suppkey % 9 <> 0) AS has_meta,
      CASE WHEN (s_suppkey % 10 = 0 OR s_suppkey % 9 = 0) THEN '-' ELSE concat('step', s_suppkey % 4) END AS step_id, CASE WHEN (s_suppkey % 10 = 0 OR s_suppkey % 9 = 0) THEN '-' ELSE s_name END AS step_name,
      CASE WHEN (s_suppkey % 10 = 0 OR s_suppkey % 9 = 0) THEN -1 ELSE s_suppkey % 3 END AS exit_code, CASE WHEN (s_suppkey % 10 = 0 OR s_suppkey % 9 = 0) THEN -99999 ELSE CAST(floor(s_acctbal) AS BIGINT) END AS duration_ms,
      CASE WHEN (s_suppkey % 10 = 0 OR s_suppkey % 9 = 0) THEN '-' ELSE 'run ' || s_name END AS cmd, CASE WHEN (s_suppkey % 10 = 0 OR s_suppkey % 9 = 0) THEN 0 ELSE 1704164645678 END AS finished_ms FROM supplier""",
)
def runs_read(v: Views) -> DataFrame:
    runs = read_runs(v.spark, _write_runs(v))
    return runs.select(
        "workspace_id",
        "run_id",
        "has_meta",
        F.coalesce("step_id", F.lit("-")).alias("step_id"),
        F.coalesce("step_name", F.lit("-")).alias("step_name"),
        F.coalesce("exit_code", F.lit(-1)).alias("exit_code"),
        F.coalesce("duration_ms", F.lit(-99999)).alias("duration_ms"),
        F.coalesce(F.array_join("cmd", " "), F.lit("-")).alias("cmd"),
        F.coalesce(F.unix_millis("finished_at"), F.lit(0)).alias("finished_ms"),
    )


@check(
    "s3_read_state",
    """SELECT concat(s_nationkey, '-', s_suppkey // 1000) AS workspace_id, concat('step', s_suppkey) AS step_id, concat('run', s_suppkey) AS run_id, s_name AS fingerprint,
      row_number() OVER (PARTITION BY s_nationkey, s_suppkey // 1000 ORDER BY s_suppkey) - 1 AS pos FROM supplier""",
)
def state_read(v: Views) -> DataFrame:
    entry = F.struct(
        F.concat(F.lit("step"), "s_suppkey").alias("key"),
        F.struct(F.concat(F.lit("run"), "s_suppkey").alias("runId"), F.col("s_name").alias("fingerprint")).alias("value"),
    )
    documents = (
        v.table("supplier")
        .groupBy(F.expr("concat(s_nationkey, '-', s_suppkey div 1000)").alias("nation"))  # at most 1000 steps each
        .agg(F.array_sort(F.collect_list(F.struct("s_suppkey", entry.alias("entry")))).alias("entries"))
        .select("nation", F.to_json(F.struct(F.map_from_entries("entries.entry").alias("steps"))).alias("value"))
    )
    root = work_path(v.spark, "state")
    write_files(documents.select(F.concat("nation", F.lit("/state.json")).alias("path"), F.col("value").alias("content")), root)
    return read_state(v.spark, root)


@check(
    "s8_read_artifacts",
    """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN '-' WHEN s_suppkey % 7 = 0 THEN '-' ELSE 'name=' || s_name || chr(10) END AS content,
      CASE WHEN s_suppkey % 7 = 0 THEN concat('Step not found: none', s_suppkey) WHEN s_suppkey % 5 = 0 THEN 'Invalid path: must be within artifacts directory' ELSE '-' END AS error FROM supplier""",
)
def artifacts(v: Views) -> DataFrame:
    number = F.col("s_suppkey")
    suppliers = v.table("supplier").withColumn("workspace_id", F.col("s_nationkey").cast("string"))
    file = F.concat(F.lit("of/s"), number, F.lit(" [x].txt"))
    written = suppliers.select(
        F.concat("workspace_id", F.lit("/runs/all/artifacts/"), file).alias("path"),
        F.concat(F.lit("name="), "s_name", F.lit("\n")).alias("content"),
    )
    root = work_path(v.spark, "artifacts")
    write_files(written.repartition(v.tasks()), root)
    asked = suppliers.select(
        number.alias("id"),
        "workspace_id",
        F.when(number % 7 == 0, F.concat(F.lit("none"), number)).otherwise(F.lit("build")).alias("step_id"),
        F.when(number % 5 == 0, F.concat(F.lit("../other/"), file)).otherwise(F.concat(F.lit("./x/../"), file)).alias("path"),
    )
    state = suppliers.select("workspace_id", F.lit("build").alias("step_id"), F.lit("all").alias("run_id")).distinct()
    return read_artifacts(v.spark, root, asked, state).select(
        "id",
        F.coalesce(F.decode("content", "utf-8"), F.lit("-")).alias("content"),
        F.coalesce("error", F.lit("-")).alias("error"),
    )


@check(
    "s2_running_steps",
    """SELECT CAST(s_nationkey AS VARCHAR) AS workspace_id, concat('step', s_suppkey) AS step_id, s_suppkey AS pid, 1704164645678 AS started_ms, s_suppkey % 4 = 0 AS alive
    FROM supplier WHERE s_suppkey % 6 <> 0""",
)
def markers(v: Views) -> DataFrame:
    number = F.col("s_suppkey")
    document = F.to_json(F.struct(F.lit("2024-01-02T03:04:05.678Z").alias("startedAt"), number.alias("pid"), F.col("s_name").alias("stepName")))
    files = v.table("supplier").select(
        F.concat(F.col("s_nationkey"), F.lit("/running/step"), number).alias("path"),
        F.when(number % 6 == 0, F.substring(document, 1, 20)).otherwise(document).alias("content"),
    )
    root = work_path(v.spark, "markers")
    write_files(files.repartition(v.tasks()), root)
    live = v.table("supplier").filter(number % 4 == 0).select(number.alias("pid"))
    return read_markers(v.spark, root, live).select("workspace_id", "step_id", "pid", F.unix_millis("started_at").alias("started_ms"), "alive")


@check(
    "s2_locks",
    """SELECT concat('ws', s_suppkey) AS workspace_id, s_suppkey AS pid, s_suppkey % 4 = 0 AS alive FROM supplier WHERE s_suppkey % 6 <> 0""",
)
def locks(v: Views) -> DataFrame:
    number = F.col("s_suppkey")
    document = F.to_json(F.struct(number.alias("pid"), F.lit("").alias("socketPath"), F.lit("2024-01-02T03:04:05.678Z").alias("startedAt"), F.lit(1).alias("version")))
    files = v.table("supplier").select(
        F.concat(F.lit("ws"), number, F.lit("/daemon.json")).alias("path"),
        F.when(number % 6 == 0, F.lit("{")).otherwise(document).alias("content"),
    )
    root = work_path(v.spark, "locks")
    write_files(files.repartition(v.tasks()), root)
    live = v.table("supplier").filter(number % 4 == 0).select(number.alias("pid"))
    return read_locks(v.spark, root, live).select("workspace_id", "pid", "alive")


@check(
    "a7_workspace_files",
    """SELECT CAST(s_nationkey AS VARCHAR) AS workspace_id, count(*) FILTER (s_suppkey % 3 = 0) AS runs, count(*) FILTER (s_suppkey % 3 = 1) AS caches, sum(length(s_name)) AS size
    FROM supplier GROUP BY s_nationkey""",
)
def whole_workspaces(v: Views) -> DataFrame:
    number = F.col("s_suppkey")
    place = F.when(number % 3 == 0, F.concat(F.lit("runs/r"), number, F.lit("/artifacts/a/runs/b"))).when(
        number % 3 == 1, F.concat(F.lit("caches/c"), number, F.lit("/x"))
    )
    files = v.table("supplier").select(
        F.concat(F.col("s_nationkey"), F.lit("/"), F.coalesce(place, F.concat(F.lit("staging/s"), number))).alias("path"),
        F.col("s_name").alias("content"),
    )
    root = work_path(v.spark, "store/runs/whole")
    write_files(files.repartition(v.tasks()), root)
    return H.workspace_summary(read_runs(v.spark, root), read_caches(v.spark, root), list_workspace_files(v.spark, root))


@check(
    "j8_inspect_runs",
    """SELECT r.workspace_id, r.step_id, coalesce(CAST(m.duration_ms AS VARCHAR), '-') AS duration,
      CASE WHEN s.run_id IS NULL THEN 'step' WHEN m.run_id IS NULL THEN 'meta' ELSE '-' END AS error
    FROM (SELECT DISTINCT workspace_id, concat('step', CAST(run_id AS BIGINT) % 11) AS step_id FROM v_runs) r
    LEFT JOIN v_state s ON r.workspace_id = s.workspace_id AND r.step_id = s.step_id LEFT JOIN v_runs m ON s.run_id = m.run_id AND CAST(m.run_id AS BIGINT) % 17 <> 0""",
)
def inspected(v: Views) -> DataFrame:
    runs = v.runs()
    number = F.col("run_id").cast("bigint")
    asked = runs.select("workspace_id", F.concat(F.lit("step"), number % 11).alias("step_id")).distinct()
    found = H.inspect_runs(asked, v.state(), runs.filter(number % 17 != 0))
    kind = F.when(F.col("error").startswith("Step"), "step").when(F.col("error").startswith("No metadata"), "meta").otherwise("-")
    return found.select(*_KEY, F.coalesce(F.col("meta.duration_ms").cast("string"), F.lit("-")).alias("duration"), kind.alias("error"))


@check(
    "s7_list_artifacts",
    """WITH asked AS (SELECT s.workspace_id, s.step_id, s.run_id, unnest(['', 'R', './R/../A/', '..', 'none']) AS path, unnest(['artifacts', 'artifacts/R', 'artifacts/A', NULL, 'artifacts/none']) AS dir FROM v_state s),
    hit AS (SELECT a.*, f.path AS file, f.length, string_split(f.path[length(a.dir) + 2:], '/') AS rest FROM asked a JOIN v_files f ON a.run_id = f.run_id AND starts_with(f.path, a.dir || '/')),
    entries AS (SELECT workspace_id, step_id, path, rest[1] AS name, CASE WHEN len(rest) > 1 THEN 'directory' ELSE 'file' END AS type, max(CASE WHEN len(rest) > 1 THEN 0 ELSE length END) AS size FROM hit GROUP BY ALL)
    SELECT workspace_id, step_id, path, name, type, size, '-' AS error FROM entries
    UNION ALL SELECT workspace_id, step_id, path, '-', '-', -1, CASE WHEN path = '..' THEN 'Invalid path: must be within artifacts directory' ELSE 'Folder not found: ' || path END FROM asked a
      WHERE path <> '' AND NOT EXISTS (SELECT 1 FROM entries e WHERE e.workspace_id = a.workspace_id AND e.step_id = a.step_id AND e.path = a.path)""",
)
def listed_artifacts(v: Views) -> DataFrame:
    state = v.state()
    asked = state.select(*_KEY, F.explode(F.array(*[F.lit(x) for x in ("", "R", "./R/../A/", "..", "none")])).alias("path"))
    return H.list_artifacts(asked, state, v.run_files()).select(
        *_KEY, "path", *[F.coalesce(c, F.lit("-")).alias(c) for c in ("name", "type", "error")], F.coalesce("size", F.lit(-1)).alias("size")
    )


@check("s17_export_step_output", "SELECT l_returnflag, count(*) AS n, sum(l_linenumber) AS lines FROM lineitem GROUP BY l_returnflag")
def exported(v: Views) -> DataFrame:
    """The lines of each flag are the output of the flag's own step."""
    root, dest = work_path(v.spark, "export"), work_path(v.spark, "dest")
    lines = v.table("lineitem").select("l_returnflag", "l_linenumber")
    flags = lines.select(F.col("l_returnflag").alias("step_id")).distinct()
    state = flags.select(F.lit("ws").alias("workspace_id"), "step_id", F.concat(F.lit("run"), "step_id").alias("run_id"))
    # One write per flag, as there is one export per step.
    steps = sorted(r.step_id for r in state.select("step_id").collect())
    for step in steps:
        lines.filter(F.col("l_returnflag") == step).write.parquet(f"{root}/ws/runs/run{step}/artifacts")
        export_step_output(v.spark, state, "ws", step, root, f"{dest}/{step}")
    out = v.spark.read.schema(lines.schema).parquet(*[f"{dest}/{step}" for step in steps])
    return out.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))
