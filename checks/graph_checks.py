"""Dependency graphs of all pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.base import Views, check
from stepledger.functions.fingerprint import fingerprint
from stepledger.operators import graph as G
from stepledger.operators.inputs import copy_to_output, resolve_inputs
from stepledger.storage import materialize

_NODE = ["pipeline_id", "step_id"]


def _graph(v: Views) -> tuple[DataFrame, DataFrame]:
    """Steps and edges, written once, since graph operators read them in several rounds."""
    steps = materialize(v.steps(), "steps")
    return steps, materialize(G.merge_edges(v.inputs(steps)), "edges")


@check("g1_build_edges", "SELECT * FROM edges")
def edges(v: Views) -> DataFrame:
    nested = (
        v.inputs()
        .groupBy(*_NODE)
        .agg(F.collect_list(F.struct(F.col("dep_id").alias("step"), F.lit(False).alias("copy_to_output"), "optional")).alias("inputs"))
    )
    return G.build_edges(nested).drop("copy_to_output")


@check("j1_missing_refs", "SELECT pipeline_id, step_id, dep_id FROM edges WHERE dep_id = 'missing' AND NOT any_optional")
def missing(v: Views) -> DataFrame:
    return G.missing_refs(G.merge_edges(v.inputs()), v.steps())


_LEAVES = "SELECT pipeline_id, step_id FROM v_steps s WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.pipeline_id = s.pipeline_id AND e.dep_id = s.step_id)"


@check("j2_leaf_steps", _LEAVES)
def leaves(v: Views) -> DataFrame:
    return G.leaf_steps(v.steps().select(*_NODE), G.merge_edges(v.inputs()))


@check("j3_existing_deps", "SELECT pipeline_id, step_id, dep_id FROM links")
def existing(v: Views) -> DataFrame:
    return G.existing_deps(G.merge_edges(v.inputs()), v.steps()).select(*_NODE, "dep_id")


@check(
    "a6_in_degree",
    "SELECT s.pipeline_id, s.step_id, count(l.dep_id) AS in_degree FROM v_steps s LEFT JOIN links l ON s.pipeline_id = l.pipeline_id AND s.step_id = l.step_id GROUP BY ALL",
)
def degrees(v: Views) -> DataFrame:
    return G.in_degree(v.steps(), G.merge_edges(v.inputs()))


@check("g2_topological_levels", "SELECT pipeline_id, step_id, level FROM levels")
def levels(v: Views) -> DataFrame:
    return G.topological_levels(*_graph(v))


@check(
    "g3_cyclic_steps",
    """WITH behind AS (SELECT pipeline_id, 's2' AS step_id FROM v_steps WHERE step_id = 's4' AND CAST(pipeline_id AS BIGINT) % 3 = 0
      UNION SELECT l.pipeline_id, l.step_id FROM behind b JOIN links l ON l.pipeline_id = b.pipeline_id AND l.dep_id = b.step_id)
    SELECT pipeline_id, step_id FROM behind UNION SELECT pipeline_id, step_id FROM v_steps WHERE step_id = 's1' AND CAST(pipeline_id AS BIGINT) % 100 = 1
    UNION SELECT pipeline_id, step_id FROM v_steps WHERE CAST(pipeline_id AS BIGINT) % 100 = 1""",
)
def cycles(v: Views) -> DataFrame:
    # A back edge s2 -> s4 in every third pipeline, a self-loop on s1 (the root of all) in every hundredth.
    steps, found = _graph(v)
    number = F.col("pipeline_id").cast("bigint")
    back = steps.filter((F.col("step_id") == "s4") & (number % 3 == 0)).select(
        "pipeline_id", F.lit("s2").alias("step_id"), F.lit("s4").alias("dep_id")
    )
    loops = steps.filter((F.col("step_id") == "s1") & (number % 100 == 1)).select(
        "pipeline_id", "step_id", F.col("step_id").alias("dep_id")
    )
    return G.cyclic_steps(steps, found.select(*_NODE, "dep_id").unionByName(back).unionByName(loops))


@check(
    "g4_ancestor_closure",
    """WITH up AS (SELECT pipeline_id, step_id FROM v_steps WHERE o_orderkey % 7 = 0
      UNION SELECT pipeline_id, 'ghost' FROM v_steps WHERE o_orderkey % 50 = 0
      UNION SELECT e.pipeline_id, e.dep_id FROM up JOIN edges e ON e.pipeline_id = up.pipeline_id AND e.step_id = up.step_id)
    SELECT * FROM up""",
)
def closure(v: Views) -> DataFrame:
    steps, found = _graph(v)
    known = steps.filter("o_orderkey % 7 = 0").select(*_NODE)
    ghosts = steps.filter("o_orderkey % 50 = 0").select("pipeline_id", F.lit("ghost").alias("step_id"))
    return G.ancestor_closure(found, known.unionByName(ghosts))


_ACTIVE = """active AS (SELECT pipeline_id, step_id FROM v_steps WHERE prio = '1' AND o_orderkey % 3 = 0
    UNION SELECT l.pipeline_id, l.dep_id FROM active a JOIN links l ON l.pipeline_id = a.pipeline_id AND l.step_id = a.step_id)"""


def _targets(steps: DataFrame) -> DataFrame:
    return steps.filter("prio = '1' AND o_orderkey % 3 = 0").select(*_NODE)


@check("g5_active_steps", f"WITH {_ACTIVE} SELECT *, 'targets' AS scope FROM active UNION ALL SELECT pipeline_id, step_id, 'leaves' FROM v_steps")
def active(v: Views) -> DataFrame:
    steps, found = _graph(v)
    chosen = G.active_steps(steps, found, _targets(steps)).select(*_NODE, F.lit("targets").alias("scope"))
    return chosen.unionByName(G.active_steps(steps, found).select(*_NODE, F.lit("leaves").alias("scope")))


@check("g6_execution_plan", f"WITH {_ACTIVE} SELECT l.pipeline_id, l.level, l.step_id FROM levels l JOIN active USING (pipeline_id, step_id)")
def plan(v: Views) -> DataFrame:
    steps, found = _graph(v)
    return G.execution_plan(steps, found, _targets(steps))


@check(
    "u3_active_levels",
    """SELECT pipeline_id, step_id, CAST(dense_rank() OVER (PARTITION BY pipeline_id ORDER BY level) - 1 AS INT) AS level
    FROM levels JOIN v_steps USING (pipeline_id, step_id) WHERE prio IN ('1', '2') AND i > 1""",
)
def kept_levels(v: Views) -> DataFrame:
    steps, found = _graph(v)
    chosen = steps.filter("prio IN ('1', '2') AND i > 1")
    return G.active_levels(G.topological_levels(steps, found), chosen, renumber=True)


_OUTCOMES = """blocked AS (SELECT e.pipeline_id, e.step_id FROM edges e JOIN v_steps d ON e.pipeline_id = d.pipeline_id AND e.dep_id = d.step_id
      WHERE e.any_required AND d.own_outcome IN ('failed', 'condition')
    UNION SELECT e.pipeline_id, e.step_id FROM blocked b JOIN edges e ON e.pipeline_id = b.pipeline_id AND e.dep_id = b.step_id WHERE e.any_required),
outcomes AS (SELECT s.pipeline_id, s.step_id, s.i, CASE WHEN b.step_id IS NOT NULL OR own_outcome = 'condition' THEN 'skipped' ELSE own_outcome END AS outcome,
    CASE WHEN b.step_id IS NOT NULL THEN 'dependency' WHEN own_outcome = 'condition' THEN 'condition' ELSE '-' END AS reason
    FROM v_steps s LEFT JOIN blocked b ON s.pipeline_id = b.pipeline_id AND s.step_id = b.step_id)"""


def _own(steps: DataFrame) -> DataFrame:
    return steps.select(*_NODE, F.col("own_outcome").alias("outcome"))


@check("g7_step_outcomes", f"WITH {_OUTCOMES} SELECT pipeline_id, step_id, outcome, reason FROM outcomes")
def outcomes(v: Views) -> DataFrame:
    steps, found = _graph(v)
    return G.step_outcomes(steps, found, _own(steps)).withColumn("reason", F.coalesce("reason", F.lit("-")))


@check(
    "a13_job_outcome",
    f"""WITH {_OUTCOMES} SELECT pipeline_id, CASE WHEN bool_or(outcome = 'failed') THEN 'failed' ELSE 'completed' END AS status,
      coalesce(arg_min(step_id, level * 1000 + i) FILTER (outcome = 'failed'), '-') AS first_failed
    FROM outcomes JOIN levels USING (pipeline_id, step_id) GROUP BY pipeline_id""",
)
def jobs(v: Views) -> DataFrame:
    steps, found = _graph(v)
    levels = materialize(G.topological_levels(steps, found), "levels")
    placed = G.step_outcomes(steps, found, _own(steps), levels=levels).join(levels, _NODE).join(
        steps.select(*_NODE, F.col("i").alias("pos")), _NODE
    )
    return G.job_outcome(placed).withColumn("first_failed", F.coalesce("first_failed", F.lit("-")))


_DRY = """seeds AS (SELECT pipeline_id, step_id FROM v_steps WHERE o_orderkey % 23 = 0),
skipped AS (SELECT pipeline_id, step_id FROM seeds
    UNION SELECT e.pipeline_id, e.step_id FROM skipped b JOIN edges e ON e.pipeline_id = b.pipeline_id AND e.dep_id = b.step_id WHERE e.any_required),
behind AS (SELECT e.pipeline_id, e.step_id FROM seeds b JOIN edges e ON e.pipeline_id = b.pipeline_id AND e.dep_id = b.step_id WHERE e.any_required
    UNION SELECT e.pipeline_id, e.step_id FROM behind b JOIN edges e ON e.pipeline_id = b.pipeline_id AND e.dep_id = b.step_id WHERE e.any_required),
dirty AS (SELECT pipeline_id, step_id FROM skipped UNION SELECT pipeline_id, step_id FROM v_steps WHERE o_orderkey % 9 = 0 OR o_orderkey % 31 = 0 OR step_id = 's9'
    UNION SELECT l.pipeline_id, l.step_id FROM dirty d JOIN links l ON l.pipeline_id = d.pipeline_id AND l.dep_id = d.step_id)"""


@check(
    "g8_dry_run",
    f"""WITH {_DRY} SELECT s.pipeline_id, s.step_id,
      CASE WHEN k.step_id IS NOT NULL THEN 'skipped' WHEN d.step_id IS NOT NULL THEN 'would_run' ELSE 'cached' END AS outcome,
      CASE WHEN b.step_id IS NOT NULL THEN 'dependency' WHEN k.step_id IS NOT NULL THEN 'condition' WHEN d.step_id IS NOT NULL THEN '-' ELSE 'cached' END AS reason,
      CASE WHEN k.step_id IS NULL AND d.step_id IS NULL THEN 'r' || s.o_orderkey ELSE '-' END AS run_id
    FROM v_steps s LEFT JOIN skipped k ON s.pipeline_id = k.pipeline_id AND s.step_id = k.step_id
      LEFT JOIN behind b ON s.pipeline_id = b.pipeline_id AND s.step_id = b.step_id
      LEFT JOIN dirty d ON s.pipeline_id = d.pipeline_id AND s.step_id = d.step_id""",
)
def dry(v: Views) -> DataFrame:
    # The stored state is that of a full run in which every ninth step had another image. Some runs are gone.
    steps, found = _graph(v)
    steps = steps.withColumn("cmd", F.array(F.lit("run"), "prio")).withColumn("condition_met", F.col("o_orderkey") % 23 != 0)
    run_id = F.concat(F.lit("r"), "o_orderkey")
    before = steps.select(
        *_NODE, "cmd", "o_orderkey", run_id.alias("run_id"),
        F.when(F.col("o_orderkey") % 9 == 0, F.lit("old")).otherwise(F.col("image")).alias("image"),
    )
    # From the inputs as they are named, repeats included.
    inputs = v.inputs(steps).join(
        before.select("pipeline_id", F.col("step_id").alias("dep_id"), "run_id"), ["pipeline_id", "dep_id"], "left"
    )
    ids = inputs.groupBy(*_NODE).agg(F.collect_list("run_id").alias("ids"))
    state = before.join(ids, _NODE, "left").select(
        *_NODE, "run_id", fingerprint(F.col("image"), F.col("cmd"), input_run_ids=F.col("ids")).alias("fingerprint")
    )
    runs = before.filter("o_orderkey % 31 <> 0").select("pipeline_id", "run_id")
    result = G.dry_run(steps, found, state, runs, force=["s9"])
    return result.select(
        *_NODE, "outcome", F.coalesce("reason", F.lit("-")).alias("reason"), F.coalesce("run_id", F.lit("-")).alias("run_id")
    )


@check(
    "j6_resolve_inputs",
    """SELECT e.pipeline_id, e.step_id, e.dep_id AS dep, coalesce('r' || d.o_orderkey, '-') AS run_id, '/input/' || e.dep_id AS path, 'metadata' AS form
      FROM edges e LEFT JOIN v_steps d ON e.pipeline_id = d.pipeline_id AND e.dep_id = d.step_id AND d.own_outcome = 'finished'
    UNION ALL SELECT e.pipeline_id, e.step_id, '-', 'r' || d.o_orderkey, '/input/' || e.dep_id, 'mount'
      FROM edges e JOIN v_steps d ON e.pipeline_id = d.pipeline_id AND e.dep_id = d.step_id AND d.own_outcome = 'finished'""",
)
def resolved(v: Views) -> DataFrame:
    runs = v.steps().filter("own_outcome = 'finished'").select(*_NODE, F.concat(F.lit("r"), "o_orderkey").alias("run_id"))
    metadata, mounts = resolve_inputs(G.merge_edges(v.inputs()), runs)
    return metadata.select(
        *_NODE, F.col("dep_id").alias("dep"), F.coalesce("run_id", F.lit("-")).alias("run_id"),
        F.col("mounted_as").alias("path"), F.lit("metadata").alias("form"),
    ).unionByName(
        mounts.select(
            *_NODE, F.lit("-").alias("dep"), "run_id", F.col("container_path").alias("path"), F.lit("mount").alias("form")
        )
    )


@check(
    "j14_copy_to_output",
    """WITH turns AS (SELECT s.pipeline_id, s.step_id, CAST(d.o_orderkey AS VARCHAR) AS run_id, CASE WHEN l.dep_id = concat('s', CAST(floor(s.i / 2.0) AS INT)) THEN 0 ELSE 1 END AS turn
      FROM links l JOIN v_steps s ON l.pipeline_id = s.pipeline_id AND l.step_id = s.step_id JOIN v_steps d ON l.pipeline_id = d.pipeline_id AND l.dep_id = d.step_id
      WHERE NOT l.any_optional
      UNION ALL SELECT pipeline_id, step_id, CAST(o_orderkey AS VARCHAR), 2 FROM v_steps),
    own_files AS (SELECT run_id, path, max(length) AS length FROM v_files GROUP BY ALL)
    SELECT pipeline_id, step_id, path, arg_max(run_id, turn) AS source_run, arg_max(length, turn) AS length FROM turns JOIN own_files USING (run_id) GROUP BY ALL""",
)
def copied(v: Views) -> DataFrame:
    steps = v.steps()
    inputs = (
        G.merge_edges(v.inputs(steps))
        .join(steps.select(*_NODE, "i"), _NODE)
        .select(
            *_NODE,
            "dep_id",
            (F.col("dep_id") != F.concat(F.lit("s"), F.floor(F.col("i") / 2).cast("int"))).cast("int").alias("pos"),
            (~F.col("any_optional")).alias("copy_to_output"),
        )
    )
    runs = steps.select(*_NODE, F.col("o_orderkey").cast("string").alias("run_id"))
    files = v.files().groupBy("run_id", "path").agg(F.max("length").alias("length"))
    return copy_to_output(inputs, runs, files)
