"""Dependency-graph operators over all graphs of a fleet at once.

``steps`` holds ``(pipeline_id, step_id, …)``, ``edges`` holds one row per distinct pair
``(pipeline_id, step_id, dep_id, any_optional, any_required, uses)``: ``step_id`` depends on ``dep_id``, named ``uses`` times.

The loops advance *every* graph per round, so the number of rounds depends on the greatest depth, not on the number of
graphs. Each round reads what the round before left over, never what is settled, and writes its new rows into its own
sub-folder of one work table. All rounds together are one plain scan of that table, so plans stay small, and a lost
executor only repeats a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepledger.functions.fingerprint import fingerprint
from stepledger.storage import materialize, path_exists, remove_path, work_path, work_table

P = "pipeline_id"
_NODE = [P, "step_id"]


def build_edges(steps: DataFrame) -> DataFrame:
    """Distinct edges of steps with an ``inputs`` array."""
    return merge_edges(
        steps.select(P, "step_id", F.explode("inputs").alias("input")).select(
            P,
            "step_id",
            F.col("input.step").alias("dep_id"),
            F.col("input.optional").alias("optional"),
            F.col("input.copy_to_output").alias("copy_to_output"),
        )
    )


def merge_edges(inputs: DataFrame) -> DataFrame:
    """One edge per (step, dep) of input rows, with the number of its ``uses``; repeated inputs may differ in their flags."""
    optional = F.coalesce(F.col("optional"), F.lit(False))
    flags = [F.bool_or(optional).alias("any_optional"), F.bool_or(~optional).alias("any_required")]
    flags.append(F.count(F.lit(1)).alias("uses"))
    if "copy_to_output" in inputs.columns:
        flags.append(F.bool_or(F.coalesce("copy_to_output", F.lit(False))).alias("copy_to_output"))
    return inputs.groupBy(P, "step_id", "dep_id").agg(*flags)


def missing_refs(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """Edges to steps that do not exist, unless one occurrence of the pair is optional."""
    nodes = steps.select(P, F.col("step_id").alias("dep_id"))
    return edges.filter(~F.col("any_optional")).join(nodes, [P, "dep_id"], "left_anti").select(P, "step_id", "dep_id")


def existing_deps(edges: DataFrame, steps: DataFrame) -> DataFrame:
    nodes = steps.select(P, F.col("step_id").alias("dep_id"))
    return edges.join(nodes, [P, "dep_id"], "left_semi")


def leaf_steps(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps that no step depends on. The depended-on names are made distinct before the join."""
    depended = edges.select(P, F.col("dep_id").alias("step_id")).distinct()
    return steps.join(depended, _NODE, "left_anti")


def in_degree(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of existing dependencies of every step."""
    degrees = existing_deps(edges, steps).groupBy(*_NODE).agg(F.count(F.lit(1)).alias("in_degree"))
    return (
        steps.select(*_NODE)
        .distinct()
        .join(degrees, _NODE, "left")
        .select(*_NODE, F.coalesce("in_degree", F.lit(0)).alias("in_degree"))
    )


def _schema(df: DataFrame, *extra: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(name, data_type) for name, data_type in extra]])


_LINK = f"{P} STRING, step_id STRING, dep_id STRING, spent BOOLEAN"


def _peel(steps: DataFrame, links: DataFrame, folder: str) -> int:
    """Retire links level by level below ``folder``: ``level=k/spent=true`` has those whose dep stands on level ``k``.

    A step stands one level above the round that retired its last link. Links whose dep still waits (``spent=false``) are all
    that the next round reads, beside the links just retired. Returns the last round, which leaves those behind cycles.
    """
    spark = steps.sparkSession
    placed, live, level = steps.select(*_NODE).distinct().join(links, _NODE, "left_anti"), links, 0
    while True:
        done = placed.select(P, F.col("step_id").alias("dep_id"), F.lit(True).alias("spent"))
        round_folder = f"{folder}/level={level}"
        marked = live.join(done, [P, "dep_id"], "left").select(*_NODE, "dep_id", F.coalesce("spent", F.lit(False)).alias("spent"))
        marked.write.partitionBy("spent").parquet(round_folder)
        # A partition folder exists only if it has rows.
        if not all(path_exists(spark, f"{round_folder}/spent={flag}") for flag in ("true", "false")):
            return level
        found = spark.read.schema(_LINK).parquet(round_folder)
        live = found.filter("NOT spent").drop("spent")
        placed = found.groupBy(*_NODE).agg(F.bool_and("spent").alias("all")).filter("all")
        level += 1


def _levels(steps: DataFrame, edges: DataFrame) -> tuple[DataFrame, bool]:
    """The levels, and whether a cycle keeps some steps from having one."""
    spark = steps.sparkSession
    folder = work_path(spark, "levels")
    with work_table(existing_deps(edges, steps).select(*_NODE, "dep_id"), "links") as links:
        last = _peel(steps, links, folder)
    rounds = spark.read.schema(f"{_LINK}, level INT").parquet(folder)
    stuck = rounds.filter((F.col("level") == last) & ~F.col("spent"))
    above = rounds.filter("spent").groupBy(*_NODE).agg(F.max("level").alias("below"))
    placed = steps.select(*_NODE).distinct().join(stuck, _NODE, "left_anti").join(above, _NODE, "left")
    cyclic = path_exists(spark, f"{folder}/level={last}/spent=false")
    return placed.select(*_NODE, F.coalesce(F.col("below") + 1, F.lit(0)).alias("level")), cyclic


def topological_levels(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """``(pipeline_id, step_id, level)``: 0 without existing deps, else one more than the deepest dep.

    Steps on or behind a cycle get no row.
    """
    return _levels(steps, edges)[0]


def cyclic_steps(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps on a cycle or behind one."""
    return steps.select(*_NODE).distinct().join(topological_levels(steps, edges), _NODE, "left_anti")


#: Links that one round of ``reachable`` follows, rounds without contraction, and passes of it between two later rounds.
HOPS, PLAIN_ROUNDS, PASSES = 2, 4, 3
_PAIR = [P, "source", "target"]


def _contracted(links: DataFrame, salt: int, folder: str) -> DataFrame:
    """Links without some of the steps that have one way in and one way out; those go to ``folder`` with the step before them.

    Such a step is reached exactly if the one before it is. Of neighbours the one with the least hash goes, so about a third of
    a chain at a time and never two in a row.
    """
    spark = links.sparkSession
    nothing = F.lit(None).cast("string")
    ends = links.select(P, F.col("target").alias("node"), F.col("source").alias("before"), nothing.alias("after")).unionByName(
        links.select(P, F.col("source").alias("node"), nothing.alias("before"), F.col("target").alias("after"))
    )
    ways = ends.groupBy(P, "node").agg(*[f(c).alias(f"{n}_{c}") for c in ("before", "after") for n, f in (("min", F.min), ("max", F.max))])
    of = lambda name: F.xxhash64(F.lit(salt), P, name)
    inner = (F.col("min_before") == F.col("max_before")) & (F.col("min_after") == F.col("max_after"))
    least = (of("node") < of("min_before")) & (of("node") < of("min_after"))
    ways.filter(inner & least).select(P, "node", F.col("min_before").alias("before"), F.col("min_after").alias("after")).write.parquet(folder)
    gone = spark.read.schema(f"{P} STRING, node STRING, before STRING, after STRING").parquet(folder)
    kept = links
    for end in ("source", "target"):
        kept = kept.join(gone.select(P, F.col("node").alias(end)), [P, end], "left_anti")
    return kept.select(*_PAIR).unionByName(gone.select(P, F.col("before").alias("source"), F.col("after").alias("target")))


def _with_contracted(reached: DataFrame, folder: str, passes: int) -> DataFrame:
    """``reached`` and all contracted steps whose last kept step is reached. A step hangs below at most ``passes`` others."""
    spark = reached.sparkSession
    schema = f"{P} STRING, node STRING, before STRING"
    hung, ties = spark.read.schema(schema).parquet(f"{folder}/*"), 1
    while ties < passes:
        # Every step is tied to the one that its own was tied to, so the distance to the last one kept is halved.
        up = hung.select(P, F.col("node").alias("before"), F.col("before").alias("higher"))
        hung = materialize(hung.join(up, [P, "before"], "left").select(P, "node", F.coalesce("higher", "before").alias("before")), "hung")
        ties *= 2
    kept = hung.join(reached.select(P, F.col("step_id").alias("before")), [P, "before"], "left_semi")
    return reached.unionByName(kept.select(P, F.col("node").alias("step_id")))


def _sweep(seeds: DataFrame, links: DataFrame, folder: str, hung: str) -> tuple[int, int]:
    """The rounds of ``reachable``: steps found go to ``folder``, contracted ones to ``hung``. Returns rounds and passes."""
    spark = seeds.sparkSession
    schema = seeds.schema
    seeds.write.parquet(f"{folder}/round=0")
    newest = spark.read.schema(schema).parquet(f"{folder}/round=0")
    live, rounds, passes, written = links.select(*_PAIR), 0, 0, None
    while True:
        # Most graphs are done in a few rounds; what has been reached leaves the links of the others, once and then round by round.
        reached = spark.read.schema(schema).parquet(f"{folder}/*") if not passes else newest
        if rounds >= PLAIN_ROUNDS:
            live = live.join(reached.withColumnRenamed("step_id", "target"), [P, "target"], "left_anti")
            for _ in range(PASSES):
                before, written = written, work_path(spark, "live")
                _contracted(live, passes, f"{hung}/{passes}").write.parquet(written)
                live, passes = spark.read.schema(f"{P} STRING, source STRING, target STRING").parquet(written), passes + 1
                if before is not None:
                    remove_path(spark, before)
        found = newest
        for _ in range(HOPS):  # each keeps what it came from, so one plan holds each hop once
            both = F.explode(F.array_compact(F.array("source", "target"))).alias("step_id")
            found = found.withColumnRenamed("step_id", "source").join(live, [P, "source"], "left").select(P, both).distinct()
        rounds += 1
        found.join(reached, _NODE, "left_anti").write.parquet(f"{folder}/round={rounds}")
        newest = spark.read.schema(schema).parquet(f"{folder}/round={rounds}")
        if newest.isEmpty():
            if written is not None:
                remove_path(spark, written)
            return rounds, passes


def reachable(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """``(pipeline_id, step_id)`` of the seeds and everything reachable over ``links (…, source, target)``.

    A round follows HOPS links. After PLAIN_ROUNDS the links that lead to steps reached are dropped, so that later rounds read
    neither these nor the steps found before, and the rest is contracted: a chain takes a number of rounds that grows with the
    logarithm of its length, and all rounds together read and write rows in proportion to its links.
    """
    spark: SparkSession = seeds.sparkSession
    folder, hung = work_path(spark, "reached"), work_path(spark, "hung")
    seeds = seeds.select(*_NODE).distinct()
    _, passes = _sweep(seeds, links, folder, hung)
    reached = spark.read.schema(_schema(seeds, ("round", T.IntegerType()))).parquet(folder).select(*_NODE)
    return _with_contracted(reached, hung, passes) if passes else reached


def ancestor_closure(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets and all they depend on, over optional edges too; unknown names stay in the result."""
    upwards = edges.select(P, F.col("step_id").alias("source"), F.col("dep_id").alias("target"))
    with work_table(upwards, "links") as links:
        return reachable(targets, links)


def active_steps(steps: DataFrame, edges: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Steps needed for the targets; the default targets are the leaves."""
    targets = leaf_steps(steps, edges) if targets is None else targets
    return steps.join(ancestor_closure(edges, targets), _NODE, "left_semi")


def active_levels(levels: DataFrame, active: DataFrame, renumber: bool = False) -> DataFrame:
    """Levels of the active steps. ``renumber`` closes the gaps left by levels without active steps."""
    kept = levels.join(active.select(*_NODE), _NODE, "left_semi")
    if not renumber:
        return kept
    # One row per (graph, level) is enough to number the levels, however many steps share them.
    by_level = Window.partitionBy(P).orderBy("level")
    ranks = kept.select(P, "level").distinct().withColumn("new_level", F.row_number().over(by_level) - 1)
    return kept.join(ranks, [P, "level"]).select(*_NODE, F.col("new_level").alias("level"))


def execution_plan(steps: DataFrame, edges: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """``(pipeline_id, level, step_id)`` of the active steps in run order."""
    levels, cyclic = _levels(steps, edges)
    # Without cycles every step leads to a leaf, so all steps are active unless targets are given.
    if targets is not None or cyclic:
        levels = active_levels(levels, active_steps(steps, edges, targets))
    return levels.select(P, "level", "step_id")


def blocked_steps(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Steps behind a failed or skipped step over required edges.

    Seeds that are themselves behind another seed are blocked too. What lies behind a blocked seed is
    blocked either way, so plain reachability gives the exact answer.
    """
    required = edges.filter("any_required").select(P, F.col("dep_id").alias("source"), F.col("step_id").alias("target"))
    with work_table(required, "links") as downwards:
        first = downwards.join(
            seeds.select(P, F.col("step_id").alias("source")).distinct(), [P, "source"], "left_semi"
        ).select(P, F.col("target").alias("step_id"))
        return reachable(first, downwards)


def step_outcomes(
    steps: DataFrame,
    edges: DataFrame,
    own_outcome: DataFrame,
    targets: DataFrame | None = None,
    levels: DataFrame | None = None,
) -> DataFrame:
    """Final ``outcome`` and skip ``reason`` of every active step.

    ``levels``, where they are known and written already, tell whether there is a cycle: without one every step leads to a
    leaf, so all steps are active unless targets are given, and the way to the leaves need not be followed.

    ``own_outcome`` gives what each step would do on its own: ``cached``, ``finished``, ``failed`` or
    ``condition`` (its condition is false). Being blocked is tested first and wins.
    """
    nodes = steps.select(*_NODE).distinct()
    acyclic = targets is None and levels is not None and levels.count() == nodes.count()
    active = nodes if acyclic else active_steps(steps, edges, targets).select(*_NODE)
    own = materialize(
        active.join(own_outcome.select(*_NODE, F.col("outcome").alias("own")), _NODE, "left"), "outcomes"
    )
    blocked = blocked_steps(edges, own.filter(F.col("own").isin("failed", "condition")))
    blocked = blocked.withColumn("blocked", F.lit(True))
    reason = (
        F.when(F.col("blocked"), F.lit("dependency"))
        .when(F.col("own") == "condition", F.lit("condition"))
        .when(F.col("own") == "cached", F.lit("cached"))
    )
    skipped = F.col("blocked") | (F.col("own") == "condition")
    return own.join(blocked, _NODE, "left").select(
        *_NODE,
        F.when(skipped, F.lit("skipped")).otherwise(F.col("own")).alias("outcome"),
        reason.alias("reason"),
    )


def dry_run(
    steps: DataFrame,
    edges: DataFrame,
    state: DataFrame,
    runs: DataFrame,
    force: bool | list[str] = False,
    targets: DataFrame | None = None,
) -> DataFrame:
    """What a run would do: ``cached``, ``would_run`` or ``skipped`` (with reason) per active step.

    ``steps`` carries ``image`` and ``cmd``, optionally ``setup_cmd``, ``env``, ``mounts``, ``condition_met`` and
    ``has_inputs`` (true for an input list, even an empty one; without it, true for a step with edges);
    ``state`` and ``runs`` are keyed by ``pipeline_id``. An input that is named twice adds its run id twice. A step is cached if its fingerprint, which includes
    the run ids of its cached deps, equals the stored one and the stored run still exists. A step that would
    run has no run id yet, so whatever depends on it changes too; hence the loop over levels. A step whose condition is
    false is skipped, and so is what lies behind a skipped step over required edges; the same loop hands that on.
    """
    spark = steps.sparkSession
    plan = materialize(execution_plan(steps, edges, targets), "plan")
    conditional = "condition_met" in steps.columns
    # Half as long as the text; a stored text that no fingerprint can equal stands for none.
    packed = F.when(F.col("fingerprint").rlike("^[0-9a-f]{64}$"), F.unhex("fingerprint"))
    stored = state.select(*_NODE, "run_id", packed.alias("stored"))
    settings = [c for c in ("image", "cmd", "setup_cmd", "env", "mounts") if c in steps.columns]
    if "has_inputs" in steps.columns:
        declared = steps.select(*_NODE, "has_inputs")
    else:
        declared = edges.groupBy(*_NODE).agg(F.lit(True).alias("has_inputs"))
    forced = F.lit(force) if isinstance(force, bool) else F.col("step_id").isin(*force)
    unmet = F.coalesce(~F.col("condition_met"), F.lit(False)) if conditional else F.lit(False)
    labels = ("todo", "todo-runs", "todo-links", "inputs", "decided")
    todo_path, run_path, link_path, input_path, folder = (work_path(spark, label) for label in labels)
    todo = (
        steps.select(*_NODE, *settings, unmet.alias("unmet"))
        .join(plan, _NODE)
        .join(stored, _NODE, "left")
        .join(declared, _NODE, "left")
        .withColumn("forced", forced)
    )
    todo.write.partitionBy("level").parquet(todo_path)
    todo = spark.read.schema(todo.schema).parquet(todo_path)
    # Which of the stored runs still exist is found without their fingerprints and settings.
    kept = todo.filter("stored IS NOT NULL").select(*_NODE, "run_id", "level").join(runs.select(P, "run_id").distinct(), [P, "run_id"], "left_semi")
    kept = kept.select(*_NODE, F.lit(True).alias("kept"), "level")
    kept.write.partitionBy("level").parquet(run_path)
    kept = spark.read.schema(kept.schema).parquet(run_path)
    # Links lie under the level that they leave, and what they carry under the level that they reach, so that every round reads
    # its own steps, its own inputs and the links to later rounds, and nothing twice.
    uses = F.col("uses") if "uses" in edges.columns else F.lit(1)
    blocking = F.col("any_required") if conditional else F.lit(False)
    from_level = plan.select(P, F.col("step_id").alias("dep_id"), F.col("level").alias("from_level"))
    links = edges.select(*_NODE, "dep_id", uses.cast("int").alias("uses"), blocking.alias("blocking")).join(plan, _NODE).join(from_level, [P, "dep_id"])
    links.write.partitionBy("from_level").parquet(link_path)
    links = spark.read.schema(links.schema).parquet(link_path)

    depth = (plan.agg(F.max("level")).first()[0] or 0) + 1
    decided_schema = f"{P} STRING, step_id STRING, run_id STRING, cached BOOLEAN, reason STRING, level INT"
    input_schema = f"{P} STRING, step_id STRING, ids ARRAY<STRING>, level INT"
    skipped = F.coalesce(F.col("reason").isin("dependency", "condition"), F.lit(False))
    for level in range(depth):
        here = todo.filter(F.col("level") == level)
        if path_exists(spark, input_path):
            # One list per step, as long as the input list of that step's definition: an id for every time it is named. A null
            # instead of a list comes over a required link from a step that is skipped.
            came = spark.read.schema(input_schema).parquet(input_path).filter(F.col("level") == level)
            inputs = came.groupBy(*_NODE).agg(F.flatten(F.collect_list("ids")).alias("ids"), F.bool_or(F.col("ids").isNull()).alias("blocked"))
        else:
            inputs = here.select(*_NODE, F.array().cast("array<string>").alias("ids"), F.lit(False).alias("blocked")).limit(0)
        ids = F.when(F.col("has_inputs"), F.coalesce("ids", F.array().cast("array<string>")))
        setting = lambda name: F.col(name) if name in settings else None
        current = fingerprint(
            F.col("image"), F.col("cmd"), setting("setup_cmd"), setting("env"), ids, setting("mounts")
        )
        # Being blocked is tested first and wins.
        reason = F.when(F.col("blocked"), F.lit("dependency")).when(F.col("unmet"), F.lit("condition"))
        same = F.coalesce(F.col("kept") & (F.col("stored") == F.unhex(current)), F.lit(False))
        (
            here.join(inputs, _NODE, "left")
            .join(kept.filter(F.col("level") == level).drop("level"), _NODE, "left")
            .withColumn("reason", reason)
            .withColumn("cached", F.col("reason").isNull() & ~F.col("forced") & same)
            .select(*_NODE, F.when(F.col("cached"), F.col("run_id")).alias("run_id"), "cached", F.when(F.col("cached"), F.lit("cached")).otherwise(F.col("reason")).alias("reason"))
            .write.parquet(f"{folder}/level={level}")
        )
        known = spark.read.schema(decided_schema).parquet(f"{folder}/level={level}").filter(F.col("cached") | skipped)
        carried = links.filter(F.col("from_level") == level).join(known.select(P, F.col("step_id").alias("dep_id"), "run_id", "cached"), [P, "dep_id"])
        carried = carried.filter(F.col("cached") | F.col("blocking"))
        carried = carried.select(*_NODE, F.when(F.col("cached"), F.array_repeat("run_id", F.col("uses"))).alias("ids"), "level")
        carried.write.mode("append").partitionBy("level").parquet(input_path)
    for path in (todo_path, run_path, link_path, input_path):
        remove_path(spark, path)
    outcome = F.when(F.col("cached"), F.lit("cached")).when(skipped, F.lit("skipped")).otherwise(F.lit("would_run"))
    return spark.read.schema(decided_schema).parquet(folder).select(*_NODE, outcome.alias("outcome"), "reason", "run_id")


def job_outcome(outcomes: DataFrame) -> DataFrame:
    """Per graph ``failed`` or ``completed`` and the first failed step by (level, position).

    ``outcomes`` holds ``(pipeline_id, step_id, outcome, level, pos)``; a failure that the step allows is
    already ``finished`` there.
    """
    failed = F.col("outcome") == "failed"
    return outcomes.groupBy(P).agg(
        F.when(F.bool_or(failed), F.lit("failed")).otherwise(F.lit("completed")).alias("status"),
        F.min_by("step_id", F.when(failed, F.struct("level", "pos"))).alias("first_failed"),
    )
