"""Graph operators on small graphs, and on random ones against brute force."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from stepledger.functions.fingerprint import fingerprint
from stepledger.operators import graph as G


def make(spark, graphs: dict[str, dict[str, list]]):
    """``{graph: {step: [dep or (dep, optional)]}}`` as steps and edges."""
    steps, inputs = [], []
    for graph, nodes in graphs.items():
        for step, deps in nodes.items():
            steps.append((graph, step))
            inputs += [(graph, step, *(d if isinstance(d, tuple) else (d, False))) for d in deps]
    steps_df = spark.createDataFrame(steps, "pipeline_id STRING, step_id STRING")
    inputs_df = spark.createDataFrame(inputs, "pipeline_id STRING, step_id STRING, dep_id STRING, optional BOOLEAN")
    return steps_df, G.merge_edges(inputs_df)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


SMALL = {
    "linear": {"a": [], "b": ["a"], "c": ["b"]},
    "diamond": {"a": [], "b": ["a"], "c": ["a"], "d": ["b", "c"]},
    "cycle": {"a": ["b"], "b": ["a"], "c": ["a"], "d": []},
    "loop": {"a": ["a"]},
    "missing": {"a": ["ghost"], "b": [("ghost", True)], "c": [("ghost", True), ("ghost", False)]},
    "two": {"a": [], "b": ["a"], "x": [], "y": ["x"]},
}


def test_levels_cycles_and_references(spark):
    steps, edges = make(spark, SMALL)
    levels = {(p, s): n for p, s, n in rows(G.topological_levels(steps, edges))}
    assert {s: levels["diamond", s] for s in "abcd"} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert {s: levels["linear", s] for s in "abc"} == {"a": 0, "b": 1, "c": 2}
    assert {s: levels["missing", s] for s in "abc"} == {"a": 0, "b": 0, "c": 0}
    assert rows(G.cyclic_steps(steps, edges)) == [("cycle", "a"), ("cycle", "b"), ("cycle", "c"), ("loop", "a")]
    assert rows(G.missing_refs(edges, steps)) == [("missing", "a", "ghost")]
    leaves = set(rows(G.leaf_steps(steps, edges)))
    assert {("linear", "c"), ("diamond", "d"), ("two", "b"), ("two", "y")} <= leaves and ("loop", "a") not in leaves
    degrees = {(p, s): n for p, s, n in rows(G.in_degree(steps, edges))}
    assert degrees["diamond", "d"] == 2 and degrees["missing", "a"] == 0


def test_nested_inputs(spark):
    schema = "pipeline_id STRING, step_id STRING, inputs ARRAY<STRUCT<step: STRING, copy_to_output: BOOLEAN, optional: BOOLEAN>>"
    steps = spark.createDataFrame([("p", "b", [("a", True, None), ("a", None, True)]), ("p", "a", None)], schema)
    assert rows(G.build_edges(steps)) == [("p", "b", "a", True, True, 2, True)]


def test_closure_keeps_unknown_names(spark):
    steps, edges = make(spark, {"p": {"a": [], "b": ["a", ("ghost", True)], "c": ["b"], "d": []}})
    targets = spark.createDataFrame([("p", "b"), ("p", "nobody")], "pipeline_id STRING, step_id STRING")
    assert rows(G.ancestor_closure(edges, targets), "step_id") == [("a",), ("b",), ("ghost",), ("nobody",)]
    assert rows(G.active_steps(steps, edges, targets), "step_id") == [("a",), ("b",)]
    assert rows(G.execution_plan(steps, edges, targets), "level", "step_id") == [(0, "a"), (1, "b")]


def test_outcomes_cascade(spark):
    graph = {"bad": [], "behind": ["bad"], "after": ["behind"], "soft": [("bad", True)], "off": ["bad"], "cond": [], "c2": ["cond"]}
    steps, edges = make(spark, {"p": graph})
    own = {"bad": "failed", "off": "condition", "cond": "condition"}
    table = spark.createDataFrame(
        [("p", s, own.get(s, "finished")) for s in graph], "pipeline_id STRING, step_id STRING, outcome STRING"
    )
    found = {r.step_id: (r.outcome, r.reason) for r in G.step_outcomes(steps, edges, table).collect()}
    assert found == {
        "bad": ("failed", None),
        "behind": ("skipped", "dependency"),
        "after": ("skipped", "dependency"),
        "soft": ("finished", None),
        "off": ("skipped", "dependency"),
        "cond": ("skipped", "condition"),
        "c2": ("skipped", "dependency"),
    }


def random_graphs(seed: int) -> dict:
    dice = random.Random(seed)
    graphs = {}
    for g in range(6):
        n = dice.randrange(2, 14)
        nodes = {}
        for i in range(n):
            others = [j for j in range(n if dice.random() < 0.05 else i)]
            picked = dice.sample(others, min(len(others), dice.randrange(4)))
            nodes[f"s{i}"] = [(f"s{j}", dice.random() < 0.3) for j in picked]
        graphs[f"g{seed}-{g}"] = nodes
    return graphs


def test_random_graphs(spark):
    graphs = {k: v for seed in range(5) for k, v in random_graphs(seed).items()}
    steps, edges = make(spark, graphs)
    levels, cyclic, closures, targets = [], [], [], []
    for g, nodes in graphs.items():
        placed: dict[str, int] = {}
        while True:
            ready = [s for s, deps in nodes.items() if s not in placed and all(d in placed for d, _ in deps)]
            if not ready:
                break
            level = {s: 1 + max((placed[d] for d, _ in nodes[s]), default=-1) for s in ready}
            placed.update(level)
        levels += [(g, s, n) for s, n in placed.items()]
        cyclic += [(g, s) for s in nodes if s not in placed]
        target = max(nodes)
        targets.append((g, target))
        seen, todo = set(), [target]
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                todo += [d for d, _ in nodes[s]]
        closures += [(g, s) for s in seen]
    assert rows(G.topological_levels(steps, edges)) == sorted(levels)
    assert rows(G.cyclic_steps(steps, edges)) == sorted(cyclic)
    chosen = spark.createDataFrame(targets, "pipeline_id STRING, step_id STRING")
    assert rows(G.ancestor_closure(edges, chosen)) == sorted(closures)


def test_dry_run(spark):
    graph = {"a": [], "b": ["a"], "c": ["b"], "d": [], "e": ["d"]}
    steps, edges = make(spark, {"p": graph})
    steps = steps.withColumn("image", F.lit("img")).withColumn("cmd", F.array(F.lit("x")))
    ids = F.when(F.col("dep").isNotNull(), F.array("dep"))
    stored = [("p", "a", "ra", None), ("p", "b", "rb", "ra"), ("p", "c", "rc", "rb"), ("p", "d", "rd", None), ("p", "e", "re", "gone")]
    state = spark.createDataFrame(stored, "pipeline_id STRING, step_id STRING, run_id STRING, dep STRING").withColumn(
        "fingerprint", fingerprint(F.lit("img"), F.array(F.lit("x")), input_run_ids=ids)
    )
    runs = state.select("pipeline_id", "run_id")

    def outcome(**options):
        return {r.step_id: r.outcome for r in G.dry_run(options.pop("steps", steps), edges, state, **{"runs": runs, **options}).collect()}

    assert outcome() == {"a": "cached", "b": "cached", "c": "cached", "d": "cached", "e": "would_run"}
    assert outcome(force=["b"])["c"] == "would_run"
    assert outcome(runs=runs.filter("run_id <> 'ra'"))["c"] == "would_run"
    assert set(outcome(force=True).values()) == {"would_run"}
    unmet = steps.withColumn("condition_met", F.col("step_id") != "a")
    assert outcome(steps=unmet) == {"a": "skipped", "b": "skipped", "c": "skipped", "d": "cached", "e": "would_run"}


def test_job_outcome(spark):
    table = [("p", "a", "finished", 0, 0), ("p", "c", "failed", 1, 2), ("p", "b", "failed", 1, 1), ("q", "a", "finished", 0, 0)]
    df = spark.createDataFrame(table, "pipeline_id STRING, step_id STRING, outcome STRING, level INT, pos INT")
    assert rows(G.job_outcome(df)) == [("p", "failed", "b"), ("q", "completed", None)]


def test_dry_run_names_a_repeated_input_twice(spark):
    """The stored hash of a step that lists an input twice holds its run id twice."""
    steps = spark.createDataFrame([("p", "a", "img", ["x"]), ("p", "b", "img", ["x"])], "pipeline_id STRING, step_id STRING, image STRING, cmd ARRAY<STRING>")
    inputs = spark.createDataFrame([("p", "b", "a", False)] * 2, "pipeline_id STRING, step_id STRING, dep_id STRING, optional BOOLEAN")
    alone, twice = fingerprint(F.lit("img"), F.array(F.lit("x"))), fingerprint(F.lit("img"), F.array(F.lit("x")), input_run_ids=F.array(F.lit("ra"), F.lit("ra")))
    state = steps.select(
        "pipeline_id", "step_id", F.concat(F.lit("r"), "step_id").alias("run_id"), F.when(F.col("step_id") == "a", alone).otherwise(twice).alias("fingerprint")
    )
    found = G.dry_run(steps, G.merge_edges(inputs), state, state.select("pipeline_id", "run_id")).collect()
    assert {(r.step_id, r.outcome) for r in found} == {("a", "cached"), ("b", "cached")}


def test_dry_run_hands_each_row_on_once(spark, monkeypatch):
    """In a chain a level reads only what the level before wrote for it, however deep it lies."""
    n, read = 8, []
    steps = spark.range(n).selectExpr("'p' AS pipeline_id", "concat('s', id) AS step_id", "'img' AS image", "array('x') AS cmd")
    inputs = spark.range(1, n).selectExpr("'p' AS pipeline_id", "concat('s', id) AS step_id", "concat('s', id - 1) AS dep_id", "false AS optional")
    real = G.work_path
    monkeypatch.setattr(G, "remove_path", lambda *_: None)
    monkeypatch.setattr(G, "work_path", lambda spark, label: read.append((label, real(spark, label))) or read[-1][1])
    state = steps.selectExpr("pipeline_id", "step_id", "concat('r', step_id) AS run_id", "'old' AS fingerprint")
    first = fingerprint(F.lit("img"), F.array(F.lit("x")))
    state = state.withColumn("fingerprint", F.when(F.col("step_id") == "s0", first).otherwise(F.col("fingerprint")))
    found = G.dry_run(steps, G.merge_edges(inputs), state, state.select("pipeline_id", "run_id")).collect()
    assert {r.step_id: r.outcome for r in found} == {f"s{k}": "would_run" if k else "cached" for k in range(n)}
    handed = spark.read.parquet(dict(read)["inputs"])
    assert [(r.step_id, r.ids, r.level) for r in handed.collect()] == [("s1", ["rs0"], 1)]


def test_long_chains_take_few_rounds(spark, tmp_path):
    """Two chains, one of 5,000 steps, side branches, and a seed in the middle of a chain; rows written are linear in the links."""
    n = 5000
    links = [("long", f"s{i}", f"s{i + 1}") for i in range(n)] + [("long", f"s{i}", f"leaf{i}") for i in range(0, n, 1000)]
    links += [("short", f"s{i}", f"s{i + 1}") for i in range(300)] + [("long", "loop", "loop"), ("long", "x", "y"), ("long", "y", "x")]
    df = spark.createDataFrame(links, "pipeline_id STRING, source STRING, target STRING").repartition(4)
    seeds = spark.createDataFrame([("long", "s7"), ("short", "s150"), ("long", "nobody")], "pipeline_id STRING, step_id STRING")
    rounds, passes = G._sweep(seeds, df, f"{tmp_path}/reached", f"{tmp_path}/hung")
    assert rounds <= 14
    written = spark.read.parquet(f"{tmp_path}/hung/*").count() + spark.read.parquet(f"{tmp_path}/reached").count()
    assert written <= 3 * len(links)
    expected = [("long", f"s{i}") for i in range(7, n + 1)] + [("long", f"leaf{i}") for i in range(1000, n, 1000)]
    expected += [("short", f"s{i}") for i in range(150, 301)] + [("long", "nobody")]
    assert rows(G.reachable(seeds, df)) == sorted(expected)


def test_reachability_of_random_graphs(spark, monkeypatch):
    monkeypatch.setattr(G, "HOPS", 1)
    dice = random.Random(12)
    links, seeds, expected = set(), [], []
    for g in range(8):
        nodes = range(dice.randrange(5, 60))
        own = {(a, b) for a in nodes for b in dice.sample(nodes, min(len(nodes), dice.choice([0, 1, 1, 1, 1, 2])))}
        links |= {(f"g{g}", f"s{a}", f"s{b}") for a, b in own}
        todo = dice.sample(nodes, 2)
        seeds += [(f"g{g}", f"s{s}") for s in todo]
        seen = set()
        while todo:
            at = todo.pop()
            if at not in seen:
                seen.add(at)
                todo += [b for a, b in own if a == at]
        expected += [(f"g{g}", f"s{s}") for s in seen]
    df = spark.createDataFrame(sorted(links), "pipeline_id STRING, source STRING, target STRING")
    found = G.reachable(spark.createDataFrame(seeds, "pipeline_id STRING, step_id STRING"), df)
    assert rows(found) == sorted(expected)


def test_settled_links_are_not_read_again(spark, tmp_path):
    """A tree whose levels halve: each round leaves half the links to the next, so all rounds hold at most three times the links."""
    steps = spark.createDataFrame([("p", f"s{i}") for i in range(1, 512)], "pipeline_id STRING, step_id STRING")
    links = spark.createDataFrame([("p", f"s{i // 2}", f"s{i}") for i in range(2, 512)], "pipeline_id STRING, step_id STRING, dep_id STRING")
    assert G._peel(steps, links, str(tmp_path)) == 7
    assert spark.read.parquet(str(tmp_path)).count() <= 3 * 510


def test_dry_run_skips_only_what_runs(spark):
    """Skips go along with the levels: through blocked steps, over required edges, to steps of the plan only."""
    graph = {"a": [], "b": ["a"], "c": [("b", True)], "d": ["b"], "e": ["d"], "x": ["a"], "y": ["x"], "z": ["z", "a"]}
    steps, edges = make(spark, {"p": graph})
    # Both "a" and "d" have a condition that is false, "x" and "y" are not asked for, "z" waits for itself.
    steps = steps.withColumns({"image": F.lit("i"), "cmd": F.array(F.lit("k")), "condition_met": ~F.col("step_id").isin("a", "d")})
    state = steps.select("pipeline_id", "step_id", F.concat(F.lit("r"), "step_id").alias("run_id"), F.upper(F.sha2(F.lit("i"), 256)).alias("fingerprint"))
    targets = steps.filter("step_id IN ('c', 'e')").select("pipeline_id", "step_id")
    found = G.dry_run(steps, edges, state, state.select("pipeline_id", "run_id"), targets=targets)
    assert {r.step_id: (r.outcome, r.reason, r.run_id) for r in found.collect()} == {
        "a": ("skipped", "condition", None),
        "b": ("skipped", "dependency", None),
        "c": ("would_run", None, None),
        "d": ("skipped", "dependency", None),
        "e": ("skipped", "dependency", None),
    }


def test_known_levels_spare_the_way_to_the_leaves(spark, monkeypatch):
    """Without a cycle all steps are active; with one the leaves decide, as they do where no levels are given."""
    for graph, loops in (({"a": [], "b": ["a"], "c": ["b"]}, False), ({"a": [], "b": ["a"], "x": ["y"], "y": ["x", "a"]}, True)):
        steps, edges = make(spark, {"p": graph})
        own = steps.withColumn("outcome", F.when(F.col("step_id") == "a", "failed").otherwise("finished"))
        plain = rows(G.step_outcomes(steps, edges, own), "step_id", "outcome")
        levels, called, real = G.topological_levels(steps, edges), [], G.active_steps
        with monkeypatch.context() as patch:
            patch.setattr(G, "active_steps", lambda *args: called.append(1) or real(*args))
            assert rows(G.step_outcomes(steps, edges, own, levels=levels), "step_id", "outcome") == plain
        assert bool(called) == loops
