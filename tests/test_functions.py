"""Scalar functions on literal cases."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from stepledger.functions import formats, merge, paths, text
from stepledger.functions.condition import eval_condition, judge_condition
from stepledger.functions.fingerprint import canonical_json, fingerprint
from stepledger.functions.ignore import is_ignored
from stepledger.operators.files import files_to_ship, mark_ignored
from stepledger.storage import materialize


def test_conditions(wrong):
    cases = [
        ("env.CI", {"CI": "true"}, True),
        ("env.CI", {}, False),
        ('env.NODE_ENV == "production"', {"NODE_ENV": "production"}, True),
        ('env.NODE_ENV == "production"', {"NODE_ENV": "development"}, False),
        ("env.CI && !env.STAGING", {"CI": "true"}, True),
        ("env.CI && !env.STAGING", {"CI": "true", "STAGING": "true"}, False),
        ("env.CI && !env.STAGING", {}, False),
        (")))invalid(((", {}, False),
        (None, {}, True),
        ("", {}, True),
        ("env.A", {"A": ""}, False),
        ("env.A", {"A": "0"}, True),
        ("env.A", {"A": "false"}, True),
        ("env.A == 5", {"A": "5.0"}, True),
        ("env.A > 10", {"A": "9"}, False),
        ('env.A > "10"', {"A": "9"}, True),
        ("env.A <= 3", {"A": "x"}, False),
        ("env.A || env.B && env.C", {"A": "x"}, False),
        ("env.A || (env.B && env.C)", {"A": "x"}, True),
        ('!(env.A == "x" || env.B)', {"A": "y"}, True),
        ("!!env.A", {"A": "y"}, True),
        ("env.A == env.B", {}, True),
        ('env.A != "x"', {}, True),
        ("env.A == true", {"A": "1"}, True),
        ("env.A == true", {"A": "true"}, False),
        ('env.A == "a && b"', {"A": "a && b"}, True),
        ("env.A == 'it\\'s'", {"A": "it's"}, True),
        ("env.A & & env.B", {"A": "1", "B": "1"}, False),
        ("env.A | env.B", {"A": "1", "B": "1"}, False),
        ("env.A env.B", {"A": "1", "B": "1"}, False),
        ("env.A == env.B == env.C", {}, False),
        ("env.A == env.B == true", {}, True),
        ('!env.A == "x"', {"A": "y"}, False),
        ("!env.A == false", {"A": "y"}, True),
        ('(env.A) == "1"', {"A": "1"}, True),
        ('env.A == "1" == true', {"A": "1"}, True),
        ('env.A == "1" == false', {"A": "1"}, False),
        ('(env.A || env.B) == "b"', {"B": "b"}, True),
        ('"b" == (env.A && env.B)', {"A": "a", "B": "b"}, True),
        ('env.A && env.B == "b"', {"A": "a", "B": "b"}, True),
        ("(env.A > 1) == (env.B > 1)", {"A": "2", "B": "0"}, False),
        ("env.A = = env.A", {"A": "1"}, False),
        ("env.N + 1 == 6", {"N": "5"}, False),
        ("env.A == 7", {"A": "7\n"}, True),
        ("((env.A))", {"A": "1"}, True),
        ("(env.A", {"A": "1"}, False),
        ("foo.bar", {}, False),
        ("0", {}, False),
    ]
    assert not wrong(
        cases, "c STRING, env MAP<STRING, STRING>, expected BOOLEAN", eval_condition(F.col("c"), F.col("env"))
    )


def test_unsupported_conditions_are_marked(wrong):
    cases = [(None, True), ("", True), ("env.A", True), ("!(env.A == 'x') && 1 < 2", True), ("env.N + 1 == 6", False), ("env.A ? 1 : 2", False), ("env.A in ['x']", False), ("((", False), ("env.A env.B", False)]
    env = F.create_map(F.lit("A"), F.lit("x"))
    assert not wrong(cases, "c STRING, expected BOOLEAN", judge_condition(F.col("c"), env)["supported"])


def test_default_ignores(wrong):
    ignored = [
        ".git", ".git/config", "node_modules", "node_modules/foo/index.js", "__pycache__", "test.pyc", ".DS_Store",
        ".env", "src/.DS_Store", "src/.git", "src/.git/config", "lib/node_modules/pkg/index.js", "src/__pycache__", ".ENV",
    ]
    kept = ["src/app.js", "", "config/settings.yaml", "environment", "git/x"]
    cases = [(p, True) for p in ignored] + [(p, False) for p in kept]
    assert not wrong(cases, "p STRING, expected BOOLEAN", is_ignored(F.col("p")))


def test_rules_as_columns(spark):
    """The rules of a table mean what the rules of a list mean, root by root."""
    lists = {
        "a": ["*.log", "!keep.log", "dist/", "/top.txt"],
        "b": ["docs/**/x", "**/gen", "a?c", "[!x]y", "lib/*", "# no", "", "  ", "!.env", "we\\ird", "end\\ "],
        "c": ["build", "!build/keep", "A.TXT"],
    }
    paths = ["", "x.log", "keep.log", "d/keep.log", "dist", "dist/a", "e/dist/b", "top.txt", "d/top.txt", "docs/x", "docs/1/2/x", "gen/q", "p/gen", "abc", "abbc", "zy", "xy", "lib/q", "lib", "m/lib/q", ".env", "k/.env", "build/keep", "build", "a.txt", "node_modules/n", "q.pyc", "weird", "end ", "l\n.log"]
    files = spark.createDataFrame([(r, p) for r in lists for p in paths], "root STRING, path STRING")
    rules = spark.createDataFrame([(r, k, p) for r, ps in lists.items() for k, p in enumerate(ps)], "root STRING, pos INT, pattern STRING")
    found = {(r.root, r.path): r.ignored for r in mark_ignored(files, rules, "root").collect()}
    assert len(found) == len(lists) * len(paths)
    for root, patterns in lists.items():
        own = files.filter(F.col("root") == root).select("path", is_ignored(F.col("path"), patterns).alias("ignored")).collect()
        assert {r.path: r.ignored for r in own} == {p: found[root, p] for p in paths}, root


def test_rules_multiply_no_rows(spark):
    """However many rules a root has, they are one row; repeated, null and rootless files keep their place."""
    files = spark.createDataFrame([("a", "x/y.log", 1), ("a", "x/y.log", 1), ("b", "x/y.log", 2), (None, ".git", 3), ("a", None, 4)], "root STRING, path STRING, more INT")
    rules = spark.range(200).select(F.lit("a").alias("root"), F.col("id").alias("pos"), F.concat(F.when(F.col("id") % 2 == 1, "!").otherwise(""), F.lit("*.log")).alias("pattern"))
    marked = mark_ignored(files, rules, "root")
    found = sorted((str(r.root), str(r.path), r.more, r.ignored) for r in marked.collect())
    assert found == [("None", ".git", 3, False), ("a", "None", 4, False), ("a", "x/y.log", 1, False), ("a", "x/y.log", 1, False), ("b", "x/y.log", 2, False)]
    last = mark_ignored(files, rules.union(spark.createDataFrame([("a", 500, "x/")], "root STRING, pos BIGINT, pattern STRING")), "root")
    assert sorted((str(r.root), r.ignored) for r in last.collect()) == [("None", False), ("a", False), ("a", True), ("a", True), ("b", False)]
    assert mark_ignored(files.limit(0), rules, "root").count() == 0
    plan = marked._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_rules_of_few_roots_shuffle_no_files(spark, tmp_path):
    """However few the roots, their files stay where they are, in the order of the roots; odd paths are judged as by a list."""
    lists = {"a": ["x[!a]", "!x/keep", "*.log", "!b.log/"], "b": ["a/**", "!a/b", "/q/*", "!**/q/1"], "c": ["!*", "z/"], "d": ["[!k]*", "!m/"], "e": []}
    paths = ["x/y", "x/keep", "xb/keep", "a/b/c", "a/", "a", "a//b", "/x", "/", "//", "q/1", "q/2/1", "p/q/1", "b.log", "d/b.log/e", "z/n", "Z/n", "m", "k", "m/k", "l\nz/.env", "l\nz/n", "u\u2028/.env"]
    spark.createDataFrame([(r, p) for r in lists for p in paths], "root STRING, path STRING").write.parquet(f"{tmp_path}/files")
    files = spark.read.parquet(f"{tmp_path}/files")
    rules = spark.createDataFrame([(r, k, p) for r, ps in lists.items() for k, p in enumerate(ps)], "root STRING, pos INT, pattern STRING")
    marked = mark_ignored(files, rules, "root")
    found = {(r.root, r.path): r.ignored for r in marked.collect()}
    from stepledger.functions.ignore import DEFAULT_IGNORES, ignore_rule
    import re

    def ignored(shown, listed):
        verdicts = [rule.ignore for rule in listed if re.search(rule.regex.replace("\\z", "\\Z").replace(".*", "[^\n\r\u0085\u2028\u2029]*").replace("/.+", "/[^\n\r\u0085\u2028\u2029]+"), shown)]
        return bool(verdicts) and verdicts[-1]

    for root, patterns in lists.items():
        listed = [rule for rule in map(ignore_rule, (*DEFAULT_IGNORES, *patterns)) if rule]
        for path in paths:
            parts = path.split("/")
            above = [f for n in range(1, len(parts)) if (f := "/".join(parts[:n]))]
            shown = [*[f"{f}/" for f in above], path, f"{path}/"]
            assert found[root, path] == any(ignored(s, listed) for s in shown), (root, path)
    assert "Exchange hashpartitioning" not in marked._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in marked._jdf.queryExecution().executedPlan().toString()


def test_files_to_ship(spark):
    files = spark.createDataFrame([("a", "d/e/f.txt", 1), ("a", "d/x.pyc", 2), ("a", "top", 3), ("b", "d/e/f.txt", 4)], "root STRING, path STRING, length INT")
    asked = spark.createDataFrame([("a", "d"), ("a", "d/e/f.txt"), ("a", "."), ("a", "none/at/all"), ("a", "d/x.pyc"), ("c", "d")], "root STRING, path STRING")
    rules = spark.createDataFrame([("a", 0, "top")], "root STRING, pos INT, pattern STRING")
    found = sorted((r.root, r.dependency, r.path or "-", r.error or "-") for r in files_to_ship(asked, files, rules, "root").collect())
    missing = "Dependency not found: "
    assert found == [
        ("a", ".", "d/e/f.txt", "-"), ("a", "d", "d/e/f.txt", "-"), ("a", "d/e/f.txt", "d/e/f.txt", "-"),
        ("a", "none/at/all", "-", missing + "none/at/all"), ("c", "d", "-", missing + "d"),
    ]


def test_ignore_patterns(wrong):
    patterns = ["dist/", "*.log", "!keep.log", "/build", "docs/*.md", "q/**/r.txt", "foo/**", "# note", "", "t?.x", "[ab].y"]
    cases = [
        ("dist", True), ("dist/bundle.js", True), ("a/dist/x", True), ("error.log", True), ("keep.log", False),
        ("a/keep.log", False), ("dist/keep.log", True), ("build/x", True), ("a/build/x", False), ("docs/a.md", True),
        ("docs/x/a.md", False), ("q/zz/r.txt", True), ("q/r.txt", True), ("foo/bar", True), ("foo", False),
        ("t1.x", True), ("t12.x", False), ("a.y", True), ("c.y", False), ("src/app.js", False),
    ]
    assert not wrong(cases, "p STRING, expected BOOLEAN", is_ignored(F.col("p"), patterns))


def test_paths(wrong):
    normal = [
        ("./src/", "src"), ("src", "src"), ("/", ""), ("", "."), ("a//b/./c/../d", "a/b/d"), ("../a", "../a"),
        ("a/../../b", "../b"), ("/../a", "/a"), ("./", "."), ("/a/b/", "/a/b"),
    ]
    assert not wrong(normal, "p STRING, expected STRING", paths.normalize_path(F.col("p")))
    relative = [("/a/b", "/a/b/c", "c"), ("/a/b", "/a/x/y", "../x/y"), ("/a/b", "/a/b", ""), ("/a/b", "/", "../..")]
    assert not wrong(relative, "r STRING, p STRING, expected STRING", paths.relative_path(F.col("r"), F.col("p")))
    bounds = [
        ("/w", "src", True), ("/w/p", "../../x", False), ("/w", "..", False), ("/w", ".", True), ("/w/p", "..", True),
        ("/w", "../w2", False), ("/w", "/etc", False), ("/w", "/w/x", True),
    ]
    column = paths.within_boundary(F.col("r"), F.col("p"), F.lit("/w"))
    assert not wrong(bounds, "r STRING, p STRING, expected BOOLEAN", column)


def test_names(wrong):
    slugs = [
        ("Étape numéro un", "etape-numero-un"), ("build@v2!", "build-v2"), ("a--b", "a-b"), ("-hello-", "hello"),
        ("Straße Œuvre Æther", "strasse-oeuvre-aether"), ("a_b-C", "a_b-c"), ("été", "ete"), ("日本", ""),
    ]
    assert not wrong(slugs, "p STRING, expected STRING", text.slugify(F.col("p")))
    specs = [("a=b", "a", "b"), ("a=b=c", "a", "b=c"), ("=b", "=b", "=b"), ("step", "step", "step"), ("a=", "a", "")]
    rows = [(s, a + "|" + b) for s, a, b in specs]
    both = F.concat_ws("|", text.input_alias(F.col("p")), text.input_step(F.col("p")))
    assert not wrong(rows, "p STRING, expected STRING", both)


def test_formats(spark, wrong):
    sizes = [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.3 KB"), (1536 * 1024, "1.5 MB"), (5 * 2**30, "5.0 GB")]
    assert not wrong(sizes, "p BIGINT, expected STRING", formats.format_size(F.col("p")))
    times = [
        (0, "0ms"), (999, "999ms"), (1000, "1.0s"), (1250, "1.3s"), (1450, "1.4s"), (59_999, "60.0s"),
        (60_000, "1m 0s"), (119_500, "1m 60s"), (125_400, "2m 5s"),
    ]
    assert not wrong(times, "p BIGINT, expected STRING", formats.format_duration(F.col("p")))
    # Below a minute the text is that of the correctly rounded binary fraction, ties going up.
    rows = spark.range(1000, 60_000).select("id", formats.format_duration(F.col("id")).alias("t")).collect()
    ties = {250, 750}
    assert all(r.t == f"{r.id / 1000:.1f}s" for r in rows if r.id % 1000 not in ties)
    assert all(r.t == f"{r.id // 1000}.{'3' if r.id % 1000 == 250 else '8'}s" for r in rows if r.id % 1000 in ties)


def test_merges(spark):
    row = spark.range(1).select(
        merge.merge_env(F.expr("map('A','1','B','2')"), F.expr("map('B','3','C','4')")).alias("env"),
        merge.merge_env(F.expr("CAST(NULL AS MAP<STRING, STRING>)"), F.expr("map('A','1')")).alias("one"),
        merge.merge_env(F.expr("CAST(NULL AS MAP<STRING, STRING>)"), F.expr("CAST(NULL AS MAP<STRING, STRING>)")).alias("none"),
        merge.merge_caches(
            F.expr("array(named_struct('name','npm','path','/a'), named_struct('name','pip','path','/b'))"),
            F.expr("array(named_struct('name','uv','path','/c'), named_struct('name','npm','path','/d'))"),
        ).alias("caches"),
    ).first()
    assert row.env == {"A": "1", "B": "3", "C": "4"}
    assert row.one == {"A": "1"} and row.none is None
    assert [(c.name, c.path) for c in row.caches] == [("npm", "/d"), ("pip", "/b"), ("uv", "/c")]


def _fingerprint(image, cmd, setup=None, env=None, ids=None, mounts=None) -> str:
    dump = lambda value: json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    text = image + dump(cmd)
    text += dump(setup) if setup is not None else ""
    text += dump(sorted([k, v] for k, v in env.items())) if env is not None else ""
    text += dump(sorted(ids)) if ids is not None else ""
    if mounts:
        ordered = sorted(mounts, key=lambda m: m[1])
        text += dump([{"hostPath": h, "containerPath": c} for h, c in ordered])
    return hashlib.sha256(text.encode()).hexdigest()


def test_fingerprint(spark):
    cases = [
        ("alpine", ["echo", "hello"], None, None, None, None),
        ("alpine", ["echo", "é\"\\/\n\x1f\x0b"], ["sh", "-c"], {}, [], []),
        ("alpine", ["echo"], None, {"B": "2", "A": "1"}, ["y", "x"], [("b", "/b"), ("a", "/a")]),
        ("node", [], None, {"A": "\\u001F"}, None, [("z", "/a"), ("a", "/a")]),
    ]
    schema = """image STRING, cmd ARRAY<STRING>, setup ARRAY<STRING>, env MAP<STRING, STRING>, ids ARRAY<STRING>,
        mounts ARRAY<STRUCT<host: STRING, container: STRING>>"""
    df = spark.createDataFrame(cases, schema)
    got = [r[0] for r in df.select(fingerprint(*[F.col(c) for c in df.columns])).collect()]
    assert got == [_fingerprint(*case) for case in cases]


def test_json_escapes(spark):
    nasty = "".join(chr(c) for c in range(1, 32)) + '"\\/é\\u001F'
    df = spark.createDataFrame([([nasty],)], "a ARRAY<STRING>")
    assert df.select(canonical_json(F.col("a"))).first()[0] == json.dumps([nasty], ensure_ascii=False)


def test_dependencies_of_few_roots_are_written_once(spark, monkeypatch):
    """The few depths meet the files as a small written table, and no shuffle deals files by their root alone."""
    from stepledger.operators import files as module

    written = []
    monkeypatch.setattr(module, "materialize", lambda df, label: written.append(label) or materialize(df, label))
    files = spark.createDataFrame([("a", "d/x", 1), ("a", "e/y", 2)], "root STRING, path STRING, length INT")
    asked = spark.createDataFrame([("a", "d")], "root STRING, path STRING")
    rules = spark.createDataFrame([("a", 0, "y")], "root STRING, pos INT, pattern STRING")
    assert [(r.dependency, r.path) for r in files_to_ship(asked, files, rules, "root").collect()] == [("d", "d/x")]
    assert written == ["asked", "depths", "rules"]


def test_slugs_of_odd_characters(spark, wrong):
    """No regex over a class of several ranges, and the same rows as one gives: controls, line ends, other scripts, runs of both."""
    chars = [*range(0, 400, 3), 0, 10, 0x85, 0x2028, 0x212A, 0x130, 0x1F600, 0x301]
    odd = [chr(a) + chr(b) + "x" + chr(a) for a in chars for b in (10, 32, 45, 95, 0x1F600, 0x4E2D)] + ["", "-", "- -", "\n", "-\n", "_-_"]
    simple = F.regexp_replace(F.lower(text.strip_accents(F.col("p"))), "[^A-Za-z0-9_]+", "-")
    named = spark.createDataFrame([(p,) for p in odd], "p STRING").withColumn("expected", F.regexp_replace(simple, "^-|-$", ""))
    assert not wrong([tuple(r) for r in named.collect()], "p STRING, expected STRING", text.slugify(F.col("p")))
    assert "0-9" not in named.select(text.slugify(F.col("p")))._jdf.queryExecution().optimizedPlan().expressions().toString()
