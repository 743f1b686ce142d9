"""Scalar functions and validation on step definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.base import Views, check
from checks.event_checks import DURATION_SQL, SIZE_SQL
from stepledger.functions import formats, merge, paths, text
from stepledger.functions.condition import judge_condition
from stepledger.functions.fingerprint import fingerprint
from stepledger.operators import inputs as I
from stepledger.operators import validation as V
from stepledger.operators.history import force_filter

_SLUG = "lower(replace(strip_accents({c}), 'ß', 'ss'))"
_SLUG_SQL = f"regexp_replace(regexp_replace({_SLUG}, '[^a-z0-9_-]+', '-', 'g'), '-{{{{2,}}}}', '-', 'g')"
_SLUG_SQL = f"regexp_replace({_SLUG_SQL}, '^-|-$', '', 'g')"


@check(
    "p1_slugify",
    f"""SELECT concat('d', doc_id) AS id, {_SLUG_SQL.format(c='text')} AS slug FROM documents
    UNION ALL SELECT concat('c', c_custkey), {_SLUG_SQL.format(c='c_name')} FROM customer""",
)
def slugs(v: Views) -> DataFrame:
    documents = v.table("documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("name"))
    customers = v.table("customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"))
    return documents.unionByName(customers).select("id", text.slugify(F.col("name")).alias("slug"))


@check(
    "p2_derive_id",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN step_id ELSE concat('step-no-', i, '-prio-', prio) END AS id FROM v_steps""",
)
def ids(v: Views) -> DataFrame:
    given = F.when(F.col("o_orderkey") % 3 == 0, F.col("step_id"))
    name = F.concat(F.lit("Step Nö. "), F.col("i"), F.lit(" / Prio: "), F.col("prio"), F.lit("!"))
    return v.steps().select("o_orderkey", text.derive_id(given, name).alias("id"))


@check(
    "p3_display_name",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN concat('Step ', i) ELSE step_id END AS display_name FROM v_steps",
)
def names(v: Views) -> DataFrame:
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Step "), F.col("i")))
    return v.steps().select("o_orderkey", text.display_name(name, F.col("step_id")).alias("display_name"))


@check("p4_format_size", f"SELECT run_id, {SIZE_SQL.format(n='(duration_ms * 20011)')} AS size FROM v_runs")
def sizes(v: Views) -> DataFrame:
    return v.runs().select("run_id", formats.format_size(F.col("duration_ms") * 20011).alias("size"))


@check("p5_format_duration", f"SELECT run_id, {DURATION_SQL.format(ms='duration_ms')} AS duration FROM v_runs")
def durations(v: Views) -> DataFrame:
    return v.runs().select("run_id", formats.format_duration(F.col("duration_ms")).alias("duration"))


@check(
    "p6_format_finished",
    "SELECT run_id, CASE WHEN exit_code = 0 THEN strftime(finished_at, '%Y-%m-%d %H:%M:%S') ELSE '-' END AS finished FROM v_runs",
)
def finished(v: Views) -> DataFrame:
    at = F.when(F.col("exit_code") == 0, F.col("finished_at"))
    return v.runs().select("run_id", formats.format_finished(at).alias("finished"))


@check(
    "p7_duration_ms",
    """SELECT job_id, event_id, (epoch_us(ts) // 1000 - epoch_us(first_ts) // 1000) AS elapsed_ms
    FROM v_events JOIN (SELECT job_id, min(ts) AS first_ts FROM v_events GROUP BY job_id) USING (job_id)""",
)
def elapsed(v: Views) -> DataFrame:
    events = v.events().select("job_id", "event_id", "ts")
    first = events.groupBy("job_id").agg(F.min("ts").alias("first_ts"))
    return events.join(first, "job_id").select(
        "job_id", "event_id", formats.duration_ms(F.col("first_ts"), F.col("ts")).alias("elapsed_ms")
    )


@check("p8_run_status", "SELECT run_id, CASE WHEN exit_code = 0 THEN 'success' ELSE 'failure' END AS status FROM v_runs")
def statuses(v: Views) -> DataFrame:
    return v.runs().select("run_id", formats.run_status(F.col("exit_code")).alias("status"))


@check(
    "p10_normalize_path",
    """SELECT page_id, regexp_replace(regexp_replace(regexp_replace(substr(host, 3), '/+', '/', 'g'), '[^/]+/[.][.]/', ''), '/$', '') AS path FROM v_paths""",
)
def normal_paths(v: Views) -> DataFrame:
    return v.paths().select("page_id", paths.normalize_path(F.col("host")).alias("path"))


@check(
    "p11_within_boundary",
    """SELECT page_id, page_id % 3 <> 0 AS inside FROM v_paths""",
)
def inside(v: Views) -> DataFrame:
    # Every third host climbs out of the boundary /work by one level more than it is deep.
    depth = F.size(F.filter(F.split(paths.normalize_path(F.col("host")), "/"), lambda p: p != ""))
    climb = F.repeat(F.lit("../"), depth + 2)
    host = F.when(F.col("page_id") % 3 == 0, F.concat(F.col("host"), climb)).otherwise(F.col("host"))
    return v.paths().select(
        "page_id", paths.within_boundary(F.lit("/work/root"), host, F.lit("/work")).alias("inside")
    )


@check(
    "p12_relativize",
    """SELECT o_orderkey, CASE i % 3 WHEN 0 THEN concat('src/', step_id) WHEN 1 THEN concat('../shared/', step_id) ELSE concat('data/', step_id) END AS host FROM v_steps""",
)
def relative(v: Views) -> DataFrame:
    i, step = F.col("i"), F.col("step_id")
    host = (
        F.when(i % 3 == 0, F.concat(F.lit("/work/"), "pipeline_id", F.lit("/src/"), step))
        .when(i % 3 == 1, F.concat(F.lit("/work/shared/"), step))
        .otherwise(F.concat(F.lit("data/"), step))
    )
    mounts = F.array(F.struct(host.alias("host"), F.lit("/m").alias("container")))
    root = F.concat(F.lit("/work/"), "pipeline_id")
    return v.steps().select("o_orderkey", paths.relativize(root, mounts)[0]["host"].alias("host"))


@check(
    "p13_parse_input_spec",
    """SELECT o_orderkey, CASE i % 3 WHEN 0 THEN concat('a', i) WHEN 1 THEN step_id ELSE concat('=', step_id) END AS alias,
    CASE i % 3 WHEN 0 THEN concat(step_id, '=x') WHEN 1 THEN step_id ELSE concat('=', step_id) END AS source FROM v_steps""",
)
def specs(v: Views) -> DataFrame:
    i, step = F.col("i"), F.col("step_id")
    spec = (
        F.when(i % 3 == 0, F.concat(F.lit("a"), i, F.lit("="), step, F.lit("=x")))
        .when(i % 3 == 1, step)
        .otherwise(F.concat(F.lit("="), step))
    )
    return v.steps().select(
        "o_orderkey", text.input_alias(spec).alias("alias"), text.input_step(spec).alias("source")
    )


@check("p14_split_list", "SELECT o_orderkey, unnest([image, prio, step_id]) AS item FROM v_steps")
def items(v: Views) -> DataFrame:
    option = F.concat_ws(",", "image", "prio", "step_id")
    return v.steps().select("o_orderkey", F.explode(text.split_list(option)).alias("item"))


_CMD_JSON = """concat('["run","', prio, '","a\\"b/', i, '"]')"""


@check(
    "p15_fingerprint",
    f"""SELECT o_orderkey, sha256(concat(image, {_CMD_JSON}, CASE WHEN i % 2 = 0 THEN '["install"]' ELSE '' END,
      CASE i % 3 WHEN 0 THEN '[["a","1"],["A_B","x"],["AB","y"],["B","' || prio || '"]]' WHEN 1 THEN '[]' ELSE '' END,
      CASE i % 4 WHEN 0 THEN '["r1","r1","R2","r3' || i || '"]' WHEN 1 THEN '[]' ELSE '' END,
      CASE i % 5 WHEN 0 THEN '[{{"hostPath":"/w/y","containerPath":"/a"}},{{"hostPath":"/w/x","containerPath":"/b"}}]' ELSE '' END)) AS fp FROM v_steps""",
)
def fingerprints(v: Views) -> DataFrame:
    i, prio = F.col("i"), F.col("prio")
    cmd = F.array(F.lit("run"), prio, F.concat(F.lit('a"b/'), i))
    env = F.when(
        i % 3 == 0, F.create_map(F.lit("B"), prio, F.lit("AB"), F.lit("y"), F.lit("a"), F.lit("1"), F.lit("A_B"), F.lit("x"))
    ).when(i % 3 == 1, F.create_map().cast("map<string,string>"))
    ids = F.when(i % 4 == 0, F.array(F.concat(F.lit("r3"), i), F.lit("r1"), F.lit("R2"), F.lit("r1"))).when(
        i % 4 == 1, F.array().cast("array<string>")
    )
    mounts = F.when(
        i % 5 == 0,
        F.array(
            F.struct(F.lit("/w/x").alias("host"), F.lit("/b").alias("container")),
            F.struct(F.lit("/w/y").alias("host"), F.lit("/a").alias("container")),
        ),
    )
    setup = F.when(i % 2 == 0, F.array(F.lit("install")))
    return v.steps().select("o_orderkey", fingerprint(F.col("image"), cmd, setup, env, ids, mounts).alias("fp"))


def _map_text(env):
    entries = F.array_sort(F.map_entries(env))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


@check(
    "p16_merge_env",
    """SELECT o_orderkey, CASE WHEN i % 2 = 0 AND i % 3 = 0 THEN 'A=high;B=low;C=' || prio WHEN i % 2 = 0 THEN 'A=low;B=low' WHEN i % 3 = 0 THEN 'A=high;C=' || prio ELSE '-' END AS env,
      CASE WHEN i % 2 = 0 AND i % 3 = 0 THEN 'A=high;B=low;C=' || prio || ';D=cli' WHEN i % 2 = 0 THEN 'A=low;B=low;C=cli;D=cli' WHEN i % 3 = 0 THEN 'A=high;C=' || prio || ';D=cli' ELSE 'C=cli;D=cli' END AS three FROM v_steps""",
)
def merged_env(v: Views) -> DataFrame:
    i = F.col("i")
    cli = F.create_map(F.lit("C"), F.lit("cli"), F.lit("D"), F.lit("cli"))
    low = F.when(i % 2 == 0, F.create_map(F.lit("A"), F.lit("low"), F.lit("B"), F.lit("low")))
    high = F.when(i % 3 == 0, F.create_map(F.lit("A"), F.lit("high"), F.lit("C"), F.col("prio")))
    return v.steps().select(
        "o_orderkey",
        F.coalesce(_map_text(merge.merge_env(low, high)), F.lit("-")).alias("env"),
        _map_text(merge.merge_env_levels(cli, low, high)).alias("three"),
    )


def _cache(name, path):
    return F.struct(name.alias("name"), path.alias("path"), F.lit(None).cast("boolean").alias("exclusive"))


def _template_caches():
    i = F.col("i")
    low = F.when(i % 2 == 0, F.array(_cache(F.lit("npm"), F.lit("/npm")), _cache(F.lit("pip"), F.lit("/pip"))))
    high = F.when(
        i % 3 == 0, F.array(_cache(F.lit("uv"), F.lit("/uv")), _cache(F.lit("npm"), F.concat(F.lit("/"), F.col("prio"))))
    )
    return low, high


def _cache_text(caches):
    return F.array_join(F.transform(caches, lambda c: F.concat(c["name"], F.lit(":"), c["path"])), ",")


_CACHES_SQL = """CASE WHEN i % 2 = 0 AND i % 3 = 0 THEN 'npm:/' || prio || ',pip:/pip,uv:/uv' WHEN i % 2 = 0 THEN 'npm:/npm,pip:/pip'
  WHEN i % 3 = 0 THEN 'uv:/uv,npm:/' || prio ELSE '-' END"""


@check("p17_merge_caches", f"SELECT o_orderkey, {_CACHES_SQL} AS caches FROM v_steps")
def merged_caches(v: Views) -> DataFrame:
    low, high = _template_caches()
    merged = _cache_text(merge.merge_caches(low, high))
    return v.steps().select("o_orderkey", F.coalesce(merged, F.lit("-")).alias("caches"))


@check(
    "p18_merge_mounts",
    """SELECT o_orderkey, CASE WHEN i % 2 = 0 AND i % 3 = 0 THEN 'src,' || step_id WHEN i % 2 = 0 THEN 'src' WHEN i % 3 = 0 THEN step_id ELSE '-' END AS hosts FROM v_steps""",
)
def merged_mounts(v: Views) -> DataFrame:
    i = F.col("i")
    mount = lambda host: F.array(F.struct(host.alias("host"), F.lit("/m").alias("container")))
    merged = merge.merge_mounts(F.when(i % 2 == 0, mount(F.lit("src"))), F.when(i % 3 == 0, mount(F.col("step_id"))))
    return v.steps().select(
        "o_orderkey", F.when(merged.isNull(), F.lit("-")).otherwise(F.array_join(merged["host"], ",")).alias("hosts")
    )


@check(
    "p19_merge_setup",
    f"""SELECT o_orderkey, CASE WHEN i % 3 = 0 THEN 'user ' || prio WHEN i % 2 = 0 THEN 'kit' ELSE '-' END AS cmd, {_CACHES_SQL} AS caches,
      CASE WHEN i % 3 = 0 AND i % 5 = 0 THEN 'false' WHEN i % 2 = 0 THEN 'true' ELSE '-' END AS network FROM v_steps""",
)
def merged_setup(v: Views) -> DataFrame:
    i = F.col("i")
    low_caches, high_caches = _template_caches()

    def setup(cmd, caches, network):
        return F.struct(F.array(cmd).alias("cmd"), caches.alias("caches"), network.alias("allow_network"))

    low = F.when(i % 2 == 0, setup(F.lit("kit"), low_caches, F.lit(True)))
    high = F.when(
        i % 3 == 0, setup(F.concat(F.lit("user "), "prio"), high_caches, F.when(i % 5 == 0, F.lit(False)))
    )
    steps = v.steps().withColumn("merged", merge.merge_setup(low, high))
    return steps.select(
        "o_orderkey",
        F.coalesce(F.array_join("merged.cmd", " "), F.lit("-")).alias("cmd"),
        F.coalesce(_cache_text(F.col("merged.caches")), F.lit("-")).alias("caches"),
        F.coalesce(F.col("merged.allow_network").cast("string"), F.lit("-")).alias("network"),
    )


@check(
    "p23_mounted_as",
    "SELECT o_orderkey, '/input/' || step_id AS mounted_as, CASE WHEN i % 2 = 0 THEN '/out' ELSE '/output' END AS output FROM v_steps",
)
def mounted(v: Views) -> DataFrame:
    given = F.when(F.col("i") % 2 == 0, F.lit("/out"))
    return v.steps().select(
        "o_orderkey", text.mounted_as(F.col("step_id")).alias("mounted_as"), text.output_mount(given).alias("output")
    )


@check(
    "f1_eval_condition",
    """SELECT o_orderkey, i % 10 <> 4 AS supported, CASE i % 10
      WHEN 0 THEN o_orderkey % 2 = 0
      WHEN 1 THEN prio = '1'
      WHEN 2 THEN o_orderkey % 2 = 0 AND prio <> '3'
      WHEN 3 THEN CAST(prio AS INT) >= 2 AND NOT (o_orderkey % 2 = 0 OR prio = '4')
      WHEN 4 THEN FALSE
      WHEN 5 THEN TRUE
      WHEN 6 THEN i > 10
      WHEN 8 THEN prio = '1'
      WHEN 9 THEN prio <> '1'
      ELSE o_orderkey % 2 = 0 END AS met FROM v_steps""",
)
def conditions(v: Views) -> DataFrame:
    i = F.col("i")
    env = F.create_map(
        F.lit("PRIO"), F.col("prio"), F.lit("EVEN"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("yes")).otherwise(F.lit("")),
        F.lit("I"), i.cast("string"),
    )
    condition = (
        F.when(i % 10 == 0, F.lit("env.EVEN"))
        .when(i % 10 == 1, F.lit('env.PRIO == "1"'))
        .when(i % 10 == 2, F.lit("env.EVEN && !(env.PRIO == 3)"))
        .when(i % 10 == 3, F.lit("env.PRIO >= 2 && !(env.EVEN || env.PRIO == '4')"))
        .when(i % 10 == 4, F.lit(")))invalid((("))
        .when(i % 10 == 6, F.lit("env.I > 10"))
        .when(i % 10 == 7, F.lit("env.I || env.MISSING && env.EVEN"))
        .when(i % 10 == 8, F.lit('(env.PRIO) == "1"'))
        .when(i % 10 == 9, F.lit('env.PRIO == "1" == false'))
    )
    judged = v.steps().select("o_orderkey", judge_condition(condition, env).alias("judged"))
    return judged.select("o_orderkey", "judged.met", "judged.supported")


@check("f6_force_filter", "SELECT o_orderkey FROM v_steps WHERE step_id IN ('s1', 's7')")
def forced(v: Views) -> DataFrame:
    return force_filter(v.steps(), ["s1", "s7"]).select("o_orderkey")


def _definitions(v: Views) -> DataFrame:
    """Definitions in which every rule is broken by some steps of the table."""
    return v.steps().selectExpr(
        "pipeline_id",
        "CASE WHEN o_orderkey % 40 = 0 THEN concat('s ', i) WHEN o_orderkey % 43 = 0 THEN concat(step_id, char(10)) ELSE step_id END AS step_id",
        "CASE WHEN o_orderkey % 30 = 1 THEN NULL ELSE image END AS image",
        "CASE WHEN o_orderkey % 25 = 2 THEN CAST(array() AS ARRAY<STRING>) ELSE array('run', prio) END AS cmd",
        "CASE WHEN o_orderkey % 20 = 3 THEN '/etc/env' ELSE 'conf/.env' END AS env_file",
        """array(named_struct('step', 's1', 'copy_to_output', false, 'optional', false),
            named_struct('step', CASE o_orderkey % 15 WHEN 4 THEN 'bad.name' WHEN 5 THEN concat('s2', char(10)) ELSE 's2' END, 'copy_to_output', false, 'optional', true)) AS inputs""",
        """array(named_struct('host', CASE o_orderkey % 12 WHEN 0 THEN '/abs' WHEN 1 THEN '' ELSE 'src' END,
            'container', CASE o_orderkey % 10 WHEN 0 THEN 'rel' WHEN 1 THEN '/a/../b' WHEN 2 THEN NULL ELSE '/app' END)) AS mounts""",
        """CASE WHEN i % 2 = 0 THEN array(named_struct('host', CASE o_orderkey % 11 WHEN 0 THEN '/abs' ELSE 'src' END, 'container', '/src')) END AS sources""",
        """array(named_struct('name', CASE o_orderkey % 14 WHEN 0 THEN 'bad name' WHEN 1 THEN '' WHEN 2 THEN concat('npm', char(10)) ELSE 'npm' END,
            'path', CASE o_orderkey % 16 WHEN 0 THEN 'rel' WHEN 1 THEN NULL ELSE '/c' END, 'exclusive', false)) AS caches""",
        """CASE WHEN o_orderkey % 2 = 0 THEN named_struct('cmd', CASE WHEN o_orderkey % 18 = 4 THEN CAST(array() AS ARRAY<STRING>) ELSE array('install') END,
            'caches', array(named_struct('name', CASE WHEN o_orderkey % 22 = 0 THEN 'bad!' ELSE 'pip' END, 'path', '/p', 'exclusive', true)), 'allow_network', true) END AS setup""",
    )


_ID = "CASE WHEN o_orderkey % 40 = 0 THEN concat('s ', i) WHEN o_orderkey % 43 = 0 THEN concat(step_id, chr(10)) ELSE step_id END"
# Per rule: when it is broken, the field, the problem and the value.
_RULES = {
    "v1_step_id": [("o_orderkey % 40 = 0 OR o_orderkey % 43 = 0", "step_id", "malformed", _ID)],
    "v2_image": [("o_orderkey % 30 = 1", "image", "missing", "NULL")],
    "v3_cmd": [("o_orderkey % 25 = 2", "cmd", "empty", "NULL")],
    "v4_env_file": [("o_orderkey % 20 = 3", "env_file", "absolute", "'/etc/env'")],
    "v5_input_names": [
        ("o_orderkey % 15 = 4", "inputs.step", "malformed", "'bad.name'"),
        ("o_orderkey % 15 = 5", "inputs.step", "malformed", "'s2' || chr(10)"),
    ],
    "v6_mount_host": [
        ("o_orderkey % 12 = 0", "mounts.host", "absolute", "'/abs'"),
        ("o_orderkey % 12 = 1", "mounts.host", "missing", "''"),
        ("i % 2 = 0 AND o_orderkey % 11 = 0", "sources.host", "absolute", "'/abs'"),
    ],
    "v7_mount_container": [
        ("o_orderkey % 10 = 0", "mounts.container", "relative", "'rel'"),
        ("o_orderkey % 10 = 1", "mounts.container", "climbing", "'/a/../b'"),
        ("o_orderkey % 10 = 2", "mounts.container", "missing", "NULL"),
    ],
    "v8_cache_name": [
        ("o_orderkey % 14 = 0", "caches.name", "malformed", "'bad name'"),
        ("o_orderkey % 14 = 1", "caches.name", "missing", "''"),
        ("o_orderkey % 14 = 2", "caches.name", "malformed", "'npm' || chr(10)"),
        ("o_orderkey % 22 = 0", "setup.caches.name", "malformed", "'bad!'"),
    ],
    "v9_cache_path": [("o_orderkey % 16 = 0", "caches.path", "relative", "'rel'"), ("o_orderkey % 16 = 1", "caches.path", "missing", "NULL")],
    "v10_setup_cmd": [("o_orderkey % 18 = 4", "setup.cmd", "empty", "NULL")],
}


def _rule_check(name: str, cases: list[tuple[str, str, str, str]]) -> None:
    rule = name.split("_")[0].upper()
    sql = " UNION ALL ".join(
        f"SELECT pipeline_id, {_ID} AS step_id, '{field}' AS field, '{problem}' AS problem, coalesce({value}, '-') AS value FROM v_steps WHERE {test}"
        for test, field, problem, value in cases
    )

    @check(name, sql)
    def violations(v: Views) -> DataFrame:
        found = V.validate_steps(_definitions(v)).filter(F.col("rule") == rule)
        return found.select("pipeline_id", "step_id", "field", "problem", F.coalesce("value", F.lit("-")).alias("value"))


for _name, _cases in _RULES.items():
    _rule_check(_name, _cases)


@check(
    "v11_definitions",
    """SELECT pipeline_id, 'V11' AS rule, -1 AS pos, 'id' AS field, 'missing' AS problem FROM v_steps WHERE o_orderkey % 7 = 0
    UNION ALL SELECT pipeline_id, 'V11', -1, 'steps', 'empty' FROM v_steps WHERE i % 6 = 0
    UNION ALL SELECT pipeline_id, 'V11', i, 'id', 'missing' FROM v_steps WHERE o_orderkey % 13 = 0""",
)
def unnamed(v: Views) -> DataFrame:
    steps = v.steps()
    definitions = steps.selectExpr(
        "pipeline_id",
        "CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE pipeline_id END AS id",
        "CAST(NULL AS STRING) AS name",
        "CASE WHEN i % 6 = 0 THEN array() ELSE array('x') END AS steps",
    )
    step_defs = steps.selectExpr(
        "pipeline_id", "i AS pos", "CASE WHEN o_orderkey % 13 <> 0 THEN step_id END AS id", "CAST(NULL AS STRING) AS name"
    )
    whole = V.validate_definitions(definitions).withColumn("pos", F.lit(-1)).drop("rank")
    return whole.unionByName(V.validate_step_names(step_defs))


@check(
    "v12_duplicates",
    """SELECT pipeline_id, concat('p', prio) AS step_id, 'V12' AS rule, 'repeated' AS problem FROM v_steps GROUP BY ALL HAVING count(*) > 1""",
)
def duplicates(v: Views) -> DataFrame:
    steps = v.steps().select("pipeline_id", F.concat(F.lit("p"), "prio").alias("step_id"))
    return V.duplicate_steps(steps).select("pipeline_id", "step_id", "rule", "problem")


@check(
    "v13_step_files",
    "SELECT o_orderkey AS file FROM v_steps WHERE o_orderkey % 2 = 1 AND o_orderkey % 3 = 1 AND o_orderkey % 5 = 1",
)
def step_files(v: Views) -> DataFrame:
    files = v.steps().selectExpr(
        "o_orderkey AS file",
        "CASE WHEN o_orderkey % 2 <> 1 THEN step_id END AS id",
        "CASE WHEN o_orderkey % 3 <> 1 THEN 'A step' ELSE '' END AS name",
        "CASE WHEN o_orderkey % 5 <> 1 THEN 'given' END AS override",
    )
    return V.validate_step_files(files).select("file")


@check(
    "j10_exec_inputs",
    """SELECT s.pipeline_id, s.step_id, concat('in', s.i % 3) AS alias, concat('s', s.i + 1) AS source, coalesce('r' || t.o_orderkey, '-') AS run_id,
      CASE WHEN t.o_orderkey IS NULL THEN concat('No run found for input step: s', s.i + 1) ELSE '-' END AS error,
      CASE WHEN t.o_orderkey IS NULL THEN 'in0' WHEN s.i % 3 = 0 THEN 'in0' ELSE concat('in0,in', s.i % 3) END AS inputs
    FROM v_steps s LEFT JOIN v_steps t ON s.pipeline_id = t.pipeline_id AND t.i = s.i + 1 AND t.o_orderkey % 4 <> 0""",
)
def exec_inputs(v: Views) -> DataFrame:
    steps = v.steps().withColumnRenamed("pipeline_id", "workspace_id")
    specs = steps.select(
        "workspace_id",
        "step_id",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("pos"), F.concat(F.lit("in"), F.col("i") % 3, F.lit("=old")).alias("spec")),
                F.struct(
                    F.lit(1).alias("pos"), F.concat(F.lit("in"), F.col("i") % 3, F.lit("=s"), F.col("i") + 1).alias("spec")
                ),
            )
        ).alias("o"),
    ).select("workspace_id", "step_id", "o.pos", "o.spec")
    state = steps.filter("o_orderkey % 4 <> 0").select(
        "workspace_id", "step_id", F.concat(F.lit("r"), "o_orderkey").alias("run_id")
    )
    resolved = I.exec_inputs(specs, state)
    first = F.array(
        F.struct(F.lit("in0").alias("step"), F.lit(False).alias("copy_to_output"), F.lit(False).alias("optional"))
    )
    extended = I.add_exec_inputs(steps.select("workspace_id", "step_id", first.alias("inputs")), resolved)
    return resolved.join(extended, ["workspace_id", "step_id"]).select(
        F.col("workspace_id").alias("pipeline_id"),
        "step_id",
        "alias",
        "source",
        F.coalesce("run_id", F.lit("-")).alias("run_id"),
        F.coalesce("error", F.lit("-")).alias("error"),
        F.array_join("inputs.step", ",").alias("inputs"),
    )


_MOUNT = "named_struct('host', {host}, 'container', '/m')"


@check(
    "j11_apply_templates",
    """SELECT o_orderkey, CASE WHEN i % 4 = 0 THEN image WHEN prio = '5' THEN '-' ELSE concat('kit-', prio) END AS image,
      CASE WHEN i % 4 = 0 THEN 'own' WHEN prio = '5' THEN '-' ELSE 'kit' END AS cmd,
      CASE WHEN i % 4 = 0 OR prio = '5' THEN 'A=own' ELSE 'A=own;K=' || prio END AS env,
      CASE WHEN i % 4 = 0 OR prio = '5' THEN 'own' ELSE 'kit,own' END AS mounts,
      CASE WHEN i % 3 = 0 THEN 'false' WHEN i % 4 = 0 OR prio = '5' THEN '-' ELSE 'true' END AS network FROM v_steps""",
)
def templates(v: Views) -> DataFrame:
    steps = v.steps()
    empty_caches = "CAST(NULL AS ARRAY<STRUCT<name: STRING, path: STRING, exclusive: BOOLEAN>>)"
    empty_setup = (
        "CAST(NULL AS STRUCT<cmd: ARRAY<STRING>, caches: ARRAY<STRUCT<name: STRING, path: STRING, exclusive: BOOLEAN>>, allow_network: BOOLEAN>)"
    )
    empty_mounts = "CAST(NULL AS ARRAY<STRUCT<host: STRING, container: STRING>>)"
    kits = steps.filter("prio <> '5'").select("prio").distinct().selectExpr(
        "concat('k', prio) AS uses",
        "concat('kit-', prio) AS image",
        "array('kit') AS cmd",
        f"{empty_setup} AS setup",
        "map('A', 'kit', 'K', prio) AS env",
        f"{empty_caches} AS caches",
        "array(" + _MOUNT.format(host="'kit'") + ") AS mounts",
        f"{empty_mounts} AS sources",
        "true AS allow_network",
    )
    definitions = steps.selectExpr(
        "o_orderkey",
        "CASE WHEN i % 4 <> 0 THEN concat('k', prio) END AS uses",
        "CASE WHEN i % 4 = 0 THEN image END AS image",
        "CASE WHEN i % 4 = 0 THEN array('own') END AS cmd",
        f"{empty_setup} AS setup",
        "map('A', 'own') AS env",
        f"{empty_caches} AS caches",
        "array(" + _MOUNT.format(host="'own'") + ") AS mounts",
        f"{empty_mounts} AS sources",
        "CASE WHEN i % 3 = 0 THEN false END AS allow_network",
    )
    return I.apply_templates(definitions, kits).select(
        "o_orderkey",
        F.coalesce("image", F.lit("-")).alias("image"),
        F.coalesce(F.array_join("cmd", " "), F.lit("-")).alias("cmd"),
        _map_text(F.col("env")).alias("env"),
        F.array_join("mounts.host", ",").alias("mounts"),
        F.coalesce(F.col("allow_network").cast("string"), F.lit("-")).alias("network"),
    )


@check(
    "j12_resolve_by_priority",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'alias' WHEN o_orderkey % 3 = 0 THEN 'custom' WHEN o_orderkey % 2 = 0 THEN 'builtin'
      WHEN o_orderkey % 7 = 0 THEN 'package' ELSE '-' END AS source,
      CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 2 <> 0 AND o_orderkey % 7 <> 0 THEN concat('Unknown template: "n', o_orderkey, '"') ELSE '-' END AS error FROM v_steps""",
)
def priorities(v: Views) -> DataFrame:
    names = v.steps().selectExpr(
        "o_orderkey", "concat(CASE WHEN o_orderkey % 7 = 0 THEN '@scope/' ELSE '' END, 'n', o_orderkey) AS name"
    )
    sources = F.array_compact(
        F.array(
            F.lit("package"),
            F.when(F.col("o_orderkey") % 2 == 0, F.lit("builtin")),
            F.when(F.col("o_orderkey") % 3 == 0, F.lit("custom")),
            F.when(F.col("o_orderkey") % 5 == 0, F.lit("alias")),
        )
    )
    candidates = names.select("name", F.explode(sources).alias("source")).withColumn(
        "target", F.concat(F.col("source"), F.lit(":"), F.col("name"))
    )
    return I.resolve_by_priority(names, candidates).select(
        "o_orderkey", F.coalesce("source", F.lit("-")).alias("source"), F.coalesce("error", F.lit("-")).alias("error")
    )


@check(
    "u1_collect_dependencies",
    """SELECT DISTINCT pipeline_id, concat('src/', prio) AS path FROM v_steps UNION SELECT pipeline_id, 'data' FROM v_steps WHERE i % 2 = 0""",
)
def dependencies(v: Views) -> DataFrame:
    steps = v.steps().selectExpr(
        "pipeline_id",
        "array(" + _MOUNT.format(host="concat('./src//', prio, '/')") + ") AS mounts",
        "CASE WHEN i % 2 = 0 THEN array("
        + _MOUNT.format(host="'data/x/..'")
        + ", "
        + _MOUNT.format(host="concat('src/', prio)")
        + ") END AS sources",
    )
    return I.collect_dependencies(steps)
