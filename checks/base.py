"""Registry of checks and the derived views that they read.

``VIEWS`` is the SQL text of the views for the comparison; ``Views`` builds the same views in Spark.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepledger.operators.events import assign_seq, event_envelope
from stepledger.operators.history import latest_run_per_step
from stepledger.scale import number_rows

Query = Callable[["Views"], DataFrame]

CHECKS: dict[str, tuple[Query, str | None]] = {}


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` may use every view of ``VIEWS``."""

    def add(query: Query) -> Query:
        if name in CHECKS:
            raise ValueError(f"two checks named {name}")
        CHECKS[name] = (query, sql)
        return query

    return add


_V_EVENTS = """
SELECT event_id, ts, CAST(user_id AS STRING) AS job_id, concat('ws', CAST(user_id % 5 AS STRING)) AS workspace_id,
  concat('s', CAST(k % 7 AS STRING)) AS step_id, concat('Step ', CAST(k % 7 AS STRING)) AS display_name, k,
  CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 20 = 0 THEN 'PIPELINE_START' WHEN event_id % 20 < 6 THEN 'STEP_WOULD_RUN' ELSE 'STEP_STARTING' END
       WHEN event_type = 'view' THEN 'STEP_STARTING'
       WHEN event_type = 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'STEP_SKIPPED' ELSE 'STEP_FINISHED' END
       WHEN event_type = 'error' THEN CASE WHEN event_id % 10 < 2 THEN 'STEP_RETRYING' WHEN event_id % 10 < 6 THEN 'STEP_FAILED' ELSE 'STEP_LOG' END
       ELSE CASE WHEN event_id % 20 = 0 THEN 'PIPELINE_FINISHED' WHEN event_id % 20 = 1 THEN 'PIPELINE_FAILED' ELSE 'STEP_LOG' END END AS type,
  CASE k % 3 WHEN 0 THEN 'cached' WHEN 1 THEN 'condition' ELSE 'dependency' END AS reason,
  CASE WHEN k % 3 = 0 OR event_id % 3 <> 0 THEN concat('run', CAST(event_id AS STRING)) END AS run_id,
  CAST(event_id % 90000 AS BIGINT) AS duration_ms, CAST(event_id * 37 % 1000000 AS BIGINT) AS artifact_size,
  CAST(k % 5 + 1 AS INT) AS exit_code, CAST(k % 3 + 1 AS INT) AS attempt, 3 AS max_retries,
  CASE WHEN event_type = 'error' THEN 'stderr' ELSE 'stdout' END AS stream, props AS line
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) e
"""

_V_STEPS = """
SELECT CAST(o_custkey AS STRING) AS pipeline_id, i, concat('s', CAST(i AS STRING)) AS step_id,
  concat('img', CAST(o_orderkey % 9 AS STRING)) AS image, left(o_orderpriority, 1) AS prio,
  CASE WHEN o_orderstatus = 'F' AND o_totalprice > 150000 THEN 'failed' WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 0 THEN 'condition' ELSE 'finished' END AS own_outcome,
  o_orderkey, o_totalprice, o_orderdate
FROM {numbered} o
"""
_NUMBERED = "(SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS i FROM orders)"

_V_EDGES = """
SELECT pipeline_id, step_id, concat('s', CAST(CAST(floor(i / 2.0) AS INT) AS STRING)) AS dep_id, prio = '5' AS optional FROM v_steps WHERE i >= 2
UNION ALL
SELECT pipeline_id, step_id, concat('s', CAST(CAST(floor(i / 3.0) AS INT) AS STRING)) AS dep_id, prio = '4' AS optional FROM v_steps WHERE i >= 3
UNION ALL
SELECT pipeline_id, step_id, 'missing' AS dep_id, prio IN ('4', '5') AS optional FROM v_steps WHERE o_orderkey % 20 = 0
"""

_V_RUNS = """
SELECT CAST(o_custkey AS STRING) AS workspace_id, CAST(o_orderkey AS STRING) AS run_id, concat('step', CAST(o_orderkey % 8 AS STRING)) AS step_id,
  o_orderdate AS finished_at, CAST(o_orderkey * 7919 % 200000 AS BIGINT) AS duration_ms,
  CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS exit_code, concat('img', CAST(o_orderkey % 9 AS STRING)) AS image
FROM {orders}
"""

_V_STATE = """
SELECT workspace_id, step_id, run_id, CASE WHEN exit_code = 0 THEN image ELSE '' END AS fingerprint
FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, step_id ORDER BY finished_at DESC, CAST(run_id AS BIGINT) DESC) AS rn FROM v_runs) r
WHERE rn = 1
"""

_V_FILES = """
SELECT CAST(l_orderkey AS STRING) AS run_id,
  concat('artifacts/', l_returnflag, '/', l_linestatus, '/part', CAST(l_partkey AS STRING), CASE l_linenumber % 3 WHEN 0 THEN '.pyc' WHEN 1 THEN '.csv' ELSE '.json' END) AS path,
  CAST(floor(l_extendedprice) AS BIGINT) AS length
FROM {lineitem}
"""

_V_PATHS = "SELECT page_id, concat('./', replace(url, 'http://', ''), '/../x//y/') AS host FROM {pages}"
_V_PEOPLE = "SELECT c_name AS name, c_mktsegment AS department, CAST(floor(c_acctbal) AS BIGINT) AS salary FROM {customer}"
_V_LANGUAGES = "SELECT p_partkey AS pos, p_type AS category, p_name AS language, p_size AS score FROM {part}"

_ORDER = "row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) - 1 AS seq"

VIEWS = {
    "v_events": _V_EVENTS.format(events="events"),
    "ev": f"SELECT *, {_ORDER} FROM v_events WHERE type <> 'STEP_LOG'",
    "ev_all": f"SELECT *, {_ORDER} FROM v_events",
    "v_steps": _V_STEPS.format(numbered=_NUMBERED),
    "v_edges": _V_EDGES,
    "edges": """SELECT pipeline_id, step_id, dep_id, bool_or(optional) AS any_optional, bool_or(NOT optional) AS any_required, count(*) AS uses
        FROM v_edges GROUP BY ALL""",
    "links": """SELECT e.* FROM edges e JOIN v_steps s ON e.pipeline_id = s.pipeline_id AND e.dep_id = s.step_id""",
    "lv": """SELECT pipeline_id, step_id, 0 AS level FROM v_steps
        UNION SELECT l.pipeline_id, l.step_id, lv.level + 1 FROM lv JOIN links l ON l.pipeline_id = lv.pipeline_id AND l.dep_id = lv.step_id""",
    "levels": "SELECT pipeline_id, step_id, max(level) AS level FROM lv GROUP BY ALL",
    "v_runs": _V_RUNS.format(orders="orders"),
    "v_state": _V_STATE,
    "v_files": _V_FILES.format(lineitem="lineitem"),
    "run_files": "SELECT r.workspace_id, f.* FROM v_files f JOIN v_runs r USING (run_id)",
    "v_logs": """SELECT doc_id AS run_id, CASE WHEN doc_id % 3 = 0 THEN 'stderr' ELSE 'stdout' END AS stream,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents""",
    "v_paths": _V_PATHS.format(pages="pages"),
    "v_people": _V_PEOPLE.format(customer="customer"),
    "v_languages": _V_LANGUAGES.format(part="part"),
}


def full_sql(sql: str) -> str:
    """A check's SQL with the views in front; further common tables may start with ``WITH``."""
    views = ",\n".join(f"{name} AS ({text})" for name, text in VIEWS.items())
    sql = sql.strip()
    if sql.upper().startswith("WITH "):
        return f"WITH RECURSIVE {views},\n{sql[5:]}"
    return f"WITH RECURSIVE {views}\n{sql}"


def write_files(files: DataFrame, root: str) -> None:
    """Write each row ``(path, content)`` as a file below ``root``, which Spark's writers would name themselves."""

    def write(batches):
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                target = f"{root}/{path}".removeprefix("file:")
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "w", encoding="utf-8", newline="") as file:
                    file.write(content)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    files.select("path", "content").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


class Views:
    """The test tables and the derived views of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """A test table; its times have no zone, the library's are instants (read as UTC)."""
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return df.select(*[F.col(c).cast("timestamp") if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])

    def tasks(self) -> int:
        """Tasks for writes of many small files, which no size estimate would spread."""
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _sql(self, text: str, **tables: DataFrame) -> DataFrame:
        return self.spark.sql(text, **tables)

    def events(self) -> DataFrame:
        return self._sql(_V_EVENTS, events=self.table("events"))

    def _flat_events(self) -> DataFrame:
        """With the list of steps that a start event announces."""
        names = F.transform(
            F.sequence(F.lit(0), F.col("k") % 7),
            lambda n: F.struct(
                F.concat(F.lit("s"), n.cast("string")).alias("id"),
                F.concat(F.lit("Listed "), n.cast("string")).alias("display_name"),
            ),
        )
        is_start = F.col("type") == "PIPELINE_START"
        is_step = F.col("type").startswith("STEP_")
        return (
            self.events()
            .withColumn("timestamp", F.col("ts"))
            .withColumn("steps", F.when(is_start, names))
            .withColumn("pipeline_name", F.when(is_start, F.concat(F.lit("job "), "job_id")))
            .withColumn("step_id", F.when(is_step, F.col("step_id")))
        )

    def envelopes(self) -> DataFrame:
        """Envelopes without log events, numbered."""
        return event_envelope(assign_seq(self._flat_events(), ["ts", "event_id"]))

    def all_envelopes(self) -> DataFrame:
        """Envelopes of all events, log events included."""
        return event_envelope(number_rows(self._flat_events(), ["job_id"], ["ts", "event_id"], "seq"))

    def steps(self) -> DataFrame:
        """v_steps without price and date: what a step needs of them is worked out before the rows are numbered, and so moved."""
        key, status = F.col("o_orderkey"), F.col("o_orderstatus")
        failed, unmet = (status == "F") & (F.col("o_totalprice") > 150000), (status == "P") & (key % 4 == 0)
        outcome = F.when(failed, F.lit("failed")).when(unmet, F.lit("condition")).otherwise(F.lit("finished"))
        orders = self.table("orders").select("o_custkey", key, F.left("o_orderpriority", F.lit(1)).alias("prio"), outcome.alias("own_outcome"))
        numbered = number_rows(orders, ["o_custkey"], ["o_orderkey"], "i", start=1).withColumn("i", F.col("i").cast("int"))
        return numbered.select(
            F.col("o_custkey").cast("string").alias("pipeline_id"), "i", F.concat(F.lit("s"), "i").alias("step_id"),
            F.concat(F.lit("img"), key % 9).alias("image"), "prio", "own_outcome", key,
        )

    def inputs(self, steps: DataFrame | None = None) -> DataFrame:
        """v_edges: all inputs of a step come from one pass over the steps."""
        steps = self.steps() if steps is None else steps
        i, prio = F.col("i"), F.col("prio")

        def dep(test, name, optional):
            return F.when(test, F.struct(name.alias("dep_id"), optional.alias("optional")))

        def nth(divisor: float):
            return F.concat(F.lit("s"), F.floor(i / divisor).cast("int").cast("string"))

        found = F.array_compact(
            F.array(
                dep(i >= 2, nth(2.0), prio == "5"),
                dep(i >= 3, nth(3.0), prio == "4"),
                dep(F.col("o_orderkey") % 20 == 0, F.lit("missing"), prio.isin("4", "5")),
            )
        )
        return steps.select("pipeline_id", "step_id", F.explode(found).alias("d")).select(
            "pipeline_id", "step_id", "d.dep_id", "d.optional"
        )

    def runs(self) -> DataFrame:
        return self._sql(_V_RUNS, orders=self.table("orders"))

    def state(self) -> DataFrame:
        latest = latest_run_per_step(
            self.runs().withColumn("n", F.col("run_id").cast("bigint")), ["finished_at", "n"]
        )
        return latest.select(
            "workspace_id",
            "step_id",
            "run_id",
            F.when(F.col("exit_code") == 0, F.col("image")).otherwise(F.lit("")).alias("fingerprint"),
        )

    def files(self) -> DataFrame:
        return self._sql(_V_FILES, lineitem=self.table("lineitem"))

    def run_files(self) -> DataFrame:
        return self.files().join(self.runs().select("workspace_id", "run_id"), "run_id")

    def logs(self) -> DataFrame:
        text = self.table("documents").select(
            F.col("doc_id").alias("run_id"),
            F.when(F.col("doc_id") % 3 == 0, F.lit("stderr")).otherwise(F.lit("stdout")).alias("stream"),
            F.posexplode(F.split("text", "\n")).alias("line_no", "line"),
        )
        return text.withColumn("line_no", F.col("line_no").cast("bigint"))

    def paths(self) -> DataFrame:
        return self._sql(_V_PATHS, pages=self.table("pages"))

    def people(self) -> DataFrame:
        return self._sql(_V_PEOPLE, customer=self.table("customer"))

    def languages(self) -> DataFrame:
        return self._sql(_V_LANGUAGES, part=self.table("part"))
