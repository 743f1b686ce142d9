"""Files, logs, plain tables and the example reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.base import Views, check, write_files
from stepledger.functions.formats import rating
from stepledger.functions.text import basename
from stepledger.operators import files as O
from stepledger.operators import reports as R
from stepledger.operators.inputs import collect_dependencies
from stepledger.plans.jobs import category_summary_job, text_report_job
from stepledger.scale import number_rows
from stepledger.sources.definitions import read_dotenv, read_pipelines
from stepledger.sources.paths import read_lines
from stepledger.sources.runs import list_files, read_logs
from stepledger.sources.tables import read_headerless_csv, read_json_doc, write_csv, write_json_doc, write_text_report
from stepledger.storage import work_path

_PATTERNS = ["*.csv", "!**/part1*.csv", "artifacts/R/O/", "/artifacts/A/F/part2*"]
_IGNORED = """(path LIKE '%.pyc' OR (path LIKE '%.csv' AND NOT regexp_matches(path, '/part1[^/]*\\.csv$')) OR path LIKE 'artifacts/R/O/%'
  OR regexp_matches(path, '^artifacts/A/F/part2'))"""


@check("f5_ignore_filter", f"SELECT run_id, path, length FROM v_files WHERE {_IGNORED}")
def ignored(v: Views) -> DataFrame:
    return O.ignore_filter(v.files(), _PATTERNS)


@check("u4_remaining_files", f"SELECT run_id, path, length FROM v_files WHERE NOT {_IGNORED}")
def remaining(v: Views) -> DataFrame:
    return O.remaining_files(v.files(), _PATTERNS)


_ROOT = "'root' || CAST(CAST(run_id AS BIGINT) % 3 AS VARCHAR)"
# Each root has its own rules; the files of its runs are its files.
_ROOT_RULES = {"root0": ["*.csv", "!**/part1*.csv", "artifacts/R/O/"], "root1": ["# note", "", "A/", "!*.pyc"], "root2": []}
_ROOT_IGNORED = """(CASE CAST(run_id AS BIGINT) % 3
  WHEN 0 THEN path LIKE '%.pyc' OR (path LIKE '%.csv' AND NOT regexp_matches(path, '/part1[^/]*\\.csv$')) OR path LIKE 'artifacts/R/O/%'
  WHEN 1 THEN path LIKE 'artifacts/A/%' ELSE path LIKE '%.pyc' END)"""


def _rooted(v: Views) -> tuple[DataFrame, DataFrame]:
    name = F.concat(F.lit("root"), (F.col("run_id").cast("bigint") % 3).cast("string"))
    files = v.files().select(name.alias("root"), F.concat("run_id", F.lit("/"), "path").alias("path"), "length", "run_id")
    by_root = F.create_map(*[x for k, p in _ROOT_RULES.items() for x in (F.lit(k), F.array(*map(F.lit, p)).cast("array<string>"))])
    rules = files.select("root").distinct().select("root", F.posexplode(by_root[F.col("root")]).alias("pos", "pattern"))
    # Rules for paths below the run folders.
    return files, rules.withColumn("pattern", F.regexp_replace("pattern", "^artifacts/", "**/artifacts/"))


@check(
    "f5_ignore_by_root",
    f"SELECT {_ROOT} AS root, run_id || '/' || path AS path, {_ROOT_IGNORED} AS ignored, count(*) AS n FROM v_files GROUP BY ALL",
)
def ignored_by_root(v: Views) -> DataFrame:
    files, rules = _rooted(v)
    return O.mark_ignored(files, rules, "root").groupBy("root", "path", "ignored").agg(F.count(F.lit(1)).alias("n"))


@check(
    "u4_files_to_ship",
    f"""WITH deps AS (SELECT DISTINCT {_ROOT} AS root, run_id || CASE WHEN CAST(run_id AS BIGINT) % 5 = 0 THEN '/none' ELSE '/artifacts/A' END AS dependency, run_id FROM v_files),
    whole AS (SELECT {_ROOT} AS root, run_id || '/' || path AS path, length, {_ROOT_IGNORED} AS ignored, path LIKE 'artifacts/A/%' AS below, run_id FROM v_files)
    SELECT d.root, d.dependency, w.path, w.length, '-' AS error FROM deps d JOIN whole w ON d.run_id = w.run_id WHERE w.below AND NOT w.ignored AND d.dependency NOT LIKE '%none'
    UNION ALL SELECT root, dependency, '-', -1, 'Dependency not found: ' || dependency FROM deps d
      WHERE dependency LIKE '%none' OR NOT EXISTS (SELECT 1 FROM whole w WHERE w.run_id = d.run_id AND w.below)""",
)
def shipped(v: Views) -> DataFrame:
    """Mounts of a step per run, whose paths are the dependencies."""
    files, rules = _rooted(v)
    folder = F.when(F.col("run_id").cast("bigint") % 5 == 0, F.lit("/none")).otherwise(F.lit("/artifacts/A/"))
    mount = F.struct(F.concat(F.lit("./"), "run_id", folder).alias("host"), F.lit("/in").alias("container"))
    steps = files.select(F.col("root").alias("pipeline_id"), "run_id").distinct().select("pipeline_id", F.array(mount).alias("mounts"), F.array().cast("array<struct<host: string, container: string>>").alias("sources"))
    wanted = collect_dependencies(steps).withColumnRenamed("pipeline_id", "root")
    found = O.files_to_ship(wanted, files, rules, "root")
    return found.select("root", "dependency", F.coalesce("path", F.lit("-")).alias("path"), F.coalesce("length", F.lit(-1)).alias("length"), F.coalesce("error", F.lit("-")).alias("error"))


@check(
    "a8_dir_size",
    """WITH dirs AS (SELECT run_id, unnest(['', 'artifacts', array_to_string(string_split(path, '/')[1:2], '/'), array_to_string(string_split(path, '/')[1:3], '/')]) AS dir, length FROM v_files)
    SELECT run_id, dir, sum(length) AS size FROM dirs GROUP BY ALL UNION ALL SELECT DISTINCT run_id, 'none', 0 FROM v_files""",
)
def dir_sizes(v: Views) -> DataFrame:
    files = v.files()
    asked = files.select("run_id", F.lit("none").alias("dir")).distinct()
    return O.dir_sizes(files).unionByName(O.dir_size(files, asked))


@check("o2_file_inventory", "SELECT string_split(path, '/')[4] AS filename, length AS size_bytes FROM v_files")
def inventory(v: Views) -> DataFrame:
    return O.file_inventory(v.files())


@check("p24_basename", "SELECT run_id, string_split(path, '/')[4] AS name, length FROM v_files")
def base(v: Views) -> DataFrame:
    return v.files().select("run_id", basename(F.col("path")).alias("name"), "length")


@check(
    "s10_write_csv",
    "SELECT string_split(path, '/')[4] AS filename, length AS size_bytes FROM v_files",
)
def csv(v: Views) -> DataFrame:
    path = work_path(v.spark, "csv")
    write_csv(O.file_inventory(v.files()), path)
    return v.spark.read.schema("filename STRING, size_bytes BIGINT").option("header", True).csv(path)


def _written_names(v: Views) -> str:
    path = work_path(v.spark, "names")
    v.table("customer").select(F.col("c_name").alias("value"), F.col("c_nationkey").alias("nation")).write.partitionBy(
        "nation"
    ).text(path)
    return path


_SIZES_SQL = "SELECT CAST(c_nationkey AS VARCHAR) AS run_id, sum(strlen(c_name) + 1) AS size FROM customer GROUP BY ALL"


@check("s7_list_files", _SIZES_SQL)
def listing(v: Views) -> DataFrame:
    files = list_files(v.spark, _written_names(v))
    return files.groupBy(F.regexp_extract("path", "nation=([0-9]+)", 1).alias("run_id")).agg(F.sum("length").alias("size"))


@check("s7_list_directory", """SELECT run_id, 'directory' AS type, string_split(path, '/')[2] AS name, 0 AS size FROM v_files GROUP BY ALL""")
def directory(v: Views) -> DataFrame:
    return O.list_directory(v.files(), "artifacts")


@check("e3_archive_inventory", _SIZES_SQL)
def archive(v: Views) -> DataFrame:
    files = list_files(v.spark, _written_names(v))
    path = work_path(v.spark, "inventory")
    numbered = files.withColumn("path", F.regexp_replace("path", r"/nation=([0-9]+)/.*$", "/$1"))
    write_csv(O.file_inventory(numbered), path)
    return (
        v.spark.read.schema("filename STRING, size_bytes BIGINT")
        .option("header", True)
        .csv(path)
        .groupBy(F.col("filename").alias("run_id"))
        .agg(F.sum("size_bytes").alias("size"))
    )


def _write_logs(v: Views) -> str:
    """The lines of each document as a log of its own run, with an artifact that has a log's name."""
    doc_id = F.col("doc_id")
    run = F.concat(F.col("lang"), F.lit("/runs/"), doc_id)
    stream = F.when(doc_id % 3 == 0, F.lit("/stderr.log")).otherwise(F.lit("/stdout.log"))
    decoy = F.struct(F.concat(run, F.lit("/artifacts/stdout.log")).alias("path"), F.lit("decoy").alias("content"))
    log = F.struct(F.concat(run, stream).alias("path"), F.concat("text", F.lit("\n")).alias("content"))
    files = v.table("documents").select(F.explode(F.when(doc_id % 50 == 0, F.array(log, decoy)).otherwise(F.array(log))).alias("f"))
    root = work_path(v.spark, "store/runs/logs")
    write_files(files.select("f.*").repartition(v.tasks()), root)
    return root


@check(
    "s6_read_logs",
    "SELECT d.lang AS workspace_id, CAST(l.run_id AS VARCHAR) AS run_id, l.stream, count(*) AS lines, sum(length(l.line)) AS chars FROM v_logs l JOIN documents d ON d.doc_id = l.run_id GROUP BY ALL",
)
def logs(v: Views) -> DataFrame:
    found = read_logs(v.spark, _write_logs(v))
    return found.groupBy("workspace_id", "run_id", "stream").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


@check("f3_filter_stream", "SELECT run_id, stream, line_no, line FROM v_logs WHERE stream = 'stderr'")
def stderr(v: Views) -> DataFrame:
    return O.filter_stream(v.logs(), "stderr")


@check("a16_line_counts", "SELECT run_id, stream, count(*) AS lines FROM v_logs GROUP BY ALL")
def counts(v: Views) -> DataFrame:
    return O.line_counts(v.logs())


@check("w5_line_numbers", "SELECT CAST(run_id AS VARCHAR) AS run_id, line_no, line FROM v_logs")
def numbers(v: Views) -> DataFrame:
    return read_logs(v.spark, _write_logs(v)).select("run_id", "line_no", "line")


def _people_file(v: Views) -> DataFrame:
    path = work_path(v.spark, "people")
    v.people().write.csv(path)
    return read_headerless_csv(v.spark, path, "name STRING, department STRING, salary BIGINT")


@check("s9_read_headerless_csv", "SELECT name, department, salary FROM v_people")
def people(v: Views) -> DataFrame:
    return _people_file(v)


@check("f2_high_earners", "SELECT name, department, concat('$', salary) AS salary FROM v_people WHERE salary > 7000")
def earners(v: Views) -> DataFrame:
    return R.high_earners(v.people(), 7000)


_STATS = "SELECT department, count(*) AS employees, CAST(trunc(sum(salary) / count(*)) AS BIGINT) AS avg_salary FROM v_people GROUP BY department"


@check("a1_department_stats", _STATS)
def stats(v: Views) -> DataFrame:
    return R.department_stats(v.people())


_REPORT = f"""report AS (SELECT 0 AS section, '=== FINAL REPORT ===' AS line UNION ALL SELECT 1, '' UNION ALL SELECT 3, '' UNION ALL SELECT 4, '--- High earners ---'
    UNION ALL SELECT 2, concat(department, ': ', employees, ' employees, avg salary $', avg_salary) FROM ({_STATS})
    UNION ALL SELECT 5, concat(name, ' ', department, ' $', salary) FROM v_people WHERE salary > {{threshold}})"""


def _report(v: Views, threshold: int) -> DataFrame:
    return R.build_report(R.department_stats(v.people()), R.high_earners(v.people(), threshold))


@check("u2_build_report", f"WITH {_REPORT.format(threshold=5000)} SELECT section, line FROM report")
def report(v: Views) -> DataFrame:
    return _report(v, 5000).select("section", "line")


@check(
    "s12_write_text_report",
    f"""WITH {_REPORT.format(threshold=9000)} SELECT row_number() OVER (ORDER BY section, line) - 1 AS at, line FROM report""",
)
def written_report(v: Views) -> DataFrame:
    path = work_path(v.spark, "report")
    write_text_report(_report(v, 9000), path, ["section", "sort_key", "line"])
    # Files in name order, lines in file order: the running number shows that the report is in order.
    lines = read_lines(v.spark, f"{path}/part-*")
    return number_rows(lines, [], ["file", "line_no"], "at").select("at", "line")


@check(
    "e1_text_report_job",
    f"""WITH {_REPORT.format(threshold=8000)} SELECT 'report' AS step, line FROM report
    UNION ALL SELECT 'notify', concat('Would notify: report ready (', count(*), ' lines)') FROM report
    UNION ALL SELECT 'audit', concat('Input records: ', count(*)) FROM v_people UNION ALL SELECT 'audit', concat('High earners: ', count(*)) FROM v_people WHERE salary > 8000""",
)
def text_job(v: Views) -> DataFrame:
    env = F.create_map(F.lit("NOTIFY"), F.lit("1"), F.lit("AUDIT"), F.lit("1"))
    return text_report_job(_people_file(v), env, 8000).select("step", "line")


_ANALYSIS = "SELECT category, count(*) AS count, round(sum(score) / count(*), 6) AS avg_score, min(pos) AS first_pos FROM v_languages GROUP BY category"


_RANKED = "SELECT category, language, row_number() OVER (PARTITION BY category ORDER BY pos) AS rank FROM v_languages"


@check(
    "a2_category_analysis",
    f"""SELECT a.category, a.count, a.avg_score, a.first_pos, r.rank, r.language, (SELECT count(*) FROM v_languages) AS total
    FROM ({_ANALYSIS}) a JOIN ({_RANKED}) r ON a.category = r.category""",
)
def analysis(v: Views) -> DataFrame:
    found = R.category_analysis(v.languages()).withColumn("avg_score", F.round("avg_score", 6))
    whole = found.join(R.rank_in_list(v.languages()), "category")
    total = R.total_rows(found).select(F.lit(1).alias("one"), "total")
    return whole.withColumn("one", F.lit(1)).join(total, "one").drop("one")


@check("w3_rank_in_list", _RANKED)
def ranks(v: Views) -> DataFrame:
    return R.rank_in_list(v.languages())


@check("o1_ranked_by_language", _RANKED)
def ranked(v: Views) -> DataFrame:
    return R.ranked_by_language(R.rank_in_list(v.languages()))


@check("a3_category_summary", "SELECT category, count, CAST(avg_score AS VARCHAR) AS avg FROM (SELECT category, count(*) AS count, round(sum(score) / count(*), 3) AS avg_score FROM v_languages GROUP BY category)")
def summary(v: Views) -> DataFrame:
    rows = R.category_summary(R.category_analysis(v.languages()))
    return rows.select("category", "summary.count", F.round("summary.avgScore", 3).cast("string").alias("avg"))


@check(
    "a4_best_category",
    "SELECT category, round(sum(score) / count(*), 6) AS avg_score FROM v_languages GROUP BY category ORDER BY sum(score) / count(*) DESC, min(pos) LIMIT 1",
)
def best(v: Views) -> DataFrame:
    return R.best_category(R.category_analysis(v.languages())).withColumn("avg_score", F.round("avg_score", 6))


def _placed(v: Views) -> DataFrame:
    return R.languages_by_category(R.rank_in_list(v.languages()))


@check("a5_total_languages", "SELECT count(*) AS total_languages FROM v_languages")
def totals(v: Views) -> DataFrame:
    return R.total_languages(_placed(v))


_PLACED = f"SELECT category, language, row_number() OVER (PARTITION BY category ORDER BY language, rank) - 1 AS place FROM ({_RANKED})"


@check(
    "a17_languages_by_category",
    f"SELECT category, place AS at, language FROM ({_PLACED})",
)
def by_category(v: Views) -> DataFrame:
    return _placed(v)


@check(
    "j13_category_languages",
    f"""SELECT category, coalesce(place, -1) AS at, coalesce(language, '-') AS language FROM (SELECT DISTINCT category FROM v_languages)
    LEFT JOIN (SELECT * FROM ({_PLACED}) WHERE category <> 'SMALL') USING (category)""",
)
def joined(v: Views) -> DataFrame:
    categories = R.category_analysis(v.languages()).select("category")
    found = R.category_languages(categories, _placed(v).filter("category <> 'SMALL'"))
    return found.select("category", F.coalesce("at", F.lit(-1)).alias("at"), F.coalesce("language", F.lit("-")).alias("language"))


@check("p9_rating", "SELECT p_partkey, CASE WHEN p_retailprice >= 1090 THEN 'excellent' WHEN p_retailprice >= 1080 THEN 'good' ELSE 'fair' END AS rating FROM part")
def ratings(v: Views) -> DataFrame:
    return v.table("part").select("p_partkey", rating(F.col("p_retailprice") - 1000).alias("rating"))


_RATING = "CASE WHEN {a} >= 90 THEN 'excellent' WHEN {a} >= 80 THEN 'good' ELSE 'fair' END"


@check(
    "e2_category_summary_job",
    f"""SELECT 'summary' AS kind, category AS name, {_RATING.format(a='sum(score) / count(*)')} AS rating, (SELECT count(*) FROM v_languages) AS n FROM v_languages GROUP BY category
      QUALIFY row_number() OVER (ORDER BY sum(score) / count(*) DESC, min(pos)) = 1
    UNION ALL SELECT 'category', category, {_RATING.format(a='sum(score) / count(*)')}, count(*) FROM v_languages GROUP BY category""",
)
def category_job(v: Views) -> DataFrame:
    summary_row, categories = category_summary_job(v.languages())
    path = work_path(v.spark, "summary")
    write_json_doc(summary_row, path)
    schema = "totalLanguages BIGINT, bestCategory STRUCT<name: STRING, avgScore: DOUBLE, rating: STRING>"
    document = v.spark.read.schema(schema).json(path)
    return document.select(
        F.lit("summary").alias("kind"), "bestCategory.name", "bestCategory.rating", F.col("totalLanguages").alias("n")
    ).unionByName(
        categories.groupBy("category", "rating")
        .agg(F.count("language").alias("n"))
        .select(F.lit("category").alias("kind"), F.col("category").alias("name"), "rating", "n")
    )


@check("s11_json_doc", "SELECT category, count(*) AS count, min(pos) AS first_pos FROM v_languages GROUP BY category")
def documents(v: Views) -> DataFrame:
    path = work_path(v.spark, "documents")
    rows = R.category_analysis(v.languages())
    # One document per category and file, as the reader of whole-file documents expects.
    wanted = F.to_json(F.struct("category", "count", "first_pos"))
    rows.select(wanted.alias("value"), F.col("category").alias("c")).write.partitionBy("c").text(path)
    return read_json_doc(v.spark, path, "category STRING, count BIGINT, first_pos BIGINT").drop("c")


@check(
    "s1_read_pipelines",
    """SELECT concat('nation-', s_nationkey, '-', s_suppkey // 1000) AS pipeline_id, concat('supplier-', lpad(CAST(s_suppkey AS VARCHAR), 9, '0')) AS step_id,
      row_number() OVER (PARTITION BY s_nationkey, s_suppkey // 1000 ORDER BY s_suppkey) - 1 AS pos, concat('img', s_suppkey) AS image,
      s_suppkey % 2 = 0 AS allow_failure, count(*) OVER (PARTITION BY s_nationkey, s_suppkey // 1000) AS n_steps FROM supplier WHERE s_nationkey % 5 <> 0""",
)
def pipelines(v: Views) -> DataFrame:
    """A JSON file per folder; in every fifth one a file of another format takes precedence."""
    step = F.struct(
        "s_suppkey",
        F.col("s_name").alias("name"),
        F.concat(F.lit("img"), "s_suppkey").alias("image"),
        (F.col("s_suppkey") % 2 == 0).alias("allowFailure"),
    )
    files = (
        v.table("supplier")
        .groupBy("s_nationkey", F.expr("concat(s_nationkey, '-', s_suppkey div 1000)").alias("nation"))  # at most 1000 steps each
        .agg(F.array_sort(F.collect_list(step)).alias("steps"))
        .select("s_nationkey", "nation", F.to_json(F.struct(F.concat(F.lit("Nation "), "nation").alias("name"), "steps")).alias("content"))
    )
    own = files.select(F.concat("nation", F.lit("/pipeline.json")).alias("path"), "content")
    other = files.filter("s_nationkey % 5 = 0").select(F.concat("nation", F.lit("/pipeline.yml")).alias("path"), F.lit("id: x").alias("content"))
    root = work_path(v.spark, "definitions")
    write_files(own.unionByName(other).repartition(v.tasks()), root)
    found, steps = read_pipelines(v.spark, root)
    return steps.join(found.select("pipeline_id", "n_steps"), "pipeline_id").select(
        "pipeline_id", "step_id", "pos", "image", "allow_failure", "n_steps"
    )


@check(
    "s13_read_dotenv",
    """SELECT CAST(s_nationkey AS VARCHAR) AS file, unnest(['NAME_' || s_suppkey, 'Q_' || s_suppkey]) AS key, unnest([s_name, 'a b # ' || s_suppkey]) AS value FROM supplier
    UNION ALL SELECT CAST(s_nationkey AS VARCHAR), 'SAME', 'same' FROM supplier GROUP BY s_nationkey""",
)
def dotenv(v: Views) -> DataFrame:
    number = F.col("s_suppkey").cast("string")
    text = F.concat(
        F.lit("# comment\n\nNAME_"), number, F.lit("='"), F.col("s_name"), F.lit("' # tail\nexport Q_"), number,
        F.lit(" = \"a b # "), number, F.lit("\"\nSAME='other'\nSAME=same"),
    )
    path = work_path(v.spark, "env")
    v.table("supplier").select(text.alias("value"), F.col("s_nationkey").alias("nation")).write.partitionBy("nation").text(path)
    pairs = read_dotenv(v.spark, path, glob="part-*")
    # Suppliers of a nation may be spread over several files.
    return pairs.select(F.regexp_extract("file", "nation=([0-9]+)", 1).alias("file"), "key", "value").distinct()
