"""The queries of the driver contract, one per operator of the library."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from flawsieve.functions.paths import extension
from flawsieve.functions.predicates import is_secret_assignment, is_secret_format
from flawsieve.operators.lines import explode_lines, with_language
from flawsieve.plans import reports
from flawsieve.plans.scan import findings, read_against, scan_log, scan_read, scan_table
from flawsieve.plans.workspace import scope_counts, workspace_log, workspace_report
from flawsieve.rules import BUILTIN_RULES, RULE_SETS, SEVERITIES, Rule
from flawsieve.sources.files import DEFAULT_EXCLUDES, supported_files
from flawsieve.sources.folders import shared_folder
from flawsieve.sources.store import last_run, write_run
from flawsieve.streaming.current import read_current, update_current
from flawsieve.streaming.revisions import current_findings, scan_revisions
from querysuite.corpus import code_corpus, revisions

FINDING = ("path", "language", "line", "rule_ord", "issue", "severity", "confidence")

# Two rules of each set share a text, and a line with the first has the second.
TWIN_RULES = tuple(
    rule
    for name in RULE_SETS
    for rule in (
        Rule(name, 1, "eval(", "High", "Dynamic evaluation", 0.9),
        Rule(name, 2, "val(", "Medium", "Dynamic evaluation", 0.85),
        Rule(name, 3, "val(", "Low", "Dynamic evaluation", 0.7),
        Rule(name, 4, "exec", "High", "Execution", 0.5),
        Rule(name, 5, "random", "Low", "Randomness", 0.65),
    )
)

# A rule for each pair of the letters a to p: far more than the scan tests one by one.
MANY_RULES = tuple(
    Rule(name, i + 1, chr(97 + i // 16) + chr(97 + i % 16), SEVERITIES[i % 3], f"Letters {i}", i % 100 / 100)
    for name in RULE_SETS
    for i in range(256)
)

# As many rules as a table can hold, of six letters each, made of common endings.
SYLLABLES = ("an", "er", "th", "in", "on", "es", "or", "ti", "re", "al")
MOST_RULES = tuple(
    Rule(
        name, i + 1, SYLLABLES[i % 10] + SYLLABLES[i // 10 % 10] + SYLLABLES[i // 100], SEVERITIES[i % 3],
        f"Syllables {i}", i % 100 / 100,
    )
    for name in RULE_SETS
    for i in range(1000)
)

# So small that most files of the corpus have several parts.
SMALL_PART = 3


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _wide(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, so that both engines agree on types."""
    return df.select(
        *(F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes)
    )


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_table(code_corpus(spark, sf_dir))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_log(code_corpus(spark, sf_dir))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken for Python files and web pages for JavaScript files."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
        F.col("text").alias("content"),
    )
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        F.concat(F.lit("p/"), F.col("page_id").cast("string"), F.lit(".js")).alias("path"),
        F.col("html").alias("content"),
    )
    return documents.unionByName(pages)


def detect_language(spark, sf_dir):
    return with_language(code_corpus(spark, sf_dir)).selectExpr(
        "path", f"{extension('path')} AS ext", "language", "rule_set"
    )


def supported(spark, sf_dir):
    return supported_files(code_corpus(spark, sf_dir))


def exclude_globs(spark, sf_dir):
    return supported_files(code_corpus(spark, sf_dir), DEFAULT_EXCLUDES)


def lines(spark, sf_dir):
    return _wide(explode_lines(code_corpus(spark, sf_dir)))


def rule_match(spark, sf_dir):
    return _wide(scan_table(code_corpus(spark, sf_dir), heuristics=()))


def confidence_band(spark, sf_dir):
    rules = _findings(spark, sf_dir).filter(F.col("confidence").isNotNull())
    return rules.groupBy("issue", "confidence").agg(F.count("*").alias("n"))


def _heuristic(flag: str):
    def query(spark, sf_dir):
        found = scan_table(code_corpus(spark, sf_dir), rules=(), heuristics=[flag])
        return _wide(found.select("path", "line", "issue", "severity"))

    return query


def heur_secret(spark, sf_dir):
    files = code_corpus(spark, sf_dir).select("path", "content").unionByName(_texts(spark, sf_dir))
    found = scan_table(files, rules=(), heuristics=["h_secret"])
    return _wide(found.select("path", "line", "issue", "severity"))


def secret_assignment(spark, sf_dir):
    found = explode_lines(code_corpus(spark, sf_dir)).filter(is_secret_assignment("text"))
    return _wide(found.select("path", "line", "text"))


def secret_format(spark, sf_dir):
    found = explode_lines(code_corpus(spark, sf_dir)).filter(is_secret_format("text"))
    return _wide(found.select("path", "line", "text"))


def scan_all(spark, sf_dir):
    return _wide(_findings(spark, sf_dir))


def scan_documents(spark, sf_dir):
    return _wide(scan_table(_texts(spark, sf_dir)))


def dedupe_findings(spark, sf_dir):
    return _wide(scan_table(code_corpus(spark, sf_dir), rules=TWIN_RULES))


def min_severity(spark, sf_dir):
    return _wide(reports.min_severity(_findings(spark, sf_dir)))


def ordered_findings(spark, sf_dir):
    return _wide(reports.ordered_findings(_findings(spark, sf_dir)))


def diagnostics(spark, sf_dir):
    return _wide(reports.diagnostics(reports.min_severity(_findings(spark, sf_dir))))


def severity_summary(spark, sf_dir):
    return reports.severity_summary(_findings(spark, sf_dir))


def severity_by_file(spark, sf_dir):
    return reports.severity_by_file(_findings(spark, sf_dir))


def _flat(report: DataFrame) -> DataFrame:
    # One string instead of the array, which the two engines would hash apart.
    issues = F.transform(
        "issues", lambda i: F.concat_ws("|", i["line"].cast("string"), i["severity"], i["issue"])
    )
    return _wide(report.withColumn("issues", F.array_join(issues, "\n")))


def report_by_file(spark, sf_dir):
    return _flat(reports.report_by_file(_findings(spark, sf_dir), "/repo"))


def report_by_file_parts(spark, sf_dir):
    return _flat(reports.report_by_file(_findings(spark, sf_dir), "/repo", SMALL_PART))


def report_json_parts(spark, sf_dir):
    return _wide(reports.report_json(_log(spark, sf_dir), SMALL_PART))


def findings_text_parts(spark, sf_dir):
    return _wide(reports.findings_text(_log(spark, sf_dir), SMALL_PART))


def _workspace(spark: SparkSession, sf_dir: str):
    return workspace_report(workspace_log(code_corpus(spark, sf_dir)), root="/repo")


def workspace_summary(spark, sf_dir):
    return _workspace(spark, sf_dir).summary


def workspace_reports(spark, sf_dir):
    return _flat(_workspace(spark, sf_dir).by_file)


def workspace_label(spark, sf_dir):
    return _workspace(spark, sf_dir).label


def workspace_scope(spark, sf_dir):
    files = code_corpus(spark, sf_dir)
    return scope_counts(files, workspace_log(files))


def user_rules(spark, sf_dir):
    return _wide(scan_table(code_corpus(spark, sf_dir), rules=MANY_RULES, heuristics=()))


def indexed_rules(spark, sf_dir):
    return _wide(scan_table(_texts(spark, sf_dir), rules=MOST_RULES))


def explode_conversations(spark, sf_dir):
    """Every turn taken for a Java file."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr(
        "concat('conv/', conv_id, '/', turn, '.java') AS path", "text AS content"
    )
    return _wide(explode_lines(turns))


def report_json(spark, sf_dir):
    return _wide(reports.report_json(_log(spark, sf_dir)))


def report_text(spark, sf_dir):
    return _wide(reports.report_text(_log(spark, sf_dir)))


def findings_text(spark, sf_dir):
    return _wide(reports.findings_text(_log(spark, sf_dir)))


def report_title(spark, sf_dir):
    return reports.report_title(_findings(spark, sf_dir))


def status_label(spark, sf_dir):
    return reports.status_label(_findings(spark, sf_dir))


def scan_status(spark, sf_dir):
    return reports.scan_status(_log(spark, sf_dir))


def last_run_report(spark, sf_dir):
    """A run a day, of the files whose last event falls on it: the last two are stored, the last one is read."""
    files = code_corpus(spark, sf_dir).selectExpr(
        "*", "CAST(date_format(event_time, 'yyyyMMdd') AS BIGINT) AS run_id"
    )
    store = _new_folder(spark, "runs")
    days = [r.run_id for r in files.select("run_id").distinct().orderBy(F.desc("run_id")).limit(2).collect()]
    for day in days:
        write_run(scan_log(files.filter(F.col("run_id") == day)), store, day)
    log = last_run(spark, store)
    return reports.severity_by_file(findings(log if log is not None else scan_log(files.limit(0))))


def kept_current(spark, sf_dir):
    """The revisions in four batches: late ones after their successors, and some again."""
    log = scan_revisions(revisions(spark, sf_dir))
    store = _new_folder(spark, "current")
    batches = (
        "revision = 2 AND hash(path) % 2 = 0", "revision = 1 AND hash(path) % 3 <> 0",
        "revision = 2 AND hash(path) % 4 <> 0", "revision = 1 OR hash(path) % 2 <> 0",
    )
    for number, batch in enumerate(batches, 1):
        update_current(log.filter(batch), store, number, buckets=4)
    return _wide(read_current(spark, store, log.schema))


def quarantine_report(spark, sf_dir):
    """The corpus as it was listed, and as it was read: of seven files one is gone, one cut short, one longer."""
    files = code_corpus(spark, sf_dir)
    listing = files.selectExpr("path", "octet_length(content) AS length")
    content = """CASE file_id % 7 WHEN 1 THEN left(content, char_length(content) div 2)
                                  WHEN 2 THEN concat(content, 'x') ELSE content END AS content"""
    read = files.filter("file_id % 7 <> 0").selectExpr("path", content)
    log = scan_read(read_against(listing, read))
    return log.groupBy("path").agg(
        F.max("reason").alias("reason"), F.max("n_lines").alias("n_lines"), F.count_if(F.col("rule_ord") > 0).alias("n_issues")
    )


def first_findings(spark, sf_dir):
    """Every file delivered twice, the second time with its rules in another order."""
    again = scan_table(code_corpus(spark, sf_dir), rules=[r._replace(rule_ord=100 + r.rule_ord) for r in BUILTIN_RULES])
    return _wide(reports.first_findings(again.unionByName(_findings(spark, sf_dir))))


def scan_progress(spark, sf_dir):
    files = code_corpus(spark, sf_dir)
    return reports.scan_progress(workspace_log(files), files)


def current(spark, sf_dir):
    log = scan_revisions(revisions(spark, sf_dir))
    return _wide(current_findings(log))


QUERIES = {
    "detect_language": detect_language,
    "supported_files": supported,
    "exclude_globs": exclude_globs,
    "explode_lines": lines,
    "rule_match": rule_match,
    "confidence_band": confidence_band,
    "heur_sql": _heuristic("h_sql"),
    "heur_xss": _heuristic("h_xss"),
    "heur_path": _heuristic("h_path"),
    "heur_secret": heur_secret,
    "secret_assignment": secret_assignment,
    "secret_format": secret_format,
    "scan_all": scan_all,
    "scan_documents": scan_documents,
    "dedupe_findings": dedupe_findings,
    "min_severity": min_severity,
    "ordered_findings": ordered_findings,
    "diagnostics": diagnostics,
    "severity_summary": severity_summary,
    "severity_by_file": severity_by_file,
    "report_by_file": report_by_file,
    "report_json": report_json,
    "report_text": report_text,
    "findings_text": findings_text,
    "report_by_file_parts": report_by_file_parts,
    "report_json_parts": report_json_parts,
    "findings_text_parts": findings_text_parts,
    "workspace_summary": workspace_summary,
    "workspace_report": workspace_reports,
    "workspace_label": workspace_label,
    "workspace_scope": workspace_scope,
    "user_rules": user_rules,
    "indexed_rules": indexed_rules,
    "explode_conversations": explode_conversations,
    "report_title": report_title,
    "status_label": status_label,
    "scan_status": scan_status,
    "last_run_report": last_run_report,
    "current_findings": current,
    "kept_current": kept_current,
    "quarantine_report": quarantine_report,
    "first_findings": first_findings,
    "scan_progress": scan_progress,
}
