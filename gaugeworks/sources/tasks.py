"""Task folders as a table: definition, state before, reference patch and coverage of each task.

`tasks` has one input partition a folder, and filters on id leave folders unread. What is absent is null: a folder without
a reference patch is told from one whose patch is empty. A definition that breaks a rule has its problems beside it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from ..operators import diffs
from .files import listed, place
from .reports import executed_lines, test_reports

#: Files of a folder, fields a definition must have, levels of risk, and causes below which a task measures little.
DEFINITION, REPORT, COVERAGE = "task.yaml", "broken-report.json", "coverage.json"
REFERENCES = ("reference.patch", "reference.diff")
REQUIRED = ("id", "repo", "base_sha", "test_command", "package", "from_version", "to_version")
RISKS = ("high", "medium", "low")
LEAST_CAUSES = 3

_TEXTS = ("repo", "base_sha", "package", "from_version", "to_version", "test_command", "reference_pr", "reference_sha", "base_sha_date", "low_power_reason")
_SCHEMA = (
    "id string, problems array<string>, " + ", ".join(f"{c} string" for c in _TEXTS) + ", python string, env map<string,string>, contamination_risk string, contamination_reason string, "
    "root_causes array<string>, unreachable array<string>, broken_report string, reference_diff string, coverage string"
)


@dataclass
class Folder(InputPartition):
    id: str
    files: tuple[str, ...]


class TaskReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.only = path, None

    def partitions(self) -> list[Folder]:
        by: dict[str, list[str]] = {}
        for name, _ in listed(self.path):
            folder, _, file = name.rpartition("/")
            if folder and "/" not in folder:
                by.setdefault(folder, []).append(file)
        found = [Folder(k, tuple(v)) for k, v in sorted(by.items()) if DEFINITION in v and (self.only is None or k in self.only)]
        return found or [Folder("", ())]

    def read(self, folder: Folder) -> Iterator[tuple]:
        if not folder.id:
            return
        files, root = place(self.path)

        def text(*names: str) -> str | None:
            name = next((n for n in names if n in folder.files), None)
            if name is None:
                return None
            with files.open_input_stream(f"{root}/{folder.id}/{name}") as f:
                return f.read().decode()

        yield (folder.id, *_defined(folder.id, text(DEFINITION)), text(REPORT), text(*REFERENCES), text(COVERAGE))


class PushingReader(TaskReader):
    """One that takes filters on id. Spark takes such a reader only where `spark.sql.python.filterPushdown.enabled` is set."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("id",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = own if self.only is None else self.only & own
            else:
                yield f


def _defined(id_: str, raw: str) -> tuple:
    """The definition's columns from problems on."""
    import yaml

    try:
        d = yaml.safe_load(raw)
    except yaml.YAMLError:
        d = None
    if not isinstance(d, dict):
        return (["not a definition"], *[None] * (len(_TEXTS) + 6))
    own = {k: str(v).strip() for k, v in (d.get("contamination") or {}).items()}
    causes, risk = [str(c) for c in d.get("root_causes") or ()], own.get("risk", "")
    lacking = [k for k in REQUIRED if not d.get(k)]
    rules = (
        (lacking, f"missing {', '.join(lacking)}"), (d.get("id") and d["id"] != id_, f"says it is {d.get('id')}"), (risk and risk not in RISKS, f"unknown risk {risk}"),
        (risk and not own.get("reason"), "risk without a reason"), (causes and len(causes) < LEAST_CAUSES and not str(d.get("low_power_reason", "")).strip(), f"{len(causes)} root causes without a low_power_reason"),
    )
    texts = [None if d.get(c) is None else str(d[c]).strip() for c in _TEXTS]
    env = {str(k): str(v) for k, v in (d.get("env") or {}).items()}
    return ([text for broken, text in rules if broken], *texts, str(d.get("python", "3.11")), env, risk or None, own.get("reason"), causes, [str(p) for p in d.get("unreachable") or ()])


class TaskSource(DataSource):
    """``tasks``: the task folders under ``path``."""

    @classmethod
    def name(cls) -> str:
        return "tasks"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> TaskReader:
        kind = PushingReader if self.options.get("push") == "true" else TaskReader
        return kind(self.options["path"].rstrip("/"))


def read_task_folders(spark: SparkSession, path: str) -> DataFrame:
    """All task folders under ``path``, those with problems too. Filters on id reach the source where the session has
    `spark.sql.python.filterPushdown.enabled`."""
    spark.dataSource.register(TaskSource)
    return spark.read.format("tasks").option("path", path).option("push", spark.conf.get("spark.sql.python.filterPushdown.enabled")).load()


def usable(tasks: DataFrame) -> DataFrame:
    """``tasks``, but a definition with problems is an error that names the first."""
    said = F.concat_ws(": ", "id", F.element_at("problems", 1))
    return tasks.where(F.when(F.size("problems") == 0, F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))


def before_states(tasks: DataFrame) -> DataFrame:
    """The recorded state before of each task, as `test_reports` gives it, with name as task. No report: no_verdict, not an empty state."""
    found = test_reports(tasks.where("broken_report is not null").select(F.col("id").alias("name"), F.col("broken_report").alias("value")))
    none = tasks.where("broken_report is null").select(F.col("id").alias("name"), F.lit("no_verdict").alias("status"), F.lit("the state before is unknown").alias("reason"))
    return found.unionByName(none, allowMissingColumns=True).withColumnRenamed("name", "task")


def referenced(tasks: DataFrame) -> DataFrame:
    """(task) of those with a reference patch, an empty one too."""
    return tasks.where("reference_diff is not null").select(F.col("id").alias("task"))


def reference_lines(tasks: DataFrame) -> DataFrame:
    """(task, path, kind, norm): what the reference patches add and remove."""
    return diffs.signature(diffs.parse(tasks.where("reference_diff is not null"), "id", "reference_diff")).withColumnRenamed("key", "task")


def executed(tasks: DataFrame) -> DataFrame:
    """(task, path, line) that the tests of tasks with a coverage report run."""
    return executed_lines(tasks.where("coverage is not null").select(F.col("id").alias("name"), F.col("coverage").alias("value"))).withColumnRenamed("name", "task")


def covered(tasks: DataFrame) -> DataFrame:
    """(task) of those with a coverage report, an empty one too."""
    return tasks.where("coverage is not null").select(F.col("id").alias("task"))


def unreached(tasks: DataFrame) -> DataFrame:
    """(task, prefix): paths that the tests of a task without a coverage report never reach."""
    return tasks.where("coverage is null").select(F.col("id").alias("task"), F.explode("unreachable").alias("prefix"))
