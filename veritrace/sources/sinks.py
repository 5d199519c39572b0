"""Writers of artifacts, sheets, manifests and fixed-width tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SETTINGS


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def run_outputs(outputs: dict[str, DataFrame], folder: str, label: str) -> None:
    """Each output of a run as JSON lines under its label."""
    for name, rows in outputs.items():
        json_lines(rows, f"{folder}/run_label={label}/{name}")


def tsv(rows: DataFrame, path: str) -> None:
    """A sheet; tabs and line ends within fields become spaces."""
    clean = [F.regexp_replace(F.col(c), r"[\t\r\n]+", " ").alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]
    rows.select(*clean).write.mode("overwrite").csv(path, sep="\t", header=True)


def annotation_tasks(substituted: DataFrame, need_gate6: bool = True) -> DataFrame:
    """Tasks for annotators, from edits that changed nothing else."""
    ok = F.coalesce(F.col("gates")["6"]["passed"], F.lit(False))
    rows = substituted.where(ok) if need_gate6 else substituted
    return rows.select(
        F.concat_ws(":", "question_id", F.col("proposal.passage_doc_id")).alias("task_id"), "question_id", F.col("proposal.passage_doc_id").alias("doc_id"), F.col("proposal.old").alias("old"), F.col("proposal.new").alias("new"),
        "old_passage", "new_passage", F.lit(None).cast("boolean").alias("semantic_unique"), F.lit(None).cast("boolean").alias("relation_plausible"), F.lit("").alias("labeler"),
    )


def file_hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """SHA-256 of each file's bytes, made where the files are read."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", F.sha2("content", 256).alias("sha256"))


def tree_hash(files: DataFrame) -> DataFrame:
    """One hash of a set of files, by their paths in order and their hashes."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: F.concat_ws(":", x["path"], x["sha256"]))
    return files.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("tree_sha256"), F.count("*").alias("n_files"))


def manifest(spark: SparkSession, label: str, mode: str, data: list[str], models: list[str], config_key: str, counts: dict, verdicts: dict) -> DataFrame:
    """One row that says what a run was made of."""
    settings = {k: getattr(SETTINGS, k) for k in SETTINGS.__dataclass_fields__ if k != "gates"}
    hashes = file_hashes(spark, data).agg(F.map_from_entries(F.collect_list(F.struct("path", "sha256"))).alias("data_sha256"))
    return hashes.select(
        F.lit(label).alias("label"), F.lit(mode).alias("mode"), F.lit(config_key).alias("config_key"), F.array(*map(F.lit, models)).alias("models"), "data_sha256",
        F.lit(json.dumps(settings, default=list, sort_keys=True)).alias("settings"), F.lit(json.dumps(counts, sort_keys=True)).alias("counts"), F.lit(json.dumps(verdicts, sort_keys=True)).alias("verdicts"), F.current_timestamp().alias("made_at"),
    )


def render(rows: list, columns: list[str], title: str, digits: int = 3) -> str:
    """A fixed-width text table of report rows."""
    say = lambda v: "-" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    cells = [columns, *[[say(r[c]) for c in columns] for r in rows]]
    width = [max(len(x[k]) for x in cells) for k in range(len(columns))]
    return "\n".join([title, *["  ".join(v.rjust(w) if k else v.ljust(w) for k, (v, w) in enumerate(zip(x, width))) for x in cells]])


def render_markdown(rows: list, columns: list[str]) -> str:
    say = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *["| " + " | ".join(say(r[c]) for c in columns) + " |" for r in rows]])
