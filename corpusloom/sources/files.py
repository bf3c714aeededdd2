"""Documents, configuration and logs: files in and out."""

from __future__ import annotations

import os
from dataclasses import dataclass

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import glob_regex

PROVIDERS = ("claude", "gemini", "ollama")


class AppError(Exception):
    """An error with a hint on what to do."""

    def __init__(self, message: str, hint: str | None = None):
        super().__init__(message)
        self.hint = hint

    def __str__(self):
        return super().__str__() + (f"\nHint: {self.hint}" if self.hint else "")


def read_documents(spark: SparkSession, root: str, pattern: str = "**") -> DataFrame:
    """``path, text`` of the files below ``root`` that match a glob, paths from ``root`` on; a relative ``root`` starts here."""
    root = root if "://" in root else os.path.abspath(root)
    head = root.rstrip("/") + "/"
    last = "*" if "{" in pattern else pattern.rsplit("/", 1)[-1]  # tested on listed names, before a file is opened
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*" if "**" in last else last).load(root)
    path = F.regexp_replace(F.col("path"), r"^[a-z]+:(?://)?(?=/)", "")
    below = head.split("://")[-1].replace("//", "/")  # the first place it stands at: its name may come again further down
    rel = F.substr(path, F.instr(path, F.lit(below)) + len(below))
    out = found.select(rel.alias("path"), F.decode("content", "UTF-8").alias("text"))
    return out.where(F.col("path").rlike(glob_regex(pattern)))


def matched_documents(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``read_documents``, failing with a hint if no file matches."""
    found = read_documents(spark, root, pattern)
    if found.select("path").isEmpty():
        raise AppError(f"No files matched: {pattern}", f"Looked below {root}.")
    return found


def read_template(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def write_documents(docs: DataFrame, path: str) -> None:
    """``path, text`` rows as one file each below ``path``; a task that runs again writes the same files.

    ``path`` is a folder that all executors share.  A null text is an empty file; a path
    that leaves the folder fails the write.
    """

    def put(rows):
        for r in rows:
            to = os.path.normpath(os.path.join(path, r["path"]))
            if os.path.isabs(r["path"]) or not to.startswith(os.path.normpath(path) + os.sep):
                raise ValueError(f"Path leaves the output folder: {r['path']}")
            os.makedirs(os.path.dirname(to), exist_ok=True)
            with open(to, "w", encoding="utf-8", newline="") as f:
                f.write(r["text"] or "")

    docs.select("path", "text").foreachPartition(put)


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").text(path)


def log_rows(calls: DataFrame, path: str) -> None:
    """Append calls to a JSON-lines log, each with an ISO-8601 UTC time."""
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    calls.withColumn("timestamp", stamp).write.mode("append").json(path)


@dataclass
class Config:
    provider: str
    model: str
    glossary: str | None = None
    templates: str | None = None
    output_dir: str | None = None
    log_enabled: bool = False
    log_path: str | None = None


def load_env(folder: str) -> dict[str, str]:
    """Values of a ``.env`` file that the environment lacks; they are put there."""
    path, out = os.path.join(folder, ".env"), {}
    if os.path.exists(path):
        for line in open(path, encoding="utf-8"):
            key, sep, value = line.strip().partition("=")
            if sep and not key.startswith("#") and key.strip() not in os.environ:
                out[key.strip()] = value.strip().strip("\"'")
    os.environ.update(out)
    return out


def load_config(path: str, env_dir: str | None = None) -> Config:
    if not os.path.exists(path):
        raise AppError(f"Config file not found: {path}", "create one first")
    if env_dir:
        load_env(env_dir)
    raw = yaml.safe_load(open(path, encoding="utf-8"))
    if not isinstance(raw, dict):
        raise AppError("Invalid config: not a mapping")
    if raw.get("provider") not in PROVIDERS:
        raise AppError(f"Invalid provider: {raw.get('provider')}", "one of " + ", ".join(PROVIDERS))
    if not isinstance(raw.get("model"), str) or not raw["model"]:
        raise AppError("Invalid config: model is required")
    if raw.get("glossary") is not None and not isinstance(raw["glossary"], str):
        raise AppError("Invalid config: glossary must be a path")
    log = raw.get("log") or {}
    return Config(raw["provider"], raw["model"], raw.get("glossary"), raw.get("templates"), raw.get("outputDir"), bool(log.get("enabled")), log.get("path"))


def init_config(path: str, force: bool = False) -> None:
    if os.path.exists(path) and not force:
        raise AppError(f"Config already exists: {path}")
    with open(path, "w", encoding="utf-8") as f:
        f.write("# provider: claude, gemini or ollama\nprovider: claude\nmodel: set-a-model\n# glossary: glossary.yaml\n# outputDir: ./output\n# log: {enabled: true, path: calls.log}\n")


def version() -> str:
    from importlib import metadata

    try:
        return metadata.version("corpusloom")
    except metadata.PackageNotFoundError:
        return "0.0.0"
