"""Sources: file trees, snapshots of parsed files, workspaces, and versions from git."""

from __future__ import annotations

import json
import re
import subprocess
import tomllib

from corvane.functions.scalars import glob_to_regex
from corvane.sources.languages import detect
from pyspark.sql import DataFrame, SparkSession, functions as F

VERSION = 3


def ignore_patterns(text: str) -> list[tuple[str, bool]]:
    """(regex, keep) of a .gitignore's lines, in order; the last that fits decides."""
    out = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        body = line.lstrip("!").rstrip("/")
        anchored = "/" in body
        glob = body.lstrip("/") if anchored else f"**/{body}"
        regex = glob_to_regex(glob) or "\\A\\Q" + glob + "\\E\\z"
        out.append((regex.removesuffix("\\z") + "(/.*)?\\z", keep))
    return out


def scan_tree(spark: SparkSession, root: str, member: str = "root", max_kb: int = 512, max_depth: int | None = None, excludes: tuple[str, ...] = (), gitignore: str = "") -> DataFrame:
    """files(member, path, language, size, mtime, content) below a folder: visible, not ignored, small enough and of a known language."""
    root = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = raw.select(F.expr("substring(path, locate(:r, path) + length(:r) + 1)".replace(":r", "'" + root.replace("'", "\\'") + "'")).alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), F.col("content"))
    files = files.where((F.col("size") <= max_kb * 1024) & ~F.col("path").rlike("(^|/)[.][^/]"))
    if max_depth is not None:
        files = files.where(F.size(F.split("path", "/")) <= max_depth)
    ignored = F.lit(False)
    for regex, keep in ignore_patterns(gitignore):
        ignored = F.when(F.col("path").rlike(regex), not keep).otherwise(ignored)
    for glob in excludes:
        ignored = ignored | F.col("path").rlike(glob_to_regex(glob) or "\\A\\Q" + glob + "\\E(/.*)?\\z")
    files = files.where(~ignored).withColumn("language", detect(F.col("path"))).where("language IS NOT NULL")
    return files.select(F.lit(member).alias("member"), "path", "language", "size", "mtime", F.decode("content", "UTF-8").alias("content"))


def cache_split(files: DataFrame, snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): files whose path, time and size are in the snapshot, and those to parse."""
    key = ["path", "mtime", "size"]
    known = snapshot.where(F.col("version") == VERSION).select(*key).distinct()
    return files.join(known, key, "left_semi"), files.join(known, key, "left_anti")


def write_snapshot(parsed: DataFrame, current: DataFrame, path: str) -> None:
    """Overwrite the snapshot with parsed rows of paths that are still there."""
    parsed.join(current.select("path").distinct(), "path", "left_semi").withColumn("version", F.lit(VERSION)).write.mode("overwrite").parquet(path)


def workspace(manifests: dict[str, str], folders: list[str]) -> tuple[str, list[tuple[str, str]]]:
    """(kind, [(name, path)]) by Cargo.toml, else package.json, else go.work, given manifests by path and all folders."""

    def expand(pattern: str) -> list[str]:
        regex = "/".join(re.escape(p).replace("\\*", "[^/]*").replace("\\?", "[^/]") for p in pattern.rstrip("/").removeprefix("./").split("/"))
        return sorted(f for f in folders if re.fullmatch(regex, f))

    def name(folder: str) -> str:
        at = lambda f: manifests.get(f"{folder}/{f}" if folder != "." else f)
        try:
            if cargo := at("Cargo.toml"):
                return tomllib.loads(cargo)["package"]["name"]
            if package := at("package.json"):
                return json.loads(package)["name"]
            if go := at("go.mod"):
                return go.split("\n", 1)[0].split()[1].rsplit("/", 1)[-1]
        except (KeyError, IndexError, ValueError):
            pass
        return folder.rsplit("/", 1)[-1]

    kind, patterns = "none", []
    if "Cargo.toml" in manifests and (found := tomllib.loads(manifests["Cargo.toml"]).get("workspace", {}).get("members")):
        kind, patterns = "cargo", found
    elif "package.json" in manifests and (found := json.loads(manifests["package.json"]).get("workspaces")):
        kind, patterns = "npm", found["packages"] if isinstance(found, dict) else found
    elif "go.work" in manifests:
        kind, patterns = "go", re.findall(r"^\s*(?:use\s+)?(\.{0,2}/?[\w./-]+)\s*$", re.sub(r"^go\s.*$|[()]|^use\s*$", "", manifests["go.work"], flags=re.M), re.M)
    members = sorted({f for p in patterns if not p.startswith("!") for f in expand(p)})
    return (kind, [(name(m), m) for m in members]) if members else ("none", [(name("."), ".")])


def git_changed(root: str, ref: str, kinds: str | None = None) -> list[str]:
    """Paths that differ from where HEAD left `ref`; `kinds` as in git's diff filter."""
    args = ["git", "-C", root, "diff", "--name-only", *([f"--diff-filter={kinds}"] if kinds else []), f"{ref}...HEAD"]
    return subprocess.run(args, capture_output=True, text=True, check=True, timeout=120).stdout.splitlines()


def git_version(root: str, path: str, ref: str) -> str | None:
    """A file's text at `ref`, None where it isn't there."""
    done = subprocess.run(["git", "-C", root, "show", f"{ref}:{path}"], capture_output=True, text=True, timeout=120)
    return done.stdout if done.returncode == 0 else None
