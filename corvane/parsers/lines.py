"""Line-oriented parsers as plain SQL: HTML, shell, CMake, Markdown, properties and carried sections.

Files are (path, content); every parser gives (path, line, kind, name, signature, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Fixed values.
HTML_TAGS = "head|body|header|nav|main|section|article|aside|footer|form|table|script|style|template|slot|dialog"
HTML_ID, HTML_TITLE = "id\\s*=\\s*[\"']([^\"']+)[\"']", "<title[^>]*>([^<]+)</title>"
HTML_SHEET, HTML_SCRIPT = "<link\\s+rel\\s*=\\s*[\"']stylesheet[\"'][^>]*href\\s*=\\s*[\"']([^\"']+)[\"']", "<script[^>]*src\\s*=\\s*[\"']([^\"']+)[\"']"
SHELL_WORDS = "if for while until case do then else elif fi done esac export alias source echo return exit set unset local readonly".split()


def lines(files: DataFrame) -> DataFrame:
    """(path, line, text): lines from 1, where a last line feed adds none and carriage returns go."""
    body = F.regexp_replace("content", "\n\\z", "")
    return files.where("content <> ''").select("path", F.posexplode(F.split(body, "\n")).alias("i", "text")).select("path", (F.col("i") + 1).cast("bigint").alias("line"), F.regexp_replace("text", "\r\\z", "").alias("text"))


def _first(cases: list[tuple[str, str, Column, Column]], df: DataFrame) -> DataFrame:
    """The first (pattern, kind, name, signature) whose pattern fits a line."""
    pick = None
    for pattern, kind, name, signature in cases:
        made = F.struct(F.lit(kind).alias("kind"), name.alias("name"), signature.alias("signature"))
        pick = F.when(F.col("t").rlike(pattern), made) if pick is None else pick.when(F.col("t").rlike(pattern), made)
    return df.withColumn("d", pick).where("d.kind IS NOT NULL AND d.name <> ''").select("path", "line", "d.*")


def html(files: DataFrame) -> DataFrame:
    """The first structural tag of each line, with an id on that line, and titles."""
    x = lines(files).withColumn("t", F.trim("text"))
    tag, ident, title = F.regexp_extract("t", f"<({HTML_TAGS})[\\s>]", 1), F.regexp_extract("t", HTML_ID, 1), F.regexp_extract("t", HTML_TITLE, 1)
    name = F.when(ident != "", F.concat(tag, F.lit("#"), ident)).otherwise(tag)
    a = x.where(tag != "").select("path", "line", F.lit("ConfigKey").alias("kind"), name.alias("name"), F.concat(F.lit("<"), name, F.lit(">")).alias("signature"))
    cut = F.when(F.octet_length(title) > 60, F.concat(F.left(title, F.lit(60)), F.lit("..."))).otherwise(title)
    return a.union(x.where(title != "").select("path", "line", F.lit("ConfigKey"), F.lit("title"), F.concat(F.lit("title: "), cut)))


def html_imports(files: DataFrame) -> DataFrame:
    """(path, line, text): the first stylesheet and the first script source of each line."""
    x = lines(files)
    sheet, script = F.regexp_extract("text", HTML_SHEET, 1), F.regexp_extract("text", HTML_SCRIPT, 1)
    return x.select("path", "line", F.explode(F.filter(F.array(sheet, script), lambda s: s != "")).alias("text"))


def shell(files: DataFrame) -> DataFrame:
    """Functions, exports and aliases; sourced files are left to shell_imports."""
    x = lines(files).withColumn("t", F.trim("text")).where(~F.col("t").rlike("^(?:source\\s+|[.]\\s+)."))
    word = "[A-Za-z_][A-Za-z0-9_]*"
    one = lambda p: F.regexp_extract("t", p, 1)
    short = one(f"^({word})\\s*\\(\\s*\\)")
    return _first(
        [
            (f"^function\\s+{word}\\s*\\(\\s*\\)", "ShellFunction", one(f"^function\\s+({word})"), F.concat(F.lit("function "), one(f"^function\\s+({word})"), F.lit("()"))),
            (f"^function\\s+{word}(?:\\s*\\{{|\\s*\\z)", "ShellFunction", one(f"^function\\s+({word})"), F.concat(F.lit("function "), one(f"^function\\s+({word})"))),
            (f"^{word}\\s*\\(\\s*\\)", "ShellFunction", F.when(short.isin(*SHELL_WORDS), "").otherwise(short), F.concat(short, F.lit("()"))),
            (f"^export\\s+{word}=", "Constant", one(f"^export\\s+({word})="), F.concat(F.lit("export "), one(f"^export\\s+({word})="))),
            ("^alias\\s+[A-Za-z_][A-Za-z0-9_-]*=", "Constant", one("^alias\\s+([A-Za-z_][A-Za-z0-9_-]*)="), F.concat(F.lit("alias "), one("^alias\\s+([A-Za-z_][A-Za-z0-9_-]*)="))),
        ],
        x,
    )


def shell_imports(files: DataFrame) -> DataFrame:
    text = F.regexp_extract(F.trim("text"), "^(?:source\\s+|[.]\\s+)(.+)\\z", 1)
    return lines(files).select("path", "line", F.regexp_replace(F.trim(text), "^[\"']+|[\"']+\\z", "").alias("text")).where("text <> ''")


def cmake(files: DataFrame) -> DataFrame:
    """Projects, libraries, executables, functions, macros, options and upper-case variables."""
    x = lines(files).withColumn("t", F.trim("text"))
    made = []
    for call, kind in (("project", "Module"), ("add_library", "Module"), ("add_executable", "Function"), ("function", "Function"), ("macro", "Macro"), ("option", "ConfigKey")):
        p = f"^(?i:{call})\\s*\\(\\s*([A-Za-z0-9_.${{}}-]+)"
        made.append((p, kind, F.regexp_extract("t", p, 1), F.concat(F.lit(f"{call}("), F.regexp_extract("t", p, 1), F.lit(")"))))
    p = "^(?i:set)\\s*\\(\\s*([A-Z][A-Z0-9_]*)\\s"
    made.append((p, "Constant", F.regexp_extract("t", p, 1), F.concat(F.lit("set("), F.regexp_extract("t", p, 1), F.lit(")"))))
    return _first(made, x)


def markdown(files: DataFrame) -> DataFrame:
    """Headings with parent_line: the nearest heading above of a smaller level.

    For each of six levels a window carries the last heading's line; the parent is the greatest
    carried line among smaller levels, as a later heading of a level closes all deeper ones.
    """
    p = "^(#{1,6})\\s+(.+)\\z"
    x = lines(files).where(F.col("text").rlike(p)).select("path", "line", F.length(F.regexp_extract("text", p, 1)).alias("level"), F.trim(F.regexp_extract("text", p, 2)).alias("name"))
    above = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    carried = x
    for k in range(1, 6):
        carried = carried.withColumn(f"l{k}", F.max(F.when(F.col("level") == k, F.col("line"))).over(above))
    parent = F.lit(None).cast("bigint")
    for k in range(2, 7):
        parent = F.when(F.col("level") == k, F.greatest(*[F.col(f"l{j}") for j in range(1, k)], F.lit(None).cast("bigint"))).otherwise(parent)
    return carried.select("path", "line", F.lit("Heading").alias("kind"), "name", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("name")).alias("signature"), parent.alias("parent_line"))


def properties(files: DataFrame) -> DataFrame:
    """Keys; those with a dot stand under a group of their first part, at its first line."""
    p = "^([A-Za-z_][A-Za-z0-9_.-]*)\\s*[=:]"
    x = lines(files).withColumn("t", F.trim("text")).where(~F.col("t").rlike("^[#!]") & F.col("t").rlike(p)).select("path", "line", F.regexp_extract("t", p, 1).alias("name"), "t")
    group = F.when(F.contains("name", F.lit(".")), F.regexp_extract("name", "^([^.]*)", 1))
    keys = x.select("path", "line", F.lit("ConfigKey").alias("kind"), "name", F.col("t").alias("signature"), group.alias("parent"))
    heads = keys.where("parent IS NOT NULL").groupBy("path", "parent").agg(F.min("line").alias("line"))
    return keys.union(heads.select("path", "line", F.lit("ConfigKey"), "parent", F.concat("parent", F.lit(".*")), F.lit(None).cast("string")))


def toml_keys(files: DataFrame) -> DataFrame:
    """(path, line, kind, name, section): sections, and keys with the section they stand in (carried down)."""
    x = lines(files).withColumn("t", F.trim("text")).where(~F.startswith("t", F.lit("#")))
    head, key = F.regexp_extract("t", "^\\[\\[?([^\\]]+)\\]", 1), F.regexp_extract("t", "^([A-Za-z_][A-Za-z0-9_-]*)\\s*=", 1)
    x = x.withColumns({"head": F.nullif(F.trim(head), F.lit("")), "key": F.nullif(key, F.lit(""))})
    run = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("section", F.last("head", True).over(run))
    return x.where("head IS NOT NULL OR key IS NOT NULL").select("path", "line", F.lit("ConfigKey").alias("kind"), F.coalesce("head", "key").alias("name"), F.when(F.col("head").isNull(), F.col("section")).alias("section"))


def brace_depth(files: DataFrame) -> DataFrame:
    """(path, line, depth): braces open after each line."""
    n = lambda c: F.length("text") - F.length(F.replace(F.col("text"), F.lit(c), F.lit("")))
    run = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines(files).select("path", "line", F.sum(n("{") - n("}")).over(run).alias("depth"))
