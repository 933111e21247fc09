"""Scalar functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Extensions of four or more characters that end an import, prefixes that name no path.
LONG_EXTENSIONS = ("json", "yaml", "toml", "wasm", "lock", "html", "scss", "less", "svelte")
IMPORT_PREFIXES = ("crate/", "super/", "self/", "import ", "from ", "require('", 'require("', "require(")
#: Primitive type names, compared in lower case, and the importance of entry-point files.
PRIMITIVES = (
    "str", "string", "i8", "i16", "i32", "i64", "i128", "isize", "u8", "u16", "u32", "u64", "u128", "usize", "f32", "f64", "bool", "char", "int", "float", "double", "long", "short",
    "byte", "void", "undefined", "null", "none", "any", "object", "number", "boolean", "self", "error",
)
ENTRY_POINTS = {
    100: ("main.rs", "main.py", "main.go", "main.ts", "main.js", "main.java", "index.ts", "index.js", "index.tsx", "index.jsx"),
    90: ("lib.rs", "lib.py"),
    50: ("mod.rs", "__init__.py", "mod.ts"),
}


def estimate_tokens(s: Column) -> Column:
    """ceil(bytes / 4)."""
    return F.ceil(F.octet_length(s) / 4).cast("bigint")


def path_parts(path: Column) -> Column:
    """Components, whose array order is the order of paths."""
    return F.split(path, "/")


def split_identifier(name: Column) -> Column:
    """Lower-case words of a snake_case, kebab-case or camelCase name."""
    return F.filter(F.split(F.lower(F.regexp_replace(name, "(?<=[a-z0-9])(?=\\p{Lu})", "_")), "[_\\-./]"), lambda x: x != "")


def bigrams(s: Column) -> Column:
    return F.when(F.length(s) < 2, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2))))
    )


def bigram_similarity(a: Column, b: Column) -> Column:
    """Dice coefficient over sets of character bigrams; 0 under two bytes."""
    x, y = bigrams(a), bigrams(b)
    return F.when((F.octet_length(a) < 2) | (F.octet_length(b) < 2), 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / F.greatest(F.size(x) + F.size(y), F.lit(1)))


def score_match(text: Column, query: str, terms: list[str]) -> Column:
    """Points of a lower-cased text: substring 10, equal 20 more, each term 5, each term that is a whole part 3, else a fuzzy remainder.

    Texts are cut into parts only where they hold the term, and into bigrams only where they hold so many
    of the query's bigrams that a similarity of over 0.4 is possible: with c of the query's y bigrams, it is at most 2c / (c + y).
    """
    score = F.when(F.contains(text, F.lit(query)), 10).otherwise(0) + F.when(text == query, 20).otherwise(0)
    for term in terms:
        score = score + F.when(F.contains(text, F.lit(term)), F.when(F.array_contains(split_identifier(text), term), 8).otherwise(5)).otherwise(0)
    if len(query.encode()) < 4:
        return score.cast("int")
    pairs = sorted({query[k : k + 2] for k in range(len(query) - 1)})
    shared = F.lit(0)
    for pair in pairs:
        shared = shared + F.contains(text, F.lit(pair)).cast("int")
    alike = 2.0 * shared / (F.size(bigrams(text)) + len(pairs))
    return F.when(score != 0, score).when(shared * 4 <= len(pairs), 0).when(alike > 0.4, F.floor(alike * 8)).otherwise(0).cast("int")


def word_boundary(text: Column, word: str) -> Column:
    """True if the word stands without ASCII word characters at its sides; never for an empty word."""
    if not word:
        return F.lit(False)
    quoted = "\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return text.rlike(f"(?<![A-Za-z0-9_]){quoted}(?![A-Za-z0-9_])")


def glob_to_regex(pattern: str) -> str | None:
    """Anchored Java pattern of a glob whose `*` and `?` stay within a component; None without metacharacters."""
    if not any(c in pattern for c in "*?["):
        return None
    if "/" not in pattern:
        pattern = f"**/{pattern}"
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if pattern.startswith("**/", k) and (k == 0 or pattern[k - 1] == "/"):
            out, k = out + "(?:.*/)?", k + 3
        elif pattern.startswith("/**", k) and k + 3 == len(pattern):
            out, k = out + "/.*", k + 3
        elif c == "*":
            k += 2 if pattern.startswith("**", k) else 1
            out += "[^/]*"
        elif c == "?":
            out, k = out + "[^/]", k + 1
        elif c == "[" and (end := pattern.find("]", k + 2)) > 0:
            body = pattern[k + 1 : end]
            out, k = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "&&[^/]]", end + 1
        else:
            out, k = out + ("\\" + c if not c.isalnum() and c not in "_/ " else c), k + 1
    return f"\\A{out}\\z"


def glob_match(path: Column, pattern: str) -> Column:
    """Glob; without metacharacters the path itself or a folder above it."""
    regex = glob_to_regex(pattern)
    return path.rlike(regex) if regex else (path == pattern) | path.startswith(f"{pattern}/")


def file_importance(path: Column, public: Column, lines: Column) -> Column:
    """Entry points 100, 90 or 50 by file name, less 5 a folder, plus 3 a public declaration, less 1 a hundred lines."""
    name = F.element_at(path_parts(path), -1)
    entry = F.lit(0)
    for points, names in ENTRY_POINTS.items():
        entry = F.when(name.isin(*names), points).otherwise(entry)
    return (entry - 5 * (F.size(path_parts(path)) - 1) + 3 * public - F.floor(lines / 100)).cast("bigint")


def hotspot_score(cc: Column, nesting: Column, params: Column, lines: Column) -> Column:
    return cc + 2.0 * nesting + 0.5 * params + F.coalesce(lines, F.lit(0)) / 20.0


def normalize_import(text: Column) -> Column:
    """`::` and dots between names become `/`; dots of file extensions stay."""
    letters = "[\\p{L}\\p{N}]"
    ends = f"{letters}{{1,5}}(?=[^\\p{{L}}\\p{{N}}_.])|(?:{letters}{{1,3}}|(?i:{'|'.join(LONG_EXTENSIONS)}))\\z"
    return F.regexp_replace(F.replace(text, F.lit("::"), F.lit("/")), f"\\.(?!{ends})", "/")


def strip_import_prefix(text: Column) -> Column:
    quoted = "|".join("\\Q" + p + "\\E" for p in IMPORT_PREFIXES)
    return F.regexp_replace(F.regexp_replace(text, f"^(?:{quoted})", ""), "\\)*'*\"*\\z", "")


def import_segments(text: Column) -> Column:
    """Segments that an import's text is matched by."""
    bare = F.regexp_replace(F.trim(text), "^(?:use )*(?:import )*(?:from )*", "")
    return F.filter(F.split(strip_import_prefix(normalize_import(F.trim(F.regexp_replace(bare, ";+\\z", "")))), "/"), lambda x: x != "")


def import_candidates(text: Column) -> Column:
    """Lower-case path ends to try, best first: trailing slices, then leading ones, of three bytes or more."""
    s = import_segments(text)
    n = F.size(s)
    trailing = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.array_join(F.slice(s, k, n), "/"))).otherwise(F.array().cast("array<string>"))
    leading = F.when(n > 1, F.transform(F.sequence(F.greatest(n - 1, F.lit(1)), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(s, 1, k), "/"))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(F.concat(trailing, leading), lambda x: F.lower(x)), lambda x: F.octet_length(x) >= 3)


def relative_target(path: Column, text: Column) -> Column:
    """Lower-case path that a relative import names, from its file's folder, without `.` and `..`; else null."""
    asked = import_path(text)
    joined = F.split(F.concat(F.regexp_replace(path, "[^/]*\\z", ""), asked), "/")
    step = lambda done, x: F.when(x.isin("", "."), done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x))
    folded = F.aggregate(joined, F.array().cast("array<string>"), step)
    return F.when(asked.rlike("^[.]{1,2}/"), F.lower(F.array_join(folded, "/")))


def import_path(text: Column) -> Column:
    """Quoted path after the keyword from, else a quoted relative path, else a bare one."""
    quoted = lambda s: F.coalesce(F.nullif(F.regexp_extract(s, '"([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract(s, "'([^']*)'", 1), F.lit("")))
    after = F.regexp_extract(text, "(?s)(?<![A-Za-z0-9])from(?![A-Za-z0-9])(.*)", 1)
    relative = quoted(text)
    return F.when(text.rlike("(?<![A-Za-z0-9])from(?![A-Za-z0-9])"), quoted(after)).when(relative.rlike("^[.]{1,2}/"), relative).otherwise(F.nullif(F.regexp_extract(F.trim(text), "^([.]{1,2}/[^\\s;]*)", 1), F.lit("")))


def truncate(s: Column, most: int) -> Column:
    """The first `most` characters and `...` if it has more bytes than that."""
    return F.when(F.octet_length(s) > most, F.concat(F.left(s, F.lit(most)), F.lit("..."))).otherwise(s)


def truncate_doc(s: Column, most: int = 120) -> Column:
    """As truncate, without dots before the `...`."""
    return F.when(F.octet_length(s) > most, F.concat(F.regexp_replace(F.left(s, F.lit(most)), "[.]+\\z", ""), F.lit("..."))).otherwise(s)


def sanitize_id(s: Column) -> Column:
    """Lower-case ASCII letters, digits, `_` and `-`."""
    return F.lower(F.regexp_replace(s, "[^A-Za-z0-9_-]", ""))


def long_words(s: Column, least: int = 4) -> Column:
    """White-space separated words of at least so many bytes."""
    return F.filter(F.split(F.trim(F.regexp_replace(s, "\\s+", " ")), " "), lambda w: F.octet_length(w) >= least)


def derive_topic_id(s: Column) -> Column:
    found = F.array_join(F.slice(F.filter(F.transform(long_words(s), lambda w: sanitize_id(w)), lambda w: w != ""), 1, 3), "-")
    return F.when(found == "", F.lit("topic-new")).otherwise(F.concat(F.lit("topic-"), found))


def title_from_text(s: Column) -> Column:
    return F.array_join(F.transform(F.slice(long_words(s), 1, 5), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))), " ")


def format_size(n: Column) -> Column:
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("bigint")))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", F.bround(n / 1024.0, 1)))
        .when(n.isNotNull(), F.format_string("%.1f MB", F.bround(n / (1024.0 * 1024.0), 1)))
    )


def savings_percent(part: Column, whole: Column) -> Column:
    return 100 - F.floor(100 * part / whole)


def github_repo(url: Column) -> Column:
    """STRUCT<owner, repo> of an https or ssh address of the host github.com."""
    pattern = "github[.]com[:/]([^/]+)/([^/]+?)(?:[.]git)?/?\\z"
    return F.when(F.regexp_extract(url, pattern, 1) != "", F.struct(F.regexp_extract(url, pattern, 1).alias("owner"), F.regexp_extract(url, pattern, 2).alias("repo")))


def line_count(text: Column) -> Column:
    """Lines, where a last line feed adds none."""
    body = F.regexp_replace(text, "\n\\z", "")
    return F.when(text == "", 0).otherwise(F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def wiki_links(text: Column) -> Column:
    """Distinct sanitised [[ids]] outside fences, in order."""
    outside = F.regexp_replace(text, "(?ms)^\\s*```.*?(?:^\\s*```[^\n]*$|\\z)", "")
    found = F.transform(F.regexp_extract_all(outside, F.lit("\\[\\[([^\\]\\n]+)\\]\\]"), 1), lambda x: sanitize_id(x))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def type_names(text: Column) -> Column:
    """Identifiers of a type expression that start with a letter and are no primitives."""
    found = F.regexp_extract_all(text, F.lit("([\\p{L}_][\\p{L}\\p{N}_]*)"), 1)
    return F.array_distinct(F.filter(found, lambda x: x.rlike("^\\p{L}") & ~F.lower(x).isin(*PRIMITIVES)))
