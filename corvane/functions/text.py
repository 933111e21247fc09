"""Text functions that built-in expressions can't state: balanced text, excerpts, page files. As Arrow UDFs."""

from __future__ import annotations

import re

import pandas as pd
from corvane.functions.scalars import PRIMITIVES
from pyspark.sql import functions as F, types as T

PAIRS = {"(": ")", "<": ">", "[": "]", "{": "}"}


def split_nested(text: str, mark: str = ",") -> list[str]:
    """Parts between marks outside all of ()<>[]; an arrow's `>` closes nothing."""
    parts, depth, last = [], 0, 0
    for k, c in enumerate(text):
        if c in "(<[":
            depth += 1
        elif c in ")>]" and not (c == ">" and k and text[k - 1] in "-="):
            depth -= 1
        elif c == mark and depth == 0:
            parts.append(text[last:k])
            last = k + 1
    return [p.strip() for p in [*parts, text[last:]] if p.strip()]


def closing(text: str, at: int) -> int:
    """Offset of the bracket that closes the one at `at`, or the text's length."""
    stack = []
    for k in range(at, len(text)):
        c = text[k]
        if c in PAIRS and not (c == "<" and text[at] != "<"):
            stack.append(PAIRS[c])
        elif stack and c == stack[-1] and not (c == ">" and text[k - 1] in "-="):
            stack.pop()
            if not stack:
                return k
    return len(text)


def names_of(expression: str) -> list[str]:
    """Type identifiers of an expression, without primitives."""
    found = re.findall(r"[^\W\d]\w*", re.sub(r"\b(?:dyn|impl|mut|const|struct|unsigned)\b|'\w+", " ", expression))
    return list(dict.fromkeys(x for x in found if x[0] != "_" and x.lower() not in PRIMITIVES))


def signature_types(signature: str, language: str) -> tuple[list[str], list[str]]:
    """Names of parameter types and of return types of a function's signature."""
    if language == "Ruby":
        return [], []
    begin = signature.find("(")
    if language == "Go" and signature.startswith("func (") and begin >= 0:  # the receiver
        begin = signature.find("(", closing(signature, begin) + 1)
    if begin < 0:
        return [], []
    end = closing(signature, begin)
    inner, before, after = split_nested(signature[begin + 1 : end]), signature[:begin], signature[end + 1 :]
    params: list[str] = []
    for p in inner:
        if language in ("Rust", "TypeScript", "JavaScript", "Python", "Kotlin", "Swift"):
            params.append(re.split(r"(?<!:):(?!:)", p, maxsplit=1)[1].split("=")[0] if re.search(r"(?<!:):(?!:)", p) else "")
        elif language == "Go":
            params.append(p.split(None, 1)[1] if " " in p else "")
        else:
            params.append(re.sub(r"\b\w+\s*(?:\[\])?$", "", p.split("=")[0]) if " " in p.strip() else p)
    if language in ("Rust", "Python", "Swift"):
        back = after.split("->", 1)[1].split(" where ")[0] if "->" in after else ""
    elif language in ("TypeScript", "JavaScript", "Kotlin"):
        back = after.split(":", 1)[1].split("=")[0] if after.strip().startswith(":") else ""
    elif language == "Go":
        back = after.split("{")[0]
    else:
        back = re.sub(r"\b(?:public|private|protected|static|final|abstract|virtual|override|async|inline|extern)\b|\w+\s*$", " ", before)
    unique = lambda xs: list(dict.fromkeys(n for x in xs for n in names_of(x)))
    return unique(params), unique([back.rstrip(":")])


@F.pandas_udf(T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in ("params", "returns")]))
def extract_types(signature: pd.Series, language: pd.Series) -> pd.DataFrame:
    found = [signature_types(s or "", x or "") for s, x in zip(signature, language, strict=True)]
    return pd.DataFrame({"params": [f[0] for f in found], "returns": [f[1] for f in found]})


def collapse(source: str, keep: int = 2) -> str:
    """Blocks at brace depth `keep` and below as `{ ... }`; braces in strings and comments count as text."""
    from corvane.parsers.scanner import blank

    code, out, depth, last = blank(source), [], 0, 0
    for k, c in enumerate(code):
        if c == "{":
            depth += 1
            if depth == keep:
                out.append(source[last:k] + "{ ... }")
        elif c == "}":
            if depth == keep:
                last = k + 1
            depth = max(0, depth - 1)
    return "".join(out) + (source[last:] if depth < keep else "")


@F.pandas_udf(T.StringType())
def collapse_bodies(source: pd.Series) -> pd.Series:
    return source.map(lambda s: None if s is None else collapse(s))


def excerpt_of(content: str, query: str, most: int = 150) -> str:
    """Text around the first hit in any case, from its line's start or half the length before it, else the head."""
    at = content.lower().find(query.lower())
    if at < 0:
        head = content[:most]
        return head + ("..." if len(content) > most else "")
    begin = max(content.rfind("\n", 0, at) + 1, at - most // 2)
    end = min(len(content), at + len(query) + most // 2)
    stop = content.find("\n", at, end)
    end = stop if stop > at else end
    return ("..." if begin > 0 and content[begin - 1] != "\n" else "") + content[begin:end].strip() + ("..." if end < len(content) else "")


@F.pandas_udf(T.StringType())
def excerpt(content: pd.Series, query: pd.Series) -> pd.Series:
    return pd.Series([excerpt_of(c or "", q or "") for c, q in zip(content, query, strict=True)])


def parse_page(text: str) -> dict | None:
    """Front matter (scalars and lists of scalars) and content of a page file; None if it is malformed."""
    m = re.match(r"---\n(.*?)\n---\n?(.*)\Z", text, re.S)
    if not m:
        return None
    page: dict = {"source_files": [], "links_to": [], "covers": [], "content": m[2]}
    key = None
    for line in m[1].split("\n"):
        if item := re.match(r"\s*-\s+(.*)", line):
            if key is None:
                return None
            page.setdefault(key, [])
            if isinstance(page[key], list):
                page[key].append(item[1].strip("\"'"))
        elif pair := re.match(r"(\w+):\s*(.*)", line):
            key = pair[1]
            page[key] = [] if pair[2] in ("", "[]") else pair[2].strip("\"'")
        elif line.strip():
            return None
    return page if isinstance(page.get("id"), str) and isinstance(page.get("title"), str) else None


def render_page(page: dict) -> str:
    """The inverse of parse_page."""
    rows = []
    for key, value in page.items():
        if key != "content":
            rows += [f"{key}:" + (" []" if not value else "")] + [f"- {x}" for x in value] if isinstance(value, list) else [f"{key}: {value}"]
    return "---\n" + "\n".join(rows) + "\n---\n" + page.get("content", "")
