"""Structure of source texts by rule tables: one scanner for brace languages, and a few for others.

A language is a list of rules: a pattern with the groups `name` and maybe `vis`, the kind it makes, and
where it holds: at the top, in a container, or both. The scanner blanks strings and comments, follows
brace depth, and opens a container where a rule says so. Python goes through the standard `ast`.
`parse(language, text)` never raises on odd input: what is not recognised is left out.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from corvane.parsers.lines import HTML_ID, HTML_SCRIPT, HTML_SHEET, HTML_TAGS, HTML_TITLE, SHELL_WORDS


@dataclass
class Decl:
    kind: str
    name: str
    signature: str
    line: int
    visibility: str = "Public"
    parent: int | None = None
    doc: str | None = None
    is_test: bool = False
    is_async: bool = False
    is_deprecated: bool = False
    body_lines: int | None = None
    cyclomatic: int | None = None
    max_nesting: int | None = None
    param_count: int | None = None
    rels: list[tuple[str, str]] = field(default_factory=list)


@dataclass(frozen=True)
class Rule:
    pattern: str
    kind: str
    where: str = "any"  # top, in, any
    opens: bool = False
    body: bool = False

    @property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern)


def _r(pattern: str, kind: str, where: str = "any", opens: bool = False, body: bool = False) -> Rule:
    return Rule(pattern, kind, where, opens, body)


NAME = r"(?P<name>[A-Za-z_$][\w$]*)"
JVM = r"(?P<vis>(?:(?:public|private|protected|internal|static|final|abstract|sealed|override|virtual|async|readonly|partial|open|data|inline|suspend|synchronized|default|fileprivate|mutating|lazy|weak|const)\s+)*)"

#: What each language declares.
RULES: dict[str, list[Rule]] = {
    "Rust": [
        _r(rf"(?P<vis>pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+\"\"\s+)*fn\s+{NAME}", "Function", body=True),
        _r(rf"(?P<vis>pub(?:\([^)]*\))?\s+)?struct\s+{NAME}", "Struct", "top", True), _r(rf"(?P<vis>pub(?:\([^)]*\))?\s+)?enum\s+{NAME}", "Enum", "top", True),
        _r(rf"(?P<vis>pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+{NAME}", "Trait", "top", True), _r(r"(?:unsafe\s+)?impl\b(?:<[^{]*?>)?\s*(?P<name>[^{]+?)\s*(?:where\b[^{]*)?(?=\{)", "Impl", "top", True),
        _r(rf"(?P<vis>pub(?:\([^)]*\))?\s+)?const\s+{NAME}\s*:", "Constant", "top"), _r(rf"(?P<vis>pub(?:\([^)]*\))?\s+)?static\s+(?:mut\s+)?{NAME}", "Static", "top"),
        _r(rf"(?P<vis>pub(?:\([^)]*\))?\s+)?type\s+{NAME}", "TypeAlias", "top"), _r(rf"(?P<vis>pub(?:\([^)]*\))?\s+)?mod\s+{NAME}", "Module", "top"),
        _r(rf"(?P<vis>pub(?:\([^)]*\))?\s+)?{NAME}\s*:\s*[^:=]", "Field", "Struct"), _r(rf"{NAME}\s*(?:[,({{=]|$)", "Variant", "Enum"),
    ],
    "Go": [
        _r(rf"func\s*\(\s*\w*\s*\*?(?P<recv>\w+)[^)]*\)\s*{NAME}", "Method", "top", body=True), _r(rf"func\s+{NAME}", "Function", "top", body=True), _r(rf"type\s+{NAME}\s+struct", "Struct", "top", True),
        _r(rf"type\s+{NAME}\s+interface", "Trait", "top", True), _r(rf"type\s+{NAME}\s", "TypeAlias", "top"), _r(rf"const\s+{NAME}", "Constant", "top"), _r(rf"var\s+{NAME}", "Static", "top"),
        _r(rf"{NAME}\s+[\w*\[\]]", "Field", "Struct"), _r(rf"{NAME}\s*\(", "Method", "Trait"),
    ],
    "TypeScript": [
        _r(rf"(?P<vis>export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{NAME}", "Function", "top", body=True), _r(rf"(?P<vis>export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{NAME}", "Struct", "top", True),
        _r(rf"(?P<vis>export\s+)?interface\s+{NAME}", "Trait", "top", True), _r(rf"(?P<vis>export\s+)?type\s+{NAME}\s*[=<]", "TypeAlias", "top"), _r(rf"(?P<vis>export\s+)?(?:const\s+)?enum\s+{NAME}", "Enum", "top", True),
        _r(rf"(?P<vis>export\s+)?const\s+{NAME}", "Constant", "top"), _r(rf"(?P<vis>(?:public|private|protected|static|async|abstract|readonly|get|set)\s+)*{NAME}\s*(?:<[^>]*>)?\s*\(", "Method", "in", body=True),
        _r(rf"(?P<vis>(?:public|private|protected|static|readonly)\s+)*{NAME}[?!]?\s*[:=;]", "Field", "in"), _r(rf"{NAME}\s*(?:[,=]|$)", "Variant", "Enum"),
    ],
    "Java": [
        _r(rf"{JVM}(?:class|record)\s+{NAME}", "Struct", "any", True), _r(rf"{JVM}@?interface\s+{NAME}", "Interface", "any", True), _r(rf"{JVM}enum\s+{NAME}", "Enum", "any", True),
        _r(rf"{JVM}(?:<[^>]+>\s*)?(?:[\w<>\[\],.?]+\s+)?{NAME}\s*\([^;{{]*\)?[^;{{]*(?=[;{{]|$)", "Method", "in", body=True), _r(rf"{JVM}[\w<>\[\],.?]+\s+{NAME}\s*(?:=|;)", "Field", "in"),
    ],
    "C": [
        _r(rf"(?P<vis>static\s+)?(?:inline\s+|const\s+|unsigned\s+|extern\s+)*\w[\w\s*]*?[\s*]{NAME}\s*\([^;{{]*\)\s*(?=[;{{]|$)", "Function", "top", body=True), _r(rf"(?:typedef\s+)?struct\s+{NAME}\s*(?=\{{|$)", "Struct", "top", True),
        _r(rf"(?:typedef\s+)?enum\s+{NAME}\s*(?=\{{|$)", "Enum", "top", True), _r(rf"typedef\s+[^{{;]*?{NAME}\s*;", "TypeAlias", "top"), _r(rf"#\s*define\s+{NAME}", "Constant", "top"),
        _r(rf"(?P<vis>static\s+)?(?:const\s+|unsigned\s+|extern\s+)*\w+[\s*]+{NAME}\s*(?:\[[^\]]*\])?\s*[=;]", "Static", "top"), _r(rf"\w[\w\s*]*[\s*]{NAME}\s*(?:\[[^\]]*\])?;", "Field", "Struct"), _r(rf"{NAME}\s*(?:[,=]|$)", "Variant", "Enum"),
    ],
    "Kotlin": [
        _r(rf"{JVM}enum\s+class\s+{NAME}", "Enum", "any", True), _r(rf"{JVM}class\s+{NAME}", "Class", "any", True), _r(rf"{JVM}(?:companion\s+)?object\s+{NAME}", "Class", "any", True), _r(rf"{JVM}interface\s+{NAME}", "Interface", "any", True),
        _r(rf"{JVM}fun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?{NAME}", "Function"), _r(rf"{JVM}va[lr]\s+{NAME}", "Field"), _r(rf"{JVM}typealias\s+{NAME}", "TypeAlias", "top"),
    ],
    "Swift": [
        _r(rf"{JVM}class\s+(?!func|var){NAME}", "Class", "any", True), _r(rf"{JVM}struct\s+{NAME}", "Struct", "any", True), _r(rf"{JVM}protocol\s+{NAME}", "Interface", "any", True), _r(rf"{JVM}enum\s+{NAME}", "Enum", "any", True),
        _r(r"(?P<vis>)extension\s+(?P<name>[\w.]+)", "Impl", "any", True), _r(rf"{JVM}(?:class\s+)?func\s+{NAME}", "Method"), _r(rf"{JVM}(?:let|var)\s+{NAME}", "Field"), _r(rf"{JVM}typealias\s+{NAME}", "TypeAlias"), _r(rf"case\s+{NAME}", "Variant", "Enum"),
    ],
    "C#": [
        _r(r"(?P<vis>)namespace\s+(?P<name>[\w.]+)", "Namespace", "top", True), _r(rf"{JVM}(?:class|record)\s+{NAME}", "Class", "any", True), _r(rf"{JVM}interface\s+{NAME}", "Interface", "any", True), _r(rf"{JVM}struct\s+{NAME}", "Struct", "any", True),
        _r(rf"{JVM}enum\s+{NAME}", "Enum", "any", True), _r(rf"{JVM}[\w<>\[\],.?]+\s+{NAME}\s*\([^;]*\)", "Method", "in"),
    ],
    "Protobuf": [
        _r(rf"message\s+{NAME}", "Message", "any", True), _r(rf"service\s+{NAME}", "Service", "any", True), _r(rf"enum\s+{NAME}", "Enum", "any", True), _r(rf"rpc\s+{NAME}", "RpcMethod", "in"), _r(r"syntax\s*=\s*(?P<name>)", "ConfigKey", "top"),
        _r(rf"(?:(?:optional|required|repeated)\s+)?(?:map<[^>]*>|[\w.]+)\s+{NAME}\s*=\s*\d+", "Field", "in"), _r(rf"{NAME}\s*=\s*-?\d+", "Variant", "Enum"),
    ],
    "GraphQL": [
        _r(rf"(?:extend\s+)?(?:type|input)\s+{NAME}", "SchemaType", "top", True), _r(rf"interface\s+{NAME}", "Interface", "top", True), _r(rf"enum\s+{NAME}", "Enum", "top", True), _r(r"(?P<name>schema)\b", "ConfigKey", "top", True),
        _r(rf"(?:query|mutation|subscription)\s+{NAME}", "Function", "top"), _r(rf"{NAME}\s*(?:\([^)]*\))?\s*:", "Field", "in"), _r(rf"{NAME}\s*$", "Variant", "Enum"),
    ],
    "CSS": [_r(r"(?P<name>--[\w-]+)\s*:", "Constant"), _r(r"(?P<name>@[\w-]+[^{;]*)", "ConfigKey", "top", True), _r(r"(?P<name>[^{}@;]+?)\s*\{", "Class", "top", True)],
    "Gradle": [_r(r"task\s+(?P<name>\w+)", "Function"), _r(r"tasks\.register\(\s*(?P<name>)", "Function"), _r(rf"(?:def|va[lr])\s+{NAME}", "Constant", "top"), _r(r"id[\s(]+(?P<name>)", "ConfigKey", "in"), _r(r"(?P<name>\w+)\s*\{", "ConfigKey", "top", True)],
    "Objective-C": [
        _r(r"@(?:interface|implementation)\s+(?P<name>\w+)", "Class", "top", True), _r(r"@protocol\s+(?P<name>\w+)", "Interface", "top", True), _r(r"[-+]\s*\([^)]*\)\s*(?P<name>\w+)", "Method", "in"), _r(r"@property\s*(?:\([^)]*\))?.*?(?P<name>\w+)\s*;", "Field", "in"),
    ],
}
RULES["JavaScript"] = RULES["TypeScript"]
RULES["C++"] = [
    _r(rf"namespace\s+{NAME}", "Module", "any", True), _r(rf"(?:template\s*<[^>]*>\s*)?class\s+{NAME}[^;{{]*(?=\{{|$)", "Struct", "any", True),
    _r(rf"(?P<vis>)(?:virtual\s+|static\s+|inline\s+|explicit\s+|const\s+)*(?:[\w:<>*&]+\s+)*[*&]?~?{NAME}\s*\([^;{{]*\)[^;{{]*(?=[;{{]|$)", "Method", "in", body=True), *RULES["C"],
]
#: Import lines of each language; the first group is the text.
IMPORTS = {
    "Rust": r"(?:pub\s+)?use\s+([^;]+);", "Go": r"import\s+(.+)", "TypeScript": r"import\s+(.+?);?$", "JavaScript": r"import\s+(.+?);?$", "Java": r"import\s+(.+?);", "C": r"#\s*include\s+(\S+)", "C++": r"#\s*include\s+(\S+)",
    "Kotlin": r"(?:import|package)\s+(.+)", "Swift": r"import\s+(.+)", "C#": r"using\s+([^=(]+?);", "Protobuf": r"(?:import|package)\s+(?:public\s+)?\"?([^\";]+)\"?;", "GraphQL": r"#\s*import\s+(.+)", "CSS": r"@import\s+(.+?);",
    "Gradle": r"import\s+(.+)", "Objective-C": r"(?:#import|#include|@import)\s+(.+?);?$", "Ruby": r"(?:require(?:_relative)?|load|gem|include|extend)\s+['\"]?([\w/:.-]+)",
}
BRANCH = re.compile(r"\b(?:if|for|while|case|catch|loop|foreach|when)\b|&&|\|\||\?\?|=>(?=)")
NEST = re.compile(r"\b(?:if|for|while|switch|match|loop|try|select|do)\b")
HASHED = {"Ruby", "YAML", "TOML", "GraphQL", "Shell"}


def blank(text: str, hashed: bool = False) -> str:
    """The text with the contents of strings and comments as spaces; lines stay."""
    out, k, n = list(text), 0, len(text)

    def wipe(a: int, b: int) -> None:
        for i in range(a, min(b, n)):
            if out[i] != "\n":
                out[i] = " "

    while k < n:
        c = text[k]
        if text.startswith("//", k) and not hashed or hashed and c == "#":
            end = text.find("\n", k)
            end = n if end < 0 else end
            wipe(k, end)
            k = end
        elif text.startswith("/*", k):
            end = text.find("*/", k + 2)
            end = n if end < 0 else end + 2
            wipe(k, end)
            k = end
        elif c in "\"'`":
            stop = k + 1
            while stop < n and text[stop] != c and not (text[stop] == "\n" and c != "`"):
                stop += 2 if text[stop] == "\\" else 1
            if c == "'" and stop < n and text[stop] == "\n":  # a lifetime or an apostrophe
                k += 1
                continue
            wipe(k + 1, stop)
            k = stop + 1
        else:
            k += 1
    return "".join(out)


def _visibility(language: str, mark: str | None, name: str, kind: str) -> str:
    mark = (mark or "").strip()
    if language == "Rust":
        return "Private" if not mark or kind == "Impl" else "PublicCrate" if "crate" in mark else "Public"
    if language == "Go":
        return "Public" if name.rpartition(".")[2][:1].isupper() else "Private"
    if language in ("TypeScript", "JavaScript"):
        if kind in ("Method", "Field", "Variant"):
            return "Private" if re.search("private|protected", mark) else "Public"
        return "Public" if "export" in mark else "Private"
    if language in ("C", "C++"):
        return "Private" if "static" in mark else "Public"
    if language == "Java":
        return "Public" if "public" in mark else "Private"
    if language == "C#":
        return "Public" if "public" in mark else "PublicCrate" if re.search("internal|protected", mark) else "Private"
    return "Private" if re.search("private|fileprivate", mark) else "PublicCrate" if re.search("internal|protected", mark) else "Public"


def _close(code: str, at: int) -> int:
    """Offset of the brace that closes the one at `at`."""
    depth = 0
    for m in re.compile("[{}]").finditer(code, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return len(code)


def _parameters(code: str, at: int) -> int:
    """Parameters between the parentheses that open at or after `at`."""
    begin = code.find("(", at)
    if begin < 0:
        return 0
    depth, parts, seen = 0, 0, False
    for c in code[begin:]:
        if c in "([{<":
            depth += 1
        elif c in ")]}>":
            depth -= 1
            if not depth:
                break
        elif depth == 1 and c == ",":
            parts, seen = parts + seen, False
        elif depth >= 1 and not c.isspace():
            seen = True
    return parts + seen


#: branches that some languages have besides: arms of a match, and conditional expressions (no `?.`, `??`, `x?: T` or `<? extends T>`)
ARMS = re.compile(r"=>")
TERNARY = re.compile(r"(?<!\?)\?(?![?.:,)\];=>])(?!\s*(?:extends|super)\b)")
BRANCHES_OF = {"Rust": ARMS} | dict.fromkeys(("TypeScript", "JavaScript", "Java", "C", "C++"), TERNARY)


def _complexity(code: str, language: str = "") -> tuple[int, int]:
    """Branches plus one, and the depth of nested control blocks; `else if` adds no depth."""
    depth, deepest, stack, pending = 0, 0, [], False
    for m in re.finditer(r"\belse\s+if\b|" + NEST.pattern + r"|[{};]", code):
        if m[0] == "{":
            stack.append(pending)
            depth += pending
            deepest, pending = max(deepest, depth), False
        elif m[0] == "}":
            if stack:
                depth -= stack.pop()
        elif m[0] == ";":
            pending = False
        else:
            pending = True
    more = len(BRANCHES_OF[language].findall(code)) if language in BRANCHES_OF else 0
    return 1 + more + len(re.findall(r"\b(?:if|for|while|case|catch|loop)\b|&&|\|\||\?\?", code)), deepest


def braces(language: str, text: str) -> tuple[list[str], list[Decl]]:
    """Imports and declarations of a brace language by its rules."""
    code = blank(text, language in HASHED)
    raw_lines, code_lines = text.split("\n"), code.split("\n")
    rules = [(r, re.compile(r"\s*" + r.pattern)) for r in RULES[language]]
    imports, decls, stack, depth, offset, skip, note = [], [], [], 0, 0, -1, []
    wanted = re.compile(r"\s*" + IMPORTS[language]) if language in IMPORTS else None
    group = False
    for number, (raw, line) in enumerate(zip(raw_lines, code_lines, strict=True), 1):
        begin = offset
        offset += len(line) + 1
        stripped = raw.strip()
        if language == "Go" and (group or re.match(r"\s*import\s*\($", line)):
            if group and stripped.startswith(")"):
                group = False
            elif group and stripped:
                imports.append(stripped)
            else:
                group = True
            continue
        if wanted and depth <= (1 if language == "C#" else 0) and (m := wanted.match(raw)):
            imports.append(m[1].strip())
            continue
        if stripped.startswith(("///", "//", "/*", "*", "@", "#[", "[[")):
            note.append(stripped)
            if not stripped.startswith("@") or language not in ("Objective-C", "CSS", "Java"):
                continue
        inside = decls[stack[-1][0]].kind if stack else None
        level = stack[-1][1] + 1 if stack else 0
        if begin > skip and depth == level and line.strip():
            for rule, regex in rules:
                m = regex.match(line)
                if not m or rule.where == "top" and stack or rule.where == "in" and not stack or rule.where not in ("top", "in", "any") and rule.where != inside:
                    continue
                groups = m.groupdict()
                name = groups["name"].strip()
                if not name and (quoted := re.search("[\"']([^\"']+)[\"']", raw)):
                    name = "syntax" if rule.pattern.startswith("syntax") else quoted[1]
                if not name or name in ("if", "for", "while", "switch", "return", "else", "catch", "new", "constructor") and name != "constructor":
                    continue
                if groups.get("recv"):
                    name = f"{groups['recv']}.{name}"
                kind = "Method" if rule.kind == "Function" and stack and language in ("Rust", "Kotlin", "C++") else rule.kind
                head_end = min((x for x in (code.find("{", begin + m.start("name")), code.find(";", begin + m.start("name"))) if x >= 0), default=len(code))
                if kind in ("Field", "Variant", "Constant", "Static", "ConfigKey") or language in ("CSS", "Gradle", "Protobuf", "GraphQL"):
                    head_end = min(head_end, begin + len(line))
                signature = " ".join(text[begin:head_end].split()).rstrip(",")
                d = Decl(kind, name, signature, number, _visibility(language, groups.get("vis"), name, kind), stack[-1][0] if stack else None)
                doc = [re.sub(r"^(?:///?|/\*\*?|\*/?)\s?|\*/$", "", x).strip() for x in note if x.startswith(("///", "/**", "*", "//") if language != "Rust" else ("///", "/**", "*"))]
                d.doc = "\n".join(x for x in doc if x) or None
                notes = " ".join(note)
                d.is_test = "test" in " ".join(x for x in note if x.startswith("#[")) or "Test" in " ".join(x for x in note if x.startswith("@")) or language == "Go" and name.startswith("Test")
                d.is_deprecated = "eprecated" in notes
                d.is_async = bool(re.search(r"\basync\b|\bsuspend\b", signature))
                if language == "Rust" and kind == "Impl" and (t := re.match(r"(.+?)\s+for\s+", name)):
                    d.rels.append(("Implements", t[1]))
                for word, rel in (("extends", "Extends"), ("implements", "Implements")):
                    if t := re.search(rf"\b{word}\s+([\w$., <>]+?)(?=\bimplements\b|\bextends\b|$)", signature):
                        d.rels += [(rel, re.sub("<.*", "", x).strip()) for x in t[1].split(",") if x.strip()]
                opened = head_end < len(code) and code[head_end : head_end + 1] == "{"
                if rule.body and opened:
                    end = _close(code, head_end)
                    d.body_lines = code.count("\n", begin, end)
                    d.cyclomatic, d.max_nesting = _complexity(code[head_end + 1 : end], language)
                    d.param_count = _parameters(code, begin + m.start("name"))
                    skip = end
                decls.append(d)
                if rule.opens and (opened or language == "Objective-C") and (code.find("}", head_end, begin + len(line)) < 0 or language == "Objective-C"):
                    stack.append((len(decls) - 1, depth))
                break
        note = [] if stripped else note
        depth = max(0, depth + line.count("{") - line.count("}"))
        if language == "Objective-C":
            if stripped.startswith("@end"):
                stack.clear()
            depth = len(stack)
        while stack and depth <= stack[-1][1] and "}" in line:
            stack.pop()
    return imports, decls


def python(text: str) -> tuple[list[str], list[Decl]]:
    """Functions, classes with methods, and assignments at module level."""
    tree = ast.parse(text)
    rows, imports, decls = text.split("\n"), [], []

    def measure(node: ast.AST) -> tuple[int, int]:
        count, deepest = 1, 0
        branches = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)
        nests = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match)
        work = [(c, 0) for c in ast.iter_child_nodes(node)]
        while work:
            x, depth = work.pop()
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):
                continue
            count += isinstance(x, branches) + (len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0)
            below = depth + isinstance(x, nests)
            deepest = max(deepest, below)
            for c in ast.iter_child_nodes(x):
                elif_ = isinstance(x, ast.If) and c in x.orelse and isinstance(c, ast.If)
                work.append((c, depth if elif_ else below))
        return count, deepest

    def add(node, parent: int | None) -> None:
        if isinstance(node, (ast.Import, ast.ImportFrom)) and parent is None:
            imports.append(ast.get_source_segment(text, node) or "")
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            is_class = isinstance(node, ast.ClassDef)
            head = " ".join(" ".join(rows[node.lineno - 1 : node.body[0].lineno]).split())
            marks = [ast.unparse(x) for x in node.decorator_list]
            signature = " ".join([*(f"@{x}" for x in marks), re.split(r":\s*(?:$|[\"#])|:\s+\S*$", head, maxsplit=1)[0].rstrip(":")])
            first = node.decorator_list[0].lineno if node.decorator_list else node.lineno
            d = Decl("Struct" if is_class else "Function" if parent is None else "Method", node.name, signature, first, "Private" if node.name.startswith("_") else "Public", parent, ast.get_docstring(node))
            d.is_test = node.name.startswith("Test" if is_class else "test_")
            d.is_deprecated = any("deprecated" in x for x in marks)
            d.body_lines = (node.end_lineno or node.lineno) - first
            if is_class:
                d.rels = [("Extends", ast.unparse(b)) for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))]
            else:
                d.is_async = isinstance(node, ast.AsyncFunctionDef)
                d.cyclomatic, d.max_nesting = measure(node)
                a = node.args
                d.param_count = sum(x.arg not in ("self", "cls") for x in [*a.posonlyargs, *a.args, *a.kwonlyargs]) + bool(a.vararg) + bool(a.kwarg)
            decls.append(d)
            if is_class and parent is None:
                me = len(decls) - 1
                for c in node.body:
                    if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        add(c, me)
        elif isinstance(node, ast.Assign) and parent is None and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            decls.append(Decl("Constant", node.targets[0].id, rows[node.lineno - 1].strip(), node.lineno, "Private" if node.targets[0].id.startswith("_") else "Public"))

    for node in tree.body:
        add(node, None)
    return imports, decls


def indented(text: str) -> tuple[list[str], list[Decl]]:
    """Ruby: modules, classes, methods, constants and attributes; the outermost container holds them."""
    imports, decls, stack = [], [], []
    for number, raw in enumerate(blank(text, True).split("\n"), 1):
        line, indent, source = raw.strip(), len(raw) - len(raw.lstrip()), text.split("\n")[number - 1].strip()
        if m := re.match(IMPORTS["Ruby"], source):
            imports.append(m[1])
        elif m := re.match(r"(?:(module|class)\s+([A-Z][\w:]*)|def\s+((?:self\.)?[\w?!=]+)|([A-Z][A-Z0-9_]*)\s*=|attr_(?:reader|writer|accessor)\s+:(\w+))", line):
            kind = {"module": "Module", "class": "Class"}.get(m[1]) or ("Method" if m[3] else "Constant" if m[4] else "Field")
            name = m[2] or m[3] or m[4] or m[5]
            decls.append(Decl(kind, name, source, number, "Private" if name.startswith("_") else "Public", stack[0][0] if stack else None))
            if m[1] and not stack:
                stack.append((len(decls) - 1, indent))
        elif line == "end" and stack and indent <= stack[-1][1]:
            stack.pop()
    return imports, decls


def keyed(language: str, text: str) -> tuple[list[str], list[Decl]]:
    """YAML and JSON keys of the first two levels."""
    imports, decls = [], []
    if language == "JSON":
        tree = json.loads(text)
        at = lambda k, start=0: text.count("\n", 0, max(0, text.find(json.dumps(k, ensure_ascii=False), start))) + 1
        for k, v in tree.items() if isinstance(tree, dict) else ():
            decls.append(Decl("ConfigKey", k, f"{k}: {type(v).__name__}", at(k)))
            if isinstance(v, dict):
                me = len(decls) - 1
                decls += [Decl("ConfigKey", c, f"{c}: {x if isinstance(x, str) else type(x).__name__}"[:80], at(c, text.find(json.dumps(k))), "Private", me) for c, x in v.items()]
                if k.lower().endswith("dependencies"):
                    imports += list(v)
        return imports, decls
    top = None
    for number, line in enumerate(text.split("\n"), 1):
        if m := re.match(r"(\s*)([A-Za-z0-9_.\"'-]+)\s*:(?:\s|$)", line):
            if not m[1]:
                decls.append(Decl("ConfigKey", m[2].strip("\"'"), line.strip(), number))
                top = len(decls) - 1
            elif top is not None and decls[top].name == "services" and len(m[1]) <= 4:
                decls.append(Decl("ConfigKey", m[2], line.strip(), number, "Private", top))
    return imports, decls


def xml(text: str) -> tuple[list[str], list[Decl]]:
    """Distinct elements at depth 0 and 1."""
    decls, depth, seen, root = [], 0, set(), None
    bare = re.sub(r"<!--.*?-->|<\?.*?\?>|<!\[CDATA\[.*?\]\]>|<![^>]*>", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    for m in re.finditer(r"<(/?)([A-Za-z_][\w:.-]*)[^>]*?(/?)>", bare, re.S):
        if m[1]:
            depth -= 1
            continue
        if depth <= 1 and (depth, m[2]) not in seen:
            seen.add((depth, m[2]))
            decls.append(Decl("ConfigKey", m[2], f"<{m[2]}>", bare.count("\n", 0, m.start()) + 1, "Public", root if depth else None))
            root = len(decls) - 1 if not depth else root
        depth += not m[3]
    return [], decls


def sql(text: str) -> tuple[list[str], list[Decl]]:
    """Tables, views, indexes, functions and types, with the typed columns of tables."""
    decls, table = [], None
    kinds = {"TABLE": "TableDef", "VIEW": "TableDef", "INDEX": "ConfigKey", "FUNCTION": "Function", "PROCEDURE": "Function", "TYPE": "SchemaType"}
    for number, line in enumerate(re.sub(r"--[^\n]*", "", text).split("\n"), 1):
        if m := re.match(r"\s*CREATE\s+(?:OR\s+REPLACE\s+|UNIQUE\s+|TEMP(?:ORARY)?\s+|MATERIALIZED\s+)*(TABLE|VIEW|INDEX|FUNCTION|PROCEDURE|TYPE)\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.\"`]+)", line, re.I):
            decls.append(Decl(kinds[m[1].upper()], m[2].strip("\"`"), " ".join(line.split()).rstrip("( "), number))
            table = len(decls) - 1 if m[1].upper() == "TABLE" and ";" not in line else None
        elif table is not None:
            if re.match(r"\s*\)", line):
                table = None
            elif (m := re.match(r"\s*[\"`]?(\w+)[\"`]?\s+([A-Za-z]+(?:\s*\([^)]*\))?)", line)) and m[1].upper() not in ("PRIMARY", "FOREIGN", "UNIQUE", "CONSTRAINT", "CHECK", "KEY", "INDEX", "CREATE"):
                decls.append(Decl("Field", m[1], f"{m[1]} {m[2]}", number, "Public", table))
    return [], decls


#: What a trimmed line declares, by language: pattern, kind, signature over the groups. The first that fits counts.
LINE_RULES: dict[str, list[tuple[str, str, str]]] = {
    "Shell": [
        (r"function\s+([A-Za-z_]\w*)\s*\(\s*\)", "ShellFunction", "function {0}()"),
        (r"function\s+([A-Za-z_]\w*)(?:\s*\{|\s*$)", "ShellFunction", "function {0}"),
        (r"([A-Za-z_]\w*)\s*\(\s*\)", "ShellFunction", "{0}()"),
        (r"export\s+([A-Za-z_]\w*)=(.*)", "Constant", "export {0}={1}"),
        (r"alias\s+([A-Za-z_][\w-]*)=", "Constant", "alias {0}"),
    ],
    "CMake": [
        (r"(?i:project)\s*\(\s*(\w+)", "Module", "project({0})"),
        (r"(?i:add_executable)\s*\(\s*(\w+)", "Function", "add_executable({0})"),
        (r"(?i:add_library)\s*\(\s*(\w+)", "Module", "add_library({0})"),
        (r"(?i:function)\s*\(\s*(\w+)", "Function", "function({0})"),
        (r"(?i:macro)\s*\(\s*(\w+)", "Macro", "macro({0})"),
        (r'(?i:option)\s*\(\s*(\w+)\s+"([^"]*)', "ConfigKey", 'option({0} "{1}")'),
        (r"(?i:set)\s*\(\s*([A-Z]\w*)", "Constant", "set({0})"),
    ],
}
#: What a trimmed line imports, in place of a declaration.
LINE_IMPORTS = {"Shell": [r"(?:source\s+|\.\s+)(.+)$"], "CMake": [r"(?i:find_package)\s*\(\s*(\w+)", r"(?i:add_subdirectory)\s*\(\s*([^\s)]+)"]}
#: Bytes of a value that a signature shows.
SHOWN = {"Shell": 60, "CMake": 50, "Properties": 50, "HTML": 60}


def shown(value: str, most: int) -> str:
    return value[:most] + "..." if len(value.encode()) > most else value


def numbered(text: str) -> Iterator[tuple[int, str]]:
    """Lines from 1, trimmed; a last line feed adds none."""
    return ((k, line.strip()) for k, line in enumerate(text.removesuffix("\n").split("\n"), 1))


def line_rules(language: str, text: str) -> tuple[list[str], list[Decl]]:
    """Shell and CMake: one declaration or import a line."""
    imports, decls = [], []
    for number, line in numbered(text):
        if line.startswith("#"):
            continue
        if m := next(filter(None, (re.match(p, line) for p in LINE_IMPORTS[language])), None):
            imports.append(m[1].strip().strip('"').strip("'"))
            continue
        for pattern, kind, signature in LINE_RULES[language]:
            if m := re.match(pattern, line):
                if not (language == "Shell" and kind == "ShellFunction" and m[1] in SHELL_WORDS and not line.startswith("function")):
                    decls.append(Decl(kind, m[1], signature.format(m[1], *(shown(v, SHOWN[language]) for v in m.groups()[1:])), number))
                break
    return imports, decls


def html(text: str) -> tuple[list[str], list[Decl]]:
    """The first structural tag of each line with an id on that line, titles, style sheets and scripts."""
    imports, decls = [], []
    for number, line in numbered(text):
        if m := re.search(rf"<({HTML_TAGS})[\s>]", line):
            ident = re.search(HTML_ID, line)
            name = f"{m[1]}#{ident[1]}" if ident else m[1]
            decls.append(Decl("ConfigKey", name, f"<{name}>", number))
        if m := re.search(HTML_TITLE, line):
            decls.append(Decl("ConfigKey", "title", f"title: {shown(m[1], SHOWN['HTML'])}", number))
        imports += [m[1] for p in (HTML_SHEET, HTML_SCRIPT) if (m := re.search(p, line))]
    return imports, decls


def headings(text: str) -> tuple[list[str], list[Decl]]:
    """Markdown headings under the nearest heading above of a smaller level."""
    decls: list[Decl] = []
    open_at: list[tuple[int, int]] = []
    for number, line in enumerate(text.removesuffix("\n").split("\n"), 1):
        if m := re.match(r"(#{1,6})\s+(.+)$", line.removesuffix("\r")):
            level, name = len(m[1]), m[2].strip()
            open_at = [x for x in open_at if x[0] < level]
            decls.append(Decl("Heading", name, f"{m[1]} {name}", number, parent=open_at[-1][1] if open_at else None))
            open_at.append((level, len(decls) - 1))
    return [], decls


def toml(text: str, path: str) -> tuple[list[str], list[Decl]]:
    """Sections and their keys; the keys of a Cargo manifest's dependency sections are imports too."""
    imports, decls, section, wanted = [], [], None, False
    manifest = path.rpartition("/")[2] == "Cargo.toml"
    for number, line in numbered(text):
        if m := re.match(r"\[\[([^\]]+)\]\]", line) or re.match(r"\[([^\]]+)\]", line):
            wanted = manifest and not line.startswith("[[") and re.match(r"(?:dev-|build-)?dependencies(?:\.|$)", m[1]) is not None
            section = len(decls)
            decls.append(Decl("ConfigKey", m[1], m[0], number))
        elif m := re.match(r"([A-Za-z_][A-Za-z0-9_-]*)\s*=", line):
            imports += [m[1]] * wanted
            decls.append(Decl("ConfigKey", m[1], line, number, "Private", section))
    return imports, decls


def properties(text: str) -> tuple[list[str], list[Decl]]:
    """Keys; those with a dot stand under a group of their first part, made where that is first met."""
    decls: list[Decl] = []
    groups: dict[str, int] = {}
    for number, line in numbered(text):
        if m := re.match(r"([A-Za-z_][\w.-]*)\s*[=:](.*)$", line):
            group, dot, _ = m[1].partition(".")
            if dot and group not in groups:
                groups[group] = len(decls)
                decls.append(Decl("ConfigKey", group, f"{group}.*", number))
            signature = f"{m[1]} = {shown(m[2].strip(), SHOWN['Properties'])}"
            decls.append(Decl("ConfigKey", m[1], signature, number, "Private" if dot else "Public", groups[group] if dot else None))
    return [], decls


def parse(language: str, text: str, path: str = "") -> tuple[list[str], list[Decl]]:
    """Imports and declarations; nothing where the language or the text is not understood."""
    try:
        if language == "Python":
            return python(text)
        if language == "Ruby":
            return indented(text)
        if language in ("YAML", "JSON"):
            return keyed(language, text)
        if language == "XML":
            return xml(text)
        if language == "SQL":
            return sql(text)
        if language in LINE_RULES:
            return line_rules(language, text)
        if language == "HTML":
            return html(text)
        if language == "Markdown":
            return headings(text)
        if language == "TOML":
            return toml(text, path)
        if language == "Properties":
            return properties(text)
        return braces(language, text) if language in RULES else ([], [])
    except (SyntaxError, ValueError, RecursionError):
        return [], []
