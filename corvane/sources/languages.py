"""Languages of file names: a whole-name table before an extension table."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Names that decide alone (null: no language), and the extensions of each language.
FILENAMES = {
    "Dockerfile": None, "Makefile": None, "Justfile": None, "Cargo.toml": "TOML", "pyproject.toml": "TOML", "Pipfile": "TOML", "package.json": "JSON", "tsconfig.json": "JSON", "composer.json": "JSON",
    "docker-compose.yml": "YAML", "docker-compose.yaml": "YAML", ".bashrc": "Shell", ".zshrc": "Shell", ".bash_profile": "Shell", ".profile": "Shell", "Gemfile": "Ruby", "Rakefile": "Ruby", "CMakeLists.txt": "CMake",
    "build.gradle": "Gradle", "settings.gradle": "Gradle", "build.gradle.kts": "Gradle", "settings.gradle.kts": "Gradle",
}
EXTENSIONS_OF = {
    "Rust": "rs", "Python": "py pyi", "TypeScript": "ts tsx mts cts", "JavaScript": "js jsx mjs cjs flow", "Go": "go", "Java": "java", "C": "c h", "C++": "cpp cc cxx hpp hh hxx", "Shell": "sh bash zsh", "TOML": "toml",
    "YAML": "yml yaml", "JSON": "json jsonc", "SQL": "sql", "Markdown": "md markdown", "Protobuf": "proto", "GraphQL": "graphql gql", "Ruby": "rb rake gemspec podspec", "Kotlin": "kt kts", "Swift": "swift", "C#": "cs",
    "Objective-C": "m mm", "XML": "xml plist svg xib storyboard", "HTML": "html htm", "CSS": "css", "Gradle": "gradle", "CMake": "cmake", "Properties": "properties",
}
EXTENSIONS = {ext: language for language, exts in EXTENSIONS_OF.items() for ext in exts.split()}


def detect(path: Column) -> Column:
    """Language of a path, or null; extensions are compared as they are, and a leading dot begins none."""
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.regexp_extract(name, "(?s)^.+[.]([^.]+)\\z", 1)
    names, exts = (F.create_map(*[F.lit(x) for k, v in d.items() for x in (k, v)]) for d in ({k: v for k, v in FILENAMES.items() if v}, EXTENSIONS))
    none = [k for k, v in FILENAMES.items() if v is None]
    return F.when(name.isin(*none), F.lit(None).cast("string")).otherwise(F.coalesce(F.element_at(names, name), F.element_at(exts, ext)))
