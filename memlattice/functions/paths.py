"""What a path says about a file: language, areas, subsystems. Paths are cleaned before (see ``cleaning.clean_path``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Areas of a repository and the paths (in lower case) that belong to them; a test is no source.
AREAS = {
    "app": r"^packages/app/",
    "automation": r"^scripts/",
    "ci": r"^\.github/(workflows|actions)/|(^|/)(\.gitlab-ci|azure-pipelines)\.yml$",
    "docs": r"^docs/|[^/]\.(adoc|md|mdx|rst|txt)$|(^|/)readme(\.[^/]*)?$",
    "package": r"(^|/)(package(-lock)?\.json|(pnpm-lock|pnpm-workspace)\.yaml|(yarn|bun)\.lock)$",
    "source": r"[^/]\.(c|cc|cpp|cs|cts|go|h|hpp|java|js|jsx|kt|mjs|mts|php|py|rb|rs|sh|swift|ts|tsx)$",
    "tests": r"\.(test|spec)\.[^/]*$|/(__tests__|tests?)/",
}
# The first pattern that a path (in lower case) matches names its part of the repository; else it is root.
SUBSYSTEMS = {
    r"^packages/([^/]+)/.*": "$1",
    r"^(?:backend|server|api)/.*": "backend",
    r"^(?:frontend|client|web)/.*": "frontend",
    r"^(scripts|examples|adapters)/.*": "$1",
}
#: Where a repository keeps its memory; what people write there themselves is not generated.
MEMORY_FOLDER, WRITTEN = ".memory", ("automation", "config")
LANGUAGES = {".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".py": "Python", ".rs": "Rust", ".go": "Go", ".md": "Markdown", ".json": "JSON", ".yml": "YAML", ".yaml": "YAML"}


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The last dot of the base name and what follows, in lower case; empty if there is none or it stands first."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1))


def language(path: Column) -> Column:
    """The language by extension, else null."""
    pairs = [F.lit(x) for pair in LANGUAGES.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def _in(area: str, path: Column) -> Column:
    return F.lower(path).rlike(AREAS[area])


def is_test(path: Column) -> Column:
    return _in("tests", path)


def is_source(path: Column) -> Column:
    return _in("source", path) & ~is_test(path)


def is_docs(path: Column) -> Column:
    return _in("docs", path)


def is_memory(path: Column) -> Column:
    return F.lower(path).startswith(MEMORY_FOLDER + "/")


def is_generated_memory(path: Column) -> Column:
    return is_memory(path) & ~F.split_part(F.lower(path), F.lit("/"), F.lit(2)).isin(*WRITTEN)


def areas(path: Column) -> Column:
    """All areas a path belongs to, sorted."""
    found = F.filter(F.array(*(F.when(_in(area, path), area) for area in AREAS)), lambda a: a.isNotNull())
    return F.when(is_test(path), F.array_remove(found, "source")).otherwise(found)


def subsystem(path: Column) -> Column:
    """The part of the repository that a path belongs to by SUBSYSTEMS."""
    low = F.lower(path)
    out = F.lit("root")
    for pattern, name in reversed(SUBSYSTEMS.items()):
        out = F.when(low.rlike(pattern), F.regexp_replace(low, pattern, name)).otherwise(out)
    return out
