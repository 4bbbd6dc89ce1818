"""Path, extension and URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories, extensions and limits of the file scan. (One hidden directory that bears a product name is left out; the scan prunes all hidden ones.)
IGNORE_DIRS = ["node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", ".next", "coverage", ".pytest_cache", "docs", "tests_generated"]
IGNORE_EXTENSIONS = [".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".mp4", ".mp3", ".zip", ".tar", ".gz", ".lock", ".bin", ".exe", ".pyc", ".docx", ".xlsx", ".pdf", ".env", ".db"]
CODE_EXTENSIONS = [".py", ".js", ".mjs", ".cjs", ".ts", ".tsx", ".go", ".rs", ".java", ".rb", ".c", ".cpp", ".cc", ".h", ".hpp", ".cs", ".swift", ".kt", ".scala", ".php"]
MAX_FILE_SIZE_BYTES = 1_000_000
MAX_FILE_TOKENS = 50_000
REPO_HOSTS = ["github.com", "gitlab.com"]
# Which paths count as tests, which are no targets of the dead-code analysis, which are not audited.
TEST_FILE = r"(^|[/\\])(test_|_test\.|tests?[/\\]).*\.(py|js|ts)$"
NOT_ANALYSED = r"(^|[/\\])(test_|_test\.|tests?[/\\]|tests_generated[/\\]|docs[/\\])"
NOT_AUDITED = ["test", "docs", "_refactored", "tests_generated"]


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-case suffix of the file name; a leading dot alone starts none (``.gitignore`` has no suffix)."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^.]+)$", 1))


def module_extension(ext: Column, path: Column) -> Column:
    """The extension on record, lower-case and with its dot, else the suffix of the path."""
    bare = F.nullif(F.lower(F.regexp_replace(F.trim(ext), r"^\.+", "")), F.lit(""))
    return F.coalesce(F.concat(F.lit("."), bare), suffix(path))


def splitext(path: Column) -> Column:
    """Lower-case extension after the last dot of the file name, leading dots not counted."""
    return F.lower(F.regexp_extract(F.regexp_replace(base_name(path), r"^\.+", ""), r"(?s).(\.[^.]*)$", 1))


def after_last_dot(path: Column) -> Column:
    """Text after the last dot anywhere in the path, directories included; empty without a dot."""
    return F.when(F.contains(path, F.lit(".")), F.concat(F.lit("."), F.lower(F.substring_index(path, ".", -1)))).otherwise(F.lit(""))


def ignored_dir(path: Column, extra: list[str] | None = None) -> Column:
    """Whether any directory of the path is pruned by the scan."""
    dirs = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(dirs, lambda s: s.isin(IGNORE_DIRS + (extra or [])) | s.startswith("."))


def is_test_file(path: Column) -> Column:
    return slashes(path).rlike(TEST_FILE)


def is_analysis_target(path: Column) -> Column:
    return ~slashes(path).rlike(NOT_ANALYSED)


def is_audited(path: Column, content: Column) -> Column:
    cond = F.length(F.trim(content)) > 0
    for s in NOT_AUDITED:
        cond = cond & ~F.contains(path, F.lit(s))
    return cond


def import_path(path: Column) -> Column:
    """Dotted module path of a Python file."""
    return F.regexp_replace(F.replace(path, F.lit("/"), F.lit(".")), r"\.py$", "")


def repo_of_url(url: Column) -> Column:
    """struct(clean_url, repo) of a repository URL on a supported host, else null."""
    u = F.trim(url)
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^https?://([^/?#]*)", 1)), r"^www\.", "")
    repo = F.regexp_extract(u, r"^https?://[^/?#]*/([^/?#]+/[^/?#]+?)(?:\.git)?(?:[?#].*)?$", 1)
    return F.when(host.isin(REPO_HOSTS) & (repo != ""), F.struct(F.concat(F.lit("https://"), host, F.lit("/"), repo).alias("clean_url"), repo.alias("repo")))


def redact_url(url: Column) -> Column:
    """Drop user information from every http(s) URL in a text."""
    return F.regexp_replace(url, r"(https?://)([^@/]+@)", "$1")


def url_key(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)
