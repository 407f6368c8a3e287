"""Which paths of a corpus are read, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import slashes

MOST_BYTES = 400_000

# Folders that are never walked.
EXCLUDED_FOLDERS = (
    "bin", "obj", ".git", ".vs", ".idea", ".vscode", "node_modules", "packages", "TestResults", "coverage", "dist", "build", "out", ".next", ".nuxt",
    ".angular", ".venv", "venv", "__pycache__", ".pytest_cache", ".terraform", "artifacts",
)
# Folders whose uncommitted files are never read.
DIRTY_EXCLUDED_FOLDERS = (".git", "bin", "obj", "node_modules", "packages", "dist", "build", "out", "artifacts", "TestResults", "coverage")
# Ends of names of machine-written files.
EXCLUDED_ENDS = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", ".min.js", ".min.css", ".designer.cs", ".g.cs", ".g.i.cs", "assemblyinfo.cs", ".generated.cs")
# Extensions that the syntactic chunker takes, and those that the line windows take.
SYNTAX_EXTENSIONS = (".cs", ".csx")
WINDOW_EXTENSIONS = (
    ".ts", ".tsx", ".js", ".jsx", ".vue", ".svelte", ".py", ".go", ".java", ".kt", ".rs", ".rb", ".php", ".c", ".h", ".cpp", ".hpp", ".cc", ".ino",
    ".sql", ".graphql", ".proto", ".xaml", ".xml", ".razor", ".cshtml", ".html", ".htm", ".css", ".scss", ".less", ".md", ".mdx", ".txt", ".adoc",
    ".yml", ".yaml", ".toml", ".ini", ".conf", ".ps1", ".psm1", ".sh", ".bash", ".tf", ".bicep", ".csproj", ".props", ".targets", ".fsproj", ".vbproj", ".json",
)
# Extensions and parts of names of files that may hold secrets.
SECRET_EXTENSIONS = (".key", ".pem", ".pfx", ".p12", ".cer", ".crt", ".kdbx")
SECRET_PARTS = (".env", "credential", "credentials", "secret", "token", "private-key", "private_key")


def segments(path: Column) -> Column:
    return F.filter(F.split(slashes(path), "/"), lambda s: s != "")


def file_name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(segments(path), F.lit(-1)), F.lit(""))


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; empty if the name has none."""
    return F.lower(F.regexp_extract(file_name(path), r"\.[^.]+$", 0))


def in_folders(path: Column, names: tuple[str, ...], whole: bool = False) -> Column:
    """Is one of the path's folders (``whole``: of all its segments) among ``names``, whatever their case."""
    own = segments(path)
    folders = own if whole else F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0)))
    return F.exists(folders, lambda s: F.lower(s).isin(*[n.lower() for n in names]))


def chunker(path: Column) -> Column:
    """``syntax`` or ``window``; null if the file isn't indexed."""
    name = F.lower(file_name(path))
    ends = F.lit(False)
    for end in EXCLUDED_ENDS:
        ends = ends | name.endswith(end)
    return F.when(ends, None).when(extension(path).isin(*SYNTAX_EXTENSIONS), "syntax").when(extension(path).isin(*WINDOW_EXTENSIONS), "window")


def walked(path: Column) -> Column:
    """No folder on the way is excluded, nor a folder of worktrees."""
    return ~in_folders(path, EXCLUDED_FOLDERS) & ~F.lower(F.concat(F.lit("/"), slashes(path))).contains("/.claude/worktrees/")


def dirty_allowed(path: Column, ignored: Column) -> Column:
    """May an uncommitted file be read: not ignored, no excluded segment, no secret by its name, indexable."""
    name = F.lower(file_name(path))
    secret = extension(path).isin(*SECRET_EXTENSIONS)
    for part in SECRET_PARTS:
        secret = secret | name.contains(part)
    return ~ignored & ~in_folders(path, DIRTY_EXCLUDED_FOLDERS, whole=True) & ~secret & chunker(path).isNotNull()


def escapes(path: Column) -> Column:
    """Does a relative path leave its root, or is it rooted."""
    step = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))
    moved = lambda s: F.when(s == "..", -1).when(s == ".", 0).otherwise(1)
    walk = F.aggregate(segments(path), step, lambda a, s: F.struct((a["depth"] + moved(s)).alias("depth"), F.least(a["least"], a["depth"] + moved(s)).alias("least")))
    return slashes(path).startswith("/") | path.rlike(r"^[A-Za-z]:") | (walk["least"] < 0)


def resolved(path: Column) -> Column:
    """The segments of a confined relative path, without ``.`` and with each ``..`` taking back one."""
    step = lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(s == ".", a).otherwise(F.concat(a, F.array(s)))
    return F.aggregate(segments(path), F.array().cast("array<string>"), step)
