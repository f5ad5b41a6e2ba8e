"""Import statements of source files, and the files they mean.

Parsing gives each file's import strings; resolution turns a string into an ordered list of candidate paths, joins all candidates with the
inventory of files and of Go folders, and keeps the first that exists. So no task touches a file system to resolve, and the
join is an ordinary shuffle join on path.
"""

from __future__ import annotations

import ast
import os
import posixpath
from collections.abc import Callable, Sequence

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fixed values: endings tried on a TypeScript path without one, in order
ENDINGS = (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")

_C_NOISE = regex.compile(r"""(?P<keep>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|//[^\n]*|/\*.*?\*/""", regex.S)
_TS_FORMS = regex.compile(
    r"""\bimport\s+(?:type\s+)?(?:[\w$*{][^;'"`()]*?\bfrom\s*)?["']([^"'\n]+)["']"""
    r"""|\bexport\s+(?:type\s+)?(?:\*(?:\s*as\s+[\w$]+)?|\{[^}]*\})\s*from\s*["']([^"'\n]+)["']"""
    r"""|\b(?:require|import)\s*\(\s*["']([^"'\n]+)["']\s*[,)]"""
)
_GO_GROUP = regex.compile(r"\bimport\s*\((.*?)\)", regex.S)
_GO_ONE = regex.compile(r"""^\s*import\s+(?:[\w.]+\s+)?["`]([^"`\n]+)["`]""", regex.M)
_GO_SPEC = regex.compile(r"""["`]([^"`\n]+)["`]""")
_RUBY = regex.compile(r"""^\s*require(?:_relative)?\s*\(?\s*(?:'([^'\n]*)'|"([^"\n]*)")""", regex.M)
_PY_LINE = regex.compile(r"^\s*(?:from\s+(\.*[\w.]*)\s+import\b|import\s+([^\n#;]+))", regex.M)


def _clean(found) -> list[str]:
    return sorted({f for f in found if f})


def script_imports(source: str) -> list[str]:
    """TypeScript and JavaScript: static, type-only, re-exporting, require and literal dynamic imports."""
    bare = _C_NOISE.sub(lambda m: m.group("keep") or " ", source)
    return _clean(a or b or c for a, b, c in _TS_FORMS.findall(bare))


def python_imports(source: str) -> list[str]:
    """Modules of import statements; relative ones keep their dots; aliased modules of a plain import and __future__ are left out."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        out = []
        for frm, plain in _PY_LINE.findall(source):
            out += [frm] if frm else [p.strip() for p in plain.split(",") if " as " not in p and regex.fullmatch(r"\s*[\w.]+\s*", p)]
        return _clean(o for o in out if o != "__future__")
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [a.name for a in node.names if a.asname is None]
        elif isinstance(node, ast.ImportFrom):
            out.append("." * node.level + (node.module or ""))
    return _clean(o for o in out if o != "__future__")


def ruby_imports(source: str) -> list[str]:
    """Literal require and require_relative; interpolated ones are left out."""
    lines = "\n".join(x.split(" #")[0] for x in source.split("\n") if not x.lstrip().startswith("#"))
    return _clean(a or (b if "#{" not in b else "") for a, b in _RUBY.findall(lines))


def go_imports(source: str) -> list[str]:
    """Every import path, grouped, named and blank ones included."""
    bare = _C_NOISE.sub(lambda m: m.group("keep") or " ", source)
    grouped = [p for body in _GO_GROUP.findall(bare) for p in _GO_SPEC.findall(body)]
    return _clean([*grouped, *_GO_ONE.findall(bare)])


#: parsers by lower-case ending; callers may pass their own
PARSERS: dict[str, Callable[[str], list[str]]] = {e: script_imports for e in (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")} | {".py": python_imports, ".rb": ruby_imports, ".go": go_imports}


def parse_imports(files: DataFrame, parsers: dict[str, Callable[[str], list[str]]] | None = None, *, by: Sequence[str] = ()) -> DataFrame:
    """by, path, imports (sorted, distinct), error: files(by, path, content), by naming the project where there are several.

    A parser that fails gives an error and no imports, so does a file without content (it couldn't be read); unknown endings give none.
    """
    known = dict(PARSERS if parsers is None else parsers)

    def one(path: str, content: str | None) -> dict:
        if content is None:
            return {"imports": [], "error": "unreadable"}
        try:
            parser = known.get(os.path.splitext(path)[1].lower())
            return {"imports": parser(content) if parser else [], "error": None}
        except Exception as e:  # noqa: BLE001 - a broken file is data
            return {"imports": [], "error": f"{type(e).__name__}: {e}"[:200]}

    kind = T.StructType([T.StructField("imports", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])

    def run(path: pd.Series, content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(p, c) for p, c in zip(path, content)], columns=["imports", "error"])

    parsed = F.pandas_udf(run, kind)
    return files.select(*by, "path", parsed("path", "content").alias("p")).select(*by, "path", "p.imports", "p.error")


def _folded(path: str) -> str:
    return posixpath.normpath(path) if path else ""


def candidates(raw: str, importer: str, aliases: list[dict] | None = None) -> list[tuple[str, str]]:
    """What an import may mean, best first: (path, 'file') or (path, 'folder' for a Go package).

    Aliases go first, but an import that matches one and finds nothing is still tried by the rules of its own form, of
    which exactly one applies: ./ and ../ paths, Python's leading dots, or bare names (Go folder, then Ruby from the root).
    """
    out: list[tuple[str, str]] = []

    def add(base: str, endings: tuple[str, ...]) -> None:
        for e in ("",) if posixpath.splitext(base)[1] else endings:
            out.append((_folded(base) + e, "file"))

    for alias in aliases or ():
        rest = raw[len(alias["prefix"]) :] if alias["wildcard"] and raw.startswith(alias["prefix"]) else "" if raw == alias["pattern"] and not alias["wildcard"] else None
        if rest is not None:
            for target in alias["targets"]:
                add(_folded(posixpath.join(alias["base"], target.replace("*", rest, 1) if alias["wildcard"] else target)), ENDINGS)
    here = posixpath.dirname(importer)
    if raw.startswith(("./", "../")):
        joined = _folded(posixpath.join(here, raw))
        if posixpath.splitext(raw)[1]:
            out.append((joined, "file"))
        else:
            out += [(joined + e, "file") for e in ENDINGS]
    elif raw.startswith("."):
        module = raw.lstrip(".")
        for _ in range(len(raw) - len(module) - 1):
            here = posixpath.dirname(here)
        base = posixpath.join(here, module.replace(".", "/")) if module else here
        if base:
            add(base, (".py",))
    elif not raw.startswith("/") and "://" not in raw and raw:
        out.append((_folded(raw), "folder"))
        if "." not in raw.split("/")[0]:
            add(raw, (".rb",))
    return out


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: list[dict] | None = None, *, by: Sequence[str] = ()) -> DataFrame:
    """by, src, dst: distinct links between existing files (or Go folders) of a project. imports(by, path, imports), files(by, path).

    ``aliases`` come from one project's configuration and are small by nature. What an import may mean is found once for each distinct
    import and folder it stands in, not once a file.
    """
    kind = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("kind", T.StringType())]))

    def run(raw: pd.Series, importer: pd.Series) -> pd.Series:
        return pd.Series([[{"path": p, "kind": k} for p, k in candidates(r, i, aliases)] for r, i in zip(raw, importer)])

    probe = F.pandas_udf(run, kind)
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    rows = imports.select(*by, F.col("path").alias("src"), folder.alias("here"), F.explode("imports").alias("raw"))
    meant = rows.select("here", "raw").distinct().withColumn("c", probe("raw", F.concat("here", F.when(F.col("here") != "", "/").otherwise(""), F.lit("x"))))
    tried = rows.join(meant, ["here", "raw"]).select(*by, "src", "raw", F.posexplode("c").alias("rank", "c")).select(*by, "src", "raw", "rank", F.col("c.path").alias("dst"), F.col("c.kind").alias("kind"))
    inventory = files.select(*by, F.col("path").alias("dst"), F.lit("file").alias("kind")).unionByName(files.where(F.col("path").endswith(".go")).select(*by, folder.alias("dst"), F.lit("folder").alias("kind"))).distinct()
    found = tried.join(inventory, [*by, "dst", "kind"]).groupBy(*by, "src", "raw").agg(F.min_by("dst", "rank").alias("dst"))
    return found.select(*by, "src", "dst").distinct()


def dependency_graph(links: DataFrame, files: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """by, path, imports: every file with its sorted distinct targets, an empty list if it has none."""
    targets = links.groupBy(*by, F.col("src").alias("path")).agg(F.array_sort(F.collect_set("dst")).alias("imports"))
    return files.select(*by, "path").distinct().join(targets, [*by, "path"], "left").withColumn("imports", F.coalesce("imports", F.array().cast("array<string>")))
