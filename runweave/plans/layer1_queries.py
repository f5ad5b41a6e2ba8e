"""Queries of import parsing and resolution, over source trees that say what the dependency graphs of the data say.

Each graph is a project. A file's content imports the file's targets in the forms of its language, among comments and strings that only look like
imports; so parsing and resolution must give back what SQL reads off the links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.operators import graph, imports
from runweave.plans.reference_queries import _FILES, _LINKS
from runweave.sources.tables import table

PROJECT = ["result_id"]
ALIASES = [{"pattern": "@/*", "wildcard": True, "prefix": "@/", "targets": ["*"], "base": "."}]
_MODULE = r"^([\p{L}_][\p{L}\p{N}_]*/)+[\p{L}_][\p{L}\p{N}_]*\.py$"

QUERIES: dict = {}
ORACLE: dict = {}


def _form(*forms: str) -> F.Column:
    """One of several ways to write an import, by a checksum of its target; {} stands for the import."""
    which = F.crc32("dst") % len(forms)
    out = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        before, after = f.split("{}", 1)
        out = F.when(which == i, F.concat(F.lit(before), F.col("raw"), F.lit(after))).otherwise(out)
    return out


def _imports_of(links: DataFrame) -> DataFrame:
    """result_id, src, dst, lang, raw: how each link is written, null where the language can't name its target."""
    lang = F.regexp_extract("src", r"\.([a-z]+)$", 1)
    here = F.size(F.split("src", "/")) - 1
    folder = F.regexp_extract("dst", r"^(.*)/[^/]*$", 1)
    module = F.concat(F.repeat(F.lit("."), here + 1), F.replace(F.regexp_replace("dst", r"\.py$", ""), F.lit("/"), F.lit(".")))
    raw = (
        F.when(F.col("lang").isin("ts", "tsx"), F.concat(F.lit("@/"), "dst"))
        .when(F.col("lang") == "rb", F.col("dst"))
        .when(F.col("lang") == "go", F.when(F.col("dst").endswith(".go"), folder).otherwise(F.col("dst")))
        .when((F.col("lang") == "py") & F.col("dst").rlike(_MODULE), module)
    )
    return links.withColumn("lang", lang).withColumn("raw", F.nullif(raw, F.lit("")))


def source_trees(graphs: DataFrame) -> DataFrame:
    """result_id, path, content: the files of each graph as source code."""
    written = _imports_of(graph.links(graphs)).where("raw is not null")
    line = (
        F.when(F.col("lang").isin("ts", "tsx"), _form('import {a as b} from "{}";', "export * from '{}';", 'const q = require("{}");', "const p = import('{}');", 'import type T from "{}";', 'import "{}";'))
        .when(F.col("lang") == "rb", _form("require '{}'", 'require "{}"', "  require('{}')"))
        .when(F.col("lang") == "go", _form('\t"{}"', '\tname "{}"', '\t_ "{}"'))
        .otherwise(_form("from {} import thing", "def f():\n    from {} import thing as other", "from {} import (\n    one,\n    two,\n)"))
    )
    bodies = written.withColumn("line", line).groupBy("result_id", F.col("src").alias("path")).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("body"))
    rows = graph.files(graphs).join(bodies, ["result_id", "path"], "left").withColumn("body", F.coalesce("body", F.lit("")))
    content = (
        F.when(F.col("path").rlike(r"\.tsx?$"), F.concat(F.lit('// import { x } from "@/not/there.ts"\n/* require("@/nor.ts")\n*/\nconst s = "a // b";\n'), "body", F.lit("\nexport const n = 1;\n")))
        .when(F.col("path").endswith(".rb"), F.concat(F.lit('# require "not/there"\nrequire "not/#{there}"\n'), "body", F.lit("\nclass A\nend\n")))
        .when(F.col("path").endswith(".go"), F.concat(F.lit('package p\n\n// import "not/there"\nimport (\n'), "body", F.lit('\n)\n\nvar s = "text"\n')))
        .when(F.col("path").endswith(".py"), F.concat(F.lit('"""from .not_there import x"""\nfrom __future__ import annotations\n# import not_there\n'), "body", F.lit("\nx = 1\n")))
        .otherwise(F.col("body"))
    )
    return rows.select("result_id", "path", content.alias("content"))


def _parsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = source_trees(table(spark, sf_dir, "layer1_results"))
    return imports.parse_imports(files, by=PROJECT), files


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parsed, files = _parsed(spark, sf_dir)
    return imports.resolve_imports(parsed, files, ALIASES, by=PROJECT), files


def parsed_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import strings of every file of every tree."""
    return _parsed(spark, sf_dir)[0].select("result_id", "path", "imports", F.col("error").isNotNull().alias("failed"))


def resolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between files, and from Go files to folders, as resolution finds them: by alias, from the root, by leading dots, by folder."""
    return _resolved(spark, sf_dir)[0]


def rebuilt_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dependency graph of every tree, files without imports included."""
    links, files = _resolved(spark, sf_dir)
    return imports.dependency_graph(links, files, by=PROJECT)


QUERIES |= {"parsed_imports": parsed_imports, "resolved_imports": resolved_imports, "rebuilt_graph": rebuilt_graph}

_WRITTEN = f"""{_LINKS}, {_FILES}, files AS (SELECT DISTINCT result_id, path FROM k),
said AS (SELECT *, CASE WHEN regexp_matches(src, '\\.tsx?$') THEN '@/' || dst WHEN src LIKE '%.rb' THEN dst WHEN src LIKE '%.go' THEN CASE WHEN dst LIKE '%.go' THEN nullif(regexp_extract(dst, '^(.*)/[^/]*$', 1), '') ELSE dst END
  WHEN src LIKE '%.py' AND regexp_matches(dst, '{_MODULE}') THEN repeat('.', len(string_split(src, '/'))) || replace(regexp_replace(dst, '\\.py$', ''), '/', '.') END AS raw FROM links),
found AS (SELECT DISTINCT result_id, src, CASE WHEN src LIKE '%.go' AND dst LIKE '%.go' THEN raw ELSE dst END AS dst FROM said WHERE raw IS NOT NULL
  AND (regexp_matches(src, '\\.(tsx?|py)$') OR (src LIKE '%.go' AND dst LIKE '%.go') OR NOT contains(string_split(dst, '/')[1], '.')))"""

ORACLE |= {
    "parsed_imports": f"""WITH {_WRITTEN} SELECT f.result_id, f.path, list_sort(coalesce(list(DISTINCT raw) FILTER (raw IS NOT NULL), [])) AS imports, false AS failed
FROM files f LEFT JOIN said s ON s.result_id = f.result_id AND s.src = f.path GROUP BY 1, 2""",
    "resolved_imports": f"WITH {_WRITTEN} SELECT result_id, src, dst FROM found",
    "rebuilt_graph": f"""WITH {_WRITTEN} SELECT f.result_id, f.path, list_sort(coalesce(list(DISTINCT dst) FILTER (dst IS NOT NULL), [])) AS imports
FROM files f LEFT JOIN found s ON s.result_id = f.result_id AND s.src = f.path GROUP BY 1, 2""",
}
