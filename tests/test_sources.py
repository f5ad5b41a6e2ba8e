import datetime as dt
import json

import pytest

from runweave.operators import imports
from runweave.sources import config, run_log
from runweave.sources.run_log import RUN


def write(root, **files):
    for name, text in files.items():
        path = root / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_run_log_tolerates_broken_lines(spark, tmp_path):
    good = {"id": "1", "repo_id": "r", "pr_number": 3, "sha": "s", "predicted_skip": [], "actual_failures": ["a"], "all_tests": ["a"], "mode": "shadow", "created_at": "2024-01-07T10:00:00.123Z"}
    (tmp_path / "log.jsonl").write_text("\n".join([json.dumps(good), "{broken", "", "   ", json.dumps(good | {"id": "2", "created_at": "never"})]))
    got = {r["id"]: r for r in run_log.read_run_log(spark, f"file://{tmp_path}/log.jsonl").collect()}
    assert set(got) == {"1", "2"} and got["2"]["created_at"] is None and got["1"]["created_at"].microsecond == 123000
    assert run_log.read_run_log(spark, f"file://{tmp_path}/none.jsonl").count() == 0
    (tmp_path / "empty.jsonl").write_text("")
    assert run_log.read_run_log(spark, f"file://{tmp_path}/empty.jsonl").count() == 0


def test_append_reads_back(spark, tmp_path):
    row = ("1", "r", 3, "s", ["x"], [], ["x", "y"], "shadow", 0.5, dt.datetime(2024, 1, 7, 1, 2, 3, 4000))
    df = spark.createDataFrame([row], RUN)
    for _ in range(2):
        run_log.append_run_log(df, f"file://{tmp_path}/out")
    back = run_log.read_run_log(spark, f"file://{tmp_path}/out")
    assert back.count() == 2 and back.first()["created_at"] == df.first()["created_at"]
    run_log.write_runs(df, f"file://{tmp_path}/table")
    assert (tmp_path / "table/repo_id=r/yyyymm=202401").is_dir()


def test_failed_files(spark, tmp_path):
    body = {"testResults": [{"testFilePath": "/w/b.test.ts", "status": "failed"}, {"testFilePath": "/w/a.test.ts", "status": "failed"}, {"testFilePath": "/w/c", "status": "passed"}]}
    (tmp_path / "r.json").write_text(json.dumps(body, indent=1))
    failed = lambda name, *w: sorted(r[0] for r in run_log.failed_test_files(spark, f"file://{tmp_path}/{name}.json", *w).collect())
    assert failed("r", "/w") == ["a.test.ts", "b.test.ts"]
    (tmp_path / "bad.json").write_text('{"testResults": 3}')
    assert failed("bad") == failed("none") == []


def test_settings(tmp_path):
    (tmp_path / "c.yml").write_text("mode: standard\nflaky-test-quarantine: 0.3\nrunAllTestsOn: [a, 3]\nalways-run: [x]\nfullSuiteEvery: yes\n")
    got = config.SelectionConfig.read(str(tmp_path / "c.yml"))
    pytest.importorskip("yaml")
    assert (got.mode, got.flaky_test_quarantine, got.always_run, got.full_suite_every) == ("standard", 0.3, ["x"], 50)
    assert got.run_all_tests_on == config.SelectionConfig().run_all_tests_on
    (tmp_path / "bad.yml").write_text("- a\n- b")
    assert config.SelectionConfig.read(str(tmp_path / "bad.yml")) == config.SelectionConfig.read(str(tmp_path / "none")) == config.SelectionConfig()
    assert config.SelectionConfig.of({"mode": "odd"}).mode == "shadow"


def test_aliases_chain_and_order(tmp_path):
    write(tmp_path, **{"tsconfig.json": '{ // c\n "extends": "./base", "compilerOptions": {"paths": {"@/*": ["src/*"], "@/a": ["x/a.ts"], "@@/*": ["**/*.ts"],},},}', "base.json": '{"compilerOptions": {"baseUrl": "app", "paths": {"@/*": ["old/*"], "~/*": ["lib/*"]}}}'})
    got = config.ts_aliases(str(tmp_path))
    assert [(r["pattern"], r["targets"][0], r["base"]) for r in got] == [("@@/*", "**/*.ts", "app"), ("@/a", "x/a.ts", "app"), ("@/*", "src/*", "app"), ("~/*", "lib/*", "app")]
    assert config.ts_aliases(str(tmp_path / "nowhere")) is None
    write(tmp_path, **{"tsconfig.json": "{"})
    assert config.ts_aliases(str(tmp_path)) is None


def test_import_forms():
    ts = """
    // import no from 'comment'
    import { a } from 'mod-a'; import type { T } from "./types"
    import './side'; export * from './all'; export { b } from './b'
    import legacy = require('./legacy'); const { c } = require("./c")
    const d = await import('./d'); const e = await import(name)
    /* require('blocked') */
    const s = "http://x"; import
      multi
      from './multi'
    """
    assert imports.script_imports(ts) == ["./all", "./b", "./c", "./d", "./legacy", "./multi", "./side", "./types", "mod-a"]
    py = "import os, sys\nimport a.b\nimport numpy as np\nfrom .x import y\nfrom .. import z\nfrom __future__ import annotations\nfrom p.q import r as s\n"
    assert imports.python_imports(py) == ["..", ".x", "a.b", "os", "p.q", "sys"]
    assert imports.python_imports(py + "def broken(:\n") == ["..", ".x", "a.b", "os", "p.q", "sys"]
    rb = "require 'json'\nrequire_relative './u'\nrequire(\"net/http\")\nrequire \"a#{b}\"\n# require 'no'\nputs 'x'\n"
    assert imports.ruby_imports(rb) == ["./u", "json", "net/http"]
    go = 'package m\nimport "fmt"\nimport (\n  "os/exec" // "no"\n  x "pkg/x"\n  _ "blank"\n)\nvar s = "not"\n'
    assert imports.go_imports(go) == ["blank", "fmt", "os/exec", "pkg/x"]


def test_candidates():
    c = lambda raw, src="src/a/b.ts", al=None: [p for p, _ in imports.candidates(raw, src, al)]
    assert c("./x")[:3] == ["src/a/x.ts", "src/a/x.tsx", "src/a/x.js"] and c("./x")[4] == "src/a/x/index.ts"
    assert c("../x.service") == ["src/x.service"]
    assert c(".m.n", "p/q.py") == ["p/m/n.py"] and c("..m", "p/q/r.py") == ["p/m.py"] and c("..", "p/q/r.py") == ["p.py"]
    assert c("lib/u") == ["lib/u", "lib/u.rb"] and c("github.com/x") == ["github.com/x"] and c("/abs") == [] and c("http://x") == []
    rule = [{"pattern": "@/*", "wildcard": True, "prefix": "@/", "targets": ["src/*"], "base": "."}]
    assert c("@/k", al=rule)[0] == "src/k.ts"


def test_tree_to_graph(spark, tmp_path, rows):
    from runweave.plans.pipeline import static_analysis

    write(tmp_path, **{
        "tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}', "src__core.ts": "export const x = 1", "src__mid.ts": "import '@/core'", "test__mid.test.ts": "import '../src/mid'", "test__other.test.ts": "import 'fs'",
        "pkg__one__a.go": "package one", "main.go": 'package main\nimport "pkg/one"', "py__u.py": "x = 1", "py__v.py": "from .u import x", "node_modules__dep.ts": "import './x'", "readme.md": "import 'a'", "src__node_modules__kept.ts": "import '../core'",
    })
    got = static_analysis(spark, str(tmp_path), ["src/core.ts"], ["*.config.ts"])
    assert rows(got["links"]) == [("main.go", "pkg/one"), ("py/v.py", "py/u.py"), ("src/mid.ts", "src/core.ts"), ("src/node_modules/kept.ts", "src/core.ts"), ("test/mid.test.ts", "src/mid.ts")]
    assert rows(got["blocking"]) == [("test/mid.test.ts",)] and got["errors"].count() == 0 and got["full_suite"].first()[0] is False
    files = run_log.read_tree(spark, str(tmp_path))
    whole = imports.dependency_graph(got["links"], files)
    assert whole.count() == files.count() and whole.where("path = 'src/core.ts'").first()["imports"] == []
    assert rows(run_log.read_test_files(spark, str(tmp_path)).select("path")) == [("test/mid.test.ts",), ("test/other.test.ts",)]


def test_parser_errors_are_data(spark, rows):
    def boom(source):
        raise ValueError("broken")

    files = spark.createDataFrame([("a.ts", "x"), ("b.txt", "y"), ("c.TS", None)], "path string, content string")  # c couldn't be read
    got = rows(imports.parse_imports(files, {".ts": boom}))
    assert got == [("a.ts", [], "ValueError: broken"), ("b.txt", [], None), ("c.TS", [], "unreadable")]
