"""Native operators keep Python out of their plans; driver contracts of the subpackage."""

from __future__ import annotations

import ast
from pathlib import Path

import pytest

import foldline.llm as llm
from foldline.llm import decontam, dedup, jaccard, licenses
from foldline.llm import queries as Q

ROOT = Path(llm.__file__).resolve().parents[2]


@pytest.mark.parametrize("module", [decontam, dedup, licenses])
def test_native_modules_have_no_python_functions(module):
    text = Path(module.__file__).read_text()
    for name in ("udf", "mapIn", "applyIn", "pandas", "pyarrow", ".rdd", "mapPartitions"):
        assert name not in text, name


def test_native_plans(spark, data):
    for name in ("op4_exact_dedup", "op8_license_scan", "op10_benchmark_decontamination"):
        plan = Q.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "InArrow", "CartesianProduct")), plan


def test_nothing_else_imports_the_subpackage():
    for path in ROOT.glob("foldline/**/*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_every_operator_has_its_query():
    assert sorted(int(k[2:].split("_")[0]) for k in Q.QUERIES) == list(range(1, 11))
    assert set(Q.SQL) <= set(Q.QUERIES)


def test_first_pass_grows_with_the_corpus():
    small, mid, huge = (jaccard.dealing(n) for n in (10, 10**9, 15 * 10**12))
    assert small == (1, jaccard.BLOCK)
    assert mid[0] == 10**9 // jaccard.BUCKET and mid[1] >= jaccard.MESSAGE * mid[0]
    assert huge[0] == jaccard.MOST_BUCKETS and huge[1] == jaccard.MESSAGE * jaccard.MOST_BUCKETS
