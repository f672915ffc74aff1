import random

from pyspark.sql import functions as F

from lodewright.operators import graph as g
from lodewright.operators.structure import inventory

E = "project_id long, src string, dst string"


def brute(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            for n in nodes:
                if a in reach[n]:
                    reach[n] = reach[n] | reach[b]
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


def test_components_both_ways(spark):
    rng = random.Random(4)
    rows, expected = [], set()
    for p in range(4):
        edges = {(f"n{rng.randrange(14):02d}", f"n{rng.randrange(14):02d}") for _ in range(8 + 6 * p)}
        edges = {e for e in edges if e[0] != e[1]}
        rows += [(p, *e) for e in edges]
        label = brute(edges)
        expected |= {(p, c, n) for n, c in label.items() if sum(x == c for x in label.values()) > 1}
    df = spark.createDataFrame(rows, E)
    for limit in (1000, 0):
        assert {(r.project_id, r.component, r.module) for r in g.components(df, limit).collect()} == expected
    assert g.components(df.limit(0)).count() == 0


def test_long_chain_and_ring():
    import pandas as pd

    chain = [(f"c{i}", f"c{i + 1}") for i in range(10_000)] + [(f"r{i}", f"r{(i + 1) % 100}") for i in range(100)]
    label = g._tarjan(pd.DataFrame(chain, columns=["src", "dst"]))
    assert sum(v == "r0" for v in label.values()) == 100 and len(set(label.values())) == 10_002


def test_degrees_coupling_scores(spark):
    edges = g.simple_edges(spark.createDataFrame([(1, "a", "b"), (1, "a", "b"), (1, "b", "b"), (1, "c", "b"), (1, "d", "b"), (1, None, "b")], E))
    nodes = spark.createDataFrame([(1, "e"), (1, ".x"), (1, "a")], "project_id long, module string")
    degree = g.degrees(edges, nodes)
    assert {r.module: (r.fan_in, r.fan_out) for r in degree.collect()} == {"a": (0, 1), "b": (3, 0), "c": (0, 1), "d": (0, 1), "e": (0, 0), ".x": (0, 0)}
    assert [r.module for r in g.orphans(degree).collect()] == ["e"]
    files = spark.createDataFrame([(1, "b/x.py"), (1, "b/y_test.go"), (1, "a/Base.java"), (1, "a/z.h")], "project_id long, path string")
    coupled = g.coupling(degree, g.abstractness(files, F.substring_index("path", "/", 1)))
    got = {r.module: (r.instability, r.abstractness, r.distance) for r in coupled.collect()}
    assert got["b"] == (0.0, 0.0, 0.707) and got["a"] == (1.0, 1.0, 0.707)
    assert [(r.module, r.severity) for r in g.painful(coupled).collect()] == [("b", "medium")]
    assert g.coupling_score(coupled).first().score == 88.8
    ring = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), *[(1, f"x{i}", "hub") for i in range(16)]], E)
    row = g.dependency_score(g.degrees(ring), g.components(ring)).first()
    assert (row.cycles, row.largest, row.top_fan_in, row.score) == (1, 2, 16, 84.0)


def test_imports_resolve(spark):
    files = [
        ("src/pkg/__init__.py", ""), ("src/pkg/a.py", "from .b import x\nfrom pkg.sub import c\nimport os\nfrom . import q\n"), ("src/pkg/b.py", "import pkg.a\n"), ("src/pkg/sub/__init__.py", "from ..b import y\n"),
        ("top.py", "import helper\nimport missing.mod\n"), ("helper.py", ""), ("web/app.ts", "import x from './lib/y'\nimport '../top'\nconst z = require('react')\n"), ("web/lib/y/index.ts", "import q from '../../app'"),
    ]
    inv = inventory(spark.createDataFrame([(1, p, c) for p, c in files], "project_id long, path string, content string"))
    got = {(r.src, r.dst) for r in g.import_edges(inv).collect()}
    assert got == {("src/pkg/a", "src/pkg/b"), ("src/pkg/a", "src/pkg/sub"), ("src/pkg/b", "src/pkg/a"), ("src/pkg/sub", "src/pkg/b"), ("top", "helper"), ("web/app", "web/lib/y"), ("web/lib/y", "web/app")}
