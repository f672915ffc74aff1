"""Whole runs: a scan of projects, from files and history to the overall score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewright.functions.paths import module_of
from lodewright.operators import findings as f
from lodewright.operators import functions_of, graph, history, report, structure
from lodewright.session import cut_lineage


def scan(files: DataFrame, commits: DataFrame, commit_files: DataFrame, measured: list[str] | None = None) -> dict[str, DataFrame]:
    """scores, overall and findings of every project with files: what a scan of a repository reports.

    files has project_id, path and content; measured are the languages whose comments count (by default all known ones but markup and data).
    """
    measured = measured or sorted(set(structure.LANGUAGES.values()) - {"markdown", "json", "yaml", "toml", "html", "css", "scss", "sql", "shell"})
    whole = structure.inventory(files)
    # What needs no content reads the inventory's other columns, written once; contents are read once by each of the others.
    inv = cut_lineage(whole.drop("content"))
    churned = history.file_churn(history.changes(commits, commit_files))
    hot, lone = history.hotspots(churned), history.islands(churned)
    modules = structure.module_rollup(inv)
    edges = cut_lineage(graph.import_edges(whole))
    degree = graph.degrees(edges, inv.select("project_id", module_of(F.col("path")).alias("module")).distinct())
    coupled = graph.coupling(degree, graph.abstractness(inv, module_of(F.col("path"))))
    markers = cut_lineage(structure.marker_counts(whole))
    metrics = cut_lineage(functions_of.function_metrics(whole))
    functions = functions_of.function_summary(metrics)
    sizes = structure.size_medians(inv).join(structure.comment_ratio(whole, measured), "project_id", "left").join(functions, "project_id", "left")
    debt = structure.debt_density(markers, inv.groupBy("project_id").agg(F.sum("loc").alias("loc")))
    cycles = cut_lineage(graph.components(edges))
    parts = {
        "git_history": history.score(hot, history.bus_factor(history.author_commits(commits)), lone),
        "architecture": structure.architecture_score(modules),
        "dependencies": graph.dependency_score(degree, cycles),
        "complexity": sizes.withColumn("score", structure.complexity_score(F.col("long_files"), F.col("long_functions"), F.col("complex_functions"), F.col("comment_ratio"))),
        "tech_debt": debt,
        "coupling": graph.coupling_score(coupled),
    }
    scores = None
    for name, part in parts.items():
        one = part.select("project_id", F.lit(name).alias("analyzer"), "score")
        scores = one if scores is None else scores.unionByName(one)
    kinds = [
        f.hotspot(hot), f.knowledge_island(history.first_islands(lone)), f.god_module(structure.god_modules(modules)), f.deep_nesting(modules), f.import_cycle(cycles), f.heavy_import(degree),
        f.long_file(structure.long_files(inv)), f.long_function(metrics), f.complex_function(metrics), f.debt_marker(f.marker_locations(whole)), f.debt_hotspot(structure.debt_files(markers)),
        f.stable_concrete(graph.painful(coupled)),
    ]
    findings = kinds[0]
    for kind in kinds[1:]:
        findings = findings.unionByName(kind)
    top = report.top_findings(findings)
    stats = report.stats(inv, commits)
    return {"inventory": inv, "scores": scores, "overall": report.composite(scores), "findings": top, "edges": edges, "modules": modules, "stats": stats, "counts": report.counts(top)}
