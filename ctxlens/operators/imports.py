"""Import graph of a code corpus and its neighbourhoods."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxlens.runtime import cut_lineage

IMPORTS = "array<struct<module:string,level:int>>"


def _imports_of(source: str) -> list[tuple[str, int]]:
    try:
        nodes = list(ast.walk(ast.parse(source)))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    plain = [(a.name, 0) for n in nodes if isinstance(n, ast.Import) for a in n.names]
    named = [
        (n.module, n.level) for n in nodes if isinstance(n, ast.ImportFrom) and n.module
    ]
    return plain + named


def _import_lists(sources: pd.Series) -> pd.Series:
    return sources.map(
        lambda s: [{"module": m, "level": lv} for m, lv in _imports_of(s or "")]
    )


def resolved_module(path: Column, module: Column, level: Column) -> Column:
    """Absolute dotted name of an import; each level above 1 climbs one folder."""
    folders = F.slice(
        F.split(path, "/", -1), 1, F.greatest(F.size(F.split(path, "/", -1)) - level, F.lit(0))
    )
    return F.when(level == 0, module).otherwise(
        F.array_join(F.concat(folders, F.array(module)), ".")
    )


def imports(code_files: DataFrame) -> DataFrame:
    """Distinct (repo, src, module) named by import statements; unreadable code has none."""
    listed = F.pandas_udf(_import_lists, IMPORTS)
    found = code_files.select(
        "repo", F.col("path").alias("src"), F.explode(listed("content")).alias("i")
    )
    return found.select(
        "repo", "src",
        resolved_module(F.col("src"), F.col("i.module"), F.col("i.level")).alias("module"),
    ).distinct()


def proper_prefixes(module: Column) -> Column:
    """Dotted prefixes of a module name, the name itself left out."""
    names = F.split(module, r"\.", -1)
    return F.when(
        F.size(names) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(names) - 1),
            lambda n: F.array_join(F.slice(names, F.lit(1), n), "."),
        ),
    ).otherwise(F.array().cast("array<string>"))


def edges(import_rows: DataFrame, files: DataFrame) -> DataFrame:
    """edges(repo, src, dst): exact module match, else every known dotted prefix.

    Each import sends itself and its prefixes to one equi-join with the modules.
    Exact hits are marked by rank 0; prefixes count only where no exact hit exists.
    Modules are unique per name, so a module that very many files import splits
    on the import side.
    """
    modules = files.groupBy("repo", "module").agg(F.min("path").alias("dst"))
    tried = import_rows.select(
        "repo",
        "src",
        F.col("module").alias("wanted"),
        F.posexplode(
            F.concat(F.array("module"), proper_prefixes(F.col("module")))
        ).alias("rank", "module"),
    )
    hits = tried.join(modules, ["repo", "module"])
    exact = hits.where(F.col("rank") == 0).select("repo", "src", "wanted")
    prefix = hits.where(F.col("rank") > 0).join(exact, ["repo", "src", "wanted"], "left_anti")
    return (
        hits.where(F.col("rank") == 0)
        .select("repo", "src", "dst")
        .unionByName(prefix.select("repo", "src", "dst"))
        .where(F.col("src") != F.col("dst"))
        .distinct()
    )


def import_graph(code_files: DataFrame) -> DataFrame:
    return edges(imports(code_files), code_files)


def reversed_edges(edge_rows: DataFrame) -> DataFrame:
    return edge_rows.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst"))


def reachable(
    starts: DataFrame, edge_rows: DataFrame, depth: int = 1, cut_every: int = 2
) -> DataFrame:
    """Nodes within `depth` steps of each start: (repo, start, node, steps), start left out.

    One frontier join per step, for all starts at once. Visited nodes are taken
    off by an anti-join; from the third step on, the plan is cut by checkpoints.
    """
    visited = starts.select("repo", "start", F.col("start").alias("node"), F.lit(0).alias("steps"))
    frontier = visited
    for step in range(1, depth + 1):
        ahead = frontier.select("repo", "start", F.col("node").alias("src")).join(
            edge_rows, ["repo", "src"]
        )
        frontier = (
            ahead.select("repo", "start", F.col("dst").alias("node"))
            .distinct()
            .join(visited, ["repo", "start", "node"], "left_anti")
            .withColumn("steps", F.lit(step))
        )
        if step >= cut_every and step < depth:
            frontier = cut_lineage(frontier)
            visited = cut_lineage(visited.unionByName(frontier))
        else:
            visited = visited.unionByName(frontier)
    return visited.where(F.col("steps") > 0)


def neighbourhood(starts: DataFrame, edge_rows: DataFrame, depth: int = 1) -> DataFrame:
    """(repo, start, node, steps, relation) for dependencies and dependents."""
    ahead = reachable(starts, edge_rows, depth).withColumn("relation", F.lit("dependency"))
    back = reachable(starts, reversed_edges(edge_rows), depth).withColumn(
        "relation", F.lit("dependent")
    )
    return ahead.unionByName(back)
