"""Functions of Python sources and who calls whom."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _owners(tree: ast.AST) -> dict[ast.AST, ast.FunctionDef | None]:
    """The innermost function around every node of a tree, None at the top; parents come before their children."""
    owner: dict[ast.AST, ast.FunctionDef | None] = {tree: None}
    for node in ast.walk(tree):
        inside = node if isinstance(node, ast.FunctionDef) else owner[node]
        owner.update(dict.fromkeys(ast.iter_child_nodes(node), inside))
    return owner


def _rows(module: str, source: str | None) -> list[tuple]:
    """The functions of a source that can be parsed; those of one name share their calls, which are known by bare name only."""
    try:
        owner = _owners(ast.parse(source or ""))
    except SyntaxError:
        return []
    calls = [(f.name, getattr(n.func, "id", None) or getattr(n.func, "attr", None)) for n, f in owner.items() if isinstance(n, ast.Call) and f]
    out = []
    for f in owner:
        if isinstance(f, ast.FunctionDef):
            args = [a.arg for i, a in enumerate(f.args.args) if i or a.arg != "self"]
            says = (ast.get_docstring(f) or "").strip().partition("\n")[0]
            out.append((module, f.name, args, says, [callee for caller, callee in calls if caller == f.name and callee]))
    return out


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [r for module, source in frame.itertuples(index=False, name=None) for r in _rows(module, source)]
        yield pd.DataFrame(rows, columns=["module", "name", "args", "doc", "calls"])


def functions(sources: DataFrame) -> DataFrame:
    """(module, name, args, doc, calls) of sources (module, source)."""
    return sources.select("module", "source").mapInPandas(_parse, "module string, name string, args array<string>, doc string, calls array<string>")


def edges(found: DataFrame) -> DataFrame:
    """(src, dst, crosses): calls resolved by bare name; a name with several functions leads to all of them."""
    calls = found.select(F.concat_ws(".", "module", "name").alias("src"), F.col("module").alias("src_module"), F.explode("calls").alias("callee"))
    callees = found.select(F.col("name").alias("callee"), F.concat_ws(".", "module", "name").alias("dst"), F.col("module").alias("dst_module")).distinct()
    return calls.join(callees, "callee").select("src", "dst", (F.col("src_module") != F.col("dst_module")).alias("crosses")).distinct()


def pruned(all_edges: DataFrame, most: int = 8) -> DataFrame:
    """Of every src its first `most` edges by dst."""
    rank = F.row_number().over(W.partitionBy("src").orderBy("dst"))
    return all_edges.withColumn("_k", rank).where(F.col("_k") <= most).drop("_k")


def dot(found: DataFrame, all_edges: DataFrame) -> DataFrame:
    """The graph as DOT text: rows (part, line), to be written in their order; parts: 0 head, 1 functions by module, 2 calls, 3 end."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    session = found.sparkSession
    ends = session.createDataFrame([(0, "digraph calls {"), (3, "}")], "part int, line string")
    label = F.concat(F.col("name"), F.lit("("), F.array_join("args", ", "), F.lit(")"), F.when(F.col("doc") != "", F.concat(F.lit("\\n"), "doc")).otherwise(""))
    nodes = found.select(F.lit(1).alias("part"), F.concat(quoted(F.concat_ws(".", "module", "name")), F.lit(" [label="), quoted(label), F.lit(", group="), quoted(F.col("module")), F.lit("];")).alias("line"))
    calls = all_edges.select(F.lit(2).alias("part"), F.concat(quoted(F.col("src")), F.lit(" -> "), quoted(F.col("dst")), F.when(F.col("crosses"), " [penwidth=1.4]").otherwise(""), F.lit(";")).alias("line"))
    return ends.unionByName(nodes.distinct()).unionByName(calls.distinct())
