"""Facts of Python sources: units for chunking, and nodes and edges of a name-based graph."""

from __future__ import annotations

import ast
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "id string, kind string, name string, file string, line int"
EDGES = "source string, target string, relationship string, file string, line int"


def module_name(path: str) -> str:
    return path.removesuffix(".py").removesuffix("/__init__").replace("/", ".")


DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


class Places:
    """Character offsets of the places that a syntax tree gives as line and byte column."""

    def __init__(self, source: str):
        self.lines = source.splitlines(keepends=True)
        self.starts = [0, *accumulate(map(len, self.lines))]

    def __call__(self, line: int, column: int) -> int:
        return self.starts[line - 1] + len(self.lines[line - 1].encode()[:column].decode())


def units(source: str) -> list[dict]:
    """Functions and classes with their character ranges, qualified names, signatures and doc strings, in source order."""
    tree, place = ast.parse(source), Places(source)
    above = {child: node for node in ast.walk(tree) for child in ast.iter_child_nodes(node)}

    def owners(node) -> list:
        """The definitions around a node, the innermost first."""
        chain = []
        while node := above.get(node):
            chain += [node] if isinstance(node, DEFINITIONS) else []
        return chain

    def unit(node) -> dict:
        around = owners(node)
        name = ".".join(n.name for n in [*around[::-1], node])
        is_class = isinstance(node, ast.ClassDef)
        # a decorator's place is that of its expression, behind the sign
        begin = min([place(node.lineno, node.col_offset), *(place(d.lineno, d.col_offset) - 1 for d in node.decorator_list)])
        return {
            "key": name,
            "kind": "class" if is_class else "method" if around and isinstance(around[0], ast.ClassDef) else "function",
            "name": node.name,
            "qualified_name": name,
            "start": begin,
            "end": place(node.end_lineno, node.end_col_offset),
            "parent": ".".join(n.name for n in around[::-1]) if around else None,
            "signature": node.name if is_class else f"{node.name}({ast.unparse(node.args)})",
            "comments": ast.get_docstring(node) or "",
        }

    return sorted((unit(n) for n in ast.walk(tree) if isinstance(n, DEFINITIONS)), key=lambda u: (u["start"], -u["end"]))


def facts(path: str, source: str) -> tuple[list[tuple], list[tuple]]:
    """Nodes and edges (calls by name, still to be resolved; contains; imports) of one file. Nothing for broken syntax."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return [], []
    module = module_name(path)
    nodes, edges = [(module, "module", module, path, 1)], []

    def called(node) -> str:
        f = node.func
        return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""

    def visit(node, owner: str, in_class: bool):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.Import):
                edges.extend((module, a.name, "imports", path, child.lineno) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                base = child.module or ""
                if child.level:  # relative to the package that the file stands in
                    package = module if path.endswith("__init__.py") else module.rpartition(".")[0]
                    above = package.split(".")[: len(package.split(".")) - child.level + 1]
                    base = ".".join([*above, *([base] if base else [])]) if above and above[0] else "." * child.level + base
                edges.append((module, base, "imports", path, child.lineno))
                edges.extend((module, f"{base}.{a.name}", "may_import", path, child.lineno) for a in child.names if a.name != "*")
            elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if in_class else "function"
                name = f"{owner}:{child.name}" if owner == module else f"{owner}.{child.name}"
                nodes.append((name, kind, child.name, path, child.lineno))
                edges.append((owner, name, "contains", path, child.lineno))
                if kind != "class":
                    edges.extend((name, called(c), "calls", path, c.lineno) for c in ast.walk(child) if isinstance(c, ast.Call) and called(c))
                visit(child, name, kind == "class")
            else:
                visit(child, owner, in_class)

    visit(tree, module, False)
    return nodes, edges


def _table(files: DataFrame, which: int, schema: str) -> DataFrame:
    def rows(batches):
        import pandas as pd

        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            found = [r for p, s in zip(batch["path"], batch["text"], strict=True) for r in facts(p, s or "")[which]]
            yield pd.DataFrame(found, columns=names)

    return files.where(F.col("path").endswith(".py")).select("path", "text").mapInPandas(rows, schema)


def nodes(files: DataFrame) -> DataFrame:
    return _table(files, 0, NODES)


def edges(files: DataFrame) -> DataFrame:
    return _table(files, 1, EDGES)
