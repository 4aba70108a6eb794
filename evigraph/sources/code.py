"""Code analysis as a Python table function: what a source file declares, one row per item."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

CALLS = 50


def _doc(node) -> str | None:
    lines = (ast.get_docstring(node) or "").strip().splitlines()
    return lines[0] if lines else None


def _signature(f) -> str:
    """Parameters with annotations and defaults, and what is returned, as written."""
    return f"({ast.unparse(f.args)})" + (f" -> {ast.unparse(f.returns)}" if f.returns else "")


def _dotted(node: ast.expr) -> str:
    """A name with its dots; "" for what is no plain name, as a call of a call."""
    text = ast.unparse(node)
    return text if all(part.isidentifier() for part in text.split(".")) else ""


def _declared(owner: str, node) -> Iterator[tuple[str, str | None, str | None, str | None]]:
    """Rows of one class or function, and of its decorators."""
    is_class = isinstance(node, ast.ClassDef)
    kind = "class" if is_class else "method" if owner else "function"
    yield kind, owner + node.name, ", ".join(map(ast.unparse, node.bases)) if is_class else _signature(node), _doc(node)
    if not owner:
        yield from (("decorator", node.name, _dotted(d.func if isinstance(d, ast.Call) else d), None) for d in node.decorator_list)


def python_items(source: str) -> Iterator[tuple[str, str | None, str | None, str | None]]:
    """kind, name, signature, doc: module docstring, imports at any depth, top-level classes (with bases) and functions, methods,
    decorators, and the dotted names called (sorted, CALLS at most). A syntax error gives one row with the source."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        yield "error", "syntax error", None, source
        return
    if doc := ast.get_docstring(tree):
        yield "module", None, None, doc
    calls, functions = set(), (ast.FunctionDef, ast.AsyncFunctionDef)
    for node in ast.walk(tree):
        match node:
            case ast.Import(names=names):
                yield from (("import", x.name, None, None) for x in names)
            case ast.ImportFrom(module=module, names=names):
                yield from (("import", f"{module or ''}.{x.name}", None, None) for x in names)
            case ast.Call(func=func):
                calls.add(_dotted(func))
    for node in tree.body:
        if isinstance(node, (ast.ClassDef, *functions)):
            yield from _declared("", node)
        if isinstance(node, ast.ClassDef):
            for inner in filter(lambda x: isinstance(x, functions), node.body):
                yield from _declared(f"{node.name}.", inner)
    yield from (("call", name, None, None) for name in sorted(calls - {""})[:CALLS])


#: Declarations of other languages, by their keywords; and comments.
DECLARATION = re.compile(r"^\s*(?:(?:public|private|protected|static|export|async|abstract|final|pub|default)\s+)*(class|interface|struct|enum|module|package|namespace|trait|fn|func|function|def|type)\s+([A-Za-z_$][\w$]*)[^\n]*", re.M)
COMMENT = re.compile(r"^\s*(?://|#|--|\*)\s?(.*\S)", re.M)


def other_items(source: str) -> Iterator[tuple[str, str | None, str | None, str | None]]:
    for m in DECLARATION.finditer(source):
        yield m[1], m[2], "\n".join(source[m.start() :].strip().split("\n")[:5]), None
    for m in list(COMMENT.finditer(source))[:10]:
        yield "comment", None, None, m[1]


class CodeItems:
    def eval(self, path: str, source: str):
        if source is not None:
            yield from (python_items if path.endswith(".py") else other_items)(source)


def register(spark: SparkSession) -> None:
    """Makes ``code_items(path, source)`` a table function in SQL."""
    spark.udtf.register("code_items", udtf(CodeItems, returnType="kind string, name string, signature string, doc string"))


def code_items(spark: SparkSession, files: DataFrame) -> DataFrame:
    """path, kind, name, signature, doc for files (path, text)."""
    register(spark)
    files.createOrReplaceTempView("_code_files")
    return spark.sql("SELECT f.path, c.* FROM _code_files f, LATERAL code_items(f.path, f.text) c")
