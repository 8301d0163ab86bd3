"""Facts read from the syntax tree of Python files: the one place where code is parsed.

One row per file holds everything the file-local rules ask for, in typed arrays, so those rules need
no shuffle. :func:`fact_rows` gives the same facts as rows.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolens import constants as K

FILE_FACTS = (
    "repo_id STRING, path STRING, "
    "error STRUCT<kind: STRING, line: INT, message: STRING, text: STRING>, "
    "imports ARRAY<STRUCT<name: STRING, line: INT, pos: INT, text: STRING>>, "
    "used ARRAY<STRING>, "
    "handlers ARRAY<STRUCT<idx: INT, line: INT, type: STRING, only_pass: BOOLEAN, text: STRING>>, "
    "calls ARRAY<STRUCT<idx: INT, line: INT, name: STRING, constant_arg: BOOLEAN, shell_true: BOOLEAN, text: STRING>>, "
    "defs ARRAY<STRUCT<idx: INT, name: STRING, line: INT>>, "
    "scopes ARRAY<STRUCT<scope: INT, assigned: ARRAY<STRUCT<name: STRING, line: INT, pos: INT, text: STRING>>, "
    "loaded: ARRAY<STRING>>>"
)

_BINDING = pa.struct([("name", pa.string()), ("line", pa.int32()), ("pos", pa.int32()), ("text", pa.string())])
_ARROW = pa.schema([
    ("repo_id", pa.string()),
    ("path", pa.string()),
    ("error", pa.struct([("kind", pa.string()), ("line", pa.int32()), ("message", pa.string()), ("text", pa.string())])),
    ("imports", pa.list_(_BINDING)),
    ("used", pa.list_(pa.string())),
    ("handlers", pa.list_(pa.struct([("idx", pa.int32()), ("line", pa.int32()), ("type", pa.string()),
                                     ("only_pass", pa.bool_()), ("text", pa.string())]))),
    ("calls", pa.list_(pa.struct([("idx", pa.int32()), ("line", pa.int32()), ("name", pa.string()),
                                  ("constant_arg", pa.bool_()), ("shell_true", pa.bool_()), ("text", pa.string())]))),
    ("defs", pa.list_(pa.struct([("idx", pa.int32()), ("name", pa.string()), ("line", pa.int32())]))),
    ("scopes", pa.list_(pa.struct([("scope", pa.int32()), ("assigned", pa.list_(_BINDING)),
                                   ("loaded", pa.list_(pa.string()))]))),
])

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _bindings(pairs, text) -> list[dict]:
    """Names in order of first binding, each with the line of its last one."""
    lines: dict[str, int] = {}
    for name, line in pairs:
        lines[name] = line
    return [{"name": n, "line": at, "pos": i, "text": text(at)} for i, (n, at) in enumerate(lines.items())]


def _imported(nodes):
    for node in nodes:
        if isinstance(node, ast.Import):
            for a in node.names:
                yield a.asname or a.name.partition(".")[0], node.lineno
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                if a.name != "*":
                    yield a.asname or a.name, node.lineno


def _scope(number: int, function: ast.AST, text) -> dict:
    """Plain names assigned anywhere below a function, and which of them are read there."""
    pairs, loaded = [], set()
    for node in ast.walk(function):
        if isinstance(node, ast.Assign):
            pairs += [(t.id, node.lineno) for t in node.targets if isinstance(t, ast.Name)]
        elif isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load):
            loaded.add(node.id)
    assigned = _bindings(pairs, text)
    return {"scope": number, "assigned": assigned, "loaded": sorted(loaded & {b["name"] for b in assigned})}


def _call(idx: int, node: ast.Call, text) -> dict | None:
    name = getattr(node.func, "id", None) or getattr(node.func, "attr", None)
    if name not in K.EVAL_NAMES and name not in K.SUBPROCESS_NAMES:
        return None
    shell = any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in node.keywords)
    constant = bool(node.args) and isinstance(node.args[0], ast.Constant)
    return {"idx": idx, "line": node.lineno, "name": name, "constant_arg": constant, "shell_true": shell,
            "text": text(node.lineno)}


def file_facts(source: str) -> dict:
    """Facts of one file. A file that is no Python, or that the parser gives up on, has only ``error``."""
    try:
        tree = ast.parse(source)
    except SyntaxError as e:
        return {"error": {"kind": "syntax_error", "line": e.lineno or 1, "message": e.msg, "text": e.text or ""}}
    except (RecursionError, MemoryError, ValueError) as e:
        return {"error": {"kind": "parse_error", "line": 1, "message": type(e).__name__, "text": ""}}
    lines = source.splitlines()

    def text(number):
        return lines[number - 1].strip() if 1 <= number <= len(lines) else ""

    nodes = list(ast.walk(tree))
    imports = _bindings(_imported(nodes), text)
    bound = {b["name"] for b in imports}
    functions = sorted((n for n in nodes if isinstance(n, _FUNCTIONS)), key=lambda n: (n.lineno, n.col_offset))
    calls = (_call(i, n, text) for i, n in enumerate(nodes) if isinstance(n, ast.Call))
    return {
        "imports": imports,
        "used": sorted({n.id for n in nodes if isinstance(n, ast.Name)} & bound),
        "handlers": [
            {"idx": i, "line": h.lineno, "text": text(h.lineno),
             "type": None if h.type is None else h.type.id if isinstance(h.type, ast.Name) else "",
             "only_pass": all(isinstance(s, ast.Pass) for s in h.body)}
            for i, n in enumerate(nodes) if isinstance(n, ast.Try) for h in n.handlers
        ],
        "calls": [c for c in calls if c],
        "defs": [{"idx": i, "name": n.name, "line": n.lineno} for i, n in enumerate(nodes) if isinstance(n, _FUNCTIONS)],
        "scopes": [s for s in (_scope(i, f, text) for i, f in enumerate(functions)) if s["assigned"]],
    }


def extract_facts(files: DataFrame, content: str = "content", keep: str | None = None) -> DataFrame:
    """One row of facts per file of ``files(repo_id, path, <content>)``; a null content has no facts.

    Files are parsed where they are read: nothing is shuffled. Names are kept only where they can
    meet a binding, so a row of facts is much smaller than its file. The column ``keep`` goes along, so
    that what else is found in a content comes from the same scan.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        warnings.simplefilter("ignore", SyntaxWarning)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = [
                    {"repo_id": repo, "path": path, **({} if source is None else file_facts(source))}
                    for repo, path, source in zip(*(part.column(i).to_pylist() for i in range(3)))
                ]
                facts = pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                yield facts if keep is None else facts.append_column(keep, part.column(3))

    kept = [] if keep is None else [files.schema[keep]]
    schema = T.StructType([*T.StructType.fromDDL(FILE_FACTS).fields, *kept])
    return files.select("repo_id", "path", content, *[f.name for f in kept]).mapInArrow(parse, schema)


def fact_rows(facts: DataFrame) -> DataFrame:
    """``(repo_id, path, kind, pos, name, line, scope)``, one row per fact."""

    def row(kind, pos, name, line, scope=F.lit(None)):
        return F.struct(
            F.lit(kind).alias("kind"), pos.cast("int").alias("pos"), name.cast("string").alias("name"),
            line.cast("int").alias("line"), scope.cast("int").alias("scope"),
        )

    none = F.lit(None)
    arrays = [
        F.when(F.col("error").isNotNull(), F.array(row("error", F.lit(0), F.col("error.kind"), F.col("error.line")))),
        F.transform("imports", lambda x: row("import", x.pos, x["name"], x.line)),
        F.transform("used", lambda x, i: row("use", i, x, none)),
        F.transform("handlers", lambda x: row("handler", x.idx, x["type"], x.line)),
        F.transform("calls", lambda x: row("call", x.idx, x["name"], x.line)),
        F.transform("defs", lambda x: row("def", x.idx, x["name"], x.line)),
        F.flatten(F.transform("scopes", lambda s: F.transform(s.assigned, lambda x: row("assign", x.pos, x["name"], x.line, s.scope)))),
        F.flatten(F.transform("scopes", lambda s: F.transform(s.loaded, lambda x, i: row("load", i, x, none, s.scope)))),
    ]
    empty = F.array().cast("array<struct<kind:string,pos:int,name:string,line:int,scope:int>>")
    every = F.concat(*[F.coalesce(a, empty) for a in arrays])
    return facts.select("repo_id", "path", F.explode(every).alias("f")).select("repo_id", "path", "f.*")
