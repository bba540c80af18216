"""Facts of Python source text, file by file: definitions, imports, calls, bases, uses of module variables.

A file is parsed alone, so the work is a map over files in Arrow batches; whatever needs several files is
a join over the facts (``operators.resolution``). A file that can't be parsed gives one row of kind ``error``.
"""

from __future__ import annotations

import ast
import builtins
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FACTS = (
    "snapshot_id string, path string, kind string, id string, name string, qualified_name string, parent_id string, "
    "type string, line int, end_line int, complexity int, target string, from_module string, via_import boolean"
)
BUILTINS = frozenset(dir(builtins))
BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension)
SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)
MARKS = (ast.expr_context, ast.boolop, ast.operator, ast.unaryop, ast.cmpop)


def module_name(path: str, packages: set[str]) -> str:
    """AX03: dotted name from the highest folder of an unbroken run of packages above the file."""
    parts = path.removesuffix(".py").split("/")
    top = len(parts) - 1
    while top > 0 and "/".join(parts[:top]) in packages:
        top -= 1
    names = parts[top:]
    return ".".join(names[:-1] if names[-1] == "__init__" and len(names) > 1 else names)


def relative(module: str, is_package: bool, level: int, target: str | None) -> str | None:
    """AX04: the absolute name of a relative import; None if it leaves the top package."""
    if level == 0:
        return target
    parts = module.split(".")
    keep = len(parts) - level + is_package
    return ".".join(parts[:keep] + ([target] if target else [])) if keep > 0 else None


def child_nodes(node: ast.AST) -> list[ast.AST]:
    """As ``ast.iter_child_nodes``, without load and store marks and operators, which nothing here asks for."""
    found = []
    for name in node._fields:
        value = getattr(node, name, None)
        if isinstance(value, list):
            found += [x for x in value if isinstance(x, ast.AST) and not isinstance(x, MARKS)]
        elif isinstance(value, ast.AST) and not isinstance(value, MARKS):
            found.append(value)
    return found


def own_nodes(root: ast.AST) -> list[ast.AST]:
    """The nodes below ``root`` that no nested definition holds."""
    found, todo = [], child_nodes(root)
    while todo:
        node = todo.pop()
        found.append(node)
        if not isinstance(node, SCOPES):
            todo += child_nodes(node)
    return found


def complexity(inner: list[ast.AST]) -> int:
    """AX11, of a function's own nodes: one, one for each branch, and one for each further operand of a boolean expression."""
    return 1 + sum(isinstance(n, BRANCHES) + (len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0) for n in inner)


def dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def assigned(body: list[ast.stmt]) -> dict[str, int]:
    """AX10: names that statements bind, and the first line; through if, try, with and loops, not into definitions."""
    found: dict[str, int] = {}

    def names(target: ast.AST, line: int) -> None:
        for n in ast.walk(target):
            if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
                found.setdefault(n.id, line)

    for s in body:
        for target in getattr(s, "targets", [getattr(s, "target", None)]) if isinstance(s, (ast.Assign, ast.AnnAssign, ast.AugAssign, ast.For)) else []:
            names(target, s.lineno)
        if not isinstance(s, SCOPES):
            blocks = [getattr(s, b, []) for b in ("body", "orelse", "finalbody")] + [h.body for h in getattr(s, "handlers", [])]
            for name, line in ((n, k) for b in blocks for n, k in assigned(b).items()):
                found.setdefault(name, line)
    return found


class Reader:
    """Collects the facts of one file."""

    def __init__(self, snapshot: str, path: str, module: str) -> None:
        self.base = {"snapshot_id": snapshot, "path": path}
        self.module, self.is_package = module, path.endswith("__init__.py")
        self.module_id = f"{path}:{module}"
        self.rows: list[dict] = []
        self.alias: dict[str, str] = {}

    def add(self, kind: str, **values: object) -> None:
        self.rows.append(self.base | {"kind": kind} | values)

    def read(self, source: str) -> list[dict]:
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            self.add("error", name=type(e).__name__, line=getattr(e, "lineno", None))
            return self.rows
        self.add("symbol", id=self.module_id, name=self.module.rpartition(".")[2], qualified_name=self.module, type="module", line=1, end_line=source.count("\n") + 1)
        self.globals = assigned(tree.body)
        self.local = {s.name for s in tree.body if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))}
        for name, line in self.globals.items():
            self.add("symbol", id=f"{self.module_id}.{name}", name=name, qualified_name=f"{self.module}.{name}", parent_id=self.module_id, type="global_variable", line=line, end_line=line)
        todo = [tree]  # as ast.walk; statements hold all imports, and no expression holds a statement
        for node in todo:
            self.imported(node)
            todo += [n for n in child_nodes(node) if not isinstance(n, ast.expr)]
        self.scope(own_nodes(tree), False, self.module_id, self.module, None)
        return self.rows

    def imported(self, node: ast.AST) -> None:
        if isinstance(node, ast.Import):
            for a in node.names:
                self.alias[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
                self.add("import", id=self.module_id, target=a.name, line=node.lineno)
        elif isinstance(node, ast.ImportFrom):
            origin = relative(self.module, self.is_package, node.level, node.module)
            for a in node.names if origin else []:
                full = origin if a.name == "*" else f"{origin}.{a.name}"
                self.alias[a.asname or a.name] = full
                self.add("import", id=self.module_id, target=full, from_module=origin, line=node.lineno)
                self.add("alias", id=self.module_id, qualified_name=f"{self.module}.{a.asname or a.name}", target=full)

    def scope(self, inner: list[ast.AST], in_class: bool, owner: str, qualified: str, cls: str | None) -> None:
        self.uses(inner, owner, cls)
        for child in self.definitions(inner):
            name = f"{qualified}.{child.name}"
            ident = f"{self.base['path']}:{name}"
            is_class = isinstance(child, ast.ClassDef)
            kind = "class" if is_class else "method" if in_class else "function"
            own = own_nodes(child)
            self.add("symbol", id=ident, name=child.name, qualified_name=name, parent_id=owner, type=kind, line=child.lineno, end_line=child.end_lineno, complexity=None if is_class else complexity(own))
            for base in child.bases if is_class else []:
                if (raw := dotted(base)) and raw not in BUILTINS:
                    self.add("inherit", id=ident, name=raw, target=self.full(raw, None)[0], line=child.lineno)
            if not is_class:
                self.globals_of(child, own, ident)
            self.scope(own, is_class, ident, name, name if is_class else cls)

    @staticmethod
    def definitions(inner: list[ast.AST]) -> list:
        kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
        found = [n for n in inner if isinstance(n, kinds)]
        return sorted(found, key=lambda n: (n.lineno, n.col_offset))

    def full(self, raw: str, cls: str | None) -> tuple[str | None, bool]:
        """AX09: the full name that a dotted name means here, and whether an import led to it."""
        head, _, rest = raw.partition(".")
        tail = f".{rest}" if rest else ""
        if head in ("self", "cls") and cls and rest:
            return cls + tail, False
        if head in self.alias:
            return self.alias[head] + tail, True
        if head in self.local or head in self.globals:
            return f"{self.module}.{raw}", False
        return None if head in BUILTINS else raw, False

    def uses(self, inner: list[ast.AST], owner: str, cls: str | None) -> None:
        for n in inner:
            if isinstance(n, ast.Call) and (raw := dotted(n.func)):
                target, via = self.full(raw, cls)
                if target:
                    self.add("call", id=owner, name=raw.rpartition(".")[2], target=target, line=n.lineno, via_import=via)

    def globals_of(self, function: ast.AST, inner: list[ast.AST], ident: str) -> None:
        """AX07: module variables that a function reads or writes; its parameters and own names hide them."""
        args = function.args
        hidden = {a.arg for a in [*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg))]}
        declared = {name for n in inner if isinstance(n, ast.Global) for name in n.names}
        hidden |= {n.id for n in inner if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)} - declared
        for name in sorted({n.id for n in inner if isinstance(n, ast.Name)} & (set(self.globals) | set(self.alias)) - hidden):
            self.add("global", id=ident, name=name, target=self.alias.get(name, f"{self.module}.{name}"))


#: So many files give one batch of facts.
FILES = 500


def fact_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The facts of batches of files, handed on every ``FILES`` files, so that a worker and the JVM that reads from it hold no more."""
    for batch in batches:
        for at in range(0, batch.num_rows, FILES):
            files = batch.slice(at, FILES).to_pylist()
            rows = [r for f in files for r in Reader(f["snapshot_id"], f["path"], f["module"]).read(f["source"] or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c.name) for r in rows], c.type) for c in schema], schema=schema)


def extract(files: DataFrame) -> DataFrame:
    """AX01 to AX11: facts of ``files`` (snapshot_id, path, module, source)."""
    schema = to_arrow_schema(StructType.fromDDL(FACTS))
    return files.select("snapshot_id", "path", "module", "source").mapInArrow(lambda batches: fact_batches(batches, schema), FACTS)


def executable_hash(source: str) -> str | None:
    """AX24: hash of the syntax tree without docstrings; None if it can't be parsed."""
    import hashlib

    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    for node in ast.walk(tree):
        body = getattr(node, "body", None)
        if isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str):
            node.body = body[1:]
    return hashlib.sha256(ast.dump(tree).encode()).hexdigest()


#: Larger sources aren't parsed for review evidence: a fixed value.
LARGEST = 512 * 1024


def review_facts(files: DataFrame, key: list[str]) -> DataFrame:
    """AX22, AX24: ``files`` (key columns, source) with ``status`` (ok, missing, too_large, parse_error), the sorted names that
    it imports and declares, and the hash of its executable syntax tree."""

    def names(source: str) -> tuple[str, list, list]:
        if source is None:
            return "missing", [], []
        if len(source.encode("utf-8", "replace")) > LARGEST:
            return "too_large", [], []
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return "parse_error", [], []
        imports = {a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names}
        imports |= {"." * n.level + (n.module or "") + ":" + a.name for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) for a in n.names}
        declared = {n.name for n in ast.walk(tree) if isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef))}
        return "ok", sorted(imports), sorted(declared)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [names(x) for x in batch["source"]]
            for i, name in enumerate(("status", "imports", "declared")):
                batch[name] = [f[i] for f in found]
            batch["executable"] = [executable_hash(x) if f[0] == "ok" else None for x, f in zip(batch["source"], found)]
            yield batch.drop(columns=["source"])

    kinds = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in key)
    return files.select(*key, "source").mapInPandas(run, f"{kinds}, status string, imports array<string>, declared array<string>, executable string")
