"""Python files, by the standard parser."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from .base import MODULE, ContractRef, Extract, Ref, Scope, Symbol, join

#: HTTP methods that decorators name.
VERBS = ("get", "post", "put", "delete", "patch", "head", "options")


def _parsed(text: str) -> ast.Module:
    """The tree, or that of the longest prefix of whole top-level blocks that parses."""
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError):
        pass
    blocks = re.split(r"(?m)^(?=\S)", text.replace("\x00", ""))
    out, line = ast.Module([], []), 0
    for block in blocks:
        try:
            part = ast.parse(block)
            ast.increment_lineno(part, line)
            out.body += part.body
        except (SyntaxError, ValueError):
            pass
        line += block.count("\n")
    return out


def _calls(node: ast.AST) -> bool:
    return any(isinstance(x, ast.Call) for x in ast.walk(node))


def _relative(module: str, is_package: bool, level: int, target: str | None) -> str:
    if not level:
        return (target or "").replace(".", "::")
    parts = module.split("::") if module else []
    up = level - 1 if is_package else level
    return join(*(parts[: len(parts) - up] if up else parts), *(target or "").split("."))


def _own(node: ast.AST) -> Iterator[ast.AST]:
    """All nodes below, the bodies of nested functions included (they belong to the enclosing symbol)."""
    for child in ast.iter_child_nodes(node):
        yield child
        yield from _own(child)


def extract(file: str, module: str, text: str, config: dict | None = None) -> Extract:
    tree, out = _parsed(text), Extract()
    name = file.rsplit("/", 1)[-1]
    test_file = name.startswith("test_") or name.endswith("_test.py")
    is_package = name == "__init__.py"
    scope = Scope(module)
    last = max(1, text.count("\n") + 1)
    out.symbols.append(Symbol("Module", join(module, MODULE), 1, min(1, last), is_test=test_file))

    def imports(body: list[ast.stmt], top: bool) -> None:
        for s in body:
            if isinstance(s, ast.ImportFrom):
                base = _relative(module, is_package, s.level, s.module)
                for a in s.names:
                    if a.name == "*":
                        scope.wildcards.append(base)
                    else:
                        scope.imports[a.asname or a.name] = base
                        if s.level and not s.module:
                            scope.imports[a.asname or a.name] = join(base, a.name)
                if top:
                    out.refs.append(Ref(join(module, MODULE), MODULE, "Imports", "Module", base))
            elif isinstance(s, ast.Import):
                for a in s.names:
                    target = a.name.replace(".", "::")
                    scope.imports[a.asname or a.name.split(".")[0]] = target if a.asname or "." not in a.name else a.name.split(".")[0]
                    if top:
                        out.refs.append(Ref(join(module, MODULE), MODULE, "Imports", "Module", target))
            elif isinstance(s, (ast.If, ast.Try)):
                imports([x for x in ast.iter_child_nodes(s) if isinstance(x, ast.stmt)], top)

    imports(tree.body, True)

    def declared(body: list[ast.stmt]) -> None:
        for s in body:
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                scope.locals.add(s.name)
            elif isinstance(s, (ast.Assign, ast.AnnAssign)) and s.value is not None and _calls(s.value):
                targets = s.targets if isinstance(s, ast.Assign) else [s.target]
                scope.locals.update(t.id for t in targets if isinstance(t, ast.Name))

    declared(tree.body)

    def refs_in(node: ast.AST, owner: str, cls: str | None) -> None:
        for x in [node, *_own(node)]:
            if not isinstance(x, ast.Call):
                continue
            f = x.func
            while isinstance(f, ast.Call):
                f = f.func
            if isinstance(f, ast.Name):
                tag, target = scope.bare(f.id)
                out.refs.append(Ref(owner, f.id, "Calls", tag, target))
            elif isinstance(f, ast.Attribute):
                base = f.value
                if isinstance(base, ast.Name) and base.id in ("self", "cls") and cls:
                    out.refs.append(Ref(owner, f"{cls}::{f.attr}", "Calls", "Module", module))
                elif isinstance(base, ast.Name) and base.id in scope.locals and base.id not in scope.imports:
                    out.refs.append(Ref(owner, f"{base.id}::{f.attr}", "Calls", "Module", module))
                elif isinstance(base, ast.Name):
                    tag, target = scope.qualified(base.id)
                    if tag == "Module" and base.id[:1].isupper():
                        out.refs.append(Ref(owner, f"{base.id}::{f.attr}", "Calls", tag, target))
                    else:
                        out.refs.append(Ref(owner, f.attr, "Calls", tag, target))
                else:
                    out.refs.append(Ref(owner, f.attr, "Calls", "Opaque", ""))

    frameworks = set((config or {}).get("api_frameworks", ("fastapi", "flask")))

    def routes(s: ast.FunctionDef | ast.AsyncFunctionDef, path: str) -> None:
        for d in s.decorator_list:
            if not (isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str)):
                continue
            verb = d.func.attr
            if verb == "route" and "flask" in frameworks:
                methods = next((k.value for k in d.keywords if k.arg == "methods"), None)
                first = next((e.value for e in getattr(methods, "elts", []) if isinstance(e, ast.Constant)), "GET")
                out.contracts.append(ContractRef("ApiRoute", f"{str(first).upper()} {d.args[0].value}", path, "produces"))
            elif verb in VERBS and frameworks & {"fastapi", "flask"}:
                out.contracts.append(ContractRef("ApiRoute", f"{verb.upper()} {d.args[0].value}", path, "produces"))

    def function(s, prefix: str, cls: str | None) -> None:
        path = join(prefix, s.name)
        first = min([s.lineno, *(d.lineno for d in s.decorator_list)])
        out.symbols.append(Symbol("Function", path, s.lineno if not s.decorator_list else first + len(s.decorator_list), s.end_lineno or s.lineno, is_test=s.name.startswith("test"), owner=cls))
        out.symbols[-1].line = s.lineno
        routes(s, path)
        for part in [*s.body, s.args]:
            refs_in(part, path, cls)

    def walk(body: list[ast.stmt]) -> None:
        for s in body:
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                function(s, module, None)
            elif isinstance(s, ast.ClassDef):
                out.symbols.append(Symbol("Type", join(module, s.name), s.lineno, s.end_lineno or s.lineno))
                for m in s.body:
                    if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        function(m, join(module, s.name), s.name)
                    else:
                        refs_in(m, join(module, s.name), s.name)
            else:
                if isinstance(s, (ast.Assign, ast.AnnAssign)) and s.value is not None and _calls(s.value):
                    for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                        if isinstance(t, ast.Name):
                            out.symbols.append(Symbol("Field", join(module, t.id), s.lineno, s.end_lineno or s.lineno))
                            refs_in(s.value, join(module, t.id), None)
                if not isinstance(s, (ast.Import, ast.ImportFrom)):
                    refs_in(s, join(module, MODULE), None)

    walk(tree.body)
    return out
