"""Python sources, by the standard library's syntax tree."""

from __future__ import annotations

import ast
import re

from tessella.operators.analyzers import chunk, lines_of

LANGUAGE = "python"
#: Base classes that tell the kind of a class.
ENUMS = {"Enum", "IntEnum", "StrEnum", "Flag", "IntFlag"}
#: Names that aren't counted as calls or as types.
BUILTIN_CALLS = set("print len range str int float bool list dict set tuple type isinstance issubclass hasattr getattr setattr delattr open input super property staticmethod classmethod enumerate zip map filter sorted reversed min max sum abs round any all next iter".split())
BUILTIN_TYPES = set("str int float bool bytes list List dict Dict set Set tuple Tuple None Any Optional Union Callable Type Sequence Mapping Iterable Iterator Generator Coroutine Awaitable AsyncIterator Self TypeVar Generic".split())
LONGEST = 101


def module_name(path: str) -> str:
    """The file's name without extension; of __init__.py the folder's."""
    parts = path.split("/")
    name = parts[-1].removesuffix(".py")
    return parts[-2] if name == "__init__" and len(parts) > 1 else name


def parameters(node: ast.FunctionDef | ast.AsyncFunctionDef) -> list[dict]:
    a = node.args
    named = [("", x) for x in (*a.posonlyargs, *a.args)] + ([("*", a.vararg)] if a.vararg else []) + [("", x) for x in a.kwonlyargs] + ([("**", a.kwarg)] if a.kwarg else [])
    return [{"name": star + x.arg, "type": ast.unparse(x.annotation) if x.annotation else ""} for star, x in named]


def signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    shown = ", ".join(p["name"] + (f": {p['type']}" if p["type"] else "") for p in parameters(node))
    back = f" -> {ast.unparse(node.returns)}" if node.returns else ""
    return f"{'async ' if isinstance(node, ast.AsyncFunctionDef) else ''}def {node.name}({shown}){back}"


def decorators(node) -> list[str]:
    return [ast.unparse(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list]


def calls(node) -> list[dict]:
    """Distinct calls of a body in order of lines: by self, cls, super(), a class, or plain."""
    out: dict[tuple, dict] = {}
    found = sorted((n for stmt in node.body for n in ast.walk(stmt) if isinstance(n, ast.Call)), key=lambda n: (n.lineno, n.col_offset))
    for n in found:
        f, receiver, owner = n.func, "", ""
        if isinstance(f, ast.Attribute):
            v = f.value
            if isinstance(v, ast.Name) and (v.id in ("self", "cls") or v.id[:1].isupper()):
                receiver, owner = v.id, v.id if v.id[:1].isupper() else ""
            elif isinstance(v, ast.Call) and isinstance(v.func, ast.Name) and v.func.id == "super":
                receiver = "super()"
            else:
                continue
            name = f.attr
        elif isinstance(f, ast.Name) and f.id not in BUILTIN_CALLS:
            name = f.id
        else:
            continue
        out.setdefault((receiver, name), {"name": name, "receiver": receiver, "class_name": owner, "line": n.lineno})
    return list(out.values())


def types_in(text: str) -> list[str]:
    """Names of an annotation that aren't builtin, in order."""
    return list(dict.fromkeys(x for x in re.findall(r"[A-Za-z_][\w.]*", text) if x not in BUILTIN_TYPES))


def type_deps(node) -> list[str]:
    texts = [p["type"] for p in parameters(node)] + ([ast.unparse(node.returns)] if node.returns else [])
    return list(dict.fromkeys(x for t in texts for x in types_in(t)))


def is_constant(name: str) -> bool:
    return name[:1].isupper() and name.upper() == name


def assigned(node, where: str) -> list[tuple[str, str, str, int]]:
    """(name, type, value, line) of the assignments to names of a body."""
    out = []
    for s in node.body:
        if isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name) and not isinstance(s.value, ast.Lambda):
            out.append((s.targets[0].id, "", ast.get_source_segment(where, s.value) or "", s.lineno))
        elif isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name):
            out.append((s.target.id, ast.unparse(s.annotation), (ast.get_source_segment(where, s.value) or "") if s.value else "", s.lineno))
    return out


def imports(tree: ast.AST) -> list[dict]:
    out = []
    for n in sorted((n for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom))), key=lambda n: n.lineno):
        if isinstance(n, ast.Import):
            out += [{"module": a.name, "alias": a.asname or "", "names": [], "is_from": False, "line": n.lineno} for a in n.names]
        else:
            out.append({"module": "." * n.level + (n.module or ""), "alias": "", "names": [a.name for a in n.names if a.name != "*"], "is_from": True, "line": n.lineno})
    return out


FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)


def methods_of(node: ast.ClassDef) -> list:
    return [m for m in node.body if isinstance(m, FUNCTION)]


def properties(methods: list) -> list[dict]:
    """Properties by name: which of getter, setter and deleter there are."""
    out: dict[str, dict] = {}
    for m in methods:
        for d in decorators(m):
            base, _, part = d.rpartition(".")
            part = "getter" if d in ("property", "functools.cached_property", "cached_property") else part if base and part in ("setter", "deleter") else ""
            if part:
                p = out.setdefault(base if part != "getter" else m.name, {"type": "", "doc": "", "start": m.lineno, "end": m.end_lineno, "getter": False, "setter": False, "deleter": False})
                p[part] = True
                if part == "getter":
                    p |= {"type": ast.unparse(m.returns) if m.returns else "", "doc": ast.get_docstring(m) or ""}
    return [{"name": k, **v} for k, v in out.items()]


def analyze(path: str, content: str) -> list[dict]:
    """Classes, methods, properties, functions, constants and variables of a module; a ValueError for a text that isn't Python."""
    try:
        tree = ast.parse(content)
    except SyntaxError as e:
        raise ValueError(f"line {e.lineno}: {e.msg}") from e
    package, out = module_name(path), []
    base = {"language": LANGUAGE, "path": path, "package": package}

    def code(n) -> str:
        return lines_of(content, n.lineno, min(n.end_lineno, n.lineno + LONGEST - 1))

    found_imports = imports(tree)
    for n in tree.body:
        if isinstance(n, ast.ClassDef):
            bases, decs = [ast.unparse(b) for b in n.bases], decorators(n)
            meta = next((ast.unparse(k.value) for k in n.keywords if k.arg == "metaclass"), "")
            methods = methods_of(n)
            deps = list(dict.fromkeys([x for b in bases for x in types_in(b)] + [x for m in methods for x in type_deps(m)] + [c["class_name"] for m in methods for c in calls(m) if c["class_name"]]))
            listed = ", ".join(bases + ([f"metaclass={meta}"] if meta else []))
            out.append(chunk("class", n.name, start=n.lineno, end=n.end_lineno, signature=f"class {n.name}" + (f"({listed})" if listed else ""), docstring=ast.get_docstring(n) or "", code=code(n), bases=bases, decorators=decs,
                             is_abstract=meta in ("ABCMeta", "abc.ABCMeta") or any(b in ("ABC", "abc.ABC") or "Abstract" in b for b in bases), is_dataclass=any(d in ("dataclass", "dataclasses.dataclass") for d in decs),
                             is_enum=any(b.split(".")[-1] in ENUMS for b in bases), is_protocol=any(b in ("Protocol", "typing.Protocol") for b in bases), is_mixin="Mixin" in n.name or any("Mixin" in b for b in bases), metaclass=meta, dependencies=[d for d in deps if d != n.name],
                             class_vars=[{"name": a, "type": t, "value": v} for a, t, v, _ in assigned(n, content)], imports=found_imports, **base))
            for m in methods:
                decs = decorators(m)
                if any(d == "property" or d.endswith((".setter", ".deleter", "cached_property")) for d in decs):
                    continue
                out.append(chunk("method", m.name, start=m.lineno, end=m.end_lineno, signature=signature(m), docstring=ast.get_docstring(m) or "", code=code(m), class_name=n.name, is_static="staticmethod" in decs, is_classmethod="classmethod" in decs,
                                 is_abstract=any(d.endswith("abstractmethod") for d in decs), is_async=isinstance(m, ast.AsyncFunctionDef), decorators=decs, params=parameters(m), calls=calls(m), type_deps=type_deps(m), **base))
            out += [chunk("property", p["name"], start=p["start"], end=p["end"], signature=f"@property {p['name']}: {p['type']}", docstring=p["doc"], class_name=n.name, has_getter=p["getter"], has_setter=p["setter"], has_deleter=p["deleter"], **base) for p in properties(methods)]
        elif isinstance(n, FUNCTION):
            makes = any(isinstance(x, (ast.Yield, ast.YieldFrom)) for x in ast.walk(n))
            out.append(chunk("function", n.name, start=n.lineno, end=n.end_lineno, signature=signature(n), docstring=ast.get_docstring(n) or "", code=code(n), is_async=isinstance(n, ast.AsyncFunctionDef), is_generator=makes, decorators=decorators(n), params=parameters(n), calls=calls(n), type_deps=type_deps(n), **base))
    for name, kind, value, line in assigned(tree, content):
        constant = is_constant(name)
        out.append(chunk("const" if constant else "var", name, start=line, end=line, signature=f"{name}: {kind} = {value}" if constant else f"{name}: {kind}", code=value if constant else "", **base))
    return out
