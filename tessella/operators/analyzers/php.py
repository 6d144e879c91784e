"""PHP sources: namespaces, classes, interfaces, traits, functions, and what Laravel makes of them."""

from __future__ import annotations

import re

from tessella.functions.text import ACTION_VERBS, PREFIX_VERBS, RELATION_TYPES
from tessella.operators.analyzers import chunk, lines_of
from tessella.operators.analyzers.scan import Token, end_line, matching, scanner, split_top, text_of, tokens

LANGUAGE = "php"
PATTERN = scanner(strings=r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|<<<['\"]?(?P<h>\w+)['\"]?\n.*?\n[ \t]*(?P=h)\b", line_comments=r"//|\#(?!\[)", variables=True, between=r"\?>.*?(?:<\?(?:php\b|=)?|\Z)")
MODIFIERS = {"public", "protected", "private", "static", "abstract", "final", "readonly", "var"}
#: Methods of a resource controller, and routes that a resource makes as (verb, suffix, action).
RESOURCE_ACTIONS = ["index", "create", "store", "show", "edit", "update", "destroy"]
RESOURCE_ROUTES = [("GET", "", "index"), ("GET", "/create", "create"), ("POST", "", "store"), ("GET", "/{id}", "show"), ("GET", "/{id}/edit", "edit"), ("PUT", "/{id}", "update"), ("DELETE", "/{id}", "destroy")]
ROUTE_VERBS = {"get", "post", "put", "patch", "delete", "options", "any"}
MODEL_LISTS = ["fillable", "guarded", "dates", "hidden", "visible", "appends"]


# ---- documentation comments ------------------------------------------------------------------------------------------


def phpdoc(comment: str) -> dict:
    """Description and tags of a documentation comment."""
    lines = [re.sub(r"^\s*\*? ?", "", x).rstrip() for x in re.sub(r"^/\*\*|\*/$", "", comment.strip()).split("\n")]
    out: dict = {"description": "", "params": [], "returns": [], "throws": [], "var": "", "deprecated": "", "see": [], "examples": []}
    blocks: list[list[str]] = [[]]
    for line in lines:
        if line.lstrip().startswith("@"):
            blocks.append([line.strip()])
        else:
            blocks[-1].append(line)
    out["description"] = "\n".join(x for x in (y.strip() for y in blocks[0]) if x)
    for block in blocks[1:]:
        tag, _, rest = " ".join(x.strip() for x in block if x.strip()).partition(" ")
        first, _, more = rest.strip().partition(" ")
        if tag == "@param":
            name, _, about = more.strip().partition(" ")
            out["params"].append({"name": name.lstrip("&.").lstrip("$"), "type": first, "description": about.strip()} if name.startswith(("$", "&", ".")) else {"name": first.lstrip("$"), "type": "", "description": more.strip()} if first.startswith("$") else {"name": name, "type": first, "description": about.strip()})
        elif tag == "@return":
            out["returns"].append({"type": first, "description": more.strip()})
        elif tag == "@throws":
            out["throws"].append(first)
        elif tag == "@var":
            out["var"] = first
        elif tag == "@deprecated":
            out["deprecated"] = rest.strip() or "deprecated"
        elif tag == "@see":
            out["see"].append(rest.strip())
        elif tag == "@example":
            out["examples"].append("\n".join(block)[len("@example") :].strip())
    return out


# ---- syntax ----------------------------------------------------------------------------------------------------------


def qualified(toks: list[Token], i: int) -> tuple[str, int]:
    """A name with backslashes that begins at i, and where it ends."""
    out = ""
    while i < len(toks) and (toks[i].text == "\\" or toks[i].kind == "word" and not toks[i].text.startswith("$")):
        if toks[i].kind == "word" and out and not out.endswith("\\"):
            break
        out += toks[i].text
        i += 1
    return out, i


def value_of(toks: list[Token], source: str) -> object:
    """A literal as a value: string, list, map; other expressions as text."""
    if len(toks) == 1 and toks[0].kind == "string" and toks[0].text[0] in "'\"":
        return re.sub(r"\\([\\'\"])", r"\1", toks[0].text[1:-1])
    inner = None
    if toks and toks[0].text == "[" and matching(toks, 0) == len(toks) - 1:
        inner = toks[1:-1]
    elif len(toks) > 1 and toks[0].text == "array" and toks[1].text == "(":
        inner = toks[2:-1]
    if inner is None:
        return text_of(toks, source)
    pairs, items = {}, []
    for run in split_top(inner):
        halves = split_top(run, "=>")
        if len(halves) == 2:
            pairs[str(value_of(halves[0], source))] = value_of(halves[1], source)
        else:
            items.append(value_of(run, source))
    return pairs or items


def params(toks: list[Token], source: str, doc: dict) -> list[dict]:
    told = {p["name"]: p for p in doc["params"]}
    out = []
    for run in split_top(toks):
        at = next((i for i, t in enumerate(run) if t.kind == "word" and t.text.startswith("$")), None)
        if at is None:
            continue
        name = run[at].text[1:]
        hint = text_of([t for t in run[:at] if t.text not in MODIFIERS | {"&", "..."}], source)
        out.append({"name": name, "type": hint or told.get(name, {}).get("type", ""), "description": told.get(name, {}).get("description", ""), "optional": any(t.text == "=" for t in run[at:])})
    return out


class Parser:
    """Reads the declarations of one file."""

    def __init__(self, path: str, source: str) -> None:
        self.path, self.source = path, source
        at = source.find("<?")
        self.all = tokens(PATTERN, source, at + (5 if source[at : at + 5].lower() == "<?php" else 2)) if at >= 0 else []
        self.toks = [t for t in self.all if t.kind != "comment"]
        self.docs = {}
        last = None
        for t in self.all:
            if t.kind == "comment":
                last = t if t.text.startswith("/**") else last
            elif last is not None:
                self.docs[t.start] = last.text
                last = None
        self.namespace = "global"
        self.imports: dict[str, str] = {}
        self.types: list[dict] = []
        self.functions: list[dict] = []
        self.constants: list[dict] = []
        self.read(0, len(self.toks))

    def doc(self, t: Token) -> dict:
        return phpdoc(self.docs.get(t.start, "/** */"))

    def read(self, i: int, end: int) -> None:
        first = None
        while i < end:
            t = self.toks[i]
            word = t.text.lower() if t.kind == "word" else t.text
            if word == "#" and i + 1 < end and self.toks[i + 1].text == "[":
                i = matching(self.toks, i + 1)
            elif word == "namespace":
                self.namespace, i = qualified(self.toks, i + 1)
                self.namespace = self.namespace or "global"
                continue
            elif word == "use":
                stop = next((j for j in range(i, end) if self.toks[j].text == ";"), end - 1)
                self.use(self.toks[i + 1 : stop])
                i = stop
            elif word in ("abstract", "final", "readonly"):
                first = first or t
                i += 1
                continue
            elif word in ("class", "interface", "trait", "enum") and i + 1 < end and self.toks[i + 1].kind == "word" and self.toks[i - 1].text not in ("::", "new"):
                i = self.type(word, i, first or t)
            elif word == "function" and i + 1 < end and self.toks[i + 1].kind == "word":
                f, i = self.function(i, t, [])
                self.functions.append(f | {"namespace": self.namespace})
            elif word == "const":
                found, i = self.consts(i, end, t, [])
                self.constants += [c | {"namespace": self.namespace} for c in found]
            elif word == "function" or word == "class" and self.toks[i - 1].text != "::":
                i = self.nameless(i, end)
            elif t.text in ("(", "["):
                i = matching(self.toks, i)  # not "{": bodies of namespaces and conditions hold declarations, too
            first = None
            i += 1

    def use(self, toks: list[Token]) -> None:
        if toks and toks[0].text in ("function", "const"):
            return
        brace = next((i for i, t in enumerate(toks) if t.text == "{"), None)
        prefix = qualified(toks, 0)[0] if brace is not None else ""
        for run in split_top(toks[brace + 1 : -1] if brace is not None else toks):
            name, at = qualified(run, 0)
            full = (prefix + name).lstrip("\\")
            alias = run[at + 1].text if at + 1 < len(run) and run[at].text.lower() == "as" else full.split("\\")[-1]
            self.imports[alias] = full

    def nameless(self, i: int, end: int) -> int:
        """The last token of the closure or anonymous class at i."""
        i += 1
        while i < end and self.toks[i].text not in ("{", ";"):
            i = matching(self.toks, i) + 1 if self.toks[i].text in ("(", "[") else i + 1
        return matching(self.toks, i) if i < end and self.toks[i].text == "{" else i

    def consts(self, i: int, end: int, first: Token, modifiers: list[str]) -> tuple[list[dict], int]:
        """The constants of the declaration at `const`, and the place of its semicolon."""
        stop = next((k for k in range(i, end + 1) if k < len(self.toks) and self.toks[k].text == ";"), min(end, len(self.toks) - 1))
        out = []
        for run in split_top(self.toks[i + 1 : stop]):
            eq = next((k for k, x in enumerate(run) if x.text == "="), len(run))
            if eq:
                out.append({"name": run[eq - 1].text, "value": text_of(run[eq + 1 :], self.source), "doc": self.doc(first), "start": first.line, "end": self.toks[stop].line, "visibility": next((m for m in modifiers if m in ("public", "protected", "private")), "public")})
        return out, stop

    def function(self, i: int, first: Token, modifiers: list[str]) -> tuple[dict, int]:
        """A function at `function`, and the place of its last token."""
        i += 1
        if self.toks[i].text == "&":
            i += 1
        name, op = self.toks[i].text, i + 1
        cl = matching(self.toks, op)
        doc = self.doc(first)
        j = cl + 1
        while j < len(self.toks) and self.toks[j].text not in ("{", ";"):
            j += 1
        back = text_of([t for t in self.toks[cl + 1 : j] if t.text != ":"], self.source)
        end = matching(self.toks, j) if j < len(self.toks) and self.toks[j].text == "{" else min(j, len(self.toks) - 1)
        ps = params(self.toks[op + 1 : cl], self.source, doc)
        returns = back or (doc["returns"][0]["type"] if doc["returns"] else "")
        shown = ", ".join(f"{p['type']} ${p['name']}".strip() for p in ps)
        visibility = next((m for m in modifiers if m in ("public", "protected", "private")), "public")
        sig = " ".join([*(m for m in modifiers if m not in ("public", "protected", "private")), f"function {name}({shown})" + (f": {back}" if back else "")])
        return {"name": name, "params": ps, "returns": returns, "return_doc": doc["returns"], "doc": doc, "visibility": visibility, "static": "static" in modifiers, "abstract": "abstract" in modifiers, "final": "final" in modifiers, "signature": sig, "start": first.line, "end": end_line(self.toks[end]), "body": self.toks[j + 1 : end] if self.toks[j].text == "{" else []}, end

    def type(self, kind: str, i: int, first: Token) -> int:
        name = self.toks[i + 1].text
        op = next((j for j in range(i, len(self.toks)) if self.toks[j].text == "{"), len(self.toks) - 1)
        end = matching(self.toks, op)
        head = self.toks[i + 2 : op]
        named: dict[str, list[str]] = {"extends": [], "implements": []}
        at = ""
        j = 0
        while j < len(head):
            if head[j].text.lower() in named:
                at = head[j].text.lower()
                j += 1
            elif at and (head[j].kind == "word" or head[j].text == "\\"):
                full, j = qualified(head, j)
                named[at].append(full)
            else:
                j += 1
        before = {t.text for t in self.toks[max(0, i - 2) : i]}
        full = name if self.namespace == "global" else f"{self.namespace}\\{name}"
        out = {"kind": kind, "name": name, "full": full, "namespace": self.namespace, "imports": self.imports, "extends": named["extends"], "implements": named["implements"], "abstract": "abstract" in before, "final": "final" in before, "doc": self.doc(first), "start": first.line, "end": end_line(self.toks[end]), "methods": [], "properties": [], "constants": [], "traits": [], "path": self.path}
        j, modifiers, start, hint = op + 1, [], None, []
        while j < end:
            t = self.toks[j]
            low = t.text.lower()
            if t.text == "#" and self.toks[j + 1].text == "[":
                j = matching(self.toks, j + 1)
            elif low in MODIFIERS:
                modifiers.append(low)
                start = start or t
            elif low == "use":
                stop = next(k for k in range(j, end + 1) if self.toks[k].text in (";", "{"))
                out["traits"] += [qualified(r, 0)[0] for r in split_top(self.toks[j + 1 : stop])]
                j = matching(self.toks, stop) if self.toks[stop].text == "{" else stop
            elif low == "function":
                f, j = self.function(j, start or t, modifiers)
                out["methods"].append(f)
                modifiers, start, hint = [], None, []
            elif low == "const":
                found, stop = self.consts(j, end, start or t, modifiers)
                out["constants"] += found
                j, modifiers, start, hint = stop, [], None, []
            elif t.kind == "word" and t.text.startswith("$") and (modifiers or hint):
                stop, depth = j, 0
                while stop < end and not (self.toks[stop].text == ";" and depth == 0):
                    depth += self.toks[stop].text in ("(", "[", "{")
                    depth -= self.toks[stop].text in (")", "]", "}")
                    stop += 1
                eq = next((k for k in range(j, stop) if self.toks[k].text == "="), stop)
                doc = self.doc(start or t)
                out["properties"].append({"name": t.text[1:], "type": text_of(hint, self.source) or doc["var"], "visibility": next((m for m in modifiers if m in ("public", "protected", "private")), "public"), "static": "static" in modifiers, "readonly": "readonly" in modifiers, "value": value_of(self.toks[eq + 1 : stop], self.source) if stop > eq else None, "doc": doc, "start": (start or t).line, "end": self.toks[stop].line})
                j, modifiers, start, hint = stop, [], None, []
            elif t.text == ";":
                modifiers, start, hint = [], None, []
            elif t.text in ("{", "(", "["):
                j = matching(self.toks, j)
            elif modifiers:
                hint.append(t)
            j += 1
        self.types.append(out)
        return end


# ---- Laravel ---------------------------------------------------------------------------------------------------------


def resolve(name: str, of: dict) -> str:
    """A class name in full: by the imports, else in the namespace."""
    name = name.removesuffix("::class").lstrip("\\")
    if not name or "\\" in name:
        return name
    return of["imports"].get(name) or (name if of["namespace"] in ("", "global") else f"{of['namespace']}\\{name}")


def is_model(t: dict) -> bool:
    return t["kind"] == "class" and any(resolve(x, t).split("\\")[-1] in ("Model", "Authenticatable", "Pivot") or resolve(x, t) == "Illuminate\\Foundation\\Auth\\User" for x in t["extends"])


def this_call(body: list[Token]) -> tuple[str, list[list[Token]]] | None:
    """The first $this->relation(...) of a body: its kind and arguments."""
    for i in range(len(body) - 3):
        if body[i].text == "$this" and body[i + 1].text == "->" and body[i + 2].text in RELATION_TYPES and body[i + 3].text == "(":
            return body[i + 2].text, split_top(body[i + 4 : matching(body, i + 3)])
    return None


def snake(name: str) -> str:
    return re.sub(r"(?<!^)([A-Z])", r"_\1", name).lower()


def model(t: dict, source: str) -> dict:
    """What Eloquent sees in a class."""
    props = {p["name"]: p["value"] for p in t["properties"]}
    listed = lambda k: [str(x) for x in props[k]] if isinstance(props.get(k), list) else []
    relations, scopes, attributes = [], [], []
    for m in t["methods"]:
        if found := this_call(m["body"]):
            kind, args = found
            text = [str(value_of(a, source)) for a in args]
            relations.append({"name": m["name"], "type": kind, "related_model": resolve(text[0], t) if text else "", "foreign_key": text[1] if len(text) > 1 else "", "local_key": text[2] if len(text) > 2 else "", "description": m["doc"]["description"], "start_line": m["start"], "end_line": m["end"]})
        name = m["name"]
        if name.startswith("scope") and len(name) > 5:
            scopes.append({"name": name[5].lower() + name[6:], "method_name": name, "start_line": m["start"], "end_line": m["end"]})
        if (hit := re.fullmatch("(get|set)(.+)Attribute", name)) and len(name) > 12:
            attributes.append({"name": snake(hit[2]), "method_name": name, "type": "accessor" if hit[1] == "get" else "mutator"})
    casts = props.get("casts")
    return {"class_name": t["name"], "namespace": t["namespace"], "full_name": t["full"], "table": props.get("table") or "", "primary_key": props.get("primaryKey") or "id", **{k: listed(k) for k in MODEL_LISTS}, "casts": {k: str(v) for k, v in casts.items()} if isinstance(casts, dict) else {}, "timestamps": str(props.get("timestamps", "true")).lower() != "false", "soft_deletes": any(x.split("\\")[-1] == "SoftDeletes" for x in t["traits"]), "relations": relations, "scopes": scopes, "attributes": attributes}


def verbs(action: str) -> list[str]:
    low = action.lower()
    return ACTION_VERBS.get(low) or next((v for p, v in PREFIX_VERBS if low.startswith(p)), [])


def is_controller(t: dict) -> bool:
    return t["kind"] == "class" and ("Controllers" in t["namespace"] or any(x in ("Controller", "BaseController", "ApiController") or x.endswith("\\Controller") for x in t["extends"]))


def middleware(t: dict, source: str) -> list[str]:
    """What the constructor of a controller names in $this->middleware(...)."""
    out = []
    for body in (m["body"] for m in t["methods"] if m["name"] == "__construct"):
        for i in range(len(body) - 3):
            if [x.text for x in body[i : i + 4]] == ["$this", "->", "middleware", "("]:
                for value in (value_of(a, source) for a in split_top(body[i + 4 : matching(body, i + 3)])):
                    out += map(str, value) if isinstance(value, list) else [str(value)]
    return out


def controller(t: dict, source: str) -> dict:
    names = {m["name"] for m in t["methods"]}
    actions = [{"name": m["name"], "description": m["doc"]["description"], "http_methods": verbs(m["name"]), "parameters": [p["name"] for p in m["params"]], "returns": m["returns"], "start_line": m["start"], "end_line": m["end"]} for m in t["methods"] if m["visibility"] == "public" and not m["name"].startswith("__")]
    is_api = any(x in t["namespace"] for x in ("\\Api", "\\API")) or t["name"].endswith("ApiController") or any(x in t["path"] for x in ("/Api/", "/API/"))
    return {"class_name": t["name"], "full_name": t["full"], "base_controller": ", ".join(t["extends"]), "is_resource": len(names & set(RESOURCE_ACTIONS)) >= 4, "is_api": is_api, "actions": actions, "middleware": middleware(t, source)}


def target(arg: list[Token], source: str, imports: dict[str, str]) -> tuple[str, str]:
    """(controller, action) of a route's last argument."""
    v = value_of(arg, source)
    if isinstance(v, list) and v:
        name = str(v[0]).removesuffix("::class").lstrip("\\")
        return imports.get(name, name), str(v[1]) if len(v) > 1 else "__invoke"
    if arg and arg[0].kind == "string" and "@" in arg[0].text:
        c, _, a = arg[0].text[1:-1].partition("@")
        return c, a
    if isinstance(v, str) and v.endswith("::class"):
        name = v.removesuffix("::class").lstrip("\\")
        return imports.get(name, name), "__invoke"
    return "Closure", ""


def prefixes(toks: list[Token]) -> list[tuple[int, int, str]]:
    """(first token, last token, prefix) of every group of routes: Route::prefix('x')->...->group(...) or Route::group(['prefix' => 'x'], ...)."""
    out = []
    for i in range(len(toks) - 3):
        if toks[i].text != "Route" or toks[i + 1].text != "::" or toks[i + 3].text != "(":
            continue
        at, found = i + 2, ""
        while at + 1 < len(toks) and toks[at + 1].text == "(":
            end = matching(toks, at + 1)
            if toks[at].text == "prefix" and toks[at + 2].kind == "string":
                found = toks[at + 2].text[1:-1]
            elif toks[at].text == "group":
                for j in range(at + 2, min(end, len(toks) - 2)):
                    if toks[j].text in ("function", "fn"):
                        break
                    if toks[j].kind == "string" and toks[j].text[1:-1] == "prefix" and toks[j + 1].text == "=>" and toks[j + 2].kind == "string":
                        found = toks[j + 2].text[1:-1]
                out.append((at, end, found.strip("/")))
            if end + 1 >= len(toks) or toks[end + 1].text not in ("->", "?->"):
                break
            at = end + 2
    return out


def routes(p: Parser) -> list[dict]:
    """Routes that a file declares by Route::verb(...), below the prefixes of the groups around them."""
    out, toks = [], p.toks
    groups = prefixes(toks)
    for i in range(len(toks) - 3):
        if toks[i].text != "Route" or toks[i + 1].text != "::" or toks[i + 3].text != "(":
            continue
        verb, args = toks[i + 2].text, split_top(toks[i + 4 : matching(toks, i + 3)])
        line = toks[i].line

        around = [g for lo, hi, g in groups if lo < i < hi and g]

        def add(method: str, uri: str, to: tuple[str, str], line: int = line, around: list[str] = around) -> None:
            uri = "/" + "/".join(x for x in (*around, uri.strip("/")) if x) if around else uri
            out.append({"method": method, "uri": uri, "controller": to[0], "action": to[1], "middleware": [], "file_path": p.path, "line": line, "description": f"Route {method} {uri} -> {to[0]}" + (f"@{to[1]}" if to[1] else "")})

        if verb in ROUTE_VERBS and args:
            add(verb.upper(), str(value_of(args[0], p.source)), target(args[-1], p.source, p.imports) if len(args) > 1 else ("", ""))
        elif verb == "match" and len(args) > 2:
            for m in value_of(args[0], p.source) or []:
                add(str(m).upper(), str(value_of(args[1], p.source)), target(args[2], p.source, p.imports))
        elif verb in ("resource", "apiResource") and len(args) > 1:
            name, to = str(value_of(args[0], p.source)), target(args[1], p.source, p.imports)[0]
            for m, suffix, action in RESOURCE_ROUTES:
                if verb == "resource" or action not in ("create", "edit"):
                    add(m, f"/{name.strip('/')}{suffix}", (to, action))
    return out


# ---- chunks ----------------------------------------------------------------------------------------------------------


def analyze(path: str, content: str) -> list[dict]:
    """Symbols of a file; models and controllers carry what the framework makes of them, route files their routes."""
    p = Parser(path, content)
    out: list[dict] = []
    base = {"language": LANGUAGE, "path": path, "package": p.namespace}
    for t in p.types:
        code = lines_of(content, t["start"], min(t["end"], t["start"] + 50))
        sig = " ".join(x for x in ("abstract" if t["abstract"] else "", "final" if t["final"] else "", t["kind"], t["name"], "extends " + ", ".join(t["extends"]) if t["extends"] else "", "implements " + ", ".join(t["implements"]) if t["implements"] else "") if x)
        meta = {"full_name": t["full"], "extends": t["extends"], "implements": t["implements"], "traits": t["traits"], "imports": t["imports"], "is_abstract": t["abstract"], "is_final": t["final"]}
        if is_model(t):
            meta["eloquent"] = model(t, content)
        elif is_controller(t):
            meta["controller"] = controller(t, content)
        at = base | {"package": t["namespace"]}
        out.append(chunk(t["kind"], t["name"], start=t["start"], end=t["end"], signature=sig, docstring=t["doc"]["description"], code=code, **meta, **at))
        for m in t["methods"]:
            out.append(chunk("method", m["name"], start=m["start"], end=m["end"], signature=m["signature"], docstring=m["doc"]["description"], code=lines_of(content, m["start"], m["end"]), class_name=t["name"], visibility=m["visibility"], is_static=m["static"], is_abstract=m["abstract"], params=m["params"], returns=m["returns"], throws=m["doc"]["throws"], deprecated=m["doc"]["deprecated"], **at))
        for x in t["properties"]:
            out.append(chunk("property", x["name"], start=x["start"], end=x["end"], signature=" ".join(y for y in (x["visibility"], "static" if x["static"] else "", x["type"], f"${x['name']}") if y), docstring=x["doc"]["description"], code=lines_of(content, x["start"], x["end"]), class_name=t["name"], visibility=x["visibility"], property_type=x["type"], **at))
        for x in t["constants"]:
            out.append(chunk("constant", x["name"], start=x["start"], end=x["end"], signature=f"const {x['name']} = {x['value']}", docstring=x["doc"]["description"], code=x["value"], class_name=t["name"], **at))
    for f in p.functions:
        out.append(chunk("function", f["name"], start=f["start"], end=f["end"], signature=f["signature"], docstring=f["doc"]["description"], code=lines_of(content, f["start"], f["end"]), params=f["params"], returns=f["returns"], **(base | {"package": f["namespace"]})))
    for x in p.constants:
        out.append(chunk("constant", x["name"], start=x["start"], end=x["end"], signature=f"const {x['name']} = {x['value']}", docstring=x["doc"]["description"], code=x["value"], **(base | {"package": x["namespace"]})))
    for r in routes(p):
        out.append(chunk("route", f"{r['method']} {r['uri']}", start=r["line"], end=r["line"], signature=f"{r['method']} {r['uri']}", docstring=r["description"], code=lines_of(content, r["line"], r["line"]), route=r, **base))
    return out
