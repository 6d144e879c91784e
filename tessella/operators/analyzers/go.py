"""Go sources: exported functions, methods, types, constants and variables."""

from __future__ import annotations

import re

from tessella.operators.analyzers import chunk, lines_of
from tessella.operators.analyzers.scan import Token, end_line, matching, scanner, split_top, text_of, tokens

LANGUAGE = "go"
PATTERN = scanner(strings=r'`[^`]*`|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'', line_comments="//")


def exported(name: str) -> bool:
    return name[:1].isupper()


def doc_text(comments: list[Token]) -> str:
    """The text of the comments right above a declaration."""
    out = []
    for c in comments:
        body = c.text[2:] if c.text.startswith("//") else c.text[2:-2]
        out += [x.strip() for x in body.split("\n")]
    return "\n".join(x for x in out if x)


def fields(toks: list[Token], source: str) -> list[dict]:
    """Parameters or results: names with types; `a, b int` gives both the type."""
    runs = split_top(toks)
    named = any(len(r) > 1 and r[0].kind == "word" and r[1].text not in (".", "(", "[") or len(r) > 2 and r[0].kind == "word" and r[1].text == "[" and r[2].text == "]" for r in runs)
    if any(r[0].text in ("func", "map", "chan", "struct", "interface") for r in runs) and not any(len(r) > 1 and r[0].kind == "word" and r[1].kind == "word" and r[0].text not in ("chan", "map", "func") for r in runs):
        named = False
    out: list[dict] = []
    for r in runs:
        if named and len(r) > 1:
            out.append({"name": r[0].text, "type": text_of(r[1:], source)})
        elif named:
            out.append({"name": r[0].text, "type": ""})
        else:
            out.append({"name": "", "type": text_of(r, source)})
    kind = ""
    for f in reversed(out):
        kind = f["type"] or kind
        f["type"] = kind
    return out


def struct_fields(toks: list[Token], source: str) -> list[dict]:
    """Fields of a struct body, a line each."""
    by_line: dict[int, list[Token]] = {}
    depth, line = 0, 0
    for t in toks:
        if t.kind == "comment":
            continue
        line = t.line if depth == 0 else line
        by_line.setdefault(line, []).append(t)
        if t.kind == "sign":
            depth += t.text in ("{", "(", "[")
            depth -= t.text in ("}", ")", "]")
    out = []
    for run in by_line.values():
        tag = run[-1].text if run[-1].kind == "string" else ""
        run = run[:-1] if tag else run
        if not run:
            continue
        names, i = [run[0].text], 1
        while i + 1 < len(run) and run[i].text == ",":
            names.append(run[i + 1].text)
            i += 2
        rest = text_of(run[i:], source)
        out += [{"name": n, "type": rest, "tag": tag} for n in names] if rest and run[0].kind == "word" and run[1].text != "." else [{"name": "", "type": text_of(run, source), "tag": tag}]
    return out


def analyze(path: str, content: str) -> list[dict]:
    """Exported declarations of a file; constructors and typed constants are among them. Test files give nothing."""
    if path.endswith("_test.go"):
        return []
    toks = tokens(PATTERN, content)
    plain = [t for t in toks if t.kind != "comment"]
    package = next((b.text for a, b in zip(plain, plain[1:], strict=False) if a.text == "package"), "")
    by_end = {end_line(t): t for t in toks if t.kind == "comment"}
    base = {"language": LANGUAGE, "path": path, "package": package}
    out: list[dict] = []
    imports: list[str] = []
    methods: dict[str, list[str]] = {}

    def doc(t: Token) -> str:
        above, line = [], t.line - 1
        while line in by_end and by_end[line].line > 0:
            above.append(by_end[line])
            line = by_end[line].line - 1
        return doc_text(above[::-1])

    def emit(kind: str, name: str, first: Token, last: Token, signature: str, about: Token, code: str | None = None, **meta) -> None:
        out.append(chunk(kind, name, start=first.line, end=end_line(last), signature=signature, docstring=doc(about), code=lines_of(content, first.line, end_line(last)) if code is None else code, **meta, **base))

    def specs(i: int) -> tuple[list[list[Token]], int]:
        """Runs of tokens of a declaration, grouped or single, and where it ends."""
        if plain[i + 1].text == "(":
            end = matching(plain, i + 1)
            runs, run, depth = [], [], 0
            for t in plain[i + 2 : end]:
                if run and depth == 0 and t.line > end_line(run[-1]):
                    runs.append(run)
                    run = []
                run.append(t)
                if t.kind == "sign":
                    depth += t.text in ("(", "[", "{")
                    depth -= t.text in (")", "]", "}")
            return [*runs, run] if run else runs, end
        j, depth = i + 1, 0
        while j < len(plain):
            t = plain[j]
            if j > i + 1 and depth == 0 and t.line > end_line(plain[j - 1]) and plain[j - 1].text not in ("=", ","):
                break
            if t.kind == "sign":
                depth += t.text in ("(", "[", "{")
                depth -= t.text in (")", "]", "}")
            j += 1
        return [plain[i + 1 : j]], j - 1

    i = 0
    while i < len(plain):
        t = plain[i]
        if t.text == "import" and i + 1 < len(plain):
            runs, i = specs(i)
            imports += [r[-1].text.strip('"`') for r in runs]
        elif t.text == "func" and i + 2 < len(plain):
            j, receiver, owner = i + 1, "", ""
            if plain[j].text == "(":
                end = matching(plain, j)
                receiver = text_of(plain[j + 1 : end], content)
                owner = re.sub(r"\[.*", "", receiver).split(" ")[-1].lstrip("*")
                j = end + 1
            name = plain[j].text
            if plain[j + 1].text == "[":
                j = matching(plain, j + 1) - 0
            op = j + 1
            cl = matching(plain, op)
            k = cl + 1
            if k < len(plain) and plain[k].text == "(":
                rend = matching(plain, k)
                results, k = fields(plain[k + 1 : rend], content), rend + 1
            else:
                start = k
                while k < len(plain) and plain[k].text != "{" and plain[k].line == plain[cl].line:
                    k = matching(plain, k) + 1 if plain[k].text in ("(", "[") else k + 2 if plain[k].text in ("interface", "struct") and plain[k + 1].text == "{" else k + 1
                results = [{"name": "", "type": text_of(plain[start:k], content)}] if k > start else []
            head = plain[i:k]
            end = matching(plain, k) if k < len(plain) and plain[k].text == "{" else k - 1
            if exported(name) and (not owner or exported(owner)):
                emit("method" if owner else "function", name, t, plain[end], text_of(head, content), t, params=fields(plain[op + 1 : cl], content), returns=results, receiver=receiver, class_name=owner)
                if owner:
                    methods.setdefault(owner, []).append(name)
            i = end
        elif t.text == "type" and i + 2 < len(plain):
            runs, end = specs(i)
            grouped = plain[i + 1].text == "("
            for r in runs:
                if not r or not exported(r[0].text):
                    continue
                k = 1
                if len(r) > 3 and r[1].text == "[" and r[2].kind == "word":
                    k = matching(r, 1) + 1
                kind = r[k].text if k < len(r) else ""
                first = r[0] if grouped else t
                meta: dict = {"form": kind if kind in ("struct", "interface") else "alias" if kind == "=" else "type", "fields": [], "methods": []}
                if kind == "struct" and r[k + 1].text == "{":
                    meta["fields"] = struct_fields(r[k + 2 : matching(r, k + 1)], content)
                elif kind == "interface" and r[k + 1].text == "{":
                    inner = struct_fields(r[k + 2 : matching(r, k + 1)], content)
                    meta["methods"] = [f["name"] for f in inner if f["type"].startswith("(")]
                emit("type", r[0].text, first, r[-1], f"type {r[0].text} {kind if kind in ('struct', 'interface') else text_of(r[k:], content)}", first, **meta)
            i = end
        elif t.text in ("const", "var") and i + 2 < len(plain):
            runs, end = specs(i)
            for r in runs:
                names, k = [r[0]], 1
                while k + 1 < len(r) and r[k].text == ",":
                    names.append(r[k + 1])
                    k += 2
                eq = next((n for n, x in enumerate(r) if x.text == "=" and n >= k), len(r))
                kind, values = text_of(r[k:eq], content), [text_of(v, content) for v in split_top(r[eq + 1 :])]
                for n, x in enumerate(names):
                    if exported(x.text):
                        value = values[n] if n < len(values) else ""
                        emit(t.text, x.text, x, r[-1], " ".join(y for y in (t.text, x.text, kind, f"= {value}" if value else "") if y), r[0] if plain[i + 1].text == "(" else t, code=value if t.text == "const" else None)
            i = end
        elif t.text in ("(", "{", "["):
            i = matching(plain, i)
        i += 1
    import json

    for c in out:
        c["metadata"]["imports"] = json.dumps(sorted(set(imports)))
        if c["type"] == "type" and c["name"] in methods:
            c["metadata"]["methods"] = json.dumps(sorted(set(json.loads(c["metadata"]["methods"])) | set(methods[c["name"]])))
    return out
