"""HTML pages: a chunk for every heading's section, or one for the page."""

from __future__ import annotations

from html.parser import HTMLParser

from tessella.operators.analyzers import chunk

LANGUAGE = "html"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that an open element of a kind is closed by.
CLOSED_BY = {"p": {"p", "div", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "table", "section", "article", "footer", "pre", "blockquote"}, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
HIDDEN = {"script", "style", "template", "noscript"}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict | None = None) -> None:
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def text(self) -> str:
        """The shown text, in order."""
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in HIDDEN:
                todo += reversed(n.children)
        return "".join(out)

    def below(self):
        """Elements below, in order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]


class Tree(HTMLParser):
    def __init__(self, source: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        while len(self.open) > 1 and tag in CLOSED_BY.get(self.open[-1].tag, ()):
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), 0)
        if at:
            del self.open[at:]

    def handle_data(self, data):
        self.open[-1].children.append(data)


def squeeze(text: str) -> str:
    """Trimmed lines without blank ones."""
    return "\n".join(x for x in (y.strip() for y in text.replace("\r\n", "\n").split("\n")) if x)


def code_of(nodes: list[Node]) -> list[str]:
    """Texts of pre and code elements below the nodes, the outermost of each."""
    out = []
    for node in nodes:
        if node.tag in ("pre", "code"):
            out.append(squeeze(node.text()))
            continue
        skip: set[int] = set()
        for n in node.below():
            if id(n) not in skip and n.tag in ("pre", "code"):
                out.append(squeeze(n.text()))
                skip |= {id(x) for x in n.below()}
    return [x for x in out if x]


def elements(node: Node) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node)]


def headings(root: Node):
    """Headings below a node, in order, each with the elements that follow it beside it up to the next heading."""
    todo = [(elements(root), 0)]
    while todo:
        beside, i = todo.pop()
        if i == len(beside):
            continue
        todo += [(beside, i + 1), (elements(beside[i]), 0)]
        if beside[i].tag in HEADINGS:
            yield beside[i], beside[i + 1 : next((j for j in range(i + 1, len(beside)) if beside[j].tag in HEADINGS), len(beside))]


def analyze(path: str, content: str) -> list[dict]:
    """Sections: a heading and what follows it. Without a section that holds anything, the page's text.

    A section's code is its title, text and pieces of code. A heading without text is named by its place among all headings.
    """
    tree = Tree(content).root
    named = next((n for n in tree.below() if n.tag == "title"), None)
    page = named.text().strip() if named else ""
    body = next((n for n in tree.below() if n.tag == "body"), tree)
    of_page = {"page_title": page} if page else {}
    out = []
    for place, (h, beside) in enumerate(headings(body), 1):
        text, blocks = squeeze("\n".join(n.text() for n in beside)), code_of(beside)
        if text or blocks:
            title = h.text().strip() or f"Section {place}"
            told = {"html_id": h.attrs.get("id", "").strip(), "class": h.attrs.get("class", "").strip(), "code_blocks": blocks}
            code = "\n\n".join(x for x in (title, text, *blocks) if x)
            out.append(chunk("section", title, LANGUAGE, path, signature=f"<{h.tag}>{title}</{h.tag}>", docstring=text, code=code, heading_level=int(h.tag[1]), **of_page, **{k: v for k, v in told.items() if v}))
    if not out and (text := squeeze(body.text())):
        file = path.split("/")[-1]
        out.append(chunk("file", page or (file.rpartition(".")[0] or file), LANGUAGE, path, signature=page, docstring=text, code=text, **of_page))
    return out
