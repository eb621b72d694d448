"""Languages read line by line or by the standard library: configuration, shell, Ruby, SQL, HTML."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

from tessera.sources.extract.base import Chunk, chunk, fold_comments, until_next


def json_keys(path: str, text: str) -> list[Chunk]:
    """Every pair at any depth, in order; the scope holds the keys around it."""
    try:
        json.loads(text)
    except ValueError:
        return []
    out, stack, i = [], [], 0
    token = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+')
    key, found = None, list(token.finditer(text))
    opened: list[tuple[str | None, int]] = []
    for k, m in enumerate(found):
        t = m.group()
        if t.startswith('"') and k + 1 < len(found) and found[k + 1].group() == ":":
            key = json.loads(t)
            end = _json_end(found, k + 2)
            content = text[m.start() : end]
            line = text.count("\n", 0, m.start()) + 1
            out.append(chunk("config_key", key, line, line + content.count("\n"), content, "::".join(s for s, _ in opened if s), "json"))
        elif t in "{[":
            before = found[k - 1].group() if k else ""
            opened.append((key if before == ":" else None, k))
        elif t in "}]" and opened:
            opened.pop()
    return out


def _json_end(found: list[re.Match], k: int) -> int:
    depth = 0
    for m in found[k:]:
        t = m.group()
        depth += (t in "{[") - (t in "}]")
        if depth == 0:
            return m.end()
    return found[-1].end()


def toml_tables(path: str, text: str) -> list[Chunk]:
    lines = text.split("\n")
    heads = [(i, m) for i, line in enumerate(lines) if (m := re.match(r"\s*\[\[?\s*([^\]]+?)\s*\]\]?\s*(?:#.*)?$", line))]
    out = []
    for (i, m), end in zip(heads, until_next([h[0] for h in heads], len(lines)), strict=True):
        parts = [p.strip().strip("\"'") for p in re.findall(r"\"[^\"]*\"|'[^']*'|[^.\s]+", m[1])]
        body = "\n".join(lines[i:end]).rstrip()
        out.append(chunk("config_key", parts[-1], i + 1, i + 1 + body.count("\n"), body, "::".join(parts[:-1]), "toml"))
    return fold_comments(out, text, r"\s*#")


def yaml_keys(path: str, text: str) -> list[Chunk]:
    lines = text.split("\n")
    heads = [(i, m[1].strip("\"'")) for i, line in enumerate(lines) if (m := re.match(r"([\w\"'./$-][^:#]*?)\s*:(?:\s|$)", line)) and not line.startswith("---")]
    out = []
    for (i, name), end in zip(heads, until_next([h[0] for h in heads], len(lines)), strict=True):
        while end - 1 > i and not re.match(r"\s+\S|-", lines[end - 1]):
            end -= 1
        out.append(chunk("config_key", name, i + 1, end, "\n".join(lines[i:end]), "", "yaml"))
    return fold_comments(out, text, r"\s*#")


def hcl_blocks(path: str, text: str) -> list[Chunk]:
    out, lines, i = [], text.split("\n"), 0
    while i < len(lines):
        m = re.match(r"([A-Za-z_][\w-]*)((?:\s+(?:\"[^\"]*\"|[\w-]+))*)\s*\{", lines[i])
        if not m:
            i += 1
            continue
        depth, j = 0, i
        while j < len(lines):
            plain = re.sub(r"\"(?:[^\"\\]|\\.)*\"|#.*|//.*", "", lines[j])
            depth += plain.count("{") - plain.count("}")
            j += 1
            if depth <= 0:
                break
        name = ".".join([m[1], *re.findall(r"[\w-]+", m[2])])
        out.append(chunk("config_key", name, i + 1, j, "\n".join(lines[i:j]), "", "hcl"))
        i = j
    return fold_comments(out, text, r"\s*(?:#|//)")


def bash(path: str, text: str) -> list[Chunk]:
    out, lines, depth, i = [], text.split("\n"), 0, 0
    while i < len(lines):
        line = lines[i]
        if m := re.match(r"\s*(?:function\s+([\w:.-]+)\s*(?:\(\s*\))?|([\w:.-]+)\s*\(\s*\))\s*(\{)?", line):
            j, level, seen = i, 0, False
            while j < len(lines):
                plain = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'[^']*'|(?<!\$)#.*", "", lines[j])
                level += plain.count("{") - plain.count("}")
                seen |= "{" in plain
                j += 1
                if seen and level <= 0:
                    break
            out.append(chunk("function", m[1] or m[2], i + 1, j, "\n".join(lines[i:j]), "", "bash"))
            i = j
            continue
        if m := re.match(r"(?:export\s+|declare\s+(?:-\w+\s+)*|readonly\s+)?([A-Za-z_]\w*)=", line):
            out.append(chunk("variable", m[1], i + 1, i + 1, line, "", "bash"))
        elif m := re.match(r"alias\s+([\w.-]+)=", line):
            out.append(chunk("variable", m[1], i + 1, i + 1, line, "", "bash"))
        elif m := re.match(r"\s*(?:source|\.)\s+[\"']?([^\s\"';]+)", line):
            out.append(chunk("import", line.strip(), i + 1, i + 1, line, "", "bash", module=m[1]))
        i += 1
    return fold_comments(out, text, r"\s*#(?!!)")


_RUBY_OPEN = re.compile(r"\s*(?:class|module|def|if|unless|case|while|until|for|begin)\b|.*\bdo\b\s*(?:\|[^|]*\|)?\s*$")


def ruby(path: str, text: str) -> list[Chunk]:
    out, lines, stack = [], text.split("\n"), []
    for i, line in enumerate(lines):
        code = re.sub(r"(^|\s)#(?!\{).*", "", line)
        if re.match(r"\s*end\b", code) and stack:
            at, made = stack.pop()
            if made is not None:
                made["line_end"], made["content"] = i + 1, "\n".join(lines[at : i + 1])
            continue
        scope = "::".join(c["name"] for _, c in stack if c is not None)
        made = None
        if m := re.match(r"\s*(?:class|module)\s+([A-Z][\w:]*)", code):
            made = chunk("class", m[1], i + 1, i + 1, line, scope, "ruby")
        elif m := re.match(r"\s*def\s+((?:self\.|[A-Za-z_]\w*\.)?[\w?!=\[\]<>+*/%-]+)", code):
            inside = next((c for _, c in reversed(stack) if c is not None), None)
            made = chunk("method" if inside is not None and inside["kind"] == "class" else "function", m[1].split(".")[-1], i + 1, i + 1, line, scope, "ruby")
        elif m := re.match(r"\s*(describe|context|it|specify)\b\s*\(?[\"']?([^\"'\n]*?)[\"']?\)?\s*(?:,.*)?\s+do\b", code):
            made = chunk("class" if m[1] in ("describe", "context") else "function", m[2].strip(), i + 1, i + 1, line, scope, "ruby")
        elif m := re.match(r"\s*([A-Z]\w*)\s*=[^=~>]", code):
            out.append(chunk("variable", m[1], i + 1, i + 1, line, scope, "ruby"))
        elif m := re.match(r"\s*require(_relative)?\s*\(?\s*[\"']([^\"']+)", code):
            module = m[2] if not m[1] or m[2].startswith(".") else "./" + m[2]
            out.append(chunk("import", line.strip(), i + 1, i + 1, line, "", "ruby", module=module))
        if made is not None:
            out.append(made)
        if _RUBY_OPEN.match(code) and not re.search(r"\bend\b\s*$", code):
            stack.append((i, made))
    return fold_comments(out, text, r"\s*#")


_SQL = (
    ("class", r"create\s+(?:or\s+replace\s+)?(?:global\s+|local\s+)?(?:temp(?:orary)?\s+|unlogged\s+|materialized\s+)?(?:table|view|type)\s+(?:if\s+not\s+exists\s+)?([\w.\"]+)"),
    ("variable", r"create\s+(?:or\s+replace\s+)?(?:unique\s+)?(?:sequence|index|schema|database|extension|role|trigger)\s+(?:concurrently\s+)?(?:if\s+not\s+exists\s+)?([\w.\"]+)"),
    ("function", r"create\s+(?:or\s+replace\s+)?(?:function|procedure)\s+([\w.\"]+)"),
    ("function", r"alter\s+\w+\s+(?:if\s+exists\s+)?(?:only\s+)?([\w.\"]+)"),
    ("function", r"drop\s+\w+\s+(?:if\s+exists\s+)?([\w.\"]+)"),
    ("function", r"insert\s+(?:or\s+\w+\s+)?into\s+([\w.\"]+)"),
    ("function", r"update\s+([\w.\"]+)"),
    ("function", r"delete\s+from\s+([\w.\"]+)"),
    ("function", r"select\b(?:.*?\bfrom\s+([\w.\"]+))?"),
    ("function", r"with\b.*?\)\s*(?:select\b.*?\bfrom|insert\s+into|update|delete\s+from)\s+([\w.\"]+)"),
)


def sql(path: str, text: str) -> list[Chunk]:
    masked = re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'", lambda m: re.sub(r"[^\n]", " ", m.group()), text, flags=re.S)
    out, at = [], 0
    for part in re.split(r"(?<=;)", masked):
        start = at + len(part) - len(part.lstrip())
        body, at = part.strip(), at + len(part)
        for kind, pattern in _SQL:
            if m := re.match(pattern, body, re.I | re.S):
                first = text.count("\n", 0, start) + 1
                raw = text[start : start + len(body)]
                out.append(chunk(kind, (m[1] or "").strip('"') or f"anonymous:{first}", first, first + raw.count("\n"), raw, "", "sql"))
                break
        for m in re.finditer(r"(?:\bwith\s+(?:recursive\s+)?|,\s*)([A-Za-z_]\w*)\s+as\s+(?:not\s+|materialized\s+)*\(", body, re.I):
            first = text.count("\n", 0, start + m.start(1)) + 1
            out.append(chunk("function", m[1], first, first, text.split("\n")[first - 1], "", "sql"))
    return fold_comments(out, text, r"\s*--")


TAGS = {"article", "aside", "body", "footer", "form", "head", "header", "main", "nav", "section", "table", "template", "dialog", "details"}


class _Html(HTMLParser):
    def __init__(self, lines: list[str]):
        super().__init__()
        self.lines, self.out, self.open = lines, [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        line, a = self.getpos()[0], dict(attrs)
        if tag in TAGS:
            self.open.append((tag, chunk("doc_section", a.get("id") or tag, line, line, "", "", "html")))
        elif tag == "script" and a.get("src"):
            self.out.append(chunk("import", a["src"], line, line, self.get_starttag_text(), "", "html", module=a["src"], language_hint="javascript"))
        elif tag == "link" and a.get("href"):
            hint = "css" if "stylesheet" in (a.get("rel") or "") else ""
            self.out.append(chunk("import", a["href"], line, line, self.get_starttag_text(), "", "html", module=a["href"], language_hint=hint))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                made = self.open.pop(i)[1]
                made["line_end"] = self.getpos()[0]
                made["content"] = "\n".join(self.lines[made["line_start"] - 1 : made["line_end"]])
                self.out.append(made)
                return

    def handle_comment(self, data: str) -> None:
        line = self.getpos()[0]
        self.out.append(chunk("comment", data.strip().split("\n")[0], line, line + data.count("\n"), f"<!--{data}-->", "", "html"))


def html(path: str, text: str) -> list[Chunk]:
    parser = _Html(text.split("\n"))
    parser.feed(text)
    parser.close()
    return sorted(parser.out, key=lambda c: c["line_start"])


def query_patterns(path: str, text: str) -> list[Chunk]:
    """Each top-level pattern of a tree query, named by its own capture."""
    out, depth, start = [], 0, 0
    code = re.sub(r";[^\n]*|\"(?:[^\"\\]|\\.)*\"", lambda m: " " * len(m.group()), text)
    for i, c in enumerate(code):
        if c in "([":
            if depth == 0:
                start = i
            depth += 1
        elif c in ")]":
            depth -= 1
            if depth == 0:
                m = re.match(r"[*+?]?\s*@([\w.]+)", code[i + 1 :])
                end = i + 1 + (m.end() if m else 0)
                first = text.count("\n", 0, start) + 1
                out.append(chunk("doc_section", m[1] if m else f"anonymous:{first}", first, first + text.count("\n", start, end), text[start:end], "", "tree_sitter_query"))
    return fold_comments(out, text, r"\s*;")


EXTRACTORS = {"json": json_keys, "toml": toml_tables, "yaml": yaml_keys, "hcl": hcl_blocks, "bash": bash, "ruby": ruby, "sql": sql, "html": html, "tree_sitter_query": query_patterns}
