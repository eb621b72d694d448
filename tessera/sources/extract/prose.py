"""Markdown and reStructuredText: sections and references."""

from __future__ import annotations

import re

from tessera.sources.extract.base import Chunk, chunk, until_next

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#*)?[ \t]*$")
_FENCE = re.compile(r"\s*(```|~~~)\s*([\w+-]*)")
_LINK = re.compile(r"(?<!!)\[[^\]]*\]\(([^)\s]+)[^)]*\)")
_EXTERNAL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:|//|#")


def _local(target: str) -> tuple[str, str] | None:
    if _EXTERNAL.match(target):
        return None
    module, _, fragment = target.partition("#") if "#" not in target else (*target.rsplit("#", 1)[:1], "#", target.rsplit("#", 1)[1])
    return module, fragment


def _sections(lines: list[str], heads: list[tuple[int, int, str]], language: str) -> list[Chunk]:
    """heads: (0-based line, depth, title). A section's own text ends at the next heading of any depth."""
    out, open_ = [], []
    for (at, depth, title), following in zip(heads, until_next([h[0] for h in heads], len(lines)), strict=True):
        open_ = [o for o in open_ if o[0] < depth]
        body = "\n".join(lines[at:following]).strip()
        out.append(chunk("doc_section", title, at + 1, following, body, "::".join(t for _, t in open_ if t), language))
        open_.append((depth, title))
    return out


def markdown(path: str, text: str) -> list[Chunk]:
    lines, heads, fence = text.split("\n"), [], ""
    out: list[Chunk] = []
    for i, line in enumerate(lines):
        f = _FENCE.match(line)
        if f and (not fence or f[1] == fence):
            fence = "" if fence else f[1]
        elif not fence:
            if m := _ATX.match(line):
                heads.append((i, len(m[1]), (m[2] or "").strip()))
            for m in _LINK.finditer(line):
                if (t := _local(m[1])) and t[0]:
                    out.append(chunk("import", f"link:{m[1]}", i + 1, i + 1, m.group(), "", "markdown", module=t[0], names=t[1]))
    return _sections(lines, heads, "markdown") + out


def fences(text: str) -> list[tuple[str, int, str]]:
    """(info string, first line of the code, code) of fenced blocks."""
    out, start, info = [], None, ""
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if m := _FENCE.match(line):
            if start is None:
                start, info = i + 1, m[2].lower()
            else:
                out.append((info, start + 1, "\n".join(lines[start:i])))
                start = None
    return out


_ADORN = re.compile(r"([=\-~^\"'+#*`:._])\1{2,}\s*$")
_ROLE = re.compile(r":([\w:+.-]+):`(?:[^`<]*<)?([^`>]+)>?`")
_RST_LINK = re.compile(r"`[^`<]*<([^>`]+)>`_")
NAMED_ROLES = {"func", "meth", "class", "attr", "data", "exc", "obj", "const", "type"}


def rst(path: str, text: str) -> list[Chunk]:
    lines, heads, order, out = text.split("\n"), [], [], []
    in_toctree, indent = False, 0
    for i, line in enumerate(lines):
        m = _ADORN.match(line)
        if m and i and lines[i - 1].strip() and not _ADORN.match(lines[i - 1]) and len(line.rstrip()) >= len(lines[i - 1].rstrip()):
            over = i >= 2 and bool(_ADORN.match(lines[i - 2])) and lines[i - 2].strip()[0] == m[1]
            style = (m[1], over)
            if style not in order:
                order.append(style)
            heads.append((i - 2 if over else i - 1, order.index(style) + 1, lines[i - 1].strip()))
        for r in _ROLE.finditer(line):
            role, target = r[1].split(":")[-1], r[2].strip().lstrip("~!")
            if role == "doc":
                out.append(chunk("import", f"role:{target}", i + 1, i + 1, r.group(), "", "rst", module=target))
            elif role in NAMED_ROLES:
                out.append(chunk("import", f"role:{target}", i + 1, i + 1, r.group(), "", "rst", names=target.rstrip("()").split(".")[-1]))
        for r in _RST_LINK.finditer(line):
            if (t := _local(r[1])) and t[0]:
                out.append(chunk("import", f"ref:{r[1]}", i + 1, i + 1, r.group(), "", "rst", module=t[0], names=t[1]))
        if re.match(r"\s*\.\. toctree::", line):
            in_toctree, indent = True, len(line) - len(line.lstrip())
        elif in_toctree and line.strip():
            if len(line) - len(line.lstrip()) <= indent:
                in_toctree = False
            elif not line.strip().startswith(":"):
                entry = re.sub(r"^.*<([^>]+)>\s*$", r"\1", line.strip())
                if not _EXTERNAL.match(entry):
                    out.append(chunk("import", f"toctree:{entry}", i + 1, i + 1, line.strip(), "", "rst", module=entry))
    if heads:
        return _sections(lines, heads, "rst") + out
    start = None
    for i, line in enumerate([*lines, ""]):
        if line.strip() and start is None:
            start = i
        elif not line.strip() and start is not None:
            body = "\n".join(lines[start:i])
            out.append(chunk("doc_section", f"para:{start + 1}", start + 1, i, body, "", "rst"))
            start = None
    return out


EXTRACTORS = {"markdown": markdown, "rst": rst}
