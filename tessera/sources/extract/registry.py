"""From a file to its chunks: the language's extractor or line windows, embedded code, and a row in the host language."""

from __future__ import annotations

import logging
import re
from collections.abc import Mapping
from typing import TYPE_CHECKING

from tessera.sources.extract import brace, lines, prose, python
from tessera.sources.extract.base import Chunk, chunk

if TYPE_CHECKING:
    from tessera.sources.languages import Language

log = logging.getLogger(__name__)

EXTRACTORS = {"python": python.extract, **brace.EXTRACTORS, **prose.EXTRACTORS, **lines.EXTRACTORS}
#: How code is named where it is embedded.
HINTS = {"py": "python", "js": "javascript", "ts": "typescript", "sh": "bash", "shell": "bash", "yml": "yaml", "rb": "ruby", "rs": "rust", "md": "markdown", "c++": "cpp", "golang": "go"}
MAX_DEPTH = 5
_BLOCK = re.compile(r"<(script|style|template)\b([^>]*)>(.*?)</\1>", re.S | re.I)


def line_chunks(path: str, text: str, size: int = 50, overlap: int = 5) -> list[Chunk]:
    rows, out = text.split("\n"), []
    for start in range(0, len(rows), size - overlap):
        body = "\n".join(rows[start : start + size]).strip()
        if body:
            end = min(start + size, len(rows))
            out.append(chunk("raw_chunk", f"{path}:{start + 1}-{end}", start + 1, end, body))
    return out


def _claims(text: str, language: str, registered: Language | None) -> list[tuple[int, int, int, str]]:
    """(priority, start, end, language) of embedded code, by the language's own rules and by those registered."""
    out = []
    if language == "markdown":
        starts = [0, *(m.end() for m in re.finditer("\n", text))]
        for info, at, code in prose.fences(text):
            if info:
                out.append((1, starts[at - 1], starts[at - 1] + len(code), HINTS.get(info, info)))
    elif language in ("html", "svelte", "vue"):
        for m in _BLOCK.finditer(text):
            tag, attrs = m[1].lower(), m[2]
            stated = re.search(r"lang=[\"']?([\w-]+)", attrs)
            if tag != "template" and m[3].strip() and not re.search(r"\bsrc=", attrs):
                out.append((1 if stated else 0, m.start(3), m.end(3), HINTS.get(stated[1], stated[1]) if stated else {"script": "javascript", "style": "css"}[tag]))
    for rule in registered.embedded if registered else ():
        for m in re.finditer(rule.pattern, text, re.M):
            named = m.groupdict().get("language") or rule.language
            out.append((rule.priority, m.start("code"), m.end("code"), HINTS.get(named, named)))
    return out


def injections(text: str, language: str, registered: Language | None = None) -> list[tuple[str, int, str]]:
    """(language, first line, code) of embedded code; of claims to the same characters that of the highest priority stands, then the earliest."""
    kept: list[tuple[int, int, str]] = []
    for _, start, end, name in sorted(_claims(text, language, registered), key=lambda c: (-c[0], c[1], c[2])):
        if all(end <= a or b <= start for a, b, _ in kept):
            kept.append((start, end, name))
    return [(name, text.count("\n", 0, start) + 1, text[start:end]) for start, end, name in sorted(kept)]


def _by_patterns(text: str, symbols) -> list[Chunk]:
    """Chunks of declarative patterns, in order of their lines."""
    found = []
    for rule in symbols:
        for m in re.finditer(rule.pattern, text, re.M):
            first, last = text.count("\n", 0, m.start()) + 1, text.count("\n", 0, m.end()) + 1
            found.append((first, last if rule.one_line else None, rule.kind, m["name"], m.groupdict().get("module") or ""))
    found.sort(key=lambda f: f[0])
    lines, out = text.split("\n"), []
    for (first, last, kind, name, module), follows in zip(found, [*[f[0] for f in found[1:]], len(lines) + 1], strict=True):
        end = last or max(first, follows - 1)
        out.append(chunk(kind, name, first, end, "\n".join(lines[first - 1 : end]), **({"module": module} if module else {})))
    return out


def _own(path: str, text: str, language: str, registered: Language | None) -> list[Chunk]:
    """Chunks in the file's own language: by the registered extractor, the registered patterns, the library's extractor; else line windows."""
    if registered is not None and registered.extractor is not None:
        found = [chunk(c["kind"], c["name"], c["line_start"], c["line_end"], c["content"], c.get("scope", ""), c.get("language", ""), **c.get("metadata", {})) for c in registered.extractor(path, text)]
    elif registered is not None and registered.symbols:
        found = _by_patterns(text, registered.symbols)
    elif language in ("svelte", "vue"):
        found = [chunk("raw_chunk", "template", text.count("\n", 0, m.start()) + 1, text.count("\n", 0, m.end()) + 1, m.group(), "", language) for m in _BLOCK.finditer(text) if m[1].lower() == "template"]
        if language == "svelte":
            rest = _BLOCK.sub("", text).strip()
            found = [chunk("raw_chunk", "template", 1, text.count("\n") + 1, rest, "", language)] if rest else []
        return found
    else:
        found = EXTRACTORS[language](path, text) if language in EXTRACTORS else []
    out = []
    for c in found:
        if registered is not None:
            name = registered.name_hook(c, text) if registered.name_hook else c["name"]
            if name is None:
                continue
            c["name"] = name
            if registered.scope_hook:
                c["scope"] = registered.scope_hook(c, text)
            if registered.import_hook and c["kind"] == "import":
                c["metadata"] = c["metadata"] | dict(registered.import_hook(c, text))
        out.append(c)
    return out or line_chunks(path, text)


def extract_file(path: str, text: str, language: str, depth: int = 0, languages: Mapping[str, Language] | None = None) -> list[Chunk]:
    """Chunks of a file. Embedded code is extracted in its own language, at most five levels deep; if none of the chunks is in the file's language, one row says that it was there.

    ``languages`` are registrations, whose extractors, patterns, hooks and injections come before
    the library's. Whatever fails in extraction leaves the text on line windows.
    """
    registered = (languages or {}).get(language)
    try:
        found = _own(path, text, language, registered)
        inner = injections(text, language, registered) if depth < MAX_DEPTH else []
    except Exception:  # a text or a hook that an extractor can't take mustn't end the job
        log.warning("extraction of %s as %s failed; it is cut into line windows", path, language, exc_info=True)
        found, inner = line_chunks(path, text), []
    for c in found:
        c["language"] = c["language"] or language
    for name, at, code in inner:
        other = (languages or {}).get(name)
        if name in EXTRACTORS or (other is not None and (other.extractor or other.symbols)):
            for c in extract_file(path, code, name, depth + 1, languages):
                c["line_start"], c["line_end"] = c["line_start"] + at - 1, c["line_end"] + at - 1
                found.append(c)
    if depth == 0 and not any(c["language"] == language for c in found):
        found.append(chunk("raw_chunk", f"{path}:host", 1, 1, "", "", language))
    return found
