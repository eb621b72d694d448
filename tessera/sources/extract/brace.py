"""Languages with braces: declaration heads by rule, imports by pattern."""

from __future__ import annotations

import re
from collections.abc import Iterator

from tessera.sources.extract.base import Chunk, Rule, chunk, fold_comments, scan_braces

N = r"(?P<name>[A-Za-z_$][\w$]*)"
MODS = r"(?:(?:pub(?:\([^)]*\))?|public|private|protected|internal|static|final|abstract|async|export|default|declare|unsafe|const|extern(?:\s+\"[^\"]*\")?|inline|virtual|override|synchronized|native|sealed|readonly)\s+)*"

JS = (
    Rule("class", MODS + r"class\s+" + N, scope=True, class_like=True),
    Rule("function", MODS + r"function\s*\*?\s*" + N, scope=True),
    Rule("function", MODS + r"(?:const|let|var)\s+" + N + r"\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|[A-Za-z_$][\w$]*\s*=>)", scope=True),
    Rule("variable", MODS + r"(?:const|let|var)\s+" + N, top_only=True),
    Rule("method", r"(?:(?:static|async|get|set|public|private|protected|readonly|override|abstract)\s+)*\*?(?!(?:if|for|while|switch|catch|return|function|new|await|typeof)\b)" + N + r"\s*(?:<[^>]*>)?\([^)]*\)\s*(?::[^{;]+)?\{", scope=True),
)
TS = (
    Rule("class", MODS + r"(?:class|interface|enum|namespace|module)\s+" + N, scope=True, class_like=True),
    Rule("class", MODS + r"type\s+" + N + r"\s*(?:<[^=]*>)?\s*="),
    *JS[1:],
)
RULES: dict[str, tuple[Rule, ...]] = {
    "javascript": JS,
    "typescript": TS,
    "tsx": TS,
    "go": (
        Rule("method", r"func\s*\((?:\w+\s+)?\*?(?P<receiver>\w+)[^)]*\)\s*" + N),
        Rule("function", r"func\s+" + N),
        Rule("class", r"type\s+" + N, scope=True, class_like=True),
        Rule("variable", r"(?:var|const)\s+" + N, top_only=True),
    ),
    "java": (
        Rule("class", r"(?:@\w+(?:\([^)]*\))?\s+)*" + MODS + r"(?:class|interface|enum|record|@interface)\s+" + N, scope=True, class_like=True),
        Rule("method", r"(?:@\w+(?:\([^)]*\))?\s+)*" + MODS + r"(?:<[^>]+>\s+)?(?!(?:return|new|throw|else|case)\b)(?:[\w.$]+(?:<[^;=(){}]*>)?(?:\[\])*\s+)?(?!(?:if|for|while|switch|catch|return|new|super|this)\b)" + N + r"\s*\([^;{]*\)\s*(?:throws\s+[\w.,\s]+)?\{"),
        Rule("variable", r"(?:(?:public|private|protected|static|final|volatile|transient)\s+)+[\w.$]+(?:<[^;=(){}]*>)?(?:\[\])*\s+" + N + r"\s*[=;]"),
    ),
    "rust": (
        Rule("class", MODS + r"(?:struct|enum|union|trait|mod|type)\s+" + N, scope=True, class_like=True),
        Rule("class", r"(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?" + N, scope=True, class_like=True),
        Rule("function", MODS + r"fn\s+" + N, scope=True),
        Rule("function", r"macro_rules!\s*" + N),
        Rule("variable", MODS + r"(?:static|const)\s+(?:mut\s+)?" + N, top_only=True),
    ),
    "c": (
        Rule("class", r"(?:typedef\s+)?(?:struct|union|enum)\s+" + N + r"\s*\{", scope=True),
        Rule("class", r"typedef\s+.*?\b" + N + r"\s*;"),
        Rule("function", r"#\s*define\s+" + N + r"\("),
        Rule("variable", r"#\s*define\s+" + N),
        Rule("function", r"(?!(?:return|else|if|for|while|switch|typedef|struct\s+\w+\s*\{)\b)(?:[A-Za-z_][\w\s*]*?[\s*])" + N + r"\s*\([^;{}]*\)\s*[{;]", top_only=True),
        Rule("variable", r"(?!(?:return|typedef)\b)(?:[A-Za-z_][\w\s*]*?[\s*])" + N + r"(?:\[[^\]]*\])?\s*=", top_only=True),
    ),
    "css": (Rule("class", r"(?P<name>(?:[.#@:\[*A-Za-z][^{};]*))\{", scope=True),),
}
RULES["cpp"] = (
    Rule("class", r"(?:template\s*<[^>]*>\s*)?(?:class|struct|union|enum(?:\s+class)?|concept)\s+" + N + r"[^;()]*\{", scope=True, class_like=True),
    Rule("class", r"(?:inline\s+)?namespace\s+" + N + r"\s*\{", scope=True),
    Rule("class", r"using\s+" + N + r"\s*="),
    *RULES["c"][1:4],
    Rule("function", r"(?:template\s*<[^>]*>\s*)?(?!(?:return|else|if|for|while|switch|typedef|new|delete|using)\b)(?:[A-Za-z_][\w:<>,\s*&~]*?[\s*&])?(?P<name>(?:[A-Za-z_]\w*::)*~?[A-Za-z_]\w*|operator\s*[^\s(]+)\s*\([^;{}]*\)\s*(?:const|noexcept|override|final|\s)*(?::[^{;]*)?[{;]", scope=False),
)
RULES["scss"] = (Rule("function", r"@(?:mixin|function)\s+(?P<name>[\w-]+)"), Rule("variable", r"(?P<name>\$[\w-]+)\s*:"), Rule("variable", r"(?P<name>--[\w-]+)\s*:"), *RULES["css"])
RULES["less"] = (Rule("function", r"(?P<name>[.#][\w-]+)\s*\([^)]*\)\s*\{"), Rule("variable", r"(?P<name>@[\w-]+)\s*:"), Rule("variable", r"(?P<name>--[\w-]+)\s*:"), *RULES["css"])
RULES["css"] = (Rule("variable", r"(?P<name>--[\w-]+)\s*:"), *RULES["css"])

_JS_IMPORT = re.compile(r"(?m)^\s*(?:import\s+(?:(?P<what>[^'\"]+?)\s+from\s+)?|export\s+(?P<re>[^'\"]+?)\s+from\s+|(?:const|let|var)\s+(?P<req>[^=]+?)\s*=\s*require\()['\"](?P<module>[^'\"]+)['\"]")
_C_INCLUDE = re.compile(r"(?m)^\s*#\s*include\s*[<\"](?P<module>[^>\"]+)[>\"]")
_JAVA_IMPORT = re.compile(r"(?m)^\s*import\s+(?:static\s+)?(?P<module>[\w.]+?)(?:\.(?P<name>\w+|\*))?\s*;")
_GO_IMPORT = re.compile(r"(?ms)^import\s*(?:\((?P<block>.*?)\)|(?:\w+\s+)?\"(?P<module>[^\"]+)\")")
_RUST_USE = re.compile(r"(?ms)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<path>[^;]+);")
_CSS_IMPORT = re.compile(r"(?m)@(?:import|use|forward)\s+(?:url\()?['\"]?(?P<module>[^'\")\s;]+)")


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _import(text: str, m: re.Match, **meta: str) -> Chunk:
    start = m.start() + len(m.group()) - len(m.group().lstrip())
    return chunk("import", m.group().strip(), _line(text, start), _line(text, m.end()), m.group().strip(), **meta)


def imports(text: str, language: str) -> Iterator[Chunk]:
    if language in ("javascript", "typescript", "tsx"):
        for m in _JS_IMPORT.finditer(text):
            what = m["what"] or m["re"] or m["req"] or ""
            braces = re.search(r"\{([^}]*)\}", what)
            names = [re.split(r"\s+as\s+|\s*:\s*", n.strip())[0].removeprefix("type ").strip() for n in braces[1].split(",")] if braces else []
            default = re.match(r"\s*([A-Za-z_$][\w$]*)\s*(?:,|$)", re.sub(r"^type\s+", "", what))
            names = ([default[1]] if default and not m["req"] else []) + [n for n in names if n]
            yield _import(text, m, module=re.sub(r"\.(?:jsx?|mjs|tsx?)$", "", m["module"]), names=",".join(names))
    elif language in ("c", "cpp"):
        for m in _C_INCLUDE.finditer(text):
            yield _import(text, m, module=m["module"])
    elif language == "java":
        for m in _JAVA_IMPORT.finditer(text):
            last = m["name"] or ""
            yield _import(text, m, module=f"{m['module']}.{last}" if last and last != "*" else m["module"], names=last if last != "*" else "")
    elif language == "go":
        for m in _GO_IMPORT.finditer(text):
            for s in re.finditer(r"\"([^\"]+)\"", m["block"] or f'"{m["module"]}"'):
                at = m.start("block") + s.start() if m["block"] else m.start()
                yield chunk("import", s[1], _line(text, at), _line(text, at), s[0], module=s[1])
    elif language == "rust":
        for m in _RUST_USE.finditer(text):
            path = re.sub(r"\s+", "", m["path"])
            head, _, tail = path.rpartition("::")
            names = [n for n in tail.strip("{}").split(",") if n not in ("*", "self", "")]
            dots = 0
            while head.startswith("super"):
                head, dots = head[5:].removeprefix("::"), dots + 1
            yield _import(text, m, module=head.replace("::", "/"), names=",".join(names), dots=str(dots) if dots else "")
    elif language in ("css", "scss", "less"):
        for m in _CSS_IMPORT.finditer(text):
            yield _import(text, m, module=m["module"])


def extractor(language: str):
    line_comment = "" if language == "css" else "//"
    quotes = "\"" if language in ("rust", "c", "cpp", "java") else "\"'`"
    mark = r"\s*(?:/\*|\*|//)" if language != "css" else r"\s*(?:/\*|\*)"

    def extract(path: str, text: str) -> list[Chunk]:
        found = [c for c in scan_braces(text, RULES[language], language, line_comment, quotes) if not c["name"].startswith(("@import", "@use", "@forward"))]
        return fold_comments([*imports(text, language), *found], text, mark)

    return extract


EXTRACTORS = {lang: extractor(lang) for lang in RULES}
