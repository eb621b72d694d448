"""Text expressions: code tokens, query classes, previews, sentences. All of them are built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The character before a border within an identifier, besides underscores: camel case, the end of an acronym, digits.
BEFORE_BORDER = "[a-z](?=[A-Z0-9])|[A-Z](?=[0-9]|[A-Z][a-z])|[0-9](?=[A-Za-z])"
_MARK = "\x01"


def tokenise_code(text: Column) -> Column:
    """Identifiers in lower case, each followed by its parts, without repeats, space-joined.

    Borders are marked once for the whole text; a pattern that splits word by word would be
    compiled anew for each.
    """
    given = F.coalesce(text, F.lit(""))
    clean = F.when(F.contains(given, F.lit(_MARK)), F.translate(given, _MARK, " ")).otherwise(given)
    words = F.regexp_extract_all(F.regexp_replace(clean, BEFORE_BORDER, f"$0{_MARK}"), F.lit(f"([A-Za-z_][A-Za-z0-9_{_MARK}]*)"), F.lit(1))

    def expand(word: Column) -> Column:
        parts = F.filter(F.split(F.translate(word, "_", _MARK), _MARK), lambda p: p != "")
        plain = ~F.contains(word, F.lit("_")) & ~F.contains(word, F.lit(_MARK))
        return F.when(plain, F.array(word)).otherwise(F.concat(F.array(F.translate(word, _MARK, "")), parts))

    return F.array_join(F.array_distinct(F.flatten(F.transform(F.array_distinct(F.transform(words, F.lower)), expand))), " ")


# --- query classification -------------------------------------------------

#: Words that open a query which is code, from common languages' keywords, without plain English ones.
CODE_KEYWORDS = (
    "abstract async await begin bool break case catch char class const constexpr continue def default defer delete del double "
    "elif enum except export extends extern final finally float fn foreach func function global goto impl implements import "
    "include inline instanceof int interface internal lambda let local long loop match mod module mut namespace nil nonlocal "
    "null operator override package pass private protected pub public raise readonly ref require self select short signed sizeof "
    "static struct super switch template this throw throws trait type typedef typename typeof union unless unsafe unsigned until "
    "use using val var virtual void volatile where while yield"
).split()
#: The thresholds of the classes.
CODE_THRESHOLD = 2
CONCEPT_WORDS = 3
CONCEPT_PUNCTUATION = 0.04
#: Patterns of syntax that score two points each, and those that score one.
STRONG_MARKS = (r"[{}]", r"\w\(", r"==|!=|<=|>=|=>|->", r";")
WEAK_MARKS = (r"\w=\w", r"(?m):\s*$")


def code_score(query: Column) -> Column:
    """Points for syntax: two for strong marks, one for weak ones and for a keyword in front."""
    has = lambda pattern: F.rlike(query, F.lit(pattern))
    points = lambda condition, n: F.when(condition, n).otherwise(0)
    call, opened, closed = has(r"\w\("), has(r"<\w"), has(r"\w>")
    first = F.lower(F.regexp_extract(query, r"^(\S*)", 1))
    total = F.when(opened & closed, 2).when(opened | closed, 1).otherwise(0) + points(~call & has(r"[()]"), 1) + points(first.isin(CODE_KEYWORDS), 1)
    for marks, n in ((STRONG_MARKS, 2), (WEAK_MARKS, 1)):
        for mark in marks:
            total = total + points(has(mark), n)
    return total


def punctuation_ratio(query: Column) -> Column:
    natural = F.char_length(F.regexp_replace(query, r"[^\p{L}\p{N} ]", ""))
    return F.when(query == "", F.lit(0.0)).otherwise(1.0 - natural / F.char_length(query))


def classify_query(query: Column) -> Column:
    """``code``, ``concept`` or ``identifier``."""
    q = F.regexp_replace(query, r"^\s+|\s+$", "")
    n_words = F.when(q == "", 0).otherwise(F.size(F.split(q, r"\s+")))
    return F.when(code_score(q) >= CODE_THRESHOLD, "code").when((n_words >= CONCEPT_WORDS) & (punctuation_ratio(q) <= CONCEPT_PUNCTUATION), "concept").otherwise("identifier")


# --- ranking signals --------------------------------------------------------

#: The boost of each chunk kind; 1.0 for any other.
KIND_BOOST = {
    "class": 1.5, "function": 1.3, "method": 1.3, "variable": 1.0, "api_endpoint": 1.0, "doc_section": 0.8,
    "test_function": 0.7, "config_key": 0.6, "comment": 0.5, "raw_chunk": 0.5, "migration": 0.4, "import": 0.3,
}
#: Path marks of each file category with its penalty, in order of priority.
FILE_PENALTY = (
    (0.3, ("vendor/", "node_modules/", "third_party/"), ()),
    (0.3, ("_generated.", ".gen."), ("_pb2.py", ".pb.go")),
    (0.5, ("test_", "/tests/", "_test.", "/test/", "tests.", "conftest."), ()),
    (0.8, (), (".md", ".rst", ".txt", ".adoc")),
    (0.7, (), (".json", ".yaml", ".yml", ".toml", ".ini", ".cfg")),
)


def name_score(query: Column, name: Column) -> Column:
    """1.0 equal, 0.8 prefix, 0.5 substring, 0.4 all of several words within the name, else 0.0; case is ignored."""
    q, n = F.lower(query), F.lower(name)
    tokens = F.filter(F.split(q, r"\s+"), lambda t: t != "")
    all_in = (F.size(tokens) > 1) & F.forall(tokens, lambda t: F.contains(n, t))
    return F.when(q == "", 0.0).when(n == q, 1.0).when(F.startswith(n, q), 0.8).when(F.contains(n, q), 0.5).when(all_in, 0.4).otherwise(0.0)


def kind_boost(kind: Column) -> Column:
    out = F.when(F.lit(False), F.lit(1.0))
    for k, boost in KIND_BOOST.items():
        out = out.when(kind == k, F.lit(boost))
    return out.otherwise(F.lit(1.0))


def file_penalty(path: Column) -> Column:
    p = F.lower(path)
    out = F.when(F.lit(False), F.lit(1.0))
    for penalty, within, ends in FILE_PENALTY:
        tests = [F.contains(p, F.lit(m)) for m in within] + [F.endswith(p, F.lit(m)) for m in ends]
        test = tests[0]
        for more in tests[1:]:
            test = test | more
        out = out.when(test, F.lit(penalty))
    return out.otherwise(F.lit(1.0))


def importance(degree: Column) -> Column:
    """1 + log2(1 + degree) / 4, at most 3; 1 without inbound edges."""
    return F.when(degree <= 0, F.lit(1.0)).otherwise(F.least(1 + F.log2(1 + degree) / 4, F.lit(3.0)))


# --- previews and sentences ----------------------------------------------

def preview(content: Column, query_tokens: Column) -> Column:
    """struct<line,matched>: the 0-based earliest line with the most distinct query tokens (null if none), and the tokens that occur anywhere, in query order."""
    low = F.lower(content)
    counts = F.transform(F.split(low, "\n", -1), lambda line: F.size(F.filter(query_tokens, lambda t: F.contains(line, t))))
    best = F.array_position(counts, F.array_max(counts)) - 1
    return F.struct(F.when(F.array_max(counts) > 0, best.cast("int")).alias("line"), F.filter(query_tokens, lambda t: F.contains(low, t)).alias("matched"))


#: Fixed values of usable sentences.
SENTENCE_END = r"(?<=[.!?])\s+|\n\s*\n"
BODY_END = r"[.!?]\s+|\n\s*\n"
SENTENCE_CHARS = (15, 200)
NOISE = r"^[\s/#*\-!\"'`]+"
REJECTED_PREFIXES = ("todo", "fixme", "xxx", "hack", "deprecated", "@param", "@return", "@returns", "@throws", "@type", "@see", "@link")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def instructed(query: Column, instruction: str = "") -> Column:
    """The text of a query as it is embedded: a model's instruction first, if it takes one."""
    return F.concat(F.lit(instruction), query) if instruction else query


def first_sentence(text: Column, end: str = SENTENCE_END) -> Column:
    """The first sentence, cut at 200 characters; null if shorter than 15 or if it opens with boilerplate. With ``BODY_END`` the final mark is dropped."""
    least, most = SENTENCE_CHARS
    first = _strip(F.get(F.split(_strip(text), end, 2), F.lit(0)))
    first = F.when(F.char_length(first) > most, F.regexp_replace(F.substring(first, 1, most), r"\s+$", "")).otherwise(first)
    rejected = F.rlike(F.lower(F.regexp_replace(first, NOISE, "")), F.lit("^(" + "|".join(REJECTED_PREFIXES) + ")"))
    return F.when((F.char_length(first) >= least) & ~rejected, first)


def heading_label(text: Column) -> Column:
    """The first line with text, with an ellipsis if others follow."""
    lines = F.filter(F.transform(F.split(text, "\\r\\n|[\\n\\r]", -1), _strip), lambda x: x != "")
    return F.when(F.size(lines) == 0, _strip(text)).when(F.size(lines) > 1, F.concat(F.get(lines, F.lit(0)), F.lit(" …"))).otherwise(F.get(lines, F.lit(0)))


def excluded_identifiers(name: Column, scope: Column, path: Column) -> Column:
    """Sorted identifiers that give a symbol away: its name, its scope and the scope's parts, and path stems of three characters or more."""
    stems = F.filter(F.transform(F.split(path, "/"), lambda p: F.regexp_replace(p, r"(?<=.)\.[^.]*$", "")), lambda x: F.char_length(x) >= 3)
    scopes = F.filter(F.concat(F.array(scope), F.split(scope, "::")), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.concat(F.array(name), scopes, stems)))


def mentions_any(text: Column, names: Column) -> Column:
    low = F.lower(text)
    return F.exists(names, lambda n: F.contains(low, n))


def clean_keywords(keywords: Column, most: int = 10) -> Column:
    """Stripped, non-empty, first occurrences, ``most`` of them."""
    return F.slice(F.array_distinct(F.filter(F.transform(keywords, _strip), lambda k: k != "")), 1, most)


def human_count(n: Column) -> Column:
    return F.when(n < 1000, n.cast("string")).when(n >= 1000, F.format_string("%.1fk", n / 1000))


def human_bytes(n: Column) -> Column:
    """Decimal units: 512 B, 1.5 MB."""
    out = F.when(n < 1000, F.format_string("%d B", n.cast("long")))
    for unit, size in (("KB", 1e3), ("MB", 1e6)):
        out = out.when(n < size * 1000, F.format_string(f"%.1f {unit}", n / size))
    return out.otherwise(F.format_string("%.1f GB", n / 1e9))


def elapsed(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return F.when(seconds < 60, F.format_string("%.0fs", seconds)).otherwise(F.format_string("%dm%02ds", F.floor(whole / 60), (whole % 60).cast("long")))


def percent(x: Column) -> Column:
    """A share as a percentage, as ``percentage`` has it."""
    return percentage(x * 100)


def percentage(x: Column) -> Column:
    """One decimal, halves of ten times the number away from zero; null for null."""
    return F.when(x.isNotNull(), F.format_string("%.1f %%", F.round(x * 10) / 10))
