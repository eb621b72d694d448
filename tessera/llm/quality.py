"""Quality rules, line first. DataFrame functions only.

Punctuation, navigation and boilerplate rules are evaluated per line, failing lines are removed,
then documents that lose too much of their text are rejected. Everything happens within the row,
so there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import WHITE, text_or_empty, unclashing, words

WORD, BLANK = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
#: A line whose words end in doubled symbols, one in four or more, is not prose.
DOUBLED = r"(?<![#*$%&|<>!?~^=_])[#*$%&|<>!?~^=_]{2,}+(?![^\x20\x09-\x0D])"
#: Separators that stand alone between the entries of a menu.
SEPARATOR = r"(?<![^\x20\x09-\x0D])[|>»›·•](?![^\x20\x09-\x0D])"
#: Phrases of page furniture; they count in short lines only. Fixed values.
BOILERPLATE = r"(?i)\b(all rights reserved|cookie policy|privacy policy|terms of (use|service)|click here|sign up|log in|subscribe to|javascript|lorem ipsum|share this|skip to content)\b"
#: The same in German, French and Spanish, and copyright signs. Fixed values.
FURNITURE = r"(?i)(?<![a-z0-9_])(?:alle rechte vorbehalten|datenschutzerkl|cookie-richtlinie|nutzungsbedingungen|hier klicken|tous droits r|politique de confidentialit|mentions l.gales|cliquez ici|conditions d.utilisation|todos los derechos reservados|aviso legal|haga clic aqu|condiciones de uso|iniciar sesi|\x{00A9} ?[0-9]{4}|\(c\) ?[0-9]{4}|copyright [0-9]{4})"
BOILERPLATE_WORDS, BOILERPLATE_CHARS = 20, 400
#: Characters of code, tables and markup; a line that has one in three of them is not prose.
SYMBOLS = r"[#*$%&|<>=_~^{}\\+@]"
#: A word that is an address.
LINK = r"^(?:https?://|www\.).|^[^@]+@[^@]+\.[a-z]+\z"
#: A word that is a number, a date or a time.
NUMBER = r"(?<![^\x20\x09-\x0D])[0-9][0-9.,:/%+-]*+(?![^\x20\x09-\x0D])"
#: A line of a few words and characters that doesn't end in one of these marks may be an entry of a menu; so many in a row are one.
TERMINAL, ENTRY_WORDS, ENTRY_CHARS, ENTRIES = r"[.,;:!?\x{2026}\x{3002}\x{FF01}\x{FF1F}\x22')\]\x{201D}\x{2019}\x{BB}][\x20\x09-\x0D]*\z", 4, 200, 4
#: Marks that end a sentence or a line of one. Where ENDED of the lines do, of ENDED_LINES lines or more, the others go if they are short; a long one is prose that was cut off. The same marks as in TERMINAL.
MARKS, ENDED, ENDED_LINES = ".,;:!?\u2026\u3002\uff01\uff1f\"')]\u201d\u2019\u00bb", 0.75, 4
#: A line that stands in a text so often stays once.
REPEATS = 3
#: A document is rejected if it keeps less than this share of its word characters.
LEAST_KEPT = 0.5
LEAST_WORDS = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, even where the optimiser copies the expression, as it does when a filter on the result moves down."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _word_chars(text: Column) -> Column:
    return F.char_length(text) - _count(text, BLANK)


def signs(text: Column) -> Column:
    """What rules need before they can remove any line of a text: symbols, separators, addresses, digits. Most prose has none, and its lines aren't searched for them."""
    doubled = [F.contains(text, F.lit(x)) for x in ("!!", "??", "!?", "?!")]  # of the doubled symbols those that SYMBOLS lacks
    found = {"symbols": F.rlike(text, F.lit(SYMBOLS)), "marks": F.lit(False), "links": F.contains(text, F.lit("www.")) | F.contains(text, F.lit("://")) | F.contains(text, F.lit("@")), "digits": F.rlike(text, F.lit("[0-9]"))}
    for x in doubled + [F.contains(text, F.lit(c)) for c in "»›·•"]:
        found["marks"] = found["marks"] | x
    return F.struct(*[c.alias(name) for name, c in found.items()])


def line_fails(line: Column, has: Column) -> Column:
    """True where a rule removes the line by itself; lines without a word stay. ``has`` are the signs of the line or of a text that holds it.

    * Punctuation: one word in four or more ends in doubled symbols, or a third or more of the word
      characters are symbols.
    * Navigation: a third or more of the words are separators of a menu, or half or more are addresses.
    * Digits: three words or more, half or more of them numbers, dates or times.
    * Boilerplate: 20 words and 400 characters at most, with a phrase of page furniture.
    """
    n = _count(line, WORD)  # counted only where a rule comes to need it
    noisy = (has["symbols"] | has["marks"]) & let(n, lambda m: (_count(line, DOUBLED) * 4 >= m) | (_count(line, SEPARATOR) * 3 >= m))
    symbols = has["symbols"] & (_count(line, SYMBOLS) * 3 >= _word_chars(line))
    links = has["links"] & F.rlike(line, F.lit("@|www|://")) & (F.size(F.filter(words(line), lambda w: F.rlike(w, F.lit(LINK)))) * 2 >= n)
    digits = has["digits"] & F.rlike(line, F.lit("[0-9]")) & (_count(line, NUMBER) * 2 >= n) & (n >= 3)
    furniture = (F.char_length(line) <= BOILERPLATE_CHARS) & (F.rlike(line, F.lit(BOILERPLATE)) | F.rlike(line, F.lit(FURNITURE))) & (n <= BOILERPLATE_WORDS)
    return (F.btrim(line, F.lit(WHITE)) != "") & (noisy | symbols | links | digits | furniture)


def _in_menus(lines: Column) -> Column:
    """Of every line whether it is one of ``ENTRIES`` or more entries of a menu that follow one another, blank lines apart; null where no line is."""

    def kind(line: Column) -> Column:
        entry = (_count(line, WORD) <= ENTRY_WORDS) & ~F.rlike(line, F.lit(TERMINAL))
        return F.when(F.char_length(line) > ENTRY_CHARS, "x").when(F.btrim(line, F.lit(WHITE)) == "", "b").when(entry, "s").otherwise("x")

    def marked(kinds: Column) -> Column:
        """The pattern takes runs whole and other lines one by one."""
        parts = F.regexp_extract_all(kinds, F.lit(rf"s(?:b*+s){{{ENTRIES - 1},}}+|."), F.lit(0))
        return F.flatten(F.transform(parts, lambda p: F.when(F.char_length(p) > 1, F.transform(F.split(p, ""), lambda c: c == "s")).otherwise(F.array(F.lit(False)))))

    run = lambda k: F.when(F.rlike(k, F.lit(rf"s(?:b*s){{{ENTRIES - 1}}}")), marked(k))
    return F.when(F.size(lines) >= ENTRIES, let(F.array_join(F.transform(lines, kind), ""), run))


def _short(line: Column) -> Column:
    return (F.char_length(line) <= BOILERPLATE_CHARS) & (_count(line, WORD) <= BOILERPLATE_WORDS)


def _unended(lines: Column) -> Column:
    """Of every line of 20 words and 400 characters at most whether it ends in no mark though the text's lines mostly do; null where the text has few lines, or too many such, or none."""
    ends = F.transform(lines, lambda line: let(F.right(F.btrim(line, F.lit(WHITE)), F.lit(1)), lambda c: F.when(c != "", F.contains(F.lit(MARKS), c))))

    def judged(e: Column) -> Column:
        worded, ended = F.size(F.filter(e, lambda x: x.isNotNull())), F.size(F.filter(e, lambda x: x))
        return F.when((worded >= ENDED_LINES) & (ended < worded) & (ended >= worded * ENDED), F.transform(e, lambda x, i: F.coalesce(~x, F.lit(False)) & _short(F.get(lines, i))))

    return F.when(F.size(lines) >= ENDED_LINES, let(ends, judged))


def _repeated(lines: Column) -> Column:
    """Of every line whether it repeats an earlier one of a line that stands ``REPEATS`` times or more in the text; null where none does. Lines are sorted, so a text of many lines costs no more than that."""
    keyed = F.transform(lines, lambda line, i: F.struct(F.btrim(line, F.lit(WHITE)).alias("k"), i.alias("i")))

    def judged(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["k"] == x["k"], F.lit(False))
        again = lambda x, j: same(x, j - 1) & (same(x, j - 2) | same(x, j + 1)) & (x["k"] != "")
        return F.transform(F.sort_array(F.transform(s, lambda x, j: F.struct(x["i"].alias("i"), again(x, j).alias("r")))), lambda x: x["r"])

    worded = F.filter(keyed, lambda x: x["k"] != "")
    many = F.size(F.array_distinct(F.transform(worded, lambda x: x["k"]))) <= F.size(worded) - (REPEATS - 1)
    return F.when(F.size(lines) >= REPEATS, F.when(many, let(F.sort_array(keyed), judged)))


def passing(text: Column) -> Column:
    """struct<lines, n_failing, n_menu, n_unended, n_repeated>: the lines of ``text`` that no rule removes, and how many each rule removes; a line may fail several.

    Rules see the line alone (``line_fails``), its neighbours (entries of a menu), or all lines of
    the text: where most end in a mark of punctuation, a short one that doesn't is a heading, a caption or a
    button; and a line that stands there again and again is furniture whatever it says, so that only
    its first stays.
    """

    def cleaned(p: Column) -> Column:
        ls, has = p["lines"], p["signs"]
        flags = F.struct(F.transform(ls, lambda line: line_fails(line, has)).alias("failing"), _in_menus(ls).alias("menu"), _unended(ls).alias("unended"), _repeated(ls).alias("repeated"))
        names = ("failing", "menu", "unended", "repeated")

        def kept(f: Column) -> Column:
            goes = lambda i: F.coalesce(F.get(f["failing"], i), F.lit(False)) | F.coalesce(F.get(f["menu"], i), F.lit(False)) | F.coalesce(F.get(f["unended"], i), F.lit(False)) | F.coalesce(F.get(f["repeated"], i), F.lit(False))
            count = lambda name: F.coalesce(F.size(F.filter(f[name], lambda x: x)), F.lit(0)).cast("long")
            return F.struct(F.filter(ls, lambda line, i: ~goes(i)).alias("lines"), *[F.greatest(count(n), F.lit(0)).alias(f"n_{n}") for n in names])

        return let(flags, kept)

    return let(F.struct(F.split(text, "\n", -1).alias("lines"), signs(text).alias("signs")), cleaned)


#: Bits of a place within a text in the sorted keys below; a text has fewer than 2 ** 31 characters, so fewer words.
_PLACE_BITS = 30


def _repeated_words(w: Column) -> Column:
    """Words within 3-word windows that occur twice or more.

    Windows are hashed. Where hashes repeat, keys of the upper bits of a hash and the window's place
    are sorted as numbers; neighbours with the same upper bits are compared by the whole hash. Should
    two different hashes share their upper bits, that text is sorted by whole hashes instead.
    """
    place = (1 << _PLACE_BITS) - 1
    upper = lambda x: F.shiftright(x, _PLACE_BITS)

    def measured(places: Column) -> Column:
        """The union of windows of three words at ``places``, which are sorted."""
        gaps = F.transform(places, lambda at, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - at, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    def by_upper(h: Column, s: Column) -> Column:
        again = F.filter(s, lambda x, k: upper(F.get(s, k - 1)).eqNullSafe(upper(x)) | upper(F.get(s, k + 1)).eqNullSafe(upper(x)))

        def checked(x: Column) -> Column:
            at = F.transform(x, lambda v: v.bitwiseAND(F.lit(place)).cast("int"))
            clash = F.size(F.array_distinct(F.transform(at, lambda i: F.get(h, i)))) != F.size(F.array_distinct(F.transform(x, upper)))
            return F.when(clash, by_whole(h)).otherwise(let(F.sort_array(at), measured))

        return let(again, checked)

    def by_whole(h: Column) -> Column:
        def places(s: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, k: same(k, k - 1) | same(k, k + 1)), lambda x: x["i"]))

        return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda s: let(places(s), measured))

    def counted(h: Column) -> Column:
        keys = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(upper(x), _PLACE_BITS).bitwiseOR(i.cast("long"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(keys, lambda s: by_upper(h, s)))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows, counted))


REMOVED = ("n_failing", "n_menu", "n_unended", "n_repeated")


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_kept: float = LEAST_KEPT, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, kept_text, and the lines that each rule removes: n_failing, n_menu, n_unended, n_repeated.

    * kept_text has the lines that pass (see ``line_fails`` and ``passing``), joined by \\n. kept is
      false where the base rules fail (under 50 words, or over half of the words in repeated 3-word
      windows) or where the lines that pass hold less than ``least_kept`` of the word characters.
    * Null or empty text: no words, so base_failed. Repeated rows are judged one by one; a null
      doc_id is returned as it is. Other columns are not read. An empty table gives none.
    * 3-word windows are compared by 64-bit hashes within one document.
    * The columns named in ``carry`` are returned too, each row's own; a name that clashes is an error.
    """
    unclashing(carry, doc_id, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_text", *REMOVED)
    src = docs.select(F.col(doc_id).alias("__id"), text_or_empty(text).alias("__text"), *carry)
    by_words = lambda w: F.struct(F.size(w).cast("long").alias("n"), F.char_length(F.array_join(w, "")).cast("long").alias("chars"), _repeated_words(w).cast("long").alias("repeat"))
    worded = F.filter(F.split("__text", "\n", -1), lambda line: F.btrim(line, F.lit(WHITE)) != "")
    counted = src.select(
        "__id",
        let(words(F.col("__text")), by_words).alias("__w"),
        _count(F.col("__text"), "[#*$%&|<>]").cast("long").alias("n_symbols"),
        let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(passing(F.col("__text")), lambda x: F.struct(F.array_join(x["lines"], "\n").alias("text"), *[x[c] for c in REMOVED])).alias("__p"),
        (F.octet_length("__text")).alias("__octets"),
        *carry,
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    named = counted.select("__id", F.col("__w.n").alias("n_words"), F.col("__w.chars").alias("word_chars"), "n_symbols", "n_dup_lines", F.col("__w.repeat").alias("n_repeat_words"), F.col("__p.text").alias("kept_text"), *[F.col(f"__p.{c}").alias(c) for c in REMOVED], "__octets", *carry)
    whole = F.octet_length("kept_text") == F.col("__octets")  # nothing was removed
    enough = whole | (_word_chars(F.col("kept_text")) >= F.col("word_chars") * F.lit(least_kept))
    return named.select(F.col("__id").alias(doc_id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & enough).alias("kept"), "kept_text", *REMOVED, *carry)
