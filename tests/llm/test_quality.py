import re
from collections import Counter

import pytest

from tessera.llm.quality import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def check(df):
    got = quality(df).collect()
    want = sorted((str(r.doc_id), *base(r.text)) for r in df.collect())
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(not r.kept or not r.base_failed for r in got)
    return got


def test_odd_rows(odd):
    check(odd)


def test_documents(spark, tiny):
    check(spark.read.parquet(f"{tiny}/documents.parquet"))


def test_empty(none):
    assert quality(none).count() == 0


def test_repeats_of_all_kinds(spark):
    texts = ["a a a a", "a b c a b c", "a b c d a b", "a a a", "x y z x y z x y", "a b a b a b a", " ".join("abcdefghij") + " q " + " ".join("abcdefghij")]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))


def test_lines_are_cleaned_first_and_losers_are_rejected(spark):
    prose = " ".join(f"word{i}," for i in range(60)) + " end."
    noise = " ".join(f"n{i}###" for i in range(80))
    menu = " | ".join(f"m{i}" for i in range(40))
    rows = [(1, prose), (2, prose + "\n" + noise), (3, prose + "\nshort### x"), (4, prose + "\n" + menu), (5, noise), (6, prose + "\nAll rights reserved."), (7, "SHOUT!! " * 60), (8, prose + "\na - b | c")]
    got = {r.doc_id: r for r in quality(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {i for i, r in got.items() if r.kept} == {1, 3, 4, 6, 8}
    assert got[3].kept_text == got[4].kept_text == got[6].kept_text == prose and got[8].kept_text == rows[7][1]


def test_labelled_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = {r.doc_id: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    kept = {r.doc_id: r.kept for r in quality(docs).collect() if r.doc_id in labels and r.n_words >= 50 and not r.base_failed}
    good = [kept[d] for d in kept if labels[d] == 1]
    bad = [kept[d] for d in kept if labels[d] == 0]
    assert all(good) and sum(bad) <= 0.1 * len(bad)


PHRASES = re.compile(r"\b(all rights reserved|cookie policy|privacy policy|terms of (use|service)|click here|sign up|log in|subscribe to|javascript|lorem ipsum|share this|skip to content)\b", re.I | re.A)
OTHERS = re.compile(r"(?<![A-Za-z0-9_])(alle rechte vorbehalten|datenschutzerkl|cookie-richtlinie|nutzungsbedingungen|hier klicken|tous droits r|politique de confidentialit|mentions l.gales|cliquez ici|conditions d.utilisation|todos los derechos reservados|aviso legal|haga clic aqu|condiciones de uso|iniciar sesi|© ?[0-9]{4}|\(c\) ?[0-9]{4}|copyright [0-9]{4})", re.I)


def line_goes(line):
    w = WORD.findall(line)
    if not w:
        return False
    n, chars = len(w), sum(map(len, w))
    tail = [re.search(r"[#*$%&|<>!?~^=_]+$", x) for x in w]
    return (
        4 * sum(bool(m and len(m[0]) >= 2) for m in tail) >= n
        or 3 * sum(x in "|>»›·•" for x in w) >= n
        or 3 * sum(c in "#*$%&|<>=_~^{}\\+@" for c in line) >= chars
        or 2 * sum(bool(re.match(r"(https?://|www\.).", x) or re.fullmatch(r"[^@]+@[^@]+\.[a-z]+", x)) for x in w) >= n
        or (n >= 3 and 2 * sum(bool(re.fullmatch(r"[0-9][0-9.,:/%+-]*", x)) for x in w) >= n)
        or (n <= 20 and len(line) <= 400 and bool(PHRASES.search(line) or OTHERS.search(line)))
    )


def cleaned(text):
    """(kept_text, whether enough is left) by the rules of the docstrings."""
    lines = (text or "").split("\n")
    entry = [1 <= len(WORD.findall(x)) <= 4 and len(x) <= 200 and WORD.findall(x)[-1][-1] not in ".,;:!?…！？\"')]”’»" for x in lines]
    worded = [i for i, x in enumerate(lines) if WORD.search(x)]
    menu, run = set(), []
    for i in [*worded, None]:
        if i is not None and entry[i]:
            run.append(i)
        else:
            menu |= set(run) if len(run) >= 4 else set()
            run = []
    key = [x.strip(" \t\n\x0b\x0c\r") for x in lines]
    ended = {i for i in worded if key[i][-1] in ".,;:!?…。！？\"')]”’»"}
    strict = len(worded) >= 4 and len(ended) < len(worded) and 4 * len(ended) >= 3 * len(worded)
    times, repeated = Counter(key[i] for i in worded), set()
    for i in worded:
        if times[key[i]] >= 3 and key[i] in key[:i]:
            repeated.add(i)
    unended = {i for i in worded if strict and i not in ended and len(WORD.findall(lines[i])) <= 20 and len(lines[i]) <= 400}
    left = [x for i, x in enumerate(lines) if i not in menu | unended | repeated and not line_goes(x)]
    chars = lambda s: sum(map(len, WORD.findall(s)))
    return "\n".join(left), 2 * chars("\n".join(left)) >= chars(text or "")


def check_kept(df):
    want = []
    for r in df.collect():
        left, enough = cleaned(r.text)
        want.append((str(r.doc_id), left, not base(r.text)[-1] and enough))
    assert sorted((str(r.doc_id), r.kept_text, r.kept) for r in quality(df).collect()) == sorted(want)


def test_kept_like_brute_force(spark, odd, small):
    check_kept(odd)
    check_kept(spark.read.parquet(f"{small}/documents.parquet"))


def test_rules_that_see_the_whole_text(spark):
    s = [f"Sentence number {i} has enough words to be a sentence, and it ends." for i in range(9)]
    texts = [
        "\n".join([*s[:3], "A heading of the page"]), "\n".join([*s[:2], "one caption", "another caption"]), "\n".join([*s[:2], "no mark"]), "\n".join(s), "\n".join(x[:-1] for x in s), "\n".join([*s[:6], "heading", "", " \t", "button  ", s[6]]),
        "\n".join([*s[:4], "long " * 21]), "\n".join([*s[:4], "l" * 401]), "\n".join([*s[:4], "long " * 20]), "\n".join([*s[:4], "l" * 400]),
        "\n".join([*s[:3], "Read more.", s[3], " Read more.", s[4], "Read more.\t", s[5]]), "\n".join(["Twice only."] * 2 + s[:3]), "\n".join(["", "", "", " ", *s[:2]]), "\n".join([s[0]] * 3), "\n".join([s[0], s[1]] * 50), "\n".join(f"{i % 7}." for i in range(3000)),
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    check_kept(df)
    got = {r.doc_id: r for r in quality(df).collect()}
    assert got[0].kept_text == "\n".join(s[:3]) and got[0].n_unended == 1 and got[1].n_unended == 0 and got[5].n_unended == 2
    assert [got[i].n_unended for i in range(6, 10)] == [0, 0, 1, 1]
    assert got[10].n_repeated == 2 and got[10].kept_text.count("Read more.") == 1 and got[11].n_repeated == got[12].n_repeated == 0 and got[13].kept_text == s[0]


def test_names_that_clash_are_an_error(spark):
    with pytest.raises(ValueError):
        quality(spark.createDataFrame([(1, "x", 2)], "doc_id bigint, text string, kept int"), carry=("kept",))


def test_each_rule_and_its_limits(spark):
    prose = "A sentence of plain words stands here, and another one follows it. " * 2
    menu = ["Home", "Produkte und Preise", "Über uns", "Kontakt"]
    lines = [
        "a## b c d", "a## b c d e", "== x ==", "mot | mot", "a | b | c d e", "x = {y: [1]} + @z", "word " * 30, "word " * 29, "word " * 29 + "word,", "http://a.b/c text", "see http://a.b/c for more", "mail a.b@c.de", "a@b text more words",
        "12 34 56", "2024-01-01 12:00", "call 555 12345 now", "a1 b2 c3 4", "1,000 2.5% x 12:30/", "5" * 3000 + "x 1 2", "Alle Rechte vorbehalten.", "ALLE RECHTE VORBEHALTEN", "Malle rechte vorbehalten", "© 2024 Verlag", "(c) 2024", "Mentions légales", "click here " + "w " * 19, "click here " + "w " * 18, "x" * 400 + " click here", "=" * 3000 + "x", "a@" * 2000,
    ]
    texts = [prose * 3 + "\n" + x for x in lines]
    texts += [prose + "\n" + sep.join(menu) + "\n" + prose for sep in ("\n", "\n\n \n", "\n" + prose + "\n")] + ["\n".join(menu[:3]) + "\n" + prose, "\n".join([*menu, "Ende."]), "\n".join(menu * 3000), "\n".join(["Home.", "Back:", "a\u2028", *menu[:3]])]
    check_kept(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))


def test_clashing_hashes_are_told_apart(spark):
    """Keys that share their upper bits are compared by whole hashes."""
    from pyspark.sql import functions as F

    from tessera.llm import quality as q

    texts = ["a b c d e f g h i j k l m n", "a b c x a b c y z a b c", "p q r s p q r s p", *[" ".join("abcab"[i * k % 5] for i in range(40)) for k in range(1, 5)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bits, q._PLACE_BITS = q._PLACE_BITS, 62  # two bits of the hash are left: nearly all keys clash
    try:
        got = [r.n for r in df.select("doc_id", q._repeated_words(q.words(F.col("text"))).alias("n")).orderBy("doc_id").collect()]
    finally:
        q._PLACE_BITS = bits
    assert got == [base(t)[4] for t in texts]


def test_sql_says_the_same(spark, odd, small):
    import duckdb
    import pandas as pd

    from tessera.llm.queries import OP9_SQL

    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    for df in (odd, spark.read.parquet(f"{small}/documents.parquet")):
        con = duckdb.connect()
        con.register("raw", pd.DataFrame([(r.doc_id, r.text) for r in df.collect()], columns=["doc_id", "text"], dtype=object))
        con.execute("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text FROM raw")
        assert sorted(con.execute(OP9_SQL).fetchall(), key=str) == sorted((tuple(r) for r in quality(df).select(*columns).collect()), key=str)
