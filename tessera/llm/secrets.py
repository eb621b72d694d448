"""Secret scans over an incremental blob ledger. DataFrame functions only.

Every historical version of a text is addressed by its content (SHA-256). A ledger, kept as a
Parquet folder that grows from run to run, holds which (blob, rule, rule version) were scanned and
what was found, so a run scans only pairs it has not seen; findings are then joined back to every
path that holds the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import text_or_empty, unclashing, written
from tessera.session import scratch_path

LEDGER_SCHEMA = "blob string, kind string, version int, spans array<struct<start:long,end:long>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost matches that do not overlap; those whose ``group`` has fewer than ``least`` characters are dropped.

    ``hint`` is a cheaper pattern that every text with a match also matches.
    """

    kind: str
    pattern: str
    group: int
    least: int
    hint: str
    version: int = 1


#: Fixed values of the contract. ``{n,}`` stands where dropping short runs afterwards gives the same spans.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, r"(?i:password|passwd|secret|token|api_?key)[\"' :=]"),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16, r"AKIA[A-Z0-9]{12}"),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}"),
)
#: What the ledger's rules find besides: heads of private keys, and signed web tokens of three parts.
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, r"-----BEGIN "),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}", 0, 0, r"eyJ"),
)
RULES = (*BASE, *ADDED)


def _spans(text: Column, rule: Rule) -> Column:
    """array<struct<start,end>> in code points: the k-th match starts after k + 1 gaps and k matches."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    parts = F.struct(
        F.split(text, rule.pattern, -1).alias("gaps"),
        whole.alias("found"),
        (F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole).alias("value"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("out"))

    def placed(p: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            begin = acc["at"] + F.char_length(F.get(p["gaps"], i))
            end = begin + F.char_length(F.get(p["found"], i))
            one = F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end")))
            good = F.char_length(F.get(p["value"], i)) >= rule.least
            return F.struct(end.cast("long").alias("at"), F.when(good, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(p["found"]) - 1), start, step)["out"]

    found = F.get(F.transform(F.filter(F.array(parts), lambda p: F.size(p["found"]) > 0), placed), F.lit(0))
    none = F.array().cast("array<struct<start:long,end:long>>")
    return F.when(F.rlike(text, F.lit(rule.hint)), F.coalesce(found, none)).otherwise(none)


def addressed(docs: DataFrame, path: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """__path and __blob of every version; a null text is the empty blob."""
    return docs.select(F.col(path).alias("__path"), F.sha2(text_or_empty(text), 256).alias("__blob"), *carry)


def stored_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger kept in ``folder``; empty where nothing has been stored yet."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def _rule(r: Rule) -> Column:
    return F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Ledger rows for the (blob, rule version) pairs of ``docs`` that ``ledger`` lacks.

    Blobs are grouped by their hashes alone. A text moves only if a rule's hint matches it and its
    blob is due, and of the rows that share a blob only the one with the smallest path. Texts are
    dealt by (blob, path), so a blob that a third of all paths hold does not gather in one task; rows
    that repeat path and text are one before they move. So every due blob is scanned once.
    """
    hinted = F.lit(False)
    for r in rules:
        hinted = hinted | F.rlike("__text", F.lit(r.hint))
    texts = docs.select(F.col(path).alias("__path"), text_or_empty(text).alias("__text"))
    blob = F.sha2("__text", 256).alias("__blob")
    blobs = texts.select("__path", blob).groupBy("__blob").agg(F.min("__path").alias("__first"))
    wanted, none = F.array(*map(_rule, rules)), F.array().cast("array<struct<kind:string,version:int>>")
    if ledger is not None:
        done = ledger.select(F.col("blob").alias("__blob"), F.struct("kind", "version").alias("__rule")).groupBy("__blob").agg(F.collect_set("__rule").alias("__done"))
        blobs = blobs.join(done, "__blob", "left").withColumn("__wanted", F.array_except(wanted, F.coalesce("__done", none)))
    else:
        blobs = blobs.withColumn("__wanted", wanted)
    todo = written(blobs.filter(F.size("__wanted") > 0).select(F.col("__blob").alias("__b"), "__first", "__wanted"), "due-blobs")
    due = texts.filter(hinted).select("__path", "__text", blob).dropDuplicates(["__blob", "__path"]).join(todo, (F.col("__blob") == F.col("__b")) & F.col("__path").eqNullSafe(F.col("__first")))
    results = [F.when(F.array_contains("__wanted", _rule(r)), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), _spans(F.col("__text"), r).alias("spans"))) for r in rules]
    scanned = written(due.select("__blob", F.inline(F.filter(F.array(*results), lambda x: x.isNotNull()))), "scanned")
    clear = todo.join(scanned.select(F.col("__blob").alias("__b")), "__b", "left_anti").select(F.col("__b").alias("__blob"), F.inline("__wanted")).withColumn("spans", F.array().cast("array<struct<start:long,end:long>>"))
    return scanned.unionByName(clear).select(F.col("__blob").alias("blob"), "kind", F.col("version").cast("int").alias("version"), "spans")


def secret_spans(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(spans of every row of ``docs``, new ledger).

    The first frame has one row per row of ``docs``: path and ``found``, an array of
    (start, kind position, end, kind), in order of start and then of the rules. The second holds
    the ledger and the pairs scanned now. With ``folder`` the ledger is the one stored there and
    what is new is appended to it, in one commit; otherwise it is ``ledger``, and what is new is a
    scratch table.

    * Null or empty text: no spans. Rows that repeat a path or a text are each returned.
    * A null path is an ordinary path. Spans of different rules may overlap; all are returned.
    * Columns other than the two named are not read; empty tables give empty results.
    * The first frame also has the columns named in ``carry``, each row's own; a name that clashes is an error.

    Findings are gathered by blob and written before they are joined to the paths, so Spark can
    split the paths of a common blob over tasks.
    """
    spark = docs.sparkSession
    unclashing(carry, path, "blob", "found")
    if folder is not None:
        ledger = stored_ledger(spark, folder)
    fresh = scan_unseen(docs, ledger, rules, path, text).dropDuplicates(["blob", "kind", "version"])
    target = folder or scratch_path(spark, "ledger")
    fresh.write.mode("append").option("compression", "zstd").parquet(target)
    whole = stored_ledger(spark, target)
    if folder is None and ledger is not None:
        whole = ledger.select("blob", "kind", "version", "spans").unionByName(whole)
    place = F.coalesce(*[F.when(F.col("kind") == r.kind, F.lit(i)) for i, r in enumerate(rules)])
    marked = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), place.alias("place"), s["end"].alias("end"), F.col("kind").alias("kind")))
    by_blob = (
        whole.filter((F.size("spans") > 0) & F.array_contains(F.array(*map(_rule, rules)), F.struct("kind", "version")))
        .select("blob", marked.alias("spans"))
        .groupBy("blob")
        .agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("found"))
    )
    none = F.array().cast("array<struct<start:long,place:int,end:long,kind:string>>")
    rows = addressed(docs, path, text, carry).join(written(by_blob, "findings"), F.col("__blob") == F.col("blob"), "left")
    return rows.select(F.col("__path").alias(path), "__blob", F.coalesce("found", none).alias("found"), *carry).withColumnRenamed("__blob", "blob"), whole


def redacted(text: Column, found: Column, mark: str = "[REDACTED]") -> Column:
    """``text`` with every span of ``found`` replaced by ``mark``; spans that overlap or touch are replaced as one."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] > acc["at"]
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        first = F.size(acc["out"]) == 0
        out = F.when(fresh, F.concat(acc["out"], F.array(gap, F.lit(mark)))).when(first, F.array(F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    def close(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2147483647)))

    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(found, start, step, close))
