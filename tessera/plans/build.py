"""Building and refreshing an index, embedding it, and its reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import evaluation as ev
from tessera.operators import store as st
from tessera.operators.graph import edges_after, infer_edges
from tessera.plans import tables
from tessera.schema import CHUNK_KINDS
from tessera.session import numbered, scratch_path, written
from tessera.sources.languages import Registry
from tessera.sources.symbols import extract_symbols


#: What edges are inferred from.
LINKED = ["id", "file_path", "kind", "name", "language", "line_start", "metadata"]


def build(store: st.Store, repo_id: int, snapshot: str, files: DataFrame, registry: Registry | None = None, at=None) -> st.Store:
    """The store with a snapshot of ``files`` (file_path, content) indexed.

    Only blobs that aren't current are parsed, once: their chunks are written, and so is what edges
    are inferred from. Edges are inferred over the whole snapshot, or, where the repository has an
    indexed snapshot already, for the imports that the changed files concern. Chunks and their files
    come together, and the completion row is last.
    """
    registry = registry or Registry()
    spark = files.sparkSession
    text = files.select("file_path", F.col("content").cast("string").alias("content"), F.md5(F.col("content").cast("binary")).alias("blob_sha"))
    text = text.withColumn("language", registry.detect(F.col("file_path")))
    serials = spark.createDataFrame(registry.serials(), "language string, extraction_serial int")
    current = st.blobs_current(store, text.select("blob_sha", "language").distinct(), serials).filter("up_to_date").select("blob_sha")
    present = store.chunks.select("blob_sha", "file_path").distinct()
    due = text.join(text.join(current, "blob_sha", "left_semi").join(present, ["blob_sha", "file_path"], "left_semi").select("blob_sha", "file_path"), ["blob_sha", "file_path"], "left_anti")
    parsed = written(extract_symbols(due, registry.serials(), registry.languages).select(*store.chunks.columns), "parsed")
    rows = written(text.select(F.lit(repo_id).cast("int").alias("repo_id"), F.lit(snapshot).alias("snapshot_sha"), "file_path", "blob_sha", F.col("language").alias("detected_language")), "files")
    staged = store.but(chunks=st.upsert_chunks(store.chunks, parsed), file_snapshots=st.replace_snapshot(store.file_snapshots, repo_id, snapshot, rows))
    seen = written(st.at_snapshots(staged, repo_id=repo_id, snapshot=snapshot).select(*LINKED), "seen")
    edges = written(_edges(store, repo_id, snapshot, seen, rows, parsed, registry), "edges")
    edges = edges.select(F.lit(repo_id).cast("int").alias("repo_id"), "source_id", "target_id", "kind", F.lit(snapshot).alias("snapshot_sha"))
    return staged.but(edges=st.replace_snapshot(store.edges, repo_id, snapshot, edges), indexed_snapshots=st.mark_indexed(store.indexed_snapshots, repo_id, snapshot, at))


def _edges(store: st.Store, repo_id: int, snapshot: str, seen: DataFrame, rows: DataFrame, parsed: DataFrame, registry: Registry) -> DataFrame:
    """The edges of ``snapshot``, from those of the repository's latest other snapshot where there is one. Files whose blob was parsed anew count as changed, as an extractor may have."""
    last = st.latest_snapshots(store.but(indexed_snapshots=store.indexed_snapshots.filter((F.col("repo_id") == repo_id) & (F.col("snapshot_sha") != snapshot)))).first()
    paths = rows.select("file_path")
    if last is None:
        return infer_edges(seen, paths, registry.languages)
    own = (F.col("repo_id") == repo_id) & (F.col("snapshot_sha") == last.snapshot_sha)
    old = store.file_snapshots.filter(own).select("file_path", F.col("blob_sha").alias("old"))
    changed = rows.join(old, "file_path", "full").filter(~F.col("blob_sha").eqNullSafe(F.col("old"))).select("file_path").unionByName(parsed.select("file_path"))
    before = st.at_snapshots(store, repo_id=repo_id, snapshot=last.snapshot_sha).select(*LINKED)
    return edges_after(store.edges.filter(own), before, seen, paths, written(changed.distinct(), "changed"), registry.languages)


def embedding_text(name, content):
    return F.concat_ws("\n", name, content)


def vectors_of(texts: DataFrame, model: Callable[[list[str]], list[tuple[list[float], bool]]]) -> DataFrame:
    """(id, embedding, embedding_truncated) of ``texts`` (id, text); ``model`` maps texts to (vector, truncated)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 32):
                part = batch.iloc[i : i + 32]
                made = model(part["text"].tolist())
                yield pd.DataFrame({"id": part["id"].to_numpy(), "embedding": [list(map(float, v)) for v, _ in made], "embedding_truncated": [t for _, t in made]})

    return texts.mapInPandas(run, tables.VECTORS)


def embed(store: st.Store, model: Callable[[list[str]], list[tuple[list[float], bool]]]) -> st.Store:
    """Chunks without a vector get one."""
    due = store.chunks.filter(F.col("embedding").isNull()).select("id", embedding_text(F.col("name"), F.col("content")).alias("text"))
    return store.but(chunks=st.update_embeddings(store.chunks, vectors_of(due, model).withColumnRenamed("embedding_truncated", "truncated")))


def hashed_vectors(texts: list[str], size: int = 16) -> list[tuple[list[float], bool]]:
    """A stand-in for a model: hashed word counts."""
    import zlib

    out = []
    for t in texts:
        v = [0.0] * size
        for w in t.lower().split():
            v[zlib.crc32(w.encode()) % size] += 1.0
        out.append((v, len(t) > 8192))
    return out


# --- reports -----------------------------------------------------------------

def repo_report(store: st.Store) -> DataFrame:
    """Chunks, embedded and truncated ones, and edges of every repository, zero where it has none."""
    seen = st.at_snapshots(store).groupBy("repo_id", "id").agg(F.max(F.col("embedding").isNotNull()).alias("e"), F.max("embedding_truncated").alias("t"))
    per = seen.groupBy("repo_id").agg(F.count("*").alias("chunks"), F.count_if("e").alias("embedded"), F.count_if("t").alias("truncated"))
    edges = store.edges.groupBy("repo_id").agg(F.count("*").alias("edges"))
    out = store.repos.join(per, F.col("id") == per.repo_id, "left").drop("repo_id").join(edges, F.col("id") == edges.repo_id, "left").drop("repo_id")
    return out.select("path", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("chunks", "embedded", "truncated", "edges")]).orderBy("path")


def group_report(store: st.Store, by: str) -> DataFrame:
    """Chunks by kind or language with the edges that leave and reach them; an empty language reads (plaintext)."""
    label = F.when(F.col(by) == "", "(plaintext)").otherwise(F.col(by))
    chunks = store.chunks.select("id", label.alias(by))
    ends = lambda column, name: store.edges.select(column).join(chunks, F.col(column) == F.col("id")).groupBy(by).agg(F.count("*").alias(name))
    out = chunks.groupBy(by).agg(F.count("*").alias("n")).join(ends("source_id", "outbound_edges"), by, "left").join(ends("target_id", "inbound_edges"), by, "left")
    return out.fillna(0, ["outbound_edges", "inbound_edges"])


def totals(store: st.Store) -> DataFrame:
    chunks = store.chunks.agg(F.count("*").alias("total_chunks"), F.count("embedding").alias("with_embedding"), F.count_if("embedding_truncated").alias("truncated"))
    return chunks.crossJoin(F.broadcast(store.edges.agg(F.count("*").alias("total_edges"))))  # one row


def truncated_targets(store: st.Store) -> DataFrame:
    seen = st.at_snapshots(store).filter("embedding_truncated").join(store.repos.withColumnRenamed("id", "repo"), F.col("repo_id") == F.col("repo"))
    return seen.select("path", "file_path", "scope", "name", "line_start").distinct()


# --- version gates and pending work ------------------------------------------------

def version_gate(stored: str | None, own: str) -> str:
    """``keep``, ``wipe`` (stored is older or absent) or ``refuse`` (stored is newer)."""
    if stored is None:
        return "wipe"
    parts = lambda v: [int(x) for x in v.split(".")]
    return "keep" if parts(stored) == parts(own) else "wipe" if parts(stored) < parts(own) else "refuse"


def model_gate(store: st.Store, stored: tuple[str, str] | None, own: tuple[str, str]) -> st.Store:
    """Vectors of another model or version go."""
    return store if stored == own else store.but(chunks=st.clear_embeddings(store.chunks))


def opened(store: st.Store, schema: str, model: tuple[str, str]) -> st.Store:
    """The store as a program of this ``schema`` version and embedding ``model`` (name, version) may use it.

    An older or unmarked schema is wiped, a newer one is refused; vectors of another model go. The
    settings are then those of the program.
    """
    held = {} if store.meta is None else {r.key: r.value for r in st.get_meta(store, "schema_version", "embedding_model", "embedding_version").collect()}  # three rows
    verdict = version_gate(held.get("schema_version"), schema)
    if verdict == "refuse":
        raise ValueError(f"the index has schema {held['schema_version']}, which is newer than {schema}")
    if verdict == "wipe":
        store = st.wipe(store)
    else:
        store = model_gate(store, (held.get("embedding_model"), held.get("embedding_version")), model)
    return st.set_meta(store, schema_version=schema, embedding_model=model[0], embedding_version=model[1])


def embed_pages(spark, root: str, model: Callable[[list[str]], list[tuple[list[float], bool]]], page: int = 100_000) -> int:
    """Embeds what has no vector yet in the store at ``root``, ``page`` chunks to a commit; the pages done now.

    What is due is written once, by page. A page is read alone, goes to the model in tasks of a few
    hundred texts, and commits its vectors only. Chunks without a vector are the queue, so whatever
    ends the work, the next call goes on with the pages that weren't committed.
    """
    due = tables.load(spark, root).chunks.filter(F.col("embedding").isNull()).select("id", embedding_text(F.col("name"), F.col("content")).alias("text"))
    rows = numbered(due, "id").withColumn("page", F.floor((F.col("number") - 1) / page)).drop("number")
    queue = scratch_path(spark, "due")
    rows.write.partitionBy("page").parquet(queue)
    counts = spark.read.schema(rows.schema).parquet(queue).groupBy("page").count().orderBy("page").collect()  # one row a page
    for r in counts:
        texts = spark.read.schema("id string, text string").parquet(f"{queue}/page={r.page}").repartition(-(-r["count"] // 512))
        tables.append(spark, root, vectors=vectors_of(texts, model))
    return len(counts)


def profile(store: st.Store) -> tuple[DataFrame, DataFrame]:
    """(chunks by language and kind with their total, the same as percentages of the language)."""
    label = F.when(F.col("language") == "", "(plaintext)").otherwise(F.col("language"))
    counts = ev.pivot(store.chunks.withColumn("language", label), "language", "kind", list(CHUNK_KINDS), F.count(F.lit(1)), total="total")
    return counts, ev.row_percent(counts.drop("total"), list(CHUNK_KINDS))


def pending_jobs(store: st.Store, desired: DataFrame) -> DataFrame:
    """(repo_id, snapshot_sha, job) for ``desired`` snapshots: builds of those not indexed, then embeds of those with chunks that lack vectors."""
    wanted = desired.select(*st.SNAPSHOT_KEY).distinct()
    builds = wanted.join(store.indexed_snapshots.select(*st.SNAPSHOT_KEY), st.SNAPSHOT_KEY, "left_anti").withColumn("job", F.lit("build"))
    lacking = st.snapshot_status(store).filter(F.col("embedded") < F.col("total")).select(*st.SNAPSHOT_KEY)
    embeds = wanted.join(store.indexed_snapshots.select(*st.SNAPSHOT_KEY), st.SNAPSHOT_KEY, "left_semi").join(lacking, st.SNAPSHOT_KEY, "left_semi").withColumn("job", F.lit("embed"))
    return builds.unionByName(embeds).orderBy(F.col("job") != "build", *st.SNAPSHOT_KEY)


def missing_languages(store: st.Store, registry: Registry) -> DataFrame:
    """Languages of the index that no registration covers."""
    known = [i for i in registry.languages] + [""]
    return store.chunks.select("language").distinct().filter(~F.col("language").isin(known))


def read_snapshot(store: st.Store, repo_id: int, explicit: str | None) -> str:
    """The snapshot that a request reads: the one it names, which must be indexed, else the latest."""
    own = store.indexed_snapshots.filter(F.col("repo_id") == repo_id)
    if explicit is not None:
        if own.filter(F.col("snapshot_sha") == explicit).isEmpty():
            raise LookupError(f"{explicit} isn't indexed")
        return explicit
    row = st.latest_snapshots(store).filter(F.col("repo_id") == repo_id).first()
    if row is None:
        raise LookupError(f"repository {repo_id} has no index")
    return row.snapshot_sha
