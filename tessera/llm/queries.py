"""The queries of this package: each operator over its whole table, and DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.ann import nearest
from tessera.llm.collocations import collocations
from tessera.llm.importance import resample
from tessera.llm.line_dedup import drop_shared_lines
from tessera.llm.packing import pack
from tessera.llm.quality import quality
from tessera.llm.secrets import BASE, secret_spans
from tessera.llm.sentencepiece_bpe import encoded
from tessera.llm.sharding import shard
from tessera.llm.simhash import near_duplicates
from tessera.llm.token_counts import document_tokens
from tessera.llm.toxicity import toxicity
from tessera.llm.url_filter import judge_urls

#: Separator of the 50k byte-level vocabulary.
SEPARATOR = 50256


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_shared_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secret_spans(_table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in BASE]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"].isin(kinds))
    return found.select("doc_id", *map(count, kinds), F.sha2(joined(base), 256).alias("base_sha256"), joined("found").alias("spans"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_tokens(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), SEPARATOR)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encoded(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_sharding, op3_url_filter, op4_nearest, op5_simhash, op6_packing, op7_secrets, op8_token_counts, op9_quality, op10_sentencepiece, op11_importance, op12_toxicity, op13_collocations)}

_WHITE = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH lines AS (
  SELECT doc_id, line, pos, {_LOWER.format(f"trim(line, {_WHITE})")} AS key
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT l.doc_id, l.line, l.pos, s.key IS NOT NULL AND l.doc_id IS DISTINCT FROM s.keeper AS lost FROM lines l LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

#: The walk is followed for 120 rounds, after which 0.85 ** 120 of it is left to move.
OP3_SQL = r"""
WITH RECURSIVE p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
hp AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, html, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM p)),
rules(rule_host, rule_path, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit AS (SELECT DISTINCT host, path, rule_host || rule_path AS rule, v FROM (SELECT DISTINCT host, path FROM hp) JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path)),
won AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM fit GROUP BY host, path),
judged AS (SELECT page_id, hp.host, hp.path, rule, v FROM hp LEFT JOIN won ON hp.host = won.host AND hp.path = won.path),
link AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)\bhref[\x20\x09-\x0D]*=[\x20\x09-\x0D]*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''\x20\x09-\x0D>]*)', 1)) AS target FROM hp),
dst AS (SELECT src, translate(regexp_extract(target[strpos(target, '//') + 2:], '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM link),
edge AS (SELECT src, dst, count(*) AS w FROM dst WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
step AS (SELECT kind, src, dst, w / sum(w) OVER (PARTITION BY kind, src) AS share FROM (SELECT 'allow' AS kind, src, dst, w FROM edge UNION ALL SELECT 'block', dst, src, w FROM edge)),
base AS (SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS rank FROM (SELECT v AS kind, host, count(*) AS n FROM judged WHERE v IS NOT NULL AND host <> '' GROUP BY 1, 2)),
walk AS (
  SELECT 0 AS i, kind, host, rank FROM base
  UNION ALL
  SELECT i + 1, kind, host, sum(rank) FROM (
    SELECT walk.i, walk.kind, step.dst AS host, 0.85 * walk.rank * step.share AS rank FROM walk JOIN step ON walk.kind = step.kind AND walk.host = step.src WHERE walk.i < 120
    UNION ALL SELECT walk.i, walk.kind, walk.host, 0.15 * walk.rank FROM (SELECT DISTINCT walk.i AS i, base.kind, base.host, base.rank FROM walk, base WHERE walk.i < 120) walk)
  GROUP BY i, kind, host),
last AS (SELECT kind, host, rank / sum(rank) OVER (PARTITION BY kind) AS share FROM walk WHERE i = (SELECT max(i) FROM walk)),
spread AS (SELECT host, (coalesce(sum(share) FILTER (kind = 'block'), 0) - coalesce(sum(share) FILTER (kind = 'allow'), 0)) * (SELECT count(DISTINCT host) FROM last) > 0.05 AS bad FROM last GROUP BY host)
SELECT page_id, judged.host, path, rule, coalesce(v, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict FROM judged LEFT JOIN spread ON judged.host = spread.host
"""

_ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("'", "''")
_PEM, _JWT = r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}"

OP7_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
rules(kind, place, pattern, grp, least) AS (VALUES
  ('assign', 0, '{_ASSIGN}', 1, 8), ('access', 1, 'AKIA[A-Z0-9]+', 0, 16), ('hex', 2, '[0-9a-f]{{32,}}', 0, 32), ('pem', 3, '{_PEM}', 0, 0), ('jwt', 4, '{_JWT}', 0, 0)),
raw AS (
  SELECT doc_id, text, kind, place, least,
    CASE kind WHEN 'assign' THEN regexp_extract_all(text, '{_ASSIGN}') WHEN 'access' THEN regexp_extract_all(text, 'AKIA[A-Z0-9]+') WHEN 'pem' THEN regexp_extract_all(text, '{_PEM}') WHEN 'jwt' THEN regexp_extract_all(text, '{_JWT}') ELSE regexp_extract_all(text, '[0-9a-f]{{32,}}') END AS found,
    CASE kind WHEN 'assign' THEN regexp_extract_all(text, '{_ASSIGN}', 1) WHEN 'access' THEN regexp_extract_all(text, 'AKIA[A-Z0-9]+') WHEN 'pem' THEN regexp_extract_all(text, '{_PEM}') WHEN 'jwt' THEN regexp_extract_all(text, '{_JWT}') ELSE regexp_extract_all(text, '[0-9a-f]{{32,}}') END AS value,
    CASE kind WHEN 'assign' THEN regexp_split_to_array(text, '{_ASSIGN}') WHEN 'access' THEN regexp_split_to_array(text, 'AKIA[A-Z0-9]+') WHEN 'pem' THEN regexp_split_to_array(text, '{_PEM}') WHEN 'jwt' THEN regexp_split_to_array(text, '{_JWT}') ELSE regexp_split_to_array(text, '[0-9a-f]{{32,}}') END AS gaps
  FROM d, rules
), spans AS (
  SELECT doc_id, kind, place, s, s + length(found[i]) AS e, length(value[i]) >= least AS good FROM (
    SELECT doc_id, kind, place, least, found, value, i,
      list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s
    FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM raw WHERE len(found) > 0))
), kept AS (SELECT * FROM spans WHERE good),
joined AS (
  SELECT d.doc_id, count(*) FILTER (kind = 'assign')::BIGINT AS n_assign, count(*) FILTER (kind = 'access')::BIGINT AS n_access, count(*) FILTER (kind = 'hex')::BIGINT AS n_hex,
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (kind IS NOT NULL), '') AS spans, coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (place < 3), '') AS base
  FROM d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, n_assign, n_access, n_hex, sha256(base) AS base_sha256, spans FROM joined
"""

_W = r"[\x20\x09-\x0D]"

OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(text, '{_W}+'), lambda x: x <> '') AS w FROM d),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
rep AS (SELECT r, count(DISTINCT p)::BIGINT AS n FROM (
  SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1) GROUP BY r),
line AS (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
parts AS (SELECT *, list_filter(regexp_split_to_array(line, '{_W}+'), lambda x: x <> '') AS w, length(regexp_replace(line, '{_W}', '', 'g')) AS chars FROM line),
judged AS (SELECT *, len(w) > 0 AND (
    len(regexp_extract_all(line, '[#*$%&|<>!?~^=_]{{2,}}(?:{_W}|$)')) * 4 >= len(w)
    OR len(list_filter(w, lambda y: y IN ('|', '>', '»', '›', '·', '•'))) * 3 >= len(w)
    OR len(regexp_extract_all(line, '[#*$%&|<>=_~^{{}}\\+@]')) * 3 >= chars
    OR len(list_filter(w, lambda y: regexp_matches(y, '^(https?://|www\.).') OR regexp_matches(y, '^[^@]+@[^@]+\.[a-z]+$'))) * 2 >= len(w)
    OR (len(w) >= 3 AND len(list_filter(w, lambda y: regexp_matches(y, '^[0-9][0-9.,:/%+-]*$'))) * 2 >= len(w))
    OR (len(w) <= 20 AND length(line) <= 400 AND (
      regexp_matches(line, '(?i)\b(all rights reserved|cookie policy|privacy policy|terms of (use|service)|click here|sign up|log in|subscribe to|javascript|lorem ipsum|share this|skip to content)\b')
      OR regexp_matches(line, '(?i)(^|[^a-z0-9_])(alle rechte vorbehalten|datenschutzerkl|cookie-richtlinie|nutzungsbedingungen|hier klicken|tous droits r|politique de confidentialit|mentions l.gales|cliquez ici|conditions d.utilisation|todos los derechos reservados|aviso legal|haga clic aqu|condiciones de uso|iniciar sesi|© ?[0-9]{{4}}|\(c\) ?[0-9]{{4}}|copyright [0-9]{{4}})')))) AS fails,
  len(w) BETWEEN 1 AND 4 AND length(line) <= 200 AND NOT regexp_matches(line, '[.,;:!?…！？"''\])”’»]{_W}*$') AS entry FROM parts),
run AS (SELECT r, pos, entry AND count(*) OVER (PARTITION BY r, entry, island) >= 4 AS menu FROM (
  SELECT r, pos, entry, row_number() OVER (PARTITION BY r ORDER BY pos) - row_number() OVER (PARTITION BY r, entry ORDER BY pos) AS island FROM judged WHERE len(w) > 0)),
ended AS (SELECT r, pos, n, size, ended, count(ended) OVER w AS worded, count(*) FILTER (ended) OVER w AS n_ended, count(*) OVER k AS again, row_number() OVER (PARTITION BY r, key ORDER BY pos) AS nth, key FROM (
  SELECT r, pos, len(w) AS n, length(line) AS size, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key, CASE WHEN len(w) > 0 THEN contains('.,;:!?…。！？"'')]”’»', right(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1)) END AS ended FROM judged)
  WINDOW w AS (PARTITION BY r), k AS (PARTITION BY r, key)),
doc AS (SELECT r, pos, coalesce(worded >= 4 AND n_ended < worded AND n_ended * 4 >= worded * 3 AND NOT ended AND n <= 20 AND size <= 400, false) OR (key <> '' AND again >= 3 AND nth > 1) AS lost FROM ended),
left_over AS (SELECT judged.r, sum(chars) AS word_chars, sum(chars) FILTER (NOT fails AND NOT coalesce(menu, false) AND NOT lost) AS left_chars, count(*) FILTER (len(w) > 0) - count(DISTINCT line) FILTER (len(w) > 0) AS dup
  FROM judged LEFT JOIN run ON judged.r = run.r AND judged.pos = run.pos JOIN doc ON judged.r = doc.r AND judged.pos = doc.pos GROUP BY judged.r),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(left_chars, 0) AS left_chars
  FROM d JOIN w ON d.r = w.r JOIN left_over ON d.r = left_over.r LEFT JOIN rep ON d.r = rep.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND left_chars >= word_chars * 0.5 AS kept FROM m
"""

#: CRC-32 is folded over the bytes of every distinct word.
OP11_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
texts AS (SELECT 'd' AS side, row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT side, r, unnest(list_filter(regexp_split_to_array(text, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS word FROM texts),
bytes AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM w)),
hashed AS (SELECT word, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1),
  lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM bytes, crc),
f AS (SELECT side, r, bucket FROM w JOIN hashed USING (word)),
counts AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM f GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM counts),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS g FROM counts, sums),
per AS (SELECT r, count(*) AS n, sum(g) AS weight FROM f JOIN gain USING (bucket) WHERE side = 'd' GROUP BY r),
h AS (SELECT r, doc_id, list_reduce(list_transform(range(8), lambda i: strpos('0123456789abcdef', sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[i + 1]) - 1), lambda a, b: a * 16 + b, 0::BIGINT) AS h FROM texts WHERE side = 'd'),
scored AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, (coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE))))::BIGINT AS score FROM h LEFT JOIN per USING (r)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN place END AS rank FROM ranked
"""

OP13_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t)),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) AS x(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
cuts AS (SELECT lang, k, phrase, a, i, array_to_string(w[1:i], ' ') AS lp, array_to_string(w[i + 1:k], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS i FROM cand)),
scored AS (SELECT c.lang, c.k, c.phrase, a, fl.f AS l, fr.f AS r, i, (2000000::HUGEINT * a // (fl.f::HUGEINT + fr.f))::BIGINT AS score FROM cuts c JOIN f fl ON fl.lang = c.lang AND fl.phrase = c.lp JOIN f fr ON fr.lang = c.lang AND fr.phrase = c.rp),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
inner_ AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM cand)) GROUP BY ALL),
standing AS (SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank FROM best LEFT JOIN inner_ ON best.lang = inner_.lang AND best.phrase = inner_.phrase WHERE NOT coalesce(100 * most >= 80 * a, false))
SELECT s.lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM standing s JOIN sizes USING (lang) WHERE rank <= 2000
"""

SQL = {"op1_line_dedup": OP1_SQL, "op3_url_filter": OP3_SQL, "op7_secrets": OP7_SQL, "op9_quality": OP9_SQL, "op11_importance": OP11_SQL, "op13_collocations": OP13_SQL}
