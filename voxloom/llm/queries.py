"""The registered queries of the training-data operators: thin callables over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import audio, bpe, conversations, hard_negatives, langid, license_scan, line_dedup, mixing, quality, simhash, suffix_dedup, toxicity, url_filter
from voxloom.llm.common import crc32_of_id, read_table


def vocabulary_path() -> str:
    """The public word-level vocabulary."""
    return importlib.import_module("public_tokenizers").path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc32_of_id(F.col("doc_id")) % 4 == 2, F.lit(False))  # a null id is not held out
    model = langid.train(docs.filter(~held_out).select("text", "lang"))
    found = langid.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicate_classes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(read_table(spark, sf_dir, "documents"), vocabulary_path())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = F.coalesce(crc32_of_id(F.col("doc_id")) % 3 == 1, F.lit(False))
    model = toxicity.train(docs, labels.filter(~held_out))
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows, named = mixing.mix(docs, keep=["doc_id"])
    size, copies = F.col(named["size"]), F.col(named["copies"])
    return rows.select(
        "doc_id", size.alias("size"), F.col(named["source_size"]).alias("source_size"), F.col(named["target"]).alias("target"),
        (size * copies).cast("long").alias("taken"), F.round(named["rate"], 6).alias("rate"), copies.alias("copies"),
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages").select("page_id", "url"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.store_texts(read_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = quality.judge(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(read_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, copies = conversations.damaged(read_table(spark, sf_dir, "conversations"))
    return conversations.repair(rows, copies=copies)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(read_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    changed = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"), anchor=F.col("vec_id") % 100 == 0, label=changed)


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_language_id, op2_simhash, op3_license_scan, op4_bpe, op5_toxicity, op6_mixing, op7_url_filter, op8_media, op9_quality, op10_suffix_dedup,
            op11_conversation_repair, op12_line_dedup, op13_hard_negatives,
        )
    }


_QUALITY_SQL = r"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i:i + 2]) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
raw AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
l AS (SELECT doc_id, source, t, regexp_replace(trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '[0-9]+', '0', 'g') AS line FROM raw WHERE line <> ''),
hosts AS (SELECT source, count(DISTINCT t) AS docs FROM d GROUP BY source),
freq AS (SELECT l.source, line FROM l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source WHERE line <> '' GROUP BY l.source, line HAVING count(DISTINCT t) >= 5 AND count(DISTINCT t) > least(5000, 0.1::DOUBLE * any_value(docs))),
gone AS (SELECT doc_id, sum(len(string_split(l.line, ' '))) AS n FROM l JOIN freq f ON l.line = f.line AND l.source IS NOT DISTINCT FROM f.source GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.r, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS removed_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT (removed_words > 0 AND n_words - removed_words < 0.5 * n_words) AS kept FROM b"""


_RULES_SQL = "\n".join(
    f"    WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'"
    for r in sorted(url_filter.RULES, key=lambda r: -len(r.name))
)
_ALLOWED_SQL = ", ".join(f"'{r.name}'" for r in url_filter.RULES if r.allow)


def _gram_sql(urls: str, alias: str) -> str:
    return f"{alias} AS (SELECT *, unnest(list_transform(range(1, length(url) + 2), lambda i: substr(repeat(chr(2), 3) || url || chr(3), i, 4))) AS gram FROM {urls})"


def _chance_sql(side: str) -> str:
    p = f"(1.0::DOUBLE / {url_filter.CODE_POINTS})"
    for k in range(4):
        p = f"((coalesce(t{k}.{side}, 0) + 0.5::DOUBLE * {p}) / (coalesce(x{k}.{side}, 0) + 0.5::DOUBLE))"
    return f"ln({p})"


_URL_SQL = rf"""WITH u AS (SELECT page_id, coalesce(url, '') AS url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE
{_RULES_SQL} END AS rule FROM u),
lab AS (SELECT DISTINCT url, rule IN ({_ALLOWED_SQL}) AS ok, md5(url)[1] > '3' AS counted FROM r WHERE rule IS NOT NULL),
{_gram_sql("(SELECT * FROM lab WHERE counted)", "g")},
c AS (SELECT gram, count(*) FILTER (ok) AS a, count(*) FILTER (NOT ok) AS r FROM g GROUP BY gram),
{", ".join(f"t{k} AS (SELECT substr(gram, {4 - k}, {k + 1}) AS key, sum(a) AS a, sum(r) AS r FROM c GROUP BY 1), x{k} AS (SELECT substr(gram, {4 - k}, {k}) AS key, sum(a) AS a, sum(r) AS r FROM c GROUP BY 1)" for k in range(4))},
want AS (SELECT DISTINCT url FROM r WHERE rule IS NULL UNION SELECT url FROM lab WHERE NOT counted),
{_gram_sql("want", "w")},
d AS (SELECT DISTINCT gram FROM w),
ratio AS (SELECT gram, {_chance_sql("a")} - {_chance_sql("r")} AS part FROM d
  {" ".join(f"LEFT JOIN t{k} ON t{k}.key = substr(gram, {4 - k}, {k + 1}) LEFT JOIN x{k} ON x{k}.key = substr(gram, {4 - k}, {k})" for k in range(4))}),
s AS (SELECT url, sum(part) / count(*) AS score FROM w JOIN ratio USING (gram) GROUP BY url),
st AS (SELECT avg(score) FILTER (ok) AS ma, avg(score) FILTER (NOT ok) AS mr, stddev_pop(score) FILTER (ok) AS sa, stddev_pop(score) FILTER (NOT ok) AS sr FROM lab JOIN s USING (url) WHERE NOT counted),
th AS (SELECT (ma * greatest(sr, 5e-10::DOUBLE) + mr * greatest(sa, 5e-10::DOUBLE)) / greatest(sa + sr, 1e-9::DOUBLE) AS t FROM st)
SELECT page_id, host, path, rule, CASE WHEN CASE WHEN rule IS NULL THEN coalesce(score >= t, true) ELSE rule IN ({_ALLOWED_SQL}) END THEN 'allow' ELSE 'block' END AS verdict,
  round(CASE WHEN rule IS NULL THEN score END, 6) AS score FROM r LEFT JOIN s USING (url), th"""


_CRC_TABLE = "list_transform(range(256), lambda n: list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n))"
_CRC = "xor(list_reduce(list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


def _path(cost: str, label: str, role: str, text: str, tail: str) -> str:
    """A weight of the repair in SQL: cost, labels and lines to the end, from those after the next step."""
    line = f"{role} || ':' || {text} || chr(10) || " if role else ""
    return f"{{'c': {cost} + ({tail}).c, 'a': '{label}' || ({tail}).a, 't': {line}({tail}).t}}"


def _row_weight(q: int) -> str:
    to = conversations.INSERTED[q]
    keep = " ".join(f"WHEN '{r}' THEN {_path('cut', 'K', 'role', 'text', f'v{n}')}" for r, n in conversations.GRAMMAR[q].items())
    rerole = _path("3 + cut", "R", f"'{conversations.ROLES[to]}'", "text", f"v{to}")
    free = f"list_filter([CASE substr(role, 1, 1) {keep} END, {rerole}], lambda x: x IS NOT NULL AND NOT forced)"
    return f"list_min({free} || [{_path('4', 'D', '', '', f'v{q}')}]) AS w{q}"


def _inserted_weight(q: int) -> str:
    one = conversations.INSERTED[q]
    two = conversations.INSERTED[one]
    insert = lambda to, tail: _path("3", "I", f"'{conversations.ROLES[to]}'", "''", tail)
    return f"list_min([w{q}, {insert(one, f'w{one}')}, {insert(one, insert(two, f'w{two}'))}]) AS v{q}"


_INSERTIONS = ", ".join(_inserted_weight(q) for q in range(4))
_REPAIR_SQL = rf"""WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS crc),
h AS (SELECT *, {_CRC} % 20 AS code FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations), crc),
d AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
  CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
  unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
n AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
  NOT regexp_matches(text, '[^ 	-
]') AS blank FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS (SELECT *, blank OR again AS forced, CASE WHEN NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 3 ELSE 0 END AS cut FROM n),
s AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
  count(*) FILTER (cut > 0) AS truncated, count(*) FILTER (i > 1 AND coalesce(substr(before, 1, 1) || substr(role, 1, 1), '') NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
e AS (SELECT {{'c': 0::BIGINT, 'a': '', 't': ''}} AS w0, {{'c': 1000000000000, 'a': '', 't': ''}} AS w1, {{'c': 1000000000000, 'a': '', 't': ''}} AS w2, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS w3),
r AS (SELECT s.conv_id, n + 1 AS place, {_INSERTIONS} FROM s, e
  UNION ALL
  SELECT conv_id, place, {_INSERTIONS} FROM (SELECT r.conv_id, r.place - 1 AS place, {", ".join(_row_weight(q) for q in range(4))}
    FROM r JOIN f ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = r.place - 1)),
o AS (SELECT DISTINCT conv_id FROM conversations)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v0.c, 0)::BIGINT AS cost, coalesce(v0.a, '') AS audit, sha256(coalesce(regexp_replace(v0.t, '
\z', ''), '')) AS repaired_sha256
FROM o LEFT JOIN s ON o.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN r ON o.conv_id IS NOT DISTINCT FROM r.conv_id AND r.place = 1"""


_LINES_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d)),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, f.key IS NOT NULL AND doc_id <> last AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""


_NEGATIVES_SQL = """WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that it can express: the others need XXH64, kernels or merges."""
    return {"op7_url_filter": _URL_SQL, "op9_quality": _QUALITY_SQL, "op11_conversation_repair": _REPAIR_SQL, "op12_line_dedup": _LINES_SQL, "op13_hard_negatives": _NEGATIVES_SQL}
