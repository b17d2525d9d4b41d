"""Registered queries of decoding, clustering, language models and ranks, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.operators import ctc, embed, ngram_model, vbx
from voxloom.plans.derived import EVENTS_SQL, events, table
from voxloom.plans.registry import _SQL, _words, query
from voxloom.sources.shared import scratch
from voxloom.streaming import intervals as streams

_D = "::DOUBLE"
#: Tokens of the frames that are made of vectors: the blank, two letters and the gap between words.
TOKENS = ["-", "a", "b", " "]


def _frames(spark, sf_dir):
    """Four chunks of four frames of four scores of each vector."""
    rows = table(spark, sf_dir, "embeddings").filter("embedding is not null").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    scores = F.transform(F.slice("embedding", F.col("k") * 4 + 1, F.lit(4)), lambda x: x.cast("double") * 8)
    return rows.select((F.col("vec_id") * 4 + F.floor(F.col("k") / 4)).alias("chunk_id"), (F.col("k") % 4).alias("frame"), scores.alias("logits"))


_FRAMES = f"""k AS (SELECT vec_id, embedding, unnest(range(16)) AS k FROM embeddings),
x AS (SELECT vec_id * 4 + k // 4 AS chunk_id, k % 4 AS frame, list_transform(embedding[k * 4 + 1:k * 4 + 4], lambda v: v{_D} * 8) AS v FROM k),
lp AS (SELECT chunk_id, frame, list_transform(v, lambda y: y - list_max(v) - ln(list_sum(list_transform(v, lambda z: exp(z - list_max(v)))))) AS lp FROM x)"""


@query(f"""WITH {_FRAMES}, four AS (SELECT chunk_id, list(lp ORDER BY frame) AS lp FROM lp GROUP BY chunk_id),
n AS (SELECT unnest(range(256)) AS n), p AS (SELECT [n // 64, n // 16 % 4, n // 4 % 4, n % 4] AS p FROM n),
t AS (SELECT p, list_transform(list_filter(range(1, 5), lambda i: p[i] <> 0 AND (i = 1 OR p[i] <> p[i - 1])), lambda i: p[i]) AS tokens FROM p),
s AS (SELECT chunk_id, tokens, ln(sum(exp(lp[1][p[1] + 1] + lp[2][p[2] + 1] + lp[3][p[3] + 1] + lp[4][p[4] + 1]))) AS score FROM four, t GROUP BY chunk_id, tokens),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, tokens) - 1 AS rank FROM s)
SELECT chunk_id, rank::INT AS rank, trim(regexp_replace(array_to_string(list_transform(tokens, lambda c: [' ', 'a', 'b', ' '][c + 1]), ''), ' +', ' ', 'g'), ' ') AS text, round(score, 6) AS score
FROM r WHERE rank < 5""")
def ctc_nbest(spark, sf_dir):
    """The five likeliest readings of each chunk; four frames have 121 prefixes at most, so that the beams hold all of them."""
    return ctc.nbest(_frames(spark, sf_dir), TOKENS, width=128).select("chunk_id", "rank", "text", F.round("score", 6).alias("score"))


@query(f"WITH {_FRAMES}, u AS (SELECT chunk_id, frame, unnest(range(4)) AS i, lp FROM lp) SELECT chunk_id, frame::INT AS frame, ['-', 'a', 'b', ' '][i + 1] AS token, round(lp[i + 1], 6) AS logp FROM u WHERE lp[i + 1] >= -1.25")
def ctc_lattice(spark, sf_dir):
    """Tokens of each frame that are not too unlikely."""
    return ctc.lattice(_frames(spark, sf_dir), TOKENS, least=-1.25).withColumn("logp", F.round("logp", 6))


_UNIT = f"""un AS (SELECT label, vec_id, list_transform(embedding, lambda x: x{_D} / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings)"""


def _linkage_sql(threshold: float) -> str:
    pairs = "flatten(list_transform(range(1, len(c) + 1), lambda i: list_transform(range(i + 1, len(c) + 1), lambda j: {'d': 1 - list_inner_product(c[i].s, c[j].s) / (c[i].n * c[j].n), 'i': i, 'j': j})))"
    both = "{'m': list_concat(c[b.i].m, c[b.j].m), 's': list_transform(list_zip(c[b.i].s, c[b.j].s), lambda z: z[1] + z[2]), 'n': c[b.i].n + c[b.j].n}"
    return f"""WITH RECURSIVE {_UNIT}, r AS (SELECT label, list({{'m': [vec_id], 's': u, 'n': 1}} ORDER BY vec_id) AS c FROM un GROUP BY label
  UNION ALL SELECT label, list_transform(list_filter(range(1, len(c) + 1), lambda k: k <> b.j), lambda k: CASE WHEN k = b.i THEN {both} ELSE c[k] END)
  FROM (SELECT label, c, list_min({pairs}) AS b FROM r WHERE len(c) > 1) WHERE b.d <= {threshold}),
e AS (SELECT label, arg_min(c, len(c)) AS c FROM r GROUP BY label),
k AS (SELECT label, unnest(range(1, len(c) + 1)) AS i, c FROM e)
SELECT label, unnest(c[i].m) AS vec_id, (i - 1)::INT AS cluster FROM k"""


@query(_linkage_sql(0.9))
def ahc_clusters(spark, sf_dir):
    """Average-linkage clusters of each class."""
    return embed.cluster(table(spark, sf_dir, "embeddings"), "label", threshold=0.9)


@query(_linkage_sql(0.6))
def ahc_by_components(spark, sf_dir):
    """The same at a lower cut, by the components of near pairs, as groups are that are too large for a task."""
    return embed.cluster(table(spark, sf_dir, "embeddings"), "label", threshold=0.6, whole=0)


@query()
def vbx_speakers(spark, sf_dir):
    """Speakers of records of 40 vectors each, in the space of a model of the classes."""
    rows = table(spark, sf_dir, "embeddings").withColumn("record_id", F.floor(F.col("vec_id") / 40))
    found = vbx.cluster(rows, embed.Plda.fit(rows), config=vbx.VbxConfig(threshold=0.9))
    return found.select("record_id", "vec_id", "cluster", "rounds", F.round("bound", 3).alias("bound"))


_ORDER = 5


def _model_sql(order: int) -> str:
    """Tables p1 .. of a model of the benchmark's texts, strings as lists of words."""
    parts = [f"""w AS (SELECT list_concat(['<s>'], {_words('text')}, ['</s>']) AS w FROM benchmark),
c{order} AS (SELECT g, count(*) AS c FROM (SELECT w[i:i + {order - 1}] AS g FROM (SELECT w, unnest(range(1, len(w) - {order - 2})) AS i FROM w)) GROUP BY g)"""]
    for n in range(order - 1, 0, -1):
        opening = f" UNION ALL SELECT w[:{n}], count(*) FROM w WHERE len(w) >= {n} GROUP BY 1" if n > 1 else ""
        parts.append(f"c{n} AS (SELECT g[2:] AS g, count(*) AS c FROM c{n + 1} GROUP BY 1{opening})")
    for n in range(1, order + 1):
        parts.append(f"""k{n} AS (SELECT count(*) FILTER (c = 1){_D} AS a, count(*) FILTER (c = 2) AS b, count(*) FILTER (c = 3) AS d, count(*) FILTER (c = 4) AS e FROM c{n}),
y{n} AS (SELECT *, 1 - 2 * a / (a + 2 * b) * b / a AS x, 2 - 3 * a / (a + 2 * b) * d / b AS y, 3 - 4 * a / (a + 2 * b) * e / d AS z, a * b * d * e > 0 AS all_ FROM k{n}),
d{n} AS (SELECT CASE WHEN ok THEN [x, y, z] ELSE [0.5{_D}, 1.0{_D}, 1.5{_D}] END AS d FROM (SELECT *, coalesce(all_ AND x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 2 AND z BETWEEN 0 AND 3, false) AS ok FROM y{n})),
x{n} AS (SELECT g[:-2] AS h, sum(c) AS total, sum(d[least(c, 3)]) AS lost FROM c{n}, d{n} GROUP BY 1)""")
    parts.append(f"""u AS (SELECT lost / total / ((SELECT count(*) FROM c1) + 1) AS rest, total FROM x1),
p1 AS (SELECT g, (c - d[least(c, 3)]) / total + rest AS p FROM c1, d1, u UNION ALL SELECT ['<unk>'], rest FROM u UNION ALL SELECT ['<s>'], 0 FROM u)""")
    for n in range(2, order + 1):
        parts.append(f"p{n} AS (SELECT c.g, (c - d[least(c, 3)]) / total + lost / total * s.p AS p FROM c{n} c JOIN x{n} x ON x.h = c.g[:-2] JOIN p{n - 1} s ON s.g = c.g[2:], d{n})")
    rows = " UNION ALL ".join(
        f"SELECT {n} AS n, p{n}.g, p, " + (f"log10(lost / total) AS backoff FROM p{n} LEFT JOIN x{n + 1} x ON x.h = p{n}.g" if n < order else f"NULL::DOUBLE FROM p{n}") for n in range(1, order + 1)
    )
    parts.append(f"m AS (SELECT n, g, round(CASE WHEN p > 0 THEN log10(p) ELSE -99 END, 8) AS logp, round(backoff, 8) AS backoff FROM ({rows}))")
    return ",\n".join(parts)


@query(f"WITH {_model_sql(_ORDER)} SELECT n::INT AS n, array_to_string(g, ' ') AS gram, round(logp, 5) AS logp, round(backoff, 5) AS backoff FROM m")
def arpa_rows(spark, sf_dir):
    """A model of order 5 of the benchmark's texts, written as an ARPA file and read back."""
    path = scratch(spark, "arpa")
    ngram_model.write_arpa(ngram_model.train(table(spark, sf_dir, "benchmark"), _ORDER), path)
    return ngram_model.read_arpa(spark, path).select("n", "gram", F.round("logp", 5).alias("logp"), F.round("backoff", 5).alias("backoff"))


@query(f"""WITH {_model_sql(_ORDER)}, t AS (SELECT conv_id, turn, list_concat(['<s>'], {_words('text')}, ['</s>']) AS w FROM conversations WHERE text IS NOT NULL),
v AS (SELECT conv_id, turn, w[greatest(1, i - {_ORDER - 1}):i] AS v FROM (SELECT *, unnest(range(2, len(w) + 1)) AS i FROM t)),
q AS (SELECT DISTINCT v FROM v), e AS (SELECT v, unnest(range(1, len(v) + 1)) AS n FROM q),
l AS (SELECT v, max(e.n) AS n, arg_max(logp, e.n) AS logp FROM e JOIN m ON m.g = v[len(v) - e.n + 1:] GROUP BY v),
b AS (SELECT e.v, sum(backoff) AS b FROM e LEFT JOIN l ON l.v = e.v JOIN m ON e.n < len(e.v) AND e.n >= coalesce(l.n, 1) AND m.g = e.v[len(e.v) - e.n:len(e.v) - 1] GROUP BY e.v),
s AS (SELECT q.v, coalesce(l.logp, (SELECT logp FROM m WHERE g = ['<unk>'])) + coalesce(b.b, 0) AS lp, (l.v IS NULL)::INT AS lost FROM q LEFT JOIN l USING (v) LEFT JOIN b USING (v))
SELECT conv_id, turn, round(sum(lp), 4) AS lm, sum(lost)::BIGINT AS unknown FROM v JOIN s USING (v) GROUP BY conv_id, turn""")
def arpa_scores(spark, sf_dir):
    """Conversation turns scored by the model as the file has it."""
    path = scratch(spark, "arpa")
    ngram_model.write_arpa(ngram_model.train(table(spark, sf_dir, "benchmark"), _ORDER), path)
    turns = table(spark, sf_dir, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    found = ngram_model.score(ngram_model.read_arpa(spark, path), turns, "key")
    return found.select("key.conv_id", "key.turn", F.round("lm", 4).alias("lm"), "unknown")


@query(_SQL["ev_intervals_merge"])
def stream_merge(spark, sf_dir):
    """Events as they come, file by file, merged by a stream; a last row of each record, far in the future, closes it."""
    ev = events(spark, sf_dir).select("record_id", "speaker", "start_s", "end_s")
    last = ev.agg(F.max("end_s")).first()[0] or 0.0
    closing = ev.select("record_id").distinct().select("record_id", F.lit("").alias("speaker"), F.lit(last + 1e6).alias("start_s"), F.lit(last + 1e6 + 1).alias("end_s"))
    stream = streams.replay(spark, ev.unionByName(closing), "start_s", scratch(spark, "replay"), 4)
    out = streams.drained(streams.merge_gaps(stream, gap_s=3600.0), scratch(spark, "merged"), scratch(spark, "checkpoint"))
    return out.select("record_id", "speaker", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"))


@query(f"""WITH {EVENTS_SQL}, e AS (SELECT * FROM ev WHERE end_s - start_s <= 7200)
SELECT v.event_id, e.event_id AS r_event_id, round(least(v.end_s, e.end_s) - greatest(v.start_s, e.start_s), 3) AS overlap_s
FROM e v JOIN e ON v.speaker = 'view' AND e.speaker = 'error' AND v.record_id = e.record_id AND v.start_s < e.end_s AND e.start_s < v.end_s""")
def stream_overlaps(spark, sf_dir):
    """Views that come as a stream with the errors of another stream that they overlap, both of two hours at most."""
    ev = events(spark, sf_dir).select("record_id", "event_id", "speaker", "start_s", "end_s")
    side = lambda who: streams.replay(spark, ev.filter(F.col("speaker") == who).drop("speaker"), "start_s", scratch(spark, "replay"), 4)
    out = streams.drained(streams.overlaps(side("view"), side("error"), 7200.0, "30 days"), scratch(spark, "pairs"), scratch(spark, "checkpoint"))
    return out.select("event_id", "r_event_id", F.round("overlap_s", 3).alias("overlap_s"))
