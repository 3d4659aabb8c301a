"""Queries that search: related chains, similar words, shapes and states, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import graphs, networks, relational, seqsearch, shapes
from strandline.plans.tables import hits, points, table
from strandline.sources.scratch import computed_once

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


_HITS = """hits AS (SELECT a.l_partkey AS query, b.l_partkey AS target, b.l_tax / 40 AS evalue, a.l_quantity * 2 AS pident, b.l_quantity::INTEGER AS alnlen, 1 - a.l_discount AS qcov, 1 - b.l_tax AS tcov
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND abs(a.l_linenumber - b.l_linenumber) <= 1)"""


@query(
    "related_chains",
    f"""WITH RECURSIVE {_HITS},
k AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size DESC, md5('0:' || p_partkey::VARCHAR), p_partkey) AS place FROM part),
e AS (SELECT DISTINCT a.place AS a, b.place AS b FROM hits h JOIN k a ON a.id = h.query JOIN k b ON b.id = h.target WHERE a.place <> b.place AND evalue < 1e-3 AND pident >= 30 AND alnlen >= 20 AND qcov >= 0.9 AND tcov >= 0.9),
before AS (SELECT k.place, list(e.o) AS near FROM k LEFT JOIN (SELECT a AS place, b AS o FROM e WHERE b < a UNION SELECT b, a FROM e WHERE a < b) e ON e.place = k.place GROUP BY k.place),
walk(place, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT b.place, CASE WHEN list_has_any(near, kept) THEN kept ELSE list_append(kept, b.place) END FROM walk JOIN before b ON b.place = walk.place + 1),
final AS (SELECT kept FROM walk ORDER BY place DESC LIMIT 1),
first AS (SELECT b.place, min(o) AS lo FROM (SELECT place, unnest(near) AS o FROM before) b, final WHERE list_contains(final.kept, o) GROUP BY b.place)
SELECT k.id AS p_partkey, first.place IS NULL AS kept, p.id AS partner FROM k LEFT JOIN first ON first.place = k.place LEFT JOIN k p ON p.place = first.lo""",
)
def related_chains(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_size")
    found = hits(spark, d)
    return graphs.independent(parts, found.filter(relational.homology()), "p_partkey", [F.desc("p_size")])


_LETTERS = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"
_GRID = ", ".join(f"('{a}', '{b}', {s})" for a, row in zip(seqsearch.RESIDUES, seqsearch.SCORES.strip().split("\n"), strict=True) for b, s in zip(seqsearch.RESIDUES, row.split(), strict=True))


def _similar_words_sql(k: int, threshold: int) -> str:
    """Relations w (word), n (word, x): words of the queries and those that score the threshold, letter by letter; what cannot reach it any more is left out."""
    rest = lambda i: " + ".join(["0", *(f"(SELECT max(score) FROM m WHERE a = substr(w, {j}, 1))" for j in range(i, k + 1))])
    out = [f"n0 AS (SELECT word AS w, '' AS x, 0 AS s FROM w WHERE regexp_full_match(word, '[{seqsearch.RESIDUES}]+'))"]
    for i in range(1, k + 1):
        out.append(f"n{i} AS (SELECT w, x || m.b AS x, s + m.score AS s FROM n{i - 1} JOIN m ON m.a = substr(w, {i}, 1) WHERE s + m.score + {rest(i + 1)} >= {threshold})")
    return ",\n".join(out) + f",\nn AS (SELECT w AS word, x FROM n{k} UNION SELECT word, word FROM w)"


@query(
    "diagonal_hits",
    f"""WITH m AS (SELECT * FROM (VALUES {_GRID}) t(a, b, score)),
q AS (SELECT item_id AS id, {_LETTERS} AS seq FROM benchmark), t AS (SELECT doc_id AS id, {_LETTERS} AS seq FROM documents),
qp AS (SELECT id, i::INT AS place, substr(seq, i + 1, 5) AS word FROM q, unnest(range(0, length(seq) - 4)) r(i)),
tp AS (SELECT id, i::INT AS pos, substr(seq, i + 1, 5) AS word FROM t, unnest(range(0, length(seq) - 4)) r(i)),
w AS (SELECT DISTINCT word FROM qp),
{_similar_words_sql(5, 20)},
h AS (SELECT qp.id AS query, tp.id AS target, pos - place AS diagonal, place FROM qp JOIN n ON n.word = qp.word JOIN tp ON tp.word = n.x),
two AS (SELECT *, count(*) OVER (PARTITION BY query, target, diagonal ORDER BY place RANGE BETWEEN 40 PRECEDING AND 5 PRECEDING) AS before FROM h)
SELECT query, target, diagonal, count(*) AS hits FROM two WHERE before > 0 GROUP BY ALL""",
)
def diagonal_hits(spark, d):
    q, t = _sequences(spark, d)
    return seqsearch.diagonal_hits(q, t, 5, 20, 40)


def _sequences(spark, d):
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), letters.alias("seq")), table(spark, d, "documents").select(F.col("doc_id").alias("id"), letters.alias("seq"))


@query("sensitive_search")
def sensitive_search(spark, d):
    q, _ = _sequences(spark, d)
    return seqsearch.sensitive_search(q, q)


#: Vectors have unit length; their values times this are distances of a chain's size.
SCALE = 20.0
_PTS = """pts AS (SELECT label AS chain, vec_id AS model, (r + 1)::BIGINT AS seq, embedding[3*r+1]::DOUBLE AS x, embedding[3*r+2]::DOUBLE AS y, embedding[3*r+3]::DOUBLE AS z
  FROM embeddings, range(21) t(r))"""


def _chains(spark, d):
    values = F.transform(F.slice("embedding", 1, 63), lambda v: v.cast("double") * SCALE)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.repeat(F.lit("A"), F.lit(21)).alias("seq"), values.alias("xyz"))


def _shape_sql() -> str:
    at = lambda k: f"[x[3 * (pos + {k}) + 1], x[3 * (pos + {k}) + 2], x[3 * (pos + {k}) + 3]]"
    d = ", ".join(f"list_distance({at(-a)}, {at(b)}) AS d{n}" for n, (a, b) in enumerate(shapes.REACH))
    word = " || '.' || ".join(["kind", *(f"c{n}" for n in range(len(shapes.REACH)))])
    soft = "\n".join(f", unnest([floor((d{n} - {shapes.MARGIN}::DOUBLE) / {shapes.WIDTH}::DOUBLE)::INT, floor((d{n} + {shapes.MARGIN}::DOUBLE) / {shapes.WIDTH}::DOUBLE)::INT]) u{n}(c{n})" for n in range(len(shapes.REACH)))
    hard = ", ".join(f"floor(d{n} / {shapes.WIDTH}::DOUBLE)::INT AS c{n}" for n in range(len(shapes.REACH)))
    return f"""WITH e AS (SELECT vec_id AS id, list_transform(embedding[1:63], lambda v: v::DOUBLE * {SCALE}::DOUBLE) AS x FROM embeddings),
g AS (SELECT id, pos, list_distance({at(-2)}, {at(2)}) AS k, {d} FROM e, range(3, 17) r(pos)),
h AS (SELECT *, CASE WHEN abs(k - 6.37::DOUBLE) < 1.05 THEN '1' WHEN abs(k - 13.0::DOUBLE) < 1.42 THEN '2' WHEN k < 8.0 THEN '3' ELSE '0' END AS kind FROM g),
q AS (SELECT DISTINCT id, pos, {word} AS word FROM h {soft} WHERE id % 50 = 0),
t AS (SELECT DISTINCT id, {word} AS word FROM (SELECT id, kind, {hard} FROM h)),
s AS (SELECT q.id AS query, t.id AS target, count(DISTINCT pos) AS shared FROM q JOIN t ON q.word = t.word WHERE q.id <> t.id GROUP BY ALL)
SELECT query, target, shared, 14::BIGINT AS places FROM s WHERE shared >= 0.5::DOUBLE * 14"""


@query("shape_hits", _shape_sql())
def shape_hits(spark, d):
    chains = _chains(spark, d)
    return shapes.shape_hits(chains.filter("id % 50 = 0"), chains)


@query("indexed_search")
def indexed_search(spark, d):
    chains = _chains(spark, d)
    named = lambda df: df.withColumn("id", F.col("id").cast("string"))
    found = shapes.indexed_search(named(chains.filter("id % 50 = 0")), named(chains))
    return found.select(F.col("query").cast("long").alias("query"), F.col("target").cast("long").alias("target"), F.round("tm1", 4).alias("tm1"), F.round("tm2", 4).alias("tm2"), "n_ali")


@query(
    "nearest_residues",
    f"""WITH {_PTS}, p AS (SELECT a.chain, a.model, a.seq AS i, b.seq AS j, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d
  FROM pts a JOIN pts b ON a.chain = b.chain AND a.model = b.model AND abs(a.seq - b.seq) >= 3)
SELECT chain, model, i, j, round(d, 5) AS d FROM p QUALIFY row_number() OVER (PARTITION BY chain, model, i ORDER BY d, j) = 1""",
)
def nearest_residues(spark, d):
    return shapes.nearest_residues(points(spark, d), ["chain", "model"], 0.3).select("chain", "model", "i", "j", F.round("d", 5).alias("d"))


@query("learned_states")
def learned_states(spark, d):
    found = computed_once(shapes.pair_features(points(spark, d), ["chain", "model"], 0.3))
    return shapes.encode_states(found, ["chain", "model"], shapes.learn_states(found, held=True))


@query("network_by_solves")
def network_by_solves(spark, d):
    return networks.large_fluctuations(points(spark, d), 0.2)
