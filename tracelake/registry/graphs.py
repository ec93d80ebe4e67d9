"""Entity graph of the log (f29, f30, r08, a20, j20, g24).

Entities are compared without case and come out in lower case, in the order in which they are found: marked names, names in
code marks, paths, dotted code names, the files of the event. A path has no blanks, and a dotted name inside a path is none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.operators import assembly as A
from tracelake.operators import hierarchy as H
from tracelake.plans.cut import cut
from tracelake.registry import query
from tracelake.registry.hierarchies import _WALKS
from tracelake.sources.tables import SQL_LOG, log, read

# The notations of entities, each with its name in the last column, and of relations between them.
MARKED, QUOTED = r"\[\[([^\]]+)\]\]", r"`([^`\n]{2,160})`"
PATH, CODE = r"(?:[A-Za-z]:[\\/])?[\p{L}\p{N}_.-]+(?:[\\/][\p{L}\p{N}_.-]+)+", r"(?:^|[^\p{L}\p{N}_./\\-])([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+)"
NOTATIONS = ((MARKED, 1), (QUOTED, 1), (PATH, 0), (CODE, 1))
_NAME = r"(?:\[\[([^\]]+)\]\]|`([^`]+)`)"
EXPLICIT = r"\[\[([^\]]+)\]\]\s*-\[([^\]]+)\]->\s*\[\[([^\]]+)\]\]"
NATURAL = rf"(?i){_NAME}\s+(uses|depends\s+on|requires|calls|implements|owns|blocks|supersedes|reads\s+from|writes\s+to)\s+{_NAME}"
#: So many entities of an event, as they are found, are taken to occur together.
TOGETHER = 12
#: How sure a relation is, and how many a name gives, the surest first.
SURE, NAMED, NEAR, FANOUT = 1.0, 0.9, 0.55, 200


def _clean(x: Column) -> Column:
    return F.substring(F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, r"^[\s`\[\]]+|[\s`\[\]]+$", ""), r"\s+", " "))), 1, 240)


def _sql_clean(x: str) -> str:
    return rf"substr(lower(trim(regexp_replace(regexp_replace({x}, '^[\s`\[\]]+|[\s`\[\]]+$', '', 'g'), '\s+', ' ', 'g'))), 1, 240)"


_SQL_FOUND = " || ".join(f"regexp_extract_all(content, '{p}', {g})" for p, g in NOTATIONS)
_SQL_ENTITIES = SQL_LOG + f""", en0 AS (SELECT id, seq, content, list_filter(list_transform(coalesce({_SQL_FOUND}, []) || coalesce(files, []), lambda x: {_sql_clean('x')}), lambda x: x <> '') AS a FROM log WHERE content IS NOT NULL OR len(files) > 0),
en AS (SELECT id, seq, content, list_filter(a, lambda x, i: list_position(a, x) = i) AS es FROM en0)"""
# every notation of a relation as (id, source, relation, target, confidence)
_SQL_RELATIONS = f"""{_SQL_ENTITIES}, ex AS (SELECT id, unnest(regexp_extract_all(content, '{EXPLICIT}', 0)) AS m FROM en), na AS (SELECT id, unnest(regexp_extract_all(content, '{NATURAL}', 0)) AS m FROM en),
said AS (SELECT id, {_sql_clean(f"regexp_extract(m, '{EXPLICIT}', 1)")} AS source, {_sql_clean(f"regexp_extract(m, '{EXPLICIT}', 2)")} AS relation, {_sql_clean(f"regexp_extract(m, '{EXPLICIT}', 3)")} AS target, {SURE} AS confidence FROM ex
  UNION ALL SELECT id, {_sql_clean(f"regexp_extract(m, '{NATURAL}', 1) || regexp_extract(m, '{NATURAL}', 2)")}, {_sql_clean(f"regexp_extract(m, '{NATURAL}', 3)")}, {_sql_clean(f"regexp_extract(m, '{NATURAL}', 4) || regexp_extract(m, '{NATURAL}', 5)")}, {NAMED} FROM na),
tied AS (SELECT id, source, replace(relation, ' ', '_') AS relation, target, confidence FROM said WHERE source <> '' AND relation <> '' AND target <> '' AND source <> target),
pl AS (SELECT id, unnest(es[1:{TOGETHER}]) AS e, generate_subscripts(es[1:{TOGETHER}], 1) AS n FROM en),
co AS (SELECT a.id, a.e AS source, b.e AS target FROM pl a JOIN pl b ON b.id = a.id AND a.n < b.n),
rel AS (SELECT id, source, relation, target, max(confidence) AS confidence FROM (SELECT * FROM tied UNION ALL SELECT co.id, co.source, 'co_occurs', co.target, {NEAR} FROM co WHERE NOT EXISTS (SELECT 1 FROM tied t WHERE t.id = co.id AND ((t.source = co.source AND t.target = co.target) OR (t.source = co.target AND t.target = co.source)))) GROUP BY 1, 2, 3, 4)"""


def entities(spark, d):
    """(id, seq, content, es): all entities of each event."""
    found = F.concat(*[F.coalesce(F.regexp_extract_all("content", F.lit(p), F.lit(g)), F.array()) for p, g in NOTATIONS], F.coalesce("files", F.array().cast("array<string>")))
    names = F.array_distinct(F.filter(F.transform(found, _clean), lambda x: x != ""))
    return log(spark, d, "content is not null or size(files) > 0").select("id", "seq", "content", names.alias("es"))


def relations(spark, d):
    """(id, source, relation, target, confidence): what each event says of its entities, and which of the first occur together.

    Pairs of one event are built inside its row, at most 66; whatever is said of two entities, they do not only occur together.
    """
    rows = entities(spark, d)

    def said(pattern: str, source: Column, relation: Column, target: Column, confidence: float):
        found = rows.select("id", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("m"))
        return found.select("id", _clean(source).alias("source"), F.replace(_clean(relation), F.lit(" "), F.lit("_")).alias("relation"), _clean(target).alias("target"), F.lit(confidence).alias("confidence"))

    part = lambda pattern, *n: F.concat(*[F.regexp_extract("m", pattern, k) for k in n])
    tied = said(EXPLICIT, part(EXPLICIT, 1), part(EXPLICIT, 2), part(EXPLICIT, 3), SURE).unionByName(said(NATURAL, part(NATURAL, 1, 2), part(NATURAL, 3), part(NATURAL, 4, 5), NAMED))
    tied = tied.where("source <> '' and relation <> '' and target <> '' and source <> target")
    first = rows.select("id", F.slice("es", 1, TOGETHER).alias("es")).where(F.size("es") > 1).select("id", "es", F.posexplode("es").alias("n", "source"))
    near = first.select("id", "source", F.explode(F.slice("es", F.col("n") + 2, TOGETHER)).alias("target"))
    known = tied.select("id", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    near = near.withColumn("a", F.least("source", "target")).withColumn("b", F.greatest("source", "target")).join(known, ["id", "a", "b"], "left_anti")
    near = near.select("id", "source", F.lit("co_occurs").alias("relation"), "target", F.lit(NEAR).alias("confidence"))
    return tied.unionByName(near).groupBy("id", "source", "relation", "target").agg(F.max("confidence").alias("confidence"))


@query("f29_entities", f"WITH {_SQL_ENTITIES} SELECT id, unnest(es) AS entity FROM en")
def f29(spark, d):
    return entities(spark, d).select("id", F.explode("es").alias("entity"))


@query("f30_relations", f"WITH {_SQL_RELATIONS} SELECT source, relation, target, count(*) AS n, max(confidence) AS confidence FROM rel GROUP BY 1, 2, 3")
def f30(spark, d):
    return relations(spark, d).groupBy("source", "relation", "target").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"))


_SQL_TOP = "both_ AS (SELECT id, source AS e, target AS o, confidence FROM rel UNION ALL SELECT id, target, source, confidence FROM rel), top AS (SELECT e FROM both_ GROUP BY 1 ORDER BY count(*) DESC, e LIMIT 3)"


def _both(pairs):
    return pairs.select("id", F.col("source").alias("e"), F.col("target").alias("o"), "confidence").unionByName(pairs.select("id", F.col("target").alias("e"), F.col("source").alias("o"), "confidence"))


def _asked(both):
    """The three entities with the most relations, as a query."""
    return both.groupBy("e").count().orderBy(F.desc("count"), "e").limit(3).select("e")


@query("r08_neighbours", f"WITH {_SQL_RELATIONS}, {_SQL_TOP} SELECT e, o AS neighbour, count(*) AS n, max(confidence) AS confidence FROM both_ WHERE e IN (SELECT e FROM top) GROUP BY 1, 2")
def r08(spark, d):
    """Neighbours of the entities with the most relations: a union of two equality lookups instead of an OR join."""
    both = cut(_both(relations(spark, d)))
    return both.join(F.broadcast(_asked(both)), "e", "left_semi").groupBy("e", F.col("o").alias("neighbour")).agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"))


@query("a20_graph_scores", f"WITH {_SQL_RELATIONS}, {_SQL_TOP}, hit AS (SELECT id, e, max(confidence) AS confidence FROM both_ WHERE e IN (SELECT e FROM top) GROUP BY 1, 2), cut AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY confidence DESC, id) AS nth FROM hit) SELECT id, count(*) AS keys_, max(confidence) AS confidence, round(tanh(0.5 * count(*)) + max(confidence), 6) AS score FROM cut WHERE nth <= {FANOUT} GROUP BY 1")
def a20(spark, d):
    """Events by the asked entities that they relate, each entity giving its two hundred surest events."""
    both = cut(_both(relations(spark, d)))
    hits = both.join(F.broadcast(_asked(both)), "e", "left_semi").groupBy("id", "e").agg(F.max("confidence").alias("confidence"))
    near = A.first_of_each(hits, ["e"], [F.desc("confidence")], F.lit(FANOUT))
    keys = F.count(F.lit(1))
    return near.groupBy("id").agg(keys.alias("keys_"), F.max("confidence").alias("confidence"), F.round(F.tanh(0.5 * keys) + F.max("confidence"), 6).alias("score"))


@query("g24_impact", _WALKS + " SELECT w.anc AS node, count(*) AS affected FROM walk w JOIN ends e ON e.node = w.node WHERE NOT e.missing AND w.depth BETWEEN 1 AND 3 GROUP BY 1")
def g24(spark, d):
    """How many branches lie within three steps below each branch."""
    tree = H.hierarchy(read(spark, d, "branches")).where("kind = 'tree'")
    return H.descendants(tree).where("distance <= 3").groupBy(F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("affected"))


#: Steps of the reverse walk.
REACH = 2


@query("g24_reverse_reach", f"WITH RECURSIVE {_SQL_RELATIONS}, {_SQL_TOP}, e AS (SELECT DISTINCT source, target FROM rel), w(node, depth) AS (SELECT e, 0 FROM top UNION SELECT e.source, w.depth + 1 FROM w JOIN e ON e.target = w.node WHERE w.depth < {REACH}) SELECT node, min(depth) AS depth FROM w GROUP BY 1")
def g24_reach(spark, d):
    """Every entity that leads to an asked one within two relations, at its least distance: each step goes on only from what it finds first."""
    pairs = cut(relations(spark, d).select("id", "source", "target", "confidence"))
    links = pairs.select("source", "target").distinct()
    found = cut(_asked(_both(pairs)).select(F.col("e").alias("node"), F.lit(0).alias("depth")))
    front = found
    for step in range(1, REACH + 1):
        front = links.join(front.select(F.col("node").alias("target")), "target", "left_semi").select(F.col("source").alias("node")).distinct().join(found.select("node"), "node", "left_anti").withColumn("depth", F.lit(step))
        found = cut(found.unionByName(front), replaces=found)
        front = found.where(F.col("depth") == step)
    return found
