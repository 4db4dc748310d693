"""Graph queries over ``nodes`` and ``edges``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velumine.operators import code
from velumine.operators.graph import Graph
from velumine.plans.registry import query
from velumine.session import Workspace
from velumine.sources.tables import load

_G = r"""n0 AS (SELECT nullif(trim(id, E' \t\n\r'), '') AS id, trim(name) AS name, lower(trim(type)) AS type, file_path, start_line, created_at FROM nodes),
n AS (SELECT id, min_by(row(name, type, file_path, start_line), row(created_at, name)) AS b FROM n0 GROUP BY id),
nn AS (SELECT id, b[1] AS name, b[2] AS type, b[3] AS file_path, b[4] AS start_line FROM n),
e AS (SELECT nullif(trim(source_id, E' \t\n\r'), '') AS source_id, nullif(trim(target_id, E' \t\n\r'), '') AS target_id, lower(trim(type)) AS type, min(confidence) AS confidence, max(weight) AS weight
  FROM edges WHERE nullif(trim(source_id, E' \t\n\r'), '') IS NOT NULL AND nullif(trim(target_id, E' \t\n\r'), '') IS NOT NULL GROUP BY 1, 2, 3)"""
_START = "s AS (SELECT id FROM nn WHERE file_path LIKE 'lib/core/%')"


#: The tables name inheritance ``inherits``.
INHERITS = ("inherits", "extends")


def _graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(load(spark, sf_dir, "nodes"), load(spark, sf_dir, "edges"))


def _start(g: Graph) -> DataFrame:
    return g.nodes.filter(F.col("file_path").like("lib/core/%")).select("id")


def _walk_sql(types: str, a: str, b: str, depth: int, start: str = _START) -> str:
    cond = f"AND e.type IN ({types})" if types else ""
    return f"""WITH RECURSIVE {_G}, {start}, w AS (SELECT id AS start_id, id, 0 AS depth, id AS path FROM s
UNION ALL SELECT w.start_id, e.{b}, w.depth + 1, w.path || ' → ' || e.{b} FROM w JOIN e ON e.{a} = w.id {cond} WHERE w.depth < {depth}) SELECT start_id, id, depth, path FROM w WHERE depth > 0"""


@query("graph_callers", _walk_sql("'calls'", "target_id", "source_id", 2))
def graph_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    return g.callers(_start(g), 2)


_CALLERS_OF = "s AS (SELECT DISTINCT source_id AS id FROM e WHERE type = 'calls' AND target_id = 'lib/core/journal.ex:record:12')"


@query("graph_callees", _walk_sql("'calls'", "source_id", "target_id", 2, _CALLERS_OF))
def graph_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    start = g.edges.filter("type = 'calls' and target_id = 'lib/core/journal.ex:record:12'").select(F.col("source_id").alias("id")).distinct()
    return g.callees(start, 2)


_CLASSES = "s AS (SELECT id FROM nn WHERE type = 'class')"


@query("graph_ancestors", _walk_sql("'inherits', 'extends'", "source_id", "target_id", 4, _CLASSES))
def graph_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    return g.ancestors(g.nodes.filter("type = 'class'").select("id"), 4, INHERITS)


@query("graph_descendants", _walk_sql("'inherits', 'extends'", "target_id", "source_id", 4, _CLASSES))
def graph_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    return g.descendants(g.nodes.filter("type = 'class'").select("id"), 4, INHERITS)


@query("graph_importers", _walk_sql("'imports'", "target_id", "source_id", 1, "s AS (SELECT id FROM nn WHERE type = 'module')"))
def graph_importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    return g.one_hop(g.nodes.filter("type = 'module'").select("id"), "imports", forward=False)


@query("graph_implementations", _walk_sql("'inherits'", "target_id", "source_id", 1, _CLASSES))
def graph_implementations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    return g.one_hop(g.nodes.filter("type = 'class'").select("id"), "inherits", forward=False)


@query("graph_dependents", f"""WITH RECURSIVE {_G}, {_START}, w AS (SELECT id, 0 AS depth FROM s UNION SELECT e.source_id, w.depth + 1 FROM w JOIN e ON e.target_id = w.id WHERE w.depth < 3)
SELECT id, min(depth) AS depth FROM w GROUP BY id HAVING min(depth) > 0""")
def graph_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    return g.dependents(_start(g), Workspace(spark, "dep"), 3)


_NEAR = f"""b AS (SELECT source_id AS a, target_id AS z FROM e UNION SELECT target_id, source_id FROM e),
w AS (SELECT id, 0 AS depth FROM s UNION SELECT b.z, w.depth + 1 FROM w JOIN b ON b.a = w.id WHERE w.depth < 1), r AS (SELECT id, min(depth) AS depth FROM w GROUP BY id)"""


@query("graph_neighborhood", f"WITH RECURSIVE {_G}, {_START}, {_NEAR} SELECT id, depth FROM r")
def graph_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    return g.neighborhood(_start(g), 1, Workspace(spark, "near"))[0]


@query("graph_induced", f"WITH RECURSIVE {_G}, {_START}, {_NEAR} SELECT source_id, target_id, type FROM e WHERE source_id IN (SELECT id FROM r) AND target_id IN (SELECT id FROM r)")
def graph_induced(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    return g.neighborhood(_start(g), 1, Workspace(spark, "near"))[1].select("source_id", "target_id", "type")


@query("graph_god", f"""WITH {_G}, d AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM e UNION ALL SELECT target_id FROM e) GROUP BY 1)
SELECT nn.id, name, type, coalesce(degree, 0) AS degree FROM nn LEFT JOIN d USING (id) WHERE type IN ('function', 'method', 'module', 'class') ORDER BY degree DESC, id LIMIT 10""")
def graph_god(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).god_nodes()


@query("graph_bridge", f"""WITH {_G} SELECT e.source_id AS id, count(DISTINCT t.file_path) AS files FROM e JOIN nn s ON s.id = e.source_id JOIN nn t ON t.id = e.target_id
WHERE e.type = 'calls' AND s.file_path <> t.file_path GROUP BY 1 HAVING count(DISTINCT t.file_path) >= 2 ORDER BY files DESC, id LIMIT 10""")
def graph_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).bridge_nodes()


_COMM = "c AS (SELECT id, CASE WHEN instr(file_path, '/') > 1 THEN left(file_path, instr(file_path, '/') - 1) ELSE '' END AS k FROM nn)"


@query("graph_communities", f"""WITH {_G}, {_COMM}, o AS (SELECT source_id AS id, count(*) AS o FROM e GROUP BY 1), i AS (SELECT target_id AS id, count(*) AS i FROM e GROUP BY 1),
m AS (SELECT a.k, count(*) AS n FROM e JOIN c a ON a.id = e.source_id JOIN c b ON b.id = e.target_id WHERE a.k = b.k GROUP BY 1)
SELECT c.k AS community, count(*) AS nodes, sum(coalesce(o, 0) + coalesce(i, 0))::BIGINT AS degree, coalesce(any_value(m.n), 0) AS internal_edges, round(coalesce(any_value(m.n), 0) / greatest(sum(coalesce(o, 0)), 1), 3) AS cohesion
FROM c LEFT JOIN o USING (id) LEFT JOIN i USING (id) LEFT JOIN m ON m.k = c.k WHERE c.k <> '' GROUP BY c.k HAVING count(*) >= 3""")
def graph_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).communities()


@query("graph_surprising", f"""WITH {_G}, {_COMM} SELECT source_id, target_id, e.type, CASE confidence WHEN 'AMBIGUOUS' THEN 'ambiguous' WHEN 'INFERRED' THEN 'inferred' ELSE 'crosses communities' END AS reason
FROM e JOIN c a ON a.id = source_id JOIN c b ON b.id = target_id WHERE confidence IN ('INFERRED', 'AMBIGUOUS') OR (a.k <> b.k AND a.k <> '' AND b.k <> '')
ORDER BY CASE confidence WHEN 'AMBIGUOUS' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END, source_id, target_id, e.type LIMIT 10""")
def graph_surprising(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).surprising()


@query("graph_counts", f"WITH {_G} SELECT type, count(*) AS n, 'node' AS kind FROM nn GROUP BY 1 UNION ALL SELECT type, count(*), 'edge' FROM e GROUP BY 1")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).counts()


@query("graph_questions")
def graph_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).report()["questions"]


def _pagerank_sql(rounds: int) -> str:
    steps = [f"r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM nn) AS p FROM nn)"]
    for i in range(rounds):
        steps.append(
            f"r{i + 1} AS (SELECT nn.id, 0.15 / (SELECT count(*) FROM nn) + 0.85 * (coalesce(g.s, 0) + (SELECT coalesce(sum(p), 0) FROM r{i} WHERE id NOT IN (SELECT source_id FROM o)) / (SELECT count(*) FROM nn)) AS p FROM nn "
            f"LEFT JOIN (SELECT l.target_id AS id, sum(l.w / o.t * r.p) AS s FROM l JOIN o USING (source_id) JOIN r{i} r ON r.id = l.source_id GROUP BY 1) g USING (id))"
        )
    return f"""WITH {_G}, l AS MATERIALIZED (SELECT source_id, target_id, count(*)::DOUBLE AS w FROM e WHERE source_id IN (SELECT id FROM nn) AND target_id IN (SELECT id FROM nn) GROUP BY 1, 2),
o AS MATERIALIZED (SELECT source_id, sum(w) AS t FROM l GROUP BY 1), {', '.join(steps)} SELECT id, round(p, 9) AS pagerank FROM r{rounds}""".replace("AS (SELECT nn.id, 0.15", "AS MATERIALIZED (SELECT nn.id, 0.15")


@query("pagerank", _pagerank_sql(10))
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).pagerank(Workspace(spark, "pagerank")).select("id", F.round("pagerank", 9).alias("pagerank"))


@query("graph_external", f"""WITH {_G}, x AS (SELECT DISTINCT 'external:' || type || ':' || name AS external_id, name FROM nn WHERE type = 'function' AND name IS NOT NULL)
SELECT external_id, max(nn.id) AS id FROM x JOIN nn ON nn.name = string_split(external_id, ':')[-1] GROUP BY 1""")
def graph_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    x = g.nodes.filter("type = 'function' and name is not null").select(F.concat(F.lit("external:"), "type", F.lit(":"), "name").alias("external_id")).distinct()
    return g.resolve_external(x)


# Symbols from source text

_LINES = r"""x AS (SELECT id AS unit, string_split(replace(replace(source_text, E'\r\n', E'\n'), E'\r', E'\n'), E'\n') AS t FROM (SELECT DISTINCT id, source_text, language FROM nodes) WHERE lower(trim(language)) = '{lang}' AND source_text IS NOT NULL),
ln AS (SELECT unit, unnest(t) AS s, generate_subscripts(t, 1) AS line FROM x), k AS (SELECT * FROM ln WHERE NOT regexp_matches(s, '^\s*#'))"""


def _symbol_sql(lang: str) -> str:
    parts = []
    for kind, pattern in code.PATTERNS[lang].items():
        name = f"regexp_extract(s, '{pattern}', 1)"
        if kind == "import" and lang == "python":
            name = f"coalesce(nullif({name}, ''), regexp_extract(s, '{pattern}', 2))"
        parts.append(f"SELECT unit, '{kind}' AS kind, {name} AS name, line::INT AS line FROM k WHERE {name} <> ''")
    return f"WITH {_LINES.replace('{lang}', lang)} " + " UNION ALL ".join(parts)


def _once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nodes").select("id", "source_text", "language").distinct()


@query("code_symbols_elixir", _symbol_sql("elixir"))
def code_symbols_elixir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.symbols(_once(spark, sf_dir), "elixir")


@query("code_symbols_python", _symbol_sql("python"))
def code_symbols_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.symbols(_once(spark, sf_dir), "python")


@query("code_contains", f"""WITH d AS ({_symbol_sql("python")}), w AS (SELECT *, last_value(CASE WHEN kind = 'class' THEN name END IGNORE NULLS) OVER (PARTITION BY unit ORDER BY line ROWS UNBOUNDED PRECEDING) AS parent FROM d)
SELECT unit, parent, name AS child, line FROM w WHERE kind = 'function' AND parent IS NOT NULL""")
def code_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.contains(_once(spark, sf_dir), "python")


@query("code_calls", f"""WITH {_LINES.replace('{lang}', 'elixir')}, q AS (SELECT *, regexp_extract(s, '{code.PATTERNS["elixir"]["function"]}', 1) AS f FROM k),
w AS (SELECT *, last_value(nullif(f, '') IGNORE NULLS) OVER (PARTITION BY unit ORDER BY line ROWS UNBOUNDED PRECEDING) AS caller FROM q),
u AS (SELECT unit, caller, line, unnest(regexp_extract_all(s, '([a-z_]\\w*[?!]?)\\(', 1)) AS callee FROM w WHERE f = ''),
t AS (SELECT trim(name) AS callee, max(trim(id)) AS t FROM nodes WHERE lower(trim(type)) IN ('function', 'method') GROUP BY 1)
SELECT DISTINCT unit, caller, callee, coalesce(t, 'external:' || callee) AS target_id, CASE WHEN t IS NULL THEN 'INFERRED' ELSE 'EXTRACTED' END AS confidence
FROM u LEFT JOIN t USING (callee) WHERE caller IS NOT NULL AND callee NOT IN ({', '.join(repr(r) for r in code._RESERVED)})""")
def code_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = code.calls(_once(spark, sf_dir), "elixir")
    return code.resolve(found, load(spark, sf_dir, "nodes")).distinct()
