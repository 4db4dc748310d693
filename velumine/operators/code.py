"""Symbols and edges from source text by line patterns, for languages without a parser at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Line patterns of definitions, imports and calls by language; the first group is the name.
PATTERNS = {
    "elixir": {
        "module": r"^\s*defmodule\s+([A-Z][\w.]*)",
        "function": r"^\s*(?:def|defp|defmacro|defmacrop|defdelegate|defcallback)\s+([a-z_]\w*[?!]?)",
        "import": r"^\s*(?:alias|import|use|require)\s+([A-Z][\w.]*)",
    },
    "python": {
        "class": r"^\s*class\s+([A-Za-z_]\w*)",
        "function": r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)",
        "import": r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))",
    },
}
_CALL = r"([a-z_]\w*[?!]?)\("
_QUALIFIED = r"([A-Z][A-Za-z0-9_.]*\.[a-z_][A-Za-z0-9_?!]*)\("
_MENTION = r"(?<![\w.:@\"'])([A-Z]\w*(?:\.[A-Z]\w*)*)"
_RESERVED = ("if", "unless", "case", "cond", "for", "while", "fn", "def", "defp", "return", "not", "and", "or", "in", "with", "raise", "print")


def _lines(df: DataFrame, id_col: str, source: str, language: str, lang_col: str) -> DataFrame:
    rows = df.filter(F.lower(F.btrim(lang_col)) == language).filter(F.col(source).isNotNull())
    text = F.regexp_replace(F.col(source), r"\r\n?", "\n")
    out = rows.select(F.col(id_col).alias("unit"), F.posexplode(F.split(text, "\n")).alias("line", "_text"))
    return out.withColumn("line", F.col("line") + 1).filter(~F.col("_text").rlike(r"^\s*#"))


def symbols(df: DataFrame, language: str, id_col: str = "id", source: str = "source_text", lang_col: str = "language") -> DataFrame:
    """(unit, kind, name, line) of the definitions and imports in each text."""
    found = []
    for kind, pattern in PATTERNS[language].items():
        name = F.regexp_extract("_text", pattern, 1)
        if kind == "import" and language == "python":
            name = F.coalesce(F.nullif(name, F.lit("")), F.regexp_extract("_text", pattern, 2))
        found.append(F.struct(F.lit(kind).alias("kind"), name.alias("name")))
    rows = _lines(df, id_col, source, language, lang_col).select("unit", "line", F.explode(F.array(*found)).alias("_s"))
    return rows.filter("_s.name <> ''").select("unit", "_s.kind", "_s.name", "line")


def contains(df: DataFrame, language: str, **options) -> DataFrame:
    """(unit, parent, child, line): each function under the last module or class before it in its text."""
    s = symbols(df, language, **options)
    w = Window.partitionBy("unit").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    outer = F.last(F.when(F.col("kind").isin("module", "class"), F.col("name")), ignorenulls=True).over(w)
    return s.withColumn("parent", outer).filter("kind = 'function' and parent is not null").select("unit", "parent", F.col("name").alias("child"), "line")


def calls(df: DataFrame, language: str, id_col: str = "id", source: str = "source_text", lang_col: str = "language") -> DataFrame:
    """(unit, caller, callee, line): calls in each text with the function they stand in."""
    lines = _lines(df, id_col, source, language, lang_col)
    name = F.regexp_extract("_text", PATTERNS[language]["function"], 1)
    w = Window.partitionBy("unit").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("_def", name).withColumn("caller", F.last(F.nullif(name, F.lit("")), ignorenulls=True).over(w))
    found = placed.filter("_def = ''").select("unit", "line", "caller", F.explode(F.regexp_extract_all("_text", F.lit(_CALL), F.lit(1))).alias("callee"))
    return found.filter(F.col("caller").isNotNull() & ~F.col("callee").isin(*_RESERVED)).select("unit", "caller", "callee", "line").distinct()


def qualified_calls(df: DataFrame, language: str, id_col: str = "id", source: str = "source_text", lang_col: str = "language") -> DataFrame:
    """(unit, module, function, line): calls by a qualified name."""
    found = _lines(df, id_col, source, language, lang_col).select("unit", "line", F.explode(F.regexp_extract_all("_text", F.lit(_QUALIFIED), F.lit(1))).alias("_q"))
    return found.select("unit", F.regexp_replace("_q", r"\.[^.]*$", "").alias("module"), F.regexp_extract("_q", r"\.([^.]*)$", 1).alias("function"), "line").distinct()


def imports(df: DataFrame, language: str, **options) -> DataFrame:
    """(source_id, target_id, type, confidence): each text imports the modules its lines name."""
    s = symbols(df, language, **options).filter("kind = 'import'")
    return s.select(F.col("unit").alias("source_id"), F.concat(F.lit("module:"), "name").alias("target_id"), F.lit("imports").alias("type"), F.lit("EXTRACTED").alias("confidence")).distinct()


def references(df: DataFrame, language: str, id_col: str = "id", source: str = "source_text", lang_col: str = "language") -> DataFrame:
    """(source_id, target_id, type, confidence): names with a capital that a text mentions outside definitions and imports."""
    lines = _lines(df, id_col, source, language, lang_col)
    for kind in ("module", "class", "import"):
        if kind in PATTERNS[language]:
            lines = lines.filter(~F.col("_text").rlike(PATTERNS[language][kind]))
    found = lines.select("unit", F.explode(F.regexp_extract_all("_text", F.lit(_MENTION), F.lit(1))).alias("name")).distinct()
    return found.select(F.col("unit").alias("source_id"), F.concat(F.lit("module:"), "name").alias("target_id"), F.lit("references").alias("type"), F.lit("INFERRED").alias("confidence"))


def relationships(df: DataFrame, language: str, nodes: DataFrame, **options) -> DataFrame:
    """(source_id, target_id, type, confidence) of all kinds: calls, contains, imports and references of each text."""
    made = resolve(calls(df, language, **options), nodes).select(F.col("unit").alias("source_id"), "target_id", F.lit("calls").alias("type"), "confidence")
    inside = contains(df, language, **options).select(F.concat_ws(":", "unit", "parent").alias("source_id"), F.concat_ws(":", "unit", "child").alias("target_id"), F.lit("contains").alias("type"), F.lit("EXTRACTED").alias("confidence"))
    return made.unionByName(inside).unionByName(imports(df, language, **options)).unionByName(references(df, language, **options)).distinct()


def resolve(calls_: DataFrame, nodes: DataFrame) -> DataFrame:
    """(unit, caller, callee, target_id, confidence): callees by short name; unresolved ones are external and inferred."""
    known = nodes.filter(F.lower(F.btrim("type")).isin("function", "method")).groupBy(F.btrim("name").alias("callee")).agg(F.max(F.btrim("id")).alias("_t"))
    out = calls_.join(known, "callee", "left")
    return out.select("unit", "caller", "callee", F.coalesce("_t", F.concat(F.lit("external:"), "callee")).alias("target_id"), F.when(F.col("_t").isNull(), "INFERRED").otherwise("EXTRACTED").alias("confidence"))
