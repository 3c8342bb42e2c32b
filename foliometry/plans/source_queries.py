"""Queries of typesetting sources, which stand-in rules make from parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliometry.functions import source
from foliometry.functions.scalar import r6
from foliometry.plans.registry import Tables, query, with_views

SRC = r"""src_ AS (SELECT p_partkey AS doc, p_size, '\documentclass[' || (10 + p_size % 3) || 'pt' || CASE WHEN p_partkey % 2 = 0 THEN ', twocolumn' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN ',fleqn' ELSE '' END || ']{article}' || chr(10)
 || CASE p_partkey % 4 WHEN 0 THEN '\usepackage[margin=' || (15 + p_size % 20) || 'mm]{geometry}' || chr(10) WHEN 1 THEN '\usepackage[top=2cm,left=' || (10 + p_size % 15) || 'mm, right=1in]{geometry}' || chr(10) WHEN 2 THEN '\usepackage[a4paper]{geometry}' || chr(10) ELSE '' END
 || CASE WHEN p_partkey % 4 = 0 THEN '\usepackage{microtype}' || chr(10) ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN '\usepackage{fancyhdr}' || chr(10) ELSE '' END || '\begin{document}' || chr(10)
 || CASE WHEN p_partkey % 2 = 0 THEN '\begin{abstract}' || chr(10) ELSE '' END || CASE WHEN p_partkey % 6 = 0 THEN '\tableofcontents' || chr(10) ELSE '' END || repeat('\section{S}' || chr(10), p_size % 4)
 || CASE WHEN p_partkey % 3 < 2 THEN '\begin{figure' || CASE WHEN p_partkey % 2 = 0 THEN '*' ELSE '' END || '}[t]' || chr(10) ELSE '' END || CASE WHEN p_partkey % 5 < 2 THEN '\begin{table}' || CASE WHEN p_partkey % 2 = 0 THEN '[H]' ELSE '' END || chr(10) ELSE '' END || '\end{document}' AS src FROM part)"""
FACT = r"""opt_ AS (SELECT *, list_transform(string_split(regexp_extract(src, '\\documentclass\[([^\]]*)\]', 1), ','), lambda o: trim(o)) AS opts, list_transform(string_split(regexp_extract(src, '\\usepackage\[([^\]]*)\]\{geometry\}', 1), ','), lambda o: trim(o)) AS geo FROM src_),
len_ AS (SELECT *, list_filter(geo, lambda o: starts_with(o, 'margin=')) AS m, list_transform(list_filter(geo, lambda o: regexp_matches(o, '^(top|bottom|left|right)=')), lambda o: CAST(regexp_extract(o, '=([0-9.]+)', 1) AS DOUBLE) * CASE WHEN o LIKE '%mm' THEN 1.0 WHEN o LIKE '%cm' THEN 10.0 ELSE 25.4 END) AS s FROM opt_),
fact_ AS (SELECT doc, p_size, src, 'article' AS documentclass, 10 + p_size % 3 AS font_pt, list_contains(opts, 'twocolumn') AS twocolumn, list_contains(opts, 'fleqn') AS fleqn,
 coalesce(CAST(regexp_extract(m[1], '=([0-9.]+)', 1) AS DOUBLE), list_min(s), 25.4) AS margin_mm, len(m) > 0 OR len(s) > 0 AS margin_explicit, contains(src, 'microtype') AS microtype, contains(src, '\begin{abstract}') AS abstract,
 len(regexp_extract_all(src, '\\section\{')) AS sections, len(string_split(src, chr(10))) AS lines, contains(src, '\tableofcontents') AS toc, contains(src, '{fancyhdr}') AS header FROM len_)"""


def sources(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    some = lambda cond, text: F.when(cond, text).otherwise("")
    text = F.concat(
        F.lit("\\documentclass["), (10 + size % 3).cast("string"), F.lit("pt"), some(k % 2 == 0, ", twocolumn"), some(k % 5 == 0, ",fleqn"), F.lit("]{article}\n"),
        F.when(k % 4 == 0, F.concat(F.lit("\\usepackage[margin="), (15 + size % 20).cast("string"), F.lit("mm]{geometry}\n")))
        .when(k % 4 == 1, F.concat(F.lit("\\usepackage[top=2cm,left="), (10 + size % 15).cast("string"), F.lit("mm, right=1in]{geometry}\n"))).when(k % 4 == 2, "\\usepackage[a4paper]{geometry}\n").otherwise(""),
        some(k % 4 == 0, "\\usepackage{microtype}\n"), some(k % 7 == 0, "\\usepackage{fancyhdr}\n"), F.lit("\\begin{document}\n"), some(k % 2 == 0, "\\begin{abstract}\n"), some(k % 6 == 0, "\\tableofcontents\n"),
        F.expr("repeat('\\\\section{S}\\n', p_size % 4)"), some(k % 3 < 2, F.concat(F.lit("\\begin{figure"), some(k % 2 == 0, "*"), F.lit("}[t]\n"))),
        some(k % 5 < 2, F.concat(F.lit("\\begin{table}"), some(k % 2 == 0, "[H]"), F.lit("\n"))), F.lit("\\end{document}"),
    )
    return t["part"].select(k.alias("doc"), "p_size", text.alias("src"))


FACTS = ("documentclass", "font_pt", "twocolumn", "fleqn", "margin_mm", "margin_explicit", "microtype", "abstract", "sections", "lines", "toc", "header")


@query("source_facts", with_views(SRC, FACT, body="SELECT doc, documentclass, font_pt, twocolumn, fleqn, round(margin_mm, 6) AS margin_mm, margin_explicit, microtype, abstract, sections, lines, toc, header FROM fact_"))
def source_parse(t: Tables) -> DataFrame:
    """Class, options, font size, margins and flags of each source."""
    f = source.facts(F.col("src"))
    out = source.with_commands(sources(t)).select("doc", *[c.alias(n) for n, c in f.items()])
    return out.withColumn("margin_mm", r6("margin_mm")).withColumn("sections", F.col("sections").cast("long")).withColumn("lines", F.col("lines").cast("long"))


@query("source_floats", with_views(SRC, body=r"SELECT doc, pos, regexp_extract(m, '\{([a-z]+)', 1) AS kind, contains(m, '*') AS starred, nullif(regexp_extract(m, '\[([^\]]*)\]', 1), '') AS spec FROM (SELECT doc, unnest(l) AS m, unnest(range(len(l))) AS pos FROM (SELECT doc, regexp_extract_all(src, '\\begin\{(?:figure|table)\*?\}(?:\[[^\]]*\])?') AS l FROM src_))"))
def source_floats(t: Tables) -> DataFrame:
    """Float environments in order: kind, starred, placement."""
    rows = sources(t).select("doc", F.posexplode(source.floats(F.col("src"))).alias("pos", "f"))
    return rows.select("doc", F.col("pos").cast("long").alias("pos"), "f.kind", "f.starred", "f.spec")


@query("gate_rules", with_views(SRC, FACT, body="""SELECT doc, code, code IN ('pages', 'font', 'margin', 'fleqn', 'toc', 'header') AS repairable FROM (SELECT doc, unnest([CASE WHEN p_size = 1 THEN 'compile' END, CASE WHEN p_size = 2 THEN 'pdf' END, CASE WHEN p_size > 40 THEN 'pages' END,
CASE WHEN font_pt <> 11 THEN 'font' END, CASE WHEN CASE WHEN doc % 2 = 0 THEN margin_mm < 19.5 ELSE abs(margin_mm - 20) > 0.5 END THEN 'margin' END, CASE WHEN fleqn THEN 'fleqn' END, CASE WHEN sections >= 2 AND NOT toc THEN 'toc' END, CASE WHEN doc % 3 = 0 AND NOT header THEN 'header' END]) AS code FROM fact_) WHERE code IS NOT NULL"""))
def gate_checks(t: Tables) -> DataFrame:
    """Rules that a measured source breaks, and whether an action can repair it; even documents' margin is a floor."""
    rows = source.with_commands(sources(t)).select("doc", "p_size", *[c.alias(n) for n, c in source.facts(F.col("src")).items()])
    size, lit = F.col("p_size"), F.lit
    codes = source.gates(size != 1, size != 2, size, lit(40), lit(11), lit(20.0), F.col("doc") % 2 == 0, lit(True), lit(2), F.col("doc") % 3 == 0)
    return rows.select("doc", F.explode(codes).alias("code")).withColumn("repairable", F.col("code").isin(*source.REPAIRABLE))
