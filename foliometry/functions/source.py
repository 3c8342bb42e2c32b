"""Facts of typesetting sources, read from their commands: each command is a name, options and an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliometry.functions.scalar import MM, length_in

#: One command with options or without and a plain argument.
COMMAND = r"\\([A-Za-z]+\*?)\s*(?:\[([^\]]*)\])?\s*\{([^{}]*)\}"
#: The column of a table's commands.
COMMANDS = "__commands"
#: Gate codes that deterministic actions can repair.
REPAIRABLE = ("pages", "font", "margin", "fleqn", "toc", "header")
#: Width and height of papers in mm.
PAPER_MM = {"a4paper": (210.0, 297.0), "a5paper": (148.0, 210.0), "b5paper": (176.0, 250.0), "letterpaper": (215.9, 279.4), "legalpaper": (215.9, 355.6), "executivepaper": (184.15, 266.7)}
FLOATS = ("figure", "table")


def listed(c: Column) -> Column:
    """The entries of a comma-separated list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, ","), lambda o: F.trim(o)), lambda o: o != "")  # noqa: PLW0108 (F.trim takes two)


def commands(src: Column) -> Column:
    """All commands of a source in order: name, options (list), argument."""
    part = lambda m, k: F.regexp_extract(m, COMMAND, k)
    return F.transform(F.regexp_extract_all(src, F.lit(COMMAND), F.lit(0)), lambda m: F.struct(part(m, 1).alias("name"), listed(part(m, 2)).alias("options"), part(m, 3).alias("argument")))


def settings(options: Column) -> Column:
    """key=value entries as key and value; an entry without = has no value."""
    return F.transform(options, lambda o: F.struct(F.trim(F.substring_index(o, "=", 1)).alias("key"), F.when(o.contains("="), F.trim(F.regexp_replace(o, "^[^=]*=", ""))).alias("value")))


def with_commands(df: DataFrame, src: str = "src") -> DataFrame:
    """df with the array of each source's commands, which is made once for all facts that are read from it."""
    return df.withColumn(COMMANDS, commands(F.col(src)))


class Source:
    """Columns of one source of a table that with_commands() has gone over."""

    def __init__(self, src: Column) -> None:
        self.src, self.commands = src, F.col(COMMANDS)

    def named(self, *names: str) -> Column:
        return F.filter(self.commands, lambda c: c["name"].isin(*names))

    def loads(self, package: str) -> Column:
        return F.exists(self.named("usepackage", "RequirePackage"), lambda c: F.array_contains(listed(c["argument"]), package))

    @property
    def document_class(self) -> Column:
        return F.get(self.named("documentclass"), F.lit(0))

    def has_option(self, option: str) -> Column:
        return F.coalesce(F.array_contains(self.document_class["options"], option), F.lit(False))

    @property
    def font_pt(self) -> Column:
        """The last class option such as 11pt; 10 where there is none."""
        sizes = F.filter(F.coalesce(self.document_class["options"], F.array().cast("array<string>")), lambda o: o.rlike("^[0-9]+pt$"))
        return F.coalesce(F.regexp_extract(F.get(F.reverse(sizes), F.lit(0)), "^[0-9]+", 0).cast("int"), F.lit(10))

    @property
    def geometry(self) -> Column:
        """Settings of page geometry: those of the package where it is loaded with some, else those of its command."""
        packages = F.flatten(F.transform(F.filter(self.named("usepackage", "RequirePackage"), lambda c: F.array_contains(listed(c["argument"]), "geometry")), lambda c: c["options"]))
        calls = F.flatten(F.transform(self.named("geometry"), lambda c: listed(c["argument"])))
        return settings(F.when(F.size(packages) > 0, packages).otherwise(calls))

    def margin_mm(self) -> tuple[Column, Column]:
        """Margin in mm and whether the source states it: margin=, else the least of the sides, else one inch."""
        lengths = F.filter(F.transform(self.geometry, lambda s: F.struct(s["key"].alias("key"), length_in(s["value"], MM).alias("mm"))), lambda s: s["mm"].isNotNull())
        mm = lambda *keys: F.transform(F.filter(lengths, lambda s: s["key"].isin(*keys)), lambda s: s["mm"])
        whole, least = F.get(F.reverse(mm("margin")), F.lit(0)), F.array_min(mm("top", "bottom", "left", "right"))
        return F.coalesce(whole, least, F.lit(25.4)), whole.isNotNull() | least.isNotNull()

    def text_area_mm(self) -> tuple[Column, Column]:
        """Width and height of the text: paper by class option (letter where none is named) less the margins, at least 20 mm."""
        margin, known = self.margin_mm()[0], F.filter(F.coalesce(self.document_class["options"], F.array().cast("array<string>")), lambda o: o.isin(*PAPER_MM))
        paper = F.coalesce(F.get(known, F.lit(0)), F.lit("letterpaper"))
        sides = []
        for k in range(2):
            size = F.lit(PAPER_MM["letterpaper"][k])
            for name, mm in PAPER_MM.items():
                size = F.when(paper == name, F.lit(mm[k])).otherwise(size)
            sides.append(F.greatest(size - 2 * margin, F.lit(20.0)))
        return sides[0], sides[1]

    @property
    def header(self) -> Column:
        """A running header: its package, its page style, or one of its commands."""
        return self.loads("fancyhdr") | F.exists(self.named("pagestyle"), lambda c: c["argument"] == "fancy") | self.src.contains("\\fancyhead")


def floats(src: Column) -> Column:
    """Float environments in order: kind, starred and placement (null where none is stated)."""
    begin = r"\\begin\{(" + "|".join(FLOATS) + r")(\*?)\}(?:\[([^\]]*)\])?"
    whole = F.regexp_extract_all(src, F.lit(begin), F.lit(0))
    return F.transform(whole, lambda m: F.struct(F.regexp_extract(m, begin, 1).alias("kind"), (F.regexp_extract(m, begin, 2) == "*").alias("starred"), F.nullif(F.trim(F.regexp_extract(m, begin, 3)), F.lit("")).alias("spec")))


def facts(src: Column) -> dict[str, Column]:
    """Columns over a table that with_commands() has gone over."""
    s = Source(src)
    margin, explicit = s.margin_mm()
    return {
        "documentclass": F.coalesce(s.document_class["argument"], F.lit("")), "font_pt": s.font_pt, "twocolumn": s.has_option("twocolumn"), "fleqn": s.has_option("fleqn"), "margin_mm": margin, "margin_explicit": explicit,
        "microtype": src.contains("microtype"), "abstract": F.exists(s.named("begin"), lambda c: c["argument"] == "abstract"), "sections": F.size(s.named("section", "section*")), "lines": F.size(F.split(src, "\n", -1)),
        "toc": src.contains("\\tableofcontents"), "header": s.header,
    }


def gates(compiled: Column, has_pdf: Column, pages: Column, limit: Column, need_font: Column, need_margin: Column, is_floor: Column, need_toc: Column, least_sections: Column, need_header: Column) -> Column:
    """Codes of the rules that a row (with the columns of facts) breaks; a null requirement asks nothing."""
    short = need_margin - F.col("margin_mm")
    broken = {
        "header": need_header & ~F.col("header"), "toc": need_toc & ~F.col("toc") & (F.col("sections") >= least_sections), "fleqn": F.col("fleqn"), "margin": (short > 0.5) | ~is_floor & (short < -0.5),
        "font": need_font != F.col("font_pt"), "pages": pages > limit, "pdf": compiled & ~has_pdf, "compile": ~compiled,
    }
    return F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in broken.items()]))
