"""Controlled degradations of sources, and the ladder that adds them up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECTION = r"\\section\*?\{"
PACKAGE = r"\\usepackage(?:\[[^\]]*\])?\{[^}]*\}"
#: What the degradations put in.
SPACE, BREAK, WIDE, PLACE = "\\vspace{3cm}\n", "\\newpage\n", "\\includegraphics[width=1.25\\linewidth]", "\\usepackage{float}"


def _quoted(text: str) -> str:
    """text as a replacement that stands for itself."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def before_nth(c: Column, pattern: str, n: int, text: str) -> Column:
    """c with text put in before the n-th match; unchanged where there are fewer."""
    return F.regexp_replace(c, F.lit(rf"(?s)\A((?:.*?{pattern}){{{n - 1}}}.*?)({pattern})"), F.lit(f"$1{_quoted(text)}$2"))


def spaced(c: Column) -> Column:
    return before_nth(c, SECTION, 2, SPACE)


def broken(c: Column) -> Column:
    return before_nth(c, SECTION, 2, BREAK)


def forced(c: Column) -> Column:
    """Floats with a place are forced to where they stand, and the package for it is loaded if it is not."""
    placed = r"\\begin\{(figure|table)(\*?)\}\s*\[[^\]]*\]"
    out = F.regexp_replace(c, F.lit(placed), F.lit(r"\\begin{$1$2}[H]"))
    loaded = out.contains(PLACE) | out.contains("\\usepackage{placeins}")
    behind = F.regexp_replace(out, F.lit(rf"(?s)\A(.*?{PACKAGE})"), F.lit(f"$1\n{_quoted(PLACE)}"))
    ahead = before_nth(out, r"\\begin\{document\}", 1, f"{PLACE}\n")
    return F.when(~c.rlike(placed), c).when(loaded, out).when(out.rlike(PACKAGE), behind).otherwise(ahead)


def widened(c: Column) -> Column:
    """The first figure with options is widened beyond the line."""
    return F.regexp_replace(c, F.lit(r"(?s)\A(.*?)\\includegraphics\s*\[[^\]]*\]"), F.lit(f"$1{_quoted(WIDE)}"))


#: Each level adds one degradation to those before.
LADDER = (spaced, broken, forced, widened)
