"""Text normalisation and pattern expressions over source lines, logs and pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entities and typographic replacements.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&lsquo;", "‘"), ("&rsquo;", "’"),
    ("&ldquo;", "“"), ("&rdquo;", "”"), ("&copy;", "©"), ("&reg;", "®"), ("&deg;", "°"), ("&middot;", "·"), ("&bull;", "•"), ("&times;", "×"), ("&amp;", "&"),
)
QUOTES_FROM, QUOTES_TO = "‘’“”–—−", "''\"\"---"
LIGATURES = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("­", ""))
#: A box message is a word, a side, a detail in brackets and its place; the places that name lines, and the one of pages.
BOX = r"(Over|Under)full \\([hv])box \(([^)]*)\) (.*)"
BOX_KINDS = {"Overh": "overfull", "Underh": "underfull", "Overv": "vbox_over", "Underv": "vbox_under"}
AT_LINE, AT_LINES, ON_PAGE = "detected at line ", ("in paragraph at lines ", "in alignment at lines "), "has occurred while \\output is active"
#: Other messages.
WARNING, ERROR = "LaTeX Warning: ", "! "


def unescape(c: Column) -> Column:
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def norm_title(c: Column) -> Column:
    """Unescaped, blanks collapsed, dots, bullets and dashes trimmed."""
    return F.btrim(F.regexp_replace(unescape(c), r"[ \t\n\r]+", " "), F.lit(" .·-"))


def norm_quote(c: Column) -> Column:
    """Ligatures, quotes and dashes in plain form, lower case, one blank between words."""
    for a, b in LIGATURES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.lower(F.btrim(F.regexp_replace(F.translate(c, QUOTES_FROM, QUOTES_TO), r"[ \t\n\r]+", " ")))


def html_text(c: Column) -> Column:
    """Readable text of a page: no scripts or styles, a blank for each tag, block tags break lines."""
    for tag in ("script", "style", "noscript"):
        c = F.regexp_replace(c, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6]|section|article)>", "\n")
    c = unescape(F.regexp_replace(c, r"<[^>]+>", " "))
    c = F.regexp_replace(F.regexp_replace(c, "[ \t\u00a0]+", " "), r"\n[ \n]*\n[ \n]*\n+", "\n\n")
    return F.btrim(c, F.lit(" \t\r\n"))


def strip_layout(c: Column) -> Column:
    """A body without layout: tables' bars, digits' marks, symbol runs and blanks."""
    c = F.regexp_replace(c, r"[|]", "")
    c = F.regexp_replace(c, r"[#$%&*]{3}", "")
    return F.regexp_replace(c, r"[ \t\n\r]+", "")


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, which is worked out once however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def log_message(c: Column) -> Column:
    """A log line as kind (overfull, underfull, vbox_over, vbox_under, floatwarn, error, warning or other), amount, first and last.

    The amount is the number in a box message's detail: points too wide or high, or badness. first and last are its source lines:
    a single line has no last one, a page's box has none.
    """

    def parts(x: Column) -> Column:
        return F.struct(x.alias("text"), *[F.regexp_extract(x, BOX, k).alias(name) for k, name in enumerate(("word", "side", "detail", "place"), 1)])

    def placed(p: Column) -> Column:
        named = p["place"].startswith(AT_LINE) | (p["side"] == "h") & (p["place"].startswith(AT_LINES[0]) | p["place"].startswith(AT_LINES[1]))
        numbers = F.nullif(F.regexp_extract(p["place"], "^[a-z ]+ ([0-9]+(?:--[0-9]+)?)", 1), F.lit(""))
        at = F.when(named, numbers).when((p["side"] == "v") & p["place"].startswith(ON_PAGE), F.lit(""))
        return F.struct(p["text"].alias("text"), F.concat(p["word"], p["side"]).alias("box"), p["detail"].alias("detail"), at.alias("at"))

    def read(p: Column) -> Column:
        said = p["text"].contains(WARNING)
        kind = F.when(said & F.lower(p["text"]).contains("float"), "floatwarn").when(p["text"].startswith(ERROR), "error").when(said, "warning").otherwise("other")
        kinds = F.create_map(*[F.lit(x) for pair in BOX_KINDS.items() for x in pair])
        line = lambda k: F.nullif(F.get(F.split(p["at"], "--", -1), F.lit(k)), F.lit("")).cast("long")
        amount = F.nullif(F.regexp_extract(p["detail"], r"[0-9]+\.?[0-9]*", 0), F.lit("")).cast("double")
        is_box = p["at"].isNotNull()
        return F.struct(F.when(is_box, F.element_at(kinds, p["box"])).otherwise(kind).alias("kind"), F.when(is_box, amount).alias("amount"), line(0).alias("first"), line(1).alias("last"))

    return _once(_once(_once(c, parts), placed), read)


def caption_kind(c: Column) -> Column:
    word = F.lower(F.regexp_extract(c, r"^\s*(?i:(fig(?:ure|\.)?|tab(?:le|\.)?))\s*[0-9]+", 1))
    return F.when(word.startswith("fig"), "figure").when(word.startswith("tab"), "table")


def link_candidates(url: Column) -> Column:
    """Repaired forms of an address by rule: no fragment, https, no mobile host, lower case, no query; distinct, in order, without itself."""
    forms = F.array(F.regexp_replace(url, "#.*$", ""), F.regexp_replace(url, "^http://", "https://"), F.regexp_replace(url, "^(https?://)m\\.", "$1"), F.lower(url), F.regexp_replace(url, "\\?.*$", ""))
    return F.filter(F.array_distinct(forms), lambda x: x != url)
