"""Entries of venues' index pages: title, landing page and PDF, by one rule for each kind of site.

A page is cut into pieces in the engine (all matches of a pattern, or blocks between marks), pieces become rows in their order,
and what a rule needs beyond a piece is a join: PDF links of the same slug, the landing pages that an index links to, the
issues that an archive lists.

Defined results: titles are unescaped and trimmed, and entries without one are left out; of entries with the same key on a page
the first stays; null pages have no entries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliometry.functions.text import norm_title
from foliometry.operators.windows import first_per_key

#: Hosts and paths of the sites.
HASHED, PLAIN, SLUGGED, LISTED = "https://proceedings.neurips.cc", "https://proceedings.mlr.press", "https://openaccess.thecvf.com", "https://aclanthology.org"
WRAPPED, TALKS, JOURNAL, PANELS = "https://www.ijcai.org/proceedings", "https://www.usenix.org", "https://ojs.aaai.org/index.php/AAAI", "https://www.ecva.net"


def _all(pattern: Column) -> Column:
    """All matches of a pattern that may depend on the row."""
    return F.regexp_extract_all(F.col("html"), pattern, F.lit(0))


def _pattern(*parts: Column | str) -> Column:
    """A pattern of fixed parts and of columns that stand for themselves."""
    quoted = [F.lit(p) if isinstance(p, str) else F.concat(F.lit("\\Q"), p.cast("string"), F.lit("\\E")) for p in parts]
    return F.concat(*quoted)


def _part(c: Column, pattern: str | Column, group: int = 1) -> Column:
    return F.regexp_extract(c, pattern, group) if isinstance(pattern, str) else F.get(F.regexp_extract_all(c, pattern, F.lit(group)), F.lit(0))


def _strip(c: Column, by: str = "") -> Column:
    return F.regexp_replace(c, "<[^>]+>", by)


def _entries(pages: DataFrame, pieces: Column) -> DataFrame:
    """Pieces of pages as rows: the columns of pages but the html, pos and piece."""
    return pages.select(*[c for c in pages.columns if c != "html"], F.posexplode(pieces).alias("pos", "piece"))


def _result(df: DataFrame, title: Column, landing: Column, pdf: Column, key: Column | None = None) -> DataFrame:
    """Rows with a title, a landing page and a PDF; the first of each key of a page."""
    rows = df.select("page_id", F.col("pos").cast("long").alias("pos"), norm_title(title).alias("title"), landing.alias("landing_url"), pdf.alias("pdf_url"), (key if key is not None else F.col("pos").cast("string")).alias("key"))
    rows = rows.where((F.col("title") != "") & (F.col("landing_url") != "") & (F.col("pdf_url") != ""))
    return first_per_key(rows, ["page_id", "key"], [F.col("pos")]).drop("key") if key is not None else rows.drop("key")


def hashed(pages: DataFrame, track: str | None = "Conference") -> DataFrame:
    """Links to abstracts whose file name, with another suffix, is the PDF's; one track, or all."""
    rows = _entries(pages, _all(_pattern('href="/paper_files/paper/', F.col("year"), r'/hash/[0-9a-f]{6,}-Abstract-[A-Za-z_]+\.html">[^<]{5,400}</a>')))
    path, name, kind = _part(F.col("piece"), '"([^"]*)"'), _part(F.col("piece"), "/hash/([0-9a-f]+)-"), _part(F.col("piece"), r"-Abstract-([A-Za-z_]+)\.html")
    rows = rows.where(kind == track) if track else rows
    pdf = F.concat(F.lit(f"{HASHED}/paper_files/paper/"), F.col("year").cast("string"), F.lit("/file/"), name, F.lit("-Paper-"), kind, F.lit(".pdf"))
    return _result(rows, _part(F.col("piece"), ">([^<]*)<"), F.concat(F.lit(HASHED), path), pdf, name)


def blocks(pages: DataFrame) -> DataFrame:
    """Blocks of a paper each, which hold the title, the landing page in the volume and the PDF."""
    rows = _entries(pages, F.slice(F.split("html", '<div class="paper">', -1), 2, 1 << 30))
    landing = F.coalesce(_part(F.col("piece"), _pattern(f'href="({PLAIN}/', F.col("volume"), r'/[^"]+\.html)"')), F.lit(""))
    return _result(rows, _part(F.col("piece"), '<p class="title">([^<]+)</p>'), landing, _part(F.col("piece"), r'href="([^"]+\.pdf)"'))


def slugged(pages: DataFrame) -> DataFrame:
    """Links to pages and to PDFs that share a slug, in either quotes; a page without its PDF link gets the address by rule."""
    at = lambda kind, rest: _pattern("href=['\"]/content/", F.col("venue"), F.col("year"), f"/{kind}/", rest)
    slug = _part(F.col("piece"), r"/(?:html|papers)/([^'\"]+?)_paper\.(?:html|pdf)")
    rows = _entries(pages, _all(at("html", r"[^'\"]+?_paper\.html['\"]\s*>[^<]{5,400}<"))).withColumn("slug", slug)
    links = _entries(pages, _all(at("papers", r"[^'\"]+?_paper\.pdf['\"]"))).select("page_id", slug.alias("slug"), F.concat(F.lit(SLUGGED), _part(F.col("piece"), "['\"]([^'\"]*)['\"]")).alias("pdf")).distinct()
    address = lambda kind, end: F.concat(F.lit(f"{SLUGGED}/content/"), F.col("venue"), F.col("year").cast("string"), F.lit(f"/{kind}/"), F.col("slug"), F.lit(f"_paper.{end}"))
    both = rows.join(links, ["page_id", "slug"], "left")
    return _result(both, _part(F.col("piece"), ">([^<]*)<"), address("html", "html"), F.coalesce("pdf", address("papers", "pdf")), F.col("slug"))


def listed(pages: DataFrame) -> DataFrame:
    """Links by an id of the volume, without quotes; number 0 is the volume's front matter."""
    rows = _entries(pages, _all(F.lit("<a class=align-middle href=/[0-9A-Za-z.\\-]+?/>[^<]{5,400}</a>"))).withColumn("id", _part(F.col("piece"), "href=/([0-9A-Za-z.\\-]+?)/>"))
    rows = rows.where(F.col("id").startswith(F.concat(F.col("volume"), F.lit("."))) & (F.substring_index("id", ".", -1) != "0"))
    return _result(rows, _part(F.col("piece"), ">([^<]*)<"), F.concat(F.lit(f"{LISTED}/"), F.col("id"), F.lit("/")), F.concat(F.lit(f"{LISTED}/"), F.col("id"), F.lit(".pdf")), F.col("id"))


def wrapped(pages: DataFrame) -> DataFrame:
    """Numbered wrappers; pages and PDFs are named by the number, PDFs with four digits."""
    rows = _entries(pages, _all(F.lit('<div id="paper[0-9]+" class="paper_wrapper"><div class="title">[^<]+</div>')))
    number = _part(F.col("piece"), 'id="paper0*([0-9]+)"')
    base = F.concat(F.lit(f"{WRAPPED}/"), F.col("year").cast("string"), F.lit("/"))
    return _result(rows, _part(F.col("piece"), '"title">([^<]+)<'), F.concat(base, number), F.concat(base, F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number), F.lit(".pdf")))


def talks(pages: DataFrame, landing: DataFrame) -> DataFrame:
    """Links to talks, whose own pages (url, html) give the title and the first PDF that holds no slides."""
    rows = _entries(pages, _all(_pattern('href="/conference/', F.col("venue"), '/presentation/[^"]+"')))
    rows = rows.withColumn("url", F.concat(F.lit(TALKS), _part(F.col("piece"), '"([^"]*)"')))
    files = F.filter(F.regexp_extract_all("html", F.lit(f'href="({TALKS}/system/files/[^"]+\\.pdf)"'), F.lit(1)), lambda x: ~F.lower(x).contains("slides"))
    known = landing.select("url", _part(F.col("html"), r"<title>([^<]*?)\s*\|\s*USENIX").alias("name"), F.coalesce(F.get(files, F.lit(0)), F.lit("")).alias("pdf")).dropDuplicates(["url"])
    return _result(first_per_key(rows, ["page_id", "url"], [F.col("pos")]).join(known, "url"), F.col("name"), F.col("url"), F.col("pdf"))


def journal(archive: DataFrame, issues: DataFrame, main_only: bool = True) -> DataFrame:
    """Articles of the issues (issue, html) that an archive's pages list for its year: article page and the PDF galley of the same number."""
    found = _entries(archive, _all(F.lit(r'<a class="title" href="[^"]*issue/view/[0-9]+">\s*[^<]*')))
    title = norm_title(_part(F.col("piece"), ">([^<]*)$"))
    short = F.lpad((F.col("year") % 100).cast("string"), 2, "0")
    wanted = title.startswith(F.concat(F.lit("AAAI-"), short, F.lit(" Technical Tracks"))) if main_only else title.rlike("^AAAI-[0-9]{2}\\b") & (F.substring(title, 6, 2) == short)
    listed_ = found.where(wanted).select("page_id", _part(F.col("piece"), "issue/view/([0-9]+)").alias("issue"), F.col("pos").alias("of")).groupBy("page_id", "issue").agg(F.min("of").alias("of"))
    pieces = issues.select("issue", F.posexplode(F.slice(F.split("html", '<div class="obj_article_summary">', -1), 2, 1 << 30)).alias("k", "piece"))
    rows = listed_.join(pieces, "issue").withColumn("pos", F.row_number().over(W.partitionBy("page_id").orderBy("of", "issue", "k")) - 1)
    article = rf'(?s)<a id="article-[0-9]+" href="({JOURNAL}/article/view/([0-9]+))">\s*(.*?)\s*</a>'
    galley = rf'<a class="obj_galley_link pdf" href="{JOURNAL}/article/view/([0-9]+)/([0-9]+)"'
    own, file = _part(F.col("piece"), article, 2), _part(F.col("piece"), galley, 1)
    same = rows.where((own != "") & (own == file))
    return _result(same, _strip(_part(F.col("piece"), article, 3)), _part(F.col("piece"), article, 1), F.concat(F.lit(f"{JOURNAL}/article/download/"), file, F.lit("/"), _part(F.col("piece"), galley, 2)))


def panels(pages: DataFrame) -> DataFrame:
    """Panels of a term: a link to the paper's page with the title, and the first PDF that is no supplement."""
    rows = _entries(pages, F.slice(F.split("html", '<dt class="ptitle">', -1), 2, 1 << 30))
    folder = _pattern("papers/eccv_", F.col("year"), "/papers_ECCV/")
    link = F.concat(F.lit("(?s)<a href=['\"]?"), folder, F.lit("html/[^'\">]+\\.php['\"]?>(.*?)</a>"))
    files = F.regexp_extract_all("piece", F.concat(F.lit("href=['\"]("), folder, F.lit("papers/[^'\"]+?\\.pdf)['\"]")), F.lit(1))
    pdf = F.get(F.filter(files, lambda x: ~F.lower(x).endswith("-supp.pdf")), F.lit(0))
    return _result(rows, _strip(F.coalesce(_part(F.col("piece"), link), F.lit("")), " "), F.lit(f"{PANELS}/papers.php"), F.coalesce(F.concat(F.lit(f"{PANELS}/"), pdf), F.lit("")))


#: Rules that need one page alone, by the name of the site's kind.
RULES: dict[str, Callable[[DataFrame], DataFrame]] = {"hashed": hashed, "blocks": blocks, "slugged": slugged, "listed": listed, "wrapped": wrapped, "panels": panels}


def extract(pages: DataFrame) -> DataFrame:
    """Index entries of all kinds of pages: page_id, pos, title, landing_url, pdf_url.

    pages: page_id, site (a rule's name; talks and journal have talk, archive and issue pages as well), url, venue, year, volume, html.
    """
    of = lambda site: pages.where(F.col("site") == site)
    parts = [rule(of(site)) for site, rule in RULES.items()]
    parts.append(talks(of("talks"), of("talk").select("url", "html")))
    parts.append(journal(of("journal"), of("issue").select(F.regexp_extract("url", "([0-9]+)$", 1).alias("issue"), "html")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def pick_even(entries: DataFrame, limit: int) -> DataFrame:
    """limit entries of each page at even distances in their order, all where there are fewer."""
    w = W.partitionBy("page_id")
    numbered = entries.withColumn("__i", F.row_number().over(w.orderBy("pos")) - 1).withColumn("__n", F.count("*").over(w))
    before = F.floor(F.col("__i") * limit / F.col("__n"))
    first = [F.floor((before + d) * (F.col("__n") / F.lit(float(limit)))) == F.col("__i") for d in (0, 1)]
    return numbered.where((F.col("__n") <= limit) | ((first[0] & (before < limit)) | (first[1] & (before + 1 < limit)))).drop("__i", "__n")
