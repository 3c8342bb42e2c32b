"""Queries of index pages: stand-ins of eight kinds of sites, made from pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliometry.operators import indexes
from foliometry.operators.lineage import cut
from foliometry.plans.registry import Tables, query

SITES = ("hashed", "blocks", "slugged", "listed", "wrapped", "panels", "talks", "journal")


def index_pages(t: Tables) -> DataFrame:
    """page_id, site, url, venue, year, volume, html: for each page an index of its navigation's words, in the form of a site by its number.

    Entries of each kind include such as a rule must leave out: other tracks, front matter, supplements, slides, missing links.
    """
    p = F.col("page_id")
    words = F.regexp_extract_all("html", F.lit('<li><a href="[^"]*">([^<]*)</a>'), F.lit(1))
    head = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    base = t["pages"].select("page_id", (2018 + p % 8).alias("year"), words.alias("words"), head.alias("head"), F.element_at(F.array(*map(F.lit, SITES)), (p % len(SITES) + 1).cast("int")).alias("site"))
    s = lambda *parts: F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in parts])
    year, short = F.col("year"), F.lpad((F.col("year") % 100).cast("string"), 2, "0")
    number = lambda i: F.col("page_id") * 100 + i
    hex_ = lambda i: F.substring(F.md5(s(number(i)).cast("binary")), 1, 12)
    title = lambda w: s(" ", F.col("head"), " &amp; ", w, ". ")

    def join(entry) -> Column:
        return F.array_join(F.transform("words", entry), "\n")

    either = lambda i, a, b, n=3: F.when(i % n == 0, a).otherwise(b)
    html = {
        "hashed": join(lambda w, i: s('<li><a href="/paper_files/paper/', year, "/hash/", hex_(i - i % 5), "-Abstract-", either(i, "Creative_AI_Track", "Conference"), '.html">', title(w), "</a></li>")),
        "blocks": join(lambda w, i: s('<div class="paper"><p class="title">', title(w), '</p><a href="https://proceedings.mlr.press/v', year, "/", w, i, '.html">abs</a>', either(i, "", s('<a href="https://files.example.org/', i, '.pdf">pdf</a><a href="x.pdf">'), 4), "</div>")),
        "slugged": join(lambda w, i: s("<dt><a href='/content/CONF", year, "/html/", w, i - i % 4, "_paper.html'>", title(w), "</a></dt>", either(i, "", s('<a href="/content/CONF', year, "/papers/", w, i, '_paper.pdf">pdf</a>')))),
        "listed": join(lambda w, i: s("<a class=align-middle href=/", year, either(i, ".other.", ".main.", 4), either(i, 0, i, 5), "/>", title(w), "</a>")),
        "wrapped": join(lambda w, i: s('<div id="paper', number(i) % 20011, '" class="paper_wrapper"><div class="title">', title(w), "</div></div>")),
        "panels": join(lambda w, i: s('<dt class="ptitle"><br><a href=papers/eccv_', either(i, year + 1, year, 5), "/papers_ECCV/html/", i, "_paper.php>\n<b>", title(w), "</b></a></dt><dd>[<a href='papers/eccv_", year, "/papers_ECCV/papers/", i, "-supp.pdf'>supp</a>", either(i, "", s("<a href='papers/eccv_", year, "/papers_ECCV/papers/", i, ".pdf'>pdf</a>"), 4), "]</dd>")),
        "talks": join(lambda w, i: s('<a href="/conference/conf', short, "/presentation/", F.col("page_id"), "-", i - i % 2, '">x</a>')),
        "journal": s('<a class="title" href="https://x/issue/view/', number(F.lit(1)), '">\n AAAI-', short, ' Technical Tracks 1 </a><a class="title" href="https://x/issue/view/', number(F.lit(2)), '">AAAI-', short, ' Special Track</a><a class="title" href="https://x/issue/view/', number(F.lit(3)), '">AAAI-', (F.col("year") + 1) % 100, " Technical Tracks 1</a>"),
    }
    shown = F.lit("")
    for site, form in html.items():
        shown = F.when(F.col("site") == site, form).otherwise(shown)
    columns = lambda df, site, url, form: df.select("page_id", site.alias("site"), url.alias("url"), s(F.when(F.col("site") == "talks", "conf").otherwise("CONF"), F.when(F.col("site") == "talks", short).otherwise("")).alias("venue"), "year", F.when(F.col("site") == "listed", s(year, ".main")).otherwise(s("v", year)).alias("volume"), form.alias("html"))
    index = columns(base, F.col("site"), s("https://index.example.org/", F.col("page_id")), shown)
    each = base.where(F.col("site").isin("talks", "journal")).select("*", F.posexplode("words").alias("i", "w"))
    i, w = F.col("i"), F.col("w")
    talk = s("<html><title>", title(w), "| USENIX</title><a href=\"https://www.usenix.org/system/files/", i, either(i, "_Slides", "_paper", 4), '.pdf">', either(i, "", s('<a href="https://www.usenix.org/system/files/full', i, '.pdf">'), 3))
    talks = columns(each.where("site = 'talks'"), F.lit("talk"), s("https://www.usenix.org/conference/conf", short, "/presentation/", F.col("page_id"), "-", i), talk)
    journal, view = "https://ojs.aaai.org/index.php/AAAI/article/view/", number(i)
    article = s('<div class="obj_article_summary"><h3><a id="article-', view, '" href="', journal, view, '">\n', s("<i>", title(w), "</i>"), "\n</a></h3>", either(i, s('<a class="obj_galley_link" href="', journal, view, '/1">Video</a>'), s('<a class="obj_galley_link pdf" href="', journal, either(i, view + 1, view, 5), "/", i + 7, '">PDF</a>'), 4), "</div>")
    issue = each.where("site = 'journal'").withColumn("part", i % 3 + 1).withColumn("html", article).groupBy("page_id", "site", "year", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "html"))), lambda x: x["html"]), "\n").alias("html"))
    issues = columns(issue, F.lit("issue"), s("https://ojs.aaai.org/index.php/AAAI/issue/view/", number(F.col("part"))), F.col("html"))
    return index.unionByName(talks).unionByName(issues)


@query("index_extract")
def index_extract(t: Tables) -> DataFrame:
    """Entries of the index pages of eight kinds of sites: title, landing page, PDF."""
    return indexes.extract(cut(index_pages(t)))


@query("index_even")
def index_even(t: Tables) -> DataFrame:
    """Three entries of each index page at even distances."""
    return indexes.pick_even(indexes.extract(cut(index_pages(t))), 3)
