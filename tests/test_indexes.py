"""Index rules against plain-Python readings of the same pages."""

import html as markup
import re
from collections import Counter

from conftest import DATA
from foliometry.operators import indexes
from foliometry.plans import index_queries, registry

SITE = {"hashed": "https://proceedings.neurips.cc", "slugged": "https://openaccess.thecvf.com", "listed": "https://aclanthology.org", "wrapped": "https://www.ijcai.org/proceedings", "journal": "https://ojs.aaai.org/index.php/AAAI", "panels": "https://www.ecva.net"}


def clean(x):
    return re.sub(r"[ \t\n\r]+", " ", markup.unescape(x)).strip().strip(" .·-")


def plain(page, by_url):
    """(title, landing page, PDF) of one index page."""
    text, year, volume, out, seen = page.html or "", page.year, page.volume, [], set()
    if page.site == "hashed":
        for path, name, track, title in re.findall(rf'href="(/paper_files/paper/{year}/hash/([0-9a-f]+)-Abstract-(\w+)\.html)">([^<]+)<', text):
            if track == "Conference" and name not in seen:
                seen.add(name)
                out.append((title, SITE["hashed"] + path, f"{SITE['hashed']}/paper_files/paper/{year}/file/{name}-Paper-{track}.pdf"))
    elif page.site == "blocks":
        for part in text.split('<div class="paper">')[1:]:
            title, landing, pdf = re.search(r'"title">([^<]+)', part), re.search(rf'"(https://proceedings.mlr.press/{volume}/[^"]+\.html)"', part), re.search(r'href="([^"]+\.pdf)"', part)
            if title and landing and pdf:
                out.append((title[1], landing[1], pdf[1]))
    elif page.site == "slugged":
        pdfs = set(re.findall(rf"/content/{page.venue}{year}/papers/([^'\"]+)_paper\.pdf", text))
        for slug, title in re.findall(rf"/content/{page.venue}{year}/html/([^'\"]+)_paper\.html'>([^<]+)<", text):
            if slug not in seen:
                seen.add(slug)
                out.append((title, f"{SITE['slugged']}/content/{page.venue}{year}/html/{slug}_paper.html", f"{SITE['slugged']}/content/{page.venue}{year}/papers/{slug}_paper.pdf"))
        assert pdfs
    elif page.site == "listed":
        for name, title in re.findall(r"<a class=align-middle href=/([^/]+)/>([^<]+)<", text):
            if name.startswith(volume + ".") and not name.endswith(".0") and name not in seen:
                seen.add(name)
                out.append((title, f"{SITE['listed']}/{name}/", f"{SITE['listed']}/{name}.pdf"))
    elif page.site == "wrapped":
        out = [(title, f"{SITE['wrapped']}/{year}/{int(n)}", f"{SITE['wrapped']}/{year}/{int(n):04d}.pdf") for n, title in re.findall(r'id="paper(\d+)" class="paper_wrapper"><div class="title">([^<]+)<', text)]
    elif page.site == "panels":
        for part in text.split('<dt class="ptitle">')[1:]:
            title = re.search(rf"<a href=papers/eccv_{year}/papers_ECCV/html/\d+_paper\.php>(.*?)</a>", part, re.S)
            pdfs = [x for x in re.findall(r"href='([^']+\.pdf)'", part) if "-supp" not in x and f"eccv_{year}/" in x]
            if title and pdfs:
                out.append((re.sub("<[^>]*>", " ", title[1]), f"{SITE['panels']}/papers.php", f"{SITE['panels']}/{pdfs[0]}"))
    elif page.site == "talks":
        for path in dict.fromkeys(re.findall(rf'href="(/conference/{page.venue}/presentation/[^"]+)"', text)):
            talk = by_url.get("https://www.usenix.org" + path, "")
            pdfs = [x for x in re.findall(r'href="(https://www.usenix.org/system/files/[^"]+)"', talk) if "slides" not in x.lower()]
            if pdfs:
                out.append((re.search(r"<title>([^<]*?)\s*\| USENIX", talk)[1], "https://www.usenix.org" + path, pdfs[0]))
    elif page.site == "journal":
        for issue, title in re.findall(r'issue/view/(\d+)">([^<]*)<', text):
            if title.strip().startswith(f"AAAI-{year % 100:02d} Technical"):
                for part in by_url.get(f"{SITE['journal']}/issue/view/{issue}", "").split('<div class="obj_article_summary">')[1:]:
                    a, g = re.search(r'href="(\S+/view/(\d+))">(.*?)</a>', part, re.S), re.search(r'link pdf" href="\S+/view/(\d+)/(\d+)"', part)
                    if g and a[2] == g[1]:
                        out.append((re.sub("<[^>]*>", "", a[3]), a[1], f"{SITE['journal']}/article/download/{g[1]}/{g[2]}"))
    return [(clean(t), a, b) for t, a, b in out if clean(t)]


def test_each_rule_equals_a_plain_reading(spark):
    pages = index_queries.index_pages(registry.Tables(spark, DATA)).collect()
    by_url = {p.url: p.html for p in pages}
    want = Counter((p.page_id, *x) for p in pages for x in plain(p, by_url))
    got = registry.run("index_extract")(spark, DATA).collect()
    assert Counter((r.page_id, r.title, r.landing_url, r.pdf_url) for r in got) == want
    assert {p.site for p in pages if p.page_id in {k for k, *_ in want}} >= set(index_queries.SITES)
    order = {}
    for r in sorted(got, key=lambda r: (r.page_id, r.pos)):
        order.setdefault(r.page_id, []).append(r.landing_url)
    assert all(order[p.page_id] == [x[1] for x in plain(p, by_url)] for p in pages if p.site in index_queries.SITES and p.page_id in order)


def test_even_picks(spark):
    entries = [(page, pos) for page, n in enumerate((0, 1, 3, 4, 7, 50)) for pos in range(n)]
    df = spark.createDataFrame(entries, "page_id long, pos long")
    for limit in (1, 3, 5, 49, 60):
        want = Counter()
        for page, n in enumerate((0, 1, 3, 4, 7, 50)):
            want.update((page, k) for k in (range(n) if limit >= n else {int(i * (n / float(limit))) for i in range(limit)}))
        assert Counter((r.page_id, r.pos) for r in indexes.pick_even(df, limit).collect()) == want


def test_empty_and_missing_pages(spark):
    rows = [(1, "hashed", "u", "X", 2020, "v1", None), (2, "blocks", "u", "X", 2020, "v.1", '<div class="paper"><p class="title">&nbsp;</p>'), (3, "journal", "u", "X", 2020, "v1", ""), (4, "listed", "u", "X", 2020, "a.b", "<a class=align-middle href=/axb.1/>Title five</a>")]
    df = spark.createDataFrame(rows, "page_id long, site string, url string, venue string, year int, volume string, html string")
    assert indexes.extract(df).collect() == [] and indexes.extract(df.limit(0)).collect() == []
