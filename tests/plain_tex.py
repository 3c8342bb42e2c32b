"""Plain-Python readings of typesetting sources, for comparison with the Spark operators. Written from the rules, one document at a time."""

import re

PT = {"pt": 1.0, "mm": 72.27 / 25.4, "cm": 72.27 / 2.54, "in": 72.27, "em": 10.0, "ex": 4.3, "mu": 0.5}
MM = {"mm": 1.0, "cm": 10.0, "in": 25.4, "pt": 25.4 / 72.27}
SIZES = "tiny scriptsize footnotesize small normalsize large Large LARGE huge Huge".split()
CAPS = {"chapter": "Large", "section": "Large", "subsection": "large", "subsubsection": "normalsize"}
ROWS = set("tabular tabular* tabularx longtable array align align* alignat alignat* flalign flalign* gather gather* multline multline* eqnarray eqnarray* aligned alignedat gathered split cases smallmatrix matrix pmatrix bmatrix Bmatrix vmatrix Vmatrix".split())
PAPERS = {"a4paper": (210, 297), "letterpaper": (215.9, 279.4)}


def length(text, table):
    m = re.match(r"\s*(-?\d*\.?\d+)\s*([a-z]*)\s*\Z", text)
    return float(m[1]) * table[m[2] or "pt"] if m and (m[2] or "pt") in table else None


def braced(text, at):
    """The argument whose brace opens at or behind blanks after at: (content, place of its first character)."""
    while at < len(text) and text[at].isspace():
        at += 1
    if text[at : at + 1] != "{":
        return None
    depth = 0
    for k in range(at, len(text)):
        depth += {"{": 1, "}": -1}.get(text[k], 0)
        if depth == 0:
            return text[at + 1 : k], at + 1
    return None


def spans(text):
    """(name, start, start of the end mark, end) of closed environments."""
    stack, out = [], []
    for m in re.finditer(r"\\(begin|end)\{([a-zA-Z*]+)\}", text):
        if m[1] == "begin":
            stack.append(m)
        elif stack and stack[-1][2] == m[2]:
            out.append((m[2], stack.pop().start(), m.start(), m.end()))
    return out


def text_area(src):
    options, margin = [], 25.4
    if m := re.search(r"\\documentclass(?:\[([^\]]*)\])?\{", src):
        options = [o.strip() for o in (m[1] or "").split(",")]
    if m := re.search(r"\\(?:usepackage|RequirePackage)\[([^\]]*)\]\{geometry\}", src):
        pairs = dict(o.split("=") for o in re.sub(r"\s", "", m[1]).split(",") if "=" in o)
        sides = [length(v, MM) for k, v in pairs.items() if k in ("top", "bottom", "left", "right")]
        margin = length(pairs["margin"], MM) if "margin" in pairs else min(sides, default=25.4)
    w, h = next((PAPERS[o] for o in options if o in PAPERS), PAPERS["letterpaper"])
    return max(w - 2 * margin, 20), max(h - 2 * margin, 20)


def hygiene(src):
    """(line, kind) for each broken rule."""
    out, code_lines = [], [re.sub(r"(?<!\\)%.*", "", x) for x in src.split("\n")]
    code = "\n".join(code_lines)
    line = lambda text, at: text[:at].count("\n") + 1

    def every(kind, pattern, text=code, test=lambda m: True, flags=0):
        out.extend((line(text, m.start()), kind) for m in re.finditer(pattern, text, flags) if test(m))

    every("dollar_math", r"\$\$.+?\$\$", flags=re.S)
    every("manual_pagebreak", r"\\(newpage|clearpage|pagebreak)\b")
    every("manual_vspace", r"\\vspace\*?\s*\{|\\(medskip|bigskip|smallskip)\b")
    every("underline_abuse", r"\\underline\s*\{")
    every("noindent", r"\\noindent\b")
    every("unbreakable", r"[A-Za-z]{80,}")
    size = r"\\(" + "|".join(SIZES) + r")\b"
    begin = re.search(r"\\begin\{document\}", code)
    every("size_switch", size, test=lambda m: m.start() >= (begin.end() if begin else 0))
    too_large = lambda text, cap: [m for m in re.finditer(size, text) if SIZES.index(m[1]) > SIZES.index(cap)]
    levels = "(chapter|section|subsection|subsubsection)"
    for m in [*re.finditer(r"\\titleformat\*?\s*\{\s*\\" + levels + r"\s*\*?\s*\}", code), *re.finditer(r"\\" + levels + r"font\s*(?=\{)", code)]:
        if got := braced(code, m.end()):
            out += [(line(code, m.start()), "heading_size") for _ in too_large(got[0], CAPS[m[1]])]
    for m in re.finditer(r"\\begin\{(itemize|enumerate|description)\}\s*\[([^\]]*)\]", code):
        for k, _, v in (o.partition("=") for o in m[2].split(",")):
            if k.strip() in ("itemsep", "topsep", "parsep", "partopsep") and (length(v, PT) or 0) > 8:
                out.append((line(code, m.start()), "list_spacing"))
    held = spans(code)
    exempt = {x for n, a, b, _ in held if n in ROWS for x in range(line(code, a), line(code, b) + 1)}
    for k, x in enumerate(code_lines, 1):
        if k not in exempt and re.search(r"\\\\\*?\s*(\[[^\]]*\])?\s*$", x):
            out.append((k, "hard_linebreak"))
        if re.search(r"(?i)START\s+READING\s+HERE|READ\s+ME\s+FIRST|document order was not finalized", x):
            out.append((k, "reading_aid"))
        if re.search(r"(?i)(?:^|[\s\\{])(?:\\?[a-zA-Z]*\{?){0,2}\s*(WARNING|CAUTION|ATTENTION)\s*:", x.strip()[:60]):
            out.append((k, "warning_box"))
    for n, a, b, _ in held:
        seg = code[a:b]
        if n == "center" and "\\includegraphics" not in seg and "\\caption" not in seg and sum(bool(x.strip()) for x in seg.split("\n")) > 3:
            out.append((line(code, a), "center_text"))
        if n in ("figure", "figure*", "table", "table*") and "\\caption" not in seg:
            out.append((line(code, a), "missing_caption"))
    if "\\usepackage{xurl}" not in src:
        every("long_url", r"\\(url|href|path)\s*\{\s*https?://\S{40,}")
    if (m := re.search(r"\\title\s*(?=\{)", src)) and (got := braced(src, m.end())):
        out += [(line(src, got[1] + x.start()), "title_size") for x in too_large(got[0], "LARGE")]
    if (m := re.search(r"\\setlength\s*\{\s*\\parskip\s*\}\s*\{([^}]*)\}", src)) and (length(m[1], PT) or 0) > 8:
        out.append((line(src, m.start()), "parskip"))
    for m in re.finditer(r"\\(lhead|rhead|chead|fancyhead(\s*\[[^\]]*\])?)\s*(?=\{)", src):
        if (got := braced(src, m.end())) and len(got[0].strip()) > 40:
            out.append((line(src, m.start()), "header_abnormal"))
    first, last = re.search(r"\\begin\{document\}", src), re.search(r"\\end\{document\}", src)
    if first:
        lo, hi = first.end(), last.start() if last else len(src)
        out += [(line(src, a), "multicols_mid") for n, a, _, b in spans(src) if n in ("multicols", "multicols*") and lo <= a < hi and b - a < 0.8 * max(hi - lo, 1)]
    wide, high = text_area(src)
    for m in re.finditer(r"\\includegraphics(?:\[([^\]]*)\])?\{", src):
        if x := re.search(r"(?:^|,)\s*height\s*=\s*([^,\]]+)", m[1] or ""):
            share = re.fullmatch(r"(\d*\.?\d+)\s*\\(textheight|paperheight|pageheight)", x[1].strip())
            mm = length(x[1].strip(), MM)
            if (float(share[1]) if share else (mm or 0) / high) > 0.4:
                out.append((line(src, m.start()), "fig_oversized"))
    for n, a, _, b in spans(src):
        w = [float(x[0]) for x in re.findall(r"\\begin\{(?:subfigure|subfloat|minipage)\}\s*\{(\d*\.?\d+)\s*\\(textwidth|linewidth|columnwidth)", src[a:b])]
        if n in ("figure", "figure*") and len(w) > 1 and round(sum(w), 9) > 0.95:
            out.append((line(src, a), "subfig_overfull"))
    for m in re.finditer(r"\\begin\{(tabular\*?|tabularx|longtable)\}", src):
        got = braced(src, m.end())
        w = [float(v) * MM[u] for v, u in re.findall(r"[pmb]\s*\{\s*(\d*\.?\d+)\s*(mm|cm|in|pt)\s*\}", got[0])] if got else []
        if w and sum(w) < 0.6 * wide:
            out.append((line(src, m.start()), "table_narrow"))
    own, inside = set(), False
    for k, x in enumerate(src.split("\n"), 1):
        inside |= "===== inserted" in x and "===== inserted end" not in x
        if inside:
            own.add(k)
        inside &= "===== inserted end" not in x
    return [x for x in out if x[0] not in own]


def _tables(text):
    out, at = "", 0
    for m in iter(lambda: re.compile(r"\\(begin|end)\{(tabularx|tabular\*?|longtable|array)\}").search(text, at), None):
        out += text[at : m.start()] + ("\\end{TAB}" if m[1] == "end" else "\\begin{TAB}{COLS}")
        at = m.end()
        while m[1] == "begin" and text[at : at + 1] in ("[", "{"):
            if text[at] == "[":
                at = text.index("]", at) + 1
            else:
                got = braced(text, at)
                at = got[1] + len(got[0]) + 1
    return out + text[at:]


def body(src):
    m = re.search(r"\\begin\{document\}(.*)\\end\{document\}", src, re.S)
    return m[1] if m else ""


def content(text):
    text = re.sub(r"% ===== inserted.*?% ===== inserted end[^\n]*\n?", "", text, flags=re.S)
    text = re.sub(r"\\tableofcontents\s*(?:\\(?:newpage|clearpage))?", "", text)
    text = re.sub(r"(\\begin\{(figure|table)\*?\})(\[[^\]]*\])?", r"\1", text)
    text = re.sub(r"(width|height)\s*=\s*[^,\]]+", "width=W", text)
    text = re.sub(r"\{\s*\d*\.?\d+\s*\\(textwidth|linewidth|columnwidth|textheight|paperheight|hsize)\s*\}", "{LEN}", text)
    text = re.sub(r"\$\$.+?\$\$|\\\[.+?\\\]", "MATH", text, flags=re.S)
    text = re.sub(r"\\(newpage|clearpage|pagebreak)\*?(\s*\[[^\]]*\])?", "", text)
    text = re.sub(r"\\vspace\*?\{[^}]*\}", "", text)
    text = re.sub(r"\\(" + "|".join(SIZES) + r")\b", "", text).replace("\\-", "")
    text = re.sub(r"\\begin\{multicols\*?\}(\s*\[[^\]]*\])?(\s*\{[^}]*\})?|\\end\{multicols\*?\}", "", text)

    def kept(m):
        left = [o for o in m[2].split(",") if o.strip() and o.split("=")[0].strip() not in ("itemsep", "topsep", "parsep", "partopsep")]
        return m[1] + (f"[{','.join(left)}]" if left else "")

    return _tables(re.sub(r"(\\begin\{(?:itemize|enumerate|description)\})\s*\[([^\]]*)\]", kept, text))


def wording(text):
    text = content(re.sub(r"(?<!\\)%.*", "", text)).replace("\\underline", "\\emph")
    text = re.sub(r"\\vspace\*?\{[^}]*\}|\\(newpage|clearpage|pagebreak|noindent)\b", "", text)
    text = re.sub(r"\\(begin|end)\{center\}", "", re.sub(r"\\(" + "|".join(SIZES) + r")\b", "", text))
    text = re.sub(r"\\\\\s*(\[[^\]]*\])?", "", _tables(text)).replace("\\-", "")
    text = re.sub(r"\\(hfill|break)\b", "", text).replace("{}", "")
    return re.sub(r"[ \t\n\x0b\f\r]+", "", text)


def floats(src):
    src, out = re.sub(r"(?<!\\)%.*", "", src), []
    for m in re.finditer(r"\\begin\{((?:figure|table)\*?)\}.*?\\end\{\1\}", src, re.S):
        x = re.sub(r"(width|height)\s*=\s*[^,\]]+", "LEN=W", m[0])
        x = re.sub(r"\{\s*\d*\.?\d+\s*\\(textwidth|linewidth|columnwidth|textheight|paperheight|hsize)\s*\}", "{LEN}", x)
        x = _tables(re.sub(r"(\\begin\{(?:figure|table)\*?\})\[[^\]]*\]", r"\1", x))
        out.append(re.sub(r"[ \t\n\x0b\f\r]+", " ", x).strip(" "))
    return out


def degraded(src):
    """The source at levels 0 to 4."""
    out = [src]
    for text in ("\\vspace{3cm}\n", "\\newpage\n"):
        places = [m.start() for m in re.finditer(r"\\section\*?\{", out[-1])]
        out.append(out[-1][: places[1]] + text + out[-1][places[1] :] if len(places) > 1 else out[-1])
    x, n = re.subn(r"(\\begin\{(?:figure|table)\*?\})\s*\[[^\]]*\]", r"\1[H]", out[-1])
    if n and "\\usepackage{float}" not in x and "\\usepackage{placeins}" not in x:
        m = re.search(r"\\usepackage(\[[^\]]*\])?\{[^}]*\}", x)
        x = x[: m.end()] + "\n\\usepackage{float}" + x[m.end() :] if m else x.replace("\\begin{document}", "\\usepackage{float}\n\\begin{document}", 1)
    out.append(x)
    m = re.search(r"\\includegraphics\s*\[[^\]]*\]", x)
    out.append(x[: m.start()] + "\\includegraphics[width=1.25\\linewidth]" + x[m.end() :] if m else x)
    return out


def inventory(src):
    """(line, kind, starred, spec, width, too wide) of floats and figures with a width."""
    out = []
    for m in re.finditer(r"\\begin\{(figure|table)(\*?)\}(?:\[([^\]]*)\])?|\\includegraphics(?:\[([^\]]*)\])?\{", src):
        line = src[: m.start()].count("\n") + 1
        if m[1]:
            out.append((line, m[1], bool(m[2]), (m[3] or "").strip() or None, None, None))
        elif w := re.search(r"width\s*=\s*([^,\]]+)", m[4] or ""):
            mm, share = length(w[1].strip(), MM), re.fullmatch(r"(\d*\.?\d+)\s*\\(linewidth|textwidth|columnwidth|hsize)", w[1].strip())
            out.append((line, "graphic", False, None, w[1].strip(), mm > 160 if mm is not None else bool(share) and float(share[1]) > 1))
    return out
