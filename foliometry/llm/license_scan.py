"""License scan: Aho-Corasick finds notice phrases and identifier tags; a shunting-yard parser evaluates expressions.

One automaton holds all phrases and the tag's words, and runs once over each text's words (A-Z lower-cased, joined by
one blank). Where the tag is met, the rest of its line is parsed: ids joined by AND, OR and WITH, with parentheses. The
expression's value says whether the text may be used under a set of allowed licenses: OR needs one side, AND both, WITH
needs its license.

Tasks read Arrow batches; nothing is shuffled or gathered.

Defined results: a null text counts as empty: no words, empty labels, score 0; a malformed expression gives no label and
no value and is listed as it stands; repeated rows are scanned alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliometry.llm.common import LOWER, UPPER, slices

#: The contract's phrases and labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: More notice phrases of this method.
MORE = {
    "bsd license": "bsd", "mozilla public license": "mpl", "lesser general public license": "lgpl", "affero general public license": "agpl",
    "isc license": "isc", "eclipse public license": "epl", "creative commons": "cc", "boost software license": "bsl", "public domain dedication": "cc0",
}
TAG = "spdx license identifier"
TAG_LINE = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\n]*)", re.IGNORECASE)
#: What may be used: ids by their first part.
ALLOWED = frozenset({"mit", "apache", "bsd", "isc", "cc0", "cc", "unlicense", "zlib", "bsl"})
SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())),
     ("labels", pa.list_(pa.string())), ("score", pa.float64()), ("expressions", pa.list_(pa.string())), ("usable", pa.bool_())]
)
RANK = {"or": 1, "and": 2, "with": 3}
#: Bytes that end a word become blanks; A-Z are lower-cased.
_WORD_BYTES = bytes(b if b >= 128 or chr(b).isdigit() or chr(b) in LOWER else ord(chr(b).lower()) if chr(b) in UPPER else 32 for b in range(256))


class Malformed(ValueError):
    pass


def to_postfix(expression: str) -> list[str]:
    """Shunting yard: ids and operators in postfix order; WITH binds closest, then AND, then OR."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # what must come next
    for token in re.findall(r"[()]|[^\s()]+", expression):
        low = token.lower()
        if low == "(" and operand:
            stack.append("(")
        elif low == ")" and not operand:
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise Malformed(expression)
            stack.pop()
        elif low in RANK and not operand:
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        elif operand and low not in RANK and low not in "()" and re.fullmatch(r"[a-z0-9][a-z0-9.+:-]*", low):
            out.append(low)
            operand = False
        else:
            raise Malformed(expression)
    if operand or "(" in stack:
        raise Malformed(expression)
    return out + stack[::-1]


def evaluate(postfix: list[str], allowed: frozenset[str] = ALLOWED) -> tuple[bool, list[str]]:
    """Whether the expression can be met with allowed licenses, and the license ids in it (without exceptions)."""
    stack: list[tuple[bool, list[str]]] = []
    for token in postfix:
        if token not in RANK:
            family = re.split(r"[-+.]", token)[0]
            stack.append((family in allowed and "-nc" not in token and "-nd" not in token, [token]))
            continue
        (right, right_ids), (left, left_ids) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left, left_ids))
        else:
            stack.append((left or right if token == "or" else left and right, left_ids + right_ids))
    return stack[0]


def label_of(license_id: str) -> str:
    return re.sub(r"-(\d[\w.]*|only|or-later|clause)|\+$", "", license_id)


@cache
def _automaton() -> Any:
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in [*BASE, *MORE, TAG]:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan_text(text: str | None) -> dict[str, Any]:
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()
    words = f" {b' '.join(raw).decode('utf-8', 'surrogatepass')} "
    starts, base, labels, tag, at, word = [], set(), set(), False, 0, -1
    for end, phrase in _automaton().iter(words):
        if phrase in BASE:
            begin = end - len(phrase) - 1
            # the blanks up to the phrase give its word number; hits come by end, so a start may lie before the last
            word = word + words.count(" ", at, begin + 1) if begin + 1 >= at else word - words.count(" ", begin + 1, at)
            at = begin + 1
            starts.append(word)
            base.add(BASE[phrase])
        elif phrase == TAG:
            tag = True
        else:
            labels.add(MORE[phrase])
    expressions, values = [], []
    for m in TAG_LINE.finditer(text or "") if tag else ():
        expression = re.sub(r"[*/>#.;,-]*\s*$", "", m[1].strip())
        expressions.append(expression)
        try:
            value, ids = evaluate(to_postfix(expression))
        except Malformed:
            continue
        values.append(value)
        labels.update(map(label_of, ids))
    score = 1.0 if values else 0.9 if base else 0.7 if labels else 0.2 if tag else 0.0
    return {
        "n_words": len(raw), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": sorted(base),
        "labels": sorted(base | labels), "score": score, "expressions": expressions, "usable": all(values) if values else None,
    }


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: word counts and places of base phrases, label lists, score, expressions and their value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [{"doc_id": i, **scan_text(t)} for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, expressions array<string>, usable boolean"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def query(docs: DataFrame) -> DataFrame:
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
