"""Personal data: fixed patterns, and a linear-chain conditional random field over word-shape features.

The patterns give the base spans. The field is trained from a small labelled table (texts with marked spans; LABELLED by
default) and adds spans that no pattern gives, such as two card numbers side by side, phone numbers without a country
code, or keys and tokens. Its words are what blanks separate. A word without a digit or @ is outside by construction,
which cuts the chain there: only runs of the other words are decoded, as numpy batches of runs over many texts at once.

Training happens on the driver over at most MOST_LABELLED rows of the table; the weights go out with the scoring function.
Tasks read Arrow batches; nothing is shuffled.

Defined results: a null text counts as empty and has no spans; offsets are code points, ends exclusive; added spans never
overlap base spans; repeated rows are scanned alike; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliometry.llm.common import slices

KINDS = ("email", "ip", "card", "phone", "secret")
MOST_LABELLED = 10_000
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
Span = tuple[int, int, int]  # kind's number, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The patterns' spans by kind, then start."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at) if begin < at else None
        if m:
            out.append((0, begin, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


#: The labelled table: marked spans stand in [kind:...]; values vary by rule.
_LINES = (
    "write to [email:{e}] or call [phone:{p}] today", "mail [email:{e}], thanks", "her address is <[email:{e}]>", "[email:{e}] wrote", "contact: [email:{e}].",
    "server [ip:{i}] is down", "from [ip:{i}], to [ip:{j}].", "host [ip:{i}] port 8080", "ping [ip:{i}] [ip:{j}] done", "version 1.2.3.4567 of it",
    "card [card:{c}] expires", "paid with [card:{c}] [card:{d}] twice", "number [card:{c}], code 123", "[card:{g}] is the card", "cards [card:{c}] [card:{d}] [card:{c}] and more",
    "order {x} shipped", "id {x} {y} in stock", "serial {x}.", "sum of {x} and {y} is 77",
    "call [phone:{p}] now", "tel. [phone:{q}] or [phone:{r}].", "phone [phone:{r}] at noon", "[phone:{q}]", "ring [phone:{p}] [card:{c}] please", "[card:{c}] [phone:{p}] both", "fax [phone:{r}], office 12",
    'token = "[secret:{h}]" here', "api_key = [secret:{h}]", 'password = "[secret:{k}]"', "secret: [secret:{k}] end", 'token = "[secret:{h}]" [card:{c}] text',
    "in 2024 there were 12 of 345 cases", "pages 10-12 and 13", "at 10:30 on 2024-05-06", "a ratio of 3.14 to 2.72", "room 101, floor 3", "about 1,250,000 people", "chapter 7.2.1 says", "1990-1995 and 2001", "x1 y2 z3",
    "15% of 200", "born 12.05.1987 there", "item 4711 costs 19.99", "the 3rd of 4th", "no numbers in this line at all", "iso 9001 and rfc 2616", "a4 b5 c6 paper", "0 1 2 3 4 5", "e = 2.71828 and @home or @ home",
)


def _card(n: int, size: int = 16, valid: bool = True) -> str:
    body = str(10**30 + n * 7919 * 104729 * 15485863 % 10**30)[1:size]
    good = next(d for d in "0123456789" if luhn(body + d))
    return body + (good if valid else str((int(good) + 1 + n % 9) % 10))


@cache
def labelled() -> tuple[str, ...]:
    """The default table of marked texts."""
    rows = []
    for n in range(1, 5):
        c = "4" + _card(n)[:14]
        c += next(d for d in "0123456789" if luhn(c + d))
        h = hashlib.sha1(str(n).encode()).hexdigest()
        values = {
            "e": f"{'abcd'[n - 1]}nn.lee{n * 7}@mail{n}.example.com", "i": f"{n * 37 % 255}.{n * 91 % 255}.{n}.{n * 53 % 255}", "j": f"10.{n}.0.{n * 11}", "c": c, "d": "5" + _card(n + 50, 15)[:14], "g": "-".join(c[k : k + 4] for k in (0, 4, 8, 12)),
            "x": _card(n + 9, 16, False), "y": _card(n + 70, 16, False), "p": f"+1 ({200 + n * 37}) 555-{1000 + n * 77}", "q": f"({200 + n * 37}) 555-{1000 + n * 77}", "r": f"{200 + n * 37}-555-{1000 + n * 77}", "h": h, "k": f"{h[:10].upper()}x{h[10:24]}Z9",
        }
        values["d"] += next(d for d in "0123456789" if luhn(values["d"] + d))
        rows += [line.format(**values) for line in _LINES]
    return tuple(rows)


WORD = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
TRIM = re.compile(r"^[\"'(<\[{]*(.*?)[\"'>\]}.,;:!?*%$#&|]*$", re.DOTALL)
PREVIOUS = re.compile(r"(\S+)\s*\Z")
CUES = {
    "token": "key", "=": "sign", "api_key": "key", "password": "key", "secret": "key", "secret:": "key", "key": "key", "call": "call", "phone": "call", "tel": "call", "tel.": "call", "ring": "call", "fax": "call", "card": "card", "cards": "card",
}


def features(word: str, before: str) -> tuple[str, ...]:
    """Shape features of a word that holds a digit or @; before: the word before it, empty at the start."""
    m = TRIM.match(word)
    w = (m[1] if m else word) or word
    shape = re.sub(r"(.)\1+", r"\1+", re.sub(r"[a-z]", "x", re.sub(r"[A-Z]", "X", re.sub(r"[0-9]", "d", re.sub(r"[^\x00-\x7f]", "u", w[:64])))))
    digits = _digits(w)
    n = len(digits)
    size = next(k for k in (0, 1, 3, 4, 6, 8, 12, 19, 1 << 60) if n <= k)
    out = ["bias", f"n{size}", f"s{shape[:10]}", f"b{CUES.get(before.lower().strip(chr(34)), 'digit' if any(map(str.isdigit, before)) else 'word')}"]
    if "@" in w:
        out.append("mail" if re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", w) else "at")
    parts = w.split(".")
    if len(parts) == 4 and all(p.isdigit() for p in parts):
        out.append("ip" if all(len(p) < 4 and int(p) <= 255 for p in parts) else "notip")
    if 13 <= n <= 19 and len(w.replace("-", "")) == n:
        out.append("luhn" if luhn(digits) else "noluhn")
    if re.fullmatch(r"\(?[0-9]{3}\)?[-.][0-9]{3}[-.][0-9]{4}|[0-9]{3}[-.][0-9]{4}", w):
        out.append("phone")
    if re.fullmatch(r"\+[0-9]{1,3}|\([0-9]{2,4}\)|\([0-9]{2,4}", w):
        out.append("prefix")
    if len(w) >= 20 and re.fullmatch(r"[A-Za-z0-9_-]+", w) and n < len(w):
        out.append("key")
    return tuple(out)


LABELS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
NEVER = -1e9


def runs(text: str) -> list[list[tuple[int, int, tuple[str, ...]]]]:
    """Runs of neighbouring words with a digit or @: start, end and features of each word."""
    out: list[list[tuple[int, int, tuple[str, ...]]]] = []
    last = -1
    before = ""
    for m in WORD.finditer(text):
        start, end = m.span()
        joined = out and text[last:start].isspace()
        if not joined:
            p = PREVIOUS.search(text, max(0, start - 40), start)
            before = p[1] if p else ""
            out.append([])
        out[-1].append((start, end, features(m[0], before)))
        last, before = end, m[0]
    return out


class Field:
    """A linear-chain conditional random field; the words around a run are outside."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray) -> None:
        self.names, self.weights, self.moves = names, weights, moves

    def emissions(self, chains: list[list[tuple[str, ...]]], length: int) -> np.ndarray:
        out = np.full((len(chains), length, len(LABELS)), NEVER)
        out[:, :, 0] = 0
        for k, chain in enumerate(chains):
            for t, found in enumerate(chain):
                out[k, t] = self.weights[[self.names[f] for f in found if f in self.names]].sum(axis=0)
        return out

    def decode(self, chains: list[list[tuple[str, ...]]]) -> list[np.ndarray]:
        """Viterbi over chains, in batches of similar length."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(chains)
        order = sorted(range(len(chains)), key=lambda k: len(chains[k]))
        while order:
            length = len(chains[order[-1]])
            some = max(1, 200_000 // max(1, length))
            batch, order = order[-some:], order[:-some]
            e = self.emissions([chains[k] for k in batch], length)
            best = self.moves[0] + e[:, 0]
            back = np.zeros((length, len(batch), len(LABELS)), np.int8)
            for t in range(1, length):
                ways = best[:, :, None] + self.moves[None]
                back[t] = ways.argmax(axis=1)
                best = ways.max(axis=1) + e[:, t]
            at = (best + self.moves[:, 0]).argmax(axis=1)
            path = np.zeros((len(batch), length), int)
            for t in range(length - 1, -1, -1):
                path[:, t] = at
                at = back[t][np.arange(len(batch)), at]
            for k, p in zip(batch, path, strict=True):
                out[k] = p[: len(chains[k])]
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _allowed() -> np.ndarray:
    """I-k follows B-k or I-k only."""
    ok = np.zeros((len(LABELS), len(LABELS)))
    for i, a in enumerate(LABELS):
        for j, b in enumerate(LABELS):
            if b[0] == "I" and a[2:] != b[2:]:
                ok[i, j] = NEVER
    return ok


def train(rows: list[str] | None = None, steps: int = 120, rate: float = 0.3, decay: float = 0.002) -> Field:
    """Maximum likelihood by Adam steps on the whole table; deterministic."""
    chains, gold = [], []
    for row in (labelled() if rows is None else rows)[:MOST_LABELLED]:
        text, spans = "", []
        for plain, kind, inside in re.findall(r"([^\[]+|\[(\w+):([^\]]*)\])", row):
            spans += [(kind, len(text), len(text) + len(inside))] * bool(kind)
            text += inside if kind else plain
        for run in runs(text):
            chains.append([w[2] for w in run])
            tags = []
            for start, end, _ in run:
                kind = next(((k, a) for k, a, b in spans if a < end and start < b), None)
                tags.append(0 if kind is None else LABELS.index(("B-" if start <= kind[1] else "I-") + kind[0]))
            gold.append(tags)
    names = {f: k for k, f in enumerate(sorted({f for c in chains for w in c for f in w}))}
    n, length, m = len(chains), max(map(len, chains)), len(LABELS)
    mask = np.zeros((n, length))
    x = np.zeros((n, length, len(names)))
    y = np.zeros((n, length), int)
    for k, (c, g) in enumerate(zip(chains, gold, strict=True)):
        for t, w in enumerate(c):
            mask[k, t], y[k, t] = 1, g[t]
            x[k, t, [names[f] for f in w]] = 1
    hot = np.eye(m)[y]
    field = Field(names, np.zeros((len(names), m)), np.zeros((m, m)))
    state = [np.zeros_like(field.weights), np.zeros_like(field.weights), np.zeros((m, m)), np.zeros((m, m))]
    hard = _allowed()
    edges_gold = np.einsum("ki,kj->ij", np.eye(m)[np.zeros(n, int)], hot[:, 0]) + sum(np.einsum("ki,kj->ij", hot[:, t - 1], hot[:, t]) for t in range(1, length))
    edges_gold += np.einsum("ki,kj->ij", hot[:, -1], np.eye(m)[np.zeros(n, int)])
    outside = np.full(m, NEVER)
    outside[0] = 0
    for step in range(1, steps + 1):
        moves = field.moves + hard
        e = np.where(mask[:, :, None] > 0, x @ field.weights, outside)
        alpha, beta = np.zeros((n, length, m)), np.zeros((n, length, m))
        alpha[:, 0] = moves[0] + e[:, 0]
        for t in range(1, length):
            alpha[:, t] = _log_sum(alpha[:, t - 1, :, None] + moves[None], 1) + e[:, t]
        beta[:, -1] = moves[:, 0]
        for t in range(length - 2, -1, -1):
            beta[:, t] = _log_sum(moves[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = _log_sum(alpha[:, -1] + moves[:, 0], 1)
        node = np.exp(alpha + beta - z[:, None, None])
        edges = np.zeros((m, m))
        edges[0] += node[:, 0].sum(axis=0)
        edges[:, 0] += node[:, -1].sum(axis=0)
        for t in range(1, length):
            edges += np.exp(alpha[:, t - 1, :, None] + moves[None] + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None]).sum(axis=0)
        down = [np.einsum("ktf,ktl->fl", x, (node - hot) * mask[:, :, None]) / n + decay * field.weights, (edges - edges_gold) / n + decay * field.moves]
        for k, (p, g) in enumerate(zip((field.weights, field.moves), down, strict=True)):
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * g
            state[2 * k + 1] = 0.99 * state[2 * k + 1] + 0.01 * g * g
            p -= rate * (state[2 * k] / (1 - 0.9**step)) / (np.sqrt(state[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
    field.moves = field.moves + hard
    return field


def added_spans(texts: list[str], base: list[list[Span]], field: Field) -> list[list[Span]]:
    """The field's spans of each text that no base span overlaps."""
    found = [runs(t) for t in texts]
    tags = iter(field.decode([[w[2] for w in run] for rs in found for run in rs]))
    out = []
    for text, own, rs in zip(texts, base, found, strict=True):
        spans: list[Span] = []
        for run in rs:
            for (start, end, _), tag in zip(run, next(tags), strict=True):
                if tag == 0:
                    continue
                m = TRIM.match(text[start:end])
                a, b = (start + m.start(1), start + m.end(1)) if m and m[1] else (start, end)
                if LABELS[tag][0] == "I" and spans:
                    spans[-1] = (spans[-1][0], spans[-1][1], b)
                else:
                    # an opening parenthesis belongs to a phone number
                    a = start + text[start:end].find("(") if LABELS[tag] == "B-phone" and "(" in text[start:a] else a
                    spans.append((KINDS.index(LABELS[tag][2:]), a, b))
        taken = sorted((a, b) for _, a, b in own)
        free, k = [], 0
        for s in sorted(spans, key=lambda s: s[1]):
            while k < len(taken) and taken[k][1] <= s[1]:
                k += 1
            if all(not (a < s[2] and s[1] < b) for a, b in taken[max(0, k - 3) : k + 3]):
                free.append(s)
        out.append(free)
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


SCHEMA = "doc_id long, base array<struct<kind:string,start:long,end:long>>, added array<struct<kind:string,start:long,end:long>>, base_text string, spans_text string"


def find(docs: DataFrame, field: Field | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its base and added spans, as arrays and as texts."""
    field = field or train()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("base", span), ("added", span), ("base_text", pa.string()), ("spans_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            added = added_spans(texts, base, field)
            shown = [[[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in s] for s in part] for part in (base, added)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(shown[0], span), pa.array(shown[1], span), pa.array(list(map(_joined, base)), pa.string()), pa.array([_joined(b + a) for b, a in zip(base, added, strict=True)], pa.string())], schema=schema
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def query(docs: DataFrame) -> DataFrame:
    def n(kind: str) -> F.Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find(docs).select("doc_id", *[n(k) for k in KINDS[:4]], F.sha2(F.col("base_text").cast("binary"), 256).alias("base_sha256"), F.col("spans_text").alias("spans"), F.size(F.array_union("base", "added")).cast("long").alias("n_spans"))
