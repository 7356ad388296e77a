"""Personal data by candidate gradient boosting.

High-recall generators propose spans that may overlap: the base patterns of the four kinds, and looser ones (spelled-out
or spaced `@` and dots, defanged addresses, dotted or spaced groups of digits, local phone numbers, long digit runs).
Boosted trees score each candidate of a kind from format features (lengths, digits, groups, separators, checksums,
octets) and context features (words nearby, neighbouring characters, place in the line).

There are no hand labels for personal data, so examples are planted: into a sample of texts, the forms that the base
rules do not know are written as positives, and look-alikes (versions, dates, order numbers, failed checksums, handles,
amounts) as negatives; the candidates that the sampled texts have of their own, beyond the base spans, are negatives too.
Cue words stand before some of either. A threshold per kind is calibrated on the candidates of held-out texts, so that
PRECISION of those above it are planted positives; if that can't be had, no candidate of the kind is added. Base spans
always stay; an added span overlaps no base span and no other span of its kind, the best score goes first.

Fitting uses about FIT_TEXTS texts, chosen by a hash of the id, and FIT_CHARS of each: the bound of what reaches the
driver. All else covers every text whole.

Cases: null and empty texts have no spans. Ties of score go to the earlier and longer span. Repeated rows are searched
row by row. With too few candidates to fit on, only base spans are given. Empty tables give empty results. Other columns
of the input are not read and are not returned; redact keeps all columns.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerf.llm.common import id_and_text

KINDS = ("email", "ip", "card", "phone")
#: The bounds of the fitting sample: texts, and characters of each.
FIT_TEXTS = 3000
FIT_CHARS = 4000
PRECISION = 0.98
LEAST_CANDIDATES = 60

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?)[A-Za-z0-9-]{1,63}){0,8}"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,4}(?:(?:[.]|\[[.]\]|\([.]\))[0-9]{1,4}){2,5}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9]{2,6}(?:[\x20.-]?[0-9]{2,6}){2,7}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])(?:\+|00|\()?[0-9]{1,4}[)\x20.-]{0,2}(?:\(?[0-9]{2,4}\)?[\x20.-]?){2,5}(?![0-9])"),
}
#: Words that may stand near personal data, one feature each.
CUES = ("mail", "contact", "ip", "host", "server", "card", "visa", "pay", "phone", "tel", "call", "fax", "id", "token", "version", "order")
HINT = re.compile(r"[0-9@]|\(at\)|\[at\]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches without overlap, in time linear in the text: the domain is tried once for each `@`."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return out


def ip_ok(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    out["ip"] = [m.span() for m in IP.finditer(text) if ip_ok(m.group())]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int, bool]]:
    """kind, start, end and whether the base rule accepts the span."""
    out = []
    for kind in KINDS:
        own = set(base[kind])
        loose = {(m.start(), m.start() + len(m.group().rstrip(" .-("))) for m in LOOSE[kind].finditer(text)}
        strict = {"ip": IP, "card": CARD, "phone": PHONE}.get(kind)
        if strict:
            loose |= {m.span() for m in strict.finditer(text) if m.end() - m.start() <= 80}
        out += [(kind, s, e, (s, e) in own) for s, e in sorted(loose | own)]
    return out


def describe(text: str, start: int, end: int) -> list[float]:
    s = text[start:end]
    groups = re.findall(r"[0-9]+", s)
    sizes = [len(g) for g in groups] or [0]
    digits = "".join(groups)
    before, after = text[max(0, start - 40) : start].lower(), text[end : end + 12].lower()
    form = [len(s), len(digits), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1], s.count("."), s.count("-"), s.count(" "), s.count("("), s.count("["), s.count("@"), s.count("+")]
    form += [float(s[0] == "+"), float(s[0] == "("), float(s.startswith("00")), float("(at)" in s or "[at]" in s), float("(dot)" in s or "[dot]" in s), float("[.]" in s or "(.)" in s), len(re.split(r"[.]|dot", s)[-1].strip(" )]"))]
    form += [float(13 <= len(digits) <= 19 and luhn(digits)), max((int(g[:6]) for g in groups), default=-1), int(groups[0][:6]) if groups else -1, float(any(c.isalpha() for c in s))]
    near = [float(before[-1:].isspace() or not before), float(before[-1:].isalnum()), float(after[:1].isspace() or not after), float(after[:1].isalnum()), float("=" in before[-4:] or ":" in before[-4:]), float("@" in after[:2])]
    return form + near + [float(c in before) for c in CUES]


def planted(r: random.Random) -> list[tuple[str, str, bool]]:
    """For each kind a form that the base rule does not know (True), and a look-alike (False)."""
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
    name, site, top = r.choice([w(), f"{w()}.{w()}", f"{w()}{n(2)}"]), r.choice([w(), f"{w()}-{w()}", f"{w()}{n(1)}"]), r.choice(["com", "org", "net", "de", "fr", "es", "io", "info"])
    at, dot = r.choice([" (at) ", "(at)", " [at] ", "[at]", " @ "]), r.choice([".", " (dot) ", "(dot)", "[dot]"])
    out = [("email", f"{name}{at}{site}{dot}{top}", True)]
    out.append(("email", r.choice([f"{w()}@{w()}", f"{n(2)} @ {n(3)}", f"{w()} @ {n(2)}.{n(2)}", f"{w()} @ {w()}", f"{n(1)}@{n(2)}.{n(2)}"]), False))
    octets = [str(r.randint(0, 255)) for _ in range(4)]
    out.append(("ip", r.choice(["[.]", "(.)"]).join(octets), True))
    out.append(("ip", r.choice([f"{n(1)}.{n(1)}.{n(2)}", f"{r.randint(10, 31)}.{r.randint(10, 12)}.20{n(2)}", f"{n(1)}.{n(1)}.{n(1)}.{n(1)}.{n(2)}", f"{r.randint(300, 999)}.{n(2)}.{n(2)}.{n(1)}", "[.]".join([str(r.randint(300, 999)), n(2), n(1)])]), False))
    body = r.choice("3456") + n(14)
    card = next(body + c for c in "0123456789" if luhn(body + c))
    wrong = body + r.choice([c for c in "0123456789" if not luhn(body + c)])
    cut = lambda x, sep: sep.join(x[i : i + 4] for i in range(0, 16, 4))
    out.append(("card", cut(card, "."), True))
    out.append(("card", r.choice([cut(wrong, "."), wrong, cut(wrong, " "), f"1.{n(3)}.{n(3)}.{n(3)}.{n(3)}", n(12)]), False))
    area, mid, last = r.choice("23456789") + n(2), n(3), n(4)
    out.append(("phone", r.choice([f"({area}) {mid}-{last}", f"{area}-{mid}-{last}", f"{area}.{mid}.{last}", f"00{r.choice(['49', '33', '34', '44'])} {n(2)} {n(3)} {n(4)}", f"0{n(2)} {n(3)} {n(4)}"]), True))
    out.append(("phone", r.choice([f"20{n(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"19{n(2)}-20{n(2)}", n(16), n(7), f"{n(2)} {n(2)} {n(2)}", f"{r.randint(10, 28)}.{r.randint(10, 12)}.19{n(2)}", f"{n(1)}.{n(3)}.{n(3)}"]), False))
    return out


#: Words written before planted examples: of personal data, of look-alikes, and of either.
PLANT_CUES = {True: ["mail", "contact", "ip", "host", "card", "visa", "phone", "tel", "call"], False: ["version", "order", "id", "total", "on", "page", "serial"]}


def examples(text: str) -> list[tuple[str, bool, list[float]]]:
    """kind, label and features of the candidates of a text (FIT_CHARS of it) with examples planted between its words."""
    r = random.Random(hashlib.sha256(text.encode()).hexdigest())
    start = r.randrange(max(1, len(text) - FIT_CHARS))
    words = text[start : start + FIT_CHARS].split(" ")
    marks: dict[int, list[tuple[str, str, bool]]] = {}
    for x in planted(r):
        marks.setdefault(r.randrange(len(words) + 1), []).append(x)
    out, put, at = [], [], 0
    for i in range(len(words) + 1):
        for kind, form, label in marks.get(i, []):
            if r.random() < (0.5 if label else 0.3):
                cue = r.choice(PLANT_CUES[label if r.random() < 0.8 else not label]) + r.choice([" ", ": "])
                out.append(cue[:-1])
                at += len(cue)
            out.append(form)
            put.append((kind, at, at + len(form), label))
            at += len(form) + 1
        if i < len(words):
            out.append(words[i])
            at += len(words[i]) + 1
    whole = " ".join(out)
    base = base_spans(whole)
    fixed = [x for k in KINDS for x in base[k]]
    rows = []
    for kind, s, e, ok in candidates(whole, base):
        if ok or any(s < b and a < e for a, b in fixed):
            continue
        near = [(a, b) for k, a, b, label in put if label and s < b and a < e]
        exact = any(k == kind and label and (a, b) == (s, e) for k, a, b, label in put)
        # Parts of a planted positive, and it under other kinds, are neither.
        if exact or not near:
            rows.append((kind, exact, describe(whole, s, e)))
    return rows


@dataclass
class Trees:
    """Boosted regression trees of fixed depth on binned features: logistic loss, Newton leaf values."""

    cuts: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    start: float = 0.0
    depth: int = 3

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1).astype(np.int16)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.2, ridge: float = 1.0, most_bins: int = 32) -> Trees:
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, most_bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self.bins(x)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.start)
        for _ in range(rounds):
            prob = 1 / (1 + np.exp(-f))
            g, h = y - prob, prob * (1 - prob)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, 999, np.int64)
            for level in range(self.depth):
                width = 2**level
                best_gain = np.full(width, 1e-6)
                for j in range(b.shape[1]):
                    n = len(self.cuts[j]) + 1
                    at = (node * n + b[:, j]).astype(np.int64)
                    gs, hs = (np.bincount(at, v, width * n).reshape(width, n).cumsum(axis=1) for v in (g, h))
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(width), k]
                    better = top > best_gain
                    best_gain[better] = top[better]
                    feature[width - 1 + np.flatnonzero(better)] = j
                    cut[width - 1 + np.flatnonzero(better)] = k[better]
                own = width - 1 + node
                node = node * 2 + (b[np.arange(len(y)), feature[own]] > cut[own])
            gs, hs = np.bincount(node, g, 2**self.depth), np.bincount(node, h, 2**self.depth)
            leaf = rate * gs / (hs + ridge)
            self.trees.append((feature, cut, leaf))
            f += leaf[node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        b, f = self.bins(x), np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                own = 2**level - 1 + node
                node = node * 2 + (b[rows, feature[own]] > cut[own])
            f += leaf[node]
        return 1 / (1 + np.exp(-f))


def fit_kind(x: np.ndarray, y: np.ndarray, text_no: np.ndarray) -> tuple[Trees, float] | None:
    """Trees and threshold (even odds at least) of one kind; None if there is too little to learn from or no threshold is
    precise enough."""
    hold = text_no % 3 == 0
    if min((y == 1).sum(), (y == 0).sum()) < 10 or len(y) < LEAST_CANDIDATES or len(set(y[hold])) < 2 or len(set(y[~hold])) < 2:
        return None
    trees = Trees().fit(x[~hold], y[~hold])
    p, t = trees.score(x[hold]), y[hold]
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(t[order]) / np.arange(1, len(t) + 1)
    last = np.append(p[order][1:] != p[order][:-1], True)
    good = np.flatnonzero((right >= PRECISION) & last)
    return (trees, max(0.5, float(p[order][good[-1]]))) if len(good) and good[-1] >= 20 else None


def fit_pii(docs: DataFrame, fit_texts: int = FIT_TEXTS) -> dict[str, tuple[Trees, float]]:
    """Trees and threshold of each kind, from examples planted into about fit_texts texts of docs."""
    own = id_and_text(docs).where("text <> ''")
    share = int(min(1.0, fit_texts / max(1, own.count())) * 2**31)
    sample = own.where(F.pmod(F.xxhash64(F.lit("pii"), "doc_id"), F.lit(2**31)) < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, no, label, x = [], [], [], []
            for text in batch.column(1).to_pylist():
                code = int.from_bytes(hashlib.sha256(text.encode()).digest()[:4], "big")
                for k, y, features in examples(text):
                    kind.append(KINDS.index(k))
                    no.append(code)
                    label.append(y)
                    x.append(features)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(no, pa.int64()), pa.array(label, pa.bool_()), pa.array(x, pa.list_(pa.float32()))], names=["kind", "no", "ok", "x"])

    got = sample.mapInArrow(run, "kind int, no long, ok boolean, x array<float>").toArrow()
    kind, no, ok = (got.column(c).to_numpy() for c in ("kind", "no", "ok"))
    x = got.column("x").combine_chunks().flatten().to_numpy().astype(float).reshape(len(kind), -1 if len(kind) else 1)
    order = np.lexsort((*x.T, ok, no, kind)) if len(kind) else np.empty(0, int)
    kind, no, ok, x = kind[order], no[order], ok[order].astype(float), x[order]
    models = {k: fit_kind(x[kind == i], ok[kind == i], no[kind == i]) for i, k in enumerate(KINDS)}
    return {k: m for k, m in models.items() if m}


def find_spans(text: str, models: dict[str, tuple[Trees, float]]) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans, and all spans: base and added, by kind and in order."""
    if not HINT.search(text):
        empty: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        return empty, empty
    base = base_spans(text)
    every = {k: list(v) for k, v in base.items()}
    fixed = [x for k in KINDS for x in base[k]]
    more = [c for c in candidates(text, base) if not c[3] and c[0] in models and all(c[2] <= a or b <= c[1] for a, b in fixed)]
    for kind in {c[0] for c in more}:
        trees, least = models[kind]
        own = [c for c in more if c[0] == kind]
        p = trees.score(np.array([describe(text, s, e) for _, s, e, _ in own]))
        for i in sorted(range(len(own)), key=lambda i: (-p[i], own[i][1], -own[i][2])):
            s, e = own[i][1:3]
            if p[i] >= least and all(e <= a or b <= s for a, b in every[kind]):
                every[kind].append((s, e))
    return base, {k: sorted(v) for k, v in every.items()}


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in spans[k])


def redacted(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each stretch that spans cover replaced by the kind of the first of them, in angle brackets."""
    out, at, reach = [], 0, 0
    for s, e, k in sorted((s, e, k) for k in KINDS for s, e in spans[k]):
        if s >= reach:
            out += [text[at:s], f"<{k.upper()}>"]
        reach = max(reach, e)
        at = reach
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, models: dict[str, tuple[Trees, float]] | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added and redacted of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_pii(docs) if models is None else models)
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added", "redacted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, every = find_spans(text or "", shared.value)
                n = [len(base[k]) for k in KINDS]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), sum(map(len, every.values())) - sum(n), redacted(text, every) if text else text))
            columns = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=names)

    own = id_and_text(docs)
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, redacted string")


def redact(docs: DataFrame, models: dict[str, tuple[Trees, float]] | None = None) -> DataFrame:
    """docs with the spans found in text replaced by their kind; all columns kept, null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_pii(docs) if models is None else models)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [redacted(t, find_spans(t, shared.value)[1]) if t else t for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
