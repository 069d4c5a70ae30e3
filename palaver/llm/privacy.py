"""Personal data: generators of many overlapping spans, boosted trees that judge them, calibrated thresholds."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import map_texts
from palaver.llm.planted import plant

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind, end

#: Fixed patterns of the base spans.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Wider patterns of the candidates, by kind.
_WIDE = {
    0: [re.compile(r"[\w.+-]{1,64}[ ]?(?:\(at\)|\[at\]|@)[ ]?[\w-]{1,64}(?:[ ]?(?:\.|\(dot\)|\[dot\])[ ]?[\w-]{2,24}){1,4}")],
    1: [re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")],
    2: [re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])"), re.compile(r"(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])"),
        re.compile(r"(?<![0-9])[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}(?![0-9])")],
    3: [re.compile(r"\+?[0-9]{1,3}[ .-]\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{4}(?![0-9])"), re.compile(r"\([0-9]{3}\)[ ]?[0-9]{3}[ -][0-9]{4}(?![0-9])")],
}
#: The parts after the host of a written-out address; every end is a candidate.
_HOST = re.compile(r".*?(?:\(at\)|\[at\]|@)[ ]?[\w-]+")
_DOT = re.compile(r"[ ]?(?:\.|\(dot\)|\[dot\])[ ]?[\w-]+")
#: Words shortly before a candidate that speak for a kind, or for a number of another sort.
_CUES = [re.compile(p) for p in (
    r"\b(?:e-?mail|write|contact|correo|courriel)\b", r"\b(?:ip|host|server|from|address|login)\b",
    r"\b(?:card|visa|master|amex|paid|karte|tarjeta|carte)\b", r"\b(?:tel|phone|call|mobile|cell|fax|reach|telefon|t[ée]l[ée]fono?|t[ée]l[ée]phone)\b",
    r"\b(?:order|invoice|version|release|isbn|ref|ticket|serial|section|date|batch|tracking|id|no|nr)\b")]
_YEAR = re.compile(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])")
_GROUP = re.compile(r"[0-9]+")
_BETWEEN = re.compile(r"[\x20().-]+")
FEATURES = 31


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def _ip_ok(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in text.split("."))


def _emails(text: str) -> list[tuple[int, int]]:
    """The leftmost matches, found from each @ so that the time is linear."""
    out, cursor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > cursor and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((start, found.end()))
            cursor = found.end()
        at = text.find("@", max(at + 1, cursor))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns that pass their tests, by start, then kind."""
    out: list[Span] = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _ip_ok(m.group())] if "." in text else []
    for m in _CARD.finditer(text):
        digits = _digits(m.group()) if m.end() - m.start() >= 14 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out)


def _phones(text: str) -> list[Span]:
    """From every group of digits, with a plus right before it, every end of a group that leaves 10 to 15 digits."""
    groups = [m.span() for m in _GROUP.finditer(text)]
    joined = [_BETWEEN.fullmatch(text, b, c) is not None for (_, b), (c, _) in zip(groups, groups[1:])] + [False]
    out = []
    for i, (start, _) in enumerate(groups):
        total = 0
        for j in range(i, len(groups)):
            total += groups[j][1] - groups[j][0]
            if 10 <= total <= 15:
                out.append((start - (text[start - 1:start] == "+"), 3, groups[j][1]))
            if total >= 15 or not joined[j]:
                break
    return out


def candidates(text: str) -> list[Span]:
    """Overlapping spans that might be personal data: the wide patterns, all phone ends and the base spans, each once."""
    out = {*base_spans(text), *_phones(text)}
    for kind, patterns in _WIDE.items():
        if kind == 0 and "@" not in text and "at)" not in text and "at]" not in text:
            continue
        for pattern in patterns:
            for m in pattern.finditer(text):
                out.add((m.start(), kind, m.end()))
                if kind == 0:
                    at = _HOST.match(m.group()).end()
                    while part := _DOT.match(m.group(), at):
                        at = part.end()
                        out.add((m.start(), kind, m.start() + at))
    return sorted(out)


def _kind_of(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3


def describe(text: str, span: Span) -> list[float]:
    """Format and context of a candidate as FEATURES numbers."""
    start, kind, end = span
    own = text[start:end]
    digits = _digits(own)
    before, after = text[start - 1:start], text[end:end + 1]
    parts = re.split(r"[^0-9]+", own.strip("+( )"))
    octets = [int(p) for p in own.split(".") if 0 < len(p) <= 9 and p.isascii() and p.isdigit()]
    context = text[max(0, start - 24):start].lower()
    near = context.rpartition("\n")[2]
    return [kind, len(own), len(digits), len(digits) / len(own), own.count("."), own.count("@"), own.count("-") + own.count(" "),
            float(len(digits) > 11 and luhn(digits)), float(own[:1] == "+"), float("(" in own), max(octets, default=0), len(octets),
            max(map(len, parts)), min(map(len, parts)), len(parts), _kind_of(before), _kind_of(after),
            float("=" in context or '"' in context[-2:]), len(own.rpartition(".")[2]),
            *[float(cue.search(near) is not None) for cue in _CUES], float(_YEAR.search(own) is not None),
            float("at)" in own or "at]" in own or "@" in own), float(own[:1] == "0"),
            own.count("(") - own.count(")"), float(before in ("(", "+")), _kind_of(text[max(0, start - 2):start][:-1]), _kind_of(text[end + 1:end + 2])]


@dataclass
class Boosted:
    """Trees of depth three on binned features, each a list of (feature, cut) per inner node and a value per leaf."""

    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(3):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - 7]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3, smooth: float = 1.0) -> Boosted:
        """Newton boosting of the logistic loss with cuts at up to 32 quantiles of each feature."""
        rate_of = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        model = cls(float(np.log(rate_of / (1 - rate_of))))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(x.shape[1])]
        margin = np.full(len(y), model.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            feature, cut, leaf = np.zeros(7, np.int64), np.full(7, np.inf), np.zeros(8)
            node = np.zeros(len(y), np.int64)
            for inner in range(7):
                mine = np.flatnonzero(node == inner) if inner else np.arange(len(y))
                best = 1e-9
                for j, values in enumerate(cuts):
                    if not len(mine):
                        break
                    b = np.searchsorted(values, x[mine, j], side="left")
                    gs = np.cumsum(np.bincount(b, g[mine], minlength=len(values) + 1))
                    hs = np.cumsum(np.bincount(b, h[mine], minlength=len(values) + 1))
                    gain = gs[:-1] ** 2 / (hs[:-1] + smooth) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + smooth) - gs[-1] ** 2 / (hs[-1] + smooth)
                    if len(gain) and gain.max() > best:
                        best, feature[inner], cut[inner] = float(gain.max()), j, values[int(gain.argmax())]
                node[mine] = 2 * inner + 1 + (x[mine, feature[inner]] > cut[inner])
            gl, hl = np.bincount(node - 7, g, minlength=8), np.bincount(node - 7, h, minlength=8)
            leaf[:] = rate * gl / (hl + smooth)
            margin += leaf[node - 7]
            model.trees.append((feature, cut, leaf))
        return model


@dataclass
class PrivacyModel:
    trees: Boosted
    thresholds: tuple[float, ...]

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """(base spans, all spans): every base span, then the likeliest candidates over the threshold that overlap none
        chosen, phones last, because one may run into the digits after it; of equally likely phones the longest."""
        base = base_spans(text)
        known = set(base)
        rest = [c for c in candidates(text) if c not in known]
        if not rest:
            return base, base
        chance = self.trees.probability(np.array([describe(text, c) for c in rest]))
        likely = [(-p, span) for p, span in zip(chance.tolist(), rest) if p >= self.thresholds[span[1]]]
        likely.sort(key=lambda x: (x[1][1] == 3, x[0], x[1][0], -x[1][2]))
        return base, sorted(base + without_overlaps(base, [span for _, span in likely]))


def without_overlaps(taken: list[Span], ordered: list[Span]) -> list[Span]:
    """The spans that overlap neither ``taken`` nor an earlier one of their own; each looks at its two neighbours only."""
    starts, ends, out = [], [], []  # what is covered, as rising ranges that do not overlap
    for a, _, b in sorted(taken):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for span in ordered:
        a, _, b = span
        at = bisect_right(starts, a)
        if (at == 0 or ends[at - 1] <= a) and (at == len(starts) or b <= starts[at]):
            starts.insert(at, a)
            ends.insert(at, b)
            out.append(span)
    return out


def _accepts(kind: int, own: str) -> bool:
    """Whether the fixed patterns take the whole string when it stands alone."""
    return (0, kind, len(own)) in base_spans(own)


def _stretch(text: str, size: int, seed: int) -> str:
    """The text, or of a longer one ``size`` characters from a place that ``seed`` chooses."""
    start = seed % (len(text) - size + 1) if len(text) > size else 0
    return text[start:start + size]


def training_rows(text: str, max_chars: int = 65536) -> list[tuple[list[float], bool, bool]]:
    """(features, personal, beyond the base) of the candidates of a text into which personal data and look-alikes are planted.

    Personal are the planted spans and what the base rule takes when it stands alone; all that only overlaps those, lies in a
    look-alike or stands in the text unplanted and untaken is not. What is planted depends on the text alone.
    """
    seed = zlib.crc32(text.encode("utf-8", "replace"))
    full, marks = plant(_stretch(text, max_chars, seed), random.Random(seed))
    exact = {(a, k, b) for a, k, b, personal in marks if personal}
    base = set(base_spans(full))
    starts, out = [m[0] for m in marks], []
    for c in candidates(full):
        a, kind, b = c
        at = bisect_right(starts, b - 1) - 1  # the last plant that starts before the end; plants do not overlap
        inside = at >= 0 and marks[at][2] > a
        out.append((describe(full, c), c in exact if inside else _accepts(kind, full[a:b]), c not in base))
    return out


def fit_privacy(documents: DataFrame, bound: int = 4000, max_chars: int = 65536, precision: float = 0.98) -> PrivacyModel:
    """Learn from the candidates of at most ``bound`` documents (the least hashes of the id; of longer ones a stretch of ``max_chars``
    characters from a hashed place).

    There are no labels for personal data, so ``plant`` writes some into the training texts, with look-alikes and words around
    them (see ``training_rows``): the trees learn formats beyond the base and the context that tells a phone from
    an order number. A fourth of the documents is kept for the thresholds: per kind, the least probability with the wanted
    ``precision`` among the candidates that are no base spans (a half at least, 0.9 where there is nothing to measure).
    """
    usable = documents.where(F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull()).select("doc_id", "text")
    ids = usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    chosen = usable.join(F.broadcast(ids), "doc_id")  # at most `bound` numbers

    def make():
        def run(texts):
            rows = [training_rows(t, max_chars) for t in texts]
            return {"x": [[v for x, _, _ in r for v in x] for r in rows], "y": [[float(y) for _, y, _ in r] for r in rows],
                    "beyond": [[z for _, _, z in r] for r in rows]}
        return run

    rows = map_texts(chosen, "x array<double>, y array<double>, beyond array<boolean>", make, keep=["doc_id"]).where("size(y) > 0").orderBy("doc_id").collect()
    if not rows:
        return PrivacyModel(Boosted(-5.0), (0.9,) * len(KINDS))
    x = np.concatenate([np.reshape(r["x"], (-1, FEATURES)) for r in rows])
    y = np.concatenate([r["y"] for r in rows])
    beyond = np.concatenate([np.array(r["beyond"], bool) for r in rows])
    later = np.concatenate([np.full(len(r["y"]), zlib.crc32(str(r["doc_id"]).encode()) % 4 == 0) for r in rows])
    trees = Boosted.fit(x[~later], y[~later], rounds=120) if (~later).any() else Boosted(-5.0)
    held = later & beyond
    chance, limits = trees.probability(x[held]), []
    for kind in range(len(KINDS)):
        mine = x[held][:, 0] == kind
        order = np.argsort(-chance[mine], kind="stable")
        p, good = chance[mine][order], np.cumsum(y[held][mine][order]) / np.arange(1, mine.sum() + 1)
        ok = np.flatnonzero(good >= precision)
        limits.append(max(0.5, float(p[ok[-1]])) if len(ok) else 0.9)
    return PrivacyModel(trees, tuple(limits))


def _written(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span (overlapping ones together) replaced by the name of its first kind."""
    out, cursor = [], 0
    for start, kind, end in sorted(spans):
        if start >= cursor:
            out += [text[cursor:start], f"[{KINDS[kind].upper()}]"]
        cursor = max(cursor, end)
    return "".join(out) + text[cursor:]


_MAY_HOLD = re.compile(r"[0-9@]|[(\[]at[)\]]")


def find_privacy(documents: DataFrame, model: PrivacyModel, keep: list[str] | None = None, redacted: bool = False) -> DataFrame:
    """Every document with the base counts by kind, base_sha256 and all ``spans`` (and the ``redacted`` text if asked for).

    A null text counts as empty and is redacted to the empty text; columns of these names give way.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)  # some dozens of small trees

    def make():
        def run(texts):
            found = [sent.value.spans(t) if _MAY_HOLD.search(t) else ([], []) for t in texts]
            out = {f"n_{kind}": [sum(s[1] == k for s in base) for base, _ in found] for k, kind in enumerate(KINDS)}
            out["base_sha256"] = [hashlib.sha256(_written(base).encode()).hexdigest() for base, _ in found]
            out["spans"] = [_written(every) for _, every in found]
            out["redacted"] = [redact(t, every) for t, (_, every) in zip(texts, found)] if redacted else None
            return out
        return run

    added = ", ".join(f"n_{kind} bigint" for kind in KINDS) + ", base_sha256 string, spans string" + (", redacted string" if redacted else "")
    return map_texts(documents, added, make, keep)
