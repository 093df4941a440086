"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans in other spellings."""

from __future__ import annotations

import random
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, sliced

KINDS = ("email", "ip", "card", "phone")
#: Regions of text that the field is fitted on at most; tokens, digits and groups of digits of an entity that it adds at most (base spans have no bound).
SAMPLE_REGIONS = 300
ENTITY_TOKENS, ENTITY_DIGITS, ENTITY_GROUPS = 40, 24, 8
#: Code points of a region that goes to the fit at most; longer regions are searched like any other, but nothing is learnt from them.
TAUGHT_REGION = 600
#: Code points of context on either side of a digit, at sign, or spelt at or dot.
BEFORE, AFTER = 40, 72

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Spelt marks of an address, in any case and bracket and with blanks around them. A bare word at is one only where a label, a dot and a label follow, as an address has them.
_OPEN, _CLOSE = r"\s{0,4}[(\[{<]?\s{0,4}", r"\s{0,4}[)\]}>]?\s{0,4}"
_AT, _DOT = r"(?<![^\W\d_])[aA][tT](?![^\W\d_])", r"(?<![^\W\d_])[dD][oO][tT](?![^\W\d_])"
_DOTTED = rf"(?:\.|\s{{1,4}}\.\s{{1,4}}|\s{{0,4}}[(\[{{<]\s{{0,4}}\.{_CLOSE}|{_OPEN}{_DOT}{_CLOSE})"
_HOSTED = rf"{_AT}(?={_CLOSE}[\w-]+{_DOTTED}\w)"
_ANCHOR = re.compile(rf"[0-9@]+|[(\[{{<]\s*{_AT}|{_HOSTED}|{_DOT}")
_LABEL = re.compile(r"[\w%+-]+")
_HOST = re.compile(r"[\w-]+\Z")
_GAP = re.compile(r"\s{0,4}([(\[{<]?)\s{0,4}([@.]?)\s{0,4}([)\]}>]?)\s{0,4}\Z")
#: Words that often stand before a plain at without being the name of an address.
_BEFORE_AT = frozenset("look looked looking looks meet meets met meeting sold sell buy bought shop available work works worked working stay stayed visit visited arrive arrived read see seen find found hosted host published posted listed live lives lived start starts started end ends aim aimed us me him her them it you was is are be been were and or not here there shown page store stores site contact prices order orders".split())
_BRACKETS = str.maketrans("[]{}<>", "()()()")
_SPELT = re.compile(rf"{_AT}")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s|[^\w\s]|_")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by the base patterns, leftmost and non-overlapping for each kind; matches that fail a test are dropped. Time is linear in the text."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:  # from each at sign: all of the run before it, then a domain
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end(), "email"))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if _octets(m.group().split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Parts of a text around digits, at signs, and spelt ats and dots, where entities can be."""
    begin = end = -1
    for m in _ANCHOR.finditer(text):
        if begin >= 0 and m.start() - BEFORE <= end:
            end = m.end() + AFTER
            continue
        if begin >= 0:
            yield begin, min(end, len(text))
        begin, end = max(0, m.start() - BEFORE), m.end() + AFTER
    if begin >= 0:
        yield begin, min(end, len(text))


def _shape(s: str) -> str:
    out = []
    for c in s:
        k = "9" if "0" <= c <= "9" else "a" if c.isalpha() else "_" if c.isspace() else c
        if not out or out[-1] != k or k not in "9a":
            out.append(k)
    return "".join(out)


def features(s: str, before: str, after: str) -> list[str]:
    """Whole-span features of a candidate segment with its neighbours."""
    digits, low = _digits(s), s.lower()
    words = re.split(r"[^a-z]+", low)
    if "at" in words or "dot" in words:  # one bracket is like another
        s = s.translate(_BRACKETS)
    shape = _shape(s)
    out = ["1", "shape=" + shape, "begins=" + shape[:6], "ends=" + shape[-6:], f"digits={min(len(digits), 20)}", f"size={min(len(s) // 4, 9)}", "before=" + ("word" if before.isalpha() else before[:1]), "after=" + ("word" if after.isalpha() else after[:1])]
    marks = {c for c in s if not c.isalnum()}
    out += ["has=" + (" " if c.isspace() else c) for c in sorted(marks)]
    groups = [g for g in re.split(r"[^0-9]+", s) if g]
    if not any(c.isalpha() for c in s):
        out.append("numeric")
        out.append("groups=" + ",".join(str(min(len(g), 9)) for g in groups))
        if 13 <= len(digits) <= 19:
            out.append("luhn" if luhn(digits) else "not-luhn")
        if len(groups) == 4:
            out.append("octets" if _octets(groups) else "not-octets")
    else:
        out.append("letters")
        out += [f"word={w}" for w in ("at", "dot") if w in words]
        if "@" in s or "at" in words:
            out.append("tld" if re.search(r"(?:\.|\bdot[)\]}> ]*)\s*[a-z]{2,6}$", low) else "no-tld")
            out.append(f"ats={min(s.count('@') + words.count('at'), 3)}")
    if s[0] == "+":
        out.append("plus")
    if s[0] == "0" and len(digits) >= 9:
        out.append("zero")
    return out


def _links(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, bool]], list[tuple[int, int, str]]]:
    """The labels of a text; for each the label that a dot links it to from the left, and whether that dot is spelt (-1: none); and the links by an at sign: left label, right label, how the at stands.

    A link is what stands between two neighbouring labels, or a label that spells the mark with its two gaps. Each gap is read
    once, so time is linear in the text, however its marks follow one another.
    """
    labels = [m.span() for m in _LABEL.finditer(text)]
    gaps: list[tuple[bool, str, bool]] = []  # whether a mark can stand in the gap before each label, which one, whether in a bracket
    end = 0
    for a, b in labels:
        m = _GAP.match(text, end, a) if a - end <= 18 else None
        if m and m[2] == "." and a - end > 1 and not (m[1] or m[3] or text[end].isspace() and text[a - 1].isspace()):
            m = None  # the end of a sentence
        gaps.append((m is not None, m[2] if m else "", bool(m and (m[1] or m[3]))))
        end = b
    dots: list[tuple[int, bool]] = []
    ats: list[tuple[int, int, str]] = []
    for k, (a, b) in enumerate(labels):
        dots.append((-1, False))
        if not k:
            continue
        fits, mark, bracket = gaps[k]
        if fits and mark == ".":
            dots[k] = k - 1, False
        elif fits and mark == "@":
            ats.append((k - 1, k, "sign"))
        if k > 1 and fits and not mark and b > a:
            spelt = text[labels[k - 1][0] : labels[k - 1][1]]
            before, other, bracket_before = gaps[k - 1]
            if len(spelt) < 4 and before and not other:
                if spelt.lower() == "dot" and dots[k][0] < 0:
                    dots[k] = k - 2, True
                elif spelt.lower() == "at":
                    ats.append((k - 2, k, "bracket" if bracket or bracket_before else "bare"))
    return labels, dots, ats


def addresses(text: str) -> dict[int, list[tuple[int, list[str]]]]:
    """By first code point, the ends of all spans that are written like an address, with the features of their spelling.

    A name (labels linked by dots), an at, and a host of two labels at least. Each label of the name may begin one and each label
    of the host from the second on may end one, as far as an entity reaches.
    """
    labels, dots, ats = _links(text)
    after: dict[int, tuple[int, bool]] = {left: (k, spelt) for k, (left, spelt) in enumerate(dots) if left >= 0}
    out: dict[int, list[tuple[int, list[str]]]] = {}
    for left, right, style in ats:
        begins, ends, k, spelt = [left], [], right, set()
        while dots[begins[-1]][0] >= 0 and len(begins) < ENTITY_TOKENS // 2:
            begins.append(dots[begins[-1]][0])
        while k in after and len(ends) < ENTITY_TOKENS // 2 and _HOST.match(text, *labels[k]) and _HOST.match(text, *labels[after[k][0]]):
            k, is_spelt = after[k]
            spelt.add(is_spelt)
            ends.append((k, "spelt" if spelt == {True} else "plain" if spelt == {False} else "mixed"))
        name = text[slice(*labels[left])].lower()
        for i, begin in enumerate(begins):
            for j, (end, dotted) in enumerate(ends):
                names = [f"style={style}/{dotted}", "name-whole" if i == len(begins) - 1 else "name-part", "host-whole" if j == len(ends) - 1 else "host-part"]
                if style == "bare" and name in _BEFORE_AT and len(begins) == 1:
                    names.append("verb-at/" + dotted)
                out.setdefault(labels[begin][0], []).append((labels[end][1], names))
    return out


class Lattice:
    """Tokens of a region and its candidate segments, which are made as they are asked for and not kept.

    Candidates are of two kinds: stretches without letters that hold seven digits or four groups of them, and what is written like an address.
    """

    def __init__(self, text: str, offset: int = 0):
        self.text, self.offset = text, offset
        self.begin, self.end = array("q"), array("q")
        for m in _TOKEN.finditer(text):
            self.begin.append(m.start())
            self.end.append(m.end())
        self.n = len(self.begin)
        self.addresses = addresses(text) if "@" in text or _SPELT.search(text) else {}

    def token(self, i: int) -> str:
        return self.text[self.begin[i] : self.end[i]] if 0 <= i < self.n else ""

    def edges(self) -> Iterator[tuple[int, int, list[str]]]:
        """(first token, end, features) of each candidate, by first token. An entity has bounded tokens and digits, so a token begins few."""
        before = ""
        for i in range(self.n):
            t = self.token(i)
            if not (i and t.isalnum() and before.isalnum()):
                if "0" <= t[0] <= "9" or t in "+(":
                    yield from self._numeric(i, before)
                if self.begin[i] in self.addresses:
                    yield from self._written(i, before)
            before = t

    def _numeric(self, i: int, before: str) -> Iterator[tuple[int, int, list[str]]]:
        digits = groups = 0
        behind = self.token(i - 2) if before.isspace() else ""  # a number there may be the beginning of this one
        t = self.token(i)
        behind = "behind=" + ("9" if behind[:1].isdigit() else "a" if behind.isalpha() else behind[:1]) + "/" + ("9" if t[0] not in "+(" else t[0])
        for j in range(i, min(i + ENTITY_TOKENS, self.n)):
            after = self.token(j + 1)
            number = "0" <= t[0] <= "9"
            digits, groups = digits + len(t) * number, groups + number
            if t == "\n" or digits > ENTITY_DIGITS or groups > ENTITY_GROUPS or not number and t.isalnum():
                return
            if number and (digits >= 7 or digits >= 4 and groups == 4) and not after.isalnum() and j > i - (len(t) > 8):
                yield i, j + 1, [*features(self.text[self.begin[i] : self.end[j]], before, after), behind]
            t = after

    def _written(self, i: int, before: str) -> Iterator[tuple[int, int, list[str]]]:
        for end, names in self.addresses[self.begin[i]]:
            j = bisect_left(self.end, end, i)
            if j < i + ENTITY_TOKENS and self.end[j] == end:
                yield i, j + 1, [*features(self.text[self.begin[i] : end], before, self.token(j + 1)), *names]

    def span(self, i: int, j: int) -> tuple[int, int]:
        return self.begin[i] + self.offset, self.end[j - 1] + self.offset


def _score(weights: dict[str, float], kind: str, names: list[str]) -> float:
    get = weights.get
    return sum(get(f"{kind}|{x}", 0.0) for x in names)


Weights = dict[str, tuple[float, ...]]


def decode(lattice: Lattice, weights: Weights) -> list[tuple[int, int, str]]:
    """The best joint choice of boundaries and kinds, by dynamic programming over bounded segments: each is scored as it is made, and only the best way to each token is kept."""
    n = lattice.n
    best, begin, kinds = array("d", [0.0]) * (n + 1), array("q", [-1]) * (n + 1), array("b", [0]) * (n + 1)
    low = float("-inf")
    for k in range(1, n + 1):
        best[k] = low
    at, get = 0, weights.get
    for i, j, names in lattice.edges():
        while at < i:  # no further segment ends here
            if best[at] >= best[at + 1]:
                best[at + 1], begin[at + 1] = best[at], -1
            at += 1
        a = b = c = d = best[i]
        for x in names:
            if (w := get(x)) is not None:
                a, b, c, d = a + w[0], b + w[1], c + w[2], d + w[3]
        if (s := max(a, b, c, d)) > best[j]:
            best[j], begin[j], kinds[j] = s, i, (a, b, c, d).index(s)
    while at < n:
        if best[at] >= best[at + 1]:
            best[at + 1], begin[at + 1] = best[at], -1
        at += 1
    out, j = [], n
    while j:
        if begin[j] < 0:
            j -= 1
        else:
            out.append((*lattice.span(begin[j], j), KINDS[kinds[j]]))
            j = begin[j]
    return out[::-1]


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == float("-inf") else a + log(1 + exp(b - a)) if b - a > -40 else a


def _gradient(lattice: Lattice, edges: list, gold: set[tuple[int, int, str]], weights: dict[str, float]) -> dict[str, float]:
    """Of the conditional log likelihood: features of the true segments less those expected."""
    low = float("-inf")
    scores = [[_score(weights, kind, names) for kind in KINDS] for _, _, names in edges]
    ahead, behind = [low] * (lattice.n + 1), [low] * (lattice.n + 1)
    by_end: dict[int, list[int]] = {}
    by_begin: dict[int, list[int]] = {}
    for k, (i, j, _) in enumerate(edges):
        by_end.setdefault(j, []).append(k)
        by_begin.setdefault(i, []).append(k)
    ahead[0] = behind[lattice.n] = 0.0
    for j in range(1, lattice.n + 1):
        ahead[j] = ahead[j - 1]
        for k in by_end.get(j, ()):
            for s in scores[k]:
                ahead[j] = _add(ahead[j], ahead[edges[k][0]] + s)
    for i in range(lattice.n - 1, -1, -1):
        behind[i] = behind[i + 1]
        for k in by_begin.get(i, ()):
            for s in scores[k]:
                behind[i] = _add(behind[i], behind[edges[k][1]] + s)
    out: dict[str, float] = {}
    for (i, j, names), own in zip(edges, scores):
        a, b = lattice.span(i, j)
        for kind, s in zip(KINDS, own):
            p = exp(min(0.0, ahead[i] + s + behind[j] - ahead[lattice.n]))
            d = ((a, b, kind) in gold) - p
            if abs(d) > 1e-4:
                for x in names:
                    out[f"{kind}|{x}"] = out.get(f"{kind}|{x}", 0.0) + d
    return out


def _respell(rng: random.Random, s: str, kind: str) -> str:
    """The same entity in a spelling that the base patterns miss."""
    if kind == "email":
        name, host = s.split("@", 1)
        form = rng.choice(("{} at {}", "{} (at) {}", "{} [at] {}", "{} @ {}"))
        return form.format(name.replace(".", " dot "), host.replace(".", rng.choice((" dot ", " (dot) ", " [dot] ")) if "@" not in form else "."))
    if kind == "ip":
        return rng.choice((" . ", "[.]", "(.)")).join(s.split("."))
    d = _digits(s)
    if kind == "card":
        return rng.choice((".", " - ", "  ", "/")).join(d[i : i + 4] for i in range(0, len(d), 4))
    return rng.choice(("({}) {}-{}", "({}) {} {}", "{}-{}-{}", "{}.{}.{}", "0{} {} {}")).format(d[-10:-7], d[-7:-4], d[-4:])


def _generated_address(rng: random.Random) -> str:
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 9)))
    return f"{word()}{rng.choice(('', '.' + word(), str(rng.randint(1, 99))))}@{word()}.{rng.choice(('com', 'org', 'net', 'example.com', 'fr', 'de'))}"


def _generated(rng: random.Random) -> tuple[str, str]:
    """An entity of a random kind, so that every kind is known whatever the sample holds."""
    kind = rng.choice((*KINDS, "email", "email"))  # addresses have the most spellings
    if kind == "email":
        return _generated_address(rng), kind
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4)), kind
    if kind == "card":
        body = "".join(rng.choice("0123456789") for _ in range(15))
        return body + next(c for c in "0123456789" if luhn(body + c)), kind
    return f"+{rng.randint(1, 99)} ({rng.randint(100, 999)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}", kind


def _taught(text: str, gold: set[tuple[int, int, str]]) -> tuple[Lattice, list, set]:
    lattice = Lattice(text)
    return lattice, list(lattice.edges()), gold


def fit(sample: list[str], rounds: int = 5, seed: int = 7) -> Weights:
    """Weights of the field, from regions whose base spans are the truth, the same with spans respelt, and generated ones."""
    rng, data = random.Random(seed), []
    fillers = ["the", "on", "of", "version 2.0", "in 2019", "4.0", "chapter 12", "was", "id = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "0x1f3a", "12 345", "3.141592", "10:45:30", "2021-03-04", "2021 03 04 2022", "1 2 3 4 5 6 7 8", "10 20 30 40", "met at noon. The", "look at the end", "the dot on it", "the meeting at dot com era"]
    plain = ["look at", "met at", "sold at", "read it at", "prices at", "see us at", "available at", "works at", "hosted at"]
    texts = list(sample)
    for _ in range(640):
        s, _ = _generated(rng)
        texts.append(f"{rng.choice(fillers)} {rng.choice(fillers)} {s} {rng.choice(fillers)}")
    for _ in range(80):
        texts.append(" ".join(rng.choice(fillers) for _ in range(4)))
    for _ in range(120):  # hosts after a plain at that are nobody's address, and names before one that are somebody's
        name, host = _generated_address(rng).split("@")
        if rng.random() < 0.5:
            data.append(_taught(f"{rng.choice(fillers)} {rng.choice(plain)} {host} {rng.choice(fillers)}", set()))
        else:
            a = len(filler := rng.choice(fillers) + " ")
            data.append(_taught(f"{filler}{name} at {host} {rng.choice(fillers)}", {(a, a + len(name) + 4 + len(host), "email")}))
    for text in texts:
        spans = base_spans(text)
        clean = [s for s in spans if not any(o is not s and o[0] < s[1] and s[0] < o[1] for o in spans)]
        data.append(_taught(text, set(clean)))
        if clean and len(text) < 400:
            a, b, kind = rng.choice(clean)
            other = _respell(rng, text[a:b], kind)
            changed, grew = text[:a] + other + text[b:], len(other) - (b - a)
            data.append(_taught(changed, {(a, a + len(other), kind)} | {(x + grew * (x >= b), y + grew * (x >= b), k) for x, y, k in clean if x >= b or y <= a}))
    weights: dict[str, float] = {}
    squares: dict[str, float] = {}
    for _ in range(rounds):
        rng.shuffle(data)
        for lattice, edges, gold in data:
            for x, g in _gradient(lattice, edges, gold, weights).items():
                squares[x] = squares.get(x, 1e-2) + g * g
                weights[x] = weights.get(x, 0.0) * 0.9995 + 0.5 * g / squares[x] ** 0.5
    names = {x.split("|", 1)[1] for x, w in weights.items() if abs(w) > 1e-3}
    return {x: tuple(weights.get(f"{kind}|{x}", 0.0) for kind in KINDS) for x in sorted(names)}


def all_spans(text: str, weights: Weights, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The base spans and those the field adds where no base span is."""
    added, held, upto = [], sorted((a, b) for a, b, _ in base), []
    for _, b in held:
        upto.append(max(b, upto[-1]) if upto else b)
    for a, b in regions(text):
        for s, e, kind in decode(Lattice(text[a:b], a), weights):
            k = bisect_left(held, (e, -1))  # base spans that begin before the end
            if not k or upto[k - 1] <= s:
                added.append((s, e, kind))
    return sorted([*base, *added], key=lambda s: (s[0], KINDS.index(s[2])))


def fit_on(docs: DataFrame, *, text_col: str = "text", sample_regions: int = SAMPLE_REGIONS) -> Weights:
    """Fit the field on at most ``sample_regions`` distinct regions of the texts, those of least hash among the regions under TAUGHT_REGION code points."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            found = {t[a:b] for t in batch.column("text").to_pylist() if t for a, b in regions(t) if b - a < TAUGHT_REGION}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["region"])

    every = docs.select(column(docs, text_col).alias("text")).mapInArrow(cut, "region string").distinct()
    rows = every.orderBy(F.xxhash64("region"), "region").limit(sample_regions).collect()
    return fit([r["region"] for r in rows])


def find_personal_data(docs: DataFrame, weights: Weights | None = None, *, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``base`` and ``spans``: arrays of (start, end, kind), code points, end exclusive, by start and kind.

    ``base`` are the matches of the base patterns; ``spans`` holds them and what the field adds beside them. Null and empty
    texts have none. Rows are independent: copies are treated alike, an empty table gives an empty one; very long texts are
    searched whole, in linear time and with about 100 bytes a code point at most. Columns of ``docs`` of the same names are replaced. There is no shuffle beyond the
    sample's.
    """
    weights = fit_on(docs, text_col=text_col) if weights is None else weights
    kept = docs.select(*(column(docs, c) for c in docs.columns if c not in ("base", "spans")))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))
    schema = T.StructType([*kept.schema.fields, T.StructField("base", span), T.StructField("spans", span)])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    as_rows = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            base = [base_spans(t) for t in texts]
            whole = [all_spans(t, weights, b) for t, b in zip(texts, base)]
            more = [pa.array([as_rows(x) for x in y], arrow) for y in (base, whole)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "base", "spans"])

    return kept.mapInArrow(run, schema)
