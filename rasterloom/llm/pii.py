"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds spans.

The base patterns give e-mail addresses, IP addresses, cards and phone numbers as they are
usually written.  The field finds disguised or loosely written ones (``name [at] host [dot]
org``, ``(847) 555 0199``, ``10[.]1[.]2[.]3``): every feasible segment of up to ``MAX_TOKENS``
tokens is scored by features of the whole span and its surroundings, and by its kind after that
of the segment before it on the line.  Dynamic programming over the text chooses kinds and
boundaries of all segments together; its state is the last kind.  Segments without digits,
an at-sign or the word at between blanks or brackets are infeasible, so the field runs in
windows around such places only.  A window holds every segment that can reach its place, and
features look at the whole text, so the spans are those of decoding the text as a whole.

The weights are fitted at the first use, by the exact gradient of the field's likelihood, on
``EXAMPLES`` written out by a seeded generator; nothing is learnt from the corpus.  A task
needs one text at a time, and nothing is shuffled.

Defined cases: null and empty texts have no spans; positions are code points, ends exclusive;
the field never changes or overlaps base spans; repeated rows are treated alike; an empty
table gives an empty result; other columns pass.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, EXAMPLES = 26, 600
#: More digits than any kind has.
MOST_DIGITS = 19

#: The leftmost match begins a run of digits: were its first digit within a run, the run's first digit would match before it.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at-sign outwards: what the pattern finds, without trying every word."""
    end, at = 0, text.find("@")  # each character is looked at once: a name never reaches beyond the at-sign before it
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _HOST.match(text, at)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _octet(digits: str) -> bool:
    value = digits.lstrip("0")
    return len(value) <= 3 and int(value or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_octet, m.group().split(".")))]
        for m in _CARD.finditer(text):
            d = _only_digits(m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_only_digits(m.group())) <= 15]
    return sorted(out)


# --- feasible segments and their features

_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
_NUMERIC = frozenset(" -.()+[]{}/")
_AT = re.compile(r"\s?[\[({<]\s?at\s?[\])}>]\s?|\s+at\s+|\s?@\s?", re.I)
#: Tokens of which every feasible segment holds one: digits, or what any match of _AT is about.
_MARK = re.compile(r"[0-9]+|@|(?<=[\s\[({<])at(?=[\s\])}>])", re.I)
_DOT = re.compile(r"\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\s+dot\s+|\s?\.\s?", re.I)
_MORE = re.compile(r"(?:\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\s+dot\s+|\.)[A-Za-z]{2,}", re.I)
_WORDS = {
    "email": re.compile(r"e-?mail|contact|write|reach|correo|mail", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|node|router", re.I),
    "card": re.compile(r"card|visa|master|amex|pay|karte|tarjeta|carte", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|cell|fax|ring|whatsapp|anruf", re.I),
}
_TAILS = frozenset("com org net edu gov io co de fr es uk eu info biz app dev me ai".split())


class Segment:
    """A feasible segment of one kind, by token numbers, with its features."""

    __slots__ = ("kind", "first", "last", "start", "end", "names")

    def __init__(self, kind, first, last, start, end, names):
        self.kind, self.first, self.last, self.start, self.end, self.names = kind, first, last, start, end, names


def merged(base: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the base spans, sorted; those that overlap are one."""
    starts, ends = [], []
    for a, _, b in base:
        if ends and a < ends[-1]:
            ends[-1] = max(b, ends[-1])
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def segments(text: str, blocked: tuple[list[int], list[int]] = ((), ()), low: int = 0, high: int | None = None) -> tuple[list[bool], list[Segment]]:
    """For each token whether it ends a line, and all feasible segments outside the blocked ranges by their start; of text[low:high], whose ends are ends of tokens."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, low, len(text) if high is None else high)]
    starts, ends = blocked
    if starts:
        before = [bisect_left(starts, e) - 1 for _, e in tokens]
        free = [k < 0 or ends[k] <= s for k, (s, _) in zip(before, tokens, strict=True)]
    else:
        free = [True] * len(tokens)
    out: list[Segment] = []
    for i, (s, e) in enumerate(tokens):
        c = text[s]
        if not free[i] or not (c.isascii() and c.isalnum() or c in "+("):
            continue
        number = "0" <= c <= "9" or c in "+("
        digits, groups, mail = 0, 0, c not in "+("
        if mail and s and (text[s - 1] in _LOCAL_CHARS):
            mail = False
        if mail:
            at = _AT.search(text, s, tokens[min(len(tokens), i + MAX_TOKENS) - 1][1])
            mail = at is not None and _is_local(text[s : at.start()])
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            a, b = tokens[j]
            word = text[a:b]
            if not free[j] or word == "\n":
                break
            is_digit = "0" <= word[0] <= "9"
            if number:
                if is_digit:
                    digits, groups = digits + len(word), groups + 1
                    if digits > MOST_DIGITS:
                        number = False
                    elif groups >= 3 and digits >= 4 and (j + 1 == len(tokens) or text[b : b + 1] not in tuple("0123456789")):
                        out += _numeric(text, i, j, s, b, digits)
                    elif 10 <= digits <= 19:
                        out += _numeric(text, i, j, s, b, digits)
                elif word not in _NUMERIC and word.lower() != "dot":
                    number = False
            if mail and b > at.end() and word.isalpha() and word.isascii():
                if seg := _mail(text, i, j, s, b):
                    out.append(seg)
            if not number and not mail:
                break
    return [text[s] == "\n" for s, _ in tokens], out


def _context(text: str, kind: str, s: int, e: int) -> list[str]:
    names = [f"{kind}:bias"]
    before, after = text[s - 1 : s], text[e : e + 1]
    if before and (before.isalnum() or before in "_=#/$"):
        names.append(f"{kind}:joined-left")
    if after and (after.isalnum() or after in "_/%"):
        names.append(f"{kind}:joined-right")
    if before in ("-", ".") and s >= 2 and text[s - 2].isdigit():
        names.append(f"{kind}:number-left")
    if len(after) and after in "-." and text[e + 1 : e + 2].isdigit():
        names.append(f"{kind}:number-right")
    if _WORDS[kind].search(text[max(0, s - 28) : s]):
        names.append(f"{kind}:announced")
    return names


def _numeric(text: str, i: int, j: int, s: int, e: int, nd: int) -> list[Segment]:
    span, out = text[s:e], []
    groups = re.findall("[0-9]+", span)
    seps = [x.strip() or " " for x in re.findall(r"[^0-9]+", span.lstrip("+("))]
    alike = len(set(seps)) <= 1
    sizes = [len(g) for g in groups]
    if len(groups) == 4 and max(sizes) <= 3:
        names = _context(text, "ip", s, e)
        names.append("ip:octets" if all(int(g) <= 255 for g in groups) else "ip:too-large")
        names.append("ip:dots" if all("." in x or "dot" in x.lower() for x in seps) else "ip:other-separators")
        if alike:
            names.append("ip:alike")
        if span[0] in "+(":
            names.append("ip:signed")
        out.append(Segment("ip", i, j, s, e, names))
    if 14 <= nd <= 19:
        names = _context(text, "card", s, e)
        names.append("card:luhn" if luhn(_only_digits(span)) else "card:no-luhn")
        names.append("card:fours" if len(sizes) > 2 and set(sizes[:-1]) == {4} else "card:one" if len(sizes) == 1 else "card:odd-groups")
        if alike:
            names.append("card:alike")
        if span[0] in "+(" or "dot" in span.lower():
            names.append("card:signed")
        out.append(Segment("card", i, j, s, e, names))
    if 10 <= nd <= 15 and len(groups) >= 2:
        names = _context(text, "phone", s, e)
        shape = "-".join(map(str, sizes))
        names.append("phone:shape" if re.fullmatch(r"(?:[1-4]-)?3-3-4|(?:[123]-)?3-4-4|[123]-[23]-[34]-4|(?:[123]-)?[234](?:-2){3,5}", shape) else "phone:odd-shape")
        if span[0] == "+" or span.startswith("00"):
            names.append("phone:plus")
        if re.search(r"\([0-9]{2,4}\)", span):
            names.append("phone:area")
        elif "(" in span or ")" in span:
            names.append("phone:loose-bracket")
        if "dot" in span.lower() or "[" in span or "{" in span:
            names.append("phone:brackets")
        if alike:
            names.append("phone:alike")
        if "." in seps and len(groups) == 4:
            names.append("phone:dotted-four")
        out.append(Segment("phone", i, j, s, e, names))
    return out


def _is_local(local: str) -> bool:
    return bool(_LOCAL.match(_DOT.sub(".", local)))


def _mail(text: str, i: int, j: int, s: int, e: int) -> Segment | None:
    span = text[s:e]
    ats = list(_AT.finditer(span))
    if len(ats) != 1:
        return None
    at = ats[0]
    local, host = span[: at.start()], span[at.end() :]
    if not local or not host or not _is_local(local):
        return None
    dots = list(_DOT.finditer(host))
    labels = _DOT.split(host)
    if not dots or not all(re.fullmatch(r"[A-Za-z0-9-]+", x) for x in labels):
        return None
    names = _context(text, "email", s, e)
    mark = at.group()
    at_kind = "sign" if "@" in mark else "bracket" if mark.strip()[0] in "[({<" else "word"
    names.append(f"email:at-{at_kind}")
    marks = {("bracket" if m.group().strip()[0] in "[({<" else "word" if "dot" in m.group().lower() else "dot" if m.group() == "." else "spaced") for m in dots}
    names += [f"email:by-{m}" for m in sorted(marks)]
    if at_kind == "word":
        names += [f"email:word-by-{m}" for m in sorted(marks)]
    names.append("email:tail" if labels[-1].lower() in _TAILS else "email:short-tail" if len(labels[-1]) <= 3 else "email:odd-tail")
    if " " in local:
        names.append("email:spaced-local")
    if _MORE.match(text, e):
        names.append("email:cut-short")
    return Segment("email", i, j, s, e, names)


# --- the field


STATES = ("none", *KINDS)
#: The path before any segment.
START = ((0.0, None), None, None, None, None)


class Field:
    """Weights by feature.  A path's score is the sum of its segments' and of its transitions; other tokens score 0.

    The state is the kind of the last segment on the line, or none.
    """

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    @property
    def weights(self) -> dict[str, float]:
        return self._weights

    @weights.setter
    def weights(self, weights: dict[str, float]) -> None:
        self._weights = weights
        self.steps = [[weights.get(f"{a}>{b}", 0.0) for b in STATES] for a in STATES]

    def score(self, seg: Segment) -> float:
        return sum(self.weights.get(n, 0.0) for n in seg.names)

    def line_end(self, now: tuple) -> tuple:
        """The best state becomes the state none."""
        return (max((x for x in now if x), key=lambda x: x[0]), None, None, None, None)

    def walk(self, ends: list[bool], segs: list[Segment], now: tuple = START) -> tuple:
        """The best paths to each state behind the tokens, as (score, (last segment, the path before it))."""
        begins: dict[int, list[Segment]] = {}
        for s in segs:
            begins.setdefault(s.first, []).append(s)
        now, arriving = list(now), {}
        for k in range(len(ends) + 1):
            for v, state, path in arriving.pop(k, ()):
                if now[state] is None or v > now[state][0]:
                    now[state] = v, path
            for s in begins.get(k, ()):
                state = KINDS.index(s.kind) + 1
                v, path = max(((x[0] + self.steps[j][state], x[1]) for j, x in enumerate(now) if x), key=lambda x: x[0])
                arriving.setdefault(s.last + 1, []).append((v + self.score(s), state, (s, path)))
            if k < len(ends) and ends[k]:
                now = list(self.line_end(now))
        return tuple(now)

    @staticmethod
    def chosen(now: tuple) -> list[Segment]:
        path, out = max((x for x in now if x), key=lambda x: x[0])[1], []
        while path:
            out.append(path[0])
            path = path[1]
        return out[::-1]

    def best(self, ends: list[bool], segs: list[Segment]) -> list[Segment]:
        """The highest-scoring segmentation of the tokens."""
        return self.chosen(self.walk(ends, segs))

    def expected(self, ends: list[bool], segs: list[Segment]) -> tuple[float, np.ndarray, np.ndarray]:
        """log Z, and the expected counts of each segment and of each transition, by the forward and backward sums."""
        n, states = len(ends), len(STATES)
        score, kind = np.exp(np.minimum([self.score(s) for s in segs], 30.0)), [KINDS.index(s.kind) + 1 for s in segs]
        steps = np.exp(np.array(self.steps))
        ending: dict[int, list[int]] = {}
        begins: dict[int, list[int]] = {}
        for k, s in enumerate(segs):
            ending.setdefault(s.last + 1, []).append(k)
            begins.setdefault(s.first, []).append(k)
        ahead, back = np.zeros((n + 1, states)), np.ones((n + 1, states))
        ahead[0, 0] = 1
        for k in range(1, n + 1):
            ahead[k] = ahead[k - 1]
            if ends[k - 1]:
                ahead[k] = [ahead[k].sum(), *[0.0] * len(KINDS)]
            for x in ending.get(k, ()):
                ahead[k, kind[x]] += ahead[segs[x].first] @ steps[:, kind[x]] * score[x]
        for k in range(n - 1, -1, -1):
            back[k] = back[k + 1, 0] if ends[k] else back[k + 1]
            for x in begins.get(k, ()):
                back[k] += steps[:, kind[x]] * score[x] * back[segs[x].last + 1, kind[x]]
        z = float(ahead[n].sum())
        pairs, each = np.zeros((states, states)), np.zeros(len(segs))
        for x, s in enumerate(segs):
            mass = ahead[s.first] * steps[:, kind[x]] * (score[x] * back[s.last + 1, kind[x]] / z)
            pairs[:, kind[x]] += mass
            each[x] = mass.sum()
        return math.log(z), each, pairs


def examples(n: int = EXAMPLES, seed: int = 11) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences with the spans they hold, by a seeded generator."""
    r = random.Random(seed)
    syllables = "an the re on er st ion ly ed ha ou vi au de la que con ver ein sch".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        d = r.choice("3456") + digits(r.choice((13, 14, 14, 14)))
        d += next(x for x in "0123456789" if luhn(d + x))
        sep = r.choice((".", "/", " - ", "  "))
        return sep.join(d[k : k + 4] for k in range(0, len(d), 4))

    def email() -> str:
        at, dot = r.choice(((" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", "."), (" (at) ", "."), ("{at}", "{dot}"), (" @ ", "."), ("@", " dot "), (" AT ", " DOT "), ("@", "[.]"), ("<at>", "<dot>")))
        host = [word() for _ in range(r.randint(1, 2))] + [r.choice(("com", "org", "net", "de", "fr", "io"))]
        return word() + r.choice(("", ".", "_")) + word() + r.choice(("", digits(2))) + at + dot.join(host)

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"1-{a}-{b}-{c}", f"00{digits(2)} {a} {b} {c}", f"({a}) {b} {c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"+{digits(1)}/{a}/{b}/{c}"))

    def ip() -> str:
        return r.choice(("[.]", "(.)", "[dot]", " dot ", " . ", "{.}")).join(str(r.randint(0, 255)) for _ in range(4))

    def other() -> str:
        return r.choice((
            lambda: f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 30)}", lambda: f"20{digits(2)}-0{digits(1)}-1{digits(1)}", lambda: digits(r.choice((1, 2, 4, 6, 10, 12, 16))),
            lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"${digits(2)},{digits(3)}.{digits(2)}", lambda: "".join(r.choice("0123456789abcdef") for _ in range(18)),
            lambda: f"{r.randint(1, 9)} - {r.randint(10, 99)} - {r.randint(100, 400)}", lambda: f"{word()} at {word()}. {word()}", lambda: f"{word()} at the {word()} dot", lambda: f"{word()}@{word()}",
            lambda: " ".join(digits(r.randint(1, 5)) for _ in range(r.randint(3, 6))), lambda: "/".join(digits(r.choice((1, 3, 5))) for _ in range(4)), lambda: f"({digits(4)}) {digits(2)} {digits(4)}",
            lambda: ", ".join(digits(2) for _ in range(6)), lambda: f"{digits(5)}-{digits(5)}", lambda: f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: f"{digits(3)} {digits(3)} {digits(3)}",
            lambda: f"{r.randint(300, 999)}.{r.randint(0, 999)}.{r.randint(256, 999)}.{r.randint(0, 99)}", lambda: f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}",
        ))()

    makers = {"card": card, "email": email, "phone": phone, "ip": ip}
    hints = {"card": ("card", "pay by visa"), "email": ("mail", "contact"), "phone": ("call", "tel:", "phone"), "ip": ("host", "server at")}
    for _ in range(n):
        parts, spans, at, kind = [], [], 0, None

        def put(x: str, kind: str = "") -> None:
            nonlocal at
            if kind:
                spans.append((kind, at, at + len(x)))
            parts.append(x)
            at += len(x)

        for _ in range(r.randint(1, 4)):
            put(" ".join(word() for _ in range(r.randint(1, 4))) + r.choice((" ", " ", ", ", ": ")))
            if r.random() < 0.5:
                kind = kind if kind and r.random() < 0.4 else r.choice(KINDS)  # lists hold one kind
                if r.random() < 0.4:
                    put(r.choice(hints[kind]) + " ")
                put(makers[kind](), kind)
            else:
                put(other())
            put(r.choice((" ", ", ", ". ")))
        put(word())
        yield "".join(parts), spans


@cache
def fitted(n: int = EXAMPLES, seed: int = 11, epochs: int = 14, batch: int = 60, rate: float = 0.15, decay: float = 1e-4) -> Field:
    """Gradient ascent (Adam) on the likelihood of the examples."""
    data = []
    for text, spans in examples(n, seed):
        ends, segs = segments(text)
        gold = {(k, a, b) for k, a, b in spans}
        real = [s for s in segs if (s.kind, s.start, s.end) in gold]
        steps = [f"{a}>{b}" for a, b in zip(["none", *(s.kind for s in real)], [s.kind for s in real], strict=False)]
        data.append((ends, segs, np.array([float(s in real) for s in segs]), steps))
    names = [f"{a}>{b}" for a in STATES for b in STATES] + sorted({x for _, segs, *_ in data for s in segs for x in s.names})
    number = {x: k for k, x in enumerate(names)}
    rows = [[[number[x] for x in s.names] for s in segs] for _, segs, *_ in data]
    w, m, v = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
    field, r, t = Field({}), np.random.default_rng(seed), 0
    for _ in range(epochs):
        for pick in np.array_split(r.permutation(len(data)), max(1, len(data) // batch)):
            field.weights = dict(zip(names, w.tolist(), strict=True))
            g = -decay * len(pick) * w
            for k in pick:
                ends, segs, gold, steps = data[k]
                if segs:
                    _, each, pairs = field.expected(ends, segs)
                    for ids, d in zip(rows[k], gold - each, strict=True):
                        g[ids] += d
                    g[: pairs.size] -= pairs.ravel()
                    for x in steps:
                        g[number[x]] += 1
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    field.weights = dict(zip(names, w.tolist(), strict=True))
    return field


def _before(text: str, at: int) -> int:
    """Where the MAX_TOKENS - 1 tokens before ``at``, as far as its line goes, begin."""
    size = 8 * MAX_TOKENS
    while True:
        low = max(0, at - size)
        tokens = list(islice(_TOKEN.finditer(text[low:at][::-1]), MAX_TOKENS - 1))
        whole = next((k for k, m in enumerate(tokens) if m.group() == "\n"), len(tokens))
        found = at - tokens[whole - 1].end() if whole else at
        if found > low or not low:
            return found
        size *= 2  # the last token may go on


def _after(text: str, at: int) -> int:
    """Where the MAX_TOKENS - 1 tokens from ``at`` on, as far as its line goes, end."""
    for m in islice(_TOKEN.finditer(text, at), MAX_TOKENS - 1):
        if m.group() == "\n":
            break
        at = m.end()
    return at


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """What the field finds outside the base spans: (start, kind number, end)."""
    windows: list[list[int]] = []
    k = 0
    reach = np.maximum.accumulate([b for _, _, b in base]).tolist() if base else []
    for m in _MARK.finditer(text):
        while k < len(base) and base[k][0] <= m.start():
            k += 1
        if k and reach[k - 1] >= m.end():
            continue  # within a base span
        b = _after(text, m.end())
        if windows and m.start() <= windows[-1][1]:
            windows[-1][1] = max(b, windows[-1][1])
            continue
        a = _before(text, m.start())
        if windows and a <= windows[-1][1]:
            windows[-1][1] = b
        else:
            windows.append([a, b])
    now, last, blocked = START, 0, merged(base)
    for a, b in windows:
        ends, segs = segments(text, blocked, a, b)
        if segs:
            if text.find("\n", last, a) >= 0:
                now = field.line_end(now)
            now, last = field.walk(ends, segs, now), b
    return [(s.start, KINDS.index(s.kind), s.end) for s in field.chosen(now)]


SPAN = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """``docs`` with the spans of each text, by start, then kind; a column of that name is replaced."""
    field = fitted()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
    kept = [f for f in docs.schema.fields if f.name != spans_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                made = []
                for v in batch.column(batch.schema.names.index(text_col)):
                    text = v.as_py() or ""
                    base = base_spans(text)
                    spans = sorted([(*s, True) for s in base] + [(*s, False) for s in added_spans(text, base, field)])
                    made.append([{"kind": KINDS[k], "start": a, "end": b, "base": own} for a, k, b, own in spans])
                names = [f.name for f in kept]
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.names.index(n)) for n in names], pa.array(made, kind)], names=[*names, spans_col])

    schema = T.StructType([*kept, T.StructField(spans_col, T._parse_datatype_string(SPAN))])
    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[%s]") -> DataFrame:
    """``docs`` with every span replaced by its kind; overlapping spans count as one, named by the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = fitted()
        for batch in batches:
            at = batch.schema.names.index(text_col)
            out = []
            for v in batch.column(at):
                text, done, parts = v.as_py(), 0, []
                base = base_spans(text or "")
                for a, k, b in sorted(base + added_spans(text or "", base, field)):
                    if a >= done:
                        parts += [text[done:a], mask % KINDS[k]]
                    done = max(done, b)
                out.append(text if not parts else "".join([*parts, text[done:]]))
            yield batch.set_column(at, text_col, pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(C.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    named = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.base and s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.expr(named.format("filter(spans, s -> s.base)")), 256).alias("base_sha256"), F.expr(named.format("spans")).alias("spans"), F.expr("cast(size(filter(spans, s -> not s.base)) as bigint)").alias("n_added"))
