"""Personal data: base patterns, and a semi-Markov conditional random field that adds what they miss.

The base finds emails, ip addresses, payment cards and phone numbers of the plain forms. Around runs of digits, "@" and
spelt-out "at", candidate segments of up to max_tokens tokens, and written-out addresses of whole words of any length,
are scored as wholes (shape, digit groups, checksum, context, length) by type; dynamic programming over all ways to cut a
region into entities and single other tokens chooses boundaries and types together, with transitions between
neighbouring segments that are learned with the features: both follow the gradient of the likelihood, gold less expected. A segment is added if
the best cut has it, its posterior is high and no base span overlaps it.

The field is fitted on the driver: base spans of a bounded sample of documents are its positive examples, in their own
form and rewritten (no plus sign, dots for dashes, "at" and "dot" spelt out), other numbers of those texts and made-up
ones (dates, prices, versions, numbers that fail the checksum) its negative ones. Every whole text is scanned.

Nulls: a null text is empty. Repeated rows and null ids are each scanned; an empty table gives an empty result. Other
columns are passed over, whatever their names. Positions are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableproof.llm.common import ship

ship(__name__)

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
Span = tuple[int, int, int]  # start, kind, end

#: The base patterns. Lookbehinds only keep long runs from being tried again at each place.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


@dataclass(frozen=True)
class PiiSpec:
    #: Documents whose base spans and numbers the field is fitted on, about, and the longest of them in characters.
    sample_docs: int = 2_000
    sample_chars: int = 20_000
    examples: int = 1_200
    epochs: int = 8
    max_tokens: int = 20
    #: Longer runs of digits and their separators (a list of numbers) are cut in windows of so many characters that
    #: overlap by twice the margin; each window gives the entities that begin in its middle part.
    window: int = 4_000
    margin: int = 200
    #: How sure the field must be that an entity of the kind is there, over all its boundaries.
    posterior: float = 0.9
    seed: int = 11


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield (start, 0, found.end())
            done = found.end()
        at = text.find("@", max(at + 1, done))


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by start and then kind."""
    spans = list(_emails(text)) if "@" in text else []
    if re.search("[0-9]", text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                spans.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = digits_of(m[0])
                if 14 <= len(d) <= 19 and luhn(d):
                    spans.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(digits_of(m[0])) <= 15:
                    spans.append((m.start(), 3, m.end()))
    return sorted(spans)


# -- candidates ------------------------------------------------------------------------------------------------------

TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s|.", re.S)
#: Where entities may be: numbers in groups, and words around an "at".
NUMBERS = re.compile(r"[+(]{0,2}[0-9](?:[\x20().\-–/]{0,3}[0-9])+")
_AT = r"\x20?(?:@|[\[({]\x20?(?:at|AT|@)\x20?[\])}]|\x20(?:at|AT)\x20)\x20?[\w-]{1,64}"
_DOT = r"\x20?(?:\.|[\[({]\x20?(?:dot|DOT)\x20?[\])}]|\x20(?:dot|DOT)\x20)\x20?[\w-]"
WRITTEN = re.compile(rf"[\w.+%-]{{1,64}}(?:\x20dot\x20[\w-]{{1,64}}){{0,3}}{_AT}(?:{_DOT}{{1,64}}){{1,5}}")
#: What each match of WRITTEN has, and is one: the sign with what is next to it. A match begins at most LEAD characters before.
SIGNED = re.compile(rf"(?=[\x20@\[({{])(?<=[\w.+%-]){_AT}{_DOT}")
LEAD = 64 + 3 * (5 + 64)
#: Last labels that written-out addresses commonly end in.
ENDINGS = set("com org net edu gov mil int info biz io ai app dev co eu uk de fr es it nl be at ch pl cz se no fi dk pt ie us ca au nz jp cn in br mx ru".split())
CONTEXT = {"tel": "tel", "phone": "tel", "call": "tel", "mobile": "tel", "fax": "tel", "ip": "ip", "host": "ip", "server": "ip", "card": "card", "visa": "card", "mastercard": "card", "mail": "mail", "email": "mail", "contact": "mail"}


@dataclass
class Region:
    tokens: list[tuple[int, int]]
    candidates: list[tuple[int, int, int, tuple[str, ...]]]  # first token, end token, kind, features
    #: Entities that begin outside of this part of the text belong to another window of a long run.
    core: tuple[int, int] | None = None


def regions(text: str, spec: PiiSpec) -> Iterator[Region]:
    """The text's regions with their candidate segments and features."""
    if re.search("[0-9]", text):
        for m in NUMBERS.finditer(text):
            if m.end() - m.start() >= 7 and sum(c.isdigit() for c in m[0]) >= 4:
                for start, end, core in windows(text, m.start(), m.end(), spec):
                    region = _region(text, start, end, spec, False)
                    region.core = core
                    if region.candidates:
                        yield region
    for start, end in written(text):
        region = _region(text, start, end, spec, True)
        if region.candidates:
            yield region


def written(text: str) -> Iterator[tuple[int, int]]:
    """Matches of WRITTEN, looked for only from LEAD characters before each match of its SIGNED part."""
    done = 0
    while sign := SIGNED.search(text, done + 1):
        m = WRITTEN.search(text, max(done, sign.start() - LEAD))
        yield m.span()
        done = m.end()


def windows(text: str, start: int, end: int, spec: PiiSpec) -> Iterator[tuple[int, int, tuple[int, int]]]:
    """Start, end and middle part of the windows that a long run is read in; a short one is a single window.

    Windows begin and end between tokens, unless a run of digits is as long as a margin.
    """
    if end - start <= spec.window:
        yield start, end, (start, end)
        return

    def between(at: int) -> int:
        low = max(start, at - spec.margin // 2)
        while at > low and text[at - 1].isdigit() and text[at].isdigit():
            at -= 1
        return at

    step = spec.window - 2 * spec.margin
    cuts = [start, *(between(at) for at in range(start + step, end - spec.margin, step)), end]
    for lo, hi in zip(cuts, cuts[1:]):
        yield (between(lo - spec.margin) if lo > start else start), (between(hi + spec.margin) if hi + spec.margin < end else end), (lo, hi)


def _region(text: str, start: int, end: int, spec: PiiSpec, written: bool) -> Region:
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text, start, end)]
    found = []
    # where a local part may begin and a last label may end
    heads = {m.start(1) for m in re.compile(r"[_.+%-]*([^\W_][\w.+%-]*)").finditer(text, start, end)} if written else ()
    tails = {m.end() for m in re.compile(r"[\w-]*[^\W_]").finditer(text, start, end)} if written else ()
    for i, (a, _) in enumerate(tokens):
        first = text[a]
        if not (first.isalnum() or (not written and first in "+(")):
            continue
        for j in range(i, len(tokens) if a in heads else min(i + spec.max_tokens, len(tokens))):
            b = tokens[j][1]
            if j >= i + spec.max_tokens and b not in tails:
                continue
            last = text[b - 1]
            if not (last.isalnum() or (not written and last == ")")):
                continue
            piece = text[a:b]
            if written:
                kinds = (0,) if j > i + 1 and re.search(r"@|\bat\b", piece, re.I) and re.search(r"\.|\bdot\b", piece.partition("@")[2] or piece, re.I) else ()
            else:
                n = sum(c.isdigit() for c in piece)
                kinds = ((1,) if piece.count(".") == 3 and 4 <= n <= 12 else ()) + ((2,) if 12 <= n <= 19 else ()) + ((3,) if 7 <= n <= 15 else ())
            if kinds:
                shared = span_features(text, a, b)
                found += [(i, j + 1, k, shared) for k in kinds]
    return Region(tokens, found)


def _class(c: str) -> str:
    return "d" if c.isdigit() else "a" if c.isalpha() else "s" if c.isspace() else c if c else "^"


def span_features(text: str, a: int, b: int) -> tuple[str, ...]:
    """Features of a whole segment and the text beside it."""
    piece = text[a:b]
    groups = re.findall("[0-9]+", piece)
    digits = "".join(groups)
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: str(min(len(m[0]), 9)), piece)) if len(piece) < 60 else "long"
    loose = re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", piece))[:40]
    before, after = text[a - 1 : a], text[b : b + 1]
    word = re.search(r"([^\W\d_]+)[^\w+(]{0,3}$", text[max(0, a - 24) : a])
    out = [
        "shape:" + shape,
        "loose:" + loose,
        f"digits:{len(digits)}",
        f"groups:{min(len(groups), 6)}",
        "before:" + _class(before),
        "after:" + _class(after),
        "first:" + _class(piece[0]),
        "last:" + _class(piece[-1]),
        f"tokens:{min(len(piece) // 4, 9)}",
        f"context:{CONTEXT.get(word[1].lower(), '-') if word else '-'}",
    ]
    if before in (".", "-", "/", ",") or after in ("/", "-"):
        out.append("joined")
    if not re.search("[A-Za-z@]", piece):  # part of a longer number, or one of a list
        more = bool(re.search(r"[+0-9][\x20().\-–/]{0,3}$", text[max(0, a - 4) : a])), bool(re.match(r"[\x20().\-–/]{0,3}[0-9]", text[b : b + 4]))
        out.append(f"more:{more[0]}:{more[1]}")
        out.append(f"shape:{shape}:{more[0]}:{more[1]}")
    if (after == "." and text[b + 1 : b + 2].isalnum()) or (before == "." and text[a - 2 : a - 1].isalnum()):
        out.append("dotted")
    if 12 <= len(digits) <= 19:
        out.append(f"luhn:{luhn(digits)}:{13 <= len(digits) <= 19}")
    if len(groups) == 4 and piece.count(".") == 3:
        out.append(f"bytes:{all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    if re.search(r"[-/.]", piece) and re.fullmatch(r"(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}(?:[ T].*)?|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)?[0-9]{2}(?: .*)?|(?:19|20)[0-9]{2}\s?[-–/]\s?(?:19|20)[0-9]{2}", piece):
        out.append("date")
    if re.search("[A-Za-z]", piece):
        tail = re.search(r"[A-Za-z]+$", piece)
        out.append(f"tail:{min(len(tail[0]), 7) if tail else 0}")
        out.append(f"ending:{bool(tail) and tail[0].lower() in ENDINGS}")
        if re.search(r"\b(?:dot|at)$|^(?:dot|at)\b", piece, re.I):
            out.append("hanging")
        if re.match(r"\s?(?:dot\b|[\[({]\s?dot\b)|\.[A-Za-z0-9]", text[b : b + 8], re.I) or re.search(r"[A-Za-z0-9](?:[._+%-]|\sdot\s)$", text[max(0, a - 8) : a], re.I):
            out.append("goes on")
        out.append("sign:" + ("@" if "@" in piece else "at" if re.search(r"[\[({]\s?at", piece, re.I) else "word"))
        if re.search(r"\bAT\b", piece):
            out.append("capitals")
        if re.search(r"\.\s", piece):
            out.append("gap")
        out.append("dots:" + ("." if "." in piece.partition("@")[2] else "dot" if re.search(r"\bdot\b", piece, re.I) else "-"))
        if "hanging" not in out and "goes on" not in out:
            out.append(f"form:{out[-2]}:{out[-1]}:{bool(tail) and tail[0].lower() in ENDINGS}")
    return tuple(out)


# -- the field -------------------------------------------------------------------------------------------------------

Weights = dict[str, list[float]]


def _scores(region: Region, weights: Weights) -> list[float]:
    out = []
    for _, _, kind, features in region.candidates:
        total = weights["bias"][kind]
        for f in features:
            w = weights.get(f)
            if w is not None:
                total += w[kind]
        out.append(total)
    return out


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) if top > -math.inf else -math.inf


def _lattice(region: Region, scores: list[float], moves: list[list[float]]):
    """Forward and backward sums by token and last (next) type; moves[p][q]: score of type q after type p."""
    n, states = len(region.tokens), OTHER + 1
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    starting: list[list[int]] = [[] for _ in range(n + 1)]
    for c, (i, j, _, _) in enumerate(region.candidates):
        ending[j].append(c)
        starting[i].append(c)
    ahead = [[-math.inf] * states for _ in range(n + 1)]
    ahead[0][OTHER] = 0.0
    for t in range(1, n + 1):
        ahead[t][OTHER] = _log_sum([ahead[t - 1][p] + moves[p][OTHER] for p in range(states)])
        by_kind: dict[int, list[float]] = {}
        for c in ending[t]:
            i, _, kind, _ = region.candidates[c]
            by_kind.setdefault(kind, []).append(_log_sum([ahead[i][p] + moves[p][kind] for p in range(states)]) + scores[c])
        for kind, values in by_kind.items():
            ahead[t][kind] = _log_sum(values)
    behind = [[-math.inf] * states for _ in range(n + 1)]
    behind[n] = [0.0] * states
    for t in range(n - 1, -1, -1):
        onward = [(OTHER, behind[t + 1][OTHER])] + [(region.candidates[c][2], scores[c] + behind[region.candidates[c][1]][region.candidates[c][2]]) for c in starting[t]]
        behind[t] = [_log_sum([moves[p][q] + v for q, v in onward]) for p in range(states)]
    whole = _log_sum(ahead[n])
    return ahead, behind, whole


def posteriors(region: Region, scores: list[float], moves: list[list[float]]) -> list[float]:
    ahead, behind, whole = _lattice(region, scores, moves)
    out = []
    for c, (i, j, kind, _) in enumerate(region.candidates):
        into = _log_sum([ahead[i][p] + moves[p][kind] for p in range(OTHER + 1)])
        out.append(math.exp(min(0.0, into + scores[c] + behind[j][kind] - whole)))
    return out


def expected_moves(region: Region, scores: list[float], moves: list[list[float]]) -> list[list[float]]:
    """How often each type follows each type, as the field expects it."""
    ahead, behind, whole = _lattice(region, scores, moves)
    states = OTHER + 1
    out = [[0.0] * states for _ in range(states)]
    for t in range(len(region.tokens)):
        for p in range(states):
            out[p][OTHER] += math.exp(min(0.0, ahead[t][p] + moves[p][OTHER] + behind[t + 1][OTHER] - whole))
    for c, (i, j, kind, _) in enumerate(region.candidates):
        for p in range(states):
            out[p][kind] += math.exp(min(0.0, ahead[i][p] + moves[p][kind] + scores[c] + behind[j][kind] - whole))
    return out


def gold_moves(region: Region, goal: list[float]) -> list[list[float]]:
    """How often each type follows each type in the cut whose entities are the candidates with goal 1."""
    out = [[0.0] * (OTHER + 1) for _ in range(OTHER + 1)]
    entities = {i: (j, kind) for (i, j, kind, _), want in zip(region.candidates, goal, strict=True) if want}
    last, t = OTHER, 0
    while t < len(region.tokens):
        end, kind = entities.get(t, (t + 1, OTHER))
        out[last][kind] += 1
        last, t = kind, end
    return out


def decode(region: Region, scores: list[float], moves: list[list[float]]) -> list[int]:
    """Candidates of the best cut of the region."""
    n, states = len(region.tokens), OTHER + 1
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    for c, (_, j, _, _) in enumerate(region.candidates):
        ending[j].append(c)
    best = [[(-math.inf, None, None)] * states for _ in range(n + 1)]
    best[0][OTHER] = (0.0, None, None)
    for t in range(1, n + 1):
        best[t][OTHER] = max(((best[t - 1][p][0] + moves[p][OTHER], (t - 1, p), None) for p in range(states)), key=lambda x: x[0])
        for c in ending[t]:
            i, _, kind, _ = region.candidates[c]
            value, p = max((best[i][p][0] + moves[p][kind], p) for p in range(states))
            if value + scores[c] > best[t][kind][0]:
                best[t][kind] = (value + scores[c], (i, p), c)
    at = (n, max(range(states), key=lambda p: best[n][p][0]))
    chosen = []
    while at and at[0]:
        _, back, c = best[at[0]][at[1]]
        if c is not None:
            chosen.append(c)
        at = back
    return chosen


@dataclass
class SegmentField:
    weights: Weights
    moves: list[list[float]]


def fit(texts: list[str], spec: PiiSpec = PiiSpec()) -> SegmentField:
    """The field fitted on the base spans of texts, in their own and other forms, against other numbers."""
    rng = random.Random(spec.seed)
    examples = _examples(texts, spec, rng)
    weights: Weights = {"bias": [-2.0] * OTHER}
    seen: Weights = {"bias": [1.0] * OTHER}
    moves = [[0.0] * (OTHER + 1) for _ in range(OTHER + 1)]
    seen_moves = [[1.0] * (OTHER + 1) for _ in range(OTHER + 1)]
    prepared = []
    for text, gold in examples:
        for region in regions(text, spec):
            goal = [1.0 if (kind, region.tokens[i][0], region.tokens[j - 1][1]) in gold else 0.0 for i, j, kind, _ in region.candidates]
            prepared.append((region, goal))
    for _ in range(spec.epochs):
        rng.shuffle(prepared)
        for region, goal in prepared:
            expected = posteriors(region, _scores(region, weights), moves)
            grad: dict[tuple[str, int], float] = {}
            for (_, _, kind, features), want, got in zip(region.candidates, goal, expected, strict=True):
                if abs(want - got) > 1e-3:
                    for f in ("bias", *features):
                        grad[f, kind] = grad.get((f, kind), 0.0) + want - got
            for (f, kind), g in grad.items():
                w, s = weights.setdefault(f, [0.0] * OTHER), seen.setdefault(f, [1.0] * OTHER)
                s[kind] += g * g
                w[kind] += 0.5 * g / math.sqrt(s[kind])
            want, got = gold_moves(region, goal), expected_moves(region, _scores(region, weights), moves)
            # between two other tokens nothing is added: it would count against long segments, token by token
            for p, q in ((p, q) for p in range(OTHER + 1) for q in range(OTHER + 1) if (p, q) != (OTHER, OTHER)):
                g = want[p][q] - got[p][q]
                seen_moves[p][q] += g * g
                moves[p][q] += 0.1 * g / math.sqrt(seen_moves[p][q])
    return SegmentField(weights, moves)


#: Sentences that stand around made-up examples when the sample has too few of its own.
FRAMES = ("please see {} for more", "reach us: {}.", "{}", "it was {} and then", "(id {})", "the value, {}, is stored", "tel {} or write", "server {} answered", "card {} on file", "mail {} today")


def _examples(texts: list[str], spec: PiiSpec, rng: random.Random) -> list[tuple[str, set[tuple[int, int, int]]]]:
    found: list[tuple[str, str, int, str]] = []  # before, value, kind, after
    plain: list[str] = []
    for text in texts:
        spans = base_spans(text)
        for start, kind, end in spans:
            lo, hi = _around(start, end, spans)
            found.append((text[lo:start], text[start:end], kind, text[end:hi]))
        for m in NUMBERS.finditer(text):
            if m.end() - m.start() >= 7 and not any(s < m.end() and m.start() < e for s, _, e in spans):
                lo, hi = _around(m.start(), m.end(), spans)
                plain.append(text[lo:hi])
    rng.shuffle(found)
    rng.shuffle(plain)
    out = []
    for before, value, kind, after in found[: spec.examples]:
        out.append(_framed(before, value, kind, after))
        if rng.random() < 0.6:
            out.append(_framed(before, _other_form(value, kind, rng), kind, after))
    for _ in range(spec.examples // 3):
        kind = rng.randrange(OTHER)
        before, _, after = rng.choice(FRAMES).partition("{}")
        value = _made(kind, rng)
        out.append(_framed(before, value if rng.random() < 0.4 else _other_form(value, kind, rng), kind, after))
    out += [_listed(rng) for _ in range(spec.examples // 4)]
    out += [(text, _gold(text)) for text in plain[: spec.examples]]
    for _ in range(spec.examples // 2):
        before, _, after = rng.choice(FRAMES).partition("{}")
        out.append((before + _innocent(rng) + after, set()))
    return out


def _around(start: int, end: int, spans: list[Span], reach: int = 40) -> tuple[int, int]:
    """The stretch around a span, without pieces of others: what is left of a cut number would count as none."""
    lo, hi = max(0, start - reach), end + reach
    for s, _, e in spans:
        if s < lo < e <= start:
            lo = e
        if end <= s < hi < e:
            hi = s
    return lo, hi


def _gold(text: str) -> set[tuple[int, int, int]]:
    return {(kind, a, b) for a, kind, b in base_spans(text)}


def _framed(before: str, value: str, kind: int, after: str) -> tuple[str, set[tuple[int, int, int]]]:
    gold = {(k, a, b) for k, a, b in _gold(before)}
    gold.add((kind, len(before), len(before) + len(value)))
    shift = len(before) + len(value)
    gold |= {(k, a + shift, b + shift) for k, a, b in _gold(after)}
    return before + value + after, gold


def _listed(rng: random.Random) -> tuple[str, set[tuple[int, int, int]]]:
    """A list of values of one kind, or of other numbers, in one form with only blanks or dashes between."""
    kind, seed, gap = rng.randrange(1, OTHER + 1), rng.random(), rng.choice((" ", " ", "  ", " - ", " / "))
    text, gold = "", set()
    for _ in range(rng.randrange(2, 6)):
        if kind == OTHER:
            value = _innocent(random.Random(seed))
        else:
            value = _made(kind, rng) if seed < 0.3 else _other_form(_made(kind, rng), kind, random.Random(seed))
            gold.add((kind, len(text), len(text) + len(value)))
        text += value + gap
    return text[: -len(gap)], gold


def _other_form(value: str, kind: int, rng: random.Random) -> str:
    if kind == 0 and "@" in value:
        local, _, domain = value.partition("@")
        sign = rng.choice((" at ", " [at] ", "(at)", " (at) ", "[at]", "@"))
        dot = rng.choice((" dot ", " [dot] ", "(dot)")) if sign == "@" or "at " in sign or rng.random() < 0.6 else "."
        if rng.random() < 0.4:
            sign, dot = rng.choice(((" AT ", " DOT "), (" AT ", "."), (" [AT] ", " [DOT] "), (" {at} ", " {dot} "), (" ( at ) ", "."), (" at ", ".")))
        return local + sign + domain.replace(".", dot)
    if kind == 2:
        d = digits_of(value)
        gap = rng.choice((" ", "-", ".", ""))
        return gap.join(d[i : i + 4] for i in range(0, len(d), 4))
    if kind == 3:
        d = digits_of(value)[-10:]
        return rng.choice(("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "({}){}-{}", "1-{}-{}-{}", "00{} {} {}")).format(d[:3], d[3:6], d[6:])
    return value


def _made(kind: int, rng: random.Random) -> str:
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == 0:
        return rng.choice(("info", "jo.doe", "anna_k", "m" + number(2))) + "@" + rng.choice(("mail", "web", "post" + number(1))) + "." + rng.choice(("example.com", "org", "example.net", "de"))
    if kind == 1:
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    if kind == 2:
        head = number(15)
        return next(head + c for c in "0123456789" if luhn(head + c))
    return f"+{rng.choice(('1', '44', '49', '33'))} ({number(3)}) {number(3)}-{number(4)}"


def _innocent(rng: random.Random) -> str:
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    bad = number(16)
    while luhn(bad):
        bad = number(16)
    year = rng.choice(("19", "20")) + number(2)
    return rng.choice((f"{year}-0{rng.randrange(1, 9)}-1{rng.randrange(9)}", f"1{rng.randrange(9)}/0{rng.randrange(1, 9)}/{year}", f"{year}-{year}", bad, f"{bad[:4]} {bad[4:8]} {bad[8:12]} {bad[12:]}", f"{rng.randrange(1, 30)}.{rng.randrange(9)}.{rng.randrange(9)}.{rng.randrange(400, 9999)}", f"{number(3)}.{number(3)},{number(2)}", number(rng.choice((7, 8, 9, 11, 12, 13))), f"ISBN 978-{number(1)}-{number(4)}-{number(4)}-{number(1)}", f"{number(4)} {number(4)}", f"{year}-01-01 12:{number(2)}:{number(2)}", rng.choice(("we meet at home dot and", "look at it dot then go", "at one dot or two", "he was at work dot dot dot")), f"{rng.choice(('we meet', 'he stayed', 'look', 'she arrived', 'it was sold'))} at {rng.choice(('home', 'noon', 'it', 'Paris', 'work', 'auction'))}. {rng.choice(('In', 'It', 'Us', 'De', 'Be', 'The', 'Then', 'Is', 'At', 'No'))} {rng.choice(('the end', 'all was well', 'that'))}", f"{number(2)} 000 000", f"#{number(10)}"))


class Taken:
    """Disjoint stretches of a text, to ask which parts of it are free; both questions take logarithmic time."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, _, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, a: int, b: int) -> bool:
        at = bisect_left(self.starts, b)
        return at > 0 and self.ends[at - 1] > a

    def add(self, a: int, b: int) -> None:
        at = bisect_left(self.starts, a)
        self.starts.insert(at, a)
        self.ends.insert(at, b)


def added_spans(text: str, base: list[Span], model: SegmentField, spec: PiiSpec) -> list[Span]:
    out: list[Span] = []
    taken = Taken(base)
    spans = set(base)
    for region in regions(text, spec):
        lo, hi = region.tokens[0][0], region.tokens[-1][1]
        if any((lo, kind, hi) in spans for kind in range(OTHER)):
            continue  # one base span is the whole region: nothing can be added
        scores = _scores(region, model.weights)
        if max(scores) <= 0 and all(m <= 0 for row in model.moves for m in row):
            continue  # no cut with an entity beats the one without
        chosen = decode(region, scores, model.moves)
        if not chosen:
            continue
        sure = posteriors(region, scores, model.moves)
        # candidates come by their first token: those that overlap an entity begin within the longest one's reach
        firsts = [i for i, *_ in region.candidates]
        reach = max(j - i for i, j, *_ in region.candidates)
        for c in chosen:
            i, j, kind, _ = region.candidates[c]
            a, b = region.tokens[i][0], region.tokens[j - 1][1]
            if region.core and not region.core[0] <= a < region.core[1]:
                continue
            near = range(bisect_left(firsts, i - reach + 1), bisect_left(firsts, j))
            there = sum(sure[n] for n in near if region.candidates[n][2] == kind and region.candidates[n][1] > i)
            if there >= spec.posterior and not taken.meets(a, b):
                out.append((a, kind, b))
                taken.add(a, b)
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in sorted(spans))


def sample(docs: DataFrame, spec: PiiSpec, id_column: str, text_column: str) -> list[str]:
    """Texts to fit on: about spec.sample_docs of those with digits or "@", with the smallest hashes of their id."""
    text = F.col(text_column).cast("string")
    rows = docs.select(F.col(id_column).cast("string").alias("id"), text.alias("text")).where((F.length("text") <= spec.sample_chars) & F.col("text").rlike("[0-9]{4}|@"))
    n = rows.count()
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    return [r["text"] for r in sorted(rows.where(draw < spec.sample_docs / max(n, 1)).collect(), key=lambda r: (r["id"] or "", r["text"]))]


def find(docs: DataFrame, spec: PiiSpec = PiiSpec(), *, model: SegmentField | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (all), n_added for every row of docs."""
    if model is None:
        model = fit(sample(docs, spec, id_column, text_column), spec)
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.moves))

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        field = SegmentField(*held.value)
        for batch in batches:
            rows = []
            for text in batch:
                text = text or ""
                base = base_spans(text)
                more = added_spans(text, base, field, spec)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(OTHER)]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select(F.col(id_column).alias("doc_id"), scan(F.col(text_column).cast("string")).alias("s")).select("doc_id", "s.*")
