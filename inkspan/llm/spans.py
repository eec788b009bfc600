"""Personal data as spans, found by a semi-Markov conditional random field over whole candidate segments.

Base spans (fixed patterns with a test of each match: EMAIL, IP, CARD, PHONE) always stay. The field adds what
one pass of patterns misses: a card behind a year, a phone glued to an address, mail addresses written with
"at" and "dot". A *cluster* is a list of candidate segments that lie close together; a segmentation chooses some that
do not overlap and leaves the rest of the text outside, which scores 0. A segment scores the sum of the weights
of its features, all of which see the whole span (digits, checksum, shape, joints, both neighbours, a cue word
before it), and a segment right behind another the weight of the pair of kinds. A segment has at most MAX_RUNS runs
of digits or MAX_LABELS host labels, so the dynamic programme that chooses boundaries and kinds together is linear
in the text. Base spans are clamped: they are forced, and candidates that overlap one are left out.

Weights are trained by penalised likelihood (forward-backward sums, numpy) on clusters of at most SAMPLE documents,
the first by a hash of doc_id, labelled by their base spans, and on MADE rows that state the wider task. Equal
clusters are counted in Spark; the driver gets at most CLUSTERS of them, the first by hash. Clusters whose base
labels are doubtful (a pattern matched, its test failed, and the match has several runs) are not learnt from.

Memory of a task: an Arrow batch and the candidates of one text; a text is read whole in linear time. A null or
empty text has no spans. Kinds that share a start go in the order of KINDS; segmentations of equal score go to the one
that was found first. Repeated rows are each a row. An empty table gives an empty result; trained on no document,
the field knows the made rows alone. Columns of docs are kept, whatever their names; ``spans`` is replaced.
"""

from __future__ import annotations

import json
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import cut, small_batches

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
SAMPLE, CLUSTERS, MADE = 20_000, 4_000, 1_500
MAX_RUNS, MAX_DIGITS, MAX_LABELS, NEAR, FORCED = 19, 19, 5, 3, 1e6

# The base patterns. Runs are possessive, which changes no match and keeps them linear.
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[0-9]+")
# What candidates are made of: runs of digits up to three joints apart, and names joined by at and dot.
_ZONE = re.compile(r"[0-9]++(?:[\x20().-]{1,3}+[0-9]++)*+")
_AT = r"(?:\s{0,2}[\[({<]\s?[aA][tT]\s?[\])}>]\s{0,2}|\s{1,2}[aA][tT]\s{1,2}|\s?@\s?)"
_DOT = r"(?:\s{0,2}[\[({<]\s?[dD][oO][tT]\s?[\])}>]\s{0,2}|\s{1,2}[dD][oO][tT]\s{1,2}|\.)"
_LABEL = r"[A-Za-z0-9-]{1,63}+"
_MAIL = re.compile(rf"({_AT})({_LABEL}(?:{_DOT}{_LABEL}){{1,{MAX_LABELS - 1}}})")
_JOINT = re.compile(_DOT)
# Words before a span that name its kind, and common ends of host names.
CUES = {"mail": EMAIL, "email": EMAIL, "contact": EMAIL, "ip": IP, "host": IP, "server": IP, "card": CARD, "visa": CARD, "mastercard": CARD, "tel": PHONE, "phone": PHONE, "call": PHONE, "fax": PHONE, "mobile": PHONE}
ENDS = frozenset("com org net edu gov info io de fr es it nl uk eu".split())
_CUE = re.compile(r"([A-Za-z]+)[^A-Za-z0-9]{1,3}\Z")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, kind, end) of the matches that pass, sorted, and (start, end) of those that fail."""
    found, failed = [], []
    last = 0
    at = text.find("@")
    while at >= 0:
        # A name ends at the sign, so the leftmost match starts where the run before it does.
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(text, at) if start < at else None
        if m:
            found.append((start, EMAIL, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for kind, pattern in ((IP, _IP), (CARD, _CARD), (PHONE, _PHONE)):
        for m in pattern.finditer(text):
            digits = "".join(_DIGITS.findall(m.group()))
            if kind == IP:
                good = all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in _DIGITS.findall(m.group()))
            elif kind == CARD:
                good = 14 <= len(digits) <= 19 and luhn(digits)
            else:
                good = 10 <= len(digits) <= 15
            if good:
                found.append((m.start(), kind, m.end()))
            elif len(digits) > 6:
                failed.append(m.span())
    return sorted(found), failed


def _beside(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "edge"
    x = text[at]
    return "letter" if x.isalpha() else "digit" if x.isdigit() else "space" if x.isspace() else "stop" if x in ".,;:!?" else "other"


def _cue(text: str, start: int, kind: int) -> list[str]:
    m = _CUE.search(text[max(0, start - 16) : start])
    return ["cue"] if m and CUES.get(m.group(1).lower()) == kind else []


def number_segments(text: str) -> Iterator[tuple[int, int, int, tuple[str, ...]]]:
    """(start, end, kind, features) of all segments of runs of digits that have the size of a kind."""
    for zone in _ZONE.finditer(text):
        if zone.end() - zone.start() < 7:
            continue
        runs = [(m.start() + zone.start(), m.end() + zone.start()) for m in _DIGITS.finditer(zone.group())]
        joints = [text[a[1] : b[0]] for a, b in zip(runs, runs[1:])]
        for i, (start, _) in enumerate(runs):
            digits = ""
            for j in range(i, min(len(runs), i + MAX_RUNS)):
                lo, end = runs[j]
                if len(digits) + end - lo > MAX_DIGITS:
                    break
                digits += text[lo:end]
                inside = joints[i:j]
                kinds = []
                if len(digits) >= 13 and all(len(x) == 1 for x in inside):
                    kinds.append(CARD)
                if 7 <= len(digits) <= 15 and j - i < 6:
                    kinds.append(PHONE)
                if j - i == 3 and inside == [".", ".", "."] and all(b - a < 4 for a, b in runs[i : j + 1]):
                    kinds.append(IP)
                for kind in kinds:
                    lengths = [b - a for a, b in runs[i : j + 1]]
                    first = start
                    if kind == PHONE:
                        while first > 0 and start - first < 2 and text[first - 1] in "+(":
                            first -= 1
                    opened = text[first:start]
                    shape = opened + "".join(f"{n}{s}" for n, s in zip(lengths, [*inside, ""]))
                    if kind == CARD:
                        good = len(digits) >= 14 and luhn(digits)
                    elif kind == PHONE:
                        good = len(digits) >= 10
                    else:
                        good = all(int(text[a:b]) < 256 for a, b in runs[i : j + 1])
                    left = f"run{joints[i - 1]}" if i else _beside(text, first - 1)
                    right = f"run{joints[j]}" if j + 1 < len(runs) else _beside(text, end)
                    # A row of runs that goes on alike beyond the segment is one thing with it.
                    on = (i > 0 and runs[i - 1][1] - runs[i - 1][0] == lengths[0] and j > i) or (j + 1 < len(runs) and runs[j + 1][1] - runs[j + 1][0] == lengths[-1] and j > i)
                    sure = f"{'good' if good else 'bad'}:{'on' if on else 'alone'}"
                    seen = [sure, f"{sure}:runs{min(j - i, 4)}", f"shape:{shape}", f"{sure}:opened{opened}", f"left:{left}", f"right:{right}", f"digits:{len(digits)}", *_cue(text, first, kind)]
                    yield first, end, kind, tuple(f"{KINDS[kind]}:{x}" for x in ("", *seen))


def mail_segments(text: str) -> Iterator[tuple[int, int, int, tuple[str, ...]]]:
    at = 0
    while m := _MAIL.search(text, at):
        at = m.start(2)
        start = m.start()
        while start > 0 and m.start() - start < 64 and text[start - 1] in _LOCAL:
            start -= 1
        name = text[start : m.start()].lstrip("._%+-")
        if not name:
            continue
        start = m.start() - len(name)
        sign = m.group(1).strip()
        sign = "@" if m.group(1) == "@" else "@ " if sign == "@" else "word" if sign.lower() == "at" else "bracket"
        joints = list(_JOINT.finditer(m.group(2)))
        for labels in range(2, len(joints) + 2):
            used = [x.group().strip() for x in joints[: labels - 1]]
            how = "." if all(x == "." for x in used) else "word" if all(x.lower() == "dot" for x in used) else "bracket" if "." not in used else "mixed"
            whole = labels == len(joints) + 1
            end = m.end() if whole else m.start(2) + joints[labels - 1].start()
            last = m.group(2)[joints[labels - 2].end() : end - m.start(2)].lower()
            tail = "known" if last in ENDS else "letters" if last.isalpha() and len(last) > 1 else "other"
            right = _beside(text, end) if whole else "more"
            seen = [f"sign:{sign}:{how}", f"sign:{sign}:{how}:{tail}", f"tail:{tail}", f"labels:{labels}", f"right:{right}", f"left:{_beside(text, start - 1)}", f"name:{'odd' if not name.isalpha() else 'plain'}", *_cue(text, start, EMAIL)]
            yield start, end, EMAIL, tuple(f"email:{x}" for x in ("", *seen))


def clusters(segments: list[tuple]) -> Iterator[list[tuple]]:
    """Segments that overlap or lie at most NEAR code points apart, directly or through others."""
    held: list[tuple] = []
    reach = 0
    for s in sorted(segments, key=lambda s: (s[0], s[1], s[2])):
        if held and s[0] - reach > NEAR:
            yield held
            held = []
        reach = max(reach, s[1]) if held else s[1]
        held.append(s)
    if held:
        yield held


class Field:
    """Weights by feature name; pairs of kinds are features too."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.pairs = [[weights.get(f"pair:{a}:{b}", 0.0) for b in KINDS] for a in KINDS]
        # Segments are longer than NEAR, so one that is left out leaves no pair: below this none is ever chosen.
        self.least = -2 * max(0.0, *(x for row in self.pairs for x in row))

    def decode(self, cluster: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
        """The best choice of segments (start, end, kind, score), sorted by start.

        Of segments that have ended, the best of each (end, kind) is kept while it is near, and one best behind
        all those; both move forward with the starts.
        """
        by_end = sorted(range(len(cluster)), key=lambda i: cluster[i][1])
        totals, back = [0.0] * len(cluster), [-1] * len(cluster)
        recent: dict[tuple[int, int], int] = {}
        far, done = -1, 0
        for i, (start, _, kind, score) in enumerate(cluster):
            while done < len(by_end) and cluster[by_end[done]][1] <= start:
                k = by_end[done]
                place = cluster[k][1:3]
                if place not in recent or totals[recent[place]] < totals[k]:
                    recent[place] = k
                done += 1
            for place in [p for p in recent if start - p[0] > NEAR]:
                k = recent.pop(place)
                far = k if far < 0 or totals[k] > totals[far] else far
            best, before = (totals[far], far) if far >= 0 and totals[far] > 0 else (0.0, -1)
            for (_, other), k in recent.items():
                if totals[k] + self.pairs[other][kind] > best:
                    best, before = totals[k] + self.pairs[other][kind], k
            totals[i], back[i] = best + score, before
        at = max(range(len(cluster)), key=totals.__getitem__)
        out = []
        while at >= 0 and (totals[at] > 0 or out):
            out.append(cluster[at])
            at = back[at]
        return out[::-1]

    def spans(self, text: str | None) -> list[tuple[int, int, int, bool, float]]:
        """(start, kind, end, base, score) by start, then kind."""
        text = text or ""
        base, _ = base_spans(text)
        # Base spans of one kind do not overlap, and neither do these merged stretches of all kinds.
        taken: list[list[int]] = []
        for start, _, end in base:
            if taken and start < taken[-1][1]:
                taken[-1][1] = max(taken[-1][1], end)
            else:
                taken.append([start, end])
        starts = [x[0] for x in taken]
        free = []
        for segments in (number_segments(text), mail_segments(text)):
            for start, end, kind, features in segments:
                at = bisect_left(starts, end) - 1
                if at < 0 or taken[at][1] <= start:
                    score = sum(self.weights.get(x, 0.0) for x in features)
                    if score > self.least:
                        free.append((start, end, kind, score))
        out = [(start, kind, end, True, 1.0) for start, kind, end in base]
        if free:
            forced = [(start, end, kind, FORCED) for start, kind, end in base]
            for cluster in clusters(free + forced):
                out += [(s, k, e, False, x) for s, e, k, x in self.decode(cluster) if x < FORCED]
        return sorted(out)


def labelled(text: str | None, gold: list[tuple[int, int, int]] | None = None) -> list[str]:
    """The clusters of a text as JSON: [start, end, kind, features, right] of each segment, starts from 0.

    gold: (start, kind, end); without it the base spans, and doubtful clusters are left out.
    """
    text = text or ""
    base, failed = base_spans(text)
    right = {(s, e, k) for s, k, e in (base if gold is None else gold)}
    out = []
    for cluster in clusters([*number_segments(text), *mail_segments(text)]):
        lo, hi = cluster[0][0], max(s[1] for s in cluster)
        if gold is None:
            inside = [(s, e) for s, _, e in base if s < hi and e > lo]
            doubtful = any(s < hi and e > lo and not text[s:e].isdigit() for s, e in failed)
            crossing = any(a[1] > b[0] for a, b in zip(inside, inside[1:]))
            if doubtful or crossing or len(cluster) > 200 or sum((s[0], s[1], s[2]) in right for s in cluster) < len(inside):
                continue
        out.append(json.dumps([[s - lo, e - lo, k, f, int((s, e, k) in right)] for s, e, k, f in cluster]))
    return out


def made_rows(n: int = MADE, seed: int = 11) -> Counter:
    """Labelled clusters that state the wider task, by a fixed random order."""
    rng = random.Random(seed)
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda: "".join(rng.choice("abcdefghinorstu") for _ in range(rng.randint(2, 9)))

    def card(valid: bool = True) -> str:
        size = rng.choice([14, 15, 16, 16, 16, 16, 16, 19])
        digits = number(size)
        while luhn(digits) != valid:
            digits = number(size)
        sep = rng.choice(["", "", "", " ", "-", "."])
        if size == 16 and sep:
            return sep.join(digits[i : i + 4] for i in range(0, 16, 4))
        return digits

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return rng.choice([f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"({a}) {b} {c}", f"+{rng.randint(1, 9)}{a}{b}{c}", f"+{rng.randint(1, 99)}-{a}-{b}-{c}"])

    address = lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))
    end = lambda: rng.choice([*sorted(ENDS), name()[:3].ljust(2, "a")])

    def mail() -> str:
        at, dot = rng.choice([("@", "."), (" [at] ", "."), ("(at)", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), ("[at]", "[dot]"), (" @ ", ".")])
        middle = f"{name()}{dot}" if rng.random() < 0.3 else ""
        return f"{name()}{rng.choice(['', '.', '_', ''])}{rng.choice([name(), number(2), name()])}{at}{name()}{dot}{middle}{end()}"

    def noise() -> str:
        date = f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
        return rng.choice([
            card(valid=False), card(valid=False), number(rng.randint(7, 13)), date, f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1900, 2030)}", f"{number(3)}-{number(4)}",
            f"{number(4)} {number(4)} {number(4)} {number(4)} {number(4)}", " ".join(number(2) for _ in range(rng.randint(5, 12))), f"1.3.6.1.4.1.{number(3)}.{number(2)}", f"{rng.randint(256, 999)}.{address()}", f"{address()}.{number(2)}",
            f"978-3-{number(2)}-{number(6)}-{number(1)}", f"{number(1)}.{number(3)}.{number(3)}.{number(3)}", f"3.{number(12)}", f"{date} {number(2)} {number(2)}", f"{name()}{number(14)}{name()}",
            f"{name()} at {name()}.{end()}", f"{name()} at {name()}.{name()}", f"{name()} @ {number(1)}.{number(2)}", f"{name()} at {name()} dot {name()}ing {name()}", f"{name()} at www.{name()}.{end()}",
        ])

    kinds = {CARD: card, PHONE: phone, IP: address, EMAIL: mail}
    counts: Counter = Counter()
    for _ in range(n):
        text, gold = rng.choice(["", f"{name()} ", f"{name()}: ", f"{rng.choice(sorted(CUES))} ", "("]), []
        for part in range(rng.choice([1, 1, 2, 3])):
            kind = rng.choice([CARD, PHONE, IP, EMAIL, None, None, None])
            piece = noise() if kind is None else kinds[kind]()
            text += rng.choice([" ", " ", ", ", f" {name()} ", f" {rng.randint(1900, 2030)} "]) if part else ""
            # A row of fours beside another, or names beside "at", may be read in two ways; those are not stated.
            if kind is not None:
                gold.append((len(text), kind, len(text) + len(piece)))
            text += piece
        text += rng.choice(["", ".", f" {name()}", ", ", f" {rng.randint(1, 99)}"])
        counts.update(labelled(text, gold))
    return counts


def fit(rows: dict[str, float], rounds: int = 80, rate: float = 0.2, penalty: float = 0.003) -> Field:
    """rows: clusters as labelled() gives them, with counts, which weigh by their root. Penalised likelihood by Adam.

    ahead[q] sums the weights (exponentials of scores) of all choices that end in q, behind[p] those of what may follow p;
    a cluster's segments are few and their scores small, so plain exponentials hold.
    """
    names: dict[str, int] = {}
    flat, sizes, right, weights, known = [], [], [], [], []
    for text, count in sorted(rows.items()):
        cluster = json.loads(text)
        weights += [float(count) ** 0.5] * len(cluster)
        for s in cluster:
            flat += [names.setdefault(x, len(names)) for x in s[3]]
            sizes.append(len(s[3]))
            right.append(s[4])
        gold = [i for i, s in enumerate(cluster) if s[4]]
        follows = np.array([[a[1] <= b[0] for b in cluster] for a in cluster], float)
        near = [(p, q, names.setdefault(f"pair:{KINDS[a[2]]}:{KINDS[b[2]]}", len(names)), float((p, q) in zip(gold, gold[1:]))) for q, b in enumerate(cluster) for p, a in enumerate(cluster) if 0 <= b[0] - a[1] <= NEAR]
        known.append((len(sizes) - len(cluster), len(sizes), follows, near))
    flat, sizes, right, weights = (np.array(x) for x in (flat, sizes, right, weights))
    w, m, v = (np.zeros(len(names)) for _ in range(3))
    total = sum(weights[lo] for lo, *_ in known)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for step in range(1, rounds + 1):
        score = np.exp(np.add.reduceat(w[flat], starts))
        share, grad = np.zeros(len(sizes)), penalty * w
        for lo, hi, follows, near in known:
            own = score[lo:hi]
            if near:
                follows = follows.copy()
                for p, q, t, _ in near:
                    follows[p, q] = np.exp(w[t])
            ahead, behind = own.copy(), np.ones(hi - lo)
            for q in range(1, hi - lo):
                ahead[q] *= 1 + ahead[:q] @ follows[:q, q]
            for p in range(hi - lo - 2, -1, -1):
                behind[p] += (own * behind)[p + 1 :] @ follows[p, p + 1 :]
            z = 1 + ahead.sum()
            share[lo:hi] = ahead * behind / z
            for p, q, t, hit in near:
                grad[t] += weights[lo] / total * (ahead[p] * follows[p, q] * own[q] * behind[q] / z - hit)
        grad += np.bincount(flat, np.repeat((share - right) * weights / total, sizes), len(w))
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field({x: float(w[i]) for x, i in names.items()})


def train(docs: DataFrame, sample: int = SAMPLE, most: int = CLUSTERS) -> Field:
    """docs: doc_id, text."""
    small_batches(docs.sparkSession)
    order = F.xxhash64("doc_id", F.lit(11))
    chosen = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(order, "doc_id").limit(sample)
    # At most ``sample`` ids, so the side that is broadcast is bounded.
    texts = docs.select("doc_id", "text").join(F.broadcast(cut(chosen)), "doc_id").select("text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = Counter(c for t in batch["text"] for c in labelled(t))
            yield pd.DataFrame({"cluster": pd.Series(list(counts), dtype=object), "n": list(counts.values())})

    counts = texts.mapInPandas(run, "cluster string, n long").groupBy("cluster").agg(F.sum("n").alias("n"))
    rows = Counter(made_rows())
    for r in counts.orderBy(F.xxhash64("cluster"), "cluster").limit(most).collect():
        rows[r["cluster"]] += r["n"]
    return fit(rows)


SPANS = "array<struct<start: long, kind: string, end: long, base: boolean, score: double>>"


def find_spans(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """docs' columns with spans: start, kind, end (code points, exclusive), base, and the score of added ones."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = shared.value
        for batch in texts:
            yield pd.Series([[{"start": s, "kind": KINDS[k], "end": e, "base": b, "score": x} for s, k, e, b, x in of.spans(t)] for t in batch], dtype=object)

    return docs.drop("spans").withColumn("spans", F.pandas_udf(find, SPANS)(F.col(f"`{text}`")))
