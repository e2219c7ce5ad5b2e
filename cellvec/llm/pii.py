"""Personal data in texts: emails, addresses of machines, cards and phones, by patterns and by a trained tagger.

Patterns give the base spans of each kind, leftmost first and apart, less those that fail the kind's rule. The
tagger (``tagger``) adds spans in other spellings: "name [at] host dot com", cards and phones with other
separators. It is trained on labelled spans: the base spans of a bounded sample of windows (``SAMPLE`` of each
stratum, over all documents by hash), the same in other spellings, and spans set into plain windows. Every place
with enough digits, an @ or words that stand for it is looked at, in overlapping windows; spans of all windows of a
text are reconciled together: base spans stay, and of the others those apart with the largest sum of log odds.

Null and empty texts have no spans; repeated rows, null ids and ties are each on their own; extra columns are
ignored; empty table: no rows. A very long text needs some 30 times its size in memory; its windows are
decoded in batches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tagger import decode, train
from .texthash import blocks

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base spans.
EMAIL = re.compile(rb"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def table_of(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode())] = True
    return out


DIGITS = table_of("0123456789")
MARKS = DIGITS + 2 * table_of("@") + 3 * table_of("[({<")
NUMERIC = table_of("0123456789 ().+-")
LOCAL = table_of("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Characters of a window, from one window to the next, around what is looked at; windows decoded at once.
SPAN, STRIDE, AROUND, BATCH = 96, 32, 24, 256
#: Least digits of an address of a machine; digits further apart don't belong together.
LEAST_DIGITS, APART = 4, 16
#: Windows of a stratum that the tagger learns from at most, and the confidence that an added span needs.
SAMPLE, CONFIDENCE = 200, 0.75
#: Characters that may stand beside a span, not at its ends.
BESIDE = " \t\n.,;:!?*$%&#\"'"
#: Words for @ and for a dot, in brackets or between spaces.
AT = re.compile(r"\s*(?:[\[({<]\s*at\s*[\])}>]|\sat\s|@)\s*", re.IGNORECASE)
DOT = re.compile(r"\s*(?:[\[({<]\s*(?:dot|\.)\s*[\])}>]|\sdot\s|\.)\s*", re.IGNORECASE)
WORDED = re.compile(rb"[\[({<]\s?(?:at|dot)\s?[\])}>]|\sdot\s")


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def rule(kind: int, text: str) -> bool:
    """What a match of a kind's pattern must fulfil."""
    if kind == 1:
        return all(map(small, text.split(".")))
    if kind == 2:
        d = digits_of(text)
        return 13 <= len(d) <= 19 and luhn(d)
    return kind == 0 or 9 <= len(digits_of(text)) <= 15


def base_spans(data: np.ndarray, rules: bool = True) -> list[tuple[int, int, int]]:
    """(kind, start, end), of all matches or those that fulfil their kind's rule, in bytes of a text's UTF-8. Emails are sought around each @, the others in maximal runs of
    the characters they are made of, so no text is gone through character by character."""
    out = []
    signs = np.flatnonzero(data == 64)
    if len(signs):
        text, end = data.tobytes(), 0
        broken = np.maximum.accumulate(np.where(LOCAL[data], -1, np.arange(len(data))))
        for at in signs.tolist():
            start = max(end, int(broken[at - 1]) + 1) if at else 0
            if start < at and (m := EMAIL.match(text, start)):
                out.append((0, start, m.end()))
                end = m.end()
    digit = DIGITS[data]
    if np.count_nonzero(digit) >= LEAST_DIGITS:
        edge = np.diff(NUMERIC[data].astype(np.int8), prepend=0, append=0)
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        before = np.concatenate(([0], np.cumsum(digit, dtype=np.int64)))
        some = before[stops] - before[starts] >= LEAST_DIGITS
        for a, b in zip(starts[some].tolist(), stops[some].tolist(), strict=True):
            run = data[a:b].tobytes().decode()
            out += [(kind, a + m.start(), a + m.end()) for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)) for m in pattern.finditer(run) if not rules or rule(kind, m[0])]
    return sorted(out)


def regions(data: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges that may hold personal data: digits close together, LEAST_DIGITS of them at least, every @ and
    every word for it."""
    out = []
    mark = MARKS[data]
    at = np.flatnonzero(mark == 1)
    if len(at) >= LEAST_DIGITS:
        cut = np.flatnonzero(np.diff(at) > APART) + 1
        first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(at)]))
        out += [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(first.tolist(), last.tolist(), strict=True) if b - a >= LEAST_DIGITS]
    out += [(int(k), int(k) + 1) for k in np.flatnonzero(mark == 2)]
    lowered = data.tobytes().lower()
    if b"dot" in lowered or (mark == 3).any():
        out += [m.span() for m in WORDED.finditer(lowered)]
    return sorted(out)


def windows(text: str, places: list[tuple[int, int]]) -> list[tuple[int, str]]:
    """(start, characters) of overlapping windows over all places (in characters) and what is around them."""
    merged: list[list[int]] = []
    for a, b in places:
        a, b = max(0, a - AROUND), min(len(text), b + AROUND)
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out = []
    for a, b in merged:
        while True:
            out.append((a, text[a : a + SPAN]))
            if a + SPAN >= b:
                break
            a += STRIDE
    return out


def acceptable(kind: int, text: str) -> bool:
    """Whether a span that the tagger adds can be of its kind, however it is spelled."""
    d = digits_of(text)
    if kind == 0:
        return bool(EMAIL.fullmatch(DOT.sub(".", AT.sub("@", text, count=1)).encode()))
    if kind == 1:
        plain = DOT.sub(".", text)
        return bool(IP.fullmatch(plain)) and rule(1, plain)
    if kind == 2:
        return bool(re.fullmatch(r"[0-9][0-9 ./_-]+[0-9]", text)) and rule(2, text)
    return 9 <= len(d) <= 15 and bool(re.fullmatch(r"[+(]?[0-9][0-9 ()./-]+[0-9]", text)) and len(re.findall(r"[0-9]+", text)) > 1


def reconcile(found: list[tuple[int, int, int, float]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (kind, start, end, confidence) those apart from each other and from the base spans with the largest sum of
    log odds; ties keep what comes first."""
    best: dict[tuple[int, int, int], float] = {}
    for kind, a, b, c in found:
        if c >= CONFIDENCE and not any(x < b and a < y for _, x, y in base):
            best[kind, a, b] = max(best.get((kind, a, b), 0), c)
    spans = sorted(best, key=lambda s: (s[2], s[1], s[0]))
    sums: list[tuple[float, int, int]] = [(0.0, -1, -1)]  # after k spans: the sum, the last span taken, how many before it
    ends = [s[2] for s in spans]
    for k, s in enumerate(spans):
        before = int(np.searchsorted(ends[:k], s[1], side="right"))
        c = min(best[s], 1 - 1e-9)
        with_it = sums[before][0] + float(np.log(c / (1 - c)))
        sums.append((with_it, k, before) if with_it > sums[k][0] else (sums[k][0], -1, k))
    out, k = [], len(spans)
    while k > 0:
        _, taken, k = sums[k]
        if taken >= 0:
            out.append(spans[taken])
    return out


def characters(data: np.ndarray) -> np.ndarray:
    """Code points before each byte of UTF-8, and in all."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)))


def texts_of(block: pa.RecordBatch) -> Iterator[np.ndarray]:
    for t in block.column("text"):
        yield np.frombuffer(t.as_buffer(), dtype=np.uint8) if t.is_valid and len(t.as_buffer()) else np.zeros(0, np.uint8)


def spans_of(texts: list[np.ndarray], weights: dict | None) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans and added spans of each text, in code points."""
    base, jobs, found = [], [], [[] for _ in texts]
    for k, data in enumerate(texts):
        near = regions(data)
        if not near:
            base.append([])
            continue
        place = characters(data)
        base.append([(kind, int(place[a]), int(place[b])) for kind, a, b in base_spans(data)])
        if weights is not None:
            text = data.tobytes().decode()
            for start, chars in windows(text, [(int(place[a]), int(place[b])) for a, b in near]):
                jobs.append((k, start, chars, len(text)))
    for i in range(0, len(jobs), BATCH):
        some = jobs[i : i + BATCH]
        for (k, start, chars, size), spans in zip(some, decode([j[2] for j in some], weights), strict=True):
            for kind, a, b, c in spans:
                a, b = a + len(chars[a:b]) - len(chars[a:b].lstrip(BESIDE)), a + len(chars[a:b].rstrip(BESIDE))
                cut = a == 0 and start > 0 or b == len(chars) and start + b < size  # another window has it whole
                if not cut and acceptable(kind, chars[a:b]):
                    found[k].append((kind, start + a, start + b, c))
    return [(b, reconcile(f, b)) for b, f in zip(base, found, strict=True)]


# ---- labelled spans ----


def spelled(kind: int, text: str, rng: Random) -> str:
    """The same data in another spelling."""
    pick = rng.choice
    if kind == 0:
        name, _, host = text.rpartition("@")
        dot = pick([".", " dot ", "[dot]", " [dot] ", "(dot)", " (dot) ", "[.]"])
        at = pick([" at ", "[at]", " [at] ", "(at)", " (at) ", " @ ", "{at}", "@"])
        return name + at + host.replace(".", dot if at != " at " else " dot ")
    if kind == 1:
        return text.replace(".", pick(["[.]", "(.)", " . ", " dot ", "[dot]", "(dot)"]))
    if kind == 2:
        d, sep = digits_of(text), pick([".", "/", "_", "-", " ", " - "])
        return sep.join(d[k : k + 4] for k in range(0, len(d), 4))
    d, sep = digits_of(text), pick(["-", ".", " ", "/"])
    cut = [d[:-10], d[-10:-7], d[-7:-4], d[-4:]] if len(d) >= 10 else [d[:3], d[3:6], d[6:]]
    cut = [c for c in cut if c]
    if len(d) == 11 and d[0] == "1" and rng.random() < 0.6:
        cut = cut[1:]
    head = pick(["", "", "00"]) if len(cut) == 4 else ""
    if rng.random() < 0.4 and len(cut[-3]) == 3:
        cut[-3] = f"({cut[-3]})"
    return head + sep.join(cut)


def made(kind: int, words: list[str], rng: Random) -> str:
    """Data of a kind, made up."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: re.sub("[^A-Za-z]", "", rng.choice(words)) or "mail"
    if kind == 0:
        host = ".".join(word() + rng.choice(["", digits(1)]) for _ in range(rng.randint(1, 2)))
        return f"{word()}{rng.choice(['', '.' + digits(2), '_' + word(), '.' + word()])}@{host}.{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'edu', 'co'])}"
    if kind == 1:
        return ".".join(str(rng.randint(1, 255)) for _ in range(4))
    if kind == 2:
        d = digits(rng.choice([15, 16, 16, 16]))
        sep = rng.choice(["", "", " ", "-"])
        return sep.join(d[k : k + 4] for k in range(0, len(d), 4))
    a, b, c = digits(3), digits(3), digits(4)
    return f"+{rng.choice(['1', '1', '33', '49', '34', '44'])} " + rng.choice([f"({a}) {b}-{c}", f"{a} {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"])


def not_personal(rng: Random) -> str:
    """Digits and signs that are no personal data."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    return rng.choice([f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(1)},{digits(3)},{digits(3)}", digits(8), digits(6), f"{digits(2)}:{digits(2)}:{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(3)}.{digits(2)}", f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"', f"@{rng.choice('abcdef')}x", f"{digits(4)} {digits(4)}", f"# {digits(5)}", f"{digits(3)} at {digits(2)}", "meet at the dot on the map", f"${digits(4)}.{digits(2)}"])


def examples(samples: list[tuple[str, list[tuple[int, int, int]]]], seed: int = 11) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """Texts and spans to learn from, of windows and their base spans: as they are; with their spans spelled in other
    ways; and, where a window has none, with data made up or what isn't personal set in between its words."""
    rng = Random(seed)
    texts, spans = [], []
    for text, base in samples:
        for _ in range(3 if base else 2):
            other, own, end = "", [], 0
            if base:
                for kind, a, b in base:
                    if a < end:
                        continue
                    other += text[end:a]
                    new = text[a:b] if rng.random() < 0.35 else spelled(kind, text[a:b] if rng.random() < 0.5 else made(kind, text.split() or ["a"], rng), rng)
                    own.append((kind, len(other), len(other) + len(new)))
                    other, end = other + new, b
                other += text[end:]
            elif not re.search(r"[0-9@]", text) and " " in text and rng.random() < 0.9:
                at = rng.choice([m.start() + 1 for m in re.finditer(" ", text)])
                kind = rng.randrange(6)
                new = not_personal(rng) if kind > 3 else made(kind, text.split() or ["a"], rng)
                if kind <= 3 and rng.random() < 0.6:
                    new = spelled(kind, new, rng)
                other = text[:at] + new + rng.choice([" ", ", ", ". ", "\n", "!! "]) + text[at:]
                own = [(kind, at, at + len(new))] if kind <= 3 else []
            else:
                other = text
            start = max(0, min(own[0][1] - AROUND, len(other) - SPAN)) if own else 0
            texts.append(other[start : start + SPAN])
            spans.append([(k, a - start, b - start) for k, a, b in own if b - start <= SPAN])
    return texts, spans


def sample_windows(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(window, stratum): at most ``most`` windows each of those whose first base span is of a kind, of those with
    digits or signs but none, and of plain ones, by hash over all documents; a window counts once however often it
    occurs."""

    def cut(batches):
        for batch in batches:
            for block in blocks(batch, "text", 1 << 20):
                got: dict[tuple[str, int], None] = {}
                for data in texts_of(block):
                    if not len(data):
                        continue
                    text = data.tobytes().decode()
                    at = int(hashlib.md5(text[:64].encode()).hexdigest()[:8], 16) % len(text)
                    got[text[at : at + 64], 5] = None
                    if near := regions(data):
                        place = characters(data)
                        base = [(k, int(place[a]), int(place[b])) for k, a, b in base_spans(data)]
                        for a, b in near:
                            a = max(0, int(place[a]) - AROUND)
                            window = text[a : min(int(place[b]) + AROUND, a + SPAN)]
                            kinds = [k for k, x, y in base if x >= a and y <= a + len(window)]
                            got[window, kinds[0] if kinds else 4] = None
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in got], pa.string()), pa.array([s for _, s in got], pa.int32())], names=["window", "stratum"])

    x = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(cut, "window string, stratum int").groupBy("window", "stratum").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy(F.xxhash64("window"), "window"))
    return x.withColumn("rank", rank).filter(F.col("rank") <= most).select("window", "stratum")


def patterns(data: np.ndarray) -> list[tuple[int, int, int]]:
    """What the tagger is to learn of a window: matches of the patterns, apart from each other, long enough for their
    kind. Whether a card's digits add up is left to the rule, as no tagger sees it."""
    out, end = [], 0
    for k, a, b in sorted(base_spans(data, rules=False), key=lambda s: (s[1], -s[2])):
        d = len(digits_of(data[a:b].tobytes().decode()))
        if a >= end and (k == 0 or k == 1 and rule(1, data[a:b].tobytes().decode()) or k == 2 and 13 <= d <= 19 or k == 3 and 9 <= d <= 15):
            out.append((k, a, b))
            end = b
    return out


def learn(docs: DataFrame, most: int = SAMPLE) -> dict | None:
    """The tagger's weights, from a sample of 6 * ``most`` windows at most; none without texts."""
    found = sorted(r.window for r in sample_windows(docs, most).collect())
    samples = []
    for text in found:
        data = np.frombuffer(text.encode(), np.uint8)
        place = characters(data)
        samples.append((text, [(k, int(place[a]), int(place[b])) for k, a, b in patterns(data)]))
    return train(*examples(samples), len(KINDS)) if samples else None


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_personal(spark: SparkSession, docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): counts and digest of the base spans, and
    all spans as kind:start:end in code points."""
    weights = spark.sparkContext.broadcast(learn(docs, most))  # some 50 KB

    def find(batches):
        for batch in batches:
            for block in blocks(batch, "text", 1 << 20):
                both = spans_of(list(texts_of(block)), weights.value)
                counts = [[sum(s[0] == k for s in base) for base, _ in both] for k in range(len(KINDS))]
                digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in both]
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array([joined(base + more) for base, more in both], pa.string()), pa.array([len(more) for _, more in both], pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    x = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return x.mapInArrow(find, f"doc_id {x.schema['doc_id'].dataType.simpleString()}, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string, n_added long")
