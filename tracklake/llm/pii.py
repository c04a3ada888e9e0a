"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The field labels the words around each word with a digit, "@" or "+" (its neighbours included); it
is trained from a small labelled table by gradient ascent on the likelihood and decoded by Viterbi
in numpy, all windows of a slice with equal lengths at once. Words without those characters differ
by few features: a handful of cue words ("tel", "card") have one of their own. `fit` checks that the weights hold a run
of `REACH` of them at O, cue or not, so decoding windows gives what decoding whole texts would. Spans of the field that
touch a pattern's span are left out.

The field finds what the patterns leave: numbers written as phones without a "+", cards whose check digit is wrong.
Spans are told by kind and place; of equal ones one is kept.

Defined cases: a null or empty text has no spans; very long texts, words and runs of words are read whole, in time
linear in their length; of equally good labellings the first tag in the order of `TAGS` is taken; repeated rows give
equal results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.llm.common import rows, slices, text_only

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
REACH = 3

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Runs of digits are taken whole (a shorter one could not be followed by a dot), so no run is scanned twice.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TRIGGER = re.compile(r"[0-9@+]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches by kind; those that fail the checks drop out."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out["email"].append((start, m.end()))
            end = m.end()
        else:
            end = at  # the letters before cannot begin a later match: "@" is not among them
        at = text.find("@", at + 1)
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if len(m[0]) <= 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            out["phone"].append(m.span())
    return out


# ---------------------------------------------------------------- the field

FEATURES = 1 << 12
PUNCTUATION = ".,;:!?\"'"
# Words that announce a kind; the field learns what each is worth.
CUES = {"tel": "phone", "phone": "phone", "call": "phone", "fax": "phone", "mobile": "phone", "ring": "phone", "card": "card", "visa": "card", "pay": "card", "ip": "ip", "host": "ip", "server": "ip", "ssn": "none", "order": "none", "page": "none", "id": "none", "isbn": "none"}


def shape(word: str) -> str:
    return re.sub(r"[0-9]", "d", re.sub(r"[^\W\d_]+", "a", word))


def features(word: str) -> list[str]:
    """Word-shape features; words without trigger characters share a few of them."""
    if not TRIGGER.search(word):
        cue = CUES.get(word.strip(PUNCTUATION).lower()) if len(word) < 20 else None
        return ["plain", f"cue={cue}"] if cue else ["plain"]
    s = shape(word.strip(PUNCTUATION))
    short = re.sub(r"d+", "d", s)
    return ["shape=" + s, "short=" + short, f"digits={min(s.count('d'), 20)}", f"plus={s.startswith('+')}", f"at={'@' in s}", f"dots={min(s.count('.'), 4)}", f"letters={'a' in s}", f"first={s[:1]}", f"last={s[-1:]}"]


def slots(words: list[str]) -> list[list[int]]:
    """Feature numbers for each word: its own, and those of the words before and after."""
    own = [features(w) for w in words]
    out = []
    for i, f in enumerate(own):
        names = f + ["<" + x for x in (own[i - 1] if i else ["edge"])[:3]] + [">" + x for x in (own[i + 1] if i + 1 < len(own) else ["edge"])[:3]]
        out.append([zlib.crc32(x.encode()) % FEATURES for x in names])
    return out


def scores(sentence: list[list[int]], weights: np.ndarray) -> np.ndarray:
    return np.array([weights[f].sum(axis=0) for f in sentence])


def grouped(sentences: list[tuple[list[str], list[int]]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sentences of equal lengths together: feature numbers (sentences, words, slots; FEATURES fills up) and tags."""
    by_length = defaultdict(list)
    for x, y in sentences:
        if x:
            by_length[len(x)].append((slots(x), y))
    out = []
    for some in by_length.values():
        wide = max(len(f) for x, _ in some for f in x)
        out.append((np.array([[f + [FEATURES] * (wide - len(f)) for f in x] for x, _ in some]), np.array([y for _, y in some])))
    return out


def likelihood(groups: list[tuple[np.ndarray, np.ndarray]], w: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of labelled sentences and its gradients, by the forward-backward sums."""

    def log_sum(z, axis):
        m = z.max(axis=axis, keepdims=True)
        return np.squeeze(m, axis) + np.log(np.exp(z - m).sum(axis=axis))

    k, value = len(TAGS), 0.0
    padded = np.vstack([w, np.zeros(k)])
    dw, dt = np.zeros_like(padded), np.zeros_like(t)
    for x, y in groups:
        n, every = x.shape[1], np.arange(len(x))
        e = padded[x].sum(axis=2)
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0]
        for i in range(1, n):
            a[:, i] = e[:, i] + log_sum(a[:, i - 1, :, None] + t, 1)
        for i in range(n - 2, -1, -1):
            b[:, i] = log_sum(t + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2)
        total = log_sum(a[:, -1], 1)
        d = -np.exp(a + b - total[:, None, None])
        for i in range(n):
            d[every, i, y[:, i]] += 1
            value += e[every, i, y[:, i]].sum()
            if i:
                dt -= np.exp(a[:, i - 1, :, None] + t + (e[:, i] + b[:, i])[:, None, :] - total[:, None, None]).sum(axis=0)
                np.add.at(dt, (y[:, i - 1], y[:, i]), 1)
                value += t[y[:, i - 1], y[:, i]].sum()
        value -= total.sum()
        for slot in range(x.shape[2]):
            np.add.at(dw, x[:, :, slot].ravel(), d.reshape(-1, k))
    return value, dw[:-1], dt


def train(sentences: list[tuple[list[str], list[int]]], rounds: int = 120, step: float = 0.3, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (feature by tag) and transitions (tag by tag) by AdaGrad on the regularised log-likelihood."""
    k = len(TAGS)
    w, t = np.zeros((FEATURES, k)), np.zeros((k, k))
    gw, gt = np.full_like(w, 1e-8), np.full_like(t, 1e-8)
    groups = grouped(sentences)
    for _ in range(rounds):
        _, dw, dt = likelihood(groups, w, t)
        dw, dt = dw - decay * w, dt - decay * t
        gw += dw * dw
        gt += dt * dt
        w += step * dw / np.sqrt(gw)
        t += step * dt / np.sqrt(gt)
    return w, t


def viterbi(e: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Best tags of windows (windows, words, tags) of equal lengths."""
    best, back = e[:, 0], []
    for i in range(1, e.shape[1]):
        z = best[:, :, None] + t
        back.append(z.argmax(axis=1))
        best = z.max(axis=1) + e[:, i]
    path = [best.argmax(axis=1)]
    for k in reversed(back):
        path.append(k[np.arange(len(k)), path[-1]])
    return np.stack(path[::-1], axis=1)


CASES = {
    # templates; d is a digit, and the words of a span are its parts
    "phone": ["+d (ddd) ddd-dddd", "(ddd) ddd-dddd", "ddd-ddd-dddd", "ddd.ddd.dddd", "+dd ddd ddddddd", "+dd dd dddd dddd", "+d-ddd-ddd-dddd", "+dd (d) ddd dddddd", "+ddddddddddd", "00dd dd dddd dddd", "0ddd ddd dddd", "0dd dddd dddd", "0dddd dddddd", "ddd ddd dddd", "(0dd) dddd-dddd", "00ddddddddddd"],
    "email": ["amo@anna.com", "ile.ora@mail.example.org", "xu_7@host.net", "ab+tag@site.co.uk", "t9@box.io"],
    "ip": ["dd.dd.dd.ddd", "ddd.dd.d.dd", "d.dd.ddd.dd", "ddd.ddd.d.d"],
    "card": ["dddd dddd dddd dddd", "dddd-dddd-dddd-dddd", "dddddddddddddddd", "dddd dddddd ddddd"],
    "": ["dddd", "dd", "d.d", "d.dd", "dddd-dd-dd", "d,ddd", "dd%", "ddth", "v d.d", "d+d", "@", "@ana", "d.d.d", "dd:dd", "page dd", "dd - dd", "d dd", "ddd ddd", "Version d.d.", "+d", "+", "dddd,", "ddd-ddd", "dd/dd/dddd", "dddddd", "x dd y d", "a1 b22",
         "ddd-dd-dddd", "ssn ddd-dd-dddd", "order dddddddd", "order ddddddddd", "isbn ddd-d-dd-dddddd-d", "id dddddddddd", "dddd dddd", "dddd-dddd", "dd.dd.dddd", "ddddd ddddd", "ddd ddd ddd", "d ddd ddd", "dddddddd", "dd dd dd", "dddd dd dd", "a-dddd-bb"],
}
ANNOUNCED = {"phone": ["tel", "call", "Phone:", "mobile", "ring"], "card": ["card", "visa"], "ip": ["host", "ip", "server"], "email": ["and"]}


def labelled(spark: SparkSession) -> DataFrame:
    """The labelled table: sentence, position, word, tag. Made by rule from the templates, with and without a cue before."""
    plans = [[(k, x)] for k in CASES for x in CASES[k] for _ in range(4)]
    plans += [[("cue", cue), (k, x)] for k in ANNOUNCED for x in CASES[k] for cue in ANNOUNCED[k]]
    plans += [[("cue", cue), ("", x)] for k in ANNOUNCED for cue in ANNOUNCED[k] for x in ("dd", "dddd", "the word")]  # a cue alone says nothing
    plans += [[("cue", a), ("cue", b)] for a in ("tel", "card", "ip", "ssn", "order") for b in ("phone", "visa", "host", "page", "id")]
    some = [(k, x) for k in KINDS for x in CASES[k][:4]]
    plans += [[p, q] for p in some for q in some if p[0] != q[0]]  # neighbours without a word between
    plans += [[p, q, r] for p in some[::4] for q in some[1::4] for r in some[2::4] if len({p[0], q[0], r[0]}) == 3]
    lead, tail = ["the word of", "and", "", "Ab cd to in"], ["and the of", "in.", "", "or und le la"]
    seed, out = 12345, []
    for sentence, plan in enumerate(plans):
        words, tags = lead[sentence % 4].split(), []
        tags += ["O"] * len(words)
        for kind, template in plan:
            filled = ""
            for c in template:
                seed = (seed * 1103515245 + 12345) % (1 << 31)
                filled += str(seed // 65536 % 10) if c == "d" and kind not in ("email", "cue") and template != "the word" else c
            words += filled.split()
            tags += [f"{'I' if i else 'B'}-{kind}" if kind in KINDS else "O" for i in range(len(filled.split()))]
        more = tail[(sentence // 4 + sentence) % 4].split()
        words, tags = words + more, tags + ["O"] * len(more)
        out += [(sentence, i, w, t) for i, (w, t) in enumerate(zip(words, tags, strict=True))]
    return spark.createDataFrame(out, "sentence int, position int, word string, tag string")


def fit(table: DataFrame, most: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """Trains on a small labelled table (at most `most` sentences are read)."""
    grouped = defaultdict(list)
    for r in table.where(F.col("sentence") < most).orderBy("sentence", "position").collect():
        grouped[r.sentence].append((r.word, TAGS.index(r.tag)))
    w, t = train([([x for x, _ in s], [y for _, y in s]) for s in grouped.values()])
    plain = ["a", *CUES]
    held = min((e[0] - e[1:]).min() for x in plain for y in plain for z in plain for e in (scores(slots([x, y, z]), w)[1],))
    if REACH * held <= 2 * np.abs(t).max():
        raise ValueError("plain words are not held at O; train with more plain sentences")
    return w, t


WORD, NEXT = re.compile(r"\S+"), re.compile(r"\s*(\S+)")


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Spans of words around the trigger words, runs of plain words between windows being longer than twice REACH."""
    out: list[list[tuple[int, int]]] = []
    done = 0

    def follow() -> None:
        """Gives the last window the words after it."""
        at = done
        for _ in range(REACH):
            if not (m := NEXT.match(text, at)):
                break
            out[-1].append(m.span(1))
            at = m.end()

    for m in TRIGGER.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        word = WORD.match(text, start)
        before: list[tuple[int, int]] = []
        at = start
        while len(before) < 2 * REACH and at > done:
            while at > done and text[at - 1].isspace():
                at -= 1
            end = at
            while at > done and not text[at - 1].isspace():
                at -= 1
            if at < end:
                before.append((at, end))
        before.reverse()
        if out and len(before) < 2 * REACH:
            out[-1] += [*before, word.span()]
        else:
            if out:
                follow()
            out.append([*before[-REACH:], word.span()])
        done = word.end()
    if out:
        follow()
    return out


def window_slots(text: str, spans: list[tuple[int, int]]) -> list[list[int]]:
    """Feature numbers of a window's words; the words next to it count as neighbours of its ends."""
    end = spans[0][0]
    while end and text[end - 1].isspace():
        end -= 1
    start = end
    while start and not text[start - 1].isspace():
        start -= 1
    after = NEXT.match(text, spans[-1][1])
    words = [text[start:end]] * (end > 0) + [text[s:e] for s, e in spans] + ([after[1]] if after else [])
    return slots(words)[int(end > 0) : len(words) - bool(after)]


def field_spans(texts: list[str], w: np.ndarray, t: np.ndarray) -> list[list[tuple[str, int, int]]]:
    """Spans found by the field in each text."""
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    by_length = defaultdict(list)
    for d, text in enumerate(texts):
        if TRIGGER.search(text):
            for spans in windows(text):
                by_length[len(spans)].append((d, spans))
    for group in by_length.values():
        size = max(1, 20_000 // len(group[0][1]))
        for g in range(0, len(group), size):
            some = group[g : g + size]
            e = np.stack([scores(window_slots(texts[d], spans), w) for d, spans in some])
            for (d, spans), path in zip(some, viterbi(e, t), strict=True):
                open_kind, begin, end = "", 0, 0
                for (s, f), k in zip([*spans, (0, 0)], [*path, 0], strict=True):
                    tag = TAGS[k]
                    if open_kind and tag == f"I-{open_kind}" and TRIGGER.search(texts[d], s, f):
                        end = f
                        continue
                    if open_kind:
                        found[d].append((open_kind, begin, end))
                    open_kind, begin, end = (tag[2:], s, f) if tag[0] == "B" else ("", 0, 0)
    return found


LEAST = {"phone": (9, 15), "card": (13, 19)}


def spans_of(texts: list[str], w: np.ndarray, t: np.ndarray) -> list[tuple[dict, list[tuple[str, int, int]]]]:
    """For each text the pattern spans by kind, and all spans by kind and start."""
    out = []
    for text, extra in zip(texts, field_spans(texts, w, t), strict=True):
        base = base_spans(text)
        taken = sorted(s for v in base.values() for s in v)
        every = [(k, *s) for k in KINDS for s in base[k]]
        for kind, s, e in extra:
            while s < e and text[e - 1] in PUNCTUATION:
                e -= 1
            digits = sum(map(str.isdigit, text[s:e]))
            low, high = LEAST.get(kind, (0, 1 << 30))
            if s < e and low <= digits <= high and (kind != "email" or "@" in text[s + 1 : e - 1]) and (kind != "ip" or text[s:e].count(".") == 3) and not any(a < e and s < b for a, b in taken):
                every.append((kind, s, e))
        out.append((base, sorted(set(every), key=lambda x: (KINDS.index(x[0]), x[1], x[2]))))
    return out


def find(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, counts and digest of the pattern spans, all spans, and how many these are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x tags, whatever the data
    schema = [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())]

    def run(batches):
        w, t = shared.value
        for b in slices(batches):
            out = []
            for base, every in spans_of(b.column("text").to_pylist(), w, t):
                text = ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in base[k])
                out.append((*(len(base[k]) for k in KINDS), hashlib.sha256(text.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for k, s, e in every), len(every)))
            yield rows(schema, b.column("doc_id"), *map(list, zip(*out, strict=True)))

    return text_only(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """docs (all its columns) with each span in text replaced by its kind in brackets."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        w, t = shared.value
        for b in slices(batches):
            texts, out = b.column("text").to_pylist(), []
            for text, (_, every) in zip(texts, spans_of([x or "" for x in texts], w, t), strict=True):
                if text is not None:
                    parts, at = [], 0
                    for k, s, e in sorted(every, key=lambda x: (x[1], -x[2])):
                        if s >= at:
                            parts += [text[at:s], f"[{k.upper()}]"]
                        at = max(at, e)
                    text = "".join([*parts, text[at:]])
                out.append(text)
            yield b.set_column(place, b.schema.field("text"), pa.array(out, b.schema.field("text").type))

    return docs.mapInArrow(run, docs.schema)
