"""Personal data: fixed patterns, and candidates of generous generators judged by boosted trees with calibrated thresholds."""

from __future__ import annotations

import bisect
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.llm.boosting import fit_trees, predict, threshold
from stratum.llm.common import Taken, col, map_rows, ship, texts

KINDS = ("email", "ip", "card", "phone", "email_found", "ip_found", "card_found", "phone_found")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Possessive repeats: no text makes these step back, so time grows with the length of a text alone.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
#: High-recall generators: an at sign or its spelling with words around it; digits with up to six marks between them.
AT = re.compile(r"@|\s?[\[({<]\s?at\s?[\])}>]\s?|\sat\s(?=[^\s@|]+(?:\sdot\s|\s?[\[({<]\s?(?:dot|\.)))", re.IGNORECASE)
DOT = re.compile(r"\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s", re.IGNORECASE)
AFTER_AT = re.compile(rf"\s?[^\s@|]+(?:(?:{DOT.pattern})[^\s@|]+)*", re.IGNORECASE)
EDGE = "()[]{}<>,.;:!?\"'"
GAP = r"(?:[^A-Za-z0-9\n]{0,6}|\x20?[\[({<]?\x20?dot\x20?[\])}>]?\x20?)"
LOOSE_DIGITS = re.compile(rf"[+(]?[0-9](?:{GAP}[0-9]){{3,}}")
#: Parts of such digits: no kind has more than MOST digits, and but for four groups of up to three none has less than LEAST.
#: Marks between items of a list; digits beside a span; forms in a list.
LEAST, MOST, GROUPS = 6, 19, 6
#: Candidates that are judged at a time.
STEP = 1 << 13
DIGITS = re.compile("[0-9]+")
DIGIT_ONLY = re.compile("[^0-9]+")
LISTED = re.compile(r"[,;/|\t]")
BEFORE, AFTER = re.compile(r"[0-9][^A-Za-z0-9\n]{0,6}$"), re.compile(r"[^A-Za-z0-9\n]{0,6}[0-9]")
CARD_FORM = re.compile(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(\1[0-9]{1,3})?|[0-9]{4}([ -])[0-9]{6}\3[0-9]{4,5}")
PLAIN_PHONE = re.compile(r"\([0-9]{2,4}\) ?[0-9]{3,4}[ .-][0-9]{4}|(?:1[ .-])?[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}")
NOISE = re.compile(r"[^A-Za-z0-9.+@()\x20-]+")
HINTS = ("mail", "ip", "card", "phone", "tel", "call", "address", "contact", "server", "visa", "fax")
SPANS = T.StructType([T.StructField("spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans in code points, by kind as listed, then start."""
    found: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            done = m.end()
            found.append(("email", start, done))
        else:
            done = at + 1
        at = text.find("@", done)
    if DIGIT.search(text):
        for m in DOTTED.finditer(text):
            parts, start = m[0].split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                own = parts[i : i + 4]
                end = start + sum(map(len, own)) + 3
                if all(map(_octet, own)):
                    found.append(("ip", start, end))
                start = end + 1
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return found


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def candidates(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, has an at sign) of every span that a generator proposes; they may overlap."""
    out = [(s, e, True) for s, e in _loose_emails(text)] if "@" in text or AT.search(text) else []
    if DIGIT.search(text):
        for m in LOOSE_DIGITS.finditer(text):
            out += [(s, e, False) for s, e in _parts(text, m.start(), m.end())]
    return out


def _loose_emails(text: str) -> list[tuple[int, int]]:
    """The words at both sides of each at sign, with and without the marks at their edges."""
    out, signs = [], list(AT.finditer(text))
    for i, m in enumerate(signs):
        least = signs[i - 1].end() if i else 0
        start = m.start()
        if m[0] == "@" and start > least and text[start - 1].isspace():
            start -= 1
        while start > least and not text[start - 1].isspace() and text[start - 1] not in "@|":
            start -= 1
        right = AFTER_AT.match(text, m.end(), signs[i + 1].start() if i + 1 < len(signs) else len(text))
        if right and text[start : m.start()].strip():
            end = right.end()
            out.append((start, end))
            low, high = start, end
            while low < m.start() and text[low] in EDGE:
                low += 1
            while high > m.end() and text[high - 1] in EDGE:
                high -= 1
            if (low, high) != (start, end) and low < m.start() and high > m.end():
                out.append((low, high))
    return out


def _parts(text: str, begin: int, stop: int) -> list[tuple[int, int]]:
    """Parts of a run of digits and marks, between marks, that have as many digits as some kind has, and the whole run.

    A part has up to GROUPS groups of digits, or any number if it begins the run or a plus or bracket begins it.
    """
    groups = [(m.start(), m.end()) for m in DIGITS.finditer(text, begin, stop)]
    out = [(begin, stop)] if sum(e - s for s, e in groups) >= LEAST else []
    for i, (start, _) in enumerate(groups):
        while start > begin and text[start - 1] in "+(":
            start -= 1
        n, mine = 0, []
        for j in range(i, len(groups)):
            low, high = groups[j]
            n += high - low
            if n > MOST or (j - i >= GROUPS and i and text[start] not in "+("):
                break
            four = j == i + 3 and all(e - s <= 3 for s, e in groups[i : j + 1])
            if (n >= LEAST or four) and (start, high) not in out[:1]:
                mine.append((start, high))
        out += reversed(mine)
    return out


def disguised(text: str, rng: random.Random) -> tuple[str, list[tuple[int, int, str | None]]]:
    """A text with each base span written another way, and the spans' new places and kinds: training's own truth.

    In a third of the addresses and cards a digit is changed so that they are none: their kind is None.
    """
    out, truth, at, length = [], [], 0, 0
    for kind, start, end in sorted(base_spans(text), key=lambda s: (s[1], -s[2])):
        if start < at:
            continue
        span, label = text[start:end], kind
        if kind in ("ip", "card") and rng.random() < 1 / 3:
            span, label = _spoilt(kind, span, rng), None
        span = DISGUISES[kind](span, rng)
        out += [text[at:start], span]
        length += start - at
        truth.append((length, length + len(span), label))
        length += len(span)
        at = end
    return "".join([*out, text[at:]]), truth


def _spoilt(kind: str, span: str, rng: random.Random) -> str:
    if kind == "ip":
        parts = span.split(".")
        parts[rng.randrange(4)] = str(rng.randint(256, 999))
        return ".".join(parts)
    last = span[-1]
    return span[:-1] + rng.choice([d for d in "0123456789" if d != last])


def _disguise_email(span: str, rng: random.Random) -> str:
    at = rng.choice(["[at]", " [at] ", "(at)", " (at) ", " at ", " AT ", "{at}", "<at>", " @ ", "@ "])
    dot = rng.choice([".", "[dot]", " [dot] ", "(dot)", " dot ", " DOT ", "[.]", "{dot}"]) if at != " at " else " dot "
    local, domain = span.split("@", 1)
    return local + at + domain.replace(".", dot)


def _disguise_ip(span: str, rng: random.Random) -> str:
    return span.replace(".", rng.choice(["[.]", "(.)", " . ", "{.}", "[dot]", " dot ", ". ", ",", "-"]))


def _disguise_card(span: str, rng: random.Random) -> str:
    digits, mark = DIGIT_ONLY.sub("", span), rng.choice([".", "/", "_", " - ", "  ", ":", "~", "*"])
    size = rng.choice([4, 4, 4, 5, 6])
    return mark.join(digits[i : i + size] for i in range(0, len(digits), size))


def _disguise_phone(span: str, rng: random.Random) -> str:
    groups, mark = DIGITS.findall(span), rng.choice([".", "/", "_", " - ", "  ", "~", " / ", "--"])
    form = rng.randrange(4)
    if form == 0:
        return "+" + mark.join(groups) if mark not in ("-", " ", ".") or len(groups) == 1 else "00" + mark.join(groups)
    if form == 1:
        return "00" + groups[0] + mark + mark.join(groups[1:]) if len(groups) > 1 else "00" + groups[0]
    if form == 2 and len(groups) > 2:
        return f"({groups[0]}){mark}" + mark.join(groups[1:])
    return "+" + " ".join("".join(groups))


DISGUISES = {"email": _disguise_email, "ip": _disguise_ip, "card": _disguise_card, "phone": _disguise_phone}


def kind_of(text: str, begin: int, stop: int) -> str | None:
    """What a span is once marks that don't belong are taken out of it: the distant label of training. Parts of words are none."""
    span = text[begin:stop]
    if text[begin - 1 : begin].isalnum() or text[stop : stop + 1].isalnum():
        return None
    clean = NOISE.sub("", DOT.sub(".", AT.sub("@", span)))
    clean = clean.replace(" ", "") if "@" in clean else clean
    part = bool(BEFORE.search(text[max(0, begin - 7) : begin]) or AFTER.match(text, stop))
    if part and "@" not in clean:  # an item of a list of numbers: whole by itself, and of a usual form
        if LISTED.search(span) or re.search(r"[0-9][.-]$", text[max(0, begin - 2) : begin]) or re.match(r"[.-][0-9]", text[stop : stop + 2]):
            return None
    bare = clean.strip(" .-")
    if PLAIN_PHONE.fullmatch(bare):
        return "phone"
    for kind, start, end in base_spans(clean):
        if end - start >= 0.9 * len(clean.strip(" ().-")) and not (part and kind == "card" and not CARD_FORM.fullmatch(bare)):
            return kind
    return None


def features(text: str, start: int, end: int, at_sign: bool) -> list[float]:
    """Format of the span and its context."""
    span = text[start:end]
    digits = "".join(c for c in span if c in "0123456789")
    groups = DIGITS.findall(span)
    gaps = set(DIGITS.split(span)[1:-1])
    words = re.findall("[a-z]+", text[max(0, start - 30) : start].lower())[-3:]
    tail = re.split("[^A-Za-z0-9]+", span.rstrip(".,;!?*&%$# "))[-1]
    sound = [g for g in groups if len(g) <= 3 and int(g) <= 255]
    return [
        float(at_sign), len(span), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        span.count("."), span.count("-"), span.count(" "), span.count("("), float(span.startswith("+")), float("+" in text[max(0, start - 2) : start]),
        sum(len(x) for x in NOISE.findall(span)), float(luhn(digits)) if digits else 0.0, len(sound), len(tail), float(tail.isalpha()),
        sum(c.isalpha() for c in span), float(any(h in w for w in words for h in HINTS)), float(start > 0 and text[start - 1].isalnum()),
        float(end < len(text) and text[end].isalnum()), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0,
        float(bool(BEFORE.search(text[max(0, start - 7) : start]))), float(bool(AFTER.match(text, end))), float(len(LISTED.findall(span))),
        float(len(groups) == len(sound) == 4), len(gaps), float(any("dot" in g.lower() or "[" in g or "(" in g for g in gaps)), max(map(len, gaps), default=0),
        float(13 <= len(digits) <= 19 and luhn(digits)), float(span.startswith("00")), float(bool(PLAIN_PHONE.fullmatch(span))),
    ]


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, max_docs: int = 8000, max_spans: int = 24000, precision: float = 0.9) -> dict:
    """Trees for each kind and their thresholds, fitted on a bounded sample: about max_docs rows, max_spans candidates.

    Rows are chosen by a hash of the id, candidates by a hash of their text, so the model does not depend on how rows are
    dealt out. Labels are of two sorts. Every text is taken once more with its base spans disguised (spelled out, other
    marks, other groups; some spoilt), where each candidate that is such a span bears its kind and those that meet it
    otherwise bear none. A candidate of the text itself bears the kind that it has once foreign marks are taken out. Two
    thirds of the candidates grow the trees; on the others each kind's threshold is the least that reaches `precision`.
    """
    ship(df.sparkSession)
    share = F.pmod(F.xxhash64(col(id_col)), F.lit(max(1, df.count() // max_docs))) == 0
    sample = df.where(share & col(text_col).isNotNull()).select(col(text_col).alias("text"))

    def examples(batches):
        for batch in batches:
            found = [(zlib.crc32(t.encode()), x, k) for t in texts(batch.column(0)) for x, k in labelled(t)]
            columns = [pa.array([h for h, *_ in found], pa.int64()), pa.array([x for _, x, _ in found], pa.list_(pa.float64())), pa.array([k for *_, k in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["hash", "x", "kind"])

    rows = sample.mapInArrow(examples, "hash long, x array<double>, kind string").orderBy("hash", "x", "kind").limit(max_spans).collect()
    model: dict = {}
    if rows:
        x = np.array([r.x for r in rows])
        own = np.array([mixed % 3 != 0 for mixed in (r["hash"] for r in rows)])  # a text's candidates stay together
        for kind in KINDS[:4]:
            y = np.array([float(r.kind == kind) for r in rows])
            if 5 <= y[own].sum() and y[~own].any():
                trees = fit_trees(x[own], y[own])
                model[kind] = (trees, threshold(predict(trees, x[~own]), y[~own], precision))
    return model


def labelled(text: str) -> list[tuple[list[float], str | None]]:
    """Features and kinds of the candidates of a text and of its disguised form."""
    out = [(features(text, *c), kind_of(text, *c[:2])) for c in candidates(text)]
    other, truth = disguised(text, random.Random(zlib.crc32(text.encode())))
    starts = [s for s, _, _ in truth]
    for c in candidates(other) if truth else []:
        for s, e, kind in truth[max(0, bisect.bisect_right(starts, c[0]) - 1) :]:
            if s >= c[1]:
                break
            if c[0] < e:
                out.append((features(other, *c), kind if (c[0], c[1]) == (s, e) else None))
                break
    return out


def all_spans(texts_: list[str], model: dict) -> list[list[Span]]:
    """Base spans, all of them, and accepted candidates that overlap neither them nor a surer candidate; ties go to the
    earlier proposed."""
    base = [base_spans(t) for t in texts_]
    taken = [Taken((s, e) for _, s, e in b) for b in base]
    fit: list[tuple[float, int, str, int, int, int]] = []  # minus sureness, number, kind, text, start, end
    asked: list[tuple[int, int, int]] = []
    rows: list[list[float]] = []
    number = 0

    def judge() -> None:
        nonlocal number
        x = np.array(rows)
        sure = np.stack([predict(model[k][0], x) - model[k][1] for k in kinds])
        which = sure.argmax(0)
        for j in np.flatnonzero(sure.max(0) >= 0).tolist():
            fit.append((-float(sure[which[j], j]), number + j, kinds[which[j]], *asked[j]))
        number += len(rows)
        asked.clear()
        rows.clear()

    kinds = [k for k in KINDS[:4] if k in model]
    for i, t in enumerate(texts_):
        for c in candidates(t) if kinds else ():
            if not taken[i].meets(c[0], c[1]):
                asked.append((i, c[0], c[1]))
                rows.append(features(t, *c))
                if len(rows) >= STEP:
                    judge()
    if rows:
        judge()
    for _, _, kind, i, s, e in sorted(fit):
        if not taken[i].meets(s, e):
            taken[i].add(s, e)
            base[i].append((kind + "_found", s, e))
    return [sorted(b, key=lambda s: (KINDS.index(s[0]), s[1])) for b in base]


def find_personal_data(df: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with a column spans: array<struct<kind, start, end>>, in code points, end exclusive, by kind, then start.

    Null and empty texts have none; texts are read whole, in time that grows with their length. Rows that repeat get equal
    spans, an empty table gives an empty one. One pass, no shuffle. An input column named spans, in any case, is replaced.
    """

    def make():
        return lambda column: [[[{"kind": k, "start": s, "end": e} for k, s, e in row] for row in all_spans(texts(column), model)]]

    return map_rows(df, [text_col], SPANS, make, keep)


def redact(df: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """df, each span of its texts replaced by its kind in brackets (overlapping spans by one); null texts stay null."""

    def one(text, spans):
        out, at = [], 0
        for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
            if start >= at:
                out += [text[at:start], f"[{kind.removesuffix('_found').upper()}]"]
            at = max(at, end)
        return "".join(out) + text[at:]

    def make():
        def run(column):
            given = column.to_pylist()
            return [[None if t is None else one(t, s) for t, s in zip(given, all_spans(["" if t is None else t for t in given], model))]]

        return run

    order = df.columns
    return map_rows(df, [text_col], T.StructType([T.StructField(text_col, T.StringType())]), make).select(*[col(c) for c in order])
