"""Secret scans: fixed patterns, and a linear-chain conditional random field that tags tokens begin, inside or outside.

A text is one chain of tokens, line ends among them. A token's score sums the weights of its shape and letters, of the words
up to four before and two after it, and of the whole file. Labels of training go beyond the fixed patterns: secrets of many
forms, and look-alikes that are none, are set into lines of the sampled texts.

Decoding is Viterbi's over whole texts. Where a token's score for outside beats its others by more than any change of its
neighbours' labels could make up, it is outside on every best path, so the chain falls apart there and only what lies between
such tokens needs the recursion.
"""

from __future__ import annotations

import base64
import math
import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.llm.common import Taken, col, map_rows, ship, texts
from stratum.llm.crf import fit, viterbi

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A line end, a sign that assigns, or a run without white space, quotes, brackets and separators.
TOKEN = re.compile(r"""\n|[:=]|[^\s"'`,;:=(){}\[\]<>|]+""")
EDGE = ".!?"
O, B, I = range(3)
FORBIDDEN = np.array([[False, False, True], [False, False, False], [False, False, False]])  # outside never before inside
#: Places whose words count for a token: itself, those before, those after.
PLACES = (0, -1, -2, -3, -4, 1, 2)
REMEMBER = 500_000
SPANS = T.StructType([T.StructField("spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
_DIGITS, _UPPER, _LOWER = (set(x) for x in ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns' spans in code points, by start, then kind."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# --- features ---


def is_word(bare: str) -> bool:
    """Letters, small but for the first, as nearly all tokens are."""
    return 2 <= len(bare) <= 20 and bare.isalpha() and bare[1:].islower()


def own_features(token: str) -> list[str]:
    """Shape and letters of a token."""
    bare = token.rstrip(EDGE)
    n = len(bare)
    if n < 2:
        return ["bias", "w=" + token.lower()]
    if is_word(bare):
        return ["bias", "w=" + bare.lower(), f"word={n // 4}", f"word,capital={bare[0].isupper()}"]
    kinds = (bool(set(bare) & _UPPER), bool(set(bare) & _LOWER), bool(set(bare) & _DIGITS))
    digits = sum(c in _DIGITS for c in bare)
    marks = sum(not c.isalnum() for c in bare)
    shape = re.sub(r"(.)\1+", r"\1", "".join("9" if c in _DIGITS else "A" if c in _UPPER else "a" if c.isalpha() else c for c in bare[:64]))
    entropy = int(2 * -sum(c / n * math.log2(c / n) for c in Counter(bare).values()))
    turns = sum(a != b for a, b in zip(shape, shape[1:]))
    vowels = sum(map(bare.lower().count, "aeiou"))
    hexa = "low" if not re.search("[^0-9a-f]", bare) else "up" if not re.search("[^0-9A-F]", bare) else "no"
    out = [
        "bias", f"shape={shape[:8]}", f"len={min(n, 80) // 4}", f"kinds={kinds}", f"kinds,len={kinds},{min(n, 48) // 6}", f"digits={digits * 5 // n}", f"marks={min(marks, 4)}",
        f"entropy={entropy}", f"entropy,len={entropy},{min(n, 48) // 8}", f"turns={min(turns, 12) // 2}", f"vowels={vowels * 6 // n}", f"hex,len={hexa},{min(n, 64) // 8}", f"start={bare[:4].lower()}",
    ]
    if n <= 20:
        out.append("w=" + bare.lower())
    if marks:
        parts = [p for p in re.split("[^A-Za-z0-9]+", bare) if p]
        out.append(f"parts={min(len(parts), 6)},{all(p.isalpha() for p in parts)},{min(max(map(len, parts), default=0), 40) // 5}")
        out += [f"mark={c}" for c in set(bare) if not c.isalnum() and c.isascii()]
    return out


def word_features(token: str) -> list[str]:
    """What a token is to its neighbours."""
    bare = token.rstrip(EDGE).lower()
    kind = "word" if bare.isalpha() else "number" if bare.isdigit() else token if len(token) == 1 else "long" if len(bare) > 20 else "mixed"
    return ["c=" + kind] if len(bare) > 20 else ["c=" + kind, "w=" + (bare or token)]


def file_features(text: str) -> list[str]:
    n = 1 + len(text)
    share = lambda k: min(6, int(math.log2(1 + 1000 * k / n)))
    return [f"file marks={share(sum(map(text.count, '=:;{}')))}", f"file lines={share(text.count(chr(10)))}", f"file loud={text.isupper()}"]


# --- training ---

#: Words that announce secrets (and as often do not); what stands between them and a value; what announces other values.
CUES = (
    "password", "passwd", "passphrase", "pass", "pwd", "pw", "secret", "token", "key", "apikey", "api_key", "auth", "authorization", "bearer", "credential",
    "credentials", "login", "pin", "private", "signature", "session", "cookie", "access_token", "client_secret", "private_key", "kennwort", "clave", "motdepasse",
)
JOINS = (": ", "=", " = ", " is ", " -> ", " => ", " := ", ':"', "='", " ", " was ", "(", " - ")
OTHERS = ("version", "file", "date", "id", "order", "ref", "see", "at", "path", "host", "class", "page", "isbn", "release", "build", "total")
_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def _some(rng: random.Random, letters: str, low: int, high: int) -> str:
    return "".join(rng.choices(letters, k=rng.randint(low, high)))


def _secret(rng: random.Random, words: list[str]) -> tuple[str, bool]:
    """A made-up secret, and whether it is one by its looks alone."""
    form = rng.randrange(8)
    if form == 0:
        return rng.choice("-_.+").join(rng.choice(words) for _ in range(rng.randint(3, 5))), False
    if form == 1:
        return _some(rng, _ALNUM, 3, 7) + rng.choice("!@#$%^&*?+~") + _some(rng, _ALNUM + "!@#$%^&*", 3, 8), False
    if form == 2:
        return base64.b64encode(rng.randbytes(rng.randint(15, 40))).decode(), True
    if form == 3:
        return _some(rng, "0123456789ABCDEF", 24, 64), True
    if form == 4:
        text = rng.randbytes(16).hex()
        return "-".join(text[a:b] for a, b in ((0, 8), (8, 12), (12, 16), (16, 20), (20, 32))), False
    if form == 5:
        return _some(rng, "abcdefghijklmnopqrstuvwxyz", 2, 4) + rng.choice("_-") + _some(rng, _ALNUM, 20, 36), True
    if form == 6:
        part = lambda k: base64.urlsafe_b64encode(rng.randbytes(k)).decode().rstrip("=")
        return f"eyJ{part(rng.randint(12, 24))}.eyJ{part(rng.randint(18, 40))}.{part(32)}", True
    return _some(rng, _ALNUM, 8, 24), False


def _harmless(rng: random.Random, words: list[str]) -> str:
    """A made-up value that is no secret."""
    n = lambda k: rng.randint(0, 10**k)
    word = lambda: rng.choice(words)
    return rng.choice([
        f"{n(1)}.{n(2)}.{n(1)}", f"20{n(1)}{n(1)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", f"{word()}{n(2)}.txt", f"/{word()}/{word()}/{word()}.html", f"{word().title()}{word().title()}{word().title()}",
        f"{word()}_{word()}_{n(3)}", f"{word()}@{word()}.org", f"#{rng.randbytes(3).hex()}", f"{n(9)}", f"978-{n(1)}-{n(4)}-{n(4)}-{n(1)}", f"{n(2)}:{n(2)}:{n(2)}", f"{n(4)}.{n(3)}", f"{word()}-{word()}",
        f"https://{word()}.{word()}.net/{word()}?{word()}={n(3)}", f"{word()}.{word()}.{word()}", f"{word()}/{word()}", f"v{n(1)}.{n(1)}-rc{n(1)}", f"{n(3)},{n(3)}", f"{word().upper()}_{word().upper()}",
        f"{word()}-{word()}-{word()}-{word()}", rng.randbytes(4).hex(), word(), word() + " " + word(),
    ])


def example(text: str, rng: random.Random, reach: int = 12) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines for training with the secrets in them: stretches of the text around its base spans, and around what is set in."""
    words = re.findall(r"[^\W\d_]{2,12}", text)[:2000] or ["text"]
    base = [(m.start(2), m.end(2)) if (m := ASSIGN.match(text, s)) and m.end() == e else (s, e) for _, s, e in base_spans(text)]
    spots = [(s, e) for s, e in base if e - s < 400]
    gaps = [m.start() for m in re.finditer(r"\s", text)] or [len(text)]
    out = []

    def around(whole: str, low: int, high: int, secrets: list[tuple[int, int]]) -> None:
        begin, end = max(0, low - 10 * reach), min(len(whole), high + 6 * reach)
        begin = next((i + 1 for i in range(begin, low) if whole[i].isspace()), low) if begin else 0
        out.append((whole[begin:end], [(s - begin, e - begin) for s, e in secrets if begin <= s and e <= end]))

    for s, e in rng.sample(spots, min(3, len(spots))):
        around(text, s, e, spots)
    for hidden in (False, True, False):
        value, plain = _secret(rng, words) if not hidden else (_harmless(rng, words), False)
        cue = "" if plain and rng.random() < 0.4 else rng.choice(OTHERS) + rng.choice(JOINS) if hidden and rng.random() < 0.5 else rng.choice(CUES) + rng.choice(JOINS)
        if hidden and cue and cue.split("=")[0].strip(" :'\"(").lower() in CUES and ("=" in cue or ":" in cue):
            value = rng.choice(words)  # even assigned, a single common word or two are prose
            cue = cue.replace("=", " ").replace(":", " ")
        cue = cue.upper() if rng.random() < 0.15 else cue.title() if rng.random() < 0.2 else cue
        at = rng.choice(gaps)
        piece = rng.choice([" ", "\n"]) + cue + value + rng.choice(["", "", ".", '"', ")"]) + rng.choice([" ", "\n"])
        whole = text[max(0, at - 400) : at] + piece + text[at : at + 400]
        low = min(at, 400) + 1 + len(cue)
        around(whole, low, low + len(value), [] if hidden else [(low, low + len(value))])
    at = rng.choice(gaps)
    around(text, at, at, spots)
    return out


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, max_docs: int = 4000, max_lines: int = 12000) -> dict:
    """A tagger fitted on a bounded sample: about max_docs rows, chosen by a hash of the id, and max_lines lines of them.

    Lines are taken in the order of a hash of their texts, so the model does not depend on how rows are dealt out. See
    example() for what a line bears. Words beside a token are hidden in a third of the lines, so that shape alone must tell.
    """
    ship(df.sparkSession)
    share = F.pmod(F.xxhash64(col(id_col)), F.lit(max(1, df.count() // max_docs))) == 0
    sample = df.where(share & col(text_col).isNotNull()).select(col(text_col).alias("text"))

    def examples(batches):
        for batch in batches:
            found = []
            for text in texts(batch.column(0)):
                seed = zlib.crc32(text.encode())
                lines = example(text, random.Random(seed)) if text else []
                found += [(zlib.crc32(line.encode(), seed), line, [x for s in secrets for x in s]) for line, secrets in lines if len(line) < 2000]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.list_(pa.int32()))], names=["hash", "line", "secrets"])

    rows = sample.mapInArrow(examples, "hash long, line string, secrets array<int>").orderBy("hash", "line").limit(max_lines).collect()
    return fit_lines([(r.line, list(zip(r.secrets[::2], r.secrets[1::2]))) for r in rows])


def fit_lines(lines: list[tuple[str, list[tuple[int, int]]]]) -> dict:
    """The field of lines whose secrets are known."""
    rng = random.Random(7)
    numbers: dict[str, int] = {}  # features in the order they are met; those met once go in the end
    flat, sizes, gold, lengths = array("i"), [], [], []
    for line, secrets in lines:
        found = list(TOKEN.finditer(line))
        if not found:
            continue
        tokens, last = [m[0] for m in found], None
        for m in found:
            start, end = m.start(), m.start() + len(m[0].rstrip(EDGE) or m[0])
            inside = next((x for x in secrets if x[0] < end and start < x[1]), None)
            gold.append(O if inside is None else I if inside == last else B)
            last = inside
        lengths.append(len(tokens))
        near, page, hide = [word_features(t) for t in tokens], file_features(line), rng.random() < 1 / 3
        for i, t in enumerate(tokens):
            feats = ["0" + f for f in own_features(t)] + page
            for d in () if hide else PLACES[1:]:
                if 0 <= i + d < len(tokens):
                    feats += [f"{d}{f}" for f in near[i + d]]
            sizes.append(len(feats))
            flat.extend([numbers.setdefault(f, len(numbers)) for f in feats])
    if B not in gold:
        return {"index": {}, "weights": np.zeros((0, 3)), "trans": np.zeros((3, 3))}
    ids = np.frombuffer(flat, np.int32)
    often = np.bincount(ids, minlength=len(numbers)) > 1
    often[numbers["0bias"]] = True
    place = np.cumsum(often) - 1
    index = {f: int(place[i]) for f, i in numbers.items() if often[i]}
    kept = often[ids]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bounds = np.append(0, np.cumsum(np.bincount(owner[kept], minlength=len(sizes))))
    weights, trans = fit(place[ids[kept]], bounds, np.array(gold), np.array(lengths), len(index), 3, border=O, forbidden=FORBIDDEN, epochs=5, batch=128)
    return {"index": index, "weights": weights.astype(np.float32), "trans": trans}


# --- tagging ---


class Tagger:
    """A model with a bounded memory of what each token scores by itself and as a neighbour; one a task."""

    def __init__(self, model: dict):
        self.index, self.weights, self.trans = model["index"], model["weights"], model["trans"]
        t = self.trans
        inner = [(a, y, c) for a in (O, B, I) for y in (B, I) for c in (O, B, I) if not FORBIDDEN[a, y]]
        after = max(t[I, d] - t[B, d] for d in (O, B, I)) if self.index else 0.0
        #: What transitions can gain at most by a label other than outside, its neighbours' labels free.
        self.gain = max(t[a, y] + t[y, c] + (after if c == I else 0) - t[a, O] - t[O, B if c == I else c] for a, y, c in inner) if self.index else 0.0
        self.forget()

        #: Of each feature of a neighbour its weights at all places.
        self.near: dict[str, np.ndarray] = {}
        for p, place in enumerate(PLACES[1:]):
            mark = str(place)
            for f, i in self.index.items():
                if f.startswith(mark) and f[len(mark) :][:2] in ("c=", "w="):
                    self.near.setdefault(f[len(mark) :], np.zeros((len(PLACES) - 1, 3), np.float32))[p] = self.weights[i]
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((1 << 12, len(PLACES), 3), np.float32)  # of each token by itself, then as a neighbour
        self.used, self.unknown = 0, {}

    def _sum(self, features: list[str]) -> np.ndarray:
        ids = [self.index[f] for f in features if f in self.index]
        return self.weights[ids].sum(0)

    def _learn(self, tokens: list[str]) -> None:
        for t in set(tokens).difference(self.rows):
            bare, kind = t.rstrip(EDGE), None
            if is_word(bare) and "0w=" + (low := bare.lower()) not in self.index and "w=" + low not in self.near:
                kind = len(bare) // 4, bare[0].isupper()  # words that training did not meet score by these alone
                if kind in self.unknown:
                    self.rows[t] = self.unknown[kind]
                    continue
            at, self.used = self.used, self.used + 1
            if at == len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[at, 0] = self._sum(["0" + f for f in own_features(t)])
            for f in word_features(t):
                if (found := self.near.get(f)) is not None:
                    self.scores[at, 1:] += found
            self.rows[t] = at
            if kind:
                self.unknown[kind] = at

    def emissions(self, tokens: list[str]) -> np.ndarray:
        """Scores of the tokens of one text, without those of the file."""
        if len(self.rows) > REMEMBER:
            self.forget()
        try:
            at = np.fromiter(map(self.rows.__getitem__, tokens), np.int64, len(tokens))
        except KeyError:
            self._learn(tokens)
            at = np.fromiter(map(self.rows.__getitem__, tokens), np.int64, len(tokens))
        out = self.scores[at, 0].astype(float)
        for p, place in enumerate(PLACES[1:], 1):
            if place < 0:
                out[-place:] += self.scores[at[:place], p]
            else:
                out[:-place] += self.scores[at[place:], p]
        return out

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """The field's spans: from a token tagged B to the last I after it, without marks that end a sentence."""
        tokens = TOKEN.findall(text) if self.index else []
        if not tokens:
            return []
        emit = self.emissions(tokens) + self._sum(file_features(text))
        better = emit[:, 1:].max(1) - emit[:, O]
        turned = np.append(np.maximum(0, emit[1:, I] - emit[1:, B]), 0)
        live = np.flatnonzero(better + turned + self.gain >= 0)
        if not len(live):
            return []
        place = [m.span() for m in TOKEN.finditer(text)]
        cuts = np.flatnonzero(np.diff(live) > 1) + 1
        out: list[tuple[str, int, int]] = []
        for run in np.split(live, cuts):
            for i, label in zip(run.tolist(), viterbi(emit[run], self.trans, O), strict=True):
                start, end = place[i]
                end = start + len(text[start:end].rstrip(EDGE)) or end
                if label == B:
                    out.append(("crf", start, end))
                elif label == I and out:
                    out[-1] = ("crf", out[-1][1], end)
        return out


def all_spans(text: str, tagger: Tagger) -> list[tuple[str, int, int]]:
    """Base spans, all of them, and those of the field that do not lie within them; by start, then kind."""
    base = base_spans(text)
    taken = Taken((s, e) for _, s, e in base)
    more = [s for s in tagger.spans(text) if not taken.covers(s[1], s[2])]
    return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def scan_secrets(df: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with a column spans: array<struct<kind, start, end>>, in code points, end exclusive.

    Null and empty texts have no spans; texts are scanned whole, however long, in time that grows with their length. One
    pass, no shuffle. Rows that repeat are scanned alike; an empty table gives an empty one. Of labellings of equal score
    the one of the lesser labels is taken. An input column named spans, in any case, is replaced; others stay (or those in
    `keep`).
    """

    def make():
        tagger = Tagger(model)
        return lambda column: [[[{"kind": k, "start": s, "end": e} for k, s, e in all_spans(t, tagger)] for t in texts(column)]]

    return map_rows(df, [text_col], SPANS, make, keep)
