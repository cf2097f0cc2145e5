"""Personal data: patterns with checks, and a linear-chain conditional random field over word shapes (operator 9).

Base spans come from the four patterns below, each scanned from left to right without overlap; a match that fails its
check is dropped and not tried again. The field adds what the patterns cannot see: phone numbers without a country code,
e-mail addresses that write @ and the dot as words in brackets. It labels blank-separated tokens with `-` or a kind, from the
shape of the token and of its neighbours. It is trained on the
driver from a small generated table (`labelled_table`, a parameter) by maximum likelihood; its weights, a few kB, go to
the workers. A run of equal labels is a span; it is added if it passes the kind's check and touches no base span.

Decoding is Viterbi in numpy, over batches of windows. A token of letters between tokens of letters can never be part of
a span: `letters_stay_outside` proves it from the trained weights (for all labels of both neighbours), training fails
otherwise. Hence a text may be cut at such tokens, and only windows around tokens that are not letters alone
are decoded, in lines with a digit, an @ or such a bracket, with
the labels that decoding whole texts would give.

Defined cases: a null or empty text has no spans; spans are counted in code points; equal spans of different kinds are
kept and stand in the order of KINDS; rows may repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, release, table

KINDS = ("email", "ip", "card", "phone")
# The patterns of the four kinds, written so that each is scanned in linear time: a number is tried at its first digit alone,
# since a later one fails where the first did, and repetitions that nothing follows keep no way back.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9.-]*")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"

RUN = re.compile(r"[^\x20\x09-\x0D]+")
DIGITS = re.compile(r"[0-9]+")


def luhn(number: str) -> bool:
    digits = [ord(c) - 48 for c in number[::-1]]
    return not (sum(digits[::2]) + sum(d * 2 - 9 * (d > 4) for d in digits[1::2])) % 10


def _digits(s: str) -> str:
    return "".join(DIGITS.findall(s))


def _is_ip(s: str) -> bool:
    # a part of many digits is large unless it begins with zeros; int() of a huge one would be slow
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _is_card(s: str) -> bool:
    d = _digits(s)
    return 12 <= len(d) <= 19 and luhn(d)


def _is_phone(s: str) -> bool:
    return 9 <= len(_digits(s)) <= 15


def _emails(text: str):
    """The matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, found from each @.

    All starts in the run of characters before an @ share its domain, so that the first of them matches or none does.
    """
    at, until = text.find("@"), 0
    while at >= 0:
        before = text[until:at]
        start = until + len(before.rstrip(LOCAL))
        name = DOMAIN.match(text, at + 1)[0].split("..", 1)[0].rstrip(".")
        until = at + 1
        if start < at and "." in name and name[0] != ".":
            until += len(name)
            yield start, until
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), sorted."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if DIGITS.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if _is_ip(m[0])]
        out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if _is_card(m[0])]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if _is_phone(m[0])]
    return sorted(out)


# --- the field ---

LABELS = ("-", *KINDS)
#: What stands for @ and the dot, and the shape it has for the field.
KEYS = {"[at]": "at", "(at)": "at", "{at}": "at", "[dot]": "dot", "(dot)": "dot", "{dot}": "dot"}
TRIGGER = re.compile(r"[0-9@]|[\[({](?:at|dot)[\])}]")
EDGE = ".,;:!?\"'*#$%&|<>"
_SHAPE = ((re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"[0-9]{5,}"), "N"), (re.compile(r"[0-9]+"), lambda m: str(len(m[0]))))


def shape(token: str) -> str:
    """A token without marks at its ends: letters become a, runs of digits their length (N from five on), other characters stay; at most 16."""
    core = token.strip(EDGE)
    if core in KEYS:
        return KEYS[core]
    if core.isalpha():
        return "a"
    for pattern, to in _SHAPE:
        core = pattern.sub(to, core)
    return core[:16]


def features(shapes: list[str], i: int) -> tuple[str, ...]:
    s = shapes[i]
    before, after = shapes[i - 1] if i else "a", shapes[i + 1] if i + 1 < len(shapes) else "a"
    return ("s=" + s, "p=" + before, "n=" + after, "ps=" + before + " " + s, "sn=" + s + " " + after)


LONGEST = 8  # tokens in a span
PAD = 2  # letter tokens on each side of a window
ROWS, CELLS = 512, 1 << 15  # windows, and tokens with padding, that are decoded at once


def labelled_table(rows: int = 600, seed: int = 11) -> list[tuple[str, list[str]]]:
    """Sentences of invented words with personal data and look-alikes, and the label of each blank-separated token."""
    rnd = random.Random(seed)
    syllable = ["ba", "re", "tion", "the", "ou", "ly", "mi", "que", "er", "sto", "in", "el"]
    word = lambda: "".join(rnd.choices(syllable, k=rnd.randint(1, 3)))
    plain = lambda: word() + rnd.choice(["", "", "", ",", "."])
    n = lambda k: "".join(rnd.choices("0123456789", k=k))

    def card() -> str:
        d = "4" + n(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = rnd.choice(["", " ", "-"])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    national = lambda: rnd.choice(["({}) {}-{}", "({}) {} {}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"]).format(n(3), n(3), n(4))
    private = {
        "phone": lambda: rnd.choice([national, national, lambda: "+1 " + national(), lambda: "+" + n(2) + " " + n(3) + " " + n(3) + " " + n(3)])(),
        "email": lambda: rnd.choice(["{} [at] {} [dot] com", "{} (at) {} (dot) org", "{}@{}.com", "{}.{}@mail.example.org"]).format(word(), word()),
        "ip": lambda: ".".join(str(rnd.randint(1, 255)) for _ in range(4)),
        "card": card,
    }
    alike = [
        lambda: f"version {n(1)}.{n(1)}", lambda: f"token = \"{''.join(rnd.choices('0123456789abcdef', k=40))}\"", lambda: n(4), lambda: f"{n(2)}-{n(2)}-{n(4)}", lambda: f"{n(4)}-{n(2)}-{n(2)}",
        lambda: f"password={''.join(rnd.choices('0123456789abcdef', k=18))}", lambda: f"{n(3)} {word()}", lambda: f"{n(1)}.{n(2)} {word()}", lambda: f"at {word()}", lambda: f"the dot {word()}", lambda: f"{n(2)}:{n(2)}", lambda: n(8), lambda: f"{n(3)} {n(3)}", lambda: f"({n(1)}) {word()}", lambda: f"{n(2)}% {word()}", lambda: "BY-NC 4.0", lambda: "AKIA" + n(3) + "QX" + n(4),
    ]
    out = []
    for r in range(rows):
        tokens = [(plain(), "-") for _ in range(rnd.randint(2, 6))]
        if r % 3:
            kind = rnd.choice(["phone", "phone", "email", "email", "ip", "card"])
            tokens += [(t, kind) for t in private[kind]().split(" ")]
        else:
            tokens += [(t, "-") for t in rnd.choice(alike)().split(" ")]
        tokens += [(plain(), "-") for _ in range(rnd.randint(2, 5))]
        out.append((" ".join(t for t, _ in tokens), [y for _, y in tokens]))
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Field:
    """Weights of a linear-chain field: emissions by feature, transitions between labels."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, step: np.ndarray):
        self.names, self.emit, self.step = names, emit, step

    def ids(self, shapes: list[str]) -> np.ndarray:
        none, get = len(self.names), self.names.get  # the weights of none are zero
        return np.fromiter((get(f, none) for i in range(len(shapes)) for f in features(shapes, i)), np.int32, 5 * len(shapes)).reshape(-1, 5)

    def best(self, windows: list[np.ndarray]) -> list[np.ndarray]:
        """The likeliest labels of each window; windows of about the same length are decoded together, up to ROWS windows and CELLS tokens."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(windows)
        order = sorted(range(len(windows)), key=lambda i: len(windows[i]))
        while order:
            rows = 1
            while rows < min(ROWS, len(order)) and (rows + 1) * len(windows[order[-1]]) <= CELLS:
                rows += 1
            for i, labels in zip(order[-rows:], self._decoded([windows[i] for i in order[-rows:]])):
                out[i] = labels
            del order[-rows:]
        return out

    def _decoded(self, part: list[np.ndarray]) -> list[np.ndarray]:
        sizes = np.array(list(map(len, part)))
        n, longest = len(part), int(sizes.max())
        back = np.zeros((n, longest, len(LABELS)), np.int8)
        ends = at = None
        for first in range(0, longest, CELLS):  # scores of a long window are made in pieces
            width = min(CELLS, longest - first)
            ids = np.full((n, width, 5), len(self.names), np.int32)
            for row, w in enumerate(part):
                piece = w[first : first + width]
                ids[row, : len(piece)] = piece
            scores = sum(self.emit[ids[:, :, f]] for f in range(5))
            for t in range(first, first + width):
                if not t:
                    at = scores[:, 0] + self.step[0]  # before a window stands a token outside
                    ends = at.copy()
                    continue
                paths = at[:, :, None] + self.step[None]
                back[:, t] = paths.argmax(axis=1)
                at = paths.max(axis=1) + scores[:, t - first]
                ends[sizes > t] = at[sizes > t]
        label = (ends + self.step[:, 0]).argmax(axis=1)  # and after it as well
        labels, rows = np.zeros((n, longest), np.int8), np.arange(n)
        for t in range(longest - 1, -1, -1):
            labels[:, t] = label
            label = np.where(t < sizes, back[rows, t, label] if t else label, label)
        return [labels[row, :size] for row, size in enumerate(sizes)]


def letters_stay_outside(field: Field) -> bool:
    """Whether a token of letters between tokens of letters is outside on every best path, whatever its neighbours' labels."""
    e = field.emit[field.ids(["a", "a", "a"])[1]].sum(axis=0)
    through = field.step[:, :, None] + e[None, :, None] + field.step[None]  # before, label, after
    return bool((through[:, :1] > through[:, 1:]).all())


@lru_cache(maxsize=2)
def train(rows: int = 600, seed: int = 11, rounds: int = 120, l2: float = 0.02) -> Field:
    """Maximum likelihood with an L2 penalty, by Adam over all sentences at once."""
    data = labelled_table(rows, seed)
    shapes = [[shape(t) for t in text.split(" ")] for text, _ in data]
    names: dict[str, int] = {}
    for s in shapes:
        for i in range(len(s)):
            for f in features(s, i):
                names.setdefault(f, len(names))
    n, longest, k, y_of = len(data), max(map(len, shapes)), len(LABELS), {y: i for i, y in enumerate(LABELS)}
    ids, gold, real = np.full((n, longest, 5), len(names)), np.zeros((n, longest), int), np.zeros((n, longest), bool)
    field = Field(names, np.zeros((len(names) + 1, k)), np.zeros((k, k)))
    for r, (s, (_, ys)) in enumerate(zip(shapes, data)):
        ids[r, : len(s)], gold[r, : len(s)], real[r, : len(s)] = field.ids(s), [y_of[y] for y in ys], True
    hot = np.eye(k)[gold] * real[..., None]
    pairs = np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:])
    weights = [field.emit, field.step]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    flat = ids.reshape(-1, 5)
    for turn in range(1, rounds + 1):
        scores = field.emit[ids].sum(axis=2)
        forth, back = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        forth[:, 0] = scores[:, 0]
        for t in range(1, longest):
            step = _log_sum(forth[:, t - 1, :, None] + field.step, 1) + scores[:, t]
            forth[:, t] = np.where(real[:, t, None], step, forth[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = _log_sum(field.step + (scores[:, t + 1] + back[:, t + 1])[:, None], 2)
            back[:, t] = np.where(real[:, t + 1, None], step, 0.0)
        total = _log_sum(forth[:, -1], 1)
        each = np.exp(forth + back - total[:, None, None]) * real[..., None]
        joint = np.exp(forth[:, :-1, :, None] + field.step + (scores[:, 1:] + back[:, 1:])[:, :, None] - total[:, None, None, None]) * real[:, 1:, None, None]
        miss = (each - hot).reshape(-1, k)
        grad_emit = np.zeros_like(field.emit)
        for f in range(5):
            for y in range(k):
                grad_emit[:, y] += np.bincount(flat[:, f], miss[:, y], len(names) + 1)
        grads = [grad_emit / n + l2 / 10 * field.emit, (joint.sum(axis=(0, 1)) - pairs) / n + l2 * field.step]
        for i, g in enumerate(grads):
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            weights[i] -= 0.15 * (mean[i] / (1 - 0.9**turn)) / (np.sqrt(square[i] / (1 - 0.99**turn)) + 1e-8)
        field.emit[-1] = 0
    if not letters_stay_outside(field):
        raise ValueError("the trained field may label tokens of letters alone: windows would not be exact")
    return field


def windows(text: str) -> Iterator[list[tuple[int, int]]]:
    """Token spans around everything that is not letters alone, PAD more tokens on each side, cut where windows do not meet.

    A line is a sequence of its own; one without digits, @ and brackets cannot hold a span that passes its check.
    """
    if not TRIGGER.search(text):
        return
    at = 0
    for line in text.split("\n"):
        if TRIGGER.search(line):
            tokens = [(at + m.start(), at + m.end()) for m in RUN.finditer(line)]
            first = last = -1
            for i, (a, b) in enumerate(tokens):
                if shape(text[a:b]) == "a":
                    continue
                if first < 0:
                    first = i
                elif i - last > 2 * PAD:
                    yield tokens[max(0, first - PAD) : last + PAD + 1]
                    first = i
                last = i
            if first >= 0:
                yield tokens[max(0, first - PAD) : last + PAD + 1]
        at += len(line) + 1


_NUMBER = re.compile(r"[0-9+().\x20/-]+").fullmatch
AT, DOT = ({k for k, v in KEYS.items() if v == of} for of in ("at", "dot"))
_CHECKS = (lambda s: "@" in s or bool(AT & set(s.split(" ")) and DOT & set(s.split(" "))), lambda s: s.count(".") == 3 and not s.strip("0123456789.") and _is_ip(s), lambda s: bool(_NUMBER(s)) and _is_card(s), lambda s: bool(_NUMBER(s)) and _is_phone(s))


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], field: Field) -> list[list[tuple[int, int, int]]]:
    """What the field adds to the base spans of each text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    places: list[tuple[int, list[tuple[int, int]]]] = []
    tokens = 0
    for d, t in enumerate(texts):
        for w in windows(t):
            places.append((d, w))
            tokens += len(w)
            if tokens > 8 * CELLS:
                _add(places, texts, base, field, out)
                places, tokens = [], 0
    _add(places, texts, base, field, out)
    return out


def _add(places: list, texts: list[str], base: list, field: Field, out: list) -> None:
    """Adds to out what the field finds in the windows (number of the text, tokens) of places."""
    labels = field.best([field.ids([shape(texts[d][a:b]) for a, b in w]) for d, w in places])
    # base spans overlap where kinds do: beside their starts stand the largest ends so far
    near = {d: ([a for a, _, _ in base[d]], list(accumulate((e for _, _, e in base[d]), max))) for d in {d for d, _ in places}}
    for (d, w), ys in zip(places, labels):
        starts, ends = near[d]
        i = 0
        while i < len(w):
            if not ys[i]:
                i += 1
                continue
            # the longest run of equal labels that passes the check; a run may hold several spans
            last = i + 1
            while last < min(len(w), i + LONGEST) and ys[last] == ys[i]:
                last += 1
            for j in range(last, i, -1):
                raw = texts[d][w[i][0] : w[j - 1][1]]
                start = w[i][0] + len(raw) - len(raw.lstrip(EDGE))
                end = start + len(raw.strip(EDGE))
                if start < end and _CHECKS[ys[i] - 1](texts[d][start:end]):
                    before = bisect_left(starts, end)  # base spans that begin before the end
                    if not before or ends[before - 1] <= start:
                        out[d].append((start, int(ys[i]) - 1, end))
                    i = j
                    break
            else:
                i += 1


def find(texts: list[str], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, all spans) of each text, sorted by start and kind."""
    base = [base_spans(t) for t in texts]
    return [(b, sorted({*b, *more})) for b, more in zip(base, added_spans(texts, base, field))]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (the union of overlapping ones) replaced by its kind in angle brackets."""
    out, at, until = [], 0, -1
    for a, k, b in spans:
        if a >= until:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
            at = until = b
        elif b > until:
            at = until = b
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row."""
    spec = docs.sparkSession.sparkContext.broadcast(train())

    def run(batches):
        field = spec.value
        for batch in batches:
            found = find([t.as_py() or "" for t in batch.column(1)], field)
            counts = [pa.array([sum(k == i for _, k, _ in b) for b, _ in found], pa.int64()) for i in range(len(KINDS))]
            digest = pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, pa.array([written(a) for _, a in found], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced in text (null stays null), and n_chars, where it is a column, counted again."""
    bound_batches(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(train())

    @F.arrow_udf("string")
    def clean(batch: pa.Array) -> pa.Array:
        release()
        texts = [t.as_py() for t in batch]
        found = find([t or "" for t in texts], spec.value)
        return pa.array([None if t is None else redact(t, spans) for t, (_, spans) in zip(texts, found)], pa.string())

    out = docs.withColumn("text", clean(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
