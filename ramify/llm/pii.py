"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds spans.

The patterns find emails, IPv4 addresses, cards and international phone numbers. The field is trained here, from a
small labelled table (`training_table`), by gradient ascent on the regularised conditional likelihood; its features
are shapes of a word and its neighbours, never the words of a document's own vocabulary beyond a few cue words. It is
decoded by Viterbi over padded numpy batches. A span needs a word with a digit, @ or + by a hard constraint, so only
the surroundings of such words are decoded; all of them are, in whole texts. A span is added if it is sound for its
kind and overlaps no base span.

Defined results: null and empty texts have no spans; rows with a null id and repeated rows are each scanned; an empty
table gives an empty result; columns beyond id and text are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_arrow

KINDS = ("email", "ip", "card", "phone")

# ---------------------------------------------------------------- base patterns
# The patterns of the base kinds. Possessive runs and the look-behind change no match, but keep
# long runs of digits linear: a run that fails at its start fails at each later digit too.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each @ outwards, in linear time."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        left = at
        while left > last and text[left - 1] in LOCAL:
            left -= 1
        m = DOMAIN.match(text, at + 1) if left < at else None
        if m:
            last = m.end()
            out.append((left, last))
        at = text.find("@", max(last, at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            d = _digits(m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# ---------------------------------------------------------------- features

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
N_FEATURES = 1 << 14
CUES = frozenset("call tel phone telephone mobile cell fax dial sms text whatsapp email mail e-mail contact reach write ip host server address card visa mastercard credit account number at dot".split())
TOKEN = re.compile(r"[^\s]+")
TRIGGER = re.compile(r"[^\s]*[0-9@+][^\s]*")
#: Words on each side of a trigger that are decoded with it.
CONTEXT = 4


def shape(word: str) -> str:
    """Letters x or X and digits 9, runs of letters shortened to two, runs of digits kept up to five."""
    s = re.sub(r"[0-9]", "9", re.sub(r"[a-zß-ÿ]", "x", re.sub(r"[A-ZÀ-Þ]", "X", word)))
    s = re.sub(r"[^\x20-\x7e]", "u", s)
    return re.sub(r"9{6,}", "99999+", re.sub(r"(x|X|u)\1{2,}", r"\1\1", s))


class Memo(dict):
    """Results of a function by argument, up to `most`; it travels to executors empty."""

    def __init__(self, function, most: int):
        self.function, self.most = function, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.function(key)
        return value

    def __reduce__(self):
        return Memo, (self.function, self.most)


def own_features(word: str) -> tuple[str, ...]:
    core = word.strip(".,;:!?\"'()[]<>")
    low, s = core.lower(), shape(core)
    d = sum(c.isdigit() for c in word)
    out = ["s=" + s, f"d={min(d, 20)}", f"n={min(len(core), 20)}", "p=" + shape(word[:1]), "e=" + shape(word[-1:])]
    out.append("sep=" + re.sub(r"[0-9]+", "9", "".join(c for c in core if not c.isalpha())))
    out.append("mix=" + "".join(k for k, on in (("a", any(c.isalpha() for c in core)), ("9", d), ("@", "@" in core), ("+", "+" in core), (".", "." in core), ("-", "-" in core), ("(", "(" in word)) if on))
    if low in CUES:
        out.append("cue=" + low)
    return tuple(out)


def feature_ids(words: list[str]) -> list[list[int]]:
    """Hashed features of each word: its own, and those of two neighbours on either side."""
    own = [OWN[w] for w in words]
    out = []
    for i in range(len(words)):
        names = list(own[i]) + ["bias"]
        for k in (-2, -1, 1, 2):
            j = i + k
            names += [f"{k}{f}" for f in own[j] if f[0] in "sdc"] if 0 <= j < len(words) else [f"{k}none"]
        out.append([FEATURE[x] for x in names])
    return out


def _feature(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") % N_FEATURES


OWN, FEATURE = Memo(own_features, 50_000), Memo(_feature, 200_000)


# ---------------------------------------------------------------- the labelled table


def training_table(seed: int = 7, n: int = 500) -> list[tuple[list[str], list[str]]]:
    """Labelled sentences (words, labels): made-up personal data of several notations, and look-alikes that are none."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: r.choice((str.lower, str.capitalize, str.lower))("".join(r.choice("etaoinshrdlucmfwypvbgk") for _ in range(r.randint(2, 10)))) + r.choice(("", "", "", "", ",", "."))
    name = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(3, 8)))

    def card() -> str:
        body = num(r.choice((12, 14, 15)))
        return next(body + c for c in "0123456789" if luhn(body + c))

    def entity() -> tuple[str, str | None]:
        k = r.randrange(15)
        if k == 0:
            return f"{name()}.{num(2)}@{name()}{num(1)}.example.{r.choice(('com', 'org', 'net'))}", "email"
        if k == 1:
            return f"{name()}@{name()}", "email"
        if k == 2:
            return f"{name()}{num(1)} (at) {name()} (dot) {r.choice(('com', 'org'))}", "email"
        if k == 3:
            return ".".join(str(r.randint(1, 255)) for _ in range(4)) + r.choice(("", "", f":{num(4)}")), "ip"
        if k == 4:
            c = card()
            return r.choice((c, " ".join(c[i : i + 4] for i in range(0, len(c), 4)), ".".join(c[i : i + 4] for i in range(0, len(c), 4)))), "card"
        if k == 5:
            return f"+{r.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", "phone"
        if k in (6, 7):
            return r.choice(("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "({}){}-{}")).format(num(3), num(3), num(4)), "phone"
        if k == 8:
            return f"+{r.randint(1, 99)}/{num(3)}/{num(7)}", "phone"
        return (
            r.choice(("AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), str(r.randint(1900, 2030)), f"{r.randint(1, 12)}/{r.randint(1, 28)}/{num(4)}", f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}", f"${num(3)}.{num(2)}", f"v{num(1)}.{num(1)}.{num(2)}", num(r.randint(1, 6)), f"{num(2)}%", f"[{num(2)}]", f"#{num(4)}", f"{name()}{num(3)}", f"@{name()}", f"{num(1)}+{num(1)}", f"ISBN {num(3)}-{num(1)}-{num(5)}-{num(3)}-{num(1)}", f"{num(3)},{num(3)}", f"{num(1)}.{num(3)}e-{num(2)}", num(22), f"C++{num(2)}", f"{num(8)}-{num(4)}-{num(4)}-{num(4)}-{num(12)}")),
            None,
        )

    out = []
    for _ in range(n):
        words, labels = [], []
        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(0, 4)):
                words.append(word())
                labels.append("O")
            text, kind = entity()
            if kind and r.random() < 0.15:
                words.append(r.choice(sorted(CUES)) + r.choice(("", ":")))
                labels.append("O")
            parts = (text + r.choice(("", "", "", ".", ","))).split()
            words += parts
            labels += ["O" if kind is None else ("B-" if i == 0 else "I-") + kind for i in range(len(parts))]
        words += [word() for _ in range(r.randint(0, 3))]
        labels += ["O"] * (len(words) - len(labels))
        out.append((words, labels))
    return out


# ---------------------------------------------------------------- the field


def pad(rows: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids (rows, words, features; N_FEATURES where there is none) and lengths."""
    t, f = max(map(len, rows)), max((len(x) for r in rows for x in r), default=1)
    ids = np.full((len(rows), t, f), N_FEATURES, np.int32)
    for i, r in enumerate(rows):
        for j, x in enumerate(r):
            ids[i, j, : len(x)] = x
    return ids, np.array([len(r) for r in rows])


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def allowed() -> np.ndarray:
    """0 where a label may follow another, -1e4 where not (row N_LABELS: the start)."""
    n = len(LABELS)
    out = np.zeros((n + 1, n), np.float32)
    for b, y in enumerate(LABELS):
        if y[0] == "I":
            out[:, b] = -1e4
            for a, x in enumerate(LABELS):
                if x[2:] == y[2:] and x != "O":
                    out[a, b] = 0
    return out


def train(table: list[tuple[list[str], list[str]]], epochs: int = 60, rate: float = 0.1, l2: float = 2e-3) -> dict[str, np.ndarray]:
    """Weights by Adam on the mean log-likelihood of all sentences at once: forward-backward over padded batches."""
    n_labels, at = len(LABELS), {y: i for i, y in enumerate(LABELS)}
    ids, lengths = pad([feature_ids(w) for w, _ in table])
    n, t, _ = ids.shape
    gold = np.zeros((n, t), np.int64)
    for i, (_, y) in enumerate(table):
        gold[i, : len(y)] = [at[k] for k in y]
    used, compact = np.unique(ids, return_inverse=True)
    compact = compact.reshape(ids.shape)
    real = (np.arange(t) < lengths[:, None]).astype(np.float64)
    w, tr = np.zeros((len(used), n_labels)), np.zeros((n_labels + 1, n_labels))
    hard, live = allowed().astype(np.float64), (used != N_FEATURES)[:, None]
    onehot = np.eye(n_labels)[gold] * real[..., None]
    n_features = compact.shape[2]
    order = np.argsort(compact.ravel(), kind="stable")
    words_of_feature, starts = order // n_features, np.searchsorted(compact.ravel()[order], np.arange(len(used)))
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, tr)]
    for step in range(1, epochs + 1):
        emit, full = (w * live)[compact].sum(2), tr + hard
        alpha = np.empty((n, t, n_labels))
        alpha[:, 0] = emit[:, 0] + full[-1]
        for k in range(1, t):
            new = _lse(alpha[:, k - 1, :, None] + full[None, :-1], 1) + emit[:, k]
            alpha[:, k] = np.where(real[:, k, None] > 0, new, alpha[:, k - 1])
        beta = np.zeros((n, t, n_labels))
        for k in range(t - 2, -1, -1):
            new = _lse(full[None, :-1] + (emit[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
            beta[:, k] = np.where(real[:, k + 1, None] > 0, new, 0)
        z = _lse(alpha[:, -1], 1)
        marginal = np.exp(alpha + beta - z[:, None, None]) * real[..., None]
        g_emit = onehot - marginal
        g_tr = np.zeros_like(tr)
        g_tr[-1] = (onehot[:, 0] - marginal[:, 0]).sum(0)
        for k in range(1, t):
            pair = np.exp(alpha[:, k - 1, :, None] + full[None, :-1] + (emit[:, k] + beta[:, k])[:, None, :] - z[:, None, None]) * real[:, k, None, None]
            g_tr[:-1] += onehot[:, k - 1].T @ onehot[:, k] - pair.sum(0)
        g_w = np.add.reduceat(g_emit.reshape(n * t, -1)[words_of_feature], starts, axis=0)
        for x, g, (m, v) in zip((w, tr), (g_w / n - l2 * w, g_tr / n - l2 * tr), moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros((N_FEATURES + 1, n_labels), np.float32)
    weights[used] = w
    weights[N_FEATURES] = 0
    return {"weights": weights, "transitions": (tr + hard).astype(np.float32)}


def emissions(model: dict[str, np.ndarray], rows: list[list[str]], part: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(rows, words, labels) scores of the words by their features, and the lengths of the rows.

    Features are made for parts of a row, with the neighbours that they look at, so that long rows take little memory.
    """
    lengths = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), int(lengths.max(initial=0)), len(LABELS)), np.float32)
    parts = [(i, k) for i, r in enumerate(rows) for k in range(0, len(r), part)]
    for at in range(0, len(parts), 64):
        some = parts[at : at + 64]
        ids, _ = pad([feature_ids(rows[i][max(0, k - 2) : k + part + 2])[min(k, 2) :][:part] for i, k in some])
        scores = model["weights"][ids].sum(2)
        for (i, k), score in zip(some, scores, strict=True):
            n = min(part, len(rows[i]) - k)
            out[i, k : k + n] = score[:n]
    return out, lengths


def viterbi(model: dict[str, np.ndarray], emit: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best labels (rows, words) of a padded batch of emissions; 0 beyond a row's length."""
    tr = model["transitions"]
    n, t, k = emit.shape
    score, back = emit[:, 0] + tr[-1], np.zeros((n, t, k), np.int8)
    for i in range(1, t):
        step = score[:, :, None] + tr[None, :-1]
        live = (i < lengths)[:, None]
        back[:, i] = np.where(live, step.argmax(1), np.arange(k))
        score = np.where(live, step.max(1) + emit[:, i], score)
    out = np.zeros((n, t), np.int64)
    out[:, -1] = score.argmax(1)
    for i in range(t - 1, 0, -1):
        out[:, i - 1] = back[np.arange(n), i, out[:, i]]
    out[np.arange(t) >= lengths[:, None]] = 0
    return out


@lru_cache(maxsize=1)
def default_model() -> dict[str, np.ndarray]:
    return train(training_table())


# ---------------------------------------------------------------- spans of texts


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Runs of words (start, end) around words with a digit, @ or +: up to CONTEXT words on each side; close ones are one run."""
    out: list[list[tuple[int, int]]] = []
    for m in TRIGGER.finditer(text):
        if out and m.start() < out[-1][-1][1]:
            continue
        # words before, found backwards from the trigger
        before, at = [], m.start()
        floor = out[-1][-1][1] if out else 0
        while len(before) < CONTEXT and at > floor:
            end = at
            while end > floor and text[end - 1].isspace():
                end -= 1
            start = end
            while start > floor and not text[start - 1].isspace():
                start -= 1
            if start == end:
                break
            before.append((start, end))
            at = start
        joins = bool(out) and (at <= floor or not text[floor:at].strip())
        run = out[-1] if joins else []
        if not joins:
            out.append(run)
        run.extend(reversed(before))
        run.append(m.span())
        end = m.end()
        for _ in range(CONTEXT):
            nxt = TOKEN.search(text, end)
            if not nxt or TRIGGER.fullmatch(nxt[0]):
                break
            run.append(nxt.span())
            end = nxt.end()
    return out


def sound(kind: str, s: str) -> bool:
    """What a decoded span must hold to count as its kind."""
    d = _digits(s)
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@]+@[^\s@]+", s) and re.search(r"[A-Za-z0-9]@[A-Za-z0-9]", s)) or bool(re.search(r"[A-Za-z0-9]\s*[(\[]\s*at\s*[)\]]\s*[A-Za-z0-9]", s))
    if kind == "ip":
        parts = s.split(":")[0].split(".")
        return len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 and bool(re.fullmatch(r"[+(]?[0-9][0-9()./\s-]*[0-9]", s)) and not re.fullmatch(r"[0-9]+", s)


def decoded_spans(texts: list[str], model: dict[str, np.ndarray], batch: int = 512) -> list[list[tuple[str, int, int]]]:
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    runs = []
    for i, text in enumerate(texts):
        for run in windows(text) if re.search(r"[0-9@+]", text) else ():
            runs.append((i, run))
    runs.sort(key=lambda x: len(x[1]))
    k = 0
    while k < len(runs):  # batches of about the same length, and of so many words
        stop = k + 1
        while stop < len(runs) and stop - k < batch and (stop + 1 - k) * len(runs[stop][1]) <= 50_000:
            stop += 1
        part, k = runs[k:stop], stop
        emit, lengths = emissions(model, [[texts[i][a:b] for a, b in run] for i, run in part])
        for (i, run), labels in zip(part, viterbi(model, emit, lengths), strict=True):
            j = 0
            while j < len(run):
                y = LABELS[labels[j]]
                if y == "O":
                    j += 1
                    continue
                end = j + 1
                while end < len(run) and LABELS[labels[end]] == "I-" + y[2:]:
                    end += 1
                a, b = run[j][0], run[end - 1][1]
                while b > a and texts[i][b - 1] in ".,;:!?\"'>]" or (b > a and texts[i][b - 1] == ")" and "(" not in texts[i][a:b]):
                    b -= 1
                while a < b and texts[i][a] in "\"'<[,;:":
                    a += 1
                if re.search(r"[0-9@+]", texts[i][a:b]) and sound(y[2:], texts[i][a:b]):
                    out[i].append((y[2:], a, b))
                j = end
    return out


def find_spans(texts: list[str], model: dict[str, np.ndarray]) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """Base spans and all spans of each text, both by kind as in KINDS, then start."""
    key = lambda s: (KINDS.index(s[0]), s[1])
    out = []
    for text, more in zip(texts, decoded_spans(texts, model), strict=True):
        base = base_spans(text)
        extra = [s for s in dict.fromkeys(more) if all(s[2] <= a or s[1] >= b for _, a, b in base)]
        out.append((sorted(base, key=key), sorted(base + extra, key=key)))
    return out


def _scan(model: dict[str, np.ndarray]):
    names = ["id", *(f"n_{k}" for k in KINDS), "base_spans", "spans"]
    join = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = find_spans([t or "" for t in part.column(1).to_pylist()], model)
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array([join(b) for b, _ in found]), pa.array([join(a) for _, a in found])], names)

    return run


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """id_col, n_email, n_ip, n_card, n_phone (base spans), base_spans and spans (kind:start:end, comma-joined)."""
    bounded_arrow(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, " + "".join(f"n_{k} long, " for k in KINDS) + "base_spans string, spans string"
    return rows.mapInArrow(_scan(model or default_model()), schema).withColumnRenamed("id", id_col)
