"""Personal data by a character-level bidirectional LSTM with CRF transitions, beside exact patterns.

The network is trained here, in numpy, from labelled spans (``labelled``: generated sentences with
addresses, numbers and look-alikes). Texts are read in windows of ``WINDOW`` characters, a new one each
``STRIDE``; each window is decoded by Viterbi, and over a whole text the spans of all windows
are reconciled by choosing the non-overlapping ones of greatest total score, where a span cut
by a window's border counts less than its whole form in the next one. A span must hold a digit or an @ (a
span rule, so windows without either hold none and aren't run) and pass the check of its
kind. Spans of the base patterns always stay; the network's join them where they overlap none.

Null and empty texts have no spans. Rows are independent, so repeated rows get equal results.
Spans count code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .tables import read

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48
HIDDEN, TAGS = 16, 1 + 2 * len(KINDS)
Span = tuple[str, int, int]

# ---- base patterns -------------------------------------------------------------------------------------------------
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def octets(s: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in s.split("."))


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns by kind, leftmost and non-overlapping within a kind; failing ones are dropped."""
    out: list[Span] = []
    end = 0
    at = text.find("@")
    while at >= 0:  # a match's local part ends at an @, and begins where the run of its characters does
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", begin, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    out += [("ip", *m.span()) for m in _IP.finditer(text) if octets(m[0])]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 16 <= len(n := digits(m[0])) <= 19 and luhn(n)]
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return out


def plausible(kind: str, s: str) -> bool:
    """The check a span of the network must pass."""
    n = digits(s)
    if kind == "email":
        return re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@.]+", s) is not None
    if kind == "ip":
        return s.count(".") == 3 and re.fullmatch(r"[0-9.]+", s) is not None and octets(s)
    if kind == "card":
        return 13 <= len(n) <= 19 and luhn(n) and re.fullmatch(r"[0-9][0-9 .-]+[0-9]", s) is not None
    return 8 <= len(n) <= 15 and re.fullmatch(r"\+?[0-9(][0-9 ().-]+[0-9]", s) is not None and sum(c in " ().-" for c in s) >= 2


# ---- characters ----------------------------------------------------------------------------------------------------
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SYMBOLS = 7 + len(_PUNCTUATION)  # pad, lower, upper, digit, space, break, other, then each ASCII punctuation
_SYMBOL = np.full(129, 6, np.int64)
_SYMBOL[97:123], _SYMBOL[65:91], _SYMBOL[48:58], _SYMBOL[32], _SYMBOL[10] = 1, 2, 3, 4, 5
for _i, _c in enumerate(_PUNCTUATION):
    _SYMBOL[ord(_c)] = 7 + _i
_SYMBOL[128] = 1  # letters outside ASCII read as letters


def symbols(text: str) -> np.ndarray:
    return _SYMBOL[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 128)]


# ---- network -------------------------------------------------------------------------------------------------------
@dataclass
class Network:
    """Weights of both directions (first axis), the output layer and the CRF."""

    x: np.ndarray  # (2, symbols, 4 hidden)
    u: np.ndarray  # (2, hidden, 4 hidden)
    b: np.ndarray  # (2, 1, 4 hidden)
    o: np.ndarray  # (2 hidden, tags)
    c: np.ndarray  # (tags,)
    t: np.ndarray  # (tags, tags): from, to
    s: np.ndarray  # (tags,): first tag

    def parts(self) -> list[np.ndarray]:
        return [self.x, self.u, self.b, self.o, self.c, self.t, self.s]


def _new(rng: np.random.Generator) -> Network:
    scale = lambda *n: rng.normal(0, 0.3, n).astype(np.float32)
    net = Network(scale(2, SYMBOLS, 4 * HIDDEN), scale(2, HIDDEN, 4 * HIDDEN), np.zeros((2, 1, 4 * HIDDEN), np.float32), scale(2 * HIDDEN, TAGS), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32), np.zeros(TAGS, np.float32))
    net.b[..., HIDDEN : 2 * HIDDEN] = 1  # remember at first
    return net


def _forward(net: Network, seq: np.ndarray, keep: bool = False):
    """Emissions (n, length, tags) of windows of symbols; with ``keep``, also what training needs."""
    n, length = seq.shape
    both = np.stack((seq, seq[:, ::-1]))
    h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
    outs, saved = np.empty((length, 2, n, HIDDEN), np.float32), []
    for k in range(length):
        z = np.matmul(h, net.u)
        z += np.stack((net.x[0][both[0, :, k]], net.x[1][both[1, :, k]]))
        z += net.b
        gates = 1 / (1 + np.exp(-np.clip(z[..., : 3 * HIDDEN], -30, 30)))
        i, f, o = gates[..., :HIDDEN], gates[..., HIDDEN : 2 * HIDDEN], gates[..., 2 * HIDDEN :]
        g = np.tanh(z[..., 3 * HIDDEN :])
        before, c_before = h, c
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        outs[k] = h
        if keep:
            saved.append((both[:, :, k], before, c_before, i, f, o, g, tc))
    hidden = np.concatenate((outs[:, 0], outs[::-1, 1]), axis=-1).transpose(1, 0, 2)
    emit = hidden @ net.o + net.c
    return (emit, hidden, saved) if keep else emit


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def _crf(net: Network, emit: np.ndarray, tags: np.ndarray):
    """Mean negative log likelihood and its slopes by emissions, transitions and first tags."""
    n, length, _ = emit.shape
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    alpha[:, 0] = net.s + emit[:, 0]
    for k in range(1, length):
        alpha[:, k] = _lse(alpha[:, k - 1, :, None] + net.t, 1) + emit[:, k]
    for k in range(length - 2, -1, -1):
        beta[:, k] = _lse(net.t + (emit[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
    log_z = _lse(alpha[:, -1], 1)
    d_emit = np.exp(alpha + beta - log_z[:, None, None])
    d_t = np.zeros_like(net.t)
    for k in range(1, length):
        d_t += np.exp(alpha[:, k - 1, :, None] + net.t + (emit[:, k] + beta[:, k])[:, None, :] - log_z[:, None, None]).sum(0)
    rows = np.arange(n)
    d_s = d_emit[:, 0].sum(0) - np.bincount(tags[:, 0], minlength=TAGS)
    np.add.at(d_t, (tags[:, :-1], tags[:, 1:]), -1)
    path = net.s[tags[:, 0]] + np.take_along_axis(emit, tags[..., None], 2)[..., 0].sum(1) + net.t[tags[:, :-1], tags[:, 1:]].sum(1)
    d_emit[rows[:, None], np.arange(length)[None, :], tags] -= 1
    return float((log_z - path).mean()), d_emit / n, d_t / n, d_s / n


def _slopes(net: Network, seq: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
    emit, hidden, saved = _forward(net, seq, keep=True)
    loss, d_emit, d_t, d_s = _crf(net, emit, tags)
    length = seq.shape[1]
    d_o, d_c = np.einsum("nlh,nlt->ht", hidden, d_emit), d_emit.sum((0, 1))
    d_hidden = (d_emit @ net.o.T).transpose(1, 0, 2)
    into = np.stack((d_hidden[..., :HIDDEN], d_hidden[::-1, :, HIDDEN:]), axis=1)  # by step of each direction
    d_x, d_u, d_b = np.zeros_like(net.x), np.zeros_like(net.u), np.zeros_like(net.b)
    dh, dc = np.zeros_like(into[0]), np.zeros_like(into[0])
    for k in range(length - 1, -1, -1):
        at, before, c_before, i, f, o, g, tc = saved[k]
        dh = dh + into[k]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate((dc * g * i * (1 - i), dc * c_before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), axis=-1)
        for d in (0, 1):
            np.add.at(d_x[d], at[d], dz[d])
        d_u += np.matmul(before.transpose(0, 2, 1), dz)
        d_b += dz.sum(1, keepdims=True)
        dh = np.matmul(dz, net.u.transpose(0, 2, 1))
        dc = dc * f
    return loss, [d_x, d_u, d_b, d_o, d_c, d_t, d_s]


# ---- labelled spans ------------------------------------------------------------------------------------------------
def labelled(rng: np.random.Generator) -> tuple[str, list[Span]]:
    """A generated text of about 300 characters with its personal data as spans."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    number = lambda n: "".join(str(int(d)) for d in rng.integers(0, 10, n))
    syllables = "th an er in on re ou st ion le de la es und der ge que mi co ña é ü tion ing".split()

    def word() -> str:
        w = "".join(pick(syllables) for _ in range(int(rng.integers(1, 5))))
        return w.capitalize() if rng.random() < 0.15 else w

    def ascii_word() -> str:
        return "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(int(rng.integers(2, 9))))

    def card() -> str:
        n = number(15)
        n += next(c for c in "0123456789" if luhn(n + c))
        return pick((n, n, " ".join(n[k : k + 4] for k in range(0, 16, 4)), "-".join(n[k : k + 4] for k in range(0, 16, 4))))

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return pick((f"+{pick('1234')} ({a}) {b}-{c}", f"+{number(2)} {number(2)} {number(7)}", f"+{number(2)}-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{number(2)} {a} {b} {number(2)} {number(2)}", f"+{number(11)}"))

    def email() -> str:
        local = pick((ascii_word(), f"{ascii_word()}.{number(2)}", f"{ascii_word()}.{ascii_word()}", f"{ascii_word()}_{number(1)}", f"{ascii_word()}+{ascii_word()}"))
        return f"{local}@{pick(('', 'mail.', 'mail' + number(1) + '.'))}{ascii_word()}.{pick(('com', 'org', 'net', 'de', 'co.uk', 'io'))}"

    def other() -> str:
        return pick((
            f"{number(1)}.{number(1)}", f"version {number(1)}.", f"{number(1)}.{number(1)}.{number(2)}", f"password={number(2)}b{number(3)}fa{number(4)}c", f'token = "{number(3)}ae{number(5)}dc{number(4)}b"',
            f"AKIA{number(2)}XQ{number(2)}KDHLT{number(1)}", f"20{number(2)}-0{number(1)}-1{number(1)}", f"1{number(1)}:{number(2)}", f"${number(3)}.{number(2)}", number(int(rng.integers(1, 9))), f"19{number(2)}-20{number(2)}",
            f"@{ascii_word()}", f"{ascii_word()}@{ascii_word()}", f"978-3-{number(2)}-{number(6)}-{number(1)}", f"{number(3)},{number(3)}", f"(c) 20{number(2)}", f"CC BY-NC {number(1)}.0", f"1+{number(1)}", f"{ascii_word()}{number(2)}",
        ))

    makers = {"email": email, "ip": lambda: ".".join(str(int(x)) for x in rng.integers(0, 256, 4)), "card": card, "phone": phone}
    text, spans = "", []
    while len(text) < 300:
        r = rng.random()
        if r < 0.14:
            kind = pick(KINDS)
            s = makers[kind]()
            spans.append((kind, len(text), len(text) + len(s)))
        else:
            s = other() if r < 0.24 else word()
        text += s + pick((" ", " ", " ", " ", " ", " ", ", ", ". ", ".\n", "; ", " ("))
    return text, spans


def _examples(n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    seq, tags = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    for r in range(n):
        text, spans = labelled(rng)
        full = np.zeros(len(text), np.int64)
        for kind, a, b in spans:
            full[a], full[a + 1 : b] = 1 + 2 * KINDS.index(kind), 2 + 2 * KINDS.index(kind)
        at = int(rng.integers(0, len(text) - 30))
        part = symbols(text)[at : at + WINDOW]
        seq[r, : len(part)], tags[r, : len(part)] = part, full[at : at + WINDOW]
    return seq, tags


def _forbidden() -> np.ndarray:
    """Transitions into the inside of a kind from anything but that kind."""
    t = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        t[:, 2 + 2 * k] = -1e4
        t[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return t


@lru_cache(2)
def trained(seed: int = 5, examples: int = 2000, epochs: int = 10, batch: int = 100) -> Network:
    """The network after Adam on ``examples`` generated windows; the same for the same parameters."""
    rng = np.random.Generator(np.random.PCG64(seed))
    net = _new(rng)
    seq, tags = _examples(examples, rng)
    m = [np.zeros_like(p) for p in net.parts()]
    v = [np.zeros_like(p) for p in net.parts()]
    step, total = 0, epochs * -(-examples // batch)
    for _ in range(epochs):
        order = rng.permutation(examples)
        for k in range(0, examples, batch):
            step += 1
            rows = order[k : k + batch]
            _, slopes = _slopes(net, seq[rows], tags[rows])
            norm = float(np.sqrt(sum(float((g * g).sum()) for g in slopes)))
            rate = 0.015 * min(1, 10 * step / total) * (1 - 0.9 * step / total)
            for p, g, a, b in zip(net.parts(), slopes, m, v, strict=True):
                g = g * min(1.0, 5 / max(norm, 1e-9))
                a += 0.1 * (g - a)
                b += 0.002 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.998**step)) + 1e-8)
    net.t = net.t + _forbidden()
    return net


def decode(net: Network, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best tags, emission of the best tag above that of no data) of each window's characters."""
    emit = _forward(net, seq)
    n, length, _ = emit.shape
    score, back = net.s + emit[:, 0], np.zeros((length, n, TAGS), np.int8)
    for k in range(1, length):
        all_ = score[:, :, None] + net.t
        back[k] = all_.argmax(1)
        score = np.take_along_axis(all_, back[k][:, None, :].astype(np.int64), 1)[:, 0] + emit[:, k]
    tags = np.empty((n, length), np.int64)
    tags[:, -1] = score.argmax(1)
    for k in range(length - 1, 0, -1):
        tags[:, k - 1] = back[k][np.arange(n), tags[:, k]]
    return tags, np.take_along_axis(emit, tags[..., None], 2)[..., 0] - emit[..., 0]


def reconcile(spans: list[tuple[str, int, int, float]]) -> list[Span]:
    """The non-overlapping spans of greatest total score (weighted interval scheduling)."""
    best: dict[Span, float] = {}
    for kind, a, b, s in spans:
        best[kind, a, b] = max(s, best.get((kind, a, b), 0))
    items = sorted(best.items(), key=lambda x: (x[0][2], x[0][1], x[0][0]))
    ends = [x[0][2] for x in items]
    value = [0.0] * (len(items) + 1)
    take = [0] * (len(items) + 1)
    for k, ((_, a, _), s) in enumerate(items, 1):
        before = int(np.searchsorted(ends, a, side="right"))
        before = min(before, k - 1)
        take[k] = before if value[before] + s > value[k - 1] else -1
        value[k] = max(value[k - 1], value[before] + s)
    out, k = [], len(items)
    while k:
        if take[k] >= 0:
            out.append(items[k - 1][0])
            k = take[k]
        else:
            k -= 1
    return out[::-1]


def network_spans(net: Network, texts: list[str]) -> list[list[Span]]:
    """The network's spans of each text, over all windows that hold a digit or an @."""
    owner, begins, pieces, read_ = [], [], [], [symbols(t) for t in texts]
    at_sign = 7 + _PUNCTUATION.index("@")
    for r, s in enumerate(read_):
        marks = np.flatnonzero((s == 3) | (s == at_sign))
        if not len(marks):
            continue
        # window k covers [k * STRIDE - STRIDE // 2, + WINDOW): a mark lies in each window whose span of the text holds it
        k = (marks + STRIDE // 2) // STRIDE
        for w in np.unique(np.concatenate((k, k - 1))).tolist():
            begin = w * STRIDE - STRIDE // 2
            piece = np.zeros(WINDOW, np.int64)
            low, high = max(begin, 0), min(begin + WINDOW, len(s))
            if high <= low:
                continue
            piece[low - begin : high - begin] = s[low:high]
            owner.append(r)
            begins.append(begin)
            pieces.append(piece)
    found: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    for part in range(0, len(pieces), 2048):
        tags, margin = decode(net, np.stack(pieces[part : part + 2048]))
        for row in np.flatnonzero((tags > 0).any(1)).tolist():
            r, begin, tag = owner[part + row], begins[part + row], tags[row]
            k = 0
            while k < WINDOW:
                if tag[k] == 0:
                    k += 1
                    continue
                e, kind = k + 1, (int(tag[k]) - 1) // 2
                while e < WINDOW and tag[e] == 2 + 2 * kind:
                    e += 1
                cut = (k == 0 and begin > 0) or (e == WINDOW and begin + WINDOW < len(read_[r]))
                a, b = max(begin + k, 0), min(begin + e, len(read_[r]))
                if a < b:
                    s = max(float(margin[row, k:e].sum()), 0.01)
                    found[r].append((KINDS[kind], a, b, s * (0.1 if cut else 1)))
                k = e
    out = []
    for r, spans in enumerate(found):
        text = texts[r]
        ok = []
        for kind, a, b, s in spans:
            while b > a and text[b - 1] in " .,;:-\n":
                b -= 1
            while a < b and text[a] in " .,;:\n":
                a += 1
            if b > a and plausible(kind, text[a:b]):
                ok.append((kind, a, b, s))
        out.append(reconcile(ok))
    return out


def _say(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def all_spans(net: Network, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    out = []
    for text, more in zip(texts, network_spans(net, texts), strict=True):
        base = base_spans(text)
        added = [m for m in more if not any(m[1] < b and a < m[2] for _, a, b in base)]
        out.append((base, base + added))
    return out


def find_personal_data(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """One row a document: counts of base spans by kind, their digest, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(net or trained())
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for b in K.slices(batches):
            data, offsets = K.utf8(b.column("text"))
            # base patterns and windows alike need a digit or an @ in the text
            marks = np.concatenate(([0], np.cumsum(((data >= 48) & (data <= 57)) | (data == 64))))
            rows = np.flatnonzero(marks[offsets[1:]] > marks[offsets[:-1]])
            counts = np.zeros((b.num_rows, len(KINDS)), np.int64)
            digest, said = [nothing] * b.num_rows, [""] * b.num_rows
            texts = b.column("text").take(pa.array(rows)).to_pylist()
            for r, (base, spans) in zip(rows.tolist(), all_spans(shared.value, texts), strict=True):
                for kind, _, _ in base:
                    counts[r, KINDS.index(kind)] += 1
                digest[r], said[r] = hashlib.sha256(_say(base).encode()).hexdigest(), _say(spans)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(counts[:, k]) for k in range(len(KINDS))), pa.array(digest), pa.array(said)], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the personal data of every document."""
    return find_personal_data(read(spark, sf_dir, "documents"))
