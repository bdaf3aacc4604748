"""Personal data by fixed patterns and a character-level bidirectional LSTM with CRF transitions.

The patterns give the base spans. The tagger, trained in numpy from labelled spans, reads every
character of every text in overlapping windows, and each window is decoded by Viterbi. The spans of
all windows are then reconciled over the whole text: those of one kind that overlap are one, and of
different kinds that overlap the choice with the largest total score stays. A tagger's span is added
if it overlaps no base span and passes its kind's exact check, so that the tagger adds written-out
or loosely written forms that the patterns miss. It also finds secrets, keys and tokens that
programs use, which are reported apart.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalquarry.llm.common import packed, portions, table, tidied, work_path
from evalquarry.llm.langid import adam
from evalquarry.sources.records import hadoop_list

KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS)
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
WINDOW, MARGIN = 1024, 32
HIDDEN = 12
GROUP, PORTION, STEP = 1024, 1 << 22, 16
EXAMPLES, LENGTH, EPOCHS, BATCH, RATE, SEED = 4000, 112, 7, 64, 0.02, 10
_domain = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+").match
_numeric = re.compile(r"[0-9][0-9\x20.-]{6,}").finditer  # every address and card lies in one of these
_chain = re.compile(r"[0-9]+(?:\.[0-9]+)*").finditer
_card = re.compile(r"[0-9]([\x20-]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_digits = re.compile(r"[^0-9]").sub


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def emails(text: str):
    """Leftmost matches, found from each @ so that long runs cost no more than their length."""
    at = text.find("@")
    free = 0
    while at >= 0:
        head = text[free:at]
        start = free + len(head.rstrip(LOCAL))
        free = at + 1
        if start < at and (m := _domain(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", free)


def addresses(text: str, *within: int):
    for m in _chain(text, *within):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:].lstrip("0") or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of all base matches, by kind and start."""
    out = [(0, *s) for s in emails(text)] if "@" in text else []
    runs = [m.span() for m in _numeric(text)]
    out += [(1, *s) for r in runs if text.count(".", *r) >= 3 for s in addresses(text, *r)]
    for m in (m for r in runs if r[1] - r[0] >= 13 for m in _card(text, *r)):
        d = _digits("", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _phone(text) if 9 <= len(_digits("", m[0])) <= 15]
    return out


def added_ok(kind: int, s: str) -> bool:
    """The exact check of a span that the tagger proposes."""
    d = _digits("", s)
    if kind == 0:
        return bool(re.fullmatch(r"[\w.%+-]+\s*(@|[\[(]\s*at\s*[\])]|\bat\b)\s*[\w-]+(\s*(\.|[\[(]\s*dot\s*[\])]|\bdot\b)\s*[\w-]+)+", s, re.I)) and bool(re.search(r"@|[\[(]at|\bat\b.*\bdot\b", s, re.I))
    if kind == 1:
        parts = re.split(r"\s*(?:\.|[\[(]\s*\.\s*[\])]|[\[(]?\s*\bdot\b\s*[\])]?)\s*", s, flags=re.I)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == SECRET:
        return bool(re.fullmatch(r"[A-Za-z0-9+/_.=-]{16,}", s)) and len(d) >= 4 and sum(map(str.isalpha, s)) >= 4
    return 9 <= len(d) <= 15 and bool(re.fullmatch(r"(\+|00|\(?[0-9]{3}\)?[ .-])[\x20().0-9/-]+[0-9]", s)) and bool(re.search(r"[\x20().-]", s))


# Character classes: 0 pads; letters without case; one class for digits, one for other letters.
_MARKS = [c for c in map(chr, range(33, 127)) if not c.isalnum()] + [" ", "\n"]
_CLASS = np.full(129, 1, np.uint8)
_CLASS[128] = 2
for _k, _c in enumerate(_MARKS):
    _CLASS[ord(_c)] = 3 + _k
for _k in range(26):
    _CLASS[97 + _k] = _CLASS[65 + _k] = 3 + len(_MARKS) + _k
_CLASS[48:58] = 29 + len(_MARKS)
CLASSES = 30 + len(_MARKS)
TAGS = 2 + len(KINDS)


def codes(text: str) -> np.ndarray:
    """The class of each code point."""
    return _CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


class Room:
    """Arrays by name that are used again, as fresh memory for every step and group costs more than sums."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, dtype: type, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size, dtype)
        return self.held[name][:size].reshape(shape)


def resized(a: np.ndarray, m: int) -> np.ndarray:
    """The first m columns of a matrix, with zeros for those it lacks."""
    out, k = np.zeros((len(a), m), a.dtype), min(m, a.shape[1])
    out[:, :k] = a[:, :k]
    return out


class Tagger:
    """Two LSTM directions over class embeddings, an emission layer and CRF transitions; tag 0 is outside."""

    def __init__(self, hidden: int = HIDDEN, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        f = lambda *s, scale=0.3: r.normal(0, scale, s).astype(np.float32)
        self.h = hidden
        self.w = [f(CLASSES, 4 * hidden), f(CLASSES, 4 * hidden)]
        self.u = [f(hidden, 4 * hidden), f(hidden, 4 * hidden)]
        self.bias = [np.zeros(4 * hidden, np.float32) for _ in range(2)]
        for b in self.bias:
            b[hidden : 2 * hidden] = 1
        self.e, self.eb = f(2 * hidden, TAGS), np.zeros(TAGS, np.float32)
        self.trans = np.zeros((TAGS, TAGS), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [*self.w, *self.u, *self.bias, self.e, self.eb, self.trans]

    def masked_trans(self) -> np.ndarray:
        """A span keeps its kind: steps between two kinds are forbidden."""
        k = np.arange(TAGS)
        bad = (k[:, None] != k) & (k[:, None] > 0) & (k > 0)
        return np.where(bad, np.float32(-1e4), self.trans)

    def direction(self, x: np.ndarray, which: int, keep: bool = False):
        """(T, n, hidden) states over codes (T, n), from the start or from the end."""
        steps, n = x.shape
        h, half = self.h, np.float32(0.5)
        gates = (self.w[which] + self.bias[which]).copy()
        gates[:, : 3 * h] *= half  # sigmoid(z) is (1 + tanh(z / 2)) / 2
        u = self.u[which].copy()
        u[:, : 3 * h] *= half
        out = np.empty((steps, n, h), np.float32)
        state, cell, saved = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), []
        for t in range(steps) if which == 0 else range(steps - 1, -1, -1):
            z = gates[x[t]]
            z += state @ u
            np.tanh(z, out=z)
            z[:, : 3 * h] += 1
            z[:, : 3 * h] *= half
            before, last = cell, state
            cell = z[:, h : 2 * h] * cell + z[:, :h] * z[:, 3 * h :]
            squashed = np.tanh(cell)
            state = z[:, 2 * h : 3 * h] * squashed
            out[t] = state
            if keep:
                saved.append((t, z, before, last, squashed))
        return out, saved

    def emissions(self, x: np.ndarray, live: np.ndarray | None = None, room: Room | None = None) -> np.ndarray:
        """(T, TAGS, n), by the recurrence of ``direction`` laid out so that every gate is one block of memory.

        At step t the first ``live[t]`` windows (all, if None) have characters; what follows them is not
        set. States are not kept: each is turned into emissions at once.
        """
        steps, n = x.shape
        h, room = self.h, room or Room()
        many = [n] * steps if live is None else live.tolist()
        half = np.full((4 * h, 1), 0.5, np.float32)
        half[3 * h :] = 1
        em = room("em", np.float32, steps, TAGS, n)
        for which in range(2):
            gates = np.ascontiguousarray((self.w[which] + self.bias[which]).T) * half
            # States are held doubled, which saves halving every gate: weights that meet them are halved.
            u = np.concatenate([self.u[which].T * half, self.e[which * h : (which + 1) * h].T]) * np.float32(0.5)
            cell, state, m, last = np.zeros((h, 0), np.float32), np.zeros((h, 0), np.float32), 0, -1
            for t in [*(range(steps) if which == 0 else range(steps - 1, -1, -1)), -1]:
                if t < 0 or many[t] != m:
                    if last >= 0:
                        self._emit(em[last, :, :m], u[4 * h :] @ state, which)
                    if t < 0:
                        break
                    m, last = many[t], -1
                    cell, state = resized(cell, m), resized(state, m)
                    z, both, one = (room(k, np.float32, rows, m) for k, rows in (("z", 4 * h), ("both", 4 * h + TAGS), ("one", h)))
                    sigmoids, keep, new, show, value = z[: 3 * h], z[h : 2 * h], z[:h], z[2 * h : 3 * h], z[3 * h :]
                    more, shown = both[: 4 * h], both[4 * h :]
                # One product gives what the last state adds to the gates and what it emits.
                np.matmul(u, state, out=both)
                if last >= 0:
                    self._emit(em[last, :, :m], shown, which)
                gates.take(x[t, :m], axis=1, out=z, mode="clip")
                z += more
                np.tanh(z, out=z)
                sigmoids += 1
                cell *= keep
                new *= value
                cell += new
                cell *= 0.5
                np.tanh(cell, out=one)
                np.multiply(show, one, out=state)
                last = t
        return em

    def _emit(self, at: np.ndarray, values: np.ndarray, which: int) -> None:
        np.add(values, self.eb[:, None] if which == 0 else at, out=at)

    def decode(self, x: np.ndarray, live: np.ndarray | None = None, room: Room | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi tags (T, n) of codes (T, n), and their emissions; ``live`` as in ``emissions``, tags are 0 beyond.

        What is returned lies in ``room`` and lasts until its next use.
        """
        room = room or Room()
        em, tr = self.emissions(x, live, room), self.masked_trans()
        steps, _, n = em.shape
        many = [n] * steps if live is None else live.tolist()
        leave, stays, enter = tr[:, 0][:, None], np.diag(tr)[1:, None], tr[0, 1:][:, None]
        scores = room("scores", np.float32, steps, TAGS, n)
        stay = room("stay", bool, steps, TAGS - 1, n)
        left = room("left", bool, steps, n)  # whether a span ends before this step, if this step is outside
        scores[0] = em[0]
        m = 0
        for t in range(1, steps):
            if many[t] != m:
                m = many[t]
                out, ended, on, new = (room(k, np.float32, rows, m) for k, rows in (("out", TAGS), ("ended", 1), ("on", TAGS - 1), ("new", TAGS - 1)))
                ended = ended[0]
            s, now = scores[t - 1, :, :m], scores[t, :, :m]
            np.add(s, leave, out=out)
            np.maximum.reduce(out[1:], axis=0, out=ended)
            np.greater(ended, out[0], out=left[t, :m])
            np.maximum(ended, out[0], out=now[0])
            np.add(s[1:], stays, out=on)
            np.add(s[0], enter, out=new)
            np.greater_equal(on, new, out=stay[t, :, :m])
            np.maximum(on, new, out=now[1:])
            now += em[t, :, :m]
        tag = room("tag", np.int8, steps, n)
        tag[...] = 0
        m = 0
        for t in range(steps - 1, -1, -1):
            if many[t] > m:  # windows whose last character this is
                tag[t, m : many[t]] = scores[t, :, m : many[t]].argmax(0)
                m = many[t]
            if not t:
                break
            now = tag[t, :m]
            if (inside := now.nonzero()[0]).size:
                k = now[inside]
                tag[t - 1, inside] = np.where(stay[t][k - 1, inside], k, 0)
            if (end := (left[t, :m] > now.view(bool)).nonzero()[0]).size:
                tag[t - 1, end] = (scores[t - 1][1:, end] + leave[1:]).argmax(0) + 1
        return tag, em

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean negative log-likelihood of tags y (T, n), in the order of ``weights``."""
        steps, n = x.shape
        h = self.h
        runs = [self.direction(x, k, keep=True) for k in range(2)]
        states = np.concatenate([runs[0][0], runs[1][0]], 2)
        em, tr = (states @ self.e + self.eb).astype(np.float64), self.masked_trans().astype(np.float64)
        a, b = np.empty_like(em), np.zeros_like(em)
        a[0] = em[0]
        for t in range(1, steps):
            a[t] = em[t] + lse(a[t - 1][:, :, None] + tr, 1)
        for t in range(steps - 2, -1, -1):
            b[t] = lse(tr + (em[t + 1] + b[t + 1])[:, None, :], 2)
        z = lse(a[-1], 1)
        d_em = np.exp(a + b - z[None, :, None])
        pair = np.exp(a[:-1, :, :, None] + tr + (em[1:] + b[1:])[:, :, None, :] - z[None, :, None, None])
        d_tr = pair.sum((0, 1))
        np.subtract.at(d_tr, (y[:-1].ravel(), y[1:].ravel()), 1)
        d_em[np.arange(steps)[:, None], np.arange(n), y] -= 1
        d_em = (d_em / (n * steps)).astype(np.float32)
        d_states = d_em @ self.e.T
        grads_w, grads_u, grads_b = [], [], []
        for k in range(2):
            dw, du = np.zeros_like(self.w[k]), np.zeros_like(self.u[k])
            dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t, z_, before, last, sq in reversed(runs[k][1]):
                i, f, o, g = (z_[:, j * h : (j + 1) * h] for j in range(4))
                dh = dh + d_states[t, :, k * h : (k + 1) * h]
                dc = dc + dh * o * (1 - sq * sq)
                dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * sq * o * (1 - o), dc * i * (1 - g * g)], 1)
                np.add.at(dw, x[t], dz)
                du += last.T @ dz
                dh, dc = dz @ self.u[k].T, dc * f
            grads_w.append(dw)
            grads_u.append(du)
            grads_b.append(dw.sum(0))
        return [*grads_w, *grads_u, *grads_b, np.tensordot(states, d_em, ([0, 1], [0, 1])), d_em.sum((0, 1)), (d_tr / (n * steps)).astype(np.float32)]


def lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - m).sum(axis, keepdims=True)) + m).squeeze(axis)


# Frequent words of four languages, and syllables of made-up ones.
FRAMES = {
    "en": "the of and to in is that for it was on are with they be at one have this from".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
SYLLABLES = "the and re ing tion er de la que en ung ch ver os ción ra ll ent é è ñ ü ma ti on is at of a in to ge lich keit eau ou ai".split()
LEADS = {
    0: ["", "", "", "mail ", "e-mail: ", "write to ", "Kontakt: ", "courriel : ", "correo: ", "<", "(", '"', "from "],
    1: ["", "", "", "ip ", "IP: ", "host ", "server ", "from ", "Adresse ", "[", "("],
    2: ["", "", "", "card ", "card no. ", "Karte: ", "carte ", "tarjeta ", "visa ", "# "],
    3: ["", "", "", "tel ", "Tel.: ", "phone: ", "call ", "Telefon ", "tél. ", "llame al ", "fax "],
    4: ['token = "', 'token="', 'api_key = "', "api-key: ", "secret=", "password: ", 'key = "', "bearer ", "export KEY=", ""],
}


def labelled_spans(n: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Made-up texts with labelled spans, without their leads and quotes.

    Prose of four languages and of none, in plain, shouted, tabular and littered writing, with numbers
    and other things that look like personal data, around personal data and secrets in many spellings.
    """
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    digits = lambda k: "".join(map(str, r.integers(0, 10, k)))
    among = lambda chars, k: "".join(chars[i] for i in r.integers(0, len(chars), k))

    def invented():
        return "".join(pick(SYLLABLES) for _ in range(int(r.integers(1, 4))))

    def junk():
        return pick([
            lambda: digits(int(r.integers(1, 16))), lambda: f"{digits(1)}.{digits(2)}", lambda: f"v{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"{digits(1)}.{digits(3)}.{digits(3)}",
            lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}.{digits(2)}.{digits(4)}", lambda: f"{digits(2)}:{digits(2)}", lambda: "$" + digits(3), lambda: f"({digits(4)})", lambda: invented() + "!!",
            lambda: f"https://{invented()}.example.org/{invented()}", lambda: "***", lambda: "|", lambda: f"{invented()} at {invented()}", lambda: f"{invented()} dot {invented()}", lambda: f"{invented()} at {invented()}.", lambda: "@" + invented(),
            lambda: f"{digits(3)} {digits(3)}", lambda: f"{invented()} = {digits(3)}", lambda: f'{invented()} = "{invented()}"', lambda: invented() * 5, lambda: f"page {digits(2)}-{digits(2)}", lambda: f"ISBN {digits(3)}-{digits(1)}-{digits(5)}",
        ])()

    def card():
        head = digits(14) if r.random() < 0.2 else digits(15)
        whole = next(s for last in range(10) if luhn(s := head + str(last)))
        four = [whole[i : i + 4] for i in range(0, len(whole), 4)]
        return pick([whole, " ".join(four), "-".join(four), ".".join(four), "/".join(four), "  ".join(four), "_".join(four)])

    def email():
        user = pick([lambda: invented() + "." + digits(2), lambda: "user" + digits(2), lambda: pick(["j.doe", "k_lee", "info", "ann", "max.p"]), invented, lambda: f"{invented()}.{invented()}"])()
        host, top = pick(["mail", "example", "post", "web", "inbox", invented()]) + pick(["", digits(1)]), pick(["com", "org", "net", "de", "fr", "es", "example.com"])
        at, dot = pick([("@", "."), ("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" @ ", "."), (" AT ", " DOT "), ("[at]", "."), (" (at) ", ".")])
        return f"{user}{at}{host}{dot}{top}"

    def ip():
        return pick([".", ".", ".", "[.]", " dot ", "(dot)", " . "]).join(str(int(x)) for x in r.integers(0, 256, 4))

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"+1 ({a}) {b}-{c}", f"+49 {a} {b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{a} {b} {c}", f"+33.{a}.{b}.{c}", f"+{a[:2]} {b} {c} {a}", f"({a}) {b} {c}", f"0049/{a}/{b}{c}"])

    def secret():
        k = int(r.integers(20, 44))
        return pick([lambda: among("0123456789abcdef", k), lambda: among("0123456789ABCDEF", k), lambda: "sk-" + among("abcdefghijkmnopqrstuvwxyzABCDEFGH0123456789", k), lambda: "AKIA" + among("ABCDEFGHJKLMNPQRSTUVWXYZ234567", 16), lambda: among("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k) + "="])()

    made, out = (email, ip, card, phone, secret), []
    for _ in range(n):
        text, spans, frame, style = "", [], pick([*FRAMES.values(), SYLLABLES]), r.random()
        mark, sep = ("!!", " ") if style < 0.08 else (pick(["%%%", "***", "&&&", "$$$"]), " ") if style < 0.14 else ("", " | ") if style < 0.2 else ("", " ")
        up = 0.08 < style < 0.11 or style < 0.08
        while len(text) < LENGTH:
            x = r.random()
            if x < 0.13:
                k = int(r.integers(5))
                lead, s = pick(LEADS[k]), made[k]()
                if len(text) + len(lead) + len(s) > LENGTH - 2:
                    break
                tail = lead[-1:] if lead[-1:] == '"' else {"<": ">", "(": ")", "[": "]"}.get(lead[-1:], "")
                # Letters that a check depends on keep their case.
                lead, s = (lead.upper(), s.upper() if k != SECRET else s) if up else (lead, s)
                spans.append((k, len(text) + len(lead), len(text) + len(lead) + len(s)))
                s = lead + s + tail
            elif x < 0.85:
                s = pick(frame) if r.random() < 0.5 else invented()
                s = s.upper() if up else s.capitalize() if r.random() < 0.1 else s
            else:
                s = junk()
            text += s + mark + (sep if sep != " " else pick([" ", " ", " ", " ", ". ", ", ", "\n", ") "]))
        out.append((text[:LENGTH], spans))
    return out


def train(examples: list[tuple[str, list[tuple[int, int, int]]]], *, epochs: int = EPOCHS, seed: int = SEED) -> Tagger:
    """A tagger from texts with (kind number, start, end) spans; texts are cut or padded to LENGTH."""
    x, y = np.zeros((LENGTH, len(examples)), np.uint8), np.zeros((LENGTH, len(examples)), np.int64)
    for j, (text, spans) in enumerate(examples):
        c = codes(text[:LENGTH])
        x[: len(c), j] = c
        for k, s, e in spans:
            y[s:e, j] = 1 + k
    net, r = Tagger(seed=seed), np.random.default_rng(seed)
    total = epochs * -(-len(examples) // BATCH)
    step, done = adam(net.weights(), RATE), 0
    for _ in range(epochs):
        order = r.permutation(len(examples))
        for k in range(0, len(examples), BATCH):
            mine = order[k : k + BATCH]
            grads = net.gradients(x[:, mine], y[:, mine])
            norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
            scale = min(1.0, 1.0 / (norm + 1e-9)) * (1 - 0.9 * done / total)
            step([g * scale for g in grads])
            done += 1
    return net


_TRAINED: dict[str, Tagger] = {}


def settings() -> str:
    """A digest of all that the tagger's weights depend on."""
    examples = hashlib.sha256(json.dumps(labelled_spans(20)).encode()).hexdigest()
    return hashlib.sha256(json.dumps([EXAMPLES, LENGTH, EPOCHS, BATCH, RATE, SEED, HIDDEN, CLASSES, TAGS, examples]).encode()).hexdigest()[:16]


def default_tagger(spark: SparkSession) -> Tagger:
    """The tagger of ``labelled_spans``; it depends on no table.

    Trained once and kept in the shared folder, where other sessions of the same folder find it.
    """
    if (key := settings()) not in _TRAINED:
        path = f"{work_path(spark, 'x').rsplit('/', 1)[0]}/pii-tagger-{key}"
        net = Tagger()
        if hadoop_list(spark, f"{path}/_SUCCESS"):
            for r in spark.read.parquet(path).collect():
                net.weights()[r["place"]][...] = np.frombuffer(r["raw"], np.float32).reshape(net.weights()[r["place"]].shape)
        else:
            net = train(labelled_spans())
            spark.createDataFrame([(k, bytearray(w.tobytes())) for k, w in enumerate(net.weights())], "place int, raw binary").coalesce(1).write.mode("overwrite").parquet(path)
        _TRAINED[key] = net
    return _TRAINED[key]


def window_spans(tags: np.ndarray, em: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(window, kind number, start, end, score) of the runs of tags (T, n) in all windows."""
    edge = np.ones((len(tags) + 1, tags.shape[1]), bool)
    np.not_equal(tags[1:], tags[:-1], out=edge[1:-1])
    w, at = (np.concatenate([x, y]) for x, y in zip(((edge[:-1] & (tags != 0)).nonzero()[::-1]), ((edge[1:] & (tags != 0)).nonzero()[::-1])))
    order = np.lexsort((at, w))  # first and last step of each run in turn, of one step twice the same
    out = []
    for w, a, b in zip(w[order][::2].tolist(), at[order][::2].tolist(), at[order][1::2].tolist()):
        k = int(tags[a, w])
        out.append((w, k - 1, a, b + 1, float((em[a : b + 1, k, w] - em[a : b + 1, 0, w]).sum())))
    return out


def reconciled(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the spans (kind, start, end, score) of all windows of a text.

    Spans of one kind that overlap are parts of one, with the larger score; of what still overlaps,
    the choice with the largest total score stays, and of equal ones the earlier.
    """
    merged: list[list] = []
    for k, a, b, v in sorted(spans):
        if merged and merged[-1][0] == k and a < merged[-1][2]:
            merged[-1][2], merged[-1][3] = max(merged[-1][2], b), max(merged[-1][3], v)
        else:
            merged.append([k, a, b, v])
    merged.sort(key=lambda x: (x[2], x[1]))
    ends = [x[2] for x in merged]
    best: list[tuple[float, int]] = [(0.0, -1)]
    for j, (_, a, _, v) in enumerate(merged):
        with_it = best[bisect_right(ends, a, 0, j)][0] + max(v, 1e-6)
        best.append((with_it, j) if with_it > best[-1][0] else (best[-1][0], -1))
    out, j = [], len(merged)
    while j > 0:
        if best[j][1] < 0:
            j -= 1
        else:
            k, a, b, _ = merged[best[j][1]]
            out.append((k, a, b))
            j = bisect_right(ends, a, 0, best[j][1])
    return sorted(out, key=lambda x: x[1])


def tag_texts(net: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """The tagger's spans in each text, from overlapping windows.

    A text has a margin of padding before and after it. Its last window ends there, filled up to a
    multiple of STEP, so what a text gets depends on itself alone; windows of like sizes are read together.
    """
    core = WINDOW - 2 * MARGIN
    coded = [codes(t) for t in texts]
    sizes = np.array([len(c) for c in coded], np.int64)
    counts = -(-sizes // core)
    owner = np.repeat(np.arange(len(texts)), counts)
    start = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * core - MARGIN
    size = np.minimum(-(-(sizes[owner] + MARGIN - start) // STEP) * STEP, WINDOW)
    order = np.argsort(-size, kind="stable")
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    room = Room()
    for mine in np.array_split(order, -(-len(order) // GROUP)) if len(order) else []:
        steps = int(size[mine[0]])
        x = np.zeros((len(mine), steps), np.uint8)
        for row, d, s in zip(x, owner[mine].tolist(), start[mine].tolist()):
            piece = coded[d][max(s, 0) : s + WINDOW]
            row[max(-s, 0) : max(-s, 0) + len(piece)] = piece
        live = np.searchsorted(-size[mine], -np.arange(steps), "left")
        for w, k, a, b, v in window_spans(*net.decode(np.ascontiguousarray(x.T), live, room)):
            d, s = int(owner[mine[w]]), int(start[mine[w]])
            a, b = max(0, a + s), min(len(texts[d]), b + s)
            if a < b:
                found[d].append((k, a, b, v))
    return [trimmed(t, reconciled(f)) if f else [] for t, f in zip(texts, found)]


def trimmed(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans without white space, quotes and sentence marks at the ends."""
    out = []
    for k, s, e in spans:
        piece = text[s:e]
        left = len(piece) - len(piece.lstrip(" \t\r\n.,;:|!?)<>[]\"'*%$&"))
        right = len(piece.rstrip(" \t\r\n.,;:|!?(<>[]\"'*%$&"))
        if right > left:
            out.append((k, s + left, s + right))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_spans(text: str, tagged: list[tuple[int, int, int]]) -> tuple[list, list, list]:
    """Base spans, all spans by kind and start, and secrets.

    A tagger's span that overlaps a base span, even in part, gives way to it.
    """
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    more = [(k, s, e) for k, s, e in tagged if added_ok(k, text[s:e]) and not any(s < f and b < e for b, f in taken)]
    return base, sorted(base + [x for x in more if x[0] != SECRET]), [x for x in more if x[0] == SECRET]


def detect(docs: DataFrame, *, text: str = "text", tagger: Tagger | None = None, keep: list[str] | None = None) -> DataFrame:
    """(doc struct of all columns or of ``keep``, base string, spans string, secrets string) per row.

    ``base`` and ``spans`` are ``kind:start:end``, comma-joined, by kind and start; ``secrets`` are
    ``start:end``. Null and empty texts have no spans. Offsets count code points, ends are exclusive.
    Rows are read for themselves, so repeated rows get equal results and an empty table an empty one;
    a text of any length is read whole, window by window; other columns may have any name.
    """
    net = tagger or default_tagger(docs.sparkSession)
    rows, texts_of = packed(docs, text, keep)

    def run(batches):
        for b in batches:
            texts = [t or "" for t in texts_of(b)]
            base, every, secrets = [], [], []
            for lo, hi in portions(texts, PORTION):
                for t, tagged in zip(texts[lo:hi], tag_texts(net, texts[lo:hi])):
                    x, y, z = find_spans(t, tagged)
                    base.append(joined(x))
                    every.append(joined(y))
                    secrets.append(",".join(f"{s}:{e}" for _, s, e in z))
            yield pa.RecordBatch.from_arrays([b.column("doc"), *(pa.array(c, pa.string()) for c in (base, every, secrets))], names=["doc", "base", "spans", "secrets"])

    return rows.mapInArrow(tidied(run), f"doc {rows.schema['doc'].dataType.simpleString()}, base string, spans string, secrets string")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents; after the contract's columns the number of all spans, and secrets."""
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    many = lambda c: F.regexp_count(c, F.lit(":[0-9]+(,|$)")).cast("long")
    n = [F.regexp_count("base", F.lit(rf"{k}:")).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col("doc.doc_id").alias("doc_id"), *n, F.sha2("base", 256).alias("base_sha256"), "spans", many("spans").alias("n_spans"), many("secrets").alias("n_secrets"), "secrets", (many("spans") + many("secrets")).alias("n_private"))
