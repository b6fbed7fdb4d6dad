"""Secret scanning: base patterns plus a character convolutional network over candidates in their context.

Candidates are long runs of key-like characters that hold a digit, and every base finding. The network sees a
window of the candidate and the characters around it: embedding, one convolution, maxima over the candidate and
over its surroundings, a logistic output. It is trained in numpy on labelled findings made by rule from a seed
(keys of several services and formats; identifiers, paths, dates, numbers and prose as negatives). Platt scaling
on held-out findings calibrates it, and the threshold is the largest that keeps the wanted recall there.
Base findings always stay; the network adds spans of kind `cnn`.

Defined results: a null text counts as empty and has no spans; rows repeat as they are; ids may be null; an
empty table gives an empty result; other columns are ignored. Over a candidate longer than the window the network
slides overlapping windows and the highest score counts; the span is the whole. What base spans leave of a run is a
candidate of its own. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, documents

KINDS = ("assign", "access", "hex", "cnn")
WINDOW, CONTEXT = 48, 24
#: Steps between the windows of a long candidate: any 40 characters in a row are seen together.
STRIDE = 8
SHORTEST = 16
RECALL = 0.97

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24}[0-9a-f]*")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16}[A-Za-z0-9+/_=-]*")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Key-like runs, and of those that base spans touch what lies before, between and after the spans."""
    if not _DIGIT.search(text):
        return []
    runs = [m.span() for m in _CANDIDATE.finditer(text) if _DIGIT.search(m[0])]
    if not base:
        return runs
    cuts: list[list[int]] = []
    for start, end, _ in sorted(base):
        if cuts and start <= cuts[-1][1]:
            cuts[-1][1] = max(cuts[-1][1], end)
        else:
            cuts.append([start, end])
    out, k = [], 0
    for a, b in runs:
        while k < len(cuts) and cuts[k][1] <= a:
            k += 1
        while k < len(cuts) and cuts[k][0] < b:
            out.append((a, cuts[k][0]))
            a = cuts[k][1]
            k += 1
        k = max(0, k - 1)  # the last one may reach into the next run
        out.append((a, b))
    return [(a, b) for a, b in out if b - a >= SHORTEST and _DIGIT.search(text, a, b)]


# ---- the network

_CODE = np.full(128, 6, np.uint8)  # 0: nothing there, 1: not ASCII; letters and digits by class and by value
for _chars, _first, _each in ((string.ascii_lowercase, 10, True), (string.ascii_uppercase, 36, True), (string.digits, 62, True), (" \t\n\r", 2, False), ("=:", 3, False), ("\"'`", 4, False), ("-_.", 5, False), ("/+", 7, False), ("@&?%", 8, False), ("()[]{}<>", 9, False)):
    for _k, _c in enumerate(_chars):
        _CODE[ord(_c)] = _first + (_k if _each else 0)
SYMBOLS = 72
_LENGTH = WINDOW + 2 * CONTEXT


def windows(text: str, a: int, b: int) -> np.ndarray:
    """For each window of the candidate (one, if it is not longer than that): codes of the context before, the window and the context after."""
    at = [a] if b - a <= WINDOW else [*range(a, b - WINDOW, STRIDE), b - WINDOW]
    out = np.zeros((len(at), _LENGTH), np.uint8)
    first = max(0, a - CONTEXT)
    raw = np.frombuffer(text[first : b + CONTEXT].encode("utf-32-le"), np.uint32)
    codes = np.where(raw < 128, _CODE[np.minimum(raw, 127)], 1)
    before, inner, after = codes[: a - first], codes[a - first : b - first], codes[b - first :]
    out[:, CONTEXT - len(before) : CONTEXT] = before
    out[:, CONTEXT + WINDOW : CONTEXT + WINDOW + len(after)] = after
    for row, k in zip(out, at, strict=True):
        own = inner[k - a : k - a + WINDOW]
        row[CONTEXT : CONTEXT + len(own)] = own
    return out


def window(text: str, a: int, b: int) -> np.ndarray:
    """The first window of a candidate."""
    return windows(text, a, b)[0]


class Network:
    """Embedding 12, convolution of width 5 with 24 filters, ReLU, two maxima, logistic output, Platt scaling."""

    WIDTH, EMBED, FILTERS = 5, 12, 24

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "e": r.normal(0, 0.5, (SYMBOLS, self.EMBED)),
            "w": r.normal(0, (2 / (self.WIDTH * self.EMBED)) ** 0.5, (self.WIDTH * self.EMBED, self.FILTERS)),
            "b": np.zeros(self.FILTERS),
            "v": r.normal(0, 0.2, 2 * self.FILTERS),
            "c": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5
        positions = np.arange(_LENGTH - self.WIDTH + 1) + self.WIDTH // 2
        self.inside = (positions >= CONTEXT) & (positions < CONTEXT + WINDOW)

    def forward(self, x: np.ndarray):
        e = self.p["e"][x]
        e[x == 0] = 0
        cols = np.lib.stride_tricks.sliding_window_view(e, self.WIDTH, 1).transpose(0, 1, 3, 2).reshape(len(x), -1, self.WIDTH * self.EMBED)
        h = np.maximum(cols @ self.p["w"] + self.p["b"], 0)
        parts = [np.flatnonzero(self.inside), np.flatnonzero(~self.inside)]
        tops = [own[h[:, own].argmax(1)] for own in parts]
        pooled = np.concatenate([np.take_along_axis(h, t[:, None], 1)[:, 0] for t in tops], 1)
        return pooled @ self.p["v"] + self.p["c"][0], (cols, h, tops, pooled)

    def step(self, x: np.ndarray, y: np.ndarray, state: dict, t: int, rate: float = 4e-3) -> None:
        z, (cols, _, tops, pooled) = self.forward(x)
        dz = (1 / (1 + np.exp(-z)) - y) / len(y)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["v"], g["c"] = pooled.T @ dz, np.array([dz.sum()])
        n, f = len(x), self.FILTERS
        for half, top in enumerate(tops):
            own = slice(half * f, half * f + f)
            dh = dz[:, None] * self.p["v"][own] * (pooled[:, own] > 0)  # reaches only the place of each maximum
            picked = cols[np.arange(n)[:, None], top]  # n, filters, width * embed
            g["w"] += np.einsum("nfk,nf->kf", picked, dh)
            g["b"] += dh.sum(0)
            back = (dh[:, :, None] * self.p["w"].T[None]).reshape(n, f, self.WIDTH, self.EMBED)
            symbols = x[np.arange(n)[:, None, None], top[:, :, None] + np.arange(self.WIDTH)]
            np.add.at(g["e"], symbols, back)
        for k in self.p:
            m, s = state.setdefault(k, (np.zeros_like(self.p[k]), np.zeros_like(self.p[k])))
            m, s = 0.9 * m + 0.1 * g[k], 0.999 * s + 0.001 * g[k] ** 2
            state[k] = m, s
            self.p[k] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)

    def score(self, x: np.ndarray) -> np.ndarray:
        parts = [1 / (1 + np.exp(-(self.scale * self.forward(x[k : k + 512])[0] + self.shift))) for k in range(0, len(x), 512)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def calibrate(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Platt scaling of the highest output of each finding by Newton steps, then the largest threshold that keeps the recall. first: where the windows of each finding begin."""
        z = np.maximum.reduceat(np.concatenate([self.forward(x[k : k + 512])[0] for k in range(0, len(x), 512)]), first)
        w, a = np.array([1.0, 0.0]), np.stack([z, np.ones_like(z)], 1)
        for _ in range(30):
            p = 1 / (1 + np.exp(-a @ w))
            w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.5 * np.eye(2), a.T @ (p - y) + 0.5 * w)
        self.scale, self.shift = w
        found = np.sort(1 / (1 + np.exp(-(a @ w)[y == 1])))
        self.threshold = float(found[int((1 - recall) * len(found))])


def labelled_findings(n: int, seed: int) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """n findings (text, start, end) and whether each is a secret, half of them."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[r.integers(len(xs))]
    chars = lambda alphabet, k: "".join(alphabet[i] for i in r.integers(0, len(alphabet), k))
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    syllables = ["on", "the", "er", "ti", "re", "an", "que", "ment", "ion", "sch", "ich", "ar", "os", "en", "al", "ou", "le", "st"]
    word = lambda: "".join(pick(syllables) for _ in range(r.integers(1, 5)))
    prose = lambda k: " ".join(word() for _ in range(k))
    digits = lambda k: chars(string.digits, k)
    secrets = [
        lambda: chars(alnum, r.integers(20, 48)), lambda: chars(alnum + "+/", r.integers(27, 64)) + pick(["", "=", "=="]),
        lambda: pick(["ghp_", "gho_", "sk_live_", "rk_live_", "xoxb-", "glpat-", "npm_", "pk_", "key-", "SG_"]) + chars(alnum, r.integers(20, 40)),
        lambda: "eyJ" + chars(alnum + "-_", r.integers(30, 60)), lambda: "AIza" + chars(alnum + "-_", 35), lambda: chars(hexa, r.choice([32, 40, 64])),
        lambda: "AKIA" + chars(string.ascii_uppercase + string.digits, 16), lambda: chars(string.ascii_uppercase + string.digits, r.integers(24, 40)),
    ]
    others = [
        lambda: "-".join(word() for _ in range(r.integers(3, 7))) + "-" + digits(r.integers(1, 5)), lambda: "/".join([word(), word(), digits(4), word() + word()]),
        lambda: word() + word() + word() + word() + digits(r.integers(1, 4)), lambda: digits(r.integers(16, 24)), lambda: f"2024-{digits(2)}-{digits(2)}T{digits(2)}-{digits(2)}-{digits(2)}-{digits(3)}",
        lambda: "_".join([word(), word(), digits(2), word(), word()]), lambda: "-".join(digits(4) for _ in range(4)), lambda: "=" * r.integers(8, 30) + digits(2) + "=" * 8,
        lambda: (word() + digits(1)) * int(r.integers(4, 9)), lambda: "-".join(chars(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: word().upper() + "_" + word().upper() + "_" + digits(3) + "_" + word().upper(),
        lambda: "".join(word().capitalize() for _ in range(5)) + digits(2), lambda: "-" * 12 + digits(r.integers(1, 3)) + "-" * 12,
    ]
    leads = ["key = ", "Authorization: Bearer ", "auth=", "export KEY=", "\"key\": \"", "credentials: ", "", "", "access ", "client_id: "]
    plain = ["see ", "page ", "in ", "file ", "id ", "", "", "number ", "http://example.com/", "on "]
    out, y = [], (np.arange(n) % 2 == 0).astype(float)
    for secret in y:
        body = pick(secrets if secret else others)()
        lead = prose(r.integers(0, 6)) + " " + pick(leads if secret and r.random() < 0.7 else plain)
        out.append((lead + body + pick([" ", "\n", '" ', ". ", ", "]) + prose(r.integers(0, 5)), len(lead), len(lead) + len(body)))
    return out, y


@lru_cache(maxsize=2)
def trained(seed: int = 7, size: int = 3000, steps: int = 350, recall: float = RECALL) -> Network:
    found, y = labelled_findings(size, seed)
    x = [windows(*f) for f in found]
    fit = size * 3 // 4
    net, state, r = Network(seed), {}, np.random.default_rng(seed)
    for t in range(1, steps + 1):
        rows = r.integers(0, fit, 96)
        net.step(np.stack([x[k][r.integers(len(x[k]))] for k in rows]), y[rows], state, t)
    net.calibrate(np.concatenate(x[fit:]), _starts(x[fit:]), y[fit:], recall)
    return net


def _starts(x: list[np.ndarray]) -> np.ndarray:
    return np.cumsum([0, *map(len, x[:-1])])


def find(texts: list[str | None], net: Network) -> list[tuple[list[Span], list[Span], list[float]]]:
    """For each text: base spans and all spans by start, then kind; and the score of each of the latter."""
    found, seen = [], []
    for t in texts:
        t = t or ""
        base = base_spans(t)
        more = candidates(t, base)
        seen += [windows(t, a, b) for a, b, *_ in (*base, *more)]
        found.append((base, more))
    scores = np.maximum.reduceat(net.score(np.concatenate(seen)), _starts(seen)) if seen else np.zeros(0)
    out, at = [], 0
    for base, more in found:
        p = scores[at : at + len(base) + len(more)].tolist()
        at += len(p)
        every = list(zip(base, p, strict=False)) + [((a, b, "cnn"), q) for (a, b), q in zip(more, p[len(base) :], strict=True) if q >= net.threshold]
        order = lambda s: (s[0], KINDS.index(s[2]))
        every.sort(key=lambda s: order(s[0]))
        out.append((sorted(base, key=order), [s for s, _ in every], [q for _, q in every]))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


_OUT = "doc_id long, n_assign long, n_access long, n_hex long, n_cnn long, base_sha256 string, spans string, scores string"


def secret_scan(docs: DataFrame, net: Network | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts by kind, digest of the base spans, all spans, and the calibrated score of each."""
    held = docs.sparkSession.sparkContext.broadcast(net or trained())

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, (base, every, scores) in zip(batch.column("doc_id").to_pylist(), find(batch.column("text").to_pylist(), held.value), strict=True):
            counts = [sum(s[2] == k for s in every) for k in KINDS]
            rows.append((doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), ",".join(f"{q:.3f}" for q in scores)))
        kinds = [x.split() for x in _OUT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "long" else pa.string()) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], [k for k, _ in kinds])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), scan, _OUT)


def op1(spark, sf_dir):
    return secret_scan(documents(spark, sf_dir))
