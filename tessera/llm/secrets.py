"""Secret scanning: patterns of known kinds, and a character network over all other candidates.

Base findings are the leftmost non-overlapping matches of three kinds:

* assign: a key word, a separator and a value (group 2) of at least 6 characters;
* access: `AKIA` and capitals or digits, at least 20 characters;
* hex: at least 24 lower-case hexadecimal digits.

Every run of at least LEAST_RUN token characters that overlaps no base finding is a candidate, unless it
is a plain word: letters alone, under PLAIN_WORD of them, without a capital after a lower-case letter. A
convolutional network in numpy reads windows over the whole candidate and its surroundings: 24 characters
before a window, 40 of the candidate and 24 after these, with a mark that tells the candidate from the
rest. Windows are 20 characters apart and the last ends with the candidate; a candidate counts as its
highest window. The network is trained on labelled findings in the same way: those given, or a fixed set
made by rule from public token formats. Its logits are calibrated on a held-out part (Platt). The
threshold keeps the wanted recall there, and lies below that as far as half-way to the harmless
candidates. Accepted candidates are spans of kind `cnn`.

Spans are code points, end exclusive. Null and empty texts have none; repeated rows each get theirs.
Spans that begin together are ordered by kind. Time is in proportion to a text's length.
"""

from __future__ import annotations

import base64
import random
import re
import string
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import sha, slices, table, texts_of
from tessera.session import ship

KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
WORD = re.compile(r"[A-Z]*[a-z]*")
LEAST_RUN, PLAIN_WORD = 8, 16
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
BEFORE, INSIDE, AFTER, STEP, WIDTH, FILTERS, EMBED = 24, 40, 24, 20, 5, 16, 8
#: Windows held at once.
BLOCK = 4_096


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings, in order."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for run in RUN.finditer(text):
        if run.end() - run.start() >= 20:  # the least of the two
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, *run.span())]
            out += [(m.start(), 2, m.end()) for m in HEX.finditer(text, *run.span())]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs without the full stops around them that overlap no base finding (in order) and are no plain word."""
    begins = [a for a, _, _ in base]
    reach = list(accumulate((b for _, _, b in base), max))  # the furthest end up to each finding
    out = []
    for run in RUN.finditer(text):
        s = run[0]
        a, b = run.start() + len(s) - len(s.lstrip(".")), run.end() - len(s) + len(s.rstrip("."))
        if b - a < LEAST_RUN or (b - a < PLAIN_WORD and WORD.fullmatch(text, a, b)):
            continue
        k = bisect_left(begins, b)
        if not k or reach[k - 1] <= a:
            out.append((a, b))
    return out


def codes(text: str, start: int, end: int, at: int | None = None) -> np.ndarray:
    """Character codes of a window of a candidate and of what stands around it; 0 pads, inside codes are 128 higher."""
    at = start if at is None else at
    first = max(0, at - BEFORE)
    piece = text[first : min(end, at + INSIDE) + AFTER]
    got = np.minimum(np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), 127)
    got[max(0, start - first) : end - first] += 128
    out = np.zeros(BEFORE + INSIDE + AFTER, np.int64)
    lead = BEFORE - (at - first)
    out[lead : lead + len(got)] = got
    return out


def starts(start: int, end: int) -> list[int]:
    """Where the windows of a candidate begin; the last one ends with it."""
    last = max(start, end - INSIDE)
    return [*range(start, last, STEP), last]


def blocks(found: list[tuple[str, int, int]]):
    """(windows, the candidate of each) in blocks of bounded size."""
    rows, own = [], []
    for k, (text, a, b) in enumerate(found):
        for at in starts(a, b):
            rows.append(codes(text, a, b, at))
            own.append(k)
            if len(rows) == BLOCK:
                yield np.array(rows), np.array(own)
                rows, own = [], []
    if rows:
        yield np.array(rows), np.array(own)


def highest(values: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """The highest value of each of n candidates."""
    out = np.full(n, -np.inf)
    np.maximum.at(out, own, values)
    return out


@dataclass
class Network:
    """Embedding, one convolution, maximum and mean over places, a dense layer; then Platt scaling."""

    embed: np.ndarray
    conv: np.ndarray
    conv_bias: np.ndarray
    dense: np.ndarray
    dense_bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    def hidden(self, x: np.ndarray):
        e = self.embed[x]
        windows = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, WIDTH * EMBED)
        z = windows @ self.conv + self.conv_bias
        r = np.maximum(z, 0)
        return windows, z, r, np.concatenate([r.max(1), r.mean(1)], 1)

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """The last of hidden(), by one table lookup for each place of the convolution."""
        places = x.shape[1] - WIDTH + 1
        z = sum((self.embed @ self.conv[k * EMBED : (k + 1) * EMBED])[x[:, k : k + places]] for k in range(WIDTH)) + self.conv_bias
        r = np.maximum(z, 0)
        return np.concatenate([r.max(1), r.mean(1)], 1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.pooled(x[i : i + 512]) @ self.dense + self.dense_bias for i in range(0, len(x), 512)] or [np.zeros(0)])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-(a * self.logits(x) + b)))


def train(x: np.ndarray, own: np.ndarray, y: np.ndarray, recall: float = 0.95, epochs: int = 12, seed: int = 7) -> Network:
    """Adam on four fifths of the findings; calibration and threshold on the rest.

    x holds windows, own the finding of each. Of a secret its highest window is learned, of a
    harmless one all; secrets of several windows wait for the first two epochs.
    """
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held = np.zeros(len(y), bool)
    held[order[: len(y) // 5]] = True
    several = np.bincount(own, minlength=len(y)) > 1
    small = lambda *a: rng.normal(0, *a).astype(np.float32)
    net = Network(small(0.3, (256, EMBED)), small(0.2, (WIDTH * EMBED, FILTERS)), np.zeros(FILTERS, np.float32), small(0.2, 2 * FILTERS), np.float32(0))
    state = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in ("embed", "conv", "conv_bias", "dense", "dense_bias")}
    step = 0
    for epoch in range(epochs):
        learned = (y[own] == 0) | ~several[own]
        if epoch > 1:
            z = net.logits(x)
            learned |= z == highest(z, own, len(y))[own]
        rest = np.flatnonzero(learned & ~held[own])
        for part in np.array_split(rng.permutation(rest), max(1, len(rest) // 64)):
            if not len(part):
                continue
            xb, yb = x[part], y[own[part]]
            windows, z, r, h = net.hidden(xb)
            g = ((1 / (1 + np.exp(-(h @ net.dense + net.dense_bias))) - yb) / len(part)).astype(np.float32)
            gh = g[:, None] * net.dense
            gr = np.repeat(gh[:, None, FILTERS:] / r.shape[1], r.shape[1], 1)
            np.put_along_axis(gr, r.argmax(1)[:, None, :], np.take_along_axis(gr, r.argmax(1)[:, None, :], 1) + gh[:, None, :FILTERS], 1)
            gz = gr * (z > 0)
            gw = (gz @ net.conv.T).reshape(len(part), -1, WIDTH, EMBED)
            ge = np.zeros((*xb.shape, EMBED), np.float32)
            for k in range(WIDTH):
                ge[:, k : k + gw.shape[1]] += gw[:, :, k]
            gembed = np.zeros_like(net.embed)
            np.add.at(gembed, xb, ge)
            grads = {"embed": gembed, "conv": np.tensordot(windows, gz, ((0, 1), (0, 1))), "conv_bias": gz.sum((0, 1)), "dense": h.T @ g, "dense_bias": g.sum()}
            step += 1
            for k, grad in grads.items():
                m, v = state[k]
                m = state[k][0] = np.float32(0.9) * m + np.float32(0.1) * grad
                v = state[k][1] = np.float32(0.999) * v + np.float32(0.001) * grad**2
                setattr(net, k, getattr(net, k) - np.float32(0.01) * (m / np.float32(1 - 0.9**step)) / (np.sqrt(v / np.float32(1 - 0.999**step)) + np.float32(1e-8)))
    z, t = highest(net.logits(x), own, len(y))[held], y[held]
    net.scale = platt(z, t)
    z = net.scale[0] * z + net.scale[1]
    if t.any() and not t.all():
        # up to here the wanted recall holds; below it half-way down to the harmless ones, but for 1 in 200
        top, low = np.quantile(z[t == 1], 1 - recall), np.quantile(z[t == 0], 0.995)
        net.threshold = float(1 / (1 + np.exp(-min(top, (top + low) / 2))))
    return net


def platt(z: np.ndarray, t: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Scale and shift that make logits probabilities, by Newton steps on smoothed labels."""
    if not t.any() or t.all():
        return 1.0, 0.0
    pos, neg = t.sum(), len(t) - t.sum()
    want = np.where(t == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    m = np.stack([z, np.ones(len(z))], 1)
    w = np.array([1.0, 0.0])
    loss = lambda w: float(np.logaddexp(0, m @ w).sum() - want @ (m @ w))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(m @ w)))
        step = np.linalg.solve(m.T @ (m * (p * (1 - p))[:, None]) + 1e-9 * np.eye(2), m.T @ (p - want))
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def made_findings(n: int = 4_000, seed: int = 11, deep: int = 0) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): candidates of public token formats, and of harmless ones, in context."""
    r = random.Random(seed)
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    some = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    stems = ["an", "er", "the", "on", "re", "ti", "es", "or", "st", "ing", "ed", "ou", "ein", "sch", "lich", "keit", "que", "eau", "tion", "ment", "ado", "ción", "los", "ha", "wh", "ly", "ble", "de", "pf", "ux"]
    word = lambda: "".join(r.choice(stems) for _ in range(r.randint(1, 4)))
    secret = [
        lambda: base64.b64encode(r.randbytes(r.randint(16, 48))).decode(),
        lambda: some(alnum, 20, 48),
        lambda: r.choice(["ghp_", "gho_", "glpat-", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "AIza", "npm_", "SG."]) + some(alnum, 20, 40),
        lambda: "eyJ" + some(alnum, 12, 30) + ".eyJ" + some(alnum, 20, 40) + "." + some(alnum + "-_", 20, 43),
        lambda: some(hexa.upper(), 24, 48),
        lambda: some(alnum + "+/", 30, 44) + "=" * r.randint(0, 2),
        lambda: some(alnum, 10, 16),
        lambda: some(string.ascii_letters, 16, 40),
        lambda: some(string.ascii_uppercase + "234567", 16, 32),
        lambda: "-".join(some(alnum, 4, 6) for _ in range(r.randint(3, 5))),
        lambda: some(string.digits, 8, 10) + ":" + some(alnum + "-_", 30, 35),
    ]
    harmless = [
        lambda: "-".join(word() for _ in range(r.randint(3, 6))) + f"-{r.randint(1, 9)}",
        lambda: "/".join(word() for _ in range(r.randint(3, 6))) + f"/{r.randint(1, 999)}",
        lambda: f"{word()}.{word()}.example.com/{word()}/{r.randint(1, 9999)}",
        lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}",
        lambda: f"{word()}{word()}_{word()}_{r.randint(1, 99)}.{r.choice(['txt', 'html', 'csv', 'json', 'parquet'])}",
        lambda: f"{word()}.{word()}.{word()}.{r.randint(0, 99)}.{r.randint(0, 99)}",
        lambda: "=" * r.randint(8, 20) + f"{word()}{r.randint(1, 9)}" + "=" * r.randint(8, 20),
        lambda: f"{word()}{r.randint(0, 9)}" + "".join(word() for _ in range(r.randint(3, 6))),
        lambda: f"v{r.randint(0, 20)}.{r.randint(0, 30)}.{r.randint(0, 30)}-{word()}.{r.randint(1, 30)}+{word()}",
        lambda: f"{r.randint(0, 99)}.{word()}.{word() * 4}",
        lambda: some(string.digits, 8, 19),
        lambda: "-".join(some(string.digits, 3, 4) for _ in range(r.randint(2, 4))),
        lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        lambda: "".join(word() for _ in range(r.randint(4, 7))),
        lambda: "".join(word().capitalize() for _ in range(r.randint(2, 5))) + r.choice(["", "", str(r.randint(1, 99))]),
        lambda: word() + "".join(word().capitalize() for _ in range(r.randint(1, 4))) + r.choice(["", "Id", "2"]),
        lambda: "_".join(word() for _ in range(r.randint(2, 6))),
        lambda: "".join(word() for _ in range(r.randint(4, 6))).upper(),
        lambda: "-" * r.randint(8, 30),
        lambda: f"{word()}{r.choice('/+-_=.')}{word()}{r.choice('/+-_=.')}{word()}",
        lambda: f"{r.choice(['mail', 'host', 'www', 'cdn', 'ns'])}{r.randint(0, 99)}.{r.choice(['example', word()])}.{r.choice(['com', 'org', 'net'])}",
    ]
    lead_secret = ["key: ", "Authorization: Bearer ", "auth = ", "credential ", "private key ", "", "client ", "export KEY=", '"'] + [""] * 4
    lead_plain = ["see ", "file ", "at ", "version ", "", "href ", "path ", "id ", "the ", "of ", "@", "name@", "me.42@", "x_7@"]
    out = []
    for k in range(n):
        label = k % 2
        body = r.choice(secret if label else harmless)()
        before = " ".join(word() for _ in range(r.randint(0, 6))) + " " + r.choice(lead_secret if label else lead_plain)
        if r.random() < 0.1:
            before = before.upper()
        text = before + body + r.choice([" ", " ", " ", "", ". ", ", ", "!! ", "$$$ ", "%% ", '" ', ") "]) + word()
        start = len(before)
        out.append((text, start, start + len(body), label))
    heads, cores, ends = ["b", "bl", "c", "ch", "d", "f", "fl", "g", "h", "j", "k", "l", "m", "n", "p", "pr", "qu", "r", "s", "st", "t", "tr", "v", "w", "x", "y", "z", ""], ["a", "e", "i", "o", "u", "ee", "ou", "ai"], ["", "", "n", "r", "s", "l", "t", "m", "ck", "ng", "ld", "f", "p", "x"]
    spoken = lambda: "".join(r.choice(heads) + r.choice(cores) + r.choice(ends) for _ in range(r.randint(1, 3)))
    for k in range(deep):  # secrets at the end of long paths and names, and harmless ones as long; told by what follows
        label = k % 2
        parts = [r.choice([word(), spoken(), spoken(), spoken() + str(r.randint(0, 99)), spoken()[:1].upper() + "00000000"]) for _ in range(r.randint(5, 16))]
        body = r.choice(["//", "/", ""]) + r.choice("/./-").join(parts) + r.choice("/./=") + (r.choice([secret[1], secret[2], secret[5]])() if label else f"{r.choice([word, spoken])()}{r.randint(1, 999)}")
        before = " ".join(word() for _ in range(r.randint(0, 6))) + r.choice([" ", " see https:", " at ", ' "'])
        after = r.choice([" is the private key", " as credential", '" (api key)', ""] if label else [" is the page", " as file", '" (see there)', ""]) + " " + " ".join(word() for _ in range(r.randint(0, 6)))
        out.append((before + body + after, len(before), len(before) + len(body), label))
    return out


def fit(findings: list[tuple[str, int, int, int]] | None = None, recall: float = 0.95) -> Network:
    """Train on labelled findings (text, start, end, label); a bounded list, by default the made ones."""
    rows = findings or made_findings(deep=800)
    x, own = (np.concatenate(part) for part in zip(*blocks([(t, a, b) for t, a, b, _ in rows]), strict=True))
    return train(x, own, np.array([y for *_, y in rows], float), recall)


def find(texts: list[str], net: Network) -> list[list[tuple[int, int, int]]]:
    """All (start, kind, end) of each text, base and accepted."""
    found = [base_spans(t) for t in texts]
    new = [(k, a, b) for k, t in enumerate(texts) for a, b in candidates(t, found[k])]
    if new:
        p = np.full(len(new), -np.inf)
        for x, own in blocks([(texts[k], a, b) for k, a, b in new]):
            np.maximum.at(p, own, net.probabilities(x))
        for (k, a, b), x in zip(new, p, strict=True):
            if x >= net.threshold:
                found[k].append((a, 3, b))
    return [sorted(f) for f in found]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the base counts, base_sha256, spans and n_cnn of every whole text."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                all_ = find(texts_of(part), shared.value)
                counts = [pa.array([sum(x[1] == k for x in s) for s in all_], pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *counts[:3], pa.array([sha(joined([x for x in s if x[1] < 3])) for s in all_]), pa.array([joined(s) for s in all_], pa.string()), counts[3]],
                    names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_cnn"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_cnn bigint")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    return scan(table(spark, sf_dir, "documents"), fit())
