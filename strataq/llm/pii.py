"""Personal data: a character-level bidirectional LSTM with CRF transitions, in numpy, beside a plain pattern base.

The network reads characters (letters by themselves, so words around a number count; all digits alike) and is trained from
labelled spans: the base's own on a bounded sample, and spans of written-out variants that the base doesn't know, among
clutter of the same looks. Texts are cut into overlapping windows; a window's decoded tags count for its middle, where it saw
most on both sides, and the pieces are joined over the whole text before spans are checked, so no span is cut by a window's edge.

Only characters within NEAR of a trigger (a digit, an `@`, `[at]` or `(at)`) may be tagged: the decoder forbids all other tags
elsewhere. So the only path through a window without such a character is the empty one, and it needn't be computed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import scanned

KINDS = ("email", "ip", "card", "phone")
#: Bounds of the training sample: rows, pieces of a row, characters of a piece, and windows that are made of them.
SAMPLE_ROWS, PIECES, PIECE_CHARS, SAMPLE_WINDOWS = 600, 4, 400, 4000
WINDOW, STRIDE, NEAR, TRAINING = 96, 48, 32, 60
EMBED, HIDDEN, TAGS = 10, 16, 1 + 2 * len(KINDS)
EPOCHS, BATCH, RATE, SEED = 10, 48, 0.02, 11
#: Mean probability of its tags from which a decoded span is taken.
CONFIDENT = 0.5
ROWS = 2048

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can't begin inside a run of digits: a run's first digit is tried first, and matches end with their runs
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")
_TRIGGER = re.compile(r"[0-9@]|[\[(][aA][tT][\])]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _ip_holds(s: str) -> bool:
    return all(len(p := x.lstrip("0")) < 3 or len(p) == 3 and p <= "255" for x in s.split("."))


def _card_holds(s: str) -> bool:
    digits = _NOT_DIGIT.sub("", s) if len(s) <= 64 else s.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and luhn(digits)


def _phone_holds(s: str) -> bool:
    return 9 <= len(_NOT_DIGIT.sub("", s)) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, found from their `@`: linear in the text, whatever stands before it."""
    last = 0
    at = text.find("@")
    while at >= 0:
        reach = 64
        while True:
            begin = max(last, at - reach)
            run = text[begin:at]
            start = begin + len(run.rstrip(_LOCAL))
            if start > begin or begin == last:
                break
            reach *= 4
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            last = m.end()
        at = text.find("@", m.end() if m else at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base, by kind, then start; code points, end exclusive."""
    out = [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for kind, pattern, holds in ((1, _IP, _ip_holds), (2, _CARD, _card_holds), (3, _PHONE, _phone_holds)):
            out += [(kind, *m.span()) for m in pattern.finditer(text) if holds(m[0])]
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


OTHERS = 64
PAD = 128 + OTHERS
_CODE = np.arange(128, dtype=np.uint8)
_CODE[ord("A") : ord("Z") + 1] += 32
_CODE[ord("0") : ord("9") + 1] = ord("0")
_CODE[[9, 10, 11, 12, 13]] = ord(" ")


def codes(text: str) -> np.ndarray:
    """What the network reads, one for each code point: ASCII with letters lower-cased, digits alike and white space alike;
    others hashed to OTHERS codes."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    hashed = ((points * np.uint32(0x9E3779B1)) >> np.uint32(26)).astype(np.uint8) + np.uint8(128)
    return np.where(points < 128, _CODE[np.minimum(points, 127)], hashed)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def allowed() -> np.ndarray:
    """Which tag may follow which: the inside of a kind only its beginning or itself."""
    out = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = False
        out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return out


_FORBIDDEN = np.where(allowed(), 0, -1e4).astype(np.float32)
_FIRST = np.array([-1e4 if t and t % 2 == 0 else 0 for t in range(TAGS)], np.float32)


@dataclass
class Tagger:
    """Embedding, for each direction the gates' weights on (input, state) and bias, output weights, transitions."""

    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = SEED) -> Tagger:
        rng = np.random.default_rng(seed)
        p = {"e": rng.normal(0, 0.5, (PAD + 1, EMBED)), "o": rng.normal(0, 0.2, (2 * HIDDEN, TAGS)), "ob": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS))}
        for d in "fb":
            p["w" + d] = rng.normal(0, 0.25, (EMBED + HIDDEN, 4 * HIDDEN))
            p["c" + d] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])  # forget gates begin open
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def _direction(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """x: time, rows, EMBED. States of one direction, and what its gradient needs."""
        n, (w, bias) = x.shape[1], (self.p["w" + d], self.p["c" + d])
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, kept = np.empty((len(x), n, HIDDEN), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            inp = np.concatenate([x[t], h], axis=1)
            z = inp @ w + bias
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            f, i, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                kept.append((t, inp, f, i, o, g, before, tc))
        return out, kept

    def emissions(self, ids: np.ndarray, keep: bool = False):
        """ids: rows, time. Scores of the tags: time, rows, TAGS."""
        x = self.p["e"][ids.T]
        forward, kf = self._direction(x, "f", keep)
        backward, kb = self._direction(x, "b", keep)
        both = np.concatenate([forward, backward], axis=2)
        scores = both @ self.p["o"] + self.p["ob"]
        return (scores, both, kf, kb) if keep else scores

    def limited(self, ids: np.ndarray, may: np.ndarray) -> np.ndarray:
        """Scores with all tags but the empty one forbidden where `may` (rows, time) is false."""
        scores = self.emissions(ids)
        scores[:, :, 1:] += np.where(may.T, np.float32(0), np.float32(-1e4))[:, :, None]
        return scores

    def decode(self, ids: np.ndarray, may: np.ndarray) -> np.ndarray:
        """The best allowed tags of each row: rows, time."""
        scores = self.limited(ids, may)
        move = self.p["t"] + _FORBIDDEN
        best, back = scores[0] + _FIRST, np.empty(scores.shape, np.int8)
        for t in range(1, len(scores)):
            through = best[:, :, None] + move[None]
            back[t] = through.argmax(axis=1)
            best = through.max(axis=1) + scores[t]
        tags = np.empty(ids.shape, np.int8)
        tags[:, -1] = best.argmax(axis=1)
        rows = np.arange(len(ids))
        for t in range(len(scores) - 1, 0, -1):
            tags[:, t - 1] = back[t][rows, tags[:, t]]
        return tags

    def chain(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From scores (time, rows, TAGS): the log of each row's sum over all allowed paths, the probability of each tag in
        its place, and the expected number of each transition in all rows. Forward and backward sums are scaled to one a step."""
        top = scores.max(axis=2, keepdims=True)
        e, move = np.exp(scores - top), np.exp(self.p["t"]) * allowed()
        a, b, c = np.empty_like(e), np.ones_like(e), np.empty(e.shape[:2], e.dtype)
        x = e[0] * np.exp(_FIRST)
        for t in range(len(e)):
            if t:
                x = (a[t - 1] @ move) * e[t]
            c[t] = x.sum(axis=1)
            a[t] = x / c[t][:, None]
        through = np.empty_like(e)
        for t in range(len(e) - 1, -1, -1):
            through[t] = e[t] * b[t] / c[t][:, None]
            if t:
                b[t - 1] = through[t] @ move.T
        moves = (a[:-1].reshape(-1, TAGS).T @ through[1:].reshape(-1, TAGS)) * move
        return (np.log(c) + top[:, :, 0]).sum(axis=0), a * b, moves

    def marginals(self, ids: np.ndarray, may: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """The probability of each of the given tags in its place: rows, time."""
        chance = self.chain(self.limited(ids, may))[1]
        return np.take_along_axis(chance, tags.T[:, :, None].astype(np.int64), axis=2)[:, :, 0].T

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags, and its gradients."""
        scores, both, kf, kb = self.emissions(ids, keep=True)
        steps, n = scores.shape[:2]
        z, d, gt = self.chain(scores)
        d = d.copy()
        own = tags.T[:, :, None].astype(np.int64)
        pairs = np.bincount((tags[:, :-1].astype(np.int64) * TAGS + tags[:, 1:]).ravel(), minlength=TAGS * TAGS).reshape(TAGS, TAGS)
        gold = np.take_along_axis(scores, own, axis=2).sum(axis=(0, 2)) + (self.p["t"] + _FORBIDDEN)[tags[:, :-1], tags[:, 1:]].sum(axis=1) + _FIRST[tags[:, 0]]
        np.put_along_axis(d, own, np.take_along_axis(d, own, axis=2) - 1, axis=2)
        gt = gt - pairs
        g = {"t": gt / n}
        d = (d / n).astype(scores.dtype)
        g["o"] = np.einsum("tnh,tnk->hk", both, d)
        g["ob"] = d.sum(axis=(0, 1))
        dh_all = d @ self.p["o"].T
        dx = np.zeros((steps, n, EMBED), np.float32)
        for name, kept, part in (("f", kf, dh_all[:, :, :HIDDEN]), ("b", kb, dh_all[:, :, HIDDEN:])):
            w, gw, gc = self.p["w" + name], np.zeros_like(self.p["w" + name]), np.zeros_like(self.p["c" + name])
            dh_next, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for t, inp, f, i, o, gg, before, tc in reversed(kept):
                dh = part[t] + dh_next
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * before * f * (1 - f), dc * gg * i * (1 - i), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                gw += inp.T @ dz
                gc += dz.sum(axis=0)
                back = dz @ w.T
                dx[t] += back[:, :EMBED]
                dh_next, dc = back[:, EMBED:], dc * f
            g["w" + name], g["c" + name] = gw, gc
        g["e"] = np.zeros_like(self.p["e"])
        np.add.at(g["e"], ids.T, dx)
        return float((z - gold).mean()), g

    def train(self, ids: np.ndarray, tags: np.ndarray) -> Tagger:
        """Adam over shuffled batches."""
        rng, m, v, step = np.random.default_rng(SEED), {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(ids))
            for start in range(0, len(ids), BATCH):
                some = order[start : start + BATCH]
                _, g = self.gradients(ids[some], tags[some])
                step += 1
                scale = min(1.0, 5 / (sum(float((x**2).sum()) for x in g.values()) ** 0.5 + 1e-9))
                for k, x in g.items():
                    x = x * scale
                    m[k], v[k] = 0.9 * m[k] + 0.1 * x, 0.99 * v[k] + 0.01 * x * x
                    self.p[k] -= (RATE * 0.75**epoch * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self


#: Words before a bare number that say it is a phone's, and such as say it isn't.
CALLS = ("call", "tel", "phone", "mobile", "fax", "reach me at", "dial", "contact")
COUNTS = ("order", "item", "invoice", "page", "ticket", "serial", "lot", "part", "room", "case")


def variants(rng: np.random.Generator) -> tuple[int, str, str]:
    """A kind, what stands before the span, and a written-out form of it that the base may miss."""
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9)))
    pick = lambda *forms: str(rng.choice(forms))
    kind = int(rng.choice(4, p=(0.25, 0.15, 0.15, 0.45)))
    if kind == 0:
        name, host, end = pick(word(), f"{word()}.{word()}", f"{word()}{digits(2)}"), word(), pick("com", "org", "net", "de")
        return kind, "", pick(f"{name} @ {host} . {end}", f"{name} @ {host}.{end}", f"{name}@{host} . {end}", f"{name} [at] {host}.{end}", f"{name}(at){host}.{end}", f"{name} (at) {host} (dot) {end}", f"{name}[at]{host}[dot]{end}")
    if kind == 1:
        a = [str(x) for x in rng.integers(0, 256, 4)]
        return kind, "", pick(" . ".join(a), "[.]".join(a), "(.)".join(a))
    if kind == 2:
        body = "4" + digits(14)
        body += next(str(c) for c in range(10) if luhn(body + str(c)))
        return kind, "", pick(".", "_", "/", " - ").join(body[i : i + 4] for i in range(0, 16, 4))
    a, b, c = digits(3), digits(3), digits(4)
    if rng.random() < 0.5:
        return kind, pick(*CALLS) + pick(" ", ": ", " "), pick(a + b + c, f"{a} {b} {c}", f"{a}/{b}{c}")
    return kind, "", pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits(2)} {a} {b} {c}")


def clutter(rng: np.random.Generator) -> str:
    """Numbers and signs that are no personal data."""
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda *forms: str(rng.choice(forms))
    if rng.random() < 0.4:
        return pick(*COUNTS) + pick(" ", ": ", " ") + pick(n(10), f"{n(3)} {n(3)} {n(4)}", n(7), n(12), f"{n(3)}/{n(7)}")
    return pick(n(4), f"{n(1)}.{n(2)}", f"{n(2)},{n(3)}", f"20{n(2)}-0{n(1)}-1{n(1)}", f"{n(2)}%", f"#{n(3)}", f"v{n(1)}.{n(1)}.{n(1)}", f"@{n(2)}", f"{n(2)}:{n(2)}", n(6), f"id{n(5)}", "@", n(10), f"{n(3)} {n(3)} {n(4)}", f"| {n(3)} | {n(2)} | {n(4)}", f"{n(1)},{n(3)},{n(3)}", f"{n(8)}-{n(4)}", "(at)", "".join(rng.choice(list("0123456789abcdef"), 16)))


def _tags(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(n, np.int8)
    for k, a, b in spans:
        if not out[a:b].any():
            out[a:b], out[a] = 2 + 2 * k, 1 + 2 * k
    return out


def near_trigger(text: str) -> np.ndarray:
    """Whether each character may be tagged: it lies within NEAR of a trigger."""
    steps = np.zeros(len(text) + 1, np.int32)
    at = np.array([m.span() for m in _TRIGGER.finditer(text)], np.int64).reshape(-1, 2)
    np.add.at(steps, np.maximum(at[:, 0] - NEAR, 0), 1)
    np.add.at(steps, np.minimum(at[:, 1] + NEAR, len(text)), -1)
    return np.cumsum(steps[:-1]) > 0


def training_windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags: around the base's spans, around variants and clutter set into the texts, and plain ones."""
    rng, ids, tags = np.random.default_rng(SEED), [], []

    def add(text: str, spans: list, at: int) -> None:
        start = max(0, min(at - int(rng.integers(4, TRAINING - 26)), len(text) - TRAINING))
        row, own = np.full(TRAINING, PAD, np.uint8), np.zeros(TRAINING, np.int8)
        part = codes(text[start : start + TRAINING])
        row[: len(part)] = part
        own[: len(part)] = _tags(len(text), spans)[start : start + TRAINING]
        if own[0] and own[0] % 2 == 0:
            own[0] -= 1  # a span that began before the window
        ids.append(row), tags.append(own)

    texts = [t for t in texts if t] or ["the of and to in"]
    for t in texts:
        spans = base_spans(t)
        for _, a, _ in spans[:3]:
            if len(ids) < SAMPLE_WINDOWS // 4:
                add(t, spans, a)
        if (digit := _TRIGGER.search(t)) and len(ids) < SAMPLE_WINDOWS // 3:
            add(t, spans, digit.start())
    while len(ids) < SAMPLE_WINDOWS:
        t = texts[int(rng.integers(len(texts)))]
        cut = int(rng.integers(0, max(1, len(t))))
        cut = t.find(" ", cut) + 1 or cut
        around = t[max(0, cut - 150) : cut], t[cut : cut + 150]
        if rng.random() < 0.55:
            kind, before, form = variants(rng)
            extra = before + form + " "
            spans = [(kind, len(around[0]) + len(before), len(around[0]) + len(before) + len(form))]
        else:
            extra, spans = clutter(rng) + " ", []
        text = around[0] + extra + around[1]
        found = [s for s in base_spans(text) if not spans or s[2] <= spans[0][1] or s[1] >= spans[0][2]]
        add(text, spans + found, len(around[0]))
    return np.array(ids), np.array(tags)


def pieces_of(text: str, seed: int) -> list[str]:
    """Up to PIECES pieces of PIECE_CHARS characters, from anywhere in the text: half of them around triggers, if it has any."""
    rng, out = np.random.default_rng(seed & 2**63 - 1), []
    for i in range(PIECES):
        at = int(rng.integers(0, len(text)))
        if i % 2 and (m := _TRIGGER.search(text, at) or _TRIGGER.search(text)):
            at = m.start()
        start = max(0, min(at - PIECE_CHARS // 2, len(text) - PIECE_CHARS))
        start = 0 if start == 0 else text.find(" ", start, start + 40) + 1 or start
        piece = text[start : start + PIECE_CHARS]
        out.append(piece if start + PIECE_CHARS >= len(text) else piece[: piece.rfind(" ") + 1 or len(piece)])
    return out


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id") -> Tagger:
    """A tagger trained on a bounded sample: of the SAMPLE_ROWS distinct rows with the least hash of key and text, PIECES pieces
    of PIECE_CHARS characters each. Only pieces leave the executors, of some three times as many rows, chosen by a threshold of
    the hash. Null and empty texts don't enter it; without any text the tagger learns from variants and clutter alone."""
    n = docs.count()
    ceiling = int(-(2**63) + min(1.0, 3 * SAMPLE_ROWS / max(1, n)) * (2**64 - 1))
    rows = docs.select(F.xxhash64(F.col(key), F.col(text)).alias("h"), F.col(text).alias("t")).where((F.col("h") <= min(ceiling, 2**63 - 1)) & (F.col("t") != ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [pieces_of(t.as_py(), h) for h, t in zip(b.column("h").to_pylist(), b.column("t"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(cut, pa.list_(pa.string()))], ["h", "pieces"])

    got = rows.mapInArrow(run, "h long, pieces array<string>").dropDuplicates(["h"]).orderBy("h").limit(SAMPLE_ROWS).collect()
    return Tagger.fresh().train(*training_windows([p for r in sorted(got) for p in r["pieces"]]))


def _holds(kind: int, s: str) -> bool:
    """What the base asks of its own matches, of the digits alone: their number, the checksum of cards, the range of addresses."""
    if kind == 0:
        return any(map(str.isalpha, s))
    if kind == 1:
        return len(parts := re.findall("[0-9]+", s)) == 4 and _ip_holds(".".join(parts))
    digits = _NOT_DIGIT.sub("", s)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


def window_starts(may: np.ndarray) -> np.ndarray:
    """Starts of the windows on the grid that hold a character that may be tagged, over the whole text."""
    last = max(0, -(-(len(may) - WINDOW) // STRIDE))
    before = np.concatenate([[0], np.cumsum(may)])
    starts = np.arange(last + 1) * STRIDE
    return starts[before[np.minimum(starts + WINDOW, len(may))] > before[starts]] if len(may) else starts[:0]


def tag_texts(texts: list[str], tagger: Tagger, everywhere: bool = False) -> list[list[tuple[int, int, int]]]:
    """Spans of each whole text, base and added ones, by kind and start. Added spans overlap no other span. everywhere: also
    windows without a character that may be tagged are computed, with the same result."""
    may, places, edge = {}, [], (WINDOW - STRIDE) // 2
    for i, t in enumerate(texts):
        if everywhere or _TRIGGER.search(t):
            may[i] = near_trigger(t)
            places += [(i, int(s)) for s in (window_starts(np.ones(len(t), bool)) if everywhere else window_starts(may[i]))]
    coded = {i: codes(texts[i]) for i in may}
    tags = {i: np.zeros(len(c), np.int8) for i, c in coded.items()}
    sure: dict[int, np.ndarray] = {}
    for start in range(0, len(places), ROWS):
        some = places[start : start + ROWS]
        ids, open_ = np.full((len(some), WINDOW), PAD, np.uint8), np.zeros((len(some), WINDOW), bool)
        for r, (i, s) in enumerate(some):
            n = min(WINDOW, len(coded[i]) - s)
            ids[r, :n], open_[r, :n] = coded[i][s : s + n], may[i][s : s + n]
        found = tagger.decode(ids, open_)
        if not len(hit := np.flatnonzero(found.any(axis=1))):
            continue
        chance = tagger.marginals(ids[hit], open_[hit], found[hit])
        for r, p in zip(hit, chance, strict=True):
            i, s = some[r]
            n = len(coded[i])
            a, b = 0 if s == 0 else edge, WINDOW if s + WINDOW >= n else WINDOW - edge  # the middle, or up to the text's end
            b = min(b, n - s)
            tags[i][s + a : s + b] = found[r, a:b]
            sure.setdefault(i, np.zeros(n, np.float32))[s + a : s + b] = p[a:b]
    out = []
    for i, t in enumerate(texts):
        base = base_spans(t)
        added = []
        if i in sure and tags[i].any():
            kinds = (tags[i] + 1) // 2
            begins = np.flatnonzero((kinds > 0) & ((tags[i] % 2 == 1) | (np.concatenate([[0], kinds[:-1]]) != kinds)))
            taken = sorted((a, b) for _, a, b in base)
            for a in begins.tolist():
                k, b = int(kinds[a]), a + 1
                while b < len(t) and kinds[b] == k and tags[i][b] % 2 == 0:
                    b += 1
                if sure[i][a:b].mean() < CONFIDENT or not _TRIGGER.search(t, a, b):
                    continue
                while b > a and t[b - 1] in " .-(,;:":
                    b -= 1
                if _holds(k - 1, t[a:b]) and not any(x < b and a < y for x, y in taken):
                    added.append((k - 1, a, b))
                    taken.append((a, b))
        out.append(sorted(base + added))
    return out


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch that spans cover replaced by the first of their kinds in square brackets."""
    out, last = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{KINDS[k].upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def scan(docs: DataFrame, tagger: Tagger, keep: list[Column], text: str = "text") -> DataFrame:
    """`keep` columns and, for every row's whole text (null: empty): n_email, n_ip, n_card, n_phone and base (the base's spans
    alone), spans (base and added), each as `kind:start:end` by kind and start, comma-joined, and redacted (null for null).
    A kept column with one of these names is left out."""
    known = docs.sparkSession.sparkContext.broadcast(tagger)
    types = [pa.int64()] * len(KINDS) + [pa.string()] * 3

    def look(column: pa.Array) -> list:
        texts = column.to_pylist()
        out = []
        for t, spans in zip(texts, tag_texts([t or "" for t in texts], known.value), strict=True):
            base = base_spans(t or "")
            out.append((*(sum(s[0] == k for s in base) for k in range(len(KINDS))), written(base), written(spans), None if t is None else redacted(t, spans)))
        return [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]

    return scanned(docs, keep, text, "n_email long, n_ip long, n_card long, n_phone long, base string, spans string, redacted string", lambda: look, 4 << 20)
