"""Personal data: patterns with checks, and a character BiLSTM-CRF that adds spans.

The base finds e-mail addresses, IP addresses, card and phone numbers by pattern and
check, leftmost and without overlap per kind. The tagger is a bidirectional LSTM over
characters with CRF transitions over BIO tags, trained in numpy. Its labelled spans are the
base's own in a bounded sample and spans planted there, in the forms that people use and
patterns miss (spelled or spaced signs, missing plus signs, other separators, line
breaks), beside numbers and words that are no personal data.

The tagger reads every character of every text, in overlapping windows whose scores are
blended. Windows in which the best path with a span falls behind the one without hold none;
runs of the others are decoded whole, in pieces that see their neighbours' edges, so that no span is
cut by a window. A decoded span is added when its tags are likely enough, its plain form passes its kind's
check and it touches no base span.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blocklens.llm.common import pick

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)
#: Characters of a window and how far the next one begins; characters of a piece that is
#: decoded at once, and of the context that it has on either side.
WINDOW, STRIDE = 256, 224
PIECE, AROUND = 512, 64
CLASSES, HIDDEN = 128, 12
#: A window is decoded when its best path with a span comes this near to the one without.
NEAR_ENOUGH = 2.0
#: The least mean probability of an added span's tags.
CONFIDENT = 0.6
#: Bounds of what a fit reads and makes.
MAX_FIT_ROWS, MAX_FIT_CHARS, FIT_WINDOWS, FIT_WIDTH = 400, 20_000, 2400, 128

TRIGGER = re.compile(r"[0-9@]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9][0-9.]*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Grouped digits and signs that stand for an at sign.
LIKELY = re.compile(r"[+(]{0,2}[0-9][0-9\s()./_-]{7,}[0-9]|@|[(\[{]at[)\]}]")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def card_ok(text: str) -> bool:
    digits = digits_of(text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def phone_ok(text: str) -> bool:
    return 9 <= len(digits_of(text)) <= 15


def part_ok(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def emails(text: str) -> Iterator[Span]:
    """As the pattern finds them, each at sign once: a match starts where the run of
    local characters before it starts, or where the last match ended."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            yield "email", start, done
        at = text.find("@", max(done, at + 1))


def ips(text: str) -> Iterator[Span]:
    """Each four consecutive dotted numbers of a run, from the left."""
    for run in DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        held: list[tuple[int, int]] = []
        at = run.start()
        for part in run.group().split("."):
            held = [*held, (at, at + len(part))] if part else []
            at += len(part) + 1
            if len(held) == 4:
                if all(part_ok(text[a:b]) for a, b in held):
                    yield "ip", held[0][0], held[3][1]
                held = []


def base_spans(text: str) -> list[Span]:
    if not TRIGGER.search(text):
        return []
    cards = (("card", m.start(), m.end()) for m in CARD.finditer(text) if card_ok(m.group()))
    phones = (("phone", m.start(), m.end()) for m in PHONE.finditer(text) if phone_ok(m.group()))
    return [*emails(text), *ips(text), *cards, *phones]


def plain_form(kind: str, text: str) -> str:
    """A span without the ways around a pattern: spaced signs, brackets, spelled signs."""
    if kind in ("email", "ip"):
        text = re.sub(r"\s*[(\[{]?\b(?:dot|punkt|point|punto)\b[)\]}]?\s*|\s*[(\[{]\s*\.\s*[)\]}]\s*|\s+\.\s*|\s*\.\s+", ".", text)
    if kind == "email":
        text = re.sub(r"\s*[(\[{]?\b(?:at|arroba)\b[)\]}]?\s*|\s*[(\[{]\s*@\s*[)\]}]\s*|\s+@\s*|\s*@\s+", "@", text)
    return text


def passes(kind: str, text: str) -> bool:
    """The check that an added span has to pass: weaker in form than the base's, not in content.

    E-mail and ip: the plain form is one. Cards: 13 to 19 digits that pass Luhn, in groups
    parted by any signs. Phones: 9 to 15 digits in two groups at least.
    """
    plain = plain_form(kind, text)
    if kind == "email":
        return EMAIL.fullmatch(plain) is not None
    if kind == "ip":
        parts = plain.split(".")
        return len(parts) == 4 and all(p and p == digits_of(p) and part_ok(p) for p in parts)
    if kind == "card":
        return re.fullmatch(r"[0-9](?:[\s./_-]{0,3}[0-9])+", text) is not None and card_ok(text)
    return re.fullmatch(r"[+(]{0,2}[0-9][0-9\s()./-]*[0-9]", text) is not None and phone_ok(text) and len(re.findall(r"[0-9]+", text)) > 1 and not re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", text)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def classes_of(text: str) -> np.ndarray:
    """Character classes: 0 is kept for what lies outside the text; digits, small and capital
    letters and what lies beyond ASCII are one class each, and so is every other sign."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return class_table()[np.minimum(code, 128)]


@cache
def class_table() -> np.ndarray:
    table = np.arange(129, dtype=np.uint8)
    table[ord("0") : ord("9") + 1], table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1] = 1, 2, 3
    table[128], table[0] = 4, 5
    # Letters that spelled signs are made of keep classes of their own.
    for place, c in enumerate("adot"):
        table[ord(c)] = ord("a") + place
    return table


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """Parameters by name: each direction's input table and weights, output and transitions.

    Gates are input, forget, output and candidate, in this order. All arrays go by step first.
    """

    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 3) -> Tagger:
        rng = np.random.default_rng(seed)
        p = {"out": rng.normal(0, HIDDEN**-0.5, (2 * HIDDEN, TAGS)), "out_bias": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS))}
        for side in ("fore", "back"):
            table = rng.normal(0, 0.5, (CLASSES, 4 * HIDDEN))
            table[:, HIDDEN : 2 * HIDDEN] += 1
            p[side + "_in"], p[side] = table, rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def lstm(self, ids: np.ndarray, side: str, tape: list | None = None) -> np.ndarray:
        """Hidden states over ``ids[step, row]``, which run in the direction's own order."""
        steps, n = ids.shape
        # A sigmoid is half of one plus a tanh of half its argument, so one tanh serves all gates.
        half = np.repeat(np.array([0.5, 0.5, 0.5, 1], np.float32), HIDDEN)
        table, w = self.p[side + "_in"] * half, self.p[side] * half
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, z, own = np.empty((steps, n, HIDDEN), np.float32), np.empty((n, 4 * HIDDEN), np.float32), np.empty((n, 4 * HIDDEN), np.float32)
        i, f, o, g = (z[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        if tape is None:
            # In place, with the gates' halves and ones left to the sums they enter.
            part, squashed = np.empty_like(c), np.empty_like(c)
            for t in range(steps):
                np.matmul(h, w, out=z)
                np.take(table, ids[t], axis=0, out=own, mode="clip")
                z += own
                np.tanh(z, out=z)
                np.multiply(f, c, out=part)
                c += part
                np.multiply(i, g, out=part)
                c += part
                c += g
                c *= np.float32(0.5)
                np.tanh(c, out=squashed)
                h = out[t]
                np.multiply(o, squashed, out=h)
                h += squashed
                h *= np.float32(0.5)
            return out
        for t in range(steps):
            np.matmul(h, w, out=z)
            z += table[ids[t]]
            np.tanh(z, out=z)
            z[:, : 3 * HIDDEN] = (z[:, : 3 * HIDDEN] + 1) * np.float32(0.5)
            new = f * c + i * g
            squashed = np.tanh(new)
            tape.append((h, c, z.copy(), squashed))
            c, h = new, o * squashed
            out[t] = h
        return out

    def emissions(self, ids: np.ndarray, tapes: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fore = self.lstm(ids, "fore", tapes and tapes[0])
        back = self.lstm(ids[::-1], "back", None if tapes is None else tapes[1])[::-1]
        e = fore @ self.p["out"][:HIDDEN]
        e += back @ self.p["out"][HIDDEN:]
        e += self.p["out_bias"]
        return e, fore, back

    def lstm_back(self, tape: list, d_out: np.ndarray, ids: np.ndarray, side: str, grad: dict) -> None:
        w = self.p[side]
        dz = np.empty((*ids.shape, 4 * HIDDEN), np.float32)
        dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
        for t in range(len(ids) - 1, -1, -1):
            h, c, z, squashed = tape[t]
            i, f, o, g = (z[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
            dh = dh + d_out[t]
            dc = dc + dh * o * (1 - squashed**2)
            for k, d in enumerate((dc * g * i * (1 - i), dc * c * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2))):
                dz[t, :, k * HIDDEN : (k + 1) * HIDDEN] = d
            grad[side] += h.T @ dz[t]
            dh, dc = dz[t] @ w.T, dc * f
        flat = dz.reshape(-1, 4 * HIDDEN)
        one = np.zeros((len(flat), CLASSES), np.float32)
        one[np.arange(len(flat)), ids.ravel()] = 1
        grad[side + "_in"] += one.T @ flat

    def sums(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log sums over all paths up to, and from, each step and tag, and over whole paths."""
        move = self.p["move"]
        ahead, behind = np.zeros_like(e), np.zeros_like(e)
        ahead[0] = e[0]
        for t in range(1, len(e)):
            ahead[t] = log_sum(ahead[t - 1][:, :, None] + move, 1) + e[t]
        for t in range(len(e) - 2, -1, -1):
            behind[t] = log_sum(move + (e[t + 1] + behind[t + 1])[:, None, :], 2)
        return ahead, behind, log_sum(ahead[-1], 1)

    def crf_grad(self, e: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Gradients of the negative log-likelihood by emissions and transitions."""
        steps, n, _ = e.shape
        move = self.p["move"]
        ahead, behind, total = self.sums(e)
        d_e = np.exp(ahead + behind - total[:, None])
        d_move = np.zeros_like(move)
        rows = np.arange(n)
        gold = np.zeros(n)
        for t in range(steps):
            d_e[t, rows, tags[t]] -= 1
            gold += e[t, rows, tags[t]]
            if t:
                both = np.exp(ahead[t - 1][:, :, None] + move + (e[t] + behind[t])[:, None, :] - total[:, None, None])
                d_move += both.sum(axis=0)
                np.add.at(d_move, (tags[t - 1], tags[t]), -1)
                gold += move[tags[t - 1], tags[t]]
        return d_e / n, d_move / n, float((total - gold).mean())

    def step(self, ids: np.ndarray, tags: np.ndarray) -> tuple[dict, float]:
        tapes: tuple[list, list] = ([], [])
        e, fore, back = self.emissions(ids, tapes)
        h = np.concatenate((fore, back), axis=2)
        d_e, d_move, loss = self.crf_grad(e, tags)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["move"] = d_move
        grad["out"] = h.reshape(-1, 2 * HIDDEN).T @ d_e.reshape(-1, TAGS)
        grad["out_bias"] = d_e.sum(axis=(0, 1))
        d_h = d_e @ self.p["out"].T
        self.lstm_back(tapes[0], d_h[:, :, :HIDDEN], ids, "fore", grad)
        self.lstm_back(tapes[1], d_h[::-1, :, HIDDEN:], ids[::-1], "back", grad)
        return grad, loss

    def decode(self, e: np.ndarray) -> np.ndarray:
        """Best tags of ``e[step, row, tag]``."""
        steps, n, _ = e.shape
        move, best = self.p["move"], e[0]
        came = np.zeros((steps, n, TAGS), np.int8)
        for t in range(1, steps):
            options = best[:, :, None] + move
            came[t] = options.argmax(axis=1)
            best = options.max(axis=1) + e[t]
        out, tag, rows = np.zeros((steps, n), np.int64), best.argmax(axis=1), np.arange(n)
        for t in range(steps - 1, -1, -1):
            out[t] = tag
            tag = came[t, rows, tag]
        return out

    def best_span(self, e: np.ndarray) -> np.ndarray:
        """Per row of ``e[step, row, tag]``: what the best path with one span gains over the one without tags."""
        move, none = self.p["move"], e[:, :, :1] + self.p["move"][0, 0]
        first, inner = np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)
        begin, go_on = e[:, :, first] - none + move[0, first], e[:, :, inner] - none
        grow, stay = move[first, inner], move[inner, inner]
        out_first, out_inner = move[first, 0] - move[0, 0], move[inner, 0] - move[0, 0]
        opened, inside = begin[0], np.full_like(begin[0], -1e9)
        best = opened + out_first
        for t in range(1, len(e)):
            inside = go_on[t] + np.maximum(opened + grow, inside + stay)
            opened = begin[t]
            np.maximum(best, opened + out_first, out=best)
            np.maximum(best, inside + out_inner, out=best)
        # A span may run on beyond the window.
        return np.maximum(best, np.maximum(opened, inside)).max(axis=1)

    def near_windows(self, texts: list[str], at_once: int = 1024) -> Iterator[tuple[int, int, np.ndarray]]:
        """``(text, start, scores)`` of the windows that are worth decoding; all are read."""
        ids, places = np.zeros((at_once, WINDOW), np.uint8), []

        def read() -> Iterator[tuple[int, int, np.ndarray]]:
            e, _, _ = self.emissions(np.ascontiguousarray(ids[: len(places)].T))
            near = self.best_span(e) > -NEAR_ENOUGH
            for r in np.flatnonzero(near).tolist():
                yield places[r][0], places[r][1], e[: places[r][2], r].copy()

        for i, text in enumerate(texts):
            if not text:
                continue
            code = classes_of(text)
            for start in range(0, max(1, len(code) - (WINDOW - STRIDE)), STRIDE):
                own = code[start : start + WINDOW]
                ids[len(places), : len(own)], ids[len(places), len(own) :] = own, 0
                places.append((i, start, len(own)))
                if len(places) == at_once:
                    yield from read()
                    places = []
        if places:
            yield from read()

    def runs(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        """``(text, start, scores)`` of runs of such windows, blended where they overlap."""
        weight = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(np.float32)[:, None]
        held: list[tuple[int, int, np.ndarray]] = []

        def blend() -> tuple[int, int, np.ndarray]:
            a = held[0][1]
            scores = np.zeros((held[-1][1] + len(held[-1][2]) - a, TAGS), np.float32)
            mass = np.zeros((len(scores), 1), np.float32)
            for _, s, e in held:
                scores[s - a : s - a + len(e)] += e * weight[: len(e)]
                mass[s - a : s - a + len(e)] += weight[: len(e)]
            return held[0][0], a, scores / mass

        for i, start, e in self.near_windows(texts):
            if held and (held[-1][0] != i or held[-1][1] + STRIDE != start):
                yield blend()
                held = []
            held.append((i, start, e))
        if held:
            yield blend()

    def tag(self, texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
        """Decoded spans of every text, with the mean probability of their tags over all paths."""
        found: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
        pieces, owners = [], []

        def read() -> None:
            e = np.zeros((max(map(len, pieces)), len(pieces), TAGS), np.float32)
            e[:, :, 1:] = -50
            for r, own in enumerate(pieces):
                e[: len(own), r] = own
            tags = self.decode(e)
            ahead, behind, total = self.sums(e)
            sure = np.exp(np.take_along_axis(ahead + behind, tags[:, :, None], 2)[:, :, 0] - total)
            for r, (run, begin) in enumerate(owners):
                lo, hi = min(begin, AROUND), min(begin + PIECE, len(run[2]))
                run[2][begin:hi], run[3][begin:hi] = tags[lo : lo + hi - begin, r], sure[lo : lo + hi - begin, r]

        runs = []
        for i, a, e in self.runs(texts):
            run = (i, a, np.zeros(len(e), np.int64), np.zeros(len(e)))
            runs.append(run)
            for begin in range(0, len(e), PIECE):
                pieces.append(e[max(0, begin - AROUND) : begin + PIECE + AROUND])
                owners.append((run, begin))
                if len(pieces) == 256:
                    read()
                    pieces, owners = [], []
        if pieces:
            read()
        for i, a, tags, sure in runs:
            found[i] += [(kind, a + s, a + stop, float(sure[s:stop].mean())) for kind, s, stop in spans_of(tags)]
        return found


def spans_of(tags: np.ndarray) -> list[Span]:
    out: list[Span] = []
    begin, kind = -1, -1
    places = np.flatnonzero(tags)
    for t in np.unique(np.concatenate((places, places + 1))).tolist():
        tag = int(tags[t]) if t < len(tags) else 0
        inside = tag and tag % 2 == 0 and (tag - 1) // 2 == kind and begin >= 0
        if not inside and begin >= 0:
            out.append((KINDS[kind], begin, t))
            begin, kind = -1, -1
        if tag and not inside and tag % 2:
            begin, kind = t, (tag - 1) // 2
    return out


NAMES = "anna ben carla dmitri elena farid grace hugo ines jonas karin luis maria noah olga pablo rosa sven tara yusuf".split()
HOSTS = "mail post web office home net inbox corp school lab".split()
ENDS = "com org net de fr es example.com co.uk edu".split()


def luhn_number(rng: random.Random, n: int) -> str:
    body = "".join(rng.choices("0123456789", k=n - 1))
    return next(body + d for d in "0123456789" if luhn(body + d))


def made_span(rng: random.Random, kind: str) -> str:
    """A span of a kind, in one of the forms that people write; base patterns miss most of them."""
    pick_ = rng.choice
    if kind == "email":
        name = pick_(NAMES) + pick_(["", ".", "_", "-"]) + pick_([pick_(NAMES), str(rng.randrange(100))])
        host = pick_(HOSTS) + pick_(["", str(rng.randrange(10))])
        at = pick_([" at ", " (at) ", "(at)", " [at] ", "[at]", " @ ", "@ ", " @", " {at} ", "@"])
        dot = pick_([".", " dot ", " (dot) ", "[dot]", " [dot] ", " . ", "(dot)", "."])
        return name + at + host + dot.join(["", *pick_(ENDS).split(".")])
    if kind == "ip":
        dot = pick_(["[.]", "(.)", " . ", " dot ", "[dot]", " [dot] ", ".\n", " .", "."])
        return dot.join(str(rng.randrange(256)) for _ in range(4))
    if kind == "card":
        number, gap = luhn_number(rng, pick_([16, 16, 15, 13])), pick_([".", "/", "  ", " - ", "_", "\n", " ", ". "])
        cuts = [0, 4, 10, len(number)] if len(number) == 15 else [*range(0, len(number), 4), len(number)]
        return gap.join(number[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    digits = lambda n: str(rng.randrange(2, 10)) + "".join(rng.choices("0123456789", k=n - 1))
    forms = [
        lambda: f"({digits(3)}) {digits(3)}-{digits(4)}",
        lambda: f"{digits(3)}-{digits(3)}-{digits(4)}",
        lambda: f"{digits(3)}.{digits(3)}.{digits(4)}",
        lambda: f"{digits(3)} {digits(3)} {digits(4)}",
        lambda: f"1 ({digits(3)}) {digits(3)}-{digits(4)}",
        lambda: f"0{digits(3)} {digits(3)} {digits(4)}",
        lambda: f"0{digits(3)}/{digits(6)}",
        lambda: f"00{digits(2)} {digits(3)} {digits(3)} {digits(3)}",
        lambda: f"+{digits(2)} {digits(3)} {digits(3)} {digits(3)}",
        lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}",
    ]
    return pick_(forms)()


def made_other(rng: random.Random) -> str:
    """Numbers and words that look a little like personal data and are none."""
    n = rng.randrange
    return rng.choice([
        lambda: f"{n(1990, 2030)}-{n(1, 13):02d}-{n(1, 29):02d}",
        lambda: f"{n(1, 29)}.{n(1, 13)}.{n(1990, 2030)}",
        lambda: f"{n(24)}:{n(60):02d}:{n(60):02d}",
        lambda: f"{n(1, 999)},{n(1000):03d},{n(1000):03d}.{n(100):02d}",
        lambda: f"{n(10)}.{n(20)}.{n(30)}",
        lambda: str(n(10**15, 10**16)),
        lambda: str(n(10**8, 10**9)),
        lambda: f"{n(1, 20)} @ {n(1, 99)}.{n(100):02d}",
        lambda: f"at {rng.choice(HOSTS)} dot and {rng.choice(NAMES)}",
        lambda: "".join(rng.choices("0123456789abcdef", k=40)),
        lambda: f"{n(1000)} {n(1000)} {n(100)}",
        lambda: f"{n(1800, 2030)}-{n(1800, 2030)}",
        lambda: f"p. {n(500)}-{n(500)}",
        lambda: f"{n(10000)} {n(10000)} {n(10000)} {n(10000)}",
        lambda: f"{n(1000)}.{n(1000)}.{n(1000)}",
    ])()


def planted(text: str, rng: random.Random, spans: list[Span], width: int, kinds: tuple[str, ...]) -> tuple[str, np.ndarray]:
    """A cut of ``text`` of ``width`` characters with its base spans' tags and new spans of ``kinds``."""
    tags = np.zeros(len(text), np.int64)
    for kind, a, b in sorted(spans, key=lambda s: -KINDS.index(s[0])):
        tags[a:b], tags[a] = 2 + 2 * KINDS.index(kind), 1 + 2 * KINDS.index(kind)
    for kind in kinds:
        new = made_span(rng, kind) if kind else made_other(rng)
        # White space follows in the text.
        lead, trail = rng.choice([" ", " ", " ", "\n", ": ", " (", " \"", ", "]), rng.choice(["", "", "", ",", ".", ")", ";", "\""])
        own = np.zeros(len(lead) + len(new) + len(trail), np.int64)
        if kind:
            own[len(lead) : len(lead) + len(new)], own[len(lead)] = 2 + 2 * KINDS.index(kind), 1 + 2 * KINDS.index(kind)
        free = np.flatnonzero((tags == 0) & np.array([c.isspace() for c in text], bool)) if text else np.zeros(0, np.int64)
        at = int(free[rng.randrange(len(free))]) if len(free) else len(text)
        text, tags = text[:at] + lead + new + trail + text[at:], np.concatenate((tags[:at], own, tags[at:]))
    return text[:width], tags[:width]


def doubtful(text: str, spans: list[Span]) -> bool:
    """Whether a text holds what may be personal data that its base spans miss: no example of none."""
    for m in LIKELY.finditer(text):
        if not any(a < m.end() and m.start() < b for _, a, b in spans) and ("@" in m.group() or m.group()[-1] in ")]}" or passes("phone", m.group()) or passes("card", m.group())):
            return True
    return False


def examples(texts: list[str], most: int, seed: int = 3, width: int = FIT_WIDTH) -> list[tuple[str, np.ndarray]]:
    """Cuts of the texts with tags: around base spans, and anywhere with spans planted."""
    rng, out = random.Random(seed), []
    texts = [t for t in texts if t]
    marked = [(t, base_spans(t)) for t in texts]
    natural = [(t, spans, s) for t, spans in marked for s in spans]
    for _ in range(most if texts else 0):
        kind = rng.random()
        if natural and kind < 0.25:
            text, spans, (_, a, b) = rng.choice(natural)
            lo = max(0, rng.randint(b - width, a)) if b - a < width else a
            extra = ()
        else:
            text, spans = rng.choice(marked)
            lo = rng.randrange(max(1, len(text) - width // 2))
            extra = tuple(rng.choice(KINDS) for _ in range(rng.randint(1, 2))) if kind < 0.75 else (("",) * rng.randint(1, 3) if kind < 0.93 else ())
        cut = text[lo : lo + width]
        own = [(k, max(0, a - lo), min(len(cut), b - lo)) for k, a, b in spans if a < lo + len(cut) and b > lo and a >= lo]
        room = width if not extra else width - 48 * len([x for x in extra if x])
        cut = cut[: max(24, room)]
        if doubtful(cut, own):
            continue
        out.append(planted(cut, rng, [(k, a, b) for k, a, b in own if b <= len(cut)], width, extra))
    return out


def fit(texts: list[str], *, epochs: int = 10, batch: int = 32, rate: float = 0.02, most: int = FIT_WINDOWS, seed: int = 9) -> Tagger | None:
    """A tagger from ``texts``; none without any text."""
    rows = examples(texts, most)
    if not rows:
        return None
    net, rng = Tagger.fresh(), np.random.default_rng(seed)
    ids, tags = np.zeros((FIT_WIDTH, len(rows)), np.uint8), np.zeros((FIT_WIDTH, len(rows)), np.int64)
    for r, (text, own) in enumerate(rows):
        ids[: len(text), r], tags[: len(text), r] = classes_of(text), own
    m, v, t = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0
    steps = epochs * -(-len(rows) // batch)
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(len(rows)), -(-len(rows) // batch)):
            grad, _ = net.step(ids[:, some], tags[:, some])
            norm = sum(float((g**2).sum()) for g in grad.values()) ** 0.5
            t += 1
            pace = rate * min(1.0, t / 20) * (1 - t / (steps + 1)) ** 0.5
            for k, g in grad.items():
                g = g / max(1.0, norm / 5)
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                net.p[k] -= (pace * m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def settled(kind: str, text: str, a: int, b: int) -> tuple[int, int] | None:
    """The span on the borders of its words, if it passes; a tag may be off by a few characters."""
    whole = (lambda c: c.isalnum()) if kind != "email" else (lambda c: c in LOCAL)
    while a < b and not (text[a].isalnum() or text[a] in "+("):
        a += 1
    while a < b and not text[b - 1].isalnum():
        b -= 1
    if a == b:
        return None
    while a > 0 and whole(text[a - 1]):
        a -= 1
    while b < len(text) and text[b].isalnum():
        b += 1
    if kind == "phone" and a > 0 and text[a - 1] in "+(":
        a -= 1
    return (a, b) if passes(kind, text[a:b]) else None


def all_spans(text: str, base: list[Span], tagged: list[tuple[str, int, int, float]], confident: float = CONFIDENT) -> list[Span]:
    """The base's spans and the tagged ones that are likely, pass and touch none of them."""
    out = list(base)
    for kind, a, b, sure in tagged:
        place = settled(kind, text, a, b) if sure >= confident else None
        if place and all(place[1] <= x or y <= place[0] for _, x, y in out):
            out.append((kind, *place))
    return out


def fit_sample(rows: DataFrame, most: int) -> list[str]:
    """At most ``most`` texts with a digit or an at sign, of at most ``MAX_FIT_CHARS``.

    First only hashes reach the driver, then the texts of the least of them.
    """
    usable = rows.filter(F.col("text").rlike("[0-9@]") & (F.length("text") <= MAX_FIT_CHARS)).select(F.xxhash64(F.lit("fit"), "id", "text").alias("k"), "text")
    keys = [r[0] for r in usable.select("k").distinct().orderBy("k").limit(most).collect()]
    if not keys:
        return []
    found = usable.filter(F.col("k") <= max(keys)).dropDuplicates(["k"]).orderBy("k")
    return [r[0] for r in found.select("text").collect()]


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = MAX_FIT_ROWS, fit_windows: int = FIT_WINDOWS) -> DataFrame:
    """Per row of ``docs``: ``id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_added``.

    Spans are ``kind:start:end`` in code points, end exclusive, ordered by kind and
    start. The fit reads at most ``fit_rows`` rows of at most 20,000 code points that hold a
    digit or an at sign, in the order of a hash of the row, and makes ``fit_windows`` cuts of
    them; whole texts of all rows are searched in one narrow pass. Null and empty texts
    have none; repeated rows and null ids are answered row by row; an empty table gives an
    empty result; where the fit finds no text the base's spans are all; other columns are
    ignored.
    """
    rows = pick(docs, id=id_col, text=text_col)
    net = docs.sparkSession.sparkContext.broadcast(fit(fit_sample(rows, fit_rows), most=fit_windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = net.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            tagged = tagger.tag(texts) if tagger else [[] for _ in texts]
            every = [all_spans(*x) for x in zip(texts, base, tagged, strict=True)]
            counts = [pa.array([sum(s[0] == kind for s in spans) for spans in base], pa.int64()) for kind in KINDS]
            digest = pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in base], pa.string())
            total = [pa.array([len(e) for e in every], pa.int64()), pa.array([len(e) - len(b) for e, b in zip(every, base, strict=True)], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *counts, digest, pa.array([joined(s) for s in every], pa.string()), *total], ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans", "n_added"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_spans long, n_added long")


def masked(text: str, spans: str) -> str:
    """The text with each span replaced by its kind in angle brackets."""
    cuts = sorted(((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)), reverse=True)
    last = len(text) + 1
    for a, b, kind in cuts:
        text = text[:a] + f"<{kind}>" + text[min(b, last) :]
        last = a
    return text
