"""Personal data: exact patterns, and a linear-chain conditional random field that adds what they miss.

The field is trained on a small labelled table of word sequences (labelled() is the one shipped; a table of your own may be
given) by gradient ascent on the conditional likelihood, forward-backward in numpy. A word is seen through its shape (runs
of digits, letters and signs), and so are its two neighbours on either side. Only words with a digit or an @ can be labelled;
such words with two neighbours on either side make sequences, which Viterbi decodes in padded numpy batches. Beside the
patterns' kinds the field knows secrets (keys and passwords that stand behind their names). What it labels is added as it is,
without the signs around it, but for spans that overlap one of a pattern.

Null or empty text: no spans. Null id, repeated rows: each row comes out. Ties between paths: the label that is listed first.
Very long texts: words are sought span by span, sequences decoded some thousand at a time. Empty table: empty result. Other
columns are not looked at. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import lean, spans, text_bytes, word_bounds

KINDS = ("email", "ip", "card", "phone")
#: The field's kinds: those of the patterns, and what it alone finds.
ALL = (*KINDS, "secret")
LABELS = ("O", *(f"{p}-{k}" for k in ALL for p in "BI"))
#: Places of the words whose shapes a word is seen through, from its own.
PLACES = (0, 1, -1, 2, -2)
#: Words that a field remembers between calls, and words decoded in one call.
REMEMBERED, AT_ONCE = 200_000, 100_000
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = np.zeros(256, bool)
_MARK[[*range(48, 58), 64]] = True
_SIGNS = ".,;:!?\"'#$%&*|"
_NEAR = 2


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ so that long runs of letters cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the exact patterns, by kind as listed, then start."""
    out = [(0, s, e) for s, e in _emails(text)]
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 40 and 13 <= len(digits := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def shape(word: str) -> tuple[str, ...]:
    """Features of a word: its shape with run lengths, its shape without, its number of digits, its signs, whether letters and digits
    are mixed in it and how many, and itself in lower case if it is letters."""
    bare = word.strip(_SIGNS)[:64] or word[:1]
    kinds = "".join("d" if "0" <= c <= "9" else "x" if c.isalpha() else c for c in bare)
    full = re.sub(r"(.)\1*", lambda m: m[1] + str(min(len(m[0]), 6)) if m[1] == "d" else m[1], kinds)
    digits = kinds.count("d")
    out = [f"full={full}" if len(full) <= 24 else "full=long", f"short={re.sub(r'(.)(?=.*?)\1+', r'\1', kinds)[:16]}", f"digits={min(digits, 20)}"]
    out.append(f"signs={re.sub('[dx]+', '', kinds)[:8]}")
    letters = kinds.count("x")
    if digits and letters and digits + letters == len(kinds):
        out.append(f"mixed={min(len(kinds) // 8, 4)}")
    if not digits and "@" not in bare:
        out.append(f"word={bare.lower()}")
    if 13 <= digits <= 19 and digits == sum(c != "-" for c in kinds):
        out.append(f"luhn={luhn(re.sub('[^0-9]', '', bare)) if bare.isascii() else False}")
    return tuple(out)


def labelled(n: int = 600, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """The shipped labelled table: sequences made by rule of plain words, cue words, personal data in many spellings, and numbers that are none."""
    rng = np.random.default_rng(seed)

    def d(k: int) -> str:
        return "".join(map(str, rng.integers(0, 10, k)))

    def letters(k: int) -> str:
        return "".join(chr(97 + c) for c in rng.integers(0, 26, k))

    def word() -> str:
        return letters(rng.integers(2, 10)).capitalize() if rng.random() < 0.1 else letters(rng.integers(2, 10)) + ("," if rng.random() < 0.1 else "")

    def octet() -> str:
        return str(rng.integers(0, 256))

    def card(*groups: int, split: str = "") -> str:
        while not luhn(x := d(sum(groups))):
            pass
        return split.join(x[sum(groups[:i]) : sum(groups[: i + 1])] for i in range(len(groups)))

    def no_card() -> str:
        while luhn(x := d(16)):
            pass
        return x

    phones = [lambda: f"+{d(2)} {d(3)} {d(3)} {d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"00{d(2)} {d(3)} {d(6)}", lambda: f"+{d(11)}", lambda: f"1-{d(3)}-{d(3)}-{d(4)}", lambda: f"+{d(1)}-{d(3)}-{d(3)}-{d(4)}"]
    cards = [lambda: card(16), lambda: card(4, 4, 4, 4, split=" "), lambda: card(4, 4, 4, 4, split="-"), lambda: card(4, 6, 5, split=" "), lambda: card(15)]
    emails = [lambda: f"{letters(5)}.{letters(6)}@{letters(6)}.com", lambda: f"{letters(4)}{d(2)}@{letters(5)}.org", lambda: f"<{letters(4)}@{letters(5)}.net>", lambda: f"{letters(3)}.{d(2)}@{letters(4)}{d(1)}.{letters(6)}.com", lambda: f"{letters(6)}@localhost"]
    ips = [lambda: ".".join(octet() for _ in range(4)), lambda: f"{octet()}.{octet()}.{octet()}.{octet()}:{d(4)}", lambda: f"{octet()}.{octet()}.{octet()}.{octet()}/{rng.integers(8, 33)}"]
    plain = [no_card, no_card, lambda: str(rng.integers(1900, 2030)), lambda: d(1), lambda: d(2), lambda: d(3), lambda: f"{d(1)}.{d(1)}", lambda: f"{d(2)}.{d(2)}.{rng.integers(1900, 2030)}", lambda: f"{rng.integers(1900, 2030)}-{d(2)}-{d(2)}", lambda: f"${d(2)}.{d(2)}", lambda: f"{d(2)}%", lambda: f"v{d(1)}.{d(1)}.{d(1)}", lambda: letters(3) + d(3), lambda: mixed(lower, 40), lambda: mixed(lower, 64), lambda: f"{d(1)},{d(3)}", lambda: d(5), lambda: d(8), lambda: f"{d(2)}:{d(2)}", lambda: f"@{letters(6)}", lambda: f"({d(2)})", lambda: f"#{d(3)}", lambda: d(20), lambda: f"{d(3)}-{d(2)}", lambda: d(10), lambda: f"{d(1)}.{d(1)}.{d(1)}.{d(1)}.{d(1)}.{d(1)}"]
    def mixed(letters: str, n: int) -> str:
        return "".join(letters[c] for c in rng.integers(0, len(letters), n - 2)) + d(1) + letters[10]

    lower, both = "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    secrets = [lambda: mixed(lower, 40), lambda: mixed(lower, 32), lambda: mixed(lower, 64), lambda: mixed(both, int(rng.integers(16, 48))), lambda: mixed(lower.upper(), 40)]
    names = ("token", "key", "secret", "password", "api_key", "apikey", "passwd", "TOKEN", "auth")
    cues = {"phone": ("phone", "call", "tel"), "card": ("card", "visa", "paid"), "email": ("email", "mail", "write"), "ip": ("ip", "host", "from")}
    pools = dict(zip(ALL, (emails, ips, cards, phones, secrets), strict=True))
    signs = (".", ",", ";", "!!", "***", "###", "%%%", "$$$", "&&&")
    rows = []
    for _ in range(n):
        words, labels = [], []
        for _ in range(int(rng.integers(1, 4))):
            for _ in range(int(rng.integers(1, 4))):
                words.append(word())
                labels.append("O")
            if rng.random() < 0.55:
                kind = ALL[int(rng.integers(0, len(ALL)))]
                if kind == "secret":
                    mark, quote = str(rng.choice(names)), str(rng.choice(['"', "'", ""]))
                    text = quote + secrets[int(rng.integers(0, len(secrets)))]() + quote
                    words += [mark, str(rng.choice(["=", ":"])), text] if rng.random() < 0.7 else [mark + ":", text]
                    labels += ["O"] * (2 if words[-2] in "=:" else 1) + ["B-secret"]
                    if rng.random() < 0.2:
                        words[-1] += str(rng.choice(signs))
                    continue
                if rng.random() < 0.3:
                    words.append(str(rng.choice(cues[kind])))
                    labels.append("O")
                parts = pools[kind][int(rng.integers(0, len(pools[kind])))]().split(" ")
                words += parts
                labels += [f"{'B' if i == 0 else 'I'}-{kind}" for i in range(len(parts))]
            else:
                words.append(plain[int(rng.integers(0, len(plain)))]())
                labels.append("O")
            if rng.random() < 0.2:
                words[-1] += str(rng.choice(signs))
        words.append(word())
        labels.append("O")
        rows.append((words, labels))
    return rows


class Field:
    """Weights of a trained field. Words are numbered as they come; each has a row of scores for itself and as a neighbour."""

    def __init__(self, names: dict[str, int], unary: np.ndarray, step: np.ndarray, first: np.ndarray):
        self.names, self.unary, self.step, self.first = names, unary, step, first
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.rows = np.zeros((256, len(PLACES), len(LABELS)))
        self.free = np.zeros(256, bool)

    def __getstate__(self) -> tuple:
        return self.names, self.unary, self.step, self.first

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def number(self, word: str) -> int:
        if (k := self.words.get(word)) is None:
            k = self.words[word] = len(self.words)
            if k >= len(self.rows):
                self.rows, self.free = np.concatenate([self.rows, np.zeros_like(self.rows)]), np.concatenate([self.free, np.zeros_like(self.free)])
            at = [self.names[f] for f in shape(word) if f in self.names]
            self.rows[k] = self.unary[:, at].sum(1)
            self.free[k] = any("0" <= c <= "9" or c == "@" for c in word)
        return k

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Of each word and label, without transitions."""
        out = self.rows[ids, 0].copy()
        for k, by in enumerate(PLACES):
            if 0 < by < len(ids):
                out[by:] += self.rows[ids[:-by], k]
            elif -len(ids) < by < 0:
                out[:by] += self.rows[ids[-by:], k]
        out[~self.free[ids], 1:] = -1e9
        return out

    def decode(self, sequences: list[list[str]]) -> list[np.ndarray]:
        """The best labels of each sequence; padded batches of like length. Words keep their numbers for the whole call."""
        coded = [np.fromiter(map(self.number, s), np.int64, len(s)) for s in sequences]
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(coded)
        order = sorted((i for i in range(len(coded)) if len(coded[i])), key=lambda i: len(coded[i]))
        while order:
            most = len(coded[order[0]]) * 2 + 8
            batch = [i for i in order if len(coded[i]) <= most][: max(1, 200_000 // most)]
            order = order[len(batch) :]
            lengths = np.array([len(coded[i]) for i in batch])
            score = np.zeros((len(batch), lengths.max(), len(LABELS)))
            for r, i in enumerate(batch):
                score[r, : lengths[r]] = self.scores(coded[i])
            back = np.zeros(score.shape, np.int8)
            best = score[:, 0] + self.first
            for t in range(1, score.shape[1]):
                ways = best[:, :, None] + self.step
                back[:, t] = ways.argmax(1)
                best = np.where((lengths > t)[:, None], ways.max(1) + score[:, t], best)
            path = np.zeros(score.shape[:2], np.int64)
            label = best.argmax(1)
            for t in range(score.shape[1] - 1, -1, -1):
                path[:, t] = label
                if t:
                    label = np.where(t < lengths, back[np.arange(len(batch)), t, label], label)
            for r, i in enumerate(batch):
                out[i] = path[r, : lengths[r]]
        if len(self.words) > REMEMBERED:
            self.forget()
        return out


def train(rows: list[tuple[list[str], list[str]]] | None = None, steps: int = 80, rate: float = 0.2, keep: float = 1e-3) -> Field:
    """Fits a field to (words, labels) rows: Adam on the mean conditional log-likelihood with a quadratic penalty."""
    rows = labelled() if rows is None else rows
    seen: dict[str, int] = {}
    for words, _ in rows:
        for w in words:
            for f in shape(w):
                seen[f] = seen.get(f, 0) + 1
    names = {f: i for i, f in enumerate(f for f, c in sorted(seen.items()) if c >= 2)}
    n, length, k, width = len(rows), max(len(w) for w, _ in rows), len(LABELS), len(names)
    gold, alive = np.zeros((n, length), np.int64), np.zeros((n, length), bool)
    which: list[tuple[int, int, int, int]] = []  # part, row, place, feature
    for r, (words, labels) in enumerate(rows):
        gold[r, : len(words)], alive[r, : len(words)] = [LABELS.index(x) for x in labels], True
        for t, w in enumerate(words):
            for f in shape(w):
                if f in names:
                    which += [(p, r, t + by, names[f]) for p, by in enumerate(PLACES) if 0 <= t + by < len(words)]
    part, row, place, feature = np.array(which).T
    cell, column = row * length + place, part * width + feature
    unary, step, first = np.zeros((len(PLACES) * width, k)), np.zeros((k, k)), np.zeros(k)
    values, moment, second = [unary, step, first], [np.zeros_like(x) for x in (unary, step, first)], [np.zeros_like(x) for x in (unary, step, first)]
    starts = np.zeros(k)
    np.add.at(starts, gold[:, 0], 1)
    pairs = np.zeros((k, k))
    both = alive[:, 1:]
    np.add.at(pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    hot = np.zeros((n * length, k))
    hot[np.arange(n * length), gold.ravel()] = alive.ravel()

    def total(x: np.ndarray, axis: int) -> np.ndarray:
        m = x.max(axis, keepdims=True)
        return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)

    order = np.argsort(cell, kind="stable")
    cell, column = cell[order], column[order]
    for i in range(steps):
        score = np.zeros((n * length, k))
        np.add.at(score, cell, unary[column])
        score = score.reshape(n, length, k)
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0] + first
        for t in range(1, length):
            new = total(forward[:, t - 1, :, None] + step, 1) + score[:, t]
            forward[:, t] = np.where(alive[:, t, None], new, forward[:, t - 1])
        for t in range(length - 2, -1, -1):
            new = total(step[None] + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(alive[:, t + 1, None], new, 0)
        whole = total(forward[:, -1], 1)
        marginal = np.exp(forward + backward - whole[:, None, None]) * alive[:, :, None]
        edge = np.exp(forward[:, :-1, :, None] + step + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - whole[:, None, None, None]) * both[:, :, None, None]
        off = hot - marginal.reshape(-1, k)
        grads = [np.zeros_like(unary), (pairs - edge.sum((0, 1))) / n, (starts - marginal[:, 0].sum(0)) / n]
        np.add.at(grads[0], column, off[cell] / n)
        for j, (v, g) in enumerate(zip(values, grads, strict=True)):
            g -= keep * v / 10
            moment[j] = 0.9 * moment[j] + 0.1 * g
            second[j] = 0.99 * second[j] + 0.01 * g * g
            v += rate * (moment[j] / (1 - 0.9 ** (i + 1))) / (np.sqrt(second[j] / (1 - 0.99 ** (i + 1))) + 1e-8)
    return Field(names, unary.reshape(len(PLACES), width, k), step, first)


def _sequences(data: np.ndarray) -> list[list[tuple[int, int]]]:
    """Of one text the bounds in code points of words with a digit or an @ and their neighbours, in runs."""
    places, begins, ends, marked, words, points = [], [], [], [], 0, 0
    for _, _, a, b in spans(data, np.array([0, len(data)])):
        part = data[a:b]
        starts, stops, _ = word_bounds(part, np.array([0, len(part)]))
        rank = np.concatenate([[0], np.cumsum(_MARK[part], dtype=np.int64)])
        mine = rank[stops] > rank[starts]
        near = np.zeros(len(starts) + 2 * _NEAR, bool)
        for k in range(2 * _NEAR + 1):
            near[k : k + len(starts)] |= mine
        near = near[_NEAR : _NEAR + len(starts)]
        near[:_NEAR] = near[len(near) - min(_NEAR, len(near)) :] = True  # may be neighbours of the next span's
        letter = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80, dtype=np.int64)])
        keep = np.flatnonzero(near)
        places.append(keep + words)
        begins.append(letter[starts[keep]] + points)
        ends.append(letter[stops[keep]] + points)
        marked.append(mine[keep])
        words, points = words + len(starts), points + int(letter[-1])
    place, begin, end, mine = (np.concatenate(x) for x in (places, begins, ends, marked))
    centres = place[mine]
    at = np.searchsorted(centres, place - _NEAR)
    keep = np.append(centres, words + 2 * _NEAR)[at] <= place + _NEAR
    place, begin, end = place[keep], begin[keep], end[keep]
    cuts = np.flatnonzero(np.diff(place) > 1) + 1
    return [list(zip(x.tolist(), y.tolist(), strict=True)) for x, y in zip(np.split(begin, cuts), np.split(end, cuts), strict=True) if len(x)]


def _trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    while s < e and text[s] in f"{_SIGNS}<>[]{{}}":
        s += 1
    while e > s and text[e - 1] in f"{_SIGNS}<>[]{{}}":
        e -= 1
    return s, e


def _runs(seq: list[tuple[int, int]], labels: list[int]) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of what a sequence's labels mark."""
    now: list[int] | None = None
    for (s, e), label in zip(seq, labels, strict=True):
        kind, inside = (label - 1) // 2, label > 0 and label % 2 == 0
        if inside and now and now[0] == kind:
            now[2] = e
            continue
        if now:
            yield tuple(now)
        now = [kind, s, e] if label else None
    if now:
        yield tuple(now)


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): for each row its spans (kind, start, end, base), by kind as listed, then start; base: found by a pattern."""
    told = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = told.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            found: list[list[tuple[int, int, int, bool]]] = [[] for _ in range(len(offsets) - 1)]
            texts: dict[int, str] = {}
            waiting: list[tuple[int, list[tuple[int, int]], list[str]]] = []

            def decode() -> None:
                for (i, seq, _), labels in zip(waiting, crf.decode([w for _, _, w in waiting]), strict=True):
                    for kind, s, e in _runs(seq, labels.tolist()):
                        s, e = _trimmed(texts[i], s, e)
                        if s < e and not any(b and s < y and x < e for _, x, y, b in found[i]):
                            found[i].append((kind, s, e, False))
                waiting.clear()

            for i in range(len(offsets) - 1):
                own = data[offsets[i] : offsets[i + 1]]
                if not any(_MARK[own[a : a + (1 << 20)]].any() for a in range(0, len(own), 1 << 20)):
                    continue
                text = texts[i] = own.tobytes().decode()
                found[i] = [(*x, True) for x in patterns(text)]
                for seq in _sequences(own):
                    waiting.append((i, seq, [text[s:e] for s, e in seq]))
                    if len(waiting) >= AT_ONCE // 8:
                        decode()
            decode()
            for x in found:
                x.sort()
            flat = [y for x in found for y in x]
            items = pa.StructArray.from_arrays([pa.array([ALL[y[0]] for y in flat], pa.string()), *(pa.array([y[j] for y in flat], pa.int64()) for j in (1, 2)), pa.array([y[3] for y in flat], pa.bool_())], names=["kind", "start", "end", "base"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), items)], names=["doc_id", "spans"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")
