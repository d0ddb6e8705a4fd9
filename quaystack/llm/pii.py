"""Personal data: fixed patterns plus a linear-chain CRF over word shapes.

The base patterns find e-mail addresses, IPv4 addresses, card numbers and
phone numbers; every match that passes its check stays. A conditional
random field then tags every word of every line with BIO labels from the
shapes of the word and its neighbours. It finds what the patterns lose (a
phone number run into the number after it) and keys that no pattern names
(``secret``). A tagged run becomes a span if it holds a value that passes
its kind's check and overlaps no base span.

The field is trained by gradient ascent on its log-likelihood over the
small labelled table below and decoded by Viterbi in numpy, a step for all
lines of a batch at once. Words are cut at white space, lines at line feeds.

Edge cases: a null or empty text has no spans. Offsets count code points,
ends are exclusive. Null ids, repeated rows and extra columns pass through.
Texts and lines of any length are read whole, in time linear in them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystack.llm.common import column, ready, texts

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

# --- base patterns ------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A match starts at a run of digits, so later digits of a run are no starts.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _DIGITS = re.compile(r"[0-9]"), re.compile(r"[0-9]+")


def _number(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def valid(kind: str, value: str) -> bool:
    """The check that a match of a base kind must pass."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in value.split("."))
    if kind == "card":
        digits = _number(value)
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(_number(value)) <= 15
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every address has one ``@`` after a run of local characters: the run
    is walked back from it, so a long run without one costs nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("email", *s) for s in _emails(text)]
    if _DIGIT.search(text):
        for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
            spans += [(kind, *m.span()) for m in pattern.finditer(text) if valid(kind, m[0])]
    return spans


# --- the labelled table -------------------------------------------------------

#: Sentences with marked values; ``{email}`` and so on stand for drawn ones.
TABLE = """
Please write to [{email}] before noon.
Kontakt: [{email}] oder [{phone}] am Abend.
The thing ing [{email}] reon relywh the.
[{email}] de la maison avec des amis.
[{email}] | Elnbo | osmimi | tion.
Escriba a [{email}], por favor.
My number is [{phone}] and I am home.
Call [{phone}] or [{phone}] today.
nd the rely [{phone}] erth is. Ed reen.
In real [{phone}] [{card}] the hentand.
Tel. [{phone}], bitte nach acht Uhr.
ont*** [{phone}] era&&& the$$$ of%%%
Il a dit [{card}] et puis rien.
Card [{card}] expires soon, she said.
THE!! [{card}]!! OF!! INGNT!! AND!!
Of the [{card}] [{phone}] thonly.
Pay with [{card}]. Then leave.
The server [{ip}] was down again.
Ping [{ip}], then [{ip}] and wait.
erea [{ip}]*** the&&& ing### of
Von [{ip}] kam keine Antwort.
una [{ip}] y la otra [{ip}] ayer.
Config: token = "[{secret}]" and go on.
token = "[{secret}]" From here on nothing.
The ing token = "[{secret}]" thand with. Esand.
api_key: [{secret}] is not for you.
Use secret [{secret}] with care.
password= "[{secret}]" der die das
Mail [{email}] ip [{ip}] phone [{phone}] done.
Reen token = "[{secret}]"### el%%% con$$$ raos***
A token of thanks was given to her = fine.
The key to the house is under a stone.
In 1984 there were 12,000 people, 3.5 percent more.
Version 2.0. of the License, chapter 12.
Licensed under CC BY-NC 4.0.
It cost $5.99 + 10% at 10:30 on 2024-05-06.
Room 101, floor 3, +2 degrees (cold).
THE!! QUICK!! FOX.!! OVER!! DOGS!!
That*** this*** eredsh$$$ for,*** onhe*** the&&&
Ein | Wort | das | steht | allein.
Les enfants jouent dans la cour, et puis rentrent.
Der Hund schläft unter dem Tisch und träumt.
El perro duerme, la niña canta por la noche.
She met @home friends and a/b tests v1.2.3 again.
Order 20240506123456 shipped in 2 boxes.
The the the the and of in on it was.
See section 1.2.3 and page 4-5 of it.
Was it [{ip}]? No, it was [{ip}]!
"""

_MARK = re.compile(r"\[\{(\w+)\}\]")


def _draw(kind: str, rng: np.random.Generator) -> str:
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *options: options[rng.integers(len(options))]
    if kind == "email":
        name = pick("jo", "anna.maria", "k", "user", "first_last", "info+list", "ma-ro") + pick("", digits(2))
        return f"{name}@{pick('mail', 'post', 'site', 'host')}{pick('', digits(1))}.{pick('example', 'test')}.{pick('com', 'org', 'net', 'de')}"
    if kind == "ip":
        return ".".join(str(n) for n in rng.integers(1, 256, 4))
    if kind == "card":
        body = str(rng.integers(3, 7)) + digits(14)
        number = next(body + d for d in "0123456789" if luhn(body + d))
        return pick(number, number, " ".join(number[i:i + 4] for i in range(0, 16, 4)),
                    "-".join(number[i:i + 4] for i in range(0, 16, 4)))
    if kind == "phone":
        return pick(f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(7)}",
                    f"+{digits(1)}-{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(2)}{digits(9)}")
    return "".join(pick(*"0123456789abcdef") for _ in range(pick(32, 40, 40, 48)))


def labelled_rows(copies: int = 6, seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """The table with drawn values as words and tag numbers."""
    rng, rows = np.random.default_rng(seed), []
    for line in TABLE.strip().split("\n") * copies:
        text, spans, end = "", [], 0
        for mark in _MARK.finditer(line):
            value = _draw(mark[1], rng)
            text += line[end:mark.start()]
            spans.append((mark[1], len(text), len(text) + len(value)))
            text, end = text + value, mark.end()
        text += line[end:]
        words, tags, last = [], [], None
        for word in re.finditer(r"\S+", text):
            hit = next((s for s in spans if s[1] < word.end() and word.start() < s[2]), None)
            tag = 0 if hit is None else TAGS.index(("I-" if hit is last else "B-") + hit[0])
            words.append(word[0])
            tags.append(tag)
            last = hit
        rows.append((words, tags))
    return rows


# --- features -------------------------------------------------------------------

_RUNS = [(re.compile(p), r) for p, r in
         ((r"[A-Z]{3,}", "XX"), (r"[^\W\d_A-Z]{3,}", "xx"), (r"[A-Z]", "X"), (r"[^\W\d_A-Z]", "x"),
          (r"[0-9]+", "9"))]
_HEX = re.compile(r"[0-9a-f]{16,}|[0-9A-F]{16,}")
_CUES = frozenset("token key api_key secret password = tel phone call mail email card ip".split())
_SHAPE_CHARS = 14


def word_features(word: str) -> tuple[str, ...]:
    """Shape, size and cue features of one word, read whole: its runs of
    letters and digits are shortened everywhere, and of the shape that is
    left the first ``_SHAPE_CHARS`` characters and the last one count."""
    cue = word.lower().strip(":=\"'.,")
    cue = f"cue={cue or word[:3]}" if (cue or word) in _CUES else "cue="
    if word.isalpha():
        shape = "XX" if word.isupper() else "Xx" if word[0].isupper() else "xx"
        return f"shape={shape}", "digits=0", cue, "hex=0"
    shape = word
    for pattern, mark in _RUNS:
        shape = pattern.sub(mark, shape)
    digits = sum(map(len, _DIGITS.findall(word)))
    size = next(i for i, most in enumerate((0, 2, 4, 7, 11, 15, 19, 10**12)) if digits <= most)
    run = _HEX.search(word)
    hexed = bool(run and not run[0].isdigit() and not run[0].isalpha())
    return (f"shape={shape[:_SHAPE_CHARS]}", f"first={shape[:1]}", f"last={shape[-1:]}",
            f"digits={size}", f"dots={min(word.count('.'), 4)}", f"at={'@' in word}",
            f"sign={word[0] == '+'}", cue, f"hex={int(hexed)}")


class Crf(NamedTuple):
    """Feature numbers, their weights for this, the last and the next word,
    tag transitions, and the scores of a line's first and last tag."""

    features: dict[str, int]
    weights: np.ndarray      # (3, features, tags)
    moves: np.ndarray        # (tags, tags)
    first: np.ndarray
    last: np.ndarray

    def rows(self, word: tuple[str, ...]) -> np.ndarray:
        known = [self.features[f] for f in word if f in self.features]
        return self.weights[:, known].sum(axis=1)


_EDGE = ("edge",)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@lru_cache(maxsize=1)
def train(rounds: int = 160, rate: float = 0.15, decay: float = 2e-3) -> Crf:
    """Maximise the likelihood of the labelled table (Adam, all rows a step)."""
    rows = labelled_rows()
    tagged = [([word_features(w) for w in words], tags) for words, tags in rows]
    names = sorted({f for words, _ in tagged for w in words for f in w} | set(_EDGE))
    number = {f: i for i, f in enumerate(names)}
    n, longest, t = len(rows), max(len(w) for w, _ in rows), len(TAGS)
    have = np.zeros((3, n, longest, len(names)))
    y, live = np.zeros((n, longest), dtype=int), np.zeros((n, longest), dtype=bool)
    for r, (words, tags) in enumerate(tagged):
        padded = [_EDGE, *words, _EDGE]
        for i in range(len(words)):
            for place, word in enumerate((padded[i + 1], padded[i], padded[i + 2])):
                have[place, r, i, [number[f] for f in word]] = 1
        y[r, :len(words)], live[r, :len(words)] = tags, True
    ends = live.sum(axis=1) - 1
    each, true = np.arange(n), np.eye(t)[y] * live[..., None]
    both = true[:, :-1, :, None] * true[:, 1:, None, :]
    goals = (both.sum(axis=(0, 1)), true[:, 0].sum(axis=0), true[each, ends].sum(axis=0))
    flat = have.transpose(1, 2, 0, 3).reshape(n * longest, -1)
    goals = ((flat.T @ true.reshape(-1, t)).reshape(3, -1, t), *goals)
    values = [np.zeros_like(g) for g in goals]
    ms, vs = [np.zeros_like(g) for g in goals], [np.zeros_like(g) for g in goals]
    for step in range(1, rounds + 1):
        w, moves, first, last = values
        emit = (flat @ w.reshape(-1, t)).reshape(n, longest, t)
        ahead = np.zeros((longest, n, t))
        behind = np.zeros((longest, n, t))
        ahead[0] = emit[:, 0] + first
        for i in range(1, longest):
            new = _lse(ahead[i - 1][:, :, None] + moves, 1) + emit[:, i]
            ahead[i] = np.where(live[:, i, None], new, ahead[i - 1])
        total = _lse(ahead[-1] + last, 1)
        behind[-1] = last
        for i in range(longest - 2, -1, -1):
            new = _lse(moves + (emit[:, i + 1] + behind[i + 1])[:, None, :], 2)
            behind[i] = np.where(live[:, i + 1, None], new, last)
        one = np.exp((ahead + behind).transpose(1, 0, 2) - total[:, None, None]) * live[..., None]
        two = np.exp(ahead[:-1].transpose(1, 0, 2)[..., None] + moves
                     + (emit[:, 1:] + behind[1:].transpose(1, 0, 2))[:, :, None, :]
                     - total[:, None, None, None]) * live[:, 1:, None, None]
        means = ((flat.T @ one.reshape(-1, t)).reshape(3, -1, t), two.sum(axis=(0, 1)),
                 one[:, 0].sum(axis=0), one[each, ends].sum(axis=0))
        for k, (goal, mean) in enumerate(zip(goals, means)):
            g = (goal - mean) / n - decay * values[k]
            ms[k], vs[k] = 0.9 * ms[k] + 0.1 * g, 0.99 * vs[k] + 0.01 * g * g
            values[k] = values[k] + rate * (ms[k] / (1 - 0.9**step)) / (
                np.sqrt(vs[k] / (1 - 0.99**step)) + 1e-8)
    w, moves, first, last = (v.astype(np.float32) for v in values)
    return Crf(number, w, moves, first, last)


# --- decoding -------------------------------------------------------------------


class Tagger:
    """Decodes lines; keeps words and shapes it has seen, up to bounds that
    only limit its memory."""

    WORDS, SHAPES, TOKENS = 300_000, 50_000, 200_000

    def __init__(self, crf: Crf):
        self.crf = crf
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.shapes: dict[tuple[str, ...], int] = {_EDGE: 0}
        self.tables = [self.crf.rows(_EDGE)]

    def _number(self, word: str) -> int:
        shape = word_features(word)
        at = self.shapes.get(shape)
        if at is None:
            at = self.shapes[shape] = len(self.tables)
            self.tables.append(self.crf.rows(shape))
        if len(word) <= 64:
            self.words[word] = at
        return at

    def tags(self, lines: list[list[str]]) -> list[np.ndarray]:
        """The best tags of each line (lists of words, none empty)."""
        out: list[np.ndarray] = []
        group, size = [], 0
        for line in lines:
            group.append(line)
            size += len(line)
            if size >= self.TOKENS:
                out += self._decode(group)
                group, size = [], 0
        return out + (self._decode(group) if group else [])

    def _decode(self, lines: list[list[str]]) -> list[np.ndarray]:
        if len(self.words) > self.WORDS or len(self.tables) > self.SHAPES:
            self._forget()
        known = self.words.get
        ids = []
        for line in lines:
            for word in line:
                at = known(word)
                ids.append(self._number(word) if at is None else at)
        lens = np.array([len(line) for line in lines])
        order = np.argsort(-lens, kind="stable")
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        tables = np.stack(self.tables)  # (shapes, 3, tags)
        here = np.array(ids)
        before, after = np.roll(here, 1), np.roll(here, -1)
        before[starts], after[starts + lens - 1] = 0, 0
        emit = tables[here, 0] + tables[before, 1] + tables[after, 2]
        emit[starts] += self.crf.first
        emit[starts + lens - 1] += self.crf.last

        lens, starts = lens[order], starts[order]
        back = np.zeros((len(here), len(TAGS)), dtype=np.int8)
        score = emit[starts].copy()
        final = np.empty(len(lines), dtype=np.int64)
        moves = self.crf.moves.T[None]
        alive = np.searchsorted(-lens, -np.arange(1, lens[0] + 1), side="right")
        for i in range(1, int(lens[0])):
            k = alive[i]
            if k < len(score):
                final[k:len(score)] = score[k:].argmax(axis=1)
                score = score[:k]
            reach = score[:, None, :] + moves
            best = reach.argmax(axis=2)
            at = starts[:k] + i
            back[at] = best
            score = np.take_along_axis(reach, best[..., None], 2)[..., 0] + emit[at]
        final[:len(score)] = score.argmax(axis=1)

        tags = np.zeros(len(here), dtype=np.int8)
        now = np.zeros(len(lines), dtype=np.int64)
        for i in range(int(lens[0]) - 1, -1, -1):
            k = alive[i]
            at = starts[:k] + i
            ending = lens[:k] == i + 1
            now[:k][ending] = final[:k][ending]
            tags[at] = now[:k]
            now[:k] = back[at, now[:k]]
        parts: list[np.ndarray] = [None] * len(lines)  # type: ignore[list-item]
        for line, start, length in zip(order.tolist(), starts.tolist(), lens.tolist()):
            parts[line] = tags[start:start + length]
        return parts


_VALUE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": _IP, "card": _CARD,
    "phone": re.compile(r"\+?[0-9][\x20().0-9-]*[0-9]"),
    "secret": re.compile(r"[A-Za-z0-9_-]{20,}"),
}


def _proper(kind: str, value: str) -> bool:
    if kind == "secret":
        return any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    return valid(kind, value)


_WORD = re.compile(r"\S+")


def _tagged_spans(line: str, at: int, tags: np.ndarray) -> Iterator[tuple[str, int, int]]:
    words = [m.span() for m in _WORD.finditer(line)]
    runs: list[list] = []
    for i in np.flatnonzero(tags).tolist():
        part, kind = TAGS[tags[i]].split("-")
        if part == "I" and runs and runs[-1][0] == kind and runs[-1][2] == i - 1:
            runs[-1][2] = i
        else:
            runs.append([kind, i, i])
    for kind, a, b in runs:
        value = _VALUE[kind].search(line, words[a][0], words[b][1])
        if value and _proper(kind, value[0]):
            yield kind, at + value.start(), at + value.end()


def all_spans(batch: list[str], tagger: Tagger) -> list[list[tuple[str, int, int, bool]]]:
    """Spans of each text, by kind and start; the last field marks base ones."""
    lines, owners = [], []
    for number, text in enumerate(batch):
        at = 0
        for line in text.split("\n"):
            words = line.split()
            if words:
                lines.append(words)
                owners.append((number, at, line))
            at += len(line) + 1
    found = [[(*s, True) for s in base_spans(text)] for text in batch]
    for (number, at, line), tags in zip(owners, tagger.tags(lines)):
        if tags.any():
            for kind, start, end in _tagged_spans(line, at, tags):
                if all(end <= s[1] or s[2] <= start for s in found[number]):
                    found[number].append((kind, start, end, False))
    return [sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])) for spans in found]


_TAGGERS: dict[int, Tagger] = {}


def tagger(crf: Crf) -> Tagger:
    """One a process for a model; workers keep it between tasks."""
    key = zlib.crc32(crf.weights.tobytes())
    if key not in _TAGGERS:
        _TAGGERS.clear()
        _TAGGERS[key] = Tagger(crf)
    return _TAGGERS[key]


# --- operators ------------------------------------------------------------------

_SPANS = "spans array<struct<kind:string,start:int,end:int,base:boolean>>"


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             crf: Crf | None = None) -> DataFrame:
    """``(id, spans)`` of every row, spans by kind (as in KINDS), then start."""
    ready(df.sparkSession)
    rows, model = texts(df, id_col, text_col), crf or train()
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                      ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tagger(model)
        for batch in batches:
            spans = all_spans(batch.column("text").to_pylist(), own)
            made = pa.array([[dict(zip(("kind", "start", "end", "base"), s)) for s in row]
                             for row in spans], pa.list_(span))
            yield pa.RecordBatch.from_arrays([batch.column("id"), made], ["id", "spans"])

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, {_SPANS}").withColumnRenamed("id", id_col)


def masked(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with ``<KIND>`` in place of every span; overlaps merge."""
    out, done = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def mask_column(text: Column, crf: Crf | None = None) -> Column:
    """The masked text; a null text stays null."""
    model = crf or train()

    @F.pandas_udf("string")
    def mask(batch: pd.Series) -> pd.Series:
        whole = [t or "" for t in batch]
        spans = all_spans(whole, tagger(model))
        return pd.Series([None if raw is None else masked(t, s)
                          for raw, t, s in zip(batch, whole, spans)], dtype=object)

    return mask(text)


def mask_pii(df: DataFrame, text_col: str = "text", crf: Crf | None = None) -> DataFrame:
    """``df`` with personal data in ``text_col`` replaced, other columns as they are."""
    ready(df.sparkSession)
    return df.withColumn(text_col, mask_column(column(text_col), crf))
