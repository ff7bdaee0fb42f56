"""Text decoded with the wrong character encoding (problem 5), found and undone by a hidden Markov model.

The hidden states are one clean state and one for each pair (encoding written, encoding read). Characters of the ASCII
range look alike in all states, so the model walks over the runs of other characters between them. A run in which clean and
garbled characters meet is walked in parts: characters that some pair can have made from UTF-8, replacement characters, and
the rest, each with its own label. All characters of a run or part have one label. Under a pair's state a run is what its inverse transform would be as clean text: the
emission is the clean character model's probability of the inverse, or nothing where no inverse exists. The clean model
is a character bigram model whose contexts at the ends of a run are classes of the neighbouring ASCII characters.
It is trained here, over all documents, leaving out those with signs that no clean text has (control characters of the
upper range, replacement characters, runs that become valid UTF-8 under some pair). Viterbi's path labels the runs; each
span of one label gets its state's inverse transform. The state ``lost`` marks replacement characters, which have none.

Where all gains of a document's runs together can't pay for one entry into a garbled state, the best path is the clean
one, so only other documents are walked, and only over states that gain somewhere in them; both leave the path as it is.

Null, empty and pure ASCII texts are clean. Repeated rows are labelled alike and come out once each. Extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.runtime import collect_bounded

#: (encodings written, encoding read); several readings one after another stand for text that was garbled repeatedly.
PAIRS = [
    ("utf-8", "cp1252"), ("utf-8", "cp1252", "cp1252"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "mac_roman"), ("utf-8", "mac_roman", "mac_roman"), ("utf-8", "cp1251"), ("utf-8", "cp1251", "cp1251"),
    ("utf-8", "koi8_r"), ("utf-8", "cp866"), ("utf-8", "cp1250"), ("utf-8", "cp1254"),
    ("cp1252", "latin-1"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("cp1252", "cp1250"), ("mac_roman", "cp1252"),
    ("cp1251", "cp1252"), ("cp1251", "koi8_r"), ("cp1251", "cp866"), ("cp1251", "mac_roman"), ("cp1251", "cp437"), ("cp1251", "cp850"), ("koi8_r", "cp1251"), ("koi8_r", "cp1252"), ("koi8_r", "cp866"),
    ("cp866", "cp1251"), ("cp866", "cp1252"), ("cp866", "koi8_r"), ("euc_jp", "cp1252"), ("gb18030", "cp1252"),
]
CLEAN, LOST = "clean", "lost"
STATES = [CLEAN, LOST, *(">".join(p) for p in PAIRS)]
#: Log probabilities of entering and of leaving a garbled state, at each run.
ENTER, LEAVE = log(1e-5), log(1e-2)
#: Distinct character bigrams of the alphabets in use: what training brings to the driver.
BIGRAMS = 2_000_000
#: How much more the parts of a run must gain than the whole.
CUT = 5.0
_CACHE = 200_000
_NEVER = -1e9

_RUN = re.compile(r"[^\x00-\x7f]+")
_CONTROL = re.compile("[\x80-\x9f�]")
#: Scripts in which an inverse counts as a sign of garbling while the model isn't trained yet.
_USUAL = re.compile("[\xa0-\u017f\u0400-\u045f\u2010-\u203a\u20ac\u2122\u2500-\u257f\u3000-\u30ff\u4e00-\u9fff\U0001f300-\U0001faff]+")


def _class(c: str) -> str:
    """The class of an ASCII neighbour; nothing stands for an end of the text."""
    if not c or c in "\n\r":
        return "\n"
    return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else " " if c.isspace() else "."


_CLASSES = {chr(i): _class(chr(i)) for i in range(128)} | {"": "\n"}


def _symbol(c: str) -> str:
    """The character, or one for its block of 256 beyond the alphabetic scripts."""
    return c if c < "⺀" or c == "�" else chr(ord(c) & ~0xFF)


class Inverse:
    """Undoes one pair: the characters that were read go back to bytes, and these are decoded as they were written."""

    def __init__(self, pair: tuple[str, ...]):
        self.written, self.steps = pair[0], []
        for read in pair[:0:-1]:
            back = {ord(bytes([b]).decode(read, "ignore") or chr(b)): b for b in range(128, 256)}
            if read == "cp1252":  # both readings of the upper control range are in use
                back |= {b: b for b in range(0x80, 0xA0)}
            self.steps.append(back)

    def __call__(self, run: str) -> str | None:
        text = run
        for i, back in enumerate(self.steps):
            try:
                raw = bytes([back[ord(c)] for c in text])
                text = raw.decode(self.written if i == len(self.steps) - 1 else "utf-8")
            except (KeyError, UnicodeDecodeError):
                return None
        return None if text == run or _CONTROL.search(text) else text


def _units(inverse: Inverse) -> re.Pattern:
    """What whole characters of UTF-8 look like after the last reading of a pair: one character for each byte."""
    back = inverse.steps[0]
    of = lambda lo, hi: "[" + "".join(re.escape(chr(c)) for c, b in back.items() if lo <= b <= hi) + "]"
    more = of(0x80, 0xBF)
    return re.compile(f"(?:{of(0xC2, 0xDF)}{more}|{of(0xE0, 0xEF)}{more}{{2}}|{of(0xF0, 0xF4)}{more}{{3}})+|\ufffd+")


_inverses: list[Inverse] = []
_unit_patterns: list[re.Pattern] = []


def inverses() -> list[Inverse]:
    if not _inverses:
        _inverses.extend(Inverse(p) for p in PAIRS)
    return _inverses


def unit_patterns() -> list[re.Pattern]:
    if not _unit_patterns:
        _unit_patterns.extend(_units(inverses()[i]) for i in _utf8_only)
    return _unit_patterns


def _telling(part: str) -> bool:
    """Not what clean words of another alphabet hold as well: with a sign in it, or led by a Latin letter, or lost."""
    return not part.isalpha() or part[0] < "\u0100"


def telling_parts(run: str) -> list[tuple[int, list[tuple[int, int]]]]:
    """By the number of the pair: the parts of a run that it can have made from UTF-8."""
    found = []
    for i, p in zip(_utf8_only, unit_patterns()):
        spans = [m.span() for m in p.finditer(run) if _telling(m.group())]
        if spans:
            found.append((i, spans))
    return found


def cuts(run: str) -> list[list[int]]:
    """Ways to cut a run, one for each pair that can have made a part of it from UTF-8: the bounds of the parts."""
    found = []
    for _, spans in telling_parts(run):
        bounds = sorted({0, len(run), *(x for span in spans for x in span)})
        if len(bounds) > 2 and bounds not in found:
            found.append(bounds)
    return found


_utf8_only = [i for i, p in enumerate(PAIRS) if p[0] == "utf-8"]


def _usual(i: int, part: str) -> bool:
    return (text := inverses()[i](part)) is not None and _USUAL.fullmatch(text) is not None


def suspicious(run: str) -> bool:
    """Signs that no clean text has: of garbling in the whole run, or in a part of it."""
    if _CONTROL.search(run) or any(_usual(i, run) for i in _utf8_only):
        return True
    return len(run) > 2 and any(_usual(i, run[a:b]) for i, spans in telling_parts(run) for a, b in spans)


def count_bigrams(documents: DataFrame) -> DataFrame:
    """(a, b, n): character bigrams with at least one character beyond ASCII, over all documents without such signs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for batch in batches:
            runs: Counter = Counter()
            for text in batch.column("text").to_pylist():
                own = [(text[m.start() - 1 : m.start()], m.group(), text[m.end() : m.end() + 1]) for m in _RUN.finditer(text)]
                for _, run, _ in own:
                    if run not in known:
                        if len(known) >= _CACHE:
                            known.clear()
                        known[run] = suspicious(run)
                    if known[run]:
                        break
                else:
                    runs.update(own)
            bigrams: Counter = Counter()
            for (before, run, after), n in runs.items():
                s = [_CLASSES[before], *map(_symbol, run), _CLASSES[after]]
                for pair in zip(s, s[1:]):
                    bigrams[pair] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in bigrams], type=pa.string()), pa.array([b for _, b in bigrams], type=pa.string()), pa.array(list(bigrams.values()), type=pa.int64())], names=["a", "b", "n"]
            )

    other = documents.select("text").where(F.col("text").rlike(r"[^\x00-\x7F]"))
    return other.mapInArrow(scan, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _script(s: str) -> str:
    """The kind of a symbol, to which a bigram that was never seen falls back."""
    if s < "\x80":
        return s
    if s.isalpha():
        case = "l" if s.islower() else "U" if s.isupper() else "x"
        return case + ("L" if s < "\u0250" else "G" if s < "\u0400" else "C" if s < "\u0530" else "?" if s < "⺀" else "J")
    return "box" if "\u2500" <= s < "\u25a0" else "quote" if "\u2010" <= s < "\u2070" else "sign" if s < "\u0100" else "other"


class CleanModel:
    """Log probabilities of clean runs: bigrams, backed by kinds of characters (Witten and Bell's weights)."""

    def __init__(self, bigrams: list[tuple[str, str, int]]):
        self.pair = {a + b: n for a, b, n in bigrams}
        self.after: Counter = Counter()
        self.followers: Counter = Counter()
        self.single: Counter = Counter()
        self.kind: Counter = Counter()
        self.kinds: Counter = Counter()
        self.kinds_after: Counter = Counter()
        for a, b, n in bigrams:
            self.after[a] += n
            self.followers[a] += 1
            self.single[b] += n
            self.kind[_script(b)] += n
            self.kinds[_script(a), _script(b)] += n
            self.kinds_after[_script(a)] += n
        self.memo: dict[str, float] = {}

    def bigram(self, a: str, b: str) -> float:
        k = a + b
        if k not in self.memo:
            x, y = _script(a), _script(b)
            fall = (self.kinds[x, y] + 0.1) / (self.kinds_after[x] + 2) * (self.single[b] + 0.1) / (self.kind[y] + 20)
            t = self.followers[a] + 1
            self.memo[k] = log((self.pair.get(k, 0) + t * fall) / (self.after[a] + t))
        return self.memo[k]

    def run(self, before: str, run: str, after: str) -> float:
        s = [before, *map(_symbol, run), after]
        return sum(map(self.bigram, s, s[1:]))


class Labeller:
    """The model with its memory of runs."""

    def __init__(self, clean: CleanModel):
        self.clean = clean
        self.known: dict[tuple[str, str, str], tuple[list[float], float, list[int]] | None] = {}
        self.parts_of: dict[tuple[str, str, str], list[int]] = {}
        self.cuts_of: dict[str, list[list[int]]] = {}

    def gain(self, before: str, run: str, after: str) -> tuple[list[float], float, list[int]] | None:
        """How much likelier each state is than the clean one, the most of it, and the states that gain; None if no other state can emit the run."""
        key = (before, run, after)
        if key not in self.known:
            if len(self.known) >= _CACHE:
                self.known.clear()
            out = [_NEVER] * len(STATES)
            out[0] = 0.0
            base = self.clean.run(*key)
            if "�" in run:
                out[0], out[1] = -40.0, 0.0
            for i, inverse in enumerate(inverses(), 2):
                text = inverse(run)
                if text is not None:
                    # an inverse may begin or end in ASCII characters
                    out[i] = self.clean.run(before, text, after) - base if text[0] > "\x7f" and text[-1] > "\x7f" else -base + len(text) * log(1 / 64)
            better = [i for i in range(1, len(STATES)) if out[i] > out[0]]
            self.known[key] = (out, max(out) - out[0], better) if max(out[1:]) > _NEVER else None
        return self.known[key]

    def parts(self, before: str, run: str, after: str) -> list[int]:
        """The bounds of the parts that a run is walked in: the cut whose parts gain most, if it gains more than the whole."""
        key = (before, run, after)
        if key not in self.parts_of:
            if len(self.parts_of) >= _CACHE:
                self.parts_of.clear()
                self.cuts_of.clear()
            whole = self.gain(*key)
            best, bounds = (max(0.0, whole[1]) if whole else 0.0) + CUT, [0, len(run)]
            if run not in self.cuts_of:
                self.cuts_of[run] = cuts(run)
            for b in self.cuts_of[run]:
                gained = [self.gain(*self._part(key, i, j)) for i, j in zip(b, b[1:])]
                total = sum(g[1] for g in gained if g)
                if total > best:
                    best, bounds = total, b
            self.parts_of[key] = bounds
        return self.parts_of[key]

    @staticmethod
    def _part(key: tuple[str, str, str], i: int, j: int) -> tuple[str, str, str]:
        before, run, after = key
        return before if i == 0 else _symbol(run[i - 1]), run[i:j], after if j == len(run) else _symbol(run[j])

    def path(self, text: str) -> list[tuple[int, int, int]]:
        """(begin, end, state) of every run or part that isn't clean."""
        runs, gains, most, active = [], [], 0.0, {0}
        for a, b, key in self._walked(text):
            g = self.gain(*key)
            runs.append((a, b))
            gains.append(g)
            if g is not None:
                active.update(g[2])
                most += g[1]
        if most + ENTER <= 0:
            return []
        states = sorted(active)
        score = [0.0 if s == 0 else ENTER for s in states]
        back = []
        for t, g in enumerate(gains):
            if t:
                best = max(range(1, len(states)), key=score.__getitem__)
                top, source = max((score[0] + ENTER, 0), (score[best] + LEAVE + ENTER, best))
                clean, leave = score[0], score[best] + LEAVE
                at = [(i if score[i] >= top else source) for i in range(len(states))]
                score = [max(x, top) for x in score]
                score[0], at[0] = (clean, 0) if clean >= leave else (leave, best)
                back.append(at)
            if g is None:  # likeliest where it is; a garbled span that can't emit it ends before it
                score = [score[0], *([_NEVER] * (len(score) - 1))]
            else:
                score = [x + g[0][s] for x, s in zip(score, states)]
        at = max(range(len(states)), key=score.__getitem__)
        out = []
        for t in range(len(runs) - 1, -1, -1):
            if states[at]:
                out.append((*runs[t], states[at]))
            at = back[t - 1][at] if t else 0
        return out[::-1]

    def _walked(self, text: str) -> Iterator[tuple[int, int, tuple[str, str, str]]]:
        for m in _RUN.finditer(text):
            a, b = m.span()
            key = (_CLASSES[text[a - 1 : a]], m.group(), _CLASSES[text[b : b + 1]])
            if b - a < 3 and "\ufffd" not in key[1]:  # too short for a clean and a garbled character
                yield a, b, key
                continue
            bounds = self.parts(*key)
            for i, j in zip(bounds, bounds[1:]):
                yield a + i, a + j, self._part(key, i, j)

    def restore(self, text: str, path: list[tuple[int, int, int]]) -> str:
        parts, last = [], 0
        for a, b, state in path:
            inverse = inverses()[state - 2](text[a:b]) if state > 1 else None
            parts += [text[last:a], text[a:b] if inverse is None else inverse]
            last = b
        return "".join(parts) + text[last:]


def spans(text: str, path: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Neighbouring runs of one state, with nothing but ASCII between them, as one span."""
    out: list[tuple[int, int, int]] = []
    for a, b, s in path:
        if out and out[-1][2] == s and text[out[-1][1] : a].isascii():
            out[-1] = (out[-1][0], b, s)
        else:
            out.append((a, b, s))
    return out


def garbled(documents: DataFrame) -> DataFrame:
    """One row for each affected document: its spans (begin, end, pair), whether all of them were undone, and the text after it."""
    bigrams = [tuple(r) for r in collect_bounded(count_bigrams(documents), BIGRAMS, "character bigrams")]
    sc = documents.sparkSession.sparkContext
    model = sc.broadcast(bigrams)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(CleanModel(model.value))
        for batch in batches:
            ids, found, restored, marks, whole = batch.column("doc_id"), [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                path = labeller.path(text)
                if path:
                    found.append(i)
                    marks.append([{"begin": a, "end": b, "pair": STATES[s]} for a, b, s in spans(text, path)])
                    whole.append(all(s > 1 for _, _, s in path))
                    restored.append(labeller.restore(text, path))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(found, type=pa.int64())), pa.array(marks, type=pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("pair", pa.string())]))), pa.array(whole, type=pa.bool_()), pa.array(restored, type=pa.string())],
                names=["doc_id", "spans", "restored", "text"],
            )

    other = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike(r"[^\x00-\x7F]"))
    return other.mapInArrow(scan, "doc_id long, spans array<struct<begin:int,end:int,pair:string>>, restored boolean, text string")
