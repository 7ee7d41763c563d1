"""Operator 10: token counts by a compiled finite-state tokenizer.

A sentencepiece BPE file is compiled to a deterministic transducer over characters whose transitions carry
the number of tokens by which the count of the text so far changes (it can fall: a merge makes two tokens
one). Counting is then table lookups, many stretches of text in step.

Why the transducer is exact. Merges are ordered by the score of what they make, so a sequence of tokens
is what the library gives if each two neighbours alone would be left as they are. A text up to any
character so has one last token: the one that ends there, begins where another prefix of the text ends,
and is left as it is behind that prefix's last token. What may still matter of a text is thus, for each
suffix of it that begins some token, the last token and the count before that suffix. That is a state. States are
met, numbered and given their transitions as texts need them; a worker holds some ``MOST_TRANSITIONS`` of them, then starts anew.
No token has a space mark behind another character, so a mark starts afresh; runs of marks are one
input symbol each. Characters outside the vocabulary count their UTF-8 bytes and start afresh.

Chunks. The texts of a batch are laid end to end and cut into chunks of equal length. A chunk's map takes
the state before it to the state behind it and a count. Where some character starts afresh, all after the first such one
is constant. A chunk without one has a map over the states that can come before it: ``passing`` starts with
what the chunk before gives from the empty state, and adds what comes out of any chunk with the same last characters until nothing new does; tokens are short, so these
are a few states a chunk, and all chunks' are worked out in step. A prefix scan by doubling composes the maps, and
the heads of the other chunks, up to where they start afresh, run in step from the states that the scan gives.

Long texts are cut before space marks into parts of some 1.5 million characters, which are counted one after the other; memory grows with
the longest stretch without a mark alone.

Cases: null and empty text have no tokens and no bytes; special strings in a text are plain text, as the
library takes them by default. Repeated rows are counted each. Extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

LIMIT = 4096
MARK = "▁"
MARKS = " " + MARK
#: Where a run of marks begins.
OPENS = re.compile(f"(?<=[^{MARKS}])[{MARKS}]")
#: Runs of marks up to this length are symbols of their own; longer ones are shortened by whole longest tokens.
CHUNK = 192
MOST_TRANSITIONS = 500_000
#: More than there are Unicode characters and runs: state * SYMBOLS + symbol is a transition's key.
SYMBOLS = 1 << 21
_SPREAD, _ALL = 0x9E3779B97F4A7C15, 2**64 - 1
COUNTED = "doc_id long, n_bytes long, n_tokens long"


class Pieces:
    """The vocabulary of a sentencepiece BPE file, and the library's merges for a few characters."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: only BPE with byte fallback, a leading mark and no normalisation is compiled")
        self.score = {p.piece: p.score for p in model.pieces if p.type in (1, 4, 5)}
        if any(MARK in p.lstrip(MARK) or p[0] == MARK and p[1:2] == MARK and p.strip(MARK) for p in self.score):
            raise ValueError(f"{path}: a piece holds a space mark behind another character")
        self.characters = {c for p in self.score for c in p}
        self.longest = max(map(len, self.score))
        self.longest_run = max(len(p) for p in self.score if not p.strip(MARK))
        self._kept: dict[tuple[str, str], bool] = {}

    def merge(self, parts: list[str]) -> list[str]:
        """The best-scored pair becomes one, the leftmost of equals first, while there is one."""
        parts = list(parts)
        while True:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def kept(self, a: str, b: str) -> bool:
        """Whether the tokens a, b stay as they are side by side."""
        found = self._kept.get((a, b))
        if found is None:
            if len(self._kept) > 2_000_000:
                self._kept.clear()
            found = self._kept[a, b] = self.merge([*a, *b]) == [a, b]
        return found

    def run_tokens(self, n: int) -> int:
        """Tokens of n marks and nothing else."""
        return n and len(self.merge([MARK] * n))


class Transducer:
    """States and transitions by need. Symbols: 0 .. runs - 1 are runs of 1 .. runs marks, then vocabulary characters as met."""

    def __init__(self, pieces: Pieces, most: int = MOST_TRANSITIONS):
        self.pieces, self.most = pieces, most
        self.runs = 2 * pieces.longest_run
        self.run_count = [pieces.run_tokens(n) for n in range(self.runs + 1)]
        self.prefixes = {p[:i] for p in pieces.score for i in range(1, len(p) + 1)}
        self.symbol_of = np.full(0x110000, -1, np.int32)  # -1: not in the vocabulary; -2: in it, not met yet
        self.symbol_of[[ord(c) for c in pieces.characters]] = -2
        self.forget()

    def forget(self) -> None:
        for c in getattr(self, "met", ()):
            self.symbol_of[ord(c)] = -2
        self.met: list[str] = []
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.transitions = 0
        self._room(1 << 16)
        self.number(())  # state 0: nothing before that matters

    def _room(self, slots: int) -> None:
        """An open-addressed table: a transition lies in the first free slot from its key's own."""
        old = getattr(self, "keys", np.zeros(0, np.int64)) if self.transitions else np.zeros(0, np.int64)
        held = (old[old >= 0], *(x[old >= 0] for x in (self.to, self.gain))) if len(old) else ()
        self.mask = slots - 1
        self.keys = np.full(slots, -1, np.int64)
        self.to, self.gain = np.zeros(slots, np.int32), np.zeros(slots, np.int16)
        for key, to, gain in zip(*(x.tolist() for x in held), strict=True) if held else ():
            self._put(key, to, gain)

    def _put(self, key: int, to: int, gain: int) -> None:
        at = (key * _SPREAD & _ALL) >> 20 & self.mask
        while self.keys[at] >= 0:
            at = at + 1 & self.mask
        self.keys[at], self.to[at], self.gain[at] = key, to, gain

    @property
    def full(self) -> bool:
        return self.transitions > self.most

    def number(self, state: tuple) -> int:
        at = self.numbers.get(state)
        if at is None:
            at = self.numbers[state] = len(self.states)
            self.states.append(state)
        return at

    def symbols(self, points: np.ndarray) -> np.ndarray:
        """Symbols of code points (no marks); -1 for those outside the vocabulary."""
        out = self.symbol_of[points]
        if (out == -2).any():
            for p in np.unique(points[out == -2]).tolist():
                self.symbol_of[p] = self.runs + len(self.met)
                self.met.append(chr(p))
            out = self.symbol_of[points]
        return out

    def compile(self, state: int, symbol: int) -> None:
        """Work out one transition.

        A state lists (suffix, last token before the suffix or None, count before it less the count of
        all), for suffixes that begin a token, longest first; the empty suffix stands for the text as it is.
        """
        if symbol < self.runs:
            n = symbol + 1
            gain = self.run_count[n]
            after = ((MARK, None, self.run_count[n - 1] - gain), ("", MARK, 0))
        else:
            c = self.met[symbol - self.runs]
            before = self.states[state] or (("", None, 0),)
            last, least = None, None
            for suffix, token, count in before:  # the longest suffix that, with c, is a token left as it is
                t = suffix + c
                if t in self.pieces.score and (token is None or self.pieces.kept(token, t)):
                    last, least = t, count + 1
                    break
            if last is None:
                raise RuntimeError(f"no token ends in {c!r} after {before!r}")
            gain = least
            grown = [(s + c, token, count - gain) for s, token, count in before if s + c in self.prefixes]
            after = (*grown, ("", last, 0))
        self.transitions += 1
        if 3 * self.transitions > self.mask:
            self._room(4 * (self.mask + 1))
        self._put(state * SYMBOLS + symbol, self.number(after), gain)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Slots of keys; -1 where there is none."""
        at = ((key.astype(np.uint64) * np.uint64(_SPREAD)) >> np.uint64(20)).astype(np.int64) & self.mask
        found = self.keys[at]
        off = np.flatnonzero(found != key)
        while len(off):
            off = off[found[off] >= 0]
            at[off] = at[off] + 1 & self.mask
            found[off] = self.keys[at[off]]
            off = off[found[off] != key[off]]
            if len(off) and (found[off] < 0).all():
                break
        at[found != key] = -1
        return at

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and gains of many places at once."""
        key = state * SYMBOLS + symbol
        at = self._find(key)
        if at.min(initial=0) < 0:
            for one in np.unique(key[at < 0]).tolist():
                self.compile(*divmod(one, SYMBOLS))
            at = self._find(key)
        return self.to[at].astype(np.int64), self.gain[at]


def compose(to: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of maps in a row (number of a state before -> number of the state behind, and a gain), each composed with all before it: Hillis and Steele's scan, by doubling."""
    to, gain = to.copy(), gain.copy()
    step = 1
    while step < len(to):
        first, then = to[:-step], np.arange(step, len(to))[:, None]
        new_gain = gain[:-step] + gain[then, first]
        to[step:], gain[step:] = to[then, first], new_gain
        step *= 2
    return to, gain


def passing(machine: Transducer, grid: np.ndarray, passes: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Gains of the chunks that start nothing afresh (``passes``); ``state``, of the states behind chunks, gets theirs.

    grid: symbols, a row a chunk. A run of such chunks begins behind one whose state is known.
    """
    rows, chunk = grid.shape
    gained = np.zeros(rows, np.int64)

    def walk(which: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = np.zeros(len(which), np.int64)
        for j in range(chunk):
            own, g = machine.step(own, grid[which, j])
            total += g
        return own, total

    places = np.flatnonzero(passes)
    leads = ~np.concatenate([[False], passes])[places] if places[0] == 0 else ~passes[places - 1]
    known = np.where(places > 0, state[places - 1], 0)
    guess, _ = walk(places, np.zeros(len(places), np.int64))
    # lanes: a chunk and a state before it
    entry = np.where(leads, known, np.concatenate([[0], guess[:-1]]))
    follows = np.append(~leads[1:], False)  # the next of ``places`` goes on from this one
    maps: list[dict[int, tuple[int, int]]] = [{} for _ in places]
    # what has come before a chunk may come before all chunks behind the same characters
    behind_same: dict[bytes, list[int]] = {}
    ends = [None if lead else grid[p - 1, -machine.pieces.longest :].tobytes() for lead, p in zip(leads.tolist(), places.tolist(), strict=True)]
    for k, end in enumerate(ends):
        behind_same.setdefault(end, []).append(k)
    met = set(zip(ends, entry.tolist(), strict=True))
    todo = [(k, e) for k, e in enumerate(entry.tolist()) if leads[k]] + [(k, e) for end, e in met if end is not None for k in behind_same[end]]
    while todo:
        at, own = (np.array(x) for x in zip(*todo, strict=True))
        out, total = walk(places[at], own)
        todo = []
        for k, before, behind, gain in zip(at.tolist(), own.tolist(), out.tolist(), total.tolist(), strict=True):
            maps[k][before] = (behind, gain)
            if follows[k] and (ends[k + 1], behind) not in met:
                met.add((ends[k + 1], behind))
                todo += [(other, behind) for other in behind_same[ends[k + 1]]]
    # states before a chunk by number; what a map gives as numbers of the states before the next chunk
    names = [list(m) for m in maps]
    number = [{s: i for i, s in enumerate(own)} for own in names]
    bounds = np.flatnonzero(leads).tolist() + [len(places)]
    for a, b in zip(bounds, bounds[1:], strict=False):
        width = max(map(len, names[a:b]))
        to, gain = np.zeros((b - a, width), np.int64), np.zeros((b - a, width), np.int64)
        for k in range(a, b):
            for i, s in enumerate(names[k]):
                behind, g = maps[k][s]
                to[k - a, i], gain[k - a, i] = number[k + 1][behind] if k + 1 < b else behind, g
        upto, total = compose(to, gain)
        first = number[a][int(entry[a])]
        total = total[:, first]
        gained[places[a:b]] = np.diff(total, prepend=0)
        last = upto[:, first].tolist()
        state[places[a:b]] = [names[k + 1][last[k - a]] if k + 1 < b else last[k - a] for k in range(a, b)]
    return gained


def _counts(machine: Transducer, texts: list[str], chunk: int) -> np.ndarray:
    """Tokens of each text (none of them empty)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer((" " + " ".join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    firsts = np.cumsum(lengths + 1) - lengths - 1  # places of the marks put before the texts
    mark = (points == 32) | (points == ord(MARK))
    # runs of marks become one symbol, the count of longest tokens taken off is added apart
    opens = mark & ~np.concatenate([[False], mark[:-1]])
    opens[firsts] = True
    starts = np.flatnonzero(opens)
    stops = np.flatnonzero(mark & ~np.concatenate([mark[1:] & ~opens[1:], [False]]))
    run = stops - starts + 1
    longest = machine.pieces.longest_run
    off = np.where(run > machine.runs, (run - longest - 1) // longest, 0)
    symbol = machine.symbols(np.where(mark, 0x110000 - 1, points))
    unknown = (symbol < 0) & ~mark
    symbol[starts] = run - off * longest - 1
    kept = opens | ~mark
    apart = np.zeros(len(points), np.int64)
    apart[starts] = off
    p = points[unknown]
    apart[unknown] = 1 + (p > 0x7F).astype(np.int64) + (p > 0x7FF) + (p > 0xFFFF)
    text_of = np.repeat(np.arange(len(texts)), lengths + 1)
    totals = np.bincount(text_of[apart > 0], weights=apart[apart > 0], minlength=len(texts)).astype(np.int64)
    symbol, fresh = symbol[kept], (opens | unknown)[kept]
    # an unknown character leaves state 0 behind it: as a symbol it is -1
    n = len(symbol)
    rows = -(-n // chunk)
    padded = np.full(rows * chunk, -1, np.int32)
    padded[:n] = symbol
    starts_fresh = np.zeros(rows * chunk, bool)
    starts_fresh[:n] = fresh
    starts_fresh[n:] = True
    grid, anew = padded.reshape(rows, chunk), starts_fresh.reshape(rows, chunk)
    head = np.where(anew.any(axis=1), anew.argmax(axis=1), chunk)
    gains = np.zeros((rows, chunk), np.int32)
    state = np.zeros(rows, np.int64)
    # tails: from where a chunk starts afresh its map is constant
    for j in range(chunk):
        live = np.flatnonzero((head <= j) & (grid[:, j] >= 0))
        state[(head <= j) & (grid[:, j] < 0)] = 0
        if len(live):
            state[live], gains[live, j] = machine.step(state[live], grid[live, j])
    passes = head == chunk
    if passes.any():
        own_gain = passing(machine, grid, passes, state)
        apart_from = np.flatnonzero(passes)
        totals += np.bincount(text_of[kept][apart_from * chunk], weights=own_gain[apart_from], minlength=len(texts)).astype(np.int64)
    entry = np.concatenate([[0], state[:-1]])
    # heads: all chunks' beginnings in step, now that their entries are known
    own = entry.copy()
    for j in range(int(head[~passes].max(initial=0))):
        live = np.flatnonzero((head > j) & ~passes)
        own[live], gains[live, j] = machine.step(own[live], grid[live, j])
    return totals + np.bincount(text_of[kept], weights=gains.ravel()[:n], minlength=len(texts)).astype(np.int64)


class Counter:
    """Counts tokens of texts with one transducer."""

    def __init__(self, path: str, chunk: int = CHUNK, most: int = MOST_TRANSITIONS, most_points: int = 1_500_000):
        self.machine, self.chunk, self.most_points = Transducer(Pieces(path), most), chunk, most_points

    def parts(self, text: str) -> Iterator[str]:
        """A text cut where runs of space marks begin into parts of some ``most_points`` characters, whose tokens add up to its own.

        The mark at a cut is left out, as each part is counted with a mark put before it. Stretches without a mark stay whole.
        """
        at = 0
        while len(text) - at > self.most_points:
            head = text[at : at + self.most_points]
            cut = at + len(head[: max(map(head.rfind, MARKS)) + 1].rstrip(MARKS))
            if cut == at:  # no run begins behind the part's own first one
                found = OPENS.search(text, at + self.most_points)
                cut = found.start() if found else len(text)
            if cut >= len(text) - 1:  # nothing is left behind it
                break
            yield text[at:cut]
            at = cut + 1
        yield text[at:]

    def count(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        of: list[int] = []
        group: list[str] = []
        size = 0

        def add() -> None:
            if self.machine.full:
                self.machine.forget()
            np.add.at(out, of, _counts(self.machine, group, self.chunk))

        for i, text in enumerate(texts):
            for part in self.parts(text) if text else ():
                of.append(i)
                group.append(part)
                size += len(part)
                if size > self.most_points:
                    add()
                    of, group, size = [], [], 0
        if group:
            add()
        return out


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    """One transducer for each Python worker."""
    return Counter(path)


def _count(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                text = batch.column("text")
                n_bytes = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
                yield pa.record_batch([batch.column("doc_id"), n_bytes, pa.array(counter(path).count(text.to_pylist()))], names=["doc_id", "n_bytes", "n_tokens"])

    return count


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``)."""
    small_batches(docs.sparkSession)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count(path), COUNTED)
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
