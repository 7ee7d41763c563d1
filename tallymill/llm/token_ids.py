"""Token ids of whole texts by a tokenizers-library file whose pieces never span white space."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

#: Words that a worker remembers, and as a share of that, pieces of words; when more are met, it forgets them and starts again.
REMEMBERED = 320_000
PIECES_SHARE = 0.5
#: Characters that are worked on at once; longer texts are cut at spaces.
AT_ONCE = 4 << 20
#: Texts without these may be put in lower case and parted into pieces here: no composition, context or added token is in sight.
_NOT_PLAIN = re.compile("[^\x00-ɏ]|<\\|")
#: How the tokenizer file parts words: runs of letters, single digits, six endings, runs of anything else; for plain texts.
_PIECES = re.compile(r"[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|'(?:s|t|re|ve|m|ll|d)|(?:[^\w\s]|_)+")


def _is_plain(text: str) -> bool:
    if text.isascii():
        return "<|" not in text
    try:
        text.encode("latin-1")  # much faster than looking for the rare character
    except UnicodeEncodeError:
        return not _NOT_PLAIN.search(text)
    return "<|" not in text


def _has_odd_space(text: str) -> bool:
    """str.split() parts at these, which the tokenizer doesn't hold for white space."""
    return "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text


def _parts(text: str, most: int = AT_ONCE // 4) -> list[str]:
    """A text cut at spaces into parts of some ``most`` characters (a longer word stays whole)."""
    if len(text) <= most:
        return [text]
    out, at = [], 0
    while at < len(text):
        stop = text.find(" ", at + most)
        stop = len(text) if stop < 0 else stop
        out.append(text[at:stop])
        at = stop
    return out


class _Numbers(dict):
    """Numbers words in the order they are first asked for; ``new`` gets those that are asked for anew."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        return at


class _Runs:
    """Runs of ids by number."""

    def __init__(self):
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.used = self.count = 0

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.start) < self.count + len(lengths):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.flat[self.used : self.used + len(ids)] = ids
        here = slice(self.count, self.count + len(lengths))
        self.length[here] = lengths
        self.start[here] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.count += len(lengths)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the runs ``at``, end to end, and the bounds of each."""
        lengths = self.length[at]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        return self.flat[np.repeat(self.start[at] - upto[:-1], lengths) + np.arange(upto[-1])], upto


# What a tokenizer file says of normalising and splitting if its texts may be taken word by word.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


def _splits_at_space(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    splits = told.get("pre_tokenizer") or {}
    first = (splits.get("pretokenizers") or [{}])[0]
    model = told["model"]
    return (
        told.get("normalizer") == NORMALIZER
        and first == SPLIT
        and [x.get("add_prefix_space") for x in splits["pretokenizers"][1:]] == [False]
        and model["type"] == "BPE"
        and model.get("end_of_word_suffix") == "</w>"
        and not model.get("dropout")
        and not any(re.search(r"\s", t["content"]) or t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"].startswith("<|") for t in told.get("added_tokens", ()))
    )


class WordEncoder:
    """Encodes texts as the library does, but each distinct word, and piece of a word, once.

    It is exact for tokenizers that drop white space before anything else is looked at, as
    word_bpe_49k does: none of its tokens, added tokens included, holds white space, and no normaliser looks
    beyond it. Plain words are put in lower case and parted as the tokenizer file parts them; others, with combining marks,
    added tokens or letters whose case has a context, go to the library as they are. For a file of any other kind, which ``_splits_at_space``
    tells, whole texts go to the library.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.by_words = _splits_at_space(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.remembered = remembered
        vocabulary = self.library.get_vocab(True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a piece
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words, self.word_runs = _Numbers(), _Runs()
        self.pieces, self.piece_runs = _Numbers(), _Runs()

    def _learn_pieces(self, new: list[str], plain: bool, step: int = 256) -> None:
        """Plain pieces are encoded many at once; which ids are whose shows in the tokens that end a piece."""
        for k in range(0, len(new), step):
            some = new[k : k + step]
            if plain or not any(map(_NOT_PLAIN.search, some)):
                ids = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
                ends = np.flatnonzero(self.closes[ids]) + 1
                if len(ends) == len(some) and ends[-1] == len(ids):
                    self.piece_runs.add(ids, np.diff(ends, prepend=0))
                    continue
            found = [e.ids for e in self.library.encode_batch_fast(some, add_special_tokens=False)]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            self.piece_runs.add(np.fromiter((i for x in found for i in x), np.uint32, int(lengths.sum())), lengths)

    def _learn(self, words: list[str], plain: bool) -> None:
        parts = list(map(_PIECES.findall, words)) if plain else [[w] if _NOT_PLAIN.search(w) or _has_odd_space(w) else _PIECES.findall(w.lower()) for w in words]
        at = np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(parts)), np.int64)
        new, self.pieces.new = self.pieces.new, []
        self._learn_pieces(new, plain)
        ids, upto = self.piece_runs.take(at)
        bounds = upto[np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])]
        self.word_runs.add(ids, np.diff(bounds))

    def encode(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order as uint32, and how many each text has (null: as an empty text); ``end`` is appended to each."""
        parts: list[str] = []
        last: list[int] = []  # the last part of each text
        for text in texts:
            parts += _parts(text or "") if self.by_words else [text or ""]
            last.append(len(parts) - 1)
        ids, sizes, at = [np.zeros(0, np.uint32)], [], 0
        while at < len(parts):
            stop, held = at, 0
            while stop < len(parts) and (stop == at or held + len(parts[stop]) <= AT_ONCE):
                held += len(parts[stop])
                stop += 1
            own, n = (self._words if self.by_words else self._whole)(parts[at:stop])
            ids.append(own)
            sizes.append(n)
            at = stop
        ids = np.concatenate(ids)
        upto = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
        bounds = np.concatenate([[0], upto[np.array(last, np.int64) + 1]])
        sizes = np.diff(bounds)
        if end is not None:
            ids = np.insert(ids, bounds[1:], np.uint32(end))
            sizes = sizes + 1
        return ids, sizes

    def _whole(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.library.encode_batch_fast(parts, add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum())), n

    def _words(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > self.remembered:
            self.words, self.word_runs = _Numbers(), _Runs()
        if len(self.pieces) > PIECES_SHARE * self.remembered:
            self.pieces, self.piece_runs = _Numbers(), _Runs()
        counts = np.zeros(len(parts), np.int64)
        places: list[np.ndarray] = [np.zeros(0, np.int64)]
        plain = True
        for i, text in enumerate(parts):
            if _has_odd_space(text):
                words, plain = [text], False
            elif _is_plain(text):
                words = text.lower().split()
            else:
                words, plain = text.split(), False
            counts[i] = len(words)
            places.append(np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)))
        if self.words.new:
            new, self.words.new = self.words.new, []
            self._learn(new, plain)
        ids, upto = self.word_runs.take(np.concatenate(places))
        return ids, np.diff(upto[np.concatenate([[0], np.cumsum(counts)])])


@lru_cache(maxsize=1)
def encoder(path: str, remembered: int = REMEMBERED) -> WordEncoder:
    """One encoder for each Python worker."""
    return WordEncoder(path, remembered)
