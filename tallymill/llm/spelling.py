"""Operator 13: spelling variants, by Levenshtein automata of distance one on shards of a compact trie.

1. ``count_words``: maximal runs of letters a-z, A-Z and U+00C0 to U+00FF of whole texts, A-Z in lower case, each document's distinct runs once. A run whose crc32 with its document's id is a multiple of
   ``TYPO`` loses one code point. Tasks add up what they have read, ``HELD`` words at a time, before the shuffle by word.
2. Words with enough code points and occurrences are ranked in code-point order and cut into shards of ``SHARD`` units (a word is 8 and its
   length). A shard's trie has labels of any length on its edges, so it has less than two nodes a word; it is written as flat arrays to a file of the shared folder.
3. Every shard's words go through every shard's trie, depth-first: a stack holds blocks of automaton states (word, place in it, node, whether its one error is spent), and the
   block put there last goes on first. An error is made only where word and trie first differ, which reaches each neighbour on exactly one way. A task reads one shard's words and up to ``ASKED`` tries, one at a time.
4. For each word the number of neighbours is added up, and the best form, the neighbour of largest n (ties: first in code-point order), is reduced over shards. A form must be ``RATIO`` times as frequent as its word, so chains of forms
   are short; roots are found by jumping along them, twice as far each round.

All shards together grow with the vocabulary, so they are never broadcast whole nor held: a task gets one at a time from the shared folder. What a task holds is bounded by two shards; the list of shards (one path for some 65,000 words)
goes through the driver. Tries that begin with other letters turn a word back after one or two states.

Cases: null and empty texts have no words; a null doc_id is hashed as "". Rows with equal ids count each. A word of any length is a word: long labels are compared as a whole. An empty table gives no rows.
Extra columns are left out. A repeated task writes a file of its own; no one is told of an unfinished one.
"""

from __future__ import annotations

import io
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_output import file_system
from .mixing import in_ranges
from .shared import batches_of, materialise, runs, shared_dir, slices, small_batches

TYPO = 97
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: Distinct words that a task adds up before it passes them on, and code points that they may have.
HELD, HELD_CHARS = 200_000, 8 << 20
SHARD = 1 << 20
#: Tries that a task asks about the words that it has read.
ASKED = 8
#: States of a block that are expanded together.
STATES = 4096
#: Code points that are compared one by one; what is still equal after so many is compared as a whole.
SHORT = 24
_RUN = re.compile("[a-zÀ-ÿ]+")


def words_of(doc_id: int | None, text: str) -> Iterator[tuple[str, int]]:
    """The words of a text with at least ``LEAST_LENGTH`` code points, and how often they occur."""
    text = text.encode("utf-8", "replace").lower().decode()  # lower() of bytes changes A-Z alone
    begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    found = Counter(_RUN.findall(text)) if len(text) < 1 << 20 else Counter(m[0] for m in _RUN.finditer(text))
    for word, n in found.items():
        if len(word) >= LEAST_LENGTH:
            h = zlib.crc32(word.encode(), begun)
            if h % TYPO == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
                if len(word) < LEAST_LENGTH:
                    continue
            yield word, n


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, int] = {}
    chars = 0

    def out() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return batch

    for batch in slices(batches, 256, "text"):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for word, n in words_of(doc_id, text or ""):
                if word in held:
                    held[word] += n
                    continue
                held[word] = n
                chars += len(word)
                if len(held) >= HELD or chars >= HELD_CHARS:
                    yield out()
                    chars = 0
    if held:
        yield out()


def count_words(docs: DataFrame) -> DataFrame:
    """word, n: words that are long and frequent enough."""
    small_batches(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    return given.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def common(a: bytes, b: bytes) -> int:
    """How many code points two words begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # alike up to low, not up to high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


class Trie:
    """Distinct words in order, as flat arrays. Code points are below 256, so a word is bytes.

    text, ends: the words end to end; n: their counts. Of a node: label_at and label_end (in text), word (-1: none ends there), and its
    children's places first_child .. first_child of the next node, in the order of their labels' first code points. Nodes are numbered so that children follow each other; 0 is the root.
    """

    FIELDS = ("text", "ends", "n", "label_at", "label_end", "word", "first_child")

    def __init__(self, **arrays: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, arrays[name])
        self.starts = self.ends - np.diff(self.ends, prepend=0)

    @classmethod
    def of(cls, words: list[bytes], n: np.ndarray) -> Trie:
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        up, depth, some, word = [-1], [0], [0], [-1]  # some: a word that goes through the node
        path = [0]
        for i, w in enumerate(words):
            alike = common(words[i - 1], w) if i else 0
            last = -1
            while depth[path[-1]] > alike:
                last = path.pop()
            if depth[path[-1]] < alike:  # a label is parted
                up.append(path[-1])
                depth.append(alike)
                some.append(i)
                word.append(-1)
                up[last] = len(up) - 1
                path.append(up[last])
            up.append(path[-1])
            depth.append(len(w))
            some.append(i)
            word.append(i)
            path.append(len(up) - 1)
        up, depth, some, word = (np.array(x, np.int64) for x in (up, depth, some, word))
        text = np.frombuffer(b"".join(words), np.uint8)
        start = (ends - np.diff(ends, prepend=0))[some]
        # breadth-first numbers: by depth of the tree, then parent, then first code point
        level = np.zeros(len(up), np.int64)
        for node in np.argsort(depth, kind="stable")[1:].tolist():  # a parent is less deep than its children
            level[node] = level[up[node]] + 1
        first = np.where(up >= 0, text[np.minimum(start + depth[np.maximum(up, 0)], len(text) - 1)], 0)
        number = np.zeros(len(up), np.int64)
        order = [np.zeros(1, np.int64)]
        at = 1
        by_level = np.argsort(level, kind="stable")
        bounds = np.searchsorted(level[by_level], np.arange(level.max() + 2))
        for k in range(1, level.max() + 1):
            nodes = by_level[bounds[k] : bounds[k + 1]]
            nodes = nodes[np.lexsort((first[nodes], number[up[nodes]]))]
            number[nodes] = np.arange(at, at + len(nodes))
            at += len(nodes)
            order.append(nodes)
        order = np.concatenate(order)
        children = np.bincount(number[up[1:]], minlength=len(up))
        first_child = 1 + np.concatenate([[0], np.cumsum(children)])
        above = np.maximum(up[order], 0)
        return cls(text=text, ends=ends, n=n, label_at=start[order] + np.where(up[order] >= 0, depth[above], 0), label_end=start[order] + depth[order], word=word[order], first_child=first_child)

    def data(self) -> bytes:
        sink = io.BytesIO()
        np.savez(sink, **{name: getattr(self, name) for name in self.FIELDS})
        return sink.getvalue()

    @classmethod
    def read(cls, data: bytes) -> Trie:
        with np.load(io.BytesIO(data), allow_pickle=False) as arrays:
            return cls(**arrays)


def _alike(x: np.ndarray, x_at: np.ndarray, x_end: np.ndarray, y: np.ndarray, y_at: np.ndarray, y_end: np.ndarray) -> np.ndarray:
    """How many code points x from x_at to x_end and y from y_at to y_end begin with alike."""
    most = np.minimum(x_end - x_at, y_end - y_at)
    found = np.zeros(len(most), np.int64)
    at = np.flatnonzero(most > 0)
    for k in range(SHORT):
        if not len(at):
            return found
        at = at[x[x_at[at] + k] == y[y_at[at] + k]]
        found[at] += 1
        at = at[most[at] > k + 1]
    for i in at.tolist():
        differ = x[x_at[i] + SHORT : x_at[i] + most[i]] != y[y_at[i] + SHORT : y_at[i] + most[i]]
        where = int(differ.argmax())
        found[i] = SHORT + where if differ[where] else most[i]
    return found


def neighbours(asking: Trie, trie: Trie) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (word of ``asking``, word of ``trie``) that differ by exactly one inserted, deleted or replaced code point, each once."""
    q, t, ends = asking.text, trie.text, asking.ends
    children = np.diff(trie.first_child)
    left, right = [], []
    # states: word, place in the text of all words, node; whether the error is spent is told by the stack's entry
    stack = [(False, np.arange(a, min(a + STATES, len(ends))), asking.starts[a : a + STATES], np.zeros(min(STATES, len(ends) - a), np.int64)) for a in range(0, len(ends), STATES)]
    while stack:
        spent, word, at, node = stack.pop()
        if len(word) > STATES:
            stack.append((spent, word[STATES:], at[STATES:], node[STATES:]))
            word, at, node = word[:STATES], at[:STATES], node[:STATES]
        over = np.flatnonzero((ends[word] - at == (0 if spent else 1)) & (trie.word[node] >= 0))  # without an error so far the last code point is the one too many
        left.append(word[over])
        right.append(trie.word[node[over]])
        if spent:
            go = np.flatnonzero((at < ends[word]) & (children[node] > 0))
            word, at, node = word[go], at[go], node[go]
            low, high = trie.first_child[node], trie.first_child[node + 1]
            want = q[at]
            while True:  # the first child whose label begins with ``want`` or more
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                less = t[trie.label_at[mid]] < want[open_]
                low[open_[less]] = mid[less] + 1
                high[open_[~less]] = mid[~less]
            got = np.flatnonzero(low < trie.first_child[node + 1])
            got = got[t[trie.label_at[low[got]]] == want[got]]
            word, at, child = word[got], at[got], low[got]
            tries = [(word, at, child, trie.label_at[child])]
        else:
            each = children[node]
            word, at = np.repeat(word, each), np.repeat(at, each)
            child = np.repeat(trie.first_child[node] - (np.cumsum(each) - each), each) + np.arange(len(word))
            end, label, label_end = ends[word], trie.label_at[child], trie.label_end[child]
            alike = _alike(q, at, end, t, label, label_end)
            whole = label + alike == label_end
            go = np.flatnonzero(whole)
            if len(go):
                stack.append((False, word[go], at[go] + alike[go], child[go]))
            go = np.flatnonzero(~whole)
            word, at, child, label, end = word[go], at[go] + alike[go], child[go], label[go] + alike[go], end[go]
            more = np.flatnonzero(at < end)
            replaced = (word[more], at[more] + 1, child[more], label[more] + 1)
            inserted = (word, at, child, label + 1)
            more = more[(at[more] + 1 < end[more]) & (q[np.minimum(at[more] + 1, len(q) - 1)] == t[label[more]])]
            deleted = (word[more], at[more] + 1, child[more], label[more])
            tries = [replaced, inserted, deleted]
        word, at, child, label = (np.concatenate(c) for c in zip(*tries, strict=True))
        if len(word):
            rest = trie.label_end[child] - label
            go = np.flatnonzero(_alike(q, at, ends[word], t, label, trie.label_end[child]) == rest)
            if len(go):
                stack.append((True, word[go], at[go] + rest[go], child[go]))
    return np.concatenate(left) if left else np.zeros(0, np.int64), np.concatenate(right) if right else np.zeros(0, np.int64)


def _build(folder: str):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = file_system(folder)
        for t in runs(batches, ("shard",)):
            path = f"{base}/{uuid.uuid4().hex}.npz"
            files.create_dir(base, recursive=True)
            words = [w.encode("latin-1") for w in t.column("word").to_pylist()]
            with files.open_output_stream(path) as sink:
                sink.write(Trie.of(words, t.column("n").to_numpy()).data())
            yield pa.record_batch([pa.array([path]), pa.array([t.num_rows], pa.int64())], names=["path", "words"])

    return build


def _ask(folder: str, paths: list[str]):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = file_system(folder)

        def trie_at(path: str) -> Trie:
            with files.open_input_stream(path) as source:
                return Trie.read(source.read())

        for batch in batches:
            for row in batch.to_pylist():
                asking = trie_at(row["path"])
                spelled = lambda trie, i: trie.text[trie.starts[i] : trie.ends[i]].tobytes().decode("latin-1")
                for path in paths[row["group"] * ASKED : (row["group"] + 1) * ASKED]:
                    trie = asking if path == row["path"] else trie_at(path)
                    left, right = neighbours(asking, trie)
                    order = np.lexsort((right, -trie.n[right], left))
                    left, right = left[order], right[order]
                    own, first, count = np.unique(left, return_index=True, return_counts=True)
                    best = right[first]
                    yield pa.record_batch([pa.array([spelled(asking, i) for i in own], pa.string()), pa.array(count.astype(np.int64)), pa.array(trie.n[best]), pa.array([spelled(trie, i) for i in best], pa.string())], names=["word", "n_near", "best_n", "best"])

    return ask


def near_words(vocabulary: DataFrame, shard: int = SHARD) -> DataFrame:
    """Of a written vocabulary (word, n): word, n_near, best_n and best, for words that have neighbours."""
    spark = vocabulary.sparkSession
    ranked = in_ranges(vocabulary.select("word", "n"), [F.col("word")], "ranked", (F.length("word") + 8).cast("long").alias("upto"))
    dealt = ranked.select(F.floor((F.col("upto") - F.length("word") - 8) / shard).alias("shard"), "word", "n").repartition("shard").sortWithinPartitions("shard", "word")
    folder = f"{shared_dir(spark)}/tries-{uuid.uuid4().hex}"
    tries = materialise(dealt.mapInArrow(_build(folder), "path string, words long"), "tries")
    paths = sorted(r["path"] for r in tries.select("path").collect())
    groups = -(-len(paths) // ASKED)
    asked = tries.select("path", F.explode(F.sequence(F.lit(0), F.lit(max(0, groups - 1)))).alias("group"))
    with batches_of(spark, 1):
        found = asked.repartition(max(1, len(paths) * groups)).mapInArrow(_ask(folder, paths), "word string, n_near long, best_n long, best string")
        best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
        return materialise(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best")), "near")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last form that is reached from each word of ``forms`` (word, form); chains end."""
    found = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = materialise(found.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "roots")
        if found.where("went").isEmpty():
            return found.select("word", "root")
        found = found.select("word", "root")


def variants(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    vocabulary = materialise(count_words(docs), "vocabulary")
    near = near_words(vocabulary, shard)
    is_form = F.col("best_n") >= RATIO * F.col("n")
    joined = vocabulary.join(near, "word", "left")
    joined = materialise(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    return joined.join(roots(joined.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
