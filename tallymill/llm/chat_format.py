"""Operator 11: chat formatting, with layouts told by schema fingerprints.

1. ``canonical``: a record (a struct, or JSON text) has nested field paths, such as ``messages[].content``. Those that any mapping names, sorted and hashed, are the record's
   fingerprint. A mapping is chosen once for a fingerprint and remembered: the one all of whose needed paths are there, of several the one that needs
   most, then the first in ``MAPPINGS``. A mapping says declaratively which paths give roles and texts; records of all layouts become turns (conv_id, turn, step, role, text,
   layout, fingerprint). ``layouts`` counts records by fingerprint, so that those without mapping are seen; they give no turns.
2. ``write``: turns are put in order by ranges and written as chunks of marked-up text with the spans of the loss mask. A chunk holds whole turns
   of one conversation, up to ``CHUNK`` characters or one turn; most conversations are one chunk.
3. ``parse`` and ``digests`` read chunks back: turns are found by their marks, escapes are undone.

The template marks a turn as ``### Role: text</turn>`` and a line break. In texts and roles ``\\`` becomes ``\\\\``, ``##`` is parted as ``#\\#`` and ``</`` as ``<\\/``,
so neither mark can stand in a text; undoing drops a backslash and keeps what follows it. Roles other than system, user and assistant are written behind ``~``, with ``:`` as ``\\:``.

Order: by conversation, turn (null first), step within a record, role, hash of the text, text; rows alike in all are equal turns. Null texts and roles are empty. Rows with a null conv_id are one conversation, whose id
is null. Records that are null, no objects, no JSON, or of no known layout give no turns. A text that a mapping finds but that is no string is given as JSON. An empty table gives no rows; extra columns and extra fields are left out, whatever their names.

Scale: the order is a range shuffle over conversation, turn and a spread of equal rows, so a conversation of any size is dealt over many tasks, and tasks stream. A task knows which conversations it holds whole; their digests
are made where they are read. Only chunks at the borders of ranges are shuffled, by conversation. SHA-256 of a whole conversation is sequential: ``digests`` streams the chunks of one that
crosses borders through one task, holding one chunk; ``write`` and ``parse`` never do.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import batches_of, materialise, runs, small_batches

#: Characters of a chunk, beyond which a new one begins.
CHUNK = 1 << 18


@dataclass(frozen=True)
class Turn:
    """One turn of a mapping. role and text are paths, or several paths whose texts are joined by an empty line; a role that starts with "=" is that word itself.

    each: the path of an array, one turn for each of its elements; role and text are then paths within an element. optional: no turn where the text is null or not there.
    """

    role: str
    text: str | tuple[str, ...]
    each: str = ""
    optional: bool = False


@dataclass(frozen=True)
class Mapping:
    """A layout: the paths that a record must have, its turns, and perhaps paths of the conversation's id and the turn's number."""

    name: str
    needs: tuple[str, ...]
    turns: tuple[Turn, ...]
    conversation: str = ""
    turn: str = ""


MAPPINGS = (
    Mapping("turn rows", ("conv_id", "turn", "role", "text"), (Turn("role", "text"),), "conv_id", "turn"),
    Mapping("messages in parts", ("messages[].role", "messages[].content[].text"), (Turn("=system", "system", optional=True), Turn("role", ("content[].text", "content[]:string", "content:string"), "messages"))),
    Mapping("messages", ("messages[].role", "messages[].content"), (Turn("=system", "system", optional=True), Turn("role", "content", "messages"))),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), (Turn("=system", "system", optional=True), Turn("from", "value", "conversations"))),
    Mapping("instruction, input, output", ("instruction", "input", "output"), (Turn("=system", "system", optional=True), Turn("=user", ("instruction", "input")), Turn("=assistant", "output"))),
    Mapping("instruction, output", ("instruction", "output"), (Turn("=system", "system", optional=True), Turn("=user", "instruction"), Turn("=assistant", "output"))),
    Mapping("instruction, response", ("instruction", "response"), (Turn("=system", "system", optional=True), Turn("=user", ("instruction", "context")), Turn("=assistant", "response"))),
    Mapping("prompt, completion", ("prompt", "completion"), (Turn("=system", "system", optional=True), Turn("=user", "prompt"), Turn("=assistant", "completion"))),
    Mapping("prompt, response", ("prompt", "response"), (Turn("=system", "system", optional=True), Turn("=user", "prompt"), Turn("=assistant", "response"))),
    Mapping("prompt, chosen", ("prompt", "chosen"), (Turn("=system", "system", optional=True), Turn("=user", "prompt"), Turn("=assistant", "chosen"))),
    Mapping("question, answer", ("question", "answer"), (Turn("=system", "system", optional=True), Turn("=user", ("context", "question")), Turn("=assistant", "answer"))),
)
#: Names that layouts give to roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TURNS = "conv_id long, turn long, step long, role string, text string, layout string, fingerprint string"


def field_paths(value, path: str = "") -> Iterator[str]:
    """The nested field paths of a value, those inside of it too, an array's places told as one."""
    todo = [(value, path)]
    while todo:
        value, path = todo.pop()
        yield path
        if isinstance(value, dict):
            todo += [(v, f"{path}.{k}" if path else str(k)) for k, v in value.items()]
        elif isinstance(value, list):
            todo += [(v, f"{path}[]") for v in value]


def values_at(value, path: str) -> list:
    """All values at a path, in the record's order; nulls and what isn't there are left out, and what is no string if the path ends with ":string"."""
    found = [value]
    path, _, kind = path.partition(":")
    for name in path.split("."):
        depth = (len(name) - len(name.rstrip("[]"))) // 2
        found = [v[name.rstrip("[]")] for v in found if isinstance(v, dict) and name.rstrip("[]") in v]
        for _ in range(depth):
            found = [x for v in found if isinstance(v, list) for x in v]
    return [v for v in found if (isinstance(v, str) if kind else v is not None)]


def told(value) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True, default=str)


def text_at(value, paths: str | tuple[str, ...]) -> str | None:
    found = [told(v) for p in ([paths] if isinstance(paths, str) else paths) for v in values_at(value, p)]
    return "\n\n".join(x for x in found if x) if found else None


class Layouts:
    """Chooses mappings by fingerprint, each fingerprint once."""

    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS):
        self.mappings = mappings
        self.named = {p for m in mappings for p in m.needs}
        self.chosen: dict[str, Mapping | None] = {}

    def fingerprint(self, record) -> str:
        known = sorted(set(field_paths(record)) & self.named)
        code = hashlib.sha256("\n".join(known).encode()).hexdigest()[:16]
        if code not in self.chosen:
            fits = [m for m in self.mappings if set(m.needs) <= set(known)]
            self.chosen[code] = max(fits, key=lambda m: len(m.needs), default=None)
        return code

    def turns(self, record) -> tuple[str, Mapping | None, list[tuple[str, str]]]:
        code = self.fingerprint(record)
        mapping = self.chosen[code]
        out = []
        for turn in mapping.turns if mapping else ():
            for part in values_at(record, f"{turn.each}[]") if turn.each else [record]:
                text = text_at(part, turn.text)
                if text is None and turn.optional:
                    continue
                role = turn.role[1:] if turn.role[0] == "=" else text_at(part, turn.role) or ""
                out.append((ROLES.get(role, role) if turn.each else role, text or ""))
        return code, mapping, out


def _whole(value) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63 else None


def _records(column: pa.Array, as_json: bool) -> Iterator:
    for value in column:
        value = value.as_py()
        if as_json and value is not None:
            try:
                value = json.loads(value)
            except (ValueError, RecursionError):
                value = None
        yield value


def _canonical(mappings, as_json: bool, with_turns: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layouts = Layouts(mappings)
        for batch in batches:
            rows = []
            for own, record in zip(batch.column("id").to_pylist(), _records(batch.column("record"), as_json), strict=True):
                code, mapping, turns = layouts.turns(record)
                name = mapping.name if mapping else None
                if not with_turns:
                    rows.append((code, name))
                    continue
                conversation, number = ((values_at(record, p) or [None])[0] if mapping and p else None for p in (mapping and mapping.conversation, mapping and mapping.turn))
                conversation = _whole(conversation) if mapping and mapping.conversation else own
                rows += [(conversation, _whole(number), i, role, text, name, code) for i, (role, text) in enumerate(turns)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()) if with_turns else (pa.string(), pa.string())
            names = ("conv_id", "turn", "step", "role", "text", "layout", "fingerprint") if with_turns else ("fingerprint", "layout")
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))

    return run


def _given(records: DataFrame, record: Column, own: Column) -> tuple[DataFrame, bool]:
    small_batches(records.sparkSession)
    given = records.select(own.cast("long").alias("id"), record.alias("record"))
    return given, isinstance(given.schema["record"].dataType, T.StringType)


def canonical(records: DataFrame, record: Column, own: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Turns of records of any known layout. record: a struct or JSON text; own: the id of a record that is a whole conversation."""
    given, as_json = _given(records, record, own)
    return given.mapInArrow(_canonical(mappings, as_json, True), TURNS)


def layouts(records: DataFrame, record: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """fingerprint, layout (null: none known), records."""
    given, as_json = _given(records, record, F.lit(None))
    return given.mapInArrow(_canonical(mappings, as_json, False), "fingerprint string, layout string").groupBy("fingerprint", "layout").agg(F.count(F.lit(1)).alias("records"))


#: How the template names roles.
NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
_ROLES = {v: k for k, v in NAMES.items()}
END = "</turn>\n"
_ESCAPED = re.compile(r"\\|#(?=#)|<(?=/)")
_UNDO = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### (~?)((?:[^\\:]|\\.)*): (.*?)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNDO.sub(r"\1", text)


def marked(role: str, text: str) -> tuple[str, int, int]:
    """A turn's text in the template, and where the escaped text lies in it."""
    name = NAMES.get(role)
    head = f"### {name}: " if name else f"### ~{escape(role).replace(':', chr(92) + ':')}: "
    body = escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def unmarked(text: str) -> Iterator[tuple[str, str]]:
    """The turns (role, text) of a chunk; a chunk that isn't one is an error."""
    at = 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            break
        at = m.end()
        yield unescape(m[2]) if m[1] else _ROLES[m[2]], unescape(m[3])
    if at != len(text):
        raise ValueError(f"no turn begins at character {at}")


_CHUNKS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("chunk", pa.int64()), ("whole", pa.bool_()), ("n_turns", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])
CHUNKS = "conv_id long, part int, chunk long, whole boolean, n_turns long, text string, loss array<struct<start: long, stop: long>>"


def _chunks(learned: frozenset[str], most: int):
    """Chunks from turns in order. One is held back until the next conversation, or the partition's end, shows whether it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, number, first = None, None, 0, True  # first: the conversation at hand is the partition's first, so it may have begun before
        texts, spans, size = [], [], 0

        def out(whole: bool) -> pa.RecordBatch:
            values = (conv, part, number, whole, len(texts), "".join(texts), spans)
            return pa.record_batch([pa.array([v], f.type) for v, f in zip(values, _CHUNKS, strict=True)], schema=_CHUNKS)

        for batch in batches:
            for own, at, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "role", "text")), strict=True):
                if texts and own != conv:
                    yield out(not first and number == 0)
                    texts, spans, size, number, first = [], [], 0, 0, False
                elif size >= most:
                    yield out(False)
                    texts, spans, size, number = [], [], 0, number + 1
                part, conv = at, own
                turn, start, stop = marked(role, text)
                if role in learned:
                    spans.append({"start": size + start, "stop": size + stop})
                texts.append(turn)
                size += len(turn)
        if texts:
            yield out(False)

    return run


def write(turns: DataFrame, learned: tuple[str, ...] = ("assistant",), most: int = CHUNK) -> DataFrame:
    """The formatted conversations as a written table: conv_id, part and chunk (their order), whole (the chunk is all of its conversation), n_turns, text, loss (spans of the texts of ``learned`` roles, in characters)."""
    small_batches(turns.sparkSession)
    filled = turns.select("conv_id", "turn", "step", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # the last column spreads equal rows; the order of such rows doesn't matter
    keyed = materialise(filled.withColumns({"hash": F.xxhash64("text"), "spread": F.xxhash64(F.monotonically_increasing_id())}), "turns")
    order = ["conv_id", "turn", "step", "role", "hash"]
    ranged = keyed.repartitionByRange(*order, "spread").sortWithinPartitions(*order, "text").select("conv_id", F.spark_partition_id().alias("part"), "role", "text")
    return materialise(ranged.mapInArrow(_chunks(frozenset(learned), most), CHUNKS), "chat")


def parse(chunks: DataFrame) -> DataFrame:
    """The turns of formatted conversations, read back: conv_id, part, chunk, place (in the chunk), role, text, learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stops, at = {s["stop"] for s in row["loss"]}, 0
                rows = []
                for i, (role, text) in enumerate(unmarked(row["text"])):
                    turn, _, stop = marked(role, text)
                    rows.append((row["conv_id"], row["part"], row["chunk"], i, role, text, at + stop in stops))
                    at += len(turn)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "part", "chunk", "place", "role", "text", "learned"])

    return chunks.mapInArrow(run, "conv_id long, part int, chunk long, place long, role string, text string, learned boolean")


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation, from chunks in order."""
    done: list[tuple] = []
    conv, held = None, None

    def out() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _DIGESTS, strict=True)], schema=_DIGESTS)
        done.clear()
        return batch

    def close():
        n, turns, chars, loss, formatted = held
        done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted))

    for batch in batches:
        for row in batch.to_pylist():
            if held is None or row["conv_id"] != conv:
                if held is not None:
                    close()
                conv, held = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            text = row["text"]
            for role, said in unmarked(text):
                held[0] += 1
                for x in (role, "\n", said, "\n"):
                    held[1].update(x.encode())
            for span in row["loss"]:
                said = unescape(text[span["start"] : span["stop"]])
                held[2] += len(said)
                held[3].update(said.encode())
            held[4] += len(text)
        if len(done) >= 512:
            yield out()
    if held is not None:
        close()
    if done:
        yield out()


def digests(chunks: DataFrame) -> DataFrame:
    """Per conversation, read back from its chunks: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    with batches_of(chunks.sparkSession, 32):  # a row holds a chunk
        alone = chunks.where("whole").select("conv_id", "text", "loss").mapInArrow(_digest, DIGESTS)
        parted = chunks.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk").select("conv_id", "text", "loss")
        return materialise(alone.union(parted.mapInArrow(_digest, DIGESTS)), "digests")


#: A conversation that tries the template's marks and escapes.
TRIAL = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def format_conversations(rows: DataFrame) -> DataFrame:
    """``digests`` of conversations given as rows by turn (conv_id, turn, role, text), and of ``TRIAL``."""
    given = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    given = given.union(rows.sparkSession.createDataFrame(TRIAL, given.schema))
    return digests(write(canonical(given, F.struct("conv_id", "turn", "role", "text"), F.col("conv_id"))))


ORACLE_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
lengths AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</', ''))) // 2
      + length(text) - length(replace(text, '#', '')) - len(regexp_extract_all(text, '#+')) AS escaped,
    length('### ') + length(role) + length(': ') + length('</turn>') + 1 AS marks
  FROM given)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(escaped + marks) AS BIGINT) AS formatted_chars
FROM lengths GROUP BY conv_id
"""
