"""Transcript parsing: a hidden Markov model finds who speaks in each line, then turns are rendered alike.

A transcript comes in rows (conv_id, turn, text): parts of it in order, of one or more lines each. States are a role
that begins a turn or goes on with one. Features of a line: the role its speaker marker names, if it has one; whether
a gap (a new part or an empty line) precedes it; its length; its last character. Their probabilities in each state,
and those of transitions, are counted in rows whose role is known, TRAIN_ROWS in expectation, by a hash of conv_id.
Viterbi finds the likeliest states of all lines of a conversation; lines of one turn are joined, the marker is
dropped, and the turn is rendered.

A conversation is decoded in blocks of BLOCK turn numbers, and of LINES lines at most, by tasks that hold one block
at a time. First each block gives the best log probability of its last state for every state before it (a max-plus
matrix); a pass over a conversation's matrices fixes the states at all borders; then blocks are decoded between these,
and turns that cross borders are put together. So the states are those of Viterbi over the whole conversation.

Defined cases: a null text is an empty line; rows of equal turn come in the order of their texts; a null turn comes
first, in a block of its own; rows with a null conv_id are one conversation; without known roles the model is uniform but for
markers; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.llm.shared import cut

ROLES = ("system", "user", "assistant")
#: Speaker markers by role.
MARKERS = {
    "system": ("system", "instructions"),
    "user": ("user", "human", "customer", "q", "me"),
    "assistant": ("assistant", "bot", "ai", "agent", "a"),
}
TRAIN_ROWS, BLOCK, LINES, SMOOTH = 50_000, 256, 4096, 0.5
_ROLE_OF = {m: r for r, names in MARKERS.items() for m in names}
_MARKER = re.compile(r"^\s*[\[<(*]*(" + "|".join(sorted(_ROLE_OF, key=len, reverse=True)) + r")[\])>*]*\s*[:>]\s*", re.I | re.A)
STATES = [(r, s) for r in range(len(ROLES)) for s in (0, 1)]  # 0: begins a turn, 1: goes on
#: Values of each feature: marker (none or a role), gap, length class, last character class.
SIZES = (1 + len(ROLES), 2, 5, 4)
TURNS = "conv_id long, turn long, role string, lines long, score double, rendered string"
_TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("lines", pa.int64()), ("score", pa.float64()), ("rendered", pa.string())])


def line_features(line: str, gap: bool) -> tuple[int, int, int, int]:
    m = _MARKER.match(line)
    n = len(line)
    last = line.rstrip()[-1:]
    return (
        1 + ROLES.index(_ROLE_OF[m[1].lower()]) if m else 0,
        int(gap),
        0 if n < 40 else 1 if n < 120 else 2 if n < 300 else 3 if n < 800 else 4,
        0 if last == "?" else 1 if last == "." else 2 if last in (":", "!") else 3,
    )


def lines_of(rows: list[tuple]) -> list[tuple]:
    """(features, turn, line, role or None) of the lines of a conversation's rows (turn, text, role)."""
    out = []
    gap = True
    for turn, text, role in rows:
        gap = True
        for line in (text or "").split("\n"):
            if not line.strip() and "\n" in (text or ""):
                gap = True
                continue
            out.append((line_features(line, gap), turn, line, role))
            gap = False
    return out


class Model:
    """Log probabilities: of states at the start, of transitions, and of each feature's values in each state."""

    def __init__(self, counts: dict[tuple[str, int, int], float]):
        n = len(STATES)
        self.start, self.move = np.full(n, SMOOTH), np.full((n, n), SMOOTH)
        self.emit = [np.full((n, k), SMOOTH) for k in SIZES]
        for s, (r, _) in enumerate(STATES):  # what a marker says, before any count
            self.emit[0][s, 1 + r] += 20 * SMOOTH * (1 - STATES[s][1])
        for s, (r, goes_on) in enumerate(STATES):
            for t, (q, on) in enumerate(STATES):
                if on and q != r:
                    self.move[s, t] = 0.0  # a turn goes on in its own role only
            self.start[s] *= 1 - goes_on
        for (kind, a, b), c in counts.items():
            if kind == "start":
                self.start[a] += c
            elif kind == "move":
                self.move[a, b] += c
            else:
                self.emit[int(kind)][a, b] += c
        with np.errstate(divide="ignore"):
            self.start = np.log(self.start / self.start.sum())
            self.move = np.log(self.move / self.move.sum(1, keepdims=True))
            self.emit = [np.log(e / e.sum(1, keepdims=True)) for e in self.emit]

    def _seen(self, features: list[tuple[int, ...]]) -> np.ndarray:
        f = np.array(features)
        return sum(e[:, f[:, k]] for k, e in enumerate(self.emit)).T

    def best(self, features: list[tuple[int, ...]]) -> np.ndarray:
        """Best log probability of each last state (columns) from the start (row 0) and after each state (the others)."""
        seen = self._seen(features)
        v = np.vstack([self.start, self.move]) + seen[0]
        for x in seen[1:]:
            v = (v[:, :, None] + self.move).max(1) + x
        return v

    def decode(self, features: list[tuple[int, ...]], entry: int = -1, end: int = -1) -> tuple[list[int], float]:
        """The likeliest states after state entry and up to state end (-1: any), and their log probability a line."""
        f = np.array(features)
        seen = self._seen(features)
        back = np.zeros(seen.shape, np.int8)
        v = (self.start if entry < 0 else self.move[entry]) + seen[0]
        for i in range(1, len(f)):
            ways = v[:, None] + self.move
            back[i] = ways.argmax(0)
            v = ways.max(0) + seen[i]
        states = [int(v.argmax()) if end < 0 else end]
        for i in range(len(f) - 1, 0, -1):
            states.append(int(back[i][states[-1]]))
        return states[::-1], float(v.max()) / len(f)


def render(role: str, lines: list[str]) -> str:
    return f"<|{role}|>\n" + "\n".join(lines).strip() + "\n<|end|>\n"


def turns_of(lines: list[tuple], model: Model, entry: int, end: int) -> list[tuple]:
    """(goes on from the block before, turn, role, lines) of a block of lines between the states at its borders."""
    states, _ = model.decode([x[0] for x in lines], entry, end)
    out: list[tuple] = []
    for s, (_, turn, line, _) in zip(states, lines):
        role, goes_on = STATES[s]
        if not goes_on or not out:
            out.append((bool(goes_on), turn, role, [line if goes_on else _MARKER.sub("", line, count=1)]))
        else:
            out[-1][3].append(line)
    return out


def _borders(parts):
    """conv_id, block, text: the blocks' [sub, entry, exit, score, last] as JSON, of sorted (conv_id, block, sub, n, best)."""
    rows = (r for b in parts for r in zip(*(c.to_pylist() for c in b.columns)))
    for conv, group in itertools.groupby(rows, key=lambda r: r[0]):
        blocks = [(b, sub, n, np.frombuffer(m).reshape(len(STATES) + 1, len(STATES))) for _, b, sub, n, m in group]
        v, back = blocks[0][3][0], []
        for *_, m in blocks[1:]:
            ways = v[:, None] + m[1:]
            back.append(ways.argmax(0))
            v = ways.max(0)
        ends = [int(v.argmax())]
        for b in reversed(back):
            ends.append(int(b[ends[-1]]))
        ends.reverse()
        score = float(v.max()) / sum(x[2] for x in blocks)
        found: dict[int, list] = {}
        for i, (b, sub, *_) in enumerate(blocks):
            found.setdefault(b, []).append([sub, ends[i - 1] if i else -1, ends[i], score, i == len(blocks) - 1])
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv] * len(found), pa.int64()), "block": pa.array(found, pa.int64()), "text": pa.array([json.dumps(x) for x in found.values()], pa.string())})


def _blocks(parts):
    """(conv_id, block, number in it, borders, rows) of sorted rows (conv_id, block, turn, text, role, borders)."""
    key, rows, size, sub, borders = None, [], 0, 0, None
    for batch in parts:
        for conv, block, turn, text, role, is_border in zip(*(batch.column(i).to_pylist() for i in range(6))):
            n = (text or "").count("\n") + 1
            if rows and (key != (conv, block) or size + n > LINES):
                yield *key, sub, borders, rows
                rows, size, sub = [], 0, sub + 1
            if key != (conv, block):
                key, sub, borders = (conv, block), 0, None
            if is_border:
                borders = {x[0]: x[1:] for x in json.loads(text)}
                continue
            rows.append((turn, text, role))
            size += n
    if rows:
        yield *key, sub, borders, rows


_COUNTED = pa.schema([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("conv_id", pa.int64()), ("block", pa.int64()), ("sub", pa.int64())])
COUNTED = "kind string, a long, b long, n long, conv_id long, block long, sub long"


def _counts(counts: dict, borders: list[tuple] = []) -> pa.RecordBatch:
    rows = [(*k, n, None, None, None) for k, n in counts.items()] + [(text, None, None, None, *at) for text, *at in borders]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_COUNTED)], schema=_COUNTED)


def _count_part(parts):
    """Counts of all but blocks' first lines, and what is needed to count these: JSON in kind, with the block."""
    counts: dict[tuple[str, int, int], int] = {}
    for conv, block, sub, _, rows in _blocks(parts):
        lines = lines_of(rows)
        if not lines:
            continue
        states = [STATES.index((ROLES.index(y[3]), int(y[1] == x[1] and y[3] == x[3]))) for x, y in zip(lines, lines[1:])]
        for i, s in enumerate(states):
            for k in [("move", states[i - 1], s)] * (i > 0) + [(str(k), s, f) for k, f in enumerate(lines[i + 1][0])]:
                counts[k] = counts.get(k, 0) + 1
        yield _counts({}, [(json.dumps([lines[0][0], lines[0][1], lines[0][3], states[:1], states[-1:], lines[-1][1], lines[-1][3]]), conv, block, sub)])
    yield _counts(counts)


def _count_borders(parts):
    counts: dict[tuple[str, int, int], int] = {}
    conv_before, last = object(), None
    for batch in parts:
        for text, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            features, turn, role, second, end, turn_end, role_end = json.loads(text)
            if conv != conv_before:
                conv_before, last = conv, None
            s = STATES.index((ROLES.index(role), int(last is not None and last[1:] == (turn, role))))
            where = ("start", s, 0) if last is None else ("move", last[0], s)
            for k in [where, *(("move", s, x) for x in second), *((str(k), s, f) for k, f in enumerate(features))]:
                counts[k] = counts.get(k, 0) + 1
            last = (end[0] if end else s, turn_end, role_end)
    yield _counts(counts)


def _dealt(rows: DataFrame, borders: DataFrame | None = None) -> DataFrame:
    turn = F.col("turn").cast("long")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.floor(turn / BLOCK), F.lit(-(2**62))).alias("block"), turn.alias("turn"), F.col("text").cast("string").alias("text"), F.col("role").cast("string").alias("role"), F.lit(False).alias("border"))
    if borders is not None:
        nothing = F.lit(None).cast("string")
        rows = rows.unionByName(borders.select("conv_id", "block", nothing.cast("long").alias("turn"), "text", nothing.alias("role"), F.lit(True).alias("border")))
    return rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", F.desc("border"), "turn", "text")


def learn(rows: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """From rows(conv_id, turn, text, role) with a known role; what the driver gets is a few hundred counts."""
    known = rows.where(F.col("role").isin(*ROLES))
    n = max(1, known.count())
    chosen = known.where(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, train_rows / n)))
    counted = cut(_dealt(chosen).mapInArrow(_count_part, COUNTED), "counted")
    borders = counted.where("block is not null").repartition("conv_id").sortWithinPartitions("conv_id", "block", "sub").select("kind", "conv_id").mapInArrow(_count_borders, COUNTED)
    counts = counted.where("block is null").unionByName(borders).groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    return Model({(r["kind"], r["a"], r["b"]): r["n"] for r in counts})


_BEST = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("sub", pa.int64()), ("n", pa.int64()), ("best", pa.binary())])
_PIECES = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("sub", pa.int64()), ("i", pa.int64()), ("goes_on", pa.bool_()), ("torn", pa.bool_()), *list(_TURNS)[1:]])
PIECES = "conv_id long, block long, sub long, i long, goes_on boolean, torn boolean, turn long, role string, lines long, score double, rendered string"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def parse(rows: DataFrame, model: Model) -> DataFrame:
    """The turns of rows(conv_id, turn, text): conv_id, turn (of the row where it begins), role, lines, score
    (probability a line of the conversation's states) and rendered."""

    def best(parts):
        for conv, block, sub, _, found in _blocks(parts):
            if lines := lines_of(found):
                yield _batch([(conv, block, sub, len(lines), model.best([x[0] for x in lines]).tobytes())], _BEST)

    def run(parts):
        for conv, block, sub, borders, found in _blocks(parts):
            if lines := lines_of(found):
                entry, end, score, last = borders[sub]
                pieces = turns_of(lines, model, entry, end)
                out = []
                for i, (goes_on, turn, role, x) in enumerate(pieces):
                    torn = goes_on or (i == len(pieces) - 1 and not last)
                    out.append((conv, block, sub, i, goes_on, torn, turn, ROLES[role], len(x), math.exp(score), "\n".join(x) if torn else render(ROLES[role], x)))
                yield _batch(out, _PIECES)

    def whole(parts):
        for batch in parts:
            yield _batch([(*r[:-1], render(r[2], r[-1])) for r in zip(*(c.to_pylist() for c in batch.columns))], _TURNS)

    rows = rows.withColumn("role", F.lit(None).cast("string"))
    blocks = _dealt(rows).mapInArrow(best, "conv_id long, block long, sub long, n long, best binary")
    borders = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block", "sub").mapInArrow(_borders, "conv_id long, block long, text string")
    pieces = cut(_dealt(rows, cut(borders, "borders")).mapInArrow(run, PIECES), "pieces")
    head = F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(Window.partitionBy("conv_id").orderBy("block", "sub", "i"))
    part = F.sort_array(F.collect_list(F.struct("block", "sub", "i", "turn", "role", "rendered")))
    torn = pieces.where("torn").withColumn("head", head).groupBy("conv_id", "head").agg(part.alias("p"), F.sum("lines").alias("lines"), F.first("score").alias("score"))
    joined = torn.select("conv_id", F.col("p")[0]["turn"].alias("turn"), F.col("p")[0]["role"].alias("role"), "lines", "score", F.col("p.rendered").alias("rendered"))
    columns = [f.name for f in _TURNS]
    return pieces.where("not torn").select(*columns).unionByName(joined.select(*columns).mapInArrow(whole, TURNS))
