"""Conversation repair by survivor-coalescence Viterbi.

A conversation is brought to the form ``(system? (user assistant)+)?`` by the
cheapest edits.  Four states say what has been emitted: nothing, a system turn,
a user turn, a whole exchange.  Rows are read in order; every state keeps one
survivor, a leaf of a tree of backpointers whose nodes count their children.
Nodes that no survivor leads to are freed at once, and as soon as all survivors
share an ancestor the edits up to it are emitted, so a task holds only the
unresolved ends.  Survivors of equal cost are compared by their complete
unresolved ends.

Rows are range-partitioned by conversation and turn, so a conversation of any
length is spread over tasks.  A conversation that lies within a task and is
short is repaired there.  Any other is cut into segments; each is run from all
four states, the few resulting paths of a segment are joined by the same
algorithm with segments in place of rows, and each segment then applies its own
part of the chosen edits.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import saved, sent_if_small

#: What a state waits for: at the start or after a system turn or a whole exchange a user turn, after a user turn an assistant turn.
START, SYSTEM, ASKED, ANSWERED = range(4)
STATES = (START, SYSTEM, ASKED, ANSWERED)
#: A conversation may end with nothing emitted or after a whole exchange.
ENDS = (START, ANSWERED)
NEXT = {(START, "s"): SYSTEM, (START, "u"): ASKED, (SYSTEM, "u"): ASKED, (ASKED, "a"): ANSWERED, (ANSWERED, "u"): ASKED}
WANTS = {START: "user", SYSTEM: "user", ASKED: "assistant", ANSWERED: "user"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Whatever one state can still do, any other can do for so much more (at most an insertion and a deletion), so a survivor beyond that is lost.
LOST = INSERT + DELETE
#: Rows of a conversation that a task holds at once; a longer one is cut into segments of so many.
SEGMENT_ROWS = 1 << 12


class Node:
    """An edit (or a segment's edits) with its backpointer and the number of children and survivors that lead to it."""

    __slots__ = ("parent", "label", "refs", "depth")

    def __init__(self, parent, label):
        self.parent, self.label, self.refs = parent, label, 0
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.refs += 1


def _free(node):
    while node is not None and node.refs == 0:
        parent, node.parent = node.parent, None
        if parent is not None:
            parent.refs -= 1
        node = parent


def _ends(a, b) -> tuple[str, str]:
    """The labels of two leaves below their common ancestor."""
    left, right = [], []
    while a is not b:
        if a.depth >= b.depth:
            left.append(a.label)
            a = a.parent
        else:
            right.append(b.label)
            b = b.parent
    return "".join(reversed(left)), "".join(reversed(right))


class Survivors:
    """The cheapest path to every state, ties by the ASCII order of the labels."""

    def __init__(self, start: int):
        self.root = Node(None, "")
        self.root.refs = 1  # the tree itself
        self.at = {start: (0, self.root)}
        self.root.refs += 1

    def step(self, moves) -> None:
        """``moves``: (from, to, cost, label) of one row; every path takes one of them."""
        new: dict[int, tuple[int, Node]] = {}
        for source, to, cost, label in moves:
            if source in self.at:
                before, node = self.at[source]
                self._offer(new, to, before + cost, node, label)
        old, self.at = self.at, new
        low = min(cost for cost, _ in new.values())
        lost = [new.pop(s) for s in STATES if s in new and new[s][0] > low + LOST]
        for _, node in [*old.values(), *lost]:
            node.refs -= 1
            _free(node)

    def _offer(self, new, to, cost, node, label) -> None:
        if to in new and new[to][0] < cost:
            return
        leaf = Node(node, label)
        if to in new and new[to][0] == cost:
            ours, theirs = _ends(leaf, new[to][1])
            if ours >= theirs:
                _free(leaf)
                return
        if to in new:
            new[to][1].refs -= 1
            _free(new[to][1])
        leaf.refs += 1
        new[to] = (cost, leaf)

    def insert(self) -> None:
        """Inserted turns; in this order one pass reaches all that insertions can better."""
        for source in (ANSWERED, START, SYSTEM, ASKED):
            if source in self.at:
                cost, node = self.at[source]
                self._offer(self.at, NEXT[source, WANTS[source][0]], cost + INSERT, node, "I")

    def resolved(self) -> str:
        """The labels up to the last common ancestor of all survivors, which becomes the root."""
        leaves = [node for _, node in self.at.values()]
        common = leaves[0]
        for leaf in leaves[1:]:
            while common is not leaf:
                if common.depth >= leaf.depth:
                    common = common.parent
                else:
                    leaf = leaf.parent
        labels, node = [], common
        while node is not self.root:
            labels.append(node.label)
            node = node.parent
        if common is not self.root:
            old, self.root = self.root, common
            common.refs += 1
            kept, common.parent = common.parent, None
            kept.refs -= 1
            old.refs -= 1
            _free(kept)
        return "".join(reversed(labels))

    def tails(self) -> dict[int, tuple[int, str]]:
        """Cost and unresolved labels per state."""
        return {state: (cost, _ends(node, self.root)[0]) for state, (cost, node) in self.at.items()}


def _row_moves(initial: str, gone: bool, cut: bool):
    """The edits of one row: required deletion, else deletion, keeping where the role fits, and another role."""
    moves = [(s, s, DELETE, "D") for s in STATES]
    if not gone:
        more = TRUNCATED if cut else 0
        moves += [(s, NEXT[s, initial], more, "K") for s in STATES if (s, initial) in NEXT]
        moves += [(s, NEXT[s, WANTS[s][0]], more + REROLE, "R") for s in STATES]
    return moves


MOVES = {(i, g, c): _row_moves(i, g, c) for i in ("s", "u", "a", "") for g in (False, True) for c in (False, True)}


def run_rows(kinds, start: int, opening: bool) -> dict[int, tuple[int, str]]:
    """Cost and edits to every state reached from ``start`` over rows of these kinds (keys of ``MOVES``); ``opening``: turns may be inserted before the first."""
    survivors = Survivors(start)
    if opening:
        survivors.insert()
    done, due = [], 64
    for k, kind in enumerate(kinds, 1):
        survivors.step(MOVES[kind])
        survivors.insert()
        if k == due:  # a walk costs the unresolved length, so a longer one waits longer
            done.append(survivors.resolved())
            due += 64 + 2 * max(node.depth - survivors.root.depth for _, node in survivors.at.values())
    before = "".join(done)
    return {state: (cost, before + tail) for state, (cost, tail) in survivors.tails().items()}


@functools.lru_cache(maxsize=1 << 14)
def _whole(kinds: tuple) -> tuple[int, str]:
    """Cost and edits of a whole conversation; short ones repeat in their kinds."""
    return cheapest(run_rows(kinds, START, True))


def cheapest(paths: dict[int, tuple[int, str]]) -> tuple[int, str]:
    return min(paths[s] for s in ENDS if s in paths)


def apply(edits: str, rows, state: int):
    """``edit, role, text`` per edit; ``rows`` are (role, text). A deleted row keeps its own role and text."""
    rows = iter(rows)
    for edit in edits:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit in "IR":
            role = WANTS[state]
        yield edit, role, text
        if edit != "D":
            state = NEXT[state, role[:1]]


FACTS = "rows long, turns long, low long, high long, blank long, duplicate long, truncated long, illegal long, first string, last string"


class Facts:
    """Counts of one segment; facts of neighbouring segments add up."""

    def __init__(self):
        self.rows = self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.first = self.last = None

    def row(self, turn, initial: str, fault: str) -> None:
        self.join(1, int(turn is not None), turn, turn, int(fault == "blank"), int(fault == "duplicate"), int(fault == "truncated"), 0, initial, initial)

    def join(self, rows, turns, low, high, blank, duplicate, truncated, illegal, first, last) -> None:
        if not rows:
            return
        if self.rows and self.last + first not in ("su", "ua", "au"):
            self.illegal += 1
        # turns ascend, so only the border can share a turn
        self.turns += turns - (turns > 0 and low == self.high)
        self.rows += rows
        self.blank, self.duplicate, self.truncated, self.illegal = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated, self.illegal + illegal
        self.low = low if self.low is None else self.low
        self.high = self.high if high is None else high
        self.first, self.last = first if self.first is None else self.first, last

    def values(self):
        return self.rows, self.turns, self.low, self.high, self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last


FACT_NAMES = tuple(f.split()[0] for f in FACTS.split(", "))
ROWS = "what string, conv string, part int, seg int, at int, edit string, role string, text string, start int, end int, cost long, audit string, " + FACTS
COLUMNS = tuple(f.split()[0] for f in ROWS.split(", "))


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in COLUMNS})


class _Reader:
    """Reads the sorted rows of one partition and gives the rows of ``ROWS``.

    The first and the last conversation of a partition may go on in its
    neighbours; they and those of ``most`` rows and more are left open.
    """

    def __init__(self, part: int, most: int):
        self.part, self.most, self.seg, self.out = part, most, 0, []
        self.conv, self.held, self.open, self.begun, self.before = None, [], True, False, None

    def row(self, r) -> None:
        if self.begun and r.conv != self.conv:
            self.finish(False)
            self.open, self.before = False, None
        self.conv, self.begun = r.conv, True
        this = (r.turn, r.role, r.digest)
        fault = "blank" if r.blank else "duplicate" if r.earlier or this == self.before else "truncated" if r.truncated else ""
        self.before = this
        self.held.append((None if r.turn is None else int(r.turn), fault, r.role, r.text))
        if len(self.held) == self.most:
            self.open = True
            self.segment()

    def finish(self, last: bool) -> None:
        if not self.held:
            return
        if self.open or last:
            self.segment()
            return
        cost, audit = _whole(self.kinds())
        self.out.append(dict(what="conversation", conv=self.conv, cost=cost, audit=audit, **self.facts()))
        place = {"what": "edit", "conv": self.conv, "part": self.part, "seg": self.seg}
        for at, (edit, role, text) in enumerate(apply(audit, [h[2:] for h in self.held], START)):
            self.out.append(dict(place, at=at, edit=edit, role=role, text=text))
        self.held = []
        self.seg += 1

    def kinds(self) -> tuple:
        return tuple((r[:1] if r[:1] in ("s", "u", "a") else "", f in ("blank", "duplicate"), f == "truncated") for _, f, r, _ in self.held)

    def facts(self) -> dict:
        facts = Facts()
        for turn, fault, role, _ in self.held:
            facts.row(turn, role[:1], fault)
        return dict(zip(FACT_NAMES, facts.values(), strict=True))

    def segment(self) -> None:
        place = {"conv": self.conv, "part": self.part, "seg": self.seg}
        for at, (_, _, role, text) in enumerate(self.held):
            self.out.append(dict(place, what="open", at=at, role=role, text=text))
        kinds, facts = self.kinds(), self.facts()
        for start in STATES:
            for end, (cost, audit) in run_rows(kinds, start, False).items():
                self.out.append(dict(place, what="path", start=start, end=end, cost=cost, audit=audit, **facts))
        self.held = []
        self.seg += 1


def _read(frames, most: int):
    reader = _Reader(TaskContext.get().partitionId(), most)
    for frame in frames:
        for r in frame.itertuples(index=False):
            reader.row(r)
            if len(reader.out) > most:
                yield _frame(reader.out)
                reader.out = []
    reader.finish(True)
    yield _frame(reader.out)


class _Joined:
    """The paths of a conversation's segments, joined as they come."""

    def __init__(self, conv):
        self.conv, self.facts, self.done, self.segments, self.moves = conv, Facts(), [], [], []
        self.survivors = Survivors(START)
        self.survivors.insert()

    def path(self, r) -> None:
        if not self.segments or self.segments[-1][:2] != (r.part, r.seg):
            self.step()
            self.segments.append((r.part, r.seg, r.rows))
            self.facts.join(r.rows, r.turns, _int(r.low), _int(r.high), r.blank, r.duplicate, r.truncated, r.illegal, r.first, r.last)
        self.moves.append((r.start, r.end, r.cost, r.audit))

    def step(self) -> None:
        if self.moves:
            self.survivors.step(self.moves)
            self.moves = []
            self.done.append(self.survivors.resolved())

    def rows(self):
        """The conversation, then each segment's state at its start and its own edits: those of its rows and the insertions after them."""
        self.step()
        cost, tail = cheapest(self.survivors.tails())
        audit = "".join(self.done) + tail
        facts = dict(zip(FACT_NAMES, self.facts.values(), strict=True))
        yield dict(what="conversation", conv=self.conv, cost=cost, audit=audit, **facts)
        at = emitted = 0
        odd = (len(audit) - audit.count("D")) % 2 == 1  # only a system turn in front makes the emitted turns odd
        for k, (part, seg, rows) in enumerate(self.segments):
            begin = at
            while k == 0 and audit[at : at + 1] == "I":
                at += 1
            for _ in range(rows):
                at += 1
                while audit[at : at + 1] == "I":
                    at += 1
            yield dict(what="piece", conv=self.conv, part=part, seg=seg, start=_state(emitted, odd), audit=audit[begin:at])
            emitted += at - begin - audit.count("D", begin, at)


def _state(emitted: int, system: bool) -> int:
    if emitted <= system:
        return SYSTEM if emitted else START
    return ASKED if (emitted - system) % 2 else ANSWERED


def _int(x):
    return None if pd.isna(x) else int(x)


def _join(frames):
    joined, out = None, []
    for frame in frames:
        for r in frame.itertuples(index=False):
            if joined is None or joined.conv != r.conv:
                out += joined.rows() if joined else []
                joined = _Joined(r.conv)
            joined.path(r)
        yield _frame(out)
        out = []
    yield _frame(list(joined.rows()) if joined else [])


def _apply(key, rows, piece) -> pd.DataFrame:
    """One segment's edits."""
    if not len(piece):
        return _frame([])
    conv, start, audit = piece["conv"].iloc[0], int(piece["start"].iloc[0]), piece["audit"].iloc[0]
    rows = rows.sort_values("at")
    place = {"what": "edit", "conv": conv, "part": int(key[0]), "seg": int(key[1])}
    edits = apply(audit, zip(rows["role"], rows["text"], strict=True), start)
    return _frame([dict(place, at=at, edit=e, role=role, text=text) for at, (e, role, text) in enumerate(edits)])


class Repaired(NamedTuple):
    #: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``, one row per conversation that has rows.
    conversations: DataFrame
    #: ``conv_id, part, seg, at, edit, role, text``: in the order of the middle three, the edits of a conversation; ``edit`` is K, R, D or I.
    edits: DataFrame


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment_rows: int = SEGMENT_ROWS) -> Repaired:
    """The cheapest repair of every conversation; see ``Repaired`` for its tables.

    Rows are read by turn (nulls first), then role and a hash of the text, so
    repeated rows stand side by side.  A null role or text is one space; rows
    without a conversation id are one conversation with a null id.  A row's
    first fault counts: blank (nothing but ASCII white space), duplicate (role
    and text seen earlier), truncated (the last other character is not one of
    ``.!?``).  Kept rows cost nothing, another role (user or assistant) 3, a
    deletion 4, an inserted turn with empty text 3, and a truncated row that
    stays 3 more; blank and duplicate rows must go.  Roles count by their first
    letter.  Of the cheapest edits those of the ASCII-least letters are taken.
    ``gaps`` are the turn numbers missing between the first and the last,
    ``illegal`` the neighbouring rows that are not system-user, user-assistant
    or assistant-user.  Extra columns are ignored; no rows give empty tables.
    """

    def segments(frames):
        return _read(frames, segment_rows)

    id_type = turns.schema[conv_col].dataType.simpleString()
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
    ).withColumn("digest", F.sha2("text", 256))
    keys = ["conv_id", "role", "digest"]
    # only keys that occur again matter; counts and minima are combined before they move
    again = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count("turn").alias("n_turns"), F.min("turn").alias("low")).where("n > 1")
    again = sent_if_small(saved(again.select(*[F.col(k).alias(f"again_{k}") for k in keys], (F.col("n_turns") < F.col("n")).alias("unnumbered"), "low"), "dialogue-again"))
    same = F.col("conv_id").eqNullSafe(F.col("again_conv_id")) & (F.col("role") == F.col("again_role")) & (F.col("digest") == F.col("again_digest"))
    marked = rows.join(again, same, "left").select(
        "conv_id", "turn", "role", "digest", "text",
        F.coalesce(F.col("turn").isNotNull() & (F.col("unnumbered") | (F.col("low") < F.col("turn"))), F.lit(False)).alias("earlier"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"),
    )
    order = ["conv_id", "turn", "role", "digest"]
    laid = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    told = F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("string").alias("turn")
    read = saved(laid.select(*told, "role", "digest", "text", "earlier", "blank", "truncated").mapInPandas(segments, ROWS), "dialogue-rows")
    paths = read.where("what = 'path'").repartition("conv").sortWithinPartitions("conv", "part", "seg", "start", "end")
    joined = saved(paths.mapInPandas(_join, ROWS), "dialogue-joined")
    segment = ["part", "seg"]
    opened = read.where("what = 'open'").groupBy(*segment).cogroup(joined.where("what = 'piece'").groupBy(*segment)).applyInPandas(_apply, ROWS)

    named = F.col("conv").cast(id_type).alias("conv_id")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    whole = read.unionByName(joined).where("what = 'conversation'")
    edits = read.where("what = 'edit'").unionByName(opened)
    return Repaired(
        whole.select(named, gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit"),
        edits.select(named, "part", "seg", "at", "edit", "role", "text"),
    )


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Plants faults by ``crc32("<conv_id>:<turn>") mod 20`` (a null counts as one space).

    0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4
    makes its role user; a null role or text becomes one space.
    """
    kind = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col)]).cast("binary")) % 20
    text = F.coalesce(F.col(text_col), F.lit(" "))
    rows = turns.select(conv_col, turn_col, F.coalesce(F.col(role_col), F.lit(" ")).alias(role_col), text.alias(text_col), kind.alias("kind")).where("kind != 0")
    return rows.select(
        conv_col,
        turn_col,
        F.when(F.col("kind") == 4, "user").otherwise(F.col(role_col)).alias(role_col),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text_col, "[.!?]", "")).otherwise(F.col(text_col)).alias(text_col),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")
