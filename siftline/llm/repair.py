"""Conversation structure repair over a suffix-shared automaton.

Each row of a conversation is one symbol: what it has of role and fault. The
words of symbols of all conversations are an automaton minimised from the end:
a node stands for one distinct suffix and is shared by all words that end in it.
Cost-to-go and best edit of a node depend on the node and the grammar's state
alone, so they are found once for each node and state, from the end on: the
node after the row is known, and edits of the row lead to it. The best audit is
read off by following best edits.

Spark takes the distinct words, deals them by ranges of the reversed word and
sorts them so. Words with a common suffix then follow each other, each node
comes up once in a task (nodes on the bounds of a range, in two), and a task holds
the nodes of one word only, whatever the corpus. Rows are placed and judged by
window functions and repaired in a stream of sorted rows, so no conversation is
held whole in memory; its rows do go through one task, as its digest needs.

Defined results: null roles and texts are one blank; a null conv_id is a
conversation; a null turn comes first; rows of one turn are ordered by role and
text; an empty role has no initial, so its row can't be kept; gaps beyond a long
are 0; repeated rows are
duplicates; an empty table gives an empty table; columns that are not named are
not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import crowded_join, releasing, scratch_table

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: What edits cost, and a truncated row that is not deleted.
COSTS, TRUNCATED = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}, 1
#: Grammar states: nothing yet, after the system row, after a user row, after
#: an assistant row. A conversation may end in ENDS.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: The state that the only user or assistant row allowed next leads to.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Symbols of rows: one for blank and duplicate rows, which have to go; else by
#: the role's initial (o: another), in upper case if truncated.
GONE = "d"
ROLES = ("u", "a", "s")
_NEVER = 1 << 60
_SPACES = " \t\n\x0b\x0c\r"
Node = tuple[tuple[int, str], ...]


def kept_state(symbol: str, state: int) -> int | None:
    """Where keeping a row leads, if the grammar allows it."""
    initial = symbol.lower()
    if initial == "s":
        return SYSTEM if state == START else None
    to = NEXT[state]
    return to if initial == NAMES[to][0] else None


def _inserted(best: list[tuple[int, str]]) -> Node:
    """The node with insertions before its row weighed in. Two in a row are of use only where the grammar asks for both."""
    cost = COSTS[INSERT]
    user, assistant = best[USER], best[ASSISTANT]
    best[USER] = min(user, (cost + assistant[0], INSERT))
    best[ASSISTANT] = min(assistant, (cost + user[0], INSERT))
    for state in (START, SYSTEM):
        best[state] = min(best[state], (cost + best[USER][0], INSERT))
    return tuple(best)


#: The node of the empty suffix.
END = _inserted([(0, "") if state in ENDS else (_NEVER, "") for state in range(4)])


def before(symbol: str, after: Node) -> Node:
    """The node of a row and the suffix after it: for each state the cost-to-go and the first edit, the ASCII-least of the best."""
    best = []
    for state in range(4):
        options = [(COSTS[DELETE] + after[state][0], DELETE)]
        if symbol != GONE:
            extra = TRUNCATED * symbol.isupper()
            options.append((COSTS[REROLE] + extra + after[NEXT[state]][0], REROLE))
            kept = kept_state(symbol, state)
            if kept is not None:
                options.append((COSTS[KEEP] + extra + after[kept][0], KEEP))
        best.append(min(options))
    return _inserted(best)


def audit_of(word: str, nodes: list[Node]) -> str:
    """The best edits of a word; ``nodes[k]`` is the node of its last k symbols."""
    state, left, out = START, len(word), []
    while edit := nodes[left][state][1]:
        out.append(edit)
        if edit == KEEP:
            state = kept_state(word[-left], state)
        elif edit != DELETE:
            state = NEXT[state]
        left -= edit != INSERT
    return "".join(out)


def walk(words: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """``(word, cost, audit)`` of words that are sorted from their ends. What
    the last word's suffix shares with this one's is kept, the rest made."""
    nodes, last = [END], ""
    for word in words:
        shared = 0
        for x, y in zip(reversed(word), reversed(last)):
            if x != y:
                break
            shared += 1
        del nodes[shared + 1 :]
        for k in range(shared + 1, len(word) + 1):
            nodes.append(before(word[-k], nodes[-1]))
        last = word
        yield word, nodes[-1][START][0], audit_of(word, nodes)


def damaged(talks: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that a checksum of conv_id and turn draws: a row is
    dropped, emptied, loses its sentence ends, is repeated, or gets the user's role."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    role = F.when(draw == 4, "user").otherwise(blank("role"))
    copies = F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1)
    rows = talks.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("col")


def placed(rows: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), turn, role, text, fault (blank, duplicate,
    truncated or null), symbol, illegal, new_turn of each row."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col("conv_id"), F.col("turn"), filled("role").alias("role"), filled("text").alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    initial = lambda role: F.substring(role, 1, 1)
    pair = F.concat(F.lag(initial("role")).over(order), initial("role"))
    rows = rows.withColumns({
        "pos": F.row_number().over(order),
        "illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)),
        "new_turn": F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order)),
    })
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("pos"))
    bare = F.rtrim(F.col("text"), F.lit(_SPACES))
    fault = F.when(bare == "", "blank").when(nth > 1, "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
    kind = F.when(initial("role").isin(*ROLES), initial("role")).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault").isNotNull(), F.upper(kind)).otherwise(kind)
    return rows.withColumn("fault", fault).withColumn("symbol", symbol)


def diagnosed(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal and the word of each conversation of ``placed`` rows."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    wide = lambda c: c.cast("decimal(20,0)")
    gaps = wide(F.max("turn")) - wide(F.min("turn")) + 1 - wide(count(F.col("new_turn")))
    symbols = F.transform(F.array_sort(F.collect_list(F.struct("pos", "symbol"))), lambda x: x["symbol"])
    return rows.groupBy("conv_id").agg(
        F.coalesce(gaps.try_cast("long"), F.lit(0)).alias("gaps"), *(count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")),
        count(F.col("illegal")).alias("illegal"), F.array_join(symbols, "").alias("word"),
    )


def plans(diagnoses: DataFrame) -> DataFrame:
    """Add cost and audit: the cheapest edits that give a conversation's role
    initials the form ``(s?(ua)+)?``, the ASCII-least of those. ``diagnoses`` is
    read several times and has to be the same each time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = (word for batch in batches for word in batch.column(0).to_pylist())
        held = []
        for row in walk(words):
            held.append(row)
            if len(held) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], names=["word", "cost", "audit"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], names=["word", "cost", "audit"])

    words = scratch_table(diagnoses.groupBy("word").agg(F.count("*").alias("n")), "words")
    dealt = words.select("word").repartitionByRange(F.reverse("word")).sortWithinPartitions(F.reverse("word"))
    best = dealt.mapInArrow(releasing(run), "word string, cost long, audit string").join(words, "word")
    return crowded_join(diagnoses, scratch_table(best, "audits"), "word").drop("word")


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, nth (from 1), edit, role, text.
    ``rows`` as from ``placed``, ``plan`` with conv_id and audit."""
    kinds = pa.schema([("conv_id", pa.int64()), ("nth", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, nth, state = None, "", 0, 0, START

        def until_row(row: tuple[str, str, str] | None) -> Iterator[tuple]:
            """What the audit says up to and with the next row; to its end if there is none."""
            nonlocal at, nth, state
            while at < len(audit):
                edit = audit[at]
                at += 1
                if edit == DELETE:
                    return
                nth += 1
                if edit == KEEP:
                    state = kept_state(row[2], state)
                    yield conv, nth, edit, row[0], row[1]
                else:
                    state = NEXT[state]
                    yield conv, nth, edit, NAMES[state], row[1] if edit == REROLE else ""
                if edit != INSERT:
                    return

        for batch in batches:
            out = []
            for key, pos, *row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if pos == 0:
                    out.extend(until_row(None))
                    conv, audit, at, nth, state = key, row[1], 0, 0, START
                else:
                    out.extend(until_row(tuple(row)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, kinds)], schema=kinds)
        out = list(until_row(None))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, kinds)], schema=kinds)

    heads = plan.select("conv_id", F.lit(0).alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit("").alias("symbol"))
    both = heads.unionByName(rows.select("conv_id", "pos", "role", "text", "symbol"))
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return dealt.mapInArrow(releasing(run), "conv_id long, nth long, edit string, role string, text string")


def turn_digests(turns: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, sha256)``: the digest of ``role:text`` of all rows in order of nth, joined by line ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, n, digest = None, 0, None
        for batch in batches:
            out = []
            for key, nth, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if nth == 1 or key != conv:
                    if n:
                        out.append((conv, n, digest.hexdigest()))
                    conv, n, digest = key, 0, hashlib.sha256()
                digest.update(("\n" * (n > 0) + f"{role}:{text}").encode())
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.string()))], names=["conv_id", "n_turns", "sha256"])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in ((conv, pa.int64()), (n, pa.int64()), (digest.hexdigest(), pa.string()))], names=["conv_id", "n_turns", "sha256"])

    dealt = turns.select("conv_id", "nth", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "nth")
    return dealt.mapInArrow(releasing(run), "conv_id long, n_turns long, sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plans (conv_id, counts of faults, cost, audit) and the repaired turns of
    a table of conv_id, turn, role and text."""
    made = scratch_table(placed(rows), "placed-turns")
    plan = scratch_table(plans(scratch_table(diagnosed(made), "diagnoses")), "repair-plans")
    return plan, repaired(made, plan)


def of_each(ids: DataFrame, table: DataFrame, key: str = "conv_id") -> DataFrame:
    """``ids``, distinct, with the columns of ``table``; a null id meets a null id."""
    other = table.withColumnRenamed(key, f"__{key}")
    return ids.join(other, F.col(key).eqNullSafe(F.col(f"__{key}")), "left").drop(f"__{key}")


def column_or(name: str, value) -> Column:
    return F.coalesce(F.col(name), F.lit(value)).alias(name)
