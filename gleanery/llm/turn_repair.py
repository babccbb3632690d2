"""Faults of conversations and their cheapest repair, by a checkpointed dynamic programme.

Roles have to read ``(s?(ua)+)?`` by their initials: four states. A backward pass over a
conversation gives each state's cheapest cost to the end, but stores that vector at every
square-rootth row only. The walk forward recomputes one block of vectors at a time and takes,
of the edits that keep the cost, the first in ASCII order: delete, insert, keep, rerole.

A row enters the programme as one byte, so an ordinary conversation is one short string. A
long one is cut into segments, ordered by a prefix scan: each segment's costs are a
4 x 4 matrix, the matrices give the vector at every segment's end, with it every segment says
which state it ends in from each state it may start in, and chained these give every
segment's start. Only the final digest, which is sequential by nature, reads a conversation
in one task, row by row.

Nulls are one space each, in roles, texts and the places that damage is drawn from; rows
without a conversation id are one conversation. Turns are ordered by turn (nulls first), then
role, then text; repeated rows are rows of their own, all but the first duplicates. An empty
table gives no row.
"""

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import attach, kept
from gleanery.operators.running import HOT_ROWS, Fold, hot_keys, prefix_scan

SEGMENT = 65_536
NOTHING = hashlib.sha256(b"").hexdigest()
BLANK = r"^[\x20\x09-\x0D]*\z"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"

# States: nothing yet, after system, after user, after assistant. Costs of the edits.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER},
        "a": {USER: ASSISTANT}}
WANTED = (USER, USER, ASSISTANT, USER)  # where an inserted or reroled turn leads
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NEVER = 1 << 50
FINAL = (0, 2 * INSERT, INSERT, 0)
KINDS = "sua?"
MUST, CUT = 4, 8  # bits of a row's byte beside its kind: has to go, is truncated


def _row(code: int, after: tuple[int, ...]) -> list[dict[str, tuple[int, int]]]:
    """Per state, the cost to the end and the next state by the edit of this row."""
    options = []
    cut = TRUNCATED if code & CUT else 0
    for state in range(4):
        found = {"D": (DELETE + after[state], state)}
        if not code & MUST:
            kept_in = NEXT.get(KINDS[code & 3], {}).get(state)
            if kept_in is not None:
                found["K"] = (cut + after[kept_in], kept_in)
            found["R"] = (REROLE + cut + after[WANTED[state]], WANTED[state])
        options.append(found)
    return options


def _before(options) -> tuple[int, ...]:
    direct = [min(cost for cost, _ in found.values()) for found in options]
    user = min(direct[USER], INSERT + direct[ASSISTANT])
    assistant = min(direct[ASSISTANT], INSERT + direct[USER])
    return (min(direct[START], INSERT + user), min(direct[SYSTEM], INSERT + user), user, assistant)


@lru_cache(100_000)
def _back(code: int, after: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """The vector before a row, as its least entry and the rest above it."""
    before = _before(_row(code, after))
    least = min(before)
    return least, tuple(min(b - least, NEVER) for b in before)


@lru_cache(100_000)
def _step(code: int, after: tuple[int, ...], state: int) -> tuple[str, str, int, int]:
    """Edits at a row, the same with roles, the state they lead to and their cost.

    In the second form ``u`` and ``a`` are inserted turns, ``U`` and ``A`` new roles.
    """
    options = _row(code, after)
    before = _before(options)
    edits = script = ""
    cost = 0
    while True:
        tight = [e for e, (c, _) in options[state].items() if c == before[state]]
        if "D" not in tight and INSERT + before[WANTED[state]] == before[state]:
            edits += "I"
            state = WANTED[state]
            script += KINDS[state - 1]
            cost += INSERT
            continue
        edit = min(tight)
        total, to = options[state][edit]
        return (edits + edit, script + (KINDS[to - 1].upper() if edit == "R" else edit), to,
                cost + total - after[to])


def matrix(codes: bytes) -> list[int]:
    """Cheapest cost from each state before the rows to each state after them, row by row."""
    columns = []
    for end in range(4):
        vector, base = tuple(0 if s == end else NEVER for s in range(4)), 0
        for code in reversed(codes):
            least, vector = _back(code, vector)
            base += least
        columns.append([min(base + v, NEVER) for v in vector])
    return [columns[end][state] for state in range(4) for end in range(4)]


def vectors(matrices: list[list[int]]) -> list[tuple[int, ...]]:
    """The vector after each segment of a conversation, from their matrices."""
    found = [FINAL]
    for m in reversed(matrices[1:]):
        after = found[-1]
        vector = [min(m[4 * s + e] + after[e] for e in range(4)) for s in range(4)]
        least = min(vector)
        found.append(tuple(min(v - least, NEVER) for v in vector))
    return found[::-1]


def walk(codes: bytes, state: int, after: tuple[int, ...], last: bool = True
         ) -> tuple[list[str], list[str], int, int]:
    """Edits of each row from a state on, the same with roles, the last state and the cost.

    ``after`` is the vector after the rows; edits behind the last row join the row's own.
    """
    n = len(codes)
    stride = isqrt(n) + 1
    checkpoints = [after] * (n // stride + 2)
    vector = after
    for i in range(n - 1, -1, -1):
        vector = _back(codes[i], vector)[1]
        if i % stride == 0:
            checkpoints[i // stride] = vector
    edits, scripts, cost = [], [], 0
    for low in range(0, n, stride):
        high = min(n, low + stride)
        block = [after if high == n else checkpoints[high // stride]]
        for i in range(high - 1, low, -1):
            block.append(_back(codes[i], block[-1])[1])
        for i in range(low, high):
            edit, script, state, spent = _step(codes[i], block[high - 1 - i], state)
            edits.append(edit)
            scripts.append(script)
            cost += spent
    while last and n and FINAL[state]:
        state = WANTED[state]
        edits[-1] += "I"
        scripts[-1] += KINDS[state - 1]
        cost += INSERT
    return edits, scripts, state, cost


def _illegal(codes: bytes) -> int:
    return sum(KINDS[a & 3] + KINDS[b & 3] not in ("su", "ua", "au")
               for a, b in zip(codes, codes[1:]))


def damaged(conversations: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """``k, turn, role, text, copies`` of the rows that a seeded damage leaves.

    By the CRC-32 of ``id:turn`` modulo 20 a row is dropped, emptied, stripped of its
    sentence ends, doubled or given the role user.
    """
    k = F.coalesce(F.col(conv_id).cast("string"), F.lit(" "))
    place = F.concat(k, F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    text = F.coalesce("text", F.lit(" "))
    kind = F.crc32(place.cast("binary")) % 20
    return conversations.select(
        k.alias("k"), F.col("turn").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("copies"), kind.alias("kind"),
    ).where("kind <> 0").drop("kind")


def placed(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows without their texts, in order: ``k, turn, role, tie, copies, start`` (the first
    copy's place from 0), what is wrong with the text, and whether it is the first of its
    kind. Texts are shuffled only where they decide an order."""
    place = ["k", "turn", "role"]
    shared = kept(rows.groupBy(*place).count().where("count > 1").drop("count"))
    tie = F.lit(None).cast("string")
    if not shared.isEmpty():
        tied = shared.select(*[F.col(p).alias(f"_{p}") for p in place])
        rows = rows.join(tied, (F.col("k") == F.col("_k")) & (F.col("role") == F.col("_role"))
                         & F.col("turn").eqNullSafe(F.col("_turn")), "left")
        tie = F.when(F.col("_k").isNotNull(), F.col("text"))
    content = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    narrow = kept(rows.select(
        "k", "turn", "role", tie.alias("tie"), "copies", F.unhex(F.sha2(content, 256)).alias("same"),
        F.col("text").rlike(BLANK).alias("blank"), (~F.col("text").rlike(ENDED)).alias("cut")))
    hot = hot_keys(narrow, ["k"], hot_rows)
    numbered = kept(
        prefix_scan(narrow, ["k"], ["turn", "role", "tie"],
                    {"stop": Fold(F.col("copies").cast("long"), "sum")}, hot, hot_rows)
        .withColumn("start", F.col("stop") - F.col("copies")).drop("stop"))
    first = numbered.groupBy("k", "same").agg(F.min("start").alias("start"))
    fresh = first.select("k", "start", F.lit(True).alias("fresh"))
    return numbered.drop("same").join(fresh, ["k", "start"], "left").withColumn(
        "fresh", F.coalesce("fresh", F.lit(False)))


def _code(gone: Column) -> Column:
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    bits = kind + F.when(gone, MUST).otherwise(0) + F.when(F.col("cut"), CUT).otherwise(0)
    return bits.cast("tinyint")


def segments(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``k, seg, segs`` and the segment's ``rows``: starts and codes, doubled rows with two.

    A segment holds at most the greater of ``segment`` and the square root of its
    conversation's rows, so there are no more than that many per conversation either.
    """
    again = F.when(F.col("copies") == 2, _code(F.lit(True)))
    codes = kept(rows.select("k", "start", F.struct(
        "start", _code(F.col("blank") | ~F.col("fresh")).alias("code"), again.alias("again")
    ).alias("row")))
    size = F.greatest(F.lit(segment), F.ceil(F.sqrt("n"))).cast("long")
    many = kept(
        rows.groupBy("k").agg(F.sum("copies").alias("n")).where(F.col("n") > segment)
        .select("k", size.alias("size"), (F.floor((F.col("n") - 1) / size) + 1).alias("segs"))
    )
    cut = attach(codes, many, ["k"]).select(
        "k", "row", F.coalesce(F.floor(F.col("start") / F.col("size")), F.lit(0)).alias("seg"),
        F.coalesce("segs", F.lit(1)).alias("segs"))
    return cut.groupBy("k", "seg", "segs").agg(F.array_sort(F.collect_list("row")).alias("rows"))


def _each(batch: pa.RecordBatch, column: str = "rows") -> Iterator[tuple[list, list, bytes]]:
    """Starts, numbers of copies and codes of every segment of a batch."""
    rows = batch.column(column)
    ends = rows.offsets.to_pylist()
    inner = rows.values
    starts, codes, again = (inner.field(n).to_pylist() for n in ("start", "code", "again"))
    for low, high in zip(ends, ends[1:]):
        copies = [1 if a is None else 2 for a in again[low:high]]
        if 2 in copies:
            both = [c for pair in zip(codes[low:high], again[low:high]) for c in pair
                    if c is not None]
        else:
            both = codes[low:high]
        yield starts[low:high], copies, bytes(both)


def _plain(batch: pa.RecordBatch, names: list[str]) -> list[list]:
    return [batch.column(n).to_pylist() for n in names]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [matrix(codes) for *_, codes in _each(batch)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("k"), batch.column("seg"), pa.array(found, pa.list_(pa.int64()))],
            names=["k", "seg", "m"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, ms in zip(*_plain(batch, ["k", "ms"])):
            found = [list(v) for v in vectors([m["m"] for m in ms])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * len(ms), pa.string()), pa.array([m["seg"] for m in ms], pa.int64()),
                 pa.array(found, pa.list_(pa.int64()))], names=["k", "seg", "after"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state each segment ends in, by the state it starts in."""
    for batch in batches:
        found = [[walk(codes, s, tuple(after), False)[2] for s in range(4)]
                 for (*_, codes), after in zip(_each(batch), batch.column("after").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("k"), batch.column("seg"), pa.array(found, pa.list_(pa.int32()))],
            names=["k", "seg", "ends"])


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, segs in zip(*_plain(batch, ["k", "segs"])):
            states = [START]
            for seg in segs[:-1]:
                states.append(seg["ends"][states[-1]])
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * len(segs), pa.string()),
                 pa.array([s["seg"] for s in segs], pa.int64()), pa.array(states, pa.int32())],
                names=["k", "seg", "state"])


_WALKED = ("k string, seg long, audit string, cost long, illegal long, first string, last string, "
           "starts array<long>, scripts array<string>")


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for (starts, copies, codes), k, seg, segs, state, after in zip(
                _each(batch), *_plain(batch, ["k", "seg", "segs", "state", "after"])):
            edits, scripts, _, cost = walk(codes, state, tuple(after), seg == segs - 1)
            if 2 in copies:
                found = iter(scripts)
                scripts = ["".join(next(found) for _ in range(n)) for n in copies]
            out.append((k, seg, "".join(edits), cost, _illegal(codes), KINDS[codes[0] & 3],
                        KINDS[codes[-1] & 3], starts, scripts))
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(),
                 pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())]
        names = [part.split()[0] for part in _WALKED.split(", ")]
        columns = list(zip(*out)) if out else [()] * len(names)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)


def _started(cut: DataFrame) -> DataFrame:
    """Segments with the state they start in and the vector after them."""
    final = F.array(*[F.lit(v).cast("long") for v in FINAL])
    alone = cut.where("segs = 1").withColumns({"state": F.lit(START), "after": final})
    many = cut.where("segs > 1")
    if many.isEmpty():
        return alone
    by_place = ["k", "seg"]
    after = kept(
        many.select(*by_place, "rows").mapInArrow(_matrices, "k string, seg long, m array<long>")
        .groupBy("k").agg(F.array_sort(F.collect_list(F.struct("seg", "m"))).alias("ms"))
        .mapInArrow(_vectors, "k string, seg long, after array<long>"))
    known = many.join(after, by_place)
    state = (
        known.mapInArrow(_ends, "k string, seg long, ends array<int>")
        .groupBy("k").agg(F.array_sort(F.collect_list(F.struct("seg", "ends"))).alias("segs"))
        .mapInArrow(_starts, "k string, seg long, state int"))
    return alone.unionByName(known.join(state, by_place).select(*alone.columns))


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's repaired lines; scripts come before the turn's rows."""
    k, state, scripts = None, None, deque()

    def close(done):
        return pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()),
             pa.array([d[1].hexdigest() for d in done], pa.string())],
            names=["k", "repaired_sha256"])

    fresh = True
    for batch in batches:
        done = []
        texts = batch.column("text")
        for i, (key, side, script, role) in enumerate(
                zip(*_plain(batch, ["k", "side", "script", "role"]))):
            if key != k:
                if k is not None:
                    done.append((k, state))
                k, state, fresh = key, hashlib.sha256(), True
                scripts.clear()
            if not side:
                scripts.append(script)
                continue
            text = None
            for edit in scripts.popleft():
                if edit == "D":
                    continue
                named = {"u": "user", "U": "user", "a": "assistant", "A": "assistant"}.get(edit, role)
                if edit in "KUA":
                    text = texts[i].as_py()
                state.update(f"{'' if fresh else chr(10)}{named}:{text if edit in 'KUA' else ''}"
                             .encode())
                fresh = False
        if done:
            yield close(done)
    if k is not None:
        yield close([(k, state)])


def repair(conversations: DataFrame, conv_id: str = "conv_id", segment: int = SEGMENT,
           hot_rows: int = HOT_ROWS) -> DataFrame:
    """Damages the conversations and repairs them: one row per conversation with ``gaps``,
    ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` (the edits'
    initials) and ``repaired_sha256`` of its ``role:text`` lines.

    ``edits`` has the edits themselves: ``start`` of a damaged row, the initials in order and
    the roles of inserted (``u, a``) and reroled (``U, A``) turns.
    """
    return repair_rows(damaged(conversations, conv_id), conversations, conv_id, segment, hot_rows)


def edits(conversations: DataFrame, conv_id: str = "conv_id", segment: int = SEGMENT,
          hot_rows: int = HOT_ROWS) -> DataFrame:
    """``k, turn, role, start, script`` per damaged row, see :func:`repair`."""
    rows = kept(placed(damaged(conversations, conv_id), hot_rows))
    return _scripted(rows, _walked(rows, segment))


def _walked(rows: DataFrame, segment: int) -> DataFrame:
    return kept(_started(kept(segments(rows, segment))).mapInArrow(_walks, _WALKED))


def _scripted(rows: DataFrame, walked: DataFrame) -> DataFrame:
    each = walked.select("k", F.explode(F.arrays_zip("starts", "scripts")).alias("e")).select(
        "k", F.col("e.starts").alias("start"), F.col("e.scripts").alias("script"))
    return rows.select("k", "turn", "role", "start").join(each, ["k", "start"])


def repair_rows(damaged_rows: DataFrame, conversations: DataFrame, conv_id: str, segment: int,
                hot_rows: int) -> DataFrame:
    rows = kept(placed(damaged_rows, hot_rows))
    walked = _walked(rows, segment)

    good = ~F.col("blank")
    faults = rows.groupBy("k").agg(
        F.sum(F.when(good, 0).otherwise(F.col("copies"))).alias("blank"),
        F.sum(F.when(good, F.col("copies") - F.col("fresh").cast("int")).otherwise(0))
        .alias("duplicate"),
        F.count_if(good & F.col("fresh") & F.col("cut")).alias("truncated"))
    gaps = (
        rows.where("turn IS NOT NULL").select("k", "turn").distinct().groupBy("k")
        .agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps")))
    parts = walked.groupBy("k").agg(
        F.array_sort(F.collect_list(F.struct("seg", "audit", "illegal", "first", "last")))
        .alias("p"), F.sum("cost").alias("cost"))
    seams = F.zip_with(
        F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1),
        lambda a, b: (~F.concat(a["last"], b["first"]).isin("su", "ua", "au")).cast("long"))
    inside = F.transform("p", lambda x: x["illegal"])
    total = F.aggregate(F.concat(inside, seams), F.lit(0).cast("long"), lambda s, x: s + x)
    audits = parts.select("k", "cost", total.alias("illegal"), F.array_join(
        F.transform("p", lambda x: x["audit"]), "").alias("audit"))

    none = F.lit(None).cast("string")
    scripts = _scripted(rows, walked).select(
        "k", "turn", F.lit(0).alias("side"), "start", "script", none.alias("role"),
        none.alias("text"))
    texts = damaged_rows.select(
        "k", "turn", F.lit(1).alias("side"), F.lit(None).cast("long").alias("start"),
        none.alias("script"), "role", "text")
    lines = (
        scripts.unionByName(texts).repartition("k")
        .sortWithinPartitions("k", "turn", "side", "start", "role", "text")
        .mapInArrow(_repaired, "k string, repaired_sha256 string"))

    key = F.coalesce(F.col(conv_id).cast("string"), F.lit(" "))
    ids = conversations.select(key.alias("k"), F.col(conv_id).alias("conv_id")).distinct()
    found = ids.join(faults, "k", "left").join(gaps, "k", "left").join(audits, "k", "left").join(
        lines, "k", "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select(
        "conv_id", *[F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
                     for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256"))
