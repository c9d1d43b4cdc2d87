"""Chat formatting: role repair of least cost over a legal-turn automaton, then rendering.

The choice for a conversation's first turn can hang on its last, so there are two passes: one over the roles
alone, which keeps four bytes for each turn, and one over the texts, which streams them past the choices made.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.common import partitions, table

#: A legal conversation: at most one system turn, then user and assistant in turn, the assistant last.
FOLLOWS = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
#: Cost of joining a turn to one of its role before it, of an empty turn put in, of another role for a turn
#: whose role is known, and for one whose role is not.
MERGE, INSERT, RELABEL, NAME = 2, 3, 5, 1
#: Other names of the three roles.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "developer": "system"}

#: Characters of repaired turns that are given out together.
BATCH_CHARS = 4 << 20


def _routes() -> dict[str, dict[str, list[str]]]:
    """For each state the shortest lists of empty turns that lead to another, none and all that cost more left out."""
    found: dict[str, dict[str, list[str]]] = {}
    for state in FOLLOWS:
        found[state] = {state: []}
        front = [state]
        while front:
            at = front.pop(0)
            for to in FOLLOWS[at]:
                if to not in found[state]:
                    found[state][to] = [*found[state][at], to]
                    front.append(to)
    return found


ROUTES = _routes()


def _choices() -> dict[str | None, list[tuple[str, str, int, tuple[str, ...], str]]]:
    """By role: (state before, state after, cost, empty turns before, how), in the order that ties are settled."""
    out: dict[str | None, list] = {}
    for role in ("system", "user", "assistant", None):
        rows = []
        for state in FOLLOWS:
            if state != "start":
                other = 0 if role == state else NAME if role is None else RELABEL
                rows.append((state, state, MERGE + other, (), "merge" if not other else "merge_relabel"))
            for middle, route in ROUTES[state].items():
                for to in FOLLOWS[middle]:
                    other = 0 if role == to else NAME if role is None else RELABEL
                    rows.append((state, to, INSERT * len(route) + other, tuple(route), "keep" if not other else "relabel"))
        best: dict[tuple[str, str, str], tuple] = {}
        for r in rows:
            if (k := (r[0], r[1], r[4][:5])) not in best or r[2] < best[k][2]:
                best[k] = r
        order = {"keep": 0, "merge": 1, "relabel": 2, "merge_relabel": 3}
        out[role] = sorted(best.values(), key=lambda r: (order[r[4]], len(r[3]), r[0], r[1]))
    return out


CHOICES = _choices()


STATES = list(FOLLOWS)


def decide(roles: Iterable[str | None]) -> bytes:
    """For each turn the place in CHOICES, by its role, of what a legal sequence of least cost does with it.

    Ties go to the choice that comes first, at the end to the state that does. Four bytes are held for each turn.
    """
    best: dict[str, int] = {"start": 0}
    came, known = bytearray(), bytearray()  # the choice that leads to each state, and the role
    names = list(CHOICES)
    for role in roles:
        new: dict[str, int] = {}
        row = [255] * len(STATES)
        for k, (before, after, cost, _, _) in enumerate(CHOICES[role]):
            if before in best:
                total = best[before] + cost
                if after not in new or total < new[after]:
                    new[after], row[STATES.index(after)] = total, k
        best = new
        came += bytes(row[1:])
        known.append(names.index(role))
    if not known:
        return b""
    width = len(STATES) - 1
    state = min(best, key=lambda s: (best[s] + INSERT * len(ROUTES[s]["assistant"]), STATES.index(s)))
    out = bytearray(len(known))
    for i in range(len(known) - 1, -1, -1):
        out[i] = came[i * width + STATES.index(state) - 1]
        state = CHOICES[names[known[i]]][out[i]][0]
    return bytes(out)


def known_role(role: str | None) -> str | None:
    """One of the three roles, or None."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return name if name in ("system", "user", "assistant") else None


def render(role: str, text: str) -> str:
    """A turn in chat markup; marks inside a text are broken up."""
    return f"<|im_start|>{role}\n{text.replace('<|im_', '<| im_')}<|im_end|>\n"


def repaired(turns: Iterable[tuple[str | None, str | None]], choices: bytes) -> Iterator[tuple[int, str, str, int, int]]:
    """(position, role, text, turns that went into it, cost) of the repaired sequence of (known role, text), by what decide() chose.

    A turn is given out as soon as the next one isn't merged into it.
    """
    position, now, state = 0, None, "start"

    def done() -> Iterator[tuple[int, str, str, int, int]]:
        nonlocal position
        if now is not None:
            yield position, now[0], "\n".join(now[1]), now[2], now[3]
            position += 1

    for (role, text), k in zip(turns, choices, strict=True):
        _, state, cost, route, how = CHOICES[role][k]
        if how.startswith("merge"):
            now[1].append(text or "")
            now[2] += 1
            now[3] += cost
            continue
        for empty in route:
            yield from done()
            now = [empty, [""], 0, INSERT]
        yield from done()
        now = [state, [text or ""], 1, cost - INSERT * len(route)]
    if state == "start":
        return
    for empty in ROUTES[state]["assistant"]:
        yield from done()
        now = [empty, [""], 0, INSERT]
    yield from done()


def _conversations(rows: Iterator[tuple]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """Runs of rows of one conversation, the first field, each to be read before the next; a row without one is a run."""
    ahead = next(rows, None)

    def run(conv: int | None) -> Iterator[tuple]:
        nonlocal ahead
        while ahead is not None and ahead[0] == conv:
            now, ahead = ahead, next(rows, None)
            yield now
            if conv is None:
                return

    while ahead is not None:
        conv = ahead[0]
        own = run(conv)
        yield conv, own
        for _ in own:
            pass


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def decisions(rows: DataFrame) -> DataFrame:
    """(conv_id, choices): a byte for each turn of every conversation of rows (conv_id, turn, role), by turn and role."""
    rows = rows.where("conv_id is not null").select("conv_id", "turn", "role").repartition(partitions(rows.sparkSession), "conv_id")
    rows = rows.sortWithinPartitions("conv_id", "turn", "role").select("conv_id", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, turns in _conversations(_rows(batches)):
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([decide(known_role(r) for _, r in turns)], pa.binary())], ["conv_id", "choices"])

    return rows.mapInArrow(run, "conv_id long, choices binary")


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, role, text, n_turns, cost, rendered): the repaired turns, in order of position.

    The rendered turns of a conversation, one after another, are its rendering; a turn's own row keeps long
    conversations apart. n_turns is 0 for an empty turn put in. Turns go by turn, then role, then text, nulls
    first; repeated rows are turns of their own. A null text is an empty one, an unknown role takes the one that
    costs least. A row without a conv_id is a conversation by itself. No rows give no rows; other columns are
    not read. Texts are streamed through sorted partitions; of a conversation a task holds a byte for each turn, and the
    texts of turns that are merged into one, as they are one row.
    """
    own = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    none = F.lit(None)
    # the choices of a conversation come before its turns
    first = decisions(rows).select("conv_id", none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"), "choices", F.lit(0).alias("kind"))
    rows = first.union(rows.select("conv_id", "turn", "role", "text", none.cast("binary").alias("choices"), F.lit(1).alias("kind")))
    rows = rows.repartition(partitions(conversations.sparkSession), "conv_id", own).sortWithinPartitions("conv_id", "kind", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "position", "role", "text", "n_turns", "cost", "rendered"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            out = pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], t) for i, t in enumerate(types)], names)
            held.clear()
            size = 0
            return out

        def turns(own: Iterator[tuple]) -> Iterator[tuple[str | None, str | None]]:
            return ((known_role(role), text) for _, role, text, _ in own)

        for conv, own in _conversations(_rows(batches)):
            if conv is None:
                (turn,) = turns(own)
                out = repaired([turn], decide([turn[0]]))
            else:
                out = repaired(turns(own), next(own)[3])
            for position, role, text, n, cost in out:
                held.append((conv, position, role, text, n, cost, render(role, text)))
                size += len(text)
                if len(held) >= 2000 or size > BATCH_CHARS:
                    yield flush()
        if held:
            yield flush()

    return rows.select("conv_id", "role", "text", "choices").mapInArrow(run, "conv_id long, position long, role string, text string, n_turns long, cost long, rendered string")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired turns of all conversations; nulls, ties, empty and very long texts are as in format_turns()."""
    return format_turns(table(spark, sf_dir, "conversations")).select("conv_id", "position", "role", "n_turns", "cost", "rendered")


def _sql() -> str:
    """The same dynamic programme as recursive SQL, made from the tables of choices and routes."""

    def text(x: str | None) -> str:
        return "NULL" if x is None else f"'{x}'"

    choices = ", ".join(f"({text(role)}, {k}, '{before}', '{after}', {cost}, [{', '.join(map(text, route))}]::VARCHAR[], {how.startswith('merge')})" for role, rows in CHOICES.items() for k, (before, after, cost, route, how) in enumerate(rows))
    ends = ", ".join(f"('{s}', {STATES.index(s)}, [{', '.join(map(text, ROUTES[s]['assistant']))}]::VARCHAR[])" for s in STATES)
    names = " ".join(f"WHEN '{x}' THEN '{y}'" for x, y in [*ALIASES.items(), *((r, r) for r in ("system", "user", "assistant"))])
    return f"""
    WITH RECURSIVE own AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN -1 - row_number() OVER () ELSE conv_id END AS key, turn, role, coalesce(text, '') AS text,
        CASE lower(trim(role)) {names} END AS known FROM conversations),
      t AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM own),
      c(role, k, before, after, cost, route, merges) AS (VALUES {choices}),
      e(state, place, route) AS (VALUES {ends}),
      dp AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS i, 'start' AS state, CAST(0 AS BIGINT) AS total, -1 AS k, '' AS before FROM t
        UNION ALL SELECT key, i, after, total, k, before FROM (
          SELECT dp.key, t.i, c.after, CAST(dp.total + c.cost AS BIGINT) AS total, c.k, c.before, row_number() OVER (PARTITION BY dp.key, c.after ORDER BY dp.total + c.cost, c.k) AS rn
          FROM dp JOIN t ON t.key = dp.key AND t.i = dp.i + 1 JOIN c ON c.role IS NOT DISTINCT FROM t.known AND c.before = dp.state) WHERE rn = 1),
      final AS (SELECT dp.*, row_number() OVER (PARTITION BY key ORDER BY total + {INSERT} * len(e.route), e.place) AS rn
        FROM dp JOIN e USING (state) JOIN (SELECT key, max(i) AS i FROM t GROUP BY key) USING (key, i)),
      back AS (SELECT key, i, state, k, before FROM final WHERE rn = 1
        UNION ALL SELECT dp.key, dp.i, dp.state, dp.k, dp.before FROM back JOIN dp ON dp.key = back.key AND dp.i = back.i - 1 AND dp.state = back.before WHERE back.i > 1),
      path AS (SELECT t.key, t.conv_id, t.i, t.text, c.after, c.cost, c.route, c.merges, sum(CASE WHEN c.merges THEN 0 ELSE 1 END) OVER w AS g, sum(CASE WHEN c.merges THEN 0 ELSE len(c.route) + 1 END) OVER w AS upto
        FROM back JOIN t USING (key, i) JOIN c ON c.role IS NOT DISTINCT FROM t.known AND c.k = back.k WINDOW w AS (PARTITION BY t.key ORDER BY t.i)),
      turns AS (SELECT conv_id, max(upto) - 1 AS position, any_value(after) AS role, string_agg(text, chr(10) ORDER BY i) AS text, count(*) AS n_turns, sum(cost - {INSERT} * len(route)) AS cost FROM path GROUP BY key, conv_id, g
        UNION ALL SELECT conv_id, upto - len(route) - 2 + x.at, route[x.at], '', 0, {INSERT} FROM path, LATERAL (SELECT unnest(range(1, len(route) + 1)) AS at) x
        UNION ALL SELECT t.conv_id, last.upto + x.at - 1, e.route[x.at], '', 0, {INSERT} FROM final JOIN e USING (state) JOIN (SELECT key, max(upto) AS upto FROM path GROUP BY key) last USING (key) JOIN t ON t.key = final.key AND t.i = 1, LATERAL (SELECT unnest(range(1, len(e.route) + 1)) AS at) x WHERE final.rn = 1)
    SELECT conv_id, CAST(position AS BIGINT) AS position, role, CAST(n_turns AS BIGINT) AS n_turns, CAST(cost AS BIGINT) AS cost,
      '<|im_start|>' || role || chr(10) || replace(text, '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS rendered FROM turns"""


ORACLE = _sql()
