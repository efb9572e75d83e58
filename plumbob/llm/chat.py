"""Operator 5 - chat formatting by a finite-state machine and a template.

A template declares, as data, the machine over roles (``moves`` from a state by
a role to a state, the first state and the accepting ones) and what each role's
turn is written as: parts of text, each with a loss flag, of which ``{text}``
stands for the turn's own text.  Neighbouring parts of equal flags are one
segment.  Conversations that the machine accepts give their segments in order;
others give one row that names the first thing wrong with them.

All of it is built-in expressions: a conversation's turns are gathered by one
shuffle, sorted and folded through the machine inside the JVM.

Turns are ordered by ``turn``.  Rows with a null ``conv_id`` take no part;
equal rows count once.  Wrong are, in the order of the test: a null turn
number, a repeated one (with other text or role), a null role, a role that
mayn't come next or isn't known, a null text, an empty or blank text, and an end in a
state that isn't accepting.  Control marks in texts (``<|``) are broken up by a
space, so no text can write a turn.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbob.llm.common import require, table


@dataclass(frozen=True)
class Template:
    start: str
    accept: tuple[str, ...]
    moves: dict[tuple[str, str], str]
    turns: dict[str, tuple[tuple[str, bool], ...]]
    opening: tuple[tuple[str, bool], ...] = ()
    closing: tuple[tuple[str, bool], ...] = field(default=())

    def __post_init__(self):
        for (_, role), to in self.moves.items():
            if role not in self.turns:
                raise ValueError(f"the role {role} has no turn")
            if to not in self.accept and not any(a == to for a, _ in self.moves):
                raise ValueError(f"nothing leads on from the state {to}")

    @staticmethod
    def merged(parts) -> list[tuple[str, bool]]:
        out: list[tuple[str, bool]] = []
        for text, loss in parts:
            if out and out[-1][1] == loss:
                out[-1] = (out[-1][0] + text, loss)
            else:
                out.append((text, loss))
        return out


CHAT = Template(
    start="start",
    accept=("assistant",),
    moves={("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user", ("assistant", "tool"): "tool", ("tool", "assistant"): "assistant"},
    turns={
        "system": (("<|system|>\n", False), ("{text}", False), ("<|end|>\n", False)),
        "user": (("<|user|>\n", False), ("{text}", False), ("<|end|>\n", False)),
        "tool": (("<|tool|>\n", False), ("{text}", False), ("<|end|>\n", False)),
        "assistant": (("<|assistant|>\n", False), ("{text}", True), ("<|end|>\n", True)),
    },
    opening=(("<|begin|>\n", False),),
)


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def format_chats(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """``(conv_id, segment, turn, role, text, loss, error)``: segments from 0 of
    accepted conversations, error null; else one row of nulls with the error."""
    require(turns, "conv_id", "turn", "role", "text")
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    chats = turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_set(one)).alias("ts"))
    moves = "map(" + ", ".join(f"{_quoted(s + chr(0) + r).replace(chr(0), '|')}, {_quoted(t)}" for (s, r), t in template.moves.items()) + ")"
    fold = f"""aggregate(ts, named_struct('state', {_quoted(template.start)}, 'last', CAST(NULL AS BIGINT), 'error', CAST(NULL AS STRING)), (s, t) ->
      CASE WHEN s.error IS NOT NULL THEN s ELSE named_struct('state', element_at({moves}, concat(s.state, '|', coalesce(t.role, ''))), 'last', t.turn, 'error',
        CASE WHEN t.turn IS NULL THEN 'null turn'
          WHEN t.turn = s.last THEN concat('repeated turn ', t.turn)
          WHEN t.role IS NULL THEN concat('null role at turn ', t.turn)
          WHEN element_at({moves}, concat(s.state, '|', t.role)) IS NULL THEN concat(t.role, ' after ', s.state, ' at turn ', t.turn)
          WHEN t.text IS NULL THEN concat('null text at turn ', t.turn)
          WHEN trim(translate(t.text, '\\n\\r\\t', '   ')) = '' THEN concat('empty text at turn ', t.turn) END) END,
      s -> coalesce(s.error, CASE WHEN s.state NOT IN ({", ".join(map(_quoted, template.accept))}) THEN concat('ends after ', s.state) END))"""

    def struct(text: str, loss: bool, own: bool) -> str:
        parts = [_quoted(p) for p in text.split("{text}")]
        whole = parts[0] if len(parts) == 1 else f"concat({', replace(t.text, \'<|\', \'< |\'), '.join(parts)})"
        return f"named_struct('turn', {'t.turn' if own else 'CAST(NULL AS BIGINT)'}, 'role', {'t.role' if own else 'CAST(NULL AS STRING)'}, 'text', {whole}, 'loss', {str(loss).lower()})"

    cases = " ".join(f"WHEN {_quoted(role)} THEN array({', '.join(struct(t, x, True) for t, x in Template.merged(parts))})" for role, parts in template.turns.items())
    around = [f"array({', '.join(struct(t, x, False) for t, x in Template.merged(parts))})" if parts else None for parts in (template.opening, template.closing)]
    body = f"flatten(transform(ts, t -> CASE t.role {cases} END))"
    segments = f"concat({', '.join(x for x in (around[0], body, around[1]) if x)})"
    checked = chats.select("conv_id", "ts", F.expr(fold).alias("error"))
    # both outcomes leave one generator, so turns are gathered and folded once
    one = f"CASE WHEN error IS NULL THEN {segments} ELSE array(CAST(NULL AS STRUCT<turn: BIGINT, role: STRING, text: STRING, loss: BOOLEAN>)) END"
    rows = checked.select("conv_id", "error", F.posexplode(F.expr(one)).alias("segment", "s"))
    return rows.select("conv_id", F.when(F.col("error").isNull(), F.col("segment")).alias("segment"), "s.turn", "s.role", "s.text", "s.loss", "error")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, lag(role) OVER w AS prev, lag(turn) OVER w AS last_turn, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
e AS (SELECT *, CASE WHEN turn IS NULL THEN 'null turn' WHEN turn = last_turn THEN 'repeated turn ' || turn WHEN role IS NULL THEN 'null role at turn ' || turn
  WHEN NOT coalesce((i = 1 AND role IN ('system', 'user')) OR (prev = 'system' AND role = 'user') OR (prev = 'user' AND role = 'assistant') OR (prev = 'assistant' AND role IN ('user', 'tool')) OR (prev = 'tool' AND role = 'assistant'), false)
    THEN role || ' after ' || coalesce(prev, 'start') || ' at turn ' || turn
  WHEN text IS NULL THEN 'null text at turn ' || turn WHEN trim(translate(text, chr(10) || chr(13) || chr(9), '   ')) = '' THEN 'empty text at turn ' || turn
  WHEN i = n AND role <> 'assistant' THEN 'ends after ' || role END AS err FROM o),
f AS (SELECT conv_id, arg_min(err, i) FILTER (err IS NOT NULL) AS error FROM e GROUP BY 1),
s AS (SELECT conv_id, -1 AS i, 0 AS j, CAST(NULL AS BIGINT) AS turn, CAST(NULL AS VARCHAR) AS role, '<|begin|>' || chr(10) AS text, false AS loss FROM f
  UNION ALL SELECT conv_id, i, 0, turn, role, '<|' || role || '|>' || chr(10) || CASE WHEN role = 'assistant' THEN '' ELSE replace(text, '<|', '< |') || '<|end|>' || chr(10) END, false FROM e
  UNION ALL SELECT conv_id, i, 1, turn, role, replace(text, '<|', '< |') || '<|end|>' || chr(10), true FROM e WHERE role = 'assistant'),
g AS (SELECT s.*, f.error FROM s JOIN f USING (conv_id) WHERE f.error IS NULL)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY i, j) - 1 AS INTEGER) AS segment, turn, role, text, loss, error FROM g
UNION ALL SELECT conv_id, NULL, NULL, NULL, NULL, NULL, error FROM f WHERE error IS NOT NULL
"""
