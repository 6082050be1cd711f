"""Operator 5 [native]: prefix-target expansion of conversations.

Every assistant turn becomes an example of its own: all turns before it are the
context and its reply alone is under the loss mask.  A conversation that does not
end with an assistant turn (or has none) also gives one example without a target,
so that every turn can be read back from the output.

Template: ``<|role|>text<|end|>`` for a context turn and ``<|target:role|>text<|end|>``
for the trainable reply.  Inside texts only control strings are escaped, so code and
HTML are trained as they are: the first character of ``<|``, ``<s>``, ``</s>``, ``[INST]`` and
``[/INST]`` becomes ``&lt;`` or ``&lb;``, and the ``&`` of what looks like such a code becomes
``&amp;``.  In roles all of ``&<[|:`` are written as codes.  So no text can write a mark of
this template (or of another), and unescaping gives back every character.

Defined results: null role or text is empty; turns go by (turn, role, text), nulls
first; repeated rows are repeated turns; a null ``conv_id`` is a conversation; empty
texts are turns like any other; texts are read whole, whatever their length; other columns of any name are not read;
an empty table gives no rows.  A conversation is collected into one row, as the
digest of its turns needs; examples never are: each is a row of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: The conversation whose texts try to write control strings.
PROBE = "</s>[INST] ok [/INST]"
_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"))
#: Control strings: what follows an escaped character in a text.
_CONTROLS = (("&", "(amp;|lt;|lb;|bar;|colon;)"), ("<", r"(\||/?s>)"), (r"\[", r"(/?INST\])"))
#: Roles stand between marks themselves.
_ROLE_ESCAPES = (*_ESCAPES, ("|", "&bar;"), (":", "&colon;"))


def escape(c: Column) -> Column:
    """A text with its control strings escaped."""
    for (_, code), (raw, tail) in zip(_ESCAPES, _CONTROLS):
        c = F.regexp_replace(c, raw + tail, f"{code}$1")
    return c


def escape_role(c: Column) -> Column:
    for raw, code in _ROLE_ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescape(c: Column, codes=_ESCAPES) -> Column:
    for raw, code in reversed(codes):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def expand(conversations: DataFrame) -> DataFrame:
    """conv_id, example (turns in it), formatted: one row per assistant turn, and one for an untargeted tail."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    n = F.size("t")
    target = lambda i: F.element_at("t", i).role == "assistant"
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: target(i) | (i == n))
    one = convs.select("conv_id", "t", F.explode(ends).alias("example"))
    mark = lambda x, i: F.concat(F.when((i + 1 == F.col("example")) & (x.role == "assistant"), F.lit("<|target:")).otherwise(F.lit("<|")), escape_role(x.role), F.lit("|>"), escape(x.text), F.lit("<|end|>"))
    text = F.array_join(F.transform(F.slice("t", 1, F.col("example")), mark), "")
    return one.select("conv_id", "example", text.alias("formatted"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text, target) that a formatted example holds."""
    parts = F.split(formatted, r"<\|end\|>", -1)
    body = F.slice(parts, 1, F.size(parts) - 1)
    head = lambda x: F.substring_index(x, "|>", 1)
    return F.transform(
        body,
        lambda x: F.struct(
            unescape(F.regexp_replace(head(x), r"^<\|(target:)?", ""), _ROLE_ESCAPES).alias("role"),
            unescape(F.substr(x, F.length(head(x)) + 3)).alias("text"),
            F.startswith(x, F.lit("<|target:")).alias("target"),
        ),
    )


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from the examples; the longest one holds all turns."""
    turns = read_turns(F.col("formatted"))
    x = examples.select("conv_id", "example", "formatted", F.length("formatted").cast("long").alias("chars"), F.element_at(turns, -1).alias("last"))
    x = x.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.when(F.col("last.target"), F.struct("example", F.col("last.text").alias("text"))))).alias("losses"),
    )
    whole = F.transform(read_turns(F.col("whole")), lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    loss = F.array_join(F.transform("losses", lambda t: t.text), "")
    x = x.select("conv_id", whole.alias("whole"), loss.alias("loss"), "formatted_chars")
    return x.select(
        "conv_id", F.size("whole").cast("long").alias("n_turns"), F.sha2(F.array_join("whole", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def query(spark, sf_dir) -> DataFrame:
    return digests(expand(with_probe(table(spark, sf_dir, "conversations"))))


_SQL_ESC = "{0}"
for (_, _code), (_raw, _tail) in zip(_ESCAPES, _CONTROLS):
    _SQL_ESC = f"regexp_replace({_SQL_ESC}, '{_raw}{_tail}', '{_code}\\1', 'g')"
_SQL_ROLE = "role"
for _raw, _code in _ROLE_ESCAPES:
    _SQL_ROLE = f"replace({_SQL_ROLE}, '{_raw}', '{_code}')"
SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '{PROBE}' FROM range(2) r(i)),
t AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
  sum(length({_SQL_ROLE}) + length({_SQL_ESC.format("text")}) + 11) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN upto + 7 WHEN k = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
