"""Chat formatting by event-sourced reconstruction (DataFrame functions only).

A log of events is folded into final messages, which are rendered with a template that escapes its own
control strings inside texts.

Events: ``conv_id, seq, turn, kind, role, text`` with ``kind``
  * ``message``: opens a message at its turn (several at one turn stay apart, in order of seq, role, text);
  * ``delta``: its text is appended to the last message of its turn (opens one if there is none);
  * ``edit``: replaces the text of the last message of its turn (and its role, if it gives one);
  * ``regenerate``: replaces all messages of its turn and voids whatever came before it at later turns.

Defined cases: null text or role is the empty string; an unknown or null kind counts as ``message``;
null conv_id, turn or seq are values of their own, sorted first; repeated rows stay repeated; an empty
log gives no rows; columns beyond these six are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.session import table

# Fixed values of the template.
TURN_OPEN, ROLE_END, TURN_CLOSE = "### ", ": ", "</turn>\n"
#: In this order to escape, in the opposite order to read back. No escaped text holds a control string.
ESCAPES = (("\\", "\\b"), ("</turn>", "\\e"), ("###", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escaped(text: Column, pairs=ESCAPES) -> Column:
    for plain, code in pairs:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, pairs=ESCAPES) -> Column:
    for plain, code in reversed(pairs):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, turn, part, role, text``; the output stays partitioned by conversation."""
    e = F.struct(
        F.col("seq"),
        F.coalesce("kind", F.lit("message")).alias("kind"),
        F.col("role").alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = events.groupBy("conv_id", "turn").agg(
        F.sort_array(F.collect_list(e)).alias("log"),
        F.max(F.when(F.col("kind") == "regenerate", F.coalesce("seq", F.lit(-1)))).alias("regen"),
    )
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("void", F.max("regen").over(before))
    log = F.filter("log", lambda x: F.col("void").isNull() | (F.coalesce(x.seq, F.lit(-1)) > F.col("void")))
    entry = lambda role, text: F.struct(F.coalesce(role, F.lit("")).alias("role"), text.alias("text"))
    none = F.array().cast("array<struct<role:string,text:string>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        rest = F.slice(acc, F.lit(1), F.size(acc) - 1)
        return (
            F.when(x.kind == "regenerate", F.array(entry(x.role, x.text)))
            .when(
                (x.kind == "delta") & (F.size(acc) > 0),
                F.concat(rest, F.array(entry(last.role, F.concat(last.text, x.text)))),
            )
            .when(
                (x.kind == "edit") & (F.size(acc) > 0),
                F.concat(rest, F.array(entry(F.coalesce(x.role, last.role), x.text))),
            )
            .otherwise(F.concat(acc, F.array(entry(x.role, x.text))))
        )

    plain = F.forall("live", lambda x: ~x.kind.isin("delta", "edit", "regenerate"))
    folded = F.when(plain, F.transform("live", lambda x: entry(x.role, x.text))).otherwise(
        F.aggregate("live", none, step)
    )
    return (
        turns.withColumn("live", log)
        .select("conv_id", "turn", F.posexplode(folded).alias("part", "m"))
        .select("conv_id", "turn", "part", "m.role", "m.text")
    )


def render(messages: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans``: spans are (start, len) in code points of each assistant text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "part", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    head = F.concat(F.lit(TURN_OPEN), escaped(F.col("role"), ROLE_ESCAPES), F.lit(ROLE_END))
    rows = (
        messages.select("conv_id", "turn", "part", "role", "text", head.alias("head"), escaped(F.col("text")).alias("body"))
        .withColumn("start", F.coalesce(F.sum(F.length("head") + F.length("body") + len(TURN_CLOSE)).over(before), F.lit(0)))
    )
    one = F.struct(
        "turn", "part", "start",
        F.concat("head", "body", F.lit(TURN_CLOSE)).alias("piece"),
        F.when(F.col("role") == "assistant", F.struct((F.col("start") + F.length("head")).alias("start"), F.length("body").cast("long").alias("len"))).alias("span"),
    )
    got = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("got"))
    return got.select(
        "conv_id",
        F.array_join(F.transform("got", lambda x: x.piece), "").alias("formatted"),
        F.filter(F.transform("got", lambda x: x.span), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def parse(rendered: DataFrame) -> DataFrame:
    """Reads a rendering back: adds ``turns``, an array of (role, text), and ``loss``, the texts under ``loss_spans``.

    Both come from ``formatted`` alone: turns by its control strings, the loss texts by cutting at the spans, in an
    encoding of four bytes a code point, so that a cut costs its own length wherever it lies.
    """
    pieces = F.filter(F.split("formatted", F.lit("</turn>\\n")), lambda x: x != "")
    role_raw = lambda x: F.substring_index(F.substr(x, F.lit(len(TURN_OPEN) + 1)), ROLE_END, 1)
    body_of = lambda x: F.substr(x, F.length(role_raw(x)) + len(TURN_OPEN) + len(ROLE_END) + 1)
    turns = F.transform(
        pieces,
        lambda x: F.struct(unescaped(role_raw(x), ROLE_ESCAPES).alias("role"), unescaped(body_of(x)).alias("text")),
    )
    # A letter before each cut keeps a leading byte order mark from being taken for one.
    wide = lambda text: F.encode(text, "UTF-32")
    cut = lambda u, x: F.substr(F.decode(F.concat(wide(F.lit("|")), F.substring(u, (4 * x.start + 1).cast("int"), (4 * x.len).cast("int"))), "UTF-32"), F.lit(2))
    cuts = F.transform(F.array(wide(F.col("formatted"))), lambda u: F.transform("loss_spans", lambda x: unescaped(cut(u, x))))
    return rendered.withColumn("turns", turns).withColumn("loss", F.get(cuts, F.lit(0)))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` plus conversation -7, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = "r'\\### Assistant: </turn> ok'"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', {own}), (-7L, 1L, 'assistant', {own}) AS t(conv_id, turn, role, text)")
    events = rows.unionByName(extra).select(
        "conv_id", F.col("turn").alias("seq"), "turn", F.lit("message").alias("kind"), "role", "text"
    )
    got = parse(render(reconstruct(events)))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return got.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.array_join("loss", "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.aggregate("loss_spans", F.lit(0).cast("long"), lambda a, s: a + s.len).alias("span_chars"),
    ).select(
        "conv_id", "n_turns", "turns_sha256",
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars", "span_chars",
    )


_E = "replace(replace(replace({}, '\\', '\\b'), '</turn>', '\\e'), '###', '\\h')"
OP10_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
l AS (SELECT *, length({_E.format('text')}) AS body,
             length(replace({_E.format('role')}, ':', '\\c')) AS head FROM c),
g AS (SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum(head + body + 14) AS formatted_chars,
        coalesce(sum(body) FILTER (role = 'assistant'), 0) AS span_chars
      FROM l GROUP BY conv_id)
SELECT conv_id::BIGINT AS conv_id, n_turns::BIGINT AS n_turns, sha256(whole) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
  sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars, span_chars::BIGINT AS span_chars
FROM g
"""

QUERIES = {"op10_chat_formatting": op10_chat_formatting}
ORACLE_SQL = {"op10_chat_formatting": OP10_SQL}
