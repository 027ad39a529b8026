"""Chat formatting with Spark expressions only.

A conversation becomes one string: `<s>`, then for each block of adjacent turns of one role `<|role|>`, the texts of its
turns with `<|next|>` between them, and `</s>`. Control strings inside texts are escaped (`&` as `&amp;`, then the `<` of
`<|`, `<s>` and `</s>` as `&lt;`, and in roles every `>` as `&gt;`), so a text can neither close its turn nor open another, and the output
reads back exactly. The loss mask is the segment list: `segments` cuts the formatted string into pieces and marks those that are
assistant text; `loss_text` reads the same text back from the formatted string alone.

Nulls: a null text or role counts as empty; a null turn sorts first; rows with a null conv_id form one conversation. Rows that
tie in turn are ordered by role, then text; repeated rows are repeated turns. An empty table gives no rows. Other columns are
ignored. A conversation is one row of output, so one task holds one conversation at a time, never more; very long texts are whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, read

BEGIN, NEXT, END = "<s>", "<|next|>", "</s>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for control in ("<|", BEGIN, END):
        out = F.replace(out, F.lit(control), F.lit("&lt;" + control[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("&gt;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&gt;"), F.lit(">")))


def _blocks(turns: Column) -> Column:
    """Runs of adjacent turns of one role: array of (role, texts). Linear in the number of turns."""

    def cut(starts: Column) -> Column:
        return F.transform(
            starts,
            lambda s, k: F.struct(
                F.get(turns, s)["role"].alias("role"),
                F.transform(F.slice(turns, s + 1, F.coalesce(F.get(starts, k + 1), F.size(turns)) - s), lambda t: t["text"]).alias("texts"),
            ),
        )

    first = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    return let(first, cut)


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def _segments(blocks: Column) -> Column:
    """The formatted string in pieces, each marked as under the loss mask or not."""
    no = F.lit(False)

    def block(b: Column) -> Column:
        said = F.transform(
            b["texts"],
            lambda t, j: F.when(j == 0, F.array(_segment(escape(t), b["role"] == "assistant"))).otherwise(
                F.array(_segment(F.lit(NEXT), no), _segment(escape(t), b["role"] == "assistant"))
            ),
        )
        head = F.concat(F.lit("<|"), escape_role(b["role"]), F.lit("|>"))
        return F.concat(F.array(_segment(head, no)), F.flatten(said), F.array(_segment(F.lit(END), no)))

    return F.concat(F.array(_segment(F.lit(BEGIN), no)), F.flatten(F.transform(blocks, block)))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted string, segments array<struct<text, loss>>, n_blocks."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    blocks = whole.select("conv_id", let(_blocks(F.col("turns")), lambda b: F.struct(F.size(b).alias("n_blocks"), _segments(b).alias("segments"))).alias("o"))
    return blocks.select("conv_id", F.array_join(F.transform("o.segments", lambda s: s["text"]), "").alias("formatted"), "o.segments", "o.n_blocks")


def parse(formatted: Column) -> Column:
    """The turns of a formatted string: array of (role, text)."""
    body = F.substr(formatted, F.lit(len(BEGIN) + 1))
    blocks = F.filter(F.split(body, END), lambda b: b != "")

    def turns(b: Column) -> Column:
        return let(
            F.split(b, r"\|>", 2),
            lambda p: F.transform(
                F.split(F.get(p, F.lit(1)), r"<\|next\|>"),
                lambda t: F.struct(unescape_role(F.substr(F.get(p, F.lit(0)), F.lit(3))).alias("role"), unescape(t).alias("text")),
            ),
        )

    return F.flatten(F.transform(blocks, turns))


def loss_text(turns: Column) -> Column:
    """All text under the loss mask, unescaped, in order, from the turns that parse() reads back."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{probe}'), (-7L, 1L, 'assistant', '{probe}') AS t(conv_id, turn, role, text)")
    out = format_conversations(rows.unionByName(extra))
    back = out.select("conv_id", parse(F.col("formatted")).alias("t"), F.length("formatted").cast("long").alias("formatted_chars"), "n_blocks")
    back = back.withColumn("loss", loss_text(F.col("t")))
    return back.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        F.col("n_blocks").cast("long").alias("n_blocks"),
    )


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, replace(replace(replace(replace(text, '&', '&amp;'), '<|', '&lt;|'), '<s>', '&lt;s>'), '</s>', '&lt;/s>') AS esc,
         coalesce(lag(role) OVER w <> role, true) AS opens
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(length(esc)) + sum(CASE WHEN opens THEN length(role) + 8 ELSE 8 END))::BIGINT AS formatted_chars,
  count(*) FILTER (opens)::BIGINT AS n_blocks
FROM e GROUP BY conv_id
"""
