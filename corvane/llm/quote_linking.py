"""Conversations without quotes: quoted passages linked to the messages they come from.

A line's quote level is the number of `>` before its text (spaces between them allowed). Runs of lines
of one level are blocks. A message's own text is its lines of level 0. Passages are blocks, their
paragraphs (text between blank lines) and their lines; they are
normalised (A-Z lower-cased, white space collapsed) and hashed. Those of level 1 and more are joined,
within their conversation, to the earliest turn before the message whose own text has the passage, as a
whole, as a paragraph or as a line. The join is 1 to 1 at most: the
originals are first reduced to the earliest turn for each (conversation, passage).

A message's parent is the latest turn that its shallowest linked quotes come from, whole blocks
before paragraphs and those before single lines. Messages without a linked quote start a thread. `root_turn` and `depth` follow the
parents by pointer doubling, so a thread of n replies takes log2(n) rounds. Sorted by (conv_id,
root_turn, turn) a conversation is in reply order: a parent is an earlier turn of the same thread, so
it comes before all its replies. No conversation is collected into one row or task.

Messages are parsed once: bodies and the passages' hashes (16 bytes each) are a written table, which all later
steps read by columns.

Edge cases: a null or empty text has an empty body and no quotes; line ends become line feeds, and bodies have
no white space around them, whether or not there is a quote; a passage that is empty once
normalised is not linked; rows with a null conv_id or turn are kept and link to nothing; repeated (conv_id, turn)
rows are one turn, and keep their rows; a quote of a later or unknown message is dropped
from the body and stays unlinked; an empty table gives no rows; of further columns only those named
in `keep` are carried, under any name but those of the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from corvane.llm.common import Scratch, quoted

#: Fixed value: the marks before a quoted line's text.
MARKS = "^(?:[ \\\\t]*>)+[ \\\\t]?"

LINES = "split(regexp_replace(coalesce(text, ''), '\\r\\n?', '\n'), '\n')"
#: lines as (level, text)
LEVELLED = f"transform({LINES}, x -> struct(length(regexp_replace(regexp_extract(x, '{MARKS}', 0), '[^>]', '')) AS level, regexp_replace(x, '{MARKS}', '') AS line))"
#: first lines of blocks
STARTS = "filter(sequence(0, size(lines) - 1), i -> i = 0 OR lines[i].level <> lines[i - 1].level)"
BLOCKS = "transform(starts, (s, k) -> struct(lines[s].level AS level, array_join(slice(lines.line, s + 1, coalesce(get(starts, k + 1), size(lines)) - s), '\n') AS body))"
#: how much of a block a passage is: more counts first
LINE, PARAGRAPH, WHOLE = 0, 1, 2
SPACE = "' \t\n\r\f'"


def _normal(x: str) -> str:
    return f"trim(regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\\\\s+', ' '))"


def _passages(text: str, level: str) -> str:
    """(level, part, passage) of a text's whole, paragraphs and lines."""
    part = lambda rows, n: f"transform({rows}, x -> struct({level} AS level, {n} AS part, {_normal('x')} AS passage))"
    return f"concat({part(f'array({text})', WHOLE)}, {part(f'split({text}, {PARA})', PARAGRAPH)}, {part(f'split({text}, {NEWLINE})', LINE)})"


PARA, NEWLINE = "'\n[ \t]*\n'", "'\n'"


def _hashed(passages: str) -> str:
    """Passages that aren't empty, as (level, part, h)."""
    return f"array_distinct(transform(filter({passages}, p -> p.passage <> ''), p -> struct(p.level AS level, p.part AS part, unhex(md5(p.passage)) AS h)))"


def parse(messages: DataFrame) -> DataFrame:
    """Adds body, n_quotes, quotes and own to (conv_id, turn, text): quotes are (level, part, h) of quoted passages, own the hashes of the body's.

    A message without `>` is its own body; only others are cut into blocks.
    """
    marked = F.expr("coalesce(text, '') LIKE '%>%'")
    whole = F.expr(f"trim(BOTH {SPACE} FROM array_join({LINES}, '\n'))")
    none = "CAST(array() AS array<struct<level:int,part:int,h:binary>>)"
    plain = messages.where(~marked).withColumns({"body": whole, "n_quotes": F.lit(0).cast("bigint"), "quotes": F.expr(none)})
    cut = messages.where(marked).withColumn("lines", F.expr(LEVELLED)).withColumn("starts", F.expr(STARTS)).withColumn("blocks", F.expr(BLOCKS))
    cut = cut.withColumn("asked", F.expr(f"filter(blocks, b -> b.level > 0 AND {_normal('b.body')} <> '')"))
    body = f"trim(BOTH {SPACE} FROM array_join(filter(lines, x -> x.level = 0).line, '\n'))"
    quotes = _hashed("flatten(transform(asked, b -> " + _passages("b.body", "b.level") + "))")
    cut = cut.withColumns({"body": F.expr(body), "n_quotes": F.expr("CAST(size(asked) AS bigint)"), "quotes": F.expr(quotes)})
    both = plain.unionByName(cut.drop("lines", "starts", "blocks", "asked"))
    return both.withColumn("own", F.expr(f"array_distinct({_hashed(_passages('body', '0'))}.h)")).drop("text")


def link(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, level, part, h, source_turn) of every quoted passage with an original."""
    asked = parsed.where(F.size("quotes") > 0).select("conv_id", "turn", F.expr("inline(quotes)")).distinct()
    wanted = asked.select("conv_id", "h").distinct()
    own = parsed.select("conv_id", F.col("turn").alias("source_turn"), F.explode("own").alias("h")).join(wanted, ["conv_id", "h"], "left_semi")
    first = own.groupBy("conv_id", "h").agg(F.min("source_turn").alias("source_turn"))
    return asked.join(first, ["conv_id", "h"]).where("source_turn < turn")


def threads(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, root_turn, depth) of (conv_id, turn, parent_turn): every turn with a parent."""
    now = scratch.put(parents.select("conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).alias("depth")), "threads0")
    for k in range(1, 64):
        up = now.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("next"), F.col("depth").alias("more"))
        step = now.join(up, ["conv_id", "root_turn"], "left")
        if k > 1 and step.where("next IS NOT NULL").isEmpty() or k == 1 and now.isEmpty():
            return now
        now = scratch.put(step.select("conv_id", "turn", F.coalesce("next", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), f"threads{k}")
        scratch.drop(f"threads{k - 1}")
    return now


def conversations(messages: DataFrame, keep: Sequence[str] = ("role",), conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """Every message as (conv_id, turn, *keep, body, n_quotes, n_linked, parent_turn, root_turn, depth)."""
    scratch = Scratch(messages.sparkSession, "quotes")
    held = {f"_keep{k}": c for k, c in enumerate(keep)}
    base = messages.select(quoted(conv_col).alias("conv_id"), quoted(turn_col).alias("turn"), *[quoted(c).alias(k) for k, c in held.items()], quoted(text_col).alias("text"))
    parsed = scratch.put(parse(base), "parsed")
    links = scratch.put(link(parsed), "links")
    best = F.max(F.struct((-F.col("level")).alias("shallow"), "part", "source_turn"))
    parents = scratch.put(links.groupBy("conv_id", "turn").agg(best.alias("best"), F.countDistinct("level", "h").cast("bigint").alias("n_linked")).select("conv_id", "turn", F.col("best.source_turn").alias("parent_turn"), "n_linked"), "parents")
    scratch.drop("links")
    tree = parents.join(threads(parents, scratch), ["conv_id", "turn"])
    joined = parsed.select("conv_id", "turn", *held, "body", "n_quotes").join(tree, ["conv_id", "turn"], "left")
    rest = ["body", "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth")]
    return joined.select("conv_id", "turn", *[F.col(k).alias(c) for k, c in held.items()], *rest)
