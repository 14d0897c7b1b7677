"""Chat formatting with typed content parts.

A turn's content is plain text, or a JSON array of parts {"type": "text" | "image" | "audio" | "document", ...}. A visitor
flattens the parts in order: text as it is, any other as a numbered placeholder, with an attachment record (number, kind,
reference, turn, expanded tokens). A conversation's turns go by number into one prompt string.

Expanded tokens: text by its whitespace-separated words; an image by its tiles, ceil(width / 28) * ceil(height / 28), 256 where a side isn't
given; audio 25 a second, rounded up, 250 where seconds aren't given; a document 512 a page, 512 where pages aren't given.
Role marks count 4 a turn.

All of it is built-in expressions: one shuffle by conversation, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PART = "type string, text string, url string, width double, height double, seconds double, pages double"
TURN_TOKENS = 4
KINDS = ("image", "audio", "document")
#: What stands for an attachment until all are numbered; texts that hold the first character get it escaped meanwhile.
ESCAPE, SLOT = "\x01", "\x01s"


def parse(text: Column) -> Column:
    """The parts of a turn. What isn't a JSON array of objects that each have a type is one part of text."""
    parts = F.from_json(text, f"array<struct<{PART}>>")
    plain = F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("url"), *(F.lit(None).cast("double").alias(c) for c in ("width", "height", "seconds", "pages"))))
    typed = text.rlike(r"^\s*\[") & parts.isNotNull() & (F.size(parts) > 0) & ~F.exists(parts, lambda p: p.isNull() | p["type"].isNull())
    return F.when(text.isNull(), F.array().cast(f"array<struct<{PART}>>")).when(typed, parts).otherwise(plain)


def part_tokens(p: Column) -> Column:
    """Visitor: the tokens that a part expands to. Parts of an unknown type are treated as text."""
    image = F.coalesce(F.ceil(p["width"] / 28) * F.ceil(p["height"] / 28), F.lit(256))
    audio = F.coalesce(F.ceil(p["seconds"] * 25), F.lit(250))
    document = F.coalesce(F.ceil(p["pages"]) * 512, F.lit(512))
    return F.when(p["type"] == "image", image).when(p["type"] == "audio", audio).when(p["type"] == "document", document).otherwise(common.words(p["text"])).cast("bigint")


def format_chat(turns: DataFrame) -> DataFrame:
    """A row for each conv_id: n_turns, prompt, n_text_tokens, n_attachment_tokens, n_tokens, attachments.

    Turns go by number (nulls first), then role, then text; repeated rows are all kept, ties being equal rows. A null role is 'unknown', a null text an
    empty turn, and both keep their place. Every turn with a null conv_id is a conversation of its own, so they are never brought together. Extra columns aren't read; an empty table
    gives an empty result. Attachments are numbered from 0 in a conversation; without any the array is empty. Texts of any length are taken
    whole; a conversation is one row, which Spark holds up to 2 GB.
    """
    t = common.pick(turns, conv_id="bigint", turn="bigint", role="string", text="string")
    t = t.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    # Parts are read after the shuffle, which then carries each text once.
    c = t.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    c = c.union(t.where("conv_id IS NULL").select("conv_id", F.array("t")))
    c = c.select("conv_id", F.transform("turns", lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), parse(t["text"]).alias("parts"))).alias("turns"))
    flat = F.flatten(F.transform("turns", lambda t: F.transform(t["parts"], lambda p: F.struct(t["turn"].alias("turn"), p["type"].alias("kind"), F.coalesce(p["url"], F.lit("")).alias("ref"), part_tokens(p).alias("tokens")))))
    c = c.select("conv_id", "turns", flat.alias("flat"))
    c = c.withColumn("held", F.filter("flat", lambda x: x["kind"].isin(*KINDS)))
    # An attachment leaves a slot at first. The text is cut at the slots and joined by their numbered marks, so that no turn counts those before it.
    safe = lambda x: F.replace(x, F.lit(ESCAPE), F.lit(f"{ESCAPE}e"))
    plain = lambda x: F.replace(x, F.lit(f"{ESCAPE}e"), F.lit(ESCAPE))
    body = lambda t: F.array_join(F.transform(t["parts"], lambda p: F.when(p["type"].isin(*KINDS), F.lit(SLOT)).otherwise(safe(F.coalesce(p["text"], F.lit(""))))), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(F.lit("<|"), safe(t["role"]), F.lit("|>\n"), body(t), F.lit("<|end|>\n"))), "")
    mark = lambda i: F.concat(F.lit("<|"), F.get(F.col("held"), i - 1)["kind"], F.lit(":"), (i - 1).cast("string"), F.lit("|>"))
    prompt = F.array_join(F.transform(F.split(whole, SLOT, -1), lambda x, i: F.when(i == 0, plain(x)).otherwise(F.concat(mark(i), plain(x)))), "")
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda n, x: n + x["tokens"])
    return c.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), prompt.alias("prompt"),
        (total("flat") - total("held")).alias("n_text_tokens"), total("held").alias("n_attachment_tokens"), (total("flat") + F.size("turns") * TURN_TOKENS).alias("n_tokens"),
        F.transform("held", lambda x, i: F.struct(i.cast("bigint").alias("number"), x["kind"].alias("kind"), x["ref"].alias("ref"), x["turn"].alias("turn"), x["tokens"].alias("tokens"))).alias("attachments"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments as a JSON string, which both engines compare alike."""
    return format_chat(common.table(spark, sf_dir, "conversations")).withColumn("attachments", F.to_json("attachments"))


def typed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations with attachments: of every four turns, one gets an image after its text, one audio before it, and one becomes a document and an image of unknown size."""
    part = lambda **x: F.struct(*(x.get(c, F.lit(None)).cast(t).alias(c) for c, t in (f.split() for f in PART.split(", "))))
    text = part(type=F.lit("text"), text=F.coalesce("text", F.lit("")))
    ref = F.concat_ws("-", "conv_id", "turn")
    image = part(type=F.lit("image"), url=ref, width=F.lit(100), height=F.lit(57))
    audio = part(type=F.lit("audio"), url=ref, seconds=F.lit(1.5))
    parts = F.when(F.col("turn") % 4 == 1, F.array(text, image)).when(F.col("turn") % 4 == 2, F.array(audio, text)).when(F.col("turn") % 4 == 3, F.array(part(type=F.lit("document"), url=ref, pages=F.lit(3)), part(type=F.lit("image"))))
    t = common.table(spark, sf_dir, "conversations").withColumn("text", F.coalesce(F.to_json(parts), "text"))
    return format_chat(t).withColumn("attachments", F.to_json("attachments"))


_WORDS = "coalesce(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')), 0)"
#: Over plain texts, which are all that the conversations table holds; TYPED_SQL is over typed parts.
ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, turn, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS s, {_WORDS} AS n, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations)
SELECT conv_id, count(*) AS n_turns, string_agg(s, '' ORDER BY turn NULLS FIRST, role, text) AS prompt,
       CAST(sum(n) AS BIGINT) AS n_text_tokens, CAST(0 AS BIGINT) AS n_attachment_tokens, CAST(sum(n) + 4 * count(*) AS BIGINT) AS n_tokens, '[]' AS attachments
FROM t WHERE conv_id IS NOT NULL GROUP BY conv_id
UNION ALL SELECT conv_id, 1, s, CAST(n AS BIGINT), CAST(0 AS BIGINT), CAST(n + 4 AS BIGINT), '[]' FROM t WHERE conv_id IS NULL
"""
TYPED_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, {_WORDS} AS words, turn % 4 AS k, conv_id || '-' || turn AS ref FROM conversations),
c AS (SELECT *, CASE k WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS held, CASE k WHEN 1 THEN 12 WHEN 2 THEN 38 WHEN 3 THEN 1792 ELSE 0 END AS more, CASE k WHEN 3 THEN 0 ELSE words END AS n FROM t),
w AS (SELECT *, CAST(coalesce(sum(held) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM c),
r AS (SELECT *, CASE k WHEN 1 THEN text || '<|image:' || b || '|>' WHEN 2 THEN '<|audio:' || b || '|>' || text WHEN 3 THEN '<|document:' || b || '|><|image:' || (b + 1) || '|>' ELSE text END AS body,
  CASE k WHEN 1 THEN '{{"number":' || b || ',"kind":"image","ref":"' || ref || '","turn":' || turn || ',"tokens":12}}' WHEN 2 THEN '{{"number":' || b || ',"kind":"audio","ref":"' || ref || '","turn":' || turn || ',"tokens":38}}'
    WHEN 3 THEN '{{"number":' || b || ',"kind":"document","ref":"' || ref || '","turn":' || turn || ',"tokens":1536}},{{"number":' || (b + 1) || ',"kind":"image","ref":"","turn":' || turn || ',"tokens":256}}' END AS a FROM w)
SELECT conv_id, count(*) AS n_turns, string_agg('<|' || role || '|>' || chr(10) || body || '<|end|>' || chr(10), '' ORDER BY turn) AS prompt,
       CAST(sum(n) AS BIGINT) AS n_text_tokens, CAST(sum(more) AS BIGINT) AS n_attachment_tokens, CAST(sum(n) + sum(more) + 4 * count(*) AS BIGINT) AS n_tokens, '[' || coalesce(string_agg(a, ',' ORDER BY turn), '') || ']' AS attachments
FROM r GROUP BY conv_id
"""
