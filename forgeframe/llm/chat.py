"""Chat formatting: turns of a conversation as one marked-up string, and back. DataFrame functions only.

Layout of a conversation, one block for each run of turns of one role:

    <|begin|>ROLE<|says|>TEXT<|turn|>TEXT<|end|>

``<|turn|>`` divides the turns that were merged into one block. Inside roles and texts a backslash is
doubled and ``<|`` becomes ``<\\|``, so none of the marks can occur in them and both can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, SAYS, TURN, END = "<|begin|>", "<|says|>", "<|turn|>", "<|end|>"
#: Turns that are first put together as one row; long conversations are joined from these.
SEGMENT = 64
#: The role whose texts count for the loss.
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _merge(blocks: Column) -> Column:
    """Blocks (role, texts) with neighbours of one role made one."""

    def add(done: Column, block: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.struct(block["role"].alias("role"), F.concat(last["texts"], block["texts"]).alias("texts"))
        return F.when(last["role"] == block["role"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(block)))

    return F.aggregate(blocks, F.expr("cast(array() as array<struct<role:string,texts:array<string>>>)"), add)


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) for each conversation of ``turns`` (conv_id, turn, role, text).

    Turns go by ``turn``, nulls first; rows that share a turn go by role, then text. Null role or text:
    empty. A null conv_id is a conversation of its own. ``loss`` is the loss mask by runs: (chars,
    learned) that cover ``formatted`` from its start: a mark, a text, a mark, a text, ..., the last mark.
    Learned are the assistant's texts. Empty table: no rows. Other columns are ignored.

    Turns are put together in segments of SEGMENT numbers first, so a very long conversation is sorted
    and merged by many tasks, and only finished segments meet in one row, its own output.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    segments = turns.groupBy("conv_id", F.floor(F.col("turn") / SEGMENT).alias("segment")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    blocks = F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), F.array(escape(t["text"])).alias("texts")))
    segments = segments.select("conv_id", F.struct("segment", _merge(blocks).alias("blocks")).alias("part"))
    whole = segments.groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    whole = whole.select("conv_id", F.flatten(F.transform("parts", lambda p: p["blocks"])).alias("blocks"))

    def head(block: Column, i: Column, j: Column) -> Column:
        goes_on = (j > 0) | ((i > 0) & (F.get("blocks", i - 1)["role"] == block["role"]))
        return F.when(goes_on, TURN).otherwise(F.concat(F.when(i > 0, END).otherwise(""), F.lit(BEGIN), block["role"], F.lit(SAYS)))

    def pieces(block: Column, i: Column) -> Column:
        return F.transform(block["texts"], lambda text, j: F.struct(head(block, i, j).alias("head"), text.alias("body"), (block["role"] == LEARNED).alias("learned")))

    whole = whole.select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("pieces"))
    formatted = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), ""), F.lit(END))

    def run(text: Column, learned: Column) -> Column:
        return F.struct(F.length(text).alias("chars"), learned.alias("learned"))

    runs = F.flatten(F.transform("pieces", lambda p: F.array(run(p["head"], F.lit(False)), run(p["body"], p["learned"]))))
    return whole.select("conv_id", formatted.alias("formatted"), F.concat(runs, F.array(run(F.lit(END), F.lit(False)))).alias("loss"))


def learned_texts(chats: DataFrame) -> DataFrame:
    """``chats`` (formatted, loss) with a column learned array<string>: what ``formatted`` holds under each learned run, unescaped.

    Only the runs' lengths say where a text lies. ``formatted`` is first cut at every SEGMENT runs, so that
    a very long conversation isn't walked from its start for each run.
    """
    runs = F.transform(F.sequence(F.lit(0), F.size("loss") - 1, F.lit(SEGMENT)), lambda i: F.slice("loss", i + 1, F.lit(SEGMENT)))

    def chars(of: Column) -> Column:
        return F.aggregate(of, F.lit(0), lambda n, run: n + run["chars"])

    def before(sizes: Column, k: Column) -> Column:
        return F.aggregate(F.slice(sizes, F.lit(1), k), F.lit(0), lambda n, x: n + x)

    def learned(part: Column) -> Column:
        def text(run: Column, j: Column) -> Column:
            return F.when(run["learned"], unescape(F.substring(part["text"], chars(F.slice(part["runs"], F.lit(1), j)) + 1, run["chars"])))

        return F.transform(part["runs"], text)

    out = chats.withColumn("runs\x00", runs)
    out = out.withColumn("sizes\x00", F.transform("runs\x00", chars))
    parts = F.transform("runs\x00", lambda r, k: F.struct(r.alias("runs"), F.substring("formatted", before(F.col("sizes\x00"), k) + 1, F.get("sizes\x00", k)).alias("text")))
    out = out.withColumn("parts\x00", parts)
    texts = F.filter(F.flatten(F.transform("parts\x00", learned)), lambda t: t.isNotNull())
    return out.select(*chats.columns, texts.alias("learned"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """``formatted`` with a column turns array<(role, text)>, read from its column formatted alone."""
    blocks = F.slice(F.split("formatted", "<\\|begin\\|>"), 2, F.size(F.split("formatted", "<\\|begin\\|>")))

    def turns(block: Column) -> Column:
        role = unescape(F.substring_index(block, SAYS, 1))
        body = F.substring_index(F.substring_index(block, SAYS, -1), END, 1)
        return F.transform(F.split(body, "<\\|turn\\|>"), lambda text: F.struct(role.alias("role"), unescape(text).alias("text")))

    return formatted.withColumn("turns", F.flatten(F.transform(blocks, turns)))
