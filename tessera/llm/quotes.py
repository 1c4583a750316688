"""Linking quotations to the messages that they quote.

Lines that begin with ``>`` are quoted, as deep as there are such marks. Neighbouring lines of one depth form a passage. Its
text is normalised, to lower-case letters and digits with single blanks, and hashed; the same is done with what a message itself says: the
whole, each paragraph and each line. A passage comes from the first message of the conversation that says it, if that is an earlier one.
A passage that no earlier message says as one of these is looked for by its paragraphs, and a paragraph that is not found by its lines, so that any choice
of whole lines of a message is found; each part has its own source.
A message replies to the latest message of which it quotes a passage at its smallest depth that is found; others begin a thread.
Conversations are then ordered by thread and turn, with the quotes taken out.

Only DataFrame functions are used. All groups are keyed by conversation and hash, so a long conversation or a frequent line is summed up
in the tasks first and no group is gathered. Threads are found by pointer doubling.

Defined cases: a null or empty text says and quotes nothing; passages without letters or digits are not looked for; a row with a null
conversation or turn is not linked and begins its own thread; rows with equal conversation and turn are one message for
links and stay separate rows; an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialise

_MARKS = r"^((?:[ \t]*>)+)"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _depth(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[^>]", ""))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r")


def unquoted(text: Column) -> Column:
    """The text without its quoted lines and without blank lines at its ends."""
    own = F.array_join(F.filter(_lines(text), lambda x: ~x.rlike(_MARKS)), "\n")
    return F.regexp_replace(F.regexp_replace(own, r"^(?:[ \t]*\n)+", ""), r"(?:\n[ \t]*)+$", "")


def quoted_passages(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, message, depth, line, passage) of each quoted passage, line being its first line's number from 0."""
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(text_col).alias("text")).where(F.col("text").rlike(r"(?m)" + _MARKS)).distinct()
    lines = rows.select("conv_id", "turn", F.xxhash64("text").alias("message"), F.posexplode(_lines(F.col("text"))).alias("line", "said"))
    lines = lines.where(F.col("said").rlike(_MARKS)).withColumn("depth", _depth(F.col("said"))).withColumn("said", F.regexp_replace("said", _MARKS + r"[ \t]?", ""))
    run = F.col("line") - F.row_number().over(Window.partitionBy("conv_id", "turn", "message", "depth").orderBy("line"))
    passages = lines.withColumn("run", run).groupBy("conv_id", "turn", "message", "depth", "run").agg(F.min("line").alias("line"), F.array_sort(F.collect_list(F.struct("line", "said"))).alias("all"))
    return passages.select("conv_id", "turn", "message", "depth", "line", F.array_join(F.transform("all", lambda x: x["said"]), "\n").alias("passage"))


def _parts(passages: DataFrame) -> DataFrame:
    """The passages with (level, paragraph, offset, part): a row for the whole, each paragraph and each line, offset being its first line's number in the passage."""
    none = F.lit(-1)
    blank = lambda x: F.trim(F.translate(x, "\t", " ")) == ""
    numbered = F.transform("said", lambda x, i: F.struct(i.alias("at"), x.alias("text")))
    rows = passages.withColumn("said", F.split("passage", "\n"))
    whole = rows.select("*", F.lit(0).alias("level"), none.alias("paragraph"), F.lit(0).alias("offset"), F.col("passage").alias("part")).drop("said")
    lines = rows.where(F.size("said") > 1).select("*", F.explode(numbered).alias("one")).select("*", F.col("one.at").alias("offset"), F.col("one.text").alias("text"))
    run = Window.partitionBy("conv_id", "turn", "message", "depth", "line").orderBy("offset")
    lines = lines.withColumn("paragraph", F.sum(blank(F.col("text")).cast("int")).over(run).cast("int")).where(~blank(F.col("text")))
    per_line = lines.select("conv_id", "turn", "message", "depth", "line", "passage", F.lit(2).alias("level"), "paragraph", "offset", F.col("text").alias("part"))
    paragraphs = lines.groupBy("conv_id", "turn", "message", "depth", "line", "passage", "paragraph").agg(F.min("offset").alias("offset"), F.array_sort(F.collect_list(F.struct("offset", "text"))).alias("all"))
    paragraphs = paragraphs.select("conv_id", "turn", "message", "depth", "line", "passage", F.lit(1).alias("level"), "paragraph", "offset", F.array_join(F.transform("all", lambda x: x["text"]), "\n").alias("part"))
    return whole.unionByName(paragraphs).unionByName(per_line)


def linked_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, depth, line, passage, source) of each quoted passage, or of its paragraphs or lines where it is not found as one;
    source is the turn that it comes from, null if not found."""
    key = lambda text: F.sha2(_normal(text), 256)
    asked = _parts(quoted_passages(messages, conv_col, turn_col, text_col)).withColumn("key", key(F.col("part"))).withColumn("bare", F.length(_normal(F.col("part"))) == 0)
    own = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), unquoted(F.col(text_col)).alias("body")).where("conv_id is not null and turn is not null and body != ''")
    parts = F.array_distinct(F.concat(F.array("body"), F.split("body", r"\n[ \t]*\n"), _lines(F.col("body"))))
    said = own.select("conv_id", "turn", F.explode(F.array_distinct(F.transform(parts, _normal))).alias("part")).where("part != ''")
    # only passages that are asked for can be sources
    wanted = asked.where("not bare").select("conv_id", "key").distinct()
    first = said.select("conv_id", F.sha2("part", 256).alias("key"), "turn").join(wanted, ["conv_id", "key"], "left_semi").groupBy("conv_id", "key").agg(F.min("turn").alias("source"))
    joined = asked.join(first, ["conv_id", "key"], "left").withColumn("source", F.when(~F.col("bare") & (F.col("source") < F.col("turn")), F.col("source")))
    # of each line that one asks for, the largest part that is found counts, else the passage as a whole
    found = F.col("source").isNotNull()
    within = Window.partitionBy("conv_id", "turn", "message", "depth", "line")
    above = Window.partitionBy("conv_id", "turn", "message", "depth", "line", "paragraph")
    joined = joined.withColumn("whole", F.max(found & (F.col("level") == 0)).over(within)).withColumn("paragraphs", F.max(found & (F.col("level") == 1)).over(above)).withColumn("any", F.max(found).over(within))
    kept = (F.col("level") == 0) & (F.col("whole") | ~F.col("any")) | ~F.col("whole") & found & ((F.col("level") == 1) | (F.col("level") == 2) & ~F.col("paragraphs"))
    return joined.where(kept).select("conv_id", "turn", "depth", (F.col("line") + F.col("offset")).alias("line"), F.col("part").alias("passage"), "source")


def reply_ordered(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most_rounds: int = 40) -> DataFrame:
    """(conv_id, turn, role, content, reply_to, thread, depth, sources) of each row: its text without quotes, the turn it replies to (null:
    none), the turn that begins its thread, how many replies lead there, and all quoted turns. Sorted by conversation, thread
    and turn the rows are the conversations in the order of replies."""
    links = materialise(linked_quotes(messages, conv_col, turn_col, text_col).where("source is not null").select("conv_id", "turn", "depth", "source"), "links")
    per_message = links.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("depth")).alias("d"), F.col("source").alias("source"))).alias("best"), F.array_sort(F.collect_set("source")).alias("sources"))
    up = materialise(per_message.select("conv_id", "turn", F.col("best.source").alias("reply_to"), "sources", F.col("best.source").alias("thread"), F.lit(1).alias("depth")), "replies")
    for _ in range(most_rounds):
        step = up.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("above"), F.col("depth").alias("more"))
        joined = up.join(step, ["conv_id", "thread"], "left")
        if joined.where("above is not null").isEmpty():
            break
        up = materialise(joined.select("conv_id", "turn", "reply_to", "sources", F.coalesce("above", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "replies")
    else:
        raise RuntimeError("the threads did not settle")
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), unquoted(F.col(text_col)).alias("content"))
    out = rows.join(up, ["conv_id", "turn"], "left")
    none = F.array().cast(out.schema["sources"].dataType)
    return out.select("conv_id", "turn", "role", "content", "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("sources", none).alias("sources"))
