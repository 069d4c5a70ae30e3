"""Block order, and cutting a long history into segments of bounded context.

A boundary follows an assistant message once the running context passes the limit; the running
total then restarts at the size of the text kept from before. Kept text is the tail of all labelled
texts so far, at most ``recent`` bytes and cut between characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.text import split_offset, utf8_tail
from palaver.operators.ordered import row_position, running_sum, top_per_key
from palaver.session import durable

# Context limit, kept text, and the labels of kept text.
CONTEXT_BYTES = 192 * 1024
RECENT_BYTES = 16 * 1024
LABELS = {"user": "[User]: ", "assistant": "[Assistant]: "}
EMPTY_RECENT = "[Assistant]: Earlier imported messages remain stored in this session."
_GAP = "\n\n"
_BUCKET = 1024


def order_blocks(texts: DataFrame, reasoning: DataFrame, tools: DataFrame) -> DataFrame:
    """All blocks of a message in one order: entry index, then reasoning, text, tool.

    Each table: session_id, message_id, block_index, and its own columns; texts may add sub_rank.
    """
    parts = [(reasoning, "reasoning", 0), (texts, "text", 1), (tools, "tool", 2)]
    merged = None
    for table, kind, rank in parts:
        rows = table.withColumn("type", F.lit(kind)).withColumn("rank", F.lit(rank))
        merged = rows if merged is None else merged.unionByName(rows, allowMissingColumns=True)
    if "sub_rank" not in merged.columns:
        merged = merged.withColumn("sub_rank", F.lit(0))
    if "call_id" not in merged.columns:
        merged = merged.withColumn("call_id", F.lit(None).cast("string"))
    order = ["block_index", "rank", F.coalesce("sub_rank", F.lit(0)), F.coalesce("call_id", F.lit(""))]
    return row_position(merged, ["session_id", "message_id"], order, "pos").drop("rank", "sub_rank")


def normalize_message_order(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages with new_pos, sessions with ``reordered``): sorted by creation time, then id."""
    placed = row_position(messages, ["session_id"], ["created_at", "id"], "new_pos")
    placed = row_position(placed, ["session_id"], ["pos"], "old_pos")
    flags = placed.groupBy("session_id").agg(
        F.bool_or(F.col("new_pos") != F.col("old_pos")).alias("reordered"))
    return placed.drop("old_pos"), flags


def pretty_json_bytes(json_text: Column) -> Column:
    """Size of compact JSON when printed with two-space indent and a final newline."""
    plain = F.regexp_replace(json_text, r'"(?:[^"\\]|\\.)*"', "s")
    marks = F.regexp_replace(F.regexp_replace(plain, r"\{\}|\[\]", ""), r"[^\[\]{},:]", "")
    start = F.struct(F.lit(0).cast("bigint").alias("d"), F.lit(0).cast("bigint").alias("n"))

    def step(acc: Column, mark: Column) -> Column:
        deeper, higher = acc["d"] + 1, acc["d"] - 1
        return (F.when(mark.isin("{", "["), F.struct(deeper.alias("d"), (acc["n"] + 1 + 2 * deeper).alias("n")))
                .when(mark.isin("}", "]"), F.struct(higher.alias("d"), (acc["n"] + 1 + 2 * higher).alias("n")))
                .when(mark == ",", F.struct(acc["d"].alias("d"), (acc["n"] + 1 + 2 * acc["d"]).alias("n")))
                .when(mark == ":", F.struct(acc["d"].alias("d"), (acc["n"] + 1).alias("n")))
                .otherwise(acc))
    extra = F.aggregate(F.split(marks, ""), start, step)["n"]
    return F.octet_length(json_text).cast("bigint") + extra + 1


def text_context_bytes(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("bigint") + 32


def tool_context_bytes(input_json: Column, output_text: Column, error_message: Column) -> Column:
    """Context of a tool block: whole input, and at most 2,000 characters of output and of error."""
    quoted = F.to_json(F.array(error_message))
    error = F.concat(F.lit('{\n  "message": '), F.substring(quoted, F.lit(2), F.length(quoted) - 2),
                     F.lit(',\n  "type": "TOOL_ERROR"\n}\n'))
    part = lambda c: F.coalesce(F.octet_length(F.substring(c, 1, 2000)), F.lit(0)).cast("bigint")
    return (pretty_json_bytes(F.coalesce(input_json, F.lit("null"))) + part(output_text)
            + part(F.when(error_message.isNotNull(), error)) + 64)


def labelled_texts(texts: DataFrame, limit: int = RECENT_BYTES) -> DataFrame:
    """(session_id, pos, entry, entry_bytes): the labelled texts of a message, its tail within ``limit``.

    ``texts``: session_id, pos (message), block_pos, type (user/assistant), text. Only the last
    blocks can matter, since each takes a label and a separator, so the list per message is short.
    """
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in LABELS.items() for x in p]),
                                        F.col("type")), F.lit(""))
    entries = texts.select(
        "session_id", "pos", "block_pos",
        F.concat(label, utf8_tail(F.col("text"), F.lit(limit) - F.octet_length(label))).alias("_e"))
    most = limit // (min(len(x) for x in LABELS.values()) + len(_GAP)) + 2
    last = top_per_key(entries, ["session_id", "pos"], [F.desc("block_pos")], most, "_rank")
    joined = last.groupBy("session_id", "pos").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("block_pos", "_e"))), lambda x: x["_e"]), _GAP).alias("_j"))
    entry = utf8_tail(F.col("_j"), limit)
    return joined.select("session_id", "pos", entry.alias("entry"),
                         F.octet_length(entry).cast("bigint").alias("entry_bytes"))


def _stream(entries: DataFrame) -> DataFrame:
    """Entries with their place [start, start + entry_bytes) in the joined text of the session."""
    gap = len(_GAP)
    placed = running_sum(entries.withColumn("_w", F.col("entry_bytes") + gap), ["session_id"], "pos", "_w", "_c")
    return placed.withColumn("start", F.col("_c") - F.col("_w")).withColumn(
        "end", F.col("_c") - gap).drop("_w", "_c")


def tail_bytes(entries: DataFrame, limit: int = RECENT_BYTES) -> DataFrame:
    """(session_id, pos, tail_bytes, start, end): size of the kept text after every entry.

    The entry in which the cut falls is found by an equi-join on 1 KiB buckets of the joined text.
    """
    stream = durable(_stream(entries))
    cuts = stream.filter(F.col("end") > limit).select(
        "session_id", "pos", (F.col("end") - limit).alias("cut"))
    cuts = cuts.withColumn("bucket", F.floor(F.col("cut") / _BUCKET))
    reach = F.col("end") + len(_GAP)
    spans = stream.select("session_id", F.col("pos").alias("cut_pos"), F.col("start").alias("_from"),
                          reach.alias("_to"), F.explode(F.sequence(
                              F.floor(F.col("start") / _BUCKET), F.floor((reach - 1) / _BUCKET))).alias("bucket"))
    inside = (F.col("cut") >= F.col("_from")) & (F.col("cut") < F.col("_to"))
    hit = cuts.join(spans, ["session_id", "bucket"]).filter(inside).select(
        "session_id", "pos", "cut_pos", (F.col("cut") - F.col("_from")).alias("offset"))
    texts = stream.select("session_id", F.col("pos").alias("cut_pos"), F.col("entry").alias("_t"),
                          F.col("entry_bytes").alias("_b"))
    shift = F.when(F.col("offset") < F.col("_b"), split_offset(F.col("_t"), F.col("offset"))).otherwise(0)
    sizes = hit.join(texts, ["session_id", "cut_pos"]).select(
        "session_id", "pos", (F.lit(limit) - shift).cast("bigint").alias("_tail"))
    return stream.join(sizes, ["session_id", "pos"], "left").select(
        "session_id", "pos", F.coalesce("_tail", "end").alias("tail_bytes"), "start", "end")


def recent_tail(entries: DataFrame, boundaries: DataFrame, limit: int = RECENT_BYTES) -> DataFrame:
    """(session_id, pos, recent): the kept text at every boundary; ``boundaries`` has session_id, pos.

    ``entries`` as from ``labelled_texts``; a boundary uses the last entry at or before it.
    """
    stream = durable(_stream(entries))
    ends = running_max_end(stream, boundaries)
    wanted = ends.withColumn("_low", F.greatest(F.col("end") - limit, F.lit(0))).withColumn(
        "bucket", F.explode(F.sequence(F.floor(F.col("_low") / _BUCKET), F.floor(F.col("end") / _BUCKET))))
    # An entry belongs to the bucket of its last byte, so it meets a boundary at most once.
    pieces = stream.select("session_id", F.col("pos").alias("_pos"), F.col("end").alias("_end"), "entry",
                           F.floor(F.col("end") / _BUCKET).alias("bucket"))
    near = wanted.join(pieces, ["session_id", "bucket"]).filter(
        (F.col("_end") > F.col("_low")) & (F.col("_end") <= F.col("end")))
    joined = near.groupBy("session_id", "pos").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_pos", "entry"))), lambda x: x["entry"]), _GAP).alias("_text"))
    low = ends.select("session_id", "pos", F.col("end").alias("_e"))
    text = F.col("_text")
    # Bytes of the gap before the first whole entry may still belong to the tail.
    padded = F.when(F.col("_e") > F.octet_length(text), F.concat(F.lit(_GAP), text)).otherwise(text)
    shown = joined.join(low, ["session_id", "pos"]).select(
        "session_id", "pos", utf8_tail(padded, limit).alias("_r"))
    return boundaries.select("session_id", "pos").join(shown, ["session_id", "pos"], "left").select(
        "session_id", "pos", F.coalesce(F.nullif("_r", F.lit("")), F.lit(EMPTY_RECENT)).alias("recent"))


def running_max_end(stream: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(session_id, pos, end): end of the joined text at a boundary, from the last entry up to it.

    Positions are array indices: an as-of lookup through the chunk of the boundary and, if that
    has no earlier entry, the last entry of the nearest earlier chunk.
    """
    merged = (stream.select("session_id", "pos", F.col("end"), F.lit(False).alias("_b"))
              .unionByName(boundaries.select("session_id", "pos", F.lit(None).cast("bigint").alias("end"),
                                             F.lit(True).alias("_b"))))
    both = merged.groupBy("session_id", "pos").agg(F.max("end").alias("end"), F.bool_or("_b").alias("_b"))
    # Ends grow with the position, so the sum of growth is the end itself.
    from palaver.operators.ordered import previous_value
    known = previous_value(both.filter("end IS NOT NULL"), ["session_id"], "pos", "end", "_before")
    growth = both.join(known.select("session_id", "pos", (F.col("end") - F.coalesce("_before", F.lit(0))).alias("_g")),
                       ["session_id", "pos"], "left").withColumn("_g", F.coalesce("_g", F.lit(0)))
    return running_sum(growth, ["session_id"], "pos", "_g", "_end").filter("_b").select(
        "session_id", "pos", F.col("_end").alias("end"))


def segment_history(messages: DataFrame, cap: int = CONTEXT_BYTES, width: int = 65_536) -> DataFrame:
    """(session_id, pos, active_bytes): the messages after which a boundary is inserted.

    ``messages``: session_id, pos, type, bytes, tail_bytes; positions are distinct, sizes not negative, a missing
    size counts as 0. A session below the limit has no boundary. In the others every possible boundary gets a link to the one
    that would follow it, as the restarted total says, and the chain from the start is marked by doubling the links. So
    the number of jobs grows with the logarithm of the boundaries of a session, not with its messages.
    """
    totals = messages.groupBy("session_id").agg(F.sum("bytes").alias("_t"))
    long = totals.filter(F.col("_t") > cap).select("session_id")
    rows = messages.filter("pos IS NOT NULL").select(
        "session_id", F.col("pos").cast("bigint").alias("pos"), F.coalesce(F.col("bytes").cast("bigint"), F.lit(0)).alias("bytes"),
        F.coalesce(F.col("tail_bytes").cast("bigint"), F.lit(0)).alias("tail_bytes"), (F.col("type") == "assistant").alias("turn"))
    placed = running_sum(rows.join(long, "session_id"), ["session_id"], "pos", "bytes", "sum")
    turns = durable(placed.filter("turn").select("session_id", "pos", "sum", (F.col("sum") - F.col("tail_bytes")).alias("base")))
    # The start is a boundary before all messages, with nothing kept.
    first = F.lit(None).cast("bigint")
    starts = turns.select("session_id").distinct().select("session_id", first.alias("pos"), F.lit(0).cast("bigint").alias("sum"),
                                                          F.lit(0).cast("bigint").alias("base"))
    links = durable(next_cuts(turns, turns.unionByName(starts), cap, width))
    marked = _chain(links)
    return marked.select("session_id", F.col("next").alias("pos"), F.col("active_bytes"))


def next_cuts(turns: DataFrame, asking: DataFrame, cap: int, width: int) -> DataFrame:
    """(session_id, pos, next, active_bytes): the boundary after every one in ``asking``, where there is one.

    ``turns``: session_id, pos, sum (bytes up to here), base (sum less the kept text). A boundary at ``pos`` is followed by the first
    later turn whose sum exceeds base + cap. Sums rise with the position, so turns and questions are merged
    in buckets of ``width`` bytes; a question that finds nothing in its own bucket takes the first turn of the buckets behind.
    """
    most = F.lit((1 << 63) - 1)
    wall = F.col("base") + cap
    open_ = F.coalesce(wall >= F.col("sum"), F.lit(True))
    asked = asking.select(
        "session_id", F.lit(True).alias("asks"), F.col("pos").alias("from"), "base",
        F.when(open_, wall).otherwise(F.col("sum")).alias("value"), F.when(open_, most).otherwise(F.col("pos")).alias("at"))
    stops = turns.select("session_id", F.lit(False).alias("asks"), F.lit(None).cast("bigint").alias("from"), F.lit(None).cast("bigint").alias("base"),
                         F.col("sum").alias("value"), F.col("pos").alias("at"))
    both = asked.unionByName(stops).withColumn("bucket", F.floor(F.col("value") / width))
    stop = F.when(~F.col("asks"), F.struct("at", "value"))
    # Backwards, a stop meant for others comes after the questions that equal it.
    back = Window.partitionBy("session_id", "bucket").orderBy(F.desc("value"), F.desc("at"), F.desc("asks"))
    near = F.last(stop, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumn("near", near).filter("asks")
    # The least turn behind a bucket: inside chunks of buckets, then from the chunks behind.
    buckets = both.groupBy("session_id", "bucket").agg(F.min(stop).alias("least")).withColumn("part", F.floor(F.col("bucket") / 65_536))
    behind = Window.partitionBy("session_id", "part").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    parts = buckets.groupBy("session_id", "part").agg(F.min("least").alias("all"))
    beyond = Window.partitionBy("session_id").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("session_id", "part", F.min("all").over(beyond).alias("beyond"))
    later = (buckets.withColumn("behind", F.min("least").over(behind)).join(parts, ["session_id", "part"])
             .select("session_id", "bucket", F.coalesce("behind", "beyond").alias("later")))
    met = F.coalesce("near", "later")
    return (found.join(later, ["session_id", "bucket"]).withColumn("met", met).filter("met IS NOT NULL").select(
        "session_id", F.col("from").alias("pos"), F.col("met.at").alias("next"), (F.col("met.value") - F.col("base")).alias("active_bytes")))


def _chain(links: DataFrame) -> DataFrame:
    """The links on the way from the start (pos NULL) of every session.

    Links lead forward. Round k knows the first 2^k links of each way, and for every place that some link leads to, the place 2^k links on.
    """
    marked = links.filter("pos IS NULL")
    targets = links.select("session_id", F.col("next").alias("pos")).distinct()
    jump = durable(links.join(targets, ["session_id", "pos"], "left_semi").select("session_id", "pos", "next"))
    known = links.filter("pos IS NOT NULL")
    # Places reached: those after the first link, then 2^k more a round.
    reached = durable(marked.select("session_id", F.col("next").alias("pos")))
    while True:
        more = durable(reached.join(jump, ["session_id", "pos"]).select("session_id", F.col("next").alias("pos")))
        if more.isEmpty():
            break
        reached = reached.unionByName(more)
        hop = jump.select("session_id", F.col("pos").alias("next"), F.col("next").alias("far"))
        jump = durable(jump.join(hop, ["session_id", "next"]).select("session_id", "pos", F.col("far").alias("next")))
    return marked.unionByName(known.join(reached, ["session_id", "pos"], "left_semi"))
