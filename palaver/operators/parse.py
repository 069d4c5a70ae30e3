"""Raw message records to typed rows; every record that is refused leaves an issue row.

Input: ``recs(session_id, entry_index, rec VARIANT)``. The typed fields of all records are written
once; rows and issues are cheap reads of that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions import variant as V
from palaver.functions.credentials import is_blank
from palaver.functions.identity import digest
from palaver.functions.values import MAX_SAFE_INTEGER, MESSAGE_STATUS, normalize_status
from palaver.session import durable

# Id patterns and record locator.
MESSAGE_ID = r"^[A-Za-z0-9._:-]{1,256}$"
SESSION_ID = r"^[A-Za-z0-9._:-]{8,128}$"
LOCATOR = "runtime:getMessages#message"
FINISH_TOOLS = ("finish", "Finish", "response_to_user")
PLAN_SUMMARY_AGENTS = ("chat", "solo_agent")

_ISSUE = "struct<code:string,severity:string,field:string,locator:string>"


def _issue(code: str, severity: str = "error", field: str | None = None, locator: Column | None = None) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"),
                    F.lit(field).cast("string").alias("field"),
                    (locator if locator is not None else F.lit(None).cast("string")).alias("locator"))


def _present(*issues: Column) -> Column:
    return F.filter(F.array(*issues), lambda i: i.isNotNull())


def _identifier(v: Column, pattern: str = MESSAGE_ID) -> Column:
    text = V.text(v)
    return F.when(text.rlike(pattern), text)


def _seconds(v: Column) -> Column:
    value = V.integer_or_digits(v)
    return F.when(value <= MAX_SAFE_INTEGER // 1000, value * 1000)


def _milliseconds(v: Column) -> Column:
    return V.integer_or_digits(v)


def _given(v: Column) -> Column:
    """Present, not null and not the empty string."""
    return v.isNotNull() & ~F.is_variant_null(v) & ~F.coalesce(V.text(v) == "", F.lit(False))


def _parsed(v: Column) -> Column:
    """The value itself, or the JSON inside it when it is a string of JSON."""
    return F.when(V.is_text(v), F.try_parse_json(V.text(v))).otherwise(v)


def _envelope(v: Column) -> Column:
    return V.obj(_parsed(v))


def _block_value(block: Column) -> Column:
    """First of text_content, text, content that is neither absent nor null."""
    picks = [V.field(block, f"$.{name}") for name in ("text_content", "text", "content")]
    return F.coalesce(*[F.when(~V.is_absent(p), p) for p in picks])


def message_text(content: Column, query: Column) -> Column:
    """struct(content_ok, content_text, query_ok, query_text) of one user record.

    ``content``: a string, a string of JSON, or an array of blocks; ``query``: an array of strings
    and parts, possibly as a string of JSON. Both VARIANT; an absent one is valid and has no text.
    """
    inner = F.coalesce(_parsed(content), content)
    whole = V.text(inner)
    blocks = V.array(inner)

    def is_text_block(b: Column) -> Column:
        return F.coalesce(V.text(V.field(b, "$.type")) == "text", F.lit(False))
    blocks_ok = F.forall(blocks, lambda b: V.obj(b).isNotNull() & (
        ~is_text_block(b) | F.coalesce(V.is_text(_block_value(b)), F.lit(False))))
    joined = F.array_join(F.transform(F.filter(blocks, is_text_block), lambda b: V.text(_block_value(b))), "")
    content_ok = content.isNull() | whole.isNotNull() | F.coalesce(blocks_ok, F.lit(False))
    content_text = F.coalesce(whole, F.when(blocks_ok, joined))
    parts = V.array(_parsed(query))
    parts_ok = F.forall(parts, lambda p: V.is_text(p) | V.obj(p).isNotNull())
    chunks = F.transform(parts, lambda p: F.coalesce(
        V.text(p), F.when(is_text_block(p), V.text(_block_value(p))), F.lit("")))
    return F.struct(
        content_ok.alias("content_ok"), content_text.alias("content_text"),
        (query.isNull() | F.coalesce(parts_ok, F.lit(False))).alias("query_ok"),
        F.when(parts_ok, F.array_join(chunks, "")).alias("query_text"))


def _query_value(rec: Column) -> tuple[Column, Column]:
    """The first given query field and its locator."""
    context = V.obj(V.field(rec, "$.user_message_context"))
    options = (("query", V.field(rec, "$.query")),
               ("user_message_context.parsed_query", V.field(context, "$.parsed_query")),
               ("user_message_context.parsedQuery", V.field(context, "$.parsedQuery")))
    value = F.coalesce(*[F.when(_given(v), v) for _, v in options])
    name = F.coalesce(*[F.when(_given(v), F.lit(n)) for n, v in options])
    return value, name


def parse_user_messages(recs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, issues) of the user records; assistant records are left to the other parser."""
    rec = F.col("rec")
    query, locator = _query_value(rec)
    base = recs.select(
        "session_id", "entry_index", V.obj(rec).isNull().alias("not_object"),
        V.text(V.field(rec, "$.role")).alias("role"),
        _identifier(V.field(rec, "$.message_id")).alias("message_id"),
        _identifier(V.field(rec, "$.chat_session_id"), SESSION_ID).alias("claimed_session_id"),
        V.integer_or_digits(V.field(rec, "$.message_index")).alias("ord"),
        _seconds(V.field(rec, "$.created_at")).alias("created_at"),
        message_text(V.field(rec, "$.content"), query).alias("t"), locator.alias("query_locator"),
        digest(F.to_json(V.field(rec, "$.content"))).alias("content_digest"),
        digest(F.to_json(query)).alias("query_digest"), digest(F.to_json(rec)).alias("digest"))
    base = durable(base.filter(F.col("not_object") | ~F.coalesce(F.col("role") == "assistant", F.lit(False))))
    identified = (~F.col("not_object") & F.coalesce(F.col("role") == "user", F.lit(False))
                  & F.col("message_id").isNotNull() & F.col("claimed_session_id").isNotNull()
                  & F.col("ord").isNotNull() & F.col("created_at").isNotNull())
    from_content = F.when(F.col("t.content_ok") & ~is_blank(F.col("t.content_text")), F.col("t.content_text"))
    from_query = F.when(F.col("t.query_ok") & ~is_blank(F.col("t.query_text")), F.col("t.query_text"))
    checked = base.withColumn("identified", identified).withColumn("from_content", from_content).withColumn(
        "from_query", F.when(F.col("from_content").isNull(), from_query))
    issues = F.when(~F.col("identified"), F.array(_issue("USER_RECORD_INVALID"))).otherwise(_present(
        F.when(~F.col("t.content_ok"), _issue("USER_CONTENT_INVALID", field="content")),
        F.when(~F.col("t.query_ok"), _issue("USER_QUERY_INVALID", field="query")),
        F.when(F.col("from_query").isNotNull(), _issue("USER_TEXT_FROM_QUERY", "warning", "query")),
        F.when(F.col("from_content").isNull() & F.col("from_query").isNull(), _issue("USER_TEXT_MISSING"))))
    checked = durable(checked.withColumn("issues", issues))
    messages = checked.filter("identified AND coalesce(from_content, from_query) IS NOT NULL").select(
        "session_id", "claimed_session_id", "message_id", "entry_index", "ord", "created_at",
        F.coalesce("from_content", "from_query").alias("text"),
        F.when(F.col("from_content").isNotNull(), "content").otherwise(F.col("query_locator")).alias("text_locator"),
        F.when(F.col("from_content").isNotNull(), F.col("content_digest")).otherwise(F.col("query_digest"))
        .alias("text_digest"), "digest")
    return messages, _exploded(checked)


def _exploded(checked: DataFrame) -> DataFrame:
    return checked.select(
        "session_id", "message_id", "entry_index", F.explode("issues").alias("i")).select(
        "session_id", "message_id", "entry_index", "i.*")


def _known_type(entry: Column) -> Column:
    return F.coalesce(V.text(V.field(entry, "$.type")).isin("proposal", "plan_item", "agent_call"), F.lit(False))


def _is_type(entry: Column, name: str) -> Column:
    return F.coalesce(V.text(V.field(entry, "$.type")) == name, F.lit(False))


def _text_or_absent(v: Column) -> Column:
    return v.isNull() | F.is_variant_null(v) | V.is_text(v)


def _solid(v: Column) -> Column:
    text = V.text(v)
    return F.when(~is_blank(text), text)


_TEXTS = "array<struct<entry_index:int,rank:int,text:string,locator:string>>"


def _texts(entries: Column, thought_path: str, name: str) -> Column:
    rows = F.transform(entries, lambda e, i: F.struct(
        i.alias("entry_index"), F.lit(0).alias("rank"), _solid(V.field(e, thought_path)).alias("text"),
        F.concat(F.lit("content.messages["), i, F.lit(f"].{name}.thought")).alias("locator")))
    return F.filter(rows, lambda r: r["text"].isNotNull())


def assistant_text_blocks(content: Column, message_type: Column, agent_type: Column) -> Column:
    """struct(valid, texts array<struct<entry_index, rank, text, locator>>) of an assistant record."""
    envelope = _envelope(content)
    return _text_blocks(envelope.isNotNull(), V.field(envelope, "$.content"),
                        V.array(V.field(envelope, "$.messages")), message_type, agent_type)


def _text_blocks(has_envelope: Column, body: Column, entries: Column, message_type: Column,
                 agent_type: Column) -> Column:
    general = F.struct(
        (has_envelope & _text_or_absent(body)).alias("valid"),
        F.when(_solid(body).isNotNull(), F.array(F.struct(
            F.lit(-1).alias("entry_index"), F.lit(0).alias("rank"), _solid(body).alias("text"),
            F.lit("content.content").alias("locator")))).otherwise(F.array().cast(_TEXTS)).alias("texts"))

    def proposal_ok(e: Column) -> Column:
        inside = V.obj(V.field(V.obj(V.field(e, "$.proposal")), "$.content"))
        return inside.isNotNull() & _text_or_absent(V.field(inside, "$.thought"))

    def plan_ok(e: Column) -> Column:
        item = V.obj(V.field(e, "$.plan_item"))
        return item.isNotNull() & _text_or_absent(V.field(item, "$.thought"))
    proposals = F.filter(
        _texts(entries, "$.proposal.content.thought", "proposal.content"),
        lambda r: _is_type(F.try_element_at(entries, r["entry_index"] + 1), "proposal"))
    by_proposal = F.struct(
        F.forall(entries, lambda e: _known_type(e) & (~_is_type(e, "proposal") | proposal_ok(e))).alias("valid"),
        proposals.alias("texts"))
    thoughts = F.filter(
        _texts(entries, "$.plan_item.thought", "plan_item"),
        lambda r: _is_type(F.try_element_at(entries, r["entry_index"] + 1), "plan_item"))

    def summary_of(e: Column) -> Column:
        call = V.obj(V.field(e, "$.plan_item.tool_call_info"))
        named = F.coalesce(V.text(V.field(call, "$.name")).isin(*FINISH_TOOLS), F.lit(False))
        return F.when(_is_type(e, "plan_item") & named,
                      _solid(V.field(_envelope(V.field(call, "$.params")), "$.summary")))
    summaries = F.filter(F.transform(entries, lambda e, i: F.struct(
        i.alias("entry_index"), F.lit(1).alias("rank"), summary_of(e).alias("text"),
        F.concat(F.lit("content.messages["), i,
                 F.lit("].plan_item.tool_call_info.params.summary")).alias("locator"))),
        lambda r: r["text"].isNotNull())
    last = F.slice(summaries, -1, 1)
    shown = F.filter(thoughts, lambda t: ~F.exists(last, lambda s: s["text"] == t["text"]))
    by_plan = F.struct(
        F.forall(entries, lambda e: _known_type(e) & (~_is_type(e, "plan_item") | plan_ok(e))).alias("valid"),
        F.array_sort(F.concat(shown, F.when(F.size(summaries) > 0, last).otherwise(
            F.array().cast(_TEXTS)))).alias("texts"))
    nothing = F.struct(F.lit(False).alias("valid"), F.array().cast(_TEXTS).alias("texts"))
    return (F.when(message_type == "general", general).when(entries.isNull(), nothing)
            .when(F.coalesce(agent_type.isin(*PLAN_SUMMARY_AGENTS), F.lit(False)), by_plan)
            .otherwise(by_proposal))


def parse_assistant_messages(recs: DataFrame) -> dict[str, DataFrame]:
    """Tables messages, issues, texts, reasoning, plan_items, plan_conflicts and tool_obs."""
    rec = F.col("rec")
    get = lambda name: V.field(rec, f"$.{name}")
    message_type = V.text(get("message_type"))
    base = recs.select(
        "session_id", "entry_index", V.obj(rec).isNull().alias("not_object"), V.text(get("role")).alias("role"),
        _identifier(get("message_id")).alias("message_id"),
        _identifier(get("chat_session_id"), SESSION_ID).alias("claimed_session_id"),
        _identifier(get("turn_id")).alias("turn_id"), _identifier(get("reply_to_message_id")).alias("reply_to"),
        V.integer_or_digits(get("message_index")).alias("ord"), _seconds(get("created_at")).alias("created_at"),
        F.when(message_type.isin("general", "task"), message_type).alias("message_type"),
        normalize_status(V.text(get("status")), MESSAGE_STATUS).alias("status"),
        _given(get("chat_start_time")).alias("has_start"), _milliseconds(get("chat_start_time")).alias("started_at"),
        _given(get("chat_end_time")).alias("has_end"), _milliseconds(get("chat_end_time")).alias("ended_at"),
        _envelope(get("content")).alias("envelope"), V.text(get("agent_type")).alias("agent_type"),
        digest(F.to_json(rec)).alias("digest"))
    base = durable(base.filter(F.col("not_object") | ~F.coalesce(F.col("role") == "user", F.lit(False)))
                   .select("*", V.field(F.col("envelope"), "$.content").alias("body"),
                           V.field(F.col("envelope"), "$.reasoning_content").alias("reason"),
                           V.array(V.field(F.col("envelope"), "$.messages")).alias("entries"),
                           F.col("envelope").isNotNull().alias("has_envelope")).drop("envelope"))
    identified = ~F.col("not_object") & F.coalesce(F.col("role") == "assistant", F.lit(False))
    for name in ("message_id", "claimed_session_id", "turn_id", "reply_to", "ord", "created_at", "message_type"):
        identified = identified & F.col(name).isNotNull()
    reversed_time = F.col("has_start") & F.col("has_end") & F.coalesce(
        F.col("ended_at") < F.col("started_at"), F.lit(False))
    checked = (base.withColumn("identified", identified)
               .withColumn("started_at", F.when(F.col("has_start"), F.col("started_at")))
               .withColumn("reversed", reversed_time)
               .withColumn("completed_at", F.when(F.col("has_end") & ~F.col("reversed"), F.col("ended_at")))
               .withColumn("t", _text_blocks(F.col("has_envelope"), F.col("body"), F.col("entries"),
                                             F.col("message_type"), F.col("agent_type"))))
    issues = F.when(~F.col("identified"), F.array(_issue("ASSISTANT_RECORD_INVALID"))).otherwise(_present(
        F.when(F.col("status") == "unknown", _issue("ASSISTANT_STATUS_INVALID", "warning", "status")),
        F.when(F.col("has_start") & F.col("started_at").isNull(),
               _issue("ASSISTANT_TIMING_INVALID", field="chat_start_time")),
        F.when(F.col("has_end") & F.col("ended_at").isNull(),
               _issue("ASSISTANT_TIMING_INVALID", field="chat_end_time")),
        F.when(F.col("reversed"), _issue("ASSISTANT_TIMING_ORDER_INVALID")),
        F.when((F.col("status") == "completed") & F.col("completed_at").isNull(),
               _issue("ASSISTANT_COMPLETION_TIME_MISSING", "warning", "chat_end_time")),
        F.when(~F.col("t.valid"), _issue("ASSISTANT_CONTENT_INVALID", field="content")),
        F.when(F.size("t.texts") == 0, _issue("ASSISTANT_TEXT_MISSING", "warning", "content"))))
    checked = durable(checked.withColumn("issues", issues))
    good = checked.filter("identified")
    messages = good.select(
        "session_id", "claimed_session_id", "message_id", "entry_index", "ord", "created_at", "started_at",
        "completed_at", "turn_id", "reply_to", "message_type", "status", "digest")
    ident = ["session_id", "message_id", "entry_index", "digest"]
    texts = good.select(*ident, F.explode("t.texts").alias("b")).select(
        *ident, F.col("b.entry_index").alias("block_index"), F.col("b.rank").alias("sub_rank"),
        F.col("b.text").alias("text"), F.col("b.locator").alias("locator"))
    reasoning = reasoning_blocks(good)
    tools = tool_observations(good)
    extra = [t.select("session_id", "message_id", "entry_index", "code", "severity",
                      F.lit(None).cast("string").alias("field"), "locator")
             for t in (reasoning["issues"], tools["issues"])]
    return {"messages": messages, "issues": _exploded(checked).unionByName(extra[0]).unionByName(extra[1]),
            "texts": texts, "reasoning": reasoning["reasoning"], "plan_items": reasoning["plan_items"],
            "plan_conflicts": reasoning["plan_conflicts"], "tool_obs": tools["tool_obs"]}


def _entries(good: DataFrame) -> DataFrame:
    """One row per entry of the task messages, with its envelope index."""
    return (good.filter("message_type = 'task'")
            .select("session_id", "message_id", F.col("entry_index").alias("rec_index"), "digest",
                    F.posexplode("entries").alias("i", "e"))
            .withColumn("kind", V.text(V.field(F.col("e"), "$.type"))))


def reasoning_blocks(good: DataFrame) -> dict[str, DataFrame]:
    """Reasoning of the envelope, of proposals and of plan items, with plan items deduplicated.

    ``good``: identified assistant rows with message_type, has_envelope, reason and entries.
    """
    from palaver.operators.dedup import dedup_quarantine
    ident = ["session_id", "message_id", "entry_index", "digest"]
    general = good.filter("message_type = 'general'").select(
        *ident, F.lit(-1).alias("block_index"), F.col("reason").alias("v"), F.lit("content.reasoning_content").alias("locator"))
    entries = _entries(good)
    place = F.concat(F.lit("content.messages["), F.col("i"), F.lit("]"))
    proposal = V.obj(_parsed(V.field(V.obj(_parsed(V.field(F.col("e"), "$.proposal"))), "$.content")))
    proposals = entries.filter("kind = 'proposal'").select(
        "session_id", "message_id", F.col("rec_index").alias("entry_index"), "digest",
        F.col("i").alias("block_index"), V.field(proposal, "$.reasoning_content").alias("v"),
        F.concat(place, F.lit(".proposal.content.reasoning_content")).alias("locator"))
    item = V.obj(V.field(F.col("e"), "$.plan_item"))
    items = entries.filter("kind = 'plan_item'").select(
        "session_id", "message_id", F.col("rec_index"), F.col("digest").alias("rec_digest"),
        F.col("i").alias("entry_index"), _identifier(V.field(item, "$.id")).alias("item_id"),
        digest(F.to_json(item)).alias("digest"), F.to_json(V.field(item, "$.reasoning_content")).alias("reasoning"),
        V.text(V.field(item, "$.thought")).alias("thought"),
        _text_or_absent(V.field(item, "$.thought")).alias("thought_ok"),
        F.concat(place, F.lit(".plan_item")).alias("locator"))
    # One message may be read twice; an item is compared within one record.
    kept, conflicts = dedup_quarantine(items.filter("item_id IS NOT NULL"),
                                       ["session_id", "message_id", "rec_index", "item_id"], "digest", ["entry_index"])
    from_items = kept.select(
        "session_id", "message_id", F.col("rec_index").alias("entry_index"), F.col("rec_digest").alias("digest"),
        F.col("entry_index").alias("block_index"), F.try_parse_json("reasoning").alias("v"),
        F.concat("locator", F.lit(".reasoning_content")).alias("locator"))
    fields = general.unionByName(proposals).unionByName(from_items)
    reasoning = fields.withColumn("text", _solid(F.col("v"))).filter("text IS NOT NULL").drop("v")

    def bad(rows: DataFrame, code: str, severity: str = "error", index: str = "rec_index") -> DataFrame:
        return rows.select("session_id", "message_id", F.col(index).alias("entry_index"),
                           F.lit(code).alias("code"), F.lit(severity).alias("severity"), "locator")
    located = entries.withColumn("locator", place)
    not_object = V.obj(F.col("e")).isNull()
    issues = bad(fields.filter(_given(F.col("v")) & ~V.is_text(F.col("v"))), "REASONING_INVALID",
                 index="entry_index")
    for rows, code, severity in (
            (good.filter("NOT has_envelope").select(*ident, F.lit("content").alias("locator"),
                                                   F.col("entry_index").alias("rec_index")),
             "REASONING_INVALID", "error"),
            (good.filter("message_type = 'task' AND has_envelope AND entries IS NULL")
             .select(*ident, F.lit("content.messages").alias("locator"), F.col("entry_index").alias("rec_index")),
             "PLAN_ITEM_INVALID", "error"),
            (located.filter(not_object), "PLAN_ITEM_INVALID", "error"),
            (located.filter((F.col("kind") == "proposal") & proposal.isNull()), "REASONING_INVALID", "error"),
            (located.filter(~not_object & ~F.coalesce(F.col("kind").isin("proposal", "plan_item"), F.lit(False))),
             "CONTENT_TYPE_UNSUPPORTED", "warning"),
            (items.filter("item_id IS NULL"), "PLAN_ITEM_INVALID", "error"),
            (kept.filter("NOT thought_ok"), "PLAN_ITEM_INVALID", "error"),
            (conflicts.withColumn("locator", F.col("item_id")), "PLAN_ITEM_CONFLICT", "error")):
        issues = issues.unionByName(bad(rows, code, severity))
    return {"reasoning": reasoning, "plan_items": kept, "plan_conflicts": conflicts, "issues": issues}


def tool_observations(good: DataFrame) -> dict[str, DataFrame]:
    """Tool calls of plan items: tool_obs (input of the merge) and issues."""
    place = F.concat(F.lit("content.messages["), F.col("i"), F.lit("].plan_item"))
    item = V.obj(V.field(F.col("e"), "$.plan_item"))
    call = V.field(item, "$.tool_call_info")
    result = V.field(call, "$.result")
    rows = _entries(good).filter("kind = 'plan_item'").select(
        "session_id", "message_id", "rec_index", F.col("i").alias("entry_index"), place.alias("locator"),
        item.isNull().alias("no_item"), call.alias("call"), result.alias("result"),
        V.field(item, "$.timing").alias("timing"))
    call, result, timing = F.col("call"), F.col("result"), F.col("timing")
    members = F.map_keys(F.try_variant_get(result, "$", "map<string,variant>"))
    placeholder = (F.coalesce(V.text(V.field(call, "$.name")) == "", F.lit(False))
                   & V.field(call, "$.params").isNull()
                   & (result.isNull() | F.is_variant_null(result) | F.coalesce(F.size(members) == 0, F.lit(False))))
    rows = rows.filter(F.col("no_item") | (~V.is_absent(call) & ~placeholder))
    name, call_id = V.text(V.field(call, "$.name")), _identifier(V.field(call, "$.id"))
    absent_result = result.isNull() | F.is_variant_null(result)
    error = V.field(result, "$.error_message")
    stamp = lambda field: V.safe_integer(V.field(timing, f"$.{field}"))
    fields = {"generated_at": "generated_at_ms", "started_at": "tool_call_started_at_ms",
              "completed_at": "tool_call_finished_at_ms"}
    params = V.field(call, "$.params")
    typed = rows.select(
        "session_id", "message_id", "rec_index", "entry_index", "locator", call_id.alias("call_id"),
        F.when(~is_blank(name), name).alias("name"), F.coalesce(F.to_json(params), F.lit("null")).alias("input"),
        params.isNull().alias("input_missing"),
        absent_result.alias("no_result"), (~absent_result & V.obj(result).isNull()).alias("bad_result"),
        F.when(absent_result, F.lit("unknown")).otherwise(
            normalize_status(V.text(V.field(result, "$.status")))).alias("status"),
        F.to_json(V.field(result, "$.data")).alias("output"),
        F.when(_given(error), F.to_json(error)).alias("error"),
        (~V.is_absent(timing) & V.obj(timing).isNull()).alias("bad_timing"),
        *[stamp(raw).alias(n) for n, raw in fields.items()],
        *[(~V.is_absent(V.field(timing, f"$.{raw}")) & stamp(raw).isNull()).alias(f"bad_{n}")
          for n, raw in fields.items()],
        digest(F.to_json(call)).alias("digest"))
    start = F.coalesce("started_at", "generated_at")
    early_end = F.coalesce(F.col("completed_at") < start, F.lit(False))
    known = F.col("call_id").isNotNull() & F.col("name").isNotNull()
    # A call without parameters cannot be told from one whose parameters were lost.
    invalid = F.col("bad_result") | F.col("input_missing")
    at = lambda suffix: F.concat("locator", F.lit(suffix))
    issues = F.when(~known, F.array(_issue("TOOL_CALL_INVALID", locator=at(".tool_call_info")))).otherwise(_present(
        F.when(F.col("input_missing"), _issue("TOOL_INPUT_INVALID", locator=at(".tool_call_info.params"))),
        F.when(F.col("no_result"), _issue("TOOL_RESULT_MISSING", "warning", locator=at(".tool_call_info.result"))),
        F.when(F.col("bad_result"), _issue("TOOL_RESULT_INVALID", locator=at(".tool_call_info.result"))),
        F.when(~F.col("no_result") & ~F.col("bad_result") & (F.col("status") == "unknown"),
               _issue("TOOL_STATUS_UNSUPPORTED", "warning", locator=at(".tool_call_info.result.status"))),
        F.when(F.col("error").isNotNull(),
               _issue("TOOL_ERROR_UNVERIFIED", "warning", locator=at(".tool_call_info.result.error_message"))),
        F.when(F.col("bad_timing") | early_end, _issue("TOOL_TIMING_INVALID", locator=at(".timing"))),
        *[F.when(F.col(f"bad_{n}"), _issue("TOOL_TIMING_INVALID", locator=at(f".timing.{raw}")))
          for n, raw in fields.items()]))
    typed = durable(typed.withColumn("invalid", invalid).withColumn("issues", issues))
    obs = typed.filter(known).select(
        "session_id", "message_id", "rec_index", "call_id", "entry_index", "name", "input", "status", "output",
        "error", *fields, "invalid", "locator", "digest")
    bad_envelope = good.filter("message_type = 'task' AND entries IS NULL").select(
        "session_id", "message_id", "entry_index", F.lit("TOOL_CONTAINER_INVALID").alias("code"),
        F.lit("error").alias("severity"), F.lit("content.messages").alias("locator"))
    found = typed.select("session_id", "message_id", F.col("rec_index").alias("entry_index"),
                         F.explode("issues").alias("x")).select(
        "session_id", "message_id", "entry_index", "x.code", "x.severity", "x.locator")
    return {"tool_obs": obs, "issues": found.unionByName(bad_envelope)}
