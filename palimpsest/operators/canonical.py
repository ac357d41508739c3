"""Raw conversation graphs to typed nodes, edges, active paths and branch traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.folders import shared
from palimpsest.functions.text import instant, trimmed

# Content types and channels that decide a message's class, and field names.
RESULT_TYPES = ("tool_result", "tool_output", "computer_output", "execution_output", "code_execution_output")
CALL_TYPES = ("tool_call", "tool_use", "computer_initialize_state", "computer_input", "code_execution")
REASONING_TYPES = ("reasoning", "reasoning_summary", "thoughts", "analysis")
PROGRESS_TYPES = ("progress", "status", "intermediate", "delta")
VOICE = "voice|audio|realtime|speech|transcript|transcription|spoken|microphone|camera"
TRANSCRIPTS = ("transcript", "transcription", "audio_transcript", "audioTranscript", "voice_transcript", "voiceTranscript", "spoken_text", "spokenText", "caption")
PART_TYPES = {
    "image_asset_pointer": "image", "image": "image", "file": "file", "file_asset_pointer": "file", "citation": "citation", "tool_call": "tool_call",
    "tool_result": "tool_result", "canvas": "canvas", "canvas_asset_pointer": "canvas", "reasoning_summary": "reasoning_summary",
}


def get(value: Column, *paths: str, kind: str = "string") -> Column:
    """The first of several paths of a VARIANT that holds a value of the kind."""
    return F.coalesce(*(F.try_variant_get(value, p, kind) for p in paths))


def role(value: Column) -> Column:
    return F.when(value.isin("user", "assistant", "system", "tool"), value).when(value == "developer", "system").otherwise("unknown")


def token(value: Column) -> Column:
    return F.lower(trimmed(F.coalesce(value, F.lit(""))))


def is_voice(message: Column) -> Column:
    kind = token(get(message, "$.content.content_type", "$.content.type"))
    flag = F.coalesce(get(message, "$.metadata.is_voice", "$.metadata.voice_mode", "$.metadata.is_audio", "$.metadata.realtime", kind="boolean"), F.lit(False))
    told = get(message, *(f"$.content.{f}" for f in TRANSCRIPTS), *(f"$.metadata.{f}" for f in TRANSCRIPTS))
    return (flag | kind.rlike(VOICE)) & F.coalesce(told, get(message, "$.content.text", "$.content.parts[0]")).isNotNull() | told.isNotNull()


def semantic(message: Column) -> Column:
    """One of eleven classes; the first rule that fits decides."""
    who = token(get(message, "$.author.role"))
    kind = token(get(message, "$.content.content_type", "$.content.contentType", "$.content.type"))
    to = token(get(message, "$.recipient", "$.target", "$.to", "$.metadata.recipient", "$.metadata.target", "$.metadata.to"))
    channel = token(get(message, "$.channel", "$.message_channel", "$.metadata.channel", "$.metadata.message_channel", "$.metadata.messageChannel"))
    name, status = token(get(message, "$.author.name")), token(get(message, "$.status"))
    event = token(get(message, "$.metadata.message_type", "$.metadata.messageType", "$.metadata.event_type", "$.metadata.eventType"))
    hidden = F.coalesce(get(message, "$.metadata.is_visually_hidden_from_conversation", kind="boolean"), F.lit(False))
    voice, ours = F.coalesce(is_voice(message), F.lit(False)), who == "assistant"
    return (
        F.when(message.isNull(), "unknown").when(who.isin("developer", "system"), who).when(who == "tool", "tool_result")
        .when(kind.isin(*RESULT_TYPES), "tool_result").when(kind.isin(*CALL_TYPES), "tool_call")
        .when(kind.isin(*REASONING_TYPES) | (channel == "analysis"), "reasoning")
        .when(voice & (who == "user"), "user_voice_transcript").when(voice & ours, "assistant_voice_transcript").when(who == "user", "user")
        .when(ours & ~to.isin("", "all", "assistant", "user", "none"), "tool_call").when(ours & name.rlike("tool|browser|python|api|connector"), "tool_call")
        .when(ours & ((channel == "commentary") | event.isin(*PROGRESS_TYPES) | status.isin("in_progress", "streaming") | hidden), "assistant_intermediate")
        .when(ours, "assistant_final").otherwise("unknown")
    )


def parts(message: Column, meaning: Column) -> Column:
    """Typed content parts: array<struct<type, text, language>>; unknown kinds are kept with their text."""
    source = F.coalesce(get(message, "$.content.content_type", "$.content.type"), F.lit("text"))
    listed = F.try_variant_get(message, "$.content.parts", "array<variant>")
    single = F.coalesce(F.try_variant_get(message, "$.content.text", "variant"), F.try_variant_get(message, "$.content.result", "variant"), F.try_variant_get(message, "$.content", "variant"))
    told = get(message, *(f"$.content.{f}" for f in TRANSCRIPTS), *(f"$.metadata.{f}" for f in TRANSCRIPTS))
    names = F.create_map(*(F.lit(x) for pair in PART_TYPES.items() for x in pair))
    forced = F.when(meaning.isin("tool_call", "tool_result"), meaning).when(meaning == "reasoning", "reasoning_summary")

    def one(part: Column) -> Column:
        plain = F.schema_of_variant(part) == "STRING"
        text = F.when(plain, F.try_variant_get(part, "$", "string")).otherwise(get(part, *(f"$.{f}" for f in (*TRANSCRIPTS, "text", "content", "result", "name", "url"))))
        own = F.when(source.isin("text", "multimodal_text"), F.coalesce(get(part, "$.content_type", "$.type"), source)).otherwise(source)
        code = (own == "code") | (get(part, "$.type", "$.content_type") == "code")
        kind = F.when(plain, "text").when(code, "code").otherwise(F.coalesce(names[own], F.lit("unknown")))
        return F.struct(F.coalesce(forced, kind).alias("type"), F.coalesce(text, F.when(code, "")).alias("text"), get(part, "$.language").alias("language"))

    spoken = F.array(F.struct(F.lit("text").alias("type"), told.alias("text"), F.lit(None).cast("string").alias("language")))
    empty = F.filter(spoken, lambda _: F.lit(False))
    return F.when(message.isNull(), empty).when(told.isNotNull() & meaning.endswith("voice_transcript"), spoken).otherwise(
        F.coalesce(F.transform(F.coalesce(listed, F.when(single.isNotNull(), F.array(single))), one), empty)
    )


def nodes(raw: DataFrame, column: str = "raw") -> DataFrame:
    """One row per node of every raw conversation (a JSON string), in the order of its mapping.

    conversation_id, node_id, ordinal, parent_id, children, message_id, role, semantic, stream_group, created_at, status, model, content, is_message
    """
    entry = "map<string,struct<parent:string,children:array<string>,message:string>>"
    doc = raw.select(
        F.coalesce(*(F.get_json_object(column, f"$.{k}") for k in ("id", "conversation_id", "conversationId"))).alias("conversation_id"),
        F.posexplode(F.map_entries(F.from_json(F.get_json_object(column, "$.mapping"), entry))).alias("ordinal", "e"),
    )
    doc = doc.select("conversation_id", "ordinal", F.col("e.key").alias("node_id"), F.col("e.value.parent").alias("parent_id"), F.coalesce("e.value.children", F.array().cast("array<string>")).alias("children"), F.try_parse_json(F.col("e.value.message")).alias("m"))
    m = F.col("m")
    doc = doc.withColumn("semantic", semantic(m))
    return doc.select(
        "conversation_id", "node_id", "ordinal", "parent_id", "children", get(m, "$.id").alias("message_id"), role(get(m, "$.author.role")).alias("role"), "semantic",
        F.coalesce(get(m, "$.metadata.stream_group_id", "$.metadata.streamGroupId", "$.metadata.content_block_id", "$.metadata.contentBlockId", "$.metadata.event_id", "$.metadata.eventId"), get(m, "$.id")).alias("stream_group"),
        instant(get(m, "$.create_time")).alias("created_at"), get(m, "$.status").alias("status"), get(m, "$.metadata.model_slug", "$.metadata.model").alias("model"),
        parts(m, F.col("semantic")).alias("content"), m.isNotNull().alias("is_message"),
    )


def heads(raw: DataFrame, column: str = "raw") -> DataFrame:
    """conversation_id, title, current_node, project_id, created_at, updated_at of raw conversations."""
    j = lambda *keys: F.coalesce(*(F.get_json_object(column, f"$.{k}") for k in keys))
    return raw.select(j("id", "conversation_id", "conversationId").alias("conversation_id"), F.coalesce(j("title"), F.lit("Untitled conversation")).alias("title"), j("current_node").alias("current_node"), j("gizmo_id", "conversation_template_id", "project_id").alias("project_id"), instant(j("create_time")).alias("created_at"), instant(j("update_time")).alias("updated_at"))


def branch(nodes_: DataFrame, heads_: DataFrame, rounds: int = 40) -> tuple[DataFrame, DataFrame]:
    """(path, trace): nodes from each current node up to its root, and root_reached, parent_breaks, cycle per conversation.

    Pointer doubling: after k rounds a node knows its 2**k-th ancestor, so a chain
    of n nodes takes about log2(n) joins; whoever still has an ancestor after
    all of a conversation's nodes are passed stands above a cycle.
    """
    ids = cut(nodes_.select("conversation_id", "node_id", "parent_id"))  # read by every join below, and parsed from whole texts
    known = ids.select("conversation_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("exists"))
    up = ids.join(known, ["conversation_id", "parent_id"], "left").select("conversation_id", "node_id", "parent_id", F.when(F.col("exists"), F.col("parent_id")).alias("jump"), F.lit(1).cast("long").alias("steps"))
    up = cut(up)
    # membership: the set of nodes reached from the current node doubles each round
    reached = heads_.join(ids, [heads_.conversation_id == ids.conversation_id, heads_.current_node == ids.node_id]).select(heads_.conversation_id, "node_id", F.lit(0).cast("long").alias("depth"))
    k, longest = 0, ids.groupBy("conversation_id").count().agg(F.max("count")).first()[0] or 0
    leap = up.where("jump IS NOT NULL").select("conversation_id", "node_id", "jump")  # who has no further ancestor leads nowhere
    while 2**k <= max(1, longest) * 2 and k < rounds:
        more = reached.join(leap, ["conversation_id", "node_id"]).select("conversation_id", F.col("jump").alias("node_id"), (F.col("depth") + 2**k).alias("depth"))
        reached = reached.union(more).groupBy("conversation_id", "node_id").agg(F.min("depth").alias("depth"))
        far = leap.select("conversation_id", F.col("node_id").alias("jump"), F.col("jump").alias("next"))
        leap = leap.join(far, ["conversation_id", "jump"]).select("conversation_id", "node_id", F.col("next").alias("jump"))
        k += 1
        reached, leap = cut(reached), cut(leap)  # both are used twice a round
        if leap.isEmpty():  # all chains have been passed; those of a cycle never end
            break
    path = reached
    tops = path.join(up, ["conversation_id", "node_id"])
    trace = tops.groupBy("conversation_id").agg(
        F.max(F.col("parent_id").isNull()).alias("root_reached"), F.count_if(F.col("parent_id").isNotNull() & F.col("jump").isNull()).alias("parent_breaks")
    )
    trace = heads_.select("conversation_id", "current_node").join(trace, "conversation_id", "left").select(
        "conversation_id", F.coalesce("root_reached", F.lit(False)).alias("root_reached"),
        (F.coalesce("parent_breaks", F.lit(0)) + F.when(F.col("current_node").isNotNull() & F.col("root_reached").isNull(), 1).otherwise(0)).cast("long").alias("parent_breaks"),
        (F.col("root_reached").isNotNull() & ~F.coalesce("root_reached", F.lit(False)) & (F.coalesce("parent_breaks", F.lit(0)) == 0)).alias("cycle"),
    )
    return path, trace


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder."""
    shared(df.sparkSession)
    return df.checkpoint()


def raw_of(messages: DataFrame) -> DataFrame:
    """Raw graph JSON of linear (conv_id, turn, role, text) conversations; one string per conversation."""
    node = F.struct(
        F.when(F.col("turn") > 0, F.concat(F.lit("n"), (F.col("turn") - 1).cast("string"))).alias("parent"), F.array().cast("array<string>").alias("children"),
        F.struct(F.concat(F.lit("m"), F.col("turn").cast("string")).alias("id"), F.struct(F.col("role").alias("role")).alias("author"),
                 F.struct(F.lit("text").alias("content_type"), F.array("text").alias("parts")).alias("content")).alias("message"),
    )
    rows = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.struct(F.concat(F.lit("n"), F.col("turn").cast("string")).alias("key"), node.alias("value")).alias("e")))).alias("es"), F.max("turn").alias("last"))
    mapping = F.map_from_entries(F.transform("es", lambda x: x["e"]))
    return rows.select("conv_id", F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title"), F.concat(F.lit("n"), F.col("last").cast("string")).alias("current_node"), mapping.alias("mapping"))).alias("raw"))
