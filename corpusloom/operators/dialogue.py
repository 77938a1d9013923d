"""Dialogue records of several shapes as canonical blocks, and pairing of turns from conversation logs."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MODEL, USER, strip

#: Blocks in a log message that make its turn unusable (fixed values, spelling included).
NON_TEXT_BLOCKS = ("tool_use", "tool_result", "isUesrError", "image", "file")
#: Fixed limits and openings of the question-answer source.
MOST_QUESTION, MOST_ANSWER = 300, 600
MACHINE_OPENINGS = "^(作为|我是|首先，)"


def clean(text: Column) -> Column:
    """Stripped; null counts as empty."""
    return strip(F.coalesce(text, F.lit("")))


def single_turn(user: Column, model: Column) -> Column:
    """Block of one question and answer, null if either is empty."""
    block = F.concat(F.lit(USER), user, F.lit(f"\n{MODEL}"), model)
    return F.when((user != "") & (model != ""), block)


def turns(entries: Column, role: Callable[[Column], Column], text: Callable[[Column], Column], names: dict[str, str]) -> Column:
    """Labelled lines of an array of turns; empty turns and roles without a label are left out."""

    def line(e: Column) -> Column:
        label = None
        for name, shown in names.items():
            label = F.when(role(e) == name, shown) if label is None else label.when(role(e) == name, shown)
        return F.when(clean(text(e)) != "", F.concat(label, clean(text(e))))

    return F.filter(F.transform(entries, line), lambda x: x.isNotNull())


def joined(lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n"))


def from_question(rows: DataFrame) -> Column:
    """question, answer_zh."""
    return single_turn(clean(F.col("question")), clean(F.col("answer_zh")))


def from_conversations(rows: DataFrame) -> Column:
    """conversations: array of (from, value); human and gpt or assistant speak."""
    names = {"human": USER, "gpt": MODEL, "assistant": MODEL}
    return joined(turns(F.col("conversations"), lambda e: e["from"], lambda e: e["value"], names))


def from_exchanges(rows: DataFrame) -> Column:
    """conversation: array of (human, assistant), each of which may give a user and a model turn."""
    said = lambda e, field, label: F.when(clean(e[field]) != "", F.concat(F.lit(label), clean(e[field])))
    both = F.flatten(F.transform("conversation", lambda e: F.array(said(e, "human", USER), said(e, "assistant", MODEL))))
    return joined(F.filter(both, lambda x: x.isNotNull()))


def from_instruction(rows: DataFrame) -> Column:
    """instruction, input, output; a non-empty input follows the instruction on a line of its own."""
    asked, more = clean(F.col("instruction")), clean(F.col("input"))
    return single_turn(F.when(more != "", F.concat_ws("\n", asked, more)).otherwise(asked), clean(F.col("output")))


def from_messages(rows: DataFrame) -> Column:
    """prompt or else messages: array of (role, content), closed by the chosen reply."""
    sources = [F.when(F.size(c) > 0, F.col(c)) for c in ("prompt", "messages") if c in rows.columns]
    history = F.coalesce(*sources)
    lines = turns(history, lambda e: e["role"], lambda e: e["content"], {"user": USER, "assistant": MODEL})
    chosen = clean(F.col("chosen")) if "chosen" in rows.columns else F.lit("")
    lines = F.concat(lines, F.when(chosen != "", F.array(F.concat(F.lit(MODEL), chosen))).otherwise(F.array().cast("array<string>")))
    return F.when(history.isNotNull(), joined(lines))


def from_answers(rows: DataFrame) -> Column:
    """INSTRUCTION, RESPONSE; long ones and answers that open like a machine's are left out."""
    asked, answer = clean(F.col("INSTRUCTION")), clean(F.col("RESPONSE"))
    fits = (F.length(asked) <= MOST_QUESTION) & (F.length(answer) <= MOST_ANSWER) & ~answer.rlike(MACHINE_OPENINGS)
    return F.when(fits, single_turn(asked, answer))


#: Row shapes by name; register_shape() adds to them.
SHAPES: dict[str, Callable[[DataFrame], Column]] = {
    "question": from_question,
    "conversations": from_conversations,
    "exchanges": from_exchanges,
    "instruction": from_instruction,
    "messages": from_messages,
    "answers": from_answers,
}


def register_shape(name: str, shape: Callable[[DataFrame], Column], replace: bool = False) -> None:
    """Add a shape of one's own: a function of the rows that gives the column of their blocks, null where there is none.

    A name that is there already is an error unless it is to be replaced.
    """
    if name in SHAPES and not replace:
        raise ValueError(f"there is a shape {name} already")
    SHAPES[name] = shape


def to_blocks(rows: DataFrame, shape: str | Callable[[DataFrame], Column]) -> DataFrame:
    """rows with a column block, without those that give none; the shape is a name or a function. An unknown name raises KeyError."""
    made = SHAPES[shape] if isinstance(shape, str) else shape
    return rows.withColumn("block", made(rows)).where("block is not null")


def render(conversations: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """(conv_id, n_turns, block) of rows (conv_id, turn, role, text): labelled turns in order.

    Empty turns and roles without a label are left out, conversations without turns too.
    """
    labels = labels or {"user": USER, "assistant": MODEL}
    label = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))[F.col("role")]
    said = conversations.withColumn("_text", clean(F.col("text"))).where("_text <> ''").where(label.isNotNull())
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat(label, "_text").alias("line"))))
    return said.groupBy("conv_id").agg(lines.alias("_lines")).select(
        "conv_id",
        F.size("_lines").cast("long").alias("n_turns"),
        F.array_join(F.transform("_lines", lambda x: x["line"]), "\n").alias("block"),
    )


def insert_eos(blocks: DataFrame, key: list[str], eos: str = "<eos>", user: str = USER, model: str = MODEL) -> DataFrame:
    """blocks with eos lines after each model reply.

    A reply is open from its labelled line to the next turn line, blank line or the end. White space before a
    label doesn't matter; empty lines go, lines of white space stay and close the reply too. A block is cut
    before the lines that close, within the row, so nothing is shuffled and rows may share a key; null stays null.
    """
    quoted = lambda label: rf"\Q{label}\E"
    inline = r"[\s\x1c-\x1f&&[^\n]]*"
    parts = F.split("block", rf"(?U)\n(?={inline}(?:{quoted(user)}|{quoted(model)}|\n|\z))")
    reply = lambda part: F.regexp_like(part, F.lit(rf"(?U)^{inline}{quoted(model)}"))
    closed = F.transform(parts, lambda part: F.when(reply(part), F.concat(part, F.lit("\n" + eos))).otherwise(part))
    block = F.regexp_replace(F.array_join(closed, "\n"), r"\n\n+", "\n")
    return blocks.select(*key, F.regexp_replace(block, r"\A\n|\n\z", "").alias("block"))


def first_replies(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Pairs of a usable user turn and the first reply after it, from classified events.

    events has kind (user, bad_user, bad_reply or reply) and text; everything else is to be left out before,
    so that it doesn't stand between a turn and its reply.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    paired = events.select(*key, *order, "kind", "text", F.lag("kind").over(w).alias("_kind"), F.lag("text").over(w).alias("_user"))
    paired = paired.where("kind = 'reply' and _kind = 'user'")
    return paired.select(*key, *order, F.col("_user").alias("user"), F.col("text").alias("asst"))


def pair_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, user, asst): each user turn with the first assistant turn before the next user turn."""
    text = F.coalesce("text", F.lit(""))
    kind = F.when(F.col("role") == "user", F.when(text != "", "user").otherwise("bad_user")).when(
        (F.col("role") == "assistant") & (text != ""), "reply"
    )
    return first_replies(conversations.select("conv_id", "turn", kind.alias("kind"), text.alias("text")).where("kind is not null"), ["conv_id"], ["turn"])


def log_events(lines: DataFrame) -> DataFrame:
    """(path, line_no, kind, text) of a log whose lines (path, line_no, value) are JSON messages.

    A message's content is a string or a list of typed blocks. A list with a block that is not text makes
    the turn unusable; lists without text (thinking) are left out, and so are lines that are not JSON.
    """
    v = F.try_parse_json("value")
    blocks = F.try_variant_get(v, "$.message.content", "array<struct<type string, text string>>")
    plain = F.try_variant_get(v, "$.message.content", "string")
    kind = F.try_variant_get(v, "$.type", "string")
    row = lines.select("path", "line_no", kind.alias("type"), blocks.alias("blocks"), plain.alias("plain"))
    bad = F.exists("blocks", lambda b: b["type"].isin(*NON_TEXT_BLOCKS))
    texts = F.filter("blocks", lambda b: (b["type"] == "text") & b["text"].isNotNull())
    text = F.array_join(F.transform(texts, lambda b: b["text"]), " ")
    text = F.when(F.col("blocks").isNotNull(), text).when(F.col("type") == "user", F.col("plain"))
    listed = F.col("blocks").isNotNull()
    user = F.when(listed & bad, "bad_user").when(F.coalesce(text, F.lit("")) != "", "user").otherwise("bad_user")
    # a plain string is usable even when it is empty: the reply is what decides
    user = F.when(~listed & F.col("plain").isNotNull(), "user").otherwise(user)
    reply = F.when(listed & bad, "bad_reply").when(listed & (F.size(texts) > 0), "reply")
    found = row.select(
        "path",
        "line_no",
        F.when(F.col("type") == "user", user).when(F.col("type") == "assistant", reply).alias("kind"),
        text.alias("text"),
    )
    return found.where("kind is not null")


def session_pairs(events: DataFrame) -> DataFrame:
    """(session, nth, user, asst) of an event log (session, seq, kind, turn, idx, text).

    kind is user (a user's text), chunk (a piece of the reply of a turn) or end (the turn ends). Chunks of
    one (turn, idx) are put together in order, blocks in the order they begin; replies end where end says or
    with the session. Users and replies of a session are then paired by position, up to the shorter.
    """
    users = events.where("kind = 'user' and text <> ''")
    order = Window.partitionBy("session").orderBy("seq")
    users = users.select("session", F.row_number().over(order).alias("nth"), F.col("text").alias("user"))
    ends = F.sum(F.when(F.col("kind") == "end", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    chunks = events.withColumn("reply", F.coalesce(ends, F.lit(0))).where("kind = 'chunk'")
    whole = lambda parts: F.array_join(F.transform(F.array_sort(parts), lambda p: p["text"]), "")
    blocks = chunks.groupBy("session", "reply", "turn", "idx").agg(
        F.min("seq").alias("seq"), whole(F.collect_list(F.struct("seq", "text"))).alias("text")
    )
    replies = blocks.groupBy("session", "reply").agg(whole(F.collect_list(F.struct("seq", "text"))).alias("asst")).where("asst <> ''")
    nth = F.row_number().over(Window.partitionBy("session").orderBy("reply"))
    return users.join(replies.select("session", nth.alias("nth"), "asst"), ["session", "nth"])
