"""Scalar text functions as Column expressions; nothing here leaves the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as Python's \s has it: Java's Unicode classes and the four ASCII separators.
SPACE = r"(?U)[\s\x1c-\x1f]"
NOT_SPACE = r"(?U)[^\s\x1c-\x1f]"

# Fixed values.
USER, MODEL = "用户：", "模型："
STOPWORDS = ("继续", "好", "好的", "可以", "嗯", "对", "行", "ok", "okay", "继续吧", "然后呢", "然后", "是的", "对的", "好呀", "接着说")
CONTINUE = "继续"
HAN = r"[\x{4e00}-\x{9fff}]"
HAN_OR_PUNCTUATION = r"[\x{4e00}-\x{9fff}，。！？；：、'（）《》…—]"
ONLY_PUNCTUATION = r"""^[，。！？；：、,.!?;:…—\-'"()\[\]{}]*$"""
TURN_MARKERS = ("\n用户：", "\n模型：", "\nUser:", "\nModel:")
SENTENCE_ENDS = "。！？…!?~～"
#: What strip_noise() takes out, in this order: fenced and inline code, links, home paths, control characters, white space.
NOISE = (
    r"(?s)```.*?```",
    r"`[^`\n]{1,80}`",
    rf"https?://(?:{NOT_SPACE})+",
    r"(?U)[Cc]:\\\\[\w.\\]+|[\\/](?:home|Users|root|tmp)[\\/][\w./-]*",
    r"[\x00-\x08\x0b\x0c\x0e-\x1f]",
    f"{SPACE}+",
)


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def no_spaces(text: Column, space: str = SPACE) -> Column:
    return F.regexp_replace(text, space, "")


def strip_noise(text: Column) -> Column:
    """Without fenced and inline code, links, home paths and control characters; white space runs become one space."""
    for pattern in NOISE:
        text = F.regexp_replace(text, pattern, " ")
    return F.trim(text)


def char_len(text: Column, space: str = SPACE) -> Column:
    """Characters that are not white space."""
    return F.length(no_spaces(text, space))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def class_ratio(text: Column, character_class: str = HAN_OR_PUNCTUATION, space: str = SPACE) -> Column:
    """Share of the characters of a class among those that are not white space."""
    return ratio(F.regexp_count(text, F.lit(character_class)), char_len(text, space))


def whitespace_ratio(text: Column, space: str = SPACE) -> Column:
    return ratio(F.regexp_count(text, F.lit(space)), F.length(text))


def unify_spaces(text: Column) -> Column:
    """Ideographic spaces become plain ones."""
    return F.translate(text, "　", " ")


def is_degenerate(text: Column) -> Column:
    """Without white space: empty, only punctuation, or one character more than twice."""
    bare = no_spaces(text)
    return bare.rlike(ONLY_PUNCTUATION) | bare.rlike(r"(?s)^(.)\1{2,}$")


def turn_structure(text: Column, user: str = "用户", model: str = "模型") -> Column:
    """Struct of n_user, n_model, turns (the greater) and has_structure, from labels followed by either colon."""
    n_user, n_model = (F.regexp_count(text, F.lit(f"{label}[:：]")) for label in (user, model))
    structured = (n_user + n_model >= 2) & (text.contains(model) | F.lower(text).contains("model"))
    return F.struct(
        n_user.alias("n_user"),
        n_model.alias("n_model"),
        F.greatest(n_user, n_model).alias("turns"),
        structured.alias("has_structure"),
    )


def truncate_at_turn(text: Column, markers: tuple[str, ...] = TURN_MARKERS) -> Column:
    """Text before a turn marker: the first marker in list order that occurs at all decides, not the earliest."""
    out = text
    for marker in reversed(markers):
        at = F.instr(text, marker)
        out = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(out)
    return out


def clip_sentence(text: Column, ends: str = SENTENCE_ENDS) -> Column:
    """Text up to its last sentence end; unchanged if it has none."""
    clipped = F.regexp_extract(text, f"(?s)^(.*[{ends}])", 1)
    return F.when(clipped != "", clipped).otherwise(text)


def prompt(text: Column) -> Column:
    return F.concat(F.lit(USER), text, F.lit(f"\n{MODEL}"))


def without_prefix(text: Column, prefix: Column) -> Column:
    return F.when(F.startswith(text, prefix), F.substring(text, F.length(prefix) + 1, F.length(text))).otherwise(text)


def human_size(n_bytes: Column) -> Column:
    """1.5 KB and the like; GB is the largest unit. Halves go to the even digit: 1280 bytes are 1.2 KB."""
    shown = lambda power, unit: F.format_string(f"%.1f {unit}", F.bround(n_bytes / 1024**power, 1))
    out = shown(3, "GB")
    for power, unit in ((2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n_bytes < 1024 ** (power + 1), shown(power, unit)).otherwise(out)
    return out


def eos_cut(ids: Column, eos: int) -> Column:
    """Struct of eos_pos (0-based, null if there is none) and the ids before it."""
    at = F.array_position(ids, eos)
    return F.struct(
        F.when(at > 0, at - 1).alias("eos_pos"),
        F.when(at > 0, F.slice(ids, F.lit(1), (at - 1).cast("int"))).otherwise(ids).alias("ids"),
    )
