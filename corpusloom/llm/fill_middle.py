"""Fill-in-middle transformation by marker injection: the text itself carries the cuts, so only string functions are needed."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as bytes; a unit is a word with the white space before it, or white space that ends the text.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The delimiter put after each unit, the character that escapes it, and what stands for each of them in escaped text.
#: None of them is white space, so escaping moves no edge of a unit.
CUT, ESCAPE = "\x01", "\x02"
OF_CUT, OF_ESCAPE = ESCAPE + "c", ESCAPE + "e"


def before(text: Column, mark: str | Column, count: int | Column) -> Column:
    """What stands before the count-th mark, or behind the count-th from the end where count is negative; empty for 0."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.call_function("substring_index", text, as_column(mark), as_column(count))


def escaped(text: Column) -> Column:
    """text without the delimiter: unescaped() gives it back."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(OF_ESCAPE)), F.lit(CUT), F.lit(OF_CUT))


def unescaped(text: Column) -> Column:
    """The text of a part of marked units. Behind each escape stands the letter of what it replaced, so the order is safe."""
    whole = F.replace(text, F.lit(CUT), F.lit(""))
    return F.replace(F.replace(whole, F.lit(OF_CUT), F.lit(CUT)), F.lit(OF_ESCAPE), F.lit(ESCAPE))


def draw(digest: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def transform(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 42,
    rate: int = 50,
    spm_rate: int = 80,
) -> DataFrame:
    """docs with a struct column `fim`: n, form, prefix_chars, middle_chars, output.

    A text of n units is cut after two of the n + 1 places between units, drawn by the sha256 of seed and id. In
    `rate` of a hundred texts, drawn likewise, the parts are put in another order with a mark before each:
    suffix, prefix, middle (form spm, in spm_rate of a hundred of them) or prefix, suffix, middle (psm). The others,
    empty texts and texts that hold a mark are left as they are (plain, null lengths).

    The delimiter is escaped, put after each unit by one regexp_replace, and counted by the bytes that it added;
    the parts are what stands before or between the delimiters of the drawn ranks. Only the parts are unescaped.

    Everything is a projection over built-in functions: no shuffle, one pass, and a text of any length is held
    a few times by the task that has its row. Null texts count as empty (output empty); a null id is drawn like an
    empty one; rows that repeat an id and text repeat the result. Other columns pass through, one named `fim` is
    replaced. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    rows = docs.select(F.struct("*").alias("row"), text.alias("text"), F.sha2(key, 256).alias("digest"))  # names can't clash
    held = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        held |= F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | held | (draw(F.col("digest"), 2) % 100 >= rate)
    form = F.when(plain, "plain").when(draw(F.col("digest"), 3) % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.select("row", "text", "digest", form.alias("form"), escaped(F.col("text")).alias("escaped"))
    rows = rows.select("*", F.regexp_replace("escaped", UNIT, f"$0{CUT}").alias("marked"))
    count = (F.octet_length("marked") - F.octet_length("escaped")).cast("long")
    rows = rows.select("row", "text", "digest", "form", "marked", count.alias("n"))
    places = [draw(F.col("digest"), k) % (F.col("n") + 1) for k in (0, 1)]
    low, high = F.least(*places).cast("int"), F.greatest(*places).cast("int")
    rows = rows.select("row", "text", "form", "marked", "n", low.alias("low"), high.alias("high"))
    some = F.when(F.col("form") != "plain", F.col("marked"))  # plain texts are not cut
    parts = rows.select(
        "row", "text", "form", "n",
        unescaped(before(some, CUT, F.col("low"))).alias("prefix"),
        unescaped(before(before(some, CUT, F.col("high")), CUT, F.col("low") - F.col("high"))).alias("middle"),
        unescaped(before(some, CUT, (F.col("high") - F.col("n") - 1).cast("int"))).alias("suffix"),
    )
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"))
        .otherwise(F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
    )
    fim = F.struct(
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        output.alias("output"),
    )
    done = parts.select("row", fim.alias("fim"))
    return done.select(*(F.col("row")[c].alias(c) for c in docs.columns if c != "fim"), "fim")


def restored(output: Column, form: Column) -> Column:
    """The text from which an output of this form was made. A transformed output holds each mark once."""
    between = lambda first, last: before(before(output, last, 1), first, -1)
    middle = before(output, MIDDLE, -1)
    return (
        F.when(form == "plain", output)
        .when(form == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))
        .otherwise(F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
    )
