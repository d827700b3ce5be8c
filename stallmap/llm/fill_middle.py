"""Fill-in-the-middle: documents cut at two places and put in another order, so that a model learns to fill the gap.

A text is a row of units: runs of ASCII letters, and each other character by itself. regexp_count gives their number n; a hash of the id
draws two places among them, a and b. A pattern made for the row, the unit a times and then b - a times, captures prefix,
middle and suffix in one match, whose replacement is the output. The counted groups are possessive: the regex engine then walks over them in a loop,
and neither goes back nor needs stack for each unit, so long texts are cut like short ones.

All are column functions: a row for a row, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are cut; of 100 cut ones so many have the suffix first.
CUT, SUFFIX_FIRST = 90, 20
_ATOM = "(?:[A-Za-z]++|[^A-Za-z])"


def numbers(id_: Column, seed: int) -> list[Column]:
    """Four whole numbers under 2 ** 32 from the SHA-256 of seed and id; a null id counts as an empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    three = lambda first, second, third: rf"(?s)\A{first}(.*?){second}(.*?){third}(.*+)\z"
    return (
        F.when(form == "psm", F.regexp_replace(output, three(PREFIX, SUFFIX, MIDDLE), "$1$3$2"))
        .when(form == "spm", F.regexp_replace(output, three(SUFFIX, PREFIX, MIDDLE), "$2$3$1"))
        .otherwise(output)
    )


def fill_middle(docs: DataFrame, seed: int = 1, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n (units), form, prefix_chars, middle_chars (code points), output.

    form is plain (output is the text; prefix_chars and middle_chars are null), psm (`<P>`prefix`<S>`suffix`<M>`middle) or spm
    (`<S>`suffix`<P>`prefix`<M>`middle). Null and empty texts are plain and empty, and so stay texts that contain a sentinel, as their output
    couldn't be read back. Any of the three parts may be empty. Very long texts are cut as a whole; a task holds the units of
    one text while it counts them. Repeated rows, and different texts with one id, are drawn alike. Null ids are drawn like an empty one.
    An empty table gives no rows. Other columns of docs are not looked at.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = slim.withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("long"))
    h = numbers(F.col("doc_id"), seed)
    barred = F.lit(False)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        barred = barred | F.contains("text", F.lit(sentinel))
    form = F.when((F.col("text") == "") | barred | (h[2] % 100 >= cut), "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    places = [h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)]
    drawn = counted.select("*", form.alias("form"), F.least(*places).alias("a"), F.greatest(*places).alias("b"))
    pattern = F.format_string(rf"(?s)\A({_ATOM}{{%d}}+)({_ATOM}{{%d}}+)(.*+)", F.col("a"), F.col("b") - F.col("a"))
    order = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    made = drawn.withColumn("output", F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace(F.col("text"), pattern, order)))
    # No part contains a sentinel, and none can begin in one part and end in a sentinel, so these are the sentinels put in.
    at = lambda sentinel: F.instr(F.col("output"), sentinel).cast("long")
    prefix = F.when(F.col("form") == "psm", at(SUFFIX) - 4).when(F.col("form") == "spm", at(MIDDLE) - at(PREFIX) - 3)
    middle = F.when(F.col("form") == "psm", F.length("output") - at(MIDDLE) - 2).when(F.col("form") == "spm", F.length("output") - at(MIDDLE) - 2)
    return made.select("doc_id", "n", "form", prefix.alias("prefix_chars"), middle.cast("long").alias("middle_chars"), "output")
