"""Fill-in-middle: each text is cut in three by one regular-expression match and put together in another order.

``regexp_count`` gives the number of code points, a hash of the id the two cuts, and each row's own pattern takes a, b-a
and all further code points in possessive groups. The replacement names the groups in the form's order. All of it is
one narrow pass without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points that one match of the counting pattern takes, so that counting makes no object for each of them.
RUN = 4096


def code_points(text: Column) -> Column:
    """Whole runs of RUN code points, then those of the rest."""
    rest = F.regexp_extract(text, rf"(?s)\A(?:.{{{RUN}}})*+(.*+)\z", 1)
    return (F.regexp_count(text, F.lit(f"(?s).{{{RUN}}}")) * RUN + F.regexp_count(rest, F.lit("(?s)."))).cast("long")


def draws(salt: str, doc_id: Column) -> list[Column]:
    """The first four 8-digit groups of the hex SHA-256 of salt, colon and id."""
    digits = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, percent: int = 90, spm_percent: int = 20, salt: str = "1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n, form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output.

    Cuts are two draws modulo n + 1, in order; they may fall together or on the ends, so parts may be empty. ``percent``
    of the texts are changed, ``spm_percent`` of them with the suffix first. A null or empty text, and one that holds a
    marker, is plain. A null id draws as an empty one; repeated rows give equal rows; an empty table gives an empty one;
    other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    counted = rows.withColumns({"n": code_points(F.col("text"))} | {f"h{i + 1}": h for i, h in enumerate(draws(salt, F.col("doc_id")))})
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("n") == 0) | marked | (F.col("h3") % 100 >= percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    cut = counted.select("doc_id", "text", "n", F.least(one, two).alias("a"), F.greatest(one, two).alias("b"), form.alias("form"))
    pattern = F.concat(F.lit(r"(?s)\A(.{"), F.col("a"), F.lit("}+)(.{"), F.col("b") - F.col("a"), F.lit(r"}+)(.*+)\z"))
    order = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    changed = F.col("form") != "plain"
    return cut.select(
        "doc_id", "n", "form", F.when(changed, F.col("a")).alias("prefix_chars"), F.when(changed, F.col("b") - F.col("a")).alias("middle_chars"),
        F.when(changed, F.regexp_replace("text", pattern, order)).otherwise(F.col("text")).alias("output"),
    )


def restored(form: Column, output: Column) -> Column:
    """The text again, from the form and the output alone. A changed text held no marker, so each is found once."""
    psm = F.regexp_replace(output, rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*+)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*+)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(made: DataFrame) -> DataFrame:
    back = restored(F.col("form"), F.col("output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
