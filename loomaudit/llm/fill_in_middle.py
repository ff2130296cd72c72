"""Fill-in-the-middle examples, cut at units, in relational steps.

A unit is a run of letters A-Z or any other single code point. The units of each
document become rows (posexplode), a window sums their lengths, requests for
cuts (document, ordinal of a unit) are joined on, and the offsets that they meet
come together in one row for each document, where `substring` makes the parts.

Cuts and form follow from doc_id by SHA-256, so they are the same on every run.
A text that holds a sentinel stays plain; its output is the text, and so the way
back from output and form is exact for every text.

Null texts are empty; a null doc_id counts as one without digits. Equal rows
(doc_id, text) are cut once and give as many rows as there were. Other columns
of the input are left out. An empty table gives an empty table. The units of one
text are one array while they are dealt out, so a task holds some 30 bytes for
each code point of its longest text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What marks the parts of an output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred, how many documents are transformed, and how many of those begin with the suffix.
TRANSFORMED, SUFFIX_FIRST = 90, 20
LETTERS, UNIT = "[A-Za-z]+", "[A-Za-z]+|[^A-Za-z]"
PLAIN, PSM, SPM = "plain", "psm", "spm"
_KEY = ["key1", "key2"]  # 128 bits that stand for (doc_id, text)


def _draw(doc_id: Column, n: int) -> Column:
    """The n-th number below 2**32 that a document draws."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substr(digest, F.lit(8 * n - 7), F.lit(8)), 16, 10).cast("bigint")


def requests(docs: DataFrame, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Distinct documents (key1, key2, doc_id, text, copies) with n units, the form, and the ordinals of the last units of prefix and middle."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key1"), F.xxhash64(F.lit(1), "doc_id", F.coalesce("text", F.lit(""))).alias("key2"))
    n = F.length(F.regexp_replace("text", LETTERS, "a")).cast("bigint")
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (_draw(F.col("doc_id"), 3) % 100 >= transformed)
    form = F.when(plain, PLAIN).when(_draw(F.col("doc_id"), 4) % 100 < suffix_first, SPM).otherwise(PSM)
    # Worked out before rows are dealt by key, once. As one struct, so that all that read behind the exchange need the same columns of it and share it.
    known = keyed.withColumns({"n": n, "form": form, "draw1": _draw(F.col("doc_id"), 1), "draw2": _draw(F.col("doc_id"), 2)})
    once = known.groupBy(*_KEY).agg(F.first(F.struct("doc_id", "text", "n", "form", "draw1", "draw2")).alias("doc"), F.count("*").alias("copies"))
    first, second = (F.col(f"doc.{c}") % (F.col("doc.n") + 1) for c in ("draw1", "draw2"))
    return once.select(*_KEY, "doc.doc_id", "doc.text", "doc.n", "doc.form", F.least(first, second).alias("prefix_units"), F.greatest(first, second).alias("middle_units"), "copies")


def offsets(asked: DataFrame) -> DataFrame:
    """(key1, key2, prefix_end, middle_end), in code points, of what `requests` asks for. Units behind the last cut are not dealt out; a cut at ordinal 0 meets no unit."""
    cut = asked.where((F.col("form") != PLAIN) & (F.col("middle_units") > 0) & (F.col("copies") > 0))
    lengths = F.transform(F.slice(F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)), F.lit(1), F.col("middle_units").cast("int")), F.length)
    units = cut.select(*_KEY, F.posexplode(lengths).alias("pos", "length"))
    upto = Window.partitionBy(*_KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = units.select(*_KEY, (F.col("pos") + 1).alias("ordinal"), F.sum("length").over(upto).alias("end"))
    wanted = cut.select(*_KEY, "prefix_units", "middle_units")
    # Only the document is a key, so that units stay where the window has put them.
    met = ends.join(wanted.hint("shuffle_hash"), _KEY).where((F.col("ordinal") == F.col("prefix_units")) | (F.col("ordinal") == F.col("middle_units")))
    return met.groupBy(*_KEY).agg(*(F.max(F.when(F.col("ordinal") == F.col(f"{part}_units"), F.col("end"))).alias(f"{part}_end") for part in ("prefix", "middle")))


def transformed(docs: DataFrame, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, output, prefix_chars, middle_chars) of docs (doc_id, text), a row for each."""
    asked = requests(docs, transformed, suffix_first)
    both = asked.join(offsets(asked).hint("shuffle_hash"), _KEY, "left")
    is_cut = F.col("form") != PLAIN
    first, second = F.coalesce("prefix_end", F.lit(0)), F.coalesce("middle_end", F.lit(0))
    cut = both.withColumns({"prefix_chars": F.when(is_cut, first.cast("bigint")), "middle_chars": F.when(is_cut, (second - first).cast("bigint"))})
    text = F.col("text")
    prefix, middle, suffix = F.substr(text, F.lit(1), F.col("prefix_chars").cast("int")), F.substr(text, (F.col("prefix_chars") + 1).cast("int"), F.col("middle_chars").cast("int")), F.substr(text, (F.col("prefix_chars") + F.col("middle_chars") + 1).cast("int"))
    before, behind = F.concat(F.lit(PREFIX), prefix), F.concat(F.lit(SUFFIX), suffix)
    end = F.concat(F.lit(MIDDLE), middle)
    output = F.when(~is_cut, text).when(F.col("form") == SPM, F.concat(behind, before, end)).otherwise(F.concat(before, behind, end))
    made = cut.select("doc_id", "n", "form", output.alias("output"), "prefix_chars", "middle_chars", "copies")
    return made.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("copy", "copies")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of some form was made of."""
    inner = F.substr(output, F.lit(len(PREFIX) + 1))
    head = F.substring_index(inner, MIDDLE, 1)
    middle = F.substr(inner, F.length(head) + len(MIDDLE) + 1)

    def joined(mark: str, suffix_first: bool) -> Column:
        one = F.substring_index(head, mark, 1)
        two = F.substr(head, F.length(one) + len(mark) + 1)
        return F.concat(two, middle, one) if suffix_first else F.concat(one, middle, two)

    return F.when(form == PSM, joined(SUFFIX, False)).when(form == SPM, joined(PREFIX, True)).otherwise(output)
