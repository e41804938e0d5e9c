"""Fill-in-middle by relational units: a document is a relation of its tokens, and its cuts are found by a join.

1. A unit is a word with the white space before it, or white space at the end. `posexplode` makes a row for each unit.
2. A window sums unit lengths (code points) along a document, so a unit knows where it ends.
3. A document asks for two cuts by unit ordinal; requests and units meet by document and ordinal, and an aggregate brings the offsets of
   a document together.
4. Prefix, middle and suffix are substrings at those offsets, put together in the form that the document's hash picks.

Rows are dealt out by a row key once; units, requests, offsets and texts of a document stay in its task from then on, so no unit is
shuffled. Documents that stay plain ask for nothing and make no units.

Null text: the empty one. Null doc_id: hashed as `42:` alone. Repeated doc_ids: each row by itself, all with the same hashes. Extra columns are
ignored. A text with a marker in it stays plain, so the original always comes back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 42, 50, 80  #: percent of the documents that are transformed, and of those the ones that start with the suffix


def hashes(doc_id: Column, seed: int = SEED) -> list[Column]:
    """The first four 32-bit numbers of sha256 of seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def form(text: Column, h: list[Column], rate: int = RATE, spm: int = SPM) -> Column:
    """plain, spm or psm."""
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    return F.when((text == "") | marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)  # the first one is empty
    prefix, suffix = F.when(form == "psm", parts[1]).otherwise(parts[2]), F.when(form == "psm", parts[2]).otherwise(parts[1])
    return F.when(form == "plain", output).otherwise(F.concat(prefix, parts[3], suffix))


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """doc_id, text, n (units), form, prefix_chars, middle_chars (null if plain), output for each document."""
    dealt = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartition("row")
    h = hashes(F.col("doc_id"), seed)
    named = dealt.withColumn("form", form(F.col("text"), h, rate, spm)).withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("long"))
    cuts = [h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)]
    asked = named.withColumns({"first": F.least(*cuts), "second": F.greatest(*cuts)})

    # units of what isn't plain; posexplode_outer and no filter, so that all branches read the same exchange
    matches = F.when(F.col("form") != "plain", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)))
    units = dealt.withColumn("form", form(F.col("text"), h, rate, spm)).select("row", F.posexplode_outer(matches).alias("pos", "unit"))
    ends = units.select(F.col("row").alias("of"), (F.col("pos") + 1).alias("ordinal"), F.length("unit").alias("size"), "pos")
    ends = ends.select("of", "ordinal", F.sum("size").over(W.partitionBy("of").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)).alias("end"))
    requests = asked.select("row", "first", "second")
    met = requests.join(ends, (F.col("row") == F.col("of")) & ((F.col("ordinal") == F.col("first")) | (F.col("ordinal") == F.col("second"))))
    offsets = met.groupBy("row").agg(F.max(F.when(F.col("ordinal") == F.col("first"), F.col("end"))).alias("a"), F.max(F.when(F.col("ordinal") == F.col("second"), F.col("end"))).alias("b"))

    whole = asked.join(offsets, "row", "left").withColumns({"a": F.coalesce("a", F.lit(0)).cast("int"), "b": F.coalesce("b", F.lit(0)).cast("int")})
    text = F.col("text")
    prefix, middle, suffix = F.substring(text, F.lit(1), F.col("a")), F.substring(text, F.col("a") + 1, F.col("b") - F.col("a")), F.substring(text, F.col("b") + 1, F.length(text))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm_ = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    plain = F.col("form") == "plain"
    chars = lambda c: F.when(~plain, c.cast("long"))
    return whole.select("doc_id", "text", "n", "form", chars(F.col("a")).alias("prefix_chars"), chars(F.col("b") - F.col("a")).alias("middle_chars"), F.when(plain, text).when(F.col("form") == "psm", psm).otherwise(spm_).alias("output"))
