"""Line dedup in DataFrame expressions: content-defined chunks of lines, and runs of line pairs where chunks' edges fall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointloom.llm.common import staged

#: A boundary follows a line if the hash of it and the line before is 0 modulo this: chunks have about as many lines.
MEAN_LINES = 3
#: A line of so many words is a chunk by itself, and so many words make a run of line pairs a passage.
PASSAGE_WORDS = 50


def _words(line: Column) -> Column:
    """Words of a line: runs of other than white space."""
    spaces = F.translate(line, "\t\x0b\x0c\r", "    ")
    return F.size(F.filter(F.split(spaces, " "), lambda w: w != "")).cast("int")


def document_key() -> Column:
    """A document's id and whether it has one, as a hash key: null ids are one id, which no other equals, and sort first."""
    return F.struct(F.col("doc_id").isNotNull().alias("has"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"))


def keyed(docs: DataFrame) -> DataFrame:
    """(key, th, text) of the documents that have a text."""
    return docs.where("text is not null and text <> ''").select(document_key().alias("key"), F.xxhash64("text").alias("th"), "text")


def units(docs: DataFrame, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """Chunks of a document's lines, and pairs of adjacent lines: (key, th, kind, start, stop, hash, words, lead), lines
    counted from 0, stop inclusive; lead is the words of the first line. th is a hash of the text, so that rows with one id and other texts are told apart.

    A chunk ends where a rolling hash over two line hashes says, so an insertion elsewhere doesn't move it; and before and
    after a line of passage_words. Of chunks, those of several lines and of passage_words are given; pairs have kind 1."""
    lines = keyed(docs).select("key", "th", F.split("text", "\n", -1).alias("lines"))
    sized = lines.select("key", "th", F.transform("lines", lambda x: F.xxhash64(x)).alias("h"), F.transform("lines", _words).alias("w"), (F.size("lines") - 1).alias("last"))

    def ends(i: Column) -> Column:
        h, w = F.col("h"), F.col("w")
        before = F.get(h, F.greatest(i - 1, F.lit(0)))
        rolled = F.pmod(F.xxhash64(before, F.get(h, i)), F.lit(MEAN_LINES)) == 0
        return (i == F.col("last")) | rolled | (F.get(w, i) >= passage_words) | (F.coalesce(F.get(w, i + 1), F.lit(0)) >= passage_words)

    cut = sized.withColumn("stops", F.filter(F.sequence(F.lit(0), F.col("last")), ends))
    span = lambda a, b: F.slice(F.col("h"), a + 1, b - a + 1)
    total = lambda a, b: F.aggregate(F.slice(F.col("w"), a + 1, b - a + 1), F.lit(0), lambda x, y: x + y)
    one = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("stop"), F.xxhash64(F.lit(kind), span(a, b)).alias("hash"), total(a, b).alias("words"), F.get(F.col("w"), a).alias("lead"))
    chunks = F.transform("stops", lambda b, k: one(0, F.when(k == 0, F.lit(0)).otherwise(F.get(F.col("stops"), k - 1) + 1).cast("int"), b))
    chunks = F.filter(chunks, lambda u: ((u["stop"] > u["start"]) & (u["words"] > 0)) | (u["words"] >= passage_words))
    pairs = F.when(F.col("last") > 0, F.transform(F.sequence(F.lit(0), F.col("last") - 1), lambda i: one(1, i, i + 1)))
    both = F.concat(chunks, F.coalesce(pairs, F.array().cast("array<struct<kind:int,start:int,stop:int,hash:bigint,words:int,lead:int>>")))
    return cut.select("key", "th", F.explode(both).alias("u")).select("key", "th", "u.*")


def repeats(docs: DataFrame, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """The units that are another occurrence of the bytes of an earlier one: (key, th, kind, start, stop, words, lead).

    Hashes only choose: the texts of units whose hash occurs twice are fetched and compared. If the least and the greatest text
    of a hash are equal, all are; otherwise (hashes collide) its units are grouped by their texts. The first occurrence, by id,
    text hash and line, isn't among the result. All sums and least values are aggregated before they are shuffled, and joined
    to by joins that adaptive execution can split, so a line that a third of all documents share is nobody's single task. The texts
    are shuffled here and once more when lines are taken out; the files of the first shuffle go before the second."""
    made = staged(units(docs, passage_words), "units")
    twice = made.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    wanted = made.join(twice, "hash").groupBy("key", "th").agg(F.collect_list(F.struct("hash", "kind", "start", "stop", "words", "lead")).alias("units"))
    got = keyed(docs).join(wanted, ["key", "th"]).withColumn("lines", F.split("text", "\n", -1))
    unit = F.col("u")
    spelled = got.select("key", "th", "lines", F.explode("units").alias("u")).select(
        "key", "th", "u.*", F.array_join(F.slice("lines", unit["start"] + 1, unit["stop"] - unit["start"] + 1), "\n").alias("bytes")
    )
    place = F.struct("key", "th", "start")
    whole = spelled.groupBy("hash").agg(F.min("bytes").alias("lo"), F.max("bytes").alias("hi"), F.count("*").alias("n"), F.min(place).alias("first"))
    whole = staged(whole.select("hash", (F.col("lo") == F.col("hi")).alias("same"), "n", "first"), "compared", free=True)
    occurs = made.join(whole.where("same and n > 1").select("hash", "first"), "hash").where(place != F.col("first"))
    names = ["key", "th", "kind", "start", "stop", "words", "lead"]
    mixed = whole.where("not same").select("hash")
    if not mixed.isEmpty():
        apart = spelled.join(mixed, "hash")
        first = apart.groupBy("hash", "bytes").agg(F.min(place).alias("first"))
        occurs = occurs.select(*names).unionByName(apart.join(first, ["hash", "bytes"]).where(place != F.col("first")).select(*names))
    return occurs.select(*names).distinct()


def removals(docs: DataFrame, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """Runs of lines to take out: (key, th, runs array<struct<start,stop>>), one row for each text that has some.

    Repeated chunks go. Where a shared passage begins or ends within a chunk, its lines there aren't a chunk of their own; they
    are a run of repeated pairs of lines, which goes if it meets a chunk that goes, or has passage_words itself."""
    found = repeats(docs, passage_words)
    by = Window.partitionBy("key", "th", "kind").orderBy("start")
    # islands: pairs (i, i + 1), (i + 1, i + 2), ... in a row make one run; chunks stand alone
    isle = found.withColumn("isle", F.when(F.col("kind") == 1, F.col("start") - F.row_number().over(by)).otherwise(F.col("start")))
    # a run's words: the first lines of its pairs, and the second line of the last
    words = (F.sum("lead") + F.max_by(F.col("words") - F.col("lead"), "start")).alias("words")
    runs = isle.groupBy("key", "th", "kind", "isle").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), words)
    run = F.struct("start", "stop", "words")
    both = runs.groupBy("key", "th").agg(F.collect_list(F.when(F.col("kind") == 0, run)).alias("chunks"), F.collect_list(F.when(F.col("kind") == 1, run)).alias("pairs"))
    meets = lambda p: (p["words"] >= passage_words) | F.exists("chunks", lambda c: (c["start"] <= p["stop"]) & (p["start"] <= c["stop"]))
    gone = F.concat("chunks", F.filter("pairs", meets))
    return both.select("key", "th", F.transform(gone, lambda r: F.struct(r["start"].alias("start"), r["stop"].alias("stop"))).alias("runs")).where(F.size("runs") > 0)


def dedup_lines(docs: DataFrame, passage_words: int = PASSAGE_WORDS, report: bool = True, n_chars: str | None = None) -> DataFrame:
    """docs with every column as it came, but text without repeated passages, and with report a column removed_lines (long) beside
    them. n_chars names a column that gets the length of the text left.

    A line ends at \\n. Chunks of several lines, and single lines of passage_words, that occur again (in another document or
    later in the same) are removed but for the first occurrence, whole and byte for byte equal. Short lines that repeat alone
    stay. Null and empty texts stay as they are. A text all of which is repeated becomes empty; its row stays. Null ids are
    dealt with as one id that comes first. Rows with the same id and text are one document: all keep or lose the same lines.
    Other columns may have any names; one named removed_lines is replaced. An empty table gives an empty table."""
    # the columns of docs travel as one, so that no name of theirs meets one used here
    own = docs.select(document_key().alias("key"), F.xxhash64("text").alias("th"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    joined = own.join(removals(docs, passage_words), ["key", "th"], "left")
    text = F.col("row.text")
    lines = F.split(text, "\n", -1)
    kept = F.filter(lines, lambda line, i: ~F.exists("runs", lambda r: (r["start"] <= i) & (i <= r["stop"])))
    out = joined.select("row", F.when(F.col("runs").isNotNull(), kept).alias("left"))
    left = F.when(F.col("left").isNotNull(), F.array_join("left", "\n")).otherwise(text)
    gone = F.when(F.col("left").isNotNull(), (F.size(lines) - F.size("left")).cast("long")).otherwise(F.lit(0).cast("long"))
    made = {"text": left} | ({n_chars: F.length(left).cast(docs.schema[n_chars].dataType)} if n_chars else {}) | ({"removed_lines": gone} if report else {})
    names = [c for c in docs.columns if c not in made or c in ("text", n_chars)]
    return out.select(*(made.get(c, F.col("row").getField(c)).alias(c) for c in names), *([gone.alias("removed_lines")] if report else []))
