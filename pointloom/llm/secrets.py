"""Secret scans in DataFrame expressions: fixed patterns, and character Markov models of random strings and identifiers."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds of the base in order, each with its pattern and the characters that a match (assign: its value) needs.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST = {"assign": 12, "access": 18}
#: Strings that the models judge, and how much likelier, in natural log, random must be: by character, and for short strings in all.
CANDIDATE, MARGIN, LEAST_MARGIN = r"[A-Za-z0-9+/_=-]{12,}", 0.5, 11.0
#: Characters of access and hex matches, one by one, the first by what must follow it and others by the match before them.
ACCESS_CHARACTER, HEX_CHARACTER = r"\G(?!^)[A-Z0-9]|A(?=KIA[A-Z0-9]{14})", r"(?:\G(?!^)|(?=[0-9a-f]{16}))[0-9a-f]"
#: Matches whose positions are summed up at a time.
BLOCK = 128
IDENTIFIER = r"[A-Za-z][A-Za-z0-9_-]{4,}"
#: Labelled samples: documents whose base matches are the random strings, and of them those whose other words are identifiers.
RANDOM_DOCS, IDENTIFIER_DOCS = 20_000, 2_000
SPAN = "array<struct<start:int,rank:int,stop:int>>"


def _empty() -> Column:
    return F.array().cast(SPAN)


def matched(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost matches, or what a group of them has; texts without a match are told by a cheaper look."""
    return F.when(text.rlike(pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))


def located(between: Column, whole: Column, value: Column, kind: str) -> Column:
    """The spans of matches, in code points. What stands between matches and the matches themselves take turns, so that running
    sums of their lengths are the positions. Matches shorter than LEAST are dropped after that.

    Adding to an array copies it, so sums run over blocks of BLOCK matches and then over the blocks."""
    rank = KINDS.index(kind)
    lengths = F.zip_with(whole, value, lambda w, v: F.struct(F.length(w).alias("w"), F.length(v).alias("v")))
    sizes = F.zip_with(F.slice(between, F.lit(1), F.size(whole)), lengths, lambda b, x: F.struct(F.length(b).alias("b"), x["w"].alias("w"), x["v"].alias("v")))
    # sizes are the variable of an outer function, and so computed once and not for each block
    cut = lambda x: F.transform(F.sequence(F.lit(1), F.size(x), F.lit(BLOCK)), lambda i: F.slice(x, i, F.lit(BLOCK)))
    blocks = F.element_at(F.transform(F.array(sizes), cut), 1)

    def add(acc: Column, x: Column) -> Column:
        start = (acc["at"] + x["b"]).cast("int")
        stop = (start + x["w"]).cast("int")
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.when(x["v"] >= LEAST.get(kind, 0), F.array_append(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    def add_block(acc: Column, block: Column) -> Column:
        inner = F.aggregate(block, F.struct(acc["at"].alias("at"), _empty().alias("found")), add)
        return F.struct(inner["at"].alias("at"), F.array_append(acc["found"], inner["found"]).alias("found"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))
    return F.when(F.size(whole) > 0, F.aggregate(blocks, start, add_block, lambda acc: F.flatten(acc["found"]))).otherwise(_empty())


def masked(text: Column, between: Column, whole: Column, value: Column) -> Column:
    """The text with spaces for what the base finds, of the same length."""
    each = F.zip_with(whole, value, lambda w, v: F.when(F.length(v) >= LEAST["assign"], F.repeat(F.lit(" "), F.length(w))).otherwise(w))
    rest = F.element_at(between, -1)
    without = F.when(F.size(whole) > 0, F.concat(F.array_join(F.zip_with(F.slice(between, F.lit(1), F.size(whole)), each, lambda b, x: F.concat(b, x)), ""), rest)).otherwise(text)
    return F.regexp_replace(F.regexp_replace(without, ACCESS_CHARACTER, " "), HEX_CHARACTER, " ")


def _pairs(token: Column) -> Column:
    """The codes of each two characters in turn as one number."""
    codes = F.transform(F.split(token, ""), F.ascii)
    return F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: a * 128 + b)


def log_ratios(random: dict[int, int], plain: dict[int, int]) -> list[float]:
    """log P(b after a | random) - log P(b after a | identifier) at 128 * a + b; one is added to each count of the alphabet. Pairs
    with a mark say nothing: texts join few words by marks, and names join many."""
    alphabet = [ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]
    out = [0.0] * (128 * 128)
    for a in alphabet:
        total = [sum(counts.get(128 * a + b, 0) for b in alphabet) + len(alphabet) for counts in (random, plain)]
        for b in alphabet:
            key = 128 * a + b
            if not (chr(a).isalnum() and chr(b).isalnum()):
                continue
            out[key] = math.log((random.get(key, 0) + 1) / total[0]) - math.log((plain.get(key, 0) + 1) / total[1])
    return out


def fit(docs: DataFrame, text: Column, random_docs: int = RANDOM_DOCS, identifier_docs: int = IDENTIFIER_DOCS) -> list[float]:
    """Log ratios from weakly labelled samples: values that the base finds are random, other words are identifiers.

    Documents are sampled by a hash of id and text, as many as the parameters say on average; the driver gets pair counts, of
    which there are 128 * 128 at most for each label."""
    rows = docs.count()
    at = F.pmod(F.xxhash64("doc_id", text), F.lit(1 << 30))
    bound = lambda n: int((1 << 30) * min(1.0, n / max(1, rows)))
    sample = docs.select(text.alias("t"), at.alias("at")).where(F.col("at") < bound(random_docs))
    t = F.col("t")
    values = F.concat(
        F.filter(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= LEAST["assign"]),
        F.filter(F.regexp_extract_all(t, F.lit(ACCESS), F.lit(0)), lambda v: F.length(v) >= LEAST["access"]),
        F.regexp_extract_all(t, F.lit(HEX), F.lit(0)),
    )
    random = sample.where(t.rlike(f"{ASSIGN}|{ACCESS}|{HEX}")).select(F.explode(values).alias("token"), F.lit(1).alias("label"))
    rest = F.regexp_replace(F.regexp_replace(t, ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    plain = sample.where(F.col("at") < bound(identifier_docs)).select(F.explode(F.regexp_extract_all(rest, F.lit(IDENTIFIER), F.lit(0))).alias("token"), F.lit(0).alias("label"))
    pairs = random.unionByName(plain).select("label", F.explode(_pairs(F.col("token"))).alias("pair"))
    counts: tuple[dict[int, int], dict[int, int]] = ({}, {})
    for r in pairs.groupBy("label", "pair").agg(F.count("*").alias("n")).collect():
        counts[r["label"]][r["pair"]] = r["n"]
    return log_ratios(counts[1], counts[0])


def _text_of(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["stop"])), ",")


def _digest(spans: Column) -> Column:
    return F.sha2(_text_of(spans), 256)


def scan(docs: DataFrame, ratios: Sequence[float] | None = None, margin: float = MARGIN) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov), one row per input row.

    Spans are kind:start:stop in code points, stop exclusive, by start and then by kind as listed. A hex or access match of
    the base is a whole run of its characters, so its least length can be part of the pattern; an assignment whose value is too
    short still uses up its text, so that is checked after matching. The models judge the strings of 12 characters and more that
    are left when the base's matches are taken out; they add those that are likelier random by margin a character, and by
    LEAST_MARGIN in all. Null and empty texts have no spans; a null doc_id stays null; repeated rows are scanned each; an empty
    table gives no rows. Only expressions run on the executors, and a text takes time about in proportion to its length."""
    text = F.coalesce(F.col("text"), F.lit(""))
    if ratios is None:
        ratios = fit(docs, text)
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in ratios)), ",").cast("array<double>")
    patterns = {"assign": (ASSIGN, 2), "access": (ACCESS, 0), "hex": (HEX, 0)}
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    parts = parts.select("*", *(matched(F.col("text"), p).alias(f"w_{k}") for k, (p, _) in patterns.items()), matched(F.col("text"), ASSIGN, 2).alias("v_assign"))
    parts = parts.select("*", *(F.when(F.size(f"w_{k}") > 0, F.split("text", p, -1)).otherwise(F.array("text")).alias(f"b_{k}") for k, (p, _) in patterns.items()))
    value = lambda k: F.col("v_assign" if k == "assign" else f"w_{k}")
    base = parts.select("doc_id", *(located(F.col(f"b_{k}"), F.col(f"w_{k}"), value(k), k).alias(k) for k in patterns), masked(F.col("text"), F.col("b_assign"), F.col("w_assign"), F.col("v_assign")).alias("open"))
    left = base.select("*", matched(F.col("open"), CANDIDATE).alias("w"))
    left = left.select("*", F.when(F.size("w") > 0, F.split("open", CANDIDATE, -1)).otherwise(F.array().cast("array<string>")).alias("b"))
    maybe = left.select("doc_id", *patterns, F.zip_with(located(F.col("b"), F.col("w"), F.col("w"), "markov"), F.col("w"), lambda span, w: F.struct(span.alias("span"), w.alias("token"))).alias("maybe"))

    def secret(x: Column) -> Column:
        ratio = F.aggregate(_pairs(x["token"]), F.lit(0.0), lambda acc, p: acc + F.element_at(table, p.cast("int") + 1))
        return ratio > F.greatest(F.lit(LEAST_MARGIN), margin * (F.length(x["token"]) - 1))

    added = F.transform(F.filter("maybe", secret), lambda x: x["span"])
    spans = maybe.select("doc_id", *patterns, F.concat(*patterns).alias("base"), added.alias("markov"))
    count = lambda c: F.size(c).cast("long")
    return spans.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), _digest(F.col("base")).alias("base_sha256"), _text_of(F.concat("base", "markov")).alias("spans"), count("markov").alias("n_markov")
    )
