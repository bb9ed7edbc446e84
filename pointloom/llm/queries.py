"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Vocabulary files come with the environment; their folder is looked up when a query runs.
WORD_TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.lmscore import score

    return score(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.language import identify

    return identify(table(spark, sf_dir, "documents"), vocabulary(PIECES))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.html import extract

    return extract(table(spark, sf_dir, "pages"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.linededup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary(WORD_TOKENIZER), capacity=2048)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ppm_score,
        op2_language_id,
        op3_html_extraction,
        op4_benchmark_decontamination,
        op5_toxicity,
        op6_minhash_near_dedup,
        op7_secret_scan,
        op8_quality_rules,
        op9_line_dedup,
        op10_best_fit_packing,
    )
}

#: Words: runs of other than ASCII white space, with A-Z in lower case.
_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""

ORACLE_SQL: dict[str, str] = {
    # all pairs that share a shingle, and the components of the links by a walk over them
    "op6_minhash_near_dedup": f"""with recursive d as (select doc_id, {_WORDS} as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) end) as g from d),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
r as (select doc_id as id, doc_id as reached from d union select r.id, l.b from r join l on l.a = r.reached),
m as (select id, min(reached) as component_id from r group by id)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, m.component_id, d.doc_id = m.component_id as kept from d left join n on n.doc_id = d.doc_id join m on m.id = d.doc_id""",
    # hits of an item's shingles in a document, and what each window that holds a hit has in common with the item
    "op4_benchmark_decontamination": r"""with i as (select distinct item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as w from benchmark),
d as (select distinct doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as w from documents),
ig as (select item_id, len(w) - 4 as m, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' '))) as g from i where len(w) >= 5),
ic as (select item_id, m, g, count(*) as c from ig group by all),
dg as (select doc_id, len(w) - 4 as total, unnest(range(1, len(w) - 3)) as pos, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' '))) as g from d where len(w) >= 5),
h as (select doc_id, total, pos, item_id, m, g, c from dg join ic using (g)),
s as (select doc_id, item_id, m, g, c, unnest(range(greatest(1, pos - m + 1), least(pos, total - m + 1) + 1)) as start from h),
c as (select doc_id, item_id, m, start, g, least(count(*), any_value(c)) as both_have from s group by all),
v as (select doc_id, item_id, start, cast(sum(both_have) as double) as x, m from c group by doc_id, item_id, start, m),
f as (select *, x / (2 * m - x) as similarity from v where 100 * x >= 80 * (2 * m - x))
select doc_id, item_id, max(similarity) as similarity, cast(arg_min(start, (-similarity, start)) - 1 as bigint) as start from f group by doc_id, item_id""",
}
