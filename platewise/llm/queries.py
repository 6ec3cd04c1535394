"""Registered queries of this subpackage and the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm import canonical, cooccurrence, encoding, mixing, quality, setjoin
from platewise.operators.packed import PHRASES, split_packed
from platewise.runtime import cut
from platewise.sources.tables import table


def p1_lift(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of items in at least five and a thousandth of the recipes, with their lift."""
    return cooccurrence.frequent_pairs(table(spark, folder, "corpus", "ingredients_norm"), "ingredients_norm", 5, 1)


def p1_lift_all(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of items that a recipe holds together, with their lift."""
    return cooccurrence.frequent_pairs(table(spark, folder, "corpus", "ingredients_norm"), "ingredients_norm", 1, 0)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    big = "decimal(38,0)"
    n, ab, a, b = (F.col(c).cast(big) for c in ("n", "n_ab", "n_a", "n_b"))
    return p1_lift(spark, folder).where(n * ab >= a * b * 5).select("item_a", "item_b")


def _ingredient_sets(spark: SparkSession, folder: str) -> DataFrame:
    return setjoin.records(table(spark, folder, "corpus", "id", "ingredients_norm"), "id", "ingredients_norm")


def _tag_sets(spark: SparkSession, folder: str) -> DataFrame:
    return setjoin.records(table(spark, folder, "recipes", "id", "tags"), "id", split_packed("tags", PHRASES))


def _linked(sets: DataFrame, least: int = 6) -> tuple[DataFrame, DataFrame]:
    members = cut(setjoin.by_content(sets, least))
    return members, setjoin.similar_pairs(members.where("id = rep").select("id", "vals"), 4, 5, least)


def p3_ingredient_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of recipes with nearly the same ingredients."""
    return setjoin.expand(*_linked(_ingredient_sets(spark, folder)))


def p3_tag_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of recipes with nearly the same tags."""
    return setjoin.expand(*_linked(_tag_sets(spark, folder)))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    fields = {"ingredients_norm": p3_ingredient_pairs, "tags": p3_tag_pairs}
    one, two = (q(spark, folder).select(F.lit(f).alias("field"), "id_a", "id_b") for f, q in fields.items())
    return one.unionByName(two)


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each recipe's class of equal sets and its number of similar recipes, by ingredients and by tags."""
    counted = [setjoin.link_counts(*_linked(sets(spark, folder))).select(F.lit(f).alias("field"), "*") for f, sets in (("ingredients_norm", _ingredient_sets), ("tags", _tag_sets))]
    return counted[0].unionByName(counted[1])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    corpus = table(spark, folder, "corpus", "id", "ingredients", "has_unmappable").where("has_unmappable")
    values = corpus.select("id", F.posexplode("ingredients").alias("pos", "val"))
    return canonical.map_values(values, table(spark, folder, "ingr_map")).select("id", "pos", "replaced")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents", "doc_id", "text")
    return documents.select("doc_id", encoding.encode(documents, "text").alias("ids"))


def p6_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Every text as its ids decode to it."""
    ids = p6_ids(spark, folder)
    return ids.select("doc_id", encoding.decode(ids, "ids").alias("text"))


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, folder, "documents", "doc_id", "text", "source")
    sized = documents.select(
        F.col("doc_id").alias("id"), F.array(mixing.normal_source("source")).alias("sources"), encoding.count_tokens(documents, "text").alias("size")
    )
    return mixing.mix(sized, mixing.read_targets(table(spark, folder, "mix_targets")))


def p7_mix_report(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mix(spark, folder)[1]


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document is used."""
    return _mix(spark, folder)[0].withColumnRenamed("id", "doc_id")


def p7_mix_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual shares when equal texts are one document that belongs to the sources of all its copies."""
    documents = table(spark, folder, "documents", "doc_id", "text", "source").where("text is not null")
    copies = documents.select(F.sha2("text", 256).alias("sig"), "doc_id", mixing.normal_source("source").alias("source"))
    # the sources of a text are as many as there are sources, whatever its copies
    classes = cut(copies.groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.collect_set("source").alias("sources")).select("doc_id", "sources"))
    one = documents.select("doc_id", "text").join(classes, "doc_id")
    sized = one.select(F.col("doc_id").alias("id"), "sources", encoding.count_tokens(one, "text").alias("size"))
    return mixing.mix(sized, mixing.read_targets(table(spark, folder, "mix_targets")))[1]


def _texts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "documents", "doc_id", "text", "lang"), table(spark, folder, "common_words")


def p8_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Quality statistics of every document."""
    documents, common = _texts(spark, folder)
    return quality.statistics(documents, "doc_id", "text", "lang", common)


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Outlier scores of every document that has a text."""
    return quality.scores(cut(p8_statistics(spark, folder)), "doc_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    documents, common = _texts(spark, folder)
    return quality.kinds(documents, p8_scores(spark, folder), "doc_id", "text", "lang", common)


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_lift, p1_lift_all, p3_found, p3_ingredient_pairs, p3_tag_pairs, p3_classes, p5_found, p6_ids, p6_decoded,
        p7_mix_report, p7_mix, p7_mix_overlap, p8_found, p8_statistics, p8_scores,
    )
}

_PAIRS = """
WITH rows_ AS (SELECT id, ingredients_norm FROM corpus WHERE len(ingredients_norm) > 0),
held AS (SELECT DISTINCT id, item FROM (SELECT id, unnest(ingredients_norm) AS item FROM rows_) WHERE item IS NOT NULL),
one AS (SELECT item, count(*) AS n FROM held GROUP BY item),
two AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM held a JOIN held b ON a.id = b.id AND a.item < b.item GROUP BY ALL),
pairs AS (
    SELECT item_a, item_b, n_ab, a.n AS n_a, b.n AS n_b, (SELECT count(*) FROM rows_) AS n
    FROM two JOIN one a ON a.item = item_a JOIN one b ON b.item = item_b
    WHERE n_ab >= 5 AND 1000 * n_ab >= (SELECT count(*) FROM rows_))
"""
_SETS = """
WITH held AS (SELECT DISTINCT id, val FROM (SELECT id, unnest(ingredients_norm) AS val FROM corpus) WHERE val IS NOT NULL),
sized AS (SELECT id, count(*) AS n FROM held GROUP BY id HAVING count(*) >= 6),
pairs AS (
    SELECT a.id AS id_a, b.id AS id_b FROM held a JOIN held b ON a.val = b.val AND a.id < b.id
    JOIN sized x ON x.id = a.id JOIN sized y ON y.id = b.id
    GROUP BY a.id, b.id, x.n, y.n HAVING 5 * count(*) >= 4 * (x.n + y.n - count(*)))
"""
_P8 = {"space": quality.SPACE, "words": quality.WORDS, "lines": quality.LINES, "ended": quality.ENDED.replace("'", "''"), "stops": quality.STOPS.replace("'", "''"), "vowels": quality.VOWELS}
_STATISTICS = r"""
WITH texts AS (SELECT doc_id, CASE WHEN coalesce(lower(trim(lang)), '') IN ('', 'und') THEN '*' ELSE lower(trim(lang)) END AS lang, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, regexp_extract_all(lower(t), '%(words)s') AS ws FROM texts),
counted AS (
    SELECT *, len(ws) AS n, length(regexp_replace(t, '[%(space)s]+', '', 'g')) AS solid, length(regexp_replace(t, '[\p{L}\p{M}\p{N}%(space)s]+', '', 'g')) AS symbols,
        length(array_to_string(ws, '')) AS letters, length(regexp_replace(array_to_string(ws, ''), '[^%(vowels)s]+', '', 'g')) AS vowels,
        len(regexp_extract_all(t, '%(lines)s')) AS lines, len(regexp_extract_all(t, '%(ended)s')) AS ended, len(regexp_extract_all(t, '%(stops)s')) AS stops, len(list_distinct(ws)) AS different
    FROM worded),
held AS (SELECT doc_id, lang, unnest(ws) AS w FROM worded),
hits AS (SELECT doc_id, count(*) AS listed FROM held WHERE w IN (SELECT lower(word) FROM common_words c WHERE c.lang = held.lang OR held.lang NOT IN (SELECT lang FROM common_words WHERE lang IS NOT NULL)) GROUP BY 1)
SELECT doc_id, lang, n AS word_count, CASE WHEN solid > 0 AND n > 0 THEN letters / n::DOUBLE END AS mean_word_length, CASE WHEN solid > 0 THEN symbols / solid::DOUBLE END AS symbol_ratio,
    CASE WHEN solid > 0 AND lines > 0 THEN ended / lines::DOUBLE END AS punct_line_share, CASE WHEN solid > 0 THEN coalesce(listed, 0) / greatest(n, 1)::DOUBLE END AS common_word_share,
    CASE WHEN solid > 0 THEN 1e0 - (different + CASE WHEN n = 0 THEN 1 ELSE 0 END) / greatest(n, 1)::DOUBLE END AS repeated_word_share, CASE WHEN solid > 0 THEN stops / greatest(n, 1)::DOUBLE END AS stop_rate,
    CASE WHEN solid > 0 AND lines > 0 THEN n / lines::DOUBLE END AS words_per_line, CASE WHEN solid > 0 AND letters > 0 THEN vowels / letters::DOUBLE END AS vowel_share
FROM counted LEFT JOIN hits USING (doc_id)
""".replace("\\\\p", "\\p") % _P8
SQL = {
    "p8_statistics": _STATISTICS,
    "p1_found": _PAIRS + "SELECT item_a, item_b FROM pairs WHERE n * n_ab >= 5 * n_a * n_b",
    "p1_lift": _PAIRS + "SELECT *, n * n_ab::DOUBLE / (n_a::DOUBLE * n_b) AS lift FROM pairs",
    "p3_ingredient_pairs": _SETS + "SELECT id_a, id_b FROM pairs",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
