"""Lexicon and text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.functions import text as T
from platewise.functions.numeric import settled
from platewise.operators import content
from platewise.operators import lexicon as L
from platewise.plans.profiling import TAGS_SQL
from platewise.plans.cleaning import parse_lists
from platewise.sources.tables import table

#: The queries' own lexicon: fourteen kinds of kitchen items, in words counted in the tables; any other is read by ``Lexicon.read``.
SAMPLE = L.Lexicon(
    [
        (cls, layer, term)
        for cls, layers in {
            "allium": ("onion garlic shallot leek chive scallion", "onion powder, garlic powder", "pickle relish"),
            "berry": ("raspberry strawberry blueberry blackberry gooseberry cranberry redcurrant", "", ""),
            "brassica": ("cabbage kale collard broccoli cauliflower turnip watercress arugula", "bok choy, brussels sprout", "coleslaw mix"),
            "cheese": ("cheese cheddar parmesan mozzarella ricotta cotija provolone mascarpone", "monterey jack, queso fresco", "lasagna sheet"),
            "citrus": ("lemon lime orange", "lemon juice, lemon zest, lime zest", "mango chutney"),
            "egg": ("egg", "", "custard powder, mayonnaise"),
            "herb": ("basil parsley dill thyme oregano rosemary tarragon cilantro mint chervil", "bay leaf, sage leaf", "salsa verde"),
            "legume": ("bean lentil chickpea", "split pea, snow pea, snap pea, pigeon pea, miso paste", "baked beans, refried beans"),
            "mushroom": ("mushroom shiitake", "", ""),
            "nut": ("walnut pecan hazelnut macadamia almond", "pine nut, almond flour", "chocolate spread"),
            "pepper": ("pepper jalapeno poblano serrano cayenne chipotle", "chili powder, scotch bonnet, paprika", "hot sauce"),
            "poultry": ("chicken turkey duck", "chicken broth, chicken thigh, turkey leg", "poultry seasoning"),
            "squash": ("squash pumpkin zucchini", "pumpkin puree", ""),
            "stone": ("peach plum apricot nectarine cherry", "", "apricot jam"),
        }.items()
        for layer, words in zip(("direct", "derived", "composite"), layers, strict=True)
        for term in (words.split() if layer == "direct" else words.split(", "))
        if term
    ],
    exempt={"pepper": ("black pepper", "white pepper"), "citrus": ("lemongrass", "lime leaf", "lemon balm"), "egg": ("eggplant",), "nut": ("almond extract",), "stone": ("cherry tomato", "plum tomato"), "legume": ("bean sprout",), "allium": ("onion flower",)},
)
#: which tag claims the absence of a class
CLAIMS = {"egg": "egg-free", "cheese": "vegan", "poultry": "vegetarian"}
#: Raw substrings that exclude an item from the third regime, blanks included.
BLACKLIST = (
    "pork", "bacon", "ham ", "gammon", "prosciutto", "pancetta", "chorizo",
    "salami", "pepperoni", "lard", "gelatin", "gelatine", "suet",
    "wine", "beer", "ale ", "lager", "rum", "vodka", "brandy", "sherry",
    "whisky", "whiskey", "bourbon", "liqueur", "kirsch", "marsala", "vermouth",
    "sake", "mirin", "champagne", "cognac", "amaretto", "creme de",
)
#: Substrings that reject a note, and the most characters it may have.
FORBIDDEN = (
    "safe", "safety", "allergen", "allergy", "allergic", "intoleran",
    "medical", "medicine", "doctor", "diagnos", "cure", "treat", "prescri",
    "healthy for you", "good for your", "won't harm", "no risk", "risk-free",
)
MOST_CHARS = 320
#: Tags and their marks by priority, and the mark of the rest.
CATEGORIES = [
    ("seafood", "🦐"), ("fish", "🐟"), ("poultry", "🍗"), ("chicken", "🍗"),
    ("beef", "🥩"), ("pork", "🥓"), ("lamb-sheep", "🍖"), ("meat", "🍖"),
    ("pasta", "🍝"), ("pizza", "🍕"), ("sandwiches", "🥪"),
    ("soups-stews", "🍲"), ("salads", "🥗"), ("curries", "🍛"),
    ("rice", "🍚"), ("grains", "🌾"), ("potatoes", "🥔"), ("beans", "🫘"),
    ("eggs", "🥚"), ("cheese", "🧀"), ("breads", "🍞"), ("fruit", "🍎"),
    ("vegetables", "🥦"), ("greens", "🥬"), ("side-dishes", "🥄"),
]
NO_CATEGORY = "🍽️"
BANNED = ("oats", "olives", "peas", "goat cheese", "")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "corpus", "id", "ingredients").select("id", L.joined_text("ingredients").alias("text"))


def lex_flags(spark: SparkSession, folder: str) -> DataFrame:
    return L.flags(_texts(spark, folder), F.col("text"), SAMPLE).drop("text")


def _long_flags(spark: SparkSession, folder: str) -> DataFrame:
    flagged = lex_flags(spark, folder)
    return flagged.unpivot(["id"], [f"has_{c}" for c in SAMPLE.classes], "class", "fires").withColumn("class", F.substring("class", 5, 99))


def lex_layer(spark: SparkSession, folder: str) -> DataFrame:
    """Layer of the longest matching term per class."""
    return _texts(spark, folder).select("id", *(SAMPLE.layer(F.col("text"), c).alias(f"layer_{c}") for c in SAMPLE.classes))


def lex_theta_join(spark: SparkSession, folder: str) -> DataFrame:
    """The same layers by a join with the term table."""
    return L.matches(_texts(spark, folder), "id", F.col("text"), SAMPLE)


def lex_layer_counts(spark: SparkSession, folder: str) -> DataFrame:
    return lex_theta_join(spark, folder).groupBy("class").pivot("layer", list(SAMPLE.layers)).count().na.fill(0)


def lex_none(spark: SparkSession, folder: str) -> DataFrame:
    """Rows without any class."""
    any_ = F.lit(False)
    for c in SAMPLE.classes:
        any_ = any_ | F.col(f"has_{c}")
    return lex_flags(spark, folder).agg(F.count("*").alias("n"), F.count_if(~any_).alias("n_none"))


def lex_contradiction(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose tags claim the absence of a class that the text shows."""
    claims = spark.createDataFrame(list(CLAIMS.items()), "class string, tag string")
    fired = _long_flags(spark, folder).where("fires")
    claimed = parse_lists(spark, folder).join(F.broadcast(claims), "tag")
    return fired.join(claimed, ["id", "class"]).groupBy("class").agg(F.count("*").alias("n"))


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    """Prediction from entered strings against a truth from canonical ones: a direct or derived term is a whole word."""
    c = table(spark, folder, "corpus", "id", "ingredients_norm").select("id", L.joined_text("ingredients_norm").alias("norm"))
    words = {k: "|".join(t.text for t in ts if t.layer != "composite") for k, ts in SAMPLE.terms.items()}
    truth = c.select("id", *(F.coalesce(F.col("norm").rlike(rf"\b({w})\b"), F.lit(False)).alias(k) for k, w in words.items()))
    return _long_flags(spark, folder).join(truth.unpivot(["id"], list(words), "class", "truth"), ["id", "class"])


def lex_confusion(spark: SparkSession, folder: str) -> DataFrame:
    """Confusion counts per class and over all (class null)."""
    return L.confusion(_judged(spark, folder), "class", "fires", "truth")


def strat_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Three rows per class and outcome by an arithmetic key."""
    return L.stratified(_judged(spark, folder), ["class", "fires"], F.struct((F.col("id") * 7919) % 10007, "id"), 3).select("class", "fires", "id")


def sample_exclusion(spark: SparkSession, folder: str) -> DataFrame:
    """A second sample that shares no row with the first."""
    rest = _judged(spark, folder).join(strat_sample(spark, folder), "id", "left_anti")
    return L.stratified(rest, ["class", "fires"], F.struct((F.col("id") * 6007) % 10007, "id"), 2).select("class", "fires", "id")


def tag_and_term_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Rows by a tag whitelist and by a list of raw substrings that are matched unstripped."""
    tags = parse_lists(spark, folder).groupBy("id").agg(F.bool_or(F.col("tag") == "vegetarian").alias("vegetarian"), F.bool_or(F.col("tag") == "vegan").alias("vegan"))
    hit = F.lit(False)
    for term in BLACKLIST:
        hit = hit | F.col("text").contains(term)
    rows = _texts(spark, folder).join(tags, "id", "left")
    return rows.select("id", F.coalesce("vegetarian", F.lit(False)).alias("vegetarian"), F.coalesce("vegan", F.lit(False)).alias("vegan"), (~F.coalesce(hit, F.lit(False))).alias("no_listed_term"))


def slug(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "corpus", "id", "name").select("id", T.slug(F.col("name"), F.col("id")).alias("slug"))


def url_valid(spark: SparkSession, folder: str) -> DataFrame:
    return slug(spark, folder).agg(F.count("*").alias("n"), F.count_if(T.is_slug(F.col("slug"))).alias("n_valid"))


def safety_filter(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "recipes", "id", "description")
    return r.groupBy(T.safe_note(F.col("description"), FORBIDDEN, MOST_CHARS).alias("accepted")).agg(F.count("*").alias("n"))


def escape_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ingr_map", "raw_ingr").distinct().select("raw_ingr", T.escape_markdown(F.col("raw_ingr")).alias("plain"))


def category_mark(spark: SparkSession, folder: str) -> DataFrame:
    sets = parse_lists(spark, folder).groupBy("id").agg(F.collect_set("tag").alias("tags"))
    return sets.select("id", T.first_category(F.col("tags"), CATEGORIES, NO_CATEGORY).alias("mark"))


def pref_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Preference terms of each customer, from a comma list of likes."""
    c = table(spark, folder, "customer", "c_custkey", "c_mktsegment").withColumn("likes", F.concat(F.lit(" Brown Sugar, ,"), F.lower("c_mktsegment"), F.lit(" , salt,")))
    return c.select("c_custkey", F.array_join(T.preference_tokens(T.split_list(F.col("likes")), F.array(F.col("c_mktsegment"), F.lit(" North African"))), " ").alias("tokens"))


def exclude_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that hold a word starting with the stem of each banned term."""
    texts = _texts(spark, folder)
    one = texts.agg(*(F.count_if(T.excluded(F.col("text"), t)).alias(t or "empty") for t in BANNED))
    return one.unpivot([], one.columns, "term", "n")


def excluded_terms_report(spark: SparkSession, folder: str) -> DataFrame:
    """Of each banned term: the items it removes, and the eight most frequent strings among theirs that it matches."""
    rows = table(spark, folder, "corpus", "id", "ingredients").select("id", F.explode("ingredients").alias("i")).select("id", F.lower("i").alias("item"))
    terms = F.array_compact(F.array(*(F.when(T.excluded(F.col("item"), t), F.lit(t)) for t in BANNED if t)))
    hits = rows.select("id", "item", F.explode(terms).alias("term"))
    removed = hits.groupBy("term").agg(F.countDistinct("id").alias("removed"))
    found = content.top_k(hits.groupBy("term", "item").agg(F.count("*").alias("n")), "term", [F.desc("n"), F.col("item")], 8)
    return found.join(F.broadcast(removed), "term").select("term", "removed", "rn", "item", "n")  # a row per banned term


def macro_split(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "corpus", "id", "protein_g", "fat_g", "carbs_g", "calories")
    shares = T.energy_split(F.col("protein_g"), F.col("fat_g"), F.col("carbs_g"))
    return c.select("id", *(settled(v).alias(k) for k, v in shares.items()), settled(T.meter(F.col("calories") / 800.0)).alias("meter"))


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "corpus", "id", "name", "calories", "protein_g", "minutes")
    share = F.floor(F.col("calories") / 2000.0 * 100.0 + 0.5).cast("long")
    protein = F.floor(F.col("protein_g") / 50.0 * 100.0 + 0.5).cast("long")
    return c.withColumns({"share": share, "protein": protein})


def derived_note(spark: SparkSession, folder: str) -> DataFrame:
    """A note put together from numbers: energy, protein from 15 %, time against a budget of 30 minutes."""
    parts = [
        F.concat(F.lit("gives "), F.col("share").cast("string"), F.lit("% of the day's energy")),
        F.when(F.col("protein") >= 15, F.concat(F.lit("gives "), F.col("protein").cast("string"), F.lit("% of the protein"))),
        F.when(F.col("minutes") > 30, F.lit("takes longer than planned")).when(F.col("minutes") * 2 <= 30, F.lit("is quick")),
    ]
    return _facts(spark, folder).select("id", F.concat_ws("; ", *parts).alias("note"))


def fact_block(spark: SparkSession, folder: str) -> DataFrame:
    lines = [F.concat(F.lit("name: "), F.coalesce("name", F.lit("?"))), F.concat(F.lit("energy share: "), F.col("share").cast("string")), F.concat(F.lit("minutes: "), F.col("minutes").cast("string"))]
    return _facts(spark, folder).select("id", F.concat_ws("\n", *lines).alias("facts"))


def note_choice(spark: SparkSession, folder: str) -> DataFrame:
    """A given text where it passes the filter, else the derived note."""
    given = table(spark, folder, "recipes", "id", "description").groupBy("id").agg(F.min("description").alias("given"))
    both = derived_note(spark, folder).join(given, "id", "left")
    kept = F.when(T.safe_note(F.col("given"), FORBIDDEN, MOST_CHARS), F.col("given"))
    return both.select("id", F.coalesce(kept, "note").alias("note"), F.when(kept.isNotNull(), F.lit("given")).otherwise(F.lit("derived")).alias("origin"))


QUERIES = {
    f.__name__: f
    for f in (
        lex_flags, lex_layer, lex_theta_join, lex_layer_counts, lex_none, lex_contradiction, lex_confusion, strat_sample, sample_exclusion, tag_and_term_flags,
        slug, url_valid, safety_filter, escape_markdown, category_mark, pref_tokens, exclude_prefix, excluded_terms_report, macro_split, derived_note,
        fact_block, note_choice,
    )
}


def _masked(cls: str, text: str = "text") -> str:
    for phrase in SAMPLE.exempt.get(cls, ()):
        text = f"replace({text}, '{phrase}', '{' ' * len(phrase)}')"
    return text


def _fires(cls: str) -> str:
    return "coalesce(" + " OR ".join(f"contains({_masked(cls)}, '{t.text}')" for t in SAMPLE.terms[cls]) + ", false)"


def _layer(cls: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({_masked(cls)}, '{t.text}') THEN '{t.layer}'" for t in SAMPLE.terms[cls]) + " END"


_TEXTS = "texts AS (SELECT id, lower(array_to_string(ingredients, ' | ')) AS text FROM corpus)"
_LAYERS = _TEXTS + ", layers AS (" + " UNION ALL ".join(f"SELECT id, '{c}' AS class, {_layer(c)} AS layer FROM texts" for c in SAMPLE.classes) + ")"
_FLAGS = _TEXTS + ", flags AS (" + " UNION ALL ".join(f"SELECT id, '{c}' AS class, {_fires(c)} AS fires FROM texts" for c in SAMPLE.classes) + ")"
_TRUTH = _FLAGS + ", norms AS (SELECT id, lower(array_to_string(ingredients_norm, ' | ')) AS norm FROM corpus), truths AS (" + " UNION ALL ".join(
    f"SELECT id, '{c}' AS class, coalesce(regexp_matches(norm, '\\b({'|'.join(t.text for t in ts if t.layer != 'composite')})\\b'), false) AS truth FROM norms" for c, ts in SAMPLE.terms.items()
) + "), judged AS (SELECT id, class, fires, truth FROM flags JOIN truths USING (id, class))"
_FIRST = _TRUTH + ", first_ AS (SELECT class, fires, id FROM judged QUALIFY row_number() OVER (PARTITION BY class, fires ORDER BY (id * 7919) % 10007, id) <= 3)"
_NOTE = """facts AS (SELECT *, floor(calories / 2000.0e0 * 100 + 0.5e0)::BIGINT AS share, floor(protein_g / 50.0e0 * 100 + 0.5e0)::BIGINT AS protein FROM corpus),
notes AS (SELECT id, concat_ws('; ', 'gives ' || share || '% of the day''s energy', CASE WHEN protein >= 15 THEN 'gives ' || protein || '% of the protein' END,
    CASE WHEN minutes > 30 THEN 'takes longer than planned' WHEN minutes * 2 <= 30 THEN 'is quick' END) AS note FROM facts)"""
_SAFE = "coalesce(length(trim({c})) > 0 AND length(trim({c})) <= 320 AND NOT (" + " OR ".join(f"contains(lower(trim({{c}})), '" + w.replace("'", "''") + "')" for w in FORBIDDEN) + "), false)"
SQL = {
    "lex_flags": "WITH " + _TEXTS + " SELECT id, " + ", ".join(f"{_fires(c)} AS has_{c}" for c in SAMPLE.classes) + " FROM texts",
    "lex_layer": "WITH " + _TEXTS + " SELECT id, " + ", ".join(f"{_layer(c)} AS layer_{c}" for c in SAMPLE.classes) + " FROM texts",
    "lex_theta_join": "WITH " + _LAYERS + " SELECT * FROM layers WHERE layer IS NOT NULL",
    "lex_layer_counts": "WITH " + _LAYERS + " SELECT class, " + ", ".join(f"count(*) FILTER (layer = '{x}') AS {x}" for x in SAMPLE.layers) + " FROM layers WHERE layer IS NOT NULL GROUP BY 1",
    "lex_none": "WITH " + _FLAGS + " SELECT count(*) AS n, count(*) FILTER (NOT a) AS n_none FROM (SELECT id, bool_or(fires) AS a FROM flags GROUP BY 1)",
    "lex_contradiction": "WITH " + TAGS_SQL + ", " + _FLAGS + ", claims AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{t}')" for c, t in CLAIMS.items())
    + ") v(class, tag)) SELECT class, count(*) AS n FROM flags JOIN claims USING (class) JOIN tag_set USING (id, tag) WHERE fires GROUP BY 1",
    "lex_confusion": "WITH " + _TRUTH + """, c AS (SELECT class, count(*) FILTER (fires AND truth) AS tp, count(*) FILTER (fires AND NOT truth) AS fp,
        count(*) FILTER (NOT fires AND truth) AS fn, count(*) FILTER (NOT fires AND NOT truth) AS tn FROM judged GROUP BY ROLLUP (class))
        SELECT *, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END AS recall, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END AS precision FROM c""",
    "strat_sample": "WITH " + _FIRST + " SELECT * FROM first_",
    "sample_exclusion": "WITH " + _FIRST + """ SELECT class, fires, id FROM judged WHERE id NOT IN (SELECT id FROM first_)
        QUALIFY row_number() OVER (PARTITION BY class, fires ORDER BY (id * 6007) % 10007, id) <= 2""",
    "tag_and_term_flags": "WITH " + TAGS_SQL + ", " + _TEXTS + " SELECT id, id IN (SELECT id FROM tag_set WHERE tag = 'vegetarian') AS vegetarian, id IN (SELECT id FROM tag_set WHERE tag = 'vegan') AS vegan, NOT coalesce("
    + " OR ".join(f"contains(text, '{t}')" for t in BLACKLIST) + ", false) AS no_listed_term FROM texts",
    "slug": "SELECT id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || id AS slug FROM corpus",
    "url_valid": "SELECT count(*) AS n, count(*) FILTER (regexp_matches(s, '^[a-z0-9]+(-[a-z0-9]+)*-[0-9]+$')) AS n_valid FROM (SELECT regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || id AS s FROM corpus)",
    "safety_filter": f"SELECT {_SAFE.format(c='description')} AS accepted, count(*) AS n FROM recipes GROUP BY 1",
    "escape_markdown": r"SELECT DISTINCT raw_ingr, regexp_replace(raw_ingr, '([\\`*_{}\[\]()#+!$~<>|-])', '\\\1', 'g') AS plain FROM ingr_map",
    "category_mark": "WITH " + TAGS_SQL + ", s AS (SELECT id, list(tag) AS tags FROM tag_set GROUP BY 1) SELECT id, CASE " + " ".join(f"WHEN list_contains(tags, '{t}') THEN '{m}'" for t, m in CATEGORIES) + " ELSE '🍽️' END AS mark FROM s",
    "pref_tokens": "SELECT c_custkey, concat_ws(' ', 'brown_sugar', replace(lower(trim(c_mktsegment)), ' ', '_'), 'salt', replace(lower(trim(c_mktsegment)), ' ', '-'), 'north-african') AS tokens FROM customer",
    "exclude_prefix": "WITH " + _TEXTS + " " + " UNION ALL ".join(
        f"SELECT '{t or 'empty'}' AS term, count(*) FILTER ({f'''regexp_matches(text, '{T.exclusion_pattern(t)}')''' if t else 'false'}) AS n FROM texts" for t in BANNED
    ),
    "excluded_terms_report": "WITH lines AS (SELECT id, lower(i) AS item FROM (SELECT id, unnest(ingredients) AS i FROM corpus)), hits AS ("
    + " UNION ALL ".join(f"SELECT '{t}' AS term, id, item FROM lines WHERE regexp_matches(item, '{T.exclusion_pattern(t)}')" for t in BANNED if t)
    + "), r AS (SELECT term, count(DISTINCT id) AS removed FROM hits GROUP BY 1), c AS (SELECT term, item, count(*) AS n FROM hits GROUP BY 1, 2) "
    "SELECT term, removed, row_number() OVER (PARTITION BY term ORDER BY n DESC, item)::INTEGER AS rn, item, n FROM c JOIN r USING (term) QUALIFY row_number() OVER (PARTITION BY term ORDER BY n DESC, item) <= 8",
    "macro_split": "SELECT id, " + ", ".join(
        f"CASE WHEN protein_g*4.0e0 + fat_g*9.0e0 + carbs_g*4.0e0 <> 0 THEN floor({x}/(protein_g*4.0e0 + fat_g*9.0e0 + carbs_g*4.0e0)*10000+0.5e0)/10000 END AS {n}"
        for n, x in (("protein_share", "protein_g*4.0e0"), ("fat_share", "fat_g*9.0e0"), ("carbs_share", "carbs_g*4.0e0"))
    ) + ", floor(least(greatest(calories/800.0e0, 0.0e0), 1.4e0)/1.4e0*100.0e0*10000+0.5e0)/10000 AS meter FROM corpus",
    "derived_note": "WITH " + _NOTE + " SELECT id, note FROM notes",
    "fact_block": "WITH " + _NOTE + " SELECT id, concat_ws(chr(10), 'name: ' || coalesce(name, '?'), 'energy share: ' || share, 'minutes: ' || minutes) AS facts FROM facts",
    "note_choice": "WITH " + _NOTE + ", given_ AS (SELECT id, min(description) AS given FROM recipes GROUP BY 1) SELECT n.id, CASE WHEN "
    + _SAFE.format(c="given") + " THEN given ELSE note END AS note, CASE WHEN " + _SAFE.format(c="given") + " THEN 'given' ELSE 'derived' END AS origin FROM notes n LEFT JOIN given_ g ON g.id = n.id",
}
