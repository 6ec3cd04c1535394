import math
import random

import pytest

from platewise.llm import quality as Q
from platewise.llm.shape import Reader

COMMON = "the of and a to in is it with for on that this we you was my le la et de un une les des est el y en que los las der die das und ist nicht mit ein".split()
READER = Reader(COMMON)
SENTENCE = "The crust stayed crisp under the leek, and it was a joy to eat with my friends. "
KINDS = {
    "prose": [
        SENTENCE * 3, SENTENCE.upper(), SENTENCE.lower().replace(".", "").replace(",", "") * 2, "- " + SENTENCE + "\n- This is a soup that we like.\n- You can serve it with the bread.",
        "1. " + SENTENCE + "\n2. We had it in the garden.", SENTENCE.replace(" under", "\nunder"), "Le gratin est la joie de la famille et des amis.", "Der Quark ist mit der Butter nicht gut.",
        "玉ねぎを細かく切って、塩と一緒に煮ます。とてもおいしくできました。", "Simple Bake\n\n" + SENTENCE, SENTENCE + "\n- salt\n- oil",
    ],
    "list": [
        "salt\nonion\nolive oil\nleek", "- 2 cups flour\n- 1 egg\n- salt", "1) oats\n2) milk\n3) honey", "salt, onion, olive oil, leek, cream of tartar, egg", "YOU NEED\n1 lbs oats; 3 tsp salt; 2 cups milk; 250 g leek",
        "[x] salt\n[ ] oats", "golden leek soup ........ 12\nlight egg pie ..... 44", "a) 2 cups oats, minced\nb) 3 ml milk, chopped\nc) 1 leek, sliced", "  > Salt\r\n  > Oats\r\n  > Olive Oil",
    ],
    "table": [
        "| a | b |\n|---|---|\n| oats | 2 |\n| milk | 3 |", "item,fat,kcal\noats,1,2\nmilk,3,4\nleek,-,5", "item\tfat\noats\t1\nmilk\t2", "<table>\n<tr><td>oats</td><td>1</td></tr>\n<tr><td>milk</td><td>2</td></tr>\n</table>",
        "item        fat     kcal\noats        1       22\nmilk        3       44", "│ oats │ 1 │\n│ milk │ 2 │", "As we weighed it in the kitchen:\nitem;fat;kcal\noats;1;2\nmilk;3;4\nleek;5;6\nonion;1;12\npepper;1;12\nturnip;1;12",
    ],
    "junk": [
        "hash " * 40, "uuvrpomsdf fyqoqunhrd agklc xjhq elsztnszf yjefjyzhvkn coblcal kwdkukipo", "&^[%()}%{=$~}(=)$*][%=$!?(?=&~+*#[~?{ =+}*+]}>&)", ".r1{margin:3px;color:#fff}\n.r2{margin:4px;color:#000}",
        "© 2019 | Log in | Share | Top ↑ | Sign up | Home | Cookies", "HIz16NJt3D2bEiu47MyaXDsVWgtBk1UGxNF9HFFe6Hw6tDF/hjyOuR2gmGfFUI7akOvTdrorql0jnrgxsBkKoTgT8B", "Ã\x83Â©Ã\x83Â\xa0Ã\x83Â¼t dÃ\x83Â©Ã\x83Â©",
        "669 6 384235032 5416368974161 62723473298396 6973 70830", "click here for tart " * 30,
    ],
}


@pytest.mark.parametrize("kind,text", [(k, t) for k, ts in KINDS.items() for t in ts])
def test_kind_of_the_greater_part(kind, text):
    sizes, lines = READER.read(text)
    assert max(sizes, key=sizes.get) == kind and sum(sizes.values()) == sum(x.size for x in lines)


def common(spark):
    return spark.createDataFrame([("en", i, w) for i, w in enumerate(COMMON)] + [("en", 0, None)], "lang string, word_rank int, word string")


def documents(spark):
    rows = [(i, t, random.choice(["en", "EN ", "fr", "und", None]), "x") for i, t in enumerate([*[SENTENCE * 2] * 60, *(t for ts in KINDS.values() for t in ts), None, "", " \n\t "])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kind string")


def test_scores_equal_brute_force(spark):
    random.seed(9)
    stats = Q.statistics(documents(spark), "doc_id", "text", "lang", common(spark)).cache()
    rows = [r for r in stats.collect() if r["symbol_ratio"] is not None]
    got = {r["doc_id"]: r for r in Q.scores(stats, "doc_id").collect()}
    assert set(got) == {r["doc_id"] for r in rows}
    split = {r["doc_id"]: r for r in Q.scores(stats, "doc_id", most_hot=0).collect()}
    for r in rows:
        sums, away = [0.0, 0.0, 0.0], []
        for group in dict.fromkeys((r["lang"], "*")):
            members = [x for x in rows if group in ("*", x["lang"])]
            away.append(0.0)
            for s, side in Q.RANKED.items():
                vs = [x[s] for x in members if x[s] is not None]
                low, high = (-math.log(sum(f(x) for x in vs) / len(vs)) if r[s] is not None else None for f in (lambda x: x <= r[s], lambda x: x >= r[s]))
                if side:
                    away[-1] += 1.0 if low is None else high if side == 1 else low
                if group == r["lang"] and low is not None:
                    median = max(v for v in vs if 2 * sum(x < v for x in vs) <= len(vs))
                    for i, x in enumerate((low, high, low if median - sum(vs) / len(vs) > 1e-9 * median else high)):
                        sums[i] += x
        assert abs(got[r["doc_id"]]["away_score"] - max(away)) < 1e-6
        assert abs(got[r["doc_id"]]["outlier_score"] - max(sums)) < 1e-6
        assert all(abs(got[r["doc_id"]][c] - split[r["doc_id"]][c]) < 1e-9 for c in ("outlier_score", "away_score"))


def kinds(df, spark, **options):
    stats = Q.statistics(df, "doc_id", "text", "lang", common(spark)).cache()
    return {r["doc_id"]: r["kind"] for r in Q.kinds(df, Q.scores(stats, "doc_id"), "doc_id", "text", "lang", common(spark), **options).collect()}


def test_found_kinds(spark):
    random.seed(10)
    texts = [*[SENTENCE * 2] * 60, *(t for ts in KINDS.values() for t in ts)]
    names = ["prose"] * 60 + [k for k, ts in KINDS.items() for _ in ts]
    want = {i: k for i, (k, _) in enumerate(zip(names, texts, strict=True)) if k != "prose"}
    df = documents(spark).cache()
    assert kinds(df, spark, candidate=0.0) == want == kinds(df, spark, candidate=0.0, most_ids=3)


SENTENCES = [
    "The crust stayed crisp under the leek.", "It was a joy to eat with my friends!", "We like this soup on a cold day.", "You need time for it.", "My aunt made the bread, and I made the jam.",
    "That was the best pie of the year.", "Is it hard to make?", "The oven was on for an hour.", "I put the rest in a jar.", "We had it with the tea in the garden.",
]


def test_the_scores_select_what_is_read(spark):
    """Long texts that repeat few sentences look like junk to the reader; nothing else about them is unlikely."""
    random.seed(11)
    texts = {i: " ".join(random.sample(SENTENCES, random.randint(3, 8))) for i in range(40)} | {i: " ".join(random.choices(SENTENCES, k=160)) for i in range(40, 60)} | {60: "salt\nonion\nolive oil\nleek"}
    df = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string").cache()
    assert kinds(df, spark, candidate=0.0) == {i: "junk" for i in range(40, 60)} | {60: "list"}
    selected = kinds(df, spark)
    assert selected[60] == "list" and len(selected) < 10


def test_most_prose_is_not_read(spark, data):
    from platewise.llm import queries

    scored = queries.p8_scores(spark, data)
    assert scored.where(f"away_score >= {Q.CANDIDATE}").count() < 0.45 * scored.count()


def test_words_count_in_their_language(spark):
    words = spark.createDataFrame([("en", "the"), ("es", "los"), (" ES ", "y"), (None, "und"), ("en", None)], "lang string, word string")
    rows = [(1, "the los y", "en"), (2, "the los y", "ES"), (3, "the los y", "und"), (4, "The LOS y", "ja")]
    stats = Q.statistics(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", words)
    assert {r["doc_id"]: round(r["common_word_share"] * 3) for r in stats.collect()} == {1: 1, 2: 2, 3: 3, 4: 3}


def test_counts_of_odd_texts(spark):
    text = "It's a “Fine” day… (Yes!)  \r\n\u3000\n- x2\u2028おいしい。まあ\U00020000 \U0001f600 .5!\""
    m = Q.measure(["", text, "\n"], ["*", "*", "*"], {"*": Q.word_hashes(["a", "s"])})
    assert {k: v.tolist() for k, v in m.items()} == {
        "letters": [0, 22, 0], "vowels": [0, 8, 0], "symbols": [0, 13, 0], "solid": [0, 37, 0], "lines": [0, 3, 0], "n": [0, 9, 0], "ended": [0, 2, 0], "stops": [0, 4, 0], "different": [0, 9, 0], "common": [0, 2, 0],
    }


def test_blank_and_empty(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "  ", "en"), (4, "!", "en"), (5, "x" * 300_000, "en")], "doc_id long, text string, lang string")
    stats = Q.statistics(df, "doc_id", "text", "lang", common(spark)).cache()
    rows = {r["doc_id"]: r for r in stats.collect()}
    assert [rows[i]["word_count"] for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 0, 1] and rows[1]["symbol_ratio"] is None and rows[5]["mean_word_length"] == 300_000
    assert {r["doc_id"] for r in Q.scores(stats, "doc_id").collect()} == {4, 5}
    assert Q.scores(stats.limit(0), "doc_id").count() == 0
    assert kinds(df.limit(0), spark) == {}


def test_bytes_that_are_no_text(spark):
    df = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text, 'en' AS lang")
    assert Q.statistics(df, "doc_id", "text", "lang", common(spark)).first()["symbol_ratio"] == 1 / 3
    assert kinds(df, spark, candidate=0.0) in ({}, {1: "list"}, {1: "junk"})
