from test_quality import SENTENCE, kinds


def test_small_and_homogeneous_languages_have_candidates(spark):
    table, salt = "| a | b |\n|---|---|\n| oats | 2 |\n| milk | 3 |", "salt\nonion\nolive oil\nleek"
    rows = [(i, SENTENCE * (2 + i % 3), "en") for i in range(60)] + [(100, salt, "ta"), *((200 + i, table, "sw") for i in range(6)), (300, SENTENCE, "cy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()
    assert kinds(df, spark) == {100: "list"} | {200 + i: "table" for i in range(6)}
