import random

from platewise.llm import canonical as C

MAP = [
    ("Heavy Creams", "heavy cream"), ("x", "Clove"), ("y", "split pea"), ("offcuts", None), ("q", "lime zest"), ("q", "lime"), ("h", "ham hock"), ("flour", "flour"), ("flour", "flour"), ("s", "Salt"),
    ("b", "bay leaf"), ("c", "cream of tartar"), ("e", "egg"), ("p", "parsley"), ("r", "raspberry"), ("z", "za'atar blend"), ("w", ""), (None, "mint"),
]
CASES = [
    ("Fresh heavy-cream (optional)", "heavy cream"), ("hevay cream", "heavy cream"), ("hevay craem", "heavy cream"), ("heavycream", "heavy cream"), ("cream - heavy", "heavy cream"), ("zest, lime", "lime zest"), ("tartar (cream of)", "cream of tartar"),
    ("ｅｇｇ", "egg"), ("ÉGGS", "egg"), ("PARS1EY", "parsley"), ("pársley", "parsley"), ("raspberries", "raspberry"), ("rapsberry", "raspberry"), ("bay leaves", "bay leaf"), ("harn hock", "ham hock"),
    ("<b>salt</b> &amp; such", "salt"), ("Bowus salt", "salt"), ("zaatar  blend", "za'atar blend"), ("flouur at room temperature", "flour"), ("egg at room temperature", "egg"), ("limme zset - see note", "lime zest"),
    ("love and patience", "unmatched"), ("", "unmatched"), ("???", "unmatched"), ("salsify", "unmatched"), ("x" * 3000, "unmatched"), ("250", "unmatched"), ("mints", "mint"), ("salt offcuts", "salt"),
]
RESOLVED = ["heavy creams", " Salt ", "FLOUR", "mint"]


def tables(spark):
    values = [(i, 0, v, "r") for i, (v, _) in enumerate(CASES)] + [(100 + i, 0, v, "r") for i, v in enumerate(RESOLVED)] + [(200, 0, None, "r"), (201, 1, "ÉGGS", "r")]
    return spark.createDataFrame(values, "id long, pos int, val string, entry string"), spark.createDataFrame(MAP, "raw_ingr string, replaced string")


def test_cases(spark):
    values, mapping = tables(spark)
    got = {r["id"]: r["replaced"] for r in C.map_values(values, mapping).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)} | {201: "egg"}


def test_empty_tables(spark):
    values, mapping = tables(spark)
    assert C.map_values(values.limit(0), mapping).count() == 0
    assert {r["replaced"] for r in C.map_values(values, mapping.limit(0)).collect()} == {"unmatched"}


def distance(a, b):
    """Letters changed, added or dropped, and neighbours swapped."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[j - 1] + 1, rows[-1][j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                row[j] = min(row[j], rows[-2][j - 2] + 1)
        rows.append(row)
    return rows[-1][-1]


def test_segments_find_every_near_pair(spark):
    random.seed(2)
    word = lambda n, letters="abc": "".join(random.choice(letters) for _ in range(n))
    names = sorted({word(random.randint(3, 18), "abcdefgh") for _ in range(100)})

    def bent(name):
        """A name with a few neighbours swapped and letters changed."""
        x = list(name)
        for _ in range(random.randint(0, 4)):
            j = random.randrange(len(x) - 1)
            if random.random() < 0.7:
                x[j : j + 2] = x[j + 1], x[j]
            else:
                x[j : j + 1] = random.choice([[], ["z"], ["a", "b"]])
            if len(x) < 2:
                break
        return "".join(x)

    forms = C.entries(spark.createDataFrame([(n,) for n in names], "replaced string")).cache()
    shapes = sorted({bent(random.choice(names)) for _ in range(600)} - {""})
    limits = {(r["form"], r["k"]) for r in forms.collect()}
    near = {(s, f) for s in shapes for f, k in limits if abs(len(s) - len(f)) <= k and distance(s, f) <= k}
    for sent in (C.SENT, 0):
        C.SENT, before = sent, C.SENT
        got = {tuple(r) for r in C.candidates(spark.createDataFrame([(s,) for s in shapes], "w string"), forms).collect()}
        C.SENT = before
        assert near <= got and len(near) > 300 and len(got) < 20 * len(near)


def test_swaps_are_counted_once(spark):
    pairs = [("hevaycraem", "heavycream", 2), ("abcd", "badc", 2), ("abc", "bca", 2), ("aba", "bab", 2), ("same", "same", 0), ("axcd", "abdc", 2), ("a", "b", 1)]
    df = spark.createDataFrame(pairs, "w string, form string, n int")
    assert df.selectExpr(C._swapped("w", "form") + " = n AS good", "*").where("not good").count() == df.where("w = 'abc'").count()


def test_letters_of_both_sides_are_plain(spark):
    df = spark.createDataFrame([("  Crème—Brûlée №1 <i>x</i>&nbsp;y_z’s",)], "v string")
    assert df.selectExpr(C.plain("v") + " AS p").first()["p"] == "creme brulee 1 x y zs"
