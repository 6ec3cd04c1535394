"""Map freely entered values to a canonical list by a partition-based pigeonhole join, in SQL.

An entry of length ``L`` is cut into ``k(L) + 1`` segments.  A string within ``k``
edits of it, a swap of neighbouring letters being one, keeps at least one segment
whole, moved by at most ``k`` places: an edit touches one segment, but for a swap
across a border, for which each segment also stands with its end letters exchanged.
An equality join on (entry length, segment number, segment text) with the substrings
at those places therefore finds every candidate.  Candidates whose letters differ in
more places than the edits can explain are dropped in the join, by the parities of
their letters; ``levenshtein`` then verifies.  Strings without a verified entry come
out of an anti-join as unmatched.

What a string names is looked for in its windows of neighbouring words, so that
amounts, makers and remarks around the name do not matter; windows are compared
without spaces, also with their first word last and their last word first
(``sauce (fish)``), and with look-alike signs (``0`` for ``o``, ``rn`` for ``m``) exchanged.  Accents, widths,
markup and punctuation are removed on both sides, and an entry also answers to
its plural.  The candidate with the most matched letters after three off for each
edit wins.  A misspelt name of at most
five letters that is a small part of its string counts only if each word around it
is on a fixed list of remarks, follows ``by``, or is capitalised in a string that has
words in lower case, as a maker's name.  What a string is mapped to thus depends on it
and on the list of entries, not on the other strings.  Windows hold as many words as
the longest entry and one more.

Defined results: null elements name nothing and are left out; an empty string is
unmatched; a null or blank entry is no entry; ties go to fewer edits, then to the longer entry, then alphabetically.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.runtime import cut

UNMATCHED = "unmatched"


@lru_cache(1)
def _plain_letters() -> tuple[str, str]:
    """Letters with a compatibility decomposition to one ASCII character, and those characters."""
    pairs = []
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c)).lower()
        if len(base) == 1 and base.isascii() and base.isalnum():
            pairs.append((chr(point), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def plain(column: str) -> str:
    """SQL of a string in plain lower-case words of letters and digits, single-spaced."""
    accented, base = _plain_letters()
    s = f"translate({column}, '{accented}', '{base}')"
    s = f"regexp_replace(lower({s}), '[\\\\u0300-\\\\u036f\\\\u2019\\'`]', '')"
    s = f"regexp_replace({s}, '</?[a-z][^>]*>|&#?[a-z0-9]+;', ' ')"
    return f"trim(regexp_replace({s}, '[^a-z0-9]+', ' '))"


#: SQL of the edits that the join tolerates for an entry of length L: those of FEW, or one in each word of four letters or more
EDITS = "CASE WHEN L <= 3 THEN 0 WHEN L <= 7 THEN 1 WHEN L <= 9 THEN 2 WHEN L <= 15 THEN 3 ELSE greatest(4, L div 4) END"
#: rows of segments that are sent to every task; of more, both sides meet by segment
SENT = 1_000_000
#: a misspelt name of at most five letters that is a smaller share of its string needs remarks around it
LEAST_PART = 0.28
#: words of amounts, kinds, states and remarks that may stand around any name
REMARKS = frozenset(
    """
    a about absolutely all an and any approx approximately are around as at available be best between big bit bought by can coarsely cold cooked
    cooled cored cut desired diced divided drained dried each ends enough extra fine finely finish firmly for freezer fresh freshly
    from frozen garnish generous good grated halved handful handfuls heaped heaping homemade hot if in into is it jarred large leftover
    lengthwise level lightly like little lots medium melted minced mine minus more my need needed needs note of off offcuts on one only
    optional or other our out packed packet packets peeled per pieces piece pinch pinches plain plus preferably prepared pure quality quartered
    rinsed ripe room roughly rounded scant see serve serving shredded sifted skinned sliced slices small so softened some split squeezed store
    strips such taste temperature thawed the then thick thickly thin thinly three tinned to toasted topping torn trimmed two unpeeled until use
    used using usual very warm washed well whatever whichever whole with without you your find chopped crushed
    bag bags bottle bottles box bunch bunches can cans clove cup cups dash drop drops g gram grams jar jars kg kilo l lb lbs liter litre
    ml ounce ounces oz pack pint pints pound pounds quart quarts slice sprig sprigs stick sticks tablespoon tablespoons tbs tbsp tbsps
    teaspoon teaspoons tin tins tsp tsps
    """.split()
)
#: SQL of whether verified edits, a swap being one, are few enough for the whole name
FEW = "CASE WHEN L <= 3 THEN edits = 0 WHEN L <= 7 THEN edits <= 1 WHEN L <= 9 THEN edits <= 2 ELSE edits <= 3 END"


def entries(mapping: DataFrame, entry: str = "replaced") -> DataFrame:
    """``(entry, words, form, L, k)``: the distinct lower-case entries with their forms and plurals."""
    spark = mapping.sparkSession
    return spark.sql(
        f"""
        WITH named AS (
            SELECT DISTINCT lower({entry}) AS entry FROM {{mapping}} WHERE trim({entry}) <> ''
        ), forms AS (
            SELECT entry, {plain("entry")} AS f FROM named
        ), plurals AS (
            SELECT entry, explode(array_distinct(array(f, concat(f, 's'),
                CASE WHEN f RLIKE '([sxzo]|ch|sh)$' THEN concat(f, 'es') ELSE f END,
                regexp_replace(f, 'y$', 'ies'), regexp_replace(f, 'fe?$', 'ves')))) AS words
            FROM forms WHERE f <> ''
        )
        SELECT entry, words, form, L, {EDITS} AS k
        FROM (SELECT *, replace(words, ' ', '') AS form, length(replace(words, ' ', '')) AS L FROM plurals)
        """,
        mapping=mapping,
    )


def unresolved(values: DataFrame, mapping: DataFrame, raw: str = "raw_ingr", entry: str = "replaced") -> DataFrame:
    """Rows of ``values`` (with a string column ``val``) that the mapping does not resolve as they stand."""
    spark = values.sparkSession
    trimmed = "lower(regexp_replace(val, '^[\\\\s\\\\u00a0]+|[\\\\s\\\\u00a0]+$', ''))"
    return spark.sql(
        f"""
        SELECT v.* FROM {{vals}} v LEFT ANTI JOIN (
            SELECT lower({raw}) AS known FROM {{mapping}} WHERE trim({entry}) <> '' AND {raw} IS NOT NULL
            UNION SELECT lower({entry}) FROM {{mapping}} WHERE trim({entry}) <> ''
        ) ON {trimmed} = known
        WHERE val IS NOT NULL
        """,
        vals=values,
        mapping=mapping,
    )


def windows(strings: DataFrame, words: int = 4) -> DataFrame:
    """``(val, words, w, part)``: windows of up to ``words`` words, turned ones included.

    ``w`` is the window without spaces, ``part`` its share of the string's letters.
    """
    spark = strings.sparkSession
    return spark.sql(
        f"""
        WITH split AS (
            SELECT val, split(s, ' ') AS t, greatest(1, length(replace(s, ' ', ''))) AS n
            FROM (SELECT val, {plain("val")} AS s FROM {{strings}})
        ), cut AS (
            SELECT val, n, explode(flatten(transform(sequence(1, {words}), n ->
                CASE WHEN size(t) >= n THEN transform(sequence(0, size(t) - n), i -> slice(t, i + 1, n))
                     ELSE array() END))) AS p
            FROM split
        ), turned AS (
            SELECT val, n, explode(CASE WHEN size(p) = 1 THEN array(p) ELSE array(
                p, concat(slice(p, 2, size(p) - 1), slice(p, 1, 1)),
                concat(slice(p, -1, 1), slice(p, 1, size(p) - 1))) END) AS p
            FROM cut
        ), joined AS (
            SELECT val, n, array_join(p, ' ') AS s FROM turned
        ), read AS (
            SELECT val, n, explode(array_distinct(array(s, translate(s, '013457', 'oleast'),
                replace(s, 'rn', 'm'), replace(s, 'cl', 'd'), replace(s, 'vv', 'w')))) AS words
            FROM joined WHERE length(s) >= 2 AND s RLIKE '[a-z]'
        )
        SELECT DISTINCT val, words, replace(words, ' ', '') AS w, length(replace(words, ' ', '')) / n AS part FROM read
        """,
        strings=strings,
    )


#: SQL of the start and length of segment i of k + 1 in a form of length L: the later segments take the remainder
SEGMENT = "i * (L div (k + 1)) + greatest(0, i - (k + 1 - L % (k + 1)))", "L div (k + 1) + CASE WHEN i >= k + 1 - L % (k + 1) THEN 1 ELSE 0 END"


def _letters(column: str) -> str:
    """SQL of the parities of a string's letters and digits, as the bits of one number."""
    return f"aggregate(split({column}, ''), 0L, (bits, x) -> bits ^ shiftleft(1L, ascii(x) % 64))"


def segments(forms: DataFrame) -> DataFrame:
    """``(form, L, k, i, seg, swaps, bits)``: each form's segments, also with end letters exchanged with the neighbours'."""
    start, size = SEGMENT
    return forms.sparkSession.sql(
        f"""
        WITH placed AS (
            SELECT form, L, k, i, {start} AS at, {size} AS len, {_letters("form")} AS bits
            FROM (SELECT form, L, k, explode(sequence(0, k)) AS i FROM (SELECT DISTINCT form, L, k FROM {{forms}}))
        ), turned AS (
            SELECT *, substring(form, at + 1, len) AS s, substring(form, at, 1) AS before, substring(form, at + len + 1, 1) AS after FROM placed
        )
        SELECT DISTINCT form, L, k, i, v.seg, v.swaps, bits FROM turned LATERAL VIEW explode(array(
            struct(s AS seg, 0 AS swaps),
            CASE WHEN i > 0 AND k > 0 THEN struct(concat(before, substring(s, 2)) AS seg, 1 AS swaps) END,
            CASE WHEN i < k THEN struct(concat(substring(s, 1, len - 1), after) AS seg, 1 AS swaps) END,
            CASE WHEN i > 0 AND i < k AND k > 1 AND len > 1 THEN struct(concat(before, substring(s, 2, len - 2), after) AS seg, 2 AS swaps) END
        )) AS v WHERE v IS NOT NULL
        """,
        forms=forms,
    )


def candidates(shapes: DataFrame, forms: DataFrame) -> DataFrame:
    """``(w, form)``: pairs that share a segment at a tolerable place; ``shapes`` holds distinct ``w``."""
    spark = shapes.sparkSession
    start, size = SEGMENT
    cuts = cut(segments(forms))
    sent = cuts.limit(SENT + 1).count() <= SENT
    longest = forms.selectExpr("max(k)").first()[0] or 0
    return spark.sql(
        f"""
        WITH lengths AS (
            SELECT DISTINCT L, k FROM {{forms}}
        ), probes AS (
            SELECT w, bits, L, k, i, {start} AS at, {size} AS len
            FROM (SELECT w, {_letters("w")} AS bits, explode(sequence(greatest(1, length(w) - {longest}), length(w) + {longest})) AS want FROM {{shapes}})
            JOIN lengths ON want = L
            LATERAL VIEW explode(sequence(0, k)) AS i
            WHERE abs(length(w) - L) <= k
        ), places AS (
            SELECT w, bits, L, k, i, d, substring(w, at + d + 1, len) AS seg
            FROM (SELECT *, explode(sequence(-k, k)) AS d FROM probes)
            WHERE at + d >= 0 AND at + d + len <= length(w) AND abs(d - (length(w) - L)) <= k
        )
        SELECT DISTINCT p.w, c.form
        FROM places p JOIN {{cuts}} c ON p.L = c.L AND p.i = c.i AND p.seg = c.seg
            AND greatest(abs(p.d), abs(p.d - (length(p.w) - p.L))) + c.swaps <= p.k AND bit_count(p.bits ^ c.bits) <= 2 * (p.k - c.swaps)
        """,
        shapes=shapes,
        forms=forms,
        cuts=F.broadcast(cuts) if sent else cuts,
    )


def _swapped(w: str, form: str) -> str:
    """SQL of the edits between strings of one length that neither adds nor drops a letter, a swap being one."""
    at = "substring({}, j, 1)"
    a, b, c, d = at.format(w), at.format(form), at.format(w).replace("j", "j + 1"), at.format(form).replace("j", "j + 1")
    return f"""aggregate(sequence(1, length({w})), struct(0 AS upto, 0 AS n), (s, j) -> CASE
        WHEN j <= s.upto OR {a} = {b} THEN s WHEN j < length({w}) AND {a} = {d} AND {c} = {b} THEN struct(j + 1 AS upto, s.n + 1 AS n)
        ELSE struct(j AS upto, s.n + 1 AS n) END, s -> s.n)"""


def match(strings: DataFrame, forms: DataFrame) -> DataFrame:
    """``(val, entry, edits)``: the best entry of each distinct string that names one."""
    spark = strings.sparkSession
    longest = forms.selectExpr("max(size(split(words, ' ')))").first()[0] or 0
    spoken = cut(windows(strings, longest + 1))
    # each window grows into many substrings: spread them by number, since their bytes say little of the work
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # by another key than the distinct rows lie by, or the engine would leave them there
    shapes = spark.sql(f"SELECT /*+ REPARTITION({parts}, h) */ w, h FROM (SELECT w, xxhash64(w) AS h FROM (SELECT DISTINCT w FROM {{spoken}}))", spoken=spoken)
    pairs = cut(candidates(shapes, forms))
    swapped = "CASE WHEN {d} >= 2 AND length({a}) = length({b}) AND array_sort(split({a}, '')) = array_sort(split({b}, '')) THEN 1 ELSE 0 END"
    each = f"levenshtein(x, y) - {swapped.format(d='levenshtein(x, y)', a='x', b='y')}"
    scored = cut(spark.sql(
        f"""
        WITH near AS (
            SELECT /*+ REPARTITION({parts}) */ p.w, p.form, f.L, levenshtein(p.w, p.form, 2 * f.k) AS lev
            FROM {{pairs}} p JOIN (SELECT DISTINCT form, L, k FROM {{forms}}) f ON p.form = f.form
        ), verified AS (
            SELECT w, form, L, CASE WHEN lev >= 2 AND length(w) = L THEN least(lev, {_swapped("w", "form")}) ELSE lev END AS edits FROM near WHERE lev >= 0
        ), measured AS (
            SELECT c.val, c.words, c.w, c.part, f.entry, v.L, v.edits,
                CASE WHEN size(split(c.words, ' ')) = size(split(f.words, ' '))
                    THEN zip_with(split(c.words, ' '), split(f.words, ' '), (x, y) ->
                        CASE WHEN x = y THEN 0 WHEN length(y) < 4 THEN 9 ELSE {each} END) END AS by_word
            FROM verified v JOIN {{spoken}} c ON v.w = c.w JOIN {{forms}} f ON v.form = f.form
        )
        SELECT val, entry, words, L, part, e, length(w) - 3 * e AS score
        FROM (
            SELECT *, CASE WHEN {FEW} THEN edits END AS whole,
                CASE WHEN NOT exists(by_word, x -> x > 1) THEN aggregate(by_word, 0, (a, x) -> a + x) END AS worded
            FROM measured
        ) LATERAL VIEW explode(array(least(whole, worded))) AS e
        WHERE e IS NOT NULL
        """,
        pairs=pairs,
        forms=forms,
        spoken=spoken,
    ))
    remarks = ", ".join(f"'{w}'" for w in sorted(REMARKS))
    return spark.sql(
        f"""
        WITH rest AS (
            SELECT val, entry, s, explode(array_except(split(s, ' '), split(words, ' '))) AS word
            FROM (SELECT *, {plain("val")} AS s FROM {{scored}} WHERE e > 0 AND L <= 5 AND part < {LEAST_PART})
        ), doubtful AS (
            SELECT DISTINCT val, entry FROM rest
            WHERE word RLIKE '[a-z]' AND word NOT IN ({remarks}) AND NOT contains(concat(' ', s, ' '), concat(' by ', word, ' '))
                AND NOT (val RLIKE '(^|[^A-Za-z])[a-z]' AND val RLIKE concat('(^|[^A-Za-z])', initcap(word), '([^A-Za-z]|$)'))
        ), sure AS (
            SELECT s.* FROM {{scored}} s LEFT ANTI JOIN doubtful d ON s.val = d.val AND s.entry = d.entry AND s.e > 0
        )
        SELECT val, best.entry, -best.e AS edits
        FROM (SELECT val, max_by(struct(entry, -e AS e), struct(score, -e, length(entry), entry)) AS best FROM sure GROUP BY val)
        """,
        scored=scored,
    )


def map_values(values: DataFrame, mapping: DataFrame, raw: str = "raw_ingr", entry: str = "replaced") -> DataFrame:
    """The unresolved rows of ``values`` with the entry each names in ``replaced``, or ``unmatched``.

    Equal strings are matched once.  The list's size is not assumed.
    """
    spark = values.sparkSession
    cases = unresolved(values, mapping, raw, entry)
    strings = cut(spark.sql("SELECT DISTINCT val FROM {cases}", cases=cases))
    found = cut(match(strings, cut(entries(mapping, entry))))
    return spark.sql(
        f"""
        SELECT c.*, f.entry AS replaced FROM {{cases}} c JOIN {{found}} f ON c.val = f.val
        UNION ALL
        SELECT c.*, '{UNMATCHED}' AS replaced FROM {{cases}} c LEFT ANTI JOIN {{found}} f ON c.val = f.val
        """,
        cases=cases,
        found=found,
    )
