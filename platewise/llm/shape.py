"""Line-by-line reading of a text's shape: how many characters are prose, list, table or junk."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
BULLET = re.compile(
    r"^\s*(?:[-–—*•·▪◦‣+>~»→o]|\(?\d{1,3}[.):]|\(?[a-zA-Z][.)]|\(?[ivx]{1,5}[.)]|\[[ xX✓]?\]|[☐☑☒✓✔])\s+"
)
TAGS = re.compile(r"</?(?:table|thead|tbody|tr|td|th)\b[^>]*>", re.I)
CELL_TAGS = re.compile(r"</?(?:tr|td|th)\b", re.I)
GAPS = re.compile(r"(?<=\S)(?: {2,}|\t+)(?=\S)")
TIGHT = {",": re.compile(r"(?<=\S),(?=\S)"), ";": re.compile(r"(?<=\S);(?=\S)")}
LEADER = re.compile(r"\S\s*(?:\.{4,}|(?:\. ){4,}\.?)\s*\S{1,12}\s*$")
CONSONANTS = re.compile(r"[bcdfghjklmnpqrstvwxz]{4,}", re.I)
ODD_PAIR = re.compile(r"q(?!u)|[jvxz][bcdfghjkmpqtvwxz]|[bcdfghkmpst]x|[bfhkmpvw]j|yy|hh|kk|jj|vv|ww|uu|ii|aa", re.I)
VOWELS = re.compile(r"[aeiouyàáâäãåæèéêëìíîïòóôöõøœùúûü]", re.I)
DAMAGE = re.compile(r"[�\x80-\x9f¤§ÃÂ\x00-\x08\x0b\x0c\x0e-\x1f]|[âÃÐÑ][€™œž\u0080-¿]")
CODE = re.compile(r"[{}<>;=]|\w\(|\)\s*;|://|\bvar\b|\bfunction\b|\breturn\b|\bconst\b|[#.][\w-]+\s*\{")
KANA = re.compile(r"[぀-ヿ]")
CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
BREAK = re.compile(r"\r\n|[\n\r\u2028\u2029\x85]")
STOPS = re.compile(r"[.!?…。！？][\"'”’»)\]]*\s*$")
#: Words of navigation bars and page footers.
NAVIGATION = frozenset(
    "home login log in sign up share print next previous prev top back cart cookies cookie menu search about contact terms privacy policy "
    "subscribe newsletter follow us facebook twitter pinterest instagram rss sitemap reserved rights all copyright help faq page tweet "
    "comments reply more read account register skip to content save email".split()
)
KINDS = ("prose", "list", "table", "junk")


def _odd(word: str) -> bool:
    """Whether a word does not look like one of any language with vowels."""
    return bool(CONSONANTS.search(word)) or not VOWELS.search(word) or bool(ODD_PAIR.search(word))


def _solid(s: str) -> int:
    """Characters other than white space."""
    return len("".join(s.split()))


class Line:
    """What is known of one line before its neighbours are looked at."""

    __slots__ = ("body", "common", "how", "low", "n", "prose", "row", "size")

    def __init__(self, row: str, common: frozenset[str]):
        self.row = row
        self.size = _solid(row)
        s = row.strip()
        self.how, self.n = self.cells(s)
        if self.how == "html":
            s = TAGS.sub(" ", s)
        self.body = BULLET.sub("", s, count=1) or s
        self.low = WORD.findall(self.body.lower())
        self.common = sum(w in common or ("'" in w or "’" in w) and self.parts(w, common) for w in self.low)
        self.prose = self.how != "html" and self.sentence()

    @staticmethod
    def parts(word: str, common: frozenset[str]) -> bool:
        """A contraction counts as common if either side of its apostrophe is, or is one letter."""
        head, _, tail = word.replace("’", "'").partition("'")
        return head in common or tail in common or len(head) == 1

    @staticmethod
    def cells(s: str) -> tuple[str, int]:
        """The notation a line could be a table row in, and its number of separators."""
        if "<" in s and CELL_TAGS.search(s):
            return "html", 1
        for mark in ("|", "│", "¦", "║"):
            if mark in s:
                return "bar", s.strip(mark).count(mark)
        if "\t" in s:
            return "tab", s.count("\t")
        if "  " in s:
            gaps = len(GAPS.findall(s))
            if gaps:
                return "gap", gaps
        for mark, find in TIGHT.items():
            if mark in s:
                n = len(find.findall(s))
                if n:
                    return mark, n
        return "", 0

    def sentence(self) -> bool:
        """Running text: common words among enough others, or kana."""
        s = self.body
        if not s.isascii() and CJK.search(s):
            kana, cjk = len(KANA.findall(s)), len(CJK.findall(s))
            if cjk >= 0.4 * self.size:
                return kana >= 0.2 * cjk and bool(STOPS.search(s) or kana >= 6) or bool(re.search("[。！？]", s))
        n = len(self.low)
        if n < 4:
            return False
        return self.common >= 0.2 * n if n in (5, 6, 7, 8) else self.common >= 0.13 * n if n >= 9 else self.common > 0 and bool(STOPS.search(s))

    def damaged(self) -> bool:
        """Replacement characters, controls or text decoded by the wrong table."""
        return not self.row.isascii() and len(DAMAGE.findall(self.row)) >= 0.08 * self.size

    def again(self) -> bool:
        """One or two words over and over."""
        if len(self.low) < 6:
            return False
        counts = Counter(self.low)
        return max(counts.values()) >= 0.5 * len(self.low) or len(self.low) >= 12 and len(counts) <= max(2, 0.1 * len(self.low))

    def code(self) -> bool:
        """Program text or style sheets."""
        s = self.row
        if not any(c in s for c in "{};<>=()") or self.how == "html":
            return False
        return len(CODE.findall(s)) >= 3 and bool(re.search(r"[{}]|</?\w+[^>]*>|[)\w]\s*;\s*$", s)) and self.common < 0.15 * len(self.low) + 1

    def furniture(self) -> bool:
        """Navigation bars and page footers."""
        named = sum(w in NAVIGATION for w in self.low)
        return bool(self.low) and ("©" in self.row or len(self.low) >= 2) and named >= 0.6 * len(self.low)

    def noise(self) -> bool:
        """Long unbroken strings, marks, digits or letters that form no words."""
        s, letters = self.row.strip(), sum(map(len, self.low))
        if self.size >= 40:
            long = sum(len(x) for x in s.split() if len(x) >= 40)
            if long > 0.5 * self.size and "://" not in s and not CJK.search(s):
                return True
        if self.size >= 6 and letters < 0.4 * self.size and self.how != "bar" and not LEADER.search(s):
            marks = sum(not (c.isalnum() or c.isspace()) for c in s)
            if marks > 0.45 * self.size and not re.fullmatch(r"[-=_*~.#\s]+", s):
                return True
            if self.size >= 20 and sum(c.isdigit() for c in s) > 0.7 * self.size:
                return True
        long = [w for w in self.low if len(w) >= 4]
        return len(long) >= 5 and sum(map(_odd, long)) >= 0.4 * len(long) and self.common < 0.15 * len(self.low)

    def run(self) -> bool:
        """Several short items in one line."""
        for mark in (";", ",", "•", "·", " / ", "|", "*", " - ", " – "):
            parts = self.body.count(mark) + 1
            if parts >= 4 and len(self.low) <= 5.5 * parts:
                return True
        return False


RULE = re.compile(r"[\s|│┌┐└┘├┤┬┴┼─━+=:\-]+")


class Reader:
    """Measures texts; ``common`` is the set of common words of their language."""

    def __init__(self, common):
        self.common = frozenset(w.lower() for w in common)

    def kind(self, line: Line, near: list[Line], alike: int) -> str:
        """The kind of one line, or an empty string if it says nothing of its own."""
        if line.damaged():
            return "junk"
        if line.how == "html":
            return "table"
        if ".." in line.row and LEADER.search(line.row):
            return "list"
        if line.prose and line.how in ("", ",", ";"):
            return "junk" if line.again() else "prose"
        if line.code() or line.furniture():
            return "junk"
        if line.n and alike >= 2:
            beside = any((x.how, x.n) == (line.how, line.n) for x in near)
            if line.how == "bar" or line.how == "tab" and not line.prose or beside and not (line.prose and line.how == "gap"):
                return "table"
        s = line.row.strip()
        if len(s) >= 3 and RULE.fullmatch(s):
            return "table" if any(x.how == "bar" for x in near) or re.search(r"[│┼┬┴├┤]|\+-|-\+|\|", s) else ""
        if line.again():
            return "junk"
        if line.prose:
            return "prose"
        if line.noise():
            return "junk"
        if line.how == "bar" and line.n >= 4:
            return "junk" if sum(w in NAVIGATION for w in line.low) >= 0.3 * len(line.low) else "table"
        if line.how == "tab" and line.n >= 2:
            return "table"
        return "list" if line.run() or len(line.low) <= 6 else ""

    def read(self, text: str) -> tuple[dict[str, int], list[Line]]:
        """Characters other than white space by kind of line, and the lines."""
        lines = [Line(x, self.common) for x in BREAK.split(text) if x.strip()]
        notation = Counter((x.how, x.n) for x in lines)
        kinds = [self.kind(x, lines[max(0, i - 1) : i] + lines[i + 1 : i + 2], notation[x.how, x.n]) for i, x in enumerate(lines)]
        out = dict.fromkeys(KINDS, 0)
        before = ""
        after = [""] * len(kinds)
        for i in range(len(kinds) - 2, -1, -1):
            after[i] = kinds[i + 1] or after[i + 1]
        for i, (kind, line) in enumerate(zip(kinds, lines, strict=True)):
            took = kind
            if kind == "list" and line.size >= 12 and not BULLET.match(line.row):
                # a wrapped line, or the last line of a wrapped sentence, without common words
                if before == "prose" and (after[i] == "prose" or STOPS.search(line.row)):
                    took = "prose"
            elif not kind:
                took = before if before and before == after[i] else "prose" if "prose" in (before, after[i]) or not before + after[i] else before or after[i]
            out[took] += line.size
            before = kind or before
        words = [w for x in lines for w in x.low]
        if len(words) >= 12 and "table" not in kinds:
            counts = Counter(words)
            if max(counts.values()) >= 0.5 * len(words) or len(counts) <= min(12, max(3, 0.06 * len(words))):
                out = dict.fromkeys(KINDS, 0) | {"junk": sum(x.size for x in lines)}
        return out, lines
