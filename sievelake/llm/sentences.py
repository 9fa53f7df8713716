"""Sentence boundaries across languages and scripts, learned without labels.

One pass over all texts counts word types: how often they carry a full stop, stand in lower case, stand within a sentence with a capital, or
follow a certain boundary (a heading, an exclamation or question mark). By language, log-likelihood ratios of these counts yield abbreviations, sentence starters
and collocations of numbers with what follows their full stop. A second pass classifies every full stop with these statistics; other
marks, quotations, empty lines and Thai blanks follow rules of the script. The language tags of the documents are not used: a word's language is that of its script, and
for Latin script and ideographs that of its text, told by function words and kana.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.staging import stage

#: Combining signs that belong to words, sentence marks, closing signs, emoji.
SIGNS = "̀-ًͯ-ٰٟऀ-ःऺ-़ा-ॏัิ-ฺ็-๎​‍゙゚"
MARKS = ".!?…。！？।॥؟۔｡"
HARD = "!?！？؟。।॥۔｡"
PAIRS = {"«": "»", "“": "”", "„": "“”", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "《": "》", "‹": "›"}
CLOSERS = "»”“\"」』)）]》›'’"
EMOJI = "\U0001f000-\U0001faff☀-➿‍️⭐⭕"
CJK = "぀-ヿ㐀-鿿豈-﫿"
THAI = "ก-๛"

_LETTER = rf"(?:[^\W_]|[{SIGNS}])"
_WORD = re.compile(rf"[^\W_]{_LETTER}*(?:[.'’\-]{_LETTER}+)*")
_LINK = re.compile(r"(?P<whole>(?:https?://|www\.)[^\s«»“”「」()，。！？]+|(?<![\w.+-])[\w.+-]+@[\w.-]+\w)|(?<![A-Za-z0-9_-])(?P<chain>[A-Za-z0-9_-]+(?:\.[a-z0-9_-]+)++)(?P<path>/[^\s«»“”「」()，。！？]*)?")
_MAY_LINK = re.compile(r"://|www\.|@|[A-Za-z0-9_-]\.[a-z]")
_DOMAIN = re.compile(r"\.[a-z]{2,}")
_MARK = re.compile(rf"[{re.escape(MARKS)}]+")
_LINES = re.compile(r"(?<!\s)\s{2,}")
_BRACKET = re.compile(r"[«»“”„「」『』()（）\[\]《》‹›\"]")
_SIGN_RUN = re.compile(r"(?:[^\w\s]|_)*")
_LATIN_WORD = re.compile(r"[a-zà-ÿ]+")
_EMOJI = re.compile(rf"[ \t ]*[{EMOJI}]*[\U0001f000-\U0001faff☀-➿⭐⭕][{EMOJI}]*")
_FACES = re.compile(rf"(?<![{EMOJI}])(?:(?<![ \t ])[ \t ]+)?[{EMOJI}]*[\U0001f000-\U0001faff☀-➿⭐⭕][{EMOJI}]*")
_CJK_START = re.compile(rf"(^|[\n。！？!?])([」』”\"»）)]*)[ \t 　]*([{CJK}]{{1,2}})")
_CJK = re.compile(rf"[{CJK}]")
_THAI = re.compile(f"[{THAI}]")
_KANA = re.compile("[぀-ヿ]")
_LATIN = re.compile("[A-Za-z]")
_THAI_GAP = re.compile(rf"(?<=[{THAI}])([​]*\s[\s​]*)(?=[{THAI}])")

#: Thresholds of the published method: score of an abbreviation, log-likelihood ratio of a starter or collocation.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
COUNTS = ("n", "low", "mid", "strong", "closed", "dot", "digit", "on", "cap", "open")
NUMBER = "##"
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")


#: Function words that tell languages of Latin script apart. A text with none of them, or as many of several, is of the table "latn".
FUNCTION_WORDS = {
    "de": "der die das und ist nicht mit für ein eine einen einem den dem des von zu im auf wir ich sie es sich auch nach bei oder aus wird sind war hat am zum zur".split(),
    "en": "the and is not with for a an of to in on we i you it this that are was has have at by or from be will as".split(),
    "es": "el la los las y es no con por para un una de en que se del al lo su".split(),
    "fr": "le la les et est ne pas avec pour un une de en que se du au des il nous vous".split(),
}
_TONGUES: dict[str, list[str]] = {}
for _lang, _list in FUNCTION_WORDS.items():
    for _w in _list:
        _TONGUES.setdefault(_w, []).append(_lang)


def tongues(text: str) -> tuple[str, str]:
    """(table of its Latin words, table of its ideographs)."""
    latin = "latn"
    if _LATIN.search(text):
        hits: Counter = Counter()
        for w in _LATIN_WORD.findall(text.lower()):
            for lang in _TONGUES.get(w, ()):
                hits[lang] += 1
        best = hits.most_common(2)
        if best and (len(best) == 1 or best[0][1] > best[1][1]):
            latin = best[0][0]
    return latin, "ja" if _KANA.search(text) else "zh"


def script(ch: str, where: tuple[str, str] = ("latn", "zh")) -> str:
    """The table of a character's words, in a text of the given tongues."""
    o = ord(ch)
    if o < 0x250:
        return where[0]
    if 0x400 <= o < 0x530:
        return "cyrl"
    if 0x600 <= o < 0x780:
        return "arab"
    if 0x900 <= o < 0x980:
        return "deva"
    if 0xE00 <= o < 0xE80:
        return "thai"
    if 0x3040 <= o < 0xA000:
        return where[1]
    return "othr"


#: Tables of ideographs, whose starters are the first two signs.
IDEOGRAPHS = ("zh", "ja")


def word_type(word: str) -> str:
    return _short_type(word) if len(word) <= 64 else _type_of(word)


def _type_of(word: str) -> str:
    if word[0].isdigit() and word.replace(".", "").replace("-", "").replace("'", "").isdigit():
        return NUMBER
    word = _STRETCHED.sub(r"\1", word.replace("​", ""))
    return (word if word.isascii() else unicodedata.normalize("NFC", word)).lower()


#: Table, type and case of words seen, by task; bounds the worker's memory only.
SEEN = 300_000
_seen: dict[str, tuple[str, str, bool]] = {}


#: Types of the words met, without those that would make it large.
_short_type = lru_cache(maxsize=200_000)(_type_of)


def count_types(text: str, types: dict, pairs: Counter) -> None:
    """Adds a text's counts by (script, type), in the order of COUNTS, and those of (script, dotted type, next capitalised type)."""
    last_end, prev, where = 0, None, None
    for m in _WORD.finditer(text):
        word, at = m[0], m.start()
        gap = text[last_end:at]
        known = _seen.get(word)
        if known is None:
            if len(_seen) > SEEN:
                _seen.clear()
            known = _seen[word] = (script(word[0], ("", "cjk")), word_type(word), word[0].isupper())
        table, kind, upper = known
        if table == "cjk" or table == "thai":
            prev, last_end = None, m.end()
            continue
        if not table:
            where = where or tongues(text)
            table = where[0]
        key = (table, kind)
        c = types.get(key)
        if c is None:
            c = types[key] = [0] * len(COUNTS)
        c[0] += 1
        if not upper:
            c[1] += 1
        if gap == " " and last_end:
            if upper:
                c[2] += 1
            prev, last_end = key, m.end()
            continue
        bare = gap.replace("​", "").strip()
        if not last_end or gap.count("\n") > 1:
            c[3] += 1
            if prev is not None and not bare:
                types[prev][9] += 1  # at the end of a heading or paragraph a full stop may be missing
        elif bare and any(x in HARD for x in bare) or "…" in bare or ".." in bare:
            c[4 if any(x in CLOSERS for x in bare) else 3] += 1
        elif upper and bare in ("", ",", "–", "-", "—", ":"):
            c[2] += 1
        if prev is not None and bare[:1] == "." and bare[:2] != "..":
            p = types[prev]
            p[5] += 1
            if key[1] == NUMBER:
                p[6] += 1
            elif not upper or bare[1:2] in (",", ";", ":"):
                if word[0].islower() or bare[1:2]:
                    p[7] += 1
                else:
                    p[8] += 1
                    pairs[prev[0], prev[1], key[1]] += 1
            else:
                p[8] += 1
                pairs[prev[0], prev[1], key[1]] += 1
        prev, last_end = key, m.end()
    if prev is not None and text[last_end : last_end + 1] == "." and text[last_end + 1 : last_end + 2] != ".":
        types[prev][5] += 1
    elif prev is not None and not text[last_end:].strip():
        types[prev][9] += 1
    if _CJK.search(text):
        where = where or tongues(text)
        for m in _CJK_START.finditer(text):
            c = types.setdefault((where[1], m[3]), [0] * len(COUNTS))
            c[0] += 1
            c[4 if m[2] else 3] += 1


def dunning(a: Column, b: Column, ab: Column, n: Column, p2: Column | float | None = None) -> Column:
    """Log-likelihood ratio of ``ab`` joint events among ``a`` and ``b`` of ``n``; with ``p2``, against a fixed rate."""
    safe = lambda x: F.least(F.greatest(x, F.lit(1e-9)), F.lit(1 - 1e-9))
    like = lambda k, m, p: k * F.log(safe(p)) + (m - k) * F.log(1 - safe(p))
    p = b / n
    if p2 is not None:
        return -2 * (like(ab, a, p) - like(ab, a, F.lit(p2)))
    p1, rest = ab / a, (b - ab) / F.greatest(n - a, F.lit(1))
    return -2 * (like(ab, a, p) + like(b - ab, n - a, p) - like(ab, a, p1) - like(b - ab, n - a, rest))


@dataclass
class SentenceModel:
    """What the second pass needs. Words are (script, type)."""

    digits: dict[tuple[str, str], float] = field(default_factory=dict)
    """Abbreviations with the share of their full stops that a number follows."""
    starters: dict[tuple[str, str], float] = field(default_factory=dict)
    """Sentence starters with the share of their uses at certain boundaries."""
    lower: set[tuple[str, str]] = field(default_factory=set)
    """Words that occur in lower case and were seen with a capital after an abbreviation or number."""
    ordinals: set[tuple[str, str]] = field(default_factory=set)
    """Words that follow a number's full stop as a collocation."""
    counted: set[tuple[str, str]] = field(default_factory=set)
    """Words whose full stop is nearly always followed by a number."""


_COUNTED = "script string, type string, next string, " + ", ".join(f"{c} long" for c in COUNTS)


def learn(df: DataFrame, text: str) -> SentenceModel:
    """Statistics of all texts. Counts are combined in the tasks before their shuffle; to the driver come only words that pass a test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: dict = {}
        pairs: Counter = Counter()

        def flush() -> pa.RecordBatch:
            cols = [[s for s, _ in types] + [s for s, _, _ in pairs], [t for _, t in types] + [t for _, t, _ in pairs], [None] * len(types) + [x for _, _, x in pairs]]
            nums = [[c[i] for c in types.values()] + [k if i == 0 else 0 for k in pairs.values()] for i in range(len(COUNTS))]
            out = pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), *(pa.array(c, pa.int64()) for c in nums)], names=["script", "type", "next", *COUNTS])
            types.clear()
            pairs.clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    count_types(t, types, pairs)
            if len(types) + len(pairs) > 300_000:
                yield flush()
        yield flush()

    raw = df.select(F.col(f"`{text}`").alias("t")).mapInArrow(run, _COUNTED)
    counted = stage(raw.groupBy("script", "type", "next").agg(*[F.sum(c).alias(c) for c in COUNTS]), "types")
    types = counted.where(F.col("next").isNull()).drop("next")
    totals = F.broadcast(types.groupBy("script").agg(F.sum("n").alias("all"), F.sum("dot").alias("dots"), F.sum("strong").alias("strongs")))  # a row a script
    types = types.join(totals, "script")
    one = F.lit(1.0)
    ratio = F.col("strong") / F.col("n")
    start_llr = dunning(F.col("n") * one, F.col("strongs") * one, F.col("strong") * one, F.col("all") * one)
    starter = F.when(F.col("script").isin(*IDEOGRAPHS), F.col("strong") >= 0.3 * F.col("n")).otherwise((ratio > F.col("strongs") / F.col("all")) & (start_llr >= STARTER))
    starters = stage(types.where((F.col("strong") > 0) & starter & (F.col("type") != NUMBER)).select("script", "type", ratio.alias("share")), "starters")
    # the table of the follower is that of its own row; the same table is assumed, as for nearly all
    pairs = counted.where(F.col("next").isNotNull()).select("script", "type", "next", F.col("n").alias("k"))
    ends = pairs.join(starters.select("script", F.col("type").alias("next")), ["script", "next"], "left_semi").groupBy("script", "type").agg(F.sum("k").alias("ended"))
    periods = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit(""))) + 1
    letters = F.length("type") - periods + 1
    score = dunning(F.col("n") * one, F.col("dots") * one, F.col("dot") * one, F.col("all") * one, 0.99) * F.exp(-letters) * periods * F.pow(letters * one, -F.greatest(F.col("n") - F.col("dot") - F.col("open") - 0.02 * F.col("dot"), F.lit(0.0)))
    goes_on = (F.col("on") + F.col("digit")) / F.col("dot")
    usual_end = (letters > 2) & (periods == 1) & (F.coalesce(F.col("ended"), F.lit(0)) >= 0.6 * (F.col("cap") + 1)) & (goes_on < 0.15)
    abbreviations = types.where((F.col("dot") > 0) & (letters > 0) & (F.col("type") != NUMBER) & (score >= ABBREVIATION)).join(ends, ["script", "type"], "left").where(~usual_end)
    abbreviations = stage(abbreviations.select("script", "type", (F.col("digit") / F.col("dot")).alias("digits")), "abbreviations")
    numbers = types.where(F.col("type") == NUMBER).groupBy().agg(F.sum("dot").alias("dot_n")).first()["dot_n"] or 0
    ordinal = pairs.where(F.col("type") == NUMBER).groupBy("next").agg(F.sum("k").alias("k"))
    vocabulary = types.select("script", F.col("type").alias("next"), "n", "low", "mid", "all")
    ordinal = ordinal.join(vocabulary, "next").where((F.col("k") >= 3) & (F.col("mid") * 5 >= F.col("n") - F.col("k")) & (F.col("low") == 0))
    ordinal = ordinal.where(dunning(F.lit(float(max(numbers, 1))), F.col("n") * one, F.least(F.col("k") * one, F.lit(float(max(numbers, 1)))), F.col("all") * one) >= COLLOCATION)
    counted_llr = dunning(F.col("dot") * one, F.lit(float(numbers)) + 1, F.col("digit") * one, F.col("all") * one)
    counts = types.where((F.col("digit") >= 3) & (F.col("digit") >= 0.8 * F.col("dot")) & (F.col("type") != NUMBER) & (counted_llr >= COLLOCATION))
    after = pairs.join(abbreviations.select("script", "type"), ["script", "type"], "left_semi").unionByName(pairs.where(F.col("type") == NUMBER)).select("next").distinct()
    lower = vocabulary.where((F.col("low") > 0) & (F.col("low") * 5 > F.col("mid"))).join(after, "next", "left_semi")
    rows = lambda d, *c: [tuple(r) for r in d.select(*c).collect()]
    return SentenceModel(
        {(s, t): d for s, t, d in rows(abbreviations, "script", "type", "digits")},
        {(s, t): d for s, t, d in rows(starters, "script", "type", "share")},
        set(rows(lower, "script", "next")),
        set(rows(ordinal, "script", "next")),
        set(rows(counts, "script", "type")),
    )


class Segmenter:
    def __init__(self, model: SentenceModel):
        self.m = model
        #: Words over this length are none of the model's (stretched letters are told apart up to it).
        self.longest = 4 * max((len(t) for _, t in [*model.digits, *model.counted, *model.starters, *model.lower, *model.ordinals]), default=0) + 16

    def _begin(self, text: str) -> None:
        """What is remembered of a text while its marks are read from left to right, so that no stretch is read again for each mark in it."""
        self.text, self.where, self.signs, self.run, self.first = text, None, (0, 0, None), (-1, -1), (-1, -1)

    def _script(self, ch: str) -> str:
        if self.where is None and (ch < "\u0250" or "\u3040" <= ch < "\ua000"):
            self.where = tongues(self.text)
        return script(ch, self.where or ("latn", "zh"))

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the sentences, in code points; together they cover all that is not white space."""
        out, start = [], 0
        for cut in [*self._cuts(text), len(text)]:
            a, b = start, cut
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if a < b:
                out.append((a, b))
            start = max(start, cut)
        return out

    def _cuts(self, text: str) -> list[int]:
        self._begin(text)
        blank = [(m.start(), m.end()) for m in _LINES.finditer(text) if m[0].count("\n") > 1 or (m[0].count("\r") > 1 and "\n" not in m[0])]
        cuts = {e for _, e in blank}
        quoted = self._quoted(text, blank)
        links = self._links(text)
        caseless = text == text.lower()
        unit = 0
        ends, next_end = sorted(cuts), 0
        thai = {m.end() for m in _THAI_GAP.finditer(text) if not quoted[m.start()]} if _THAI.search(text) else set()
        cuts |= thai
        li = 0
        for m in _MARK.finditer(text):
            i, j = m.start(), m.end()
            if i < unit:
                continue
            while next_end < len(ends) and ends[next_end] <= i:
                unit = max(unit, ends[next_end])
                next_end += 1
            while li < len(links) and links[li][1] <= i:
                li += 1
            if li < len(links) and links[li][0] <= i < links[li][1] and (j < links[li][1]):
                continue
            closed = j
            while closed < len(text) and text[closed] in CLOSERS and (text[closed] not in "\"“'’" or quoted[closed] == 2):
                closed += 1
            if quoted[i] and (closed == j or closed < len(text) and quoted[closed]):
                continue  # inside a quotation that goes on
            if j < closed < len(text) and text[closed] in MARKS:
                continue  # the mark after the closing sign decides
            in_quote = bool(quoted[i])
            end = closed
            while end < len(text) and text[end] in MARKS and text[end] != ".":
                end += 1
            k = end
            while k < len(text) and text[k] in " \t ":
                k += 1
            face = _EMOJI.match(text, end) if k < len(text) and text[k] >= "\u200d" else None
            if face:
                end = face.end()
            if self._breaks(text, i, j, closed, end, in_quote, bool(face), caseless, unit):
                cuts.add(end)
                unit = end
        # an emoji after a Thai sentence closes it
        if thai or _CJK.search(text):
            for face in _FACES.finditer(text):
                b = face.start()
                if b and _THAI.match(text[b - 1]) and not quoted[b - 1]:
                    cuts.add(face.end())
        return sorted(cuts)

    @staticmethod
    def _links(text: str) -> list[tuple[int, int]]:
        """(start, end) of web and mail addresses. Labels parted by full stops are read once, and are an address up to the last that could be a domain."""
        out = []
        if not _MAY_LINK.search(text):
            return out
        for m in _LINK.finditer(text):
            if m["whole"]:
                out.append(m.span())
                continue
            last = None
            for last in _DOMAIN.finditer(text, m.start("chain"), m.end("chain")):
                pass
            if last:
                out.append((m.start(), m.end() if last.end() == m.end("chain") else last.end()))
        return out

    @staticmethod
    def _quoted(text: str, blank: list[tuple[int, int]]) -> bytearray:
        """1 inside a quotation or bracket, 2 at its closing sign; one left open at an empty line or the end is none."""
        mark = bytearray(len(text) + 1)
        stack: list[tuple[int, str]] = []
        closed: list[tuple[int, int]] = []
        outer: list[int] = []
        awaited: Counter = Counter()  # closing signs that would end something open
        edges = iter([*(a for a, _ in blank), len(text) + 1])
        edge = next(edges)
        for m in _BRACKET.finditer(text):
            i, ch = m.start(), m[0]
            while i >= edge:
                stack.clear()
                awaited.clear()
                edge = next(edges)
            opened = next((k for k in range(len(stack) - 1, -1, -1) if ch in stack[k][1]), -1) if awaited[ch] > 0 else -1
            if opened >= 0 and not (ch == "“" and stack[opened][1] == "”"):
                closed.append((stack[opened][0], i + 1))
                for _, ends in stack[opened:]:
                    awaited.subtract(ends)
                del stack[opened:]
                if not stack:
                    outer.append(i)
            elif ch == '"':
                stack.append((i, '"'))
                awaited['"'] += 1
            elif ch in PAIRS:
                stack.append((i, PAIRS[ch]))
                awaited.update(PAIRS[ch])
        done = 0
        for a, b in sorted(closed, key=lambda r: (r[0], -r[1])):  # nested stretches are within their outermost
            if b > done:
                mark[max(a, done) : b] = b"\1" * (b - max(a, done))
                done = b
        for i in outer:
            mark[i] = 2
        return mark

    def _next_word(self, text: str, at: int) -> tuple[str, str, bool, bool]:
        """(first sign before it, word, whether a line break lies before, whether a blank does) of what follows."""
        k, line = at, False
        while k < len(text) and (text[k].isspace() or text[k] == "​"):
            line |= text[k] == "\n"
            k += 1
        space, sign = k > at, ""
        a, b, word = self.signs
        if not a <= k < b:
            b = _SIGN_RUN.match(text, k).end()
            end = b
            while end < len(text) and text[end].isspace():
                end += 1
            m = _WORD.match(text, end, end + self.longest)  # a longer word is in no set either
            self.signs = k, b, (word := m[0] if m else "")
        if k < b:
            sign = text[k]
        return sign, word, line, space

    def _starts(self, word: str, share: float = 0.0) -> bool:
        s = self._script(word[0])
        if s in IDEOGRAPHS:
            return (s, word[:2]) in self.m.starters
        return self.m.starters.get((s, word_type(word)), -1.0) >= share and (s, word_type(word)) in self.m.starters

    def _goes_on(self, text: str, at: int, caseless: bool) -> bool:
        """Whether the sentence goes on after a closing quotation mark."""
        sign, word, line, _ = self._next_word(text, at)
        if sign[:1] in tuple(",;:，；：、،؛"):
            return True
        if not word:
            return False
        c, s = word[0], self._script(word[0])
        if c.isdigit():
            return False
        if s in IDEOGRAPHS:
            return not line and not self._starts(word)
        if c.isupper():
            return False
        if c.islower() and not caseless:
            return True
        return not self._starts(word, 0.0 if s in ("arab", "deva") else 0.1)

    def _breaks(self, text: str, i: int, j: int, closed: int, end: int, in_quote: bool, face: bool, caseless: bool, unit: int) -> bool:
        marks = text[i:j]
        if end >= len(text):
            return True
        if in_quote:
            return face or not self._goes_on(text, end, caseless)
        if closed > j and not face and self._goes_on(text, closed, caseless):
            return False
        if any(c in HARD for c in marks):
            return True
        after = text[end]
        sign, word, line, space = self._next_word(text, end)
        if "…" in marks or len(marks) > 1:
            if face:
                return True
            near = text[i - 1 : i] + (word[:1] if not sign else "")
            if _CJK.search(near):
                return line
            return not (word[:1].islower() and not (caseless and self._starts(word, 0.1)))
        if face:
            return True
        if not (space or after in CLOSERS) and closed == j:
            if _CJK.match(after) or self._script(after) in ("arab", "deva") and after.isalpha():
                pass
            elif not (after.isupper() or after in PAIRS or after in "—–"):
                return False
        return self._full_stop(text, i, sign, word, line, space, caseless, unit)

    def _full_stop(self, text: str, i: int, sign: str, word: str, line: bool, space: bool, caseless: bool, unit: int) -> bool:
        m = self.m
        a, (run_end, run_start) = i, self.run
        while a > unit and (text[a - 1].isalnum() or text[a - 1] in ".-'’​‍" or unicodedata.combining(text[a - 1]) or unicodedata.category(text[a - 1]) in ("Mn", "Mc")):
            if a - 1 == run_end:  # the run of an earlier full stop goes on
                a = max(run_start, unit)
                break
            a -= 1
        self.run = i, a
        long = i - a > self.longest and text.find(".", a, i) >= 0
        left = text[a : a + 16 if long else i].strip("-'’.​")
        if not left:
            return True
        lead, s = word[:1], self._script(left[0])
        nxt = (self._script(word[0]), word_type(word)) if word else ("", "")
        if lead and sign and sign[0] in ",;:，；":
            return False
        if long:
            return True
        number = word_type(left) == NUMBER
        if number or left[0].isdigit():
            if not left.isdigit():
                return True  # decimals, times, dates
            if self.first[0] != unit:
                k = unit
                while k < a and text[k].isspace():
                    k += 1
                self.first = unit, k
            head = self.first[1] >= a
            if head and len(left) <= 3 and space and lead:
                return False  # a list number belongs to what follows
            if not lead or lead.isdigit():
                return not lead or space
            if lead.islower() and not caseless:
                return True
            return nxt not in m.ordinals
        kind = (s, word_type(left))
        initial = len(left) == 1 and (left.isupper() or s in ("arab", "deva"))
        if len(left) == 1 and kind not in m.digits and not initial:
            before = re.search(r"(\w{1,2})\.\s?$", text[max(unit, a - 5) : a])  # second part of an abbreviation such as one of two letters
            initial = bool(before and (s, before[1].lower()) in m.digits)
        if kind in m.counted and lead.isdigit():
            return False
        if kind not in m.digits and not initial:
            if not space and lead.isupper() and len(left) < 2:
                return False
            return True
        if not lead:
            return True
        if lead.isdigit():
            return not initial and m.digits.get(kind, 1.0) < 0.15
        if lead.islower() and not caseless:
            return False
        if not (lead.isupper() or lead.islower()):
            return kind not in m.digits and not initial or self._script(lead) != s and self._starts(word)
        if caseless:
            return self._starts(word, 0.1) and not initial
        if sign[:1] in ("—", "–") and not line:
            return True
        if initial and left.isupper() and kind not in m.starters:
            # an initial before a name; a common word or starter after it begins a sentence
            return self._starts(word) and nxt in m.lower
        if self._starts(word) or nxt in m.lower:
            return True
        return False


def split_sentences(df: DataFrame, key: str, text: str, model: SentenceModel | None = None, *, names: tuple[str, str] = ("sent_start", "sent_end")) -> DataFrame:
    """(key, sent_start, sent_end): one row per sentence, code-point offsets, end exclusive, without surrounding white space.

    Null, empty and blank texts give no rows; every other text is covered whole. Repeated rows are each split. The model is learned from
    ``df`` itself if none is given; its size grows with the vocabulary of abbreviations and starters, not with the texts. No shuffle but that of the counts.
    """
    if key in names:
        raise ValueError("the key may not have an output's name")
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model or learn(df, text))
    kept = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("__text")).where(F.col("__text").isNotNull())
    kind = kept.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Segmenter(shared.value)
        for batch in batches:
            rows, a, b = [], [], []
            for r, t in enumerate(batch.column(1).to_pylist()):
                for x, y in cutter.spans(t):
                    rows.append(r)
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=[key, *names])

    return kept.mapInArrow(run, f"`{key}` {kind}, `{names[0]}` int, `{names[1]}` int")
