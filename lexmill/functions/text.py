"""Column functions on text: repair of line breaks, words, names, scripts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.schemas import DEFAULT, Settings

# ---- fixed values ----
#: Soft hyphen, zero-width space, non-breaking hyphen.
SOFT = "­​‑"
#: Letters that line-break repair joins; accented Latin letters are not among them.
LETTER = "[a-zа-яA-ZА-ЯёЁ]"
#: What a name keeps.
NAME_DROPS = "[^a-zA-Z0-9а-яА-ЯёЁ/]"
#: Characters that count as digits: decimal digits, and digits raised, lowered, circled and the like.
DIGIT = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒፩-፱᧚]"
WORD = r"[\p{L}\p{N}]+"
BROKEN = "—"
#: Line-break repair. Letters of a word's head before a hyphen, and before white space; lengths up to which parts are joined:
#: both together, both together across white space, each of them, a head with any tail not shorter; a long head and its tail.
HEAD, SPACED_HEAD = 10, 8
JOIN_UP_TO, JOIN_SPACED, BOTH_SHORT, SHORT_HEAD = 25, 15, 5, 3
LONG_HEAD, SHORT_TAIL = "6,15", "2,6"
#: White space, as Python's \\s has it.
SPACE = r"\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# ----


def strip_soft(text: Column) -> Column:
    return F.translate(text, SOFT, "")


def words_of(text: Column, settings: Settings = DEFAULT) -> Column:
    """Array of the words of a text, in lower case, without those that hold digits or are too short or long."""
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    fits = lambda w: F.length(w).between(settings.shortest, settings.longest)
    # words are looked at for digits only in texts that have some
    kept = F.when(text.rlike(DIGIT), F.filter(found, lambda w: fits(w) & ~w.rlike(DIGIT))).otherwise(F.filter(found, fits))
    return F.coalesce(kept, F.array().cast("array<string>"))


def each(table: DataFrame, *kept: str, **array: Column) -> DataFrame:
    """kept, and a row for each element that isn't null of one array, named by its keyword.

    explode would first filter by the array's size, and so make the array twice; the outer form does not.
    """
    ((name, values),) = array.items()
    return table.select(*kept, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda p: p.rlike(r"(?U)\S"))


def script_language(word: Column) -> Column:
    """ru if any letter from а to я is in it, in either case (ё is not among them), else en."""
    return F.when(word.rlike("[а-яА-Я]"), "ru").otherwise("en")


def other_language(word: Column) -> Column:
    return F.when(word.rlike("[а-яА-Я]"), "en").otherwise("ru")


def valid_translation(word: Column, translation: Column) -> Column:
    """Whether a translation says something: not blank, not an empty pair of quotes, not the word, not the mark of a failed request."""
    bare = F.regexp_replace(translation, r"(?U)^\s+|\s+$", "")
    return F.coalesce((bare != "") & (translation != '""') & (bare != BROKEN) & (F.lower(translation) != F.lower(word)), F.lit(False))


def plain_name(path: Column) -> Column:
    """A path up to its first dot, of letters, digits and slashes only."""
    return F.regexp_replace(F.substring_index(path, ".", 1), NAME_DROPS, "")


def clean_filename(name: Column) -> Column:
    """A file name with one dot at most; names with one dot or none stay as they are."""
    out = name
    for old, new in ((".", "_"), (" ", "_"), (",", "_"), ("__", "_"), ("___", "_"), ("[", "_"), ("]", "_"), ("_pdf", ".pdf")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.when(F.length(name) - F.length(F.replace(name, F.lit("."), F.lit(""))) > 1, out).otherwise(name)


# ---- line-break repair ----

#: A run of white space that holds a line feed, looked at once: whether it does is seen ahead, then the run is passed without going back.
_BREAK = r"(?=[^\S\n]*+\n)\s*+"
#: The same with white space behind that line feed.
_WIDE = r"(?=[^\S\n]*+\n\s)\s++"


def _short_enough(m: re.Match) -> str:
    return m[1] + m[2] if len(m[1]) + len(m[2]) <= JOIN_UP_TO else m[0]


def _belongs(m: re.Match) -> str:
    a, b = len(m[1]), len(m[2])
    return m[1] + m[2] if max(a, b) <= BOTH_SHORT or (a <= SHORT_HEAD <= b) or a + b <= JOIN_SPACED else m[0]


#: In this order, each over what the one before it made. A run of white space ends at something else on both sides, so
#: each pattern asks about whole runs: none tries its parts one after another, and all take time in proportion to the text.
_STEPS = [
    (re.compile(rf"({LETTER}{{1,{HEAD}}})\s*+-{_BREAK}({LETTER}{{2,}})"), _short_enough),
    (re.compile(rf"({LETTER}{{1,{HEAD}}})\s*+-\s++({LETTER}{{2,}})"), _short_enough),
    (re.compile(rf"({LETTER}{{1,{SPACED_HEAD}}})\s{_WIDE}({LETTER}{{2,}})"), _belongs),
    (re.compile(rf"({LETTER}{{1,{SPACED_HEAD}}})\r?\n\s++({LETTER}{{2,}})"), _belongs),
    (re.compile(rf"([.,;:!?]|(?<![\s.,;:!?])\s){_WIDE}({LETTER}{{2,}})"), r"\1 \2"),
    (re.compile(rf"(\A|(?<=\S)[^\S\n]*+\n){_WIDE}({LETTER}{{2,}})"), r"\1\2"),
    (re.compile(rf"({LETTER}{{{LONG_HEAD}}})\s*+-{_BREAK}({LETTER}{{{SHORT_TAIL}}})"), _short_enough),
    (re.compile(rf"({LETTER}){_BREAK}({LETTER})"), r"\1 \2"),
]


def mend(text: str | None) -> str | None:
    """Words that a line break cut in two are joined, other line breaks between letters become spaces."""
    if text is None:
        return None
    text = text.translate(dict.fromkeys(map(ord, SOFT)))
    if "\n" not in text and "-" not in text:
        return text
    for pattern, put in _STEPS:
        text = pattern.sub(put, text)
    return text


def _mend(texts: pd.Series) -> pd.Series:
    """mend() of a column held by Python, for what isn't Spark's."""
    return texts.map(mend)


# The same steps as patterns of the JVM. They begin at the break, since most letters have none behind them: the head is looked at from there,
# backwards, and stays as it is. What a match took as its tail is no head, so a break where the last match ended (\G) is none. The head is as long as
# the letters before the break, or as the most that a head has; parts that don't fit are passed as they are, by the last alternative.

#: No break begins with a letter: one look tells nearly all places of a text.
_QUICK = "(?![a-zа-я])"


def _joins(gap: str, fitting: list[tuple[int, str]]) -> tuple[str, str]:
    """Pattern and replacement: a gap between letters goes for lengths (what the head falls short of, or 0; of the tail) in fitting, else stays."""
    ways = [(f"(?<!{LETTER}{{{h}}})" if h else "") + rf"{gap}({LETTER}{{{t}}})(?!{LETTER})" for h, t in fitting]
    return rf"{_QUICK}(?<={LETTER})(?!\G)(?={gap}{LETTER}{{2}})(?:{'|'.join(ways)}|({gap}{LETTER}{{2,}}))", "".join(f"${i}" for i in range(1, len(ways) + 2))


def _jvm_steps() -> list[tuple[str, str]]:
    white, other = f"[{SPACE}]", f"[^{SPACE}]"
    within = f"[{SPACE}&&[^\\n]]"
    to_break, wide = f"(?={within}*+\\n){white}*+", f"(?={within}*+\\n{white}){white}++"
    # from the longest head down: a tail that fits a head fits all shorter ones
    short = [(0, f"2,{JOIN_UP_TO - HEAD}"), *[(h + 1, f"2,{JOIN_UP_TO - h}") for h in range(HEAD - 1, 0, -1)]]
    fits = lambda h: max(JOIN_SPACED - h, BOTH_SHORT if h <= BOTH_SHORT else 0)
    near = [(0, f"2,{fits(SPACED_HEAD)}"), *[(h + 1, f"2,{fits(h)}") for h in range(SPACED_HEAD - 1, SHORT_HEAD, -1)], (SHORT_HEAD + 1, "2,")]
    least = int(LONG_HEAD.split(",")[0])
    return [
        _joins(f"{white}*+-{to_break}", short),
        _joins(f"{white}*+-{white}++", short),
        _joins(f"{white}{wide}", near),
        _joins(f"\\r?\\n{white}++", near),
        (f"{_QUICK}(?=[.,;:!?{SPACE}]{white}{{2}})([.,;:!?]|(?<![{SPACE}.,;:!?]){white}){wide}({LETTER}{{2,}})", "$1 $2"),
        (f"{_QUICK}(?={white}{{2}})(\\A|(?<={other}){within}*+\\n){wide}({LETTER}{{2,}})", "$1$2"),
        # here a tail may end within letters, so those behind it have to be enough for a head
        (f"{_QUICK}(?<={LETTER}{{{least}}})(?<!\\G{LETTER}{{0,{least - 1}}}){white}*+-{to_break}({LETTER}{{{SHORT_TAIL}}})", "$1"),
        (f"{_QUICK}(?<={LETTER})(?!\\G){to_break}({LETTER})", " $1"),
    ]


def mend_breaks(text: Column) -> Column:
    """Line-break repair of lower-cased text.

    All steps but the last need white space behind a hyphen or a line feed; only texts with that go through all of them.
    """
    bare = strip_soft(text)
    # a letter, white space that ends in a line feed, a letter: such texts have no other breaks between letters
    last = F.regexp_replace(bare, F.lit(rf"({LETTER})[{SPACE}]*+(?<=\n)({LETTER})"), F.lit("$1 $2"))
    every = bare
    for pattern, put in _jvm_steps():
        every = F.regexp_replace(every, F.lit(pattern), F.lit(put))
    return F.when(bare.rlike(rf"[-\n][{SPACE}]"), every).otherwise(last)
